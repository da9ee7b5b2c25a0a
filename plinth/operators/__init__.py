"""The steps of plans and the edits of tables; each maps a frame to a frame."""

from .edits import EDITS
from .steps import STEPS

__all__ = ["EDITS", "STEPS"]
