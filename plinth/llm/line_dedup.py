"""Line dedup: later occurrences of three-line windows go.

All windows of consecutive lines are hashed (128 bits) and counted over the whole
corpus.  An occurrence is later if the same window stands at a smaller
(id, line); the lines of later occurrences are removed, windows that overlap
being merged into one covered stretch.  So each removed line still stands at an
earlier place, and what a document shares with none stays untouched.

With ``piece_words`` lines are also cut after sentence ends, and three consecutive
pieces of so many words in all are a window too, wherever the lines break: so a
passage inside one or two lines, or one that begins inside a line, is seen.  The
pieces of later occurrences go; a line goes when nothing is left of it.

Everything is DataFrame functions: windows are made inside the row, first places
are a grouped minimum with map-side combining, and a frequent window is a skewed
key of a plain equi-join only, which Spark splits.

Defined results: a null text stays null and has no lines; a text of fewer lines
than the window has no window; windows of blank lines don't count.  Rows of null
id keep all of their lines.  Rows that share an id and a text are at one place,
so they keep the same lines.  Other columns pass through; existing columns n_lines
and n_removed are replaced.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Sentence ends, after the blanks that follow them.
PIECE_END = r"(?<=[.!?。！？]\s)(?=\S)"


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = 3, piece_words: int | None = None) -> DataFrame:
    """``docs`` with the text's kept lines, and n_lines and n_removed."""
    if piece_words is not None:
        return _dedup_pieces(docs, id_col, text, window, piece_words)
    body = F.col(text).cast("string")
    lines, state = F.split(body, "\n"), F.xxhash64(body)

    def of(start):
        own = [F.get("lines", start + i) for i in range(window)]
        blank = F.length(F.trim(F.concat(*own))) == 0
        return F.struct(start.alias("at"), F.xxhash64(F.lit(1), *own).alias("h1"), F.xxhash64(F.lit(2), *own).alias("h2"), blank.alias("blank"))

    split = docs.where(F.col(id_col).isNotNull() & body.isNotNull()).select(F.col(id_col).alias("id"), state.alias("state"), lines.alias("lines")).where(F.size("lines") >= window)
    windows = split.select("id", "state", F.explode(F.transform(F.sequence(F.lit(0), F.size("lines") - window), of)).alias("w"))
    windows = cut(windows.where("not w.blank").select("id", "state", "w.at", "w.h1", "w.h2"), "windows")
    first = windows.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(F.struct("id", "at")).alias("first")).where("n > 1").select("h1", "h2", "first")
    later = windows.join(first, ["h1", "h2"]).where(F.struct("id", "at") > F.col("first"))
    covered = later.groupBy(F.col("id").alias("__line_id"), F.col("state").alias("__line_state")).agg(F.collect_set("at").alias("__line_starts"))

    joined = docs.withColumn("__line_own", state).join(covered, (F.col(id_col) == F.col("__line_id")) & (F.col("__line_own") == F.col("__line_state")), "left")
    gone = F.flatten(F.transform("__line_starts", lambda s: F.sequence(s, s + (window - 1))))
    told = F.struct(lines.alias("lines"), F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone).alias("kept"))
    shorter = _once(told, lambda x: F.struct(F.size(x["kept"]).alias("n"), F.array_join(F.transform(x["kept"], lambda i: F.get(x["lines"], i)), "\n").alias("text")))
    joined = joined.withColumn("__line_new", F.when(F.col("__line_starts").isNotNull(), shorter))
    n_lines = F.when(body.isNull(), 0).otherwise(F.size(lines)).cast("long")
    out = joined.withColumns(
        {
            "n_lines": n_lines, "n_removed": F.when(F.col("__line_new").isNull(), F.lit(0)).otherwise(n_lines - F.col("__line_new.n")).cast("long"),
            "__line_text": F.when(F.col("__line_new").isNull(), body).otherwise(F.col("__line_new.text")),
        }
    )
    return out.withColumn(text, F.col("__line_text")).drop("__line_own", "__line_id", "__line_state", "__line_starts", "__line_new", "__line_text")


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is made once a row, however often ``then`` (or a function inside of it) names it."""
    return F.get(F.transform(F.array(value), then), 0)


def _dedup_pieces(docs: DataFrame, id_col: str, text: str, window: int, least: int) -> DataFrame:
    """Windows of lines and of pieces; both are stretches of the text's pieces, ``at`` to ``upto``."""
    body = F.col(text).cast("string")
    lines, state = F.split(body, "\n"), F.xxhash64(body)
    pieces = F.flatten(F.transform(lines, lambda line, i: F.transform(F.split(line, PIECE_END), lambda p, j: F.struct(i.alias("line"), j.alias("nth"), p.alias("p")))))

    def stretch(salt, at, upto, own, counts):
        return F.struct(at.alias("at"), upto.alias("upto"), F.xxhash64(F.lit(salt), *own).alias("h1"), F.xxhash64(F.lit(salt + 1), *own).alias("h2"), counts.alias("counts"))

    def of_lines(i):
        own = [F.get("lines", i + k) for k in range(window)]
        end = F.coalesce(F.get("starts", i + window), F.size("pieces")) - 1
        return stretch(1, F.get("starts", i), end, own, F.length(F.trim(F.concat(*own))) > 0)

    def of_pieces(k):
        own = [F.rtrim(F.get("pieces", k + n)["p"]) for n in range(window)]
        return stretch(3, k, k + (window - 1), own, F.size(F.split(F.trim(F.concat_ws(" ", *own)), r"\s+")) >= least)

    def each(column, of):
        return F.when(F.size(column) >= window, F.transform(F.sequence(F.lit(0), F.size(column) - window), of)).otherwise(F.array())

    split = docs.where(F.col(id_col).isNotNull() & body.isNotNull()).select(F.col(id_col).alias("id"), state.alias("state"), lines.alias("lines"), pieces.alias("pieces"))
    split = split.withColumn("starts", F.filter(F.transform("pieces", lambda x, k: F.when(x["nth"] == 0, k)), lambda k: k.isNotNull()))
    windows = split.select("id", "state", F.explode(F.concat(each("lines", of_lines), each("pieces", of_pieces))).alias("w"))
    windows = cut(windows.where("w.counts").select("id", "state", "w.at", "w.upto", "w.h1", "w.h2"), "pieces")
    first = windows.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(F.struct("id", "at")).alias("first")).where("n > 1").select("h1", "h2", "first")
    later = windows.join(first, ["h1", "h2"]).where(F.struct("id", "at") > F.col("first"))
    covered = later.groupBy(F.col("id").alias("__line_id"), F.col("state").alias("__line_state")).agg(F.collect_set(F.struct("at", "upto")).alias("__line_gone"))

    joined = docs.withColumn("__line_own", state).join(covered, (F.col(id_col) == F.col("__line_id")) & (F.col("__line_own") == F.col("__line_state")), "left")
    gone = F.flatten(F.transform("__line_gone", lambda g: F.sequence(g["at"], g["upto"])))

    def left_over(x):
        return F.transform(F.array_except(F.sequence(F.lit(0), F.size(x["pieces"]) - 1), x["gone"]), lambda k: F.get(x["pieces"], k))

    def shown(left):
        each = lambda x, n: F.concat(x["p"], F.when(F.get(left, n + 1)["line"] != x["line"], "\n").otherwise(""))
        return F.struct(F.size(F.array_distinct(F.transform(left, lambda x: x["line"]))).alias("n"), F.array_join(F.transform(left, each), "").alias("text"))

    shorter = _once(F.struct(pieces.alias("pieces"), gone.alias("gone")), lambda x: _once(left_over(x), shown))
    joined = joined.withColumn("__line_new", F.when(F.col("__line_gone").isNotNull(), shorter))
    n_lines = F.when(body.isNull(), 0).otherwise(F.size(lines)).cast("long")
    out = joined.withColumns(
        {
            "n_lines": n_lines, "n_removed": F.when(F.col("__line_new").isNull(), F.lit(0)).otherwise(n_lines - F.col("__line_new.n")).cast("long"),
            "__line_text": F.when(F.col("__line_new").isNull(), body).otherwise(F.col("__line_new.text")),
        }
    )
    return out.withColumn(text, F.col("__line_text")).drop("__line_own", "__line_id", "__line_state", "__line_gone", "__line_new", "__line_text")
