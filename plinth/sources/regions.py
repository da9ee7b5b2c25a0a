"""Table regions in sheets of cells, by window functions over rows and columns.

A sheet's rows that hold something form bands, which empty rows part, and a band's
columns that hold something form blocks, which empty columns part.  A block goes on
with one below it after at most two empty rows if that one is no wider and has
totals or looks like data; small blocks that no table takes are titles or notes.
A table's header is one of its first five rows: all text, and half of the width.
A sparse row of texts above it has labels of groups.  Without a header the table's
first row is data and its header_row the row above.  Totals fill at most 70 % of
the width, rounded up (all of three columns); a single text in a table of three
columns or more labels a section.

Cells are put together to runs of a row, which are dealt by their sheet once; what
follows goes by sheet too and deals nothing again.  Blocks of one sheet (not its
cells) are put together in one array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.cells import bare, blank
from .profile import text_class

TOTAL = r"(?i)\b(grand\s*total|sub-?\s*total|total)s?\b"
MAX_GAP = 2
_NO_BOXES = "cast(array() as array<struct<top:bigint,left:bigint,bottom:bigint,right:bigint>>)"


def _header_like(width):
    least = F.when(width == 1, 1).otherwise(F.greatest(F.lit(2), F.ceil(width * 0.5)))
    return (F.col("texts") == F.col("filled")) & (F.col("filled") >= least)


def _box(x):
    return F.struct(*[x[k].alias(k) for k in ("top", "left", "bottom", "right")])


def _holds(o, x):
    return (o["top"] <= x["top"]) & (o["left"] <= x["left"]) & (o["bottom"] >= x["bottom"]) & (o["right"] >= x["right"])


def _merged(found, b):
    """The tables so far with the next block: taken by the first that it goes on with, or a table of its own."""

    def takes(r):
        dense = (b["bottom"] - b["top"] >= 2) | (b["filled"] > (r["right"] - r["left"] + 1) * 0.5)
        near = (b["top"] > r["bottom"]) & (b["top"] - r["bottom"] - 1 <= MAX_GAP) & (b["left"] >= r["left"]) & (b["right"] <= r["right"])
        return near & (b["totals"] | (dense & ~b["fresh"]))

    by = F.array_position(F.transform(found, takes), True)
    longer = F.transform(found, lambda r, k: F.struct(r["top"].alias("top"), r["left"].alias("left"), F.when(k + 1 == by, b["bottom"]).otherwise(r["bottom"]).alias("bottom"), r["right"].alias("right")))
    return F.when(by > 0, longer).when(b["note"] | b["totals"], found).otherwise(F.concat(found, F.array(_box(b))))


def rows_by_role(cells: DataFrame) -> DataFrame:
    """sheet, row, region, role (title, group, header, data, totals or label) of rows that hold something, and the region's box.

    ``cells``: sheet, row, col, value (text).  A row has one role in each region that it crosses; titles and notes
    outside of regions have none (null).
    """
    there = cells.where(~blank(F.col("value"), True)).select("sheet", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), text_class(F.col("value")).alias("text"), F.col("value").rlike(TOTAL).alias("total")).dropna(subset=["sheet", "row", "col"])
    after = lambda at, along: F.coalesce(F.col(at) - F.lag(at).over(along) > 1, F.lit(False)).cast("int")
    in_row = Window.partitionBy("sheet", "row").orderBy("col")
    runs = there.withColumn("_new", after("col", in_row)).withColumn("_run", F.sum("_new").over(in_row)).groupBy("sheet", "row", "_run").agg(
        F.min("col").alias("c0"), F.max("col").alias("c1"), F.count(F.lit(1)).alias("filled"), F.count_if(F.col("text")).alias("texts"), F.max("total").alias("total"),
    )
    down = Window.partitionBy("sheet").orderBy("row")
    banded = runs.withColumn("_new", after("row", down)).withColumn("band", F.sum("_new").over(down))
    across = Window.partitionBy("sheet", "band").orderBy("c0")
    gap = F.coalesce(F.col("c0") - F.max("c1").over(across.rowsBetween(Window.unboundedPreceding, -1)) > 1, F.lit(False)).cast("int")
    row = banded.withColumn("_new", gap).withColumn("part", F.sum("_new").over(across)).groupBy("sheet", "band", "part", "row").agg(
        F.sum("filled").alias("filled"), F.sum("texts").alias("texts"), F.max("total").alias("total"), F.min("c0").alias("c0"), F.max("c1").alias("c1"),
    )
    block = Window.partitionBy("sheet", "band", "part")
    boxed = row.withColumns({"top": F.min("row").over(block), "bottom": F.max("row").over(block), "left": F.min("c0").over(block), "right": F.max("c1").over(block)})
    like = _header_like(F.col("right") - F.col("left") + 1)
    at = lambda n, c: F.coalesce(F.max(F.when(F.col("row") == F.col("top") + n, c)), F.lit(False))
    blocks = boxed.groupBy("sheet", "band", "part", "top", "left", "bottom", "right").agg(F.sum("filled").alias("filled"), at(0, F.col("total")).alias("total"), at(0, like).alias("first"), at(1, like).alias("second"))
    short = F.col("bottom") - F.col("top") <= 1
    told = F.struct(
        "top", "left", "bottom", "right", "band", "part", "filled", (short & (F.col("filled") <= 2)).alias("note"), (short & F.col("total")).alias("totals"), (F.col("first") & ~F.col("second") & (F.col("bottom") > F.col("top"))).alias("fresh"),
    )
    sheets = blocks.groupBy("sheet").agg(F.array_sort(F.collect_list(told)).alias("blocks"))
    sheets = sheets.withColumn("found", F.aggregate("blocks", F.expr(_NO_BOXES), _merged))
    sheets = sheets.withColumn("found", F.filter("found", lambda r: ~F.exists("found", lambda o: (o != r) & _holds(o, r))))
    region = F.array_position(F.transform("found", lambda o: _holds(o, F.struct("top", "left", "bottom", "right"))), True)
    owned = boxed.join(sheets.select("sheet", "found"), "sheet").withColumn("region", region).withColumns({"region": F.when(F.col("region") > 0, F.col("region")), "box": F.get("found", (F.col("region") - 1).cast("int"))})
    rows = owned.groupBy("sheet", "region", "box", "row").agg(
        F.sum("filled").alias("filled"), F.sum("texts").alias("texts"), F.max("total").alias("total"), F.min("c0").alias("c0"), F.max("c1").alias("c1"),
    )
    width = F.col("box.right") - F.col("box.left") + 1
    could = _header_like(width) & (F.col("row") <= F.least(F.col("box.top") + 4, F.col("box.bottom") - 1))
    headed = rows.withColumn("header", F.min(F.when(could, F.col("row"))).over(Window.partitionBy("sheet", "region")))
    title = (F.col("filled") == 1) & (F.col("c0") == F.col("box.left")) & (width > 2)
    group = (F.col("row") == F.col("header") - 1) & (F.col("texts") == F.col("filled")) & (F.col("filled") < width) & ~title
    role = (
        F.when(F.col("region").isNull(), "title").when(F.col("row") == F.col("header"), "header").when(group, "group").when(F.col("row") < F.col("header"), "title")
        .when(F.col("total") & (F.col("filled") <= F.ceil(width * 0.7)), "totals").when((F.col("filled") == 1) & (width >= 3) & (F.col("texts") == 1), "label").otherwise("data")
    )
    return headed.select("sheet", "row", "region", role.alias("role"), "c0", "c1", "box")


def regions(cells: DataFrame) -> DataFrame:
    """sheet, region, header_row, header_rows, first_row, last_row, first_col, last_col, rows, skipped of each table."""
    is_ = lambda *roles: F.col("role").isin(*roles)
    return rows_by_role(cells).where("region is not null").groupBy("sheet", "region").agg(
        F.coalesce(F.max(F.when(is_("header"), F.col("row"))), F.first("box.top") - 1).alias("header_row"), F.count_if(is_("header", "group")).alias("header_rows"),
        F.min(F.when(is_("data"), F.col("row"))).alias("first_row"), F.max(F.when(is_("data"), F.col("row"))).alias("last_row"), F.first("box.left").alias("first_col"), F.first("box.right").alias("last_col"),
        F.count_if(is_("data")).alias("rows"), F.count_if(is_("totals", "label", "title")).alias("skipped"),
    )


def _letters(col: Column) -> Column:
    """The letters of a column, the first one being 1: A, Z, AA, ..."""
    n = col.cast("int")
    digit = lambda x: F.chr(F.lit(65) + x)
    two = F.concat(F.when(n > 26, digit(F.floor((n - 27) / 26) % 26)).otherwise(""), digit((n - 1) % 26))
    return F.concat(F.when(n > 702, digit(F.floor((n - 703) / 676))).otherwise(""), two)


def headers(cells: DataFrame) -> DataFrame:
    """sheet, region, col, name of the columns of each table: the header's text, after the label of its group if there is one.

    A blank one is named by the column's letters; of equal names (ignoring case) the later ones are numbered.
    """
    row_of = lambda role: F.max(F.when(F.col("role") == role, F.col("row")))  # noqa: E731  a table has one of each at most
    tables = rows_by_role(cells).where("region is not null").groupBy("sheet", "region", "box").agg(row_of("header").alias("header"), row_of("group").alias("group"))
    asked = tables.select("sheet", "region", "box", F.explode(F.array(F.struct(F.col("header").alias("row"), F.lit(True).alias("top")), F.struct(F.col("group").alias("row"), F.lit(False).alias("top")))).alias("x"))
    asked = asked.select("sheet", "region", "box", "x.*").where("top or row is not null")
    text = cells.where(text_class(F.col("value")) & ~blank(F.col("value"), True)).select("sheet", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), bare(F.col("value")).alias("value"))
    said = asked.join(text, ["sheet", "row"], "left")  # rows of headers and groups hold texts only; a table without one keeps its box
    inside = F.col("col").between(F.col("box.left"), F.col("box.right"))
    told = said.groupBy("sheet", "region").agg(F.first("box").alias("box"), F.collect_list(F.when(inside, F.struct("col", "value", "top"))).alias("words"))
    cell = lambda c, own, label: F.struct(c.alias("col"), own.cast("string").alias("own"), label.cast("string").alias("label"))
    wide = F.transform(F.sequence("box.left", "box.right"), lambda c: cell(c, F.lit(None), F.lit(None)))
    words = F.transform("words", lambda x: cell(x["col"], F.when(x["top"], x["value"]), F.when(~x["top"], x["value"])))
    along = Window.partitionBy("sheet", "region").orderBy("col")
    spread = told.select("sheet", "region", F.explode(F.concat(wide, words)).alias("x")).select("sheet", "region", "x.*")
    named = spread.groupBy("sheet", "region", "col").agg(F.max("own").alias("own"), F.max("label").alias("label"))
    own = F.coalesce("own", F.concat(F.lit("Column "), _letters(F.col("col"))))
    full = named.withColumn("name", F.concat_ws(" ", F.last("label", ignorenulls=True).over(along), own))
    nth = F.row_number().over(Window.partitionBy("sheet", "region", F.lower("name")).orderBy("col"))
    return full.withColumn("_nth", nth).select("sheet", "region", "col", F.when(F.col("_nth") > 1, F.concat("name", F.lit(" ("), "_nth", F.lit(")"))).otherwise(F.col("name")).alias("name"))
