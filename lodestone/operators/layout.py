"""Tables rebuilt from positioned text, by the gaps between blocks alone.

Blocks of a page fall into lines where the gaps between their middles pass half the page's median block height.
Neighbouring lines of two blocks or more, no further apart than `SPACING` times the page's median
line pitch, are a region. In a region the blocks' x intervals are laid over one another: where no block covers
the axis for `GUTTER` of the median height, a column ends, so that cells may be set to the left,
the right or the middle, and may be missing. A region of two lines and two columns or more is a table.

Windows run within a page, whose blocks are few; pages are dealt to tasks. Defined results: blocks without text or a
coordinate are left out; pages without tables give no rows; several blocks of one cell are joined
by a space from left to right, ties by block_ix; a missing cell is null; columns other than the named ones are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import strip

PAGE = ["source", "page"]
#: In median line pitches, and in median block heights.
SPACING, GUTTER = 1.8, 0.4


def _running(flag: Column, by: list[str], order: list) -> Column:
    """How many rows so far have the flag."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return F.sum(flag.cast("int")).over(w)


def lined(blocks: DataFrame) -> DataFrame:
    """blocks (source, page, block_ix, x0, y0, x1, y1, text) that count, with the page's median height and their line from 0."""
    there = blocks.select(*PAGE, "block_ix", "x0", "y0", "x1", "y1", strip(F.col("text")).alias("text")).where("text <> '' AND x0 + y0 + x1 + y1 IS NOT NULL")
    tall = there.withColumn("height", F.median(F.col("y1") - F.col("y0")).over(Window.partitionBy(*PAGE))).withColumn("mid", (F.col("y0") + F.col("y1")) / 2)
    order = ["mid", "block_ix"]
    step = F.col("mid") - F.lag("mid").over(Window.partitionBy(*PAGE).orderBy(*order))
    return tall.withColumn("apart", F.coalesce(step > F.col("height") / 2, F.lit(False))).withColumn("line", _running(F.col("apart"), PAGE, order)).drop("apart")


def regions(blocks: DataFrame) -> DataFrame:
    """Lined blocks of lines that may be a table's, with their region's number in the page."""
    lines = blocks.groupBy(*PAGE, "line").agg(F.count("*").alias("n"), F.avg("mid").alias("mid"))
    before = Window.partitionBy(*PAGE).orderBy("line")
    pitched = lines.withColumn("pitch", F.col("mid") - F.lag("mid").over(before))
    pitched = pitched.withColumn("usual", F.median("pitch").over(Window.partitionBy(*PAGE)))
    # a region begins at a line of several blocks behind a single block or a wide gap
    begins = (F.col("n") > 1) & ((F.coalesce(F.lag("n").over(before), F.lit(1)) == 1) | F.coalesce(F.col("pitch") > F.col("usual") * SPACING, F.lit(False)))
    numbered = pitched.withColumn("begins", begins).withColumn("region", _running(F.col("begins"), PAGE, ["line"])).where("n > 1")
    return blocks.join(numbered.select(*PAGE, "line", "region"), [*PAGE, "line"])


def cells(blocks: DataFrame) -> DataFrame:
    """(source, page, table_ix, row, col, text) of all tables; rows and columns from 0."""
    placed = regions(lined(blocks))
    region = [*PAGE, "region"]
    order = ["x0", "block_ix"]
    reached = F.max("x1").over(Window.partitionBy(*region).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    wide = placed.withColumn("free", F.coalesce(F.col("x0") - reached > F.col("height") * GUTTER, F.lit(False)))
    cut = wide.withColumn("col", _running(F.col("free"), region, order))
    both = Window.partitionBy(*region)
    rows = F.dense_rank().over(Window.partitionBy(*region).orderBy("line"))
    sized = cut.withColumn("row", (rows - 1).cast("int")).withColumn("rows", F.max("row").over(both) + 1).withColumn("cols", F.max("col").over(both) + 1)
    tables = sized.where("rows > 1 AND cols > 1").withColumn("table_ix", (F.dense_rank().over(Window.partitionBy(*PAGE).orderBy("region")) - 1).cast("int"))
    parts = F.array_sort(F.collect_list(F.struct("x0", "block_ix", "text")))
    return tables.groupBy(*PAGE, "table_ix", "row", "col", "cols").agg(F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text"))


def tables(blocks: DataFrame) -> DataFrame:
    """(source, page, table_ix, cells array<array<string>>), as extract.page_tables takes them; no row is ragged."""
    each = cells(blocks).groupBy(*PAGE, "table_ix", "row", "cols").agg(F.map_from_entries(F.collect_list(F.struct("col", "text"))).alias("held"))
    row = F.transform(F.sequence(F.lit(0), F.col("cols") - 1), lambda c: F.try_element_at(F.col("held"), c))
    whole = F.array_sort(F.collect_list(F.struct("row", row.alias("cells"))))
    return each.groupBy(*PAGE, "table_ix").agg(F.transform(whole, lambda r: r["cells"]).alias("cells"))
