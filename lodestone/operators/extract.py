"""Page assembly from blocks, tables and images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.tables import is_ragged, to_markdown
from lodestone.functions.text import strip

PAGE = ["source", "page"]
MIN_IMAGE = 100


def usable_blocks(blocks: DataFrame) -> DataFrame:
    """(source, page, page_width, x0, y0, block_ix, text): stripped, blank ones dropped."""
    return blocks.select(*PAGE, "page_width", "x0", "y0", "block_ix", strip(F.col("text")).alias("text")).where(F.col("text") != "")


def ordered_blocks(blocks: DataFrame) -> DataFrame:
    """Adds `column` (0 left, 1 right). A page with a block beginning right of 45 % of
    its width is read in two columns, parted at its middle; else all by y0."""
    two = F.max(F.col("x0") > 0.45 * F.col("page_width")).over(Window.partitionBy(*PAGE))
    return blocks.withColumn("column", F.when(two & (F.col("x0") >= F.col("page_width") / 2), 1).otherwise(0))


def block_text(blocks: DataFrame) -> DataFrame:
    """(source, page, text) in reading order, blocks joined by line feeds."""
    two = F.max(F.col("x0") > 0.45 * F.col("page_width")).alias("two")
    packed = usable_blocks(blocks).groupBy(*PAGE).agg(two, F.collect_list(F.struct("y0", "block_ix", "x0", "text", "page_width")).alias("b"))
    right = lambda b: F.when(F.col("two") & (b["x0"] >= b["page_width"] / 2), 1).otherwise(0)
    keyed = F.array_sort(F.transform("b", lambda b: F.struct(right(b).alias("c"), b["y0"].alias("y"), b["block_ix"].alias("k"), b["text"].alias("t"))))
    return packed.select(*PAGE, F.array_join(F.transform(keyed, lambda b: b["t"]), "\n").alias("text"))


def first_text(*layers: Column) -> Column:
    """The first layer with more than white space, stripped; null if none has."""
    return F.coalesce(*[F.nullif(strip(x), F.lit("")) for x in layers])


def page_tables(tables: DataFrame) -> DataFrame:
    """(source, page, table_ix, cells) -> (source, page, markdowns, ragged). One
    ragged table loses all tables of its page, and `ragged` says so."""
    one = tables.where(F.size("cells") > 0).select(*PAGE, "table_ix", is_ragged(F.col("cells")).alias("bad"), "cells")
    made = one.withColumn("md", F.when(~F.col("bad"), to_markdown(F.col("cells"))))
    packed = made.groupBy(*PAGE).agg(F.bool_or("bad").alias("ragged"), F.array_sort(F.collect_list(F.struct("table_ix", "md"))).alias("t"))
    kept = F.filter(F.transform("t", lambda x: x["md"]), lambda m: m.isNotNull() & (m != ""))
    return packed.select(*PAGE, F.when(F.col("ragged"), F.array().cast("array<string>")).otherwise(kept).alias("markdowns"), "ragged")


def framed(markdown: Column) -> Column:
    return F.concat(F.lit("\n[TABLE]\n"), markdown, F.lit("\n[/TABLE]"))


def large_images(images: DataFrame) -> DataFrame:
    """Images of at least 100 pixels either way."""
    return images.where((F.col("width") >= MIN_IMAGE) & (F.col("height") >= MIN_IMAGE))


def captions(captioned: DataFrame) -> DataFrame:
    """(source, page, image_ix, caption) -> (source, page, captions); nulls and blanks give none."""
    some = captioned.where(F.coalesce(strip(F.col("caption")), F.lit("")) != "")
    packed = F.array_sort(F.collect_list(F.struct("image_ix", F.concat(F.lit("[Image: "), strip(F.col("caption")), F.lit("]")).alias("c"))))
    return some.groupBy(*PAGE).agg(F.transform(packed, lambda x: x["c"]).alias("captions"))


def assemble(texts: DataFrame, tables: DataFrame | None = None, images: DataFrame | None = None) -> DataFrame:
    """(source, page, text) of all pages with any content: text, tables, captions, parted by blank lines."""
    none = F.array().cast("array<string>")
    out = texts.select(*PAGE, F.col("text").alias("t"))
    out = out.join(tables.select(*PAGE, "markdowns"), PAGE, "full") if tables is not None else out.withColumn("markdowns", none)
    out = out.join(images, PAGE, "full") if images is not None else out.withColumn("captions", none)
    text = F.filter(F.array("t"), lambda x: x.isNotNull() & (x != ""))
    parts = F.concat(text, F.transform(F.coalesce("markdowns", none), framed), F.coalesce("captions", none))
    return out.select(*PAGE, strip(F.array_join(parts, "\n\n")).alias("text")).where(F.col("text") != "")
