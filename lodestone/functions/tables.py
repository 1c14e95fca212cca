"""Tables of cells as aligned Markdown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.text import strip


def clean_cells(table: Column) -> Column:
    """array<array<string>>: nulls become "", line feeds spaces, ends stripped."""
    return F.transform(table, lambda row: F.transform(row, lambda c: F.coalesce(strip(F.replace(c, F.lit("\n"), F.lit(" "))), F.lit(""))))


def is_ragged(table: Column) -> Column:
    """Whether some row is longer or shorter than the header."""
    return F.coalesce(~F.forall(table, lambda row: F.size(row) == F.size(F.get(table, F.lit(0)))), F.lit(False))


def to_markdown(table: Column) -> Column:
    """Header, dashes and body with columns padded to their widest cell; "" without
    rows or columns; with a header only it ends in a line feed. For tables that are
    not ragged."""
    cells = clean_cells(table)
    header = F.get(cells, F.lit(0))
    widths = F.transform(header, lambda _, i: F.array_max(F.transform(cells, lambda r: F.char_length(F.get(r, i)))))
    line = lambda parts: F.concat(F.lit("| "), F.array_join(parts, " | "), F.lit(" |"))
    padded = lambda row: line(F.transform(row, lambda c, i: F.concat(c, F.repeat(F.lit(" "), F.get(widths, i) - F.char_length(c)))))
    dashes = line(F.transform(widths, lambda w: F.repeat(F.lit("-"), w)))
    body = F.array_join(F.transform(F.slice(cells, 2, F.greatest(F.size(cells) - 1, F.lit(0))), padded), "\n")
    full = F.concat(padded(header), F.lit("\n"), dashes, F.lit("\n"), body)
    return F.when(F.coalesce(F.size(table), F.lit(0)) < 1, "").when(F.coalesce(F.size(header), F.lit(0)) < 1, "").otherwise(full)
