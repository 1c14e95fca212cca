"""Tables from positioned blocks."""

import random

import pytest

from lodestone.operators import extract, layout

BLOCK = "source string, page int, block_ix int, x0 double, y0 double, x1 double, y1 double, text string"


def laid_out(r, page, top, rows, jitter=1.0):
    """Blocks of a table; each column is set left, right or in the middle; empty cells have none."""
    widths = [max(len(row[c]) for row in rows) * 5.0 for c in range(len(rows[0]))]
    sets = [r.choice(["left", "right", "middle"]) for _ in widths]
    out = []
    for k, row in enumerate(rows):
        left = 30.0
        for c, text in enumerate(row):
            w = len(text) * 5.0
            x = left + {"left": 0, "right": widths[c] - w, "middle": (widths[c] - w) / 2}[sets[c]] + r.uniform(-jitter, jitter)
            y = top + 14 * k + r.uniform(-jitter, jitter)
            if text:
                out.append(("s", page, len(out), x, y, x + w, y + 10, text))
            left += widths[c] + 14
    return out


@pytest.mark.parametrize("seed", range(3))
def test_tables_are_rebuilt(spark, seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9)))
    blocks, want = [], {}
    for page in range(12):
        top = 50.0
        for table in range(r.randint(0, 2)):
            rows = [[word() for _ in range(r.randint(3, 5))]]
            for _ in range(r.randint(1, 8)):
                row = [word() for _ in rows[0]]
                row[r.randrange(len(row))] = r.choice(["", "one two"])
                rows.append(row)
            mine = laid_out(r, page, top, rows)
            top += 14 * len(rows)
            mine += [("s", page, 900 + table, 30.0, top, 400.0, top + 10, "A line of text behind the table, on its own.")]
            top += 14
            blocks += mine
            want[page, table] = [[c or None for c in row] for row in rows]
        blocks.append(("s", page, 999, 30.0, top + 30, 90.0, top + 40, "End."))
    r.shuffle(blocks)
    got = {(x["page"], x["table_ix"]): x["cells"] for x in layout.tables(spark.createDataFrame(blocks, BLOCK)).collect()}
    assert got == want


def test_pages_without_tables_and_odd_blocks(spark):
    rows = [
        ("s", 1, 0, 0.0, 0.0, 50.0, 10.0, "only text"), ("s", 1, 1, 0.0, 14.0, 50.0, 24.0, "in one column"),
        ("s", 2, 0, 0.0, 0.0, 50.0, 10.0, "one line"), ("s", 2, 1, 90.0, 0.0, 120.0, 10.0, "of two blocks"),
        ("s", 3, 0, None, 0.0, 50.0, 10.0, "no place"), ("s", 3, 1, 0.0, 0.0, 50.0, 10.0, " "), ("s", 3, 2, 0.0, 0.0, 1.0, 10.0, None),
        # two blocks of one cell, and two blocks of the same place
        ("s", 4, 0, 0.0, 0.0, 20.0, 10.0, "a"), ("s", 4, 1, 22.0, 0.0, 40.0, 10.0, "b"), ("s", 4, 2, 90.0, 0.0, 99.0, 10.0, "c"), ("s", 4, 3, 90.0, 0.0, 99.0, 10.0, "c"),
        ("s", 4, 4, 0.0, 14.0, 20.0, 24.0, "d"), ("s", 4, 5, 90.0, 14.0, 99.0, 24.0, "e"),
    ]
    t = layout.tables(spark.createDataFrame(rows, BLOCK))
    assert [(r["page"], r["table_ix"], r["cells"]) for r in t.collect()] == [(4, 0, [["a b", "c c"], ["d", "e"]])]
    assert extract.page_tables(t).first()["markdowns"] == ["| a b | c c |\n| --- | --- |\n| d   | e   |"]
    assert layout.tables(spark.createDataFrame([], BLOCK)).count() == 0
