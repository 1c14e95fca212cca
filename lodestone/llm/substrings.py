"""Removal of passages that repeat across documents, behind a count-min prefilter.

A window is `window` consecutive words. Windows are grouped in runs: of the
8-word grams inside a window the one with the least hash is its anchor, and a run
is a stretch of neighbouring windows with the same anchor. Equal windows have
equal anchors, so an anchor's count bounds its windows' counts from above.

1. Every partition builds a count-min sketch of its anchors; the sketches are
   merged by ranges of cells into bits "two or more". The sketch grows with the
   anchors. Up to `2 ** max_bits` cells a row its bits are sent out (a fixed bound,
   2 x 32 MB); a larger one stays in partitions, by cell, and the anchors of its
   cells of two or more go back to their documents by joins.
2. Runs whose anchor may repeat are grouped exactly, by a 128-bit digest of their
   words, to the smallest doc_id. Where an anchor has several different runs, one
   document shows each run's windows; a second sketch of the same kind counts those, and the
   ones that may repeat are grouped too, by anchor and window hash (two
   independent 64-bit hashes).
3. Word ranges of windows that a smaller doc_id holds go back to their documents.

Copies of a passage cost one short row a run, not one a window, and no group is
gathered anywhere: all grouping is by partially aggregated minima and joins.

Defined results: null or empty texts have no words; texts of fewer words than a
window lose nothing; a null doc_id neither removes nor is removed from; rows that
share a doc_id do not remove from each other; repeated rows give repeated rows;
an empty table gives an empty table; extra columns are kept if named in `keep`, and
a result column replaces a kept column of the same name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import SPACES, Words, arrow_map, byte_table, delete_path, materialize, mix, pieces, redealt, rolling_hashes, text_bytes

WINDOW, GRAM = 50, 8
#: Cells of a sketch row, as a power of two: the largest, and cells for an anchor.
MAX_BITS, CELLS_AN_ANCHOR = 28, 8
_RANGE_BITS = 8  # a sketch row is merged in so many (as a power of two) ranges
_SEEDS = (0x5851F42D4C957F2D, 0x14057B7EF767814F)

TABLE = byte_table(SPACES)


def runs(words: Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first window and number of windows of each run."""
    h = rolling_hashes(words.hashes, gram, 0xD1342543DE82EF95)
    n = len(words.hashes) - window + 1
    if n <= 0:
        empty = np.zeros(0, np.int64)
        return empty.astype(np.uint64), empty, empty
    span, least = 1, h
    size = window - gram + 1
    while span * 2 <= size:
        least = np.minimum(least[: len(least) - span], least[span:])
        span *= 2
    least = np.minimum(least[: n], least[size - span : size - span + n])
    whole = words.doc[:n] == words.doc[window - 1 :]
    begins = np.ones(n, bool)
    begins[1:] = (least[1:] != least[:-1]) | (words.doc[1:n] != words.doc[: n - 1])
    at = np.flatnonzero(begins)
    # windows that cross into the next text end a text's windows: each run is counted up to there
    sizes = np.add.reduceat(whole.astype(np.int64), at)
    real = sizes > 0
    return least[at][real], at[real], sizes[real]


def _cells(anchors: np.ndarray, row: int) -> np.ndarray:
    return (mix(anchors ^ np.uint64(_SEEDS[row])) >> np.uint64(64 - MAX_BITS)).astype(np.int64)


SKETCH = "line int, range int, cells binary, keys long"


def packed_sketch(keys: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A partition's count-min sketch: for each row and range, its cells that
    count, each with 1 in the lowest bit if it counts two or more."""
    low = MAX_BITS - _RANGE_BITS
    for row in range(len(_SEEDS) if len(keys) else 0):
        cells, counts = np.unique(_cells(keys, row), return_counts=True)
        packed = (((cells & ((1 << low) - 1)) << 1) | (counts > 1)).astype("<u4")
        cuts = np.searchsorted(cells >> low, np.arange((1 << _RANGE_BITS) + 1))
        some = [r for r in range(1 << _RANGE_BITS) if cuts[r] < cuts[r + 1]]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([row] * len(some), pa.int32()),
                pa.array(some, pa.int32()),
                pa.array([packed[cuts[r] : cuts[r + 1]].tobytes() for r in some], pa.binary()),
                pa.array([cuts[r + 1] - cuts[r] for r in some], pa.int64()),
            ],
            names=["line", "range", "cells", "keys"],
        )


def anchor_sketch(documents: DataFrame, text_col: str, window: int, gram: int) -> DataFrame:
    """Partition sketches of all runs' anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [runs(Words(*text_bytes(part.column(0)), TABLE), window, gram)[0] for batch in batches for part in pieces(batch, text_col, 2_000_000)]
        yield from packed_sketch(np.concatenate(found) if found else np.zeros(0, np.uint64))

    return documents.select(f"`{text_col}`").mapInArrow(run, SKETCH)


def _window_keys(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch (anchor, windows, ...): a key for each window, its row, its place in it."""
    lists = batch.column(1)
    hashes = lists.flatten().to_numpy().view(np.uint64)
    n = lists.value_lengths().to_numpy()
    row = np.repeat(np.arange(len(n)), n)
    anchor = batch.column(0).to_numpy().view(np.uint64)
    return mix(hashes ^ mix(anchor)[row]), row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)


def window_sketch(shown: DataFrame) -> DataFrame:
    """Partition sketches of the windows of runs (anchor, windows, ...)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [_window_keys(batch)[0] for batch in batches]
        yield from packed_sketch(np.concatenate(found) if found else np.zeros(0, np.uint64))

    return shown.select("anchor", "windows").mapInArrow(run, SKETCH)


def repeated_windows(shown: DataFrame, sent: Bits) -> DataFrame:
    """(anchor, hash, off, run, least) of the windows that may repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, row, off = _window_keys(batch)
            ok = np.flatnonzero(sent.may_repeat(keys))
            at = pa.array(row[ok])
            columns = [batch.column(0).take(at), batch.column(1).flatten().take(pa.array(ok)), pa.array(off[ok].astype(np.int32)), batch.column(2).take(at), batch.column(3).take(at)]
            yield pa.RecordBatch.from_arrays(columns, names=["anchor", "hash", "off", "run", "least"])

    return shown.select("anchor", "windows", "run", "least").mapInArrow(run, "anchor long, hash long, off int, run binary, least long")


class Bits:
    """The merged sketch, one bit a cell: two or more. Held as a broadcast."""

    def __init__(self, sent, bits: int):
        self.sent, self.bits = sent, bits

    def may_repeat(self, keys: np.ndarray) -> np.ndarray:
        ok = np.ones(len(keys), bool)
        for row in range(len(_SEEDS)):
            c = _cells(keys, row) >> (MAX_BITS - self.bits)
            ok &= (self.sent.value[row][c >> 3] >> (7 - (c & 7)).astype(np.uint8)) & 1 == 1
        return ok


def sketched(sketches: DataFrame) -> int:
    """How many keys the partitions' sketches hold: equal ones of a partition once."""
    return sketches.where("line = 0").agg(F.sum("keys")).first()[0] or 0


def merged_bits(sketches: DataFrame) -> Bits:
    """Merge partition sketches, range by range. With more keys than MAX_BITS is made for, more pass, none is lost."""
    total = sketched(sketches)
    bits = min(MAX_BITS, max(16, int(np.ceil(np.log2(max(1, total) * CELLS_AN_ANCHOR)))))
    fold, size = MAX_BITS - bits, 1 << (bits - _RANGE_BITS)

    def merge(key, table):
        counts = np.zeros(size, np.uint8)
        for cells in table.column("cells"):
            c = np.frombuffer(cells.as_buffer(), "<u4").astype(np.int64)
            at, more = (c >> 1) >> fold, (c & 1).astype(bool)
            n = np.bincount(at, minlength=size) + np.bincount(at[more], minlength=size)
            counts = np.minimum(2, counts + n).astype(np.uint8)
        return pa.Table.from_arrays(
            [pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int32()), pa.array([np.packbits(counts > 1).tobytes()], pa.binary())], names=["line", "range", "bits"]
        )

    out = np.zeros((len(_SEEDS), (1 << bits) // 8), np.uint8)
    step = size // 8
    # at most 2 x 32 MB, whatever the input
    for r in sketches.groupBy("line", "range").applyInArrow(merge, "line int, range int, bits binary").toLocalIterator():
        out[r["line"], r["range"] * step : (r["range"] + 1) * step] = np.frombuffer(r["bits"], np.uint8)
    return Bits(sketches.sparkSession.sparkContext.broadcast(out), bits)


def keyed(documents: DataFrame, doc_col: str, text_col: str) -> DataFrame:
    """(doc, tkey, text) of the rows with an id."""
    some = documents.where(F.col(f"`{doc_col}`").isNotNull())
    return some.select(F.col(f"`{doc_col}`").cast("long").alias("doc"), F.xxhash64(f"`{text_col}`").alias("tkey"), F.col(f"`{text_col}`").alias("text"))


def partitioned_sketch(documents: DataFrame, bits: int, window: int, gram: int) -> DataFrame:
    """(doc, tkey, anchors): each document's anchors in cells that count two or more, of a sketch of 2 ** bits
    cells that lies in partitions by cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", 2_000_000):
                w = Words(*text_bytes(part.column(2)), TABLE)
                anchor, first, _ = runs(w, window, gram)
                doc = pa.array(w.doc[first])
                cell = (mix(anchor ^ np.uint64(_SEEDS[0])) >> np.uint64(64 - bits)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0).take(doc), part.column(1).take(doc), pa.array(anchor.view(np.int64)), pa.array(cell)], names=["doc", "tkey", "anchor", "cell"])

    placed, path = materialize(documents.mapInArrow(run, "doc long, tkey long, anchor long, cell long"), "anchors")
    full = redealt(placed.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1").select("cell"))
    lists, _ = materialize(placed.join(full, "cell").groupBy("doc", "tkey").agg(F.collect_set("anchor").alias("anchors")), "anchor_lists")
    delete_path(documents.sparkSession, path)
    return lists


def repeated_runs(documents: DataFrame, sent: Bits | None, window: int, gram: int) -> DataFrame:
    """Runs whose anchor may repeat, with the digest of their words and their windows' hashes.
    documents: (doc, tkey, text), and their anchors if no bits are sent."""
    schema = "doc long, tkey long, first int, n int, anchor long, run binary, windows array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", 2_000_000):
                data, offsets = text_bytes(part.column(2))
                w = Words(data, offsets, TABLE)
                anchor, first, n = runs(w, window, gram)
                if sent is not None:
                    ok = sent.may_repeat(anchor)
                else:
                    own = part.column(3)
                    of = np.repeat(np.arange(part.num_rows, dtype=np.uint64), own.value_lengths().to_numpy())
                    passing = mix(own.flatten().to_numpy().view(np.uint64) ^ mix(of))
                    ok = np.isin(mix(anchor ^ mix(w.doc[first].astype(np.uint64))), passing)  # a collision only lets one more pass
                anchor, first, n = anchor[ok], first[ok], n[ok]
                if not len(first):
                    continue
                hashes = rolling_hashes(w.hashes, window, 0xA0761D6478BD642F).view(np.int64)
                doc = w.doc[first]
                spans = zip(w.starts[first].tolist(), w.ends[first + n + window - 2].tolist(), strict=True)
                digest = [hashlib.blake2b(b" ".join(data[s:e].tobytes().split()), digest_size=16).digest() for s, e in spans]
                ends = np.cumsum(n)
                flat = np.arange(ends[-1]) + np.repeat(first - (ends - n), n)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(doc)).cast(pa.int64()),
                        part.column(1).take(pa.array(doc)),
                        pa.array((first - w.first[doc]).astype(np.int32)),
                        pa.array(n.astype(np.int32)),
                        pa.array(anchor.view(np.int64)),
                        pa.array(digest, pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(hashes[flat])),
                    ],
                    names=["doc", "tkey", "first", "n", "anchor", "run", "windows"],
                )

    return documents.mapInArrow(run, schema)


def removed_ranges(documents: DataFrame, doc_col: str, text_col: str, window: int, gram: int) -> DataFrame:
    """(doc, tkey, ranges): word ranges that windows of smaller documents cover."""
    sketches, sketch_path = materialize(anchor_sketch(documents, text_col, window, gram), "anchor_sketches")
    texts, total = keyed(documents, doc_col, text_col), sketched(sketches)
    if total * CELLS_AN_ANCHOR <= 1 << MAX_BITS:
        found = repeated_runs(texts, merged_bits(sketches), window, gram)
    else:
        lists = partitioned_sketch(texts, min(60, (total * CELLS_AN_ANCHOR - 1).bit_length()), window, gram)
        found = repeated_runs(texts.join(lists, ["doc", "tkey"]), None, window, gram)
    rows, rows_path = materialize(found, "runs")
    classes, classes_path = materialize(rows.groupBy("anchor", "run").agg(F.min("doc").alias("least"), F.max("doc").alias("most")), "run_classes")

    # anchors of several different runs: one document shows each run's windows
    several = redealt(classes.groupBy("anchor").agg(F.count("*").alias("k")).where("k > 1").select("anchor"))
    mixed = classes.join(several, "anchor").select("anchor", "run", "least")
    chosen = rows.select("run", F.col("doc").alias("least"), "windows").join(mixed, ["run", "least"])
    shown, shown_path = materialize(chosen.select("anchor", "windows", "run", "least"), "shown_runs")
    window_sketches, window_path = materialize(window_sketch(shown), "window_sketches")
    again, again_path = materialize(repeated_windows(shown, merged_bits(window_sketches)), "repeated_windows")
    least = redealt(again.groupBy("anchor", "hash").agg(F.min("least").alias("w"), F.max("least").alias("z")).where("w < z").select("anchor", "hash", "w"))
    # a run that a document repeats is shown more than once: equal rows are one
    inside = again.select("anchor", "run", "hash", "off").join(least, ["anchor", "hash"]).groupBy("run").agg(F.collect_set(F.struct("off", "w")).alias("offs"))

    # of a run's windows, `least` bounds those of equal runs, `offs` those of other runs with its anchor
    useful = redealt(classes.join(inside, "run", "left").where("least < most OR offs IS NOT NULL").select("run", "least", "offs"))
    hits = rows.select("doc", "tkey", "first", "n", "run").join(useful, "run")
    own = F.filter("offs", lambda x: x["w"] < F.col("doc"))
    spans = F.when(F.col("least") < F.col("doc"), F.array(F.struct(F.col("first").alias("s"), (F.col("first") + F.col("n") + window - 1).alias("e")))).otherwise(
        F.coalesce(F.transform(own, lambda x: F.struct((F.col("first") + x["off"]).alias("s"), (F.col("first") + x["off"] + window).alias("e"))), F.array())
    )
    hits = hits.select("doc", "tkey", spans.alias("spans")).where("size(spans) > 0")
    ranges, _ = materialize(hits.groupBy("doc", "tkey").agg(F.flatten(F.collect_list("spans")).alias("ranges")), "ranges")
    for path in (sketch_path, rows_path, classes_path, shown_path, window_path, again_path):
        delete_path(documents.sparkSession, path)
    return ranges


RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_removed", T.LongType()),
        T.StructField("kept_text", T.StringType()),
    ]
)


def remove_repeats(documents: DataFrame, doc_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Add n_words, n_removed and kept_text (the words left, joined by one space)."""
    new = RESULT.names
    keep = [c for c in (documents.columns if keep is None else keep) if c.lower() not in new]
    ranges = removed_ranges(documents, doc_col, text_col, window, gram)
    # kept columns under plain names, which clash with nothing made here
    plain = {c: f"c{k}" for k, c in enumerate(keep)}
    docs = documents.select(*[F.col(f"`{c}`").alias(p) for c, p in plain.items()], F.col(f"`{doc_col}`").cast("long").alias("doc"), F.xxhash64(f"`{text_col}`").alias("tkey"), F.col(f"`{text_col}`").alias("whole"))
    joined = docs.join(ranges.select("doc", "tkey", "ranges"), ["doc", "tkey"], "left")

    def make():
        def work(part: pa.RecordBatch) -> list:
            data, offsets = text_bytes(part.column(part.schema.get_field_index("whole")))
            w = Words(data, offsets, TABLE)
            lists = part.column(part.schema.get_field_index("ranges"))
            edge = np.zeros(len(w.hashes) + 1, np.int64)
            for d in range(part.num_rows):
                if lists[d].is_valid:
                    flat = lists[d].values.flatten()
                    np.add.at(edge, np.asarray(flat[0]) + w.first[d], 1)
                    np.add.at(edge, np.asarray(flat[1]) + w.first[d], -1)
            gone = np.cumsum(edge[:-1]) > 0
            removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[w.first])
            texts = []
            for d in range(part.num_rows):
                a, b = w.first[d], w.first[d + 1]
                raw = data[offsets[d] : offsets[d + 1]]
                if removed[d]:
                    cover = np.zeros(len(raw) + 1, np.int8)
                    hit = np.flatnonzero(gone[a:b]) + a
                    cover[w.starts[hit] - offsets[d]] += 1
                    cover[w.ends[hit] - offsets[d]] -= 1
                    raw = np.where(np.cumsum(cover[:-1]) > 0, 32, raw).astype(np.uint8)
                texts.append(b" ".join(raw.tobytes().split()))
            return [w.counts.astype(np.int64), removed.astype(np.int64), pa.array(texts, pa.binary()).cast(pa.string())]

        return work

    out = arrow_map(joined.select(*plain.values(), "whole", "ranges"), "whole", [*plain.values(), "ranges"], RESULT, make)
    return out.select(*[F.col(p).alias(c) for c, p in plain.items()], *new)
