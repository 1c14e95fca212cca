"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The alphabet is words (64-bit hashes of their folded bytes) and a block is two
words (one for one-word patterns). For each pattern length a shift table, keyed
by a block's hash, says how far every pattern allows the search to skip; where
it says 0, the bucket of patterns that end in that block is compared, first by
all word hashes, then byte for byte. All texts of a piece are searched at once:
many cursors jump through the words, each by its own shifts.

The benchmark's windows are cut and made distinct on the executors, each with the set of its
items. They are then read in blocks of at most `max_windows`, one at a time on the driver; a
block's tables go to the executors with the code (a proven size), and one more pass in
the same stage searches them, so a benchmark of any size is searched without a
shuffle of documents.

Defined results: a null or empty text has no words and no hits; an item without
words has no window; repeated items and items with equal windows all count, by
item_id once each; an item with a null id marks words but is not listed; an empty
benchmark hits nothing; extra columns of the benchmark are ignored, those of the
documents are kept if named in `keep`, and a result column replaces a kept column
of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import SPACES, Words, arrow_map, byte_table, mix, text_bytes

WINDOW = 10
#: Windows in one block of the benchmark: about 60 MB of tables.
MAX_WINDOWS = 200_000

#: Word bytes: digits, letters (A-Z folded), and all beyond ASCII.
TABLE = byte_table([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)], lower=True)

_PRIME = np.uint64(0x9FB21C651E98DF25)
_SEGMENT = 256  # words for a cursor

RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("hit_spans", T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
        T.StructField("item_ids", T.ArrayType(T.StringType())),
    ]
)


class Patterns:
    """Wu-Manber tables for patterns of one length."""

    def __init__(self, length: int, hashes: np.ndarray, words: list[bytes], items: list[list[str]]):
        """words: each pattern's words, joined by one space."""
        self.length, self.words, self.items = length, words, items
        self.block = min(2, length)
        blocks = [self.blocks(hashes, j) for j in range(self.block - 1, length)]
        bits = max(10, int(np.ceil(np.log2(max(1, hashes.shape[0] * len(blocks))))) + 3)
        self.down = np.uint64(64 - bits)
        self.shift = np.full(1 << bits, length - self.block + 1, np.int16)
        for k, b in enumerate(blocks):
            np.minimum.at(self.shift, (b >> self.down).astype(np.int64), len(blocks) - 1 - k)
        order = np.argsort(blocks[-1], kind="stable")
        self.order, self.suffix, self.hashes = order, blocks[-1][order], hashes[order]

    def blocks(self, hashes: np.ndarray, j: int) -> np.ndarray:
        return hashes[:, j] if self.block == 1 else mix(hashes[:, j - 1] * _PRIME + hashes[:, j])

    def find(self, w: Words, folded: bytes) -> Iterator[tuple[int, int]]:
        """(first word, pattern) of each occurrence."""
        h, m = w.hashes, self.length
        starts, ends = [], []
        first, last = w.first[:-1] + m - 1, w.first[1:]  # window ends lie in [first, last)
        long_enough = first < last
        first, last = first[long_enough], last[long_enough]
        if not len(first):
            return
        n_segments = (last - first + _SEGMENT - 1) // _SEGMENT
        base = np.repeat(first, n_segments)
        nth = np.arange(len(base)) - np.repeat(np.cumsum(n_segments) - n_segments, n_segments)
        at = base + nth * _SEGMENT
        stop = np.minimum(at + _SEGMENT, np.repeat(last, n_segments))
        while len(at):
            key = h[at] if self.block == 1 else mix(h[at - 1] * _PRIME + h[at])
            step = self.shift[(key >> self.down).astype(np.int64)]
            here = np.flatnonzero(step == 0)
            if len(here):
                low = np.searchsorted(self.suffix, key[here], "left")
                high = np.searchsorted(self.suffix, key[here], "right")
                some = high > low
                starts.append(np.repeat(at[here][some] - (m - 1), (high - low)[some]))
                sizes = (high - low)[some]
                ends.append(np.repeat(low[some], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes))
            at = at + np.maximum(step, 1)
            go = at < stop
            if not go.all():
                at, stop = at[go], stop[go]
        if not starts:
            return
        start, pattern = np.concatenate(starts), np.concatenate(ends)
        same = np.ones(len(start), bool)
        for j in range(m):
            same &= h[start + j] == self.hashes[pattern, j]
        for i, p in zip(start[same].tolist(), self.order[pattern[same]].tolist(), strict=True):
            if b" ".join(folded[w.starts[i] : w.ends[i + m - 1]].split()) == self.words[p]:
                yield i, p


_FOLD = np.where(TABLE == 0, 32, TABLE - 1).astype(np.uint8)


def windows(benchmark: DataFrame, item_col: str, text_col: str, n: int) -> DataFrame:
    """(length, window, items): the distinct windows of n consecutive words of all items (one of all its words, if
    they are fewer), words joined by one space, with the ids of their items, sorted."""
    items = benchmark.select(F.col(f"`{item_col}`").cast("string").alias("item"), F.col(f"`{text_col}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = _FOLD[np.frombuffer((text or "").encode("utf-8"), np.uint8)].tobytes().split()
                found = list({b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1) if words else 0)})
                lengths = [min(n, len(words))] * len(found)
                yield pa.RecordBatch.from_arrays([pa.array(lengths, pa.int32()), pa.array(found, pa.binary()), pa.array([item] * len(found), pa.string())], names=["length", "window", "item"])

    return items.mapInArrow(run, "length int, window binary, item string").groupBy("length", "window").agg(F.array_sort(F.collect_set("item")).alias("items"))


def build(found: list[tuple[int, bytes, list[str]]]) -> list[Patterns]:
    by_length: dict[int, list[tuple[bytes, list[str]]]] = {}
    for length, window, items in found:
        by_length.setdefault(length, []).append((window, items))
    out = []
    for length, rows in sorted(by_length.items()):
        flat = b" ".join(w for w, _ in rows)
        hashes = Words(np.frombuffer(flat, np.uint8), np.array([0, len(flat)]), byte_table(SPACES)).hashes.reshape(len(rows), length)
        out.append(Patterns(length, hashes, [w for w, _ in rows], [i for _, i in rows]))
    return out


def search(
    documents: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    keep: list[str] | None = None,
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    max_windows: int = MAX_WINDOWS,
) -> DataFrame:
    """Add n_words, hit_spans (word ranges inside occurrences, disjoint, in order)
    and item_ids (sorted strings) to every document."""
    keep = documents.columns if keep is None else keep
    out, first = documents, True
    block: list[tuple[int, bytes, list[str]]] = []
    carry = [c for c in dict.fromkeys([*keep, text_col])]
    for r in windows(benchmark, item_col, item_text_col, window).toLocalIterator():
        block.append((r["length"], bytes(r["window"]), r["items"]))
        if len(block) >= max_windows:
            out, first, block = _scan(out, block, text_col, carry, first), False, []
    if block or first:
        out = _scan(out, block, text_col, carry, first)
    return out.select(*[f"`{c}`" for c in keep if c.lower() not in {f.name for f in RESULT}], *[F.col(f"__{f.name}").alias(f.name) for f in RESULT])


def _scan(df: DataFrame, block: list, text_col: str, carry: list[str], first: bool) -> DataFrame:
    tables = build(block)
    new = T.StructType([T.StructField(f"__{f.name}", f.dataType) for f in RESULT])
    before = [] if first else [f"__old_{f.name}" for f in RESULT]
    for f in [] if first else RESULT:
        df = df.withColumnRenamed(f"__{f.name}", f"__old_{f.name}")

    def make():
        def work(part: pa.RecordBatch) -> list:
            data, offsets = text_bytes(part.column(part.schema.get_field_index(text_col)))
            w = Words(data, offsets, TABLE)
            edge = np.zeros(len(w.hashes) + 1, np.int32)
            named: dict[int, set[str]] = {}
            folded = _FOLD[data].tobytes()
            for table in tables:
                for i, p in table.find(w, folded):
                    edge[i] += 1
                    edge[i + table.length] -= 1
                    named.setdefault(int(w.doc[i]), set()).update(table.items[p])
            spans: dict[int, list[dict]] = {}
            if named:
                hit = np.cumsum(edge[:-1]) > 0
                new_doc = np.ones(len(hit), bool)
                new_doc[1:] = w.doc[1:] != w.doc[:-1]
                begin = np.flatnonzero(hit & (new_doc | ~np.concatenate([[False], hit[:-1]])))
                end = np.flatnonzero(hit & (np.concatenate([new_doc[1:], [True]]) | ~np.concatenate([hit[1:], [False]]))) + 1
                for s, e in zip(begin.tolist(), end.tolist(), strict=True):
                    d = int(w.doc[s])
                    spans.setdefault(d, []).append({"first": s - int(w.first[d]), "end": e - int(w.first[d])})
            if before:
                old = part.column(part.schema.get_field_index("__old_hit_spans")).to_pylist()
                ids = part.column(part.schema.get_field_index("__old_item_ids")).to_pylist()
                spans = {d: _union(old[d] + spans.get(d, [])) for d in range(part.num_rows)}
                named = {d: set(ids[d]) | named.get(d, set()) for d in range(part.num_rows)}
            rows = range(part.num_rows)
            return [w.counts.astype(np.int64), [spans.get(d, []) for d in rows], [sorted(named.get(d, ())) for d in rows]]

        return work

    return arrow_map(df, text_col, [*carry, *before], new, make, 4_000_000).drop(*before)


def _union(spans: list[dict]) -> list[dict]:
    out: list[dict] = []
    for s in sorted(spans, key=lambda s: s["first"]):
        if out and s["first"] <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], s["end"])
        else:
            out.append(dict(s))
    return out
