"""What the corpus operators share: Arrow plumbing, word hashing, shared tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from lodestone.sources.shared import delete_path, scratch

#: Text bytes handled at once inside a Python worker; a longer text is handled alone.
PIECE_BYTES = 2_000_000

# ---------------------------------------------------------------- shared tables


def materialize(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write df as Parquet in the shared folder and read it back: lineage is cut,
    and a lost executor loses nothing. Returns the table and its path. Tables
    left over go when the driver's Python ends."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def redealt(df: DataFrame) -> DataFrame:
    """df in a fresh round-robin partitioning. An aggregate's result is joined from
    it by a shuffle of its own; only then can Spark split the other side's hot keys."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


# --------------------------------------------------------------- Arrow plumbing


def extend_schema(df: DataFrame, keep: list[str], new: T.StructType) -> T.StructType:
    """Kept input columns, then the new ones; a new column replaces a kept one of the same name."""
    names = {f.name.lower() for f in new}
    return T.StructType([df.schema[c] for c in keep if c.lower() not in names] + list(new))


def arrow_map(
    df: DataFrame,
    text_col: str,
    keep: list[str],
    new: T.StructType,
    make: Callable[[], Callable[[pa.RecordBatch], list]],
    piece_bytes: int = PIECE_BYTES,
) -> DataFrame:
    """Append columns computed from text_col, a piece of a batch at a time.

    make() runs once in each Python worker's task and returns a function from a
    piece to the new columns' values. Column text_col reaches it under its name.
    """
    schema = extend_schema(df, keep, new)
    kept = [f.name for f in schema][: len(schema) - len(new)]
    inputs = list(dict.fromkeys([*kept, text_col]))
    arrow = to_arrow(new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in pieces(batch, text_col, piece_bytes):
                made = work(part)
                cols = [part.column(part.schema.get_field_index(c)) for c in kept]
                cols += [m if isinstance(m, pa.Array) else pa.array(m, type=f.type) for m, f in zip(made, arrow, strict=True)]
                yield pa.RecordBatch.from_arrays(cols, names=[*kept, *(f.name for f in arrow)])

    return df.select(*[f"`{c}`" for c in inputs]).mapInArrow(run, schema)


def to_arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def pieces(batch: pa.RecordBatch, text_col: str, piece_bytes: int) -> Iterator[pa.RecordBatch]:
    n = batch.num_rows
    if n == 0:
        return
    _, offsets = text_bytes(batch.column(batch.schema.get_field_index(text_col)))
    at = 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + piece_bytes, side="right")) - 1
        end = min(n, max(end, at + 1))
        yield batch.slice(at, end - at)
        at = end


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all values on end, and the offsets of each; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_string())
    raw = col.buffers()
    offsets = np.frombuffer(raw[1], np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None and raw[2].size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


# ----------------------------------------------------------------- word hashing

_R = 0x9E6D62D06F6A9A9B  # odd, so invertible modulo 2**64
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "r" not in _POWERS or len(_POWERS["r"]) < n:
        size = max(n, PIECE_BYTES + 1)
        for key, base in (("r", _R), ("inv", pow(_R, -1, 1 << 64))):
            step = np.full(size, base, np.uint64)
            step[0] = 1
            _POWERS[key] = np.cumprod(step, dtype=np.uint64)
    return _POWERS["r"], _POWERS["inv"]


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words begin and end, from which bytes are inside of one, and the word index at which each text begins."""
    begins, ends = inside.copy(), inside.copy()
    if len(inside):
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        first = offsets[:-1][offsets[:-1] < offsets[1:]]
        begins[first] = inside[first]
        last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
        ends[last] = inside[last]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


class Words:
    """Words of many texts: byte spans, hashes and the text each belongs to."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray):
        """table: for each byte, 0 for a separator, else the word byte's code from 1."""
        self.codes = table[data]
        n = len(data)
        self.starts, self.ends, self.first = word_spans(self.codes != 0, offsets)
        self.counts = np.diff(self.first)
        if len(self.starts):
            r, inv = _powers(n)
            sums = np.add.reduceat(self.codes.astype(np.uint64) * r[:n], self.starts)
            self.hashes = mix(sums * inv[self.starts])
        else:
            self.hashes = np.zeros(0, np.uint64)
        self.doc = np.repeat(np.arange(len(offsets) - 1), self.counts)


def byte_table(separators: bytes | range | list[int], lower: bool = False) -> np.ndarray:
    """A table for Words: the listed bytes separate; lower folds A-Z."""
    codes = np.arange(1, 257).astype(np.uint16)
    if lower:
        codes[65:91] = codes[97:123]
    codes[list(separators)] = 0
    return codes


#: Words are runs without space and \t \n \v \f \r.
SPACES = [0x20, *range(0x09, 0x0E)]


def gram_hashes(words: Words, n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each run of n consecutive words, where it begins; those that
    cross into the next text are marked False in the second array."""
    h = words.hashes
    if len(h) < n:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    size = len(h) - n + 1
    out = np.zeros(size, np.uint64)
    b = np.uint64(base | 1)
    for k in range(n):
        out = out * b + h[k : k + size]
    return mix(out), words.doc[:size] == words.doc[n - 1 :]


def rolling_hashes(h: np.ndarray, n: int, base: int) -> np.ndarray:
    """As gram_hashes, by prefix sums: cheaper for a large n."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    b = base | 1
    step = np.full(len(h) + 1, b, np.uint64)
    step[0] = 1
    power = np.cumprod(step, dtype=np.uint64)
    step[1:] = np.uint64(pow(b, -1, 1 << 64))
    inverse = np.cumprod(step, dtype=np.uint64)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * power[:-1], out=sums[1:])
    return mix((sums[n:] - sums[:-n]) * inverse[: len(h) - n + 1])

