"""Quality classifier by compression against two dictionaries.

A zstandard dictionary is trained on texts labelled good, another on bad ones. A
text is cut in blocks of `BLOCK` bytes and each block is compressed with either
dictionary; what the bad one needs more than the good one, over the text's length, is
the text's normalised difference: high for texts like the good ones, low for texts like the
bad ones and for those that repeat themselves, which either compresses well. A
logistic curve turns it into a probability.

Training sees at most `MAX_TEXTS` labelled rows of each class (those with the least
hash of their id), and all of each. The sample is dealt to `FOLDS` folds: a fold's texts are
scored with dictionaries of the other folds, and the curve is fitted to those scores; the
final dictionaries hold all folds. Dictionaries are trained and texts scored on the
executors; the driver holds dictionaries and one number a sampled text.

Defined results: null and empty texts score as a difference of 0 does; without usable
labels of both classes every score is 0.5; labels that are null or neither 0 nor 1,
and ids labelled both ways, are not used; repeated labels count once; equal texts
get equal scores; an empty table gives an empty table; extra columns are kept if
named in `keep`, and a result column replaces a kept column of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import arrow_map, delete_path, materialize

BLOCK = 512
#: The bound of the labelled sample: rows of each class.
MAX_TEXTS = 1200
FOLDS = 5
DICTIONARY_BYTES, LEVEL = 262144, 3


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    weight: float  # of the difference
    offset: float


def blocks(text: bytes) -> list[bytes]:
    return [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)]


def dictionary(texts: list[bytes]) -> bytes:
    """A dictionary trained on whole texts; the texts themselves where zstandard finds too little to train on."""
    all_bytes = b"\n".join(sorted(texts))
    if not all_bytes:
        return b""
    samples = blocks(all_bytes)
    if len(samples) > 1 and len(samples[-1]) < 8:  # the library's least sample
        samples[-2:] = [samples[-2] + samples[-1]]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return all_bytes


class Compressor:
    """Compressed size of texts under one dictionary."""

    def __init__(self, data: bytes):
        if data:
            ready = zstandard.ZstdCompressionDict(data)
            ready.precompute_compress(level=LEVEL)
            self.c = zstandard.ZstdCompressor(dict_data=ready, write_checksum=False, write_content_size=False, write_dict_id=False)
        else:
            self.c = zstandard.ZstdCompressor(level=LEVEL, write_checksum=False, write_content_size=False)

    def size(self, text: bytes) -> int:
        compress = self.c.compress
        return sum(len(compress(b)) for b in blocks(text))


def difference(good: Compressor, bad: Compressor, text: bytes) -> float:
    """The normalised size difference, above 0 if the good dictionary compresses the text better."""
    return (bad.size(text) - good.size(text)) / len(text) if text else 0.0


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Weight and offset by damped Newton steps, with a slight pull to 0."""
    scale = max(float(np.abs(x).max()), 1e-9)
    z = np.stack([x / scale, np.ones(len(x))], axis=1)
    pull = np.array([0.02, 1e-6])
    beta = np.zeros(2)
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        grad = z.T @ (weight * (y - p)) - pull * beta
        hess = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(pull)
        step = np.clip(np.linalg.solve(hess, grad), -2, 2)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0] / scale), float(beta[1])


def probability(model: Model, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x * model.weight + model.offset, -500, 500)))


def labelled_sample(documents: DataFrame, labels: DataFrame, allowed: Column, doc_col: str, text_col: str, label_col: str, max_texts: int) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, y, fold, text) of at most max_texts rows of each class, of ids for which allowed holds; and
    how many labels each class has."""
    known = labels.select(F.col(f"`{doc_col}`").alias("doc_id"), F.col(f"`{label_col}`").alias("y")).where(allowed & F.col("doc_id").isNotNull() & F.col("y").isin(0, 1))
    once = known.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z").select("doc_id", "y")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    least = lambda df, *more: df.where("y = 0").orderBy(*order, *more).limit(max_texts).union(df.where("y = 1").orderBy(*order, *more).limit(max_texts))
    texts = documents.select(F.col(f"`{doc_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).where("length(text) > 0")
    # at most 2 x max_texts ids: a proven size; ids that documents repeat don't widen the sample
    rows = least(texts.join(F.broadcast(least(once)), "doc_id").select("doc_id", "y", "text"), F.xxhash64("text"))
    totals = {int(r["y"]): r["count"] for r in once.groupBy("y").count().collect()}
    return rows.select("doc_id", F.col("y").cast("int").alias("y"), F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(FOLDS)).cast("int").alias("fold"), F.encode("text", "UTF-8").alias("text")), totals


def dictionaries(sample: DataFrame) -> dict[tuple[int, int], bytes]:
    """(fold, class) -> dictionary of the class without that fold; fold FOLDS: of all."""
    without = F.filter(F.sequence(F.lit(0), F.lit(FOLDS)), lambda f: f != F.col("fold"))
    spread = sample.select(F.explode(without).alias("without"), "y", "text")

    def train_group(key, table):
        data = dictionary(table.column("text").to_pylist())
        return pa.Table.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int32()), pa.array([data], pa.binary())], names=["without", "y", "data"])

    trained = spread.groupBy("without", "y").applyInArrow(train_group, "without int, y int, data binary")
    return {(r["without"], r["y"]): bytes(r["data"]) for r in trained.collect()}  # 2 x (FOLDS + 1) of a fixed size


def differences(sample: DataFrame, found: dict[tuple[int, int], bytes]) -> list[tuple[int, float]]:
    """(class, difference) of each sampled text, under the dictionaries that have not seen it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: dict[int, tuple[Compressor, Compressor]] = {}
        for batch in batches:
            out = []
            for fold, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if fold not in pairs:
                    pairs[fold] = tuple(Compressor(found.get((fold, y), b"")) for y in (1, 0))
                out.append(difference(*pairs[fold], text))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=["y", "x"])

    return sorted((r["y"], r["x"]) for r in sample.select("y", "fold", "text").mapInArrow(run, "y int, x double").collect())


@lru_cache(maxsize=2)
def _compressors(model: Model) -> tuple[Compressor, Compressor]:
    return Compressor(model.good), Compressor(model.bad)


def score(documents: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None, score_col: str = "score") -> DataFrame:
    """Add each whole text's probability of being good."""

    def make():
        good, bad = _compressors(model)

        def work(part: pa.RecordBatch) -> list:
            raw = part.column(part.schema.get_field_index(text_col)).cast(pa.binary()).to_pylist()
            return [probability(model, np.array([difference(good, bad, t or b"") for t in raw]))]

        return work

    return arrow_map(documents, text_col, documents.columns if keep is None else keep, T.StructType([T.StructField(score_col, T.DoubleType())]), make)


def held_out(doc_col: str = "doc_id") -> Column:
    """Rows whose labels training never sees: crc32 of the id as text leaves 1 on division by 3."""
    return F.coalesce(F.crc32(F.col(f"`{doc_col}`").cast("string")) % 3 == 1, F.lit(False))


def train(documents: DataFrame, labels: DataFrame, doc_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_texts: int = MAX_TEXTS) -> Model:
    drawn, totals = labelled_sample(documents, labels, ~held_out("doc_id"), doc_col, text_col, label_col, max_texts)
    sample, path = materialize(drawn, "labelled")
    found = dictionaries(sample)
    seen = differences(sample, found)
    delete_path(documents.sparkSession, path)
    y, x = np.array([k for k, _ in seen]), np.array([v for _, v in seen])
    if len(np.unique(y)) < 2:
        return Model(b"", b"", 0.0, 0.0)
    # a class of which not all rows are in the sample counts in full
    weight = np.where(y == 1, totals[1] / (y == 1).sum(), totals[0] / (y == 0).sum())
    return Model(found[FOLDS, 1], found[FOLDS, 0], *logistic(x, y, weight * len(y) / weight.sum()))
