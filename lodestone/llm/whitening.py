"""Whitening of embeddings from centred products summed by SQL expressions.

Entries are taken as longs x = floor(1024 * c) + 100000. One aggregation sums them a dimension;
a second sums the products of centred entries for every pair of dimensions. The pairs of the
upper triangle are folded into a ring: dimension i meets i, i + 1, ... i + d/2 (modulo d), so
that each row of the aggregation carries one dimension and `PAIRS` generated sums, few enough to
stay compiled, and every task sends d x d/2 sums, whatever its rows. The covariance (a table of
d x d numbers, the only thing collected) is decomposed by LAPACK on the driver; rows are then
projected, written once, and their covariance measured.

Defined results: rows whose vector is null, empty, or holds null or non-finite entries are dropped;
null and repeated ids and repeated rows count like others; components without variance (an eigenvalue of at most
1e-12 of the trace: fewer vectors than dimensions, equal vectors) are left out, so that a table
of equal vectors or of one vector gives no rows, as an empty table does; entries beyond 2^61/1024
count as that; a deviation that a long can't hold is null; vectors of different lengths are an error; extra
columns are ignored. Signs: the largest component of each eigenvector (the first of such) is positive.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import materialize

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
#: Generated sums a row of the aggregation.
PAIRS = 33
#: Entries are bounded so, that their differences are longs.
BOUND = float(1 << 61)
#: An eigenvalue of at most this part of the trace is none.
NO_VARIANCE = 1e-12


@dataclass(frozen=True)
class Model:
    """n fitted vectors, each dimension's sum, all eigenvalues falling, and the kept eigenvectors as columns."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    axes: np.ndarray

    @property
    def explained(self) -> list[float]:
        return [float(v) for v in self.values[: self.axes.shape[1]] / self.values.sum()]


def entries(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x): the remaining rows, their entries as longs."""
    v = F.col(f"`{vector_col}`")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.where(F.coalesce(finite & (F.size(v) > 0), F.lit(False)))
    return rows.select(
        F.col(f"`{id_col}`").alias("vec_id"),
        F.transform(v, lambda c: F.floor(F.least(F.greatest(c.cast("double") * SCALE, F.lit(-BOUND)), F.lit(BOUND))) + SHIFT).alias("x"),
    )


def dimension_sums(rows: DataFrame) -> tuple[int, tuple[int, ...]]:
    """The number of rows and each dimension's exact sum, from one aggregation. High and low bits are
    summed apart, so that no sum leaves a long."""
    span = rows.agg(F.count("*").alias("n"), F.min(F.size("x")).alias("a"), F.max(F.size("x")).alias("b")).first()
    if not span["n"]:
        return 0, ()
    if span["a"] != span["b"]:
        raise ValueError(f"vectors of {span['a']} and {span['b']} dimensions")
    each = rows.select(F.posexplode("x").alias("i", "v")).groupBy("i")
    found = each.agg(F.expr("sum(shiftright(v, 24))").alias("high"), F.expr("sum(v & 16777215)").alias("low")).collect()  # a row a dimension
    sums = {r["i"]: (r["high"] << 24) + r["low"] for r in found}
    return span["n"], tuple(sums[i] for i in range(span["a"]))


def covariance(rows: DataFrame, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """d x d, divisor n, entries centred before they are multiplied."""
    d = len(sums)
    # the mean as a whole number and a rest below 1: the difference to the first is exact
    whole = ", ".join(f"{s // n}L" for s in sums)
    rest = ", ".join(f"{(s % n) / n!r}D" for s in sums)
    # twice on end: the ring's places need no modulo
    centred = f"transform(concat(x, x), (v, k) -> cast(v - get(array({whole}), k % {d}) AS DOUBLE) - get(array({rest}), k % {d})) AS c"
    blocks = -(-(d // 2 + 1) // PAIRS)
    unit = rows.selectExpr(centred).selectExpr("c", f"explode(sequence(0, {d * blocks - 1})) AS u")
    placed = unit.selectExpr("c", "u", f"u % {d} AS i", f"cast(u % {d} + u div {d} * {PAIRS} AS INT) AS j")
    products = [f"sum(get(c, i) * get(c, j + {k})) AS p{k}" for k in range(min(PAIRS, d // 2 + 1))]
    found = placed.groupBy("u").agg(*[F.expr(p) for p in products]).collect()  # d x blocks rows
    out = np.zeros((d, d))
    for r in found:
        i, at = r["u"] % d, r["u"] // d * PAIRS
        for k in range(min(len(products), d // 2 + 1 - at)):
            j = (i + at + k) % d
            out[i, j] = out[j, i] = r[f"p{k}"] / n
    return out


def fit(rows: DataFrame, components: int = COMPONENTS) -> Model:
    n, sums = dimension_sums(rows)
    if not n:
        return Model(0, (), np.zeros(0), np.zeros((0, 0)))
    values, axes = np.linalg.eigh(covariance(rows, n, sums))
    values, axes = np.maximum(values[::-1], 0), axes[:, ::-1]
    kept = int((values > NO_VARIANCE * values.sum()).sum()) if values.sum() > 0 else 0
    axes = axes[:, : min(components, kept)]
    largest = np.abs(axes).argmax(axis=0)
    return Model(n, sums, values, axes * np.sign(axes[largest, np.arange(axes.shape[1])]))


def project(rows: DataFrame, model: Model) -> DataFrame:
    """(vec_id, deviation, w): each row's squared distance from the mean times n^2, exact, and its whitened components."""
    n, d = model.n, len(model.sums)
    whole = np.array([s // n for s in model.sums], np.int64)
    rest = [s % n for s in model.sums]
    scaled = model.axes / np.sqrt(model.values[: model.axes.shape[1]])
    top = np.iinfo(np.int64).max

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1)
            if isinstance(x, pa.ChunkedArray):
                x = x.combine_chunks()
            x = x.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, d) - whole
            w = (x - np.array(rest, np.float64) / n) @ scaled
            most = (int(np.abs(x).max()) + 1) * n if len(x) else 0
            if most * most * d < top:
                far = n * x - np.array(rest, np.int64)
                deviation = pa.array((far * far).sum(axis=1))
            else:  # beyond a long's range on the way: whole numbers of any size
                far = x.astype(object) * n - np.array(rest, object)
                deviation = pa.array([int(s) if s <= top else None for s in (far * far).sum(axis=1)], pa.int64())
            listed = pa.ListArray.from_arrays(np.arange(batch.num_rows + 1, dtype=np.int32) * w.shape[1], w.ravel())
            yield pa.RecordBatch.from_arrays([batch.column(0), deviation, listed], names=["vec_id", "deviation", "w"])

    return rows.mapInArrow(run, f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, deviation long, w array<double>")


def identity_error(projected: DataFrame, components: int) -> float:
    """The largest absolute entry of the whitened components' covariance minus the identity."""
    pairs = [(i, j) for i in range(components) for j in range(i, components)]
    sums = [F.covar_pop(F.get("w", F.lit(i)), F.get("w", F.lit(j))) for i, j in pairs]
    found = projected.agg(*[s.alias(f"v{k}") for k, s in enumerate(sums)]).first()
    return max(abs(v - (i == j)) for v, (i, j) in zip(found, pairs, strict=True))


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each remaining vector and component."""
    rows = entries(vectors, id_col, vector_col)
    model = fit(rows, components)
    kept = model.axes.shape[1]
    if not kept:
        return rows.select("vec_id", *[F.lit(None).cast(t).alias(c) for c, t in (("component", "int"), ("n", "long"), ("deviation", "long"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double"))]).limit(0)
    projected, _ = materialize(project(rows, model), "whitened")
    error = identity_error(projected, kept)
    each = projected.select("vec_id", "deviation", F.posexplode("w").alias("k", "whitened"))
    explained = F.get(F.array(*[F.lit(e) for e in model.explained]), F.col("k"))
    return each.select(
        "vec_id",
        (F.col("k") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        explained.alias("explained"),
        F.lit(error).alias("identity_error"),
    )
