"""Embedding near-duplicates by int8 tile products with rigorous error bounds.

Distinct vectors are dealt to strips; each pair of strips is one task. A unit
vector u is s*q + r, with int8 q. For two of them
|u.v - s_u*s_v*(q_u.q_v)| <= |r_u| + |r_v| + 3*|r_u|*|r_v|, so the integer product
(exact in float32) tells which pairs may reach the threshold; only those are
computed from the given components in double precision. No pair is lost.

Copies of a vector are one class, known by its own number, and never expanded. A task returns a row per
linked vector and tile, never pairs: how many vectors it links to, and the
least class it reaches in the tile.

A strip is one row of a stored table, at most `STRIP_BYTES` of vectors, and Spark's own product of the
strips with themselves reads each pair of them: nothing is replicated through a shuffle. Of
the two orders of a pair one is taken, so that every strip meets half of the others.
Comparing all with all is quadratic by nature; the tiles make it a dense product of one byte a
component.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components, rows with a null id, and vectors of different lengths link with
nothing; every row counts (repeated rows link with each other); an empty table
gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import materialize, redealt
from lodestone.llm.components import connected_components
from lodestone.llm.jaccard import by_key

THRESHOLD = 0.9
#: A strip's vectors in bytes, and the least number of strips that a task's share is made of.
STRIP_BYTES, STRIPS = 4 << 20, 12
TILE = 2048
#: Cosines nearer to the threshold are computed again in one fixed order of addition.
CLOSE = 1e-9


class Side:
    """One strip's vectors, quantised."""

    def __init__(self, ids: np.ndarray, copies: np.ndarray, x: np.ndarray):
        self.ids, self.copies, x = ids, copies, x.astype(np.float64)
        # times a power of two, which changes no cosine and rounds nothing that counts: largest components lie between
        # 0.5 and 1, and neither norms nor products of very large or small vectors leave the doubles' range
        self.x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])
        self.norm = np.sqrt((self.x * self.x).sum(axis=1))
        u = self.x / self.norm[:, None]
        self.scale = np.abs(u).max(axis=1) / 127
        self.q = np.rint(u / self.scale[:, None]).astype(np.int8)
        # sums of products of bytes are exact in float32 up to 2^24
        self.exact = self.q.astype(np.float32 if u.shape[1] * 127 * 127 < 1 << 24 else np.float64)
        r = u - self.scale[:, None] * self.q
        self.rest = np.sqrt((r * r).sum(axis=1)) + 1e-12


def linked_tile(a: Side, b: Side, rows: slice, cols: slice, threshold: float) -> np.ndarray:
    """Which pairs of a tile have at least the threshold's cosine in double precision."""
    product = a.exact[rows] @ b.exact[cols].T
    e, f, s, t = a.rest[rows], b.rest[cols], a.scale[rows], b.scale[cols]
    # 3ef <= 3e*max(f): the bound splits into a row's and a column's part; 1e-5 covers float32 rounding
    own = threshold - (e * (1 + 3 * f.max()) + 1e-5)
    # what a row's product must reach at least, whatever the column; products are integers
    least = np.where(own > f.max(), (own - f.max()) / (s * t.max()) - 0.5, -np.inf)
    i, j = np.nonzero(product >= least.astype(product.dtype)[:, None])
    linked = np.zeros(product.shape, bool)
    some = product[i, j] * s[i] * t[j] + f[j] >= own[i]
    linked[i[some], j[some]] = True
    found = int(some.sum())
    if not found:
        return linked
    x, y = a.x[rows], b.x[cols]
    if found > linked.size // 8:  # many at once
        cosine = (x @ y.T) / (a.norm[rows][:, None] * b.norm[cols][None, :])
        close = linked & (np.abs(cosine - threshold) < CLOSE)
        linked &= cosine >= threshold
        i, j = np.nonzero(close)
    else:
        i, j = np.nonzero(linked)
    for k in range(0, len(i), 65536):
        p, q = i[k : k + 65536], j[k : k + 65536]
        cosine = np.einsum("ij,ij->i", x[p], y[q]) / (a.norm[rows][p] * b.norm[cols][q])
        linked[p, q] = cosine >= threshold
    return linked


def strip_pair(a: Side, b: Side | None, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, links, least id reached) for the linked vectors of each tile; b None: within a."""
    out = []
    within, b = b is None, b or a
    for i in range(0, len(a.ids), TILE):
        for j in range(i if within else 0, len(b.ids), TILE):
            rows, cols = slice(i, i + TILE), slice(j, j + TILE)
            linked = linked_tile(a, b, rows, cols, threshold)
            if within and i == j:
                np.fill_diagonal(linked, False)
            some_rows, some_cols = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
            if not len(some_rows):
                continue
            linked = linked[np.ix_(some_rows, some_cols)]
            left, right = a.ids[rows][some_rows], b.ids[cols][some_cols]
            top = np.iinfo(np.int64).max
            reach_l, reach_r = left.copy(), right.copy()
            while True:
                new_l = np.minimum(reach_l, np.where(linked, reach_r[None, :], top).min(axis=1))
                new_r = np.minimum(reach_r, np.where(linked, new_l[:, None], top).min(axis=0))
                if (new_l == reach_l).all() and (new_r == reach_r).all():
                    break
                reach_l, reach_r = new_l, new_r
            out.append((left, linked @ b.copies[cols][some_cols], reach_l))
            if not (within and i == j):
                out.append((right, a.copies[rows][some_rows] @ linked, reach_r))
    if not out:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x).astype(np.int64) for x in zip(*out, strict=True))


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row."""
    if threshold <= 0:
        raise ValueError("threshold must be positive")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(F.col("vec_id").isNotNull() & finite & F.exists("v", lambda x: x != 0), F.lit(False))
    grouped = rows.where(usable).groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    # numbers hold from the write on: a class is known by its own, not by a vec_id that others may share
    classes, _ = materialize(grouped.select(F.monotonically_increasing_id().alias("cls"), "v", "rep", "copies"), "vectors")
    found, _ = materialize(linked_classes(classes, threshold), "vector_links")
    across, _ = materialize(connected_components(found.where("cls <> root").select(F.col("cls").alias("a"), F.col("root").alias("b"))), "linked_vectors")
    least = across.withColumnRenamed("node", "cls").join(classes.select("cls", "rep"), "cls").groupBy("component").agg(F.min("rep").alias("least"))
    reached = across.join(redealt(least), "component").select(F.col("node").alias("cls"), "least")
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    described = classes.join(links, "cls", "left").join(reached, "cls", "left")
    described = described.select("v", F.coalesce("least", "rep").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    out = rows.select("vec_id", F.when(usable, F.col("v")).alias("v")).join(described, "v", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))


def linked_classes(classes: DataFrame, threshold: float) -> DataFrame:
    """(cls, links, root) of each linked vector and tile."""
    sizes = classes.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).collect()  # a row a dimension
    strips = {r["dim"]: max(1, -(-r["n"] * r["dim"] * 4 // STRIP_BYTES), min(STRIPS, -(-r["n"] // 512))) for r in sizes}
    spark = classes.sparkSession
    table = spark.createDataFrame([(d, int(k)) for d, k in strips.items()], "dim int, strips int")
    # every vector's place is its hash's: strips are of near equal size
    dealt = classes.withColumn("dim", F.size("v")).join(F.broadcast(table), "dim").withColumn("strip", F.pmod(F.xxhash64("cls"), F.col("strips")).cast("int"))
    dealt = dealt.select("dim", "strip", "strips", "cls", "copies", "v").repartition(max(1, sum(strips.values())), "dim", "strip").sortWithinPartitions("dim", "strip")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in by_key(batches, 2):
            cols = [group.column(k)[0].as_py() for k in range(3)]
            ids, copies = (group.column(k).to_numpy() for k in (3, 4))
            x = group.column(5).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64 if group.schema.field(5).type.value_type == pa.float64() else np.float32)
            raw = [ids.astype(np.int64).tobytes(), copies.astype(np.int64).tobytes(), x.tobytes(), str(x.dtype)]
            yield pa.RecordBatch.from_arrays([*(pa.array([c], pa.int32()) for c in cols), *(pa.array([b], pa.binary()) for b in raw[:3]), pa.array([raw[3]])], names=["dim", "strip", "strips", "ids", "copies", "x", "kind"])

    packed, _ = materialize(dealt.mapInArrow(pack, "dim int, strip int, strips int, ids binary, copies binary, x binary, kind string"), "strips")
    left, right = (packed.select([F.col(c).alias(f"{side}_{c}") for c in packed.columns]) for side in "ab")
    # a strip meets itself and the next half of the others, in a ring; opposite ones once
    ahead = F.pmod(F.col("b_strip") - F.col("a_strip"), F.col("a_strips"))
    half = (ahead * 2 < F.col("a_strips")) | (ahead * 2 == F.col("a_strips")) & (F.col("a_strip") < F.col("b_strip"))
    # a difference, not an equality: strips of one length are not to be dealt by it to one task
    pairs = left.crossJoin(right).where((F.col("a_dim") - F.col("b_dim") == 0) & half)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, int] | None = None
        for batch in batches:
            for row in range(batch.num_rows):
                r = {name: batch.column(k)[row] for k, name in enumerate(batch.schema.names)}
                at, other = ((r[f"{s}_dim"].as_py(), r[f"{s}_strip"].as_py()) for s in "ab")
                if at != last:
                    a, last = _side(r, "a"), at
                found = strip_pair(a, None if at == other else _side(r, "b"), threshold)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["cls", "links", "root"])

    return pairs.mapInArrow(run, "cls long, links long, root long")


def _side(row: dict, side: str) -> Side:
    raw = {c: row[f"{side}_{c}"].as_buffer() for c in ("ids", "copies", "x")}
    ids, copies = np.frombuffer(raw["ids"], np.int64), np.frombuffer(raw["copies"], np.int64)
    return Side(ids, copies, np.frombuffer(raw["x"], row[f"{side}_kind"].as_py()).reshape(len(ids), -1))
