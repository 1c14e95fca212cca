"""A flat dense index in blocks, of which a search reads those that can matter, exactly.

Vectors are dealt to the nearest of a few pivots, put in order of their distance from it, and packed into blocks
once, when the index is built: ids and numbers as bytes, with the block's centre and radius. An inner product
with a vector x of a block is at most q.c + |q| r (Cauchy). A search bounds every block for every query, which is
one small product for thousands of vectors, reads for each query the blocks of the largest bounds until
they hold k vectors, and then only those blocks whose bound reaches the k-th best product found. What is
left out scores less than that, so the result is the flat scan's.

Pivots are a bounded sample (`PIVOTS` vectors of the smallest hashes of their ids): they shape blocks and decide no result.
Defined results: null vectors are left out; ties by smaller chunk_ix; fewer vectors than k give them all; vectors of another
length than the first are an error.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.score import KEYS, TIE_PLACES
from lodestone.sources.shared import read_pointer, saved, write_pointer

PIVOTS = 64
#: Vectors of a block at most, and queries that a task multiplies a block with at once.
ROWS, QUERIES = 1024, 512
#: Rounding of bounds and products.
SLACK = 10.0 ** (1 - TIE_PLACES)
PACKED = "block long, n int, ids binary, x binary, centre array<double>, radius double"


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def pack(vectors: DataFrame, rows: int = ROWS, pivots: int = PIVOTS) -> DataFrame:
    """(block, n, ids, x, centre, radius) of vectors (chunk_ix, embedding)."""
    some = vectors.where("embedding IS NOT NULL").select(F.col("chunk_ix").cast("long"), F.col("embedding").cast("array<double>"))
    sample = some.orderBy(F.xxhash64("chunk_ix"), "chunk_ix").limit(pivots).collect()  # at most `pivots` rows
    heads = np.array([r["embedding"] for r in sample], np.float64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1))
            if not len(x):
                continue
            far = (heads * heads).sum(axis=1)[None, :] - 2 * (x @ heads.T)
            cell = far.argmin(axis=1)
            away = far[np.arange(len(x)), cell] + (x * x).sum(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(away)], names=["chunk_ix", "embedding", "cell", "away"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        of, n = None, 0
        for batch in batches:
            cells = batch.column(2).to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(cells)) + 1, [batch.num_rows]])
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                while a < b:
                    if held and (cells[a] != of or n == rows):
                        yield packed(held)
                        held, n = [], 0
                    take = min(b - a, rows - n)
                    held.append(batch.slice(a, take))
                    of, n, a = cells[a], n + take, a + take
        if held:
            yield packed(held)

    def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        x = _matrix(table.column(1))
        centre = x.mean(axis=0)
        radius = float(np.sqrt(((x - centre) ** 2).sum(axis=1)).max())
        ids = table.column(0).to_numpy().astype(np.int64)
        cols = [pa.array([len(x)], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary()), pa.array([centre.tolist()], pa.list_(pa.float64())), pa.array([radius])]
        return pa.RecordBatch.from_arrays(cols, names=["n", "ids", "x", "centre", "radius"])

    if not sample:
        return vectors.sparkSession.createDataFrame([], PACKED)
    dealt = saved(some.mapInArrow(deal, "chunk_ix long, embedding array<double>, cell int, away double"), "dealt_vectors")
    spread = dealt.repartitionByRange("cell", "away", "chunk_ix").sortWithinPartitions("cell", "away", "chunk_ix")
    blocks = spread.mapInArrow(gather, "n int, ids binary, x binary, centre array<double>, radius double")
    return blocks.select(F.monotonically_increasing_id().alias("block"), "*")


def stored(vectors: DataFrame, root: str, name: str, **how: int) -> DataFrame:
    """The packed vectors under `name` (a key of what they are made of), written the first time and read from then on."""
    spark = vectors.sparkSession
    folder = read_pointer(spark, f"{root}/{name}.current")
    if folder is None:
        folder = f"{name}-{uuid.uuid4().hex}"
        pack(vectors, **how).write.parquet(f"{root}/{folder}")
        write_pointer(spark, f"{root}/{name}.current", folder)
    return spark.read.parquet(f"{root}/{folder}")


def bounds(queries: DataFrame, packed: DataFrame) -> DataFrame:
    """(query_id, variant_ix, embedding, block, n, bound): the most that a query's product with a vector of the block can be."""
    size = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))
    dot = F.aggregate(F.zip_with("embedding", "centre", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    asked = queries.where("embedding IS NOT NULL").select(*KEYS, F.col("embedding").cast("array<double>"))
    # every query with every block's summary: a few numbers for a thousand vectors
    pairs = asked.crossJoin(packed.select("block", "n", "centre", "radius"))
    return pairs.select(*KEYS, "embedding", "block", "n", (dot + size * F.col("radius") + SLACK).alias("bound"))


def products(wanted: DataFrame, packed: DataFrame, k: int) -> DataFrame:
    """(query_id, variant_ix, chunk_ix, raw): the k best of each wanted block, (query_id, variant_ix, embedding, block), for its query."""
    dealt = wanted.withColumn("share", F.pmod(F.xxhash64(*KEYS), F.lit(1 << 20)) % F.greatest(F.lit(1), F.ceil(F.count("*").over(Window.partitionBy("block")) / QUERIES)))
    grouped = dealt.groupBy("block", "share").agg(F.collect_list(F.struct(*KEYS, "embedding")).alias("q"))
    rows = packed.select("block", "ids", "x").join(grouped, "block").select("ids", "x", F.col("q.query_id").alias("query"), F.col("q.variant_ix").alias("variant"), F.flatten("q.embedding").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                raw = [batch.column(c)[row] for c in range(5)]
                ids = np.frombuffer(raw[0].as_buffer(), np.int64)
                x = np.frombuffer(raw[1].as_buffer(), np.float64).reshape(len(ids), -1)
                query, variant = (raw[c].values.to_numpy() for c in (2, 3))
                scores = raw[4].values.to_numpy().reshape(len(query), -1) @ x.T
                order = np.lexsort((np.broadcast_to(ids, scores.shape), -np.round(scores, TIE_PLACES)))[:, :k]
                at = np.repeat(np.arange(len(query)), order.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(query[at]), pa.array(variant[at].astype(np.int32)), pa.array(ids[order.ravel()]), pa.array(scores[at, order.ravel()])], names=[*KEYS, "chunk_ix", "raw"])

    return rows.mapInArrow(run, "query_id long, variant_ix int, chunk_ix long, raw double")


def top(queries: DataFrame, packed: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(query_id, variant_ix, chunk_ix, raw, r): the k largest inner products of each query (query_id, variant_ix, embedding), from 1, ties
    by chunk_ix; and what was read: (query_id, variant_ix, block)."""
    bounded = saved(bounds(queries, packed), "dense_bounds")
    ordered = Window.partitionBy(*KEYS).orderBy(F.desc("bound"), "block").rowsBetween(Window.unboundedPreceding, -1)
    placed = saved(bounded.withColumn("before", F.coalesce(F.sum("n").over(ordered), F.lit(0))), "dense_places")
    first = saved(products(placed.where(F.col("before") < k), packed, k), "dense_products")
    best = Window.partitionBy(*KEYS).orderBy(F.round("raw", TIE_PLACES).desc(), "chunk_ix")
    last = first.withColumn("r", F.row_number().over(best)).where(F.col("r") == k).select(*KEYS, F.col("raw").alias("last"))
    more = saved(placed.where(F.col("before") >= k).join(last, KEYS).where(F.col("bound") >= F.col("last") - SLACK), "dense_more")
    found = first.unionByName(products(more.select(*KEYS, "embedding", "block"), packed, k))
    read = placed.where(F.col("before") < k).select(*KEYS, "block").unionByName(more.select(*KEYS, "block"))
    return found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k), read
