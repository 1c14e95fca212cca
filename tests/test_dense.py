"""The packed dense index against a flat scan."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import dense

VECTORS = "chunk_ix long, embedding array<float>"


def clustered(r, n, groups, dim=16):
    centres = r.normal(size=(groups, dim))
    x = centres[r.integers(0, groups, n)] + 0.05 * r.normal(size=(n, dim))
    return (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)


@pytest.mark.parametrize(("n", "groups", "rows", "k"), [(900, 12, 32, 5), (300, 300, 16, 7), (40, 3, 1024, 60)])
def test_the_top_is_the_flat_scans(spark, n, groups, rows, k):
    r = np.random.default_rng(n)
    x = clustered(r, n, groups)
    x[1 : n // 10] = x[0]  # copies: ties by id
    v = spark.createDataFrame([(i * 3, row.tolist()) for i, row in enumerate(x)] + [(10**6, None)], VECTORS)
    packed = dense.saved(dense.pack(v, rows=rows, pivots=24), "packed")
    assert packed.agg(F.sum("n")).first()[0] == n and packed.agg(F.max("n")).first()[0] <= rows
    queries = v.where("chunk_ix % 30 = 0 AND embedding IS NOT NULL").select(F.col("chunk_ix").alias("query_id"), F.lit(0).alias("variant_ix"), "embedding")
    found, read = dense.top(queries, packed, k)
    got = {}
    for row in found.orderBy("query_id", "r").collect():
        got.setdefault(row["query_id"], []).append(row["chunk_ix"])
    d = x.astype(np.float64)
    for q in range(0, n, 10):
        score = np.round(d @ d[q], 9)
        assert got[q * 3] == [i * 3 for i in sorted(range(n), key=lambda i: (-score[i], i))[:k]], q
    if groups == 12:  # most blocks are of other groups
        assert read.count() < 0.4 * packed.count() * len(got)


def test_nothing_to_search(spark):
    none = spark.createDataFrame([], VECTORS)
    packed = dense.pack(none)
    queries = spark.createDataFrame([(1, 0, [1.0, 0.0])], "query_id long, variant_ix int, embedding array<float>")
    assert packed.count() == 0 and dense.top(queries, packed, 3)[0].count() == 0
    one = dense.pack(spark.createDataFrame([(5, [0.0, 2.0]), (6, [3.0, 4.0])], VECTORS))
    assert [(r["chunk_ix"], r["raw"]) for r in dense.top(queries, one, 3)[0].orderBy("r").collect()] == [(6, 3.0), (5, 0.0)]
