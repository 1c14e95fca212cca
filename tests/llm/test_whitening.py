"""Whitening against numpy in plain form, and on odd tables."""

import math
import random

import numpy as np
import pytest

from lodestone.llm import whitening
from lodestone.llm.queries import QUERIES
from tests.conftest import SF


def plain(vectors, components=8):
    """{row number: (deviation, whitened, explained)} by whole numbers and numpy."""
    kept = [(i, v) for i, v in enumerate(vectors) if v and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(1024 * c) + 100000 for c in v] for _, v in kept]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    centred = np.array([[(n * c - s) / n for c, s in zip(v, sums, strict=True)] for v in x])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    w = centred @ axes[:, :components] / np.sqrt(values[:components])
    deviation = [sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for v in x]
    return {i: (dev, row, values[:components] / values.sum()) for (i, _), dev, row in zip(kept, deviation, w, strict=True)}


def same(rows, want, n):
    got = {}
    for r in rows:
        got.setdefault(r["vec_id"], {})[r["component"]] = r
    assert set(got) == set(want)
    k = len(next(iter(want.values()))[1])
    signs = None
    for i, (deviation, w, explained) in want.items():
        assert set(got[i]) == set(range(1, k + 1))
        found = np.array([got[i][c]["whitened"] for c in range(1, k + 1)])
        assert {r["deviation"] for r in got[i].values()} == {deviation} and {r["n"] for r in got[i].values()} == {n}
        assert np.allclose([got[i][c]["explained"] for c in range(1, k + 1)], explained, rtol=1e-9)
        assert all(r["identity_error"] <= 1e-9 for r in got[i].values())
        if signs is None and (np.abs(w) > 1e-3).all():
            signs = np.sign(found * w)
        if signs is not None:
            assert np.allclose(found, signs * w, atol=1e-6)
    assert signs is not None


def test_the_query_equals_numpy(spark):
    vectors = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    ids = list(vectors)
    want = {ids[i]: w for i, w in plain([vectors[i] for i in ids]).items()}
    same(QUERIES["op12_whitening"](spark, SF).collect(), want, len(ids))


@pytest.mark.parametrize("d", [1, 2, 3, 8, 67])
def test_any_number_of_dimensions(spark, d):
    """Rings of odd, even and single length, and more than one block of pairs."""
    r = random.Random(d)
    vectors = [[r.gauss(k, 1 + k % 5) for k in range(d)] for _ in range(3 * d + 4)]
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>").repartition(5)
    got = whitening.whiten(df).collect()
    values = np.linalg.eigvalsh(np.cov(np.floor(1024 * np.array(vectors)).T, bias=True).reshape(d, d))[::-1]
    same(got, plain(vectors, min(8, d)), len(vectors))
    assert np.allclose(sorted({r["explained"] for r in got}, reverse=True), (values / values.sum())[:8])


def test_odd_rows_are_dropped_and_ties_count(spark):
    r = random.Random(5)
    good = [[r.gauss(0, 1) for _ in range(4)] for _ in range(30)]
    odd = [None, [], [1.0, None, 2.0, 3.0], [float("nan")] * 4, [1.0, float("inf"), 0.0, 0.0], [0.0] * 4, good[0]]
    rows = [(i, v, "x") for i, v in enumerate(good + odd)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, x string").withColumnsRenamed({"x": "w"})
    same(whitening.whiten(df).collect(), plain(good + odd, 4), 32)
    twice = df.unionByName(spark.createDataFrame([(None, good[1], "x")], df.schema))
    assert {r["n"] for r in whitening.whiten(twice).collect()} == {33}


def test_tables_without_variance_give_no_rows(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        out = whitening.whiten(spark.createDataFrame(rows, schema))
        assert out.collect() == [] and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    line = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 3.0]), (3, [1.0, 5.0])], schema)).collect()
    assert sorted((r["vec_id"], r["component"]) for r in line) == [(1, 1), (2, 1), (3, 1)]


def test_large_entries_and_unequal_lengths(spark):
    schema = "vec_id long, embedding array<double>"
    vectors = [[1e6 + i, -1e9 * i] for i in range(5)]
    got = whitening.whiten(spark.createDataFrame(list(enumerate(vectors)), schema)).where("component = 1").collect()
    want = plain(vectors, 1)
    top = (1 << 63) - 1
    assert {r["vec_id"]: r["deviation"] for r in got} == {i: (w[0] if w[0] <= top else None) for i, w in want.items()}
    huge = whitening.whiten(spark.createDataFrame([(1, [1e300, 1.0]), (2, [-1e300, 2.0]), (3, [0.0, 1.5])], schema)).collect()
    assert {r["vec_id"] for r in huge} == {1, 2, 3} and all(math.isfinite(r["whitened"]) for r in huge)
    with pytest.raises(ValueError, match="dimensions"):
        whitening.whiten(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], schema))


def test_sums_are_exact(spark):
    x = spark.createDataFrame([([2**61, -5],), ([2**61, 2**61],), ([2**61 - 1, -(2**61)],)], "x array<long>")
    assert whitening.dimension_sums(x) == (3, (3 * 2**61 - 1, -5))
