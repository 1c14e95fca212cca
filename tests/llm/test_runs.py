"""Runs against brute force, comparisons counted on texts made to be hard, and odd tables."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from lodestone.llm import runs
from lodestone.llm.common import text_bytes
from lodestone.llm.queries import QUERIES, with_periodic_ends
from tests.conftest import SF


def plain(s, least=12):
    """All runs by trying every period, smallest first."""
    out, n = set(), len(s)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and s[j] == s[j + q]:
                j += 1
            start, length = i, j - i + q
            i = j + 1
            if j - start >= q and length >= least and not any(a <= start and a + b >= start + length for a, b, p in out):
                out.add((start, length, q))
    return out


def strings(r):
    for _ in range(1500):
        n, kinds = r.randrange(1, 60), r.randrange(1, 5)
        s = [r.randrange(kinds) for _ in range(n)]
        if r.random() < 0.4:
            s = (s[: r.randrange(1, 9)] * 60)[:n]
            for _ in range(r.randrange(3)):
                s[r.randrange(n)] = r.randrange(kinds)
        yield s


def test_runs_equal_brute_force():
    r = random.Random(2)
    for s in strings(r):
        least = r.choice([2, 3, 12])
        # smaller periods within a run of their own are found apart: least 2 keeps all of them
        every = plain(s, 2)
        assert runs.runs_of(np.array(s), least) == {x for x in every if x[1] >= least}


def test_next_smaller_suffixes_and_matched_lengths():
    for s in strings(random.Random(3)):
        nss, nlce, _ = runs.next_smaller(s)
        for i in range(len(s)):
            j = next((j for j in range(i + 1, len(s)) if s[j:] < s[i:]), len(s))
            assert nss[i] == j
            if j < len(s):
                assert nlce[i] == next((k for k in range(len(s) - j) if s[i + k] != s[j + k]), len(s) - j)


def hard(n=20_000):
    r = random.Random(4)
    fibonacci, other = [0, 1], [0]
    while len(fibonacci) < n:
        fibonacci, other = fibonacci + other, fibonacci
    doubled = [0]
    while len(doubled) < n:
        doubled = doubled * 2 + [r.randrange(2)]
    return {
        "equal": [0] * n,
        "fibonacci": fibonacci[:n],
        "thue": [bin(i).count("1") & 1 for i in range(n)],
        "random": [r.randrange(2) for _ in range(n)],
        "periodic": ([r.randrange(3) for _ in range(977)] * 30)[:n],
        "doubled": doubled[:n],
        "powers": sum(([0] * k + [1] for k in range(1, 200)), []),
        "falling": sum(([0] * k + [1] for k in range(200, 1, -1)), []),
    }


@pytest.mark.parametrize("sign", [1, -1])
def test_comparisons_grow_with_the_text_alone(sign):
    for name, s in hard().items():
        assert runs.next_smaller([x * sign for x in s])[2] <= 3 * len(s), name


def test_words_are_numbered_exactly():
    r = random.Random(6)
    words = ["a", "a\x00", "a\x00\x00", "ab", "abcdefgh", "abcdefgh\x00", "abcdefghi", "abcdefghijklmnop", "x" * 127, "x" * 128, "x" * 129, "x" * 3000, "x" * 2999 + "y", "é", "漢字漢字漢字"]
    listed = [r.choice(words) for _ in range(400)]
    text = " ".join(listed).encode()
    starts, ends, _ = runs.word_spans(runs._INSIDE[np.frombuffer(text, np.uint8)], np.array([0, len(text)]))
    ids = runs.numbers(np.frombuffer(text, np.uint8), starts, ends).tolist()
    assert len(starts) == 400 and len(set(ids)) == len(set(listed)) == len(set(zip(ids, listed, strict=True)))


def test_cutting_at_single_words_loses_no_run():
    r = random.Random(7)
    texts = []
    for _ in range(300):
        words = [f"w{r.randrange(40)}" for _ in range(r.randrange(0, 120))]
        for _ in range(r.randrange(3)):
            at = r.randrange(len(words) + 1)
            words[at:at] = [f"w{r.randrange(6)}" for _ in range(r.randrange(1, 9))] * r.randrange(2, 6)
        texts.append(" ".join(words))
    import pyarrow as pa

    data, offsets = text_bytes(pa.array(texts))
    counts, found = runs.text_runs(data, offsets)
    for d, t in enumerate(texts):
        assert counts[d] == len(t.split())
        assert found.get(d, []) == sorted(plain(t.split()), key=lambda x: (x[0], x[2]))
    assert sum(map(len, found.values())) > 50


def answer(doc_id, text):
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", text or "") if w]
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    found = sorted(plain(words), key=lambda x: (x[0], x[2]))
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=None)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    top = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *top, digest("".join(f"{s},{length},{q}\n" for s, length, q in found)), digest(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_the_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = sorted(tuple(r) for r in QUERIES["op13_lyndon_runs"](spark, SF).collect())
    small = [r for r in docs if len((r["text"] or "").split()) < 600]
    want = {r["doc_id"]: answer(r["doc_id"], r["text"]) for r in small}
    assert len(got) == len(docs) and all(want.get(r[0], r) == r for r in got) and len(want) > 100
    assert sum(r[1] > 0 for r in got) >= len(docs) // 20


def test_odd_rows(spark):
    loop = "x y z " * 50_000
    rows = [(None, loop, 1), (1, None, 2), (2, "", 3), (3, " \n\t\x0b", 4), (4, loop, 5), (4, loop, 5), (5, "a " * 11, 6), (6, "a  " * 12, 7), (7, "a" * 2_000_000, 8), (8, "p q " * 6 + "end", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs int")
    got = sorted(runs.find(df, keep=["doc_id", "text", "runs"]).collect(), key=lambda r: (r["doc_id"] or 0))
    assert [(r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]]) for r in got] == [
        (None, 150_000, [(0, 150_000, 3)]), (1, 0, []), (2, 0, []), (3, 0, []), (4, 150_000, [(0, 150_000, 3)]), (4, 150_000, [(0, 150_000, 3)]),
        (5, 11, []), (6, 12, [(0, 12, 1)]), (7, 1, []), (8, 13, [(0, 12, 2)]),
    ]
    assert {r["doc_id"]: r["collapsed"] for r in got}[8] == "p q end" and {r["collapsed"] for r in got if r["doc_id"] in (None, 4)} == {"x y z"}
    clash = df.withColumnsRenamed({"runs": "collapsed"}).withColumn("doc", df["doc_id"])
    assert set(runs.find(clash).columns) == {"doc_id", "text", "doc", "n_words", "runs", "collapsed"}
    empty = spark.createDataFrame([], df.schema)
    assert runs.find(empty).collect() == []
    assert with_periodic_ends(df).count() == len(rows) and {r["text"] for r in with_periodic_ends(df).collect() if r["doc_id"] is None} == {loop}
