"""Chunking, extraction, index, scores, ranking, answers."""

import hashlib
import math
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.operators import answer, chunk, extract, hooks, index, rank, score
from lodestone.plans import retrieve
from lodestone.sources import documents as src
from lodestone.sources.shared import numbered, saved
from lodestone.streaming import ingest


def sentence(n, tag="w"):
    return " ".join(f"{tag}{i}" for i in range(n - 1)) + " end." if n > 1 else "end."


def pages_of(spark, *texts):
    return spark.createDataFrame([("s", i + 1, t) for i, t in enumerate(texts)], "source string, page int, text string")


def widths_of(spark, text):
    return [r["n_words"] for r in chunk.chunk_pages(pages_of(spark, text)).orderBy("chunk_no").collect()]


# -------------------------------------------------------------------- chunking


@pytest.mark.parametrize("sizes, want", [([450], [450]), ([25, 190], [25, 215]), ([180, 60], [180, 60]), ([100, 90, 10, 50], [200, 60]), ([10] * 30, [200, 130])])
def test_chunk_sizes(spark, sizes, want):
    assert widths_of(spark, " ".join(sentence(n) for n in sizes)) == want


def model_ranges(w, most=200, overlap=30):
    out, lo, cur = [], 0, 0
    for i, n in enumerate(w):
        if cur + n > most and i > lo:
            out.append((lo, i - 1))
            keep, total = 0, 0
            while i - 1 - keep >= lo and total + w[i - 1 - keep] <= overlap:
                total += w[i - 1 - keep]
                keep += 1
            lo, cur = i - keep, total
        cur += n
    return [*out, (lo, len(w) - 1)]


def test_ranges_equal_a_model_and_cover_every_sentence(spark):
    drawn = []

    @settings(max_examples=200, deadline=None, database=None)
    @given(st.lists(st.one_of(st.integers(1, 40), st.integers(1, 260)), min_size=1, max_size=40))
    def draw(w):
        drawn.append(w)

    draw()
    got = spark.createDataFrame([(w,) for w in drawn], "w array<int>").select("w", chunk.ranges("w", 200, 30).alias("r")).collect()
    for r in got:
        pairs = [(x["lo"], x["hi"]) for x in r["r"]]
        assert pairs == model_ranges(r["w"])
        assert pairs[0][0] == 0 and pairs[-1][1] == len(r["w"]) - 1
        for (_, a), (b, _) in zip(pairs, pairs[1:]):
            assert b <= a + 1 and sum(r["w"][b : a + 1]) <= 30


def test_chunks_stay_on_their_page_and_tables_stay_whole(spark):
    table = "[TABLE]\n" + " | ".join(["cell. next"] * 150) + "\n[/TABLE]"
    got = chunk.chunk_pages(pages_of(spark, sentence(5) + " " + table + " " + sentence(4), sentence(3))).orderBy("page", "chunk_no").collect()
    assert any(table in r["text"] for r in got) and got[-1]["page"] == 2 and got[-1]["n_words"] == 3


def test_blank_pages_have_no_chunks(spark):
    assert chunk.chunk_pages(pages_of(spark, "", " \n")).count() == 0


def test_numbers_are_dense_in_order(spark):
    df = spark.createDataFrame([(f"s{i % 3}", i) for i in range(500)], "a string, b int").repartition(7)
    got = [(r["a"], r["b"]) for r in numbered(df, ["a", "b"], "k").orderBy("k").collect()]
    assert got == sorted(got)
    assert sorted(r["k"] for r in numbered(df, ["a", "b"], "k").collect()) == list(range(500))


# ------------------------------------------------------------------ extraction


def block_rows(spark, rows, width=100.0):
    return spark.createDataFrame([("d", 1, width, float(x), float(y), i, t) for i, (x, y, t) in enumerate(rows)], "source string, page int, page_width double, x0 double, y0 double, block_ix int, text string")


def test_reading_order(spark):
    two = block_rows(spark, [(60, 1, "right"), (10, 9, "left low"), (47, 2, "middle"), (10, 0, " top "), (10, 5, "  ")])
    assert extract.block_text(two).first()["text"] == "top\nmiddle\nleft low\nright"
    single = block_rows(spark, [(10, 2, "b"), (44, 1, "a"), (10, 2, "c")])
    assert extract.block_text(single).first()["text"] == "a\nb\nc"
    assert [r["column"] for r in extract.ordered_blocks(extract.usable_blocks(two)).orderBy("block_ix").collect()] == [1, 0, 0, 0]


def test_fallback_layers(spark):
    df = spark.createDataFrame([(" a ", "b", "c"), (" ", " b", "c"), (None, "", "c"), (None, None, "\n")], "a string, b string, c string")
    assert [r["t"] for r in df.select(extract.first_text(F.col("a"), F.col("b"), F.col("c")).alias("t")).collect()] == ["a", "b", "c", None]


def test_a_ragged_table_loses_its_page(spark):
    rows = [("d", 1, 0, [["a"], ["b"]]), ("d", 1, 1, [["a", "b"], ["c"]]), ("d", 2, 0, [["a"], ["b"]]), ("d", 3, 0, [])]
    got = {r["page"]: (r["markdowns"], r["ragged"]) for r in extract.page_tables(spark.createDataFrame(rows, "source string, page int, table_ix int, cells array<array<string>>")).collect()}
    assert got == {1: ([], True), 2: (["| a |\n| - |\n| b |"], False)}


def test_images_and_captions(spark):
    df = spark.createDataFrame([("d", 1, 1, 99, 500, "x"), ("d", 1, 3, 100, 100, "b"), ("d", 1, 2, 200, 100, "a"), ("d", 1, 4, 200, 200, None), ("d", 2, 1, 200, 200, " ")], "source string, page int, image_ix int, width int, height int, caption string")
    assert extract.large_images(df).count() == 4
    assert [r["captions"] for r in extract.captions(extract.large_images(df)).collect()] == [["[Image: a]", "[Image: b]"]]


def test_assembly(spark):
    texts = spark.createDataFrame([("d", 1, "text"), ("d", 3, "")], "source string, page int, text string")
    tables = spark.createDataFrame([("d", 1, ["| a |"]), ("d", 2, ["| b |"])], "source string, page int, markdowns array<string>")
    images = spark.createDataFrame([("d", 2, ["[Image: c]"])], "source string, page int, captions array<string>")
    got = {r["page"]: r["text"] for r in extract.assemble(texts, tables, images).collect()}
    assert got == {1: "text\n\n\n[TABLE]\n| a |\n[/TABLE]", 2: "[TABLE]\n| b |\n[/TABLE]\n\n[Image: c]"}


def test_hooks_survive_failing_rows(spark):
    def load():
        def f(batch):
            if any(x == b"bad" for x in map(bytes, batch)):
                raise ValueError("no image")
            return ["ok"] * len(batch)

        return f

    df = spark.createDataFrame([(1, bytearray(b"good")), (2, bytearray(b"bad"))], "k int, content binary")
    got = {r["k"]: (r["caption"], r["hook_error"]) for r in hooks.caption(df, load).collect()}
    assert got == {1: ("ok", None), 2: (None, "ValueError: no image")}


def test_hooks_pass_results_on(spark):
    """A worker does not hold the results of a whole Arrow batch."""

    def load():
        class Counted(str):
            alive = 0

            def __new__(cls, _):
                cls.alive += 1
                return super().__new__(cls, cls.alive)

            def __del__(self):
                type(self).alive -= 1

        return lambda images: [Counted(x) for x in images]

    df = spark.range(0, 64, 1, 1).select("id", F.array(F.lit(1)).alias("other"), F.repeat(F.lit("x"), 100_000).cast("binary").alias("content"))
    got = hooks.caption(df, load).select("id", "other", F.col("caption").cast("int").alias("n")).collect()
    assert [r["id"] for r in got] == list(range(64)) and all(r["other"] == [1] for r in got)
    assert max(r["n"] for r in got) <= 24  # twice the 1 MB of input that may be held


def test_ocr_passes_rows_on(spark):
    """The other columns and failures stay with their rows where a batch is passed on in pieces."""

    def load():
        def f(images):
            if bytes(images[0]).endswith(b"7"):
                raise ValueError("unreadable")
            return [f" {bytes(x)[-3:].decode()} " for x in images]

        return f

    image = F.concat(F.repeat(F.lit("x"), 200_000), F.lpad(F.col("id").cast("string"), 3, "0")).cast("binary")
    got = hooks.ocr(spark.range(0, 100, 1, 1).select("id", image.alias("image")), load).select("id", "ocr_text", "hook_error").collect()
    failed = (None, "ValueError: unreadable")
    assert [tuple(r) for r in got] == [(i, *(failed if i % 10 == 7 else (f"{i:03}", None))) for i in range(100)]


def test_hooks_take_arrays_of_a_model(spark):
    def load():
        import numpy as np

        return lambda texts: np.array([[3, 4]] * len(texts), np.float32)

    v = hooks.embed(spark.range(200).select("id", F.lit("x").alias("text")).coalesce(1), load)
    rows = v.collect()
    assert sorted(r["id"] for r in rows) == list(range(200)) and all(abs(r["embedding"][0] - 0.6) < 1e-6 for r in rows)


# --------------------------------------------------------------------- sources


def test_cache_keeps_pages_of_renamed_files(spark, tmp_path):
    for name, text in (("a.txt", "same"), ("b.txt", "same"), ("c.txt", "other"), ("d.txt", " ")):
        (tmp_path / name).write_text(text)
    files = src.read_files(spark, str(tmp_path), "*.txt")
    calls = []

    def extract_text(todo):
        calls.append(todo.count())
        return todo.select("doc_md5", F.lit(1).alias("page"), F.decode("content", "UTF-8").alias("text")).where("trim(text) <> ''")

    pages, new = src.cached_pages(files, None, extract_text)
    assert {r["source"] for r in pages.collect()} == {"a.txt", "b.txt", "c.txt"} and calls == [3]
    src.write_cache(new, f"{tmp_path}/cache")
    (tmp_path / "e.txt").write_text("same")
    cache = src.read_cache(spark, f"{tmp_path}/cache", files)
    assert re.search(r"PartitionFilters: \[[^\]]*part", cache._jdf.queryExecution().explainString(cache._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")))
    again, newer = src.cached_pages(src.read_files(spark, str(tmp_path), "*.txt"), cache, extract_text)
    assert again.where("source = 'e.txt'").count() == 1 and calls == [3, 0] and newer.count() == 0


def test_every_listed_file_gets_its_pages_once(spark, tmp_path):
    """Rows that are there twice, names and paths that are null, and empty contents: as the cache's SQL says."""
    from lodestone import queries

    rows = [(1, "twice", "s"), (1, "twice", "s"), (2, "", "s"), (3, "no path", None), (None, "no name", "s"), (4, None, "s"), (5, "twice", "t")] + [(k, f"text {k}", "s") for k in range(10, 40)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((str(r["source"]), r["page"], r["text"]) for r in queries.s3(spark, str(tmp_path)).collect())
    assert got == sorted((f"file{k}" if k else "None", 1, text) for k, text, _ in rows if text)
    assert queries.s3_work(spark, str(tmp_path)).first()["n"] == len({t for _, t, _ in rows if t is not None and hashlib.md5(t.encode()).hexdigest() >= "8"})


def test_file_stats_and_fingerprint(spark):
    files = spark.createDataFrame([("a", "1"), ("b", "2")], "name string, doc_md5 string")
    chunks = spark.createDataFrame([("a",), ("a",)], "source string")
    stats = src.file_stats(files, chunks)
    assert {(r["name"], r["chunks"]) for r in stats.collect()} == {("a", 2), ("b", 0)}
    assert src.totals(stats).first() == (2, 2)
    changed = files.withColumn("doc_md5", F.lit("3"))
    assert src.fingerprint(files).first() == src.fingerprint(files.orderBy(F.desc("name"))).first() != src.fingerprint(changed).first()
    with pytest.raises(ValueError):
        src.require_chunks(chunks.limit(0))


def test_streaming_ingest_appends_chunks(spark, tmp_path):
    pages_of(spark, sentence(30), sentence(20)).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("source string, page int, text string").parquet(f"{tmp_path}/in")
    ingest.append_chunks(stream, f"{tmp_path}/chunks", f"{tmp_path}/check").awaitTermination()
    pages_of(spark, "", "", sentence(9)).where("page = 3").write.mode("append").parquet(f"{tmp_path}/in")
    ingest.append_chunks(stream, f"{tmp_path}/chunks", f"{tmp_path}/check").awaitTermination()
    assert sorted(r["n_words"] for r in spark.read.parquet(f"{tmp_path}/chunks").collect()) == [9, 20, 30]
    seen = ingest.distinct_pages(stream)
    assert seen.isStreaming


# ---------------------------------------------------------------------- scores

TEXTS = ["alpha beta beta", "beta gamma", "beta delta epsilon", "zeta"]


def chunk_rows(spark, texts, source="s", pages=None):
    rows = [(i, source if isinstance(source, str) else source[i], pages[i] if pages else i + 1, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "chunk_ix long, source string, page int, text string")


def test_bm25_by_hand(spark):
    ix = index.build(chunk_rows(spark, TEXTS), keep=False)
    n, avgdl = 4, 9 / 4
    raw = {t: math.log(n - d + 0.5) - math.log(d + 0.5) for t, d in {"alpha": 1, "beta": 3, "gamma": 1, "delta": 1, "epsilon": 1, "zeta": 1}.items()}
    idf = {t: v if v >= 0 else 0.25 * sum(raw.values()) / 6 for t, v in raw.items()}
    got = {r["term"]: r["idf"] for r in ix.term_stats.collect()}
    assert got == pytest.approx(idf) and idf["beta"] > 0
    q = spark.createDataFrame([(1, 0, "beta Beta alpha nowhere")], "query_id long, variant_ix int, text string")
    scores = {r["chunk_ix"]: r["raw"] for r in score.bm25_raw(q, ix).collect()}
    part = lambda t, tf, dl: idf[t] * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))
    assert scores == pytest.approx({0: 2 * part("beta", 2, 3) + part("alpha", 1, 3), 1: 2 * part("beta", 1, 2), 2: 2 * part("beta", 1, 3)})


def test_unretained_rows_rank_above_a_retained_negative(spark):
    top = spark.createDataFrame([(1, 0, 0, 0.5), (1, 0, 1, -0.3)], "query_id long, variant_ix int, chunk_ix long, raw double")
    inside, rest = score.dense_norm(top, 5, 2)
    got = {r["chunk_ix"]: r["dense"] for r in inside.collect()}
    assert got == pytest.approx({0: 1.0, 1: 0.0}) and rest.first()["dense_rest"] == pytest.approx(0.3 / 0.8)
    inside, _ = score.dense_norm(top, 2, 2)
    assert {r["chunk_ix"]: r["dense"] for r in inside.collect()} == pytest.approx({0: 1.0, 1: 0.0})


def test_maxima_are_independent(spark):
    s = spark.createDataFrame([(1, 0, 7, 1.0, 0.0, 0.6), (1, 1, 7, 0.0, 1.0, 0.4), (1, 0, 8, -1.0, -1.0, -1.0)], "query_id long, variant_ix int, chunk_ix long, dense double, bm25 double, combined double")
    got = {r["chunk_ix"]: (r["dense"], r["bm25"], r["combined"]) for r in score.best_of_variants(s).collect()}
    assert got == {7: (1.0, 1.0, 0.6), 8: (0.0, 0.0, 0.0)}


def model_scores(texts, variants, fetch_k, alpha=0.6):
    """Zero-filled vectors and min-max, a row at a time."""
    import hashlib
    import re
    from collections import Counter

    tok = lambda t: re.findall(r"\w+", t.lower())

    def vec(t):
        v = [0.0] * 64
        for w in tok(t):
            v[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 64] += 1
        norm = math.sqrt(sum(x * x for x in v))
        return [x / norm for x in v] if norm else v

    docs = [Counter(tok(t)) for t in texts]
    n, avgdl = len(texts), sum(sum(d.values()) for d in docs) / len(texts)
    df = Counter(t for d in docs for t in d)
    raw = {t: math.log(n - k + 0.5) - math.log(k + 0.5) for t, k in df.items()}
    idf = {t: v if v >= 0 else 0.25 * sum(raw.values()) / len(raw) for t, v in raw.items()}

    def scale(x):
        lo, hi = min(x), max(x)
        return [(v - lo) / (hi - lo) for v in x] if hi - lo > 1e-9 else x

    best = [[0.0, 0.0, 0.0] for _ in texts]
    for v in variants:
        dots = [sum(a * b for a, b in zip(vec(v), vec(t), strict=True)) for t in texts]
        keep = set(sorted(range(n), key=lambda i: (-round(dots[i], 12), i))[:fetch_k])
        dense = scale([d if i in keep else 0.0 for i, d in enumerate(dots)])
        bm = scale([sum(idf[t] * d[t] * 2.5 / (d[t] + 1.5 * (0.25 + 0.75 * sum(d.values()) / avgdl)) for t in tok(v) if t in d) for d in docs])
        for i in range(n):
            for k, x in enumerate((dense[i], bm[i], alpha * dense[i] + (1 - alpha) * bm[i])):
                best[i][k] = max(best[i][k], x)
    return best


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(6)
    texts = [" ".join(r.choice("title heading model training network data the of result score".split()) for _ in range(r.randrange(1, 25))) for _ in range(40)]
    return texts, index.build(chunk_rows(spark, texts, source=[f"s{i % 3}" for i in range(40)], pages=[i // 6 + 1 for i in range(40)]))


def test_hybrid_equals_a_model(spark, corpus):
    texts, ix = corpus
    q = spark.createDataFrame([(1, "the modle of training"), (2, "summary of everything in the title")], "query_id long, raw string")
    found, analysed = retrieve.retrieve(q, ix, top_k=2)
    rows = found.orderBy("query_id", "rank").collect()
    for query_id, corrected, broad in ((1, "the model of training", False), (2, "summary of everything in the title", True)):
        variants = spark.createDataFrame([(corrected,)], "c string").select(retrieve_variants("c").alias("v")).first()["v"]
        best = model_scores(texts, variants, 30 if broad else 20)
        order = sorted(range(40), key=lambda i: (-round(best[i][2], 9), -i))
        seen, first, later = set(), [], []
        for i in order:
            key = i % 3 if broad else (i % 3, i // 6 + 1)
            (later if key in seen else first).append(i)
            seen.add(key)
        want = (first + later)[: 6 if broad else 2]
        mine = [r for r in rows if r["query_id"] == query_id]
        assert [r["chunk_ix"] for r in mine] == want
        for r in mine:
            assert (r["vector_score"], r["bm25_score"], r["final_score"]) == pytest.approx(tuple(best[r["chunk_ix"]]), abs=1e-4)
        assert {r["corrected_query"] for r in mine} == {None if broad else corrected}


def retrieve_variants(c):
    from lodestone.functions.questions import variants

    return variants(F.col(c))


def test_a_batch_equals_one_by_one(spark, corpus):
    _, ix = corpus
    rows = [(1, "title of the data"), (2, "full summary"), (3, "page 2"), (4, "page 0 model")]
    key = lambda df: sorted(tuple(r) for r in df.collect())
    whole = key(retrieve.retrieve(spark.createDataFrame(rows, "query_id long, raw string"), ix)[0])
    single = sorted(x for r in rows for x in key(retrieve.retrieve(spark.createDataFrame([r], "query_id long, raw string"), ix)[0]))
    assert whole == single


def test_a_negative_product_in_the_top_ranks_below_chunks_outside(spark):
    """Retained negatives score less than the constant of all other chunks, which then come first."""
    texts = ["zzz"] * 12
    vectors = spark.createDataFrame([(i, [1.0, 0.0] if i == 0 else [-0.5, 0.1 * i]) for i in range(12)], "chunk_ix long, embedding array<double>")
    chunks = chunk_rows(spark, texts, source=[f"s{i % 2}" for i in range(12)], pages=[i // 4 + 1 for i in range(12)])
    ix = index.build(chunks, vectors, keep=False)
    one = lambda df: df.select(*score.KEYS, F.array(F.lit(1.0), F.lit(0.0)).alias("embedding"))
    q = spark.createDataFrame([(1, "word")], "query_id long, raw string").withColumns({"corrected": F.col("raw"), "was_changed": F.lit(False), "intent": F.lit("specific"), "page_num": F.lit(None).cast("int")})
    got = [r["chunk_ix"] for r in retrieve.hybrid_retrieve(q, ix, top_k=1, embed=one).orderBy("rank").collect()]
    assert got == [0]
    deep = q.withColumn("fetch_k", F.lit(3))
    hits, rest = retrieve.hybrid_scores(deep, ix, 3, embed=one)
    for k in (2, 9):
        for by in (["source"], ["source", "page"]):
            rows = retrieve.ranking_rows(hits, rest, q.select("query_id"), chunks, by, k)
            got = [r["chunk_ix"] for r in rank.diversified(rows, chunks, by, k).orderBy("rank").collect()]
            whole = rank.diversified(score.of_all_chunks(hits, rest, chunks), chunks, by, k)
            assert got == [r["chunk_ix"] for r in whole.orderBy("rank").collect()], (k, by)


def test_unheld_chunks_rank_as_in_the_whole_grid(spark):
    r = random.Random(9)
    chunks = chunk_rows(spark, ["t"] * 60, source=[f"s{r.randrange(4)}" for _ in range(60)], pages=[r.randrange(1, 9) for _ in range(60)])
    for seed in range(2):
        r = random.Random(seed)
        hits = spark.createDataFrame([(1, c, 0.0, 0.0, round(0.3 + r.random() / 2, 2)) for c in r.sample(range(60), r.randrange(1, 30))], "query_id long, chunk_ix long, dense double, bm25 double, combined double")
        rest = spark.createDataFrame([(1, 0.0, 0.0, 0.4 if seed % 2 else 0.3)], "query_id long, dense double, bm25 double, combined double")
        asked = rest.select("query_id")
        for k in (3, 8, 40):
            for by in (["source"], ["source", "page"]):
                got = rank.diversified(retrieve.ranking_rows(hits, rest, asked, chunks, by, k), chunks, by, k).orderBy("rank").collect()
                want = rank.diversified(score.of_all_chunks(hits, rest, chunks), chunks, by, k).orderBy("rank").collect()
                assert [x["chunk_ix"] for x in got] == [x["chunk_ix"] for x in want], (seed, k, by)


def test_thousands_of_variants_are_one_plan(spark, corpus):
    texts, ix = corpus
    words = "title heading model training network data the of result score".split()
    r = random.Random(12)
    rows = [(i, " ".join(r.choice(words) for _ in range(4))) for i in range(500)]
    q = spark.createDataFrame(rows, "query_id long, raw string")
    found, analysed = retrieve.retrieve(q, ix, top_k=1)
    got = {}
    for x in found.where("rank = 1").collect():
        got[x["query_id"]] = x["chunk_ix"]
    variants = {x["query_id"]: x["v"] for x in analysed.select("query_id", retrieve_variants("corrected").alias("v")).collect()}
    assert sum(map(len, variants.values())) > 3000 and len(got) == 500
    for i in (0, 77, 499):
        best = model_scores(texts, variants[i], 10)
        assert got[i] == max(range(40), key=lambda c: (round(best[c][2], 9), c))


def test_nearest_in_blocks_equals_brute_force(spark, monkeypatch):
    r = random.Random(3)
    x = [[r.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(3)] for _ in range(90)]
    v = spark.createDataFrame([(i, e) for i, e in enumerate(x)], "chunk_ix long, embedding array<double>").repartition(3)
    q = spark.createDataFrame([(i, 0, x[i]) for i in range(0, 90, 7)], "query_id long, variant_ix int, embedding array<double>")
    dot = lambda a, b: sum(p * s for p, s in zip(a, b, strict=True))
    for vectors, queries in ((4096, 512), (8, 2)):
        monkeypatch.setattr(score, "VECTOR_BLOCK", vectors)
        monkeypatch.setattr(score, "QUERY_BLOCK", queries)
        got = {}
        for row in score.dense_top(q, v, 5).orderBy("r").collect():
            got.setdefault(row["query_id"], []).append(row["chunk_ix"])
        assert got == {i: sorted(range(90), key=lambda c: (-dot(x[i], x[c]), c))[:5] for i in range(0, 90, 7)}
    assert score.nearest(q, v.limit(0), 5).count() == 0


def test_nearest_by_groups_equals_brute_force(spark, monkeypatch):
    r = random.Random(5)
    x = [[r.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(4)] for _ in range(600)]
    dot = lambda a, b: sum(p * s for p, s in zip(a, b, strict=True))
    for name, n in (("VECTOR_BLOCK", 64), ("QUERY_BLOCK", 16), ("STRIP", 5), ("HELD_ROWS", 50)):
        monkeypatch.setattr(score, name, n)
    for groups in (2, 40):
        v = spark.createDataFrame([(i, e, i % groups) for i, e in enumerate(x)], "chunk_ix long, embedding array<double>, page int").repartition(3)
        q = v.where("chunk_ix % 17 = 0").select(F.col("chunk_ix").alias("query_id"), F.lit(0).alias("variant_ix"), "embedding")
        found = score.nearest(q, v, 9, F.col("page").cast("long"), small_first=False).withColumn("combined", F.col("raw"))
        placed = found.join(v.select("chunk_ix", "page"), "chunk_ix")
        got = {}
        for row in rank.spread(placed, ["page"], 9).orderBy("rank").collect():
            got.setdefault(row["query_id"], []).append(row["chunk_ix"])
        assert len(got) == 36
        for i, ids in got.items():
            order = sorted(range(600), key=lambda c: (-dot(x[i], x[c]), -c))
            heads = list({c % groups: c for c in reversed(order)}.values())
            late = {c: c not in heads for c in order}
            assert ids == sorted(order, key=lambda c: late[c])[:9]


def test_nearest_ranks_only_what_counts(spark, monkeypatch):
    """Of a pair of blocks, products that can't be among the first are left out before any is ranked."""
    best = score._best

    def few(query, *more):
        assert len(query) <= 20_000
        return best(query, *more)

    monkeypatch.setattr(score, "_best", few)
    v = spark.range(0, 4096, 1, 1).select(F.col("id").alias("chunk_ix"), F.array(*[F.sin(F.col("id") * k) for k in range(1, 9)]).alias("embedding"))
    q = v.where("chunk_ix % 16 = 0").select(F.col("chunk_ix").alias("query_id"), F.lit(0).alias("variant_ix"), "embedding")
    for groups in (4, 64):
        found = score.nearest(q, v, 25, F.col("chunk_ix") % groups, small_first=False)
        assert found.groupBy("query_id").count().where("count >= 25").count() == 256


def test_a_saved_index_is_reused(spark, corpus, tmp_path):
    texts, ix = corpus
    made = []

    def make():
        made.append(1)
        return ix

    first = index.reused(spark, str(tmp_path), "abc", make)
    again = index.reused(spark, str(tmp_path), "abc", make)
    assert made == [1] and again.n == 40 and again.avgdl == first.avgdl
    q = spark.createDataFrame([(1, "title of the data")], "query_id long, raw string")
    rows = lambda i: sorted(map(str, retrieve.retrieve(q, i)[0].collect()))
    assert rows(again) == rows(ix)


def test_vectors_of_a_model_get_unit_length(spark):
    v = hooks.embed(spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k int, text string"), hooks.stub_embed(6), keys=["k"])
    assert all(abs(sum(x * x for x in r["embedding"]) - 1) < 1e-6 for r in v.collect())


def test_models_load_once_a_process(spark, tmp_path):
    import os
    import uuid

    at = str(tmp_path)

    def load():
        open(os.path.join(at, f"{os.getpid()}-{uuid.uuid4().hex}"), "w").close()
        return lambda texts: ["x"] * len(texts)

    df = spark.range(40).select(F.col("id").cast("string").alias("prompt")).repartition(16)
    assert hooks.answer(df, load).where("answer = 'x'").count() == 40
    assert hooks.answer(df, load).count() == 40
    loads = [n.split("-")[0] for n in os.listdir(at)]
    assert len(loads) == len(set(loads)) > 0


def test_pdf_hook_to_chunks(spark):
    content = b"First line. It goes on.\n| a | b |\n| 1 | 2 |\fSecond page."
    files = spark.createDataFrame([("d.pdf", bytearray(content)), ("bad.pdf", None)], "source string, content binary")
    pages = hooks.pdf(files, keys=["source"])
    assert pages.where("source = 'bad.pdf'").first()["page"] is None
    text = extract.block_text(hooks.blocks_of(pages, ["source"]))
    whole = extract.assemble(text, extract.page_tables(hooks.tables_of(pages, ["source"])))
    got = {r["page"]: r["text"] for r in whole.collect()}
    assert got == {1: "First line. It goes on.\n\n\n[TABLE]\n| a | b |\n| - | - |\n| 1 | 2 |\n[/TABLE]", 2: "Second page."}
    assert chunk.chunk_pages(whole).count() == 2


def test_a_single_page_source_returns_everything():
    assert rank.depth("specific", 50, 3, True, 2) == (50, 50)
    assert rank.depth("specific", 50, 3, True, 2, strict_top_k=True) == (20, 2)
    assert rank.depth("broad", 50, 3, False, 2) == (30, 6)
    assert rank.depth("specific", 0, 0, False, 2) == (1, 2)


def test_depths_of_rows_equal_the_policy(spark):
    rows = [(i, n, s, one, k) for i in ("broad", "specific") for n in (0, 7, 90, 2000) for s in (1, 4) for one in (False, True) for k in (2, 8)]
    df = spark.createDataFrame(rows, "i string, n long, s long, one boolean, k long")
    got = df.select("*", *rank.depths(*(F.col(c) for c in df.columns))).collect()
    assert [tuple(r)[5:] for r in got] == [rank.depth(*r) for r in rows]


def test_ties_rank_by_larger_index_and_nothing_is_lost(spark):
    chunks = chunk_rows(spark, ["t"] * 6, source=list("aabbcc"), pages=[1] * 6)
    s = chunks.select(F.lit(1).alias("query_id"), "chunk_ix", F.lit(0.5).alias("combined"))
    got = [r["chunk_ix"] for r in rank.diversified(s, chunks, ["source"], 6).orderBy("rank").collect()]
    assert got == [5, 3, 1, 4, 2, 0]
    assert [r["chunk_ix"] for r in rank.ranked(s).orderBy("rank").collect()] == [5, 4, 3, 2, 1, 0]


def test_vectors_of_one_dimension_only(spark):
    with pytest.raises(ValueError):
        index.check_dimension(spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "embedding array<double>"))


# --------------------------------------------------------------------- answers


def result_rows(spark, texts):
    return spark.createDataFrame([(1, i + 1, "s", i + 1, t) for i, t in enumerate(texts)], "query_id long, rank int, source string, page int, text string")


@pytest.mark.parametrize("lengths, want", [([6950, 200], [6950]), ([6800, 400], [6800, 200]), ([7000, 5], [7000]), ([6899, 500, 10], [6899, 101]), ([9000], [7000])])
def test_broad_budget(spark, lengths, want):
    context = answer.broad_context(result_rows(spark, ["x" * n for n in lengths])).first()["context"]
    assert [len(p.split("\n", 1)[1]) for p in context.split("\n\n")] == want


def test_broad_order_and_specific_cut(spark):
    rows = spark.createDataFrame([(1, 1, "b", 1, "B"), (1, 2, "a", 2, "A2"), (1, 3, "a", 1, "x" * 2000)], "query_id long, rank int, source string, page int, text string")
    assert answer.broad_context(rows).first()["context"].startswith("[SOURCE: a | Page 1]\nxxx")
    assert answer.specific_context(rows).first()["context"] == "[SOURCE: b | Page 1]\nB\n\n[SOURCE: a | Page 2]\nA2\n\n[SOURCE: a | Page 1]\n" + "x" * 1500


def test_clean_stream_and_fallback(spark):
    a = spark.createDataFrame([(1, "use `x` now, `")], "query_id long, answer string")
    q = spark.createDataFrame([(1,), (2,)], "query_id long")
    got = {r["query_id"]: r["answer"] for r in answer.with_fallback(q, a).collect()}
    assert got == {1: "use x now, `", 2: answer.NO_RESULT}
    assert [r["piece"] for r in answer.word_stream(a.withColumn("answer", F.lit("a  b"))).orderBy("position").collect()] == ["a ", " ", "b "]


def test_ask_from_question_to_answer(spark, corpus):
    _, ix = corpus
    q = spark.createDataFrame([(1, "title of the data"), (2, "page 77")], "query_id long, raw string")
    got = {r["query_id"]: r["answer"] for r in retrieve.ask(q, ix).collect()}
    assert got[2] == answer.NO_RESULT and got[1] != answer.NO_RESULT


def test_notices_and_log(spark):
    q = spark.createDataFrame([(1, "x", "y", True, "broad", None), (2, "x", "x", False, "broad", 3)], "query_id long, raw string, corrected string, was_changed boolean, intent string, page_num int")
    got = {r["query_id"]: (r["corrected_notice"], r["broad_notice"] is not None) for r in answer.notices(q).collect()}
    assert got == {1: ("Query corrected: y", True), 2: (None, False)}
    log = answer.chat_log(spark.createDataFrame([("s", 0, 1, "q1"), ("s", 1, 2, "q2")], "session_id string, query_no long, query_id long, raw string"), spark.createDataFrame([(1, "a1")], "query_id long, answer string"))
    assert [tuple(r) for r in log.orderBy("session_id", "turn").collect()] == [("s", 0, "user", "q1"), ("s", 1, "assistant", "a1"), ("s", 2, "user", "q2")]


def test_saved_tables_keep_their_rows(spark):
    assert saved(spark.range(5), "t").count() == 5
