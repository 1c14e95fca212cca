"""The pipeline and the registered queries."""

import hashlib
import struct

from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import bpe, decontaminate, jaccard, pii, quality
from lodestone.llm.queries import ORACLE_SQL, QUERIES, tokenizer_path
from tests.conftest import SF


def test_stages_judge_their_input_and_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.train(docs, labels)
    scores = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "decontamination", "private_data", "bpe"]
    stage = dict(corpus_pipeline.STAGES)

    one = stage["quality"](spark, docs, SF)
    assert one.columns == columns and {r["doc_id"] for r in one.collect()} == {d for d, s in scores.items() if s >= 0.5}
    two = stage["near_duplicates"](spark, one.union(one.limit(5)), SF)
    kept = {r["doc_id"] for r in jaccard.join(one).where("kept").collect()}
    assert two.columns == columns and sorted(r["doc_id"] for r in two.collect()) == sorted(kept)
    three = stage["decontamination"](spark, docs, SF)
    bad = decontaminate.search(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).where("size(hit_spans) > 0")
    assert three.columns == columns and three.count() == docs.count() - bad.count()
    four = stage["private_data"](spark, docs, SF)
    assert four.columns == columns and four.count() == docs.count()
    for r in four.collect():
        assert r["n_chars"] == len(r["text"]) and not any(pii.base_spans(r["text"])[k] for k in ("email", "ip"))
    five = stage["bpe"](spark, docs, SF)
    assert five.count() == docs.count()


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert 0 < out.count() < 200 and "ids" in out.columns


def test_stages_take_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_stages_take_nulls(spark):
    docs = spark.createDataFrame([(None, None, None, None, None), (1, None, "en", "s", None), (2, "", None, None, 0)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == (3 if name != "quality" else stage(spark, docs, SF).count())


def test_stages_take_long_texts_and_clashing_columns(spark):
    import random

    r = random.Random(1)
    long = " ".join(f"w{r.randrange(4000)}" for _ in range(200_000))
    mail = "mail a.b@c.example.com and ip 10.0.0.1 "
    rows = [(1, long, "en", "s", 1), (2, long + " end", "en", "s", 2), (3, mail * 20_000, "en", "s", 3), (4, "x" * 2_000_000, "en", "s", 4), (5, "1" * 1_000_000, "en", "s", 5), (6, "short text", "en", "s", 6), (6, "short text", "en", "s", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    own = ["score", "hit_spans", "n_words", "item_ids", "spans", "kept", "key", "tkey", "cls", "comp", "block", "c0", "digest", "labels"]
    docs = docs.select("*", *[F.concat(F.lit(f"{c} of "), F.col("doc_id").cast("string")).alias(c) for c in own])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        got = out.collect()
        assert all(x[c] == f"{c} of {x['doc_id']}" for x in got for c in own), name
        if name == "near_duplicates":
            assert sorted(x["doc_id"] for x in got) == [1, 3, 4, 5, 6]
        if name == "decontamination":
            assert len(got) == 7
        if name == "private_data":
            text = {x["doc_id"]: x["text"] for x in got}
            assert text[3] == "mail [email] and ip [ip] " * 20_000 and text[1] == long and text[5] == rows[4][1]
            assert all(x["n_chars"] == len(x["text"]) for x in got)
    ids = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {x["doc_id"]: x["n_tokens"] for x in ids}[1] > 200_000


def test_digest_columns(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in QUERIES["op1_bpe"](spark, SF).collect():
        ids = tok.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    for r in QUERIES["op4_weak_supervision"](spark, SF).collect():
        base = pii.base_spans(texts[r["doc_id"]])
        listed = ",".join(f"{k}:{s}:{e}" for k in pii.KINDS for s, e in base[k])
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [len(base[k]) for k in pii.KINDS]


def test_thirteen_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLE_SQL) <= set(QUERIES)
    assert bpe.CACHE_BYTES > 0
