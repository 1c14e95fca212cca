"""Indexes that grow by segments, files and chat messages that arrive as streams, counts observed on the way."""

import threading

import pytest
from pyspark.sql import functions as F

from lodestone.operators import index, progress, rank, segments
from lodestone.operators.chunk import chunk_pages, indexed_chunks
from lodestone.plans import retrieve
from lodestone.sources import documents as src
from lodestone.sources.shared import list_folder
from lodestone.streaming import chat, files, ingest


def pages(spark, *rows):
    return spark.createDataFrame(list(rows), "source string, page int, text string")


FIRST = [("a", 1, "alpha beta. gamma data."), ("a", 2, "the alpha of the page"), ("b", 1, "old words here")]
SECOND = [("c", 1, "beta beta delta"), ("b", 1, "the new words. of b")]


def relations(ix):
    """What the index says, whatever its chunks' numbers."""
    place = ix.chunks.select("chunk_ix", "source", "page", "chunk_no", "text")
    post = ix.postings.join(ix.term_stats.select("term", "df", F.round("idf", 9).alias("idf")), "term").join(place, "chunk_ix").drop("chunk_ix")
    return sorted(map(str, post.select(sorted(post.columns)).collect())), (ix.n, round(ix.avgdl, 9), ix.num_sources, ix.has_single_page_source)


def ids(ix):
    return {(r["source"], r["page"], r["chunk_no"]): r["chunk_ix"] for r in ix.chunks.collect()}


def test_segments_equal_one_pass_and_ids_never_move(spark, tmp_path):
    root = str(tmp_path)
    segments.append(pages(spark, *FIRST), root, "1")
    files_before = {e.name: sorted(x.name for x in list_folder(spark, f"{root}/{e.name}")) for e in list_folder(spark, root)}
    before = ids(segments.open_index(spark, root))
    segments.append(pages(spark, *SECOND), root, "2")
    assert segments.append(pages(spark, *SECOND), root, "2") == 2  # a label counts once
    once = index.build(indexed_chunks(pages(spark, *FIRST[:2], *SECOND)))
    grown = segments.open_index(spark, root)
    assert relations(grown) == relations(once)
    after = ids(grown)
    assert {k: v for k, v in after.items() if k[0] == "a"} == {k: v for k, v in before.items() if k[0] == "a"}
    assert all(name in [e.name for e in list_folder(spark, root)] for name in files_before)
    assert segments.compact(spark, root) == 3 and segments.compact(spark, root) == 3
    small = segments.open_index(spark, root)
    assert relations(small) == relations(once) and ids(small) == after
    segments.append(pages(spark, ("d", 1, "alpha again")), root, deleted=["c"])
    last = segments.open_index(spark, root)
    assert relations(last) == relations(index.build(indexed_chunks(pages(spark, *FIRST[:2], SECOND[1], ("d", 1, "alpha again")))))
    found = retrieve.retrieve(spark.createDataFrame([(1, "alpha data of the page"), (2, "page 1")], "query_id long, raw string"), last, top_k=2)[0]
    rows = found.orderBy("query_id", "rank").collect()
    assert [(r["source"], r["page"]) for r in rows if r["query_id"] == 2] == [("a", 1), ("b", 1), ("d", 1)]  # by arrival
    assert len(segments.expire(spark, root, 0.0)) == 2 and relations(segments.open_index(spark, root)) == relations(last)


def test_writers_at_the_same_time_both_commit(spark, tmp_path):
    root, failed = str(tmp_path), []

    def write(k):
        try:
            segments.append(pages(spark, (f"s{k}", 1, f"word{k} shared")), root, f"w{k}")
        except Exception as e:  # shown by the assertion
            failed.append(e)

    writers = [threading.Thread(target=write, args=(k,)) for k in (0, 1)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    m = segments.manifest(spark, root)
    assert not failed and m.version == 2 and sorted(m.labels) == ["w0", "w1"] and [s.no for s in m.segments] == [0, 1]
    assert segments.open_index(spark, root).n == 2


def test_empty_batches_and_sources_without_text(spark, tmp_path):
    root = str(tmp_path)
    with pytest.raises(ValueError):
        segments.open_index(spark, root)
    segments.append(pages(spark, *FIRST), root)
    segments.append(pages(spark, ("b", 1, " ")), root)  # replaced by nothing
    segments.append(pages(spark).limit(0), root)
    ix = segments.open_index(spark, root)
    assert relations(ix) == relations(index.build(indexed_chunks(pages(spark, *FIRST[:2]))))


def test_a_stream_of_pages_grows_an_index(spark, tmp_path):
    at, root = f"{tmp_path}/in", f"{tmp_path}/index"
    for rows in (FIRST, SECOND):
        pages(spark, *rows).write.mode("append").parquet(at)
        stream = spark.readStream.schema("source string, page int, text string").parquet(at)
        ingest.append_segments(stream, root, f"{tmp_path}/check").awaitTermination()
    assert relations(segments.open_index(spark, root)) == relations(index.build(indexed_chunks(pages(spark, *FIRST[:2], *SECOND))))


# ------------------------------------------------------------------------ files


def read_text(todo):
    return todo.select("doc_md5", F.lit(1).alias("page"), F.decode("content", "UTF-8").alias("text")).where("trim(text) <> ''")


def test_arriving_files_are_extracted_once(spark, tmp_path):
    at, cache = tmp_path / "in", f"{tmp_path}/cache"
    at.mkdir()
    extracted = []

    def extract(todo):
        extracted.extend(sorted(r["name"] for r in todo.collect()))
        return read_text(todo)

    batches = [{"a.txt": "one", "b.txt": "two", "e.txt": " "}, {"c.txt": "one"}, {"d.txt": "three", "f.txt": "two"}]
    for batch in batches:
        for name, text in batch.items():
            (at / name).write_text(text)
        files.ingest_files(src.stream_files(spark, str(at), "*.txt"), cache, f"{tmp_path}/check", extract).awaitTermination()
    want = {("a.txt", "one"), ("b.txt", "two"), ("c.txt", "one"), ("d.txt", "three"), ("f.txt", "two")}
    got = lambda: sorted((r["source"], r["text"]) for r in files.pages_of(spark, cache).collect())
    assert got() == sorted(want) and extracted == ["a.txt", "b.txt", "e.txt", "d.txt"]
    # a batch that fails after its pages are written runs again, and replaces what it wrote
    last = src.read_files(spark, str(at), "[df].txt")
    files.commit(last, 2, cache, extract)
    assert got() == sorted(want) and extracted[4:] == ["d.txt"]
    # the same name with other content means that content from then on
    (at / "g.txt").write_text("four")
    changed = src.read_files(spark, str(at), "g.txt").withColumn("name", F.lit("a.txt"))
    files.commit(changed, 3, cache, extract)
    assert ("a.txt", "four") in got() and ("a.txt", "one") not in got() and ("c.txt", "one") in got()


def test_the_cache_is_safe_to_repeat(spark, tmp_path):
    rows = spark.createDataFrame([("0a", 1, "x"), ("0a", 2, "y"), ("1b", None, None)], "doc_md5 string, page int, text string")
    other = rows.where("doc_md5 = '0a'").unionByName(spark.createDataFrame([("2c", 1, "z")], rows.schema))
    for batch in (rows, rows, other):
        src.write_cache(batch, f"{tmp_path}/cache")
    assert sorted((r["doc_md5"], r["page"] or 0) for r in src.read_cache(spark, f"{tmp_path}/cache").collect()) == [("0a", 1), ("0a", 2), ("1b", 0), ("2c", 1)]


# ------------------------------------------------------------------------- chat


def test_turns_are_numbered_across_batches_and_late_ones_marked(spark, tmp_path):
    at = f"{tmp_path}/in"
    batches = [[("s", 20, 2, "second"), ("s", 10, 1, "first"), ("t", 5, 9, "other")], [("s", 30, 4, "fourth"), ("s", 15, 3, "late")], [("t", 6, 10, "more"), ("s", 30, 5, "same time")]]
    for batch in batches:
        spark.createDataFrame(batch, "session_id string, sent long, query_id long, raw string").coalesce(1).write.mode("append").parquet(at)
        arriving = spark.readStream.schema("session_id string, sent long, query_id long, raw string").parquet(at)
        chat.log_turns(arriving, F.concat(F.lit("re "), "raw"), f"{tmp_path}/log", f"{tmp_path}/check").awaitTermination()
        numbered = chat.numbered_questions(arriving).writeStream.format("parquet").option("path", f"{tmp_path}/n").option("checkpointLocation", f"{tmp_path}/check2").trigger(availableNow=True).start()
        numbered.awaitTermination()
    log = sorted((r["session_id"], r["turn"], r["role"], r["content"]) for r in spark.read.parquet(f"{tmp_path}/log").collect())
    asked = [("s", k, c) for k, c in enumerate(["first", "second", "late", "fourth", "same time"])] + [("t", 0, "other"), ("t", 1, "more")]
    assert log == sorted(x for s, k, c in asked for x in ((s, 2 * k, "user", c), (s, 2 * k + 1, "assistant", f"re {c}")))
    late = {r["raw"]: r["late"] for r in spark.read.parquet(f"{tmp_path}/n").collect()}
    assert [r for r, x in late.items() if x] == ["late"] and len(late) == 7


# --------------------------------------------------------------------- progress


def test_counts_are_observed_in_one_pass(spark, tmp_path):
    rows = pages(spark, ("a", 1, "x y"), ("a", 2, " "), ("b", 1, None)).withColumn("hook_error", F.when(F.col("source") == "b", "broken"))
    seen, counts = progress.observed(rows, "hook_error")
    chunk_pages(seen).write.parquet(f"{tmp_path}/out")
    assert counts.get == {"done": 3, "blank": 2, "chars": 4, "failed": 1}


def test_a_stream_tells_its_progress(spark, tmp_path):
    heard = progress.Progress(total=4)
    spark.streams.addListener(heard)
    try:
        for rows in ([("a", 1, "x y")], [("a", 2, " "), ("b", 1, "zz")]):
            pages(spark, *rows).write.mode("append").parquet(f"{tmp_path}/in")
            stream = spark.readStream.schema("source string, page int, text string").parquet(f"{tmp_path}/in")
            ingest.append_chunks(progress.observed(stream)[0], f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(heard)
    assert heard.counts() == {"done": 3, "blank": 1, "chars": 6, "failed": 0} and heard.share() == 0.75


def test_page_lookup_follows_the_order_of_arrival(spark, tmp_path):
    root = str(tmp_path)
    for k, source in enumerate(["z", "m", "a"]):
        segments.append(pages(spark, (source, 1, f"text {k}"), (source, 2, "more")), root)
    ix = segments.open_index(spark, root)
    asked = spark.createDataFrame([(1, 1, "x", False)], "query_id long, page_num int, corrected string, was_changed boolean")
    assert [r["source"] for r in rank.page_lookup(asked, ix.chunks).orderBy("rank").collect()] == ["z", "m", "a"]


def test_a_batch_reads_contents_twice(spark, tmp_path):
    """Once for their hash, once to be extracted."""
    read = spark.sparkContext.accumulator(0)

    def content(x):
        read.add(1)
        return x

    one = F.udf(content, "binary").asNondeterministic()
    raw = spark.createDataFrame([(f"/in/f{i}", bytearray(f"text {i % 8}".encode() if i else b"")) for i in range(20)], "path string, c binary")
    named = src.named(raw.select("path", one("c").alias("content")))
    extract = lambda f: f.where("length(content) > 0").select("doc_md5", F.lit(1).alias("page"), F.decode("content", "UTF-8").alias("text"))
    for _ in range(2):
        before = read.value
        files.commit(named, 0, f"{tmp_path}/cache", extract)
        assert read.value - before <= 40
        got = sorted((r["source"], r["text"]) for r in files.pages_of(spark, f"{tmp_path}/cache").collect())
        assert got == sorted((f"f{i}", f"text {i % 8}") for i in range(1, 20))
        held = spark.read.parquet(f"{tmp_path}/cache/pages/batch=0")
        assert held.count() == 9 and held.where("page IS NULL").count() == 1
