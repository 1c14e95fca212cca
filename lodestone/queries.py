"""The registered queries of the retrieval engine and their SQL equivalents.

Keys begin with the operator's ID in the blueprint. Plain text tables stand in for
PDFs: `documents` are pages (source, running number, text).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import questions as qf
from lodestone.functions.lexicon import BARE_TRIGGERS, BROAD_PHRASES, STOP_WORDS, SYNONYMS, TYPOS
from lodestone.functions.tables import is_ragged, to_markdown
from lodestone.functions.text import sentences, tokens, word_count
from lodestone.operators import answer, chunk, dense, extract, hooks, index, layout, progress, rank, scan, score, segments
from lodestone.plans import retrieve
from lodestone.sources import documents as src
from lodestone.sources.shared import listing, numbered, put_file, saved, spread_small, work_dir
from lodestone.streaming import chat, files, ingest

# ------------------------------------------------------------------- test input

QUESTIONS: list[tuple[int, str]] = [
    (1, "what is the heading"),
    (2, "Summarize the document"),
    (3, "(Retreival?) modle performance of  the training"),
    (4, "overview of the and that"),
    (5, "Show allocation of the result, en que la"),
    (6, "page 3"),
    (7, "last page"),
    (8, "First page please"),
    (9, "webpage 12 title"),
    (10, "page 0 of the dataset"),
    (11, "RETREIVAL retreival-2 reTreival"),
    (12, "summarize this pdf"),
    (13, "the der que and"),
    (14, "summarized results, of evaluation!"),
    (15, "certifications  and skils"),
    (16, "What optimizer was used for training?"),
]

def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    return spread_small(df) if name == "documents" else df


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return src.pages_of_documents(_table(spark, sf, "documents"))


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunk.indexed_chunks(pages(spark, sf))


def asked(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(QUESTIONS, "query_id long, raw string")


def built(spark: SparkSession, sf: str) -> index.Index:
    """The index of sf's documents: built once for the same names and contents, then reused."""
    files = _table(spark, sf, "documents").select(F.concat_ws("/", "source", "doc_id").alias("name"), F.md5(F.encode("text", "UTF-8")).alias("doc_md5"))
    name = index.key(src.fingerprint(files).first()["fingerprint"], chunk_words=chunk.CHUNK_WORDS, overlap_words=chunk.OVERLAP_WORDS, embedder="hashed")
    root = f"{work_dir(spark)}/lodestone/indexes"
    return index.reused(spark, root, name, lambda: index.build(chunks(spark, sf), path=f"{root}/{name}-{uuid.uuid4().hex}"))


def all_questions(spark: SparkSession, sf: str) -> DataFrame:
    """The literal questions and every user turn."""
    return asked(spark).unionByName(_table(spark, sf, "conversations").where("role = 'user'").select((F.lit(1000) + F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("raw")))


def blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of documents as page blocks: the side by the line's hash, y by its number."""
    lines = _table(spark, sf, "documents").select("source", F.col("doc_id").alias("page"), F.posexplode(F.split("text", "\n")).alias("block_ix", "text"))
    odd = F.conv(F.substring(F.md5(F.encode("text", "UTF-8")), 1, 1), 16, 10).cast("int")
    x0 = F.when(odd < 8, 10.0).when(odd < 12, 47.0).otherwise(60.0)
    x0 = F.when(F.col("page") % 3 == 0, 10.0).otherwise(x0)
    return lines.select("source", "page", F.lit(100.0).alias("page_width"), x0.alias("x0"), (F.col("block_ix") % 7).cast("double").alias("y0"), "block_ix", "text")


def cells(spark: SparkSession, sf: str) -> DataFrame:
    """region's nations as tables, a page each."""
    rows = _table(spark, sf, "nation").select("n_regionkey", "n_nationkey", F.array(F.col("n_nationkey").cast("string"), "n_name").alias("r"))
    packed = rows.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "r"))).alias("rs"))
    head = F.array(F.array(F.lit("key"), F.lit("name")))
    return packed.select(F.lit("nation").alias("source"), F.col("n_regionkey").alias("page"), F.lit(0).alias("table_ix"), F.concat(head, F.transform("rs", lambda x: x["r"])).alias("cells"))


# ------------------------------------------------------------ SQL building blocks


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_STRIP = lambda c: f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"
_PAGES = "pages AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page, text FROM documents)"
_SENTS = f"""sents AS (SELECT source, page, list_filter(string_split(regexp_replace({_STRIP('text')}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s : s <> '') AS s FROM pages),
wide AS (SELECT source, page, s, list_transform(s, lambda x : len(list_filter(string_split_regex(x, '\\s+'), lambda y : y <> ''))) AS w FROM sents WHERE len(s) > 0)"""
_CHUNKS = f"""{_PAGES}, {_SENTS},
walk AS (
  SELECT source, page, w, 0 AS i, 0 AS lo, w[1] AS cur, CAST(NULL AS BIGINT) AS elo, CAST(NULL AS BIGINT) AS ehi FROM wide
  UNION ALL
  SELECT source, page, w, i + 1, CASE WHEN emit THEN i + 1 - n ELSE lo END,
    CASE WHEN emit THEN coalesce(list_sum(w[i + 2 - n:i + 1]), 0) + w[i + 2] ELSE cur + w[i + 2] END,
    CASE WHEN emit THEN lo END, CASE WHEN emit THEN i END
  FROM (SELECT *, cur + w[i + 2] > 200 AND i + 1 > lo AS emit,
    len(list_filter(range(1, least(30, i + 1 - lo) + 1), lambda k : list_sum(w[i + 2 - k:i + 1]) <= 30)) AS n
    FROM walk WHERE i + 1 < len(w))
),
cut AS (SELECT source, page, elo AS lo, ehi AS hi FROM walk WHERE elo IS NOT NULL UNION ALL SELECT source, page, lo, i FROM walk WHERE i + 1 = len(w)),
chunks AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY source, page, hi) - 1 AS chunk_ix, source, page, CAST(row_number() OVER (PARTITION BY source, page ORDER BY hi) - 1 AS INTEGER) AS chunk_no,
    array_to_string(s[lo + 1:hi + 1], ' ') AS text, CAST(list_sum(w[lo + 1:hi + 1]) AS INTEGER) AS n_words, CAST(lo AS INTEGER) AS first_sentence, CAST(hi AS INTEGER) AS last_sentence
  FROM cut JOIN wide USING (source, page)
)"""
_TOKENS = lambda c: f"regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}_]+')"
_INDEX = f"""
toks AS MATERIALIZED (SELECT chunk_ix, {_TOKENS('text')} AS t FROM chunks),
postings AS MATERIALIZED (SELECT term, chunk_ix, count(*) AS tf FROM (SELECT chunk_ix, unnest(t) AS term FROM toks) GROUP BY ALL),
doc_len AS MATERIALIZED (SELECT chunk_ix, len(t) AS dl FROM toks),
corpus AS (SELECT count(*) AS n, sum(dl) / count(*) AS avgdl FROM doc_len),
dfs AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
raws AS MATERIALIZED (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM dfs, corpus),
term_stats AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * mean ELSE raw END AS idf FROM raws, (SELECT avg(raw) AS mean FROM raws))"""
_BUCKET = "CAST(('0x' || substr(md5(tok), 1, 8)) AS BIGINT) % 64"


def _vectors(name: str, source: str, keys: str) -> str:
    return f"""{name}_c AS (SELECT {keys}, {_BUCKET} AS b, count(*) AS c FROM (SELECT {keys}, unnest({_TOKENS('text')}) AS tok FROM {source}) GROUP BY ALL),
{name} AS (SELECT {keys}, b, c / sqrt(sum(c * c) OVER (PARTITION BY {keys})) AS v FROM {name}_c)"""


_Q = "q(query_id, raw) AS (VALUES " + ", ".join(f"({i}, {_lit(t)})" for i, t in QUESTIONS) + ")"
_Q_ALL = "q AS MATERIALIZED (SELECT * FROM (VALUES " + ", ".join(f"({i}, {_lit(t)})" for i, t in QUESTIONS) + ") t(query_id, raw) UNION ALL SELECT 1000 + conv_id * 1000 + turn, text FROM conversations WHERE role = 'user')"
_E = "[.,!?;:''\"()]"
_ANALYSED = f"""{_Q},
typos(typo, target) AS (VALUES {", ".join(f"({_lit(k)}, {_lit(v)})" for k, v in TYPOS.items())}),
qw AS (SELECT query_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT query_id, list_filter(string_split_regex(raw, '\\s+'), lambda x : x <> '') AS ws FROM q)),
qc AS (SELECT *, regexp_replace(regexp_replace(w, '^{_E}+', ''), '{_E}+$', '') AS core, regexp_extract(w, '^{_E}*') AS lead FROM qw),
fx AS (SELECT query_id, i, w, CASE WHEN core <> '' AND NOT (contains(core, '-') OR regexp_matches(core, '^.+\\p{{Lu}}') OR (regexp_matches(core, '\\p{{Lu}}') AND upper(core) = core) OR regexp_matches(core, '\\p{{Nd}}'))
  THEN lead || target || substr(w, len(lead) + len(core) + 1) END AS fix FROM qc LEFT JOIN typos ON typo = lower(core)),
corr AS (SELECT query_id, raw, CASE WHEN count(fix) > 0 THEN string_agg(coalesce(fix, w), ' ' ORDER BY i) ELSE raw END AS corrected FROM q LEFT JOIN fx USING (query_id) GROUP BY query_id, raw),
ints AS (SELECT query_id, raw, corrected, {_STRIP('lower(corrected)')} AS c FROM corr),
analysed AS (SELECT query_id, raw, corrected, corrected <> raw AS was_changed,
  CASE WHEN len(list_filter([{", ".join(map(_lit, BROAD_PHRASES))}], lambda p : contains(c, p))) > 0
    OR len(list_filter([{", ".join(map(_lit, BARE_TRIGGERS))}], lambda t : starts_with(c, t) AND len(list_filter(string_split_regex(regexp_replace(substr(c, len(t) + 1), '^[ .,?!]+|[ .,?!]+$', '', 'g'), '\\s+'), lambda x : x <> '' AND NOT list_contains([{", ".join(map(_lit, STOP_WORDS))}], x))) = 0)) > 0
  THEN 'broad' ELSE 'specific' END AS intent FROM ints)"""
_ANALYSED_ALL = _ANALYSED.replace(_Q, _Q_ALL)
_VARIANTS = f"""lex(word, k, syn) AS (VALUES {", ".join(f"({_lit(k)}, {i}, {_lit(s)})" for k, v in SYNONYMS.items() for i, s in enumerate(v))}),
vw AS (SELECT query_id, ws, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT query_id, list_filter(string_split_regex(lower(corrected), '\\s+'), lambda x : x <> '') AS ws FROM analysed)),
vs AS (SELECT query_id, ws, i, k, syn FROM vw JOIN lex ON word = regexp_replace(regexp_replace(w, '^{_E}+', ''), '{_E}+$', '')),
vr AS (SELECT query_id, 1 AS part, i, k, array_to_string(list_concat(list_concat(ws[1:i - 1], [syn]), ws[i + 1:]), ' ') AS text FROM vs),
vu AS (SELECT query_id, syn, min(i * 100 + k) AS o FROM vs GROUP BY ALL),
va AS (SELECT query_id, 0 AS part, 0 AS i, 0 AS k, corrected AS text FROM analysed UNION ALL SELECT * FROM vr UNION ALL
  SELECT query_id, 2, 0, 0, any_value(corrected) || ' ' || string_agg(syn, ' ' ORDER BY o) FROM vu JOIN analysed USING (query_id) GROUP BY query_id),
vd AS (SELECT query_id, text, min(part * 1000000 + i * 1000 + k) AS o FROM va GROUP BY ALL),
variants AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY o) - 1 AS INTEGER) AS variant_ix, text FROM vd)"""
_PAGE_OF = """CASE WHEN contains(lower(raw), 'last page') AND (SELECT count(DISTINCT source) FROM pages) = 1 THEN (SELECT max(page) FROM pages)
  WHEN contains(lower(raw), 'first page') THEN 1 ELSE TRY_CAST(regexp_extract(lower(raw), 'page\\s*(\\d+)', 1) AS INTEGER) END"""
_SCALE = lambda x: f"CASE WHEN hi - lo > 1e-9 THEN ({x} - lo) / (hi - lo) ELSE {x} END"
_BM25 = """bm AS (
  SELECT query_id, variant_ix, chunk_ix, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS raw
  FROM (SELECT query_id, variant_ix, term, count(*) AS qtf FROM (SELECT query_id, variant_ix, unnest(""" + _TOKENS("text") + """) AS term FROM variants) GROUP BY ALL)
  JOIN postings USING (term) JOIN term_stats USING (term) JOIN doc_len USING (chunk_ix), corpus GROUP BY ALL
)"""
_SCORES = f"""{_vectors('cv', 'chunks', 'chunk_ix')}, {_vectors('qv', 'variants', 'query_id, variant_ix')}, {_BM25},
grid AS (SELECT query_id, variant_ix, chunk_ix, coalesce(d.raw, 0) AS dot, coalesce(bm.raw, 0) AS b
  FROM (SELECT query_id, variant_ix, chunk_ix FROM variants, chunks)
  LEFT JOIN (SELECT query_id, variant_ix, chunk_ix, sum(cv.v * qv.v) AS raw FROM cv JOIN qv USING (b) GROUP BY ALL) d USING (query_id, variant_ix, chunk_ix)
  LEFT JOIN bm USING (query_id, variant_ix, chunk_ix)),
fetched AS (SELECT g.*, intent, CASE WHEN row_number() OVER (PARTITION BY query_id, variant_ix ORDER BY round(dot, 9) DESC, chunk_ix) <= least((SELECT n FROM corpus), CASE WHEN intent = 'broad' THEN 120 ELSE 80 END) THEN dot ELSE 0 END AS d FROM grid g JOIN analysed USING (query_id)),
blend AS (SELECT query_id, chunk_ix, intent, CASE WHEN dx - dm > 1e-9 THEN (d - dm) / (dx - dm) ELSE d END AS dense, CASE WHEN bx - bl > 1e-9 THEN (b - bl) / (bx - bl) ELSE b END AS bm25
  FROM (SELECT *, min(d) OVER v AS dm, max(d) OVER v AS dx, min(b) OVER v AS bl, max(b) OVER v AS bx FROM fetched WINDOW v AS (PARTITION BY query_id, variant_ix))),
best AS (SELECT query_id, chunk_ix, intent, greatest(max(dense), 0) AS dense, greatest(max(bm25), 0) AS bm25, greatest(max(0.6 * dense + 0.4 * bm25), 0) AS combined FROM blend GROUP BY ALL)"""
_RANKED = """nth AS (SELECT best.*, source, page, text, CASE WHEN intent = 'broad' AND (SELECT count(DISTINCT source) FROM chunks) > 1
    THEN row_number() OVER (PARTITION BY query_id, source ORDER BY round(combined, 9) DESC, chunk_ix DESC) ELSE row_number() OVER (PARTITION BY query_id, source, page ORDER BY round(combined, 9) DESC, chunk_ix DESC) END AS k FROM best JOIN chunks USING (chunk_ix)),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY (k > 1), round(combined, 9) DESC, chunk_ix DESC) AS rank FROM nth)"""

RETRIEVE_SQL = f"""WITH RECURSIVE {_CHUNKS}, {_INDEX}, {_ANALYSED}, {_VARIANTS}, {_SCORES}, {_RANKED},
pg AS (SELECT query_id, {_PAGE_OF} AS page_num FROM analysed),
found AS (
  SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_ix, source, page, text, round(dense, 4) AS vector_score, round(bm25, 4) AS bm25_score, round(combined, 4) AS final_score, CASE WHEN was_changed THEN corrected END AS corrected_query
  FROM placed JOIN analysed USING (query_id) JOIN pg USING (query_id)
  WHERE coalesce(page_num, 0) = 0 AND rank <= CASE WHEN placed.intent = 'broad' THEN least((SELECT n FROM corpus), 8 * (SELECT count(DISTINCT source) FROM chunks)) ELSE 8 END
  UNION ALL
  SELECT query_id, CAST(r AS INTEGER), chunk_ix, source, page, text, NULL, NULL, NULL, NULL FROM (
    SELECT query_id, chunks.*, row_number() OVER (PARTITION BY query_id ORDER BY chunk_ix) AS r FROM chunks JOIN pg ON page = page_num WHERE page_num <> 0) WHERE r <= 8
)
"""

# ---------------------------------------------------------------------- queries

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return put


# sources


@query("s1_files_s2_hash", "SELECT n_name || '.txt' AS name, md5(n_name) AS doc_md5 FROM nation")
def s1(spark, sf):
    """Files written from nation's names, read as binary with their hash."""
    at = f"{work_dir(spark)}/lodestone/files-{uuid.uuid4().hex}"
    for r in _table(spark, sf, "nation").select("n_name").collect():  # 25 rows: a fixture
        put_file(spark, f"{at}/{r['n_name']}.txt", r["n_name"].encode())
    return src.read_files(spark, at, "*.txt").select("name", "doc_md5")


def _files(spark, sf):
    """Documents as files, ten names a content: file k of source s holds the text of the source's page."""
    d = _table(spark, sf, "documents")
    return d.select(F.concat(F.lit("file"), F.col("doc_id").cast("string")).alias("name"), F.md5(F.encode("text", "UTF-8")).alias("doc_md5"), F.col("source").alias("path"), F.encode("text", "UTF-8").alias("content"))


_CACHE_SQL = "SELECT 'file' || doc_id AS source, CAST(1 AS INTEGER) AS page, text FROM documents WHERE text <> ''"


@query("s3_cache", _CACHE_SQL)
def s3(spark, sf):
    """Half of the contents cached, the others extracted; every name gets its pages, of which an empty content has none."""
    files = _files(spark, sf)
    read = lambda f: f.select("doc_md5", F.lit(1).alias("page"), F.decode("content", "UTF-8").alias("text")).where("text <> ''")
    cache = read(files.where(F.substring("doc_md5", 1, 1) < "8")).distinct()
    return src.cached_pages(files, cache, read)[0]


@query("s3_cache_work_list", "SELECT count(DISTINCT md5(text)) AS n FROM documents WHERE substr(md5(text), 1, 1) >= '8'")
def s3_work(spark, sf):
    files = _files(spark, sf)
    return src.to_extract(files, files.where(F.substring("doc_md5", 1, 1) < "8").select("doc_md5")).agg(F.count("*").alias("n"))


@query("s4_ingest", f"WITH RECURSIVE {_CHUNKS} SELECT source, page, chunk_no, n_words FROM chunks")
def s4(spark, sf):
    d = _table(spark, sf, "documents")
    numbered = src.pages_of_documents(d)
    files = numbered.select("source", F.lit("k").alias("doc_md5")).distinct().select(F.col("source").alias("name"), F.col("source").alias("doc_md5"))
    read = lambda f: f.join(numbered, F.col("doc_md5") == numbered["source"]).select("doc_md5", "page", "text")
    files = files.withColumn("path", F.col("name"))
    return src.ingest(files, None, read)[1].select("source", "page", "chunk_no", "n_words")


@query("s5_union", "SELECT source, page, text FROM (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page, text FROM documents)")
def s5(spark, sf):
    p = pages(spark, sf)
    return src.require_chunks(src.union_all([p.where("page % 2 = 0"), p.where("page % 2 = 1").select("text", "page", "source")]))


@query(
    "s6_fingerprint",
    """WITH h AS (SELECT md5('file' || doc_id || '|' || md5(text)) AS m FROM documents)
SELECT CAST(count(*) AS VARCHAR) || '-' || CAST(sum(CAST(CAST(('0x' || substr(m, 1, 15)) AS BIGINT) AS HUGEINT)) AS VARCHAR) || '-' || CAST(sum(CAST(CAST(('0x' || substr(m, 16, 15)) AS BIGINT) AS HUGEINT)) AS VARCHAR) AS fingerprint FROM h""",
)
def s6(spark, sf):
    return src.fingerprint(_files(spark, sf))


@query("s6_index_reuse", f"WITH RECURSIVE {_CHUNKS}, {_INDEX} SELECT term, chunk_ix, CAST(tf AS INTEGER) AS tf, CAST(dl AS INTEGER) AS dl FROM postings JOIN doc_len USING (chunk_ix)")
def s6_reuse(spark, sf):
    """Postings of the index as it is found again under its inputs' fingerprint."""
    first, again = built(spark, sf), built(spark, sf)
    if first.postings.inputFiles() != again.postings.inputFiles():
        raise RuntimeError("the index was built anew")
    return again.postings.select("term", "chunk_ix", "tf", "dl")


_PARTS = "parts AS (SELECT source || '-' || CAST((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 50 AS VARCHAR) AS name, doc_id AS page, text FROM documents)"


def _put_parts(spark, parts, path):
    """(name, page, text) as files: a folder a name, a line a page."""
    lines = parts.repartition("name").sortWithinPartitions("name", "page").select("name", F.to_json(F.struct("page", "text")).alias("line"))
    lines.write.mode("append").partitionBy("name").text(path)


def _part_pages(files):
    """(doc_md5, page, text) of files of such lines."""
    line = F.explode(F.split(F.decode("content", "UTF-8"), "\n"))
    read = files.select("doc_md5", line.alias("line")).where("line <> ''").select("doc_md5", F.from_json("line", "page long, text string").alias("r"))
    return read.select("doc_md5", F.col("r.page").cast("int").alias("page"), "r.text")


@query(
    "s1_s3_stream_files",
    f"WITH {_PARTS} SELECT name AS source, CAST(page AS INTEGER) AS page, text FROM (SELECT 'name=' || name AS name, page, text FROM parts UNION ALL SELECT 'name=copy of ' || name, page, text FROM parts WHERE ends_with(name, '-0'))",
)
def s1_stream(spark, sf):
    """Files that arrive in three batches, the third of renamed ones; a batch is committed twice. No content is extracted twice, no page is there twice."""
    base = f"{work_dir(spark)}/lodestone/files-{uuid.uuid4().hex}"
    d = _table(spark, sf, "documents")
    first = src.pages_of_documents(d.select("source", "doc_id", F.col("doc_id").cast("string").alias("text")))
    parts = first.select("source", F.col("text").cast("long").alias("doc_id"), F.floor((F.col("page") - 1) / 50).alias("k")).join(d.select("doc_id", F.col("text")), "doc_id")
    parts = saved(parts.select(F.concat_ws("-", "source", "k").alias("name"), F.col("doc_id").alias("page"), "text"), "file_parts")
    renamed = parts.where("endswith(name, '-0')").withColumn("name", F.concat(F.lit("copy of "), "name"))
    half = F.crc32(F.col("name")) % 2
    arriving = None
    with listing(spark):
        for part in (parts.where(half == 0), parts.where(half == 1), renamed):
            _put_parts(spark, part, f"{base}/in")
            # each call lists all folders
            arriving = arriving or src.stream_files(spark, f"{base}/in", "*.txt", name_at=-2, files_a_batch=1_000_000)
            files.ingest_files(arriving, f"{base}/cache", f"{base}/checkpoint", _part_pages).awaitTermination()
        again = src.named(spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").option("recursiveFileLookup", "true").load(f"{base}/in/name=copy*"), -2)
    files.commit(again, 2, f"{base}/cache", _part_pages)  # as after a failure
    return files.pages_of(spark, f"{base}/cache").withColumn("source", F.url_decode("source"))


_STATS_SQL = f"WITH RECURSIVE {_CHUNKS}, names AS (SELECT DISTINCT source AS name FROM documents UNION ALL SELECT 'empty.pdf'), stats AS (SELECT name, count(chunk_ix) AS chunks FROM names LEFT JOIN chunks ON source = name GROUP BY name)"


@query("s7_file_stats", f"{_STATS_SQL} SELECT * FROM stats")
def s7(spark, sf):
    files = _table(spark, sf, "documents").select(F.col("source").alias("name")).distinct().union(spark.createDataFrame([("empty.pdf",)], "name string"))
    return src.file_stats(files, chunk.chunk_pages(pages(spark, sf)))


@query("s8_totals", f"{_STATS_SQL} SELECT count(*) AS documents, CAST(sum(chunks) AS BIGINT) AS chunks FROM stats")
def s8(spark, sf):
    return src.totals(s7(spark, sf))


@query("s9_peek", f"WITH RECURSIVE {_CHUNKS} SELECT chunk_ix, source, page, text FROM chunks ORDER BY chunk_ix LIMIT 3")
def s9(spark, sf):
    at = f"{work_dir(spark)}/lodestone/peek-{uuid.uuid4().hex}"
    chunks(spark, sf).write.parquet(at)
    return src.peek(spark, at)[1].select("chunk_ix", "source", "page", "text")


# extraction

_BLOCKS = f"""lines AS (SELECT source, doc_id AS page, unnest(string_split(text, chr(10))) AS text, unnest(range(0, len(string_split(text, chr(10))))) AS block_ix FROM documents),
blk AS (SELECT source, page, block_ix, CAST(block_ix % 7 AS DOUBLE) AS y0, {_STRIP('text')} AS text,
  CASE WHEN page % 3 = 0 THEN 10.0 WHEN instr('01234567', substr(md5(text), 1, 1)) > 0 THEN 10.0 WHEN instr('89ab', substr(md5(text), 1, 1)) > 0 THEN 47.0 ELSE 60.0 END AS x0 FROM lines),
use AS (SELECT * FROM blk WHERE text <> '')"""


@query("e1_usable_blocks", f"WITH {_BLOCKS} SELECT source, page, CAST(x0 AS DOUBLE) AS x0, y0, text FROM use")
def e1(spark, sf):
    return extract.usable_blocks(blocks(spark, sf)).select("source", "page", "x0", "y0", "text")


_E2 = f"""WITH {_BLOCKS}, two AS (SELECT source, page, max(x0 > 45) AS two FROM use GROUP BY ALL),
texts AS (SELECT source, page, string_agg(text, chr(10) ORDER BY (two AND x0 >= 50), y0, block_ix) AS text FROM use JOIN two USING (source, page) GROUP BY source, page)"""


@query("e2_reading_order", f"{_E2} SELECT * FROM texts")
def e2(spark, sf):
    return extract.block_text(blocks(spark, sf))


@query("e3_fallback", f"""SELECT doc_id, coalesce(nullif({_STRIP("CASE WHEN doc_id % 3 = 0 THEN text ELSE ' ' END")}, ''), nullif({_STRIP("CASE WHEN doc_id % 3 = 1 THEN lang END")}, ''), source) AS text FROM documents""")
def e3(spark, sf):
    d = _table(spark, sf, "documents")
    layer = lambda k, c, other: F.when(F.col("doc_id") % 3 == k, F.col(c)).otherwise(other)
    return d.select("doc_id", extract.first_text(layer(0, "text", F.lit(" ")), layer(1, "lang", F.lit(None)), F.col("source")).alias("text"))


@query("e4_ocr", "SELECT doc_id, 'scanned page ' || md5(text) AS ocr_text, CAST(NULL AS VARCHAR) AS hook_error FROM documents")
def e4(spark, sf):
    d = _table(spark, sf, "documents").select("doc_id", F.encode("text", "UTF-8").alias("image"))
    return hooks.ocr(d, keys=["doc_id"]).select("doc_id", "ocr_text", "hook_error")


_PDF_SQL = f"""lines AS (SELECT 'file' || doc_id AS name, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS k FROM documents),
texts AS (SELECT name, string_agg({_STRIP('line')}, chr(10) ORDER BY k) AS text FROM lines WHERE {_STRIP('line')} <> '' GROUP BY name)"""


@query("e1_e5_pdf_hook", f"WITH {_PDF_SQL} SELECT name, CAST(1 AS INTEGER) AS page, text FROM texts")
def pdf_hook(spark, sf):
    """Files through the PDF hook: blocks in reading order, each file's pages by name."""
    files = _files(spark, sf).select(F.col("name").alias("source"), "content")
    made = extract.block_text(hooks.blocks_of(hooks.pdf(files, keys=["source"]), ["source"]))
    return made.select(F.col("source").alias("name"), "page", "text")


_MD = """body AS (SELECT n_regionkey, CAST(n_nationkey AS VARCHAR) AS k, n_name AS v, n_nationkey AS o FROM nation UNION ALL SELECT DISTINCT n_regionkey, 'key', 'name', -1 FROM nation),
wid AS (SELECT n_regionkey, max(len(k)) AS a, max(len(v)) AS b FROM body GROUP BY ALL),
md AS (SELECT n_regionkey AS page, string_agg('| ' || rpad(k, CAST(a AS INTEGER), ' ') || ' | ' || rpad(v, CAST(b AS INTEGER), ' ') || ' |' || CASE WHEN o = -1 THEN chr(10) || '| ' || repeat('-', a) || ' | ' || repeat('-', b) || ' |' ELSE '' END, chr(10) ORDER BY o) AS markdown
  FROM body JOIN wid USING (n_regionkey) GROUP BY n_regionkey)"""


@query("e5_e6_table_markdown", f"WITH {_MD} SELECT 'nation' AS source, page, markdown FROM md")
def e6(spark, sf):
    return extract.page_tables(cells(spark, sf)).select("source", "page", F.explode("markdowns").alias("markdown"))


_LAID = """body AS (SELECT n_regionkey AS page, 1 + row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS r, CAST(n_nationkey AS VARCHAR) AS a, CASE WHEN n_nationkey % 6 <> 5 THEN n_name ELSE '' END AS b, r_name AS c FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT DISTINCT n_regionkey, 1, 'key', 'name', 'region' FROM nation),
wid AS (SELECT page, max(len(a)) AS wa, max(len(b)) AS wb, max(len(c)) AS wc FROM body GROUP BY page),
md AS (SELECT page, string_agg('| ' || rpad(a, CAST(wa AS INTEGER), ' ') || ' | ' || rpad(b, CAST(wb AS INTEGER), ' ') || ' | ' || rpad(c, CAST(wc AS INTEGER), ' ') || ' |'
  || CASE WHEN r = 1 THEN chr(10) || '| ' || repeat('-', wa) || ' | ' || repeat('-', wb) || ' | ' || repeat('-', wc) || ' |' ELSE '' END, chr(10) ORDER BY r) AS markdown FROM body JOIN wid USING (page) GROUP BY page)"""


def _laid_out(spark, sf):
    """Nations with their region's name as blocks on a page a region, a line of text above and below: numbers set to the right, names to
    the left, regions in the middle, each moved a little by its hash; every sixth name is missing."""
    n = _table(spark, sf, "nation").join(_table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    line = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey"))  # few nations a region
    rows = n.select(F.col("n_regionkey").alias("page"), line.alias("r"), F.col("n_nationkey").cast("string").alias("a"), F.when(F.col("n_nationkey") % 6 != 5, F.col("n_name")).otherwise("").alias("b"), F.col("r_name").alias("c"))
    said = lambda r, a: n.select(F.col("n_regionkey").alias("page"), r.alias("r"), *[F.lit(x).alias(c) for c, x in zip("abc", a, strict=True)]).distinct()
    rows = rows.unionByName(said(F.lit(0), ["key", "name", "region"])).unionByName(said(F.lit(-2), ["Nations of a region, in the order of their keys", "", ""])).unionByName(said(F.lit(40), ["Names that are not known are left out.", "", ""]))
    each = rows.select("page", "r", F.posexplode(F.array("a", "b", "c")).alias("k", "text"))
    shift = lambda salt: (F.pmod(F.xxhash64("page", "r", "k", F.lit(salt)), F.lit(100)) / 100 - 0.5)
    width = F.char_length("text") * 5.0
    text_line = F.col("r").isin(-2, 40)
    left = F.when(text_line, 20.0).when(F.col("k") == 0, 60 - width).when(F.col("k") == 1, 80.0).otherwise(300 - width / 2) + 2 * shift(1)
    top = 100 + 14 * F.col("r") + 3 * shift(2)
    return each.select(F.lit("nation").alias("source"), "page", (F.col("r") * 3 + F.col("k")).cast("int").alias("block_ix"), left.alias("x0"), top.alias("y0"), (left + width).alias("x1"), (top + 10).alias("y1"), "text")


@query("e5_tables_from_positions", f"WITH {_LAID} SELECT 'nation' AS source, page, markdown FROM md")
def e5_layout(spark, sf):
    """Tables found by the blocks' places on a page, as Markdown."""
    return extract.page_tables(layout.tables(_laid_out(spark, sf))).select("source", "page", F.explode("markdowns").alias("markdown"))


_RAGGED = """rows AS (SELECT n_regionkey AS page, n_nationkey % 2 AS table_ix, n_nationkey % 7 = 0 AS short, n_name FROM nation),
rag AS (SELECT page, CAST(table_ix AS INTEGER) AS table_ix, bool_or(short) AS ragged, count(*) AS n FROM rows GROUP BY ALL)"""


def _ragged_cells(spark, sf):
    """Two tables a region; the row of every seventh nation is too short."""
    n = _table(spark, sf, "nation")
    row = F.when(F.col("n_nationkey") % 7 == 0, F.array("n_name")).otherwise(F.array(F.col("n_nationkey").cast("string"), F.col("n_name")))
    packed = n.groupBy(F.col("n_regionkey").alias("page"), (F.col("n_nationkey") % 2).cast("int").alias("table_ix")).agg(F.collect_list(row).alias("rs"))
    return packed.select(F.lit("nation").alias("source"), "page", "table_ix", F.concat(F.array(F.array(F.lit("key"), F.lit("name"))), "rs").alias("cells"))


_SHAPED = """cells AS (SELECT n_regionkey AS page, CAST(n_nationkey % 2 AS INTEGER) AS table_ix, n_nationkey AS r, n_nationkey % 7 = 0 OR n_nationkey % 11 = 10 AS odd, CASE WHEN n_nationkey % 5 <> 1 THEN CAST(n_nationkey AS VARCHAR) ELSE '' END AS a, n_name AS b FROM nation
  UNION ALL SELECT DISTINCT n_regionkey, CAST(n_nationkey % 2 AS INTEGER), -1, false, 'key', 'name of nation' FROM nation),
wid AS (SELECT page, table_ix, bool_or(odd) AS ragged, CAST(max(len(a)) AS INTEGER) AS wa, CAST(max(len(b)) AS INTEGER) AS wb FROM cells GROUP BY ALL),
md AS (SELECT page, table_ix, ragged, string_agg('| ' || rpad(a, wa, ' ') || ' | ' || rpad(b, wb, ' ') || ' |' || CASE WHEN r = -1 THEN chr(10) || '| ' || repeat('-', wa) || ' | ' || repeat('-', wb) || ' |' ELSE '' END, chr(10) ORDER BY r) AS markdown
  FROM cells JOIN wid USING (page, table_ix) GROUP BY page, table_ix, ragged),
one AS (SELECT DISTINCT n_regionkey AS page, CAST(n_regionkey AS VARCHAR) AS k FROM nation)"""


def _shaped_cells(spark, sf):
    """A region's nations as two tables, with rows that are too short or too long, cells that are null, of two lines or not stripped;
    and a table of a header only, one without rows and one of an empty row."""
    n = _table(spark, sf, "nation")
    key = F.when(F.col("n_nationkey") % 5 != 1, F.col("n_nationkey").cast("string"))
    name = F.concat(F.lit(" "), "n_name", F.lit(" "))
    row = F.when(F.col("n_nationkey") % 7 == 0, F.array(name)).when(F.col("n_nationkey") % 11 == 10, F.array(key, name, F.lit("more"))).otherwise(F.array(key, name))
    packed = n.groupBy(F.col("n_regionkey").alias("page"), (F.col("n_nationkey") % 2).cast("int").alias("table_ix")).agg(F.array_sort(F.collect_list(F.struct("n_nationkey", row.alias("row")))).alias("rs"))
    tables = packed.select("page", "table_ix", F.concat(F.array(F.array(F.lit("key"), F.lit("name\nof nation"))), F.col("rs.row")).alias("cells"))
    header = F.array(F.array(F.lit("region"), F.col("n_regionkey").cast("string")))
    odd = F.array(header, F.array().cast("array<array<string>>"), F.array(F.array().cast("array<string>")))
    shapes = n.select("n_regionkey").distinct().select(F.col("n_regionkey").alias("page"), F.posexplode(odd).alias("k", "cells"))
    return tables.unionByName(shapes.select("page", (F.col("k") + 2).cast("int").alias("table_ix"), "cells")).withColumn("source", F.lit("nation"))


@query(
    "e7_ragged",
    f"""WITH {_SHAPED} SELECT 'nation' AS source, page, table_ix, ragged, CASE WHEN NOT ragged THEN markdown END AS markdown FROM md
UNION ALL SELECT 'nation', page, CAST(2 AS INTEGER), false, '| region | ' || k || ' |' || chr(10) || '| ------ | ' || repeat('-', len(k)) || ' |' || chr(10) FROM one
UNION ALL SELECT 'nation', page, CAST(i AS INTEGER), false, '' FROM one, (VALUES (3), (4)) t(i)""",
)
def e7(spark, sf):
    """Each table's whole Markdown, none of a ragged one."""
    bad = is_ragged(F.col("cells"))
    return _shaped_cells(spark, sf).select("source", "page", "table_ix", bad.alias("ragged"), F.when(~bad, to_markdown(F.col("cells"))).alias("markdown"))


@query("e7_page_loss", f"WITH {_RAGGED} SELECT page, bool_or(ragged) AS ragged, CAST(CASE WHEN bool_or(ragged) THEN 0 ELSE count(*) END AS INTEGER) AS n FROM rag GROUP BY page")
def e7_page(spark, sf):
    """One ragged table loses all tables of its page."""
    return extract.page_tables(_ragged_cells(spark, sf)).select("page", "ragged", F.size("markdowns").alias("n"))


@query("e8_framing", f"WITH {_MD} SELECT page, chr(10) || '[TABLE]' || chr(10) || markdown || chr(10) || '[/TABLE]' AS framed FROM md")
def e8(spark, sf):
    return extract.page_tables(cells(spark, sf)).select("page", F.explode("markdowns").alias("md")).select("page", extract.framed(F.col("md")).alias("framed"))


_IMAGES = "im AS (SELECT doc_id AS page, source, 1 AS image_ix, 50 + doc_id % 120 AS width, 80 + doc_id % 50 AS height, CASE WHEN doc_id % 4 > 0 THEN lang ELSE NULL END AS caption FROM documents)"


def _images(spark, sf):
    return _table(spark, sf, "documents").select(
        F.col("doc_id").alias("page"), "source", F.lit(1).alias("image_ix"), (50 + F.col("doc_id") % 120).alias("width"), (80 + F.col("doc_id") % 50).alias("height"), F.when(F.col("doc_id") % 4 > 0, F.col("lang")).alias("caption")
    )


@query("e9_image_filter", f"WITH {_IMAGES} SELECT page, width, height FROM im WHERE width >= 100 AND height >= 100")
def e9(spark, sf):
    return extract.large_images(_images(spark, sf)).select("page", "width", "height")


@query("e10_captions", f"WITH {_IMAGES} SELECT source, page, '[Image: ' || caption || ']' AS caption FROM im WHERE width >= 100 AND height >= 100 AND caption IS NOT NULL")
def e10(spark, sf):
    return extract.captions(extract.large_images(_images(spark, sf))).select("source", "page", F.explode("captions").alias("caption"))


@query("e10_caption_hook", "SELECT doc_id, CASE WHEN text <> '' THEN 'image ' || md5(text) END AS caption, CAST(len(to_base64(encode(text))) AS INTEGER) AS n_encoded FROM documents")
def e10_hook(spark, sf):
    d = _table(spark, sf, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    return hooks.caption(hooks.encoded(d), keys=["doc_id"]).select("doc_id", "caption", F.length(F.regexp_replace("encoded", "[\r\n]", "")).alias("n_encoded"))


@query(
    "e11_e12_pages",
    f"""{_E2}, {_IMAGES}, cap AS (SELECT source, page, '[Image: ' || caption || ']' AS c FROM im WHERE width >= 100 AND height >= 100 AND caption IS NOT NULL),
tab AS (SELECT source, doc_id AS page, CASE WHEN doc_id % 5 > 0 THEN chr(10) || '[TABLE]' || chr(10) || '| id' || repeat(' ', greatest(len(CAST(doc_id AS VARCHAR)) - 2, 0)) || ' | lang |' || chr(10) || '| ' || repeat('-', greatest(len(CAST(doc_id AS VARCHAR)), 2)) || ' | ---- |' || chr(10)
  || '| ' || rpad(CAST(doc_id AS VARCHAR), CAST(greatest(len(CAST(doc_id AS VARCHAR)), 2) AS INTEGER), ' ') || ' | ' || rpad(lang, 4, ' ') || ' |' || chr(10) || '[/TABLE]' END AS t FROM documents WHERE doc_id % 2 = 0),
whole AS (SELECT source, page, {_STRIP("concat_ws(chr(10) || chr(10), text, t, c)")} AS text FROM texts FULL JOIN tab USING (source, page) FULL JOIN cap USING (source, page))
SELECT * FROM whole WHERE text <> ''""",
)
def e11(spark, sf):
    """Text, tables and captions of every page; every fifth table is ragged and loses its page's tables."""
    d = _table(spark, sf, "documents").where("doc_id % 2 = 0")
    body = F.when(F.col("doc_id") % 5 > 0, F.array(F.col("doc_id").cast("string"), "lang")).otherwise(F.array("lang"))
    t = d.select("source", F.col("doc_id").alias("page"), F.lit(0).alias("table_ix"), F.array(F.array(F.lit("id"), F.lit("lang")), body).alias("cells"))
    return extract.assemble(extract.block_text(blocks(spark, sf)), extract.page_tables(t), extract.captions(extract.large_images(_images(spark, sf))))


# chunking


@query("c1_word_count", "SELECT doc_id, CAST(len(list_filter(string_split_regex(text, '\\s+'), lambda y : y <> '')) AS INTEGER) AS n_words FROM documents")
def c1(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", word_count(F.col("text")).alias("n_words"))


@query(
    "c2_table_blocks",
    f"""WITH t AS (SELECT doc_id, list_filter(string_split(regexp_replace({_STRIP('text')}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s : s <> '') AS s,
  '[TABLE]' || chr(10) || lang || '. ' || source || chr(10) || '[/TABLE]' AS b, '[TABLE] ' || lang || '. never closed' AS o FROM documents),
w AS (SELECT doc_id, list_concat(list_concat(list_concat(s, [b]), ['Two here.']), CASE WHEN doc_id % 2 = 0 THEN [b, o] ELSE [] END) AS s FROM t)
SELECT doc_id, CAST(len(s) AS INTEGER) AS n, md5(array_to_string(s, '|')) AS digest FROM w""",
)
def c2(spark, sf):
    """Every document with a table behind it and a sentence; half of them with a second one and an open one."""
    block = F.concat(F.lit("[TABLE]\n"), "lang", F.lit(". "), "source", F.lit("\n[/TABLE]"))
    opened = F.when(F.col("doc_id") % 2 == 0, F.concat(block, F.lit("[TABLE] "), "lang", F.lit(". never closed"))).otherwise("")
    whole = F.concat("text", F.lit("\n"), block, F.lit(" Two here. "), opened)
    s = _table(spark, sf, "documents").select("doc_id", sentences(whole).alias("s"))
    return s.select("doc_id", F.size("s").alias("n"), F.md5(F.encode(F.array_join("s", "|"), "UTF-8")).alias("digest"))


@query("c3_sentences", f"WITH {_PAGES}, {_SENTS} SELECT source, page, CAST(len(s) AS INTEGER) AS n, md5(array_to_string(s, '|')) AS digest FROM wide")
def c3(spark, sf):
    s = pages(spark, sf).select("source", "page", sentences(F.col("text")).alias("s")).where(F.size("s") > 0)
    return s.select("source", "page", F.size("s").alias("n"), F.md5(F.encode(F.array_join("s", "|"), "UTF-8")).alias("digest"))


@query("c4_c5_chunks", f"WITH RECURSIVE {_CHUNKS} SELECT chunk_ix, source, page, chunk_no, text, n_words, first_sentence, last_sentence FROM chunks")
def c4(spark, sf):
    return chunks(spark, sf).select("chunk_ix", "source", "page", "chunk_no", "text", "n_words", "first_sentence", "last_sentence")


# index


@query("i1_tokens", f"SELECT doc_id, CAST(len(t) AS INTEGER) AS n, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {_TOKENS('text')} AS t FROM documents)")
def i1(spark, sf):
    t = _table(spark, sf, "documents").select("doc_id", tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").alias("n"), F.md5(F.encode(F.array_join("t", " "), "UTF-8")).alias("digest"))


@query(
    "i2_i3_embed_hook",
    """WITH d AS (SELECT doc_id, list_transform(range(1, 5), lambda k : instr('0123456789abcdef', substr(md5(text), k, 1))) AS v FROM documents)
SELECT doc_id, CAST(k - 1 AS INTEGER) AS k, round(v[k] / sqrt(list_sum(list_transform(v, lambda x : x * x))), 4) AS x FROM (SELECT doc_id, v, unnest(range(1, 5)) AS k FROM d)""",
)
def i2_hook(spark, sf):
    """A model whose vectors are not of unit length, through the hook."""
    v = hooks.embed(_table(spark, sf, "documents").select("doc_id", "text"), hooks.stub_embed(), keys=["doc_id"])
    return v.select("doc_id", F.posexplode("embedding").alias("k", "x")).select("doc_id", "k", F.round(F.col("x").cast("double"), 4).alias("x"))


@query("i2_hashed_vectors", f"WITH RECURSIVE {_CHUNKS}, {_vectors('cv', 'chunks', 'chunk_ix')} SELECT chunk_ix, CAST(b AS INTEGER) AS b, round(v, 4) AS v FROM cv")
def i2(spark, sf):
    v = index.hashed_vectors(chunks(spark, sf), ["chunk_ix"]).select("chunk_ix", F.posexplode("embedding").alias("b", "v"))
    return v.where("v <> 0").select("chunk_ix", "b", F.round("v", 4).alias("v"))


@query("i4_dense_index", "SELECT vec_id, CAST(len(embedding) AS INTEGER) AS dim, round(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x : x * x)), 4) AS norm FROM embeddings")
def i4(spark, sf):
    """The vectors as the flat index holds them, checked to be of one dimension."""
    v = _table(spark, sf, "embeddings")
    dim = index.check_dimension(v)
    squares = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return v.select("vec_id", F.lit(dim).alias("dim"), F.round(squares, 4).alias("norm"))


@query("i5_term_stats", f"WITH RECURSIVE {_CHUNKS}, {_INDEX} SELECT term, df, round(idf, 4) AS idf FROM term_stats")
def i5(spark, sf):
    c = chunks(spark, sf)
    return index.term_stats(index.postings(c), c.count()).select("term", "df", F.round("idf", 4).alias("idf"))


@query(
    "i6_build",
    f"""WITH RECURSIVE {_CHUNKS}, {_INDEX}, {_vectors('cv', 'chunks', 'chunk_ix')}
SELECT chunk_ix, source, page, CAST(dl AS INTEGER) AS dl, n_terms, round(idf, 3) AS idf, coalesce(n_places, 0) AS n_places FROM chunks JOIN doc_len USING (chunk_ix)
LEFT JOIN (SELECT chunk_ix, count(*) AS n_terms, sum(idf) AS idf FROM postings JOIN term_stats USING (term) GROUP BY chunk_ix) USING (chunk_ix) LEFT JOIN (SELECT chunk_ix, count(*) AS n_places FROM cv GROUP BY chunk_ix) USING (chunk_ix)""",
)
def i6(spark, sf):
    """Every chunk with what each relation of the index says of it."""
    ix = built(spark, sf)
    # blocks are joined, not their postings
    terms = ix.blocks.select("term", "held.chunk_ix").join(ix.term_stats.select("term", "idf"), "term").select("idf", F.explode("chunk_ix").alias("chunk_ix"))
    terms = terms.groupBy("chunk_ix").agg(F.count("*").alias("n_terms"), F.round(F.sum("idf"), 3).alias("idf"))
    places = ix.vectors.select("chunk_ix", F.size(F.filter("embedding", lambda x: x != 0)).cast("long").alias("n_places"))
    whole = ix.chunks.select("chunk_ix", "source", "page").join(ix.doc_len, "chunk_ix").join(terms, "chunk_ix", "left").join(places, "chunk_ix", "left")
    return whole.select("chunk_ix", "source", "page", "dl", "n_terms", "idf", F.coalesce("n_places", F.lit(0)).alias("n_places"))


def _segmented(spark, sf):
    """Documents in five batches of sources, in their order; the last source comes with the first batch too, with other texts, and is replaced by the last."""
    p = saved(pages(spark, sf), "segment_pages")
    named = numbered(p.select("source").distinct(), ["source"], "k")
    n = named.count()
    placed = p.join(named.select("source", F.floor(F.col("k") * 5 / n).alias("batch"), (F.col("k") == n - 1).alias("last")), "source")
    root = f"{work_dir(spark)}/lodestone/segments-{uuid.uuid4().hex}"
    for k in range(5):
        batch = placed.where(F.col("batch") == k)
        if k == 0:
            batch = batch.unionByName(placed.where("last").withColumn("text", F.concat(F.lit("An old version. "), F.reverse("text"))))
        segments.append(batch.select("source", "page", "text"), root, f"batch-{k}")
    segments.append(placed.where("last").select("source", "page", "text"), root, "batch-4")  # repeated: nothing changes
    return root


@query("i5_i6_segments", f"WITH RECURSIVE {_CHUNKS}, {_INDEX} SELECT source, page, chunk_no, term, CAST(tf AS INTEGER) AS tf, CAST(dl AS INTEGER) AS dl, df, round(idf, 4) AS idf FROM postings JOIN term_stats USING (term) JOIN doc_len USING (chunk_ix) JOIN chunks USING (chunk_ix)")
def i6_segments(spark, sf):
    """Postings and merged term statistics of an index of five appended batches with a replaced source."""
    ix = segments.open_index(spark, _segmented(spark, sf))
    # blocks are joined, not their postings; dead chunks find no row of the live ones
    posts = index.held_by(ix.blocks, ix.term_stats.select("term", "df", F.round("idf", 4).alias("idf")), "term", "df", "idf")
    return posts.join(ix.chunks.select("chunk_ix", "source", "page", "chunk_no"), "chunk_ix").select("term", "tf", "dl", "df", "idf", "source", "page", "chunk_no")


@query("r9_r13_segments", f"{RETRIEVE_SQL} SELECT query_id, rank, vector_score, bm25_score, final_score, corrected_query, source, page, text FROM found")
def r9_segments(spark, sf):
    """Retrieval and page lookup from the index of appended batches, compacted once: the same order as from one built at once."""
    root = _segmented(spark, sf)
    segments.compact(spark, root)
    return retrieve.retrieve(asked(spark), segments.open_index(spark, root))[0].drop("chunk_ix")


# questions


@query("u1_correct", f"WITH {_ANALYSED_ALL} SELECT query_id, corrected, was_changed FROM analysed")
def u1(spark, sf):
    c = all_questions(spark, sf).withColumn("corrected", qf.correct(F.col("raw")))
    return c.select("query_id", "corrected", (F.col("corrected") != F.col("raw")).alias("was_changed"))


@query("u2_intent", f"WITH {_ANALYSED_ALL} SELECT query_id, intent FROM analysed")
def u2(spark, sf):
    return all_questions(spark, sf).select("query_id", qf.intent(qf.correct(F.col("raw"))).alias("intent"))


@query("u3_variants", f"WITH {_ANALYSED_ALL}, {_VARIANTS} SELECT query_id, variant_ix, text FROM variants")
def u3(spark, sf):
    return qf.explode_variants(all_questions(spark, sf).withColumn("corrected", qf.correct(F.col("raw"))))


@query("u4_page_reference", f"WITH {_PAGES}, {_Q_ALL} SELECT query_id, CAST({_PAGE_OF} AS INTEGER) AS page_num FROM q")
def u4(spark, sf):
    stats = pages(spark, sf).agg(F.countDistinct("source").alias("num_sources"), F.max("page").alias("last_page"))
    return qf.analyse(all_questions(spark, sf), stats).select("query_id", "page_num")


# scores


@query(
    "r1_corpus_stats",
    f"WITH RECURSIVE {_CHUNKS}, {_INDEX}, ps AS (SELECT source, count(DISTINCT page) AS p FROM chunks GROUP BY source) SELECT n, round(avgdl, 4) AS avgdl, (SELECT count(*) FROM ps) AS num_sources, (SELECT max(p = 1) FROM ps) AS has_single_page_source, (SELECT max(page) FROM chunks) AS last_page FROM corpus",
)
def r1(spark, sf):
    s = index.corpus_stats(chunk.chunk_pages(pages(spark, sf)))
    return s.select("n", F.round("avgdl", 4).alias("avgdl"), "num_sources", "has_single_page_source", "last_page")


# The search query set: every row whose id is divisible by 100, against all rows.
_DENSE_SQL = """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, v.vec_id AS chunk_ix, list_inner_product(q.e, v.e) AS raw FROM v q, v WHERE q.vec_id % 100 = 0),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 9) DESC, chunk_ix) AS r FROM s) WHERE r <= 40)"""


def _search_set(v):
    return v.where("chunk_ix % 100 = 0").select(F.col("chunk_ix").alias("query_id"), F.lit(0).alias("variant_ix"), "embedding")


def _dense(spark, sf):
    v = _table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_ix"), "embedding")
    return v, score.dense_top(_search_set(v), v, 40)


@query("r2_dense_top", f"{_DENSE_SQL} SELECT query_id, chunk_ix, round(raw, 4) AS raw FROM t")
def r2(spark, sf):
    return _dense(spark, sf)[1].select("query_id", "chunk_ix", F.round("raw", 4).alias("raw"))


@query("i4_packed_top", f"{_DENSE_SQL} SELECT query_id, chunk_ix, round(raw, 4) AS raw FROM t")
def i4_packed(spark, sf):
    """The same from blocks that are packed once for the same vectors, without reading those that can't matter."""
    v = _table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_ix"), "embedding")
    named = v.select(F.col("chunk_ix").cast("string").alias("name"), F.md5(F.array_join(F.col("embedding").cast("array<string>"), ",").cast("binary")).alias("doc_md5"))
    name = index.key(src.fingerprint(named).first()["fingerprint"], packed=dense.ROWS, pivots=dense.PIVOTS)
    packed = dense.stored(v, f"{work_dir(spark)}/lodestone/packed", name)
    return dense.top(_search_set(v), packed, 40)[0].select("query_id", "chunk_ix", F.round("raw", 4).alias("raw"))


@query(
    "r3_dense_norm",
    f"""{_DENSE_SQL}, b AS (SELECT query_id, least(min(raw), 0) AS lo, greatest(max(raw), 0) AS hi FROM t GROUP BY ALL)
SELECT query_id, chunk_ix, round(CASE WHEN hi - lo > 1e-9 THEN (raw - lo) / (hi - lo) ELSE raw END, 4) AS dense FROM t JOIN b USING (query_id)
UNION ALL SELECT query_id, -1, round(CASE WHEN hi - lo > 1e-9 THEN (0 - lo) / (hi - lo) ELSE 0 END, 4) FROM b""",
)
def r3(spark, sf):
    """The normalised top of each query, and under -1 the one score of all other vectors."""
    v, top = _dense(spark, sf)
    inside, rest = score.dense_norm(top, v.count(), 40)
    others = rest.select("query_id", F.lit(-1).cast("long").alias("chunk_ix"), F.col("dense_rest").alias("dense"))
    return inside.select("query_id", "chunk_ix", "dense").unionByName(others).withColumn("dense", F.round("dense", 4))


@query("r4_bm25", f"WITH RECURSIVE {_CHUNKS}, {_INDEX}, {_ANALYSED}, {_VARIANTS}, {_BM25} SELECT query_id, variant_ix, chunk_ix, round(raw / (max(raw) OVER (PARTITION BY query_id, variant_ix)), 4) AS bm25 FROM bm")
def r4(spark, sf):
    ix = built(spark, sf)
    v = qf.explode_variants(asked(spark).withColumn("corrected", qf.correct(F.col("raw"))))
    return score.bm25_norm(score.bm25_raw(v, ix), v, ix.n)[0].withColumn("bm25", F.round("bm25", 4))


_BEST_SQL = f"WITH RECURSIVE {_CHUNKS}, {_INDEX}, {_ANALYSED}, {_VARIANTS}, {_SCORES}"


@query("r5_r6_r7_r8_scores", f"{_BEST_SQL} SELECT query_id, chunk_ix, round(dense, 4) AS dense, round(bm25, 4) AS bm25, round(combined, 4) AS combined FROM best")
def r5(spark, sf):
    """Every chunk's scores for every question, both intents at their own depth."""
    ix = built(spark, sf)
    deep, fetch_k, _ = retrieve.with_depth(qf.analyse(asked(spark), ix.stats), ix, 8)
    s = scan.search(*retrieve.variants_of(deep), ix, fetch_k, None, score.ALPHA)
    return s.select("query_id", "chunk_ix", *[F.round(c, 4).alias(c) for c in retrieve.SCORES])


@query("r9_r10_r11_r12_retrieve", f"{RETRIEVE_SQL} SELECT query_id, rank, vector_score, bm25_score, final_score, corrected_query, source, page, chunk_ix, text FROM found")
def r9(spark, sf):
    found, _ = retrieve.retrieve(asked(spark), built(spark, sf))
    return found.select("query_id", "rank", "vector_score", "bm25_score", "final_score", "corrected_query", "source", "page", "chunk_ix", "text")


@query("r9_retrieve_turns", f"{RETRIEVE_SQL.replace(_Q, _Q_ALL)} SELECT query_id, rank, vector_score, bm25_score, final_score, corrected_query, source, page, chunk_ix FROM found")
def r9_turns(spark, sf):
    """Retrieval for every user turn of the conversations too."""
    found, _ = retrieve.retrieve(all_questions(spark, sf), built(spark, sf))
    return found.select("query_id", "rank", "vector_score", "bm25_score", "final_score", "corrected_query", "source", "page", "chunk_ix")


@query(
    "r8_depth_policy",
    """WITH c AS (SELECT lang, count(*) AS n, count(DISTINCT source) AS sources FROM documents GROUP BY lang), one AS (SELECT lang, bool_or(k = 1) AS single FROM (SELECT lang, source, count(*) AS k FROM documents GROUP BY ALL) GROUP BY lang),
p AS (SELECT * FROM c JOIN one USING (lang), (VALUES ('broad'), ('specific')) i(intent), (VALUES (6), (8)) t(k))
SELECT lang, intent, CAST(k AS BIGINT) AS k, CAST(greatest(1, CASE WHEN single THEN n WHEN intent = 'broad' THEN least(n, 15 * k) ELSE least(n, 10 * k) END) AS BIGINT) AS fetch_k,
  CAST(CASE WHEN single THEN n WHEN intent = 'broad' THEN least(n, k * sources) ELSE k END AS BIGINT) AS final_k FROM p""",
)
def r8(spark, sf):
    """The depths of both intents in the corpus of each language: one of a source with a single page returns everything."""
    by = _table(spark, sf, "documents").groupBy("lang", "source").agg(F.count("*").alias("pages"))
    corpora = by.groupBy("lang").agg(F.sum("pages").alias("n"), F.count("*").alias("sources"), F.bool_or(F.col("pages") == 1).alias("single"))
    p = corpora.select("*", F.explode(F.array(F.lit("broad"), F.lit("specific"))).alias("intent")).select("*", F.explode(F.array(F.lit(6).cast("long"), F.lit(8).cast("long"))).alias("k"))
    fetch, final = rank.depths(*(F.col(c) for c in ("intent", "n", "sources", "single", "k")))
    return p.select("lang", "intent", "k", fetch.alias("fetch_k"), final.alias("final_k"))


_PLACED_SQL = """WITH c AS (SELECT vec_id AS chunk_ix, 's' || label AS source, CAST(vec_id % 7 + 1 AS INTEGER) AS page, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT q.chunk_ix AS query_id, c.chunk_ix, c.source, c.page, list_inner_product(q.e, c.e) AS combined FROM c q, c WHERE q.chunk_ix % 100 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id, {by} ORDER BY round(combined, 9) DESC, chunk_ix DESC) AS nth FROM s),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY ({late}), round(combined, 9) DESC, chunk_ix DESC) AS INTEGER) AS rank FROM k)
SELECT query_id, chunk_ix, source, page, rank FROM r WHERE rank <= 25"""


def _placed(spark, sf, *by):
    """Scores of the search query set as far as they can rank, and every vector's source and page."""
    v = _table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("chunk_ix"), F.concat(F.lit("s"), F.col("label").cast("string")).alias("source"), (F.col("vec_id") % 7 + 1).cast("int").alias("page"), "embedding"
    )
    top = score.nearest(_search_set(v), v, 25, F.xxhash64(*by) if by else None, small_first=False)
    return top.select("query_id", "chunk_ix", F.col("raw").alias("combined")), v.drop("embedding")


@query("r7_rank", _PLACED_SQL.format(by="source", late="false"))
def r7(spark, sf):
    s, c = _placed(spark, sf)
    return rank.ranked(s).where("rank <= 25").join(c, "chunk_ix").select("query_id", "chunk_ix", "source", "page", "rank")


@query("r10_diversify_by_source", _PLACED_SQL.format(by="source", late="nth > 1"))
def r10(spark, sf):
    return rank.diversified(*_placed(spark, sf, "source"), ["source"], 25).select("query_id", "chunk_ix", "source", "page", "rank")


@query("r11_diversify_by_page", _PLACED_SQL.format(by="source, page", late="nth > 1"))
def r11(spark, sf):
    return rank.diversified(*_placed(spark, sf, "source", "page"), ["source", "page"], 25).select("query_id", "chunk_ix", "source", "page", "rank")


@query("r13_page_lookup", f"WITH RECURSIVE {_CHUNKS}, {_Q}, pg AS (SELECT query_id, {_PAGE_OF} AS page_num FROM q) SELECT query_id, CAST(r AS INTEGER) AS rank, chunk_ix, source, text FROM (SELECT query_id, chunks.*, row_number() OVER (PARTITION BY query_id ORDER BY chunk_ix) AS r FROM chunks JOIN pg ON page = page_num WHERE page_num <> 0) WHERE r <= 8")
def r13(spark, sf):
    c = chunks(spark, sf)
    q = qf.analyse(asked(spark), index.corpus_stats(c))
    return rank.page_lookup(q, c).select("query_id", "rank", "chunk_ix", "source", "text")


# answers

_AS_RESULTS = "res AS (SELECT doc_id // 20 AS query_id, source, CAST(doc_id AS BIGINT) AS page, CAST(row_number() OVER (PARTITION BY doc_id // 20 ORDER BY doc_id DESC) AS INTEGER) AS rank, text FROM documents)"


def _as_results(spark, sf):
    """Documents as if they were ranked results, twenty a question."""
    d = _table(spark, sf, "documents").select(F.floor(F.col("doc_id") / 20).alias("query_id"), "source", F.col("doc_id").alias("page"), "text")
    return d.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("page"))))


_SHOW = lambda t: f"'[SOURCE: ' || source || ' | Page ' || page || ']' || chr(10) || {t}"


@query(
    "a1_a3_broad_context",
    f"""WITH {_AS_RESULTS}, cum AS (SELECT *, sum(length(text)) OVER (PARTITION BY query_id ORDER BY source, page, rank ROWS UNBOUNDED PRECEDING) AS upto FROM res),
cut AS (SELECT *, CASE WHEN upto <= 7000 THEN text WHEN upto - length(text) <= 7000 AND 7000 - (upto - length(text)) > 100 THEN substr(text, 1, CAST(7000 - (upto - length(text)) AS BIGINT)) END AS t FROM cum)
SELECT query_id, string_agg({_SHOW('t')}, chr(10) || chr(10) ORDER BY source, page, rank) AS context FROM cut WHERE t IS NOT NULL GROUP BY query_id""",
)
def a1(spark, sf):
    return answer.broad_context(_as_results(spark, sf))


@query("a2_a3_specific_context", f"WITH {_AS_RESULTS} SELECT query_id, string_agg({_SHOW('substr(text, 1, 1500)')}, chr(10) || chr(10) ORDER BY rank) AS context FROM res GROUP BY query_id")
def a2(spark, sf):
    return answer.specific_context(_as_results(spark, sf))


@query("a4_sources", "SELECT string_agg(source, ', ' ORDER BY source) AS sources FROM (SELECT DISTINCT source FROM documents)")
def a4(spark, sf):
    return answer.source_list(_table(spark, sf, "documents"))


def _prompt_sql(parts):
    return " || ".join({"$context": "context", "$raw": "raw", "$sources": "sources"}.get(p) or _lit(p) for p in parts)


@query(
    "a5_prompts",
    f"""WITH {_ANALYSED}, {_AS_RESULTS}, ctx AS (SELECT query_id, string_agg({_SHOW('substr(text, 1, 1500)')}, chr(10) || chr(10) ORDER BY rank) AS context FROM res GROUP BY query_id),
src AS (SELECT string_agg(source, ', ' ORDER BY source) AS sources FROM (SELECT DISTINCT source FROM documents))
SELECT query_id, CASE WHEN intent = 'broad' THEN {_prompt_sql(answer.BROAD_PROMPT)} ELSE {_prompt_sql(answer.SPECIFIC_PROMPT)} END AS prompt, CAST(CASE WHEN intent = 'broad' THEN 1500 ELSE 1000 END AS INTEGER) AS max_tokens FROM analysed JOIN ctx USING (query_id), src""",
)
def a5_prompts(spark, sf):
    stats = pages(spark, sf).agg(F.countDistinct("source").alias("num_sources"), F.max("page").alias("last_page"))
    return answer.prompts(qf.analyse(asked(spark), stats), a2(spark, sf), a4(spark, sf))


@query("a9_fallback", f"SELECT conv_id * 1000 + turn AS query_id, CASE WHEN turn % 3 = 0 THEN text ELSE {_lit(answer.NO_RESULT)} END AS answer FROM conversations")
def a9(spark, sf):
    c = _table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "turn", F.col("text").alias("answer"))
    return answer.with_fallback(c, c.where("turn % 3 = 0").select("query_id", "answer"))


@query(
    "a5_a6_a9_ask",
    f"""{RETRIEVE_SQL}, kinds AS (SELECT query_id, CASE WHEN coalesce(page_num, 0) <> 0 THEN 'specific' ELSE intent END AS kind FROM analysed JOIN pg USING (query_id)),
firsts AS (SELECT query_id, kind, text, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN kind = 'broad' THEN source END, CASE WHEN kind = 'broad' THEN page END, rank) AS k FROM found JOIN kinds USING (query_id)),
line1 AS (SELECT query_id, string_split(substr(text, 1, CASE WHEN kind = 'broad' THEN 7000 ELSE 1500 END), chr(10))[1] AS line FROM firsts WHERE k = 1)
SELECT query_id, coalesce(regexp_replace(line, '`([^`]+)`', '\\1', 'g'), {_lit(answer.NO_RESULT)}) AS answer FROM analysed LEFT JOIN line1 USING (query_id)""",
)
def a5(spark, sf):
    """Prompts and stub answers of all questions, with the fixed message where nothing is found."""
    return retrieve.ask(asked(spark), built(spark, sf))


@query("a7_clean", "SELECT conv_id, turn, regexp_replace(replace(text, ' the ', ' `the` '), '`([^`]+)`', '\\1', 'g') AS answer FROM conversations")
def a7(spark, sf):
    c = _table(spark, sf, "conversations")
    return c.select("conv_id", "turn", answer.cleaned(F.replace("text", F.lit(" the "), F.lit(" `the` "))).alias("answer"))


@query("a8_word_stream", "SELECT query_id, CAST(position AS INTEGER) AS position, w || ' ' AS piece FROM (SELECT conv_id * 1000 + turn AS query_id, unnest(string_split(text, ' ')) AS w, unnest(range(0, len(string_split(text, ' ')))) AS position FROM conversations)")
def a8(spark, sf):
    c = _table(spark, sf, "conversations")
    return answer.word_stream(c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("answer")))


@query("a10_notices", f"WITH {_PAGES}, {_ANALYSED}, pg AS (SELECT *, {_PAGE_OF} AS p FROM analysed) SELECT query_id, CASE WHEN coalesce(p, 0) = 0 AND was_changed THEN 'Query corrected: ' || corrected END AS corrected_notice, CASE WHEN coalesce(p, 0) = 0 AND intent = 'broad' THEN {_lit(answer.BROAD_NOTICE)} END AS broad_notice FROM pg")
def a10(spark, sf):
    stats = pages(spark, sf).agg(F.countDistinct("source").alias("num_sources"), F.max("page").alias("last_page"))
    return answer.notices(qf.analyse(asked(spark), stats))


_LOG = "qs AS (SELECT conv_id AS session_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS query_no, conv_id * 1000 + turn AS query_id, text AS raw FROM conversations WHERE role = 'user')"


@query("a11_chat_log", f"WITH {_LOG} SELECT session_id, query_no * 2 AS turn, 'user' AS role, raw AS content FROM qs UNION ALL SELECT session_id, query_no * 2 + 1, 'assistant', 're: ' || raw FROM qs")
def a11(spark, sf):
    users = _table(spark, sf, "conversations").where("role = 'user'")
    order = (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1).cast("long")
    q = users.select(F.col("conv_id").alias("session_id"), order.alias("query_no"), (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("raw"))
    return answer.chat_log(q, q.select("query_id", F.concat(F.lit("re: "), "raw").alias("answer")))


@query("a11_a8_stream_log", f"WITH {_LOG} SELECT CAST(session_id AS VARCHAR) AS session_id, query_no * 2 AS turn, 'user' AS role, raw AS content FROM qs UNION ALL SELECT CAST(session_id AS VARCHAR), query_no * 2 + 1, 'assistant', 're: ' || raw FROM qs")
def a11_stream(spark, sf):
    """The chat log of questions that arrive in three batches, numbered by each session's state."""
    base = f"{work_dir(spark)}/lodestone/chat-{uuid.uuid4().hex}"
    users = _table(spark, sf, "conversations").where("role = 'user'")
    asked_ = users.select(F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("sent"), (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("raw"))
    for batch in (F.col("sent") < 2, F.col("sent").between(2, 4), F.col("sent") > 4):
        asked_.where(batch).write.mode("append").parquet(f"{base}/in")
        arriving = spark.readStream.schema(asked_.schema).parquet(f"{base}/in")
        chat.log_turns(arriving, F.concat(F.lit("re: "), "raw"), f"{base}/log", f"{base}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{base}/log").select("session_id", "turn", "role", "content")


@query("e12_progress", "SELECT count(*) AS done, CAST(sum(CASE WHEN trim(text) = '' THEN 1 ELSE 0 END) AS BIGINT) AS blank, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(0 AS BIGINT) AS failed FROM documents")
def e12_progress(spark, sf):
    """What was counted while pages went from extraction to their chunks: one pass, which only writes the chunks."""
    seen, counts = progress.observed(pages(spark, sf))
    saved(chunk.chunk_pages(seen), "observed_chunks")
    return spark.createDataFrame([counts.get], "done long, blank long, chars long, failed long")


@query("stream_ingest", f"WITH RECURSIVE {_CHUNKS} SELECT source, page, chunk_no, n_words FROM chunks")
def stream(spark, sf):
    """Chunks of pages that arrive as a stream, appended batch by batch."""
    base = f"{work_dir(spark)}/lodestone/stream-{uuid.uuid4().hex}"
    table = saved(pages(spark, sf), "stream_pages")
    arriving = spark.readStream.schema(table.schema).parquet(table.inputFiles()[0].rsplit("/", 1)[0])
    ingest.append_chunks(arriving, f"{base}/chunks", f"{base}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{base}/chunks").select("source", "page", "chunk_no", "n_words")
