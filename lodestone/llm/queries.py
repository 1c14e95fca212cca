"""The registered queries of the corpus operators, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe, decontaminate, html_text, jaccard, licences, pii, quality, runs, secrets, shards, substrings, vectors, whitening
from lodestone.llm.common import scratch
from lodestone.sources.shared import spread_small


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return spread_small(df) if table in ("documents", "pages") else df


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    both = bpe.encode(docs, tokenizer_path(), keep=["doc_id"], packed=True, decoded_col="decoded")
    return both.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


def op2_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = quality.train(docs, _read(spark, sf_dir, "labels"))
    scored = quality.score(docs, model, keep=["doc_id"])
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files in five old shards by their names, uneven ones, to eight of equal size; read back as rewritten."""
    rows, made = shards.reshard(spark.read.parquet(f"{sf_dir}/documents.parquet"), shards=8, old_shards=5)
    new = shards.rewrite_affected(rows, made, scratch(spark, "new_shards"))
    return new.select(*shards.measures("doc_id", "text"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    found = pii.find(docs, pii.train(docs), keep=["doc_id"])
    base = F.filter("spans", lambda s: s["base"])
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(kind) for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed("spans").alias("spans"))


def op5_tag_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = html_text.extract(_read(spark, sf_dir, "pages"), keep=["page_id", "url"])
    return text.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op6_int8_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(_read(spark, sf_dir, "embeddings"))


OP6_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
  ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9
),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
comp AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
deg AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, component_id = vec_id AS kept
FROM v JOIN comp USING (vec_id) LEFT JOIN deg USING (vec_id)
"""


def op7_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.search(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), keep=["doc_id"])
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["first"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


_FOLDED = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP7_SQL = f"""
WITH d AS (SELECT doc_id, {_FOLDED} AS w FROM documents),
b AS (SELECT item_id, {_FOLDED} AS w FROM benchmark),
p AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)
),
o AS (
  SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS win
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM p))
),
h AS (SELECT doc_id, item_id, i, m FROM o JOIN p USING (m, win)),
hw AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS k FROM h) GROUP BY doc_id),
hi AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM h) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.remove_repeats(_read(spark, sf_dir, "documents"), keep=["doc_id"])
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


_WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"

OP8_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
v AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)),
f AS (SELECT win, min(doc_id) AS least FROM v GROUP BY win HAVING min(doc_id) < max(doc_id)),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k FROM v JOIN f USING (win) WHERE least < doc_id),
e AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS k FROM d),
s AS (SELECT e.doc_id, string_agg(w[k], ' ' ORDER BY k) AS kept, count(*) AS n FROM e ANTI JOIN g USING (doc_id, k) GROUP BY e.doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN s USING (doc_id)
"""


def op9_sentence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan(_read(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select(
        "doc_id",
        F.size("sentence_ids").cast("long").alias("n_sentences"),
        F.array_join("sentence_ids", ",").alias("sentence_ids"),
        F.array_join("licences", ",").alias("licences"),
    )


def _op9_sql() -> str:
    """From the rule in words: a known sentence is a run of whole pieces of a paragraph, the longest first from the left."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    table = ", ".join(f"({quote(k)}, {quote(v)})" for k, v in licences.known().items())
    steps, rest = [], "concat('|', array_to_string(ids, '||'), '|')"
    for k, (_, ids) in enumerate(licences.RULES):
        mark = quote("|" + "||".join(ids) + "|")
        source = f"r{k - 1}" if k else "seq"
        steps.append(f"r{k} AS (SELECT * EXCLUDE (rest), contains(rest, {mark}) AS h{k}, replace(rest, {mark}, '#') AS rest FROM {source})")
    last = f"r{len(licences.RULES) - 1}"
    hits = ", ".join(f"CASE WHEN h{k} THEN {quote(name)} END" for k, (name, _) in enumerate(licences.RULES))
    order: dict[str, int] = {}
    for name, _ in licences.RULES:
        order.setdefault(name, len(order))
    ranked = ", ".join(f"({quote(n)}, {k})" for n, k in order.items())
    led, varies = quote(licences.LEAD), licences.VARIES
    tidied = "s"
    for pattern, form in varies:
        tidied = f"regexp_replace({tidied}, {quote(pattern)}, {quote(form)})"
    spdx = f"regexp_replace(regexp_replace(x, {quote(licences.SPDX_EXCEPT)}, '', 'g'), {quote(licences.SPDX_NEXT)}, chr(10) || '{licences.SPDX} ', 'g')"
    return f"""
WITH RECURSIVE known AS (SELECT s, id FROM (VALUES {table}) t(s, id)), ranked(licence, k) AS (VALUES {ranked}),
lines AS (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), {quote(licences.RUN_ON)}, '\\1' || chr(10) || '\\2', 'g'), chr(10)) AS l FROM documents),
cut AS (SELECT doc_id, array_to_string(list_transform(l, lambda x : CASE WHEN contains(x, '{licences.SPDX}') THEN {spdx} ELSE x END), chr(10)) AS t FROM lines),
pieces AS (SELECT doc_id, unnest(p) AS piece, unnest(range(1, len(p) + 1)) AS i
  FROM (SELECT doc_id, string_split_regex(t, '\\n|[.:;][^a-zA-Z0-9\\s]*[ \\t]+') AS p FROM cut)),
words AS (SELECT doc_id, i, replace(regexp_replace(trim(regexp_replace(lower(piece), '[^a-z0-9]+', ' ', 'g')), '^(dnl|rem) ', ''), 'licence', 'license') AS w FROM pieces),
para AS (SELECT *, CASE WHEN w = '' THEN 0 ELSE len(string_split(w, ' ')) END AS n, sum(CAST(w = '' AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM words),
ends AS (SELECT *, sum(n) OVER (PARTITION BY doc_id, p ORDER BY i) AS upto FROM para WHERE w <> ''),
grown AS (SELECT a.doc_id, a.i, b.i - a.i + 1 AS m, regexp_replace(a.w, {led}, 'licensed under') || coalesce(' ' || (SELECT string_agg(c.w, ' ' ORDER BY c.i) FROM ends c WHERE c.doc_id = a.doc_id AND c.i > a.i AND c.i <= b.i), '') AS s
  FROM ends a JOIN ends b ON a.doc_id = b.doc_id AND a.p = b.p AND b.i >= a.i AND b.upto - a.upto + a.n <= {licences.most_words()}
  WHERE EXISTS (SELECT 1 FROM (SELECT DISTINCT split_part(s, ' ', 1) AS f FROM known) WHERE f = split_part(regexp_replace(a.w, {led}, 'licensed under'), ' ', 1))),
runs AS (SELECT g.doc_id, g.i, g.m, known.id FROM (SELECT *, {tidied} AS c FROM grown) g JOIN known ON known.s = g.c),
best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id, i ORDER BY m DESC) = 1),
taken AS (
  SELECT doc_id, i, m, id FROM best QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i) = 1
  UNION ALL
  SELECT b.doc_id, b.i, b.m, b.id FROM taken t JOIN best b ON b.doc_id = t.doc_id AND b.i >= t.i + t.m QUALIFY row_number() OVER (PARTITION BY b.doc_id ORDER BY b.i) = 1
),
lists AS (SELECT doc_id, list(id ORDER BY i) AS ids FROM taken GROUP BY doc_id),
seq AS (SELECT doc_id, ids, {rest} AS rest FROM lists), {", ".join(steps)},
hit AS (SELECT DISTINCT doc_id, licence FROM (SELECT doc_id, unnest([{hits}]) AS licence FROM {last}) WHERE licence IS NOT NULL),
named AS (SELECT doc_id, string_agg(licence, ',' ORDER BY k) AS licences FROM hit h JOIN ranked USING (licence)
  WHERE licence <> '{licences.RESERVED}' OR NOT EXISTS (SELECT 1 FROM hit o WHERE o.doc_id = h.doc_id AND o.licence <> h.licence) GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(len(ids), 0) AS BIGINT) AS n_sentences, coalesce(array_to_string(ids, ','), '') AS sentence_ids, coalesce(licences, '') AS licences
FROM documents LEFT JOIN lists USING (doc_id) LEFT JOIN named USING (doc_id)
"""


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(_read(spark, sf_dir, "documents")).select("doc_id", "class_id", "component_id", "n_links", "kept")


OP10_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM d WHERE len(w) > 0)
),
n AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, chr(1) ORDER BY g)) AS k FROM s GROUP BY doc_id),
c AS (SELECT k, min(doc_id) AS class_id FROM n GROUP BY k),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS x FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE x / (p.n + q.n - x) >= 0.8),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a),
deg AS (SELECT a AS doc_id, count(*) AS n_links FROM links GROUP BY a)
SELECT doc_id, class_id, component_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id = doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (k) LEFT JOIN comp USING (doc_id) LEFT JOIN deg USING (doc_id)
"""


def op11_credential_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_read(spark, sf_dir, "documents"), keep=["doc_id"])
    base = F.filter("spans", lambda s: s["base"])
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(kind) for kind in secrets.BASE]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed("spans").alias("spans"))


def _op11_sql() -> str:
    """From the rules in words: places by running sums, scopes by counted blank lines, links by comparing a text's parts."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    enough = {
        "assign": f"length(regexp_extract(m, {quote(secrets.BASE['assign'])}, 2)) >= 6",
        "identifier": "length(regexp_extract(m, '[:=]\\x20*[\"'']?([A-Za-z0-9@._-]+)$', 1)) >= 3",
        "secret": "CASE WHEN regexp_matches(m, '[:=]') THEN length(regexp_extract(m, '[:=]\\x20*[\"'']?(.*)$', 1)) >= 4 ELSE " + " AND ".join(f"regexp_matches(m, '{c}')" for c in secrets.MIXED) + " END",
    }
    raw = " UNION ALL ".join(
        f"SELECT doc_id, '{kind}' AS kind, unnest(range(len(ms))) AS k, unnest(ms) AS m, unnest(ps[:len(ms)]) AS p, {n} AS rank FROM (SELECT doc_id, regexp_extract_all(t, {quote(p)}) AS ms, string_split_regex(t, {quote(p)}) AS ps FROM d)"
        for n, (kind, p) in enumerate((secrets.BASE | secrets.PARTS | {"break": secrets.BREAK}).items())
    )
    ok = " ".join(f"WHEN kind = '{k}' THEN {c}" for k, c in enough.items())
    strong = "(" + ", ".join(quote(k) for k in secrets.BASE) + ")"
    near = lambda a, b: f"{a}.doc_id = {b}.doc_id AND {a}.scope = {b}.scope AND {b}.s - {secrets.REACH} <= {a}.e AND {a}.s <= {b}.e + {secrets.REACH}"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
raw AS ({raw}),
pos AS (SELECT doc_id, kind, rank, m, sum(length(p) + length(m)) OVER (PARTITION BY doc_id, kind ORDER BY k) AS e FROM raw),
span AS MATERIALIZED (SELECT doc_id, kind, rank, e - length(m) AS s, e FROM pos WHERE CASE {ok} ELSE true END),
part AS (SELECT span.*, (SELECT count(*) FROM span b WHERE b.doc_id = span.doc_id AND b.kind = 'break' AND b.s <= span.s) AS scope FROM span
  WHERE kind <> 'break' AND (kind IN {strong} OR NOT EXISTS (SELECT 1 FROM span b WHERE b.doc_id = span.doc_id AND b.kind IN {strong} AND b.s < span.e AND span.s < b.e))),
ids AS (SELECT * FROM part WHERE kind IN ('identifier', 'access')),
sec AS (SELECT * FROM part WHERE kind IN ('secret', 'assign', 'hex')),
held AS (SELECT * FROM sec WHERE EXISTS (SELECT 1 FROM ids WHERE {near('sec', 'ids')})),
named AS (SELECT * FROM ids WHERE kind = 'identifier' AND EXISTS (SELECT 1 FROM sec WHERE {near('ids', 'sec')})),
ends AS (SELECT * FROM part WHERE kind = 'endpoint' AND EXISTS (SELECT 1 FROM held WHERE {near('part', 'held')})),
base AS (SELECT doc_id, kind, rank, s, e FROM span WHERE kind IN {strong}),
whole AS (SELECT * FROM base UNION ALL SELECT doc_id, kind, rank, s, e FROM held WHERE kind = 'secret' UNION ALL SELECT doc_id, kind, rank, s, e FROM named UNION ALL SELECT doc_id, kind, rank, s, e FROM ends),
n AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS b FROM base GROUP BY doc_id),
a AS (SELECT doc_id, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans FROM whole GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN a USING (doc_id)
"""


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_read(spark, sf_dir, "embeddings"))


def with_periodic_ends(docs: DataFrame) -> DataFrame:
    """(doc_id, text): a tenth of the texts, by doc_id, with a part of their words repeated up to the end."""
    words = F.regexp_extract_all(F.col("text"), F.lit("[^\\x20\\x09-\\x0D]+"), 0)
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)

    def repeated(w):
        n = F.size(w)
        a = g % n
        p = F.floor((n - a) / (3 + g % 8)) + 1
        at = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, at(i))), " ")

    changed = F.element_at(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, repeated(w))), 1)
    return docs.select("doc_id", F.when(h % 10 == 0, changed).otherwise(F.col("text")).alias("text"))


def op13_lyndon_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.find(with_periodic_ends(_read(spark, sf_dir, "documents")), keep=["doc_id"])
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    # by length falling, then start, then period: the first of the sorted
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("rest"), r["start"].alias("start"), r["period"].alias("period"))))
    length = -F.col("best.rest")
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        length.alias("length"),
        F.col("best.period").alias("period"),
        F.floor(1000 * length / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2(F.encode("collapsed", "UTF-8"), 256).alias("collapsed_sha256"),
    )


# crc32 of the decimal doc_id, a byte and then a bit at a time
_CRC32 = """xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c : CAST(ascii(c) AS BIGINT))),
  lambda a, b : list_reduce(list_concat([xor(a, b)], list_transform(range(8), lambda k : CAST(0 AS BIGINT))), lambda c, z : xor(c >> 1, 3988292384 * (c & 1)))), 4294967295)"""

OP13_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w, {_CRC32} AS h FROM documents),
p AS (SELECT doc_id, w, len(w) AS n, h, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a, h // 10 AS g FROM d),
e AS (
  SELECT doc_id, i, w[CASE WHEN h % 10 = 0 AND i >= a THEN a + (i - a) % (1 + (n - a) // (3 + g % 8)) ELSE i END + 1] AS word
  FROM (SELECT *, unnest(range(n)) AS i FROM p)
),
-- equal words of a text, and stretches of them at one distance
m AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM e x JOIN e y ON x.doc_id = y.doc_id AND x.word = y.word AND x.i < y.i),
s AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM m) GROUP BY doc_id, q, k),
l AS (SELECT * FROM s WHERE length >= greatest(12, 2 * q)),
r AS (SELECT * FROM l WHERE NOT EXISTS (SELECT 1 FROM l o WHERE o.doc_id = l.doc_id AND o.q < l.q AND o.start <= l.start AND o.start + o.length >= l.start + l.length)),
t AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS listed FROM r GROUP BY doc_id),
b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length DESC, start, q) = 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + q, start + length)) AS i FROM r),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM e ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, q AS period, CAST(1000 * length // q AS BIGINT) AS exponent_milli,
  sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(text, '')) AS collapsed_sha256
FROM d LEFT JOIN t USING (doc_id) LEFT JOIN b USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_compression": op2_compression,
    "op3_flow": op3_flow,
    "op4_weak_supervision": op4_weak_supervision,
    "op5_tag_paths": op5_tag_paths,
    "op6_int8_tiles": op6_int8_tiles,
    "op7_wu_manber": op7_wu_manber,
    "op8_substrings": op8_substrings,
    "op9_sentence_rules": op9_sentence_rules,
    "op10_jaccard": op10_jaccard,
    "op11_credential_links": op11_credential_links,
    "op12_whitening": op12_whitening,
    "op13_lyndon_runs": op13_lyndon_runs,
}
ORACLE_SQL: dict[str, str] = {"op6_int8_tiles": OP6_SQL, "op7_wu_manber": OP7_SQL, "op8_substrings": OP8_SQL, "op9_sentence_rules": _op9_sql(), "op10_jaccard": OP10_SQL, "op11_credential_links": _op11_sql(), "op13_lyndon_runs": OP13_SQL}
