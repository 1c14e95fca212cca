"""The corpus preparation pipeline: documents in, token ids of the kept ones out.

Each stage takes (spark, docs, sf_dir) and judges its own input. The stages before
the last return rows with the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe, decontaminate, jaccard, pii, quality
from lodestone.llm.common import materialize
from lodestone.llm.queries import tokenizer_path


def masked(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs under plain column names, which no operator's own columns clash with, and those names."""
    names = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def unmasked(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.select(*[F.col(m).alias(c) for c, m in names.items()])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier rejects go."""
    plain, names = masked(docs)
    model = quality.train(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality.score(plain, model, text_col=names["text"], score_col="score")
    return unmasked(scored.where(F.col("score") >= 0.5), names)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id stays; of repeated rows one."""
    plain, names = masked(docs)
    doc, text = names["doc_id"], names["text"]
    keyed = plain.withColumn("key", F.xxhash64(text))
    stay = jaccard.join(docs).where("kept").select(F.col("doc_id").alias("stays"), F.col("tkey").alias("stays_key")).distinct()
    kept = keyed.join(stay, F.col(doc).eqNullSafe(F.col("stays")) & (F.col("key") == F.col("stays_key")), "left_semi")
    return unmasked(kept.dropDuplicates([doc, "key"]), names)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    plain, names = masked(docs)
    found = decontaminate.search(plain, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), text_col=names["text"])
    return unmasked(found.where(F.size("hit_spans") == 0), names)


def private_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets; n_chars follows the text."""
    clean = pii.redact(docs, pii.train(docs))
    return clean.withColumn("n_chars", F.char_length("text").cast("long")).select(*[f"`{c}`" for c in docs.columns])


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE ids of each whole text."""
    ids = bpe.encode(docs, tokenizer_path(), keep=["doc_id", "lang", "source"])
    return ids.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("private_data", private_data_stage),
    ("bpe", encode_stage),
]

#: SQL can't express the classifier, the span model and the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs, _ = materialize(stage(spark, docs, sf_dir), name)
    return docs
