"""Document sources, the extraction cache, and what a session shows of its files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.chunk import chunk_pages
from lodestone.sources.shared import numbered, saved

FILES = "path string, modificationTime timestamp, length long, content binary"


def read_files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """(name, doc_md5, path, content) of all files that match, in subfolders too."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return named(raw)


def stream_files(spark: SparkSession, path: str, pattern: str = "*.pdf", name_at: int = -1, files_a_batch: int = 1000) -> DataFrame:
    """The same for files as they arrive. name_at: which part of the path is the name."""
    stream = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
    return named(stream.option("maxFilesPerTrigger", files_a_batch).load(path), name_at)


def named(raw: DataFrame, name_at: int = -1) -> DataFrame:
    return raw.select(F.element_at(F.split("path", "/"), name_at).alias("name"), content_hash("content").alias("doc_md5"), "path", "content")


def content_hash(col: str):
    return F.md5(col)


#: Folders of the cache: the first digits of the hash.
CACHE_PART = "substring(doc_md5, 1, 2)"


def read_cache(spark: SparkSession, path: str, files: DataFrame | None = None) -> DataFrame:
    """(doc_md5, page, text) of the cache. With files, only the folders that their hashes name are
    read (256 at most), pruned before the scan. Of a content that two batches extracted at the same time, one's pages."""
    cache = spark.read.schema("doc_md5 string, page int, text string, part string, batch string").parquet(path)
    if files is not None:
        cache = cache.where(F.col("part").isin([r["p"] for r in files.selectExpr(f"{CACHE_PART} AS p").distinct().collect()]))
    first = cache.groupBy(F.col("doc_md5").alias("of")).agg(F.min("batch").alias("first"))
    own = cache.join(first, (F.col("doc_md5") == F.col("of")) & (F.col("batch") == F.col("first")), "left_semi")
    return own.select("doc_md5", "page", "text")


def write_cache(new: DataFrame, path: str, batch: str | None = None) -> None:
    """Keep new rows under their batch's name, in folders by the hash's first digits; what is written twice is there once.
    Without a name it is that of the rows' contents: a repeated run writes over its own."""
    if batch is None:
        new = saved(new, "cache_rows")
        batch = fingerprint(new.select(F.lit("").alias("name"), "doc_md5")).first()["fingerprint"]
    new.withColumn("part", F.expr(CACHE_PART)).write.mode("overwrite").partitionBy("part").parquet(f"{path}/batch={batch}")


def to_extract(files: DataFrame, cache: DataFrame | None) -> DataFrame:
    """One file for each content that the cache does not hold: the file of each hash is chosen by its name and path,
    either of which may be null, and of a file that is listed several times one row counts."""
    return _chosen(files, first_files(files.select("doc_md5", "name", "path"), cache))


def _chosen(files: DataFrame, first: DataFrame) -> DataFrame:
    of = first.select(*[F.col(c).alias(f"__{c}") for c in ("doc_md5", "name", "path")])
    same = (F.col("doc_md5") == F.col("__doc_md5")) & F.col("name").eqNullSafe(F.col("__name")) & F.col("path").eqNullSafe(F.col("__path"))
    return files.join(of, same, "left_semi").dropDuplicates(["doc_md5"])


def first_files(keys: DataFrame, cache: DataFrame | None) -> DataFrame:
    """(doc_md5, name, path) of the file to extract for each content that the cache does not hold."""
    todo = keys.where("doc_md5 IS NOT NULL")
    if cache is not None:
        todo = todo.join(cache.select("doc_md5").distinct(), "doc_md5", "left_anti")
    return todo.groupBy("doc_md5").agg(F.min(F.struct("name", "path")).alias("first")).select("doc_md5", "first.name", "first.path")


def cached_pages(files: DataFrame, cache: DataFrame | None, extract: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Pages (source, page, text) of all files, and the cache's new rows
    (doc_md5, page, text), one row with a null page for a document without text.

    extract: files -> (doc_md5, page, text). Names are put on after the cache, so a
    renamed file keeps its pages under its new name.
    """
    first = first_files(files.select("doc_md5", "name", "path"), cache)
    made = first.select("doc_md5").join(extract(_chosen(files, first)), "doc_md5", "left").select("doc_md5", "page", "text")
    known = made if cache is None else cache.select("doc_md5", "page", "text").unionByName(made)
    pages = files.select(F.col("name").alias("source"), "doc_md5").join(known, "doc_md5").where("page IS NOT NULL")
    return pages.select("source", "page", "text"), made


def ingest(files: DataFrame, cache: DataFrame | None, extract: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pages, chunks, new cache rows) of files: extraction, then chunking."""
    pages, new = cached_pages(files, cache, extract)
    return pages, chunk_pages(pages), new


def union_all(parts: list[DataFrame]) -> DataFrame:
    """Chunks of several sources together; columns are matched by name, missing ones are null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def require_chunks(chunks: DataFrame) -> DataFrame:
    if chunks.isEmpty():
        raise ValueError("no text could be extracted from any document")
    return chunks


def fingerprint(files: DataFrame) -> DataFrame:
    """One row that changes if any file's name or content does; an index is reused while it is the same.
    The number of files, and the sums of two 60-bit pieces of each one's hash: partially aggregated, in any order."""
    own = F.md5(F.concat_ws("|", "name", "doc_md5"))
    piece = lambda at: F.sum(F.conv(F.substring(own, at, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    return files.agg(F.concat_ws("-", F.count("*").cast("string"), piece(1), piece(16)).alias("fingerprint"))


def file_stats(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """(name, chunks) of every file, 0 included."""
    counts = chunks.groupBy(F.col("source").alias("name")).agg(F.count("*").alias("chunks"))
    return files.select("name").join(counts, "name", "left").select("name", F.coalesce("chunks", F.lit(0)).alias("chunks"))


def totals(stats: DataFrame) -> DataFrame:
    """One row: documents, chunks."""
    return stats.agg(F.count("*").alias("documents"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"))


def peek(spark: SparkSession, path: str, rows: int = 3) -> tuple[int, DataFrame]:
    """How many chunks a saved table holds, and its first ones."""
    saved = spark.read.parquet(path)
    return saved.count(), saved.orderBy("chunk_ix").limit(rows)


def pages_of_documents(documents: DataFrame) -> DataFrame:
    """Adapter for plain text tables: (source, page, text), pages numbered by doc_id in each source.

    All rows are numbered at once, in ranges, so a large source is split; a source's pages count
    from its least number, one row a source.
    """
    rows = numbered(documents.select("source", "doc_id", "text"), ["source", "doc_id"], "__n")
    first = rows.groupBy(F.col("source").alias("__of")).agg(F.min("__n").alias("__first"))
    return rows.join(first, F.col("source").eqNullSafe(F.col("__of"))).select("source", (F.col("__n") - F.col("__first") + 1).cast("int").alias("page"), "text")
