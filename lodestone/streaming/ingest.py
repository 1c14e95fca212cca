"""Incremental ingest: pages arrive as a stream, chunks are appended batch by batch.

Chunking is a stateless projection, so it runs inside the stream. An index that grows with the
stream, statistics included, is made of a segment a batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import segments
from lodestone.operators.chunk import chunk_pages


def chunk_stream(pages: DataFrame) -> DataFrame:
    """A stream of (source, page, text) as a stream of chunks, without chunk_ix."""
    return chunk_pages(pages)


def append_chunks(pages: DataFrame, chunk_path: str, checkpoint: str, once: bool = True):
    """Start the query that appends each batch's chunks under its batch number; a
    batch that is run again after a failure replaces its own files."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{chunk_path}/batch={batch_id}")

    writer = chunk_stream(pages).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def append_segments(pages: DataFrame, root: str, checkpoint: str, once: bool = True):
    """Start the query that adds each batch of pages (source, page, text) to the index under root as a segment. A batch that is
    run again finds its label and adds nothing."""
    stream_name = checkpoint.rstrip("/").rsplit("/", 1)[-1]

    def add(batch: DataFrame, batch_id: int) -> None:
        segments.append(batch, root, f"{stream_name}-{batch_id}")

    writer = pages.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def distinct_pages(pages: DataFrame) -> DataFrame:
    """Each page text once, over all batches."""
    return pages.withColumn("text_md5", F.md5(F.encode("text", "UTF-8"))).dropDuplicates(["text_md5"]).drop("text_md5")
