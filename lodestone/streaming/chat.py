"""A chat log whose turns are numbered as messages arrive, by a state of each session that outlives batches and restarts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NUMBERED = "session_id string, query_no long, sent long, query_id long, raw string, late boolean"


class Numbering(StatefulProcessor):
    """State: how many questions a session has, and when the last one in time was sent."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("session", "n long, last long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, last = self.state.get() if self.state.exists() else (0, None)
        # a session's messages of one micro-batch, which the source's rate bounds
        batch = pd.concat(list(rows)).sort_values(["sent", "query_id"], kind="stable")
        sent = batch["sent"].astype("int64")
        before = sent.cummax().shift(fill_value=sent.iloc[0] if last is None else last)
        if last is not None:
            before = before.clip(lower=last)
        numbers = range(n, n + len(batch))
        self.state.update((n + len(batch), int(max(sent.max(), sent.iloc[0] if last is None else last))))
        yield pd.DataFrame({"session_id": key[0], "query_no": numbers, "sent": sent, "query_id": batch["query_id"], "raw": batch["raw"], "late": sent < before})

    def close(self) -> None:
        pass


def use_state_store(spark: SparkSession) -> None:
    """State of this kind needs RocksDB; set it unless the session names a provider."""
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) in (None, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def numbered_questions(messages: DataFrame) -> DataFrame:
    """A stream of (session_id string, sent long, query_id long, raw) as a stream of NUMBERED: query_no counts a session's
    questions from 0 as they arrive, of those in one batch by `sent`, then query_id. A question sent before one that
    an earlier batch numbered gets the next number all the same, numbers never change, and is marked late."""
    use_state_store(messages.sparkSession)
    grouped = messages.select("session_id", "sent", "query_id", "raw").groupBy("session_id")
    return grouped.transformWithStateInPandas(statefulProcessor=Numbering(), outputStructType=NUMBERED, outputMode="Append", timeMode="None")


def turns(numbered: DataFrame, answer) -> DataFrame:
    """(session_id, turn, role, content): each question and, behind it, its answer, a column of `numbered`."""
    said = F.array(F.struct(F.lit("user").alias("role"), F.col("raw").alias("content")), F.struct(F.lit("assistant").alias("role"), answer.alias("content")))
    each = numbered.select("session_id", "query_no", F.posexplode(said).alias("k", "m"))
    return each.select("session_id", (F.col("query_no") * 2 + F.col("k")).alias("turn"), "m.role", "m.content")


def log_turns(messages: DataFrame, answer, log_path: str, checkpoint: str, once: bool = True):
    """Start the query that appends the turns of arriving questions to a log, each batch in a folder of its number: one that runs again replaces its own."""
    def write(batch: DataFrame, k: int) -> None:
        batch.write.mode("overwrite").parquet(f"{log_path}/batch={k}")

    writer = turns(numbered_questions(messages), answer).writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
