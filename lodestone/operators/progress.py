"""Progress of extraction, counted while rows pass: no second pass over the data and no accumulator in user code.

Counts are observed metrics of the plan itself: in a batch they are there when its action ends, in a stream after each
micro-batch, by a listener, so that done of total is known while files come in. Rows that a
retried task makes again count once.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

METRIC = "pages"


def _counts(blank: Column, error: Column | None) -> list[Column]:
    failed = F.count_if(error.isNotNull()) if error is not None else F.lit(0).cast("long")
    return [F.count(F.lit(1)).alias("done"), F.count_if(blank).alias("blank"), F.coalesce(F.sum(F.char_length("text").cast("long")), F.lit(0)).alias("chars"), failed.alias("failed")]


def observed(pages: DataFrame, error_col: str | None = None, name: str = METRIC) -> tuple[DataFrame, Observation | None]:
    """pages (with a column text) as they are, whose passing is counted: done, blank, chars, failed. In a batch the Observation
    has them after the action; of a stream they come to a Progress listener."""
    counts = _counts(F.coalesce(F.trim("text"), F.lit("")) == "", F.col(f"`{error_col}`") if error_col else None)
    if pages.isStreaming:
        return pages.observe(name, *counts), None
    seen = Observation(name)
    return pages.observe(seen, *counts), seen


@dataclass
class Progress(StreamingQueryListener):
    """Sums up the counts of a stream's micro-batches. total: pages that are to come, if known."""

    total: int | None = None
    name: str = METRIC
    batches: dict[tuple[str, int], dict[str, int]] = field(default_factory=dict)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(self.name)
        if row is not None:  # a batch that is run again replaces its own counts
            self.batches[str(event.progress.id), event.progress.batchId] = row.asDict()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def counts(self) -> dict[str, int]:
        names = ("done", "blank", "chars", "failed")
        return {k: sum(b[k] for b in self.batches.values()) for k in names}

    def share(self) -> float | None:
        """Done of total, if that is known."""
        return self.counts()["done"] / self.total if self.total else None
