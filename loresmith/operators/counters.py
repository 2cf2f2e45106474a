"""Counters of a run, taken from the rows as they pass: no second scan.

``observed`` puts metrics on a DataFrame; whatever job runs it fills them, and ``Counters.get`` gives them. For a stream, ``Totals``
listens to its micro-batches and adds their metrics up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def run_metrics(lists: tuple[str, ...] = ("problems", "tips", "cost_info", "settings"), size: str = "batch_size", error: str = "error") -> dict[str, Column]:
    """Counters of extraction results: batches, posts, failed and empty ones, and the items of each list."""
    n = lambda c: F.coalesce(F.size(c), F.lit(0))
    items = {f"n_{c}": F.sum(n(c)).cast("long") for c in lists}
    some = F.lit(False)
    for c in lists:
        some = some | (n(c) > 0)
    return {
        "batches": F.count(F.lit(1)), "posts": F.coalesce(F.sum(size), F.lit(0)).cast("long"), "failed": F.count_if(F.col(error).isNotNull()), "empty": F.count_if(~some & F.col(error).isNull()), **items
    }


def status_metrics(id_column: str, at: str) -> dict[str, Column]:
    """Counters of what a source brought: rows, distinct ids (about), the first and the last time."""
    return {"rows": F.count(F.lit(1)), "ids": F.approx_count_distinct(id_column, 0.01), "earliest": F.min(at), "latest": F.max(at)}


class Counters:
    """Metrics of one pass over a DataFrame."""

    def __init__(self, name: str):
        self._seen = Observation(name)

    def on(self, df: DataFrame, metrics: dict[str, Column]) -> DataFrame:
        return df.observe(self._seen, *(c.alias(k) for k, c in metrics.items()))

    def get(self) -> dict:
        """The counters of the first job that ran to its end; waits for it."""
        return dict(self._seen.get)


class Totals(StreamingQueryListener):
    """Sums of the metrics that a stream's DataFrame observes under a name (``df.observe(name, ...)``), over its micro-batches."""

    def __init__(self, name: str):
        self.name, self.batches = name, 0
        self.totals: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(self.name)
        if row is not None:
            self.batches += 1
            for k, v in row.asDict().items():
                self.totals[k] = self.totals.get(k, 0) + (v or 0)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
