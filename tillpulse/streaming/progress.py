"""Rows in and out and durations of every micro-batch, from the engine's own progress reports: no job of their own."""

from __future__ import annotations

import json
from collections import deque

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

SCHEMA = (
    "query_id string, name string, batch bigint, started string, rows_in bigint, rows_out bigint, "
    "batch_ms bigint, write_ms bigint, observed map<string, string>"
)


class ProgressLog(StreamingQueryListener):
    """Keeps the last ``most`` reports; ``write`` moves what has gathered to a table. Add it with ``spark.streams.addListener``."""

    def __init__(self, most: int = 100_000):
        self.reports: deque = deque(maxlen=most)

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        report = event.progress
        out = report.sink.numOutputRows
        duration = dict(report.durationMs)
        observed = {name: json.dumps(row.asDict(), default=str) for name, row in dict(report.observedMetrics).items()}
        self.reports.append((
            str(report.id), report.name, report.batchId, report.timestamp, report.numInputRows, out if out >= 0 else None,
            duration.get("triggerExecution"), duration.get("addBatch"), observed,
        ))

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.reports), SCHEMA)

    def write(self, spark: SparkSession, path: str) -> int:
        """Append the gathered reports to a folder and forget them; gives their number."""
        rows = [self.reports.popleft() for _ in range(len(self.reports))]
        if rows:
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
        return len(rows)
