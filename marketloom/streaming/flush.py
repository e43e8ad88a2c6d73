"""Streaming side of a run: results flushed in batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from marketloom.operators import ranks
from marketloom.sources import sheets


def flush_results(results: DataFrame, target: str, checkpoint: str, batch_rows: int = 10) -> StreamingQuery:
    """Write payloads of a stream of results, ``batch_rows`` to a payload, for each sheet; a repeated micro-batch overwrites its own folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        numbered = ranks.batches(sheets.updates(batch), ["sheet_name"], [F.col("row_number")], batch_rows)
        sheets.payloads(numbered).write.mode("overwrite").json(f"{target}/batch={batch_id}")

    return results.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
