"""File changes as a stream: debounced, reconciled, materialised."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def quiet_periods(changes: DataFrame, quiet: str = "2 seconds") -> DataFrame:
    """``source_id, began, last_change, changes``: bursts of changes (``source_id, ts``) that end when a source has been
    quiet for ``quiet``. Works on tables and, with a watermark on ``ts``, on streams. Null times are left out.
    """
    return (
        changes.where("ts IS NOT NULL")
        .groupBy("source_id", F.session_window("ts", quiet))
        .agg(F.min("ts").alias("began"), F.max("ts").alias("last_change"), F.count(F.lit(1)).alias("changes"))
        .select("source_id", "began", "last_change", "changes")
    )


def debounced(stream: DataFrame, quiet: str = "2 seconds", late: str = "10 seconds") -> DataFrame:
    """A stream of changes (``source_id, ts``) as one row per burst, out once the watermark has passed its end."""
    return quiet_periods(stream.withWatermark("ts", late), quiet)


def write_bursts(stream: DataFrame, path: str, checkpoint: str, quiet: str = "2 seconds", every: str | None = None) -> StreamingQuery:
    """Appends debounced bursts to Parquet: every so often (a reconciliation), or all that is there and then stops."""
    writer = debounced(stream, quiet).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).outputMode("append").start()
