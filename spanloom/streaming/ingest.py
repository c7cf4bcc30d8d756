"""Documents that arrive in a folder become findings, once each.

A micro-batch is written under its own id, and a batch that is replayed after a
failure overwrites just that folder, so replays change nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spanloom.operators.rules import rule_findings
from spanloom.policy import Policy
from spanloom.sources.segments import from_documents


def findings_stream(documents: DataFrame, policy: Policy | None = None) -> DataFrame:
    """Rule findings of a stream of documents; stateless, so append mode needs no watermark."""
    return rule_findings(from_documents(documents), policy)


def ingest(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, policy: Policy | None = None) -> StreamingQuery:
    """Process what is there and stop; call again for what came since."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rule_findings(from_documents(batch), policy).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress_windows(events: DataFrame, seconds: int = 10, lateness: str = "1 minute") -> DataFrame:
    """task, window, observations, completed: progress per window, with a watermark for late events."""
    slot = F.window("ts", f"{seconds} seconds")
    return events.withWatermark("ts", lateness).groupBy("task", slot.alias("window")).agg(F.count(F.lit(1)).alias("observations"), F.max("completed").alias("completed"))
