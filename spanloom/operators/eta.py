"""Time-to-finish ranges from progress samples."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WINDOW_SECONDS = 10
LEAST_OBSERVATIONS = 4
KEPT_POINTS = 7
DECAY = 0.8


def completed_counts(events: DataFrame, task: str, ts: str, event_id: str, slot: str = "1 hour") -> DataFrame:
    """task, ts, completed, total: how many events of its task each event completes, in order of time and id.

    Events are numbered inside slots of time, on top of the counts of the slots before, so
    that a task with most of the events does not meet in one place.
    """
    rows = events.select(F.col(task).alias("task"), F.col(ts).alias("ts"), F.col(event_id).alias("id"), F.window(ts, slot)["start"].alias("slot"))
    sizes = rows.groupBy("task", "slot").agg(F.count(F.lit(1)).alias("n"))
    by = W.partitionBy("task")
    earlier = F.coalesce(F.sum("n").over(by.orderBy("slot").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("task", "slot", earlier.alias("earlier"), F.sum("n").over(by).alias("total"))
    inside = rows.withColumn("k", F.row_number().over(W.partitionBy("task", "slot").orderBy("ts", "id")))
    return inside.join(sizes, ["task", "slot"]).select("task", "ts", (F.col("earlier") + F.col("k")).alias("completed"), "total")


def windowed_points(progress: DataFrame, seconds: int = WINDOW_SECONDS, least: int = LEAST_OBSERVATIONS) -> DataFrame:
    """task, ts, completed, total: the points from which ranges are told, the first observation of a task being its origin.

    An observation counts if it is further on than all before it.  It is a point from the
    fourth such observation on, and ten seconds after the last point at the earliest; between
    points the last range holds.  Each point depends on the one before, so a task's
    observations are read in order, a batch at a time.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = point = most = None
        seen = 0
        for pdf in batches:
            keep = []
            for t, at, done, total in zip(pdf["task"], pdf["at"], pdf["completed"], pdf["total"], strict=True):
                if t != task:
                    task = t
                    point = None
                take = False
                if total > 0 and 0 <= done < total:
                    if point is None:
                        point, most, seen, take = at, done, 0, True
                    elif done > most:
                        most, seen = done, seen + 1
                        take = at - point >= seconds * 1_000_000 and seen >= least
                        point = at if take else point
                keep.append(take)
            yield pdf[keep]

    rows = progress.select(F.coalesce(F.col("task").cast("string"), F.lit("")).alias("task"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("completed").cast("long").alias("completed"), F.col("total").cast("long").alias("total"))
    ordered = rows.where("at is not null and completed is not null and total is not null").repartition("task").sortWithinPartitions("task", "at", "completed")
    points = ordered.mapInPandas(run, "task string, at long, completed long, total long")
    return points.select("task", F.timestamp_micros("at").cast(progress.schema["ts"].dataType).alias("ts"), "completed", "total")


def eta_ranges(points: DataFrame) -> DataFrame:
    """task, ts, completed, low, high (seconds): decayed mean cost of the last points, widened by their spread.

    The low end is never under the observed rate of the kept points nor of the whole
    run; the high end is at least a fifth above the low one.
    """
    order = W.partitionBy("task").orderBy("ts")
    kept = order.rowsBetween(-(KEPT_POINTS - 2), 0)
    at = F.col("ts").cast("timestamp").cast("double")
    steps = points.select("task", "ts", "completed", "total", at.alias("t"), F.lag(at).over(order).alias("t0"), F.lag("completed").over(order).alias("c0"), F.first(at).over(order).alias("t_first"), F.first("completed").over(order).alias("c_first"))
    steps = steps.where("c0 is not null and completed > c0 and t > t0")
    sample = F.struct(((F.col("t") - F.col("t0")) / (F.col("completed") - F.col("c0"))).alias("cost"), (F.col("completed") - F.col("c0")).cast("double").alias("n"), F.col("t0").alias("t0"), F.col("c0").alias("c0"))
    rows = steps.withColumn("s", F.collect_list(sample).over(kept))
    age = lambda i: F.pow(F.lit(DECAY), (F.size("s") - 1 - i).cast("double"))
    rows = rows.withColumn("w", F.transform("s", lambda x, i: x["n"] * age(i)))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda p, x: p + x)
    rows = rows.withColumn("sw", total(F.col("w")))
    rows = rows.withColumn("mean", total(F.zip_with("s", "w", lambda x, w: x["cost"] * w)) / F.col("sw"))
    rows = rows.withColumn("var", total(F.zip_with("s", "w", lambda x, w: w * F.pow(x["cost"] - F.col("mean"), 2.0))) / F.col("sw"))
    first = F.get("s", F.lit(0))
    seen = (F.col("t") - first["t0"]) / (F.col("completed") - first["c0"])
    base = (F.col("t") - F.col("t_first")) / (F.col("completed") - F.col("c_first"))
    low = F.greatest(F.col("mean"), seen, base)
    margin = F.greatest(F.col("mean") * 0.2, F.sqrt("var"))
    left = F.col("total") - F.col("completed")
    fits = (F.col("t") - first["t0"] >= WINDOW_SECONDS) & (left > 0)
    return rows.where(fits).select("task", "ts", "completed", (low * left).alias("low"), (F.greatest(low * 1.2, F.col("mean") + margin) * left).alias("high"))


def format_eta(low: float | None, high: float | None) -> str:
    """A range in whole minutes."""
    import math

    if low is None or high is None or not math.isfinite(low) or not math.isfinite(high):
        return "estimating"
    low, high = sorted((max(0.0, low), max(0.0, high)))
    if high < 60:
        return "under a minute left"
    a, b = math.ceil(low / 60), math.ceil(high / 60)
    return f"up to {b} min left" if a == 0 else f"{b} min left" if a == b else f"{a} to {b} min left"
