"""Bounded-load consistent hashing.

Shards own virtual nodes on a ring of 2**32 places.  A row's home is the shard
of the first virtual node at or after the row's own place.  Every shard has a
capacity; capacities differ by at most one and sum to the number of rows, so the
law ``rows`` holds exactly.  A full shard's later rows (by ring order inside its
arcs) continue clockwise to the next shard with room; only they move.

Scale: arcs, not rows, reach the driver (shards x virtual nodes counters), where
the clockwise walk runs on counts.  Rows are ranked inside small cells of an
arc, so no task holds more than a cell; repeated rows are counted before the
exchange and unfolded after it.  The plan joined back has at most
``arcs + shards`` intervals, which bounds the broadcast.

Defined results: null ids and texts hash as their own value; ties on the ring
are ordered by (id, checksum, size); identical rows are interchangeable; an
empty table gives an empty result; ids may be of any type; other columns, whatever their names, are not
read; with fewer rows than shards some stay empty.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from spanloom.llm.common import documents, durable, text_or_empty

SHARDS = 40
VIRTUAL_NODES = 128
CELL_ROWS = 20_000
FIXED_BYTES = 16


def ring(shards: int, virtual_nodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted places of all virtual nodes and their shards."""
    place = {}
    for s in range(shards):
        for v in range(virtual_nodes):
            p = zlib.crc32(f"shard {s} node {v}".encode())
            while p in place:  # a taken place: the next one clockwise
                p = (p + 1) % (1 << 32)
            place[p] = s
    at = np.array(sorted(place), dtype=np.int64)
    return at, np.array([place[p] for p in at], dtype=np.int64)


def walk(counts: np.ndarray, owner: np.ndarray, shards: int) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, end rank, shard, first slot): home rows first, then the overflow clockwise."""
    total = int(counts.sum())
    room = np.full(shards, total // shards, dtype=np.int64)
    room[: total % shards] += 1
    used = np.zeros(shards, dtype=np.int64)
    plan, over = [], []
    for arc in np.flatnonzero(counts):
        s, n = int(owner[arc]), int(counts[arc])
        take = min(n, int(room[s]))
        if take:
            plan.append((int(arc), 0, take, s, int(used[s])))
            used[s] += take
            room[s] -= take
        if take < n:
            over.append((int(arc), take, n))
    arcs = len(owner)
    for arc, lo, hi in over:
        step = 1
        while lo < hi:
            s = int(owner[(arc + step) % arcs])
            take = min(hi - lo, int(room[s]))
            if take:
                plan.append((arc, lo, lo + take, s, int(used[s])))
                used[s] += take
                room[s] -= take
                lo += take
            step += 1
    return plan


def assign_shards(
    docs: DataFrame,
    shards: int = SHARDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    virtual_nodes: int = VIRTUAL_NODES,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row."""
    spark = docs.sparkSession
    at, owner = ring(shards, virtual_nodes)

    @F.pandas_udf("int")
    def arc_of(place: pd.Series) -> pd.Series:
        return pd.Series((np.searchsorted(at, place.to_numpy()) % len(at)).astype(np.int32))

    text = text_or_empty(text_col)
    keyed = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + F.lit(FIXED_BYTES)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    keyed = keyed.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("copies"))
    keyed = keyed.withColumn("hash", F.xxhash64("doc_id", "text_crc32", "size"))
    keyed = keyed.withColumn("arc", arc_of(F.expr("shiftrightunsigned(hash, 32)")))
    keyed = durable(keyed)

    by_arc = keyed.groupBy("arc").agg(F.sum("copies").alias("n")).collect()  # at most one row per virtual node
    counts = np.zeros(len(at), dtype=np.int64)
    for r in by_arc:
        counts[r["arc"]] = r["n"]
    cells = max(1, math.ceil(int(counts.max()) / cell_rows)) if len(by_arc) else 1
    plan = walk(counts, owner, shards)

    # ranks: cells are ring intervals inside an arc's rows (by the low hash bits), each ranked alone
    keyed = keyed.withColumn("cell", F.expr(f"cast(pmod(hash, {cells}) as int)"))
    before = W.partitionBy("arc").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    offsets = keyed.groupBy("arc", "cell").agg(F.sum("copies").alias("n"))
    offsets = offsets.select("arc", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("cell_start"))
    inside = W.partitionBy("arc", "cell").orderBy("hash", "doc_id", "text_crc32", "size")
    ranked = keyed.withColumn(
        "ahead", F.coalesce(F.sum("copies").over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    )
    ranked = ranked.join(offsets, ["arc", "cell"]).withColumn("first", F.col("cell_start") + F.col("ahead"))
    unfolded = ranked.withColumn("rank", F.explode(F.expr("sequence(first, first + copies - 1)")))
    intervals = spark.createDataFrame(plan or [(-1, 0, 0, 0, 0)], "p_arc int, lo long, hi long, shard int, slot0 long")
    placed = unfolded.join(
        F.broadcast(intervals), (F.col("arc") == F.col("p_arc")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    )
    return placed.select(
        "doc_id", "size", "text_crc32", "shard", (F.col("slot0") + F.col("rank") - F.col("lo")).alias("slot")
    )


def query(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return assign_shards(docs).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
