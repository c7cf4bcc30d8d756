"""Segments from tables and annotated corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.schemas import CORPUS, LOCATOR


def segment_id(number: Column) -> Column:
    """'s' and the 1-based number, six digits at least."""
    return F.concat(F.lit("s"), F.when(number < 1_000_000, F.lpad(number.cast("string"), 6, "0")).otherwise(number.cast("string")))


def _no_locator() -> Column:
    return F.lit(None).cast(LOCATOR.simpleString()).alias("locator")


def from_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One segment a line; a null text has none."""
    lines = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.posexplode(F.split(text_col, "\n", -1)).alias("p", "text"))
    return lines.select("doc_id", (F.col("p") + 1).alias("seg_no"), segment_id(F.col("p") + 1).alias("segment_id"), "text", _no_locator())


def from_conversations(turns: DataFrame) -> DataFrame:
    """One segment a turn, in turn order."""
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    n = F.row_number().over(order)
    rows = turns.select(F.col("conv_id").cast("string").alias("doc_id"), n.alias("seg_no"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.select("doc_id", "seg_no", segment_id(F.col("seg_no")).alias("segment_id"), "text", _no_locator())


def read_corpus(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(segments, gold) of annotated documents in JSON, read with a fixed schema."""
    docs = spark.read.schema(CORPUS).json(path, multiLine=True)
    return explode_corpus(docs)


def explode_corpus(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    seg = docs.select(F.col("id").alias("doc_id"), F.posexplode("segments").alias("p", "s"))
    segments = seg.select("doc_id", (F.col("p") + 1).alias("seg_no"), F.col("s.id").alias("segment_id"), F.col("s.text").alias("text"), _no_locator())
    gold = docs.select(F.col("id").alias("doc_id"), F.explode("annotations").alias("a")).select("doc_id", "a.*")
    return segments, gold


def summary(segments: DataFrame) -> DataFrame:
    """One row a document: segments and characters."""
    return segments.groupBy("doc_id").agg(F.count(F.lit(1)).alias("segments"), F.sum(F.length("text")).cast("long").alias("characters"))


def segment_violations(segments: DataFrame, most_segments: int = 100_000, most_bytes: int = 16 << 20) -> DataFrame:
    """doc_id, violation: repeated ids, too many segments, texts that are too long."""
    by = segments.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("segment_id").alias("d"), F.max(F.octet_length("text")).alias("b"))
    found = F.array_compact(F.array(F.when(F.col("n") != F.col("d"), F.lit("duplicate_segment")), F.when(F.col("n") > most_segments, F.lit("too_many_segments")), F.when(F.col("b") > most_bytes, F.lit("text_too_long"))))
    return by.select("doc_id", F.explode(found).alias("violation"))


def write_metrics(rows: DataFrame, path: str) -> None:
    """JSON that never overwrites."""
    rows.write.mode("errorifexists").json(path)
