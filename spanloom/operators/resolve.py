"""Resolving overlaps: connected spans become one, and what they covered stays covered."""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.functions.spans import category_rank, occurrence_id, piece
from spanloom.schemas import FINDING_COLUMNS

_SEGMENT = ["doc_id", "segment_id"]


def with_ids(findings: DataFrame) -> DataFrame:
    """Findings with their canonical occurrence id."""
    return findings.withColumn("id", occurrence_id(F.col("segment_id"), F.col("start"), F.col("end"), F.col("category"), F.col("text")))


def islands(findings: DataFrame) -> DataFrame:
    """``island`` numbers the connected spans of a segment; spans that only touch are apart."""
    order = W.partitionBy(*_SEGMENT).orderBy("start", "end", "id", "detector", F.col("entity_key"))
    reach = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    opens = F.when(F.col("start") >= F.coalesce(reach, F.lit(-1)), 1).otherwise(0)
    return findings.withColumn("__open", opens).withColumn("island", F.sum("__open").over(order.rowsBetween(W.unboundedPreceding, 0))).drop("__open")


def merged(components: DataFrame, segments: DataFrame, detector: str = "resolver:coverage_union", identity: bool = True) -> DataFrame:
    """One row an island: the union span, first category by priority, best score, provenance, agreed key."""
    grouped = components.groupBy(*_SEGMENT, "island").agg(
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        F.min(F.struct(category_rank(F.col("category")).alias("rank"), F.col("category").alias("name"))).alias("cat"),
        F.max("score").alias("score"),
        F.count(F.lit(1)).alias("members"),
        F.array_sort(F.collect_set("category")).alias("categories"),
        F.array_sort(F.collect_set("detector")).alias("detectors"),
        F.array_sort(F.collect_list("id")).alias("finding_ids"),
        F.collect_set(F.when(F.length("entity_key") > 0, F.col("entity_key"))).alias("keys"),
        F.bool_and(F.coalesce(F.length("entity_key") > 0, F.lit(False))).alias("all_keyed"),
        F.collect_set(F.when(F.length("entity_key") > 0, F.struct("start", "end"))).alias("keyed_spans"),
    )
    whole = F.array_contains("keyed_spans", F.struct("start", "end"))
    key = F.when((F.size("keys") == 1) & (F.col("all_keyed") | whole), F.get("keys", F.lit(0)))
    seg = segments.select(*_SEGMENT, F.col("text").alias("__t"))
    met = grouped.join(seg, _SEGMENT).withColumn("text", piece(F.col("__t"), F.col("start"), F.col("end")))
    out = met.select(
        *_SEGMENT, "island", "members", "start", "end", "text", F.col("cat.name").alias("category"), "score", F.lit(detector).alias("detector"),
        (key if identity else F.lit(None).cast("string")).alias("entity_key"), F.lit(False).alias("review_only"),
        F.struct("categories", "detectors", "finding_ids").alias("provenance"),
    )
    return with_ids(out)


def resolve(findings: DataFrame, segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(selected, suppressed).  A span alone in its island passes unchanged; review-only ones take no part."""
    proposals = islands(with_ids(findings).where("not review_only"))
    sized = proposals.withColumn("members", F.count(F.lit(1)).over(W.partitionBy(*_SEGMENT, "island")))
    none = F.lit(None).cast("struct<categories:array<string>,detectors:array<string>,finding_ids:array<string>>")
    alone = sized.where("members = 1").select("id", *FINDING_COLUMNS, none.alias("provenance"))
    unions = merged(sized.where("members > 1").drop("members"), segments)
    selected = alone.unionByName(unions.select("id", *FINDING_COLUMNS, "provenance"))
    into = unions.select(*_SEGMENT, "island", F.col("id").alias("merged_into"))
    suppressed = sized.where("members > 1").join(into, [*_SEGMENT, "island"]).select("id", *FINDING_COLUMNS, F.lit("overlap_merged").alias("reason"), "merged_into")
    return selected, suppressed


def coverage_union(findings: DataFrame, segments: DataFrame) -> DataFrame:
    """The comparison form: single spans are rewritten too, no identity is kept, review rows stay as evidence."""
    unions = merged(islands(with_ids(findings).where("not review_only")), segments, detector="union:coverage", identity=False)
    return unions.select(*FINDING_COLUMNS).unionByName(findings.where("review_only").select(*FINDING_COLUMNS))


def combine(primary: DataFrame, secondary: DataFrame, review_only: bool = False) -> DataFrame:
    """Union of two detectors' findings; on equal (span, category, detector) the first one's row stays."""
    key = ["doc_id", "segment_id", "start", "end", "category", "detector"]
    order = W.partitionBy(*key).orderBy(F.col("score").desc(), F.col("text"), F.col("entity_key"))
    once = secondary.join(primary.select(*key).distinct(), key, "left_anti").withColumn("__n", F.row_number().over(order)).where("__n = 1")
    if review_only:
        once = once.withColumn("review_only", F.lit(True))
    return primary.select(*FINDING_COLUMNS).unionByName(once.select(*FINDING_COLUMNS))


def resolve_greedy(findings: DataFrame) -> DataFrame:
    """Older projections: highest score first, longer first, then by id; later overlaps are suppressed.

    The choice depends on all earlier choices of a segment, so each segment is one group.
    """
    ided = with_ids(findings).where("not review_only").dropDuplicates(["doc_id", "segment_id", "id"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(size=pdf["end"] - pdf["start"]).sort_values(["score", "size", "id"], ascending=[False, False, True])
        starts: list[int] = []  # taken spans don't overlap, so their ends are in order too
        ends: list[int] = []
        reasons = []
        for a, b in zip(pdf["start"], pdf["end"], strict=True):
            at = bisect.bisect_left(starts, b)
            clash = at > 0 and ends[at - 1] > a
            reasons.append("overlap_priority" if clash else None)
            if not clash:
                starts.insert(at, a)
                ends.insert(at, b)
        return pdf.assign(reason=reasons)[["id", *FINDING_COLUMNS, "reason"]]

    cols = ided.select("id", *FINDING_COLUMNS)
    return cols.groupBy(*_SEGMENT).applyInPandas(run, "id string, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cols.schema.fields[1:]) + ", reason string")


def overlaps(a: str, b: str) -> Column:
    """Interval overlap of two aliased inputs inside one segment."""
    return (F.col(f"{a}.doc_id") == F.col(f"{b}.doc_id")) & (F.col(f"{a}.segment_id") == F.col(f"{b}.segment_id")) & (F.col(f"{a}.start") < F.col(f"{b}.end")) & (F.col(f"{b}.start") < F.col(f"{a}.end"))


def slice_violations(findings: DataFrame, segments: DataFrame) -> DataFrame:
    """Findings whose text is not their slice, or whose segment or bounds are wrong; never shows text."""
    seg = segments.select(*_SEGMENT, F.col("text").alias("__t"))
    met = findings.join(seg, _SEGMENT, "left")
    code = (
        F.when(F.col("__t").isNull(), "unknown_segment")
        .when(~((F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.length("__t"))), "bad_bounds")
        .when(piece(F.col("__t"), F.col("start"), F.col("end")) != F.col("text"), "text_mismatch")
    )
    return met.withColumn("violation", code).where("violation is not null").select(*_SEGMENT, "start", "end", "category", "violation")
