"""Ranking what a reviewer should read next.

Scores are sums of a few fixed boosts, at most 1, with six places; they are no
probabilities.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.functions.spans import is_blank, piece, round6
from spanloom.operators.rules import signals
from spanloom.schemas import SENSITIVE_CATEGORIES

_SEGMENT = ["doc_id", "segment_id"]
SAMPLE_SEED = "review-remainder-v1"


def _reasons(*pairs: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, name in pairs]))


def rank_passages(segments: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """doc_id, segment_id, score, reasons: cues in the text and signals of its own findings."""
    rows = segments.select(*_SEGMENT, "text")
    if findings is None:
        rows = rows.select("*", F.lit(0).alias("n"), *[F.lit(False).alias(c) for c in ("low", "double", "inner")])
    else:
        size = segments.select(*_SEGMENT, F.length("text").alias("__n"))
        own = findings.join(size, _SEGMENT).groupBy(*_SEGMENT).agg(
            F.count(F.lit(1)).alias("n"),
            F.bool_or(F.col("score") < 0.75).alias("low"),
            (F.count_distinct(F.struct("start", "end")) < F.count(F.lit(1))).alias("double"),
            F.bool_or((F.col("start") > 0) & (F.col("end") < F.col("__n"))).alias("inner"),
        )
        rows = rows.join(own, _SEGMENT, "left").fillna({"n": 0, "low": False, "double": False, "inner": False})
    s = signals(F.col("text"))
    rows = rows.select("*", s["personal"].alias("p"), s["direct"].alias("d"), s["token"].alias("t"))
    has = F.col("n") > 0
    token = ~F.col("d") & F.col("t")
    boost = lambda c, x: F.when(c, F.lit(x)).otherwise(F.lit(0.0))
    score = (
        F.when(has, F.least(F.lit(0.48), 0.18 * F.col("n"))).otherwise(F.lit(0.0)) + boost(F.col("low"), 0.24) + boost(F.col("double"), 0.12)
        + boost(F.col("inner"), 0.08) + boost(F.col("p"), 0.22) + boost(F.col("d"), 0.35) + boost(token, 0.10)
    )
    found = _reasons(
        (has, "pii_findings_present"), (F.col("low"), "low_confidence_candidates"), (F.col("double"), "overlapping_candidates"), (F.col("inner"), "partially_redacted_passage"),
        (F.col("p"), "personal_context_terms"), (F.col("d"), "identifier_like_text"), (token, "identifier_like_token"),
    )
    reasons = F.when(F.size(found) == 0, F.array(F.lit("no_candidate_signal"))).otherwise(found)
    return rows.select(*_SEGMENT, round6(F.least(F.lit(1.0), score)).alias("score"), reasons.alias("reasons"))


def masked_findings(findings: DataFrame, masks: DataFrame, segments: DataFrame) -> DataFrame:
    """Findings with ``masked``: masks cover them but for white space.

    A finding's masks are sorted and the gaps between them looked at; nothing is
    spread out by position.
    """
    grouped = masks.groupBy(*_SEGMENT).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("__m"))
    seg = segments.select(*_SEGMENT, F.col("text").alias("__t"))
    met = findings.join(seg, _SEGMENT).join(grouped, _SEGMENT, "left")
    t, a, b = F.col("__t"), F.col("start"), F.col("end")
    state = F.struct(a.cast("int").alias("at"), F.lit(True).alias("ok"))

    def step(s: Column, m: Column) -> Column:
        skip = (m["end"] <= s["at"]) | (s["at"] >= b)
        gap_ok = (m["start"] <= s["at"]) | ((m["start"] < b) & is_blank(piece(t, s["at"], m["start"])))
        stop = (m["start"] >= b) & (m["start"] > s["at"])
        return F.when(skip | stop, s).otherwise(F.struct(F.greatest(s["at"], m["end"]).cast("int").alias("at"), (s["ok"] & gap_ok).alias("ok")))

    end = F.aggregate(F.coalesce("__m", F.array().cast("array<struct<start:int,end:int>>")), state, step)
    met = met.withColumn("__s", end)
    covered = F.col("__s.ok") & is_blank(piece(t, F.col("__s.at"), b))
    return met.withColumn("masked", covered).select(*findings.columns, "masked")


def finding_evidence(findings: DataFrame, masks: DataFrame, segments: DataFrame) -> DataFrame:
    """doc_id, segment_id, reason, boost of every finding that is not fully masked."""
    every = findings.select(*_SEGMENT, "start", "end", "category", "score")
    rivals = every.groupBy(*_SEGMENT, "start", "end", "category").agg(F.max("score").alias("score")).alias("o")
    left = masked_findings(findings, masks, segments).where("not masked").drop("masked")
    spans = left.select(*_SEGMENT, "start", "end", "category", "score").distinct().alias("f")
    other = (
        (F.col("f.doc_id") == F.col("o.doc_id")) & (F.col("f.segment_id") == F.col("o.segment_id")) & (F.col("f.start") < F.col("o.end")) & (F.col("o.start") < F.col("f.end"))
        & ((F.col("f.start") != F.col("o.start")) | (F.col("f.end") != F.col("o.end")) | (F.col("f.category") != F.col("o.category"))) & (F.col("o.score") >= F.col("f.score"))
    )
    beaten = spans.join(rivals, other, "left_semi").withColumn("beaten", F.lit(True))
    met = left.join(beaten, [*_SEGMENT, "start", "end", "category", "score"], "left")
    c = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("score")))
    one = lambda cond, reason, boost: F.when(cond, F.struct(F.lit(reason).alias("reason"), boost.cast("double").alias("boost")))
    rows = F.array_compact(
        F.array(
            one(F.col("review_only"), "review_only_candidate", 0.12 + 0.16 * c),
            one(~F.col("review_only"), "unresolved_candidate", 0.08 + 0.12 * c),
            one(F.col("category").isin(SENSITIVE_CATEGORIES), "sensitive_identifier_candidate", F.lit(0.20)),
            one(F.col("score") < 0.75, "low_confidence_candidate", 0.08 * (1 - c)),
            one(F.coalesce("beaten", F.lit(False)), "overlap_suppressed_candidate", F.lit(0.14)),
        )
    )
    return met.select(*_SEGMENT, "start", "end", F.explode(rows).alias("r")).select(*_SEGMENT, "start", "end", "r.*")


def rank_retained(segments: DataFrame, rendered: DataFrame, findings: DataFrame, masks: DataFrame, sample_size: int = 5, sample_seed: str = SAMPLE_SEED) -> DataFrame:
    """Cues of the rendered text plus evidence of unmasked findings; a seeded sample of the quiet rest."""
    proof = finding_evidence(findings, masks, segments)
    best = proof.groupBy(*_SEGMENT, "reason").agg(F.max("boost").alias("boost"), F.min(F.struct("start", "end")).alias("at"))
    summed = best.groupBy(*_SEGMENT).agg(F.sum("boost").alias("boost"), F.array_sort(F.collect_list(F.struct("at", "reason"))).alias("why"))
    met = rank_passages(rendered).join(summed, _SEGMENT, "left")
    score = round6(F.least(F.lit(1.0), F.col("score") + F.coalesce("boost", F.lit(0.0))))
    more = F.coalesce(F.transform("why", lambda w: w["reason"]), F.array().cast("array<string>"))
    ranked = met.select(*_SEGMENT, score.alias("score"), F.concat("reasons", more).alias("reasons"), F.col("boost").isNull().alias("quiet"))
    if not sample_size:
        return ranked.drop("quiet")
    sampled = remainder_sample(ranked.where("quiet"), sample_size, sample_seed).withColumn("__s", F.lit(True))
    out = ranked.join(sampled, _SEGMENT, "left")
    reasons = F.when(F.coalesce("__s", F.lit(False)), F.array_append("reasons", F.lit("remainder_sample"))).otherwise(F.col("reasons"))
    return out.select(*_SEGMENT, "score", reasons.alias("reasons"))


def remainder_sample(quiet: DataFrame, size: int, seed: str = SAMPLE_SEED) -> DataFrame:
    """Of each document's quieter half, the first ``size`` passages in hash order."""
    queue = W.partitionBy("doc_id").orderBy(F.col("score").desc(), F.col("segment_id"))
    whole = W.partitionBy("doc_id")
    low = quiet.withColumn("__n", F.row_number().over(queue)).withColumn("__c", F.count(F.lit(1)).over(whole)).where("__n > floor(__c / 2)")
    draw = W.partitionBy("doc_id").orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("segment_id")), 256), F.col("segment_id"))
    return low.withColumn("__k", F.row_number().over(draw)).where(F.col("__k") <= size).select(*_SEGMENT)
