"""Measuring detection, masking and review effort against annotated spans.

Spans meet inside their segment only; coverage is worked out from interval gaps, so
nothing is spread out by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.functions.spans import count_non_space, is_blank, piece, ratio, words
from spanloom.operators.resolve import overlaps

_SEGMENT = ["doc_id", "segment_id"]
_KEY = [*_SEGMENT, "start", "end", "category"]
BUDGETS = (1, 3, 5, 10)


def matched_predictions(predictions: DataFrame, gold: DataFrame) -> DataFrame:
    """Predictions with ``exact`` (the first on a gold key) and ``partial`` (overlap with another gold span)."""
    order = W.partitionBy(*_KEY).orderBy(F.col("score").desc(), F.col("detector"), F.coalesce("entity_key", F.lit("")))
    g = gold.select(*_KEY).distinct().withColumn("is_gold", F.lit(True))
    met = predictions.join(g, _KEY, "left").withColumn("__n", F.row_number().over(order))
    met = met.withColumn("exact", F.coalesce("is_gold", F.lit(False)) & (F.col("__n") == 1)).drop("is_gold", "__n")
    spans = met.where("not exact").select(*_KEY).distinct().alias("p")
    other = F.lit(False)
    for c in ("start", "end", "category"):
        other = other | (F.col(f"p.{c}") != F.col(f"g.{c}"))
    near = spans.join(gold.select(*_KEY).alias("g"), overlaps("p", "g") & other, "left_semi").withColumn("near", F.lit(True))
    out = met.join(near, _KEY, "left")
    return out.withColumn("partial", ~F.col("exact") & F.coalesce("near", F.lit(False))).drop("near")


def misses(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """Gold spans that no prediction hits exactly."""
    return gold.join(predictions.select(*_KEY).distinct(), _KEY, "left_anti")


def metrics_by_category(predictions: DataFrame, gold: DataFrame) -> DataFrame:
    """category, gold, tp, fp, fn, precision, recall."""
    m = matched_predictions(predictions, gold)
    p = m.groupBy("category").agg(F.sum(F.col("exact").cast("long")).alias("tp"), F.sum((~F.col("exact")).cast("long")).alias("fp"))
    g = gold.groupBy("category").agg(F.count(F.lit(1)).alias("gold"))
    met = g.join(p, "category", "full_outer").fillna(0, ["gold", "tp", "fp"])
    return met.select("category", "gold", "tp", "fp", (F.col("gold") - F.col("tp")).alias("fn"), ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), ratio(F.col("tp"), F.col("gold")).alias("recall"))


def metrics_total(predictions: DataFrame, gold: DataFrame, segments: DataFrame) -> DataFrame:
    """One row of totals."""
    m = matched_predictions(predictions, gold).agg(
        F.count(F.lit(1)).alias("predictions"), F.coalesce(F.sum(F.col("exact").cast("long")), F.lit(0)).alias("tp"), F.coalesce(F.sum(F.col("partial").cast("long")), F.lit(0)).alias("partial_overlap_predictions")
    )
    g = gold.agg(F.count(F.lit(1)).alias("gold"))
    w = segments.agg(F.coalesce(F.sum(words(F.col("text"))), F.lit(0)).alias("words"))
    one = m.crossJoin(g).crossJoin(w)  # three single rows
    fp = F.col("predictions") - F.col("tp")
    return one.select(
        "gold", "predictions", "tp", fp.alias("fp"), (F.col("gold") - F.col("tp")).alias("fn"), ratio(F.col("tp"), F.col("predictions")).alias("precision"),
        ratio(F.col("tp"), F.col("gold")).alias("recall"), "partial_overlap_predictions", ratio(fp * 1000, F.col("words")).alias("false_positives_per_1000_words"), "words",
    )


def _covers(selected: DataFrame) -> DataFrame:
    return selected.groupBy(*_SEGMENT).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("__m"))


def _uncovered(text: Column, start: Column, end: Column, spans: Column) -> Column:
    """The pieces of a span outside sorted spans, concatenated."""
    spans = F.coalesce(spans, F.array().cast("array<struct<start:int,end:int>>"))
    state = F.struct(start.cast("int").alias("at"), F.lit("").alias("out"))

    def step(s: Column, m: Column) -> Column:
        upto = F.least(F.greatest(m["start"], s["at"]), end)
        return F.struct(F.greatest(s["at"], F.least(m["end"], end)).cast("int").alias("at"), F.concat(s["out"], piece(text, s["at"], upto)).alias("out"))

    done = F.aggregate(spans, state, step)
    return F.concat(done["out"], piece(text, done["at"], end))


def residuals(gold: DataFrame, selected: DataFrame, segments: DataFrame) -> DataFrame:
    """Gold spans with a non-space code point that no selected span covers, whatever its category."""
    met = gold.join(segments.select(*_SEGMENT, F.col("text").alias("__t")), _SEGMENT).join(_covers(selected), _SEGMENT, "left")
    rest = _uncovered(F.col("__t"), F.col("start"), F.col("end"), F.col("__m"))
    return met.where(~is_blank(rest)).select(*gold.columns)


def replacement_quality(gold: DataFrame, selected: DataFrame, segments: DataFrame) -> DataFrame:
    """One row: what is masked, and how much of it needn't be."""
    met = selected.select(*_SEGMENT, "start", "end").join(segments.select(*_SEGMENT, F.col("text").alias("__t")), _SEGMENT).join(_covers(gold), _SEGMENT, "left")
    own = count_non_space(piece(F.col("__t"), F.col("start"), F.col("end")))
    extra = count_non_space(_uncovered(F.col("__t"), F.col("start"), F.col("end"), F.col("__m")))
    met = met.select(own.alias("own"), extra.alias("extra"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return met.agg(
        F.count(F.lit(1)).alias("proposed_occurrences"),
        total(((F.col("own") > 0) & (F.col("own") == F.col("extra"))).cast("long")).alias("wholly_false_positive_occurrences"),
        total("own").alias("masked_nonwhitespace_characters"),
        total("extra").alias("non_pii_masked_characters"),
    )


def inspection_curve(ordered: DataFrame, residual: DataFrame) -> DataFrame:
    """doc_id, inspected_passages from 0, inspected_words, recovered, residual.

    ordered: doc_id, segment_id, position (from 1), text.
    """
    hits = residual.groupBy(*_SEGMENT).agg(F.count(F.lit(1)).alias("n"))
    total = residual.groupBy("doc_id").agg(F.count(F.lit(1)).alias("total"))
    steps = ordered.join(hits, _SEGMENT, "left").select("doc_id", "position", words(F.col("text")).alias("w"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    zero = ordered.select("doc_id").distinct().select("doc_id", F.lit(0).alias("position"), F.lit(0).cast("long").alias("w"), F.lit(0).cast("long").alias("n"))
    run = W.partitionBy("doc_id").orderBy("position").rowsBetween(W.unboundedPreceding, 0)
    met = steps.unionByName(zero).join(total, "doc_id", "left")
    got = F.sum("n").over(run)
    return met.select(
        "doc_id", F.col("position").alias("inspected_passages"), F.sum("w").over(run).alias("inspected_words"), got.alias("recovered"),
        (F.coalesce("total", F.lit(0)) - got).cast("long").alias("residual"),
    )


def ranked_order(ranked: DataFrame, segments: DataFrame) -> DataFrame:
    """Segments in the order a reviewer gets them."""
    order = W.partitionBy("doc_id").orderBy(F.col("score").desc(), F.col("segment_id"))
    return ranked.withColumn("position", F.row_number().over(order)).join(segments.select(*_SEGMENT, "text"), _SEGMENT).select(*_SEGMENT, "position", "text")


def effort(curve: DataFrame, budgets: tuple[int, ...] = BUDGETS) -> DataFrame:
    """doc_id, passages and words until nothing is left, and what is left after fixed budgets."""
    done = F.col("residual") == 0
    last = F.max("inspected_passages")
    after = [F.min(F.when(F.col("inspected_passages") <= b, F.col("residual"))).alias(f"residual_after_{b}") for b in budgets]
    return curve.groupBy("doc_id").agg(
        F.min(F.when(done, F.col("inspected_passages"))).alias("passages_to_recover_all"), F.min(F.when(done, F.col("inspected_words"))).alias("words_to_recover_all"), last.alias("passages"), *after
    )


def document_residuals(gold: DataFrame, predictions: DataFrame, residual: DataFrame) -> DataFrame:
    """Per document: gold, exact hits, exact misses, residuals."""
    m = misses(gold, predictions).groupBy("doc_id").agg(F.count(F.lit(1)).alias("candidate_exact_misses"))
    r = residual.groupBy("doc_id").agg(F.count(F.lit(1)).alias("residual_misses"))
    g = gold.groupBy("doc_id").agg(F.count(F.lit(1)).alias("gold_annotations"))
    met = g.join(m, "doc_id", "left").join(r, "doc_id", "left").fillna(0)
    return met.select("doc_id", "gold_annotations", (F.col("gold_annotations") - F.col("candidate_exact_misses")).alias("detected_exact"), "candidate_exact_misses", "residual_misses")


def residual_categories(residual: DataFrame) -> DataFrame:
    return residual.groupBy("doc_id", "category").agg(F.count(F.lit(1)).alias("residual"))


def corpus_violations(segments: DataFrame, gold: DataFrame) -> DataFrame:
    """doc_id, violation: repeated segment ids, unknown segments, bad bounds, repeated gold keys; must be empty."""
    twice = segments.groupBy(*_SEGMENT).count().where("count > 1").select("doc_id", F.lit("duplicate_segment").alias("violation"))
    met = gold.join(segments.select(*_SEGMENT, F.length("text").alias("__n")), _SEGMENT, "left")
    bad = met.select("doc_id", F.when(F.col("__n").isNull(), "unknown_segment").when(~((F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.col("__n"))), "bad_bounds").alias("violation")).where("violation is not null")
    again = gold.groupBy(*_KEY).count().where("count > 1").select("doc_id", F.lit("duplicate_gold").alias("violation"))
    return twice.unionByName(bad).unionByName(again)


def compare_variants(variants: dict[str, DataFrame], gold: DataFrame, segments: DataFrame) -> DataFrame:
    """One row of totals a variant."""
    out = None
    for name, predictions in sorted(variants.items()):
        row = metrics_total(predictions, gold, segments).select(F.lit(name).alias("variant"), "*")
        out = row if out is None else out.unionByName(row)
    return out
