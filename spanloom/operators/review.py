"""Groups, tokens, rendering, masks, decision tables and their validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.functions.spans import fold, group_id, overlay, token, token_prefix
from spanloom.schemas import GROUP_ACTIONS, OCCURRENCE_ACTIONS, OUTCOMES, PASSAGE_ACTIONS

_SEGMENT = ["doc_id", "segment_id"]


def with_groups(selected: DataFrame) -> DataFrame:
    return selected.withColumn("group_id", group_id(F.col("category"), F.col("entity_key"), F.col("text")))


def entity_groups(selected: DataFrame, segments: DataFrame, counters: DataFrame | None = None, old: DataFrame | None = None) -> DataFrame:
    """One row a document and group: category, token, aliases and occurrences in order of appearance.

    Tokens number the new groups of a category by first appearance, go on from the
    counters of earlier revisions, and skip numbers whose token some text already
    has: free numbers are candidates minus taken ones, and the k-th group takes the
    k-th free number.
    """
    keyed = with_groups(selected)
    place = F.struct("segment_id", "start", "id")
    groups = keyed.groupBy("doc_id", "group_id").agg(
        F.min_by("category", place).alias("category"),
        F.min(place).alias("first"),
        F.array_sort(F.collect_list(F.struct(F.col("segment_id"), F.col("start"), F.col("id"), F.col("text")))).alias("members"),
    )
    groups = groups.select(
        "doc_id", "group_id", "category", "first", token_prefix(F.col("category")).alias("prefix"),
        F.transform("members", lambda m: m["id"]).alias("occurrence_ids"), F.array_distinct(F.transform("members", lambda m: m["text"])).alias("aliases"),
    )
    kept = ["doc_id", "group_id", "token", "action", "replacement", "note"]
    new = groups
    if old is not None:
        new = groups.join(old.select("doc_id", "group_id"), ["doc_id", "group_id"], "left_anti")
    numbered = new.withColumn("k", F.row_number().over(W.partitionBy("doc_id", "prefix").orderBy("first", "group_id")))
    base = numbered.groupBy("doc_id", "prefix").agg(F.count(F.lit(1)).alias("wanted"))
    if counters is not None:
        base = base.join(counters.select("doc_id", "prefix", F.col("n").alias("used")), ["doc_id", "prefix"], "left")
    else:
        base = base.withColumn("used", F.lit(0))
    used = F.coalesce("used", F.lit(0))
    # tokens that texts already hold, by prefix and number
    seen = segments.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"([A-Z0-9_]+_)(\d{3,})"), F.lit(0))).alias("t")).distinct()
    near = base.join(seen, "doc_id", "left").where(F.col("t").isNull() | F.contains(F.col("t"), F.concat("prefix", F.lit("_"))))
    digits = F.regexp_extract("t", r"(\d{3,})$", 1)
    # a token also occurs inside longer digit runs: every prefix of the run counts
    run = F.transform(F.sequence(F.lit(3), F.greatest(F.length(digits), F.lit(3))), lambda n: F.substring(digits, F.lit(1), n))
    taken = near.where("t is not null").select("doc_id", "prefix", F.explode(run).alias("d")).where("length(d) >= 3 and length(d) <= 9 and (length(d) = 3 or d not like '0%')")
    taken = taken.select("doc_id", "prefix", F.col("d").cast("int").alias("n")).distinct()
    slack = taken.groupBy("doc_id", "prefix").agg(F.count(F.lit(1)).alias("slack"))
    free = base.join(slack, ["doc_id", "prefix"], "left").select("doc_id", "prefix", F.explode(F.sequence(used + 1, used + F.col("wanted") + F.coalesce("slack", F.lit(0)))).alias("n"))
    free = free.withColumn("n", F.col("n").cast("int")).join(taken, ["doc_id", "prefix", "n"], "left_anti")
    free = free.withColumn("k", F.row_number().over(W.partitionBy("doc_id", "prefix").orderBy("n")))
    made = numbered.join(free, ["doc_id", "prefix", "k"]).select(
        "doc_id", "group_id", token(F.col("category"), F.col("n")).alias("token"), F.lit("accept").alias("action"), F.lit("").alias("replacement"), F.lit("").alias("note")
    )
    decided = made if old is None else made.unionByName(old.select(*kept))
    return groups.join(decided, ["doc_id", "group_id"]).select("doc_id", "group_id", "category", "token", "action", "replacement", "note", "occurrence_ids", "aliases")


def token_counters(groups: DataFrame) -> DataFrame:
    """doc_id, prefix, n: the last number used of each prefix."""
    number = F.regexp_extract("token", r"_(\d+)$", 1).cast("int")
    return groups.groupBy("doc_id", token_prefix(F.col("category")).alias("prefix")).agg(F.max(number).alias("n"))


def effective(selected: DataFrame, groups: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """Selected findings with the action that holds and what is written in their place.

    An occurrence's own decision comes before its group's, unless it inherits.
    """
    keyed = with_groups(selected)
    g = groups.select("doc_id", "group_id", "token", F.col("action").alias("g_action"), F.col("replacement").alias("g_text"))
    met = keyed.join(g, ["doc_id", "group_id"])
    if decisions is not None:
        d = decisions.select("doc_id", "id", F.col("action").alias("o_action"), F.col("replacement").alias("o_text"))
        met = met.join(d, ["doc_id", "id"], "left")
    else:
        met = met.withColumn("o_action", F.lit("inherit")).withColumn("o_text", F.lit(""))
    own = F.coalesce("o_action", F.lit("inherit")) != "inherit"
    met = met.withColumn("action", F.when(own, F.col("o_action")).otherwise(F.col("g_action")))
    text = F.coalesce(F.when(own, F.col("o_text")).otherwise(F.col("g_text")), F.lit(""))
    written = F.when(F.col("action") == "retain", F.col("text")).when(F.col("action") == "remove", "").when(F.col("action") == "accept", F.col("token")).otherwise(text)
    return met.withColumn("replacement", written).drop("g_action", "g_text", "o_action", "o_text")


def render(segments: DataFrame, effects: DataFrame) -> DataFrame:
    """Segments with the effects of ``effective`` written into their text."""
    cuts = effects.groupBy(*_SEGMENT).agg(F.collect_list(F.struct("start", "end", "replacement")).alias("__c"))
    met = segments.join(cuts, _SEGMENT, "left")
    return met.withColumn("text", F.when(F.col("__c").isNull(), F.col("text")).otherwise(overlay(F.col("text"), F.col("__c")))).select(*segments.columns)


def render_placeholder(segments: DataFrame, selected: DataFrame, placeholder: str = "<REDACTED>") -> DataFrame:
    return render(segments, selected.select(*_SEGMENT, "start", "end", F.lit(placeholder).alias("replacement")))


def masked_intervals(effects: DataFrame) -> DataFrame:
    """Spans that no longer show: accepted and removed ones, and replacements that don't hold the old text."""
    hides = F.col("action").isin("accept", "remove") | ((F.col("action") == "replace") & ~F.contains(fold(F.col("replacement")), fold(F.col("text"))))
    return effects.where(hides).select(*_SEGMENT, "start", "end")


def group_view(groups: DataFrame, selected: DataFrame, segments: DataFrame) -> DataFrame:
    """The review table of groups."""
    first = groups.select("*", F.get("occurrence_ids", F.lit(0)).alias("f_id")).join(selected.select("doc_id", F.col("id").alias("f_id"), "segment_id"), ["doc_id", "f_id"])
    met = first.join(segments.select(*_SEGMENT, F.col("text").alias("context")), _SEGMENT)
    return met.select(
        "doc_id", F.col("group_id").alias("id"), F.get("aliases", F.lit(0)).alias("source"), F.array_join("aliases", " | ").alias("aliases"), "category", "token",
        F.size("occurrence_ids").alias("count"), "context", "action", "replacement", "note",
    )


def occurrence_view(selected: DataFrame, segments: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """The review table of occurrences."""
    met = with_groups(selected).join(segments.select(*_SEGMENT, F.col("text").alias("context")), _SEGMENT)
    if decisions is not None:
        met = met.join(decisions.select("doc_id", "id", "action", "replacement", "note"), ["doc_id", "id"], "left")
    else:
        met = met.select("*", *[F.lit(None).cast("string").alias(c) for c in ("action", "replacement", "note")])
    return met.select(
        "doc_id", "id", "group_id", "segment_id", F.col("text").alias("source"), "context",
        F.coalesce("action", F.lit("inherit")).alias("action"), F.coalesce("replacement", F.lit("")).alias("replacement"), F.coalesce("note", F.lit("")).alias("note"),
    )


def passage_view(source: DataFrame, rendered: DataFrame, ranked: DataFrame, reviews: DataFrame | None = None) -> DataFrame:
    """The review table of passages; an outcome holds only while the text it was given for is unchanged."""
    s = source.select(*_SEGMENT, F.col("text").alias("source"))
    met = ranked.join(s, _SEGMENT).join(rendered.select(*_SEGMENT, "text"), _SEGMENT)
    if reviews is not None:
        met = met.join(reviews.select(*_SEGMENT, F.col("outcome").alias("r_outcome"), F.col("note").alias("r_note"), "text_sha256"), _SEGMENT, "left")
    else:
        met = met.select("*", *[F.lit(None).cast("string").alias(c) for c in ("r_outcome", "r_note", "text_sha256")])
    valid = F.col("text_sha256") == F.sha2("text", 256)
    return met.select(
        "doc_id", F.col("segment_id").alias("id"), "source", "text", "score", F.array_join("reasons", "; ").alias("reasons"),
        F.when(valid, F.col("r_outcome")).otherwise("uninspected").alias("outcome"), F.lit("keep").alias("action"), F.lit("").alias("replacement"), F.coalesce("r_note", F.lit("")).alias("note"),
    )


IMMUTABLE = {
    "groups": ["source", "aliases", "category", "token", "count", "context"],
    "passages": ["source", "text", "score", "reasons"],
    "occurrences": ["group_id", "segment_id", "source", "context"],
}
ACTIONS = {"groups": GROUP_ACTIONS, "passages": PASSAGE_ACTIONS, "occurrences": OCCURRENCE_ACTIONS}


def decision_violations(table: str, trusted: DataFrame, returned: DataFrame) -> DataFrame:
    """doc_id, id, violation for a returned decision table against the trusted one; must be empty.

    Ids must match one to one, immutable columns be unchanged, enumerations hold, a
    replacement be there exactly if the action is to replace (and a miss be
    corrected).  Texts never show.
    """
    columns = IMMUTABLE[table]
    count = returned.groupBy("doc_id", "id").agg(F.count(F.lit(1)).alias("__n"))
    t = trusted.select("doc_id", "id", F.lit(True).alias("__t"), *[F.col(c).alias(f"t_{c}") for c in columns])
    met = returned.withColumn("__r", F.lit(True)).join(t, ["doc_id", "id"], "full_outer").join(count, ["doc_id", "id"], "left")
    changed: Column = F.lit(False)
    for c in columns:
        changed = changed | ~F.col(c).eqNullSafe(F.col(f"t_{c}"))
    text = F.coalesce("replacement", F.lit(""))
    checks = [
        (F.col("__r").isNull(), "missing_id"),
        (F.col("__t").isNull(), "foreign_id"),
        (F.col("__n") > 1, "duplicate_id"),
        (changed, "immutable_changed"),
        (~F.col("action").isin(*ACTIONS[table]) | F.col("action").isNull(), "bad_action"),
        ((F.col("action") == "replace") & (F.trim(text) == ""), "replacement_missing"),
        ((F.col("action") != "replace") & (text != ""), "replacement_without_replace"),
    ]
    if table == "passages":
        checks += [
            (~F.col("outcome").isin(*OUTCOMES) | F.col("outcome").isNull(), "bad_outcome"),
            ((F.col("outcome") == "miss") & (F.col("action") == "keep"), "miss_without_correction"),
        ]
    found = F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, name in checks]))
    gone = F.when(F.col("__r").isNull(), F.array(F.lit("missing_id"))).when(F.col("__t").isNull(), F.array(F.lit("foreign_id"))).otherwise(found)
    return met.select("doc_id", "id", F.explode(gone).alias("violation")).distinct()


def orphan_occurrences(occurrences: DataFrame, groups: DataFrame) -> DataFrame:
    """Occurrences whose group is not in the table; must be empty."""
    return occurrences.join(groups.select("doc_id", F.col("id").alias("group_id")), ["doc_id", "group_id"], "left_anti").select("doc_id", "id", F.lit("orphan_occurrence").alias("violation"))


def status(groups: DataFrame, occurrences: DataFrame, passages: DataFrame) -> DataFrame:
    """One row a document: counts a reviewer sees."""
    g = groups.groupBy("doc_id").agg(F.count(F.lit(1)).alias("groups"), F.sum((F.col("action") != "accept").cast("long")).alias("edited_groups"))
    o = occurrences.groupBy("doc_id").agg(F.count(F.lit(1)).alias("occurrences"), F.sum((F.col("action") != "inherit").cast("long")).alias("edited_occurrences"))
    sampled = F.contains(F.col("reasons"), F.lit("remainder_sample"))
    inspected = F.col("outcome") != "uninspected"
    p = passages.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("passages"), F.sum(inspected.cast("long")).alias("inspected"), F.sum((F.col("outcome") == "miss").cast("long")).alias("misses"),
        F.sum(sampled.cast("long")).alias("sampled"), F.sum((sampled & inspected).cast("long")).alias("sample_inspected"),
    )
    return p.join(g, "doc_id", "left").join(o, "doc_id", "left").fillna(0)
