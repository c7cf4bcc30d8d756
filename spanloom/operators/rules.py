"""Rule detectors: e-mail, phone, IBAN, identifiers after a cue word, policy aliases.

All rules of a segment are one projection: an array of findings that is unfolded
once, so text is read once and nothing is exchanged.  A rule that the policy turns
off is not in the plan at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.spans import after, before, find_spans, iban_valid, literal, piece, round6, whole_word
from spanloom.policy import Policy
from spanloom.schemas import FINDING_COLUMNS

# What counts as an e-mail address, a telephone number and an IBAN, in Java's syntax.
_LOCAL = r"A-Za-z0-9.!#$%&'*+/=?^_`{|}~\-"
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9\-]{0,61}[A-Za-z0-9])?"
EMAIL = rf"(?<![{_LOCAL}])[{_LOCAL}]+@{_LABEL}(?:\.{_LABEL})+(?![A-Za-z0-9\-])"
#: Separators inside a number are space, full stop and slash; a hyphen only on request.
PHONE = r"(?U)(?<!\w)(?:\+\d{1,3}[ .\-]?)?\(?\d{2,5}\)?[ ./]?(?:\d[ ./]?){5,13}\d(?!\w)"
PHONE_WITH_HYPHENS = PHONE.replace("[ ./]", r"[ ./\-]")
IBAN = r"(?i)(?<![A-Z0-9])[A-Z]{2}\d{2}(?:[ \-]?[A-Z0-9]){10,32}(?![A-Z0-9])"
_VALUE = r"\s*[:#\-]?\s*((?=[A-Z0-9./_\-]*\d)[A-Z0-9][A-Z0-9./_\-]{3,31})"
# Cue words of the identifier rules.
CUSTOMER_CUE = r"\b(?:kunden?(?:nummer|nr\.?)|customer(?:\s*(?:number|no\.?|id)))\b"
DEPOT_CUE = r"\bdepot(?:\s*[\-/]?\s*(?:nummer|nr\.?|kennung|konto))?(?!\w)"
ACCOUNT_CUE = r"\b(?:konto(?:nummer|nr\.?)|account(?:\s*(?:number|no\.?|id)))\b"
PHONE_CUE = r"(?iuU)\b(?:telefon|tel\.?|mobil|handy|phone|fax|anrufen|erreichbar)\b"
PERSONAL_CUE = (
    r"(?iuU)\b(?:kunde|kundin|herr|frau|mitarbeiter(?:in)?|telefon|mobil|mail|e-?mail|kontonummer|iban|depot|adresse|wohnort|geburtsdatum)\b"
)
DATE_LIKE = r"^(?:\d{4}[\-/.]\d{1,2}[\-/.]\d{1,2}|\d{1,2}[./]\d{1,2}[./]\d{2,4})$"
IDENTIFIER_TOKEN = r"(?iU)(?<!\w)(?=[A-Z0-9./_\-]*[A-Z])(?=[A-Z0-9]*\d)[A-Z0-9][A-Z0-9./_\-]{5,31}(?!\w)"
# Scores.
SCORES = {"email": 0.99, "phone": 0.94, "iban": 1.0, "customer_id": 0.86, "depot_id": 0.86, "account_id": 0.84, "alias": 0.98}
_CUES = {"customer_id": CUSTOMER_CUE, "depot_id": DEPOT_CUE, "account_id": ACCOUNT_CUE}
PHONE_REACH = 32


def phone_accepted(text: Column, span: Column) -> Column:
    """Not a date, and: international, or grouped behind a leading zero, or near a telephone word."""
    value = F.trim(span["text"])
    near = piece(text, span["start"] - PHONE_REACH, span["end"] + PHONE_REACH)
    plausible = value.startswith("+") | (value.startswith("0") & value.rlike(r"[ .()/\-]")) | near.rlike(PHONE_CUE)
    return (F.length(F.regexp_replace(value, r"\D", "")) >= 7) & ~value.rlike(DATE_LIKE) & plausible


def _shaped(spans: Column, category: str, score: float, detector: str) -> Column:
    return F.transform(
        spans,
        lambda s: F.struct(
            s["start"].cast("int").alias("start"),
            s["end"].cast("int").alias("end"),
            s["text"].alias("text"),
            F.lit(category).alias("category"),
            F.lit(score).cast("double").alias("score"),
            F.lit(detector).alias("detector"),
        ),
    )


def _cued(text: Column, cue: str) -> Column:
    """Values behind a cue word, without full stops at their end."""

    def trimmed(s: Column) -> Column:
        value = F.regexp_replace(s["text"], r"\.+$", "")
        return F.struct(s["start"].alias("start"), (s["start"] + F.length(value)).alias("end"), value.alias("text"))

    return F.transform(find_spans(text, "(?iU)(?:" + cue + ")" + _VALUE, 1), trimmed)


def rule_spans(text: Column, rules: dict[str, bool], hyphens: bool = False) -> Column:
    """All rule findings of a text as one array."""
    parts = []
    if rules.get("email", True):
        parts.append(_shaped(find_spans(text, EMAIL), "email", SCORES["email"], "rule:email"))
    if rules.get("phone", True):
        found = F.filter(find_spans(text, PHONE_WITH_HYPHENS if hyphens else PHONE), lambda s: phone_accepted(text, s))
        parts.append(_shaped(found, "phone", SCORES["phone"], "rule:phone"))
    if rules.get("iban", True):
        parts.append(_shaped(F.filter(find_spans(text, IBAN), lambda s: iban_valid(s["text"])), "iban", SCORES["iban"], "rule:iban"))
    for name, cue in _CUES.items():
        if rules.get(name, True):
            parts.append(_shaped(_cued(text, cue), name, SCORES[name], f"rule:{name}"))
    return F.concat(*parts) if parts else F.array()


def finish(rows: DataFrame) -> DataFrame:
    """Findings with all columns, in order."""
    for name, value in (("entity_key", F.lit(None).cast("string")), ("review_only", F.lit(False))):
        if name not in rows.columns:
            rows = rows.withColumn(name, value)
    return rows.withColumn("score", round6(F.col("score"))).select(*FINDING_COLUMNS)


def rule_findings(segments: DataFrame, policy: Policy | None = None, hyphens: bool = False) -> DataFrame:
    """Findings of the pattern rules."""
    rules = (policy or Policy()).rules
    if not any(rules.values()):
        return finish(segments.limit(0).select("doc_id", "segment_id", F.lit(0).alias("start"), F.lit(0).alias("end"), "text", F.lit("").alias("category"), F.lit(0.0).alias("score"), F.lit("").alias("detector")))
    found = segments.select("doc_id", "segment_id", F.explode(rule_spans(F.col("text"), rules, hyphens)).alias("s"))
    return finish(found.select("doc_id", "segment_id", "s.*"))


def alias_findings(segments: DataFrame, aliases: DataFrame) -> DataFrame:
    """Whole-word, case-insensitive occurrences of explicit aliases (a checked policy table)."""
    names = F.broadcast(aliases.select(F.col("alias"), "entity_key"))
    regex = whole_word(literal(F.col("alias")))
    met = segments.join(names, F.rlike("text", regex))
    found = met.select("doc_id", "segment_id", "entity_key", F.explode(find_spans(F.col("text"), regex)).alias("s"))
    return finish(found.select("doc_id", "segment_id", "entity_key", "s.*", F.lit("person").alias("category"), F.lit(SCORES["alias"]).alias("score"), F.lit("rule:alias").alias("detector")))


def pattern_findings(segments: DataFrame, pattern: str, category: str, score: float, detector: str) -> DataFrame:
    """Findings of one pattern."""
    found = segments.select("doc_id", "segment_id", F.explode(_shaped(find_spans(F.col("text"), pattern), category, score, detector)).alias("s"))
    return finish(found.select("doc_id", "segment_id", "s.*"))


def signals(text: Column) -> dict[str, Column]:
    """Cues of retained text: personal words, direct identifiers, identifier-like tokens."""
    phones = F.exists(find_spans(text, PHONE), lambda s: phone_accepted(text, s))
    return {"personal": text.rlike(PERSONAL_CUE), "direct": text.rlike(EMAIL) | text.rlike(IBAN) | phones, "token": text.rlike(IDENTIFIER_TOKEN)}


def with_context(findings: DataFrame, segments: DataFrame, left: int = 120, right: int = 60) -> DataFrame:
    """Findings with the text around them, for type evidence."""
    seg = segments.select("doc_id", "segment_id", F.col("text").alias("__t"))
    met = findings.join(seg, ["doc_id", "segment_id"])
    return met.select(*findings.columns, before(F.col("__t"), F.col("start"), left).alias("left_context"), after(F.col("__t"), F.col("end"), right).alias("right_context"))
