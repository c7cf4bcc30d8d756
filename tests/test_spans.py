"""Span primitive, rules and scalar functions on hand-made strings."""

from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from spanloom.functions import spans as S
from spanloom.operators import rules
from spanloom.policy import Policy, load_policy, parse_policy
from spanloom.schemas import SpanloomError


def seg(spark, *texts):
    return spark.createDataFrame([("d", i, f"s{i:06d}", t) for i, t in enumerate(texts, 1)], "doc_id string, seg_no int, segment_id string, text string")


def one(spark, text, make):
    return spark.createDataFrame([(text,)], "t string").select(make(F.col("t"))).first()[0]


def found(spark, text, **switch):
    rows = rules.rule_findings(seg(spark, text), parse_policy({"rules": switch} if switch else {})).collect()
    return sorted((r["category"], r["text"]) for r in rows)


def test_offsets_are_code_points(spark):
    text = "ü😀 a1 über a22\tb"
    got = one(spark, text, lambda t: S.find_spans(t, r"a\d+"))
    assert [(r["start"], r["end"], r["text"]) for r in got] == [(3, 5, "a1"), (11, 14, "a22")]
    assert all(text[r["start"] : r["end"]] == r["text"] for r in got)
    assert one(spark, "", lambda t: S.find_spans(t, r"a")) == []


@pytest.mark.parametrize(
    "text, want",
    [
        ("Mail an kim.lee@mail.beispiel.de.", [("email", "kim.lee@mail.beispiel.de")]),
        ("x@y", []),
        ("Ruf +49 30 1234567 an", [("phone", "+49 30 1234567")]),
        ("Umsatz 12345678 Euro", []),
        ("Tel. 12345678", [("phone", "12345678")]),
        ("Kundennr: AB-1234.", [("customer_id", "AB-1234")]),
        ("Depotkonto 99-7788", [("depot_id", "99-7788")]),
        ("account number: ZZ99/1", [("account_id", "ZZ99/1")]),
        ("Kundennummer: ohne", []),
    ],
)
def test_rules(spark, text, want):
    assert found(spark, text) == want


def test_hyphens_only_on_request(spark):
    text = "Telefon 030-123-4567"
    assert rules.rule_findings(seg(spark, text)).count() == 0
    assert [r["text"] for r in rules.rule_findings(seg(spark, text), hyphens=True).collect()] == ["030-123-4567"]


def test_rules_switch_off(spark):
    assert found(spark, "a@b.de, Kundennr: AB-1234", email=False) == [("customer_id", "AB-1234")]
    off = dict.fromkeys(("email", "phone", "iban", "customer_id", "depot_id", "account_id"), False)
    assert found(spark, "a@b.de", **off) == []


def test_iban(spark):
    bban = "500105175407324931"
    check = 98 - int(bban + "131400") % 97
    good = f"DE{check:02d}{bban}"
    assert one(spark, good, S.iban_valid) is True
    assert one(spark, good[:-1] + "2", S.iban_valid) is False
    assert one(spark, "DE12", S.iban_valid) is False


def test_aliases_quote_their_text(spark):
    table = parse_policy({"aliases": {"k": ["A.C\\E+B"]}}).alias_table(spark)
    rows = rules.alias_findings(seg(spark, "der a.c\\e+b kam, axc nicht"), table).collect()
    assert [(r["start"], r["text"], r["entity_key"]) for r in rows] == [(4, "a.c\\e+b", "k")]


def test_occurrence_id_is_canonical_json(spark):
    text = 'Ä"\\\t😀'
    want = "o" + hashlib.sha256(json.dumps(["s1", 1, 6, "person", text], ensure_ascii=False, indent=2).encode()).hexdigest()[:20]
    got = one(spark, text, lambda t: S.occurrence_id(F.lit("s1"), F.lit(1), F.lit(6), F.lit("person"), t))
    assert got == want


def test_overlay_and_tokens(spark):
    cuts = F.array(F.struct(F.lit(0).alias("start"), F.lit(2).alias("end"), F.lit("XXX").alias("replacement")), F.struct(F.lit(4).alias("start"), F.lit(5).alias("end"), F.lit("").alias("replacement")))
    assert one(spark, "😀bcdef", lambda t: S.overlay(t, cuts)) == "XXXcdf"
    assert one(spark, "customer-id", lambda t: S.token(t, F.lit(7))) == "CUSTOMERID_007"
    assert one(spark, "😀a", S.utf16_units) == 3
    assert one(spark, "  \t", S.is_blank) is True
    assert one(spark, "Straße", S.fold) == "strasse"


@pytest.mark.parametrize(
    "bad",
    [
        {"x": 1},
        {"schema_version": 2},
        {"rules": {"email": 1}},
        {"model": {"labels": ["planet"]}},
        {"model": {"review_threshold": 0.9, "proposal_threshold": 0.5}},
        {"model": {"threshold": True}},
        {"model": {"chunk_tokens": 10, "chunk_overlap_tokens": 10}},
        {"aliases": [{"entity_key": "k"}]},
    ],
)
def test_policy_is_strict(bad):
    with pytest.raises(SpanloomError):
        parse_policy(bad)


def test_policy_forms():
    p = parse_policy({"model": {"threshold": 0.6, "labels": ["person", "email"], "thresholds": {"person": {"review": 0.1}}}, "aliases": {"k": ["A", "A", "B"]}})
    assert (p.proposal_threshold, p.threshold("person", "review"), p.threshold("email", "proposal")) == (0.6, 0.1, 0.6)
    assert p.aliases == (("k", ("A", "B")),) and p.least_review_threshold() == 0.1
    assert load_policy(None) == Policy()
    with pytest.raises(SpanloomError):
        load_policy("{")
