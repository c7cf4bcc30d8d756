"""Resolver, identity, evidence, ranking, review, evaluation and the model seam."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from spanloom.operators import evaluate, evidence, identity, manifests, model, rank, resolve, review
from spanloom.operators.detect import detect
from spanloom.policy import Policy, parse_policy
from spanloom.schemas import FINDING, SpanloomError


def seg(spark, *texts, doc="d"):
    return spark.createDataFrame([(doc, i, f"s{i:06d}", t) for i, t in enumerate(texts, 1)], "doc_id string, seg_no int, segment_id string, text string")


def finds(spark, text, *spans):
    """spans: (start, end, category, score, detector, key, review_only)"""
    rows = []
    for a, b, *rest in spans:
        category, score, detector, key, only = [*rest, *[None] * 5][:5]
        rows.append(("d", "s000001", a, b, text[a:b], category or "person", 0.9 if score is None else score, detector or "x", key, bool(only)))
    return spark.createDataFrame(rows, FINDING)


TEXT = "Anna Maria Berg wohnt in Ulm, Tel 0731 555"


def test_islands_touch_but_do_not_merge(spark):
    f = finds(spark, TEXT, (0, 4), (4, 10), (11, 15), (12, 20), (19, 24))
    selected, suppressed = resolve.resolve(f, seg(spark, TEXT))
    assert sorted((r["start"], r["end"]) for r in selected.collect()) == [(0, 4), (4, 10), (11, 24)]
    assert suppressed.count() == 3


def test_merged_category_key_and_text(spark):
    f = finds(spark, TEXT, (0, 15, "address", 0.5, "m", "k"), (5, 10, "person", 0.8, "n"), (0, 4, "email", 0.3, "o"))
    row = resolve.resolve(f, seg(spark, TEXT))[0].collect()
    assert len(row) == 1
    r = row[0]
    assert (r["category"], r["score"], r["entity_key"], r["text"]) == ("person", 0.8, "k", TEXT[0:15])
    assert r["provenance"]["detectors"] == ["m", "n", "o"]
    partial = finds(spark, TEXT, (0, 10, "person", 0.5, "m", "k"), (5, 15, "person", 0.8, "n"))
    assert resolve.resolve(partial, seg(spark, TEXT))[0].first()["entity_key"] is None


def test_resolver_ignores_order_and_review_rows(spark):
    spans = [(i, i + n) for i, n in [(0, 4), (2, 6), (11, 4), (14, 8), (25, 3)]]
    want = None
    for k in range(3):
        random.Random(k).shuffle(spans)
        got = sorted((r["start"], r["end"]) for r in resolve.resolve(finds(spark, TEXT, *spans, (0, 30, "person", 0.9, "r", None, True)), seg(spark, TEXT))[0].collect())
        want = want or got
        assert got == want


def test_greedy_resolver(spark):
    rows = resolve.resolve_greedy(finds(spark, TEXT, (0, 10, None, 0.5), (5, 15, None, 0.9), (11, 15, None, 0.9))).collect()
    assert {(r["start"], r["end"]): r["reason"] for r in rows} == {(0, 10): "overlap_priority", (5, 15): None, (11, 15): "overlap_priority"}


def test_combine_prefers_first(spark):
    a, b = finds(spark, TEXT, (0, 4, None, 0.2)), finds(spark, TEXT, (0, 4, None, 0.9), (5, 10), (5, 10, None, 0.3))
    rows = resolve.combine(a, b, review_only=True).collect()
    assert sorted((r["start"], r["score"], r["review_only"]) for r in rows) == [(0, 0.2, False), (5, 0.9, True)]


def test_slice_violations_show_no_text(spark):
    f = finds(spark, TEXT, (0, 4), (5, 10)).withColumn("text", F.when(F.col("start") == 5, "nope").otherwise(F.col("text")))
    bad = resolve.slice_violations(f, seg(spark, TEXT))
    assert "text" not in bad.columns and [r["violation"] for r in bad.collect()] == ["text_mismatch"]


def test_speakers_and_aliases(spark):
    s = seg(spark, "[0:05] Kim Adler: Hallo zusammen", "Ich frage Kim Adler und Frau Adler.", "Budget Plan: Hallo dort", "Sprecher Eins: Hallo du")
    assert [r["name"] for r in identity.speaker_labels(s).collect()] == ["Kim Adler"]
    f = identity.speaker_findings(s)
    got = sorted((r["segment_id"], r["start"], r["score"], r["review_only"]) for r in f.collect())
    assert got == [("s000001", 7, 0.97, False), ("s000002", 10, 0.78, False), ("s000002", 29, 0.58, True)]
    local = identity.document_aliases(s, f).collect()
    assert [(r["text"], r["start"], r["entity_key"] is not None) for r in local] == [("Adler", 29, True)]


def test_shared_surname_carries_no_key(spark):
    s = seg(spark, "Kim Adler: Hallo du", "Jo Adler: Hallo du", "Herr Adler kommt.")
    f = identity.speaker_findings(s)
    rows = [r for r in identity.document_aliases(s, f).collect() if r["segment_id"] == "s000003"]
    assert [(r["text"], r["entity_key"]) for r in rows] == [("Adler", None)]


def test_dedupe_keeps_best(spark):
    rows = identity.dedupe(finds(spark, TEXT, (0, 4, None, 0.2), (0, 4, None, 0.7), (0, 4, None, 0.7, "y"))).collect()
    assert sorted((r["detector"], r["score"]) for r in rows) == [("x", 0.7), ("y", 0.7)]


@pytest.mark.parametrize(
    "text, a, b, category, want",
    [
        ("Der Projektleiter kam", 4, 17, "person", "reject"),
        ("Herr Leiter kam", 5, 11, "person", "propose"),
        ("A. B. kam", 0, 5, "person", "review"),
        ("an x@y.de heute", 3, 9, "email", "propose"),
        ("an x@y heute", 3, 6, "email", "review"),
        ("an xy heute", 3, 5, "email", "reject"),
        ("login: kimmi", 7, 12, "username", "propose"),
        ("der kimmi", 4, 9, "username", "review"),
        ("Am Ring", 0, 7, "address", "review"),
        ("wohnt Am Ring", 6, 13, "address", "propose"),
        ("Am Ring 5", 0, 9, "address", "propose"),
        ("Kundennummer fehlt", 0, 12, "customer_id", "reject"),
        ("ID AB-12 da", 3, 8, "account_id", "propose"),
    ],
)
def test_evidence(spark, text, a, b, category, want):
    df = spark.createDataFrame([(text, a, b, category)], "t string, a int, b int, c string")
    assert df.select(evidence.evidence(F.col("c"), F.col("t"), F.col("a"), F.col("b"))).first()[0] == want


@pytest.mark.parametrize("text, value, want", [("geboren am 3.4.1980 in Ulm", "3.4.1980", True), ("Termin am 3.4.1980", "3.4.1980", False), ("geboren um 12:30", "12:30", False)])
def test_birth_context(spark, text, value, want):
    a = text.index(value)
    df = spark.createDataFrame([(text, a, a + len(value))], "t string, a int, b int")
    assert df.select(evidence.birth_context(F.col("t"), F.col("a"), F.col("b"))).first()[0] is want


def test_masks_with_gaps(spark):
    s = seg(spark, TEXT)
    f = finds(spark, TEXT, (0, 15))
    mask = lambda *spans: spark.createDataFrame([("d", "s000001", a, b) for a, b in spans], "doc_id string, segment_id string, start int, end int")
    cases = [([(0, 15)], True), ([(0, 4), (5, 10), (11, 15)], True), ([(0, 4), (11, 15)], False), ([(0, 10)], False), ([(0, 4), (0, 20)], True), ([], False)]
    for spans, want in cases:
        m = mask(*spans) if spans else mask((90, 91))
        assert rank.masked_findings(f, m, s).first()["masked"] is want, spans


def test_groups_tokens_and_render(spark):
    text = "Anna und anna und Bob"
    s = seg(spark, text, "PERSON_001 steht schon da")
    f = finds(spark, text, (0, 4), (9, 13), (18, 21))
    selected, _ = resolve.resolve(f, s)
    groups = review.entity_groups(selected, s)
    assert sorted((r["token"], r["aliases"]) for r in groups.collect()) == [("PERSON_002", ["Anna", "anna"]), ("PERSON_003", ["Bob"])]
    bob = selected.where("text = 'Bob'").select("doc_id", "id", F.lit("replace").alias("action"), F.lit("Bobby").alias("replacement"), F.lit("").alias("note"))
    effects = review.effective(selected, groups, bob)
    out = review.render(s, effects).orderBy("seg_no").collect()
    assert [r["text"] for r in out] == ["PERSON_002 und PERSON_002 und Bobby", "PERSON_001 steht schon da"]
    assert sorted(r["start"] for r in review.masked_intervals(effects).collect()) == [0, 9]  # "Bobby" still shows "Bob"
    again = review.entity_groups(selected, s, review.token_counters(groups), groups.where("token = 'PERSON_003'"))
    assert sorted(r["token"] for r in again.collect()) == ["PERSON_003", "PERSON_004"]


def test_evaluation(spark):
    s = seg(spark, TEXT)
    gold = spark.createDataFrame([("d", "s000001", 0, 15, "person"), ("d", "s000001", 34, 42, "phone")], "doc_id string, segment_id string, start int, end int, category string")
    pred = finds(spark, TEXT, (0, 15, "person", 0.9), (0, 15, "person", 0.8, "y"), (34, 40, "phone"), (25, 28, "address"))
    m = {(r["start"], r["score"], r["category"]): (r["exact"], r["partial"]) for r in evaluate.matched_predictions(pred, gold).collect()}
    assert m == {(0, 0.9, "person"): (True, False), (0, 0.8, "person"): (False, False), (34, 0.9, "phone"): (False, True), (25, 0.9, "address"): (False, False)}
    t = evaluate.metrics_total(pred, gold, s).first()
    assert (t["tp"], t["fp"], t["fn"], t["precision"], t["recall"]) == (1, 3, 1, 0.25, 0.5)
    selected = resolve.resolve(pred, s)[0]
    assert [r["category"] for r in evaluate.residuals(gold, selected, s).collect()] == ["phone"]
    q = evaluate.replacement_quality(gold, selected, s).first()
    assert (q["proposed_occurrences"], q["wholly_false_positive_occurrences"], q["masked_nonwhitespace_characters"], q["non_pii_masked_characters"]) == (3, 1, 13 + 5 + 3, 3)
    assert [r["violation"] for r in evaluate.corpus_violations(s, gold.unionByName(gold.limit(1))).collect()] == ["duplicate_gold"]


def test_curve_starts_at_zero(spark):
    s = seg(spark, "a b", "c", "d e f")
    rest = spark.createDataFrame([("d", "s000002", 0, 1, "person")], "doc_id string, segment_id string, start int, end int, category string")
    curve = evaluate.inspection_curve(s.select("doc_id", "segment_id", F.col("seg_no").alias("position"), "text"), rest)
    assert [(r[1], r[2], r[3], r[4]) for r in curve.orderBy("inspected_passages").collect()] == [(0, 0, 0, 1), (1, 2, 0, 1), (2, 3, 1, 0), (3, 6, 1, 0)]
    e = evaluate.effort(curve).first()
    assert (e["passages_to_recover_all"], e["words_to_recover_all"], e["residual_after_1"], e["residual_after_10"]) == (2, 3, 1, 0)


def test_chunks_cover_everything(spark):
    for n, want in [(0, []), (5, [(0, 5)]), (10, [(0, 10)]), (11, [(0, 10), (7, 11)]), (18, [(0, 10), (7, 17), (14, 18)])]:
        got = spark.range(1).select(model.char_chunks(F.lit(n), 10, 3)).first()[0]
        assert [(r["start"], r["end"]) for r in got] == want
    assert model.word_windows("aa bb cc dd", lambda t: len(t) <= 5, 3, 1) == [(0, 5), (3, 8), (6, 11)]


def test_adapter_contract(spark):
    s = seg(spark, "Kim Lee ruft an", "Da ist Kim Lee")
    answer = lambda score, **extra: lambda: lambda text, labels, t: [{"label": "Person", "start": text.index("Kim Lee"), "end": text.index("Kim Lee") + 7, "score": score, **extra}] if "Kim Lee" in text else []
    rows = model.model_findings(s, answer(0.5), Policy(), "fake").collect()
    assert sorted((r["segment_id"], r["start"], r["review_only"]) for r in rows) == [("s000001", 0, False), ("s000002", 7, False)]
    assert all(r["review_only"] for r in model.model_findings(s, answer(0.3), Policy(), "fake").collect())
    assert model.model_findings(s, answer(0.1), Policy(), "fake").count() == 0
    with pytest.raises(SpanloomError):
        model.parse_result([{"label": "person", "start": 0, "end": 99, "score": 0.5}], "abc", ["person"])
    with pytest.raises(SpanloomError):
        model.parse_result([{"label": "person", "start": 0, "end": 2, "text": "zz", "score": 0.5}], "abc", ["person"])
    assert model.parse_result({"entities": {"planet": [{"start": 0, "end": 1, "score": 1.0}]}}, "abc", ["person"]) == []


def test_model_takes_speaker_key(spark):
    s = seg(spark, "Kim Lee: Guten Tag allerseits", "Da ist Kim Lee")
    factory = lambda: lambda text, labels, t: [{"label": "person", "start": text.index("Kim"), "end": text.index("Kim") + 7, "score": 0.9}]
    rows = [r for r in detect(s, parse_policy({}), factory, "fake").collect() if r["detector"].startswith("model:")]
    assert rows and all(r["entity_key"].startswith("speaker:") for r in rows)


def test_manifest_checks(spark):
    m = spark.createDataFrame([("a/b", 1, "x"), ("A/B", 1, "x"), ("c", 1, "x"), ("c/d", 1, "x"), ("../e", 1, "x")], "path string, bytes long, sha256 string")
    got = {(r["violation"], r["path"].lower()) for r in manifests.manifest_violations(m).collect()}
    assert {("unsafe_name", "../e"), ("case_clash", "a/b"), ("file_and_folder", "c")} <= got
    assert [r["part"] for r in manifests.size_split(m.where("bytes = 1").limit(5).withColumn("bytes", F.lit(4).cast("long")), 8).orderBy("path").collect()] == [0, 0, 1, 1, 2]
