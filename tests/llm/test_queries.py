"""Registered queries on a small table: oracles, contracts, and the pipeline's stages."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from spanloom.llm import entry
from spanloom.llm.mixing import targets
from tests.llm.test_operators import brute_links, distance, naive_rules, prose, reached

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables are absent")


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_oracle(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    rel = con.sql(entry.oracle_sql()[name])
    at = [rel.columns.index(c) for c in columns]
    assert Counter(tuple(r) for r in df.select(*columns).collect()) == Counter(tuple(r[i] for i in at) for r in rel.fetchall())


@pytest.mark.parametrize("name", ["op4_sharding", "op5_mixing", "op7_quality_classifier", "op10_secret_scans", "op3_minhash_near_dedup"])
def test_one_row_a_document(spark, name):
    ids = [r["doc_id"] for r in entry.queries()[name](spark, SF).select("doc_id").collect()]
    assert sorted(ids) == sorted(r["doc_id"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect())


def same_lines(a, b):
    """Whether two lines count as one: equal, few edits in code points, or few in words."""
    if a == b:
        return True
    n, words = min(len(a), len(b)), min(len(a.split(" ")), len(b.split(" ")))
    return distance(a, b) <= min(2, n // 15) or (words >= 12 and distance(a.split(" "), b.split(" ")) <= max(1, words // 20))


def test_pipeline_against_brute_force(spark, tmp_path):
    """Every stage on all that its predecessor kept, worked out another way."""
    rng = random.Random(31)
    bodies = [[prose(rng, rng.randint(3, 30)) for _ in range(rng.randint(1, 4))] for _ in range(14)]
    notice = "diese Zeile steht in vielen Texten"
    made = ["\n".join([*body, *([notice] if rng.random() < 0.5 else [])]) for body in bodies]
    long = prose(rng, 200).split()
    near = [" ".join([*long[:k], "anders", *long[k + 1 :]]) for k in (10, 80, 150)]
    texts = [*made, made[2], made[5].replace(" ", "  ", 1), *near, "zu kurz", "wort " * 40, None, "", notice]
    docs = spark.createDataFrame([(i, t, "de", rng.choice(["a", "b", None]), 0 if t is None else len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    stages, columns, steps_out = dict(corpus_pipeline.STAGES), docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        steps_out[name] = [r.asDict() for r in docs.collect()]
        assert name == "packing" or docs.columns == columns
    assert list(stages) == ["quality_rules", "line_dedup", "near_dedup", "mixing", "packing"]

    def passes(text):
        n_words, chars, symbols, dup, repeated = naive_rules(text)
        lines = [x for x in (text or "").split("\n") if x.strip()]
        return not (n_words < 10 or 100 * repeated > 20 * n_words or chars < 2 * n_words or chars > 25 * n_words or 10 * symbols > 3 * n_words or 100 * dup > 40 * len(lines))

    kept = {i: t for i, t in enumerate(texts) if passes(t)}
    assert {r["doc_id"]: r["text"] for r in steps_out["quality_rules"]} == kept and len(kept) < len(texts)

    spots = [((i, n), line.strip(" ")) for i, t in sorted(kept.items()) for n, line in enumerate(t.split("\n")) if line.strip()]
    groups = {at: [other for other, b in spots if same_lines(a, b)] for at, a in spots}
    gone = {at for at in groups if min(reached(at, groups)) != at}
    want = {}
    for i, t in kept.items():
        rest = [line for n, line in enumerate(t.split("\n")) if (i, n) not in gone]
        if rest == t.split("\n") or any(x.strip() for x in rest):
            want[i] = "\n".join(rest)
    assert {r["doc_id"]: r["text"] for r in steps_out["line_dedup"]} == want and gone
    assert all(r["n_chars"] == len(r["text"]) for r in steps_out["line_dedup"])

    ids = sorted(want)
    links = defaultdict(list, {i: [i] for i in ids})
    for a, b in brute_links([want[i] for i in ids]):
        links[ids[a]].append(ids[b])
        links[ids[b]].append(ids[a])
    assert {r["doc_id"] for r in steps_out["near_dedup"]} == {min(reached(i, links)) for i in ids}

    before = {r["doc_id"]: r for r in steps_out["near_dedup"]}
    size = Counter()
    for r in before.values():
        size[r["source"]] += len(r["text"].split())
    goal, taken, times = targets(size), Counter(), Counter()
    for r in steps_out["mixing"]:
        assert r == before[r["doc_id"]]
        taken[r["source"]] += len(r["text"].split())
        times[r["doc_id"]] += 1
    most = max(len(r["text"].split()) for r in before.values())
    assert max(times.values()) <= 2 and all(abs(taken[s] - goal[s]) <= most for s in goal)

    tokens = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces, ends = Counter(), Counter()
    for r in steps_out["mixing"]:
        n = len(tokens.encode(r["text"], add_special_tokens=False).ids) + 1
        for k, start in enumerate(range(0, n, 2048)):
            pieces[r["doc_id"], k, start, min(2048, n - start)] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"]) for r in steps_out["packing"]) == pieces
    for r in steps_out["packing"]:
        ends[r["sequence_id"]] += r["length"]
    assert max(ends.values()) <= 2048 and len(ends) <= 1 + 2 * sum(ends.values()) / 2048


def test_pipeline_run(spark):
    assert corpus_pipeline.run(spark, SF).columns[0] == "doc_id"
