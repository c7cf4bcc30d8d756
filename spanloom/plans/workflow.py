"""Runs and revisions: prepare, import a review, status, export.

A run keeps immutable revisions, each a folder of tables, and one pointer that is
swapped last.  Tables are Parquet written by Spark; only control data (pointer,
state, decisions of one review) passes through the driver.  A run is a folder that the
driver and all executors mount, since the pointer is swapped by renaming.

``runs/<run>/revisions/r000001/{source,segments,findings,selected,suppressed,groups,
counters,decisions,reviews,rendered,passages}.parquet`` and ``runs/<run>/current.json``.
"""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import UTC, datetime
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators import rank, resolve, review
from spanloom.operators.detect import SparkDetector
from spanloom.operators.model import Detector
from spanloom.policy import Policy
from spanloom.schemas import SpanloomError
from spanloom.sources.packages import write_atomic

TABLES = ("source", "segments", "findings", "selected", "suppressed", "groups", "counters", "decisions", "reviews", "rendered", "passages")
RESOLVER_VERSION = 2
_DECISIONS = "doc_id string, id string, action string, replacement string, note string"
_REVIEWS = "doc_id string, segment_id string, outcome string, note string, text_sha256 string"


def _digest(value: Any) -> str:
    return hashlib.sha256(json.dumps(value, ensure_ascii=False, sort_keys=True, indent=2).encode()).hexdigest()


def _now() -> str:
    return datetime.now(UTC).isoformat(timespec="seconds")


@contextmanager
def run_lock(run: Path) -> Iterator[None]:
    """One writer at a time."""
    lock = run / ".lock"
    try:
        os.close(os.open(lock, os.O_CREAT | os.O_EXCL | os.O_WRONLY))
    except FileExistsError:
        raise SpanloomError("run: another writer holds the lock") from None
    try:
        yield
    finally:
        lock.unlink(missing_ok=True)


def _table(spark: SparkSession, folder: Path, name: str) -> DataFrame:
    return spark.read.parquet(str(folder / f"{name}.parquet"))


def candidate_hash(rendered: DataFrame) -> str:
    """A SHA-256 over the rendered text that does not depend on the order of rows or files: a tree of digests, documents first."""
    over = lambda c: F.sha2(F.array_join(F.sort_array(F.collect_list(c)), " "), 256).alias("d")
    row = F.sha2(F.to_json(F.struct("doc_id", "segment_id", "text")), 256)
    level = rendered.groupBy("doc_id").agg(over(row))
    for digits in (6, 4, 2):  # so that no node has more than some hundred times the documents of the next level's mean
        level = level.groupBy(F.substring("d", 1, digits).alias("g")).agg(over("d"))
    return _digest(sorted(r["d"] for r in level.select("d").collect()))  # 256 rows at most


def load(spark: SparkSession, run: str | Path) -> tuple[dict[str, Any], dict[str, DataFrame]]:
    """(state, tables) of the current revision; its digests are checked."""
    run = Path(run)
    try:
        pointer = json.loads((run / "current.json").read_text())
        folder = run / "revisions" / pointer["revision"]
        raw = (folder / "state.json").read_bytes()
        state = json.loads(raw)
    except (OSError, ValueError, KeyError):
        raise SpanloomError("run: no readable revision") from None
    if hashlib.sha256(raw).hexdigest() != pointer["state_sha256"]:
        raise SpanloomError("run: the state was changed")
    tables = {t: _table(spark, folder, t) for t in TABLES}
    if candidate_hash(tables["rendered"]) != state["candidate_sha256"]:
        raise SpanloomError("run: the candidate was changed")
    return state, tables


Save = Callable[[str, DataFrame], DataFrame]


def _commit(spark: SparkSession, run: Path, state: dict[str, Any], build: Callable[[Save], None]) -> dict[str, Any]:
    """Write a revision beside the others, then swap the pointer.

    Each table is read back as soon as it is written, so what derives from it neither
    repeats its work nor carries its plan.
    """
    (run / "revisions").mkdir(parents=True, exist_ok=True)
    name = f"r{state['revision']:06d}"
    stage, final = run / "revisions" / f".{name}-{uuid.uuid4().hex}", run / "revisions" / name

    def save(table: str, df: DataFrame) -> DataFrame:
        df.write.parquet(str(stage / f"{table}.parquet"))
        return _table(spark, stage, table)

    try:
        build(save)
        state = state | {"candidate_sha256": candidate_hash(_table(spark, stage, "rendered"))}
        raw = json.dumps(state, ensure_ascii=False, sort_keys=True, indent=2).encode()
        write_atomic(stage / "state.json", raw)
        if final.exists():
            raise SpanloomError("run: the revision exists")
        os.rename(stage, final)
    except BaseException:
        shutil.rmtree(stage, ignore_errors=True)
        raise
    write_atomic(run / "current.json", json.dumps({"revision": name, "state_sha256": hashlib.sha256(raw).hexdigest()}).encode())
    return state


def _project(
    save: Save, state: dict[str, Any], source: DataFrame, segments: DataFrame, findings: DataFrame, decisions: DataFrame, reviews: DataFrame, old_groups: DataFrame | None, counters: DataFrame | None = None
) -> None:
    """Every table of a revision."""
    source, segments, findings = save("source", source), save("segments", segments), save("findings", findings)
    selected, suppressed = resolve.resolve(findings, segments)
    quiet = resolve.with_ids(findings.where("review_only")).select(*[c for c in suppressed.columns if c not in ("reason", "merged_into")], F.lit("review_only").alias("reason"), F.lit(None).cast("string").alias("merged_into"))
    save("suppressed", suppressed.unionByName(quiet))
    selected = save("selected", selected)
    if old_groups is None:
        groups = review.entity_groups(selected, segments)
    else:
        groups = review.entity_groups(selected, segments, counters, old_groups)
    groups = save("groups", groups)
    now = review.token_counters(groups)
    now = now if counters is None else now.unionByName(counters).groupBy("doc_id", "prefix").agg(F.max("n").alias("n"))
    save("counters", now)  # a group that goes keeps its number
    decisions = save("decisions", decisions.join(selected.select("doc_id", "id").distinct(), ["doc_id", "id"], "left_semi"))
    reviews = save("reviews", reviews)
    effects = review.effective(selected, groups, decisions)
    rendered = save("rendered", review.render(segments, effects))
    ranked = rank.rank_retained(segments, rendered, findings, review.masked_intervals(effects), state["sample_size"])
    save("passages", review.passage_view(source, rendered, ranked, reviews))


def prepare(segments: DataFrame, run: str | Path, detector: Detector | None = None, sample_size: int = 5, policy_id: str = "") -> dict[str, Any]:
    """The first revision of a new run."""
    run = Path(run)
    if isinstance(sample_size, bool) or not 0 <= sample_size <= 100:
        raise SpanloomError("run: the sample size is from 0 to 100")
    if run.exists():
        raise SpanloomError("run: the folder exists")
    spark = segments.sparkSession
    detector = detector or SparkDetector()
    run.mkdir(parents=True)
    state = {
        "schema_version": 1, "run_id": uuid.uuid4().hex, "revision": 1, "resolver_version": RESOLVER_VERSION, "sample_size": sample_size, "detector": detector.metadata,
        "policy_id": policy_id or detector.metadata.get("policy", ""), "signed_off_by": "", "signed_sha256": "", "signed_policy": "", "imports": [], "history": [{"at": _now(), "event": "prepared", "revision": 1}],
    }
    with run_lock(run):
        empty = spark.createDataFrame([], _DECISIONS), spark.createDataFrame([], _REVIEWS)
        return _commit(spark, run, state, lambda save: _project(save, state, segments, segments, detector.transform(segments), *empty, None))


def view(spark: SparkSession, run: str | Path) -> dict[str, Any]:
    """State keys and the three decision tables as DataFrames."""
    state, t = load(spark, run)
    return {
        **{k: state[k] for k in ("schema_version", "run_id", "revision", "candidate_sha256", "policy_id", "signed_off_by")},
        "groups": review.group_view(t["groups"], t["selected"], t["segments"]),
        "passages": t["passages"],
        "occurrences": review.occurrence_view(t["selected"], t["segments"], t["decisions"]),
    }


def import_review(spark: SparkSession, run: str | Path, returned: dict[str, Any], detector: Detector | None = None) -> dict[str, Any]:
    """Apply returned decision tables as a new revision; the same import again does nothing.

    returned: run_id, revision, candidate_sha256, signed_off_by, and groups, passages,
    occurrences as DataFrames with doc_id.
    """
    run = Path(run)
    with run_lock(run):
        state, t = load(spark, run)
        if state["resolver_version"] != RESOLVER_VERSION:
            raise SpanloomError("run: prepared by another resolver")
        tables = {k: returned[k] for k in ("groups", "passages", "occurrences")}
        parts = [df.select(F.lit(k).alias("k"), F.to_json(F.struct(*sorted(df.columns))).alias("j")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("k", "j").cast("decimal(38,0)")).alias("s")).first() for k, df in tables.items()]
        own = _digest([str(returned.get("signed_off_by", "")), *[[p["n"], str(p["s"])] for p in parts], returned.get("revision")])
        if own in state["imports"]:
            return state
        for key in ("run_id", "revision", "candidate_sha256"):
            if returned.get(key) != state[key]:
                raise SpanloomError(f"review: {key} is stale")
        if returned.get("policy_id", state["policy_id"]) != state["policy_id"]:
            raise SpanloomError("review: given under another policy")
        trusted = {
            "groups": review.group_view(t["groups"], t["selected"], t["segments"]), "passages": t["passages"],
            "occurrences": review.occurrence_view(t["selected"], t["segments"], t["decisions"]),
        }
        for k, df in tables.items():
            if bad := review.decision_violations(k, trusted[k], df).limit(5).collect():
                raise SpanloomError(f"review: {k}: " + ", ".join(f"{b['id']} {b['violation']}" for b in bad))
        if review.orphan_occurrences(tables["occurrences"], tables["groups"]).limit(1).count():
            raise SpanloomError("review: an occurrence has no group")
        edits = tables["passages"].where("action != 'keep'")
        edited = edits.limit(1).count() > 0
        groups = t["groups"].drop("action", "replacement", "note").join(tables["groups"].select("doc_id", F.col("id").alias("group_id"), "action", "replacement", "note"), ["doc_id", "group_id"])
        decisions = tables["occurrences"].where("action != 'inherit'").select("doc_id", "id", "action", "replacement", "note")
        changed = edited or _differs(groups, t["groups"], ["doc_id", "group_id", "action", "replacement"]) or _differs(decisions, t["decisions"], ["doc_id", "id", "action", "replacement"])
        if changed and detector is None:
            raise SpanloomError("review: changes need the run's detector")
        if detector is not None and detector.metadata != state["detector"]:  # its policy's digest included
            raise SpanloomError("review: the detector is not the run's")
        segments, findings = t["segments"], t["findings"]
        if edited:
            clash = edits.select("doc_id", F.col("id").alias("segment_id")).join(_touched(t, groups, decisions), ["doc_id", "segment_id"], "left_semi")
            if clash.limit(1).count():
                raise SpanloomError("review: a passage and an entity in it are both edited")
            fix = edits.select("doc_id", F.col("id").alias("segment_id"), F.when(F.col("action") == "remove", F.lit("")).otherwise(F.col("replacement")).alias("__new"))
            segments = segments.join(fix, ["doc_id", "segment_id"], "left").withColumn("text", F.coalesce("__new", "text")).drop("__new").select(*segments.columns)
            findings = detector.transform(segments)
        if changed:
            _rescan(spark, detector, groups, decisions)
        # reviews are given for the text the reviewer saw
        reviews = tables["passages"].where("outcome != 'uninspected'").select("doc_id", F.col("id").alias("segment_id"), "outcome", "note", F.sha2("text", 256).alias("text_sha256"))
        signed = str(returned.get("signed_off_by", "")).strip()
        state = state | {"revision": state["revision"] + 1, "imports": [*state["imports"], own], "history": [*state["history"], {"at": _now(), "event": "imported", "revision": state["revision"] + 1}]}
        old = state["candidate_sha256"]
        state = state | {"signed_off_by": "" if changed else signed, "signed_sha256": "" if changed or not signed else old, "signed_policy": "" if changed or not signed else state["policy_id"]}
        return _commit(spark, run, state, lambda save: _project(save, state, t["source"], segments, findings, decisions, reviews, groups, t["counters"]))


def _differs(a: DataFrame, b: DataFrame, columns: list[str]) -> bool:
    x, y = a.select(*columns), b.select(*columns)
    return x.exceptAll(y).limit(1).count() > 0 or y.exceptAll(x).limit(1).count() > 0


def _touched(t: dict[str, DataFrame], groups: DataFrame, decisions: DataFrame) -> DataFrame:
    """Segments in which a group's or an occurrence's decision changed."""
    cols = ["doc_id", "group_id", "action", "replacement"]
    g = groups.select(*cols).exceptAll(t["groups"].select(*cols)).select("doc_id", "group_id")
    keyed = review.with_groups(t["selected"])
    by_group = keyed.join(g, ["doc_id", "group_id"], "left_semi").select("doc_id", "segment_id")
    cols = ["doc_id", "id", "action", "replacement"]
    d = decisions.select(*cols).exceptAll(t["decisions"].select(*cols)).select("doc_id", "id")
    return by_group.unionByName(keyed.join(d, ["doc_id", "id"], "left_semi").select("doc_id", "segment_id")).distinct()


def _rescan(spark: SparkSession, detector: Detector, groups: DataFrame, decisions: DataFrame) -> None:
    """Replacements must hold nothing that the detector finds."""
    texts = groups.where("action = 'replace'").select("doc_id", F.col("group_id").alias("id"), "replacement").unionByName(decisions.where("action = 'replace'").select("doc_id", "id", "replacement"))
    rows = texts.select(F.concat_ws("/", "doc_id", "id").alias("doc_id"), F.lit(1).alias("seg_no"), F.lit("s000001").alias("segment_id"), F.col("replacement").alias("text"))
    if detector.transform(rows).limit(1).count():
        raise SpanloomError("review: a replacement holds personal data")


def status(spark: SparkSession, run: str | Path) -> DataFrame:
    v = view(spark, run)
    return review.status(v["groups"], v["occurrences"], v["passages"])


def export(spark: SparkSession, run: str | Path, dest: str | Path, policy: Policy | None = None) -> dict[str, Any]:
    """The signed candidate and a manifest of it, and nothing else; a policy, if given, must be the run's."""
    state, t = load(spark, run)
    dest = Path(dest)
    if policy is not None and policy.digest() != state["detector"].get("policy"):
        raise SpanloomError("export: the policy is not the run's")
    if not state["signed_off_by"] or state["signed_sha256"] != state["candidate_sha256"]:
        raise SpanloomError("export: the candidate is not signed off")
    if state["signed_policy"] != state["policy_id"]:
        raise SpanloomError("export: signed off under another policy")
    if state["resolver_version"] != RESOLVER_VERSION:
        raise SpanloomError("export: prepared by another resolver")
    if dest.exists():
        raise SpanloomError("export: the target exists")
    t["rendered"].select("doc_id", "seg_no", "segment_id", "text").write.parquet(str(dest / "segments.parquet"))
    manifest = {"run_id": state["run_id"], "revision": state["revision"], "candidate_sha256": state["candidate_sha256"], "signed_off_by": state["signed_off_by"], "policy_id": state["policy_id"]}
    write_atomic(dest / "manifest.json", json.dumps(manifest, sort_keys=True).encode())
    return manifest
