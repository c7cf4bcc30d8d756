"""Mixing sources to target weights by cube-method balanced sampling.

Targets: ``budget`` times all words is shared among sources by weight; a share
above ``cap`` times its source's own words stops there and the excess is shared
again.  A source's rows then have inclusion ``target / size``: its whole part is
how often each row is taken anyway, its fraction is sampled.

The fraction is balanced on two totals a source, words and documents.  Flight:
three undecided rows at a time are moved along the null space of their 2 x 3
constraint matrix until one of them is decided, which leaves both totals as they
are.  Rows fly in cells of bounded size; a cell leaves at most two rows open, and
those fly on together, level by level, until at most two are open in a source.
Landing: those drop the document total first, then round towards the word total.

Scale: a hot source has many cells.  The driver sees one line per source and
numbers of open rows, never rows.  Each level's decisions are checkpointed, so
that a lost executor can't change them; directions come from a fixed seed, so
reruns agree.

Defined results: null texts and texts without words have size 0 and are decided
like others; a null source is a source of its own, last in order; identical rows
are interchangeable; ids may be of any type that a string can say; an empty table gives an
empty result; extra columns pass through ``apply_mix``, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import Words, buffers, documents, durable, private, steps

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
CAP = 2.0
CELL_ROWS = 4096
#: Sources up to which a table of one line a source is broadcast.
MANY_SOURCES = 10_000
SEED = 20
_EPS = 1e-9


def word_sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Last column, a text, becomes its number of words."""
    for batch in batches:
        raw, offsets = buffers(batch.column(batch.num_columns - 1))
        size = np.zeros(batch.num_rows, dtype=np.int64)
        for lo, hi in steps(offsets):
            size[lo:hi] = np.diff(Words(raw, offsets, lo, hi).first)
        columns = [*batch.columns[:-1], pa.array(size)]
        yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "size"])


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, cap: float = CAP) -> dict[str | None, float]:
    """Target words per source; sources in code point order, null last, weigh in turn."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target: dict[str | None, float] = {}
    left, free = budget * sum(sizes.values()), list(order)
    while free:
        unit = left / sum(weight[s] for s in free)
        full = [s for s in free if unit * weight[s] > cap * sizes[s]]
        if not full:
            target.update({s: unit * weight[s] for s in free})
            break
        for s in full:
            target[s] = cap * sizes[s]
            left -= target[s]
        free = [s for s in free if s not in target]
    return target


def fly(prob: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Move probabilities through the null space of (words, documents) until at most two are open."""
    p = prob.astype(float).tolist()
    x = size.astype(float).tolist()
    draws = rng.random(2 * len(p) + 8).tolist()
    hold: list[int] = []
    d = 0
    for i in range(len(p)):
        if not _EPS < p[i] < 1 - _EPS:
            p[i] = float(round(p[i]))
            continue
        hold.append(i)
        if len(hold) < 3:
            continue
        a, b, c = hold
        # orthogonal to (1, 1, 1) and to the sizes: their cross product
        u = (x[c] - x[b], x[a] - x[c], x[b] - x[a])
        if u == (0.0, 0.0, 0.0):
            u = (1.0, -1.0, 0.0)
        up = down = math.inf
        for j, v in zip(hold, u, strict=True):
            if v > 0:
                up, down = min(up, (1 - p[j]) / v), min(down, p[j] / v)
            elif v < 0:
                up, down = min(up, -p[j] / v), min(down, (p[j] - 1) / v)
        step = up if draws[d] < down / (up + down) else -down
        d += 1
        for j, v in zip(hold, u, strict=True):
            p[j] += step * v
            if p[j] < _EPS:
                p[j] = 0.0
            elif p[j] > 1 - _EPS:
                p[j] = 1.0
        hold = [j for j in hold if 0 < p[j] < 1]
    return np.array(p)


def land(prob: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Decide the last open rows of a source: the choice nearest to their expected words."""
    p = prob.copy()
    is_open = np.flatnonzero((p > 0) & (p < 1))
    due = float((p[is_open] * size[is_open]).sum())
    best = min(range(1 << len(is_open)), key=lambda m: (abs(sum(size[j] for k, j in enumerate(is_open) if m >> k & 1) - due), m))
    for k, j in enumerate(is_open):
        p[j] = float(best >> k & 1)
    return p


def few(table: DataFrame, n: int) -> DataFrame:
    """Broadcast a table of one line a source if the sources are few."""
    return F.broadcast(table) if n <= MANY_SOURCES else table


def _level(rows: DataFrame, level: int, last: bool, seed: int) -> DataFrame:
    """One round of flights over (source_no, cell)."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "size", "tie"], kind="stable", na_position="last").reset_index(drop=True)
        rng = np.random.default_rng([seed, level, int(key[0]), int(key[1])])
        # longest first, so that what stays open at the end is short; equal sizes in random order
        order = np.lexsort((rng.permutation(len(pdf)), -pdf["size"].to_numpy()))
        pdf = pdf.iloc[order].reset_index(drop=True)
        p = fly(pdf["prob"].to_numpy(), pdf["size"].to_numpy(), rng)
        pdf["prob"] = land(p, pdf["size"].to_numpy()) if last else p
        return pdf

    return rows.groupBy("source_no", "cell").applyInPandas(run, rows.schema)


def cube_sample(rows: DataFrame, cells: dict[int, int], seed: int = SEED, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Decide every row's fraction: ``prob`` becomes 0 or 1.  cells: number of cells of each source_no."""
    parts: list[DataFrame] = []
    level = 0
    while True:
        n = rows.sparkSession.createDataFrame(list(cells.items()) or [(-1, 1)], "source_no int, n_cells int")  # one line a source
        celled = rows.drop("cell").join(few(n, len(cells)), "source_no")
        celled = celled.withColumn("cell", F.expr(f"cast(pmod(xxhash64(tie, {level}), n_cells) as int)")).drop("n_cells")
        last = all(c == 1 for c in cells.values())
        decided = durable(_level(celled.select("source_no", "cell", "doc_id", "size", "tie", "prob"), level, last, seed))
        if last:
            parts.append(decided)
            break
        is_open = F.expr("prob > 0 and prob < 1")
        parts.append(decided.where(~is_open))
        rows = decided.where(is_open)
        cells = {r[0]: max(1, math.ceil(r[1] / cell_rows)) for r in rows.groupBy("source_no").count().collect()}
        level += 1
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, cell_rows: int = CELL_ROWS) -> DataFrame:
    """doc_id, source_no, tie, size, source_size, target, repeats and taken for every row.

    ``tie`` is a hash of the row's id, source and text; it tells rows of one id apart.
    """
    spark = docs.sparkSession
    slim = docs.select(
        F.col(id_col).cast("string").alias("doc_id"),  # as pandas would make floats of longs beside nulls
        F.col(source_col).cast("string").alias("source"),
        F.xxhash64(F.col(id_col), F.col(source_col), F.col(text_col)).alias("tie"),
        F.col(text_col).cast("string").alias("text"),
    )
    sized = durable(slim.mapInArrow(word_sizes, "doc_id string, source string, tie long, size long"))
    per_source = sized.groupBy("source").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows")).collect()
    words = {r["source"]: int(r["words"]) for r in per_source}
    target = targets(words)
    order = {s: i for i, s in enumerate(sorted(words, key=lambda s: (s is None, s or "")))}
    lines, cells = [], {}
    for r in per_source:
        s = r["source"]
        rate = target[s] / words[s] if words[s] else 0.0
        whole = min(int(math.floor(rate + _EPS)), int(CAP))
        lines.append((s, order[s], words[s], float(target[s]), whole, max(0.0, rate - whole)))
        cells[order[s]] = max(1, math.ceil(r["rows"] / cell_rows))
    plan = spark.createDataFrame(lines or [("", -1, 0, 0.0, 0, 0.0)], "p_source string, source_no int, source_size long, target double, whole int, prob double")
    joined = sized.join(few(plan, len(lines)), F.col("source").eqNullSafe(F.col("p_source")))  # one line a source
    decided = cube_sample(joined.select("source_no", "doc_id", "size", "tie", "prob"), cells, seed, cell_rows)
    known = plan.select("source_no", "source_size", "target", "whole")
    out = decided.join(few(known, len(lines)), "source_no").withColumn("repeats", (F.col("whole") + F.round("prob")).cast("int"))
    return out.select(
        F.col("doc_id").cast(docs.schema[id_col].dataType).alias("doc_id"), "source_no", "tie", "size", "source_size", "target", "repeats", (F.col("size") * F.col("repeats")).cast("long").alias("taken")
    )


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """The mixture itself: each row as often as it is taken, with the input's columns."""
    chosen = mix(docs, id_col, text_col, source_col, seed)
    key, own_key, times, rows, k = private(docs, "g_tie", "tie", "times", "rows", "k")
    # identical rows share a tie: one of them then stands for all, as often as they are taken together
    chosen = chosen.groupBy(F.col("tie").alias(key)).agg(F.sum("repeats").cast("int").alias(times), F.count(F.lit(1)).alias(rows)).where(F.col(times) > 0)
    joined = docs.withColumn(own_key, F.xxhash64(F.col(id_col), F.col(source_col), F.col(text_col))).join(chosen, F.col(own_key) == F.col(key))
    single, several = joined.where(F.col(rows) == 1), joined.where(F.col(rows) > 1).dropDuplicates([own_key])
    return single.unionByName(several).withColumn(k, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
