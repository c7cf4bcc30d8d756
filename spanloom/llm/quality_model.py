"""Quality classifier: a factorisation machine over hashed words and structure.

score = sigmoid(w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j), the pairwise sum
in linear time as half of (sum v x)^2 - sum (v x)^2 for each factor.

Inputs come from the text alone: words hashed into a fixed space (dampened
counts, unit length) and statistics of structure and size.  Labels, language,
source and document id never enter a score.

Training reads labelled rows only, at most ``sample`` of them in hash order (a
documented bound), and leaves out the held-out remainder of crc32(doc_id) modulo
4.  Features are made on the executors; the driver receives the bounded sample's
sparse rows and trains with Adam from a fixed seed, so reruns agree.  Scoring is
one pass without exchange; the model is a megabyte at any corpus size.

Defined results: null and empty texts are scored by their (zero) features; a null
doc_id is not held out and is never a training row; without labels of both
classes the score is 0.5 everywhere; repeated rows get equal scores; extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import Words, buffers, documents, shingles, steps

WORD_BITS = 12
FACTORS = 8
SAMPLE = 12_000
HELD_OUT = 2
THRESHOLD = 0.7
STATISTICS = (
    "log_words", "log_bytes", "mean_word", "upper", "digits", "high", "stops", "commas", "exclaims", "symbols", "quotes",
    "lines_a_word", "mean_line", "same_as_before", "distinct_words", "repeated_windows", "repeated_pairs", "long_words", "short_words", "end_stop",
)
_WORDS = 1 << WORD_BITS
_SIZE = _WORDS + len(STATISTICS)

_CLASS = np.zeros((256, 7), dtype=np.float32)
for _i, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", bytes(range(0xC2, 0xF5)), b".", b",;:", b"!?", b"#*$%&|<>_=+~^{}[]\\/@")):
    _CLASS[list(_chars), _i] = 1


@dataclass
class Model:
    bias: float
    linear: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(4)) == HELD_OUT, F.lit(False))


def _spread(keys: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Distinct keys of each row."""
    both = np.sort((rows.astype(np.uint64) << np.uint64(51)) | (keys >> np.uint64(13)))
    if not len(both):
        return np.zeros(n)
    lead = np.concatenate([[True], both[1:] != both[:-1]])
    return np.bincount((both[lead] >> np.uint64(51)).astype(np.int64), minlength=n).astype(float)


def features(raw: np.ndarray, offsets: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word part as (row, feature, value), sorted by row, and the statistics of the rows lo..hi."""
    n = hi - lo
    cased = Words(raw, offsets, lo, hi)
    folded = Words(raw, offsets, lo, hi, lower=True)
    h = folded.hashes()
    row = folded.row
    size = np.diff(folded.offsets).astype(float)
    count = np.diff(folded.first).astype(float)
    length = (folded.ends - folded.starts).astype(float)
    some, wide = np.maximum(count, 1), np.maximum(size, 1)
    by_row = lambda x: np.bincount(row, x, minlength=n)
    byte_row = np.repeat(np.arange(n), np.diff(folded.offsets))
    chars = [np.bincount(byte_row, _CLASS[cased.bytes, i], minlength=n) for i in range(_CLASS.shape[1])]
    quotes = np.bincount(byte_row, (cased.bytes == 34) | (cased.bytes == 39), minlength=n)
    lines = np.bincount(byte_row, cased.bytes == 10, minlength=n) + 1.0
    before = np.zeros(len(h))
    before[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    last = cased.bytes[np.maximum(cased.ends - 1, 0)] if len(h) else np.zeros(0, dtype=np.uint8)
    repeats = []
    for width in (5, 2):
        r, s = shingles(folded, h, width)
        windows = np.bincount(r, minlength=n).astype(float)
        repeats.append(1 - _spread(s, r, n) / np.maximum(windows, 1) - (windows == 0))
    stats = np.stack(
        [
            np.log1p(count), np.log1p(size), by_row(length) / some, *(c / wide for c in chars[:2]), chars[2] / wide, chars[3] / some, chars[4] / some,
            chars[5] / some, chars[6] / some, quotes / some, lines / some, np.log1p(size / lines), by_row(before) / some, _spread(h, row, n) / some,
            repeats[0], repeats[1], by_row(length > 20) / some, by_row(length < 3) / some, by_row(last == 46) / some,
        ],
        axis=1,
    )
    keys = np.sort((row.astype(np.int64) << WORD_BITS) | (h >> np.uint64(64 - WORD_BITS)).astype(np.int64))
    if not len(keys):
        return row.astype(np.int64), row.astype(np.int64), np.zeros(0), stats
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    value = np.log1p(np.diff(np.append(first, len(keys))))
    keys = keys[first]
    at = keys >> WORD_BITS
    value /= np.sqrt(np.bincount(at, value * value, minlength=n))[at]
    return at, keys & (_WORDS - 1), value, stats


def _sample(docs: DataFrame, labels: DataFrame, sample: int, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """Sparse features and label of the bounded training sample."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # at most ``sample`` rows: bounded, hence broadcast
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select(F.col("doc_id").cast("string").alias("doc_id"), F.col("quality").cast("int").alias("quality"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = buffers(batch.column(2))
            for lo, hi in steps(offsets):
                at, feature, value, stats = features(raw, offsets, lo, hi)
                bounds = np.searchsorted(at, np.arange(hi - lo + 1))
                cut = lambda x, r: x[bounds[r] : bounds[r + 1]].tobytes()
                f16, v32 = feature.astype(np.uint16), value.astype(np.float32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        batch.column(1).slice(lo, hi - lo).cast(pa.int32()),
                        pa.array([cut(f16, r) for r in range(hi - lo)], pa.binary()),
                        pa.array([cut(v32, r) for r in range(hi - lo)], pa.binary()),
                        pa.array([s.tobytes() for s in stats.astype(np.float32)], pa.binary()),
                    ],
                    names=["doc_id", "quality", "feature", "value", "stats"],
                )

    made = rows.mapInArrow(run, "doc_id string, quality int, feature binary, value binary, stats binary").toArrow().sort_by([("doc_id", "ascending"), ("stats", "ascending")])
    return [
        (np.frombuffer(f, dtype=np.uint16), np.frombuffer(v, dtype=np.float32), np.frombuffer(s, dtype=np.float32), int(q))
        for q, f, v, s in zip(*(made[c].to_pylist() for c in ("quality", "feature", "value", "stats")), strict=True)
    ]


def fit_rows(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]], factors: int = FACTORS, epochs: int = 8, rate: float = 0.01, decay: float = 1e-4, seed: int = 7) -> Model:
    """Adam on the logistic loss; classes weigh alike to their square root."""
    rng = np.random.default_rng(seed)
    empty = Model(0.0, np.zeros(_SIZE, np.float32), np.zeros((_SIZE, factors), np.float32), np.zeros(len(STATISTICS)), np.ones(len(STATISTICS)))
    y = np.array([q for *_, q in rows], dtype=np.float32)
    if len(rows) == 0 or y.min() == y.max():
        return empty
    stats = np.stack([s for _, _, s, _ in rows]).astype(np.float64)
    mean, scale = stats.mean(axis=0), stats.std(axis=0) + 1e-6
    norm = np.clip((stats - mean) / scale, -6, 6).astype(np.float32) * 0.3
    share = y.mean()
    cost = np.where(y == 1, 1.0, np.sqrt(share / (1 - share))).astype(np.float32)
    params = [np.array([np.log(share / (1 - share))], np.float32), np.zeros(_SIZE, np.float32), rng.normal(0, 0.02, (_SIZE, factors)).astype(np.float32)]
    first, second, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), 128):
            part = order[lo : lo + 128]
            x = np.zeros((len(part), _SIZE), np.float32)
            for i, r in enumerate(part):
                x[i, rows[r][0]] = rows[r][1]
            x[:, _WORDS:] = norm[part]
            w0, w, v = params
            s = x @ v
            x2 = x * x
            z = w0[0] + x @ w + 0.5 * ((s * s).sum(axis=1) - (x2 @ (v * v)).sum(axis=1))
            g = (1 / (1 + np.exp(-z)) - y[part]) * cost[part] / len(part)
            grads = [np.array([g.sum()], np.float32), x.T @ g + decay * w, x.T @ (g[:, None] * s) - v * (x2.T @ g)[:, None] + decay * v]
            t += 1
            for p, m, u, d in zip(params, first, second, grads, strict=True):
                m *= 0.9
                m += 0.1 * d
                u *= 0.999
                u += 0.001 * d * d
                p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(u / (1 - 0.999**t)) + 1e-8)
    return Model(float(params[0][0]), params[1], params[2], mean, scale)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model of the labelled rows (labels: doc_id, quality) that are not held out."""
    return fit_rows(_sample(docs, labels, sample, id_col, text_col))


def predict(model: Model, raw: np.ndarray, offsets: np.ndarray, lo: int, hi: int) -> np.ndarray:
    at, feature, value, stats = features(raw, offsets, lo, hi)
    n = hi - lo
    norm = np.clip((stats - model.mean) / model.scale, -6, 6) * 0.3
    v = model.factors
    linear = model.bias + np.bincount(at, value * model.linear[feature], minlength=n) + norm @ model.linear[_WORDS:]
    pairs = np.zeros(n)
    own = norm @ v[_WORDS:]
    squares = (norm * norm) @ (v[_WORDS:] ** 2)
    for k in range(v.shape[1]):
        x = value * v[feature, k]
        total = np.bincount(at, x, minlength=n) + own[:, k]
        pairs += total * total - np.bincount(at, x * x, minlength=n) - squares[:, k]
    return 1 / (1 + np.exp(-np.clip(linear + 0.5 * pairs, -40, 40)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # _SIZE x (factors + 1) floats
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = buffers(batch.column(1))
            out = np.zeros(batch.num_rows)
            for lo, hi in steps(offsets):
                out[lo:hi] = predict(shared.value, raw, offsets, lo, hi)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], names=["doc_id", "score"])

    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, score double")


def query(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = score(docs, model)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
