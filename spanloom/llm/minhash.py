"""Near-duplicates by consistent weighted sampling over TF-IDF shingles.

1. Feature pass.  Every text gives its distinct five-word shingles (case folded
   in ASCII) with counts.  Document frequencies are counted over all documents in
   a hashed feature space of fixed size, as hashed TF-IDF does: the table is a
   megabyte at any corpus size, and since every feature then carries the same
   share of unrelated shingles, idf behaves alike at every size.
   Weight: (1 + ln tf) * (1 + ln((1 + N) / (1 + df)) / ln(1 + N)).
2. Sampling pass.  Improved consistent weighted sampling draws one (shingle,
   level) per hash function; equal draws have the probability of the weighted
   Jaccard similarity.  Draws are banded; two bits of each are kept as a sketch.
3. Equal texts collapse to one node.  The nodes of a bucket meet its hubs in rounds
   (``classes``); the join's condition compares sketches, so that pairs that merely
   share a band aren't emitted.
4. Pairs are verified by weighted Jaccard similarity on whole texts.
5. Classes are connected components by alternating stars; each round is a table in
   the shared folder, and nothing of all documents reaches the driver.

No link between classes is lost but for sampling: at similarity 0.8 12 bands of 5 find
99.2 % of single pairs, and the sketch test passes 99 % (74 of 96 draws whose two bits
agree, and 310 of 384 for what the first round leaves).

Defined results: a null text is empty; texts without a word are linked to equal
texts only; texts of one to four words have one shingle, of all their words; the
class id is the smallest doc_id (nulls aside) and the rows with it stay; repeated
rows of that id stay together; ids may be of any type that can be ordered; an empty table
gives an empty result; extra columns pass through ``drop_near_duplicates``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.classes import classes, plain, sized, with_payload
from spanloom.llm.common import Words, Work, buffers, documents, mix64, pair_texts, private, shingles, steps, text_or_empty

WIDTH = 5
SIMILARITY = 0.8
BANDS, ROWS = 12, 5
#: Draws of a sketch (a multiple of 32, BANDS * ROWS at least), and how many must agree in their two bits.
DRAWS, SKETCH_MATCHES = 96, 74
#: The same for the nodes that are left after ``classes`` has looked at one hub of every bucket.
MORE_DRAWS, MORE_MATCHES = 384, 310
FEATURE_BITS = 18
_HASH_BITS = 52
_LOW = np.uint64((1 << _HASH_BITS) - 1)


def features(raw: np.ndarray, offsets: np.ndarray, lo: int, hi: int, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle, count) of the rows lo..hi, by row and shingle; at most 4096 rows."""
    words = Words(raw, offsets, lo, hi, lower=True)
    rows, values = shingles(words, words.hashes(), width)
    keys = np.sort((rows.astype(np.uint64) << np.uint64(_HASH_BITS)) | (values & _LOW))
    if not len(keys):
        return rows.astype(np.int64), keys, np.zeros(0, dtype=np.int64)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    count = np.diff(np.append(first, len(keys)))
    keys = keys[first]
    return (keys >> np.uint64(_HASH_BITS)).astype(np.int64), keys & _LOW, count


def bucket(shingle: np.ndarray) -> np.ndarray:
    return (shingle >> np.uint64(_HASH_BITS - FEATURE_BITS)).astype(np.int64)


def document_frequencies(docs: DataFrame, text_col: str = "text", width: int = WIDTH) -> tuple[np.ndarray, int]:
    """Document frequency of every hashed feature, and the number of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(1 << FEATURE_BITS, dtype=np.int64), 0
        for batch in batches:
            raw, offsets = buffers(batch.column(0))
            n += batch.num_rows
            for lo, hi in steps(offsets):
                total += np.bincount(bucket(features(raw, offsets, lo, hi, width)[1]), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(at, -1)), pa.array(np.append(total[at], n))], names=["feature", "n"]
        )

    counted = docs.select(F.col(text_col).cast("string")).mapInArrow(run, "feature long, n long")
    table = counted.groupBy("feature").agg(F.sum("n").alias("n")).toArrow()  # 2**FEATURE_BITS + 1 lines at most
    at, n = table["feature"].to_numpy(), table["n"].to_numpy()
    df = np.zeros(1 << FEATURE_BITS, dtype=np.int64)
    df[at[at >= 0]] = n[at >= 0]
    return df, int(n[at < 0].sum())


def idf_table(df: np.ndarray, n: int) -> np.ndarray:
    return (1 + np.log((1 + n) / (1 + np.minimum(df, n))) / np.log(2 + n)).astype(np.float32)


def weights(shingle: np.ndarray, count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return (1 + np.log(count.astype(np.float32))) * idf[bucket(shingle)]


def _gamma_quantiles(n: int) -> np.ndarray:
    """Quantiles of Gamma(2, 1), whose distribution function is 1 - (1 + x) exp(-x)."""
    q = (np.arange(n) + 0.5) / n
    lo, hi = np.zeros(n), np.full(n, 60.0)
    for _ in range(70):
        mid = (lo + hi) / 2
        below = 1 - (1 + mid) * np.exp(-mid) < q
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
    return (lo + hi) / 2


_GAMMA = _gamma_quantiles(1 << 16)
_R = _GAMMA.astype(np.float32)
_R_INV = (1 / _GAMMA).astype(np.float32)
_LN_C = np.log(_GAMMA).astype(np.float32)


def draws(row: np.ndarray, shingle: np.ndarray, weight: np.ndarray, rows: int, k: int) -> np.ndarray:
    """rows x k draws (64-bit); a row without shingles has zeros."""
    out = np.zeros((rows, k), dtype=np.uint64)
    if not len(row):
        return out
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    count = np.diff(np.append(first, len(row)))
    owner = row[first]
    place = np.repeat(np.arange(len(first)), count)
    ln_w = np.log(weight).astype(np.float32)
    low = np.uint64(0xFFFF)
    for j in range(k):
        z = mix64(shingle + np.uint64((j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        at = (z & low).astype(np.intp)
        r = _R[at]
        beta = (z >> np.uint64(40)).astype(np.float32) * np.float32(2.0**-24)
        t = np.floor(ln_w * _R_INV[at] + beta)
        ln_a = _LN_C[((z >> np.uint64(16)) & low).astype(np.intp)] - r * (t - beta + 1)
        least = np.minimum.reduceat(ln_a, first)
        hit = np.flatnonzero(ln_a == least[place])
        hit = hit[np.concatenate([[True], place[hit][1:] != place[hit][:-1]])]
        out[owner, j] = mix64(shingle[hit] + t[hit].astype(np.int64).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(j))
    return out


def sketch(drawn: np.ndarray) -> list[pa.Array]:
    """Two bits of each draw, 32 draws a long."""
    shifts = np.arange(0, 64, 2, dtype=np.uint64)
    parts = (drawn & np.uint64(3)).reshape(len(drawn), -1, 32) << shifts
    longs = np.bitwise_or.reduce(parts, axis=2).view(np.int64)
    return [pa.array(np.ascontiguousarray(longs[:, i])) for i in range(longs.shape[1])]


def _longs(n: int) -> list[str]:
    return [f"s{i}" for i in range(n // 32)]


def _node(text_col: str) -> Column:
    """128 bits of the text's SHA-256."""
    return F.unhex(F.substring(F.sha2(text_or_empty(text_col), 256), 1, 32)).alias("node")


def sign(docs: DataFrame, idf: np.ndarray, id_col: str, text_col: str, width: int, bands: int, rows: int) -> DataFrame:
    """doc_id, node (128 bits of the text's SHA-256), sketch longs and band keys of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(idf)  # 2**FEATURE_BITS floats
    slim = docs.select(
        F.col(id_col).alias("doc_id"),
        _node(text_col),
        F.col(text_col).cast("string").alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = shared.value
        for batch in batches:
            raw, offsets = buffers(batch.column(2))
            n = batch.num_rows
            drawn, keys, some = np.zeros((n, DRAWS), dtype=np.uint64), np.zeros((n, bands), dtype=np.uint64), np.zeros(n, dtype=bool)
            for lo, hi in steps(offsets, 1 << 18):
                row, shingle, count = features(raw, offsets, lo, hi, width)
                drawn[lo:hi] = own = draws(row, shingle, weights(shingle, count, idf), hi - lo, DRAWS)
                some[lo + np.unique(row)] = True
                for b in range(bands):
                    total = np.full(hi - lo, b + 1, dtype=np.uint64)
                    for j in range(rows):
                        total = mix64(total * np.uint64(0xD1342543DE82EF95) + own[:, b * rows + j])
                    keys[lo:hi, b] = total
            per_row = np.where(some, bands, 0)
            ends = np.concatenate([[0], np.cumsum(per_row)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[some].reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *sketch(drawn), lists], names=["doc_id", "node", *_longs(DRAWS), "bands"])

    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(run, f"doc_id {kind}, node binary, " + ", ".join(f"{c} long" for c in _longs(DRAWS)) + ", bands array<long>")


def more_draws(texts: DataFrame, idf: np.ndarray, width: int) -> DataFrame:
    """node and a longer sketch of every row of ``texts`` (node, text)."""
    shared = texts.sparkSession.sparkContext.broadcast(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = buffers(batch.column(1))
            for lo, hi in steps(offsets, 1 << 18):
                row, shingle, count = features(raw, offsets, lo, hi, width)
                drawn = draws(row, shingle, weights(shingle, count, shared.value), hi - lo, MORE_DRAWS)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *sketch(drawn)], names=["node", *_longs(MORE_DRAWS)])

    return texts.select("node", "text").mapInArrow(run, "node binary, " + ", ".join(f"{c} long" for c in _longs(MORE_DRAWS)))


def agree(n: int, matches: int):
    """Condition that two aliases' sketches of ``n`` draws agree in ``matches``."""

    def unequal(x: str, y: str, c: str) -> Column:
        d = F.col(f"{x}.{c}").bitwiseXOR(F.col(f"{y}.{c}"))
        return F.bit_count(d.bitwiseOR(F.shiftrightunsigned(d, 1)).bitwiseAND(F.lit(0x5555555555555555)))

    return lambda x, y: reduce(lambda p, q: p + q, [unequal(x, y, c) for c in _longs(n)]) <= n - matches


def verify(pairs: DataFrame, n: int, texts: DataFrame, idf: np.ndarray, width: int, similarity: float) -> DataFrame:
    """Those of ``n`` pairs of nodes whose texts have at least the weighted Jaccard similarity."""
    shared = pairs.sparkSession.sparkContext.broadcast(idf)
    both = pair_texts(pairs, n, texts)
    own = len(pairs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = shared.value
        for batch in batches:
            n, score = batch.num_rows, np.zeros(batch.num_rows)
            (raw_a, off_a), (raw_b, off_b) = buffers(batch.column(own)), buffers(batch.column(own + 1))
            for lo, hi in steps(off_a + off_b):
                sums, keyed = [], []
                for raw, off in ((raw_a, off_a), (raw_b, off_b)):
                    row, shingle, count = features(raw, off, lo, hi, width)
                    w = weights(shingle, count, idf).astype(np.float64)
                    sums.append(np.bincount(row, w, minlength=hi - lo))
                    keyed.append(((row.astype(np.uint64) << np.uint64(_HASH_BITS)) | shingle, w, row))
                (ka, wa, ra), (kb, wb, _) = keyed
                if not len(ka) or not len(kb):
                    continue
                at = np.minimum(np.searchsorted(kb, ka), len(kb) - 1)
                both_have = kb[at] == ka
                least = np.bincount(ra[both_have], np.minimum(wa, wb[at])[both_have], minlength=hi - lo)
                union = sums[0] + sums[1] - least
                score[lo:hi] = np.divide(least, union, out=np.zeros(hi - lo), where=union > 0)
            keep = pa.array(np.flatnonzero(score >= similarity - 1e-9), pa.int64())
            yield batch.select(range(own)).take(keep)

    return both.mapInArrow(run, pairs.schema)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, matches: int = SKETCH_MATCHES
) -> DataFrame:
    """doc_id, node, class_id, class_size and kept for every row."""
    work = Work(docs.sparkSession, "near")
    df, n = document_frequencies(docs, text_col, width)
    idf = idf_table(df, n)
    signed, _ = work.write(sign(docs, idf, id_col, text_col, width, bands, rows))
    own = _longs(DRAWS)
    first = [F.first(c).alias(c) for c in (*own, "bands")]
    texts, _ = work.write(signed.groupBy("node").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), *first))
    members, _ = work.write(with_payload(sized(texts.select("node", F.explode("bands").alias("key"))), texts.select("node", *own)))
    # texts of all nodes that any pair can name, one row a node
    whole = docs.select(_node(text_col), text_or_empty(text_col).alias("text")).groupBy("node").agg(F.first("text").alias("text"))
    one, _ = work.write(whole.join(members.select(plain("node")).distinct(), "node", "left_semi"), small=0)
    roots, _ = classes(
        work, members, agree(DRAWS, matches), lambda pairs, n: verify(pairs, n, one, idf, width, similarity),
        lambda nodes: (more_draws(one.join(nodes, "node", "left_semi"), idf, width), agree(MORE_DRAWS, MORE_MATCHES)),
    )
    work.drop(one)
    linked = texts.select("node", "rep", "copies").join(roots, "node", "left").select("node", "rep", "copies", F.coalesce("root", "node").alias("root"))
    found = linked.groupBy("root").agg(F.min("rep").alias("class_id"), F.sum("copies").alias("class_size")).select(plain("root"), "class_id", "class_size")
    by_node = linked.join(found, "root").select(plain("node"), "class_id", "class_size")
    return signed.select("doc_id", "node").join(by_node, "node").select(
        "doc_id", "node", "class_id", "class_size", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept")
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each class, with the input's columns."""
    own_id, own_node = private(docs, "id", "node")
    stay = near_duplicates(docs, id_col, text_col, **options).where("kept").select(F.col("doc_id").alias(own_id), F.col("node").alias(own_node)).distinct()
    return docs.join(stay, F.col(id_col).eqNullSafe(F.col(own_id)) & (_node(text_col) == F.col(own_node)), "left_semi")


def query(spark, sf_dir: str) -> DataFrame:
    rows = near_duplicates(documents(spark, sf_dir).select("doc_id", "text"))
    return rows.select("doc_id", "class_id", "class_size", "kept")
