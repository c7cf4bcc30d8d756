"""Packing token pieces into sequences: Martello-Toth dominance, then best fit.

Lengths are whole numbers up to the capacity, so the instance is a histogram of
at most ``capacity`` counters at any corpus size; the driver solves it and rows
never reach it.

Reduction, longest piece j first, on whole classes of equal lengths: {j} is fixed
if nothing fits beside it; {j, k} is fixed if k fills the sequence exactly, or if
only one piece fits beside j and k is the longest that does, or if at most two fit
and the longest single k is no shorter than the fullest pair.  Any other set with j
can swap its partners for k without needing a sequence more, so fixing is safe.
What is left is packed by best fit, longest first, again on classes.

The plan says, for each length, which ranks go to which sequences and offsets.
Its size depends on the histogram only (a long one is not broadcast).  Ranks
inside a length come from cells of bounded size, so that a hot length (many equal
texts) does not meet in one task.

Defined results: a null text is empty and has the end token only; ties are broken
by (doc_id, piece, checksum); identical pieces are interchangeable; an empty table
gives an empty result; ids may be of any type; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import bisect
import math
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.llm.common import _LOWER, Words, buffers, documents, durable, steps, text_or_empty

CAPACITY = 2048
END_ID = 0
CELL_ROWS = 20_000
#: Distinct words whose ids a Python worker remembers (about 40 bytes each).
CACHE_WORDS = 3_000_000
#: Lines of the plan up to which it is broadcast; a longer one is dealt out by length.
PLAN_LIMIT = 500_000


# --- the packing problem on a histogram -------------------------------------------------


def reduce_dominated(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Fixed (pattern, times) and the counts left."""
    left = {s: n for s, n in counts.items() if n > 0}
    fixed: list[tuple[tuple[int, ...], int]] = []
    for j in sorted(left, reverse=True):
        while left.get(j, 0):
            n_j = left[j]
            room = capacity - j
            sizes = sorted(s for s, n in left.items() if n - (s == j) > 0)
            if not sizes or sizes[0] > room:
                times = n_j if j * 2 > capacity or len(sizes) == 0 else 1
                fixed.append(((j,), times))
                _take(left, (j,), times)
                continue
            k = sizes[bisect.bisect_right(sizes, room) - 1]
            small: list[int] = []  # the three shortest partners
            for s in sizes:
                small += [s] * min(3, left[s] - (s == j))
                if len(small) >= 3:
                    break
            one_only = len(small) < 2 or small[0] + small[1] > room
            two_at_most = len(small) < 3 or sum(small[:3]) > room
            if k == room or one_only or (two_at_most and k >= _fullest_pair(sizes, left, j, room)):
                # what is taken only makes partners scarcer and pairs shorter: the case holds until k runs out
                times = n_j // 2 if k == j else min(n_j, left[k])
                fixed.append(((j, k), times))
                _take(left, (j, k), times)
                continue
            break
    return fixed, left


def _take(left: dict[int, int], pattern: tuple[int, ...], times: int) -> None:
    for s in pattern:
        left[s] -= times
        if not left[s]:
            del left[s]


def _fullest_pair(sizes: list[int], left: dict[int, int], j: int, room: int) -> int:
    best, lo, hi = 0, 0, len(sizes) - 1
    while lo <= hi:
        a, b = sizes[lo], sizes[hi]
        if a + b > room or (lo == hi and left[a] - (a == j) < 2):
            hi -= 1
        else:
            best = max(best, a + b)
            lo += 1
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit decreasing on classes: (pattern, times)."""
    groups: dict[int, list[list]] = {}  # room left -> [pattern, times]
    rooms: list[int] = []

    def put(pattern: tuple[int, ...], times: int) -> None:
        room = capacity - sum(pattern)
        if room not in groups:
            groups[room] = []
            bisect.insort(rooms, room)
        groups[room].append([pattern, times])

    for s in sorted(counts, reverse=True):
        n = counts[s]
        while n:
            at = bisect.bisect_left(rooms, s)
            if at == len(rooms):
                per = capacity // s
                if n >= per:
                    put((s,) * per, n // per)
                    n %= per
                else:
                    put((s,) * n, 1)
                    n = 0
                continue
            room = rooms[at]
            group = groups[room][-1]
            fit = min(room // s, n)
            times = min(group[1], n // fit)
            group[1] -= times
            if not group[1]:
                groups[room].pop()
                if not groups[room]:
                    del groups[room]
                    rooms.pop(at)
            put(group[0] + (s,) * fit, times)
            n -= times * fit
    return [(tuple(p), t) for g in groups.values() for p, t in g]


def solve(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    fixed, left = reduce_dominated(counts, capacity)
    return fixed + best_fit(left, capacity)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """(length, first rank, end rank, first sequence, offset) and the number of sequences."""
    rank: dict[int, int] = {}
    out, sequence = [], 0
    for pattern, times in sorted(solve(counts, capacity), reverse=True):
        offset = 0
        for s in pattern:
            lo = rank.get(s, 0)
            out.append((s, lo, lo + times, sequence, offset))
            rank[s] = lo + times
            offset += s
        sequence += times
    return out, sequence


# --- tokens ------------------------------------------------------------------------------


class WordEncoder:
    """Ids of texts, word by word.

    Where a tokenizer never joins characters across white space, nor an ASCII letter
    with a full stop, comma or exclamation mark behind it, and folds case, a text's ids
    are the ids of such parts one after another, and each distinct part is encoded once.
    That is tried on the tokenizer at hand; another kind encodes whole texts.  Parts
    are known by a 64-bit hash of their bytes and length: two of a worker's few million
    distinct parts share one with a probability under one in a million.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.limit = cache_words
        kinds = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        others = iter(range(256, 512))
        self.letters = {b: chr(b) if b in set(kinds) else chr(next(others)) for b in range(256)}  # the byte-level alphabet
        self.by_parts = self.holds()
        self.forget()

    def holds(self) -> bool:
        """Whether the tokenizer does what encoding by parts needs."""
        ids = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        words = ["the", "Haus", "ETWAS", "naïve", "é", "x", "token2", "don't", "a-b", "漢字", "12", "?"]
        joined = all(ids(sep.join(pair)) == ids(pair[0]) + ids(pair[1]) for sep in " \t\n\x0b\x0c\r" for pair in zip(words, words[::-1], strict=True))
        stops = all(ids(w + mark) == ids(w) + ids(mark) for w in ("the", "Haus", "x", "naiv") for mark in ".,!")
        plain = all(ids(w) == [t.id for t in self.model.tokenize("".join(map(self.letters.__getitem__, w.encode())))] for w in ("the", "haus", "naïve", "z"))
        return joined and stops and plain and all(ids(w) == ids(w.lower()) for w in words)

    def forget(self) -> None:
        self.known = np.zeros(0, dtype=np.uint64)
        self.first = np.zeros(0, dtype=np.int64)
        self.count = np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.uint32)

    def encode_part(self, part: bytes) -> list[int]:
        text = part.decode("utf-8", "replace")
        if text.isalpha() and text == text.lower() and unicodedata.is_normalized("NFC", text):
            return [t.id for t in self.model.tokenize("".join(map(self.letters.__getitem__, part)))]
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def learn(self, new: np.ndarray, parts: list[bytes]) -> None:
        """new: sorted hashes that aren't known, parts: their bytes."""
        encoded = [self.encode_part(p) for p in parts]
        count = np.fromiter(map(len, encoded), dtype=np.int64, count=len(encoded))
        flat = np.fromiter((i for e in encoded for i in e), dtype=np.uint32, count=int(count.sum()))
        if len(self.known) + len(new) > self.limit:
            self.forget()
        first = len(self.ids) + np.concatenate([[0], np.cumsum(count)[:-1]]).astype(np.int64) if len(count) else count
        known = np.concatenate([self.known, new])
        order = np.argsort(known, kind="stable")
        self.known = known[order]
        self.first = np.concatenate([self.first, first])[order]
        self.count = np.concatenate([self.count, count])[order]
        self.ids = np.concatenate([self.ids, flat])

    def encode(self, raw: np.ndarray, offsets: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the rows lo..hi one after another, and where each row's begin."""
        if not self.by_parts:
            texts = [raw[offsets[r] : offsets[r + 1]].tobytes().decode("utf-8", "replace") for r in range(lo, hi)]
            each = [np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
            return np.concatenate([np.zeros(0, np.uint32), *each]), np.concatenate([[0], np.cumsum([len(e) for e in each])]).astype(np.int64)
        words = _Parts(raw, offsets, lo, hi)
        h = words.hashes()
        distinct, where, inverse = np.unique(h, return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, distinct)
        have = np.zeros(len(distinct), dtype=bool)
        inside = at < len(self.known)
        have[inside] = self.known[at[inside]] == distinct[inside]
        if not have.all():
            if len(self.known) + int((~have).sum()) > self.limit:
                have[:] = False  # the cache starts anew
            fresh = where[~have]
            data = words.bytes.tobytes()
            self.learn(distinct[~have], [data[a:b] for a, b in zip(words.starts[fresh], words.ends[fresh], strict=True)])
            at = np.searchsorted(self.known, distinct)
        count, first = self.count[at][inverse], self.first[at][inverse]
        ends = np.cumsum(count)
        total = int(ends[-1]) if len(ends) else 0
        index = np.arange(total) + np.repeat(first - (ends - count), count)
        bounds = np.concatenate([[0], ends])[words.first]
        return self.ids[index], bounds


class _Parts(Words):
    """Words, with a last full stop, comma or exclamation mark behind an ASCII letter cut off, in lower case."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, lo: int, hi: int) -> None:
        super().__init__(raw, offsets, lo, hi)
        if not bytes(self.bytes).count(b"<|"):  # names of special tokens are taken as they are written
            self.bytes = _LOWER[self.bytes]
        if not len(self.starts):
            return
        end, before = self.bytes[self.ends - 1], self.bytes[np.maximum(self.ends - 2, 0)]
        cut = ((end == 46) | (end == 44) | (end == 33)) & (self.ends - self.starts > 1) & (before >= 97) & (before <= 122)
        at = self.ends[cut] - 1
        row = self.row[cut]
        ends = self.ends.copy()
        ends[cut] -= 1
        starts = np.concatenate([self.starts, at])
        order = np.argsort(starts, kind="stable")
        self.starts = starts[order]
        self.ends = np.concatenate([ends, at + 1])[order]
        self.row = np.concatenate([self.row, row])[order]
        self.first = np.searchsorted(self.starts, self.offsets)


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder a Python worker, kept between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document."""
    slim = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        for batch in batches:
            raw, offsets = buffers(batch.column(1))
            rows, pieces, starts, lengths, sums = [], [], [], [], []
            for lo, hi in steps(offsets, 1 << 21, 1 << 20):
                ids, bounds = enc.encode(raw, offsets, lo, hi)
                for r in range(hi - lo):
                    own = np.append(ids[bounds[r] : bounds[r + 1]], np.uint32(END_ID)).astype("<u4")
                    for piece, start in enumerate(range(0, len(own), capacity)):
                        cut = own[start : start + capacity]
                        rows.append(lo + r)
                        pieces.append(piece)
                        starts.append(start)
                        lengths.append(len(cut))
                        sums.append(zlib.crc32(cut.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


def place(pieces: DataFrame, capacity: int = CAPACITY, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Pieces with sequence_id and offset."""
    spark = pieces.sparkSession
    pieces = durable(pieces)
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most ``capacity`` lines
    layout, _ = plan(counts, capacity)
    # cells of a length: by a hash of the piece; identical pieces are counted first, so that no cell is hot
    cells = {s: math.ceil(n / cell_rows) for s, n in counts.items() if n > cell_rows}
    folded = pieces.groupBy("doc_id", "piece", "start", "length", "ids_crc32").agg(F.count(F.lit(1)).alias("copies"))
    n_cells = F.lit(1)
    for s, n in cells.items():
        n_cells = F.when(F.col("length") == s, F.lit(n)).otherwise(n_cells)
    if len(cells) > 64:  # a long chain of cases is slow: look the number up instead
        table = spark.createDataFrame([(s, n) for s, n in cells.items()], "c_length long, c_cells int")
        folded = folded.join(F.broadcast(table), F.col("length") == F.col("c_length"), "left")
        n_cells = F.coalesce("c_cells", F.lit(1))
    keyed = folded.withColumn("cell", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), n_cells).cast("int"))
    sums = keyed.groupBy("length", "cell").agg(F.sum("copies").alias("n"))
    earlier = W.partitionBy("length").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("length", "cell", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("cell_start"))
    inside = W.partitionBy("length", "cell").orderBy("doc_id", "piece", "ids_crc32").rowsBetween(W.unboundedPreceding, -1)
    ranked = keyed.withColumn("ahead", F.coalesce(F.sum("copies").over(inside), F.lit(0))).join(sums, ["length", "cell"])
    ranked = ranked.withColumn("rank", F.explode(F.expr("sequence(cell_start + ahead, cell_start + ahead + copies - 1)")))
    lines = spark.createDataFrame(layout or [(-1, 0, 0, 0, 0)], "p_length long, lo long, hi long, seq0 long, offset long")
    small = F.broadcast(lines) if len(layout) <= PLAN_LIMIT else lines
    met = ranked.join(small, (F.col("length") == F.col("p_length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return met.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("seq0") + F.col("rank") - F.col("lo")).alias("sequence_id"), "offset")


def pack(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    return place(token_pieces(docs, tokenizer_path, capacity, id_col, text_col), capacity)


def query(spark, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir).select("doc_id", "text"))


