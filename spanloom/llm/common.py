"""Shared helpers: lineage cuts, schema-safe inputs and vectorised word hashing.

Words are always maximal runs of bytes outside 0x20 and 0x09-0x0D.  Those bytes
never occur inside a multi-byte UTF-8 sequence, so whole Arrow buffers can be
cut into words without decoding a single character.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step handles; a longer document is a step of its own.
STEP_BYTES = 1 << 20
SEPARATORS = " \t\n\x0b\x0c\r"

#: Rows of a written table that are one partition.
SMALL = 100_000

_IS_SEP = np.zeros(256, dtype=bool)
_IS_SEP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names; make one only where none is set (local tests)."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spanloom-ckpt-"))


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint, so that a lost executor costs no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Work:
    """A folder of its own in the shared folder, for tables that cut lineage.

    Tables are Parquet: unlike a checkpoint they are compressed, and their sizes are known
    to the optimiser.  Rows are counted on the way; a table of up to ``SMALL`` rows is read
    as one partition, so that steps on small tables need no exchange, while larger ones
    are dealt out.  Tables that are no longer needed go at once, all others when the
    session's file system is closed.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        ensure_checkpoint_dir(spark)
        self.spark = spark
        self.folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/spanloom-{name}-{uuid.uuid4().hex}"
        self._n = 0
        self._at: dict[int, str] = {}
        self._fs(self.folder)[0].deleteOnExit(self._fs(self.folder)[1])

    def _fs(self, path: str) -> tuple:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def write(self, df: DataFrame, small: int = SMALL, **measures: Column) -> tuple[DataFrame, dict]:
        """The table as written, and aggregates of its rows taken on the way (n: how many)."""
        path = f"{self.folder}/{self._n}"
        self._n += 1
        watch = Observation()
        df.observe(watch, F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in measures.items()]).write.parquet(path)
        table, seen = self.spark.read.schema(df.schema).parquet(path), watch.get
        table = table.coalesce(1) if seen["n"] <= small else table
        self._at[id(table)] = path
        return table, seen

    def drop(self, table: DataFrame) -> None:
        path = self._at.pop(id(table), None)
        if path:
            fs, p = self._fs(path)
            fs.delete(p, True)


#: Rows of pairs (four ids) that are broadcast, by their count; more are dealt out.
FEW = 200_000


def pair_texts(pairs: DataFrame, n: int, texts: DataFrame) -> DataFrame:
    """The rows of ``pairs`` (a, b, ...) with text_a and text_b; texts: node, text, one row a node."""
    left, right = texts, texts
    if n <= FEW:
        ids = lambda c: F.broadcast(pairs.select(F.col(c).alias("node")).distinct())
        left, right = texts.join(ids("a"), "node", "left_semi"), texts.join(ids("b"), "node", "left_semi")
    left = left.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = right.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(left, "a").join(right, "b").select(*pairs.columns, "text_a", "text_b")


def private(df: DataFrame, *names: str) -> list[str]:
    """Column names that the table doesn't have, in any case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, at least n of each."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, STEP_BYTES + 1)
        for name, base in (("up", _BASE), ("down", _BASE_INV)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser with full avalanche (the public splitmix64 constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string array; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + n + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    if n == 0:
        return raw[:0], np.zeros(1, dtype=np.int64)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(offsets: np.ndarray, limit: int = STEP_BYTES, rows: int = 4096) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes and at most ``rows`` rows."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), lo + rows, n)
        yield lo, hi
        lo = hi


class Words:
    """Words of the rows lo..hi of a string buffer, as byte positions and 64-bit hashes."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, lo: int, hi: int, lower: bool = False) -> None:
        self.bytes = raw[offsets[lo] : offsets[hi]]
        self.offsets = offsets[lo : hi + 1] - offsets[lo]
        if lower:
            self.bytes = _LOWER[self.bytes]
        n = len(self.bytes)
        inside = np.zeros(n + 2, dtype=bool)
        np.logical_not(_IS_SEP[self.bytes], out=inside[1 : n + 1])
        edge = inside[1:] != inside[:-1]
        starts = edge & inside[1:]
        ends = edge & inside[:-1]
        breaks = self.offsets[1:-1]
        breaks = breaks[(breaks > 0) & (breaks < n)]
        cut = breaks[inside[breaks] & inside[breaks + 1]]  # a word on both sides of a row's end
        starts[cut] = True
        ends[cut] = True
        self.starts = np.flatnonzero(starts)
        self.ends = np.flatnonzero(ends)
        #: first word of each row, and one past the last
        self.first = np.searchsorted(self.starts, self.offsets)
        self.row = np.repeat(np.arange(hi - lo), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        n = len(self.bytes)
        up, down = powers(n + 1)
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((self.bytes.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
        h = (total[self.ends] - total[self.starts]) * down[self.starts]
        return mix64(h + (self.ends - self.starts).astype(np.uint64))


#: Odd multipliers, one for each place in a shingle.
_PLACES = [np.uint64(pow(0xD1342543DE82EF95, 2 * i + 1, 1 << 64)) for i in range(64)]


def shingles(words: Words, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every window of ``width`` words; a shorter text with a word has one, of all its words."""
    n = len(hashes)
    count = np.diff(words.first)
    if n >= width:
        total = np.zeros(n - width + 1, dtype=np.uint64)
        for i in range(width):
            total += hashes[i : n - width + 1 + i] * _PLACES[i]
        inside = words.row[: n - width + 1] == words.row[width - 1 :]
        rows, values = words.row[: n - width + 1][inside], mix64(total[inside])
    else:
        rows, values = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        extra = []
        for r in short:
            own = hashes[words.first[r] : words.first[r + 1]]
            total = np.uint64(0)
            with np.errstate(over="ignore"):
                for i, h in enumerate(own):
                    total = total + h * _PLACES[i]
            extra.append(total)
        rows = np.concatenate([rows, short])
        values = np.concatenate([values, mix64(np.array(extra, dtype=np.uint64))])
    return rows, values
