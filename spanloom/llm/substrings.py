"""Repeated passages by hashing normalised units (lines, cut at content-defined words).

A unit is a line, cut further after words whose hash (taken with the two words that
follow) is the least among its neighbours; ties cut too, so that periodic text has
units no longer than its period.  Such cuts depend on a few nearby words alone, so a passage pasted
into the middle of a line has the same inner units wherever it stands.  Hashing
whole lines only would miss it.  Normalised: ASCII case folded, white space
collapsed (a unit is the sequence of its word hashes).

Digests are grouped over all documents; a unit stays where its earliest document
(smallest doc_id, then row key) has it first and is a repeat everywhere else.  Consecutive
repeats are put together, and a run of ``min_words`` words or more is a span to
remove, wherever in its lines it stands; so is a whole line of ``min_line_words`` words
(every line, unless the caller asks for more) that an earlier place has.  Shorter pieces of lines are common phrases and stay.
Spans keep the original offsets, in code points, end exclusive.

Scale: a unit repeated inside its document is marked at once, so that the global
side has one row a document and digest; counts and minima are aggregated before
the exchange, and the join back is a plain two-sided exchange that AQE may split
at a hot digest.  A run needs several units, so single collisions of 64-bit
digests remove nothing.

Defined results: null and empty texts have no units; a null doc_id ranks last;
different texts under one doc_id, or without one, are documents of their own; repeated
rows (same id and text) have the same spans; ids may be of any type that can be ordered; an empty
table gives an empty result; extra columns pass through ``remove_spans``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.llm.common import _PLACES, Words, buffers, documents, mix64, private, steps

MIN_WORDS = 20
MIN_LINE_WORDS = 1
REACH = 4
GRAM = 3


def units(raw: np.ndarray, offsets: np.ndarray, lo: int, hi: int, reach: int = REACH, line_words: tuple[int, int] = (0, 0)) -> dict[str, np.ndarray]:
    """Units of the rows lo..hi: row, no (place in its row), digest, start, end (code points), word (its first), words, again.

    Whole lines of ``line_words`` (from, below) words follow, with no < 0.
    """
    words = Words(raw, offsets, lo, hi, lower=True)
    n = len(words.starts)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return {"row": none, "no": none, "digest": none, "start": none, "end": none, "word": none, "words": none, "again": none.astype(bool)}
    h = words.hashes()
    newline = np.concatenate([[0], np.cumsum(words.bytes == 10)])
    line = newline[words.starts]
    last = np.ones(n, dtype=bool)  # of a line or row
    last[:-1] = (line[1:] != line[:-1]) | (words.row[1:] != words.row[:-1])
    # hash of a word with the words after it: a very frequent word is not always the least or tied with itself
    gram = h.copy()
    for d in range(1, GRAM):
        if d < n:
            gram[:-d] += h[d:] * _PLACES[d]
    gram = mix64(gram)
    least = np.ones(n, dtype=bool)
    for d in range(1, reach + 1):
        if d < n:
            least[d:] &= gram[d:] <= gram[:-d]
            least[:-d] &= gram[:-d] <= gram[d:]
    # the neighbours must be of the same line: near its ends there are no cuts
    for d in range(1, reach + GRAM):
        if d < n:
            apart = (line[d:] != line[:-d]) | (words.row[d:] != words.row[:-d])
            if d <= reach:
                least[d:] &= ~apart
            least[:-d] &= ~apart
    least[: min(reach, n)] = False
    least[max(0, n - reach - GRAM + 1) :] = False
    chars = np.concatenate([[0], np.cumsum((words.bytes & 0xC0) != 0x80)])

    def cut(end_word: np.ndarray, salt: int) -> dict[str, np.ndarray]:
        first_word = np.concatenate([[0], end_word[:-1] + 1])
        count = end_word - first_word + 1
        # digest: sum over places of hash times an odd power, from the unit's start
        place = np.arange(n) - np.repeat(first_word, count)
        spread = h * _PLACES_LONG[place & 1023] + (place >> 10).astype(np.uint64)
        total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mix64(spread), dtype=np.uint64)])
        digest = mix64(total[end_word + 1] - total[first_word] + count.astype(np.uint64) + np.uint64(salt))
        row = words.row[first_word]
        base = chars[words.offsets[row]]
        first_of_row = np.searchsorted(row, np.arange(hi - lo))
        return {
            "row": row,
            "no": np.arange(len(row)) - first_of_row[row],
            "digest": digest.view(np.int64),
            "start": chars[words.starts[first_word]] - base,
            "end": chars[words.ends[end_word]] - base,
            "word": first_word - words.first[row],
            "words": count,
        }

    out = cut(np.flatnonzero(last | least), 0)
    if line_words[0] < line_words[1]:
        lines = cut(np.flatnonzero(last), 1 << 40)
        wanted = (lines["words"] >= line_words[0]) & (lines["words"] < line_words[1])
        lines["no"] = -1 - lines["no"]
        out = {k: np.concatenate([v, lines[k][wanted]]) for k, v in out.items()}
    row, digest = out["row"], out["digest"]
    order = np.lexsort((out["start"], digest, row))
    again = np.zeros(len(row), dtype=bool)
    again[order[1:]] = (digest[order[1:]] == digest[order[:-1]]) & (row[order[1:]] == row[order[:-1]])
    return out | {"again": again}


_PLACES_LONG = np.array([pow(int(_PLACES[1]), i + 1, 1 << 64) for i in range(1024)], dtype=np.uint64)


def unit_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH, line_words: tuple[int, int] = (0, 0)) -> DataFrame:
    """doc_id, row_key, no, digest, start, end, word, words, again for every unit of every text."""
    slim = docs.select(
        F.col(id_col).alias("doc_id"),
        F.xxhash64(F.col(id_col), F.col(text_col)).alias("row_key"),
        F.col(text_col).cast("string").alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = buffers(batch.column(2))
            for lo, hi in steps(offsets):
                u = units(raw, offsets, lo, hi, reach, line_words)
                take = pa.array(u["row"] + lo)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(take),
                        batch.column(1).take(take),
                        pa.array(u["no"].astype(np.int32)),
                        pa.array(u["digest"]),
                        pa.array(u["start"].astype(np.int32)),
                        pa.array(u["end"].astype(np.int32)),
                        pa.array(u["word"].astype(np.int32)),
                        pa.array(u["words"].astype(np.int32)),
                        pa.array(u["again"]),
                    ],
                    names=["doc_id", "row_key", "no", "digest", "start", "end", "word", "words", "again"],
                )

    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, row_key long, no int, digest long, start int, end int, word int, words int, again boolean")


def repeated_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, reach: int = REACH, min_line_words: int = MIN_LINE_WORDS
) -> DataFrame:
    """doc_id, row_key, span_start, span_end, n_words, n_units, first_doc_id: the passages to remove, apart from each other."""
    table = unit_table(docs, id_col, text_col, reach, (min_line_words, min_words))  # longer lines are runs
    lead = table.where("not again")
    shared = lead.groupBy("digest").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = shared.select(F.expr("digest + shiftright(n, 62)").alias("s_digest"), F.col("first.doc_id").alias("first_doc"), F.col("first.row_key").alias("first_key"))  # detached from the aggregate's partitioning
    elsewhere = lead.join(shared, (F.col("digest") == F.col("s_digest")) & (~F.col("doc_id").eqNullSafe(F.col("first_doc")) | (F.col("row_key") != F.col("first_key"))))
    columns = ["doc_id", "row_key", "no", "start", "end", "word", "words"]
    repeats = elsewhere.select(*columns, "first_doc").unionByName(table.where("again").select(*columns, F.col("doc_id").alias("first_doc")))
    # repeated rows share doc_id and row_key: one of each unit is enough
    repeats = repeats.groupBy(*columns).agg(F.min("first_doc").alias("first_doc"))
    by_row = W.partitionBy("doc_id", "row_key")
    # consecutive units have one difference; a line, whose no is below zero, has one of its own
    in_units = F.col("no") - F.row_number().over(by_row.orderBy(F.col("no") < 0, "no"))
    runs = repeats.withColumn("run", F.when(F.col("no") < 0, F.col("no") - (1 << 40)).otherwise(in_units))
    ends = [F.min("start").alias("start"), F.max("end").alias("end"), F.min("word").alias("word"), F.min("first_doc").alias("first_doc")]
    spans = runs.groupBy("doc_id", "row_key", "run").agg(*ends, F.max(F.col("word") + F.col("words")).alias("stop"), F.count(F.lit(1)).alias("n_units"))
    spans = spans.where((F.col("run") < -(1 << 39)) | (F.col("stop") - F.col("word") >= min_words))
    # a line may lie in a run or go on where one ends: together they are one span
    before = F.max("end").over(by_row.orderBy("start", "end", "run").rowsBetween(W.unboundedPreceding, -1))
    parts = spans.withColumn("opens", (F.col("start") > F.coalesce(before, F.lit(-1))).cast("int"))
    parts = parts.withColumn("span", F.sum("opens").over(by_row.orderBy("start", "end", "run").rowsBetween(W.unboundedPreceding, 0)))
    whole = parts.groupBy("doc_id", "row_key", "span").agg(*ends, F.max("stop").alias("stop"), F.sum("n_units").alias("n_units"))
    return whole.select(
        "doc_id", "row_key", F.col("start").cast("long").alias("span_start"), F.col("end").cast("long").alias("span_end"),
        (F.col("stop") - F.col("word")).cast("long").alias("n_words"), "n_units", F.col("first_doc").alias("first_doc_id"),
    )


def remove_spans(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts without the spans of ``repeated_spans``; other columns as they are."""
    key, own_key, cut = private(docs, "g_key", "row_key", "cut")
    cuts = spans.groupBy(F.col("row_key").alias(key)).agg(F.sort_array(F.collect_set(F.struct("span_start", "span_end"))).alias(cut))
    met = docs.withColumn(own_key, F.xxhash64(F.col(id_col), F.col(text_col))).join(cuts, F.col(own_key) == F.col(key), "left")
    text = F.col(text_col)
    before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(F.col(cut), i - 1)["span_end"])
    pieces = F.transform(cut, lambda s, i: F.substring(text, (before(i) + 1).cast("int"), (s["span_start"] - before(i)).cast("int")))
    tail = F.substring(text, (F.element_at(cut, -1)["span_end"] + 1).cast("int"), F.length(text))
    cleaned = F.when(F.col(cut).isNull(), text).otherwise(F.concat(F.array_join(pieces, ""), tail))
    return met.select(*[cleaned.alias(c) if c == text_col else F.col(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    spans = repeated_spans(documents(spark, sf_dir).select("doc_id", "text"))
    return spans.select("doc_id", "span_start", "span_end", "n_words", "n_units", "first_doc_id")
