"""Exact duplicates by progressive refinement (DataFrame functions only).

Level 1 groups texts by byte length, level 2 the texts of shared lengths by a hash of the
head, level 3 the texts of shared (length, head) by SHA-256 of the full text.  A row leaves
the search at the first level where it is alone: levels 1 and 2 see no digest, and the
digests that are grouped are those of level 2's survivors.  (The result has every row's
digest; that one is taken at the scan of the result and takes no part in the search.)

No level gathers a group: counts and the largest id are aggregated before each exchange,
and keys reach joins through an expression, which makes both join inputs plain exchanges
that AQE may split when one group is hot.

Defined results: a null text equals the empty text; a null id is never the larger one;
of a group the row with the largest id stays, and where several rows bear that id, or none
has an id, exactly one of them; ids may be of any type that can be ordered; an empty
table gives an empty result; extra columns are passed through ``exact_groups`` whatever their
names, and only those that bear a result column's name are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.classes import plain
from spanloom.llm.common import documents, private, text_or_empty

HEAD_CHARS = 64
RESULT = ("keep_id", "group_size", "kept", "text_sha256")


def _sizes(docs: DataFrame, text_col: str, head_chars: int) -> list:
    text = text_or_empty(text_col)
    return [F.octet_length(text).cast("long").alias("len"), F.xxhash64(F.substring(text, 1, head_chars)).alias("head")]


def shared_heads(docs: DataFrame, text_col: str = "text", head_chars: int = HEAD_CHARS) -> DataFrame:
    """Levels 1 and 2: the (len, head) that several rows have."""
    rows = docs.select(*_sizes(docs, text_col, head_chars))
    lengths = rows.groupBy("len").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(plain("len"))
    level1 = rows.join(lengths, "len", "left_semi").select(plain("len"), "head")
    return level1.groupBy("len", "head").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(plain("len"), "head")


def refine(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", head_chars: int = HEAD_CHARS) -> DataFrame:
    """Groups of two or more equal texts: len, head, sha, keep_id, group_size, top (rows that bear keep_id)."""
    rows = docs.select(F.col(id_col).alias("id"), *_sizes(docs, text_col, head_chars), F.sha2(text_or_empty(text_col), 256).alias("sha"))
    level2 = rows.join(shared_heads(docs, text_col, head_chars), ["len", "head"], "left_semi").select("id", plain("len"), "head", "sha")
    ids = level2.groupBy("len", "head", "sha", "id").agg(F.count(F.lit(1)).alias("top")).select("id", plain("len"), "head", "sha", "top")
    groups = ids.groupBy("len", "head", "sha").agg(F.max(F.struct("id", "top")).alias("last"), F.sum("top").alias("group_size"))
    return groups.where("group_size > 1").select("len", "head", "sha", F.col("last.id").alias("keep_id"), "group_size", F.col("last.top").alias("top"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", head_chars: int = HEAD_CHARS) -> DataFrame:
    """Every row with keep_id, group_size, kept and text_sha256."""
    own = [c for c in docs.columns if c.lower() not in RESULT]
    key, keep, size, top, sha = private(docs, "key", "keep", "size", "top", "sha")
    groups = refine(docs, id_col, text_col, head_chars).select(plain("sha").alias(key), F.col("keep_id").alias(keep), F.col("group_size").alias(size), F.col("top").alias(top))
    met = docs.withColumn(sha, F.sha2(text_or_empty(text_col), 256)).join(groups, F.col(sha) == F.col(key), "left")
    last = F.col(key).isNotNull() & F.col(id_col).eqNullSafe(F.col(keep))

    def result(rows: DataFrame, kept) -> DataFrame:
        keep_id = F.when(F.col(key).isNull(), F.col(id_col)).otherwise(F.col(keep))
        return rows.select(*own, keep_id.alias("keep_id"), F.coalesce(size, F.lit(1)).cast("long").alias("group_size"), kept.alias("kept"), F.col(sha).alias("text_sha256"))

    several = last & (F.col(top) > 1)
    plain_rows = result(met.where(~F.coalesce(several, F.lit(False))), F.col(key).isNull() | last)
    # rows that can't be told apart by id and text: one of them, whichever
    tied = met.where(several)
    numbered = tied.withColumn(top, F.row_number().over(Window.partitionBy(sha).orderBy(F.lit(0))))
    return plain_rows.unionByName(result(numbered, F.col(top) == 1))


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with their own columns only."""
    clash = [c for c in docs.columns if c.lower() in RESULT]
    names = dict(zip(clash, private(docs, *[f"own_{c}" for c in clash]), strict=True))
    rows = exact_groups(docs.withColumnsRenamed(names), names.get(id_col, id_col), names.get(text_col, text_col))
    return rows.where("kept").select(*[F.col(names.get(c, c)).alias(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return exact_groups(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE = """
WITH t AS (SELECT doc_id, sha256(coalesce(text, '')) AS s FROM documents),
g AS (SELECT s, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY s)
SELECT t.doc_id AS doc_id, g.keep_id AS keep_id, g.group_size AS group_size,
       t.doc_id = g.keep_id AS kept, t.s AS text_sha256
FROM t JOIN g ON t.s = g.s
"""
