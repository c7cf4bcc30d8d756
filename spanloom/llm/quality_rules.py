"""Rule bitmask ledger (DataFrame functions only).

Every rule is evaluated once per row.  The ledger keeps the measurements and one
long of failure bits; policies are named, versioned masks applied to those bits,
so a new policy or an ablation reads the ledger and never a text again.

Words are ``[^\\x20\\x09-\\x0D]+``.  Repeats inside a text are found on 64-bit
hashes of five-word windows held in the row itself: nothing is exchanged, and
only a text that has some repeated window pays for a sort.

Defined results: a null text has no words and fails ``few_words``; counts of an
empty text are 0; a null id passes through; repeated rows are judged alike; an
empty table gives an empty ledger; extra columns pass through, those named like
a ledger column are replaced.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import SEPARATORS, documents, text_or_empty

WINDOW = 5
SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_exclaims")

#: name, what fails; the place in this list is the bit.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("many_words", "n_words > 200000"),
    ("short_mean_word", "word_chars < 2 * n_words"),
    ("long_mean_word", "word_chars > 25 * n_words"),
    ("symbols", "10 * n_symbols > 3 * n_words"),
    ("repeated_lines", "100 * n_dup_lines > 40 * n_lines"),
    ("exclaims", "2 * n_exclaims > n_words"),
]
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}


def mask(*names: str) -> int:
    return sum(BIT[n] for n in names)


#: policy name -> version -> mask
POLICIES: dict[str, dict[int, int]] = {
    "base": {1: mask("few_words", "repeated_windows")},
    "web": {
        1: mask("few_words", "repeated_windows", "many_words", "short_mean_word", "long_mean_word", "symbols"),
        2: mask(*BIT),
        3: mask(*(n for n in BIT if n != "many_words")),  # size alone is no fault: the bit is a measurement
    },
}
DEFAULT_POLICY = ("web", 3)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _without(text: Column, characters: str) -> Column:
    return reduce(lambda t, c: F.replace(t, F.lit(c)), characters, text)


def _repeats(words: Column, n: Column, window: int) -> Column:
    """Words inside windows that occur more than once, overlaps counted once."""

    def covered(at: Column) -> Column:
        gap = lambda p, j: F.least(F.lit(window), F.coalesce(F.get(at, j + 1), p + window) - p)
        return F.aggregate(F.transform(at, gap), F.lit(0), lambda total, x: total + x)

    def places(s: Column) -> Column:
        twin = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
        same = lambda x, j: twin(x, j - 1) | twin(x, j + 1)
        return F.sort_array(F.transform(F.filter(s, same), lambda x: x["i"]))

    def in_grams(g: Column) -> Column:
        pairs = F.array_sort(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(let(let(pairs, places), covered))

    grams = F.transform(
        F.sequence(F.lit(0), n - window), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(window)])
    )
    return F.when(n < window + 1, F.lit(0)).otherwise(let(grams, in_grams)).cast("long")


def measure(docs: DataFrame, text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The measurements, each read from the whole text once."""
    kept = [c for c in docs.columns if c not in (*MEASURES, "fail_bits")]
    blank = "[" + "".join(f"\\x{ord(c):02x}" for c in SEPARATORS) + "]+"
    text = F.col("__text")
    base = docs.select(*kept, text_or_empty(text_col).alias("__text"))
    cut = base.select(
        *kept,
        text.alias("__text"),
        F.array_remove(F.split(text, blank, -1), "").alias("__words"),
        F.filter(F.split(text, "\n", -1), lambda x: F.length(_without(x, SEPARATORS)) > 0).alias("__lines"),
    )
    n = F.size("__words")
    measures = F.struct(
        n.cast("long").alias("n_words"),
        F.length(_without(text, SEPARATORS)).cast("long").alias("word_chars"),
        (F.length(text) - F.length(_without(text, SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        _repeats(F.col("__words"), n, window).alias("n_repeat_words"),
        F.size("__lines").cast("long").alias("n_lines"),
        (F.length(text) - F.length(_without(text, "!"))).cast("long").alias("n_exclaims"),
    )
    # a generator, not a projection: filters on the ledger can't be pushed below it, where they
    # would repeat the split of the text for every rule, and inside lambdas for every word
    return cut.select(*kept, F.inline(F.array(measures)))


def ledger(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Input columns, measurements and ``fail_bits``."""
    bits = reduce(
        lambda a, b: a.bitwiseOR(b),
        [F.when(F.expr(fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, (_, fails) in enumerate(RULES)],
    )
    return measure(docs, text_col).withColumn("fail_bits", bits)


def apply_policy(rows: DataFrame, policy: str = DEFAULT_POLICY[0], version: int = DEFAULT_POLICY[1]) -> DataFrame:
    """Ledger rows with ``kept`` under a policy."""
    return rows.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(POLICIES[policy][version]).cast("long")) == 0)


def ablation(rows: DataFrame, policy: str = DEFAULT_POLICY[0], version: int = DEFAULT_POLICY[1]) -> DataFrame:
    """Per rule of a policy: rows failing it, rows failing it alone, rows kept if it were dropped."""
    used = POLICIES[policy][version]
    seen = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(used).cast("long")).alias("bits")).count()  # 2**rules lines at most
    rules = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(b).cast("long").alias("bit")) for n, b in BIT.items() if b & used]))
    each = seen.select("bits", "count", rules.alias("r")).select("bits", "count", "r.*")
    total = lambda cond: F.sum(F.when(cond, F.col("count")).otherwise(0))
    return each.groupBy("rule").agg(
        total(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("failed"),
        total(F.col("bits") == F.col("bit")).alias("failed_alone"),
        total(F.col("bits").bitwiseAND(F.bitwise_not("bit")) == 0).alias("kept_without"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    rows = apply_policy(ledger(documents(spark, sf_dir).select("doc_id", "text")), "web", 2)  # as ORACLE has it
    base = F.col("fail_bits").bitwiseAND(F.lit(POLICIES["base"][1]).cast("long")) != 0
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "fail_bits"
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
      FROM d),
g AS (SELECT doc_id, unnest(range(1, greatest(len(words) - 3, 1))) AS i, words FROM w),
h AS (SELECT doc_id, i, list_slice(words, i, i + 4) AS gram FROM g),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM h) WHERE n > 1),
c AS (SELECT doc_id, sum(least(5, coalesce(nxt - i, 5))) AS n_repeat_words
      FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM r) GROUP BY doc_id),
m AS (SELECT w.doc_id AS doc_id, CAST(len(words) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(c.n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
             CAST(len(lines) AS BIGINT) AS n_lines,
             CAST(length(regexp_replace(text, '[^!]', '', 'g')) AS BIGINT) AS n_exclaims
      FROM w LEFT JOIN c ON w.doc_id = c.doc_id),
b AS (SELECT *, CAST((CASE WHEN n_words < 10 THEN 1 ELSE 0 END)
           + (CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END)
           + (CASE WHEN n_words > 200000 THEN 4 ELSE 0 END)
           + (CASE WHEN word_chars < 2 * n_words THEN 8 ELSE 0 END)
           + (CASE WHEN word_chars > 25 * n_words THEN 16 ELSE 0 END)
           + (CASE WHEN 10 * n_symbols > 3 * n_words THEN 32 ELSE 0 END)
           + (CASE WHEN 100 * n_dup_lines > 40 * n_lines THEN 64 ELSE 0 END)
           + (CASE WHEN 2 * n_exclaims > n_words THEN 128 ELSE 0 END) AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits FROM b
"""
