"""Spans with offsets in pure Catalyst, and the scalar functions around them.

Offsets are code points, 0-based, end exclusive.  A pattern's matches and the
pieces between them interleave, so a match starts after the pieces and matches
before it; no Python touches the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.schemas import CATEGORY_PRIORITY

#: White space as Python's str.isspace has it.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def piece(text: Column, start: Column, end: Column) -> Column:
    """text[start:end] with clamping, as slices have it."""
    low = F.greatest(start, F.lit(0))
    return F.substring(text, (low + 1).cast("int"), F.greatest(end - low, F.lit(0)).cast("int"))


def before(text: Column, start: Column, width: int) -> Column:
    return piece(text, start - width, start)


def after(text: Column, end: Column, width: int) -> Column:
    return piece(text, end, end + width)


def find_spans(text: Column, pattern: str | Column, group: int = 0) -> Column:
    """array<struct<start, end, text>> of a pattern's matches.

    With a group, the span is the group's value, which must end its match.  The place is
    carried along the matches, so that a text with many of them is not counted anew for each;
    a text without a match is searched once.
    """
    regex = F.lit(pattern) if isinstance(pattern, str) else pattern
    found = F.regexp_extract_all(text, regex, F.lit(0))
    none = F.array().cast("array<struct<start:int,end:int,text:string>>")

    def rows(matches: Column) -> Column:
        parts = F.struct(F.split(text, regex, -1).alias("g"), (F.regexp_extract_all(text, regex, F.lit(group)) if group else matches).alias("v"))
        return F.when(F.size(matches) > 0, let(parts, lambda p: walk(matches, p))).otherwise(none)

    def walk(matches: Column, p: Column) -> Column:
        def step(state: Column, i: Column) -> Column:
            value = F.get(p["v"], i)
            end = state["at"] + F.length(F.get(p["g"], i)) + F.length(F.get(matches, i))
            one = lambda e: F.struct(e.alias("at"), F.array_append(state["out"], F.struct((e - F.length(value)).alias("start"), e.alias("end"), value.alias("text"))).alias("out"))
            return let(end, one)

        zero = F.struct(F.lit(0).alias("at"), none.alias("out"))
        return F.aggregate(F.sequence(F.lit(0), F.size(matches) - 1), zero, step, lambda state: state["out"])

    return let(found, rows)


def literal(value: Column | str) -> Column:
    """A value as a literal inside a pattern."""
    value = F.lit(value) if isinstance(value, str) else value
    return F.concat(F.lit("\\Q"), F.replace(value, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def whole_word(pattern: Column | str, ignore_case: bool = True) -> Column:
    """Not inside a longer word; Unicode-aware."""
    body = F.lit(pattern) if isinstance(pattern, str) else pattern
    return F.concat(F.lit("(?iuU)" if ignore_case else "(?U)"), F.lit(r"(?<!\w)(?:"), body, F.lit(r")(?!\w)"))


def fold(value: Column) -> Column:
    """Case folding for keys; full folding differs from lower case mainly at sharp s."""
    return F.replace(F.lower(value), F.lit("ß"), F.lit("ss"))


def name_form(value: Column) -> Column:
    """A name with its separators collapsed, trimmed and folded."""
    return fold(F.regexp_replace(F.regexp_replace(value, r"^[\s ]+|[\s ]+$", ""), r"[ _\t ]+", " "))


def name_pattern(value: Column) -> Column:
    """A name as a pattern in which its separators are interchangeable."""
    parts = F.split(F.trim(value), r"[ _\t ]+", -1)
    return F.array_join(F.transform(parts, lambda p: literal(p)), r"[ _\t ]+")


def words(text: Column) -> Column:
    """Number of runs of non-space characters."""
    return F.size(F.regexp_extract_all(text, F.lit(r"(?U)\S+"), F.lit(0))).cast("long")


def is_blank(text: Column) -> Column:
    return ~text.rlike("(?s)[^\\s\\x1c-\\x1f\\x85\\p{Z}]")


def count_non_space(text: Column) -> Column:
    return F.length(F.regexp_replace(text, SPACE, "")).cast("long")


def iban_valid(value: Column) -> Column:
    """Shape, length 15 to 34 and remainder 1 modulo 97."""
    compact = F.upper(F.regexp_replace(value, "[ -]", ""))

    def remainder(c: Column) -> Column:
        turned = F.concat(F.substring(c, 5, 34), F.substring(c, 1, 4))
        digit = lambda x: F.when(x.rlike("[0-9]"), F.ascii(x) - 48).otherwise(F.ascii(x) - 55)
        step = lambda r, x: F.when(digit(x) > 9, r * 100 + digit(x)).otherwise(r * 10 + digit(x)) % 97
        return F.aggregate(F.filter(F.split(turned, "", -1), lambda x: x != ""), F.lit(0), step)

    shaped = lambda c: (F.length(c) >= 15) & (F.length(c) <= 34) & c.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]+$")
    return let(compact, lambda c: F.when(shaped(c), remainder(c) == 1).otherwise(F.lit(False)))


def json_string(value: Column) -> Column:
    """A string as JSON without escaping what lies outside ASCII."""
    out = F.replace(value, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit('"'), F.lit('\\"'))
    for char, mark in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
        out = F.replace(out, F.lit(char), F.lit(mark))
    for code in [*range(0, 8), 11, *range(14, 32)]:
        out = F.replace(out, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
    return F.concat(F.lit('"'), out, F.lit('"'))


def json_list(*items: Column) -> Column:
    """A list over several lines, indented by two, as the canonical form has it."""
    return F.concat(F.lit("[\n  "), F.concat_ws(",\n  ", *items), F.lit("\n]"))


def occurrence_id(segment_id: Column, start: Column, end: Column, category: Column, text: Column) -> Column:
    """'o' and 20 hex digits over the canonical JSON of the source finding."""
    raw = json_list(json_string(segment_id), start.cast("string"), end.cast("string"), json_string(category), json_string(text))
    return F.concat(F.lit("o"), F.substring(F.sha2(raw, 256), 1, 20))


def group_id(category: Column, entity_key: Column, text: Column) -> Column:
    """'g' and 20 hex digits over category and identity (the key, or else the folded text)."""
    identity = F.when(F.length(entity_key) > 0, entity_key).otherwise(fold(text))
    return F.concat(F.lit("g"), F.substring(F.sha2(json_list(json_string(category), json_string(identity)), 256), 1, 20))


def category_rank(category: Column) -> Column:
    rank = F.lit(100)
    for i, name in enumerate(CATEGORY_PRIORITY):
        rank = F.when(category == name, F.lit(i)).otherwise(rank)
    return rank


def overlay(text: Column, cuts: Column) -> Column:
    """Splice array<struct<start, end, replacement>> of disjoint spans into a text, from the right."""
    step = lambda t, c: F.concat(piece(t, F.lit(0), c["start"]), c["replacement"], F.substring(t, (c["end"] + 1).cast("int"), F.length(t)))
    return F.aggregate(F.sort_array(cuts, asc=False), text, step)


def token_prefix(category: Column) -> Column:
    cleaned = F.regexp_replace(F.upper(category), "[^A-Z0-9_]", "")
    return F.when(cleaned == "", F.lit("PII")).otherwise(cleaned)


def token(category: Column, number: Column) -> Column:
    return F.concat(token_prefix(category), F.lit("_"), F.when(number < 1000, F.lpad(number.cast("string"), 3, "0")).otherwise(number.cast("string")))


def utf16_units(text: Column) -> Column:
    """Length in UTF-16 units, which spreadsheets count: astral characters are two."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("long")


def round6(x: Column) -> Column:
    return F.bround(x, 6)


def ratio(a: Column, b: Column) -> Column:
    """a / b to six places, 0 where b is 0."""
    return F.coalesce(round6(F.try_divide(a.cast("double"), b.cast("double"))), F.lit(0.0))


def label_key(label: Column) -> Column:
    """A model's label in one spelling."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(label)), "[ -]+", "_"), "_+", "_")


def private(df: DataFrame, *names: str) -> list[str]:
    """Column names that the table doesn't have, in any case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def explode_findings(segments: DataFrame, spans: Column, *keep: str) -> DataFrame:
    """One row a span struct, with the segment's identity."""
    return segments.select("doc_id", "segment_id", *keep, F.explode(spans).alias("__s")).select("doc_id", "segment_id", *keep, "__s.*")
