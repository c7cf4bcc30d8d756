"""Near-duplicate lines by a segment-partition edit join (DataFrame functions only).

A line of ``min_chars`` code points or more (after trimming) takes part.  Equal
lines of any such length are one; two different ones are linked when one of two thresholds, which grow with the shorter one, holds:

* in code points: an edit for each ``CHARS_AN_EDIT``, at most ``edits``;
* in words: a line of ``MIN_WORDS`` words or more may have an inserted, removed or
  changed word for each ``WORDS_AN_EDIT``, and one in any case, however long the word.

Segments: with as many segments as edits and one more, some segment is whole and has moved by
no more than the segments on its nearer side (``anchors``), so few keys serve all lengths of a class.
Lines of fewer than 20 words meet by segments in code points (short ones by exact length), and from
12 words on by halves; lines of up to ``LONG`` words by segments of words, with gaps between.
A longer line would have too many segments, as the threshold grows with it, so it is cut where its
own characters say so; an edit changes two of these pieces at most, and two linked lines share one
among their longest (as many as edits can change, and one).  A line of too few pieces has runs of
``GRAM`` words besides.
Characters of scripts without blanks are words of their own.

Keys that an index entry and another line have are buckets.  Lines of a bucket meet its
hubs in rounds (``classes``), so that no bucket's lines are all paired; parities of characters and
words filter in the join's condition, and a pair is verified by a bit-parallel automaton along
the band of ``2 * edits + 1`` diagonals (one bit a diagonal, one word for each number of edits)
after the common head and tail, or by a banded edit distance over one character a word.

Linked lines are one class, chains included.  Of a class the earliest occurrence (by doc_id,
then place) stays, all others go, so that a line's leader always stays.  Equal lines
are grouped first, so a line that a third of all documents share is one row in the join.

Result: ``n_links`` is the number of other distinct lines that a line is linked with.  Classes
need only some of the links; all of them are counted afterwards inside each class (``link_counts``),
as sums, so that no row is made for a pair.  ``dedup_lines`` needs no counts and leaves that out.

Defined results: null and empty texts have no lines and stay as they are; blank and
shorter lines always stay; a null doc_id ranks first; rows that repeat a document (same id
and text) have the same result; an empty table gives an empty result; doc_id may be of
any type that can be ordered; extra columns pass through ``dedup_lines``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.classes import classes, plain, sized, with_payload
from spanloom.llm.common import Work, documents, pair_texts, private, text_or_empty

EDITS = 2
MIN_CHARS = 1
CHARS_AN_EDIT = 15
MIN_WORDS = 12
WORDS_AN_EDIT = 20
#: Least numbers of words of classes of lines whose segments are found from their ends; beyond the last class, content cuts pieces.
CLASSES = (20, 28, 40, 60)
LONG = 4 * WORDS_AN_EDIT
#: Words between segments, and edits of code points up to which segments of words are long enough.
GAP = 2
MOST_EDITS = 4
#: Lines of so few code points meet by segments of lines of exactly their length, longer ones by classes of lengths.
EXACT = 48
GRAM = 4
#: Up to so many members of a class are all compared with each other, those of a larger one where they share a key; so many at once.
TOGETHER = 512
BLOCK = 128
#: Lines of so many words have parities of their own for four kinds of words; a plain edit distance is not taken of lines of so many code points.
MANY = 100
VERY_LONG = 500
#: Long lines are cut at blanks behind these characters, which end about every fourth word of scripts that have them.
CUT = " (?<=[aeimquyAEIMQUY!?;] )"
#: Scripts written without blanks.
UNSPACED = r"([\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u2E80-\uA4CF\uF900-\uFAFF\x{20000}-\x{3FFFF}])"


def let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row_key, line_no and line for every line of every text."""
    text = text_or_empty(text_col)
    base = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("row_key"), F.split(text, "\n", -1).alias("lines"))
    return base.select("doc_id", "row_key", F.posexplode_outer("lines").alias("line_no", "raw")).select(
        "doc_id", "row_key", "line_no", F.trim("raw").alias("line")
    )


def takes_part(min_chars: int) -> Column:
    """Lines of ``min_chars`` code points or more with something else than blanks in them."""
    return (F.length("line") >= min_chars) & (F.ltrim("line", F.lit(" \t\r\x0b\x0c")) != "")


def line_id() -> Column:
    """Hash of a line; the last bit is free."""
    return F.xxhash64("line").bitwiseAND(F.lit(-2))


def probe_moves(edits: int) -> list[tuple[int, int, int]]:
    """(how much shorter, segment, move): where a segment of a shorter line can lie in a line."""
    out = []
    for shorter in range(edits + 1):
        for i in range(edits + 1):
            low = max(-i, shorter - (edits - i), -((edits - shorter) // 2))
            high = min(i, shorter + (edits - i), (edits + shorter) // 2)
            out += [(shorter, i, move) for move in range(low, high + 1)]
    return out


def anchors(edits: int) -> list[tuple[int, int]]:
    """(segment, how far it can have moved) for a line in ``edits + 1`` segments, each found from the nearer end.

    The first segment up to whose end there are no more edits than segments before it is whole, has as many edits
    before it as segments, and at most the rest of the edits behind it.
    """
    return [(i, min(i, edits - i)) for i in range(edits + 1)]


def word_classes(edits: int) -> list[tuple[int, int]]:
    """Least and next number of words of each class; lines of fewer words meet by code points and halves, those of more by pieces."""
    if edits > MOST_EDITS:
        return [(LONG // 2, LONG // 2)]
    return list(zip(CLASSES, (*CLASSES[1:], LONG), strict=True))


def place(by_words: bool, which: int, at: int, i: int, m: int, indexed: bool) -> Column:
    """A negative long for a key that is still to be made: which class, where a segment begins (negative: from the end), its number, and its words or its move."""
    return F.lit(-(1 << 63) | by_words << 50 | which << 40 | (at + 512) << 30 | i << 20 | (m + 512) << 10 | indexed)


def whole(key: Column, indexed: Column | bool = True) -> Column:
    """A long that is not negative for a key as it is; the last bit is set if it is indexed."""
    flag = F.lit(int(indexed)) if isinstance(indexed, bool) else indexed.cast("int")
    return key.bitwiseAND(F.lit((1 << 63) - 2)).bitwiseOR(flag.cast("long"))


def exact_keys(line: Column, n: Column, edits: int) -> Column:
    """Keys of a line among lines of exactly its length or some more: its own segments, which are indexed, and every place that one can have moved to (0: none)."""
    div = lambda x, y: F.call_function("div", x, y).cast("int")

    def keyed(p: Column) -> Column:
        length, k = n - p["s"], p["e"] + 1

        def inside(f: Column) -> Column:
            at, own = p["i"] * f["size"] + F.greatest(F.lit(0), p["i"] - f["short"]) + p["m"], f["size"] + F.when(p["i"] >= f["short"], 1).otherwise(0)
            fits = (at >= 0) & (at + own <= n) & (F.least(F.lit(edits), div(length, F.lit(CHARS_AN_EDIT))) == p["e"])
            return F.when(fits, whole(F.xxhash64(F.lit(2), p["e"], length, p["i"], F.substring(line, at + 1, own)), p["t"])).otherwise(F.lit(0).cast("long"))

        return let(F.struct(div(length, k).alias("size"), (k - length % k).alias("short")), inside)  # so many segments come first that are shorter by one

    # where the threshold changes, a line looks for shorter ones by theirs
    ends = lambda e: max(EXACT, edits * CHARS_AN_EDIT) if e == edits else (e + 1) * CHARS_AN_EDIT
    each = [F.array(*[F.struct(*[F.lit(x).alias(c) for x, c in zip((e, *at, at[0] == at[2] == 0), "esimt", strict=True)]) for at in probe_moves(e)]) for e in range(1, edits + 1)]
    known = F.concat(*[F.when((n >= e * CHARS_AN_EDIT) & (n < ends(e) + e), places).otherwise(F.slice(places, 1, 0)) for e, places in enumerate(each, 1)])
    return F.transform(known, keyed)


def length_places(edits: int) -> Column:
    """Segments of lines of a class of lengths, the line's own and the next; they begin at multiples of their size."""
    return F.array(*[place(False, which, i if 2 * i <= edits else i - edits - 1, i, move, move == 0) for which in (0, 1) for i, far in anchors(edits) for move in range(-far, far + 1)])


def word_places(least: int, beyond: int, edits: int, step: int) -> Column:
    """Segments of lines of a class of numbers of words; ``step``: how many words an edit can move the rest of the line.

    A code point can change three neighbouring words, so that there are ``GAP`` words between segments.
    """
    most = max(edits, (beyond - 1) // WORDS_AN_EDIT)
    room = least - max(edits, (least - 1) // WORDS_AN_EDIT) - GAP * most
    out = []
    for i, far in anchors(most):
        size = room // (most + 1)
        at = i * (size + GAP) if i <= most - i else -(size + (most - i) * (size + GAP))
        out += [place(True, least, at + move, i, size, move == 0) for move in range(-far * step, far * step + 1)]
    return F.array(*out)


def length_class(length: Column) -> Column:
    """The length without all but its three leading bits: classes an eighth to a quarter wide."""
    drop = F.floor(F.log2(length)).cast("int") - 2
    return F.call_function("shiftleft", F.call_function("shiftright", length, drop), drop)


def whole_keys(words: Column, edits: int) -> tuple[Column, Column]:
    """Keys of a line of few words (its halves), and of a line of many (its longest pieces)."""

    def halves(w: Column) -> Column:
        n = F.size(w)
        sizes = F.array_distinct(F.array(F.floor((n - 1) / 2).cast("int"), F.floor((n - 2) / 2).cast("int")))
        both = lambda k: F.array(F.xxhash64(F.lit(0), k, F.slice(w, F.lit(1), k)), F.xxhash64(F.lit(1), k, F.slice(w, n - k + 1, k)))
        return F.flatten(F.transform(sizes, both))

    def least_runs(w: Column, most: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.size(w) - GRAM), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(GRAM)]))
        # an edit of a word breaks GRAM runs at most; one of a code point changes up to three words in a row
        broken = F.greatest(GRAM * most, F.lit((GRAM + 2) * edits))
        return F.slice(F.sort_array(F.array_distinct(runs)), F.lit(1), broken + 1)

    def longest_pieces(w: Column) -> Column:
        most = word_edits(F.size(w))
        # an edit changes a piece, and the next one if it makes or removes a cut
        broken = 2 * F.greatest(most, F.lit(edits))

        def ranked(x: Column) -> Column:
            long = F.shiftleft((4095 - F.least(F.octet_length(x), F.lit(4095))).cast("long"), 51)
            return long.bitwiseOR(F.shiftrightunsigned(F.xxhash64(x), 13))

        pieces = F.transform(F.split("line", CUT, -1), ranked)
        # too few to be sure of one: all of them, and runs
        few = lambda h: F.when(F.size(h) > broken, F.slice(F.sort_array(h), F.lit(1), broken + 1)).otherwise(F.concat(h, least_runs(w, most)))
        return let(F.array_distinct(pieces), few)

    return halves(words), longest_pieces(words)


def line_keys(lines: DataFrame, edits: int) -> DataFrame:
    """key and tag of every line (id, line): its id, the last bit set if the key is indexed.

    The places are unfolded before the key is computed, so that one small expression
    serves all of them; written out side by side they make a method that the JVM does not compile.
    """
    each, n, size = word_classes(edits), F.col("n"), F.size("w")
    first, last = each[0][0], each[-1][1]
    lines = lines.select("id", "line", F.length("line").alias("n"), is_wide(F.col("line")).alias("wide"))
    lines = lines.select("id", "line", "n", "wide", F.inline(F.array(F.struct(words_of(F.col("line"), F.col("wide")).alias("w")))))
    # linked lines have one class in common: a line looks up, as it may be the shorter one, and one that words
    # of a single character can have made longer looks down
    low, high = size - F.when(F.col("wide"), 2 * edits).otherwise(0), size + F.greatest(F.lit(edits), word_edits(size))
    none = F.array().cast("array<bigint>")
    given = lambda keys: F.transform(keys, lambda h: whole(h))
    halves, pieces = whole_keys(F.col("w"), edits)
    exact, one = max(EXACT, edits * CHARS_AN_EDIT), sum(2 * far + 1 for _, far in anchors(edits))
    by_length = F.when(length_class(n) == length_class(n + edits), F.slice(length_places(edits), 1, one)).otherwise(length_places(edits))
    parts = [F.when((low < first) & (n < exact + edits), exact_keys(F.col("line"), n, edits)), F.when((low < first) & (n >= exact), by_length)]
    for least, beyond in each:
        if least < beyond:
            parts += [F.when((high < least) | (low >= beyond), none).when(F.col("wide"), word_places(least, beyond, edits, 2)).otherwise(word_places(least, beyond, edits, 1))]
    parts += [F.when((low < first) & (size >= MIN_WORDS), given(halves)), F.when(high >= last, given(pieces))]
    # functions of elements run outside of generated code, so they come before and not in the step that unfolds; that
    # one is an outer one, as Spark works arrays out twice otherwise, to see whether they are empty
    places = F.concat(*[F.coalesce(x, none) for x in parts]).alias("places")
    sized = lambda c: F.floor(F.greatest(F.lit(edits * CHARS_AN_EDIT), c - edits) / (edits + 1)).cast("int")
    of_class = [f(x).alias(f"{c}{k}") for c, f in (("l", length_class), ("z", lambda x: sized(length_class(x)))) for k, x in enumerate((n, n + edits))]
    rows = lines.select("id", "line", "n", "w", *of_class, places).select("id", "line", "n", "w", "l0", "l1", "z0", "z1", F.explode_outer("places").alias("p")).where("p != 0")
    p = F.col("p")
    field = lambda at: F.shiftright(p, at).bitwiseAND(F.lit(1023)).cast("int")
    which, at, i, m = field(40), field(30) - 512, field(20), field(10) - 512
    by_words = F.xxhash64(which, i, F.slice("w", F.when(at < 0, size).otherwise(0) + at + 1, m))
    start = F.when(at < 0, n).otherwise(0) + at * F.when(which == 0, F.col("z0")).otherwise(F.col("z1")) + m + 1
    by_chars = F.xxhash64(F.when(which == 0, F.col("l0")).otherwise(F.col("l1")), i, F.substring(F.col("line"), start, F.when(which == 0, F.col("z0")).otherwise(F.col("z1"))))
    made = F.when(p.bitwiseAND(F.lit(1 << 50)) != 0, by_words).otherwise(by_chars)
    key = F.when(p >= 0, p).otherwise(made).bitwiseAND(F.lit(-2))
    return rows.select(F.coalesce(key, F.lit(0)).alias("key"), F.col("id").bitwiseOR(p.bitwiseAND(F.lit(1))).alias("tag"))


def _common_head(a: Column, b: Column) -> Column:
    """Length of the common prefix, by doubling steps."""
    grow = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.length(a), F.lit(2)))).cast("int")))
    steps = F.reverse(F.transform(grow, lambda i: F.call_function("shiftleft", F.lit(1), i)))
    same = lambda at, step: (at + step <= F.least(F.length(a), F.length(b))) & (F.substring(a, at + 1, step) == F.substring(b, at + 1, step))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(same(at, step), at + step).otherwise(at))


def _automaton(a: Column, b: Column, edits: int) -> Column:
    """Whether the edit distance is at most ``edits``; a and b are arrays of characters.

    Bit d of word e says: the first i characters of a and i + d - edits of b are
    within e edits.
    """
    width = 2 * edits + 1
    full = (1 << width) - 1
    n, m = F.size(a), F.size(b)

    def meeting(i: Column) -> Column:
        """Bit d: character i of a is the one of b on diagonal d."""
        char = F.get(a, i)
        bits = [F.when(F.get(b, i + (d - edits)) == char, F.lit(1 << d)).otherwise(F.lit(0)) for d in range(width)]
        return reduce(lambda x, y: x.bitwiseOR(y), bits)

    def closed(raw: list[Callable[[], Column]], done: list[Column]) -> Column:
        """Bind the words one after another; an insertion steps to the next diagonal for an edit."""
        e = len(done)
        if e == len(raw):
            return F.struct(*[w.alias(f"w{k}") for k, w in enumerate(done)])
        word = raw[e]()
        if e:
            word = word.bitwiseOR(done[-1]).bitwiseOR(F.shiftleft(done[-1], 1)).bitwiseAND(F.lit(full))
        return let(word, lambda w: closed(raw, [*done, w]))

    def step(state: Column, i: Column) -> Column:
        old = [state[f"w{e}"] for e in range(edits + 1)]

        def words(meets: Column) -> Column:
            raw = [lambda: old[0].bitwiseAND(meets)]
            for e in range(1, edits + 1):
                # match; substitution; deletion, which is a step to the diagonal before
                raw.append(lambda e=e: old[e].bitwiseAND(meets).bitwiseOR(old[e - 1]).bitwiseOR(F.shiftright(old[e - 1], 1)))
            return closed(raw, [])

        return let(meeting(i), words)

    def guarded(state: Column, i: Column) -> Column:
        return F.when(state[f"w{edits}"] == 0, state).otherwise(step(state, i))

    first = [1 << edits]
    for _ in range(edits):
        first.append((first[-1] | first[-1] << 1) & full)
    zero = F.struct(*[F.lit(w).alias(f"w{e}") for e, w in enumerate(first)])
    # places beyond the end of b are reached by edits only and don't count at the end
    end = F.aggregate(F.sequence(F.lit(0), n - 1), zero, guarded)
    last = F.when(n == 0, F.lit(full)).otherwise(end[f"w{edits}"])
    diagonal = m - n + edits
    hit = F.call_function("shiftright", last, F.greatest(F.lit(0), F.least(diagonal, F.lit(width)))).bitwiseAND(F.lit(1)) == 1
    return (F.abs(m - n) <= edits) & (F.when(n == 0, m <= edits).otherwise(hit))


def within_edits(a: Column, b: Column, edits: int) -> Column:
    """Banded bit-parallel check of two strings."""

    def cores(head: Column) -> Column:
        x, y = F.substring(a, head + 1, F.length(a)), F.substring(b, head + 1, F.length(b))
        pair = F.struct(F.reverse(x).alias("x"), F.reverse(y).alias("y"))
        return let(pair, tails)

    def tails(p: Column) -> Column:
        return let(_common_head(p["x"], p["y"]), lambda t: core(F.substring(p["x"], t + 1, F.length(p["x"])), F.substring(p["y"], t + 1, F.length(p["y"]))))

    def core(x: Column, y: Column) -> Column:
        chars = lambda s: F.array_remove(F.split(s, "", -1), "")
        return let(F.struct(chars(x).alias("x"), chars(y).alias("y")), lambda c: _automaton(c["x"], c["y"], edits))

    return (F.abs(F.length(a) - F.length(b)) <= edits) & let(_common_head(a, b), cores)


def is_wide(line: Column) -> Column:
    """Whether there are characters of scripts without blanks; none of them is before U+0E00, which takes little to see."""
    return (F.octet_length(line) > F.length(line)) & line.rlike("[^\\x00-\\u0DFF]") & line.rlike(UNSPACED)


def words_of(line: Column, wide: Column | None = None) -> Column:
    """Pieces between blanks; characters of scripts without blanks are pieces of their own."""
    return F.split(F.when(is_wide(line) if wide is None else wide, F.regexp_replace(line, UNSPACED, " $1 ")).otherwise(line), " ", -1)


def char_edits(length: Column, edits: int) -> Column:
    """Edits in code points that a line of ``length`` may have."""
    return F.least(F.lit(edits), F.floor(length / CHARS_AN_EDIT).cast("int"))


def word_edits(n: Column) -> Column:
    """Edits of words that a line of ``n`` words may have."""
    return F.when(n < MIN_WORDS, 0).otherwise(F.greatest(F.lit(1), F.floor(n / WORDS_AN_EDIT).cast("int")))


def shared_keys(lines: DataFrame, edits: int) -> DataFrame:
    """id and keys of every line that has a key in common with an indexed one."""
    rows = line_keys(lines, edits).repartition("key")
    own = F.col("tag").bitwiseAND(F.lit(-2))
    found = rows.groupBy("key").agg(F.min(own).alias("least"), F.max(own).alias("most"), F.max(F.col("tag").bitwiseAND(F.lit(1))).alias("indexed"))
    found = found.where("least != most and indexed = 1").select("key")
    live = rows.join(found.hint("shuffle_hash"), "key").select(own.alias("id"), "key")  # a semi join would be pushed below the union, which makes the keys twice
    return live.groupBy("id").agg(F.collect_set("key").alias("keys"))


def word_code(words: Column, part: int) -> Column:
    """One character of four bytes a word: 19 bits of the word's hash."""
    bits = lambda h: F.shiftright(h, 24 * part).bitwiseAND(F.lit(0x023F3F3F)).bitwiseOR(F.lit(0xF1808080))
    return F.unhex(F.array_join(F.transform(words, lambda h: F.hex(bits(h))), "")).cast("string")


def payload(lines: DataFrame, edits: int) -> list[Column]:
    """What links are judged by: chars, words, most (words that may differ), parities of characters, words and neighbours, and words as characters.

    A parity is a long in which each character, word or pair of neighbouring words flips the bit that its
    code or hash names. Lines of ``MANY`` words have four more for words of four kinds.
    """
    flip = lambda total, h: total.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int")))
    parity = lambda hashes: F.aggregate(hashes, F.lit(0).cast("long"), flip)
    letters = F.aggregate(F.split("line", "", -1), F.lit(0).cast("long"), lambda total, c: total.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.ascii(c).bitwiseAND(F.lit(63)))))
    pairs = lambda h: F.zip_with(h, F.slice(h, F.lit(2), F.greatest(F.size(h) - 1, F.lit(1))), lambda x, y: F.xxhash64(x, y))
    kinds = lambda h: [F.when(F.size(h) >= MANY, parity(F.filter(h, lambda x: F.shiftright(x, 6).bitwiseAND(F.lit(3)) == k))).otherwise(F.lit(0).cast("long")).alias(f"q{k}") for k in range(4)]

    def row(h: Column) -> Column:
        return F.struct(F.size(h).alias("words"), word_edits(F.size(h)).alias("most"), parity(h).alias("w0"), parity(pairs(h)).alias("w1"), *kinds(h), word_code(h, 0).alias("c0"), word_code(h, 1).alias("c1"))

    of = let(F.transform(words_of(F.col("line")), lambda w: F.xxhash64(w)), row)
    return [F.length("line").alias("chars"), letters.alias("letters"), F.inline(F.array(of))]


#: Columns of ``payload`` that ``may_be_near`` compares, and those that ``near_lines`` needs besides.
FILTER = ["chars", "letters", "words", "most", "w0", "w1", "q0", "q1", "q2", "q3"]
FACTS = ["line", "chars", "letters", "words", "most", "c0", "c1"]


def may_be_near(x: Callable[[str], Column], y: Callable[[str], Column], edits: int) -> Column:
    """An edit of a word changes two bits of its parity at most, and four of that of neighbours: moved words don't pass; one of a code point, up to three words for one."""
    gap = lambda c: F.abs(x(c) - y(c))
    flipped = lambda c: F.bit_count(x(c).bitwiseXOR(y(c)))
    most = F.least(x("most"), y("most"))
    by_chars = (gap("chars") <= edits) & (flipped("letters") <= 2 * edits) & (flipped("w0") <= 4 * edits) & (flipped("w1") <= 6 * edits)
    kinds = (F.least(x("words"), y("words")) < MANY) | (reduce(lambda a, b: a + b, [flipped(f"q{k}") for k in range(4)]) <= 2 * most)
    return by_chars | ((gap("words") <= most) & (flipped("w0") <= 2 * most) & (flipped("w1") <= 4 * most) & kinds)


def near_lines(x: Callable[[str], Column], y: Callable[[str], Column], edits: int) -> Column:
    """Whether two lines are linked.

    Words are compared by their hashes, in two codes one after another: each code's distance
    is the true one at most.
    """
    gap = lambda c: F.abs(x(c) - y(c))
    within = lambda c, most: F.call_function("levenshtein", x(c), y(c), most) >= 0
    most = F.least(x("most"), y("most"))
    by_words = (most > 0) & (gap("words") <= most) & within("c0", most) & within("c1", most)
    few = char_edits(F.least(x("chars"), y("chars")), edits)
    long = (F.least(x("chars"), y("chars")) >= VERY_LONG) & (few == edits)  # the function takes the square of the length
    by_chars = F.when(long, within_edits(x("line"), y("line"), edits)).otherwise(within("line", few))
    return by_words | ((gap("chars") <= few) & (F.bit_count(x("letters").bitwiseXOR(y("letters"))) <= 2 * few) & by_chars)


def link_counts(live: DataFrame, roots: DataFrame, edits: int) -> DataFrame:
    """node and n_links of every line with a link; live: id, line, keys and payload; roots: node, root.

    Linked lines are in one class and share a key.  The members of a class, or of a large
    class those with a common key, are dealt into blocks; two blocks (or one and itself)
    meet in one row, which counts.  Lines that share several keys count at the least.
    """
    many = roots.groupBy("root").agg(F.count(F.lit(1)).alias("many")).where("many > 1").select(plain("root"), "many")
    own = live.join(roots.join(many, "root").select("node", "root", "many"), F.col("id") == F.col("node"))
    whole = F.col("many") <= TOGETHER
    of = F.struct("node", *dict.fromkeys([*FILTER, *FACTS]), F.when(~whole, F.col("keys")).alias("keys"), F.transform(words_of(F.col("line")), lambda w: F.xxhash64(w)).alias("split"))
    places = own.select("node", "root", whole.alias("whole"), of.alias("of"), F.explode(F.when(whole, F.array("root")).otherwise(F.col("keys"))).alias("key"), "many")
    size = places.where("not whole").groupBy("root", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select(plain("root"), plain("key"), "size")
    alone = places.where("whole").withColumn("size", F.col("many"))
    dealt = alone.unionByName(places.where("not whole").join(size, ["root", "key"]).select(*alone.columns)).withColumn("blocks", F.ceil(F.col("size") / BLOCK))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    sides = dealt.select("of", "root", "key", "whole", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    met = sides.groupBy("root", "key", "whole", "low", "high").agg(F.collect_list(F.struct("block", "of")).alias("g"))

    def linked(x: Column, y: Column) -> Column:
        a, b = x["of"], y["of"]
        apart = (a["node"] != b["node"]) & ((F.col("low") == F.col("high")) | (x["block"] != y["block"]))
        once = F.col("whole") | (F.array_min(F.array_intersect(a["keys"], b["keys"])) == F.col("key"))
        differ = F.size(F.filter(F.zip_with(a["split"], b["split"], lambda v, w: v != w), lambda d: d))
        replaced = (a["most"] > 0) & (a["words"] == b["words"]) & (differ <= a["most"])  # most links, at little cost
        return apart & may_be_near(a.getField, b.getField, edits) & once & (replaced | near_lines(a.getField, b.getField, edits))

    counts = F.transform("g", lambda x: F.struct(x["of"]["node"].alias("node"), F.size(F.filter("g", lambda y: linked(x, y))).alias("n")))
    return met.select(F.inline(counts)).where("n > 0").groupBy("node").agg(F.sum("n").alias("n_links"))


def line_classes(found: DataFrame, min_chars: int, edits: int, count: bool = True) -> tuple[DataFrame, DataFrame]:
    """node and root of every line that shares a key with another, and node and n_links; without ``count``, links that classes needed."""
    work = Work(found.sparkSession, "lines")
    # no line's text is moved for its keys; equal lines have the same keys
    lines = found.where(takes_part(min_chars)).select(line_id().alias("id"), "line")
    shared, _ = work.write(shared_keys(lines, edits), small=0)  # apart, or the keys would be made twice
    live = lines.join(shared.withColumnRenamed("id", "s_id").hint("shuffle_hash"), F.col("id") == F.col("s_id")).select("id", "line", "keys").dropDuplicates(["id"])
    live, _ = work.write(live.select("id", "line", "keys", *payload(live, edits)), small=0)
    texts = live.select(F.col("id").alias("node"), F.struct(*FACTS).alias("text"))
    members = with_payload(sized(live.select(F.col("id").alias("node"), F.explode("keys").alias("key"))), live.select(F.col("id").alias("node"), *FILTER))

    def verify(pairs: DataFrame, n: int) -> DataFrame:
        near = near_lines(F.col("text_a").getField, F.col("text_b").getField, edits)
        return pair_texts(pairs, n, texts).where(near).select(pairs.columns)

    roots, links = classes(work, members, lambda x, y: may_be_near(lambda c: F.col(f"{x}.{c}"), lambda c: F.col(f"{y}.{c}"), edits), verify)
    ends = link_counts(live, roots, edits) if count else links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    return roots, ends


def leaders(parts: DataFrame, roots: DataFrame, ends: DataFrame) -> DataFrame:
    """id, leader (first occurrence in its class), copies and n_links of every line that is not alone; parts: id, doc_id, line_no."""
    own = parts.groupBy("id").agg(F.min(F.struct("doc_id", "line_no")).alias("pos"), F.count(F.lit(1)).alias("n"))
    lead = own.join(roots.join(ends, "node").withColumnRenamed("node", "id"), "id", "left")
    lead = lead.select("id", "pos", "n", F.coalesce("root", "id").alias("root"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")).where("n > 1 or n_links > 0")
    lead, _ = Work(parts.sparkSession, "leaders").write(lead)
    first = lead.groupBy("root").agg(F.min("pos").alias("leader"))
    return lead.join(first, "root").select("id", "leader", F.col("n").alias("copies"), "n_links")


def judged_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, min_chars: int = MIN_CHARS, count: bool = True) -> DataFrame:
    """doc_id, row_key, line_no, n_chars, copies, n_links, leader_doc, leader_line and kept for every line that takes part.

    Without ``count``, n_links has only the links that classes needed.
    """
    found = occurrences(docs, id_col, text_col)
    roots, ends = line_classes(found, min_chars, edits, count)
    parts = found.where(takes_part(min_chars)).select("doc_id", "row_key", "line_no", F.length("line").cast("long").alias("n_chars"), line_id().alias("id"))
    parts, _ = Work(docs.sparkSession, "parts").write(parts, small=0)
    lead = leaders(parts, roots, ends).select(plain("id"), "leader", "copies", "n_links").withColumnRenamed("id", "g_id")
    met = parts.join(lead, F.col("id") == F.col("g_id"), "left")
    own = F.struct("doc_id", "line_no")
    alone = F.col("g_id").isNull()
    return met.select(
        "doc_id", "row_key", "line_no", "n_chars",
        F.coalesce("copies", F.lit(1)).cast("long").alias("copies"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("leader.doc_id")).alias("leader_doc"),
        F.when(alone, F.col("line_no")).otherwise(F.col("leader.line_no")).alias("leader_line"),
        (alone | own.eqNullSafe(F.col("leader"))).alias("kept"),
    )


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, min_chars: int = MIN_CHARS, drop_emptied: bool = False) -> DataFrame:
    """Texts without the lines that go; one of which only blank lines are left is dropped if asked for."""
    key, own_key, gone, new = private(docs, "g_key", "row_key", "gone", "new")
    found = judged_lines(docs, id_col, text_col, edits, min_chars, count=False).where("not kept")
    found = found.groupBy(F.col("row_key").alias(key)).agg(F.collect_set("line_no").alias(gone))
    keyed = docs.withColumn(own_key, F.xxhash64(F.col(id_col), F.col(text_col)))
    met = keyed.join(found, F.col(key) == F.col(own_key), "left")
    stays = F.filter(F.split(F.col(text_col), "\n", -1), lambda x, i: ~F.array_contains(gone, i))
    text = F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(F.array_join(stays, "\n"))
    out = met.withColumn(new, text).where(F.lit(not drop_emptied) | F.col(gone).isNull() | (F.length(F.trim(F.replace(new, F.lit("\n")))) > 0))
    return out.select(*[F.col(new).alias(c) if c == text_col else F.length(new).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    rows = judged_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return rows.select("doc_id", F.col("line_no").cast("long").alias("line_no"), "n_chars", "copies", "n_links", "leader_doc", F.col("leader_line").cast("long").alias("leader_line"), "kept")
