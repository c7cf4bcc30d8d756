"""Classes of near copies from shared buckets, without pairs of all members of a bucket.

Nodes that share a bucket may be near.  In rounds every bucket names a few hubs; its
members of other classes meet the hubs, near pairs are verified, and the classes of
verified pairs become one:

* round 0: one hub a bucket, the member that shares most places with others, so that a
  group of n copies of one text costs n pairs;
* round k: those of the remaining members that a hash puts among ``fan ** k`` of the
  bucket's size; a pair meets in the least of its common buckets only.  A bucket whose members are all in one class takes no further part,
  neither does one whose members have all been hubs.

So every two members of a bucket are in one class in the end or have met: no link
between classes is lost and no bucket is cut.  A link inside a class is not looked for,
as it changes nothing.  Rows grow with a bucket's size times the hubs of its rounds,
and only members that no hub has drawn in go on to the next.

Each round's state is a table in the shared folder; a lost executor costs a task, and
nothing of all nodes reaches the driver but counts.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import Work

FAN = 32
_UNIT = 1 << 52


def plain(name: str) -> Column:
    """The column behind an expression, so that a join deals both sides by plain exchanges, which AQE may split at a hot key."""
    return F.least(name, name).alias(name)


def sized(rows: DataFrame) -> DataFrame:
    """node, key, size of every bucket that several nodes are in; rows: node, key without repeats."""
    size = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select(plain("key"), "size")
    return rows.join(size, "key").select("node", "key", "size")


def with_payload(members: DataFrame, payload: DataFrame) -> DataFrame:
    """node, key, size, degree (members of all its buckets), all keys and the payload (one row a node); a node's keys are few."""
    own = members.groupBy("node").agg(F.sum("size").alias("degree"), F.collect_list(F.struct("key", "size")).alias("own"))
    columns = [c for c in payload.columns if c != "node"]
    return own.join(payload, "node").select("node", F.inline("own"), "degree", F.col("own.key").alias("keys"), *columns)


def _central(side: DataFrame) -> DataFrame:
    """The member of each bucket that shares most places; its keys are those of the buckets that it is the hub of."""
    order = ["degree", "node", *[c for c in side.columns if c not in ("degree", "node", "key", "keys")]]
    hubs = side.groupBy("key").agg(F.max(F.struct(*order)).alias("top")).select("key", "top.*")
    rest = [c for c in side.columns if c not in ("node", "key", "keys", "size")]
    led = hubs.groupBy("node").agg(F.first(F.struct(*rest)).alias("own"), F.collect_list(F.struct("key", "size")).alias("led"))
    led = led.select("node", "own", F.col("led.key").alias("keys"), F.inline("led"))
    return led.select("node", plain("key"), "size", "keys", "own.*").select(*side.columns)


def _place(low: float, high: float) -> Column:
    """Members that a hash puts into this part of the bucket's size."""
    at = F.xxhash64("node", "key").bitwiseAND(F.lit(_UNIT - 1)).cast("double") / _UNIT * F.col("size")
    return (at >= low) & (at < high)


def _met(side: DataFrame, hubs: DataFrame, near: Callable[[str, str], Column]) -> DataFrame:
    """Pairs a < b of a hub and a member of another class, with their classes, in the least only of the buckets that the hub is to meet it in (its keys)."""
    x, y = side.alias("x"), hubs.alias("y")
    close = (F.col("x.key") == F.col("y.key")) & (F.col("x.root") != F.col("y.root")) & near("x", "y")
    close = close & (F.array_min(F.array_intersect("x.keys", "y.keys")) == F.col("x.key"))
    met = x.join(y, close)
    first = F.col("x.node") < F.col("y.node")
    way = lambda c: (F.when(first, F.col(f"x.{c}")).otherwise(F.col(f"y.{c}")), F.when(first, F.col(f"y.{c}")).otherwise(F.col(f"x.{c}")))
    (a, b), (ra, rb) = way("node"), way("root")
    return met.select(a.alias("a"), b.alias("b"), ra.alias("ra"), rb.alias("rb")).distinct()


def classes(work: Work, members: DataFrame, near: Callable[[str, str], Column], verify: Callable[[DataFrame, int], DataFrame], sharper: Callable[[DataFrame], tuple] | None = None, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """node, root for every node of ``members`` (``with_payload``; columns that ``near`` compares).

    ``near`` is part of the join's condition; ``verify`` keeps those of so
    many rows (a, b, ra, rb) whose texts are near.  ``sharper`` gives other columns and
    their ``near`` for the nodes that are left after round 0.  Also the verified pairs a, b.
    """
    side, seen = work.write(members.withColumn("root", F.col("node")), top=F.max("size"))
    roots, _ = work.write(side.select("node", "root").distinct())
    low, high, links = 0, 0, []  # round 0
    while seen["n"]:
        hubs = side.where(_place(low, high)) if high else _central(side)
        pairs, met = work.write(_met(side, hubs, near))
        edges, found = work.write(verify(pairs, met["n"]))
        work.drop(pairs)
        if found["n"]:
            into = components(work, edges.select(F.col("ra").alias("a"), F.col("rb").alias("b")))
            into = into.select(F.col("node").alias("root"), F.col("root").alias("new"))
            merged, _ = work.write(roots.join(into, "root", "left").select("node", F.coalesce("new", "root").alias("root")))
            work.drop(roots)
            roots = merged
        links.append(edges.select("a", "b"))
        if high >= seen["top"]:
            break
        rest, _ = work.write(side.where(F.col("size") > high).drop("root").join(roots, "node").select(*side.columns))  # in a smaller bucket all have been hubs
        still = rest.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least != most").select(plain("key"))
        left, seen = work.write(rest.join(still, "key", "left_semi"), top=F.max("size"))
        work.drop(rest)
        work.drop(side)
        side, low, high = left, high, max(1, high) * fan
        if sharper and not low and seen["n"]:
            columns, near = sharper(side.select(plain("node")).distinct())
            own, _ = work.write(columns)
            side, _ = work.write(side.select("node", "key", "size", "degree", "keys", "root").join(own, "node"))
            work.drop(left)
    work.drop(side)
    nothing = roots.select(F.col("node").alias("a"), F.col("root").alias("b")).where(F.lit(False))
    return roots, reduce(DataFrame.unionByName, links, nothing).distinct()


def components(work: Work, edges: DataFrame) -> DataFrame:
    """(node, root) for every node of some edge (a, b) but the roots themselves, by alternating large and small stars.

    The rounds end when a round changes nothing; they are at most logarithmic in the
    number of nodes, squared.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            e = e.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
        else:  # towards the smaller neighbour
            e = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = e.groupBy("u").agg(F.min("v").alias("m")).select(plain("u"), F.least("u", "m").alias("m"))
        met = e.join(low, "u")
        if large:
            return met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        both = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))
        return met.select(F.inline(both)).where("u != v").distinct()

    state = {"x": F.bit_xor(F.xxhash64("u", "v"))}
    now, seen = work.write(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u != v").distinct(), **state)
    while True:
        large, _ = work.write(star(now, True))
        work.drop(now)
        now, then = work.write(star(large, False), **state)
        work.drop(large)
        if then == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = then
