"""Candidate pairs of the two MinHash operators, in DataFrame functions only.

Members of a bucket (a shared band key) aren't all paired: each meets the head of
its group, the heads meet the heads of larger groups, and so on up to the bucket.
Heads are minima, aggregated map-side, and members get them by a join whose
skewed parts Spark splits.

What these pairs leave open, buckets whose members lie in several components, is
settled by an exact prefix join over the sets themselves.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from . import common

#: Members of a group on average; levels of groups, enough for FAN ** LEVELS members.
FAN, LEVELS = 64, 6
#: Remainders of elements whose frequencies are told apart.
CLASSES = 1 << 18
#: Four orders in which heads are least: a bucket takes one by its key.
ORDERS = (0, -1, 0x5555555555555555, -0x5555555555555556)


def members(bands: DataFrame) -> DataFrame:
    """(key, id, members) of the buckets of two members or more, of bands (key, id)
    without repeated rows."""
    # without an order of ids the sort is by one number, which Spark does by radix
    return bands.select("key", "id", F.count("*").over(Window.partitionBy("key")).alias("members")).where("members > 1")


def _order() -> Column:
    turn = F.col("key").bitwiseAND(F.lit(3))
    out = F.lit(ORDERS[0]).cast("long")
    for k, mask in enumerate(ORDERS[1:], 1):
        out = F.when(turn == k, F.lit(mask).cast("long")).otherwise(out)
    return out


def pairs(held: DataFrame) -> DataFrame:
    """(u, v) with u < v: members with the head of their group, and heads with those
    of the next level.  held: members()."""
    now = held.withColumn("depth", F.greatest(F.lit(0), F.expr(f"cast(ceil(log2(members / {FAN}D)) as int)")))
    found = None
    for level in range(LEVELS):
        now = now.withColumn("part", F.xxhash64("id").bitwiseAND(F.expr("shiftleft(1L, depth) - 1")))
        heads = now.groupBy("key", "members", "depth", "part").agg(F.min(F.col("id").bitwiseXOR(_order())).alias("least"))
        heads = heads.select("key", "members", "depth", "part", F.col("least").bitwiseXOR(_order()).alias("head"))
        met = now.join(heads.select("key", "part", "head"), ["key", "part"]).where("id <> head")
        met = met.select(F.least("id", "head").alias("u"), F.greatest("id", "head").alias("v"))
        found = met if found is None else found.union(met)
        # a bucket that had one group is done
        now = common.materialize(heads.where("depth > 0").select("key", "members", F.col("head").alias("id"), F.expr(f"greatest(0, depth - {FAN.bit_length() - 1})").alias("depth")), "heads")
        if now.isEmpty():
            break
    return found.distinct()


def opened(held: DataFrame, comps: DataFrame) -> DataFrame:
    """(key, id, component, members), and what else held has, of the buckets that lie in
    several components; in one of two members the only pair was tried."""
    more = [c for c in held.columns if c not in ("key", "id", "members")]
    labelled = held.where("members > 2").join(comps.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"), "members", *more)
    split = labelled.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("key")
    return labelled.join(split, "key", "left_semi")


def frequency_classes(sets: DataFrame) -> bytes:
    """By the remainder of an element, how many sets hold elements of that remainder, on a
    scale of sixteenths of a power of two; CLASSES bytes, whatever the sets."""
    counted = sets.select(F.explode_outer("s").alias("x")).where("x IS NOT NULL").groupBy(F.pmod("x", F.lit(CLASSES)).cast("int").alias("b")).agg(F.count("*").alias("n"))
    out = bytearray(CLASSES)
    for r in counted.collect():
        out[r["b"]] = min(255, int(16 * math.log2(r["n"] + 1)))
    return bytes(out)


def prefix_pairs(sets: DataFrame, percent: int, marks: Sequence[str] = (), agree: Column | None = None) -> DataFrame:
    """(u, v) with u < v of different components that may reach the similarity: sets
    (id, component, s) of distinct hashed elements.

    Elements are put in one order for all sets, rare ones first, as their classes tell
    (frequency_classes); two sets at the threshold must share one of the first
    n - ceil(percent of n) + 1 of either, in whatever order.  What a template's texts
    share is frequent and stands outside these, and of an element's holders the
    largest component meets only the others, never itself.  Positions and sizes drop
    pairs that can't reach the overlap.  No pair at the threshold is lost, but by agree,
    a condition on further columns of sets, marks, called a.. on one side and b.. on
    the other."""
    classes = F.lit(frequency_classes(sets))
    n = F.size("s").cast("long")
    ranked = F.array_sort(F.transform("s", lambda x: F.struct(F.substring(classes, F.pmod(x, F.lit(CLASSES)).cast("int") + 1, F.lit(1)).alias("c"), x.alias("x"))))
    first = F.slice(ranked, F.lit(1), (n - F.ceil(n * percent / 100 - 1e-9)).cast("int") + 1)
    # outer: else Spark would rank every set once more, to drop empty ones
    prefix = sets.select("id", "component", *marks, n.alias("n"), F.posexplode_outer(first).alias("at", "e")).where("e IS NOT NULL")
    prefix = common.materialize(prefix.select("id", "component", *marks, "n", F.col("e.x").alias("s"), (F.col("at") + 1).alias("at")), "prefix")
    owned = prefix.groupBy("s", "component").agg(F.count("*").alias("c")).groupBy("s").agg(F.max_by("component", F.struct("c", "component")).alias("largest"), F.count("*").alias("components"))
    owned = owned.where("components > 1").select(F.col("s").alias("e"), "largest")
    # written between the joins, so that each has two shuffled sides, whose skewed parts Spark splits;
    # holders of the largest component, most of a hot element's, aren't copied here
    few = common.materialize(prefix.join(common.materialize(owned, "owned"), (F.col("s") == F.col("e")) & (F.col("component") != F.col("largest"))).drop("e", "largest"), "few")
    left = few.select("s", F.col("id").alias("u"), F.col("component").alias("cu"), F.col("n").alias("nu"), F.col("at").alias("au"), *[F.col(m).alias(f"a{m}") for m in marks])
    right = prefix.select("s", F.col("id").alias("v"), F.col("component").alias("cv"), F.col("n").alias("nv"), F.col("at").alias("av"), *[F.col(m).alias(f"b{m}") for m in marks])
    fits = F.expr(f"100 * least(nu, nv) >= {percent} * greatest(nu, nv)")
    reaches = F.expr(f"(100 + {percent}) * (least(nu - au, nv - av) + 1) >= {percent} * (nu + nv)")
    met = left.join(right, "s").where((F.col("cu") != F.col("cv")) & fits & reaches & (F.lit(True) if agree is None else agree))
    return met.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
