"""Set forms of the co-view counts: O3, overlaps of visitor sets, and sketches of them for A2.

``pair_overlap`` intersects the visitor sets of given SKU pairs, held as bitmaps of 64-bit words, a row per
SKU and word.  Sets of at most ``LIST_WORDS`` words are unpacked into one list each, so a pair of such SKUs is
one row and not a row for each word of a SKU.  A larger set is never one row: a SKU seen by a third of all
visitors stays spread over its words, its pairs look up the words of the SKU that has fewer, and their count
is the sum of the set bits of the AND of the words that both have.

``daily_visitor_sketches`` keeps a HyperLogLog sketch per SKU and day.  The distinct visitors of any
window of days are then the union of stored sketches, without the log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import KEY, cut_lineage

BITS = 64
LIST_WORDS = 128                           # of a set that is unpacked into one list
SKETCH_BITS = 12                           # 4,096 registers a sketch
ERROR = 1.04 / (1 << SKETCH_BITS) ** 0.5   # standard error of an estimate


def visitor_words(sv: DataFrame) -> DataFrame:
    """``sub_category, sku, word, bits`` of distinct (category, sku, visitor) rows; visitors are integers."""
    bit = F.expr(f"shiftleft(1L, cast(pmod(visitor, {BITS}) AS int))")
    return (sv.select(KEY, "sku", F.floor(F.col("visitor") / BITS).cast("bigint").alias("word"), bit.alias("bit"))
              .groupBy(KEY, "sku", "word").agg(F.bit_or("bit").alias("bits")))


def word_lists(words: DataFrame, list_words: int = LIST_WORDS) -> DataFrame:
    """``sub_category, sku, n, l``: a row per SKU with its number of words and the list of its visitors, NULL
    where there are more than ``list_words`` words."""
    sizes = words.groupBy(KEY, "sku").agg(F.count(F.lit(1)).alias("n"))
    short = words.join(sizes.filter(F.col("n") <= F.lit(list_words)), [KEY, "sku"])
    lists = (short.withColumn("i", F.explode(F.array(*[F.lit(i) for i in range(BITS)])))
                  .filter(F.getbit("bits", F.col("i")) == F.lit(1))
                  .select(KEY, "sku", "n", F.expr(f"shiftleft(word, {BITS.bit_length() - 1}) | i").alias("visitor"))
                  .groupBy(KEY, "sku", "n").agg(F.collect_list("visitor").alias("l")))
    large = sizes.filter(F.col("n") > F.lit(list_words))
    return lists.unionByName(large.withColumn("l", F.lit(None).cast("array<bigint>")))


def pair_overlap(words: DataFrame, pairs: DataFrame, list_words: int = LIST_WORDS) -> DataFrame:
    """O3: ``sub_category, sku1, sku2, com`` of the given pairs, 0 for disjoint sets."""
    lists = cut_lineage(word_lists(words, list_words), "lists")
    side = lambda i: lists.select(KEY, *[F.col(c).alias(f"{c}{i}") for c in ("sku", "n", "l")])
    both = (pairs.select(KEY, "sku1", "sku2").join(side(1), [KEY, "sku1"], "left").join(side(2), [KEY, "sku2"], "left"))
    com = (F.when(F.col("n1").isNull() | F.col("n2").isNull(), F.lit(0).cast("bigint"))
            .when(F.col("l1").isNotNull() & F.col("l2").isNotNull(), F.size(F.array_intersect("l1", "l2")).cast("bigint")))
    met = cut_lineage(both.select(KEY, "sku1", "sku2", "n1", "n2", com.alias("com")), "met")
    pair = [KEY, "sku1", "sku2"]
    large = met.filter(F.col("com").isNull())
    done = met.filter(F.col("com").isNotNull()).select(*pair, "com")
    if large.isEmpty():
        return done
    # pairs with a set that is not held as a list: the words of the smaller set, looked up in the larger one
    less = F.col("n1") <= F.col("n2")
    large = cut_lineage(large.select(*pair, F.when(less, F.col("sku1")).otherwise(F.col("sku2")).alias("a"),
                                     F.when(less, F.col("sku2")).otherwise(F.col("sku1")).alias("z")).distinct(), "large")
    named = lambda i: words.select(KEY, F.col("sku").alias(i), "word", F.col("bits").alias(f"b{i}"))
    shared = large.join(named("a"), [KEY, "a"]).join(named("z"), [KEY, "z", "word"])
    found = shared.groupBy(*pair).agg(F.sum(F.bit_count(F.col("ba").bitwiseAND(F.col("bz"))).cast("bigint")).alias("n"))
    rest = met.filter(F.col("com").isNull()).select(*pair).join(found, pair, "left")
    return done.unionByName(rest.select(*pair, F.coalesce("n", F.lit(0)).alias("com")))


def daily_visitor_sketches(q: DataFrame) -> DataFrame:
    """``sub_category, sku, visit_date, sketch`` of the qualified views."""
    return (q.filter(F.col("visitor").isNotNull()).groupBy(KEY, "sku", "visit_date")
             .agg(F.hll_sketch_agg("visitor", F.lit(SKETCH_BITS)).alias("sketch")))


def sku_views_estimate(sketches: DataFrame, first_day=None, last_day=None) -> DataFrame:
    """``sub_category, sku, pv``: estimated distinct visitors per SKU of the days from ``first_day`` to
    ``last_day`` (both included; None: no limit)."""
    if first_day is not None:
        sketches = sketches.filter(F.col("visit_date") >= F.lit(first_day).cast("date"))
    if last_day is not None:
        sketches = sketches.filter(F.col("visit_date") <= F.lit(last_day).cast("date"))
    return sketches.groupBy(KEY, "sku").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("pv"))
