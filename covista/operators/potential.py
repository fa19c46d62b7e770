"""Potential traffic of SKUs and SKU pairs.

A SKU's potential is the category traffic of its ssc on the days it was visible; a pair's joint
potential combines the traffic of both ssc on the days both were visible.  Neither depends on the
SKU itself, only on ``(ssc, first visible date)`` or ``(ssc1, ssc2, later first visible date)``.
So instead of joining every SKU or pair with every day, suffix sums are taken per ssc (or ssc
pair) over the calendar and each distinct key reads the sum at its start day: the key rows are
merged into the day rows and a running sum ordered by day, descending, stops at each key row.
Each window group holds one ssc (pair)'s days plus its distinct start dates, so its size is
bounded by the calendar, not by the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import KEY


def _suffix_lookup(days: DataFrame, keys: DataFrame, group: list[str], key_day: str,
                   sums: dict[str, F.Column], visible_rule: str) -> DataFrame:
    """For every key row, sum each ``sums`` column over the day rows of its group with
    ``day >= key_day`` (``on_or_after``) or ``day > key_day`` (``after``).

    ``days`` has ``group + [day] + sums`` inputs; ``keys`` has ``group + [key_day]``.
    Returns ``group + [key_day] + sums`` (zeros when no day qualifies).
    """
    # At an equal day, traffic rows sort before key rows for ``on_or_after`` (they count) and
    # after them for ``after`` (they do not).
    day_kind, key_kind = (0, 1) if visible_rule == "on_or_after" else (1, 0)
    d = days.select(*group, F.col("day"), F.lit(day_kind).alias("kind"),
                    *[expr.cast("bigint").alias(name) for name, expr in sums.items()])
    k = keys.select(*group, F.col(key_day).alias("day"), F.lit(key_kind).alias("kind"),
                    *[F.lit(0).cast("bigint").alias(name) for name in sums])
    w = (Window.partitionBy(*group).orderBy(F.col("day").desc(), F.col("kind").asc())
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    merged = d.unionByName(k).select(*group, "day", "kind",
                                     *[F.sum(name).over(w).alias(name) for name in sums])
    return merged.filter(F.col("kind") == key_kind).select(*group, F.col("day").alias(key_day), *sums)


def sku_potential(profile: DataFrame, traffic: DataFrame, visible_rule: str = "on_or_after") -> DataFrame:
    """``sub_category, sku, pot`` = traffic of the SKU's ssc on days it was visible.

    SKUs with a NULL first visible date are dropped (the original could not compare them).
    """
    prof = profile.filter(F.col("fvd").isNotNull() & F.col("ssc").isNotNull())
    keys = prof.select(KEY, "ssc", "fvd").distinct()
    days = traffic.select(KEY, "ssc", F.col("visit_date").alias("day"), "visits")
    pot = _suffix_lookup(days, keys, [KEY, "ssc"], "fvd", {"pot": F.col("visits")}, visible_rule)
    return prof.join(pot, [KEY, "ssc", "fvd"]).select(KEY, "sku", "pot")


def pair_profile(pairs: DataFrame, profile: DataFrame) -> DataFrame:
    """Attach both SKUs' ssc and first visible date and the later of the two dates.

    Also ``sa <= sb``, the ssc pair in canonical order (joint potential is symmetric in it), and
    ``pair_id`` = ``sku1_sku2``.
    """
    prof = profile.filter(F.col("fvd").isNotNull() & F.col("ssc").isNotNull()).select(KEY, "sku", "ssc", "fvd")
    a = prof.select(KEY, F.col("sku").alias("sku1"), F.col("ssc").alias("ssc1"), F.col("fvd").alias("fvd1"))
    b = prof.select(KEY, F.col("sku").alias("sku2"), F.col("ssc").alias("ssc2"), F.col("fvd").alias("fvd2"))
    return (pairs.join(a, [KEY, "sku1"]).join(b, [KEY, "sku2"])
            .withColumn("maxfvd", F.greatest("fvd1", "fvd2"))
            .withColumn("sa", F.least("ssc1", "ssc2"))
            .withColumn("sb", F.greatest("ssc1", "ssc2"))
            .withColumn("pair_id", F.concat_ws("_", F.col("sku1").cast("string"), F.col("sku2").cast("string"))))


def joint_potential_keys(keys: DataFrame, traffic: DataFrame, mode: str = "daily_min",
                         visible_rule: str = "on_or_after") -> DataFrame:
    """A7 on distinct keys ``sub_category, sa, sb, maxfvd`` → ``... , pot_joint``.

    Modes (days where both ssc have traffic, from the later first visible date on):
      * ``daily_min``    Σ_d min(c1, c2)
      * ``row_weighted`` Σ_d n_d · min(c1, c2), n_d = ssc rows of the category that day, as the
                         original Python loop counted each day once per row
      * ``min_of_sums``  min(Σ_d c1, Σ_d c2), as the original Spark SQL did
    """
    sp = keys.select(KEY, "sa", "sb").distinct()
    t1 = traffic.select(KEY, F.col("ssc").alias("sa"), F.col("visit_date").alias("day"), F.col("visits").alias("c1"))
    t2 = traffic.select(KEY, F.col("ssc").alias("sb"), F.col("visit_date").alias("day"), F.col("visits").alias("c2"))
    days = sp.join(t1, [KEY, "sa"]).join(t2, [KEY, "sb", "day"])
    if mode == "daily_min":
        sums = {"pj": F.least("c1", "c2")}
    elif mode == "row_weighted":
        n_day = traffic.groupBy(KEY, F.col("visit_date").alias("day")).agg(F.count(F.lit(1)).alias("n_d"))
        days = days.join(n_day, [KEY, "day"])
        sums = {"pj": F.least("c1", "c2") * F.col("n_d")}
    elif mode == "min_of_sums":
        sums = {"s1": F.col("c1"), "s2": F.col("c2")}
    else:
        raise ValueError(f"unknown joint mode {mode!r}")
    out = _suffix_lookup(days, keys.select(KEY, "sa", "sb", "maxfvd").distinct(), [KEY, "sa", "sb"],
                         "maxfvd", sums, visible_rule)
    if mode == "min_of_sums":
        out = out.withColumn("pj", F.least("s1", "s2")).drop("s1", "s2")
    return out.withColumnRenamed("pj", "pot_joint")


def joint_potential(pp: DataFrame, traffic: DataFrame, mode: str = "daily_min",
                    visible_rule: str = "on_or_after") -> DataFrame:
    """A7 / J6 per pair: ``sub_category, sku1, sku2, pot_joint`` from a ``pair_profile`` table."""
    keys = pp.select(KEY, "sa", "sb", "maxfvd").distinct()
    pj = joint_potential_keys(keys, traffic, mode, visible_rule)
    return pp.join(pj, [KEY, "sa", "sb", "maxfvd"]).select(KEY, "sku1", "sku2", "pot_joint")
