"""Exact order statistics of groups of any size (A9, A12, A28): no group's values meet in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bins of a group in one pass.
BINS = 1024


def split_median(df: DataFrame, keys: list[str], col: str, bins: int = BINS) -> DataFrame:
    """(keys, n, median): the exact median of col, the mean of the two middle values for even n; groups without values are left out.

    Equal values are counted first, with partial aggregates. A histogram of `bins` equal parts of the group's range tells which bins hold the middle ranks; only their values are ranked.
    Bins are split once more by their own range, so that a group's few outliers don't leave all others in one bin. A group has at most bins rows in each step but the last, which ranks what one
    part in bins squared of its range holds.
    """
    rows = df.where(F.col(col).isNotNull()).select(*keys, F.col(col).cast("double").alias("_v")).groupBy(*keys, "_v").agg(F.count("*").alias("_c"))
    size = rows.groupBy(*keys).agg(F.sum("_c").alias("n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    ranks = F.array_distinct(F.array(F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)))
    wanted = size.select(*keys, "n", "_lo", "_hi", F.explode(ranks).alias("_rank")).withColumn("_below", F.lit(0).cast("long"))
    same = lambda a, b, cols: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in cols]
    for _ in range(2):
        part = F.least(F.floor(F.try_divide(F.col("r._v") - F.col("w._lo"), F.col("w._hi") - F.col("w._lo")) * bins), F.lit(bins - 1))
        near = rows.alias("r").join(wanted.alias("w"), [*same("r", "w", keys), F.col("r._v").between(F.col("w._lo"), F.col("w._hi"))])
        counted = near.select(*[F.col(f"w.{k}") for k in keys], "w.n", "w._rank", "w._below", F.coalesce(part, F.lit(0)).alias("_bin"), "r._v", "r._c")
        counted = counted.groupBy(*keys, "n", "_rank", "_below", "_bin").agg(F.sum("_c").alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        upto = F.col("_below") + F.sum("_c").over(Window.partitionBy(*keys, "_rank").orderBy("_bin"))
        placed = counted.withColumn("_upto", upto).where((F.col("_upto") > F.col("_rank")) & (F.col("_upto") - F.col("_c") <= F.col("_rank")))
        wanted = placed.select(*keys, "n", "_rank", (F.col("_upto") - F.col("_c")).alias("_below"), "_lo", "_hi")
    last = rows.alias("r").join(wanted.alias("w"), [*same("r", "w", keys), F.col("r._v").between(F.col("w._lo"), F.col("w._hi"))]).select(*[F.col(f"w.{k}") for k in keys], "w.n", "w._rank", "w._below", "r._v", "r._c")
    upto = F.col("_below") + F.sum("_c").over(Window.partitionBy(*keys, "_rank").orderBy("_v"))
    picked = last.withColumn("_upto", upto).where((F.col("_upto") > F.col("_rank")) & (F.col("_upto") - F.col("_c") <= F.col("_rank")))
    return picked.groupBy(*keys, "n").agg(F.avg("_v").alias("median"))


def split_concentration(df: DataFrame, group: list[str], item: str, value: str, k: int) -> DataFrame:
    """(group, items, top_share): the k largest items' part of the group's total; ties go to the smaller item.

    The k-th largest total is found first, over limited ranks that Spark cuts before its shuffle; group sums are partial aggregates, so that a hot group's items never meet in one task.
    """
    totals = df.groupBy(*group, item).agg(F.sum(value).alias("_v"))
    spread = F.pmod(F.xxhash64(item), F.lit(64))
    some = totals.withColumn("_part", spread).withColumn("_r", F.row_number().over(Window.partitionBy(*group, "_part").orderBy(F.desc("_v"), item))).where(F.col("_r") <= k)
    best = some.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("_v"), item))).where(F.col("_r") <= k).groupBy(*group).agg(F.sum("_v").alias("_top"))
    every = totals.groupBy(*group).agg(F.count("*").alias("items"), F.sum("_v").alias("_all"))
    share = F.bround(F.try_divide(F.col("_top").cast("double"), F.col("_all").cast("double")), 4)
    return every.alias("a").join(best.alias("b"), [F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}")) for g in group]).select(*[F.col(f"a.{g}") for g in group], "items", share.alias("top_share"))
