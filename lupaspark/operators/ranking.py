"""Rankings (W1-W6, W20, W21, T1-T6). Every order ends in a key, so that ties fall alike each run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, part: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group, with their rank. Spark drops rows beyond k before it shuffles them."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*part).orderBy(*order))).where(F.col("rank") <= k)


def newest(df: DataFrame, part: list[str], date: str, k: int, tie: str) -> DataFrame:
    """The true newest k, whatever the order of the file."""
    return top_k(df, part, [F.desc(date), F.col(tie)], k)


def top_k_rest(df: DataFrame, part: list[str], item: str, value: str, k: int, rest: str = "others") -> DataFrame:
    """The k largest items and one row for all others; the rows add up to the total."""
    sums = df.groupBy(*part, F.col(item).cast("string").alias(item)).agg(F.sum(value).alias(value))
    ranked = sums.withColumn("_r", F.row_number().over(Window.partitionBy(*part).orderBy(F.desc(value), item)))
    return ranked.groupBy(*part, F.when(F.col("_r") <= k, F.col(item)).otherwise(rest).alias(item), F.least("_r", F.lit(k + 1)).alias("rank")).agg(F.sum(value).alias(value), F.count("*").alias("items"))


def nested_top_k(df: DataFrame, part: list[str], item: str, sub: str, value: str, k1: int, k2: int) -> DataFrame:
    """The k1 largest items of each group and the k2 largest parts of each of these."""
    by_sub = df.groupBy(*part, item, sub).agg(F.sum(value).alias(value))
    items = by_sub.groupBy(*part, item).agg(F.sum(value).alias("item_value"))
    best = items.withColumn("item_rank", F.row_number().over(Window.partitionBy(*part).orderBy(F.desc("item_value"), item))).where(F.col("item_rank") <= k1)
    inner = by_sub.join(best, [*part, item])
    return inner.withColumn("rank", F.row_number().over(Window.partitionBy(*part, item).orderBy(F.desc(value), sub))).where(F.col("rank") <= k2)


def priority_newest(df: DataFrame, part: list[str], prio: Column, date: str, tie: str, k: int) -> DataFrame:
    """By priority, then newest."""
    return top_k(df, part, [prio.asc(), F.desc(date), F.col(tie)], k)


def role_dedupe(df: DataFrame, part: list[str], person: str, role: str, ranks: dict[str, int]) -> DataFrame:
    """Each person once, in the highest role; roles not named come last."""
    rank = F.lit(len(ranks) + 1)
    for name, r in ranks.items():
        rank = F.when(F.col(role) == name, r).otherwise(rank)
    return df.withColumn("role_rank", rank).withColumn("_n", F.row_number().over(Window.partitionBy(*part, person).orderBy("role_rank", role))).where("_n = 1").drop("_n")


def vs_median(df: DataFrame, group: str, col: str) -> DataFrame:
    """Ratio to the group's median and which side of it."""
    med = df.groupBy(group).agg(F.median(F.col(col).cast("double")).alias("median"))
    out = df.join(med, group)
    v = F.col(col).cast("double")
    return out.withColumns({"ratio": F.bround(F.try_divide(v, F.col("median")), 4), "side": F.when(v > F.col("median"), "above").when(v < F.col("median"), "below").when(v.isNotNull(), "at")})


def bar_scale(df: DataFrame, col: str, part: list[str]) -> DataFrame:
    """Share of the group's largest value."""
    return df.withColumn("bar", F.bround(F.try_divide(F.col(col).cast("double"), F.max(F.col(col).cast("double")).over(Window.partitionBy(*part))), 4))


def global_top(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """Each task keeps k rows and one merges them."""
    return df.orderBy(*order).limit(k)


def top_ratio(df: DataFrame, num: str, den: str, tie: str, k: int, places: int = 4) -> DataFrame:
    """By a ratio whose denominator may be zero; those rows rank nowhere."""
    r = F.bround(F.try_divide(F.col(num).cast("double"), F.col(den).cast("double")), places)
    return df.withColumn("ratio", r).where("ratio is not null").orderBy(F.desc("ratio"), tie).limit(k)


def ordered_by_state(df: DataFrame, state: str, ranks: dict[str, int], date: str, tie: str) -> DataFrame:
    """By state's rank, newest first, rows without date last; position numbers the rows of a state."""
    rank = F.lit(len(ranks) + 1)
    for name, r in ranks.items():
        rank = F.when(F.col(state) == name, r).otherwise(rank)
    return df.withColumn("state_rank", rank).withColumn("position", F.row_number().over(Window.partitionBy("state_rank").orderBy(F.col(date).desc_nulls_last(), tie)))


def recent_events(df: DataFrame, date: str, tie: str, cap: int = 200) -> DataFrame:
    """T4."""
    return df.orderBy(F.desc(date), tie).limit(cap)


def rank_by(df: DataFrame, measure: str, tie: str, filters: Column | None = None, desc: bool = True, k: int = 100) -> tuple[DataFrame, DataFrame]:
    """T5: the ranking by a measure, and how many rows have none."""
    rows = df if filters is None else df.where(filters)
    order = F.desc(measure) if desc else F.asc(measure)
    return rows.where(F.col(measure).isNotNull()).orderBy(order, tie).limit(k), rows.agg(F.count_if(F.col(measure).isNull()).alias("without"))


def most_common(df: DataFrame, col: str, k: int) -> DataFrame:
    """T6."""
    return df.groupBy(col).agg(F.count("*").alias("n")).orderBy(F.desc("n"), col).limit(k)
