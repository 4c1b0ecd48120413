"""Data quality (Q1-Q14): each check returns the rows that break it, or a report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """Q1: keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def references(df: DataFrame, fk: str, dim: DataFrame, key: str) -> DataFrame:
    """Q2: foreign keys without a row; nulls refer to nothing."""
    return df.where(F.col(fk).isNotNull()).join(dim.select(F.col(key).alias(fk)), fk, "left_anti")


def conforms(df: DataFrame, key: str, rules: list[tuple[str, str, Column]]) -> DataFrame:
    """Q3: (key, level, message) for each rule (level, message, condition that must hold) that a row breaks; unknown breaks it."""
    bad = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.struct(F.lit(level).alias("level"), F.lit(msg).alias("message"))) for level, msg, ok in rules]))
    return df.select(key, F.explode(bad).alias("b")).select(key, "b.level", "b.message")


def single_owner(df: DataFrame, key: str, owner: str) -> DataFrame:
    """Q4: keys with several owners."""
    return df.groupBy(key).agg(F.count_distinct(owner).alias("owners")).where("owners > 1")


def shrink(prev: DataFrame, cur: DataFrame, key: str, n: str, floor: float = 0.4, lost: int = 0) -> DataFrame:
    """Q5: sizes under `floor` of the previous ones, with at least `lost` fewer; what is missing has size 0."""
    out = prev.select(key, F.col(n).alias("before")).join(cur.select(key, F.col(n).alias("after")), key, "left").withColumn("after", F.coalesce("after", F.lit(0)))
    return out.where((F.col("after") < F.col("before") * floor) & (F.col("before") - F.col("after") >= lost))


def monotone(prev: DataFrame, cur: DataFrame, key: str, n: str) -> DataFrame:
    """Q6: counters that fell."""
    return shrink(prev, cur, key, n, 1.0)


def freshness(datasets: DataFrame, limits: DataFrame, as_of, default_days: int = 7) -> DataFrame:
    """Q7: (dataset, age, limit, stale). datasets(dataset, generated), limits(dataset, days)."""
    age = F.datediff(F.lit(as_of).cast("date"), F.col("generated").cast("date"))
    out = datasets.join(limits, "dataset", "left").select("dataset", age.alias("age"), F.coalesce("days", F.lit(default_days)).alias("limit"))
    return out.withColumn("stale", F.coalesce(F.col("age") > F.col("limit"), F.lit(True)))


def run_registry(prev: DataFrame, runs: DataFrame, known: DataFrame, as_of) -> DataFrame:
    """Q8: (connector, status, seconds, last_ok, days_without) after a run; connectors no longer known go."""
    r = runs.withColumn("_ok", F.when(F.col("status") == "ok", F.lit(as_of).cast("date")))
    p = prev.select("connector", F.col("status").alias("_ps"), F.col("seconds").alias("_pt"), F.col("last_ok").alias("_pl"))
    out = known.select("connector").join(r, "connector", "left").join(p, "connector", "left")
    out = out.select("connector", F.coalesce("status", "_ps").alias("status"), F.coalesce("seconds", "_pt").alias("seconds"), F.coalesce("_ok", "_pl").alias("last_ok"))
    return out.withColumn("days_without", F.datediff(F.lit(as_of).cast("date"), "last_ok"))


def regressions(prev: DataFrame, cur: DataFrame, floor: float = 20, pct: float = 5) -> DataFrame:
    """Q9: metrics of a base of some size that fell by pct per cent or more. Both (metric, value)."""
    out = prev.select("metric", F.col("value").alias("before")).join(cur.select("metric", F.col("value").alias("after")), "metric")
    return out.where((F.col("before") >= floor) & (F.col("after") <= F.col("before") * (1 - pct / 100)))


def golden(df: DataFrame, must: DataFrame, must_not: DataFrame) -> DataFrame:
    """Q10: (raw, expected, got) of names that should have matched and did not, or matched and should not. df(raw, node), must(raw, node), must_not(raw)."""
    a = must.select("raw", F.col("node").alias("expected")).join(df.select("raw", F.col("node").alias("got")), "raw", "left").where("not (expected <=> got)")
    b = must_not.select("raw", F.lit(None).cast(dict(must.dtypes)["node"]).alias("expected")).join(df.select("raw", F.col("node").alias("got")), "raw").where("got is not null")
    return a.unionByName(b)


def unmatched(df: DataFrame, name: str, reason: str, volume: str, k: int = 50) -> DataFrame:
    """Q11: names without a match, with their reason, rows and volume; the k largest."""
    return df.groupBy(name, reason).agg(F.count("*").alias("n"), F.sum(volume).alias("volume")).orderBy(F.desc("volume"), name).limit(k)


def complete(months: DataFrame, wanted: DataFrame, tolerance: int = 2) -> DataFrame:
    """Q12: one row: months missing, and whether that is within tolerance. Both (month)."""
    return wanted.join(months.select("month").distinct(), "month", "left_anti").agg(F.count("*").alias("missing")).withColumn("ok", F.col("missing") <= tolerance)


def carried_age(df: DataFrame, origin: str, seen: str, as_of, days: int = 45) -> DataFrame:
    """Q13: carried rows, those older than `days`, and their share of all."""
    old = (F.col(origin) == "carried") & (F.datediff(F.lit(as_of).cast("date"), F.col(seen)) > days)
    return df.agg(F.count("*").alias("n"), F.count_if(F.col(origin) == "carried").alias("carried"), F.count_if(old).alias("old"), F.bround(F.try_divide(F.count_if(old) * 100.0, F.count("*").cast("double")), 1).alias("old_pct"))


def signals(people: DataFrame) -> DataFrame:
    """Q14: (person_id, signal): neutral facts across sources that reach their thresholds.

    people(person_id, same_surname, staff, staff_changes, vote_money_share, vote_money, donor_payees, assets_before, assets_after).
    """
    rules = [
        ("same surname among staff", F.col("same_surname") >= 1),
        ("staff turnover", F.col("staff_changes") >= F.greatest(F.lit(6), F.ceil(F.col("staff") * 0.5))),
        ("money to own voters", (F.col("vote_money_share") >= 0.8) & (F.col("vote_money") >= 1_000_000)),
        ("donor was paid later", F.col("donor_payees") >= 1),
        ("assets doubled", (F.col("assets_after") - F.col("assets_before") >= 500_000) & (F.col("assets_after") >= 2 * F.col("assets_before")) & (F.col("assets_before") > 0)),
    ]
    return people.select("person_id", F.explode(F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules]))).alias("signal"))
