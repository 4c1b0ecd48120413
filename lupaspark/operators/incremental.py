"""State carried from run to run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def accumulate(prev: DataFrame, new: DataFrame, id_col: str) -> DataFrame:
    """Rows of ids not seen before are added, each once; the same window twice changes nothing."""
    fresh = new.join(prev.select(id_col), id_col, "left_anti").dropDuplicates([id_col])
    return prev.unionByName(fresh, allowMissingColumns=True)


def snapshot_diff(prev: DataFrame, cur: DataFrame, key: list[str], as_of) -> DataFrame:
    """(key, event, date): who entered and who left between snapshots; nothing on the first run, whose previous one is empty."""
    a, b = prev.select(*key).distinct().withColumn("_a", F.lit(True)), cur.select(*key).distinct().withColumn("_b", F.lit(True))
    known = prev.select(F.lit(True).alias("_any")).limit(1)
    both = a.join(b, key, "full_outer").where("_a is null or _b is null")
    return both.join(F.broadcast(known)).select(*key, F.when(F.col("_a").isNull(), "entered").otherwise("left").alias("event"), F.lit(as_of).cast("date").alias("date"))  # one row


def scd(prev: DataFrame, cur: DataFrame, key: list[str], as_of) -> DataFrame:
    """Tenure table (key, valid_from, valid_to) after a snapshot: open spans that are gone end, new keys open."""
    day = F.lit(as_of).cast("date")
    now = cur.select(*key).distinct().withColumn("_now", F.lit(True))
    open_ = prev.where("valid_to is null").join(now, key, "left").select(*key, "valid_from", F.when(F.col("_now").isNull(), day).alias("valid_to"))
    fresh = now.join(prev.where("valid_to is null"), key, "left_anti").select(*key, day.alias("valid_from"), F.lit(None).cast("date").alias("valid_to"))
    return prev.where("valid_to is not null").select(*key, "valid_from", "valid_to").unionByName(open_).unionByName(fresh)


def retain(store: DataFrame, new: DataFrame, text: list[str], date: str, days: int, as_of) -> DataFrame:
    """Store by content: texts not yet kept are added under their hash, those older than `days` go."""
    h = F.sha1(F.concat_ws("\n", *text))
    added = new.withColumn("content_id", h).dropDuplicates(["content_id"]).join(store.select("content_id"), "content_id", "left_anti")
    return store.unionByName(added, allowMissingColumns=True).where(F.datediff(F.lit(as_of).cast("date"), F.col(date).cast("date")) <= days)


def windows_log(prev: DataFrame, new: DataFrame, at: str, k: int = 30) -> DataFrame:
    """I4: the newest k windows read."""
    return prev.unionByName(new).distinct().orderBy(F.desc(at)).limit(k)


def due(df: DataFrame, memory: DataFrame, key: str, at: str, days: int, as_of) -> DataFrame:
    """Keys not asked for within `days`."""
    recent = memory.where(F.datediff(F.lit(as_of).cast("date"), F.col(at).cast("date")) <= days)
    return df.join(recent.select(key), key, "left_anti")


def carry_forward(prev: DataFrame, cur: DataFrame, key: str, value: str, seen: str, max_days: int, as_of) -> DataFrame:
    """(key, value, seen, origin): today's value, else that of before if seen within max_days. prev and cur(key, value, seen)."""
    p, c = prev.alias("p"), cur.alias("c")
    both = p.join(c, F.col(f"p.{key}") == F.col(f"c.{key}"), "full_outer")
    fresh = F.col(f"c.{value}").isNotNull()
    out = both.select(F.coalesce(f"c.{key}", f"p.{key}").alias(key), F.coalesce(f"c.{value}", f"p.{value}").alias(value), F.when(fresh, F.col(f"c.{seen}")).otherwise(F.col(f"p.{seen}")).alias(seen), F.when(fresh, "current").otherwise("carried").alias("origin"))
    return out.where((F.col("origin") == "current") | (F.datediff(F.lit(as_of).cast("date"), F.col(seen)) <= max_days))


def changed_only(df: DataFrame, prev: DataFrame, key: str, content: list[str]) -> DataFrame:
    """Rows whose content hash is new or differs. prev(key, content_hash)."""
    h = F.sha1(F.concat_ws("\n", *content))
    return df.withColumn("content_hash", h).join(prev.select(key, F.col("content_hash").alias("_h")), key, "left").where("_h is null or _h <> content_hash").drop("_h")


def learn(prev: DataFrame, pairs: DataFrame, key: str, value: str) -> DataFrame:
    """I8: a mapping that grows: keys known keep their value, new ones that point to one value alone are added."""
    new = pairs.groupBy(key).agg(F.min(value).alias(value), F.count_distinct(value).alias("_n")).where("_n = 1").drop("_n")
    return prev.unionByName(new.join(prev, key, "left_anti"))


