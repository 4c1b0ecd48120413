"""Shared helpers: tables in the cluster's shared folder, and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys of more than one row in so many are joined by broadcast; there are no more than so many of them.
HEAVY = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's spark.checkpoint.dir. Where that is unset, one of our own if driver and executors are one machine, else an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="lupaspark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/lupaspark/{tag}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, tag: str) -> DataFrame:
    """Cuts lineage: the rows as a table in the shared folder, which outlives any executor."""
    return written_at(df, tag)[0]


def written_at(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def quoted(name: str) -> str:
    """A column's name as Spark reads it whatever it holds: dots, blanks, backticks."""
    return "`" + name.replace("`", "``") + "`"


def looked_up(left: DataFrame, right: DataFrame, keys: list[str], spread: str) -> DataFrame:
    """Inner join of left with right(keys, n, ...), whose keys are unique and stand in n rows of left, that no frequent key brings to one task.

    Keys of more than one row in HEAVY are at most HEAVY, so that their part of right is broadcast; rows that find theirs there are dealt by
    `spread`, an expression, in the join with the others. Left's rows are read and shuffled once.
    """
    least = (right.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long")).first()[0]) // HEAVY
    values = [c for c in right.columns if c not in keys and c != "n"]
    heavy = right.where(F.col("n") > max(least, 1)).select(*[F.col(k).alias(f"_heavy_{k}") for k in keys], F.struct(*values).alias("_heavy"))
    found = left.join(F.broadcast(heavy), [F.col(k) == F.col(f"_heavy_{k}") for k in keys], "left").drop(*[f"_heavy_{k}" for k in keys])
    light = right.where(F.col("n") <= max(least, 1)).select(*[F.col(k).alias(f"_light_{k}") for k in keys], F.lit(0).cast("long").alias("_light_at"), F.struct(*values).alias("_light"))
    # A key of light rows has place 0; a row with its answer has a place of its own, and so no partner.
    found = found.withColumn("_at", F.when(F.col("_heavy").isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(F.expr(spread)).bitwiseOR(F.lit(1))))
    joined = found.join(light.hint("merge"), [*[F.col(k) == F.col(f"_light_{k}") for k in keys], F.col("_at") == F.col("_light_at")], "left")
    value = F.coalesce("_heavy", "_light")
    return joined.where(value.isNotNull()).select(*left.columns, *[value[v].alias(v) for v in values])


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges(a, b) that is not the smallest of its component.

    Alternates large-star and small-star rounds; each is an aggregate and a join on node ids, so a hub
    is one partially aggregated key and no neighbourhood is ever gathered. The driver sees two numbers a round.
    Loops and repeated edges are allowed; null ends are ignored.
    """
    spark = edges.sparkSession
    now, path = written_at(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark[0] == 0 or tuple(mark) == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = tuple(mark)
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least)
        after, after_path = written_at(small.distinct(), "edges")
        drop_path(spark, path)
        now, path = after, after_path
