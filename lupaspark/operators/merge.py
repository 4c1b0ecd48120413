"""Set operations and layered merges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def union_layers(*layers: DataFrame) -> DataFrame:
    """By name; a column that a layer lacks is null in it."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), layers)


def first_layer(df: DataFrame, position: list[str], layer: str) -> DataFrame:
    """The lowest layer that fills a position gives its whole list."""
    return df.withColumn("_m", F.min(layer).over(Window.partitionBy(*position))).where(F.col(layer) == F.col("_m")).drop("_m")


def overlay(curated: DataFrame, generated: DataFrame, key: str, fields: list[str], sets: list[str]) -> DataFrame:
    """Curated rows over generated ones: fields filled where the curated is null, array columns united, rows of either side alone kept."""
    c, g = curated.alias("c"), generated.alias("g")
    joined = c.join(g, F.col(f"c.{key}") == F.col(f"g.{key}"), "full_outer")
    union = lambda x: F.array_sort(F.array_distinct(F.concat(*[F.coalesce(F.col(f"{s}.{x}"), F.array().cast("array<string>")) for s in "cg"])))
    origin = F.when(F.col(f"g.{key}").isNull(), "curated").when(F.col(f"c.{key}").isNull(), "generated").otherwise("both")
    return joined.select(F.coalesce(f"c.{key}", f"g.{key}").alias(key), *[F.coalesce(f"c.{f}", f"g.{f}").alias(f) for f in fields], *[union(s).alias(s) for s in sets], origin.alias("origin"))


def qualify_names(nodes: DataFrame, name: str, parent_name: str) -> DataFrame:
    """U4: a name that several nodes bear gets its parent's as suffix."""
    n = F.count("*").over(Window.partitionBy(name))
    return nodes.withColumn(name, F.when((n > 1) & F.col(parent_name).isNotNull(), F.concat_ws(" – ", name, parent_name)).otherwise(F.col(name)))


def repair_ids(df: DataFrame, id_col: str, code: str) -> DataFrame:
    """Of the rows that share an id, all but the first by code get the code appended."""
    r = F.row_number().over(Window.partitionBy(id_col).orderBy(code))
    return df.withColumn(id_col, F.when(r > 1, F.concat_ws("-", id_col, code)).otherwise(F.col(id_col)))


def distinct_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """U6."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def append_missing(hist: DataFrame, current: DataFrame, on: list[str]) -> DataFrame:
    """History and the present holders that it lacks."""
    return hist.unionByName(current.join(hist, on, "left_anti"), allowMissingColumns=True)


def difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """U8: keys of one side only."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("right")))


def common(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """U9."""
    return left.select(key).intersect(right.select(key))


def duplicate_edges(edges: DataFrame) -> DataFrame:
    """(type, from, to) that occur more than once."""
    return edges.groupBy("type", "from", "to").agg(F.count("*").alias("n")).where("n > 1")
