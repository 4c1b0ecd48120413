"""Sinks (S14-S18)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def to_pt(df: DataFrame) -> DataFrame:
    """All columns as text: decimal commas, sim and não."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind.startswith(("decimal", "double", "float")):
            c = F.replace(F.when(c == F.floor(c), F.format_string("%.1f", c.cast("double"))).otherwise(c.cast("string")), F.lit("."), F.lit(","))
        elif kind == "boolean":
            c = F.when(c, "sim").when(~c, "não")
        elif kind.startswith(("array", "map", "struct")):
            c = F.to_json(c)
        out.append(c.cast("string").alias(name))
    return df.select(*out)


def write_csv_pt(df: DataFrame, path: str) -> None:
    """Semicolons and a header; spreadsheets find UTF-8 by the mark that begins the first column's name."""
    out = to_pt(df)
    out = out.withColumnRenamed(out.columns[0], "﻿" + out.columns[0])
    out.write.mode("overwrite").csv(path, sep=";", header=True, encoding="UTF-8")


def documents(df: DataFrame, key: str, core: list[str], detail: list[str]) -> DataFrame:
    """(key, core, detail): one JSON document of the light columns and one of the heavy ones for each entity."""
    return df.select(key, F.to_json(F.struct(key, *core)).alias("core"), F.to_json(F.struct(key, *detail)).alias("detail"))


def write_docs(df: DataFrame, key: str, core: list[str], detail: list[str], path: str) -> None:
    """The same, as files of JSON lines; documents are spread over as many files as Spark has partitions, not one file each."""
    docs = documents(df, key, core, detail)
    docs.select(F.col("core").alias("value")).write.mode("overwrite").text(f"{path}/core")
    docs.select(F.col("detail").alias("value")).write.mode("overwrite").text(f"{path}/detail")


def write_bundle(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Each table as Parquet, and the manifest (table, rows, columns)."""
    spark = next(iter(tables.values())).sparkSession
    rows = []
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        rows.append((name, spark.read.parquet(f"{path}/{name}").count(), len(df.columns)))
    manifest = spark.createDataFrame(rows, "table string, rows long, columns int")
    manifest.write.mode("overwrite").parquet(f"{path}/_manifest")
    return manifest


def feed_table(changes: DataFrame, kind: str | None, k: int = 100) -> DataFrame:
    """The newest k changes, each with a stable id. changes(kind, date, subject, person)."""
    rows = changes if kind is None else changes.where(F.col("kind") == kind)
    guid = F.sha1(F.concat_ws("|", "kind", F.col("date").cast("string"), F.col("subject").cast("string"), F.col("person").cast("string")))
    return rows.withColumn("guid", guid).orderBy(F.desc("date"), "guid").limit(k)


def write_index(df: DataFrame, key: str, path: str, partitions: int = 64) -> None:
    """An index for other jobs, partitioned by hash of the key and sorted by it, so that a look-up reads one part and few of its pages."""
    part = F.pmod(F.xxhash64(key), F.lit(partitions)).alias("part")
    df.select("*", part).repartition("part").sortWithinPartitions(key).write.mode("overwrite").partitionBy("part").parquet(path)


def read_index(spark: SparkSession, path: str, keys: DataFrame, key: str, partitions: int = 64) -> DataFrame:
    """The index's rows of keys(key); the part is a join column, so that parts without keys are pruned at run time."""
    k = keys.select(key, F.pmod(F.xxhash64(key), F.lit(partitions)).cast("int").alias("part")).distinct()
    return spark.read.parquet(path).join(k, ["part", key]).drop("part")
