"""Other joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lupaspark.functions import columns as C


def keep(facts: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """J27."""
    return facts.join(keys, on, "left_semi")


def uncovered(facts: DataFrame, dim: DataFrame, on: list[str]) -> DataFrame:
    """J28."""
    return facts.join(dim, on, "left_anti")


def overlap(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys of both sides."""
    return left.select(*keys).distinct().join(right.select(*keys).distinct(), keys)


def share_in_set(facts: DataFrame, top: DataFrame, part: list[str], keys: list[str], value: str) -> DataFrame:
    """Share of each author's money that goes to the author's own set of places."""
    own = top.select(*part, *keys).distinct().withColumn("_in", F.lit(True))
    joined = facts.join(own, [*part, *keys], "left")
    return joined.groupBy(*part).agg(F.sum(value).alias("total"), F.bround(F.try_divide(F.sum(F.when(F.col("_in"), F.col(value))).cast("double"), F.sum(value).cast("double")), 4).alias("share"))


def same_surname_count(staff: DataFrame, heads: DataFrame) -> DataFrame:
    """(head, n): how many of the head's own staff share the surname; no names. staff(head, name), heads(head, name)."""
    last = heads.select("head", F.element_at(C.tokens(F.col("name")), -1).alias("surname"))
    hit = F.array_contains(C.tokens(F.col("name")), F.col("surname"))
    return staff.join(last, "head").groupBy("head").agg(F.count_if(hit).alias("n"))


def value_levels(staff: DataFrame, levels: DataFrame, on: list[str]) -> DataFrame:
    """Staff with what their level pays; null where the table has no such level."""
    return staff.join(levels, on, "left")


def attach_sum(df: DataFrame, amounts: DataFrame, key: str, value: str) -> DataFrame:
    """The key's sum beside each row."""
    return df.join(amounts.groupBy(key).agg(F.sum(value).alias("amount")), key, "left")


def match_rules(targets: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, family) of the targets that one family alone claims, and those that several do. targets(id, name, subtype), rules(family, kind, pattern, except_pattern).

    kind is id (equal), subtype (equal) or name (regular expression without the exception). Equal kinds meet by hash; patterns are a few rows.
    """
    exact = rules.where("kind in ('id', 'subtype')").select("family", F.concat_ws(":", "kind", "pattern").alias("k"))
    keys = targets.select("id", F.explode(F.array(F.concat(F.lit("id:"), F.col("id").cast("string")), F.concat(F.lit("subtype:"), "subtype"))).alias("k"))
    by_key = keys.join(exact, "k").select("id", "family")
    by_name = targets.join(rules.where("kind = 'name'"), F.expr("name rlike pattern and not coalesce(name rlike except_pattern, false)")).select("id", "family")
    claims = by_key.union(by_name).distinct()
    n = claims.groupBy("id").agg(F.count("*").alias("claims"), F.min("family").alias("family"), F.array_join(F.array_sort(F.collect_set("family")), ",").alias("families"))
    return n.where("claims = 1").select("id", "family"), n.where("claims > 1").select("id", "families")


def coalesce_sources(df: DataFrame, key: str, sources: list[tuple[DataFrame, str, str]], out: str) -> DataFrame:
    """The first source's value that is known, and its label in <out>_source. A source has each key once."""
    values, labels = [], []
    for i, (src, col, label) in enumerate(sources):
        df = df.join(src.select(F.col(key), F.col(col).alias(f"_v{i}")), key, "left")
        values.append(F.col(f"_v{i}"))
        labels.append(F.when(F.col(f"_v{i}").isNotNull(), F.lit(label)))
    return df.withColumns({out: F.coalesce(*values), f"{out}_source": F.coalesce(*labels)}).drop(*[f"_v{i}" for i in range(len(sources))])


def attach_children(parent: DataFrame, child: DataFrame, key: str, col: str, k: int = 6) -> DataFrame:
    """The distinct children's first k, sorted, as an array; empty where there are none."""
    rows = child.select(key, col).distinct().withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(col))).where(F.col("_r") <= k)
    lists = rows.groupBy(key).agg(F.array_sort(F.collect_list(col)).alias(f"{col}_list"))
    return parent.join(lists, key, "left").withColumn(f"{col}_list", F.coalesce(f"{col}_list", F.array().cast(f"array<{dict(child.dtypes)[col]}>")))


def assemble(people: DataFrame, blocks: dict[str, DataFrame], key: str) -> DataFrame:
    """People with a struct of each block's columns, null where a block has no row. A block has each key once."""
    for name, block in blocks.items():
        cols = [c for c in block.columns if c != key]
        people = people.join(block.select(key, F.struct(*cols).alias(name)), key, "left")
    return people


