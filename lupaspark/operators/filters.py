"""Filters and projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lupaspark.functions import columns as C


def scoped(df: DataFrame, predicate: Column, report: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows in scope, and how many lie outside (nulls do), by the report's columns."""
    inside = F.coalesce(predicate, F.lit(False))
    return df.where(inside), df.groupBy(*(report or [])).agg(F.count_if(~inside).alias("n_excluded"), F.count_if(inside).alias("n_kept"))


def clean_sentinels(df: DataFrame, cols: list[str], values: list[str]) -> DataFrame:
    """Words that stand for 'not known' become null, whatever their case and outer spaces."""
    known = [v.strip().lower() for v in values]
    return df.withColumns({c: F.when(~F.lower(F.trim(c)).isin(known), F.col(c)) for c in cols})


def destination(df: DataFrame, modality: str, payee: str, modalities: dict[str, str], payees: dict[str, str]) -> DataFrame:
    """Destination by modality code, else by payee type; rows with neither go."""
    lookup = lambda m, c: F.element_at(C._map(m), F.col(c)) if m else F.lit(None).cast("string")
    return df.withColumn("destination", F.coalesce(lookup(modalities, modality), lookup(payees, payee))).where("destination is not null")


def in_period(df: DataFrame, col: str, start, end) -> DataFrame:
    """Start and end included; a bound of None is open."""
    out = df.where(F.col(col) >= F.lit(start)) if start is not None else df
    return out.where(F.col(col) <= F.lit(end)) if end is not None else out


def exclude_codes(df: DataFrame, col: str, codes: list) -> DataFrame:
    """P5: rows with no code stay."""
    return df.where(F.col(col).isNull() | ~F.col(col).isin(codes))


def min_support(df: DataFrame, n: str, k: float) -> DataFrame:
    """P6."""
    return df.where(F.col(n) >= k)


def named_only(df: DataFrame, kind: str, value: str, floor: float, individual: str = "individual") -> DataFrame:
    """Individuals under the floor are never named; they go before any ranking."""
    return df.where(~((F.col(kind) == individual) & (F.col(value) < floor)))


def local_only(df: DataFrame, place_uf: str, author_uf: str, home: str) -> DataFrame:
    """Money to the home place counts for its own authors alone."""
    return df.where(~((F.col(place_uf) == home) & (F.col(author_uf) != home)))


def external_only(df: DataFrame, name: str, own_org: str, sigla: str | None = None, cut: float = 0.6) -> DataFrame:
    """Entities that are the organ itself go: token Jaccard of at least `cut`, or its sigla."""
    a, b = C.tokens(F.col(name)), C.tokens(F.col(own_org))
    same = F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double")) >= cut
    if sigla:
        same = same | F.array_contains(a, F.lower(sigla))
    return df.where(~F.coalesce(same, F.lit(False)))


def drop_junk(df: DataFrame, name: str, junk: DataFrame, label: str) -> DataFrame:
    """P10: rows whose normalised name is a junk label go."""
    keys = junk.select(C.norm_alnum(F.col(label)).alias("_junk")).distinct()
    return df.join(keys, C.norm_alnum(F.col(name)) == F.col("_junk"), "left_anti")


def drop_stale(df: DataFrame, source: str, date: str, stale_source: str, cut) -> DataFrame:
    """A secondary source counts from the cut on."""
    return df.where(~((F.col(source) == stale_source) & (F.coalesce(F.col(date) < F.lit(cut), F.lit(True)))))


def split_columns(df: DataFrame, key: str, core: list[str]) -> tuple[DataFrame, DataFrame]:
    """The core columns and, by the same key, the others."""
    return df.select(key, *core), df.drop(*core)


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by an order that must be total."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
