"""The institutional structure from registries and curated entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lupaspark.operators import graph as G
from lupaspark.operators import merge as U
from lupaspark.operators import temporal as T


def structure(units: DataFrame, curated: DataFrame, natures: dict[str, int], top: int = 4) -> DataFrame:
    """(id, code, name, parent, how, ring, depth, cyclic, origin) of every organ.

    units(code, id, above, name, nature, is_organ) come from the registry, curated(id, name, nature, aliases) by hand. Ids that several codes share are repaired (U5); curated fields go over generated
    ones (U3); parents are the organ above or that above an intermediate unit (N8); names that several organs bear get their parent's (U4); rings start
    from the legal nature (N9) and go down the tree to any depth (N4). Curated organs that the registry lacks have no code and no parent.
    """
    organs = U.repair_ids(units.where("is_organ").select("code", "id", "name", "nature").withColumn("aliases", F.array().cast("array<string>")), "id", "code")
    merged = U.overlay(curated.withColumn("code", F.lit(None).cast("string")), organs, "id", ["name", "nature", "code"], ["aliases"])
    above = G.resolve_parent(units.select(F.col("code").alias("id"), "above"), organs.select(F.col("code").alias("id"))).where("parent is not null").select(F.col("id").alias("code"), F.col("parent").alias("_up"), "how")
    names = merged.select(F.col("code").alias("_up"), F.col("id").alias("parent"), F.col("name").alias("_parent_name")).where("_up is not null")
    placed = merged.join(above, "code", "left").join(names, "_up", "left")
    named = U.qualify_names(placed, "name", "_parent_name")
    ringed = G.assign_ring(named, "nature", natures)
    deep = G.depths(ringed.select("id", "parent", "ring"), top)
    return named.select("id", "code", "name", "parent", "how", "origin").join(deep, "id")


def history(terms: DataFrame, present: DataFrame, cut, gap: int = 31) -> DataFrame:
    """(unit, person, start, end, spans, missing_predecessor): terms chained where they follow within `gap` days (W9), the present holder added where history lacks them (U7), and the list of each unit (W11). terms and present(unit, person, start, end)."""
    whole = U.append_missing(terms, present, ["unit", "person"])
    return T.tenure_list(T.chain_spans(whole, ["unit", "person"], "start", "end", gap), "unit", "person", "start", "end", F.lit(cut).cast("date"))
