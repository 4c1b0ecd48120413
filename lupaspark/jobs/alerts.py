"""Contracts signed with suppliers that were barred at the time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lupaspark.functions import columns as C
from lupaspark.operators import quality as Q
from lupaspark.operators import ranking as W
from lupaspark.operators import resolve as R
from lupaspark.operators import temporal as T


def resolved_buyers(contracts: DataFrame, cache: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Contracts with `node` and `how`, the pairs (key, node) that the cache did not have, and (reason, raw, n, volume) of the names that no node answers.

    contracts(contract, buyer_code, buyer_name, value, ...), cache(key, node), nodes(id, name, sigla). A code that earlier runs have learned goes first (J8), else the
    name's ladder (J4); names resolve once each.
    """
    ladder = R.resolve_names(contracts.select(F.col("buyer_name").alias("raw")), nodes)
    out, fresh = R.resolve_with_cache(contracts, "buyer_code", ["buyer_name"], cache, ladder.select("raw", "node"))
    out = out.join(ladder.select(F.col("raw").alias("buyer_name"), F.col("how").alias("_how")), "buyer_name", "left").join(cache.select(F.col("key").alias("buyer_code"), F.lit("known code").alias("_known")), "buyer_code", "left")
    out = out.withColumn("how", F.coalesce("_known", "_how", F.lit("no name"))).drop("_how", "_known")
    return out, fresh, Q.unmatched(out.where("node is null"), "buyer_name", "how", "value", 40)


def alerts(contracts: DataFrame, sanctions: DataFrame) -> DataFrame:
    """(contract, firm_key, node, signed, value, sanctions, reach): contracts under a sanction that bars (F33) and reaches the buyer (F34) on the day of signing.

    reach is 'known' if some sanction surely reaches the buyer and 'unknown' if none is sure; sanctions that surely don't reach it make no alert.
    contracts(contract, firm_key, node, signed, value), sanctions(firm_key, valid_from, valid_to, category, reach, body_key, sanction_id).
    """
    reaches = C.reaches_buyer(F.col("reach"), F.col("body_key"), F.col("node"))
    held = T.in_force_join(contracts.select("contract", "firm_key", "node", "signed", "value"), sanctions, ["firm_key"], "signed", extra=C.bars_contracting(F.col("category")) & F.coalesce(reaches, F.lit(True)))
    return held.groupBy("contract", "firm_key", "node", "signed", "value").agg(F.count_distinct("sanction_id").alias("sanctions"), F.when(F.bool_or(F.coalesce(reaches, F.lit(False))), "known").otherwise("unknown").alias("reach"))


def barred_suppliers(contracts: DataFrame, cache: DataFrame, nodes: DataFrame, sanctions: DataFrame, newest: int = 3) -> DataFrame:
    """The newest alerts of each supplier (W4) beside its total of alerts and money."""
    found = alerts(resolved_buyers(contracts, cache, nodes)[0], sanctions)
    total = found.groupBy("firm_key").agg(F.count("*").alias("alerts"), F.sum("value").alias("volume"))
    return W.newest(found, ["firm_key"], "signed", newest, "contract").join(total, "firm_key")
