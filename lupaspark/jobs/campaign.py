"""Candidacies joined to people, what they declared, who paid for them and whom they pay."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lupaspark.functions import columns as C
from lupaspark.operators import filters as P
from lupaspark.operators import joins as J
from lupaspark.operators import resolve as R
from lupaspark.operators import selection as SEL


def people_of(cands: DataFrame, people: DataFrame) -> DataFrame:
    """(cand_id, year, person_id, how): full name, else short name and state (J9), unless both births are known and differ (J10); of those left without any, a short name that is unique in its year and among people.

    cands(cand_id, year, name, short, uf, birth), people(person_id, name, short, uf, birth). A vetoed candidacy is 'birth differs' and gets no second try.
    """
    first = R.person_join(cands.select("cand_id", "year", "name", "short", "uf", "birth"), people)
    told = first.join(people.select("person_id", F.col("birth").alias("_own")), "person_id", "left")
    veto = F.coalesce(F.col("birth") != F.col("_own"), F.lit(False))
    told = told.select("cand_id", "year", F.when(~veto, F.col("person_id")).alias("person_id"), F.when(F.col("person_id").isNotNull() & veto, "birth differs").otherwise(F.col("how")).alias("how"), C.norm_alpha(F.col("short")).alias("short_key"))
    rest = told.where("how is null").select("cand_id", "year", "short_key")
    known = people.select("person_id", C.norm_alpha(F.col("short")).alias("short_key"))
    second = R.second_pass(rest, told.where("how is not null").select("cand_id"), known, "short_key", "year").select("cand_id", F.col("person_id").alias("_second"))
    out = told.join(second, "cand_id", "left")
    return out.select("cand_id", "year", F.coalesce("person_id", "_second").alias("person_id"), F.coalesce("how", F.when(F.col("_second").isNotNull(), F.lit("unique short name")), F.lit("no match")).alias("how"))


def assets_over_time(found: DataFrame, assets: DataFrame, prices: DataFrame, base: float) -> DataFrame:
    """(person_id, first_year, last_year, first, last, nominal_pct, real_pct): what a person declared in the first and the last candidacy, and the change in nominal money and in prices of index `base` (J26). assets(cand_id, value), prices(year, idx).

    Several candidacies of one year count once, by the smaller cand_id (U6); an unknown price gives no real change.
    """
    once = found.where("person_id is not null").withColumn("_n", F.row_number().over(Window.partitionBy("person_id", "year").orderBy("cand_id"))).where("_n = 1")
    sums = once.join(assets.groupBy("cand_id").agg(F.sum("value").alias("value")), "cand_id").join(prices, "year", "left")
    real = F.try_divide(F.col("value").cast("double") * base, F.col("idx"))
    ends = sums.groupBy("person_id").agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.min_by("value", "year").alias("first"), F.max_by("value", "year").alias("last"), F.min_by(real, "year").alias("_r0"), F.max_by(real, "year").alias("_r1"))

    def pct(a, b):
        """Rounded, with its sign: a loss too small to show is -0.0, as in SQL."""
        change = F.try_divide((b - a) * 100, a)
        return F.signum(change) * F.abs(F.bround(change, 1))

    return ends.select("person_id", "first_year", "last_year", "first", "last", pct(F.col("first").cast("double"), F.col("last").cast("double")).alias("nominal_pct"), pct(F.col("_r0"), F.col("_r1")).alias("real_pct"))


def donors_of(found: DataFrame, donors: DataFrame, payees: DataFrame, floor: float, k: int = 5) -> DataFrame:
    """(person_id, donors, top_share, donor_payees): named donors, the part of the k largest in all money (A12), and donors whom the person's money pays later.

    donors(cand_id, donor, kind, value): individuals under the floor are never named (P7), but their money counts in the total. payees(person_id, payee).
    """
    given = donors.join(found.where("person_id is not null").select("cand_id", "person_id"), "cand_id").groupBy("person_id", "donor", "kind").agg(F.sum("value").alias("value"))
    share = SEL.split_concentration(given, ["person_id"], "donor", "value", k).select("person_id", "top_share")
    named = P.named_only(given, "kind", "value", floor).groupBy("person_id").agg(F.count_distinct("donor").alias("donors"))
    both = J.overlap(given.select("person_id", "donor"), payees.select("person_id", F.col("payee").alias("donor")), ["person_id", "donor"]).groupBy("person_id").agg(F.count("*").alias("donor_payees"))
    return share.join(named, "person_id", "left").join(both, "person_id", "left").select("person_id", F.coalesce("donors", F.lit(0)).alias("donors"), "top_share", F.coalesce("donor_payees", F.lit(0)).alias("donor_payees"))
