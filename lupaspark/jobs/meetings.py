"""Meetings of office holders with outsiders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lupaspark.functions import columns as C
from lupaspark.operators import aggregates as A
from lupaspark.operators import filters as P
from lupaspark.operators import people as J
from lupaspark.operators import text as X
from lupaspark.session import grows


def encounters(events: DataFrame, holders: DataFrame, siglas: list[str]) -> tuple[DataFrame, DataFrame]:
    """(event_id, person, entity_key, entity, class) of each outsider whom a holder met, and (reason, n) of the hosts that no holder is.

    events(event_id, host, organ, html), holders(left_id, name, organ, is_head). Hosts are found by aligned names (J15), outsiders below the line of private agents (X11); an entity that
    is the organ itself goes (P9); its key is the sigla or the name's core (X20), its spelling the commonest of the key (A36), its class the interest that the name shows (F32), 'none' without any.
    """
    # Names resolve once each, with their organ, however many events they have.
    asked = events.select(F.struct("host", "organ").alias("left_id"), F.col("host").alias("name"), "organ", F.lit(False).alias("is_head")).distinct()
    known = holders.select(F.col("left_id").alias("right_id"), "name", "organ", F.lit(None).cast("date").alias("ended"), F.col("is_head").alias("is_top"), F.lit(True).alias("titular"), F.lit(None).cast("date").alias("start"))
    found = events.select("event_id", F.struct("host", "organ").alias("left_id")).join(grows(J.aligned_person(asked, known)), "left_id")
    met = found.where("right_id is not null").select("event_id", F.col("right_id").alias("person"))
    # So do pages, which several events may share; they meet by their digest.
    page = F.sha2("html", 256)
    pages = events.groupBy(page.alias("event_id")).agg(F.first("html").alias("html"))
    outside = X.participants(pages).where("side = 'private' and entity is not null").select(F.col("event_id").alias("page"), "entity")
    rows = met.join(grows(events.select("event_id", "organ", page.alias("page"))), "event_id").join(grows(outside), "page")
    rows = P.external_only(rows, "entity", "organ").withColumn("entity_key", X.entity_key(F.col("entity")))
    spelled = A.preferred_spelling(rows, "entity_key", "entity").select("entity_key", F.col("entity").alias("_spelled"))
    out = rows.join(grows(spelled), "entity_key").withColumn("class", F.coalesce(C.interest_marker(F.col("_spelled"), siglas), F.lit("none")))
    return out.select("event_id", "person", "entity_key", F.col("_spelled").alias("entity"), "class"), found.where("right_id is null").groupBy("reason").agg(F.count("*").alias("n"))


def received(found: DataFrame) -> DataFrame:
    """(person, class, encounters, entities): who received whom, public bodies left out."""
    return found.where("class <> 'public'").groupBy("person", "class").agg(F.count_distinct("event_id", "entity_key").alias("encounters"), F.count_distinct("entity_key").alias("entities"))
