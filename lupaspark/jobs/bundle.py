"""The open-data bundle: its twelve tables, from the graph and its facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The bundle's tables and their columns, in order.
TABLES = {
    "nodes": "id string, type string, subtype string, sector string, ring int, name string, parent string, cite string, official_url string",
    "links": "from string, to string, type string, cite string",
    "people": "id string, name string, party string, uf string, posts string",
    "occupants": "post_id string, post string, person_id string, person string, role string, since date, entry string, appointed_by string, term_end date, acting boolean, source string",
    "changes": "date date, kind string, person string, post_id string, post string, acting boolean, source string",
    "inaction": "kind string, pending long, overdue long, oldest_due date",
    "topics": "topic string, state string, days_still int",
    "revenue": "year int, value decimal(38,4), real double",
    "amendments": "id string, name string, year int, committed decimal(38,4), paid decimal(38,4)",
    "offices": "id string, name string, house string, staff long, payroll decimal(38,4), cost double",
    "assets": "id string, name string, first_year int, last_year int, first decimal(38,4), last decimal(38,4), nominal_pct double, real_pct double",
    "travel": "id string, name string, trips long, total decimal(38,4), abroad long",
}


def shaped(df: DataFrame, columns: str) -> DataFrame:
    """df's columns in the order and types asked for; those that it lacks are null, further ones go."""
    fields = [f.rsplit(" ", 1) for f in columns.split(", ")]
    have = set(df.columns)
    return df.select(*[(F.col(f"`{n}`") if n in have else F.lit(None)).cast(kind).alias(n) for n, kind in fields])


def with_names(facts: DataFrame, people: DataFrame) -> DataFrame:
    """Facts of people(id, ...) with their names; those of nobody known go."""
    return facts.join(people.select("id", "name"), "id")


def tables(parts: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The twelve tables by name. parts holds a frame for each that is known, under the table's name; the others are empty.

    People get their posts, each once, in the order of seats, from the occupants; facts by person get the person's name. Occupants(post_id, post, person_id, seat, ...) get the person's name.
    """
    spark = next(iter(parts.values())).sparkSession
    parts = dict(parts)
    people = parts.get("people")
    if people is not None:
        for name in ("amendments", "offices", "assets", "travel"):
            if name in parts:
                parts[name] = with_names(parts[name].drop("name"), people)
        if "occupants" in parts:
            seats = parts["occupants"]
            held = seats.where("person_id is not null").groupBy(F.col("person_id").alias("id")).agg(F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("seat", "post"))), lambda x: x["post"])), " | ").alias("posts"))
            parts["people"] = people.drop("posts").join(held, "id", "left")
            parts["occupants"] = seats.drop("person").join(people.select(F.col("id").alias("person_id"), F.col("name").alias("person")), "person_id", "left")
    return {name: shaped(parts[name], columns) if name in parts else spark.createDataFrame([], columns) for name, columns in TABLES.items()}
