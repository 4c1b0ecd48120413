"""The registry of queries: each applies an operator to the given tables, beside the SQL that it must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lupaspark.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
AS_OF = "2024-01-31"
ORDERS_AS_OF = "2001-08-01"


class Tables:
    """The given tables and the domain tables that they stand for."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    def spending(self) -> DataFrame:
        """Money facts: org, action, kind, dest, day, month, year, committed, paid."""
        price, cut = F.col("l_extendedprice").cast("decimal(18,2)"), F.col("l_discount").cast("decimal(4,2)")
        day = F.to_date("l_shipdate")
        return self.lineitem.select(
            F.col("l_suppkey").alias("org"), F.col("l_partkey").alias("action"), F.col("l_returnflag").alias("kind"), F.col("l_linestatus").alias("dest"), day.alias("day"), F.trunc(day, "month").alias("month"), F.year(day).alias("year"), price.alias("committed"), (price * (1 - cut)).alias("paid"), F.col("l_quantity").alias("quantity"), F.col("l_orderkey").alias("contract")
        )

    def programs(self) -> DataFrame:
        """The same with the program, which is the part's brand."""
        return self.spending().join(self.part.select(F.col("p_partkey").alias("action"), F.col("p_brand").alias("program")), "action")

    def contracts(self) -> DataFrame:
        """contract, firm, buyer, signed, value, status, decision."""
        buyer = self.customer.select(F.col("c_custkey").alias("supplier"), F.col("c_nationkey").cast("long").alias("buyer"))
        o = self.orders.select(F.col("o_orderkey").alias("contract"), F.col("o_custkey").alias("supplier"), F.to_date("o_orderdate").alias("signed"), F.col("o_totalprice").cast("decimal(18,2)").alias("value"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("decision"))
        return o.join(buyer, "supplier").withColumn("firm_key", F.col("supplier") % 150)

    def sanctions(self) -> DataFrame:
        """One for each error event: sanction_id, firm_key, valid_from, valid_to, category, reach, body_key."""
        k = F.from_json("props", "k int")["k"]
        e = self.events.where("event_type = 'error'").select("event_id", "user_id", "value", k.alias("k"))
        start = F.date_add(F.lit("1995-01-01").cast("date"), (F.col("event_id") % 2400).cast("int"))
        end = F.when(F.col("k") % 10 != 0, F.date_add(start, (30 + F.floor("value")).cast("int")))
        pick = lambda *v: F.element_at(F.array(*[F.lit(x) for x in v]), (F.col("k") % len(v) + 1).cast("int"))
        return e.select(F.col("event_id").alias("sanction_id"), F.col("user_id").alias("firm_key"), start.alias("valid_from"), end.alias("valid_to"), pick("impedimento", "suspensao", "inidoneidade", "multa").alias("category"), pick("all", "sanctioning_body", None).alias("reach"), (F.col("event_id") % 25).alias("body_key"))

    def organs(self) -> DataFrame:
        """The organ tree: suppliers below nations below regions below one root; id, parent, name, kind, ring."""
        root = self.region.select(F.lit("root").alias("id"), F.lit(None).cast("string").alias("parent"), F.lit("root").alias("name"), F.lit("root").alias("kind"), F.lit(0).alias("ring")).distinct()
        r = self.region.select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit("root").alias("parent"), F.col("r_name").alias("name"), F.lit("region").alias("kind"), F.lit(0).alias("ring"))
        n = self.nation.select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.col("n_name").alias("name"), F.lit("nation").alias("kind"), F.lit(0).alias("ring"))
        s = self.supplier.select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.concat(F.lit("n"), "s_nationkey").alias("parent"), F.col("s_name").alias("name"), F.lit("supplier").alias("kind"), F.lit(1).alias("ring"))
        return root.unionByName(r).unionByName(n).unionByName(s)

    def log(self) -> DataFrame:
        """Appointments and dismissals: unit, person, verb, day."""
        return self.events.where("event_type in ('signup', 'error')").select((F.col("user_id") % 40).alias("unit"), F.col("user_id").alias("person"), F.col("event_type").alias("verb"), F.to_date("ts").alias("day"), "event_id")

    def people(self) -> DataFrame:
        """person_id, name, house, uf, balance."""
        return self.customer.select(F.col("c_custkey").alias("person_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("house"), F.col("c_nationkey").alias("uf"), F.col("c_acctbal").cast("decimal(18,2)").alias("balance"))


SPENDING = """(SELECT l_suppkey AS org, l_partkey AS action, l_returnflag AS kind, l_linestatus AS dest, CAST(l_shipdate AS DATE) AS day, CAST(date_trunc('month', l_shipdate) AS DATE) AS month, CAST(year(l_shipdate) AS INTEGER) AS year,
 CAST(l_extendedprice AS DECIMAL(18,2)) AS committed, CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS paid, l_quantity AS quantity, l_orderkey AS contract FROM lineitem)"""
PROGRAMS = f"(SELECT s.*, p_brand AS program FROM {SPENDING} s JOIN part ON p_partkey = action)"
CONTRACTS = """(SELECT o_orderkey AS contract, o_custkey AS supplier, CAST(o_orderdate AS DATE) AS signed, CAST(o_totalprice AS DECIMAL(18,2)) AS value, o_orderstatus AS status, o_orderpriority AS decision, CAST(c_nationkey AS BIGINT) AS buyer, o_custkey % 150 AS firm_key FROM orders JOIN customer ON c_custkey = o_custkey)"""
SANCTIONS = """(SELECT event_id AS sanction_id, user_id AS firm_key, DATE '1995-01-01' + CAST(event_id % 2400 AS INTEGER) AS valid_from,
 CASE WHEN k % 10 = 0 THEN NULL ELSE DATE '1995-01-01' + CAST(event_id % 2400 AS INTEGER) + CAST(30 + floor(value) AS INTEGER) END AS valid_to,
 CASE k % 4 WHEN 0 THEN 'impedimento' WHEN 1 THEN 'suspensao' WHEN 2 THEN 'inidoneidade' ELSE 'multa' END AS category,
 CASE k % 3 WHEN 0 THEN 'all' WHEN 1 THEN 'sanctioning_body' ELSE NULL END AS reach, event_id % 25 AS body_key
 FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE event_type = 'error'))"""
ORGANS = """(SELECT DISTINCT 'root' AS id, NULL AS parent, 'root' AS name, 'root' AS kind, 0 AS ring FROM region UNION ALL SELECT 'r' || r_regionkey, 'root', r_name, 'region', 0 FROM region
 UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name, 'nation', 0 FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, s_name, 'supplier', 1 FROM supplier)"""
LOG = "(SELECT user_id % 40 AS unit, user_id AS person, event_type AS verb, CAST(ts AS DATE) AS day, event_id FROM events WHERE event_type IN ('signup', 'error'))"
PEOPLE = "(SELECT c_custkey AS person_id, c_name AS name, c_mktsegment AS house, c_nationkey AS uf, CAST(c_acctbal AS DECIMAL(18,2)) AS balance FROM customer)"


def query(sql: str | None = None):
    """Registers a function of Tables under its name, with its SQL."""

    def register(f: Callable[[Tables], DataFrame]):
        name = f.__name__.rstrip("_")
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[name] = sql
        return f

    return register


def money(*cols: str) -> list:
    """Sums of decimals leave as doubles, which both engines print alike."""
    return [F.col(c).cast("double").alias(c) for c in cols]
