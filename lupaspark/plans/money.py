"""Queries on money: aggregates, rankings, comparisons (A, W1-W6, T, P, J1-J8, J23-J37)."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from lupaspark.functions import columns as C
from lupaspark.operators import aggregates as A
from lupaspark.operators import filters as P
from lupaspark.operators import joins as J
from lupaspark.operators import ranking as W
from lupaspark.operators import resolve as R
from lupaspark.operators import temporal as TM
from lupaspark.plans.registry import CONTRACTS, ORDERS_AS_OF, PEOPLE, PROGRAMS, SANCTIONS, SPENDING, money, query


@query(f"""SELECT contract, sanction_id, signed, valid_from, valid_to, category, reach IS NULL AS reach_unknown, CAST(value AS DOUBLE) AS value FROM {CONTRACTS} c JOIN {SANCTIONS} s USING (firm_key)
 WHERE signed >= valid_from AND (valid_to IS NULL OR signed <= valid_to) AND category <> 'multa' AND (reach IS DISTINCT FROM 'sanctioning_body' OR body_key = buyer)""")
def j23_contracts_under_sanction(t):
    reach = C.reaches_buyer(F.col("reach"), F.col("body_key"), F.col("buyer"))
    ok = C.bars_contracting(F.col("category")) & F.coalesce(reach, F.lit(True))
    return TM.in_force_join(t.contracts(), t.sanctions(), ["firm_key"], "signed", extra=ok).select("contract", "sanction_id", "signed", "valid_from", "valid_to", "category", F.col("reach").isNull().alias("reach_unknown"), *money("value"))


@query(f"SELECT org, year, CAST(sum(committed) AS DOUBLE) AS committed, CAST(sum(paid) AS DOUBLE) AS paid FROM {SPENDING} s GROUP BY ALL")
def a1_sum_by_org_year(t):
    return A.sum_by(t.spending(), ["org", "year"], ["committed", "paid"]).select("org", "year", *money("committed", "paid"))


@query(f"""SELECT concat_ws(',', CASE WHEN grouping(kind) = 0 THEN 'kind' END, CASE WHEN grouping(dest) = 0 THEN 'dest' END, CASE WHEN grouping(org) = 0 THEN 'org' END) AS grouping, kind, dest, org, CAST(sum(paid) AS DOUBLE) AS paid
 FROM {SPENDING} s GROUP BY GROUPING SETS ((kind, dest), (dest), (org), (org, kind), ())""")
def a2_multi_sum(t):
    return A.multi_sum(t.spending(), [["kind", "dest"], ["dest"], ["org"], ["org", "kind"], []], ["paid"]).select("grouping", "kind", "dest", "org", *money("paid"))


@query(f"SELECT month, kind, CASE WHEN grouping(d) = 0 THEN d END AS day, CAST(sum(paid) AS DOUBLE) AS value, max(day) AS last_day FROM (SELECT *, day AS d FROM {SPENDING} s) GROUP BY GROUPING SETS ((month), (kind), (d))")
def a3_revenue_rollup(t):
    return A.revenue_rollup(t.spending(), "kind", "day", "paid").select("month", "kind", "day", *money("value"), "last_day")


@query(f"SELECT org, count(DISTINCT action) AS n_distinct FROM {SPENDING} s GROUP BY org")
def a4_distinct_actions(t):
    return A.distinct_by(t.spending(), ["org"], "action")


@query(f"SELECT buyer, count(*) FILTER (status = 'F') AS closed, count(*) FILTER (status = 'O') AS open, count(*) FILTER (decision LIKE '1%') AS urgent FROM {CONTRACTS} c GROUP BY buyer")
def a5_count_where(t):
    return A.count_where(t.contracts(), ["buyer"], {"closed": F.col("status") == "F", "open": F.col("status") == "O", "urgent": F.col("decision").startswith("1")})


@query(f"SELECT buyer, decision, count(*) AS n FROM {CONTRACTS} c GROUP BY ALL")
def a6_histogram(t):
    return A.histogram(t.contracts(), ["buyer"], "decision")


@query(f"SELECT supplier, den, num, CASE WHEN den >= 20 THEN round_even(num * 100.0 / den, 1) END AS rate FROM (SELECT supplier, count(*) AS den, count(*) FILTER (status = 'F') AS num FROM {CONTRACTS} c GROUP BY supplier)")
def a7_rate(t):
    return A.rate(t.contracts().groupBy("supplier").agg(F.count("*").alias("den"), F.count_if(F.col("status") == "F").alias("num")), "num", "den")


@query(f"SELECT buyer, CAST(sum(num) AS BIGINT) AS num, CAST(sum(den) AS BIGINT) AS den, round_even(sum(num) * 100.0 / sum(den), 1) AS rate FROM (SELECT buyer, supplier, count(*) AS den, count(*) FILTER (status = 'F') AS num FROM {CONTRACTS} c GROUP BY ALL) GROUP BY buyer")
def a8_rerate(t):
    return A.rerate(t.contracts().groupBy("buyer", "supplier").agg(F.count("*").alias("den"), F.count_if(F.col("status") == "F").alias("num")), ["buyer"], "num", "den")


@query(f"SELECT house, median(nullif(CAST(balance AS DOUBLE), 0)) AS median, count(nullif(balance, 0)) AS n FROM {PEOPLE} p GROUP BY house")
def a9_median(t):
    return A.median_by(t.people(), ["house"], "balance", drop_zero=True)


@query(f"""SELECT supplier, n, CASE WHEN n >= 5 THEN m END AS median, CASE WHEN n BETWEEN 3 AND 4 THEN a END AS low, CASE WHEN n BETWEEN 3 AND 4 THEN z END AS high, CASE WHEN n < 3 THEN 'sample too small' END AS reason
 FROM (SELECT supplier, count(value) AS n, median(CAST(value AS DOUBLE)) AS m, min(CAST(value AS DOUBLE)) AS a, max(CAST(value AS DOUBLE)) AS z FROM {CONTRACTS} c WHERE year(signed) = 1996 GROUP BY supplier)""")
def a10_sampled_value(t):
    return A.sampled_value(t.contracts().where("year(signed) = 1996"), ["supplier"], "value")


@query(f"SELECT org, kind, CAST(v AS DOUBLE) AS v, round_even(CAST(v AS DOUBLE) / CAST(sum(v) OVER (PARTITION BY org) AS DOUBLE), 4) AS share FROM (SELECT org, kind, sum(paid) AS v FROM {SPENDING} s GROUP BY ALL)")
def a11_share(t):
    return A.share(t.spending().groupBy("org", "kind").agg(F.sum("paid").alias("v")), ["org"], "v").select("org", "kind", *money("v"), "share")


@query(f"""SELECT org, count(*) AS items, round_even(CAST(sum(v) FILTER (r <= 5) AS DOUBLE) / CAST(sum(v) AS DOUBLE), 4) AS top_share FROM (SELECT org, action, v, row_number() OVER (PARTITION BY org ORDER BY v DESC, action) AS r FROM (SELECT org, action, sum(paid) AS v FROM {SPENDING} s GROUP BY ALL)) GROUP BY org""")
def a12_concentration(t):
    return A.concentration(t.spending(), ["org"], "action", "paid", 5)


@query(f"""SELECT buyer, CAST(v AS DOUBLE) AS value, population, round_even(CAST(v AS DOUBLE) / population, 4) AS per_capita FROM (SELECT buyer, sum(value) AS v FROM {CONTRACTS} c GROUP BY buyer) LEFT JOIN (SELECT CAST(n_nationkey AS BIGINT) AS buyer, CAST((n_nationkey + 1) * 1000 AS BIGINT) AS population FROM nation) USING (buyer)""")
def a13_per_capita(t):
    pop = t.nation.select(F.col("n_nationkey").cast("long").alias("buyer"), ((F.col("n_nationkey") + 1) * 1000).cast("long").alias("population"))
    return A.per_capita(t.contracts().groupBy("buyer").agg(F.sum("value").alias("value")), pop, "buyer", "value").select("buyer", *money("value"), "population", "per_capita")


@query(f"SELECT org, CAST(b AS DOUBLE) AS before, CAST(a AS DOUBLE) AS after, round_even(CAST(a AS DOUBLE) / CAST(b AS DOUBLE), 4) AS ratio FROM (SELECT org, sum(paid) FILTER (year = 1996) AS b, sum(paid) FILTER (year = 1997) AS a FROM {SPENDING} s WHERE year IN (1996, 1997) GROUP BY org)")
def a14_yoy(t):
    return A.yoy(t.spending(), ["org"], "year", "paid", 1996, 1997).select("org", *money("before", "after"), "ratio")


@query(f"SELECT year, CAST(sum(paid) AS DOUBLE) AS value FROM {SPENDING} s WHERE year <= 1998 AND (month(day) < 6 OR (month(day) = 6 AND day(day) <= 17)) GROUP BY year")
def a15_same_period(t):
    return A.same_period(t.spending(), "day", "paid", "1998-06-17").select("year", *money("value"))


@query(f"""SELECT month, CAST(v AS DOUBLE) AS value, round_even(coalesce(CAST(v AS DOUBLE) * 250.0 / idx, CAST(v AS DOUBLE)), 2) AS real FROM (SELECT month, sum(paid) AS v FROM {SPENDING} s GROUP BY month)
 LEFT JOIN (SELECT DISTINCT month, CASE WHEN month >= DATE '1994-01-01' THEN 100.0 + (year(month) - 1992) * 12 + month(month) END AS idx FROM {SPENDING} s) USING (month)""")
def a16_real_terms(t):
    idx = F.when(F.col("month") >= F.lit("1994-01-01").cast("date"), 100.0 + (F.year("month") - 1992) * 12 + F.month("month"))
    return A.real_terms(t.spending().groupBy("month").agg(F.sum("paid").alias("value")).withColumn("idx", idx), "idx", "value", 250.0).select("month", *money("value"), "real")


@query(f"SELECT max(month) AS last_month, CAST(sum(v) AS DOUBLE) AS value, round_even(CAST(sum(v) AS DOUBLE) / sum(day(last_day(month)) * 86400), 4) AS per_second FROM (SELECT month, sum(paid) AS v FROM {SPENDING} s GROUP BY month ORDER BY month DESC LIMIT 3)")
def a17_run_rate(t):
    return A.run_rate(t.spending().groupBy("month").agg(F.sum("paid").alias("value")), "month", "value").select("last_month", *money("value"), "per_second")


@query("""SELECT person, coalesce(present, 0) AS present, rolls, round_even(coalesce(present, 0) * 100.0 / rolls, 1) AS attendance FROM (SELECT DISTINCT user_id AS person FROM events)
 LEFT JOIN (SELECT user_id AS person, count(DISTINCT CAST(ts AS DATE)) AS present FROM events WHERE event_type = 'click' GROUP BY 1) USING (person) CROSS JOIN (SELECT count(DISTINCT CAST(ts AS DATE)) AS rolls FROM events)""")
def a18_attendance(t):
    e = t.events.select(F.col("user_id").alias("person"), F.to_date("ts").alias("roll"), "event_type")
    return A.attendance(e.where("event_type = 'click'"), e, e, "person", "roll")


@query(f"""WITH k AS (SELECT org, kind, sum(paid) AS v FROM {SPENDING} s GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY org ORDER BY v DESC, kind) AS n FROM k)
 SELECT org, CAST(total AS DOUBLE) AS total, months, round_even(CAST(total AS DOUBLE) / months, 2) AS monthly, top_kinds FROM (SELECT org, sum(paid) AS total, count(DISTINCT month) AS months FROM {SPENDING} s GROUP BY org) JOIN (SELECT org, string_agg(kind, ',' ORDER BY n) AS top_kinds FROM r WHERE n <= 3 GROUP BY org) USING (org)""")
def a19_quota(t):
    return A.quota(t.spending(), "org", "month", "kind", "paid").select("org", *money("total"), "months", "monthly", "top_kinds")


@query(f"""SELECT supplier, CAST(staff AS DOUBLE) AS staff, CAST(quota AS DOUBLE) AS quota, round_even((1000.0 + CAST(staff AS DOUBLE)) * 0.5 * 12 + coalesce(CAST(quota AS DOUBLE), 0), 2) AS cost FROM (SELECT c_custkey AS supplier, CAST(c_acctbal AS DECIMAL(18,2)) AS staff FROM customer) LEFT JOIN (SELECT supplier, sum(value) AS quota FROM {CONTRACTS} c GROUP BY supplier) USING (supplier)""")
def a20_mandate_cost(t):
    offices = t.customer.select(F.col("c_custkey").alias("supplier"), F.col("c_acctbal").cast("decimal(18,2)").alias("staff"))
    return A.mandate_cost(offices, t.contracts().groupBy("supplier").agg(F.sum("value").alias("total")), 1000.0, "supplier", 0.5).select("supplier", *money("staff", "quota"), "cost")


def _seat_tables(t):
    posts = t.supplier.select(F.col("s_suppkey").alias("post"), F.col("s_nationkey").alias("family"), (F.col("s_suppkey") % 5 + 1).alias("seats"))
    rules = t.nation.where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("family"), F.lit("A").alias("block"), (F.col("n_nationkey") * 100 + 1000).alias("monthly"))
    factors = t.lineitem.select(F.col("l_returnflag").alias("block")).distinct().select("block", F.lit(12).alias("times"), F.when(F.col("block") == "N", 50000).alias("cap"), F.when(F.col("block") == "R", 4).alias("amortise_years"))
    facts = t.lineitem.select(F.col("l_suppkey").alias("post"), F.col("l_returnflag").alias("block"), F.col("l_extendedprice").alias("value"))
    return posts, rules, factors, facts


SEATS = """WITH posts AS (SELECT s_suppkey AS post, s_nationkey AS family, s_suppkey % 5 + 1 AS seats FROM supplier), rules AS (SELECT n_nationkey AS family, 'A' AS block, n_nationkey * 100 + 1000 AS monthly FROM nation WHERE n_nationkey % 2 = 0),
 factors AS (SELECT DISTINCT l_returnflag AS block, 12 AS times, CASE WHEN l_returnflag = 'N' THEN 50000.0 END AS cap, CASE WHEN l_returnflag = 'R' THEN 4 END AS years FROM lineitem),
 m AS (SELECT l_suppkey AS post, l_returnflag AS block, count(*) AS n, median(l_extendedprice) AS med, min(l_extendedprice) AS a, max(l_extendedprice) AS z FROM lineitem GROUP BY ALL),
 law AS (SELECT post, block, 'law' AS basis, CAST(monthly AS DOUBLE) AS v, NULL AS lo, NULL AS hi FROM posts JOIN rules USING (family)),
 b AS (SELECT * FROM law UNION ALL SELECT post, block, 'measured', CASE WHEN n >= 5 THEN med ELSE (a + z) / 2 END, CASE WHEN n < 5 THEN a END, CASE WHEN n < 5 THEN z END FROM m WHERE n >= 3 AND (post, block) NOT IN (SELECT (post, block) FROM law)),
 blocks AS (SELECT post, block, basis, round_even(least(v, coalesce(cap, v)) * times / coalesce(years, 1), 3) AS annual, round_even(least(lo, coalesce(cap, lo)) * times / coalesce(years, 1), 3) AS low, round_even(least(hi, coalesce(cap, hi)) * times / coalesce(years, 1), 3) AS high, lo, hi FROM b JOIN factors USING (block))"""


@query(SEATS + " SELECT post, block, basis, CAST(annual AS DOUBLE) AS annual, CASE WHEN lo IS NOT NULL THEN CAST(low AS DOUBLE) END AS low, CASE WHEN hi IS NOT NULL THEN CAST(high AS DOUBLE) END AS high FROM blocks")
def a21_seat_cost(t):
    return A.seat_cost(*_seat_tables(t))


@query(SEATS + " SELECT family, CAST(round_even(sum(annual * seats), 3) AS DOUBLE) AS total, CAST(sum(seats) AS BIGINT) AS seats, CAST(round_even(round_even(sum(annual * seats), 3) / sum(seats), 3) AS DOUBLE) AS per_seat FROM posts JOIN (SELECT post, sum(annual) AS annual FROM blocks GROUP BY post) USING (post) GROUP BY family")
def a22_family_cost(t):
    posts, *rest = _seat_tables(t)
    return A.family_cost(A.seat_cost(posts, *rest), posts)


@query(f"SELECT house, count(*) AS members, CAST(sum(balance) AS DOUBLE) AS balance_sum, median(CAST(balance AS DOUBLE)) AS balance_median FROM {PEOPLE} p GROUP BY ROLLUP (house)")
def a23_house_rollup(t):
    return A.house_rollup(t.people(), "house", ["balance"]).select("house", "members", *money("balance_sum"), "balance_median")


@query("SELECT s_nationkey AS organ, c_mktsegment AS party, count(DISTINCT c_custkey) AS people FROM supplier JOIN customer ON c_custkey = s_suppkey GROUP BY ALL")
def a24_party_history(t):
    return A.party_history(t.supplier.select(F.col("s_nationkey").alias("organ"), F.col("s_suppkey").alias("person")), t.customer.select(F.col("c_custkey").alias("person"), F.col("c_mktsegment").alias("party")))


@query(f"SELECT supplier, count(*) AS n, CAST(sum(value) AS DOUBLE) AS value, count(DISTINCT decision) AS organs FROM {CONTRACTS} c GROUP BY supplier")
def a25_supplier_rollup(t):
    return A.supplier_rollup(t.contracts(), "supplier", "decision", "value").select("supplier", "n", *money("value"), "organs")


@query("SELECT role, count(*) AS encounters, count(DISTINCT conv_id) AS entities FROM conversations GROUP BY role")
def a26_class_volume(t):
    return A.class_volume(t.conversations, "role", "conv_id")


@query("SELECT conv_id, count(*) AS encounters, count(DISTINCT role) AS entities FROM conversations GROUP BY conv_id")
def a27_who_received(t):
    return A.who_received(t.conversations, "conv_id", "role")


@query(f"SELECT firm_key, count(DISTINCT body_key) AS holders, median(CAST(valid_to - valid_from AS DOUBLE)) AS median_days, count(valid_to) AS closed FROM {SANCTIONS} s GROUP BY firm_key")
def a28_tenure_stats(t):
    return A.tenure_stats(t.sanctions(), "firm_key", "body_key", "valid_from", "valid_to")


@query("""WITH n AS (SELECT s_nationkey % 3 AS sector, s_suppkey % 2 AS ring, s_suppkey % 5 + 1 AS seats, s_suppkey % 3 AS filled FROM supplier)
 SELECT dimension, value, count(*) AS nodes, CAST(sum(seats) AS BIGINT) AS seats, CAST(sum(filled) AS BIGINT) AS filled, CAST(sum(seats) - sum(filled) AS BIGINT) AS vacant FROM (SELECT 'all' AS dimension, '' AS value, seats, filled FROM n UNION ALL SELECT 'sector', CAST(sector AS VARCHAR), seats, filled FROM n UNION ALL SELECT 'ring', CAST(ring AS VARCHAR), seats, filled FROM n) GROUP BY ALL""")
def a29_graph_stats(t):
    n = t.supplier.select((F.col("s_nationkey") % 3).alias("sector"), (F.col("s_suppkey") % 2).alias("ring"), (F.col("s_suppkey") % 5 + 1).alias("seats"), (F.col("s_suppkey") % 3).alias("filled"))
    return A.graph_stats(n, ["sector", "ring"])


@query("""WITH b AS (SELECT c_mktsegment AS sector, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS x, CASE WHEN c_custkey % 3 = 0 THEN c_custkey END AS y FROM customer), h AS (SELECT sector, (x IS NOT NULL)::INT + (y IS NOT NULL)::INT AS h FROM b)
 SELECT sector, count(*) AS organs, round_even(avg(h), 4) AS mean_blocks, count(*) FILTER (h = 0) AS "none", round_even(count(*) FILTER (h = 0) * 100.0 / count(*), 1) AS none_pct FROM h GROUP BY sector""")
def a30_transparency(t):
    b = t.customer.select(F.col("c_mktsegment").alias("sector"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("x"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey")).alias("y"))
    return A.transparency(b, ["sector"], ["x", "y"])


@query(f"SELECT count(*) AS total, count(DISTINCT firm_key) AS companies, count(*) FILTER (valid_from <= DATE '{ORDERS_AS_OF}' AND (valid_to IS NULL OR valid_to >= DATE '{ORDERS_AS_OF}')) AS in_force, min(valid_from) AS earliest FROM {SANCTIONS} s")
def a32_penalties(t):
    return A.penalties(t.sanctions(), "firm_key", "valid_from", "valid_to", ORDERS_AS_OF)


@query(f"SELECT count(*) AS pending, count(*) FILTER (due < DATE '1998-01-01') AS overdue, min(due) AS oldest_due, count(*) FILTER (due - DATE '1998-01-01' BETWEEN 0 AND 30) AS expiring, CAST(sum(value) FILTER (due < DATE '1998-01-01') AS DOUBLE) AS at_risk FROM (SELECT signed + 90 AS due, value FROM {CONTRACTS} c WHERE status = 'O')")
def a33_backlog(t):
    return A.backlog(t.contracts().where("status = 'O'").withColumn("due", F.date_add("signed", 90)), "due", "value", "1998-01-01").select("pending", "overdue", "oldest_due", "expiring", *money("at_risk"))


@query("SELECT l_suppkey AS person, count(DISTINCT l_orderkey) AS bills, count(*) FILTER (l_linenumber = 1) AS first_author, count(DISTINCT l_orderkey) FILTER (l_linestatus = 'F') AS became_law, count(DISTINCT l_returnflag) AS classes FROM lineitem GROUP BY 1")
def a34_authorship(t):
    a = t.lineitem.select(F.col("l_suppkey").alias("person"), F.col("l_orderkey").alias("bill"), F.col("l_linenumber").alias("signature"), F.col("l_returnflag").alias("cls"), (F.col("l_linestatus") == "F").alias("law"))
    return A.authorship(a, "person", "bill", "signature", "cls", "law")


@query(f"SELECT count(DISTINCT contract) AS n_distinct FROM {SPENDING} s")
def a35_distinct_total(t):
    return A.distinct_by(t.spending(), [], "contract")


@query("SELECT p_brand, p_name, n FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_name) AS r FROM (SELECT p_brand, p_name, count(*) AS n FROM part GROUP BY ALL)) WHERE r = 1")
def a36_preferred_spelling(t):
    return A.preferred_spelling(t.part, "p_brand", "p_name")


@query(f"""WITH s AS (SELECT uf, count(DISTINCT person_id) AS delegation FROM {PEOPLE} p GROUP BY uf), a AS (SELECT CAST(buyer AS INTEGER) AS uf, sum(value) AS amended FROM {CONTRACTS} c WHERE status = 'F' GROUP BY 1), x AS (SELECT CAST(buyer AS INTEGER) AS uf, sum(value) AS transferred FROM {CONTRACTS} c WHERE status = 'O' GROUP BY 1),
 j AS (SELECT * FROM s LEFT JOIN a USING (uf) LEFT JOIN x USING (uf)) SELECT uf, delegation, CAST(amended AS DOUBLE) AS amended, CAST(transferred AS DOUBLE) AS transferred, (SELECT median(CAST(amended AS DOUBLE)) FROM j) AS amended_median, (SELECT median(CAST(transferred AS DOUBLE)) FROM j) AS transferred_median FROM j""")
def a37_state_bundle(t):
    c = t.contracts().withColumn("uf", F.col("buyer").cast("int"))
    out = A.state_bundle(t.people(), c.where("status = 'F'"), c.where("status = 'O'"))
    return out.select("uf", "delegation", *money("amended", "transferred"), "amended_median", "transferred_median")


@query("SELECT l_suppkey AS person, CAST(sum(g) AS DOUBLE) AS gross, CAST(sum(abs(c)) AS DOUBLE) AS cut, CAST(sum(i) AS DOUBLE) AS indemnity, CAST(sum(g) - sum(abs(c)) + sum(i) AS DOUBLE) AS net FROM (SELECT l_suppkey, CAST(l_extendedprice AS DECIMAL(18,2)) AS g, -CAST(l_tax AS DECIMAL(4,2)) AS c, CAST(l_quantity AS DECIMAL(18,2)) AS i FROM lineitem) GROUP BY 1")
def a38_payroll_components(t):
    d = t.lineitem.select(F.col("l_suppkey").alias("person"), F.col("l_extendedprice").cast("decimal(18,2)").alias("g"), (-F.col("l_tax").cast("decimal(4,2)")).alias("c"), F.col("l_quantity").cast("decimal(18,2)").alias("i"))
    return A.payroll_components(d, "person", "g", "c", "i").select("person", *money("gross", "cut", "indemnity", "net"))


@query(f"SELECT status, decision, count(*) AS n, round_even(count(*) * 100.0 / (SELECT count(*) FROM {CONTRACTS} c), 1) AS pct FROM {CONTRACTS} c GROUP BY ALL")
def a39_match_report(t):
    return A.match_report(t.contracts(), ["status", "decision"])


@query(f"SELECT house, count(*) AS n FROM {PEOPLE} p GROUP BY house ORDER BY n DESC, house LIMIT 3")
def a40_party_mix(t):
    return A.party_mix(t.people(), "house", 3)


@query("SELECT count(*) FILTER (o_orderstatus = 'O') AS free, count(*) FILTER (o_orderstatus = 'F' AND CAST(o_orderdate AS DATE) > DATE '1996-01-01') AS fixed_beyond, count(*) FILTER (o_orderstatus = 'P') AS life FROM orders")
def a41_transition_counts(t):
    entry = F.when(F.col("o_orderstatus") == "O", "free").when(F.col("o_orderstatus") == "F", "mandate").otherwise("life")
    return A.transition_counts(t.orders.select(entry.alias("entry"), F.to_date("o_orderdate").alias("until")), "entry", "until", "1996-01-01")


@query(f"SELECT org, action, CAST(v AS DOUBLE) AS v, CAST(rank AS INTEGER) AS rank FROM (SELECT org, action, v, row_number() OVER (PARTITION BY org ORDER BY v DESC, action) AS rank FROM (SELECT org, action, sum(paid) AS v FROM {SPENDING} s GROUP BY ALL)) WHERE rank <= 10")
def w1_top_k(t):
    return W.top_k(t.spending().groupBy("org", "action").agg(F.sum("paid").alias("v")), ["org"], [F.desc("v"), F.asc("action")], 10).select("org", "action", *money("v"), "rank")


@query(f"""WITH k AS (SELECT org, program, paid, row_number() OVER (PARTITION BY org ORDER BY paid DESC, program) AS r FROM (SELECT org, program, sum(paid) AS paid FROM {PROGRAMS} p GROUP BY ALL))
 SELECT org, CASE WHEN r <= 3 THEN program ELSE 'others' END AS program, CAST(least(r, 4) AS INTEGER) AS rank, CAST(sum(paid) AS DOUBLE) AS paid, count(*) AS items FROM k GROUP BY ALL""")
def w2_top_k_rest(t):
    return W.top_k_rest(t.programs(), ["org"], "program", "paid", 3).select("org", "program", "rank", *money("paid"), "items")


@query(f"""WITH s AS (SELECT dest, program, action, sum(paid) AS paid FROM {PROGRAMS} p GROUP BY ALL), i AS (SELECT dest, program, sum(paid) AS item_value, row_number() OVER (PARTITION BY dest ORDER BY sum(paid) DESC, program) AS item_rank FROM s GROUP BY dest, program)
 SELECT dest, program, action, CAST(paid AS DOUBLE) AS paid, CAST(item_value AS DOUBLE) AS item_value, CAST(item_rank AS INTEGER) AS item_rank, CAST(rank AS INTEGER) AS rank FROM (SELECT s.*, item_value, item_rank, row_number() OVER (PARTITION BY s.dest, s.program ORDER BY paid DESC, action) AS rank FROM s JOIN i ON i.dest = s.dest AND i.program = s.program WHERE item_rank <= 5) WHERE rank <= 3""")
def w3_nested_top_k(t):
    return W.nested_top_k(t.programs(), ["dest"], "program", "action", "paid", 5, 3).select("dest", "program", "action", *money("paid", "item_value"), "item_rank", "rank")


@query(f"SELECT supplier, contract, signed, CAST(rank AS INTEGER) AS rank FROM (SELECT supplier, contract, signed, row_number() OVER (PARTITION BY supplier ORDER BY signed DESC, contract) AS rank FROM {CONTRACTS} c) WHERE rank <= 5")
def w4_newest(t):
    return W.newest(t.contracts(), ["supplier"], "signed", 5, "contract").select("supplier", "contract", "signed", "rank")


@query(f"SELECT supplier, contract, CAST(rank AS INTEGER) AS rank FROM (SELECT supplier, contract, row_number() OVER (PARTITION BY supplier ORDER BY CASE WHEN decision LIKE '1%' THEN 0 ELSE 1 END, signed DESC, contract) AS rank FROM {CONTRACTS} c) WHERE rank <= 4")
def w5_priority_newest(t):
    return W.priority_newest(t.contracts(), ["supplier"], F.when(F.col("decision").startswith("1"), 0).otherwise(1), "signed", "contract", 4).select("supplier", "contract", "rank")


@query("SELECT conv_id, role, CAST(CASE role WHEN 'system' THEN 1 WHEN 'assistant' THEN 2 ELSE 3 END AS INTEGER) AS role_rank FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY CASE role WHEN 'system' THEN 1 WHEN 'assistant' THEN 2 ELSE 3 END, role) AS n FROM conversations) WHERE n = 1")
def w6_role_dedupe(t):
    return W.role_dedupe(t.conversations.withColumn("who", F.lit(1)), ["conv_id"], "who", "role", {"system": 1, "assistant": 2}).select("conv_id", "role", "role_rank")


@query(f"SELECT person_id, median, round_even(CAST(balance AS DOUBLE) / median, 4) AS ratio, CASE WHEN balance > median THEN 'above' WHEN balance < median THEN 'below' ELSE 'at' END AS side FROM (SELECT person_id, CAST(balance AS DOUBLE) AS balance, house FROM {PEOPLE} p) JOIN (SELECT house, median(CAST(balance AS DOUBLE)) AS median FROM {PEOPLE} p GROUP BY house) USING (house)")
def w20_vs_median(t):
    return W.vs_median(t.people(), "house", "balance").select("person_id", "median", "ratio", "side")


@query(f"SELECT person_id, round_even(CAST(balance AS DOUBLE) / max(CAST(balance AS DOUBLE)) OVER (PARTITION BY house), 4) AS bar FROM {PEOPLE} p")
def w21_bar_scale(t):
    return W.bar_scale(t.people(), "balance", ["house"]).select("person_id", "bar")


@query(f"SELECT contract, CAST(value AS DOUBLE) AS value FROM {CONTRACTS} c ORDER BY c.value DESC, contract LIMIT 50")
def t1_global_top(t):
    return W.global_top(t.contracts(), [F.desc("value"), F.asc("contract")], 50).select("contract", *money("value"))


@query("SELECT c_custkey AS person, round_even(c_acctbal / nullif(c_nationkey, 0), 4) AS ratio FROM customer WHERE c_nationkey <> 0 ORDER BY 2 DESC, 1 LIMIT 25")
def t2_top_ratio(t):
    return W.top_ratio(t.customer.select(F.col("c_custkey").alias("person"), "c_acctbal", "c_nationkey"), "c_acctbal", "c_nationkey", "person", 25).select("person", "ratio")


@query(f"SELECT contract, CAST(r AS INTEGER) AS state_rank, CAST(row_number() OVER (PARTITION BY r ORDER BY signed DESC NULLS LAST, contract) AS INTEGER) AS position FROM (SELECT *, CASE status WHEN 'P' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS r FROM {CONTRACTS} c)")
def t3_ordered_by_state(t):
    return W.ordered_by_state(t.contracts(), "status", {"P": 1, "O": 2}, "signed", "contract").select("contract", "state_rank", "position")


@query("SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id LIMIT 200")
def t4_recent_events(t):
    return W.recent_events(t.events.select("event_id", "ts", "event_type"), "ts", "event_id")


@query(f"SELECT person_id, CAST(balance AS DOUBLE) AS balance FROM {PEOPLE} p WHERE house = 'BUILDING' AND balance IS NOT NULL ORDER BY p.balance, person_id LIMIT 100")
def t5_rank_by(t):
    return W.rank_by(t.people(), "balance", "person_id", F.col("house") == "BUILDING", desc=False)[0].select("person_id", *money("balance"))


@query("SELECT p_type, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_type LIMIT 10")
def t6_most_common(t):
    return W.most_common(t.part, "p_type", 10)


@query(f"SELECT dest, count(*) FILTER (NOT coalesce(year >= 1995, false)) AS n_excluded, count(*) FILTER (year >= 1995) AS n_kept FROM {SPENDING} s GROUP BY dest")
def p1_scoped(t):
    return P.scoped(t.spending(), F.col("year") >= 1995, ["dest"])[1]


@query("SELECT o_orderkey, CASE WHEN lower(trim(o_orderpriority)) NOT IN ('5-low', '4-not specified') THEN o_orderpriority END AS o_orderpriority FROM orders")
def p2_clean_sentinels(t):
    return P.clean_sentinels(t.orders.select("o_orderkey", "o_orderpriority"), ["o_orderpriority"], ["5-LOW", "4-NOT SPECIFIED "])


@query(f"SELECT destination, count(*) AS n, CAST(sum(paid) AS DOUBLE) AS paid FROM (SELECT *, CASE kind WHEN 'A' THEN 'state' WHEN 'R' THEN 'municipality' ELSE CASE dest WHEN 'F' THEN 'entity' END END AS destination FROM {SPENDING} s) WHERE destination IS NOT NULL GROUP BY 1")
def p3_destination(t):
    return P.destination(t.spending(), "kind", "dest", {"A": "state", "R": "municipality"}, {"F": "entity"}).groupBy("destination").agg(F.count("*").alias("n"), F.sum("paid").alias("paid")).select("destination", "n", *money("paid"))


@query(f"SELECT contract, signed FROM {CONTRACTS} c WHERE signed BETWEEN DATE '1996-02-01' AND DATE '1997-01-31'")
def p4_in_period(t):
    return P.in_period(t.contracts(), "signed", datetime.date(1996, 2, 1), datetime.date(1997, 1, 31)).select("contract", "signed")


@query("SELECT event_id FROM events WHERE event_type NOT IN ('error', 'view')")
def p5_exclude_codes(t):
    return P.exclude_codes(t.events, "event_type", ["error", "view"]).select("event_id")


@query("SELECT l_partkey AS action, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) >= 32")
def p6_min_support(t):
    return P.min_support(t.lineitem.groupBy(F.col("l_partkey").alias("action")).agg(F.count("*").alias("n")), "n", 32)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE NOT (o_orderstatus = 'F' AND o_totalprice < 200000)")
def p7_named_only(t):
    return P.named_only(t.orders, "o_orderstatus", "o_totalprice", 200000, "F").select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE NOT (o_orderstatus = 'F' AND c_mktsegment <> 'F')")
def p8_local_only(t):
    return P.local_only(t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")), "o_orderstatus", "c_mktsegment", "F").select("o_orderkey")


@query("SELECT supplier, contract, via IS NOT NULL AS known FROM (SELECT o_custkey AS supplier, o_orderkey AS contract, c_custkey AS via FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0) ON c_custkey = o_custkey)")
def j1_code_join(t):
    dim = t.customer.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("supplier"), F.lit(True).alias("in_dim"))
    return R.code_join(t.orders.select(F.col("o_custkey").alias("supplier"), F.col("o_orderkey").alias("contract")), dim, "supplier").select("supplier", "contract", F.col("in_dim").isNotNull().alias("known"))


@query("SELECT p_name || '/' || p_size AS key, min(p_partkey) AS id FROM part GROUP BY 1 HAVING count(DISTINCT p_partkey) = 1")
def j2_key_index_drop(t):
    return R.key_index(t.part.withColumn("k", F.concat_ws("/", "p_name", "p_size")), "k", "p_partkey")


@query("SELECT p_name AS key, min_by(p_partkey, p_size * 10000000 + p_partkey) AS id FROM part GROUP BY 1")
def j3_key_index_first(t):
    return R.key_index(t.part, "p_name", "p_partkey", "first", "p_size")


@query(f"SELECT count(*) AS n FROM {SPENDING} s WHERE org IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)")
def j27_keep(t):
    return J.keep(t.spending(), t.supplier.where("s_acctbal > 5000").select(F.col("s_suppkey").alias("org")), ["org"]).agg(F.count("*").alias("n"))


@query("SELECT c_custkey AS person FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)")
def j28_uncovered(t):
    return J.uncovered(t.customer.select(F.col("c_custkey").alias("person")), t.orders.where("o_totalprice > 450000").select(F.col("o_custkey").alias("person")), ["person"])


@query("SELECT DISTINCT o_custkey AS person FROM orders WHERE o_custkey IN (SELECT l_suppkey FROM lineitem)")
def j29_overlap(t):
    return J.overlap(t.orders.select(F.col("o_custkey").alias("person")), t.lineitem.select(F.col("l_suppkey").alias("person")), ["person"])


@query(f"""WITH f AS (SELECT org, action, sum(paid) AS v FROM {SPENDING} s GROUP BY ALL), top AS (SELECT org, action FROM (SELECT org, action, row_number() OVER (PARTITION BY org ORDER BY n DESC, action) AS r FROM (SELECT org, action, count(*) AS n FROM {SPENDING} s GROUP BY ALL)) WHERE r <= 15)
 SELECT f.org, CAST(sum(v) AS DOUBLE) AS total, round_even(CAST(sum(v) FILTER (top.org IS NOT NULL) AS DOUBLE) / CAST(sum(v) AS DOUBLE), 4) AS share FROM f LEFT JOIN top ON top.org = f.org AND top.action = f.action GROUP BY f.org""")
def j30_share_in_set(t):
    s = t.spending()
    top = W.top_k(s.groupBy("org", "action").agg(F.count("*").alias("n")), ["org"], [F.desc("n"), F.asc("action")], 15)
    return J.share_in_set(s, top, ["org"], ["action"], "paid").select("org", *money("total"), "share")


@query("SELECT c_nationkey AS head, count(*) FILTER (list_contains(string_split(lower(replace(c_name, '#', ' ')), ' '), lpad(CAST(c_nationkey AS VARCHAR), 9, '0'))) AS n FROM customer GROUP BY 1")
def j31_same_surname_count(t):
    heads = t.nation.select(F.col("n_nationkey").alias("head"), F.concat(F.lit("Head "), F.lpad(F.col("n_nationkey").cast("string"), 9, "0")).alias("name"))
    return J.same_surname_count(t.customer.select(F.col("c_nationkey").alias("head"), F.col("c_name").alias("name")), heads)


@query("SELECT p_partkey, pay FROM part LEFT JOIN (SELECT DISTINCT p_size AS lvl, p_size * 10 AS pay FROM part WHERE p_size < 25) ON lvl = p_size")
def j32_value_levels(t):
    levels = t.part.where("p_size < 25").select("p_size", (F.col("p_size") * 10).alias("pay")).distinct()
    return J.value_levels(t.part.select("p_partkey", "p_size"), levels, ["p_size"]).select("p_partkey", "pay")


@query(f"SELECT c_custkey AS supplier, CAST(amount AS DOUBLE) AS amount FROM customer LEFT JOIN (SELECT supplier, sum(value) AS amount FROM {CONTRACTS} c GROUP BY supplier) ON supplier = c_custkey")
def j33_attach_sum(t):
    return J.attach_sum(t.customer.select(F.col("c_custkey").alias("supplier")), t.contracts(), "supplier", "value").select("supplier", *money("amount"))


@query("""WITH claims AS (SELECT p_partkey AS id, 'steel' AS family FROM part WHERE regexp_matches(p_type, 'STEEL$') AND NOT regexp_matches(p_type, '^SMALL') UNION SELECT p_partkey, 'sized' FROM part WHERE CAST(p_size AS VARCHAR) IN ('1', '2') UNION SELECT p_partkey, 'first' FROM part WHERE p_partkey = 1)
 SELECT id, min(family) AS family FROM claims GROUP BY id HAVING count(*) = 1""")
def j34_match_rules(t):
    rules = t.spark.createDataFrame([("steel", "name", "STEEL$", "^SMALL"), ("sized", "subtype", "1", None), ("sized", "subtype", "2", None), ("first", "id", "1", None)], "family string, kind string, pattern string, except_pattern string")
    return J.match_rules(t.part.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("name"), F.col("p_size").cast("string").alias("subtype")), rules)[0]


@query("""SELECT c_custkey AS person, coalesce(a, b, c) AS started, CASE WHEN a IS NOT NULL THEN 'own' WHEN b IS NOT NULL THEN 'gazette' WHEN c IS NOT NULL THEN 'act' END AS started_source FROM customer LEFT JOIN (SELECT o_custkey, min(CAST(o_orderdate AS DATE)) AS a FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) x ON x.o_custkey = c_custkey
 LEFT JOIN (SELECT o_custkey, min(CAST(o_orderdate AS DATE)) AS b FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) y ON y.o_custkey = c_custkey LEFT JOIN (SELECT o_custkey, min(CAST(o_orderdate AS DATE)) AS c FROM orders GROUP BY 1) z ON z.o_custkey = c_custkey""")
def j35_coalesce_sources(t):
    o = t.orders.select(F.col("o_custkey").alias("person"), F.to_date("o_orderdate").alias("d"), "o_orderstatus")
    first = lambda df: df.groupBy("person").agg(F.min("d").alias("d"))
    return J.coalesce_sources(t.customer.select(F.col("c_custkey").alias("person")), "person", [(first(o.where("o_orderstatus = 'P'")), "d", "own"), (first(o.where("o_orderstatus = 'F'")), "d", "gazette"), (first(o), "d", "act")], "started")


@query("SELECT o_orderkey, coalesce(array_to_string(list_sort(list_slice(l, 1, 6)), ','), '') AS effects FROM orders LEFT JOIN (SELECT l_orderkey, list_sort(list(DISTINCT l_partkey)) AS l FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def j36_attach_children(t):
    child = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey")
    return J.attach_children(t.orders.select("o_orderkey"), child, "o_orderkey", "l_partkey").select("o_orderkey", F.array_join(F.col("l_partkey_list").cast("array<string>"), ",").alias("effects"))


@query(f"""SELECT c_custkey AS person, n AS contracts, CAST(v AS DOUBLE) AS value, m AS visits FROM customer LEFT JOIN (SELECT supplier, count(*) AS n, sum(value) AS v FROM {CONTRACTS} c GROUP BY 1) ON supplier = c_custkey LEFT JOIN (SELECT user_id, count(*) AS m FROM events GROUP BY 1) ON user_id = c_custkey""")
def j37_assemble(t):
    blocks = {"buys": t.contracts().groupBy(F.col("supplier").alias("person")).agg(F.count("*").alias("n"), F.sum("value").alias("v")), "web": t.events.groupBy(F.col("user_id").alias("person")).agg(F.count("*").alias("m"))}
    return J.assemble(t.customer.select(F.col("c_custkey").alias("person")), blocks, "person").select("person", F.col("buys.n").alias("contracts"), F.col("buys.v").cast("double").alias("value"), F.col("web.m").alias("visits"))
