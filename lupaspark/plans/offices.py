"""Published jobs about offices and their holders: travel, pay, parliament, meetings, expenditures, courts, the gazette, seats."""

from __future__ import annotations

from pyspark.sql import functions as F

from lupaspark.functions import columns as C
from lupaspark.operators import aggregates as A
from lupaspark.operators import filters as P
from lupaspark.operators import graph as G
from lupaspark.operators import ranking as W
from lupaspark.operators import resolve as R
from lupaspark.operators import temporal as T
from lupaspark.operators import text as X
from lupaspark.plans.jobs import _pick, _sql_pick, _sql_word, _word
from lupaspark.plans.money import SEATS, _seat_tables
from lupaspark.plans.registry import CONTRACTS, LOG, SANCTIONS, SPENDING, money, query


@query(f"""WITH s AS (SELECT * FROM {SPENDING} x), g AS (SELECT 'org,kind' AS grouping, org, kind, NULL AS dest, NULL AS year, sum(paid) AS paid FROM s GROUP BY org, kind UNION ALL SELECT 'org,dest', org, NULL, dest, NULL, sum(paid) FROM s GROUP BY org, dest
 UNION ALL SELECT 'org,year', org, NULL, NULL, year, sum(paid) FROM s GROUP BY org, year)
 SELECT grouping, org, kind, dest, year, CAST(paid AS DOUBLE) AS paid, rank FROM (SELECT *, row_number() OVER (PARTITION BY grouping ORDER BY paid DESC, org, kind, dest, year) AS rank FROM g) WHERE rank <= 30""")
def d10_travel(t):
    """What organs paid by kind, destination and year in one pass, and the 30 largest of each grouping."""
    sums = A.multi_sum(t.spending(), [["org", "kind"], ["org", "dest"], ["org", "year"]], ["paid"])
    return W.top_k(sums, ["grouping"], [F.desc("paid"), F.asc("org"), F.asc("kind"), F.asc("dest"), F.asc("year")], 30).select("grouping", "org", "kind", "dest", "year", *money("paid"), "rank")


@query(f"""WITH p AS (SELECT buyer, supplier, year(signed) AS year, sum(value) AS gross FROM {CONTRACTS} c GROUP BY ALL), n AS (SELECT buyer, year, count(*) AS people, count(*) FILTER (gross > 300000) AS above, sum(greatest(gross - 300000, 0)) AS excess FROM p GROUP BY ALL HAVING count(*) >= 5)
 SELECT buyer, year, people, above, round_even(above * 100.0 / people, 1) AS pct, CAST(excess AS DOUBLE) AS excess FROM n""")
def d11_pay_ceiling(t):
    """People paid above the ceiling in a year, their share and what exceeds it, for organs with five people and more."""
    people = A.multi_sum(t.contracts().withColumn("year", F.year("signed")), [["buyer", "supplier", "year"]], ["value"])
    over = F.greatest(F.col("value") - 300000, F.lit(0).cast("decimal(18,2)"))
    out = people.groupBy("buyer", "year").agg(F.count("*").alias("people"), F.count_if(F.col("value") > 300000).alias("above"), F.sum(over).alias("excess"))
    return P.min_support(out, "people", 5).select("buyer", "year", "people", "above", C.pct(F.col("above"), F.col("people")).alias("pct"), *money("excess"))


_PAY = "(SELECT l_suppkey AS row_id, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS gross, sum(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(4,2))) AS cut, sum(CAST(l_tax AS DECIMAL(4,2))) AS indemnity FROM lineitem GROUP BY 1)"


@query(f"""SELECT criterion, reason, count(*) AS n, count(gross) AS paid_rows, CAST(sum(gross) AS DOUBLE) AS gross, CAST(sum(cut) AS DOUBLE) AS cut, CAST(sum(gross - cut + indemnity) AS DOUBLE) AS net
 FROM (SELECT CASE WHEN s_suppkey % 3 < 2 THEN s_suppkey END AS row_id, CASE s_suppkey % 3 WHEN 0 THEN 'full name' WHEN 1 THEN 'base name' END AS criterion, CASE WHEN s_suppkey % 3 = 2 THEN 'no match' END AS reason FROM supplier) LEFT JOIN {_PAY} USING (row_id) GROUP BY ALL""")
def d12_payroll_of_holders(t):
    """Holders found in the payroll of their organ, with what they are paid, by how they were found."""
    s = t.supplier.select(F.col("s_suppkey").alias("id"), F.concat(F.lit("s"), "s_suppkey").alias("organ"), F.concat(_word("s_suppkey"), F.lit(" Maria Lima")).alias("name"))
    pay = s.select(F.col("id").alias("row_id"), F.when(F.col("id") % 3 == 0, F.col("name")).when(F.col("id") % 3 == 1, F.concat("name", F.lit(" Neto"))).otherwise("Outra Pessoa").alias("name"), "organ")
    found = R.payroll_match(s.select(F.col("id").alias("person"), "name", "organ"), pay, G.closure(t.organs())).select("person", "row_id", "criterion", "reason")
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    slips = t.lineitem.select(F.col("l_suppkey").alias("row_id"), price.alias("gross"), (-price * F.col("l_discount").cast("decimal(4,2)")).alias("cut"), F.col("l_tax").cast("decimal(4,2)").alias("indemnity"))
    out = found.join(A.payroll_components(slips, "row_id", "gross", "cut", "indemnity"), "row_id", "left")
    return out.groupBy("criterion", "reason").agg(F.count("*").alias("n"), F.count("gross").alias("paid_rows"), *[F.sum(c).alias(c) for c in ("gross", "cut", "net")]).select("criterion", "reason", "n", "paid_rows", *money("gross", "cut", "net"))


@query(f"""WITH r AS (SELECT DISTINCT user_id AS person FROM events), v AS (SELECT user_id AS person, count(DISTINCT CAST(ts AS DATE)) AS present FROM events WHERE event_type = 'click' GROUP BY 1), n AS (SELECT count(DISTINCT CAST(ts AS DATE)) AS rolls FROM events),
 q AS (SELECT supplier AS person, sum(value) AS total, count(DISTINCT date_trunc('month', signed)) AS months FROM {CONTRACTS} c GROUP BY 1), b AS (SELECT supplier AS person, count(DISTINCT contract) AS bills, count(*) FILTER (status = 'F') AS became_law FROM {CONTRACTS} c GROUP BY 1),
 f AS (SELECT c_custkey AS person, CAST(c_acctbal AS DECIMAL(18,2)) AS staff FROM customer)
 SELECT person, coalesce(present, 0) AS present, round_even(coalesce(present, 0) * 100.0 / rolls, 1) AS attendance, CAST(total AS DOUBLE) AS total, months, coalesce(bills, 0) AS bills, coalesce(became_law, 0) AS became_law,
 CASE WHEN staff IS NOT NULL THEN round_even((2000.0 + CAST(staff AS DOUBLE)) * 0.5 * 12 + coalesce(CAST(total AS DOUBLE), 0), 2) END AS cost FROM r CROSS JOIN n LEFT JOIN v USING (person) LEFT JOIN q USING (person) LEFT JOIN b USING (person) LEFT JOIN f USING (person)""")
def d14_parliament(t):
    """Attendance, quota, bills and cost of each member, members without any among them."""
    e = t.events.select(F.col("user_id").alias("person"), F.to_date("ts").alias("roll"), "event_type")
    c = t.contracts().withColumnRenamed("supplier", "person")
    quota = A.quota(c.withColumn("month", F.trunc("signed", "month")), "person", "month", "decision", "value").select("person", "total", "months")
    bills = A.authorship(c.withColumns({"order": F.lit(1), "law": F.col("status") == "F"}), "person", "contract", "order", "decision", "law").select("person", "bills", "became_law")
    offices = t.customer.select(F.col("c_custkey").alias("person"), F.col("c_acctbal").cast("decimal(18,2)").alias("staff"))
    cost = A.mandate_cost(offices, quota, 2000.0, "person", 0.5).select("person", "cost")
    out = A.attendance(e.where("event_type = 'click'"), e, e, "person", "roll").join(quota, "person", "left").join(bills, "person", "left").join(cost, "person", "left")
    return out.select("person", "present", "attendance", *money("total"), "months", F.coalesce("bills", F.lit(0)).alias("bills"), F.coalesce("became_law", F.lit(0)).alias("became_law"), "cost")


_MEETINGS = f"(SELECT l_suppkey AS person, l_partkey AS entity, {_sql_pick('l_partkey', 'law firm', 'sector', 'company', None, 'public')} AS class FROM lineitem)"


@query(f"""SELECT class, person, encounters, entities, rank FROM (SELECT *, row_number() OVER (PARTITION BY class ORDER BY encounters DESC, person) AS rank FROM (SELECT coalesce(class, 'none') AS class, person, count(*) AS encounters, count(DISTINCT entity) AS entities FROM {_MEETINGS} m WHERE class IS DISTINCT FROM 'public' GROUP BY ALL)) WHERE rank <= 10""")
def d15_meetings(t):
    """Who received whom: outsiders by the kind of interest that their name shows, public bodies left out, the ten who meet each kind most."""
    name = _pick(F.col("l_partkey"), "Costa Advogados Associados", "Sindicato dos Portos", "Portos e Obras Ltda", "Ana Lima", "Prefeitura de Lagoa")
    m = t.lineitem.select(F.col("l_suppkey").alias("person"), F.col("l_partkey").alias("entity"), F.coalesce(C.interest_marker(name, ["ANA"]), F.lit("none")).alias("class")).where("class <> 'public'")
    met = m.groupBy("class", "person").agg(F.count("*").alias("encounters"), F.count_distinct("entity").alias("entities"))
    return W.top_k(met, ["class"], [F.desc("encounters"), F.asc("person")], 10)


@query("""WITH x AS (SELECT p_size % 25 AS ministry, sum(CAST(p_retailprice AS DECIMAL(18,2))) AS waived FROM part GROUP BY 1), b AS (SELECT s_nationkey AS ministry, sum(CAST(s_acctbal AS DECIMAL(18,2))) AS budget FROM supplier GROUP BY 1)
 SELECT ministry, n_name AS name, CAST(waived AS DOUBLE) AS waived, CAST(budget AS DOUBLE) AS budget, round_even(CAST(waived AS DOUBLE) / CAST(budget AS DOUBLE), 4) AS ratio FROM x JOIN nation ON n_nationkey = ministry JOIN b USING (ministry) WHERE budget <> 0 ORDER BY ratio DESC, ministry LIMIT 10""")
def d17_expenditures(t):
    """Taxes waived beside the budget of the ministry in charge, the ten largest ratios."""
    waived = t.part.groupBy((F.col("p_size") % 25).cast("long").alias("ministry")).agg(F.sum(F.col("p_retailprice").cast("decimal(18,2)")).alias("waived"))
    budget = t.supplier.groupBy(F.col("s_nationkey").cast("long").alias("ministry")).agg(F.sum(F.col("s_acctbal").cast("decimal(18,2)")).alias("budget"))
    names = t.nation.select(F.col("n_nationkey").cast("long").alias("ministry"), F.col("n_name").alias("name"))
    return W.top_ratio(waived.join(names, "ministry").join(budget, "ministry"), "waived", "budget", "ministry", 10).select("ministry", "name", *money("waived", "budget"), "ratio")


@query(f"""WITH c AS (SELECT year(valid_from) AS year, firm_key, valid_from <= DATE '1999-01-01' AND (valid_to IS NULL OR valid_to >= DATE '1999-01-01') AS live, {_sql_pick('sanction_id', 'warning', 'fine', 'suspension', 'debarment', 'rescission', 'other')} AS class FROM {SANCTIONS} s),
 g AS (SELECT year, class, count(*) AS n, count(DISTINCT firm_key) AS firms, count(*) FILTER (live) AS in_force FROM c GROUP BY year, class) SELECT year, class, n, firms, in_force, round_even(n * 100.0 / sum(n) OVER (PARTITION BY year), 1) AS pct FROM g""")
def d18_court_penalties(t):
    """Penalties that a court publishes as free text: by class and year, how many are in force, and their share of the year."""
    words = _pick(F.col("sanction_id"), "ADVERTÊNCIA", "Multa de 2%", "Suspensão do direito de licitar", "Declaração de inidoneidade", "RESCISÃO contratual", "sem efeito")
    s = t.sanctions().select("firm_key", "valid_from", "valid_to", F.year("valid_from").alias("year"), C.class_by_patterns(words, C.PENALTIES).alias("class"))
    day = F.lit("1999-01-01").cast("date")
    live = (F.col("valid_from") <= day) & (F.col("valid_to").isNull() | (F.col("valid_to") >= day))
    out = s.groupBy("year", "class").agg(F.count("*").alias("n"), F.count_distinct("firm_key").alias("firms"), F.count_if(live).alias("in_force"))
    total = out.groupBy("year").agg(F.sum("n").alias("all"))
    return out.join(total, "year").select("year", "class", "n", "firms", "in_force", C.pct(F.col("n"), F.col("all")).alias("pct"))


@query(f"""WITH l AS (SELECT unit, person, verb, day FROM {LOG} x), e AS (SELECT unit, max(day) AS since FROM l WHERE verb = 'signup' GROUP BY unit), h AS (SELECT l.unit, e.since, max({_sql_word('l.person')}) AS w FROM l JOIN e ON e.unit = l.unit AND e.since = l.day WHERE verb = 'signup' GROUP BY ALL)
 SELECT unit, 'MARIA ' || upper(w) || 'A LIMA' AS name, since FROM h WHERE NOT EXISTS (SELECT 1 FROM l x WHERE x.verb = 'error' AND x.unit = h.unit AND {_sql_word('x.person')} = h.w AND x.day >= h.since)""")
def d19_gazette_occupants(t):
    """Who holds each post, told from the texts of the gazette alone: acts parsed, posts and names taken from them, then folded by date."""
    log = t.log()
    verb = F.when(F.col("verb") == "signup", F.lit("NOMEAR, a contar desta data, a Senhora")).otherwise("EXONERAR, a pedido,")
    tail = F.when(F.col("verb") == "signup", F.lit(" para exercer o cargo em comissão de ")).otherwise(" do cargo de ")
    text = F.concat(F.lit("O MINISTRO DE ESTADO resolve "), verb, F.lit(" MARIA "), F.upper(_word("person")), F.lit("A LIMA"), tail, F.lit("Chefe da Unidade "), "unit", F.lit(", código CCE 1.13."))
    acts = X.acts_with_names(log.select(F.struct("event_id", "day").alias("doc_id"), text.alias("text")))
    unit = F.regexp_extract("post", r"Unidade (\d+)", 1).cast("long")
    return T.current_holder(acts.select(unit.alias("unit"), "name", "verb", F.col("doc_id.day").alias("day")), "unit", "name", "verb", "day", "nomear", "exonerar").select("unit", "name", "since")


@query(SEATS + """, f AS (SELECT family, round_even(sum(annual * seats), 3) AS total, sum(seats) AS seats, count(DISTINCT post) AS posts, count(*) FILTER (basis = 'law') AS by_law, count(*) AS blocks FROM posts JOIN blocks USING (post) GROUP BY family)
 SELECT family, CAST(total AS DOUBLE) AS total, posts, by_law, round_even(by_law * 100.0 / blocks, 1) AS law_pct FROM f""")
def d22_seat_rules(t):
    """What the seats of each family cost a year, and how many of their blocks a law states."""
    posts, *rest = _seat_tables(t)
    blocks = A.seat_cost(posts, *rest)
    cost = A.family_cost(blocks, posts).select("family", "total")
    told = blocks.join(posts.select("post", "family"), "post").groupBy("family").agg(F.count_distinct("post").alias("posts"), F.count_if(F.col("basis") == "law").alias("by_law"), F.count("*").alias("blocks"))
    return cost.join(told, "family").select("family", F.col("total").cast("double").alias("total"), "posts", "by_law", C.pct(F.col("by_law"), F.col("blocks")).alias("law_pct"))
