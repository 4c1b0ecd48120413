"""Published jobs about money, sanctions, requests and the structure (the others are in offices), and queries of the remaining rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lupaspark.functions import columns as C
from lupaspark.operators import aggregates as A
from lupaspark.operators import filters as P
from lupaspark.operators import graph as G
from lupaspark.operators import incremental as I  # noqa: E741
from lupaspark.operators import joins as J
from lupaspark.operators import merge as U
from lupaspark.operators import quality as Q
from lupaspark.operators import ranking as W
from lupaspark.operators import resolve as R
from lupaspark.operators import temporal as T
from lupaspark.operators import text as X
from lupaspark.plans.registry import AS_OF, CONTRACTS, LOG, ORGANS, PEOPLE, PROGRAMS, SANCTIONS, SPENDING, money, query
from lupaspark.session import grows

LETTERS = ("0123456789", "bcdfghjklm")


def _word(col: str):
    """A word of letters alone that stands for a number."""
    return F.translate(F.col(col).cast("string"), *LETTERS)


def _sql_word(col: str) -> str:
    return f"translate(CAST({col} AS VARCHAR), '{LETTERS[0]}', '{LETTERS[1]}')"


# Jobs -----------------------------------------------------------------------


@query(f"""WITH y AS (SELECT org, year, sum(committed) AS c, sum(paid) AS p FROM {SPENDING} s GROUP BY ALL), t AS (SELECT org, sum(paid) AS total FROM {SPENDING} s GROUP BY org), k AS (SELECT org, action, sum(paid) AS v FROM {SPENDING} s GROUP BY ALL),
 c AS (SELECT org, sum(v) FILTER (r <= 5) AS top FROM (SELECT *, row_number() OVER (PARTITION BY org ORDER BY v DESC, action) AS r FROM k) GROUP BY org), j AS (SELECT org, sum(paid) FILTER (year = 1994) AS a, sum(paid) FILTER (year = 1995) AS b FROM {SPENDING} s WHERE year IN (1994, 1995) GROUP BY org)
 SELECT t.org, CAST(total AS DOUBLE) AS paid, round_even(CAST(top AS DOUBLE) / CAST(total AS DOUBLE), 4) AS top_share, round_even(CAST(b AS DOUBLE) / CAST(a AS DOUBLE), 4) AS jump, years FROM t JOIN c USING (org) LEFT JOIN j USING (org) JOIN (SELECT org, count(*) AS years FROM y GROUP BY org) USING (org)""")
def d1_amendments(t):
    s = t.spending()
    total = s.groupBy("org").agg(F.sum("paid").alias("paid"))
    years = A.sum_by(s, ["org", "year"], ["committed", "paid"]).groupBy("org").agg(F.count("*").alias("years"))
    top = A.concentration(s, ["org"], "action", "paid", 5).select("org", "top_share")
    jump = A.yoy(s, ["org"], "year", "paid", 1994, 1995).select("org", F.col("ratio").alias("jump"))
    return total.join(top, "org").join(jump, "org", "left").join(years, "org").select("org", *money("paid"), "top_share", "jump", "years")


@query(f"""WITH d AS (SELECT *, CASE kind WHEN 'A' THEN 'state' WHEN 'R' THEN 'municipality' ELSE CASE dest WHEN 'F' THEN 'entity' END END AS destination FROM {SPENDING} s), n AS (SELECT d.*, s_nationkey AS uf FROM d JOIN supplier ON s_suppkey = org WHERE destination IS NOT NULL)
 SELECT uf, destination, CAST(sum(paid) AS DOUBLE) AS paid, round_even(CAST(sum(paid) AS DOUBLE) / ((uf + 1) * 1000), 4) AS per_capita, CAST(row_number() OVER (PARTITION BY destination ORDER BY sum(paid) DESC, uf) AS INTEGER) AS rank FROM n GROUP BY uf, destination""")
def d2_transfers(t):
    d = P.destination(t.spending(), "kind", "dest", {"A": "state", "R": "municipality"}, {"F": "entity"})
    n = R.code_join(d, t.supplier.select(F.col("s_suppkey").alias("org"), F.col("s_nationkey").alias("uf")), "org")
    sums = A.sum_by(n.where("uf is not null"), ["uf", "destination"], ["paid"])
    pop = t.nation.select(F.col("n_nationkey").alias("uf"), ((F.col("n_nationkey") + 1) * 1000).alias("population"))
    return W.top_k(A.per_capita(sums, pop, "uf", "paid"), ["destination"], [F.desc("paid"), F.asc("uf")], 1000).select("uf", "destination", *money("paid"), "per_capita", "rank")


@query(f"""WITH b AS (SELECT DISTINCT 'n' || n_nationkey AS node, s_suppkey AS org FROM nation JOIN supplier ON s_nationkey = n_nationkey), s AS (SELECT node, program, sum(paid) AS paid FROM {PROGRAMS} p JOIN b USING (org) GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY paid DESC, program) AS r FROM s)
 SELECT node, CASE WHEN r <= 4 THEN program ELSE 'others' END AS program, CAST(sum(paid) AS DOUBLE) AS paid FROM k GROUP BY ALL""")
def d3_budget_by_program(t):
    bridge = R.scope_bridge(t.nation.select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("n"), "n_nationkey").alias("code")), t.supplier.select(F.concat(F.lit("s"), "s_suppkey").alias("code"), F.concat(F.lit("n"), "s_nationkey").alias("superior")))
    covered = bridge.where("code like 's%'").select("node", F.substring("code", 2, 12).cast("long").alias("org"))
    return W.top_k_rest(t.programs().join(covered, "org"), ["node"], "program", "paid", 4).select("node", "program", *money("paid"))


@query(f"""SELECT 's' || org AS node, year, 'own' AS scope, CAST(sum(committed) AS DOUBLE) AS committed FROM {SPENDING} s GROUP BY ALL UNION ALL SELECT 'n' || s_nationkey, year, 'superior', CAST(sum(committed) AS DOUBLE) FROM {SPENDING} s JOIN supplier ON s_suppkey = org GROUP BY ALL""")
def d4_budget_by_organ(t):
    s = t.spending()
    own = A.sum_by(s, ["org", "year"], ["committed"]).select(F.concat(F.lit("s"), "org").alias("node"), "year", F.lit("own").alias("scope"), *money("committed"))
    up = A.sum_by(s.join(t.supplier.select(F.col("s_suppkey").alias("org"), "s_nationkey"), "org"), ["s_nationkey", "year"], ["committed"])
    return own.unionByName(up.select(F.concat(F.lit("n"), "s_nationkey").alias("node"), "year", F.lit("superior").alias("scope"), *money("committed")))


@query(f"""WITH p AS (SELECT year, sum(paid) AS v FROM {SPENDING} s WHERE year <= 1998 AND (month(day) < 9 OR (month(day) = 9 AND day(day) <= 10)) GROUP BY year)
 SELECT year, CAST(v AS DOUBLE) AS value, round_even(CAST(v AS DOUBLE) * 200.0 / (100.0 + (year - 1990) * 10), 2) AS real, round_even(CAST(v AS DOUBLE) / CAST(lag(v) OVER (ORDER BY year) AS DOUBLE), 4) AS growth FROM p""")
def d5_revenue_meter(t):
    from pyspark.sql import Window

    p = A.same_period(t.spending(), "day", "paid", "1998-09-10").withColumn("idx", 100.0 + (F.col("year") - 1990) * 10)
    real = A.real_terms(p, "idx", "value", 200.0)
    before = F.lag("value").over(Window.orderBy("year"))  # one row for each year
    return real.withColumn("growth", F.bround(F.try_divide(F.col("value").cast("double"), before.cast("double")), 4)).select("year", *money("value"), "real", "growth")


@query(f"""WITH a AS (SELECT DISTINCT contract, supplier, value FROM {CONTRACTS} c JOIN {SANCTIONS} s USING (firm_key) WHERE signed >= valid_from AND (valid_to IS NULL OR signed <= valid_to) AND category <> 'multa' AND (reach IS DISTINCT FROM 'sanctioning_body' OR body_key = buyer))
 SELECT supplier, count(*) AS n, CAST(sum(value) AS DOUBLE) AS value FROM a GROUP BY supplier ORDER BY a.supplier IS NULL, sum(value) DESC, supplier LIMIT 40""".replace("ORDER BY a.supplier IS NULL, ", "ORDER BY "))
def d6_barred_suppliers(t):
    ok = C.bars_contracting(F.col("category")) & F.coalesce(C.reaches_buyer(F.col("reach"), F.col("body_key"), F.col("buyer")), F.lit(True))
    alerts = T.in_force_join(t.contracts(), t.sanctions(), ["firm_key"], "signed", extra=ok).select("contract", "supplier", "value").distinct()
    return W.global_top(A.supplier_rollup(alerts, "supplier", "contract", "value"), [F.desc("value"), F.asc("supplier")], 40).select("supplier", "n", *money("value"))


@query(f"SELECT body_key, category, count(*) AS n, count(*) FILTER (valid_from <= DATE '1999-01-01' AND (valid_to IS NULL OR valid_to >= DATE '1999-01-01')) AS in_force, count(DISTINCT firm_key) AS firms, count(*) FILTER (reach IS NULL) AS unknown_reach FROM {SANCTIONS} s GROUP BY ALL")
def d7_sanctions_registry(t):
    day = F.lit("1999-01-01").cast("date")
    live = (F.col("valid_from") <= day) & (F.col("valid_to").isNull() | (F.col("valid_to") >= day))
    return t.sanctions().groupBy("body_key", "category").agg(F.count("*").alias("n"), F.count_if(live).alias("in_force"), F.count_distinct("firm_key").alias("firms"), F.count_if(F.col("reach").isNull()).alias("unknown_reach"))


@query(f"""SELECT buyer, requests, denied, CASE WHEN requests >= 20 THEN round_even(denied * 100.0 / requests, 1) END AS rate FROM (SELECT buyer, count(*) AS requests, count(*) FILTER (decision LIKE '1%') AS denied FROM {CONTRACTS} c GROUP BY buyer)""")
def d8_information_requests(t):
    counts = A.count_where(t.contracts(), ["buyer"], {"requests": F.lit(True), "denied": F.col("decision").startswith("1")})
    return A.rate(counts, "denied", "requests")


@query("""SELECT l_suppkey AS organ, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS spent, count(DISTINCT l_orderkey) AS holders, count(*) FILTER (l_returnflag = 'R') AS secret FROM lineitem GROUP BY 1 HAVING count(*) >= 50""")
def d9_corporate_card(t):
    li = t.lineitem.select(F.col("l_suppkey").alias("organ"), F.col("l_extendedprice").cast("decimal(18,2)").alias("v"), "l_orderkey", "l_returnflag")
    out = li.groupBy("organ").agg(F.sum("v").alias("spent"), F.count_distinct("l_orderkey").alias("holders"), F.count_if(F.col("l_returnflag") == "R").alias("secret"), F.count("*").alias("n"))
    return P.min_support(out, "n", 50).select("organ", *money("spent"), "holders", "secret")


@query(f"SELECT house, uf, count(*) AS members, CAST(sum(balance) AS DOUBLE) AS assets, CAST(sum(balance) FILTER (balance > 5000) AS DOUBLE) AS large FROM {PEOPLE} p WHERE NOT (house = 'BUILDING' AND balance < 1000) GROUP BY ALL")
def d13_campaign_assets(t):
    named = P.named_only(t.people(), "house", "balance", 1000, "BUILDING")
    return named.groupBy("house", "uf").agg(F.count("*").alias("members"), F.sum("balance").alias("assets"), F.sum(F.when(F.col("balance") > 5000, F.col("balance"))).alias("large")).select("house", "uf", "members", *money("assets", "large"))


@query(f"""SELECT status AS kind, count(*) AS pending, count(*) FILTER (signed + 120 < DATE '1998-01-01') AS overdue, min(signed + 120) AS oldest_due, CAST(sum(value) FILTER (signed + 120 < DATE '1998-01-01') AS DOUBLE) AS at_risk FROM {CONTRACTS} c WHERE status IN ('O', 'P') GROUP BY status""")
def d16_inaction_board(t):
    items = T.deadlines(t.contracts().where("status in ('O', 'P')").withColumn("halted", F.lit(False)), "signed", "halted", "1998-01-01", 120)
    late = F.col("days_left") < 0
    return items.groupBy(F.col("status").alias("kind")).agg(F.count("*").alias("pending"), F.count_if(late).alias("overdue"), F.min("due").alias("oldest_due"), F.sum(F.when(late, F.col("value"))).alias("at_risk")).select("kind", "pending", "overdue", "oldest_due", *money("at_risk"))


@query(f"""WITH w AS (SELECT user_id AS id, DATE '{AS_OF}' - CAST(ts AS DATE) AS age FROM events), h AS (SELECT id, round(2 * count(*) FILTER (age BETWEEN 0 AND 6) + count(*) FILTER (age BETWEEN 0 AND 89) / 10.0, 1) AS heat FROM w GROUP BY id ORDER BY heat DESC, id LIMIT 20)
 SELECT id, heat, CAST(floor(age / 7) AS BIGINT) AS week, count(*) AS n FROM h JOIN w USING (id) WHERE age BETWEEN 0 AND 83 GROUP BY ALL""")
def d20_power_map(t):
    e = t.events.select(F.col("user_id").alias("id"), "ts")
    return T.weekly_counts(e.join(T.heat(e, "id", "ts", AS_OF).select("id", "heat"), "id"), ["id", "heat"], "ts", AS_OF)


@query(f"""WITH o AS {ORGANS} SELECT o.kind, count(*) AS nodes, count(DISTINCT o.parent) AS parents, CAST(sum(CASE WHEN c.n IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS leaves FROM o LEFT JOIN (SELECT parent, count(*) AS n FROM o WHERE parent IS NOT NULL GROUP BY parent) c ON c.parent = o.id GROUP BY o.kind""")
def d21_structure(t):
    o = t.organs()
    children = o.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("n"))
    return o.join(children, "id", "left").groupBy("kind").agg(F.count("*").alias("nodes"), F.count_distinct("parent").alias("parents"), F.count_if(F.col("n").isNull()).alias("leaves"))


@query(f"""WITH p AS (SELECT DISTINCT unit, person FROM {LOG} l WHERE verb = 'signup' AND day = DATE '2024-01-10'), c AS (SELECT DISTINCT unit, person FROM {LOG} l WHERE verb = 'signup' AND day = DATE '2024-01-11')
 SELECT unit, person, 'left' AS event FROM p WHERE (unit, person) NOT IN (SELECT (unit, person) FROM c) UNION ALL SELECT unit, person, 'entered' FROM c WHERE (unit, person) NOT IN (SELECT (unit, person) FROM p)""")
def d23_changes(t):
    at = lambda d: t.log().where((F.col("verb") == "signup") & (F.col("day") == F.lit(d).cast("date")))
    return I.snapshot_diff(at("2024-01-10"), at("2024-01-11"), ["unit", "person"], "2024-01-11").select("unit", "person", "event")


# Remaining rows -------------------------------------------------------------


@query("SELECT c_custkey, 'ministerio ' || w AS core, 'obras ' || w AS bare, w || ' costa' AS base, 'jose costa' AS ends, 'Ministério da ' || upper(w[1]) || w[2:] AS title, 'SP' AS uf FROM (SELECT c_custkey, " + _sql_word("c_custkey") + " AS w FROM customer WHERE c_custkey > 0)")
def f5_f13_names(t):
    w = _word("c_custkey")
    return t.customer.where("c_custkey > 0").select(
        "c_custkey", C.core_name(F.concat(F.lit("Min. da "), w), {"min": "ministerio"}).alias("core"), C.strip_legal_form(F.concat(F.lit("Obras "), w, F.lit(" Ltda. ME"))).alias("bare"), C.name_key_base(F.concat(w, F.lit(" da Costa Filho"))).alias("base"),
        C.name_key_first_last(F.concat(F.lit("José "), w, F.lit(" Costa Neto"))).alias("ends"), C.title_pt(F.concat(F.lit("MINISTÉRIO DA "), F.upper(w))).alias("title"), C.uf_from_code(F.concat(F.lit("35"), "c_custkey")).alias("uf"),
    )


def _pick(k, *values):
    """The value whose place is k modulo their number."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (k % len(values) + 1).cast("int"))


def _sql_pick(k: str, *values) -> str:
    return f"CASE {k} % {len(values)} " + " ".join(f"WHEN {i} THEN " + ("NULL" if v is None else f"'{v}'") for i, v in enumerate(values)) + " END"


_K = "(SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"


@query(f"SELECT event_id, {_sql_pick('k', 'trip', 'trip', 'hearing', 'hearing', 'meeting', 'meeting', 'event', 'event', 'other', 'other', 'other')} AS class, CASE WHEN k % 4 = 0 THEN 'PL' ELSE 'other' END AS bill, k % 2 = 1 AS abroad, CAST(k AS DOUBLE) AS amount FROM {_K}")
def f28_f36_classes(t):
    e = t.events.select("event_id", F.from_json("props", "k int")["k"].alias("k"))
    title = _pick(F.col("k"), "Viagem a Recife", "Partida para São Paulo", "Audiência com A", "Recebe a delegação", "Almoço com B", "Telefonema", "Cerimônia de posse", "Inauguração do posto", "Férias", None, "O fim da viagem")
    bill = F.when(F.col("k") % 4 == 0, "PLP").otherwise("XX")
    return e.select("event_id", C.class_by_patterns(title, C.EVENTS).alias("class"), C.class_by_rules(bill, {"PEC": "PEC"}, {"PL": "PL"}).alias("bill"), C.abroad(F.when(F.col("k") % 2 == 0, "Recife/PE").otherwise("Lisboa")).alias("abroad"), C.value_in_text(F.concat(F.lit("custa R$ "), "k", F.lit(",00 ao todo"))).cast("double").alias("amount"))


@query(f"SELECT event_id, {_sql_pick('k', 'shelved', 'approved', 'approved', 'rejected', 'withdrawn', 'other')} AS outcome, {_sql_pick('k', 'public', 'public', 'law firm', 'sector', 'company', 'company', 'company', None, None)} AS marker, {_sql_pick('k', 'granted', 'denied', 'partial', 'nonexistent', 'not competent', 'not a request', 'duplicate', 'other')} AS nature, {_sql_pick('k', 'warning', 'fine', 'suspension', 'suspension', 'debarment', 'rescission', 'other')} AS penalty FROM {_K}")
def f29_f37_closed_classes(t):
    """Values as sources print them, each class at least once."""
    k = F.col("k")
    outcome = _pick(k, "Arquivada ao fim da legislatura", "Transformado em norma; sancionada", "Promulgada", "Vetado integralmente", "Retirado pelo autor", "Em tramitação")
    name = _pick(k, "Secretaria de Estado da Saúde Ltda", "Advocacia-Geral da União", "Silva Advogados", "Federação das Indústrias", "Obras e Rodas LTDA", "Rodas S.A.", "Banco Rodas SA", "Maria Lima", "Funai Obras Ltda")
    nature = _pick(k, "Acesso Concedido", "Acesso Negado", "Acesso Parcialmente Concedido", "Informação Inexistente", "Órgão não tem competência para responder sobre o assunto", "Não se trata de solicitação de informação", "Pergunta Duplicada/Repetida", "Encaminhada")
    penalty = _pick(k, "Advertência e multa", "Multa de mora", "Impedimento de licitar", "Suspensão temporária", "Declaração de inidoneidade", "Rescisão unilateral", "Sem registro")
    e = t.events.select("event_id", F.from_json("props", "k int")["k"].alias("k"))
    return e.select("event_id", C.class_by_patterns(outcome, C.OUTCOMES).alias("outcome"), C.interest_marker(name, ["FUNAI"]).alias("marker"), C.decision_nature(nature).alias("nature"), C.class_by_patterns(penalty, C.PENALTIES).alias("penalty"))


@query("SELECT p_partkey FROM part WHERE p_partkey % 2 = 0")
def p9_external_only(t):
    w = _word("p_partkey")
    return P.external_only(t.part.select("p_partkey", F.concat(F.lit("ministerio fazenda "), w).alias("own"), F.when(F.col("p_partkey") % 2 == 1, F.concat(F.lit("fazenda "), w)).otherwise(F.concat(F.lit("empresa "), w)).alias("name")), "name", "own").select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_brand <> 'Brand#1'")
def p10_drop_junk(t):
    return P.drop_junk(t.part, "p_brand", t.part.where("p_brand = 'Brand#1'").select(F.upper("p_brand").alias("label")), "label").select("p_partkey")


@query("SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'P' AND CAST(o_orderdate AS DATE) < DATE '1996-01-01')")
def p11_drop_stale(t):
    return P.drop_stale(t.orders.withColumn("d", F.to_date("o_orderdate")), "o_orderstatus", "d", "P", "1996-01-01").select("o_orderkey")


@query("SELECT c_custkey, c_name FROM customer")
def p12_core_columns(t):
    return P.split_columns(t.customer, "c_custkey", ["c_name"])[0]


@query("SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN -1 WHEN o_custkey % 3 = 1 THEN o_custkey END AS node FROM orders")
def j8_resolve_with_cache(t):
    o = t.orders.select("o_orderkey", "o_custkey", F.concat(F.lit("n"), "o_custkey").alias("name"))
    cache = o.where("o_custkey % 3 = 0").select(F.col("o_custkey").alias("key"), F.lit(-1).cast("long").alias("node")).distinct()
    known = o.where("o_custkey % 3 < 2").select(F.col("name").alias("raw"), F.col("o_custkey").alias("node")).distinct()
    return R.resolve_with_cache(o, "o_custkey", ["name"], cache, known)[0].select("o_orderkey", "node")


@query("SELECT c_custkey AS cand_id, c_custkey AS person_id FROM customer WHERE c_custkey % 3 <> 1")
def j10_person_join_birth(t):
    c = t.customer.select(F.col("c_custkey").alias("id"), F.concat(F.lit("Maria "), _word("c_custkey")).alias("name"))
    day = lambda n: F.date_add(F.lit("1960-01-01").cast("date"), n)
    cands = c.select(F.col("id").alias("cand_id"), "name", F.when(F.col("id") % 3 == 0, day(0)).when(F.col("id") % 3 == 1, day(1)).alias("birth"))
    return R.person_join_birth(cands, c.select(F.col("id").alias("person_id"), "name", day(0).alias("birth"))).select("cand_id", "person_id")


@query("SELECT o_orderkey AS cand_id, c_custkey AS person_id FROM (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 2 = 1 QUALIFY count(*) OVER (PARTITION BY year(o_orderdate), o_custkey) = 1) JOIN customer ON c_custkey = o_custkey")
def j11_second_pass(t):
    o = t.orders.select(F.col("o_orderkey").alias("cand_id"), F.col("o_custkey").cast("string").alias("urna"), F.year("o_orderdate").alias("year"))
    return R.second_pass(o, o.where("cand_id % 2 = 0"), t.customer.select(F.col("c_custkey").alias("person_id"), F.col("c_custkey").cast("string").alias("urna")), "urna", "year").select("cand_id", "person_id")


@query("SELECT s_suppkey AS person, CASE WHEN s_suppkey % 3 < 2 THEN s_suppkey END AS row_id, CASE s_suppkey % 3 WHEN 0 THEN 'full name' WHEN 1 THEN 'base name' END AS criterion, CASE WHEN s_suppkey % 3 = 2 THEN 'no match' END AS reason FROM supplier")
def j12_payroll_match(t):
    s = t.supplier.select(F.col("s_suppkey").alias("id"), F.concat(F.lit("s"), "s_suppkey").alias("organ"), F.concat(_word("s_suppkey"), F.lit(" Maria Lima")).alias("name"), F.concat(F.lit("n"), "s_nationkey").alias("up"))
    pay = s.select(F.col("id").alias("row_id"), F.when(F.col("id") % 3 == 0, F.col("name")).when(F.col("id") % 3 == 1, F.concat("name", F.lit(" Neto"))).otherwise("Outra Pessoa").alias("name"), "organ")
    return R.payroll_match(s.select(F.col("id").alias("person"), "name", "organ"), pay, G.closure(t.organs())).select("person", "row_id", "criterion", "reason")


@query("SELECT c_custkey AS act, c_custkey AS target FROM customer WHERE c_custkey % 5 <> 0")
def j20_symmetric_terms(t):
    """Optional words on either side or both; one target in five has a word more that is none."""
    n, word = F.col("c_custkey"), F.concat(_word("c_custkey"), F.lit("qz obras"))
    acts = F.when(n % 2 == 0, F.concat(F.lit("Substituto de "), word)).otherwise(word)
    targets = F.when(n % 5 == 0, F.concat(word, F.lit(" hidricas"))).when(n % 3 == 0, F.concat(word, F.lit(", adjunto"))).otherwise(word)
    return R.symmetric_terms(t.customer.select(n.alias("act"), acts.alias("text")), t.customer.select(n.alias("target"), targets.alias("text")), ["substitut", "adjunt"])


@query("SELECT s_suppkey AS raw_id, s_suppkey AS org FROM supplier")
def j21_abbrev_match(t):
    s = t.supplier.select(F.col("s_suppkey").alias("org"), F.concat(F.lit("Ministerio "), _word("s_suppkey"), F.lit("zq Nacional")).alias("name"), F.concat(F.lit("Min "), _word("s_suppkey"), F.lit("zq")).alias("raw"))
    got = R.abbrev_match(s.select("raw"), s.select("org", "name"))
    return s.select(F.col("org").alias("raw_id"), "raw").join(grows(got), "raw").select("raw_id", "org")


@query("SELECT c_custkey, CASE WHEN n = 1 THEN id END AS canonical_id FROM customer LEFT JOIN (SELECT floor(c_acctbal) AS k, min(c_custkey) AS id, count(*) AS n FROM customer GROUP BY 1) ON k = floor(c_acctbal)")
def j22_canonical_ids(t):
    """Balances in full units name a customer where no other has the same."""
    key = F.floor("c_acctbal").cast("long").alias("size")
    reg = t.customer.select(F.lit(1).alias("layer"), F.col("c_custkey").alias("id"), key)
    return R.canonical_ids(t.customer.select("c_custkey", key), reg, ["size"]).select("c_custkey", "canonical_id")


@query(f"SELECT a.org, a.n AS before, coalesce(b.n, 0) AS after FROM (SELECT org, count(*) AS n FROM {SPENDING} s WHERE year = 1996 GROUP BY org) a LEFT JOIN (SELECT org, count(*) AS n FROM {SPENDING} s WHERE year = 1997 GROUP BY org) b USING (org) WHERE coalesce(b.n, 0) < a.n")
def q6_monotone(t):
    n = lambda y: t.spending().where(F.col("year") == y).groupBy("org").agg(F.count("*").alias("n"))
    return Q.monotone(n(1996), n(1997), "org", "n")


@query("""WITH r AS (SELECT event_type AS connector, count(*) FILTER (value > 200) AS bad, max(CAST(ts AS DATE)) AS d FROM events GROUP BY 1) SELECT connector, CASE WHEN connector = 'error' THEN 'old' ELSE 'ok' END AS status, CASE WHEN connector = 'error' THEN DATE '2023-12-31' ELSE DATE '2024-02-01' END AS last_ok FROM r""")
def q8_run_registry(t):
    c = t.events.select(F.col("event_type").alias("connector")).distinct()
    prev = c.select("connector", F.lit("old").alias("status"), F.lit(1).alias("seconds"), F.lit("2023-12-31").cast("date").alias("last_ok"))
    return Q.run_registry(prev, c.where("connector <> 'error'").select("connector", F.lit("ok").alias("status"), F.lit(2).alias("seconds")), c, "2024-02-01").select("connector", "status", "last_ok")


@query("SELECT count(*) AS n, count(*) FILTER (c_custkey % 2 = 0) AS carried, count(*) FILTER (c_custkey % 2 = 0 AND c_custkey % 100 > 45) AS old, round_even(count(*) FILTER (c_custkey % 2 = 0 AND c_custkey % 100 > 45) * 100.0 / count(*), 1) AS old_pct FROM customer")
def q13_carried_age(t):
    c = t.customer.select(F.when(F.col("c_custkey") % 2 == 0, "carried").otherwise("current").alias("origin"), F.date_sub(F.lit(AS_OF).cast("date"), (F.col("c_custkey") % 100).cast("int")).alias("seen"))
    return Q.carried_age(c, "origin", "seen", AS_OF)


@query("SELECT c_custkey AS id, lower(w) AS form FROM (SELECT c_custkey, 'Ministerio de ' || " + _sql_word("c_custkey") + " AS w FROM customer WHERE c_custkey % 2 = 0)")
def x3_eligible_aliases(t):
    a = t.customer.select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("Ministerio de "), _word("c_custkey"))).otherwise(F.concat(F.lit("m "), F.lit("x"))).alias("alias"))
    return X.eligible_aliases(a, ["conselho"])


@query("SELECT c_custkey, 'Maria ' || " + _sql_word("c_custkey") + " AS name, 'Diretor' AS post FROM customer")
def x10_nominations(t):
    s = F.concat(F.lit("Submete a indicação da Senhora Maria "), _word("c_custkey"), F.lit(", para exercer o cargo de Diretor, na vaga de X."))
    name, post = X.parse_nomination(s)
    return t.customer.select("c_custkey", name.alias("name"), post.alias("post"))


@query("SELECT c_custkey AS bill, c_custkey AS person_id FROM customer")
def x19_rapporteur(t):
    c = t.customer.select(F.col("c_custkey").alias("bill"), F.concat(F.lit("Designado Relator, Dep. Ana "), _word("c_custkey"), F.lit(" (X-SP).")).alias("text"))
    return X.rapporteur(c, t.customer.select(F.col("c_custkey").alias("person_id"), F.concat(F.lit("Ana "), _word("c_custkey")).alias("name")))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'abc' ELSE 'obras ' || " + _sql_word("c_custkey") + " END AS key FROM customer")
def x20_entity_keys(t):
    s = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("ABC - Associacao "), _word("c_custkey"))).otherwise(F.concat(F.lit("Obras "), _word("c_custkey"), F.lit(" Ltda")))
    return t.customer.select("c_custkey", X.entity_key(s).alias("key"))


@query("SELECT c_custkey, c_custkey % 2 = 0 AS person FROM customer")
def x14_person_names(t):
    s = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("Maria da "), _word("c_custkey"))).otherwise(F.concat(F.lit("Secretaria de "), _word("c_custkey")))
    return t.customer.select("c_custkey", X.is_person_name(s).alias("person"))


@query("""SELECT n_nationkey AS page_id, unnest(generate_series(0, 1)) AS table_no, unnest([0, 0]) AS row_no, unnest(['Nome|UF', n_name || '|R' || n_regionkey]) AS cells FROM nation
 UNION ALL SELECT n_nationkey, 1, 1, 'fim' FROM nation""")
def x16_page_tables(t):
    """Pages with two tables each, head cells, attributes and mark-up within cells."""
    html = F.concat(F.lit("<h1>x</h1><table class='a'><tr><th>Nome</th><th> UF </th></tr></table> text <TABLE><tr><td id=1><b>"), "n_name", F.lit("</b></td>\n<td>R"), "n_regionkey", F.lit("</td></tr><tr><td>fim</td></tr></TABLE>"))
    got = X.page_tables(t.nation.select(F.col("n_nationkey").alias("page_id"), html.alias("html")))
    return got.select("page_id", "table_no", "row_no", F.array_join("cells", "|").alias("cells"))


@query("SELECT p_partkey, 'left' AS side FROM part WHERE p_partkey % 2 = 0 AND p_partkey % 3 <> 0 UNION ALL SELECT p_partkey, 'right' FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 2 <> 0")
def u8_difference_of_layers(t):
    return U.difference(t.part.where("p_partkey % 2 = 0").select("p_partkey"), t.part.where("p_partkey % 3 = 0").select("p_partkey"), "p_partkey")


@query("SELECT DISTINCT o_custkey AS person FROM orders WHERE o_orderstatus = 'P'")
def j27_people_of_interest(t):
    return J.keep(t.orders.select(F.col("o_custkey").alias("person")).distinct(), t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("person")), ["person"])
