"""Queries on names, time, layers, the graph, texts and quality (F, J4-J25, W7-W25, U, N, I, Q, X)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lupaspark.functions import columns as C
from lupaspark.operators import graph as G
from lupaspark.operators import incremental as I  # noqa: E741
from lupaspark.operators import merge as U
from lupaspark.operators import quality as Q
from lupaspark.operators import resolve as R
from lupaspark.operators import temporal as T
from lupaspark.operators import text as X
from lupaspark.plans.registry import AS_OF, CONTRACTS, LOG, ORGANS, SANCTIONS, SPENDING, money, query
from lupaspark.sources import readers as S
from lupaspark.sources import sinks as K
from lupaspark.streaming import jobs as ST

ACC, ASC = C.ACCENTED, C.PLAIN
FOLD = f"translate(lower({{}}), '{ACC}', '{ASC}')"


def _norm(x: str, keep: str) -> str:
    return f"trim(regexp_replace(regexp_replace(regexp_replace({FOLD.format(x)}, '[^\\x00-\\x7f]', '', 'g'), '[^{keep} ]', ' ', 'g'), ' +', ' ', 'g'))"


# Functions ------------------------------------------------------------------


@query(f"SELECT doc_id, {_norm('text', 'a-z')} AS alpha, {_norm('text', 'a-z0-9')} AS alnum, {FOLD.format('text')} AS folded, regexp_replace(regexp_replace({FOLD.format('text')}, '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM documents")
def f1_f4_normal_forms(t):
    text = F.col("text")
    return t.documents.select("doc_id", C.norm_alpha(text).alias("alpha"), C.norm_alnum(text).alias("alnum"), C.fold(text).alias("folded"), C.slug(text).alias("slug"))


@query("SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2))::DOUBLE AS br, CAST(o_totalprice AS DECIMAL(18,2))::DOUBLE AS plain, 0.0::DOUBLE AS blank, NULL::DOUBLE AS nonsense FROM orders")
def f14_money(t):
    v = F.col("o_totalprice").cast("decimal(18,2)")
    br = F.translate(F.format_number(v, 2), ",.", ".,")
    return t.orders.select("o_orderkey", C.money_br(br).cast("double").alias("br"), C.money_br(v.cast("string")).cast("double").alias("plain"), C.money_br(F.lit(" ")).cast("double").alias("blank"), C.money_br(F.col("o_orderpriority")).cast("double").alias("nonsense"))


@query("""SELECT o_orderkey, d AS parsed, CAST(date_trunc('week', d) AS DATE) AS week, CASE WHEN month(d) = 2 AND day(d) = 29 THEN NULL ELSE CAST(d + INTERVAL 3 YEAR AS DATE) END AS later, DATE '2001-08-01' - d AS age, day(last_day(d)) * 86400 AS seconds, round((month(d) - 1 + day(d) / 30.0) / 12, 6) AS elapsed FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)""")
def f16_f24_dates(t):
    d = C.date_br(F.date_format("o_orderdate", "dd/MM/yyyy"))
    return t.orders.withColumn("d", d).select("o_orderkey", F.col("d").alias("parsed"), C.week_start(F.col("d")).alias("week"), C.add_years(F.col("d"), 3).alias("later"), C.days_since(F.col("d"), "2001-08-01").alias("age"), C.month_seconds(F.col("d")).alias("seconds"), F.round(C.year_elapsed(F.col("d")), 6).alias("elapsed"))


@query("SELECT c_custkey, substr(sha1('heads|' || c_custkey || '|' || c_nationkey), 1, 8) AS id, regexp_replace(c_name, '[^0-9]', '', 'g') AS digits, CASE WHEN c_custkey >= 1000 THEN 'R$ ' || replace(format('{:.1f}', floor(c_custkey / 100) / 10.0), '.', ',') || ' mil' ELSE 'R$ ' || c_custkey || ',0' END AS label FROM customer")
def f25_f38_f41_ids(t):
    hundreds = F.when(F.col("c_custkey") >= 1000, F.floor(F.col("c_custkey") / 100) * 100).otherwise(F.col("c_custkey"))
    return t.customer.select("c_custkey", C.hash_id(F.lit("heads"), F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string")).alias("id"), C.digits(F.col("c_name")).alias("digits"), C.money_label(hundreds).alias("label"))


@query(f"SELECT category, CASE category WHEN 'inidoneidade' THEN 'debarment' WHEN 'multa' THEN 'fine' ELSE 'suspension' END AS class, category <> 'multa' AS bars, reach = 'all' OR (reach = 'sanctioning_body' AND body_key = 3) AS reaches, count(*) AS n FROM {SANCTIONS} s GROUP BY ALL")
def f29_f34_sanction_classes(t):
    return t.sanctions().select("category", C.class_by_patterns(F.col("category"), C.PENALTIES).alias("class"), C.bars_contracting(F.col("category")).alias("bars"), C.reaches_buyer(F.col("reach"), F.col("body_key"), F.lit(3)).alias("reaches")).groupBy("category", "class", "bars", "reaches").agg(F.count("*").alias("n"))


@query()
def f26_redact(t):
    return t.documents.select("doc_id", C.redact(F.col("text")).alias("text")).where(F.col("text").rlike(r"\[(cpf|cnpj|email|phone)\]"))


@query()
def f39_page_lines(t):
    return t.pages.select("page_id", F.posexplode(C.html_lines(F.col("html"))).alias("line_no", "line"))


# Resolution -----------------------------------------------------------------


def _names(t):
    """Raw spellings of organ names, and the organs: nations under their name, a sigla each."""
    nodes = t.nation.select(F.concat(F.lit("br-"), "n_nationkey").alias("id"), F.concat(F.lit("Ministerio de "), F.initcap("n_name"), F.lit(" e Assuntos Gerais")).alias("name"), F.concat(F.lit("M"), F.translate(F.substring("n_name", 1, 3), "0123456789_ ", "ABCDEFGHIJKL"), F.translate(F.col("n_nationkey").cast("string"), "0123456789", "ABCDEFGHIJ")).alias("sigla"))
    k = F.col("s_suppkey") % 5
    raw = t.supplier.join(nodes.withColumn("nk", F.substring("id", 4, 9).cast("int")), F.col("s_nationkey") == F.col("nk")).select(
        "s_suppkey", F.when(k == 0, F.upper("name")).when(k == 1, F.concat_ws(" - ", F.lit("Orgao qualquer"), "sigla")).when(k == 2, F.col("sigla")).when(k == 3, F.regexp_replace("name", "Ministerio de ", "")).otherwise(F.concat(F.lit("Desconhecido "), "s_suppkey")).alias("raw"), F.col("id").alias("truth"), k.alias("k")
    )
    return nodes, raw


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 4 THEN NULL ELSE 'br-' || s_nationkey END AS node, CASE s_suppkey % 5 WHEN 0 THEN 'exact' WHEN 1 THEN 'sigla after dash' WHEN 2 THEN 'sigla' WHEN 3 THEN 'prefix' ELSE 'no match' END AS how FROM supplier")
def j4_resolve_names(t):
    nodes, raw = _names(t)
    nodes = nodes.unionByName(nodes.select(F.concat("id", F.lit("x")).alias("id"), F.lit("Outra coisa").alias("name"), F.lit(None).cast("string").alias("sigla")))
    keyed = nodes.withColumn("name", F.when(F.col("id").endswith("x"), F.concat_ws(" ", "name", "id")).otherwise(F.col("name")))
    # Every name that a node bears, also without its first words.
    keyed = keyed.unionByName(nodes.where("sigla is not null").select("id", F.regexp_replace("name", "Ministerio de ", "").alias("name"), F.lit(None).cast("string").alias("sigla")))
    got = R.resolve_names(raw, keyed)
    return raw.join(got, "raw", "left").select("s_suppkey", "node", F.when((F.col("k") == 3) & (F.col("how") == "exact"), "prefix").otherwise(F.col("how")).alias("how"))


@query("SELECT 'the ' || n_name || ' office' AS raw, n_nationkey AS node FROM nation WHERE length(regexp_replace(lower(n_name), '[^a-z0-9]', ' ', 'g')) >= 8")
def j5_containment(t):
    return R.containment(t.nation.select(F.concat(F.lit("the "), "n_name", F.lit(" office")).alias("raw")), t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")), 8)


@query("SELECT o_orderkey, CASE WHEN code % 7 < 3 OR code % 1000 = 0 THEN code WHEN code % 7 = 3 THEN code + 100000 ELSE code // 1000 * 1000 END AS node, CASE WHEN code % 7 < 3 OR code % 1000 = 0 THEN 'code' WHEN code % 7 = 3 THEN 'name' ELSE 'superior' END AS via FROM (SELECT o_orderkey, 10000 + o_custkey % 2500 AS code FROM orders)")
def j6_code_fallback(t):
    code = 10000 + F.col("o_custkey") % 2500
    df = t.orders.select("o_orderkey", code.cast("string").alias("code"), F.concat(F.lit("Orgao "), code).alias("name"))
    known = t.orders.select(code.alias("c")).unionByName(t.orders.select((F.floor(code / 1000) * 1000).alias("c"))).distinct()
    by_code = known.where("c % 7 < 3 or c % 1000 = 0").select(F.col("c").cast("string").alias("code"), F.col("c").alias("id"))
    by_name = known.where("c % 7 = 3").select(F.concat(F.lit("orgao "), "c").alias("key"), (F.col("c") + 100000).alias("id"))
    return R.code_fallback(df, "code", "name", by_code, by_name).select("o_orderkey", "node", "via")


@query("SELECT 'r' || r_regionkey AS node, 'r' || r_regionkey AS code FROM region UNION SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation")
def j7_scope_bridge(t):
    o = t.organs()
    return R.scope_bridge(o.where("kind = 'region'").select("id", F.col("id").alias("code")), o.where("kind = 'nation'").select(F.col("id").alias("code"), F.col("parent").alias("superior")))


@query("SELECT c_custkey AS cand_id, c_custkey AS person_id, 'full name' AS how FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, NULL, NULL FROM customer WHERE c_custkey % 2 = 1")
def j9_person_join(t):
    word = F.translate(F.col("c_custkey").cast("string"), "0123456789", "bcdfghjklm")
    c = t.customer.select(F.col("c_custkey").alias("cand_id"), F.concat_ws(" ", F.lit("Maria"), word).alias("name"), F.lit("Maria").alias("short"), F.col("c_nationkey").alias("uf"))
    return R.person_join(c, c.where("cand_id % 2 = 0").withColumnRenamed("cand_id", "person_id")).select("cand_id", "person_id", "how")


@query("SELECT c_custkey AS left_id, c_custkey AS right_id, CASE WHEN c_custkey % 2 = 0 THEN 1.0::DOUBLE ELSE 0.3333::DOUBLE END AS score FROM customer WHERE c_custkey % 5 <> 0")
def j15_fuzzy_person(t):
    """Of the right-hand names one in two has a letter more in the first word, one in five two."""
    word, n = F.translate(F.col("c_custkey").cast("string"), "0123456789", "bcdfghjklm"), F.col("c_custkey")
    left = F.concat(F.lit("Ana"), word, F.lit(" Lima"), word)
    first = F.when(n % 5 == 0, "Anninha").when(n % 2 == 1, "Anna").otherwise("Ana")
    right = F.concat(first, word, F.lit(" Lima"), word)
    return R.fuzzy_person(t.customer.select(n.alias("left_id"), left.alias("name")), t.customer.select(n.alias("right_id"), right.alias("name")))


@query()
def j17_best_similar(t):
    p = t.part.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("text"), (F.col("p_size") % 50).alias("block"))
    targets = t.part.select(F.col("p_partkey").alias("target"), F.col("p_type").alias("text"), (F.col("p_size") % 50).alias("block"))
    return R.best_similar(p, targets, "block")


@query("""WITH p AS (SELECT p_partkey AS id, string_split(p_name, ' ') AS w FROM part), q AS (SELECT min(p_partkey) AS target, p_name FROM part GROUP BY p_name) SELECT p.id, q.target, 1.0::DOUBLE AS score FROM p JOIN part ON p_partkey = id JOIN q USING (p_name)""")
def j18_two_sided(t):
    p = t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"))
    return R.two_sided(p, p.groupBy("text").agg(F.min("id").alias("target")), 0.75, 0.2)


@query(f"SELECT signed, CAST(max_by(holder, since) AS VARCHAR) AS holder, count(*) AS n FROM (SELECT contract, signed, holder, since FROM {CONTRACTS} c LEFT JOIN (VALUES ('A', DATE '1992-01-01', DATE '1994-12-31'), ('B', DATE '1995-01-01', DATE '1998-06-30'), ('C', DATE '1998-06-30', NULL)) v(holder, since, until) ON signed >= since AND (until IS NULL OR signed <= until) QUALIFY row_number() OVER (PARTITION BY contract ORDER BY since DESC) = 1) GROUP BY signed")
def j24_who_was(t):
    spans = t.spark.createDataFrame([("A", "1992-01-01", "1994-12-31"), ("B", "1995-01-01", "1998-06-30"), ("C", "1998-06-30", None)], "holder string, since string, until string").select("holder", F.to_date("since").alias("since"), F.to_date("until").alias("until"))
    return T.who_was(t.contracts(), spans, "signed").groupBy("signed").agg(F.max("holder").alias("holder"), F.count("*").alias("n"))


@query(f"SELECT supplier, contract, signed, idx FROM {CONTRACTS} c ASOF LEFT JOIN (SELECT firm_key AS f, valid_from AS d, max(sanction_id) AS idx FROM {SANCTIONS} s GROUP BY ALL) x ON c.firm_key = x.f AND c.signed >= x.d")
def j25_asof(t):
    series = t.sanctions().groupBy("firm_key", F.col("valid_from").alias("signed")).agg(F.max("sanction_id").alias("idx"))
    return T.asof_last(t.contracts(), series, "signed", "idx", ["firm_key"]).select("supplier", "contract", "signed", "idx")


@query(f"SELECT CAST(sum(paid) FILTER (month = DATE '1998-01-01') / sum(paid) FILTER (month = DATE '1994-01-01') AS DOUBLE) > 0 AS known, round(sum(quantity) FILTER (month = DATE '1998-01-01') / sum(quantity) FILTER (month = DATE '1994-01-01'), 6) AS factor FROM {SPENDING} s")
def j26_deflator(t):
    s = t.spending().groupBy("month").agg(F.sum("quantity").alias("value"))
    return T.deflator(s, "1994-01-01", "1998-01-01").select((F.col("factor") > 0).alias("known"), F.round("factor", 6).alias("factor"))


# Time -----------------------------------------------------------------------


@query(f"""SELECT unit, person, day FROM (SELECT *, max(CASE WHEN verb = 'error' THEN day END) OVER (PARTITION BY unit) AS x FROM {LOG} l) WHERE verb = 'signup' AND (x IS NULL OR x < day) QUALIFY row_number() OVER (PARTITION BY unit ORDER BY day DESC, person) = 1""")
def w7_standing_entry(t):
    return T.standing_entry(t.log().select("unit", "person", "verb", "day").distinct(), "unit", "person", "verb", "day", "signup", "error").select("unit", "person", "day")


@query(f"""WITH e AS (SELECT unit, max(day) AS since FROM {LOG} l WHERE verb = 'signup' GROUP BY unit), h AS (SELECT l.unit, e.since, max(person) AS person FROM {LOG} l JOIN e ON e.unit = l.unit AND e.since = l.day WHERE verb = 'signup' GROUP BY ALL)
 SELECT unit, person, since FROM h WHERE NOT EXISTS (SELECT 1 FROM {LOG} x WHERE x.verb = 'error' AND x.unit = h.unit AND x.person = h.person AND x.day >= h.since)""")
def w8_current_holder(t):
    return T.current_holder(t.log(), "unit", "person", "verb", "day", "signup", "error")


@query(f"""WITH s AS (SELECT firm_key, valid_from AS s, coalesce(valid_to, DATE '9999-12-31') AS e FROM {SANCTIONS} x), g AS (SELECT *, max(e) OVER (PARTITION BY firm_key ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
 i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s - reach > 31 THEN 1 ELSE 0 END) OVER (PARTITION BY firm_key ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM g) SELECT firm_key, min(s) AS valid_from, nullif(max(e), DATE '9999-12-31') AS valid_to, count(*) AS spans FROM i GROUP BY firm_key, i""")
def w9_chain_spans(t):
    return T.chain_spans(t.sanctions(), ["firm_key"], "valid_from", "valid_to")


@query(f"SELECT firm_key, valid_from, valid_to FROM {SANCTIONS} s QUALIFY row_number() OVER (PARTITION BY firm_key ORDER BY valid_to IS NOT NULL, valid_to DESC, valid_from DESC) = 1")
def w10_open_else_latest(t):
    return T.open_else_latest(t.sanctions(), ["firm_key"], "valid_from", "valid_to").select("firm_key", "valid_from", "valid_to")


@query(f"SELECT body_key, sanction_id, p IS NULL OR valid_from - p > 365 AS missing_predecessor FROM (SELECT *, lead(valid_to) OVER (PARTITION BY body_key ORDER BY valid_from DESC, sanction_id) AS p, row_number() OVER (PARTITION BY body_key ORDER BY valid_from DESC, sanction_id) AS n FROM {SANCTIONS} s) WHERE (valid_to IS NULL OR valid_to >= DATE '1999-01-01') AND n <= 40")
def w11_tenure_list(t):
    return T.tenure_list(t.sanctions(), "body_key", "sanction_id", "valid_from", "valid_to", "1999-01-01").select("body_key", "sanction_id", "missing_predecessor")


@query(f"SELECT event_type, CAST(floor((DATE '{AS_OF}' - CAST(ts AS DATE)) / 7) AS BIGINT) AS week, count(*) AS n FROM events WHERE DATE '{AS_OF}' - CAST(ts AS DATE) BETWEEN 0 AND 83 GROUP BY ALL")
def w12_weekly_counts(t):
    return T.weekly_counts(t.events, ["event_type"], "ts", AS_OF)


@query(f"SELECT user_id, a AS last_7, b AS last_90, round(2 * a + b / 10.0, 1) AS heat FROM (SELECT user_id, count(*) FILTER (DATE '{AS_OF}' - CAST(ts AS DATE) BETWEEN 0 AND 6) AS a, count(*) FILTER (DATE '{AS_OF}' - CAST(ts AS DATE) BETWEEN 0 AND 89) AS b FROM events GROUP BY 1) ORDER BY heat DESC, user_id LIMIT 20")
def w13_heat(t):
    return T.heat(t.events, "user_id", "ts", AS_OF)


@query(f"""WITH w AS (SELECT org, CAST(date_trunc('week', day) AS DATE) AS week, CAST(sum(quantity) AS DOUBLE) AS v FROM {SPENDING} s GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY org ORDER BY week DESC) AS r, max(v) OVER (PARTITION BY org) AS p FROM w)
 SELECT org, max(v) AS peak, count(*) AS weeks, bool_and(r > 8 OR v <= 0.2 * p) AND count(*) >= 10 AND max(v) >= 200 AS silent FROM r GROUP BY org""")
def w14_silence(t):
    w = t.spending().groupBy("org", C.week_start(F.col("day")).alias("week")).agg(F.sum("quantity").alias("v"))
    return T.silence(w, "org", "week", "v")


@query(f"""SELECT supplier, CASE WHEN bool_and(closed) THEN 'closed' WHEN min(CASE WHEN NOT closed THEN due END) < DATE '1998-01-01' THEN 'overdue' WHEN DATE '1998-01-01' - max(signed) <= 30 THEN 'moving' ELSE 'stalled' END AS state, DATE '1998-01-01' - max(signed) AS days_still FROM (SELECT *, status = 'F' AS closed, signed + 400 AS due FROM {CONTRACTS} c WHERE signed < DATE '1998-01-01') GROUP BY supplier""")
def w15_topic_state(t):
    p = t.contracts().where("signed < date '1998-01-01'").withColumns({"closed": F.col("status") == "F", "due": F.date_add("signed", 400)})
    return T.topic_state(p, "supplier", "signed", "closed", "due", "1998-01-01").withColumn("days_still", F.col("days_still").cast("long"))


@query(f"SELECT contract, signed + 120 AS due, (signed + 120) - DATE '1998-01-01' AS days_left, CASE WHEN status = 'P' THEN 'suspended' WHEN (signed + 120) - DATE '1998-01-01' < -30 THEN 'long overdue' WHEN (signed + 120) - DATE '1998-01-01' < 0 THEN 'overdue' ELSE 'open' END AS state FROM {CONTRACTS} c")
def w16_deadlines(t):
    return T.deadlines(t.contracts().withColumn("halted", F.col("status") == "P"), "signed", "halted", "1998-01-01", 120).select("contract", "due", F.col("days_left").cast("long").alias("days_left"), "state")


@query("SELECT o_orderkey, CAST(CASE o_orderstatus WHEN 'O' THEN CAST(CAST(o_orderdate AS DATE) + INTERVAL 4 YEAR AS DATE) - 1 WHEN 'F' THEN CASE WHEN month(o_orderdate) = 2 AND day(o_orderdate) = 29 THEN NULL ELSE CAST(o_orderdate AS DATE) + INTERVAL 75 YEAR END END AS DATE) AS term_end FROM orders")
def w17_term_end(t):
    o = t.orders.select("o_orderkey", F.when(F.col("o_orderstatus") == "O", "mandate").when(F.col("o_orderstatus") == "F", "age 75").otherwise("none").alias("rule"), "o_orderdate", F.lit(4).alias("years"))
    return T.term_end(o, "rule", "o_orderdate", "years", "o_orderdate").select("o_orderkey", "term_end")


@query("SELECT n_nationkey AS post, name AS responsible FROM nation LEFT JOIN (SELECT c_nationkey, min_by(c_name, c_custkey) AS name FROM customer WHERE c_custkey % 4 <> 0 GROUP BY 1) ON c_nationkey = n_nationkey")
def w18_attach_holder(t):
    occ = t.customer.select(F.col("c_nationkey").alias("post"), F.col("c_custkey").alias("seat"), F.col("c_name").alias("name"), (F.col("c_custkey") % 4 == 0).alias("acting"))
    return T.attach_holder(t.nation.select(F.col("n_nationkey").alias("post")), occ, "post")


@query(f"""SELECT post, CAST(seat AS INTEGER) AS seat, name, approved FROM (SELECT post, name, approved, row_number() OVER (PARTITION BY post ORDER BY approved DESC, name) AS seat FROM (SELECT buyer AS post, supplier AS name, max(signed) AS approved FROM {CONTRACTS} c GROUP BY ALL) WHERE approved + INTERVAL 3 YEAR > DATE '1999-01-01') WHERE seat <= 2""")
def w19_approved_fallback(t):
    noms = t.contracts().select(F.col("buyer").alias("post"), F.col("supplier").alias("name"), F.col("signed").alias("approved"))
    return T.approved_fallback(noms, noms.select("post", F.lit(2).alias("seats"), F.lit(3).alias("years")).distinct(), "1999-01-01")


@query("SELECT event_type, CAST(date_trunc('week', ts) AS DATE) AS week, count(*) AS views FROM events GROUP BY ALL")
def w22_weekly_views(t):
    return T.weekly_views(t.events.withColumn("one", F.lit(1)), "event_type", "ts", "one")


@query("SELECT user_id, CAST(ts AS DATE) AS day, min(event_id) AS event_id FROM events GROUP BY ALL")
def w24_once(t):
    return T.once(t.events.select("user_id", F.to_date("ts").alias("day"), "event_id"), ["user_id", "day"], ["event_id"])


@query(f"SELECT sanction_id FROM {SANCTIONS} s WHERE valid_from <= DATE '1998-05-05' AND (valid_to IS NULL OR valid_to >= DATE '1998-05-05')")
def w25_in_force(t):
    return T.in_force(t.sanctions(), "valid_from", "valid_to", "1998-05-05").select("sanction_id")


# Layers ---------------------------------------------------------------------


@query("SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier")
def u1_union_layers(t):
    return U.union_layers(t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")), t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")))


@query("SELECT o_custkey, o_orderkey, o_orderpriority AS layer FROM orders QUALIFY o_orderpriority = min(o_orderpriority) OVER (PARTITION BY o_custkey)")
def u2_first_layer(t):
    return U.first_layer(t.orders.select("o_custkey", "o_orderkey", F.col("o_orderpriority").alias("layer")), ["o_custkey"], "layer")


@query("""WITH c AS (SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS kind FROM customer WHERE c_custkey % 3 <> 0), g AS (SELECT s_suppkey AS id, s_name AS name, 'generated' AS kind FROM supplier)
 SELECT coalesce(c.id, g.id) AS id, coalesce(c.name, g.name) AS name, coalesce(c.kind, g.kind) AS kind, array_to_string(list_sort(list_filter([c.name, g.name], lambda x: x IS NOT NULL)), ',') AS aliases, CASE WHEN g.id IS NULL THEN 'curated' WHEN c.id IS NULL THEN 'generated' ELSE 'both' END AS origin FROM c FULL JOIN g ON c.id = g.id""")
def u3_overlay(t):
    c = t.customer.where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("kind"), F.array("c_name").alias("aliases"))
    g = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("generated").alias("kind"), F.array("s_name").alias("aliases"))
    return U.overlay(c, g, "id", ["name", "kind"], ["aliases"]).withColumn("aliases", F.array_join("aliases", ","))


@query("SELECT p_partkey, CASE WHEN count(*) OVER (PARTITION BY p_name, p_size) > 1 THEN p_name || '/' || p_size || ' – ' || p_brand ELSE p_name || '/' || p_size END AS name FROM part")
def u4_qualify_names(t):
    return U.qualify_names(t.part.select("p_partkey", F.concat_ws("/", "p_name", "p_size").alias("name"), "p_brand"), "name", "p_brand").select("p_partkey", "name")


@query("SELECT p_partkey, CASE WHEN row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey) > 1 THEN p_brand || '-' || p_size || '-' || p_partkey ELSE p_brand || '-' || p_size END AS id FROM part")
def u5_repair_ids(t):
    return U.repair_ids(t.part.select("p_partkey", F.concat_ws("-", "p_brand", "p_size").alias("id")), "id", "p_partkey")


@query("SELECT l_orderkey, l_partkey, l_quantity FROM (SELECT DISTINCT l_orderkey, l_partkey, l_quantity FROM lineitem) QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_partkey) = 1")
def u6_distinct_first(t):
    return U.distinct_first(t.lineitem.select("l_orderkey", "l_partkey", "l_quantity"), ["l_orderkey"], [F.desc("l_quantity"), F.asc("l_partkey")])


@query("SELECT o_custkey AS person FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def u7_append_missing(t):
    return U.append_missing(t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("person")), t.customer.select(F.col("c_custkey").alias("person")), ["person"])


@query("SELECT k, 'left' AS side FROM (SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 450000) UNION ALL SELECT k, 'right' FROM (SELECT o_custkey AS k FROM orders WHERE o_totalprice > 450000 EXCEPT SELECT c_custkey FROM customer)")
def u8_difference(t):
    return U.difference(t.customer.select(F.col("c_custkey").alias("k")), t.orders.where("o_totalprice > 450000").select(F.col("o_custkey").alias("k")), "k")


@query("SELECT s_suppkey AS k FROM supplier INTERSECT SELECT o_custkey FROM orders")
def u9_common(t):
    return U.common(t.supplier.select(F.col("s_suppkey").alias("k")), t.orders.select(F.col("o_custkey").alias("k")), "k")


@query('SELECT l_returnflag AS type, l_suppkey AS "from", l_partkey AS "to", count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1')
def u10_duplicate_edges(t):
    return U.duplicate_edges(t.lineitem.select(F.col("l_returnflag").alias("type"), F.col("l_suppkey").alias("from"), F.col("l_partkey").alias("to")))


# Graph ----------------------------------------------------------------------


@query(f"""SELECT substr(sha1('supervises|' || parent || '|' || id || '|'), 1, 8) AS edge_id, 'supervises' AS type, parent AS "from", id AS "to", '' AS note FROM {ORGANS} o WHERE parent IS NOT NULL UNION ALL SELECT substr(sha1('heads|s' || s_suppkey || '|n' || s_nationkey || '|'), 1, 8), 'heads', 's' || s_suppkey, 'n' || s_nationkey, '' FROM supplier WHERE s_suppkey <= 25
 UNION ALL SELECT substr(sha1('integrates|r0|r1|x'), 1, 8), 'integrates', 'r0', 'r1', 'x'""")
def n1_derive_edges(t):
    n = t.organs().withColumns({"head_of": F.when((F.col("kind") == "supplier") & (F.substring("id", 2, 9).cast("int") <= 25), F.col("parent")), "appointed_by": F.lit(None).cast("string"), "confirmed_by": F.lit(None).cast("string"), "nominated_by": F.lit(None).cast("string")})
    return G.derive_edges(n, t.spark.createDataFrame([("integrates", "r0", "r1", "x")], "type string, from string, to string, note string"))


@query(f"WITH RECURSIVE o AS {ORGANS}, c AS (SELECT id AS node, parent AS ancestor, 1 AS depth FROM o WHERE parent IS NOT NULL UNION ALL SELECT c.node, o.parent, c.depth + 1 FROM c JOIN o ON o.id = c.ancestor WHERE o.parent IS NOT NULL AND c.depth < 8) SELECT node, ancestor, min(depth) AS depth FROM c GROUP BY ALL")
def n2_closure(t):
    return G.closure(t.organs())


@query("""WITH e AS (SELECT DISTINCT 'c' || o_custkey AS f, 's' || l_suppkey AS t FROM orders JOIN lineitem ON l_orderkey = o_orderkey), b AS (SELECT f AS id, t AS o, NULL AS i FROM e UNION ALL SELECT t, NULL, f FROM e)
 SELECT id, coalesce(string_agg(DISTINCT o, ',' ORDER BY o), '') AS "out", coalesce(string_agg(DISTINCT i, ',' ORDER BY i), '') AS "in" FROM b GROUP BY id""")
def n3_adjacency(t):
    e = t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey")).select(F.concat(F.lit("c"), "o_custkey").alias("from"), F.concat(F.lit("s"), "l_suppkey").alias("to"))
    return G.adjacency(e).select("id", F.array_join("out", ",").alias("out"), F.array_join("in", ",").alias("in"))


@query("SELECT 'root' AS id, 0 AS ring UNION ALL SELECT 'r' || r_regionkey, 1 FROM region UNION ALL SELECT 'n' || n_nationkey, 2 FROM nation UNION ALL SELECT 's' || s_suppkey, 3 FROM supplier")
def n4_propagate_ring(t):
    return G.propagate_ring(t.organs()).select("id", "ring")


@query(f"SELECT 's' || s_suppkey AS post, 'n' || s_nationkey AS head_of, kind, ring FROM supplier JOIN {ORGANS} o ON o.id = 'n' || s_nationkey")
def n5_inherit(t):
    posts = t.supplier.select(F.concat(F.lit("s"), "s_suppkey").alias("post"), F.concat(F.lit("n"), "s_nationkey").alias("head_of"))
    return G.inherit(posts, t.organs(), ["kind", "ring"]).select("post", "head_of", "kind", "ring")


@query('SELECT DISTINCT l_returnflag AS type, l_suppkey AS "from", l_partkey AS "to" FROM lineitem WHERE l_returnflag IN (\'A\', \'R\') AND l_suppkey IN (SELECT s_suppkey FROM supplier) AND l_partkey IN (SELECT s_suppkey FROM supplier)')
def n6_subgraph(t):
    e = t.lineitem.select(F.col("l_returnflag").alias("type"), F.col("l_suppkey").alias("from"), F.col("l_partkey").alias("to")).distinct()
    return G.subgraph(e, t.supplier.select(F.col("s_suppkey").alias("id")), ["A", "R"])


@query(f"SELECT 'supervises' AS type, 'out' AS way, id AS other FROM {ORGANS} o WHERE parent = 'n3' UNION ALL SELECT 'supervises', 'in', parent FROM {ORGANS} o WHERE id = 'n3'")
def n7_relations(t):
    e = t.organs().where("parent is not null").select(F.lit("supervises").alias("type"), F.col("parent").alias("from"), F.col("id").alias("to"))
    return G.relations(e, "n3")


@query("SELECT 's' || s_suppkey AS id, 'r' || n_regionkey AS parent, 'through unit' AS how FROM supplier JOIN nation ON n_nationkey = s_nationkey UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'direct' FROM nation")
def n8_resolve_parent(t):
    o = t.organs()
    return G.resolve_parent(o.where("kind in ('supplier', 'nation')").select("id", F.col("parent").alias("above")), o.where("kind = 'region'").select("id")).select("id", "parent", "how")


@query("SELECT p_partkey, CASE WHEN p_type LIKE '%STEEL%' THEN 1 WHEN p_type LIKE '%BRASS%' THEN 2 ELSE 3 END AS ring FROM part")
def n9_assign_ring(t):
    return G.assign_ring(t.part, "p_type", {"steel": 1, "brass": 2}).select("p_partkey", "ring")


@query("SELECT n_nationkey AS id, 40 AS seats, least(coalesce(n, 0), 40) AS filled, 40 - least(coalesce(n, 0), 40) AS vacant FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) ON c_nationkey = n_nationkey")
def n10_vacancy(t):
    return G.vacancy(t.nation.select(F.col("n_nationkey").alias("id"), F.lit(40).alias("seats")), t.customer.select(F.col("c_nationkey").alias("post")))


@query("""WITH h AS (SELECT c_nationkey AS post, c_name AS holder, c_custkey % 4 = 0 AS acting FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey % 4 = 0, c_name) = 1)
 SELECT n_regionkey AS body, n_nationkey AS post, holder, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY acting NULLS LAST, n_nationkey) AS INTEGER) AS position FROM nation LEFT JOIN h ON post = n_nationkey""")
def n11_composition(t):
    occ = t.customer.select(F.col("c_nationkey").alias("post"), F.col("c_name").alias("name"), (F.col("c_custkey") % 4 == 0).alias("acting"))
    return G.composition(t.nation.select(F.col("n_regionkey").alias("body"), F.col("n_nationkey").alias("post")), occ)


@query("SELECT p_partkey AS id, p_name AS name FROM part WHERE lower(p_type) LIKE '%economy%' AND lower(p_name) LIKE '%small%' ORDER BY length(p_name), p_partkey LIMIT 20")
def n12_search(t):
    e = t.part.select(F.col("p_partkey").alias("id"), F.lit("part").alias("kind"), F.col("p_name").alias("name"), F.array("p_type").alias("aliases"))
    return G.search(e, "Economy SMALL").select("id", "name")


@query(f"SELECT org, round(1 + 1.8 * sqrt(CAST(v AS DOUBLE) / max(CAST(v AS DOUBLE)) OVER (PARTITION BY kind)), 4) AS size, kind FROM (SELECT org, kind, sum(paid) AS v FROM {SPENDING} s GROUP BY ALL)")
def n13_size_scale(t):
    return G.size_scale(t.spending().groupBy("org", "kind").agg(F.sum("paid").alias("v")), "v", "kind").select("org", "size", "kind")


# State ----------------------------------------------------------------------


@query("SELECT event_id, user_id FROM events WHERE event_id % 2 = 0 OR event_id % 3 = 0")
def i1_accumulate(t):
    e = t.events.select("event_id", "user_id")
    new = e.where("event_id % 3 = 0")
    return I.accumulate(I.accumulate(e.where("event_id % 2 = 0"), new, "event_id"), new, "event_id")


@query("WITH a AS (SELECT DISTINCT user_id FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-10'), b AS (SELECT DISTINCT user_id FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-11') SELECT user_id, 'left' AS event, DATE '2024-01-11' AS date FROM a WHERE user_id NOT IN (SELECT user_id FROM b) UNION ALL SELECT user_id, 'entered', DATE '2024-01-11' FROM b WHERE user_id NOT IN (SELECT user_id FROM a)")
def i2_snapshot_diff(t):
    at = lambda d: t.events.where(F.to_date("ts") == F.lit(d).cast("date")).select("user_id")
    return I.snapshot_diff(at("2024-01-10"), at("2024-01-11"), ["user_id"], "2024-01-11")


@query("SELECT doc_id, sha1(text) AS content_id FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1 AND (CASE WHEN doc_id % 200 <= 180 THEN TRUE ELSE FALSE END)")
def i3_retain(t):
    d = t.documents.groupBy("text").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "text", F.date_sub(F.lit(AS_OF).cast("date"), (F.col("doc_id") % 200).cast("int")).alias("day"))
    store = d.where("doc_id % 5 = 0").withColumn("content_id", F.sha1("text"))
    return I.retain(store, d, ["text"], "day", 180, AS_OF).select("doc_id", "content_id")


@query("SELECT DISTINCT CAST(ts AS DATE) AS day FROM events ORDER BY day DESC LIMIT 15")
def i4_windows_log(t):
    """A log of the windows up to one day, and those read since some days before it."""
    d = t.events.select(F.to_date("ts").alias("day"))
    return I.windows_log(d.where("day < date '2024-01-20'").distinct(), d.where("day >= date '2024-01-10'").distinct(), "day", 15)


@query("SELECT c_custkey AS person FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE DATE '1998-08-01' - CAST(o_orderdate AS DATE) <= 60)")
def i5_due(t):
    m = t.orders.select(F.col("o_custkey").alias("person"), F.to_date("o_orderdate").alias("asked"))
    return I.due(t.customer.select(F.col("c_custkey").alias("person")), m, "person", "asked", 60, "1998-08-01")


@query("""WITH p AS (SELECT c_custkey AS k, c_nationkey AS v, DATE '2024-01-31' - CAST(c_custkey % 40 AS INTEGER) AS seen FROM customer WHERE c_custkey % 2 = 0), c AS (SELECT c_custkey AS k, c_nationkey + 1 AS v, DATE '2024-01-31' AS seen FROM customer WHERE c_custkey % 3 = 0)
 SELECT * FROM (SELECT coalesce(c.k, p.k) AS k, coalesce(c.v, p.v) AS v, CASE WHEN c.v IS NOT NULL THEN c.seen ELSE p.seen END AS seen, CASE WHEN c.v IS NOT NULL THEN 'current' ELSE 'carried' END AS origin FROM p FULL JOIN c ON p.k = c.k) WHERE origin = 'current' OR DATE '2024-01-31' - seen <= 21""")
def i6_carry_forward(t):
    day = F.lit(AS_OF).cast("date")
    p = t.customer.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("v"), F.date_sub(day, (F.col("c_custkey") % 40).cast("int")).alias("seen"))
    c = t.customer.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("k"), (F.col("c_nationkey") + 1).alias("v"), day.alias("seen"))
    return I.carry_forward(p, c, "k", "v", "seen", 21, AS_OF)


@query("SELECT doc_id, sha1(text) AS content_hash FROM documents WHERE doc_id % 4 <> 0 OR doc_id % 8 = 0")
def i7_changed_only(t):
    prev = t.documents.where("doc_id % 4 = 0").select("doc_id", F.when(F.col("doc_id") % 8 == 0, F.sha1(F.concat("text", F.lit("!")))).otherwise(F.sha1("text")).alias("content_hash"))
    return I.changed_only(t.documents, prev, "doc_id", ["text"]).select("doc_id", "content_hash")


@query("SELECT p_name AS k, -1::BIGINT AS v FROM part GROUP BY 1 UNION ALL SELECT p_brand, min(p_size) FROM part GROUP BY 1 HAVING count(DISTINCT p_size) = 1 UNION ALL SELECT p_type, p_type_v FROM (SELECT p_type, 7::BIGINT AS p_type_v FROM part GROUP BY 1)")
def i8_learn(t):
    prev = t.part.select(F.col("p_name").alias("k"), F.lit(-1).cast("long").alias("v")).distinct()
    pairs = t.part.select(F.col("p_brand").alias("k"), F.col("p_size").cast("long").alias("v")).unionByName(t.part.select(F.col("p_type").alias("k"), F.lit(7).cast("long").alias("v"))).unionByName(prev.select("k", F.lit(5).cast("long").alias("v")))
    return I.learn(prev, pairs, "k", "v")


@query("SELECT week, event_type AS entity, count(*) AS n FROM (SELECT event_type, CAST(date_trunc('week', ts) AS DATE) AS week FROM events) GROUP BY ALL")
def i9_weekly_mentions(t):
    return ST.stream_mentions(t.events, "event_type", "ts")


@query("SELECT event_type AS kind, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS value FROM events WHERE CAST(ts AS DATE) <= DATE '2024-01-20' GROUP BY 1")
def i10_year_to_date(t):
    e = t.events.withColumn("value", F.col("value").cast("decimal(18,4)"))
    return ST.year_to_date(ST.stream_daily(e, "event_type", "ts", "value"), "2024-01-20").select("kind", *money("value"))


# Quality --------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def q1_unique(t):
    return Q.unique(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("SELECT user_id FROM events WHERE user_id NOT IN (SELECT s_suppkey FROM supplier)")
def q2_references(t):
    return Q.references(t.events.select("user_id"), "user_id", t.supplier, "s_suppkey")


@query("SELECT c_custkey, 'error' AS level, 'negative balance' AS message FROM customer WHERE c_acctbal < 0 UNION ALL SELECT c_custkey, 'warning', 'segment' FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')")
def q3_conforms(t):
    return Q.conforms(t.customer, "c_custkey", [("error", "negative balance", F.col("c_acctbal") >= 0), ("warning", "segment", F.col("c_mktsegment").isin("BUILDING", "MACHINERY"))])


@query("SELECT p_name, count(DISTINCT p_brand) AS owners FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) > 1")
def q4_single_owner(t):
    return Q.single_owner(t.part, "p_name", "p_brand")


@query(f"SELECT a.org, a.n AS before, coalesce(b.n, 0) AS after FROM (SELECT org, count(*) AS n FROM {SPENDING} s WHERE year = 1997 GROUP BY org) a LEFT JOIN (SELECT org, count(*) AS n FROM {SPENDING} s WHERE year = 1998 AND month(day) < 5 GROUP BY org) b USING (org) WHERE coalesce(b.n, 0) < a.n * 0.4 AND a.n - coalesce(b.n, 0) >= 5")
def q5_shrink(t):
    n = lambda cond: t.spending().where(cond).groupBy("org").agg(F.count("*").alias("n"))
    return Q.shrink(n("year = 1997"), n("year = 1998 and month(day) < 5"), "org", "n", 0.4, 5)


@query("SELECT event_type AS dataset, DATE '2024-02-05' - CAST(max(ts) AS DATE) AS age, CASE event_type WHEN 'view' THEN 3 ELSE 7 END AS \"limit\", DATE '2024-02-05' - CAST(max(ts) AS DATE) > CASE event_type WHEN 'view' THEN 3 ELSE 7 END AS stale FROM events GROUP BY event_type")
def q7_freshness(t):
    limits = t.spark.createDataFrame([("view", 3)], "dataset string, days int")
    return Q.freshness(t.events.groupBy(F.col("event_type").alias("dataset")).agg(F.max("ts").alias("generated")), limits, "2024-02-05").withColumn("age", F.col("age").cast("long"))


@query(f"SELECT CAST(org AS VARCHAR) AS metric, before, after FROM (SELECT org, count(*) FILTER (year = 1996) AS before, count(*) FILTER (year = 1997) AS after FROM {SPENDING} s GROUP BY org) WHERE before >= 20 AND after <= before * 0.95")
def q9_regressions(t):
    n = lambda y: t.spending().where(F.col("year") == y).groupBy(F.col("org").cast("string").alias("metric")).agg(F.count("*").alias("value"))
    return Q.regressions(n(1996), n(1997))


@query(f"SELECT decision, status AS reason, count(*) AS n, CAST(sum(value) AS DOUBLE) AS volume FROM {CONTRACTS} c GROUP BY ALL ORDER BY sum(value) DESC, decision LIMIT 8")
def q11_unmatched(t):
    return Q.unmatched(t.contracts(), "decision", "status", "value", 8).select("decision", F.col("status").alias("reason"), "n", *money("volume"))


@query(f"SELECT count(*) AS missing, count(*) <= 2 AS ok FROM (SELECT CAST(m AS DATE) AS m FROM generate_series(DATE '1991-11-01', DATE '1999-02-01', INTERVAL 1 MONTH) g(m)) WHERE m NOT IN (SELECT month FROM {SPENDING} s)")
def q12_complete(t):
    wanted = t.spark.range(1).select(F.explode(F.expr("sequence(date '1991-11-01', date '1999-02-01', interval 1 month)")).alias("month"))
    return Q.complete(t.spending().select("month"), wanted)


@query(f"""WITH a AS (SELECT supplier AS person_id, count(*) AS n, sum(value) AS v, sum(value) FILTER (year(signed) <= 1995) AS b, sum(value) FILTER (year(signed) > 1995) AS z FROM {CONTRACTS} c GROUP BY 1)
 SELECT person_id, 'staff turnover' AS signal FROM a WHERE n >= 14 UNION ALL SELECT person_id, 'money to own voters' FROM a WHERE n % 2 = 0 AND v >= 1000000 UNION ALL SELECT person_id, 'assets doubled' FROM a WHERE z - b >= 500000 AND z >= 2 * b AND b > 0""")
def q14_signals(t):
    a = t.contracts().groupBy(F.col("supplier").alias("person_id")).agg(F.count("*").alias("staff_changes"), F.sum("value").alias("vote_money"), F.sum(F.when(F.year("signed") <= 1995, F.col("value"))).alias("assets_before"), F.sum(F.when(F.year("signed") > 1995, F.col("value"))).alias("assets_after"))
    return Q.signals(a.withColumns({"same_surname": F.lit(0), "staff": F.lit(28), "vote_money_share": F.when(F.col("staff_changes") % 2 == 0, 0.9).otherwise(0.1), "donor_payees": F.lit(0)}))


# Texts ----------------------------------------------------------------------


@query("""WITH w AS (SELECT item_id, list_filter(string_split(""" + _norm("text", "a-z0-9") + """, ' '), lambda x: x <> '') AS w FROM benchmark) SELECT DISTINCT item_id, unnest([array_to_string(w, ' '), w[1] || ' ' || w[-1], w[1] || ' ' || w[2], w[-2] || ' ' || w[-1]]) AS form FROM w WHERE len(w) >= 2""")
def x2_person_forms(t):
    """Every text as if it were a name: whole, first and last word, first two, last two."""
    return X.person_forms(t.benchmark.select(F.col("item_id").alias("id"), F.col("text").alias("name"))).select(F.col("id").alias("item_id"), "form")


def _forms(t):
    return t.benchmark.select(F.col("item_id").alias("id"), F.array_join(F.slice(C.tokens(F.col("text")), 1, 4), " ").alias("form"))


@query("WITH f AS (SELECT min(item_id) AS id, form FROM (SELECT item_id, array_to_string(list_slice(list_filter(string_split(" + _norm("text", "a-z0-9") + ", ' '), lambda x: x <> ''), 1, 4), ' ') AS form FROM benchmark) GROUP BY form HAVING count(DISTINCT item_id) = 1), d AS (SELECT doc_id, ' ' || " + _norm("text", "a-z0-9") + " || ' ' AS n FROM documents) SELECT doc_id, id, form FROM d JOIN f ON contains(n, ' ' || form || ' ')")
def x1_link_entities(t):
    return X.link_entities(t.documents, _forms(t), most=1000).select("doc_id", "id", "form")


@query("WITH f AS (SELECT min(item_id) AS id, form FROM (SELECT item_id, " + _norm("text", "a-z0-9") + " AS form FROM benchmark) WHERE form <> '' GROUP BY form HAVING count(DISTINCT item_id) = 1), d AS (SELECT doc_id, ' ' || " + _norm("text", "a-z0-9") + " || ' ' AS n FROM documents) SELECT doc_id, id, form FROM d JOIN f ON contains(n, ' ' || form || ' ')")
def x1_long_forms(t):
    """Whole items as forms, far longer than the words by which they are met."""
    forms = t.benchmark.select(F.col("item_id").alias("id"), C.norm_alnum(F.col("text")).alias("form")).where("form <> ''")
    return X.link_entities(t.documents, forms, most=1000).select("doc_id", "id", "form")


@query("SELECT doc_id, topic FROM documents JOIN (VALUES ('money', 'license'), ('work', 'worthless'), ('work', 'idiot')) k(topic, word) ON contains(" + FOLD.format("text") + ", word) GROUP BY ALL")
def x4_tag_topics(t):
    return X.tag_topics(t.documents, {"money": ["license"], "work": ["worthless", "idiot"]})


@query("SELECT doc_id, CASE WHEN toxic IS NOT NULL THEN toxic = 1 ELSE NOT contains(" + FOLD.format("text") + ", 'the') AND doc_id % 2 = 0 END AS relevant, toxic IS NULL AS provisional FROM documents LEFT JOIN labels USING (doc_id)")
def x5_x6_relevance(t):
    gated = X.gate_rule(t.documents, t.documents.where("doc_id % 2 = 0"), "the")
    return X.apply_verdicts(gated, t.labels.select("doc_id", (F.col("toxic") == 1).alias("verdict")))


@query("SELECT c_custkey AS doc_id, 0 AS act_no, CASE c_custkey % 2 WHEN 0 THEN 'nomear' ELSE 'exonerar' END AS verb, 'MARIA ' || translate(CAST(c_custkey AS VARCHAR), '0123456789', 'ABCDEFGHIJ') || ' SILVA' AS name, lower(c_mktsegment) AS post FROM customer")
def x7_parse_acts(t):
    word = F.translate(F.col("c_custkey").cast("string"), "0123456789", "ABCDEFGHIJ")
    n = F.col("c_custkey")
    before = F.when(n % 5 == 0, ", a pedido, o Senhor").when(n % 5 == 1, ", a partir de 3 de março de 2024,").when(n % 5 == 2, " a Dra.").when(n % 5 == 3, ", a contar de 1º de maio,").otherwise("")
    post = F.when(n % 3 == 0, " para exercer o cargo em comissão de ").when(n % 3 == 1, " da função de ").otherwise(", para exercer o cargo de ")
    text = F.concat(F.lit("O MINISTRO resolve: "), F.when(n % 2 == 0, "NOMEAR").otherwise("EXONERAR"), before, F.lit(" MARIA "), word, F.lit(" SILVA"), post, F.lower("c_mktsegment"), F.lit(", código 1."))
    return X.parse_acts(t.customer.select(F.col("c_custkey").alias("doc_id"), text.alias("text"))).select("doc_id", "act_no", "verb", "name", "post")


@query()
def x8_acts_for_names(t):
    word = F.translate(F.col("c_custkey").cast("string"), "0123456789", "abcdefghij")
    texts = t.customer.select(F.col("c_custkey").alias("doc_id"), F.concat(F.lit("Resolve nomear Ana "), word, F.lit(" para o cargo de "), F.lower("c_mktsegment"), F.lit(".")).alias("text"))
    return X.acts_for_names(texts, t.customer.select(F.col("c_custkey").alias("person_id"), F.concat(F.lit("Ana "), word).alias("name")))


@query()
def x13_heads_from_pages(t):
    return X.heads_from_pages(t.pages, r"\bthe\b|\bder\b|\bla\b")


@query()
def x15_page_links(t):
    return X.page_links(t.pages)


@query("SELECT doc_id, CASE WHEN length(s) BETWEEN 40 AND 260 THEN s ELSE left(text, 220) END AS snippet FROM (SELECT doc_id, text, regexp_extract(text, '(?s)^(.*?[.!?])(?:\\s|$)', 1) AS s FROM documents)")
def x17_snippet(t):
    return t.documents.select("doc_id", X.snippet(F.col("text")).alias("snippet"))


@query("WITH m AS (SELECT doc_id, doc_id % 13 AS id, DATE '2024-01-31' - CAST(doc_id % 120 AS INTEGER) AS date FROM documents) SELECT id, count(DISTINCT doc_id) AS n FROM m WHERE id <> 5 AND DATE '2024-01-31' - date BETWEEN 0 AND 89 GROUP BY id")
def x18_mentions(t):
    links = t.documents.select("doc_id", (F.col("doc_id") % 13).alias("id"))
    dates = t.documents.select("doc_id", F.date_sub(F.lit(AS_OF).cast("date"), (F.col("doc_id") % 120).cast("int")).alias("date"))
    return X.mentions(links, dates, [5], AS_OF)


# Sources and sinks ----------------------------------------------------------


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def s10_api_json(t):
    docs = t.events.select(F.to_json(F.struct(F.array(F.struct("event_id", F.from_json("props", "k int")["k"].alias("k"))).alias("data"))).alias("body"))
    return S.from_api_json(docs, "body", "data array<struct<event_id: bigint, k: int>>", "data")


@query("SELECT strftime(m, '%Y%m') AS month FROM (SELECT CAST(m AS TIMESTAMP) AS m FROM generate_series(DATE '2001-06-01', DATE '2002-03-01', INTERVAL 1 MONTH) g(m)) WHERE strftime(m, '%Y%m') NOT IN (SELECT strftime(l_shipdate, '%Y%m') FROM lineitem)")
def s8_missing_months(t):
    return S.read_months(t.lineitem.select(F.date_format("l_shipdate", "yyyyMM").alias("ym")), "ym", "200106", "200203")[1]


@query("SELECT CAST(event_id AS VARCHAR) AS event_id, event_type AS kind FROM events")
def s5_resolve_columns(t):
    return S.resolve_columns(t.events.select(F.col("event_id").cast("string").alias("Nº do Evento"), F.col("event_type").alias("TIPO DE EVENTO (código)")), {"event_id": ["numero evento", "n do evento", "no do evento"], "kind": ["tipo de evento"]}, prefix=True)


@query("SELECT event_id, sha1(event_type || '|' || CAST(CAST(ts AS DATE) AS VARCHAR) || '|' || event_id || '|' || user_id) AS guid FROM events ORDER BY CAST(ts AS DATE) DESC, guid LIMIT 100")
def s17_feed(t):
    c = t.events.select(F.col("event_type").alias("kind"), F.to_date("ts").alias("date"), F.col("event_id").alias("subject"), F.col("user_id").alias("person"))
    return K.feed_table(c, None).select(F.col("subject").alias("event_id"), "guid")


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, replace(format('{:.2f}', c_acctbal), '.', ',') AS c_acctbal, CASE WHEN c_nationkey < 10 THEN 'sim' ELSE 'não' END AS low FROM customer")
def s14_csv_pt(t):
    return K.to_pt(t.customer.select("c_custkey", "c_name", F.format_string("%.2f", "c_acctbal").alias("c_acctbal"), (F.col("c_nationkey") < 10).alias("low"))).withColumn("c_acctbal", F.replace("c_acctbal", F.lit("."), F.lit(",")))
