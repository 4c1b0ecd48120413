"""Queries of the composed jobs: occupants, contract alerts, campaigns, meetings, news, the bundle, boards, the structure (D6, D13, D15-D17, D19-D21, S16), weeks and views."""

from __future__ import annotations

from pyspark.sql import functions as F

from lupaspark.functions import columns as C
from lupaspark.jobs import alerts as AL
from lupaspark.jobs import board as BD
from lupaspark.jobs import bundle as B
from lupaspark.jobs import campaign as CM
from lupaspark.jobs import meetings as M
from lupaspark.jobs import news as N
from lupaspark.jobs import occupants as O
from lupaspark.jobs import structure as ST
from lupaspark.operators import aggregates as A
from lupaspark.operators import graph as G
from lupaspark.operators import temporal as T
from lupaspark.sources import sinks as K
from lupaspark.session import grows, scratch
from lupaspark.plans.facts import FOLD, _forms, _norm
from lupaspark.plans.mechanisms import _WORD, _apart, _misspelt, _word
from lupaspark.plans.registry import AS_OF, CONTRACTS, LOG, ORGANS, SANCTIONS, SPENDING, money, query


def _decrees(t):
    """One text for each day and fifth of the units: the acts of the log, some with no person or no known post."""
    n, w, u = F.col("event_id") % 11, F.upper(_word(F.col("person"))), _word(F.col("unit"))
    verb = F.when(F.col("verb") == "signup", "NOMEAR").otherwise("EXONERAR")
    who = F.when(n == 3, F.lit("Comissão de Ética")).otherwise(F.concat(F.lit("MARIA "), w, F.lit(" LIMA")))
    post = F.when(n == 5, F.lit("Assessor Extraordinário")).otherwise(F.concat(F.lit("Chefe da Unidade "), u))
    act = F.concat(verb, F.lit(" "), who, F.when(F.col("verb") == "signup", ", para exercer o cargo em comissão de ").otherwise(", do cargo de "), post, F.lit(", código CCE 1.13"))
    doc = F.datediff("day", F.lit("2024-01-01").cast("date")) * 10 + F.col("unit") % 5
    acts = t.log().select(doc.cast("long").alias("doc_id"), "day", F.struct("event_id", act.alias("act")).alias("a"))
    return acts.groupBy("doc_id", "day").agg(F.concat(F.lit("O MINISTRO DE ESTADO resolve: "), F.array_join(F.transform(F.array_sort(F.collect_list("a")), lambda a: a["act"]), "; "), F.lit(".")).alias("text"))


def _posts(t):
    return t.log().select(F.col("unit").alias("post_id"), F.concat(F.lit("Chefe da Unidade "), _word(F.col("unit"))).alias("title")).distinct()


def _pages(t):
    """A third of the units have a page with a head."""
    u = F.col("unit")
    html = F.concat(F.lit("<h1>Quem é quem</h1><p>Chefe da Unidade "), _word(u), F.lit("</p><p>Ana W"), _word(u), F.lit(" Costa</p><p>Galeria de ex-chefes</p><p>Rui Reis</p>"))
    return t.log().select("unit").distinct().where(u % 3 == 0).select(u.alias("page_id"), html.alias("html"))


_TENURES = f"""l AS (SELECT unit AS post_id, 'maria ' || {_WORD.format('person')} || ' lima' AS person, verb, day FROM {LOG} x WHERE event_id % 11 NOT IN (3, 5)),
 en AS (SELECT DISTINCT post_id, person, day AS start FROM l WHERE verb = 'signup'), le AS (SELECT *, lead(start) OVER (PARTITION BY post_id ORDER BY start, person) AS nxt FROM en),
 sp AS (SELECT post_id, person, start, coalesce(least((SELECT min(day) FROM l WHERE verb = 'error' AND l.post_id = le.post_id AND l.person = le.person AND l.day >= le.start), nxt), DATE '9999-12-31') AS stop FROM le),
 r AS (SELECT *, max(stop) OVER (PARTITION BY post_id, person ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM sp),
 i AS (SELECT *, sum(CASE WHEN reach IS NULL OR start - reach > 31 THEN 1 ELSE 0 END) OVER (PARTITION BY post_id, person ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS island FROM r),
 tn AS (SELECT post_id, person, min(start) AS start, max(stop) AS stop, count(*) AS spans FROM i GROUP BY post_id, person, island)"""


@query(f"WITH {_TENURES} SELECT post_id, person, start, CASE WHEN stop < DATE '9999-12-31' THEN stop END AS \"end\", spans FROM tn")
def d19_tenures(t):
    return O.tenures(O.gazette_events(_decrees(t), _posts(t)))


@query(f"""WITH {_TENURES}, o AS (SELECT post_id, person, start FROM tn WHERE stop = DATE '9999-12-31'), p AS (SELECT DISTINCT unit AS post_id, 'ana w' || {_WORD.format('unit')} || ' costa' AS person FROM {LOG} x WHERE unit % 3 = 0)
 SELECT post_id, coalesce(p.person, o.person) AS person, CASE WHEN p.person IS NULL THEN o.start END AS since, CASE WHEN p.person IS NULL THEN 'gazette' ELSE 'page' END AS source FROM p FULL JOIN o USING (post_id)""")
def d19_occupants(t):
    """Who holds each unit: its page first, else the open tenure that the decrees tell."""
    return O.occupants(_decrees(t), _posts(t), _pages(t))[0]


@query(f"SELECT CASE event_id % 11 WHEN 3 THEN 'unclear name' ELSE 'no such post' END AS reason, count(*) AS n FROM {LOG} l WHERE event_id % 11 IN (3, 5) GROUP BY 1")
def d19_refusals(t):
    return O.occupants(_decrees(t), _posts(t), _pages(t))[1]


def _buyers(t):
    """Contracts whose buyers are known by a code, by a name in several forms, or not at all; and the nodes."""
    w = lambda c: _word(c)
    nodes = t.nation.select(F.col("n_nationkey").cast("long").alias("id"), F.concat(F.lit("Secretaria de Obras de "), w(F.col("n_nationkey"))).alias("name"), F.concat(F.lit("SO"), F.upper(F.substring(w(F.col("n_nationkey")), 1, 6))).alias("sigla"))
    n = F.col("contract") % 4
    name, sigla = F.concat(F.lit("Secretaria de Obras de "), w(F.col("buyer"))), F.concat(F.lit("SO"), F.upper(F.substring(w(F.col("buyer")), 1, 6)))
    raw = F.when(n == 0, F.upper(name)).when(n == 1, F.concat(sigla, F.lit(" - setor de compras"))).when(n == 2, F.concat(name, F.lit(" Ltda"))).otherwise("Outro Comprador Qualquer")
    contracts = t.contracts().select("contract", "firm_key", "signed", "value", F.concat(F.lit("c"), "buyer").alias("buyer_code"), raw.alias("buyer_name"))
    cache = t.nation.where("n_nationkey % 5 = 0").select(F.concat(F.lit("c"), "n_nationkey").alias("key"), F.col("n_nationkey").cast("long").alias("node"))
    return contracts, cache, nodes


_FOUND = f"""c AS (SELECT *, CASE WHEN buyer % 5 = 0 OR contract % 4 < 3 THEN buyer END AS node FROM {CONTRACTS} x),
 a AS (SELECT contract, c.firm_key, node, signed, value, count(DISTINCT sanction_id) AS sanctions, CASE WHEN bool_or(coalesce(CASE reach WHEN 'all' THEN true WHEN 'sanctioning_body' THEN body_key = node END, false)) THEN 'known' ELSE 'unknown' END AS reach
  FROM c JOIN {SANCTIONS} s USING (firm_key) WHERE signed >= valid_from AND (valid_to IS NULL OR signed <= valid_to) AND category <> 'multa' AND coalesce(CASE reach WHEN 'all' THEN true WHEN 'sanctioning_body' THEN body_key = node END, true) GROUP BY ALL)"""


@query(f"""WITH {_FOUND}, t AS (SELECT firm_key, count(*) AS alerts, sum(value) AS volume FROM a GROUP BY 1)
 SELECT firm_key, contract, node, signed, CAST(value AS DOUBLE) AS value, sanctions, reach, CAST(rank AS INTEGER) AS rank, alerts, CAST(volume AS DOUBLE) AS volume FROM (SELECT *, row_number() OVER (PARTITION BY firm_key ORDER BY signed DESC, contract) AS rank FROM a) JOIN t USING (firm_key) WHERE rank <= 3""")
def d6_contract_alerts(t):
    """The newest three alerts of each supplier, buyers resolved by code or name."""
    return AL.barred_suppliers(*_buyers(t), t.sanctions()).select("firm_key", "contract", "node", "signed", *money("value"), "sanctions", "reach", "rank", "alerts", *money("volume"))


@query(f"""WITH c AS (SELECT *, CASE WHEN buyer % 5 = 0 THEN 'known code' WHEN contract % 4 = 0 THEN 'exact' WHEN contract % 4 = 1 THEN 'sigla before dash' WHEN contract % 4 = 2 THEN 'legal form' ELSE 'no match' END AS how FROM {CONTRACTS} x) SELECT how, count(*) AS n, CAST(sum(value) AS DOUBLE) AS volume FROM c GROUP BY how""")
def d6_resolution(t):
    """How buyers were found, refusals beside the matches."""
    return AL.resolved_buyers(*_buyers(t))[0].groupBy("how").agg(F.count("*").alias("n"), F.sum("value").alias("volume")).select("how", "n", *money("volume"))


def _meetings(t):
    """An event for each order: hosts named rightly, with a letter wrong or not at all; outsiders of several kinds, the organ itself among them."""
    c, k, w = F.concat, F.col("o_orderkey") % 5, _apart(F.col("o_custkey"))
    people = t.customer.select(F.col("c_custkey").alias("o_custkey"), c(F.lit("Secretaria "), F.lower("c_mktsegment"), F.lit(" "), _apart(F.col("c_custkey"))).alias("organ"))
    host = F.when(F.col("o_orderkey") % 3 == 0, c(F.lit("ANA "), F.upper(w), F.lit(" SILVA"))).when(F.col("o_orderkey") % 3 == 1, c(F.lit("Ana "), _misspelt(w), F.lit(" Silva"))).otherwise(c(F.lit("Eva "), w, F.lit(" Silva")))
    entity = F.when(k == 0, F.lit("Costa Advogados Associados")).when(k == 1, F.lit("SINDP - Sindicato dos Portos")).when((k == 2) & (F.col("o_orderkey") % 2 == 0), F.lit("SINDP - Sind. dos Portos")).when(k == 2, F.lit("Portos e Obras Ltda")).when(k == 3, F.col("organ")).otherwise("Prefeitura de Lagoa")
    html = c(F.lit("<p>Agentes públicos:</p><p>Ana (ministra) - MF</p><p>Agentes privados</p><p>Rui Reis (diretor) - "), entity, F.lit("</p>"))
    events = t.orders.join(grows(people), "o_custkey").select(F.col("o_orderkey").alias("event_id"), host.alias("host"), "organ", html.alias("html"))
    holders = people.select(F.col("o_custkey").alias("left_id"), c(F.lit("Ana "), _apart(F.col("o_custkey")), F.lit(" Silva")).alias("name"), "organ", F.lit(True).alias("is_head"))
    return events, holders


@query("""WITH m AS (SELECT o_custkey AS person, CASE WHEN o_orderkey % 5 = 0 THEN 'law firm' WHEN o_orderkey % 5 = 1 OR (o_orderkey % 5 = 2 AND o_orderkey % 2 = 0) THEN 'sector' WHEN o_orderkey % 5 = 2 THEN 'company' END AS class FROM orders WHERE o_orderkey % 3 < 2 AND o_orderkey % 5 < 3)
 SELECT person, class, count(*) AS encounters, 1::BIGINT AS entities FROM m GROUP BY ALL""")
def d15_received(t):
    return M.received(M.encounters(*_meetings(t), ["XYZ"])[0])


@query("SELECT 'no match' AS reason, count(*) AS n FROM orders WHERE o_orderkey % 3 = 2")
def d15_unknown_hosts(t):
    return M.encounters(*_meetings(t), ["XYZ"])[1]


_NEWS = f"""f AS (SELECT min(item_id) AS id, form FROM (SELECT item_id, array_to_string(list_slice(list_filter(string_split({_norm('text', 'a-z0-9')}, ' '), lambda x: x <> ''), 1, 4), ' ') AS form FROM benchmark) GROUP BY form HAVING count(DISTINCT item_id) = 1),
 d AS (SELECT doc_id, DATE '{AS_OF}' - CAST(doc_id % 200 AS INTEGER) AS date, ' ' || {_norm('text', 'a-z0-9')} || ' ' AS n, contains({FOLD.format('text')}, 'worthless') AS off FROM documents WHERE doc_id % 200 <= 180),
 x AS (SELECT DISTINCT doc_id, date, id FROM d JOIN f ON contains(n, ' ' || form || ' ') LEFT JOIN labels USING (doc_id) WHERE CASE WHEN quality IS NOT NULL THEN quality = 1 ELSE NOT off END),
 h AS (SELECT id, round(2 * count(*) FILTER (DATE '{AS_OF}' - date BETWEEN 0 AND 6) + count(*) FILTER (DATE '{AS_OF}' - date BETWEEN 0 AND 89) / 10.0, 1) AS heat, count(*) FILTER (DATE '{AS_OF}' - date BETWEEN 0 AND 89) AS mentions FROM x GROUP BY id ORDER BY heat DESC, id LIMIT 20)"""


def _news(t):
    """Documents as articles of the last two hundred days, benchmark items as entities, labels as verdicts."""
    articles = t.documents.select("doc_id", F.date_sub(F.lit(AS_OF).cast("date"), (F.col("doc_id") % 200).cast("int")).alias("date"), "text")
    return N.linked(articles, _forms(t), {"money": ["license"]}, "worthless", t.labels.select("doc_id", (F.col("quality") == 1).alias("verdict")).where("verdict is not null"), AS_OF)[0]


def _edges(t):
    return t.benchmark.select(F.lit("next").alias("type"), F.col("item_id").alias("from"), (F.col("item_id") + 1).alias("to"))


@query(f"WITH {_NEWS} SELECT id, CAST(heat AS DOUBLE) AS heat, mentions FROM h")
def d20_heat(t):
    return N.power_map(_news(t), _edges(t), ["next"], AS_OF)[0]


@query(f"WITH {_NEWS} SELECT h.id, CAST(w AS BIGINT) AS week, count(x.id) AS n FROM h CROSS JOIN range(12) g(w) LEFT JOIN x ON x.id = h.id AND floor((DATE '{AS_OF}' - x.date) / 7) = w GROUP BY ALL")
def d20_weeks(t):
    return N.power_map(_news(t), _edges(t), ["next"], AS_OF)[1]


@query(f"WITH {_NEWS} SELECT 'next' AS type, a.id AS \"from\", b.id AS \"to\" FROM h a JOIN h b ON b.id = a.id + 1")
def d20_edges(t):
    return N.power_map(_news(t), _edges(t), ["next"], AS_OF)[2]


@query(f"SELECT event_type AS kind, CAST(date_trunc('week', ts) AS DATE) AS week, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS views, CAST(any_value(last_7) AS DOUBLE) AS last_7 FROM events JOIN (SELECT event_type, coalesce(sum(CAST(value AS DECIMAL(18,2))) FILTER (DATE '{AS_OF}' - CAST(ts AS DATE) BETWEEN 0 AND 6), 0) AS last_7 FROM events GROUP BY 1) USING (event_type) GROUP BY 1, 2")
def w22_views_to_date(t):
    e = t.events.select(F.col("event_type").alias("kind"), F.to_date("ts").alias("day"), F.col("value").cast("decimal(18,2)").alias("value"))
    return T.views_to_date(e, "kind", "day", "value", AS_OF).select("kind", "week", *money("views", "last_7"))


@query(f"SELECT kind, CAST(w AS BIGINT) AS week, count(e.event_id) AS n FROM (SELECT DISTINCT event_type AS kind FROM events) CROSS JOIN range(12) g(w) LEFT JOIN events e ON event_type = kind AND floor((DATE '{AS_OF}' - CAST(ts AS DATE)) / 7) = w GROUP BY ALL")
def w12_every_week(t):
    """Twelve weeks of each kind, those without events too."""
    e = t.events.select(F.col("event_type").alias("kind"), F.to_date("ts").alias("day"))
    return T.every_week(T.weekly_counts(e, ["kind"], "day", AS_OF), e, ["kind"])


def _candidacies(t):
    """Two years of each customer: known by full name, by short name and state, with another birth, in another state, without a birth."""
    c, n, k = F.concat, F.col("c_custkey"), F.col("c_custkey") % 5
    w = _apart(n)
    birth = F.make_date(F.lit(1950) + (n % 30).cast("int"), F.lit(1), F.lit(1))
    people = t.customer.select(n.alias("person_id"), c(F.lit("Ana "), w, F.lit(" Silva")).alias("name"), w.alias("short"), F.col("c_nationkey").alias("uf"), birth.alias("birth"))
    full = F.when(k.isin(0, 2, 4), c(F.lit("ANA "), F.upper(w), F.lit(" DA SILVA"))).otherwise(c(F.lit("Outra "), w, F.lit(" Pessoa")))
    cands = t.customer.select((n * 10).alias("id"), full.alias("name"), w.alias("short"), F.when(k == 3, F.col("c_nationkey") + 100).otherwise(F.col("c_nationkey")).alias("uf"), F.when(k == 2, F.date_add(birth, 1)).when(k != 4, birth).alias("birth"), F.explode(F.array(F.lit(2018), F.lit(2022))).alias("year"))
    return cands.withColumn("cand_id", F.col("id") + F.when(F.col("year") == 2022, 1).otherwise(0)).drop("id"), people


_CANDS = "m AS (SELECT c_custkey AS person_id, CASE c_custkey % 5 WHEN 0 THEN 'full name' WHEN 4 THEN 'full name' WHEN 1 THEN 'short name and state' WHEN 2 THEN 'birth differs' ELSE 'unique short name' END AS how FROM customer)"


@query(f"WITH {_CANDS} SELECT how, year, count(*) AS n, count(CASE WHEN how <> 'birth differs' THEN person_id END) AS people FROM m, (VALUES (2018), (2022)) y(year) GROUP BY ALL")
def d13_people(t):
    cands, people = _candidacies(t)
    return CM.people_of(cands, people).groupBy("how", "year").agg(F.count("*").alias("n"), F.count_distinct("person_id").alias("people"))


@query(f"""WITH {_CANDS}, a AS (SELECT o_custkey AS person_id, CASE WHEN o_orderkey % 2 = 0 THEN 2018 ELSE 2022 END AS year, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS v FROM orders JOIN m ON m.person_id = o_custkey WHERE how <> 'birth differs' GROUP BY ALL),
 e AS (SELECT person_id, min(year) AS first_year, max(year) AS last_year, min_by(v, year) AS f, max_by(v, year) AS l, min_by(CAST(v AS DOUBLE) * 150.0 / CASE year WHEN 2018 THEN 100.0 ELSE 130.0 END, year) AS r0, max_by(CAST(v AS DOUBLE) * 150.0 / CASE year WHEN 2018 THEN 100.0 ELSE 130.0 END, year) AS r1 FROM a GROUP BY 1)
 SELECT person_id, first_year, last_year, CAST(f AS DOUBLE) AS first, CAST(l AS DOUBLE) AS last, round_even((CAST(l AS DOUBLE) - CAST(f AS DOUBLE)) * 100 / CAST(f AS DOUBLE), 1) AS nominal_pct, round_even((r1 - r0) * 100 / r0, 1) AS real_pct FROM e""")
def d13_assets(t):
    assets = t.orders.select((F.col("o_custkey") * 10 + F.col("o_orderkey") % 2).alias("cand_id"), F.col("o_totalprice").cast("decimal(18,2)").alias("value"))
    prices = t.spark.createDataFrame([(2018, 100.0), (2022, 130.0)], "year int, idx double")
    return CM.assets_over_time(CM.people_of(*_candidacies(t)), assets, prices, 150.0).select("person_id", "first_year", "last_year", *money("first", "last"), "nominal_pct", "real_pct")


@query(f"""WITH {_CANDS}, d AS (SELECT o_custkey AS person_id, l_suppkey AS donor, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS v FROM orders JOIN m ON m.person_id = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE how <> 'birth differs' GROUP BY ALL),
 s AS (SELECT person_id, round_even(CAST(sum(v) FILTER (r <= 5) AS DOUBLE) / CAST(sum(v) AS DOUBLE), 4) AS top_share FROM (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY v DESC, donor) AS r FROM d) GROUP BY 1),
 n AS (SELECT person_id, count(*) AS donors FROM d WHERE donor % 2 = 1 OR v >= 50000 GROUP BY 1), p AS (SELECT DISTINCT o_custkey AS person_id, o_orderkey % 100 AS donor FROM orders), b AS (SELECT person_id, count(*) AS donor_payees FROM d JOIN p USING (person_id, donor) GROUP BY 1)
 SELECT person_id, coalesce(donors, 0) AS donors, top_share, coalesce(donor_payees, 0) AS donor_payees FROM s LEFT JOIN n USING (person_id) LEFT JOIN b USING (person_id)""")
def d13_donors(t):
    given = t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey")).select((F.col("o_custkey") * 10 + F.col("o_orderkey") % 2).alias("cand_id"), F.col("l_suppkey").alias("donor"), F.when(F.col("l_suppkey") % 2 == 0, "individual").otherwise("company").alias("kind"), F.col("l_extendedprice").cast("decimal(18,2)").alias("value"))
    payees = t.orders.select(F.col("o_custkey").alias("person_id"), (F.col("o_orderkey") % 100).alias("payee"))
    return CM.donors_of(CM.people_of(*_candidacies(t)), given, payees, 50000)


def _bundle(t):
    """The twelve tables from the organs, the customers as people, the log as changes and the money facts."""
    organs = t.organs()
    explicit = t.spark.createDataFrame([], "type string, from string, to string, note string")
    none = [F.lit(None).cast("string").alias(c) for c in ("head_of", "appointed_by", "confirmed_by", "nominated_by")]
    people = t.customer.select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("party"), F.col("c_nationkey").cast("string").alias("uf"))
    seats = t.supplier.select(F.concat(F.lit("s"), "s_suppkey").alias("post_id"), F.col("s_name").alias("post"), (F.col("s_suppkey") % 50).cast("string").alias("person_id"), F.col("s_suppkey").alias("seat"))
    spending = t.spending()
    parts = {
        "nodes": organs.withColumnRenamed("kind", "type"), "links": G.derive_edges(organs.select("id", "parent", *none), explicit).withColumn("cite", F.col("note")), "people": people, "occupants": seats,
        "changes": t.log().select(F.col("day").alias("date"), F.col("verb").alias("kind"), F.col("person").cast("string").alias("person"), F.col("unit").cast("string").alias("post_id")),
        "revenue": A.sum_by(spending, ["year"], ["paid"]).select("year", F.col("paid").alias("value")),
        "amendments": A.sum_by(spending.withColumn("id", F.col("org").cast("string")), ["id", "year"], ["committed", "paid"]),
        "travel": spending.groupBy(F.col("org").cast("string").alias("id")).agg(F.count("*").alias("trips"), F.sum("paid").alias("total"), F.count_if(F.col("dest") == "F").alias("abroad")),
    }
    return B.tables(parts)


@query(f"""SELECT 'nodes' AS "table", count(*) AS rows, 9 AS columns FROM {ORGANS} o UNION ALL SELECT 'links', count(*), 4 FROM {ORGANS} o WHERE parent IS NOT NULL UNION ALL SELECT 'people', count(*), 5 FROM customer UNION ALL SELECT 'occupants', count(*), 11 FROM supplier
 UNION ALL SELECT 'changes', count(*), 7 FROM {LOG} l UNION ALL SELECT 'inaction', 0, 4 UNION ALL SELECT 'topics', 0, 3 UNION ALL SELECT 'revenue', count(DISTINCT year), 3 FROM {SPENDING} s
 UNION ALL SELECT 'amendments', count(*), 5 FROM (SELECT DISTINCT org, year FROM {SPENDING} s JOIN customer ON c_custkey = org) UNION ALL SELECT 'offices', 0, 6 UNION ALL SELECT 'assets', 0, 8 UNION ALL SELECT 'travel', count(DISTINCT org), 5 FROM {SPENDING} s JOIN customer ON c_custkey = org""")
def s16_bundle(t):
    """The bundle written, and its manifest."""
    return K.write_bundle(_bundle(t), scratch(t.spark, "bundle"))


@query("""SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, c_mktsegment AS party, CAST(c_nationkey AS VARCHAR) AS uf, p AS posts FROM customer LEFT JOIN (SELECT s_suppkey % 50 AS id, string_agg(s_name, ' | ' ORDER BY s_suppkey) AS p FROM supplier GROUP BY 1) s ON s.id = c_custkey""")
def s16_people(t):
    return _bundle(t)["people"]


@query(f"""SELECT CAST(org AS VARCHAR) AS id, c_name AS name, year, CAST(sum(committed) AS DOUBLE) AS committed, CAST(sum(paid) AS DOUBLE) AS paid FROM {SPENDING} s JOIN customer ON c_custkey = org GROUP BY ALL""")
def s16_amendments(t):
    return _bundle(t)["amendments"].select("id", "name", "year", *money("committed", "paid"))


@query(f"""WITH c AS (SELECT *, CAST(CASE WHEN signed + 120 < DATE '1998-01-01' - 30 THEN 'long overdue' WHEN signed + 120 < DATE '1998-01-01' THEN 'overdue' ELSE 'open' END AS VARCHAR) AS s FROM {CONTRACTS} x WHERE status <> 'F')
 SELECT buyer AS post, CASE WHEN contract % 50 = 0 THEN 'suspended' ELSE s END AS state, n_name AS responsible, count(*) AS n, min(signed + 120) AS oldest_due FROM c JOIN nation ON n_nationkey = buyer GROUP BY ALL""")
def d16_open_items(t):
    """Contracts as items: closed by the text of their outcome, suspended now and then, answered for by the post's first holder who does not act for another."""
    outcome = F.when(F.col("status") == "F", "Arquivado por decisão terminativa").when(F.col("status") == "O", "Em andamento")
    items = t.contracts().select(F.col("contract").alias("item_id"), F.col("buyer").alias("post"), F.col("signed").alias("opened"), (F.col("contract") % 50 == 0).alias("suspended"), outcome.alias("outcome"))
    one = t.nation.select(F.col("n_nationkey").cast("long").alias("post"), F.lit(2).alias("seat"), F.col("n_name").alias("name"), F.lit(False).alias("acting"))
    occupants = one.unionByName(one.withColumns({"seat": F.lit(1), "acting": F.lit(True), "name": F.lit("interino")})).unionByName(one.withColumns({"seat": F.lit(3), "name": F.lit("outro")}))
    return BD.open_items(items, occupants, "1998-01-01", 120).groupBy("post", "state", "responsible").agg(F.count("*").alias("n"), F.min("due").alias("oldest_due"))


@query(f"""WITH p AS (SELECT contract, signed + CAST(contract % 200 AS INTEGER) AS moved, status = 'F' AS closed, signed + 120 AS deadline, CASE decision WHEN '1-URGENT' THEN ['urgent'] WHEN '5-LOW' THEN ['calm'] WHEN '4-NOT SPECIFIED' THEN ['calm', 'vague'] END AS ts FROM {CONTRACTS} x),
 q AS (SELECT unnest(ts) AS topic, * FROM p), k AS (SELECT topic, count(q.topic) FILTER (q.contract IS NOT NULL) AS n, bool_and(closed) AS all_closed, max(moved) AS last, min(deadline) FILTER (NOT closed) AS due FROM (VALUES ('urgent'), ('calm'), ('vague'), ('absent')) v(topic) LEFT JOIN q USING (topic) GROUP BY topic),
 w AS (SELECT event_type AS topic, date_trunc('week', ts) AS week, sum(CAST(value AS DECIMAL(18,2))) AS v FROM events GROUP BY ALL)
 SELECT topic, CASE WHEN n = 0 THEN 'none' WHEN all_closed THEN 'closed' WHEN due < DATE '1998-06-01' THEN 'overdue' WHEN DATE '1998-06-01' - last <= 30 THEN 'moving' ELSE 'stalled' END AS state, CAST(DATE '1998-06-01' - last AS INTEGER) AS days_still, CAST(NULL AS DOUBLE) AS peak, CAST(NULL AS BOOLEAN) AS silent FROM k""")
def d16_topics(t):
    words = {"urgent": ["urgent"], "calm": ["low", "not specified"], "vague": ["specified"], "absent": ["nada consta"]}
    p = t.contracts().select(F.col("contract").alias("process"), F.concat(F.lit("Projeto "), "decision").alias("title"), F.expr("date_add(signed, cast(contract % 200 as int))").alias("moved"), (F.col("status") == "F").alias("closed"), F.date_add("signed", 120).alias("deadline"))
    views = t.events.select(F.col("event_type").alias("topic"), F.to_date("ts").alias("date"), F.col("value").cast("decimal(18,2)").alias("value"))
    return BD.topics(p, words, views, "1998-06-01").select("topic", "state", "days_still", *money("peak"), "silent")


@query("""WITH o AS (SELECT l_orderkey AS o, 10 * sum(CAST(l_quantity AS BIGINT)) AS v FROM lineitem GROUP BY 1), w AS (SELECT 'f' || (o % 30) AS function, CAST(sum(v) AS BIGINT) AS waived FROM o GROUP BY 1), b AS (SELECT s_nationkey AS ministry, sum(CAST(s_acctbal AS DECIMAL(18,2))) AS budget FROM supplier GROUP BY 1)
 SELECT function, waived, CASE WHEN n < 25 THEN n END AS ministry, CAST(budget AS DOUBLE) AS budget, round_even(CAST(waived AS DOUBLE) / CAST(budget AS DOUBLE), 4) AS ratio FROM (SELECT *, CAST(substr(function, 2) AS BIGINT) AS n FROM w) LEFT JOIN b ON ministry = n ORDER BY waived DESC, function LIMIT 12""")
def d17_waived(t):
    """Orders as functions of a sheet each followed by its lines, one sheet an order; ministries by number."""
    lines = t.lineitem.select(F.col("l_orderkey").alias("section"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).cast("long").alias("n"), F.lit("item").alias("label"), (F.col("l_quantity").cast("long") * 10).alias("value"))
    heads = lines.groupBy("section").agg(F.sum("value").alias("value")).select("section", F.lit(0).cast("long").alias("n"), F.concat(F.lit("f"), F.col("section") % 30).alias("label"), "value")
    ministries = t.nation.select(F.concat(F.lit("f"), "n_nationkey").alias("function"), F.col("n_nationkey").cast("long").alias("ministry"))
    budgets = t.supplier.groupBy(F.col("s_nationkey").cast("long").alias("ministry")).agg(F.sum(F.col("s_acctbal").cast("decimal(18,2)")).alias("budget"))
    return BD.waived(heads.unionByName(lines), ministries, budgets)[0].select("function", "waived", "ministry", *money("budget"), "ratio")


def _registry(t):
    """Regions above nations above departments above suppliers; departments are no organs; suppliers share ids and names."""
    row = lambda code, id_, above, name, nature, organ: [code.alias("code"), id_.alias("id"), above.alias("above"), name.alias("name"), F.lit(nature).alias("nature"), F.lit(organ).alias("is_organ")]
    c = F.concat
    r = t.region.select(*row(c(F.lit("r"), "r_regionkey"), c(F.lit("region-"), "r_regionkey"), F.lit(None).cast("string"), F.col("r_name"), "Órgão constitucional", True))
    n = t.nation.select(*row(c(F.lit("n"), "n_nationkey"), c(F.lit("nation-"), "n_nationkey"), c(F.lit("r"), "n_regionkey"), F.col("n_name"), "Autarquia", True))
    d = t.nation.select(*row(c(F.lit("d"), "n_nationkey"), c(F.lit("department-"), "n_nationkey"), c(F.lit("n"), "n_nationkey"), F.lit("Departamento"), "Departamento", False))
    s = t.supplier.select(*row(c(F.lit("s"), F.lpad(F.col("s_suppkey").cast("string"), 8, "0")), c(F.lit("division-"), F.col("s_suppkey") % 10), c(F.lit("d"), "s_nationkey"), c(F.lit("Divisão "), F.col("s_suppkey") % 10), "Fundação", True))
    curated = t.nation.where("n_nationkey % 3 = 0").select(c(F.lit("nation-"), "n_nationkey").alias("id"), c(F.lit("Nação "), "n_nationkey").alias("name"), F.lit(None).cast("string").alias("nature"), F.array(F.col("n_name")).alias("aliases"))
    return r.unionByName(n).unionByName(d).unionByName(s), curated


@query("""WITH s AS (SELECT s_suppkey AS k, s_nationkey AS nk, 's' || lpad(CAST(s_suppkey AS VARCHAR), 8, '0') AS code, 'division-' || (s_suppkey % 10) AS i, row_number() OVER (PARTITION BY s_suppkey % 10 ORDER BY s_suppkey) AS r, count(*) OVER (PARTITION BY s_suppkey % 10) AS c FROM supplier),
 n AS (SELECT n_nationkey AS nk, CASE WHEN n_nationkey % 3 = 0 THEN 'Nação ' || n_nationkey ELSE n_name END AS name FROM nation)
 SELECT 'region-' || r_regionkey AS id, 'r' || r_regionkey AS code, r_name AS name, NULL AS parent, NULL AS how, 'generated' AS origin, 0::BIGINT AS depth, 1 AS ring, false AS cyclic FROM region
 UNION ALL SELECT 'nation-' || n_nationkey, 'n' || n_nationkey, n.name, 'region-' || n_regionkey, 'direct', CASE WHEN n_nationkey % 3 = 0 THEN 'both' ELSE 'generated' END, 1, 2, false FROM nation JOIN n ON nk = n_nationkey
 UNION ALL SELECT CASE WHEN r = 1 THEN i ELSE i || '-' || code END, code, 'Divisão ' || (k % 10) || CASE WHEN c > 1 THEN ' – ' || n.name ELSE '' END, 'nation-' || nk, 'through unit', 'generated', 2, 3, false FROM s JOIN n USING (nk)""")
def d21_organs(t):
    return ST.structure(*_registry(t), {"constitucional": 1, "autarquia": 2, "fundacao": 3})


@query(f"""WITH {_TENURES}, w AS (SELECT post_id AS unit, person, start, stop, spans, lead(stop) OVER (PARTITION BY post_id ORDER BY start DESC, person) AS prior, row_number() OVER (PARTITION BY post_id ORDER BY start DESC, person) AS n FROM tn)
 SELECT unit, person, start, CASE WHEN stop < DATE '9999-12-31' THEN stop END AS "end", spans, CASE WHEN prior IS NULL OR prior = DATE '9999-12-31' THEN true ELSE start - prior > 365 END AS missing_predecessor FROM w WHERE stop >= DATE '2024-01-15' AND n <= 40""")
def d21_history(t):
    """Tenures of the units as their history, none of the present holders lacking."""
    terms = O.tenures(O.gazette_events(_decrees(t), _posts(t))).select(F.col("post_id").alias("unit"), "person", "start", "end")
    spans = O.tenures(O.gazette_events(_decrees(t), _posts(t)))
    return ST.history(terms, terms.where("end is null"), "2024-01-15").drop("spans").join(spans.select(F.col("post_id").alias("unit"), "person", "start", "spans"), ["unit", "person", "start"])
