"""Queries of folds, walks, sweeps, doublings, indexes and streams with state (W23, X9, X13, J15, J24, J34, A9, A12, I5, I6, N2-N4), and of the functions registered by name."""

from __future__ import annotations

from pyspark.sql import functions as F

from lupaspark.functions import registration
from lupaspark.operators import gazette as Z
from lupaspark.operators import graph as G
from lupaspark.operators import people as P
from lupaspark.operators import rules as L
from lupaspark.operators import segments as SG
from lupaspark.operators import selection as SEL
from lupaspark.operators import temporal as T
from lupaspark.plans.registry import SPENDING, query
from lupaspark.session import scratch, ship
from lupaspark.streaming import state as STATE

#: A word of letters of its own for each number, far from any other: the hex digits of its MD5 as letters.
HEX, LETTERS = "0123456789abcdef", "bcdfghjklmnpqrst"
_WORD = f"translate(substr(md5(CAST({{}} AS VARCHAR)), 1, 8), '{HEX}', '{LETTERS}')"


def _word(c):
    return F.translate(F.substring(F.md5(c.cast("string")), 1, 8), HEX, LETTERS)


def _apart(c):
    """A word for each whole number, at least three edits from that of any other: its digits as letters, each three times. Eight hex digits of MD5 stand for two numbers among some ten thousands."""
    return F.concat(F.lit("qu"), F.regexp_replace(F.translate(c.cast("string"), "-0123456789", "nbcdfghjklm"), "(.)", "$1$1$1"))


def _misspelt(w):
    """Its last letter another one."""
    return F.concat(F.substring(w, F.lit(1), F.length(w) - 1), F.lit("z"))


_SHEET = """r AS (SELECT o_custkey AS section, o_orderkey AS o, 0 AS l, 0 AS x, 'o' || o_orderkey AS label, v FROM orders JOIN (SELECT l_orderkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS v FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE o_orderkey % 7 <> 0
  UNION ALL SELECT o_custkey, l_orderkey, l_linenumber, l_partkey, 'i' || l_orderkey || '-' || l_linenumber, CAST(l_quantity AS BIGINT) FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


@query(f"""WITH RECURSIVE {_SHEET}, p AS (SELECT *, row_number() OVER w AS n, sum(v) OVER w AS s, greatest(1.0, v * 1e-6) AS slack FROM r WINDOW w AS (PARTITION BY section ORDER BY o, l, x, v)),
 f AS (SELECT a.section, a.n, min(b.n) AS j FROM p a JOIN p b ON a.section = b.section AND b.n > a.n AND b.s - a.s >= a.v - a.slack GROUP BY ALL),
 m AS (SELECT p.*, CASE WHEN b.s - p.s <= p.v + p.slack THEN f.j END AS j FROM p LEFT JOIN f USING (section, n) LEFT JOIN p b ON b.section = p.section AND b.n = f.j),
 k AS (SELECT section, n, j, label FROM m WHERE n = 1 UNION ALL SELECT m.section, m.n, m.j, m.label FROM k JOIN m ON m.section = k.section AND m.n = coalesce(k.j, k.n) + 1)
 SELECT m.section, m.label, m.v AS value, c.label AS parent, CAST(k.j - k.n AS INTEGER) AS items FROM m LEFT JOIN k ON k.section = m.section AND k.n = m.n LEFT JOIN k c ON c.section = m.section AND c.j IS NOT NULL AND m.n > c.n AND m.n <= c.j""")
def w23_segments(t):
    """Orders as rows of a sheet, each followed by its lines, one order in seven without a row of its own; sections are customers."""
    o = t.orders.select("o_orderkey", F.col("o_custkey").alias("section"))
    lines = t.lineitem.select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").cast("int").alias("l"), F.col("l_partkey").alias("x"), F.col("l_quantity").cast("long").alias("value"))
    heads = lines.groupBy("o").agg(F.sum("value").alias("value")).where("o % 7 <> 0").select("o", F.lit(0).alias("l"), F.lit(0).cast("long").alias("x"), F.concat(F.lit("o"), "o").alias("label"), "value")
    rows = heads.unionByName(lines.select("o", "l", "x", F.concat(F.lit("i"), "o", F.lit("-"), "l").alias("label"), "value")).join(o, F.col("o") == F.col("o_orderkey")).drop("o_orderkey")
    return SG.segment_by_sum(rows, "section", ["o", "l", "x", "value"], "label", "value").select("section", "label", "value", "parent", "items")


_UP = f"upper({_WORD.format('c_custkey')})"


@query(f"""WITH c AS (SELECT c_custkey AS doc_id, c_custkey % 6 AS k, {_UP} AS w, lower(c_mktsegment) AS p FROM customer)
 SELECT doc_id, 0 AS act_no, 'nomear' AS verb, 'MARIA ' || w || ' SILVA' AS name, NULL::DATE AS since, p AS post, 'Ministério da Fazenda' AS organ, NULL AS reason FROM c WHERE k = 0
 UNION ALL SELECT doc_id, 1, 'nomear', 'JOSE ' || w || ' COSTA', NULL, p, 'Ministério da Fazenda', NULL FROM c WHERE k = 0 UNION ALL SELECT doc_id, 2, 'nomear', 'ANA ' || w || ' DIAS', NULL, p, 'Ministério da Fazenda', NULL FROM c WHERE k = 0
 UNION ALL SELECT doc_id, 0, 'exonerar', 'MARIA ' || w || ' SILVA', DATE '2024-03-03', p, NULL, NULL FROM c WHERE k = 1 UNION ALL SELECT doc_id, 1, 'nomear', 'JOSE ' || w || ' COSTA', NULL, p, NULL, NULL FROM c WHERE k = 1
 UNION ALL SELECT doc_id, 0, 'designar', 'MARIA ' || w || ' SILVA', NULL, p, 'Secretaria de Governo', NULL FROM c WHERE k = 2
 UNION ALL SELECT doc_id, 0, 'dispensar', 'Comissão Especial', NULL, NULL, NULL, 'unclear name' FROM c WHERE k = 3
 UNION ALL SELECT doc_id, 0, 'nomear', 'MARIA ' || w || ' SILVA', NULL, p, NULL, NULL FROM c WHERE k = 4 UNION ALL SELECT doc_id, 1, 'nomear', 'JOSE ' || w || ' COSTA', NULL, 'auditor', NULL, NULL FROM c WHERE k = 4
 UNION ALL SELECT doc_id, 0, 'nomear', 'MARIA ' || w || ' SILVA', NULL, NULL, NULL, 'no post' FROM c WHERE k = 5 UNION ALL SELECT doc_id, 1, 'exonerar', 'JOSE ' || w || ' COSTA', NULL, p, NULL, NULL FROM c WHERE k = 5""")
def x9_clause_walk(t):
    """Several people in one act, two acts in one sentence, an organ in a later clause, posts dealt out, and what is refused."""
    return Z.walk_acts(gazette_texts(t))


def gazette_texts(t):
    w, p, k = F.upper(_word(F.col("c_custkey"))), F.lower("c_mktsegment"), F.col("c_custkey") % 6
    c = F.concat
    maria, jose = c(F.lit("MARIA "), w, F.lit(" SILVA")), c(F.lit("JOSE "), w, F.lit(" COSTA"))
    text = (
        F.when(k == 0, c(F.lit("O MINISTRO resolve: NOMEAR "), maria, F.lit(", "), jose, F.lit(" e ANA "), w, F.lit(" DIAS, para exercerem o cargo de "), p, F.lit(" do Ministério da Fazenda.")))
        .when(k == 1, c(F.lit("Resolve EXONERAR, a pedido, a partir de 3 de março de 2024, a Senhora "), maria, F.lit(" do cargo de "), p, F.lit(" e NOMEAR "), jose, F.lit(" para o mesmo cargo.")))
        .when(k == 2, c(F.lit("DESIGNAR "), maria, F.lit(", Professora da Universidade Federal, matrícula 123, para exercer a função de "), p, F.lit(", código 1, da Secretaria de Governo.")))
        .when(k == 3, c(F.lit("DISPENSAR Comissão Especial, "), maria, F.lit(", da função de "), p, F.lit(".")))
        .when(k == 4, c(F.lit("NOMEAR "), maria, F.lit(" e "), jose, F.lit(" para os cargos de "), p, F.lit(" e auditor, respectivamente.")))
        .otherwise(c(F.lit("NOMEAR "), maria, F.lit(". EXONERAR "), jose, F.lit(", do cargo de "), p, F.lit(".")))
    )
    return t.customer.select(F.col("c_custkey").alias("doc_id"), text.alias("text"))


@query(f"""WITH c AS (SELECT c_custkey AS page_id, c_custkey % 4 AS k, 'Ana W' || {_WORD.format('c_custkey')} || ' Silva' AS a, 'Rui W' || {_WORD.format('c_custkey')} || ' Costa' AS b FROM customer)
 SELECT page_id, 0 AS line_no, 'Presidente' AS unit, a AS name, false AS acting FROM c WHERE k = 0 UNION ALL SELECT page_id, 2, 'Diretor substituto', b, true FROM c WHERE k = 0
 UNION ALL SELECT page_id, 1, 'Presidente', a, false FROM c WHERE k = 1 UNION ALL SELECT page_id, 3, 'Diretor', b, false FROM c WHERE k = 1
 UNION ALL SELECT page_id, 0, 'Chefe', a, false FROM c WHERE k = 3 UNION ALL SELECT page_id, 3, 'Coordenador', b, false FROM c WHERE k = 3""")
def x13_page_heads(t):
    """Names behind and before their offices, former holders behind a stop line, and two offices that ask for one name."""
    k, w = F.col("c_custkey") % 4, _word(F.col("c_custkey"))
    a, b = F.concat(F.lit("Ana W"), w, F.lit(" Silva")), F.concat(F.lit("Rui W"), w, F.lit(" Costa"))
    page = lambda tag, *lines: F.concat(*[F.concat(F.lit(f"<{tag}>"), x if not isinstance(x, str) else F.lit(x), F.lit(f"</{tag}>")) for x in lines])
    html = F.when(k == 0, page("h2", "Presidente", a, "Diretor substituto", b)).when(k == 1, page("p", a, "Presidente", b, "Diretor")).when(k == 2, page("p", "Presidente", "Telefone 123", "Galeria de ex-presidentes", a)).otherwise(page("li", "Chefe", "Sala 2", a, "Coordenador", b))
    return Z.page_heads(t.customer.select(F.col("c_custkey").alias("page_id"), html.alias("html")))


@query(f"""WITH c AS (SELECT c_custkey AS n, c_custkey % 7 AS k FROM customer)
 SELECT n AS left_id, CASE WHEN k IN (0, 1, 2, 5) THEN n * 2 WHEN k = 6 THEN n * 2 + 1 END AS right_id, CASE k WHEN 0 THEN 'exact' WHEN 1 THEN 'subsequence' WHEN 2 THEN 'subsequence' WHEN 5 THEN 'fuzzy' WHEN 6 THEN 'subsequence' END AS mode,
  CASE WHEN k IN (0, 1, 2, 5, 6) THEN 1.0 END AS organ, CASE k WHEN 3 THEN 'no match' WHEN 4 THEN 'homonyms' END AS reason FROM c""")
def j15_aligned_person(t):
    """The same name; one letter wrong; a surname more; another first name; two people of whom no organ tells; another last word on either side; two of whom the organ tells."""
    n, k, w = F.col("c_custkey"), F.col("c_custkey") % 7, _apart(F.col("c_custkey"))
    c = F.concat
    organ = c(F.lit("Secretaria "), F.lower("c_mktsegment"))
    left = t.customer.select(n.alias("left_id"), F.when(k == 5, c(F.lit("Ana "), w, F.lit(" Silva da Lima"))).otherwise(c(F.lit("Ana "), w, F.lit(" Silva"))).alias("name"), organ.alias("organ"), F.lit(True).alias("is_head"))
    one = F.when(k == 0, c(F.lit("ANA "), w, F.lit(" SILVA"))).when(k == 1, c(F.lit("Ana "), _misspelt(w), F.lit(" Silva"))).when(k == 2, c(F.lit("Ana "), w, F.lit(" de Souza Silva"))).when(k == 3, c(F.lit("Eva "), w, F.lit(" Silva"))).when(k == 5, c(F.lit("Ana "), w, F.lit(" Silva Rocha"))).otherwise(c(F.lit("Ana "), w, F.lit(" Costa Silva")))
    two = c(F.lit("Ana "), w, F.lit(" Dias Silva"))
    theirs = F.when(k.isin(4, 6), F.lit("Banco Central")).otherwise(organ)
    rows = lambda id_, name, o: [id_.alias("right_id"), name.alias("name"), o.alias("organ"), F.lit(None).cast("date").alias("ended"), F.lit(False).alias("is_top"), F.lit(True).alias("titular"), F.lit("2024-01-01").cast("date").alias("start")]
    right = t.customer.select(*rows(n * 2, one, theirs)).unionByName(t.customer.where(k.isin(4, 6)).select(*rows(n * 2 + 1, two, F.when(k == 6, organ).otherwise(F.lit("Banco Central")))))
    return P.aligned_person(left, right)


_RULES = [
    ("teens", "glob", "p-*-Brand#1?"), ("rings", "name", "ring$|^red .*et$"), ("rings", "subtype", "ECONOMY"), ("rings", "subtype", "STANDARD"), ("rings", "except", "p-0-Brand#2"),
    ("first", "id", "p-1-Brand#17"), ("first", "id", "p-none"), ("wide", "glob", "*-*"), ("odd", "name", "no such name"), ("promo", "subtype", "PROMO"), ("promo", "name", "wid(get|ow)"),
]


@query("""WITH t AS (SELECT 'p-' || p_partkey || '-' || p_brand AS id, p_name AS name, p_type AS subtype FROM part),
 c AS (SELECT id, 'teens' AS family FROM t WHERE id GLOB 'p-*-Brand#1?' UNION SELECT id, 'rings' FROM t WHERE subtype IN ('ECONOMY', 'STANDARD') AND regexp_matches(name, 'ring$|^red .*et$') AND id <> 'p-0-Brand#2'
  UNION SELECT id, 'first' FROM t WHERE id = 'p-1-Brand#17' UNION SELECT id, 'promo' FROM t WHERE subtype = 'PROMO' AND regexp_matches(name, 'wid(get|ow)')), n AS (SELECT id, count(*) AS n, string_agg(family, ',' ORDER BY family) AS families FROM c GROUP BY id),
 r AS (SELECT * FROM (VALUES ('first', 'id', 'p-1-Brand#17', (SELECT count(*) FROM t WHERE id = 'p-1-Brand#17')), ('first', 'id', 'p-none', 0), ('rings', 'except', 'p-0-Brand#2', (SELECT count(*) FROM t WHERE id = 'p-0-Brand#2')), ('rings', 'subtype', 'ECONOMY', (SELECT count(*) FROM t WHERE subtype = 'ECONOMY')),
  ('rings', 'subtype', 'STANDARD', (SELECT count(*) FROM t WHERE subtype = 'STANDARD')), ('promo', 'subtype', 'PROMO', (SELECT count(*) FROM t WHERE subtype = 'PROMO'))) v(family, kind, pattern, met) WHERE met = 0)
 SELECT id AS subject, families AS family, CASE WHEN n = 1 THEN 'claimed' ELSE 'claimed twice' END AS outcome FROM n UNION ALL SELECT pattern, family, CASE kind WHEN 'id' THEN 'no such id' WHEN 'except' THEN 'no such id to leave out' ELSE 'no target of this subtype' END FROM r
 UNION ALL SELECT '*-*', 'wide', 'no 3 letters are required' UNION ALL SELECT 'no such name', 'odd', 'pattern meets no target'""")
def j34_rule_claims(t):
    targets = t.part.select(F.concat(F.lit("p-"), "p_partkey", F.lit("-"), "p_brand").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("subtype"))
    one, twice, errors = L.rule_claims(targets, t.spark.createDataFrame(_RULES, "family string, kind string, pattern string"))
    return one.select(F.col("id").alias("subject"), "family", F.lit("claimed").alias("outcome")).unionByName(twice.select(F.col("id").alias("subject"), F.col("families").alias("family"), F.lit("claimed twice").alias("outcome"))).unionByName(errors.select(F.col("pattern").alias("subject"), "family", F.col("error").alias("outcome")))


@query("""WITH s AS (SELECT o_orderkey AS holder, CAST(o_orderdate AS DATE) AS since, CASE WHEN o_orderkey % 97 <> 0 THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 90 AS INTEGER) END AS until FROM orders), d AS (SELECT CAST(l_shipdate AS DATE) AS day, count(*) AS n FROM lineitem GROUP BY 1)
 SELECT day, CAST(max({'s': since, 'h': holder}).h AS BIGINT) AS holder, any_value(n) AS n FROM d LEFT JOIN s ON day >= since AND (until IS NULL OR day <= until) GROUP BY day""")
def j24_sweep(t):
    """As many spans as orders, some open, and every day of shipping."""
    d = F.to_date("o_orderdate")
    spans = t.orders.select(F.col("o_orderkey").alias("holder"), d.alias("since"), F.when(F.col("o_orderkey") % 97 != 0, F.date_add(d, (F.col("o_orderkey") % 90).cast("int"))).alias("until"))
    return T.who_was(t.lineitem.select(F.to_date("l_shipdate").alias("day")), spans, "day").groupBy("day").agg(F.max("holder").alias("holder"), F.count("*").alias("n"))


@query("SELECT l_returnflag, count(*) AS n, median(l_extendedprice) AS median FROM lineitem GROUP BY 1")
def a9_split_median(t):
    return SEL.split_median(t.lineitem, ["l_returnflag"], "l_extendedprice")


@query("SELECT nation, count(*) AS n, median(days) AS median FROM (SELECT CAST(c_nationkey % 2 AS INTEGER) AS nation, CAST(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS DOUBLE) AS days FROM orders JOIN customer ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey) GROUP BY 1")
def a28_split_tenure(t):
    """Median days of two groups that hold all rows between them."""
    days = F.datediff(F.to_date("l_shipdate"), F.to_date("o_orderdate"))
    rows = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey")).select((F.col("c_nationkey") % 2).cast("int").alias("nation"), days.alias("days"))
    return SEL.split_median(rows, ["nation"], "days")


@query(f"""SELECT kind, count(*) AS items, round_even(CAST(sum(v) FILTER (r <= 5) AS DOUBLE) / CAST(sum(v) AS DOUBLE), 4) AS top_share FROM (SELECT kind, action, v, row_number() OVER (PARTITION BY kind ORDER BY v DESC, action) AS r FROM (SELECT kind, action, sum(paid) AS v FROM {SPENDING} s GROUP BY ALL)) GROUP BY kind""")
def a12_split_concentration(t):
    return SEL.split_concentration(t.spending(), ["kind"], "action", "paid", 5)


_TREE = "(SELECT p_partkey AS id, CASE WHEN p_partkey % 50 <> 0 THEN p_partkey - 1 WHEN (p_partkey // 50) % 7 = 3 THEN p_partkey + 10 END AS parent, CAST(p_partkey % 3 AS INTEGER) AS ring FROM part)"


def _tree(t):
    """Chains of fifty, one in seven of which hangs from a ring of eleven."""
    n = F.col("p_partkey")
    return t.part.select(n.alias("id"), F.when(n % 50 != 0, n - 1).when(F.floor(n / 50) % 7 == 3, n + 10).alias("parent"), (n % 3).cast("int").alias("ring"))


@query(f"""WITH RECURSIVE n AS {_TREE}, d AS (SELECT n.id, 0 AS depth, ring FROM n WHERE parent IS NULL OR parent NOT IN (SELECT id FROM n) UNION ALL SELECT n.id, d.depth + 1, greatest(n.ring, d.ring + 1) FROM d JOIN n ON n.parent = d.id)
 SELECT n.id, CAST(d.depth AS BIGINT) AS depth, CASE WHEN d.id IS NULL THEN 4 ELSE least(d.ring, 4) END AS ring, d.id IS NULL AS cyclic FROM n LEFT JOIN d USING (id)""")
def n4_any_depth(t):
    return G.depths(_tree(t))


@query(f"""WITH RECURSIVE n AS {_TREE}, c AS (SELECT id AS node, parent AS ancestor, 1 AS depth FROM n WHERE parent IS NOT NULL UNION ALL SELECT c.node, n.parent, c.depth + 1 FROM c JOIN n ON n.id = c.ancestor WHERE n.parent IS NOT NULL AND c.ancestor <> c.node AND c.depth < 70)
 SELECT node, ancestor, CAST(min(depth) AS BIGINT) AS depth FROM c WHERE node <> ancestor GROUP BY ALL""")
def n2_any_depth(t):
    return G.full_closure(_tree(t))


@query("""WITH e AS (SELECT DISTINCT o_custkey AS f, l_suppkey AS t FROM orders JOIN lineitem ON l_orderkey = o_orderkey), b AS (SELECT f AS id, 'out' AS way, t AS o FROM e UNION ALL SELECT t, 'in', f FROM e)
 SELECT id, way, count(*) AS n, string_agg(CAST(o AS VARCHAR), ',' ORDER BY o) AS neighbours, true AS small FROM b GROUP BY ALL""")
def n3_pages(t):
    """Pages put together again, and whether none was over four times its size."""
    e = t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("from"), F.col("l_suppkey").alias("to"))
    pages = G.pages_of_neighbours(e, 20)
    whole = F.array_sort(F.flatten(F.collect_list("neighbours")))
    return pages.groupBy("id", "way").agg(F.sum(F.size("neighbours")).alias("n"), F.array_join(whole, ",").alias("neighbours"), (F.max(F.size("neighbours")) <= 80).alias("small"))


def _event_stream(t):
    """The events as a stream of their files."""
    return ship(t.spark).readStream.schema(t.events.schema).parquet(f"{t.sf_dir}/[e]vents.parquet")


@query("""WITH RECURSIVE e AS (SELECT user_id AS key, epoch_us(ts) // 1000 AS "at" FROM events), a AS (SELECT key, min("at") AS "at" FROM e GROUP BY key UNION ALL SELECT key, (SELECT min(e."at") FROM e WHERE e.key = a.key AND e."at" - a."at" > 3 * 86400000) FROM a WHERE a."at" IS NOT NULL)
 SELECT key, "at" FROM a WHERE "at" IS NOT NULL""")
def i5_stream_due(t):
    out = STATE.run_now(STATE.ask_again(_event_stream(t), "user_id", "ts", 3), scratch(t.spark, "asked"))
    return out.select("key", F.unix_millis("at").alias("at"))


@query("""WITH e AS (SELECT user_id AS key, epoch_us(ts) // 1000 AS "at", CASE WHEN event_id % 4 = 0 THEN value END AS v FROM events), s AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN {'at': "at", 'v': v} END IGNORE NULLS) OVER (PARTITION BY key ORDER BY "at") AS l FROM e)
 SELECT key, "at", v AS value, "at" AS seen, 'current' AS origin FROM s WHERE v IS NOT NULL UNION ALL SELECT key, "at", l.v, l."at", 'carried' FROM s WHERE v IS NULL AND "at" - l."at" <= 2 * 86400000
 UNION ALL SELECT key, "at" + 2 * 86400000, v, "at", 'expired' FROM (SELECT key, max("at") AS "at", max_by(v, "at") AS v FROM e WHERE v IS NOT NULL GROUP BY key) WHERE "at" + 2 * 86400000 <= (SELECT max("at") FROM e) - 86400000""")
def i6_stream_carry(t):
    rows = _event_stream(t).withColumn("value", F.when(F.col("event_id") % 4 == 0, F.col("value")))
    out = STATE.run_now(STATE.carry_on(rows, "user_id", "ts", "value", 2), scratch(t.spark, "carried"))
    return out.select("key", F.unix_millis("at").alias("at"), "value", F.unix_millis("seen").alias("seen"), "origin")


@query("""SELECT c_custkey, lower(replace(c_name, '#', '-')) AS slug, regexp_replace(c_name, '[^0-9]', '', 'g') AS digits, 'silva ' || lower(c_mktsegment) AS base, CAST(c_custkey * 1000 + 5 AS DOUBLE) / 100 AS paid, DATE '2024-03-01' AS day, 'meeting' AS class, 0.5::DOUBLE AS alike FROM customer""")
def u_sql_functions(t):
    """The helpers from SQL text."""
    registration.register(t.spark)
    t.customer.createOrReplaceTempView("lupaspark_people")
    return t.spark.sql("""
        SELECT c_custkey, slug(c_name) AS slug, digits_of(c_name) AS digits, name_key_base(concat('da Silva ', c_mktsegment, ' Filho Neto')) AS base,
          CAST(money_br(concat('R$ ', CAST(c_custkey * 10 AS STRING), ',05')) AS DOUBLE) AS paid, date_br('01/03/2024') AS day, event_class('Reunião com o setor') AS class, word_jaccard(c_name, concat(c_name, ' e outros')) AS alike
        FROM lupaspark_people""")


@query(f"WITH c AS (SELECT c_custkey AS doc_id, c_custkey % 6 AS k, {_UP} AS w FROM customer) SELECT verb, reason, count(*) AS n FROM (SELECT unnest(CASE k WHEN 0 THEN ['nomear', 'nomear', 'nomear'] WHEN 1 THEN ['exonerar', 'nomear'] WHEN 2 THEN ['designar'] WHEN 3 THEN ['dispensar'] WHEN 4 THEN ['nomear', 'nomear'] ELSE ['nomear', 'exonerar'] END) AS verb, unnest(CASE k WHEN 0 THEN [NULL, NULL, NULL] WHEN 1 THEN [NULL, NULL] WHEN 2 THEN [NULL] WHEN 3 THEN ['unclear name'] WHEN 4 THEN [NULL, NULL] ELSE ['no post', NULL] END) AS reason FROM c) GROUP BY ALL")
def u_sql_parse_acts(t):
    """The table function from SQL text: outcomes of the acts, refusals beside them."""
    registration.register(t.spark)
    gazette_texts(t).createOrReplaceTempView("lupaspark_texts")
    return t.spark.sql("SELECT verb, reason, count(*) AS n FROM lupaspark_texts, LATERAL parse_acts(text) GROUP BY verb, reason")
