"""Golden cases of functions and operators on tiny tables, invariants, sources, sinks and streams."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lupaspark.functions import columns as C
from lupaspark.operators import aggregates as A
from lupaspark.operators import incremental as I  # noqa: E741
from lupaspark.operators import joins as J
from lupaspark.operators import merge as U
from lupaspark.operators import quality as Q
from lupaspark.operators import ranking as W
from lupaspark.operators import resolve as R
from lupaspark.operators import temporal as T
from lupaspark.operators import text as X
from lupaspark.sources import readers as S
from lupaspark.sources import sinks as K
from lupaspark.streaming import jobs as ST

D = dt.date


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first()[0]


@pytest.mark.parametrize(
    ("f", "x", "want"),
    [
        (C.norm_alpha, " São  João—d'Água 2 ", "sao joaod agua"), (C.norm_alnum, "Órgão nº 12", "orgao no 12"), (C.fold, "ÁÇÃO-x", "acao-x"), (C.slug, "Ministério da Saúde!", "ministerio-da-saude"),
        (C.core_name, "Secretaria-Geral da Presidência", "secretariageral presidencia"), (C.strip_legal_form, "Obras Boas Ltda ME", "obras boas"), (C.key_without_connectives, "Instituto de Pesquisa e Ensino", "instituto pesquisa ensino"),
        (C.name_key_base, "João da Silva Filho", "joao silva"), (C.name_key_first_last, "João Carlos da Silva Júnior", "joao silva"), (C.title_pt, "MINISTÉRIO DA SAÚDE", "Ministério da Saúde"),
        (C.date_br, "03/02/2024", D(2024, 2, 3)), (C.date_br, "31/02/2024", None), (C.date_pt_long, "3 de março de 2024", D(2024, 3, 3)), (C.date_pt_long, "1º de abril de 2020", D(2020, 4, 1)), (C.date_pt_long, "2019", D(2019, 1, 1)),
        (C.uf_from_name, "São Paulo", "SP"), (C.uf_from_code, "3550308", "SP"), (C.cnpj, "12.345.678/0001-95", "12345678000195"), (C.cnpj, "123", None), (C.abroad, "Lisboa/Portugal", True), (C.abroad, "Recife/PE", False),
        (C.decision_nature, "Acesso Negado", "denied"), (C.redact, "cpf 123.456.789-09, a@b.com", "cpf [cpf], [email]"), (C.veto_subject, 'Dispõe que "altera a lei', "altera a lei"),
        (X.entity_key, "FIESP - Federação das Indústrias", "fiesp"), (X.entity_key, "Obras Boas Ltda", "obras boas"), (X.snippet, "Curta. " + "a" * 300, ("Curta. " + "a" * 300)[:220]),
    ],
)
def test_functions(spark, f, x, want):
    assert one(spark, f, x) == want


@pytest.mark.parametrize(("x", "want"), [("1.234,56", 1234.56), ("1234.56", 1234.56), ("R$ 12", 12.0), ("", 0.0), ("abc", None)])
def test_money(spark, x, want):
    got = one(spark, C.money_br, x)
    assert (float(got) if got is not None else None) == want
    assert one(spark, lambda c: C.money_br(c, False), " ") is None


def test_value_and_label(spark):
    assert float(one(spark, C.value_in_text, "multa de R$ 1.500,00 e R$ 2")) == 1500.0
    assert one(spark, lambda c: C.money_label(c.cast("double")), "1234567") == "R$ 1,2 mi"
    assert one(spark, lambda c: C.partial_date(c)[1], "2020-05") == "month" and one(spark, lambda c: C.partial_date(c)[0], "2020-05") == D(2020, 5, 1)
    assert one(spark, lambda c: C.age_at(c, F.lit("2024-05-01")), "1950-06-01") == 73 and one(spark, lambda c: C.age_at(c, F.lit("2024")), "2015") is None
    assert one(spark, lambda c: C.add_years(c.cast("date"), 1), "2024-02-29") is None


def test_html_lines(spark):
    assert one(spark, C.html_lines, "<script>x<y</script><p>A &amp; <u>B</u><br>C</p><!-- d -->") == ["A & B", "C"]
    assert one(spark, C.html_lines, "<td>Secret&aacute;ria de Educa&ccedil;&atilde;o &#8211; x</td><td>C&nbsp;D</td>") == ["Secretária de Educação - x", "C D"]
    assert one(spark, C.html_lines, "<td>B</td><td>C</td><li>• E |</li>") == ["B", "C", "E"] and one(spark, C.html_lines, None) is None and one(spark, C.html_lines, "") == []


def test_parse_acts(spark):
    """Forms in which gazettes print acts."""
    rows = [
        (1, "O MINISTRO resolve NOMEAR o Senhor JOÃO LIMA para exercer o cargo de chefe de gabinete, código CCE 1.13."),
        (2, "NOMEAR, a partir de 3 de março de 2024, MARIA DE SOUZA LIMA, para exercer o cargo em comissão de Diretora, do Ministério da Saúde."),
        (3, "DISPENSAR, a pedido, o Dr. JOSÉ ALVES da função de Coordenador; DESIGNAR ANA D'ÁVILA REIS para a função comissionada de Assessora."),
        (4, "Nada a nomear."), (5, None), (6, "EXONERAR, a pedido, a contar de 1º de maio, RUI BARBOSA do cargo de Secretário da Fazenda Nacional."),
    ]
    got = X.parse_acts(spark.createDataFrame(rows, "doc_id int, text string")).collect()
    assert sorted((r.doc_id, r.act_no, r.verb, r.name, r.post) for r in got) == [
        (1, 0, "nomear", "JOÃO LIMA", "chefe de gabinete"), (2, 0, "nomear", "MARIA DE SOUZA LIMA", "Diretora"), (3, 0, "dispensar", "JOSÉ ALVES", "Coordenador"),
        (3, 1, "designar", "ANA D'ÁVILA REIS", "Assessora"), (6, 0, "exonerar", "RUI BARBOSA", "Secretário da Fazenda Nacional"),
    ]


def test_link_entities_long_forms(spark):
    """A form of more words than a key has is found whole, and not by its beginning alone."""
    long = "conselho de controle das contas do estado do rio de janeiro"
    texts = spark.createDataFrame([(1, f"ontem o {long.title()} decidiu"), (2, "conselho de controle das contas do estado do acre"), (3, long), (4, None)], "doc_id int, text string")
    got = X.link_entities(texts, spark.createDataFrame([(7, long), (8, "do acre")], "id int, form string")).collect()
    assert sorted((r.doc_id, r.id, r["first"]) for r in got) == [(1, 7, 2), (2, 8, 7), (3, 7, 0)]


def test_subsequence(spark):
    def ok(small, big):
        return spark.range(1).select(R.is_subsequence(F.split(F.lit(small), " "), F.split(F.lit(big), " "))).first()[0]

    assert ok("ana souza", "ana maria souza") and ok("ana m souza", "ana maria souza") and not ok("souza ana", "ana maria souza") and not ok("maria souza", "ana maria souza")


def test_resolution_ladder(spark):
    nodes = spark.createDataFrame([("br-ms", "Ministério da Saúde", "MS"), ("br-anvisa", "Agência Nacional de Vigilância Sanitária", "ANVISA"), ("br-a", "Conselho Federal", None), ("br-b", "Conselho Federal", None), ("br-ex", "Ministério do Trabalho Escravo", None)], "id string, name string, sigla string")
    want = {
        "MINISTERIO DA SAUDE": ("br-ms", "exact"), "Ministério Saúde": ("br-ms", "core"), "Saúde - MS": ("br-ms", "sigla after dash"), "ANVISA - Agência": ("br-anvisa", "sigla before dash"), "ANVISA": ("br-anvisa", "sigla"),
        "Diretoria da Agencia Nacional de Vigilancia Sanitaria do Norte": ("br-anvisa", "contained"), "Conselho Federal": (None, "no match"), "Ministério do Trabalho Escravo": (None, "refused"), "Vigilância": ("br-anvisa", "alternate"), "Outro": (None, "no match"),
    }
    names = spark.createDataFrame([(x,) for x in want for _ in range(2)], "raw string")
    got = R.resolve_names(names, nodes, ["ministerio do trabalho escravo"], {"vigilancia": "Agência Nacional de Vigilância Sanitária"})
    assert {r.raw: (r.node, r.how) for r in got.collect()} == want
    assert names.join(got, "raw").count() == names.count()
    must, must_not = spark.createDataFrame([("ANVISA", "br-anvisa"), ("Outro", "br-ms")], "raw string, node string"), spark.createDataFrame([("Saúde - MS",)], "raw string")
    assert {r.raw for r in Q.golden(got, must, must_not).collect()} == {"Outro", "Saúde - MS"}


def test_payroll_ladder(spark):
    holders = spark.createDataFrame([(1, "Ana Maria Souza", "o1"), (2, "Rui Costa", "o1"), (3, "Zé Lima", "o2"), (4, "Eva Reis Neto", "o1")], "person int, name string, organ string")
    pay = spark.createDataFrame([(10, "Ana Maria Souza", "o1"), (11, "Rui Alves Costa", "o3"), (12, "Rui Braga Costa", "o1"), (13, "Zé Lima", "o9"), (14, "Eva Reis", "o0")], "row_id int, name string, organ string")
    tree = spark.createDataFrame([("o3", "o1", 1), ("o1", "o0", 1), ("o3", "o0", 2)], "node string, ancestor string, depth int")
    got = {r.person: (r.row_id, r.criterion, r.confidence, r.reason) for r in R.payroll_match(holders, pay, tree).collect()}
    assert got == {1: (10, "full name", "high", None), 2: (None, None, None, "ambiguous"), 3: (None, None, None, "no match"), 4: (14, "base name", "high", None)}


def test_small_matchers(spark):
    births = R.person_join_birth(spark.createDataFrame([(1, "Ana Sá", D(1970, 1, 1)), (2, "Ana Sá", D(1980, 1, 1)), (3, "Ana Sá", None)], "cand_id int, name string, birth date"), spark.createDataFrame([(9, "ANA SA", D(1970, 1, 1))], "person_id int, name string, birth date"))
    assert {(r.cand_id, r.homonym) for r in births.collect()} == {(1, True), (3, True)}
    second = R.second_pass(spark.createDataFrame([(1, "zeca", 2020), (2, "nina", 2020), (3, "nina", 2020), (4, "dada", 2020)], "cand_id int, urna string, year int"), spark.createDataFrame([(4,)], "cand_id int"), spark.createDataFrame([(7, "zeca"), (8, "nina"), (9, "dada")], "person_id int, urna string"), "urna", "year")
    assert [(r.cand_id, r.person_id) for r in second.collect()] == [(1, 7)]
    org = R.abbrev_match(spark.createDataFrame([("Min Faz",), ("Sec Ed",), ("Xis",)], "raw string"), spark.createDataFrame([(1, "Ministério da Fazenda"), (2, "Ministério da Fazenda e Planejamento"), (3, "Secretaria de Educação"), (4, "Secretaria de Edificios")], "org int, name string"))
    assert {(r.raw, r.org) for r in org.collect()} == {("Min Faz", 1), ("Sec Ed", 3)}
    acts = spark.createDataFrame([(1, "diretor", "Diretor do Departamento de Obras"), (2, "chefe", "Chefe do Departamento de Obras"), (3, "diretor", "Diretor de Obras")], "act int, role string, text string")
    posts = spark.createDataFrame([(5, "diretor", "Departamento de Obras")], "target int, role string, text string")
    assert {r.act: (r.confidence, r.reason) for r in R.coverage_match(acts, posts).collect()} == {1: ("high", None), 2: (None, "other role"), 3: (None, "few words")}
    assert {(r.act, r.target) for r in R.symmetric_terms(acts, posts, ["diretor"]).collect()} == {(1, 5)}
    reg = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (1, "c", "y"), (1, "d", "y")], "layer int, id string, name string")
    assert {(r.name, r.canonical_id) for r in R.canonical_ids(spark.createDataFrame([("x",), ("y",)], "name string"), reg, ["name"]).collect()} == {("x", "a"), ("y", None)}
    done, new = R.resolve_with_cache(spark.createDataFrame([("k1", "A"), ("k2", "B"), ("k2", "B"), ("k3", "C")], "cnpj string, name string"), "cnpj", ["name"], spark.createDataFrame([("k1", "n1")], "key string, node string"), spark.createDataFrame([("A", "nX"), ("B", "n2")], "raw string, node string"))
    assert sorted((r.cnpj, r.node) for r in done.collect()) == [("k1", "n1"), ("k2", "n2"), ("k2", "n2"), ("k3", None)] and [tuple(r) for r in new.collect()] == [("k2", "n2")]


def test_sanctions_hold_only_in_time(spark):
    spans = spark.createDataFrame([(1, D(2020, 1, 1), D(2020, 12, 31), "suspensao", "all", 5), (1, D(2021, 1, 1), None, "multa", "all", 5), (2, D(2020, 1, 1), None, "suspensao", "sanctioning_body", 5), (3, D(2020, 1, 1), None, "suspensao", None, 5)], "firm_key int, valid_from date, valid_to date, category string, reach string, body int")
    deals = spark.createDataFrame([(1, D(2019, 12, 31)), (1, D(2020, 1, 1)), (1, D(2020, 12, 31)), (1, D(2021, 6, 1)), (2, D(2020, 6, 1)), (3, D(2020, 6, 1))], "firm_key int, signed date").withColumn("buyer", F.lit(6))
    ok = C.bars_contracting(F.col("category")) & F.coalesce(C.reaches_buyer(F.col("reach"), F.col("body"), F.col("buyer")), F.lit(True))
    got = {(r.firm_key, r.signed) for r in T.in_force_join(deals, spans, ["firm_key"], "signed", extra=ok).collect()}
    assert got == {(1, D(2020, 1, 1)), (1, D(2020, 12, 31)), (3, D(2020, 6, 1))}


def test_spans_and_folds(spark):
    s = spark.createDataFrame([("a", D(2020, 1, 1), D(2020, 6, 1)), ("a", D(2020, 6, 1), D(2020, 9, 1)), ("a", D(2020, 10, 3), None), ("b", D(2020, 1, 1), D(2020, 2, 1)), ("b", D(2020, 3, 3), D(2020, 4, 1))], "k string, s date, e date")
    assert {tuple(r) for r in T.chain_spans(s, ["k"], "s", "e").collect()} == {("a", D(2020, 1, 1), D(2020, 9, 1), 2), ("a", D(2020, 10, 3), None, 1), ("b", D(2020, 1, 1), D(2020, 4, 1), 2)}
    log = spark.createDataFrame([("u", "A", "in", 1), ("u", "B", "in", 3), ("u", "A", "out", 5), ("v", "C", "in", 1), ("v", "C", "out", 1), ("w", "D", "in", 1), ("w", "E", "in", 2), ("w", "E", "out", 3)], "unit string, name string, verb string, day int")
    assert {tuple(r) for r in T.current_holder(log, "unit", "name", "verb", "day", "in", "out").collect()} == {("u", "B", 3)}
    weeks = spark.createDataFrame([("x", w, 500.0 if w == 0 else 50.0) for w in range(12)] + [("y", w, 500.0 if w == 0 else 50.0) for w in range(9)] + [("z", w, 150.0 if w == 0 else 1.0) for w in range(12)], "k string, week int, v double")
    assert {r.k: r.silent for r in T.silence(weeks, "k", "week", "v").collect()} == {"x": True, "y": False, "z": False}


def test_sample_rule_and_rates(spark):
    rows = [(g, float(v)) for g, n in (("two", 2), ("four", 4), ("five", 5)) for v in range(1, n + 1)] + [("two", None)]
    got = {r.g: (r.n, r.median, r.low, r.high, r.reason) for r in A.sampled_value(spark.createDataFrame(rows, "g string, v double"), ["g"], "v").collect()}
    assert got == {"two": (2, None, None, None, "sample too small"), "four": (4, None, 1.0, 4.0, None), "five": (5, 3.0, None, None, None)}
    r = A.rate(spark.createDataFrame([(10, 19), (10, 20)], "a int, b int"), "a", "b").collect()
    assert [x.rate for x in r] == [None, 50.0]


def test_top_k_and_rest_add_up(spark):
    df = spark.createDataFrame([(i % 3, i % 11, i) for i in range(200)], "g int, item int, v int")
    rest = W.top_k_rest(df, ["g"], "item", "v", 4)
    total = lambda d: {r[0]: r[1] for r in d.groupBy("g").agg(F.sum("v")).collect()}
    assert total(rest) == total(df) and rest.groupBy("g").count().where("count <> 5").count() == 0


def test_state_between_runs(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "id int, v string"), spark.createDataFrame([(2, "z"), (3, "w"), (3, "w")], "id int, v string")
    once = I.accumulate(a, b, "id")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, I.accumulate(once, b, "id").collect())) == [(1, "x"), (2, "y"), (3, "w")]
    k = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id int")
    assert I.snapshot_diff(k(), k(1), ["id"], "2024-01-01").count() == 0
    assert {(r.id, r.event) for r in I.snapshot_diff(k(1, 2), k(2, 3), ["id"], "2024-01-01").collect()} == {(1, "left"), (3, "entered")}
    table = spark.createDataFrame([], "id int, valid_from date, valid_to date")
    for day, ids in (("2024-01-01", (1, 2)), ("2024-01-02", (2,)), ("2024-01-03", (1, 2))):
        table = I.scd(table, k(*ids), ["id"], day)
    assert {tuple(r) for r in table.collect()} == {(1, D(2024, 1, 1), D(2024, 1, 2)), (1, D(2024, 1, 3), None), (2, D(2024, 1, 1), None)}
    prev = spark.createDataFrame([("a", 1, D(2024, 1, 1)), ("b", 1, D(2023, 1, 1))], "k string, v int, seen date")
    cur = spark.createDataFrame([("a", None, D(2024, 1, 9)), ("c", 5, D(2024, 1, 9))], "k string, v int, seen date")
    assert {(r.k, r.v, r.origin) for r in I.carry_forward(prev, cur, "k", "v", "seen", 21, "2024-01-10").collect()} == {("a", 1, "carried"), ("c", 5, "current")}


def test_layers_and_rules(spark):
    nodes = spark.createDataFrame([("a", "p", 1), ("a", "q", 2), ("b", None, 1)], "position string, name string, layer int")
    assert {(r.position, r.name) for r in U.first_layer(nodes, ["position"], "layer").collect()} == {("a", "p"), ("b", None)}
    rules = spark.createDataFrame([("f1", "name", "^Min", "Extinto"), ("f2", "id", "x", None), ("f1", "id", "x", None)], "family string, kind string, pattern string, except_pattern string")
    ok, errors = J.match_rules(spark.createDataFrame([("m", "Min A", "s"), ("n", "Min Extinto", "s"), ("x", "Y", "s")], "id string, name string, subtype string"), rules)
    assert [tuple(r) for r in ok.collect()] == [("m", "f1")] and [tuple(r) for r in errors.collect()] == [("x", "f1,f2")]
    bad = Q.run_registry(spark.createDataFrame([("a", "ok", 3, D(2024, 1, 1)), ("gone", "ok", 1, D(2024, 1, 1))], "connector string, status string, seconds int, last_ok date"), spark.createDataFrame([("a", "failed", 9)], "connector string, status string, seconds int"), spark.createDataFrame([("a",), ("new",)], "connector string"), "2024-01-05")
    assert {(r.connector, r.status, r.days_without) for r in bad.collect()} == {("a", "failed", 4), ("new", None, None)}


def test_texts(spark):
    acts = spark.createDataFrame([(1, "Resolve NOMEAR MARIA DA SILVA, para exercer o cargo de Diretora da Agência X; EXONERAR JOÃO LIMA do cargo de chefe.")], "doc_id int, text string")
    assert [(r.verb, r.name, r.post) for r in X.parse_acts(acts).orderBy("act_no").collect()] == [("nomear", "MARIA DA SILVA", "Diretora da Agência X"), ("exonerar", "JOÃO LIMA", "chefe")]
    assert {r.name for r in X.acts_with_names(acts).collect()} == {"MARIA DA SILVA", "JOÃO LIMA"}
    links = X.link_entities(spark.createDataFrame([(1, "A ministra Ana Sá falou; Ana Sá saiu"), (2, "ana")], "doc_id int, text string"), spark.createDataFrame([(7, "ana sa"), (7, "ministra ana sa"), (8, "ana"), (9, "ana")], "id int, form string"))
    assert [(r.doc_id, r.id, r.form) for r in links.collect()] == [(1, 7, "ministra ana sa")]
    page = spark.createDataFrame([(1, "http://a/b/", "<p>Diretora</p><p>Maria da Silva</p><a href='c.pdf'>x</a><table><tr><th>N</th><td>1 <b>2</b></td></tr></table>")], "page_id int, url string, html string")
    assert [(r.name, r.acting) for r in X.heads_from_pages(page).collect()] == [("Maria da Silva", False)]
    assert [r.link for r in X.page_links(page, ["pdf"]).collect()] == ["http://a/b/c.pdf"] and X.page_tables(page).first().cells == ["N", "1 2"]
    people = X.participants(spark.createDataFrame([(1, "<p>Agentes públicos</p><p>Ana (Ministra)</p><p>Agentes privados</p><p>Rui - Empresa X</p>")], "event_id int, html string"))
    assert {(r.side, r.name, r.role, r.entity) for r in people.collect()} == {("public", "Ana", "Ministra", None), ("private", "Rui", None, "Empresa X")}
    t = spark.createDataFrame([("Ana Sá, ministra da X",), ("Ministra da X, Ana Sá",)], "s string").select(*X.title_person(F.col("s")))
    assert [tuple(r) for r in t.collect()] == [("Ana Sá", "ministra da X"), ("Ana Sá", "Ministra da X")]


def test_sources(spark, tmp_path):
    latin = tmp_path / "l.csv"
    latin.write_bytes("Ação;Valor\nmaçã;1,5\n".encode("latin1"))
    assert S.sniff(spark, str(latin)) == ("latin1", ";")
    df = S.resolve_columns(S.read_delimited(spark, str(latin), encoding="sniff"), {"action": ["acao"], "value": ["valor pago", "valor"]})
    assert [tuple(r) for r in df.collect()] == [("maçã", "1,5")]
    (tmp_path / "u.csv").write_bytes("﻿A;B\né;2\n".encode())
    assert S.read_delimited(spark, str(tmp_path / "u.csv"), encoding="utf-8-sig").columns == ["A", "B"]
    (tmp_path / "w.csv").write_bytes("A;B\né;2\n".encode("utf-16"))
    assert [tuple(r) for r in S.read_delimited(spark, str(tmp_path / "w.csv"), encoding="utf-16").collect()] == [("é", "2")]
    with pytest.raises(ValueError):
        S.resolve_columns(df, {"x": ["absent"]})
    with pytest.raises(ValueError):
        S.read_rules(spark, [{"k": "a"}, {"k": "a"}], "k string", "k")
    got = spark.createDataFrame([("[1,2]",), ("3",), (None,)], "j string").select(S.as_array(F.col("j"), "int").alias("a"))
    assert [r.a for r in got.collect()] == [[1, 2], [3], []]
    rows = spark.createDataFrame([(1, 5), (2, 7), (3, 7)], "x int, p int")
    assert {r.x for r in S.latest_partition(rows, "p", 9, 3).collect()} == {2, 3}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 1.5, True, "é"), (2, 2.0, None, None)], "id int, v double, ok boolean, s string")
    K.write_csv_pt(df, str(tmp_path / "csv"))
    text = "".join(sorted(p.read_text(encoding="utf-8") for p in (tmp_path / "csv").glob("part*")))
    assert "﻿id;v;ok;s" in text and "1;1,5;sim;é" in text
    m = K.write_bundle({"t": df, "u": df.limit(1)}, str(tmp_path / "bundle"))
    assert {(r.table, r.rows) for r in m.collect()} == {("t", 2), ("u", 1)}
    K.write_index(df, "id", str(tmp_path / "index"))
    assert K.read_index(spark, str(tmp_path / "index"), df.select("id").where("id = 2"), "id").first().v == 2.0
    K.write_docs(df, "id", ["v"], ["s"], str(tmp_path / "docs"))
    assert spark.read.json(str(tmp_path / "docs/core")).count() == 2


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=7 * i), "ab"[i % 2], float(i)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, ts timestamp, kind string, value double")
    df.write.parquet(src)
    df.limit(50).write.mode("append").parquet(src)
    stream = spark.readStream.schema(df.schema).parquet(src)

    def drain(out, mode, name):
        q = out.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name)

    assert drain(ST.stream_once(stream, "id", "ts", "365 days"), "append", "m_once").count() == 200
    batch = {tuple(r) for r in ST.stream_mentions(spark.read.parquet(src), "kind", "ts").collect()}
    assert {tuple(r) for r in drain(ST.stream_mentions(stream, "kind", "ts"), "complete", "m_weeks").collect()} == batch
    days = drain(ST.stream_daily(stream, "kind", "ts", "value"), "complete", "m_days")
    assert {r.kind for r in ST.year_to_date(days, "2024-02-01").collect()} == {"a", "b"}
    q = ST.snapshots(stream, str(tmp_path / "out"), str(tmp_path / "ckpt"), lambda b, n: b.groupBy("kind").count())
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_best_similar_of_all_parts(spark):
    from lupaspark import plans

    sf = "/root/testdata/sf0.01"
    parts = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", "p_type", "p_size").collect()
    least = {}
    for k, kind, size in parts:
        least[kind, size % 50] = min(k, least.get((kind, size % 50), k))
    got = {r.id: (r.target, r.ratio) for r in plans.QUERIES["j17_best_similar"](spark, sf).collect()}
    assert got == {k: (least[kind, size % 50], 1.0) for k, kind, size in parts}
