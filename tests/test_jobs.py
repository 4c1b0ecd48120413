"""The composed jobs on small tables: what they find, and what they refuse."""

import datetime as dt

import pytest

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
from lupaspark.operators import resolve as R
from lupaspark.sources import readers as S

D = dt.date


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=str)


def one(spark, f, x):
    from pyspark.sql import functions as F

    return spark.createDataFrame([(x,)], "x string").select(f(F.col("x")).alias("y")).first()[0]


@pytest.fixture
def gazette(spark):
    posts = spark.createDataFrame([(1, "Diretor do Departamento de Obras"), (2, "Chefe do Gabinete"), (3, "Secretário Nacional de Portos"), (4, "Assessor"), (5, "Assessor")], "post_id int, title string")
    texts = [
        (1, D(2024, 1, 1), "NOMEAR ANA LIMA para o cargo de Diretor do Departamento de Obras."),
        (2, D(2024, 2, 1), "EXONERAR ANA LIMA do cargo de Diretor do Departamento de Obras e NOMEAR RUI REIS para o mesmo cargo."),
        (3, D(2024, 2, 1), "NOMEAR CARLA DIAS, a partir de 5 de janeiro de 2024, para o cargo de Chefe do Gabinete."), (4, D(2024, 3, 1), "DESIGNAR BRUNO COSTA para a função de Secretário de Portos."),
        (5, D(2024, 3, 1), "NOMEAR EVA REIS para o cargo de Assessor."), (6, D(2024, 3, 1), "NOMEAR Conselho Superior, para o cargo de Assessor."), (7, D(2024, 4, 1), None), (8, None, "EXONERAR CARLA DIAS."),
    ]
    return spark.createDataFrame(texts, "doc_id int, day date, text string"), posts


def test_occupants(spark, gazette):
    texts, posts = gazette
    pages = spark.createDataFrame([(1, "<p>Chefe do Gabinete</p><p>Carla Dias</p>"), (2, "<p>Diretor do Departamento de Obras</p><p>Paulo Pires</p>"), (3, None), (4, "<p>Chefe substituto do Gabinete</p><p>Outra Pessoa</p>")], "page_id int, html string")
    held, refused = O.occupants(texts, posts, pages)
    assert rows(held) == [(1, "paulo pires", None, "page"), (2, "carla dias", D(2024, 1, 5), "page and gazette"), (3, "bruno costa", D(2024, 3, 1), "gazette")]
    assert rows(refused) == [("no post", 1), ("no such post", 1), ("unclear name", 1)]
    spans = O.tenures(O.gazette_events(texts, posts))
    assert rows(spans) == [(1, "ana lima", D(2024, 1, 1), D(2024, 2, 1), 1), (1, "rui reis", D(2024, 2, 1), None, 1), (2, "carla dias", D(2024, 1, 5), None, 1), (3, "bruno costa", D(2024, 3, 1), None, 1)]
    assert O.occupants(texts.limit(0), posts, pages.limit(0))[0].count() == 0


def test_alerts(spark):
    contracts = spark.createDataFrame([(1, "f", "c1", "Secretaria de Obras", D(2024, 1, 5), 10.0), (2, "f", "c9", "SO - compras", D(2024, 1, 6), 20.0), (3, "f", "c9", "Outro", D(2024, 1, 7), 5.0), (4, "g", "c9", None, D(2024, 1, 7), 7.0), (5, "f", "c1", "Secretaria de Obras", D(2025, 1, 1), 9.0)], "contract int, firm_key string, buyer_code string, buyer_name string, signed date, value double")
    nodes = spark.createDataFrame([(1, "Secretaria de Obras", "SO"), (2, "Secretaria de Portos", "SP")], "id int, name string, sigla string")
    cache = spark.createDataFrame([("c1", 2)], "key string, node int")
    out, fresh, unmatched = AL.resolved_buyers(contracts, cache, nodes)
    assert rows(out, "contract", "node", "how") == [(1, 2, "known code"), (2, 1, "sigla before dash"), (3, None, "no match"), (4, None, "no name"), (5, 2, "known code")]
    assert rows(fresh) == [("c9", 1)] and {r[0] for r in rows(unmatched)} == {"Outro", None}
    sanctions = spark.createDataFrame([(1, "f", D(2024, 1, 1), D(2024, 12, 31), "suspensao", "sanctioning_body", 2), (2, "f", D(2024, 1, 1), None, "multa", "all", 2), (3, "g", D(2024, 1, 1), None, "inidoneidade", None, 2)], "sanction_id int, firm_key string, valid_from date, valid_to date, category string, reach string, body_key int")
    assert rows(AL.alerts(out, sanctions), "contract", "sanctions", "reach") == [(1, 1, "known"), (3, 1, "unknown"), (4, 1, "unknown")]
    assert rows(AL.barred_suppliers(contracts, cache, nodes, sanctions, 1), "firm_key", "contract", "alerts", "volume") == [("f", 3, 2, 15.0), ("g", 4, 1, 7.0)]


def test_campaign(spark):
    people = spark.createDataFrame([(1, "Ana Lima", "ana", "SP", D(1970, 1, 1)), (2, "Rui Reis", "rui", "RJ", None), (3, "Eva Dias", "eva", "BA", D(1980, 1, 1))], "person_id int, name string, short string, uf string, birth date")
    cands = spark.createDataFrame([(10, 2018, "ANA LIMA", "ana", "SP", D(1970, 1, 1)), (11, 2022, "ANA LIMA", "ana", "SP", D(1971, 1, 1)), (20, 2018, "Rui dos Reis Neto", "rui", "RJ", None), (30, 2018, "Eva D.", "eva", "SE", None), (31, 2022, "Eva A.", "eva", "SE", None), (32, 2022, "Eva B.", "eva", "AL", None), (40, 2018, None, None, None, None)], "cand_id int, year int, name string, short string, uf string, birth date")
    found = CM.people_of(cands, people)
    assert rows(found, "cand_id", "person_id", "how") == [(10, 1, "full name"), (11, None, "birth differs"), (20, 2, "short name and state"), (30, 3, "unique short name"), (31, None, "no match"), (32, None, "no match"), (40, None, "no match")]
    assets = spark.createDataFrame([(10, 100.0), (10, 50.0), (20, 10.0), (99, 1.0)], "cand_id int, value double")
    assert rows(CM.assets_over_time(found, assets, spark.createDataFrame([(2018, 100.0)], "year int, idx double"), 150.0)) == [(1, 2018, 2018, 150.0, 150.0, 0.0, 0.0), (2, 2018, 2018, 10.0, 10.0, 0.0, 0.0)]
    donors = spark.createDataFrame([(10, "x", "individual", 10.0), (10, "y", "company", 30.0), (10, "z", "individual", 60.0), (20, "x", "individual", 5.0)], "cand_id int, donor string, kind string, value double")
    payees = spark.createDataFrame([(1, "y"), (1, "y"), (2, "y")], "person_id int, payee string")
    assert rows(CM.donors_of(found, donors, payees, 50.0, 1)) == [(1, 2, 0.6, 1), (2, 0, 1.0, 0)]


def test_meetings(spark):
    page = lambda *entities: "<p>Agentes privados</p>" + "".join(f"<p>Rui Reis (diretor) - {e}</p>" for e in entities)
    events = spark.createDataFrame([(1, "ANA LIMA", "Ministério de Portos", page("Costa Advogados", "Ministério de Portos")), (2, "Ana Limma", "Ministério de Portos", page("Costa Advogados")), (3, "Zé Ninguém", "x", page("Obras Ltda")), (4, None, None, None), (5, "Ana Lima", "Ministério de Portos", page("COSTA ADVOGADOS", "Prefeitura de Lagoa"))], "event_id int, host string, organ string, html string")
    holders = spark.createDataFrame([(7, "Ana Lima", "Ministério de Portos", True)], "left_id int, name string, organ string, is_head boolean")
    met, unknown = M.encounters(events, holders, ["XX"])
    assert rows(met, "event_id", "person", "entity", "class") == [(1, 7, "Costa Advogados", "law firm"), (2, 7, "Costa Advogados", "law firm"), (5, 7, "Costa Advogados", "law firm"), (5, 7, "Prefeitura de Lagoa", "public")]
    assert rows(unknown) == [("no match", 2)]
    assert rows(M.received(met)) == [(7, "law firm", 3, 1)]


def test_news(spark):
    day = D(2024, 1, 31)
    articles = spark.createDataFrame([(1, day, "Ana Lima fala da licença"), (2, day, "futebol de Ana Lima"), (3, day, "nada"), (4, D(2023, 1, 1), "Ana Lima"), (5, D(2024, 1, 1), "Ana Lima e Rui Reis"), (6, day, "futebol de Rui Reis"), (7, None, "Ana Lima"), (8, day, None)], "doc_id int, date date, text string")
    forms = spark.createDataFrame([("a", "ana lima"), ("r", "rui reis")], "id string, form string")
    found, topics = N.linked(articles, forms, {"rules": ["licenca"]}, "futebol", spark.createDataFrame([(6, True), (1, True)], "doc_id int, verdict boolean"), day)
    assert rows(found, "doc_id", "id") == [(1, "a"), (5, "a"), (5, "r"), (6, "r")] and rows(topics) == [(1, "rules")]
    hot, weeks, edges = N.power_map(found, spark.createDataFrame([("x", "a", "r"), ("x", "a", "q"), ("y", "r", "a")], "type string, from string, to string"), ["x"], day)
    assert rows(hot) == [("a", 2.2, 2), ("r", 2.2, 2)] and rows(edges, "type", "from", "to") == [("x", "a", "r")]
    assert weeks.count() == 24 and rows(weeks.where("n > 0")) == [("a", 0, 1), ("a", 4, 1), ("r", 0, 1), ("r", 4, 1)]


def test_bundle(spark):
    people = spark.createDataFrame([("p", "Ana", None)], "id string, name string, uf string")
    seats = spark.createDataFrame([("b", "Chefe", "p", 2), ("a", "Diretor", "p", 1), ("c", "Chefe", "p", 3), ("d", "Vaga", None, 4)], "post_id string, post string, person_id string, seat int")
    out = B.tables({"people": people, "occupants": seats, "travel": spark.createDataFrame([("p", 3), ("q", 4)], "id string, trips int")})
    assert list(out) == list(B.TABLES) and len(out) == 12
    assert rows(out["people"]) == [("p", "Ana", None, None, "Diretor | Chefe")] and rows(out["travel"]) == [("p", "Ana", 3, None, None)]
    assert rows(out["occupants"], "post_id", "person") == [("a", "Ana"), ("b", "Ana"), ("c", "Ana"), ("d", None)] and out["nodes"].count() == 0


def test_small_functions(spark):
    """Names' variants, heads of roles, cuts, parts of a source, headers of sheets, compatible organs."""
    from pyspark.sql import functions as F

    assert one(spark, C.name_variants, " Agência X (AX) - sede (AX)") == ["Agência X (AX) - sede (AX)", "Agência X (AX) - sede", "Agência X (AX)"]
    assert one(spark, lambda c: C.role_head(c, ["diretor geral", "diretor"]), "Diretor-Geral do X") == "diretor geral" and one(spark, lambda c: C.role_head(c, ["chefe"]), "Subchefe") is None
    assert spark.range(1).select(C.cut_amount(F.lit(-3.5))).first()[0] == 3.5
    slips = spark.createDataFrame([("a", 10.0, -2.0, 1.0)], "k string, gross double, cut double, extra double")
    assert A.payroll_components(slips, "k", "gross", "cut", "extra").first()["net"] == 9.0
    tree = spark.createDataFrame([("sub", "org", 1), ("org", "top", 1), ("sub", "top", 2)], "node string, ancestor string, depth int")
    holders = spark.createDataFrame([("p", "org")], "person string, organ string")
    pay = spark.createDataFrame([(1, "org"), (2, "sub"), (3, "top"), (4, "else")], "row_id int, organ string")
    assert rows(R.org_compatible(holders, tree, pay)) == [("p", 1, 0), ("p", 2, 1), ("p", 3, 2)]
    sheet = spark.createDataFrame([(1, "capa"), (2, "FUNÇÃO"), (3, "Saúde"), (4, "Obras")], "n int, a string")
    assert rows(S.header_rows(sheet, "^FUN", "n", "a")) == [(3, "Saúde"), (4, "Obras")]


def test_parts_and_heads_of_files(spark, tmp_path):
    for name, line in (("uf_SP", "a"), ("uf_RJ", "b"), ("uf_BRASIL", "c")):
        (tmp_path / f"{name}.csv").write_bytes(f"x;y\n{line};1\n".encode("latin1"))
    assert rows(S.read_parts(spark, str(tmp_path / "*.csv"), "_BRASIL"), "x") == [("a",), ("b",)]
    assert S.first_bytes(spark, str(tmp_path / "*.csv"), 4) == b"x;y\n" and S.first_bytes(spark, str(tmp_path / "uf_SP.csv"), 1000) == b"x;y\na;1\n"
    assert S.sniff(spark, str(tmp_path)) == ("utf-8", ";")


def test_boards(spark):
    items = spark.createDataFrame([(1, "p", D(2024, 1, 1), False, None), (2, "p", D(2024, 1, 1), True, "Em análise"), (3, "p", D(2024, 1, 1), False, "Projeto APROVADO"), (4, "q", D(2024, 5, 1), False, None), (5, None, None, False, None)], "item_id int, post string, opened date, suspended boolean, outcome string")
    seats = spark.createDataFrame([("p", 1, "Ana", True), ("p", 2, "Rui", False), ("p", 3, "Eva", False)], "post string, seat int, name string, acting boolean")
    got = BD.open_items(items, seats, "2024-06-01", 120)
    assert rows(got, "item_id", "state", "responsible") == [(1, "long overdue", "Rui"), (2, "suspended", "Rui"), (4, "open", None), (5, "open", None)]
    processes = spark.createDataFrame([(1, "Reforma da saúde", D(2024, 5, 20), False, D(2024, 9, 1)), (2, "Saúde e obras", D(2024, 1, 1), True, None), (3, None, None, None, None)], "process int, title string, moved date, closed boolean, deadline date")
    views = spark.createDataFrame([("saude", D(2024, 1, 1) + dt.timedelta(weeks=w), 500 if w == 1 else 50) for w in range(12)] + [("obras", D(2024, 1, 1), 9)], "topic string, date date, value int")
    got = BD.topics(processes, {"saude": ["saude"], "obras": ["obras"], "nada": ["xyz"]}, views, "2024-06-01")
    assert rows(got) == [("nada", "none", None, None, None), ("obras", "closed", 152, 9, False), ("saude", "moving", 12, 500, True)]
    sheet = spark.createDataFrame([("a", 1, "Saúde", 30), ("a", 2, "x", 10), ("a", 3, "y", 20), ("b", 1, "Saúde", 5), ("b", 2, "z", 5), ("b", 3, "solto", 7)], "section string, n int, label string, value int")
    top, each = BD.waived(sheet, spark.createDataFrame([("Saúde", "m")], "function string, ministry string"), spark.createDataFrame([("m", 70)], "ministry string, budget int"))
    assert rows(top, "function", "waived", "ministry", "budget", "ratio") == [("Saúde", 35, "m", 70, 0.5)]
    assert rows(each, "item", "function", "value") == [("solto", None, 7), ("x", "Saúde", 10), ("y", "Saúde", 20), ("z", "Saúde", 5)]


def test_structure(spark):
    units = spark.createDataFrame([("1", "top", None, "Presidência", "órgão constitucional", True), ("2", "x", "1", "Gabinete", "autarquia", True), ("3", "x", "9", "Gabinete", None, True), ("9", "dep", "1", "Departamento", None, False), ("4", "y", "zz", "Solto", "autarquia", True)], "code string, id string, above string, name string, nature string, is_organ boolean")
    curated = spark.createDataFrame([("top", "Presidência da República", None, ["PR"]), ("hand", "Só curado", "fundação", None)], "id string, name string, nature string, aliases array<string>")
    got = ST.structure(units, curated, {"constitucional": 1, "autarquia": 1})
    assert rows(got, "id", "name", "parent", "how", "ring", "depth", "origin") == [
        ("hand", "Só curado", None, None, 3, 0, "curated"), ("top", "Presidência da República", None, None, 1, 0, "both"), ("x", "Gabinete – Presidência da República", "top", "direct", 2, 1, "generated"),
        ("x-3", "Gabinete – Presidência da República", "top", "through unit", 3, 1, "generated"), ("y", "Solto", None, None, 1, 0, "generated"),
    ]
    terms = spark.createDataFrame([("u", "Ana", D(2010, 1, 1), D(2012, 1, 1)), ("u", "Ana", D(2012, 1, 10), D(2014, 1, 1)), ("u", "Rui", D(2016, 1, 1), D(2018, 1, 1))], "unit string, person string, start date, end date")
    now = spark.createDataFrame([("u", "Eva", D(2018, 2, 1), None), ("u", "Rui", D(2016, 1, 1), D(2018, 1, 1))], terms.schema)
    assert rows(ST.history(terms, now, D(2012, 6, 1)), "person", "start", "end", "spans", "missing_predecessor") == [("Ana", D(2010, 1, 1), D(2014, 1, 1), 2, True), ("Eva", D(2018, 2, 1), None, 1, False), ("Rui", D(2016, 1, 1), D(2018, 1, 1), 1, True)]
