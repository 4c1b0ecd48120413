"""Folds, walks, sweeps, doublings, indexes and streams with state, each beside a plain version on odd rows."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from lupaspark.functions import columns as C
from lupaspark.functions import registration
from lupaspark.operators import gazette as Z
from lupaspark.operators import graph as G
from lupaspark.operators import people as P
from lupaspark.operators import rules as L
from lupaspark.operators import segments as SG
from lupaspark.operators import selection as SEL
from lupaspark.operators import temporal as T
from lupaspark.streaming import state as STATE

D = dt.date


def plain_segments(rows):
    out, i = [], 0
    while i < len(rows):
        label, v = rows[i]
        slack, total, closed = max(1.0, abs(v) * 1e-6), 0.0, 0
        for j in range(i + 1, len(rows)):
            if total + rows[j][1] > v + slack:
                break
            total += rows[j][1]
            if abs(total - v) <= slack:
                closed = j
                break
        out.append((label, None, closed - i if closed else None))
        out += [(x, label, None) for x, _ in rows[i + 1 : closed + 1]]
        i = closed + 1 if closed else i + 1
    return out


def test_segments(spark):
    rng = random.Random(1)
    sheets = {}
    for s in range(8):
        rows = []
        while len(rows) < 300:
            items = [rng.choice([0.0, 1, 5, 20, 300, 1e7]) * rng.random() for _ in range(rng.randint(0, 6))]
            rows += [(f"p{len(rows)}", float(sum(items)) + rng.choice([0.0, 0.0, 0.5, 40.0]))] + [(f"i{len(rows) + k + 1}", v) for k, v in enumerate(items)]
        sheets[s] = rows
    rows = [(s, n, x, v, "old") for s, r in sheets.items() for n, (x, v) in enumerate(r)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "sheet int, n int, label string, v double, parent string")
    got = SG.segment_by_sum(df, "sheet", ["n"], "label", "v")
    assert got.columns == ["sheet", "n", "label", "v", "parent", "items"]
    for s, r in sheets.items():
        mine = sorted((x.n, x.label, x.parent, x["items"]) for x in got.where(F.col("sheet") == s).collect())
        assert [m[1:] for m in mine] == sorted(plain_segments(r), key=lambda x: [y for y, _ in r].index(x[0]))
    assert SG.segment_by_sum(df.limit(0), "sheet", ["n"], "label", "v").count() == 0
    alone = spark.createDataFrame([(None, 1, "a", None, None), (None, 2, None, 3.0, None)], df.schema)
    assert {(r.label, r.parent) for r in SG.segment_by_sum(alone, "sheet", ["n"], "label", "v").collect()} == {("a", None), (None, None)}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Resolve NOMEAR ANA LIMA SOUZA, BRUNO DIAS e CARLA REIS, para exercerem o cargo de Auditor do Ministério da Fazenda.", [("nomear", n, "Auditor", "Ministério da Fazenda", None) for n in ("ANA LIMA SOUZA", "BRUNO DIAS", "CARLA REIS")]),
        ("EXONERAR, a pedido, o Sr. ANA LIMA do cargo de Chefe e NOMEAR BRUNO DIAS para o referido cargo.", [("exonerar", "ANA LIMA", "Chefe", None, None), ("nomear", "BRUNO DIAS", "Chefe", None, None)]),
        ("EXONERAR ANA LIMA do cargo de Diretor do Departamento de Obras, e NOMEAR BRUNO DIAS para o mesmo cargo.", [("exonerar", "ANA LIMA", "Diretor", "Departamento de Obras", None), ("nomear", "BRUNO DIAS", "Diretor", "Departamento de Obras", None)]),
        ("Designar: I - ANA LIMA, assessora; II - BRUNO DIAS; ambos para a função de confiança de Chefe do Gabinete do Ministro.", [("designar", n, "Chefe", "Gabinete do Ministro", None) for n in ("ANA LIMA", "BRUNO DIAS")]),
        ("NOMEAR ANA LIMA e BRUNO DIAS para os cargos de Chefe, respectivamente.", [("nomear", n, None, None, "posts do not fit") for n in ("ANA LIMA", "BRUNO DIAS")]),
        ("Tornar sem efeito a portaria que nomeou ANA LIMA para o cargo de Chefe.", []),
        ("NOMEAR Comissão de Ética, para o cargo de Chefe.", [("nomear", "Comissão de Ética", None, None, "unclear name")]),
        ("NOMEAR ANA LIMA, matrícula 12; EXONERAR BRUNO DIAS, da função de Chefe, código 3, da Secretaria de Obras", [("nomear", "ANA LIMA", None, None, "no post"), ("exonerar", "BRUNO DIAS", "Chefe", "Secretaria de Obras", None)]),
        ("O Dr. BRUNO DIAS falou.", []), ("", []), ("NOMEAR", []), ("...;;,,", []),
    ],
)
def test_clause_walk(text, want):
    assert [(e["verb"], e["name"], e["post"], e["organ"], e["reason"]) for e in Z.walk(text)] == want


def test_walk_acts_on_odd_rows(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "Nomear, a contar de 1º de maio de 2023, Ana Lima para o cargo de Chefe. " * 3), (3, "x" * 100_000)], "doc_id long, text string")
    got = Z.walk_acts(df).orderBy("act_no").collect()
    assert [(r.doc_id, r.act_no, r.name, r.since, r.post) for r in got] == [(3, n, "Ana Lima", D(2023, 5, 1), "Chefe") for n in range(3)]
    assert Z.walk_acts(df.limit(0)).count() == 0


def test_heads_are_assigned_once():
    label, stop = re.compile(Z._LABELS), re.compile(Z._STOP)
    names = lambda *lines: [(lines[i], lines[j]) for i, j in Z.assigned(list(lines), label, stop, 3)]
    assert names("Presidente", "Ana Lima", "Diretor", "Rui Costa") == [("Presidente", "Ana Lima"), ("Diretor", "Rui Costa")]
    assert names("Ana Lima", "Presidente", "Rui Costa", "Diretor") == [("Presidente", "Ana Lima"), ("Diretor", "Rui Costa")]
    assert names("Chefe", "Sala 2", "Ana Lima", "Coordenador", "Rui Costa") == [("Chefe", "Ana Lima"), ("Coordenador", "Rui Costa")]
    assert names("Presidente", "Galeria de ex-presidentes", "Ana Lima") == [] and names("Presidente", "a", "b", "c", "Ana Lima") == [] and names() == []
    assert names("Diretor", "Presidente", "Ana Lima") == [("Presidente", "Ana Lima")]


def plain_align(a, b):
    def close(x, y):
        if x == y:
            return True
        if len(x) < 5 or abs(len(x) - len(y)) > 1:
            return False
        if len(x) == len(y):
            return sum(p != q for p, q in zip(x, y)) == 1
        long, short = (x, y) if len(x) > len(y) else (y, x)
        return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))

    i = 0
    for w in b:
        if i < len(a) and close(a[i], w):
            i += 1
    return i


def test_aligned_person_is_exhaustive(spark):
    """Every pair that counts is met: the index against all pairs."""
    rng = random.Random(4)
    vocabulary = ["ana", "maria", "jose", "silva", "souza", "moraes", "morais", "pereira", "pereyra", "costa", "lima", "oliveira", "olivera", "reis"]
    name = lambda: [rng.choice(vocabulary[:3])] + rng.choices(vocabulary[3:], k=rng.randint(1, 3))  # noqa: E731  a word may come twice
    left, right = [(i, name(), rng.choice(["fazenda", "saude obras", None])) for i in range(60)], [(i, name(), rng.choice(["fazenda", "obras", None])) for i in range(80)]
    organ = lambda x, y: len(set((x or "").split()) & set((y or "").split())) / max(1, len(set((x or "").split()) | set((y or "").split())))
    want = {}
    for i, a, ao in left:
        found = []
        for j, b, bo in right:
            m, back, o = plain_align(a, b), plain_align(b, a), organ(ao, bo)
            mode = "exact" if a == b else None if a[0] not in b else "subsequence" if m == len(a) or (m >= 3 and back == len(b)) else "fuzzy" if m >= 3 and m >= min(len(a), len(b)) - 1 and o >= 0.3 else None
            if mode:
                found.append((mode, o, -j, b))
        found = [x for x in found if x[0] == "exact"] or found
        best = max(found, key=lambda x: x[1:3], default=None)
        if best is None:
            want[i] = (None, None, "no match")
        elif len({tuple(x[3]) for x in found}) > 1 and best[1] == 0:
            want[i] = (None, None, "homonyms")
        else:
            want[i] = (-best[2], best[0], None)
    a = spark.createDataFrame([(i, " ".join(n), o, False) for i, n, o in left] + [(900, None, None, None)], "left_id long, name string, organ string, is_head boolean")
    b = spark.createDataFrame([(i, " ".join(n), o, None, False, True, D(2024, 1, 1)) for i, n, o in right] + [(900, "", None, None, None, None, None)], "right_id long, name string, organ string, ended date, is_top boolean, titular boolean, start date")
    got = {r.left_id: (r.right_id, r["mode"], r.reason) for r in P.aligned_person(a, b).collect()}
    assert got == want | {900: (None, None, "no match")} and len({w[2] for w in want.values()}) == 3
    assert P.aligned_person(a.limit(0), b).count() == 0 and P.aligned_person(a, b.limit(0)).where("reason = 'no match'").count() == 61


def test_aligned_person_ties(spark):
    a = spark.createDataFrame([(1, "Ana Lima", "Banco Central", True)], "left_id long, name string, organ string, is_head boolean")
    row = lambda i, organ="Banco Central", ended=None, top=False, titular=True, start=D(2020, 1, 1): (i, "ANA LIMA", organ, ended, top, titular, start)
    kind = "right_id long, name string, organ string, ended date, is_top boolean, titular boolean, start date"
    best = lambda *rows: P.aligned_person(a, spark.createDataFrame(list(rows), kind)).first().right_id
    assert best(row(1, organ="Banco"), row(2)) == 2 and best(row(1, ended=D(2021, 1, 1)), row(2)) == 2 and best(row(1), row(2, top=True)) == 2
    assert best(row(1, titular=False), row(2)) == 2 and best(row(1), row(2, start=D(2021, 1, 1))) == 2 and best(row(2), row(1)) == 1


@pytest.mark.parametrize(("pattern", "want"), [("ring$", ["ring"]), ("^red .*et$", ["red "]), ("a|bcd", None), ("abc|bcde", ["abc", "bcde"]), ("(abc)+d", None), ("abcd?e", ["abc"]), (r"ab\.cd", ["ab.cd"]), ("[a-z]+xyz{2}w", ["xy"]), ("abc+def", ["abc"]), ("", None)])
def test_required_literals(pattern, want):
    assert L.required(pattern) == (None if want == ["xy"] else want)


def test_rules(spark):
    targets = spark.createDataFrame([("a-reitor", "Reitor da UFX", "univ"), ("b-reitor", "Reitora", "univ"), ("c", "Presidente", "estatal"), ("d", None, None), ("e", "Diretor", "estatal")], "id string, name string, subtype string")
    rules = [("r", "glob", "*-reitor"), ("r", "except", "b-reitor"), ("s", "subtype", "estatal"), ("s", "name", "^Presid"), ("t", "id", "c"), ("t", "id", "zz"), ("u", "glob", "?*"), ("v", "name", "Conselh"), ("w", "glob", "[ab]-rei?or"), ("x", "id", None)]
    one, twice, errors = L.rule_claims(targets, spark.createDataFrame(rules, "family string, kind string, pattern string"))
    assert {tuple(r) for r in one.collect()} == {("b-reitor", "w")}
    assert {tuple(r) for r in twice.collect()} == {("c", "s,t"), ("a-reitor", "r,w")}
    assert {tuple(r) for r in errors.collect()} == {("t", "id", "zz", "no such id"), ("u", "glob", "?*", "no 3 letters are required"), ("v", "name", "Conselh", "pattern meets no target")}
    assert all(x.count() == 0 for x in L.rule_claims(targets, spark.createDataFrame([], "family string, kind string, pattern string")))


def test_sweep(spark):
    rng = random.Random(5)
    day = lambda n: D(2020, 1, 1) + dt.timedelta(days=n)
    spans = [(i, s, None if rng.random() < 0.1 else s + rng.randint(-3, 200)) for i, s in enumerate(rng.choices(range(-300, 900), k=120))] + [(500, None, 5), (501, 10, 10), (502, 10, 10)]
    days = list(range(-50, 700, 3)) + [10, 10]
    got = T.who_was(spark.createDataFrame([(day(d),) for d in days] + [(None,)], "d date"), spark.createDataFrame([(i, None if s is None else day(s), None if e is None else day(e)) for i, s, e in spans], "holder int, since date, until date"), "d")
    want = sorted((str(day(d)), max(((s, i) for i, s, e in spans if s is not None and s <= d and (e is None or d <= e)), default=(0, None))[1]) for d in days)
    assert sorted((str(r.d), r.holder) for r in got.collect() if r.d) == want and got.where("d is null").count() == 1


def test_split_medians(spark):
    import statistics

    rng = random.Random(6)
    groups = {"one": [5.0], "ties": [1.0] * 500 + [2.0] * 500, "skew": [rng.random() ** 40 for _ in range(999)] + [1e12], "even": [float(x) for x in range(200)], None: [-3.0, 7.5], "negative": [rng.gauss(0, 1) for _ in range(777)]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs] + [("one", None), ("none", None)], "g string, v double")
    for bins in (3, 1024):
        assert {r.g: (r.n, r["median"]) for r in SEL.split_median(df, ["g"], "v", bins).collect()} == {g: (len(v), statistics.median(v)) for g, v in groups.items()}
    assert SEL.split_median(df.limit(0), ["g"], "v").count() == 0


def test_graph_of_any_depth(spark):
    rng = random.Random(7)
    parent = {i: i - 1 if i % 300 else None for i in range(600)} | {700: 701, 701: 702, 702: 700, 703: 700, 710: 710, 720: 9999} | {800 + i: rng.choice([None, *range(600)]) for i in range(50)}
    nodes = spark.createDataFrame([(i, p, rng.randint(0, 2) if i % 5 else None) for i, p in parent.items()], "id long, parent long, ring int")
    ring = {r.id: r.ring or 0 for r in nodes.collect()}

    def up(i):
        out = []
        while parent.get(i) is not None and parent[i] not in out and parent[i] in parent:
            i = parent[i]
            out.append(i)
        return out

    for r in G.depths(nodes).collect():
        walk = up(r.id)
        cyclic = parent.get(walk[-1] if walk else r.id) in ring if walk or parent[r.id] in ring else False
        assert r.cyclic == bool(cyclic)
        if not cyclic:
            assert (r.depth, r.ring) == (len(walk), min(4, max([ring[r.id], *[ring[a] + d for d, a in enumerate(walk, 1)]])))
        else:
            assert (r.depth, r.ring) == (None, 4)
    got = {(r.node, r.ancestor): r.depth for r in G.full_closure(nodes.drop("ring")).collect()}
    want = {(i, a): d for i in parent for d, a in enumerate(up(i), 1) if a != i} | {(720, 9999): 1}
    assert got == want
    assert G.depths(nodes.limit(0)).count() == 0 and G.full_closure(nodes.limit(0).drop("ring")).count() == 0


def test_hub_in_pages(spark):
    e = spark.createDataFrame([("hub", f"n{i}") for i in range(1000)] + [("n1", "n2"), ("n1", "n2"), (None, "x"), ("n2", None)], "from string, to string")
    pages = G.pages_of_neighbours(e, 50).collect()
    hub = [r for r in pages if r.id == "hub"]
    assert len(hub) == 20 and sorted(x for r in hub for x in r.neighbours) == sorted(f"n{i}" for i in range(1000)) and max(len(r.neighbours) for r in hub) < 100
    assert [(r.way, r.page, r.neighbours) for r in pages if r.id == "n1"] in ([("out", 0, ["n2"]), ("in", 0, ["hub"])], [("in", 0, ["hub"]), ("out", 0, ["n2"])])


def test_expiring_state(spark, tmp_path):
    at = lambda d: dt.datetime(2024, 1, 1) + dt.timedelta(days=d)
    src = str(tmp_path / "in")
    schema = "k long, t timestamp, v double"
    put = lambda rows: spark.createDataFrame([(k, at(d), v) for k, d, v in rows], schema).coalesce(1).write.mode("append").parquet(src)
    put([(1, 0, 5.0), (1, 1, None), (1, 9, None), (2, 0, None), (None, 0, 1.0)])
    stream = lambda: spark.readStream.schema(schema).parquet(src)
    rows = lambda df: sorted((r.key, (r.at - at(0)).days, *[r[c] for c in df.columns[2:] if c != "seen"]) for r in df.collect())
    asked = lambda: rows(STATE.run_now(STATE.ask_again(stream(), "k", "t", 3), str(tmp_path / "asked")))
    carried = lambda: rows(STATE.run_now(STATE.carry_on(stream(), "k", "t", "v", 3), str(tmp_path / "carried")))
    assert asked() == [(1, 0), (1, 9), (2, 0)]
    assert carried() == [(1, 0, 5.0, "current"), (1, 1, 5.0, "carried"), (1, 3, 5.0, "expired")]
    put([(1, 10, None), (1, 30, 7.0), (2, 31, None)])  # the state goes on where it was
    assert asked() == [(1, 0), (1, 9), (1, 30), (2, 0), (2, 31)]
    assert carried() == [(1, 0, 5.0, "current"), (1, 1, 5.0, "carried"), (1, 3, 5.0, "expired"), (1, 30, 7.0, "current")]


def test_functions_by_name(spark):
    """Each helper gives from SQL text what its column gives."""
    names = registration.register(spark)
    texts = ["São João da Silva Filho", "Secretaria-Geral da Presidência", "R$ 1.234,56", "03/02/2024", "3 de março de 2024", "Obras Boas Ltda ME", "12.345.678/0001-95", "Audiência pública", "", None, "Neto"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string")
    df.createOrReplaceTempView("lupaspark_texts_of_test")
    same = registration.PLAIN | {"words_of": ("x STRING", C.tokens), "core_name": ("x STRING", C.core_name), "name_key_full": ("x STRING", C.name_key_full), "name_key_base": ("x STRING", C.name_key_base)}
    for name, (params, build) in same.items():
        if "DATE" not in params:
            got = spark.sql(f"SELECT i, {name}(x) AS y FROM lupaspark_texts_of_test ORDER BY i").collect()
            assert got == df.select("i", build(F.col("x")).alias("y")).orderBy("i").collect(), name
    assert spark.sql("SELECT week_start(DATE '2024-02-01')").first()[0] == D(2024, 1, 29) and spark.sql("SELECT html_unescape('a&amp;b')").first()[0] == "a&b"
    acts = spark.sql("SELECT verb, name, post FROM VALUES ('NOMEAR ANA LIMA e RUI REIS para o cargo de Chefe.'), (NULL) AS t(text), LATERAL parse_acts(text)").collect()
    assert {tuple(r) for r in acts} == {("nomear", "ANA LIMA", "Chefe"), ("nomear", "RUI REIS", "Chefe")}
    people = spark.sql("SELECT * FROM participants(array('antes', 'Agentes públicos:', 'Ana Lima (ministra) - MF', 'Agentes privados', 'Rui Reis'))").collect()
    assert {tuple(r) for r in people} == {("public", "Ana Lima", "ministra", "MF"), ("private", "Rui Reis", None, None)}
    assert {"norm_alpha", "core_name", "parse_acts", "participants"} <= set(names)
