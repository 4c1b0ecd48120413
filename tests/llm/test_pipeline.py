"""The pipeline's stages: over the smallest tables, and each on odd rows beside a plain version."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from lupaspark.llm import toxicity
from lupaspark.llm.common import written
from lupaspark.llm.simhash import fingerprint

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, ids = docs.columns, {r[0] for r in docs.select("doc_id").collect()}
    for name, stage in pipeline.STAGES:
        docs = written(stage(spark, docs, SF), name)
        left = {r[0] for r in docs.select("doc_id").collect()}
        assert left and left <= ids, name
        assert docs.columns == columns or name == pipeline.STAGES[-1][0]
        ids = left
    assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


CLASHING = "doc_id long, text string, n_chars int, row int, name string, removed int, removed_lines string, component_id long, fp long, toxic int, item_id long, words string, h long, label int, `a.b` string, `c d` int"


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Rows with nulls, empty and long texts, ties and repeats, in a table whose columns have names that the operators use inside."""
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(300)]
    prose = lambda n: " ".join(rng.choices(vocabulary, k=n))
    item = prose(30)
    rows = [(i, prose(60) + (" vermin" if i % 9 == 0 else "")) for i in range(120)]
    rows += [(200, rows[1][1]), (201, rows[1][1]), (201, rows[1][1]), (202, rows[2][1] + "\nfresh line of this document\n" + rows[3][1])]
    rows += [(203, prose(20) + " " + item + " " + prose(20)), (None, item.upper()), (None, prose(40)), (204, None), (205, ""), (206, " \n\t"), (207, "word " * 20_000), (208, "x" * 30_000)]
    home = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(i, i % 2, int(i % 9 == 0)) for i in range(120)] + [(5, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{home}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{home}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{home}/none/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{home}/none/benchmark.parquet")
    docs = spark.createDataFrame([(i, t, len(t or ""), 1, "n", 2, "r", 3, 4, 5, 6, "w", 7, 8, "ab", 9) for i, t in rows], CLASHING)
    return home, rows, docs


def plain_lines(rows):
    """Rows without lines of 20 characters and more that stand earlier; the lines here are equal or far apart."""
    order = sorted(((-1 if i is None else i, n, x) for i, t in rows if t for n, x in enumerate(t.split("\n")) if len(x) >= 20), key=lambda p: p[:2])
    first = {}
    for i, n, x in order:
        first.setdefault(x, (i, n))
    out = []
    for i, t in rows:
        if not t:
            out.append((i, t))
            continue
        stay = [x for n, x in enumerate(t.split("\n")) if len(x) < 20 or first[x] == (-1 if i is None else i, n)]
        if len(stay) == t.count("\n") + 1 or "".join(stay).strip():
            out.append((i, "\n".join(stay)))
    return out


def plain_groups(rows):
    """Rows whose doc_id is the smallest that links of at most two bits reach, and those without one."""
    prints = {}
    for i, t in rows:
        prints.setdefault(fingerprint((t or "").encode()), set()).add(i)
    group = {f: f for f in prints}
    for f in prints:
        for g in prints:
            if (f ^ g).bit_count() <= 2 and any(x is not None for x in prints[f]) and any(x is not None for x in prints[g]):
                old, new = group[g], group[f]
                group = {k: new if v == old else v for k, v in group.items()}
    least = {}
    for f, ids in prints.items():
        least[group[f]] = min([x for x in ids if x is not None] + ([least[group[f]]] if group[f] in least else []), default=None)
    return [(i, t) for i, t in rows if i is None or least[group[fingerprint((t or "").encode())]] == i]


def kept(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_each_stage_on_odd_rows(spark, odd):
    home, rows, docs = odd
    stages = dict(pipeline.STAGES)
    every = sorted(rows, key=str)

    clean = stages["toxicity"](spark, docs, home)
    judged = {(r.doc_id, r.text) for r in docs.select("doc_id", "text").join(toxicity.scored(docs, spark.read.parquet(f"{home}/labels.parquet")).where("predicted = 1").select("doc_id"), "doc_id").collect()}
    assert clean.columns == docs.columns and kept(clean) == [r for r in every if r not in judged]
    assert {i for i, _ in judged} >= {i for i in range(0, 120, 9)} and len(judged) <= 16

    lines = stages["line_dedup"](spark, docs, home)
    assert lines.columns == docs.columns and kept(lines) == sorted(plain_lines(rows), key=str)
    assert lines.where(F.col("n_chars") != F.length("text")).count() == 0

    groups = stages["simhash"](spark, docs, home)
    assert groups.columns == docs.columns and kept(groups) == sorted(plain_groups(rows), key=str)

    free = stages["decontamination"](spark, docs, home)
    assert free.columns == docs.columns and kept(free) == [r for r in every if r[0] != 203 and not (r[0] is None and r[1].isupper())]

    tokens = stages["bpe"](spark, docs, home)
    assert tokens.count() == len(rows) and tokens.where("doc_id is null").count() == 2


def test_each_stage_on_empty_tables(spark, odd):
    home, rows, docs = odd
    for name, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), home).count() == 0, name
        if name in ("toxicity", "decontamination"):  # nothing to learn from or to look for
            assert stage(spark, docs, f"{home}/none").count() == len(rows)
