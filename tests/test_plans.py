"""What Spark plans before it has read a row: by the size of files alone no table that grows may be built in the driver."""

import random
import re

import pytest

from lupaspark import plans
from lupaspark.functions import columns as C
from lupaspark.operators import resolve as R

SF = "/root/testdata/sf0.1"


@pytest.mark.parametrize("name", ["j34_rule_claims", "d15_unknown_hosts", "d15_received", "j15_aligned_person"])
def test_growing_tables_are_not_broadcast(spark, name):
    plan = plans.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan


def test_abbreviations_meet_by_their_rarest_word(spark):
    """As by trying every pair; a name asked twice counts once, and no join is by the first letters alone, which all ministries share."""
    draw = random.Random(5)
    words = ["ministerio", "minas", "energia", "en", "fazenda", "faz", "nacional", "min", "mi", "m"]
    orgs = [(i, " ".join(draw.choices(words, k=draw.randint(1, 4)))) for i in range(60)]
    raws = [(" ".join(w[: draw.randint(1, len(w))] for w in draw.choices(words, k=draw.randint(1, 3))),) for _ in range(80)]
    got = R.abbrev_match(spark.createDataFrame(raws * 2, "raw string"), spark.createDataFrame(orgs, "org int, name string"))

    def begins(raw, name):
        a, i = [w for w in raw.split() if w not in C.CONNECTIVES], 0
        for w in name.split():
            i += i < len(a) and w.startswith(a[i])
        return bool(a) and a[0][:3] == name[: len(name.split()[0])][:3] and i == len(a)

    want = set()
    for (raw,) in raws:
        hits = sorted((len(name), org) for org, name in orgs if begins(raw, name))
        if hits and [n for n, _ in hits].count(hits[0][0]) == 1:
            want.add((raw, hits[0][1]))
    assert {tuple(r) for r in got.collect()} == want and len(want) > 5
    assert not re.search(r"Join \[k#\d+\]", got._jdf.queryExecution().executedPlan().toString())
