"""Fill-in-the-middle, suffix dedup and importance resampling against brute force and on the odd cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from lupaspark.llm import infill, queries, resampling, rolling, suffixes

DOCS = "doc_id long, text string, lang string, output string, block long, rank long, h long"
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two"), (6, "A b C d é ß 日本 x"), (6, "A b C d é ß 日本 x"), (7, "A b C d é ß 日本 x"), (None, "no id here at all, but more than fifty bytes of text to see"), (8, "word " * 30000), (9, "x" * 5000)]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "o", 2, 3, 4) for i, t in rows], DOCS)


def sha(data):
    return hashlib.sha256(data).hexdigest()


def test_rolling_hash_is_a_sum_over_its_window():
    data = np.frombuffer(random.Random(1).randbytes(300), dtype=np.uint8)
    got = rolling.rolling(data)
    for i in range(300):
        assert int(got[i]) == sum(int(rolling._TABLE[data[i - k]]) * pow(rolling._BASE, k, 1 << 32) for k in range(min(i + 1, rolling.WINDOW))) % (1 << 32)
    whole = rolling.cuts(data, 8).tolist()
    assert whole == [i + 1 for i in range(300) if int(got[i]) % 8 == 0]
    rolling.BLOCK, keep = 64, rolling.BLOCK
    try:
        assert rolling.cuts(data, 8).tolist() == whole
    finally:
        rolling.BLOCK = keep


TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_infill(i, t):
    t = t or ""
    tokens = TOKEN.findall(t)
    assert "".join(tokens) == t
    digest = sha(f"42:{'' if i is None else i}".encode())
    h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
    n = len(tokens)
    if not t or any(s in t for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return i, n, "plain", None, None, sha(t.encode()), sha(t.encode())
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 80 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return i, n, form, len(p), len(m), sha(out.encode()), sha(t.encode())


def test_infill(spark):
    rng = random.Random(5)
    parts = ["a", "bb", "é日", " ", "  ", "\n", "\t\r", "<", "P>", "<S", ">", "\x1c", "　", "word", "x" * 40]
    rows = [(100 + i, "".join(rng.choices(parts, k=rng.randint(0, 400)))) for i in range(300)]
    rows += [(500 + i, "start <P> here") for i in range(8)] + [(600 + i, "x" * 20_000 + " " + "y z" * 5000) for i in range(8)] + [(620 + i, " " * 20_000) for i in range(8)]
    rows += [(700 + i, t) for i, (_, t) in enumerate(rows[:60])]  # shared chunks
    got = queries.op11_columns(docs(spark, ODD + rows)).collect()
    assert sorted(map(tuple, got), key=str) == sorted((plain_infill(i, t) for i, t in ODD + rows), key=str)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert queries.op11_columns(docs(spark, [])).count() == 0


def test_counts_combine_for_any_cuts():
    """Every token's end, whatever the cuts, with a cache that is emptied all the time and one that is not."""
    rng = random.Random(6)
    small, large = infill.Summaries(40), infill.Summaries()
    for _ in range(300):
        t = "".join(rng.choices(["ab", "é", " ", "\n", "日本"], k=rng.randint(1, 40)))
        data = t.encode()
        cuts = sorted(rng.sample(range(1, len(data) + 1), rng.randint(0, min(6, len(data))))) + [len(data)]
        ends = [0, *[m.end() for m in TOKEN.finditer(t)]]
        for known in (small, large):
            counted = infill.Counted(data, cuts, known)
            assert counted.n == len(ends) - 1
            for k, end in enumerate(ends):
                assert counted.end_of(k) == (len(t[:end].encode()), end)
    assert large.hits > 100


def plain_suffixes(rows, length=50):
    last = 1 << 62
    first = {}
    known = [(last if i is None else i, (t or "").encode()) for i, t in rows]
    for d, t in known:
        for k in range(len(t) - length + 1):
            w = t[k : k + length]
            first[w] = min(first.get(w, d), d)
    out = []
    for d, t in known:
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if first[t[k : k + length]] < d:
                gone[k : k + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out.append((None if d == last else d, len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(kept)))
    return out


def prose(rng, n, letters="abcdefgh"):
    return " ".join("".join(rng.choices(letters, k=rng.randint(2, 7))) for _ in range(n))


@pytest.mark.parametrize("small", [False, True])
def test_suffix_dedup(spark, small, monkeypatch):
    rng = random.Random(7)
    if small:  # many blocks and buckets
        monkeypatch.setattr(suffixes, "BLOCK", 2000)
        monkeypatch.setattr(suffixes, "KEYS", 100)
        monkeypatch.setattr(suffixes, "BUCKET", 2000)
    passage = prose(rng, 60)
    rows = [(i, prose(rng, rng.randint(5, 120))) for i in range(60)]
    rows += [(100 + i, prose(rng, 20) + " " + passage[i : 60 + 7 * i] + " é " + prose(rng, 20)) for i in range(40)]
    near = rows[3][1]
    rows += [(200 + i, near[:k] + "#" + near[k:]) for i, k in enumerate(rng.choices(range(len(near)), k=30))]
    rows += [(300, rows[5][1]), (301, rows[5][1]), (5, rows[5][1]), (2, rows[7][1]), (400, "ab" * 500), (401, "ba" * 300), (402, "a" * 49), (403, "a" * 50), (404, "a" * 51), (405, passage[:49]), (None, passage), (None, "日本" * 30 + passage)]
    rows = ODD + rows
    rng.shuffle(rows)
    got = queries.op12_columns(docs(spark, rows)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(plain_suffixes(rows), key=str)
    assert queries.op12_columns(docs(spark, [])).count() == 0
    assert queries.op12_columns(docs(spark, [(1, None), (2, "short")])).count() == 2


@pytest.mark.parametrize("length", [50, 64])
def test_suffix_bucket(length):
    """One bucket over few letters, so that ties are long; each string with a smaller owner is found, and no other."""
    rng = random.Random(8)
    base = "".join(rng.choices("ab", k=400))
    texts = list({base[i : i + length + rng.randint(0, 60)].encode() for i in rng.choices(range(330), k=200)} | {b"a" * 90, b"ab" * 70})
    texts = [t for t in texts if len(t) >= length]
    owners = np.array([rng.randrange(12) for _ in texts])
    first = {}
    for t, d in zip(texts, owners.tolist()):
        for k in range(len(t) - length + 1):
            first[t[k : k + length]] = min(first.get(t[k : k + length], d), d)
    base, found = suffixes.earlier(texts, owners, length)
    spans = suffixes.covered(base, found, length)
    for n, (t, d, got) in enumerate(zip(texts, owners.tolist(), np.split(found, base[1:]), strict=True)):
        want = [first[t[k : k + length]] < d for k in range(len(t) - length + 1)]
        assert got.tolist() == want
        bytes_under = {k + x for k, w in enumerate(want) if w for x in range(length)}
        assert {x for i, j in spans.get(n, []) for x in range(i, j)} == bytes_under


def test_covers():
    for period, cover in ((suffixes.PERIOD, suffixes.COVER), (suffixes.TIE_PERIOD, suffixes.TIE_COVER)):
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_beside_sql(spark, name):
    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got = queries.queries()[name](spark, sf)
    want = con.sql(queries.oracle_sql()[name])
    assert sorted(want.columns) == sorted(got.columns)
    assert sorted(map(tuple, got.select(want.columns).collect()), key=str) == sorted(want.fetchall(), key=str)


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_features(t, order):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    return len(words), [" ".join(words[i : i + n]) for n in range(1, order + 1) for i in range(len(words) - n + 1)]


def plain_drawn(rows, target, order=1, buckets=10_000):
    def counts(texts):
        return Counter(zlib.crc32(f.encode()) % buckets for t in texts for f in plain_features(t, order)[1])

    s, t = counts([x for _, x in rows]), counts(target)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s.values()) + buckets) / ((s[b] + 1) * (sum(t.values()) + buckets)))) for b in range(buckets)]
    out, held = [], []
    for i, x in rows:
        n, fs = plain_features(x, order)
        weight = sum(gain[zlib.crc32(f.encode()) % buckets] for f in fs)
        if i is None:
            out.append((i, len(fs), weight, None, None))
            continue
        h = int(sha(f"2024:{i}".encode())[:8], 16)
        row = (i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))))
        held.append(row) if n >= 20 else out.append((*row, None))
    held.sort(key=lambda r: (-r[3], r[0], r[2], r[1]))
    k = 10 * len(held) // 100
    return out + [(*r, n + 1 if n < k else None) for n, r in enumerate(held)]


@pytest.mark.parametrize("order,buckets", [(1, 10_000), (3, 500)])
def test_resampling(spark, order, buckets):
    rng = random.Random(9)
    rows = ODD + [(100 + i, prose(rng, rng.randint(0, 60), "abAB é9_-")) for i in range(400)]
    rows += [(900, rows[40][1]), (900, rows[40][1]), (900, prose(rng, 30))]
    target = [prose(rng, 40, "abé") for _ in range(20)] + [None, ""]
    bench = spark.createDataFrame([(i, t, 1) for i, t in enumerate(target)], "item_id long, text string, score long")
    got = resampling.drawn(docs(spark, rows), bench, order=order, buckets=buckets)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(plain_drawn(rows, target, order, buckets), key=str)
    assert resampling.drawn(docs(spark, []), bench).count() == 0
    assert {tuple(r) for r in resampling.drawn(docs(spark, rows), bench.limit(0)).collect()} == set(plain_drawn(rows, []))


@pytest.mark.parametrize("order", [1, 2, 4])
def test_features_of_blocks(order):
    rng = random.Random(10)
    t = prose(rng, 200, "abcé日9-")
    want = Counter(zlib.crc32(f.encode()) for f in plain_features(t, order)[1])
    for block in (1, 7, 50, 1 << 20):
        n_words, n, counts = resampling.features(t.encode(), order, block)
        assert (n_words, counts, n) == (plain_features(t, 1)[0], want, sum(want.values()))
