"""Each operator against brute force and on the odd cases: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import hashlib
import io
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from lupaspark.llm import bpe, common, decontam, lattice, linededup, neardup, queries, simhash, tokencounts, toxicity, urlfilter, warc

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
DOCS = "doc_id long, text string, lang string, component_id long, fp long, word string, h long"
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two"), (6, "A b C d é ß 日本 x"), (6, "A b C d é ß 日本 x"), (7, "A b C d é ß 日本 x"), (None, "no id here at all"), (8, "word " * 30000), (9, "x" * 5000)]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", 1, 2, "w", 3) for i, t in rows], DOCS)


def groups(links, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def test_looked_up(spark):
    """A key of most rows, light keys, keys that one side lacks, and null keys: the rows of a plain join."""
    left = spark.createDataFrame([(i, None if i % 11 == 0 else 0 if i % 3 else i % 50, i) for i in range(3000)], "id long, k long, n long")
    right = left.groupBy("k").agg(F.count("*").alias("n")).where("k is not null and k <> 7").withColumn("v", F.when(F.col("k") % 2 == 0, F.col("k") * 10))
    got = common.looked_up(left, right, ["k"], "id")
    assert got.columns == ["id", "k", "n", "v"]
    want = left.join(right.select("k", "v"), "k").select("id", "k", "n", "v")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert common.looked_up(left, right.limit(0), ["k"], "id").count() == 0


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(5, 5)]
    got = {r[0]: r[1] for r in common.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = groups(links, {x for p in links for x in p})
    assert got == {n: c for n, c in want.items() if n != c}
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_simhash(spark):
    rng = random.Random(2)
    base = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(60)) for _ in range(4)]
    near = [(100 + i, b + " extra" * (i % 3)) for i, b in enumerate(base * 8)]
    got = simhash.near_duplicates(docs(spark, ODD + near)).collect()
    rows = ODD + near
    fps = {(i, plain_fingerprint(t)) for i, t in rows}
    assert len(got) == len(rows)
    assert {(r.doc_id, r.fingerprint) for r in got} == {(i, f"{f:016x}") for i, f in fps}
    known = [(i, f) for i, f in fps if i is not None]
    want = groups([(i, j) for i, f in known for j, g in known if (f ^ g).bit_count() <= 2], {i for i, _ in known})
    assert all(r.component_id == want[r.doc_id] for r in got if r.doc_id is not None)
    assert simhash.near_duplicates(docs(spark, [])).count() == 0
    kept = simhash.deduplicated(docs(spark, rows))
    assert kept.columns == docs(spark, []).columns
    assert {r.doc_id for r in kept.collect()} == {r.component_id for r in got if r.doc_id is not None} | {None}


def test_simhash_links_all_close_pairs(spark):
    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(20)}
    for f in list(fps):
        for _ in range(12):
            g = f
            for _ in range(rng.randint(1, 3)):
                g ^= 1 << rng.randrange(64)
            fps.add(g)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = list(enumerate(sorted(fps)))
    got = {tuple(sorted(r)) for r in simhash.links(spark.createDataFrame([(i, signed(f)) for i, f in rows], "rep long, fp long")).collect()}
    assert got == {(i, j) for i, f in rows for j, g in rows if i < j and (f ^ g).bit_count() <= 2}


def test_bpe_is_tiktoken(spark):
    tokens = bpe.read_ranks(RANKS)
    hashed = bpe.PerfectHash(tokens)
    assert sorted(hashed.slots) == list(range(len(tokens))) and hashed.get(b"not a token at all") == -1
    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    rng = random.Random(4)
    odd = [(i, "".join(rng.choice([" ", "  ", "\n", "a", "The", "'s", "é", "12", "!", "\x1c", "\t", "ing", ".\n", "日", "<|endoftext|>"]) for _ in range(rng.randint(0, 30)))) for i in range(200)]
    rows = ODD + odd
    got = bpe.digests(docs(spark, rows), RANKS, PATTERN).collect()
    assert len(got) == len(rows)
    for r, (i, t) in zip(sorted(got, key=lambda r: (str(r[0]), r[2])), sorted(((i, t) for i, t in rows), key=lambda x: (str(x[0]), hashlib.sha256(np.array(own.encode_ordinary(x[1] or ""), "<u4").tobytes()).hexdigest())), strict=True):
        ids = own.encode_ordinary(t or "")
        assert (r.doc_id, r.n_tokens) == (i, len(ids))
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    there_and_back = bpe.decoded(bpe.encoded(docs(spark, odd), RANKS, PATTERN), RANKS, PATTERN)
    assert {tuple(r) for r in there_and_back.collect()} == set(odd)
    assert bpe.digests(docs(spark, []), RANKS, PATTERN).count() == 0


@pytest.mark.parametrize("rule", tokencounts.RULES)
def test_token_counts(spark, rule):
    rows = ODD + [(20, "a\n\n\nb c\nd"), (21, "\n"), (22, "é\nüü\n日本")]
    got = tokencounts.attributed(docs(spark, rows), RANKS, PATTERN, rule=rule).collect()
    own = bpe.Encoder(bpe.read_ranks(RANKS), PATTERN)
    for i, t in rows:
        mine = sorted((r for r in got if r.doc_id == i), key=lambda r: r.section)
        copies = sum(1 for j, _ in rows if j == i)
        total = sum(len(p) // 4 for p in own.encode(t or ""))
        assert sum(r.n_tokens for r in mine) == total * copies and {r.doc_tokens for r in mine} == {total}
        if copies == 1:
            assert [(r.start, r.stop) for r in mine] == [(a, b) for a, b in _sections(t or "")]
    assert tokencounts.attributed(docs(spark, []), RANKS, PATTERN).count() == 0


@pytest.mark.parametrize("rule", tokencounts.RULES)
def test_token_counts_of_sections(spark, rule):
    """Tokens laid over sections character by character; marks within tokens, so that tokens cross."""
    rng = random.Random(12)
    rows = [(i, "".join(rng.choice(["the ", "nation", " of", "al", "é", "日本", ".", "\n", "  ", "12"]) for _ in range(rng.randint(1, 60)))) for i in range(60)]
    tokens = bpe.read_ranks(RANKS)
    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={b: i for i, b in enumerate(tokens)}, special_tokens={})
    mark = "at"
    got = {(r.doc_id, r.section): (r.n_tokens, r.crossing) for r in tokencounts.attributed(docs(spark, rows), RANKS, PATTERN, mark=mark, rule=rule).collect()}
    want, crossed = {}, 0
    for i, text in rows:
        section, bounds = [], 0
        for c in range(len(text)):
            section.append(bounds)
            if text[: c + 1].endswith(mark) and (c + 1 == len(text) or c + 1 >= 2):
                bounds += c + 1 < len(text)
        for s in range((section[-1] if section else 0) + 1):
            want[i, s] = [0, 0]
        at = 0
        # A byte's character counts as read once its first byte is; a token holds the characters that it is first to read.
        lead = [c for c, x in enumerate(text) for _ in x.encode()]
        done = 0
        for n in map(len, map(tokens.__getitem__, own.encode_ordinary(text))):
            stop = lead[at + n - 1] + 1
            mine = [section[c] for c in range(done, stop)] or [section[min(done, len(text) - 1)]]
            at, done = at + n, stop
            pick = mine[0] if rule == "start" else mine[-1] if rule == "end" else max(sorted(set(mine)), key=mine.count)
            want[i, pick][0] += 1
            want[i, pick][1] += len(set(mine)) > 1
            crossed += len(set(mine)) > 1
    assert crossed > 10 and got == {k: tuple(v) for k, v in want.items()}


def _sections(t):
    out, at = [], 0
    for line in t.split("\n")[:-1]:
        out.append((at, at + len(line) + 1))
        at += len(line) + 1
    return out + ([(at, len(t))] if at < len(t) or not out else [])


def test_token_counts_crossing_rules():
    starts, ends, bounds = np.array([0, 2, 5]), np.array([2, 5, 6]), np.array([0, 3, 6])
    assert tokencounts.section_of(starts, ends, bounds, "start").tolist() == [0, 0, 1]
    assert tokencounts.section_of(starts, ends, bounds, "end").tolist() == [0, 1, 1]
    assert tokencounts.section_of(starts, ends, bounds, "largest").tolist() == [0, 1, 1]


def edits(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


@pytest.mark.parametrize("most", [1, 2, 3])
def test_line_dedup(spark, most):
    per = 9  # lines of 20 to 35 characters may differ by two or three edits
    rng = random.Random(5)
    lines = ["".join(rng.choice("abcdefgh 日é😀") for _ in range(rng.randint(18, 30))) for _ in range(12)]
    rows = []
    for i in range(40):
        own = []
        for _ in range(rng.randint(0, 6)):
            line = list(rng.choice(lines))
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(line))
                line[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "yy"])
            own.append("".join(line))
        rows.append((i, "\n".join(own)))
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, rows[3][1]), (103, rows[3][1]), (None, "a line that has no id of its own")]
    places = [(i, n, x) for i, t in rows if t is not None for n, x in enumerate(t.split("\n")) if len(x) >= 20]
    key = lambda p: (p[0] is not None, p[0] or 0, p[1])
    first = {}
    for p in sorted(places, key=key):
        first.setdefault(p[2], p[:2])
    order = sorted(first, key=lambda x: key(first[x]))
    rank = {x: n for n, x in enumerate(order)}
    want = groups([(rank[a], rank[b]) for a in order for b in order if a < b and edits(a, b) <= min(most, max(1, min(len(a), len(b)) // per))], range(len(order)))
    gone = {(i, n): first[order[want[rank[x]]]] for i, n, x in places if first[order[want[rank[x]]]] != (i, n)}
    got = {(r.doc_id, r.line_no): (r.kept_doc, r.kept_line) for r in linededup.duplicate_lines(docs(spark, rows).select("doc_id", "text"), most=most, per=per).collect()}
    assert got == gone
    out = linededup.deduplicated(docs(spark, rows), most=most, per=per)
    assert out.columns == [*docs(spark, []).columns, "removed_lines"]
    texts = sorted(((i, None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone)) for i, t in rows), key=str)
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == texts
    assert linededup.without_repeats(docs(spark, [])).count() == 0


def test_line_dedup_edits_grow_with_the_line(spark):
    """Without a bound: edits at the ends, in bursts and everywhere, lines to which 1 to 40 edits are allowed, just enough of them and one too many."""
    rng = random.Random(11)
    per, rows, places = 9, [], []
    for size in [18, 20, 26, 27, 36, 53, 54, 61, 80, 99, 130, 161, 279]:
        base = "".join(rng.choice("abcdefgh 日é😀") for _ in range(size))
        for how in range(8):
            line = list(base)
            for n in range(max(1, size // per) + (how == 7)):
                at = [rng.randrange(len(line)), 0, len(line) - 1, len(line) // 2, (n + 1) * len(line) // (size // per + 2), rng.randrange(len(line)), n * per % len(line), rng.randrange(len(line))][how]
                line[at : at + (how != 1 and rng.randint(0, 1))] = rng.choice(["x", "y"] if how != 5 else ["x", "yx", ""])
            places.append("".join(line))
        places.append(base)
    rng.shuffle(places)
    rows = [(i, x) for i, x in enumerate(places)]
    want = groups([(i, j) for i, a in rows for j, b in rows if i < j and min(len(a), len(b)) >= 18 and abs(len(a) - len(b)) <= 41 and edits(a, b) <= max(1, min(len(a), len(b)) // per)], range(len(rows)))
    got = {r.doc_id: r.kept_doc for r in linededup.duplicate_lines(docs(spark, rows), min_chars=18, most=None, per=per).collect()}
    assert got == {i: n for i, n in want.items() if i != n}


def test_line_dedup_query_removes_lines_of_several_edits(spark):
    """The query's own bound: one edit for 50 characters, whatever the length."""
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefghijklmn") for _ in range(7)) for _ in range(400)]
    long, short = " ".join(words), " ".join(words[:14])
    rows = [(1, long), (2, short), (3, long.replace("a", "z", 63)), (4, long[::-1]), (5, short[:30] + "zz" + short[32:]), (6, short[:60] + "zzz" + short[63:]), (7, long[::-1].replace("a", "z", 64)[::-1])]
    assert (len(long), len(short)) == (3199, 111)
    table = queries.op6_columns(docs(spark, rows).select("doc_id", "text"))
    assert {r.doc_id for r in table.collect() if r.n_removed} == {3, 5}  # 63 of 63 edits and 2 of 2; 6 and 7 differ from all others by more


def test_line_dedup_common_beginnings_make_few_pairs(spark, monkeypatch):
    """Lines that share a long beginning and nothing else leave the joins in no pair; a near copy among them is found."""
    rng = random.Random(13)
    head = "".join(rng.choice("abcdefgh ") for _ in range(60))
    rows = [(i, head + "".join(rng.choice("HLDCUMBG") for _ in range(60))) for i in range(60)]
    rows.append((60, rows[7][1][:80] + "zz" + rows[7][1][82:]))
    made, plain = [], linededup.written

    def counted(df, tag):
        out = plain(df, tag)
        made.extend([out.count()] if tag == "line-pairs" else [])
        return out

    monkeypatch.setattr(linededup, "written", counted)
    got = {r.doc_id: r.kept_doc for r in linededup.duplicate_lines(docs(spark, rows).select("doc_id", "text")).collect()}
    assert got == {60: 7} and 1 <= sum(made) < 20


@pytest.mark.parametrize("per", [1, 9, 50])
def test_line_dedup_classes_of_lengths(spark, per):
    """A line and one that is longer by the edits allowed are of one class or of two that are neighbours."""
    sizes = spark.range(1, 20_000).select(F.col("id").cast("int").alias("n")).select("n", (F.col("n") + linededup.allowed(F.col("n"), None, per)).alias("m"))
    steps = sizes.select((linededup._class(F.col("m"), per) - linededup._class(F.col("n"), per)).alias("step"))
    assert {r.step for r in steps.distinct().collect()} <= {0, 1}


def test_line_dedup_odd_cases(spark):
    """Columns that clash with names used inside, null and empty texts, negative and missing ids, a very long line, and the query's own columns."""
    long = "y" * 20_000
    rows = [(-5, f"first line of all the lines\n{long}"), (None, "first line of all the lines\nanother line of some length"), (7, None), (8, ""), (9, f"{long}z\nshort\nshort"), (10, "another line of some length")]
    df = spark.createDataFrame([(i, t, 1, 2, "a", 3, 9) for i, t in rows], "doc_id long, text string, removed_lines int, removed int, _gone_from string, row int, n_chars int")
    out = {r.doc_id: r for r in linededup.deduplicated(df).collect()}
    assert linededup.deduplicated(df).columns == ["doc_id", "text", "removed", "_gone_from", "row", "n_chars", "removed_lines"]
    assert {i: r.removed_lines for i, r in out.items()} == {-5: [0], None: None, 7: None, 8: None, 9: [0], 10: [0]}
    assert (out[-5].text, out[9].text, out[10].text, out[7].text, out[8].text) == (long, "short\nshort", "", None, "")
    kept = linededup.without_repeats(df)
    assert kept.columns == df.columns
    assert {(r.doc_id, r.n_chars, r.removed_lines, r.row) for r in kept.collect()} == {(-5, 20_000, 1, 3), (None, 9, 1, 3), (7, 9, 1, 3), (8, 9, 1, 3), (9, 11, 1, 3)}
    got = {(r.doc_id, r.line_no): (r.kept_doc, r.kept_line) for r in linededup.duplicate_lines(df).collect()}
    assert got == {(-5, 0): (None, 0), (9, 0): (-5, 1), (10, 0): (None, 1)}
    table = queries.op6_columns(df.select("doc_id", "text"))
    assert {r.doc_id: (r.lines_left, r.n_removed, r.text_sha256) for r in table.collect()} == {
        i: (None if r.text is None else len(r.text.split("\n")), len(r.removed_lines or []), None if r.text is None else hashlib.sha256(r.text.encode()).hexdigest()) for i, r in out.items()
    }


def test_decontamination(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghijklmn") for _ in range(rng.randint(3, 9))) for _ in range(3000)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(15, 50)))) for i in range(40)] + [(90, None), (91, ""), (92, "too short to count"), (93, "unheard")]
    twice = " ".join(rng.choices(words, k=20))  # a second text of item 3
    rows, want = [], set()
    for n in range(120):
        around = rng.choices(words, k=rng.randint(0, 200))
        if n % 2:
            i, t = items[n % 40]
            copy = t.split(" ")
            for _ in range(int(len(copy) * 0.1)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            at = rng.randint(0, len(around))
            around[at:at] = [w.upper() + "," for w in copy]
            want.add((n, i))
        rows.append((n, " ".join(around)))
    rows += [(500 + i, t) for i, t in ODD if i is not None] + [(None, items[0][1])]
    rows += [(700, "so it is Too short, to count at all; too short to count"), (701, "too short"), (702, "to count too short"), (703, "unheard"), (704, twice), (None, "clean and without id")]
    want |= {(700, 92), (703, 93), (704, 3)}
    bench = spark.createDataFrame([(i, t, 1) for i, t in [*items, (3, twice), (3, twice)]], "item_id long, text string, doc_id int")
    got = decontam.leaks(docs(spark, rows), bench).collect()
    found = {(r.doc_id, r.item_id) for r in got}
    assert found <= want and len(found) >= 0.97 * len(want)
    for r in got:
        own = decontam.words_of(twice if r.doc_id == 704 else dict(items)[r.item_id])
        span = decontam.words_of(dict(rows)[r.doc_id])[r.start_word : r.start_word + r.n_words]
        assert edits(own, span) == r.edits <= 0.2 * len(own) and r.item_words == len(own)
    left = decontam.clean(docs(spark, rows), bench)
    assert left.columns == docs(spark, []).columns and left.count() == len(rows) - len({d for d, _ in found}) - 1
    assert [r.text for r in left.where("doc_id is null").collect()] == ["clean and without id"]
    assert decontam.leaks(docs(spark, []), bench).count() == 0
    assert decontam.leaks(docs(spark, rows), bench.limit(0)).count() == 0


def test_decontamination_edits_anywhere(spark):
    """Copies of which the beginning, the end or words all over are replaced or cut, within the 20 %."""
    rng = random.Random(61)
    words = ["".join(rng.choice("abcdefghijklmn") for _ in range(rng.randint(3, 9))) for _ in range(3000)]
    items = [(i, " ".join(rng.choices(words, k=(10, 15, 20, 30, 60, 100)[i % 6]))) for i in range(120)]
    rows, want = [], {}
    for i, t in items:
        for k, where in enumerate(("head", "cut", "middle", "tail", "spread")):
            copy = t.split(" ")
            most = int(len(copy) * 0.2)
            if where == "cut":
                copy = copy[most:]
            else:
                spots = {"head": range(most), "middle": range((len(copy) - most) // 2, (len(copy) + most) // 2), "tail": range(len(copy) - most, len(copy)), "spread": rng.sample(range(len(copy)), most)}[where]
                for s in spots:
                    copy[s] = rng.choice(words)
            n = len(rows)
            rows.append((n, " ".join(rng.choices(words, k=rng.randint(0, 60)) + copy + rng.choices(words, k=rng.randint(0, 60)))))
            want.setdefault((where, len(t.split(" "))), set()).add((n, i))
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontam.leaks(docs(spark, rows), bench).collect()}
    assert found <= set().union(*want.values())
    recall = {k: len(v & found) / len(v) for k, v in want.items()}
    print(recall)
    assert min(recall.values()) >= 0.95, recall


def test_toxicity(spark):
    rng = random.Random(7)
    clean = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    bad = ["grobian", "schuftig", "rascal", "villain"]
    rows, labels = [], []
    for i in range(600):
        text = rng.choices(clean, k=rng.randint(20, 80))
        toxic = int(rng.random() < 0.2)
        if toxic:
            text[rng.randrange(len(text))] = rng.choice(bad) + rng.choice(["", ".", "!"])
        rows.append((i, " ".join(text)))
        labels.append((i, 1, toxic))
    rows += [(1000 + i, t) for i, t in ODD if i is not None] + [(None, "rascal")]
    table = spark.createDataFrame(labels + [(3, 1, None), (None, 1, 1), (5000, 0, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.scored(docs(spark, rows), table).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    known = {i: t for i, _, t in labels}
    held = [r for r in got if r.held_out and r.doc_id in known]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    assert sum(r.predicted == known[r.doc_id] for r in held) >= 0.97 * len(held)
    assert any(r.evidence for r in got if r.predicted) and next(r for r in got if r.doc_id is None).predicted == 1
    assert toxicity.accepted(docs(spark, rows), table).columns == docs(spark, []).columns
    none = toxicity.scored(docs(spark, rows), table.limit(0)).collect()
    assert all(r.score == 0 for r in none)
    assert toxicity.scored(docs(spark, []), table).count() == 0


@pytest.mark.parametrize("terms", [30, 400])
def test_toxicity_is_exact(terms):
    """Nearest examples, votes, calibration and scores against plain Python; with short lists and with rows of the table."""
    rng = random.Random(8)
    pick = lambda: sorted({min(int(rng.paretovariate(0.5)) - 1, terms - 1) for _ in range(rng.randint(1, 8))} | {rng.randrange(terms)})
    examples = [(i, int(rng.random() < 0.3), np.array(own), np.array([rng.randint(1, 3) for _ in own])) for i, own in ((i, pick()) for i in range(500))]
    examples += [(600, 1, np.array([], dtype=int), np.array([], dtype=int))]
    units = (1.0, 2.0)
    weight = np.linspace(1, 3, terms)
    index = toxicity.Index(np.arange(terms), weight, examples, units)
    assert index.table.shape[1] > 0 and (terms == 30 or len(index.who) > 0)

    def vector(ids, n):
        w = {i: (1 + math.log(c)) * weight[i] for i, c in zip(ids.tolist(), n.tolist(), strict=True)}
        norm = math.sqrt(sum(x * x for x in w.values()))
        return {i: x / norm for i, x in w.items()}

    cosine = lambda a, b: sum(x * b.get(i, 0) for i, x in a.items())
    rows = {}
    for doc, toxic, ids, n in examples:
        if len(ids):
            row = rows.setdefault((ids.tobytes(), n.tobytes()), [vector(ids, n), [0.0, 0.0], doc])
            row[1][toxic] += units[toxic]
    place = {d: r for r, d in enumerate(index.docs)}
    rows = sorted(rows.values(), key=lambda r: place[r[2]])
    total = [sum(r[1][y] for r in rows) + (units[1] if y else 0) for y in (0, 1)]
    prior = total[1] / sum(total)

    def near(v):
        every = sorted(((round(cosine(v, r[0]), 5), -i) for i, r in enumerate(rows)), reverse=True)
        return [(c, -i) for c, i in every[: toxicity.NEIGHBOURS] if c > 0]

    def vote(found, without=None):
        x = [0.0, 0.0]
        for c, i in found:
            own = list(rows[i][1])
            if without is not None and without[0] == i:
                own[without[1]] -= units[without[1]]
            x = [x[y] + own[y] * c / (1.1 - c) for y in (0, 1)]
        return (x[1] + 0.5 * prior) / (sum(x) + 0.5)

    votes = []
    for _, toxic, ids, n in examples:
        got = index.left_out(ids, n, toxic)
        if not len(ids):
            assert got is None
            continue
        found = near(vector(ids, n))
        mine = index.nearest(*index.vector(ids, n))
        assert [c for c, _ in mine] == pytest.approx([c for c, _ in found], abs=2e-5)
        if [-i for _, i in mine] == [i for _, i in found]:  # else ties fell otherwise within rounding
            assert got == pytest.approx(vote(found, (found[0][1], toxic)), abs=1e-3)
        votes.append((got, toxic))
    steps = index.calibrated(votes)
    # Isotonic regression by its min-max formula; equal neighbours are one pool.
    xs = sorted(votes)
    w = np.array([units[y] for _, y in xs])
    up, down = np.append(0, np.cumsum(w * [y for _, y in xs])), np.append(0, np.cumsum(w))
    mean = lambda i, j: (up[j + 1] - up[i]) / (down[j + 1] - down[i])
    tails = [np.minimum.accumulate([mean(i, j) for j in range(len(xs) - 1, i - 1, -1)])[::-1] for i in range(len(xs))]
    fit = [max(tails[i][m - i] for i in range(m + 1)) for m in range(len(xs))]
    pools = []
    for (x, _), v, u in zip(xs, fit, w, strict=True):
        if not pools or abs(pools[-1][1] - v) > 1e-9:
            pools.append([0.0, v, 0.0])
        pools[-1][0] += x * u
        pools[-1][2] += u
    assert steps[0] == pytest.approx([x / u for x, _, u in pools])
    assert steps[1] == pytest.approx([(v * u + prior) / (u + 1) for _, v, u in pools])
    score, evidence = index.score(examples[3][2], examples[3][3], steps)
    found = index.nearest(*index.vector(examples[3][2], examples[3][3]))
    assert score == pytest.approx(float(np.interp(index.vote(found), *steps))) and evidence[0][1] == found[0][0] and len(evidence) == min(5, len(found))
    blank = index.score(np.array([], dtype=int), np.array([], dtype=int), steps)
    assert blank == (pytest.approx((2 + prior) / 3), [])


def test_toxicity_label_weights():
    """The likelihood ratio of a two-by-two table, both ways, and near copies counting once."""
    toxic = np.array([1, 1, 1, 1, 0, 0, 0, 0, 0, 0])
    has = {0: [0, 1, 2, 3], 1: [4, 5, 6, 7, 8, 9], 2: [0, 4, 5], 3: list(range(10))}
    term = np.array([t for t, who in has.items() for _ in who])
    row = np.array([r for who in has.values() for r in who])
    got = toxicity.label_weights(term, row, toxic, 4)
    for t, who in has.items():
        ratio = 0.0
        for inside in (True, False):
            for y in (0, 1):
                cell = sum((r in who) == inside and toxic[r] == y for r in range(10))
                expected = sum((r in who) == inside for r in range(10)) * sum(toxic == y) / 10
                ratio += 2 * cell * math.log(cell / expected) if cell else 0
        assert got[t] == pytest.approx(toxicity.LEAST + (1 - toxicity.LEAST) * ratio**2 / (ratio**2 + toxicity.HALF**2), abs=1e-9)
    assert toxicity.originals(np.array([5, 5, 0xFF << 40, 4, (1 << 40) - 1], dtype=np.uint64)).tolist() == [True, False, True, False, True]


def longhand(pieces, text, at_start=True):
    """Sum over all ways to cut text, written out."""
    if not text:
        return 1.0
    total = sum(math.exp(p) * longhand(pieces, text[len(s) :], False) for s, p in pieces.logp.items() if text.startswith(s) and (at_start or s[0] != "▁"))
    return total if text[0] in pieces.logp and (at_start or text[0] != "▁") else total + math.exp(pieces.byte * len(text[0].encode())) * longhand(pieces, text[1:], False)


def test_chances_of_words_and_texts_sum_to_one():
    """All words over three letters, the space mark among them, and all texts of such words: never over 1, and near it where the bytes' share is small."""
    own = lattice.Lattice({"▁": -1.0, "▁a": -1.0, "▁▁": -2.0, "a": -1.0, "b": -1.0, "ab": -1.5, "▁ab": -2.0})
    total, words = 0.0, [""]
    for _ in range(9):
        total += math.fsum(math.exp(own.log_chance(w)) for w in words)
        words = [w + c for w in words for c in "ab▁"]
    print(total)
    assert 0.5 < total <= 1 + 1e-9
    end = 0.3  # texts of words, each followed by no end, and then an end
    assert sum((total * (1 - end)) ** n * end for n in range(200)) <= 1 + 1e-9


def test_lm_scoring(spark):
    """Every column against a model written out in plain Python: all cuts by recursion, texts token by token."""
    rng = random.Random(9)
    words = ["alpha", "beta", "gamma", "delta", "Éta", "日本", "lalala"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(1, 30)) + ([f"new{i}"] if i % 7 == 0 else []))) for i in range(150)]
    rows += [(300 + i, t) for i, t in ODD if i not in (None, 8, 9)] + [(None, "alpha beta"), (8, "word " * 400)]
    scores = {"▁": -3.0, "▁al": -4.0, "al": -4.0, "la": -3.5, "l": -3.0, "a": -2.5, "p": -3.0, "ph": -4.0, "h": -3.2, "▁n": -4.0, "e": -2.0, "w": -4.0, "t": -3.0, "ta": -3.0, "m": -3.0}
    got = lattice.scored(docs(spark, rows), scores).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    split = lambda t: (t or "").encode().lower().split()
    train = [split(t) for i, t in rows if not held(i)]
    counts = Counter(w for t in train for w in [*t, None])
    n, v, ends = sum(counts.values()), len(counts), counts[None]
    seen = {w: c for w, c in counts.items() if w is not None}
    ones, twos = (sum(c == x for c in seen.values()) for x in (1, 2))
    discount = ones / (ones + 2 * twos)
    plain = lattice.Lattice(scores)
    expected = {}
    for w in seen:
        plain.expect(w.decode(), expected)
    fitted = plain.refitted(expected, len(seen))
    spell = lambda own, w: longhand(own, "▁" + w.decode()) * math.exp(own.last)
    by_kind = [Counter() for _ in range(lattice.KINDS)]
    for t in train:
        by_kind[lattice.kind_of(Counter(t))].update([*t, None])
    known = {w: {"plain": spell(plain, w), "p": max(counts[w] - discount, 0) / n + discount * len(seen) / n * spell(fitted, w)} for w in {w for _, t in rows for w in split(t)}}

    def chance(kind, w):
        back = max(1, sum(c == 1 for x, c in by_kind[kind].items() if x is not None))
        return (by_kind[kind][w] + back * (ends / n if w is None else known[w]["p"])) / (sum(by_kind[kind].values()) + back)

    def text_chance(tokens):
        total = []
        for kind in range(lattice.KINDS):
            share = (by_kind[kind][None] + 1) / (ends + lattice.KINDS)
            for strength in (None, *lattice.BURSTS):
                log, before = math.log(share / (1 + len(lattice.BURSTS))), Counter()
                for i, w in enumerate(tokens):
                    log += math.log(chance(kind, w) if strength is None else (strength * chance(kind, w) + before[w]) / (strength + i))
                    before[w] += 1
                total.append(log)
        return (max(total) + math.log(sum(math.exp(x - max(total)) for x in total))) / math.log(10)

    want = []
    for i, t in rows:
        own = [*split(t), None]
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)
        pieces = (sum(math.log(known[w]["plain"] * (1 - ends / n)) for w in own[:-1]) + math.log(ends / n)) / math.log(10)
        want.append((str(i), held(i), len(own), sum(counts[w] > 0 for w in own), n, round(base, 4), round(text_chance(own), 4), round(pieces, 4)))
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4), round(r.score, 4), round(r.lattice_score, 4)) for r in got) == sorted(want)
    assert lattice.scored(docs(spark, []), scores).count() == 0
    blank = lattice.scored(docs(spark, [(2, ""), (3, None), (9, "unseen words"), (1, "held out")]), scores).collect()
    assert all(math.isfinite(r.score) and r.score < 0 and math.isfinite(r.lattice_score) for r in blank) and len(blank) == 4
    only_empty = lattice.scored(docs(spark, [(i, "") for i in range(2, 9)] + [(1, "x y")]), scores).collect()
    assert all(math.isfinite(r.score) and r.score <= 0 for r in only_empty)


def test_embeddings(spark):
    rng = np.random.default_rng(10)
    base = rng.normal(size=(30, 64))
    rows = []
    for i in range(400):
        v = base[i % 30] + rng.normal(size=64) * rng.choice([0.05, 0.3, 0.45])
        rows.append((i, v.astype(np.float32).tolist()))
    rows += [(500, rows[3][1]), (501, rows[3][1]), (501, rows[3][1]), (502, [x * 2 for x in rows[4][1]]), (600, None), (601, [0.0] * 64), (602, [float("nan")] * 64), (603, [None] * 64), (604, []), (605, [float("inf")] + [0.0] * 63), (None, rows[5][1])]
    rows += [(700, [1.0, 0.0]), (701, [1.0, 0.1])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, label int, rep long")
    got = neardup.near_duplicates(df).collect()
    ok = {}
    for i, v in rows:
        if i is not None and v and None not in v and np.isfinite(v).all() and any(v):
            ok[i] = np.array(v, dtype=np.float32).astype(float)
    cos = lambda a, b: a @ b / math.sqrt((a @ a) * (b @ b)) if len(a) == len(b) else 0
    links = [(i, j) for i in ok for j in ok if i < j and cos(ok[i], ok[j]) >= 0.9]
    n = Counter(x for p in links for x in p)
    root = groups(links, ok)
    assert len(got) == len(rows) and len(links) > 300
    missed = sum(abs(r.n_links - n[r.vec_id]) for r in got)
    assert missed <= 0.02 * 2 * len(links) and all(r.n_links <= n[r.vec_id] for r in got)
    if not missed:
        assert all(r.component_id == root.get(r.vec_id, r.vec_id) for r in got)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)
    assert neardup.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("parts", [1, 2, 3, 4])
def test_embeddings_recall_by_rotations(parts):
    """Pairs of cosine 0.90 to 0.92 that share a bucket of which one is a member, for as many rotations as larger inputs bring."""
    rng = np.random.default_rng(parts)
    a, b = rng.normal(size=(2, 1500, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    cosine = rng.uniform(0.9, 0.92, size=(1500, 1))
    lsh = neardup.CrossPolytope(64, parts, neardup.tables_for(parts))
    p, q = lsh.buckets(a), lsh.buckets(cosine * a + np.sqrt(1 - cosine**2) * b)
    met = ((p == q[:, :, :1]).any(axis=2) | (q == p[:, :, :1]).any(axis=2)).any(axis=1)
    print(parts, neardup.tables_for(parts), met.mean())
    assert met.mean() >= 0.96


def test_embeddings_large_group(spark):
    rng = np.random.default_rng(11)
    one = rng.normal(size=32)
    rows = [(i, (one + rng.normal(size=32) * 0.01).tolist()) for i in range(1300)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.n_links for r in got} == {1299} and {r.component_id for r in got} == {0}


def test_warc(spark):
    big = "<p>" + "0123456789é" * 60000
    rows = [(1, "http://a/x y", big), (2, "http://b/\r\nInjected: 1", big), (3, None, None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (7, "u", "s" * 100), (8, "u", "s" * 100), (8, "u", "s" * 100), (None, "u", "s" * 100), (9, "u", "WARC/1.1\r\n\r\n" * 20)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    files = warc.write_archives(df)
    chunks = warc.read_archives(files).collect()
    bodies = {}
    for r in sorted(chunks, key=lambda r: r.chunk_no):
        if r.record_type == "response" and r.page_id != 8:
            bodies[r.page_id] = bodies.get(r.page_id, b"") + bytes(r.data)
    assert bodies[1].decode() == big and max(len(r.data) for r in chunks) <= warc.CHUNK_BYTES and sum(r.page_id == 1 for r in chunks) > 2
    last = sorted(((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in chunks if r.last), key=str)
    first = {}
    for i, _, h in rows:
        if h is not None and len(h.encode()) >= 100 and i is not None:
            first[h] = min(i, first.get(h, i))
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        to = first.get(h) if len(data) >= 100 and first.get(h) != i else None
        want.append((str(i), len(data), hashlib.sha256(data).hexdigest(), "revisit" if to else "response", to))
    assert last == sorted(want, key=str)
    assert bodies[9].decode() == rows[-1][2]
    assert warc.read_archives(warc.write_archives(df.limit(0))).count() == 0


def test_warc_reads_plain_files_and_refuses_bad_ones():
    body = b"hello world"
    head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nWARC-Payload-Digest: sha256:{hashlib.sha256(body).hexdigest()}\r\nContent-Length: {len(body) + 19}\r\n\r\nHTTP/1.1 200 OK\r\n\r\n".encode()
    info = b"WARC/1.1\r\nWARC-Type: warcinfo\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    got = list(warc.records(io.BytesIO(info + head + body + b"\r\n\r\n")))
    assert [(r[0], r[5], r[8]) for r in got] == [(1, body, True)]
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(head + b"HELLO world\r\n\r\n")))
    with pytest.raises(EOFError):
        list(warc.records(io.BytesIO(head + b"hello")))


def test_urls(spark):
    urls = [
        "http://a.com/en/1", "https://WWW.Example.COM/en/x?y=1#z", "http://example.com/en/", "http://sub.example.com/en/9", "http://example.com/english", "http://x.net/es/1", "http://x.net/fr/", "http://x.net/de/1", "http://net/es/", "ftp://spam.org/a/",
        "https://www.spam.org/a.html?q", "http://com", "http://notcom/", "http://a.com?x=/", None, "", "no scheme", "://x.com/", "http://a.b.c.d.e.net/es/q", "http://evil.org/a#://b.net/es/", "http://x.com:80/",
    ]
    df = spark.createDataFrame([(i, u, "h", "p", "k") for i, u in enumerate(urls)] + [(None, urls[0], "h", "p", "k"), (0, urls[0], "h", "p", "k")], "page_id long, url string, host string, path string, keys string")
    rules = spark.createDataFrame(urlfilter.RULES, "host string, path string, verdict string")
    listed = spark.createDataFrame([("spam.org/a",), ("",)], "url_key string")
    got = urlfilter.judge(df, rules, listed).collect()

    def judge(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = "".join(c for c in rest[: min([rest.find(x) for x in "/?#" if x in rest], default=len(rest))])
        path = rest[len(host) :]
        path = path[: min([path.find(x) for x in "?#" if x in path], default=len(path))]
        host = host.lower()
        fit = [(len(h + p), h + p, v) for h, p, v in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return host, path, max(fit)[1:] if fit else None

    assert len(got) == len(urls) + 2
    for r in got:
        host, path, best = judge(urls[r.page_id or 0])
        assert (r.host, r.path) == (host, path)
        assert r.rule == (best[0] if best else None)
        assert r.verdict == (best[1] if best else "block" if host in ("spam.org", "www.spam.org") else "allow")
    many = spark.createDataFrame([(f"h{i}.org", "/" + "p" * i, "block") for i in range(300)], "host string, path string, verdict string")
    one = spark.createDataFrame([(1, "http://a.h7.org/ppppppppp"), (2, "http://h9.org/pp")], "page_id long, url string")
    assert {(r.page_id, r.rule) for r in urlfilter.judge(one, many, listed).collect()} == {(1, "h7.org/ppppppp"), (2, None)}
    assert urlfilter.judge(df.limit(0), rules, listed).count() == 0
    assert urlfilter.judge(df, rules.limit(0), listed.limit(0)).where(F.col("verdict") == "block").count() == 0


def test_bloom_has_no_false_negatives(spark):
    keys = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    check = urlfilter.may_be_listed(urlfilter.bloom(keys), spark)
    probe = spark.range(6000).select("id", F.array(F.xxhash64(F.concat(F.lit("k"), "id"))).alias("h"), F.array(F.xxhash64(F.xxhash64(F.concat(F.lit("k"), "id")))).alias("m"))
    hit = {r.id for r in probe.where(check("h", "m")).collect()}
    assert set(range(3000)) <= hit and len(hit) < 3100


def test_lm_scoring_of_long_tokens(spark):
    """A token of 5,000 characters and one that only bytes spell have their own tiny chances, summed longhand in logs."""
    out = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    ids = [i for i in range(60) if not out(i)][:6]
    train = [(i, "alpha beta gamma " * (i % 3 + 1) + f"only{i}") for i in ids]
    odd = ["q" * 5000, "qz" * 100, "\u65e5\u672c\u8a9e\u306e\u6587" * 12, "alpha " + "7" * 900]
    asked = list(zip([i for i in range(200) if out(i)], odd, strict=False))
    scores = lattice.read_scores(public_tokenizers.path("piece_bpe_32k.model"))
    got = {r.doc_id: r.score for r in lattice.scored(docs(spark, train + asked), scores).collect()}

    counts = Counter(w for _, t in train for w in t.split())
    own, expected = lattice.Lattice(scores), {}
    for w in counts:
        own.expect(w, expected)
    own = own.refitted(expected, len(counts))
    ones, twos, ends = sum(n == 1 for n in counts.values()), sum(n == 2 for n in counts.values()), len(train)
    total, discount = sum(counts.values()) + ends, ones / (ones + 2 * twos)
    kinds = [[t.split() for _, t in train if lattice.kind_of(Counter(t.encode().split())) == k] for k in range(lattice.KINDS)]

    def log_sum(*x):
        return max(x) + math.log(sum(math.exp(v - max(x)) for v in x))

    for i, text in asked:
        chances = []
        for ts in kinds:
            inside = Counter(w for t in ts for w in t)
            back, n_k = max(1, sum(n == 1 for n in inside.values())), inside.total() + len(ts)

            def fallen_back(w, inside=inside, back=back, n_k=n_k):
                spelled = math.log(discount * len(counts) / total) + own.log_chance(w)
                any_kind = log_sum(spelled, math.log((counts[w] - discount) / total)) if counts[w] else spelled
                return (log_sum(any_kind + math.log(back), math.log(inside[w])) if inside[w] else any_kind + math.log(back)) - math.log(n_k + back)

            end = math.log((len(ts) + back * ends / total) / (n_k + back))
            for strength in (None, *lattice.BURSTS):  # no word comes twice
                x = math.log((len(ts) + 1) / (ends + lattice.KINDS) / (1 + len(lattice.BURSTS))) + end + sum(map(fallen_back, text.split()))
                chances.append(x + (sum(math.log(strength / (strength + n)) for n in range(len(text.split()) + 1)) if strength else 0))
        assert got[i] == pytest.approx(log_sum(*chances) / math.log(10), rel=1e-9)
