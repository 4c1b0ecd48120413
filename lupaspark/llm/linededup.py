"""Line deduplication by a segment-partition edit join, in DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lupaspark.llm.common import connected_components, looked_up, quoted, written

#: Shorter lines are never removed: they repeat by chance.
MIN_CHARS = 20
#: Edits allowed between lines: one for each CHARS_AN_EDIT characters of the shorter line, at least one and, where MAX_EDITS is a number, at most so many.
CHARS_AN_EDIT, MAX_EDITS = 50, None
MARK = "\n"
#: Letters whose numbers in a line, a byte each, are compared before texts are: an edit changes their sum of differences by two at most.
LETTERS = "etaonisrhldcumbg"
#: Bounds for which the bit-parallel distance is laid out; the last fills a long. Pairs that may differ by more edits take Spark's banded distance.
BOUNDS = (1, 2, 4, 7, 12, 19, 30)
#: Places are doc_id * LINES + line_no, and rows without an id come before all others.
LINES, NO_ID = 1 << 31, "-9223372036854775809"
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _written(df: DataFrame, tag: str) -> DataFrame:
    """As written; the files of the shuffles behind the table, keys and whole lines, go as soon as it stands."""
    conf = df.sparkSession.conf
    before = conf.get(TIDY)
    conf.set(TIDY, "true")
    try:
        return written(df, tag)
    finally:
        conf.set(TIDY, before)


def edit_distance(a: str, b: str, most: int) -> Column:
    """Edit distance of two columns, arrays of characters whose sizes differ by at most `most`; exact up to `most`, over it beyond.

    Bit-parallel over a band of 2 * most + 1 diagonals: bit k of a column j stands for row j - most + k of the table, VP and VN
    hold where a row is one more or less than that above it, and each column takes a fixed number of operations on longs.
    """
    band, m = 2 * most, F.size(a)
    every = (1 << (band + 1)) - 1
    bits = " | ".join(f"if(get({a}, j - {most + 1 - k}) = c, {1 << k}L, 0L)" for k in range(band + 1))  # beyond the ends get gives null
    marks = F.expr(f"transform(sequence(1, size({b})), j -> named_struct('j', j, 'pm', element_at(transform(array(get({b}, j - 1)), c -> {bits}), 1)))")

    def step(s: Column, x: Column) -> Column:
        vp, vn, pm = s["vp"], s["vn"], x["pm"]
        d0 = ((pm.bitwiseAND(vp) + vp).bitwiseXOR(vp)).bitwiseOR(pm).bitwiseOR(vn).bitwiseAND(F.lit(every))

        def after(d0: Column) -> Column:
            hp = vn.bitwiseOR(F.bitwise_not(d0.bitwiseOR(vp)).bitwiseAND(F.lit(every)))
            hn = d0.bitwiseAND(vp)

            def out(h: Column) -> Column:
                at = m - x["j"] + most  # the bit of the last row
                safe = F.greatest(at, F.lit(0))
                down = F.shiftright(d0, 1)
                dist = F.when(at >= band, s["dist"] + 1 - F.getbit(d0, F.lit(band))).otherwise(s["dist"] + F.getbit(h["hp"], safe) - F.getbit(h["hn"], safe))
                return F.struct(
                    h["hn"].bitwiseOR(F.bitwise_not(down.bitwiseOR(h["hp"])).bitwiseAND(F.lit(every))).alias("vp"),
                    down.bitwiseAND(h["hp"]).alias("vn"),
                    dist.cast("int").alias("dist"),
                )

            return _let(F.struct(hp.alias("hp"), hn.alias("hn")), out)

        return _let(d0, after)

    first = F.struct(F.lit(every ^ ((1 << most) - 1)).cast("long").alias("vp"), F.lit(0).cast("long").alias("vn"), F.least(F.lit(most), m).alias("dist"))
    return F.when(F.size(b) == 0, m).otherwise(F.aggregate(marks, first, step, lambda s: s["dist"]))


def allowed(chars: Column, most: int | None, per: int) -> Column:
    """Edits allowed between two lines, the shorter of which has so many characters."""
    edits = F.greatest(F.lit(1), F.floor(chars / per).cast("int"))
    return edits if most is None else F.least(F.lit(most), edits)


def _let(value: Column, then) -> Column:
    return F.element_at(F.transform(F.array(value), then), 1)


def _lines(docs: DataFrame, mark: str) -> DataFrame:
    return docs.select("doc_id", F.posexplode(F.split("text", f"\\Q{mark}\\E")).alias("line_no", "line")).withColumn("chars", F.char_length("line"))


def _place(doc_id: Column, line_no: Column) -> Column:
    """One number for a line's place, in the order of documents and lines; unlike a struct, its minimum is found by a hash aggregate."""
    return F.coalesce(doc_id.cast("decimal(20,0)"), F.lit(NO_ID).cast("decimal(20,0)")) * F.lit(LINES) + line_no


def _spot(place: Column) -> tuple[Column, Column]:
    """doc_id and line_no of a place."""
    line = F.pmod(place, F.lit(LINES).cast("decimal(20,0)"))
    doc = ((place - line) / F.lit(LINES)).cast("decimal(20,0)")
    return F.when(doc != F.lit(NO_ID).cast("decimal(20,0)"), doc).cast("long"), line.cast("int")


def _part(wide: Column, start: Column, chars: Column) -> Column:
    """Characters of a text in UTF-32, four bytes each: they are found without a walk over those before them."""
    return wide.substr((start * 4 + 1).cast("int"), (chars * 4).cast("int"))


def _letters(line: Column) -> Column:
    """The letters' numbers, eight to a long; capitals count as small letters."""
    low = F.lower(line)

    def counts(letters: str) -> Column:
        out = None
        for k, c in enumerate(letters):
            n = F.shiftleft((F.octet_length(low) - F.octet_length(F.replace(low, F.lit(c), F.lit("")))).bitwiseAND(F.lit(255)).cast("long"), 8 * k)
            out = n if out is None else out.bitwiseOR(n)
        return out

    return F.struct(*[counts(LETTERS[x : x + 8]).alias(f"l{x}") for x in range(0, len(LETTERS), 8)])


def _letters_apart(a: str, b: str) -> Column:
    """Sum of differences of the letters' numbers, of structs by name; as bytes wrap around, it is never too large."""
    out = None
    for x in range(len(LETTERS)):
        n = [F.shiftrightunsigned(F.col(f"{s}.l{x // 8 * 8}"), x % 8 * 8).bitwiseAND(F.lit(255)) for s in (a, b)]
        d = F.abs(n[0] - n[1])
        out = F.least(d, 256 - d) if out is None else out + F.least(d, 256 - d)
    return out


def _levels(min_chars: int, per: int) -> list[int]:
    """Lengths of segments. A line is cut by the largest of which it holds two; those to which two edits and more are allowed all by the last."""
    last = 2 * per // 3  # k edits are allowed from k * per characters on, which hold k + 1 such segments
    out = [min(max(min_chars // 2, 0), last)]
    while out[-1] < last:
        out.append(min(last, max(out[-1] + 1, out[-1] * 6 // 5)))
    return out


def _entries(lines: DataFrame, min_chars: int, most: int | None, per: int) -> DataFrame:
    """(key, v) for lines(name, line, chars), where v is the name, an even number, or one more in entries that are indexed: two lines within the
    allowed edits share a key for which the shorter one is indexed, and either one if they are equally long.

    A line to which k edits are allowed has k + 1 segments of one length, half of them counted from its beginning and half from its end. k edits
    leave fewer than its segments to one of the halves; there, if number i is the first up to whose far side there are no more than i edits, it is
    whole and has i edits before it: in the longer line it stands at most i places off, counted from the same end. For those 2 i + 1 places the shorter
    line is indexed by b neighbouring substrings of the segment, and the longer one probes every b-th place.
    """
    levels = _levels(min_chars, per)
    ends = [2 * x for x in levels[1:]] + [None]
    kinds = F.array(*[
        F.struct(F.lit(s).alias("s"), F.lit(0 if at == 0 else 2 * s).alias("low"), F.lit(end or 2**31 - 1).cast("int").alias("end"))
        for at, (s, end) in enumerate(zip(levels, ends, strict=True))
    ])
    # Rows, not lambdas over arrays: Spark compiles all of this into one loop.
    # Exploded from an array of one, the encoded text is made once a line, and not where it is used, in the innermost loop.
    cut = lines.select("name", "chars", allowed(F.col("chars"), most, per).alias("k"), F.explode(F.array(F.encode("line", "UTF-32"))).alias("wide")).select("*", F.explode(kinds).alias("e"))
    # A shorter partner may be of a lower level: for that one the line only probes.
    cut = cut.where((F.col("e.low") <= F.col("chars")) & (F.col("e.end") > F.col("chars") - F.col("k")))
    cut = cut.select("name", "chars", "wide", F.col("e.s").alias("s"), (F.col("e.end") > F.col("chars")).alias("own"), F.explode(F.sequence(F.lit(0), F.col("k"))).alias("j"))
    cut = cut.select("*", F.col("j").bitwiseAND(F.lit(1)).alias("right"), F.shiftright("j", 1).alias("i"))
    s, i, b = F.col("s"), F.col("i"), F.col("b")
    cut = cut.select("*", F.greatest(F.lit(1), F.least(F.floor((s + 1) / 2).cast("int"), F.round(F.sqrt(2 * i)).cast("int"))).alias("b"))
    cut = cut.select("*", (-F.floor(i / b)).cast("int").alias("low"), F.ceil(i / b).cast("int").alias("high"), F.when(F.col("right") == 1, F.col("chars") - (i + 1) * s).otherwise(i * s).alias("at"))
    # Up to `high` probes, beyond it the index's other places.
    cut = cut.select("*", F.explode(F.sequence(F.col("low"), F.col("high") + F.when(F.col("own"), b - 1).otherwise(0))).alias("x"))
    cut = cut.withColumn("u", F.when(F.col("x") <= F.col("high"), F.col("x") * b).otherwise(F.col("x") - F.col("high")))
    cut = cut.where("at + u >= 0 and at + u + s - b + 1 <= chars")
    indexed = F.col("own") & (F.col("u") >= 0) & (F.col("u") < b)
    return cut.select(F.xxhash64("s", "right", "i", _part(F.col("wide"), F.col("at") + F.col("u"), s - b + 1)).alias("key"), F.col("name").bitwiseOR(indexed.cast("long")).alias("v"))


def _shared(entries: DataFrame) -> DataFrame:
    """(key, name, indexed) of keys that several lines have, one of them indexed."""
    every = Window.partitionBy("key")
    rows = entries.select("key", "v", F.min("v").over(every).alias("low"), F.max("v").over(every).alias("high"), F.max(F.col("v").bitwiseAND(F.lit(1))).over(every).alias("any"))
    rows = rows.where("shiftright(low, 1) <> shiftright(high, 1) and any = 1")
    return rows.select("key", F.col("v").bitwiseAND(F.lit(-2)).alias("name"), (F.col("v").bitwiseAND(F.lit(1)) == 1).alias("indexed"))


def _class(chars: Column, per: int) -> Column:
    """A number for a length; lines within the allowed edits are of one class or of two that are neighbours."""
    return F.when(chars < per, chars).otherwise(per + F.floor(F.log(chars / per) / math.log(1 + 1.01 / per)).cast("int"))


def _may_be_close(a: str, b: str, most: int | None, per: int) -> Column:
    """By lengths and letters, given as structs."""
    edits = allowed(F.least(F.col(f"{a}.chars"), F.col(f"{b}.chars")), most, per)
    return (F.abs(F.col(f"{a}.chars") - F.col(f"{b}.chars")) <= edits) & (_letters_apart(f"{a}.letters", f"{b}.letters") <= 2 * edits)


def _common(most: str, last: bool) -> Column:
    """Characters, `most` at most, that wide_a and wide_b have in common at their beginnings or ends; found by halving."""
    limit = F.expr(most)

    def part(x: str, done: Column, chars: Column) -> Column:
        return _part(F.col(x), F.octet_length(x) / 4 - done - chars if last else done, chars)

    def step(done: Column, chars: Column) -> Column:
        return F.when((done + chars <= limit) & (part("wide_a", done, chars) == part("wide_b", done, chars)), done + chars).otherwise(done)

    return F.aggregate(F.array(*[F.lit(1 << x) for x in range(29, -1, -1)]), F.lit(0), step)


def _close(pairs: DataFrame, lines: DataFrame, near: Column, most: int | None, per: int) -> DataFrame:
    """Those pairs (a, b) of names of lines that are within the allowed edits."""
    wanted = pairs.select(F.col("a").alias("name")).union(pairs.select("b")).distinct()
    ends = _written(lines.join(wanted, "name", "left_semi").select("name", "line", "chars"), "line-ends")
    for x in ("a", "b"):
        pairs = pairs.join(ends.select(F.col("name").alias(x), F.struct("line", "chars").alias(f"end_{x}")), x)
    wide = [F.encode(f"end_{x}.line", "UTF-32").alias(f"wide_{x}") for x in "ab"]
    both = pairs.select("a", "b", F.least("end_a.chars", "end_b.chars").alias("short"), *wide)
    # What the two have in common at their beginnings and ends does not change the distance.
    both = both.select("*", allowed(F.col("short"), most, per).alias("k"), _common("short", False).alias("head"))
    both = both.select("*", _common("short - head", True).alias("tail"))

    def core(x: str) -> Column:
        return _part(F.col(f"wide_{x}"), F.col("head"), F.octet_length(f"wide_{x}") / 4 - F.col("head") - F.col("tail")).alias(f"core_{x}")

    # Written, both times: a lambda that cuts and splits would do it at each of its steps.
    cores = _written(both.select("a", "b", "k", core("a"), core("b")), "line-cores")
    # Spark's own distance refuses most pairs at less cost than a walk in column functions, which follows for the others.
    cores = cores.where("levenshtein(decode(core_a, 'UTF-32'), decode(core_b, 'UTF-32'), k) >= 0")
    cores = _written(cores.select("a", "b", "k", *[F.split(F.decode(f"core_{x}", "UTF-32"), "").alias(f"c_{x}") for x in "ab"]), "line-chars")
    return cores.where(near).select("a", "b")


def _near() -> Column:
    """Whether c_a and c_b, arrays of characters, are within k edits."""
    out = F.when(F.col("k") > BOUNDS[-1], F.lit(True))  # by Spark's distance
    for bound in BOUNDS:
        out = out.when(F.col("k") <= bound, edit_distance("c_a", "c_b", bound) <= F.col("k"))
    return out


def _groups(lines: DataFrame, min_chars: int, most: int | None, per: int) -> DataFrame:
    """(node, component), names, for lines(name, line, chars) that links connect.

    Lines that share a key and are about as long are first compared with one of them. What this connects needs no further look, so that a large group of
    near copies makes few pairs; then all pairs of lines that share a key and are not connected yet are compared. Only pairs whose lengths and letters
    allow it leave the joins.
    """
    near = _near()
    shared = _written(_shared(_entries(lines, min_chars, most, per)), "line-keys")
    # Written, so that letters are counted once a line and not once a key.
    seen = _written(lines.join(shared.select("name").distinct(), "name", "left_semi").select("name", F.struct("chars", _letters(F.col("line")).alias("letters")).alias("seen")), "line-letters")
    rows = _written(shared.join(seen, "name").select("key", "name", "indexed", "seen", _class(F.col("seen.chars"), per).alias("class")), "line-keys")
    centre = F.min(F.when(F.col("indexed"), F.struct("name", "seen"))).over(Window.partitionBy("key", "class")).alias("c")
    star = rows.select("name", "seen", centre).select("name", "seen", F.col("c.name").alias("centre"), F.col("c.seen").alias("mid")).where((F.col("name") != F.col("centre")) & _may_be_close("seen", "mid", most, per))
    star = _written(star.select(F.least("name", "centre").alias("a"), F.greatest("name", "centre").alias("b")).distinct(), "line-pairs")
    first = _written(_close(star, lines, near, most, per), "line-links")
    groups = connected_components(first)
    rows = rows.join(groups.select(F.col("node").alias("name"), F.col("component").alias("part")), "name", "left").withColumn("part", F.coalesce("part", "name"))
    every = Window.partitionBy("key")
    rows = rows.withColumns({"low": F.min("part").over(every), "high": F.max("part").over(every)}).where("low <> high")
    rows = _written(rows.select("key", "name", "indexed", "seen", "class", "part"), "line-keys")
    i, p = rows.where("indexed").alias("i"), rows.withColumn("class", F.explode(F.array(F.col("class"), F.col("class") - 1))).alias("p")
    shorter = (F.col("i.seen.chars") < F.col("p.seen.chars")) | ((F.col("i.seen.chars") == F.col("p.seen.chars")) & (F.col("i.name") < F.col("p.name")))
    match = (F.col("i.key") == F.col("p.key")) & (F.col("i.class") == F.col("p.class")) & shorter & (F.col("i.part") != F.col("p.part")) & _may_be_close("i.seen", "p.seen", most, per)
    rest = i.join(p, match).select(F.least("i.name", "p.name").alias("a"), F.greatest("i.name", "p.name").alias("b")).distinct().join(star, ["a", "b"], "left_anti")
    return connected_components(first.union(_close(_written(rest, "line-pairs"), lines, near, most, per)))


def duplicate_lines(docs: DataFrame, min_chars: int = MIN_CHARS, most: int | None = MAX_EDITS, per: int = CHARS_AN_EDIT, mark: str = MARK) -> DataFrame:
    """(doc_id, line_no, kept_doc, kept_line): the lines to remove and the place of the line that stays instead.

    Lines are linked that are equal or within one edit for each `per` characters of the shorter one, at least one and, unless it is None, at most `most`; of each
    group that links connect the first stays, by doc_id and line number. Lines under min_chars characters take no part. doc_id is an integer; null ids are one
    document before all others. docs(doc_id, text) may repeat a doc_id: equal places are one.
    """
    place = _place(F.col("doc_id"), F.col("line_no"))
    h, g = F.xxhash64("line").alias("h"), F.xxhash64(F.lit(7), "line").alias("g")
    every = _lines(docs, mark).where(F.col("chars") >= min_chars)
    # Names are numbers in the order of the written rows: near each other, they take less room in a shuffle than hashes.
    name = F.shiftleft(F.monotonically_increasing_id(), 1).alias("name")
    distinct = _written(every.groupBy("line").agg(F.min(place).alias("first"), F.count("*").alias("n")).select(name, h, g, "line", F.char_length("line").alias("chars"), "first", "n"), "lines")
    groups = _groups(distinct.select("name", "line", "chars"), min_chars, most, per)

    known = distinct.select("name", "h", "g", "first", "n")
    linked = groups.select("node", "component").union(groups.select("component", "component")).distinct()
    linked = known.join(linked, F.col("name") == F.col("node")).select("name", "h", "g", "component", "first", "n")
    firsts = linked.groupBy("component").agg(F.min("first").alias("keep"))
    near = linked.join(firsts, "component").select("name", "h", "g", "keep", "n")
    same = known.where("n > 1").join(near.select("name"), "name", "left_anti").select("name", "h", "g", F.col("first").alias("keep"), "n")
    kept = _written(near.union(same).select("h", "g", "keep", "n"), "lines-kept")
    kept_doc, kept_line = _spot(F.col("keep"))
    lines = every.select("doc_id", "line_no", h, g)
    return looked_up(lines, kept, ["h", "g"], "struct(doc_id, line_no)").where(place != F.col("keep")).select("doc_id", "line_no", kept_doc.alias("kept_doc"), kept_line.alias("kept_line"))


def _without(docs: DataFrame, min_chars: int, most: int | None, per: int, mark: str, id_col: str, text_col: str) -> DataFrame:
    """(row, text, removed): the rows of docs as they were, their text without the repeated lines, and the numbers of those (null: none)."""
    picked = docs.select(F.col(quoted(id_col)).alias("doc_id"), F.col(quoted(text_col)).alias("text"))
    gone = duplicate_lines(picked, min_chars, most, per, mark).groupBy("doc_id").agg(F.array_sort(F.collect_set("line_no")).alias("removed"))
    rows = docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("row"))

    def rest(lines: Column) -> Column:
        return F.array_join(F.filter(lines, lambda line, i: ~F.array_contains("removed", i)), mark)

    whole = F.col(f"row.{quoted(text_col)}")
    text = F.when(F.col("removed").isNull(), whole).otherwise(_let(F.split(whole, f"\\Q{mark}\\E"), rest))
    # Texts are long and removed lines many: never a broadcast, whatever the size.
    return rows.join(gone.hint("merge"), F.col(f"row.{quoted(id_col)}").eqNullSafe(F.col("doc_id")), "left").select("row", text.alias("text"), "removed")


def deduplicated(docs: DataFrame, min_chars: int = MIN_CHARS, most: int | None = MAX_EDITS, per: int = CHARS_AN_EDIT, mark: str = MARK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs with the repeated lines taken out of their text, and their columns as they were, plus removed_lines array<int>.

    A line goes if an equal or nearly equal line stands earlier (see duplicate_lines). Null texts stay null, texts without
    repeated lines stay as they are, texts of repeated lines alone become empty. A column removed_lines of docs is replaced.
    """
    out = _without(docs, min_chars, most, per, mark, id_col, text_col)
    columns = [c for c in docs.columns if c != "removed_lines"]
    return out.select(*[(F.col("text") if c == text_col else F.col(f"row.{quoted(c)}")).alias(c) for c in columns], F.col("removed").alias("removed_lines"))


def without_repeats(docs: DataFrame, min_chars: int = MIN_CHARS, most: int | None = MAX_EDITS, per: int = CHARS_AN_EDIT, mark: str = MARK) -> DataFrame:
    """docs(doc_id, text, n_chars, ...) without repeated lines, columns as in docs, whatever their names. A text of which nothing but white space is left goes, if
    lines were taken from it. Null and empty texts and rows without an id stay; n_chars, where docs has it, follows the text."""
    out = _without(docs, min_chars, most, per, mark, "doc_id", "text")
    emptied = F.col("removed").isNotNull() & (F.trim(F.translate("text", "\n\r\t", "   ")) == "")
    kind = dict(docs.dtypes)
    counted = F.when(F.col("removed").isNull(), F.col("row.n_chars")).otherwise(F.char_length("text").cast(kind["n_chars"])) if "n_chars" in kind else None
    new = {"text": F.col("text"), "n_chars": counted}
    return out.where(~emptied).select(*[new.get(c, F.col(f"row.{quoted(c)}")).alias(c) for c in docs.columns])
