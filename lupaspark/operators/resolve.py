"""Entity resolution (J1-J22): a wrong link is worse than none, and every match and refusal has its reason."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lupaspark.functions import columns as C
from lupaspark.session import grows


def code_join(facts: DataFrame, dim: DataFrame, on: str) -> DataFrame:
    """Facts with their dimension, kept without it. Spark broadcasts the dimension where its size allows."""
    return facts.join(dim, on, "left")


def key_index(dim: DataFrame, key: str, id_col: str, on_ambiguous: str = "drop", seq: str | None = None) -> DataFrame:
    """(key, id). A key of several ids matches nothing ('drop') or the first by seq ('first')."""
    rows = dim.where(F.col(key).isNotNull() & (F.col(key) != ""))
    if on_ambiguous == "first":
        order = F.struct(*([seq] if seq else []), id_col)
        return rows.groupBy(F.col(key).alias("key")).agg(F.min_by(id_col, order).alias("id"))
    return rows.groupBy(F.col(key).alias("key")).agg(F.min(id_col).alias("id"), F.count_distinct(id_col).alias("n")).where("n = 1").drop("n")


def resolve_names(names: DataFrame, nodes: DataFrame, refused: list[str] = (), alternates: dict[str, str] | None = None, prefixes: list[str] = ("ministerio", "secretaria"), min_len: int = 14) -> DataFrame:
    """(raw, node, how) for each distinct raw name: the first rung of the ladder on which exactly one node answers.

    nodes(id, name, sigla). Rungs: declared refusal, alternate, exact, core name, without legal form, sigla after or before a dash,
    the remainder beside it, sigla alone, without administrative prefix, and the one node name contained in it (J5). Names resolve once, whatever the number of
    their rows; each rung is a key and all rungs meet the index in one join.
    """
    raw = names.select("raw").where("raw is not null").distinct()
    norm, text = C.norm_alnum(F.col("raw")), F.col("raw")
    before, after = F.trim(F.substring_index(text, " - ", 1)), F.trim(F.substring_index(text, " - ", -1))
    dashed = F.contains(text, F.lit(" - "))
    alt = F.element_at(C._map(alternates), norm) if alternates else F.lit(None).cast("string")
    is_sigla = lambda c: F.when(c.rlike(r"^[A-Z]{2,12}$"), F.lower(c))
    rungs = [
        ("alternate", "n", C.norm_alnum(alt)), ("exact", "n", norm), ("core", "c", C.core_name(text)), ("legal form", "n", C.strip_legal_form(text)),
        ("sigla after dash", "s", F.when(dashed, is_sigla(after))), ("sigla before dash", "s", F.when(dashed, is_sigla(before))),
        ("remainder", "c", F.when(dashed & is_sigla(after).isNotNull(), C.core_name(before)).when(dashed & is_sigla(before).isNotNull(), C.core_name(after))),
        ("sigla", "s", is_sigla(F.trim(text))), ("prefix", "c", C.core_name(C.strip_admin_prefix(text, list(prefixes)))),
    ]
    probes = raw.select("raw", F.explode(F.array(*[F.struct(F.lit(i + 1).alias("pass"), F.lit(how).alias("how"), F.concat(F.lit(kind + ":"), key).alias("key")) for i, (how, kind, key) in enumerate(rungs)])).alias("p")).select("raw", "p.*").where("key is not null and length(key) > 2")
    keyed = nodes.select("id", F.explode(F.array(F.concat(F.lit("n:"), C.norm_alnum(F.col("name"))), F.concat(F.lit("c:"), C.core_name(F.col("name"))), F.concat(F.lit("s:"), F.lower("sigla")))).alias("key"))
    hits = probes.join(key_index(keyed, "key", "id"), "key").select("raw", "pass", "how", F.col("id").alias("node"))
    inside = containment(raw, nodes, min_len).select("raw", F.lit(len(rungs) + 1).alias("pass"), F.lit("contained").alias("how"), "node")
    best = hits.unionByName(inside).groupBy("raw").agg(F.min_by(F.struct("node", "how"), "pass").alias("m"))
    out = raw.join(best, "raw", "left")
    no = norm.isin([*refused]) if refused else F.lit(False)
    return out.select("raw", F.when(~no, F.col("m.node")).alias("node"), F.when(no, "refused").otherwise(F.coalesce("m.how", F.lit("no match"))).alias("how"))


def containment(names: DataFrame, nodes: DataFrame, min_len: int = 14) -> DataFrame:
    """(raw, node) where exactly one node's core name of at least min_len characters is a run of the raw name's words.

    Runs of words are exploded and met by equality, so that no pair of names is compared.
    """
    runs = lambda w: F.flatten(F.transform(F.sequence(F.lit(1), F.size(w)), lambda i: F.transform(F.sequence(i, F.size(w)), lambda j: F.array_join(F.slice(w, i, j - i + 1), " "))))
    every = F.element_at(F.transform(F.array(F.split(C.core_name(F.col("raw")), " ")), runs), 1)
    probes = names.select("raw", F.explode(F.array_distinct(every)).alias("key")).where(F.length("key") >= min_len)
    keyed = nodes.select(F.col("id"), C.core_name(F.col("name")).alias("key"))
    return probes.join(keyed, "key").groupBy("raw").agg(F.min("id").alias("node"), F.count_distinct("id").alias("n")).where("n = 1").drop("n")


def code_fallback(df: DataFrame, code: str, name: str, by_code: DataFrame, by_name: DataFrame) -> DataFrame:
    """Node by code, else by name, else by the superior code XX000; via tells which. by_code(code, id), by_name(key, id)."""
    codes = by_code.select(F.col("code").alias("_c"), F.col("id").alias("_by_code"))
    names = by_name.select(F.col("key").alias("_k"), F.col("id").alias("_by_name"))
    up = by_code.select(F.col("code").alias("_u"), F.col("id").alias("_by_up"))
    out = df.join(codes, F.col(code) == F.col("_c"), "left").join(names, C.norm_alnum(F.col(name)) == F.col("_k"), "left").join(up, F.concat(F.col(code).substr(1, 2), F.lit("000")) == F.col("_u"), "left")
    via = F.when(F.col("_by_code").isNotNull(), "code").when(F.col("_by_name").isNotNull(), "name").when(F.col("_by_up").isNotNull(), "superior").otherwise("none")
    return out.withColumns({"node": F.coalesce("_by_code", "_by_name", "_by_up"), "via": via}).drop("_c", "_k", "_u", "_by_code", "_by_name", "_by_up")


def scope_bridge(nodes: DataFrame, org_tree: DataFrame) -> DataFrame:
    """(node, code): a node covers its own code and those of the organs below. nodes(id, code), org_tree(code, superior)."""
    own = nodes.select(F.col("id").alias("node"), "code")
    below = nodes.join(org_tree.select(F.col("code").alias("sub"), "superior"), F.col("code") == F.col("superior")).select(F.col("id").alias("node"), F.col("sub").alias("code"))
    return own.unionByName(below).distinct()


def resolve_with_cache(df: DataFrame, key: str, name_cols: list[str], cache: DataFrame, resolved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Node by a cache of keys, else by the first name that resolves; and the key's pairs that are new. cache(key, node), resolved(raw, node)."""
    out = df.join(cache.select(F.col("key").alias("_ck"), F.col("node").alias("_cached")), F.col(key) == F.col("_ck"), "left")
    for i, c in enumerate(name_cols):
        out = out.join(resolved.select(F.col("raw").alias(f"_r{i}"), F.col("node").alias(f"_n{i}")), F.col(c) == F.col(f"_r{i}"), "left")
    node = F.coalesce("_cached", *[f"_n{i}" for i in range(len(name_cols))])
    out = out.withColumn("node", node)
    fresh = out.where(F.col("_cached").isNull() & F.col("node").isNotNull()).groupBy(F.col(key).alias("key")).agg(F.min("node").alias("node"), F.count_distinct("node").alias("n")).where("n = 1").drop("n")
    return out.drop("_ck", "_cached", *[f"_{x}{i}" for i in range(len(name_cols)) for x in "rn"]), fresh


def person_join(cands: DataFrame, people: DataFrame, name: str = "name", short: str = "short", uf: str = "uf") -> DataFrame:
    """Candidacies with the person of the same full name, else of the same short name and state where both are unique; how tells which."""
    full = key_index(people.select("person_id", C.name_key_full(F.col(name)).alias("k")), "k", "person_id")
    shorts = key_index(people.select("person_id", F.concat_ws("|", C.norm_alpha(F.col(short)), uf).alias("k")), "k", "person_id")
    c = cands.withColumns({"_f": C.name_key_full(F.col(name)), "_s": F.concat_ws("|", C.norm_alpha(F.col(short)), uf)})
    once = c.groupBy("_s").agg(F.count_distinct("_f").alias("_n"))
    out = c.join(full.select(F.col("key").alias("_f"), F.col("id").alias("_a")), "_f", "left").join(shorts.select(F.col("key").alias("_s"), F.col("id").alias("_b")), "_s", "left").join(once, "_s", "left")
    by_short = F.when(F.col("_n") == 1, F.col("_b"))
    how = F.when(F.col("_a").isNotNull(), "full name").when(by_short.isNotNull(), "short name and state")
    return out.withColumns({"person_id": F.coalesce("_a", by_short), "how": how}).drop("_f", "_s", "_a", "_b", "_n")


def person_join_birth(cands: DataFrame, people: DataFrame) -> DataFrame:
    """By full name unless both births are known and differ; homonym marks names of three words or fewer. cands(cand_id, name, birth), people(person_id, name, birth)."""
    p = people.select("person_id", C.name_key_full(F.col("name")).alias("k"), F.col("birth").alias("own_birth"))
    c = cands.withColumn("k", C.name_key_full(F.col("name")))
    ok = F.coalesce(F.col("birth") == F.col("own_birth"), F.lit(True))
    return c.join(p, "k").where(ok).withColumn("homonym", F.size(F.split("k", " ")) <= 3).drop("k", "own_birth")


def second_pass(cands: DataFrame, matched: DataFrame, people: DataFrame, key: str, within: str) -> DataFrame:
    """Candidacies that the first pass left, by a key that is unique within (year) on their side and unique among people."""
    left = cands.join(matched.select("cand_id").distinct(), "cand_id", "left_anti")
    once = left.withColumn("_n", F.count("*").over(Window.partitionBy(within, key))).where("_n = 1").drop("_n")
    return once.join(key_index(people, key, "person_id").select(F.col("key").alias(key), F.col("id").alias("person_id")), key)


def is_subsequence(small: Column, big: Column) -> Column:
    """The small array's words occur in the big one in order, in full, as a beginning of four letters or more, or as an initial; the first words agree."""
    hit = lambda s, t: (s == t) | ((F.length(s) >= 4) & F.startswith(t, s)) | ((F.length(s) == 1) & (t.substr(1, 1) == s))
    found = F.aggregate(big, F.lit(0), lambda i, t: F.when((i < F.size(small)) & hit(F.get(small, i), t), i + 1).otherwise(i))
    return (F.size(small) > 0) & (found == F.size(small)) & (F.get(small, F.lit(0)) == F.get(big, F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    """Of token sets; null where both are empty."""
    return F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double"))


def _compatible_organs(holders: DataFrame, closure: DataFrame, payroll: DataFrame) -> DataFrame:
    """(person, pay_organ, rank): organs, not rows, where a holder's pay may stand."""
    present = payroll.select(F.col("organ").alias("pay_organ")).distinct()
    own = holders.select("person", F.col("organ").alias("pay_organ"), F.lit(0).alias("rank"))
    below = holders.join(closure.select(F.col("ancestor").alias("organ"), F.col("node").alias("pay_organ")), "organ").select("person", "pay_organ", F.lit(1).alias("rank"))
    above = holders.join(closure.select(F.col("node").alias("organ"), F.col("ancestor").alias("pay_organ"), "depth"), "organ").join(present, "pay_organ")
    near = above.withColumn("_n", F.row_number().over(Window.partitionBy("person", "organ").orderBy("depth", "pay_organ"))).where("_n = 1").select("person", "pay_organ", F.lit(2).alias("rank"))
    return own.union(below).union(near).groupBy("person", "pay_organ").agg(F.min("rank").alias("rank"))


def org_compatible(holders: DataFrame, closure: DataFrame, payroll: DataFrame) -> DataFrame:
    """(person, row_id, rank) where the payroll row's organ is the holder's own (0), one below it (1), or the nearest above it that has payroll (2)."""
    rows = payroll.select("row_id", F.col("organ").alias("pay_organ"))
    return _compatible_organs(holders, closure, payroll).join(rows, "pay_organ").groupBy("person", "row_id").agg(F.min("rank").alias("rank"))


def payroll_match(holders: DataFrame, payroll: DataFrame, closure: DataFrame) -> DataFrame:
    """(person, row_id, criterion, confidence, reason) for every holder(person, name, organ) against payroll(row_id, name, organ).

    Rungs among compatible organs: full name, base name, first and last name, ordered subsequence. The first rung with one row wins; several make the
    holder ambiguous. Holders meet rows by organ and first word of the name together, which every rung needs: never all rows of an organ.
    """
    h = holders.select("person", F.col("name").alias("h_name"), F.split(C.name_key_full(F.col("name")), " ").alias("hw"))
    p = payroll.select("row_id", F.col("organ").alias("pay_organ"), F.col("name").alias("p_name"), F.split(C.name_key_full(F.col("name")), " ").alias("pw")).withColumn("first", F.get("pw", F.lit(0)))
    near = _compatible_organs(holders, closure, payroll).join(h.withColumn("first", F.get("hw", F.lit(0))), "person")
    pairs = near.join(p, ["pay_organ", "first"]).dropDuplicates(["person", "row_id", "h_name"])
    hn, pn = F.col("h_name"), F.col("p_name")
    rung = F.when(C.name_key_full(hn) == C.name_key_full(pn), 1).when(C.name_key_base(hn) == C.name_key_base(pn), 2).when(C.name_key_first_last(hn) == C.name_key_first_last(pn), 3).when(is_subsequence(F.col("hw"), F.col("pw")), 4)
    found = pairs.withColumn("rung", rung).where("rung is not null")
    best = found.withColumn("_m", F.min("rung").over(Window.partitionBy("person"))).where("rung = _m").groupBy("person", "rung").agg(F.count("*").alias("n"), F.min("row_id").alias("row_id"))
    names = F.element_at(F.array(F.lit("full name"), F.lit("base name"), F.lit("first and last name"), F.lit("subsequence")), F.col("rung"))
    out = holders.select("person").distinct().join(best, "person", "left")
    one = F.col("n") == 1
    return out.select("person", F.when(one, F.col("row_id")).alias("row_id"), F.when(one, names).alias("criterion"), F.when(one, F.when(F.col("rung") <= 2, "high").otherwise("medium")).alias("confidence"), F.when(F.col("n").isNull(), "no match").when(~one, "ambiguous").alias("reason"))


def fuzzy_person(left: DataFrame, right: DataFrame, max_edit: int = 1, min_jaccard: float = 0.3) -> DataFrame:
    """(left_id, right_id, score): names that share a word and the first word up to one edit, best by token Jaccard, then smallest right_id. left(left_id, name), right(right_id, name)."""
    a = left.select("left_id", C.tokens(F.col("name")).alias("a")).withColumn("t", F.explode(F.array_distinct("a")))
    b = right.select("right_id", C.tokens(F.col("name")).alias("b")).withColumn("t", F.explode(F.array_distinct("b")))
    pairs = a.where(F.length("t") > 2).join(b.where(F.length("t") > 2), "t").select("left_id", "right_id", "a", "b").distinct()
    near = F.levenshtein(F.get("a", F.lit(0)), F.get("b", F.lit(0)), max_edit).between(0, max_edit)
    scored = pairs.withColumn("score", F.round(jaccard(F.col("a"), F.col("b")), 4)).where(near & (F.col("score") >= min_jaccard))
    return scored.withColumn("_n", F.row_number().over(Window.partitionBy("left_id").orderBy(F.desc("score"), "right_id"))).where("_n = 1").select("left_id", "right_id", "score")


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio."""
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


def best_similar(df: DataFrame, targets: DataFrame, block: str, cut: float = 0.62) -> DataFrame:
    """(id, target, ratio): the most similar target of the same block, from `cut` on; targets(target, text, block), df(id, text, block)."""
    # Equal texts of a block are compared once.
    theirs = targets.groupBy(block, F.col("text").alias("_t")).agg(F.min("target").alias("target"))
    pairs = df.select("text", block).distinct().join(theirs, block).withColumn("ratio", F.round(similarity(C.norm_alnum(F.col("text")), C.norm_alnum(F.col("_t"))), 4))
    best = pairs.where(F.col("ratio") >= cut).withColumn("_n", F.row_number().over(Window.partitionBy("text", block).orderBy(F.desc("ratio"), "target"))).where("_n = 1")
    return df.join(best.select("text", block, "target", "ratio"), ["text", block]).select("id", "target", "ratio")


def two_sided(df: DataFrame, targets: DataFrame, cut: float = 0.75, margin: float = 0.2) -> DataFrame:
    """(id, target, score): shared words as a share of either side's, the lower of the two; from `cut`, and `margin` ahead of the next target."""
    a = df.select("id", F.array_distinct(C.stem_tokens(F.col("text"))).alias("a")).distinct()
    b = targets.select("target", F.array_distinct(C.stem_tokens(F.col("text"))).alias("b")).distinct()
    known = b.select(F.explode("b").alias("t")).groupBy("t").agg(F.count("*").alias("known"))

    def rarest(side: DataFrame, key: str, words: str) -> DataFrame:
        """The rarest words of each side, one more than may be missing from a pair that counts: such pairs share one of them."""
        w = Window.partitionBy(key, words).orderBy("known", "t")
        n = F.size(words) - F.ceil(F.size(words) * (cut - margin) - 1e-9) + 1
        told = side.withColumn("t", F.explode(words)).join(known, "t", "left").withColumn("known", F.coalesce("known", F.lit(0)))
        return told.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).select(key, words, "t")

    pairs = rarest(a, "id", "a").join(rarest(b, "target", "b"), "t").select("id", "target", "a", "b").distinct()
    shared = pairs.select("id", "target", F.size("a").alias("na"), F.size("b").alias("nb"), F.size(F.array_intersect("a", "b")).alias("n"))
    scored = shared.withColumn("score", F.round(F.least(F.col("n") / F.col("na"), F.col("n") / F.col("nb")), 4))
    w = Window.partitionBy("id").orderBy(F.desc("score"), "target")
    ranked = scored.withColumns({"_n": F.row_number().over(w), "_next": F.coalesce(F.lead("score").over(w), F.lit(0.0))})
    return ranked.where((F.col("_n") == 1) & (F.col("score") >= cut) & (F.round(F.col("score") - F.col("_next"), 4) >= margin)).select("id", "target", "score")


def coverage_match(acts: DataFrame, targets: DataFrame) -> DataFrame:
    """(act, target, confidence, reason): high if role and all of the target's words are there, medium from 0.75, else why not. acts(act, role, text), targets(target, role, text)."""
    a = acts.select("act", F.col("role").alias("a_role"), C.stem_tokens(F.col("text")).alias("a"))
    b = targets.select("target", F.col("role").alias("b_role"), C.stem_tokens(F.col("text")).alias("b"))
    near = a.withColumn("t", F.explode(F.array_distinct("a"))).join(b.withColumn("t", F.explode(F.array_distinct("b"))), "t").select("act", "target", "a_role", "b_role", "a", "b").distinct()
    cover = F.round(F.size(F.array_intersect("a", "b")) / F.size(F.array_distinct("b")), 4)
    found = near.withColumn("cover", cover)
    best = found.withColumn("_n", F.row_number().over(Window.partitionBy("act").orderBy(F.desc("cover"), "target"))).where("_n = 1")
    role = F.col("a_role") == F.col("b_role")
    confidence = F.when(role & (F.col("cover") == 1), "high").when(role & (F.col("cover") >= 0.75), "medium")
    return best.select("act", "target", "cover", confidence.alias("confidence"), F.when(~role, "other role").when(F.col("cover") < 0.75, "few words").alias("reason"))


def symmetric_terms(acts: DataFrame, targets: DataFrame, optional: list[str]) -> DataFrame:
    """(act, target) where the words that only one side has are optional ones, on both sides."""
    a = acts.select("act", F.array_distinct(C.stem_tokens(F.col("text"))).alias("a"))
    b = targets.select("target", F.array_distinct(C.stem_tokens(F.col("text"))).alias("b"))
    free = F.array(*[F.lit(x) for x in optional]).cast("array<string>")
    # Equal after the optional words are gone: an equality, so no pair is tried in vain.
    key = lambda c: F.array_join(F.array_sort(F.array_except(c, free)), " ")
    return a.withColumn("k", key("a")).where("k <> ''").join(b.withColumn("k", key("b")), "k").select("act", "target")


def abbrev_match(names: DataFrame, orgs: DataFrame) -> DataFrame:
    """(raw, org): the organ whose words the raw name's words begin, in order; the shortest such name, none on a tie.

    Each word of the raw name begins one of the organ's, so that they meet by the raw name's rarest word among the beginnings of the organs' words (and the first letters of both names), not
    by what all names have in common.
    """
    a = names.select("raw").distinct().select("raw", F.filter(C.tokens(F.col("raw")), lambda t: ~t.isin(C.CONNECTIVES)).alias("a")).where(F.size("a") > 0)
    b = orgs.select("org", F.filter(C.tokens(F.col("name")), lambda t: ~t.isin(C.CONNECTIVES)).alias("b"), F.length("name").alias("chars"))
    block = lambda c: F.get(c, F.lit(0)).substr(1, 3)
    walk = F.aggregate("b", F.lit(0), lambda i, t: F.when((i < F.size("a")) & F.startswith(t, F.get("a", i)), i + 1).otherwise(i))
    begins = F.array_distinct(F.flatten(F.transform("b", lambda t: F.transform(F.sequence(F.lit(1), F.length(t)), lambda n: F.substring(t, F.lit(1), n)))))
    known = b.select("org", "b", "chars", block("b").alias("k"), F.explode(begins).alias("w"))
    often = known.groupBy("k", "w").agg(F.count("*").alias("often"))
    asked = a.select("raw", "a", block("a").alias("k"), F.explode(F.array_distinct("a")).alias("w")).join(grows(often), ["k", "w"], "left")
    rarest = asked.groupBy("raw", "a", "k").agg(F.min_by("w", F.struct(F.coalesce("often", F.lit(0)), "w")).alias("w"))
    hits = rarest.join(grows(known), ["k", "w"]).where(walk == F.size("a"))
    ranked = hits.withColumn("_r", F.rank().over(Window.partitionBy("raw").orderBy("chars"))).where("_r = 1")
    return ranked.groupBy("raw").agg(F.min("org").alias("org"), F.count("*").alias("n")).where("n = 1").drop("n")


def canonical_ids(df: DataFrame, registries: DataFrame, keys: list[str]) -> DataFrame:
    """The id that an earlier registry has for the same keys, if the registry knows one alone; registries(layer, id, keys...), the lowest layer first."""
    known = registries.groupBy(*keys, "layer").agg(F.min("id").alias("id"), F.count_distinct("id").alias("n")).where("n = 1").groupBy(*keys).agg(F.min_by("id", "layer").alias("canonical_id"))
    return df.join(known, keys, "left")
