"""People matched in spite of spelling errors and left-out names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lupaspark.functions import columns as C
from lupaspark.operators.resolve import jaccard
from lupaspark.session import checkpointed, grows

#: Letters from which on a word may have one error.
LEAST = 5


def deletions(word: Column) -> Column:
    """The word, and if it is long enough the word less each of its letters: two words within one edit have one of these in common."""
    less = F.transform(F.sequence(F.lit(1), F.length(word)), lambda k: F.concat(F.substring(word, F.lit(1), k - 1), F.substring(word, k + 1, F.length(word))))
    return F.array_distinct(F.when(F.length(word) >= LEAST, F.concat(F.array(word), less)).otherwise(F.array(word)))


def same_word(a: Column, b: Column) -> Column:
    """Equal, or within one edit where a has LEAST letters or more."""
    return (a == b) | ((F.length(a) >= LEAST) & F.levenshtein(a, b, 1).between(0, 1))


def aligned(a: Column, b: Column) -> Column:
    """How many words of a, from the first on, stand in b in this order."""
    return F.aggregate(b, F.lit(0), lambda i, w: F.when((i < F.size(a)) & F.coalesce(same_word(F.get(a, i), w), F.lit(False)), i + 1).otherwise(i))


def aligned_person(left: DataFrame, right: DataFrame, least_organ: float = 0.3) -> DataFrame:
    """(left_id, right_id, mode, organ, reason) for each left row: its person in the other list, or why there is none.

    left(left_id, name, organ, is_head), right(right_id, name, organ, ended, is_top, titular, start). Modes: 'exact' (the same words), else 'subsequence' (all words
    of one name stand in the other in order, each with at most one error) or 'fuzzy' (three words or more in order, one missing at most, organs alike from least_organ on). The left name's first word must stand in the
    other. Of several the most alike organ wins, then who is in office, the top authority for heads, titulars, the later start, the smaller id. Candidates of different names
    without a shared organ word are 'homonyms' and refused. Rows with null names match nothing.

    Names meet by their first word and, for either side, the rarest of its other words (of three and more the two rarest) or such a word less a letter: a pair that
    counts has one word missing at most, and none if there are but three, so that common names are no key.
    """
    words = lambda c: F.filter(C.tokens(F.col(c)), lambda t: ~t.isin(C.CONNECTIVES))
    # Names are split once and written, in parts however few the files are: each stands in many joins and becomes many keys.
    asked = checkpointed(left.repartition("left_id").select("left_id", words("name").alias("a"), words("organ").alias("ao"), F.coalesce("is_head", F.lit(False)).alias("is_head")))
    a = asked.where(F.size("a") > 0)
    b = checkpointed(right.repartition("right_id").select("right_id", words("name").alias("b"), words("organ").alias("bo"), F.col("ended").isNull().alias("open"), F.coalesce("is_top", F.lit(False)).alias("is_top"), F.coalesce("titular", F.lit(False)).alias("titular"), "start")).where(F.size("b") > 0)
    every = a.select(F.explode(F.array_distinct("a")).alias("w")).unionByName(b.select(F.explode(F.array_distinct("b")).alias("w"))).groupBy("w").agg(F.count("*").alias("n"))

    def firsts(side: DataFrame, key: str, w: str) -> DataFrame:
        """(key, first, other): the left name's first word beside each other word; on the right any word may be the first."""
        beside = F.array_distinct(F.filter(w, lambda _, j: j != F.col("i")))
        first = [F.lit(0).alias("i"), F.get(w, F.lit(0)).alias("first")] if w == "a" else [F.posexplode(w).alias("i", "first")]
        return side.select(key, w, *first).select(key, "i", "first", (F.size(w) - 1).alias("others"), F.explode(beside).alias("w"))

    met = None
    la, rb = firsts(a, "left_id", "a"), firsts(b, "right_id", "b")
    for mine, key, other in ((la, "left_id", rb), (rb, "right_id", la)):
        rank = F.row_number().over(Window.partitionBy(key, "i").orderBy("n", "w"))
        rare = mine.join(grows(every), "w").withColumn("_r", rank).where("_r <= if(others > 2, 2, 1)").select(key, "first", F.explode(deletions(F.col("w"))).alias("k"))
        pairs = rare.join(grows(other.select([c for c in other.columns if c.endswith("_id")][0], "first", F.explode(deletions(F.col("w"))).alias("k"))), ["first", "k"]).select("left_id", "right_id")
        met = pairs if met is None else met.unionByName(pairs)
    alone = a.where(F.size("a") == 1).join(grows(b.where(F.size("b") == 1)), F.col("a") == F.col("b")).select("left_id", "right_id")
    pairs = met.unionByName(alone).distinct().join(grows(a), "left_id").join(grows(b), "right_id")
    na, nb, m, back = F.size("a"), F.size("b"), aligned(F.col("a"), F.col("b")), aligned(F.col("b"), F.col("a"))
    pairs = pairs.withColumns({"m": m, "back": back, "organ": F.coalesce(jaccard(F.array_distinct("ao"), F.array_distinct("bo")), F.lit(0.0))})
    near = (na >= 2) & ((F.col("m") == na) | ((F.col("m") >= 3) & (F.col("back") == nb)))
    loose = (F.col("m") >= 3) & (F.col("m") >= F.least(na, nb) - 1) & (F.col("organ") >= least_organ)
    mode = F.when(F.col("a") == F.col("b"), "exact").when(near, "subsequence").when(loose, "fuzzy")
    found = pairs.withColumn("mode", mode).where("mode is not null").withColumn("exact", F.max(F.col("mode") == "exact").over(Window.partitionBy("left_id"))).where("not exact or mode = 'exact'")
    score = [F.desc("organ"), F.desc("open"), F.desc(F.col("is_head") & F.col("is_top")), F.desc("titular"), F.desc_nulls_last("start"), F.asc("right_id")]
    per = Window.partitionBy("left_id")
    best = found.withColumns({"_n": F.row_number().over(per.orderBy(*score)), "names": F.size(F.collect_set(F.array_join("b", " ")).over(per))}).where("_n = 1")
    refused = (F.col("names") > 1) & (F.col("organ") == 0)
    out = asked.select("left_id").distinct().join(grows(best.select("left_id", "right_id", "mode", "organ", refused.alias("refused"))), "left_id", "left")
    kept = lambda c: F.when(~F.col("refused"), F.col(c)).alias(c)
    return out.select("left_id", kept("right_id"), kept("mode"), F.when(~F.col("refused"), F.round("organ", 4)).alias("organ"), F.when(F.col("refused"), "homonyms").when(F.col("mode").isNull(), "no match").alias("reason"))
