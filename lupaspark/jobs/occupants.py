"""Who holds which post, from the gazette and from organs' pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lupaspark.functions import columns as C
from lupaspark.operators import gazette as Z
from lupaspark.operators import resolve as R
from lupaspark.operators import temporal as T

ENTRIES, EXITS = ["nomear", "designar"], ["exonerar", "dispensar"]
#: Words that a post's title may have or lack.
OPTIONAL = ["substituto", "adjunto", "nacional", "federal"]


def match_posts(titles: DataFrame, posts: DataFrame) -> DataFrame:
    """(title, post_id, how) of each distinct title that a post answers: the same core words, else two-sided coverage (J18), else the same but for optional words (J20); several posts at a rung answer nothing. titles(title), posts(post_id, title)."""
    asked = titles.select("title").where("title is not null").distinct()
    keys = R.key_index(posts.select("post_id", C.core_name(F.col("title")).alias("k")), "k", "post_id")
    exact = asked.withColumn("key", C.core_name(F.col("title"))).join(keys, "key").select("title", F.col("id").alias("post_id"), F.lit(1).alias("rung"))
    left = asked.join(exact.select("title"), "title", "left_anti")
    near = R.two_sided(left.select(F.col("title").alias("id"), F.col("title").alias("text")), posts.select(F.col("post_id").alias("target"), F.col("title").alias("text"))).select(F.col("id").alias("title"), F.col("target").alias("post_id"), F.lit(2).alias("rung"))
    loose = R.symmetric_terms(left.select(F.col("title").alias("act"), F.col("title").alias("text")), posts.select(F.col("post_id").alias("target"), F.col("title").alias("text")), OPTIONAL)
    loose = loose.groupBy("act").agg(F.min("target").alias("post_id"), F.count_distinct("target").alias("n")).where("n = 1").select(F.col("act").alias("title"), "post_id", F.lit(3).alias("rung"))
    best = exact.unionByName(near).unionByName(loose).groupBy("title").agg(F.min_by(F.struct("post_id", "rung"), "rung").alias("m"))
    how = F.element_at(F.array(F.lit("same words"), F.lit("coverage"), F.lit("optional words")), F.col("m.rung"))
    return best.select("title", "m.post_id", how.alias("how"))


def gazette_events(texts: DataFrame, posts: DataFrame) -> DataFrame:
    """(doc_id, act_no, post_id, person, name, verb, day, reason): each person whom an act names, with the post that its title means, or why not. texts(doc_id, day, text).

    `day` is the date from which the act counts, else that of the text; `person` is the name's key. Titles are matched once each, however many acts have them.
    """
    title = F.concat_ws(" ", "post", "organ")
    told = Z.walk_acts(texts.select("doc_id", "text")).join(texts.select("doc_id", F.col("day").cast("date").alias("_day")), "doc_id")
    told = told.withColumn("title", F.when(F.col("post").isNotNull(), title))
    met = match_posts(told.select("title"), posts).drop("how")
    out = told.join(met, "title", "left")
    reason = F.coalesce("reason", F.when(F.col("post_id").isNull(), F.lit("no such post")))
    return out.select("doc_id", "act_no", F.when(reason.isNull(), F.col("post_id")).alias("post_id"), C.name_key_full(F.col("name")).alias("person"), "name", "verb", F.coalesce("since", "_day").alias("day"), reason.alias("reason"))


def tenures(events: DataFrame, gap: int = 31) -> DataFrame:
    """(post_id, person, start, end, spans): an entry holds until the person's next exit from the post or the post's next entry; spans of one person within `gap` days are one tenure (W9). Open tenures have no end."""
    real = events.where("reason is null")
    entries = real.where(F.col("verb").isin(ENTRIES)).select("post_id", "person", F.col("day").alias("start")).distinct()
    exits = real.where(F.col("verb").isin(EXITS)).select("post_id", "person", F.col("day").alias("_x")).distinct()
    following = F.lead("start").over(Window.partitionBy("post_id").orderBy("start", "person"))
    left = entries.join(exits, ["post_id", "person"], "left").groupBy("post_id", "person", "start").agg(F.min(F.when(F.col("_x") >= F.col("start"), F.col("_x"))).alias("_left"))
    spans = left.withColumn("end", F.least("_left", following))
    return T.chain_spans(spans, ["post_id", "person"], "start", "end", gap)


def occupants(texts: DataFrame, posts: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(post_id, person, since, source) of each post that someone holds, and (reason, n) of the events refused. pages(page_id, html).

    An organ's own page goes before the gazette (one name a post; several names answer nothing); `since` is the open tenure's start where the gazette names the same person. Posts
    that neither names are left out. Null texts and pages hold nothing.
    """
    events = gazette_events(texts, posts)
    open_ = T.open_else_latest(tenures(events).where("end is null"), ["post_id"], "start", "end").select("post_id", F.col("person").alias("_by_acts"), F.col("start").alias("_since"))
    heads = Z.page_heads(pages).where("not acting").select(F.col("unit").alias("title"), C.name_key_full(F.col("name")).alias("person"))
    shown = heads.join(match_posts(heads.select("title"), posts), "title").groupBy("post_id").agg(F.min("person").alias("_by_page"), F.count_distinct("person").alias("n")).where("n = 1").drop("n")
    both = shown.join(open_, "post_id", "full_outer")
    same: Column = F.col("_by_page").isNull() | (F.col("_by_page") == F.col("_by_acts"))
    source = F.when(F.col("_by_page").isNull(), "gazette").when(same, "page and gazette").otherwise("page")
    held = both.select("post_id", F.coalesce("_by_page", "_by_acts").alias("person"), F.when(F.coalesce(same, F.lit(False)), F.col("_since")).alias("since"), F.when(F.col("_by_acts").isNull(), "page").otherwise(source).alias("source"))
    return held, events.where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))
