"""News linked to the graph, and what is hot in it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lupaspark.operators import graph as G
from lupaspark.operators import temporal as T
from lupaspark.operators import text as X


def linked(articles: DataFrame, forms: DataFrame, topics: dict[str, list[str]], off_topic: str, verdicts: DataFrame, as_of, days: int = 180) -> tuple[DataFrame, DataFrame]:
    """(doc_id, date, id, form) of the entities that relevant articles name, and (doc_id, topic).

    articles(doc_id, date, text) older than `days` are not kept (I3); an article is relevant by its stored verdict, else if it names an entity and is not off topic (X5, X6). forms(id, form) come from
    aliases and names of people (X2, X3); verdicts(doc_id, verdict).
    """
    age = F.datediff(F.lit(as_of).cast("date"), F.col("date").cast("date"))
    kept = articles.where(age.between(0, days))
    links = X.link_entities(kept.select("doc_id", "text"), forms)
    good = X.apply_verdicts(X.gate_rule(kept.select("doc_id", "text"), links, off_topic), verdicts).where("relevant").select("doc_id")
    found = links.join(good, "doc_id").join(kept.select("doc_id", "date"), "doc_id").select("doc_id", "date", "id", "form")
    return found, X.tag_topics(kept.join(good, "doc_id").select("doc_id", "text"), topics)


def power_map(found: DataFrame, edges: DataFrame, types: list[str], as_of, barred: list = (), k: int = 20) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, heat, mentions) of the k hottest entities (W13, X18), their weeks (id, week, n) without gaps (W12), and the edges among them."""
    once = found.select("doc_id", "date", "id").distinct().where(~F.col("id").isin([*barred]))
    hot = T.heat(once, "id", "date", as_of, k).select("id", "heat")
    counted = hot.join(X.mentions(once.select("doc_id", "id"), once.select("doc_id", "date").distinct(), [], as_of), "id", "left").select("id", "heat", F.coalesce("n", F.lit(0)).alias("mentions"))
    weeks = T.every_week(T.weekly_counts(once.join(hot.select("id"), "id"), ["id"], "date", as_of), hot.select("id"), ["id"])
    return counted, weeks, G.subgraph(edges, hot.select("id"), types)
