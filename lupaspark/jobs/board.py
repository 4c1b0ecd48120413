"""The inaction board, followed topics, and waived taxes beside budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lupaspark.functions import columns as C
from lupaspark.operators import ranking as W
from lupaspark.operators import segments as SG
from lupaspark.operators import temporal as T
from lupaspark.operators import text as X


def open_items(items: DataFrame, occupants: DataFrame, as_of, limit: int) -> DataFrame:
    """Items without an outcome, with due day, days left, state (W16) and who is responsible.

    items(item_id, post, opened, suspended, outcome): an outcome text that shows an end (F30) closes the item; null or other texts leave it open. occupants(post, seat, name, acting).
    """
    still = items.withColumn("ended", C.class_by_patterns(F.col("outcome"), C.OUTCOMES, None)).where("ended is null").drop("ended")
    return T.attach_holder(T.deadlines(still, "opened", "suspended", as_of, limit), occupants, "post")


def topics(processes: DataFrame, words: dict[str, list[str]], views: DataFrame, as_of) -> DataFrame:
    """(topic, state, days_still, peak, silent): where the processes of each topic stand (W15) and whether attention fell silent after a peak.

    processes(process, title, moved, closed, deadline): topics by words of the title (X4); a process may have several. views(topic, date, value). A followed topic without processes is 'none'.
    """
    tagged = X.tag_topics(processes.select(F.col("process").alias("doc_id"), F.col("title").alias("text")), words).select(F.col("doc_id").alias("process"), "topic")
    known = processes.sparkSession.createDataFrame([(w,) for w in words], "topic string")
    rows = known.join(tagged.join(processes, "process"), "topic", "left")
    weeks = T.weekly_views(views, "topic", "date", "value")
    return T.topic_state(rows, "topic", "moved", "closed", "deadline", as_of).join(T.silence(weeks, "topic", "week", "views").select("topic", "peak", "silent"), "topic", "left")


def waived(sheet: DataFrame, ministries: DataFrame, budgets: DataFrame, k: int = 12) -> tuple[DataFrame, DataFrame]:
    """(function, waived, ministry, budget, ratio) of the k functions that waive most, and (item, function, value) of every item.

    sheet(section, n, label, value) lists functions, each followed by the items that add up to it (W23); sections are files. ministries(function, ministry), budgets(ministry, budget). Items
    under no function have a null one; functions of the same name in several sections are added up.
    """
    told = SG.segment_by_sum(sheet, "section", ["n"], "label", "value")
    heads = told.where("items is not null").groupBy(F.col("label").alias("function")).agg(F.sum("value").alias("waived"))
    beside = heads.join(ministries, "function", "left").join(budgets, "ministry", "left").withColumn("ratio", F.bround(F.try_divide(F.col("waived").cast("double"), F.col("budget").cast("double")), 4))
    items = told.where("items is null").select("section", "n", F.col("label").alias("item"), F.col("parent").alias("function"), "value")
    return W.global_top(beside, [F.desc("waived"), F.asc("function")], k), items
