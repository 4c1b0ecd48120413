"""Facts in time: interval and as-of joins, inflation, terms, deadlines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lupaspark.functions import columns as C


def in_force_join(events: DataFrame, spans: DataFrame, key: list[str], at: str, start: str = "valid_from", end: str = "valid_to", extra: Column | None = None) -> DataFrame:
    """Events with the spans of the same key that hold on the event's day, both bounds included; a null end is open.

    Spans with an end join by key and month, one row for each month that they touch, so that a key's pairs grow with those that overlap; open spans join by key alone,
    since all later events of the key are theirs.
    """
    at_col = F.col(at).cast("date")
    month = lambda c: F.trunc(c, "month")
    inside = at_col >= F.col(start) if extra is None else (at_col >= F.col(start)) & extra
    shut = spans.where(F.col(end) >= F.col(start)).withColumn("_month", F.explode(F.sequence(month(F.col(start)), month(F.col(end)), F.expr("interval 1 month"))))
    met = events.withColumn("_month", month(at_col)).join(shut, [*key, "_month"]).where(inside & (at_col <= F.col(end))).drop("_month")
    return met.unionByName(events.join(spans.where(F.col(end).isNull()), key).where(inside))


def who_was(df: DataFrame, spans: DataFrame, at: str, start: str = "since", end: str = "until") -> DataFrame:
    """Df with `holder`, who held the post on a day; the later start wins on a shared day, then the greater holder. spans(holder, start, end); a null end is open, a null start never holds.

    A sweep without a range join: spans are cut at the bounds of months. Whole months of a span, one row each, reduce to the month's latest start in a partial aggregate; the days of the
    months that it only touches are at most 31 rows. Days then meet months and days by equality, and only those of df, whose first and last month bound open spans.
    """
    days = df.select(F.col(at).cast("date").alias("_d")).where("_d is not null").distinct()
    bounds = days.agg(F.min("_d").alias("_first"), F.max("_d").alias("_last"))
    known = spans.select("holder", F.col(start).cast("date").alias("_s"), F.col(end).cast("date").alias("_e")).where("_s is not null")
    cut = known.join(F.broadcast(bounds)).where("_s <= _last and (_e is null or (_e >= _first and _e >= _s))")  # one row
    cut = cut.select(F.struct(F.col("_s").alias("start"), "holder").alias("_who"), F.greatest("_s", "_first").alias("_s"), F.least(F.coalesce("_e", "_last"), "_last").alias("_e"))
    month = cut.withColumn("_m", F.explode(F.sequence(F.trunc("_s", "month"), F.trunc("_e", "month"), F.expr("interval 1 month"))))
    whole = (F.col("_s") <= F.col("_m")) & (F.col("_e") >= F.last_day("_m"))
    months = month.where(whole).groupBy("_m").agg(F.max("_who").alias("_by_month"))
    part = month.where(~whole).select("_who", F.explode(F.sequence(F.greatest("_s", "_m"), F.least("_e", F.last_day("_m")))).alias("_d"))
    single = part.groupBy("_d").agg(F.max("_who").alias("_by_day"))
    held = days.withColumn("_m", F.trunc("_d", "month")).join(months, "_m", "left").join(single, "_d", "left").select("_d", F.greatest("_by_month", "_by_day")["holder"].alias("holder"))
    return df.join(held, F.col(at).cast("date") == F.col("_d"), "left").drop("_d")


def asof_last(df: DataFrame, series: DataFrame, at: str, value: str, by: list[str] | None = None) -> DataFrame:
    """Each row with the last value of the series on or before its day (by the same key); null before the first.

    Days meet the series, not rows: both are made distinct, laid on one line and the last value carried on, by key and
    year so that a long series falls into parts; the value before each part's beginning comes from a second, short line.
    """
    keys = list(by or [])
    days = df.select(*keys, F.col(at).alias("_at")).distinct()
    known = series.select(*keys, F.col(at).alias("_at"), F.col(value).alias("_v"))
    line = days.withColumn("_v", F.lit(None).cast(dict(known.dtypes)["_v"])).withColumn("_day", F.lit(1)).unionByName(known.withColumn("_day", F.lit(0)))
    part = F.year("_at") if dict(known.dtypes)["_at"] in ("date", "timestamp", "timestamp_ntz") else F.floor(F.col("_at") / 1000)
    line = line.withColumn("_part", part)
    inner = Window.partitionBy(*keys, "_part").orderBy("_at", "_day").rowsBetween(Window.unboundedPreceding, 0)
    within = line.withColumn("_in", F.last("_v", ignorenulls=True).over(inner))
    ends = within.groupBy(*keys, "_part").agg(F.max_by("_in", F.struct("_at", "_day")).alias("_end"))
    before = ends.withColumn("_before", F.last("_end", ignorenulls=True).over(Window.partitionBy(*(keys or [F.lit(1)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).drop("_end")
    found = within.where("_day = 1").join(before, [*keys, "_part"], "left").select(*keys, "_at", F.coalesce("_in", "_before").alias(value))
    return df.join(found.withColumnRenamed("_at", at), [*keys, at], "left")


def deflator(series: DataFrame, base, ref) -> DataFrame:
    """One row with the price factor from one month to another, null where either is missing. series(month, value)."""
    value = lambda m: F.max(F.when(F.col("month") == F.lit(m).cast("date"), F.col("value")))
    return series.agg(F.try_divide(value(ref), value(base)).alias("factor"))


def standing_entry(events: DataFrame, unit: str, name: str, verb: str, date: str, entry: str, exit_: str) -> DataFrame:
    """Each unit's newest entry, unless any exit of the unit is dated on or after it."""
    w = Window.partitionBy(unit)
    left = events.withColumn("_x", F.max(F.when(F.col(verb) == exit_, F.col(date))).over(w)).where(F.col(verb) == entry)
    newest = left.withColumn("_n", F.row_number().over(w.orderBy(F.desc(date), name))).where("_n = 1")
    return newest.where(F.col("_x").isNull() | (F.col("_x") < F.col(date))).drop("_x", "_n")


def current_holder(events: DataFrame, unit: str, name: str, verb: str, date: str, entry: str, exit_: str) -> DataFrame:
    """Events folded into who holds each unit: the newest entry, unless the same name leaves on that day or later. An earlier holder never comes back."""
    newest = events.where(F.col(verb) == entry).groupBy(unit).agg(F.max(F.struct(date, name)).alias("e")).select(unit, F.col(f"e.{date}").alias("since"), F.col(f"e.{name}").alias(name))
    exits = events.where(F.col(verb) == exit_).groupBy(unit, name).agg(F.max(date).alias("_left"))
    return newest.join(exits, [unit, name], "left").where(F.col("_left").isNull() | (F.col("_left") < F.col("since"))).select(unit, name, "since")


def chain_spans(df: DataFrame, key: list[str], start: str, end: str, gap: int = 31) -> DataFrame:
    """Spans that follow within `gap` days are one tenure: (key, start, end, spans). An open span ends all."""
    far = F.lit("9999-12-31").cast("date")
    rows = df.select(*key, F.col(start).alias("_s"), F.coalesce(end, far).alias("_e"))
    w = Window.partitionBy(*key).orderBy("_s", "_e")
    reach = F.max("_e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    cut = rows.withColumn("_new", F.when(reach.isNull() | (F.datediff("_s", reach) > gap), 1).otherwise(0))
    islands = cut.withColumn("_i", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*key, "_i").agg(F.min("_s").alias(start), F.max("_e").alias("_end"), F.count("*").alias("spans")).select(*key, start, F.when(F.col("_end") < far, F.col("_end")).alias(end), "spans")


def open_else_latest(df: DataFrame, key: list[str], start: str, end: str) -> DataFrame:
    """The open span of each key, else that which ends last; the later start among equals."""
    w = Window.partitionBy(*key).orderBy(F.col(end).isNotNull(), F.desc(end), F.desc(start))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def tenure_list(terms: DataFrame, unit: str, person: str, start: str, end: str, cut, k: int = 40) -> DataFrame:
    """Terms that reach beyond the cut, the newest k of a unit; missing_predecessor marks a term that no other's end touches within a year."""
    w = Window.partitionBy(unit).orderBy(F.desc(start), person)
    prior = F.lead(end).over(w)
    rows = terms.withColumns({"missing_predecessor": prior.isNull() | (F.datediff(start, prior) > 365), "_n": F.row_number().over(w)})
    return rows.where((F.col(end).isNull() | (F.col(end) >= F.lit(cut))) & (F.col("_n") <= k)).drop("_n")


def weekly_counts(df: DataFrame, key: list[str], date: str, as_of, n: int = 12) -> DataFrame:
    """Rows of each of the last n weeks up to as_of; week 0 is the last. Weeks without rows are absent."""
    week = F.floor(F.datediff(F.lit(as_of).cast("date"), F.col(date).cast("date")) / 7)
    return df.withColumn("week", week).where(F.col("week").between(0, n - 1)).groupBy(*key, "week").agg(F.count("*").alias("n"))


def every_week(counts: DataFrame, keys_of: DataFrame, key: list[str], n: int = 12) -> DataFrame:
    """counts(key, week, n) with a zero for each week of the last n in which a key of keys_of(key) has no row."""
    weeks = keys_of.select(*key).distinct().withColumn("week", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    return weeks.join(counts, [*key, "week"], "left").select(*key, "week", F.coalesce("n", F.lit(0)).alias("n"))


def heat(df: DataFrame, key: str, date: str, as_of, k: int = 20) -> DataFrame:
    """Twice the rows of the last 7 days and a tenth of those of the last 90; the k hottest."""
    age = F.datediff(F.lit(as_of).cast("date"), F.col(date).cast("date"))
    out = df.groupBy(key).agg(F.count_if(age.between(0, 6)).alias("last_7"), F.count_if(age.between(0, 89)).alias("last_90"))
    return out.withColumn("heat", F.round(2 * F.col("last_7") + F.col("last_90") / 10, 1)).orderBy(F.desc("heat"), key).limit(k)


def silence(weeks: DataFrame, key: str, week: str, value: str, drop: float = 0.2, last: int = 8, least_weeks: int = 10, least_peak: float = 200) -> DataFrame:
    """(key, peak, weeks, silent): a peak of some size, then only weeks of at most a fifth of it."""
    w = Window.partitionBy(key)
    ranked = weeks.withColumns({"_r": F.row_number().over(w.orderBy(F.desc(week))), "_peak": F.max(value).over(w)})
    low = F.bool_and((F.col("_r") > last) | (F.col(value) <= drop * F.col("_peak")))
    out = ranked.groupBy(key).agg(F.max(value).alias("peak"), F.count("*").alias("weeks"), low.alias("_low"))
    return out.select(key, "peak", "weeks", (F.col("_low") & (F.col("weeks") >= least_weeks) & (F.col("peak") >= least_peak)).alias("silent"))


def topic_state(processes: DataFrame, topic: str, moved: str, closed: str, deadline: str, as_of) -> DataFrame:
    """(topic, state, days_still): none, closed, overdue, moving (within 30 days) or stalled."""
    today = F.lit(as_of).cast("date")
    out = processes.groupBy(topic).agg(F.count(moved).alias("n"), F.bool_and(F.coalesce(F.col(closed), F.lit(False))).alias("all_closed"), F.max(moved).alias("last"), F.min(F.when(~F.coalesce(F.col(closed), F.lit(False)), F.col(deadline))).alias("due"))
    still = F.datediff(today, "last")
    state = F.when(F.col("n") == 0, "none").when(F.col("all_closed"), "closed").when(F.col("due") < today, "overdue").when(still <= 30, "moving").otherwise("stalled")
    return out.select(topic, state.alias("state"), still.alias("days_still"))


def deadlines(items: DataFrame, opened: str, suspended: str, as_of, limit: int) -> DataFrame:
    """Due day, days left and state of items with a statutory limit in days."""
    today, due = F.lit(as_of).cast("date"), F.date_add(F.col(opened).cast("date"), limit)
    left = F.datediff(due, today)
    state = F.when(F.col(suspended), "suspended").when(left < -30, "long overdue").when(left < 0, "overdue").otherwise("open")
    return items.withColumns({"due": due, "days_left": left, "state": state})


def term_end(occupants: DataFrame, rule: str, start: str, years: str, birth: str) -> DataFrame:
    """End of term: mandate years less a day, or the 75th birthday, by the post's rule; null where the rule has none."""
    start_col = F.col(start).cast("date")
    by_years = F.date_sub(F.add_months(start_col, 12 * F.col(years)), 1)
    return occupants.withColumn("term_end", F.when(F.col(rule) == "mandate", by_years).when(F.col(rule) == "age 75", C.add_years(F.col(birth).cast("date"), 75)))


def attach_holder(items: DataFrame, occupants: DataFrame, post: str) -> DataFrame:
    """Open items with the post's first holder who does not act for another. occupants(post, seat, name, acting)."""
    first = occupants.where(~F.coalesce(F.col("acting"), F.lit(False))).groupBy(post).agg(F.min_by("name", F.struct("seat", "name")).alias("responsible"))
    return items.join(first, post, "left")


def approved_fallback(noms: DataFrame, posts: DataFrame, as_of) -> DataFrame:
    """Newest approved nominations within the mandate, as many as seats, each name once. noms(post, name, approved), posts(post, seats, years)."""
    once = noms.groupBy("post", "name").agg(F.max("approved").alias("approved"))
    live = once.join(posts, "post").where(F.add_months("approved", 12 * F.col("years")) > F.lit(as_of).cast("date"))
    w = Window.partitionBy("post").orderBy(F.desc("approved"), "name")
    return live.withColumn("seat", F.row_number().over(w)).where(F.col("seat") <= F.col("seats")).select("post", "seat", "name", "approved")


def weekly_views(df: DataFrame, key: str, date: str, value: str) -> DataFrame:
    """Sum of each week, by its Monday."""
    return df.groupBy(key, C.week_start(F.col(date)).alias("week")).agg(F.sum(value).alias("views"))


def views_to_date(df: DataFrame, key: str, date: str, value: str, as_of) -> DataFrame:
    """(key, week, views, last_7): sums by week, and beside each the key's sum of the seven days up to as_of."""
    age = F.datediff(F.lit(as_of).cast("date"), F.col(date).cast("date"))
    recent = df.groupBy(key).agg(F.coalesce(F.sum(F.when(age.between(0, 6), F.col(value))), F.lit(0)).alias("last_7"))
    return weekly_views(df, key, date, value).join(recent, key)


def once(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row for each key, the first by an order that is total."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def in_force(df: DataFrame, start: str, end: str, as_of) -> DataFrame:
    """Spans that hold on the day."""
    day = F.lit(as_of).cast("date")
    return df.where((F.col(start) <= day) & (F.col(end).isNull() | (F.col(end) >= day)))
