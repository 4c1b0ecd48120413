"""Aggregates and ratios (A1-A41). Sums of money are of decimals; missing is never zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sum_by(df: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """A1."""
    return df.groupBy(*keys).agg(*[F.sum(m).alias(m) for m in measures])


def multi_sum(df: DataFrame, sets: list[list[str]], measures: list[str]) -> DataFrame:
    """Several groupings in one pass; grouping names the set's columns."""
    cols = list(dict.fromkeys(c for s in sets for c in s))
    out = df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in cols]).agg(*[F.sum(m).alias(m) for m in measures], F.grouping_id(*cols).alias("_g"))
    n = len(cols)
    names = F.concat_ws(",", *[F.when(F.shiftright("_g", n - 1 - i).bitwiseAND(F.lit(1)) == 0, F.lit(c)) for i, c in enumerate(cols)])
    return out.select(names.alias("grouping"), *cols, *measures)


def revenue_rollup(df: DataFrame, kind: str, day: str, value: str) -> DataFrame:
    """A3: sums by month, by kind and by day, with the last day each has."""
    rows = df.select(F.col(kind).alias("kind"), F.to_date(day).alias("day"), F.trunc(F.to_date(day), "month").alias("month"), F.col(value).alias("value"))
    d, m, k = F.col("day"), F.col("month"), F.col("kind")
    return rows.withColumn("_d", d).groupingSets([[m], [k], [d]], m, k, d).agg(F.sum("value").alias("value"), F.max("_d").alias("last_day"))


def distinct_by(df: DataFrame, keys: list[str], col: str) -> DataFrame:
    """Exact; with no keys the distinct total over all groups."""
    return df.groupBy(*keys).agg(F.count_distinct(col).alias("n_distinct"))


def count_where(df: DataFrame, keys: list[str], predicates: dict[str, Column]) -> DataFrame:
    """A5: rows of each predicate."""
    return df.groupBy(*keys).agg(*[F.count_if(p).alias(n) for n, p in predicates.items()])


def histogram(df: DataFrame, keys: list[str], cat: str) -> DataFrame:
    """A6."""
    return df.groupBy(*keys, cat).agg(F.count("*").alias("n"))


def rate(df: DataFrame, num: str, den: str, min_base: float = 20, places: int = 1) -> DataFrame:
    """Per cent, null under the least base."""
    return df.withColumn("rate", F.when(F.col(den) >= min_base, F.bround(F.col(num).cast("double") * 100 / F.col(den), places)))


def rerate(df: DataFrame, keys: list[str], num: str, den: str, places: int = 1) -> DataFrame:
    """Where several rows meet in one key their parts are added first and the ratio is taken last."""
    out = df.groupBy(*keys).agg(F.sum(num).alias(num), F.sum(den).alias(den))
    return out.withColumn("rate", F.bround(F.try_divide(F.col(num).cast("double") * 100, F.col(den).cast("double")), places))


def median_by(df: DataFrame, keys: list[str], col: str, drop_zero: bool = False) -> DataFrame:
    """Nulls never count, zeros as asked."""
    v = F.when(F.col(col) != 0, F.col(col)) if drop_zero else F.col(col)
    return df.groupBy(*keys).agg(F.median(v.cast("double")).alias("median"), F.count(v).alias("n"))


def sampled_value(df: DataFrame, keys: list[str], col: str) -> DataFrame:
    """A10: median from five values on, range from three, else nothing but the reason."""
    v = F.col(col).cast("double")
    out = df.groupBy(*keys).agg(F.count(v).alias("n"), F.median(v).alias("_m"), F.min(v).alias("_a"), F.max(v).alias("_z"))
    some = F.col("n").between(3, 4)
    reason = F.when(F.col("n") < 3, "sample too small")
    return out.select(*keys, "n", F.when(F.col("n") >= 5, F.col("_m")).alias("median"), F.when(some, F.col("_a")).alias("low"), F.when(some, F.col("_z")).alias("high"), reason.alias("reason"))


def share(df: DataFrame, part: list[str], value: str, places: int = 4) -> DataFrame:
    """Of the group's total."""
    total = F.sum(value).over(Window.partitionBy(*part))
    return df.withColumn("share", F.bround(F.try_divide(F.col(value).cast("double"), total.cast("double")), places))


def concentration(df: DataFrame, part: list[str], item: str, value: str, k: int, places: int = 4) -> DataFrame:
    """Share of the k largest items in their group's total."""
    by = df.groupBy(*part, item).agg(F.sum(value).alias("v"))
    r = by.withColumn("_r", F.row_number().over(Window.partitionBy(*part).orderBy(F.desc("v"), item)))
    top = F.sum(F.when(F.col("_r") <= k, F.col("v")))
    return r.groupBy(*part).agg(F.count("*").alias("items"), F.bround(F.try_divide(top.cast("double"), F.sum("v").cast("double")), places).alias("top_share"))


def per_capita(df: DataFrame, pop: DataFrame, key: str, value: str, places: int = 4) -> DataFrame:
    """pop(key, population); null where it is missing or zero."""
    return df.join(pop, key, "left").withColumn("per_capita", F.bround(F.try_divide(F.col(value).cast("double"), F.col("population").cast("double")), places))


def yoy(df: DataFrame, key: list[str], year: str, value: str, y0: int, y1: int, places: int = 4) -> DataFrame:
    """One year as a ratio of another."""
    s = lambda y: F.sum(F.when(F.col(year) == y, F.col(value)))
    out = df.where(F.col(year).isin(y0, y1)).groupBy(*key).agg(s(y0).alias("before"), s(y1).alias("after"))
    return out.withColumn("ratio", F.bround(F.try_divide(F.col("after").cast("double"), F.col("before").cast("double")), places))


def same_period(df: DataFrame, date: str, value: str, last) -> DataFrame:
    """Each year up to the last day's month and day: closed months, and the current one as far."""
    last_col = F.lit(last).cast("date")
    upto = (F.month(date) < F.month(last_col)) | ((F.month(date) == F.month(last_col)) & (F.dayofmonth(date) <= F.dayofmonth(last_col)))
    return df.where(upto & (F.year(date) <= F.year(last_col))).groupBy(F.year(date).alias("year")).agg(F.sum(value).alias("value"))


def real_terms(df: DataFrame, index: str, value: str, ref_index: float, places: int = 2) -> DataFrame:
    """Values at the reference index's prices; nominal where there is no index."""
    return df.withColumn("real", F.bround(F.coalesce(F.col(value).cast("double") * F.lit(float(ref_index)) / F.col(index), F.col(value).cast("double")), places))


def run_rate(months: DataFrame, month: str, value: str, k: int = 3, places: int = 4) -> DataFrame:
    """Value a second over the last k months."""
    last = months.orderBy(F.desc(month)).limit(k)
    seconds = F.sum(F.dayofmonth(F.last_day(month)) * 86400)
    return last.agg(F.max(month).alias("last_month"), F.sum(value).alias("value"), F.bround(F.sum(value).cast("double") / seconds, places).alias("per_second"))


def attendance(votes: DataFrame, rolls: DataFrame, roster: DataFrame, person: str, roll: str) -> DataFrame:
    """Distinct roll calls with a vote, of all; people who never voted have 0."""
    cast = votes.join(rolls.select(roll).distinct(), roll, "left_semi").groupBy(person).agg(F.count_distinct(roll).alias("present"))
    out = roster.select(person).distinct().join(cast, person, "left").withColumn("present", F.coalesce("present", F.lit(0)))
    out = out.join(F.broadcast(rolls.agg(F.count_distinct(roll).alias("rolls"))))  # one row
    return out.withColumn("attendance", F.bround(F.try_divide(F.col("present") * F.lit(100.0), F.col("rolls").cast("double")), 1))


def quota(df: DataFrame, person: str, month: str, kind: str, value: str, k: int = 3) -> DataFrame:
    """Total, months, monthly mean and the k largest kinds."""
    kinds = df.groupBy(person, kind).agg(F.sum(value).alias("v"))
    top = kinds.withColumn("_r", F.row_number().over(Window.partitionBy(person).orderBy(F.desc("v"), kind))).where(F.col("_r") <= k).groupBy(person).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", kind))), lambda x: x[kind]), ",").alias("top_kinds"))
    out = df.groupBy(person).agg(F.sum(value).alias("total"), F.count_distinct(month).alias("months"))
    return out.withColumn("monthly", F.bround(F.try_divide(F.col("total").cast("double"), F.col("months").cast("double")), 2)).join(top, person)


def mandate_cost(offices: DataFrame, quota_: DataFrame, subsidy: float, person: str, elapsed: float) -> DataFrame:
    """Subsidy and staff for the months gone, and the quota spent. offices(person, staff), quota_(person, total)."""
    out = offices.join(quota_.select(person, F.col("total").alias("quota")), person, "left")
    return out.withColumn("cost", F.bround((F.lit(subsidy) + F.col("staff").cast("double")) * elapsed * 12 + F.coalesce(F.col("quota").cast("double"), F.lit(0.0)), 2))


def seat_cost(posts: DataFrame, rules: DataFrame, factors: DataFrame, facts: DataFrame) -> DataFrame:
    """(post, block, basis, annual, low, high): what each block of a seat costs a year, by law if a rule states it, else as measured.

    posts(post, family), rules(family, block, monthly), factors(block, times, cap, amortise_years), facts(post, block, value). Measured blocks take the median
    from five values on, a range from three; a cap bounds the month's value and an amortised block spreads over its years.
    """
    by_law = posts.join(rules, "family").select("post", "block", F.lit("law").alias("basis"), F.col("monthly").cast("double").alias("v"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"))
    m = sampled_value(facts, ["post", "block"], "value").where("n >= 3")
    measured = m.join(by_law.select("post", "block"), ["post", "block"], "left_anti").select("post", "block", F.lit("measured").alias("basis"), F.coalesce("median", (F.col("low") + F.col("high")) / 2).alias("v"), F.col("low").alias("lo"), F.col("high").alias("hi"))
    year = lambda c: F.bround(F.least(F.col(c), F.coalesce(F.col("cap").cast("double"), F.col(c))) * F.col("times") / F.coalesce(F.col("amortise_years"), F.lit(1)), 3)
    return by_law.unionByName(measured).join(factors, "block").select("post", "block", "basis", year("v").alias("annual"), F.when(F.col("lo").isNotNull(), year("lo")).alias("low"), F.when(F.col("hi").isNotNull(), year("hi")).alias("high"))


def family_cost(blocks: DataFrame, posts: DataFrame) -> DataFrame:
    """Cost of a collegiate family: seats times what a seat costs, and the mean of a seat. posts(post, family, seats)."""
    seat = blocks.groupBy("post").agg(F.sum("annual").alias("annual"))
    out = posts.join(seat, "post").groupBy("family").agg(F.bround(F.sum(F.col("annual") * F.col("seats")), 3).alias("total"), F.sum("seats").alias("seats"))
    return out.withColumn("per_seat", F.bround(F.try_divide(F.col("total"), F.col("seats").cast("double")), 3))


def house_rollup(people: DataFrame, house: str, measures: list[str]) -> DataFrame:
    """Sums and medians of each house, and of both together (null house)."""
    aggs = [F.count("*").alias("members")]
    for m in measures:
        aggs += [F.sum(m).alias(f"{m}_sum"), F.median(F.col(m).cast("double")).alias(f"{m}_median")]
    return people.rollup(house).agg(*aggs)


def party_history(posts: DataFrame, candidacies: DataFrame) -> DataFrame:
    """Holders of an organ's posts who once stood for a party. posts(organ, person), candidacies(person, party)."""
    return posts.join(candidacies, "person").groupBy("organ", "party").agg(F.count_distinct("person").alias("people"))


def supplier_rollup(contracts: DataFrame, supplier: str, organ: str, value: str) -> DataFrame:
    """A25."""
    return contracts.groupBy(supplier).agg(F.count("*").alias("n"), F.sum(value).alias("value"), F.count_distinct(organ).alias("organs"))


def class_volume(meetings: DataFrame, cls: str, entity: str) -> DataFrame:
    """Encounters and distinct entities of each class."""
    return meetings.groupBy(cls).agg(F.count("*").alias("encounters"), F.count_distinct(entity).alias("entities"))


def who_received(meetings: DataFrame, person: str, entity: str) -> DataFrame:
    """A27."""
    return meetings.groupBy(person).agg(F.count("*").alias("encounters"), F.count_distinct(entity).alias("entities"))


def tenure_stats(terms: DataFrame, unit: str, person: str, start: str, end: str) -> DataFrame:
    """Distinct holders and the median days of ended terms."""
    days = F.datediff(end, start).cast("double")
    return terms.groupBy(unit).agg(F.count_distinct(person).alias("holders"), F.median(days).alias("median_days"), F.count(end).alias("closed"))


def graph_stats(nodes: DataFrame, dims: list[str]) -> DataFrame:
    """Nodes, seats and those filled, by each dimension and in all."""
    long = F.explode(F.array(F.struct(F.lit("all").alias("dimension"), F.lit("").alias("value")), *[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dims]))
    out = nodes.select("seats", "filled", long.alias("d")).groupBy("d.dimension", "d.value").agg(F.count("*").alias("nodes"), F.sum("seats").alias("seats"), F.sum("filled").alias("filled"))
    return out.withColumn("vacant", F.col("seats") - F.col("filled"))


def transparency(blocks: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """How many of the measures each row of a group publishes on average, and the share that publishes none."""
    have = sum((F.col(m).isNotNull().cast("int") for m in measures), F.lit(0))
    out = blocks.withColumn("_h", have).groupBy(*keys).agg(F.count("*").alias("organs"), F.bround(F.avg("_h"), 4).alias("mean_blocks"), F.count_if(F.col("_h") == 0).alias("none"))
    return out.withColumn("none_pct", F.bround(F.col("none") * 100.0 / F.col("organs"), 1))


def penalties(df: DataFrame, company: str, start: str, end: str, as_of) -> DataFrame:
    """A32."""
    day = F.lit(as_of).cast("date")
    live = (F.col(start) <= day) & (F.col(end).isNull() | (F.col(end) >= day))
    return df.agg(F.count("*").alias("total"), F.count_distinct(company).alias("companies"), F.count_if(live).alias("in_force"), F.min(start).alias("earliest"))


def backlog(items: DataFrame, due: str, value: str, as_of) -> DataFrame:
    """A33."""
    left = F.datediff(F.col(due), F.lit(as_of).cast("date"))
    return items.agg(F.count("*").alias("pending"), F.count_if(left < 0).alias("overdue"), F.min(due).alias("oldest_due"), F.count_if(left.between(0, 30)).alias("expiring"), F.sum(F.when(left < 0, F.col(value))).alias("at_risk"))


def authorship(authors: DataFrame, person: str, bill: str, order: str, cls: str, law: str) -> DataFrame:
    """Bills of each person, first-signed ones, those that became law, and classes."""
    return authors.groupBy(person).agg(F.count_distinct(bill).alias("bills"), F.count_if(F.col(order) == 1).alias("first_author"), F.count_distinct(F.when(F.col(law), F.col(bill))).alias("became_law"), F.count_distinct(cls).alias("classes"))


def preferred_spelling(df: DataFrame, key: str, raw: str) -> DataFrame:
    """Each key's commonest raw form, the first by alphabet among equals."""
    n = df.groupBy(key, raw).agg(F.count("*").alias("_n"))
    return n.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_n"), raw))).where("_r = 1").select(key, raw, F.col("_n").alias("n"))


def state_bundle(people: DataFrame, amendments: DataFrame, transfers: DataFrame) -> DataFrame:
    """(uf, delegation, amended, transferred) beside the medians of all states."""
    out = people.groupBy("uf").agg(F.count_distinct("person_id").alias("delegation")).join(amendments.groupBy("uf").agg(F.sum("value").alias("amended")), "uf", "left").join(transfers.groupBy("uf").agg(F.sum("value").alias("transferred")), "uf", "left")
    m = out.agg(F.median(F.col("amended").cast("double")).alias("amended_median"), F.median(F.col("transferred").cast("double")).alias("transferred_median"))
    return out.join(F.broadcast(m))  # m is one row


def payroll_components(df: DataFrame, person: str, gross: str, cut: str, indemnity: str) -> DataFrame:
    """Gross, cut (kept as an amount), indemnities and what is left."""
    out = df.groupBy(person).agg(F.sum(gross).alias("gross"), F.sum(F.abs(cut)).alias("cut"), F.sum(indemnity).alias("indemnity"))
    return out.withColumn("net", F.col("gross") - F.col("cut") + F.col("indemnity"))


def match_report(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows by criterion, confidence and reason, and their share."""
    out = df.groupBy(*cols).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("_t"))
    return out.join(F.broadcast(total)).withColumn("pct", F.bround(F.col("n") * 100.0 / F.col("_t"), 1)).drop("_t")  # one row


def party_mix(people: DataFrame, party: str, k: int = 8) -> DataFrame:
    """A40."""
    return people.groupBy(party).agg(F.count("*").alias("n")).orderBy(F.desc("n"), party).limit(k)


def transition_counts(occupants: DataFrame, entry: str, term_end: str, date) -> DataFrame:
    """Freely appointed, fixed terms that end after the date, and for life."""
    return occupants.agg(F.count_if(F.col(entry) == "free").alias("free"), F.count_if((F.col(entry) == "mandate") & (F.col(term_end) > F.lit(date).cast("date"))).alias("fixed_beyond"), F.count_if(F.col(entry) == "life").alias("life"))
