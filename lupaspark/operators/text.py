"""Facts from texts."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lupaspark.functions import columns as C


def eligible_aliases(nodes: DataFrame, stop: list[str]) -> DataFrame:
    """(id, form): siglas of up to eight capitals, and names of two words and twelve characters; stop words never. nodes(id, alias)."""
    a = F.col("alias")
    ok = a.rlike(r"^[A-Z]{2,8}$") | ((F.size(C.tokens(a)) >= 2) & (F.length(a) >= 12))
    return nodes.where(ok & ~C.norm_alnum(a).isin(stop)).select("id", C.norm_alnum(a).alias("form")).distinct()


def person_forms(people: DataFrame, nicknames: DataFrame | None = None) -> DataFrame:
    """(id, form): full name, first and last, first two, last two words, and nicknames(id, name)."""
    w = C.tokens(F.col("name"))
    at = lambda c, i: F.get(c, F.lit(i))
    forms = people.select("id", w.alias("w")).where(F.size("w") >= 2).select("id", F.explode(F.array_distinct(F.array(F.array_join("w", " "), F.concat_ws(" ", at(F.col("w"), 0), F.element_at("w", -1)), F.concat_ws(" ", at(F.col("w"), 0), at(F.col("w"), 1)), F.concat_ws(" ", F.element_at("w", -2), F.element_at("w", -1))))).alias("form"))
    if nicknames is not None:
        forms = forms.unionByName(nicknames.select("id", C.norm_alnum(F.col("name")).alias("form")))
    return forms.distinct()


def link_entities(texts: DataFrame, forms: DataFrame, most: int = 8, key_words: int = 8) -> DataFrame:
    """(doc_id, id, form, first): entities whose form is a run of the text's words; forms of several entities name none. texts(doc_id, text), forms(id, form).

    Runs of words meet forms by equality; only lengths that forms have are made. A form of more than key_words words is met by its first ones, and the text
    then tells whether the others follow. The longest form of an entity counts, and a text's `most` earliest entities.
    """
    known = forms.groupBy("form").agg(F.min("id").alias("id"), F.count_distinct("id").alias("n")).where("n = 1").select("form", "id", F.split("form", " ").alias("parts"))
    known = known.select("form", "id", F.size("parts").alias("words"), F.array_join(F.slice("parts", 1, key_words), " ").alias("key"))
    lengths = [r[0] for r in known.select(F.least("words", F.lit(key_words))).distinct().collect()]  # at most key_words numbers
    if not lengths:
        return texts.select("doc_id", F.lit(None).cast(dict(forms.dtypes)["id"]).alias("id"), F.lit("").alias("form"), F.lit(0).alias("first")).limit(0)

    def runs(w: Column) -> Column:
        """All runs of words that have a form's length; the words are bound once, not made anew for each length or run."""
        of = lambda n: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.struct(i.alias("first"), F.array_join(F.slice(w, i + 1, n), " ").alias("key"))))
        return F.flatten(F.array_compact(F.array(*[of(n) for n in sorted(lengths)])))

    every = F.element_at(F.transform(F.array(C.tokens(F.col("text"))), runs), 1)
    runs = texts.select("doc_id", F.explode(every).alias("run")).select("doc_id", "run.first", "run.key")
    met = runs.join(known, "key")
    short = met.where(F.col("words") <= key_words).select("doc_id", "id", "form", "words", "first")
    long = met.where(F.col("words") > key_words).join(texts.select("doc_id", C.tokens(F.col("text")).alias("w")), "doc_id")
    long = long.where(F.array_join(F.slice("w", F.col("first") + 1, F.col("words")), " ") == F.col("form")).select("doc_id", "id", "form", "words", "first")
    hits = short.unionByName(long).groupBy("doc_id", "id").agg(F.max_by("form", F.struct("words", -F.col("first"))).alias("form"), F.min("first").alias("first"))
    return hits.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id").orderBy("first", "id"))).where(F.col("_n") <= most).drop("_n")


def tag_topics(texts: DataFrame, topics: dict[str, list[str]]) -> DataFrame:
    """(doc_id, topic): topics with a keyword in the folded text."""
    t = C.fold(F.col("text"))
    tags = F.array_compact(F.array(*[F.when(F.exists(F.array(*[F.lit(k) for k in ks]), lambda k: F.contains(t, k)), F.lit(name)) for name, ks in topics.items()]))
    return texts.select("doc_id", F.explode(tags).alias("topic"))


def gate_rule(texts: DataFrame, links: DataFrame, off_topic: str) -> DataFrame:
    """(doc_id, relevant, provisional): linked to an entity and not off topic by pattern."""
    linked = links.select("doc_id").distinct().withColumn("_l", F.lit(True))
    return texts.join(linked, "doc_id", "left").select("doc_id", (F.coalesce("_l", F.lit(False)) & ~C.fold(F.coalesce("text", F.lit(""))).rlike(off_topic)).alias("relevant"), F.lit(True).alias("provisional"))


def apply_verdicts(gated: DataFrame, verdicts: DataFrame) -> DataFrame:
    """A stored verdict goes before the rule. verdicts(doc_id, verdict)."""
    return gated.join(verdicts, "doc_id", "left").select("doc_id", F.coalesce("verdict", "relevant").alias("relevant"), F.col("verdict").isNull().alias("provisional"))


def mentions(links: DataFrame, dates: DataFrame, barred: list, as_of, days: int = 90) -> DataFrame:
    """Documents of the last days that mention each entity. dates(doc_id, date)."""
    age = F.datediff(F.lit(as_of).cast("date"), F.col("date").cast("date"))
    return links.where(~F.col("id").isin(barred)).join(dates, "doc_id").where(age.between(0, days - 1)).groupBy("id").agg(F.count_distinct("doc_id").alias("n"))


_NAME = r"[A-ZÀ-Ý][A-ZÀ-Ý'.-]+(?:\s+(?:D[AEO]S?\s+)?[A-ZÀ-Ý][A-ZÀ-Ý'.-]*)+"
_BEFORE = r"(?:[,:]?\s+(?:a pedido|a contar d[^,;]{1,60}|a partir d[^,;]{1,60}|com efeitos [^,;]{1,60}))*"
_TITLE = r"(?:[oaOA]s?\s+)?(?:(?i:senhora?|doutora?|dra?\.?|sra?\.?)\s+)?"
_POST = r"(?:cargo|função|funcao)(?:\s+(?:em comissão|comissionad[ao]|de confiança|efetiv[ao]|de natureza especial))*\s+d[eo]\s+([^;.,]+)(?:,?\s+d[aeo]\s+([^;.]+))?"
ACT = rf"\b(NOMEAR|EXONERAR|DESIGNAR|DISPENSAR)\b{_BEFORE}[,:]?\s+{_TITLE}({_NAME})[^;]*?{_POST}"


def parse_acts(texts: DataFrame) -> DataFrame:
    """(doc_id, act_no, verb, name, post, org_text): each act of a gazette text. "a pedido", dates from which it counts and honorifics may stand before the name."""
    every = F.regexp_extract_all("text", F.lit(ACT), F.lit(0))
    rows = texts.select("doc_id", F.posexplode(every).alias("act_no", "act"))
    part = lambda i: F.regexp_extract("act", ACT, i)
    return rows.select("doc_id", "act_no", F.lower(part(1)).alias("verb"), F.trim(part(2)).alias("name"), F.trim(part(3)).alias("post"), F.nullif(F.trim(part(4)), F.lit("")).alias("org_text"))


def acts_for_names(texts: DataFrame, names: DataFrame, before: int = 700, after: int = 400) -> DataFrame:
    """(doc_id, person_id, verb, post): the last verb up to `before` characters ahead of a name and the post up to `after` behind it. texts(doc_id, text), names(person_id, name).

    Names meet texts by their words (X1); only those pairs are searched.
    """
    pairs = link_entities(texts, names.select(F.col("person_id").alias("id"), C.norm_alnum(F.col("name")).alias("form"))).select("doc_id", F.col("id").alias("person_id"), "form").join(texts, "doc_id")

    def rows(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        verb, post = re.compile(r"nomear|exonerar|designar|dispensar"), re.compile(r"(?:cargo|funcao) de ([^;.,]+)")
        table = str.maketrans(C.ACCENTED, C.PLAIN)
        for df in it:
            out = []
            for r in df.itertuples():
                text = r.text.lower().translate(table)
                m = re.search(r"\W+".join(map(re.escape, r.form.split(" "))), text)
                if m:
                    verbs = verb.findall(text[max(0, m.start() - before) : m.start()])
                    p = post.search(text[m.end() : m.end() + after])
                    if verbs:
                        out.append((r.doc_id, r.person_id, verbs[-1], p.group(1).strip() if p else None))
            yield pd.DataFrame(out, columns=["doc_id", "person_id", "verb", "post"])

    return pairs.mapInPandas(rows, f"doc_id {dict(texts.dtypes)['doc_id']}, person_id {dict(names.dtypes)['person_id']}, verb string, post string")


HONORIFICS = r"^(?:(?:O|A)\s+)?(?:SENHORA?|DOUTORA?|DR\.?|DRA\.?|SR\.?|SRA\.?)\s+"


def acts_with_names(texts: DataFrame) -> DataFrame:
    """Acts whose name, less its honorific, is a person's."""
    acts = parse_acts(texts).withColumn("name", F.regexp_replace("name", HONORIFICS, ""))
    return acts.where(is_person_name(F.col("name")))


def is_person_name(s: Column, banned: tuple[str, ...] = ("ministerio", "secretaria", "departamento", "diretoria", "instituto", "conselho", "cargo", "processo")) -> Column:
    """Two to eight words of letters, none an office's, not all connectives."""
    w = C.tokens(s)
    real = F.filter(w, lambda t: ~t.isin(C.CONNECTIVES))
    return F.coalesce(F.size(w).between(2, 8) & (F.size(real) >= 2) & F.forall(w, lambda t: t.rlike("^[a-z]+$")) & ~F.exists(w, lambda t: t.isin(*banned)), F.lit(False))


def parse_nomination(s: Column) -> tuple[Column, Column]:
    """(name, post) of a nomination's summary."""
    p = r"(?i)(?:nome|indicação)\s+d[aeo]\s+(?:senhora?\s+)?([^,]+?),?\s+para\s+(?:exercer\s+)?o\s+cargo\s+de\s+([^,.;]+)"
    return F.nullif(F.trim(F.regexp_extract(s, p, 1)), F.lit("")), F.nullif(F.trim(F.regexp_extract(s, p, 2)), F.lit(""))


def participants(events: DataFrame) -> DataFrame:
    """X11: (event_id, side, name, role, entity) from an event's lines; a line that names a section counts for those below it. events(event_id, html)."""
    lines = events.select("event_id", F.posexplode(C.html_lines(F.col("html"))).alias("n", "line"))
    side = F.when(C.fold(F.col("line")).rlike("agentes? publicos?"), "public").when(C.fold(F.col("line")).rlike("agentes? privados?|particulares"), "private")
    w = Window.partitionBy("event_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumns({"_s": side, "side": F.last(side, ignorenulls=True).over(w)}).where("_s is null and side is not null")
    return rows.select("event_id", "side", F.trim(F.regexp_extract("line", r"^([^(\-–]+)", 1)).alias("name"), F.nullif(F.regexp_extract("line", r"\(([^)]*)\)", 1), F.lit("")).alias("role"), F.nullif(F.trim(F.regexp_extract("line", r"[-–]\s*(.+)$", 1)), F.lit("")).alias("entity"))


def title_person(s: Column, roles: str = r"ministr|secretari|president|diretor|governador|deputad|senador|embaixador") -> tuple[Column, Column]:
    """(name, role) of 'name, role' and 'role, name'."""
    a, b = F.trim(F.substring_index(s, ",", 1)), F.trim(F.substring_index(s, ",", -1))
    comma = F.contains(s, F.lit(","))
    a_role, b_role = C.fold(a).rlike(roles), C.fold(b).rlike(roles)
    return F.when(comma & a_role & ~b_role, b).when(comma, a).otherwise(F.trim(s)), F.when(comma & a_role & ~b_role, a).when(comma & b_role, b)


def heads_from_pages(pages: DataFrame, labels: str = r"diretor|secretari|president|chefe|coordenador", reach: int = 3) -> DataFrame:
    """(page_id, unit, name, acting): the nearest person's name within `reach` lines after a line that names an office. pages(page_id, html)."""
    lines = pages.select("page_id", F.posexplode(C.html_lines(F.col("html"))).alias("n", "line"))
    marked = lines.withColumns({"office": C.fold(F.col("line")).rlike(labels), "person": is_person_name(F.col("line"))})
    w = Window.partitionBy("page_id").orderBy("n")
    ahead = w.rowsBetween(1, reach)
    name = F.first(F.when(F.col("person") & ~F.col("office"), F.col("line")), ignorenulls=True).over(ahead)
    out = marked.withColumn("name", name).where("office and name is not null")
    return out.select("page_id", F.col("line").alias("unit"), "name", C.fold(F.col("line")).rlike("substitut|interin|em exercicio").alias("acting"))


@F.pandas_udf(StringType())
def absolute(base: pd.Series, href: pd.Series) -> pd.Series:
    def one(b: str | None, h: str | None) -> str | None:
        try:
            return urljoin(b or "", h or "")
        except ValueError:
            return None

    return pd.Series([one(b, h) for b, h in zip(base, href, strict=True)])


def page_links(pages: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """(page_id, link): distinct absolute links, of the given file types if any. pages(page_id, url, html)."""
    hrefs = F.regexp_extract_all("html", F.lit(r"(?i)<a\b[^>]*?href=[\"']([^\"'#][^\"']*)[\"']"), F.lit(1))
    rows = pages.select("page_id", "url", F.explode(F.array_distinct(hrefs)).alias("href"))
    out = rows.select("page_id", absolute("url", "href").alias("link")).where("link is not null").distinct()
    return out if not kinds else out.where(F.lower(F.regexp_extract("link", r"\.(\w{2,5})(?:[?#]|$)", 1)).isin(kinds))


def page_tables(pages: DataFrame) -> DataFrame:
    """(page_id, table_no, row_no, cells): rows of the pages' tables."""
    tables = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?is)<table\b.*?</table>"), F.lit(0))).alias("table_no", "t"))
    rows = tables.select("page_id", "table_no", F.posexplode(F.regexp_extract_all("t", F.lit(r"(?is)<tr\b.*?</tr>"), F.lit(0))).alias("row_no", "r"))
    cells = F.transform(F.regexp_extract_all("r", F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), F.lit(1)), lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", " "), r"\s+", " ")))
    return rows.select("page_id", "table_no", "row_no", cells.alias("cells"))


def snippet(s: Column) -> Column:
    """The first sentence if it has 40 to 260 characters, else the first 220."""
    first = F.regexp_extract(s, r"(?s)^(.*?[.!?])(?:\s|$)", 1)
    return F.when(F.length(first).between(40, 260), first).otherwise(s.substr(1, 220))


def rapporteur(steps: DataFrame, roster: DataFrame) -> DataFrame:
    """(bill, person_id) named as rapporteur in a dispatch; unique names of the roster only. steps(bill, text), roster(person_id, name)."""
    name = F.regexp_extract(F.col("text"), r"(?i)(?:designad[oa]\s+)?relator(?:a)?,?\s+(?:o\s+|a\s+)?(?:dep(?:utad[oa])?\.?|sen(?:ador(?:a)?)?\.?)\s+([^(,;.]+)", 1)
    keys = roster.groupBy(C.norm_alpha(F.col("name")).alias("k")).agg(F.min("person_id").alias("person_id"), F.count_distinct("person_id").alias("n")).where("n = 1")
    return steps.withColumn("k", C.norm_alpha(name)).where("k <> ''").join(keys, "k").select("bill", "person_id").distinct()


def entity_key(s: Column) -> Column:
    """The sigla beside a dash, else the name's core."""
    sigla = F.coalesce(F.nullif(F.regexp_extract(s, r"^([A-Z]{2,12})\s+[-–]\s", 1), F.lit("")), F.nullif(F.regexp_extract(s, r"\s[-–]\s+([A-Z]{2,12})$", 1), F.lit("")))
    return F.coalesce(F.lower(sigla), C.core_name(C.strip_legal_form(s)))
