"""Column functions: normalised keys, names, dates, money and closed classifications. All stay in the JVM, but for entities in pages."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Accented letters and what they become.
ACCENTED = "áàâãäåéèêëíìîïóòôõöúùûüçñýÿªº"
PLAIN = "aaaaaaeeeeiiiiooooouuuucnyyao"
# Portuguese connectives, legal forms, name suffixes, months.
CONNECTIVES = ["a", "as", "o", "os", "e", "da", "das", "de", "do", "dos", "em", "na", "nas", "no", "nos", "para", "por", "com"]
LEGAL_FORMS = ["sa", "s a", "ltda", "eireli", "me", "epp", "ss", "cia"]
NAME_SUFFIXES = ["filho", "neto", "junior", "jr", "sobrinho", "segundo"]
MONTHS = ["janeiro", "fevereiro", "março", "abril", "maio", "junho", "julho", "agosto", "setembro", "outubro", "novembro", "dezembro"]
STATES = {
    "acre": "AC", "alagoas": "AL", "amapa": "AP", "amazonas": "AM", "bahia": "BA", "ceara": "CE", "distrito federal": "DF", "espirito santo": "ES", "goias": "GO",
    "maranhao": "MA", "mato grosso": "MT", "mato grosso do sul": "MS", "minas gerais": "MG", "para": "PA", "paraiba": "PB", "parana": "PR", "pernambuco": "PE",
    "piaui": "PI", "rio de janeiro": "RJ", "rio grande do norte": "RN", "rio grande do sul": "RS", "rondonia": "RO", "roraima": "RR", "santa catarina": "SC",
    "sao paulo": "SP", "sergipe": "SE", "tocantins": "TO",
}
STATE_CODES = {
    "11": "RO", "12": "AC", "13": "AM", "14": "RR", "15": "PA", "16": "AP", "17": "TO", "21": "MA", "22": "PI", "23": "CE", "24": "RN", "25": "PB", "26": "PE", "27": "AL",
    "28": "SE", "29": "BA", "31": "MG", "32": "ES", "33": "RJ", "35": "SP", "41": "PR", "42": "SC", "43": "RS", "50": "MS", "51": "MT", "52": "GO", "53": "DF",
}


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def fold(s: Column) -> Column:
    """lower case without accents, one character for each of the input's, so that offsets hold."""
    return F.translate(F.lower(s), ACCENTED, PLAIN)


def _spaced(s: Column, keep: str) -> Column:
    ascii_only = F.regexp_replace(fold(s), r"[^\x00-\x7f]", "")  # what has no plain letter goes without a trace
    return F.trim(F.regexp_replace(F.regexp_replace(ascii_only, f"[^{keep} ]", " "), " +", " "))


def norm_alpha(s: Column) -> Column:
    """letters and single spaces."""
    return _spaced(s, "a-z")


def norm_alnum(s: Column) -> Column:
    """letters, digits and single spaces."""
    return _spaced(s, "a-z0-9")


def slug(s: Column) -> Column:
    """identifier of letters, digits and single hyphens."""
    return F.regexp_replace(F.regexp_replace(fold(s), "[^a-z0-9]+", "-"), "^-|-$", "")


def tokens(s: Column) -> Column:
    return F.filter(F.split(norm_alnum(s), " "), lambda t: t != "")


def core_name(s: Column, abbreviations: dict[str, str] | None = None) -> Column:
    """hyphenated words joined, abbreviations spelled out, connectives dropped."""
    words = tokens(F.regexp_replace(s, r"(?<=\w)-(?=\w)", ""))
    if abbreviations:
        words = F.transform(words, lambda t: F.coalesce(F.element_at(_map(abbreviations), t), t))
    return F.array_join(F.filter(words, lambda t: ~t.isin(CONNECTIVES)), " ")


def strip_legal_form(s: Column) -> Column:
    """company name without its final legal forms."""
    return F.trim(F.regexp_replace(norm_alnum(s), r"(?:\s(?:" + "|".join(LEGAL_FORMS) + r"))+$", ""))


def strip_admin_prefix(s: Column, prefixes: list[str]) -> Column:
    """name without a leading administrative word."""
    return F.trim(F.regexp_replace(norm_alnum(s), "^(?:" + "|".join(prefixes) + r")\s+(?:(?:da|de|do|das|dos)\s+)?", ""))


def key_without_connectives(s: Column) -> Column:
    """F8."""
    return F.array_join(F.filter(tokens(s), lambda t: ~t.isin(CONNECTIVES)), " ")


def name_variants(s: Column) -> Column:
    """the name, without its final parenthesis, and what stands before ' - '; in this order, distinct."""
    raw = F.trim(s)
    return F.array_distinct(F.array(raw, F.trim(F.regexp_replace(raw, r"\s*\([^)]*\)\s*$", "")), F.trim(F.substring_index(raw, " - ", 1))))


def stem_tokens(s: Column) -> Column:
    """words without connectives, plural and gender endings cut."""
    stem = lambda t: F.when(F.length(t) > 4, F.regexp_replace(F.regexp_replace(t, "(oes|aes)$", "ao"), "(as|os|es|a|o|s)$", "")).otherwise(t)
    return F.transform(F.filter(tokens(s), lambda t: ~t.isin(CONNECTIVES)), stem)


def role_head(s: Column, roles: list[str]) -> Column:
    """the first of the roles, in order of priority, with which the text begins."""
    return F.coalesce(*[F.when(norm_alnum(s).rlike(f"^{r}\\b"), F.lit(r)) for r in roles])


def name_key_full(s: Column) -> Column:
    """all words of a person's name but connectives."""
    return key_without_connectives(s)


def name_key_base(s: Column) -> Column:
    """the same without suffixes such as Filho at the end."""
    words = F.split(name_key_full(s), " ")
    last = F.aggregate(F.sequence(F.lit(1), F.size(words)), F.lit(0), lambda acc, i: F.when(F.get(words, i - 1).isin(NAME_SUFFIXES), acc).otherwise(i))
    return F.array_join(F.slice(words, 1, F.greatest(last, F.lit(1))), " ")


def name_key_first_last(s: Column) -> Column:
    """first and last word of the base key."""
    words = F.split(name_key_base(s), " ")
    return F.when(F.size(words) > 1, F.concat_ws(" ", F.get(words, F.lit(0)), F.element_at(words, -1))).otherwise(F.get(words, F.lit(0)))


def title_pt(s: Column) -> Column:
    """initial capitals, connectives in lower case but for the first word."""
    words = F.split(F.lower(F.trim(F.regexp_replace(s, r"\s+", " "))), " ")
    return F.array_join(F.transform(words, lambda w, i: F.when((i > 0) & w.isin(CONNECTIVES), w).otherwise(F.concat(F.upper(w.substr(1, 1)), w.substr(F.lit(2), F.length(w))))), " ")


def money_br(s: Column, blank_zero: bool = True) -> Column:
    """'1.234,56' and '1234.56' as decimal: points are thousands marks only where a comma stands. Blank is 0 if asked, nonsense is null."""
    t = F.regexp_replace(F.trim(s), r"^R\$\s*", "")
    plain = F.when(F.contains(t, F.lit(",")), F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(t)
    value = plain.try_cast("decimal(18,2)")
    return F.when(F.coalesce(t, F.lit("")) == "", F.lit(0 if blank_zero else None).cast("decimal(18,2)")).otherwise(value)


def cut_amount(v: Column) -> Column:
    """a cut coded as a negative number, as an amount."""
    return F.abs(v)


def date_br(s: Column) -> Column:
    """F16: dd/MM/yyyy, null if it is no date."""
    return F.try_to_date(F.regexp_extract(s, r"^\s*(\d{2}/\d{2}/\d{4})\s*$", 1), "dd/MM/yyyy")


def date_pt_long(s: Column) -> Column:
    """'3 de março de 2024' or a year alone (its first day)."""
    folded = {m.translate(str.maketrans(ACCENTED, PLAIN)): i + 1 for i, m in enumerate(MONTHS)}
    pattern, text = r"(\d{1,2})[ºo]?\s+de\s+([a-z]+)\s+de\s+(\d{4})", fold(s)
    month = F.element_at(_map(folded), F.regexp_extract(text, pattern, 2))
    long = F.try_to_date(F.format_string("%s-%02d-%02d", F.regexp_extract(text, pattern, 3), month, F.regexp_extract(text, pattern, 1).try_cast("int")), "yyyy-MM-dd")
    return F.coalesce(long, F.try_to_date(F.nullif(F.regexp_extract(text, r"^\s*(\d{4})\s*$", 1), F.lit("")), "yyyy"))


def partial_date(s: Column) -> tuple[Column, Column]:
    """(first day, precision) of YYYY, YYYY-MM and YYYY-MM-DD."""
    day = F.coalesce(F.try_to_date(s, "yyyy-MM-dd"), F.try_to_date(s, "yyyy-MM"), F.try_to_date(s, "yyyy"))
    precision = F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), "day").when(s.rlike(r"^\d{4}-\d{2}$"), "month").when(s.rlike(r"^\d{4}$"), "year")
    return F.when(precision.isNotNull(), day), precision


def week_start(d: Column) -> Column:
    """the week's Monday."""
    return F.date_trunc("week", d).cast("date")


def add_years(d: Column, n: int) -> Column:
    """the same day n years on; null for 29 February where that year has none."""
    out = F.add_months(d, 12 * n)
    return F.when(F.dayofmonth(out) == F.dayofmonth(d), out)


def age_at(birth: Column, at: Column) -> Column:
    """full years between partial dates; months and days count where both have them; null outside 20 to 95."""
    years = at.substr(1, 4).try_cast("int") - birth.substr(1, 4).try_cast("int")
    known = (F.length(birth) >= 7) & (F.length(at) >= 7)
    n = F.least(F.length(birth), F.length(at)) - 5
    early = known & (at.substr(F.lit(6), n) < birth.substr(F.lit(6), n))
    age = years - F.when(early, 1).otherwise(0)
    return F.when(age.between(20, 95), age)


def days_since(d: Column, as_of) -> Column:
    """F22."""
    return F.datediff(F.lit(as_of), d)


def year_elapsed(d: Column) -> Column:
    """months gone and days / 30 as a share of the year's months."""
    return (F.month(d) - 1 + F.dayofmonth(d) / 30) / 12


def month_seconds(month: Column) -> Column:
    """F24."""
    return F.dayofmonth(F.last_day(month)) * 86400


def digits(s: Column) -> Column:
    """F25."""
    return F.regexp_replace(s, r"\D", "")


def cnpj(s: Column) -> Column:
    """the 14 digits of a company number, else null."""
    return F.when(F.length(digits(s)) == 14, digits(s))


def redact(s: Column) -> Column:
    """person and company numbers, e-mail addresses and telephone numbers taken out of free text."""
    out = F.regexp_replace(s, r"\b\d{2}\.?\d{3}\.?\d{3}/?\d{4}-?\d{2}\b", "[cnpj]")
    out = F.regexp_replace(out, r"\b\d{3}\.?\d{3}\.?\d{3}-?\d{2}\b", "[cpf]")
    out = F.regexp_replace(out, r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+", "[email]")
    return F.regexp_replace(out, r"\(?\b\d{2}\)?\s?9?\d{4}-?\d{4}\b", "[phone]")


def uf_from_name(s: Column) -> Column:
    """F27."""
    return F.element_at(_map(STATES), norm_alpha(s))


def uf_from_code(code: Column) -> Column:
    """the state that a municipality code's first two digits name."""
    return F.element_at(_map(STATE_CODES), code.substr(1, 2))


def class_by_rules(s: Column, exact: dict[str, str], prefixes: dict[str, str], other: str = "other") -> Column:
    """class by exact value, then by beginning, in order."""
    out = F.element_at(_map(exact), s) if exact else F.lit(None)
    for p, c in prefixes.items():
        out = F.coalesce(out, F.when(F.startswith(s, F.lit(p)), F.lit(c)))
    return F.coalesce(out, F.lit(other))


def class_by_patterns(s: Column, ladder: list[tuple[str, str]], other: str | None = "other") -> Column:
    """Class of the first pattern, in order, that the folded text has."""
    text = fold(s)
    return F.coalesce(*[F.when(text.rlike(p), F.lit(c)) for p, c in ladder], F.lit(other))


# Ladders of patterns for penalties, outcomes and event titles, markers of interests, and the values of decisions.
PENALTIES = [("advert", "warning"), ("multa", "fine"), ("impediment|suspens", "suspension"), ("declara|inidon", "debarment"), ("rescis", "rescission")]
OUTCOMES = [("arquiv", "shelved"), ("aprovad|sancionad|promulgad", "approved"), ("rejeitad|vetad", "rejected"), ("retirad", "withdrawn")]
#: Words of event titles, folded, in the order in which the published rules list them: their order decides nothing inside a class, the classes' order does.
EVENT_WORDS = {
    "trip": ["partida", "chegada", "embarque", "desembarque", "viagem", "retorno", "deslocamento", "decolagem", "pouso"],
    "hearing": ["audiencia", "recebe "],
    "meeting": ["reuniao", "encontro", "despacho", "conversa", "almoco", "jantar", "cafe da manha", "videoconferencia", "telefonema", "ligacao"],
    "event": [
        "cerimonia", "solenidade", "evento", "lancamento", "posse", "entrevista", "sessao", "abertura", "visita", "pronunciamento", "discurso", "participa", "assinatura",
        "anuncio", "entrega", "inaugura", "comemora", "homenagem", "cupula", "assembleia", "conferencia", "seminario", "programa", "gravacao",
    ],
}
#: A trip's word begins the title; the others stand anywhere.
EVENTS = [("|".join(rf"^\s*{w}" if kind == "trip" else w for w in words), kind) for kind, words in EVENT_WORDS.items()]
#: Marks of an entity's name, as patterns over folded text, in the order of the published rules.
MARKER_WORDS = {
    "public": [
        r"\bminister", "secretari", "prefeitur", "municip", "estadual", "governo", "camara municipal", "assembleia", "tribunal", "universidade federal", "instituto federal",
        "fundacao universidade", "agencia nacional", "conselho nacional", r"\buniao\b", r"\bfederal\b", "embaixada", "consulado", "procuradoria", "defensoria", "policia", "hospital universitario",
    ],
    "law firm": [r"\badvogados?\b", r"\badvocacia\b"],
    "sector": [r"\bassociacao\b", r"\bfederacao\b", r"\bconfederacao\b", r"\bsindicato\b", r"\bsindicatos\b"],
    "company": [r"\bltda\b", r"\bs[ ./]a\b", r"\beireli\b", r"\bepp\b", r"\bmei\b", r"\bsa\b$"],
}
MARKERS = [("|".join(words), kind) for kind, words in MARKER_WORDS.items()]
NATURES = {
    "acesso concedido": "granted", "acesso negado": "denied", "acesso parcialmente concedido": "partial", "informacao inexistente": "nonexistent",
    "orgao nao tem competencia para responder sobre o assunto": "not competent", "nao se trata de solicitacao de informacao": "not a request", "pergunta duplicada repetida": "duplicate",
}
#: Elements that HTML's rendering rules lay out as blocks, list items or parts of tables, and the line break.
BLOCKS = [
    "address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "listing", "main", "menu", "nav", "ol", "optgroup", "option", "p", "plaintext", "pre", "search",
    "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul", "xmp",
]
#: Elements whose content is never shown as text.
HIDDEN = ["script", "style", "template", "noscript", "textarea", "svg"]


@F.pandas_udf(StringType())
def unescaped(s: pd.Series) -> pd.Series:
    """Named and numeric entities of HTML as their characters."""
    return s.map(html.unescape, na_action="ignore")


def interest_marker(s: Column, siglas: list[str]) -> Column:
    """F32: kind of interest that the words show, public bodies first; none where a body's sigla stands among them."""
    return F.when(~F.arrays_overlap(tokens(s), F.array(*[F.lit(x.lower()) for x in siglas])), class_by_patterns(s, MARKERS, None))


def bars_contracting(category: Column) -> Column:
    """fines and warnings do not bar."""
    return F.coalesce(~fold(category).rlike("multa|advert"), F.lit(False))


def reaches_buyer(reach: Column, body: Column, buyer: Column) -> Column:
    """true for all bodies, the sanctioning body's own reach by comparison, null where unknown."""
    return F.when(reach == "all", F.lit(True)).when(reach == "sanctioning_body", body == buyer)


def abroad(destination: Column) -> Column:
    """no '/UF' in the text."""
    return ~destination.rlike(r"/[A-Z]{2}\b")


def value_in_text(s: Column) -> Column:
    """the first amount in reais."""
    return money_br(F.nullif(F.regexp_extract(s, r"R\$\s*([\d.]+(?:,\d{2})?)", 1), F.lit("")), blank_zero=False)


def decision_nature(s: Column) -> Column:
    """F37."""
    return F.coalesce(F.element_at(_map(NATURES), norm_alpha(s)), F.lit("other"))


def hash_id(*parts: Column, n: int = 8) -> Column:
    """stable id of the parts."""
    return F.substring(F.sha1(F.concat_ws("|", *parts)), 1, n)


def html_lines(page: Column) -> Column:
    """the text lines of a page: what its blocks hold, without other tags, entities as their characters, any run of blanks as one space.

    Hidden elements and comments are cut, dashes become hyphens, and marks of lists at a line's ends go. Pages without entities stay in the JVM.
    """
    shown = F.regexp_replace(page, rf"(?is)<({'|'.join(HIDDEN)})\b.*?</\1\s*>|<!--.*?-->", "")
    blocks = F.split(shown, rf"(?i)</?(?:{'|'.join(BLOCKS)})(?=[\s/>])[^>]*>|[\r\n]+")
    text = F.array_join(F.transform(blocks, lambda x: F.regexp_replace(x, "<[^>]*>", " ")), "\n")
    entity = page.contains("&")  # of the page as given, not of what all these steps would have to make twice
    text = F.when(entity, unescaped(F.when(entity, text))).otherwise(text)
    blank, mark = r"[\s\p{Z}\p{Cf}\x{3164}]", r"[\s\p{Sm}\p{So}\x{2022}\x{b7}*]"
    clean = lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(x, f"{blank}+", " "), r"[\p{Pd}\x{2212}]", "-"), f"^{mark}+|{mark}+$", "")
    return F.filter(F.transform(F.split(text, "\n"), clean), lambda x: x != "")


def veto_subject(s: Column, most: int = 110) -> Column:
    """what follows the first ' que "', cut at `most` characters."""
    rest = F.nullif(F.regexp_extract(s, '(?s) que ["“](.*)', 1), F.lit(""))
    return F.when(F.length(rest) > most, F.concat(F.rtrim(rest.substr(1, most)), F.lit("…"))).otherwise(rest)


def money_label(v: Column) -> Column:
    """R$ 1,2 bi / mi / mil."""
    scaled = lambda d, unit: F.concat(F.lit("R$ "), F.replace(F.format_string("%.1f", v.cast("double") / d), F.lit("."), F.lit(",")), F.lit(unit))
    return F.when(F.abs(v) >= 1e9, scaled(1e9, " bi")).when(F.abs(v) >= 1e6, scaled(1e6, " mi")).when(F.abs(v) >= 1e3, scaled(1e3, " mil")).otherwise(scaled(1, ""))


def pct(num: Column, den: Column, places: int = 1) -> Column:
    """guarded share in per cent, halves to even."""
    return F.bround(F.try_divide(num.cast("double") * 100, den.cast("double")), places)
