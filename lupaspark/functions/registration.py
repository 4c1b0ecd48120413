"""The library's functions by name, for SQL texts: `register(spark)` once a session."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from lupaspark.functions import columns as C

#: Column helpers that are plain expressions: name, parameters, expression of the parameters' columns.
PLAIN: dict[str, tuple[str, Callable[..., Column]]] = {
    "fold": ("x STRING", C.fold),
    "norm_alpha": ("x STRING", C.norm_alpha),
    "norm_alnum": ("x STRING", C.norm_alnum),
    "slug": ("x STRING", C.slug),
    "strip_legal_form": ("x STRING", C.strip_legal_form),
    "money_br": ("x STRING", C.money_br),
    "date_br": ("x STRING", C.date_br),
    "date_pt_long": ("x STRING", C.date_pt_long),
    "week_start": ("x DATE", C.week_start),
    "digits_of": ("x STRING", C.digits),
    "cnpj": ("x STRING", C.cnpj),
    "redact": ("x STRING", C.redact),
    "uf_from_name": ("x STRING", C.uf_from_name),
    "uf_from_code": ("x STRING", C.uf_from_code),
    "abroad": ("x STRING", C.abroad),
    "value_in_text": ("x STRING", C.value_in_text),
    "decision_nature": ("x STRING", C.decision_nature),
    "event_class": ("x STRING", lambda x: C.class_by_patterns(x, C.EVENTS)),
    "penalty_class": ("x STRING", lambda x: C.class_by_patterns(x, C.PENALTIES)),
    "outcome_class": ("x STRING", lambda x: C.class_by_patterns(x, C.OUTCOMES)),
}


def _list(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


#: Helpers over arrays of words, as SQL over those above; each builds on the ones before it.
WORDS: dict[str, tuple[str, str]] = {
    "words_of": ("x STRING", "filter(split(norm_alnum(x), ' '), t -> t <> '')"),
    "strong_words": ("x STRING", f"filter(words_of(x), t -> t NOT IN ({_list(C.CONNECTIVES)}))"),
    "core_name": ("x STRING", f"array_join(filter(words_of(regexp_replace(x, '(?<=\\\\w)-(?=\\\\w)', '')), t -> t NOT IN ({_list(C.CONNECTIVES)})), ' ')"),
    "name_key_full": ("x STRING", "array_join(strong_words(x), ' ')"),
    "name_key_base": ("x STRING", f"regexp_replace(name_key_full(x), '(?<=\\\\S)( ({'|'.join(C.NAME_SUFFIXES)}))+$', '')"),
    "word_jaccard": ("x STRING, y STRING", "try_divide(CAST(size(array_intersect(words_of(x), words_of(y))) AS DOUBLE), CAST(size(array_union(words_of(x), words_of(y))) AS DOUBLE))"),
}


class ActsOf:
    """parse_acts(text): a row for each person that a gazette text names after a verb."""

    def eval(self, text: str) -> Iterator[tuple]:
        from lupaspark.operators.gazette import walk

        for n, e in enumerate(walk(text or "")):
            yield (n, *e.values())


class ParticipantsOf:
    """participants(lines): a row for each person below a line that names a side (X11)."""

    def eval(self, lines: list) -> Iterator[tuple]:
        from lupaspark.operators.gazette import sides

        yield from sides(lines or [])


#: Table functions: name, class, columns.
TABLES = {
    "parse_acts": (ActsOf, "act_no int, verb string, name string, since string, post string, organ string, reason string"),
    "participants": (ParticipantsOf, "side string, name string, role string, entity string"),
}


def register(spark: SparkSession) -> list[str]:
    """Registers all as temporary functions of the session and gives their names.

    Helpers become SQL functions, which the optimizer puts in place of their calls: they stay in the JVM. Table functions run in Python over Arrow batches, on the executors; use them as
    `FROM texts, LATERAL parse_acts(text)`. html_unescape is a pandas function. A name that exists is replaced.
    """
    from lupaspark.session import ship

    ship(spark)
    for name, (params, build) in PLAIN.items():
        given = [p.split() for p in params.split(", ")]
        frame = spark.range(0).select(*[F.lit(None).cast(kind).alias(p) for p, kind in given])
        made = frame.select(build(*[F.col(p) for p, _ in given]).alias("y"))
        body = made._jdf.queryExecution().analyzed().expressions().head().child().sql()
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURN {body}")
    for name, (params, body) in WORDS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURN {body}")
    spark.udf.register("html_unescape", C.unescaped)
    for name, (kind, columns) in TABLES.items():
        spark.udtf.register(name, F.udtf(kind, returnType=columns, useArrow=True))
    return [*PLAIN, *WORDS, "html_unescape", *TABLES]
