"""Walks over a gazette's clauses and a page's lines (X9, X13): what a clause or line means depends on those around it."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lupaspark.functions import columns as C

# The verbs of acts, what makes an act void, the kinds of organ, and words that no person's name has.
VERBS = ["nomear", "exonerar", "designar", "dispensar"]
VOID = "tornar sem efeito"
ORGANS = ["ministerio", "secretaria", "departamento", "instituto", "agencia", "fundacao", "universidade", "comando", "gabinete", "superintendencia", "conselho", "presidencia"]
NO_NAME = [*ORGANS, "diretoria", "comissao", "cargo", "funcao", "processo", "portaria", "decreto", "matricula"]

_FOLD = str.maketrans(C.ACCENTED, C.PLAIN)
_VERB = re.compile(rf"\b({'|'.join(VERBS)}|{VOID})\b")
_BREAK = re.compile(rf"(?<!\bdr)(?<!\bsr)(?<!\bdra)(?<!\bsra)(?<!\bart)(?<!\bn)([.])(?=\s|$)|([;:,])|\s(?=e\s+(?:{'|'.join(VERBS)})\b)|\s(?=(?:{'|'.join(VERBS)}|{VOID})\b)")
_DATE = re.compile(r"\ba (?:partir|contar) de (\d{1,2}[ºo]? de [a-z]+ de \d{4})")
_POST = re.compile(r"(?:\bpara\s+)?(?:(?:exercer(?:em)?|ocupar(?:em)?)\s+)?(?:\b(?:[oa]s?|d[oa]s?|n[oa]s?)\s+)?(?:\b(mesm|referid)[oa]s?\s+)?\b(?:cargos?|funcao|funcoes)\b((?:\s+(?:em comissao|comissionad[oa]s?|de confianca|efetiv[oa]s?))*)(?:\s+de\s+(.+))?")
_ORGAN = re.compile(rf"(?:^|\s)d[aeo]s?\s+((?:{'|'.join(ORGANS)})\b.*)")
_TITLES = re.compile(r"^(?:(?:e|[oa]s?|[ivx]+|\d+|[a-z])\s*[-–)]\s*|(?:e|[oa]s?)\s+|(?:senhora?|doutora?|dra?\.?|sra?\.?|servidora?|professora?|general|almirante|brigadeiro)\s+)+")
_ALL = re.compile(r"\b(?:ambos|ambas|todos|todas)\b")


def folded(s: str) -> str:
    """Lower case without accents, a character for each."""
    return "".join(c if len(c) == 1 else c[0] for c in map(str.lower, s)).translate(_FOLD)


def person_name(s: str) -> str | None:
    """The name, less titles, if all its strong words begin with capitals, it has two to nine words and none of an office."""
    s = s.strip(" ,:;-")
    s = s[_TITLES.match(folded(s)).end() :] if _TITLES.match(folded(s)) else s
    words = s.split()
    plain = [folded(w) for w in words]
    strong = [w for w, p in zip(words, plain) if p not in C.CONNECTIVES]
    fits = 2 <= len(words) <= 9 and len(strong) >= 2 and all(re.fullmatch(r"[a-z'.-]+", p) for p in plain) and all(w[0].isupper() for w in strong)
    return s if fits and not set(plain) & set(NO_NAME) else None


@dataclass
class Walk:
    """State of one text: what verb, date and organ hold now, names that still lack a post, and the events so far."""

    verb: str | None = None
    date: str | None = None
    pending: list[str] = field(default_factory=list)
    held: list[str] = field(default_factory=list)
    batch: list[dict] = field(default_factory=list)
    last_post: tuple[str | None, str | None] = (None, None)
    refused: bool = False
    events: list[dict] = field(default_factory=list)

    def emit(self, names: list[str], post: str | None, organ: str | None, reason: str | None) -> None:
        self.batch = [{"verb": self.verb, "name": n, "since": self.date, "post": post, "organ": organ, "reason": reason} for n in names]
        self.events += self.batch

    def release(self) -> None:
        """Names whose post did not come."""
        waiting, self.pending = self.pending, []
        self.held += waiting

    def close(self) -> None:
        self.release()
        if self.held:
            self.emit(self.held, None, None, "no post")
        self.held, self.batch, self.refused = [], [], False

    def take_names(self, text: str) -> None:
        if self.verb is None or self.refused or not text.strip(" ,:;-"):
            return
        parts = re.split(r"\s+e\s+", text)
        names = [person_name(p) for p in parts]
        if all(names):
            self.pending += names
        elif person_name(text):
            self.pending.append(person_name(text))
        elif not self.pending and not self.batch and text.strip(" ,:;-")[:1].isupper() and not re.search(r"\d", text):
            self.refused = True  # it looks like a name and is none: the act is not guessed at
            self.emit([text.strip(" ,:;-")], None, None, "unclear name")

    def take_post(self, same: str | None, post: str | None) -> None:
        organ = None
        if post and (m := _ORGAN.search(folded(post))):
            post, organ = post[: m.start()], post[m.start(1) :].strip(" ,.")
        post, organ = self.last_post if same else ((post or "").strip(" ,.") or None, organ)
        names, self.pending = self.pending, []
        if names and post:
            self.last_post = post, organ
            self.emit(names, post, organ, None)

    def clause(self, text: str) -> None:
        plain = folded(text)
        if m := _VERB.search(plain):
            self.close()
            self.verb, self.date = (None if m[1] == VOID else m[1]), None
            text, plain = text[m.end() :], plain[m.end() :]
        if m := _DATE.search(plain):
            self.date = plain[m.start(1) : m.end(1)]
            text, plain = text[: m.start()] + text[m.end() :], plain[: m.start()] + plain[m.end() :]
        if plain.strip() == "respectivamente":
            self.share_out()
        elif m := _POST.search(plain):
            if _ALL.search(plain[: m.start()]):
                self.pending, self.held = self.held + self.pending, []
            else:
                self.take_names(text[: m.start()])
            self.take_post(m[1], text[m.start(3) : m.end(3)] if m[3] else None)
        elif (m := _ORGAN.match(plain)) and self.batch:
            organ = text[m.start(1) :].strip(" ,.")
            for e in self.batch:
                e["organ"] = e["organ"] or organ
            self.last_post = self.last_post[0], self.last_post[1] or organ
        elif not self.pending or person_name(text) or re.search(r"\be\b", plain):
            self.take_names(text)

    def share_out(self) -> None:
        """'A and B, to the posts of x and y, respectively'."""
        posts = re.split(r"\s+e\s+", self.batch[0]["post"] or "") if self.batch else []
        for i, e in enumerate(self.batch):
            fits = len(posts) == len(self.batch)
            e["post"], e["reason"] = (posts[i], None) if fits else (None, "posts do not fit")


def walk(text: str) -> list[dict]:
    """Events of one text: its clauses in order, each read in the state that those before it left."""
    text = re.sub(r"\s+", " ", text)
    state, at = Walk(), 0
    for m in [*_BREAK.finditer(folded(text)), None]:
        stop = m.start() if m else len(text)
        state.clause(text[at:stop])
        at = m.end() if m else stop
        if m and m[2] == ";":
            state.release()
        if m and m[1]:
            state.close()
            state.verb = state.date = None
    state.close()
    return state.events


def walk_acts(texts: DataFrame) -> DataFrame:
    """(doc_id, act_no, verb, name, since, post, organ, reason) of every person that a text names after a verb.

    Clauses are read in order: a verb, its date and the organ hold for all names that follow, up to the next verb or the sentence's end; names wait for a post that comes in a later
    clause; 'e' joins people as well as acts; 'o mesmo cargo' is the last post, 'ambos' takes up names of earlier items, 'respectivamente' deals posts out. An
    event with a reason is a refusal: no post came, the posts do not fit the names, or what stands in a name's place is none. texts(doc_id, text); null texts have none.
    """
    kind = dict(texts.dtypes)["doc_id"]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            found = [(i, n, *e.values()) for i, t in enumerate(b.column(1).to_pylist()) for n, e in enumerate(walk(t or ""))]
            columns = list(zip(*found)) or [()] * 8
            yield pa.record_batch([b.column(0).take(pa.array(columns[0], pa.int64())), pa.array(columns[1], pa.int32()), *[pa.array(c, pa.string()) for c in columns[2:]]], names=["doc_id", "act_no", "verb", "name", "since", "post", "organ", "reason"])

    rows = texts.select("doc_id", F.col("text").cast("string")).mapInArrow(batches, f"doc_id {kind}, act_no int, verb string, name string, since string, post string, organ string, reason string")
    return rows.withColumn("since", C.date_pt_long(F.col("since")))


_SIDES = (("public", re.compile(r"agentes? publicos?")), ("private", re.compile(r"agentes? privados?|particulares")))


def sides(lines: list[str]) -> Iterator[tuple[str, str, str | None, str | None]]:
    """X11: (side, name, role, entity) of the lines below one that names a side: 'Name (role) - entity'."""
    side = None
    for line in lines:
        named = next((s for s, p in _SIDES if p.search(folded(line))), None)
        if named:
            side = named
        elif side:
            role = re.search(r"\(([^)]*)\)", line)
            entity = re.search(r"[-–]\s*(.+)$", line)
            yield side, re.match(r"[^(\-–]*", line)[0].strip(), role[1] if role and role[1] else None, entity[1].strip() if entity else None


_LABELS = "diretor|secretari|president|chefe|coordenador|reitor|superintendent"
#: Words of lines that end a section, and of former holders.
_STOP = "galeria|ex-|antig|noticia|agenda|contato|telefone|endereco"


def assigned(lines: list[str], label: re.Pattern, stop: re.Pattern, reach: int) -> list[tuple[int, int]]:
    """(line of the label, line of its name): labels and names of one stretch between stop lines, nearest first, each used once.

    Pages put names before or after their labels, most of the time alike: at equal distance the page's commoner side wins, then the earlier label.
    """
    kinds, stretch, part = [], [], 0
    for x in lines:
        plain = folded(x)
        name = person_name(x) if not label.search(plain) else None
        kind = "stop" if stop.search(plain) else "label" if label.search(plain) and len(x) <= 90 else "name" if name else ""
        part += kind == "stop"
        kinds.append(kind)
        stretch.append(part)
    pairs = [(i, j) for i, k in enumerate(kinds) if k == "label" for j in range(max(0, i - reach), min(len(lines), i + reach + 1)) if kinds[j] == "name" and stretch[i] == stretch[j]]
    near = [j - i for i, j in pairs if abs(j - i) == 1]
    side = 1 if sum(d > 0 for d in near) >= sum(d < 0 for d in near) else -1
    pairs.sort(key=lambda p: (abs(p[1] - p[0]), (p[1] - p[0]) * side < 0, p[0]))
    labels, names, out = set(), set(), []
    for i, j in pairs:
        if i not in labels and j not in names:
            labels.add(i)
            names.add(j)
            out.append((i, j))
    return sorted(out)


def page_heads(pages: DataFrame, labels: str = _LABELS, stop: str = _STOP, reach: int = 3) -> DataFrame:
    """(page_id, line_no, unit, name, acting): the offices that a page's lines name and who holds them.

    A label's name is the nearest one within `reach` lines either way that no nearer label takes and no stop line (another section, former holders)
    parts from it; 'unit' is the label's line. Labels without a name are left out. pages(page_id, html).
    """
    kind = dict(pages.dtypes)["page_id"]
    label_rx, stop_rx = re.compile(labels), re.compile(stop)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            found = [(r, i, lines[i], lines[j]) for r, lines in enumerate(b.column(1).to_pylist()) for i, j in assigned(lines or [], label_rx, stop_rx, reach)]
            columns = list(zip(*found)) or [()] * 4
            yield pa.record_batch([b.column(0).take(pa.array(columns[0], pa.int64())), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.string())], names=["page_id", "line_no", "unit", "name"])

    rows = pages.select("page_id", C.html_lines(F.col("html")).alias("lines")).mapInArrow(batches, f"page_id {kind}, line_no int, unit string, name string")
    return rows.withColumn("acting", C.fold(F.col("unit")).rlike("substitut|interin|em exercicio"))
