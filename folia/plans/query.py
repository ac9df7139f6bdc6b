"""The query language: a pure parser from a string to a SearchQuery.

Record level (whole documents): several words, AND of OR-groups, NEAR(words, n). Paragraph level:
everything else - a single word, phrases (also as `a + b`), OR, NOT, prefixes, `^first`, columns
(`title:`, `{content title}:`), and NEAR(words) without a distance, ten words inside a paragraph.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from folia.functions.text import token_words

# Function words that a distance query leaves out.
NEAR_STOPWORDS = frozenset(
    (
        "a an the and or but nor i you he she it we they me him her us them my your his its our their mine yours hers ours theirs "
        "this that these those which who whom whose am is are was were do does did have has had "
        "of in on at to for with by from into onto about as "
        "का की के को में से पर ने तक और या कि एवं तथा है हैं हूँ हो था थे थी मैं मुझे मेरा तू तुम तुम्हें आप यह ये वह वो वे हम इस उस जो भी ही"
    ).split()
)
APOSTROPHES = "'‘’"
_TOKEN = re.compile(r'"[^"]*"|\(|\)|[^\s()"]+')


class QuerySyntaxError(ValueError):
    """Invalid search syntax."""


@dataclass(frozen=True)
class Term:
    """A word, a prefix, or (several words) a phrase."""

    words: tuple[str, ...]
    prefix: bool = False
    field: str = "content"
    first: bool = False  # stands at the column's beginning


@dataclass(frozen=True)
class Node:
    """op: term, and, or, not (first without the second)."""

    op: str
    parts: tuple = ()
    term: Term | None = None


@dataclass(frozen=True)
class SearchQuery:
    level: str  # record, near, paragraph
    groups: tuple[tuple[Term, ...], ...] = ()
    distance: int | None = None
    tree: Node | None = None
    phrase_only: bool = False
    terms: tuple[Term, ...] = field(default=())


LONGEST, NATIVE_DISTANCE = 500, 10
_COLUMNS = {"content": "content", "title": "title", "title_search": "title"}


def _term(raw: str, where: str = "content", bare: bool = True) -> Term:
    first = bare and raw.startswith("^")
    prefix = raw.endswith("*")
    words = token_words(raw.strip('"*^'))
    if not words:
        raise QuerySyntaxError(f"nothing to search for in {raw!r}")
    return Term(words, prefix, where, first)


def _clean(text: str) -> str:
    """Possessives and apostrophes, outside of phrases."""
    out = []
    for part in re.split(r'("[^"]*")', text):
        if not part.startswith('"'):
            part = re.sub(rf"[{APOSTROPHES}]s\b", "", part)
            part = re.sub(rf"[{APOSTROPHES}]", " ", part)
        out.append(part)
    return "".join(out).strip()


def parse(text: str, analyse: Callable[[str], str] | None = None) -> SearchQuery:
    """analyse: the form of a word in the index that is searched; as it is if None."""
    if len(text or "") > LONGEST:
        raise QuerySyntaxError(f"a query has at most {LONGEST} characters")
    found = _parse(text)
    return _mapped(found, lambda t: replace(t, words=tuple(map(analyse, t.words)))) if analyse else found


def _mapped(q: SearchQuery, f: Callable[[Term], Term]) -> SearchQuery:
    node = lambda n: Node(n.op, tuple(map(node, n.parts)), f(n.term) if n.term else None)
    return replace(q, groups=tuple(tuple(map(f, g)) for g in q.groups), tree=node(q.tree) if q.tree else None, terms=tuple(map(f, q.terms)))


def _near(text: str) -> SearchQuery | None:
    m = re.match(r"(?is)^NEAR\s*\(\s*([^(),]+?)\s*(?:,\s*(\d+)\s*)?\)\s*$", text)
    if not m:
        return None
    words = [w for w in m[1].replace('"', " ").split() if w != "AND"]
    content = [w for w in words if unicodedata.normalize("NFC", w.lower()) not in NEAR_STOPWORDS]
    words = content if len(content) >= 2 else words
    if len(words) < 2:
        return _parse(" ".join(words))
    groups = tuple((_term(w),) for w in words)
    return SearchQuery("near" if m[2] else "paragraph_near", groups, int(m[2] or NATIVE_DISTANCE), terms=tuple(t for g in groups for t in g))


def _parse(text: str) -> SearchQuery:
    text = _clean(text or "")
    if not text:
        raise QuerySyntaxError("empty query")
    if text.count('"') % 2:
        raise QuerySyntaxError("unclosed quotation mark")
    if near := _near(text):
        return near
    groups = _units(text)
    if groups:
        return SearchQuery("record", groups, terms=tuple(t for g in groups for t in g))
    tree = _Parser(text).tree()
    return SearchQuery("paragraph", tree=tree, phrase_only=re.match(r'^\s*"[^"]+"\s*$', text) is not None, terms=tuple(_terms(tree)))


def _terms(n: Node):
    if n.op == "term":
        yield n.term
    for p in n.parts:
        yield from _terms(p)


def _units(text: str) -> tuple[tuple[Term, ...], ...] | None:
    """OR-groups that must all occur in a document; None where the paragraph level is meant."""
    if '"' in text or re.search(r"[:+^{]", text):
        return None
    if re.search(r"\bAND\b", text):
        parts = [p.strip() for p in re.split(r"\bAND\b", text)]
        groups = []
        for p in parts:
            inner = re.sub(r"^\((.*)\)$", r"\1", p)
            if not p or "(" in inner or ")" in inner or re.search(r"\b(NOT|NEAR)\b", inner):
                return None
            words = [w.strip() for w in re.split(r"\bOR\b", inner)]
            if not all(words) or any(" " in w for w in words):
                return None
            groups.append(tuple(_term(w) for w in words))
        return tuple(groups) if len(groups) > 1 else None
    if re.search(r"[()]|\b(OR|NOT|NEAR)\b", text):
        return None
    words = text.split()
    return tuple((_term(w),) for w in words) if len(words) > 1 else None


class _Parser:
    """NOT binds tighter than AND (also unwritten), AND tighter than OR; operators in capitals."""

    def __init__(self, text: str):
        text = re.sub(r"\{([^}]*)\}\s*:\s*", lambda m: "|".join(m[1].split()) + ":", text)
        text = re.sub(r"(?i)(?<![\w|])([a-z_]+(?:\|[a-z_]+)*)\s*:\s*(?=\S)", lambda m: f" {m[1].lower()}: ", text)
        self.items = _TOKEN.findall(re.sub(r"\s*\+\s*(?=([^\"]*\"[^\"]*\")*[^\"]*$)", " + ", text))
        self.at = 0

    def tree(self) -> Node:
        out = self._or()
        if self.at < len(self.items):
            raise QuerySyntaxError(f"unexpected {self.items[self.at]!r}")
        return out

    def _peek(self) -> str | None:
        return self.items[self.at] if self.at < len(self.items) else None

    def _or(self) -> Node:
        parts = [self._and()]
        while self._peek() == "OR":
            self.at += 1
            parts.append(self._and())
        return parts[0] if len(parts) == 1 else Node("or", tuple(parts))

    def _and(self) -> Node:
        parts = [self._not()]
        while (p := self._peek()) not in (None, ")", "OR"):
            if p == "AND":
                self.at += 1
            elif p == "(" or self.items[self.at - 1] == ")":
                raise QuerySyntaxError("a group needs AND, OR or NOT beside it")
            parts.append(self._not())
        return parts[0] if len(parts) == 1 else Node("and", tuple(parts))

    def _not(self) -> Node:
        left = self._atom()
        while self._peek() == "NOT":
            self.at += 1
            left = Node("not", (left, self._atom()))
        return left

    def _atom(self) -> Node:
        p = self._peek()
        if p is None or p in (")", "AND", "OR", "NOT", "+"):
            raise QuerySyntaxError("a word is missing")
        self.at += 1
        if p.endswith(":") and p != ":" and not p.startswith('"'):
            columns = p[:-1].split("|")
            if not set(columns) <= set(_COLUMNS):
                raise QuerySyntaxError(f"no such column in {p!r}")
            return self._in_columns(self._atom(), sorted({_COLUMNS[c] for c in columns}))
        if p == "(":
            inner = self._or()
            if self._peek() != ")":
                raise QuerySyntaxError("unclosed bracket")
            self.at += 1
            return inner
        term = _term(p, bare=not p.startswith('"'))
        while self._peek() == "+":
            self.at += 1
            more = self._peek()
            if more is None or more in (")", "AND", "OR", "NOT", "+"):
                raise QuerySyntaxError("a word is missing after +")
            self.at += 1
            next_ = _term(more)
            term = replace(term, words=term.words + next_.words, prefix=next_.prefix)
        return Node("term", term=term)

    def _in_columns(self, node: Node, columns: list[str]) -> Node:
        if node.op != "term":
            return Node(node.op, tuple(self._in_columns(p, columns) for p in node.parts))
        parts = tuple(Node("term", term=replace(node.term, field=c)) for c in columns)
        return parts[0] if len(parts) == 1 else Node("or", parts)
