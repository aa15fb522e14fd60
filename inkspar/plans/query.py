"""The search language: text -> syntax tree -> DataFrame plan.

Terms, AND (a space), `or`, `not x` or ` -x`, quoted and hyphenated phrases.  `or` binds tightest, then AND, then the
complement, which subtracts from all that comes before it.  A query that holds nothing but stop words is a stop query:
compile() gives None.  Stop words drop out of an AND, are blanks in a phrase, and make an OR or a complement a stop query.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Union

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import fix_cjk, is_stop_word_py
from ..operators import algebra


@dataclass(frozen=True)
class Term:
    word: str


@dataclass(frozen=True)
class Phrase:
    words: tuple[tuple[str, int], ...]  # word, offset


@dataclass(frozen=True)
class And:
    parts: tuple[Node, ...]


@dataclass(frozen=True)
class Or:
    parts: tuple[Node, ...]


@dataclass(frozen=True)
class Not:
    left: Node
    minus: Node


Node = Union[Term, Phrase, And, Or, Not]


class QueryError(ValueError):
    pass


_PIECE = re.compile(r'"([^"]*)"|([^\s"]+)')


def phrase_of(pieces: list[str]) -> Node | None:
    """Stop words are blanks; blanks at the ends are cut, those inside advance the offset; one word alone is no phrase."""
    kept = [(w, k) for k, w in enumerate(pieces) if w and not is_stop_word_py(w)]
    if len(kept) < 2:
        return None
    first = kept[0][1]
    return Phrase(tuple((w, k - first) for w, k in kept))


def word_of(text: str) -> Node | None:
    if "-" in text.strip("-"):
        return phrase_of([p for p in text.split("-")])
    word = text.strip("-")
    return None if not word or is_stop_word_py(word) else Term(word)


def parse(query: str) -> Node | None:
    """The tree, or None for a stop query."""
    text = fix_cjk(query.lower().strip())
    if not text:
        raise QueryError("the query is blank")
    if text.count('"') % 2:
        at = text.rfind('"')
        text = text[:at] + text[at + 1 :]
    if not re.search(r'[\s"-]', text):
        return None if is_stop_word_py(text) else Term(text)
    whole = re.fullmatch(r'"([^"]*)"', text)
    if whole:
        return phrase_of(re.split(r"[\s-]+", whole[1].strip()))
    if re.fullmatch(r"[^\s\"-]+(?:-[^\s\"-]+)+", text):
        return phrase_of(text.split("-"))
    # tokens: operators and operands
    items: list[tuple[str, Node | None]] = []
    for m in _PIECE.finditer(text):
        raw, quoted = m[2], m[1]
        before = text[: m.start()]
        minus = before.endswith("-") and (len(before) == 1 or before[-2].isspace())
        if quoted is not None:
            if minus and items and items[-1] == ("word", None):
                items[-1] = ("not", None)
            items.append(("word", phrase_of(re.split(r"[\s-]+", quoted.strip())) if re.search(r"[\s-]", quoted.strip()) else word_of(quoted.strip())))
        elif raw == "or":
            items.append(("or", None))
        elif raw == "not":
            items.append(("not", None))
        elif raw == "-":
            items.append(("word", None))
        elif raw.startswith("-") and items:
            items += [("not", None), ("word", word_of(raw[1:]))]
        elif raw.startswith("-"):
            return None  # a complement of nothing
        else:
            items.append(("word", word_of(raw)))
    return _complement(items)


def _complement(items: list[tuple[str, Node | None]]) -> Node | None:
    """The first complement splits off; the rest of the query is what it subtracts from."""
    minus: list[Node | None] = []
    rest: list[tuple[str, Node | None]] = []
    k = 0
    while k < len(items):
        kind, node = items[k]
        if kind == "not":
            if k + 1 >= len(items) or items[k + 1][0] != "word":
                raise QueryError("nothing follows `not`")
            if rest and rest[-1][0] == "or":
                raise QueryError("`or not` has no meaning here")
            minus.append(items[k + 1][1])
            k += 2
            continue
        rest.append((kind, node))
        k += 1
    left = _conjunction(rest)
    if minus and (left is None or any(m is None for m in minus)):
        return None
    for m in minus:
        left = Not(left, m)
    return left


def _conjunction(items: list[tuple[str, Node | None]]) -> Node | None:
    groups: list[list[Node | None]] = []
    joined = False
    for kind, node in items:
        if kind == "or":
            if not groups:
                raise QueryError("nothing comes before `or`")
            joined = True
            continue
        if joined:
            groups[-1].append(node)
        else:
            groups.append([node])
        joined = False
    if joined:
        raise QueryError("nothing follows `or`")
    parts: list[Node] = []
    for g in groups:
        if len(g) > 1:
            if any(n is None for n in g):
                return None
            parts.append(Or(tuple(g)))
        elif g[0] is not None:
            parts.append(g[0])
    if not parts:
        return None
    return parts[0] if len(parts) == 1 else And(tuple(parts))


def show(node: Node | None) -> str:
    """A tree as text: (and a b), (or a b), (not a b), a phrase with the offsets of its words, `-` for a stop query."""
    if node is None:
        return "-"
    if isinstance(node, Term):
        return node.word
    if isinstance(node, Phrase):
        return '"' + " ".join(f"{w}+{k}" for w, k in node.words) + '"'
    if isinstance(node, Not):
        return f"(not {show(node.left)} {show(node.minus)})"
    return f"({'and' if isinstance(node, And) else 'or'} {' '.join(map(show, node.parts))})"


def terms_of(node: Node) -> set[str]:
    if isinstance(node, Term):
        return {node.word}
    if isinstance(node, Phrase):
        return {w for w, _ in node.words}
    if isinstance(node, Not):
        return terms_of(node.left) | terms_of(node.minus)
    return set().union(*map(terms_of, node.parts))


class MissingTerm(LookupError):
    pass


@dataclass
class Engine:
    """Searches one or several indexes by name: posting tables, or functions from a list of terms to their postings."""

    indexes: dict[str, DataFrame | Callable[[list[str]], DataFrame]]
    union_mode: str = "merge"
    on_missing: str = "empty"  # or "error"
    #: Plans by query and indexes; `forget` drops them when an index has changed.
    known: dict[tuple, DataFrame] = field(default_factory=dict)

    def compile(self, query: str, names: str | list[str] | None = None) -> DataFrame | None:
        """The plan, or None for a stop query.  Of several indexes those that cannot be read are left out, as long as one can."""
        chosen = self.resolve(names)
        node = parse(query)
        if node is None:
            return None
        memo = (query.strip().lower(), tuple(chosen))
        if memo not in self.known:
            self.known[memo] = self._plan(node, chosen[0], query) if len(chosen) == 1 else self._over(node, chosen, query)
        return self.known[memo]

    def _over(self, node: Node, chosen: list[str], query: str) -> DataFrame:
        plans, errors = [], []
        for name in chosen:
            try:
                plans.append(self._plan(node, name, query))
            except (LookupError, OSError, ValueError, PySparkException) as e:
                errors.append(e)
        if not plans:
            raise errors[0]
        return algebra.multi_index(plans, f"{query.strip().lower()}@{' '.join(chosen)}", self.union_mode)

    def forget(self) -> None:
        self.known.clear()

    search = compile

    def resolve(self, names: str | list[str] | None) -> list[str]:
        """Names cut at spaces and semicolons; a name that is not there is left out as long as another one is."""
        if names is None:
            names = list(self.indexes)
        if isinstance(names, str):
            names = [n for n in re.split(r"[ ;]", names) if n]
        if not names:
            raise QueryError("no index is given")
        found = [n for n in names if n in self.indexes]
        if not found or (len(names) == 1 and not found):
            raise QueryError(f"no such index: {' '.join(names)}")
        return list(dict.fromkeys(found))

    def _plan(self, node: Node, name: str, query: str) -> DataFrame:
        words = sorted(terms_of(node))
        # one scan for all terms of the query: the predicate reaches the files, which are sorted by term
        index = self.indexes[name]
        rows = index(words) if callable(index) else index.where(F.col("term").isin(words))
        scanned = algebra.from_postings(rows)
        if self.on_missing == "error":
            there = {r[0] for r in scanned.select("subj").distinct().collect()}
            if set(words) - there:
                raise MissingTerm(", ".join(sorted(set(words) - there)))
        known: dict[Node, DataFrame] = {}
        out = self._run(node, scanned, known)
        return out if isinstance(node, Not) else algebra.resubject(out, f"{query.strip().lower()}@{name}")

    def _run(self, node: Node, rows: DataFrame, known: dict[Node, DataFrame]) -> DataFrame:
        if node in known:
            return known[node]
        if isinstance(node, Term):
            out = rows.where(F.col("subj") == node.word)
        elif isinstance(node, Phrase):
            out = algebra.phrase([(self._run(Term(w), rows, known), k) for w, k in node.words])
        elif isinstance(node, And):
            out = algebra.intersect(*[self._run(p, rows, known) for p in node.parts])
        elif isinstance(node, Or):
            out = algebra.union(*[self._run(p, rows, known) for p in node.parts], mode=self.union_mode)
        else:
            out = algebra.exclude(self._run(node.left, rows, known), self._run(node.minus, rows, known))
        known[node] = out
        return out
