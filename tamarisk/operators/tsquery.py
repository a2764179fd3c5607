"""Boolean text queries: parse, prune, rewrite, render, and compile to a predicate.

A query is a tree of tuples-in-dataclasses that never changes once it is parsed;
pruning gives the set of operands to leave out, and rendering reads it.

Grammar, loosest first: ``|``, ``&``, phrase (``<->``, ``<N>``), ``!``; operands are
'quoted', with '' for a quote, and may carry ``:`` flags (``*`` for a prefix, or
weights). A phrase is one operand without a lexeme of its own.
"""

from __future__ import annotations

import logging
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

log = logging.getLogger(__name__)
_SCAN = re.compile(r"\s*(?:(?P<word>'(?:[^']|'')*'(?::[*A-Da-d]+)?)|(?P<near><(?:-|\d+)>)|(?P<sign>[()&|!]))")


class QuerySyntaxError(ValueError):
    pass


@dataclass(frozen=True)
class Term:
    """An operand as written; lexeme is None where no plain lexeme can be read from it."""

    text: str
    lexeme: str | None
    at: int
    parts: tuple = ()  # of a phrase: operand, distance, operand, ...


@dataclass(frozen=True)
class Not:
    of: object


@dataclass(frozen=True)
class Group:
    kind: str  # "and" | "or"
    of: tuple


def scan(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _SCAN.match(text, at)
        if not m:
            raise QuerySyntaxError(f"nothing readable at {at}: {text[at:at + 20]!r}")
        out.append((m.lastgroup, m.group(m.lastgroup)))
        at = m.end()
    return out


class _Reader:
    """Binding powers: | 1, & 2, phrase 3; ! binds tightest."""

    POWER = {"|": 1, "&": 2}

    def __init__(self, items: list[tuple[str, str]]) -> None:
        self.items, self.i, self.n = items, 0, 0

    def peek(self) -> tuple[str, str]:
        return self.items[self.i] if self.i < len(self.items) else ("end", "")

    def take(self) -> tuple[str, str]:
        item = self.peek()
        self.i += 1
        return item

    def operand(self):
        kind, text = self.take()
        if text == "!":
            return Not(self.operand())
        if text == "(":
            inner = self.expression(1)
            if self.take()[1] != ")":
                raise QuerySyntaxError("a bracket is not closed")
            return inner
        if kind != "word":
            raise QuerySyntaxError(f"an operand was expected, not {text or 'the end'!r}")
        self.n += 1
        body, _, flags = text.rpartition("':") if not text.endswith("'") else (text[:-1], "", "")
        return Term(text, None if flags else body[1:].replace("''", "'"), self.n)

    def expression(self, least: int):
        left = self.operand()
        while True:
            kind, text = self.peek()
            power = 3 if kind == "near" else self.POWER.get(text, 0)
            if power < least or not power:
                return left
            self.take()
            right = self.expression(power + 1)
            if kind == "near":
                left = self.phrase(left, text, right)
            else:
                name = "or" if text == "|" else "and"
                flat = left.of if isinstance(left, Group) and left.kind == name else (left,)
                left = Group(name, (*flat, right))

    def phrase(self, left, near: str, right) -> Term:
        self.n += 1
        gap = 1 if near == "<->" else int(near[1:-1])
        parts = left.parts if isinstance(left, Term) and left.parts else (left,)
        return Term(f"{_text(left)} {near} {_text(right)}", None, self.n, (*parts, gap, right))


def _text(node) -> str:
    if isinstance(node, Term):
        return node.text
    if isinstance(node, Not):
        return "!" + _text(node.of)
    return "( " + (" & " if node.kind == "and" else " | ").join(map(_text, node.of)) + " )"


def parse(text: str):
    """The tree of a rendered query; None if it is blank."""
    items = scan(text)
    if not items:
        return None
    r = _Reader(items)
    tree = r.expression(1)
    if r.peek()[0] != "end":
        raise QuerySyntaxError(f"nothing may follow here: {r.peek()[1]!r}")
    return tree


def positive_terms(node) -> list[Term]:
    """Operands in order, without what is negated; a phrase counts as one."""
    if isinstance(node, Term):
        return [node]
    if isinstance(node, Not):
        return []
    return [t for child in node.of for t in positive_terms(child)]


def terms_to_drop(terms: list[Term], common: Mapping[str, int], min_terms: int) -> set[int]:
    """Places of the terms to leave out: the common ones, but for as many of the rarest
    as it takes to keep min_terms (ties keep the earlier)."""
    shared = sorted((t for t in terms if t.lexeme in common), key=lambda t: (common[t.lexeme], t.at))
    return {t.at for t in shared[max(0, min_terms - (len(terms) - len(shared))):]}


def render(node, drop: frozenset[int] | set[int] = frozenset(), outer: bool = True) -> str:
    """Query text in which each conjunction is the disjunction of its positive parts,
    and its negations; '' where nothing positive is left."""
    if isinstance(node, Term):
        return "" if node.at in drop else node.text
    if isinstance(node, Not):
        inner = render(node.of, drop, False)
        bracket = isinstance(node.of, Term) and node.of.parts  # ! binds tighter than a phrase
        return inner and (f"!( {inner} )" if bracket else f"!{inner}")
    said = [(isinstance(c, Not), r) for c in node.of if (r := render(c, drop, False))]
    if node.kind == "or":
        return " | ".join(r for _, r in said)
    wanted, banned = [r for no, r in said if not no], [r for no, r in said if no]
    if not wanted:
        return ""
    text = " & ".join([f"({' | '.join(wanted)})", *banned])
    return f"({text})" if banned and not outer else text


def rewrite(parsed: str, or_semantics: bool = True, common: Mapping[str, int] | None = None, min_terms: int = 3) -> str:
    """The query to run for a parsed one. Unreadable input comes back as it is."""
    if not or_semantics:
        return parsed
    try:
        tree = parse(parsed)
    except QuerySyntaxError as e:
        log.warning("query left as it is: %s", e)
        return parsed
    if tree is None:
        return ""
    if not isinstance(tree, Group):
        tree = Group("and", (tree,))
    return render(tree, terms_to_drop(positive_terms(tree), common or {}, min_terms))


def quoted(lexeme: str) -> str:
    return "'" + lexeme.replace("'", "''") + "'"


def from_web(text: str | None, analyse: Callable[[str], str | None] = str) -> str:
    """Free text to a rendered query: "quotes" make phrases, ``or`` a disjunction, ``-``
    a negation, everything else a conjunction (an unquoted compound of its words). Never
    fails; '' if no word is left. ``analyse`` gives a word's lexeme, None for a stop word; a
    phrase keeps the distance over those."""
    pieces = re.findall(r'(-?)"([^"]*)"|(-?)([^\s"]+)', text or "")
    branches: list[list[str]] = [[]]
    for neg_q, phrase, neg_w, word in pieces:
        if word.lower() == "or" and not neg_w:
            branches.append([])
            continue
        words = [analyse(w) for w in re.findall(r"[a-z0-9]+", (word or phrase).lower())]
        at = [i for i, w in enumerate(words) if w is not None]
        if not at:
            continue
        gap = lambda n: "<->" if n == 1 else f"<{n}>"
        if phrase or neg_q or neg_w:
            body = quoted(words[at[0]]) + "".join(f" {gap(j - i)} {quoted(words[j])}" for i, j in zip(at, at[1:]))
            negated = neg_q or neg_w
            branches[-1].append(f"!( {body} )" if negated and len(at) > 1 else f"!{body}" if negated else body)
        else:
            branches[-1] += [quoted(words[i]) for i in at]
    return " | ".join(" & ".join(dict.fromkeys(b)) for b in branches if b)


def _holds(term: Term, toks: Column, i: Column) -> Column:
    at = F.try_element_at(toks, i.cast("int"))
    if term.lexeme is None and term.text.endswith("*"):
        return F.coalesce(at.startswith(term.text[1 : term.text.rindex("'")].replace("''", "'")), F.lit(False))
    return F.coalesce(at == (term.lexeme if term.lexeme is not None else term.text[1 : term.text.rindex("'")]), F.lit(False))


def predicate(node, toks: Column) -> Column:
    """Whether a document's tokens (array<string>, in order) satisfy the query."""
    if node is None:
        return F.lit(False)
    if isinstance(node, Not):
        return ~predicate(node.of, toks)
    if isinstance(node, Group):
        out = predicate(node.of[0], toks)
        for child in node.of[1:]:
            out = (out & predicate(child, toks)) if node.kind == "and" else (out | predicate(child, toks))
        return out
    if node.parts:
        first, rest = node.parts[0], list(zip(node.parts[1::2], node.parts[2::2], strict=True))

        def here(i: Column) -> Column:
            ok, at = _holds(first, toks, i), i
            for gap, term in rest:
                at = at + gap
                ok = ok & _holds(term, toks, at)
            return ok

        return (F.size(toks) > 0) & F.exists(F.sequence(F.lit(1), F.greatest(F.size(toks), F.lit(1))), here)
    if node.lexeme is not None:
        return F.array_contains(toks, node.lexeme)
    return F.exists(toks, lambda t: _holds(node, F.array(t), F.lit(1)))


@dataclass(frozen=True)
class Plan:
    """How to run a query: 'none', 'bag' (any of ``wanted``, none of ``banned``; counted) or 'tree'
    (``text``, scored by covers; a match holds one of ``wanted``)."""

    kind: str
    text: str = ""
    wanted: tuple[str, ...] = ()
    banned: tuple[str, ...] = ()


def _bare(node) -> list[str] | None:
    """The words of a disjunction of plain words."""
    if isinstance(node, Term):
        return None if node.lexeme is None else [node.lexeme]
    if isinstance(node, Not) or node.kind != "or":
        return None
    parts = [_bare(c) for c in node.of]
    return None if None in parts else [w for p in parts for w in p]


def plan(text: str) -> Plan:
    """The plan of a rendered query (see ``rewrite``)."""
    tree = parse(text)
    operands = positive_terms(tree) if tree is not None else []
    if not operands:
        return Plan("none")
    said = tree.of if isinstance(tree, Group) and tree.kind == "and" else (tree,)
    positive, negative = [c for c in said if not isinstance(c, Not)], [c for c in said if isinstance(c, Not)]
    words, banned = _bare(positive[0]) if len(positive) == 1 else None, [_bare(c.of) for c in negative]
    if words is not None and None not in banned:
        return Plan("bag", text, tuple(dict.fromkeys(words)), tuple(w for b in banned for w in b))
    lead = lambda t: t.parts[0] if t.parts else t
    first = [t if (t := lead(o)).lexeme is not None else None for o in operands]
    return Plan("tree", text, () if None in first else tuple(dict.fromkeys(t.lexeme for t in first)))  # a prefix may be any word
