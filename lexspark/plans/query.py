"""The boolean query language: sanitising, parsing, and its tree.

    any     := all { ("|" | "||" | OR) all }
    all     := simple { ["&" | "&&" | AND] simple }
    simple  := '"' word... '"'  |  "(" any ")"  |  word

Words side by side are joined by AND, which binds more tightly than OR.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from lexspark.config import DEFAULT, Config


class QueryTooLong(ValueError):
    """The query has more characters than are accepted."""


@dataclass(frozen=True)
class Word:
    text: str


@dataclass(frozen=True)
class Phrase:
    words: tuple[str, ...]


@dataclass(frozen=True)
class And:
    parts: tuple = field(default=())


@dataclass(frozen=True)
class Or:
    parts: tuple = field(default=())


Node = Word | Phrase | And | Or

_BLANK = re.compile(r"[!@#$%^*{}\[\]<>:;?,.\-+]")


def check_length(query: str, config: Config = DEFAULT) -> None:
    if len(query) + 1 >= config.query_limit:
        raise QueryTooLong(f"{len(query)} characters; at most {config.query_limit - 2} are accepted")


def sanitize(query: str) -> str:
    """What a user typed as a query: ASCII lower case; operators only with a space on
    both sides; brackets only at the edge of a word; other marks as spaces."""
    q = "".join(c.lower() if "A" <= c <= "Z" else c for c in query)
    out, k = [], 0
    while k < len(q):
        c = q[k]
        if c in "&|":
            n = 2 if q[k : k + 2] == c * 2 else 1
            alone = k > 0 and q[k - 1] == " " and k + n < len(q) and q[k + n] == " "
            out.append(q[k : k + n] if alone else " " * n)
            k += n
            continue
        if c == "(":
            c = c if k == 0 or q[k - 1] == " " else " "
        elif c == ")":
            c = c if k == len(q) - 1 or q[k + 1] == " " else " "
        out.append(" " if _BLANK.match(c) else c)
        k += 1
    return "".join(out)


_TOKEN = re.compile(r'\s*(\|\|?|&&?|[()"]|[^\s()"]+)')


class _Parser:
    def __init__(self, text: str, nested_or: bool):
        self.tokens = [(m.group(1), m.start(1)) for m in _TOKEN.finditer(text)]
        self.at = 0
        self.nested_or = nested_or
        self.words: list[str] = []

    def peek(self) -> str | None:
        return self.tokens[self.at][0] if self.at < len(self.tokens) else None

    def take(self) -> str | None:
        token = self.peek()
        self.at += 1
        return token

    def any(self) -> Node | None:
        parts = [self.all()]
        while self.peek() in ("|", "||", "OR"):
            self.take()
            parts.append(self.all())
        return _joined(Or, parts)

    def all(self) -> Node | None:
        parts = [self.simple()]
        while self.peek() not in (None, "|", "||", "OR", ")"):
            if self.peek() in ("&", "&&", "AND"):
                self.take()
                if self.peek() in (None, "|", "||", "OR", ")"):
                    break
            before = self.at
            parts.append(self.simple())
            if self.at == before:
                break
        return _joined(And, parts)

    def simple(self) -> Node | None:
        token = self.peek()
        if token is None or token in ("|", "||", "&", "&&", ")"):
            return None
        self.take()
        if token == '"':
            words = []
            # A bracket inside a phrase ends the word before it and is left out.
            while self.peek() not in (None, '"'):
                w = self.take()
                if w not in ("(", ")"):
                    words.append(w)
            self.take()
            self.words += words
            return Phrase(tuple(words)) if words else Phrase(("",))
        if token == "(":
            node = self.any()
            if self.peek() == ")":
                self.take()
            if self.nested_or and self.peek() in ("|", "||", "OR"):
                parts = [node]
                while self.peek() in ("|", "||", "OR"):
                    self.take()
                    parts.append(self.all())
                node = _joined(Or, parts)
            return node
        self.words.append(token)
        return Word(token)


def _joined(kind, parts: list) -> Node | None:
    parts = [p for p in parts if p is not None]
    if len(parts) < 2:
        return parts[0] if parts else None
    flat = []
    for p in parts:
        flat += p.parts if isinstance(p, kind) else [p]
    return kind(tuple(flat))


@dataclass(frozen=True)
class Query:
    tree: Node | None
    words: tuple[str, ...]  # all words in order, repeats and phrase words included


def parse(text: str, nested_or: bool = False) -> Query:
    """The tree of a query; None for a blank one. What follows an unmatched ``)`` is
    dropped. ``nested_or``: an OR after a bracket binds to the bracket alone."""
    p = _Parser(text, nested_or)
    tree = p.any()
    return Query(tree, tuple(p.words))
