"""Search: from what a user typed to ranked, de-duplicated, paged results."""

from __future__ import annotations

import html
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.operators import rank
from lexspark.operators.index import Index
from lexspark.plans.query import Query, check_length, parse, sanitize

RESULT = ("title", "abstract", "url", "score")
EXPLAIN = ("static_score", "url_score", "title_score", "raw_body", "body_score", "weight", "rarest")


@dataclass
class Results:
    """``status``: ok, blank, no_result or too_many; ``rows``: None unless ok. The rows of
    all pages stay in Spark's cache until ``close``."""

    status: str
    rows: DataFrame | None = None
    pages: int = 0
    found: DataFrame | None = None

    def close(self) -> None:
        if self.found is not None:
            self.found.unpersist()


def top(index: Index, query: Query | str, explain: bool = False) -> DataFrame:
    """The best documents: title, abstract, URL and score (and its parts)."""
    q = parse(query) if isinstance(query, str) else query
    best = rank.distinct_top(rank.scored(index, q), index.config.top)
    spans = [F.col(f"spans.{x}").alias(f"n_{x}") for x in ("short", "top", "ordered", "phrase", "triple", "double")] if explain else []
    return best.select("chunk_id", "doc_id", *RESULT, *(EXPLAIN if explain else ()), *spans)


def page(results: DataFrame, number: int, size: int = 10) -> DataFrame:
    return results.orderBy(F.desc("score"), "chunk_id", "doc_id").offset(size * (number - 1)).limit(size)


def search(index: Index, typed: str, number: int = 1) -> Results:
    """A page of results for what a user typed."""
    if not typed.strip():
        return Results("blank")
    check_length(typed, index.config)
    q = parse(sanitize(typed))
    if q.tree is None or any(not w for w in q.words):
        return Results("no_result")
    found = top(index, q).where((F.col("title") != "") & (F.col("abstract") != "")).persist()
    n, size = found.count(), index.config.page
    pages = -(-n // size)
    if not 0 < number <= pages:
        found.unpersist()
        return Results("too_many", pages=pages) if n else Results("no_result")
    return Results("ok", page(found, number, size), pages, found)


def quoted(text: str) -> str:
    """A query as it may stand in an attribute of a page."""
    return text.replace('"', "&quot;")


def request(path: str) -> tuple[int, str] | None:
    """Page and (still escaped) query of a request path ``/?N?query``; None for others."""
    import re

    m = re.match(r"^/\?(\d+)\?(.*)$", path, re.S)
    return (int(m[1]), m[2]) if m else None


def render(results: Results, typed: str) -> str:
    """A plain page of results."""
    head = f'<form><input name="q" value="{quoted(typed)}"></form>'
    if results.status != "ok":
        return f"<html><body>{head}<p>{results.status}</p></body></html>"
    items = "".join(f'<li><a href="{html.escape(r.url)}">{html.escape(r.title)}</a><p>{html.escape(r.abstract)}</p></li>' for r in results.rows.collect())
    return f"<html><body>{head}<ol>{items}</ol></body></html>"
