"""Boolean and positional retrieval as one set-oriented plan.

One scan of the postings with ``term IN (words)`` and one shuffle by document give each
document the places of every query word; the query's tree becomes a boolean column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.operators.index import Index
from lexspark.plans.query import And, Node, Or, Phrase, Query, Word


def places(index: Index, words: tuple[str, ...]) -> DataFrame:
    """``chunk_id, doc_id``, the sorted body places ``p{i}`` of each distinct word and
    whether it stands in the title, ``t{i}``, of documents with any of them."""
    terms = list(dict.fromkeys(words))
    hits = index.postings.where(F.col("term").isin(terms))
    if not terms:
        return hits.select("chunk_id", "doc_id").where(F.lit(False))
    aggs = []
    for i, w in enumerate(terms):
        here = F.col("term") == w
        aggs.append(F.array_sort(F.collect_list(F.when(here & (F.col("field") == "body"), F.col("loc")))).alias(f"p{i}"))
        aggs.append(F.max(here & (F.col("field") == "title")).alias(f"t{i}"))
    return hits.groupBy("chunk_id", "doc_id").agg(*aggs)


def _earlier(places: Column, k: int) -> Column:
    return F.transform(places, lambda x: x - k)


def _condition(node: Node, at: dict[str, int]) -> Column:
    if isinstance(node, Word):
        return F.size(f"p{at[node.text]}") > 0
    if isinstance(node, Phrase):
        # Places at which the phrase can begin, by each of its words; hashed, so linear.
        starts = F.col(f"p{at[node.words[0]]}")
        for k, w in enumerate(node.words):
            if k:
                starts = F.array_intersect(starts, _earlier(F.col(f"p{at[w]}"), k))
        return F.size(starts) > 0
    out = None
    for part in node.parts:
        c = _condition(part, at)
        out = c if out is None else out & c if isinstance(node, And) else out | c
    return out


def condition(query: Query) -> Column:
    """The tree as a boolean over the columns of ``places``."""
    if query.tree is None:
        return F.lit(False)
    return _condition(query.tree, {w: i for i, w in enumerate(dict.fromkeys(query.words))})


def complete_chunks(index: Index, words: tuple[str, ...], stats: DataFrame | None = None) -> DataFrame:
    """Chunks whose body holds every word of the query; others answer nothing."""
    terms = list(dict.fromkeys(words))
    rows = (stats if stats is not None else index.postings).where(F.col("term").isin(terms) & (F.col("field") == "body"))
    return rows.groupBy("chunk_id").agg(F.countDistinct("term").alias("n")).where(F.col("n") == len(terms)).select("chunk_id")


def match(index: Index, query: Query, everywhere: bool = True) -> DataFrame:
    """Documents that match: ``chunk_id, doc_id`` and the word columns. ``everywhere``:
    only in chunks that hold every word of the query, OR alternatives included."""
    found = places(index, query.words).where(condition(query))
    if query.tree is None:
        return found
    return found.join(complete_chunks(index, query.words), "chunk_id", "left_semi") if everywhere else found


def spans(index: Index, query: Query) -> DataFrame:
    """First and last body place of the query's words in each matching document."""
    n = len(dict.fromkeys(query.words))
    every = F.flatten(F.array(*[F.col(f"p{i}") for i in range(n)]))
    return match(index, query).select("chunk_id", "doc_id", F.array_min(every).alias("first_loc"), F.array_max(every).alias("last_loc"))


def match_many(index: Index, queries: dict[str, Query]) -> DataFrame:
    """``query_id, chunk_id, doc_id`` of many queries from one scan and one shuffle."""
    words = tuple(dict.fromkeys(w for q in queries.values() for w in q.words))
    at = {w: i for i, w in enumerate(words)}
    tests = [F.when(_condition(q.tree, at), F.lit(name)) for name, q in queries.items() if q.tree is not None]
    found = places(index, words).select("chunk_id", "doc_id", F.explode(F.filter(F.array(*tests), lambda x: x.isNotNull())).alias("query_id"))
    body = index.postings.where(F.col("term").isin(list(words)) & (F.col("field") == "body")).select("chunk_id", "term").distinct()
    have = body.groupBy("chunk_id").agg(F.collect_set("term").alias("have"))
    needs = F.create_map(*[x for name, q in queries.items() for x in (F.lit(name), F.array(*[F.lit(w) for w in dict.fromkeys(q.words)]))])
    held = found.join(have, "chunk_id").where(F.size(F.array_except(F.element_at(needs, F.col("query_id")), "have")) == 0)
    return held.select("query_id", "chunk_id", "doc_id")
