import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexspark.operators import index, match
from lexspark.operators.index import Index
from lexspark.plans.query import And, Or, Phrase, Word, parse

CASE2 = {"quick": (10, 27, 105, 513, 518, 520, 1820), "brown": (28, 50, 62, 70, 514, 790), "fox": (87, 106, 515, 550, 1200, 1900)}
ENDS2 = (112, 570, 1006, 1704, 2004)
CASE3 = {"quick": (1, 3, 11, 14, 18, 19, 26), "brown": (4, 5, 6, 7, 15, 22), "fox": (9, 12, 16, 20, 24, 28)}
ENDS3 = (13, 21, 23, 25, 29)
EXPECTED = {
    "quick AND brown": ({1, 2}, {1, 2}),
    "quick AND fox": ({1, 2, 5}, {1, 2, 5}),
    "brown AND fox": ({1, 2}, {1, 2}),
    "quick AND brown AND fox": ({1, 2}, {1, 2}),
    "quick OR brown": ({1, 2, 3, 5}, {1, 2, 3, 5}),
    "quick OR fox": ({1, 2, 4, 5}, {1, 2, 4, 5}),
    "brown OR fox": ({1, 2, 3, 4, 5}, {1, 2, 3, 4, 5}),
    '"quick brown"': ({1, 2}, {1, 2}),
    '"quick fox"': ({1, 2}, {1}),
    '"brown fox"': ({2}, {2}),
    '"quick brown fox"': ({2}, {2}),
}


def built(spark, lists, ends):
    docs = spark.createDataFrame([(0, k + 1, e) for k, e in enumerate(ends)], "chunk_id int, doc_id long, doc_end long")
    places = spark.createDataFrame([(0, "body", t, p) for t, ps in lists.items() for p in ps], "chunk_id int, field string, term string, loc long")
    return Index(docs, places.join(index.document_of(docs, places.select("chunk_id", "loc")), ["chunk_id", "loc"]))


@pytest.mark.parametrize(("lists", "ends", "side"), [(CASE3, ENDS3, 0), (CASE2, ENDS2, 1)])
def test_posting_lists(spark, lists, ends, side):
    ix = built(spark, lists, ends)
    got = match.match_many(ix, {k: parse(k) for k in EXPECTED}).collect()
    for text, sides in EXPECTED.items():
        assert {r.doc_id for r in got if r.query_id == text} == sides[side], text


def test_places_beyond_the_last_document_go(spark):
    ix = built(spark, {"quick": (15, 27, 105), "fox": (87, 104, 515)}, (10, 100, 200))
    assert {r.loc for r in ix.postings.collect()} == {15, 27, 105, 87, 104}


def test_missing_word_empties_a_chunk(spark):
    ix = built(spark, CASE3, ENDS3)
    assert match.match(ix, parse("quick | zebra")).count() == 0
    assert match.match(ix, parse("")).count() == 0


def holds(node, words):
    if isinstance(node, Word):
        return node.text in words
    if isinstance(node, Phrase):
        n = len(node.words)
        return any(tuple(words[k : k + n]) == node.words for k in range(len(words) - n + 1))
    return (all if isinstance(node, And) else any)(holds(p, words) for p in node.parts)


trees = st.recursive(
    st.one_of(st.sampled_from("abc").map(Word), st.lists(st.sampled_from("abc"), min_size=2, max_size=3).map(lambda w: Phrase(tuple(w)))),
    lambda t: st.one_of(st.lists(t, min_size=2, max_size=3).map(lambda p: And(tuple(p))), st.lists(t, min_size=2, max_size=3).map(lambda p: Or(tuple(p)))),
    max_leaves=5,
)


def text(node):
    if isinstance(node, Word):
        return node.text
    if isinstance(node, Phrase):
        return '"' + " ".join(node.words) + '"'
    return "(" + (" & " if isinstance(node, And) else " | ").join(map(text, node.parts)) + ")"


@settings(max_examples=4, deadline=None)
@given(queries=st.lists(trees, min_size=4, max_size=4))
def test_plan_equals_brute_force(spark, queries):
    r = random.Random(1)
    docs = [[r.choice("abcd") for _ in range(r.randint(3, 9))] for _ in range(25)]
    ix = index.build(spark.createDataFrame([(k, f"https://x.org/{k}", [], w) for k, w in enumerate(docs)], "doc_id long, url string, title_words array<string>, words array<string>"))
    parsed = {str(k): parse(text(q)) for k, q in enumerate(queries)}
    got = match.match_many(ix, parsed).collect()
    for k, q in enumerate(queries):
        assert {r.doc_id for r in got if r.query_id == str(k)} == {i for i, w in enumerate(docs) if holds(q, w)}
