"""Scores: static, URL, title and word-proximity features, and their total.

The proximity fold walks the places of the query's rarest word; for each, every other
word steps to a near place. It is one native ``aggregate`` per document with a state of
fixed size, so no row leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexspark.config import Config
from lexspark.functions import urls as U
from lexspark.operators import match as M
from lexspark.operators.index import Index
from lexspark.plans.query import Query

FAR = 0xFFFFFFFF


def static_score(url: Column, num_title_words: Column, c: Config) -> Column:
    score = F.when(F.length(url) < c.short_url, c.short_url_weight).otherwise(0) + F.when(num_title_words < c.short_title, c.short_title_weight).otherwise(0)
    if c.tld_bonus:
        host = F.regexp_extract(url, "^[a-z]+://([^/]*)", 1)
        score = score + F.when(host.endswith(".edu") | host.endswith(".gov"), 20).when(host.endswith(".com"), 10).otherwise(0)
    return score.cast("long")


def url_score(url: Column, words: list[str], rarest: Column, c: Config) -> Column:
    """The first query word that is the domain's name counts; twice if it is the rarest."""
    simple = U.simplify(url)
    place = F.array_position(F.array(*[F.lit(w) for w in words]), U.domain_name(simple)) - 1
    score = F.when(U.is_home_page(simple), c.url_home).otherwise(c.url_word)
    return F.when(place < 0, 0).otherwise(score * F.when(place == rarest, 2).otherwise(1)).cast("long")


def ladder(ratio: Column, steps: tuple[tuple[float, int], ...], above: bool = False) -> Column:
    out = F.lit(0)
    for least, score in reversed(steps):
        out = F.when(ratio > least if above else ratio >= least, score).otherwise(out)
    return out


def title_score(hits: Column, num_title_words: Column, c: Config) -> Column:
    ratio = F.when(num_title_words > 0, hits / num_title_words).otherwise(F.lit(0.0))
    # Words in a title of which none was counted make the ratio infinite.
    ratio = F.when((num_title_words == 0) & (hits > 0), F.lit(float("inf"))).otherwise(ratio)
    return ladder(ratio, c.title_ladder).cast("long")


def _let(value: Column, of) -> Column:
    """``of(value)`` with the value computed once."""
    return F.transform(F.array(value), of)[0]


def _step(w: Column, p: Column, a: Column) -> Column:
    """The state (c, occ, span) of a word after the anchor ``a``."""
    n = F.size(p)
    c1 = w["c"] + 1

    def at(m: Column) -> Column:
        prev, here = F.get(p, m - 1), F.get(p, m)
        near = F.when((prev <= a) & (a - prev < here - a), prev).otherwise(here)
        return (
            F.when(w["c"] >= n, w)
            .when(c1 >= n, F.struct(c1.alias("c"), (w["occ"] + 1).alias("occ"), w["span"].alias("span")))
            .when(m >= n, F.struct(n.alias("c"), (w["occ"] + n - c1 + 1).alias("occ"), w["span"].alias("span")))
            .otherwise(F.struct(m.alias("c"), (w["occ"] + 2 + m - c1).alias("occ"), near.alias("span")))
        )

    return _let(F.greatest(c1, _below(p, a)), at)


def _below(p: Column, a: Column) -> Column:
    """How many of the sorted places lie below ``a``, by halving: as many steps as the
    number of places has bits."""
    n = F.size(p)
    bits = F.sequence(F.floor(F.log2(F.greatest(n, F.lit(1)))).cast("int"), F.lit(0), F.lit(-1))

    def step(found: Column, k: Column) -> Column:
        tried = found + F.call_function("shiftleft", F.lit(1), k)
        return F.when((tried <= n) & (F.get(p, tried - 1) < a), tried).otherwise(found)

    return F.aggregate(bits, F.lit(0), step)


def span_features(ps: Column, first: Column, rarest: Column, doc_start: Column, words: int, c: Config) -> Column:
    """The fold over the rarest word's places: counts of span features, and ``occ``.

    ``ps``: places of each query word; ``first``: the first place of each at or after
    the document's start, which lies beyond it where the document lacks the word."""
    zero = F.lit(0)
    init = F.struct(
        F.transform(first, lambda x: F.struct(zero.alias("c"), zero.alias("occ"), x.cast("long").alias("span"))).alias("w"),
        *[zero.alias(n) for n in ("short", "top", "ordered", "phrase", "triple", "double")],
    )
    idx = F.array(*[F.lit(i) for i in range(words)])

    def count(cond: Column) -> Column:
        return cond.cast("int")

    def fold(s: Column, a: Column) -> Column:
        moved = F.transform(idx, lambda i: F.when(i == rarest, F.struct(F.get(s["w"], i)["c"].alias("c"), F.get(s["w"], i)["occ"].alias("occ"), a.alias("span"))).otherwise(_step(F.get(s["w"], i), F.get(ps, i), a)))

        def features(w: Column) -> Column:
            span = [F.get(w, F.lit(i))["span"] for i in range(words)]
            top = F.array_max(F.transform(w, lambda x: x["span"]))
            low = F.array_min(F.transform(w, lambda x: x["span"]))
            short = count(top - low < 3 * words)
            near_top = count(top < doc_start + c.near_top)
            if words == 1:
                return F.struct(w.alias("w"), (s["short"] + short).alias("short"), (s["top"] + near_top).alias("top"), *[s[n].alias(n) for n in ("ordered", "phrase", "triple", "double")])
            ordered = phrase = F.lit(True)
            for i in range(1, words):
                ordered = ordered & (span[i - 1] <= span[i])
                phrase = phrase & (span[i] == span[i - 1] + 1)
            close = [sum((count((j != i) & (F.abs(span[i] - span[j]) <= c.near)) if i != j else zero for j in range(words)), zero) for i in range(words)]
            most = F.greatest(*close)
            triple = ~phrase & (most >= 2)
            double = ~triple & (most >= 1)
            return F.struct(
                w.alias("w"), (s["short"] + short).alias("short"), (s["top"] + near_top).alias("top"), (s["ordered"] + count(ordered)).alias("ordered"),
                (s["phrase"] + count(phrase)).alias("phrase"), (s["triple"] + count(triple)).alias("triple"), (s["double"] + count(double)).alias("double"),
            )

        return _let(moved, features)

    return F.aggregate(F.get(ps, rarest), init, fold)


def body_score(f: Column, expected: Column, words: int, c: Config) -> Column:
    cap = lambda x: F.least(x, F.lit(c.span_cap))
    often = F.aggregate(F.zip_with(f["w"], expected, lambda w, e: (w["occ"] > 2 * e).cast("int")), F.lit(0), lambda a, x: a + x)
    bonus = F.when(often == words, c.frequency_all).otherwise(ladder(often / words, c.frequency_ladder, above=True))
    score = 2 * cap(f["short"]) + 2 * cap(f["ordered"]) + 3 * f["top"] + 7 * f["phrase"] + 5 * f["triple"] + 2 * cap(f["double"]) + bonus
    return (F.floor(score / 3) if words == 1 else score).cast("long")


def word_stats(index: Index, query: Query) -> DataFrame:
    """By chunk that holds every query word: ``expected`` occurrences of each word,
    ``rarest`` (the first of the least frequent) and the ``weight`` of dynamic scores."""
    c = index.config
    terms = list(dict.fromkeys(query.words))
    each = index.term_stats.where(F.col("term").isin(terms) & (F.col("field") == "body"))
    wide = each.groupBy("chunk_id").agg(*[F.max(F.when(F.col("term") == w, F.col(k))).alias(f"{k}{i}") for i, w in enumerate(terms) for k in ("n_posts", "n_docs")])
    wide = wide.dropna().join(index.chunk_stats.select("chunk_id", F.col("n_posts").alias("all_posts")), "chunk_id")
    at = [terms.index(w) for w in query.words]
    posts = F.array(*[F.col(f"n_posts{i}") for i in at])
    rare = sum((F.floor(F.col("all_posts") / F.col(f"n_posts{i}")) > c.rare_multiplier).cast("int") for i in at) / len(at)
    return wide.select(
        "chunk_id",
        F.array(*[F.floor(F.col(f"n_posts{i}") / F.col(f"n_docs{i}")).cast("long") for i in at]).alias("expected"),
        (F.array_position(posts, F.array_min(posts)) - 1).cast("int").alias("rarest"),
        F.when(rare > c.most, c.dynamic_most_rare).when(rare > c.some, c.dynamic_some_rare).otherwise(c.dynamic_weight).alias("weight"),
        (F.col("all_posts") / c.docs_per_chunk).alias("mean_length"),
    )


def scored(index: Index, query: Query) -> DataFrame:
    """Every matching document (the first ``per_chunk`` of a chunk) with its features
    and ``score``."""
    c = index.config
    terms = list(dict.fromkeys(query.words))
    at = [terms.index(w) for w in query.words]
    n = len(at)
    # The next place of a word that a document lacks: its first in a later document.
    back = Window.partitionBy("chunk_id").orderBy(F.desc("doc_id")).rowsBetween(Window.unboundedPreceding, 0)
    rows = M.places(index, query.words)
    for i in range(len(terms)):
        rows = rows.withColumn(f"n{i}", F.coalesce(F.last(F.get(f"p{i}", F.lit(0)), ignorenulls=True).over(back), F.lit(FAR)))
    stats = word_stats(index, query)
    order = Window.partitionBy("chunk_id").orderBy("doc_id")
    rows = rows.where(M.condition(query)).join(stats, "chunk_id").withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= c.per_chunk)
    docs = index.docs.select("chunk_id", "doc_id", "url", "title", "abstract", "num_title_words", "n_tokens", "doc_start")
    rows = rows.join(docs, ["chunk_id", "doc_id"]).where(F.length("url") >= c.shortest_url)
    ps, first = F.array(*[F.col(f"p{i}") for i in at]), F.array(*[F.col(f"n{i}") for i in at])
    rows = rows.withColumn("spans", span_features(ps, first, F.col("rarest"), F.col("doc_start"), n, c))
    factor = F.col("n_tokens") / F.col("mean_length") / 10
    body = F.col("raw_body")
    return (
        rows.withColumn("raw_body", body_score(F.col("spans"), F.col("expected"), n, c))
        .withColumn("body_score", F.when(factor > 1, F.floor(body / factor)).otherwise(body).cast("long"))
        .withColumn("static_score", static_score(F.col("url"), F.col("num_title_words"), c))
        .withColumn("url_score", url_score(F.col("url"), list(query.words), F.col("rarest"), c))
        .withColumn("title_score", title_score(sum(F.col(f"t{i}").cast("int") for i in at), F.col("num_title_words"), c))
        .withColumn("score", (c.static_weight * F.col("static_score") + F.col("weight") * (F.col("body_score") + F.col("title_score") + F.col("url_score"))).cast("long"))
    )


def distinct_top(rows: DataFrame, k: int) -> DataFrame:
    """The best ``k``: of rows with one URL the best, then of rows with one title and
    score the first. Ties go to the smaller chunk and document. Both steps keep one row
    per group by a partial aggregate, so only what can reach the result is sorted."""
    cols = F.struct(*[F.col(x) for x in rows.columns])
    order = F.struct((-F.col("score")).alias("s"), "chunk_id", "doc_id")
    once = rows.groupBy(F.col("url").alias("_u")).agg(F.min_by(cols, order).alias("r")).select("r.*")
    once = once.groupBy(F.col("title").alias("_t"), F.col("score").alias("_s")).agg(F.min_by(cols, F.struct("chunk_id", "doc_id")).alias("r")).select("r.*")
    return once.orderBy(F.desc("score"), "chunk_id", "doc_id").limit(k)
