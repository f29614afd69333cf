"""Registered queries and, where SQL can express them, the SQL of their results."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.config import DEFAULT
from lexspark.functions import text as T
from lexspark.functions import urls as U
from lexspark.operators import crawl, index, match, rank
from lexspark.operators.index import Index
from lexspark.plans import search
from lexspark.plans.query import parse
from lexspark.sources import html
from lexspark.workers import shared_root

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_built: dict[tuple[str, str], tuple[Index, DataFrame]] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a query, with its SQL if it has one."""

    def add(fn):
        QUERIES[name or fn.__name__] = fn
        if sql is not None:
            SQL[name or fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents_index(spark: SparkSession, sf_dir: str) -> Index:
    """The index over ``documents``; its tables are kept for the session's later queries."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _built:
        _release(spark)
        # Files of few tasks hold all words; spread, they are tokenised by all cores.
        docs = index.spread(table(spark, sf_dir, "documents"))
        words: list[DataFrame] = []

        def keep(df: DataFrame) -> DataFrame:
            words.append(df.persist())
            return words[0]

        ix = index.build(index.parse_documents(docs), keep=keep).kept()
        _built[key] = ix, words[0]
    return _built[key][0]


def _release(spark: SparkSession) -> None:
    """Indexes of other data leave the cache before a new one enters it."""
    for key in [k for k in _built if k[0] == spark.sparkContext.applicationId]:
        ix, words = _built.pop(key)
        ix.release()
        words.unpersist()


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top(documents_index(spark, sf_dir), parse("of the"), explain=True)


# -- tokens and the index -------------------------------------------------------------

_PARSED = r"""raw AS (SELECT doc_id, source, lang, regexp_split_to_array(coalesce(text, ''), '[ \t\n\r]+') AS r FROM documents),
parsed AS (SELECT doc_id, 'https://www.' || source || '.com/' || lang || '/' || doc_id AS url,
    [lower(w) FOR w IN r[1:6] IF regexp_full_match(w, '[A-Za-z]+')] AS title_words,
    [lower(w) FOR w IN r IF regexp_full_match(w, '[A-Za-z]+')] AS words FROM raw)"""
_DOCS = f"""{_PARSED},
docs0 AS (SELECT CAST(doc_id // 30000 AS INTEGER) AS chunk_id, doc_id, url, title_words, words,
    [w FOR w IN title_words IF len(w) < 19] AS tt, [w FOR w IN words IF len(w) < 20] AS bt FROM parsed),
docs AS (SELECT *, CAST(len(tt) + len(bt) AS BIGINT) AS n_tokens,
    CAST(sum(len(tt) + len(bt) + 1) OVER (PARTITION BY chunk_id ORDER BY doc_id) AS BIGINT) AS doc_end FROM docs0)"""
_POST = f"""{_DOCS},
post AS (SELECT chunk_id, 'title' AS field, unnest(tt) AS term, doc_id, doc_end - n_tokens + generate_subscripts(tt, 1) - 1 AS loc FROM docs
    UNION ALL SELECT chunk_id, 'body', unnest(bt), doc_id, doc_end - n_tokens + len(tt) + generate_subscripts(bt, 1) - 1 FROM docs)"""


@query(f"WITH {_PARSED} SELECT p.doc_id, len(r.r) AS n_raw, len(words) AS n_words, len(list_distinct(words)) AS n_terms FROM parsed p JOIN raw r ON p.doc_id = r.doc_id")
def tokenize_documents(spark, d):
    raw = T.raw_words(F.coalesce("text", F.lit("")))
    words = T.keep_words(raw)
    big = lambda c: F.size(c).cast("long")
    return table(spark, d, "documents").select("doc_id", big(raw).alias("n_raw"), big(words).alias("n_words"), big(F.array_distinct(words)).alias("n_terms"))


@query(f"WITH {_PARSED}, w AS (SELECT unnest(words) AS w FROM parsed) SELECT count(*) AS n_kept, count(*) FILTER (len(w) < 20) AS n_indexed, count(DISTINCT w) AS n_terms, CAST((SELECT sum(len(r)) FROM raw) AS BIGINT) AS n_raw FROM w")
def token_filter_stats(spark, d):
    docs = table(spark, d, "documents")
    words = docs.select(F.explode(T.tokenize(F.col("text"))).alias("w"))
    n = docs.agg(F.sum(F.size(T.raw_words(F.col("text")))).cast("long").alias("n_raw"))
    stats = words.agg(F.count("*").alias("n_kept"), F.count(F.when(F.length("w") < DEFAULT.token_limit, 1)).alias("n_indexed"), F.countDistinct("w").alias("n_terms"))
    return stats.join(F.broadcast(n))  # one row each


@query(f"WITH {_POST} SELECT * FROM post")
def index_postings(spark, d):
    return documents_index(spark, d).postings


@query(f"WITH {_POST} SELECT chunk_id, field, term, count(*) AS n_posts, count(DISTINCT doc_id) AS n_docs FROM post GROUP BY ALL")
def index_term_stats(spark, d):
    return documents_index(spark, d).term_stats


@query(f"""WITH {_POST} SELECT chunk_id, n_posts + n_docs AS n_posts, n_unique + 1 AS n_unique, n_docs FROM
    (SELECT chunk_id, count(*) AS n_posts, count(DISTINCT field || term) AS n_unique FROM post GROUP BY 1) JOIN (SELECT chunk_id, count(*) AS n_docs FROM docs GROUP BY 1) USING (chunk_id)""")
def index_chunk_stats(spark, d):
    return documents_index(spark, d).chunk_stats


@query(f"WITH {_DOCS} SELECT chunk_id, doc_id, doc_end - n_tokens AS doc_start, doc_end, n_tokens FROM docs")
def doc_locations(spark, d):
    return documents_index(spark, d).docs.select("chunk_id", "doc_id", "doc_start", "doc_end", "n_tokens")


_VARINT = "CASE " + " ".join(f"WHEN v < {1 << (8 * n - 3)} THEN {n}" for n in range(1, 8)) + " ELSE 8 END"
_HEX = "lpad(lower(to_hex(v + (n_bytes - 1) * (1::BIGINT << (8 * n_bytes - 3)))), 2 * n_bytes, '0')"


@query(f"""WITH {_POST}, g AS (SELECT chunk_id, field, term, doc_id, loc, loc - lag(loc, 1, 0) OVER (PARTITION BY chunk_id, field, term ORDER BY loc) AS v FROM post),
    n AS (SELECT *, {_VARINT} AS n_bytes FROM g)
    SELECT chunk_id, field, term, doc_id, loc, v AS delta, CAST(n_bytes AS INTEGER) AS n_bytes, {_HEX} AS code FROM n""")
def postings_delta(spark, d):
    return index.deltas(documents_index(spark, d).postings)


@query(f"""WITH x AS (SELECT o_orderkey, o_orderkey * o_custkey * 7919 AS v FROM orders), n AS (SELECT *, {_VARINT} AS n_bytes FROM x)
    SELECT o_orderkey, v AS value, CAST(n_bytes AS INTEGER) AS n_bytes, {_HEX} AS code, v AS decoded FROM n""")
def varint_codec(spark, d):
    v = F.col("value")
    rows = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") * F.col("o_custkey") * 7919).alias("value"))
    rows = rows.withColumn("n_bytes", T.varint_length(v)).withColumn("code", T.varint_hex(v))
    return rows.withColumn("decoded", T.varint_decode(F.col("code")))


def _prefix_sql(words: str, limit: int) -> str:
    return f"array_to_string([x.w FOR x IN list_transform({words}, lambda w, i: {{'w': w, 's': list_sum([len(z) + 1 FOR z IN ({words})[1:i]])}}) IF x.s <= {limit}], ' ')"


@query(f"""WITH {_DOCS}, l AS (SELECT doc_id, url, tt, len(title_words) AS n, [w FOR w IN words[6:] IF len(w) < 20] AS later FROM docs)
    SELECT doc_id, url, coalesce({_prefix_sql("tt", 50)}, '') AS title, coalesce({_prefix_sql("later[1:100]", 100)}, '') AS abstract, CAST(n AS INTEGER) AS num_title_words FROM l""")
def doc_title_abstract(spark, d):
    return documents_index(spark, d).docs.select("doc_id", "url", "title", "abstract", "num_title_words")


# -- retrieval ------------------------------------------------------------------------


def _in(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _complete(words: list[str]) -> str:
    return f"chunk_id IN (SELECT chunk_id FROM post WHERE field = 'body' AND term IN ({_in(words)}) GROUP BY 1 HAVING count(DISTINCT term) = {len(set(words))})"


def _having(words: list[str], having: str) -> str:
    return f"WITH {_POST} SELECT chunk_id, doc_id FROM post WHERE field = 'body' AND term IN ({_in(words)}) AND {_complete(words)} GROUP BY 1, 2 HAVING {having}"


def _phrase(words: list[str]) -> str:
    joins = " ".join(f"JOIN b p{k} ON p{k}.doc_id = p0.doc_id AND p{k}.chunk_id = p0.chunk_id AND p{k}.term = '{w}' AND p{k}.loc = p0.loc + {k}" for k, w in enumerate(words) if k)
    return f"SELECT DISTINCT p0.chunk_id, p0.doc_id FROM b p0 {joins} WHERE p0.term = '{words[0]}'"


_B = f"WITH {_POST}, b AS (SELECT * FROM post WHERE field = 'body')"


def _has(w: str) -> str:
    return f"bool_or(term = '{w}')"


_MATCHES = {
    "match_word": ("that", _having(["that"], "true")),
    "match_and": ("of the", _having(["of", "the"], "count(DISTINCT term) = 2")),
    "match_or": ("with | nicht", _having(["with", "nicht"], "true")),
    "match_phrase": ('"of the"', f"{_B} {_phrase(['of', 'the'])}"),
    "match_phrase3": ('"the of the"', f"{_B} {_phrase(['the', 'of', 'the'])}"),
    "match_nested": ("(with | for) that & was", _having(["with", "for", "that", "was"], f"({_has('with')} OR {_has('for')}) AND {_has('that')} AND {_has('was')}")),
    "match_precedence": ("with that | for was", _having(["with", "that", "for", "was"], f"({_has('with')} AND {_has('that')}) OR ({_has('for')} AND {_has('was')})")),
    "match_missing_term": ("the | qqqzzz", _having(["the", "qqqzzz"], "true")),
}


def _match_query(text: str):
    return lambda spark, d: match.match(documents_index(spark, d), parse(text)).select("chunk_id", "doc_id")


for _name, (_text, _sql) in _MATCHES.items():
    query(_sql, _name)(_match_query(_text))


@query(f"WITH {_POST} SELECT chunk_id, doc_id, min(loc) AS first_loc, max(loc) AS last_loc FROM post WHERE field = 'body' AND term IN ('in', 'that') AND {_complete(['in', 'that'])} GROUP BY 1, 2 HAVING count(DISTINCT term) = 2")
def match_span_locations(spark, d):
    return match.spans(documents_index(spark, d), parse("in that"))


@query(f"WITH {_POST} SELECT chunk_id, loc, doc_id FROM post WHERE field = 'body'")
def doc_of_location(spark, d):
    ix = documents_index(spark, d)
    return index.document_of(ix.docs, ix.postings.where("field = 'body'").select("chunk_id", "loc"))


_BATCH = {"b1": "of the", "b2": '"of the"', "b3": "with | nicht", "b4": "(with | for) that", "b5": "the | qqqzzz", "b6": "in to and"}


@query(f"""{_B}, n AS (SELECT chunk_id, doc_id, {", ".join(f"{_has(w)} AS h_{w}" for w in ("of", "the", "with", "nicht", "for", "that", "in", "to", "and"))} FROM b GROUP BY 1, 2)
    SELECT 'b1' AS query_id, chunk_id, doc_id FROM n WHERE h_of AND h_the UNION ALL SELECT 'b2', * FROM ({_phrase(["of", "the"])})
    UNION ALL SELECT 'b3', chunk_id, doc_id FROM n WHERE (h_with OR h_nicht) AND {_complete(["with", "nicht"])}
    UNION ALL SELECT 'b4', chunk_id, doc_id FROM n WHERE (h_with OR h_for) AND h_that AND {_complete(["with", "for", "that"])}
    UNION ALL SELECT 'b6', chunk_id, doc_id FROM n WHERE h_in AND h_to AND h_and""")
def search_batch(spark, d):
    return match.match_many(documents_index(spark, d), {k: parse(q) for k, q in _BATCH.items()})


@query(f"""WITH {_POST}, m AS (SELECT p.chunk_id, p.doc_id FROM post p WHERE field = 'body' AND term = 'the' GROUP BY 1, 2)
    SELECT chunk_id, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY doc_id) AS rn FROM m) WHERE rn <= 99""")
def doc_cap_per_chunk(spark, d):
    """With a cap of 99 a chunk, so that it binds at every size."""
    ix = documents_index(spark, d)
    return rank.scored(replace(ix, config=replace(ix.config, per_chunk=99)), parse("the")).select("chunk_id", "doc_id")


@query(_MATCHES["match_phrase"][1])
def match_written(spark, d):
    """A phrase over an index that was written and read again: a term's scan reads the
    row groups that may hold it."""
    path = f"{shared_root(spark)}/index-{uuid.uuid4().hex}"
    documents_index(spark, d).write(path)
    return match.match(Index.read(spark, path), parse(_MATCHES["match_phrase"][0])).select("chunk_id", "doc_id")


# -- ranking --------------------------------------------------------------------------

_WS = f"""WITH {_POST}, s AS (SELECT chunk_id, term, count(*) AS n_posts, count(DISTINCT doc_id) AS n_docs FROM post WHERE field = 'body' AND term IN ('in', 'that', 'this') GROUP BY 1, 2),
    a AS (SELECT chunk_id, count(*) + (SELECT count(*) FROM docs x WHERE x.chunk_id = post.chunk_id) AS all_posts FROM post GROUP BY 1)"""


@query(f"""{_WS}, o AS (SELECT *, CASE term WHEN 'in' THEN 0 WHEN 'that' THEN 1 ELSE 2 END AS k FROM s)
    SELECT chunk_id, list(CAST(n_posts // n_docs AS BIGINT) ORDER BY k) AS expected, CAST(arg_min(k, n_posts * 10 + k) AS INTEGER) AS rarest,
    CAST(CASE WHEN avg(CASE WHEN all_posts // n_posts > 100000 THEN 1 ELSE 0 END) > 0.6 THEN 15 WHEN avg(CASE WHEN all_posts // n_posts > 100000 THEN 1 ELSE 0 END) > 0.3 THEN 12 ELSE 10 END AS INTEGER) AS weight,
    any_value(all_posts) / 30000 AS mean_length FROM o JOIN a USING (chunk_id) GROUP BY chunk_id HAVING count(*) = 3""")
def query_word_stats(spark, d):
    return rank.word_stats(documents_index(spark, d), parse("in that this"))


_TITLE_HITS = "CAST(list_contains(tt, 'of') AS INTEGER) + CAST(list_contains(tt, 'the') AS INTEGER)"


@query(f"""WITH {_POST}, m AS (SELECT chunk_id, doc_id FROM post WHERE field = 'body' AND term IN ('of', 'the') GROUP BY 1, 2 HAVING count(DISTINCT term) = 2),
    c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY doc_id) AS rn FROM m) WHERE rn <= 999),
    t AS (SELECT d.*, {_TITLE_HITS} AS hits, len(title_words) AS n FROM docs d SEMI JOIN c ON c.doc_id = d.doc_id),
    r AS (SELECT *, CASE WHEN n > 0 THEN hits / n ELSE 0.0 END AS ratio FROM t)
    SELECT chunk_id, doc_id, CAST(CASE WHEN len(url) < 40 THEN 30 ELSE 0 END + CASE WHEN n < 6 THEN 30 ELSE 0 END AS BIGINT) AS static_score, CAST(0 AS BIGINT) AS url_score,
    CAST(CASE WHEN ratio >= 1 THEN 250 WHEN ratio >= 0.74 THEN 90 WHEN ratio >= 0.49 THEN 70 WHEN ratio >= 0.24 THEN 35 WHEN ratio >= 0.05 THEN 10 ELSE 0 END AS BIGINT) AS title_score FROM r""")
def rank_features(spark, d):
    return rank.scored(documents_index(spark, d), parse("of the")).select("chunk_id", "doc_id", "static_score", "url_score", "title_score")


@query()
def rank_body_exact(spark, d):
    """Not in SQL: the fold is sequential; the tests hold it against its Python model."""
    rows = rank.scored(documents_index(spark, d), parse("in that this"))
    return rows.select("chunk_id", "doc_id", *[F.col(f"spans.{x}").alias(f"n_{x}") for x in ("short", "top", "ordered", "phrase", "triple", "double")], "raw_body", "body_score")


# One word: each place counts as a short and ordered span, those near the top as such.
_ONE_WORD = f"""WITH {_POST}, m AS (SELECT chunk_id, doc_id, count(*) AS n, count(*) FILTER (loc < start + 100) AS near FROM
        (SELECT p.*, d.doc_end - d.n_tokens AS start FROM post p JOIN docs d ON d.doc_id = p.doc_id WHERE field = 'body' AND term = 'that') GROUP BY 1, 2),
    c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY doc_id) AS rn FROM m) WHERE rn <= 999),
    a AS (SELECT chunk_id, (count(*) + (SELECT count(*) FROM docs x WHERE x.chunk_id = post.chunk_id)) / 30000 AS mean FROM post GROUP BY 1),
    f AS (SELECT d.*, c.n, d.n_tokens / mean / 10 AS factor, CAST((2 * least(c.n, 20) + 3 * c.near) // 3 AS BIGINT) AS raw_body FROM docs d JOIN c ON c.doc_id = d.doc_id JOIN a ON a.chunk_id = d.chunk_id),
    r AS (SELECT *, CAST(CASE WHEN factor > 1 THEN floor(raw_body / factor) ELSE raw_body END AS BIGINT) AS body_score,
        CAST(CASE WHEN len(url) < 40 THEN 30 ELSE 0 END + CASE WHEN len(title_words) < 6 THEN 30 ELSE 0 END AS BIGINT) AS static_score,
        CASE WHEN len(title_words) > 0 THEN CAST(list_contains(tt, 'that') AS INTEGER) / len(title_words) ELSE 0.0 END AS ratio FROM f)"""


@query(f"{_ONE_WORD} SELECT chunk_id, doc_id, round(factor, 6) AS factor, raw_body, body_score FROM r")
def rank_length_norm(spark, d):
    rows = rank.scored(documents_index(spark, d), parse("that"))
    return rows.select("chunk_id", "doc_id", F.round(F.col("n_tokens") / F.col("mean_length") / 10, 6).alias("factor"), "raw_body", "body_score")


_WORD_SCORES = f"""{_ONE_WORD}, t AS (SELECT *, CASE WHEN ratio >= 1 THEN 250 WHEN ratio >= 0.74 THEN 90 WHEN ratio >= 0.49 THEN 70 WHEN ratio >= 0.24 THEN 35 WHEN ratio >= 0.05 THEN 10 ELSE 0 END AS title_score FROM r),
    s AS (SELECT chunk_id, doc_id, url, coalesce({_prefix_sql("tt", 50)}, '') AS title, CAST(10 * static_score + 10 * (body_score + title_score) AS BIGINT) AS score FROM t),
    u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY score DESC, chunk_id, doc_id) AS rn FROM s) WHERE rn = 1),
    v AS (SELECT * FROM (SELECT chunk_id, doc_id, url, title, score, row_number() OVER (PARTITION BY title, score ORDER BY chunk_id, doc_id) AS rn FROM u) WHERE rn = 1)
    SELECT chunk_id, doc_id, url, title, score FROM v ORDER BY score DESC, chunk_id, doc_id"""


@query(f"{_WORD_SCORES} LIMIT 30")
def search_word(spark, d):
    """A ranked search from its words to its best documents."""
    return search.top(documents_index(spark, d), parse("that")).select("chunk_id", "doc_id", "url", "title", "score")


@query(f"SELECT * FROM ({_WORD_SCORES} LIMIT 30) ORDER BY score DESC, chunk_id, doc_id LIMIT 10 OFFSET 10")
def search_word_page2(spark, d):
    return search.page(search.top(documents_index(spark, d), parse("that")), 2).select("chunk_id", "doc_id", "url", "title", "score")


@query(f"""{_B}, a AS (SELECT doc_id, chunk_id, loc FROM b WHERE term = 'that'), o AS (SELECT doc_id, loc FROM b WHERE term = 'in'),
    p AS (SELECT a.doc_id, a.loc, o.loc AS before FROM a ASOF LEFT JOIN o ON a.doc_id = o.doc_id AND a.loc >= o.loc),
    q AS (SELECT p.*, o.loc AS after FROM p ASOF LEFT JOIN o ON p.doc_id = o.doc_id AND p.loc <= o.loc)
    SELECT doc_id, loc, CASE WHEN before IS NULL THEN after WHEN after IS NULL THEN before WHEN loc - before < after - loc THEN before ELSE after END AS nearest FROM q""")
def span_nearest(spark, d):
    """Each place of a word with the nearest place of another in its document, by one
    sorted pass over both."""
    from pyspark.sql.window import Window

    rows = documents_index(spark, d).postings.where("field = 'body' AND term IN ('in', 'that')")
    back = Window.partitionBy("doc_id").orderBy("loc").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("doc_id").orderBy(F.desc("loc")).rowsBetween(Window.unboundedPreceding, 0)
    other = F.when(F.col("term") == "in", F.col("loc"))
    rows = rows.select("doc_id", "loc", "term", F.last(other, ignorenulls=True).over(back).alias("b"), F.last(other, ignorenulls=True).over(ahead).alias("a"))
    near = F.when(F.col("b").isNull(), F.col("a")).when(F.col("a").isNull(), F.col("b")).when(F.col("loc") - F.col("b") < F.col("a") - F.col("loc"), F.col("b")).otherwise(F.col("a"))
    return rows.where("term = 'that'").select("doc_id", "loc", near.alias("nearest"))


@query("""WITH r AS (SELECT 0 AS chunk_id, c_custkey AS doc_id, 'u' || (c_custkey % 700) AS url, 't' || c_nationkey AS title, CAST(floor(c_acctbal / 100) AS BIGINT) AS score FROM customer),
    u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY score DESC, chunk_id, doc_id) AS rn FROM r) WHERE rn = 1),
    v AS (SELECT * FROM (SELECT chunk_id, doc_id, url, title, score, row_number() OVER (PARTITION BY title, score ORDER BY chunk_id, doc_id) AS rn FROM u) WHERE rn = 1)
    SELECT chunk_id, doc_id, url, title, score FROM v ORDER BY score DESC, chunk_id, doc_id LIMIT 30""")
def topk_dedup(spark, d):
    rows = table(spark, d, "customer").select(
        F.lit(0).alias("chunk_id"), F.col("c_custkey").alias("doc_id"), F.concat(F.lit("u"), (F.col("c_custkey") % 700).cast("string")).alias("url"),
        F.concat(F.lit("t"), F.col("c_nationkey").cast("string")).alias("title"), F.floor(F.col("c_acctbal") / 100).cast("long").alias("score"),
    )
    return rank.distinct_top(rows, DEFAULT.top)


@query()
def search_top30(spark, d):
    return search.top(documents_index(spark, d), parse("in that this"))


@query()
def search_page2(spark, d):
    return search.page(search.top(documents_index(spark, d), parse("of the")), 2)


@query()
def search_explain(spark, d):
    return flagship(spark, d)


@query()
def approx_doc_freq(spark, d):
    """Approximate document counts (a sketch, so no exact SQL)."""
    return documents_index(spark, d).postings.groupBy("term").agg(F.approx_count_distinct("doc_id").alias("n_docs"))


_RESULTS = "SELECT c_nationkey AS seq, list({'t': c_name, 'a': c_mktsegment, 'u': 'https://' || lower(c_name), 's': CAST(c_custkey AS BIGINT)} ORDER BY c_custkey) AS rows FROM customer GROUP BY 1"


def _results(spark, d):
    row = F.struct(F.col("c_custkey").alias("k"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("abstract"), F.concat(F.lit("https://"), F.lower("c_name")).alias("url"), F.col("c_custkey").cast("long").alias("score"))
    rows = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("seq")).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    return rows.select("seq", U.encode_results(F.col("seq"), F.col("rows")).alias("message"))


@query(f"WITH r AS ({_RESULTS}) SELECT seq, seq || '@' || len(rows) || '@' || array_to_string([x.t || '@' || x.a || '@' || x.u || '@' || x.s FOR x IN rows], '@') AS message FROM r")
def result_encode(spark, d):
    return _results(spark, d)


@query(f"WITH r AS ({_RESULTS}), x AS (SELECT seq, unnest(rows) AS x FROM r) SELECT seq, x.t AS title, x.a AS abstract, x.u AS url, x.s AS score FROM x")
def result_roundtrip(spark, d):
    return _results(spark, d).select("seq", F.explode(U.decode_results(F.col("message"))).alias("r")).select("seq", "r.*")


# -- URLs -----------------------------------------------------------------------------

_URLRE = "^(?:([a-z]+)://)?([^/:]*)(?::([0-9]*))?/?(.*)$"
_URLS = f"u AS (SELECT page_id, url, regexp_extract(url, '{_URLRE}', 1) AS service, regexp_extract(url, '{_URLRE}', 2) AS host, regexp_extract(url, '{_URLRE}', 3) AS port, regexp_extract(url, '{_URLRE}', 4) AS path FROM (SELECT page_id, CASE WHEN starts_with(url, 'http') THEN url ELSE 'https://' || url END AS url FROM pages))"


@query(f"WITH {_URLS} SELECT page_id, service, host, port, path, replace(replace(service || '@' || host || '@' || port || '@' || path, '/', '&'), '~', '&') AS key FROM u")
def url_parse(spark, d):
    return table(spark, d, "pages").select("page_id", U.parse(F.col("url")).alias("p"), U.doc_key(F.col("url")).alias("key")).select("page_id", "p.*", "key")


_SIMPLE = r"s AS (SELECT page_id, url, regexp_replace(substr(url, 9), '^www\.', '') AS simple FROM pages), q AS (SELECT *, string_split(simple, '.') AS parts FROM s)"


@query(rf"WITH {_SIMPLE} SELECT page_id, simple, CASE WHEN len(parts) > 2 THEN parts[2] ELSE parts[1] END AS name, right(string_split(simple, '/')[1], 4) AS suffix, regexp_matches(simple, '^[^/.]*(\.[^/.]*)?$') AS home FROM q")
def url_simplify_domain(spark, d):
    s = U.simplify(F.col("url"))
    return table(spark, d, "pages").select("page_id", s.alias("simple"), U.domain_name(s).alias("name"), U.domain_suffix(s).alias("suffix"), U.is_home_page(s).alias("home"))


@query(rf"""WITH {_SIMPLE}, n AS (SELECT *, CASE WHEN len(parts) > 2 THEN parts[2] ELSE parts[1] END AS name FROM q)
    SELECT page_id, CAST(CASE WHEN name IN ('thththe', 'example', 'ththth') THEN CASE WHEN regexp_matches(simple, '^[^/.]*(\.[^/.]*)?$') THEN 250 ELSE 70 END * CASE WHEN name = 'example' THEN 2 ELSE 1 END ELSE 0 END AS BIGINT) AS url_score FROM n""")
def rank_url(spark, d):
    return table(spark, d, "pages").select("page_id", rank.url_score(F.col("url"), ["thththe", "example", "ththth"], F.lit(1), DEFAULT).alias("url_score"))


_BASE = "CASE WHEN regexp_matches(url, '[.](edu|gov|com|org)') THEN 850 WHEN contains(url, '.net') THEN 750 WHEN contains(url, '.biz') THEN 700 ELSE 650 END"
_HOST = "regexp_extract(url, '://([^/]*)', 1)"


@query(f"""SELECT page_id, CAST(CASE WHEN contains(url, '://') THEN {_BASE} - 4 - len(url) ELSE 10 END AS INTEGER) AS score,
    CAST(CASE WHEN contains(url, '://') THEN {_BASE} - 2 * len({_HOST}) - CASE WHEN regexp_matches({_HOST}, '[-_]') THEN 100 ELSE 0 END - len(url) ELSE 10 END AS INTEGER) AS by_host FROM pages""")
def url_priority(spark, d):
    return table(spark, d, "pages").select("page_id", U.priority(F.col("url")).alias("score"), U.priority(F.col("url"), by_host=True).alias("by_host"))


_ALL_URLS = "SELECT url FROM pages UNION ALL SELECT 'www.src' || chr(97 + CAST(c_nationkey AS INTEGER)) || '.example.org/' || lower(c_mktsegment) FROM customer"
_BAD = "|".join(b.replace(".", "[.]").replace("?", "[?]").replace("*", "[*]").replace("$", "[$]") for b in U.BANNED)


@query(f"WITH a AS ({_ALL_URLS}) SELECT url, count(*) AS n, any_value(url <> '' AND NOT regexp_matches(url, '{_BAD}') AND contains(url, '.')) AS valid, any_value(CASE WHEN contains(url, 'https://') THEN url ELSE 'https://' || url END) AS full_url FROM a GROUP BY 1")
def url_valid(spark, d):
    mine = table(spark, d, "customer").select(F.concat(F.lit("www.src"), F.char(97 + F.col("c_nationkey")), F.lit(".example.org/"), F.lower("c_mktsegment")).alias("url"))
    u = F.col("url")
    rows = table(spark, d, "pages").select("url").unionByName(mine).groupBy("url").agg(F.count("*").alias("n"))
    return rows.select("url", "n", U.valid(u).alias("valid"), U.with_scheme(u).alias("full_url"))


_FLIP = " || ".join(f"substr(h, {15 - 2 * k}, 2)" for k in range(8))


@query(f"WITH m AS (SELECT page_id, md5(url) AS h FROM pages) SELECT page_id, CAST(('0x' || {_FLIP})::UBIGINT % 10 AS INTEGER) AS machine FROM m")
def url_machine(spark, d):
    return table(spark, d, "pages").select("page_id", U.machine(F.col("url"), 10).alias("machine"))


# -- pages ----------------------------------------------------------------------------

_TOKENS = r"[lower(w) FOR w IN regexp_split_to_array({0}, '[ \t\n\r]+') IF regexp_full_match(w, '[A-Za-z]+')]"


@query("SELECT page_id, " + _TOKENS.format("regexp_extract(html, '(?i)<title[^>]*>([^<]*)</title>', 1)") + " AS title_words FROM pages")
def page_title_words(spark, d):
    return table(spark, d, "pages").select("page_id", html.title_words(F.col("html")).alias("title_words"))


_BARE = r"""regexp_replace(regexp_replace(html, '(?is)<title[^>]*>[^<]*</title>|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<svg[^>]*>.*?</svg>', ' ', 'g'), '(?s)<[^">]*("[^"]*"[^">]*)*>', ' ', 'g')"""


@query("WITH w AS (SELECT page_id, " + _TOKENS.format(_BARE) + " AS words FROM pages) SELECT page_id, len(words) AS n_words, array_to_string(words, ' ') AS text FROM w")
def html_body_words(spark, d):
    words = html.body_words(F.col("html"))
    return table(spark, d, "pages").select("page_id", F.size(words).cast("long").alias("n_words"), F.array_join(words, " ").alias("text"))


@query(r"WITH t AS (SELECT unnest(regexp_extract_all(html, '<([A-Za-z][A-Za-z0-9]*)[ \t\n\r>/]', 1)) AS tag FROM pages) SELECT lower(tag) AS tag, count(*) AS n FROM t GROUP BY 1")
def html_tag_histogram(spark, d):
    return table(spark, d, "pages").select(F.explode(html.tag_names(F.col("html"))).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


_LINKS = """l AS (SELECT page_id, url, regexp_extract_all(html, '<a [^>]*?href[^">]*"([^"]+)"', 1) AS found FROM pages),
    f AS (SELECT page_id, url, generate_subscripts(found, 1) - 1 AS ord, unnest(found) AS rel FROM l),
    x AS (SELECT page_id, url, ord, CASE WHEN starts_with(rel, '//') THEN 'https:' || rel WHEN starts_with(rel, '/') THEN regexp_extract(url, '^[a-z]+://[^/]*', 0) || rel WHEN starts_with(rel, '#') THEN url || rel ELSE rel END AS dst FROM f)"""


def _links(spark, d) -> DataFrame:
    rows = table(spark, d, "pages").select("page_id", "url", F.posexplode(html.out_links(F.col("html"))).alias("ord", "rel"))
    return rows.select("page_id", "url", F.col("ord").cast("long").alias("ord"), U.fix_relative(F.col("url"), F.col("rel")).alias("dst"))


@query(f"WITH {_LINKS} SELECT page_id, ord, dst FROM x")
def page_outlinks(spark, d):
    return _links(spark, d).select("page_id", "ord", "dst")


@query(f"WITH {_LINKS} SELECT dst AS dst_url, count(*) AS n_links, count(DISTINCT url) AS n_pages FROM x GROUP BY 1")
def link_indegree(spark, d):
    return crawl.indegree(_links(spark, d).select(F.col("url").alias("src_url"), F.col("dst").alias("dst_url")))


@query(f"WITH {_LINKS} SELECT page_id, count(*) AS n FROM x GROUP BY 1 HAVING count(*) <= 8")
def fanout_filter(spark, d):
    links = F.transform(html.out_links(F.col("html")), lambda x: F.struct(x.alias("url"), F.array().cast("array<string>").alias("anchor")))
    parsed = table(spark, d, "pages").select(F.col("page_id").cast("string").alias("url"), F.lit("").alias("base"), links.alias("links"))
    out = crawl.outlinks(parsed, replace(DEFAULT, links_per_page=8))
    return out.groupBy(F.col("src_url").cast("long").alias("page_id")).agg(F.count("*").alias("n"))


@query()
def page_parse(spark, d):
    """The exact tokeniser; not a regular language, so no SQL."""
    p = html.parse_pages(table(spark, d, "pages"))
    return p.select("page_id", "url", "base", F.size("title_words").alias("n_title"), F.size("words").alias("n_words"), F.size("links").alias("n_links"))


@query()
def page_anchor_text(spark, d):
    links = crawl.outlinks(html.parse_pages(table(spark, d, "pages")))
    return links.select("src_url", "ord", "dst_url", F.array_join("anchor", " ").alias("anchor"))


@query()
def page_search(spark, d):
    """Search over pages, parsed by the exact tokeniser."""
    p = html.parse_pages(table(spark, d, "pages")).select(F.col("page_id").alias("doc_id"), "url", "title_words", "words")
    return search.top(index.build(p), parse("the and"))


# -- the crawl ------------------------------------------------------------------------

_RULES = [("disallow", "/de/"), ("allow", "/de/*1$"), ("disallow", "/*page=2"), ("allow", "/fr/8")]


def _host_urls(spark, d) -> DataFrame:
    return table(spark, d, "pages").select("page_id", "url", U.parse(F.col("url"))["host"].alias("host"))


@query(f"""WITH {_URLS}, r AS (SELECT page_id, url, host, '/' || path AS path FROM u)
    SELECT url, CASE WHEN NOT contains(host, 'example') OR ends_with(host, '.org') THEN false WHEN regexp_matches(path, '^/de/.*1$') OR regexp_matches(path, '^/fr/8') THEN true
    ELSE NOT (regexp_matches(path, '^/de/') OR regexp_matches(path, '^/.*page=2')) END AS allowed FROM r""")
def robots_allowed(spark, d):
    rows = _host_urls(spark, d)
    body = "User-agent: other\nDisallow: /\nUser-agent: *\n" + "".join(f"{k.title()}: {r}\n" for k, r in _RULES)
    files = rows.where("host LIKE '%example%' AND NOT host LIKE '%.org'").select("host").distinct().withColumn("content", F.lit(body))
    return crawl.robots_allowed(rows.select("url"), crawl.robots_rules(files))


@query("SELECT url, CAST(max(s) AS INTEGER) AS score FROM (SELECT url, " + f"CASE WHEN contains(url, '://') THEN {_BASE} - 4 - len(url) ELSE 10 END AS s FROM pages) GROUP BY url ORDER BY score DESC, url LIMIT 50")
def frontier_topk(spark, d):
    rows = table(spark, d, "pages").select("url", U.priority(F.col("url")).alias("score")).distinct()
    return crawl.frontier_top(rows, 50)


@query(f"""WITH b AS (SELECT * FROM (SELECT DISTINCT url, CAST(CASE WHEN contains(url, '://') THEN {_BASE} - 4 - len(url) ELSE 10 END AS INTEGER) AS score FROM pages) ORDER BY score DESC, url LIMIT 1200),
    g AS (SELECT *, (row_number() OVER (ORDER BY score DESC, url) - 1) // 3 AS grp FROM b)
    SELECT url, score, grp, row_number() OVER (PARTITION BY grp ORDER BY md5(url), url) = 1 AS picked FROM g""")
def frontier_group_pick(spark, d):
    rows = table(spark, d, "pages").select("url", U.priority(F.col("url")).alias("score")).distinct()
    return crawl.frontier_pick(rows)


@query(f"WITH {_URLS} SELECT page_id, url, host FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY page_id) AS rn FROM u) WHERE rn <= 2")
def host_cap(spark, d):
    rows = _host_urls(spark, d).withColumn("arrival", F.col("page_id"))
    return crawl.host_cap(rows, 2).select("page_id", "url", "host")


@query("SELECT DISTINCT url FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 3 = 0)")
def seen_antijoin(spark, d):
    pages = table(spark, d, "pages")
    return crawl.not_seen(pages.select("url"), pages.where("page_id % 3 = 0"))


@query("""WITH RECURSIVE r AS (SELECT 'https://r.org/' || o_orderkey AS src, CASE WHEN o_orderkey % 11 = 0 THEN 'http://r.org/x' ELSE 'https://r.org/' || (o_orderkey + 1 + o_orderkey % 3) END AS dst FROM orders WHERE o_orderkey % 7 <> 0),
    e AS (SELECT * FROM r WHERE len(dst) < 200 AND contains(dst, 'https://')),
    w AS (SELECT src, dst AS final, 1 AS hops FROM e UNION ALL SELECT w.src, e.dst, hops + 1 FROM w JOIN e ON e.src = w.final WHERE hops < 5),
    l AS (SELECT src, arg_max(final, hops) AS final, max(hops) AS hops FROM w GROUP BY 1)
    SELECT l.src, CASE WHEN e.src IS NULL THEN final END AS final, CAST(hops AS INTEGER) AS hops FROM l LEFT JOIN e ON e.src = l.final""")
def redirect_resolve(spark, d):
    k = F.col("o_orderkey")
    url = lambda c: F.concat(F.lit("https://r.org/"), c.cast("string"))
    rows = table(spark, d, "orders").where(k % 7 != 0).select(url(k).alias("src"), F.when(k % 11 == 0, "http://r.org/x").otherwise(url(k + 1 + k % 3)).alias("dst"))
    return crawl.resolve_redirects(rows)


@query()
def crawl_rounds(spark, d):
    """A simulated crawl from all pages until the frontier is empty; iterative, so no SQL:
    a test holds it against a Python model."""
    pages = table(spark, d, "pages")
    return crawl.crawl_rounds(html.parse_pages(pages), pages.select("url"), per_round=DEFAULT.pick_count)


@query()
def stream_new_urls(spark, d):
    """The streaming seen set and host cap over ``pages`` as a file stream."""
    from lexspark.streaming import crawl as stream

    out = f"{shared_root(spark)}/stream-{uuid.uuid4().hex}"
    pages = stream.url_stream(spark, f"{d}/pages.parquet*")
    stream.run_to_table(stream.capped(stream.new_urls(pages), 5), f"{out}/urls", f"{out}/state")
    return spark.read.parquet(f"{out}/urls")
