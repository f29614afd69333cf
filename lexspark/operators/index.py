"""The positional two-field index as DataFrames.

``docs``: url, title, abstract, first and last place of each document in its chunk.
``postings``: one row per occurrence (chunk, field, term, document, place).
``term_stats`` and ``chunk_stats``: counts. Chunks are ranges of document ids, so
numbering them needs no global sort; places run within a chunk: title words, body
words, then one place for the document's end.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexspark.config import DEFAULT, Config
from lexspark.functions import text as T


@dataclass
class Index:
    docs: DataFrame
    postings: DataFrame
    config: Config = DEFAULT
    #: Statistics kept with the index; counted from the postings where there are none.
    terms: DataFrame | None = None
    chunks: DataFrame | None = None

    @property
    def term_stats(self) -> DataFrame:
        """Occurrences and documents of each term by chunk and field."""
        if self.terms is not None:
            return self.terms
        each = self.postings.groupBy("chunk_id", "field", "term", "doc_id").agg(F.count("*").alias("n"))
        return each.groupBy("chunk_id", "field", "term").agg(F.sum("n").cast("long").alias("n_posts"), F.count("*").alias("n_docs"))

    @property
    def chunk_stats(self) -> DataFrame:
        """Places (document ends included), distinct keys and documents of each chunk."""
        if self.chunks is not None:
            return self.chunks
        terms = self.term_stats.groupBy("chunk_id").agg(F.sum("n_posts").alias("n"), F.count("*").alias("k"))
        docs = self.docs.groupBy("chunk_id").agg(F.count("*").alias("n_docs"))
        return docs.join(terms, "chunk_id", "left").select(
            "chunk_id", (F.coalesce("n", F.lit(0)) + F.col("n_docs")).cast("long").alias("n_posts"), (F.coalesce("k", F.lit(0)) + 1).cast("long").alias("n_unique"), "n_docs"
        )

    def kept(self) -> Index:
        """The index with its tables and statistics in Spark's cache; see ``release``."""
        ix = Index(self.docs.persist(), self.postings.persist(), self.config)
        ix.terms = ix.term_stats.persist()
        ix.chunks = ix.chunk_stats.persist()
        return ix

    def release(self) -> None:
        for df in (self.chunks, self.terms, self.postings, self.docs):
            if df is not None:
                df.unpersist()

    def write(self, path: str) -> None:
        """Postings and term statistics by chunk, sorted by term, so that a term's scan
        skips row groups; and the statistics of chunks."""
        self.docs.write.partitionBy("chunk_id").mode("overwrite").parquet(f"{path}/docs")
        rows = self.postings.repartition("chunk_id", "field", F.substring("term", 1, 2)).sortWithinPartitions("field", "term", "loc")
        rows.write.partitionBy("chunk_id").mode("overwrite").parquet(f"{path}/postings")
        written = Index.read(self.docs.sparkSession, path, self.config, stats=False)
        terms = written.term_stats.repartition("chunk_id").sortWithinPartitions("field", "term")
        terms.write.partitionBy("chunk_id").mode("overwrite").parquet(f"{path}/terms")
        Index.read(self.docs.sparkSession, path, self.config, stats=False, terms=True).chunk_stats.write.mode("overwrite").parquet(f"{path}/chunks")

    @staticmethod
    def read(spark, path: str, config: Config = DEFAULT, stats: bool = True, terms: bool = False) -> Index:
        ix = Index(spark.read.parquet(f"{path}/docs"), spark.read.parquet(f"{path}/postings"), config)
        if stats or terms:
            ix.terms = spark.read.parquet(f"{path}/terms")
        if stats:
            ix.chunks = spark.read.parquet(f"{path}/chunks")
        return ix


def build(parsed: DataFrame, config: Config = DEFAULT, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> Index:
    """From ``doc_id, url, title_words, words`` (arrays of lower-case words). ``keep``
    persists (or writes and rereads) the parsed rows, which several steps read."""
    title = T.short_words(F.col("title_words"), config.token_limit - 1)
    body = T.short_words(F.col("words"), config.token_limit)
    later = F.filter("words", lambda w, i: (i >= config.abstract_from) & (F.length(w) < config.token_limit))
    docs = parsed.select(
        F.floor(F.col("doc_id") / config.docs_per_chunk).cast("int").alias("chunk_id"),
        "doc_id",
        "url",
        title.alias("title_terms"),
        body.alias("terms"),
        T.fitting_prefix(title, config.title_limit).alias("title"),
        # No more words than characters can fit.
        T.fitting_prefix(F.slice(later, 1, config.abstract_limit), config.abstract_limit).alias("abstract"),
        F.size("title_words").alias("num_title_words"),
    ).withColumn("n_tokens", (F.size("title_terms") + F.size("terms")).cast("long"))
    docs = keep(docs)
    order = Window.partitionBy("chunk_id").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, 0)
    # Only counts pass through the window; the words join after it.
    places = docs.select("chunk_id", "doc_id", "n_tokens").withColumn("doc_end", F.sum(F.col("n_tokens") + 1).over(order)).select("chunk_id", "doc_id", "doc_end")
    placed = docs.join(places, ["chunk_id", "doc_id"]).withColumn("doc_start", F.col("doc_end") - F.col("n_tokens"))
    # One pass over both fields: the title's words come first.
    rows = placed.select("chunk_id", "doc_id", "doc_start", F.size("title_terms").alias("nt"), F.posexplode(F.concat("title_terms", "terms")).alias("pos", "term"))
    field = F.when(F.col("pos") < F.col("nt"), "title").otherwise("body")
    postings = rows.select("chunk_id", field.alias("field"), "term", "doc_id", (F.col("doc_start") + F.col("pos")).alias("loc"))
    return Index(placed.drop("title_terms", "terms"), postings, config)


#: Bytes of stored documents whose words make one partition (some seven times as much).
PART = 16 << 20


def spread(documents: DataFrame) -> DataFrame:
    """``documents`` over all cores, and in more partitions the larger their files are."""
    size = documents._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return documents.repartition(max(documents.sparkSession.sparkContext.defaultParallelism, -(-int(size) // PART)))


def parse_documents(documents: DataFrame) -> DataFrame:
    """``documents`` as pages: the title is made of the first six raw words."""
    raw = T.raw_words(F.coalesce("text", F.lit("")))
    return documents.select(
        "doc_id",
        F.concat(F.lit("https://www."), "source", F.lit(".com/"), "lang", F.lit("/"), F.col("doc_id").cast("string")).alias("url"),
        T.keep_words(F.slice(raw, 1, 6)).alias("title_words"),
        T.keep_words(raw).alias("words"),
    )


def deltas(postings: DataFrame) -> DataFrame:
    """Gaps between the places of a term, with their variable-length code."""
    by = Window.partitionBy("chunk_id", "field", "term").orderBy("loc")
    gap = F.col("loc") - F.lag("loc", 1, 0).over(by)
    return postings.withColumn("delta", gap).withColumn("n_bytes", T.varint_length(F.col("delta"))).withColumn("code", T.varint_hex(F.col("delta")))


def undelta(coded: DataFrame) -> DataFrame:
    """Places from gaps: the running sum in order."""
    by = Window.partitionBy("chunk_id", "field", "term").orderBy("loc").rowsBetween(Window.unboundedPreceding, 0)
    return coded.withColumn("decoded", F.sum(T.varint_decode(F.col("code"))).over(by))


def document_of(docs: DataFrame, places: DataFrame) -> DataFrame:
    """The document that holds each place (``chunk_id, loc``): the first end at or after
    it. Ends and places are merged in one sorted pass; places beyond the last end go."""
    ends = docs.select("chunk_id", F.col("doc_end").alias("at"), "doc_id", F.lit(1).alias("end"))
    asked = places.select("chunk_id", F.col("loc").alias("at"), F.lit(None).cast(dict(docs.dtypes)["doc_id"]).alias("doc_id"), F.lit(0).alias("end"))
    # From the back, so that the frame grows row by row.
    back = Window.partitionBy("chunk_id").orderBy(F.desc("at"), F.desc("end")).rowsBetween(Window.unboundedPreceding, 0)
    both = ends.unionByName(asked).withColumn("doc_id", F.last("doc_id", ignorenulls=True).over(back))
    return both.where("end = 0 AND doc_id IS NOT NULL").select("chunk_id", F.col("at").alias("loc"), "doc_id")
