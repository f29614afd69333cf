"""Parsed-document files: url, two counts, #title words, body words, one per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.functions import urls as U


def read_parsed(spark: SparkSession, path: str) -> DataFrame:
    """All ``.txt`` files of a folder: ``doc_id`` (their order by name within 2**33 per
    input partition), ``url, title_words, words``. Malformed files (no counts) go."""
    files = spark.read.option("pathGlobFilter", "*.txt").text(path, wholetext=True)
    lines = F.split(F.rtrim(F.col("value"), F.lit("\n")), "\n")
    rows = files.select(F.monotonically_increasing_id().alias("doc_id"), lines.alias("l"))
    rows = rows.select("doc_id", "l", F.get("l", F.lit(0)).alias("url"), F.get("l", F.lit(1)).try_cast("int").alias("nt"), F.get("l", F.lit(2)).try_cast("int").alias("nb"))
    title = F.transform(F.slice("l", F.lit(4), F.col("nt")), lambda w: F.regexp_replace(w, "^#", ""))
    return rows.where("nt >= 0 AND nb >= 0").select("doc_id", "url", title.alias("title_words"), F.slice("l", 4 + F.col("nt"), F.col("nb")).alias("words"))


def to_lines(parsed: DataFrame) -> DataFrame:
    """``key`` (a file name) and ``value`` (the file's text) of parsed documents."""
    head = F.array(F.col("url"), F.size("title_words").cast("string"), F.size("words").cast("string"))
    body = F.concat(head, F.transform("title_words", lambda w: F.concat(F.lit("#"), w)), F.col("words"))
    return parsed.select(U.doc_key(F.col("url")).alias("key"), F.concat(F.array_join(body, "\n"), F.lit("\n")).alias("value"))


def write_parsed(parsed: DataFrame, path: str) -> None:
    """One file per document, in a folder named by its key."""
    to_lines(parsed).withColumn("value", F.regexp_replace("value", "\n$", "")).write.partitionBy("key").mode("overwrite").text(path)
