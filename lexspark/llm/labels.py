"""Labelled rows for the classifiers: folds and bounded, class-balanced samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; fold 0 is held out."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """Up to ``per_class`` rows of each class outside fold 0 (those of the smallest id
    hashes), with the text: ``doc_id, text, n_chars, y``. The sample of ids is bounded by
    ``2 * per_class``, so it is broadcast against the documents."""
    rows = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
        .where(fold(F.col("doc_id")) != 0)
        .groupBy("doc_id")
        .agg(F.max(label).alias("y"))
    )
    order = F.xxhash64("doc_id")
    picked = None
    for y in (0, 1):
        part = rows.where(F.col("y") == y).orderBy(order, "doc_id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    chosen = picked.select(F.col("doc_id").alias("_id"), "y")
    chars = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return docs.select("doc_id", "text", chars.alias("n_chars")).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).drop("_id")
