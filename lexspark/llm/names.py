"""Names of rows: 64-bit integers in the order of doc_id, one for each document.

Where ids tell all texts apart, an id is its own name (null: the least integer). Where
rows share an id (or have none) but not the text, each different text is a document of
its own, after those of smaller ids and in the order of a hash of the text; rows equal
in both are one document.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.llm.common import small_batches, stored

NONE = -(2**63)


@dataclass
class Names:
    id_col: str
    text_col: str
    #: Bytes of all texts.
    total: int
    #: ``doc, hash, name`` where ids don't tell texts apart, else None.
    order: DataFrame | None
    #: Whether a name may have several rows.
    twins: bool = False

    def groups(self, size: int) -> int:
        """The number of groups of ``size`` bytes of text."""
        return max(1, -(-self.total // size))

    def _keys(self) -> tuple[Column, Column]:
        text = F.coalesce(F.col(f"`{self.text_col}`"), F.lit(""))
        return F.coalesce(F.col(f"`{self.id_col}`").cast("long"), F.lit(NONE)), F.xxhash64(text, F.octet_length(text))

    def of(self, docs: DataFrame, *columns: Column) -> DataFrame:
        """``name`` and the columns asked for, of each row."""
        doc, text = self._keys()
        if self.order is None:
            return docs.select(doc.alias("name"), *columns)
        rows = docs.select(doc.alias("doc"), text.alias("hash"), F.struct(*columns).alias("row"))
        return rows.join(self.order, ["doc", "hash"]).select("name", "row.*")

    def back(self, df: DataFrame, **columns: str) -> DataFrame:
        """``df`` with ids (null where there was none) in place of names: result=name column."""
        for out, name in columns.items():
            if self.order is None:
                df = df.withColumn(out, F.when(F.col(name) != NONE, F.col(name)))
            else:
                ids = self.order.select(F.col("name").alias("_name"), F.when(F.col("doc") != NONE, F.col("doc")).alias("_id"))
                df = df.join(ids, F.col(name) == F.col("_name")).drop("_name").withColumnRenamed("_id", out)
        return df


def names(docs: DataFrame, id_col: str, text_col: str) -> Names:
    out = Names(id_col, text_col, 0, None)
    doc, text = out._keys()
    rows = docs.select(doc.alias("doc"), text.alias("hash"), F.octet_length(f"`{text_col}`").alias("n"))
    each = rows.groupBy("doc").agg(F.min("hash").alias("a"), F.max("hash").alias("b"), F.sum("n").alias("n"), F.count("*").alias("rows"))
    with small_batches(docs.sparkSession):
        total, different, most = each.agg(F.sum("n"), F.max(F.col("a") != F.col("b")), F.max("rows")).first()
    out.total, out.twins = total or 0, (most or 0) > 1
    if different:
        # Ids of partitions and rows grow along the sorted table.
        out.order = stored(rows.select("doc", "hash").distinct().orderBy("doc", "hash").withColumn("name", F.monotonically_increasing_id()))
    return out
