"""What the operators of this subpackage share."""

from __future__ import annotations

import gc
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexspark.workers import shared_root, ship


def map_batches(
    df: DataFrame,
    fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    schema: str | StructType,
) -> DataFrame:
    """``mapInArrow`` with the package sent along."""
    ship(df.sparkSession)
    return df.mapInArrow(fn, schema)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """A string column as Python strings, null as the empty text."""
    return ["" if x is None else x for x in batch.column(column).to_pylist()]


def text_bytes(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """A string column as UTF-8 bytes, null as the empty text."""
    return [b"" if x is None else x for x in batch.column(column).cast(pa.binary()).to_pylist()]


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder in the one that all executors share."""
    return f"{shared_root(spark)}/{uuid.uuid4().hex}"


def _release(spark: SparkSession) -> None:
    """Spark removes the shuffle files of plans that the driver's JVM has collected; it
    is asked to collect. What the first time finds is let go by the second."""
    for k in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        if not k:
            time.sleep(0.2)


_BATCH = "spark.sql.parquet.columnarReaderBatchSize"
#: Rows that a scan holds decoded at a time: texts of some kilobytes are tens of megabytes
#: a task at Spark's 4096, which a heap of 1 GB and eight tasks don't have.
ROWS = 512
#: Bytes of a row group: a task holds one of each file that it reads or writes.
_GROUPS = {"compression": "zstd", "parquet.block.size": 16 << 20}


@contextmanager
def small_batches(spark: SparkSession):
    """Tables written in here are read ``ROWS`` rows at a time, or fewer where the session
    says so."""
    known = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, min(int(known), ROWS))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, known)


def stored(df: DataFrame, release: bool = True) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later steps restart
    from the table, not from the start of the lineage, when an executor is lost.
    ``release``: let go of the shuffle files behind it."""
    spark = df.sparkSession
    path = shared_dir(spark)
    with small_batches(spark):
        df.write.options(**_GROUPS).parquet(path)
    schema = df.schema
    del df
    if release:
        _release(spark)
    out = spark.read.schema(schema).parquet(path)
    out._lexspark_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``stored`` and ``placed`` that nothing lazy reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._lexspark_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def whole(docs: DataFrame) -> Column | None:
    """The columns of a row as one, or None where Parquet can't keep them all."""
    if any(bad in kind for _, kind in docs.dtypes for bad in ("void", "interval")):
        return None
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns])


def placed(df: DataFrame, key: str, groups: int, once: bool = False) -> DataFrame:
    """``df`` as a table in buckets by ``key``: groupings by the key read it without a
    shuffle, however often. The table's name goes at once; its files stay. ``once``: of
    rows of one key any one stays; rows are only sorted where their key lies, as a sort
    beside the scan of full rows doesn't fit a small heap."""
    spark = df.sparkSession
    most = int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets"))
    n = max(1, min(groups, most))
    name = f"lexspark_{uuid.uuid4().hex}"
    path = shared_dir(spark)
    with small_batches(spark):
        rows = df.repartition(n, key)
        rows = rows.dropDuplicates([key]) if once else rows
        rows.write.bucketBy(n, key).sortBy(key).option("path", path).options(**_GROUPS).saveAsTable(name)
        del rows
    del df
    out = spark.table(name)
    out.schema  # resolved before the name goes
    spark.sql(f"DROP TABLE {name}")
    _release(spark)
    out._lexspark_path = path
    return out
