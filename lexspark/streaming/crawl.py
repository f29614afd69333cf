"""The crawl on Structured Streaming: new URLs once, and a running count per host.

Finding links feeds the frontier that fetches them, so a whole crawl is not one stream:
each batch appends to a table that the next one reads. Within a stream, the seen set is
``dropDuplicates`` state and the host cap keyed state; offsets and state are recovered
from the checkpoint location.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lexspark.functions import urls as U
from lexspark.workers import ship


def url_stream(spark: SparkSession, path: str, schema: str = "page_id long, url string, html string", per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def new_urls(stream: DataFrame) -> DataFrame:
    """Each URL once over the whole stream, with its host and priority."""
    u = F.col("url")
    return stream.select("url", U.parse(u)["host"].alias("host"), U.priority(u).alias("score")).dropDuplicates(["url"])


def capped(stream: DataFrame, cap: int) -> DataFrame:
    """The first ``cap`` URLs of each host; the count is the host's state."""
    ship(stream.sparkSession)

    def admit(key, parts, state: GroupState):
        n = state.get[0] if state.exists else 0
        for pdf in parts:
            room = max(0, cap - n)
            n += len(pdf)
            yield pd.DataFrame({"host": pdf["host"][:room], "url": pdf["url"][:room]})
        state.update((n,))

    return stream.groupBy("host").applyInPandasWithState(admit, "host string, url string", "n long", "append", GroupStateTimeout.NoTimeout)


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> None:
    """All that is available, appended to a Parquet table exactly once."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
