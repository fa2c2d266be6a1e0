"""Counters of a stream kept in a table, so that a batch that comes again changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


def put_batch(counts: DataFrame, batch_id: int, path: str) -> None:
    """The rows of one micro-batch, in a folder of its number: putting it again replaces it."""
    counts.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def write_counters(counts: DataFrame, path: str, mode: str = "update") -> StreamingQuery:
    """Run a stream of counters (labels, count) to the end of what is there, each micro-batch into the table at path. In `update` mode a
    batch holds the counters that changed, in `complete` mode all. Started again it goes on where it stopped; a batch that was being
    written then comes again under its number."""
    put = lambda df, batch_id: put_batch(df, batch_id, path)
    return counts.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start()


def read_counters(spark: SparkSession, path: str, labels: list[str], schema: str, mode: str = "update") -> DataFrame:
    """The counters as they are now: of each label set the value of its latest batch, or all of the latest batch."""
    rows = spark.read.schema(f"{schema}, batch long").parquet(path)
    if mode == "complete":
        return rows.join(F.broadcast(rows.agg(F.max("batch").alias("batch"))), "batch").drop("batch")
    return rows.groupBy(*labels).agg(F.max_by("count", "batch").alias("count"))
