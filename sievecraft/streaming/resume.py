"""Appending and resuming: new (query, teacher) pairs are added once, in batches or as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def not_done(rows: DataFrame, done: DataFrame | None, keys: list[str]) -> DataFrame:
    """Last row of each key by pos that is not among the done ones."""
    rest = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "pos").alias("_row")).select(*keys, "_row.*")
    return last if done is None else last.join(done.select(*keys).distinct(), keys, "left_anti")


def append_new(rows: DataFrame, path: str, keys: list[str], partition_by: list[str]) -> None:
    """Adds the rows whose keys the table at path lacks. A table that is not there yet is begun."""
    spark = rows.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    done = spark.read.parquet(path) if where.getFileSystem(conf).exists(where) else None
    not_done(rows, done, keys).write.mode("append").partitionBy(*partition_by).parquet(path)


def append_stream(rows: DataFrame, path: str, checkpoint: str, keys: list[str], partition_by: list[str]) -> StreamingQuery:
    """The same for a stream: each micro-batch is appended once, whatever fails in between."""
    return rows.writeStream.foreachBatch(lambda batch, _: append_new(batch, path, keys, partition_by)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
