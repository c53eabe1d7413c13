"""Components of a graph of similar items."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """Writes df as Parquet to the cluster's shared folder and reads it again: cuts the lineage, and runs what leads to it once,
    where a Dataset's checkpoint runs it twice. The folder is a temporary one where spark.checkpoint.dir is unset and Spark runs
    on one machine; the rows are deleted when the application ends."""
    spark = df.sparkSession
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        at = tempfile.mkdtemp(prefix="spark-checkpoint-")
        sc.setCheckpointDir(at)
    path = f"{at}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_delete, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended
        pass


#: A label with at least 1 / HOT of the nodes is hot; there are at most HOT of them.
HOT = 1000


def _further(step: DataFrame) -> DataFrame:
    """step (node, component, old) with further, the label of each one's label. One label may be that of most nodes: labels
    are looked up once each, and what the hot ones have is broadcast, so that their nodes stay where they are."""
    counts = step.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    up = checkpointed(counts.join(step.select(F.col("node").alias("component"), F.col("component").alias("further")), "component"))
    least = max(2, -(-(up.agg(F.sum("n")).first()[0] or 0) // HOT))
    hot = F.broadcast(up.where(F.col("n") >= least).drop("n"))
    rest = step.join(hot.select("component"), "component", "left_anti").join(up.where(F.col("n") < least).drop("n"), "component")
    return step.join(hot, "component").unionByName(rest)


def min_labels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and component, the smallest node reachable over edges (a, b); nodes without edges stand alone.

    Each round takes the least label among neighbours and then that label's own label, so that long chains
    shrink by half; it ends when nothing changes.
    """
    both = checkpointed(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = checkpointed(nodes.select("node").distinct().withColumn("component", F.col("node")))
    while True:
        low = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("low"))
        step = labels.join(low, labels["node"] == low["a"], "left").select("node", F.least("component", F.coalesce("low", "component")).alias("component"), F.col("component").alias("old"))
        step = checkpointed(_further(checkpointed(step)).select("node", F.least("component", "further").alias("component"), "old"))
        if step.where("component <> old").isEmpty():
            return step.select("node", "component")
        labels = step.select("node", "component")
