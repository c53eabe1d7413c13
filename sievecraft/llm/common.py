"""Shared helpers: shared-folder tables, Arrow batches cut by bytes, ragged gathers."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievecraft.sources.records import spread

#: Text bytes that one step of a Python worker holds; a longer text is a step of its own.
SLAB_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; texts of few splits are dealt over all cores."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name in ("documents", "pages") else rows


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); a temporary one where it is unset and Spark runs on one machine."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        at = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(at)
    return at


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended
        pass


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sieve-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_delete, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more."""
    for t in tables:
        _delete(t.sparkSession, t.written_to)


def release(spark: SparkSession) -> None:
    """Lets the shuffle files of ended jobs go, which Spark keeps until the driver's garbage is collected."""
    gc.collect()  # Python's references first
    spark.sparkContext._jvm.System.gc()


#: A key with at least 1 / HOT_SHARE of a join's rows is hot; there are at most HOT_SHARE such keys.
HOT_SHARE = 1000


def join_hot(rows: DataFrame, known: DataFrame, key: str | list[str]) -> DataFrame:
    """rows joined with `known`, which has each key once and c, the number of rows that bear it (c does not come along).

    At most HOT_SHARE keys are hot: their rows of `known` are broadcast, so their rows stay where they are; all
    others meet by a shuffle. Both inputs are read twice, so they should be written tables.
    """
    total = known.agg(F.sum("c").alias("n")).first()["n"] or 0
    least = max(2, -(-total // HOT_SHARE))
    hot = known.where(F.col("c") >= least).drop("c")
    common = rows.join(F.broadcast(hot), key)
    keys = [key] if isinstance(key, str) else key
    rest = rows.join(F.broadcast(hot.select(*keys)), key, "left_anti").join(known.where(F.col("c") < least).drop("c").hint("merge"), key)
    return common.unionByName(rest)


def fresh_name(name: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name = f"{name}_"
    return name


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per application, so that they need no copy of their own."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        package = Path(__file__).resolve().parents[1]
        to = shutil.make_archive(f"{tempfile.mkdtemp(prefix='spark-package-')}/{package.name}", "zip", package.parent, package.name)
        spark.sparkContext.addPyFile(to)
        _shipped.add(app)


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow(run, schema) where executors know this package."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def slabs(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLAB_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that each holds at most `limit` bytes of text, or one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if i > start and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(n)
        if start < batch.num_rows:
            yield batch.slice(start)


def texts(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """The text column without nulls (null: empty)."""
    return pc.fill_null(batch.column(column), "")


def list_parts(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Values of a list array and the number of values of each list."""
    return lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)


def offsets_of(lengths: np.ndarray) -> np.ndarray:
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def ragged_take(values: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenates values[offsets[r]:offsets[r + 1]] for each r of rows; also returns the lengths."""
    lengths = offsets[rows + 1] - offsets[rows]
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    at = np.arange(total, dtype=np.int64) + np.repeat(offsets[rows] - (ends - lengths), lengths)
    return values[at], lengths


def sums_by_row(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sum of consecutive runs of values; empty runs give 0."""
    total = np.zeros(len(values) + 1, values.dtype if values.dtype.kind == "i" else np.float64)
    np.cumsum(values, out=total[1:])
    at = offsets_of(lengths)
    return total[at[1:]] - total[at[:-1]]


def sampled(labels: DataFrame, most: int) -> DataFrame:
    """At most `most` labels (key, y), those with the least hash of the key: small enough to broadcast."""
    return labels.where(F.col("key").isNotNull()).groupBy("key").agg(F.max("y").alias("y")).orderBy(F.xxhash64("key"), "key").limit(most)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, turns: int = 30) -> np.ndarray:
    """Coefficients of a ridge logistic regression by Newton steps; the first column is the intercept."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(turns):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += np.clip(step, -5, 5)
    return w
