"""Contracts on the number of rows: kept by the write itself, without a second scan."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def required(key: Column, name: str) -> Column:
    """The key; fails on rows that lack it, where a plain join would lose them unseen."""
    return F.when(key.isNull() | (key.cast("string") == ""), F.raise_error(F.lit(f"a row lacks its {name}")).cast("string")).otherwise(key.cast("string"))


def record_index(rows: DataFrame, key: str) -> DataFrame:
    """rows with their key, which none may lack, and occ, the how-manieth row of its key each is by pos."""
    from sievecraft.operators.joins import with_occurrence

    return with_occurrence(rows.withColumn(key, required(F.col(key), key)), key, "pos")


def write_counted(df: DataFrame, path: str, least: int = 0, exactly: int | None = None) -> int:
    """Writes Parquet and returns the number of rows, counted as they were written.

    Fewer rows than `least`, or others than `exactly` so many, are an error, and then nothing is at the path: the files are
    written beside it and take their name when the count is right.
    """
    spark, seen, beside = df.sparkSession, Observation(), f"{path}.{uuid.uuid4().hex}.part"
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(beside)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    own, target = hadoop(beside), hadoop(path)
    fs = own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    n = seen.get["n"]
    if n < least or exactly is not None and n != exactly:
        fs.delete(own, True)
        raise ValueError(f"{n} rows for {path}, not {exactly if exactly is not None else f'{least} at least'}")
    if fs.exists(target) or not fs.rename(own, target):
        fs.delete(own, True)
        raise ValueError(f"{path} is there already")
    return n
