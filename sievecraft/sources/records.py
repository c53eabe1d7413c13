"""Scans and sinks of loosely structured records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fields that may hold the records of a JSON document.
CONTAINERS = ("records", "data", "items", "examples", "rows", "queries", "predictions")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Rows of a scan of few splits dealt over all cores, before costly work on each; scans of more splits than cores stay as
    they are. Not for joined or grouped rows: to count their partitions would run them."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() <= cores else rows


def scan_jsonl(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """record (VARIANT), file and raw of each non-blank line; record is null where a line is no JSON."""
    rows = spark.read.text(path).select(F.col("value").alias("raw"), F.col("_metadata.file_path").alias("file"))
    return rows.where(F.trim("raw") != "").withColumn("record", F.try_parse_json("raw"))


def strict(records: DataFrame) -> DataFrame:
    """Fails on the first line that is no JSON object."""
    bad = F.col("record").isNull() | ~F.schema_of_variant("record").startswith("OBJECT")
    return records.withColumn("record", F.when(bad, F.raise_error(F.concat(F.lit("not a JSON object: "), "raw"))).otherwise(F.col("record")))


def unwrap(document: Column, containers: tuple[str, ...] = CONTAINERS) -> Column:
    """Records of a JSON document: a list, the list in one of its container fields, or itself."""
    return F.coalesce(*[F.try_variant_get(document, p, "array<variant>") for p in ("$", *(f"$.{c}" for c in containers))], F.array(document))


def scan_json(spark: SparkSession, path: str, containers: tuple[str, ...] = CONTAINERS) -> DataFrame:
    """record and file of each record of whole-document JSON files; documents that are JSON lines are read as such."""
    whole = spark.read.text(path, wholetext=True).select(F.col("value").alias("raw"), F.col("_metadata.file_path").alias("file"))
    whole = whole.withColumn("document", F.when(F.col("raw").rlike(r"(?s)^\s*[\[{].*[\]}]\s*$") & ~F.col("raw").rlike(r"(?m)^\s*\}\s*\n\s*\{"), F.try_parse_json("raw")))
    lines = F.filter(F.transform(F.split("raw", "\n"), lambda s: F.try_parse_json(s)), lambda v: v.isNotNull())
    return whole.select("file", F.explode(F.when(F.col("document").isNotNull(), unwrap(F.col("document"), containers)).otherwise(lines)).alias("record"))


def scan(spark: SparkSession, path: str) -> DataFrame:
    """Records by suffix: .jsonl, .json, .parquet/.pq (each row as VARIANT), .csv (all columns text)."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind == "jsonl":
        return scan_jsonl(spark, path).select("record", "file")
    if kind == "json":
        return scan_json(spark, path)
    if kind in ("parquet", "pq"):
        rows = spark.read.parquet(path)
        return rows.select(F.parse_json(F.to_json(F.struct("*"))).alias("record"), F.col("_metadata.file_path").alias("file"))
    if kind == "csv":
        rows = spark.read.csv(path, header=True, inferSchema=False)
        return rows.select(F.parse_json(F.to_json(F.struct(*rows.columns))).alias("record"), F.col("_metadata.file_path").alias("file"))
    raise ValueError(f"unsupported suffix: {path}")


def get_path(record: Column, *paths: str, kind: str = "string") -> Column:
    """First value at one of the dotted paths that is neither missing, null nor empty text."""
    steps = ["$" + "".join(f"[{p}]" if p.isdigit() else f".{p}" for p in path.split(".")) for path in paths]
    found = [F.try_variant_get(record, step, kind) for step in steps]
    return F.coalesce(*[F.nullif(v, F.lit("")) if kind == "string" else v for v in found])


def scan_roots(spark: SparkSession, roots: list[str], skip: str | None = None) -> DataFrame:
    """Records of JSON lines below several folders, with the place of their folder among these (root), file and raw line;
    files whose path matches `skip` are left out."""
    out = None
    for k, root in enumerate(roots):
        part = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").text(root).select(F.col("value").alias("raw"), F.col("_metadata.file_path").alias("file"), F.lit(k).alias("root"))
        out = part if out is None else out.unionByName(part)
    out = out.where(F.trim("raw") != "")
    out = out.where(~F.col("file").rlike(skip)) if skip else out
    return out.withColumn("record", F.try_parse_json("raw"))


def scan_csv(spark: SparkSession, path: str) -> tuple[str, DataFrame | None]:
    """Status (ok, missing, empty) and the rows of a CSV file, all columns text: a report in place of an exception."""
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.csv(path, header=True, inferSchema=False)
    except AnalysisException:
        return "missing", None
    return ("ok", rows) if rows.columns else ("empty", None)


def table_value(rows: DataFrame, row_key: str, row_value: str, column: str) -> str | None:
    """The column's value in the first row whose key column has this value."""
    found = rows.where(F.col(row_key) == row_value).select(column).first()
    return found[0] if found else None


def union_splits(spark: SparkSession, pattern: str, splits: list[str]) -> DataFrame:
    """Records of all splits (a path pattern with {split}), each with the name of its own."""
    out = None
    for name in splits:
        part = scan(spark, pattern.format(split=name)).withColumn("split", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def write(df: DataFrame, path: str, least: int = 0, partition_by: list[str] | None = None, mode: str = "errorifexists") -> None:
    """Sink by suffix (.jsonl, .csv, else Parquet); fails when there are fewer rows than `least`."""
    if least and df.limit(least).count() < least:
        raise ValueError(f"fewer than {least} rows for {path}")
    out = df.write.mode(mode)
    out = out.partitionBy(*partition_by) if partition_by else out
    kind = path.rsplit(".", 1)[-1]
    out.json(path) if kind == "jsonl" else out.option("header", True).csv(path) if kind == "csv" else out.parquet(path)
