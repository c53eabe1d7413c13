"""Samples, splits, bootstrap intervals and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievecraft.functions.text import hash_order


def rate(part: Column, whole: Column) -> Column:
    """part / whole, null where there is nothing."""
    return F.try_divide(part, F.nullif(whole, F.lit(0)))


def stratified_sample(rows: DataFrame, stratum: str, key: str, n: int, seed: int = 13) -> DataFrame:
    """n rows, dealt to strata in proportion by largest remainders (ties: the greater stratum), rows in hash order."""
    sizes = rows.groupBy(stratum).agg(F.count(F.lit(1)).alias("c"))
    total = sizes.agg(F.sum("c").alias("total"))
    # One row per stratum from here on.
    shares = sizes.join(F.broadcast(total)).withColumn("base", F.least(F.col("c"), F.expr(f"({n} * c) div total"))).withColumn("rest", F.expr(f"({n} * c) % total"))
    left = shares.agg((F.lit(n) - F.sum("base")).alias("left"))
    ranked = shares.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("rest"), F.desc(stratum)))).join(F.broadcast(left))
    dealt = ranked.select(stratum, (F.col("base") + F.when((F.col("rank") <= F.col("left")) & (F.col("base") < F.col("c")), 1).otherwise(0)).alias("allocated"))
    ranked = hash_ranked(rows, key, seed, stratum)
    return ranked.join(F.broadcast(dealt), stratum).where("_rank <= allocated").drop("_rank", "allocated")


#: Buckets of hashes: what a bucket holds is ordered by itself, and the buckets' sizes give the places before it.
BUCKETS = 1 << 12


def hash_ranked(rows: DataFrame, key: str, seed: int, *group: str) -> DataFrame:
    """Adds _rank, the place (from 1) of a row in the order of its key's hash, among all or in each group of few groups.

    No group is sorted in one task: a window orders one bucket of hashes, and BUCKETS sizes a group are summed up.
    """
    h = hash_order(seed, F.col(key))
    rows = rows.withColumn("_h", h).withColumn("_b", F.floor(F.col("_h") / (2**32 // BUCKETS)).cast("int"))
    sizes = rows.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    before = sizes.select(*group, "_b", F.coalesce(upto, F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*group, "_b").orderBy("_h", key))
    return rows.withColumn("_in", inside).join(before, [*group, "_b"]).withColumn("_rank", F.col("_in") + F.col("_before")).drop("_h", "_b", "_in", "_before")


def exact_split(rows: DataFrame, group: str, counts: list[tuple[str, int | None]], seed: int = 13) -> DataFrame:
    """Adds split: whole groups in the order of their hash, so many to each split; None takes the rest (the last is None)."""
    ranked = hash_ranked(rows.select(group).distinct(), group, seed)
    out, upto = None, 0
    for name, n in counts:
        if n is None:
            continue
        upto += n
        out = F.when(F.col("_rank") <= upto, name) if out is None else out.when(F.col("_rank") <= upto, name)
    rest = next((name for name, n in counts if n is None), None)
    split = F.lit(rest) if out is None else out.otherwise(rest)
    return rows.join(ranked.select(group, split.alias("split")), group)


def group_split(rows: DataFrame, group: str, shares: list[tuple[str, float]], seed: int = 13) -> DataFrame:
    """Adds split: whole groups, by the place of a group's hash among fixed shares. Disjoint, and no global order."""
    place = hash_order(seed, F.col(group)) / float(2**32)
    out, total = None, 0.0
    for name, share in shares[:-1]:
        total += share
        out = F.when(place < total, name) if out is None else out.when(place < total, name)
    return rows.withColumn("split", out.otherwise(shares[-1][0]) if out is not None else F.lit(shares[-1][0]))


def bootstrap_means(rows: DataFrame, metric: str, value: str, key: str, rounds: int, seed: int = 13) -> DataFrame:
    """metric, round, mean: Poisson bootstrap, each row drawn as often in a round as a hash of both says.

    Every row meets every round where it stands; only sums of (metric, round) are shuffled.
    """
    drawn = rows.where(F.col(value).isNotNull()).select(metric, value, key, F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("round"))
    u = hash_order(seed, F.concat_ws("|", F.col("round").cast("string"), F.col(key).cast("string"))) / float(2**32)
    drawn = drawn.withColumn("times", poisson_times(u))
    return drawn.groupBy(metric, "round").agg(F.try_divide(F.sum(F.col(value) * F.col("times")), F.sum("times")).alias("mean"))


#: The distribution of a Poisson number of mean 1 up to 6.
POISSON = (0.36787944117, 0.73575888234, 0.91969860292, 0.98101184311, 0.99634015316, 0.99940581517, 0.99991675884)


def poisson_times(u: Column) -> Column:
    return sum(((u >= p).cast("int") for p in POISSON), F.lit(0))


def interval(means: DataFrame, metric: str, confidence: float = 0.95) -> DataFrame:
    tail = (1 - confidence) / 2
    return means.groupBy(metric).agg(F.percentile("mean", tail).alias("low"), F.percentile("mean", 1 - tail).alias("high"))


def top_per_group(rows: DataFrame, group: str, k: int, *order: Column) -> DataFrame:
    by = Window.partitionBy(group).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
