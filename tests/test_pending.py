"""Pairs that are not done: dealt over tasks whose number grows with the scan, made distinct before they are joined."""

from sievecraft.operators import joins as j


def test_pairs_are_dealt_by_the_size_of_the_scan(spark, tmp_path):
    done = [(p, s) for p in range(40) for s in range(5) if (p + s) % 3] * 2 + [(99, 1), (None, 1), (3, None)]
    spark.createDataFrame(done, "p long, s long").repartition(3).write.parquet(str(tmp_path / "done"))
    left, right = spark.range(40).toDF("p").union(spark.range(2).toDF("p")), spark.range(6).toDF("s")
    spark.conf.set("spark.sql.files.openCostInBytes", str(1 << 27))
    try:
        rows = spark.read.parquet(str(tmp_path / "done"))
        assert rows.rdd.getNumPartitions() == 3 and j.dealt(rows, "p").rdd.getNumPartitions() == 3 * j.TASKS
        out = j.pending(left, right, rows, ["p", "s"])
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "RepartitionByExpression" in plan and "LeftSemi" not in plan
        assert {r["s"]: r["pending"] for r in out.collect()} == {s: 40 - sum((p + s) % 3 > 0 for p in range(40)) if s < 5 else 40 for s in range(6)}
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
