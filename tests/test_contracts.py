"""Numbers of rows kept by writes, keys that no row may lack, the choice among targets: both outcomes."""

import os

import pytest
from pyspark.sql import functions as F

from sievecraft.operators import contracts, normalize


def test_write_counted(spark, tmp_path):
    rows = spark.range(7).repartition(3)
    assert contracts.write_counted(rows, f"{tmp_path}/a", least=7) == 7 and spark.read.parquet(f"{tmp_path}/a").count() == 7
    assert contracts.write_counted(rows.where("id > 3"), f"{tmp_path}/b", exactly=3) == 3
    for more in ({"least": 8}, {"exactly": 6}):
        with pytest.raises(ValueError, match="7 rows"):
            contracts.write_counted(rows, f"{tmp_path}/c", **more)
    with pytest.raises(ValueError, match="there already"):
        contracts.write_counted(rows, f"{tmp_path}/a")
    assert contracts.write_counted(rows.limit(0), f"{tmp_path}/d") == 0
    assert sorted(x for x in os.listdir(tmp_path)) == ["a", "b", "d"] and spark.read.parquet(f"{tmp_path}/a").count() == 7


def test_record_index(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "pos int, key string")
    assert sorted((r["pos"], r["occ"]) for r in contracts.record_index(rows, "key").collect()) == [(1, 1), (2, 2), (3, 1)]
    for bad in ("", None):
        with pytest.raises(Exception, match="lacks its key"):
            contracts.record_index(rows.unionByName(spark.createDataFrame([(4, bad)], "pos int, key string")), "key").collect()


def test_first_target(spark):
    records = ['{"query": "q1", "chosen": "a", "rejected": "b"}', '{"query": "q2", "rubrics": ["x is y"]}', '{"query": "q1", "rubrics": ["hidden by the first"]}', '{"answer": "no query"}']
    rows = spark.createDataFrame(list(enumerate(records)), "pos int, raw string").select("pos", F.try_parse_json("raw").alias("record"))
    told = {r["target"]: (r["n"], r["chosen"]) for r in normalize.target_counts(rows, ["gold", "preference", "query_pool"], 2).collect()}
    assert told == {"gold": (1, False), "preference": (1, False), "query_pool": (2, True)}
    assert normalize.normalize_first(rows, ["gold", "preference"]).columns == ["pos", "query", "gold_rubrics", "data_source"]
    with pytest.raises(ValueError, match="no target"):
        normalize.normalize_first(rows, ["gold", "preference"], 2)
    assert normalize.target_counts(rows.limit(0), ["gold"], 1).collect()[0]["n"] == 0
