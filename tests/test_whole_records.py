"""A record whose items lie in one task keeps what greedy deduplication over dealt pairs keeps, and no pair is shuffled."""

import random

from pyspark.sql import functions as F

from sievecraft.operators import curate, whole


def _rows(spark):
    pick = random.Random(9)
    words = [f"w{k}" for k in range(400)] + ["the", "of"] * 60
    rows = []
    for rec in range(4):
        texts = [" ".join(pick.choices(words, k=pick.randint(1, 40))) for _ in range(90)]
        for k, x in enumerate(texts * 3):
            parts = x.split(" ")
            if k >= 90:
                parts[pick.randrange(len(parts))] = pick.choice(words)
            rows.append((rec, k % 2, pick.randrange(1 << 40), " ".join(parts) if k % 7 else x.upper()))
        rows += [(rec, 0, -k, x) for k, x in enumerate(("!!", "?", "é  É", "É é", "!!", "中文 a", "中文 A"), 1)]
    rows.append((None, 0, 1, "a b"))
    return spark.createDataFrame(rows, "rec long, side int, i long, item string")


def test_whole_and_dealt_records_agree(spark, monkeypatch):
    rows = _rows(spark)
    sizes = rows.where("rec IS NOT NULL").groupBy("rec").agg(F.sum(F.octet_length("item")).alias("size"))
    found = lambda most: sorted(map(tuple, curate.union_rows(rows, sizes, 0.9, most).select("rec", "i", "item").collect()))
    want = found(0)
    assert found(1 << 30) == want and 400 < len(want) < 1000
    monkeypatch.setattr(whole, "STEP_TERMS", 50)
    monkeypatch.setattr(whole, "WAITING", 20)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert found(1 << 30) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    sides = [rows.where(F.col("side") == k).select("rec", "i", "item") for k in (0, 1)]
    assert sorted(map(tuple, curate.union_items(sides).select("rec", "i", "item").collect())) == want


def test_union_items_shuffles_texts_once(spark):
    from sievecraft.catalog import QUERIES

    plan = QUERIES["union_items"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    # What is joined are the documents and one number, what is shuffled the items, by record.
    assert "bit_count" not in plan and "Window" not in plan and plan.count("MapInArrow") == 2
