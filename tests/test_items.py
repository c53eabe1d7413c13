"""Items in Arrow batches: what is told of them is what the column expressions tell, once for each text."""

import random

from pyspark.sql import functions as F

from sievecraft.functions import text as t
from sievecraft.functions import verify as v
from sievecraft.operators import similarity as s
from sievecraft.operators.items import items_of

ODD_TEXTS = (
    None, "", "\n\n", "- a\n\n* b  c\n1. x\x0by\xa0z　\n a) \"q'\n- - 1) deep one two three\n", "\"- four words are here\n'  1. 2. 3. four'\n\x85x\x1cy\x1f\n\t",
    " \" x  y\"\n中文字 abc中 d_e\nreturn to me the list\nA good clear x\nB) good a b\n\r\n" + "wide " * 200, "candidate answer A is a\n•\tbullet é è\n-x\na b a b a  B \n" + "\U0001f600é" * 401 + " two three",
)


def test_facts_are_those_of_the_expressions(spark):
    rows = spark.createDataFrame(list(enumerate(ODD_TEXTS)), "k long, text string")
    facts = ("item", "name", "w", "nn", "d", "reason")
    x = F.col("item")
    want = rows.select("k", F.posexplode(F.transform(t.lines(F.col("text")), t.clean_item)).alias("i", "item")).where("item <> ''")
    want = want.select("k", "i", "item", F.md5(t.item_key(x)).alias("name"), F.sort_array(t.tokens(x)).alias("w"), s.squared_norm(t.tokens(x)).alias("nn"), F.size(F.array_distinct(t.tokens(x))).cast("long").alias("d"), v.verify_reason(x).alias("reason"))
    got = items_of(rows, "k", *facts).select(want.columns)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert got.count() == 19


def test_pairs_of_small_and_large_records_agree(spark):
    """Records that lie in several batches, or in one, are compared in place as by prefixes."""
    pick = random.Random(3)
    rows = [(r, i, " ".join(pick.choice("abcdefgh") * 2 for _ in range(pick.randint(0, 9)))) for r in range(9) for i in range(r * 7)]
    classes = s.token_classes(spark.createDataFrame(rows, "rec long, i int, item string"))
    pairs = lambda df: sorted((r["rec"], r["i"], r["j"], r["sim"], r["mi"], r["mj"]) for r in df.collect())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        want = pairs(s.prefix_pairs(classes, 0.8))
        assert pairs(s.near_classes(classes, 0.8)) == pairs(s.near_classes(classes, 0.8, 10)) == want and len(want) > 100
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_rewards_read_each_text_once(spark):
    """No query of rewards cleans, cuts or judges an item in regular expressions of its row, which ran once for each use."""
    from sievecraft.catalog import QUERIES

    for name in ("reward_per_record", "hook_rewards", "bsc_summary", "reward_ablation", "balanced_rewards", "verifier_filter_delta", "audit_summary", "issue_counts"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "regexp" not in plan, name
