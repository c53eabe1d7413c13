"""What is costly stands once in a row's expression, and by-record work stays small."""

from pyspark.sql import functions as F

from sievecraft.functions import flags as fl


def test_answers_are_parsed_once(spark):
    """Decisions parse an answer once and look for an idx once, and still say the same."""
    answer = '{"rubrics": [{"idx": 1, "valid": 1, "atomic": "x", "decidable": true, "relevant": 2, "non_hallucinated": [0]}, {"idx": 0, "valid": false, "reason": "r"}, {"idx": 1, "valid": 0}]}'
    rows = spark.createDataFrame([(answer,), ("none",), (None,)], "a string")
    df = rows.select(fl.decisions(F.col("a"), F.lit(3)).alias("b"), fl.decision(F.col("a")).alias("d"))
    plan = df._jdf.queryExecution().analyzed().toString()
    assert plan.count("parse_json") == 2 and plan.count("$.idx") == 1
    assert [[(x["idx"], x["valid"], x["reason"]) for x in r["b"]] for r in df.collect()] == [
        [(0, False, "r"), (1, False, "api_reject"), (2, False, "missing_decision")],
        *[[(i, False, "invalid_json_response") for i in range(3)]] * 2,
    ]


def test_written_rows_are_computed_once(spark):
    from sievecraft.operators.graph import checkpointed

    seen = spark.sparkContext.accumulator(0)

    def look(x):
        seen.add(1)
        return x

    assert checkpointed(spark.range(10).select(F.udf(look, "long")("id").alias("x"))).count() == 10
    assert seen.value == 10


def test_near_items_against_plain_python(spark):
    """Repeated words, equal items, items without words and texts of few words: the greedy choice, item by item."""
    import random
    from collections import Counter

    from sievecraft.operators.similarity import greedy_dedupe

    pick = random.Random(5)
    rows = [(r, i, " ".join(pick.choice("abcdé中") * 2 for _ in range(pick.randint(0, 7)))) for r in range(4) for i in range(60)]
    got = {(r["rec"], r["i"]): (r["kept"], r["near_of"]) for r in greedy_dedupe(spark.createDataFrame(rows, "rec long, i int, item string"), 0.9).collect()}
    for r in range(4):
        kept = []
        for _, i, item in (x for x in rows if x[0] == r):
            w = Counter("".join(ch for ch in item if ch.isascii() or ch == "中" or ch == " ").replace("éé", "").split())
            norm = sum(v * v for v in w.values())
            near = [j for j, o, n in kept if norm and n and sum(v * o[t] for t, v in w.items()) / (norm * n) ** 0.5 >= 0.9]
            assert got[r, i] == (not near, near[0] if near else None), item
            if not near:
                kept.append((i, w, norm))
