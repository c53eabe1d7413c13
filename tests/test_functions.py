"""Facts about the text functions, the verifier and small operators on literal rows."""

import pytest
from pyspark.sql import functions as F

from sievecraft.functions import tasks, verify
from sievecraft.functions import text as t
from sievecraft.operators import curate, graph, joins, judge, normalize, stats
from sievecraft.operators import similarity as s
from sievecraft.plans.stages import Stage, run_stages, select_stages
from sievecraft.sources import records


def one(spark, column, **cells):
    names = list(cells)
    schema = ", ".join(f"{n} {'array<string>' if isinstance(cells[n], list) else 'string'}" for n in names) or "x string"
    return spark.createDataFrame([tuple(cells.values()) or ("",)], schema).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("text", "items"),
    [
        ('["a b", {"criterion": "c d"}, {"description": "e"}]', ["a b", "c d", "e"]),
        ('Here:\n```json\n["one", "two"]\n```', ["one", "two"]),
        ('{"gold": ["x", "y"]}', ["x", "y"]),
        ("- first\n- second\n- first", ["first", "second", "first"]),
        ("1. one\n2) two\na) three", ["one", "two", "three"]),
        ("plain\nlines `{}) here\n\nthree", ["plain", "lines `{}) here", "three"]),
        ("", []),
        (None, []),
    ],
)
def test_parse_items(spark, text, items):
    assert one(spark, t.parse_items(F.col("x")), x=text) == items


def test_clean_and_dedupe(spark):
    assert one(spark, t.clean_item(F.col("x")), x=" - \"Some　 text\" ") == "Some text"
    assert one(spark, t.dedupe_items(F.col("x")), x=["A b", "a  B", "c"]) == ["A b", "c"]


@pytest.mark.parametrize(("item", "reason"), [("", "empty"), ("two words", "too_short"), ("be helpful and clear", "too_generic"), ("return the list now please", "meta_instruction"), ("states the boiling point of water", "rule_pass"), ("x y z " * 200, "too_long")])
def test_verify(spark, item, reason):
    assert one(spark, verify.verify_reason(F.col("x")), x=item) == reason


@pytest.mark.parametrize(("item", "category"), [("cite the source", "evidence_grounding"), ("nothing here", "completeness"), ("must use json format", "constraint_following"), ("is it safe and correct", "factuality")])
def test_category(spark, item, category):
    assert one(spark, verify.classify_category(F.col("x")), x=item) == category


def test_scores(spark):
    assert one(spark, t.parse_score(F.col("x")), x='{"score": 1.7}') == 1.0 and one(spark, t.parse_score(F.col("x")), x="no") == 0.0 and one(spark, t.parse_score(F.col("x")), x="not satisfied") == 1.0
    assert one(spark, t.parse_bool(F.col("x")), x="Yes") is True and one(spark, t.parse_bool(F.col("x")), x="maybe") is None
    assert one(spark, t.parse_number(F.col("x")), x="true") is None and one(spark, t.parse_number(F.col("x")), x=" 2.5 ") == 2.5


def test_tasks(spark):
    assert one(spark, tasks.task_type(F.col("x"), F.lit("")), x="write a story about rain") == "creative_writing"
    assert one(spark, tasks.declarative(F.col("x")), x="Tone: Does the response stay calm?") == "The response should stay calm."


def items(spark, rows):
    return spark.createDataFrame(rows, "rec long, i int, item string")


def test_coverage_and_redundancy(spark):
    gold = spark.createDataFrame([(1, 0, "alpha beta gamma"), (1, 1, "delta epsilon"), (1, 2, "zeta eta theta")], "gold_id long, g int, item string")
    gen = items(spark, [(7, 0, "alpha beta gamma"), (7, 1, "delta epsilon one"), (7, 2, "alpha beta gamma")])
    pairs = spark.createDataFrame([(7, 1), (8, 1)], "rec long, gold_id long")
    hits = s.gold_hits(gold, s.gold_similarity(gold, gen, pairs), pairs)
    by = {r["rec"]: r["c"] for r in hits.groupBy("rec").agg(F.avg((F.col("best") >= 0.5).cast("int")).alias("c")).collect()}
    assert by[7] == pytest.approx(2 / 3) and by[8] == 0.0
    assert s.redundancy(gen, 0.99).first()["redundancy"] == pytest.approx(1 / 3)


def test_filter_items(spark):
    rows = items(spark, [(1, 0, "states the exact date clearly"), (1, 1, "States the exact  date clearly"), (1, 2, "good"), (1, 3, "states the exact date so clearly"), (1, 4, "names all three authors here"), (1, 5, "gives a source for it")])
    out = {r["i"]: (r["reason"], r["duplicate_of"]) for r in curate.filter_items(rows, 0.9, 2).collect()}
    assert out == {0: ("rule_pass", None), 1: ("exact_duplicate", 0), 2: ("too_short", None), 3: ("semantic_duplicate", 0), 4: ("rule_pass", None), 5: ("max_items_exceeded", None)}


def test_joins(spark):
    a = spark.createDataFrame([("q", 1), ("q", 2), ("p", 3)], "key string, left_id int")
    b = spark.createDataFrame([("q", 5), ("q", 6), ("q", 7), ("z", 8)], "key string, right_id int")
    assert sorted((r["left_id"], r["right_id"]) for r in joins.occurrence_join(a, b, "key", "left_id", "right_id").collect()) == [(1, 5), (2, 6)]
    assert [(r["key"], r["right_id"]) for r in joins.last_per_key(b, "key", "right_id").orderBy("key").collect()] == [("q", 7), ("z", 8)]
    assert joins.uncontaminated(a, b, "key").count() == 1 and joins.contaminated(a, b, "key").count() == 2


def test_judge(spark):
    m = judge.multicandidate(F.array(*[F.lit(x) for x in (0.2, 0.9, 0.9)]), F.lit(1))
    assert spark.range(1).select(*[x.alias(n) for n, x in m.items()]).first().asDict() == {"prediction": 1, "label_score": 0.9, "top_score": 0.9, "margin": 0.0, "tie": True, "correct": False}


def test_samples(spark):
    rows = spark.createDataFrame([(k, "a" if k < 80 else "b") for k in range(100)], "key long, s string")
    out = stats.stratified_sample(rows, "s", "key", 5)
    assert {r["s"]: r["count"] for r in out.groupBy("s").count().collect()} == {"a": 4, "b": 1}
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, stats.stratified_sample(rows, "s", "key", 5).collect()))
    split = stats.group_split(rows.withColumn("g", F.col("key") % 30), "g", [("x", 0.5), ("y", 0.5)])
    assert split.groupBy("g").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "a long, b long")
    nodes = spark.createDataFrame([(k,) for k in [*range(41), 100, 101, 200]], "node long")
    out = {r["node"]: r["component"] for r in graph.min_labels(edges, nodes).collect()}
    assert all(out[k] == 0 for k in range(41)) and out[101] == 100 and out[200] == 200


def test_normalize(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"question": "q1", "response_A": "a", "response_B": "b", "label": "A>B"}\n\n{"question": "q2", "response_A": "a", "response_B": "b", "label": "A=B"}\n{"question": "q3", "response_A": "a", "response_B": "b", "label": "B > A"}\n')
    rows = records.scan(spark, str(tmp_path / "x.jsonl")).withColumn("pos", F.monotonically_increasing_id())
    assert sorted((r["query"], r["chosen"], r["rejected"]) for r in normalize.normalize(rows, "preference").collect()) == [("q1", "a", "b"), ("q3", "b", "a")]
    (tmp_path / "y.json").write_text('{"records": [{"prompt": "p", "criteria": "- one\\n- two"}, {"prompt": "p", "criteria": "- three"}, {"prompt": "r"}]}')
    rows = records.scan(spark, str(tmp_path / "y.json")).withColumn("pos", F.monotonically_increasing_id())
    assert [(r["query"], r["gold_rubrics"]) for r in normalize.normalize(rows, "gold").collect()] == [("p", ["one", "two"])]
    assert normalize.normalize(rows, "query_pool").count() == 2


def test_strict(spark, tmp_path):
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\n[1\n')
    with pytest.raises(Exception, match="not a JSON object"):
        records.strict(records.scan_jsonl(spark, str(tmp_path / "bad.jsonl"))).collect()


def test_resume(spark, tmp_path):
    from sievecraft.streaming.resume import append_new, append_stream

    schema = "query string, teacher string, source string, pos long"
    at = str(tmp_path / "done")
    append_new(spark.createDataFrame([("q", "t", "s", 1), ("q", "t", "s", 2), ("r", "t", "s", 3)], schema), at, ["query", "teacher"], ["source"])
    spark.createDataFrame([("q", "t", "s", 9), ("x", "t", "s", 10)], schema).write.parquet(str(tmp_path / "in"))
    append_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), at, str(tmp_path / "ck"), ["query", "teacher"], ["source"]).awaitTermination()
    assert sorted((r["query"], r["pos"]) for r in spark.read.parquet(at).collect()) == [("q", 2), ("r", 3), ("x", 10)]


def test_stages(spark):
    stages = [Stage("a", lambda d: d.where("id > 1"), ("src",)), Stage("b", lambda d, n: d.limit(n), ("a",), {"n": 1})]
    assert [x.name for x in select_stages(stages, first="b")] == ["b"] and run_stages(stages, {"src": spark.range(5)})["b"].count() == 1
    with pytest.raises(ValueError, match="no stage"):
        select_stages(stages, only=["z"])


def test_consolidate(spark):
    rows = items(spark, [(1, 0, "safe"), (1, 1, "avoids unsafe or illegal advice in 2 places."), (1, 2, "cites a source for each claim made."), (1, 3, "nothing")])
    kind = verify.classify_category(F.col("item"))
    out = curate.consolidate(rows, kind, curate.quality_score(F.col("item"), kind), 2)
    assert [(r["place"], r["dimension"]) for r in out.orderBy("place").collect()] == [(1, "safety"), (2, "evidence_grounding")]


def test_flags_and_decisions(spark):
    from sievecraft.functions import flags as fl

    x = F.col("x")
    assert [one(spark, fl.lenient_flag(x), x=w) for w in ("Yes", "1.0", "maybe", "0")] == [True, True, False, False]
    assert one(spark, fl.strict_flag(x), x="invalid") is False
    with pytest.raises(Exception, match="not a binary flag"):
        one(spark, fl.strict_flag(x), x="maybe")
    assert one(spark, fl.answered_flag(x), x="well: {'valid': true}") is True and one(spark, fl.answered_flag(x), x='{"valid": "no"}') is False
    whole = '{"valid": true, "atomic": true, "decidable": true, "relevant": true, "non_hallucinated": true}'
    assert tuple(one(spark, fl.decision(x), x=whole)) == (True, "api_pass") and one(spark, fl.decision(x), x="no json")["reason"] == "invalid_json_response"
    # In a batch the text "false" counts as true, the value false does not.
    batch = '{"rubrics": [{"idx": 0, "valid": "false", "atomic": 1, "decidable": true, "relevant": true, "non_hallucinated": true}, {"idx": 2, "valid": false}]}'
    assert [tuple(d) for d in one(spark, fl.decisions(x, F.lit(3)), x=batch)] == [(0, True, "api_pass"), (1, False, "missing_decision"), (2, False, "api_reject")]
    assert one(spark, fl.unit_count(x), x="[1, 2]") == 2 and one(spark, fl.unit_count(x), x=" ") == 0 and one(spark, fl.unit_count(x), x="[1") == 1


def test_flags_that_do_not_align_fail(spark):
    from sievecraft.operators import training as t

    rows = spark.createDataFrame([(["a b", "c d", "A b"], ["1", "0", "yes"])], "items array<string>, flags array<string>")
    assert rows.select(t.flagged_items(F.col("items"), F.col("flags"))).first()[0] == ["a b"]
    with pytest.raises(Exception, match="differ in number"):
        rows.select(t.flagged_items(F.col("items"), F.slice("flags", 1, 2))).collect()


def test_exact_split_and_ranks(spark):
    from sievecraft.operators import stats

    rows = spark.createDataFrame([(k, k % 3) for k in range(500)], "k long, s long")
    ranks = sorted(r["_rank"] for r in stats.hash_ranked(rows, "k", 1).collect())
    assert ranks == list(range(1, 501))
    by = {r["split"]: r["n"] for r in stats.exact_split(rows, "k", [("a", 7), ("b", 11), ("c", None)]).groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert by == {"a": 7, "b": 11, "c": 482}


def test_nearest_is_brute_force(spark):
    import numpy as np

    from sievecraft.operators import vector as v

    x = np.random.default_rng(0).normal(size=(300, 8)).round(3)
    x[200:] = x[:100]  # ties go to the least key
    rows = spark.createDataFrame([(k, [float(f) for f in row]) for k, row in enumerate(x)], "k long, x array<float>").repartition(5)
    got = {r["query"]: r["nearest"] for r in v.nearest(rows.where("k % 50 = 0"), rows.where("k % 50 <> 0"), "k", "x").collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    rest = np.array([k for k in range(300) if k % 50])
    assert got == {k: int(rest[np.round(u[rest] @ u[k], 9).argmax()]) for k in range(0, 300, 50)}


def test_near_items_of_a_record_are_all_found(spark):
    """The prefix filter loses no pair, and equal items are counted rather than paired."""
    import itertools
    import math
    import random
    from collections import Counter

    rng = random.Random(3)
    lines = [" ".join(rng.choice("abcdefghij") * 2 for _ in range(rng.randint(1, 12))) for _ in range(60)]
    lines += [line + " extra" for line in lines[:20]] + lines[:10]
    gen = items(spark, [(1, i, t) for i, t in enumerate(lines)])
    counts = [Counter(t.split()) for t in lines]

    def cosine(a, b):
        return sum(a[w] * b[w] for w in a) / math.sqrt(sum(c * c for c in a.values()) * sum(c * c for c in b.values()))

    pairs = {(i, j) for i, j in itertools.combinations(range(len(lines)), 2) if cosine(counts[i], counts[j]) >= 0.85}
    assert s.redundancy(gen, 0.85).first()["redundancy"] == pytest.approx(len(pairs) / len(lines))
    kept = []
    for i in range(len(lines)):
        if not any((k, i) in pairs for k in kept):
            kept.append(i)
    assert sorted(r["i"] for r in s.greedy_dedupe(gen, 0.85).where("kept").collect()) == kept


def test_scans_of_several_roots(spark, tmp_path):
    from sievecraft.sources import records as r

    for k in (0, 1):
        (tmp_path / f"r{k}" / "extra_round1").mkdir(parents=True)
        (tmp_path / f"r{k}" / "a.jsonl").write_text('{"x": %d}\n\n{"x": 9}\n' % k)
        (tmp_path / f"r{k}" / "extra_round1" / "b.jsonl").write_text('{"x": 7}\n')
    roots = [str(tmp_path / "r0"), str(tmp_path / "r1")]
    assert r.scan_roots(spark, roots).count() == 6 and r.scan_roots(spark, roots, "extra_round").groupBy("root").count().count() == 2
    (tmp_path / "t.csv").write_text("method,cov\na,1\nb,2\n")
    status, rows = r.scan_csv(spark, str(tmp_path / "t.csv"))
    assert status == "ok" and r.table_value(rows, "method", "b", "cov") == "2" and r.table_value(rows, "method", "z", "cov") is None
    assert r.scan_csv(spark, str(tmp_path / "none.csv"))[0] == "missing"
    assert r.scan(spark, str(tmp_path / "t.csv")).select(r.get_path(F.col("record"), "method")).first()[0] == "a"
    listed = spark.createDataFrame([('{"a": [{"b": 1}, {"b": 2}], "0x": "y"}',)], "j string").select(F.parse_json("j").alias("v"))
    assert tuple(listed.select(r.get_path(F.col("v"), "a.1.b"), r.get_path(F.col("v"), "a.0.b")).first()) == ("2", "1")
