"""Whole jobs: cases in which an operator once did less."""

import math
from collections import Counter

import brute
import numpy as np
import pytest

import corpus_pipeline
from sievecraft.llm import line_dedup, lm, minhash, quality, toxicity


def test_filter_keeps_its_bits_a_level():
    """A shard of a large input has as many bits for a level as one of a small one, and probing ends in full bits."""
    rng = np.random.default_rng(1)
    false = []
    for n in (1_000, 400_000):
        low = np.unique(rng.integers(0, 1 << 40, 2 * n).astype(np.uint64))
        rng.shuffle(low)
        held, others = low[:n], low[n:]
        counts = rng.integers(1, 9, n)
        bits = lm.LogFrequencyFilter.shard(held, counts)
        assert len(bits) * 8 >= lm.BITS * lm.level(counts).sum()
        assert (lm.LogFrequencyFilter.levels(bits, held) >= lm.level(counts)).all()
        false.append((lm.LogFrequencyFilter.levels(bits, others) > 0).mean())
    assert max(false) < 0.005
    # A filter whose bits are all set answers the last level, and that has a value.
    values = lm.level_values()
    assert (values[lm.LogFrequencyFilter.levels(np.full(64, 255, np.uint8), held[:9])] > 0).all()
    assert lm.level(np.array([2**62]))[0] < len(values)
    # 30 GB of text are about five thousand million tokens.
    assert 5e9 / lm.shards_for(5 * 10**9) <= lm.SHARD_TOKENS and lm.shards_for(10) == lm.SHARDS


def test_templates_never_fade(spark):
    """Fields whose values recur stay fields, and what a few documents share is still shared among many."""
    names = ["ann", "bob", "cid", "dan", "eve", "fay"]
    days = ["monday", "tuesday", "friday", "sunday"]
    rows = [(k, f"written by {names[k % 6]} for the {days[k % 4]} issue of our paper\nbody {'xyzuvw'[k % 6] * (k + 1)}\nshare this\n{names[k // 6]} said this to us all day") for k in range(36)]
    for some in (rows[:9], rows):
        want = brute.deduped_lines(some)
        got = {r["doc_id"]: (r["text"], r["n_recurring"], r["n_dropped"]) for r in line_dedup.dedup_lines(spark.createDataFrame(some, "doc_id long, text string")).collect()}
        assert got == want
        assert all(got[k][2] >= 2 for k, _ in some[1:]) and got[0][2] == 0
        assert all("share this" not in got[k][0] for k, _ in some[1:])


def test_packed_numbers():
    rng = np.random.default_rng(2)
    for top in (1, 200, 2**20, 2**63):
        x = np.sort(rng.integers(0, top, 500).astype(np.uint64))
        assert (lm.unpack_sorted(lm.pack_sorted(x), 500) == x).all() and (lm.unplanes(lm.planes(x), 500) == x).all()
    assert len(lm.unplanes(lm.planes(np.zeros(0, np.uint64)), 0)) == 0


def brute_scores(rows: dict[int, str], train: set[int]) -> dict[int, float]:
    """The mixture from quantised counts in dictionaries, word by word."""
    tokens = {k: [*brute.WORD.findall(brute.lower(t)), ""] for k, t in rows.items()}
    one = Counter(w for k in train for w in tokens[k])
    two = Counter(p for k in train for p in zip(["", *tokens[k]], tokens[k], strict=False))
    n, v = sum(one.values()), len(one)

    def quantised(c: int) -> float:
        return float(lm.level_values()[lm.level(np.array([c]))[0]]) if c else 0.0

    out = {}
    for k, t in tokens.items():
        pairs = list(zip(["", *t], t, strict=False))
        total = 0.0
        for i in range(0, len(t), lm.BLOCK):
            alone = after = 0.0
            for a, b in pairs[i : i + lm.BLOCK]:
                p1 = (quantised(one[b]) + 1) / (n + v + 1)
                alone += math.log(p1)
                after += math.log((min(quantised(two[a, b]), quantised(one[a])) + lm.PRIOR * p1) / (quantised(one[a]) + lm.PRIOR))
            total += np.logaddexp(alone + math.log(1 - lm.PAIR_SHARE), after + math.log(lm.PAIR_SHARE))
        out[k] = total / math.log(10)
    return out


@pytest.mark.parametrize("shard_tokens", [lm.SHARD_TOKENS, 1 << 12])
def test_language_model_is_the_brute_force_one(spark, monkeypatch, shard_tokens):
    """With bits enough that the filter errs nowhere, every score is that of plain dictionaries, however many shards."""
    monkeypatch.setattr(lm, "SHARD_TOKENS", shard_tokens)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    want = brute_scores(rows, {k for k in rows if k % 3})
    for r in lm.score(docs, docs.where("doc_id % 3 <> 0"), bits_a_level=2048).collect():
        assert abs(r["score"] - want[r["doc_id"]]) < 1e-6 * max(1, abs(want[r["doc_id"]])), r["doc_id"]


def test_false_positives_move_scores_little(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    want = brute_scores(rows, {k for k in rows if k % 3})
    got = {r["doc_id"]: r["score"] for r in lm.score(docs, docs.where("doc_id % 3 <> 0")).collect()}
    assert abs(sum(got.values()) / sum(want.values()) - 1) < 0.002


def test_pipeline_tells_rows_apart_by_id_and_text(spark, monkeypatch):
    """A dropped row takes no other row of its id with it, and rows without an id are dropped like others."""
    base = [f"w{k}" for k in range(60)]
    near = " ".join([*base[:-1], "changed"])
    rows = [(None, "bad one"), (None, "good one"), (1, "bad two"), (1, "good two"), (2, " ".join(base)), (3, near), (3, "good three"), (None, near + " more"), (None, near + " extra")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = lambda out: sorted((r["doc_id"] or 0, r["text"]) for r in out.collect())
    for module, stage, bad in ((toxicity, corpus_pipeline.drop_toxic, 1), (quality, corpus_pipeline.drop_poor, 0)):
        real = module.classify

        def fake(docs, labelled, real=real, bad=bad, **more):
            from pyspark.sql import functions as F

            out = real(docs, labelled, **more)
            assert out.count() == docs.count() and "digest" in out.columns
            told = docs.select("doc_id", corpus_pipeline.digest().alias("digest"), F.when(F.col("text").startswith("bad"), bad).otherwise(1 - bad).alias("predicted"))
            return told

        monkeypatch.setattr(module, "classify", fake)
        assert left(stage(spark, docs, "/root/testdata/sf0.001")) == sorted((i or 0, t) for i, t in rows if not t.startswith("bad"))
    kept = left(minhash.kept_rows(docs))
    assert kept == sorted((i or 0, t) for i, t in rows if not t.startswith(near))


def test_pipeline_run_is_its_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = {(r["doc_id"], r["text"]) for r in docs.collect()}
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), docs.schema)
        assert {(r["doc_id"], r["text"]) for r in docs.collect()} <= before
    total = lambda pieces: {k: sum(p["length"] for p in pieces if p["doc_id"] == k) for k in {p["doc_id"] for p in pieces}}
    assert total(corpus_pipeline.run(spark, sf).collect()) == total(corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect())
