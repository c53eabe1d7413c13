"""Inner parts of the models against enumeration."""

import itertools
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievecraft.llm import fingerprint, quality, toxicity


def char_model(seed: int) -> toxicity.CharModel:
    k = len(toxicity.ALPHABET) + 2
    return toxicity.CharModel(np.random.default_rng(seed).integers(0, 50, k**3))


def path_score(model: toxicity.CharModel, letters: str, cost: float) -> float:
    a, b, total = 1, 1, cost
    for c in letters:
        z = 1 if c == " " else model.symbol.get(c, 0)
        total += model.step(a, b, z)
        a, b = b, z
    return total


@pytest.mark.parametrize("word", ["1d10t", "$tup1d", "b4aaad", "a*c", "1!1", "0", "xx|yy", "аb1", "i.d"])
@pytest.mark.parametrize("spaced", [False, True])
def test_viterbi_finds_the_best_path(word, spaced):
    """No path through the lattice has a greater score than the decoded one."""
    model = char_model(len(word))
    places = [*toxicity.lattice(word, spaced), [(" ", 0.0)]]
    best: dict[str, float] = {}
    for path in itertools.product(*places):
        letters = "".join(x for x, _ in path)
        best[letters.strip()] = max(best.get(letters.strip(), -math.inf), path_score(model, letters, sum(c for _, c in path)))
    assert abs(best[toxicity.decode(word, model, spaced)] - max(best.values())) < 1e-9


def test_long_words_are_decoded_whole():
    """Where paths are settled changes nothing, and time grows with the word."""
    rng = random.Random(9)
    counts = np.zeros((len(toxicity.ALPHABET) + 2) ** 3, np.int64)
    counts[[rng.randrange(len(counts)) for _ in range(20_000)]] += 5
    model = toxicity.CharModel(counts)
    for spaced in (False, True):
        for n in (1, 63, 64, 65, 257, 700):
            word = "".join(rng.choice("ab1!430*e66ss$$$zzz0|") for _ in range(n))
            assert len({toxicity.decode(word, model, spaced, settle) for settle in (1, 7, 64, 256, 1 << 30)}) == 1
    began = time.time()
    assert len(toxicity.decode("".join(rng.choice("ab1!430e66") for _ in range(100_000)), model)) >= 50_000 and time.time() - began < 60



def test_long_disguises_take_little_time():
    restorer = toxicity.Restorer(np.random.default_rng(1).integers(0, 50, (len(toxicity.ALPHABET) + 2) ** 3))
    began = time.time()
    assert restorer.word("a" + "*" * 10_000 + "b") == ["a", "b"]
    assert restorer.word("1d10t" * 20_000) and restorer.word("a1" * 50_000)
    import pyarrow as pa

    restorer.batch(pa.array(["* " * 5_000 + "i d i o t " * 2_000]))
    assert time.time() - began < 60


def test_evidence_scores_by_hand():
    """A document's score from the columns that its distinct words give, one by one."""
    import pyarrow as pa

    restorer = toxicity.Restorer(np.ones((len(toxicity.ALPHABET) + 2) ** 3, np.int64))
    model = toxicity.Evidence({"moron": 2.0, "idio~": 1.5, "fool": 0.5}, np.array([-1.0, 0.7, 0.4, 0.3, 0.2]))
    texts = ["moron idiots moron and a fool", "nothing here", "", None and "", "fool fool fool"]
    texts = [t or "" for t in texts]
    for text, got in zip(texts, model.scores(restorer, pa.array(texts)), strict=True):
        each = [max([model.weights.get(f, 0.0) for f in toxicity.features([w])], default=0.0) for w in set(text.split())]
        each = [e for e in each if e > 0]
        x = [1, math.log1p(sum(each)), max(each, default=0), math.log1p(len(each)), math.log1p(100 * len(each) / max(1, len(text.split())))]
        assert abs(got - 1 / (1 + math.exp(-sum(a * b for a, b in zip(x, model.final, strict=True))))) < 1e-9


@pytest.mark.parametrize("seed", range(3))
def test_marginals_are_those_of_all_labellings(seed):
    rng = np.random.default_rng(seed)
    field = quality.LineField(np.sort(rng.normal(size=(quality.MEASURES, quality.BINS - 1)), 1))
    field.weights, field.moves = rng.normal(size=field.weights.shape) * 0.3, rng.normal(size=(2, 2))
    doc = np.repeat([0, 2, 3], [5, 1, 4])
    measures = rng.normal(size=(len(doc), quality.MEASURES))
    active = field.active(measures, doc)
    got, moved = field.marginals(active, doc)
    odds = field.weights[active].sum(1) + field.weights[-1]
    want, expected = np.zeros(len(doc)), np.zeros((2, 2))
    for d in np.unique(doc):
        at = np.flatnonzero(doc == d)
        total = 0.0
        sums, pairs = np.zeros(len(at)), np.zeros((2, 2))
        for labels in itertools.product((0, 1), repeat=len(at)):
            weight = math.exp(sum(odds[i] * y for i, y in zip(at, labels, strict=True)) + sum(field.moves[a, b] for a, b in itertools.pairwise(labels)))
            total += weight
            sums += weight * np.array(labels)
            for a, b in itertools.pairwise(labels):
                pairs[a, b] += weight
        want[at] = sums / total
        expected += pairs / total
    assert np.allclose(got, want) and np.allclose(moved, expected)
    # A document's badness is the mean of its lines' marginals, weighted by length.
    size = rng.integers(1, 50, len(doc))
    bad = field.badness(measures, doc, size, 4)
    for d in (0, 2, 3):
        assert np.isclose(bad[d], np.average(1 - want[doc == d], weights=size[doc == d]))
    assert np.isnan(bad[1])


def test_gradient_of_the_field():
    """The fit climbs: its likelihood, by enumeration over one chain, grows."""
    rng = np.random.default_rng(3)
    doc, good = np.zeros(6, int), np.array([1.0, 1, 0, 0, 1, 1])
    field = quality.LineField(np.sort(rng.normal(size=(quality.MEASURES, quality.BINS - 1)), 1))
    active = field.active(rng.normal(size=(6, quality.MEASURES)), doc)

    def likelihood() -> float:
        odds = field.weights[active].sum(1) + field.weights[-1]
        score = lambda y: sum(o * v for o, v in zip(odds, y, strict=True)) + sum(field.moves[int(a), int(b)] for a, b in itertools.pairwise(y))
        return score(good) - math.log(sum(math.exp(score(y)) for y in itertools.product((0, 1), repeat=6)))

    before = likelihood()
    field.fit(active, doc, good, steps=30)
    assert likelihood() > before + 0.5


def test_long_labelled_documents_are_learnt_from(spark):
    """No labelled document is left out for its length while all lines together fit."""
    rows = [(k, "\n".join(["clean words in a row"] * 3000) if k == 0 else f"line {k}", k % 2) for k in range(10)]
    docs = spark.createDataFrame(rows, "key long, t string, y int")
    assert quality.within(docs, quality.MAX_LINES).count() == 10
    some = quality.within(docs, 100)
    assert some.count() == 9 and some.where("key = 0").count() == 0


def test_likeness_by_hand(spark):
    """near_edited and near_next from the stretches themselves: equal characters in equal stretches over the longer length."""
    rng = random.Random(4)
    texts = ["".join(rng.choice("abc de") for _ in range(n)) for n in (0, 1, 63, 64, 65, 100, 129, 500, 2000, 700)] + ["x" * 300, "x" * 300]
    rows = {r["doc_id"]: r for r in fingerprint.edited_fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}

    def bounds(n: int) -> list[tuple[int, int]]:
        out, at, size = [(0, 64)], 64, 32
        while at < n:
            for _ in range(2):
                if at < n:
                    out.append((at, at + size))
                at += size
            size *= 2
        return out

    def alike(a: str, b: str) -> float:
        if a == b:
            return 1.0
        same = sum(min(y, len(a), len(b)) - x for x, y in bounds(min(len(a), len(b))) if a[x:y] == b[x:y] and x < min(len(a), len(b)))
        return same / max(len(a), len(b), 1)

    canon = lambda t: " ".join(t.split())
    for k, t in enumerate(texts):
        half = len(t) // 2
        after = texts[(k + 1) % len(texts)]
        edited = t[: len(t) - half] + after[:half]
        assert abs(rows[k]["near_edited"] - alike(canon(t), canon(edited))) < 1e-9, k
        assert abs(rows[k]["near_next"] - alike(canon(t), canon(after))) < 1e-9, k
    assert rows[10]["fingerprint"] == rows[11]["fingerprint"] == rows[10]["edited_fingerprint"]


def test_colliding_buckets_are_told_apart(spark, monkeypatch):
    """With a digest that collides on purpose, unlike texts get unlike fingerprints, edited texts too, and equal ones equal."""
    real = fingerprint.lanes

    def colliding(canon):
        d = real(canon)
        return F.struct(F.lit("0" * 32).alias("wide"), d["n"].alias("n"), F.transform(d["lanes"], lambda x: F.lit(0).cast("long")).alias("lanes"))

    monkeypatch.setattr(fingerprint, "lanes", colliding)
    texts = ["abcd", "abce", "abcd", "abce", "abcd"]
    docs = spark.createDataFrame([(k or None, t) for k, t in enumerate(texts)], "doc_id long, text string")
    rows = fingerprint.edited_fingerprints(docs).collect()
    by = {r["doc_id"] or 0: r for r in rows}
    assert by[0]["fingerprint"] == by[2]["fingerprint"] == by[4]["fingerprint"] != by[1]["fingerprint"] == by[3]["fingerprint"]
    # Texts 0 and 1 edited are abab; text 4 edited is abab as well: equal texts, equal fingerprints.
    assert len({by[k]["edited_fingerprint"] for k in range(5)}) == 1 and by[0]["edited_fingerprint"] not in {by[0]["fingerprint"], by[1]["fingerprint"]}
    assert len({r["fingerprint"] for r in fingerprint.fingerprints(docs).collect()}) == 2
