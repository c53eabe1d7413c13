"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns: for every operator."""

import hashlib

import pytest
from pyspark.sql import functions as F

from sievecraft.llm import bpe, fingerprint, html, line_dedup, lm, minhash, packing, quality, toxicity
from sievecraft.llm.dedup import DigestIndex
from sievecraft.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, k int, t string, node string, label string, word string, n int, row int, score string, digest string"
LONG = "the quick brown fox jumps over the lazy dog near an old river bank " * 2000
ROWS = [(1, "one two three four five six"), (2, "one two three four five six"), (2, "one two three four five six"), (3, ""), (4, None), (None, "lonely text with no id at all"), (5, LONG), (6, LONG + "end"), (7, " \n\t "), (8, "Ünï   CODE\n\nline  two"), (9, "a b c")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "src0", 3, "x", 1, "y", "z", "l", "w", 2, 3, "s", "d") for i, t in ROWS]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark, docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 0), (5, 0, 1), (8, 0, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")


def test_bpe(docs, none):
    out = bpe.encode(docs, tokenizer_path("byte_bpe_50k.json")).collect()
    assert len(out) == len(ROWS) and sorted((r["doc_id"] or 0, r["decoded"]) for r in out) == sorted((i or 0, t or "") for i, t in ROWS)
    assert bpe.encode(none, tokenizer_path("byte_bpe_50k.json")).count() == 0
    got = bpe.digests(docs, tokenizer_path("byte_bpe_50k.json")).where("n_tokens = 0").collect()
    assert {r["ids_sha256"] for r in got} == {hashlib.sha256(b"").hexdigest()} and len(got) == 2


def test_exact_dedup(spark, docs, none):
    index = DigestIndex(spark, buckets=4)
    out = {(r["doc_id"], r["keep_id"]): r for r in index.dedup(docs).collect()}
    assert out[1, 2]["group_size"] == 3 and not out[1, 2]["kept"] and out[2, 2]["kept"]
    assert out[3, 4]["group_size"] == 2 and out[None, None]["kept"] and out[None, None]["group_size"] == 1
    # A later batch finds what an earlier one holds.
    assert [r["kept"] for r in index.dedup(docs.where("doc_id = 5")).collect()] == [False]
    index.drop()
    assert DigestIndex(spark, buckets=4).dedup(none).count() == 0
    kept = DigestIndex(spark, buckets=4).kept_rows(docs.withColumn("_digest", F.lit("mine")).withColumn("id", F.lit("own")))
    assert kept.columns == [*docs.columns, "_digest", "id"] and kept.count() == 8 and {r["_digest"] + r["id"] for r in kept.collect()} == {"mineown"}


def test_exact_dedup_in_batches(spark, docs):
    rows = lambda df: sorted(map(str, df.collect()))
    want = rows(DigestIndex(spark, buckets=4).dedup(docs))
    assert rows(DigestIndex(spark, buckets=4).dedup(docs, parts=3)) == want
    index = DigestIndex(spark, buckets=4)
    # The result of a batch is lost after its append: repeating the batch gives the same result and adds nothing.
    assert rows(index.dedup(docs, batch="monday", parts=2)) == want
    size = index.read().count()
    assert rows(index.dedup(docs, batch="monday", parts=2)) == want and index.read().count() == size == 8
    assert index.dedup(docs, batch="tuesday").where("kept").count() == 0
    more = index.dedup(spark.createDataFrame([(70, "new text"), (71, "a b c"), (72, "new text")], "doc_id long, text string"), batch="wednesday")
    assert {r["doc_id"]: (r["kept"], r["keep_id"]) for r in more.collect()} == {70: (False, 72), 71: (False, 9), 72: (True, 72)}
    assert index.read().count() == size + 1


def test_exact_dedup_by_the_anti_join(spark, docs):
    """Texts of an earlier part are removed by the anti-join: a part's rows are grouped by themselves, and fewer are added."""
    rows = spark.createDataFrame([(i, f"text {i % 40}" if i % 3 else f"own {i}") for i in range(300)], "doc_id long, text string")
    index = DigestIndex(spark)
    out = {r["doc_id"]: r for r in index.dedup(rows, batch="b", parts=3).collect()}
    held = {r["batch"]: r["count"] for r in index.read().groupBy("batch").count().collect()}
    text = {r["doc_id"]: r["text"] for r in rows.collect()}
    last = {t: max(i for i, x in text.items() if x == t) for t in text.values()}
    assert {i: r["keep_id"] for i, r in out.items()} == {i: last[t] for i, t in text.items()} and sum(held.values()) == len(last)
    assert all(r["kept"] == (r["keep_id"] == i) and r["group_size"] == list(text.values()).count(text[i]) for i, r in out.items())
    # What parts group by themselves is more than what is added: the anti-join has removed the difference.
    least = {b: min(i for i, r in out.items() if r["kept"] and i in set(x["keep_id"] for x in index.read().where(F.col("batch") == b).collect())) for b in held}
    first = {t for i, t in text.items() if i >= least["b"]}
    assert set(held) == {"b", "b/1", "b/2"} and len(first) + len({t for i, t in text.items() if i < least["b"]}) > len(last)
    again = DigestIndex(spark, index.name)
    assert again.dedup(rows.limit(5), batch="c").where("kept").count() == 0 and again.buckets == 8
    index.drop()
    # Keys of any ordered kind.
    named = rows.withColumn("doc_id", F.format_string("k%03d", "doc_id"))
    assert {r["doc_id"]: r["keep_id"] for r in DigestIndex(spark).dedup(named, parts=4).collect()} == {f"k{i:03d}": f"k{last[t]:03d}" for i, t in text.items()}


def test_line_dedup(spark, docs, none):
    out = line_dedup.dedup_lines(docs)
    rows = {(r["doc_id"], r["text"]): r for r in out.collect()}
    assert out.count() == len(ROWS) and (1, "one two three four five six") in rows and (2, "") in rows
    assert rows[None, "lonely text with no id at all"]["n_dropped"] == 0 and rows[4, ""]["n_lines"] == 1
    assert line_dedup.dedup_lines(none).count() == 0
    # Rows of one key keep their own lines; columns may bear any name.
    again = "this line recurs in other documents too"
    some = spark.createDataFrame([(1, again, 1), (2, "unique text of the second row\nmore of it", 2), (2, again + "\nkeep me here", 3), (3, "77\n78", 4), (4, "77", 5)], "doc_id long, text string, key int")
    some = some.select("*", *[F.col("key").alias(c) for c in ("_key", "key_", "d", "gone", "again", "h", "line", "_gone", "_recurring")])
    out = line_dedup.dedup_lines(some)
    assert sorted((r["key"], r["text"], r["again"]) for r in out.collect()) == [(1, again, 1), (2, "unique text of the second row\nmore of it", 2), (3, "keep me here", 3), (4, "77\n78", 4), (5, "77", 5)]
    assert out.columns == [*some.columns, "n_lines", "n_recurring", "n_dropped"]


def test_language_model(docs, none):
    out = lm.score(docs, docs).collect()
    assert len(out) == len(ROWS) and all(r["base_score"] < 0 and r["score"] < 0 for r in out)
    assert {r["n_tokens"] for r in out if r["doc_id"] in (3, 4, 7)} == {1}
    assert lm.score(none, docs).count() == 0
    blind = lm.score(docs, none).collect()
    assert {r["n_known"] for r in blind} == {0} and {r["train_tokens"] for r in blind} == {0}


def test_packing(docs, none):
    path = tokenizer_path("word_bpe_49k.json")
    out = packing.pack(docs, path).collect()
    assert sum(r["length"] for r in out) == sum({(r["doc_id"], r["doc_tokens"]): r["doc_tokens"] for r in out if r["doc_id"] != 2}.values()) + sum(r["length"] for r in out if r["doc_id"] == 2)
    by = {}
    for r in out:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096 and at & (at - 1) == 0
    assert packing.pack(none, path).count() == 0


def test_html(spark):
    rows = [(1, None, "u"), (2, "", "u"), (3, "<p>" + "word " * 50 + ".</p>", "u"), (3, "<p>" + "word " * 50 + ".</p>", "u"), (None, "<nav>x</nav><article><h1>A &amp; B</h1>one<br>two<p>three", "u"), (4, "<", "u"), (5, "<!-- open", "u")]
    pages = spark.createDataFrame(rows, "page_id long, html string, text string")
    out = {(r["page_id"], r["text"]) for r in html.extract(pages).collect()}
    assert (1, "") in out and (2, "") in out and (None, "A & B\none two\nthree") in out and (5, "") in out
    assert html.extract(pages).count() == len(rows) and html.extract(pages.limit(0)).count() == 0


def test_fingerprints(docs, none):
    out = fingerprint.edited_fingerprints(docs).collect()
    by = {}
    for r in out:
        by.setdefault(r["doc_id"], []).append(r)
    assert len(out) == len(ROWS) and by[1][0]["fingerprint"] == by[2][0]["fingerprint"] == by[2][1]["fingerprint"]
    assert by[3][0]["fingerprint"] == by[4][0]["fingerprint"] == by[7][0]["fingerprint"] != by[1][0]["fingerprint"]
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in out)
    assert fingerprint.edited_fingerprints(none).count() == 0
    assert fingerprint.fingerprints(docs).count() == len(ROWS)
    assert fingerprint.fingerprints(docs).where("doc_id = 1").first()["fingerprint"] == by[1][0]["fingerprint"]


def test_toxicity(docs, none, labels):
    out = toxicity.classify(docs, labels).collect()
    assert len(out) == len(ROWS) and all(0 <= r["score"] <= 1 for r in out)
    assert toxicity.classify(none, labels).count() == 0
    assert {r["predicted"] for r in toxicity.classify(docs, labels.limit(0)).collect()} <= {0, 1}


def test_minhash(docs, none):
    out = {(r["doc_id"], r["component_id"]): r for r in minhash.near_duplicates(docs).collect()}
    assert (2, 1) in out and (6, 5) in out and not out[2, 1]["kept"] and out[1, 1]["kept"]
    assert out[3, 3]["n_shingles"] == 0 and out[9, 9]["n_shingles"] == 1 and (None, None) in out
    assert minhash.near_duplicates(none).count() == 0
    kept = minhash.kept_rows(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 3, 4, 5, 7, 8, 9]


def test_quality(docs, none, labels):
    out = quality.classify(docs, labels).collect()
    assert len(out) == len(ROWS) and all(0 <= r["score"] <= 1 for r in out)
    assert len({r["score"] for r in out if r["doc_id"] in (3, 4, 7)}) == 1
    assert quality.classify(none, labels).count() == 0 and quality.classify(docs, labels.limit(0)).count() == len(ROWS)
