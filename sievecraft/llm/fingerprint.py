"""Canonical exact digests of documents, in DataFrame functions alone.

A text is brought to one form (Unicode compatibility composition, lower case, single blanks) and digested by
independent xxhash lanes: two over all of it, and one for each of its stretches, whose lengths double along
the text. The digest is equal exactly if the canonical texts are: rows that share one are compared byte by
byte, and a bucket with unlike bytes gets the SHA-256 of the text added. Of unlike texts the stretches tell
how much stands unchanged in its place (`likeness`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievecraft.llm.common import materialise

#: Characters of the first stretch; the next two are half as long, the two after them twice that, and so on.
FIRST = 64
#: White space that folds to one blank, ASCII and beyond.
BLANKS = r"(?U)[\s\x1c-\x1f\x{200b}\x{feff}]+"
#: Rows that one range of keys aims at, and the most ranges.
RANGE_ROWS, RANGES = 4_000, 100_000


def canonical(text: Column) -> Column:
    """The form in which texts are compared; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    composed = F.when(text.rlike(r"[^\x00-\x7f]"), F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))).otherwise(text)
    return F.regexp_replace(F.regexp_replace(F.lower(composed), BLANKS, " "), "^ | $", "")


def _stretch(i: Column) -> tuple[Column, Column]:
    """Start and length of stretch i."""
    half = F.lit(FIRST // 2) * F.pow(F.lit(2.0), F.floor((i - 1) / 2))
    start = F.when(i == 0, F.lit(0)).otherwise((half * (2 + (i - 1) % 2)).cast("int"))
    return start, F.when(i == 0, F.lit(FIRST)).otherwise(half.cast("int"))


def _stretches(n: Column) -> Column:
    """Number of stretches of a text of n characters."""
    octave = F.floor(F.log2(F.greatest(n, F.lit(FIRST)) / FIRST)).cast("int")
    into = F.when(n <= FIRST, 0).otherwise(F.when(n > 1.5 * FIRST * F.pow(F.lit(2.0), octave), 2).when(n > FIRST * F.pow(F.lit(2.0), octave), 1).otherwise(0))
    return (1 + F.when(n <= FIRST, 0).otherwise(2 * octave + into)).cast("int")


def lanes(canon: Column) -> Column:
    """Digest of a canonical text: struct of wide (32 hex digits), n (characters) and lanes (array of 64-bit)."""
    n = F.length(canon)
    each = F.transform(F.sequence(F.lit(0), _stretches(n) - 1), lambda i: F.xxhash64(F.lit("stretch"), i, F.substr(canon, _stretch(i)[0] + 1, _stretch(i)[1])))
    wide = F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(k), canon)), 16, "0") for k in ("one", "two")])
    return F.struct(F.lower(wide).alias("wide"), n.alias("n"), each.alias("lanes"))


def likeness(a: Column, b: Column) -> Column:
    """Share of characters in equal stretches, of the longer text; 1 for equal digests."""

    def weight(i: Column) -> Column:
        start, length = _stretch(i)
        return F.greatest(F.lit(0), F.least(length, F.least(a["n"], b["n"]) - start))

    both = F.sequence(F.lit(0), F.least(F.size(a["lanes"]), F.size(b["lanes"])) - 1)
    same = F.aggregate(both, F.lit(0), lambda total, i: total + F.when(F.get(a["lanes"], i) == F.get(b["lanes"], i), weight(i)).otherwise(0))
    return F.when(a["wide"] == b["wide"], F.lit(1.0)).otherwise(F.least(F.lit(1.0), same / F.greatest(a["n"], b["n"], F.lit(1))))


def as_text(digest: Column) -> Column:
    parts = F.transform(digest["lanes"], lambda x: F.right(F.lpad(F.hex(x), F.lit(16), F.lit("0")), F.lit(8)))
    return F.concat(digest["wide"], F.lit(":"), digest["n"].cast("string"), F.lit(":"), F.lower(F.array_join(parts, "")))


def unlike_buckets(docs: DataFrame, digested: DataFrame, text: str, key: str) -> DataFrame:
    """Buckets (wide) that hold unlike canonical texts. `digested` has key and wide of every document.

    Only documents of buckets with several rows are compared, by the least and greatest bytes of a bucket,
    which combine before the shuffle: a bucket of any size costs a row per task.
    """
    several = digested.groupBy("wide").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("wide")
    ids = materialise(digested.join(several, "wide").select(F.col(key).alias("_key")).distinct(), "several")
    again = docs.join(ids, docs[key].eqNullSafe(ids["_key"]), "left_semi").select(canonical(F.col(text)).alias("canon"))
    again = again.select(lanes(F.col("canon"))["wide"].alias("wide"), F.encode("canon", "UTF-8").alias("bytes"))
    return again.groupBy("wide").agg(F.min("bytes").alias("least"), F.max("bytes").alias("most")).where("least <> most").select("wide")


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_chars and fingerprint of each document; the row's own digest, as in `edited_fingerprints`."""
    rows = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("t")).withColumn("canon", canonical(F.col("t")))
    rows = rows.select(key, F.length("t").cast("long").alias("n_chars"), lanes(F.col("canon")).alias("digest"), F.sha2("canon", 256).alias("exact"))
    rows = materialise(rows, "digests")
    unlike = unlike_buckets(docs, rows.select(key, "digest.wide"), text, key).withColumn("mark", F.lit(True))
    rows = rows.withColumn("wide", F.col("digest.wide")).join(unlike, "wide", "left")
    return rows.select(key, "n_chars", F.concat(as_text(F.col("digest")), F.when(F.col("mark"), F.concat(F.lit(":"), "exact")).otherwise("")).alias("fingerprint"))


def _ranges(docs: DataFrame, key: Column) -> list[int]:
    """Keys that begin ranges of about RANGE_ROWS rows each, the first key included: a bounded list."""
    n = docs.count()
    parts = max(1, min(RANGES, n // RANGE_ROWS))
    found = docs.agg(F.min(key).alias("low"), F.percentile_approx(key, [k / parts for k in range(1, parts)] or [0.5], F.lit(max(10_000, 10 * parts))).alias("cuts")).first()
    if found is None or found["low"] is None:
        return []
    return sorted({found["low"], *(found["cuts"] if parts > 1 else [])})


def edited_fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last floor(n_chars / 2) characters replaced by the first as many (or all) of the
    next document by key, after the last by those of the first. Null text counts as empty; a null key comes
    before all others; rows of one key follow each other in an order of their texts; a document alone follows
    itself. No rows give no rows. The order is found by ranges of keys, each sorted by itself; the document
    that begins a range is also sent to the range before it.
    """
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    rows = rows.withColumn("at", F.coalesce("key", F.lit(-(2**63))))
    cuts = _ranges(rows.select("at"), F.col("at"))
    if not cuts:
        cuts = [0]
    table = F.array(*[F.lit(c).cast("long") for c in cuts]) if len(cuts) < 1000 else F.from_json(F.lit(str(cuts)), "array<bigint>")
    steps = F.sequence(F.lit(1), F.lit(max(1, len(cuts).bit_length())))
    begin = F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        right = F.get(table, mid) <= F.col("at")
        done = s["lo"] >= s["hi"] - 1
        return F.struct(F.when(~done & right, mid).otherwise(s["lo"]).alias("lo"), F.when(~done & ~right, mid).otherwise(s["hi"]).alias("hi"))

    rows = rows.withColumn("range", F.aggregate(steps, begin, halve)["lo"])
    starts = F.get(table, F.col("range")) == F.col("at")
    before = F.when(F.col("range") > 0, F.col("range") - 1).otherwise(len(cuts) - 1)
    copies = F.array(F.struct(F.col("range").alias("range"), F.lit(False).alias("ghost"), F.lit(False).alias("wrap")))
    ghosts = F.when(starts, F.array(F.struct(before.alias("range"), F.lit(True).alias("ghost"), (F.col("range") == 0).alias("wrap")))).otherwise(F.array().cast("array<struct<range:int,ghost:boolean,wrap:boolean>>"))
    rows = rows.withColumn("canon", canonical(F.col("t"))).withColumn("digest", lanes(F.col("canon"))).withColumn("place", F.explode(F.concat(copies, ghosts)))
    rows = rows.select("key", "t", "at", "digest", "place.*")
    following = Window.partitionBy("range").orderBy("wrap", "at", F.col("digest.wide"), F.xxhash64("t"))
    rows = rows.withColumn("next", F.lead(F.struct(F.col("t").alias("t"), F.col("digest").alias("digest"))).over(following)).where(~F.col("ghost"))
    n, half = F.length("t"), F.floor(F.length("t") / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substr("t", F.lit(1), n - half), F.substr("next.t", F.lit(1), half)))
    rows = rows.withColumn("canon", canonical(F.col("edited"))).withColumn("changed", lanes(F.col("canon")))
    out = rows.select(
        F.col("key").alias(key), n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), F.col("digest.wide").alias("wide"), as_text(F.col("digest")).alias("fingerprint"),
        as_text(F.col("changed")).alias("edited_fingerprint"), likeness(F.col("digest"), F.col("changed")).alias("near_edited"), likeness(F.col("digest"), F.col("next.digest")).alias("near_next"),
        F.sha2(canonical(F.col("t")), 256).alias("exact"), F.col("changed.wide").alias("edited_wide"), F.sha2("canon", 256).alias("edited_exact"),
    )
    out = materialise(out, "fingerprints")
    # Edited texts, of which the bytes are gone, are told apart from documents and each other by SHA-256.
    both = out.select("wide", "exact").unionByName(out.select(F.col("edited_wide").alias("wide"), F.col("edited_exact").alias("exact")))
    apart = both.groupBy("wide").agg(F.min("exact").alias("least"), F.max("exact").alias("most")).where("least <> most").select("wide")
    unlike = materialise(unlike_buckets(docs, out.select(key, "wide"), text, key).unionByName(apart).distinct(), "unlike")
    out = _marked(out, unlike, "wide", "fingerprint", "exact")
    out = _marked(out, unlike, "edited_wide", "edited_fingerprint", "edited_exact")
    return out.select(key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def _marked(rows: DataFrame, unlike: DataFrame, wide: str, name: str, exact: str) -> DataFrame:
    """Rows whose fingerprint has the exact digest added where its bucket is among the unlike ones."""
    out = rows.join(unlike.select(F.col("wide").alias(wide), F.lit(True).alias("mark")), wide, "left")
    return out.withColumn(name, F.concat(name, F.when(F.col("mark"), F.concat(F.lit(":"), exact)).otherwise(""))).drop("mark")
