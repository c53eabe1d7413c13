"""Toxicity of documents whose words may be disguised.

A noisy channel turns letters into look-alikes, repeats them or spaces them out. For every distinct word
that shows such marks a lattice of the characters it may stand for is decoded by Viterbi under a character
trigram model of the whole corpus; runs of single characters are decoded with optional blanks between
them. The restored words (and their beginnings) carry evidence counted on labelled documents; a document's
score joins the evidence of its distinct words.
"""

from __future__ import annotations

import math
import os
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievecraft.llm.common import SLAB_BYTES, list_parts, logistic, map_arrow, materialise, offsets_of, sampled, slabs, texts
from sievecraft.llm.dedup import digest

#: Characters that stand for letters.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i",
}
#: Letters of the character model; all others share one symbol. "*" in a word stands for any of the first 26.
ALPHABET = "abcdefghijklmnopqrstuvwxyzßàáâäåæçèéêëìíîïñòóôöøùúûüÿœ"
#: Costs (natural logarithm) of a look-alike, of dropping a repeat, of leaving out a blank, of a digit as it stands.
SUBSTITUTE, COLLAPSE, JOIN, LITERAL = -1.0, -0.3, -0.2, -4.0
#: Labelled documents that the evidence is counted on, those with the least hash first: the bound of what is learnt.
MAX_LABELLED = 20_000
#: A feature's least log-likelihood ratio.
LEAST_RATIO = 15.0
#: Stars in a row that no longer stand for letters but part words; places after which what all paths share is put by.
STARS, SETTLE = 5, 64
#: Shortest and longest beginnings of words that count as features.
SHORTEST, LONGEST = 4, 8

_ENDS = frozenset(".,;:?!\"')]}>")
_HIDDEN = re.compile("[​-‏⁠﻿­]")
_MARKS = re.compile(r"[0-9@$!|+(*€£¡аеорсхуі]|([^\W\d_])\1\1")
_SPACED = re.compile(r"^[\w@$!|+*][.\-_*~·](?:[\w@$!|+*][.\-_*~·])+[\w@$!|+*]$")
_LETTER = re.compile(r"[^\W\d_]")


def trimmed(word: str) -> str:
    """A word without punctuation and repeated symbols at its end."""
    end = len(word)
    while end:
        c = word[end - 1]
        if c in _ENDS:
            end -= 1
        elif end > 1 and word[end - 2] == c and not (c.isalnum() or c == "_"):
            while end and word[end - 1] == c:
                end -= 1
        else:
            break
    return word[:end]


class CharModel:
    """Character trigrams, interpolated with bigrams and single characters."""

    def __init__(self, counts: np.ndarray):
        k = len(ALPHABET) + 2
        tri = counts.reshape(k, k, k).astype(np.float64)
        bi, uni = tri.sum(0), tri.sum((0, 1))
        p1 = (uni + 1) / (uni.sum() + k)
        p2 = (bi + 5 * p1) / (bi.sum(1, keepdims=True) + 5)
        p3 = (tri + 5 * p2[None]) / (tri.sum(2, keepdims=True) + 5)
        self.log = np.log(p3)
        self.symbol = {c: i + 2 for i, c in enumerate(ALPHABET)}

    def step(self, a: int, b: int, c: int) -> float:
        return float(self.log[a, b, c])


def trigram_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of symbol trigrams of words: 0 any other character, 1 a word's edge, then the alphabet."""
    k = len(ALPHABET) + 2
    table = np.zeros(0x250, np.int64)
    for i, c in enumerate(ALPHABET):
        table[ord(c)] = i + 2
    table[[9, 10, 11, 12, 13, 32]] = 1
    total = np.zeros(k**3, np.int64)
    for batch in slabs(batches, "t", 4 << 20):
        joined = " ".join(pc.utf8_lower(texts(batch, "t")).to_pylist())
        points = np.frombuffer(f"  {joined}  ".encode("utf-32-le"), np.uint32)
        s = table[np.where(points < len(table), points, 0)]
        total += np.bincount((s[:-2] * k + s[1:-1]) * k + s[2:], minlength=k**3)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["gram", "c"])


def char_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Trigram counts of all documents: a dense table whose size the alphabet bounds."""
    rows = map_arrow(docs.select(F.col(text).alias("t")), trigram_counts, "gram bigint, c bigint").groupBy("gram").agg(F.sum("c").alias("c")).collect()
    counts = np.zeros((len(ALPHABET) + 2) ** 3, np.int64)
    for r in rows:
        counts[r["gram"]] = r["c"]
    return counts


def lattice(word: str, spaced: bool) -> Iterator[list[tuple[str, float]]]:
    """Choices (letters, cost) of each place of a word; between places of a spaced word a blank or none."""
    i = 0
    while i < len(word):
        c = word[i]
        run = 1
        while i + run < len(word) and word[i + run] == c:
            run += 1
        options = [(c, 0.0 if c in ALPHABET else LITERAL)] + [(x, SUBSTITUTE) for x in LOOKALIKES.get(c, "")]
        if c == "*":
            options = [(x, -1.0) for x in ALPHABET[:26]]
        if run >= 3 and c != "*":
            yield [(x * m, cost + COLLAPSE) for x, cost in options for m in (1, 2)]
            i += run
        else:
            yield options
            i += 1
        if spaced and i < len(word):
            yield [("", JOIN), (" ", 0.0)]


def decode(word: str, model: CharModel, spaced: bool = False, settle: int = SETTLE) -> str:
    """The most probable letters behind a word of any length: Viterbi over its lattice, states being the last two symbols.

    What all paths have in common is settled every `settle` places and put by, which changes nothing but keeps them short.
    """
    best: dict[tuple[int, int], tuple[float, str]] = {(1, 1): (0.0, "")}
    out: list[str] = []
    for place, options in enumerate(chain(lattice(word, spaced), [[(" ", 0.0)]]), 1):
        after: dict[tuple[int, int], tuple[float, str]] = {}
        for (a, b), (score, so_far) in best.items():
            for letters, cost in options:
                p, x, y = score + cost, a, b
                for c in letters:
                    z = 1 if c == " " else model.symbol.get(c, 0)
                    p += model.step(x, y, z)
                    x, y = y, z
                if (x, y) not in after or p > after[x, y][0]:
                    after[x, y] = (p, so_far + letters)
        best = after
        if place % settle == 0:
            common = os.path.commonprefix([so_far for _, so_far in best.values()])
            out.append(common)
            best = {state: (p, so_far[len(common) :]) for state, (p, so_far) in best.items()}
    return ("".join(out) + max(best.values())[1]).strip()


class Restorer:
    """Words of texts with disguises undone."""

    def __init__(self, counts: np.ndarray):
        self.model = CharModel(counts)
        self.seen: dict[tuple[str, bool], str] = {}

    def _decode(self, word: str, spaced: bool) -> str:
        """The restored word; long rows of stars part words."""
        if len(self.seen) > 200_000:
            self.seen = {}
        if (word, spaced) not in self.seen:
            parts = [p for p in re.split(r"\*{%d,}" % STARS, word) if p]
            self.seen[word, spaced] = " ".join(decode(p, self.model, spaced) for p in parts)
        return self.seen[word, spaced]

    def word(self, raw: str) -> list[str]:
        """Restored words of one word between blanks."""
        w = raw.lower()
        if w.isalpha() and (w.isascii() or not _MARKS.search(w)) and not re.search(r"(.)\1\1", w):
            return [w]
        w = _HIDDEN.sub("", w)
        bare = trimmed(w)
        bare = bare.lstrip("\"'([{<.,;:?#%&~`-_=/\\")
        if not bare or not _LETTER.search(bare) and not any(c in LOOKALIKES for c in bare):
            return []
        if _SPACED.match(bare):
            return self._decode(bare[::2], False).split()
        if not _LETTER.search(bare):
            return []
        if _MARKS.search(bare):
            return [x for x in re.split(r"[^\w]+", self._decode(bare, False)) if x]
        return [x for x in re.split(r"[^\w]+|_", bare) if x]

    def batch(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, list[list[str]]]:
        """Row and code of each word of each text, and the restored words of each code."""
        parts, counts = list_parts(pc.ascii_split_whitespace(column))
        coded = parts.dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        names = coded.dictionary.to_pylist()
        words = [self.word(w) for w in names]
        rows = np.repeat(np.arange(len(counts)), counts)
        # Three or more single characters in a row may be one word spaced out.
        single = np.array([len(w) == 1 and (w.isalpha() or w.lower() in LOOKALIKES or w == "*") for w in names], bool)
        if single.any():
            hit = single[codes]
            edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
            for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                for r in np.unique(rows[a:b]).tolist():
                    inside = np.flatnonzero(rows[a:b] == r) + a
                    if len(inside) >= 3:
                        spaced = "".join(names[c].lower() for c in codes[inside])
                        found = {*self._decode(spaced, True).split(), *self._decode(spaced, False).split()}
                        codes[inside[0]] = len(words)
                        words.append(sorted(w for w in found if len(w) > 1))
        return rows, codes, words


def features(words: list[str]) -> list[str]:
    """A restored word and its beginnings (these end in a mark)."""
    return [f for w in words for f in (w, *(w[:k] + "~" for k in range(SHORTEST, min(LONGEST, len(w)) + 1)))]


class Evidence:
    """Log-odds of features, and the weights of a document's sum, greatest, number and density of them."""

    def __init__(self, weights: dict[str, float], final: np.ndarray):
        self.weights, self.final = weights, final

    def weight(self, words: list[str]) -> float:
        return max((self.weights.get(f, 0.0) for f in features(words)), default=0.0)

    def columns(self, restorer: Restorer, column: pa.Array) -> np.ndarray:
        rows, codes, words = restorer.batch(column)
        each = np.array([self.weight(w) for w in words] or [0.0])
        hits = np.flatnonzero(each[codes] > 0) if len(codes) else np.zeros(0, np.int64)
        pairs = np.unique(np.stack((rows[hits], codes[hits]), 1), axis=0)
        out = np.zeros((len(column), 5))
        out[:, 0] = 1
        np.add.at(out[:, 1], pairs[:, 0], each[pairs[:, 1]])
        np.maximum.at(out[:, 2], pairs[:, 0], each[pairs[:, 1]])
        np.add.at(out[:, 3], pairs[:, 0], 1)
        size = np.bincount(rows, minlength=len(column))
        out[:, 4] = np.log1p(100 * out[:, 3] / np.maximum(size, 1))
        out[:, 1], out[:, 3] = np.log1p(out[:, 1]), np.log1p(out[:, 3])
        return out

    def scores(self, restorer: Restorer, column: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.columns(restorer, column) @ self.final, -30, 30)))


def _counts(labelled: DataFrame, char: np.ndarray, only: set[str] | None) -> DataFrame:
    """feature, toxic, clean: documents (columns t, y) that hold it; of the toxic ones only, or of a set of features."""
    shared = labelled.sparkSession.sparkContext.broadcast((char, only))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        char, only = shared.value
        restorer = restorer_of(char)
        for batch in slabs(batches, "t", SLAB_BYTES // 4):
            rows, codes, words = restorer.batch(texts(batch, "t"))
            named = [features(w) if only is None else [f for f in features(w) if f in only] for w in words]
            y = batch.column("y").to_pylist()
            pairs = np.unique(np.stack((rows, codes), 1), axis=0)
            found: dict[str, list[int]] = {}
            cuts = offsets_of(np.bincount(pairs[:, 0], minlength=batch.num_rows))
            for r in range(batch.num_rows):
                for f in {f for c in pairs[cuts[r] : cuts[r + 1], 1].tolist() for f in named[c]}:
                    found.setdefault(f, [0, 0])[y[r] != 1] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), *[pa.array([v[i] for v in found.values()], pa.int64()) for i in (0, 1)]], names=["feature", "toxic", "clean"])

    return map_arrow(labelled, run, "feature string, toxic bigint, clean bigint").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


_restorers: dict[int, Restorer] = {}


def restorer_of(char: np.ndarray) -> Restorer:
    """One restorer for all tasks of a worker."""
    key = hash(char.tobytes())
    if key not in _restorers:
        _restorers.clear()
        _restorers[key] = Restorer(char)
    return _restorers[key]


def ratio(toxic: int, clean: int, share: float) -> float:
    """Log-likelihood ratio of a feature's toxic share against the share of all."""
    n, p = toxic + clean, toxic / (toxic + clean)
    return 2 * sum(c * math.log(c / n / q) for c, q in ((toxic, share), (clean, 1 - share)) if c) if p > share else 0.0


def train(labelled: DataFrame, char: np.ndarray) -> Evidence:
    """Evidence from documents (key, t, y), a bounded sample (see `sampled`), which bounds the features collected here."""
    sample = labelled.select("t", "y")
    sample = materialise(sample, "labelled")
    sizes = sample.agg(F.sum("y").alias("toxic"), F.count(F.lit(1)).alias("n")).first()
    n, toxic = sizes["n"] or 0, sizes["toxic"] or 0
    share = (toxic + 0.5) / (n + 1)
    nothing = np.array([math.log(share / (1 - share)), 0, 0, 0, 0])
    if not toxic or toxic == n:
        return Evidence({}, nothing)
    # A feature of fewer toxic documents could not reach the ratio even if no clean one held it.
    least = LEAST_RATIO / (2 * math.log(n / toxic))
    some = _counts(sample.where("y = 1"), char, None).where(F.col("toxic") >= least).collect()
    both = _counts(sample, char, {r["feature"] for r in some}).collect()
    kept = sorted(((ratio(r["toxic"], r["clean"], toxic / n), r["feature"], r["toxic"], r["clean"]) for r in both), reverse=True)
    kept = [x for x in kept if x[0] >= LEAST_RATIO]
    weights = {f: max(0.0, math.log((t + 0.5) / (toxic + 1) / ((c + 0.5) / (n - toxic + 1)))) for _, f, t, c in kept}
    rows = _columns(sample.select(F.col("y").alias("key"), "t"), char, Evidence(weights, nothing), False).collect()
    x, y = np.array([r["x"] for r in rows]), np.array([r["key"] for r in rows])
    return Evidence(weights, logistic(x, y))


def _columns(rows: DataFrame, char: np.ndarray, evidence: Evidence, joined: bool) -> DataFrame:
    """key with the score (joined) or the columns that it is made of, x."""
    shared = rows.sparkSession.sparkContext.broadcast((char, evidence.weights, evidence.final))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        char, weights, final = shared.value
        restorer, model = restorer_of(char), Evidence(weights, final)
        for batch in slabs(batches, "t", SLAB_BYTES // 8):
            column = texts(batch, "t")
            out = pa.array(model.scores(restorer, column)) if joined else pa.array(model.columns(restorer, column).tolist(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("key"), out], names=["key", "score" if joined else "x"])

    kind = rows.schema["key"].dataType.simpleString()
    return map_arrow(rows.select("key", "t"), run, f"key {kind}, " + ("score double" if joined else "x array<double>"))


def score(rows: DataFrame, char: np.ndarray, evidence: Evidence) -> DataFrame:
    """key and score of documents (key, t). Texts without words score as documents without evidence do."""
    return _columns(rows, char, evidence, True)


def restore(docs: DataFrame, char: np.ndarray, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key and the restored text (words joined by blanks, lower case) of each document; empty for null."""
    shared = docs.sparkSession.sparkContext.broadcast(char)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = restorer_of(shared.value)
        for batch in slabs(batches, "t", SLAB_BYTES // 4):
            rows, codes, words = restorer.batch(texts(batch, "t"))
            cuts = offsets_of(np.bincount(rows, minlength=batch.num_rows))
            out = [" ".join(w for c in codes[cuts[r] : cuts[r + 1]].tolist() for w in words[c]) for r in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(out, pa.string())], names=["key", "restored"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("t"))
    return map_arrow(rows, run, f"key {rows.schema['key'].dataType.simpleString()}, restored string").withColumnRenamed("key", key)


def classify(docs: DataFrame, labelled: DataFrame, label: str = "toxic", threshold: float = 0.3, text: str = "text", key: str = "doc_id", digests: bool = False) -> DataFrame:
    """One row per document: key, score (0 to 1, higher: more likely toxic), predicted (score >= threshold).

    `labelled` has key and label of the documents that may be learnt from. Labels other than 0 and 1 are ignored
    there, and rows without text count as empty texts; documents with a null key or text are scored like others (null text:
    empty), repeated rows each give a row, and without any toxic label all score low alike. With `digests` each
    row also has the digest of its text, so that rows of one key can be told apart.
    """
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    char = char_counts(docs, text)
    known = sampled(labelled.where(F.col(label).isin(0, 1)).select(F.col(key).alias("key"), F.col(label).cast("int").alias("y")), MAX_LABELLED)
    evidence = train(rows.join(F.broadcast(known), "key"), char)
    if digests:
        out = score(rows.select(F.struct("key", digest("t").alias("digest")).alias("key"), "t"), char, evidence).select("key.*", "score")
    else:
        out = score(rows, char, evidence)
    return out.select(F.col("key").alias(key), *["digest"] * digests, "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
