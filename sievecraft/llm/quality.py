"""Document quality from a linear-chain conditional random field over lines.

Every line of a text is good or bad. Its evidence is the binned shape of the line and of its neighbours
(letters, capitals, symbols, repetition, length); a transition weight ties adjacent lines. Forward and backward
sums give each line's marginal, and the marginals weighted by length the document's score.

Labels exist for documents only. All lines of a bad document first count as bad; after each fit its lines
that look good are relabelled (the worst one never), and the field is fitted again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievecraft.llm.common import SLAB_BYTES, list_parts, logistic, map_arrow, offsets_of, sampled, slabs, sums_by_row, texts
from sievecraft.llm.dedup import digest

#: Labelled documents to fit on (those with the least hash), and lines in all of them: the bounds of what is learnt.
MAX_LABELLED, MAX_LINES = 4_000, 200_000
#: Bins of a measure, fits, and steps of each.
BINS, FITS, STEPS = 8, 3, 120
MEASURES = 14


def lines_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Measures of each non-blank line (rows of a matrix), its document and its length in characters."""
    lines, counts = list_parts(pc.split_pattern(column, "\n"))
    doc = np.repeat(np.arange(len(column)), counts)
    lines = pc.ascii_trim_whitespace(lines)
    full = pc.not_equal(lines, "").to_numpy(zero_copy_only=False)
    lines, doc = lines.filter(pa.array(full)), doc[full]
    if not len(doc):
        return np.zeros((0, MEASURES)), doc, np.zeros(0, np.int64)
    size = pc.utf8_length(lines).to_numpy(zero_copy_only=False).astype(np.int64)
    points = np.frombuffer("".join(lines.to_pylist()).encode("utf-32-le"), np.uint32)
    kind = _kinds()[np.minimum(points, 0x2FF)]
    share = {k: sums_by_row((kind == k).astype(np.int64), size) / size for k in range(6)}
    words, n = list_parts(pc.ascii_split_whitespace(lines))
    coded = words.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    line = np.repeat(np.arange(len(n)), n)
    again = np.concatenate(([False], (codes[1:] == codes[:-1]) & (line[1:] == line[:-1])))
    pairs = np.sort(line * (len(coded.dictionary) + 1) + codes)
    distinct = np.bincount(pairs[np.concatenate(([True], pairs[1:] != pairs[:-1]))] // (len(coded.dictionary) + 1), minlength=len(n))
    last = points[np.cumsum(size) - 1]
    first = points[np.cumsum(size) - size]
    lengths = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    one = sums_by_row((lengths == 1).astype(np.int64), n) / n
    longest = np.maximum.reduceat(lengths, offsets_of(n)[:-1])
    ends = np.isin(last, np.array([ord(c) for c in ".!?:;\"'"]))
    return (
        np.stack([share[0], share[1], share[2], share[3], share[4], share[5], np.log1p(size), np.log1p(n), size / n, sums_by_row(again.astype(np.int64), n) / n, distinct / n, one, np.log1p(longest), ends + 2.0 * (_kinds()[np.minimum(first, 0x2FF)] == 1)], 1),
        doc,
        size,
    )


def _kinds() -> np.ndarray:
    """Class of a code point: 0 small letter or other script, 1 capital, 2 digit, 3 blank, 4 symbol, 5 punctuation."""
    out = np.zeros(0x300, np.int8)
    for p in range(0x300):
        c = chr(p)
        out[p] = 1 if c.isupper() else 2 if c.isdigit() else 3 if c.isspace() else 0 if c.isalpha() else 5 if c in ".,;:'\"-()?" else 4
    out[0x2FF] = 0
    return out


class LineField:
    """Weights of the binned measures of a line and its neighbours, and of transitions (0 bad, 1 good)."""

    def __init__(self, cuts: np.ndarray):
        self.cuts = cuts  # measures x (BINS - 1)
        self.weights = np.zeros(3 * MEASURES * (BINS + 1) + 1)
        self.moves = np.zeros((2, 2))
        self.final = np.zeros(3)
        self.share = 0.5

    def active(self, measures: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Indices of the weights that each line turns on: its own bins, then those of the lines beside it."""
        own = np.stack([np.searchsorted(self.cuts[k], measures[:, k], side="right") for k in range(MEASURES)], 1)
        edge = np.full((1, MEASURES), BINS)  # the bin of no neighbour
        before, after = np.concatenate((edge, own[:-1])), np.concatenate((own[1:], edge))
        new = np.concatenate(([True], doc[1:] != doc[:-1]))
        before[new] = BINS
        after[np.concatenate((new[1:], [True]))] = BINS
        base = np.arange(3 * MEASURES) * (BINS + 1)
        return (np.concatenate((own, before, after), 1) + base).astype(np.int32)

    def marginals(self, active: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(good) of each line, and the expected transitions, by forward and backward sums over all documents at once."""
        if not len(doc):
            return np.zeros(0), np.zeros((2, 2))
        odds = np.clip(self.weights[active].sum(1) + self.weights[-1], -30, 30)
        local = np.stack((1 / (1 + np.exp(odds)), 1 / (1 + np.exp(-odds))), 1)
        starts = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
        sizes = np.diff(np.append(starts, len(doc)))
        order = np.argsort(-sizes, kind="stable")
        starts, sizes = starts[order], sizes[order]
        alive = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), side="right")  # chains with more than t lines
        move = np.exp(self.moves)
        fore, back = local.copy(), np.ones_like(local)
        fore[starts] /= fore[starts].sum(1, keepdims=True)
        for t in range(1, sizes[0]):
            at = starts[: alive[t]] + t
            f = (fore[at - 1] @ move) * local[at]
            fore[at] = f / f.sum(1, keepdims=True)
        expected = np.zeros((2, 2))
        for t in range(sizes[0] - 1, 0, -1):
            at = starts[: alive[t]] + t
            right = local[at] * back[at]
            b = right @ move.T
            both = fore[at - 1][:, :, None] * move[None] * right[:, None, :]
            expected += (both / both.sum((1, 2), keepdims=True)).sum(0)
            back[at - 1] = b / b.sum(1, keepdims=True)
        p = fore * back
        return p[:, 1] / p.sum(1), expected

    def fit(self, active: np.ndarray, doc: np.ndarray, good: np.ndarray, steps: int = STEPS, rate: float = 0.1, ridge: float = 1e-3) -> None:
        """Conditional maximum likelihood by Adam steps over all lines."""
        same = doc[1:] == doc[:-1]
        seen = np.zeros((2, 2))
        np.add.at(seen, (good[:-1][same].astype(int), good[1:][same].astype(int)), 1)
        theta = np.concatenate((self.weights, self.moves.ravel()))
        m, v, n = np.zeros_like(theta), np.zeros_like(theta), max(1, len(doc))
        for k in range(1, steps + 1):
            p, expected = self.marginals(active, doc)
            left = good - p
            unary = np.bincount(active.ravel(), np.repeat(left, active.shape[1]), minlength=len(self.weights))
            unary[-1] = left.sum()
            g = np.concatenate((unary, (seen - expected).ravel())) / n - ridge * theta
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            theta = theta + rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
            self.weights, self.moves = theta[:-4], theta[-4:].reshape(2, 2)

    def badness(self, measures: np.ndarray, doc: np.ndarray, size: np.ndarray, docs: int) -> np.ndarray:
        """Length-weighted mean of P(bad) of each document's lines; nan without lines."""
        p, _ = self.marginals(self.active(measures, doc), doc)
        total = np.bincount(doc, size, minlength=docs)
        with np.errstate(invalid="ignore"):
            return np.bincount(doc, (1 - p) * size, minlength=docs) / total

    def score(self, bad: np.ndarray) -> np.ndarray:
        """P(good) of documents with these shares of bad text; without text the share of good labels."""
        known = np.nan_to_num(bad)
        z = np.stack((np.ones_like(known), np.log(known + 1e-3), known), 1) @ self.final
        return np.where(np.isnan(bad), self.share, 1 / (1 + np.exp(-np.clip(z, -30, 30))))


def within(labelled: DataFrame, most: int) -> DataFrame:
    """The documents of a bounded sample (key, t, y), in the order of their hash, as long as their lines fit into `most`."""
    order = F.xxhash64("key")
    sizes = labelled.groupBy(order.alias("h")).agg(F.sum(F.size(F.split("t", "\n"))).alias("n")).orderBy("h").collect()
    out, room = [], most
    for r in sizes:
        if r["n"] <= room:
            room -= r["n"]
        else:
            out.append(r["h"])
    return labelled.where(~order.isin(out)) if out else labelled


def train(labelled: DataFrame, most: int = MAX_LINES) -> LineField:
    """A field fitted on documents (key, t, y), a bounded sample (see `sampled` and `within`), whose lines come together here."""
    sample = within(labelled, most).select("t", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slabs(batches, "t", SLAB_BYTES // 8):
            measures, doc, size = lines_of(texts(batch, "t"))
            at = offsets_of(np.bincount(doc, minlength=batch.num_rows))
            for i in range(batch.num_rows):
                part = measures[at[i] : at[i + 1]].astype("<f4").tobytes()
                yield pa.RecordBatch.from_arrays([batch.column("y").slice(i, 1).cast(pa.int32()), pa.array([part], pa.binary()), pa.array([size[at[i] : at[i + 1]].tobytes()], pa.binary())], names=["y", "m", "s"])

    rows = map_arrow(sample, run, "y int, m binary, s binary").collect()
    rows.sort(key=lambda r: (bytes(r["m"]), r["y"]))
    y = np.array([r["y"] for r in rows], float)
    parts = [np.frombuffer(r["m"], "<f4").reshape(-1, MEASURES).astype(float) for r in rows]
    measures = np.concatenate(parts) if parts else np.zeros((0, MEASURES))
    size = np.concatenate([np.frombuffer(r["s"], np.int64) for r in rows]) if rows else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(rows)), [len(p) for p in parts]) if rows else np.zeros(0, np.int64)
    cuts = np.quantile(measures, np.arange(1, BINS) / BINS, axis=0).T if len(measures) else np.zeros((MEASURES, BINS - 1))
    # Rare extremes tell most: the outer cuts lie further out than quantiles of equal steps would.
    if len(measures):
        cuts[:, 0], cuts[:, -1] = np.quantile(measures, 0.02, axis=0), np.quantile(measures, 0.97, axis=0)
        cuts = np.sort(cuts, 1)
    field = LineField(cuts)
    field.share = (y.sum() + 0.5) / (len(y) + 1)
    field.final = np.array([np.log(field.share / (1 - field.share)), 0, 0])
    if not len(doc) or y.min() == y.max():
        return field
    active, good = field.active(measures, doc), y[doc].copy()
    for turn in range(FITS):
        field.fit(active, doc, good)
        p, _ = field.marginals(active, doc)
        if turn + 1 < FITS:
            good = np.where(y[doc] == 0, (p >= 0.5).astype(float), 1.0)
            for d in np.flatnonzero((y == 0) & (np.bincount(doc, minlength=len(y)) > 0)):
                inside = slice(*np.searchsorted(doc, [d, d + 1]))
                if good[inside].all():
                    good[inside][np.argmin(p[inside])] = 0.0
    bad = field.badness(measures, doc, size, len(y))
    has = ~np.isnan(bad)
    field.final = logistic(np.stack((np.ones(has.sum()), np.log(bad[has] + 1e-3), bad[has]), 1), y[has], 0.1)
    return field


def label_lines(docs: DataFrame, field: LineField, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, line (from 0, blank lines not counted) and p_good of every line."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for batch in slabs(batches, "t", SLAB_BYTES // 8):
            measures, doc, _ = lines_of(texts(batch, "t"))
            p, _ = field.marginals(field.active(measures, doc), doc)
            at = offsets_of(np.bincount(doc, minlength=batch.num_rows))
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(doc)), pa.array(np.arange(len(doc)) - at[doc]), pa.array(p)], names=["key", "line", "p_good"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("t"))
    return map_arrow(rows, run, f"key {rows.schema['key'].dataType.simpleString()}, line bigint, p_good double").withColumnRenamed("key", key)


def classify(docs: DataFrame, labelled: DataFrame, label: str = "quality", threshold: float = 0.3, text: str = "text", key: str = "doc_id", digests: bool = False) -> DataFrame:
    """One row per document: key, score (0 to 1, higher: more likely good), predicted (score >= threshold).

    `labelled` has key and label of the documents that may be learnt from; labels other than 0 and 1 are
    ignored. Null, empty and blank texts score the share of good labels; without both labels all do. Null keys and
    repeated rows each give a row; other columns are ignored. With `digests` each row also has the digest of its
    text, so that rows of one key can be told apart.
    """
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    known = sampled(labelled.where(F.col(label).isin(0, 1)).select(F.col(key).alias("key"), F.col(label).cast("int").alias("y")), MAX_LABELLED)
    shared = docs.sparkSession.sparkContext.broadcast(train(rows.join(F.broadcast(known), "key")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for batch in slabs(batches, "t", SLAB_BYTES // 8):
            measures, doc, size = lines_of(texts(batch, "t"))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(field.score(field.badness(measures, doc, size, batch.num_rows)))], names=["key", "score"])

    scored = rows.select(F.struct("key", digest("t").alias("digest")).alias("key"), "t") if digests else rows
    out = map_arrow(scored, run, f"key {scored.schema['key'].dataType.simpleString()}, score double")
    out = out.select("key.*", "score") if digests else out
    return out.select(F.col("key").alias(key), *["digest"] * digests, "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
