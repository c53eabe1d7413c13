"""Line deduplication by a log-template tree of fixed depth.

Fields that vary by their shape (numbers, addresses, hex strings) count as one token. A line goes to a leaf by its
number of tokens and its leading tokens, and in a twin tree by its trailing ones; how many is fixed for each number
of tokens. In a leaf that several kinds of lines share, every short run of tokens beyond the path is tried as a
variable field: kinds that are alike but for that run have one template. Whether two kinds share a template depends
on them alone, so more documents never part what fewer have joined. Lines whose template recurs across documents
are dropped from all of these but the first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievecraft.llm.common import SLAB_BYTES, discard, fresh_name, join_hot, list_parts, map_arrow, materialise, offsets_of, release, slabs, texts
from sievecraft.llm.lm import mix

#: Share of a line's tokens that leads to a leaf, least share of constant tokens, longest variable run.
#: A run of 1 - CONSTANT of the tokens cannot touch both the leading and the trailing DEPTH of them.
DEPTH, CONSTANT, RUN = 0.35, 0.7, 2
#: Least tokens of a line that counts; one of them at least is no field.
LEAST_TOKENS = 1
#: Fields that vary by their shape; all have a digit or an @.
FIELDS = re.compile(r"[\w.+-]+@[\w-]+(\.[\w-]+)+|(?<![0-9a-z])(?=[a-f]*[0-9])[0-9a-f]{8,}(?![0-9a-z])|[0-9][0-9.,:/-]*", re.ASCII)
FIELD = "<*>"


def depth_of(tokens: np.ndarray) -> np.ndarray:
    return np.floor(DEPTH * tokens + 1e-9).astype(np.int64)


class Lines:
    """Tokens of lines as arrays: `size` of each line, `fixed` tokens among them, and running sums of two hash lanes of
    the tokens at their places."""

    def __init__(self, lines: pa.Array):
        tokens, counts = list_parts(pc.ascii_split_whitespace(pc.utf8_lower(lines)))
        coded = tokens.dictionary_encode()
        names = coded.dictionary
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(counts)), counts)
        blank = pc.index(names, "").as_py()
        if blank >= 0:  # white space at an end of a line leaves an empty part
            full = codes != blank
            codes, row = codes[full], row[full]
        self.size = np.bincount(row, minlength=len(counts)).astype(np.int64)
        self.at = offsets_of(self.size)
        masked = names.to_numpy(zero_copy_only=False).copy()
        marked = np.flatnonzero(pc.match_substring_regex(names, "[0-9@]").to_numpy(zero_copy_only=False)) if len(names) else []
        masked[marked] = [FIELDS.sub(FIELD, w) for w in masked[marked]]
        word = pd.util.hash_array(masked, categorize=False).astype(np.uint64) if len(masked) else np.zeros(0, np.uint64)
        place = (np.arange(len(codes)) - self.at[row]).astype(np.uint64)
        lane = mix(word[codes] + mix(place + np.uint64(1)))
        self.sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(x))) for x in (lane, mix(lane + np.uint64(7)))]
        self.fixed_sum = offsets_of((masked != FIELD)[codes]) if len(codes) else np.zeros(1, np.int64)
        self.fixed = self.fixed_sum[self.at[1:]] - self.fixed_sum[self.at[:-1]]

    def run(self, a: np.ndarray, b: np.ndarray, lane: int = 0) -> np.ndarray:
        return self.sums[lane][b] - self.sums[lane][a]

    def digests(self, line: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
        """Two 64-bit halves that know a line's tokens but for those from a to b, and where those are."""
        tag = mix((self.size[line] << 40 | a - self.at[line] << 8 | b - a).astype(np.uint64))
        return [mix(self.run(self.at[line], self.at[line + 1], k) - self.run(a, b, k) + tag).view(np.int64) for k in (0, 1)]

    def leaves(self) -> tuple[np.ndarray, np.ndarray]:
        """Leaf of each line by its leading tokens and by its trailing ones; 0 for lines too short for a variable run."""
        d, n = depth_of(self.size), self.size.astype(np.uint64)
        start, end = self.at[:-1], self.at[1:]
        lead, trail = mix(self.run(start, start + d) + mix(2 * n + np.uint64(1))), mix(self.run(end - d, end) + mix(2 * n))
        long = (1 - CONSTANT) * self.size + 1e-9 >= 1
        return np.where(long, lead, 0).astype(np.uint64), np.where(long, trail, 0).astype(np.uint64)


def line_rows(docs: DataFrame, least: int = LEAST_TOKENS) -> DataFrame:
    """Lines that count of documents (key, d, t): key, d, line (from 0), h1 and h2 (digest of the masked tokens), lead and trail."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slabs(batches, "t", SLAB_BYTES // 2):
            lines, counts = list_parts(pc.split_pattern(texts(batch, "t"), "\n"))
            doc, first = np.repeat(np.arange(len(counts)), counts), np.repeat(offsets_of(counts)[:-1], counts)
            found = Lines(lines)
            counted = np.flatnonzero((found.size >= least) & (found.fixed > 0))
            none = found.at[counted]
            h1, h2 = found.digests(counted, none, none)
            lead, trail = found.leaves()
            own = pa.array(doc[counted])
            columns = [batch.column("key").take(own), batch.column("d").take(own), pa.array((counted - first[counted]).astype(np.int32)), pa.array(h1), pa.array(h2), pa.array(lead[counted].view(np.int64)), pa.array(trail[counted].view(np.int64))]
            out = pa.RecordBatch.from_arrays(columns, names=["key", "d", "line", "h1", "h2", "lead", "trail"])
            for i in range(0, out.num_rows, 50_000):
                yield out.slice(i, 50_000)

    return map_arrow(docs.select("key", "d", "t"), run, f"key {docs.schema['key'].dataType.simpleString()}, d bigint, line int, h1 bigint, h2 bigint, lead bigint, trail bigint")


def template_rows(wanted: DataFrame) -> DataFrame:
    """h1, h2, low, high and the templates (digests) that each kind may have, one row for each length of their run. Rows are
    documents (t) with the kinds that are read from them (line, h1, h2, low, high, and whether kinds share the leaf of its leading and of its trailing tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slabs(batches, "t", SLAB_BYTES // 4):
            kinds, counts = list_parts(batch.column("wanted"))
            doc, line = np.repeat(np.arange(len(counts)), counts), pc.struct_field(kinds, "line").to_numpy(zero_copy_only=False)
            parts, in_doc = list_parts(pc.split_pattern(texts(batch, "t"), "\n"))
            found = Lines(parts.take(pa.array(offsets_of(in_doc)[doc] + line)))
            d, n = depth_of(found.size), found.size
            led, trailed = (pc.struct_field(kinds, k).to_numpy(zero_copy_only=False).astype(bool) for k in ("led", "trailed"))
            for width in range(1, RUN + 1):
                # Places where the run may begin: behind the leading tokens, or before the trailing ones, that others share.
                low = np.where(trailed, 0, d)
                high = np.where(led, n, n - d) - width
                room = np.where((width <= (1 - CONSTANT) * n + 1e-9) & (led | trailed), np.maximum(0, high - low + 1), 0)
                kind = np.repeat(np.arange(len(n)), room)
                begin = np.arange(len(kind)) - np.repeat(offsets_of(room)[:-1], room) + low[kind]
                a = found.at[kind] + begin
                left = found.fixed[kind] - (found.fixed_sum[a + width] - found.fixed_sum[a])
                good = left >= CONSTANT * n[kind] - 1e-9
                kind, a = kind[good], a[good]
                many = offsets_of(np.bincount(kind, minlength=len(n)))
                t1, t2 = found.digests(kind, a, a + width)
                lists = pa.ListArray.from_arrays(pa.array(many.astype(np.int32)), pa.StructArray.from_arrays([pa.array(t1), pa.array(t2)], names=["t1", "t2"]))
                yield pa.RecordBatch.from_arrays([*(pc.struct_field(kinds, k) for k in ("h1", "h2", "low", "high")), lists], names=["h1", "h2", "low", "high", "templates"])

    kind = wanted.schema["wanted"].dataType.elementType["low"].dataType.simpleString()
    return map_arrow(wanted.select("t", "wanted"), run, f"h1 bigint, h2 bigint, low {kind}, high {kind}, templates array<struct<t1:bigint,t2:bigint>>")


def recurring(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """h1, h2, first (smallest key that has one of its templates) and c (lines) of lines that recur across documents.

    `docs` has key, d and t; `lines` are their line_rows.
    """
    h, template = ["h1", "h2"], ["t1", "t2"]
    kinds = lines.groupBy(*h).agg(F.min("key").alias("low"), F.max("key").alias("high"), F.min(F.struct("key", "d", "line")).alias("at"), F.min("lead").alias("lead"), F.min("trail").alias("trail"), F.count(F.lit(1)).alias("c"))
    kinds = materialise(kinds, "kinds")
    paths = F.array(F.struct(F.col("lead").alias("leaf"), F.lit(1).alias("side")), F.struct(F.col("trail").alias("leaf"), F.lit(2).alias("side")))
    leaves = kinds.where("lead <> 0").select(*h, "low", "high", F.explode(paths).alias("x")).select(*h, "low", "high", "x.*")
    # A leaf that one document alone fills, or one kind, proposes nothing.
    shared = leaves.groupBy("leaf").agg(F.count(F.lit(1)).alias("c"), F.min("low").alias("first"), F.max("high").alias("last")).where("c > 1 AND first <> last")
    shared = materialise(shared.select("leaf", "c"), "leaves")
    release(docs.sparkSession)
    sides = join_hot(leaves.select(*h, "leaf", "side"), shared, "leaf").groupBy(*h).agg(F.bit_or("side").alias("sides"))
    wanted = kinds.join(sides, h).select(F.col("at.key").alias("key"), F.col("at.d").alias("d"), F.struct(F.col("at.line").alias("line"), *h, "low", "high", F.expr("(sides & 1) > 0").alias("led"), F.expr("(sides & 2) > 0").alias("trailed")).alias("kind"))
    wanted = wanted.groupBy("key", "d").agg(F.collect_list("kind").alias("wanted"))
    # The texts are neither sorted nor copied: a task holds the wanted kinds of its documents.
    rows = docs.join(wanted.hint("shuffle_hash"), ["key", "d"]).select("t", "wanted")
    listed = materialise(template_rows(rows).where(F.size("templates") > 0), "tried")
    release(docs.sparkSession)
    tried = listed.select(*h, "low", "high", F.inline("templates"))
    spread = tried.groupBy(*template).agg(F.min("low").alias("first"), F.max("high").alias("last"), F.count(F.lit(1)).alias("c")).where("first <> last")
    spread = materialise(spread.select(*template, "first", "c"), "templates")
    found = join_hot(tried.select(*h, *template), spread, template)
    found = found.select(*h, "first").unionByName(kinds.where("low <> high").select(*h, F.col("low").alias("first")))
    out = materialise(found.groupBy(*h).agg(F.min("first").alias("first")).join(kinds.select(*h, "c"), h), "recurring")
    discard(kinds, shared, listed, spread)
    release(docs.sparkSession)
    return out


def dedup_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", least: int = LEAST_TOKENS) -> DataFrame:
    """All columns of the documents, the text without recurring lines, and n_lines, n_recurring, n_dropped.

    A line is dropped where a document of a smaller key has a line of one of its templates; lines of the smallest key
    stay, wherever they stand there. Lines of fewer than `least` tokens, or of fields alone, never recur. Null text
    counts as empty; documents with a null key stay as they are. Rows of one key are one document to templates, but
    each row's lines are its own; repeated rows share their fate. Columns named like the new ones are replaced.
    """
    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), _digest(text).alias("d"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    lines = materialise(line_rows(rows, least), "lines")
    again = recurring(rows, lines)
    hits = join_hot(lines.select("key", "d", "line", "h1", "h2"), again, ["h1", "h2"])
    marks = hits.groupBy("key", "d").agg(F.collect_set(F.when(F.col("key") != F.col("first"), F.col("line"))).alias("gone"), F.count_distinct("line").alias("again"))
    rest = [c for c in docs.columns if c not in ("n_lines", "n_recurring", "n_dropped")]
    name = {c: fresh_name(c, docs) for c in ("key", "d", "gone", "again")}
    marks = marks.select(*[F.col(c).alias(new) for c, new in name.items()])
    out = docs.join(marks.hint("shuffle_hash"), (docs[key] == F.col(name["key"])) & (_digest(text) == F.col(name["d"])), "left")
    split = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    gone = F.coalesce(name["gone"], F.array().cast("array<int>"))
    left = F.array_join(F.filter(split, lambda x, i: ~F.array_contains(gone, i)), "\n")
    new = {text: F.when(F.size(gone) > 0, left).otherwise(F.coalesce(F.col(text), F.lit(""))), "n_lines": F.size(split).cast("long"), "n_recurring": F.coalesce(name["again"], F.lit(0)).cast("long"), "n_dropped": F.size(gone).cast("long")}
    return out.select(*[new[text].alias(text) if c == text else docs[c] for c in rest], *[new[c].alias(c) for c in ("n_lines", "n_recurring", "n_dropped")])


def _digest(text: str):
    """Tells the texts of one key apart."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))
