"""Language-model scores from a log-frequency Bloom filter.

Counts of words and word pairs are quantised on a logarithmic scale; an n-gram of level q is put into the
filter once for each level up to q, and a count is read back by probing level after level until one is missing.
The filter is a table of shards, cut by hash; each has the same number of bits for a level at every size of input,
so the filter grows with what it holds and its rate of false positives does not. It is never in one place: the
distinct n-grams of a slab of texts go to their shards, and the levels come back.

A text is scored in blocks of words by a mixture of two models: words alone (add one), and words given the one
before (Dirichlet-smoothed towards the first). The filter's false positives, whose rate its size sets, leave
the pair model slightly above one in sum.

Beside its bits a shard of words holds their exact counts (by 64-bit hash), which the add-one base model takes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievecraft.llm.common import SLAB_BYTES, list_parts, map_arrow, materialise, offsets_of, release, slabs, sums_by_row, texts

#: Base of the quantisation, probes of a level, bits for each stored level, levels (from 0 on).
BASE, PROBES, BITS, LEVELS = 1.5, 4, 16, 64
#: Least shards of words and of pairs; from there on they grow so that at most so many training tokens belong to one.
SHARDS, SHARD_TOKENS = 8, 1 << 21
#: Bits of a pair's hash that know it in its shard; words keep all 64. Two pairs of a shard are taken for one with
#: probability SHARD_TOKENS / 2 ** PAIR_BITS at most, a fraction of the filter's own rate of error.
PAIR_BITS = 32
#: Weight of the word model in a pair's probability, words of a block, prior share of the pair model.
PRIOR, BLOCK, PAIR_SHARE = 4.0, 64, 0.1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def hash_words(words: np.ndarray) -> np.ndarray:
    return mix(pd.util.hash_array(words, categorize=False).astype(np.uint64)) if len(words) else np.zeros(0, np.uint64)


def tokens_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct words, the end's being the last; code of each token; tokens of each text, its end last."""
    words, counts = list_parts(pc.ascii_split_whitespace(pc.ascii_lower(column)))
    coded = words.dictionary_encode()
    names = coded.dictionary.to_numpy(zero_copy_only=False)
    codes = coded.indices.to_numpy(zero_copy_only=False)
    blank = np.flatnonzero(names == "")
    if len(blank):  # white space at an end of a text leaves an empty part
        full = codes != blank[0]
        counts = np.bincount(np.repeat(np.arange(len(counts)), counts)[full], minlength=len(counts)).astype(np.int64)
        codes = codes[full]
        codes = codes - (codes > blank[0])
        names = np.delete(names, blank[0])
    lengths = counts + 1
    at = offsets_of(lengths)
    out = np.full(int(at[-1]), len(names), np.int32)
    mask = np.ones(len(out), bool)
    mask[at[1:] - 1] = False
    out[mask] = codes
    return hash_words(np.append(names, "")), out, lengths


def befores(codes: np.ndarray, lengths: np.ndarray, end: int) -> np.ndarray:
    """Code of the token before each one; at the first of a text the end's."""
    out = np.empty_like(codes)
    out[1:] = codes[:-1]
    out[offsets_of(lengths)[:-1]] = end
    return out


def pairs_of(hashes: np.ndarray, codes: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Hash of each token with the one before it."""
    return mix(mix(hashes + np.uint64(1))[before] + hashes[codes])


def level(counts: np.ndarray) -> np.ndarray:
    """Quantised counts: 1 for one, then logarithmic."""
    return np.minimum(1 + np.floor(np.log(counts) / math.log(BASE) + 1e-9).astype(np.int64), LEVELS - 1)


def level_values(most: int = LEVELS) -> np.ndarray:
    """Mean of the counts of each level; 0 for level 0."""
    out = [0.0]
    for q in range(1, most):
        a, b = math.ceil(BASE ** (q - 1) - 1e-9), math.ceil(BASE**q - 1e-9) - 1
        out.append((a + b) / 2 if b >= a else BASE ** (q - 0.5))
    return np.array(out)


class LogFrequencyFilter:
    """Bits of one shard, so many for each level that it holds. The top bits of an n-gram's hash name its shard, the
    bits after them know it there."""

    @staticmethod
    def positions(hashes: np.ndarray, q: int, size: int) -> Iterator[np.ndarray]:
        """Where each n-gram's probes of level q fall among `size` bits, probe after probe."""
        g = mix(hashes + np.uint64(q * 0x9E3779B97F4A7C15 % 2**64))
        step = (g << np.uint64(32)) | np.uint64(1)
        for _ in range(PROBES):
            yield ((g >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)
            g = g + step

    @classmethod
    def shard(cls, hashes: np.ndarray, counts: np.ndarray, bits_a_level: int = BITS) -> np.ndarray:
        levels = level(counts)
        bits = np.zeros(max(64, int(levels.sum()) * bits_a_level), bool)
        for q in range(1, int(levels.max(initial=0)) + 1):
            for at in cls.positions(hashes[levels >= q], q, len(bits)):
                bits[at] = True
        return np.packbits(bits)

    @classmethod
    def levels(cls, bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Level of each n-gram in a shard's bits, by probing from the first level to the last there is."""
        out = np.zeros(len(hashes), np.uint8)
        live = np.arange(len(hashes) if len(bits) else 0)
        for q in range(1, LEVELS):
            hit = np.ones(len(live), bool)
            for at in cls.positions(hashes[live], q, len(bits) * 8):
                hit &= (bits[at >> np.uint64(3)] << (at & np.uint64(7)).astype(np.uint8)) & 128 != 0
            live = live[hit]
            if not len(live):
                break
            out[live] = q
        return out


def shards_for(tokens: int) -> int:
    """Shards of words, and as many of pairs: a power of two, so that no shard grows with the input."""
    return max(SHARDS, 1 << max(0, (tokens - 1) // SHARD_TOKENS).bit_length())


def planes(values: np.ndarray) -> bytes:
    """Whole numbers byte plane by byte plane, only as many as they need, compressed."""
    wide = values.astype("<u8").view(np.uint8).reshape(-1, 8)
    used = (int(values.max(initial=0)).bit_length() + 7) // 8
    return bytes([used]) + pa.compress(wide[:, :used].T.tobytes(), "zstd", asbytes=True)


def unplanes(data: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    if n and data[0]:
        out[:, : data[0]] = np.frombuffer(pa.decompress(data[1:], n * data[0], "zstd"), np.uint8).reshape(data[0], n).T
    return out.view("<u8").ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending whole numbers by their differences."""
    return planes(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(unplanes(data, n), dtype=np.uint64)


def cut(hashes: np.ndarray, shards: int, first: int) -> Iterator[tuple[int, slice, np.ndarray]]:
    """Shard number (from `first` on), place and in-shard hash of the parts of sorted hashes. From shard `shards`
    on are pairs, of whose hash PAIR_BITS are kept."""
    top = shards.bit_length() - 1
    names, at = np.unique(hashes >> np.uint64(64 - top), return_index=True)
    inside = (hashes << np.uint64(top)) >> np.uint64(top if first == 0 else 64 - PAIR_BITS)
    for name, a, b in zip(names.tolist(), at.tolist(), [*at[1:].tolist(), len(hashes)], strict=True):
        yield first + name, slice(a, b), inside[a:b]


def by_shard(blocks: DataFrame, then: str, shards: int) -> DataFrame:
    """Every shard's rows in one task; there are as many tasks as shards of a kind, so none grows with the input."""
    return blocks.repartition(shards, "shard").sortWithinPartitions("shard", then)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def train_blocks(training: DataFrame, shards: int) -> DataFrame:
    """Rows (shard, n, hashes, counts): the distinct words and pairs of each slab of texts (column t) by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slabs(batches, "t", SLAB_BYTES // 2):
            hashes, codes, lengths = tokens_of(texts(batch, "t"))
            order = np.argsort(hashes)
            counts = np.bincount(codes, minlength=len(hashes))
            pairs = np.sort(pairs_of(hashes, codes, befores(codes, lengths, len(hashes) - 1)))
            first = np.flatnonzero(np.concatenate(([True], pairs[1:] != pairs[:-1])))
            for kind, found, many in ((0, hashes[order], counts[order]), (shards, pairs[first], np.diff(np.append(first, len(pairs))))):
                rows = [(s, len(low), pack_sorted(low), planes(many[place])) for s, place, low in cut(found, shards, kind)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["shard", "n", "hashes", "counts"])

    return map_arrow(training.select("t"), run, "shard int, n bigint, hashes binary, counts binary")


def build_filter(blocks: DataFrame, shards: int, bits_a_level: int) -> DataFrame:
    """Shards of the filter from train_blocks, counts summed: shard, tokens and distinct (of words, else 0), bits, and of
    words also n, hashes and counts. A worker holds one shard at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, parts in groupby(rows_of(batches), key=lambda row: row[0]):
            hashes, counts = zip(*((unpack_sorted(h, n), unplanes(c, n)) for _, n, h, c in parts), strict=True)
            h, c = np.concatenate(hashes), np.concatenate(counts)
            order = np.argsort(h)
            h, c = h[order], c[order]
            first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            h, c = h[first], np.add.reduceat(c, first)
            bits, word = LogFrequencyFilter.shard(h, c, bits_a_level).tobytes(), s < shards
            row = (s, int(c.sum()) if word else 0, len(h) if word else 0, bits, pack_sorted(h) if word else None, planes(c) if word else None)
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["shard", "tokens", "n", "bits", "hashes", "counts"])

    return map_arrow(by_shard(blocks, "n", shards), run, "shard int, tokens bigint, n bigint, bits binary, hashes binary, counts binary")


def slab_rows(docs: DataFrame) -> DataFrame:
    """Rows of documents (key, t), cut into slabs: one of each document (row, key), and one of each slab (row of its first
    document, m texts, w words, their lengths, hashes, ranks and codes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        for batch in slabs(batches, "t", SLAB_BYTES // 2):
            m = batch.num_rows
            hashes, codes, lengths = tokens_of(texts(batch, "t"))
            none = pa.nulls(m, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(row + np.arange(m)), batch.column("key"), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), none, none, none, none], names=SLAB)
            # The codes of frequent words are small, so their high planes compress.
            rank = np.empty(len(hashes), np.int64)
            rank[np.argsort(-np.bincount(codes, minlength=len(hashes)), kind="stable")] = np.arange(len(hashes))
            swap = np.argsort(hashes)
            packed = planes(lengths), pack_sorted(hashes[swap]), planes(rank[swap]), planes(rank[codes])
            yield pa.RecordBatch.from_arrays([pa.array([row]), pa.nulls(1, batch.column("key").type), pa.array([m]), pa.array([len(hashes)]), *(pa.array([x], pa.binary()) for x in packed)], names=SLAB)
            row += m

    kind = docs.schema["key"].dataType.simpleString()
    return map_arrow(docs.select("key", "t"), run, f"row bigint, key {kind}, m bigint, w bigint, lengths binary, hashes binary, ranks binary, codes binary")


SLAB = ["row", "key", "m", "w", "lengths", "hashes", "ranks", "codes"]


def unpack_slab(m: int, w: int, lengths: bytes, hashes: bytes, ranks: bytes, codes: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of each text, ascending hashes of the words, code (place there) of each token and of the one before it."""
    sizes = unplanes(lengths, m).astype(np.int64)
    place = np.empty(w, np.int32)
    place[unplanes(ranks, w).astype(np.int64)] = np.arange(w)
    at = place[unplanes(codes, int(sizes.sum())).astype(np.int64)]
    return sizes, unpack_sorted(hashes, w), at, befores(at, sizes, int(at[-1]))


def slab_queries(slabs_: DataFrame, shards: int) -> DataFrame:
    """Distinct words and pairs of each slab for the shards that hold them: (slab, shard, n, hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slab, *data in rows_of(batches):
            _, hashes, codes, before = unpack_slab(*data)
            for first, found in ((0, hashes), (shards, np.unique(pairs_of(hashes, codes, before)))):
                rows = [(slab, s, len(low), pack_sorted(low)) for s, _, low in cut(found, shards, first)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["slab", "shard", "n", "hashes"])

    return map_arrow(slabs_.select("row", "m", "w", "lengths", "hashes", "ranks", "codes"), run, "slab bigint, shard int, n bigint, hashes binary")


def probe_filter(filters: DataFrame, asked: DataFrame, shards: int) -> DataFrame:
    """Answers (slab, part, n, levels, counts) to slab_queries, each shard's beside its bits; counts of words only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bits = -1, np.zeros(0, np.uint8)
        own, count = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        for batch in batches:
            out = []
            for slab, shard, n, data, of_bits, of_counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard != held:
                    held, bits, own = shard, np.zeros(0, np.uint8), np.zeros(0, np.uint64)
                if slab < 0:
                    bits = np.frombuffer(of_bits, np.uint8)
                    if shard < shards:
                        own, count = unpack_sorted(data, n), unplanes(of_counts, n)
                    continue
                some, exact = unpack_sorted(data, n), None
                if shard < shards:
                    at = np.minimum(np.searchsorted(own, some), max(0, len(own) - 1))
                    exact = planes(np.where(own[at] == some, count[at], 0) if len(own) else np.zeros(n, np.int64))
                out.append((slab, shard, n, planes(LogFrequencyFilter.levels(bits, some)), exact))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["slab", "part", "n", "levels", "counts"])

    # A shard's bits come first, as their slab is -1.
    none = F.lit(None).cast("binary")
    both = filters.select(F.lit(-1).cast("long").alias("slab"), "shard", "n", "hashes", "bits", "counts").unionByName(asked.select("slab", "shard", "n", "hashes", none.alias("bits"), none.alias("counts")))
    return map_arrow(by_shard(both, "slab", shards), run, "slab bigint, part int, n bigint, levels binary, counts binary")


def block_scores(p1: np.ndarray, p2: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """log10 probability of each text from the logarithms of its tokens' probabilities under both models."""
    blocks = (lengths + BLOCK - 1) // BLOCK
    last = offsets_of(blocks)
    sizes = np.full(int(last[-1]), BLOCK, np.int64)
    sizes[last[1:] - 1] = lengths - (blocks - 1) * BLOCK
    s1, s2 = sums_by_row(p1, sizes), sums_by_row(p2, sizes)
    return sums_by_row(np.logaddexp(s1 + math.log(1 - PAIR_SHARE), s2 + math.log(PAIR_SHARE)), blocks) / math.log(10)


def model_scores(slabs_: DataFrame, answers: DataFrame, shards: int, n: int, v: int) -> DataFrame:
    """row, n_tokens, n_known, base_score and score of each document, from slabs and what the shards answered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, unit = level_values(), math.log10(n + v + 1)
        for slab, parts in groupby(rows_of(batches), key=lambda row: row[0]):
            _, _, m, w, *packed, _, _ = next(parts)
            lengths, hashes, codes, before = unpack_slab(m, w, *packed)
            # Answers come in the order of the hashes, those of words first.
            found = [(size, levels, counts) for _, _, size, _, _, _, _, _, levels, counts in parts]
            exact = np.concatenate([unplanes(c, size) for size, _, c in found if c is not None]).astype(np.int64)
            levels = np.concatenate([unplanes(x, size) for size, x, _ in found]).astype(np.int64)
            c1 = values[levels[:w]]
            l1 = np.log((c1 + 1) / (n + v + 1))[codes]
            distinct, which = np.unique(pairs_of(hashes, codes, before), return_inverse=True)
            if len(exact) != w or len(levels) != w + len(distinct):
                raise AssertionError((len(exact), w, len(levels), len(distinct)))
            c2 = values[levels[w:]][which]
            del which, distinct, levels
            of_before = c1[before]
            np.minimum(c2, of_before, out=c2)
            l2 = np.log((c2 + PRIOR * np.exp(l1)) / (of_before + PRIOR))
            del c2, of_before, before
            base = sums_by_row(np.log10(exact + 1.0)[codes], lengths) - lengths * unit
            known = sums_by_row((exact > 0).astype(np.int64)[codes], lengths)
            yield pa.RecordBatch.from_arrays([pa.array(slab + np.arange(m)), pa.array(lengths), pa.array(known), pa.array(base), pa.array(block_scores(l1, l2, lengths))], names=["row", "n_tokens", "n_known", "base_score", "score"])

    none = F.lit(None).cast("binary")
    own = slabs_.select(F.col("row").alias("slab"), F.lit(-1).alias("part"), "m", "w", "lengths", "hashes", "ranks", "codes", none.alias("levels"), none.alias("counts"))
    rest = answers.select("slab", "part", F.col("n").alias("m"), F.lit(0).cast("long").alias("w"), none.alias("lengths"), none.alias("hashes"), none.alias("ranks"), none.alias("codes"), "levels", "counts")
    rows = own.unionByName(rest).repartition(shards, "slab").sortWithinPartitions("slab", "part")
    return map_arrow(rows, run, "row bigint, n_tokens bigint, n_known bigint, base_score double, score double")


def score(docs: DataFrame, training: DataFrame, text: str = "text", key: str = "doc_id", bits_a_level: int = BITS) -> DataFrame:
    """One row per document: key, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities).

    Learns from the texts of `training`. Words are lower-cased (A-Z) and stand between ASCII blanks; an end
    follows each text, so null and empty texts have one token. Null keys and repeated rows each give a row.
    Without training texts every word is unknown. Other columns are ignored. More bits a level make fewer of the
    filter's levels too high.
    """
    spark = docs.sparkSession
    train = training.select(F.coalesce(F.col(text), F.lit("")).alias("t"))
    # An upper estimate of the tokens: four bytes each, and the ends.
    shards = shards_for(train.agg(F.sum(F.octet_length("t") / 4 + 1).cast("long").alias("n")).first()["n"] or 0)
    filters = materialise(build_filter(train_blocks(train, shards), shards, bits_a_level), "filter")
    release(spark)
    sizes = filters.agg(F.sum("tokens").alias("n"), F.sum("n").alias("v")).first()
    n, v = sizes["n"] or 0, sizes["v"] or 0
    rows = materialise(slab_rows(docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("t"))), "slabs")
    own = rows.where("m IS NOT NULL")
    answers = materialise(probe_filter(filters, slab_queries(own, shards), shards), "answers")
    release(spark)
    out = rows.where("m IS NULL").select("row", "key").join(model_scores(own, answers, shards, n, v), "row")
    return out.select(F.col("key").alias(key), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
