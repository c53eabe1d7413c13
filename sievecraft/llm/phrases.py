"""Phrase collocation mining by Rabin-Karp fingerprints.

Texts are cut into slabs, written once. A slab's n-grams are hashed from prefix polynomials, over its bytes for the
words and over the words' hashes for the phrases, and its distinct fingerprints go with their counts and a pointer to
the slab to the shards of the hash. A shard adds them up and sends those that are frequent back along the pointers. So
each slab reads from its text only the phrases that may be frequent; there they are told apart by their words, and what
is counted at the end are texts, of each task first. A collision therefore costs a text too many on the way and never a wrong count.

Shards grow in number with the input and keep as many bits of a fingerprint each, so that the share of collisions stays.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievecraft.llm.common import join_hot, map_arrow, materialise, offsets_of, release, slabs, texts
from sievecraft.llm.lm import by_shard, mix, pack_sorted, planes, rows_of, unpack_sorted, unplanes

#: Words of a phrase at most, occurrences at least, phrases of a language in the report.
LONGEST, LEAST, TOP = 5, 100, 2000
#: Text bytes of a slab, n-grams of a shard about, least shards, bits of a fingerprint in its shard.
SLAB, SHARD_GRAMS, SHARDS, BITS = 2 << 20, 1 << 23, 8, 32
#: Text bytes of a task that reads phrases about, and phrases it holds before it hands some on.
TASK, HELD = 48 << 20, 1 << 20
#: Ends of a piece, and blanks between its words.
ENDS, BLANKS = b".,;:!?\x0a\x0b\x0c\x0d", b" \t"
#: Base of the polynomials (odd, so that it has an inverse), and what a byte adds.
RADIX = 0x9E3779B97F4A7C15
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_KIND = np.zeros(256, np.uint8)  # 0: of a word, 1: blank, 2: end of a piece
_KIND[list(BLANKS)], _KIND[list(ENDS)] = 1, 2


class Powers:
    """Powers of the radix and of its inverse modulo 2^64, made as far as they are asked for."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            step = np.full(max(n, 1 << 16), RADIX, np.uint64)
            step[0] = 1
            self.up = np.cumprod(step, dtype=np.uint64)
            step[1:] = pow(RADIX, -1, 1 << 64)
            self.down = np.cumprod(step, dtype=np.uint64)
        return self.up[:n], self.down[:n]


def polynomial_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers) -> np.ndarray:
    """Hash of values[start:end] for each start and end, from one prefix sum of values times powers."""
    up, down = powers.upto(len(values) + 1)
    prefix = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=prefix[1:])
    lengths = (ends - starts).astype(np.uint64)
    return mix((prefix[ends] - prefix[starts]) * down[starts] + lengths * np.uint64(0xC2B2AE3D27D4EB4F))


class Slab:
    """Words of some texts: where they stand, their hashes (with the language's), and which pieces they belong to."""

    def __init__(self, data: np.ndarray, sizes: np.ndarray, langs: list[str], powers: Powers):
        self.data, self.langs, self.powers = data, langs, powers
        kinds = _KIND[data]
        at = offsets_of(sizes)
        edge = np.zeros(len(data) + 1, bool)
        edge[at] = True
        word = np.concatenate(([False], kinds == 0, [False]))
        self.starts = np.flatnonzero(word[1:-1] & (~word[:-2] | edge[:-1]))
        self.ends = np.flatnonzero(word[1:-1] & (~word[2:] | edge[1:])) + 1
        breaks = np.cumsum((kinds == 2) | edge[:-1], dtype=np.int64)
        self.piece = breaks[self.starts]
        self.lang = np.zeros(len(self.starts), np.int64)
        if len(self.starts):
            codes, self.langs = pd.factorize(np.array(langs, object))
            self.lang = codes[np.searchsorted(at[:-1], self.starts, "right") - 1]
            own = mix(pd.util.hash_array(np.array(self.langs, object), categorize=False).astype(np.uint64))
            self.words = mix(polynomial_hashes(_BYTES[data], self.starts, self.ends, powers) ^ own[self.lang])
        else:
            self.words = np.zeros(0, np.uint64)

    def grams(self, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """n, first word and hash of each phrase of n words of one piece."""
        m = len(self.words)
        for n in range(1, longest + 1):
            first = np.flatnonzero(self.piece[n - 1 :] == self.piece[: m - n + 1]) if m >= n else np.zeros(0, np.int64)
            yield n, first, polynomial_hashes(self.words, first, first + n, self.powers)

    def ids(self) -> tuple[np.ndarray, np.ndarray]:
        """An exact number for each word, and a place where the word of each number stands."""
        _, rep, ids = np.unique(self.words, return_index=True, return_inverse=True)
        sizes = self.ends - self.starts
        first = rep[ids]
        same = (sizes == sizes[first]) & (self.lang == self.lang[first])
        same = bool(same.all()) and np.array_equal(self._bytes(self.starts, sizes), self._bytes(self.starts[first], sizes))
        if not same:  # words that share a hash: told apart by their bytes
            known: dict[tuple[int, bytes], int] = {}
            ids = np.array([known.setdefault((lang, self.data[a:b].tobytes()), len(known)) for lang, a, b in zip(self.lang.tolist(), self.starts.tolist(), self.ends.tolist(), strict=True)])
            _, rep = np.unique(ids, return_index=True)
        return ids, rep

    def _bytes(self, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        at = offsets_of(sizes)
        return self.data[np.arange(at[-1]) + np.repeat(starts - at[:-1], sizes)]


def lowered(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a batch's texts (column t), A-Z in small letters, and the number of each text's bytes."""
    column = texts(batch, "t")
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    return _LOWER[data], np.diff(at)


def slab_table(docs: DataFrame) -> DataFrame:
    """slab, data (compressed), n_bytes, sizes, langs of rows (t, lang): a row for each slab of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        slab = TaskContext.get().partitionId() << 32
        for batch in slabs(batches, "t", SLAB):
            data, sizes = lowered(batch)
            row = slab, pa.compress(data.tobytes(), "zstd", asbytes=True), len(data), planes(sizes), batch.column("lang").to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.list_(pa.string())), strict=True)], names=["slab", "data", "n_bytes", "sizes", "langs"])
            slab += 1

    return map_arrow(docs.select("t", "lang"), run, "slab bigint, data binary, n_bytes bigint, sizes binary, langs array<string>")


def opened(data: bytes, n_bytes: int, sizes: bytes, langs: list[str], powers: Powers) -> Slab:
    raw = np.frombuffer(pa.decompress(data, n_bytes, "zstd"), np.uint8) if n_bytes else np.zeros(0, np.uint8)
    return Slab(raw, unplanes(sizes, len(langs)).astype(np.int64), langs, powers)


def shards_for(words: int, longest: int = LONGEST) -> int:
    """A power of two, so that no shard grows with the input."""
    return max(SHARDS, 1 << max(0, (words * longest - 1) // SHARD_GRAMS).bit_length())


def fingerprints(slabs_: DataFrame, shards: int, longest: int, bits: int) -> DataFrame:
    """Rows (slab, shard, n, hashes, counts): the distinct fingerprints of each slab by shard, with how often it has them."""
    top = shards.bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for slab, *rest in rows_of(batches):
            found = np.concatenate([h >> np.uint64(64 - top - bits) for _, _, h in opened(*rest, powers).grams(longest)])
            if not len(found):
                continue
            found.sort()
            first = np.flatnonzero(np.concatenate(([True], found[1:] != found[:-1])))
            distinct, counts = found[first], np.diff(np.append(first, len(found)))
            names, at = np.unique(distinct >> np.uint64(bits), return_index=True)
            inside = distinct & np.uint64((1 << bits) - 1)
            rows = [(slab, s, b - a, pack_sorted(inside[a:b]), planes(counts[a:b])) for s, a, b in zip(names.tolist(), at.tolist(), [*at[1:].tolist(), len(distinct)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["slab", "shard", "n", "hashes", "counts"])

    return map_arrow(slabs_, run, "slab bigint, shard int, n bigint, hashes binary, counts binary")


def frequent(blocks: DataFrame, shards: int, least: int) -> DataFrame:
    """Answers (slab, shard, n, hashes) to fingerprints: those of each slab that all slabs together have `least` times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, parts in groupby(rows_of(batches), key=lambda row: row[1]):
            slabs_, hashes, counts = zip(*((slab, unpack_sorted(h, n).astype(np.uint32), unplanes(c, n).astype(np.uint32)) for slab, _, n, h, c in parts), strict=True)
            both = np.concatenate(hashes).astype(np.uint64) << np.uint64(32)
            both |= np.concatenate(counts)
            both.sort()
            keys = both >> np.uint64(32)
            first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            often = keys[first][np.add.reduceat(both & np.uint64(0xFFFFFFFF), first) >= least].astype(np.uint32)
            del both, keys, first
            rows = []
            for slab, own in zip(slabs_, hashes, strict=True):
                at = np.minimum(np.searchsorted(own, often), len(own) - 1)
                some = often[own[at] == often].astype(np.uint64)
                if len(some):
                    rows.append((slab, shard, len(some), pack_sorted(some)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["slab", "shard", "n", "hashes"])

    return map_arrow(by_shard(blocks, "slab", shards), run, "slab bigint, shard int, n bigint, hashes binary")


PHRASE = pa.schema([("h", pa.uint64()), ("lang", pa.string()), ("words", pa.int32()), ("phrase", pa.string()), ("a", pa.int64())])


def summed(tables: list[pa.Table]) -> pa.Table:
    """Counts of equal phrases together: texts are compared, not hashes."""
    out = pa.concat_tables(tables).group_by(["h", "lang", "words", "phrase"]).aggregate([("a", "sum")])
    return out.rename_columns([c.removesuffix("_sum") for c in out.column_names]).select(PHRASE.names)


def named(slab: Slab, wanted: np.ndarray, longest: int, shift: int) -> pa.Table:
    """The slab's phrases whose fingerprints are among the wanted ones, with their counts, and the number of its words."""
    counts = np.bincount(slab.lang, minlength=len(slab.langs))
    parts = [pa.table([pa.array(np.zeros(len(counts), np.uint64)), pa.array(slab.langs, pa.string()), pa.array(np.zeros(len(counts), np.int32)), pa.nulls(len(counts), pa.string()), pa.array(counts)], schema=PHRASE)]
    if not len(wanted):
        return parts[0]
    ids, rep = slab.ids()
    sizes = (slab.ends - slab.starts)[rep]
    words = pa.StringArray.from_buffers(len(rep), pa.py_buffer(offsets_of(sizes).astype(np.int32)), pa.py_buffer(slab._bytes(slab.starts[rep], sizes)))
    langs = pa.array(slab.langs, pa.string())
    # A small table of bits tells most of the others before the search.
    sieve = np.zeros(1 << 20, bool)
    sieve[wanted & np.uint64((1 << 20) - 1)] = True
    for n, first, hashes in slab.grams(longest):
        keys = hashes >> np.uint64(shift)
        maybe = np.flatnonzero(sieve[keys & np.uint64((1 << 20) - 1)])
        at = np.minimum(np.searchsorted(wanted, keys[maybe]), len(wanted) - 1)
        hit = maybe[wanted[at] == keys[maybe]]
        first, own = first[hit], hashes[hit]
        _, begin, which, many = np.unique(own, return_index=True, return_inverse=True, return_counts=True)
        if not all(np.array_equal(ids[first + j], ids[first[begin][which] + j]) for j in range(n)):  # phrases that share a fingerprint
            _, begin, many = np.unique(np.stack([ids[first + j] for j in range(n)]), axis=1, return_index=True, return_counts=True)
        at = first[begin]
        text = pc.binary_join_element_wise(*[words.take(pa.array(ids[at + j])) for j in range(n)], " ")
        parts.append(pa.table([pa.array(own[begin]), langs.take(pa.array(slab.lang[at])), pa.array(np.full(len(at), n, np.int32)), text, pa.array(many)], schema=PHRASE))
    return pa.concat_tables(parts)


def read_phrases(slabs_: DataFrame, answers: DataFrame, shards: int, tasks: int, longest: int, bits: int) -> DataFrame:
    """Blocks (shard, data) of phrases and their counts, each task's summed over its slabs: the phrases that the answers name,
    read from the text."""
    top = shards.bit_length() - 1

    def blocks(found: pa.Table) -> pa.RecordBatch:
        found = found.sort_by([("h", "ascending")])
        of = found["h"].to_numpy() >> np.uint64(64 - top)
        names, at = np.unique(of, return_index=True)
        rows = []
        for s, a, b in zip(names.tolist(), at.tolist(), [*at[1:].tolist(), len(of)], strict=True):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, PHRASE, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(found.slice(a, b - a).sort_by([("phrase", "ascending")]))  # neighbours are alike, so they compress
            rows.append((s, sink.getvalue().to_pybytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary()), strict=True)], names=["shard", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, held, size = Powers(), [], 0
        for _, parts in groupby(rows_of(batches), key=lambda row: row[0]):
            _, _, data, n_bytes, sizes, langs, _, _ = next(parts)
            wanted = [unpack_sorted(hashes, n) | np.uint64(shard << bits) for _, shard, *_, n, hashes in parts]
            held.append(named(opened(data, n_bytes, sizes, langs, powers), np.concatenate(wanted) if wanted else np.zeros(0, np.uint64), longest, 64 - top - bits))
            size += held[-1].num_rows
            if size > HELD:
                held = [summed(held)]
                if held[0].num_rows > HELD // 2:
                    yield blocks(held.pop())
                size = sum(t.num_rows for t in held)
        if held:
            yield blocks(summed(held))

    none = F.lit(None)
    own = slabs_.select("slab", F.lit(-1).alias("shard"), "data", "n_bytes", "sizes", "langs", none.cast("bigint").alias("n"), none.cast("binary").alias("hashes"))
    rest = answers.select("slab", "shard", none.cast("binary").alias("data"), none.cast("bigint").alias("n_bytes"), none.cast("binary").alias("sizes"), none.cast("array<string>").alias("langs"), "n", "hashes")
    # Shards come in order after the slab itself, so that their fingerprints are in order together.
    rows = own.unionByName(rest).repartition(tasks, "slab").sortWithinPartitions("slab", "shard")
    return map_arrow(rows, run, "shard int, data binary")


def merged(blocks: DataFrame, shards: int, least: int) -> DataFrame:
    """lang, words, phrase, a of all blocks together; rare ones, that a shared fingerprint has brought, are gone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts in groupby(rows_of(batches), key=lambda row: row[0]):
            found = summed([pa.ipc.open_stream(data).read_all() for _, data in parts])
            yield from found.filter((pc.field("words") == 0) | (pc.field("a") >= least)).drop_columns(["h"]).combine_chunks().to_batches()

    return map_arrow(blocks.repartition(shards, "shard").sortWithinPartitions("shard"), run, "lang string, words int, phrase string, a bigint")


def phrase_counts(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = LEAST, bits: int = BITS) -> DataFrame:
    """lang, words, phrase, a of every phrase of up to `longest` words that stands `least` times in its language, a written
    table; and the number of all words of each language (words 0, no phrase). Fewer bits make more fingerprints collide."""
    rows = docs.select(F.coalesce(F.col(text), F.lit("")).alias("t"), F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"))
    kept = materialise(slab_table(rows), "slabs")
    size = kept.agg(F.sum("n_bytes")).first()[0] or 0
    shards = shards_for(size // 4 + 1, longest)  # an upper estimate of the words: four bytes each
    answers = materialise(frequent(fingerprints(kept, shards, longest, bits), shards, least), "answers")
    release(docs.sparkSession)
    out = materialise(merged(read_phrases(kept, answers, shards, max(SHARDS, size // TASK), longest, bits), shards, least), "phrases")
    release(docs.sparkSession)
    return out


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = LEAST, top: int = TOP, bits: int = BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the `top` phrases of each language by score.

    Texts are lower-cased (A-Z) and cut at stops and line ends into pieces, these at blanks and tabs into words. score is
    floor(1000 a n / (l r)) at the cut of a phrase that has the lowest (ties: after the fewest words); phrases inside a
    longer one that is as frequent are left out. Null texts count as empty, a null language as `und`; repeated rows count
    each; ties go by a, then by the phrase's bytes. Empty tables give no rows; other columns are ignored.
    """
    counts = phrase_counts(docs, text, lang, longest, least, bits)
    known = counts.where("words > 0").select("lang", "phrase", "a")
    phrases = counts.where("words > 1")
    word = F.split("phrase", " ")
    longer = phrases.where("words > 2").select("lang", "words", "a", word.alias("w"))
    ends = F.array(F.array_join(F.slice("w", F.lit(1), F.col("words") - 1), " "), F.array_join(F.slice("w", F.lit(2), F.col("words") - 1), " "))
    # What is inside a longer phrase and as frequent is inside one that is longer by a word and as frequent, too.
    longer = longer.select("lang", F.explode(ends).alias("phrase"), F.col("a").alias("of")).groupBy("lang", "phrase").agg(F.max("of").alias("of"))
    left_out = phrases.select("lang", "phrase", "a").join(longer, ["lang", "phrase"]).where("of >= a").select("lang", "phrase")
    cuts = phrases.join(left_out, ["lang", "phrase"], "left_anti").select("lang", "phrase", "words", "a", word.alias("w"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("front"), F.array_join(F.slice("w", F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("back"))
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("front"), F.col("a").alias("l")), ["lang", "front"])
    cuts = materialise(cuts.join(known.select("lang", F.col("phrase").alias("back"), F.col("a").alias("r")), ["lang", "back"]).select("lang", "phrase", "a", "k", "l", "r"), "cuts")
    totals = counts.where("words = 0").select("lang", F.col("a").alias("n")).join(cuts.groupBy("lang").agg(F.count(F.lit(1)).alias("c")), "lang")
    cuts = join_hot(cuts, materialise(totals, "totals"), "lang")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.withColumn("top", F.lit(1000).cast("decimal(4,0)") * wide("a") * wide("n")).withColumn("under", wide("l") * wide("r"))
    cuts = cuts.withColumn("score", F.expr("CAST(`top` div `under` AS BIGINT)"))
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("b")).select("lang", "phrase", "b.*")
    by = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    out = best.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
