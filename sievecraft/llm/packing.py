"""Hierarchical packing of documents into context windows of several lengths.

Every partition is packed by itself. A document's whole long windows are cut off first; what is left is routed to the
tier (a power of two) that just holds it. Tiers are packed from the longest one on: a window begins with the longest
piece of its own tier, its gap is filled with the longest pieces of this and shorter tiers that fit, and at last by
cutting one. Tiers that lack tokens for a window wait for the next texts; what waits at the end of a partition forms
windows of ever shorter powers of two, so none is padded. Windows of a tier, numbered over all partitions, are dealt
to step groups of equally many tokens.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievecraft.llm.common import SLAB_BYTES, list_parts, map_arrow, materialise, offsets_of, ragged_take, slabs, sums_by_row, texts

#: Longest and shortest tier, and the tokens of a step group.
WINDOW, SHORTEST = 4096, 256
STEP_TOKENS = 64 * WINDOW
#: Parts of words whose ids a worker remembers.
PARTS = 500_000
#: Words that stay whole: contractions, special tokens, and characters that composition may join.
_WHOLE = r"'|<\||[\x{130}]|[^\x00-\x{24f}]"


class WordEncoder:
    """Ids of texts by the tokenizers library, each distinct part of a word encoded once.

    The vocabulary drops white space, and its pre-tokenizer parts letters from other characters, so runs of
    letters and the runs between them encode alike wherever they stand. Words of `_WHOLE` are not parted.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.lengths = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _encode(self, names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct parts and their numbers: whole words each by itself, all others as one text."""
        whole = pc.match_substring_regex(names, _WHOLE).to_numpy(zero_copy_only=False)
        lengths = np.zeros(len(names), np.int64)
        found = self.tokenizer.encode_batch_fast(names.filter(pa.array(whole)).to_pylist(), add_special_tokens=False)
        lengths[whole] = [len(e.ids) for e in found]
        alone = np.array([x for e in found for x in e.ids], np.int64)
        rest = names.filter(pa.array(~whole))
        # The pre-tokenizer's words in each part; a text of parts numbers its words in their order.
        words = pc.count_substring_regex(rest, r"\pL+|\pN|[^\s\pL\pN]+").to_numpy(zero_copy_only=False).astype(np.int64)
        ids, sizes = [], []
        for i in range(0, len(rest), 10_000):
            found = self.tokenizer.encode(" ".join(rest[i : i + 10_000].to_pylist()), add_special_tokens=False)
            ids.append(np.array(found.ids, np.int64))
            per_word = np.bincount(np.array(found.word_ids, np.int64), minlength=int(words[i : i + 10_000].sum()))
            sizes.append(sums_by_row(per_word, words[i : i + 10_000]))
        lengths[~whole] = np.concatenate(sizes) if sizes else 0
        out = np.empty(int(lengths.sum()), np.int64)
        in_whole = np.repeat(whole, lengths)
        out[in_whole], out[~in_whole] = alone, np.concatenate(ids) if ids else 0
        return out, lengths

    def _parts(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Values and offsets of all known parts, and which of them the given ones are."""
        names = parts.to_pylist()
        at = [self.known.get(w, -1) for w in names]
        new = np.array(at, np.int64) < 0
        if new.any():
            if len(self.known) + int(new.sum()) > PARTS:
                self._forget()
                new[:] = True
            ids, lengths = self._encode(parts.filter(pa.array(new)))
            self.ids, self.lengths = np.concatenate((self.ids, ids)), np.concatenate((self.lengths, lengths))
            self.known.update(zip((names[i] for i in np.flatnonzero(new).tolist()), range(len(self.known), len(self.lengths)), strict=True))
            at = [self.known[w] for w in names]
        return self.ids, offsets_of(self.lengths), np.array(at, np.int64)

    def encode_batch(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        words, counts = list_parts(pc.ascii_split_whitespace(column))
        coded = words.dictionary_encode()
        names = coded.dictionary
        parted = pc.replace_substring_regex(pc.ascii_lower(names), r"(\pL+)", r" \1 ")
        whole = pc.match_substring_regex(names, _WHOLE)
        parts, per_word = list_parts(pc.ascii_split_whitespace(pc.if_else(whole, names, parted)))
        parts = parts.dictionary_encode()
        ids, at, known = self._parts(parts.dictionary)
        word_ids, lengths = ragged_take(ids, at, known[parts.indices.to_numpy(zero_copy_only=False)])
        ends = np.concatenate(([0], np.cumsum(lengths)))[offsets_of(per_word)]
        values, lengths = ragged_take(word_ids, ends, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64))
        ends = np.concatenate(([0], np.cumsum(lengths)))[offsets_of(counts)]
        return values, np.diff(ends)


@lru_cache(1)
def encoder_of(path: str) -> WordEncoder:
    """One encoder for all tasks of a worker."""
    return WordEncoder(path)


def tier_of(length: int, window: int = WINDOW, shortest: int = SHORTEST) -> int:
    """The tier, a power of two from the shortest to the window, that just holds the length."""
    return min(window, max(shortest, 1 << max(0, length - 1).bit_length()))


class Tiers:
    """Pieces (document, start, length) that wait, each in the tier that just holds it."""

    def __init__(self, window: int = WINDOW, shortest: int = SHORTEST):
        self.window, self.least = window, min(shortest, window)
        self.by_length: dict[int, list[tuple[int, int]]] = {}
        self.lengths: list[int] = []
        self.tokens: dict[int, int] = {}
        tier = window
        while tier >= self.least:
            self.tokens[tier] = 0
            tier //= 2

    def put(self, doc: int, start: int, length: int) -> None:
        if length:
            if length not in self.by_length:
                self.by_length[length] = []
                bisect.insort(self.lengths, length)
            self.by_length[length].append((doc, start))
            self.tokens[tier_of(length, self.window, self.least)] += length

    def _pop(self, k: int) -> tuple[int, int, int]:
        length = self.lengths[k]
        doc, start = self.by_length[length].pop()
        if not self.by_length[length]:
            del self.by_length[length], self.lengths[k]
        self.tokens[tier_of(length, self.window, self.least)] -= length
        return doc, start, length

    def fill(self, size: int) -> list[tuple[int, int, int]]:
        """One full window from the pieces of at most its size, which hold enough: the longest that fit, then a cut one."""
        out, room = [], size
        while room:
            k = bisect.bisect_right(self.lengths, room) - 1
            if k >= 0:
                piece = self._pop(k)
            else:
                doc, start, length = self._pop(0)
                self.put(doc, start + room, length - room)
                piece = (doc, start, room)
            out.append(piece)
            room -= piece[2]
        return out

    def windows(self) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
        """Full windows (tier, pieces) of each tier that has pieces, with shorter tiers' pieces in their gaps."""
        tiers = list(self.tokens)
        for i, tier in enumerate(tiers):
            while self.tokens[tier] and sum(self.tokens[t] for t in tiers[i:]) >= tier:
                yield tier, self.fill(tier)

    def rest(self) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
        """What waits, in windows of ever shorter powers of two."""
        size = self.window
        while total := sum(self.tokens.values()):
            while total < size:
                size //= 2
            yield size, self.fill(size)

    def waiting(self) -> list[tuple[int, int, int]]:
        return [(doc, start, length) for length, pieces in self.by_length.items() for doc, start in pieces]


def cut_windows(lengths: list[int], waiting: Tiers) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
    """The whole long windows of documents with these lengths; what is left of each waits in its tier."""
    for doc, n in enumerate(lengths):
        whole = n // waiting.window
        for k in range(whole):
            yield waiting.window, [(doc, k * waiting.window, waiting.window)]
        waiting.put(doc, whole * waiting.window, n - whole * waiting.window)


PIECE = T.StructType().add("key", "long").add("start", "long").add("length", "long").add("ids_crc32", "long").add("doc_tokens", "long").add("sequence_id", "long").add("offset", "long").add("tier", "long").add("part", "long").add("rank", "long").add("ids", T.ArrayType(T.IntegerType()))


def pack(docs: DataFrame, path: str, end_id: int = 2, window: int = WINDOW, with_ids: bool = True, text: str = "text", key: str = "doc_id", slab: int = SLAB_BYTES // 2, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group, ids.

    Null or empty text is the end id alone. Repeated rows and null keys are packed like others. Texts that a
    worker holds at once (one slab) are packed together with what waits of those before, less than two windows, so
    memory is bounded however large a partition is; sequence ids hold the partition in their upper bits. Every step
    group of a tier but its last has `step_tokens` tokens. No rows give no pieces.
    """
    if window & (window - 1):
        raise ValueError("window must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part = encoder_of(path), TaskContext.get().partitionId()
        sequence, ranks = part << 36, dict[int, int]()
        # What waits of earlier slabs: keys, where their tokens begin in their documents, tokens of these, and ids.
        keys, begin, total, kept = [], np.zeros(0, np.int64), np.zeros(0, np.int64), [np.zeros(0, "<u4")]

        def rows(found: Iterator[tuple[int, list[tuple[int, int, int]]]], at: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
            nonlocal sequence
            out: list[tuple] = []
            for tier, pieces in found:
                rank, offset = ranks.get(tier, 0), 0
                ranks[tier] = rank + 1
                for doc, start, length in pieces:
                    a = int(at[doc]) + start
                    out.append((doc, start, length, zlib.crc32(ids[a : a + length]), sequence, offset, tier, rank))
                    offset += length
                sequence += 1
            for i in range(0, len(out), 4096):
                doc, start, length, crc, seq, off, tier, rank = (np.array(x, np.int64) for x in zip(*out[i : i + 4096], strict=True))
                arrays = [pa.array([keys[d] for d in doc], pa.int64()), *map(pa.array, (begin[doc] + start, length, crc, total[doc], seq, off, tier, np.full(len(doc), part), rank))]
                if with_ids:
                    own = [ids[a : a + n] for a, n in zip((at[doc] + start).tolist(), length.tolist(), strict=True)]
                    arrays.append(pa.ListArray.from_arrays(pa.array(offsets_of(length).astype(np.int32)), pa.array(np.concatenate(own).astype(np.int32))))
                yield pa.RecordBatch.from_arrays(arrays, names=PIECE.names[: len(arrays)])

        waiting, at, ids = Tiers(window), np.zeros(1, np.int64), kept[0]
        for batch in slabs(batches, "t", slab):
            values, lengths = encoder.encode_batch(texts(batch, "t"))
            # The end id follows each document's ids.
            sizes = lengths + 1
            of = offsets_of(sizes)
            fresh = np.full(int(of[-1]), end_id, "<u4")
            mask = np.ones(len(fresh), bool)
            mask[of[1:] - 1] = False
            fresh[mask] = values
            held = np.array([len(x) for x in kept[1:]], np.int64)
            keys, begin, total = keys + batch.column("k").to_pylist(), np.concatenate((begin, np.zeros(len(sizes), np.int64))), np.concatenate((total, sizes))
            sizes, ids = np.concatenate((held, sizes)), np.concatenate((*kept, fresh))
            at, waiting = offsets_of(sizes), Tiers(window)
            yield from rows(cut_windows(sizes.tolist(), waiting), at, ids)
            yield from rows(waiting.windows(), at, ids)
            left = waiting.waiting()
            kept = [kept[0], *(ids[int(at[doc]) + start : int(at[doc]) + start + n].copy() for doc, start, n in left)]
            doc, start = np.array([x[0] for x in left], np.int64), np.array([x[1] for x in left], np.int64)
            keys, begin, total = [keys[d] for d in doc], begin[doc] + start, total[doc]
        sizes = np.array([len(x) for x in kept[1:]], np.int64)
        waiting = Tiers(window)
        for doc, n in enumerate(sizes.tolist()):
            waiting.put(doc, 0, n)
        yield from rows(waiting.rest(), offsets_of(sizes), np.concatenate(kept))

    schema = PIECE if with_ids else T.StructType(PIECE.fields[:-1])
    pieces = materialise(map_arrow(docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")), run, schema), "pieces")
    # Windows of each tier before a partition: a row for each task and tier.
    made = pieces.groupBy("tier", "part").agg((F.max("rank") + 1).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("tier").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = pieces.join(made.select("tier", "part", before.alias("before")), ["tier", "part"])
    group = F.floor((F.col("before") + F.col("rank")) * F.col("tier") / step_tokens).alias("step_group")
    return out.select(F.col("key").alias(key), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", group, *["ids"] * with_ids)
