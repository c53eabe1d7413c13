"""Byte-level BPE by a pair occurrence index over the distinct pre-tokens of a slab of texts.

A partition is read in slabs of at most SLAB_BYTES of text. A slab is cut into pre-tokens; the distinct ones are laid out as one
array of symbols with links to their neighbours. An index maps every mergeable pair (by rank) to all
its positions in that array. Ranks are applied in ascending order, all positions of a rank at once, and
only the lists of the pairs beside a merge are updated. A merge of rank r makes a symbol that no pair of
lower rank holds, so one ascending sweep gives what merging word by word gives.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievecraft.llm.common import SLAB_BYTES, list_parts, map_arrow, offsets_of, ragged_take, slabs, texts

#: Fixed value: the pre-token pattern that the vocabulary file is used with.
PRETOKEN = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
#: A blank followed by white space: only then do the pieces between blanks depend on each other.
_DOUBLE = r" [\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def byte_alphabet() -> dict[int, str]:
    """Byte to the printable character that stands for it in byte-level vocabularies."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class PairIndexBPE:
    """Encoder and decoder over a vocabulary file with merges and special tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        to_byte = {c: b for b, c in byte_alphabet().items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_re = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        words = dict(sorted(((i, bytes(to_byte[c] for c in w)) for w, i in vocab.items() if w not in self.special), key=lambda x: x[0]))
        words |= {i: w.encode() for w, i in self.special.items()}
        self.token_bytes = [words.get(i, b"") for i in range(max(words) + 1)]
        self.token_values = np.frombuffer(b"".join(self.token_bytes), np.uint8)
        self.token_offsets = offsets_of(np.array([len(w) for w in self.token_bytes]))
        self.byte_id = np.array([vocab[c] for _, c in sorted(byte_alphabet().items())], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.width = len(self.token_bytes)
        self.left = np.array([vocab[a] for a, _ in merges], np.int64)
        self.right = np.array([vocab[b] for _, b in merges], np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        keys = self.left * self.width + self.right
        self.key_order = np.argsort(keys, kind="stable")
        self.keys = keys[self.key_order]

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols, -1 for pairs that never merge."""
        key = a * self.width + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.key_order[at], -1)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each pre-token, as values and offsets."""
        sizes = np.array([len(w) for w in words], np.int64)
        starts = offsets_of(sizes)
        n = int(starts[-1])
        sym = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        nxt, prv, alive = np.arange(1, n + 1), np.arange(-1, n - 1), np.ones(n, bool)
        ends = starts[1:][sizes > 0] - 1
        nxt[ends] = -1
        prv[starts[:-1][sizes > 0]] = -1
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def note(at: np.ndarray) -> None:
            ranks = self._ranks(sym[at], sym[nxt[at]])
            at, ranks = at[ranks >= 0], ranks[ranks >= 0]
            order = np.argsort(ranks, kind="stable")
            at, ranks = at[order], ranks[order]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            for part, r in zip(np.split(at, cuts), ranks[np.concatenate(([0], cuts))].tolist() if len(ranks) else []):
                if r not in index:
                    index[r] = []
                    heapq.heappush(active, r)
                index[r].append(part)

        note(np.flatnonzero(nxt >= 0))
        while active:
            r = heapq.heappop(active)
            at = np.unique(np.concatenate(index.pop(r)))
            a, b = self.left[r], self.right[r]
            at = at[alive[at] & (sym[at] == a) & (nxt[at] >= 0)]
            at = at[sym[nxt[at]] == b]
            if a == b and len(at) > 1:  # in a run of one symbol, every second position merges
                fresh = np.concatenate(([True], prv[at[1:]] != at[:-1]))
                first = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - first) % 2 == 0]
            if not len(at):
                continue
            gone = nxt[at]
            after = nxt[gone]
            sym[at] = self.made[r]
            alive[gone] = False
            nxt[at] = after
            has = after >= 0
            prv[after[has]] = at[has]
            before = prv[at]
            note(np.unique(np.concatenate((before[before >= 0], at[has]))))
        kept = np.concatenate(([0], np.cumsum(alive)))
        return sym[alive], kept[starts]

    def pieces(self, text: str, leading: bool) -> list[int | bytes]:
        """Pre-tokens of a piece; a special token is its id."""
        text = f" {text}" if leading else text
        if text.isascii() and text[leading:].isalpha():
            return [text.encode()]
        if not self.special_re or not self.special_re.search(text):
            return [w.encode() for w in PRETOKEN.findall(text)]
        parts = self.special_re.split(text)
        return [x for part in parts for x in ([self.special[part]] if part in self.special else [w.encode() for w in PRETOKEN.findall(part)])]

    def encode_batch(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each text, as values and the number of ids of each."""
        whole = pc.match_substring_regex(column, _DOUBLE).to_numpy(zero_copy_only=False)
        parts, counts = list_parts(pc.split_pattern(column, " "))
        # Pieces between single blanks encode alike wherever they stand; texts with other gaps stay whole.
        lead = np.ones(len(parts), bool)
        lead[offsets_of(counts)[:-1]] = False
        if whole.any():
            keep = ~np.repeat(whole, counts)
            texts_whole = column.filter(pa.array(whole))
            rows = np.concatenate((np.repeat(np.arange(len(column)), counts)[keep], np.flatnonzero(whole)))
            parts = pa.concat_arrays([parts.filter(pa.array(keep)), texts_whole])
            lead = np.concatenate((lead[keep], np.zeros(len(texts_whole), bool)))
            order = np.argsort(rows, kind="stable")
            parts, lead, counts = parts.take(pa.array(order)), lead[order], np.bincount(rows, minlength=len(column))
        coded = parts.dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * 2 + lead
        used, codes = np.unique(codes, return_inverse=True)
        words: dict[bytes, int] = {}
        units, per_piece = [], []
        names = coded.dictionary.to_pylist()
        for u in used.tolist():
            found = self.pieces(names[u >> 1], bool(u & 1))
            per_piece.append(len(found))
            for w in found:
                units.append(-1 - w if type(w) is int else words.setdefault(w, len(words)))
        ids, at = self.encode_words(list(words))
        special = np.array(sorted(self.special.values()), np.int64)
        base = len(at) - 1  # special tokens follow the words as units of one id
        ids, at = np.concatenate((ids, special)), np.concatenate((at, at[-1] + 1 + np.arange(len(special))))
        unit = np.array(units, np.int64)
        unit = np.where(unit >= 0, unit, base + np.searchsorted(special, -1 - unit))
        piece_ids, lengths = ragged_take(ids, at, unit)
        sizes = np.add.reduceat(np.append(lengths, 0), offsets_of(np.array(per_piece, np.int64))[:-1]) if per_piece else np.zeros(0, np.int64)
        sizes = np.where(np.array(per_piece, np.int64) > 0, sizes, 0)
        values, lengths = ragged_take(piece_ids, offsets_of(sizes), codes)
        ends = np.concatenate(([0], np.cumsum(lengths)))[offsets_of(counts)]
        return values, np.diff(ends)

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids; bytes that are no UTF-8 become replacement characters."""
        return ragged_take(self.token_values, self.token_offsets, ids)[0].tobytes().decode("utf-8", "replace")


@lru_cache(1)
def model_of(path: str) -> PairIndexBPE:
    """One model for all tasks of a worker."""
    return PairIndexBPE(path)


def encode(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: key, ids (array<int>) and decoded, the text that the ids give back.

    A null or empty text has no ids and decodes to the empty text. Repeated rows and null keys each give
    a row. Other columns are ignored. No shuffle; a worker holds one slab of texts at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(path)
        for batch in slabs(batches, "t", 2 * SLAB_BYTES):
            values, lengths = model.encode_batch(texts(batch, "t"))
            at = offsets_of(lengths)
            for i in range(0, batch.num_rows, 256):
                j = min(i + 256, batch.num_rows)
                back = [model.decode(values[at[k] : at[k + 1]]) for k in range(i, j)]
                ids = pa.ListArray.from_arrays(pa.array((at[i : j + 1] - at[i]).astype(np.int32)), pa.array(values[at[i] : at[j]].astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("k").slice(i, j - i), ids, pa.array(back, pa.string())], names=["k", "ids", "decoded"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    return map_arrow(rows, run, f"k {kind}, ids array<int>, decoded string").withColumnRenamed("k", key)


def digests(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Digest form of `encode`: key, n_tokens, ids_sha256, decoded_sha256.

    The ids and texts are hashed beside the encoder, so that they need not leave the worker. Edge cases as
    in `encode`; without ids the digests are those of the empty string.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(path)
        for batch in slabs(batches, "t", 2 * SLAB_BYTES):
            values, lengths = model.encode_batch(texts(batch, "t"))
            at = offsets_of(lengths)
            small = values.astype("<u4")
            ids = [hashlib.sha256(small[at[k] : at[k + 1]].tobytes()).hexdigest() for k in range(batch.num_rows)]
            back = [hashlib.sha256(model.decode(values[at[k] : at[k + 1]]).encode()).hexdigest() for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(lengths, pa.int64()), pa.array(ids), pa.array(back)], names=["k", "n", "i", "d"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    out = map_arrow(rows, run, f"k {kind}, n bigint, i string, d string")
    return out.select(F.col("k").alias(key), F.col("n").alias("n_tokens"), F.col("i").alias("ids_sha256"), F.col("d").alias("decoded_sha256"))
