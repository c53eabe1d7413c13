"""Items of texts and what is told of each, in Arrow batches: a text is cleaned, keyed and cut into tokens once.

The rules are those of `functions.text` and `functions.verify`, but small letters are as SQL has them, one for each letter.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievecraft.functions.text import BULLET, RUN, WS, WS_CHARS
from sievecraft.functions.verify import GENERIC_STANDALONE

#: Bytes of text of a step of a Python worker.
STEP_BYTES = 1 << 22
FACTS = {"item": "string", "name": "string", "w": "array<string>", "nn": "bigint", "d": "bigint", "reason": "string"}


def items_of(rows: DataFrame, key: str, *facts: str) -> DataFrame:
    """key, other columns, i and facts of the cleaned non-empty lines of text; i is the line's place.

    Facts: item, name (a digest of the key under which items are equal), w (tokens in order), nn (their squared norm), d (how many
    differ), reason (the first rule that the item breaks, else rule_pass).
    """
    return _told(rows.select(key, *[c for c in rows.columns if c != key]), "text", facts or ("item",))


def with_facts(items: DataFrame, *facts: str) -> DataFrame:
    """Facts of items that stand in a row each, beside their other columns."""
    return _told(items, "item", facts)


def _told(rows: DataFrame, source: str, facts: tuple[str, ...]) -> DataFrame:
    kept = [c for c in rows.columns if c != source]
    # RE2 knows \s without \x0B.
    spell = lambda pattern: pattern.replace(r"\s", r" \t\n\x0B\f\r")
    step, white, bullet, run_, outer = STEP_BYTES, WS_CHARS, spell(BULLET.replace(WS, spell(WS))), spell(RUN), " \t\r\n\"'"
    generic_words, split = GENERIC_STANDALONE, source == "text"

    # Defined here, so that executors need no copy of this module.
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def collapsed(x: pa.Array) -> pa.Array:
            return pc.replace_substring_regex(x, run_, " ") if pc.any(pc.match_substring_regex(x, run_)).as_py() else x

        def bare(x: pa.Array) -> pa.Array:
            return pc.replace_substring_regex(x, bullet, "", max_replacements=1)

        def cut(low: pa.Array) -> tuple:
            """Codes of all tokens, their dictionary, and where those of each text begin."""
            parts = pc.split_pattern_regex(low, "[^0-9_a-z\\x{4e00}-\\x{9fff}]+")
            flat, row = parts.flatten(), pc.list_parent_indices(parts).to_numpy()
            full = pc.not_equal(flat, "")
            coded = flat.filter(full).dictionary_encode()
            row = row[full.to_numpy(zero_copy_only=False)]
            return coded.indices.to_numpy(), coded.dictionary, row, np.bincount(row, minlength=len(low))

        def counted(codes: np.ndarray, words: pa.Array, row: np.ndarray, n: np.ndarray) -> tuple:
            generic = pc.is_in(words, pa.array(generic_words)).to_numpy(zero_copy_only=False)
            return n, np.bincount(row, weights=generic[codes], minlength=len(n)) > 0

        def reasons(items: pa.Array, low: pa.Array, tokens: tuple) -> pa.Array:
            text = pc.utf8_trim(bare(collapsed(pc.utf8_trim(items, white))), outer)
            n, has = counted(*tokens)
            other = np.flatnonzero(pc.not_equal(text, items).to_numpy(zero_copy_only=False))  # those that have a second bullet
            if len(other):
                low = pc.utf8_lower(text)
                n, has = n.copy(), has.copy()
                n[other], has[other] = counted(*cut(low.take(pa.array(other))))
            meta = pc.or_(pc.starts_with(low, "return "), pc.starts_with(low, "generate "))
            for part in ("json list", "candidate answer a", "candidate answer b"):
                meta = pc.or_(meta, pc.match_substring(low, part))
            tests = [pc.equal(text, "").to_numpy(zero_copy_only=False), n < 3, (n <= 4) & has, pc.utf8_length(text).to_numpy() > 800, meta.to_numpy(zero_copy_only=False)]
            names = np.array(["empty", "too_short", "too_generic", "too_long", "meta_instruction"], object)
            return pa.array(np.select(tests, names, "rule_pass"), pa.string())

        def told(batch: pa.RecordBatch) -> pa.RecordBatch:
            item, of, place = pc.fill_null(batch.column(source), ""), np.arange(batch.num_rows), None
            if split:
                lines = pc.split_pattern(item, "\n")
                item = pc.utf8_trim(collapsed(bare(pc.utf8_trim(lines.flatten(), white))), outer)
                of = pc.list_parent_indices(lines).to_numpy()
                keep = np.flatnonzero(pc.not_equal(item, "").to_numpy(zero_copy_only=False))
                place = pa.array((np.arange(len(of)) - lines.offsets.to_numpy()[of])[keep].astype(np.int32))
                item, of = item.take(pa.array(keep)), of[keep]
            low, found = None, {"item": item}
            if set(facts) - {"item"}:
                low = pc.utf8_lower(item)
            if "name" in facts:
                found["name"] = pa.array([hashlib.md5(x).hexdigest() for x in collapsed(low).cast(pa.binary()).to_pylist()], pa.string())
            if {"w", "reason"} & set(facts):
                codes, words, row, n = tokens = cut(low)
            if "w" in facts:
                order = pc.sort_indices(words).to_numpy()
                rank = np.empty(len(order), np.int64)
                rank[order] = np.arange(len(order))
                keys = np.sort(row * max(1, len(words)) + rank[codes])
                row, code = np.divmod(keys, max(1, len(words)))
                found["w"] = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), words.take(pa.array(order[code])))
                at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
                c = np.diff(np.append(at, len(keys)))
                found["nn"] = pa.array(np.bincount(row[at], weights=c * c, minlength=len(item)).astype(np.int64))
                found["d"] = pa.array(np.bincount(row[at], minlength=len(item)).astype(np.int64))
            if "reason" in facts:
                found["reason"] = reasons(item, low, tokens)
            at = pa.array(of)
            columns = {k: batch.column(k).take(at) for k in kept} | ({"i": place} if split else {}) | {f: found[f] for f in facts}
            return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

        for whole in batches:
            size, start = np.concatenate(([0], np.cumsum(pc.fill_null(pc.binary_length(whole.column(source)), 0).to_numpy().astype(np.int64)))), 0
            while start < whole.num_rows:
                end = max(start + 1, int(np.searchsorted(size, size[start] + step, "right")) - 1)
                # A copy of the step alone: offsets of slices count from the whole batch.
                yield told(whole.slice(start, end - start).take(pa.array(np.arange(end - start))))
                start = end

    if not set(facts) <= set(FACTS) or ({"nn", "d"} & set(facts) and "w" not in facts):
        raise ValueError(f"unknown facts {facts}")
    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*kept).schema] + (["i int"] if split else []) + [f"{f} {FACTS[f]}" for f in facts]
    return rows.select(*kept, F.col(source)).mapInArrow(run, ", ".join(schema))
