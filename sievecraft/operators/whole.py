"""Greedy deduplication of records that lie whole in one task: one shuffle of their items, and no pair leaves the task."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame

#: Most bytes of a record's items that are compared in one task; entries of a step, and pairs that wait to be compared.
WHOLE_BYTES, STEP_TERMS, WAITING = 16 << 20, 1 << 20, 1 << 21
#: Tokens of a record whose counts are compared before all others.
TOP = 16


def kept_of_whole(rows: DataFrame, order: list[str], tau: float) -> DataFrame:
    """rec, i (its place in the record) and item of the items of rows (rec, item and columns of order) that greedy deduplication
    keeps: the first of each key, and of equal tokens, that is below tau with all kept before.

    Two items of at least tau share one of the rarest tokens that hold all but tau^2 of their squared norms, rare by the record's
    own counts. What is left from the first such token on bounds what a pair reaches, and so do bits of odd counts and the counts of
    the most frequent tokens (nn_x + nn_y - 2 dot is the sum of the squares by which counts differ, one at least for each bit that
    differs); the others are compared on all tokens.
    """
    least, part, step, waiting, most_often = tau * (1 - 1e-9), 1 - tau * tau, STEP_TERMS, WAITING, TOP
    from sievecraft.functions.text import RUN

    run_ = RUN.replace(r"\s", r" \t\n\x0B\f\r")

    # Defined here, so that executors need no copy of this module.
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def pieces(size: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
            """Ranges of rows whose sizes together are at most most, or of one row."""
            upto, start = np.concatenate(([0], np.cumsum(size))), 0
            while start < len(size):
                end = max(start + 1, int(np.searchsorted(upto, upto[start] + most, "right")) - 1)
                yield start, end
                start = end

        def spans(start: np.ndarray, n: np.ndarray) -> np.ndarray:
            """The numbers start, start + 1 and so on, n of each, one after the other."""
            return np.repeat(start - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())

        def near(row: np.ndarray, code: np.ndarray, c: np.ndarray, nn: np.ndarray) -> np.ndarray:
            """Pairs x < y of at least tau, as x + y * len(nn), in order; entries (row, code, c) are in order, nn is of rows."""
            n, root = len(nn), np.sqrt(nn.astype(float))
            f = np.bincount(code)
            # Counts of the most frequent tokens; bits of the others.
            top = np.full(len(f), -1)
            top[np.argsort(f, kind="stable")[-most_often:]] = np.arange(min(most_often, len(f)))
            often = top[code] >= 0
            heavy = np.zeros((n, most_often), np.int32)
            heavy[row[often], top[code[often]]] = c[often]
            odd, uneven = np.zeros((n, 4), np.uint64), ((c & 1) == 1) & ~often
            np.bitwise_xor.at(odd, (row[uneven], (code[uneven] >> 6) & 3), np.uint64(1) << (code[uneven] & 63).astype(np.uint64))
            # Prefixes, with the share of the norm that is left from each token on.
            order = np.lexsort((code, f[code], row))
            r, t, square = row[order], code[order], (c[order] * c[order]).astype(np.int64)
            before = np.cumsum(square) - square - (np.cumsum(nn) - nn)[r]
            keep = (before <= part * nn[r] + 1e-9) & (f[t] > 1)
            r, t, left = r[keep], t[keep], np.sqrt((nn[r] - before)[keep].astype(float)) / root[r[keep]]
            order = np.lexsort((r, t))
            r, t, left = r[order], t[order], left[order]
            ends = np.append(np.flatnonzero(t[1:] != t[:-1]) + 1, len(t))
            later = np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(len(t)) - 1 if len(t) else t
            # Tokens that one item alone has add nothing to a product.
            shared = f[code] > 1
            kind = np.cumsum(f > 1) - 1
            row, code, c = row[shared], kind[code[shared]], c[shared].astype(np.int64)
            d = np.bincount(row, minlength=n)
            begin, width = np.cumsum(d) - d, max(1, int((f > 1).sum()))
            table = np.zeros((max(1, (1 << 22) // width), width), np.int32)

            def compared(pairs: list[np.ndarray]) -> np.ndarray:
                pairs = np.unique(np.concatenate(pairs))
                y, x = np.divmod(pairs, n)
                _, place = np.unique(y, return_inverse=True)
                hit = np.zeros(len(pairs), bool)
                cuts = np.searchsorted(place, np.arange(0, (place[-1] if len(place) else -1) + 1 + len(table), len(table)))
                for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                    own, at = np.unique(y[low:high], return_index=True)
                    line, cell = np.repeat(np.arange(len(own)), d[own]), spans(begin[own], d[own])
                    table[line, code[cell]] = c[cell]
                    for i, j in pieces(d[x[low:high]], step):
                        xs, size = x[low + i : low + j], d[x[low + i : low + j]]
                        of, at = np.repeat(np.arange(j - i), size), spans(begin[xs], size)
                        products = table[(place[low + i : low + j] - place[low])[of], code[at]] * c[at]
                        dot = np.bincount(of, weights=products, minlength=j - i)
                        hit[low + i : low + j] = dot / np.sqrt((nn[xs] * nn[y[low + i : low + j]]).astype(float)) >= tau
                    table[line, code[cell]] = 0
                return pairs[hit]

            found, held = [], []
            for low, high in pieces(later, step):
                a = np.repeat(np.arange(low, high), later[low:high])
                b = spans(np.arange(low, high) + 1, later[low:high])
                far = left[a] * left[b] >= least
                x, y = r[a[far]], r[b[far]]
                whole = nn[x] + nn[y] - 2 * least * root[x] * root[y]
                for k in range(4):
                    whole -= np.bitwise_count(odd[x, k] ^ odd[y, k])
                    ok = whole >= -1e-6
                    x, y, whole = x[ok], y[ok], whole[ok]
                ok = np.square(heavy[x] - heavy[y]).sum(1) <= whole + 1e-6
                x, y = x[ok], y[ok]
                held.append(np.unique(x + y * n))
                if sum(map(len, held)) > waiting:
                    found.append(compared(held))
                    held = []
            if held:
                found.append(compared(held))
            return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)

        def kept(item: pa.Array) -> np.ndarray:
            """Places of the items that stay, in order."""
            low = pc.utf8_lower(item)
            parts = pc.split_pattern_regex(low, "[^0-9_a-z\\x{4e00}-\\x{9fff}]+")
            flat, row = parts.flatten(), pc.list_parent_indices(parts).to_numpy().astype(np.int64)
            full = pc.not_equal(flat, "")
            coded = flat.filter(full).dictionary_encode()
            row, kinds = row[full.to_numpy(zero_copy_only=False)], max(1, len(coded.dictionary))
            keys = np.sort(row * kinds + coded.indices.to_numpy())
            del parts, flat, full, coded, row
            at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
            c = np.diff(np.append(at, len(keys)))
            row, code = np.divmod(keys[at], kinds)
            ends = np.cumsum(np.bincount(row, minlength=len(item)))
            # Items of equal tokens, and those without tokens of equal keys, are one.
            first, bare, start, codes, counts = {}, {}, 0, code.astype(np.int32), c.astype(np.int32)
            for k, end in enumerate(ends.tolist()):
                if end > start:
                    first.setdefault(codes[start:end].tobytes() + counts[start:end].tobytes(), k)
                else:
                    bare.setdefault(pc.replace_substring_regex(low[k], run_, " ").as_py(), k)
                start = end
            classes = np.fromiter(first.values(), np.int64, len(first))
            del first, codes, counts, low, keys, at
            number = np.full(len(item), -1)
            number[classes] = np.arange(len(classes))
            own = number[row] >= 0
            row, code, c = number[row[own]], code[own], c[own]
            nn = np.bincount(row, weights=c * c, minlength=len(classes)).astype(np.int64)
            dropped = set()
            for y, x in zip(*(v.tolist() for v in np.divmod(near(row, code, c, nn), max(1, len(classes)))), strict=True):
                if y not in dropped and x not in dropped:
                    dropped.add(y)
            stays = np.ones(len(classes), bool)
            stays[np.fromiter(dropped, np.int64, len(dropped))] = False
            return np.sort(np.concatenate((classes[stays], np.fromiter(bare.values(), np.int64, len(bare)))))

        def told(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            record = pa.Table.from_batches(held).combine_chunks()
            place = kept(record.column("item").combine_chunks())
            out = pa.table({"rec": record.column("rec").take(pa.array(place)), "i": pa.array(place.astype(np.int32)), "item": record.column("item").take(pa.array(place))})
            yield from out.to_batches(max_chunksize=10_000)

        held = []
        for batch in batches:
            rec, start = batch.column("rec"), 0
            if held and batch.num_rows and held[-1].column("rec")[0] != rec[0]:
                yield from told(held)
                held = []
            for end in [*(np.flatnonzero(pc.not_equal(rec.slice(1), rec.slice(0, len(rec) - 1)).to_numpy(zero_copy_only=False)) + 1).tolist()] if len(rec) > 1 else []:
                yield from told([*held, batch.slice(start, end - start)])
                held, start = [], end
            if batch.num_rows:
                held.append(batch.slice(start))
        if held:
            yield from told(held)

    kind = rows.schema["rec"].dataType.simpleString()
    # A record is much work however few bytes it has: dealt by a fixed number, which small sizes do not merge into one task.
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.where("rec IS NOT NULL").select("rec", "item", *order).repartition(n, "rec").sortWithinPartitions("rec", *order)
    return dealt.select("rec", "item").mapInArrow(run, f"rec {kind}, i int, item string")
