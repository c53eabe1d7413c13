"""Near-duplicate components by circulant MinHash.

A document is the set of its word shingles. One permutation scatters the shingles over a universe of bins,
a second one gives the bins ranks; circularly shifted by 0, 1, 2, ... it yields all coordinates of the
signature. Bands of coordinates propose links, full shingle sets confirm them, and star contraction joins
the links to components.

Groups of copies stay cheap: equal sets are one node, and a bucket of a band proposes its members to its
heaviest node rather than to each other. What that leaves open (members of one bucket in several
components) is compared where two of them share one of their rarest shingles, which every link does.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievecraft.llm.common import fresh_name, list_parts, map_arrow, materialise, offsets_of, slabs, texts
from sievecraft.llm.dedup import digest

#: Bands and coordinates in each. A pair of similarity 0.8 shares no band with probability 2e-6.
BANDS, ROWS = 56, 7
#: Bins of the permuted universe.
BINS = 1 << 20
SEED = 20_240_229
#: Text bytes of a step of a worker, whose memory idle workers keep beside the heap of later stages.
STEP_BYTES = 2 << 20


@lru_cache(1)
def circulant(coordinates: int) -> np.ndarray:
    """Ranks of the second permutation, with the first ones repeated at the end so that shifts are slices."""
    ranks = np.random.default_rng(SEED).permutation(BINS).astype(np.uint32)
    return np.concatenate((ranks, ranks[:coordinates]))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def token_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of each text and the number of words; A-Z lower-cased, ASCII blanks apart."""
    parts, counts = list_parts(pc.ascii_split_whitespace(pc.ascii_lower(column)))
    coded = parts.dictionary_encode()
    words = coded.dictionary.to_numpy(zero_copy_only=False)
    hashes = pd.util.hash_array(words, categorize=False) if len(words) else np.zeros(0, np.uint64)
    codes = coded.indices.to_numpy(zero_copy_only=False)
    full = np.array([w != "" for w in words], bool)
    if not full.all():  # white space at an end of a text leaves an empty part
        keep = full[codes]
        counts = np.bincount(np.repeat(np.arange(len(counts)), counts)[keep], minlength=len(counts)).astype(np.int64)
        codes = codes[keep]
    return hashes[codes].astype(np.uint64), counts


def shingle_hashes(tokens: np.ndarray, width: int) -> np.ndarray:
    """Distinct sorted hashes of a text's shingles; with fewer words than the width, one of them all."""
    n = min(width, len(tokens))
    if not n:
        return np.zeros(0, np.uint64)
    total = np.full(len(tokens) - n + 1, n, np.uint64)
    for k in range(n):
        total = mix(total + tokens[k : len(tokens) - n + 1 + k])
    return np.unique(total)


def signature(shingles: np.ndarray, coordinates: int = BANDS * ROWS) -> np.ndarray:
    """Circulant MinHash signature of a non-empty set."""
    ranks = circulant(coordinates)
    at = (mix(shingles + np.uint64(SEED)) & np.uint64(BINS - 1)).astype(np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(ranks, coordinates)
    out = np.full(coordinates, BINS, np.uint32)
    for i in range(0, len(at), 512):
        np.minimum(out, windows[at[i : i + 512]].min(axis=0), out=out)
    return out


def band_keys(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key of each band."""
    bands = sig.reshape(-1, rows).astype(np.uint64)
    key = np.arange(1, len(bands) + 1, dtype=np.uint64)
    for k in range(rows):
        key = mix(key + bands[:, k])
    return key.view(np.int64)


def sketches(docs: DataFrame, width: int, text: str, key: str) -> DataFrame:
    """key, node (digest of the shingle set, null without words), n (set size), bands of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slabs(batches, "t", STEP_BYTES):
            tokens, counts = token_hashes(texts(batch, "t"))
            at = offsets_of(counts)
            nodes, sizes, bands = [], [], []
            for i in range(batch.num_rows):
                found = shingle_hashes(tokens[at[i] : at[i + 1]], width)
                nodes.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                sizes.append(len(found))
                bands.append(band_keys(signature(found)) if len(found) else np.zeros(0, np.int64))
            lists = pa.ListArray.from_arrays(pa.array(offsets_of(np.array([len(b) for b in bands])).astype(np.int32)), pa.array(np.concatenate(bands)))
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), lists], names=["key", "node", "n", "bands"])

    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    return map_arrow(rows, run, "key bigint, node binary, n bigint, bands array<bigint>")


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """node and its shingles (64-bit hashes) of documents (columns k, t)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slabs(batches, "t", STEP_BYTES):
            tokens, counts = token_hashes(texts(batch, "t"))
            at = offsets_of(counts)
            for i in range(batch.num_rows):
                found = shingle_hashes(tokens[at[i] : at[i + 1]], width)
                node = hashlib.blake2b(found.tobytes(), digest_size=16).digest()
                yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([found.view(np.int64)], pa.list_(pa.int64()))], names=["node", "shingles"])

    return map_arrow(docs, run, "node binary, shingles array<bigint>")


def links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) with the sizes of their sets' intersection and union, from the full sets."""
    a = sets.select(F.col("node").alias("a"), F.col("shingles").alias("of_a"))
    b = sets.select(F.col("node").alias("b"), F.col("shingles").alias("of_b"))
    both = pairs.join(a, "a").join(b, "b")
    both = both.withColumn("shared", F.size(F.array_intersect("of_a", "of_b")))
    return both.select("a", "b", "shared", (F.size("of_a") + F.size("of_b") - F.col("shared")).alias("total"))


def components(edges: DataFrame) -> DataFrame:
    """node and its component (smallest node reachable) for the nodes of edges (a, b), by star contraction.

    A round gives each node's larger neighbours the smallest one, then its smaller ones; it is the last when no
    edge leads to a node that has an edge of its own. No edges give no rows.
    """

    def smallest(e: DataFrame) -> DataFrame:
        return e.groupBy("u").agg(F.min("v").alias("m"))

    now = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while not now.isEmpty():
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = smallest(both).select("u", F.least("u", "m").alias("m"))
        large = materialise(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")), "large")
        small = large.join(smallest(large), "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        now = materialise(small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct(), "edges")
        if now.join(now.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def near_duplicates(docs: DataFrame, width: int = 5, threshold: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: key, n_shingles, component_id, kept.

    Documents are linked when 100 * shared >= threshold * united shingles; component_id is the smallest key
    reachable and kept marks its rows. Null, empty and blank texts are linked with nothing; a text
    with fewer words than the width is one shingle. Rows with a null key take the component of rows with the
    same set, else null, are never linked further, and are kept where no other row has their set. Repeated
    rows share their component and fate. No rows give no rows; other columns are ignored.
    """
    rows = materialise(sketches(docs, width, text, key), "sketches")
    nodes = rows.where("node IS NOT NULL AND key IS NOT NULL").groupBy("node").agg(F.min("key").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    nodes = materialise(nodes, "nodes")
    banded = nodes.select(F.explode("bands").alias("band"), "node", "n")
    shared = nodes.select(F.explode("bands").alias("band")).groupBy("band").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    members = materialise(banded.join(shared, "band"), "members")
    # A node's weight: the sizes of its buckets. The centre of a group of near copies has the greatest.
    weights = members.groupBy("node").agg(F.sum("c").alias("weight"))
    members = materialise(members.join(weights, "node").select("band", "node", "n", "weight", F.col("node").alias("label")), "members")

    def fits(a: str, b: str) -> str:
        return f"100 * least({a}, {b}) >= {threshold} * greatest({a}, {b})"

    wanted = members.select("node").distinct().join(nodes.select("node", "rep"), "node").select(F.col("rep").alias("k")).distinct()
    sets = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).join(wanted, "k", "left_semi")
    sets = materialise(shingle_sets(sets, width).dropDuplicates(["node"]), "sets")

    def linked(found: DataFrame) -> DataFrame:
        return found.where(f"100 * shared >= {threshold} * total").select("a", "b")

    # Each bucket's members are tested against its heaviest node.
    order = F.struct(-F.col("weight"), "node", "n")
    pivots = members.groupBy("band").agg(F.min(order).alias("p")).select("band", F.col("p.node").alias("a"), F.col("p.n").alias("na"))
    pairs = members.join(pivots, "band").where(F.col("node") != F.col("a")).where(fits("n", "na")).select(F.greatest("node", "a").alias("a"), F.least("node", "a").alias("b")).distinct()
    tested = materialise(links(pairs, sets), "tested")
    joined = components(linked(tested))

    # What that leaves open: members of one bucket in two components. A link between sets of n and m shingles takes
    # threshold / (100 + threshold) * (n + m) in common; so, with the rarest shingles first, the two share one
    # among the first n - that + 1 of each (the least m of the node's buckets stands for m).
    left = _labelled(members, joined)
    mixed = left.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min("n").alias("least_n")).where("low <> high").select("band", "least_n")
    left = left.join(mixed, "band").groupBy("node").agg(F.first("n").alias("n"), F.first("label").alias("label"), F.min("least_n").alias("least_n"))
    left = materialise(left, "open")
    each = materialise(sets.join(left.select("node"), "node").select("node", F.explode("shingles").alias("shingle")), "shingles")
    common = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.coalesce("c", F.lit(1)), "shingle"))
    front = each.join(common, "shingle", "left").withColumn("rank", rank).join(left, "node")
    front = front.where(f"c > 1 AND rank <= n - ceil({threshold} * (n + least_n) / {100 + threshold}) + 1").select("shingle", "node", "n", "label", "rank")
    front = materialise(front, "front")
    x, y = (front.select("shingle", *[F.col(c).alias(f"{c}_{k}") for c in ("node", "n", "label", "rank")]) for k in ("x", "y"))
    pairs = x.join(y, "shingle").where("node_x > node_y AND label_x <> label_y").where(fits("n_x", "n_y"))
    pairs = pairs.where(f"greatest(rank_x - n_x, rank_y - n_y) <= 1 - ceil({threshold} * (n_x + n_y) / {100 + threshold})")
    pairs = pairs.select(F.col("node_x").alias("a"), F.col("node_y").alias("b")).distinct().join(tested.select("a", "b"), ["a", "b"], "left_anti")
    late = materialise(linked(links(pairs, sets)), "late")

    known = nodes.select("node", "rep").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    if not late.isEmpty():  # components that a late link joins
        of = joined.select(F.col("node").alias("a"), F.col("component").alias("of_a"))
        late = late.join(of, "a", "left").join(of.select(F.col("a").alias("b"), F.col("of_a").alias("of_b")), "b", "left")
        again = components(late.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")))
        again = again.select(F.col("node").alias("component"), F.col("component").alias("whole"))
        known = known.join(again, "component", "left").select("node", "rep", F.coalesce("whole", "component").alias("component"))
    first = known.groupBy("component").agg(F.min("rep").alias("component_id"))
    known = known.join(first, "component").select("node", "component_id")
    out = rows.where("node IS NOT NULL").select("key", "node", "n").join(known, "node", "left")
    out = out.select("key", "n", "component_id").unionByName(rows.where("node IS NULL").select("key", "n", F.col("key").alias("component_id")))
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept"))


def _labelled(members: DataFrame, joined: DataFrame) -> DataFrame:
    """Members of buckets with the component of each as its label."""
    out = members.drop("label").join(joined, "node", "left")
    return out.withColumn("label", F.coalesce("component", "node")).drop("component")


def kept_rows(docs: DataFrame, width: int = 5, threshold: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The documents that stay, one of each component, with all their columns.

    Rows are told apart by key and text, so those with a null key or the key of another text are linked like all
    others. The smallest key stays, null as the last, and of its texts the one of the smallest digest; rows that
    repeat key and text share their fate.
    """
    row, name = F.xxhash64(F.col(key).isNull(), key, digest(text)), fresh_name("row", docs)
    found = near_duplicates(docs.select(row.alias("row"), F.col(text).alias("text")), width, threshold, "text", "row").select("row", "component_id").distinct()
    rank = F.struct(F.col(key).isNull().alias("none"), F.col(key).cast("long").alias("key"), digest(text).alias("digest"))
    found = materialise(found.join(docs.select(row.alias("row"), rank.alias("rank")).distinct(), "row"), "found")
    first = found.groupBy("component_id").agg(F.min("rank").alias("first"))
    dropped = found.join(first, "component_id").where("rank <> first").select(F.col("row").alias(name))
    return docs.join(dropped, row == F.col(name), "left_anti")
