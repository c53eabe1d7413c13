"""Structure repair of conversations by a rank-convergence parallel Viterbi.

Rows of a conversation are put in order by a range sort, so that a long one lies in many partitions, and cut into
chunks of at most CHUNK rows. Each chunk takes a speculative vector of costs at its end and runs backwards; fix-up
passes hand it the vector with which the chunk after it begins, until no chunk's vector changes by more than a constant.
From the stitched backward costs every chunk traces the least audit from each state it may be entered in; the entries
are found by composing the chunks' maps of states, twice as many at each step. So no conversation is ever in one task
but for its repaired text, whose SHA-256 has to see it in order; it passes as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievecraft.llm.common import map_arrow, materialise

#: Rows of a chunk; cost of an insertion, a new role and a text cut off, and of a deletion.
CHUNK, CHANGE, DELETE = 4096, 3, 4
#: States: nothing yet, after the system's turn, after a user's, after an assistant's. OPEN: where each letter of an
#: initial leads from them (u and a are also where a new role or an insertion may lead).
START, SYSTEM, USER, ASSISTANT = range(4)
LEADS = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
NEXT = [USER, USER, ASSISTANT, USER]  # the state after an insertion or a new role
ROLE_OF = {USER: "user", ASSISTANT: "assistant"}
#: Cost of the cheapest end from each state, by insertions alone.
END = (0, 2 * CHANGE, CHANGE, 0)
#: Faults of a row, as its code has them beside the initial.
SOUND, GONE, CUT = range(3)


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows with the damage that crc32 of `conv:turn` modulo 20 deals (0 drops, 1 empties, 2 takes out the stops, 3 repeats,
    4 makes a user's); nulls are one space. Columns conv, turn, role, text, copies (1 or 2)."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat(said(conv), F.lit(":"), said(turn))) % 20
    out = rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), said(role).alias("role"), said(text).alias("text"), k.alias("k")).where("k <> 0")
    changed = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return out.select("conv", "turn", F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"), changed.alias("text"), F.when(F.col("k") == 3, 2).otherwise(1).cast("long").alias("copies"))


def settled(row: list[int]) -> tuple[int, ...]:
    """Costs of the states where an insertion may come first."""
    out = list(row)
    for _ in range(2):
        for state, to in enumerate(NEXT):
            out[state] = min(out[state], CHANGE + out[to])
    return tuple(out)


def edits(state: int, initial: str, fault: int) -> list[tuple[str, int, int]]:
    """Letter, cost and next state of what can be done with a row, by letter."""
    out = [("D", DELETE, state)]
    if fault != GONE:
        more = CHANGE if fault == CUT else 0
        if state in LEADS.get(initial, {}):
            out.append(("K", more, LEADS[initial][state]))
        out.append(("R", more + CHANGE, NEXT[state]))
    return out


class Machine:
    """Steps of the backward costs, remembered: vectors differ by constants from few, as no two costs are far apart."""

    def __init__(self):
        self.known: dict[tuple[tuple[int, ...], str, int], tuple[tuple[int, ...], int]] = {}

    def back(self, after: tuple[int, ...], initial: str, fault: int) -> tuple[tuple[int, ...], int]:
        """The vector before a row, less its least cost, and that cost."""
        key = (after, initial, fault)
        if key not in self.known:
            full = settled([min(cost + after[to] for _, cost, to in edits(s, initial, fault)) for s in range(4)])
            low = min(full)
            self.known[key] = tuple(x - low for x in full), low
        return self.known[key]

    def vectors(self, end: tuple[int, ...], initials: str, faults: bytes) -> list[tuple[int, ...]]:
        """Costs at each row and after the last, each less its own least."""
        out = [end]
        for initial, fault in zip(reversed(initials), reversed(faults), strict=True):
            out.append(self.back(out[-1], initial, fault)[0])
        return out[::-1]

    def begin(self, end: tuple[int, ...], initials: str, faults: bytes) -> tuple[int, ...]:
        for initial, fault in zip(reversed(initials), reversed(faults), strict=True):
            end = self.back(end, initial, fault)[0]
        return end

    def trace(self, state: int, vectors: list[tuple[int, ...]], initials: str, faults: bytes, last: bool) -> tuple[str, int, int]:
        """The least audit from a state, its cost and the state it ends in. At a place the costs are known but for a
        constant, which an insertion leaves as it is and a row shifts by the same for all states."""
        said, cost = [], 0
        for i, (initial, fault) in enumerate(zip(initials, faults, strict=True)):
            here, (_, low) = vectors[i], self.back(vectors[i + 1], initial, fault)
            while True:
                found = [(letter, c, to) for letter, c, to in edits(state, initial, fault) if c + vectors[i + 1][to] == low + here[state]]
                if CHANGE + here[NEXT[state]] == here[state]:
                    found.append(("I", CHANGE, NEXT[state]))
                letter, c, state = min(found)
                said.append(letter)
                cost += c
                if letter != "I":
                    break
        while last and END[state]:
            said.append("I")
            cost, state = cost + CHANGE, NEXT[state]
        return "".join(said), cost, state


NAMES = ["conv", "part", "chunk", "place", "role", "text", "initials", "faults", "begin", "ended", "blank", "duplicate", "truncated", "illegal", "first_turn", "last_turn", "n_turns"]
FIELDS = "conv {}, part int, chunk bigint, place bigint, role string, text string, initials string, faults binary, begin array<bigint>, ended array<bigint>, blank bigint, duplicate bigint, truncated bigint, illegal bigint, first_turn bigint, last_turn bigint, n_turns bigint"
#: Rows and bytes of text after which a worker hands on what it has.
OUT_ROWS, OUT_BYTES = 8192, 8 << 20


def _chunks(most: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From sorted rows: each again with its chunk and place (text only where it may stay), and one row for each chunk with
    what is needed of its rows. Of the chunk at hand only codes are held."""
    from pyspark import TaskContext

    machine, part = Machine(), TaskContext.get().partitionId()
    out, size, chunk, conv, place, kind = [], 0, -1, None, 0, None
    initials, faults, counts, turns = [], bytearray(), {}, [None, None, 0]

    def close() -> None:
        joined = "".join(initials)
        begin = machine.begin(END, joined, bytes(faults))
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(joined, joined[1:], strict=False))
        out.append((conv, part, chunk, -1, None, None, joined, bytes(faults), begin, END, *(counts.get(k, 0) for k in ("blank", "duplicate", "truncated")), illegal, *turns))

    def handed() -> pa.RecordBatch:
        long, lists = pa.int64(), pa.list_(pa.int64())
        types = [kind, pa.int32(), long, long, pa.string(), pa.string(), pa.string(), pa.binary(), lists, lists, *[long] * 7]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=NAMES)

    for batch in batches:
        kind = batch.schema.field("conv").type
        for of, turn, role, text, fault, copies in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for k in range(copies):
                if chunk < 0 or of != conv or place == most:
                    if chunk >= 0:
                        close()
                    chunk, conv, place = chunk + 1, of, 0
                    initials, faults, counts, turns = [], bytearray(), {}, [None, None, 0]
                told = "duplicate" if k and fault != "blank" else fault
                counts[told] = counts.get(told, 0) + 1
                initials.append(role[:1] if role[:1] in ("s", "u", "a") else "-")
                faults.append(GONE if told in ("blank", "duplicate") else CUT if told else SOUND)
                if turn is not None and turn != turns[1]:
                    turns = [turn if turns[0] is None else turns[0], turn, turns[2] + 1]
                stays = faults[-1] != GONE
                out.append((of, part, chunk, place, role if stays else None, text if stays else None, *[None] * 11))
                size, place = size + (len(text) if stays else 0), place + 1
                if len(out) >= OUT_ROWS or size >= OUT_BYTES:
                    yield handed()
                    out, size = [], 0
    if chunk >= 0:
        close()
        yield handed()


def ordered(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Damaged rows in order, cut into chunks: a written table of rows (place from 0) and chunks (place -1).

    Equal rows are counted before anything else, so that copies never come together; they are dealt out again by the chunk. A
    row's copies after the first, and rows whose role and text an earlier turn has, are duplicates. Rows of one turn follow
    each other by role and text.
    """
    # Keys of groups and joins are without nulls.
    said = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    keys = {"c": F.coalesce("conv", F.lit(0).cast(rows.schema["conv"].dataType)), "some": F.col("conv").isNotNull(), "t": F.coalesce("turn", F.lit(0).cast(rows.schema["turn"].dataType)), "timed": F.col("turn").isNotNull(), "said": said}
    rows = rows.withColumns(keys)
    each = rows.groupBy("c", "some", "timed", "t", "said").agg(F.first("role").alias("role"), F.first("text").alias("text"), F.sum("copies").alias("copies"))
    first = rows.groupBy("c", "some", "said").agg(F.min(F.struct("timed", "t")).alias("f")).select("c", "some", "f.timed", "f.t", "said", F.lit(True).alias("first"))
    marked = each.join(first, ["c", "some", "timed", "t", "said"], "left")
    mark = F.substring(F.rtrim("text", F.lit(" \t\n\x0b\f\r")), -1, 1)
    fault = F.when(mark == "", "blank").when(F.col("first").isNull(), "duplicate").when(~mark.isin(".", "!", "?"), "truncated")
    # Many copies go in pieces: of a later piece all rows are duplicates.
    marked = marked.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {chunk}"))))
    of_piece = F.least(F.lit(chunk), F.col("copies") - F.col("piece") * chunk).cast("long")
    fault = F.when((F.col("piece") > 0) & (mark != ""), "duplicate").otherwise(fault)
    marked = marked.select(F.when(F.col("some"), F.col("c")).alias("conv"), F.when(F.col("timed"), F.col("t")).alias("turn"), "role", "text", fault.alias("fault"), of_piece.alias("copies"), "piece")
    # Whole texts order rows of one turn, their beginnings the ranges: what is sampled stays small.
    front = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role")]
    placed = marked.repartitionByRange(*front, F.substring("text", 1, 64), "piece").sortWithinPartitions(*front, F.substring("text", 1, 64), "piece", "text")
    conv = rows.schema["conv"].dataType.simpleString()
    return materialise(map_arrow(placed.drop("piece"), partial(_chunks, chunk), FIELDS.format(conv)), "turns")


def _renew(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A fix-up pass: chunks whose end has a new vector run again from it."""
    machine = Machine()
    for batch in batches:
        columns = {name: batch.column(name).to_pylist() for name in batch.schema.names}
        begins, changed = [], []
        for initials, faults, begin, ended, after in zip(*(columns[c] for c in ("initials", "faults", "begin", "ended", "after")), strict=True):
            end = tuple(after)
            begins.append(begin if list(end) == ended else list(machine.begin(end, initials, faults)))
            changed.append(begins[-1] != begin)
        arrays = {**{n: batch.column(n) for n in batch.schema.names}, "begin": pa.array(begins, pa.list_(pa.int64())), "ended": batch.column("after"), "changed": pa.array(changed, pa.bool_())}
        yield pa.RecordBatch.from_arrays(list(arrays.values()), names=list(arrays))


def stitched(chunks: DataFrame) -> DataFrame:
    """Chunks (conv, g, initials, faults, begin, ended, ...) with the true vectors at their ends, but for a constant.

    Chunks that are the last of their conversation end in the cost of the end. The others speculated and take their
    neighbour's vector; a pass that changes no beginning is the last.
    """
    names, fields = chunks.columns, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema.fields)
    while True:
        after = chunks.select((F.col("g") - 1).alias("g"), F.col("conv").alias("of"), F.col("begin").alias("after"))
        joined = chunks.drop("changed").join(after, "g", "left")
        own = F.coalesce(F.col("of").eqNullSafe(F.col("conv")) & F.col("after").isNotNull(), F.lit(False))
        joined = joined.withColumn("after", F.when(own, F.col("after")).otherwise(F.array(*[F.lit(x).cast("long") for x in END]))).drop("of")
        chunks = materialise(map_arrow(joined.select(*names, "after"), _renew, f"{fields}, after array<bigint>, changed boolean").drop("after"), "stitch")
        if chunks.where("changed").isEmpty():
            return chunks.drop("changed")


def _traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    machine = Machine()
    for batch in batches:
        found = []
        for initials, faults, ended, first, last in zip(*(batch.column(c).to_pylist() for c in ("initials", "faults", "ended", "first", "last")), strict=True):
            vectors = machine.vectors(tuple(ended), initials, faults)
            # A chunk that begins a conversation is entered in one state only.
            found.append([machine.trace(s, vectors, initials, faults, last) if s == START or not first else None for s in range(4)])
        columns = [batch.column(c) for c in ("conv", "g", "first", "last")]
        each = [pa.array([[x[k] if x else None for x in f] for f in found], pa.list_(kind)) for k, kind in enumerate((pa.string(), pa.int64(), pa.int32()))]
        yield pa.RecordBatch.from_arrays([*columns, *each], names=["conv", "g", "first", "last", "audits", "costs", "exits"])


def entered(traced: DataFrame, most: int) -> DataFrame:
    """g and the state in which each chunk is entered. `exits` of the chunks before it are composed, twice as many at each
    step; a conversation's first chunk is entered at the start."""
    # exits[s]: the state after this chunk (and those before it, as far as composed) if it is entered in s.
    maps = traced.where("NOT last").select("g", "first", F.col("exits").alias("to"), F.col("first").alias("whole"))
    step = 1
    while step < most:
        back = maps.select((F.col("g") + step).alias("g"), F.col("to").alias("back"), F.col("whole").alias("back_whole"))
        joined = maps.join(back, "g", "left")
        composed = F.transform("back", lambda s: F.when(s.isNotNull(), F.get(F.col("to"), s)))
        new = F.when(F.col("whole"), F.col("to")).otherwise(composed)
        maps = materialise(joined.select("g", "first", new.alias("to"), (F.col("whole") | F.coalesce("back_whole", F.lit(False))).alias("whole")), "maps")
        step *= 2
    return maps.select((F.col("g") + 1).alias("g"), F.get("to", F.lit(START)).alias("entry"))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's repaired text, from rows in order; a chunk's audit comes before its rows."""
    kind = None

    def rows_of() -> Iterator[tuple]:
        nonlocal kind
        for batch in batches:
            kind = batch.schema.field("conv").type
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    def of(key: tuple, rows: Iterator[tuple]) -> pa.RecordBatch:
        sha, state, edits_, begun = hashlib.sha256(), START, iter(""), False

        def add(role: str, text: str) -> None:
            nonlocal begun
            sha.update((("\n" if begun else "") + f"{role}:{text}").encode())
            begun = True

        def insert(letter: str) -> str:
            nonlocal state
            while letter == "I":
                state = NEXT[state]
                add(ROLE_OF[state], "")
                letter = next(edits_, "")
            return letter

        for _, _, place, role, text, audit in rows:
            if place < 0:
                insert(next(edits_, ""))
                edits_ = iter(audit)
                continue
            letter = insert(next(edits_))
            if letter == "K":
                state = LEADS[role[:1]][state]
                add(role, text)
            elif letter == "R":
                state = NEXT[state]
                add(ROLE_OF[state], text)
        insert(next(edits_, ""))
        return pa.RecordBatch.from_arrays([pa.array([key], kind), pa.array([sha.hexdigest()])], names=["conv", "repaired_sha256"])

    for key, rows in groupby(rows_of(), key=lambda r: r[0]):
        yield of(key, rows)


def traced_chunks(turns: DataFrame) -> DataFrame:
    """Chunks of an ordered table with the audit that holds: conv, g, part, chunk, audit, cost and their sums."""
    chunks = turns.where("place = -1").drop("place", "role", "text")
    # Chunks are numbered over all partitions: a conversation's lie side by side.
    by = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    starts = chunks.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(by), F.lit(0)).alias("start"))
    chunks = materialise(chunks.join(F.broadcast(starts), "part").withColumn("g", F.col("start") + F.col("chunk")).drop("start"), "chunks")
    beside = lambda d, name: chunks.select((F.col("g") + d).alias("g"), F.col("conv").alias(f"{name}_of"), F.substr("initials", F.lit(1), F.lit(1)).alias(f"{name}_initial"), F.col("first_turn").alias(f"{name}_turn"))
    both = chunks.join(beside(1, "before"), "g", "left").join(beside(-1, "next"), "g", "left")
    same = lambda name: F.col(f"{name}_initial").isNotNull() & F.col(f"{name}_of").eqNullSafe(F.col("conv"))
    end = F.substr("initials", F.lit(-1), F.lit(1))
    seam = same("next") & ~F.concat(end, F.col("next_initial")).isin("su", "ua", "au")
    again = same("next") & (F.col("next_turn") == F.col("last_turn"))
    both = both.select("conv", "g", "part", "chunk", "initials", "faults", "begin", "ended", (~same("before")).alias("first"), (~same("next")).alias("last"), "blank", "duplicate", "truncated",
                       (F.col("illegal") + seam.cast("long")).alias("illegal"), "first_turn", "last_turn", (F.col("n_turns") - F.coalesce(again, F.lit(False)).cast("long")).alias("n_turns"))
    chunks = materialise(both, "beside")
    most = chunks.where("NOT (first AND last)").groupBy("conv").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    true = stitched(chunks) if most > 1 else chunks
    conv = chunks.schema["conv"].dataType.simpleString()
    traced = map_arrow(true.select("conv", "g", "initials", "faults", "ended", "first", "last"), _traced, f"conv {conv}, g bigint, first boolean, last boolean, audits array<string>, costs array<bigint>, exits array<int>")
    traced = materialise(traced, "traced")
    out = true.drop("initials", "faults", "begin", "ended", "first", "last").join(traced.select("g", "first", "audits", "costs"), "g")
    out = out.join(entered(traced, most), "g", "left") if most > 1 else out.withColumn("entry", F.lit(START))
    state = F.when(F.col("first"), F.lit(START)).otherwise(F.col("entry"))
    return out.withColumn("audit", F.get("audits", state)).withColumn("cost", F.get("costs", state)).drop("audits", "costs", "entry", "first")


def repaired(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row per conversation of rows (conv, turn, role, text, copies): conv, gaps, blank, duplicate, truncated, illegal,
    cost, audit, repaired_sha256."""
    turns = ordered(rows, chunk)
    chunks = materialise(traced_chunks(turns), "audits")
    # Blanks have no place among turns; the gaps are between the least and the greatest.
    sums = chunks.groupBy("conv").agg((F.max("last_turn") - F.min("first_turn") + 1 - F.sum("n_turns")).alias("gaps"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")], F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("g", "audit"))), lambda x: x["audit"]), "").alias("audit"))
    none = F.lit(None).cast("string")
    stream = turns.where("place >= 0").join(F.broadcast(_starts(chunks)), "part").select("conv", (F.col("chunk") + F.col("start")).alias("g"), "place", "role", "text", none.alias("audit"))
    stream = stream.unionByName(chunks.select("conv", "g", F.lit(-1).cast("long").alias("place"), none.alias("role"), none.alias("text"), "audit"))
    conv = rows.schema["conv"].dataType.simpleString()
    hashed = map_arrow(stream.repartition("conv").sortWithinPartitions("conv", "g", "place"), _hashed, f"conv {conv}, repaired_sha256 string")
    return sums.join(hashed.withColumnRenamed("conv", "of"), F.col("conv").eqNullSafe(F.col("of"))).drop("of").withColumn("gaps", F.coalesce("gaps", F.lit(0)).cast("long"))


def _starts(chunks: DataFrame) -> DataFrame:
    """The number of each partition's first chunk: one row for each partition."""
    return chunks.groupBy("part").agg(F.min(F.col("g") - F.col("chunk")).alias("start"))


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows are damaged first (`damaged`) and taken by turn, nulls first, rows of one turn by role and text. A null id is a
    conversation of its own; a null role or text is one space. Conversations of which no row is left have zeros, an empty
    audit and the hash of the empty text. Repeated rows are duplicates. Empty tables give no rows; other columns are ignored.
    """
    out = repaired(damaged(rows, conv, turn, role, text), chunk)
    every = rows.select(F.col(conv).alias("id")).distinct()
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.join(out, F.col("id").eqNullSafe(F.col("conv")), "left").select(F.col("id").alias(conv), *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
