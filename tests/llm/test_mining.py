"""Mixing, phrases and conversations: against brute force, the SQL, and with nulls, ties, repeats, hot groups and clashing names."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sievecraft.llm import conversations, mixing, phrases
from sievecraft.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["op11_mixing", "op12_phrases", "op13_conversations"])
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    out = QUERIES[name](spark, SF)
    found = con.execute(ORACLE_SQL[name])
    at = [[d[0] for d in found.description].index(c) for c in out.columns]
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(repr(tuple(r[i] for i in at)) for r in found.fetchall())


# Mixing


def levels(sizes, weights, share, most):
    """Targets by sharing out again and again what is above."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, left, free = dict.fromkeys(sizes, 0.0), share * sum(sizes.values()), set(sizes)
    while left > 1e-9 and free:
        total = sum(weight[s] for s in free)
        for s in free:
            target[s] += left * weight[s] / total
        left = sum(max(0.0, target[s] - most * sizes[s]) for s in free)
        for s in list(free):
            if target[s] >= most * sizes[s]:
                target[s] = most * sizes[s]
                free.discard(s)
    return target


MIX = "doc_id long, text string, source string, rank int, size int, of string, draw int"


def test_mix_by_hand(spark):
    rng = random.Random(1)
    rows = [(i if i % 9 else None, " ".join(["w"] * rng.randint(0, 30)) if i % 7 else None, rng.choice(["hot"] * 5 + [None, "", "b", "é", "z"]), 1, 2, "x", 3) for i in range(400)] + [(1, "same text here", "b", 1, 2, "x", 3)] * 40
    docs = spark.createDataFrame(rows, MIX).repartition(5)
    out = mixing.mix(docs).collect()
    sizes, own = collections.Counter(), collections.Counter()
    for _, t, s, *_ in rows:
        sizes[s] += len((t or "").split())
    want = levels(sizes, mixing.WEIGHTS, 1.5, 2)
    by = collections.defaultdict(list)
    for r in out:
        by[r["source_size"], round(r["target"], 6)].append(r)
        assert 0 <= r["taken"] <= 2 * r["size"]
        own[r["size"]] += 1
    assert len(out) == len(rows) and own == collections.Counter(len((t or "").split()) for _, t, *_ in rows)
    assert set(by) == {(sizes[s], round(want[s], 6)) for s in sizes}
    for (size, target), found in by.items():
        assert sum(r["size"] for r in found) == size and abs(sum(r["taken"] for r in found) - target) <= 0.5 + 1e-6
        # Whole epochs for all, and one document at most is cut.
        assert sum(r["taken"] % r["size"] > 0 for r in found if r["size"]) <= 1
    assert sorted(map(repr, out)) == sorted(map(repr, mixing.mix(docs.repartition(3)).collect()))
    text = mixing.mixed(docs)
    assert text.columns == ["doc_id", "epoch", "text"] and text.agg(F.sum(F.size(F.split(F.trim("text"), " ")))).first()[0] == sum(r["taken"] for r in out)
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mixed(docs.limit(0)).count() == 0
    assert [r["taken"] for r in mixing.mix(docs.where("text IS NULL")).collect()] == [0] * docs.where("text IS NULL").count()


# Phrases


def collocations_by_hand(rows, least, top, longest=5):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    n, f = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(low)):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    found = {key: v for key, v in f.items() if len(key[1]) > 1 and v >= least}
    inside = {(lang, w[i : i + m]) for (lang, w), v in found.items() for m in range(2, len(w)) for i in range(len(w) - m + 1) if 100 * v >= 100 * f[lang, w[i : i + m]]}
    out = collections.defaultdict(list)
    for (lang, w), a in found.items():
        if (lang, w) not in inside:
            score, k = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
            out[lang].append((-score, -a, " ".join(w).encode(), a, f[lang, w[:k]], f[lang, w[k:]], n[lang], score))
    return sorted((lang, i, x[2].decode(), *x[3:]) for lang, rows in out.items() for i, x in enumerate(sorted(rows)[:top], 1))


@pytest.fixture(scope="module")
def talk():
    rng = random.Random(5)
    words = ["the", "of", "A", "b", "ÉCOLE", "x|y", "don't", "new", "york", "city", "z", "\x00q"]
    rows = [("".join(rng.choice(words) + rng.choice([" ", "  ", "\t", " ", " ", " ", ". ", "\n"]) for _ in range(rng.randint(0, 60))), rng.choice(["en", "de", None, "und"])) for _ in range(300)]
    return rows + [("new york city hall", "en")] * 40 + [(None, "en"), ("", "fr"), ("...", "fr"), ("x" * 100_000 + " y", "en"), (" ", None)]


@pytest.mark.parametrize("bits", [32, 3])
def test_collocations(spark, talk, bits):
    """With three bits nearly all fingerprints collide, and the result is the same."""
    docs = spark.createDataFrame([(t, lang, 1, "k", "s") for t, lang in talk], "text string, lang string, a int, k string, slab string").repartition(3)
    out = phrases.collocations(docs, least=5, top=50, bits=bits)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, out.collect())) == collocations_by_hand(talk, 5, 50)
    assert phrases.collocations(docs.limit(0)).count() == 0


def test_words_that_share_a_hash():
    powers = phrases.Powers()
    text = b"one two one three two one"
    slab = phrases.Slab(np.frombuffer(text, np.uint8), np.array([len(text)]), ["en"], powers)
    ids, rep = slab.ids()
    assert len(rep) == 3 and ids[0] == ids[2] == ids[5] and ids[1] == ids[4]
    slab.words = np.zeros_like(slab.words)
    ids, rep = slab.ids()
    assert len(rep) == 3 and ids[0] == ids[2] == ids[5] and ids[1] == ids[4] and len({ids[0], ids[1], ids[3]}) == 3


def test_prefix_polynomials():
    """A hash is of the words alone, wherever they stand; neither blanks nor the text before them count."""
    powers = phrases.Powers()

    def hashes(text, lang="en"):
        data = np.frombuffer(text.encode(), np.uint8)
        return {n: h for n, _, h in phrases.Slab(data, np.array([len(data)]), [lang], powers).grams(3)}

    a, b = hashes("one two three"), hashes("zero. one  two\tthree four")
    assert a[3][0] in b[3] and a[2][0] in b[2] and a[2][0] != a[2][1] and a[1][0] not in hashes("one", "de")[1]
    assert len(hashes("one. two, three")[2]) == 0


# Conversations

BLANK = " \t\n\x0b\f\r"
NEXT = {"": "u", "s": "u", "a": "u", "u": "a"}


def repaired_by_hand(rows):
    """Forward search over all edits, the cheapest and then least audit for each state kept."""
    said = lambda v: " " if v is None else str(v)
    damaged = []
    for conv, turn, role, text in rows:
        k = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        role, text = said(role), said(text)
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        damaged += [(conv, turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted(((turn is not None, turn or 0, role.encode(), text.encode()), turn, role, text) for c, turn, role, text in damaged if c == conv)
        faults, seen = [], set()
        for _, _, role, text in own:
            mark = text.rstrip(BLANK)[-1:]
            faults.append("blank" if not mark else "duplicate" if (role, text) in seen else "truncated" if mark not in ".!?" else "")
            seen.add((role, text))

        def inserted(best):
            for _ in range(3):
                for s, (cost, audit, lines) in list(best.items()):
                    new = cost + 3, audit + "I", (*lines, {"u": "user:", "a": "assistant:"}[NEXT[s]])
                    if NEXT[s] not in best or new[:2] < best[NEXT[s]][:2]:
                        best[NEXT[s]] = new
            return best

        best = inserted({"": (0, "", ())})
        for (_, _, role, text), fault in zip(own, faults, strict=True):
            after = {}
            for s, (cost, audit, lines) in best.items():
                ways = [(s, 4, "D", ())]
                if fault not in ("blank", "duplicate"):
                    more, i = 3 * (fault == "truncated"), role[:1]
                    if (i == "s" and s == "") or (i in ("u", "a") and NEXT[s] == i):
                        ways.append((i, more, "K", (f"{role}:{text}",)))
                    ways.append((NEXT[s], more + 3, "R", ({"u": "user:", "a": "assistant:"}[NEXT[s]] + text,)))
                for to, c, letter, line in ways:
                    new = cost + c, audit + letter, lines + line
                    if to not in after or new[:2] < after[to][:2]:
                        after[to] = new
            best = inserted(after)
        cost, audit, lines = min((best[s] for s in ("", "a") if s in best), key=lambda x: x[:2])
        turns, initials = [r[1] for r in own if r[1] is not None], [r[2][:1] for r in own]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        out[conv] = gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return out


@pytest.fixture(scope="module")
def chats():
    rng = random.Random(3)
    texts, roles = ["Hi there.", "ok", "", "  ", None, "Yes! \n", "good? ", "x."], ["user", "assistant", "user", "assistant", "system", None, "", "tool"]
    rows = [(i if i % 50 else None, rng.choice([None, j, j, j, j // 2]), rng.choice(roles), rng.choice(texts)) for i in range(120) for j in range(rng.randint(1, 12))]
    # One conversation with a third of all rows, one of repeated rows, one that says the same at every turn.
    rows += [(-1, j, rng.choice(["user", "assistant", "system"]), f"t{rng.randint(0, 30)}" + rng.choice([".", ""])) for j in range(400)]
    return rows + [(-2, 0, "user", "Hi.")] * 30 + [(-3, j, "assistant", "same.") for j in range(60)]


@pytest.mark.parametrize("chunk", [4096, 5])
def test_conversations(spark, chats, chunk):
    """Chunks of five rows are entered, stitched and composed; the result is that of whole conversations."""
    rows = spark.createDataFrame([(*r, "x", 1) for r in chats], "conv_id long, turn long, role string, text string, g string, place int").repartition(5)
    out = conversations.repair(rows, chunk=chunk)
    assert {r[0]: tuple(r[1:]) for r in out.collect()} == repaired_by_hand(chats)
    assert out.columns[0] == "conv_id" and conversations.repair(rows.limit(0)).count() == 0


def test_conversation_without_rows(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    (row,) = conversations.repair(spark.createDataFrame([(gone, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string")).collect()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_long_text_and_text_keys(spark):
    rows = [("c", 7, "user", "long " * 200_000 + "."), ("c", 8, "assistant", "Yes."), ("d", None, None, None)]
    out = {r["conv_id"]: r for r in conversations.repair(spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")).collect()}
    assert {k: tuple(r[1:]) for k, r in out.items()} == repaired_by_hand(rows)
