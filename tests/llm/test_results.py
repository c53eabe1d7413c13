"""Every registered query of the subpackage against a plain re-computation."""

import hashlib
import math
import random
import re
import struct
import time
import zlib
from collections import Counter
from html import unescape

import brute
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from sievecraft.llm import html, minhash, packing, toxicity
from sievecraft.llm.queries import ORACLE_SQL, QUERIES, tokenizer_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def test_registered():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{k}" for k in range(1, 14)} and "pipeline" in entry.queries() and set(ORACLE_SQL) <= set(QUERIES)


def test_bpe_is_the_library(spark, texts):
    own = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    for r in QUERIES["op1_bpe"](spark, SF).collect():
        ids = own.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(own.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_of_odd_texts():
    import pyarrow as pa

    from sievecraft.llm.bpe import PairIndexBPE

    own, model = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json")), PairIndexBPE(tokenizer_path("byte_bpe_50k.json"))
    rng = random.Random(5)
    odd = ["".join(rng.choice("ab 'sé\n\t  <|>1!日́") for _ in range(rng.randint(0, 40))) for _ in range(500)] + ["<|endoftext|> a<|endoftext|>", "aaaaaaaaa", " \n  x"]
    values, lengths = model.encode_batch(pa.array(odd))
    at = 0
    for text, n in zip(odd, lengths.tolist(), strict=True):
        assert values[at : at + n].tolist() == own.encode(text, add_special_tokens=False).ids, text
        at += n


def test_line_dedup(spark, texts):
    want = brute.deduped_lines(list(texts.items()))
    for r in QUERIES["op3_line_dedup"](spark, SF).collect():
        text, again, gone = want[r["doc_id"]]
        assert (r["n_recurring"], r["n_dropped"], r["text_sha256"]) == (again, gone, hashlib.sha256(text.encode()).hexdigest())


def test_language_model(spark, texts):
    rows = {k: brute.WORD.findall(brute.lower(t)) + [""] for k, t in texts.items()}
    held = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k in rows}
    count = Counter(w for k, t in rows.items() if not held[k] for w in t)
    n, v, own, base = sum(count.values()), len(count), 0.0, 0.0
    for r in QUERIES["op4_language_model"](spark, SF).collect():
        t = rows[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(t), sum(w in count for w in t), n)
        assert abs(r["base_score"] - sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t)) < 1e-6
        own, base = own + r["score"] * held[r["doc_id"]], base + r["base_score"] * held[r["doc_id"]]
    assert own > base


def test_packing(spark, texts):
    own = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    ids = {k: own.encode(t, add_special_tokens=False).ids + [2] for k, t in texts.items()}
    seen, windows = {k: [] for k in ids}, {}
    for r in QUERIES["op5_packing"](spark, SF).collect():
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["doc_tokens"] == len(ids[r["doc_id"]]) and r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
        seen[r["doc_id"]].append((r["start"], r["length"]))
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for k, parts in seen.items():
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == len(ids[k])
    sizes = [sum(n for _, n in w) for w in windows.values()]
    assert all(n <= 4096 and n & (n - 1) == 0 for n in sizes)


def test_packing_tiers(spark, texts):
    assert [packing.tier_of(n) for n in (1, 256, 257, 600, 2048, 9000)] == [256, 256, 512, 1024, 2048, 4096]
    waiting = packing.Tiers()
    long = list(packing.cut_windows([9000, 3000, 100, 900, 700, 300, 200, 50], waiting))
    assert long == [(4096, [(0, 0, 4096)]), (4096, [(0, 4096, 4096)])]
    # 3000 opens a long window; the longest of shorter tiers that fit fill its gap.
    made = list(waiting.windows())
    assert made[0] == (4096, [(1, 0, 3000), (3, 0, 900), (6, 0, 196)]) or made[0][1][:2] == [(1, 0, 3000), (3, 0, 900)]
    made += list(waiting.rest())
    assert all(sum(n for _, _, n in pieces) == tier for tier, pieces in made) and sum(t for t, _ in long + made) == 14250
    # Tokens of a tier's step groups are equal but for the last one, over all partitions.
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    for slab in (20_000, 8 << 20):
        rows = packing.pack(docs, tokenizer_path("word_bpe_49k.json"), with_ids=False, slab=slab, step_tokens=16_384).collect()
        groups, own = Counter(), Counter()
        for r in rows:
            groups[r["tier"], r["step_group"]] += r["length"]
            own[packing.tier_of(r["length"])] += 1
        last = {t: max(g for u, g in groups if u == t) for t, _ in groups}
        assert all(n == 16_384 for (t, g), n in groups.items() if g < last[t])
        shares = Counter()
        for (t, _), n in groups.items():
            shares[t] += n
        # Every tier has windows; those below the shortest only hold what is over at the end of a partition.
        assert all(shares[t] for t in (4096, 2048, 1024, 512, 256)) and sum(n for t, n in shares.items() if t < 256) <= 4 * 256


def test_html(spark):
    page = "<html><head><title>T</title><script>if (a < b) '<p>'</script></head><body><header>Site name</header><nav><a href=/>home</a></nav><div class='cookie-notice'>We use cookies.</div><article><h1>Head</h1><p>First &eacute; <b>bold\n text</b>.<p>Second.<form>Sign up</form><div class=comments><p>I disagree.</p></div></article><aside>More</aside><footer>&copy;</footer></body></html>"
    assert [r["text"] for r in html.extract(spark.createDataFrame([(1, page)], "page_id long, html string")).collect()] == ["Head\nFirst é bold text.\nSecond."]
    # The given pages: what their articles hold, by a plain cut.
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    out = QUERIES["op6_html"](spark, SF).collect()
    assert len(out) == len(pages)
    for r in out:
        inside = re.search(r"(?s)<article>(.*?)</article>", pages[r["page_id"]])[1]
        parts = [" ".join(unescape(re.sub(r"<[^>]*>", " " if re.match("<br", x) else "", x)).split()) for x in re.split(r"</?(?:p|h1|li|ul)>", inside.replace("<br>", "\n").replace("<b>", "").replace("</b>", ""))]
        assert r["text"] == "\n".join(x for x in parts if x) and r["n_chars"] == len(r["text"])


_P = "The quick brown fox jumps over the lazy dog near an old river bank, and nobody in the village had seen it before that day."
LABELLED = [
    (f"<article class='has-comments'><p>{_P}</p></article>", [_P]),
    (f"<div class='post-with-sidebar'><p>{_P}</p></div>", [_P]),
    (f"<datalist><option value=a>A<option value=b>B</datalist><article><h1>Old bank</h1><p>{_P}</article>", ["Old bank", _P]),
    (f"<div>Villages</div><div><h1>Four words are here</h1><p>{_P}</p><p>Yes.</p><p>{_P}</p></div><div>Copyright 2020 Acme Ltd</div>", ["Villages", "Four words are here", _P, "Yes.", _P]),
    (f"<form><main><p>{_P}</p><p>ok.</p></main></form>", [_P, "ok."]),
    (f"<body class='page-header-fixed'><div class='article-header'><h1>Old bank</h1></div><div class='article-body'><p>{_P}</p></div><div id=sidebar><p>{_P}</p></div></body>", ["Old bank", _P]),
    (f"<div><ul><li><a href=/a>one</a><li><a href=/b>two</a></ul></div><div>Top stories</div><div><ul><li><a href=/c>three</a></ul></div><div><p>{_P}</p><p>{_P}</p></div>", [_P, _P]),
    (f"<article><p>{_P}</p></article><section id=comments><article><p>{_P}</p></article></section>", [_P]),
    (f"<svg><text>logo</text><p>{_P}</p><p>{_P}</p>", [_P, _P]),
    (f"<article><p>{_P}<table><tr><td>left<td>right</table></article><aside><p>{_P}</aside>", [_P, "left", "right"]),
    *[(f"<div {name}><p>{_P}</p><p>{_P} {_P}</p></div>", [_P, f"{_P} {_P}"]) for name in ("class=social-studies", "class=legal-news", "class=tags-article", "id=search-content")],
    *[(f"<div class={name}><p>{_P}</p><p>{_P}</p></div><article><p>{_P}</p></article>", [_P]) for name in ("sidebar", "related-posts", "cookie-notice", "comment-body", "site-footer", "postSidebar")],
    *[(f"<body><{tag}>Menu<article><h1>Old bank</h1><p>{_P}</p></article></body>", ["Old bank", _P]) for tag in ("button", "audio src=x", "video", "canvas", "object data=x", "noscript")],
    (f"<article><p>{_P}</p><button><div>{_P}</div></button><video><p>{_P}</p></video><p>Yes.</p></article>", [_P, "Yes."]),
    (f"<article><p>a &lt; b &#233;&nbsp;c</p></article><noscript><p>{_P}</p></noscript><textarea>{_P}</textarea>", ["a < b é c"]),
]


def test_html_of_labelled_pages(spark):
    nodes = html.train(spark)
    # The tree asks for neighbours, not only for a block's own features.
    asked = {html.FEATURES[n[0]] for n in nodes if len(n) > 1}
    assert asked & {"words_before", "words_after"} and asked & {"links_before", "links_after"}, asked
    for page, want in LABELLED:
        assert [text for text, row in html.blocks(page) if html.keep(nodes, row)] == want, page


def test_html_of_long_broken_pages():
    """A megabyte of each piece, among them tags that never close and so lie as deep as there are of them."""
    pieces = '<a href="x |<a href=">" |<a href="x>y |<p|<!-- |<option>|<title>|<<|<div>|<button>x|<table><tr><td>|<ul><li>x|<audio src=x><p>y|<dl><dt>x<dd>|<p>x<b>|<article><p>x<section class=comments>|<a><h2>x|<button></button>x'
    for piece in pieces.split("|"):
        began = time.time()
        html.blocks(piece * (1_000_000 // len(piece)))
        assert time.time() - began < 20, piece


def test_fingerprint(spark, texts):
    order = sorted(texts)
    rows = {r["doc_id"]: r for r in QUERIES["op7_fingerprint"](spark, SF).collect()}
    for k, following in zip(order, order[1:] + order[:1], strict=True):
        t, half = texts[k], len(texts[k]) // 2
        edited = t[: len(t) - half] + texts[following][:half]
        assert rows[k]["n_chars"] == len(t) and rows[k]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
    alike = sum(r["near_edited"] > r["near_next"] for r in rows.values())
    assert alike > 0.9 * len(rows)


def test_deobfuscation(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(["you are an idiot and a moron, stupid clown"] * 30 + ["1d10t m0r0n $tupid cl0wn idiooot i.d.i.o.t", "such an i d i o t here"])], "doc_id long, text string")
    char = toxicity.char_counts(docs)
    out = {r["doc_id"]: r["restored"].split() for r in toxicity.restore(docs, char).collect()}
    assert out[30] == ["idiot", "moron", "stupid", "clown", "idiot", "idiot"] and "idiot" in out[31]


@pytest.mark.parametrize(("name", "label", "folds", "held", "least", "recall", "area"), [("op8_toxicity", "toxic", 4, 2, 0.9, 0.6, 0.78), ("op10_quality", "quality", 5, 0, 0.95, 0.9, 0.95)])
def test_held_out_accuracy(spark, name, label, folds, held, least, recall, area):
    """Accuracy, recall and the area under the curve on labels that were not learnt from."""
    sf = SF.replace("0.001", "0.01")
    labels = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in QUERIES[name](spark, sf).collect()]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % folds == held) and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    known = [r for r in rows if r["held_out"] and labels.get(r["doc_id"]) is not None]
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in known) >= least * len(known)
    yes, no = ([r for r in known if labels[r["doc_id"]] == y] for y in (1, 0))
    assert sum(r["predicted"] for r in yes) >= recall * len(yes)
    assert sum((a["score"] > b["score"]) + 0.5 * (a["score"] == b["score"]) for a in yes for b in no) >= area * len(yes) * len(no)


def family(seed: int) -> list[tuple[int, str]]:
    """Copies of one text with 0 to 12 words changed, chains of small edits, and unlike texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(120)]
    out = []
    for k in range(60):
        t = list(base)
        for _ in range(k % 13):
            t[rng.randrange(120)] = word()
        out.append(" ".join(t))
    chain = [word() for _ in range(60)]
    for _ in range(12):
        chain = list(chain)
        chain[rng.randrange(60)] = word()
        out.append(" ".join(chain))
    out += [" ".join(word() for _ in range(rng.randint(0, 40))) for _ in range(30)]
    out += ["same few words here"] * 5 + ["a b", "A  B", "", " "]
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("width", [4, 5])
def test_minhash_of_families(spark, width):
    rows = family(width)
    want = brute.near_components(rows, width, 80)
    for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width).collect():
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (*want[r["doc_id"]], want[r["doc_id"]][1] == r["doc_id"])


def test_minhash(spark, texts):
    want = brute.near_components(list(texts.items()), 4, 80)
    for r in QUERIES["op9_minhash"](spark, SF).collect():
        assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]


def test_pipeline(spark, texts):
    """Each stage keeps what its own decisions leave, and the rest follows from brute force."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [r.asDict() for r in docs.collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = spark.createDataFrame(kept, docs.schema)
        out = stage(spark, before, SF)
        assert out.columns == docs.columns
        after = [r.asDict() for r in out.collect()]
        have, left = {r["doc_id"]: r["text"] for r in kept}, {r["doc_id"] for r in after}
        if name == "exact_dedup":
            assert left == {max(k for k, t in have.items() if t == text) for text in have.values()}
        if name == "near_dedup":
            assert left == {c for _, c in brute.near_components(list(have.items()), 5, 80).values()}
        assert left <= set(have) and len(left) > 0.5 * len(have)
        kept = after
    pieces = corpus_pipeline.STAGES[-1][1](spark, spark.createDataFrame(kept, docs.schema), SF).collect()
    assert {p["doc_id"] for p in pieces} == {r["doc_id"] for r in kept}
    whole, parts = Counter(), Counter()
    for p in corpus_pipeline.run(spark, SF).collect():
        whole[p["doc_id"]] += p["length"]
    for p in pieces:
        parts[p["doc_id"]] += p["length"]
    assert whole == parts
