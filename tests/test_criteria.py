"""Rewrites until stable, consolidation and polishing against plain Python loops."""

import re

import pytest
from pyspark.sql import functions as F

from sievecraft.catalog import rewriting
from sievecraft.functions import dimensions as d
from sievecraft.functions import surface as sf
from sievecraft.functions import tasks
from sievecraft.operators import criteria as cr

I = re.IGNORECASE  # noqa: E741


def tidy(x):
    x = re.sub(r"\s+", " ", x).strip(" \t\r\n\"'")
    for pattern, fixed in tasks.SENTENCE_FIXES:
        x = re.sub(pattern, fixed, x, flags=I)
    x = x.rstrip(".;?")
    return x and x + "."


def chain(x, rules):
    for pattern, form in rules:
        x = re.sub(pattern, form, x, flags=I)
    return x


def acts(x):
    return re.match(rf"^({d.ACTIONS})\b", x)


def verbal(x, kind):
    if x.lower().startswith(tasks.VERB_STARTS):
        return x
    return f"{tasks.TASK_VERBS.get(kind, tasks.TASK_VERBS[''])} {x[:1].lower()}{x[1:]}"


def unlabelled(x):
    m = re.match(tasks.LABEL, x)
    return m.group(1).strip() if m else x


def stated(x):
    x = unlabelled(tidy(x))
    bare = x.rstrip(".").rstrip("?").strip()
    for pattern, form in tasks.QUESTION_RULES:
        if re.match(pattern, bare, I):
            return tidy(tidy(re.sub(pattern, form, bare, flags=I)))
    return tidy(x)


def imperative(x, kind):
    x = tidy(chain(tidy(unlabelled(x)), sf.OPENINGS))
    return tidy(x if acts(x) else verbal(x, kind))


def surface(x):
    if not tidy(x):
        return ""
    x, was = chain(tidy(x), sf.SHELLS), None
    while x != was:
        was, x = x, tidy(chain(x, sf.ROUND))
    x = tidy(chain(x, sf.REST))
    return tidy(x if not x or acts(x) else verbal(x, "general_task"))


def words(x):
    return [w for w in re.findall(r"[a-zA-Z0-9_]+", x.lower()) if w not in sf.TASK_STOP]


def poor(x):
    x = tidy(x)
    return not x or bool(re.search(sf.BAD_SURFACE, x, I) or re.search(sf.BAD_GRAMMAR, x, I) or re.match("[a-z]", x))


def bad_prefix(x):
    return bool(re.search(sf.BAD_PREFIX, x, I) or re.search(sf.ASKS, x, I))


def worn(x):
    return bool(re.search("|".join(f"(?:{p})" for p in sf.GENERIC), x, I))


def generic(x, terms):
    return bool(re.search(sf.ALWAYS_GENERIC, x, I)) or (worn(x) and not set(words(x)) & terms)


def score(x, terms):
    own = words(x)
    out = min(len(own), 28) / 20 + min(len(set(own) & terms), 6) * 1.2
    out += 2 * bool(acts(x)) - 6 * bad_prefix(x) - 4 * poor(x) - 5 * (worn(x) and not set(own) & terms) - 0.2 * bool(re.search(sf.SOURCES, x, I))
    return out + sum(m.lower() in x.lower() for m in sf.MARKERS)


def key(x, kind):
    x = re.sub(rf"\b({d.STOP}|{d.MORE_STOP})\b", " ", x.lower())
    x = re.sub(r"\s+", " ", re.sub("[^a-z0-9一-鿿]+", " ", x)).strip()
    for name, some in (*d.GENERAL, *d.OF_TASK.get(kind, ())):
        if any(w in x for w in some):
            return name
    return x


def cosine(a, b):
    from collections import Counter

    a, b = (Counter(re.findall(r"[a-zA-Z0-9_一-鿿]+", x.lower())) for x in (a, b))
    norm = (sum(v * v for v in a.values()) * sum(v * v for v in b.values())) ** 0.5
    return sum(v * b[k] for k, v in a.items()) / norm if norm else 0.0


def limited(items, terms):
    named = [x for x in items if re.search(sf.SOURCES, x, I)]
    return [x for x in items if x not in named] + [max(named, key=lambda x: score(x, terms))] if named else items


def consolidated(items, task, kind):
    least, most, tau = cr.BOUNDS[kind]
    terms = {w for w in words(task) if len(w) >= 3 or w.isdigit()}
    rows = [surface(imperative(stated(x), kind)) for x in items]
    rows += [x for kinds, sources, groups, added in sf.ADDED if (not kinds or kind in kinds) and not sources and all(any(w in task.lower() for w in g) for g in groups) for x in added]
    best = {}
    for x in [tidy(surface(x)) for x in rows if tidy(x) and not poor(tidy(surface(x)))]:
        x = surface(imperative(x, kind) if bad_prefix(x) else x)
        if not poor(x) and not generic(x, terms):
            k = key(x, kind)
            if k not in best or score(x, terms) > score(best[k], terms):
                best[k] = x
    ranked = limited(sorted(best.values(), key=lambda x: -score(x, terms)), terms)
    kept = []
    for x in ranked:
        if all(cosine(x, y) < tau for y in kept):
            kept.append(x)
    final = limited(kept, terms)[:most]
    for x in ranked:
        if len(final) >= least:
            break
        if x not in final:
            final.append(x)
    out = [surface(imperative(x, kind)) for x in final]
    return [x for x in out if not poor(x)]


BODIES = ("names the exact year of the old bridge", "the river bank and its mouth", "code for the parser", "cites an official source on the bridge", "uses evidence from the river", "lists the steps in order", "the old bridge names the exact year", "avoids unrelated things", "is comprehensive about rivers", "a short tale of winter", "a short tale of winters", "")


def test_consolidation(spark):
    kinds = ("simple_fact_qa", "code_generation", "general_task", "math_problem", "safety_refusal", "ambiguous_fact_qa")
    items, records, want = [], [], []
    for rec in range(36):
        task, kind = ("Tell me about the old river bridge.", "Write fibfib code", "")[rec % 3], kinds[rec % 6]
        own = [rewriting.SHELLS[(rec * 5 + k) % len(rewriting.SHELLS)] + BODIES[(rec + k * 3 + k // 4) % len(BODIES)] for k in range(rec % 12)]
        items += [(rec, k, x) for k, x in enumerate(own)]
        records.append((rec, task, "pool", kind))
        want += [(rec, k, x) for k, x in enumerate(consolidated(own, task, kind), 1)]
    out = cr.consolidate_criteria(spark.createDataFrame(items, "rec int, i int, item string"), spark.createDataFrame(records, "rec int, task string, source string, kind string"))
    assert sorted(map(tuple, out.collect())) == want and len(want) > 60


def test_surface_is_stable(spark):
    texts = [a + b for a in rewriting.SHELLS for b in BODIES] + ["Provides satisfies a, provides satisfies b, provides describes it", "Provides provides describes x", "states is states if provides is it", "  ", "\"Provides fully satisfies the need, states clearly states it\""]
    rows = spark.createDataFrame([(x,) for x in texts] + [(None,)], "x string").select("x", sf.surface(F.col("x")).alias("y"), sf.imperative(F.col("x"), F.lit("math_problem")).alias("z"), sf.stated(F.col("x")).alias("s"))
    for x, y, z, s in rows.collect():
        assert (y, z, s) == ((None, None, None) if x is None else (surface(x), imperative(x, "math_problem"), stated(x))), x
    # A text in its last form is rewritten no further, and both ways of repeating agree.
    opened = rows.where("x IS NOT NULL").select(sf.unshelled(F.col("x")).alias("x"))
    stable = cr.until_stable(opened, "x", sf.one_round)
    assert stable.where(sf.one_round(F.col("result")) != F.col("result")).count() == 0 and stable.agg(F.max("rounds")).first()[0] >= 2
    assert stable.where(sf.settled(F.col("text")) != F.col("result")).count() == 0 and stable.count() == opened.distinct().count()
    assert cr.until_stable(opened.limit(0), "x", sf.one_round).count() == 0


def test_rewrites_that_never_end(spark):
    rows = spark.createDataFrame([("a",), ("b",), (None,)], "x string")
    turn = lambda x: F.translate(x, "ab", "ba")
    with pytest.raises(ValueError, match="2 texts still change after 3 rounds"):
        cr.until_stable(rows, "x", turn, most=3)
    grows = spark.createDataFrame([("states if " * 40 + "it",)], "x string")
    assert cr.until_stable(grows, "x", sf.one_round, most=64).count() == 1
    with pytest.raises(Exception, match="still changing after 1 rounds"):
        grows.select(sf.settled(F.col("x"), 1)).collect()


def test_counters_of_nothing(spark):
    none = spark.createDataFrame([], "rec int, place int, item string")
    (row,) = cr.corpus_counters(none, spark.createDataFrame([], "rec int, task string")).collect()
    assert row["total_items"] == 0 and row["generic_rate"] == 0


def test_statements_about_the_response(spark):
    """The examples say which rule is meant."""
    want = {
        "Completeness: covers both banks": "The response should covers both banks.",
        "Tone: Is the answer clearly polite?": "The response should clearly polite.",
        "The document clearly identifies the river": "The response should clearly identify the river.",
        "Offers a map": "The response should offer a map.",
        "If applicable, does the snippet cite it?": "If applicable, the response should cite it.",
        "when asked , does the text lie?": "When asked, the response should ensure that text lie.",
        "Is it complete?": "The response should be complete.",
        "Does each line include a number?": "Each line should include a number.",
        "Can it fail": "The response should ensure that it fail.",
        "Does not lie": "The response should not lie.",
        " ": "",
        "?": ".",
    }
    rows = spark.createDataFrame([(x,) for x in want], "x string").select("x", sf.asserted(sf.response_statement(F.col("x"))).alias("y"))
    assert {r["x"]: r["y"] for r in rows.collect()} == want
