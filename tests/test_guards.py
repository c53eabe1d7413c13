"""What is told before a pattern is sought changes no result."""

import random

from pyspark.sql import functions as F

from sievecraft.functions import surface as sf
from sievecraft.functions import tasks, text


def test_guards_change_no_text(spark):
    """What is told before a pattern is sought agrees with the pattern by itself, for odd blanks, letters and cases."""
    parts = ["should is", "SHOULD BE", "Does", ", and does  not", "　", " ", "  ", "\x1c", "ſhould", "Key", "İs", "satisfies the query", "stays focused", "CITE", "the document should ", "Provides", "x", "中", "é", "evidence", "search intent", ""]
    pick = random.Random(3)
    rows = spark.createDataFrame([(" ".join(pick.choice(parts) for _ in range(pick.randint(0, 6))),) for _ in range(600)] + [(None,)], "x string")
    x = F.col("x")
    ci = lambda p: x.rlike(f"(?i){p}")
    same = {
        "collapse": (text.collapse(x), F.regexp_replace(x, text.RUN, " ")),
        "tokens": (text.tokens(x), F.regexp_extract_all(F.lower(x), F.lit(text.TOKEN), F.lit(0))),
        **{f"rules {k}": (sf.replaced(x, rules, words), sf.replaced(x, rules)) for k, (rules, words) in enumerate(((sf.OPENINGS, sf.OPENING_WORDS), (sf.SHELLS, sf.SHELL_WORDS), (sf.REST, sf.REST_WORDS), (sf.WRITTEN_FIXES, tasks.FIXED_WORDS), (tasks.SENTENCE_FIXES, tasks.FIXED_WORDS)))},
        "poor": (sf.matches(x, sf.BAD_SURFACE, sf.SURFACE_WORDS), ci(sf.BAD_SURFACE)),
        "worn": (sf.is_worn(x), ci("|".join(f"(?:{p})" for p in sf.GENERIC))),
        "always": (sf.matches(x, sf.ALWAYS_GENERIC, sf.ALWAYS_WORDS), ci(sf.ALWAYS_GENERIC)),
        "sources": (sf.names_sources(x), ci(sf.SOURCES)),
    }
    for name, (a, b) in same.items():
        assert rows.where(~a.eqNullSafe(b)).count() == 0, name


def test_keys_are_made_once(spark):
    """A criterion's key, which all tests for a dimension read, and its words, which its score reads, stand once in the expression."""
    from sievecraft.functions.dimensions import MORE_STOP, STOP, dimension

    rows = spark.createDataFrame([("Names the source", ["names"])], "x string, terms array<string>")
    plan = lambda c: rows.select(c.alias("y"))._jdf.queryExecution().analyzed().toString()
    assert plan(dimension(F.col("x"), F.lit("general_task"))).count(f"{STOP}|{MORE_STOP}") == 1
    assert plan(sf.criterion_score(F.col("x"), F.col("terms"))).count("regexp_extract_all") == 1
