"""Dimensions of criteria by keywords, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievecraft.functions.tasks import holds_any
from sievecraft.functions.text import bound

#: Words that a key leaves out.
STOP = "the|a|an|answer|response|document|snippet|content|source|should|must|be"
MORE_STOP = "is|are|that|this"
#: Dimensions and their keywords in the order of the tests; first those of any task, then those of one kind.
GENERAL = (
    ("avoid_irrelevant_content", ("irrelevant", "unrelated", "off topic", "focused", "obscure")),
    ("source_support", ("source", "citation", "evidence", "official", "authoritative", "credible", "reference")),
    ("avoid_factual_confusion", ("misleading", "incorrect", "wrong", "confuse", "conflate")),
    ("disambiguation", ("ambigu", "similar name", "same name", "distinguish", "assumed")),
)
OF_TASK = {
    "code_generation": (
        ("code_signature", ("signature", "function", "method")),
        ("code_base_cases", ("base case", "n 0", "n 1", "n 2", "n < 3")),
        ("code_recurrence", ("recurrence", "recursive relation")),
        ("code_efficiency", ("efficient", "dynamic programming", "iterative", "exponential")),
        ("code_compilability", ("compile", "syntax", "undefined", "braces")),
        ("code_return_type", ("return type", "returns", "string", "i32", "integer")),
    ),
    "math_problem": (
        ("math_final_answer", ("final answer", "numerical answer")),
        ("math_coefficient_comparison", ("coefficient", "compare")),
        ("math_expansion_factorization", ("expand", "factorization", "factorisation")),
        ("math_verification", ("verify", "substitute")),
    ),
    "safety_refusal": (
        ("safety_refusal", ("refuse", "decline")),
        ("safety_hateful_content", ("propaganda", "supremacy", "racist", "racial")),
        ("safety_redirect", ("redirect", "alternative")),
    ),
}
#: Dimensions of written criteria, in the order of the tests.
WRITTEN = (
    ("evidence_support", ("authoritative", "credible", "citation", "evidence", "source")),
    ("factuality", ("misleading", "incorrect", "factual", "accurate", "false")),
    ("completeness", ("complete", "comprehensive", "omitting", "missing")),
    ("safety", ("safety", "risk", "harm", "medical", "professional care")),
    ("constraint_following", ("constraint", "instruction", "requirement")),
)
#: Verbs that begin a criterion, openings that it should not have.
ACTIONS = "States|Identifies|Provides|Implements|Handles|Avoids|Distinguishes|Uses|Computes|Begins|Refuses|Returns|Applies|Includes|Explains|Maintains|Supports|Shows|Preserves|Covers|Names|Clarifies|Mentions|Verifies|Produces|Counts|Answers|Describes|Lists|Presents|Focuses"
QUESTIONS = "Does|Is|Do|Are|Can|Should"


def surface_key(x: Column, stop: str = STOP) -> Column:
    """Small letters, digits and CJK in order, without words that carry nothing (plain words with | between them)."""
    # Most places are told by their letter alone, which is cheaper than a boundary; ASCII spelled out is looked up in a table.
    letters = "".join(sorted({word[0] for word in stop.split("|")}))
    bare = F.regexp_replace(F.lower(x), rf"(?=[{letters}])\b({stop})\b", " ")
    return F.trim(F.regexp_replace(bare, r"[^abcdefghijklmnopqrstuvwxyz0123456789\x{4e00}-\x{9fff}]+", " "))


def _first(key: Column, table: tuple) -> list[tuple[Column, str]]:
    return [(holds_any(key, words), name) for name, words in table]


def _case(tests: list[tuple[Column, str]]) -> Column:
    out = None
    for test, name in tests:
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("")


def dimension(x: Column, task_type: Column) -> Column:
    """The first dimension of which the text holds a keyword; empty without any."""
    return bound(surface_key(x, f"{STOP}|{MORE_STOP}"), lambda key: _case(_first(key, GENERAL) + [((task_type == kind) & test, name) for kind, table in OF_TASK.items() for test, name in _first(key, table)]))


def written_dimension(x: Column) -> Column:
    return bound(surface_key(x), lambda key: _case(_first(key, WRITTEN)))


def starts_with_action(x: Column) -> Column:
    return x.rlike(rf"^({ACTIONS})\b")


def like_a_question(x: Column) -> Column:
    """An opening that asks, or a question mark at the end."""
    return x.rlike(rf"(?i)^({QUESTIONS})\b") | F.rtrim(x).endswith("?")
