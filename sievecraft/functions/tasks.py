"""Kinds of tasks by keywords, and small rewrites of criteria, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievecraft.functions.text import bound, collapse, holds, lower_first, strip, tokens, unquote

#: Keyword lists of the task classifier, in the order of its tests.
MEDICAL = ("postpartum", "doctor", "medical", "symptom", "medication", "diagnosis", "therapy", "pain", "dose")
WRITING = ("write a story", "short story", "poem", "article", "essay", "outline", "draft", "撰写", "故事", "论文", "大纲")
CREATIVE = ("story", "poem", "故事", "诗")
UNSAFE = ("white supremacy", "meth", "weapon", "bomb", "kill", "harm", "illegal", "racist", "extremist")
CODE = ("```", " function ", " rust ", " python ", " java ", " javascript ", " typescript ", " golang ", " return type", " signature", " compile", " method ", "class ")
HISTORY = ("oldest", "first recording", "origin", "founded", "invented", "released", "when was")
AMBIGUOUS = ("which ", "where does", "mary river", "salem", "meaning of", "called", "who plays")
MATH_WORDS = r"\b(solve|equation|calculate|compute|factor|integer|probability|triangle|sum|polynomial)\b"
MATH_TERM = r"[0-9]+\s*[+\-*/=^]\s*[0-9]+"
SIGNATURE = r"\b[A-Za-z0-9_]+\s*\([^)]*\)\s*(?:->|:)"

#: Question patterns and what a statement makes of them, in the order of the tests; fixes of a sentence.
QUESTION_RULES = (
    (r"^Does\s+(?:the\s+)?(?:answer|response|model|assistant|document|snippet|content|source|explanation|information|it)\s+(.+)$", r"\1"),
    (r"^Is\s+(?:the\s+)?(?:answer|response|model|assistant|document|snippet|content|source|information|explanation|it)\s+(.+)$", r"is \1"),
    (r"^Are\s+(.+)$", r"\1 are satisfied"),
    (r"^Should\s+(?:the\s+)?(?:answer|response|model|assistant|it)\s+(.+)$", r"\1"),
    (r"^(?:If|When|For)\s+(.+?),\s+does\s+(?:the\s+)?(.+)$", r"\1, \2"),
    (r"^(?:To what extent|How well)\s+does\s+(?:the\s+)?(?:brief|writing|report|teaching plan|plan|article|document|script|response|answer|content|text)\s+(.+)$", r"\1"),
)
SENTENCE_FIXES = (
    (r"\bshould\s+is\b", "should be"),
    (r"\bshould\s+are\b", "should be"),
    (r"\bshould\s+does\b", "should"),
    (r"\bshould\s+has\b", "should have"),
    (r",\s+and\s+does\s+not\b", ", and should not"),
)
#: Words one of which every fix of a sentence needs.
FIXED_WORDS = ("should", "does")
LABEL = r"^[A-Z][A-Za-z/ -]{2,40}\s*:\s*(.+)$"
#: Beginnings that need no verb, and the verb of each kind of task (else the last).
VERB_STARTS = ("avoid", "refuse", "state", "identif", "provide", "use", "return", "handle", "compute", "implement", "explain", "distinguish", "include", "maintain", "appl", "answer", "describe", "list", "name", "present", "focus")
TASK_VERBS = {"code_generation": "Implements", "math_problem": "Shows", "safety_refusal": "Avoids", "simple_fact_qa": "States", "ambiguous_fact_qa": "States", "historical_uncertain_fact": "States", "": "Provides"}


def holds_any(x: Column, words: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(x, w))


def where_held(x: Column, words: tuple[str, ...], changed: Column) -> Column:
    """The changed text where x has one of the small words, of which every pattern of the change needs one; else x."""
    return F.when(bound(F.lower(x), lambda low: holds(low, words)), changed).otherwise(x)


def task_type(task: Column, source: Column) -> Column:
    """Kind of a task; the order of the tests counts."""
    low = F.lower(task)
    few = F.size(F.regexp_extract_all(low, F.lit("[a-z0-9_]+"), F.lit(0))) <= 12
    return (
        F.when((source == "healthbench") | holds_any(low, MEDICAL), "medical_advice")
        .when((source == "ifbench") | low.contains("keyword") | (low.contains("exactly") & low.contains("response")), "instruction_following")
        .when(((source == "writingbench") | holds_any(low, WRITING)) & holds_any(low, CREATIVE), "creative_writing")
        .when((source == "writingbench") | holds_any(low, WRITING), "writing_task")
        .when(holds_any(low, UNSAFE), "safety_refusal")
        .when(holds_any(F.concat(F.lit(" "), low, F.lit(" ")), CODE) | task.rlike(SIGNATURE), "code_generation")
        .when(low.rlike(MATH_WORDS) | low.rlike(MATH_TERM), "math_problem")
        .when(holds_any(low, HISTORY), "historical_uncertain_fact")
        .when(holds_any(low, AMBIGUOUS), "ambiguous_fact_qa")
        .when(source == "rewardbench_pref", "preference_judging")
        .when((source == "beir_nq") & few & low.rlike(r"^(who|what|when|where|which|how many|how old)\b"), "simple_fact_qa")
        .otherwise("general_task")
    )


def strip_label(x: Column) -> Column:
    """Without a short leading label and its colon."""
    return strip(F.regexp_replace(x, r"^[A-Z][A-Za-z /&-]{1,40}:\s+", ""))


def question_to_statement(x: Column) -> Column:
    """A yes/no question about the response as a statement; other texts stay."""
    bare = F.regexp_replace(strip(x), r"\?+$", "")
    return (
        F.when(bare.rlike(r"(?i)^does the (response|answer) "), F.regexp_replace(bare, r"(?i)^does the (response|answer) ", "The response should "))
        .when(bare.rlike(r"(?i)^is the (response|answer) "), F.regexp_replace(bare, r"(?i)^is the (response|answer) ", "The response should be "))
        .when(bare.rlike(r"(?i)^has the (response|answer) "), F.regexp_replace(bare, r"(?i)^has the (response|answer) ", "The response should have "))
        .otherwise(strip(x))
    )


def sentence(x: Column) -> Column:
    """One line with a capital first letter and a full stop at its end."""
    flat = strip(collapse(x))
    first = F.concat(F.upper(F.substr(flat, F.lit(1), F.lit(1))), F.substr(flat, F.lit(2), F.length(flat)))
    return F.when(flat == "", "").when(first.rlike(r"[.!?。！？]$"), first).otherwise(F.concat(F.regexp_replace(first, r"[,;:]+$", ""), F.lit(".")))


def declarative(x: Column) -> Column:
    return sentence(question_to_statement(strip_label(x)))


def content_key(x: Column, stop_words: tuple[str, ...] = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "in", "is", "of", "on", "or", "should", "that", "the", "to", "with")) -> Column:
    """Tokens that carry content, in order, joined by blanks."""
    return F.array_join(F.filter(tokens(x), lambda w: ~w.isin(*stop_words)), " ")


def tidy_sentence(x: Column) -> Column:
    """One line without outer quotes, with the fixes of a sentence and one full stop."""

    def fixed(v: Column) -> Column:
        out = v
        for pattern, form in SENTENCE_FIXES:
            out = F.regexp_replace(out, f"(?i){pattern}", form)
        return where_held(v, FIXED_WORDS, out)

    return bound(F.rtrim(bound(unquote(collapse(x)), fixed), F.lit(".;?")), lambda v: F.when(v == "", v).otherwise(F.concat(v, F.lit("."))))


def unlabelled(x: Column) -> Column:
    return F.when(x.rlike(LABEL), strip(F.regexp_extract(x, LABEL, 1))).otherwise(x)


def unquestioned(x: Column) -> Column:
    """A question of one of the patterns as a statement; other texts stay."""

    def stated(bare: Column) -> Column:
        out = None
        for pattern, form in QUESTION_RULES:
            made = tidy_sentence(F.regexp_replace(bare, f"(?i){pattern}", form.replace("\\", "$")))
            out = F.when(bare.rlike(f"(?i){pattern}"), made) if out is None else out.when(bare.rlike(f"(?i){pattern}"), made)
        return out.otherwise(x)

    return bound(strip(F.regexp_replace(F.regexp_replace(x, r"\.+$", ""), r"\?+$", "")), stated)


def statement(x: Column) -> Column:
    """A criterion without label and question form, as one tidy sentence."""
    return tidy_sentence(unquestioned(unlabelled(tidy_sentence(x))))


def with_verb(x: Column, task_type: Column) -> Column:
    """A criterion that begins with a verb: that of its kind of task where it has none of the known ones."""
    has = F.lower(x).rlike(f"^({'|'.join(VERB_STARTS)})")
    verb = F.lit(TASK_VERBS[""])
    for kind, word in TASK_VERBS.items():
        verb = F.when(task_type == kind, word).otherwise(verb) if kind else verb
    return F.when(has, x).otherwise(F.concat(verb, F.lit(" "), lower_first(x)))
