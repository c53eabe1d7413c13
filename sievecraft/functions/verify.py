"""Rule verifier and classifiers of criteria, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievecraft.functions.text import BULLET, bound, collapse, strip, tokens, unquote

#: Words that say nothing by themselves.
GENERIC_STANDALONE = ("accurate", "bad", "clear", "clarity", "complete", "concise", "correct", "detailed", "factual", "good", "helpful", "quality", "relevant", "safe", "useful")
#: Words that a validated record should not use.
GENERIC_TERMS = ("helpful", "clear", "clarity", "good", "bad", "quality", "accurate", "complete")
#: Categories in the order that breaks ties, and their keywords.
CATEGORIES = ("factuality", "completeness", "constraint_following", "safety", "domain_knowledge", "evidence_grounding", "intent_reasoning")
KEYWORDS = {
    "safety": ("safe", "safety", "harm", "illegal", "policy", "sexual", "adult", "minor", "unsafe", "violence", "安全", "风险", "违法", "未成年", "伤害"),
    "evidence_grounding": ("evidence", "citation", "cite", "source", "reference", "quote", "grounded", "based on", "支持", "引用", "证据", "来源", "依据"),
    "constraint_following": ("must", "should not", "format", "approximately", "word", "json", "bullet", "limit", "only", "avoid", "要求", "格式", "字数", "限制", "不能", "不得", "必须"),
    "domain_knowledge": ("code", "python", "java", "api", "protobuf", "excel", "model", "equation", "algorithm", "医学", "法律", "代码", "函数", "经纬度", "领域", "专业"),
    "intent_reasoning": ("intent", "infer", "reason", "because", "why", "clarify", "ambiguous", "causal", "step", "推理", "原因", "意图", "需求", "澄清", "歧义", "为什么"),
    "factuality": ("correct", "accurate", "true", "states that", "identify", "explains that", "指出", "准确", "正确", "事实", "说明", "明确"),
    "completeness": ("include", "cover", "address", "all", "multiple", "comprehensive", "完整", "覆盖", "包括", "全面", "多个"),
}

#: Words of an answer that refuses, and of an error on the way to one.
REFUSALS = ("safety", "refuse", "cannot comply", "can't comply", "unable to assist", "not able to help")
API_ERRORS = ("http", "timeout", "rate", "api", "urlerror", "connection", "server", "quota")


def normalize_rule_text(x: Column) -> Column:
    """Like cleaning an item, but white space is collapsed before the bullet goes."""
    return unquote(F.regexp_replace(collapse(strip(F.coalesce(x, F.lit("")))), BULLET, ""))


def verify_reason(x: Column, reject_generic: bool = False) -> Column:
    """The first rule that an item breaks, else rule_pass."""

    def rules(text: Column, low: Column, words: Column) -> Column:
        generic = F.arrays_overlap(words, F.array(*map(F.lit, GENERIC_STANDALONE)))
        meta = low.startswith("return ") | low.startswith("generate ") | low.contains("json list") | low.contains("candidate answer a") | low.contains("candidate answer b")
        out = F.when(text == "", "empty").when(F.size(words) < 3, "too_short").when((F.size(words) <= 4) & generic, "too_generic")
        if reject_generic:
            out = out.when(generic, "generic_term")
        return out.when(F.length(text) > 800, "too_long").when(meta, "meta_instruction").otherwise("rule_pass")

    return bound(normalize_rule_text(x), lambda text: bound(F.lower(text), lambda low: bound(tokens(text), lambda words: rules(text, low, words))))


def classify_category(x: Column) -> Column:
    """The category with the most keywords inside the text; ties go to the first, none to completeness."""
    low = F.lower(x)
    found = F.array(*[F.struct(F.size(F.filter(F.array(*map(F.lit, KEYWORDS[c])), lambda k: F.contains(low, k))).alias("score"), F.lit(-i).alias("rank"), F.lit(c).alias("name")) for i, c in enumerate(CATEGORIES)])
    best = F.array_max(found)
    return F.when(best["score"] > 0, best["name"]).otherwise("completeness")


def failure_class(error: Column, response: Column, has_items: Column) -> Column:
    """Why an output failed; the order of the tests counts."""
    error, response = F.lower(F.coalesce(error, F.lit(""))), F.lower(F.coalesce(response, F.lit("")))
    both = F.concat(error, F.lit("\n"), response)

    def holds(x: Column, terms: tuple[str, ...]) -> Column:
        return F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(x, t))

    refusal = holds(both, REFUSALS)
    api = holds(error, API_ERRORS)
    return F.when(refusal, "safety_refusal").when(api, "api_error").when((response == "") & ~has_items, "empty_output").when((response != "") & ~has_items, "parse_failure").otherwise("other_failure")
