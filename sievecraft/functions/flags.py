"""Binary flags, loose numbers and verifier decisions, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievecraft.functions.text import bound, strip

#: Words of a binary flag, and the parts of a decision that must all hold.
YES, NO = ("1", "true", "yes", "valid"), ("0", "false", "no", "invalid")
DECISION_PARTS = ("valid", "atomic", "decidable", "relevant", "non_hallucinated")


def _word(x: Column) -> Column:
    return F.lower(strip(x.cast("string")))


def lenient_flag(x: Column) -> Column:
    """True for a yes word or the number one; false for everything else, null included."""
    return F.coalesce(_word(x).isin(*YES) | (_word(x).try_cast("double") == 1), F.lit(False))


def is_binary(x: Column) -> Column:
    return F.coalesce(_word(x).isin(*YES, *NO), F.lit(False))


def strict_flag(x: Column) -> Column:
    """True or false by the flag words; fails on anything else."""
    return F.when(_word(x).isin(*YES), True).when(_word(x).isin(*NO), False).otherwise(F.raise_error(F.concat(F.lit("not a binary flag: "), F.coalesce(x.cast("string"), F.lit("null")))).cast("boolean"))


def braces(x: Column) -> Column:
    """From the first brace to the last one; empty without both."""
    return F.regexp_extract(x, r"(?s)\{.*\}", 0)


def answered_flag(x: Column) -> Column:
    """The flag in a verifier's answer: the field `valid` of its JSON, else the words of a yes."""
    inside = F.try_variant_get(F.try_parse_json(braces(x)), "$.valid", "string")
    low = F.lower(F.coalesce(x, F.lit("")))
    said = F.when(low.contains("\"valid\": true") | low.contains("'valid': true"), True).when(low.contains("\"valid\": false") | low.contains("'valid': false"), False)
    return F.when(inside.isNotNull(), lenient_flag(inside)).otherwise(F.coalesce(said, strip(low).isin(*YES)))


def loose_number(x: Column) -> Column:
    """A double or null; true and false are one and zero."""
    word = _word(x)
    return F.when(word == "true", 1.0).when(word == "false", 0.0).otherwise(word.try_cast("double"))


def unit_count(x: Column) -> Column:
    """Entries of a JSON list, one for other texts, none for blank or missing ones."""
    size = F.size(F.try_variant_get(F.try_parse_json(x), "$", "array<variant>"))
    return F.when(strip(F.coalesce(x, F.lit(""))) == "", 0).when(size >= 0, size).otherwise(1).cast("long")


def difference(left: Column, right: Column) -> Column:
    """left - right with four decimals, empty where one is missing."""
    return F.coalesce(F.format_string("%.4f", left - right), F.lit(""))


def decision(answer: Column) -> Column:
    """Struct (valid, reason) of a verifier's JSON answer; valid only if all parts hold, and not without a JSON object."""

    def told(parsed: Column, holds: Column) -> Column:
        reason = F.nullif(F.try_variant_get(parsed, "$.reason", "string"), F.lit(""))
        bad = F.when(parsed.isNull(), "invalid_json_response").when(~F.schema_of_variant(parsed).startswith("OBJECT"), "non_object_response")
        return F.struct((bad.isNull() & holds).alias("valid"), F.coalesce(bad, reason, F.when(holds, "api_pass").otherwise("api_reject")).alias("reason"))

    def all_hold(parsed: Column) -> Column:
        holds = None
        for part in DECISION_PARTS:
            own = lenient_flag(F.try_variant_get(parsed, f"$.{part}", "string"))
            holds = own if holds is None else holds & own
        return holds

    parsed = F.try_parse_json(F.coalesce(F.nullif(braces(answer), F.lit("")), strip(answer)))
    return bound(parsed, lambda p: bound(all_hold(p), lambda h: told(p, h)))


def truthy(v: Column) -> Column:
    """Whether a VARIANT is more than null, false, zero or the empty text."""
    kind, word = F.schema_of_variant(v), F.try_variant_get(v, "$", "string")
    return F.coalesce(F.when(kind == "BOOLEAN", word == "true").when(kind == "STRING", word != "").when(kind == "VOID", F.lit(False)).otherwise(F.coalesce(word.try_cast("double") != 0, v.isNotNull())), F.lit(False))


def decisions(answer: Column, n: Column) -> Column:
    """Array of n structs (idx, valid, reason): a batch answer aligned by its idx fields; those left out are not valid.

    The answer is parsed once, and each of its rows looked at once for each idx.
    """

    def told(i: Column, bad: Column, own: Column) -> Column:
        parts = [bound(F.try_variant_get(own, f"$.{part}", "variant"), truthy) for part in DECISION_PARTS]
        holds = parts[0]
        for part in parts[1:]:
            holds = holds & part
        reason = F.nullif(F.try_variant_get(own, "$.reason", "string"), F.lit(""))
        return bound(F.coalesce(holds, F.lit(False)), lambda h: F.struct(i.alias("idx"), h.alias("valid"), F.when(bad, "invalid_json_response").otherwise(F.coalesce(reason, F.when(h, "api_pass").otherwise("api_reject"))).alias("reason")))

    def at(i: Column, bad: Column, rows: Column) -> Column:
        none = F.struct(i.alias("idx"), F.lit(False).alias("valid"), F.when(bad, "invalid_json_response").otherwise("missing_decision").alias("reason"))
        found = F.filter(rows, lambda v: F.try_variant_get(v, "$.idx", "int") == i)
        return bound(found, lambda own: F.when(F.size(own) == 0, none).otherwise(bound(F.get(own, F.size(own) - 1), lambda v: told(i, bad, v))))

    def aligned(parsed: Column) -> Column:
        rows = F.coalesce(F.try_variant_get(parsed, "$.rubrics", "array<variant>"), F.try_variant_get(parsed, "$", "array<variant>"), F.array().cast("array<variant>"))
        return bound(rows, lambda rs: F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda i: at(i, parsed.isNull(), rs)))

    parsed = F.try_parse_json(F.coalesce(F.nullif(braces(answer), F.lit("")), strip(answer)))
    return F.when(n > 0, bound(parsed, aligned)).otherwise(F.array().cast("array<struct<idx:int,valid:boolean,reason:string>>"))


def flag_issues(flags: Column, n_items: Column, source: Column) -> Column:
    """What is wrong with an array of flags beside n items: missing, another length, not binary, without a source."""
    found = F.array(F.when(F.size(flags) != n_items, "valid_flags_length_mismatch"), F.when(F.exists(flags, lambda f: ~is_binary(f)), "valid_flags_non_binary"), F.when(F.coalesce(source, F.lit("")) == "", "valid_flags_missing_source"))
    return F.when(flags.isNull(), F.array(F.lit("valid_flags_missing"))).otherwise(F.array_compact(found))
