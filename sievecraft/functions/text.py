"""Scalar functions over criteria texts, as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's `\\s` knows it, spelled out so that every regex engine agrees.
WS = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{0085}\x{1C}-\x{1F}]"
WS_CHARS = " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Runs that are not one blank already.
RUN = rf"{WS}{{2,}}|[\t\n\x0B\f\r\x{{00A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}\x{{0085}}\x{{1C}}-\x{{1F}}]"
BULLET = rf"^(?:[-*•]|[0-9]+[.)]|[a-zA-Z][.)]){WS}+"
TOKEN = r"[a-zA-Z0-9_\x{4e00}-\x{9fff}]+"
#: Tokens of small letters, ASCII spelled out, which Java looks up in a table; and what a text has where runs need to be looked for.
LOW_TOKEN = r"[0123456789_abcdefghijklmnopqrstuvwxyz\x{4e00}-\x{9fff}]+"
SIGNS = ("  ", *(c for c in WS_CHARS if c != " "))
QUOTES = "^[ \\t\\r\\n\"']+|[ \\t\\r\\n\"']+$"
#: Fields of a JSON object that may hold its list of items, and the text of one item.
LIST_FIELDS = ("gold_rubrics", "gold", "rubrics", "criteria", "items", "rubric_list", "dimensions")
TEXT_FIELDS = ("criterion", "criteria", "description", "text", "content")
#: Words of a flag.
TRUE_WORDS, FALSE_WORDS = ("1", "true", "yes", "y", "correct", "pass", "passed"), ("0", "false", "no", "n", "incorrect", "fail", "failed")


def bound(x: Column, use: Callable[[Column], Column]) -> Column:
    """use(x) with x evaluated once per row, however often it stands in the result."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def strip(x: Column) -> Column:
    return F.btrim(x, F.lit(WS_CHARS))


def holds(x: Column, parts: tuple[str, ...]) -> Column:
    """Whether a text, which stands in the result several times, contains one of the parts."""
    return reduce(or_, [F.contains(x, F.lit(p)) for p in parts])


def collapse(x: Column) -> Column:
    """Every run of white space as one blank. Most texts have none, which is told much faster than a pattern is sought."""
    return bound(x, lambda v: F.when(holds(v, SIGNS), F.regexp_replace(v, RUN, " ")).otherwise(v))


def unquote(x: Column) -> Column:
    """Without quotes and blanks at both ends."""
    return F.btrim(x, F.lit(" \t\r\n\"'"))


def clean_item(x: Column) -> Column:
    """An item without bullet, outer quotes and extra white space."""
    return unquote(collapse(F.regexp_replace(strip(x), BULLET, "")))


def item_key(x: Column) -> Column:
    """Key under which cleaned items are equal."""
    return collapse(F.lower(x))


def join_key(x: Column) -> Column:
    """Case-preserving key of the occurrence join; null counts as empty."""
    return strip(collapse(F.coalesce(x, F.lit(""))))


def query_key(x: Column) -> Column:
    """Case-folding key of contamination checks."""
    return collapse(F.lower(strip(F.coalesce(x, F.lit("")))))


def tokens(x: Column) -> Column:
    return F.regexp_extract_all(F.lower(x), F.lit(LOW_TOKEN), F.lit(0))


def lines(x: Column) -> Column:
    return F.split(F.coalesce(x, F.lit("")), "\n")


def bullet_items(x: Column) -> Column:
    """Texts of the lines that are bullets or numbered."""
    marked = F.filter(F.transform(lines(x), strip), lambda s: s.rlike(BULLET))
    return F.transform(marked, lambda s: strip(F.regexp_replace(s, BULLET, "")))


def json_items(x: Column) -> Column:
    """Items of a JSON list of strings or of objects with a text field, or of an object that holds such a list;
    null for other texts."""
    s = strip(F.coalesce(x, F.lit("")))
    inside = F.when(s.rlike(r"^[\[{]"), s).when(s.rlike(r"(?is)```(?:json)?.*```"), strip(F.regexp_extract(s, r"(?is)```(?:json)?\s*(.*?)```", 1))).when(s.rlike(r"(?s)\[.*\]"), F.regexp_extract(s, r"(?s)(\[.*\])", 1)).when(s.rlike(r"(?s)\{.*\}"), F.regexp_extract(s, r"(?s)(\{.*\})", 1))
    whole = F.when(inside.rlike(r"(?s)^[\[{].*[\]}]$"), F.try_parse_json(inside))
    listed = F.coalesce(
        *[F.try_variant_get(whole, path, "array<variant>") for path in ("$", *(f"$.{k}" for k in LIST_FIELDS))],
    )
    one = F.coalesce(*[F.try_variant_get(whole, f"$.{k}", "string") for k in TEXT_FIELDS])

    def value(v: Column) -> Column:
        return F.coalesce(*[F.try_variant_get(v, f"$.{k}", "string") for k in TEXT_FIELDS], F.try_variant_get(v, "$", "string"))

    return F.coalesce(F.filter(F.transform(listed, value), lambda s: s.isNotNull()), F.when(one.isNotNull(), F.array(one)))


def parse_items(x: Column) -> Column:
    """Items of a text: of its JSON, else of its bullets, else its lines; cleaned, empty ones left out."""

    def cleaned(a: Column) -> Column:
        return F.filter(F.transform(a, clean_item), lambda s: s != "")

    found, bullets = cleaned(json_items(x)), cleaned(bullet_items(x))
    return F.when(F.size(found) > 0, found).when(F.size(bullets) > 0, bullets).otherwise(cleaned(lines(x)))


def dedupe_items(items: Column) -> Column:
    """First of items with equal keys, in order."""
    start = F.struct(F.array().cast("array<string>").alias("keys"), F.array().cast("array<string>").alias("items"))

    def add(acc: Column, x: Column) -> Column:
        new = F.struct(F.array_append(acc["keys"], item_key(x)).alias("keys"), F.array_append(acc["items"], x).alias("items"))
        return F.when(F.array_contains(acc["keys"], item_key(x)), acc).otherwise(new)

    return F.aggregate(items, start, add)["items"]


def estimate_tokens(x: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.length(x) / 3.5)).cast("long")


def rough_tokens(x: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(x) / 4)).cast("long")


def first_present(*columns: Column) -> Column:
    """First value that is neither null nor the empty string."""
    return F.coalesce(*[F.nullif(c.cast("string"), F.lit("")) for c in columns])


def parse_bool(x: Column) -> Column:
    """True, false or null by a wide vocabulary."""
    word = F.lower(strip(x.cast("string")))
    return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)


def parse_number(x: Column) -> Column:
    """A double, or null for what is no number; true and false are none."""
    word = F.lower(strip(x.cast("string")))
    return F.when(~word.isin("true", "false", "nan"), word.try_cast("double"))


def parse_score(x: Column) -> Column:
    """A score in [0, 1] from JSON, a number or a yes/no word."""
    word = F.lower(strip(x))
    number = F.coalesce(F.get_json_object(x, "$.score").try_cast("double"), word.try_cast("double"))
    return F.coalesce(F.when(number.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), number))), F.when(word.contains("yes") | word.contains("satisfied"), 1.0).when(word.contains("no"), 0.0), F.lit(0.0))


def safe_float(x: Column) -> Column:
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def stable_id(source: Column, query: Column, separator: str = ":") -> Column:
    """source and the beginning of the SHA-1 of both."""
    return F.concat(source, F.lit(separator), F.substr(F.sha1(F.concat(source, F.lit("\n"), query)), F.lit(1), F.lit(16)))


def short_example(x: Column, most: int = 160) -> Column:
    return F.when(F.length(x) > most, F.concat(F.substr(x, F.lit(1), F.lit(most - 3)), F.lit("..."))).otherwise(x)


def lower_first(x: Column) -> Column:
    return F.concat(F.lower(F.substr(x, F.lit(1), F.lit(1))), F.substr(x, F.lit(2), F.length(x)))


def normalize_label(x: Column) -> Column:
    return F.translate(F.lower(F.trim(x)), "- ", "__")


def hash_order(seed: int, key: Column) -> Column:
    """A 32-bit number that orders rows at random but reproducibly, in any engine with MD5."""
    return F.conv(F.substr(F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string"))), F.lit(1), F.lit(8)), 16, 10).cast("long")


def expand_items(items: Column, keep_blank: bool = False) -> Column:
    """Items in order, those that are themselves lists or objects of items replaced by what they hold.

    A list counts up to its last bracket. Blank items go; with `keep_blank` they stay, and a list that gives nothing up to
    its last bracket is read once more as a whole.
    """

    def one(x: Column) -> Column:
        t = strip(x)
        front = F.when(t.startswith("[") & t.contains("]"), parse_items(F.regexp_extract(t, r"(?s)^(\[.*\])", 1)))
        whole = F.when(t.rlike(r"^[\[{]" if keep_blank else r"^\{"), parse_items(t))
        holds = lambda a: (F.size(a) > 0) & (a != F.array(t))
        own = F.when((t == "") & ~F.lit(keep_blank), F.array().cast("array<string>")).otherwise(F.array(t))
        return F.when(F.coalesce(holds(front), F.lit(False)), front).when(F.coalesce(holds(whole), F.lit(False)), whole).otherwise(own)

    return F.flatten(F.transform(items, one))
