"""Raw records (VARIANT column `record`, place `pos`) to the canonical entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievecraft.functions.text import first_present, parse_items, strip
from sievecraft.sources.records import get_path

#: Fields under which a part of a record may stand, in the order they are tried.
QUERY = ("query", "prompt", "question", "instruction", "input")
GOLD = ("gold_rubrics", "rubrics", "criteria", "gold", "reference_rubrics")
CHOSEN, REJECTED = ("chosen", "response_chosen", "preferred", "winner"), ("rejected", "response_rejected", "dispreferred", "loser")
CANDIDATES, LABEL = ("candidates", "responses", "answers", "options"), ("label", "answer", "best", "target")
FIRST, SECOND = ("response_A", "response_a", "answer_a"), ("response_B", "response_b", "answer_b")
SOURCE = ("data_source", "source", "dataset")


def comparative_winner(label: Column) -> Column:
    """A or B by a label like A>B; null for ties and other labels."""
    word = F.upper(F.replace(F.coalesce(label, F.lit("")), F.lit(" "), F.lit("")))
    return F.when(word.isin("A>B", "A>>B", "A", "B<A", "MODEL_A"), "A").when(word.isin("B>A", "B>>A", "B", "A<B", "MODEL_B"), "B")


def candidate_texts(record: Column) -> Column:
    """Candidates as texts: those of a list (an object's text field) or, of an object, its values by key."""

    def text(v: Column) -> Column:
        return F.coalesce(*[F.try_variant_get(v, f"$.{k}", "string") for k in ("text", "response", "answer", "content", "value")], F.try_variant_get(v, "$", "string"))

    listed = F.coalesce(*[F.transform(F.try_variant_get(record, f"$.{k}", "array<variant>"), text) for k in CANDIDATES])
    named = F.coalesce(*[F.transform(F.array_sort(F.map_entries(F.try_variant_get(record, f"$.{k}", "map<string,string>"))), lambda e: e["value"]) for k in CANDIDATES])
    split = F.concat(F.slice(F.try_variant_get(record, "$.chosen", "array<string>"), 1, 1), F.try_variant_get(record, "$.rejected", "array<string>"))
    return F.filter(F.transform(F.coalesce(listed, named, split), strip), lambda s: s != "")


def label_index(value: Column, candidates: Column) -> Column:
    """Place of the right candidate: a number in range, else the first candidate equal to the text."""
    number = F.when(value.rlike("^[0-9]+$"), value.try_cast("int"))
    number = F.when(number < F.size(candidates), number)
    place = F.array_position(candidates, value).cast("int") - 1
    return F.coalesce(number, F.when(place >= 0, place))


#: What makes a row of each target usable.
USABLE = {
    "gold": lambda c: F.size(c["gold_rubrics"]) > 0,
    "query_pool": lambda c: F.lit(True),
    "preference": lambda c: c["chosen"].isNotNull() & c["rejected"].isNotNull(),
    "multicandidate": lambda c: (F.size(c["candidates"]) >= 2) & c["label"].isNotNull(),
}


def fields_of(r: Column, target: str) -> dict[str, Column]:
    """The target's own columns of a record."""
    if target == "gold":
        return {"gold_rubrics": parse_items(first_present(*[get_path(r, k) for k in GOLD]))}
    if target == "query_pool":
        return {}
    if target == "preference":
        won = comparative_winner(get_path(r, "preference", "winner", "label"))
        a, b = get_path(r, *FIRST), get_path(r, *SECOND)
        return {"chosen": F.coalesce(get_path(r, *CHOSEN), F.when(won == "A", a).when(won == "B", b)), "rejected": F.coalesce(get_path(r, *REJECTED), F.when(won == "A", b).when(won == "B", a))}
    if target == "multicandidate":
        candidates = candidate_texts(r)
        return {"candidates": candidates, "label": F.coalesce(label_index(get_path(r, *LABEL), candidates), F.when(F.try_variant_get(r, "$.chosen", "array<string>").isNotNull(), 0))}
    raise ValueError(f"unknown target {target}")


def _asked(records: DataFrame, source: str | None = None, dedupe: bool = True) -> DataFrame:
    """pos, query, data_source and record of records with a query; the first of a query."""
    r = F.col("record")
    rows = records.select("pos", strip(get_path(r, *QUERY)).alias("query"), F.coalesce(F.lit(source), get_path(r, *SOURCE), F.lit("unknown")).alias("data_source"), "record").where("query <> ''")
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("query").orderBy("pos"))).where("_n = 1").drop("_n") if dedupe else rows


def normalize(records: DataFrame, target: str, dedupe: bool = True, limit: int | None = None, source: str | None = None) -> DataFrame:
    """Rows of `target`: gold, query_pool, preference or multicandidate.

    The first row of a query stays, and is chosen before the target's own fields are looked at, so that an
    unusable first copy hides later ones. Rows that lack a field of the target are left out.
    """
    fields = fields_of(F.col("record"), target)
    rows = _asked(records, source, dedupe).withColumns(fields).where(USABLE[target]({c: F.col(c) for c in fields}))
    rows = rows.orderBy("pos").limit(limit) if limit else rows
    return rows.select("pos", "query", *fields, "data_source")


def target_counts(records: DataFrame, targets: list[str], least: int) -> DataFrame:
    """target, n and chosen: how many rows each target would have, and whether it is the first of them with at least `least`.

    All targets are counted in one pass over the records.
    """
    counts = _asked(records).agg(*[F.count_if(USABLE[t](fields_of(F.col("record"), t))).alias(t) for t in targets])
    rows = counts.select(F.posexplode(F.array(*[F.struct(F.lit(t).alias("target"), F.col(t).alias("n")) for t in targets])).alias("at", "x"))
    first = F.min(F.when(F.col("x.n") >= least, F.col("at"))).over(Window.partitionBy(F.lit(1)))  # a row for each target
    return rows.select("x.target", "x.n", F.coalesce(F.col("at") == first, F.lit(False)).alias("chosen"))


def normalize_first(records: DataFrame, targets: list[str], least: int = 1) -> DataFrame:
    """Rows of the first target that the records have enough rows for; fails where there is none."""
    chosen = [r["target"] for r in target_counts(records, targets, least).where("chosen").collect()]
    if not chosen:
        raise ValueError(f"no target of {', '.join(targets)} has {least} rows")
    return normalize(records, chosen[0])
