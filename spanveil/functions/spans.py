"""Span algebra on arrays of struct(start, end, class, rule_id, ordinal): code points, end exclusive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int,class:string,rule_id:string,ordinal:int>"
#: The class that wins where spans overlap; any other class has 0.
PRIORITY = {"secrets": 100, "internal_hostnames": 80, "pii_customer": 50, "pii_internal": 30}


def no_spans() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def priority(klass: Column) -> Column:
    out = F.lit(0)
    for name, rank in PRIORITY.items():
        out = F.when(klass == name, F.lit(rank)).otherwise(out)
    return out


def _column(x: Column | str | int) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def match_starts(text: Column, pattern: Column | str) -> Column:
    """Starts of all leftmost non-overlapping matches: the lengths of what lies between and of the matches, summed.

    The pattern must not match the empty string and must have no group that changes what split sees."""
    found = F.regexp_extract_all(text, _column(pattern), F.lit(0))
    between = F.transform(F.split(text, _column(pattern), -1), lambda s: F.length(s))
    steps = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda g, m: F.struct(g.alias("g"), F.length(m).alias("m")))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(steps, empty, lambda a, x: F.struct((a["at"] + x["g"] + x["m"]).alias("at"), F.concat(a["out"], F.array(a["at"] + x["g"])).alias("out")), lambda a: a["out"])


def find_spans(text: Column, pattern: Column | str, klass: Column | str, rule_id: Column | str, ordinal: Column | int, group: Column | int = 0, guard: str | None = None) -> Column:
    """Spans of the matches, or of a group: its first occurrence in the match. guard: a literal that every match holds; texts without it aren't scanned."""
    whole = F.regexp_extract_all(text, _column(pattern), F.lit(0))
    value = whole if isinstance(group, int) and group == 0 else F.regexp_extract_all(text, _column(pattern), _column(group))
    parts = F.arrays_zip(match_starts(text, pattern).alias("s"), whole.alias("m"), value.alias("v"))

    def span(p: Column) -> Column:
        start = p["s"] + F.instr(p["m"], p["v"]) - 1
        return F.struct(start.cast("int").alias("start"), (start + F.length(p["v"])).cast("int").alias("end"), _column(klass).alias("class"), _column(rule_id).alias("rule_id"), _column(ordinal).alias("ordinal"))

    out = F.transform(F.filter(parts, lambda p: p["v"] != ""), span)
    # One search decides whether a text has any match: most have none, and offsets take several passes.
    worth = text.rlike(pattern) if isinstance(pattern, str) else F.lit(True)
    return F.when((F.contains(text, F.lit(guard)) & worth) if guard else worth, out).otherwise(no_spans())


def value_at(text: Column, span: Column) -> Column:
    return F.substring(text, span["start"] + 1, span["end"] - span["start"])


def overlap(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def merge_spans(spans: Column) -> Column:
    """Disjoint spans by start: higher class first, then earlier start, longer span, lower ordinal."""
    keyed = F.transform(
        spans,
        lambda s: F.struct((-priority(s["class"])).alias("p"), s["start"].alias("start"), (s["start"] - s["end"]).alias("l"), s["ordinal"].alias("ordinal"), s["end"].alias("end"), s["class"].alias("class"), s["rule_id"].alias("rule_id")),
    )
    bare = F.transform(F.array_sort(keyed), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["class"].alias("class"), s["rule_id"].alias("rule_id"), s["ordinal"].alias("ordinal")))
    kept = F.aggregate(bare, no_spans(), lambda acc, x: F.when(F.exists(acc, lambda k: overlap(k, x)), acc).otherwise(F.concat(acc, F.array(x))))
    return F.when(F.size(spans) < 2, spans).otherwise(F.array_sort(kept))


def splice(text: Column, spans: Column, replacement) -> Column:  # noqa: ANN001
    """text with each of the disjoint, sorted spans replaced by replacement(span, value)."""
    first = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(a: Column, s: Column) -> Column:
        return F.struct(F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), replacement(s, value_at(text, s))).alias("out"), s["end"].alias("at"))

    done = F.aggregate(spans, first, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    return F.when(F.size(spans) == 0, text).otherwise(done)


def line_number(text: Column, start: Column) -> Column:
    """1 and the newlines before start."""
    before = F.substring(text, F.lit(1), start)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def explode_rows(rows: DataFrame, array: Column | str, name: str, *keep: str | Column) -> DataFrame:
    """keep and a row for each element of array.

    As an outer explode without its null rows: a plain one makes the optimizer test the array's size below,
    with a copy of all that the array is computed from for every reference to it."""
    return rows.select(*keep, F.explode_outer(array).alias(name)).filter(F.col(name).isNotNull())
