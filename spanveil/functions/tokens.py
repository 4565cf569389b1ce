"""Reversible tokens: an opening bracket, the namespace, a slug, an id, a closing bracket."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

OPEN, CLOSE = "\u27e6veil:", "\u27e7"
TOKEN = OPEN + "([A-Za-z0-9_-]+):([A-Za-z0-9]+)" + CLOSE


def slug(rule_id: Column) -> Column:
    """Rule ids may hold a colon; slugs may not."""
    return F.regexp_replace(rule_id, "[^A-Za-z0-9_-]", "-")


def format_token(slug_: Column, id_: Column) -> Column:
    ok = slug_.rlike("^[A-Za-z0-9_-]+$") & id_.rlike("^[A-Za-z0-9]+$")
    return F.when(ok, F.concat(F.lit(OPEN), slug_, F.lit(":"), id_, F.lit(CLOSE))).otherwise(F.raise_error(F.concat(F.lit("not a token slug or id: "), slug_, F.lit(" "), id_)))


def format_token_local(slug_: str, id_: str) -> str:
    if not re.fullmatch("[A-Za-z0-9_-]+", slug_) or not re.fullmatch("[A-Za-z0-9]+", id_):
        raise ValueError(f"not a token slug or id: {slug_} {id_}")
    return f"{OPEN}{slug_}:{id_}{CLOSE}"


def is_token(text: Column) -> Column:
    return text.rlike(TOKEN)


def parse_tokens(text: Column) -> Column:
    """array of struct(raw, class, id, start, end)."""
    from spanveil.functions.spans import match_starts

    parts = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)).alias("raw"), F.regexp_extract_all(text, F.lit(TOKEN), F.lit(1)).alias("class"), F.regexp_extract_all(text, F.lit(TOKEN), F.lit(2)).alias("id"), match_starts(text, TOKEN).alias("start")
    )
    return F.transform(parts, lambda p: F.struct(p["raw"], p["class"], p["id"], p["start"], (p["start"] + F.length(p["raw"])).alias("end")))


def value_hash(value: Column) -> Column:
    return F.sha2(value, 256)


def token_id(value: Column, salt: Column, length: int = 12) -> Column:
    """A keyed id: the same value has the same token in every run with the same salt."""
    return F.substring(F.sha2(F.concat(salt, value), 256), 1, length)
