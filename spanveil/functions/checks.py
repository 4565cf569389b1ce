"""Predicates on matched values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def card_ok(value: Column) -> Column:
    """13 to 19 digits that pass Luhn."""
    digits = digits_of(value)
    return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)


def ssn_ok(value: Column) -> Column:
    """Area not 000, 666 or 9xx, group not 00, serial not 0000."""
    area, group, serial = F.substring(value, 1, 3), F.substring(value, 5, 2), F.substring(value, 8, 4)
    return ~area.isin("000", "666") & ~area.startswith("9") & (group != "00") & (serial != "0000")


def entropy(value: Column) -> Column:
    """Shannon entropy in bits a character."""
    chars = F.split(value, "")
    n = F.length(value)

    def part(c: Column) -> Column:
        share = F.size(F.filter(chars, lambda x: x == c)) / n
        return -share * F.log2(share)

    return F.when(n == 0, 0.0).otherwise(F.aggregate(F.transform(F.array_distinct(chars), part), F.lit(0.0), lambda a, x: a + x))


#: What people write where a secret would stand, by family. Whole value, lower case.
PLACEHOLDER_FAMILIES = (
    r"(change|replace|fill|set)[_-]?(me|this|it|in)[0-9]*",  # requests to change it
    r"(your|my|insert|enter|put|add)[_-].*",  # what should stand there
    r"(placeholder|example|sample|dummy|test|todo|tbd|fixme|default|redacted|hidden|unset)",
    r"(none|null|nil|true|false|undefined|yes|no)",
    r"(secret|token|passwd|passw[o0]rd|p[a@4][s5$]{2}w[o0]rd)",  # the key's own name, letters swapped for look-alikes
    r"[a-z]{3,7}[0-9]",  # a short word and a digit
    r"[a-z]{3,9}([-_][a-z]{3,9}){2,}",  # plain words in a row
    r"(x{3,}|\*{3,}|\.{3,}|-{3,}|0{4,}|1234(5(6(7(89?0?)?)?)?)?|abcd(ef?g?h?)?|qwerty)",  # one character, or a row of the keyboard
    r"(<.*>|\$\{.*\}|\{\{.*\}\}|%.*%)",  # a template's field
)
PLACEHOLDER = "^(" + "|".join(PLACEHOLDER_FAMILIES) + ")$"
#: Addresses, URLs and connection strings, and sentences.
SHAPES = (r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$", r"^[A-Za-z][A-Za-z0-9+.-]*://", r"[!?]$")


def placeholder(value: Column) -> Column:
    return F.lower(value).rlike(PLACEHOLDER)


def odd_shape(value: Column) -> Column:
    out = F.lit(False)
    for shape in SHAPES:
        out = out | value.rlike(shape)
    return out
