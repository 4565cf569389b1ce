"""Detection: all rules in one projection, so that a scan of the texts is narrow and needs no shuffle."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.functions import checks
from spanveil.functions.spans import explode_rows, find_spans, merge_spans, no_spans, value_at
from spanveil.operators.rules import ACCEPT, PII_RULES, SECRET_RULES, Rule, env_key_pattern, host_pattern


@dataclass(frozen=True)
class EngineConfig:
    secrets: bool = True
    pii: bool = True
    generic_entropy: float = 2.7
    allow: tuple[str, ...] = ()
    env_keys: tuple[str, ...] = ()
    internal_domains: tuple[str, ...] = ()
    #: name, pattern, class
    custom: tuple[tuple[str, str, str], ...] = field(default=())

    def rules(self) -> tuple[Rule, ...]:
        """In the order in which ties are decided: secrets, personal data, tuned."""
        import re

        tuned = [Rule("tuned-env-key", env_key_pattern(list(self.env_keys)))] if self.env_keys else []
        tuned += [Rule("tuned-internal-domain", host_pattern(g), "internal_hostnames", 0) for g in self.internal_domains]
        tuned += [Rule(f"tuned-custom:{n}", p, c, min(1, re.compile(p).groups)) for n, p, c in self.custom]
        return (*(SECRET_RULES if self.secrets else ()), *(PII_RULES if self.pii else ()), *tuned)


def rule_spans(text: Column, rule: Rule, ordinal: int, generic_entropy: float = 2.7) -> Column:
    spans = find_spans(text, rule.pattern, rule.klass, rule.rule_id, ordinal, rule.group, rule.guard)
    if rule.accept == "generic":
        # Every match holds one of the two signs.
        worth = F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))
        return F.when(worth, F.filter(spans, lambda s: generic_ok(value_at(text, s), generic_entropy))).otherwise(no_spans())
    if rule.accept:
        return F.filter(spans, lambda s: ACCEPT[rule.accept](value_at(text, s)))
    if rule.least_entropy:
        return F.filter(spans, lambda s: checks.entropy(value_at(text, s)) >= rule.least_entropy)
    return spans


def generic_ok(value: Column, least: float) -> Column:
    return ~checks.placeholder(value) & ~checks.odd_shape(value) & (checks.entropy(value) >= least)


def guarded_spans(text: Column, rules: list[tuple[int, Rule]]) -> Column:
    """Spans of the rules that have a guard, as one expression over an array of rules: a text is searched for
    each guard, and only a rule whose guard it holds has its pattern compiled and run. The plan doesn't grow with the rules."""
    table = F.array(*[
        F.struct(F.lit(r.pattern).alias("pattern"), F.lit(r.klass).alias("class"), F.lit(r.rule_id).alias("rule_id"), F.lit(k).alias("ordinal"), F.lit(r.group).alias("group"), F.lit(r.guard).alias("guard"), F.lit(float(r.least_entropy)).alias("least"))
        for k, r in rules
    ])

    def one(r: Column) -> Column:
        spans = find_spans(text, r["pattern"], r["class"], r["rule_id"], r["ordinal"], r["group"])
        return F.filter(spans, lambda s: (r["least"] == 0) | (checks.entropy(value_at(text, s)) >= r["least"]))

    return F.flatten(F.transform(F.filter(table, lambda r: F.contains(text, r["guard"])), one))


def all_spans(text: Column, config: EngineConfig) -> Column:
    """Every rule's spans, without allowed values, not merged."""
    rules = list(enumerate(config.rules()))
    # A guard of one character rules little out: those rules are written out, so that their patterns are compiled once.
    guarded = [(k, r) for k, r in rules if r.guard and len(r.guard) > 1 and not r.accept]
    parts = [guarded_spans(text, guarded)] if guarded else []
    held = {k for k, _ in guarded}
    parts += [rule_spans(text, r, k, config.generic_entropy) for k, r in rules if k not in held]
    spans = F.concat(*parts) if parts else no_spans()
    if config.allow:
        allowed = F.array(*[F.lit(v) for v in config.allow])
        spans = F.filter(spans, lambda s: ~F.array_contains(allowed, value_at(text, s)))
    return spans


def detect(docs: DataFrame, config: EngineConfig | None = None, text_col: str = "text", extra: Column | None = None) -> DataFrame:
    """docs with a column spans: merged. extra: spans of other detectors (not subject to the allowlist). Null text has none."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.withColumn("_all", all_spans(text, config or EngineConfig()))
    every = F.concat("_all", F.coalesce(extra, no_spans())) if extra is not None else F.col("_all")
    return found.withColumn("spans", merge_spans(every)).drop("_all")


#: Entity types of name recognisers that count as internal; all others are customer data.
INTERNAL_ENTITIES = ("IP_ADDRESS", "URL")


def ner_spans(entities: Column, ordinal: int = 10_000) -> Column:
    """array of struct(start, end, entity_type) of an outside recogniser as spans; malformed ones are left out."""
    sound = F.filter(entities, lambda e: e["start"].isNotNull() & e["end"].isNotNull() & (e["end"] > e["start"]) & (e["start"] >= 0))
    klass = lambda e: F.when(e["entity_type"].isin(*INTERNAL_ENTITIES), "pii_internal").otherwise("pii_customer")
    return F.transform(sound, lambda e: F.struct(e["start"].cast("int").alias("start"), e["end"].cast("int").alias("end"), klass(e).alias("class"), F.concat(F.lit("ner:"), e["entity_type"]).alias("rule_id"), F.lit(ordinal).alias("ordinal")))


def explode_spans(detected: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a span: id, start, end, class, rule_id, value."""
    rows = explode_rows(detected, "spans", "s", id_col, text_col)
    return rows.select(id_col, F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.class").alias("class"), F.col("s.rule_id").alias("rule_id"), value_at(F.col(text_col), F.col("s")).alias("value"))


def allow_anti(spans: DataFrame, allowed: DataFrame) -> DataFrame:
    """Exploded spans without those whose value is in allowed (column value)."""
    return spans.join(allowed.select("value").distinct(), "value", "left_anti")
