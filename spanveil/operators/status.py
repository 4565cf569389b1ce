"""State of an installation: counts of policy, vault and audit log, and the health check. Both are small tables."""

from __future__ import annotations

from collections.abc import Collection
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.operators import audit, vault

#: A vault that holds this share of its cap, or more, is about to evict.
NEARLY_FULL = 0.9
#: The steps that must be registered for tokens to be restored, commands screened and the vault wiped.
STEPS = ("restore", "screen", "wipe")


def status(policy: dict[str, Any], store: DataFrame, log: DataFrame) -> DataFrame:
    """part, item, value: the policy's version, modes and actions, the vault's size and age, the log's counts by action. Nulls are told as null."""
    facts = {("policy", "version"): policy["version"], ("policy", "fail_closed"): policy["fail_closed"]}
    facts |= {("detection", k): policy["detection"][k] for k in ("secrets", "fast_pii", "ner")}
    facts |= {("action", k): v for k, v in policy["actions"].items()}
    facts |= {("tune", k): len(v) for k, v in policy["tune"].items()}
    spark = store.sparkSession
    told = spark.createDataFrame([(p, i, str(v).lower()) for (p, i), v in facts.items()], "part string, item string, value string")
    kept = vault.stats(store).select(F.explode(F.array(*[F.struct(F.lit(c).alias("item"), F.col(c).cast("string").alias("value")) for c in ("entries", "created")])).alias("r")).select(F.lit("vault").alias("part"), "r.*")
    counts = audit.summary(log).select(F.lit("audit").alias("part"), F.col("action").alias("item"), F.col("n").cast("string").alias("value"))
    return told.unionByName(kept).unionByName(counts)


def health(policy: dict[str, Any], store: DataFrame, required: DataFrame, present: DataFrame | None, steps: Collection[str] | None = None, recogniser: bool = False) -> DataFrame:
    """name, status (pass, warn, fail), detail of each check. required, present: rule; present is None where the settings can't be read.

    steps: those registered, None if that isn't known. recogniser: whether the name recogniser answers; asked only if policy wants one.
    That a policy is there at all means that it could be loaded."""
    spark, cap = store.sparkSession, policy["vault"]["max_entries"]

    def check(name: str, level: Column, detail: Column) -> Column:
        return F.struct(F.lit(name).alias("name"), level.alias("status"), detail.alias("detail"))

    gone = (required if present is None else required.join(present, "rule", "left_anti")).distinct()
    seen = gone.agg(F.array_join(F.array_sort(F.collect_set("rule")), ", ").alias("_gone")).crossJoin(F.broadcast(vault.stats(store)))
    lacking = [s for s in STEPS if steps is not None and s not in steps]
    rules = F.lit("settings can't be read") if present is None else F.when(F.col("_gone") == "", "all rules present").otherwise(F.concat(F.lit("missing: "), F.col("_gone")))
    full = (F.lit(cap) > 0) & (F.col("entries") >= F.lit(cap * NEARLY_FULL))
    checks = [
        check("rules", F.lit("fail") if present is None else F.when(F.col("_gone") == "", "pass").otherwise("fail"), rules),
        check("policy", F.lit("pass"), F.lit(f"version {policy['version']}")),
        check("vault", F.when(full, "warn").otherwise("pass"), F.concat(F.col("entries").cast("string"), F.lit(f" of {cap}" if cap else " without a cap"))),
        check("steps", F.lit("warn" if steps is None else "fail" if lacking else "pass"), F.lit("not known" if steps is None else "missing: " + ", ".join(lacking) if lacking else "all steps registered")),
    ]
    if policy["detection"]["ner"]:
        checks.append(check("recogniser", F.lit("pass" if recogniser else "warn"), F.lit("answers" if recogniser else "doesn't answer: names aren't found")))
    return seen.select(F.explode(F.array(*checks)).alias("c")).select("c.*")


def healthy(checks: DataFrame) -> DataFrame:
    """ok: whether no check failed."""
    return checks.agg((F.count_if(F.col("status") == "fail") == 0).alias("ok"))
