"""Whether a task that reads, edits and writes back a file survives the way in which its secrets are hidden.

scenarios: name, original, find, replacement (the edit: each find becomes replacement), expected, secrets (array).
Four ways: `token` (vault tokens on reading, restored on writing), `constant` (a fixed text, for good), `open` (as it is),
`denied` (can't be read, so nothing is edited). A null original is an empty file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.operators import vault
from spanveil.operators.detect import EngineConfig, detect, explode_spans
from spanveil.operators.redact import redact_constant

CONFIGS = ("token", "constant", "open", "denied")


def survival(scenarios: DataFrame, config: EngineConfig | None = None) -> DataFrame:
    """scenario, config, completed, byte_correct, no_leak. A file that stays as it was, since it can't be read, counts as correct."""
    found = detect(scenarios.withColumn("original", F.coalesce("original", F.lit(""))), config, "original")
    store = vault.mint(explode_spans(found, "name", "original").select("value", "rule_id", F.struct("name", "start").alias("seen")))
    facts = found.select("name", "original", "find", "replacement", "expected", "secrets")
    edited: Column = F.replace(F.col("output"), F.col("find"), F.col("replacement"))
    leaks = F.exists("secrets", lambda s: (s != "") & F.contains(F.col("output"), s))

    hidden = vault.tokenise(found, store, "name", "original").join(facts, "name")
    back = vault.restore(hidden.select("name", edited.alias("text")), store, "name").select("name", F.col("output").alias("_final"), "decision")
    rows = hidden.join(back, "name").select("name", F.lit("token").alias("config"), (F.col("decision") == "allow").alias("completed"), ((F.col("decision") == "allow") & (F.col("_final") == F.col("expected"))).alias("byte_correct"), (~leaks).alias("no_leak"))
    plain = found.withColumn("_c", F.explode(F.array(F.lit("constant"), F.lit("open"))))
    plain = plain.withColumn("output", F.when(F.col("_c") == "constant", redact_constant(F.col("original"), F.col("spans"))).otherwise(F.col("original")))
    plain = plain.select("name", F.col("_c").alias("config"), F.lit(True).alias("completed"), (edited == F.col("expected")).alias("byte_correct"), (~leaks).alias("no_leak"))
    denied = facts.select("name", F.lit("denied").alias("config"), F.lit(False).alias("completed"), F.lit(True).alias("byte_correct"), F.lit(True).alias("no_leak"))
    return rows.unionByName(plain).unionByName(denied).withColumnRenamed("name", "scenario")


def by_config(rows: DataFrame) -> DataFrame:
    """config, total, all_three: how many scenarios have all three properties."""
    return rows.groupBy("config").agg(F.count("*").alias("total"), F.count_if(F.col("completed") & F.col("byte_correct") & F.col("no_leak")).alias("all_three"))
