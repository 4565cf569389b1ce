"""The audit log: whitelisted keys, bounded lines, counts by action, the last entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ("ts", "ruleId", "tool", "action", "tokenRef", "valueHash", "context")
SCHEMA = "ts string, ruleId string, tool string, action string, tokenRef string, valueHash string, context map<string,string>"
#: The actions that are counted.
ACTIONS = ("redact", "block", "alert", "allow", "restore", "rewrite", "evict", "wipe", "truncate")
MAX_LINE = 4000


def sanitise(rows: DataFrame) -> DataFrame:
    """Only whitelisted columns, ts filled in."""
    have = [c for c in KEYS if c in rows.columns and c != "ts"]
    ts = F.coalesce(F.col("ts"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")) if "ts" in rows.columns else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return rows.select(ts.alias("ts"), *have)


def bound_lines(rows: DataFrame, limit: int = MAX_LINE) -> DataFrame:
    """A row whose line is over limit loses its context to a marker and is followed by a truncate row; one that is still too long is an error. rows: all of KEYS."""
    # A line is the JSON and its newline.
    line = F.length(F.to_json(F.struct(*KEYS))) + 1
    size = F.coalesce(F.length(F.to_json("context")), F.lit(0)).cast("string")
    marked = F.create_map(F.lit("truncated"), F.lit("true"), F.lit("originalContextBytes"), size)
    without = F.length(F.to_json(F.struct(*KEYS[:-1]))) + 1
    short = F.when(without + 60 > limit, F.when(without > limit, F.raise_error(F.lit("audit entry too large even without context")).cast("map<string,string>"))).otherwise(marked)
    main = F.struct(*KEYS[:-1], short.alias("context"))
    follow = F.struct(
        F.col("ts"), F.lit("audit-truncate").alias("ruleId"), F.col("tool"), F.lit("truncate").alias("action"), F.lit(None).cast("string").alias("tokenRef"), F.lit(None).cast("string").alias("valueHash"),
        F.create_map(F.lit("originalRuleId"), F.substring("ruleId", 1, 200), F.lit("droppedBytes"), size).alias("context"),
    )
    return rows.select(F.explode(F.when(line > limit, F.array(main, follow)).otherwise(F.array(F.struct(*KEYS)))).alias("e")).select("e.*")


def append(rows: DataFrame, path: str, mode: str = "append") -> None:
    have = sanitise(rows)
    for c in KEYS:
        if c not in have.columns:
            have = have.withColumn(c, F.lit(None).cast("map<string,string>" if c == "context" else "string"))
    bound_lines(have.select(*KEYS)).write.mode(mode).json(path)


def summary(log: DataFrame) -> DataFrame:
    """action, n for each of ACTIONS, zero-filled, and `total`, which also counts unknown actions."""
    spark = log.sparkSession
    domain = spark.createDataFrame([(a,) for a in ACTIONS], "action string")
    counts = log.groupBy("action").agg(F.count("*").alias("n"))
    known = F.broadcast(domain).join(counts, "action", "left").select("action", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    return known.unionByName(counts.agg(F.lit("total").alias("action"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n")))


def tail(log: DataFrame, n: int) -> DataFrame:
    """The last n entries, oldest first."""
    return log.orderBy(F.desc("ts"), F.desc("ruleId"), F.desc("valueHash")).limit(n).orderBy("ts", "ruleId", "valueHash")
