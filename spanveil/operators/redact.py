"""Policy actions on merged spans: redact, alert, block, allow. Narrow: no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.functions.spans import explode_rows, splice, value_at
from spanveil.functions.tokens import format_token, slug, token_id, value_hash
from spanveil.operators.detect import EngineConfig, detect

REDACTED = "[REDACTED]"


def action_of(klass: Column, actions: dict[str, str]) -> Column:
    """A class without an action is redacted."""
    out = F.lit("redact")
    for name, action in actions.items():
        out = F.when(klass == name, F.lit(action)).otherwise(out)
    return out


def with_actions(detected: DataFrame, actions: dict[str, str], text_col: str = "text", salt: Column | None = None) -> DataFrame:
    """Adds acted: spans with action, token and value hash, up to and with the first that blocks; and blocked: that span or null.

    salt keys the token ids; give it as a column so that it stays out of the plan."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    salt = salt if salt is not None else F.lit("")

    def act(s: Column) -> Column:
        value = value_at(text, s)
        action = action_of(s["class"], actions)
        token = F.when(action == "redact", format_token(slug(s["rule_id"]), token_id(value, salt)))
        return F.struct(s["start"], s["end"], s["class"], s["rule_id"], action.alias("action"), token.alias("token"), value_hash(value).alias("value_hash"))

    acted = detected.withColumn("_acted", F.transform("spans", act))
    blocks = F.filter("_acted", lambda s: s["action"] == "block")
    acted = acted.withColumn("blocked", F.when(F.size(blocks) > 0, blocks[0]))
    return acted.withColumn("acted", F.filter("_acted", lambda s: F.col("blocked").isNull() | (s["start"] <= F.col("blocked.start")))).drop("_acted")


def output_text(text: Column, acted: Column, blocked: Column) -> Column:
    """Redacted values replaced by tokens; empty if blocked."""
    done = splice(text, F.filter(acted, lambda s: s["action"] == "redact"), lambda s, _: s["token"])
    return F.when(blocked.isNotNull(), F.lit("")).otherwise(done)


def process_text(detected: DataFrame, actions: dict[str, str], text_col: str = "text", salt: Column | None = None) -> DataFrame:
    """Adds output, detections (spans that aren't allowed; none if blocked) and blocked (rule and class, or null)."""
    acted = with_actions(detected, actions, text_col, salt)
    counted = F.filter("acted", lambda s: s["action"] != "allow")
    return acted.select(
        *[c for c in acted.columns if c not in ("acted", "blocked")],
        output_text(F.coalesce(F.col(text_col), F.lit("")), F.col("acted"), F.col("blocked")).alias("output"),
        F.when(F.col("blocked").isNotNull(), F.array().cast(acted.schema["acted"].dataType)).otherwise(counted).alias("detections"),
        F.when(F.col("blocked").isNotNull(), F.struct(F.col("blocked.rule_id").alias("rule_id"), F.col("blocked.class").alias("class"))).alias("blocked"),
    )


def process_output(ran: DataFrame, actions: dict[str, str], config: EngineConfig | None = None, id_col: str = "cmd_id", salt: Column | None = None) -> DataFrame:
    """ran: id, stdout, stderr of commands that ran elsewhere. id, stdout, stderr (redacted each by itself), blocked_rule: a block in either blanks both."""
    both = ran
    for name in ("stdout", "stderr"):
        acted = with_actions(detect(both, config, name), actions, name, salt)
        both = acted.withColumn(f"_{name}", output_text(F.coalesce(F.col(name), F.lit("")), F.col("acted"), F.lit(None))).withColumn(f"_{name}_blocked", F.col("blocked.rule_id")).drop("spans", "acted", "blocked")
    rule = F.coalesce("_stdout_blocked", "_stderr_blocked")
    shown = lambda name: F.when(rule.isNotNull(), F.lit("")).otherwise(F.col(f"_{name}")).alias(name)
    return both.select(id_col, shown("stdout"), shown("stderr"), rule.alias("blocked_rule"))


def redact_constant(text: Column, spans: Column, constant: str = REDACTED) -> Column:
    """Irreversible."""
    return splice(text, spans, lambda s, v: F.lit(constant))


def audit_rows(acted: DataFrame, id_col: str = "doc_id", tool: str = "read") -> DataFrame:
    """A row without a value for each span that was acted on; allowed ones leave none."""
    rows = explode_rows(acted, "acted", "s", id_col).filter("s.action <> 'allow'")
    return rows.select(
        F.col("s.rule_id").alias("ruleId"), F.lit(tool).alias("tool"), F.col("s.action").alias("action"), F.col("s.token").alias("tokenRef"), F.substring("s.value_hash", 1, 12).alias("valueHash"),
        F.create_map(F.lit("doc"), F.col(id_col).cast("string"), F.lit("start"), F.col("s.start").cast("string")).alias("context"),
    )
