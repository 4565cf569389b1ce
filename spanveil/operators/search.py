"""Lines, search and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanveil.functions.spans import explode_rows, line_number
from spanveil.operators.detect import EngineConfig, detect
from spanveil.operators.redact import output_text, with_actions

BLOCKED_LINE = "[... blocked by rule]"


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(id_col, F.posexplode(F.split(text_col, "\r?\n", -1)).alias("_p", "text")).select(id_col, (F.col("_p") + 1).alias("line"), "text")


def grep(docs: DataFrame, pattern: str, actions: dict[str, str], config: EngineConfig | None = None, ignore_case: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, line, text: raw lines that match, each redacted by itself; a blocked one is a fixed text."""
    hits = lines(docs, id_col, text_col).filter(F.col("text").rlike(("(?i)" if ignore_case else "") + pattern))
    acted = with_actions(detect(hits, config), actions)
    out = F.when(F.col("blocked").isNotNull(), F.lit(BLOCKED_LINE)).otherwise(output_text(F.col("text"), F.col("acted"), F.lit(None)))
    return acted.select(id_col, "line", out.alias("text"))


def first_matches(matches: DataFrame, most: int, id_col: str = "doc_id") -> DataFrame:
    """The first `most` by id and line; truncated is true if there were as many or more."""
    top = matches.orderBy(id_col, "line").limit(most)
    n = top.agg((F.count("*") >= most).alias("truncated"))
    return top.crossJoin(F.broadcast(n))


def rule_summary(acted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, rule_id, class, count, lines, tokens: of what was acted on, up to the first block."""
    rows = explode_rows(acted, "acted", "s", id_col, text_col).filter("s.action not in ('allow', 'block')")
    rows = rows.select(id_col, F.col("s.rule_id").alias("rule_id"), F.col("s.class").alias("class"), F.col("s.token").alias("token"), line_number(F.col(text_col), F.col("s.start")).alias("line"))
    return rows.groupBy(id_col, "rule_id", "class").agg(F.count("*").alias("count"), F.sort_array(F.collect_list("line")).alias("lines"), F.sort_array(F.collect_set("token")).alias("tokens"))
