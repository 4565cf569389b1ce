"""Sinks: detections as JSON lines, and the report of scores as Markdown."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("file", "start", "end", "class", "rule_id", "runner")


def write_detections(detections: DataFrame, path: str) -> None:
    """JSON lines in a folder a runner. detections: FIELDS; never a value."""
    detections.select(*FIELDS).write.mode("overwrite").partitionBy("runner").json(path)


def percent(share: Column) -> Column:
    """One decimal; a dash where there is no number."""
    return F.when(share.isNull() | F.isnan(share), "—").otherwise(F.concat(F.format_string("%.1f", share * 100), F.lit("%")))


def score_lines(scores: DataFrame) -> DataFrame:
    """runner, class, line: rows of the table of scores, see scoring.scores."""
    cells = ["runner", "class", *[F.col(c).cast("string") for c in ("tp", "fp", "fn")], *[percent(F.col(c)) for c in ("precision", "recall", "f1")]]
    return scores.select("runner", "class", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def survival_lines(rows: DataFrame) -> DataFrame:
    """scenario, config, line: see survival.survival."""
    mark = lambda c: F.when(F.col(c), "✓").otherwise("✗")
    return rows.select("scenario", "config", F.concat(F.lit("| "), F.concat_ws(" | ", "scenario", "config", *[mark(c) for c in ("completed", "byte_correct", "no_leak")]), F.lit(" |")).alias("line"))


def _table(columns: Iterable[str], lines: Iterable[str]) -> list[str]:
    names = list(columns)
    return ["| " + " | ".join(names) + " |", "|" + " --- |" * len(names), *lines, ""]


def render(scores: DataFrame, survived: DataFrame, notes: Iterable[str] = ()) -> str:
    """The report. Its rows are those of runners, classes, scenarios and ways of hiding, so they are few whatever was scored."""
    scored = [r.line for r in score_lines(scores).orderBy("runner", F.col("class") == "overall", "class").collect()]
    lived = [r.line for r in survival_lines(survived).orderBy("scenario", "config").collect()]
    parts = ["# Scores", "", *_table(("runner", "class", "TP", "FP", "FN", "precision", "recall", "F1"), scored), "# Survival of edits", "", *_table(("scenario", "config", "completed", "byte-correct", "no leak"), lived), "# Notes", ""]
    return "\n".join([*parts, *([f"- {n}" for n in notes] or ["(none)"]), ""])
