"""Chunked scanning of long texts: overlapping chunks, detected in parallel, deduplicated and merged again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanveil.functions.spans import explode_rows, line_number, merge_spans
from spanveil.operators.detect import EngineConfig, detect


def chunk_texts(docs: DataFrame, chunk: int, overlap: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, chunk_start (code points), text: chunks that share `overlap` with the next."""
    if not 0 <= overlap < chunk:
        raise ValueError("the overlap must be below the chunk")
    text = F.coalesce(F.col(text_col), F.lit(""))
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - overlap - 1, F.lit(0)), F.lit(chunk - overlap))
    return docs.select(id_col, text.alias("_t"), F.explode(starts).alias("chunk_start")).select(id_col, "chunk_start", F.substring("_t", F.col("chunk_start") + 1, F.lit(chunk)).alias("text"))


def scan_chunks(docs: DataFrame, chunk: int, overlap: int, config: EngineConfig | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, spans over the whole text. Spans longer than the overlap are left out."""
    found = detect(chunk_texts(docs, chunk, overlap, id_col, text_col), config)
    spans = explode_rows(found, "spans", "s", id_col, "chunk_start")
    moved = spans.filter(F.col("s.end") - F.col("s.start") <= overlap).select(
        id_col, (F.col("s.start") + F.col("chunk_start")).alias("start"), (F.col("s.end") + F.col("chunk_start")).alias("end"), F.col("s.class").alias("class"), F.col("s.rule_id").alias("rule_id"), F.col("s.ordinal").alias("ordinal")
    )
    once = moved.dropDuplicates([id_col, "start", "end", "rule_id"])
    return once.groupBy(id_col).agg(F.collect_list(F.struct("start", "end", "class", "rule_id", "ordinal")).alias("_s")).select(id_col, merge_spans(F.col("_s")).alias("spans"))


def with_lines(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, start, end, rule_id, line."""
    rows = explode_rows(docs.select(id_col, text_col).join(spans, id_col), "spans", "s", id_col, text_col)
    return rows.select(id_col, F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.rule_id").alias("rule_id"), line_number(F.col(text_col), F.col("s.start")).alias("line"))
