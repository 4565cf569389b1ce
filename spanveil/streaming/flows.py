"""Structured Streaming: the same column functions on streams, an append-only audit sink, and a vault with a cap as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from spanveil.operators.audit import append
from spanveil.operators.detect import EngineConfig, detect
from spanveil.operators.redact import audit_rows, output_text, with_actions


def redact_stream(docs: DataFrame, actions: dict[str, str], config: EngineConfig | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, output, n_spans: stateless, so it needs no watermark."""
    acted = with_actions(detect(docs, config, text_col), actions, text_col)
    return acted.select(id_col, output_text(F.coalesce(F.col(text_col), F.lit("")), F.col("acted"), F.col("blocked")).alias("output"), F.size("acted").alias("n_spans"))


def redact_and_audit(docs: DataFrame, actions: dict[str, str], out_path: str, audit_path: str, config: EngineConfig | None = None) -> DataStreamWriter:
    """Writes outputs by batch number, so that a batch that is run again replaces itself, outputs and audit rows alike."""

    def each(batch: DataFrame, number: int) -> None:
        acted = with_actions(detect(batch, config), actions).persist()
        text = output_text(F.coalesce(F.col("text"), F.lit("")), F.col("acted"), F.col("blocked"))
        acted.select("doc_id", text.alias("output")).write.mode("overwrite").parquet(f"{out_path}/batch={number}")
        append(audit_rows(acted), f"{audit_path}/batch={number}", "overwrite")
        acted.unpersist()

    return docs.writeStream.foreachBatch(each)


def capped_vault(uses: DataFrame, cap: int) -> DataFrame:
    """uses: shard, token, at. A stream of tokens dropped from each shard's `cap` most recently used."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, times = (list(x) for x in state.get) if state.exists else ([], [])
        held = dict(zip(tokens, times, strict=True))
        for batch in batches:
            for token, at in zip(batch["token"], batch["at"], strict=True):
                held[token] = max(int(at), held.get(token, 0))
        order = sorted(held, key=lambda t: (held[t], t))
        gone = order[: max(0, len(order) - cap)] if cap else []
        kept = order[len(gone) :]
        state.update((kept, [held[t] for t in kept]))
        yield pd.DataFrame({"shard": [key[0]] * len(gone), "token": gone, "last_used": [held[t] for t in gone]})

    return uses.groupBy("shard").applyInPandasWithState(step, "shard string, token string, last_used long", "tokens array<string>, times array<long>", "append", GroupStateTimeout.NoTimeout)
