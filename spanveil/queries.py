"""One query for each operator, over the driver's tables or inline fixtures."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanveil import fixtures as fx
from spanveil.functions import checks, tokens
from spanveil.functions.spans import explode_rows, line_number, merge_spans
from spanveil.operators import audit, chunks, commands, detect, redact, scoring, search, status, survival, vault
from spanveil.operators.detect import EngineConfig
from spanveil.operators.rules import PII_RULES, SECRET_RULES, Rule
from spanveil.plans.policy import merge_policy
from spanveil.sources import corpus, files, report
from spanveil.sources.tables import dealt, shared_path, streamed, written
from spanveil.streaming import flows

ACTIONS = merge_policy(None)["actions"]
PII = EngineConfig(secrets=False)
FULL = EngineConfig(allow=tuple(merge_policy(None)["allow"]))


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return dealt(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))


def rule_query(rule: Rule) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        table = fx.frame(spark, "texts") if rule.rule_id == "pii-ssn" else docs(spark, sf)
        found = table.withColumn("spans", detect.rule_spans(F.col("text"), rule, 0))
        return detect.explode_spans(found).select("doc_id", "start", "end", "value")

    return run


def rule_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Every secret rule over the fixture of a hit and a near miss for each."""
    found = detect.detect(fx.frame(spark, "rule_texts"), EngineConfig(pii=False))
    return detect.explode_spans(found).select("doc_id", "rule_id", "start", "end", "value")


def generic_credentials(spark: SparkSession, sf: str) -> DataFrame:
    table = docs(spark, sf).unionByName(fx.frame(spark, "credentials"))
    found = table.withColumn("spans", detect.rule_spans(F.col("text"), SECRET_RULES[-1], 0))
    return detect.explode_spans(found).select("doc_id", "start", "end", "value")


def secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    """The whole engine over all documents."""
    return detect.explode_spans(detect.detect(docs(spark, sf), FULL)).select("doc_id", "start", "end", "class", "rule_id")


def entropy_scores(spark: SparkSession, sf: str) -> DataFrame:
    return fx.frame(spark, "values").select("value", F.round(checks.entropy(F.col("value")), 6).alias("entropy"))


def merged(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.frame(spark, "spans").groupBy("doc_id").agg(F.collect_list(F.struct("start", "end", "class", "rule_id", "ordinal")).alias("s"))
    out = explode_rows(rows, merge_spans(F.col("s")), "k", "doc_id")
    return out.select("doc_id", F.col("k.start").alias("start"), F.col("k.end").alias("end"), F.col("k.class").alias("class"), F.col("k.rule_id").alias("rule_id"))


def redact_text(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: scan, merge, replace by tokens."""
    out = redact.process_text(detect.detect(docs(spark, sf), PII), ACTIONS)
    return out.select("doc_id", F.size("spans").alias("n_spans"), "output")


def redact_constant(spark: SparkSession, sf: str) -> DataFrame:
    found = detect.detect(docs(spark, sf), PII)
    return found.select("doc_id", redact.redact_constant(F.col("text"), F.col("spans")).alias("output"))


def policy_actions(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.frame(spark, "spans").select("doc_id", "start", "class")
    return rows.select("doc_id", "start", redact.action_of(F.col("class"), ACTIONS).alias("action"))


BLOCKING = {"pii_customer": "alert", "secrets": "block"}


def block_cutoff(spark: SparkSession, sf: str) -> DataFrame:
    """What is audited where credentials block: spans up to the first that does."""
    acted = redact.with_actions(detect.detect(docs(spark, sf), FULL), BLOCKING)
    rows = redact.audit_rows(acted)
    return rows.select(F.col("context")["doc"].cast("long").alias("doc_id"), F.col("context")["start"].cast("int").alias("start"), "ruleId", "action")


def audit_summary(spark: SparkSession, sf: str) -> DataFrame:
    return audit.summary(fx.frame(spark, "log"))


def audit_tail(spark: SparkSession, sf: str) -> DataFrame:
    return audit.tail(fx.frame(spark, "log"), 4).select("ts", "ruleId", "action")


def audit_bound(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.frame(spark, "log").select("ts", "ruleId", "tool", "action", F.lit(None).cast("string").alias("tokenRef"), "valueHash", F.create_map(F.lit("note"), F.repeat(F.lit("x"), F.col("note_len"))).alias("context"))
    out = audit.bound_lines(rows)
    return out.select("ts", "ruleId", "action", F.coalesce(F.col("context")["truncated"], F.lit("")).alias("truncated"), F.length(F.coalesce(F.col("context")["note"], F.lit(""))).alias("note_len"))


def token_parse(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.frame(spark, "tokenised").select("doc_id", F.explode(tokens.parse_tokens(F.col("text"))).alias("k"))
    return rows.select("doc_id", "k.raw", F.col("k.class").alias("slug"), "k.id", "k.start", "k.end")


def token_mint(spark: SparkSession, sf: str) -> DataFrame:
    found = detect.explode_spans(detect.detect(docs(spark, sf), PII))
    out = vault.mint(found.select("value", "rule_id", F.struct("doc_id", "start").alias("seen")))
    return out.select("token", "value", "value_hash", "rule_id", F.col("first_seen.doc_id").alias("first_doc"), "sightings")


def token_restore(spark: SparkSession, sf: str) -> DataFrame:
    out = vault.restore(fx.frame(spark, "tokenised"), fx.frame(spark, "vault"))
    return out.select("doc_id", "output", "n_tokens", "decision")


def token_missing(spark: SparkSession, sf: str) -> DataFrame:
    out = vault.restore(fx.frame(spark, "tokenised"), fx.frame(spark, "vault"))
    return out.filter("decision = 'deny'").select("doc_id", F.array_join("missing", ",").alias("missing"))


def round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Detect with every rule, mint, put the vault's tokens into the texts, restore: every text must come back."""
    found = written(detect.detect(docs(spark, sf), FULL), "detected")
    store = written(vault.mint(detect.explode_spans(found).select("value", "rule_id", F.struct("doc_id", "start").alias("seen"))), "vault")
    masked = vault.tokenise(found, store).withColumnRenamed("output", "text")
    return vault.restore(masked, store).select("doc_id", F.sha2("output", 256).alias("restored_sha256"))


def mint_incremental(spark: SparkSession, sf: str) -> DataFrame:
    """Values seen after a vault was made: known ones keep their tokens, new ones get theirs."""
    store = fx.frame(spark, "vault")
    fresh = vault.mint(fx.frame(spark, "sightings"), vault=store)
    return store.select("token", "value", "rule_id").unionByName(fresh.select("token", "value", "rule_id"))


def shell_output(spark: SparkSession, sf: str) -> DataFrame:
    return redact.process_output(fx.frame(spark, "outputs"), BLOCKING, FULL)


def detokenize_json(spark: SparkSession, sf: str) -> DataFrame:
    out = vault.restore_json(fx.frame(spark, "tool_inputs"), fx.frame(spark, "vault"))
    return out.select("doc_id", "output", F.array_join("missing", ",").alias("missing"), "n_tokens", "decision")


def vault_rotate(spark: SparkSession, sf: str) -> DataFrame:
    return vault.rotate(fx.frame(spark, "vault"), fx.frame(spark, "rotations")).select("token", "value", "value_hash")


def vault_owners(spark: SparkSession, sf: str) -> DataFrame:
    return vault.owners(vault.rotate(fx.frame(spark, "vault"), fx.frame(spark, "rotations")))


def vault_lru(spark: SparkSession, sf: str) -> DataFrame:
    return vault.evict(fx.frame(spark, "vault"), 3).select("token", "evicted")


def vault_stats(spark: SparkSession, sf: str) -> DataFrame:
    return vault.stats(fx.frame(spark, "vault"))


GREP = "token = "


def grep_lines(spark: SparkSession, sf: str) -> DataFrame:
    return search.grep(docs(spark, sf), GREP, ACTIONS, FULL)


def grep_limit(spark: SparkSession, sf: str) -> DataFrame:
    return search.first_matches(search.lines(docs(spark, sf)).filter(F.col("text").rlike(GREP)).select("doc_id", "line"), 5)


def line_split(spark: SparkSession, sf: str) -> DataFrame:
    rows = search.lines(docs(spark, sf))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.max(F.length("text")).alias("longest"))


def line_numbers(spark: SparkSession, sf: str) -> DataFrame:
    rows = explode_rows(detect.detect(docs(spark, sf), PII), "spans", "s", "doc_id", "text")
    return rows.select("doc_id", F.col("s.start").alias("start"), line_number(F.col("text"), F.col("s.start")).alias("line"))


def rule_summary(spark: SparkSession, sf: str) -> DataFrame:
    out = search.rule_summary(redact.with_actions(detect.detect(docs(spark, sf), PII), ACTIONS))
    return out.select("doc_id", "rule_id", "count", F.array_join(F.col("lines").cast("array<string>"), ",").alias("lines"))


def chunk_scan(spark: SparkSession, sf: str) -> DataFrame:
    found = chunks.scan_chunks(docs(spark, sf), 4096, 128, PII)
    return explode_rows(found, "spans", "s", "doc_id").select("doc_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.rule_id").alias("rule_id"))


#: Values that need no protection, by a rule on the value.
ALLOWED_VALUES = "^[a-m]"


def allow_anti(spark: SparkSession, sf: str) -> DataFrame:
    found = detect.explode_spans(detect.detect(docs(spark, sf), PII))
    allowed = found.select("value").filter(F.col("value").rlike(ALLOWED_VALUES))
    return detect.allow_anti(found, allowed).select("doc_id", "start", "value")


def env_key_parse(spark: SparkSession, sf: str) -> DataFrame:
    return files.env_keys(fx.frame(spark, "env_files"))


TUNED = EngineConfig(secrets=False, pii=False, env_keys=("DB_PASS", "API_TOKEN"), internal_domains=("*.corp.internal", "db-*.lan"), custom=(("ticket", "TCK-([0-9]{4})", "pii_internal"),))


def tuned_spans(spark: SparkSession, sf: str) -> DataFrame:
    return detect.explode_spans(detect.detect(fx.frame(spark, "tuned_texts"), TUNED)).select("doc_id", "rule_id", "start", "end", "value")


NAIVE = Rule("naive", r"[A-Za-z0-9+/=_\-]{32,}", "secrets", 0)


def naive_scan(spark: SparkSession, sf: str) -> DataFrame:
    found = docs(spark, sf).withColumn("spans", detect.rule_spans(F.col("text"), NAIVE, 0))
    return detect.explode_spans(found).select("doc_id", "start", "end")


def score_candidates(spark: SparkSession, sf: str) -> DataFrame:
    out = scoring.candidates(fx.frame(spark, "detections"), fx.frame(spark, "labels"))
    return out.select("runner", "file", "d_start", "l_start", "class", F.round("iou", 6).alias("iou"))


def score_benign(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.benign_hits(fx.frame(spark, "detections"), fx.frame(spark, "labels")).select("runner", "file", "start", "end")


def _outcomes(spark: SparkSession) -> DataFrame:
    return scoring.outcomes(fx.frame(spark, "detections"), fx.frame(spark, "labels"))


def score_fn(spark: SparkSession, sf: str) -> DataFrame:
    return _outcomes(spark).filter("outcome = 'fn'").groupBy("runner", "class").agg(F.count("*").alias("n"))


def score_rollup(spark: SparkSession, sf: str) -> DataFrame:
    out = scoring.scores(_outcomes(spark))
    return out.select("runner", "class", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def score_rates(spark: SparkSession, sf: str) -> DataFrame:
    out = scoring.rates(_outcomes(spark), fx.frame(spark, "labels"))
    return out.select("runner", *[F.round(c, 6).alias(c) for c in ("lookalike_rate", "exact_rate", "partial_rate")])


def percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """Nearest-rank percentiles of order values by priority."""
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    return scoring.nearest_rank(orders.select("o_orderpriority", F.col("o_totalprice").cast("double").alias("v")), ["o_orderpriority"], "v")


def throughput(spark: SparkSession, sf: str) -> DataFrame:
    return fx.frame(spark, "runs").select("runner", F.round(scoring.throughput(F.col("bytes"), F.col("ms")), 6).alias("mb_s"))


def guard_fallback(spark: SparkSession, sf: str) -> DataFrame:
    return commands.screen_by_pattern(fx.frame(spark, "commands")).select("command", "decision", "rule_id")


def guard(spark: SparkSession, sf: str) -> DataFrame:
    return commands.screen_commands(fx.frame(spark, "commands")).select("command", "decision", "rule_id")


def doctor(spark: SparkSession, sf: str) -> DataFrame:
    """The required deny rules that a configuration lacks."""
    return fx.frame(spark, "required").join(fx.frame(spark, "present"), "rule", "left_anti")


def health_check(spark: SparkSession, sf: str) -> DataFrame:
    """A vault of cap 5 that is nearly full, one step that isn't registered."""
    policy = merge_policy({"vault": {"max_entries": 5}, "detection": {"ner": True}})
    return status.health(policy, fx.frame(spark, "vault"), fx.frame(spark, "required"), fx.frame(spark, "present"), {"restore", "screen"})


def status_report(spark: SparkSession, sf: str) -> DataFrame:
    return status.status(merge_policy(None), fx.frame(spark, "vault"), fx.frame(spark, "log"))


def _survived(spark: SparkSession) -> DataFrame:
    return survival.survival(fx.frame(spark, "scenarios").withColumn("secrets", F.split("secrets", "[|]")), FULL)


def survivability(spark: SparkSession, sf: str) -> DataFrame:
    return _survived(spark)


def survival_by_config(spark: SparkSession, sf: str) -> DataFrame:
    return survival.by_config(_survived(spark))


def score_report(spark: SparkSession, sf: str) -> DataFrame:
    return report.score_lines(scoring.scores(_outcomes(spark)))


def vault_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Audit rows of rotation and eviction, contexts as text."""
    store = fx.frame(spark, "vault")
    rows = vault.rotation_audit(store, fx.frame(spark, "rotations")).unionByName(vault.eviction_audit(vault.evict(store, 3)), allowMissingColumns=True)
    return rows.select(F.col("action"), F.col("tokenRef").alias("token"), F.col("valueHash").alias("hash"), F.concat_ws(",", F.map_values("context")).alias("context"))


def size_routing(spark: SparkSession, sf: str) -> DataFrame:
    return files.route_by_size(docs(spark, sf), 5000).select("doc_id", "kind")


def byte_slice(spark: SparkSession, sf: str) -> DataFrame:
    """The bytes [100, 180) of every document, and how many characters they are as text, cut ones not counted."""
    out = files.slice_text(docs(spark, sf), 100, 180, 1000)
    part = F.substring(F.encode("text", "UTF-8"), 101, 80)
    return out.select("doc_id", F.lower(F.hex(part)).alias("slice_hex"), F.length(F.replace("slice", F.lit("\ufffd"), F.lit(""))).cast("long").alias("n_whole"))


def byte_slice_all(spark: SparkSession, sf: str) -> DataFrame:
    """Slices of every document, cut characters included; without SQL, see byte_slice."""
    return files.slice_text(docs(spark, sf), 100, 180, 1000).select("doc_id", "slice")


def binary_filter(spark: SparkSession, sf: str) -> DataFrame:
    table = fx.frame(spark, "blobs").select("doc_id", F.unhex("hex").alias("content"))
    return table.filter(~files.is_binary(F.col("content"))).select("doc_id")


def ignore_prune(spark: SparkSession, sf: str) -> DataFrame:
    return files.prune(fx.frame(spark, "paths"), "path", (*files.IGNORED, "*.log", "!keep.log", "docs/**/draft"))


def requests(spark: SparkSession, sf: str) -> DataFrame:
    return files.parse_requests(fx.frame(spark, "requests")).select("doc_id", "tool", "command", "decision")


def report_offsets(spark: SparkSession, sf: str) -> DataFrame:
    return files.locate_findings(fx.frame(spark, "reports"), fx.frame(spark, "report_texts"))


def ner_merge(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.frame(spark, "entities").groupBy("doc_id").agg(F.collect_list(F.struct("start", "end", "entity_type")).alias("e"))
    out = explode_rows(rows, merge_spans(detect.ner_spans(F.col("e"))), "s", "doc_id")
    return out.select("doc_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.class").alias("class"), F.col("s.rule_id").alias("rule_id"))


def ner_plugin(spark: SparkSession, sf: str) -> DataFrame:
    """A recogniser as an Arrow UDF: here one of capitalised pairs; its spans join the engine's."""

    @F.pandas_udf("array<struct<start:int,end:int,entity_type:string>>")
    def recognise(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import re

        pair = re.compile(r"\b[A-Z][a-z]+ [A-Z][a-z]+\b")
        for batch in texts:
            yield batch.map(lambda t: [{"start": m.start(), "end": m.end(), "entity_type": "PERSON"} for m in pair.finditer(t or "")])

    found = detect.detect(docs(spark, sf).withColumn("_e", recognise("text")), PII, extra=detect.ner_spans(F.col("_e")))
    return found.select("doc_id", F.size("spans").alias("n_spans"))


def aes_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Seal and unseal the vault with a key that is data, not a literal of the plan."""
    key = spark.createDataFrame([(bytes(range(32)),)], "_key binary")
    rows = fx.frame(spark, "vault").crossJoin(F.broadcast(key))
    return vault.unseal(vault.seal(rows, F.col("_key")), F.col("_key")).select("token", "value")


def corpus_scores(spark: SparkSession, sf: str) -> DataFrame:
    """The engine and a naive scanner over the labelled corpus, scored."""
    texts, labels = corpus.corpus_tables(spark)
    engine = detect.explode_spans(detect.detect(texts, FULL), "file").select(F.lit("engine").alias("runner"), "file", "start", "end", F.when(F.col("rule_id").startswith("pii-"), F.regexp_replace("rule_id", "-", "_")).otherwise(F.col("class")).alias("class"))
    naive = detect.explode_spans(texts.withColumn("spans", detect.rule_spans(F.col("text"), NAIVE, 0)), "file").select(F.lit("naive").alias("runner"), "file", "start", "end", "class")
    return scoring.scores(scoring.outcomes(engine.unionByName(naive), labels))


def streaming_redact(spark: SparkSession, sf: str) -> DataFrame:
    """documents as a stream of files through the same functions."""
    stream = streamed(spark, sf, "documents.parquet")
    path = shared_path(spark, "stream")
    query = flows.redact_stream(stream, ACTIONS, PII).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{path}/out")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **{f"{r.rule_id.replace('-', '_')}_spans": rule_query(r) for r in PII_RULES},
    "rule_hits": rule_hits, "generic_credential_spans": generic_credentials, "secret_scan": secret_scan, "entropy_scores": entropy_scores, "merge_spans": merged, "redact_text": redact_text,
    "redact_constant": redact_constant, "policy_actions": policy_actions, "block_cutoff": block_cutoff, "audit_summary": audit_summary, "audit_tail": audit_tail, "audit_bound": audit_bound,
    "token_parse": token_parse, "token_mint_dedupe": token_mint, "token_restore": token_restore, "token_missing_deny": token_missing, "round_trip": round_trip, "mint_incremental": mint_incremental, "shell_output": shell_output, "detokenize_json": detokenize_json, "vault_rotate": vault_rotate,
    "vault_owners": vault_owners, "vault_lru_evict": vault_lru, "vault_stats": vault_stats, "grep_lines": grep_lines, "grep_limit": grep_limit, "line_split": line_split, "line_numbers": line_numbers,
    "rule_summary": rule_summary, "chunk_scan_dedup": chunk_scan, "allowlist_anti": allow_anti, "env_key_parse": env_key_parse, "tuned_spans": tuned_spans, "naive_scan": naive_scan,
    "score_candidates": score_candidates, "score_benign_semi": score_benign, "score_fn_anti": score_fn, "score_rollup": score_rollup, "score_rates": score_rates, "percentile_nearest_rank": percentiles,
    "throughput": throughput, "guard_regex_fallback": guard_fallback, "bash_guard": guard, "doctor_missing_rules": doctor, "size_routing": size_routing, "byte_slice": byte_slice, "byte_slice_all": byte_slice_all,
    "binary_filter": binary_filter, "ignore_prune": ignore_prune, "request_parse": requests, "report_offsets": report_offsets, "ner_merge": ner_merge, "ner_plugin": ner_plugin,
    "health_check": health_check, "status_report": status_report, "survivability": survivability, "survival_by_config": survival_by_config, "score_report": score_report, "vault_audit": vault_audit,
    "aes_roundtrip": aes_roundtrip, "corpus_scores": corpus_scores, "streaming_redact": streaming_redact,
}
