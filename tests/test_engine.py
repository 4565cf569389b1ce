from __future__ import annotations

import json
import os

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanveil import fixtures as fx
from spanveil import queries
from spanveil.functions import checks, tokens
from spanveil.functions.spans import merge_spans
from spanveil.operators import audit, chunks, commands, redact, scoring, search, status, survival, vault
from spanveil.operators.detect import EngineConfig, detect, explode_spans, ner_spans
from spanveil.operators.rules import PII_RULES, SECRET_RULES, Rule, lint
from spanveil.plans.policy import PolicyError, engine_config, load_policy, merge_policy
from spanveil.sources import corpus, files, report
from spanveil.streaming import flows

ACTIONS = merge_policy(None)["actions"]


def spans_of(spark, text, config=None):
    rows = detect(spark.createDataFrame([(1, text)], "doc_id long, text string"), config or EngineConfig())
    return [(r.rule_id, r.value) for r in explode_spans(rows).orderBy("start").collect()]


def test_rules_are_sound():
    assert lint((*SECRET_RULES, *PII_RULES)) == []
    assert lint((Rule("a", "(x)"), Rule("a", "(x*)*", group=2)))


def test_every_vendor_rule_hits_and_misses(spark):
    found = detect(fx.frame(spark, "rule_texts"), EngineConfig(pii=False))
    by_doc = {r.doc_id: {s.rule_id for s in r.spans} for r in found.collect()}
    for k, (rule, _, _) in enumerate(fx.HITS):
        assert rule in by_doc[2 * k], rule
        assert rule not in by_doc[2 * k + 1], rule


@pytest.mark.parametrize(
    ("text", "hit"),
    [
        ("pwd: set_this", False), ("secret = my-own-value", False), ("token = winter7", False), ("passwd=blue-green-red-black", False), ("api_key: {{ vault }}", False), ("access_token: FIXME", False), ("password = P4$$w0rd", False),
        ("passwd = 172.16.4.9", False), ("client_secret = 'Ask the team?'", False), ("token = ldap://dir.lan/o=x", False), ("secret = 12345678", False), ("pwd = ********", False), ("password = %DB_PASS%", False),
        ("auth_token = Summer2019x", True), ("apikey: 'winter7-Qz81-lk'", True), ("access_token = gZ4-kW7.pQ2_vM9", True), ('{"client_secret":"b7Tq0ZxLw93e"}', True),
    ],
)
def test_generic_credentials(spark, text, hit):
    assert any(r == "generic-credential-assignment" for r, _ in spans_of(spark, text)) is hit


def test_entropy_threshold_and_allowlist(spark):
    assert not spans_of(spark, "password = Summer2019x", EngineConfig(generic_entropy=4.0))
    key = "AKIA" + "IOSFODNN7EXAMPLE"
    assert not spans_of(spark, f"aws_key = {key}", EngineConfig(allow=(key,)))
    assert spans_of(spark, f"xx{key}yy") == [("aws-access-key-id", key)]


def test_null_empty_and_astral_text(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "🙂 a@b.example 🙂")], "doc_id long, text string")
    out = {r.doc_id: r for r in redact.process_text(detect(rows, EngineConfig()), ACTIONS).collect()}
    assert out[1].output == "" and out[2].output == "" and not out[1].spans
    assert out[3].spans[0].start == 2 and out[3].output.startswith("🙂 ⟦veil:pii-email:")


def test_card_and_ssn_checks(spark):
    got = [v for _, v in spans_of(spark, "4539578763621486, 4539578763621487; 123-45-6789 000-45-6789", EngineConfig(secrets=False))]
    assert "4539578763621486" in got and "123-45-6789" in got and "000-45-6789" not in got


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(1, 8), st.sampled_from(["secrets", "pii_customer", "other"])), max_size=8))
def test_merge_is_disjoint_sorted_and_idempotent(spark, rows):
    spans = [(s, s + n, c, f"r{k}", k) for k, (s, n, c) in enumerate(rows)]
    df = spark.createDataFrame([(spans,)], "s array<struct<start:int,end:int,class:string,rule_id:string,ordinal:int>>")
    once, twice = df.select(merge_spans(F.col("s")), merge_spans(merge_spans(F.col("s")))).first()
    assert once == twice
    assert all(a.end <= b.start for a, b in zip(once, once[1:], strict=False))
    assert all(any(a.start < e and s < a.end for a in once) for s, e, *_ in spans)


def test_block_alert_allow(spark):
    text = "a@b.example then password = X9kQ2vWp1aZmL7 then c@d.example"
    rows = detect(spark.createDataFrame([(1, text)], "doc_id long, text string"), EngineConfig())
    got = redact.process_text(rows, {"secrets": "block", "pii_customer": "alert"}).first()
    assert got.output == "" and got.detections == [] and got.blocked.rule_id == "generic-credential-assignment"
    log = redact.audit_rows(redact.with_actions(rows, {"secrets": "block", "pii_customer": "alert"})).collect()
    assert [r.action for r in log] == ["alert", "block"]
    assert redact.process_text(rows, {"secrets": "allow", "pii_customer": "allow"}).first().output == text


def test_audit_never_holds_a_value(spark, tmp_path):
    rows = detect(spark.createDataFrame([(1, "mail a@b.example now")], "doc_id long, text string"), EngineConfig())
    audit.append(redact.audit_rows(redact.with_actions(rows, ACTIONS)), str(tmp_path / "log"))
    (tmp_path / "log" / "bad.json").write_text("{broken\n")
    assert "a@b.example" not in "".join(p.read_text() for p in (tmp_path / "log").glob("*.json"))
    assert files.read_audit(spark, str(tmp_path / "log")).filter("action = 'redact'").count() == 1


def test_tokens():
    with pytest.raises(ValueError):
        tokens.format_token_local("a:b", "1")


def test_vault_save_tamper_and_wipe(spark, tmp_path):
    store, path = fx.frame(spark, "vault"), str(tmp_path / "vault")
    vault.save(store, path, F.lit(bytes(32)))
    assert sorted(r.value for r in vault.unseal(spark.read.parquet(path), F.lit(bytes(32))).collect()) == sorted(r.value for r in store.collect())
    with pytest.raises(Exception, match="AES|decrypt|tag|Tag"):
        vault.unseal(spark.read.parquet(path), F.lit(b"x" * 32)).collect()
    vault.wipe(store, path)
    assert spark.read.parquet(path).count() == 0


def test_vault_errors_and_caps(spark):
    store = fx.frame(spark, "vault")
    with pytest.raises(Exception, match="unknown token"):
        vault.rotate(store, spark.createDataFrame([("nope", "x")], "token string, new_value string")).collect()
    assert vault.evict(store, 0).filter("evicted").count() == 0
    assert vault.evict(store, 2).filter("evicted").count() == 3
    assert vault.evict(store, 9).filter("evicted").count() == 0


def test_mint_names_a_value_once(spark):
    rows = spark.createDataFrame([("v", "b", 2), ("v", "a:x", 1), ("w", "b", 3)], "value string, rule_id string, seen int")
    got = {r.value: r for r in vault.mint(rows).collect()}
    assert got["v"].token.startswith("⟦veil:a-x:") and got["v"].sightings == 2 and len(got) == 2


def test_chunks_equal_whole(spark):
    text = ("word " * 50 + "mail a@b.example and (555) 123-4567 ") * 6
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    whole = [(r.start, r.end) for r in explode_spans(detect(docs, EngineConfig(secrets=False))).orderBy("start").collect()]
    got = chunks.scan_chunks(docs, 300, 60, EngineConfig(secrets=False)).first().spans
    assert [(s.start, s.end) for s in got] == whole
    with pytest.raises(ValueError):
        chunks.chunk_texts(docs, 10, 10)


ALLOWED = [
    "make test", "git remote add up /srv/x.git", "git log --grep=env", "kubectl get configmap web", "docker ps -a", "docker-compose up", "aws s3 ls", "gcloud config list", "tail -n 3 /var/log/syslog", "cat notes-on-printenv.txt",
    "setfacl -m u:x:r f", "set -u", "environment=1", "python -c 'print(1)'", "printf '%s' \"envelope\"", "timeout 9 make", "xargs -n 2 wc -l", "sudo -u web ls", "eval ls", "sh -c 'ls -l'", "true # printenv", "   ",
]
DENIED = [
    "printenv | sort", "env -0", "ls && printenv", "A=1; env", "( set )", "git remote --verbose", "git remote -v | cat", "kubectl view secrets", "kubectl edit secret db", "docker inspect web --format x", "docker compose config --services",
    "docker-compose config -q", "aws configure get region", "gcloud auth print-identity-token", "more /proc/1/environ", "bat /proc/thread-self/environ", "tail -c 9 /proc/42/environ", "zsh -c 'set'", 'dash -c "docker inspect a"', 'eval "printenv A"',
    "nohup printenv", "nice env", "stdbuf -o0 env", "xargs -P 4 env", "timeout -k 2 9 env", "doas -u www env", "echo $(git remote -v)", "x=`aws configure list`", 'echo "$(kubectl get secrets)"', "ls || (cd /tmp; printenv)", 'printenv "unclosed', "true\nprintenv",
]


def test_commands(spark):
    rows = spark.createDataFrame([(c,) for c in [*ALLOWED, *DENIED]] + [(None,)], "command string")
    got = {r.command: r.decision for r in commands.screen_commands(rows).collect()}
    assert {c for c in ALLOWED if got[c] != "allow"} == set() and {c for c in DENIED if got[c] != "deny"} == set() and got[None] == "allow"


def test_policy(tmp_path):
    assert merge_policy({"actions": {"secrets": "block"}})["actions"] == ACTIONS | {"secrets": "block"}
    assert merge_policy({"allow": ["x"]})["allow"] == ["x"]
    for bad, path in [({"version": 2}, "version"), ({"actions": {"secrets": "eat"}}, "actions.secrets"), ({"detection": {"max_bytes": 0}}, "detection.max_bytes"), ({"detection": {"chunk_overlap": 1 << 21}}, "detection.chunk_overlap"), ({"allow": "x"}, "allow"), ({"fail_closed": 1}, "fail_closed")]:
        with pytest.raises(PolicyError) as e:
            merge_policy(bad)
        assert e.value.path == path
    assert load_policy(str(tmp_path / "none")) == merge_policy(None)
    (tmp_path / "p.json").write_text(json.dumps({"tune": {"custom_patterns": [{"name": "n", "regex": "x", "class": "c"}]}}))
    assert engine_config(load_policy(str(tmp_path / "p.json"))).custom == (("n", "x", "c"),)


def test_files(spark, tmp_path):
    for name, data in {"a.txt": b"hello", "node_modules/b.txt": b"x", "c.bin": b"a\x00b"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = files.read_files(spark, str(tmp_path))
    assert sorted(r.path.rsplit("/", 1)[1] for r in got.collect()) == ["a.txt", "c.bin"]
    assert got.filter(~files.is_binary(F.col("content"))).count() == 1
    with pytest.raises(ValueError):
        files.slice_text(got, 5, 5, 10)
    cut = files.slice_text(spark.createDataFrame([("aé",)], "text string"), 0, 2, 10).first().slice
    assert cut == "a�"


def test_corpus_is_deterministic_and_found(spark):
    assert corpus.corpus(7) == corpus.corpus(7) != corpus.corpus(8)
    for name, text in corpus.corpus()[0]:
        for label in corpus.corpus()[1]:
            assert label[0] != name or text[label[2] : label[3]] == label[6]


def test_scores_without_detections(spark):
    none = spark.createDataFrame([], "runner string, file string, start int, end int, class string")
    assert scoring.scores(scoring.outcomes(none, fx.frame(spark, "labels"))).count() == 0


def test_ner_spans_lose_to_secrets(spark):
    e = spark.createDataFrame([(1, "x AKIA" + "ABCDEFGH23456789 y", [(0, 10, "PERSON"), (21, 30, "URL")])], "doc_id long, text string, e array<struct<start:int,end:int,entity_type:string>>")
    got = detect(e, EngineConfig(), extra=ner_spans(F.col("e"))).first().spans
    assert [s.rule_id for s in got] == ["aws-access-key-id"] or [s["class"] for s in got] == ["secrets", "pii_internal"]


def test_grep_limit_and_blocked_line(spark):
    docs = spark.createDataFrame([(1, "a\npassword = X9kQ2vWp1aZmL7\nb\r\nc")], "doc_id long, text string")
    got = search.grep(docs, "password", {"secrets": "block"}).collect()
    assert [(r.line, r.text) for r in got] == [(2, search.BLOCKED_LINE)]
    assert search.first_matches(search.lines(docs).select("doc_id", "line"), 4).first().truncated


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    spark.createDataFrame([(1, "a@b.example"), (2, "x")], "doc_id long, text string").write.parquet(str(tmp_path / "in/one"))
    stream = spark.readStream.schema("doc_id long, text string").option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = flows.redact_and_audit(stream, ACTIONS, str(tmp_path / "out"), str(tmp_path / "log")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2 and files.read_audit(spark, str(tmp_path / "log")).count() == 1
    spark.createDataFrame([("s", f"t{k}", k) for k in range(5)], "shard string, token string, at long").write.parquet(str(tmp_path / "uses"))
    uses = spark.readStream.schema("shard string, token string, at long").parquet(str(tmp_path / "uses"))
    q = flows.capped_vault(uses, 2).writeStream.format("memory").queryName("gone").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.token for r in spark.table("gone").collect()) == ["t0", "t1", "t2"]


@pytest.mark.parametrize("form", ["file", "folder", "partitions", "empty"])
def test_stream_of_any_form_of_documents(spark, tmp_path, form):
    """One file, a folder of files of many ages, and one of partitions; tables of other names, or elsewhere, aren't read."""
    sf = tmp_path / "sf=1"
    rows = [(k, None if k == 3 else f"mail a{k}@b.example now", f"s {k % 2}") for k in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    other = spark.createDataFrame([(99, "z@b.example", "s 9")], docs.schema).coalesce(1)
    other.write.parquet(str(sf / "older/documents.parquet"))
    other.write.parquet(str(sf / "documents.parquet.bak"))
    if form == "file":
        docs.coalesce(1).write.parquet(str(tmp_path / "made"))
        next((tmp_path / "made").glob("part-*")).rename(sf / "documents.parquet")
    else:
        parts = (docs.filter("doc_id < 0") if form == "empty" else docs).repartition(4).write
        (parts.partitionBy("source") if form == "partitions" else parts).parquet(str(sf / "documents.parquet"))
        for k, file in enumerate(sorted((sf / "documents.parquet").rglob("part-*"))):
            os.utime(file, (1e9 + k * 1e7,) * 2)
    got, want = (queries.QUERIES[q](spark, str(sf)).select("doc_id", "n_spans", "output").collect() for q in ("streaming_redact", "redact_text"))
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    assert len(got) == (0 if form == "empty" else 8) and sum(r.n_spans for r in got) == (0 if form == "empty" else 7)


def test_entropy_of_empty(spark):
    assert spark.range(1).select(checks.entropy(F.lit(""))).first()[0] == 0.0


def test_byte_slice_all_has_every_document(spark, tmp_path):
    texts = [None, "", "x" * 99, "a" * 99 + "é" * 60, "🙂" * 60, "a" + "🙂" * 60, "ab" + "漢" * 80, "a" * 179 + "🙂", "plain " * 50]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.slice for r in queries.QUERIES["byte_slice_all"](spark, str(tmp_path)).collect()}
    assert got == {k: None if t is None else t.encode()[100:180].decode(errors="replace") for k, t in enumerate(texts)}


def test_json_leaves_are_restored(spark):
    store = fx.frame(spark, "vault").unionByName(spark.createDataFrame([("⟦veil:q:quote⟧", 'say "hi"\n\\ ⟦veil:pii-email:aaaa11112222⟧', "h", "r", 0, 0)], fx.TABLES["vault"][0]))
    held = {r.token: r.value for r in store.collect()}
    rows = [*fx.TABLES["tool_inputs"][1], (8, json.dumps({"a": ["⟦veil:q:quote⟧", {"⟦veil:q:quote⟧": ["x⟦veil:q:quote⟧y", 'a":b', "\\", 'he said "⟦veil:q:quote⟧": \\"']}], "é": "\u27e6"})), (9, json.dumps({f"k{k}": f"⟦veil:none:{k}⟧" for k in range(5)}))]

    def fill(x):
        if isinstance(x, str):
            for token, value in held.items():
                if token in x:
                    return value.join(part for part in x.split(token))
            return x
        return [fill(y) for y in x] if isinstance(x, list) else {k: fill(v) for k, v in x.items()} if isinstance(x, dict) else x

    got = {r.doc_id: r for r in vault.restore_json(spark.createDataFrame(rows, "doc_id long, payload string"), store).collect()}
    assert {k for k, r in got.items() if r.decision == "deny"} == {2, 4, 7, 9}
    for k, payload in rows:
        if got[k].decision == "allow":
            assert json.loads(got[k].output) == fill(json.loads(payload)), k
        else:
            assert got[k].output == payload
    assert len(got[9].missing) == 3


def test_vault_and_texts_agree_whatever_rule_found_a_value(spark):
    docs = spark.createDataFrame([(1, "password = a1B@b.example"), (2, "mail a1B@b.example"), (3, None), (4, "plain")], "doc_id long, text string")
    found = detect(docs, EngineConfig())
    store = vault.mint(explode_spans(found).select("value", "rule_id", F.col("doc_id").alias("seen")))
    masked = vault.tokenise(found, store).withColumnRenamed("output", "text")
    assert all("a1B@" not in r.text for r in masked.collect())
    got = {r.doc_id: (r.decision, r.output) for r in vault.restore(masked, store).collect()}
    assert got == {r.doc_id: ("allow", r.text or "") for r in docs.collect()}


def test_output_of_commands(spark):
    got = {r.cmd_id: r for r in redact.process_output(fx.frame(spark, "outputs"), {"pii_customer": "redact", "secrets": "block"}).collect()}
    assert got[1].stdout.startswith("mail ⟦veil:pii-email:") and got[1].stderr.startswith("warn: ⟦veil:pii-email:") and got[1].blocked_rule is None
    assert all((got[k].stdout, got[k].stderr, got[k].blocked_rule) == ("", "", "generic-credential-assignment") for k in (2, 3))
    assert (got[4].stdout, got[4].stderr) == ("", "") and (got[5].stdout, got[5].stderr) == ("nothing", "to see")


def test_health_levels(spark):
    policy, store, none = merge_policy({"vault": {"max_entries": 0}}), fx.frame(spark, "vault"), fx.frame(spark, "present").limit(0)
    of = lambda *a, **k: {r.name: r.status for r in status.health(*a, **k).collect()}
    assert of(policy, store, none, none, status.STEPS) == {"rules": "pass", "policy": "pass", "vault": "pass", "steps": "pass"}
    lost = status.health(policy, store.limit(0), none, None)
    assert {r.name: r.status for r in lost.collect()} == {"rules": "fail", "policy": "pass", "vault": "pass", "steps": "warn"}
    assert not status.healthy(lost).first().ok
    wanted = merge_policy({"detection": {"ner": True}, "vault": {"max_entries": 6}})
    assert of(wanted, store, none, none, status.STEPS, True) == {"rules": "pass", "policy": "pass", "vault": "pass", "steps": "pass", "recogniser": "pass"}


def test_reports(spark, tmp_path):
    found = fx.frame(spark, "detections").withColumn("rule_id", F.lit("r"))
    report.write_detections(found, str(tmp_path / "found"))
    assert spark.read.json(str(tmp_path / "found")).count() == found.count()
    scored = scoring.scores(scoring.outcomes(fx.frame(spark, "detections"), fx.frame(spark, "labels")))
    lived = survival.survival(fx.frame(spark, "scenarios").withColumn("secrets", F.split("secrets", "[|]")))
    text = report.render(scored, lived)
    assert text.count("\n| ") == scored.count() + 12 + 2 * 2 and "| no secret | open | ✓ | ✓ | ✓ |" in text
    assert {r.config: r.all_three for r in survival.by_config(lived).collect()} == {"token": 3, "constant": 1, "open": 1, "denied": 0}
    empty = survival.survival(spark.createDataFrame([("x", None, "a", "b", "", [])], "name string, original string, find string, replacement string, expected string, secrets array<string>"))
    assert {r.config: r.byte_correct for r in empty.collect()} == dict.fromkeys(survival.CONFIGS, True)
