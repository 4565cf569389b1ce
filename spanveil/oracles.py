"""The queries' SQL for the oracle engine, whose patterns know no lookaround: word boundaries are written \\b there."""

from __future__ import annotations

from spanveil import queries as q
from spanveil.fixtures import values
from spanveil.functions.checks import PLACEHOLDER, SHAPES
from spanveil.functions.tokens import CLOSE, OPEN, TOKEN
from spanveil.operators import audit, commands, scoring
from spanveil.operators.rules import PII_RULES, SECRET_RULES, B, L, R, Rule
from spanveil.plans.policy import merge_policy
from spanveil.sources.files import IGNORED, ignore_pattern

DOCS = "(SELECT doc_id, text FROM documents)"


def text_literal(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def dialect(pattern: str) -> str:
    return text_literal(pattern.replace(B, r"\b").replace(L, r"\b").replace(R, r"\b"))


def entropy(v: str) -> str:
    chars = f"string_split({v}, '')"
    return f"coalesce(list_sum(list_transform(list_distinct({chars}), lambda c: -(len(list_filter({chars}, lambda x: x = c)) / length({v})::DOUBLE) * log2(len(list_filter({chars}, lambda x: x = c)) / length({v})::DOUBLE))), 0)"


def luhn(v: str) -> str:
    d = f"regexp_replace({v}, '[^0-9]', '', 'g')"
    digit = f"substr({d}, length({d}) - i, 1)::INT"
    doubled = f"CASE WHEN i % 2 = 0 THEN {digit} WHEN {digit} > 4 THEN {digit} * 2 - 9 ELSE {digit} * 2 END"
    return f"(length({d}) BETWEEN 13 AND 19 AND list_sum(list_transform(range(0, length({d})), lambda i: {doubled})) % 10 = 0)"


def accepted(rule: Rule) -> str:
    if rule.accept == "ssn":
        return "substr(value, 1, 3) NOT IN ('000', '666') AND substr(value, 1, 1) <> '9' AND substr(value, 5, 2) <> '00' AND substr(value, 8, 4) <> '0000'"
    if rule.accept == "card":
        return luhn("value")
    if rule.accept == "generic":
        shapes = " AND ".join(f"NOT regexp_matches(value, {text_literal(x)})" for x in SHAPES)
        return f"NOT regexp_matches(lower(value), {text_literal(PLACEHOLDER)}) AND {shapes} AND {entropy('value')} >= 2.7"
    return f"{entropy('value')} >= {rule.least_entropy}" if rule.least_entropy else "TRUE"


def rule_spans(source: str, rule: Rule, ordinal: int) -> str:
    """doc_id, start, end, class, rule_id, ordinal, value of one rule."""
    p = dialect(rule.pattern)
    lengths = lambda xs: f"coalesce(list_sum(list_transform({xs}, lambda x: length(x))), 0)"
    return f"""SELECT doc_id, s AS "start", (s + length(value))::INTEGER AS "end", {text_literal(rule.klass)} AS class, {text_literal(rule.rule_id)} AS rule_id, {ordinal} AS ordinal, value FROM (
  SELECT doc_id, (({lengths("g[1:i]")} + {lengths("m[1:i - 1]")}) + instr(m[i], v[i]) - 1)::INTEGER AS s, v[i] AS value FROM (
    SELECT doc_id, m, v, g, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, {p}, 0) AS m, regexp_extract_all(text, {p}, {rule.group}) AS v, regexp_split_to_array(text, {p}) AS g FROM {source})))
WHERE value <> '' AND {accepted(rule)}"""


PRIORITY = "CASE class WHEN 'secrets' THEN 100 WHEN 'internal_hostnames' THEN 80 WHEN 'pii_customer' THEN 50 WHEN 'pii_internal' THEN 30 ELSE 0 END"


def merged(spans: str) -> str:
    """CTEs that merge spans (doc_id, start, end, class, rule_id, ordinal): ends in m."""
    return f"""raw AS ({spans}),
lists AS (SELECT doc_id, list([{{'s': "start", 'e': "end", 'class': class, 'rule_id': rule_id}}] ORDER BY {PRIORITY} DESC, "start", "start" - "end", ordinal) AS xs FROM raw GROUP BY doc_id),
kept AS (SELECT doc_id, unnest(list_reduce(xs, lambda a, b: CASE WHEN len(list_filter(a, lambda k: k.s < b[1].e AND b[1].s < k.e)) > 0 THEN a ELSE a || b END)) AS k FROM lists),
m AS (SELECT doc_id, k.s AS "start", k.e AS "end", k.class AS class, k.rule_id AS rule_id FROM kept)"""


def detected(source: str, rules: tuple[Rule, ...], allow: tuple[str, ...] = ()) -> str:
    union = "\nUNION ALL\n".join(rule_spans(source, r, k) for k, r in enumerate(rules))
    if allow:
        union = f"SELECT * FROM ({union}) WHERE value NOT IN ({', '.join(map(text_literal, allow))})"
    return merged(union)


PII = detected(DOCS, PII_RULES)
#: The documents hold none of the vendors' formats; those are compared over their fixture (rule_hits).
FULL = detected(DOCS, q.FULL.rules(), q.FULL.allow)


def spliced(with_: str, replacement: str, source: str = DOCS) -> str:
    """CTEs with m (doc_id, start, end, ...) to done (doc_id, n, output): values replaced."""
    return f"""{with_},
v AS (SELECT m.*, text, substr(text, "start" + 1, "end" - "start") AS value, lag("end", 1, 0) OVER (PARTITION BY doc_id ORDER BY "start") AS p FROM m JOIN {source} USING (doc_id)),
t AS (SELECT doc_id, count(*) AS n, string_agg(substr(text, p + 1, "start" - p) || {replacement}, '' ORDER BY "start") || substr(any_value(text), max("end") + 1) AS output FROM v GROUP BY doc_id),
done AS (SELECT doc_id, coalesce(n, 0)::INTEGER AS n, coalesce(output, text) AS output FROM {source} LEFT JOIN t USING (doc_id))"""


TOKEN_SQL = f"'{OPEN}' || regexp_replace(rule_id, '[^A-Za-z0-9_-]', '-', 'g') || ':' || substr(sha256(value), 1, 12) || '{CLOSE}'"


def valued(with_: str) -> str:
    return f'{with_}, x AS (SELECT m.*, text, substr(text, "start" + 1, "end" - "start") AS value FROM m JOIN {DOCS} USING (doc_id))'


def action(actions: dict[str, str]) -> str:
    return "CASE class " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in actions.items()) + " ELSE 'redact' END"


LINES = "(SELECT doc_id, i::INTEGER AS line, l[i] AS text FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, regexp_split_to_array(text, '\\r?\\n') AS l FROM documents)))"
LINE_NO = """(length(substr(text, 1, "start")) - length(replace(substr(text, 1, "start"), chr(10), '')) + 1)::INTEGER"""
HITS = f"""d AS (SELECT * FROM {values("detections")}), l AS (SELECT * FROM {values("labels")})"""
FAMILY = "(d.class = l.class OR (starts_with(d.class, 'pii_') AND starts_with(l.class, 'pii_')))"
# One-to-one claims are a fold over a file's detections; recursion stands for it here.
OUTCOMES = f"""{HITS},
lo AS (SELECT *, min(ordinal) OVER (PARTITION BY file, class) AS f FROM l),
n AS (SELECT runner, file, "start", "end", class, row_number() OVER (PARTITION BY runner, file ORDER BY "start", "end", class) AS k FROM d),
c AS (SELECT runner, file, 0::BIGINT AS k, []::INTEGER[] AS claimed, NULL::INTEGER AS hit FROM (SELECT DISTINCT runner FROM d), (SELECT file FROM l UNION SELECT file FROM d)
  UNION ALL SELECT c.runner, c.file, n.k, CASE WHEN h IS NULL THEN claimed ELSE list_append(claimed, h) END, h FROM c JOIN n ON n.runner = c.runner AND n.file = c.file AND n.k = c.k + 1,
    LATERAL (SELECT (SELECT arg_min(lo.ordinal, lo.f * 1000 + lo.ordinal) FROM lo WHERE lo.file = n.file AND variant = 'real' AND NOT list_contains(c.claimed, lo.ordinal) AND least(n."end", lo."end") > greatest(n."start", lo."start") AND (n.class = lo.class OR (starts_with(n.class, 'pii_') AND starts_with(lo.class, 'pii_')))) AS h)),
known AS (SELECT unnest({list(scoring.CLASSES)}) AS class),
bait AS (SELECT n.runner, n.file, n.k, arg_min(l.class, l.ordinal) AS class FROM n JOIN l ON l.file = n.file AND variant <> 'real' AND least(n."end", l."end") > greatest(n."start", l."start") GROUP BY ALL),
o AS (SELECT n.runner, n.file, CASE WHEN c.hit IS NOT NULL THEN l.class WHEN coalesce(b.class, n.class) IN (SELECT class FROM known) THEN coalesce(b.class, n.class) ELSE 'secrets' END AS class,
    CASE WHEN c.hit IS NOT NULL THEN 'tp' ELSE 'fp' END AS outcome, c.hit IS NOT NULL AND l."start" = n."start" AND l."end" = n."end" AS exact, c.hit IS NULL AND b.class IS NOT NULL AS lookalike
  FROM n JOIN c USING (runner, file, k) LEFT JOIN l ON l.ordinal = c.hit LEFT JOIN bait b ON b.runner = n.runner AND b.file = n.file AND b.k = n.k
  UNION ALL SELECT z.runner, l.file, l.class, 'fn', FALSE, FALSE FROM (SELECT runner, file, arg_max(claimed, k) AS claimed FROM c GROUP BY ALL) z JOIN l USING (file) WHERE variant = 'real' AND NOT list_contains(claimed, l.ordinal))"""
ROTATED = f"""v AS (SELECT token, coalesce(new_value, value) AS value, first_seen FROM {values("vault")} LEFT JOIN {values("rotations")} USING (token))"""
PARSED = f"""p AS (SELECT doc_id, text, m, g, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, text, regexp_extract_all(text, {text_literal(TOKEN)}, 0) AS m, regexp_split_to_array(text, {text_literal(TOKEN)}) AS g FROM {values("tokenised")})),
k AS (SELECT doc_id, text, m[i] AS raw, regexp_extract(m[i], {text_literal(TOKEN)}, 1) AS slug, regexp_extract(m[i], {text_literal(TOKEN)}, 2) AS id,
  (coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::INTEGER AS "start" FROM p)"""
RESTORED = f"""{PARSED},
r AS (SELECT k.*, "start" + length(raw) AS "end", value, lag("start" + length(raw), 1, 0) OVER (PARTITION BY doc_id ORDER BY "start") AS q FROM k LEFT JOIN {values("vault")} v ON v.token = k.raw),
t AS (SELECT doc_id, count(*) AS n, count(*) FILTER (value IS NULL) AS lost, list_sort(list(DISTINCT raw) FILTER (value IS NULL)) AS missing,
  string_agg(substr(text, q + 1, "start" - q) || coalesce(value, raw), '' ORDER BY "start") || substr(any_value(text), max("end") + 1) AS output FROM r GROUP BY doc_id)"""


def ignored() -> str:
    out = "FALSE"
    for glob in (*IGNORED, "*.log", "!keep.log", "docs/**/draft"):
        pattern, back = ignore_pattern(glob)
        out = f"CASE WHEN regexp_matches(path, {text_literal(pattern)}) THEN {str(not back).upper()} ELSE {out} END"
    return out


def screened() -> str:
    out = "NULL"
    for name, pattern in reversed(commands.FALLBACK):
        out = f"CASE WHEN regexp_matches(command, {text_literal(pattern)}) THEN '{name}' ELSE {out} END"
    return out


def scalar(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) = 0 THEN 0 ELSE ({a})::DOUBLE / ({b}) END"


P_, R_ = scalar("tp", "tp + fp"), scalar("tp", "tp + fn")
TUNED = detected(values("tuned_texts"), q.TUNED.rules())
RULES = detected(values("rule_texts"), tuple(SECRET_RULES))
LOG = values("log")
#: The secrets of a scenario are stated beside it, so hiding them needs no detection here.
HIDDEN = f"""v AS (SELECT *, replace(original, find, replacement) AS edited, replace(replace(replace(original, split_part(secrets, '|', 1), 'HIDDEN'), split_part(secrets, '|', 2), 'HIDDEN'), find, replacement) AS masked FROM {values("scenarios")}),
survived AS (SELECT name AS scenario, 'token' AS config, true AS completed, edited = expected AS byte_correct, true AS no_leak FROM v UNION ALL SELECT name, 'constant', true, masked = expected, true FROM v
UNION ALL SELECT name, 'open', true, edited = expected, secrets = '' FROM v UNION ALL SELECT name, 'denied', false, true, true FROM v)"""
DEFAULT = merge_policy(None)["actions"]
GREP_SOURCE = f"(SELECT doc_id * 1000000 + line AS doc_id, text FROM {LINES} WHERE regexp_matches(text, '{q.GREP}'))"
CHUNKS = """(SELECT doc_id * 100000000 + c AS doc_id, substr(text, c + 1, 4096) AS text FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text) - 128 - 1, 0) + 1, 4096 - 128)) AS c FROM documents))"""
CHUNK_SPANS = f"""WITH {detected(CHUNKS, PII_RULES)}, moved AS (SELECT DISTINCT doc_id // 100000000 AS doc_id, "start" + doc_id % 100000000 AS "start", "end" + doc_id % 100000000 AS "end", class, rule_id FROM m WHERE "end" - "start" <= 128)
SELECT *, CASE rule_id WHEN 'pii-email' THEN 0 WHEN 'pii-ssn' THEN 1 WHEN 'pii-card' THEN 2 ELSE 3 END AS ordinal FROM moved"""
AUDIT_JSON = """length(to_json({'ts': ts, 'ruleId': "ruleId", 'tool': tool, 'action': action, 'valueHash': "valueHash", 'context': {'note': repeat('x', note_len)}})) + 1"""

ORACLE_SQL: dict[str, str] = {
    **{f"{r.rule_id.replace('-', '_')}_spans": f"SELECT doc_id, \"start\", \"end\", value FROM ({rule_spans(values('texts') if r.rule_id == 'pii-ssn' else DOCS, r, 0)})" for r in PII_RULES},
    "rule_hits": f"WITH {RULES} SELECT doc_id, rule_id, \"start\", \"end\", substr(text, \"start\" + 1, \"end\" - \"start\") AS value FROM m JOIN {values('rule_texts')} USING (doc_id)",
    "generic_credential_spans": f"SELECT doc_id, \"start\", \"end\", value FROM ({rule_spans(f'(SELECT * FROM {DOCS} UNION ALL SELECT * FROM ' + values('credentials') + ')', SECRET_RULES[-1], 0)})",
    "secret_scan": f'WITH {FULL} SELECT doc_id, "start", "end", class, rule_id FROM m',
    "entropy_scores": f"SELECT value, round({entropy('value')}, 6) AS entropy FROM {values('values')}",
    "merge_spans": f"WITH {merged('SELECT * FROM ' + values('spans'))} SELECT * FROM m",
    "redact_text": f"WITH {spliced(PII, TOKEN_SQL)} SELECT doc_id, n AS n_spans, output FROM done",
    "redact_constant": f"WITH {spliced(PII, text_literal('[REDACTED]'))} SELECT doc_id, output FROM done",
    "policy_actions": f"SELECT doc_id, \"start\", {action(DEFAULT)} AS action FROM {values('spans')}",
    "block_cutoff": f"""WITH {FULL}, a AS (SELECT *, {action(q.BLOCKING)} AS action FROM m), b AS (SELECT *, min("start") FILTER (action = 'block') OVER (PARTITION BY doc_id) AS stop FROM a)
SELECT doc_id, "start", rule_id AS "ruleId", action FROM b WHERE action <> 'allow' AND (stop IS NULL OR "start" <= stop)""",
    "audit_summary": f"SELECT a.action, count(l.action) AS n FROM (SELECT unnest({list(audit.ACTIONS)}) AS action) a LEFT JOIN {LOG} l USING (action) GROUP BY a.action UNION ALL SELECT 'total', count(*) FROM {LOG}",
    "audit_tail": f'SELECT ts, "ruleId", action FROM {LOG} ORDER BY ts DESC, "ruleId" DESC, "valueHash" DESC LIMIT 4',
    "audit_bound": f"""WITH a AS (SELECT *, {AUDIT_JSON} > {audit.MAX_LINE} AS long FROM {LOG})
SELECT ts, "ruleId", action, CASE WHEN long THEN 'true' ELSE '' END AS truncated, CASE WHEN long THEN 0 ELSE note_len END AS note_len FROM a UNION ALL SELECT ts, 'audit-truncate', 'truncate', '', 0 FROM a WHERE long""",
    "token_parse": f'WITH {PARSED} SELECT doc_id, raw, slug, id, "start", "start" + length(raw)::INTEGER AS "end" FROM k',
    "token_mint_dedupe": f"""WITH {valued(PII)}, f AS (SELECT value, arg_min(rule_id, doc_id * 100000000 + "start") AS rule_id, min(doc_id) AS first_doc, count(*) AS sightings FROM x GROUP BY value)
SELECT {TOKEN_SQL} AS token, value, sha256(value) AS value_hash, rule_id, first_doc, sightings FROM f""",
    "token_restore": f"WITH {RESTORED} SELECT doc_id, coalesce(output, text) AS output, coalesce(n, 0) AS n_tokens, CASE WHEN coalesce(lost, 0) > 0 THEN 'deny' ELSE 'allow' END AS decision FROM {values('tokenised')} LEFT JOIN t USING (doc_id)",
    "token_missing_deny": f"WITH {RESTORED} SELECT doc_id, array_to_string(missing, ',') AS missing FROM t WHERE lost > 0",
    "round_trip": "SELECT doc_id, sha256(text) AS restored_sha256 FROM documents",
    "mint_incremental": f"""WITH f AS (SELECT value, arg_min(rule_id, seen) AS rule_id FROM {values("sightings")} WHERE value NOT IN (SELECT value FROM {values("vault")}) GROUP BY value)
SELECT token, value, rule_id FROM {values("vault")} UNION ALL SELECT {TOKEN_SQL} AS token, value, rule_id FROM f""",
    "vault_rotate": f"WITH {ROTATED} SELECT token, value, sha256(value) AS value_hash FROM v",
    "vault_owners": f"WITH {ROTATED} SELECT sha256(value) AS value_hash, arg_min(token, first_seen) AS token FROM v GROUP BY value",
    "vault_lru_evict": f"SELECT token, row_number() OVER (ORDER BY last_used DESC, token DESC) > 3 AS evicted FROM {values('vault')}",
    "vault_stats": f"SELECT count(*) AS entries, min(first_seen) AS created FROM {values('vault')}",
    "grep_lines": f"WITH {spliced(detected(GREP_SOURCE, q.FULL.rules(), q.FULL.allow), TOKEN_SQL, GREP_SOURCE)} SELECT doc_id // 1000000 AS doc_id, (doc_id % 1000000)::INTEGER AS line, output AS text FROM done",
    "grep_limit": f"SELECT doc_id, line, count(*) OVER () >= 5 AS truncated FROM (SELECT doc_id, line FROM {LINES} WHERE regexp_matches(text, '{q.GREP}') ORDER BY doc_id, line LIMIT 5)",
    "line_split": f"SELECT doc_id, count(*) AS n_lines, max(length(text))::INTEGER AS longest FROM {LINES} GROUP BY doc_id",
    "line_numbers": f'WITH {valued(PII)} SELECT doc_id, "start", {LINE_NO} AS line FROM x',
    "rule_summary": f"WITH {valued(PII)}, n AS (SELECT doc_id, rule_id, {LINE_NO} AS line FROM x) SELECT doc_id, rule_id, count(*) AS count, string_agg(line::VARCHAR, ',' ORDER BY line) AS lines FROM n GROUP BY doc_id, rule_id",
    "chunk_scan_dedup": f'WITH {merged(CHUNK_SPANS)} SELECT doc_id, "start"::INTEGER AS "start", "end"::INTEGER AS "end", rule_id FROM m',
    "allowlist_anti": f"""WITH {valued(PII)} SELECT doc_id, "start", value FROM x WHERE NOT regexp_matches(value, {text_literal(q.ALLOWED_VALUES)})""",
    "env_key_parse": f"""SELECT DISTINCT key FROM (SELECT regexp_extract(line, '^(?:export\\s+)?([A-Za-z_][A-Za-z0-9_]*)\\s*=', 1) AS key FROM (SELECT trim(unnest(regexp_split_to_array(text, '\\r?\\n'))) AS line FROM {values("env_files")}) WHERE line <> '' AND NOT starts_with(line, '#')) WHERE key <> ''""",
    "tuned_spans": f"WITH {TUNED} SELECT doc_id, rule_id, \"start\", \"end\", substr(text, \"start\" + 1, \"end\" - \"start\") AS value FROM m JOIN {values('tuned_texts')} USING (doc_id)",
    "naive_scan": f'SELECT doc_id, "start", "end" FROM ({rule_spans(DOCS, q.NAIVE, 0)})',
    "score_candidates": f"""WITH {HITS} SELECT runner, d.file, d."start" AS d_start, l."start" AS l_start, l.class, round((least(d."end", l."end") - greatest(d."start", l."start")) / (greatest(d."end", l."end") - least(d."start", l."start"))::DOUBLE, 6) AS iou
FROM d JOIN l ON d.file = l.file AND variant = 'real' AND least(d."end", l."end") > greatest(d."start", l."start") AND {FAMILY}""",
    "score_benign_semi": f"""WITH {HITS} SELECT runner, file, "start", "end" FROM d WHERE EXISTS (SELECT 1 FROM l WHERE l.file = d.file AND variant <> 'real' AND least(d."end", l."end") > greatest(d."start", l."start"))""",
    "score_fn_anti": f"WITH RECURSIVE {OUTCOMES} SELECT runner, class, count(*) AS n FROM o WHERE outcome = 'fn' GROUP BY runner, class",
    "score_rollup": f"""WITH RECURSIVE {OUTCOMES}, s AS (SELECT runner, coalesce(class, 'overall') AS class, count(*) FILTER (outcome = 'tp') AS tp, count(*) FILTER (outcome = 'fp') AS fp, count(*) FILTER (outcome = 'fn') AS fn
FROM o WHERE class IN (SELECT class FROM known) GROUP BY ROLLUP (runner, class) HAVING runner IS NOT NULL),
r AS (SELECT *, {P_} AS p, {R_} AS r FROM s)
SELECT runner, class, tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round({scalar("2 * p * r", "p + r")}, 6) AS f1 FROM r""",
    "score_rates": f"""WITH RECURSIVE {OUTCOMES}, z AS (SELECT runner, count(*) FILTER (lookalike) AS l, count(*) FILTER (outcome = 'tp') AS tp, count(*) FILTER (exact) AS e, (SELECT count(*) FROM l WHERE variant <> 'real') AS b FROM o GROUP BY runner)
SELECT runner, round({scalar("l", "b")}, 6) AS lookalike_rate, round({scalar("e", "tp")}, 6) AS exact_rate, round({scalar("tp - e", "tp")}, 6) AS partial_rate FROM z""",
    "percentile_nearest_rank": """SELECT o_orderpriority, x[least(n - 1, n * 50 // 100) + 1] AS p50, x[least(n - 1, n * 95 // 100) + 1] AS p95, x[least(n - 1, n * 99 // 100) + 1] AS p99
FROM (SELECT o_orderpriority, list(o_totalprice::DOUBLE ORDER BY o_totalprice) AS x, count(*) AS n FROM orders GROUP BY o_orderpriority)""",
    "throughput": f"SELECT runner, round(CASE WHEN bytes > 0 AND ms > 0 THEN bytes / 1048576.0::DOUBLE / (ms / 1000) ELSE 0 END, 6) AS mb_s FROM {values('runs')}",
    "guard_regex_fallback": f"SELECT command, CASE WHEN rule_id IS NULL THEN 'allow' ELSE 'deny' END AS decision, rule_id FROM (SELECT command, {screened()} AS rule_id FROM {values('commands')})",
    "doctor_missing_rules": f"SELECT rule FROM {values('required')} EXCEPT SELECT rule FROM {values('present')}",
    "survivability": f"WITH {HIDDEN} SELECT * FROM survived",
    "survival_by_config": f"WITH {HIDDEN} SELECT config, count(*) AS total, count(*) FILTER (completed AND byte_correct AND no_leak) AS all_three FROM survived GROUP BY config",
    "health_check": f"""WITH g AS (SELECT string_agg(rule, ', ' ORDER BY rule) AS gone FROM (SELECT rule FROM {values('required')} EXCEPT SELECT rule FROM {values('present')}))
SELECT 'rules' AS name, CASE WHEN gone IS NULL THEN 'pass' ELSE 'fail' END AS status, coalesce('missing: ' || gone, 'all rules present') AS detail FROM g
UNION ALL SELECT 'vault', CASE WHEN count(*) >= 4.5 THEN 'warn' ELSE 'pass' END, count(*) || ' of 5' FROM {values('vault')}
UNION ALL VALUES ('policy', 'pass', 'version 1'), ('steps', 'fail', 'missing: wipe'), ('recogniser', 'warn', 'doesn''t answer: names aren''t found')""",
    "status_report": f"""SELECT part, item, value FROM (VALUES ('policy', 'version', '1'), ('policy', 'fail_closed', 'true'), ('detection', 'secrets', 'true'), ('detection', 'fast_pii', 'true'), ('detection', 'ner', 'false'),
('action', 'secrets', 'redact'), ('action', 'pii_customer', 'redact'), ('action', 'pii_internal', 'alert'), ('action', 'internal_hostnames', 'redact'), ('tune', 'env_keys_from', '1'), ('tune', 'internal_domains', '0'), ('tune', 'custom_patterns', '0')) AS t(part, item, value)
UNION ALL SELECT 'vault', 'entries', count(*)::VARCHAR FROM {values('vault')} UNION ALL SELECT 'vault', 'created', min(first_seen)::VARCHAR FROM {values('vault')}
UNION ALL SELECT 'audit', a.action, count(l.action)::VARCHAR FROM (SELECT unnest({list(audit.ACTIONS)}) AS action) a LEFT JOIN {LOG} l USING (action) GROUP BY a.action UNION ALL SELECT 'audit', 'total', count(*)::VARCHAR FROM {LOG}""",
    "score_report": f"""WITH RECURSIVE {OUTCOMES}, s AS (SELECT runner, coalesce(class, 'overall') AS class, count(*) FILTER (outcome = 'tp') AS tp, count(*) FILTER (outcome = 'fp') AS fp, count(*) FILTER (outcome = 'fn') AS fn
FROM o WHERE class IN (SELECT class FROM known) GROUP BY ROLLUP (runner, class) HAVING runner IS NOT NULL), r AS (SELECT *, {P_} AS p, {R_} AS r FROM s)
SELECT runner, class, '| ' || concat_ws(' | ', runner, class, tp, fp, fn, printf('%.1f%%', 100.0::DOUBLE * p), printf('%.1f%%', 100.0::DOUBLE * r), printf('%.1f%%', 100.0::DOUBLE * ({scalar("2 * p * r", "p + r")}))) || ' |' AS line FROM r""",
    "vault_audit": f"""SELECT 'rewrite' AS action, token, substr(sha256(new_value), 1, 12) AS hash, substr(sha256(value), 1, 12) AS context FROM {values('vault')} JOIN {values('rotations')} USING (token)
UNION ALL SELECT 'evict', token, NULL, 'lru-cap' FROM (SELECT token, row_number() OVER (ORDER BY last_used DESC, token DESC) AS n FROM {values('vault')}) WHERE n > 3""",
    "size_routing": "SELECT doc_id, CASE WHEN strlen(text) > 5000 THEN 'summary' ELSE 'content' END AS kind FROM documents",
    "byte_slice": r"""WITH s AS (SELECT doc_id, substr(lower(hex(encode(text))), 201, 160) AS slice_hex FROM documents)
SELECT doc_id, slice_hex, len(regexp_extract_all(regexp_replace(slice_hex, '(..)', '\1 ', 'g'), '([0-7]. )|([cd]. [89ab]. )|(e. [89ab]. [89ab]. )|(f. [89ab]. [89ab]. [89ab]. )')) AS n_whole FROM s""",
    "binary_filter": f"SELECT doc_id FROM {values('blobs')} WHERE NOT regexp_matches(substr(hex, 1, 16384), '^(..)*?00')",
    "ignore_prune": f"SELECT path FROM {values('paths')} WHERE NOT {ignored()}",
    "request_parse": f"""SELECT doc_id, CASE WHEN json_valid(payload) THEN payload ->> '$.tool_name' END AS tool, CASE WHEN json_valid(payload) THEN payload ->> '$.tool_input.command' END AS command, CASE WHEN json_valid(payload) THEN 'allow' ELSE 'deny' END AS decision FROM {values("requests")}""",
    "report_offsets": f"""SELECT runner, file, (instr(text, value) - 1)::INTEGER AS "start", (instr(text, value) - 1 + length(value))::INTEGER AS "end", class FROM {values("reports")} JOIN {values("report_texts")} USING (file) WHERE instr(text, value) > 0""",
    "ner_merge": "WITH " + merged(f"""SELECT doc_id, "start", "end", CASE WHEN entity_type IN ('IP_ADDRESS', 'URL') THEN 'pii_internal' ELSE 'pii_customer' END AS class, 'ner:' || entity_type AS rule_id, 0 AS ordinal FROM {values("entities")} WHERE "start" IS NOT NULL AND "end" > "start" """) + " SELECT * FROM m",
    "aes_roundtrip": f"SELECT token, value FROM {values('vault')}",
    "streaming_redact": f"WITH {spliced(PII, TOKEN_SQL)} SELECT doc_id, n AS n_spans, output FROM done",
}
