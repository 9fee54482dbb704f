"""For each query the SQL that must give the same rows on the same tables.

The patterns are the engine's own constants (they are the specification); everything
else is written independently. Queries without an entry are sequential rules that SQL
cannot follow on whole tables; the tests compare those with brute force.
"""

from __future__ import annotations

from ..functions import classify, keys, mask, measure, parse, redact

ORACLES: dict[str, str] = {}


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def re2(pattern: str) -> str:
    """Flags of the Java dialect to those of RE2 (where U means something else)."""
    if pattern.startswith("(?iU)"):
        pattern = "(?i)" + pattern[5:]
    return pattern.removeprefix("(?U)")


def wide(pattern: str) -> str:
    """Word characters of any script, as in the engine's patterns."""
    return re2(pattern).replace("[\\w", "[\\pL\\pN_").replace("\\w", "[\\pL\\pN_]")


def has(col: str, pattern: str) -> str:
    return f"regexp_matches({col}, {lit(re2(pattern))})"


def part(col: str, pattern: str, group: int = 1) -> str:
    """First match, null without one."""
    return f"CASE WHEN {has(col, pattern)} THEN regexp_extract({col}, {lit(re2(pattern))}, {group}) END"


def swap(col: str, pattern: str, to: str) -> str:
    return f"regexp_replace({col}, {lit(re2(pattern))}, {lit(to)}, 'g')"


def cases(col: str, rules: list[tuple[str, str]], default: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {has(col, '(?iU)' + p)} THEN {v}" for p, v in rules) + f" ELSE {default} END"


ACT = """act AS (SELECT 'activity' AS source_id, event_id AS event_no, ts, epoch_us(ts) // 1000000 AS sec,
  'svc-' || (user_id % 7) AS service, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level,
  event_type AS template_id, user_id || '-' || strftime(ts, '%Y%m%d') AS trace_id, value AS value_ms,
  CAST(json_extract(props, '$.k') AS DOUBLE) AS amount, event_type || ' by user ' || user_id AS text, user_id FROM events)"""

LINES = """lines AS (SELECT event_id AS line_no, ts, strftime(ts, '%Y-%m-%d %H:%M:%S')
  || CASE WHEN event_type = 'error' THEN ' ERROR' ELSE ' INFO' END || ' shop.web: [' || event_type || '] '
  || CASE event_type WHEN 'error' THEN 'request failed: connection refused by http://db-' WHEN 'signup' THEN 'request received from http://app-'
     WHEN 'purchase' THEN 'payment completed via http://pay-' ELSE 'page served to http://cdn-' END
  || (user_id % 5) || ':8080/x run_id=u' || user_id || '-' || strftime(ts, '%Y%m%d') || ' total_tokens='
  || json_extract_string(props, '$.k') || ' in ' || CAST(value AS VARCHAR) || 'ms' AS payload FROM events)"""

DOCS = """docs AS (SELECT source AS source_id, doc_id * 1000000 + i AS line_no, l[i + 1] AS payload
  FROM (SELECT doc_id, source, l, unnest(range(len(l))) AS i FROM (SELECT doc_id, source, string_split(text, chr(10)) AS l FROM documents)))"""

MIXED = """mixed AS (SELECT 'web-' || (user_id % 3) AS source_id, event_id AS line_no, (event_id * 7 + user_id) % 12 AS kind, user_id, event_type,
  strftime(ts, '%H:%M:%S') AS stamp,
  CASE (event_id * 7 + user_id) % 12
   WHEN 0 THEN '  File "shop/cart' || user_id || '.py", line 12, in add'
   WHEN 1 THEN '    at shop.Cart.add(Cart.java:' || user_id || ')'
   WHEN 2 THEN 'ValueError: bad item ' || user_id
   WHEN 3 THEN strftime(ts, '%H:%M:%S') || ' INFO shop.web: │ item ' || user_id
   WHEN 4 THEN strftime(ts, '%H:%M:%S') || ' INFO shop.web: ┌ cart of ' || user_id
   WHEN 5 THEN '{"level":"warn","msg":"slow answer","userNo":' || user_id || ',"took":"long"}'
   WHEN 6 THEN ''
   ELSE strftime(ts, '%H:%M:%S') || CASE WHEN event_type = 'error' THEN ' ERROR shop.web: ' ELSE ' INFO shop.web: ' END
     || CASE event_type WHEN 'signup' THEN 'request received from user ' WHEN 'purchase' THEN 'response sent to user '
        WHEN 'error' THEN 'lookup failed, retry for user ' WHEN 'view' THEN 'retrieve page for user ' ELSE 'parsing input of user ' END || user_id
  END AS payload FROM events)"""

# message, level and clock of the mixed lines, by their kind
MIXED_PARSED = MIXED + """, parsed AS (SELECT *,
  CASE WHEN kind = 5 THEN 'WARN slow answer userNo=' || user_id || ' took=long' WHEN kind IN (3, 4) OR kind > 6 THEN payload[10:] ELSE trim(payload) END AS message,
  CASE WHEN kind = 2 THEN 'ERROR' WHEN kind = 5 THEN 'WARN' WHEN kind > 6 AND event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level,
  CASE WHEN kind IN (3, 4) OR kind > 6 THEN stamp END AS clock, kind IN (0, 1, 2, 3) AS is_cont FROM mixed WHERE payload <> '')"""

P = f"WITH {ACT}"
L = f"WITH {LINES}"
D = f"WITH {DOCS}"
M = f"WITH {MIXED_PARSED}"


# ------------------------------------------------------------------ sources

ORACLES["read_log_lines"] = f"{L} SELECT 'web' AS service, payload FROM lines"
ORACLES["truncate_long_lines"] = "SELECT doc_id, md5(CASE WHEN length(text) > 2000 THEN left(text, 2000) || '…[truncated]' ELSE text END) AS digest FROM documents"
ORACLES["limit_backfill"] = f"""{D} SELECT source_id, count(*) AS n_lines, min(line_no) AS first_line FROM (
  SELECT *, sum(strlen(payload) + 1) OVER (PARTITION BY source_id ORDER BY line_no DESC) AS tail FROM docs) WHERE tail <= 50000 GROUP BY 1"""
ORACLES["combine_sources"] = f"""WITH {LINES}, {DOCS} SELECT 'p1' AS project_id, 'activity' AS source_id, count(*) AS n_lines FROM lines
  UNION ALL SELECT 'p1', source_id, count(*) FROM docs GROUP BY source_id"""
VENDOR = P + """, v AS (SELECT *, CASE event_no % 3 WHEN 0 THEN 'pay-uat-' WHEN 1 THEN 'prod-' ELSE 'x-' END || service AS svc,
  CASE WHEN event_no % 5 = 0 THEN 'blue' WHEN event_no % 3 = 0 THEN 'UAT?' WHEN event_no % 3 = 1 THEN 'PROD?' ELSE '' END AS env FROM act)"""
ORACLES["normalize_connector_rows"] = VENDOR + """ SELECT event_no, CASE WHEN level = 'ERROR' THEN 'ERROR ' ELSE '' END || 'trace=' || trace_id || ' ' || text
  || ' http.route=/a_b/' || template_id || CASE WHEN contains(text, 'k') THEN '' ELSE ' k=' || CAST(amount AS INT) END AS payload,
  svc AS service, env AS host, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS collected_at FROM v"""
ORACLES["infer_environment"] = VENDOR + " SELECT svc AS service, env AS host, count(*) AS records FROM v GROUP BY 1, 2"
ORACLES["query_logs"] = P + " SELECT event_no, text AS payload FROM act WHERE service = 'svc-3' AND ts >= '2024-01-05' AND contains(text, 'error by') ORDER BY event_no DESC LIMIT 200"
ORACLES["list_services"] = P + " SELECT service, count(*) AS records FROM act WHERE ts >= '2024-01-10' GROUP BY 1"
ORACLES["fair_share_sample"] = P + """ SELECT service, event_no FROM (SELECT service, event_no, row_number() OVER (PARTITION BY service ORDER BY event_no DESC) AS r,
  (SELECT greatest(20, 500 // count(DISTINCT service)) FROM act) AS share FROM act) WHERE r <= share"""
ORACLES["dedup_polled"] = P + " SELECT DISTINCT strftime(ts, '%Y-%m-%d %H:%M') AS collected_at, text AS payload FROM act"
ORACLES["parse_tabular_reply"] = P + """ SELECT trace_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || CASE WHEN level = 'ERROR' THEN ' ERROR ' ELSE ' INFO ' END || template_id
  || CASE WHEN level = 'ERROR' THEN ' failed' ELSE ' completed' END || ' in ' || CAST(value_ms AS VARCHAR) || 'ms'
  || CASE WHEN level = 'ERROR' THEN ' error=Timeout' ELSE '' END || ' trace_id=t' || event_no AS payload FROM act"""
ORACLES["flatten_record"] = "SELECT o_orderkey, 'priority=' || replace(o_orderpriority, ' ', '_') || ' states=' || o_orderstatus || ',x customer=' || o_custkey AS pairs FROM orders"
ORACLES["select_reply_lines"] = "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS row_no, md5(text) AS digest FROM conversations"
ORACLES["enrich_with_detail"] = """SELECT o_orderkey, 'INFO order completed priority=' || left(o_orderpriority, 1) || ' trace_id=o' || o_orderkey
  || CASE WHEN o_orderkey % 2 = 0 THEN ' customer=' || o_custkey || ' model=m' || o_orderstatus ELSE '' END AS payload FROM orders"""
ORACLES["merge_counts"] = P + " SELECT template_id, sec // 60 * 60 AS minute_s, count(*) AS n_events FROM act GROUP BY 1, 2"

# ------------------------------------------------------------------ lines

ORACLES["parse_lines"] = L + """ SELECT line_no, payload[1:10] AS ts_date, payload[12:19] AS clock, epoch_us(ts) // 1000000 AS ts_s,
  CASE WHEN payload[21:25] = 'ERROR' THEN 'ERROR' ELSE 'INFO' END AS level, payload[21:] AS message FROM lines"""
ORACLES["parse_mixed_lines"] = M + " SELECT line_no, clock, level, message FROM parsed"
ORACLES["strip_ansi"] = "SELECT conv_id, turn, md5(role || ' ' || text) AS digest FROM conversations"
ORACLES["line_predicates"] = M + " SELECT line_no, is_cont, kind IN (3, 4) AS is_noise FROM parsed"
ORACLES["redact_emails"] = f"""SELECT doc_id, len(regexp_extract_all(text, {lit(redact.EMAIL)})) AS emails,
  md5({swap('text', redact.EMAIL, '<EMAIL>')}) AS digest FROM documents"""


def masked(col: str) -> str:
    out = col
    for pattern, to in mask.MASKS:
        out = f"regexp_replace({out}, {lit(wide(pattern))}, {lit(to.replace('$', chr(92)))}, 'g')"
    out = f"trim(regexp_replace({out}, '[\\s\\x{{0b}}\\x{{1c}}-\\x{{1f}}\\x{{85}}\\x{{a0}}]+', ' ', 'g'))"
    return f"CASE WHEN {out} = '' THEN '<EMPTY>' ELSE {out} END"


ORACLES["mask_lines"] = f"{L} SELECT {masked('payload')} AS mask, count(*) AS n_lines FROM lines GROUP BY 1"
ORACLES["mask_documents"] = f"{D} SELECT line_no, md5({masked('payload')}) AS digest FROM docs"
ORACLES["extract_durations"] = L + " SELECT line_no, CAST(regexp_extract(payload, ' in ([0-9.]+)ms', 1) AS DOUBLE) AS value_ms, CASE WHEN contains(payload, ' ERROR ') THEN 'error' ELSE 'info' END || ' shop web' AS operation FROM lines"
ORACLES["extract_costs"] = L + " SELECT line_no, 'overall:total_tokens' AS label, CAST(regexp_extract(payload, 'total_tokens=([0-9]+)', 1) AS DOUBLE) AS amount FROM lines"
ORACLES["extract_keys"] = f"""{L} SELECT line_no, coalesce({', '.join(part('payload', p) for p in keys.KEYS)}) AS key, {has('payload', keys.UNKEYED_OPEN)} AS opens,
  {has('payload', keys.UNKEYED_CLOSE)} AS closes, {has('payload', keys.GENERIC_END)} AS ends, {has('payload', keys.HARD_CLOSERS)} AS hard FROM lines"""
ORACLES["to_seconds"] = P + " SELECT event_no, CAST(sec % 86400 AS DOUBLE) AS clock_s, epoch_us(ts) AS instant_us, CAST(NULL AS DOUBLE) AS none_s FROM act"
ORACLES["component_of"] = f"""{L} SELECT lower({part('payload', keys.TAG)}) AS component, lower({part("regexp_replace(payload, '" + chr(92) + "[.*" + chr(92) + "] ', '')", keys.LOGGER)}) AS logger,
  count(*) AS n_lines FROM lines GROUP BY 1, 2"""
ORACLES["infer_components"] = f"""{L} SELECT {cases("split_part(payload, '] ', 2)", [(p, lit(n)) for p, n in classify.COMPONENTS], "'Other'")} AS component,
  count(*) AS n_lines FROM lines GROUP BY 1"""
ORACLES["name_components"] = L + " SELECT CASE WHEN t = 'error' THEN 'runtime' ELSE t END AS component, count(*) AS n_lines FROM (SELECT regexp_extract(payload, '\\[(\\w+)\\]', 1) AS t FROM lines) GROUP BY 1"
ANNOTATED = M + f""", a AS (SELECT *, {cases('message', [(p, str(i)) for i, (p, *_) in enumerate(classify.TRANSITIONS)])} AS tr,
  {cases('message', [(p, lit(k)) for p, k, _ in classify.BRANCHES])} AS kind_, {has('message', '(?iU)' + classify.RUN_START)} AS is_start,
  {has('message', '(?iU)' + classify.COMPLETION)} AS said_done,
  CASE WHEN level IN ('ERROR', 'WARN') THEN {cases('message', [(p, lit(c)) for p, c, _ in classify.CAUSES])} END AS cause,
  {cases('message', [(p, lit(n)) for p, n in classify.COMPONENTS], "'Other'")} AS component FROM parsed),
 t(tr, stage, status, label) AS (VALUES {', '.join(f"({i}, {lit(s) if s else 'NULL'}, {lit(x)}, {lit(lb)})" for i, (_, s, x, lb) in enumerate(classify.TRANSITIONS))}),
 ann AS (SELECT a.*, stage, status, label, coalesce(stage = 'response' AND status = 'completed', false) OR said_done AS is_end FROM a LEFT JOIN t USING (tr))"""
ORACLES["infer_transitions"] = ANNOTATED + " SELECT stage, status, label, is_start, is_end, count(*) AS n_lines FROM ann GROUP BY ALL"
ORACLES["infer_causes"] = f"""{L} SELECT CASE WHEN contains(payload, ' ERROR ') THEN {cases('payload', [(p, lit(c)) for p, c, _ in classify.CAUSES])} END AS cause,
  CASE WHEN contains(payload, ' ERROR ') THEN {cases('payload', [(p, str(len(f))) for p, _, f in classify.CAUSES])} END AS n_fixes,
  concat_ws('|', {', '.join(f"CASE WHEN {has('payload', '(?i)' + p)} THEN {lit(h)} END" for p, h in classify.HINTS)}) AS hints, count(*) AS n_lines FROM lines GROUP BY ALL"""
ORACLES["detect_branches"] = ANNOTATED + f""" SELECT kind_ AS kind, CASE kind_ {' '.join(f'WHEN {lit(k)} THEN {lit(lb)}' for _, k, lb in classify.BRANCHES)} END AS label,
  CASE WHEN {has('message', '(?iU)' + classify.BRANCHES[3][0])} THEN component END AS skipped_component, count(*) AS n_lines FROM ann GROUP BY ALL"""
ORACLES["evidence_lines"] = "SELECT doc_id, md5(left(split_part(text, chr(10), 1), 160)) AS digest FROM documents"
ORACLES["error_like_events"] = P + " SELECT event_no FROM act WHERE level = 'ERROR' OR event_no % 4 = 0"
ORACLES["cause_words"] = f"""WITH w AS (SELECT doc_id, list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z_.<>]+'), lambda x: length(x) > 2))) AS c,
  list_filter(regexp_extract_all(lower(text), '[a-z0-9_]+'), lambda x: length(x) > 2 AND x NOT IN ({', '.join(lit(s) for s in classify.STOPWORDS)})) AS q FROM documents)
  SELECT doc_id, md5(array_to_string(c, '|')) AS tokens, md5(array_to_string(list_filter(q, lambda x, i: list_position(q, x) = i), '|')) AS terms FROM w"""
ORACLES["step_labels"] = "SELECT doc_id, left(split_part(text, chr(10), 1), 70) AS label FROM documents"
ORACLES["extract_targets"] = """WITH x AS (SELECT page_id, url || ' ' || html AS text, 8000 + page_id % 9 AS p FROM pages), web AS (SELECT page_id,
   regexp_extract(text, 'https?://([\\pL\\pN_.-]+)', 1) AS host, TRY_CAST(nullif(regexp_extract(text, 'https?://[\\pL\\pN_.-]+(?::(\\d+))?', 1), '') AS INT) AS port,
   regexp_extract(text, 'https?://[\\pL\\pN_.-]+(:\\d+)?') AS url, false AS local FROM x WHERE regexp_matches(text, 'https?://[\\pL\\pN_.-]'))
  SELECT * FROM web UNION ALL SELECT page_id, 'localhost', p, 'localhost:' || p, true FROM x UNION ALL SELECT page_id, 'localhost', 8001, 'localhost:8001', true FROM x WHERE p <> 8001"""

# ------------------------------------------------------------------ row assembly

FOLDED = M + """, g AS (SELECT *, count(*) FILTER (WHERE NOT is_cont) OVER (PARTITION BY source_id ORDER BY line_no) AS grp,
   last_value(clock IGNORE NULLS) OVER (PARTITION BY source_id ORDER BY line_no) AS filled,
   CASE WHEN kind = 3 THEN message[16:] WHEN kind = 5 THEN 'slow answer' ELSE message END AS content FROM parsed),
  f AS (SELECT *, row_number() OVER (PARTITION BY source_id, grp ORDER BY line_no) - 1 AS i FROM g)"""
ORACLES["fold_continuations"] = FOLDED + """ SELECT source_id, min(line_no) AS event_no, arg_min(level, line_no) AS level, arg_min(filled, line_no) AS clock,
  count(*) - 1 AS folded_lines, md5(string_agg(CASE WHEN i % 201 = 0 THEN message ELSE content END, chr(10) ORDER BY line_no)) AS digest FROM f GROUP BY source_id, grp, i // 201"""
ORACLES["fold_bounded"] = FOLDED + " SELECT source_id, min(line_no) AS event_no, count(*) - 1 AS folded_lines FROM f GROUP BY source_id, grp, i // 2"
ORACLES["fold_tracker_detail"] = f"""WITH {MIXED}, o AS (SELECT *, last_value(CASE WHEN kind <> 6 THEN kind IN (0, 1, 2) END IGNORE NULLS)
   OVER (PARTITION BY source_id ORDER BY line_no) AS open, min(line_no) FILTER (WHERE kind NOT IN (0, 1, 2, 6)) OVER (PARTITION BY source_id) AS opened FROM mixed),
  k AS (SELECT *, line_no <> opened AND (kind IN (0, 1, 2, 3, 4, 6)) AS folds FROM o WHERE line_no >= opened AND (kind <> 6 OR coalesce(open, false))),
  g AS (SELECT *, count(*) FILTER (WHERE NOT folds) OVER (PARTITION BY source_id ORDER BY line_no) AS h FROM k)
  SELECT source_id, min(line_no) AS event_no, least(40, count(*) - 1) AS kept, count(*) - 1 AS n_detail FROM g GROUP BY source_id, h"""
ORACLES["carry_timestamp"] = f"""WITH {MIXED} SELECT source_id, line_no, last_value(CASE WHEN kind IN (3, 4) OR kind > 6 THEN stamp END IGNORE NULLS)
  OVER (PARTITION BY source_id ORDER BY line_no) AS ts_carried FROM mixed"""
ORACLES["unroll_clock"] = P + """, j AS (SELECT event_no, sec % 86400 AS s, coalesce(sec % 86400 + 60 < lag(sec % 86400) OVER (ORDER BY event_no), false) AS jump FROM act)
  SELECT event_no, sum(jump::INT) OVER (ORDER BY event_no)::BIGINT AS day_no, (sum(jump::INT) OVER (ORDER BY event_no) * 86400 + s)::BIGINT AS sec FROM j"""
ORACLES["flag_novel"] = P + " SELECT template_id, min(event_no) AS event_no FROM act GROUP BY 1"
ORACLES["coverage"] = L + " SELECT 'activity' AS source_id, count(*) AS events, count(*) AS extracted, 0::BIGINT AS inferred, 0::BIGINT AS unattributed FROM lines"
ORACLES["order_events"] = P + " SELECT trace_id, event_no, row_number() OVER (PARTITION BY trace_id ORDER BY ts NULLS LAST, event_no) AS nth FROM act"
RUNS = ANNOTATED + """, r AS (SELECT *, count(*) FILTER (WHERE is_start) OVER (PARTITION BY source_id ORDER BY line_no) AS run_no FROM ann),
  e AS (SELECT source_id, run_no, min(line_no) AS end_no FROM r WHERE is_end AND run_no > 0 GROUP BY 1, 2),
  i AS (SELECT r.*, end_no, CASE status WHEN 'failed' THEN 3 WHEN 'warning' THEN 2 WHEN 'retrying' THEN 2 WHEN 'running' THEN 1 WHEN 'completed' THEN 1 END AS code
    FROM r LEFT JOIN e USING (source_id, run_no) WHERE run_no > 0 AND (end_no IS NULL OR line_no <= end_no))"""
ORACLES["segment_runs"] = RUNS + f""" SELECT source_id, run_no, min(line_no) AS start_no, max(end_no) AS end_no, count(*) AS n_events, count(*) FILTER (WHERE status = 'failed') AS failures,
   count(*) FILTER (WHERE status = 'retrying') AS retries, count(*) FILTER (WHERE {has('message', '(?iU)' + classify.BRANCHES[3][0])}) AS skipped,
   array_to_string(list_sort(list_distinct(list(component))), '|') AS components,
   CASE WHEN coalesce(bool_or(status = 'failed' OR cause IS NOT NULL), false) THEN 'failed' WHEN max(end_no) IS NOT NULL THEN 'success'
     ELSE coalesce(arg_max(status, code * 1000000000 + line_no) FILTER (WHERE code IS NOT NULL), 'running') END AS status,
   coalesce(arg_max(cause, line_no) FILTER (WHERE cause IS NOT NULL), CASE WHEN max(end_no) IS NULL THEN 'Run in progress.'
     WHEN coalesce(bool_or(status = 'failed' OR cause IS NOT NULL), false) THEN 'The run reached its end, but a step failed.' ELSE 'Execution completed successfully.' END) AS reason
  FROM i GROUP BY source_id, run_no"""

# ------------------------------------------------------------------ aggregations

ORACLES["template_counts"] = P + """ SELECT template_id, count(*) AS total_count, min(sec) AS first_s, max(sec) AS last_s, arg_max(text, event_no) AS pattern,
  left(arg_min(text, event_no), 200) AS example FROM act GROUP BY 1"""
ORACLES["top_templates"] = P + " SELECT template_id || '/' || service AS template_id, count(*) AS total_count FROM act GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"
ORACLES["template_minutes"] = ORACLES["merge_counts"]
ORACLES["template_activity"] = P + " SELECT template_id, count(*) AS n_events FROM act WHERE template_id IN ('error', 'purchase') AND ts >= '2024-01-15' GROUP BY 1"
ORACLES["duration_samples"] = L + " SELECT 'web' AS component, CASE regexp_extract(payload, '\\[(\\w+)\\]', 1) WHEN 'error' THEN 'request failed connection' WHEN 'signup' THEN 'request received from' WHEN 'purchase' THEN 'payment completed via' ELSE 'page served to' END AS operation, CAST(regexp_extract(payload, ' in ([0-9.]+)ms', 1) AS DOUBLE) AS value_ms, line_no AS event_no FROM lines"
KEPT = P + """, s AS (SELECT service AS component, template_id AS operation, value_ms, event_no, sec, ts,
    row_number() OVER (PARTITION BY service, template_id ORDER BY event_no DESC) AS back, count(*) OVER (PARTITION BY service, template_id) AS total FROM act),
  k AS (SELECT *, least(total, 200) AS n, least(total, 200) - back AS pos FROM s WHERE back <= 200)"""
ORACLES["baseline_summary"] = KEPT + """, b AS (SELECT component, operation, max(n)::BIGINT AS n_samples, max(n) >= 10 AS ready, median(value_ms) AS median_ms,
   list_sort(list(value_ms))[least(max(n) - 1, floor(max(n) * 0.95)::BIGINT) + 1] AS p95_ms FROM k GROUP BY 1, 2)
  SELECT b.*, first_s FROM b JOIN (SELECT component, operation, min(sec) AS first_s FROM s GROUP BY 1, 2) USING (component, operation)"""
ORACLES["drift"] = KEPT + """, h AS (SELECT component, operation, max(n)::BIGINT AS n_samples, median(value_ms) FILTER (WHERE pos < n // 2) AS earlier_median_ms,
   median(value_ms) FILTER (WHERE pos >= n // 2) AS recent_median_ms FROM k GROUP BY 1, 2 HAVING max(n) // 2 >= 10)
  SELECT *, recent_median_ms / earlier_median_ms AS ratio FROM h WHERE earlier_median_ms > 0 AND (recent_median_ms / earlier_median_ms >= 1.2 OR recent_median_ms / earlier_median_ms <= 1 / 1.2)"""
ORACLES["window_drift"] = KEPT + """, h AS (SELECT component, operation, max(total)::BIGINT AS n_samples, median(value_ms) FILTER (WHERE total - back < total // 2) AS earlier_median_ms,
   median(value_ms) FILTER (WHERE total - back >= total // 2) AS recent_median_ms FROM s GROUP BY 1, 2 HAVING max(total) // 2 >= 10)
  SELECT *, recent_median_ms / earlier_median_ms AS ratio FROM h WHERE earlier_median_ms > 0 AND (recent_median_ms / earlier_median_ms >= 1.05 OR recent_median_ms / earlier_median_ms <= 1 / 1.05)"""
ORACLES["known_operations"] = P + " SELECT service AS component, template_id AS operation, count(*) AS n_samples FROM act GROUP BY 1, 2"
ORACLES["keep_last_n"] = KEPT + " SELECT component, operation, event_no FROM s WHERE back <= 50"
FLOW = P + """, sized AS (SELECT *, count(*) OVER (PARTITION BY trace_id) AS m, row_number() OVER (PARTITION BY trace_id ORDER BY event_no) - 1 AS pos FROM act),
  u AS (SELECT * FROM sized WHERE m >= 2), mined AS (SELECT count(DISTINCT trace_id) AS traces_mined FROM u),
  firsts AS (SELECT trace_id, template_id, min(pos) / greatest(max(m) - 1, 1) AS position FROM u GROUP BY 1, 2),
  spans AS (SELECT trace_id, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0 AS span_s FROM u GROUP BY 1),
  spec AS (SELECT (SELECT traces_mined FROM mined) AS traces_mined, median(span_s) AS p50_s,
    list_sort(list(span_s))[least(count(*) - 1, floor(count(*) * 0.95)::BIGINT) + 1] AS p95_s FROM spans)"""
ORACLES["mine_flow"] = FLOW + """ SELECT f.template_id, count(*) AS n_runs, count(*) / (SELECT traces_mined FROM mined) AS presence,
   count(*) / (SELECT traces_mined FROM mined) >= 0.7 AS required, median(position) AS median_rank, max(d.v) AS max_duration_ms
  FROM firsts f JOIN (SELECT template_id, list_sort(list(value_ms))[least(count(*) - 1, floor(count(*) * 0.95)::BIGINT) + 1] AS v FROM u GROUP BY 1) d USING (template_id) GROUP BY 1"""
ORACLES["flow_duration"] = FLOW + " SELECT * FROM spec"
ORACLES["conversation_flow"] = """WITH sized AS (SELECT conv_id, role, count(*) OVER (PARTITION BY conv_id) AS m, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos FROM conversations),
  u AS (SELECT * FROM sized WHERE m >= 2), n AS (SELECT count(DISTINCT conv_id) AS n FROM u),
  f AS (SELECT conv_id, role, min(pos) / greatest(max(m) - 1, 1) AS position FROM u GROUP BY 1, 2)
  SELECT role AS template_id, count(*) AS n_runs, count(*) / (SELECT n FROM n) AS presence, count(*) / (SELECT n FROM n) >= 0.7 AS required, median(position) AS median_rank FROM f GROUP BY 1"""
ORACLES["topology_edges"] = P + """ SELECT before AS from_component, template_id AS to_component, count(*) AS n_transitions FROM (
  SELECT template_id, lag(template_id) OVER (PARTITION BY trace_id ORDER BY event_no) AS before FROM act) WHERE before <> template_id GROUP BY 1, 2"""
ORACLES["topology_nodes"] = P + " SELECT template_id AS component, count(*) AS n_events FROM act GROUP BY 1"
TOPO = P + """, z AS (SELECT *, count(*) OVER (PARTITION BY trace_id) AS m, row_number() OVER (PARTITION BY trace_id ORDER BY event_no) - 1 AS pos FROM act),
  f AS (SELECT trace_id, template_id AS component, min(pos) / greatest(max(m) - 1, 1) AS position FROM z GROUP BY 1, 2),
  ranks AS (SELECT component, count(*) AS n_runs, list_sort(list(position))[count(*) // 2 + 1] AS rank FROM f GROUP BY 1),
  pairs AS (SELECT a.component, b.component AS other, count(*) AS n_runs FROM f a JOIN f b ON a.trace_id = b.trace_id AND a.component <> b.component GROUP BY 1, 2)"""
ORACLES["topology_ranks"] = TOPO + " SELECT component, n_runs, rank FROM ranks"
ORACLES["topology_pairs"] = TOPO + " SELECT * FROM pairs"
ORACLES["blast_radius"] = TOPO + """ SELECT p.component, p.other, CASE WHEN a.rank + 0.001 < b.rank THEN 'downstream' ELSE 'upstream' END AS side FROM pairs p
  JOIN ranks a ON a.component = p.component JOIN ranks b ON b.component = p.other WHERE a.rank + 0.001 < b.rank OR b.rank + 0.001 < a.rank"""
ORACLES["most_upstream"] = TOPO + """, g AS (SELECT DISTINCT service, template_id AS component FROM act), o AS (SELECT service, component, rank, row_number() OVER (PARTITION BY service ORDER BY rank, component) AS r FROM g JOIN ranks USING (component))
  SELECT service, CASE WHEN count(*) = 1 OR max(rank) - min(rank) > 0.001 THEN arg_min(component, r) END AS most_upstream FROM o WHERE r <= 2 GROUP BY 1"""
STEPPED = P + """, st AS (SELECT event_no, template_id, lag(template_id) OVER (ORDER BY event_no) AS before FROM act),
  tc AS (SELECT before AS from_component, template_id AS to_component, count(*) AS n_transitions, min(event_no) AS first_no FROM st WHERE before <> template_id GROUP BY 1, 2)"""
ORACLES["transition_counts"] = STEPPED + " SELECT * FROM tc"
ORACLES["likely_successor"] = STEPPED + """ SELECT from_component, to_component, n_transitions FROM (SELECT *, row_number() OVER (PARTITION BY from_component ORDER BY n_transitions DESC, first_no) AS r FROM tc) WHERE r = 1"""
ORACLES["lane_status"] = ANNOTATED + """ SELECT source_id, component, ['completed', 'skipped', 'retrying', 'running', 'failed'][max(CASE coalesce(status, CASE WHEN level = 'ERROR' THEN 'failed' END)
   WHEN 'failed' THEN 5 WHEN 'running' THEN 4 WHEN 'retrying' THEN 3 ELSE 1 END)] AS status, count(*) AS node_count FROM ann GROUP BY 1, 2"""
ORACLES["run_metrics"] = ANNOTATED + f""" SELECT source_id, count(*) AS total_events, count(*) FILTER (WHERE status = 'failed') AS failures, count(*) FILTER (WHERE status = 'retrying') AS retries,
  count(*) FILTER (WHERE {has('message', '(?iU)' + classify.BRANCHES[3][0])}) AS skipped FROM ann GROUP BY 1"""
ORACLES["learn_profile"] = f"""WITH {LINES}, {MIXED}, first AS (SELECT regexp_extract(payload, '\\[(\\w+)\\]', 1) AS tag, min(line_no) AS seen FROM lines GROUP BY 1)
  SELECT 'activity' AS source_id, (SELECT count(*) FROM lines) AS lines_seen, 'bracketed' AS line_format, 'datetime' AS timestamp_style, false AS has_continuations,
   (SELECT string_agg(tag, '|' ORDER BY seen) FROM first WHERE tag <> 'error') AS components, 'bracket-tag' AS method, true AS confident
  UNION ALL SELECT source_id, count(*), 'json', 'time', true, '', 'none', false FROM mixed WHERE kind <> 6 GROUP BY source_id"""
JUDGED = FLOW + """, runs AS (SELECT trace_id, count(*) AS n_events, count(*) FILTER (WHERE level = 'ERROR') AS n_errors, bool_or(template_id = 'purchase') AS purpose,
   (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0 AS duration_s, max(ts) AS ended_at, arg_min(text, event_no) AS first, arg_max(text, event_no) AS last,
   list(text ORDER BY event_no) FILTER (WHERE level = 'ERROR') AS failed_on, arg_min(service, event_no) AS service, max(event_no) AS last_event_no FROM act GROUP BY 1),
  v AS (SELECT *, CASE WHEN n_errors > 0 THEN 'failed' WHEN NOT purpose THEN 'hollow' WHEN duration_s > (SELECT p95_s FROM spec) * 1.1 THEN 'degraded' ELSE 'achieved' END AS verdict FROM runs)"""
ORACLES["verdict_counts"] = JUDGED + " SELECT verdict, count(*) AS n_runs FROM v GROUP BY 1"
ORACLES["run_verdicts"] = JUDGED + " SELECT trace_id, verdict, n_events, n_errors, duration_s FROM v WHERE n_events >= 2 AND (SELECT max(ts) FROM act) - ended_at >= INTERVAL 20 SECOND"
ORACLES["complete_runs"] = JUDGED + " SELECT trace_id, n_events FROM v WHERE n_events >= 3 AND (SELECT max(ts) FROM act) - ended_at >= INTERVAL 5 DAY"
JUDGED_LINES = JUDGED + """, sp AS (SELECT p95_s AS p95 FROM spec), w AS (SELECT v.*, CASE verdict WHEN 'failed' THEN array_to_string(failed_on[:3], '|') WHEN 'hollow' THEN first || '|' || last WHEN 'degraded' THEN last ELSE '' END AS told,
    round(duration_s)::BIGINT || 's' AS took, coalesce(p95 > 0 AND duration_s > p95 * 1.1, false) AS slow, round(p95)::BIGINT || 's' AS usual FROM v, sp)"""
ORACLES["conformance_signals"] = JUDGED_LINES + """ SELECT trace_id, last_event_no AS event_no, epoch_us(ended_at) // 1000000 AS sec, service, 'purpose_never_ran' AS metric,
  concat_ws('|', 'flow ''activity'': one of the purpose steps (' || (SELECT left(arg_min(text, event_no), 36) FROM act WHERE template_id = 'purchase') || '...) - observed: no purpose step ran; no error raised', nullif(told, '')) AS evidence FROM w WHERE NOT purpose"""
ORACLES["verdict_reasons"] = JUDGED_LINES + """ SELECT trace_id, service, last_event_no, told AS evidence,
  CASE verdict WHEN 'failed' THEN n_errors || ' error event(s) in the trace' WHEN 'hollow' THEN 'ended without an error, but none of its purpose steps ran'
   WHEN 'degraded' THEN 'achieved its purpose in ' || took || ' against a p95 of ' || usual ELSE 'purpose steps ran, no errors, usual duration' END AS reason,
  concat_ws('|', CASE WHEN NOT purpose THEN 'purpose_never_ran;P2;one of the purpose steps (' || (SELECT left(arg_min(text, event_no), 36) FROM act WHERE template_id = 'purchase') || '...);no purpose step ran; no error raised' END,
   CASE WHEN slow THEN 'slow_flow;P3;<= ' || usual || ' (p95);' || took END) AS deviations FROM w"""
ORACLES["pipeline_verdicts"] = JUDGED + """ SELECT 'activity' AS source_id, CASE verdict WHEN 'degraded' THEN 'achieved' ELSE verdict END AS verdict, count(*) AS n_runs, sum(n_events)::BIGINT AS n_events
  FROM v WHERE n_events >= 2 AND (SELECT max(ts) FROM act) - ended_at >= INTERVAL 20 SECOND GROUP BY 2"""
ORACLES["missing_steps"] = FLOW + """, s AS (SELECT template_id, count(*) / (SELECT traces_mined FROM mined) AS presence FROM firsts GROUP BY 1)
  SELECT t.trace_id, s.template_id AS step_id, presence FROM (SELECT DISTINCT trace_id FROM act) t, s WHERE presence >= 0.48 AND s.template_id <> 'purchase'
   AND NOT EXISTS (SELECT 1 FROM act a WHERE a.trace_id = t.trace_id AND a.template_id = s.template_id)"""
ORACLES["run_view"] = P + """, o AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY ts, event_no) AS r FROM act)
  SELECT trace_id, count(*) AS run_events, arg_min(service, r) AS service, string_agg(text, '|' ORDER BY r) FILTER (WHERE r <= 3) AS steps,
   CASE WHEN bool_or(template_id = 'purchase') THEN 'true' ELSE 'false' END AS ran FROM o GROUP BY 1"""
ORACLES["order_verdicts"] = """SELECT CASE WHEN o_orderstatus = 'F' THEN 'failed' WHEN l_orderkey IS NULL THEN 'hollow' ELSE 'achieved' END AS verdict, count(*) AS n_runs
  FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem) ON o_orderkey = l_orderkey GROUP BY 1"""
WEEK = JUDGED + """, w AS (SELECT * FROM v WHERE ended_at BETWEEN TIMESTAMP '2024-01-18' AND TIMESTAMP '2024-01-25'),
  wc AS (SELECT verdict, count(*) AS n_runs FROM w GROUP BY 1), ws AS (SELECT service AS component, template_id AS operation, value_ms, event_no,
    row_number() OVER (PARTITION BY service, template_id ORDER BY event_no) - 1 AS pos, count(*) OVER (PARTITION BY service, template_id) AS n FROM act
    WHERE ts BETWEEN TIMESTAMP '2024-01-18' AND TIMESTAMP '2024-01-25'),
  wh AS (SELECT component, operation, max(n)::BIGINT AS n_samples, median(value_ms) FILTER (WHERE pos >= n // 2) / median(value_ms) FILTER (WHERE pos < n // 2) AS ratio FROM ws GROUP BY 1, 2 HAVING max(n) // 2 >= 10),
  wd AS (SELECT *, row_number() OVER (ORDER BY abs(ratio - 1) DESC, component, operation) AS rank FROM wh WHERE ratio >= 1.5 OR ratio <= 1 / 1.5),
  wm AS (SELECT *, median(value_ms) OVER (PARTITION BY component, operation ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS med FROM ws),
  wb AS (SELECT component, operation, arg_max(value_ms, value_ms / med) AS value_ms, arg_max(med, value_ms / med) AS median_ms, max(value_ms / med) AS ratio FROM wm
    WHERE pos >= 10 AND med > 0 AND value_ms >= med * 3 GROUP BY 1, 2),
  wk AS (SELECT *, row_number() OVER (ORDER BY ratio DESC, component, operation) AS rank FROM wb)"""
ORACLES["audit_verdicts"] = WEEK + " SELECT * FROM wc"
ORACLES["audit_drifts"] = WEEK + " SELECT component, operation, n_samples, ratio, rank FROM wd WHERE rank <= 10"
ORACLES["audit_spikes"] = WEEK + " SELECT component, operation, value_ms, median_ms, rank FROM wk WHERE rank <= 10"
LABELLED = """WITH x AS (SELECT d.source, CASE WHEN toxic = 1 THEN 'wrong_diagnosis' WHEN quality = 1 THEN 'worked' WHEN quality = 0 THEN 'did_not_work' END AS o, d.doc_id % 7 = 0 AS auto
  FROM documents d LEFT JOIN labels USING (doc_id))"""
ORACLES["accuracy"] = LABELLED + """ SELECT source AS source_id, count(*) AS incidents, count(o) AS judged, count(*) - count(o) AS unknown, count(*) FILTER (WHERE o = 'worked') AS right,
  count(*) FILTER (WHERE o = 'did_not_work') AS fix_did_not_work, count(*) FILTER (WHERE o = 'wrong_diagnosis') AS wrong_diagnosis, count(*) FILTER (WHERE o IS NOT NULL AND auto) AS auto_verified,
  CASE WHEN count(o) > 0 THEN count(*) FILTER (WHERE o = 'worked') / count(o) END AS rate FROM x GROUP BY 1"""
ARCHIVE = P + """, ar AS (SELECT user_id AS incident_no, date_trunc('week', ts)::TIMESTAMP AS opened_at, CASE WHEN count(*) FILTER (WHERE level = 'ERROR') > 2 THEN 'P2' ELSE 'P3' END AS severity,
   list_sort(list_distinct(list(service))) AS services, coalesce(list_sort(list_distinct(list('d-' || template_id) FILTER (WHERE value_ms > 60))), []) AS detectors,
   list_sort(list_distinct(list(template_id))) AS templates, arg_min(text, event_no) AS cause FROM act GROUP BY 1, 2),
  arc AS (SELECT *, list_sort(list_distinct(list_filter(regexp_extract_all(lower(cause), '[a-z_.<>]+'), lambda w: length(w) > 2))) AS cause_tokens,
   row_number() OVER (ORDER BY opened_at DESC, incident_no DESC) AS age FROM ar)"""
ORACLES["recurring_patterns"] = ARCHIVE + """ SELECT kind, value, count(*) AS n_incidents FROM (SELECT 'template' AS kind, unnest(templates) AS value FROM arc
  UNION ALL SELECT 'detector', unnest(detectors) FROM arc) GROUP BY 1, 2 HAVING count(*) >= 2"""
ORACLES["archive_incidents"] = ARCHIVE + " SELECT incident_no, epoch_us(opened_at) // 1000000 AS opened_s, CASE WHEN incident_no % 2 = 0 THEN 'worked' END AS outcome, severity FROM arc"


def jaccard(f: str) -> str:
    a, b = f"q.{f}", f"p.{f}"
    both = f"len(list_intersect({a}, {b}))"
    return f"(CASE WHEN len({a}) + len({b}) = 0 THEN 0.0::DOUBLE ELSE {both} / (len({a}) + len({b}) - {both}) END)"


ORACLES["similar_incidents"] = ARCHIVE + f""", pr AS (SELECT q.incident_no, q.opened_at AS own, p.incident_no AS precedent_no, p.opened_at AS then_, round(0.0::DOUBLE + 0.35::DOUBLE * {jaccard('templates')} + 0.25::DOUBLE * {jaccard('cause_tokens')}
   + 0.2::DOUBLE * {jaccard('detectors')} + 0.1::DOUBLE * {jaccard('services')} + 0.1::DOUBLE * (CASE WHEN q.severity = p.severity THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 3) AS similarity
   FROM arc q, arc p WHERE NOT (q.incident_no = p.incident_no AND q.opened_at = p.opened_at))
  SELECT incident_no, precedent_no, epoch_us(then_) // 1000000 AS precedent_s, similarity FROM (SELECT *, row_number() OVER (PARTITION BY incident_no, own ORDER BY similarity DESC, then_ DESC, precedent_no DESC) AS r
   FROM pr WHERE similarity >= 0.35) WHERE r <= 3"""
ORACLES["record_outcome"] = ARCHIVE + " SELECT CASE WHEN severity = 'P2' THEN 'worked' END AS outcome, CASE WHEN severity = 'P2' THEN 'kept' END AS outcome_note, count(*) AS n_incidents FROM arc GROUP BY 1, 2"
ORACLES["search_history"] = ARCHIVE + """, c AS (SELECT incident_no, min(cause) AS cause FROM arc GROUP BY 1)
  SELECT incident_no, cause, (contains(cause, 'purchase')::BIGINT + contains(cause, 'user')::BIGINT) AS score FROM c WHERE contains(cause, 'purchase') OR contains(cause, 'user') ORDER BY 3 DESC, 1 LIMIT 5"""
ORACLES["dependency_report"] = f"""{L}, t AS (SELECT regexp_extract(payload, 'http://([a-z0-9-]+):', 1) AS host FROM lines), c AS (SELECT host, count(*) AS n FROM t GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY n DESC, host) AS r FROM c)
  SELECT 'activity' AS source_id, host, 8080 AS port, 'http://' || host || ':8080' AS url, false AS local, n AS seen_in_logs, r = 1 AND n >= 2 * (SELECT n FROM o WHERE r = 2) AS single_point_of_failure FROM o"""

# ------------------------------------------------------------------ windows and detectors

ORACLES["trailing_rate"] = P + """, s AS (SELECT template_id, sec, count(*) AS n FROM act GROUP BY 1, 2)
  SELECT template_id, sec, (sum(n) OVER (PARTITION BY template_id ORDER BY sec RANGE BETWEEN 21600 PRECEDING AND CURRENT ROW))::BIGINT AS rate FROM s"""
HISTORY = P + """, h AS (SELECT *, median(value_ms) OVER w AS med, count(*) OVER w AS before FROM act
  WINDOW w AS (PARTITION BY service, template_id ORDER BY event_no ROWS BETWEEN 200 PRECEDING AND 1 PRECEDING))"""
ORACLES["spike_vs_history"] = HISTORY + """ SELECT service AS component, template_id AS operation, event_no, value_ms, med AS median_ms, before AS n_samples FROM h
  WHERE before >= 10 AND med > 0 AND value_ms >= med * 3"""
RATES = P + """, s AS (SELECT template_id, sec, count(*) AS n FROM act GROUP BY 1, 2), c AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY template_id ORDER BY sec RANGE BETWEEN 21600 PRECEDING AND 1 PRECEDING), 0)::BIGINT AS w,
   (sum(n) OVER (PARTITION BY template_id ORDER BY sec))::BIGINT AS upto, min(sec) OVER (PARTITION BY template_id) AS first FROM s),
  u AS (SELECT *, (upto - n - w) / greatest((sec - first - 21600) / 21600.0::DOUBLE, 1.0::DOUBLE) AS usual FROM c WHERE sec - first >= 86400)"""
ORACLES["rate_conditions"] = RATES + """ SELECT template_id, sec, (w + 1)::DOUBLE AS observed, usual, w + 1 >= 5 AND w + 1 >= greatest(usual, 0.1::DOUBLE) * 1.5::DOUBLE AS above,
   w + 1 <= greatest(usual, 0.1::DOUBLE) * 1.2::DOUBLE AS below FROM u"""
ORACLES["error_conditions"] = P + """, e AS (SELECT event_no, sec, (level = 'ERROR')::INT AS err, row_number() OVER (ORDER BY event_no) - 1 AS hist, coalesce(sum((level = 'ERROR')::INT) OVER (ORDER BY event_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS base FROM act),
  w AS (SELECT *, (SELECT NULL) AS x, hist + 1 - (SELECT count(*) FROM e b WHERE b.sec < e.sec - 21600) AS n, base + err - (SELECT coalesce(sum(b.err), 0) FROM e b WHERE b.sec < e.sec - 21600) AS k FROM e)
  SELECT event_no, (k::BIGINT) / n AS observed, base / greatest(hist, 1) AS usual, n >= 8 AND k::BIGINT / n >= greatest(0.2::DOUBLE, base / greatest(hist, 1) * 1.3::DOUBLE) AS above,
   k::BIGINT / n <= greatest(0.05::DOUBLE, base / greatest(hist, 1) * 1.1::DOUBLE) AS below FROM w WHERE hist >= 100"""
ORACLES["detect_novelty"] = P + """, f AS (SELECT template_id || '/' || service AS t, min(event_no) AS event_no FROM act GROUP BY 1)
  SELECT event_no, t AS template_id, 'first_occurrence' AS metric, 1.0::DOUBLE AS observed, 0.0::DOUBLE AS baseline, CASE WHEN level = 'ERROR' THEN 'P2' ELSE 'P4' END AS severity
  FROM f JOIN act USING (event_no) WHERE level = 'ERROR' OR (SELECT count(*) FROM act b WHERE b.event_no <= f.event_no) > 100"""
ORACLES["detect_rate_drop"] = P + """, s AS (SELECT template_id, sec, count(*) AS n, min(event_no) AS no FROM act GROUP BY 1, 2), c AS (SELECT *, sum(n) OVER w AS upto, min(sec) OVER (PARTITION BY template_id) AS first,
   lead(sec) OVER w AS next_sec, lead(no) OVER w AS next_no FROM s WINDOW w AS (PARTITION BY template_id ORDER BY sec)),
  k AS (SELECT *, 60.0::DOUBLE / (upto::BIGINT / ((sec - first) / 60.0::DOUBLE)) AS expected FROM c WHERE upto >= 10 AND sec - first >= 300 AND upto::BIGINT / ((sec - first) / 60.0::DOUBLE) >= 0.01),
  d AS (SELECT *, ceil(sec + greatest(expected * 4, 600))::BIGINT AS due FROM k), m AS (SELECT sec, min(event_no) AS no FROM act GROUP BY 1),
  z AS (SELECT d.template_id, d.sec, expected, next_no, m.sec AS seen, m.no AS event_no FROM d ASOF JOIN m ON d.due <= m.sec WHERE next_sec IS NULL OR next_sec >= due)
  SELECT event_no, template_id, 'silence_gap_s' AS metric, (seen - sec)::DOUBLE AS observed, expected AS baseline, 'P3' AS severity FROM z WHERE next_no IS NULL OR event_no < next_no"""
ORACLES["cost_spikes"] = P + """, h AS (SELECT template_id AS label, event_no, amount, list_sort(list(amount) OVER (PARTITION BY template_id ORDER BY event_no ROWS BETWEEN 200 PRECEDING AND 1 PRECEDING)) AS l FROM act)
  SELECT label, event_no, amount, l[len(l) // 2 + 1] AS usual FROM h WHERE len(l) >= 8 AND l[len(l) // 2 + 1] > 0 AND amount >= l[len(l) // 2 + 1] * 1.8"""
ORACLES["detect_absence"] = P + """, s AS (SELECT template_id AS component, value_ms, row_number() OVER (PARTITION BY template_id ORDER BY event_no DESC) AS back FROM act),
  b AS (SELECT component, median(value_ms) AS median_ms FROM s WHERE back <= 200 GROUP BY 1 HAVING count(*) >= 10)
  SELECT t.trace_id, b.component, b.median_ms FROM (SELECT DISTINCT trace_id FROM act) t, b WHERE NOT EXISTS (SELECT 1 FROM act a WHERE a.trace_id = t.trace_id AND a.template_id = b.component)"""
ORACLES["apply_suppressions"] = P + """, q AS (SELECT template_id FROM act GROUP BY 1 HAVING avg(value_ms) < 50 AND template_id IN ('view', 'click'))
  SELECT template_id, count(*) AS n_events FROM act WHERE template_id NOT IN (SELECT template_id FROM q) GROUP BY 1"""

# ------------------------------------------------------------------ incidents, memory, checks

MEMBERS = P + """, mb AS (SELECT *, CAST(user_id || strftime(date_trunc('week', ts), '%Y%m%d') AS BIGINT) AS incident_no, CASE WHEN value_ms > 50 THEN 'P2' ELSE 'P3' END AS severity FROM act WHERE level = 'ERROR')"""
ORACLES["incident_lifecycle"] = MEMBERS + """, p AS (SELECT incident_no, min(sec) AS opened_s, max(sec) AS last_signal_s, count(*) AS n_signals, min(severity) AS severity, (SELECT max(sec) FROM act) AS now FROM mb GROUP BY 1)
  SELECT incident_no, opened_s, last_signal_s, n_signals, severity, CASE WHEN now - last_signal_s >= 86400 THEN 'resolved' WHEN now - opened_s >= 900 THEN 'open' ELSE 'forming' END AS status,
   CASE WHEN now - last_signal_s >= 86400 THEN last_signal_s + 86400 END AS resolved_s FROM p"""
ORACLES["rank_cause"] = MEMBERS + """, f AS (SELECT incident_no, min(event_no) AS cause_signal_no, count(*) AS n_members FROM mb GROUP BY 1),
  g AS (SELECT f.*, c.text AS cause_line, c.trace_id AS tr, (SELECT count(*) FROM mb x WHERE x.incident_no = f.incident_no AND x.trace_id = c.trace_id) AS n_shared FROM f JOIN mb c ON c.event_no = f.cause_signal_no)
  SELECT incident_no, cause_signal_no, cause_line, n_members, n_shared, 'earliest onset of ' || n_members || ' member(s)' || CASE WHEN n_shared > 1 THEN '; ' || n_shared || ' member(s) share its trace ' || left(tr, 12) ELSE '' END AS cause_why FROM g"""
ORACLES["incident_view"] = MEMBERS + """, ev AS (SELECT incident_no, line, min(o) AS o FROM (SELECT incident_no, text AS line, event_no * 2 AS o FROM mb UNION ALL SELECT incident_no, 'took ' || service, event_no * 2 + 1 FROM mb) GROUP BY 1, 2),
  e5 AS (SELECT incident_no, string_agg(line, '|' ORDER BY o) AS evidence FROM (SELECT *, row_number() OVER (PARTITION BY incident_no ORDER BY o) AS r FROM ev) WHERE r <= 5 GROUP BY 1)
  SELECT incident_no, min(severity) AS severity, array_to_string(list_sort(list_distinct(list(service))), '|') AS services, count(DISTINCT template_id) AS n_templates, count(DISTINCT trace_id) AS n_traces, max(evidence) AS evidence
  FROM mb JOIN e5 USING (incident_no) GROUP BY 1"""
ORACLES["incident_signature"] = MEMBERS + """ SELECT incident_no, min(severity) AS severity, array_to_string(list_sort(list_distinct(list(service))), '|') AS services, 'NoveltyDetector' AS detectors, 'error' AS templates,
  'error|user' AS cause_tokens FROM mb GROUP BY 1"""
HALVES = P + """, k AS (SELECT service AS component, template_id AS operation, value_ms, ts < '2024-01-15' AS early, row_number() OVER (PARTITION BY service, template_id ORDER BY event_no DESC) AS back,
   row_number() OVER (PARTITION BY service, template_id, ts < '2024-01-15' ORDER BY event_no DESC) AS back_half FROM act),
  half AS (SELECT component, operation, median(value_ms) FILTER (WHERE back_half <= 200) AS median_ms, list_sort(list(value_ms) FILTER (WHERE back_half <= 200))[least(least(count(*), 200) - 1, floor(least(count(*), 200) * 0.95)::BIGINT) + 1] AS p95_ms, count(*) AS samples
   FROM k WHERE early GROUP BY 1, 2 HAVING count(*) >= 10),
  whole AS (SELECT component, operation, median(value_ms) FILTER (WHERE back <= 200) AS median_ms, list_sort(list(value_ms) FILTER (WHERE back <= 200))[least(least(count(*), 200) - 1, floor(least(count(*), 200) * 0.95)::BIGINT) + 1] AS p95_ms, count(*) AS samples
   FROM k GROUP BY 1, 2 HAVING count(*) >= 10),
  vf AS (SELECT h.component, h.operation, w.samples - h.samples AS fresh, (w.median_ms - h.median_ms) / h.median_ms AS mc, (w.p95_ms - h.p95_ms) / h.p95_ms AS tc FROM half h JOIN whole w USING (component, operation)),
  vo AS (SELECT component, operation, CASE WHEN fresh < 8 THEN 'too-early' WHEN tc <= -0.15 OR mc <= -0.15 THEN 'held' WHEN tc >= 0.15 OR mc >= 0.15 THEN 'worse' ELSE 'unchanged' END AS verdict, fresh FROM vf)"""
ORACLES["snapshot_fix"] = HALVES + " SELECT * FROM half"
ORACLES["verify_fix"] = HALVES + " SELECT component, operation, verdict, fresh FROM vo"
RECUR = HALVES + """, ut AS (SELECT user_id AS incident_no, epoch_us(date_trunc('week', ts)::TIMESTAMP) // 1000000 AS opened_s, template_id || '/' || service || '/' || user_id AS t, ts FROM act),
  ct AS (SELECT t, count(*) FILTER (WHERE ts < '2024-01-15') AS was, count(*) FILTER (WHERE ts >= '2024-01-15') AS since FROM ut GROUP BY 1),
  rc AS (SELECT DISTINCT incident_no, opened_s, t, was, since FROM ut JOIN ct USING (t)),
  rv AS (SELECT incident_no, opened_s, CASE WHEN count(*) FILTER (WHERE since > 0) > 0 THEN 'recurred' WHEN count(*) FILTER (WHERE was >= 2) = 0 THEN 'too-early' ELSE 'held' END AS verdict, count(*) AS n_templates,
   count(*) FILTER (WHERE was >= 2) AS n_watchable, arg_max(t, lpad(since::VARCHAR, 9, '0') || t) FILTER (WHERE since > 0) AS worst_template_id, max(since) FILTER (WHERE since > 0) AS worst_since FROM rc GROUP BY 1, 2)"""
ORACLES["verify_recurrence"] = RECUR + " SELECT * FROM rv"
ORACLES["fix_headline"] = RECUR + """, sp AS (SELECT CASE WHEN count(*) FILTER (WHERE verdict = 'worse') > 0 THEN 'worse' WHEN count(*) FILTER (WHERE verdict = 'held') > 0 THEN 'held' END AS s FROM vo)
  SELECT CASE WHEN verdict = 'too-early' THEN coalesce((SELECT s FROM sp), verdict) ELSE verdict END AS headline, count(*) AS n_incidents FROM rv GROUP BY 1"""
ORACLES["downgrade_fixes"] = RECUR + """, ar AS (SELECT DISTINCT user_id AS incident_no, epoch_us(date_trunc('week', ts)::TIMESTAMP) // 1000000 AS opened_s FROM act)
  SELECT a.incident_no, a.opened_s, CASE WHEN a.incident_no % 2 = 0 THEN CASE WHEN verdict = 'recurred' THEN 'did_not_work' ELSE 'worked' END END AS outcome,
   CASE WHEN a.incident_no % 2 = 0 AND verdict = 'recurred' THEN 'auto-verified: ' || worst_template_id || ' has fired ' || worst_since || ' more time(s) since the fix' END AS outcome_note
  FROM ar a LEFT JOIN (SELECT * FROM rv WHERE opened_s < epoch_us(TIMESTAMP '2024-01-22') // 1000000) rv USING (incident_no, opened_s)"""
ORACLES["search_events"] = P + " SELECT event_no, text AS text_redacted FROM act WHERE contains(lower(text), 'error by user 1') ORDER BY event_no DESC LIMIT 15"
ORACLES["keyword_evidence"] = P + " SELECT text AS text_redacted, max(event_no) AS event_no FROM act WHERE contains(text, 'purchase') OR contains(text, 'signup') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 4"
CITED = """WITH us AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'), cl AS (SELECT conv_id, turn AS claim_id, split_part(text, chr(10), 1) AS claim FROM conversations WHERE role = 'assistant'
   UNION ALL SELECT conv_id, turn, substring(text, 6, 70) FROM us), hay AS (SELECT conv_id, lower(trim(regexp_replace(l, '\\s+', ' ', 'g'))) AS h FROM (SELECT conv_id, unnest(string_split(text, chr(10))) AS l FROM us) WHERE trim(l) <> ''),
  nd AS (SELECT conv_id, claim_id, lower(trim(regexp_replace(claim, '\\s+', ' ', 'g'))) AS n FROM cl), corpus AS (SELECT conv_id, string_agg(h, chr(10)) AS c FROM hay GROUP BY 1),
  qd AS (SELECT DISTINCT nd.conv_id, claim_id FROM nd JOIN hay ON nd.conv_id = hay.conv_id AND length(n) >= 12 AND (contains(h, n) OR contains(n, h) OR starts_with(h, left(n, 60)))),
  ow AS (SELECT nd.conv_id, claim_id, list_filter(regexp_extract_all(n, '[a-z0-9_:/.-]+'), lambda w: length(w) > 3) AS w, coalesce(c, '') AS c FROM nd LEFT JOIN corpus USING (conv_id)),
  oo AS (SELECT conv_id, claim_id, len(list_filter(w, lambda x: contains(c, x))) >= greatest(2, len(w) // 2) AND len(w) > 0 AS overlapping FROM ow),
  gr AS (SELECT oo.conv_id, oo.claim_id, qd.claim_id IS NOT NULL AS quoted, overlapping FROM oo LEFT JOIN qd ON oo.conv_id = qd.conv_id AND oo.claim_id = qd.claim_id)"""
ORACLES["ground_citations"] = CITED + " SELECT * FROM gr"
ORACLES["settle_hollow"] = CITED + """ SELECT CASE WHEN conv_id IN (SELECT conv_id FROM gr WHERE overlapping) THEN 'hollow' ELSE 'unknown' END AS verdict, count(*) AS n_runs
  FROM (SELECT DISTINCT conv_id FROM conversations) GROUP BY 1"""

# ------------------------------------------------------------------ sequential rules, by recursion

ORACLES["cooldown"] = f"""WITH RECURSIVE {ACT}, n AS (SELECT service, event_no, sec, row_number() OVER (PARTITION BY service ORDER BY event_no) AS i FROM act WHERE level = 'ERROR'),
  r AS (SELECT service, event_no, i, sec AS last, true AS kept FROM n WHERE i = 1
    UNION ALL SELECT n.service, n.event_no, n.i, CASE WHEN n.sec - r.last >= 7200 THEN n.sec ELSE r.last END, n.sec - r.last >= 7200 FROM r JOIN n ON n.service = r.service AND n.i = r.i + 1)
  SELECT service, event_no FROM r WHERE kept"""
ORACLES["hysteresis_gate"] = f"""WITH RECURSIVE {ACT}, n AS (SELECT service, event_no, sec, value_ms >= 30 AS a, value_ms < 90 AS b, row_number() OVER (PARTITION BY service ORDER BY event_no) AS i FROM act),
  r AS (SELECT service, event_no, sec, i, false AS firing, CASE WHEN a THEN sec END AS since, CAST(NULL AS VARCHAR) AS change FROM n WHERE i = 1
    UNION ALL SELECT service, event_no, sec, i, CASE WHEN due THEN NOT firing ELSE firing END, CASE WHEN due THEN NULL ELSE s END, CASE WHEN due THEN CASE WHEN firing THEN 'clear' ELSE 'fire' END END FROM (
     SELECT *, s IS NOT NULL AND sec - s >= CASE WHEN firing THEN 7200 ELSE 3600 END AS due FROM (
      SELECT n.*, r.firing, CASE WHEN CASE WHEN r.firing THEN n.b ELSE n.a END THEN coalesce(r.since, n.sec) END AS s FROM r JOIN n ON n.service = r.service AND n.i = r.i + 1)))
  SELECT service, event_no, sec, change FROM r WHERE change IS NOT NULL"""


def cooled(hits: str, key: str, seconds: int) -> str:
    """Recursive part that keeps a hit if ``seconds`` have passed since the last kept one of its key."""
    return f"""n AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY event_no) AS i FROM {hits}),
  r AS (SELECT {key} AS k, event_no, i, sec AS last, true AS kept FROM n WHERE i = 1 UNION ALL
    SELECT n.{key}, n.event_no, n.i, CASE WHEN n.sec - r.last >= {seconds} THEN n.sec ELSE r.last END, n.sec - r.last >= {seconds} FROM r JOIN n ON n.{key} = r.k AND n.i = r.i + 1)"""


ORACLES["detect_latency_shift"] = HISTORY.replace("WITH", "WITH RECURSIVE", 1) + f""", hits AS (SELECT template_id, event_no, sec, value_ms, med FROM h WHERE before >= 10 AND med > 0 AND value_ms >= med * 3),
  {cooled('hits', 'template_id', 3600)}
  SELECT event_no, template_id, template_id || ' ms' AS metric, value_ms AS observed, med AS baseline, 'P3' AS severity FROM hits JOIN r USING (event_no) WHERE kept"""
ORACLES["detect_cost_anomaly"] = ORACLES["cost_spikes"].split(" SELECT label, event_no, amount, l[")[0].replace("WITH", "WITH RECURSIVE", 1) + f""", hits AS (SELECT label, h.event_no, sec, h.amount, l[len(l) // 2 + 1] AS usual
    FROM h JOIN act USING (event_no) WHERE len(l) >= 8 AND l[len(l) // 2 + 1] > 0 AND h.amount >= l[len(l) // 2 + 1] * 1.8),
  {cooled('hits', 'label', 3600)}
  SELECT event_no, label AS template_id, label || ' tokens' AS metric, amount AS observed, usual AS baseline, 'P3' AS severity FROM hits JOIN r USING (event_no) WHERE kept"""
ORACLES["skip_nodes"] = ANNOTATED + """, st AS (SELECT source_id, line_no, component, kind_, lag(component) OVER (PARTITION BY source_id ORDER BY line_no) AS previous FROM ann),
  mv AS (SELECT *, CASE WHEN previous <> component THEN row_number() OVER (PARTITION BY source_id, previous, component ORDER BY line_no) END AS n,
    min(line_no) OVER (PARTITION BY source_id, previous, component) AS first_no FROM st WHERE previous IS NOT NULL),
  ld AS (SELECT *, max(CASE WHEN n IS NOT NULL THEN lpad(n::VARCHAR, 9, '0') || lpad((999999999 - first_no)::VARCHAR, 9, '0') || component END)
    OVER (PARTITION BY source_id, previous ORDER BY line_no) AS top FROM mv)
  SELECT source_id, line_no AS event_no, component, previous, kind_ AS branch_kind, CASE WHEN top IS NOT NULL AND top[19:] <> component THEN top[19:] ELSE previous END AS skipped
  FROM ld WHERE kind_ IS NOT NULL"""
ORACLES["audit_summary"] = WEEK + """, t AS (SELECT count(*) AS total_runs, count(*) FILTER (WHERE verdict <> 'achieved') AS n_notable FROM w), dn AS (SELECT count(*) AS d FROM wd WHERE rank <= 10), sn AS (SELECT count(*) AS s FROM wk WHERE rank <= 10)
  SELECT total_runs, n_notable, d AS n_drifts, s AS n_spikes, total_runs || ' run(s) in the last week - ' || (SELECT string_agg(n_runs || ' ' || verdict, ', ' ORDER BY n_runs DESC, verdict) FROM wc)
   || CASE WHEN n_notable > 0 THEN ' (' || n_notable || ' worth a look)' ELSE '' END || '.' || CASE WHEN d + s > 0 THEN ' ' ELSE '' END
   || concat_ws(' and ', CASE WHEN d > 0 THEN d || ' operation(s) trending slower or faster than earlier in the window' END, CASE WHEN s > 0 THEN s || ' spike(s) against the window''s own history' END)
   || CASE WHEN d + s > 0 THEN '.' ELSE '' END AS summary FROM t, dn, sn"""
ORACLES["gap_report"] = P + """, c AS (SELECT count(*) AS n, count(*) FILTER (WHERE event_no % 3 = 0) AS x FROM act), v AS (SELECT count(DISTINCT trace_id) AS n, count(DISTINCT trace_id) FILTER (WHERE level = 'ERROR') AS f FROM act),
  g AS (SELECT service, event_no % 50 AS inc FROM act WHERE level = 'ERROR' AND service NOT IN ('svc-1', 'svc-2') GROUP BY 1, 2 HAVING count(*) >= 3)
  SELECT 'correlation' AS kind, format('only {:.0f}% of {} events could be tied to a request', x * 100.0::DOUBLE / n, n) AS measured FROM c WHERE n >= 50 AND x / n < 0.5
  UNION ALL SELECT 'outcome', 'all ' || n || ' completed runs came back verdict=unknown' FROM v WHERE f = 0
  UNION ALL SELECT 'timing', service || ' produced signals in incident ' || min(inc) || ' but no duration' FROM g GROUP BY service
  UNION ALL SELECT 'cost', 'model calls were seen, none carried a token count'"""
