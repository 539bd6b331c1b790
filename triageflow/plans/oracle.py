"""DuckDB twins of the registered queries (the correctness oracle).

Built from a few shared CTEs so each query reads the driver's views
(``orders``, ``customer``, ``nation``) exactly like the Spark side.
"""

from __future__ import annotations

from triageflow.constants import (BENIGN_KEYWORDS, FALSE_POSITIVE_KEYWORDS, FEATURE_COLUMNS, LABELS,
                                  TRUE_POSITIVE_KEYWORDS)


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


RAW_ALERTS_CTE = """raw_alerts AS (
  SELECT o_orderkey AS Id, o_custkey AS IncidentId, o_orderkey % 1000 AS AlertId,
    CAST(o_orderdate AS VARCHAR) AS Timestamp,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'CredentialAccess' WHEN '2-HIGH' THEN 'Exfiltration'
      WHEN '3-MEDIUM' THEN 'InitialAccess' WHEN '4-NOT SPECIFIED' THEN 'Discovery' ELSE 'Execution' END AS Category,
    CASE o_custkey % 4 WHEN 1 THEN 'T1110;T1078' WHEN 2 THEN 'T1566' WHEN 3 THEN 'T1059.005;T1021' END AS MitreTechniques,
    CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'User' WHEN 'BUILDING' THEN 'Url' WHEN 'FURNITURE' THEN 'Ip'
      WHEN 'HOUSEHOLD' THEN 'Mailbox' ELSE 'File' END AS EntityType,
    CASE WHEN o_orderkey % 2 = 0 THEN 'Impacted' ELSE 'Related' END AS EvidenceRole,
    o_orderkey % 97 AS DetectorId, o_custkey % 53 AS AlertTitle,
    CASE WHEN o_totalprice > 400000 THEN 'Suspicious' END AS SuspicionLevel,
    CASE o_orderkey % 5 WHEN 0 THEN 'Malicious' WHEN 1 THEN 'Clean' WHEN 2 THEN 'Suspicious' END AS LastVerdict,
    c_nationkey AS CountryCode, n_regionkey AS State, o_custkey % 101 AS City,
    o_orderkey % 6 AS OSFamily, o_orderkey % 67 AS OSVersion,
    CASE WHEN o_orderkey % 50 <> 49 THEN CASE o_orderstatus WHEN 'F' THEN 'TruePositive'
      WHEN 'O' THEN 'FalsePositive' ELSE 'BenignPositive' END END AS IncidentGrade
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey)"""

ALERT_TEXT_SQL = " || ' | ' || ".join(
    f"'{c}: ' || coalesce(CAST({c} AS VARCHAR), 'unknown')" for c in FEATURE_COLUMNS)

ALERTS_CTE = RAW_ALERTS_CTE + f""",
alerts AS (
  SELECT Id, IncidentId, AlertId, Timestamp, {ALERT_TEXT_SQL} AS alert_text, IncidentGrade AS label
  FROM raw_alerts WHERE IncidentGrade IS NOT NULL)"""


def keyword_sum(text: str, keywords: list[str]) -> str:
    return "(" + " + ".join(f"CAST(contains({text}, {q(k)}) AS INTEGER)" for k in keywords) + ")"


RULE_PRED_SQL = """CASE WHEN tp_score >= 2 THEN 'TruePositive'
      WHEN fp_score >= 2 AND tp_score = 0 THEN 'FalsePositive' ELSE 'BenignPositive' END"""

SCORED_CTE = ALERTS_CTE + f""",
scored0 AS (
  SELECT *, {keyword_sum('lower(alert_text)', TRUE_POSITIVE_KEYWORDS)} AS tp_score,
    {keyword_sum('lower(alert_text)', BENIGN_KEYWORDS)} AS benign_score,
    {keyword_sum('lower(alert_text)', FALSE_POSITIVE_KEYWORDS)} AS fp_score
  FROM alerts),
scored AS (SELECT *, {RULE_PRED_SQL} AS predicted_label FROM scored0)"""


# The online path: every alert, graded or not, that has any text.
ONLINE_CTE = RAW_ALERTS_CTE + f""",
online0 AS (SELECT Id, IncidentGrade AS label, {ALERT_TEXT_SQL} AS alert_text FROM raw_alerts),
online1 AS (SELECT *, {keyword_sum('lower(alert_text)', TRUE_POSITIVE_KEYWORDS)} AS tp_score,
    {keyword_sum('lower(alert_text)', BENIGN_KEYWORDS)} AS benign_score,
    {keyword_sum('lower(alert_text)', FALSE_POSITIVE_KEYWORDS)} AS fp_score FROM online0
  WHERE length(trim(alert_text, ' ' || chr(9) || chr(10) || chr(13))) > 0),
online AS (SELECT *, {RULE_PRED_SQL} AS predicted_label FROM online1)"""


def labels_values(labels: list[str] = LABELS) -> str:
    return "(VALUES " + ", ".join(f"({i}, {q(x)})" for i, x in enumerate(labels)) + ") AS lbl(label_order, label)"


def metric_ctes(preds_sql: str, labels: list[str] = LABELS) -> str:
    """CTEs ``cells``, ``pc`` (per class), ``tot`` (per model), ``summ`` over a
    ``(model, true_label, pred_label)`` relation."""
    in_list = ", ".join(q(x) for x in labels)
    return f"""preds AS ({preds_sql}),
cells AS (SELECT model, true_label, pred_label, count(*) AS n FROM preds GROUP BY model, true_label, pred_label),
models AS (SELECT DISTINCT model FROM cells),
grid AS (SELECT model, label, label_order FROM models CROSS JOIN {labels_values(labels)}),
pc0 AS (
  SELECT g.model, g.label, g.label_order,
    CAST(coalesce(sum(CASE WHEN c.true_label = g.label AND c.pred_label = g.label THEN c.n END), 0) AS BIGINT) AS tp,
    CAST(coalesce(sum(CASE WHEN c.pred_label = g.label THEN c.n END), 0) AS BIGINT) AS n_pred,
    CAST(coalesce(sum(CASE WHEN c.true_label = g.label THEN c.n END), 0) AS BIGINT) AS support
  FROM grid g LEFT JOIN cells c ON c.model = g.model
  GROUP BY g.model, g.label, g.label_order),
pc AS (
  SELECT *, CASE WHEN n_pred > 0 THEN CAST(tp AS DOUBLE) / n_pred ELSE 0.0 END AS precision,
    CASE WHEN support > 0 THEN CAST(tp AS DOUBLE) / support ELSE 0.0 END AS recall,
    CASE WHEN n_pred + support > 0 THEN CAST(2 * tp AS DOUBLE) / (n_pred + support) ELSE 0.0 END AS f1
  FROM pc0),
tot AS (
  SELECT model, CAST(sum(n) AS BIGINT) AS n_rows,
    CAST(sum(CASE WHEN true_label = pred_label THEN n ELSE 0 END) AS BIGINT) AS n_correct,
    CAST(sum(CASE WHEN coalesce(true_label IN ({in_list}) AND pred_label IN ({in_list}), false) THEN 0 ELSE n END) AS BIGINT)
      AS n_out_of_list
  FROM cells GROUP BY model),
pagg AS (
  SELECT model, avg(precision) AS macro_precision, avg(recall) AS macro_recall, avg(f1) AS macro_f1,
    sum(precision * support) AS wp, sum(recall * support) AS wr, sum(f1 * support) AS wf,
    CAST(sum(support) AS DOUBLE) AS s_sup,
    CAST(sum(tp) AS BIGINT) AS s_tp, CAST(sum(n_pred) AS BIGINT) AS s_pred
  FROM pc GROUP BY model),
summ AS (
  SELECT p.model,
    CASE WHEN n_rows > 0 THEN CAST(n_correct AS DOUBLE) / n_rows ELSE 0.0 END AS accuracy,
    macro_precision, macro_recall, macro_f1,
    CASE WHEN s_sup > 0 THEN wp / s_sup ELSE 0.0 END AS weighted_precision,
    CASE WHEN s_sup > 0 THEN wr / s_sup ELSE 0.0 END AS weighted_recall,
    CASE WHEN s_sup > 0 THEN wf / s_sup ELSE 0.0 END AS weighted_f1,
    n_rows, n_correct, n_out_of_list, s_tp, s_pred, s_sup
  FROM pagg p JOIN tot t ON p.model = t.model)"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def summary_select(digits: int = 6) -> str:
    cols = ["accuracy", "macro_precision", "macro_recall", "macro_f1",
            "weighted_precision", "weighted_recall", "weighted_f1"]
    return "SELECT model, " + ", ".join(f"round({c}, {digits}) AS {c}" for c in cols) + ", n_rows FROM summ"


def seeded_key(id_expr: str, salt: str, seed: int = 42) -> str:
    return f"md5(concat_ws(':', '{seed}', {q(salt)}, coalesce(CAST({id_expr} AS VARCHAR), '')))"


def split_ctes(src: str, out: str, salt: str, test_size_expr: str, split_col: str = "split",
               names: tuple[str, str] = ("train", "test"), seed: int = 42) -> str:
    """Stratified split of relation ``src`` (column ``label``) into ``out`` with
    quotas by largest remainder on the kept part and a plain per-class rank."""
    p = out
    return f"""{p}_keyed AS (SELECT *, {seeded_key('Id', salt, seed)} AS _k FROM {src}),
{p}_cc AS (SELECT label, count(*) AS n_c FROM {p}_keyed GROUP BY label),
{p}_tot AS (SELECT sum(n_c) AS n, CAST({test_size_expr} AS BIGINT) AS n_test FROM {p}_cc),
{p}_q0 AS (SELECT label, n_c, n - n_test AS n_train, ((n - n_test) * n_c) // n AS fl,
             ((n - n_test) * n_c) % n AS rem FROM {p}_cc CROSS JOIN {p}_tot),
{p}_q1 AS (SELECT *, n_train - sum(fl) OVER () AS extra,
             row_number() OVER (ORDER BY rem DESC, label NULLS LAST) AS rr FROM {p}_q0),
{p}_quota AS (SELECT label, n_c - (fl + CASE WHEN rr <= extra THEN 1 ELSE 0 END) AS quota FROM {p}_q1),
{p}_ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY _k, Id) AS _rn FROM {p}_keyed),
{out} AS (SELECT r.* EXCLUDE (_k, _rn), CASE WHEN r._rn <= q.quota THEN {q(names[1])} ELSE {q(names[0])} END AS {split_col}
          FROM {p}_ranked r JOIN {p}_quota q ON r.label IS NOT DISTINCT FROM q.label)"""


def balanced_ctes(src: str, out: str, salt: str, total: int, seed: int = 42) -> str:
    p = out
    return f"""{p}_keyed AS (SELECT *, {seeded_key('Id', salt, seed)} AS _k FROM {src} WHERE label IS NOT NULL),
{p}_ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY _k, Id) AS _rn FROM {p}_keyed),
{out} AS (SELECT * EXCLUDE (_k, _rn) FROM {p}_ranked
          WHERE _rn <= {total} // (SELECT count(DISTINCT label) FROM {p}_keyed))"""


SPLIT_CTE = ALERTS_CTE + ",\n" + split_ctes("alerts", "split_alerts", "split",
                                            "ceil(CAST(0.2 AS DOUBLE) * sum(n_c))")
EVAL_CTE = SPLIT_CTE + ",\n" + "test_alerts AS (SELECT * EXCLUDE (split) FROM split_alerts WHERE split = 'test'),\n" \
    + balanced_ctes("test_alerts", "eval_subset0", "subset", 300) + ",\n" \
    + f"eval_subset AS (SELECT *, {seeded_key('Id', 'subset-shuffle')} AS shuffle_key FROM eval_subset0)"
SFT_CTE = EVAL_CTE + ",\n" + """train_alerts AS (SELECT * EXCLUDE (split) FROM split_alerts WHERE split = 'train'),
clean_train AS (SELECT * FROM train_alerts t WHERE NOT EXISTS (
  SELECT 1 FROM eval_subset e WHERE CAST(e.Id AS VARCHAR) IS NOT DISTINCT FROM CAST(t.Id AS VARCHAR))),
""" + balanced_ctes("clean_train", "sft_bal", "sft", 12000) + ",\n" \
    + split_ctes("sft_bal", "sft_tv", "sft-val", "1000", "sft_split", ("train", "val")) + ",\n" \
    + f"""sft_all AS (
  SELECT *, {seeded_key('Id', 'sft-shuffle')} AS shuffle_key FROM sft_tv
  UNION ALL BY NAME
  SELECT * EXCLUDE (shuffle_key), 'test' AS sft_split, {seeded_key('Id', 'sft-shuffle')} AS shuffle_key FROM eval_subset)"""


# --- answers ---------------------------------------------------------------
from triageflow.constants import (HYBRID_PARSE_FALLBACK_SUMMARY, LABEL_ALIASES_NARROW,  # noqa: E402
                                  LABEL_ALIASES_WIDE, TRIAGE_PARSE_FALLBACK_SUMMARY,
                                  TRIAGE_REQUEST_FAILED_PREFIX)
from triageflow.sources.fixtures import (HYBRID_ANSWER_SHAPES, REQUEST_ERROR_TEXT,  # noqa: E402
                                         TRIAGE_ANSWER_SHAPES)

NO_ANSWER_TEXT = "no answer stored for this alert"


def strip_sql(e: str) -> str:
    return f"regexp_replace({e}, '^\\s+|\\s+$', '', 'g')"


def pick_sql(key: str, shapes: list[str]) -> str:
    return f"CASE {key} % {len(shapes)} " + " ".join(f"WHEN {i} THEN {q(s)}" for i, s in enumerate(shapes)) + " END"


def answers_cte(name: str, shapes: list[str], shift: int = 0) -> str:
    return f"""{name} AS (
  SELECT o_orderkey AS Id,
    CASE WHEN o_orderkey % 13 <> 12 THEN {pick_sql(f'(o_orderkey + {shift})', shapes)} END AS raw_response,
    CASE WHEN o_orderkey % 13 = 12 THEN {q(REQUEST_ERROR_TEXT)} END AS request_error,
    0.5 + (o_orderkey % 40) / 10.0 AS latency_seconds
  FROM orders)"""


def normalize_sql(raw: str, aliases: dict[str, str]) -> str:
    lab = strip_sql(raw)
    key = strip_sql(f"replace(lower({lab}), '_', ' ')")
    compact = f"replace({key}, ' ', '')"
    cases = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in aliases.items())
    labels = ", ".join(q(x) for x in LABELS)
    return (f"CASE WHEN {lab} IN ({labels}) THEN {lab} ELSE coalesce(CASE {key} {cases} END, "
            f"CASE {compact} {cases} END, 'INVALID_LABEL') END")


def list_sql(parsed: str, field: str) -> str:
    """Coerced list as JSON text (same text Spark's ``to_json`` gives)."""
    t = f"json_type({parsed}, '$.{field}')"
    s = f"json_extract_string({parsed}, '$.{field}')"
    return (f"CASE WHEN {t} = 'ARRAY' THEN CAST(to_json(json_extract_string({parsed}, '$.{field}[*]')) AS VARCHAR) "
            f"WHEN {t} = 'VARCHAR' AND length({strip_sql(s)}) > 0 THEN CAST(to_json([{s}]) AS VARCHAR) "
            f"ELSE '[]' END")


def parsed_ctes(src: str, out: str, greedy: bool = True, aliases: dict[str, str] = LABEL_ALIASES_WIDE) -> str:
    """Strict parse -> regex span -> strict parse -> status -> labels over ``src``
    (columns Id, raw_response, request_error, latency_seconds, ...)."""
    pat = r"(?s)\{.*\}" if greedy else r"(?s)\{.*?\}"
    p = out
    return f"""{p}_a AS (SELECT *, {strip_sql('raw_response')} AS _s FROM {src}),
{p}_b AS (SELECT *, regexp_extract(_s, {q(pat)}, 0) AS _span FROM {p}_a),
{p}_c AS (SELECT *, CASE WHEN json_valid(_s) THEN (CASE WHEN json_type(_s) = 'OBJECT' THEN _s END)
                     WHEN _span <> '' AND json_valid(_span) AND json_type(_span) = 'OBJECT' THEN _span END AS _parsed
          FROM {p}_b),
{p}_d AS (SELECT *, CASE WHEN request_error IS NOT NULL OR raw_response IS NULL THEN 'REQUEST_ERROR'
                     WHEN _parsed IS NULL THEN 'PARSE_ERROR' ELSE 'OK' END AS status FROM {p}_c),
{p}_e AS (SELECT *, CASE status WHEN 'REQUEST_ERROR' THEN 'REQUEST_ERROR' WHEN 'PARSE_ERROR' THEN 'PARSE_ERROR'
                     ELSE coalesce(json_extract_string(_parsed, '$.predicted_label'), 'INVALID_LABEL') END
                     AS llm_predicted_label_raw FROM {p}_d),
{out} AS (SELECT *, {normalize_sql('llm_predicted_label_raw', aliases)} AS llm_predicted_label,
    CASE WHEN status = 'OK' THEN coalesce(TRY_CAST(json_extract_string(_parsed, '$.confidence') AS DOUBLE), 0.0)
      ELSE 0.0 END AS llm_confidence,
    CASE WHEN status = 'OK' THEN coalesce(json_extract_string(_parsed, '$.reasoning_summary'), '')
      WHEN status = 'PARSE_ERROR' THEN {q(TRIAGE_PARSE_FALLBACK_SUMMARY)}
      ELSE {q(TRIAGE_REQUEST_FAILED_PREFIX)} || coalesce(request_error, {q(NO_ANSWER_TEXT)}) END AS llm_reasoning_summary,
    CASE WHEN status = 'OK' THEN {list_sql('_parsed', 'recommended_actions')} ELSE '[]' END AS actions_json
  FROM {p}_e)"""


def guidance_ctes(src: str, out: str, parse_fallback: str = HYBRID_PARSE_FALLBACK_SUMMARY) -> str:
    p = out
    return f"""{p}_a AS (SELECT *, {strip_sql('raw_response')} AS _s FROM {src}),
{p}_b AS (SELECT *, regexp_extract(_s, {q(r'(?s)\{.*\}')}, 0) AS _span FROM {p}_a),
{p}_c AS (SELECT *, CASE WHEN json_valid(_s) THEN (CASE WHEN json_type(_s) = 'OBJECT' THEN _s END)
                     WHEN _span <> '' AND json_valid(_span) AND json_type(_span) = 'OBJECT' THEN _span END AS _parsed
          FROM {p}_b),
{p}_d AS (SELECT *, CASE WHEN request_error IS NOT NULL OR raw_response IS NULL THEN 'REQUEST_ERROR'
                     WHEN _parsed IS NULL THEN 'PARSE_ERROR' ELSE 'OK' END AS status FROM {p}_c),
{out} AS (SELECT *,
    CASE WHEN status = 'OK' THEN coalesce(json_extract_string(_parsed, '$.analyst_summary'), '')
      WHEN status = 'PARSE_ERROR' THEN {q(parse_fallback)}
      ELSE {q(TRIAGE_REQUEST_FAILED_PREFIX)} || coalesce(request_error, {q(NO_ANSWER_TEXT)}) END AS analyst_summary,
    CASE WHEN status = 'OK' THEN coalesce(json_extract_string(_parsed, '$.risk_explanation'), '') ELSE '' END
      AS risk_explanation,
    CASE WHEN status = 'OK' THEN {list_sql('_parsed', 'mitre_interpretation')} ELSE '[]' END AS mitre_json,
    CASE WHEN status = 'OK' THEN {list_sql('_parsed', 'recommended_actions')} ELSE '[]' END AS actions_json,
    CASE WHEN status = 'OK' THEN coalesce(json_extract_string(_parsed, '$.containment_priority'), 'Unknown')
      ELSE 'Unknown' END AS containment_priority
  FROM {p}_d)"""


TRIAGE_ANSWERS_CTE = answers_cte("triage_answers", TRIAGE_ANSWER_SHAPES)
FEWSHOT_ANSWERS_CTE = answers_cte("fewshot_answers", TRIAGE_ANSWER_SHAPES, shift=5)
HYBRID_ANSWERS_CTE = answers_cte("hybrid_answers", HYBRID_ANSWER_SHAPES)
PARSED_CTE = TRIAGE_ANSWERS_CTE + ",\n" + parsed_ctes("triage_answers", "parsed")
PARSED_NG_CTE = TRIAGE_ANSWERS_CTE + ",\n" + parsed_ctes("triage_answers", "parsed_ng", False, LABEL_ALIASES_NARROW)
LLM_PRED_CTE = ALERTS_CTE + ",\n" + TRIAGE_ANSWERS_CTE + """,
llm_join AS (SELECT a.*, a.label AS true_label, t.raw_response, t.request_error, t.latency_seconds
             FROM alerts a LEFT JOIN triage_answers t ON a.Id = t.Id),
""" + parsed_ctes("llm_join", "llm_pred")


# Several answers of an id: the best of each (parsed, unparsable, failed; latest; greatest text).
REPEATED_CTE = ALERTS_CTE + f""",
rep_answers AS (
  SELECT o_custkey AS Id, CASE WHEN o_orderkey % 13 <> 12 THEN {pick_sql('o_orderkey', TRIAGE_ANSWER_SHAPES)} END AS raw_response,
    CASE WHEN o_orderkey % 13 = 12 THEN {q(REQUEST_ERROR_TEXT)} END AS request_error,
    0.5 + (o_orderkey % 40) / 10.0 AS latency_seconds, CAST(o_orderdate AS VARCHAR) AS answered_at FROM orders),
""" + parsed_ctes("rep_answers", "rep_parsed") + """,
rep_best AS (SELECT * FROM rep_parsed QUALIFY row_number() OVER (PARTITION BY Id ORDER BY
    CASE status WHEN 'OK' THEN 2 WHEN 'PARSE_ERROR' THEN 1 ELSE 0 END DESC, answered_at DESC NULLS LAST,
    raw_response DESC NULLS LAST, request_error DESC NULLS LAST, latency_seconds DESC NULLS LAST) = 1)"""


# --- prompts ---------------------------------------------------------------
def render_sql(template: str, **values: str) -> str:
    """SQL twin of ``operators.prompts.render``."""
    parts, rest = [], template
    while True:
        hits = [(rest.find("{" + k + "}"), k) for k in values if ("{" + k + "}") in rest]
        if not hits:
            parts.append(q(rest))
            break
        pos, name = min(hits)
        parts.append(q(rest[:pos]))
        parts.append(f"coalesce(CAST({values[name]} AS VARCHAR), '')")
        rest = rest[pos + len(name) + 2:]
    return strip_sql(" || ".join(parts))


# --- driver table columns (profile twin) -------------------------------------
DRIVER_TABLE_COLUMNS = {
    "region": ["r_regionkey", "r_name"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                 "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"],
    "events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
    "documents": ["doc_id", "text", "lang", "source", "n_chars"],
    "embeddings": ["vec_id", "embedding", "label"],
    "pages": ["page_id", "url", "html"],
    "benchmark": ["item_id", "text"],
    "labels": ["doc_id", "quality", "toxic"],
    "conversations": ["conv_id", "turn", "role", "text"],
}

PROFILE_SQL = "\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, {i} AS column_position, count(*) AS row_count, "
    f"count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS distinct_count FROM {t}"
    for t, cols in DRIVER_TABLE_COLUMNS.items() for i, c in enumerate(cols))

_TYPES = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "DATE": "date", "TIMESTAMP": "timestamp_ntz"}


def sketch_profile_sql(exact: dict[str, list[str]], first: int = 5) -> str:
    """One row per column; first values of the rows of the smallest keys (whole
    numbers and text only)."""
    kind = lambda c: f"any_value(CASE typeof({c}) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _TYPES.items()) + " END)"
    parts = []
    for t, named in exact.items():
        key = DRIVER_TABLE_COLUMNS[t][0]
        for i, c in enumerate(DRIVER_TABLE_COLUMNS[t]):
            n = f"count(DISTINCT {c})" if c in named else "CAST(NULL AS BIGINT)"
            near = "true" if c in named else "CAST(NULL AS BOOLEAN)"
            parts.append(f"""SELECT '{t}' AS table_name, '{c}' AS column_name, {i} AS column_position, {kind(c)} AS data_type, count(*) AS row_count,
  count(*) - count({c}) AS null_count, {n} AS distinct_count, {near} AS estimate_near,
  (SELECT CASE WHEN any_value(typeof({c})) IN ('BIGINT', 'INTEGER', 'VARCHAR') THEN CAST(to_json(list(substr(CAST({c} AS VARCHAR), 1, 40) ORDER BY {key})) AS VARCHAR) END
   FROM (SELECT {key}, {c} FROM {t} ORDER BY {key} LIMIT {first})) AS first_json FROM {t}""")
    return "\nUNION ALL\n".join(parts)


HYBRID_CTE = SCORED_CTE + ",\n" + HYBRID_ANSWERS_CTE + """,
hyb_join AS (SELECT s.Id, s.IncidentId, s.AlertId, s.Timestamp, s.alert_text, s.label AS true_label,
               s.predicted_label AS ml_predicted_label, h.raw_response, h.request_error, h.latency_seconds
             FROM scored s LEFT JOIN hybrid_answers h ON s.Id = h.Id),
""" + guidance_ctes("hyb_join", "hyb")


# --- text features -----------------------------------------------------------
TOKENS_SQL = "regexp_extract_all(lower(coalesce(alert_text, '')), '\\b\\w\\w+\\b')"
TERMS_CTE = ALERTS_CTE + f""",
docs AS (SELECT Id, {TOKENS_SQL} AS toks FROM alerts),
doc_terms AS (SELECT Id, unnest(toks || list_transform(range(1, len(toks)), lambda i: toks[i] || ' ' || toks[i + 1]))
              AS term FROM docs),
tf AS (SELECT Id, term, count(*) AS tf FROM doc_terms GROUP BY Id, term),
term_stats AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total FROM tf GROUP BY term),
vocab AS (SELECT *, CAST(row_number() OVER (ORDER BY total DESC, term) AS INTEGER) AS term_rank FROM
          (SELECT * FROM term_stats WHERE df >= 2 ORDER BY total DESC, term LIMIT 20000)),
ndocs AS (SELECT count(*) AS n FROM alerts),
tfw AS (SELECT tf.Id, tf.term, tf.tf * (ln((1.0 + n) / (1.0 + v.df)) + 1.0) AS w
        FROM tf JOIN vocab v ON tf.term = v.term CROSS JOIN ndocs),
tfidf AS (SELECT Id, term, w / sqrt(sum(w * w) OVER (PARTITION BY Id)) AS weight FROM tfw)"""


# --- multilingual documents (Unicode tokeniser on whole texts) --------------
DOC_TOKENS_SQL = "regexp_extract_all(lower(coalesce(text, '')), '[\\pL\\pN_]{2,}')"
DOC_TERMS_CTE = f"""ddocs AS (SELECT doc_id, {DOC_TOKENS_SQL} AS toks FROM documents),
ddoc_terms AS (SELECT doc_id, unnest(toks || list_transform(range(1, len(toks)),
                 lambda i: toks[i] || ' ' || toks[i + 1])) AS term FROM ddocs),
dtf AS (SELECT doc_id, term, count(*) AS tf FROM ddoc_terms GROUP BY doc_id, term),
dterm_stats AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total FROM dtf GROUP BY term)"""
