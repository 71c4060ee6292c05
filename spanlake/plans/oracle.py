"""DuckDB oracle SQL for the registered queries.

Each overlay is re-derived here with plain SQL from the driver's tables and the
operator's semantics are written directly (``arg_max ... FILTER`` for
last-defined-wins, ``min`` for trace start, ...), independent of the Spark code
path that parses and folds JSON. Ordering keys are fixed-width timestamp text
followed by the event id, i.e. (event_timestamp, event_id).
"""

from __future__ import annotations

SPLIT = "TIMESTAMP '2024-01-25 00:00:00'"

F1 = """
f1_src AS (
  SELECT event_id AS eid, date_trunc('millisecond', ts) AS ts, user_id, event_type, value, props,
         CAST(json_extract(props, '$.k') AS BIGINT) AS k
  FROM events
),
f1_gen AS (
  SELECT s.*, 'observation' AS kind, c.copy FROM f1_src s, (VALUES (0), (1)) c(copy)
  WHERE c.copy = 0 OR s.eid % 10 = 0
  UNION ALL
  SELECT s.*, 'trace' AS kind, c.copy FROM f1_src s, (VALUES (0), (1)) c(copy)
  WHERE s.eid % 4 = 0 AND (c.copy = 0 OR s.eid % 10 = 0)
),
f1_all AS (
  SELECT *,
    (CASE WHEN kind = 'observation' THEN 'e' ELSE 'c' END) || lpad(CAST(eid AS VARCHAR), 12, '0') AS base_id,
    eid % 37 = 0 AS bad_ts, eid % 41 = 0 AS bad_type, eid % 43 = 0 AS bad_id,
    CASE WHEN kind = 'trace' THEN 'trace-create' ELSE
      CASE event_type WHEN 'click' THEN 'span-create' WHEN 'view' THEN 'event-create'
        WHEN 'purchase' THEN 'generation-create' WHEN 'signup' THEN 'tool-create'
        WHEN 'error' THEN 'generation-update' END END AS good_type
  FROM f1_gen
),
f1_acc AS (SELECT * FROM f1_all WHERE NOT bad_ts AND NOT bad_type AND NOT bad_id),
f1_raw AS (
  SELECT base_id AS event_id, 'demo' AS project_id,
    'demo/f1/' || CAST(eid // 100 AS VARCHAR) || '.json' AS object_key,
    good_type AS event_type, ts AS event_timestamp,
    CASE WHEN kind = 'trace' THEN 't' || CAST(eid // 12 AS VARCHAR) ELSE 'o' || CAST(eid // 3 AS VARCHAR) END AS entity_id,
    CASE WHEN kind = 'trace' OR event_type <> 'error' THEN 't' || CAST(eid // 12 AS VARCHAR) END AS trace_id,
    CASE WHEN kind = 'observation' THEN 'o' || CAST(eid // 3 AS VARCHAR) END AS observation_id,
    CAST(NULL AS VARCHAR) AS score_id,
    kind, eid, user_id, event_type AS src_type, value, k,
    strftime(ts, '%Y-%m-%d %H:%M:%S.%g') || base_id AS ord
  FROM f1_acc WHERE copy = 0
),
f1_obs_ev AS (
  SELECT *,
    CASE WHEN src_type <> 'error' THEN src_type END AS name,
    CASE WHEN src_type IN ('purchase', 'view') AND value >= 0 THEN value END AS cost,
    CASE WHEN src_type = 'error' THEN k END AS output_k
  FROM f1_raw WHERE kind = 'observation'
),
f1_obs AS (
  SELECT observation_id AS id, 'demo' AS project_id,
    arg_max(trace_id, ord) FILTER (WHERE trace_id IS NOT NULL) AS trace_id,
    CAST(NULL AS VARCHAR) AS parent_observation_id,
    arg_max(event_type, ord) AS type,
    arg_max(name, ord) FILTER (WHERE name IS NOT NULL) AS name,
    arg_max(event_timestamp, ord) AS start_time,
    CAST(NULL AS TIMESTAMP) AS end_time,
    arg_max(cost, ord) FILTER (WHERE cost IS NOT NULL) AS total_cost,
    arg_max(event_timestamp, ord) AS updated_at,
    arg_max(k, ord) AS md_k,
    CAST(count(DISTINCT src_type) + 1 AS BIGINT) AS md_keys,
    arg_max(output_k, ord) FILTER (WHERE output_k IS NOT NULL) AS output_k
  FROM f1_obs_ev GROUP BY observation_id
),
f1_tr_ev AS (
  SELECT *, CASE WHEN eid % 8 <> 4 THEN src_type END AS name,
    'u' || CAST(user_id AS VARCHAR) AS u, 's' || CAST(user_id AS VARCHAR) AS s
  FROM f1_raw WHERE kind = 'trace'
),
f1_tr0 AS (
  SELECT trace_id AS id, 'demo' AS project_id,
    arg_max(name, ord) FILTER (WHERE name IS NOT NULL) AS name,
    arg_max(u, ord) AS user_id, arg_max(s, ord) AS session_id,
    min(event_timestamp) AS start_time, CAST(NULL AS TIMESTAMP) AS end_time,
    arg_max(event_timestamp, ord) AS updated_at,
    arg_max(k, ord) AS md_k, CAST(1 AS BIGINT) AS md_keys
  FROM f1_tr_ev GROUP BY trace_id
),
f1_cost AS (
  SELECT trace_id, sum(total_cost) AS cost FROM f1_obs
  WHERE total_cost IS NOT NULL AND trace_id IS NOT NULL GROUP BY trace_id
),
f1_tr AS (
  SELECT t.*, c.cost AS total_cost FROM f1_tr0 t LEFT JOIN f1_cost c ON t.id = c.trace_id
),
f1_sess AS (
  SELECT session_id AS id, project_id, min(start_time) AS first_seen_at,
    max(coalesce(end_time, start_time)) AS last_seen_at, count(*) AS trace_count
  FROM f1_tr WHERE session_id IS NOT NULL AND session_id <> '' GROUP BY session_id, project_id
),
f1_b1 AS (SELECT * FROM f1_raw WHERE event_timestamp < {split}),
f1_b2 AS (SELECT * FROM f1_raw WHERE event_timestamp >= {split}),
f1_keys2 AS (
  SELECT DISTINCT project_id, kind, key FROM (
    SELECT project_id, 'trace' AS kind, trace_id AS key FROM f1_b2 WHERE event_type = 'trace-create'
    UNION ALL SELECT project_id, 'observation', observation_id FROM f1_b2 WHERE kind = 'observation'
    UNION ALL SELECT project_id, 'cost_trace', trace_id FROM f1_b2 WHERE trace_id IS NOT NULL)
),
f1_b1_obs AS (
  SELECT observation_id, arg_max(trace_id, ord) FILTER (WHERE trace_id IS NOT NULL) AS old_trace
  FROM f1_b1 WHERE kind = 'observation' GROUP BY observation_id
),
f1_existing AS (
  SELECT project_id, kind, key FROM f1_keys2
  WHERE kind = 'trace' AND key IN (SELECT trace_id FROM f1_b1 WHERE event_type = 'trace-create')
  UNION
  SELECT project_id, kind, key FROM f1_keys2
  WHERE kind = 'observation' AND key IN (SELECT observation_id FROM f1_b1 WHERE kind = 'observation')
  UNION
  SELECT 'demo', 'cost_trace', old_trace FROM f1_b1_obs
  WHERE old_trace IS NOT NULL AND observation_id IN (SELECT key FROM f1_keys2 WHERE kind = 'observation')
)
""".replace("{split}", SPLIT)

OBS_COLS = (
    "id, project_id, trace_id, parent_observation_id, type, name, start_time, end_time, "
    "round(total_cost, 6) AS total_cost, updated_at, md_k, md_keys, output_k"
)
TRACE_COLS = "id, name, user_id, session_id, start_time, round(total_cost, 6) AS total_cost"


def with_f1(select: str) -> str:
    """Prefix the F1 CTEs; a select starting with ``,`` adds CTEs of its own."""
    return "WITH " + F1.strip() + "\n" + select


ORACLE: dict[str, str] = {
    "accepted_events": with_f1(
        "SELECT base_id AS id, good_type AS type, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS timestamp FROM f1_acc"
    ),
    "rejected_events": with_f1(
        """SELECT CASE WHEN bad_id THEN base_id || chr(13) ELSE base_id END AS id, 400 AS status,
          'Invalid request data' AS message,
          concat_ws('; ',
            CASE WHEN bad_id THEN 'ID cannot contain carriage return characters' END,
            CASE WHEN bad_ts THEN 'timestamp: invalid ISO datetime' END,
            CASE WHEN bad_type THEN 'type: invalid discriminator value' END) AS error
        FROM f1_all WHERE bad_ts OR bad_type OR bad_id"""
    ),
    "batch_result": with_f1(
        """SELECT eid // 100 AS batch,
          count(*) FILTER (WHERE NOT (bad_ts OR bad_type OR bad_id)) AS accepted,
          count(*) FILTER (WHERE bad_ts OR bad_type OR bad_id) AS rejected,
          201 AS accept_status
        FROM f1_all GROUP BY eid // 100"""
    ),
    "entity_type": with_f1(
        """SELECT base_id AS id, CASE WHEN kind = 'trace' THEN 'trace' ELSE 'observation' END AS entity_type,
          CASE WHEN kind = 'trace' THEN 't' || CAST(eid // 12 AS VARCHAR) ELSE 'o' || CAST(eid // 3 AS VARCHAR) END AS body_id
        FROM f1_acc"""
    ),
    "raw_log": with_f1(
        "SELECT event_id, project_id, object_key, event_type, event_timestamp, entity_id, trace_id, observation_id, score_id FROM f1_raw"
    ),
    "project_scope": with_f1(
        "SELECT project_id, count(*) AS events, count(DISTINCT entity_id) AS entities FROM f1_raw WHERE project_id = 'demo' GROUP BY project_id"
    ),
    "dedupe_strict": with_f1("SELECT base_id AS event_id, count(*) AS copies FROM f1_acc GROUP BY base_id HAVING count(*) > 1"),
    "dedupe_skip": with_f1(f"SELECT event_id, event_type, entity_id FROM f1_raw WHERE event_timestamp >= {SPLIT}"),
    "affected_keys": with_f1("SELECT project_id, kind, key FROM f1_keys2"),
    "existing_keys": with_f1("SELECT project_id, kind, key FROM f1_existing"),
    "replay_history": with_f1(
        """SELECT 'trace' AS kind, trace_id AS key, event_id FROM f1_b1
          WHERE event_type = 'trace-create' AND trace_id IN (SELECT key FROM f1_existing WHERE kind = 'trace')
        UNION ALL
        SELECT 'observation', observation_id, event_id FROM f1_b1
          WHERE kind = 'observation' AND observation_id IN (SELECT key FROM f1_existing WHERE kind = 'observation')"""
    ),
    "merge_observations": with_f1(f"SELECT {OBS_COLS} FROM f1_obs"),
    "observation_cost": with_f1("SELECT event_id, observation_id, round(cost, 6) AS total_cost FROM f1_obs_ev"),
    "merge_traces": with_f1(
        "SELECT id, project_id, name, user_id, session_id, start_time, end_time, updated_at, md_k, md_keys FROM f1_tr0"
    ),
    "trace_cost_rollup": with_f1("SELECT id, round(total_cost, 6) AS total_cost FROM f1_tr"),
    "sessions": with_f1("SELECT * FROM f1_sess"),
    "traces_list": with_f1(
        f"SELECT {TRACE_COLS} FROM f1_tr ORDER BY start_time DESC NULLS LAST, id LIMIT 100"
    ),
    "trace_get": with_f1(f"SELECT {TRACE_COLS} FROM f1_tr WHERE id = 't1'"),
    "observations_list": with_f1(
        f"SELECT {OBS_COLS} FROM f1_obs WHERE trace_id = 't1' ORDER BY start_time ASC NULLS LAST, id LIMIT 100"
    ),
    "sessions_list": with_f1("SELECT * FROM f1_sess ORDER BY last_seen_at DESC NULLS LAST, id LIMIT 100"),
    "session_get": with_f1("SELECT * FROM f1_sess WHERE id = 's1'"),
    "high_cost_traces": with_f1(f"SELECT {TRACE_COLS} FROM f1_tr ORDER BY f1_tr.total_cost DESC NULLS LAST, id LIMIT 20"),
    "busy_sessions": with_f1("SELECT * FROM f1_sess ORDER BY trace_count DESC, id LIMIT 20"),
    "repeated_sessions": with_f1("SELECT * FROM f1_sess WHERE trace_count > 1"),
    "entity_history": with_f1(
        "SELECT event_id, event_type, event_timestamp, entity_id, trace_id, observation_id FROM f1_raw WHERE entity_id = 'o1'"
    ),
    "trace_count": with_f1("SELECT count(*) AS trace_count FROM f1_tr"),
    "trace_bytes_stats": with_f1(
        """, sizes AS (
          SELECT trace_id, CAST(sum(strlen(event_id) + strlen(entity_id) + strlen(event_type) + strlen(trace_id)) AS BIGINT) AS bytes
          FROM f1_raw WHERE trace_id IS NOT NULL GROUP BY trace_id)
        SELECT count(*) AS traces, CAST(sum(bytes) AS BIGINT) AS trace_bytes,
          list_sort(list(bytes))[1] AS min_bytes,
          list_sort(list(bytes))[CAST(floor((count(*) - 1) * 0.5) AS BIGINT) + 1] AS p50_bytes,
          list_sort(list(bytes))[CAST(floor((count(*) - 1) * 0.95) AS BIGINT) + 1] AS p95_bytes,
          list_sort(list(bytes))[count(*)] AS max_bytes
        FROM sizes"""
    ),
    "adhoc_sql": with_f1(
        "SELECT type, count(*) AS n, round(sum(total_cost), 6) AS cost, count(DISTINCT trace_id) AS traces FROM f1_obs GROUP BY type"
    ),
}


F3 = """
f3_docs AS (
  SELECT doc_id, lang, source, n_chars, TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id) AS ts FROM documents
),
f3_tr AS (
  SELECT 'd' || CAST(doc_id AS VARCHAR) AS id, 'demo' AS project_id, source AS name, lang AS session_id,
    ts AS start_time, CAST((n_chars % 10) / 10.0 AS DOUBLE) AS model_score
  FROM f3_docs
),
f3_lab AS (
  SELECT doc_id, quality, toxic, TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id) AS ts,
    doc_id % 5 = 0 AS recheck, lpad(CAST(doc_id AS VARCHAR), 12, '0') AS pad
  FROM labels
),
f3_scores AS (
  SELECT 'q' || CAST(doc_id AS VARCHAR) AS id, 'd' || CAST(doc_id AS VARCHAR) AS trace_id,
    CAST(NULL AS VARCHAR) AS observation_id, 'quality' AS name, CAST(quality AS DOUBLE) AS value,
    CAST(NULL AS VARCHAR) AS string_value, 'NUMERIC' AS data_type, 'EVAL' AS source,
    CASE WHEN recheck THEN 'rechecked' END AS comment, ts AS timestamp,
    CASE WHEN recheck THEN ts + INTERVAL 1 HOUR ELSE ts END AS updated_at
  FROM f3_lab
  UNION ALL
  SELECT 'x' || CAST(doc_id AS VARCHAR), 'd' || CAST(doc_id AS VARCHAR), NULL, 'toxic',
    CASE WHEN toxic = 1 THEN 1.0 ELSE 0.0 END, CASE WHEN toxic = 1 THEN 'true' ELSE 'false' END, 'BOOLEAN',
    CASE WHEN doc_id % 3 = 0 THEN 'ANNOTATION' ELSE 'API' END,
    CASE WHEN recheck THEN 'rechecked' END, ts, CASE WHEN recheck THEN ts + INTERVAL 1 HOUR ELSE ts END
  FROM f3_lab
  UNION ALL
  SELECT 'g' || CAST(doc_id AS VARCHAR), 'd' || CAST(doc_id AS VARCHAR), NULL, 'grade',
    CASE WHEN doc_id % 7 = 0 THEN CAST(quality AS DOUBLE) END,
    CASE WHEN doc_id % 7 = 0 THEN CAST(quality AS VARCHAR) WHEN quality = 1 THEN 'good' ELSE 'bad' END,
    CASE WHEN doc_id % 7 = 0 THEN 'NUMERIC' ELSE 'CATEGORICAL' END, 'API', NULL, ts, ts
  FROM f3_lab
),
f3_score_ev AS (
  SELECT 'eq' || pad AS event_id, CAST(quality AS DOUBLE) AS value, CAST(NULL AS VARCHAR) AS string_value,
    'NUMERIC' AS data_type, 'EVAL' AS source FROM f3_lab
  UNION ALL
  SELECT 'ex' || pad, CASE WHEN toxic = 1 THEN 1.0 ELSE 0.0 END, CASE WHEN toxic = 1 THEN 'true' ELSE 'false' END,
    'BOOLEAN', CASE WHEN doc_id % 3 = 0 THEN 'ANNOTATION' END FROM f3_lab
  UNION ALL
  SELECT 'eg' || pad, CASE WHEN doc_id % 7 = 0 THEN CAST(quality AS DOUBLE) END,
    CASE WHEN doc_id % 7 = 0 THEN CAST(quality AS VARCHAR) WHEN quality = 1 THEN 'good' ELSE 'bad' END,
    CASE WHEN doc_id % 7 = 0 THEN 'NUMERIC' ELSE 'CATEGORICAL' END, NULL FROM f3_lab
  UNION ALL
  SELECT 'fq' || pad, NULL, NULL, NULL, NULL FROM f3_lab WHERE recheck
  UNION ALL
  SELECT 'fx' || pad, NULL, NULL, NULL, NULL FROM f3_lab WHERE recheck
)
"""

SCORE_COLS = "id, trace_id, observation_id, name, value, string_value, data_type, source, comment, timestamp, updated_at"


def with_f3(select: str) -> str:
    return "WITH " + F3.strip() + "\n" + select


ORACLE.update(
    {
        "merge_scores": with_f3(f"SELECT {SCORE_COLS} FROM f3_scores"),
        "score_typing": with_f3("SELECT event_id, value, string_value, data_type FROM f3_score_ev"),
        "score_source": with_f3("SELECT event_id, source FROM f3_score_ev"),
        "scores_list": with_f3(f"SELECT {SCORE_COLS} FROM f3_scores WHERE trace_id = 'd1' ORDER BY timestamp DESC NULLS LAST, id LIMIT 100"),
        "low_score_traces": with_f3(
            """SELECT t.id, t.name, t.start_time, t.project_id, s.name AS score_name, s.value, s.id AS score_id
            FROM f3_tr t JOIN f3_scores s ON s.trace_id = t.id WHERE s.value < 0.5
            ORDER BY t.start_time DESC NULLS LAST, t.id, s.id LIMIT 50"""
        ),
        "score_agreement": with_f3(
            """SELECT t.id, t.model_score, s.value AS expected_score, round(abs(t.model_score - s.value), 6) AS abs_diff
            FROM f3_tr t JOIN f3_scores s ON s.trace_id = t.id WHERE s.name = 'quality'"""
        ),
        "direct_append": with_f3(
            """SELECT 'score-create' AS event_type, (SELECT count(*) FROM f3_score_ev) AS processed, CAST(0 AS BIGINT) AS skipped
            UNION ALL SELECT 'trace-create', CAST(0 AS BIGINT), (SELECT count(*) FROM documents)"""
        ),
    }
)


F4 = """
f4_src AS (
  SELECT event_id AS eid, date_trunc('millisecond', ts) AS ts, user_id, event_type,
    CAST(json_extract(props, '$.k') AS BIGINT) AS k
  FROM events
),
f4_sp AS (
  SELECT *, eid % 6 AS conv,
    'demo/otel/' || lpad(CAST(eid // 8 AS VARCHAR), 8, '0') || '.json' AS object_key,
    CAST(eid % 8 AS INTEGER) AS span_pos,
    lpad(lower(hex(eid // 12)), 32, '0') AS trace_id,
    lpad(lower(hex(eid)), 16, '0') AS span_id,
    CASE WHEN eid % 12 <> 0 THEN lpad(lower(hex(eid - eid % 12)), 16, '0') END AS parent_span_id,
    CASE event_type WHEN 'click' THEN 'generation-create' WHEN 'view' THEN 'agent-create'
      WHEN 'purchase' THEN 'tool-create' WHEN 'signup' THEN 'retriever-create' END AS lf,
    CASE event_type WHEN 'click' THEN 'generation-create' WHEN 'view' THEN 'chain-create'
      WHEN 'purchase' THEN 'tool-create' WHEN 'signup' THEN 'embedding-create' END AS oi,
    CASE event_type WHEN 'click' THEN 'generation-create' WHEN 'view' THEN 'embedding-create'
      WHEN 'purchase' THEN 'tool-create' WHEN 'signup' THEN 'agent-create' END AS ga,
    CASE WHEN event_type = 'purchase' THEN 'tool-create'
      WHEN user_id % 2 <> 0 THEN NULL
      WHEN event_type IN ('click', 'signup') THEN 'generation-create'
      WHEN event_type = 'view' THEN 'embedding-create' END AS vc,
    eid % 12 = 0 AS is_root,
    eid % 4 IN (0, 1, 2) OR eid % 3 = 0 OR eid % 9 = 1 AS has_update,
    CASE WHEN eid % 4 IN (0, 1) THEN 'u' || CAST(user_id AS VARCHAR) END AS uid,
    CASE WHEN eid % 4 = 2 THEN 's' || CAST(user_id AS VARCHAR) END AS sid
  FROM f4_src
),
f4_m AS (
  SELECT *,
    CASE conv WHEN 0 THEN coalesce(lf, 'span-create') WHEN 1 THEN coalesce(oi, 'span-create')
      WHEN 2 THEN coalesce(ga, 'span-create') WHEN 3 THEN coalesce(vc, 'span-create')
      WHEN 4 THEN coalesce(lf, ga, 'span-create') ELSE 'span-create' END AS observation_type,
    conv IN (2, 4) AND ga IS NOT NULL AS ga_applies,
    CASE WHEN conv = 2 AND event_type = 'signup' THEN 'agent-' || CAST(user_id AS VARCHAR)
      ELSE 'span-' || event_type END AS root_name
  FROM f4_sp
),
f4_emit AS (
  SELECT *, CASE WHEN is_root THEN 'root' WHEN has_update THEN 'update' ELSE 'first' END AS kind,
    is_root OR has_update AS is_full
  FROM (SELECT *, row_number() OVER (PARTITION BY object_key, trace_id ORDER BY eid) AS rn FROM f4_m)
  WHERE is_root OR has_update OR rn = 1
),
f4_tev AS (
  SELECT * FROM (SELECT *, max(CAST(is_full AS INTEGER)) OVER (PARTITION BY object_key, trace_id) AS any_full FROM f4_emit)
  WHERE is_full OR any_full = 0
),
f4_tev_ord AS (
  SELECT *, strftime(ts, '%Y-%m-%d %H:%M:%S.%g') || sha256(object_key || ':0:0:' || CAST(span_pos AS VARCHAR) || ':trace') AS ord,
    CASE WHEN kind = 'root' THEN root_name END AS ev_name
  FROM f4_tev
)
"""


def with_f4(select: str) -> str:
    return "WITH " + F4.strip() + "\n" + select


ORACLE.update(
    {
        "otlp_spans": with_f4(
            "SELECT object_key, 0 AS rs_pos, 0 AS ss_pos, span_pos, trace_id, span_id, parent_span_id FROM f4_m"
        ),
        "otlp_timestamps": with_f4("SELECT span_id, ts AS start_time, ts + INTERVAL 1 SECOND AS end_time FROM f4_m"),
        "otlp_attributes": with_f4(
            """SELECT span_id,
              CAST((CASE WHEN conv = 0 THEN 1 WHEN conv = 1 THEN 1 WHEN conv = 2 THEN 4 + CASE WHEN eid % 2 = 0 THEN 1 ELSE 0 END
                     + CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END
                   WHEN conv = 3 THEN 1 + CASE WHEN user_id % 2 = 0 THEN 1 ELSE 0 END WHEN conv = 4 THEN 5 ELSE 0 END)
               + CASE WHEN eid % 4 IN (0, 1, 2) THEN 1 ELSE 0 END + CASE WHEN eid % 3 = 0 THEN 1 ELSE 0 END
               + CASE WHEN eid % 9 = 1 THEN 1 ELSE 0 END + CASE WHEN eid % 10 = 3 THEN 1 ELSE 0 END AS BIGINT) AS n_attributes,
              CASE WHEN eid % 10 = 3 THEN 'second' END AS dup_key,
              CASE WHEN conv = 2 THEN 'STRING' END AS input_tokens_type
            FROM f4_m"""
        ),
        "classify_spans": with_f4("SELECT span_id, observation_type FROM f4_m"),
        "normalize_fields": with_f4(
            """SELECT span_id, conv = 4 OR ga_applies AS model_present,
              CASE WHEN conv = 4 THEN NULL WHEN ga_applies THEN
                CASE WHEN eid % 2 = 0 THEN 'resp-' || CAST(eid % 5 AS VARCHAR) ELSE 'req-' || CAST(eid % 3 AS VARCHAR) END END AS model
            FROM f4_m"""
        ),
        "genai_usage": with_f4(
            """SELECT span_id,
              CASE WHEN ga_applies AND conv = 2 THEN CAST(user_id AS DOUBLE) END AS usage_input,
              CASE WHEN ga_applies THEN CAST(k AS DOUBLE) END AS usage_output,
              CASE WHEN ga_applies AND conv = 2 THEN CAST(user_id + k AS DOUBLE) WHEN ga_applies THEN CAST(k AS DOUBLE) END AS usage_total,
              CASE WHEN conv = 4 THEN NULL WHEN ga_applies THEN
                CASE WHEN eid % 2 = 0 THEN 'resp-' || CAST(eid % 5 AS VARCHAR) ELSE 'req-' || CAST(eid % 3 AS VARCHAR) END END AS model
            FROM f4_m"""
        ),
        "identity_resolution": with_f4("SELECT span_id, uid AS user_id, sid AS session_id FROM f4_m"),
        "trace_tags": with_f4(
            """SELECT span_id, CASE WHEN eid % 3 = 0 THEN 't' || CAST(user_id % 3 AS VARCHAR) || ',x' ELSE 'p,q' END AS tags
            FROM f4_m WHERE eid % 3 = 0 OR eid % 9 = 1"""
        ),
        "has_trace_update": with_f4("SELECT span_id, has_update FROM f4_m"),
        "root_spans": with_f4("SELECT span_id, is_root FROM f4_m"),
        "root_trace_fields": with_f4("SELECT span_id, root_name AS name FROM f4_m"),
        "otlp_trace_events": with_f4(
            "SELECT object_key, span_id, trace_id, kind, ev_name AS name, uid AS user_id, sid AS session_id FROM f4_tev_ord"
        ),
        "otlp_events": with_f4(
            """SELECT observation_type AS type, span_id AS id, 'span-' || event_type AS name, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS timestamp FROM f4_m
            UNION ALL
            SELECT 'trace-create', trace_id, ev_name, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') FROM f4_tev_ord"""
        ),
        "otlp_observation_events": with_f4(
            """SELECT span_id, trace_id, parent_span_id, observation_type AS type, 'span-' || event_type AS name,
              'default' AS environment, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS timestamp FROM f4_m"""
        ),
        "span_count": with_f4(
            """SELECT 'demo/otel/' || lpad(CAST(eid // 8 AS VARCHAR), 8, '0') || '.json' AS object_key,
              CAST(CASE WHEN (eid // 8) % 3 = 0 THEN 0 ELSE count(*) END AS BIGINT) AS span_count
            FROM f4_src GROUP BY eid // 8"""
        ),
        "otlp_traces": with_f4(
            """SELECT trace_id AS id, arg_max(ev_name, ord) FILTER (WHERE ev_name IS NOT NULL) AS name,
              arg_max(uid, ord) FILTER (WHERE uid IS NOT NULL) AS user_id,
              arg_max(sid, ord) FILTER (WHERE sid IS NOT NULL) AS session_id,
              min(ts) AS start_time
            FROM f4_tev_ord GROUP BY trace_id"""
        ),
    }
)


F2 = """
f2_src AS (
  SELECT conv_id, turn, role, text, length(text) AS len,
    TIMESTAMP '2024-01-01 00:00:00' + to_minutes(conv_id) + to_seconds(turn) AS ts,
    'v' || lpad(CAST(conv_id AS VARCHAR), 8, '0') || lpad(CAST(turn AS VARCHAR), 4, '0') AS id
  FROM conversations
),
f2_gen AS (SELECT * FROM f2_src WHERE role = 'assistant')
"""


def with_f2(select: str) -> str:
    return "WITH " + F2.strip() + "\n" + select


ORACLE.update(
    {
        "normalize_environment": with_f2(
            """SELECT id, CASE turn % 4 WHEN 0 THEN 'prod' WHEN 1 THEN 'staging' ELSE 'default' END AS environment FROM f2_src
            UNION ALL
            SELECT 'w' || lpad(CAST(conv_id AS VARCHAR), 8, '0'), 'dev' FROM f2_src WHERE turn = 0"""
        ),
        "normalize_usage": with_f2(
            """SELECT id,
              CASE WHEN turn % 3 IN (0, 1) THEN CAST(len // 2 AS BIGINT) END AS usage_input,
              CASE WHEN turn % 3 IN (0, 1) THEN CAST(len AS BIGINT) END AS usage_output,
              CASE WHEN turn % 3 = 0 THEN CAST(len // 2 + len AS BIGINT) END AS usage_total,
              CASE turn % 3 WHEN 0 THEN 'TOKENS' WHEN 1 THEN 'CHARACTERS' END AS usage_unit,
              turn % 3 = 2 AS usage_null
            FROM f2_gen"""
        ),
        "clean_usage_details": with_f2(
            """SELECT id, CAST(conv_id % 50 AS BIGINT) AS ud_input, CAST(len AS BIGINT) AS ud_output,
              CAST(len AS BIGINT) AS ud_total, CAST(3 AS BIGINT) AS ud_keys FROM f2_gen"""
        ),
        "clean_cost_details": with_f2(
            "SELECT id, round(CAST(len * 0.001 AS DOUBLE), 6) AS cost_total, CAST(1 AS BIGINT) AS cost_keys FROM f2_gen"
        ),
        "conversation_observations": with_f2(
            """SELECT 'c' || CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS id, 'c' || CAST(conv_id AS VARCHAR) AS trace_id,
              CASE WHEN turn > 0 THEN 'c' || CAST(conv_id AS VARCHAR) || '-' || CAST(turn - 1 AS VARCHAR) END AS parent_observation_id,
              CASE role WHEN 'assistant' THEN 'generation-create' WHEN 'user' THEN 'event-create' ELSE 'span-create' END AS type,
              role AS name, ts AS start_time, CASE WHEN role = 'system' THEN ts + INTERVAL 1 SECOND END AS end_time,
              CASE WHEN role = 'assistant' THEN CAST(len AS BIGINT) END AS usage_total,
              CASE WHEN role = 'assistant' THEN round(CAST(len * 0.001 AS DOUBLE), 6) END AS total_cost
            FROM f2_src"""
        ),
        "conversation_costs": with_f2(
            """SELECT 'c' || CAST(conv_id AS VARCHAR) AS id, 'conversation' AS name, 'cu' || CAST(conv_id % 30 AS VARCHAR) AS user_id,
              'cs' || CAST(conv_id % 20 AS VARCHAR) AS session_id, min(ts) FILTER (WHERE turn = 0) AS start_time,
              round(sum(CASE WHEN role = 'assistant' THEN CAST(len * 0.001 AS DOUBLE) END), 6) AS total_cost
            FROM f2_src GROUP BY conv_id HAVING count(*) FILTER (WHERE turn = 0) > 0"""
        ),
        "usage_by_model": with_f2(
            """SELECT 'model-' || CAST(conv_id % 3 AS VARCHAR) AS model, count(*) AS events,
              count(DISTINCT 'c' || CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR)) AS observations,
              sum(CAST(len AS DOUBLE)) AS total_tokens
            FROM f2_gen GROUP BY conv_id % 3"""
        ),
    }
)
ORACLE["conversation_timeline"] = ORACLE["conversation_observations"] + " WHERE conv_id = 1 ORDER BY start_time ASC NULLS LAST, id LIMIT 100"
ORACLE["accepted_scores"] = with_f3(
    """SELECT 'e' || t || pad AS id, true AS accepted, CASE WHEN t = 'q' THEN 'EVAL' ELSE 'API' END AS source, '' AS error
    FROM f3_lab, (VALUES ('q'), ('x'), ('g')) v(t)
    UNION ALL
    SELECT 'f' || t || pad, false, NULL, 'body.name: expected string; body.value: expected number, string or boolean'
    FROM f3_lab, (VALUES ('q'), ('x')) v(t) WHERE recheck"""
)


ORACLE.update(
    {
        "otlp_sink_layout": with_f4(
            """SELECT object_key, 'otel/demo/' || strftime(min(ts), '%Y/%m/%d/%H/%M') || '/'
              || lpad(CAST(eid // 8 AS VARCHAR), 8, '0') || '.json' AS path
            FROM f4_sp GROUP BY object_key, eid // 8"""
        ),
        "entity_objects": with_f1(
            """, f1_pos AS (
              SELECT *, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS ts_text,
                eid * 4 + CASE WHEN kind = 'trace' THEN 1 ELSE 0 END + copy * 2 AS pos,
                CASE WHEN kind = 'trace' THEN 'trace' ELSE 'observation' END AS entity_type,
                CASE WHEN kind = 'trace' THEN 't' || CAST(eid // 12 AS VARCHAR) ELSE 'o' || CAST(eid // 3 AS VARCHAR) END AS entity_id
              FROM f1_acc)
            SELECT eid // 100 AS batch,
              'demo/' || entity_type || '/' || entity_id || '/' || arg_min(base_id, ts_text || lpad(CAST(pos AS VARCHAR), 20, '0')) || '.json' AS key,
              entity_type, entity_id, count(*) AS n_events, min(ts_text) AS min_timestamp, max(ts_text) AS max_timestamp,
              arg_min(base_id, ts_text || lpad(CAST(pos AS VARCHAR), 20, '0')) AS first_event_id
            FROM f1_pos GROUP BY eid // 100, entity_type, entity_id"""
        ),
        "batch_manifest": with_f1(
            """SELECT eid // 100 AS batch, 'demo' AS projectId,
              count(DISTINCT CASE WHEN kind = 'trace' THEN 'trace:t' || CAST(eid // 12 AS VARCHAR) ELSE 'obs:o' || CAST(eid // 3 AS VARCHAR) END) AS n_objects,
              count(*) AS n_events
            FROM f1_acc GROUP BY eid // 100"""
        ),
        "trace_rows_to_events": """SELECT lpad(lower(hex(doc_id + 1000)), 32, '0') AS trace_id, source AS name,
              'mu' || CAST(doc_id % 10 AS VARCHAR) AS user_id, lang AS session_id, lang AS md_lang,
              CAST(n_chars AS BIGINT) AS input_n_chars, 'default' AS environment
            FROM documents""",
        "score_rows_to_events": """SELECT 'ae' || CAST(doc_id AS VARCHAR) AS id,
              CASE WHEN doc_id % 4 = 0 THEN 'refused' ELSE 'created' END AS status,
              CASE WHEN doc_id % 4 <> 0 THEN 'a' || CAST(doc_id AS VARCHAR) END AS score_id,
              CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'ANNOTATION' ELSE 'API' END AS source,
              CASE WHEN doc_id % 4 = 0 THEN NULL
                WHEN doc_id % 3 = 0 THEN CAST(quality AS VARCHAR)
                WHEN doc_id % 3 = 1 THEN CASE WHEN toxic = 1 THEN 'true' ELSE 'false' END
                ELSE CASE WHEN quality = 1 THEN '"ok"' ELSE '"bad"' END END AS value_json,
              CASE WHEN doc_id % 4 <> 0 THEN '2024-04-01T00:00:00.000Z' END AS created_at
            FROM labels""",
    }
)

ORACLE["merge_metadata"] = """
WITH e AS (
  SELECT user_id, event_id, event_id % 5 AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS o FROM events
), c AS (
  SELECT *, coalesce(max(o) FILTER (k = 2) OVER (PARTITION BY user_id), 0) AS cut FROM e
), f AS (
  SELECT user_id,
    arg_max({'k': k, 'id': event_id}, o) FILTER (k IN (0, 1, 2, 4)) AS last_a,
    arg_max({'k': k, 'id': event_id}, o) FILTER (k IN (0, 4) AND o > cut) AS last_x,
    max(event_id) FILTER (k = 2) AS any_two,
    arg_max(event_id, o) FILTER (k = 1 AND o > cut) AS y,
    arg_max(event_id, o) FILTER (k = 3) AS deep,
    arg_max(event_id, o) FILTER (k = 4) AS k
  FROM c GROUP BY user_id
)
SELECT user_id, CASE WHEN last_a.k = 2 THEN last_a.id END AS a, CASE WHEN last_x.k = 0 THEN last_x.id END AS x,
  CASE WHEN last_x.k = 4 THEN last_x.id END AS z, y, deep, k
FROM f
"""
ORACLE["events_raw_view"] = f"""
SELECT event_id, event_id AS json_id, event_type AS json_type, strftime(event_timestamp, '%Y-%m-%dT%H:%M:%S.%gZ') AS json_timestamp
FROM ({ORACLE["raw_log"]})
"""
ORACLE["upsert_observations"] = ORACLE["merge_observations"]
ORACLE["upsert_traces"] = ORACLE["trace_cost_rollup"]
ORACLE["upsert_scores"] = ORACLE["merge_scores"]
ORACLE["ledger"] = f"""
SELECT count(*) AS counted, count(*) AS stored, count(DISTINCT event_id) AS distinct_ids FROM ({ORACLE["raw_log"]})
"""


def _text_attr(key: str, value: str, when: str) -> str:
    return f"""CASE WHEN {when} THEN '{{"key":"{key}","value":{{"stringValue":' || {value} || '}}}}' END"""


def _by_type(names: dict[str, str]) -> str:
    return "coalesce(CASE event_type " + " ".join(f"WHEN '{k}' THEN '\"{v}\"'" for k, v in names.items()) + " END, 'null')"


def _storage_sql() -> str:
    """Every stored object written out as JSON text."""
    quoted = lambda x: f"""'"' || {x} || '"'"""
    langfuse = {"click": "GENERATION", "view": "agent", "purchase": "Tool", "signup": "retriever", "error": "unknown"}
    openinference = {"click": "llm", "view": "CHAIN", "purchase": "Tool", "signup": "EMBEDDING", "error": "RERANKER"}
    genai = {"click": "chat", "view": "embeddings", "purchase": "execute_tool", "signup": "invoke_agent", "error": "Chat"}
    vercel = {"click": "ai.generateText.doGenerate", "view": "ai.embed.doEmbed", "purchase": "ai.toolCall", "signup": "ai.streamText.doStream", "error": "ai.other"}
    attributes = [
        _text_attr("langfuse.observation.type", _by_type(langfuse), "conv IN (0, 4)"),
        _text_attr("openinference.span.kind", _by_type(openinference), "conv = 1"),
        _text_attr("gen_ai.operation.name", _by_type(genai), "conv IN (2, 4)"),
        """CASE WHEN conv = 2 THEN '{"key":"gen_ai.usage.input_tokens","value":{"intValue":"' || user_id || '"}}' END""",
        """CASE WHEN conv IN (2, 4) THEN '{"key":"gen_ai.usage.output_tokens","value":{"intValue":' || coalesce(CAST(k AS VARCHAR), 'null') || '}}' END""",
        _text_attr("gen_ai.request.model", quoted("'req-' || (eid % 3)"), "conv IN (2, 4)"),
        _text_attr("gen_ai.response.model", quoted("'resp-' || (eid % 5)"), "conv = 2 AND eid % 2 = 0"),
        _text_attr("gen_ai.agent.name", quoted("'agent-' || user_id"), "conv = 2 AND event_type = 'signup'"),
        _text_attr("operation.name", _by_type(vercel), "conv = 3"),
        _text_attr("ai.model.id", quoted("'m-' || user_id"), "conv = 3 AND user_id % 2 = 0"),
        """CASE WHEN conv = 4 THEN '{"key":"langfuse.observation.model.name","value":{"arrayValue":{"values":[{"stringValue":"x"}]}}}' END""",
        _text_attr("user.id", quoted("'u' || user_id"), "eid % 4 = 0"),
        _text_attr("ai.telemetry.metadata.userId", quoted("'u' || user_id"), "eid % 4 = 1"),
        _text_attr("session.id", quoted("'s' || user_id"), "eid % 4 = 2"),
        _text_attr("langfuse.trace.tags", quoted("'t' || (user_id % 3) || ', x'"), "eid % 3 = 0"),
        _text_attr("tag.tags", """'"[\\"p\\",\\"q\\"]"'""", "eid % 9 = 1"),
        _text_attr("dup.key", """'"first"'""", "eid % 10 = 3"),
        _text_attr("dup.key", """'"second"'""", "eid % 10 = 3"),
    ]
    span_id = "CASE WHEN eid % 5 = 0 THEN '[' || array_to_string([(eid >> (8 * (7 - i))) & 255 FOR i IN range(8)], ',') || ']' ELSE '\"' || span_id || '\"' END"
    start = """CASE WHEN eid % 7 = 0 THEN '{"high":' || (ns >> 32) || ',"low":' || (ns & 4294967295) || '}' ELSE '"' || ns || '"' END"""
    return with_f4(
        f""", st_ns AS (SELECT *, epoch_us(ts) * 1000 AS ns FROM f4_sp),
        st_span AS (
          SELECT object_key, eid // 8 AS obj, trace_id,
            '{{"attributes":[' || array_to_string([x FOR x IN [{", ".join(attributes)}] IF x IS NOT NULL], ',') ||
            '],"endTimeUnixNano":"' || (ns + 1000000000) || '","name":"span-' || event_type || '","parentSpanId":' ||
            coalesce('"' || parent_span_id || '"', 'null') || ',"spanId":' || {span_id} || ',"startTimeUnixNano":' || {start} ||
            ',"traceId":"' || trace_id || '"}}' AS span
          FROM st_ns
        ), st_obj AS (
          SELECT obj, strlen('[{{"resource":{{"service":"f4"}},"' || CASE WHEN obj % 3 = 0 THEN 'instrumentationLibrarySpans' ELSE 'scopeSpans' END ||
            '":[{{"scope":{{"name":"overlay"}},"spans":[' || string_agg(span, ',') || ']}}]}}]') AS bytes
          FROM st_span GROUP BY obj
        ), st_all AS (SELECT count(*) AS object_count, CAST(sum(bytes) AS BIGINT) AS total_bytes FROM st_obj),
        st_trace AS (SELECT trace_id, sum(strlen(span)) AS bytes FROM st_span GROUP BY trace_id),
        st_spread AS (
          SELECT count(*) AS n, list_sort(list(CAST(bytes AS BIGINT))) AS sizes FROM st_trace
        )
        SELECT object_count, (SELECT count(DISTINCT batch) FROM ({ORACLE["batch_manifest"]})) AS manifest_count, total_bytes,
          CAST(round(total_bytes / n) AS BIGINT) AS mean_bytes_per_trace, sizes[1] AS min_bytes,
          sizes[CAST(floor((n - 1) * 0.5) AS BIGINT) + 1] AS p50_bytes,
          sizes[CAST(floor((n - 1) * 0.95) AS BIGINT) + 1] AS p95_bytes, sizes[n] AS max_bytes
        FROM st_all, st_spread"""
    )


ORACLE["storage_stats"] = _storage_sql()
