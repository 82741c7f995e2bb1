"""DuckDB SQL equivalents of the registered queries (independent oracle).

The CTEs restate the adapter rules of ``sources/adapters.py`` in SQL.
"""

from __future__ import annotations

AS_OF = "TIMESTAMP '2024-01-20 00:00:00'"

REGISTRY_CTE = """
reg_defs AS (
  SELECT * FROM (VALUES
    ('user_age', 1, 'int64', 'user', 24),
    ('user_lifetime_value', 1, 'float64', 'user', 24),
    ('last_purchase_days', 1, 'int64', 'user', 24),
    ('avg_5min_purchase_value', 1, 'float64', 'user', 1),
    ('product_view_count', 1, 'int64', 'product', 24)
  ) t(name, version, dtype, entity_type, ttl_hours)
  UNION ALL
  SELECT DISTINCT event_type, 1, 'float64', 'user', 24 FROM events
  UNION ALL
  SELECT DISTINCT event_type, 2, 'float64', 'user', 72 FROM events WHERE event_type = 'purchase'
),
registry AS (
  SELECT CAST(row_number() OVER (ORDER BY name, version) AS INTEGER) AS feature_id,
         name, CAST(version AS INTEGER) AS version, dtype, entity_type,
         CAST(ttl_hours AS INTEGER) AS ttl_hours
  FROM reg_defs
),
fv AS (
  SELECT r.feature_id, r.name AS feature_name, r.version AS feature_version, r.ttl_hours,
         'user_' || CAST(e.user_id AS VARCHAR) AS entity_id, e.ts AS event_ts,
         e.value AS value_num, e.props AS metadata, e.event_id AS write_seq
  FROM events e JOIN registry r
    ON r.name = e.event_type
   AND r.version = CASE WHEN e.event_type = 'purchase'
                         AND e.ts >= TIMESTAMP '2024-01-15 00:00:00' THEN 2 ELSE 1 END
)"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"


PIT_CTE = f"""
pit AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY entity_id, feature_name
                                 ORDER BY event_ts DESC, feature_version DESC, write_seq DESC) AS rn
    FROM fv WHERE event_ts <= {AS_OF}) WHERE rn = 1
)"""

SPINE_CTE = """
spine AS (
  SELECT event_id AS spine_id, 'user_' || CAST(user_id AS VARCHAR) AS entity_id, ts AS label_ts
  FROM events WHERE event_type = 'signup'
)"""


def asof_feature_cte(name: str, feature: str) -> str:
    return f"""
{name} AS (
  SELECT entity_id, event_ts, value_num, feature_version, write_seq FROM fv WHERE feature_name = '{feature}'
)"""


ORACLES = {
    "pit_lookup": with_ctes(REGISTRY_CTE, PIT_CTE) + """
SELECT entity_id, feature_name, round(value_num, 6) AS value, event_ts, feature_version, write_seq
FROM pit""",

    "pit_asof_join": with_ctes(REGISTRY_CTE, SPINE_CTE, asof_feature_cte("p", "purchase")) + """
SELECT s.spine_id, s.entity_id, s.label_ts, round(p.value_num, 6) AS purchase_value,
       p.event_ts AS purchase_ts
FROM spine s ASOF LEFT JOIN p ON s.entity_id = p.entity_id AND s.label_ts >= p.event_ts""",
}


def pit_at(name: str, ts: str, where: str = "") -> str:
    extra = f" AND {where}" if where else ""
    return f"""
{name} AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY entity_id, feature_name
                                 ORDER BY event_ts DESC, feature_version DESC, write_seq DESC) AS rn
    FROM fv WHERE event_ts <= TIMESTAMP '{ts}'{extra}) WHERE rn = 1
)"""


EV_CTE = """
ev AS (
  SELECT event_id, 'user_' || CAST(user_id AS VARCHAR) AS entity_id, event_type, value, ts, props FROM events
)"""


def sliding_cte(name: str, width: str, slide: str, n: int, suffix: str) -> str:
    return f"""
{name} AS (
  SELECT entity_id, event_type, window_start, window_start + INTERVAL '{width}' AS window_end,
         avg(value) AS avg_{suffix}, stddev_samp(value) AS stddev_{suffix}, max(value) AS max_{suffix},
         min(value) AS min_{suffix}, count(value) AS n_events
  FROM (SELECT ev.*, time_bucket(INTERVAL '{slide}', ts, TIMESTAMP '1970-01-01') - k * INTERVAL '{slide}'
               AS window_start
        FROM ev, range({n}) r(k))
  GROUP BY entity_id, event_type, window_start
)"""


def stats_select(src: str, suffix: str) -> str:
    return f"""
SELECT entity_id, event_type, window_start, window_end,
       round(avg_{suffix}, 6) AS avg_{suffix}, round(stddev_{suffix}, 6) AS stddev_{suffix},
       round(max_{suffix}, 6) AS max_{suffix}, round(min_{suffix}, 6) AS min_{suffix}, n_events
FROM {src}"""


LATE_CTE = """
late AS (
  SELECT feature_id, feature_name, entity_id, event_ts, value_num FROM fv
  UNION ALL
  SELECT r.feature_id, 'purchase', 'user_' || CAST(e.user_id AS VARCHAR), e.ts - INTERVAL '1 day', e.value
  FROM events e, registry r WHERE e.event_type = 'signup' AND r.name = 'purchase' AND r.version = 1
)"""

CLOSED_CTE = """
closed AS (
  SELECT * FROM st
  WHERE window_end <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL '10 minutes' FROM ev)
)"""

ORDERS_CTE = """
o AS (
  SELECT 'cust_' || CAST(o_custkey AS VARCHAR) AS entity_id, o_orderdate AS event_ts,
         o_totalprice AS value_num, o_orderstatus AS status, o_orderkey AS write_seq
  FROM orders
)"""

LOG_CTE = """
log AS (
  SELECT event_id AS request_id,
         CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) < 40 THEN 'tenant1_key'
              WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) < 70 THEN 'tenant2_key'
              WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) < 90 THEN 'dev_key'
              WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) < 95 THEN 'revoked_key' END AS api_key,
         CASE WHEN event_type IN ('view', 'click') THEN '/features/online'
              WHEN event_type = 'purchase' THEN '/features/batch'
              WHEN event_type = 'signup' THEN '/features/register'
              ELSE '/features/invalidate' END AS endpoint,
         CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status,
         'user_' || CAST(user_id AS VARCHAR) AS entity_id, ts AS request_ts, value AS latency_ms
  FROM events
)"""

BUCKETS_CTE = """
buckets AS (
  SELECT CAST(le AS DOUBLE) AS le, bucket FROM (VALUES
    ('0.001', 0), ('0.0025', 1), ('0.005', 2), ('0.01', 3), ('0.025', 4), ('0.05', 5), ('0.1', 6),
    ('0.25', 7), ('0.5', 8), ('1.0', 9), ('2.5', 10), ('inf', 11)) t(le, bucket)
),
hist AS (
  SELECT l.endpoint, b.le, b.bucket,
         CAST(sum(CASE WHEN b.bucket = 11 OR l.latency_ms * 0.001 <= b.le THEN 1 ELSE 0 END) AS BIGINT) AS cum
  FROM log l, buckets b GROUP BY l.endpoint, b.le, b.bucket
)"""

SNAP_CTE = pit_at("pit15", "2024-01-15 00:00:00", "feature_name IN ('purchase', 'view', 'click', 'signup', 'error')") + """,
snap AS (
  SELECT entity_id, feature_name, value_num, event_ts AS value_ts, write_seq,
         TIMESTAMP '2024-01-15 00:00:00' AS written_at,
         TIMESTAMP '2024-01-15 00:00:00' + ttl_hours * INTERVAL '1 hour' AS expires_at
  FROM pit15
),
req AS (
  SELECT e.event_id AS request_id, 'user_' || CAST(e.user_id AS VARCHAR) AS entity_id, e.ts AS request_ts,
         f.pos, f.feature_name
  FROM events e, (VALUES (0, 'purchase'), (1, 'view'), (2, 'click')) f(pos, feature_name)
),
probe AS (
  SELECT r.*, coalesce(s.written_at <= r.request_ts AND r.request_ts < s.expires_at, false) AS hit,
         s.value_num AS c_value, s.value_ts AS c_ts
  FROM req r LEFT JOIN snap s ON r.entity_id = s.entity_id AND r.feature_name = s.feature_name
),
fetched AS (
  SELECT m.request_id, m.entity_id, m.request_ts, m.pos, m.feature_name, f.value_num, f.event_ts AS value_ts,
         f.write_seq AS v_seq
  FROM (SELECT * FROM probe WHERE NOT hit) m
  ASOF JOIN fv f ON m.entity_id = f.entity_id AND m.feature_name = f.feature_name AND m.request_ts >= f.event_ts
),
answers AS (
  SELECT a.*, CASE WHEN fl.all_hit THEN 'cache' ELSE 'database' END AS source,
         (epoch_us(a.request_ts) - epoch_us(a.value_ts)) / 1000000.0 AS freshness_seconds
  FROM (SELECT request_id, entity_id, request_ts, pos, feature_name, c_value AS value_num, c_ts AS value_ts,
               true AS hit FROM probe WHERE hit
        UNION ALL
        SELECT request_id, entity_id, request_ts, pos, feature_name, value_num, value_ts, false AS hit
        FROM fetched) a
  JOIN (SELECT request_id, bool_and(hit) AS all_hit FROM probe GROUP BY request_id) fl USING (request_id)
)"""

USER_REG = "SELECT * FROM registry"

ORACLES.update({
    "pit_ttl": with_ctes(REGISTRY_CTE, PIT_CTE) + f"""
SELECT entity_id, feature_name, round(value_num, 6) AS value, event_ts, feature_version, write_seq
FROM pit WHERE event_ts >= {AS_OF} - ttl_hours * INTERVAL '1 hour'""",

    "pit_latest_version": with_ctes(REGISTRY_CTE, pit_at("pitl", "2024-01-20 00:00:00",
        "(feature_name, feature_version) IN (SELECT name, max(version) FROM registry GROUP BY name)")) + """
SELECT entity_id, feature_name, round(value_num, 6) AS value, event_ts, feature_version, write_seq FROM pitl""",

    "pit_entity_set": with_ctes(REGISTRY_CTE, pit_at("pite", "2024-01-20 00:00:00",
        "feature_name IN ('purchase', 'click') AND entity_id IN (SELECT 'user_' || CAST(user_id AS VARCHAR) "
        "FROM events WHERE event_type = 'error' AND CAST(ts AS DATE) = DATE '2024-01-19')")) + """
SELECT entity_id, feature_name, round(value_num, 6) AS value, event_ts FROM pite""",

    "pit_wide": with_ctes(REGISTRY_CTE, PIT_CTE) + """
SELECT entity_id,
       round(max(CASE WHEN feature_name = 'purchase' THEN value_num END), 6) AS purchase_value,
       round(max(CASE WHEN feature_name = 'view' THEN value_num END), 6) AS view_value,
       round(max(CASE WHEN feature_name = 'click' THEN value_num END), 6) AS click_value,
       round(max(CASE WHEN feature_name = 'signup' THEN value_num END), 6) AS signup_value,
       round(max(CASE WHEN feature_name = 'error' THEN value_num END), 6) AS error_value
FROM pit WHERE feature_name IN ('purchase', 'view', 'click', 'signup', 'error') GROUP BY entity_id""",

    "feature_map": with_ctes(REGISTRY_CTE, PIT_CTE) + """
SELECT entity_id, string_agg(feature_name || '=' || printf('%.2f', value_num), ';' ORDER BY feature_name)
       AS feature_map, count(*) AS n_features
FROM pit GROUP BY entity_id""",

    "freshness": with_ctes(REGISTRY_CTE, PIT_CTE) + f"""
SELECT entity_id, feature_name,
       round((epoch_us({AS_OF}) - epoch_us(event_ts)) / 1000000.0, 6) AS freshness_seconds
FROM pit""",

    "history_range": with_ctes(REGISTRY_CTE) + """
SELECT entity_id, feature_name, round(value_num, 6) AS value, event_ts, coalesce(metadata, '{}') AS metadata,
       write_seq
FROM fv WHERE feature_name = 'purchase'
  AND event_ts BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-12 00:00:00'""",

    "pit_asof_wide": with_ctes(REGISTRY_CTE, SPINE_CTE, asof_feature_cte("p", "purchase"),
                               asof_feature_cte("v", "view"), asof_feature_cte("c", "click")) + """
SELECT s.spine_id, s.entity_id, s.label_ts,
       round(p.value_num, 6) AS purchase_value, p.event_ts AS purchase_ts,
       round(v.value_num, 6) AS view_value, v.event_ts AS view_ts,
       round(c.value_num, 6) AS click_value, c.event_ts AS click_ts
FROM spine s
ASOF LEFT JOIN p ON s.entity_id = p.entity_id AND s.label_ts >= p.event_ts
ASOF LEFT JOIN v ON s.entity_id = v.entity_id AND s.label_ts >= v.event_ts
ASOF LEFT JOIN c ON s.entity_id = c.entity_id AND s.label_ts >= c.event_ts""",

    "days_since_purchase": with_ctes(REGISTRY_CTE, SPINE_CTE, asof_feature_cte("p", "purchase")) + """
SELECT s.spine_id, s.entity_id, s.label_ts,
       CAST(date_diff('day', CAST(p.event_ts AS DATE), CAST(s.label_ts AS DATE)) AS INTEGER) AS last_purchase_days
FROM spine s ASOF LEFT JOIN p ON s.entity_id = p.entity_id AND s.label_ts >= p.event_ts""",

    "batch_retrieval": with_ctes(REGISTRY_CTE) + """
, ask AS (
  SELECT event_id AS request_id, 'user_' || CAST(user_id + i AS VARCHAR) AS entity_id, ts AS as_of, feature_name
  FROM events, (VALUES (0), (1), (2)) n(i), (VALUES ('purchase'), ('view'), ('signup')) f(feature_name)
  WHERE event_type = 'click'
), hits AS (
  SELECT b.request_id, b.entity_id, b.feature_name, f.value_num, f.event_ts AS value_ts
  FROM ask b ASOF JOIN fv f ON b.entity_id = f.entity_id AND b.feature_name = f.feature_name
                           AND b.as_of >= f.event_ts
), cnt AS (SELECT request_id, count(DISTINCT entity_id) AS entities_returned FROM hits GROUP BY request_id)
SELECT request_id, entity_id, feature_name, round(value_num, 6) AS value, value_ts, entities_returned
FROM hits JOIN cnt USING (request_id)""",

    "request_rejects": """
SELECT event_id AS request_id, concat_ws(',', CASE WHEN user_id % 7 = 0 THEN 'no_entities' END,
                                         CASE WHEN day(ts) % 10 = 0 THEN 'no_features' END) AS violations
FROM events WHERE event_type = 'click' AND (user_id % 7 = 0 OR day(ts) % 10 = 0)""",

    "sliding_stats": with_ctes(EV_CTE, sliding_cte("st", "5 minutes", "1 minute", 5, "5min"))
        + stats_select("st", "5min"),

    "sliding_stats_1d6h": with_ctes(EV_CTE, sliding_cte("st", "1 day", "6 hours", 4, "1d"))
        + stats_select("st", "1d"),

    "stream_window_stats": with_ctes(EV_CTE, sliding_cte("st", "5 minutes", "1 minute", 5, "5min"))
        + stats_select("st", "5min"),

    "window_long": with_ctes(EV_CTE, sliding_cte("st", "5 minutes", "1 minute", 5, "5min")) + """
SELECT entity_id, feature_name, round(value, 6) AS value, window_end AS event_ts, window_start FROM (
  SELECT entity_id, CASE WHEN event_type = 'purchase' THEN 'avg_5min_purchase_value'
                         ELSE 'avg_5min_' || event_type END AS feature_name,
         avg_5min AS value, window_start, window_end FROM st
  UNION ALL SELECT entity_id, 'stddev_5min_' || event_type, stddev_5min, window_start, window_end FROM st
  UNION ALL SELECT entity_id, 'max_5min_' || event_type, max_5min, window_start, window_end FROM st
  UNION ALL SELECT entity_id, 'min_5min_' || event_type, min_5min, window_start, window_end FROM st
) WHERE value IS NOT NULL""",

    "purchase_count_7d": with_ctes(EV_CTE) + """
SELECT entity_id, ts AS event_ts, event_id,
       count(*) OVER (PARTITION BY entity_id ORDER BY ts
                      RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND CURRENT ROW) AS purchase_count_7d
FROM ev WHERE event_type = 'purchase'""",

    "product_stats": """
SELECT 'product_' || json_extract_string(props, '$.k') AS entity_id,
       CAST(sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS BIGINT) AS product_view_count,
       CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS BIGINT) AS purchases,
       round(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END)
             / nullif(sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END), 0)::DOUBLE, 6)
         AS product_conversion_rate
FROM events GROUP BY 1""",

    "session_duration": with_ctes(EV_CTE) + """
, g AS (
  SELECT entity_id, ts,
         CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 30 MINUTES THEN 1 ELSE 0 END AS new_s
  FROM ev WINDOW w AS (PARTITION BY entity_id ORDER BY ts)
), s AS (
  SELECT entity_id, ts, sum(new_s) OVER (PARTITION BY entity_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid
  FROM g
)
SELECT entity_id, min(ts) AS session_start, max(ts) AS session_end, count(*) AS n_events,
       CAST(floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0) AS BIGINT) AS session_duration_seconds
FROM s GROUP BY entity_id, sid""",


    "seed_counts": with_ctes(REGISTRY_CTE) + """
SELECT feature_name, count(*) AS n_rows, count(DISTINCT entity_id) AS n_entities,
       min(event_ts) AS first_ts, max(event_ts) AS last_ts
FROM fv GROUP BY feature_name""",

    "upsert_last_wins": with_ctes(ORDERS_CTE) + """
SELECT entity_id, event_ts, round(value_num, 6) AS value, write_seq FROM (
  SELECT *, row_number() OVER (PARTITION BY entity_id, event_ts ORDER BY side DESC, write_seq DESC) AS rn FROM (
    SELECT entity_id, event_ts, value_num, write_seq, 0 AS side FROM o WHERE status = 'F'
    UNION ALL
    SELECT entity_id, event_ts, value_num, write_seq, 1 FROM o WHERE status <> 'F')) WHERE rn = 1""",

    "upsert_replaces": with_ctes(ORDERS_CTE) + """
SELECT entity_id, event_ts, round(value_num, 6) AS value, write_seq FROM (
  SELECT *, row_number() OVER (PARTITION BY entity_id, event_ts ORDER BY side DESC, write_seq DESC) AS rn FROM (
    SELECT entity_id, event_ts, value_num, write_seq, 0 AS side FROM o WHERE status = 'F'
    UNION ALL
    SELECT entity_id, event_ts, value_num, -write_seq, 1 FROM o WHERE status <> 'F')) WHERE rn = 1""",

    "recent_order_dates": with_ctes(ORDERS_CTE) + """
SELECT entity_id, event_ts, round(value_num, 6) AS value, write_seq FROM o
ORDER BY event_ts DESC, entity_id, write_seq LIMIT 5""",

    "feature_by_id": with_ctes(REGISTRY_CTE) + """
SELECT feature_id, name, version, dtype, entity_type, ttl_hours FROM registry
WHERE feature_id IN (SELECT feature_id FROM fv)""",

    "feature_resolve": with_ctes(REGISTRY_CTE) + """
SELECT 'v1' AS asked, feature_id, name, version, ttl_hours FROM registry WHERE name = 'purchase' AND version = 1
UNION ALL
SELECT 'latest', feature_id, name, version, ttl_hours FROM registry
WHERE name = 'purchase' AND version = (SELECT max(version) FROM registry WHERE name = 'purchase')""",

    "definitions_load": with_ctes(REGISTRY_CTE) + """
, h AS (SELECT regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS name, CAST(count(*) - 1 AS INTEGER) AS ttl
       FROM pages GROUP BY 1)
SELECT feature_id, name, version, dtype, entity_type, ttl_hours FROM registry
UNION ALL
SELECT CAST((SELECT max(feature_id) FROM registry) + row_number() OVER (ORDER BY name) AS INTEGER), name, 1,
       'float64', 'page', ttl FROM h WHERE ttl >= 1 AND length(name) <= 18""",

    "entities_served": with_ctes(LOG_CTE) + """
SELECT split_part(entity_id, '_', 1) AS entity_type, date_trunc('day', request_ts) AS window_start,
       count(DISTINCT entity_id) AS entities, count(*) AS requests
FROM log WHERE status < 400 GROUP BY 1, 2""",

    "asof_any_type": """
WITH s AS (SELECT event_id AS spine_id, user_id, ts FROM events WHERE event_type = 'signup')
SELECT s.spine_id, '"' || e.event_type || '"' AS last_kind, CAST(e.value > 50 AS VARCHAR) AS is_high,
       e.props AS last_doc, CAST(9007199254740992 + e.event_id AS VARCHAR) AS big_seq, e.ts AS last_doc_ts
FROM s ASOF LEFT JOIN events e ON s.user_id = e.user_id AND s.ts >= e.ts""",

    "batch_any_type": """
WITH ask AS (SELECT event_id AS request_id, user_id, ts AS as_of FROM events WHERE event_type = 'click'),
hits AS (
  SELECT a.request_id, e.user_id, e.event_type, e.value, e.props, e.event_id, e.ts
  FROM (SELECT request_id, user_id + i AS user_id, as_of FROM ask, (VALUES (0), (1), (2)) n(i)) a
  ASOF JOIN events e ON a.user_id = e.user_id AND a.as_of >= e.ts),
cnt AS (SELECT request_id, count(DISTINCT user_id) AS entities_returned FROM hits GROUP BY request_id)
SELECT request_id, 'user_' || CAST(user_id AS VARCHAR) AS entity_id, f.feature_name, f.value_json, ts AS value_ts,
       entities_returned
FROM hits JOIN cnt USING (request_id), LATERAL (VALUES
  ('last_kind', '"' || event_type || '"'), ('is_high', CAST(value > 50 AS VARCHAR)), ('last_doc', props),
  ('big_seq', CAST(9007199254740992 + event_id AS VARCHAR))) f(feature_name, value_json)""",

    "window_merge": with_ctes(REGISTRY_CTE, EV_CTE, sliding_cte("st", "5 minutes", "1 minute", 5, "5min")) + """
, new AS (
  SELECT r.feature_id, st.entity_id, st.window_end AS event_ts, st.avg_5min AS value_num, 0 AS write_seq
  FROM st, registry r WHERE st.event_type = 'purchase' AND r.name = 'avg_5min_purchase_value' AND st.avg_5min IS NOT NULL),
pooled AS (
  SELECT feature_id, entity_id, event_ts, value_num, write_seq, 0 AS side FROM fv
  WHERE CAST(event_ts AS DATE) IN (SELECT CAST(event_ts AS DATE) FROM new)
  UNION ALL SELECT *, 1 FROM new)
SELECT feature_id, entity_id, event_ts, round(value_num, 6) AS value, write_seq FROM (
  SELECT *, row_number() OVER (PARTITION BY feature_id, entity_id, event_ts ORDER BY side DESC, write_seq DESC) AS rn
  FROM pooled) WHERE rn = 1""",

    "window_unresolved": with_ctes(EV_CTE, sliding_cte("st", "5 minutes", "1 minute", 5, "5min")) + """
SELECT feature_name, count(*) AS n_rows FROM (
  SELECT 'avg_5min_' || event_type AS feature_name, avg_5min AS value FROM st WHERE event_type <> 'purchase'
  UNION ALL SELECT 'max_5min_' || event_type, max_5min FROM st) WHERE value IS NOT NULL GROUP BY feature_name""",

    "definition_rejects": """
WITH h AS (SELECT regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS name, count(*) - 1 AS ttl FROM pages GROUP BY 1)
SELECT name, concat_ws(',', CASE WHEN ttl < 1 THEN 'ttl_lt_1' END,
                       CASE WHEN length(name) > 18 THEN 'dtype_missing' END) AS violations
FROM h WHERE ttl < 1 OR length(name) > 18""",

    "cascade_delete": with_ctes(REGISTRY_CTE) + """
SELECT feature_id, count(*) AS n_rows FROM fv WHERE feature_name <> 'error' GROUP BY feature_id""",

    "json_filter_typed": """
WITH e AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) = 42 AS a, value > 50 AS b,
                  event_type = 'click' AS c FROM events)
SELECT event_id, coalesce(a, false) AS k_42, coalesce(b, false) AS high, coalesce(c, false) AS kind_click,
       false AS kind_true FROM e WHERE a OR b OR c""",

    "closed_window_snapshot": with_ctes(EV_CTE, sliding_cte("st", "5 minutes", "1 minute", 5, "5min")) + """
, f AS (
  SELECT entity_id, CASE WHEN event_type = 'purchase' THEN 'avg_5min_purchase_value' ELSE 'avg_5min_' || event_type END
           AS feature_name, avg_5min AS value, window_end FROM st
  UNION ALL
  SELECT entity_id, 'max_5min_' || event_type, max_5min, window_end FROM st)
SELECT entity_id, feature_name, round(arg_max(value, window_end), 6) AS value, max(window_end) AS value_ts
FROM f WHERE window_end <= TIMESTAMP '2024-01-15 00:00:00' AND value IS NOT NULL GROUP BY entity_id, feature_name""",

    "pit_asof_late_write": with_ctes(REGISTRY_CTE, LATE_CTE, SPINE_CTE) + """
, p AS (SELECT * FROM late WHERE feature_name = 'purchase'), v AS (SELECT * FROM late WHERE feature_name = 'view'),
a AS (SELECT s.*, p.value_num AS pv, p.event_ts AS pt FROM spine s ASOF LEFT JOIN p
      ON s.entity_id = p.entity_id AND s.label_ts >= p.event_ts)
SELECT a.spine_id, round(pv, 6) AS purchase_value, pt AS purchase_ts, round(v.value_num, 6) AS view_value, v.event_ts AS view_ts
FROM a ASOF LEFT JOIN v ON a.entity_id = v.entity_id AND a.label_ts >= v.event_ts""",

    "rollup_invalidated": with_ctes(REGISTRY_CTE, LATE_CTE) + """
SELECT feature_id, entity_id, date_trunc('hour', event_ts) AS hour, count(*) AS update_count, max(event_ts) AS last_update
FROM late GROUP BY ALL""",

    "typed_values": """
SELECT event_id AS write_seq, f.feature_name,
       CASE WHEN feature_name = 'big_seq' THEN 9007199254740992 + event_id END AS as_int64,
       CASE WHEN feature_name = 'is_high' THEN value > 50 END AS as_bool,
       CASE WHEN feature_name = 'last_kind' THEN event_type END AS as_string,
       CASE WHEN feature_name = 'last_doc' THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS as_object_k,
       CAST(NULL AS DOUBLE) AS as_float64, true AS matches
FROM events, (VALUES ('last_kind'), ('is_high'), ('last_doc'), ('big_seq')) f(feature_name)""",

    # The watermark is kept in milliseconds; windows that end at it or before have left the stream.
    "stream_closed_snapshot": with_ctes(EV_CTE, sliding_cte("st", "5 minutes", "1 minute", 5, "5min"), CLOSED_CTE) + """
, f AS (
  SELECT entity_id, CASE WHEN event_type = 'purchase' THEN 'avg_5min_purchase_value' ELSE 'avg_5min_' || event_type END
           AS feature_name, avg_5min AS value, window_end FROM closed
  UNION ALL
  SELECT entity_id, 'max_5min_' || event_type, max_5min, window_end FROM closed)
SELECT entity_id, feature_name, round(arg_max(value, window_end), 6) AS value, max(window_end) AS value_ts,
       max(window_end) AS written_at, max(window_end) + INTERVAL '1 hour' AS expires_at
FROM f WHERE value IS NOT NULL GROUP BY entity_id, feature_name""",

    "stream_closed_log": with_ctes(EV_CTE, sliding_cte("st", "5 minutes", "1 minute", 5, "5min"), CLOSED_CTE) + """
SELECT CAST(window_start AS DATE) AS dt, count(*) AS n_windows, CAST(sum(n_events) AS BIGINT) AS n_events,
       count(*) AS n_distinct, max(window_end) AS last_end, count(*) AS n_stamped FROM closed GROUP BY 1""",

    "compaction_written": with_ctes(REGISTRY_CTE) + """
, all_rows AS (
  SELECT feature_id, entity_id, event_ts, value_num, write_seq FROM fv
  UNION ALL
  SELECT feature_id, entity_id, event_ts, value_num + 1, write_seq + 1000000000 FROM fv WHERE feature_name = 'click')
SELECT feature_id, entity_id, event_ts, round(value_num, 6) AS value, write_seq FROM all_rows
WHERE event_ts >= TIMESTAMP '2024-01-24 00:00:00'
UNION ALL
SELECT feature_id, entity_id, event_ts, round(arg_max(value_num, write_seq), 6), max(write_seq) FROM all_rows
WHERE event_ts < TIMESTAMP '2024-01-24 00:00:00' GROUP BY ALL""",

    "window_merge_written": with_ctes(REGISTRY_CTE, EV_CTE, sliding_cte("st", "5 minutes", "1 minute", 5, "5min")) + """
SELECT feature_id, entity_id, event_ts, round(value_num, 6) AS value, write_seq FROM fv
UNION ALL
SELECT r.feature_id, st.entity_id, st.window_end, round(st.avg_5min, 6), 0
FROM st, registry r WHERE st.event_type = 'purchase' AND r.name = 'avg_5min_purchase_value' AND st.avg_5min IS NOT NULL""",

    "invalidate_count": with_ctes(REGISTRY_CTE, SNAP_CTE) + """
SELECT count(*) AS removed FROM snap
WHERE regexp_matches(entity_id || ':' || feature_name, '^user_[1-3].*:[^c-p].*$')""",

    "group_hosts": with_ctes(REGISTRY_CTE) + """
, h AS (SELECT regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host, count(*) - 1 AS ttl FROM pages GROUP BY 1),
d AS (SELECT host, (SELECT max(feature_id) FROM registry) + row_number() OVER (ORDER BY host) AS id
      FROM h WHERE length(host) <= 18 AND ttl >= 1)
SELECT split_part(h.host, '.', -1) AS "group", h.host AS member, CAST(d.id AS INTEGER) AS feature_id,
       CASE WHEN d.id IS NOT NULL THEN 1 END AS version, d.id IS NULL AS dangling
FROM h LEFT JOIN d USING (host)""",

    "table_statistics": """
SELECT 'write_seq' AS "column", count(*) - count(event_id) AS num_nulls, CAST(min(event_id) AS DOUBLE) AS min,
       CAST(max(event_id) AS DOUBLE) AS max, count(*) AS n_rows FROM events
UNION ALL
SELECT 'value_num', count(*) - count(value), round(min(value), 6), round(max(value), 6), count(*) FROM events""",

    "stream_quarantine": """
SELECT CASE event_type WHEN 'error' THEN 'bad_timestamp' WHEN 'click' THEN 'no_event_type' ELSE 'unparsed_or_no_entity' END
         AS reason, count(*) AS n_rows
FROM events WHERE event_type IN ('error', 'click', 'signup', 'view') GROUP BY 1""",

    "stream_late_rows": with_ctes(EV_CTE) + """
, b AS (SELECT *, event_type = 'click' AND ts < TIMESTAMP '2024-01-20 00:00:00' AND ts >= TIMESTAMP '2024-01-19 00:00:00' AS held
        FROM ev),
wm AS (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL '10 minutes' AS w FROM b
       WHERE ts < TIMESTAMP '2024-01-20 00:00:00' AND NOT held),
x AS (SELECT b.*, time_bucket(INTERVAL '1 minute', ts, TIMESTAMP '1970-01-01') - k * INTERVAL '1 minute' AS window_start
      FROM b, range(5) r(k)),
st AS (
  SELECT entity_id, event_type, window_start, window_start + INTERVAL '5 minutes' AS window_end, avg(value) AS avg_5min,
         stddev_samp(value) AS stddev_5min, max(value) AS max_5min, min(value) AS min_5min, count(value) AS n_events
  FROM x, wm WHERE NOT held OR window_start + INTERVAL '5 minutes' > w GROUP BY entity_id, event_type, window_start)"""
        + stats_select("st", "5min"),

    "insert_ignore": with_ctes(ORDERS_CTE) + """
, t AS (SELECT entity_id, event_ts, arg_min(value_num, write_seq) AS value_num, min(write_seq) AS write_seq
        FROM o WHERE status = 'F' GROUP BY entity_id, event_ts),
n AS (SELECT entity_id, event_ts, arg_min(value_num, write_seq) AS value_num, min(write_seq) AS write_seq
      FROM o WHERE status <> 'F' GROUP BY entity_id, event_ts)
SELECT entity_id, event_ts, round(value_num, 6) AS value, write_seq FROM t
UNION ALL
SELECT n.entity_id, n.event_ts, round(n.value_num, 6), n.write_seq FROM n
WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.entity_id = n.entity_id AND t.event_ts = n.event_ts)""",

    "compaction": with_ctes(ORDERS_CTE) + """
SELECT entity_id, event_ts, round(arg_max(value_num, write_seq), 6) AS value, max(write_seq) AS write_seq
FROM o WHERE CAST(event_ts AS DATE) < DATE '1997-12-25' GROUP BY entity_id, event_ts
UNION ALL
SELECT entity_id, event_ts, round(value_num, 6), write_seq FROM o WHERE CAST(event_ts AS DATE) >= DATE '1997-12-25'""",

    "compaction_due": with_ctes(ORDERS_CTE) + """
SELECT entity_id, event_ts, CAST(event_ts AS DATE) AS dt, round(arg_max(value_num, write_seq), 6) AS value,
       max(write_seq) AS write_seq
FROM o WHERE CAST(event_ts AS DATE) >= DATE '1996-12-25' AND CAST(event_ts AS DATE) < DATE '1997-12-25'
GROUP BY entity_id, event_ts""",

    "retention": with_ctes(REGISTRY_CTE) + """
SELECT feature_id, entity_id, event_ts, round(value_num, 6) AS value, write_seq
FROM fv WHERE CAST(event_ts AS DATE) >= DATE '2024-01-21'""",

    "hourly_rollup": with_ctes(REGISTRY_CTE) + """
SELECT feature_id, entity_id, date_trunc('hour', event_ts) AS hour, count(*) AS update_count,
       max(event_ts) AS last_update
FROM fv GROUP BY ALL""",

    "rollup_refresh": with_ctes(REGISTRY_CTE) + """
SELECT feature_id, entity_id, date_trunc('hour', event_ts) AS hour, count(*) AS update_count,
       max(event_ts) AS last_update
FROM fv WHERE event_ts < TIMESTAMP '2024-01-20 10:00:00' GROUP BY ALL
UNION ALL
SELECT feature_id, entity_id, date_trunc('hour', event_ts) AS hour, count(*) AS update_count,
       max(event_ts) AS last_update
FROM fv WHERE event_ts >= TIMESTAMP '2024-01-20 10:00:00' AND event_ts < TIMESTAMP '2024-01-20 11:00:00'
GROUP BY ALL""",

    "registry_list": with_ctes(REGISTRY_CTE) + """
SELECT feature_id, name, version, dtype, entity_type, ttl_hours FROM registry WHERE entity_type = 'user'""",

    "registry_latest": with_ctes(REGISTRY_CTE) + """
SELECT name, version, feature_id, ttl_hours FROM (
  SELECT *, row_number() OVER (PARTITION BY name ORDER BY version DESC) AS rn FROM registry) WHERE rn = 1""",

    "registry_upsert": with_ctes(REGISTRY_CTE) + """
, rereg AS (
  SELECT DISTINCT event_type AS name, 1 AS version, 48 AS ttl_hours, event_type || ' event value' AS description
  FROM events
  UNION ALL
  SELECT DISTINCT 'purchase', 3, 24, 'purchase event value, v3' FROM events WHERE event_type = 'purchase'
), described AS (
  SELECT r.*, CASE WHEN name IN (SELECT DISTINCT event_type FROM events)
                   THEN CASE WHEN version = 2 THEN 'purchase event value, v2' ELSE name || ' event value' END
              END AS ev_desc
  FROM registry r
), seed_desc AS (
  SELECT * FROM (VALUES
    ('user_age', 'User age in years'), ('user_lifetime_value', 'Predicted customer lifetime value'),
    ('last_purchase_days', 'Days since last purchase'),
    ('avg_5min_purchase_value', '5-minute average purchase value'),
    ('product_view_count', 'Total product views')) t(name, description)
)
SELECT coalesce(d.feature_id, (SELECT max(feature_id) FROM registry)
                + CAST(row_number() OVER (PARTITION BY d.feature_id IS NULL ORDER BY n.name, n.version) AS INTEGER))
         AS feature_id,
       coalesce(d.name, n.name) AS name, coalesce(d.version, n.version) AS version,
       coalesce(n.ttl_hours, d.ttl_hours) AS ttl_hours,
       coalesce(n.description, d.ev_desc, sd.description) AS description,
       coalesce(CASE WHEN d.feature_id IS NOT NULL THEN TIMESTAMP '2024-01-01 00:00:00' END,
                TIMESTAMP '2024-02-01 00:00:00') AS created_at,
       CASE WHEN n.name IS NOT NULL THEN TIMESTAMP '2024-02-01 00:00:00'
            ELSE TIMESTAMP '2024-01-01 00:00:00' END AS updated_at
FROM described d FULL OUTER JOIN rereg n ON d.name = n.name AND d.version = n.version
LEFT JOIN seed_desc sd ON sd.name = d.name""",

    "group_members": with_ctes(REGISTRY_CTE) + """
, grp AS (SELECT * FROM (VALUES
    ('user_demographics', 0, 'user_age'), ('user_demographics', 1, 'user_gender'),
    ('user_demographics', 2, 'user_location'),
    ('user_behavior', 0, 'last_purchase_days'), ('user_behavior', 1, 'purchase_count_7d'),
    ('user_behavior', 2, 'avg_purchase_value'),
    ('realtime_metrics', 0, 'avg_5min_purchase_value'), ('realtime_metrics', 1, 'active_session_count'),
    ('product_metrics', 0, 'product_view_count'), ('product_metrics', 1, 'product_conversion_rate')
  ) t("group", pos, member)),
latest AS (SELECT name, arg_max(feature_id, version) AS feature_id, max(version) AS version
           FROM registry GROUP BY name)
SELECT g."group", g.pos, g.member, l.feature_id, l.version FROM grp g LEFT JOIN latest l ON l.name = g.member""",

    "group_dangling": with_ctes(REGISTRY_CTE) + """
, grp AS (SELECT * FROM (VALUES
    ('user_demographics', 0, 'user_age'), ('user_demographics', 1, 'user_gender'),
    ('user_demographics', 2, 'user_location'),
    ('user_behavior', 0, 'last_purchase_days'), ('user_behavior', 1, 'purchase_count_7d'),
    ('user_behavior', 2, 'avg_purchase_value'),
    ('realtime_metrics', 0, 'avg_5min_purchase_value'), ('realtime_metrics', 1, 'active_session_count'),
    ('product_metrics', 0, 'product_view_count'), ('product_metrics', 1, 'product_conversion_rate')
  ) t("group", pos, member))
SELECT "group", pos, member FROM grp WHERE member NOT IN (SELECT name FROM registry)""",

    "tag_search": with_ctes(REGISTRY_CTE) + """
SELECT feature_id, name, version FROM registry
WHERE name IN ('user_lifetime_value', 'avg_5min_purchase_value') OR name = 'purchase'""",

    "orphans": with_ctes(REGISTRY_CTE) + """
SELECT feature_id, entity_id, event_ts, write_seq FROM fv WHERE feature_name = 'error'""",

    "dtype_violations": with_ctes(REGISTRY_CTE) + """
SELECT feature_name, feature_version, CASE WHEN feature_name = 'click' THEN 'int64' ELSE 'float64' END AS dtype,
       count(*) AS checked,
       CAST(sum(CASE WHEN feature_name = 'click'
                      AND NOT regexp_full_match(CAST(value_num AS VARCHAR), '-?[0-9]+') THEN 1 ELSE 0 END)
            AS BIGINT) AS violations
FROM fv GROUP BY feature_name, feature_version""",

    "json_filter": with_ctes(REGISTRY_CTE) + """
SELECT entity_id, feature_name, event_ts, round(value_num, 6) AS value
FROM fv WHERE json_extract_string(metadata, '$.k') = '42'""",

    "snapshot": with_ctes(REGISTRY_CTE, SNAP_CTE) + """
SELECT entity_id, feature_name, round(value_num, 6) AS value, value_ts, written_at, expires_at FROM snap""",

    "cache_probe": with_ctes(REGISTRY_CTE, SNAP_CTE) + """
SELECT request_id, pos, feature_name, hit, round(CASE WHEN hit THEN c_value END, 6) AS cached_value,
       CASE WHEN hit THEN c_ts END AS cached_ts
FROM probe""",

    "online_replay": with_ctes(REGISTRY_CTE, SNAP_CTE) + """
SELECT request_id, pos, feature_name, round(value_num, 6) AS value, value_ts, hit, source,
       round(freshness_seconds, 6) AS freshness_seconds
FROM answers""",

    "snapshot_after_replay": with_ctes(REGISTRY_CTE, SNAP_CTE) + """
, allw AS (
  SELECT entity_id, feature_name, value_num, value_ts, written_at, expires_at, write_seq FROM snap
  UNION ALL
  SELECT entity_id, feature_name, value_num, value_ts, request_ts, request_ts + INTERVAL 3600 SECOND, request_id
  FROM fetched
)
SELECT entity_id, feature_name, round(value_num, 6) AS value, value_ts, written_at, expires_at FROM (
  SELECT *, row_number() OVER (PARTITION BY entity_id, feature_name ORDER BY written_at DESC, write_seq DESC) rn
  FROM allw) WHERE rn = 1""",

    "hit_rate": with_ctes(REGISTRY_CTE, SNAP_CTE) + """
SELECT feature_name, CAST(sum(CASE WHEN hit THEN 1 ELSE 0 END) AS BIGINT) AS hits,
       CAST(sum(CASE WHEN hit THEN 0 ELSE 1 END) AS BIGINT) AS misses,
       round(coalesce(sum(CASE WHEN hit THEN 1 ELSE 0 END) * 100.0 / nullif(count(*), 0), 0), 6) AS hit_rate_pct
FROM probe GROUP BY feature_name""",

    "freshness_gauge": with_ctes(REGISTRY_CTE, SNAP_CTE) + """
SELECT feature_name, round(freshness_seconds, 6) AS freshness_seconds, request_ts AS observed_at FROM (
  SELECT *, row_number() OVER (PARTITION BY feature_name ORDER BY request_ts DESC, request_id DESC) AS rn
  FROM answers WHERE freshness_seconds IS NOT NULL AND NOT hit) WHERE rn = 1""",

    "invalidate": with_ctes(REGISTRY_CTE, SNAP_CTE) + """
SELECT entity_id, feature_name, round(value_num, 6) AS value FROM snap
WHERE NOT ((entity_id || ':' || feature_name) GLOB 'user_1*:purchase')""",

    "snapshot_stats": with_ctes(REGISTRY_CTE, SNAP_CTE) + """
, live AS (SELECT * FROM snap WHERE written_at <= TIMESTAMP '2024-01-15 01:00:00'
                               AND TIMESTAMP '2024-01-15 01:00:00' < expires_at)
SELECT (SELECT count(*) FROM live) AS total_keys,
       CAST(sum(CASE WHEN hit THEN 1 ELSE 0 END) AS BIGINT) AS hits,
       CAST(sum(CASE WHEN hit THEN 0 ELSE 1 END) AS BIGINT) AS misses,
       round(coalesce(sum(CASE WHEN hit THEN 1 ELSE 0 END) * 100.0 / nullif(count(*), 0), 0), 6) AS hit_rate_pct
FROM probe""",

    "latency_summary": with_ctes(LOG_CTE) + """
SELECT endpoint, count(*) AS n,
       CAST(sum(CASE WHEN status >= 400 THEN 1 ELSE 0 END) AS BIGINT) AS errors,
       round(min(ok_ms), 6) AS min_ms, round(max(ok_ms), 6) AS max_ms,
       round(avg(ok_ms), 6) AS mean_ms, round(stddev_pop(ok_ms), 6) AS stddev_ms,
       round(coalesce((count(*) - sum(CASE WHEN status >= 400 THEN 1 ELSE 0 END)) * 100.0 / count(*), 0), 6)
         AS success_pct,
       round(quantile_cont(ok_ms, 0.5), 6) AS median_ms, round(quantile_cont(ok_ms, 0.9), 6) AS p90_ms,
       round(quantile_cont(ok_ms, 0.95), 6) AS p95_ms, round(quantile_cont(ok_ms, 0.99), 6) AS p99_ms
FROM (SELECT *, CASE WHEN status < 400 THEN latency_ms END AS ok_ms FROM log) GROUP BY endpoint""",

    "latency_histogram": with_ctes(LOG_CTE, BUCKETS_CTE) + """
SELECT endpoint, le, CAST(bucket AS INTEGER) AS bucket, cum FROM hist""",

    "histogram_quantile": with_ctes(LOG_CTE, BUCKETS_CTE) + """
, h AS (
  SELECT *, coalesce(lag(cum) OVER w, 0) AS prev_cum, coalesce(lag(le) OVER w, 0.0) AS prev_le,
         max(cum) OVER (PARTITION BY endpoint) AS total,
         max(CASE WHEN bucket < 11 THEN le END) OVER (PARTITION BY endpoint) AS max_finite
  FROM hist WINDOW w AS (PARTITION BY endpoint ORDER BY bucket)
), first_b AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY endpoint ORDER BY bucket) AS rn
                 FROM h WHERE cum >= 0.99 * total AND total > 0) WHERE rn = 1
)
SELECT endpoint, round(CASE WHEN bucket = 11 THEN max_finite
                            ELSE prev_le + (le - prev_le) * (0.99 * total - prev_cum) / (cum - prev_cum) END, 6)
                 AS p99_s
FROM first_b""",

    "request_rate": with_ctes(LOG_CTE) + """
SELECT endpoint, time_bucket(INTERVAL '1 minute', request_ts) AS window_start, count(*) AS n,
       round(count(*) / 60.0, 6) AS rps
FROM log GROUP BY ALL""",

    "tenant_requests": with_ctes(LOG_CTE) + """
, keys AS (SELECT * FROM (VALUES ('tenant1_key', 'tenant1'), ('tenant2_key', 'tenant2'),
                                 ('dev_key', 'development')) t(api_key, tenant))
SELECT l.endpoint, CASE WHEN l.api_key IS NULL OR k.tenant IS NULL THEN 401 ELSE l.status END AS auth_status,
       k.tenant, count(*) AS requests
FROM log l LEFT JOIN keys k ON l.api_key = k.api_key GROUP BY ALL""",

    "throughput": with_ctes(LOG_CTE) + """
SELECT endpoint, count(*) AS requests,
       round((epoch_us(max(request_ts)) - epoch_us(min(request_ts))) / 1000000.0, 6) AS elapsed_s,
       round(count(*) / nullif((epoch_us(max(request_ts)) - epoch_us(min(request_ts))) / 1000000.0, 0), 6) AS rps,
       round(count(*) * 3 / nullif((epoch_us(max(request_ts)) - epoch_us(min(request_ts))) / 1000000.0, 0), 6)
         AS features_per_s
FROM log GROUP BY endpoint""",

    "latency_by_batch_size": with_ctes(LOG_CTE) + """
, b AS (SELECT entity_id, time_bucket(INTERVAL '1 hour', request_ts) AS batch_start, count(*) AS batch_size,
               sum(latency_ms) AS latency_ms FROM log GROUP BY ALL)
SELECT batch_size, count(*) AS batches, round(avg(latency_ms), 6) AS mean_ms,
       round(avg(latency_ms / batch_size), 6) AS ms_per_entity
FROM b GROUP BY batch_size""",

    "batch_size_histogram": with_ctes(LOG_CTE) + """
, b AS (SELECT split_part(entity_id, '_', 1) AS entity_type, count(*) AS batch_size
        FROM log GROUP BY entity_id, time_bucket(INTERVAL '1 hour', request_ts)),
bk AS (SELECT CAST(le AS DOUBLE) AS le, bucket FROM (VALUES ('1', 0), ('10', 1), ('50', 2), ('100', 3),
        ('250', 4), ('500', 5), ('1000', 6), ('inf', 7)) t(le, bucket))
SELECT b.entity_type, bk.le, CAST(bk.bucket AS INTEGER) AS bucket,
       CAST(sum(CASE WHEN bk.bucket = 7 OR b.batch_size <= bk.le THEN 1 ELSE 0 END) AS BIGINT) AS cum
FROM b, bk GROUP BY ALL""",

})

ORACLES["retention_dropped"] = ORACLES["retention"]
ORACLES["stream_sessions"] = ORACLES["session_duration"]
