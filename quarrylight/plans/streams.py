"""Streams over the events table, and the same flows over it as a finished table."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylight.plans.registry import Plans
from quarrylight.streaming import flows

P = Plans()
NOW = "timestamp_ntz '2024-01-31 00:00:00'"
OUTBOX_SQL = "o AS (SELECT event_id AS id, ts AS created, CASE event_type WHEN 'click' THEN 'pending' WHEN 'view' THEN 'done' WHEN 'error' THEN 'failed' ELSE 'processing' END AS status, CAST(json_extract_string(props, '$.k') AS INT) % 5 AS retries, ts AS touched FROM events)"


def _outbox(t):
    status = F.when(F.col("event_type") == "click", "pending").when(F.col("event_type") == "view", "done").when(F.col("event_type") == "error", "failed").otherwise("processing")
    return t.events.select(F.col("event_id").alias("id"), F.col("ts").alias("created"), status.alias("status"), (F.get_json_object("props", "$.k").cast("int") % 5).alias("retries"), F.col("ts").alias("touched"))


@P.add("st_debounce_batch", """
    WITH g AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS first FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM g),
    f AS (SELECT *, date_diff('microsecond', min(ts) OVER (PARTITION BY user_id, n), ts) // 10800000000 AS flush FROM s) SELECT user_id, min(ts) AS start, max(ts) AS stop, count(*) AS n FROM f GROUP BY user_id, n, flush""")
def _(t):
    return flows.debounced(t.events, "user_id", "2 hours", "3 hours")


@P.add("st_debounce_idle", """
    WITH g AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS first FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, n""")
def _(t):
    return flows.debounced(t.events, "user_id", "2 hours").select("user_id", "start", "n")


IN_ORDER_SQL = "e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE user_id IS NOT NULL)"
RATE_SQL = f"""WITH RECURSIVE {IN_ORDER_SQL}, r AS (SELECT user_id, event_id, n, true AS kept, CASE WHEN event_type <> 'error' THEN ts END AS last FROM e WHERE n = 1
    UNION ALL SELECT e.user_id, e.event_id, e.n, r.last IS NULL OR e.ts - r.last >= INTERVAL 1 HOUR, CASE WHEN (r.last IS NULL OR e.ts - r.last >= INTERVAL 1 HOUR) AND e.event_type <> 'error' THEN e.ts ELSE r.last END FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
    SELECT user_id, event_id, kept FROM r"""


@P.add("st_rate_limit", RATE_SQL)
def _(t):
    return flows.rate_limited(t.events)


@P.add("st_rate_limit_stream", RATE_SQL)
def _(t):
    """The same as a stream with keyed state."""
    return flows.run_to_table(flows.rate_limited(flows.change_stream(t.spark, t.base)))


SIGNATURE_SQL = "SELECT event_id FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS NULL OR b <> event_type"


@P.add("st_signature_dedup", SIGNATURE_SQL)
def _(t):
    return flows.signature_changes(t.events).select("event_id")


INFLIGHT_SQL = """
    SELECT event_id, CASE WHEN coalesce(r, 0) = 1 AND event_type IN ('click', 'view') THEN 'dropped' ELSE 'taken' END AS state FROM (
        SELECT event_id, event_type, last_value(CASE WHEN event_type = 'click' THEN 1 WHEN event_type IN ('purchase', 'error') THEN 0 END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM events)"""


@P.add("st_inflight", INFLIGHT_SQL)
def _(t):
    return flows.in_flight(t.events)


@P.add("st_backpressure_drop", "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY date_trunc('hour', ts) ORDER BY ts, event_id) AS n FROM events) WHERE n <= 10")
def _(t):
    from pyspark.sql import Window

    return t.events.withColumn("n", F.row_number().over(Window.partitionBy(F.date_trunc("hour", "ts")).orderBy("ts", "event_id"))).where("n <= 10").select("event_id")


@P.add("st_filter_ext_dir", "SELECT id FROM files WHERE regexp_matches(path, '\\.(rs|py|go|ts|js|java)$') AND NOT regexp_matches(path, '(^|/)(target|node_modules|dist|vendor)/')")
def _(t):
    return t.files.where(F.col("path").rlike(r"\.(rs|py|go|ts|js|java)$") & ~F.col("path").rlike("(^|/)(target|node_modules|dist|vendor)/")).select("id")


@P.add("st_outbox_claim", f"WITH {OUTBOX_SQL} SELECT id FROM o WHERE status = 'pending' ORDER BY created, id LIMIT 100")
def _(t):
    return flows.claimed(_outbox(t), 100).select("id")


@P.add("st_outbox_reaper", f"WITH {OUTBOX_SQL} SELECT id, CASE WHEN status = 'processing' AND touched < TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 5 MINUTE THEN 'pending' ELSE status END AS status FROM o")
def _(t):
    return flows.reaped(_outbox(t), F.expr(NOW)).select("id", "status")


@P.add("st_outbox_retry_purge", f"WITH {OUTBOX_SQL} SELECT id FROM o WHERE NOT ((status = 'done' AND touched < TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 24 HOUR) OR (status = 'failed' AND retries >= 3 AND touched < TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 7 DAY))")
def _(t):
    return flows.purged(_outbox(t), F.expr(NOW)).select("id")


@P.add("st_outbox_metrics", f"WITH {OUTBOX_SQL} SELECT count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'failed') AS failed FROM o")
def _(t):
    return _outbox(t).agg(F.count_if(F.col("status") == "pending").alias("pending"), F.count_if(F.col("status") == "failed").alias("failed"))


CIRCUIT_SQL = f"""WITH RECURSIVE {IN_ORDER_SQL}, r AS (SELECT user_id, event_id, n, ts, CASE WHEN event_type = 'purchase' THEN 0 ELSE 1 END AS fails, CAST(NULL AS TIMESTAMP) AS opened FROM e WHERE n = 1
    UNION ALL SELECT e.user_id, e.event_id, e.n, e.ts, CASE WHEN e.event_type = 'purchase' THEN 0 ELSE r.fails + 1 END, CASE WHEN e.event_type = 'purchase' THEN NULL WHEN r.fails = 4 THEN e.ts ELSE r.opened END FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
    SELECT user_id AS key, event_id, CASE WHEN opened IS NULL THEN 'closed' WHEN ts - opened < INTERVAL 1 HOUR THEN 'open' ELSE 'half_open' END AS state FROM r"""


@P.add("st_circuit_breaker", CIRCUIT_SQL)
def _(t):
    outcomes = t.events.select(F.col("user_id").alias("key"), "event_id", "ts", (F.col("event_type") == "purchase").alias("ok"))
    return flows.circuit(outcomes, threshold=5, wait_seconds=3600)


@P.add("st_append_stream", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def _(t):
    """Files are taken once each, as they are appended; the finished stream is counted."""
    return flows.run_to_table(flows.change_stream(t.spark, t.base).select("event_id", "event_type")).groupBy("event_type").agg(F.count("*").alias("n"))


@P.add("st_large_jsonl_stream", "SELECT event_id // 1000 AS block, count(*) AS n, CAST(sum(strlen(props)) AS BIGINT) AS bytes FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy(F.floor(F.col("event_id") / 1000).alias("block")).agg(F.count("*").alias("n"), F.sum(F.octet_length("props")).alias("bytes"))


@P.add("stream_tumbling", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def _(t):
    return flows.windowed_counts(t.events)


@P.add("st_signature_dedup_stream", SIGNATURE_SQL)
def _(t):
    return flows.run_to_table(flows.signature_changes(flows.change_stream(t.spark, t.base))).select("event_id")


@P.add("st_inflight_stream", INFLIGHT_SQL)
def _(t):
    return flows.run_to_table(flows.in_flight(flows.change_stream(t.spark, t.base)))


@P.add("st_circuit_breaker_stream", CIRCUIT_SQL)
def _(t):
    outcomes = flows.change_stream(t.spark, t.base).select(F.col("user_id").alias("key"), "event_id", "ts", (F.col("event_type") == "purchase").alias("ok"))
    return flows.run_to_table(flows.circuit(outcomes, threshold=5, wait_seconds=3600))


@P.add("st_debounce_stream", "SELECT user_id, start, n FROM (WITH g AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS first FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM g) SELECT user_id, min(ts) AS start, max(ts) AS last, count(*) AS n FROM s GROUP BY user_id, n) WHERE last + INTERVAL 2 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR")
def _(t):
    """Batches that are closed once no event an hour late could still join them; late events are counted as they come."""
    stream = flows.change_stream(t.spark, t.base).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 hour")
    return flows.run_to_table(flows.debounced(stream, "user_id", "2 hours")).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")
