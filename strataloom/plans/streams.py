"""Queries that run a stream over the tables as they are."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.delivery import normal_id
from ..streaming import streams


def stream_hourly(spark, d):
    """Closed hours of events by type."""
    return streams.drain(streams.windowed(streams.read_table(spark, f"{d}/events.parquet").select("ts", "event_type", "value"), "ts", ["event_type"], "value")).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


def stream_sessions(spark, d):
    """Closed sessions of users."""
    return streams.drain(streams.sessions(streams.read_table(spark, f"{d}/events.parquet").select("ts", "user_id"), "ts", ["user_id"])).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")})


def stream_first_deliveries(spark, d):
    """Distinct messages of the queue's stream."""
    m = streams.read_table(spark, f"{d}/job_messages.parquet").select("received_at", *[normal_id(c).alias(c) for c in ("job_id", "owner", "repo")])
    m = m.where("job_id is not null and owner is not null and repo is not null")
    return streams.drain(streams.first_deliveries(m, ["job_id", "owner", "repo"], "received_at", "3650 days").select("job_id", "owner", "repo"))


def stream_admitted(spark, d):
    """Users' events under a limit of 3 and of a value of 150 within an hour, counted by user."""
    e = streams.read_table(spark, f"{d}/events.parquet").select("user_id", "ts", "value")
    out = streams.drain(streams.admitted(e, "user_id", "ts", "value", 3600, 3, 150.0))
    return out.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if("admitted").alias("n_admitted"))


ORACLES = {
    "stream_hourly": """SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, event_type, n, total FROM (SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2)
WHERE window_start + INTERVAL 1 HOUR <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE FROM events)""",
    "stream_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g), r AS (SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM s GROUP BY user_id, k)
SELECT session_start, session_end, user_id, n FROM r WHERE session_end <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE FROM events)""",
    "stream_first_deliveries": """SELECT DISTINCT lower(regexp_replace(job_id, '^\\s+|\\s+$', '', 'g')) AS job_id, lower(regexp_replace(owner, '^\\s+|\\s+$', '', 'g')) AS owner, lower(regexp_replace(repo, '^\\s+|\\s+$', '', 'g')) AS repo FROM job_messages
WHERE trim(job_id) <> '' AND trim(owner) <> '' AND trim(repo) <> ''""",
}
QUERIES = {f.__name__: f for f in (stream_hourly, stream_sessions, stream_first_deliveries, stream_admitted)}
