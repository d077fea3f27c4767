"""Queries on event-time windows, over the whole table as one batch."""

from __future__ import annotations

from marlstone.plans.registry import query, table
from marlstone.streaming import events


@query("events_tumbling", "SELECT time_bucket(INTERVAL 1 hour, ts) AS window_start, time_bucket(INTERVAL 1 hour, ts) + INTERVAL 1 hour AS window_end, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def events_tumbling(spark, sf_dir):
    return events.tumbling(table(spark, sf_dir, "events"))


@query("events_sliding", """WITH s AS (SELECT time_bucket(INTERVAL 3 hours, ts, TIMESTAMP '1970-01-01') - k * INTERVAL 3 hours AS window_start, event_type, value FROM events, range(2) r(k))
SELECT window_start, window_start + INTERVAL 6 hours AS window_end, event_type, count(*) AS n, round(sum(value), 2) AS total FROM s GROUP BY ALL""")
def events_sliding(spark, sf_dir):
    return events.sliding(table(spark, sf_dir, "events"))


@query("events_session", """WITH g AS (SELECT user_id, ts, value, (ts - lag(ts) OVER w >= INTERVAL 30 minutes)::INT AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(coalesce(new, 1)) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT min(ts) AS window_start, max(ts) + INTERVAL 30 minutes AS window_end, user_id, count(*) AS n, round(sum(value), 2) AS total FROM s GROUP BY user_id, k""")
def events_session(spark, sf_dir):
    return events.sessions(table(spark, sf_dir, "events"))
