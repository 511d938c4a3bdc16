"""Queries that run as Structured Streaming jobs over ``events``, with their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..registry import query
from ..sources import tables as S
from ..streaming import dialogs as D
from ..streaming import insights as I


def _stream(spark, sf_dir):
    return D.file_stream(spark, f"{sf_dir}/events.parquet")


@query("stream_tumbling", "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def stream_tumbling(spark, sf_dir):
    return D.result_of(D.tumbling(_stream(spark, sf_dir)))


@query("stream_sliding", "SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM (SELECT unnest([h, h - INTERVAL 12 HOUR]) AS start FROM (SELECT CASE WHEN hour(ts) < 12 THEN date_trunc('day', ts) ELSE date_trunc('day', ts) + INTERVAL 12 HOUR END AS h FROM events)) GROUP BY 1")
def stream_sliding(spark, sf_dir):
    return D.result_of(D.sliding(_stream(spark, sf_dir)))


@query("stream_session", "WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k")
def stream_session(spark, sf_dir):
    return D.result_of(D.sessions(_stream(spark, sf_dir)))


def _kinds(events):
    kind = F.col("event_type")
    named = F.when(kind == "view", "message").when(kind == "click", F.when(F.col("event_id") % 2 == 0, "feedback").otherwise("clarify"))
    named = named.when(kind == "purchase", "specialist").when(kind == "signup", "close").otherwise("abuse")
    # a dialog is a user's hour, so that a table holds many short ones
    dialog = F.col("user_id") * 1000 + F.dayofyear("ts") * 24 + F.hour("ts")
    return events.select(dialog.cast("bigint").alias("id"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"), named.alias("kind"))


_LIFE = """WITH k AS (SELECT CAST(user_id * 1000 + dayofyear(ts) * 24 + hour(ts) AS BIGINT) AS id, ts, event_id AS seq,
  CASE event_type WHEN 'view' THEN 'message' WHEN 'click' THEN CASE WHEN event_id % 2 = 0 THEN 'feedback' ELSE 'clarify' END WHEN 'purchase' THEN 'specialist' WHEN 'signup' THEN 'close' ELSE 'abuse' END AS kind FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts, seq) AS r FROM k),
c AS (SELECT id, min(r) AS cut FROM n WHERE kind IN ('specialist', 'close', 'abuse') GROUP BY id),
t AS (SELECT n.*, cut, (cut IS NULL OR r <= cut OR kind = 'feedback') AS taken,
  CASE kind WHEN 'specialist' THEN 'escalate' WHEN 'close' THEN 'closed' WHEN 'abuse' THEN 'closed_abuse' WHEN 'message' THEN 'answered' WHEN 'clarify' THEN 'clarifying' END AS named,
  CASE kind WHEN 'specialist' THEN 'specialist_requested' WHEN 'close' THEN 'user_closed' WHEN 'abuse' THEN 'abuse' END AS why FROM n LEFT JOIN c USING (id))
SELECT id, coalesce(arg_max(named, r) FILTER (WHERE taken AND named IS NOT NULL), 'open') AS status, arg_max(why, r) FILTER (WHERE taken AND why IS NOT NULL) AS reason,
  bool_or(cut IS NOT NULL) AS closed, count(*) FILTER (WHERE taken) AS accepted, count(*) FILTER (WHERE NOT taken) AS rejected, count(*) FILTER (WHERE taken) AS revision FROM t GROUP BY id"""


@query("stream_state_machine", _LIFE)
def stream_state_machine(spark, sf_dir):
    return D.current(D.result_of(D.lifecycle_stream(_kinds(_stream(spark, sf_dir))), "update"))


@query("lifecycle_fold", _LIFE)
def lifecycle_fold(spark, sf_dir):
    return D.lifecycle_batch(_kinds(S.table(spark, sf_dir, "events")))


@query("last_snapshot", "SELECT user_id AS id, arg_max(props, event_id) AS text FROM events GROUP BY user_id")
def last_snapshot(spark, sf_dir):
    return D.last_snapshots(S.table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), F.col("props").alias("text")))


@query("tool_status", "SELECT user_id AS id, event_type AS call_id, arg_max(props, event_id) AS status, min(event_id) AS first_seq FROM events GROUP BY ALL")
def tool_status(spark, sf_dir):
    e = S.table(spark, sf_dir, "events")
    return D.tool_states(e.select(F.col("user_id").alias("id"), F.col("event_type").alias("call_id"), F.col("event_id").alias("seq"), F.col("props").alias("status")))


def _flaky(kind: str, dialog: int, revision: int, attempt: int) -> str:
    """A model that answers for a version at its 1st to 4th try."""
    if attempt <= (revision + len(kind)) % 4:
        raise TimeoutError(kind)
    return f"{kind} of {dialog}"


@query("insight_retries", """WITH c AS (SELECT user_id AS id, event_id AS revision, epoch_us(ts) // 1000 AS ms FROM events WHERE event_type IN ('purchase', 'signup', 'error')),
b AS (SELECT *, max(revision) OVER (PARTITION BY id ORDER BY ms, revision ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM c),
n AS (SELECT *, lead(ms) OVER (PARTITION BY id ORDER BY ms, revision) AS next FROM b WHERE best IS NULL OR revision > best),
e AS (SELECT n.*, coalesce(next, (SELECT max(ms) FROM c) - 3600000) AS stop, kind, 1 + (revision + length(kind)) % 4 AS needed FROM n, (VALUES ('summary'), ('classification')) AS k(kind)),
a AS (SELECT *, unnest(range(1, needed + 1)) AS attempt FROM e)
SELECT id, revision, kind, CAST(attempt AS INT) AS attempt, strftime(make_timestamp((ms + (attempt - 1) * 300000) * 1000), '%Y-%m-%d %H:%M:%S') AS at, attempt = needed AS ok,
  CASE WHEN attempt = needed THEN kind || ' of ' || id END AS value FROM a WHERE attempt = 1 OR ms + (attempt - 1) * 300000 < stop""")
def insight_retries(spark, sf_dir):
    """Every attempt at the insights of users' dialogs, each ending event a new version, with a model that fails up to three times."""
    closed = _stream(spark, sf_dir).where(F.col("event_type").isin("purchase", "signup", "error")).select(F.col("user_id").alias("id"), F.col("event_id").alias("revision"), F.col("ts").cast("timestamp").alias("at"))
    return D.result_of(I.insight_stream(closed, _flaky), "append").withColumn("at", F.date_format("at", "yyyy-MM-dd HH:mm:ss"))


@query("pending_guards", """WITH g AS (SELECT user_id AS id, event_id AS seq, ts,
  CASE event_type WHEN 'click' THEN 'reply' WHEN 'error' THEN 'close' ELSE 'message' END AS kind,
  CASE WHEN json_extract_string(props, '$.k') LIKE '%0' OR event_type = 'click' AND event_id % 2 = 0 THEN 'c' || (event_id % 2) END AS asked,
  CASE WHEN json_extract_string(props, '$.k') LIKE '%0' OR event_type = 'purchase' OR event_type = 'click' AND event_id % 2 = 1 THEN 's' || (event_id % 2) END AS taken FROM events),
o AS (SELECT *, last_value(CASE WHEN kind = 'reply' THEN {'c': asked, 's': taken} END IGNORE NULLS) OVER w AS offered, coalesce(bool_or(kind = 'close') OVER w, false) AS closed
  FROM g WINDOW w AS (PARTITION BY id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT id, seq, CASE WHEN closed THEN 'closed' WHEN asked IS NOT NULL AND taken IS NOT NULL THEN 'both ids'
  WHEN asked IS NOT NULL AND asked IS DISTINCT FROM offered.c THEN 'clarification gone' WHEN taken IS NOT NULL AND taken IS DISTINCT FROM offered.s THEN 'suggestion gone' ELSE 'accepted' END AS verdict
FROM o WHERE kind = 'message'""")
def pending_guards(spark, sf_dir):
    """Verdicts on users' messages against what their dialogs have pending."""
    kind, n, tens = F.col("event_type"), F.col("event_id"), F.coalesce(F.get_json_object("props", "$.k").endswith("0"), F.lit(False))
    asked = F.when(tens | ((kind == "click") & (n % 2 == 0)), F.concat(F.lit("c"), (n % 2).cast("string")))
    taken = F.when(tens | (kind == "purchase") | ((kind == "click") & (n % 2 == 1)), F.concat(F.lit("s"), (n % 2).cast("string")))
    named = F.when(kind == "click", "reply").when(kind == "error", "close").otherwise("message")
    rows = _stream(spark, sf_dir).select(F.col("user_id").alias("id"), F.col("ts").cast("timestamp").alias("at"), n.alias("seq"), named.alias("kind"), asked.alias("clarification_id"), taken.alias("suggestion_id"))
    return D.result_of(I.guard_stream(rows), "append")
