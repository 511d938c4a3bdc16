"""Queries of support analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analytics as A
from ..registry import query
from ..sources import tables as S

_IN = "closed_at >= TIMESTAMP '2024-01-02' AND closed_at < TIMESTAMP '2024-02-01'"
_ESCALATED = "(reason IS NOT DISTINCT FROM 'specialist_requested' OR (status IS NOT DISTINCT FROM 'escalate' AND reason IS DISTINCT FROM 'user_closed'))"
_HANDED = f"({_ESCALATED} AND coalesce(line IN ('L1', 'L2', 'L3'), false))"
_WITH = f"WITH {S.CLOSURES}, w AS (SELECT * FROM closures WHERE {_IN}) "
_OUTCOME = f"CASE WHEN {_HANDED} THEN '{A.HANDED}' || line WHEN reason IS NOT DISTINCT FROM 'user_closed' THEN '{A.BY_USER}' WHEN reason IS NOT DISTINCT FROM 'abuse' OR status IS NOT DISTINCT FROM 'closed_abuse' THEN '{A.FOR_ABUSE}' ELSE '{A.OTHER}' END"
_RATING = "CASE rating " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in A.RATINGS.items()) + " END"
_TOPIC = f"CASE WHEN coalesce(topic, '') = '' THEN '{A.UNKNOWN}' ELSE topic END"
_SUBTOPIC = f"CASE WHEN coalesce(topic, '') <> '' AND coalesce(subtopic, '') <> '' THEN topic || ' — ' || subtopic ELSE '{A.UNKNOWN}' END"


def _window(spark, sf_dir):
    return A.within(S.closures(spark, sf_dir), S.AS_OF, 30)


@query(
    "analytics_daily",
    f"{_WITH.rstrip()}, spine AS (SELECT CAST(unnest(generate_series(TIMESTAMP '2024-01-02', TIMESTAMP '2024-01-31', INTERVAL 1 DAY)) AS DATE) AS day), "
    f"c AS (SELECT CAST(closed_at AS DATE) AS day, count(*) AS total, count(*) FILTER (WHERE {_HANDED}) AS escalated FROM w GROUP BY 1) "
    "SELECT spine.day, coalesce(total, 0) AS total, coalesce(escalated, 0) AS escalated FROM spine LEFT JOIN c USING (day)",
)
def analytics_daily(spark, sf_dir):
    return A.daily(S.closures(spark, sf_dir), S.AS_OF, 30)


@query(
    "analytics_metrics",
    f"{_WITH} SELECT count(*) AS total_closed, count(*) FILTER (WHERE summary_current AND classification_current) AS analyzed, count(*) FILTER (WHERE summary_current) AS summarized, "
    "count(*) FILTER (WHERE summary_current AND remaining_questions) AS with_remaining_questions, count(*) FILTER (WHERE classification_current AND topic IS NOT NULL) AS classified, "
    f"count(rating) AS rated, count(*) FILTER (WHERE rating = 'complete') AS complete_ratings, count(*) FILTER (WHERE {_HANDED}) AS escalated, "
    "count(*) - count(*) FILTER (WHERE summary_current AND classification_current) AS pending FROM w",
)
def analytics_metrics(spark, sf_dir):
    return A.metrics(S.closures(spark, sf_dir), S.AS_OF, 30)


def _bucket_sql(label: str, where: str = "true", most: int | None = None) -> str:
    tail = f" ORDER BY n DESC, label LIMIT {most}" if most else ""
    return f"{_WITH} SELECT label, count(*) AS n FROM (SELECT {label} AS label FROM w WHERE {where}) WHERE label IS NOT NULL GROUP BY label{tail}"


@query("analytics_outcomes", _bucket_sql(_OUTCOME))
def analytics_outcomes(spark, sf_dir):
    return A.buckets(_window(spark, sf_dir), A.outcome())


@query("analytics_topics_top10", _bucket_sql(_TOPIC, "classification_current", 10))
def analytics_topics(spark, sf_dir):
    return A.buckets(_window(spark, sf_dir).where("classification_current"), A.topic_label(), 10)


@query("analytics_subtopics_top10", _bucket_sql(_SUBTOPIC, "classification_current", 10))
def analytics_subtopics(spark, sf_dir):
    return A.buckets(_window(spark, sf_dir).where("classification_current"), A.subtopic_label(), 10)


@query("analytics_ratings", _bucket_sql(_RATING))
def analytics_ratings(spark, sf_dir):
    return A.buckets(_window(spark, sf_dir), A.rating_label())


@query(
    "analytics_percentages",
    f"SELECT label, n, CAST(floor(100.0 * n / sum(n) OVER () + 0.5) AS BIGINT) AS percent FROM ({_bucket_sql(_OUTCOME)})",
)
def analytics_percentages(spark, sf_dir):
    return A.percentages(_window(spark, sf_dir), A.outcome())


@query("percent_labels", "SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS errors, CASE WHEN count(*) FILTER (WHERE event_type IN ('error', 'purchase')) = 0 THEN '—' ELSE CAST(floor(100.0 * count(*) FILTER (WHERE event_type = 'error') / count(*) FILTER (WHERE event_type IN ('error', 'purchase')) + 0.5) AS BIGINT) || '%' END AS share FROM events GROUP BY user_id")
def percent_labels(spark, sf_dir):
    """The share of failures among each user's ended dialogs, a dash where none ended."""
    ended = S.table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("errors"), F.count_if(F.col("event_type").isin("error", "purchase")).alias("ended"))
    return ended.select("user_id", "errors", A.percent_label(F.col("errors"), F.col("ended")).alias("share"))


@query(
    "analytics_topic_rollup",
    f"{_WITH} SELECT topic, subtopic, count(*) AS n FROM (SELECT {_TOPIC} AS topic, coalesce(subtopic, '') AS subtopic FROM w) GROUP BY ROLLUP (topic, subtopic)",
)
def analytics_topic_rollup(spark, sf_dir):
    rows = _window(spark, sf_dir).select(A.topic_label().alias("topic"), F.coalesce("subtopic", F.lit("")).alias("subtopic"))
    return rows.rollup("topic", "subtopic").agg(F.count("*").alias("n"))


_STAMPED = "s AS (SELECT event_id AS id, ts AS updated_at, CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN ts ELSE ts - INTERVAL 1 HOUR END AS stamp, event_id % 5 <> 0 AS present FROM events)"


@query("insight_freshness", f"WITH {_STAMPED} SELECT id, coalesce(present AND stamp IS NOT NULL AND stamp = updated_at, false) AS is_current FROM s")
def insight_freshness(spark, sf_dir):
    e, n, at = S.table(spark, sf_dir, "events"), F.col("event_id"), F.col("ts").cast("timestamp")
    stamp = F.when(n % 3 == 1, at).when(n % 3 == 2, at - F.expr("INTERVAL 1 HOUR"))
    return e.select(n.alias("id"), A.insight_current(stamp, at, n % 5 != 0).alias("is_current"))


@query(
    "insight_queue",
    f"WITH {S.CLOSURES}, q AS (SELECT *, CASE WHEN id % 11 = 0 THEN NULL ELSE closed_at + INTERVAL 5 MINUTE END AS retry_at FROM closures) "
    "SELECT id, strftime(closed_at, '%Y-%m-%d %H:%M:%S') AS closed_at FROM q WHERE NOT (summary_current AND classification_current) AND (retry_at IS NULL OR retry_at <= TIMESTAMP '2024-01-20') "
    "ORDER BY retry_at NULLS FIRST, q.closed_at, id LIMIT 10",
)
def insight_queue(spark, sf_dir):
    retry = F.when(F.col("id") % 11 == 0, None).otherwise(F.col("closed_at") + F.expr("INTERVAL 5 MINUTES"))
    queue = A.insight_queue(S.closures(spark, sf_dir).withColumn("retry_at", retry), F.lit("2024-01-20").cast("timestamp"), 10)
    return queue.select("id", F.date_format("closed_at", "yyyy-MM-dd HH:mm:ss").alias("closed_at"))
