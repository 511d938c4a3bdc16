"""Support analytics over closed dialogs: daily closures, outcomes, topics, ratings, freshness and the insight queue."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Labels of the report.
UNKNOWN = "Не определена"
BY_USER, FOR_ABUSE, OTHER, HANDED = "Закрыто пользователем", "Закрыто из-за нарушения", "Другое", "Передано в "
RATINGS = {"complete": "Полностью помог", "partial": "Частично помог", "irrelevant": "Не помог"}
LINES = ("L1", "L2", "L3")


def window_of(as_of: dt.date, days: int) -> tuple[dt.date, dt.date]:
    """The half-open range of ``days`` UTC days that ends with ``as_of``."""
    if not 1 <= days <= 365:
        raise ValueError("days must be from 1 to 365")
    end = as_of + dt.timedelta(days=1)
    return end - dt.timedelta(days=days), end


def within(closed: DataFrame, as_of: dt.date, days: int) -> DataFrame:
    """Dialogs closed in the window; a plain range on the stored column, so that Parquet skips row groups."""
    start, end = window_of(as_of, days)
    return closed.where((F.col("closed_at") >= F.lit(str(start)).cast("timestamp")) & (F.col("closed_at") < F.lit(str(end)).cast("timestamp")))


def is_escalated() -> Column:
    """Null-safe: a missing reason is no closure by the user."""
    reason = F.col("reason")
    return reason.eqNullSafe("specialist_requested") | (F.col("status").eqNullSafe("escalate") & ~reason.eqNullSafe("user_closed"))


def handed_over() -> Column:
    return is_escalated() & F.coalesce(F.col("line").isin(*LINES), F.lit(False))


def outcome() -> Column:
    """In this order; an escalation without a known line falls through."""
    return (
        F.when(handed_over(), F.concat(F.lit(HANDED), F.col("line")))
        .when(F.col("reason").eqNullSafe("user_closed"), BY_USER)
        .when(F.col("reason").eqNullSafe("abuse") | F.col("status").eqNullSafe("closed_abuse"), FOR_ABUSE)
        .otherwise(OTHER)
    )


def rating_label() -> Column:
    label = F.lit(None).cast("string")
    for key, value in RATINGS.items():
        label = F.when(F.col("rating") == key, value).otherwise(label)
    return label


def topic_label() -> Column:
    return F.when(F.coalesce(F.col("topic"), F.lit("")) == "", UNKNOWN).otherwise(F.col("topic"))


def subtopic_label() -> Column:
    known = (F.coalesce(F.col("topic"), F.lit("")) != "") & (F.coalesce(F.col("subtopic"), F.lit("")) != "")
    return F.when(known, F.concat_ws(" — ", "topic", "subtopic")).otherwise(UNKNOWN)


def daily(closed: DataFrame, as_of: dt.date, days: int = 30) -> DataFrame:
    """``day, total, escalated``: every day of the window, days without closures as zeros."""
    start, end = window_of(as_of, days)
    spine = closed.sparkSession.range(days).select(F.date_add(F.lit(start), F.col("id").cast("int")).alias("day"))
    counted = within(closed, as_of, days).groupBy(F.to_date("closed_at").alias("day")).agg(F.count("*").alias("total"), F.count_if(handed_over()).alias("escalated"))
    return spine.join(counted, "day", "left").select("day", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("escalated", F.lit(0)).alias("escalated"))


def metrics(closed: DataFrame, as_of: dt.date, days: int = 30) -> DataFrame:
    """One row of counters, in one pass."""
    both = F.col("summary_current") & F.col("classification_current")
    known = F.col("rating").isin(*RATINGS)
    row = within(closed, as_of, days).agg(
        F.count("*").alias("total_closed"),
        F.count_if(both).alias("analyzed"),
        F.count_if("summary_current").alias("summarized"),
        F.count_if(F.col("summary_current") & F.coalesce("remaining_questions", F.lit(False))).alias("with_remaining_questions"),
        F.count_if(F.col("classification_current") & F.col("topic").isNotNull()).alias("classified"),
        F.count_if(known).alias("rated"),
        F.count_if(F.col("rating") == "complete").alias("complete_ratings"),
        F.count_if(handed_over()).alias("escalated"),
    )
    return row.withColumn("pending", F.col("total_closed") - F.col("analyzed"))


def buckets(rows: DataFrame, label: Column, most: int | None = None) -> DataFrame:
    """``label, n`` by falling count, then label; null labels are left out."""
    counted = rows.select(label.alias("label")).where("label is not null").groupBy("label").agg(F.count("*").alias("n"))
    return counted if most is None else counted.orderBy(F.desc("n"), "label").limit(most)


def percent_label(part: Column, whole: Column) -> Column:
    """A share rounded half up with its sign, or a dash where there is nothing to share."""
    share = F.floor(100 * part / F.nullif(whole, F.lit(0)) + F.lit(0.5)).cast("bigint").cast("string")
    return F.coalesce(F.concat(share, F.lit("%")), F.lit("—"))


def percentages(rows: DataFrame, label: Column) -> DataFrame:
    """``label, n, percent``, the share of all rounded half up; null without rows."""
    counted = buckets(rows, label)
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))  # over a handful of labels
    return counted.withColumn("percent", F.floor(100 * F.col("n") / total + F.lit(0.5)).cast("bigint"))


def insight_current(stamp: Column, updated: Column, present: Column) -> Column:
    """A derived value is current if it is there and bears the dialog's own stamp."""
    return F.coalesce(present & stamp.isNotNull() & (stamp == updated), F.lit(False))


def insight_queue(closed: DataFrame, due: Column, most: int = 10) -> DataFrame:
    """Closed dialogs whose insights are missing or stale and whose retry is due: no retry first, then by stamp and id."""
    pending = ~(F.col("summary_current") & F.col("classification_current"))
    ready = F.col("retry_at").isNull() | (F.col("retry_at") <= due)
    return closed.where(pending & ready).orderBy(F.asc_nulls_first("retry_at"), "closed_at", "id").limit(most)
