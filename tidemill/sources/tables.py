"""Input tables, and the views of support dialogs and knowledge that queries are written against.

Each view is given twice, as a DataFrame and as the DuckDB text of a common table expression.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

#: The day that queries over ``events`` take as today: the day after the last event.
AS_OF = dt.date(2024, 1, 31)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conv_id, turn, role, text`` of users and assistants."""
    return table(spark, sf_dir, "conversations").where(F.col("role").isin("user", "assistant"))


MESSAGES = "messages AS (SELECT conv_id, turn, role, text FROM conversations WHERE role IN ('user', 'assistant'))"


def closures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed dialogs: what analytics project of a dialog, without its transcript."""
    e, n, k = table(spark, sf_dir, "events"), F.col("event_id"), F.get_json_object("props", "$.k").cast("bigint")
    kind = F.col("event_type")
    return e.select(
        n.alias("id"),
        F.col("ts").cast("timestamp").alias("closed_at"),
        F.when(kind == "purchase", "specialist_requested").when(kind == "signup", "user_closed").when(kind == "error", "abuse").alias("reason"),
        F.when(kind.isin("view", "purchase"), "escalate").when(kind == "error", "closed_abuse").otherwise("answered").alias("status"),
        F.when(n % 4 == 0, "L1").when(n % 4 == 1, "L2").when(n % 4 == 2, "L3").alias("line"),
        F.when(n % 5 == 0, "complete").when(n % 5 == 1, "partial").when(n % 5 == 2, "irrelevant").alias("rating"),
        F.when(k % 7 == 0, None).when(k % 7 == 1, "").otherwise(F.concat(F.lit("topic-"), (k % 10).cast("string"))).alias("topic"),
        F.when(k % 5 == 0, None).otherwise(F.concat(F.lit("sub-"), (k % 20).cast("string"))).alias("subtopic"),
        (n % 3 != 0).alias("summary_current"),
        (n % 4 != 0).alias("classification_current"),
        (n % 2 == 0).alias("remaining_questions"),
        F.col("user_id"),
    )


CLOSURES = """closures AS (
  SELECT event_id AS id, ts AS closed_at, user_id,
    CASE event_type WHEN 'purchase' THEN 'specialist_requested' WHEN 'signup' THEN 'user_closed' WHEN 'error' THEN 'abuse' END AS reason,
    CASE WHEN event_type IN ('view', 'purchase') THEN 'escalate' WHEN event_type = 'error' THEN 'closed_abuse' ELSE 'answered' END AS status,
    CASE event_id % 4 WHEN 0 THEN 'L1' WHEN 1 THEN 'L2' WHEN 2 THEN 'L3' END AS line,
    CASE event_id % 5 WHEN 0 THEN 'complete' WHEN 1 THEN 'partial' WHEN 2 THEN 'irrelevant' END AS rating,
    CASE WHEN k % 7 = 0 THEN NULL WHEN k % 7 = 1 THEN '' ELSE 'topic-' || (k % 10) END AS topic,
    CASE WHEN k % 5 = 0 THEN NULL ELSE 'sub-' || (k % 20) END AS subtopic,
    event_id % 3 <> 0 AS summary_current, event_id % 4 <> 0 AS classification_current, event_id % 2 = 0 AS remaining_questions
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``document, section, ord, text``: the non-empty lines of documents, numbered from 0 in each."""
    parts = F.filter(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: x != "")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document"), F.col("source").alias("section"), F.posexplode(parts).alias("ord", "text"))


CHUNKS = """chunks AS (
  SELECT document, section, CAST(i - 1 AS INT) AS ord, parts[i] AS text
  FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i
        FROM (SELECT doc_id AS document, source AS section, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: x <> '') AS parts FROM documents)))"""


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, title, parent``: topics, titled by the first six tokens of an item."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.array_join(F.slice(T.tokens("text"), 1, 6), " ").alias("title"), (F.col("item_id") % 5).alias("parent"))


CATALOG = f"catalog AS (SELECT item_id AS id, array_to_string(list_slice({T.tokens_sql('text')}, 1, 6), ' ') AS title, item_id % 5 AS parent FROM benchmark)"


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``qid, query``: distinct user messages as their tokens, numbered by their hash."""
    q = messages(spark, sf_dir).where("role = 'user'").select(F.array_join(T.tokens("text"), " ").alias("query")).where("query <> ''").distinct()
    return q.select(T.text_id("query").alias("qid"), "query")


CORPUS = f"""corpus AS (SELECT {T.text_id_sql('query')} AS qid, query FROM (
  SELECT DISTINCT array_to_string({T.tokens_sql('text')}, ' ') AS query FROM messages WHERE role = 'user') WHERE query <> '')"""


def utc(c: str) -> Column:
    """A zoned or plain timestamp as UTC; plain ones are taken as UTC."""
    return F.col(c).cast("timestamp")
