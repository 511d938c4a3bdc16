"""Dialog lists, transcripts and pairings over ``conv_id, turn, role, text`` rows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import moderation as M


def _opening():
    return Window.partitionBy("conv_id").orderBy("turn")


def rollup(messages: DataFrame) -> DataFrame:
    """One row a dialog: size, first user text and last assistant text; grouped minima, so nothing is collected."""
    first = F.min_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn")))
    last = F.max_by(F.when(F.col("role") == "assistant", F.col("text")), F.when(F.col("role") == "assistant", F.col("turn")))
    return messages.groupBy("conv_id").agg(F.count("*").alias("n_messages"), F.sum(F.length("text")).cast("bigint").alias("n_chars"), first.alias("first_user"), last.alias("last_assistant"))


def documents(messages: DataFrame) -> DataFrame:
    """Each dialog with its messages as an ordered array: one dialog is one row, as a view of it needs."""
    return messages.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("messages"))


def newest(rows: DataFrame, stamp: str, tie: str, most: int = 100) -> DataFrame:
    """The ``most`` (1 to 500) newest rows."""
    if not 1 <= most <= 500:
        raise ValueError("the limit must be from 1 to 500")
    return rows.orderBy(F.desc(stamp), F.desc(tie)).limit(most)


def title_contains(title: Column, sought: str) -> Column:
    return F.contains(F.lower(title), F.lower(F.lit(sought)))


def recency(stamp: Column, today: dt.date, zone: str = "UTC") -> Column:
    """today, yesterday or earlier, by the calendar of a zone."""
    days = F.datediff(F.lit(today), F.to_date(F.from_utc_timestamp(stamp, zone)))
    return F.when(days <= 0, "today").when(days == 1, "yesterday").otherwise("earlier")


def question_answer_pairs(messages: DataFrame) -> DataFrame:
    """Each user message with the next assistant message of its dialog; null if none follows."""
    after = _opening().rowsBetween(1, Window.unboundedFollowing)
    answer = F.first(F.when(F.col("role") == "assistant", F.col("turn")), ignorenulls=True).over(after)
    return messages.withColumn("answer_turn", answer).where("role = 'user'").select("conv_id", "turn", "answer_turn")


def last_answers(messages: DataFrame) -> DataFrame:
    """The last non-empty answer of a dialog that has an earlier request, and the nearest such request."""
    asked = F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(_opening().rowsBetween(Window.unboundedPreceding, -1))
    answers = messages.withColumn("request_turn", asked).where("role = 'assistant' and trim(text) <> '' and request_turn is not null")
    return answers.groupBy("conv_id").agg(F.max("turn").alias("answer_turn"), F.max_by("request_turn", "turn").alias("request_turn"))


def pending_cards(messages: DataFrame, is_card: Column, is_settled: Column) -> DataFrame:
    """The newest card of a dialog, if no settled message follows it."""
    seen = messages.select("conv_id", "turn", is_card.alias("card"), is_settled.alias("settled"))
    newest_of = seen.groupBy("conv_id").agg(F.max(F.when(F.col("card"), F.col("turn"))).alias("card_turn"), F.max(F.when(F.col("settled"), F.col("turn"))).alias("settled_turn"))
    return newest_of.where("card_turn is not null and (settled_turn is null or settled_turn < card_turn)").select("conv_id", "card_turn")


def last_turns(messages: DataFrame, most: int = 4, longest: int = 800) -> DataFrame:
    """The last ``most`` turns of a dialog, of which those over ``longest`` characters are then left out."""
    back = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return messages.withColumn("back", back).where((F.col("back") <= most) & (F.length("text") <= longest)).select("conv_id", "turn", "back")


def previous_role(messages: DataFrame) -> DataFrame:
    return messages.select("conv_id", "turn", "role", F.lag("role").over(_opening()).alias("previous"))


# How a request starts that only makes sense after the one before it.
FOLLOW_UP = [
    r"^(?:а\s+)?(?:(?:как|где|когда|почему|зачем)\s+)?(?:это|этого|этому|этой|этот|эту|этом|его|её|ее|их|такой|такую|там|дальше|подробнее)",
    r"^(?:не получилось|не помогло|что делать дальше|а по|а если|я поставщик|я заказчик)",
]


def follow_up_queries(messages: DataFrame) -> DataFrame:
    """What is searched for at each user turn that asks something: ``conv_id, turn, query``.

    Greetings, questions about what the assistant can do and open calls for help ask nothing and count neither as a turn nor as the
    turn before.  An explicit follow-up is put on a new line after the question before it.
    """
    text = F.col("text")
    asks = messages.where((F.col("role") == "user") & ~(M.is_greeting(text) | M.is_capability_question(text) | M.is_open_help(text)))
    before, starts = F.lag("text").over(_opening()), text.rlike("(?iU)" + "|".join(p + r"\b" for p in FOLLOW_UP))
    return asks.select("conv_id", "turn", F.when(starts & before.isNotNull(), F.concat_ws("\n", before, "text")).otherwise(text).alias("query"))


def follow_up_sql() -> str:
    starts = "|".join(p + r"(?:[^\p{L}\p{N}_]|$)" for p in FOLLOW_UP)
    asks = f"NOT ({M.is_greeting_sql('text')} OR {M.is_capability_sql('text')} OR {M.is_open_help_sql('text')})"
    return f"""SELECT conv_id, turn, CASE WHEN p IS NOT NULL AND regexp_matches(text, '(?i){starts}') THEN p || chr(10) || text ELSE text END AS query
FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM messages WHERE role = 'user' AND {asks})"""


def last_user_turn(messages: DataFrame) -> DataFrame:
    return messages.groupBy("conv_id").agg(F.max(F.when(F.col("role") == "user", F.col("turn"))).alias("turn"))


def preview(c: str, limit: int = 80) -> Column:
    return T.preview(c, limit)


def concatenated_requests(messages: DataFrame, most: int = 1200) -> DataFrame:
    """What a line is chosen from: a dialog's user texts joined by new lines, the last ``most`` characters."""
    texts = messages.where("role = 'user'").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("t"))
    joined = F.array_join(F.transform("t", lambda x: x["text"]), "\n")
    return texts.select("conv_id", F.right(joined, F.lit(most)).alias("requests"))
