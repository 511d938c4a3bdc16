"""Queries over dialogs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import dialogs as D
from ..registry import query
from ..sources import tables as S

_M = f"WITH {S.MESSAGES} "


@query("dialog_rollup", f"{_M} SELECT conv_id, count(*) AS n_messages, CAST(sum(length(text)) AS BIGINT) AS n_chars, arg_min(text, turn) FILTER (WHERE role = 'user') AS first_user, arg_max(text, turn) FILTER (WHERE role = 'assistant') AS last_assistant FROM messages GROUP BY conv_id")
def dialog_rollup(spark, sf_dir):
    return D.rollup(S.messages(spark, sf_dir))


@query("dialog_list", f"WITH {S.CLOSURES} SELECT id, status, strftime(closed_at, '%Y-%m-%d %H:%M:%S') AS closed FROM closures ORDER BY closed_at DESC, id DESC LIMIT 100")
def dialog_list(spark, sf_dir):
    rows = D.newest(S.closures(spark, sf_dir).select("id", "status", "closed_at"), "closed_at", "id", 100)
    return rows.select("id", "status", F.date_format("closed_at", "yyyy-MM-dd HH:mm:ss").alias("closed"))


@query("dialog_get", f"WITH {S.CLOSURES} SELECT id, reason, status FROM closures WHERE id = 42")
def dialog_get(spark, sf_dir):
    return S.closures(spark, sf_dir).where("id = 42").select("id", "reason", "status")


@query("dialog_preview", f"{_M} SELECT conv_id, turn, {T.preview_sql('text')} AS preview FROM messages WHERE role = 'user'")
def dialog_preview(spark, sf_dir):
    return S.messages(spark, sf_dir).where("role = 'user'").select("conv_id", "turn", D.preview("text").alias("preview"))


@query("dialog_search", f"{_M}, t AS (SELECT conv_id, substring(arg_min(text, turn), 1, 64) AS title FROM messages WHERE role = 'user' GROUP BY conv_id) SELECT conv_id, title FROM t WHERE contains(lower(title), 'the')")
def dialog_search(spark, sf_dir):
    titles = S.messages(spark, sf_dir).where("role = 'user'").groupBy("conv_id").agg(F.substring(F.min_by("text", "turn"), 1, 64).alias("title"))
    return titles.where(D.title_contains(F.col("title"), "THE"))


@query("recency_bucket", f"WITH {S.CLOSURES} SELECT id, CASE WHEN d <= 0 THEN 'today' WHEN d = 1 THEN 'yesterday' ELSE 'earlier' END AS bucket FROM (SELECT id, date_diff('day', CAST(closed_at AS DATE), DATE '2024-01-31') AS d FROM closures)")
def recency_bucket(spark, sf_dir):
    return S.closures(spark, sf_dir).select("id", D.recency(F.col("closed_at"), S.AS_OF).alias("bucket"))


@query("question_answer_pairs", f"{_M} SELECT q.conv_id, q.turn, min(a.turn) AS answer_turn FROM messages q LEFT JOIN messages a ON a.conv_id = q.conv_id AND a.turn > q.turn AND a.role = 'assistant' WHERE q.role = 'user' GROUP BY q.conv_id, q.turn")
def question_answer_pairs(spark, sf_dir):
    return D.question_answer_pairs(S.messages(spark, sf_dir))


@query("last_answer_context", f"{_M}, r AS (SELECT a.conv_id, a.turn, max(q.turn) AS request_turn FROM messages a JOIN messages q ON q.conv_id = a.conv_id AND q.turn < a.turn AND q.role = 'user' WHERE a.role = 'assistant' AND trim(a.text) <> '' GROUP BY a.conv_id, a.turn) SELECT conv_id, max(turn) AS answer_turn, arg_max(request_turn, turn) AS request_turn FROM r GROUP BY conv_id")
def last_answer_context(spark, sf_dir):
    return D.last_answers(S.messages(spark, sf_dir))


@query("pending_card", f"{_M}, s AS (SELECT conv_id, max(turn) FILTER (WHERE role = 'assistant' AND turn % 3 = 1) AS card_turn, max(turn) FILTER (WHERE role = 'assistant' AND turn % 3 <> 1) AS settled FROM messages GROUP BY conv_id) SELECT conv_id, card_turn FROM s WHERE card_turn IS NOT NULL AND (settled IS NULL OR settled < card_turn)")
def pending_card(spark, sf_dir):
    answer = F.col("role") == "assistant"
    return D.pending_cards(S.messages(spark, sf_dir), answer & (F.col("turn") % 3 == 1), answer & (F.col("turn") % 3 != 1))


@query("last_k_history", f"{_M} SELECT conv_id, turn, CAST(back AS INT) AS back FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM messages) WHERE back <= 4 AND length(text) <= 800")
def last_k_history(spark, sf_dir):
    return D.last_turns(S.messages(spark, sf_dir))


@query("previous_role", f"{_M} SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS previous FROM messages")
def previous_role(spark, sf_dir):
    return D.previous_role(S.messages(spark, sf_dir))


@query("follow_up_query", f"{_M} {D.follow_up_sql()}")
def follow_up_query(spark, sf_dir):
    return D.follow_up_queries(S.messages(spark, sf_dir))


@query("last_user_turn", f"{_M} SELECT conv_id, max(turn) FILTER (WHERE role = 'user') AS turn FROM messages GROUP BY conv_id")
def last_user_turn(spark, sf_dir):
    return D.last_user_turn(S.messages(spark, sf_dir))


@query("line_request_text", f"{_M} SELECT conv_id, right(string_agg(text, chr(10) ORDER BY turn), 1200) AS requests FROM messages WHERE role = 'user' GROUP BY conv_id")
def line_request_text(spark, sf_dir):
    return D.concatenated_requests(S.messages(spark, sf_dir))
