"""Queries of moderation and intents over messages and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import moderation as M
from ..registry import query
from ..sources import tables as S

#: A lexicon for the driver's tables, whose words are made up.
WORDS = ["token", "tiane", "thable", "shonthe", "erste"]
_WORDS = ", ".join(f"'{w}'" for w in WORDS)
_MAPPED = [w.translate(str.maketrans(T.LATIN, T.CYRILLIC)) for w in WORDS]


def _lexicon(spark):
    return spark.createDataFrame([(w,) for w in _MAPPED], "word string")


@query("lexicon_hits", f"SELECT doc_id, count(*) AS n_hits FROM (SELECT doc_id, unnest({T.tokens_sql('text')}) AS t FROM documents) WHERE t IN ({_WORDS}) GROUP BY doc_id")
def lexicon_hits(spark, sf_dir):
    listed = F.filter(T.tokens("text"), lambda t: t.isin(WORDS))  # so that no row is made of any other token
    tokens = S.table(spark, sf_dir, "documents").select("doc_id", F.explode(listed).alias("t"))
    return tokens.groupBy("doc_id").agg(F.count("*").alias("n_hits"))


@query("flagged_matches")
def flagged_matches(spark, sf_dir):
    """Flagged terms of each message; folding needs a back reference, which DuckDB lacks."""
    return M.scan(S.messages(spark, sf_dir).where("role = 'user'"), ["conv_id", "turn"], "text", _lexicon(spark))


@query("moderation_verdict")
def moderation_verdict(spark, sf_dir):
    users = S.messages(spark, sf_dir).where("role = 'user'")
    terms = M.scan(users, ["conv_id", "turn"], "text", _lexicon(spark))
    rest = M.remainders(users, ["conv_id", "turn"], "text", _lexicon(spark))
    return rest.join(terms, ["conv_id", "turn"], "left").select("conv_id", "turn", M.verdict(F.col("n_terms").isNotNull(), F.col("rest")).alias("verdict"), F.length("rest").alias("rest_chars"))


_T = f"array_to_string({T.tokens_sql('text')}, ' ')"


@query(
    "intent_flags",
    f"WITH {S.MESSAGES} SELECT conv_id, turn, len({T.tokens_sql('text')}) BETWEEN 1 AND 3 AND len(list_filter({T.tokens_sql('text')}, lambda x: x NOT IN ({', '.join(repr(g) for g in M.GREETINGS)}))) = 0 AS greeting, "
    f"regexp_full_match({_T}, '{M.THANKS[1:-1]}') AS thanks, regexp_full_match({_T}, '{M.SMALLTALK[1:-1]}') AS smalltalk, {M.is_capability_sql('text')} AS capability FROM messages WHERE role = 'user'",
)
def intent_flags(spark, sf_dir):
    return S.messages(spark, sf_dir).where("role = 'user'").select(
        "conv_id", "turn", M.is_greeting("text").alias("greeting"), M.is_thanks("text").alias("thanks"), M.is_smalltalk("text").alias("smalltalk"), M.is_capability_question("text").alias("capability")
    )


@query("open_help", f"WITH {S.MESSAGES} SELECT conv_id, turn, {M.is_open_help_sql('text')} AS open_help, {M.reports_ui_defect_sql('text')} AS ui_defect FROM messages WHERE role = 'user'")
def open_help(spark, sf_dir):
    text = F.col("text")
    return S.messages(spark, sf_dir).where("role = 'user'").select("conv_id", "turn", M.is_open_help(text).alias("open_help"), M.reports_ui_defect(text).alias("ui_defect"))


@query("toxic_confusion", f"WITH h AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, unnest({T.tokens_sql('text')}) AS t FROM documents) WHERE t IN ({_WORDS})) SELECT l.toxic, h.doc_id IS NOT NULL AS hit, count(*) AS n FROM labels l LEFT JOIN h USING (doc_id) GROUP BY 1, 2")
def toxic_confusion(spark, sf_dir):
    hits = lexicon_hits(spark, sf_dir).select("doc_id", F.lit(True).alias("hit"))
    return S.table(spark, sf_dir, "labels").join(hits, "doc_id", "left").groupBy("toxic", F.col("hit").isNotNull().alias("hit")).agg(F.count("*").alias("n"))
