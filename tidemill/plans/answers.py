"""Queries of answers and of sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import answers as A
from ..operators import clarify as C
from ..operators.topk import small
from ..registry import query
from ..sources import formats
from ..sources import tables as S
from ..sources.scratch import stored
from . import retrieval


@query("unit_segmentation")
def unit_segmentation(spark, sf_dir):
    return A.unit_rows(S.table(spark, sf_dir, "documents"), ["doc_id"], "text")


@query("extractive_answer")
def extractive_answer(spark, sf_dir):
    hits = small(stored(retrieval.lexical_topk(spark, sf_dir).select("qid", "rank", "document", "ord"), "hits"))
    hits = S.chunks(spark, sf_dir).join(hits, ["document", "ord"]).select("qid", "rank", "text")
    return A.extractive(hits).select("qid", "answer", F.array_join(F.transform("cited_ranks", lambda x: x.cast("string")), ",").alias("cited"))


_STEMS = T.significant_stems_sql


_TOPIC = "id, title, CASE WHEN parent = 0 THEN 'уполномоченный орган' WHEN parent = 1 THEN 'заказчики' ELSE 'topic ' || parent END AS parent, CASE WHEN id % 2 = 0 THEN split_part(title, ' ', 1) || ' document' ELSE '' END AS extra, CASE id % 20 WHEN 2 THEN s_manual WHEN 3 THEN c_manual ELSE 'src' || (id % 20) END AS preferred"
_FILE = "CASE section WHEN 'src2' THEN s_manual WHEN 'src3' THEN c_manual ELSE section END AS file, CASE WHEN ord % 7 = 3 THEN 'Вход для поставщиков ' WHEN ord % 11 = 5 THEN 'Рисунок ' ELSE '' END || text AS heading"
_MANUALS = f"manuals AS (SELECT '{A.SUPPLIER_MANUAL}' AS s_manual, '{A.CUSTOMER_MANUAL}' AS c_manual)"


@query(
    "topic_section_match",
    f"WITH {S.CHUNKS}, {S.CATALOG}, {_MANUALS}, c AS (SELECT {_TOPIC} FROM catalog, manuals), t AS (SELECT *, list_distinct({_STEMS('title')}) AS ts, list_distinct({_STEMS('parent')}) AS ps, list_distinct({_STEMS('extra')}) AS es FROM c), "
    f"s AS (SELECT document, ord, text, {_FILE} FROM chunks, manuals), w AS (SELECT document, ord, file, heading, list_distinct({_STEMS('heading')}) AS hs, list_distinct({_STEMS('substring(text, 1, 2500)')}) AS bs FROM s), "
    "z AS (SELECT id, document, ord, title, parent, heading, 5.0 * len(list_intersect(qs, hs)) + 1.6 * len(list_intersect(qs, bs)) + 0.4 * len(list_intersect(ps, hs)) + CASE WHEN preferred = file THEN 1.5 ELSE 0.0 END "
    "+ CASE WHEN len(ts) > 0 AND len(list_intersect(ts, hs)) = len(ts) THEN 4.0 ELSE 0.0 END + CASE WHEN len(list_intersect(es, hs)) > 0 THEN 2.0 ELSE 0.0 END "
    "+ CASE WHEN (contains(lower(parent), 'уполномочен') OR contains(lower(title), 'заказчик')) THEN CASE WHEN file = c_manual THEN 2.0 ELSE 0.0 END WHEN file = s_manual THEN 2.0 ELSE 0.0 END "
    "+ CASE WHEN contains(lower(heading), 'поставщик') AND NOT contains(lower(parent), 'заказчик') THEN 1.5 ELSE 0.0 END - CASE WHEN contains(lower(heading), 'пример') OR contains(lower(heading), 'рисунок') THEN 8.0 ELSE 0.0 END AS score "
    "FROM (SELECT *, list_distinct(list_concat(ts, es)) AS qs FROM t) CROSS JOIN w CROSS JOIN manuals WHERE len(qs) > 0), "
    "y AS (SELECT id, document, ord, round(CASE WHEN contains(lower(title), 'yml') AND contains(lower(heading), 'пример') OR trim(lower(title)) = 'консультация' AND NOT contains(lower(heading), 'консультац') THEN 0.0 ELSE score END, 6)::DOUBLE AS score FROM z), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, document, ord) AS rank FROM y WHERE score >= 2.6) SELECT id, document, ord, score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 2",
)
def topic_section_match(spark, sf_dir):
    """Catalog topics against lines as sections, with extra queries, preferred documents, the two manuals and headings that name suppliers or figures."""
    supplier, customer, none = F.lit(A.SUPPLIER_MANUAL), F.lit(A.CUSTOMER_MANUAL), F.lit("")
    extra = F.when(F.col("id") % 2 == 0, F.concat(F.split_part("title", F.lit(" "), F.lit(1)), F.lit(" document"))).otherwise(none)
    number = F.col("id") % 20
    preferred = F.array(F.when(number == 2, supplier).when(number == 3, customer).otherwise(F.concat(F.lit("src"), number.cast("string"))))
    parent = F.when(F.col("parent") == 0, F.lit("уполномоченный орган")).when(F.col("parent") == 1, F.lit("заказчики")).otherwise(F.concat(F.lit("topic "), F.col("parent").cast("string")))
    topics = S.catalog(spark, sf_dir).select("id", "title", parent.alias("parent"), extra.alias("extra"), preferred.alias("preferred"))
    file = F.when(F.col("section") == "src2", supplier).when(F.col("section") == "src3", customer).otherwise(F.col("section"))
    heading = F.concat(F.when(F.col("ord") % 7 == 3, F.lit("Вход для поставщиков ")).when(F.col("ord") % 11 == 5, F.lit("Рисунок ")).otherwise(none), "text")
    sections = S.chunks(spark, sf_dir).select("document", "ord", file.alias("file"), heading.alias("heading"), "text")
    return A.section_scores(topics, sections)


@query(
    "support_key_top8",
    f"WITH {S.MESSAGES}, m AS (SELECT conv_id % 20 AS topic, conv_id * 1000 + turn AS pos, {_STEMS('text')} AS ss FROM messages WHERE role = 'user'), e AS (SELECT topic, pos, i, ss[i] AS stem FROM (SELECT *, unnest(range(1, len(ss) + 1)) AS i FROM m)), "
    "c AS (SELECT topic, stem, count(*) AS n, min(pos * 10000 + i) AS first FROM e WHERE length(stem) >= 4 GROUP BY topic, stem), r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY n DESC, first) AS rank FROM c) SELECT topic, stem, n, CAST(rank AS INT) AS rank FROM r WHERE rank <= 8",
)
def support_key_top8(spark, sf_dir):
    rows = S.messages(spark, sf_dir).where("role = 'user'").select((F.col("conv_id") % 20).alias("topic"), (F.col("conv_id") * 1000 + F.col("turn")).alias("pos"), "text")
    return A.frequent_stems(rows, "topic", "text")


def _streams(spark, sf_dir):
    """Conversations written as NDJSON event lines: snapshots of each text, an end for those whose last turn is an assistant's."""
    m = S.messages(spark, sf_dir).select(F.col("conv_id").alias("id"), F.col("turn").alias("seq"), F.to_json(F.struct(F.lit("text").alias("type"), "text")).alias("value"))
    ends = S.messages(spark, sf_dir).groupBy("conv_id").agg(F.max("turn").alias("seq"), F.max_by("role", "turn").alias("role")).where("role = 'assistant'")
    done = ends.select(F.col("conv_id").alias("id"), (F.col("seq") + 1).alias("seq"), F.lit('{"type":"done","response":{}}').alias("value"))
    return m.union(done)


@query("ndjson_streams", f"WITH {S.MESSAGES} SELECT conv_id AS id, arg_max(role, turn) <> 'assistant' AS failed, arg_max(text, turn) AS text FROM messages GROUP BY conv_id")
def ndjson_streams(spark, sf_dir):
    return formats.stream_outcomes(formats.parse_events(_streams(spark, sf_dir)))


@query("truncated_excerpts", r"SELECT doc_id, CASE WHEN length(text) <= 300 THEN text WHEN contains(substring(text, 1, 300), ' ') THEN regexp_replace(substring(text, 1, 300), ' [^ ]*\z', '') ELSE substring(text, 1, 300) END AS excerpt FROM documents")
def truncated_excerpts(spark, sf_dir):
    return S.table(spark, sf_dir, "documents").select("doc_id", A.truncated(F.col("text"), F.lit(300)).alias("excerpt"))


@query(
    "option_list",
    f"WITH {S.CHUNKS}, o AS (SELECT section, lower(substring(text, 1, 30)) AS k, min((document * 100000 + ord, substring(text, 1, 30))) AS f FROM chunks GROUP BY ALL), r AS (SELECT section, struct_extract(f, 1) AS place, struct_extract(f, 2) AS label, row_number() OVER (PARTITION BY section ORDER BY struct_extract(f, 1)) AS rank FROM o) SELECT section, place, label, CAST(rank AS INT) AS rank FROM r WHERE rank <= 6",
)
def option_list(spark, sf_dir):
    """The first six distinct labels of each section."""
    rows = S.chunks(spark, sf_dir).select("section", (F.col("document") * 100000 + F.col("ord")).alias("place"), F.substring("text", 1, 30).alias("label"))
    return C.options(rows, ["section"], "place", "label")


@query("request_stems", f"WITH {S.MESSAGES} SELECT conv_id, turn, len(list_distinct({_STEMS('text')})) AS n_stems, regexp_matches(text, '^(?:[0-9]{{10}}|[0-9]{{12}})$') AS is_tax_number FROM messages WHERE role = 'user'")
def request_stems(spark, sf_dir):
    m = S.messages(spark, sf_dir).where("role = 'user'")
    return m.select("conv_id", "turn", F.size(C.expanded_stems(F.col("text"))).cast("bigint").alias("n_stems"), F.col("text").rlike("^(?:[0-9]{10}|[0-9]{12})$").alias("is_tax_number"))
