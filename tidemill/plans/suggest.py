"""Queries of autocomplete, audits and sets of hits."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import audit, autocomplete
from ..registry import query
from ..sources import tables as S

_SIG = f"t NOT IN ({', '.join(repr(w) for w in T.STOPWORDS)})"
_INPUTS = "inputs AS (SELECT id AS iid, array_to_string(list_slice(string_split(title, ' '), 1, 2), ' ') AS input FROM catalog)"
_INDEX = f"""cw AS (SELECT DISTINCT qid, t FROM (SELECT qid, unnest({T.tokens_sql('query')}) AS t FROM corpus) WHERE {_SIG}),
idx AS (SELECT DISTINCT qid, 'p' || substring(t, 1, k) AS term FROM (SELECT qid, t, unnest(range(2, length(t) + 1)) AS k FROM cw WHERE length(t) >= 2) UNION SELECT qid, 's' || {T.stem_sql('t')} AS term FROM cw),
iw AS (SELECT DISTINCT iid, t AS word FROM (SELECT iid, unnest({T.tokens_sql('input')}) AS t FROM inputs) WHERE {_SIG} AND length(t) >= 2),
ia AS (SELECT iid, word, 'p' || word AS term FROM iw UNION SELECT iid, word, 's' || {T.stem_sql('word')} AS term FROM iw),
hits AS (SELECT DISTINCT iid, word, qid FROM ia JOIN idx USING (term)), n AS (SELECT iid, count(*) AS n FROM iw GROUP BY iid),
whole AS (SELECT iid, qid FROM hits JOIN n USING (iid) GROUP BY iid, qid, n HAVING count(*) = n)"""
_HEAD = f"WITH {S.MESSAGES}, {S.CORPUS}, {S.CATALOG}, {_INPUTS}, {_INDEX}"


def _inputs(spark, sf_dir):
    title = F.array_join(F.slice(F.split("title", " ", -1), 1, 2), " ")
    return S.catalog(spark, sf_dir).select(F.col("id").alias("iid"), title.alias("input"))


@query("autocomplete_candidates", f"{_HEAD} SELECT iid, word, qid FROM hits JOIN whole USING (iid, qid)")
def autocomplete_candidates(spark, sf_dir):
    return autocomplete.candidates(_inputs(spark, sf_dir), autocomplete.postings(S.corpus(spark, sf_dir)))


@query(
    "autocomplete_ranked",
    f"{_HEAD}, w AS (SELECT word, ln(1 + (SELECT count(*) FROM corpus) / count(DISTINCT qid)::DOUBLE) AS weight FROM hits GROUP BY word), "
    "s AS (SELECT iid, h.qid, query, sum(weight * CASE WHEN c.t IS NOT NULL THEN 2 ELSE 1 END) AS w FROM hits h JOIN whole USING (iid, qid) JOIN w USING (word) JOIN corpus ON corpus.qid = h.qid LEFT JOIN cw c ON c.qid = h.qid AND c.t = h.word GROUP BY iid, h.qid, query) "
    "SELECT iid, qid, query, round(12 * CAST(starts_with(query, input) AS INT) + 6 * CAST(contains(query, input) AS INT) + w, 6)::DOUBLE AS score FROM s JOIN inputs USING (iid) WHERE query <> input",
)
def autocomplete_ranked(spark, sf_dir):
    c = S.corpus(spark, sf_dir)
    return autocomplete.ranked(_inputs(spark, sf_dir), c, autocomplete.postings(c))


@query("autocomplete_diverse")
def autocomplete_diverse(spark, sf_dir):
    return autocomplete.diverse(autocomplete_ranked(spark, sf_dir), 5)


@query("audit_window", f"WITH {S.CLOSURES} SELECT id, rating FROM closures WHERE closed_at >= TIMESTAMP '2024-01-14 09:30:00' AND closed_at < TIMESTAMP '2024-01-15 09:30:00' AND rating IS NOT NULL")
def audit_window(spark, sf_dir):
    end = dt.datetime(2024, 1, 15, 9, 30)
    return audit.window(S.closures(spark, sf_dir), "closed_at", end).where("rating is not null").select("id", "rating")


def _sized(spark, sf_dir):
    c = S.closures(spark, sf_dir).where("rating is not null")
    return c.select(F.to_date("closed_at").alias("period"), F.date_format("closed_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("stamp"), "id", (F.lit(900) + F.pmod(F.col("id") * 7919, F.lit(4001))).alias("size"))


@query(
    "audit_packing",
    f"WITH RECURSIVE {S.CLOSURES}, s AS (SELECT CAST(closed_at AS DATE) AS period, closed_at AS stamp, id, 900 + (id * 7919) % 4001 AS size FROM closures WHERE rating IS NOT NULL), "
    "o AS (SELECT *, row_number() OVER (PARTITION BY period ORDER BY stamp, id) AS r FROM s), "
    "p(period, r, id, size, batch, items, chars) AS (SELECT period, r, id, size, 0, 1, size FROM o WHERE r = 1 UNION ALL "
    "SELECT o.period, o.r, o.id, o.size, p.batch + CASE WHEN p.items >= 100 OR p.chars + o.size > 200000 THEN 1 ELSE 0 END, CASE WHEN p.items >= 100 OR p.chars + o.size > 200000 THEN 1 ELSE p.items + 1 END, CASE WHEN p.items >= 100 OR p.chars + o.size > 200000 THEN o.size ELSE p.chars + o.size END FROM p JOIN o ON o.period = p.period AND o.r = p.r + 1) "
    "SELECT period, id, CAST(size AS BIGINT) AS size, CAST(batch AS INT) AS batch FROM p",
)
def audit_packing(spark, sf_dir):
    return audit.pack(_sized(spark, sf_dir))


@query("audit_bisect")
def audit_bisect(spark, sf_dir):
    return audit.bisect(audit.pack(_sized(spark, sf_dir)), F.col("total") > 60_000)


@query("audit_ratings", f"WITH {S.CLOSURES} SELECT CAST(closed_at AS DATE) AS period, count(*) FILTER (WHERE rating = 'complete') AS complete, count(*) FILTER (WHERE rating = 'partial') AS partial, count(*) FILTER (WHERE rating = 'irrelevant') AS irrelevant FROM closures GROUP BY 1")
def audit_ratings(spark, sf_dir):
    return audit.ratings(S.closures(spark, sf_dir).withColumn("period", F.to_date("closed_at")), ["period"])


@query("audit_selection", f"WITH {S.CLOSURES} SELECT id, rating FROM (SELECT * FROM closures ORDER BY closed_at DESC, id DESC LIMIT 500) WHERE rating IS NOT NULL AND closed_at >= TIMESTAMP '2024-01-30'")
def audit_selection(spark, sf_dir):
    return audit.selection(S.closures(spark, sf_dir), S.AS_OF, 1).select("id", "rating")


@query("audit_last_rated", f"WITH {S.CLOSURES} SELECT id, rating FROM (SELECT * FROM closures ORDER BY closed_at DESC, id DESC LIMIT 500) WHERE rating IS NOT NULL ORDER BY closed_at DESC, id DESC LIMIT 30")
def audit_last_rated(spark, sf_dir):
    return audit.last_rated(S.closures(spark, sf_dir), 30).select("id", "rating")


_SAMPLE = f"""{S.MESSAGES}, o AS (SELECT conv_id % 4 AS batch, conv_id, count(*) AS n, sum(length(text)) AS chars, bool_or(role = 'user') AND bool_or(role = 'assistant') AS pair, bool_and(length(text) BETWEEN 1 AND 12000) AS sized FROM messages GROUP BY ALL),
p AS (SELECT batch, count(*) AS n_dialogs, CAST(sum(chars) AS BIGINT) AS n_chars, bool_and(pair) AS roles, bool_and(n BETWEEN 2 AND 200) AS few, bool_and(sized) AS texts FROM o GROUP BY batch)"""


@query("audit_faults", f"WITH {_SAMPLE} SELECT batch, n_dialogs, n_chars, array_to_string(list_filter([CASE WHEN NOT roles THEN 'roles' END, CASE WHEN NOT few THEN 'messages' END, CASE WHEN NOT texts THEN 'texts' END, CASE WHEN n_dialogs > 100 THEN 'dialogs' END, CASE WHEN n_chars > 20000 THEN 'characters' END], lambda x: x IS NOT NULL), ' ') AS faults FROM p")
def audit_faults(spark, sf_dir):
    """What keeps each quarter of the dialogs from going out as one batch of at most 20 000 characters."""
    rows = S.messages(spark, sf_dir).select((F.col("conv_id") % 4).alias("batch"), F.col("conv_id").alias("id"), "role", "text")
    return audit.sample_faults(rows, most_chars=20_000)


@query("audit_checks", f"WITH {S.MESSAGES} SELECT conv_id, count(*) AS n_messages, CAST(sum(length(text)) AS BIGINT) AS n_chars, bool_or(role = 'user') AND bool_or(role = 'assistant') AS both_roles, min(length(text)) >= 1 AS none_empty FROM messages GROUP BY conv_id")
def audit_checks(spark, sf_dir):
    return audit.checks(S.messages(spark, sf_dir))


@query("next_run_label")
def next_run_label(spark, sf_dir):
    at = S.closures(spark, sf_dir).select("id", audit.next_run(F.col("closed_at"), "09:00", "Europe/Moscow").alias("at"))
    return at.select("id", audit.zone_label(F.col("at"), "Europe/Moscow").alias("label"))


_HITS = f"a AS (SELECT doc_id FROM (SELECT doc_id, unnest({T.tokens_sql('text')}) AS t FROM documents) WHERE t = 'token'), b AS (SELECT doc_id FROM documents WHERE n_chars > 3000)"


@query("set_ops_hits", f"WITH {_HITS} SELECT 'both' AS kind, count(*) AS n FROM (SELECT doc_id FROM a INTERSECT SELECT doc_id FROM b) UNION ALL SELECT 'either', count(*) FROM (SELECT doc_id FROM a UNION SELECT doc_id FROM b) UNION ALL SELECT 'first', count(*) FROM (SELECT doc_id FROM a EXCEPT SELECT doc_id FROM b)")
def set_ops_hits(spark, sf_dir):
    d = S.table(spark, sf_dir, "documents")
    a, b = d.select("doc_id", F.explode(T.tokens("text")).alias("t")).where("t = 'token'").select("doc_id"), d.where("n_chars > 3000").select("doc_id")
    count = lambda df, kind: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    return count(a.intersect(b), "both").union(count(a.union(b).distinct(), "either")).union(count(a.subtract(b), "first"))


@query("citation_dedupe", "WITH c AS (SELECT l_orderkey, l_suppkey, min(l_linenumber) AS first FROM lineitem GROUP BY l_orderkey, l_suppkey) SELECT l_orderkey, string_agg(CAST(l_suppkey AS VARCHAR), ',' ORDER BY first, l_suppkey) AS cited FROM c GROUP BY l_orderkey")
def citation_dedupe(spark, sf_dir):
    """Cited suppliers of each order, once each, in order of first mention."""
    first = S.table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.min("l_linenumber").alias("first"))
    cited = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("first", "l_suppkey"))), lambda x: x["l_suppkey"].cast("string")), ",")
    return first.groupBy("l_orderkey").agg(cited.alias("cited"))
