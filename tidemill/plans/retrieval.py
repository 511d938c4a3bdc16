"""Queries of retrieval: catalog titles against the chunks of documents, vectors against vectors, chunks against pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import ivf
from ..operators import retrieval as R
from ..registry import query
from ..sources import tables as S

_GENERIC = ", ".join(f"'{k}'" for k in R.WEIGHTS)
_ABBR = ", ".join(f"'{k}'" for k in T.ABBREVIATIONS)
_WEIGHT = "CASE term " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in R.WEIGHTS.items()) + " ELSE 1.0 END"
_ALIAS = "alias(root, folded) AS (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in R.ALIASES.items()) + ")"


def _terms(name: str, keys: str, text: str, source: str) -> str:
    """CTEs of the distinct folded roots of a text; stems and roots are taken once a distinct token."""
    return f"""{name}_t AS (SELECT DISTINCT {keys}, t FROM (SELECT {keys}, unnest({T.tokens_sql(text)}) AS t FROM {source}) WHERE {T.significant_sql('t')}),
{name}_s AS (SELECT t, {T.stem_sql('t')} AS s FROM (SELECT DISTINCT t FROM {name}_t)),
{name}_r AS (SELECT t, {T.root_sql('s')} AS r FROM {name}_s),
{name} AS (SELECT DISTINCT {keys}, coalesce(folded, r) AS term FROM {name}_t JOIN {name}_r USING (t) LEFT JOIN alias ON r = root)"""


_SEEK = f"NOT (term = '{R.SEEKING}' AND qid IN (SELECT qid FROM q_all WHERE term = '{R.ABOUT}'))"
_LEXICAL = f"""{S.CHUNKS}, {S.CATALOG}, {_ALIAS}, queries AS (SELECT id AS qid, title AS query FROM catalog),
{_terms('q_all', 'qid', 'query', 'queries')}, qt AS (SELECT * FROM q_all WHERE {_SEEK}),
qn AS (SELECT qid, count(*) AS n_roots, count(*) FILTER (WHERE term NOT IN ({_GENERIC})) AS n_subject FROM qt GROUP BY qid),
{_terms('ct', 'document, ord', 'text', 'chunks')},
heads AS (SELECT DISTINCT section FROM chunks WHERE len(list_filter({T.tokens_sql('section')}, lambda t: {T.significant_sql('t')})) <= 12),
{_terms('ht', 'section', 'section', 'heads')},
th AS (SELECT qid, document, ord, count(*) AS n, sum({_WEIGHT}) AS w, count(*) FILTER (WHERE term IN ({_ABBR})) AS abbr, count(*) FILTER (WHERE term NOT IN ({_GENERIC})) AS subject FROM qt JOIN ct USING (term) GROUP BY ALL),
hh AS (SELECT qid, section, count(*) AS in_head, count(*) FILTER (WHERE term NOT IN ({_GENERIC})) AS head_subject FROM qt JOIN ht USING (term) GROUP BY ALL),
lexical AS (SELECT qid, document, ord, round(CASE WHEN n_subject = 0 OR subject + coalesce(head_subject, 0) > 0 THEN 2.0 * w + abbr + 2.0 * coalesce(in_head, 0) + n::DOUBLE / n_roots ELSE 0.0 END, 6)::DOUBLE AS score
  FROM th JOIN qn USING (qid) JOIN chunks USING (document, ord) LEFT JOIN hh USING (qid, section))"""


def _queries(spark, sf_dir):
    return S.catalog(spark, sf_dir).select(F.col("id").alias("qid"), F.col("title").alias("query"))


@query("lexical_topk", f"WITH {_LEXICAL}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, document, ord) AS rank FROM lexical WHERE score >= 2) SELECT qid, document, ord, score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 3")
def lexical_topk(spark, sf_dir):
    return R.lexical_top(_queries(spark, sf_dir), S.chunks(spark, sf_dir), 3)


def _field(name: str, field: str, boost: float) -> str:
    return f"""{name}_k AS (SELECT document, ord, {T.tokens_sql(field)} AS t FROM chunks), {name}_m AS (SELECT avg(len(t)) AS mean FROM {name}_k),
{name}_f AS (SELECT document, ord, n, term, count(*) AS tf FROM (SELECT document, ord, len(t) AS n, unnest(t) AS term FROM {name}_k) GROUP BY ALL),
{name}_d AS (SELECT term, count(*) AS df FROM {name}_f GROUP BY term),
{name} AS (SELECT qid, document, ord, {boost} * ln(1 + ((SELECT count(*) FROM chunks) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean)) AS w FROM asked JOIN {name}_d USING (term) JOIN {name}_f USING (term), {name}_m)"""


_BM25 = f"""asked AS (SELECT DISTINCT id AS qid, unnest({T.tokens_sql('title')}) AS term FROM catalog), {_field('bt', 'text', 1.0)}, {_field('bs', 'section', 4.0)},
bm25 AS (SELECT qid, document, ord, round(sum(w), 6) AS score FROM (SELECT * FROM bt UNION ALL SELECT * FROM bs) GROUP BY ALL)"""


@query("bm25_topk", f"WITH {S.CHUNKS}, {S.CATALOG}, {_BM25}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, document, ord) AS rank FROM bm25) SELECT qid, document, ord, score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 10")
def bm25_topk(spark, sf_dir):
    return R.bm25_top(_queries(spark, sf_dir), S.chunks(spark, sf_dir), 10)


_COSINE = "c AS (SELECT q.vec_id AS qid, v.vec_id AS vec_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id)"


@query("cosine_topk", f"WITH {_COSINE}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM c) SELECT qid, vec_id, score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 20")
def cosine_topk(spark, sf_dir):
    """The stated query set, every hundredth vector, against all."""
    v = S.table(spark, sf_dir, "embeddings")
    return R.cosine_top(v.where("vec_id % 100 = 0"), v, 20)


@query("ivf_topk")
def ivf_topk(spark, sf_dir):
    """Fifty neighbours of every hundredth vector among the four hundred and more of the cells that it probes."""
    v = S.table(spark, sf_dir, "embeddings")
    return ivf.search(ivf.build(v), v.where("vec_id % 100 = 0"))


@query("ivf_exact_topk", f"WITH {_COSINE}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM c) SELECT qid, vec_id, score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 50")
def ivf_exact_topk(spark, sf_dir):
    """The same neighbours with nothing missed, by the cells' residual bounds."""
    v = S.table(spark, sf_dir, "embeddings")
    return ivf.search(ivf.build(v), v.where("vec_id % 100 = 0"), exact=True)


def _hashed(name: str, keys: str, text: str, source: str) -> str:
    h = "CAST('0x' || substr(md5(t), 1, 8) AS BIGINT)"
    return f"""{name}_x AS (SELECT {keys}, {h} % 64 AS place, sum(CASE WHEN substr(md5(t), 9, 1) < '8' THEN -1 ELSE 1 END) AS x FROM (SELECT {keys}, unnest({T.tokens_sql(text)}) AS t FROM {source}) GROUP BY ALL),
{name} AS (SELECT *, sum(x * x) OVER (PARTITION BY {keys}) AS norm FROM {name}_x WHERE x <> 0)"""


_VECTOR = f"""{_hashed('qv', 'qid', 'query', 'queries')}, {_hashed('cv', 'document, ord', 'text', 'chunks')},
vectors AS (SELECT qid, document, ord, round(CAST(sum(q.x * c.x) AS DOUBLE) / sqrt(CAST(q.norm * c.norm AS DOUBLE)), 6) AS score FROM qv q JOIN cv c USING (place) GROUP BY qid, document, ord, q.norm, c.norm)"""
_FUSED = """f AS (SELECT DISTINCT qid, document, ord FROM (SELECT qid, document, ord, row_number() OVER (PARTITION BY qid ORDER BY score DESC, document, ord) AS k FROM bm25) WHERE k <= 50
  UNION SELECT qid, document, ord FROM (SELECT qid, document, ord, row_number() OVER (PARTITION BY qid ORDER BY score DESC, document, ord) AS k FROM vectors) WHERE k <= 50),
g AS (SELECT f.*, coalesce(score, 0.0) AS lexical, max(coalesce(score, 0.0)) OVER (PARTITION BY f.qid) AS best FROM f LEFT JOIN lexical l ON l.qid = f.qid AND l.document = f.document AND l.ord = f.ord),
s AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY lexical DESC, document, ord) AS k FROM g WHERE lexical > 0 OR best <= 0),
o AS (SELECT qid, document, ord, round(lexical / (lexical + 4.0) + 0.1 * lexical, 6)::DOUBLE AS score FROM s WHERE k <= 24)"""


@query("vector_topk", f"WITH {S.CHUNKS}, {S.CATALOG}, queries AS (SELECT id AS qid, title AS query FROM catalog), {_VECTOR}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, document, ord) AS rank FROM vectors) SELECT qid, document, ord, score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 10")
def vector_topk(spark, sf_dir):
    """The vector channel, with hashed features in place of a model's."""
    return R.vector_top(_queries(spark, sf_dir), S.chunks(spark, sf_dir), 10)


@query("hybrid_fusion", f"WITH {_LEXICAL}, {_BM25}, {_VECTOR}, {_FUSED}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, document, ord) AS rank FROM o) SELECT qid, document, ord, score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 3")
def hybrid_fusion(spark, sf_dir):
    """Full text and vectors, fifty each, put in order by their lexical scores; the stand-in for a model's rank is a squashed lexical score."""
    q, c = _queries(spark, sf_dir), R.chunk_tokens(S.chunks(spark, sf_dir))
    hits = R.joined_hits([R.bm25_top(q, c, R.CHANNEL), R.vector_top(q, c, R.CHANNEL)])
    return R.fuse(R.lexical_of(hits, q, c), F.col("lexical") / (F.col("lexical") + 4.0))


_OFF = ", ".join(f"'{R.ALIASES.get(R._py_term(w), R._py_term(w))}'" for w in R.CATALOG_NOISE.split())
_TOPICS = "topics AS (SELECT id, title, 'topic ' || parent AS section FROM catalog), asks AS (SELECT qid, query FROM corpus)"


@query(
    "catalog_boost",
    f"WITH {S.MESSAGES}, {S.CORPUS}, {S.CATALOG}, {_ALIAS}, {_TOPICS}, {_terms('q_all', 'qid', 'query', 'asks')}, qt AS (SELECT * FROM q_all WHERE {_SEEK} AND term NOT IN ({_OFF})), "
    f"{_terms('tt', 'id', 'title', 'topics')}, {_terms('st', 'id', 'section', 'topics')}, "
    f"a AS (SELECT id, term, max(in_title) AS in_title FROM (SELECT id, term, 1 AS in_title FROM tt UNION ALL SELECT id, term, 0 AS in_title FROM st) WHERE term NOT IN ({_OFF}) GROUP BY id, term), "
    "big AS (SELECT id FROM a GROUP BY id HAVING count(*) >= 2), b AS (SELECT a.* FROM a JOIN big USING (id)), df AS (SELECT term, count(*) AS df FROM b GROUP BY term), n AS (SELECT qid, count(*) AS n FROM qt GROUP BY qid), "
    "m AS (SELECT qid, id, count(*) AS n_both, sum(in_title) AS n_title, sum(1.0 / df) AS rare FROM qt JOIN b USING (term) JOIN df USING (term) GROUP BY qid, id), "
    "s AS (SELECT qid, id, title, round(2 * n_title + n_both + rare, 6)::DOUBLE AS score FROM m JOIN n USING (qid) JOIN topics USING (id) JOIN asks USING (qid) WHERE CASE WHEN n = 1 THEN n_title >= 1 ELSE n_both >= 2 END AND NOT contains(lower(query), lower(title))), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s) SELECT qid, id, title, score FROM r WHERE rank = 1",
)
def catalog_boost(spark, sf_dir):
    topics = S.catalog(spark, sf_dir).select("id", "title", F.concat(F.lit("topic "), F.col("parent").cast("string")).alias("section"))
    return R.catalog_boost(S.corpus(spark, sf_dir), topics)


def _words(c: str) -> str:
    return f"regexp_extract_all(replace(replace(regexp_replace(replace({T.folded_sql(c)}, chr(173), ''), '([\\p{{L}}\\p{{N}}_])-\\s*\\n\\s*([\\p{{L}}\\p{{N}}_])', '\\1\\2', 'g'), '-', ''), chr(0), ''), '{T.TOKEN}')"


def _triples(name: str, keys: str, text: str, source: str) -> str:
    return f"{name}_w AS (SELECT {keys}, {_words(text)} AS w FROM {source}), {name} AS (SELECT DISTINCT {keys}, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS shingle FROM (SELECT *, unnest(range(1, len(w) - 1)) AS i FROM {name}_w WHERE len(w) >= 3))"


_FRAGMENTS = "frags AS (SELECT document, ord, section AS doc_key, text FROM chunks), pgs AS (SELECT source AS doc_key, doc_id AS page, text FROM documents)"


@query(
    "page_resolve",
    f"WITH {S.CHUNKS}, {_FRAGMENTS}, {_triples('fs', 'document, ord, doc_key', 'text', 'frags')}, {_triples('ps', 'doc_key, page', 'text', 'pgs')}, n AS (SELECT document, ord, count(*) AS n FROM fs GROUP BY ALL), "
    "v AS (SELECT document, ord, page, count(*) AS votes FROM fs JOIN ps USING (doc_key, shingle) GROUP BY ALL), b AS (SELECT document, ord, max(votes) AS most FROM v GROUP BY ALL), "
    "t AS (SELECT document, ord, min(page) AS page, most AS votes, count(*) AS k FROM v JOIN b USING (document, ord) WHERE votes = most GROUP BY document, ord, most) "
    "SELECT document, ord, page, votes, votes >= 3 AND votes::DOUBLE / n >= 0.12 AND k = 1 AS accepted FROM t JOIN n USING (document, ord)",
)
def page_resolve(spark, sf_dir):
    """Every line of every document, sought among the documents of its source as pages."""
    frags = S.chunks(spark, sf_dir).select("document", "ord", F.col("section").alias("doc_key"), "text")
    pages = S.table(spark, sf_dir, "documents").select(F.col("source").alias("doc_key"), F.col("doc_id").alias("page"), "text")
    return R.page_votes(frags, pages, ["document", "ord"])


@query("shingle_count", f"WITH d AS (SELECT doc_id, text FROM documents), {_triples('s', 'doc_id', 'text', 'd')} SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id")
def shingle_count(spark, sf_dir):
    n = F.size(T.shingles(T.pdf_words("text"))).cast("bigint")
    return S.table(spark, sf_dir, "documents").select("doc_id", n.alias("n")).where("n > 0")


@query("prepared_queries")
def prepared_queries(spark, sf_dir):
    """Corpus queries as they are searched for: instance numbers out, catalog titles in."""
    topics = S.catalog(spark, sf_dir).select("id", "title", F.concat(F.lit("topic "), F.col("parent").cast("string")).alias("section"))
    return R.prepared(S.corpus(spark, sf_dir), topics)
