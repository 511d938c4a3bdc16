"""Queries of knowledge ingestion and of versioned storage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ingest as I
from ..registry import query
from ..sources import tables as S


@query("chunk_order", f"WITH {S.CHUNKS} SELECT document, section, ord, CAST(row_number() OVER (PARTITION BY document, section ORDER BY ord) - 1 AS BIGINT) AS section_ord FROM chunks")
def chunk_order(spark, sf_dir):
    return I.assign_order(S.chunks(spark, sf_dir), ["document", "section"], "ord", "section_ord").select("document", "section", "ord", F.col("section_ord").cast("bigint").alias("section_ord"))


@query("chunk_overlap", "SELECT doc_id, CAST(start AS INT) AS start, substring(text, start + 1, 400) AS chunk FROM (SELECT doc_id, text, unnest(generate_series(0, greatest(0, length(text) - 41), 360)) AS start FROM documents WHERE length(text) > 0)")
def chunk_overlap(spark, sf_dir):
    return I.fixed_chunks(S.table(spark, sf_dir, "documents"), ["doc_id"], "text")


_FILL = "f AS (SELECT document, ord, CASE WHEN ord % 3 = 0 THEN substring(text, 1, 12) ELSE '' END AS cell FROM chunks)"


@query("forward_fill", f"WITH {S.CHUNKS}, {_FILL}, g AS (SELECT *, max(CASE WHEN trim(cell) <> '' THEN ord END) OVER (PARTITION BY document ORDER BY ord) AS head FROM f) SELECT g.document, g.ord, h.cell FROM g LEFT JOIN f h ON h.document = g.document AND h.ord = g.head")
def forward_fill(spark, sf_dir):
    cells = S.chunks(spark, sf_dir).select("document", "ord", F.when(F.col("ord") % 3 == 0, F.substring("text", 1, 12)).otherwise("").alias("cell"))
    return I.forward_fill(cells, ["document"], "ord", "cell")


@query("section_bodies", f"WITH {S.CHUNKS}, m AS (SELECT *, length(text) < 60 AS h FROM chunks), s AS (SELECT *, max(CASE WHEN h THEN ord END) OVER (PARTITION BY document ORDER BY ord) AS heading FROM m) SELECT document, heading, string_agg(text, chr(10) ORDER BY ord) AS body, count(*) AS n_lines FROM s WHERE heading IS NOT NULL AND NOT h GROUP BY document, heading HAVING sum(length(text) + 1) - 1 >= 80")
def section_bodies(spark, sf_dir):
    return I.section_bodies(S.chunks(spark, sf_dir), ["document"], "ord", "text", F.length("text") < 60)


_GAPS = "c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY document, ord) AS k FROM chunks) WHERE k = 1), a AS (SELECT document, section, ord AS anchor FROM c)"
_FOUND = "r AS (SELECT c.document, c.section, anchor, ord, CAST(row_number() OVER (PARTITION BY c.document, c.section, anchor ORDER BY ord) AS INT) AS rank FROM c JOIN a ON a.document = c.document AND a.section = c.section AND ord >= anchor)"


def _continued(spark, sf_dir):
    stored = I.stored_chunks(S.chunks(spark, sf_dir))
    return I.continuation(stored, stored, 6)


@query("section_continuation", f"WITH {S.CHUNKS}, {_GAPS}, {_FOUND} SELECT * FROM r WHERE rank <= 6")
def section_continuation(spark, sf_dir):
    return _continued(spark, sf_dir)


@query("contiguous_run", f"WITH {S.CHUNKS}, {_GAPS}, {_FOUND} SELECT * FROM r WHERE rank <= 6 AND ord - anchor = rank - 1")
def contiguous_run(spark, sf_dir):
    return I.contiguous(_continued(spark, sf_dir))


@query("round_robin_corpus", f"WITH {S.CHUNKS}, k AS (SELECT section, ord, lower(text) AS key FROM chunks), o AS (SELECT key, min((ord, section)) AS f FROM k GROUP BY key) SELECT key, struct_extract(f, 1) AS ord, struct_extract(f, 2) AS section FROM o ORDER BY ord, section, key LIMIT 10000")
def round_robin_corpus(spark, sf_dir):
    keyed = S.chunks(spark, sf_dir).select("section", "ord", F.lower("text").alias("key"))
    return I.round_robin(keyed, "section", "ord", "key")


@query("insert_new", "WITH s AS (SELECT DISTINCT sha256(text) AS text_hash FROM documents WHERE source = 'src0') SELECT sha256(text) AS text_hash, min(doc_id) AS id FROM documents WHERE sha256(text) NOT IN (SELECT text_hash FROM s WHERE text_hash IS NOT NULL) GROUP BY 1")
def insert_new(spark, sf_dir):
    """What a load adds to the texts that source src0 has brought before."""
    rows = S.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", F.sha2(F.col("text").cast("binary"), 256).alias("text_hash")).where("text_hash is not null")
    return I.insert_new(rows, rows.where("source = 'src0'"))


@query(
    "table_glossary",
    f"WITH {S.CHUNKS}, r AS (SELECT document, ord, string_split(text, '|') AS c, lag(ord) OVER (PARTITION BY document ORDER BY ord) AS was FROM chunks WHERE contains(text, '|')), "
    "g AS (SELECT document, ord, trim(c[-2]) AS term, trim(c[-1]) AS definition FROM r WHERE was = ord - 1) SELECT * FROM g WHERE term <> '' AND definition <> ''",
)
def table_glossary(spark, sf_dir):
    """Pipe-separated lines as table rows: the last two cells are a term and its definition, under a header row."""
    rows = S.chunks(spark, sf_dir).where("contains(text, '|')").withColumn("cells", F.split("text", r"\|", -1))
    return I.table_items(rows, ["document"], "ord", "cells")


_V = "v AS (SELECT user_id AS id, event_id AS revision, event_type AS status, round(value, 6) AS value FROM events)"


@query("version_current", f"WITH {_V} SELECT id, max(revision) AS revision, arg_max(status, revision) AS status, arg_max(value, revision) AS value FROM v GROUP BY id")
def version_current(spark, sf_dir):
    v = S.table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("revision"), F.col("event_type").alias("status"), F.round("value", 6).alias("value"))
    return I.latest(v, ["id"], "revision")


@query("revision_conflicts", f"WITH {_V}, c AS (SELECT id, max(revision) AS revision FROM v GROUP BY id) SELECT o.c_custkey AS id, CAST(o.c_custkey * 60 AS BIGINT) AS expected FROM customer o LEFT JOIN c ON c.id = o.c_custkey WHERE o.c_custkey * 60 IS DISTINCT FROM coalesce(c.revision, 0)")
def revision_conflicts(spark, sf_dir):
    stored = S.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(F.max("event_id").alias("revision"))
    writes = S.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") * 60).alias("expected"))
    return I.conflicts(writes, stored)


@query("upsert_merge", "WITH l AS (SELECT c_custkey AS id, c_name AS title, c_mktsegment AS note FROM customer WHERE c_acctbal > 0), r AS (SELECT c_custkey AS id, c_name || '!' AS title, CASE WHEN c_custkey % 3 = 0 THEN 'r' END AS note FROM customer WHERE c_mktsegment <> 'BUILDING') SELECT r.id, r.title, coalesce(r.note, l.note) AS note FROM r LEFT JOIN l ON l.id = r.id UNION ALL SELECT id, title, note FROM l WHERE id = 10 AND id NOT IN (SELECT id FROM r)")
def upsert_merge(spark, sf_dir):
    c = S.table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "id")
    local = c.where("c_acctbal > 0").select("id", F.col("c_name").alias("title"), F.col("c_mktsegment").alias("note"))
    remote = c.where("c_mktsegment <> 'BUILDING'").select("id", F.concat("c_name", F.lit("!")).alias("title"), F.when(F.col("id") % 3 == 0, "r").alias("note"))
    return I.merge_lists(local, remote, F.col("id") == 10)


@query("stale_rejected", "SELECT event_id FROM (SELECT event_id, ts, max(ts) OVER (PARTITION BY user_id ORDER BY event_id % 97, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM events) WHERE seen > ts")
def stale_rejected(spark, sf_dir):
    """Snapshots that arrive after a newer one of their dialog; arrival is by event_id % 97."""
    from pyspark.sql import Window

    seen = F.max("ts").over(Window.partitionBy("user_id").orderBy(F.col("event_id") % 97, "event_id").rowsBetween(Window.unboundedPreceding, -1))
    return S.table(spark, sf_dir, "events").withColumn("seen", seen).where("seen > ts").select("event_id")


@query("live_rows", "SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderpriority = '1-URGENT')")
def live_rows(spark, sf_dir):
    gone = S.table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("id"))
    return I.live(S.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), gone)


@query("load_counts", "WITH h AS (SELECT sha256(text) AS h, source FROM documents WHERE text IS NOT NULL), f AS (SELECT h, count(*) AS n FROM h GROUP BY h), s AS (SELECT DISTINCT h FROM h WHERE source = 'src0') SELECT count(*) FILTER (WHERE s.h IS NULL) AS inserted, CAST(sum(n) - count(*) FILTER (WHERE s.h IS NULL) AS BIGINT) AS skipped FROM f LEFT JOIN s ON s.h = f.h")
def load_counts(spark, sf_dir):
    rows = S.table(spark, sf_dir, "documents").where("text is not null").select("source", F.sha2(F.col("text").cast("binary"), 256).alias("text_hash"))
    return I.load_counts(rows, rows.where("source = 'src0'"))
