"""Queries of the text kernel over documents, pages and messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import russian
from ..functions import text as T
from ..registry import query
from ..sources import tables as S

_TOKENS = f"tok AS (SELECT t, count(*) AS n FROM (SELECT unnest({T.tokens_sql('text')}) AS t FROM documents) GROUP BY t)"


def token_counts(spark, sf_dir):
    """``t, n``: stems and roots are then taken once a distinct token, after the sum."""
    return S.table(spark, sf_dir, "documents").select(F.explode(T.tokens("text")).alias("t")).groupBy("t").agg(F.count("*").alias("n"))


@query("tokens_per_doc", f"SELECT doc_id, CAST(len({T.tokens_sql('text')}) AS BIGINT) AS n_tokens FROM documents")
def tokens_per_doc(spark, sf_dir):
    return S.table(spark, sf_dir, "documents").select("doc_id", F.size(T.tokens("text")).cast("bigint").alias("n_tokens"))


@query("stem_frequency", f"WITH {_TOKENS} SELECT {T.stem_sql('t')} AS stem, CAST(sum(n) AS BIGINT) AS n FROM tok GROUP BY 1")
def stem_frequency(spark, sf_dir):
    return token_counts(spark, sf_dir).groupBy(T.stem("t").alias("stem")).agg(F.sum("n").alias("n"))


@query("root_frequency", f"WITH {_TOKENS} SELECT {T.root_sql('t')} AS root, CAST(sum(n) AS BIGINT) AS n FROM tok WHERE {T.significant_sql('t')} GROUP BY 1")
def root_frequency(spark, sf_dir):
    return token_counts(spark, sf_dir).where(T.significant(F.col("t"))).groupBy(T.root("t").alias("root")).agg(F.sum("n").alias("n"))


@query("doc_frequency", f"SELECT t, count(*) AS df FROM (SELECT unnest(list_distinct({T.tokens_sql('text')})) AS t FROM documents) GROUP BY t")
def doc_frequency(spark, sf_dir):
    return S.table(spark, sf_dir, "documents").select(F.explode(F.array_distinct(T.tokens("text"))).alias("t")).groupBy("t").agg(F.count("*").alias("df"))


@query("significant_stems", f"WITH {S.MESSAGES} SELECT conv_id, turn, array_to_string({T.significant_stems_sql('text')}, ' ') AS stems FROM messages WHERE role = 'user'")
def significant_stems(spark, sf_dir):
    return S.messages(spark, sf_dir).where("role = 'user'").select("conv_id", "turn", F.array_join(T.significant_stems("text"), " ").alias("stems"))


@query("stopword_filter", f"WITH {_TOKENS} SELECT t, n FROM tok WHERE {T.significant_sql('t')}")
def stopword_filter(spark, sf_dir):
    return token_counts(spark, sf_dir).where(T.significant(F.col("t")))


@query("preview_titles", f"SELECT doc_id, {T.preview_sql('text')} AS preview FROM documents")
def preview_titles(spark, sf_dir):
    return S.table(spark, sf_dir, "documents").select("doc_id", T.preview("text").alias("preview"))


@query("clean_markup")
def clean_markup(spark, sf_dir):
    """Pages as source text; lookaround and back references keep it out of DuckDB."""
    return S.table(spark, sf_dir, "pages").select("page_id", T.clean_source_text("html").alias("text"))


@query("pdf_cleanup")
def pdf_cleanup(spark, sf_dir):
    return S.table(spark, sf_dir, "documents").select("doc_id", T.clean_pdf_text("text").alias("text"))


@query("sentence_units")
def sentence_units(spark, sf_dir):
    rows = S.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.sentences(F.coalesce("text", F.lit("")))).alias("ord", "sentence"))
    return rows.withColumn("complete", T.is_complete_prose("sentence"))


@query("fold_repeats")
def fold_repeats(spark, sf_dir):
    return token_counts(spark, sf_dir).select("t", T.fold_repeats("t").alias("folded"), F.size(T.match_forms(F.col("t"))).alias("n_forms"))


_HOST = r"regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"
_PATH = r"regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"


@query("url_parts", f"SELECT page_id, {_HOST} AS host, {_PATH} AS path FROM pages")
def url_parts(spark, sf_dir):
    return S.table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("host"), F.regexp_extract("url", "^[a-z]+://[^/?#]*([^?#]*)", 1).alias("path"))


@query("doc_key", rf"SELECT page_id, trim(replace(regexp_replace(lower(regexp_extract(regexp_replace({_PATH}, '/+$', ''), '([^/]*)$', 1)), '\.pdf$', ''), '_', ' ')) AS doc_key FROM pages")
def doc_key(spark, sf_dir):
    return S.table(spark, sf_dir, "pages").select("page_id", T.document_key("url").alias("doc_key"))


@query("sha256_dedupe", "SELECT sha256(text) AS text_hash, min(doc_id) AS doc_id, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1")
def sha256_dedupe(spark, sf_dir):
    d = S.table(spark, sf_dir, "documents").where("text is not null")
    return d.groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("text_hash")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))


_CAPITAL = "substring(text, 1, 1) <> lower(substring(text, 1, 1))"


@query("preposition_headings", rf"WITH {S.CHUNKS} SELECT document, ord FROM chunks WHERE length(text) BETWEEN 4 AND 90 AND len(string_split(text, ' ')) <= 8 AND NOT regexp_matches(lower(text), '^(?:in|of|to|for|with|from|on|at|de|en|von|zu|des|la)[ ,.]')")
def preposition_headings(spark, sf_dir):
    c, size = S.chunks(spark, sf_dir), F.length("text")
    first = F.lower("text").rlike("^(?:in|of|to|for|with|from|on|at|de|en|von|zu|des|la)[ ,.]")
    return c.where(size.between(4, 90) & (F.size(F.split("text", " ", -1)) <= 8) & ~first).select("document", "ord")


@query("corpus_profile", f"WITH {S.MESSAGES}, {S.CORPUS} SELECT count(*) AS n, min(length(query)) AS shortest, median(length(query)) AS middle, max(length(query)) AS longest, CAST(sum(strlen(query)) AS BIGINT) AS n_bytes FROM corpus")
def corpus_profile(spark, sf_dir):
    size = F.length("query")
    return S.corpus(spark, sf_dir).agg(F.count("*").alias("n"), F.min(size).cast("bigint").alias("shortest"), F.median(size).alias("middle"), F.max(size).cast("bigint").alias("longest"), F.sum(F.octet_length("query")).alias("n_bytes"))


@query("null_and_distinct_counts", "SELECT count(DISTINCT lang) AS langs, count(DISTINCT source) AS sources, count(DISTINCT text) AS texts, count(*) FILTER (WHERE text IS NULL) AS null_texts FROM documents")
def null_and_distinct_counts(spark, sf_dir):
    d = S.table(spark, sf_dir, "documents")
    return d.agg(F.count_distinct("lang").alias("langs"), F.count_distinct("source").alias("sources"), F.count_distinct(F.sha2(F.col("text").cast("binary"), 256)).alias("texts"), F.count_if(F.col("text").isNull()).alias("null_texts"))


_LATIN, _RUSSIAN = "abcdefghijklmnopqrstuvwxyz", "абсдефгхийклмнопярстувшыуз"


@query("russian_stem_frequency", f"WITH {_TOKENS} SELECT stem, CAST(sum(n) AS BIGINT) AS n FROM (SELECT {russian.russian_stem_sql('w')} AS stem, n FROM (SELECT translate(t, '{_LATIN}', '{_RUSSIAN}') AS w, n FROM tok)) GROUP BY stem")
def russian_stem_frequency(spark, sf_dir):
    """Stems of all tokens, Latin ones written in Russian letters, once a distinct token."""
    words = token_counts(spark, sf_dir).select(F.translate("t", _LATIN, _RUSSIAN).alias("w"), "n")
    return words.groupBy(russian.russian_stem("w").alias("stem")).agg(F.sum("n").alias("n"))
