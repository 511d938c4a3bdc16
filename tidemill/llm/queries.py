"""The queries ``opN_<name>`` over whole tables, with production parameters, and their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, hnsw, language_id, line_dedup, made_findings, mixing, near_dedup, quality_model, quality_rules, secrets, sharding, token_align, vector_codes
from .shared import kept, table

VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document with the first line of its class, its links and whether it is kept."""
    return line_dedup.line_classes(table(spark, sf_dir, "documents"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one of control strings, formatted and read back."""
    spoken = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", spoken), (-7, 1, "assistant", spoken)], "conv_id bigint, turn bigint, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.read_back(chat.format_chats(chat.events_of(turns)))


def op3_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again: number and digest of its ids, digest of the decoded text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.decode(bpe.encode(docs, vocabulary_path()), vocabulary_path())
    return coded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's counts, the base rules' verdict and that of cross-document line frequency."""
    out = quality_rules.assess(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), *quality_rules.FEATURES, "base_failed", "kept", "removed_words")


def held_out(doc_id: str = "doc_id") -> Column:
    """The fold that labels are never learnt from."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score by the additive model, learnt outside the held-out fold."""
    measured = kept(quality_model.measure(table(spark, sf_dir, "documents")))
    gam = quality_model.train(measured, table(spark, sf_dir, "labels").where(~held_out()))
    out = quality_model.score(measured, gam)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_hnsw_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every fiftieth one, against all."""
    vectors = table(spark, sf_dir, "embeddings")
    found = hnsw.search(hnsw.build_index(vectors, keep=6), vectors.where("vec_id % 50 = 0"), 5)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: set size, component and whether it is kept, at a similarity of 0.85."""
    return near_dedup.near_classes(table(spark, sf_dir, "documents"), percent=85)


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every copy of the mixture in its shuffled order, by the default weights."""
    out = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source"))
    return out.select("doc_id", "source", F.round("_rate", 6).alias("rate"), F.col("_copies").cast("bigint").alias("n_copies"), F.col("_copy").alias("copy_no"), F.col("_order").alias("order_key"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate of every document with the forest's verdict."""
    lexicon = secrets.lexicon(secrets.read_words(vocabulary_path()))
    model = secrets.train(made_findings.labelled_findings(spark, list(lexicon.words)), lexicon)
    return secrets.scan(table(spark, sf_dir, "documents"), model, lexicon)


def op10_lpt_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of nearly equal bytes, equal texts together."""
    out = sharding.shard(table(spark, sf_dir, "documents"), 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learnt outside the fold of remainder 2; rows of a null id are in no fold and teach nothing."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.train(docs.where(language_id.fold() != 2))
    out = language_id.predict(docs.select("doc_id", F.coalesce(language_id.fold() == 2, F.lit(False)).alias("held_out"), "text"), model)
    return out.select("doc_id", "held_out", "lang_pred", "score")


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's groups and links between the byte-level and the piece tokenizer, with its links' corpus-wide counts."""
    return token_align.align(table(spark, sf_dir, "documents"), vocabulary_path(), vocabulary_path("piece_bpe_32k.model"))[0]


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's code in 16 codebooks of 64 entries, its error and that of its label."""
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_chat_formatting, op3_bpe_encoding, op4_quality_rules, op5_quality_classifier, op6_hnsw_search, op7_minhash_near_dedup, op8_source_mixing, op9_secret_scan, op10_lpt_sharding, op11_language_id, op12_tokenizer_alignment, op13_vector_codes)}

ORACLE_SQL: dict[str, str] = {"op8_source_mixing": mixing.mixture_sql(), "op13_vector_codes": vector_codes.codes_sql()}
