"""Roots and tokens are gathered where chunks are read, and texts are composed by the library alone."""

import unicodedata

from pyspark.sql import functions as F

from tidemill import registry
from tidemill.functions import text as T
from tidemill.operators import retrieval, topk

CHUNKS = [(1, "s", 0, "Alphabet soup, alphabetical soup 12345678"), (1, "договор", 1, "Перезаключили договоры на портале поставщиков"), (2, "s", 0, "soup"), (3, "s", 0, "nothing asked for")]


def tables(spark):
    queries = spark.createDataFrame([(1, "alphabet soup"), (2, "договор"), (3, "портал поставщиков")], "qid bigint, query string")
    return queries, spark.createDataFrame(CHUNKS, "document bigint, section string, ord int, text string")


def test_a_tokens_root_is_that_of_its_stem(spark):
    words = ["alphabetical", "soup", "a1", "договорами", "перезаключили", "искать", "порталами", "сайт", "abcяdefgh", "12345678", "заявка", "кс"]
    rows = spark.createDataFrame([(w,) for w in words], "t string").select("t", retrieval.term_of("t").alias("a"), retrieval.folded_root(T.stem("t")).alias("b"))
    assert all(r.a == r.b for r in rows.collect()) and all(not k.isascii() for k in retrieval.ALIASES)


def test_no_words_vocabulary_or_blocks_are_written(spark, monkeypatch):
    names, keep = [], retrieval.stored
    for module in (retrieval, topk):
        monkeypatch.setattr(module, "stored", lambda df, name: names.append((name, df)) or keep(df, name))
    found = retrieval.lexical_top(*tables(spark), 3, 0.0)
    assert not {"words", "vocabulary", "blocks"} & {n for n, _ in names}
    assert dict(names)["roots"]._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(document") == 1
    got = {(r.qid, r.document, r.ord): r.score for r in found.collect()}
    # supplier is no evidence in the product's name, so the last is a hit without its subject
    assert got == {(1, 1, 0): 5.0, (1, 2, 0): 2.5, (2, 1, 1): 5.0, (3, 1, 1): 0.0}


def test_tokens_are_counted_without_a_second_shuffle(spark, monkeypatch):
    names, keep = [], retrieval.stored
    monkeypatch.setattr(retrieval, "stored", lambda df, name: names.append((name, df)) or keep(df, name))
    retrieval.bm25_index(*tables(spark))
    plan = dict(names)["counted"]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(document") == 1 and "REPARTITION_BY_NUM" in plan


def test_few_hits_are_sent_to_the_texts(spark):
    plan = registry.queries()["extractive_answer"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_texts_are_composed(spark):
    texts = ["plain", "", None, "été", "йод ё", "한", "Å Ω יִ क़", "naïve — «да»"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", T.composed("t").alias("c"))
    assert "RLIKE" not in rows._jdf.queryExecution().optimizedPlan().toString()
    assert {r.k: r.c for r in rows.collect()} == {k: t and unicodedata.normalize("NFC", t) for k, t in enumerate(texts)}
