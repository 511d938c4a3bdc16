from tidemill.plans import moderation


def test_only_listed_tokens_become_rows(spark, tmp_path):
    rows = [(1, "Token, token tokens"), (1, "erste"), (2, "none of them"), (3, None), (4, "tiáne TIANE")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    hits = moderation.lexicon_hits(spark, str(tmp_path))
    assert "Join" not in hits._jdf.queryExecution().executedPlan().toString()
    assert {r.doc_id: r.n_hits for r in hits.collect()} == {1: 3, 4: 1}
