from tidemill import registry


def test_a_document_with_a_word_twice_is_no_difference_of_sets(spark, tmp_path):
    rows = [(1, "token and token", 4000), (2, "token token", 10), (3, "none", 4000), (4, "token", 4000)]
    spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    found = registry.queries()["set_ops_hits"](spark, str(tmp_path))
    assert {r.kind: r.n for r in found.collect()} == {"both": 2, "either": 4, "first": 1}
