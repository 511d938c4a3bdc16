"""Cards take their sources once, fork only where a card can come of it, and meet the catalog as numbers."""

from pyspark.sql import functions as F

from tidemill.functions import text as T
from tidemill.operators import cards

CATALOG = [(0, "Консультация", ""), (1, "Новый договор", "1.1 НОВЫЙ ДОГОВОР"), (2, "Договор аренды", ""), (3, "договор", "1.2 Договор"), (4, "Рисунок договора", "")] + [(n, f"Договор вида{n}", "") for n in range(5, 13)]


def tables(spark):
    q = spark.createDataFrame([(1, "договор"), (2, "Как подписать договор поставки"), (3, "Как подписать договор аренды"), (4, None)], "qid bigint, question string")
    catalog = spark.createDataFrame(CATALOG, "n int, title string, section string")
    evidence = [(1, 1, "2.1 Договор"), (1, 2, "2.2 Подписание")] + [(2, p, f"2.{p} Подписание акта{p}") for p in range(9)] + [(3, 1, "2.1 Отзыв"), (3, 2, "Без номера")]
    return q, spark.createDataFrame(evidence, "qid bigint, pos int, section string"), catalog


def test_only_questions_whose_card_can_fork_meet_the_catalog(spark, monkeypatch):
    asked, plain = [], cards.catalog_forks
    monkeypatch.setattr(cards, "catalog_forks", lambda q, c: asked.extend(r.qid for r in q.collect()) or plain(q, c))
    q, evidence, catalog = tables(spark)
    out = {r.qid: r for r in cards.decisions(q, evidence, catalog).collect()}
    # 1 is short, 3 has one procedure; 2 looks something up and has procedures, and a null has no words
    assert {1, 3} <= set(asked) <= {1, 3, 4}
    forks = {r.qid: r.labels for r in plain(q, catalog).collect()}
    assert set(forks) == {1, 2, 3} and out[1].options == forks[1] and out[3].options == forks[3]
    assert out[2].options == [f"Подписание акта{p}" for p in range(6)] and out[4].options is None


def test_a_label_is_offered_once_without_the_question_itself(spark):
    q, _, catalog = tables(spark)
    forks = {r.qid: r.labels for r in cards.catalog_forks(q, catalog).collect()}
    assert forks[1] == ["Новый договор", "Договор аренды"] + [f"Договор вида{n}" for n in range(5, 9)]
    # all stems of topic 2 are in question 3, so it says no more
    assert forks[3] == ["Новый договор"] + [f"Договор вида{n}" for n in range(5, 10)]


def test_no_texts_go_with_pairs(spark):
    q, _, catalog = tables(spark)
    plan = cards.catalog_forks(q, catalog)._jdf.queryExecution().optimizedPlan().toString()
    pairs = [line for line in plan.split("\n") if "Aggregate" in line and "count(1)" in line]
    assert len(pairs) == 1 and "question" not in pairs[0] and "label" not in pairs[0] and "array_except(stems" not in plan


def test_sources_are_read_once(spark, monkeypatch):
    read, plain = [], cards.stored
    monkeypatch.setattr(cards, "stored", lambda df, name: read.append(df) or plain(df, name))
    q, evidence, catalog = tables(spark)
    evidence.createOrReplaceTempView("card_evidence")
    cards.decisions(q, spark.table("card_evidence").withColumn("pos", F.col("pos") + 41), catalog)
    assert read[0]._jdf.queryExecution().optimizedPlan().toString().count("+ 41)") == 1


def test_stems_of_ascii_tokens_are_the_tokens(spark):
    rows = spark.createDataFrame([(t, s) for t, s in [("ordering", "ordering"), ("abcde12", "abcde12"), ("договорами", "договор"), ("abcами", "abc"), ("orders", "orders"), ("акта", "акта"), (None, None)]], "t string, s string")
    assert all(r.got == r.s for r in rows.withColumn("got", T.stem("t")).collect())
    plan = rows.select(T.stem("t"))._jdf.queryExecution().optimizedPlan().toString()
    assert "octet_length" in plan
