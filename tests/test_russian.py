"""The Russian stemmer on words worked by the published rules, in both engines, and as the terms of a search."""

import duckdb
import pytest

from tidemill.functions import russian
from tidemill.operators import retrieval

CASES = """в в, вавиловка вавиловк, вагнера вагнер, вагон вагон, вагона вагон, вагоне вагон, вагонов вагон, вагоном вагон, вагоны вагон, важная важн, важнее важн,
важнейшие важн, важнейшими важн, важничал важнича, важно важн, важного важн, важности важност, важность важност, важностью важност, важную важн, папа пап,
пакостей пакост, палата палат, пальцами пальц, пальто пальт, читавши чита, построивши постро, улыбаясь улыб, учиться уч, бегающий бега, рисующая рис,
сделанный сдела, длинный длин, летний летн, совершенно совершен, готовность готовн, гость гост, вст вст, сильнейший сильн, пошли пошл, открыть откр, любовь любов, подписание подписан, подписания подписан"""


@pytest.fixture(scope="module")
def cases():
    return [tuple(c.split()) for c in CASES.split(",")]


def test_words_by_the_rules(spark, cases):
    got = spark.createDataFrame(cases, "word string, stem string").select("word", russian.russian_stem("word").alias("mine"))
    assert [tuple(r) for r in got.collect()] == cases


def test_duckdb_gives_the_same(cases):
    db = duckdb.connect()
    db.execute("CREATE TABLE w (word VARCHAR)")
    db.executemany("INSERT INTO w VALUES (?)", [(w,) for w, _ in cases])
    assert dict(db.execute(f"SELECT word, {russian.russian_stem_sql('word')} FROM w").fetchall()) == dict(cases)


def test_nulls_and_other_scripts(spark):
    got = spark.createDataFrame([(None,), ("",), ("vagonami",), ("2024",)], "word string").select(russian.russian_stem("word"))
    assert [r[0] for r in got.collect()] == [None, "", "vagonami", "2024"]


def test_search_meets_other_forms_of_a_word(spark):
    chunks = spark.createDataFrame([(1, 0, "s", "Подписание контрактов поставщиками"), (2, 0, "s", "Вход на портал"), (3, 0, "s", "")], "document bigint, ord int, section string, text string")
    queries = spark.createDataFrame([(7, "подписания контракта"), (8, "входом")], "qid bigint, query string")
    found = lambda terms_of: sorted((r.qid, r.document) for r in retrieval.bm25_top(queries, chunks, 5, terms_of).collect())
    assert found(russian.russian_terms) == [(7, 1), (8, 2)] and found(None) == []
