"""Options and cards, and the stand-ins of models."""

from pyspark.sql import functions as F

from tidemill import plugins
from tidemill.operators import clarify as C


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("out")).collect()[0].out


def test_options(spark):
    x = F.col("x")
    assert one(spark, C.short_option(x, ["и", "для"]), x="2.3.1. <b>создание</b>  заявки  для и") == "Создание заявки"
    assert one(spark, C.short_option(x, []), x="Рисунок 4 — «вид карточки».") == "Вид карточки"
    assert len(one(spark, C.short_option(x, []), x="слово " * 40)) <= 100
    assert one(spark, C.section_family(x), x=" 3.12.4 Заголовок") == "3.12" and one(spark, C.section_family(x), x="7 Т") == "7" and one(spark, C.section_family(x), x="Т") == ""
    usable = lambda s: one(spark, C.usable_option(x, F.lit("тема")), x=s)
    assert usable("Подпись договора") and not usable("Тема") and not usable("отчёт 2020 года") and not usable("акт №") and not usable("«акт") and not usable("12")
    rows = spark.createDataFrame([(1, 2, "A"), (1, 1, "a"), (1, 3, "b"), (2, 1, "c")], "k int, o int, label string")
    assert sorted(map(tuple, C.options(rows, ["k"], "o", "label").collect())) == [(1, 1, "a", 1), (1, 3, "b", 2), (2, 1, "c", 1)]
    labels = F.array(F.lit("Подписание договора"), F.lit("Подписание акта"))
    assert one(spark, C.selects_one(x, labels), x="подписание по договору") and not one(spark, C.selects_one(x, labels), x="подписание договора")
    assert one(spark, C.valid_options(F.array(x, F.lit("b"))), x="a") and not one(spark, C.valid_options(F.array(x, F.lit("A"))), x="a")
    assert one(spark, C.is_confirm_wizard(F.array(x, F.lit("Отменить"))), x="Подтвердить")
    assert "машиночитаем" in one(spark, C.expanded_stems(x), x="где мчд")


def test_requests_and_contacts(spark):
    x = F.col("x")
    assert one(spark, C.as_user_message(x), x="«Пользователь спрашивает: вопрос: как подписать»") == "Как подписать"
    assert one(spark, C.asks_personal_fact(x), x="почему я заблокирован") and not one(spark, C.asks_personal_fact(x), x="договор")
    assert spark.range(1).select(*C.subtopic(F.lit("Оферты / как создать"))).collect()[0][:] == ("Оферты", "как создать")
    assert [r.text for r in C.variants(spark.createDataFrame([("x",)], "i string"), "i", ["Как %s", "%s?"]).orderBy("variant").collect()] == ["Как x", "x?"]
    ok = lambda a, b, c: one(spark, C.valid_contact(F.col("a"), F.col("b"), F.col("c")), a=a, b=b, c=c)
    assert ok("1234567890", " n ", "a@b.cd") and not ok("12345678901", "n", "a@b.cd") and not ok("1234567890", " ", "a@b.cd") and not ok("1234567890", "n", "a@b") and not ok(None, "n", "a@b.cd")
    assert one(spark, C.safe_source_path(x), x="/staticfiles/a%20b.pdf#page=3") and not one(spark, C.safe_source_path(x), x="/staticfiles/../a.pdf") and not one(spark, C.safe_source_path(x), x="//x/a.pdf")


def test_stand_ins(spark):
    rows = spark.createDataFrame([(1, "red fox"), (2, None), (3, "red fox")], "id bigint, text string")
    got = {r.id: r.embedding for r in plugins.embedded(rows, "text", plugins.HashEmbedder(8), batch=1).collect()}
    assert got[1] == got[3] and got[2] is None and abs(sum(x * x for x in got[1]) - 1) < 1e-9
    hits = spark.createDataFrame([(1, "red fox", "a red dog"), (1, "red fox", "the red fox")], "qid bigint, query string, passage string")
    assert {r.passage: r.rerank for r in plugins.reranked(hits, plugins.OverlapReranker()).collect()} == {"a red dog": 0.5, "the red fox": 1.0}
    out = plugins.completed(rows, "text", plugins.EchoCompleter())
    assert {r.id: r.completion for r in out.collect()} == {1: "red fox", 2: None, 3: "red fox"}


def test_table_retriever(spark):
    chunks = spark.createDataFrame([(1, "вход", k, t) for k, t in enumerate(["договор поставки подписать", "акт сверки", "новый акт"])] + [(2, "прочее", 0, "пусто совсем")], "document bigint, section string, ord int, text string")
    r = plugins.TableRetriever(chunks)
    found = r.find(spark.createDataFrame([(1, "подписать договор"), (2, "нету")], "qid bigint, query string"), 2).collect()
    assert [(x.qid, x.document, x.ord, x.rank) for x in found if x.qid == 1][0] == (1, 1, 0, 1)
    on = r.read_section(chunks.where("document = 1 and ord = 1"), 5).orderBy("rank").collect()
    assert [(x.ord, x.rank) for x in on] == [(1, 1), (2, 2)]
