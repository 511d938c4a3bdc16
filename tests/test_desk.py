"""The store, cards, tool shell, keys, tables and pieces on small cases, against plain versions where there is a fold."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from tidemill.functions import markdown
from tidemill.operators import answers, cards, clarify, ingest, store, toolshell
from tidemill.sources import formats

ID = "65920080aaaaaaaaaaaaaaa{}"


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values) or "x string"
    return spark.createDataFrame([tuple(values.values()) or ("",)], schema).select(column.alias("out")).collect()[0].out


def test_store(spark, tmp_path):
    s = store.ParquetStore(spark, f"{tmp_path}/dialogs")
    assert s.list().count() == 0
    assert s.create([ID.format(1), ID.format(2), "bad"]).count() == 2 and s.create([ID.format(1)]).count() == 1
    write = lambda i, expected, closed: spark.createDataFrame([(ID.format(i), expected, "x", closed, "body", "sum", "top")], "id string, expected bigint, status string, closed boolean, body string, summary string, topic string")
    assert s.save(write(1, 0, False)) == 1
    with pytest.raises(store.Conflict):
        s.save(write(1, 0, False))
    row = s.get(ID.format(1)).first()
    assert (row.revision, row.summary, row.closed) == (1, "sum", False)
    s.save(write(1, 1, True))
    row = s.get(ID.format(1)).first()
    assert (row.revision, row.summary, row.closed) == (2, None, True) and [r.id for r in s.pending().collect()] == [ID.format(1)]
    deltas = lambda i, r: spark.createDataFrame([(ID.format(i), r, "s2", "t2")], "id string, revision bigint, summary string, topic string")
    assert s.save_derived(deltas(1, 1)) == 0 and s.save_derived(deltas(2, 0)) == 0 and s.save_derived(deltas(1, 2)) == 1
    assert s.get(ID.format(1)).first().summary == "s2" and s.get(ID.format(1)).first().updated_at == row.updated_at
    assert s.pending().count() == 0 and s.get("nonsense").count() == 0
    made = store.on_demand(s, ID.format(2), lambda now: now.select("id", "revision", F.lit("a").alias("summary"), F.lit("b").alias("topic"))).first()
    assert (made.summary, made.topic) == ("a", "b") and s.get(ID.format(2)).first().summary is None
    assert store.on_demand(s, ID.format(1), lambda now: 1 / 0).first().summary == "s2"
    assert s.delete(ID.format(1)) and not s.delete(ID.format(1)) and s.delete_all() == 1 and s.list().count() == 0
    with pytest.raises(ValueError, match="limit"):
        s.list(0)


def test_on_demand_gives_up_after_its_tries(spark):
    class Moving:
        tries = 0

        def get(self, _):
            return spark.createDataFrame([("a", 1, True, None, None)], "id string, revision bigint, closed boolean, summary string, topic string")

        def save_derived(self, _):
            self.tries += 1
            return 0

    s = Moving()
    with pytest.raises(store.Conflict):
        store.on_demand(s, "a", lambda now: now)
    assert s.tries == 3


def test_rules_of_cards(spark):
    x = F.col("x")
    assert one(spark, cards.asks_for_term(x), x="Какой срок модерации?") and one(spark, cards.states_duration(x), x="до 3 рабочих дней") and not one(spark, cards.states_duration(x), x="скоро")
    assert one(spark, cards.named_mutation(x), x="Удалить аккаунт") and one(spark, cards.tool_noise(x), x="Этот запрос уже выполнен.")
    assert one(spark, cards.requests_clarification(x), x="Уточните, какой именно вид договора") and not one(spark, cards.requests_clarification(x), x="> Уточните, какой вид\nВот ответ.")
    assert one(spark, cards.harvests(x), x="Пришлите ваш ИНН") and not one(spark, cards.requests_clarification(x), x="Уточните тип. Пришлите номер")
    labels = lambda *xs: F.array(*map(F.lit, xs))
    assert one(spark, cards.echoes(x, labels("Договор поставки")), x="Договор поставки подписать") and not one(spark, cards.echoes(x, labels("Договор поставки")), x="Договор")
    assert one(spark, cards.is_type_fork(x, labels("Новый договор", "Старый акт")), x="Какой вариант имеется в виду?")
    for bad in ("Уточните?", "Без вопроса", "Ш" * 80 + "?"):
        assert not one(spark, cards.is_type_fork(x, labels("Новый договор", "Старый акт")), x=bad)
    assert one(spark, cards.is_form(x, labels("Подтвердить", "Отменить")), x="Что дальше по заявке?")
    assert one(spark, cards.is_help_menu(x, labels(*cards.MENU[1])), x=cards.MENU[0]) and one(spark, cards.is_generic_card(labels("Ошибка", "Как пройти", "Статус заявки")))
    assert one(spark, cards.usable_option(x, F.lit("тема")), x="Новый договор") and not any(one(spark, cards.usable_option(x, F.lit("тема")), x=bad) for bad in ("При выборе типа", "Договор на", "Кнопка входа", "тема", "После входа", "акт"))
    assert one(spark, clarify.section_label(x, F.lit("Вход")), x="2.1") == "2.1 Вход" and one(spark, clarify.section_label(x, F.lit("Вход")), x="") == "Вход"


def test_card_decisions(spark):
    q = spark.createDataFrame([(1, "договор"), (2, "Как подписать договор поставки"), (3, "помогите"), (4, "оферта"), (5, "Что такое договор"), (6, "эп")], "qid int, question string")
    catalog = spark.createDataFrame([(0, "Консультация", ""), (1, "Новый договор", "1.1 Заключение договора"), (2, "Договор аренды", ""), (3, "Электронная подпись", "3.1 Выпуск электронной подписи")], "n int, title string, section string")
    evidence = spark.createDataFrame([(1, 1, "2.1 Подписание"), (2, 1, "2.1. Подписание акта"), (2, 2, "3.4 Отправка оферты"), (2, 3, "Без номера"), (4, 1, "2.1 Подписание акта"), (4, 2, "2.1 Подписание акта"), (5, 1, "2.1 Отзыв")], "qid int, pos int, section string")
    out = {r.qid: r for r in cards.decisions(q, evidence, catalog).collect()}
    assert out[1].needs_fork and out[1].may_clarify and out[1].card_question == "Что нужно по теме «договор»?" and out[1].options == ["Новый договор", "Заключение договора", "Договор аренды"]
    assert not out[2].needs_fork and out[2].needs_choice and out[2].options == ["Подписание акта", "Отправка оферты"] and out[2].card_question == "Какой вариант имеется в виду?"
    assert out[3].may_clarify and out[3].card_question == cards.MENU[0] and out[3].options == cards.MENU[1]
    assert out[4].needs_fork and out[4].card_question is None and not out[5].may_clarify
    assert out[6].needs_fork and out[6].options == ["Электронная подпись", "Выпуск электронной подписи"] or out[6].options is None


def test_calls_and_replies(spark):
    rows = [(1, 1, "find", '{"q": "a", "n": "2"}'), (1, 2, "find", '{"n":"2","q":"a"}'), (1, 3, "find", "[]"), (1, 4, "find", "[]"), (1, 5, "read", '{"n":"2","q":"a"}'), (2, 6, "find", '{"q": "ё"}')]
    calls = spark.createDataFrame(rows, "d int, at int, name string, arguments string")
    assert sorted((r.at, r.duplicate) for r in toolshell.first_calls(calls, ["d"], "at", "name", "arguments").collect()) == [(1, False), (2, True), (3, False), (4, False), (5, False), (6, False)]
    assert one(spark, toolshell.canonical_arguments(F.col("x")), x='{"b": "ё", "a": "1"}') == '{"a":"1","b":"ё"}'
    allowed = F.array(F.lit("t1"), F.lit("t2"))
    pick = lambda x: one(spark, toolshell.strict_choice(F.col("x"), "topic", allowed, ["reason"]), x=x)
    assert pick('{"topic": "t1", "reason": "r"}') == "t1"
    assert [pick(x) for x in ('{"topic": "t3", "reason": "r"}', '{"topic": "t1"}', '{"topic": "t1", "reason": "r", "x": 1}', "t1", "", None)] == [None] * 6


def test_arguments_by_kind_and_at_any_depth(spark):
    texts = ['{"a":1}', '{"a":"1"}', '{"a":1.0}', '{"b":{"x":1,"y":2}}', '{"b":{"y":2,"x":1}}', '{"a": 1 }', '{"c":[{"q":1,"p":null}]}', '{"c":[{"p":null,"q":1}]}', "nope", None]
    calls = spark.createDataFrame([(1, k, "find", t) for k, t in enumerate(texts)], "d int, at int, name string, arguments string")
    again = [r.at for r in toolshell.first_calls(calls, ["d"], "at", "name", "arguments").orderBy("at").collect() if r.duplicate]
    assert again == [4, 5, 7]
    allowed = F.array(F.lit("1"), F.lit("true"))
    pick = lambda x: one(spark, toolshell.strict_choice(F.col("x"), "topic", allowed), x=x)
    assert [pick(x) for x in ('{"topic":"1"}', '{"topic":1}', '{"topic":true}', '{"topic":"true"}', '{"topic":null}')] == ["1", None, None, "true", None]


def test_merged_search(spark):
    merge = lambda q, s: one(spark, toolshell.merged_search(F.col("q"), F.col("s")), q=q, s=s)
    assert merge("Как войти?", " вход ") == "вход Как войти?"
    assert merge("Вход", "вход") == "вход" and merge(None, "вход") == "вход" and merge("  ", "вход") == "вход"
    assert merge("q" * 496, "abcd") == "q" * 496 and merge("q" * 495, "abcd") == "abcd " + "q" * 495
    assert merge("q", "a") is None and merge("q", "a" * 501) is None and merge("q", None) is None


def test_sections_found_by_document_and_manual_alone(spark):
    topics = spark.createDataFrame([(1, "оферта", "Общее", "", []), (2, "оферта", "Для заказчика", "", ["a.pdf"]), (3, "yml", "Общее", "", ["a.pdf", answers.SUPPLIER_MANUAL])], "id int, title string, parent string, extra string, preferred array<string>")
    manual, other = answers.SUPPLIER_MANUAL, answers.CUSTOMER_MANUAL
    parts = [(k, 0, manual, "Вход для поставщиков", "текст") for k in range(40, 10, -1)] + [(50, 0, manual, "Другое", "текст"), (51, 0, manual, "Пример для поставщиков", "текст"), (52, 0, "a.pdf", "Вход для поставщиков", "x"), (53, 0, other, "Вход для поставщиков", "x")]
    got = [(r.id, r.document, r.score) for r in answers.section_scores(topics, spark.createDataFrame(parts, "document int, ord int, file string, heading string, text string")).orderBy("id", "rank").collect()]
    assert got == [(1, 11, 3.5), (1, 12, 3.5), (3, 11, 5.0), (3, 12, 5.0)]


def plain_budget(texts, most, offset, least=100, cost=60):
    out, used = [], 0
    for k, text in enumerate(texts):
        text = text[offset if k == 0 else 0 :]
        left = most - used - cost - least
        if left < least:
            break
        if len(text) > left:
            cut = text[:left]
            out.append((k, cut.rsplit(" ", 1)[0] if " " in cut else cut, True))
            break
        out.append((k, text, False))
        used += len(text) + cost
    return out


def test_source_budget(spark):
    r = random.Random(2)
    docs = {d: [" ".join("w" * r.randint(1, 9) for _ in range(r.randint(1, 120))) for _ in range(r.randint(1, 7))] for d in range(40)}
    df = spark.createDataFrame([(d, k, t) for d, ts in docs.items() for k, t in enumerate(ts)], "d int, k int, t string")
    for most, offset in ((900, 0), (1500, 7), (150, 0)):
        got = {}
        for row in toolshell.budgeted_sources(df, ["d"], "k", "t", F.lit(60), most, offset).orderBy("d", "k").collect():
            got.setdefault(row.d, []).append((row.k, row.excerpt, row.truncated))
            if row.truncated:
                assert row.next_offset == (offset if row.k == 0 else 0) + len(row.excerpt)
        assert got == {d: want for d, ts in docs.items() if (want := plain_budget(ts, most, offset))}


def plain_history(messages, most, least=4):
    messages = list(messages)
    while sum(m[2] for m in messages) > most and len(messages) > least:
        second, third = messages[1], messages[2]
        if second[0] == "user" and third[0] == "assistant" and not third[1]:
            del messages[1:3]
        elif second[0] != "user":
            del messages[1]
        elif third[1]:
            del messages[2:4]
        else:
            break
    return messages


def test_history_compaction(spark):
    r, rows, want = random.Random(5), [], {}
    for d in range(300):
        ms = []
        for k in range(r.randint(1, 14)):
            role = r.choice(["user", "assistant", "tool"]) if d % 2 else ["system", "user", "assistant"][min(k, 1) + (k > 0 and k % 2 == 0)]
            ms.append((role, role == "assistant" and r.random() < 0.4, r.randint(1, 300), k))
        rows += [(d, k, role, c, n) for role, c, n, k in ms]
        want[d] = [m[3] for m in plain_history(ms, 700)]
    df = spark.createDataFrame(rows, "d int, k int, role string, calls boolean, n int")
    got = {}
    for row in toolshell.compacted(df, "d", "k", "role", F.col("calls"), F.col("n"), 700).orderBy("d", "k").collect():
        got.setdefault(row.d, []).append(row.k)
    assert got == want


def test_keys_descriptions_and_sections(spark):
    none = F.array().cast("array<string>")
    keys = one(spark, answers.derived_keys(F.lit("Подписание УПД"), F.lit("Исполнение  контракта"), F.lit("Вход в кабинет"), F.array(F.lit("как подписать")), F.array(F.lit("портал"), F.lit("акт"))))
    assert keys == ["Подписание УПД", "Исполнение контракта", "исполнение", "контракта", "подписание", "упд", "Вход в кабинет", "вход", "кабинет", "как подписать", "акт", "эцп", "электронная подпись", "сертификат", "электронное исполнение"]
    assert len(one(spark, answers.derived_keys(F.lit("a b"), F.lit("c"), F.lit(None).cast("string"), F.array(*(F.lit(f"key {i}") for i in range(40))), none))) == 24
    said = answers.description(F.col("x"), F.lit("т"), F.lit("р"), F.lit("d.pdf"), F.lit("1 A"), r"^Рисунок")
    long = "Это первое предложение, в котором больше сорока знаков. Кратко. Рисунок 2 показывает то, что пропускают всегда и везде. Второе предложение тоже длиннее сорока знаков всего."
    assert one(spark, said, x=f"Заголовок\n{long}") == "Это первое предложение, в котором больше сорока знаков. Второе предложение тоже длиннее сорока знаков всего."
    assert one(spark, said, x="Заголовок\nкоротко") == "Подтема «т» темы «р» по инструкции «d.pdf», раздел 1 A."
    topics = spark.createDataFrame([(1, "Формат YML", "Прайс", "", []), (2, "Консультация", "Общее", "", []), (3, "Договор", "Для заказчика уполномочен", "акт", ["b.pdf"])], "id int, title string, parent string, extra string, preferred array<string>")
    parts = [
        (1, 0, "x.pdf", "Пример формата YML", "формат yml"), (2, 0, "x.pdf", "Вопросы", "консультация"), (3, 0, "b.pdf", "Договор", "договор"), (4, 0, answers.CUSTOMER_MANUAL, "Акт поставщика", "договор"), (5, 0, "x.pdf", "Консультация", "консультация"),
        (6, 0, answers.SUPPLIER_MANUAL, "Формат поставщика", "yml"), (7, 0, "x.pdf", "Рисунок договора", "договор"),
    ]
    got = {(r.id, r.document): r.score for r in answers.section_scores(topics, spark.createDataFrame(parts, "document int, ord int, file string, heading string, text string"), most=9).collect()}
    assert got == {(2, 5): pytest.approx(5 + 1.6 + 4), (3, 3): pytest.approx(5 + 1.6 + 1.5 + 4), (3, 4): pytest.approx(5 + 1.6 + 2 + 2), (1, 6): pytest.approx(5 + 1.6 + 2 + 1.5)} or (1, 1) not in got


def test_table_repair():
    flat = "Intro\n| A | B | | --- | --- | | 1 | 2 | | 3 | 4 |"
    assert markdown.repaired(flat) == "Intro\n\n| A | B |\n| --- | --- |\n| 1 | 2 |\n| 3 | 4 |"
    assert markdown.repaired("| --- | --- |\n| 1 | 2 |") == "| | |\n| --- | --- |\n| 1 | 2 |\n"
    assert markdown.repaired("x\n| --- | --- |\n| 1 | 2 | 3 |") == "x\n\n| | | |\n| --- | --- | --- |\n| 1 | 2 | 3 |\n"
    for same in ("```\n| A | | --- | --- |\n```", "a | b", "`| A | | --- | --- |`", "", "| A | B |\n| --- | --- |\n| 1 \\| x | 2 |"):
        assert markdown.repaired(same) == same
    assert markdown.repaired("a<br>b<BR />c") == "a b c"


def test_pieces(spark):
    r = random.Random(1)
    for _ in range(200):
        text = "".join(r.choice(["word", "a", "longer" * 3, " ", " ", "\n", "\n\n", "x" * r.choice([1, 500])]) for _ in range(r.randint(0, 200)))
        pieces = ingest.split_text(text)
        assert all(0 < len(p) <= 400 for p in pieces)
        assert sorted(set("".join(pieces)) - {" ", "\n"}) == sorted(set(text) - {" ", "\n"})
        for word in text.split():
            assert len(word) > 400 or any(word in p for p in pieces)
    assert ingest.split_text("a " * 10) == ["a a a a a a a a a a"] and ingest.split_text("") == []
    out = ingest.split_chunks(spark.createDataFrame([(1, None), (2, "x" * 900)], "i int, t string"), ["i"], "t").collect()
    assert [(r.ord, len(r.chunk)) for r in sorted(out)] == [(0, 400), (1, 400), (2, 180)]


def test_ndjson_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("text", "при\nвет"), ("done", None)], "type string, text string")
    formats.write_ndjson(rows, f"{tmp_path}/out")
    lines = [json.loads(r.value) for r in spark.read.text(f"{tmp_path}/out").collect()]
    assert sorted(lines, key=lambda x: x["type"]) == [{"type": "done"}, {"type": "text", "text": "при\nвет"}]
    assert one(spark, clarify.source_link(F.col("x"), F.lit(3)), x="Ц b+*~/1.pdf") == "/staticfiles/%D0%A6%20b%2B%2A~/1.pdf#page=3"
    assert one(spark, F.date_format(store.retry_at(F.lit(dt.datetime(2024, 1, 1))), "HH:mm")) == "00:05"
