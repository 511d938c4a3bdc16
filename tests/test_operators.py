"""Semantics of the support-desk operators on small cases, against plain Python where there is a fold."""

import datetime as dt
import json
import random
import re
import time

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as types

from tidemill.functions import text as T
from tidemill.operators import analytics, answers, audit, autocomplete, clarify, dialogs, ingest, moderation, retrieval
from tidemill.sources import formats
from tidemill.streaming import dialogs as streams


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values) or "x string"
    return spark.createDataFrame([tuple(values.values()) or ("",)], schema).select(column.alias("out")).collect()[0].out


def py_stem(t):
    return next((t[: -len(s)] for s in T.SUFFIXES if t.endswith(s) and len(t) - len(s) >= 3), t) if len(t) > 4 else t


def py_root(t):
    s = py_stem(t)
    return next((s[len(p) :] for p in T.ROOT_PREFIXES if s.startswith(p) and len(s) - len(p) >= 5), s)[:6]


def test_stems_and_roots_follow_the_listed_rules(spark):
    r = random.Random(0)
    words = ["".join(r.choice("аеиоуыьямтвлгохпрзд") for _ in range(r.randint(1, 14))) for _ in range(4000)] + ["закупочные", "переподписание", "выгрузками", "портал"]
    rows = spark.createDataFrame([(w,) for w in words], "t string").select("t", T.stem("t").alias("s"), T.root("t").alias("r")).collect()
    assert all((x.s, x.r) == (py_stem(x.t), py_root(x.t)) for x in rows)


def test_tokens_and_canonical_form(spark):
    assert one(spark, T.tokens("x"), x="Ёлка, ЁЖ-42 café Über") == ["елка", "еж", "42", "caf", "ber"]
    assert one(spark, T.tokens("x"), x=None) == []
    assert one(spark, T.canon("x"), x="  Ёж  \n Кот ") == "еж кот"
    assert one(spark, T.canon("x", map_latin=True), x="Cop@") == "сора"
    assert one(spark, T.significant_stems("x"), x="как подписать 12 договорами и 7б") == ["подписа", "договор", "7б"]


def test_every_character_composes_as_the_standard_says(spark):
    import sys
    import unicodedata

    every = [chr(k) for k in range(1, sys.maxunicode + 1) if not 0xD800 <= k <= 0xDFFF and unicodedata.normalize("NFC", chr(k)) != chr(k)]
    rows = spark.createDataFrame([(t,) for t in every], "t string").select("t", T.composed("t").alias("c")).collect()
    assert len(every) > 1000 and [r.t for r in rows if r.c != unicodedata.normalize("NFC", r.t)] == []


def test_source_text_cleanup(spark):
    raw = "Под-\nпись&nbsp;<b>важна</b> ![x](y) **Рисунок 1 - схема** ( Рисунок 2 ) a<br/>b _kursiv_ snake_case_x .\n\n\n\nend &amp;"
    out = one(spark, T.clean_source_text("x"), x=raw)
    assert out.startswith("Подпись важна") and "Рисунок" not in out and "kursiv snake_case_x." in out and out.endswith("\n\nend &")
    assert one(spark, T.document_key("x"), x="https://a.b/c/%D0%9E_x.PDF?q#p") == "о x"
    assert one(spark, T.sentences("x"), x="Один. Два!  «Три» т.е. четыре? 5 шт.") == ["Один.", "Два!", "«Три» т.е. четыре?", "5 шт."]
    assert one(spark, T.preview("x", 10), x="abcdefgh ijkl") == "abcdefgh…"
    assert one(spark, T.shingles(T.pdf_words("x")), x="a b c a b c") == ["a b c", "b c a", "c a b"]
    assert one(spark, T.shingles(T.pdf_words("x")), x="a b") == []
    assert one(spark, T.composed("x"), x="\u0435\u0308") == "\u0451" and one(spark, T.composed("x"), x=None) is None
    assert one(spark, T.tokens("x"), x="мо\u0438\u0306 \u0438\u0306од cafe\u0301s") == ["мой", "йод", "caf", "s"]
    assert one(spark, T.clean_source_text("x"), x="&#1076; &rarr; &amp;lt; &apos;&hellip;") == "д → &lt; '…"
    assert one(spark, T.clean_pdf_text("x"), x="a\fb \uf0b7 c \u0438\u0306....... d-\ne") == "a\nb c й de"


def closed(spark, rows):
    schema = "id bigint, closed_at timestamp, reason string, status string, line string, rating string, topic string, subtopic string, summary_current boolean, classification_current boolean, remaining_questions boolean"
    return spark.createDataFrame(rows, schema)


def test_analytics_edges(spark):
    day, at = dt.date(2024, 1, 31), dt.datetime(2024, 1, 31, 23, 59, 59)
    rows = closed(spark, [
        (1, at, None, "escalate", "L2", "complete", "t", "s", True, True, True), (2, at, "user_closed", "escalate", "L1", "odd", "", None, True, False, None), (3, at, "specialist_requested", None, None, None, None, None, False, True, True),
        (4, at, "abuse", None, "L1", "partial", "t", "", True, True, False), (5, dt.datetime(2024, 2, 1), None, None, None, None, None, None, True, True, True), (6, None, "abuse", None, None, None, None, None, True, True, True), (7, dt.datetime(2024, 1, 30), None, None, None, None, None, None, False, False, False),
    ])
    assert [tuple(r) for r in analytics.daily(rows, day, 2).orderBy("day").collect()] == [(dt.date(2024, 1, 30), 1, 0), (day, 4, 1)]
    m = analytics.metrics(rows, day, 2).collect()[0]
    assert (m.total_closed, m.analyzed, m.pending, m.classified, m.rated, m.complete_ratings, m.with_remaining_questions) == (5, 2, 3, 2, 2, 1, 1)
    labels = {r.id: r.o for r in rows.select("id", analytics.outcome().alias("o")).collect()}
    assert labels == {1: "Передано в L2", 2: "Закрыто пользователем", 3: "Другое", 4: "Закрыто из-за нарушения", 5: "Другое", 6: "Закрыто из-за нарушения", 7: "Другое"}
    assert [(r.label, r.n) for r in analytics.buckets(rows, analytics.subtopic_label(), 1).collect()] == [("Не определена", 6)]
    with pytest.raises(ValueError):
        analytics.window_of(day, 0)
    plan = analytics.within(spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumnRenamed("ts", "closed_at"), day, 2)._jdf.queryExecution().executedPlan().toString()
    assert "ts" in re.search(r"PushedFilters: \[([^\]]*)", plan)[1]


def test_moderation(spark):
    words = ["редиска"]
    rows = [("a", "Ты редиской назвал, помоги с договором"), ("b", "дуррак"), ("c", "Где договор?"), ("d", "какого черта не работает подпись")]
    df = spark.createDataFrame(rows, "id string, text string")
    found = {r.id: (r.n_terms, r.terms) for r in moderation.scan(df, ["id"], "text", words).collect()}
    assert found == {"a": (1, "редиской"), "b": (1, "дуррак")}
    table = spark.createDataFrame([("Редиска",), ("а",)], "word string")
    assert {r.id: (r.n_terms, r.terms) for r in moderation.scan(df, ["id"], "text", table).collect()} == found
    more = spark.createDataFrame([(w,) for w in ("редиска", "редиской", "нередиска", "наредиска", "реддиска", "диска", "козлами", "мудак", "привет", "дом", "хер")], "t string")
    both = [{r.t: r.flagged for r in moderation.flagged_vocabulary(more, w).collect()} for w in (words, table)]
    assert both[0] == both[1] and both[0]["наредиска"] and not both[0]["дом"]
    rest = {r.id: r.rest for r in moderation.remainders(df, ["id"], "text", words).collect()}
    assert rest == {"a": "Назвал помоги с договором", "b": "", "c": "Где договор", "d": "Не работает подпись"}
    verdicts = [one(spark, moderation.verdict(F.lit(bad), F.lit(x))) for bad, x in ((False, ""), (True, "Где договор"), (True, ""))]
    assert verdicts == ["clean", "mixed", "pure_abuse"]
    assert one(spark, moderation.is_greeting("x"), x="Добрый день!") and not one(spark, moderation.is_greeting("x"), x="Добрый день, где договор")
    assert one(spark, moderation.is_thanks("x"), x="Огромное спасибо вам") and one(spark, moderation.is_smalltalk("x"), x="ну как дела там?")
    assert one(spark, moderation.is_open_help(F.col("x")), x="помогите мне пожалуйста") and not one(spark, moderation.is_open_help(F.col("x")), x="помогите подписать договор")
    assert moderation.lexicon(["# x", "А", " Ёж ", ""]) == ["еж"]


def test_lexical_scores(spark):
    q = spark.createDataFrame([(1, "какие сведения найти про договор"), (2, "найти портал"), (3, "и в на")], "qid bigint, query string")
    c = spark.createDataFrame([(1, 0, "договор поставки", "информация"), (2, 0, "поиск на сайте", "x"), (3, 0, "пусто", "договор")], "document bigint, ord int, text string, section string")
    got = {(r.qid, r.document): r.score for r in retrieval.lexical_top(q, c, 100, None).collect()}
    # query 1: roots of "information" (weight .55) and "contract"; the search verb is dropped
    assert set(got) == {(1, 1), (2, 2)}
    assert got[1, 1] == pytest.approx(2 * 1.0 + 2 * 1 + 1 / len(set(query_terms(spark, "какие сведения найти про договор"))), abs=1e-6)
    assert got[2, 2] == pytest.approx(2 * (0.45 + 0.65) + 1.0)


def query_terms(spark, text):
    return one(spark, retrieval.query_roots("x"), x=text)


def test_page_votes_reject_ties_and_short_matches(spark):
    pages = spark.createDataFrame([("d", 1, "a b c d e f"), ("d", 2, "a b c d e f"), ("d", 3, "q w e r t y u")], "doc_key string, page int, text string")
    frags = spark.createDataFrame([(1, "d", "a b c d e f"), (2, "d", "q w e r t"), (3, "d", "w e r"), (4, "d", "a b")], "fragment bigint, doc_key string, text string")
    got = {r.fragment: (r.page, r.votes, r.accepted) for r in retrieval.page_votes(frags, pages, ["fragment"]).collect()}
    assert got == {1: (1, 4, False), 2: (3, 3, True), 3: (3, 1, False)}


def test_autocomplete(spark):
    corpus = spark.createDataFrame([(0, "подписать договор поставки"), (1, "подписать договор поставка"), (2, "как подписать контракт"), (3, "договор")], "qid bigint, query string")
    inputs = spark.createDataFrame([(1, "договор"), (2, "подпис"), (3, "и"), (4, "нету такого")], "iid bigint, input string")
    scored = autocomplete.ranked(inputs, corpus, autocomplete.postings(corpus))
    got = {}
    for r in autocomplete.diverse(scored, 2).orderBy("iid", "rank").collect():
        got.setdefault(r.iid, []).append(r.qid)
    pools = {}
    for pool in (1, 2):
        for r in autocomplete.diverse(scored, 2, pool).orderBy("iid", "rank").collect():
            pools.setdefault((pool, r.iid), []).append(r.qid)
    assert pools == {(p, i): v for p in (1, 2) for i, v in got.items()}
    assert got == {1: [0], 2: [0, 2]}  # the second starts with the input, the other only holds it


def loop_pack(sizes, items, chars):
    out, n, total, batch = [], 0, 0, 0
    for s in sizes:
        if n and (n >= items or total + s > chars):
            batch, n, total = batch + 1, 0, 0
        n, total = n + 1, total + s
        out.append(batch)
    return out


def test_packing_and_bisection(spark):
    r = random.Random(2)
    sizes = [r.randint(1, 90) for _ in range(60)]
    df = spark.createDataFrame([(dt.date(2024, 1, 1), f"2024-01-01 00:{i:02d}", i, s) for i, s in enumerate(sizes)], "period date, stamp string, id bigint, size bigint")
    packed = audit.pack(df, 5, 200)
    assert [x.batch for x in packed.orderBy("id").collect()] == loop_pack(sizes, 5, 200)
    halves = audit.bisect(packed, F.col("total") > 100).groupBy("batch", "part").agg(F.sum("size").alias("s"), F.count("*").alias("n")).collect()
    assert all(x.s <= 100 or x.n == 1 for x in halves) and sum(x.n for x in halves) == 60


def test_next_run_keeps_the_wall_clock(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 3, 30, 12),), (dt.datetime(2024, 3, 30, 7),)], "at timestamp")
    got = [x.n for x in df.select(audit.next_run(F.col("at"), "09:00", "Europe/Berlin").alias("n")).collect()]
    assert got == [dt.datetime(2024, 3, 31, 7), dt.datetime(2024, 3, 30, 8)]


def test_versions_and_merges(spark):
    v = spark.createDataFrame([(1, 1, "a"), (1, 3, "c"), (1, 2, None)], "id bigint, revision bigint, s string")
    assert [tuple(r) for r in ingest.latest(v, ["id"], "revision").collect()] == [(1, 3, "c")]
    w = spark.createDataFrame([(1, 3), (2, 0), (1, 2), (2, 1)], "id bigint, expected bigint")
    assert sorted(tuple(r) for r in ingest.conflicts(w, ingest.latest(v, ["id"], "revision")).collect()) == [(1, 2), (2, 1)]
    local = spark.createDataFrame([(1, "l", "n"), (2, "draft", ""), (3, "gone", "")], "id bigint, title string, note string")
    remote = spark.createDataFrame([(1, "r", None)], "id bigint, title string, note string")
    assert sorted(tuple(r) for r in ingest.merge_lists(local, remote, F.col("id") == 2).collect()) == [(1, "r", "n"), (2, "draft", "")]


def test_chunks_cover_the_text(spark):
    df = spark.createDataFrame([(1, "x" * 401), (2, "y" * 400), (3, ""), (4, None)], "id bigint, text string")
    got = [(r.id, r.start, len(r.chunk)) for r in ingest.fixed_chunks(df, ["id"], "text").orderBy("id", "start").collect()]
    assert got == [(1, 0, 400), (1, 360, 41), (2, 0, 400)]


def test_pending_cards_and_pairs(spark):
    m = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "card"), (2, 0, "assistant", "card"), (2, 1, "assistant", "done"), (2, 2, "user", "q2")], "conv_id bigint, turn bigint, role string, text string")
    assert [tuple(r) for r in dialogs.pending_cards(m, F.col("text") == "card", F.col("text") == "done").collect()] == [(1, 1)]
    assert sorted(tuple(r) for r in dialogs.question_answer_pairs(m).collect()) == [(1, 0, 1), (2, 2, None)]


UNITS = "Intro one. Second two!\n\n| a | b |\n|---|:-:|\n| 1 | 2 |\nAfter table.\n\nSteps:\n- x\n- y\n\n```\n| no | t |\n|--|--|\n```\nunfinished (text"


def test_reply_units():
    units = answers.reply_units(UNITS)
    assert units[:4] == [("Intro one.", False), ("Second two!", False), ("| a | b |\n|---|:-:|\n| 1 | 2 |", True), ("After table.", False)]
    assert ("Steps:\n- x\n- y", False) in units and not any(t for _, t in units[3:])
    assert answers.cells(r"| a \| b | c |") == [r"a \| b", "c"] and answers.cells("no bars") == [] and answers.cells("    | x |") == []


def test_extractive_answer_keeps_the_budget(spark):
    hits = spark.createDataFrame([(1, 1, "First fact. " + "Long " * 10 + "end. First fact."), (1, 2, "Other fact. Broken"), (2, 1, "no end")], "qid bigint, rank int, text string")
    got = {r.qid: (r.answer, r.cited_ranks) for r in answers.extractive(hits, 40).collect()}
    assert got == {1: ("First fact.\n\nOther fact.", [1, 2])}


@given(st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=5), lambda c: st.lists(c, max_size=3) | st.dictionaries(st.text(max_size=3), c, max_size=3), max_leaves=8), st.integers(0, 60))
def test_partial_json_never_fails_and_ends_whole(value, cut):
    text = json.dumps({"text": "a\"b", "v": value}, ensure_ascii=False)
    assert isinstance(answers.partial_json(text[:cut]), dict)
    assert answers.partial_json(text) == {"text": "a\"b", "v": value}
    assert answers.partial_json('{"text": "hal') == {"text": "hal"}


def events(spark, rows):
    return spark.createDataFrame([(i, s, v) for i, s, v in rows], "id bigint, seq bigint, value string")


def test_event_streams(spark):
    done, tool = '{"type":"done","response":{"reply":"r"}}', '{"type":"tool","tool_call":{"id":"1","name":"n","reason":"r"},"status":"%s"}'
    rows = [
        (1, 0, '{"type":"text","text":"a"}'), (1, 1, ""), (1, 2, '{"type":"text","text":"ab"}\r'), (1, 3, done), (1, 4, '{"type":"text","text":"late"}'), (1, 5, "garbage"),
        (2, 0, '{"type":"text","text":"a"}'), (3, 0, '{"type":"text"'), (3, 1, done), (4, 0, tool % "unknown"), (4, 1, done), (5, 0, tool % "running"), (5, 1, done), (6, 0, '{"type":"error","detail":"x"}'), (6, 1, done), (7, 0, '{"type":"text","text":7}x'), (7, 1, done),
    ]
    got = {r.id: (r.failed, r.text) for r in formats.stream_outcomes(formats.parse_events(events(spark, rows))).collect()}
    assert got == {1: (False, "ab"), 2: (True, "a"), 3: (True, None), 4: (True, None), 5: (False, None), 6: (True, None), 7: (True, None)}


def test_completion_streams(spark):
    d = 'data: {"choices":[{"delta":{"content":"%s"}}]}'
    rows = [(1, 0, d % "he"), (1, 1, ": keepalive"), (1, 2, d % "y"), (1, 3, "data: [DONE]"), (2, 0, d % "cut")]
    assert {r.id: (r.text, r.whole) for r in formats.completion_text(events(spark, rows)).collect()} == {1: ("hey", True), 2: ("cut", False)}


def test_snapshots_are_refused_whole(spark):
    chat = lambda i, **k: {"id": i, "title": "t", "updatedAt": "2024-01-01T00:00:00Z", "messages": [{"id": "m", "role": "user", "content": "c"}]} | k
    good = {"version": 1, "activeChatId": "a", "chats": [chat("a"), chat("b", status="closed", closedAt="2024-01-01T00:00:00Z")]}
    cases = [good, good | {"version": 2}, good | {"activeChatId": "z"}, good | {"chats": [chat("a"), chat("a")]}, good | {"chats": [chat("a", status="closed")]}, good | {"chats": []}]
    rows = spark.createDataFrame([(i, json.dumps(c)) for i, c in enumerate(cases)] + [(9, "{"), (10, None)], "id bigint, value string")
    assert [(r.id, r.chat_id, r.status) for r in formats.read_snapshots(rows).collect()] == [(0, "a", "open"), (0, "b", "closed")]


def test_files(spark, tmp_path):
    schema = types.StructType([types.StructField("a", types.LongType()), types.StructField("b", types.StringType())])
    formats.zstd_parquet(spark.createDataFrame([(1, "x"), (2, ""), (None, "y")], schema), f"{tmp_path}/p")
    good, bad = formats.strict_parquet(spark, f"{tmp_path}/p", schema, {"a set": F.col("a").isNotNull(), "b long": F.length("b") > 0})
    assert [tuple(r) for r in good.collect()] == [(1, "x")] and sorted(r.broken[0] for r in bad.collect()) == ["a set", "b long"]
    with pytest.raises(formats.SchemaMismatch):
        formats.strict_parquet(spark, f"{tmp_path}/p", types.StructType(schema.fields[:1]), {})
    (tmp_path / "w.txt").write_text("# c\nЁлка\nx\n\nелка\n", encoding="utf-8")
    assert [r.word for r in formats.lexicon_lines(spark, f"{tmp_path}/w.txt").collect()] == ["елка"]
    (tmp_path / "c.json").write_text(json.dumps({"topics": [{"id": "1", "title": "t", "keys": ["k"]}]}), encoding="utf-8")
    assert [(r.id, r["keys"], r.path) for r in formats.json_catalog(spark, f"{tmp_path}/c.json").collect()] == [("1", ["k"], None)]
    lines = spark.createDataFrame([("f", i, v) for i, v in enumerate(["[s; f; 1-2]", "A | do", "Q | ask", "", "[t]", "A|x|y"])], "file string, n int, value string")
    assert [(r.header, r.kind, r.text) for r in formats.sectioned_lines(lines, "n").orderBy("n").collect()] == [("s; f; 1-2", "A", "do"), ("s; f; 1-2", "Q", "ask"), ("t", "A", "x|y")]


@given(st.lists(st.sampled_from(["message", "clarify", "specialist", "close", "abuse", "feedback"]), max_size=12))
def test_closed_dialogs_refuse_all_but_feedback(kinds):
    state, log = streams.START, []
    for k in kinds:
        state = streams.step(state, k)
        log.append(state)
    cut = next((i for i, k in enumerate(kinds) if k in streams.CLOSING), len(kinds))
    taken = min(cut + 1, len(kinds)) + sum(k == "feedback" for k in kinds[cut + 1 :])
    assert state[2] == (cut < len(kinds)) and state[3] == taken and state[4] == len(kinds) - taken and state[5] == taken


def test_stream_equals_batch(spark, tmp_path):
    r = random.Random(6)
    rows = [(i % 7, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), i, r.choice(["message", "clarify", "close", "feedback", "abuse"])) for i in range(60)]
    df = spark.createDataFrame(rows, "id bigint, at timestamp, seq bigint, kind string")
    for k in range(3):
        df.where((F.col("seq") >= 20 * k) & (F.col("seq") < 20 * k + 20)).coalesce(1).write.parquet(f"{tmp_path}/t.parquet/part{k}")
    flat = tmp_path / "in.parquet"
    flat.mkdir()
    for k in range(3):
        next((tmp_path / f"t.parquet/part{k}").glob("*.parquet")).rename(flat / f"{k}.parquet")
    got = streams.current(streams.result_of(streams.lifecycle_stream(streams.file_stream(spark, str(flat), 1)), "update"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, streams.lifecycle_batch(df).collect()))


def test_claims_are_taken_once(spark, tmp_path):
    df = spark.createDataFrame([("a", dt.datetime(2024, 1, 1, 9)), ("a", dt.datetime(2024, 1, 1, 10)), ("b", dt.datetime(2024, 1, 1, 9))], "job string, at timestamp")
    df.coalesce(1).write.parquet(f"{tmp_path}/jobs.parquet")
    got = streams.result_of(streams.claims(streams.file_stream(spark, f"{tmp_path}/jobs.parquet"), "job", "at"), "append")
    assert sorted(r.job for r in got.collect()) == ["a", "b"]


def test_patterns_have_no_catastrophic_case(spark):
    began = time.perf_counter()
    assert len(one(spark, T.sentences("x"), x="A. " * 5000 + "B")) == 5001
    for hard in ("а" * 50_000, "(" * 20_000, "- " * 20_000, "как " * 10_000, "спасибо " * 5_000):
        for column in (T.tokens("x"), T.clean_source_text("x"), T.clean_pdf_text("x"), moderation.is_open_help(F.col("x")), moderation.is_capability_question("x"), clarify.as_user_message(F.col("x"))):
            one(spark, column, x=hard)
    assert time.perf_counter() - began < 120


def test_significant_roots(spark):
    assert one(spark, T.significant_roots("x"), x="Подписали договорами 12 УПД и лес перезаключение") == ["подпис", "догово", "упд", "заключ"]


def test_follow_ups(spark):
    rows = [(1, 0, "user", "Как подписать договор?"), (1, 1, "assistant", "Так."), (1, 2, "user", "Спасибо, добрый день"), (1, 3, "user", "привет"), (1, 4, "user", "помогите"), (1, 5, "user", "А где это найти?"), (1, 6, "user", "этонет"), (2, 0, "user", "Это что"), (1, 7, "user", "Не помогло")]
    got = {(r.conv_id, r.turn): r.query for r in dialogs.follow_up_queries(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")).collect()}
    assert got == {
        (1, 0): "Как подписать договор?", (1, 2): "Спасибо, добрый день", (1, 5): "Спасибо, добрый день\nА где это найти?", (1, 6): "этонет", (2, 0): "Это что",
    }


def test_preferred_rephrase(spark):
    pick = lambda rest, said: one(spark, moderation.preferred_rephrase(F.lit(rest), F.lit(said).cast("string"), ["редиска"]))
    assert pick("Где договор", "договор где") == "Договор где" and pick("Где договор", "где мой договор") == "Где договор"
    assert pick("Где договор", "редиска") == "Где договор" and pick("", "скажи") == "скажи" and pick("", None) == "" and pick("X", None) == "X"


def test_prepared_queries(spark):
    q = spark.createDataFrame([(1, "Новый договор № 123456"), (2, "акт сверки и подписи где"), (3, "подписи договор"), (4, "№ 7")], "qid bigint, query string")
    c = spark.createDataFrame([(1, "новый договор", "Глава 1"), (2, "акт сверки и подписи", "x"), (3, "подписи договоры поставки", "Глава")], "id bigint, title string, section string")
    got = {r.qid: r.query for r in retrieval.prepared(q, c).collect()}
    assert got == {1: "Глава 1 Новый договор", 2: "акт сверки и подписи где", 3: "подписи договоры поставки подписи договор", 4: "№ 7"}


def test_ids_and_places(spark):
    assert one(spark, ingest.object_id_time(F.col("x")), x="65920080aaaaaaaaaaaaaaaa") == dt.datetime(2024, 1, 1, 0, 0)
    assert one(spark, ingest.object_id_time(F.col("x")), x="zz") is None
    m = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "b")], "id int, pos int, role string, text string")
    old = spark.createDataFrame([(1, 0, "user", "a", "n"), (1, 1, "assistant", "b", "n")], "id int, pos int, role string, text string, note string")
    assert sorted((r.pos, r.note) for r in ingest.same_place(m, old, ["id"]).collect()) == [(0, "n"), (1, None)]
