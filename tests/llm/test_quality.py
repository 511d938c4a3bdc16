"""Quality rules against a plain count, and the classifier on held-out labels."""

import random
import re
from collections import Counter, defaultdict

import numpy as np

from tidemill.llm import quality_model, quality_rules
from tidemill.llm.words import WordHasher

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, source string"


def counts(text):
    text = text or ""
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if often[w] > 1:
            covered |= set(range(i, i + 8))
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)]


def texts():
    r = random.Random(4)
    word = lambda: r.choice(["le", "the", "wörd", "a|b", "$$$", "x\x1cy", "z\xa0z", "long" * 9])
    out = [None, "", " \n\t", "one\none\n one\n", "a b c d e f g h " * 4, "\x0b\x0c\r\n x"]
    for _ in range(80):
        out.append("".join(word() + r.choice([" ", "\n", "  ", "\t"]) for _ in range(r.randint(1, 90))))
    return out


def test_counts():
    hasher = WordHasher(limit=5)
    for t in texts():
        assert quality_rules.text_counts(t, hasher)[0] == counts(t), t


def test_assess_equals_a_plain_count(spark):
    rows = [(i, (t or "") + ("\nSame  header line" if i % 3 else "") + ("\nrare line" if i == 5 else ""), "h" if i % 4 else "other") for i, t in enumerate(texts())]
    rows += [(900, rows[7][1], rows[7][2]), (900, rows[7][1], rows[7][2]), *((1000 + i, "Copied line of its own.\n" + "word " * 40 + str(i // 12), "third") for i in range(36)), (None, "header only\nSame header line", "h"), (901, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = quality_rules.assess(docs, max_share=0.3, max_docs=4).collect()
    hosts, distinct = defaultdict(lambda: defaultdict(set)), defaultdict(set)
    key = lambda line: " ".join(WORD.findall(line)).lower()
    for i, t, h in rows:
        distinct[h or ""].add((i, t or ""))
        for line in (t or "").split("\n"):
            if WORD.search(line):
                hosts[h or ""][key(line)].add((i, t))
    expected = []
    for i, t, h in rows:
        gone = [line for line in (t or "").split("\n") if WORD.search(line) and len(hosts[h or ""][key(line)]) > max(4, 0.3 * len(distinct[h or ""]))]
        n, *_, repeat = counts(t)
        failed = n < 20 or 100 * repeat > 30 * n
        removed = sum(len(WORD.findall(x)) for x in gone)
        expected.append((i or -1, n, failed, removed, not failed and removed <= 0.5 * n))
    assert sorted((r.id or -1, r.n_words, r.base_failed, r.removed_words, r.kept) for r in out) == sorted(expected)
    kept = quality_rules.apply_rules(docs.selectExpr("*", "1 as kept", "2 as host"), max_share=0.3, max_docs=4)
    assert kept.columns == ["doc_id", "text", "source", "kept", "host"]
    assert Counter(r.doc_id for r in kept.collect()) == Counter(i for i, *_, ok in expected if ok)
    assert all(removed > 40 for i, _, _, removed, _ in expected if i >= 1000)
    assert not any("Same  header line" in r.text for r in kept.where("source = 'h'").collect())
    assert quality_rules.assess(docs.limit(0)).count() == 0


def test_model_learns_interactions_and_constants():
    r = np.random.default_rng(0)
    x = r.random((4000, len(quality_model.NAMES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    gam = quality_model.fit(x[:3000], y[:3000])
    assert ((gam.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.95
    assert 0 < quality_model.fit(x[:0], y[:0]).score(x[:2])[0] < 1
    assert quality_model.fit(x[:50], np.ones(50)).score(x[:3]).min() > 0.9


def test_measure_and_score_cases(spark):
    docs = spark.createDataFrame([(1, "a few plain words here."), (None, None), (2, "")], "doc_id bigint, text string").selectExpr("*", "1 as features")
    m = quality_model.measure(docs)
    gam = quality_model.fit(np.zeros((0, len(quality_model.NAMES))), np.zeros(0))
    rows = quality_model.score(m, gam).collect()
    assert len(rows) == 3 and all(0 <= r.score <= 1 for r in rows)
    assert quality_model.score(m.limit(0), gam).count() == 0


def test_labels_may_be_null_repeated_without_a_document_or_missing(spark):
    docs = spark.createDataFrame([(i, ("plain words of a text. " if i % 2 else "### $$$ *** ") * (3 + i % 7)) for i in range(400)] + [(7, "again"), (None, "x")], "doc_id bigint, text string")
    m = quality_model.measure(docs).cache()
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)] + [(3, None), (3, 1), (None, 1), (9999, 0), (11, 0)], "doc_id bigint, quality int")
    gam = quality_model.train(m, labels)
    scores = {r.doc_id: r.score for r in quality_model.score(m, gam).where("doc_id >= 300").collect()}
    assert all((v > 0.5) == (i % 2 == 1) for i, v in scores.items())
    few = quality_model.train(m, labels, most=40)
    assert len(few.edges[0]) <= 40 and (few.score(np.zeros((1, len(quality_model.NAMES)))) > 0).all()
    assert quality_model.train(m, labels.limit(0)).tables[0].tolist() == [0.0]


def test_held_out_accuracy(spark):
    from tidemill.llm import queries

    sf = "/root/testdata/sf0.01"
    out = queries.op5_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(out) > 40 and sum(r.predicted == r.quality for r in out) / len(out) > 0.93
