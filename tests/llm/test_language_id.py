"""Language id: held-out accuracy through the query, the learner against a plain double loop, and odd inputs."""

import math

import numpy as np
from pyspark.sql import functions as F

from tidemill.llm import language_id
from tidemill.llm.queries import op11_language_id

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy_and_calibration(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = op11_language_id(spark, SF)
    assert out.columns == ["doc_id", "held_out", "lang_pred", "score"] and dict(out.dtypes)["score"] == "double"
    rows = out.join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r["held_out"]]
    right = [r["lang_pred"] == r["lang"] for r in held]
    assert len(held) > 200 and sum(right) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert abs(np.mean([r["score"] for r in held]) - np.mean(right)) < 0.03


def test_labels_of_the_held_out_fold_change_nothing(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs.withColumn("lang", F.when(language_id.fold() == 2, F.lit("xx")).otherwise(F.col("lang"))).write.parquet(f"{tmp_path}/documents.parquet")
    mine, other = (sorted(map(tuple, op11_language_id(spark, d).collect())) for d in ("/root/testdata/sf0.001", str(tmp_path)))
    assert mine == other and all(r[2] != "xx" for r in mine)


def test_learner_follows_the_plain_rule():
    rng = np.random.default_rng(2)
    rows = [(np.sort(rng.choice(30, 5, replace=False)), rng.random(5), int(rng.integers(3))) for _ in range(40)]
    z, n = np.zeros((30, 3)), np.zeros((30, 3))
    language_id.follow(z, n, rows)
    pz, pn = [[0.0] * 3 for _ in range(30)], [[0.0] * 3 for _ in range(30)]
    a, b, l1, l2 = language_id.ALPHA, language_id.BETA, language_id.L1, language_id.L2
    for at, x, lang in rows:
        w = {i: [0.0 if abs(pz[i][c]) <= l1 else -(pz[i][c] - math.copysign(l1, pz[i][c])) / ((b + math.sqrt(pn[i][c])) / a + l2) for c in range(3)] for i in at}
        m = [sum(v * w[i][c] for i, v in zip(at, x, strict=True)) for c in range(3)]
        p = [math.exp(k) / sum(map(math.exp, m)) for k in m]
        for i, v in zip(at, x, strict=True):
            for c in range(3):
                g = v * (p[c] - (c == lang))
                s = (math.sqrt(pn[i][c] + g * g) - math.sqrt(pn[i][c])) / a
                pz[i][c] += g - s * w[i][c]
                pn[i][c] += g * g
    assert np.allclose(z, pz) and np.allclose(n, pn)
    assert (language_id.weights(np.array([5e-5, -5e-5]), np.array([1.0, 1.0])) == 0).all()


def test_temperature_undoes_a_scale():
    rng = np.random.default_rng(4)
    margins = rng.normal(0, 2, (4000, 4))
    p = np.exp(margins) / np.exp(margins).sum(1, keepdims=True)
    truth = np.array([rng.choice(4, p=q) for q in p])
    assert 2.6 < language_id.temperature(3 * margins, truth) < 3.4
    assert language_id.temperature(np.empty((0, 4)), np.empty(0, np.int64)) == 1.0


def test_counts_are_of_whole_texts():
    plain = {}
    text = "Ab, c"
    for n in language_id.ORDERS:
        for k in range(len(" ab c ") - n + 1):
            plain[" ab c "[k : k + n]] = plain.get(" ab c "[k : k + n], 0) + 1
    assert language_id.ngram_counts(text).sum() == sum(plain.values())
    long = "wörter über " * 200_000
    assert language_id.ngram_counts(long).sum() == 3 * (len(long) + 1) - 3
    assert language_id.ngram_counts("12 34 !") is None and language_id.ngram_counts(None) is None


def test_odd_rows(spark):
    schema = "doc_id bigint, text string, lang string, lang_pred string, place bigint, apart string"
    few = [(k, t, lang, "own", 5, "x") for k, (t, lang) in enumerate([("the cat and the dog", "en"), ("der Hund und die Katze", "de")] * 20)]
    odd = [(None, "the dog", "en", "", 0, ""), (1, None, "en", "", 0, ""), (2, "", None, "", 0, ""), (3, "123 !?", "de", "", 0, ""), (3, "und die", None, "", 0, ""), (4, "the " * 50_000, "en", "", 0, "")]
    df = spark.createDataFrame(few + odd, schema)
    model = language_id.train(df)
    assert model.langs == ["de", "en"]
    got = language_id.predict(df, model)
    assert set(got.columns) == {"doc_id", "lang", "place", "apart", "lang_pred", "score"}
    rows = got.collect()
    assert len(rows) == len(few + odd)
    assert sum(r["lang_pred"] == "und" and r["score"] == 0 for r in rows) == 3
    assert all(r["lang_pred"] == r["lang"] for r in rows if r["lang_pred"] != "und" and r["lang"])
    none = language_id.train(df.limit(0))
    assert none.langs == [] and {r["lang_pred"] for r in language_id.predict(df, none).collect()} == {"und"}
    assert language_id.predict(df.limit(0), model).collect() == []


def test_rows_to_fit_are_bounded(spark):
    df = spark.createDataFrame([(k, f"the word {k} of", "en") for k in range(3000)] + [(k, f"das wort {k} von", "de") for k in range(40)], "doc_id bigint, text string, lang string")
    model = language_id.train(df, most_rows=200)
    assert model.predict("the word of")[0] == "en" and model.predict("das wort von")[0] == "de"
