"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

Training follows the regularised leader (FTRL-proximal) with an elastic-net penalty, in parallel learners whose states are
averaged after every epoch; a temperature fitted on rows kept apart turns margins into probabilities.
"""

from __future__ import annotations

import sys
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import bounded_batches, tidy, written

#: Hashed n-grams, and the orders that are taken.
BUCKETS, ORDERS = 1 << 16, (1, 2, 3)
#: Rows that a model is fitted on at most, an equal number of each language, and languages that it learns at most: the most frequent ones.
MOST_ROWS, MOST_LANGS = 6000, 256
LEARNERS, EPOCHS = 8, 3
#: Step, its damping, and the weights of the L1 and L2 penalties.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-4, 1e-5
#: One row in so many of the fitted ones is kept for the temperature.
KEPT_APART = 5
#: Buckets whose states are averaged together.
SLICE = 512
#: Characters that are hashed at a time.
CHARS = 1 << 20
UNKNOWN = "und"
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_STIR = np.uint64(0xFF51AFD7ED558CCD)


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For every code point its lower-case letter or mark, 0 for all else; and whether it is a letter."""
    kinds = [unicodedata.category(chr(k))[0] for k in range(sys.maxunicode + 1)]
    lower = [ord(x) if kinds[k] in "LM" and len(x := chr(k).lower()) == 1 else k if kinds[k] in "LM" else 0 for k in range(len(kinds))]
    return np.array(lower, np.uint32), np.array([k == "L" for k in kinds])


def ngram_counts(text: str | None) -> np.ndarray | None:
    """Counts of the whole text's hashed n-grams, one a bucket; nothing for a text without a letter.

    Letters are lower-cased with their marks; each run of other characters is one blank, as are both ends.
    """
    lower, letter = _tables()
    codes = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    if not letter[codes].any():
        return None
    folded = np.concatenate([np.zeros(1, np.uint32), lower[codes], np.zeros(1, np.uint32)])
    solid = folded > 0
    solid[1:] |= solid[:-1]
    solid[0] = True
    chars = folded[solid].astype(np.uint64)
    out = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(chars), CHARS):
        some = chars[at : at + CHARS + max(ORDERS) - 1]
        for n in ORDERS:
            places = min(CHARS, len(some) - n + 1)
            if places > 0:
                mixed = np.full(places, n, np.uint64)
                for k in range(n):
                    mixed = (mixed ^ some[k : k + places]) * _ODD[k]
                    mixed ^= mixed >> np.uint64(29)
                out += np.bincount((mixed * _STIR) >> np.uint64(48), minlength=BUCKETS)
    return out


def _vector(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and TF-IDF of unit length; the last bucket is a constant."""
    at = np.flatnonzero(counts)
    x = counts[at] * idf[at]
    return np.append(at, BUCKETS).astype(np.int32), np.append(x / np.sqrt((x * x).sum()), 1.0)


def _frequencies(batches):
    """Documents that hold each bucket, summed over the task; bucket -1 counts documents."""
    seen, n = np.zeros(BUCKETS, np.int64), 0
    for batch in batches:
        for text in batch.column(0):
            counts = ngram_counts(text.as_py())
            if counts is not None:
                seen += counts > 0
                n += 1
    at = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(seen[at], n))], ["bucket", "n"])


def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The closed-form minimum of the leader's objective: nothing where the gradients' sum stays within the L1 penalty."""
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def _probabilities(margins: np.ndarray) -> np.ndarray:
    e = np.exp(margins - margins.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def follow(z: np.ndarray, n: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray, int]]) -> None:
    """One pass over ``rows`` (buckets, values, language): each moves the state of its own buckets."""
    for at, x, lang in rows:
        zs, ns = z[at], n[at]
        w = weights(zs, ns)
        wrong = _probabilities(x @ w)
        wrong[lang] -= 1.0
        g = x[:, None] * wrong
        g2 = g * g
        z[at] = zs + g - (np.sqrt(ns + g2) - np.sqrt(ns)) / ALPHA * w
        n[at] = ns + g2


@dataclass
class Model:
    """Languages in order, IDF of the buckets, a weight a bucket and language, and the temperature that divides margins."""

    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float = 1.0

    def margins(self, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        return x @ self.weights[at]

    def predict(self, text: str | None) -> tuple[str, float]:
        counts = ngram_counts(text) if self.langs else None
        if counts is None:
            return UNKNOWN, 0.0
        p = _probabilities(self.margins(*_vector(counts, self.idf)) / self.temperature)
        best = int(p.argmax())
        return self.langs[best], float(p[best])


def _featuriser(given):
    def run(batches):
        for batch in batches:
            keep, ats, xs = [], [], []
            for k, text in enumerate(batch.column(3)):
                counts = ngram_counts(text.as_py())
                if counts is not None:
                    at, x = _vector(counts, given.value)
                    keep.append(k)
                    ats.append(at)
                    xs.append(x.astype(np.float32))
            columns = [c.take(pa.array(keep, pa.int64())) for c in batch.columns[:3]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(ats, pa.list_(pa.int32())), pa.array(xs, pa.list_(pa.float32()))], ["place", "lang", "apart", "at", "x"])

    return run


def _learner(given, langs: int):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("place").combine_chunks()
        z, n = (given.value[0].astype(np.float64), given.value[1].astype(np.float64)) if given else (np.zeros((BUCKETS + 1, langs)), np.zeros((BUCKETS + 1, langs)))
        follow(z, n, [(a.values.to_numpy(), x.values.to_numpy().astype(np.float64), lang.as_py()) for a, x, lang in zip(group["at"], group["x"], group["lang"], strict=True)])
        number = group["learner"][0].as_py()
        slices = range(0, BUCKETS + 1, SLICE)
        bytes_of = [[np.ascontiguousarray(v[k : k + SLICE]).tobytes() for k in slices] for v in (z, n)]
        return pa.table({"slice": pa.array(list(slices), pa.int32()), "learner": pa.array([number] * len(slices), pa.int32()), "z": pa.array(bytes_of[0], pa.binary()), "n": pa.array(bytes_of[1], pa.binary())})

    return run


def _average(group: pa.Table) -> pa.Table:
    """The learners' mean state of a slice, summed in their order, so that a rerun gives the same bits."""
    group = group.sort_by("learner").combine_chunks()
    mean = [np.mean([np.frombuffer(v.as_buffer(), np.float64) for v in group[c]], axis=0).astype(np.float32).tobytes() for c in ("z", "n")]
    return pa.table({"slice": group["slice"].slice(0, 1), "z": pa.array([mean[0]], pa.binary()), "n": pa.array([mean[1]], pa.binary())})


def temperature(margins: np.ndarray, truth: np.ndarray) -> float:
    """The divisor of margins with the least log loss against smoothed labels, by golden section on its logarithm."""
    if not len(margins) or margins.shape[1] < 2:
        return 1.0
    eps = 1.0 / (len(margins) + margins.shape[1])

    def loss(log_t: float) -> float:
        p = np.maximum(_probabilities(margins / np.exp(log_t)), 1e-300)
        return -((1 - eps) * np.log(p[np.arange(len(p)), truth]) + eps * np.log(p).mean(1)).mean()

    low, high, ratio = -4.0, 4.0, (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most_rows: int = MOST_ROWS, most_langs: int = MOST_LANGS) -> Model:
    """Fit on ``docs``, all of them rows to learn from.

    Document frequencies count every row with a language and a letter.  Weights are fitted on at most ``most_rows`` rows: of each
    language as many, those of the smallest hashes of id and text, or all if there are fewer; equal rows count once.  The ``most_langs`` most frequent
    languages are learnt.  Null languages, null texts and texts without a letter are left out; without rows the model knows no language.

    The driver holds a state of ``BUCKETS`` times languages, whatever the input; a learner holds its share of the bounded rows.
    """
    spark = docs.sparkSession
    rows = bounded_batches(docs).select(F.xxhash64(F.col(id_col).cast("string"), F.col(text_col).cast("string")).alias("place"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counted = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_langs).collect()
    held = {r["bucket"]: r["n"] for r in rows.select("text").mapInArrow(tidy(_frequencies), "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()}
    if not held.get(-1):
        return Model([], np.zeros(BUCKETS), np.zeros((BUCKETS + 1, 0)))
    idf = np.full(BUCKETS, np.log(1.0 + held.pop(-1)) + 1.0)
    at = np.fromiter(held, np.int64, len(held))
    idf[at] -= np.log1p(np.fromiter(held.values(), np.float64, len(held)))

    langs, quota = sorted(r["lang"] for r in counted), max(1, most_rows // len(counted))
    shares = {r["lang"]: min(1.0, (quota + 5 * quota**0.5) / r["n"]) for r in counted}
    bounds = [(name, k, int(-(1 << 63) + min(shares[name] * 2.0**64, 2.0**64 - 2048))) for k, name in enumerate(langs)]
    chosen = rows.join(F.broadcast(spark.createDataFrame(bounds, "lang string, number int, bound bigint")), "lang").where("place <= bound")
    chosen = chosen.groupBy("place", "number").agg(F.min("text").alias("text"))
    chosen = chosen.withColumn("rank", F.row_number().over(Window.partitionBy("number").orderBy("place", "text"))).where(F.col("rank") <= quota)
    apart = F.pmod(F.xxhash64("text"), F.lit(KEPT_APART)) == 0
    sample = chosen.select("place", F.col("number").alias("lang"), apart.alias("apart"), "text")
    context = spark.sparkContext
    sample = written(sample.mapInArrow(tidy(_featuriser(context.broadcast(idf))), "place bigint, lang int, apart boolean, at array<int>, x array<float>"), "language_rows")

    fitted = sample.where("not apart").withColumn("learner", F.pmod(F.xxhash64(F.lit(1), "place"), F.lit(LEARNERS)).cast("int"))
    z = n = np.zeros((BUCKETS + 1, len(langs)), np.float32)
    for epoch in range(EPOCHS):
        given = context.broadcast((z, n)) if epoch else None
        states = fitted.groupBy("learner").applyInArrow(_learner(given, len(langs)), "slice int, learner int, z binary, n binary")
        z, n = np.zeros_like(z), np.zeros_like(n)
        for r in states.groupBy("slice").applyInArrow(_average, "slice int, z binary, n binary").collect():
            for state, raw in ((z, r["z"]), (n, r["n"])):
                part = np.frombuffer(raw, np.float32).reshape(-1, len(langs))
                state[r["slice"] : r["slice"] + len(part)] = part
    model = Model(langs, idf, weights(z.astype(np.float64), n.astype(np.float64)).astype(np.float32))
    model.temperature = temperature(*_margins(sample.where("apart"), model))
    return model


def _margins(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Margins and languages of the rows kept apart, by place: a bounded number."""
    given = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            out = [given.value.margins(a.values.to_numpy(), x.values.to_numpy()).astype(np.float64) for a, x in zip(batch.column("at"), batch.column("x"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("place"), batch.column("lang"), pa.array(out, pa.list_(pa.float64()))], ["place", "lang", "margins"])

    found = sorted(rows.mapInArrow(run, "place bigint, lang int, margins array<double>").collect())
    return np.array([r["margins"] for r in found]).reshape(len(found), -1), np.array([r["lang"] for r in found], np.int64)


def predict(docs: DataFrame, model: Model, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """``docs`` without ``text_col``, with the likeliest language and its calibrated probability.

    Whole texts count.  Texts that are null, empty or without a letter are ``und`` with score 0, as is every text if no language was learnt;
    other columns, nulls and repeated rows pass through, but for columns of the two new names, which are replaced; a row in, a row out, without a shuffle.
    """
    keep = [c for c in docs.columns if c not in (text_col, lang_out, score_out)]
    given = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            found = [given.value.predict(t.as_py()) for t in batch.column(len(keep))]
            columns = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *columns], [*keep, lang_out, score_out])

    schema = docs.select(*keep, F.lit("").alias(lang_out), F.lit(0.0).alias(score_out)).schema
    return bounded_batches(docs).select(*keep, F.col(text_col).cast("string")).mapInArrow(tidy(run), schema)


def fold(id_col: str = "doc_id", folds: int = 4) -> Column:
    """The remainder that a row's id falls in; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds
