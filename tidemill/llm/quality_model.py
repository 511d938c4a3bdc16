"""Quality classifier: a generalised additive model with pairwise interactions, boosted cyclically into lookup tables."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality_rules import SPACES, SYMBOLS, _repeat_words
from .shared import bounded_batches, tidy
from .words import WordHasher

NAMES = [
    "log_words", "word_length", "symbols", "dup_lines", "repeated", "upper", "digits", "exclaims", "distinct",
    "top_word", "longest", "line_words", "non_ascii", "bars", "stops", "entropy", "short_words", "dup_words", "at_signs",
]
#: Labelled rows that a model is fitted on at most: those of the smallest hashes of the id.
MOST_ROWS = 20_000
BINS, PAIR_BINS, PAIRS = 48, 8, 8
ROUNDS, PAIR_ROUNDS, RATE = 200, 60, 0.08
_UPPER, _LETTERS, _DIGITS = bytes(range(65, 91)), bytes([*range(65, 91), *range(97, 123)]), bytes(range(48, 58))


def features(text: str | None, hasher: WordHasher) -> list[float]:
    """The numbers in the order of ``NAMES``, from the whole text alone; a text without words gives zeros."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    n = len(words)
    if not n:
        return [0.0] * len(NAMES)
    count = lambda chars: len(raw) - len(raw.translate(None, chars))
    hashes = hasher(words)
    _, times = np.unique(hashes, return_counts=True)
    share, lengths = times / n, np.fromiter(map(len, words), np.int64, n)
    solid, letters = len(raw) - count(SPACES), max(1, count(_LETTERS))
    seen, twice = set(), 0
    for x in lines:
        if x in seen:
            twice += len(x.split())
        seen.add(x)
    return [
        float(np.log1p(n)), solid / n, count(SYMBOLS) / n, 1 - len(seen) / len(lines), _repeat_words(hashes, 8) / n if n > 8 else 0.0,
        count(_UPPER) / letters, count(_DIGITS) / solid, raw.count(b"!") / n, len(times) / n, float(share.max()), float(np.log1p(lengths.max())),
        n / len(lines), (solid - len(raw.decode("utf-8", "surrogatepass").encode("ascii", "ignore").translate(None, SPACES))) / solid,
        raw.count(b"|") / n, count(b".,;:?") / n, float(-(share * np.log(share)).sum() / np.log(n + 1)), float((lengths <= 2).mean()), twice / n, raw.count(b"@") / n,
    ]


def _measure(batches):
    hasher = WordHasher()
    for batch in batches:
        rows = np.array([features(t.as_py(), hasher) for t in batch.column(1)], np.float64).reshape(-1, len(NAMES))
        ends = np.arange(0, rows.size + 1, len(NAMES), dtype=np.int32)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(rows.ravel()))], ["doc_id", "features"])


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, features`` of every row; null and empty texts have zeros; null ids and repeated rows pass through."""
    return bounded_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(_measure), f"doc_id {dict(docs.dtypes)[id_col]}, features array<double>")


@dataclass
class Gam:
    """Bin edges, a table a feature and a table a pair of features; the score is the logistic of their sum."""

    edges: list[np.ndarray]
    base: float
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.edges)], 1)

    def coarse(self, b: np.ndarray) -> np.ndarray:
        sizes = np.array([len(t) for t in self.tables])
        return b * PAIR_BINS // np.maximum(sizes, PAIR_BINS)

    def margin(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        c, out = self.coarse(b), np.full(len(x), self.base)
        for k, t in enumerate(self.tables):
            out += t[b[:, k]]
        for i, j, t in self.pairs:
            out += t[c[:, i], c[:, j]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def _split(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """The best cut of a histogram of gradients and curvatures: its gain, and the first bin of the right side."""
    if len(g) < 2:
        return 0.0, 0
    cg, ch = np.cumsum(g), np.cumsum(h)
    gains = _gain(cg[:-1], ch[:-1]) + _gain(cg[-1] - cg[:-1], ch[-1] - ch[:-1]) - _gain(cg[-1], ch[-1])
    at = int(np.argmax(gains))
    return float(gains[at]), at + 1


def _step(g: np.ndarray, h: np.ndarray, leaves: int = 3) -> np.ndarray:
    """A tree of up to ``leaves`` leaves over the bins, as the value of each bin."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        best = max(((*_split(g[a:b], h[a:b]), a, b) for a, b in parts), key=lambda p: p[0])
        if best[0] <= 1e-9:
            break
        _, at, a, b = best
        parts.remove((a, b))
        parts += [(a, a + at), (a + at, b)]
    out = np.empty(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1.0)
    return out


def _step2(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """A tree of depth two over a grid: the cut of one feature, then of each half by the other, that gain most together."""
    best = (-1.0, np.zeros_like(g))
    for turn in (False, True):
        a, b = (g.T, h.T) if turn else (g, h)
        ca, cb, whole = np.cumsum(a, 0), np.cumsum(b, 0), float(_gain(a.sum(), b.sum()))
        for at in range(1, len(a)):
            halves = [(slice(0, at), ca[at - 1], cb[at - 1]), (slice(at, None), ca[-1] - ca[at - 1], cb[-1] - cb[at - 1])]
            cuts = [_split(x, y) for _, x, y in halves]
            gain = sum(c[0] + float(_gain(x.sum(), y.sum())) for c, (_, x, y) in zip(cuts, halves, strict=True)) - whole
            if gain > best[0]:
                out = np.zeros_like(a)
                for (_, cut), (rows, x, y) in zip(cuts, halves, strict=True):
                    for cols in (slice(0, cut), slice(cut, None)):
                        out[rows, cols] = x[cols].sum() / (y[cols].sum() + 1.0)
                best = (gain, out.T if turn else out)
    return best


def fit(x: np.ndarray, y: np.ndarray) -> Gam:
    """Boost one shallow tree a feature in turn, then trees over the pairs that explain most of what is left.

    Without rows, or with one label only, the model is a constant.
    """
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.empty(0) for k in range(len(NAMES))]
    p = (y.sum() + 1) / (len(y) + 2)
    gam = Gam(edges, float(np.log(p / (1 - p))), [np.zeros(len(e) + 1) for e in edges])
    if not len(y) or y.min() == y.max():
        return gam
    b = gam.bins(x)
    f = np.full(len(y), gam.base)
    for _ in range(ROUNDS):
        for k, t in enumerate(gam.tables):
            q = 1 / (1 + np.exp(-f))
            s = RATE * _step(np.bincount(b[:, k], y - q, len(t)), np.bincount(b[:, k], q * (1 - q), len(t)))
            t += s
            f += s[b[:, k]]
    c = gam.coarse(b)

    def grid(i: int, j: int, w: np.ndarray) -> np.ndarray:
        return np.bincount(c[:, i] * PAIR_BINS + c[:, j], w, PAIR_BINS * PAIR_BINS).reshape(PAIR_BINS, PAIR_BINS)

    q = 1 / (1 + np.exp(-f))
    gains = [(_step2(grid(i, j, y - q), grid(i, j, q * (1 - q)))[0], i, j) for i in range(len(NAMES)) for j in range(i)]
    gam.pairs = [(i, j, np.zeros((PAIR_BINS, PAIR_BINS))) for _, i, j in sorted(gains, reverse=True)[:PAIRS]]
    for _ in range(PAIR_ROUNDS):
        for i, j, t in gam.pairs:
            q = 1 / (1 + np.exp(-f))
            s = RATE * _step2(grid(i, j, y - q), grid(i, j, q * (1 - q)))[1]
            t += s
            f += s[c[:, i], c[:, j]]
    return gam


def train(measured: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", most: int = MOST_ROWS) -> Gam:
    """Fit on the labelled rows of the ``most`` smallest hashes of the id, or on all if there are fewer.

    Ids are counted, and those past a hash bound that ``most`` rows are expected under, with five
    deviations to spare, are filtered out before features are joined: the driver receives about
    ``most`` rows however many are labelled.  Null labels and ids are left out, an id that repeats counts once
    (largest label, smallest features); labels without a document count for nothing.
    """
    given = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.max(label_col).cast("double").alias("y"))
    given = given.join(measured.select("doc_id").distinct(), "doc_id", "left_semi")
    n = given.count()
    place = F.xxhash64("doc_id")
    if n > most:
        share = min(1.0, (most + 5 * most**0.5) / n)
        given = given.where(place < int(-(1 << 63) + share * ((1 << 64) - 1)) if share < 1 else F.lit(True))
    rows = measured.join(given, "doc_id").groupBy("doc_id", "y").agg(F.min("features").alias("features")).select(place.alias("place"), "doc_id", "features", "y").collect()
    rows = sorted(rows, key=lambda r: (r["place"], r["doc_id"]))[:most]
    return fit(np.array([r["features"] for r in rows], np.float64).reshape(-1, len(NAMES)), np.array([r["y"] for r in rows], np.float64))


def score(measured: DataFrame, gam: Gam) -> DataFrame:
    """``measured`` with ``score`` in place of the features.  The model goes to the tasks whole: some thousand numbers, whatever the input."""
    keep = [c for c in measured.columns if c != "features"]
    given = measured.sparkSession.sparkContext.broadcast(gam)

    def run(batches):
        for batch in batches:
            x = batch.column(len(keep)).flatten().to_numpy().reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(given.value.score(x))], [*keep, "score"])

    schema = measured.select(*keep, F.lit(0.0).alias("score")).schema
    return measured.select(*keep, "features").mapInArrow(run, schema)
