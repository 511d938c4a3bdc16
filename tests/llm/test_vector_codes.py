"""Vector codes against a plain version that compares every part with every entry."""

import hashlib

import numpy as np
import pytest

from tidemill.llm import vector_codes

SCHEMA = "vec_id bigint, embedding array<float>, label int, code string, error string"


def plain(rows, parts=16, entries=64, rounds=2):
    kept = [r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    ints = [[int(np.floor(256.0 * float(np.float32(x)))) for x in r[1]] for r in kept]
    w = len(ints[0]) // parts
    cut = [[v[p * w : p * w + w] for p in range(parts)] for v in ints]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def pick(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            mine = [pick(c[p], books[p])[1] for c in cut]
            for k in range(len(books[p])):
                xs = [c[p] for c, m in zip(cut, mine, strict=True) if m == k]
                if xs:
                    books[p][k] = [sum(col) // len(xs) for col in zip(*xs, strict=True)]
    found = [[pick(c[p], books[p]) for p in range(parts)] for c in cut]
    error = [sum(d for d, _ in f) for f in found]
    by_label = {}
    for r, e in zip(kept, error, strict=True):
        by_label[r[2]] = by_label.get(r[2], 0) + e
    text = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((repr(r[0]), "".join(f"{k:02x}" for _, k in f), e, by_label[r[2]], text) for r, f, e in zip(kept, found, error, strict=True))


def rows_of(df):
    return sorted((repr(r["vec_id"]), r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in df.collect())


def made(n, seed, dims=32, spread=0.3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 0.2, (5, dims))
    out = [(int(k), [float(np.float32(x)) for x in centres[k % 5] + rng.normal(0, spread, dims)], k % 4) for k in range(n)]
    out += [(None, out[3][1], None), (7, out[7][1], 2), (7, out[7][1], 2), (n + 1, None, 1), (n + 2, [None] * dims, 1), (n + 3, [float("nan")] * dims, None), (n + 4, [float("inf")] + [0.0] * (dims - 1), 2)]
    return [(a, v, c, "user's", "own") for a, v, c in out]


@pytest.mark.parametrize("n,chunk,spread", [(300, 64, 0.3), (40, 8192, 0.05), (300, 8192, 0.001)])
def test_equals_plain_version(spark, monkeypatch, n, chunk, spread):
    rows = made(n, n, spread=spread)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    monkeypatch.setattr(vector_codes, "CHUNK", chunk)
    assert rows_of(vector_codes.compress(df)) == plain(rows)


def test_empty_odd_lengths_and_limits(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert vector_codes.compress(empty).collect() == []
    assert vector_codes.compress(spark.createDataFrame([(1, None, 1, "", "")], SCHEMA)).collect() == []
    rows = made(20, 1) + [(500, [0.5] * 16, 9, "", "")]
    got = {r["vec_id"]: r for r in vector_codes.compress(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[500]["code"] is None and got[500]["label_error"] is None and got[3]["code"] is not None
    with pytest.raises(ValueError):
        vector_codes.compress(spark.createDataFrame([(1, [0.0] * 17, 1, "", "")], SCHEMA))
    with pytest.raises(ValueError):
        vector_codes.compress(spark.createDataFrame([(1, [1e30] * 16, 1, "", "")], SCHEMA))


def test_hilbert_neighbours_touch():
    grid = np.stack(np.meshgrid(np.arange(16), np.arange(16), np.arange(16), indexing="ij"), -1).reshape(-1, 3)
    place = vector_codes.hilbert(grid)
    assert sorted(place.tolist()) == list(range(4096))
    walk = grid[np.argsort(place)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_shortlists_hold_every_nearest_entry_and_spare_work():
    rng = np.random.default_rng(5)
    points, entries = rng.integers(-90, 90, (4096, 4)).astype(np.int32), rng.integers(-60, 60, (64, 4))
    blocks = vector_codes.Blocks.of(points)
    lists = blocks.shortlists(entries)
    best, least = vector_codes.nearest(blocks, entries, lists, np.ones(len(lists), bool))
    apart = ((blocks.points[:, None, :].astype(np.int64) - entries) ** 2).sum(2)
    assert (best == apart.argmin(1)).all() and (least == apart.min(1)).all()
    assert lists.mean() < 0.5
