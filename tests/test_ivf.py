"""The inverted file against comparing every vector: recall of probing, equality of the exact search, files left unread."""

import random

from pyspark.sql import functions as F

from tidemill.operators import ivf, retrieval
from tidemill.sources import tables as S

SF = "/root/testdata/sf0.1"


def hits_of(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.qid, {})[r["rank"]] = (r.vec_id, r.score)
    return out


def test_recall_and_equality_on_the_largest_table(spark):
    v = S.table(spark, SF, "embeddings")
    q = v.where("vec_id % 100 = 0")
    index = ivf.build(v)
    assert index.sizes.sum() == v.count() and (index.radius >= 0).all()
    want = hits_of(retrieval.cosine_top(q, v, ivf.RETURNED))
    near = hits_of(ivf.search(index, q))
    found = sum(len({x for x, _ in want[k].values()} & {x for x, _ in near[k].values()}) for k in want)
    assert found >= 0.95 * sum(map(len, want.values()))
    assert hits_of(ivf.search(index, q, exact=True)) == want


def test_cells_that_nobody_probes_are_not_read(spark):
    v = S.table(spark, SF, "embeddings")
    index = ivf.build(v)
    one = v.where("vec_id = 100")
    asked = [r.cell for r in ivf._probes(index, ivf._vectors(one, "vec_id", "embedding"), 50).collect()]
    assert 0 < len(asked) < len(index.numbers) / 3
    plan = index.rows(spark).where(F.col("cell").isin(asked))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "cell#" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_clustered_vectors_need_few_candidates(spark):
    r = random.Random(1)
    centres = [[r.gauss(0, 1) for _ in range(16)] for _ in range(30)]
    rows = [(k, [x + r.gauss(0, 0.05) for x in centres[k % 30]]) for k in range(3000)]
    v = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    index, q = ivf.build(v, cells=30), v.where("vec_id % 100 = 0")
    assert index.candidates == ivf.CANDIDATES
    want, near = hits_of(retrieval.cosine_top(q, v, 50)), hits_of(ivf.search(index, q))
    assert sum(want[k] == near[k] for k in want) >= 0.95 * len(want)
    floors = spark.createDataFrame([(k, near[k][50][1]) for k in near], "id bigint, floor double")
    assert ivf._within(index, ivf._vectors(q, "vec_id", "embedding").join(floors, "id")).count() < 6 * len(want)


def test_odd_vectors(spark):
    r = random.Random(3)
    rows = [(k, [r.gauss(0, 1) for _ in range(8)]) for k in range(120)]
    rows += [(200, [0.0] * 8), (201, [0.0] * 8), (202, None), (203, [None] * 8), (204, [float("nan")] * 8), (None, [1.0] * 8), (205, rows[5][1]), (206, rows[5][1])]
    v = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    good = v.where("vec_id is not null and (vec_id < 202 or vec_id > 204)")
    index = ivf.build(v, cells=6)
    assert hits_of(ivf.search(index, v, most=7, candidates=10, exact=True)) == hits_of(retrieval.cosine_top(good, good, 7))
    assert ivf.search(ivf.build(v.limit(0)), v, exact=True).count() == 0
    zeros = v.where("vec_id in (200, 201)")
    assert hits_of(ivf.search(ivf.build(zeros), zeros, exact=True)) == {200: {1: (201, 0.0)}, 201: {1: (200, 0.0)}}
