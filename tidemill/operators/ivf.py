"""Inverted file over vectors: k-means cells as partitioned Parquet, searched by probing the cells near a query, or exactly by residual bounds.

Every vector lies in the cell of its nearest centroid and keeps its residual, the angle to it.  The angle between a query and a vector is
at least the difference of their angles to the centroid, so a cell's largest residual bounds the cosine that it can hold.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import fresh_path
from .retrieval import QUERY_BLOCK, VECTOR_BLOCK, _nearest, cosine_top, top

#: Cells at most, one for about the square root of the vectors; vectors that centroids are fitted on, about, for each cell; steps of the fit.
MOST_CELLS, SAMPLE, STEPS = 4096, 64, 8
#: Neighbours that are returned, and vectors in the cells that a query probes for them at least.
RETURNED, CANDIDATES = 50, 400
#: Share of the true neighbours that probing is tuned to find, and vectors that it is tuned on, about.
TARGET, TRIED = 0.97, 128
#: The cell of zero vectors, whose cosine with anything counts as 0.
ZEROS = -1
#: What rounding to six places can move a cosine by, twice over.
SLACK = 2e-6


@dataclass
class Cells:
    """Where the vectors lie, by ``cell`` and ``part``, and each cell's centroid, largest residual and number of vectors: some thousand rows at most.

    ``candidates`` is how many vectors a query's probed cells must hold together.
    """

    path: str
    numbers: np.ndarray
    centroids: np.ndarray
    radius: np.ndarray
    sizes: np.ndarray
    candidates: int = CANDIDATES

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("id bigint, v array<double>, residual double, part int, cell int").parquet(self.path)


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def _vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Rows with an id and a vector of finite components."""
    rows = rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id is not null and v is not null")
    return rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))))


def _length(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda n, x: n + x * x))


def build(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cells: int | None = None, target: float | None = TARGET, most: int = RETURNED) -> Cells:
    """Index every vector.  Centroids are fitted (MLlib) on a sample by hash of about ``SAMPLE`` vectors a cell; all vectors are then put into cells.

    With a ``target``, the number of candidates is raised from ``CANDIDATES`` until probing finds that share of the ``most`` true neighbours of about ``TRIED`` of the
    vectors, which are compared with all: clustered vectors need few cells, vectors without clusters many.

    A cell's files hold parts of bounded size, each sorted by residual.  Null ids and vectors that are null or hold null or non-finite components take no part.
    """
    spark, rows = vectors.sparkSession, _vectors(vectors, id_col, vector_col)
    n = rows.count()
    k = cells or min(MOST_CELLS, max(1, round(n**0.5)))
    share = min(1.0, SAMPLE * k / max(1, n))
    sample = rows.where(_length(F.col("v")) > 0).where(F.xxhash64("id") <= int(-(1 << 63) + min(share * 2.0**64, 2.0**64 - 2048)))
    sample = sample.select(array_to_vector(F.transform("v", lambda x: x / _length(F.col("v")))).alias("features"))
    few = sample.limit(k + 1).count()
    if few:
        model = KMeans(k=min(k, few), maxIter=STEPS, seed=7, distanceMeasure="cosine").fit(sample)
        centroids = _unit(np.array(model.clusterCenters()))
    else:
        centroids = np.zeros((0, 0))
    given = spark.sparkContext.broadcast(centroids)

    def place(batches):
        for pdf in batches:
            x, c = np.array(pdf["v"].to_list(), np.float64), given.value
            cell, residual = np.full(len(pdf), ZEROS), np.zeros(len(pdf))
            if len(pdf) and len(c):
                near = _unit(x) @ c.T
                solid = (x != 0).any(1)
                cell[solid] = near.argmax(1)[solid]
                residual[solid] = np.arccos(np.clip(near.max(1), -1, 1))[solid]
            yield pdf.assign(residual=residual, cell=cell)

    placed = rows.mapInPandas(place, "id bigint, v array<double>, residual double, cell int")
    placed = placed.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(max(1, -(-n // (VECTOR_BLOCK * max(1, k // 4)))))).cast("int"))
    path = fresh_path(spark, "cells")
    placed.repartition("cell", "part").sortWithinPartitions("cell", "residual").write.partitionBy("cell").parquet(path)
    index = Cells(path, np.empty(0, int), centroids, np.empty(0), np.empty(0, int))
    told = sorted(index.rows(spark).groupBy("cell").agg(F.max("residual").alias("r"), F.count("*").alias("n")).collect())
    index.numbers, index.radius, index.sizes = np.array([r["cell"] for r in told], int), np.array([r["r"] for r in told], float), np.array([r["n"] for r in told], int)
    if target is not None and n:
        index.candidates = max(CANDIDATES, _needed(index, spark, n, target, most))
    return index


def _needed(index: Cells, spark: SparkSession, n: int, target: float, most: int) -> int:
    """How many vectors must be in the probed cells so that the share ``target`` of true neighbours is."""
    bound = int(-(1 << 63) + min(TRIED / n * 2.0**64, 2.0**64 - 2048))
    tried = index.rows(spark).where(F.xxhash64(F.lit(5), "id") <= bound).select("id", "v")
    near = cosine_top(tried, index.rows(spark), most, "id", "v").select("qid", F.col("vec_id").alias("id"))
    places = near.join(index.rows(spark).select("id", "cell"), "id").select("qid", "cell").collect()
    asked = {r["id"]: r["v"] for r in tried.collect()}
    if not places:
        return 0
    ids = sorted(asked)
    order = np.argsort(_angles(index, np.array([asked[k] for k in ids], np.float64)), axis=1, kind="stable")
    before = np.take_along_axis(np.cumsum(index.sizes[order], axis=1) - index.sizes[order], np.argsort(order, axis=1), 1)
    row, cell = {k: i for i, k in enumerate(ids)}, {c: i for i, c in enumerate(index.numbers.tolist())}
    needs = np.sort([before[row[r["qid"]], cell[r["cell"]]] for r in places])
    return int(needs[min(len(needs) - 1, int(np.ceil(target * len(needs))))]) + 1


def _angles(index: Cells, x: np.ndarray) -> np.ndarray:
    """Angles of queries to the cells' centroids; to the cell of zeros a right one."""
    out = np.full((len(x), len(index.numbers)), np.pi / 2)
    solid = index.numbers >= 0
    if solid.any():
        out[:, solid] = np.arccos(np.clip(_unit(x) @ index.centroids[index.numbers[solid]].T, -1, 1))
    return out


def _probes(index: Cells, queries: DataFrame, candidates: int) -> DataFrame:
    """``qid, q, cell``: cells by the angle to their centroids until they hold ``candidates`` vectors."""
    given = queries.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        for pdf in batches:
            ix, x = given.value, np.array(pdf["v"].to_list(), np.float64)
            if len(pdf) and len(ix.numbers):
                order = np.argsort(_angles(ix, x), axis=1, kind="stable")
                held = np.cumsum(ix.sizes[order], axis=1)
                row, at = np.nonzero(held - ix.sizes[order] < candidates)
                yield pd.DataFrame({"qid": pdf["id"].to_numpy()[row], "q": pdf["v"].to_numpy()[row], "cell": ix.numbers[order[row, at]]})

    return queries.mapInPandas(run, "qid bigint, q array<double>, cell int")


def _within(index: Cells, floors: DataFrame) -> DataFrame:
    """``qid, q, cell``: cells that may hold a vector of a cosine at the query's ``floor`` or over it, by their residual bound; all where there is none."""
    given = floors.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        for pdf in batches:
            ix, x = given.value, np.array(pdf["v"].to_list(), np.float64)
            if len(pdf) and len(ix.numbers):
                best = np.cos(np.maximum(0, _angles(ix, x) - ix.radius))
                row, at = np.nonzero(best >= pdf["floor"].fillna(-2).to_numpy()[:, None] - SLACK)
                yield pd.DataFrame({"qid": pdf["id"].to_numpy()[row], "q": pdf["v"].to_numpy()[row], "cell": ix.numbers[at]})

    return floors.mapInPandas(run, "qid bigint, q array<double>, cell int")


def _best(index: Cells, probes: DataFrame, most: int) -> DataFrame:
    """Each query's best of the cells that it probes, by exact cosines.  The cells asked for, a bounded list, are a filter on the files' folders."""
    spark = probes.sparkSession
    asked = [r["cell"] for r in probes.select("cell").distinct().collect()]
    rows, again = (index.rows(spark).where(F.col("cell").isin(asked)) for _ in range(2))
    sizes = again.groupBy("cell", "part").count().select("cell", "part")
    blocks = max(1, -(-probes.select("qid").distinct().count() // QUERY_BLOCK))
    met = probes.withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int")).join(sizes, "cell").select("cell", "part", "block", F.col("qid").alias("id"), F.col("q").alias("v"))
    held = rows.select("cell", "part", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "id", "v")
    found = held.groupBy("cell", "part", "block").cogroup(met.groupBy("cell", "part", "block")).applyInPandas(_nearest(most), "qid bigint, vec_id bigint, score double")
    return top(found.where("qid <> vec_id").withColumn("score", F.round("score", 6)), most, ties=("vec_id",))


def search(index: Cells, queries: DataFrame, most: int = RETURNED, candidates: int | None = None, exact: bool = False, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``qid, vec_id, score, rank``: the ``most`` nearest of each query but itself, ties to the smaller id.

    A query probes the cells nearest to it that hold ``candidates`` vectors together, the index's own number if none is given.  With ``exact``, the last of its hits there is a floor, and all cells
    whose residual bound reaches it are searched: the result is that of comparing every vector.
    """
    asked = _vectors(queries, id_col, vector_col)
    hits = _best(index, _probes(index, asked, index.candidates if candidates is None else candidates), most)
    if not exact:
        return hits
    floors = hits.where(F.col("rank") == most).select(F.col("qid").alias("id"), F.col("score").alias("floor"))
    return _best(index, _within(index, asked.join(floors, "id", "left")), most)
