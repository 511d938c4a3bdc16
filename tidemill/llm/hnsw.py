"""Approximate nearest neighbours: one hierarchical navigable small-world graph per shard, results merged."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

#: Vectors of a shard; links of a node (twice as many on the ground layer); breadth of the searches that build and ask.
SHARD_ROWS, LINKS, BUILD, ASK = 4096, 16, 80, 160
#: Numbers in the query vectors that a task asks one shard at a time.
QUERY_NUMBERS = 1 << 20


class Graph:
    """A navigable small-world graph over unit vectors, kept as flat arrays.

    ``near[layer]`` holds ``width`` neighbour numbers a node, -1 where there is none.
    """

    def __init__(self, unit: np.ndarray, levels: np.ndarray, near: list[np.ndarray], entry: int):
        self.unit, self.levels, self.near, self.entry = unit, levels, near, entry

    @classmethod
    def build(cls, unit: np.ndarray, seed: int = 0) -> Graph:
        n, rng = len(unit), np.random.default_rng(seed)
        levels = np.minimum((-np.log(1 - rng.random(n)) / math.log(LINKS)).astype(np.int64), 8)
        near = [np.full((n, LINKS * (2 if k == 0 else 1)), -1, np.int32) for k in range(int(levels.max()) + 1)]
        g = cls(unit, levels, near, 0)
        for x in range(1, n):
            g._insert(x)
        return g

    def _insert(self, x: int) -> None:
        v, at = self.unit[x], [(float(self.unit[self.entry] @ self.unit[x]), self.entry)]
        top = int(self.levels[self.entry])
        for layer in range(top, int(self.levels[x]), -1):
            at = self._walk(v, at, 1, layer)
        for layer in range(min(top, int(self.levels[x])), -1, -1):
            at = self._walk(v, at, BUILD, layer)
            chosen = self._diverse(at, LINKS)
            self.near[layer][x, : len(chosen)] = chosen
            for y in chosen:
                self._link(y, x, layer)
        if self.levels[x] > top:
            self.entry = x

    def _diverse(self, found: list[tuple[float, int]], most: int) -> list[int]:
        """Nearest first, leaving out what is nearer to one already chosen; the rest fills up."""
        order = [i for _, i in sorted(found, key=lambda p: (-p[0], p[1]))]
        if len(order) <= most:
            return order
        sims = [s for s, _ in sorted(found, key=lambda p: (-p[0], p[1]))]
        block = self.unit[order]
        among = block @ block.T
        worst, chosen = np.full(len(order), -2.0, np.float32), []
        for k, s in enumerate(sims):
            if worst[k] < s:
                chosen.append(k)
                if len(chosen) == most:
                    break
                np.maximum(worst, among[k], out=worst)
        if len(chosen) < most:
            left = set(chosen)
            chosen += [k for k in range(len(order)) if k not in left][: most - len(chosen)]
        return [order[k] for k in chosen]

    def _link(self, y: int, x: int, layer: int) -> None:
        row = self.near[layer][y]
        free = int((row >= 0).sum())
        if free < len(row):
            row[free] = x
            return
        others = [*row.tolist(), x]
        chosen = self._diverse(list(zip((self.unit[others] @ self.unit[y]).tolist(), others, strict=True)), len(row))
        row[:] = -1
        row[: len(chosen)] = chosen

    def _walk(self, v: np.ndarray, start: list[tuple[float, int]], breadth: int, layer: int) -> list[tuple[float, int]]:
        """The ``breadth`` most similar nodes that a best-first walk from ``start`` meets, as (similarity, node)."""
        near, seen = self.near[layer], np.zeros(len(self.unit), bool)
        seen[[i for _, i in start]] = True
        best = list(start)
        heapq.heapify(best)
        todo = [(-s, i) for s, i in start]
        heapq.heapify(todo)
        while todo:
            s, i = heapq.heappop(todo)
            if -s < best[0][0] and len(best) >= breadth:
                break
            row = near[i]
            row = row[row >= 0]
            row = row[~seen[row]]
            if not len(row):
                continue
            seen[row] = True
            sims = self.unit[row] @ v
            if len(best) >= breadth:
                good = sims > best[0][0]
                row, sims = row[good], sims[good]
            for t, j in zip(sims.tolist(), row.tolist(), strict=True):
                if len(best) < breadth:
                    heapq.heappush(best, (t, j))
                elif t > best[0][0]:
                    heapq.heapreplace(best, (t, j))
                else:
                    continue
                heapq.heappush(todo, (-t, j))
        return best

    def ask(self, v: np.ndarray, breadth: int = ASK) -> list[int]:
        at = [(float(self.unit[self.entry] @ v), self.entry)]
        for layer in range(int(self.levels[self.entry]), 0, -1):
            at = self._walk(v, at, 1, layer)
        return [i for _, i in self._walk(v, at, breadth, 0)]


def _unit(vectors: np.ndarray) -> np.ndarray:
    wide = vectors.astype(np.float64)
    wide /= np.abs(wide).max(axis=1, keepdims=True)
    return (wide / np.sqrt((wide * wide).sum(axis=1, keepdims=True))).astype(np.float32)


def cosines(vectors: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Cosine of ``v`` with each row in double precision."""
    a, b = vectors.astype(np.float64), v.astype(np.float64)
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum()))


#: A shard: its vectors one after another, the ids of each vector and where they end, and the neighbour arrays of all layers one after another.
INDEX = "dim int, shard int, ids array<bigint>, ends array<int>, vectors array<double>, levels array<bigint>, near array<int>, entry int"


def _index(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("first", kind="stable")
    vectors = np.array(pdf["embedding"].to_list(), np.float64)
    g = Graph.build(_unit(vectors))
    ids, near = [np.asarray(x, np.int64) for x in pdf["ids"]], np.concatenate([x.ravel() for x in g.near])
    row = [int(pdf["dim"].iloc[0]), int(pdf["shard"].iloc[0]), np.concatenate(ids), np.cumsum([len(x) for x in ids]).astype(np.int32), vectors.ravel(), g.levels, near, g.entry]
    return pd.DataFrame([row], columns=[c.split()[0] for c in INDEX.split(", ")])


def build_index(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", keep: int = 6, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row a shard: its vectors, their ids and its graph as flat neighbour arrays.

    Equal vectors are one node with their ``keep`` smallest ids, found by a ranked limit before
    the shuffle; nodes are hashed to shards of about ``shard_rows``.  Vectors that are null, empty,
    all zero, or hold a null or non-finite component take no part; rows with a null id neither.
    Vectors of different lengths are in different shards and never compared.
    """
    v = F.transform(vector_col, lambda x: x.cast("double") + F.lit(0.0))
    rows = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), v.alias("embedding")).where(usable("embedding"))
    first = F.row_number().over(Window.partitionBy("embedding").orderBy("id"))
    rows = rows.distinct().withColumn("r", first).where(F.col("r") <= keep)
    nodes = written(rows.groupBy("embedding").agg(F.sort_array(F.collect_list("id")).alias("ids")), "nodes")
    shards = max(1, -(-nodes.count() // shard_rows))
    dealt = nodes.select(F.size("embedding").alias("dim"), F.pmod(F.xxhash64("embedding"), F.lit(shards)).cast("int").alias("shard"), "embedding", "ids", F.col("ids")[0].alias("first"))
    return written(dealt.groupBy("dim", "shard").applyInPandas(_index, INDEX), "index")


def usable(c: str) -> "F.Column":
    v = F.col(c)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0)


def _asker(k: int, breadth: int):
    def ask(index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": []}
        for r in index.itertuples():
            vectors = np.asarray(r.vectors, np.float64).reshape(-1, r.dim)
            ids = np.split(np.asarray(r.ids), np.asarray(r.ends)[:-1])
            first = np.array([x[0] for x in ids])
            ground, *upper = np.split(np.asarray(r.near, np.int32), np.arange(2, 2 + int(max(r.levels))) * (LINKS * len(vectors)))
            g = Graph(_unit(vectors), np.asarray(r.levels), [x.reshape(len(vectors), -1) for x in (ground, *upper)], int(r.entry))
            for q, v in zip(queries["id"].tolist(), queries["embedding"], strict=True):
                v = np.asarray(v, np.float64)
                found = np.array(g.ask(_unit(v[None])[0], breadth))
                scores = cosines(vectors[found], v)
                best = np.lexsort((first[found], -scores))[: k + 1]
                near = sorted(((-s, int(i)) for s, f in zip(scores[best].tolist(), found[best].tolist(), strict=True) for i in ids[f].tolist() if i != q))[:k]
                out["query_id"] += [q] * len(near)
                out["vec_id"] += [i for _, i in near]
                out["score"] += [-s for s, _ in near]
        return pd.DataFrame(out).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    return ask


def search(index: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", breadth: int = ASK, numbers: int = QUERY_NUMBERS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest that the shards' graphs give each query, itself left out.

    Queries are cut in blocks of about ``numbers`` vector components.  Every shard meets every
    block in a task of its own, to which both are sent by (length, shard, block): a task holds
    one graph and one block, and no key holds more.  Each shard gives its ``k`` best by exact
    cosine in double precision, ties to the smaller id, which a ranked limit merges alike.
    The index must keep ``k + 1`` ids a node.  Repeated query ids count once (smallest vector);
    unusable query vectors and null ids get no rows.
    """
    v = F.transform(vector_col, lambda x: x.cast("double") + F.lit(0.0))
    asked = queries.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), v.alias("embedding")).where(usable("embedding"))
    asked = asked.groupBy("id").agg(F.min("embedding").alias("embedding"))
    asked = written(asked.withColumn("dim", F.size("embedding")), "queries")
    shards, blocks = index.agg(F.coalesce(F.max("shard"), F.lit(0)) + 1).first()[0], max(1, -(-asked.agg(F.coalesce(F.sum("dim"), F.lit(0))).first()[0] // numbers))
    every = lambda name, n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    dealt = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).select("dim", "block", "id", "embedding", every("shard", shards))
    cell, tasks = ["dim", "shard", "block"], 2 * shards * blocks
    graphs = index.select("*", every("block", blocks)).repartition(tasks, *cell).groupBy(*cell)
    hits = graphs.cogroup(dealt.repartition(tasks, *cell).groupBy(*cell)).applyInPandas(_asker(k, breadth), "query_id bigint, vec_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
