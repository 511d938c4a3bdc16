"""Connected components of a table of links, as alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import files_for, written

#: Links of a file between rounds.
LINKS_A_FILE = 500_000


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def components(links: DataFrame, left: str = "a", right: str = "b", rounds: int = 60) -> DataFrame:
    """``node, component`` for every end of a link; the component is the smallest node it reaches.

    A round takes grouped minima and joins, so a node with very many links is summed up before
    it is shuffled and its join partition can be split.  The rounds are logarithmic in the size
    of a component; each is written to the shared folder.  Links with a null end, links to
    itself and repeated links are ignored; no links give no rows.
    """
    edges = links.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u <> v").distinct()
    before, files = None, files_for(links.count(), LINKS_A_FILE)
    for _ in range(rounds):
        edges = written(_small_star(_large_star(edges)).where("u <> v").distinct(), "stars", files)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("node")).distinct()
    return nodes.union(roots.select("node", F.col("node").alias("component")))
