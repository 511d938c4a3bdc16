"""Bounded top-k by impacts: only chunks that can enter a query's best are scored.

A score is a sum over a query's terms of ``gain * s``, the term's gain for the query and its strength in the chunk, and of what the
chunk's heading adds.  Postings are counted by term and level of strength.  About a block of each term's strongest ones
give a query first hits, whose k-th score is a floor.  A query's frequent terms then share out what lies below the
floor as cuts: a chunk that is over no cut cannot reach the floor, so terms that are cut whole are left out, and the postings of the
others meet the cut one by one, read off the chunks.  What is left is scored in full.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored

#: Postings of a block, about, and levels of strength from zero to a term's largest.
BLOCK, LEVELS = 128, 16
#: Levels of strength for which its double makes one, where first hits are chosen.
OCTAVE = 8
#: Share of the chunks that a query's postings over whole cuts may make up before cuts are halved.
FEW = 0.01
#: What rounding to six places can move a score by, twice over.
SLACK = 2e-6
#: Rows of asked-for terms that are sent to all tasks; more are shuffled.
BROADCAST_TERMS = 500_000

CHUNK = ["document", "ord"]


def small(asked: DataFrame) -> DataFrame:
    """A table of asked-for terms, broadcast if it is counted small."""
    return F.broadcast(asked) if asked.count() <= BROADCAST_TERMS else asked


@dataclass
class Index:
    """``chunks``: ``document, ord, section, terms`` (map of an asked-for term to its strength, which is positive).  ``queries``: ``qid, q`` (array of ``term, gain``) and what ``score``
    reads besides.  ``heads``: ``qid, section, head`` and what ``score`` reads besides, none negative.  ``score`` is a column over one row of all three; it may be
    less than the sum of gains and ``head``, never more.  ``bare``: whether a heading makes a hit without any term of the text.
    """

    chunks: DataFrame
    queries: DataFrame
    heads: DataFrame
    score: Column
    bare: bool = False


def summed() -> Column:
    """The terms' part of a score."""
    return F.aggregate("q", F.lit(0.0), lambda n, x: n + x["gain"] * F.coalesce(F.element_at("terms", x["term"]), F.lit(0.0)))


def impact_blocks(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Postings in blocks, ``term, level, part, most, postings``, and ``term, df, strongest`` of every term.

    A block holds one level of a term's strengths, or one of the parts that its chunks are dealt to where a level has
    more than ``BLOCK``: a hot term is gathered by no single task.
    """
    rows = chunks.select("document", "ord", F.explode("terms").alias("term", "s"))
    terms = stored(rows.groupBy("term").agg(F.count("*").alias("df"), F.max("s").alias("strongest")), "terms")
    level = F.least(F.floor(F.col("s") / F.col("strongest") * LEVELS), F.lit(LEVELS - 1)).cast("int")
    rows = rows.join(small(terms.select("term", "strongest")), "term").select("term", level.alias("level"), "document", "ord", "s")
    parts = small(rows.groupBy("term", "level").agg(F.ceil(F.count("*") / BLOCK).alias("parts")))
    placed = rows.join(parts, ["term", "level"]).withColumn("part", F.pmod(F.xxhash64("document", "ord"), F.col("parts")))
    blocks = placed.groupBy("term", "level", "part").agg(F.max("s").alias("most"), F.sort_array(F.collect_list(F.struct("document", "ord", "s"))).alias("postings"))
    return stored(blocks, "blocks"), terms


def _scored(pairs: DataFrame, index: Index) -> DataFrame:
    """``qid, document, ord, score`` in full; ``pairs`` without a shared term, or without a heading where that counts, are no hits."""
    rows = pairs.join(index.chunks, CHUNK).join(small(index.queries), "qid").join(index.heads, ["qid", "section"], "left")
    shares = F.exists("q", lambda x: F.element_at("terms", x["term"]).isNotNull())
    hit = shares | F.col("head").isNotNull() if index.bare else shares
    return rows.where(hit).select("qid", "document", "ord", F.round(index.score, 6).alias("score"))


def ranked(scored: DataFrame, most: int, least: float | None = None, ties: tuple[str, ...] = ("document", "ord")) -> DataFrame:
    """The ``most`` best of each query, ties in input order; a ranked limit, applied before the shuffle too."""
    kept = scored if least is None else scored.where(F.col("score") >= least)
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), *ties))
    return kept.withColumn("rank", rank).where(F.col("rank") <= most)


def candidates(index: Index, most: int, least: float | None = None) -> DataFrame:
    """``qid, document, ord``: pairs that hold the ``most`` best of each query, and few others.

    Frequent terms are cut first: going from the most frequent, each takes its largest impact from the room, which is the floor less the most that a
    heading can add, and the first that does not fit takes the rest.  Where that would leave many postings, cuts take half of the room only, and a
    chunk's impacts must pass their cuts by the other half together.  A chunk of a score at the floor or above does, or has
    its floor from a heading alone: of such chunks the first of each section, in input order, are enough.
    """
    postings = index.chunks.select(*CHUNK, F.explode("terms").alias("term", "s"))
    level = F.floor(F.log2("s") * OCTAVE).cast("int").alias("level")
    levels = stored(postings.groupBy("term", level).agg(F.count("*").alias("n"), F.max("s").alias("strongest")), "levels")
    terms = levels.groupBy("term").agg(F.sum("n").alias("df"), F.max("strongest").alias("strongest"))
    asked = index.queries.select("qid", F.explode("q").alias("x")).select("qid", "x.term", "x.gain").join(small(terms), "term")
    asked = stored(asked.select("qid", "term", "gain", "df", (F.col("gain") * F.col("strongest")).alias("largest")), "asked")

    above = F.coalesce(F.sum("n").over(Window.partitionBy("term").orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    strong = levels.withColumn("above", above).where(F.col("above") < BLOCK).select("term", "level", F.ceil(F.col("n") / BLOCK).alias("parts"))
    strong = stored(strong.join(small(asked.select("qid", "term")), "term").groupBy("term", "level", "parts").agg(F.collect_list("qid").alias("qids")), "strong")
    first = postings.select(*CHUNK, "term", level).join(small(strong), ["term", "level"]).where(F.pmod(F.xxhash64(*CHUNK), F.col("parts")) == 0)
    seeds = first.select(F.explode("qids").alias("qid"), *CHUNK)
    if index.bare:
        place = F.row_number().over(Window.partitionBy("section").orderBy(*CHUNK))
        heads = index.chunks.select("section", *CHUNK).join(index.heads.select("section").distinct(), "section", "left_semi").withColumn("_k", place).where(F.col("_k") <= most)
        seeds = seeds.union(heads.join(index.heads.select("qid", "section"), "section").select("qid", *CHUNK))
    seeds = stored(seeds.distinct(), "seeds")

    floors = ranked(_scored(seeds, index), most, least).groupBy("qid").agg(F.min("score").alias("floor"), F.max("rank").alias("n")).where(F.col("n") == most).select("qid", "floor")
    heads = index.heads.groupBy("qid").agg(F.max("head").alias("heading"))
    room = index.queries.select("qid").join(floors, "qid", "left").join(heads, "qid", "left")
    floor = F.coalesce("floor", F.lit(0.0)) if least is None else F.greatest(F.coalesce("floor", F.lit(0.0)), F.lit(float(least)))
    room = room.select("qid", (floor - F.coalesce("heading", F.lit(0.0)) - SLACK).alias("room"))
    asked = asked.join(room, "qid")
    order = Window.partitionBy("qid").orderBy(F.desc("df"), "term").rowsBetween(Window.unboundedPreceding, -1)
    asked = asked.withColumn("before", F.coalesce(F.sum("largest").over(order), F.lit(0.0)))
    cut = lambda room: F.greatest(F.lit(0.0), F.least(F.col("largest"), room - F.col("before")))
    whole = Window.partitionBy("qid")
    left = F.sum(F.when(cut(F.col("room")) < F.col("largest"), F.col("df")).otherwise(0)).over(whole)
    share = F.when(left <= FEW * index.chunks.count(), 1.0).otherwise(0.5)
    cuts = asked.withColumn("share", share).withColumn("cut", cut(F.col("room") * F.col("share")))
    cuts = cuts.withColumn("need", F.col("room") - F.sum("cut").over(whole)).where("cut < largest").select("qid", "term", "gain", "cut", "need")
    cuts = stored(cuts, "cuts")
    over = postings.join(small(cuts), "term").select("qid", *CHUNK, "need", (F.col("gain") * F.col("s") - F.col("cut")).alias("over")).where("over > 0")
    enough = over.groupBy("qid", *CHUNK, "need").agg(F.sum("over").alias("over")).where(F.col("over") >= F.col("need"))
    return enough.select("qid", *CHUNK).union(seeds).distinct()


def bounded_top(index: Index, most: int, least: float | None = None) -> DataFrame:
    """``qid, document, ord, score, rank``: the exact ``most`` best chunks of each query with a score of ``least`` or more, ties in input order."""
    return ranked(_scored(candidates(index, most, least), index), most, least)
