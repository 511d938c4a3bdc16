"""Autocomplete over a query corpus: prefix and stem postings, inverse-frequency ranking, greedy diversity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Candidates of an input that the greedy pass reads at a time.
POOL = 2000


def words(c: Column | str) -> Column:
    """Distinct tokens that are no stop words."""
    return F.array_distinct(F.filter(T.tokens(c), lambda t: ~t.isin(T.STOPWORDS)))


def postings(corpus: DataFrame) -> DataFrame:
    """``term, qid``: each prefix of two letters or more, marked ``p``, and each stem, marked ``s``, of each query's words."""
    w = corpus.select("qid", F.explode(words("query")).alias("w"))
    lengths = F.when(F.length("w") >= 2, F.sequence(F.lit(2), F.length("w"))).otherwise(F.array().cast("array<int>"))
    prefixes = w.select("qid", F.explode(F.transform(lengths, lambda n: F.concat(F.lit("p"), F.substring(F.col("w"), F.lit(1), n)))).alias("term"))
    return prefixes.union(w.select("qid", F.concat(F.lit("s"), T.stem("w")))).distinct()


def candidates(inputs: DataFrame, index: DataFrame) -> DataFrame:
    """``iid, word, qid`` of corpus queries that every word of an input finds, by prefix or stem."""
    w = inputs.where(F.length(F.array_join(T.tokens("input"), " ")) >= 2)
    w = w.select("iid", F.filter(words("input"), lambda t: F.length(t) >= 2).alias("ws")).where("size(ws) > 0").select("iid", F.size("ws").alias("n"), F.explode("ws").alias("word"))
    asked = w.select("iid", "n", "word", F.explode(F.array(F.concat(F.lit("p"), F.col("word")), F.concat(F.lit("s"), T.stem("word")))).alias("term"))
    hits = asked.join(index, "term").select("iid", "n", "word", "qid").distinct()
    whole = hits.groupBy("iid", "n", "qid").agg(F.count("*").alias("found")).where("found = n").select("iid", "qid")
    return hits.join(whole, ["iid", "qid"]).select("iid", "word", "qid")


def ranked(inputs: DataFrame, corpus: DataFrame, index: DataFrame) -> DataFrame:
    """Candidates with their score: 12 if they start with the input, 6 if they hold it, and each word's weight, twice if it is whole.

    A word's weight is ``log1p(corpus size / queries that it finds)``.
    """
    size = corpus.count()
    found = inputs.select("iid", F.explode(F.filter(words("input"), lambda t: F.length(t) >= 2)).alias("word")).select("word").distinct()
    asked = found.select("word", F.explode(F.array(F.concat(F.lit("p"), F.col("word")), F.concat(F.lit("s"), T.stem("word")))).alias("term"))
    weights = asked.join(index, "term").select("word", "qid").distinct().groupBy("word").agg(F.log1p(F.lit(float(size)) / F.count("*")).alias("weight"))
    texts = corpus.select("qid", "query", F.array_join(T.tokens("query"), " ").alias("norm"), words("query").alias("ws"))
    rows = candidates(inputs, index).join(weights, "word").join(texts, "qid")
    summed = rows.groupBy("iid", "qid", "query", "norm").agg(F.sum(F.col("weight") * F.when(F.array_contains("ws", F.col("word")), 2).otherwise(1)).alias("w"))
    given = inputs.select("iid", F.array_join(T.tokens("input"), " ").alias("asked"))
    score = 12 * F.startswith("norm", "asked").cast("int") + 6 * F.contains("norm", "asked").cast("int") + F.col("w")
    return summed.join(given, "iid").where("norm <> asked").select("iid", "qid", "query", F.round(score, 6).alias("score"))


def diverse(scored: DataFrame, limit: int = 5, pool: int = POOL) -> DataFrame:
    """``iid, rank, qid, query``: the best ``limit`` suggestions of each input, leaving out any whose stems overlap one already chosen by 0.9 of the smaller set.

    Ranked by falling score, length of the query, then id.  The greedy choice folds an input's ranked candidates ``pool`` at a time:
    an input whose pool does not fill the limit goes on with the next candidates that are unlike those it has chosen, until it is
    filled or has no more.  So no task holds more than a pool of an input.
    """
    stems = F.array_distinct(F.transform(words("query"), T.stem))
    order = F.row_number().over(Window.partitionBy("iid").orderBy(F.desc("score"), F.length("query"), "qid"))
    near = lambda a, b: F.size(F.array_intersect(a["stems"], b["stems"])) / F.greatest(F.least(F.size(a["stems"]), F.size(b["stems"])), F.lit(1)) >= 0.9
    step = lambda chosen, c: F.when((F.size(chosen) >= limit) | F.exists(chosen, lambda o: near(o, c)), chosen).otherwise(F.array_append(chosen, c))
    left, so_far, done = scored.select("iid", "qid", "query", "score"), None, []
    while True:
        first = left.withColumn("r", order).where(F.col("r") <= pool).select("iid", F.struct("r", "qid", "query", stems.alias("stems"), "score").alias("c"))
        lists = first.groupBy("iid").agg(F.sort_array(F.collect_list("c")).alias("cs"))
        start = F.slice("cs", 1, 0)
        if so_far is not None:
            lists, start = lists.join(so_far, "iid"), F.col("before")
        folded = lists.select("iid", F.size("cs").alias("n"), F.element_at("cs", -1).alias("last"), F.aggregate("cs", start, step).alias("chosen")).persist()
        more = (F.size("chosen") < limit) & (F.col("n") >= pool)
        done.append(folded.where(~more).select("iid", "chosen"))
        on = folded.where(more)
        if on.isEmpty():
            break
        done.append(on.join(left.groupBy("iid").agg(F.count("*").alias("all")), "iid").where("all <= n").select("iid", "chosen"))
        so_far = on.select("iid", F.col("chosen").alias("before"))
        after = F.struct(-F.col("score"), F.length("query"), F.col("qid")) > F.struct(-F.col("last.score"), F.length("last.query"), F.col("last.qid"))
        rest = left.join(on.select("iid", "last", "chosen"), "iid").where(after).withColumn("c", F.struct(F.lit(0).alias("r"), "qid", "query", stems.alias("stems"), "score"))
        rest = rest.where(~F.exists("chosen", lambda o: near(o, F.col("c"))))
        gone = on.join(rest.select("iid").distinct(), "iid", "left_anti").join(done[-1].select("iid"), "iid", "left_anti")
        done.append(gone.select("iid", "chosen"))
        left = rest.select("iid", "qid", "query", "score")
    chosen = done[0]
    for part in done[1:]:
        chosen = chosen.union(part)
    return chosen.select("iid", F.posexplode("chosen").alias("pos", "c")).select("iid", (F.col("pos") + 1).alias("rank"), "c.qid", "c.query")
