"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import hash64, shuffle_width, unused

#: Values of ``hash64`` lie below this.
SPAN = float(1 << 52)
#: Weight of a source when none are given: its share of documents to this power.
POWER = 0.5
#: Means up to ``WHOLE`` are inverted at once, as far as ``exp(-rate)`` is a full double; larger ones as a sum of means of at most ``PIECE``.
WHOLE, PIECE = 700, 500


def target_rates(docs: DataFrame, source_col: str = "source", weights: dict[str, float] | None = None, power: float = POWER, total: float = 1.0) -> DataFrame:
    """``source, n, rate``: how often each document of a source should appear on average.

    ``rate = total * rows * weight / n``, weights normalised to sum 1 and ``total`` the size of
    the mixture against the input.  Without ``weights`` a source's weight is its share of rows
    to ``power``; sources that ``weights`` leaves out have rate 0.  A null source is ``""``.
    """
    sizes = docs.groupBy(F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        raw: Column = F.pow(F.col("n").cast("double"), F.lit(power))
    else:
        pairs = [F.lit(x) for kv in weights.items() for x in (str(kv[0]), float(kv[1]))]
        raw = F.coalesce(F.element_at(F.create_map(*pairs), F.col("source")), F.lit(0.0)) if pairs else F.lit(0.0)
    sizes = sizes.withColumn("w", raw)
    all_w, all_n = sizes.agg(F.sum("w"), F.sum("n")).first()
    if not all_w:
        return sizes.select("source", "n", F.lit(0.0).alias("rate"))
    return sizes.select("source", "n", (F.lit(float(all_n)) * F.col("w") / F.lit(float(all_w)) / F.col("n") * F.lit(float(total))).alias("rate"))


def poisson_steps(rate: Column) -> Column:
    """P(X <= 0), P(X <= 1), ... of a Poisson variable, to rate + 12 * sqrt(rate) + 40, past which nothing of a double is left; rates up to ``WHOLE``."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 40).cast("int") - 1
    start = F.struct(F.exp(-rate).alias("term"), F.array(F.exp(-rate)).alias("cdf"))

    def step(s: Column, k: Column) -> Column:
        term = s["term"] * rate / k
        return F.struct(term.alias("term"), F.array_append(s["cdf"], F.element_at(s["cdf"], -1) + term).alias("cdf"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda s: s["cdf"])


def poisson_pieces(rate: Column) -> Column:
    """How many independent Poisson variables of equal mean are summed for one of mean ``rate``."""
    return F.when(rate <= WHOLE, F.lit(1)).otherwise(F.ceil(rate / PIECE).cast("int"))


#: What ``mix`` adds to a row.
MADE = ["_copy", "_copies", "_rate", "_order"]


def poisson_count(u: Column, steps: Column) -> Column:
    """The Poisson quantile of ``u`` in [0, 1): how many steps are at most ``u``, found by halving the sorted array."""
    halves = F.array(*(F.lit(1 << k) for k in range(10, -1, -1)))
    return F.aggregate(halves, F.lit(0), lambda n, k: F.when((n + k <= F.size(steps)) & (F.get(steps, n + k - 1) <= u), n + k).otherwise(n))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", weights: dict[str, float] | None = None, power: float = POWER, total: float = 1.0, seed: int = 0) -> DataFrame:
    """``docs`` with each row repeated by its Poisson count, in an order that its hash gives.

    Adds ``_copy`` (from 0), ``_copies``, ``_rate`` and ``_order``, the key of the global shuffle, in place of columns of these names; the result is sorted by it.  The
    count inverts the Poisson distribution of mean ``rate`` at ``hash(seed, id) / 2**52``, so a
    rerun or a retried task repeats it; a rate over ``WHOLE`` is the sum of as many variables as
    ``poisson_pieces`` gives, each with a hash seed of its own.  Rates are one row a source, summed before the shuffle,
    and joined as Spark sees fit, so a hot source is neither collected nor cut.

    Null ids hash as ``""``; repeated rows share their id's count; rows of a null source form
    the source ``""``; texts are carried unread.  An empty table gives no rows.
    """
    docs = docs.drop(*MADE)
    rates = target_rates(docs, source_col, weights, power, total)
    counted = with_counts(docs, rates, id_col, source_col, *MADE[1:3], seed)
    return shuffled(counted, id_col, *MADE[:2], MADE[3], seed)


def repeated(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """The mixture of ``mix`` by its default weights, in its order, with the columns of ``docs`` alone, whatever they are called."""
    copy, copies, rate, order = unused(docs, *MADE)
    counted = with_counts(docs, target_rates(docs, source_col), id_col, source_col, copies, rate)
    return shuffled(counted, id_col, copy, copies, order).select(docs.columns)


def with_counts(docs: DataFrame, rates: DataFrame, id_col: str, source_col: str, copies: str, rate: str, seed: int = 0) -> DataFrame:
    """``docs`` with each row's Poisson count ``copies`` and its source's ``rate``; rows of count 0 go."""
    source, pieces, steps = unused(docs, "_source", "_pieces", "_steps")
    parts = poisson_pieces(F.col("rate"))
    rates = rates.select(F.col("source").alias(source), F.col("rate").alias(rate), parts.alias(pieces), poisson_steps(F.col("rate") / parts).alias(steps))
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    keyed = docs.withColumn(source, F.coalesce(F.col(source_col).cast("string"), F.lit(""))).join(rates, source).drop(source)
    drawn = lambda name: poisson_count(hash64(name, key) / SPAN, F.col(steps))
    others = F.aggregate(F.sequence(F.lit(1), F.col(pieces) - 1), F.lit(0), lambda n, k: n + drawn(F.concat(F.lit(f"count{seed}."), k.cast("string"))))
    count = drawn(F.lit(f"count{seed}")) + F.when(F.col(pieces) > 1, others).otherwise(0)
    return keyed.withColumn(copies, count).drop(steps, pieces).where(F.col(copies) > 0)


def shuffled(counted: DataFrame, id_col: str, copy: str, copies: str, order: str, seed: int = 0) -> DataFrame:
    """Each row once for each of its ``copies``, numbered by ``copy``, in the ``order`` of a hash."""
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    rows = counted.withColumn(copy, F.explode(F.sequence(F.lit(0), F.col(copies) - 1)))
    rows = rows.withColumn(order, hash64(F.lit(f"order{seed}"), key, F.col(copy).cast("string")))
    return rows.repartitionByRange(shuffle_width(rows.sparkSession), order, copy).sortWithinPartitions(order, copy)


def mixture_sql(power: float = POWER, seed: int = 0) -> str:
    """DuckDB statement for the rows of ``mix`` over ``documents`` with the default weights."""
    h = "('0x' || substr(md5({}), 1, 13))::bigint"
    return f"""
WITH RECURSIVE sizes AS (SELECT coalesce(source, '') AS source, count(*) AS n FROM documents GROUP BY 1),
rates AS (SELECT source, (SELECT sum(n) FROM sizes) * pow(n::double, {power}) / (SELECT sum(pow(n::double, {power})) FROM sizes) / n AS rate FROM sizes),
cdfs(source, rate, k, term, cdf) AS (
  SELECT source, rate, 0, exp(-rate), exp(-rate) FROM rates
  UNION ALL SELECT source, rate, k + 1, term * rate / (k + 1), cdf + term * rate / (k + 1) FROM cdfs WHERE k + 1 < ceil(rate + 12 * sqrt(rate) + 40)),
lists AS (SELECT source, any_value(rate) AS rate, list(cdf ORDER BY k) AS cdfs FROM cdfs GROUP BY source),
counted AS (SELECT d.doc_id, d.source, l.rate, len(list_filter(l.cdfs, lambda c: c <= {h.format(f"'count{seed}:' || d.doc_id")} / {SPAN:.0f}.0)) AS n
  FROM documents d JOIN lists l ON l.source = coalesce(d.source, ''))
SELECT doc_id, source, round(rate, 6) AS rate, n AS n_copies, c AS copy_no, {h.format(f"'order{seed}:' || doc_id || ':' || c")} AS order_key
FROM (SELECT *, unnest(range(n))::int AS c FROM counted WHERE n > 0)"""
