"""Daily audits: the trailing window, sample checks, greedy packing into batches, and rating sums."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_ITEMS, MOST_CHARS = 100, 200_000


def window(rows: DataFrame, stamp: str, end: dt.datetime, hours: int = 24) -> DataFrame:
    """Rows of the ``hours`` before ``end``, half open."""
    start = end - dt.timedelta(hours=hours)
    return rows.where((F.col(stamp) >= F.lit(start)) & (F.col(stamp) < F.lit(end)))


def checks(dialogs: DataFrame) -> DataFrame:
    """Per dialog of ``conv_id, role, text``: both roles there, messages in range, characters."""
    return dialogs.groupBy("conv_id").agg(
        F.count("*").alias("n_messages"), F.sum(F.length("text")).cast("bigint").alias("n_chars"), (F.bool_or(F.col("role") == "user") & F.bool_or(F.col("role") == "assistant")).alias("both_roles"),
        (F.min(F.length("text")) >= 1).alias("none_empty"),
    )


def _packer(most_items: int, most_chars: int):
    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        period, items, chars, now = None, 0, 0, 0
        for pdf in frames:
            batches = []
            for own, size in zip(pdf["period"].tolist(), pdf["size"].tolist(), strict=True):
                if own != period:
                    period, items, chars, now = own, 0, 0, 0
                elif items and (items >= most_items or chars + size > most_chars):
                    now, items, chars = now + 1, 0, 0
                items, chars = items + 1, chars + size
                batches.append(now)
            yield pdf[["period", "id", "size"]].assign(batch=batches)

    return pack


def pack(dialogs: DataFrame, most_items: int = MOST_ITEMS, most_chars: int = MOST_CHARS) -> DataFrame:
    """``period, id, size, batch``: dialogs of a period in the order of ``stamp`` and ``id``, a new batch before the item that would pass either limit.

    The batches of a period depend on one another, so a period's rows come together; they are sorted by Spark and streamed
    past three numbers, so a period of any size fits in a task.
    """
    rows = dialogs.select("period", F.col("stamp").cast("string").alias("stamp"), "id", F.col("size").cast("bigint").alias("size"))
    rows = rows.repartition("period").sortWithinPartitions("period", "stamp", "id")
    return rows.mapInPandas(_packer(most_items, most_chars), "period date, id bigint, size bigint, batch int")


def bisect(batches: DataFrame, too_large: Column) -> DataFrame:
    """Halve the batches that a receiver refuses, by the order of ids, until none is or one dialog is left; ``part`` is the path of halves."""
    out = batches.withColumn("part", F.lit(""))
    key = ["period", "batch", "part"]
    for _ in range(8):  # a batch has at most 100 items
        n, r = F.count("*").over(Window.partitionBy(*key)), F.row_number().over(Window.partitionBy(*key).orderBy("id"))
        total = F.sum("size").over(Window.partitionBy(*key))
        marked = out.withColumn("n", n).withColumn("r", r).withColumn("total", total)
        out = marked.withColumn("part", F.when(too_large & (F.col("n") > 1), F.concat("part", F.when(F.col("r") <= F.col("n") / 2, "a").otherwise("b"))).otherwise(F.col("part"))).drop("n", "r", "total")
    return out


def ratings(rows: DataFrame, keys: list[str]) -> DataFrame:
    count = lambda v: F.count_if(F.col("rating") == v).alias(v)
    return rows.groupBy(*keys).agg(count("complete"), count("partial"), count("irrelevant"))


def selection(rows: DataFrame, as_of: dt.date, days: int, newest: int = 500) -> DataFrame:
    """Rated dialogs of the last ``days`` among the ``newest`` ones: the cut comes first."""
    cut = rows.orderBy(F.desc("closed_at"), F.desc("id")).limit(newest)
    return cut.where(F.col("rating").isNotNull() & (F.col("closed_at") >= F.lit(str(as_of - dt.timedelta(days=days))).cast("timestamp")))


def last_rated(rows: DataFrame, most: int, newest: int = 500) -> DataFrame:
    """The ``most`` newest rated dialogs among the ``newest`` ones: the cut comes first."""
    cut = rows.orderBy(F.desc("closed_at"), F.desc("id")).limit(newest)
    return cut.where(F.col("rating").isNotNull()).orderBy(F.desc("closed_at"), F.desc("id")).limit(most)


def sample_faults(dialogs: DataFrame, most: int = MOST_ITEMS, most_chars: int = MOST_CHARS) -> DataFrame:
    """``batch, n_dialogs, n_chars, faults``: what keeps a batch of ``batch, id, role, text`` rows from being sent; no faults, and it may go.

    Ids longer than 100 characters, dialogs without both roles, with under 2 or over 200 messages or a message that is empty or over
    12 000 characters, more than ``most`` dialogs, more than ``most_chars`` characters.
    """
    size = F.length(F.coalesce("text", F.lit("")))
    one = dialogs.groupBy("batch", "id").agg(
        F.count("*").alias("n"), F.sum(size).alias("chars"), (F.bool_or(F.col("role") == "user") & F.bool_or(F.col("role") == "assistant")).alias("both"), F.bool_and(size.between(1, 12_000)).alias("sized"),
    )
    good = lambda c: F.bool_and(F.coalesce(c, F.lit(False)))
    per = one.groupBy("batch").agg(
        F.count("*").alias("n_dialogs"), F.sum("chars").cast("bigint").alias("n_chars"), good(F.length(F.col("id").cast("string")) <= 100).alias("ids"), good(F.col("both")).alias("roles"),
        good(F.col("n").between(2, 200)).alias("messages"), good(F.col("sized")).alias("texts"),
    )
    checks = {"ids": F.col("ids"), "roles": F.col("roles"), "messages": F.col("messages"), "texts": F.col("texts"), "dialogs": F.col("n_dialogs") <= most, "characters": F.col("n_chars") <= most_chars}
    faults = F.array_join(F.filter(F.array(*(F.when(~ok, F.lit(name)) for name, ok in checks.items())), lambda x: x.isNotNull()), " ")
    return per.select("batch", "n_dialogs", "n_chars", faults.alias("faults"))


def next_run(now: Column, at: str, zone: str) -> Column:
    """The next time a zone's clock shows ``at``, in UTC; a clock change keeps the wall time."""
    local = F.from_utc_timestamp(now, zone)
    today = F.to_timestamp(F.concat(F.date_format(local, "yyyy-MM-dd"), F.lit(f" {at}:00")))
    tomorrow = F.to_timestamp(F.concat(F.date_format(F.date_add(F.to_date(local), 1), "yyyy-MM-dd"), F.lit(f" {at}:00")))
    return F.to_utc_timestamp(F.when(local < today, today).otherwise(tomorrow), zone)


def zone_label(stamp: Column, zone: str) -> Column:
    return F.concat(F.date_format(F.from_utc_timestamp(stamp, zone), "dd.MM.yyyy HH:mm:ss"), F.lit(f" {zone}"))
