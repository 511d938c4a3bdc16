"""A versioned store of dialogs: every write is a new version, the highest revision is the current one, and a write names the revision it builds on."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ingest import conflicts, latest

#: Columns that are derived from a closed dialog, and how long after a failure they are tried again.
DERIVED = ["summary", "topic"]
RETRY_MINUTES, TRIES = 5, 3
VERSIONS = "id string, revision bigint, status string, closed boolean, body string, summary string, topic string, updated_at timestamp, deleted boolean"


class Conflict(Exception):
    """Some writes name a revision that is no longer the current one."""


def is_object_id(c: Column) -> Column:
    return F.coalesce(c.rlike("^[0-9a-fA-F]{24}$"), F.lit(False))


def by_id(rows: DataFrame, key: str, sought: str) -> DataFrame:
    """The row of an id; none for one that is malformed, without reading anything."""
    ok = len(sought) == 24 and all(c in "0123456789abcdefABCDEF" for c in sought)
    return rows.where(F.col(key) == sought) if ok else rows.limit(0)


def opened(ids: DataFrame, stored: DataFrame, at: Column) -> DataFrame:
    """First versions of dialogs that the store does not have: open, empty, revision 0."""
    new = ids.select("id").distinct().join(stored.select("id"), "id", "left_anti")
    none = F.lit(None).cast("string")
    return new.select("id", F.lit(0).cast("bigint").alias("revision"), F.lit("open").alias("status"), F.lit(False).alias("closed"), F.lit("").alias("body"), none.alias("summary"), none.alias("topic"), at.alias("updated_at"), F.lit(False).alias("deleted"))


def saved(writes: DataFrame, derived: list[str] = DERIVED) -> DataFrame:
    """Next versions of writes (``id, expected, status, closed, ...``): the revision goes up by one; a write that closes has its derived columns wiped."""
    wiped = {c: F.when(F.col("closed"), F.lit(None)).otherwise(F.col(c)).cast("string") for c in derived}
    return writes.withColumns({"revision": F.col("expected") + 1, **wiped}).drop("expected")


def with_derived(current: DataFrame, deltas: DataFrame, derived: list[str] = DERIVED) -> DataFrame:
    """``current`` with derived columns from ``deltas`` (``id, revision`` and any of them) where the dialog is closed and the revision is the same; all else, ``updated_at`` too, stays."""
    have = [c for c in derived if c in deltas.columns]
    new = deltas.select("id", "revision", *(F.col(c).alias(f"_{c}") for c in have)).dropDuplicates(["id", "revision"]).withColumn("_given", F.lit(True))
    given = F.col("closed") & F.col("_given").isNotNull()
    out = current.join(new, ["id", "revision"], "left").withColumns({c: F.when(given, F.coalesce(f"_{c}", c)).otherwise(F.col(c)) for c in have})
    return out.select(current.columns)


def retry_at(failed: Column, minutes: int = RETRY_MINUTES) -> Column:
    return failed + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes))


class Store(Protocol):
    """What a conversation store can do; every result is a DataFrame."""

    def create(self, ids: list[str]) -> DataFrame: ...
    def get(self, dialog_id: str) -> DataFrame: ...
    def list(self, most: int = 100) -> DataFrame: ...
    def closed(self) -> DataFrame: ...
    def save(self, writes: DataFrame) -> int: ...
    def save_derived(self, deltas: DataFrame) -> int: ...
    def pending(self, most: int = 10) -> DataFrame: ...
    def delete(self, dialog_id: str) -> bool: ...
    def delete_all(self) -> int: ...


class ParquetStore:
    """The store as Parquet files of versions: writes append, readers take the highest revision of each dialog.

    One writer at a time: a check of revisions and the append after it are two jobs.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _append(self, rows: DataFrame) -> None:
        columns = [f.split()[0] for f in VERSIONS.split(", ")]
        rows.select(columns).write.mode("append").parquet(self.path)

    def versions(self) -> DataFrame:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        there = hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop)
        return self.spark.read.schema(VERSIONS).parquet(self.path) if there else self.spark.createDataFrame([], VERSIONS)

    def current(self) -> DataFrame:
        order = self.versions().withColumn("_order", F.struct("revision", "updated_at", "deleted", F.col("summary").isNotNull(), F.col("topic").isNotNull()))
        return latest(order, ["id"], "_order").drop("_order").where(~F.coalesce("deleted", F.lit(False)))

    def create(self, ids: list[str]) -> DataFrame:
        made = opened(self.spark.createDataFrame([(i,) for i in ids], "id string").where(is_object_id(F.col("id"))), self.versions(), F.current_timestamp())
        self._append(made)
        return self.current().where(F.col("id").isin(ids))

    def get(self, dialog_id: str) -> DataFrame:
        return by_id(self.current(), "id", dialog_id)

    def list(self, most: int = 100) -> DataFrame:
        if not 1 <= most <= 500:
            raise ValueError("the limit must be from 1 to 500")
        return self.current().orderBy(F.desc("updated_at"), F.desc("id")).limit(most)

    def closed(self) -> DataFrame:
        return self.current().where("closed")

    def save(self, writes: DataFrame) -> int:
        """Append the next versions of ``id, expected, status, closed, body, summary, topic`` and tell how many; raise ``Conflict`` and append nothing if any builds on another revision."""
        writes = writes.dropDuplicates(["id"])
        if not conflicts(writes, self.current()).isEmpty():
            raise Conflict("a write builds on a revision that is not the current one")
        self._append(saved(writes).withColumn("updated_at", F.current_timestamp()).withColumn("deleted", F.lit(False)))
        return writes.count()

    def save_derived(self, deltas: DataFrame) -> int:
        now = self.current()
        hit = now.join(deltas.select("id", "revision").distinct(), ["id", "revision"], "left_semi").where("closed")
        n = hit.count()
        if n:
            self._append(with_derived(hit, deltas))
        return n

    def pending(self, most: int = 10) -> DataFrame:
        """Closed dialogs that lack a derived column, longest closed first."""
        return self.closed().where(" or ".join(f"{c} is null" for c in DERIVED)).orderBy("updated_at", "id").limit(most)

    def _tombstones(self, rows: DataFrame) -> int:
        n = rows.count()
        if n:
            self._append(rows.withColumn("deleted", F.lit(True)).withColumn("revision", F.col("revision") + 1))
        return n

    def delete(self, dialog_id: str) -> bool:
        return self._tombstones(self.get(dialog_id)) > 0

    def delete_all(self) -> int:
        return self._tombstones(self.current())


def on_demand(store: Store, dialog_id: str, derive: Callable[[DataFrame], DataFrame], tries: int = TRIES) -> DataFrame:
    """A dialog with its derived columns, made by ``derive`` if they are not there: stored for a closed dialog, given but not stored for an open one.

    If the dialog moves on meanwhile, it is read and derived again, ``tries`` times in all; then ``Conflict`` is raised.
    """
    for _ in range(tries):
        now = store.get(dialog_id)
        row = now.first()
        if row is None or all(row[c] is not None for c in DERIVED):
            return now
        deltas = derive(now)
        if not row["closed"]:
            return now.drop(*DERIVED).join(deltas.drop("revision"), "id")
        if store.save_derived(deltas):
            return store.get(dialog_id)
    raise Conflict(f"{dialog_id} changed {tries} times")


def can_rate(messages: DataFrame, keys: list[str], closed: Column, handed_off: Column, rated: Column) -> DataFrame:
    """``keys, can_rate, can_contact``: a dialog can be rated once it is over and holds a real answer; a specialist can be called while it is open.

    ``messages`` has ``keys, role, kind, text, is_card`` and what the conditions name, alike in all rows of a dialog.
    """
    real = (F.col("role") == "assistant") & (F.col("kind") == "answer") & ~F.col("is_card") & (F.trim("text") != "")
    per = messages.groupBy(*keys).agg(F.max(real).alias("real"), F.max(closed).alias("closed"), F.max(handed_off).alias("handed"), F.max(rated).alias("rated"))
    return per.select(*keys, (~F.col("rated") & (F.col("closed") | F.col("handed")) & F.col("real")).alias("can_rate"), (~F.col("closed") & ~F.col("handed")).alias("can_contact"))
