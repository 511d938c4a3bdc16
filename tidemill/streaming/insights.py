"""The insight queue and the guards of pending ids as keyed state with timers, each with a batch twin.

State is a few scalars a dialog, whatever comes in; it goes by a timer once the dialog is idle.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

KINDS = ("summary", "classification")
RETRY_MS, IDLE_MS = 5 * 60_000, 90 * 24 * 3_600_000
ATTEMPTS = "id bigint, revision bigint, kind string, attempt int, ms bigint, ok boolean, value string"
#: Attempts go out as rows, which are written by the batch; a frame a dialog costs more than what is in it.
ATTEMPT = Row("id", "revision", "kind", "attempt", "ms", "ok", "value")
VERDICTS = "id bigint, seq bigint, verdict string"
#: ``seen`` is when the dialog's last version came, ``due`` when the next attempt is, null once nothing is missing.
JOB = ["revision", "seen", "attempt", "due", "summary", "classification"]


def _timed(spark: SparkSession) -> None:
    """State with timers needs the RocksDB provider, which this sets for the session's streams that start later."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Insights(StatefulProcessor):
    """Tries what is missing of a dialog's newest version, at once and then every ``retry_ms`` until nothing is."""

    def __init__(self, work: Callable[[str, int, int, int], str], retry_ms: int, idle_ms: int):
        self.work, self.retry_ms, self.idle_ms = work, retry_ms, idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getValueState("job", "revision bigint, seen bigint, attempt int, due bigint, summary boolean, classification boolean")

    def _try(self, key: int, job: dict, at: int) -> list[tuple]:
        """One attempt at each missing kind: what one of them raises stops neither the other nor the stream."""
        out, attempt = [], job["attempt"] + 1
        for kind in KINDS:
            if job[kind]:
                continue
            try:
                value, ok = self.work(kind, key, job["revision"], attempt), True
            except Exception:  # noqa: BLE001  whatever a model raises is tried again
                value, ok = None, False
            job[kind] = ok
            out.append((key, job["revision"], kind, attempt, at, ok, value))
        job["attempt"], job["due"] = attempt, None if all(job[k] for k in KINDS) else at + self.retry_ms
        return out

    def _until(self, key: int, job: dict, end: int) -> list[tuple]:
        out = []
        while job["due"] is not None and job["due"] < end:
            out += self._try(key, job, job["due"])
        return out

    def _wake(self, job: dict | None) -> int | None:
        return job and (job["seen"] + self.idle_ms if job["due"] is None else min(job["due"], job["seen"] + self.idle_ms))

    def _keep(self, before: int | None, job: dict | None) -> None:
        """Hold ``job``, with one timer: its next attempt, or its end."""
        wake = self._wake(job)
        if before is not None and before != wake:
            self.handle.deleteTimer(before)
        if job is None:
            self.held.clear()
            return
        self.held.update(tuple(job[c] for c in JOB))
        if before != wake:
            self.handle.registerTimer(wake)

    def _job(self) -> dict | None:
        held = self.held.get()
        return held and dict(zip(JOB, held, strict=True))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        job, out, own = self._job(), [], int(key[0])
        before = self._wake(job)
        for ms, revision in sorted((row.ms, row.revision) for row in rows):
            if job and ms > job["seen"] + self.idle_ms:
                out += self._until(own, job, job["seen"] + self.idle_ms)
                job = None
            if job and revision <= job["revision"]:
                continue
            if job:
                out += self._until(own, job, ms)
            job = {"revision": revision, "seen": ms, "attempt": 0, "due": ms} | dict.fromkeys(KINDS, False)
            out += self._try(own, job, ms)
        self._keep(before, job)
        yield from itertools.starmap(ATTEMPT, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        job, mark, own = self._job(), timerValues.getCurrentWatermarkInMs(), int(key[0])
        if job is None:
            return
        end = job["seen"] + self.idle_ms
        out = self._until(own, job, min(mark, end))
        if end < mark:
            job = None
        # the timer that woke this is spent: it is no longer there to be deleted
        if job and job["due"] == expiredTimerInfo.getExpiryTimeInMs():
            out += self._try(own, job, job["due"])
        self._keep(None, job)
        yield from itertools.starmap(ATTEMPT, out)


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.strip().split()[0] for c in schema.split(",")])


def _stamped(attempts: DataFrame) -> DataFrame:
    return attempts.select("id", "revision", "kind", "attempt", F.timestamp_millis("ms").alias("at"), "ok", "value")


def insight_stream(closed: DataFrame, work: Callable[[str, int, int, int], str], late: str = "1 hour", retry_ms: int = RETRY_MS, idle_ms: int = IDLE_MS) -> DataFrame:
    """Each attempt at the insights of a stream of closed dialogs ``id, revision, at``: ``id, revision, kind, attempt, at, ok, value``.

    ``work(kind, id, revision, attempt)`` returns an insight or raises.  A failed kind is tried again
    ``retry_ms`` later in event time, without end; a newer revision takes an older one's place, and
    one that is not newer is ignored.  Retries that fall before the next revision are made even if both
    come in one batch.  What is later than ``late`` is dropped.  A dialog whose last revision is ``idle_ms``
    old is forgotten, with its retries.  The same files in the same batches give the same attempts after a restart.
    """
    _timed(closed.sparkSession)
    rows = closed.select(F.col("id").cast("bigint").alias("id"), F.col("revision").cast("bigint").alias("revision"), F.unix_millis("at").alias("ms"), F.col("at").cast("timestamp").alias("at"))
    rows = rows.where("id is not null and revision is not null and at is not null").withWatermark("at", late)
    return _stamped(rows.groupBy("id").transformWithState(Insights(work, retry_ms, idle_ms), ATTEMPTS, "append", "EventTime"))


def insight_batch(closed: DataFrame, needed: dict[str, Column], late_ms: int = 3_600_000, retry_ms: int = RETRY_MS) -> DataFrame:
    """``id, revision, kind, attempt, at, ok`` that the stream makes of the same rows where ``needed`` attempts bring a kind's success, and no dialog goes idle.

    The newest revision's retries end at the watermark, any other's at the next revision.
    """
    rows = closed.select("id", "revision", F.unix_millis("at").alias("ms")).where("id is not null and revision is not null and ms is not null")
    order = Window.partitionBy("id").orderBy("ms", "revision")
    best = F.max("revision").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("best", best).where("best is null or revision > best").withColumn("next", F.lead("ms").over(order))
    mark = closed.agg(F.unix_millis(F.max("at")) - late_ms).scalar()
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), n.cast("bigint").alias("needed")) for k, n in needed.items())))
    rows = rows.select("id", "revision", "ms", F.coalesce("next", mark).alias("end"), kinds.alias("k"))
    # attempts whose time is before the end, the first one whatever it is
    possible = F.greatest(F.lit(1), F.ceil((F.col("end") - F.col("ms")) / F.lit(retry_ms)))
    rows = rows.withColumn("attempt", F.explode(F.sequence(F.lit(1), F.least("k.needed", possible).cast("int"))))
    return rows.select("id", "revision", "k.kind", "attempt", F.timestamp_millis(F.col("ms") + (F.col("attempt") - 1) * retry_ms).alias("at"), (F.col("attempt") == F.col("k.needed")).alias("ok"))


class Guards(StatefulProcessor):
    """Lets a message through by what its dialog has pending."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getValueState("pending", "closed boolean, clarification string, suggestion string, seen bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out, before = [], self.held.get()[3] if self.held.exists() else None
        closed, clarification, suggestion, seen = self.held.get() if before is not None else (False, None, None, 0)
        for row in pd.concat(list(rows)).sort_values(["ms", "seq"]).itertuples():
            if before is not None and row.ms > seen + self.idle_ms:
                closed, clarification, suggestion = False, None, None
            own = [None if pd.isna(v) else v for v in (row.clarification_id, row.suggestion_id)]
            seen = max(seen, int(row.ms))
            if row.kind == "message":
                out.append((int(key[0]), int(row.seq), verdict(closed, clarification, suggestion, *own)))
            elif row.kind == "reply" and not closed:
                clarification, suggestion = own
            elif row.kind == "close":
                closed, clarification = True, None
        self.held.update((closed, clarification, suggestion, seen))
        if before is not None:
            self.handle.deleteTimer(before + self.idle_ms)
        self.handle.registerTimer(seen + self.idle_ms)
        yield _frame(out, VERDICTS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.held.clear()
        yield _frame([], VERDICTS)


def verdict(closed: bool, clarification: str | None, suggestion: str | None, asked: str | None, taken: str | None) -> str:
    """``accepted``, or why a message is refused that answers clarification ``asked`` or takes suggestion ``taken``."""
    if closed:
        return "closed"
    if asked is not None and taken is not None:
        return "both ids"
    if asked is not None and asked != clarification:
        return "clarification gone"
    return "suggestion gone" if taken is not None and taken != suggestion else "accepted"


def guard_stream(events: DataFrame, late: str = "1 hour", idle_ms: int = IDLE_MS) -> DataFrame:
    """``id, seq, verdict`` of each message in a stream of ``id, at, seq, kind, clarification_id, suggestion_id``.

    A ``reply`` replaces both pending ids, null ones included; a ``close`` refuses every message after
    it.  Batches must come in the order of time, as one dialog's do; what is later than ``late`` is dropped.
    """
    _timed(events.sparkSession)
    rows = events.select(F.col("id").cast("bigint").alias("id"), F.col("seq").cast("bigint").alias("seq"), "kind", "clarification_id", "suggestion_id", F.unix_millis("at").alias("ms"), F.col("at").cast("timestamp").alias("at"))
    rows = rows.where("id is not null and seq is not null and at is not null").withWatermark("at", late)
    return rows.groupBy("id").transformWithStateInPandas(Guards(idle_ms), VERDICTS, "append", "EventTime")


def guard_batch(events: DataFrame) -> DataFrame:
    """The stream's verdicts by a window: the last reply before a message says what is pending."""
    before = Window.partitionBy("id").orderBy("at", "seq").rowsBetween(Window.unboundedPreceding, -1)
    offered = F.last(F.when(F.col("kind") == "reply", F.struct("clarification_id", "suggestion_id")), ignorenulls=True).over(before)
    closed = F.coalesce(F.max(F.col("kind") == "close").over(before), F.lit(False))
    asked, taken = F.col("clarification_id"), F.col("suggestion_id")
    said = (
        F.when(F.col("closed"), "closed").when(asked.isNotNull() & taken.isNotNull(), "both ids")
        .when(asked.isNotNull() & ~F.coalesce(asked == F.col("offered.clarification_id"), F.lit(False)), "clarification gone")
        .when(taken.isNotNull() & ~F.coalesce(taken == F.col("offered.suggestion_id"), F.lit(False)), "suggestion gone").otherwise("accepted")
    )
    rows = events.where("id is not null and seq is not null and at is not null").withColumn("offered", offered).withColumn("closed", closed)
    return rows.where("kind = 'message'").select("id", "seq", said.alias("verdict"))
