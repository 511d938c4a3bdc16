"""What the operators of this subpackage share: input tables, tables written to cut lineage, columns of input rows."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as ``spark.checkpoint.dir`` names it.

    Where it is unset, a temporary one is made and set, but only if driver and executors are one process; a cluster must name it.
    """
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        there = tempfile.mkdtemp(prefix="tidemill-")
        spark.conf.set("spark.checkpoint.dir", there)
    return there.rstrip("/")


_scratch: list[tuple[list[str], list[DataFrame]]] = []


def written(df: DataFrame, name: str, files: int | None = None, row_group: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again, in so many ``files`` if given.

    Later jobs start from the files, so a lost executor costs no recomputation of what stands before.
    ``files`` is for narrow rows of a known number: many partitions would leave as many tiny files.  ``row_group``
    bounds a row group in bytes where rows are long, so that a reader holds few of them at a time.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemill/{name}-{uuid.uuid4().hex}"
    out = (df if files is None else df.repartition(files)).write.option("compression", "zstd")
    (out if row_group is None else out.option("parquet.block.size", row_group)).parquet(path)
    if _scratch:
        _scratch[-1][0].append(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession):
    """Within it, what ``written`` makes and ``kept`` persists is noted, and given back at its end: for steps whose result is by then written by ``outlasting``."""
    _scratch.append(([], []))
    try:
        yield
    finally:
        paths, frames = _scratch.pop()
        for df in frames:
            df.unpersist()
        for path in paths:
            _delete(spark, path)


def outlasting(df: DataFrame, name: str) -> DataFrame:
    """``written``, but not given back with the steps that led to it."""
    out = written(df, name)
    if _scratch:
        path = _scratch[-1][0].pop()
        if len(_scratch) > 1:
            _scratch[-2][0].append(path)
    return out


def files_for(rows: int, each: int) -> int:
    """Files of about ``each`` rows."""
    return max(1, -(-rows // each))


def forget(spark: SparkSession) -> None:
    """Delete all tables that ``written`` made in the shared folder; results not yet read are lost with them."""
    _delete(spark, f"{shared_dir(spark)}/tidemill")


def kept(df: DataFrame) -> DataFrame:
    """``df`` kept on the executors' disks for the steps that read it again.

    For what one pass over the input gives: a lost executor's part is made again from its own
    input files.  What stands behind a shuffle is ``written`` instead.
    """
    out = df.persist(StorageLevel.DISK_ONLY)
    if _scratch:
        _scratch[-1][1].append(out)
    return out


#: Rows, and bytes, of whole texts that go to a Python worker at a time.
BATCH_ROWS, BATCH_BYTES = 1000, 32 << 20
_BATCH, _BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, with its session's Arrow batches cut to ``BATCH_ROWS`` rows and ``BATCH_BYTES`` bytes if they may be longer: whole texts make long rows.

    Spark reads these settings when a lazy plan runs, which can be long after this call, so they stay; smaller ones are left alone.
    """
    conf = df.sparkSession.conf
    for name, most in ((_BATCH, BATCH_ROWS), (_BYTES, BATCH_BYTES)):
        number, unit = re.fullmatch(r"(-?\d+)\s*([kmgt]?)i?b?", conf.get(name).lower()).groups()
        if not 0 < int(number) << 10 * " kmgt".index(unit or " ") <= most:
            conf.set(name, str(most))
    return df


def tidy(run):
    """An Arrow mapper that gives its freed buffers back to the system when its task ends: workers live on between tasks."""

    def mapper(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return mapper


def shuffle_width(spark: SparkSession) -> int:
    """Partitions of an explicit repartition: the session's own shuffle setting."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hash64(*columns) -> "F.Column":
    """A 52-bit hash of the columns' text that DuckDB computes alike: the first 13 hex digits of the MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *columns)), 1, 13), 16, 10).cast("bigint")


def unused(docs: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to be no column's of ``docs``, in any case."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def row_key(df: DataFrame, seed: int = 0) -> "F.Column":
    """A 64-bit hash of the whole row, nulls and their places included: rows of one key are copies of each other in every column."""
    plain = [F.to_json(F.struct(f.name), {"ignoreNullFields": "false"}) if f.dataType.typeName() in ("array", "map", "struct") else F.col(f.name) for f in df.schema.fields]
    return F.xxhash64(*([F.lit(seed)] if seed else []), *plain, *(F.isnull(f.name) for f in df.schema.fields))
