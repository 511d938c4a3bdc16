"""Knowledge ingestion: ordering, chunking, sections, forward fill, round-robin corpora and hash-keyed inserts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType


def assign_order(rows: DataFrame, keys: list[str], position: str, name: str = "ord") -> DataFrame:
    """Number rows from 0 within each section, by position."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(position)) - 1)


def fixed_chunks(rows: DataFrame, keys: list[str], text: str, size: int = 400, overlap: int = 40) -> DataFrame:
    """Overlapping pieces of ``size`` characters, ``start`` from 0; empty texts give none, no piece is covered by the one before."""
    step, n = size - overlap, F.length(text)
    starts = F.when(n > 0, F.sequence(F.lit(0), F.greatest(F.lit(0), n - overlap - 1), F.lit(step))).otherwise(F.array().cast("array<int>"))
    return rows.withColumn("start", F.explode(starts)).select(*keys, "start", F.substring(text, F.col("start") + 1, F.lit(size)).alias("chunk"))


def forward_fill(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Blank cells take the last value above them, as merged cells of a sheet."""
    filled = F.last(F.when(F.trim(value) != "", F.col(value)), ignorenulls=True)
    return rows.withColumn(value, filled.over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def section_bodies(lines: DataFrame, keys: list[str], order: str, text: str, is_heading: Column, least: int = 80) -> DataFrame:
    """Each heading with the text of the lines up to the next one; bodies under ``least`` characters are dropped."""
    place = Window.partitionBy(*keys).orderBy(order)
    marked = lines.withColumn("_h", is_heading).withColumn("heading", F.last(F.when(F.col("_h"), F.col(order)), ignorenulls=True).over(place.rowsBetween(Window.unboundedPreceding, 0)))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, text))), lambda x: x[text]), "\n")
    bodies = marked.where("heading is not null and not _h").groupBy(*keys, "heading").agg(body.alias("body"), F.count("*").alias("n_lines"))
    return bodies.where(F.length("body") >= least)


def split_text(text: str, size: int = 400, overlap: int = 40, separators: tuple[str, ...] = ("\n\n", "\n", " ", "")) -> list[str]:
    """Pieces of up to ``size`` characters, cut at the largest separator that gives such pieces and packed again with up to ``overlap`` characters repeated."""
    mark = next((s for s in separators if not s or s in text), "")
    smaller = separators[separators.index(mark) + 1 :]
    parts = text.split(mark) if mark else list(text)
    out: list[str] = []
    run: list[str] = []
    width = 0

    def close(keep: int) -> None:
        nonlocal width
        whole = mark.join(run).strip()
        if whole:
            out.append(whole)
        while run and width > keep:
            width -= len(run.pop(0)) + (len(mark) if run else 0)

    for part in filter(None, parts):
        if len(part) > size:
            close(0)
            run, width = [], 0
            out += split_text(part, size, overlap, smaller) if smaller else [part]
            continue
        if run and width + len(mark) + len(part) > size:
            close(overlap)
            while run and width + len(mark) + len(part) > size:
                width -= len(run.pop(0)) + (len(mark) if run else 0)
        width += len(part) + (len(mark) if run else 0)
        run.append(part)
    close(0)
    return out


@F.pandas_udf(ArrayType(StringType()))
def _split(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: split_text(x) if x else [])


def split_chunks(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys, ord, chunk``: texts in overlapping pieces of 400 characters with 40 repeated, cut at paragraphs, else lines, else words."""
    return rows.select(*keys, F.posexplode(_split(F.col(text))).alias("ord", "chunk"))


def colliding_paths(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Paths that a run would both read and write, compared in their plain form."""
    plain = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "/(?:\\./)+", "/"), "/+", "/"), "/$", "")
    return inputs.select(plain("path").alias("path")).intersect(outputs.select(plain("path").alias("path")))


def coverage(seeds: DataFrame, generated: DataFrame, source: str) -> DataFrame:
    """``source, seeds, generated``: how many of each a source has, 0 where it has none."""
    a, b = seeds.groupBy(source).agg(F.count("*").alias("seeds")), generated.groupBy(source).agg(F.count("*").alias("generated"))
    return a.join(b, source, "full").fillna(0, ["seeds", "generated"])


def continuation(chunks: DataFrame, anchors: DataFrame, most: int = 6) -> DataFrame:
    """Up to ``most`` stored chunks of an anchor's section from the anchor on; anchors are stored chunks.

    Each chunk is offered to the ``most`` places before it in its section, so rows grow with the chunks, not with the pairs in a section.
    """
    key = ["document", "section"]
    placed = chunks.select(*key, "ord", F.row_number().over(Window.partitionBy(*key).orderBy("ord")).alias("place"))
    starts = placed.join(anchors.select(*key, "ord").distinct(), [*key, "ord"]).select(*key, F.col("ord").alias("anchor"), "place")
    offered = placed.withColumn("rank", F.explode(F.sequence(F.lit(1), F.lit(most)))).withColumn("place", F.col("place") - F.col("rank") + 1)
    return offered.join(starts, [*key, "place"]).select(*key, "anchor", "ord", "rank")


def stored_chunks(chunks: DataFrame) -> DataFrame:
    """The first chunk of each text: orders are given before copies go, so a section can have gaps."""
    first = chunks.groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("h")).agg(F.min(F.struct("document", "ord")).alias("f"))
    return chunks.join(first.select("f.document", "f.ord"), ["document", "ord"], "left_semi")


def contiguous(found: DataFrame) -> DataFrame:
    """Of ``continuation``, what has no gap before it."""
    return found.where("ord - anchor = rank - 1")


def round_robin(rows: DataFrame, group: str, within: str, key: str, most: int = 10_000) -> DataFrame:
    """Rows taken in turn from each group, the first of equal keys only, up to ``most`` (a corpus size); rank from 1 within ``key`` order."""
    once = rows.groupBy(key).agg(F.min(F.struct(within, group)).alias("f")).select(key, F.col(f"f.{within}").alias(within), F.col(f"f.{group}").alias(group))
    return once.orderBy(within, group, key).limit(most)


def insert_new(rows: DataFrame, stored: DataFrame, key: str = "text_hash", tie: str = "id") -> DataFrame:
    """Rows whose key is new, the first of equal ones; ``counted`` tells how many that leaves out."""
    first = rows.groupBy(key).agg(F.min(tie).alias(tie))
    return first.join(stored.select(key), key, "left_anti")


def glossary_rows(cells: Column) -> Column:
    """(term, definition) of a table row: its last two cells."""
    return F.struct(F.trim(F.element_at(cells, -2)).alias("term"), F.trim(F.element_at(cells, -1)).alias("definition"))


def table_items(rows: DataFrame, keys: list[str], order: str, cells: str) -> DataFrame:
    """``keys, order, term, definition`` of the rows of tables, each table's first row left out as its header; rows of under two cells, or without a term or a definition, are none.

    A table is a run of rows that follow each other by ``order``.
    """
    place = Window.partitionBy(*keys).orderBy(order)
    starts = rows.withColumn("_starts", ~F.col(order).eqNullSafe(F.lag(order).over(place) + 1))
    g = starts.where(~F.col("_starts") & (F.size(cells) >= 2)).select(*keys, order, glossary_rows(F.col(cells)).alias("g"))
    return g.select(*keys, order, "g.*").where("term <> '' and definition <> ''")


def latest(rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The row of the highest version of each key: append-only writes stand for updates."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), version).alias("r")).select("r.*")


def conflicts(writes: DataFrame, stored: DataFrame, key: str = "id") -> DataFrame:
    """Writes whose expected revision is not the stored one: a compare-and-set refuses them."""
    return writes.join(stored.select(key, F.col("revision").alias("_r")), key, "left").where(~F.col("expected").eqNullSafe(F.coalesce("_r", F.lit(0)))).drop("_r")


def merge_lists(local: DataFrame, remote: DataFrame, active_draft: Column, key: str = "id") -> DataFrame:
    """Remote rows win, with local fields they lack; local rows that the remote list lacks go, but for the active draft."""
    both = remote.alias("r").join(local.alias("l"), F.col(f"r.{key}") == F.col(f"l.{key}"), "left")
    kept = both.select(F.col(f"r.{key}").alias(key), F.col("r.title").alias("title"), F.coalesce("r.note", "l.note").alias("note"))
    drafts = local.where(active_draft).join(remote.select(key), key, "left_anti")
    return kept.unionByName(drafts.select(key, "title", "note"))


def live(rows: DataFrame, tombstones: DataFrame, key: str = "id") -> DataFrame:
    """Rows that no tombstone names; a delete is a tombstone, and the count of an anti join its result."""
    return rows.join(tombstones.select(key).distinct(), key, "left_anti")


def load_counts(rows: DataFrame, stored: DataFrame, key: str = "text_hash") -> DataFrame:
    """One row: how many of the rows a load would insert and how many it would skip as duplicates."""
    known = stored.select(key).distinct().withColumn("_known", F.lit(True))
    fresh = rows.groupBy(key).agg(F.count("*").alias("n")).join(known, key, "left")
    new = F.count_if(F.col("_known").isNull())
    return fresh.agg(new.alias("inserted"), (F.sum("n") - new).alias("skipped"))


def object_id_time(oid: Column) -> Column:
    """When a 24-digit hex id was made: its first eight digits are seconds; null for anything else."""
    return F.when(oid.rlike("^[0-9a-fA-F]{24}$"), F.timestamp_seconds(F.conv(F.substring(oid, 1, 8), 16, 10).cast("bigint")))


def same_place(fresh: DataFrame, cached: DataFrame, keys: list[str]) -> DataFrame:
    """Fresh messages with the cached ``note`` of the message that has the same place, role and text."""
    on = [*keys, "pos", "role", "text"]
    return fresh.join(cached.select(*on, "note"), on, "left")
