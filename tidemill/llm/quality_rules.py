"""Quality rules: repetition and symbol counts of a text, and lines that too many documents of a host share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .shared import bounded_batches, kept, tidy, unused
from .words import WordHasher, windows

SYMBOLS, SPACES = b"#*$%&|<>", b" \t\n\x0b\x0c\r"
#: A line is removed when more than this share of a host's distinct documents, and more than this number, hold it.
MAX_SHARE, MAX_DOCS = 0.05, 20
#: A document is depleted when its removed lines hold more than this share of its words.
MAX_REMOVED = 0.5
FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _repeat_words(hashes: np.ndarray, width: int) -> int:
    w = windows(hashes, width)
    _, at, counts = np.unique(w, return_inverse=True, return_counts=True)
    twice = counts[at] > 1
    if not twice.any():
        return 0
    edge = np.zeros(len(hashes) + 1, np.int64)
    begins = np.flatnonzero(twice)
    np.add.at(edge, begins, 1)
    np.add.at(edge, begins + width, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def line_key(line: bytes) -> int:
    """A signed 64-bit hash of the line's words, A-Z lower-cased and joined by single blanks."""
    return xxhash.xxh64_intdigest(b" ".join(line.lower().split())) - (1 << 63)


def text_counts(text: str | None, hasher: WordHasher) -> tuple[list[int], dict[int, int]]:
    """The counts in the order of ``FEATURES``, and words by key of each line with a word."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    chars = len(text or "") - (len(raw) - len(raw.translate(None, SPACES)))
    by_line: dict[int, int] = {}
    for x in lines:
        k = line_key(x)
        by_line[k] = by_line.get(k, 0) + len(x.split())
    counts = [len(words), chars, len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)), _repeat_words(hasher(words), 8) if len(words) > 8 else 0]
    return counts, by_line


def _count(batches):
    hasher = WordHasher()
    for batch in batches:
        rows, keys, sums = [], [], []
        for text in batch.column(3):
            counts, by_line = text_counts(text.as_py(), hasher)
            rows.append(counts)
            keys.append(list(by_line))
            sums.append(list(by_line.values()))
        cols = [pa.array([r[k] for r in rows], pa.int64()) for k in range(len(FEATURES))]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], *cols, pa.array(keys, pa.list_(pa.int64())), pa.array(sums, pa.list_(pa.int64()))], ["id", "host", "text_key", *FEATURES, "line_keys", "line_words"])


def _keyed(docs: DataFrame, id_col: str, host_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    host = F.coalesce(F.col(host_col).cast("string"), F.lit(""))
    return bounded_batches(docs).select(F.col(id_col).alias("id"), host.alias("host"), F.unhex(F.md5(text.cast("binary"))).alias("text_key"), text.alias("text"))


def assess(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text", max_share: float = MAX_SHARE, max_docs: int = MAX_DOCS, max_removed: float = MAX_REMOVED) -> DataFrame:
    """One row for each row of ``docs``: ``id, host, text_key``, the counts, ``base_failed, removed_words, removed_keys, kept``.

    Base rules: under 20 words, or over 30 % of the words in repeated 8-word windows.  Lines are
    compared by a hash of their lower-cased words.  A line is removed when more than
    ``max_docs`` and more than ``max_share`` of the distinct documents of a host hold it; a
    document whose removed lines hold more than ``max_removed`` of its words is depleted and
    rejected.  A document is an id with its text: copies under ids of their own all count, a
    repeated row counts once, rows of a null id count by their texts.

    Documents of one text are counted together before lines are spread out, and lines are
    summed by host before the shuffle, so neither a hot host, a hot line nor a group of copies meets in a task.

    A null text is an empty one and a null host the host ``""``; both fail the base rules when
    they have no words.  Repeated rows and null ids each keep their row; an empty table gives none.
    """
    schema = f"id {dict(docs.dtypes)[id_col]}, host string, text_key binary, {', '.join(f'{c} bigint' for c in FEATURES)}, line_keys array<bigint>, line_words array<bigint>"
    base = kept(_keyed(docs, id_col, host_col, text_col).mapInArrow(tidy(_count), schema))
    texts = base.select("id", "host", "text_key").distinct().groupBy("host", "text_key").agg(F.count("*").alias("copies"))
    pairs = base.select("host", "text_key", F.explode(F.arrays_zip("line_keys", "line_words")).alias("l"))
    lines = pairs.select("host", "text_key", F.col("l.line_keys").alias("line"), F.col("l.line_words").alias("words")).distinct()
    sizes = texts.groupBy("host").agg(F.sum("copies").alias("documents"))
    often = lines.join(texts, ["host", "text_key"]).groupBy("host", "line").agg(F.sum("copies").alias("n")).where(F.col("n") > max_docs)
    often = often.join(sizes, "host").where(F.col("n") > max_share * F.col("documents")).select("host", "line")
    removed = lines.join(often, ["host", "line"]).groupBy("host", "text_key").agg(F.sum("words").alias("removed_words"), F.collect_list("line").alias("removed_keys"))
    out = base.drop("line_keys", "line_words").join(removed, ["host", "text_key"], "left")
    out = out.withColumn("removed_words", F.coalesce("removed_words", F.lit(0)))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    out = out.withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("removed_words") <= max_removed * F.col("n_words")))


@F.pandas_udf(StringType())
def _without(texts, keys):
    def one(text, gone):
        if gone is None or not len(gone) or text is None:
            return text
        gone = set(map(int, gone))
        lines = text.encode("utf-8", "surrogatepass").split(b"\n")
        return b"\n".join(x for x in lines if not x.strip() or line_key(x) not in gone).decode("utf-8", "surrogatepass")

    return texts.combine(keys, one)


def apply_rules(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text", **limits) -> DataFrame:
    """``docs`` without rejected documents and without the lines above the limits; columns unchanged, cases as in ``assess``."""
    verdict = assess(docs, id_col, host_col, text_col, **limits).select("host", "text_key", "removed_keys", "kept").dropDuplicates(["host", "text_key"])
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    host, key, gone = unused(docs, "_host", "_key", "_gone")
    keyed = docs.withColumn(host, F.coalesce(F.col(host_col).cast("string"), F.lit(""))).withColumn(key, F.unhex(F.md5(text.cast("binary"))))
    v = verdict.where("kept").select(F.col("host").alias(host), F.col("text_key").alias(key), F.col("removed_keys").alias(gone))
    joined = keyed.join(v, [host, key])
    return joined.withColumn(text_col, F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(_without(F.col(text_col), F.col(gone)))).select(docs.columns)
