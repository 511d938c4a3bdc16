"""Vector compression by product codebooks, in exact integers.

Chunks of vectors are stored part by part in the order of a Hilbert curve, cut into flat blocks that
carry the box (least and largest component) and the sum of their points.  A round bounds each block's
distance to every entry by its box: entries that cannot be nearest to any point are struck off, a block with one
entry left is assigned whole by its sum, and the others' points meet their block's shortlist alone.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches, tidy, written

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors, and components, of a stored chunk at most; points of a block.
CHUNK, NUMBERS, BLOCK = 16384, 1 << 20, 16
#: Bytes of a row group of the store: a chunk is one long row.
ROW_GROUP = 16 << 20
#: Numbers of a distance table that is held at a time.
CELLS = 1 << 20


def hilbert(points: np.ndarray) -> np.ndarray:
    """Place of every point (rows of integers) on a Hilbert curve through their box; up to 60 axes count, as many bits of each as 60 allow."""
    x = (points - points.min(0))[:, :60].astype(np.uint64)
    axes = x.shape[1]
    wide = int(x.max()).bit_length()
    bits = max(1, min(wide, 60 // axes))
    x >>= np.uint64(max(0, wide - bits))
    zero = np.uint64(0)
    for b in range(bits - 1, 0, -1):
        q, low = np.uint64(1 << b), np.uint64((1 << b) - 1)
        for i in range(axes):
            turned = (x[:, i] & q) != 0
            swap = np.where(turned, zero, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(turned, low, swap)
            x[:, i] ^= swap
    for i in range(1, axes):
        x[:, i] ^= x[:, i - 1]
    flip = np.zeros(len(x), np.uint64)
    for b in range(bits - 1, 0, -1):
        flip ^= np.where((x[:, -1] & np.uint64(1 << b)) != 0, np.uint64((1 << b) - 1), zero)
    x ^= flip[:, None]
    place = np.zeros(len(x), np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(axes):
            place = place << np.uint64(1) | x[:, i] >> np.uint64(b) & np.uint64(1)
    return place


@dataclass
class Blocks:
    """One part position of a chunk: ``order`` of the rows on the curve, their points, and each block's box and sum.  The last block is filled up with its last point."""

    order: np.ndarray
    points: np.ndarray
    low: np.ndarray
    high: np.ndarray
    total: np.ndarray

    @classmethod
    def of(cls, part: np.ndarray) -> Blocks:
        order = np.argsort(hilbert(part), kind="stable").astype(np.uint16)
        flat = part[order]
        full = np.concatenate([flat, np.repeat(flat[-1:], -len(flat) % BLOCK, 0)])
        boxes = full.reshape(-1, BLOCK, part.shape[1])
        total = np.add.reduceat(flat.astype(np.int64), np.arange(0, len(flat), BLOCK), 0)
        return cls(order, full, boxes.min(1), boxes.max(1), total)

    def shortlists(self, entries: np.ndarray) -> np.ndarray:
        """For every block and entry, whether it may be the nearest of one of the block's points.

        The pivot is the entry whose largest distance to the box is smallest.  An entry stays if its least distance to the box is not over
        that, and if somewhere in the box it is no farther than the pivot: the difference of two squared distances is linear, so
        its least value lies at the corner that the entry's components point to.
        """
        low, high = self.low.astype(np.int64)[:, None, :], self.high.astype(np.int64)[:, None, :]
        under, over = low - entries, entries - high
        near = (np.maximum(np.maximum(under, over), 0) ** 2).sum(2)
        far = (np.maximum(abs(low - entries), abs(high - entries)) ** 2).sum(2)
        pivot = entries[far.argmin(1)][:, None, :]
        ahead = entries - pivot
        corner = np.where(ahead > 0, high, low)
        gap = (entries * entries).sum(1) - (pivot * pivot).sum(2) - 2 * (corner * ahead).sum(2)
        return (near <= far.min(1)[:, None]) & (gap <= 0)


def nearest(blocks: Blocks, entries: np.ndarray, lists: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry and squared distance of every point of the ``chosen`` blocks; ties go to the lower index, which a shortlist holds first."""
    width = entries.shape[1]
    points = blocks.points.reshape(-1, BLOCK, width)
    best, least = np.zeros((len(points), BLOCK), np.int64), np.zeros((len(points), BLOCK), np.int64)
    lengths = lists.sum(1)
    for n in np.unique(lengths[chosen]):
        rows = np.flatnonzero(chosen & (lengths == n))
        for at in range(0, len(rows), max(1, CELLS // (BLOCK * int(n)))):
            some = rows[at : at + max(1, CELLS // (BLOCK * int(n)))]
            short = np.nonzero(lists[some])[1].reshape(len(some), n)
            apart = np.zeros((len(some), BLOCK, n), np.int64)
            for k in range(width):
                step = points[some, :, k][:, :, None].astype(np.int64) - entries[short, k][:, None, :]
                apart += step * step
            at_least = apart.argmin(2)
            best[some] = np.take_along_axis(short, at_least, 1)
            least[some] = np.take_along_axis(apart, at_least[:, :, None], 2)[:, :, 0]
    return best.ravel(), least.ravel()


def part_sums(blocks: Blocks, entries: np.ndarray) -> np.ndarray:
    """Count and componentwise sum of the points nearest to each entry, a row an entry."""
    lists, n, size = blocks.shortlists(entries), len(blocks.order), len(entries)
    alone = lists.sum(1) == 1
    out = np.zeros((size, 1 + entries.shape[1]), np.int64)
    whole = lists[alone].argmax(1)
    sizes = np.minimum(BLOCK, n - np.arange(0, n, BLOCK))
    np.add.at(out[:, 0], whole, sizes[alone])
    np.add.at(out[:, 1:], whole, blocks.total[alone])
    real = np.repeat(~alone, BLOCK) & (np.arange(len(blocks.points)) < n)
    mine = nearest(blocks, entries, lists, ~alone)[0][real]
    out[:, 0] += np.bincount(mine, minlength=size)
    for k in range(entries.shape[1]):  # sums of a chunk are far below 2**53, where doubles are exact
        out[:, 1 + k] += np.bincount(mine, blocks.points[real, k], size).astype(np.int64)
    return out


def _packer(parts: int, width: int):
    """Gather vectors into chunks, and yield each chunk's flat blocks as one row."""

    def chunk(ids: list, labels: list, vectors: list[np.ndarray]) -> pa.RecordBatch:
        ints = np.floor(np.concatenate(vectors) * SCALE).astype(np.int32).reshape(-1, parts, width)
        made = [Blocks.of(ints[:, p]) for p in range(parts)]
        names = [pa.concat_arrays(a) for a in (ids, labels)]
        columns = [pa.ListArray.from_arrays(pa.array([0, len(ints)], pa.int32()), a) for a in names]
        for field in ("order", "points", "low", "high", "total"):
            columns.append(pa.array([b"".join(np.ascontiguousarray(getattr(b, field)).tobytes() for b in made)], pa.binary()))
        return pa.RecordBatch.from_arrays(columns, ["ids", "labels", "order", "points", "low", "high", "total"])

    most = max(1, min(CHUNK, NUMBERS // (parts * width)))

    def run(batches):
        ids, labels, vectors, held = [], [], [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                some = batch.slice(at, most - held)
                ids.append(some.column(0))
                labels.append(some.column(1))
                vectors.append(some.column(2).flatten().to_numpy().astype(np.float64))
                at, held = at + some.num_rows, held + some.num_rows
                if held == most:
                    yield chunk(ids, labels, vectors)
                    ids, labels, vectors, held = [], [], [], 0
        if held:
            yield chunk(ids, labels, vectors)

    return run


def _stored(batch: pa.RecordBatch, row: int, parts: int, width: int) -> list[Blocks]:
    """The blocks of a stored chunk, a part after another."""
    kinds = {"order": (np.uint16, 1), "points": (np.int32, width), "low": (np.int32, width), "high": (np.int32, width), "total": (np.int64, width)}
    fields = []
    for name, (kind, columns) in kinds.items():
        flat = np.frombuffer(batch.column(name)[row].as_buffer(), kind)
        fields.append(flat.reshape(parts, -1) if columns == 1 else flat.reshape(parts, -1, columns))
    return [Blocks(*(f[p] for f in fields)) for p in range(parts)]


def _summer(given, parts: int, width: int):
    """Sums a task, over all of its chunks: a row a part, entry and place; place 0 is the count."""

    def run(batches):
        books, sums = given.value, None
        for batch in batches:
            for row in range(batch.num_rows):
                now = np.stack([part_sums(b, books[p]) for p, b in enumerate(_stored(batch, row, parts, width))])
                sums = now if sums is None else sums + now
        if sums is not None:
            part, entry, place = (x.ravel() for x in np.indices(sums.shape, np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(entry), pa.array(place), pa.array(sums.ravel())], ["part", "entry", "place", "total"])

    return run


def _coder(given, parts: int, width: int):
    def run(batches):
        books = given.value
        for batch in batches:
            for row in range(batch.num_rows):
                ids, labels = batch.column("ids")[row].values, batch.column("labels")[row].values
                codes, error = np.empty((len(ids), parts), np.uint8), np.zeros(len(ids), np.int64)
                for p, b in enumerate(_stored(batch, row, parts, width)):
                    lists = b.shortlists(books[p])
                    best, least = nearest(b, books[p], lists, np.ones(len(lists), bool))
                    codes[b.order, p] = best[: len(ids)]
                    error[b.order] += least[: len(ids)]
                digits = codes.tobytes().hex()
                texts = [digits[k : k + 2 * parts] for k in range(0, len(digits), 2 * parts)]
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array(texts, pa.string()), pa.array(error)], ["id", "label", "code", "error"])

    return run


def digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' decimal components by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """``id, code, error, label_error, codebooks_sha256`` of every vector, named ``id_col`` and so on.

    Components become ``floor(256 * x)``; each part position's codebook starts as that part of the ``entries`` smallest ids (all
    rows, if fewer; null ids last, repeated ids by their components) and is refined by ``rounds`` of nearest entries and floored means;
    ``code`` has two hex digits a part, ``error`` is the final squared distance.  ``label_error`` sums errors over
    equal labels, nulls together.  All arithmetic is on integers and exact, so neither partitions nor chunks change a result.

    Vectors that are null or hold null, NaN or infinite components are dropped.  A vector of another length than the first row's keeps
    its row, with null ``code`` and ``error``.  Repeated rows are coded each; other columns are not read; an empty
    table gives no rows.  A length that ``parts`` does not divide, and components so large that an error may pass a long, raise ``ValueError``.

    The chunks' blocks are written once, without a shuffle; a round reads them and returns ``parts * entries`` sums a task, whatever
    the input, and the driver holds the codebooks alone.  Labels are summed before they are shuffled.
    """
    if not 1 <= entries <= 256:
        raise ValueError("two hex digits hold 1 to 256 entries")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector")).where(F.col("vector").isNotNull())
    rows = rows.where(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))))
    uncoded = [F.lit(None).cast("string").alias("code"), F.lit(None).cast("bigint").alias("error")]
    head = rows.orderBy(F.col("id").asc_nulls_last(), "vector").select("vector").first()
    if head is None:
        return _with_label_errors(rows.select("id", "label", *uncoded), id_col, "")
    length = len(head["vector"])
    width, rest = divmod(length, parts)
    if rest or not width:
        raise ValueError(f"vectors of {length} components cannot be cut into {parts} equal parts")
    fitting = rows.where(F.size("vector") == length)
    largest = fitting.agg(F.max(F.array_max(F.transform("vector", F.abs)))).first()[0]
    if length * (2 * (SCALE * largest + 1)) ** 2 >= 2.0**63:
        raise ValueError("components are too large for errors of 64 bits")
    start = [r["vector"] for r in fitting.orderBy(F.col("id").asc_nulls_last(), "vector").select("vector").limit(entries).collect()]
    books = np.floor(np.array(start, np.float64) * SCALE).astype(np.int64).reshape(-1, parts, width).transpose(1, 0, 2).copy()

    kinds = dict(rows.dtypes)
    schema = f"ids array<{kinds['id']}>, labels array<{kinds['label']}>, order binary, points binary, low binary, high binary, total binary"
    store = bounded_batches(fitting).mapInArrow(tidy(_packer(parts, width)), schema)
    store = bounded_batches(written(store, "vector_blocks", row_group=ROW_GROUP))
    context = vectors.sparkSession.sparkContext
    for _ in range(rounds):
        found = store.mapInArrow(tidy(_summer(context.broadcast(books), parts, width)), "part int, entry int, place int, total bigint")
        totals = np.zeros((parts, len(start), 1 + width), np.int64)
        for r in found.groupBy("part", "entry", "place").agg(F.sum("total").alias("total")).collect():
            totals[r["part"], r["entry"], r["place"]] = r["total"]
        counts = totals[:, :, :1]
        books = np.where(counts > 0, totals[:, :, 1:] // np.maximum(counts, 1), books)
    coded = store.mapInArrow(tidy(_coder(context.broadcast(books), parts, width)), f"id {kinds['id']}, label {kinds['label']}, code string, error bigint")
    others = rows.where(F.size("vector") != length).select("id", "label", *uncoded)
    return _with_label_errors(written(coded.union(others), "vector_codes"), id_col, digest(books))


def _with_label_errors(coded: DataFrame, id_col: str, books: str) -> DataFrame:
    sums = coded.groupBy(F.col("label").alias("_of")).agg(F.sum("error").alias("label_error"))
    out = coded.join(sums, F.col("label").eqNullSafe(F.col("_of")))
    return out.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(books).alias("codebooks_sha256"))


def codes_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, source: str = "embeddings") -> str:
    """The same codes in DuckDB, every part compared with every entry."""
    steps = [
        f"""kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS place, vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM {source}
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""cut AS MATERIALIZED (
  SELECT place, p, list_transform(v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})], lambda x: CAST(floor({SCALE} * x) AS BIGINT)) AS x
  FROM kept CROSS JOIN (SELECT unnest(range({parts})) AS p))""",
        f"book0 AS MATERIALIZED (SELECT p, place AS e, x AS y FROM cut WHERE place < {entries})",
    ]
    for r in range(rounds + 1):
        steps.append(f"""chosen{r} AS MATERIALIZED (
  SELECT place, p, min(d * 256 + e) AS best FROM (
    SELECT place, cut.p, e, CAST(list_sum(list_transform(range(1, len(x) + 1), lambda k: (x[k] - y[k]) * (x[k] - y[k]))) AS BIGINT) AS d FROM cut JOIN book{r} b ON cut.p = b.p)
  GROUP BY ALL)""")
        if r < rounds:
            steps.append(f"""book{r + 1} AS MATERIALIZED (
  SELECT p, e, coalesce(means, y) AS y FROM book{r} LEFT JOIN (
    SELECT p, e, list(CAST((s - ((s % n + n) % n)) // n AS BIGINT) ORDER BY k) AS means FROM (
      SELECT p, best % 256 AS e, k, CAST(sum(x[k]) AS BIGINT) AS s, count(*) AS n FROM cut JOIN chosen{r} USING (place, p) CROSS JOIN LATERAL (SELECT unnest(range(1, len(x) + 1)) AS k)
      GROUP BY ALL)
    GROUP BY ALL) USING (p, e))""")
    steps.append(f"coded AS (SELECT place, string_agg(printf('%02x', best % 256), '' ORDER BY p) AS code, CAST(sum(best // 256) AS BIGINT) AS error FROM chosen{rounds} GROUP BY place)")
    steps.append(f"books AS (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{rounds})")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM kept JOIN coded USING (place) CROSS JOIN books"""
