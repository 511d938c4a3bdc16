"""MinHash near-dedup with tensored banding.

``2 * side`` small collections of ``depth`` minhashes each form ``side * side`` table keys, every
left collection combined with every right one: at a similarity of 0.85, 64 tables cost 32 minhashes
instead of 256.  Links are confirmed on full sets.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shared import bounded_batches, files_for, kept, row_key, shuffle_width, tidy, unused, written
from .words import WordHasher, mix, shingle_set

#: Largest probability that a pair of the asked similarity shares no table, and that its signatures agree too seldom.
MISS, UNLIKE = 1e-4, 1e-8
#: Documents of a block whose sets, or whose signatures alone, are compared with another block's in one task.
BLOCK, SIGNATURES = 512, 2048
#: A block of short texts holds up to ``WIDE`` times as many documents, if these have no more than so many shingles.
WIDE, SHINGLES = 4, 1 << 20
#: Buckets in which a member outside its group's largest component meets one that chance picks.
CHANCES = 4
#: Documents whose sets a task holds at a time before it passes them on.
ROWS = 512
#: Parts that the narrow rows of one group, and of one bucket, are dealt to before they are numbered into blocks.
GROUP_SALT, BUCKET_SALT = 64, 8


@dataclass(frozen=True)
class Banding:
    """``side`` collections of ``depth`` minhashes on either hand; ``least`` of all minhashes must agree before sets are fetched."""

    side: int
    depth: int
    least: int

    @property
    def hashes(self) -> int:
        return 2 * self.side * self.depth


def missed(s: float, side: int, depth: int) -> float:
    """Probability that two sets of similarity ``s`` share none of the ``side * side`` tables."""
    return 1 - (1 - (1 - s**depth) ** side) ** 2


def banding(percent: int) -> Banding:
    """The fewest collections that keep ``missed`` under ``MISS`` at ``percent``: two minhashes deep from 70 % on, one below."""
    if not 1 <= percent <= 100:
        raise ValueError(f"percent must be 1 to 100, not {percent}")
    s, depth = percent / 100, 2 if percent >= 70 else 1
    side = next(n for n in range(1, 2000) if missed(s, n, depth) <= MISS)
    m = 2 * side * depth
    below, least = 0.0, 0
    while least < m and (below := below + comb(m, least) * s**least * (1 - s) ** (m - least)) < UNLIKE:
        least += 1
    return Banding(side, depth, least)


def _seeds(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _signer(width: int, hashes: int):
    def sign(batches):
        hasher, seeds = WordHasher(), _seeds(hashes)
        for batch in batches:
            ids, rows = batch.column(0), {"n_shingles": [], "h1": [], "h2": [], "sig": []}
            for text in batch.column(1):
                s = shingle_set(text.as_py(), hasher, width)
                rows["n_shingles"].append(len(s))
                both = xxhash.xxh3_128_intdigest(s.tobytes())
                rows["h1"].append((both >> 64) - (1 << 63))
                rows["h2"].append((both & ((1 << 64) - 1)) - (1 << 63))
                rows["sig"].append([int(mix(s ^ x).min() >> np.uint64(33)) for x in seeds] if len(s) else [])
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(rows["n_shingles"], pa.int64()), pa.array(rows["h1"], pa.int64()), pa.array(rows["h2"], pa.int64()), pa.array(rows["sig"], pa.list_(pa.int32()))],
                ["doc_id", "n_shingles", "h1", "h2", "sig"],
            )

    return sign


def _setter(width: int):
    def fetch(batches):
        hasher = WordHasher()
        for whole in batches:
            for at in range(0, max(1, whole.num_rows), ROWS):
                batch = whole.slice(at, ROWS)
                sets = [shingle_set(t.as_py(), hasher, width).view(np.int64) for t in batch.column(3)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sets, pa.list_(pa.int64()))], ["doc_id", "h1", "h2", "shingles"])

    return fetch


def _linker(numerator: int):
    """Compare the documents of one cell; return a spanning forest of its links between components."""

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc").drop_duplicates("doc")
        docs, part = pdf["doc"].to_numpy(), pdf["component"].to_numpy().copy()
        first, second = pdf["block"].to_numpy() == pdf["i"].to_numpy(), pdf["block"].to_numpy() == pdf["j"].to_numpy()
        sizes = pdf["shingles"].map(len).to_numpy()
        owner = np.repeat(np.arange(len(docs)), sizes)
        words, place = np.unique(np.concatenate(pdf["shingles"].to_list()), return_inverse=True)
        starts = np.searchsorted(place[order := np.argsort(place, kind="stable")], np.arange(len(words) + 1))
        holders, begins, out = owner[order], np.concatenate([[0], np.cumsum(sizes)]), []
        for x in range(len(docs)):
            rest = (first[x] & second) | (second[x] & first)
            rest[: x + 1] = False
            rest &= (part != part[x]) & (100 * np.minimum(sizes, sizes[x]) >= numerator * np.maximum(sizes, sizes[x]))
            if not rest.any():
                continue
            own = place[begins[x] : begins[x + 1]]
            spans = starts[own + 1] - starts[own]
            at = np.repeat(starts[own] - np.concatenate([[0], np.cumsum(spans)[:-1]]), spans) + np.arange(spans.sum())
            inter = np.bincount(holders[at], minlength=len(docs))
            for y in np.flatnonzero(rest & (100 * inter >= numerator * (sizes + sizes[x] - inter))):
                if part[y] != part[x]:
                    part[part == part[y]] = part[x]
                    out.append((docs[x], docs[y]))
        return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    return link


def _fellows(least: int, size: int):
    """Documents of a bucket's cell whose signature agrees with another one's, one of the two unlike the bucket's first document."""

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        sigs = np.array(pdf["sig"].to_list(), np.int32).reshape(len(pdf), size)
        odd, block = pdf["odd"].to_numpy(), pdf["block"].to_numpy()
        first, second = np.flatnonzero(block == pdf["i"].iloc[0]), np.flatnonzero(block == pdf["j"].iloc[0])
        has = np.zeros(len(pdf), bool)
        for at in range(0, len(first), 128):
            x = first[at : at + 128]
            equal = np.zeros((len(x), len(second)), np.int16)
            for k in range(size):
                equal += sigs[x, k][:, None] == sigs[second, k]
            good = (equal >= least) & (odd[x][:, None] | odd[second]) & (x[:, None] != second)
            has[x] |= good.any(1)
            has[second] |= good.any(0)
        return pdf.loc[has, ["key", "doc", "size"]]

    return find


def _blocks(rows: DataFrame, group: str, sizes: DataFrame, parts: list[str], columns: list[str], salt: int) -> DataFrame:
    """``rows`` of ``group, doc`` with ``block``, once for each cell ``i <= j`` of two blocks that it takes part in.

    ``sizes`` has a row a group.  A group's rows are dealt to ``salt`` parts to meet it, so that
    a hot group is not numbered in one task.  ``parts`` are SQL: the row's block, and the first
    and last block that it meets.
    """
    salted = sizes.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64(F.lit(7), "doc"), F.lit(salt)).cast("int")).join(salted, [group, "_salt"])
    block, low, high = map(F.expr, parts)
    rows = rows.withColumn("block", block.cast("int")).withColumn("x", F.explode(F.sequence(low.cast("int"), high.cast("int"))))
    return rows.select(group, "doc", *columns, "block", F.least("block", "x").alias("i"), F.greatest("block", "x").alias("j"))


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, width: int = 5) -> DataFrame:
    """One row for each distinct id: ``doc_id, n_shingles, component_id, kept``.

    Documents are linked if ``100 * |intersection| >= percent * |union|`` of their sets of
    ``width``-word shingles (A-Z lower-cased); ``component_id`` is the smallest id reachable and
    ``kept`` marks it.  Equal sets form one class first, so copies are never paired.

    Every two classes that share a table's bucket and whose signatures agree in ``least`` places
    are compared on full sets, or lie in one component already.  Members like the bucket's
    smallest document form that document's group.  In a bucket that also has members unlike it,
    signatures are compared with every unlike member's, and members that one of these agrees with form a
    group of their own, named by the smallest: strangers at the head of a bucket part nobody.  In a group every member
    meets the smallest one first (that of the group where they agree most).  The members outside its largest component next meet
    one that chance picks in each of their first ``CHANCES`` buckets, which brings in nearly all that belong there, and those still outside meet all others in blocks.  No task holds more than two blocks and no pair is emitted that is not a link.

    A pair of exactly ``percent`` is missed with probability ``MISS`` for want of a shared table and
    ``UNLIKE`` by its signatures, whatever else the buckets hold.

    Null, empty and word-less texts have the empty set and link with nothing.  Rows with a null
    id share one row with null ``component_id``, kept.  An id that repeats counts once, by the
    smallest set hash of its rows.  Other columns are not read; an empty table gives no rows.
    """
    band = banding(percent)
    texts = bounded_batches(docs).select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = texts.mapInArrow(tidy(_signer(width, band.hashes)), "doc_id bigint, n_shingles bigint, h1 bigint, h2 bigint, sig array<int>")
    signed = kept(signed).where("doc_id is not null")
    docs_n = signed.count()
    few, fewer = files_for(docs_n, 100_000), files_for(docs_n, 400_000)
    least = signed.groupBy("doc_id").agg(F.min(F.struct("h1", "h2", "n_shingles")).alias("s"))
    one = least.select("doc_id", "s.h1", "s.h2", "s.n_shingles")
    classes = written(one.where("n_shingles > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("doc")), "classes", fewer)
    reps = classes.join(signed.select("h1", "h2", "sig", F.col("n_shingles").alias("size"), F.col("doc_id").alias("doc")), ["h1", "h2", "doc"]).dropDuplicates(["doc"])
    reps = written(reps.select("doc", "h1", "h2", "sig", "size"), "reps", shuffle_width(docs.sparkSession))

    half = [F.xxhash64(F.lit(t), *(F.col("sig")[band.depth * t + k] for k in range(band.depth))) for t in range(2 * band.side)]
    rows = reps.select("doc", F.explode(F.array(*half[: band.side])).alias("l"), F.array(*half[band.side :]).alias("r"))
    rows = rows.select("doc", "l", F.explode("r").alias("r")).select("doc", F.xxhash64("l", "r").alias("key"))
    heads = rows.groupBy("key").agg(F.min("doc").alias("head"), F.max("doc").alias("last")).where("head < last").select("key", "head")
    buckets = written(rows.join(heads, "key").select("key", "head", "doc"), "buckets", few)
    sigs = reps.select("doc", "sig", "size")
    equal = sum((F.col("sig")[k] == F.col("head_sig")[k]).cast("int") for k in range(band.hashes))

    def against(mates: DataFrame, name: str) -> DataFrame:
        mates = mates.join(sigs, "doc").join(sigs.select(F.col("doc").alias("head"), F.col("sig").alias("head_sig"), F.col("size").alias("head_size")), "head")
        return written(mates.select("head", "doc", equal.alias("equal"), "size", "head_size"), name, few)

    mates = against(buckets.where("doc <> head").select("head", "doc").distinct(), "mates")
    unlike = mates.where(F.col("equal") < band.least).select("head", "doc", F.lit(True).alias("odd"))
    mixed = buckets.join(unlike, ["head", "doc"], "left").select("key", "doc", F.coalesce("odd", F.lit(False)).alias("odd"))
    sizes = mixed.groupBy("key").agg(F.count("*").alias("n"), F.count_if("odd").alias("odd_n")).where("odd_n > 0 and n > 2")
    sizes = sizes.selectExpr("key", f"int(ceil(odd_n / {SIGNATURES})) as odd_blocks", f"int(if(n <= {SIGNATURES}, 0, ceil((n - odd_n) / {SIGNATURES}))) as even_blocks")
    block = "if(odd or even_blocks = 0, pmod(xxhash64(doc), odd_blocks), odd_blocks + pmod(xxhash64(doc), even_blocks))"
    cells = _blocks(mixed, "key", sizes, [block, "0", "odd_blocks - 1 + if(odd, even_blocks, 0)"], ["odd"], BUCKET_SALT)
    fellows = cells.join(sigs, "doc").groupBy("key", "i", "j").applyInPandas(_fellows(band.least, band.hashes), "key bigint, doc bigint, size bigint")
    fellows = written(fellows.distinct(), "fellows", few)
    named = fellows.groupBy("key").agg(F.min("doc").alias("head"))
    others = fellows.join(named, "key").where("doc <> head").select("head", "doc").distinct().join(mates.select("head", "doc"), ["head", "doc"], "left_anti")
    mates = written(mates.where(F.col("equal") >= band.least).union(against(others, "others")), "all_mates", few)
    member = fellows.join(named, "key").select("head", "doc", "size").union(mates.select("head", "doc", "size")).distinct()
    member = written(member.union(mates.select("head", F.col("head").alias("doc"), F.col("head_size").alias("size"))).distinct(), "members", few)

    asked = member.select("doc").distinct().join(reps.select("doc", "h1", "h2"), "doc")
    found = texts.join(asked.select(F.col("doc").alias("doc_id"), "h1", "h2"), "doc_id").select("doc_id", "h1", "h2", "text")
    sets = found.mapInArrow(tidy(_setter(width)), "doc_id bigint, h1 bigint, h2 bigint, shingles array<bigint>")
    sets = written(sets.select(F.col("doc_id").alias("doc"), "shingles").dropDuplicates(["doc"]), "sets")

    best = mates.groupBy("doc").agg(F.max_by("head", F.struct("equal", -F.col("head"))).alias("head"))
    twos = member.groupBy("head").agg(F.count("*").alias("n"), F.max(F.when(F.col("doc") != F.col("head"), F.col("doc"))).alias("doc")).where("n = 2").select("doc", "head")
    def confirmed(pairs: DataFrame) -> DataFrame:
        pairs = pairs.join(sets, "doc").join(sets.select(F.col("doc").alias("head"), F.col("shingles").alias("others")), "head")
        inter = F.size(F.array_intersect("shingles", "others"))
        pairs = pairs.select("doc", "head", inter.alias("i"), (F.size("shingles") + F.size("others") - inter).alias("u"))
        return pairs.where(F.col("i") * 100 >= F.col("u") * percent).select(F.col("head").alias("a"), F.col("doc").alias("b"))

    def parts(links: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Members with their component, and the groups that hold several: the largest, its rows and the others'."""
        near = written(components(links), "near", fewer)
        found = member.join(near, F.col("doc") == F.col("node"), "left").select("head", "doc", "size", F.coalesce("component", "doc").alias("component"))
        split = found.groupBy("head", "component").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
        split = split.groupBy("head").agg(F.count("*").alias("parts"), F.sum("n").alias("all"), F.sum("size").alias("size"), F.max(F.struct("n", "component", "size")).alias("main")).where("parts > 1 and all > 2")
        return found, split.selectExpr("head", "main.component as main", "all - main.n as out_n", "main.n as main_n", "size - main.size as out_size", "main.size as main_size")

    links = written(confirmed(best.union(twos).distinct()), "links", fewer)
    found, split = parts(links)
    outside = written(found.join(split, "head").where("component <> main").select("doc").distinct(), "outside", fewer)
    if outside.count():
        mine = F.row_number().over(Window.partitionBy("doc").orderBy("key"))  # a short cut only: the blocks after it miss nothing
        few_keys = buckets.select("key", "doc").withColumn("k", mine).where(F.col("k") <= CHANCES).join(outside, "doc").select("key", "doc")
        chance = buckets.groupBy("key").agg(F.min_by("doc", F.xxhash64(F.lit(3), "doc")).alias("head"))
        tried = few_keys.join(chance, "key").where("doc <> head").select("doc", "head").distinct()
        links = written(links.union(confirmed(tried)).distinct(), "more_links", fewer)
        found, split = parts(links)
    blocks = "int(ceil(least(({0}) / {2}, greatest(({0}) / {3}, ({1}) / {4}))))"
    of = lambda n, size: blocks.format(n, size, BLOCK, WIDE * BLOCK, SHINGLES)
    whole = f"{of('out_n + main_n', 'out_size + main_size')} = 1"  # such a group is one block, and its largest component lies with the rest
    split = split.selectExpr("head", "main", f"if({whole}, 1, {of('out_n', 'out_size')}) as out_blocks", f"if({whole}, 0, {of('main_n', 'main_size')}) as main_blocks")
    block = "if(component = main and main_blocks > 0, out_blocks + pmod(xxhash64(doc), main_blocks), pmod(xxhash64(doc), out_blocks))"
    cells = _blocks(found, "head", split, [block, "0", "if(component = main, 0, main_blocks) + out_blocks - 1"], ["component"], GROUP_SALT)
    more = cells.join(sets, "doc").groupBy("head", "i", "j").applyInPandas(_linker(percent), "a bigint, b bigint")
    links = written(links.union(more), "all_links", fewer)

    final = components(links)
    whole = classes.join(final, F.col("doc") == F.col("node"), "left").select("h1", "h2", F.coalesce("component", "doc").alias("component"))
    out = one.join(whole, ["h1", "h2"], "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))
    out = out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
    nameless = texts.where("doc_id is null").limit(1).select("doc_id", F.lit(0).cast("bigint").alias("n_shingles"), F.lit(None).cast("bigint").alias("component_id"), F.lit(True).alias("kept"))
    return out.union(nameless)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, width: int = 5) -> DataFrame:
    """``docs`` without the documents that another stands for; columns unchanged.

    Every row is a document of its own, known by a hash of all its columns: rows of a null id or
    of one id with different texts are compared as any others.  Of a class the smallest id is
    kept, a null one last.  Rows equal in every column are copies, of which one is kept.  Where two rows share
    the 64-bit hash by chance, a second hash tells them apart, and neither goes as another's near copy.
    """
    row, check = unused(docs, "_row", "_check")
    keyed = docs.withColumn(row, row_key(docs)).withColumn(check, row_key(docs, 1))
    classes = near_classes(keyed, row, text_col, percent, width)
    classes = written(classes.select(F.col("doc_id").alias("_row"), F.col("component_id").alias("_class")), "row_classes")
    number = F.col(id_col).cast("bigint")
    names = keyed.select(F.col(row).alias("_row"), F.struct(number.isNull().alias("unnamed"), number.alias("id"), F.col(row).alias("row")).alias("_name"))
    shared = classes.groupBy("_class").agg(F.count("*").alias("_n")).where("_n > 1").select("_class")
    members = written(classes.join(shared, "_class").join(names, "_row"), "members")
    heads = members.groupBy("_class").agg(F.min("_name").alias("_head"))
    gone = members.join(heads, "_class").where("_row <> _head.row").select("_row").distinct()
    both = keyed.select(F.col(row).alias("_row"), F.col(check).alias("_check"))
    unsure = both.groupBy("_row").agg(F.min("_check").alias("least"), F.max("_check").alias("most")).where("least < most").select("_row")
    gone = gone.join(unsure, "_row", "left_anti").select(F.col("_row").alias(row))
    return keyed.join(gone, row, "left_anti").dropDuplicates([row, check]).select(docs.columns)
