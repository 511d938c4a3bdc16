"""Line dedup by a segment-partition edit join, in DataFrame functions only.

Lines within ``threshold`` edits share at least one of ``threshold + 1`` segments.  The shorter
line of a pair is indexed by its segments (number, whole length, text); the longer one probes
those lengths with the few substrings that the multi-match-aware windows leave, 12 for two
edits.  Candidates are verified with a banded bit-parallel edit distance: one word of
``2 * threshold + 2`` bits holds a column of the band.  Edits are of characters.  Segments are cut
from UTF-16 with two bytes a character, where a cut needs no walk along the line; characters
beyond it all stand for one another there, which only adds candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import files_for, kept, row_key, unused, written

#: Edits that two lines of one class may be apart.
THRESHOLD = 2
#: An edit changes at most two of these characters' counts, each by one; lines whose counts are further apart are never paired.
COUNTED = " eantiorshdlu,."
#: Lines up to this many are looked up by a broadcast of their 8-byte hashes; more by a shuffle.
BROADCAST_LINES = 1_000_000
#: A segment under which more pairs than this would meet is refined by segments of what is left of its lines, up to so many times.
HOT_PAIRS, REFINED = 250_000, 4


def _segment(length: Column, i: int, t: int) -> tuple[Column, Column]:
    """First character (from 1) and length of segment ``i`` of ``t + 1``: even parts, the longer ones last."""
    short = length % (t + 1)
    base = (length / (t + 1)).cast("int")
    longer_before = F.greatest(F.lit(0), F.lit(i - (t + 1)) + short)
    return base * i + longer_before + 1, base + (F.lit(i) >= (t + 1) - short).cast("int")


def _cut(wide: Column, start: Column, size: Column) -> Column:
    return F.substring(wide, 2 * start - 1, 2 * size)


def index_cuts(length: Column, t: int) -> list[tuple[Column, Column, Column, Column]]:
    """Segment number, whole length, first character and size of each segment of an indexed line."""
    return [(F.lit(i), length, *_segment(length, i, t)) for i in range(t + 1)]


def probe_cuts(length: Column, t: int) -> list[tuple[Column, Column, Column, Column]]:
    """The same of every substring by which a line of this length meets one of it or up to ``t`` less, if within ``t`` edits.

    Of a pair within ``t`` edits, some segment ``i`` is untouched with at most ``i`` edits before
    it and ``t - i`` after it: take the first up to which the edits so far are no more than its number.
    """
    cuts = []
    for gap in range(t + 1):
        for i in range(t + 1):
            start, size = _segment(length - gap, i, t)
            cuts += [(F.lit(i), length - gap, F.greatest(start + shift, F.lit(1)), size) for shift in range(max(-i, gap - (t - i)), min(i, gap + (t - i)) + 1)]
    return cuts


def cut_keys(wide: Column, cuts: list[tuple[Column, Column, Column, Column]], *seed: Column) -> list[Column]:
    """A key for each cut; a line of less than a character a segment has its length for all of them."""
    return [F.xxhash64(*seed, i, n, F.when(size > 0, _cut(wide, start, size)).otherwise(F.lit(b""))) for i, n, start, size in cuts]


def _named(value: Column, use) -> Column:
    """``use(value)`` with the value made once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _shared(x: Column, y: Column, bits: int = 20) -> Column:
    """How many first characters two strings share, up to ``2 ** bits - 1``, by halving."""
    steps = F.array(*(F.lit(1 << k) for k in range(bits - 1, -1, -1)))
    more = lambda n, k: (n + k <= F.length(x)) & (F.substring(x, n + 1, k) == F.substring(y, n + 1, k))
    return F.aggregate(steps, F.lit(0), lambda n, k: F.when(more(n, k), n + k).otherwise(n))


def _middles(a: Column, b: Column, t: int) -> Column:
    """Both strings without what they share at either end, but for ``t + 1`` characters of it."""
    cut = lambda q, n: F.struct(F.substring(q["x"], n + 1, F.length(q["x"])).alias("x"), F.substring(q["y"], n + 1, F.length(q["y"])).alias("y"))
    turned = lambda q: F.struct(F.reverse(q["x"]).alias("x"), F.reverse(q["y"]).alias("y"))
    shorter = lambda q: _named(q, lambda p: cut(p, F.greatest(_shared(p["x"], p["y"]) - (t + 1), F.lit(0))))
    return _named(shorter(F.struct(a.alias("x"), b.alias("y"))), lambda p: shorter(turned(p)))


def within(a: Column, b: Column, t: int) -> Column:
    """Edit distance of two strings, exact up to ``t`` and over ``t`` beyond it; lengths at most ``t`` apart and over ``t``.

    What the strings share at both ends is left aside.  In the rest a column of the band is a
    word whose bit ``w - 1`` stands for the row ``t`` below the diagonal; ``vp`` and ``vn`` mark
    where the distance rises and falls from row to row.  Once the diagonal is over ``3 * t``
    nothing can bring it back, and the columns that are left pass unread.
    """
    w = 2 * t + 2
    full = (1 << w) - 1
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    bits = lambda x: x.bitwiseAND(F.lit(full).cast("bigint"))
    inverse = lambda x: F.lit(full).cast("bigint").bitwiseXOR(x)
    bit = lambda x, k: F.call_function("shiftright", x, k).bitwiseAND(one)

    def run(pair: Column) -> Column:
        x, y, m = pair["x"], pair["y"], pair["m"]
        start = F.struct(F.lit(((1 << (t + 1)) - 1) << (w - t - 1)).cast("bigint").alias("vp"), none.alias("vn"), F.lit(t).cast("bigint").alias("d"), F.lit(0).alias("j"))

        def first(s: Column, c: Column) -> Column:
            match = none
            for d in range(w):
                match = match + F.when(F.get(x, s["j"] + (t - (w - 1 - d))) == c, F.lit(1 << d).cast("bigint")).otherwise(none)
            return F.struct(s["vp"].alias("vp"), s["vn"].alias("vn"), s["d"].alias("d"), s["j"].alias("j"), match.alias("pm"))

        def second(q: Column) -> Column:
            d0 = bits((q["pm"].bitwiseAND(q["vp"]) + q["vp"]).bitwiseXOR(q["vp"])).bitwiseOR(q["pm"]).bitwiseOR(q["vn"])
            return F.struct(q["vp"].alias("vp"), q["d"].alias("d"), q["j"].alias("j"), d0.alias("d0"), q["vn"].bitwiseOR(inverse(d0.bitwiseOR(q["vp"]))).alias("hp"), d0.bitwiseAND(q["vp"]).alias("hn"))

        def third(q: Column) -> Column:
            k = F.lit(w - 2) - (q["j"] - (m - t))
            along, across = one - bit(q["d0"], F.lit(w - 1)), bit(q["hp"], k) - bit(q["hn"], k)
            low = F.shiftright(q["d0"], 1)
            return F.struct(
                q["hn"].bitwiseOR(inverse(low.bitwiseOR(q["hp"]))).alias("vp"), low.bitwiseAND(q["hp"]).alias("vn"), (q["d"] + F.when(q["j"] < m - t, along).otherwise(across)).alias("d"), (q["j"] + 1).alias("j")
            )

        step = lambda s, c: F.when(s["d"] > 3 * t, s).otherwise(_named(_named(first(s, c), second), third))
        return F.aggregate(y, start, step, lambda s: s["d"])

    chars = lambda p: F.struct(F.split(p["x"], "").alias("x"), F.split(p["y"], "").alias("y"), F.length(p["x"]).alias("m"))
    return _named(_named(_middles(a, b, t), chars), run)


def _wide(line: Column) -> Column:
    """A line in two bytes a character."""
    plain = F.encode(line, "UTF-16BE")
    narrow = F.encode(F.regexp_replace(line, "[\\x{10000}-\\x{10FFFF}]", "\ufffd"), "UTF-16BE")
    return F.when(F.octet_length(plain) == 2 * F.length(line), plain).otherwise(narrow)


def _lines(docs: DataFrame, id_col: str, text_col: str, *extra: Column) -> DataFrame:
    blanks = F.replace(F.replace(F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), F.lit("\r"), F.lit(" ")), F.lit("\t"), F.lit(" "))
    lines = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), *extra, F.posexplode(F.split(blanks, "\n", -1)).alias("line_no", "line"))
    lines = lines.withColumn("line", F.trim("line")).where(F.octet_length("line") > 0)
    return lines.select(*lines.columns[:-1], F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), "line")


def line_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """One row for each line that is not blank: ``doc_id, line_no, class_doc, class_line, n_links, kept``.

    Lines are compared lower-cased, with tabs and carriage returns as blanks, without outer blanks.
    Equal lines are one text; two texts of more than ``threshold`` characters within
    ``threshold`` edits are linked; a class is a connected component, named by its first line in
    (doc_id, line_no), which alone is kept.  ``n_links`` counts the different texts that a line
    is linked with.

    Segments are summed by key before probes meet them, so a line that very many documents
    hold costs no more than its copies.  Probes and segments that meet no other line are dropped
    first, which pairs nothing, and texts are read again for the rest alone.  Of those, lines
    are paired at a shared segment if their counts of frequent characters allow the threshold.
    Where very many lines share a segment, as those of a template do, they meet by segments of
    what is left of them instead: that too is within ``threshold`` edits.

    Null and empty texts give no lines; rows of a null id come first in the order and are named
    by null; a repeated row repeats its lines, and equal places share one verdict.  Other columns are not read.
    """
    return _classes(_lines(docs, id_col, text_col), ["doc_id", "line_no"], threshold)


def _refined(rows: DataFrame, cuts, t: int) -> DataFrame:
    """Rows of ``key, h1, wide, n`` (and ``seed`` from the second time on), keyed anew by segments of what the key's own leaves of each line.

    Where the key is of an empty segment, nothing is left to tell lines apart and rows stay as they are.
    """
    seed = [F.col("seed")] if "seed" in rows.columns else []
    here = cuts(F.col("n"), t)
    found = F.array(*(F.when(k == F.col("key"), F.struct(start.alias("start"), size.alias("size"))) for k, (_, _, start, size) in zip(cut_keys(F.col("wide"), here, *seed), here, strict=True)))
    rows = rows.withColumn("cut", F.explode(F.array_distinct(F.filter(found, lambda c: c.isNotNull()))))
    rest = F.concat(_cut(F.col("wide"), F.lit(1), F.col("cut.start") - 1), F.substring(F.col("wide"), 2 * (F.col("cut.start") + F.col("cut.size")) - 1, F.octet_length("wide")))
    moved = rows.where("cut.size > 0").select("h1", F.col("key").alias("seed"), rest.alias("wide"), (F.col("n") - F.col("cut.size")).alias("n")).distinct()
    moved = moved.withColumn("key", F.explode(F.array(*cut_keys(F.col("wide"), cuts(F.col("n"), t), F.col("seed")))))
    return (moved.unionByName(rows.where("cut.size = 0").drop("cut")) if seed else moved).distinct()


def _meeting(probes: DataFrame, indexed: DataFrame, texts: DataFrame, t: int, files: int) -> tuple[DataFrame, DataFrame]:
    """``key, h1`` of both sides, with hot keys refined; what is still hot after ``REFINED`` times meets as it is."""
    texts = texts.select("h1", _wide(F.col("line")).alias("wide"), F.length("line").alias("n"))
    done: list[tuple[DataFrame, DataFrame]] = []
    for level in range(REFINED + 1):
        counts = probes.groupBy("key").agg(F.count("*").alias("p")).join(indexed.groupBy("key").agg(F.count("*").alias("s")), "key")
        hot = written(counts.where(F.col("p") * F.col("s") > HOT_PAIRS).select("key"), "hot_segments", 1)
        if level == REFINED or not hot.count():
            break
        done.append((probes.join(hot, "key", "left_anti").select("key", "h1"), indexed.join(hot, "key", "left_anti").select("key", "h1")))
        probes, indexed = (rows.join(hot, "key") if level else rows.join(hot, "key").join(texts, "h1") for rows in (probes, indexed))
        probes, indexed = written(_refined(probes, probe_cuts, t), "refined", files), written(_refined(indexed, index_cuts, t), "refined", files)
    done.append((probes.select("key", "h1"), indexed.select("key", "h1")))
    first, second = done[0]
    for x, y in done[1:]:
        first, second = first.union(x), second.union(y)
    return first, second


def _classes(lines: DataFrame, place: list[str], threshold: int) -> DataFrame:
    """``line_classes`` of lines that the columns ``place`` name, in whose order the first line of a class is found."""
    places = kept(lines.select(*place, "h1", "h2"))
    lines_n = places.count()
    few, fewer = files_for(lines_n, 400_000), files_for(lines_n, 2_000_000)
    long = lines.select("h1", F.length("line").alias("n"), _wide(F.col("line")).alias("wide")).where(F.col("n") > threshold)
    wide, n = F.col("wide"), F.col("n")
    indexed = kept(long.select("h1", F.explode(F.array(*cut_keys(wide, index_cuts(n, threshold)))).alias("key")))
    probes = long.select("h1", F.explode(F.array(*cut_keys(wide, probe_cuts(n, threshold)))).alias("key"))
    ends = indexed.groupBy(F.col("key").alias("at")).agg(F.min("h1").alias("lo"), F.max("h1").alias("hi"))
    met = (F.col("key") == F.col("at")) & ((F.col("lo") != F.col("h1")) | (F.col("hi") != F.col("h1")))
    probes = written(probes.join(ends.hint("shuffle_hash"), met, "left_semi").distinct(), "probes", few)
    indexed = written(indexed.join(probes.select("key").distinct(), "key", "left_semi").distinct(), "indexed", few)

    asked = written(probes.select("h1").union(indexed.select("h1")).distinct(), "asked", fewer)
    if asked.count() <= BROADCAST_LINES:
        asked = F.broadcast(asked)
    texts = written(lines.select("h1", "h2", "line").join(asked, "h1", "left_semi").dropDuplicates(["h1", "h2"]), "texts", few)
    tally = [f"n{k}" for k in range(len(COUNTED))]
    counts = (F.octet_length("line") - F.octet_length(F.replace("line", F.lit(c))) for c in COUNTED)
    sketch = written(texts.select("h1", F.length("line").alias("n"), *(c.alias(name) for c, name in zip(counts, tally, strict=True))), "sketches", few)
    probes, indexed = _meeting(probes, indexed, texts, threshold, few)
    long_side = probes.join(sketch, "h1").select("key", F.struct("h1", "n", *tally).alias("l"))
    short_side = indexed.join(sketch, "h1").select("key", F.struct("h1", "n", *tally).alias("s"))
    differ = sum(F.abs(F.col(f"l.{c}") - F.col(f"s.{c}")) for c in tally)
    ordered = (F.col("s.n") < F.col("l.n")) | ((F.col("s.n") == F.col("l.n")) & (F.col("s.h1") < F.col("l.h1")))
    pairs = long_side.join(short_side.withColumnRenamed("key", "at"), (F.col("key") == F.col("at")) & ordered & (F.col("l.n") - F.col("s.n") <= threshold) & (differ <= 2 * threshold))
    pairs = written(pairs.select(F.least("s.h1", "l.h1").alias("a"), F.greatest("s.h1", "l.h1").alias("b")).distinct(), "pairs", fewer)
    whole = F.col("h1").cast("decimal(20,0)") * F.lit(1 << 56).cast("decimal(18,0)") + F.col("h2").bitwiseAND(F.lit((1 << 56) - 1)).cast("decimal(18,0)")
    texts = texts.select("h1", whole.cast("decimal(38,0)").alias("id"), "line")
    end = lambda side, id_, line: texts.select(F.col("h1").alias(side), F.col("id").alias(id_), F.col("line").alias(line))
    both = pairs.join(end("a", "i", "x"), "a").join(end("b", "j", "y"), "b").where(F.abs(F.length("x") - F.length("y")) <= threshold)
    links = written(both.where(within(F.col("x"), F.col("y"), threshold) <= threshold).select(F.col("i").alias("a"), F.col("j").alias("b")), "line_links", fewer)

    degrees = links.select(F.col("a").alias("id")).union(links.select("b")).groupBy("id").agg(F.count("*").alias("n_links"))
    linked = degrees.join(components(links), F.col("id") == F.col("node")).select("id", "n_links", "component")
    firsts = places.groupBy("h1", "h2").agg(F.min(F.struct(*place)).alias("first"))
    firsts = firsts.withColumn("id", whole.cast("decimal(38,0)")).join(linked, "id", "left")
    alone = firsts.where("component is null").select("h1", "h2", F.lit(0).cast("bigint").alias("n_links"), "first")
    joined = firsts.where("component is not null")
    heads = joined.groupBy("component").agg(F.min("first").alias("head"))
    named = alone.union(joined.join(heads, "component").select("h1", "h2", "n_links", F.col("head").alias("first")))
    out = places.join(named, ["h1", "h2"])
    same = F.struct(*place).eqNullSafe(F.col("first"))
    return out.select(*place, F.col("first.doc_id").alias("class_doc"), F.col("first.line_no").alias("class_line"), "n_links", same.alias("kept"))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """``docs`` with only the first line of each class; columns unchanged, cases as in ``line_classes``.

    Every row is a document of its own, known by a hash of all its columns, so rows of a null or
    repeated id do not share what is removed; rows equal in every column share one verdict.

    Documents of which no line is left, though they had some, are dropped: all they held stands
    elsewhere.  Lines without characters stay.
    """
    key = row_key(docs)
    numbers = F.array_sort(F.collect_set(F.when(~F.col("kept"), F.col("line_no"))))
    classes = _classes(_lines(docs, id_col, text_col, key.alias("_row")), ["doc_id", "_row", "line_no"], threshold)
    gone = classes.groupBy("_row").agg(numbers.alias("gone"), F.max("kept").alias("left"))
    gone = gone.where(F.size("gone") > 0)
    row, numbers, left = unused(docs, "_row", "_gone", "_left")
    gone = gone.select(F.col("_row").alias(row), F.col("gone").alias(numbers), F.col("left").alias(left))
    out = docs.withColumn(row, key).join(gone, row, "left").where(F.coalesce(F.col(left), F.lit(True)))
    kept = F.when(F.col(numbers).isNull(), F.col(text_col)).otherwise(_without(F.col(text_col), F.col(numbers)))
    return out.withColumn(text_col, kept).select(docs.columns)


def _without(text: Column, gone: Column) -> Column:
    """``text`` without the lines of the sorted numbers ``gone``: the runs of lines between two of them, so that the work is linear in both."""
    gone = gone.cast("array<bigint>")

    def rest(lines: Column) -> Column:
        after = F.concat(F.array(F.lit(-1).cast("bigint")), gone)
        before = F.concat(gone, F.array(F.size(lines).cast("bigint")))
        run = lambda a, b: F.when(b - a > 1, F.array_join(F.slice(lines, (a + 2).cast("int"), (b - a - 1).cast("int")), "\n"))
        return F.array_join(F.filter(F.zip_with(after, before, run), lambda x: x.isNotNull()), "\n")

    return F.element_at(F.transform(F.array(F.split(text, "\n", -1)), rest), 1)
