"""Alignment of two tokenizers over whole texts, with corpus-wide scores of token pairs.

Texts are cut where tokens of both end together.  Every pair of linked ids is inverted into compressed bitmaps of the
documents that hold it: one bitmap for each bit of its multiplicity there (planes), in containers of 4096
documents.  OR-merged and popcounted, they give each pair's documents and links; read as postings, they
carry the pair's score back to its documents.
"""

from __future__ import annotations

import re
from functools import lru_cache
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import _byte_letters
from .shared import bounded_batches, shuffle_width, tidy, written

#: Documents of a container, and bytes of its full bitmap; a bitmap of fewer places is a list of 16-bit numbers, which is shorter.
CONTAINER, FULL = 4096, 512
#: Segments of up to this many characters are remembered, up to this many of them; one text's longer ones are encoded each time.
MEMO_CHARS, MEMO_SEGMENTS = 40, 250_000
#: Texts, and characters of texts, that are encoded together.
ROWS, CHARS = 128, 1 << 20
#: Postings that a task gathers before it writes their bitmaps.
POSTINGS = 1 << 20

_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")


class Pair:
    """Tokenizers A (byte-level BPE, a JSON file's text) and B (pieces with byte fallback, a model file's bytes)."""

    def __init__(self, a: str, b: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        back = {c: k for k, c in enumerate(_byte_letters())}
        named = [self.a.id_to_token(k) or "" for k in range(self.a.get_vocab_size())]
        self.a_size = [len(s) if all(c in back for c in s) else len(s.encode()) for s in named]
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        if any("▁" in p.lstrip("▁") or "\n" in p for p in pieces):
            raise ValueError("pieces that go on over a blank or a line feed cannot be cut there")
        self.b_bytes = [bytes([int(m[1], 16)]) if (m := re.fullmatch("<0x([0-9A-F]{2})>", p)) else p.replace("▁", " ").encode() for p in pieces]
        if not all(self.b_bytes):
            raise ValueError("pieces without bytes have no place")
        self.blank = self.b.piece_to_id("▁")
        self.a_size, self.b_size = np.array(self.a_size, np.int64), np.array(list(map(len, self.b_bytes)), np.int64)
        #: A token's digits followed by what comes after it: A's within a group, A's at its end, B's within, B's at the end.
        self.said = [f"{k}{mark}" for size, marks in ((len(self.a_size), ",|"), (len(self.b_size), ",;")) for mark in marks for k in range(size)]
        self.memo: dict[str, tuple] = {}
        self.old: dict[str, tuple] = {}

    def _learn(self, names: list[str]) -> dict[str, tuple]:
        """Of every segment: numbers of A and B tokens in one, the groups' text, the links' pair codes; no tokens if B's bytes are not the segment's."""
        segments = [s if s[0] in " \n" else " " + s for s in names]
        ids = [e.ids for e in self.a.encode_batch_fast(segments, add_special_tokens=False)]
        pieces = self.b.encode([s[1:] if s[0] == " " else s for s in segments], num_threads=1)
        found = {}
        for k, s in enumerate(segments):
            if s[0] != " " and pieces[k].pop(0) != self.blank or b"".join(map(self.b_bytes.__getitem__, pieces[k])) != s.encode("utf-8", "surrogatepass"):
                found[names[k]], ids[k], pieces[k] = (0, "", b""), [], []
        n_a, n_b = np.array(list(map(len, ids))), np.array(list(map(len, pieces)))
        a, b = np.fromiter(chain.from_iterable(ids), np.int64, n_a.sum()), np.fromiter(chain.from_iterable(pieces), np.int64, n_b.sum())
        end_a, end_b = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])  # both have the same bytes, segment by segment
        last_a, last_b = np.isin(end_a, end_b, assume_unique=True), np.isin(end_b, end_a, assume_unique=True)
        links = (a[last_a] << 32 | b[last_b]).tobytes()
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        word = np.concatenate([a + len(self.a_size) * last_a, 2 * len(self.a_size) + b + len(self.b_size) * last_b])
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        words, start = list(map(self.said.__getitem__, word[order].tolist())), 0
        groups = np.concatenate([[0], np.cumsum(last_a)])[np.cumsum(n_a)]
        before = 0
        for s, x, y, g in zip(names, n_a.tolist(), n_b.tolist(), groups.tolist(), strict=True):
            if x:
                found[s] = x << 32 | y, "".join(words[start : start + x + y]), links[8 * before : 8 * g]
                start, before = start + x + y, g
        return found

    def align(self, texts: list[str | None]) -> list[tuple]:
        """Of each text: numbers of A and B tokens in one, the groups' text, the links' pair codes; no tokens if it is null, empty or not told alike by both.

        Tokens of both begin at every single blank or line feed between two other characters, whatever
        stands around them, so the segments between such places are encoded apart, each but once if it is short.
        """
        cut = [_segments(t) if t else [] for t in texts]
        rows = [list(map(self.memo.get, segments)) for segments in cut]
        missing = {s for segments, row in zip(cut, rows, strict=True) if None in row for s, found in zip(segments, row, strict=True) if found is None}
        found = {s: self.old[s] for s in missing & self.old.keys()}
        if new := sorted(missing - found.keys()):
            found |= self._learn(new)
        out = []
        for segments, row in zip(cut, rows, strict=True):
            counts, said, links = zip(*(found[s] if r is None else r for s, r in zip(segments, row, strict=True)), strict=True) if row else ((0,), (), ())
            out.append((0, "", b"") if 0 in counts else (sum(counts), "".join(said)[:-1], b"".join(links)))
        self.memo |= {s: row for s, row in found.items() if len(s) <= MEMO_CHARS}
        if len(self.memo) > MEMO_SEGMENTS:
            self.memo, self.old = {}, self.memo
        return out

    def rest(self) -> None:
        self.old = {}


def _segments(text: str) -> list[str]:
    """Segments of a blank and ``text``: one that begins with a single blank goes without it, one after a line feed or with more white space before it as it stands."""
    if " ".join(text.split()) == text.replace("\n", " "):
        return text.replace("\n", " \n").split(" ")
    return [s[1:] if len(s) > 1 and s[0] == " " and s[1] not in " \n" else s for s in _CUT.split(" " + text)]


@lru_cache(1)
def _loaded(a: str, b: bytes) -> Pair:
    return Pair(a, b)


def encode_bitmaps(owner: np.ndarray, places: np.ndarray, count: int) -> pa.Array:
    """``count`` bitmaps, the k-th of the ``places`` whose ``owner`` is k (sorted by owner and place, distinct): 16-bit numbers, or all bits where that is shorter."""
    sizes = np.bincount(owner, minlength=count)
    dense = 2 * sizes >= FULL
    ends = np.concatenate([[0], np.cumsum(np.where(dense, FULL, 2 * sizes))])
    out = np.zeros(ends[-1], np.uint8)
    thin = ~dense[owner]
    rank = np.arange(len(owner)) - np.concatenate([[0], np.cumsum(sizes)])[owner]
    at = ends[owner[thin]] + 2 * rank[thin]
    out[at], out[at + 1] = places[thin] & 255, places[thin] >> 8
    if dense.any():
        bits = np.zeros((dense.sum(), CONTAINER), bool)
        bits[(np.cumsum(dense) - 1)[owner[~thin]], places[~thin]] = True
        out[ends[:-1][dense][:, None] + np.arange(FULL)] = np.packbits(bits, axis=1, bitorder="little")
    return pa.Array.from_buffers(pa.binary(), count, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(out)])


def decode_bitmaps(maps: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Owner and place of every bit of ``maps``, by owner and place."""
    if not len(maps):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    ends = np.frombuffer(maps.buffers()[1], np.int32)[maps.offset : maps.offset + len(maps) + 1].astype(np.int64)
    data = np.frombuffer(maps.buffers()[2], np.uint8) if maps.buffers()[2] else np.empty(0, np.uint8)
    sizes = np.diff(ends)
    dense = np.flatnonzero(sizes == FULL)
    thin = np.where(sizes == FULL, 0, sizes // 2)
    owner = np.repeat(np.arange(len(maps)), thin)
    at = np.repeat(ends[:-1] - 2 * (np.cumsum(thin) - thin), thin) + 2 * np.arange(len(owner))
    place = data[at].astype(np.int64) | data[at + 1].astype(np.int64) << 8
    if len(dense):
        row, bit = np.nonzero(np.unpackbits(data[ends[dense][:, None] + np.arange(FULL)], axis=1, bitorder="little"))
        owner, place = np.concatenate([owner, dense[row]]), np.concatenate([place, bit])
        order = np.lexsort((place, owner))
        owner, place = owner[order], place[order]
    return owner, place


def _planes(key: np.ndarray, place: np.ndarray, times: np.ndarray, count: int) -> pa.ListArray:
    """For each of ``count`` keys, the bitmaps of the places whose multiplicity has bit 0, 1 and so on."""
    top = np.zeros(count, np.int64)
    np.maximum.at(top, key, times)
    depth = np.frexp(top.astype(np.float64))[1].astype(np.int64)
    first = np.concatenate([[0], np.cumsum(depth)])
    owners, places = [], []
    for k in range(int(depth.max(initial=0))):
        has = (times >> k & 1).astype(bool)
        owners.append(first[key[has]] + k)
        places.append(place[has])
    owner = np.concatenate(owners) if owners else np.empty(0, np.int64)
    place = np.concatenate(places) if places else np.empty(0, np.int64)
    order = np.lexsort((place, owner))
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), encode_bitmaps(owner[order], place[order], int(first[-1])))


def _multiplicities(planes: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place and multiplicity of every document in the rows' planes."""
    starts = planes.offsets.to_numpy().astype(np.int64)
    owner, place = decode_bitmaps(planes.values.slice(starts[0], starts[-1] - starts[0]))
    depth = np.diff(starts)
    row = np.repeat(np.arange(len(planes)), depth)[owner]
    plane = (np.arange(starts[-1] - starts[0]) - np.repeat(starts[:-1] - starts[0], depth))[owner]
    code, at = np.unique(row * CONTAINER + place, return_inverse=True)
    times = np.zeros(len(code), np.int64)
    np.add.at(times, at, np.left_shift(1, plane))
    return code // CONTAINER, code % CONTAINER, times


def _aligner(given):
    """Every document numbered in a container, with its counts, digest and distinct pairs."""
    names = ["container", "place", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "pairs", "times"]

    def run(batches):
        both, base, n = _loaded(*given.value), TaskContext.get().partitionId() << 32, 0
        for whole in batches:
            at = 0
            while at < whole.num_rows:
                texts, size = [], 0
                for t in whole.column(1).slice(at, ROWS):
                    texts.append(t.as_py())
                    size += len(texts[-1] or "")
                    if size > CHARS:
                        break
                made, pairs, times, ends = [], [], [], [0]
                for counts, said, links in both.align(texts):
                    linked = np.frombuffer(links, np.int64)
                    distinct, count = np.unique(linked, return_counts=True)
                    pairs.append(distinct)
                    times.append(count)
                    ends.append(ends[-1] + len(distinct))
                    made.append((counts >> 32, counts & 0xFFFFFFFF, len(linked), sha256(said.encode()).hexdigest() if counts else ""))
                k = n + np.arange(len(texts))
                numbers = [pa.array([m[x] for m in made], t) for x, t in ((0, pa.int64()), (1, pa.int64()), (2, pa.int64()), (3, pa.string()))]
                offsets = pa.array(ends, pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(v).astype(t))) for v, t in ((pairs, np.int64), (times, np.int32))]
                yield pa.RecordBatch.from_arrays([pa.array(base + k // CONTAINER), pa.array((k % CONTAINER).astype(np.int32)), whole.column(0).slice(at, len(texts)), *numbers, *lists], names)
                at, n = at + len(texts), n + len(texts)
        both.rest()

    return run


def _inverter(batches):
    """Bitmaps of each pair and container over what the task has gathered; a pair may come more than once."""

    def flush(held):
        pair, container, place, times = map(np.concatenate, zip(*held, strict=True))
        order = np.lexsort((container, pair))
        pair, container, place, times = pair[order], container[order], place[order], times[order]
        new = np.concatenate([[True], (pair[1:] != pair[:-1]) | (container[1:] != container[:-1])])
        planes = _planes(np.cumsum(new) - 1, place, times, int(new.sum()))
        return pa.RecordBatch.from_arrays([pa.array(pair[new]), pa.array(container[new]), planes], ["pair", "container", "planes"])

    held, size = [], 0
    for batch in batches:
        lists = batch.column(2)
        each = np.diff(lists.offsets.to_numpy())
        at = np.repeat(np.arange(batch.num_rows), each)
        if len(at):
            held.append((lists.flatten().to_numpy(), batch.column(0).to_numpy()[at], batch.column(1).to_numpy()[at].astype(np.int64), batch.column(3).flatten().to_numpy().astype(np.int64)))
            size += len(at)
        if size > POSTINGS:
            yield flush(held)
            held, size = [], 0
    if held:
        yield flush(held)


def _merger(batches):
    """OR of the planes of each pair and container, which come sorted, with its documents and links by popcount."""
    rest = None
    for batch in batches:
        rest = batch if rest is None else pa.concat_batches([rest, batch])
        pair, container = rest.column(0).to_numpy(), rest.column(1).to_numpy()
        last = np.flatnonzero((pair != pair[-1]) | (container != container[-1]))
        cut = last[-1] + 1 if len(last) else 0
        if cut:
            yield _merged(rest.slice(0, cut))
            rest = pa.concat_batches([rest.slice(cut)])
    if rest is not None and rest.num_rows:
        yield _merged(rest)


def _merged(batch: pa.RecordBatch) -> pa.RecordBatch:
    batch = pa.concat_batches([batch])
    pair, container = batch.column(0).to_numpy(), batch.column(1).to_numpy()
    new = np.concatenate([[True], (pair[1:] != pair[:-1]) | (container[1:] != container[:-1])])
    key, count = np.cumsum(new) - 1, int(new.sum())
    row, place, times = _multiplicities(batch.column(2))
    code, at = np.unique(key[row] * CONTAINER + place, return_inverse=True)
    merged = np.zeros(len(code), np.int64)
    np.bitwise_or.at(merged, at, times)
    owner = code // CONTAINER
    links = np.zeros(count, np.int64)
    np.add.at(links, owner, merged)
    columns = [pa.array(pair[new]), pa.array(container[new]), _planes(owner, code % CONTAINER, merged, count), pa.array(np.bincount(owner, minlength=count)), pa.array(links)]
    return pa.RecordBatch.from_arrays(columns, ["pair", "container", "planes", "docs", "links"])


def _returner(batches):
    """Scores of each document of a container, whose postings come together: links whose pair is its B id's best, and the sum of their pairs' counts."""
    now, best, total, seen = None, np.zeros(CONTAINER, np.int64), np.zeros(CONTAINER, np.int64), np.zeros(CONTAINER, bool)

    def flush():
        places = np.flatnonzero(seen)
        columns = [pa.array(np.full(len(places), now)), pa.array(places.astype(np.int32)), pa.array(best[places]), pa.array(total[places])]
        for x in (best, total, seen):
            x[:] = 0
        return pa.RecordBatch.from_arrays(columns, ["container", "place", "n_best", "count_sum"])

    for batch in batches:
        container = batch.column(0).to_numpy()
        row, place, times = _multiplicities(pa.concat_batches([batch]).column(1))
        links, leads = batch.column(2).to_numpy(), batch.column(3).to_numpy()
        for c in container[np.concatenate([[True], container[1:] != container[:-1]])]:
            if now is not None and c != now:
                yield flush()
            now, mine = c, container[row] == c
            np.add.at(total, place[mine], times[mine] * links[row[mine]])
            np.add.at(best, place[mine], times[mine] * leads[row[mine]])
            seen[place[mine]] = True
    if now is not None:
        yield flush()


def _files(spark, a_path: str, b_path: str):
    with open(a_path, encoding="utf-8") as a, open(b_path, "rb") as b:
        return spark.sparkContext.broadcast((a.read(), b.read()))


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Documents with their alignment, and the table of pairs.

    The first has a row a document: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.  The second has a row for each pair of
    ids that some link holds: ``a, b, docs, links, best`` (whether no other A id has more links with this B id).

    A encodes a blank and the text, B the text, to which it adds one; special tokens' strings are plain text.  Texts that are null, empty or that B does
    not give back byte by byte have zeros and an empty digest.  Every row counts, copies and rows of null or repeated ids alike; other columns are
    not read; very long texts are encoded whole; an empty table gives two empty ones.  The vocabulary files are read by the driver and broadcast: of one size, whatever the input.

    A container holds one task's documents, so its number needs no count of the corpus.  Hot pairs are spread over their containers: a bitmap has 512 bytes at most.
    """
    spark = docs.sparkSession
    texts = bounded_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(texts.dtypes)["doc_id"]
    schema = f"container bigint, place int, doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, pairs array<bigint>, times array<int>"
    aligned = written(texts.mapInArrow(tidy(_aligner(_files(spark, a_path, b_path))), schema), "aligned")

    width = shuffle_width(spark)
    postings = aligned.select("container", "place", "pairs", "times").mapInArrow(tidy(_inverter), "pair bigint, container bigint, planes array<binary>")
    postings = postings.repartition(width, "pair", "container").sortWithinPartitions("pair", "container")
    postings = written(postings.mapInArrow(tidy(_merger), "pair bigint, container bigint, planes array<binary>, docs bigint, links bigint"), "postings")

    pairs = postings.groupBy("pair").agg(F.sum("docs").alias("docs"), F.sum("links").alias("links"))
    pairs = pairs.select("pair", F.shiftright("pair", 32).cast("int").alias("a"), F.col("pair").bitwiseAND(0xFFFFFFFF).cast("int").alias("b"), "docs", "links")
    pairs = written(pairs, "pairs")
    most = pairs.groupBy("b").agg(F.max("links").alias("most"))
    pairs = pairs.join(most, "b").select("pair", "a", "b", "docs", "links", (F.col("links") == F.col("most")).alias("best"))

    scored = postings.select("pair", "container", "planes").join(pairs.select("pair", "links", F.col("best").cast("bigint").alias("best")), "pair")
    scored = scored.select("container", "planes", "links", "best").repartition(width, "container").sortWithinPartitions("container")
    scores = scored.mapInArrow(tidy(_returner), "container bigint, place int, n_best bigint, count_sum bigint")
    out = aligned.drop("pairs", "times").join(scores, ["container", "place"], "left")
    zero = F.lit(0).cast("bigint")
    out = out.select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
    return out, pairs.drop("pair")
