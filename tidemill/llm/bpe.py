"""Byte-level BPE encoding and decoding with a public vocabulary; merges by a segment tree over pair ranks."""

from __future__ import annotations

import json
from array import array
from functools import lru_cache
from itertools import islice, pairwise
from string import punctuation

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bounded_batches, tidy

#: Fixed values of byte-level BPE: how a text is cut before merging, with Unicode's own white space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
NEVER = 1 << 60
#: Children of a node of the segment tree.
FAN = 32
#: Pieces of up to this many characters are remembered, up to this many of them.
MEMO_CHARS, MEMO_PIECES = 48, 400_000
#: Pieces that a worker keeps between tasks: those it met first, which are the frequent ones.
KEPT_PIECES = 150_000
ROWS = 256


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself if visible Latin-1, else the next free one from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    table = {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}
    return [table[b] for b in range(256)]


class ByteBpe:
    """A byte-level BPE vocabulary, from the text of its JSON file."""

    def __init__(self, text: str):
        made = json.loads(text)
        self._refuse_others(made)
        vocab = made["model"]["vocab"]
        letters = _byte_letters()
        self.byte_ids = [vocab[c] for c in letters]
        pairs = [p if isinstance(p, list) else p.split(" ") for p in made["model"]["merges"]]
        self.ranks = {vocab[a] << 20 | vocab[b]: rank for rank, (a, b) in enumerate(pairs)}
        self.made = [vocab[a + b] for a, b in pairs]
        back = {c: b for b, c in enumerate(letters)}
        bytes_of = {i: bytes(back[c] for c in s) for s, i in vocab.items() if all(c in back for c in s)}
        self.added = {t["content"]: t["id"] for t in made.get("added_tokens") or []}
        bytes_of |= {i: s.encode() for s, i in self.added.items()}
        self.bytes_of = [bytes_of.get(i, b"") for i in range(max(bytes_of) + 1)]
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.pieces = regex.compile(PATTERN)
        self.memos: tuple[dict[str, bytes], dict[str, bytes]] = {}, {}
        self.old: tuple[dict[str, bytes], dict[str, bytes]] = {}, {}
        self.newline = self._cut_up("\n")

    @staticmethod
    def _refuse_others(made: dict) -> None:
        """Raise for a file whose settings would give other ids than plain byte-level BPE does."""
        model, pre = made["model"], made.get("pre_tokenizer") or {}
        odd = [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
        odd += ["type"] if model.get("type", "BPE") != "BPE" else []
        odd += ["normalizer"] if made.get("normalizer") else []
        odd += ["pre_tokenizer"] if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space", True) or not pre.get("use_regex", True) else []
        odd += [t["content"] for t in made.get("added_tokens") or [] if t.get("lstrip") or t.get("rstrip") or t.get("single_word")]
        if odd:
            raise ValueError(f"not a plain byte-level BPE vocabulary: {', '.join(odd)}")

    def merge(self, raw: bytes) -> list[int]:
        """Ids of one piece.

        ``levels`` is a segment tree over the adjacent pairs: a leaf holds ``rank * n + place``, a node the
        least of its ``FAN`` children, so the root is the leftmost lowest-rank merge.  A merge rewrites at
        most three leaves and the nodes above them; most pieces are so short that the root is the only node.
        """
        ids = list(map(self.byte_ids.__getitem__, raw))
        n, rank_of, made = len(ids), self.ranks.get, self.made
        if n < 2:
            return ids
        leaves = [NEVER if (r := rank_of(a << 20 | b)) is None else r * n + i for i, (a, b) in enumerate(pairwise(ids))]
        levels = [leaves]
        while len(levels[-1]) > FAN:
            below = levels[-1]
            levels.append([min(below[k : k + FAN]) for k in range(0, len(below), FAN)])
        top, deep = levels[-1], len(levels) > 1
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while (root := min(top)) < NEVER:
            r, i = divmod(root, n)
            j = after[i]
            now = ids[i] = made[r]
            ids[j] = -1
            k, p = after[j], before[i]
            after[i] = k
            if k < n:
                before[k] = i
                leaves[j] = NEVER
                r = rank_of(now << 20 | ids[k])
                leaves[i] = NEVER if r is None else r * n + i
            else:
                leaves[i] = NEVER
            if p >= 0:
                r = rank_of(ids[p] << 20 | now)
                leaves[p] = NEVER if r is None else r * n + p
            if deep:
                spots = {i // FAN, min(j, n - 2) // FAN, max(p, 0) // FAN}
                for below, above in pairwise(levels):
                    for x in spots:
                        above[x] = min(below[x * FAN : x * FAN + FAN])
                    spots = {x // FAN for x in spots}
        return [x for x in ids if x >= 0]

    def _piece(self, piece: str, spaced: bool) -> bytes:
        """Ids of a piece, with a blank before it if ``spaced``, as int32 bytes.  A full memo becomes the old one, from which pieces in use come back."""
        memo = self.memos[spaced]
        ids = memo.get(piece)
        if ids is None:
            ids = self.old[spaced].get(piece)
            if ids is None:
                ids = array("i", self.merge((" " + piece if spaced else piece).encode("utf-8", "surrogatepass"))).tobytes()
            if len(piece) <= MEMO_CHARS:
                if len(self.memos[0]) + len(self.memos[1]) > MEMO_PIECES:
                    self.memos, self.old = ({}, {}), self.memos
                self.memos[spaced][piece] = ids
        return ids

    def _cut_up(self, text: str) -> bytes:
        """Ids of a text without added tokens, cut by the pattern and merged piece by piece."""
        return b"".join(self._piece(p[1:], True) if p[0] == " " and len(p) > 1 and p[1] != " " else self._piece(p, False) for p in self.pieces.findall(text))

    def _word(self, word: str, spaced: bool) -> bytes:
        """Ids of a run of characters without white space: letters and closing signs are two pieces, all else is cut by the pattern."""
        core = word.rstrip(punctuation)
        if not core.isalpha():
            return self._cut_up(" " + word if spaced else word)
        return self._piece(core, spaced) + self._piece(word[len(core) :], False) if len(core) < len(word) else self._piece(core, spaced)

    def _known(self, words: list[str], spaced: bool) -> list[bytes]:
        found = list(map(self.memos[spaced].get, words))
        if None in found:
            word = self._word
            return [word(w, spaced) if ids is None else ids for ids, w in zip(found, words, strict=True)]
        return found

    def rest(self) -> None:
        """Give back memory at the end of a task; the worker may next run something else."""
        self.memos, self.old = tuple(dict(islice(m.items(), KEPT_PIECES)) for m in self.memos), ({}, {})

    def _plain(self, text: str, out: list[bytes]) -> None:
        """Append the ids of a text without added tokens.

        A piece begins at every single blank or line feed between two other characters, whatever
        stands around them: where all white space is of that kind, words are cut one by one.  Lines with other white space, and those that these touch, are cut together by the pattern.
        """
        if " ".join(words := text.split()) == text.replace("\n", " ") and words:
            if "\n" not in text:
                out += self._known(words[:1], False)
                out += self._known(words[1:], True)
                return
            lines = [line.split(" ") for line in text.split("\n")]
            firsts = self._known([line[0] for line in lines], False)
            rest = self._known([w for line in lines for w in line[1:]], True)
            at = 0
            for first, line in zip(firsts, lines, strict=True):
                out.append(first)
                end = at + len(line) - 1
                out += rest[at:end]
                out.append(self.newline)
                at = end
            out.pop()
            return
        lines = text.split("\n")
        open_, ends = [], [bool(x) and not x[0].isspace() and not x[-1].isspace() for x in lines]
        for k, line in enumerate(lines):
            open_.append(line)
            if k + 1 == len(lines) or ends[k] and ends[k + 1]:
                part = "\n".join(open_)
                if len(open_) == 1 and ends[k] and " ".join(words := line.split()) == line:
                    out += self._known(words[:1], False)
                    out += self._known(words[1:], True)
                else:
                    out.append(self._cut_up(part))
                if k + 1 < len(lines):
                    out.append(self.newline)
                open_ = []

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text, int32; strings of added tokens become those tokens."""
        out: list[bytes] = []
        for part in self.cut.split(text) if self.cut and any(a in text for a in self.added) else (text,):
            if part in self.added:
                out.append(array("i", [self.added[part]]).tobytes())
            elif part:
                self._plain(part, out)
        return np.frombuffer(b"".join(out), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, special tokens included; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")


@lru_cache(2)
def _loaded(text: str) -> ByteBpe:
    return ByteBpe(text)


def _vocabulary(spark: SparkSession, path: str):
    """The vocabulary file, read by the driver and broadcast: of one fixed size, whatever the input."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, pa.array(np.concatenate(rows) if rows else np.empty(0, np.int32)))


def encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with ``ids_col`` (array<int>) in place of ``text_col``, equal to the public tokenizers library's encoding
    without special tokens added, truncation or padding.

    A row in, a row out: no shuffle and no state but the memo of short pieces, which is dropped when full.
    A vocabulary file with settings other than plain byte-level BPE is refused.
    Null and empty texts give an empty array; texts of any length are encoded whole; other columns, nulls and
    repeated rows pass through; a column already named ``ids_col`` is replaced.
    """
    given = _vocabulary(docs.sparkSession, path)
    keep = [c for c in docs.columns if c not in (text_col, ids_col)]

    def run(batches):
        bpe = _loaded(given.value)
        for whole in batches:
            for at in range(0, max(1, whole.num_rows), ROWS):
                batch = whole.slice(at, ROWS)
                ids = _lists([bpe.encode(t or "") for t in batch.column(len(keep)).to_pylist()])
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], ids], [*keep, ids_col])
        bpe.rest()

    schema = docs.select(*keep, F.array().cast("array<int>").alias(ids_col)).schema
    return bounded_batches(docs).select(*keep, F.col(text_col).cast("string")).mapInArrow(tidy(run), schema)


def decode(rows: DataFrame, path: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """``rows`` with ``text_col`` decoded from ``ids_col``, which stays.  Null and empty arrays give an empty text."""
    given = _vocabulary(rows.sparkSession, path)
    keep = [c for c in rows.columns if c not in (ids_col, text_col)]

    def run(batches):
        bpe = _loaded(given.value)
        for whole in batches:
            for at in range(0, max(1, whole.num_rows), ROWS):
                batch = whole.slice(at, ROWS)
                ids = batch.column(len(keep))
                text = pa.array([bpe.decode(x.values.to_numpy()) if x.is_valid else "" for x in ids], pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns, text], [*keep, ids_col, text_col])

    schema = rows.select(*keep, ids_col, F.lit("").alias(text_col)).schema
    return bounded_batches(rows).select(*keep, F.col(ids_col).cast("array<int>")).mapInArrow(tidy(run), schema)
