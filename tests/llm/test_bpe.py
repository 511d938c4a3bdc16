"""Ids and texts equal the public tokenizers library's."""

import json
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemill.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
POOL = [chr(c) for c in range(0x250)] + [chr(c) for c in (0x85, 0xA0, 0x1680, 0x2028, 0x202F, 0x3000, 0x200B, 0xFEFF, 0x4E2D, 0x1F600, 0x0660, 0x2160, 0x0301, 0x1C, 0x1F)] + [" ", "  ", "\n\n", "<|endoftext|>", "'s", "'LL"] * 8


@pytest.fixture(scope="module")
def mine():
    with open(PATH, encoding="utf-8") as f:
        return bpe.ByteBpe(f.read())


def test_random_texts(mine):
    theirs, r = Tokenizer.from_file(PATH), random.Random(0)
    for _ in range(4000):
        text = "".join(r.choice(POOL) for _ in range(r.randint(0, 30)))
        ids = theirs.encode(text, add_special_tokens=False).ids
        assert mine.encode(text).tolist() == ids
        assert mine.decode(np.array(ids, np.int32)) == theirs.decode(ids, skip_special_tokens=False)


def test_long_piece_and_aged_memo(mine, monkeypatch):
    theirs = Tokenizer.from_file(PATH)
    monkeypatch.setattr(bpe, "MEMO_PIECES", 3)
    for text in ("ab" * 30_000, "one two three four five six one two", "x" * 60 + " y"):
        assert mine.encode(text).tolist() == theirs.encode(text, add_special_tokens=False).ids
    mine.rest()


def test_white_space_of_every_kind(mine):
    theirs, r = Tokenizer.from_file(PATH), random.Random(2)
    gaps = [" "] * 8 + ["\n"] * 4 + ["  ", "\n\n", " \n", "\n ", "\t", "\r\n", "\x1c", "\xa0", "\n \n", "\u3000", "\x0b"]
    words = ["one", "two,", "it's", "I'LL", "x2y", "...", "Éa", "中文", "'", "d'accord", "<|endoftext|>", "a" * 60, "\u200b"]
    for k in range(6000):
        some = gaps[:12] if k % 2 else gaps
        text = "".join(r.choice(words) + r.choice(some) for _ in range(r.randint(1, 25)))
        text = r.choice(["", "", " ", "\n"]) + (text if k % 3 else text.strip())
        assert mine.encode(text).tolist() == theirs.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("part, key, value", [("model", "ignore_merges", True), ("model", "end_of_word_suffix", "</w>"), ("pre_tokenizer", "add_prefix_space", True), (None, "normalizer", {"type": "NFC"}), ("added_tokens", "lstrip", True)])
def test_other_settings_are_refused(part, key, value):
    with open(PATH, encoding="utf-8") as f:
        made = json.load(f)
    (made if part is None else made[part][0] if part == "added_tokens" else made[part])[key] = value
    with pytest.raises(ValueError, match="plain byte-level"):
        bpe.ByteBpe(json.dumps(made))


def test_tables(spark):
    df = spark.createDataFrame([(1, "Hello, wörld"), (None, None), (2, ""), (2, "")], "doc_id bigint, text string").selectExpr("*", "'k' as ids", "7 as n")
    out = bpe.decode(bpe.encode(df, PATH), PATH)
    assert out.columns == ["doc_id", "n", "ids", "text"]
    assert {(r.doc_id, r.text) for r in out.collect()} == {(1, "Hello, wörld"), (None, ""), (2, "")}
    assert bpe.encode(df.limit(0), PATH).count() == 0
