"""Alignment against a plain version that encodes whole texts with the two libraries and counts pairs in a dictionary."""

import random
from collections import Counter
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest

from tidemill.llm import token_align
from tidemill.llm.queries import op12_tokenizer_alignment, vocabulary_path

A, B = vocabulary_path(), vocabulary_path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def plain(docs, libraries):
    a, b = libraries
    letters = token_align._byte_letters()
    rows = []
    for doc, text in docs:
        ids, pieces = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        names = [b.id_to_piece(p) for p in pieces]
        a_bytes = [bytes(letters.index(c) for c in a.id_to_token(i)) for i in ids]
        b_bytes = [bytes([int(n[3:5], 16)]) if len(n) == 6 and n.startswith("<0x") else n.replace("▁", " ").encode() for n in names]
        raw = (" " + text).encode() if text else b""
        if b"".join(a_bytes) != raw or b"".join(b_bytes) != raw:
            ids = pieces = a_bytes = b_bytes = []
        at_a, at_b = np.cumsum([len(x) for x in a_bytes], dtype=int).tolist(), np.cumsum([len(x) for x in b_bytes], dtype=int).tolist()
        links = [(x, y) for x, p in zip(ids, at_a, strict=True) for y, q in zip(pieces, at_b, strict=True) if p == q] if len(ids) < 400 else [(ids[at_a.index(e)], pieces[at_b.index(e)]) for e in at_a if e in set(at_b)]
        groups, was = [], 0
        for e in [e for e in at_a if e in set(at_b)]:
            groups.append(",".join(str(x) for x, p in zip(ids, at_a, strict=True) if was < p <= e) + "|" + ",".join(str(y) for y, q in zip(pieces, at_b, strict=True) if was < q <= e))
            was = e
        rows.append((doc, len(ids), len(pieces), groups, links))
    count = Counter(p for *_, links in rows for p in links)
    most = {}
    for (_, y), n in count.items():
        most[y] = max(most.get(y, 0), n)
    return sorted(
        ((doc, n, m, len(g), len(k), sum(count[p] == most[p[1]] for p in k), sum(count[p] for p in k), sha256(";".join(g).encode()).hexdigest() if n else "") for doc, n, m, g, k in rows),
        key=repr,
    )


def rows_of(df):
    assert df.columns == COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=repr)


def fuzz(n):
    rng = random.Random(3)
    bits = ["the", " ", "  ", "\n", "\n\n", " \n", "\t", "\r\n", " ", "　", "\x1c", "é", "é", "ﬁ", "漢字", "🙂👍🏽", "<s>", "</s>", "<|endoftext|>", "<0x41>", "<unk>", "'s", "don't", "!!", "1234", "‍", "\x00", "_", "Ünïcode", "def f(x):", "    ", "ẞ", "́", "İ"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(1, 12))) for _ in range(n)]


def test_equals_plain_version(spark, libraries):
    texts = [None, "", " ", "\n", "a", "the the the", "▁mark", "x ▁", "tail ", " head", *fuzz(400), "long word " * 60 + "z" * 3000, " " * 50, "the" * 90]
    docs = [*enumerate(texts), (None, "no id"), (5, "repeated id"), (5, "repeated id")]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id bigint, text string, pair int, container string").repartition(3)
    assert rows_of(token_align.align(df, A, B)[0]) == plain(docs, libraries)


def test_query_over_the_small_table(spark, libraries):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(op12_tokenizer_alignment(spark, SF)) == plain(docs, libraries)


def test_pairs_and_small_containers(spark, libraries, monkeypatch):
    texts = ["red green blue " * k for k in range(1, 40)] + ["red"] * 300
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(2)
    monkeypatch.setattr(token_align, "POSTINGS", 50)
    docs, pairs = token_align.align(df, A, B)
    assert rows_of(docs) == plain(list(enumerate(texts)), libraries)
    top = max(pairs.collect(), key=lambda r: r["docs"])
    assert top["docs"] == 339 and top["links"] == sum(range(1, 40)) + 300 and top["best"]


def test_empty(spark):
    docs, pairs = token_align.align(spark.createDataFrame([], "doc_id bigint, text string"), A, B)
    assert docs.collect() == [] and pairs.collect() == []


def test_bitmaps_round_trip_and_merge():
    rng = np.random.default_rng(1)
    sizes = [0, 1, 255, 256, 4096, 3, 0]
    owner = np.repeat(np.arange(len(sizes)), sizes)
    place = np.concatenate([np.sort(rng.choice(4096, n, replace=False)) for n in sizes])
    maps = token_align.encode_bitmaps(owner, place, len(sizes))
    assert [len(x.as_py()) for x in maps] == [0, 2, 510, 512, 512, 6, 0]
    for got, want in zip(token_align.decode_bitmaps(maps), (owner, place), strict=True):
        assert (got == want).all()
    planes = token_align._planes(np.array([0, 0, 1, 2, 2]), np.array([5, 9, 5, 1, 7]), np.array([6, 1, 2, 1, 6]), 3)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 1, 2]), pa.array([4, 4, 4]), planes], ["pair", "container", "planes"])
    merged = token_align._merged(batch).to_pylist()
    assert [(r["pair"], r["docs"], r["links"]) for r in merged] == [(1, 2, 7), (2, 2, 7)]
