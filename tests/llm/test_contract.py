"""The ten queries as they are registered: columns, types and what their contracts fix, on the smallest tables, against plain versions."""

import hashlib
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

import __spark_entry__
from tests.llm.test_near_dedup import brute
from tests.llm.test_quality import counts
from tidemill.llm import queries

SF = "/root/testdata/sf0.001"
TYPES = {
    "op1_line_dedup": "doc_id bigint, line_no int, class_doc bigint, class_line int, n_links bigint, kept boolean",
    "op2_chat_formatting": "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
    "op3_bpe_encoding": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op4_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op5_quality_classifier": "doc_id bigint, held_out boolean, score double, predicted int",
    "op6_hnsw_search": "query_id bigint, rank int, vec_id bigint, score double",
    "op7_minhash_near_dedup": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op8_source_mixing": "doc_id bigint, source string, n_copies bigint",
    "op9_secret_scan": "doc_id bigint, finding_no int, start int, length int, is_secret boolean",
    "op10_lpt_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
}


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def rows(spark):
    made = {}

    def run(name):
        if name not in made:
            df = __spark_entry__.queries()[name](spark, SF)
            made[name] = dict(df.dtypes), df.collect()
        return made[name]

    return run


@pytest.mark.parametrize("name", TYPES)
def test_columns_and_types(rows, name):
    types, found = rows(name)
    assert dict(x.rsplit(" ", 1) for x in TYPES[name].split(", ")).items() <= types.items() and (found or name == "op9_secret_scan")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_conversations(spark, rows):
    spoken, convs = "</s>[INST] ok [/INST]", defaultdict(list)
    for r in sorted(spark.read.parquet(f"{SF}/conversations.parquet").collect(), key=lambda r: (r.conv_id, r.turn)):
        convs[r.conv_id].append((r.role, r.text or ""))
    convs[-7] = [("user", spoken), ("assistant", spoken)]
    got = {r.conv_id: r for r in rows("op2_chat_formatting")[1]}
    assert got.keys() == convs.keys()
    for i, turns in convs.items():
        said = "".join(t for role, t in turns if role == "assistant")
        assert (got[i].n_turns, got[i].turns_sha256, got[i].loss_chars, got[i].loss_sha256) == (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(said), sha(said))
        assert got[i].formatted_chars > sum(len(t) for _, t in turns)


def test_tokens(rows, docs):
    library = Tokenizer.from_file(queries.vocabulary_path())
    for r in rows("op3_bpe_encoding")[1]:
        ids = library.encode(docs[r.doc_id].text or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))


def test_rules(rows, docs):
    found = rows("op4_quality_rules")[1]
    assert Counter(r.doc_id for r in found) == Counter(docs.keys())
    for r in found:
        n = counts(docs[r.doc_id].text)
        assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] == n
        assert r.base_failed == (n[0] < 20 or 100 * n[4] > 30 * n[0]) and not (r.base_failed and r.kept)


def test_scores(spark, rows, docs):
    found = rows("op5_quality_classifier")[1]
    assert Counter(r.doc_id for r in found) == Counter(docs.keys())
    for r in found:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.selectExpr("doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 5 = 0, 1 - quality, quality) as quality")
    docs_df = spark.read.parquet(f"{SF}/documents.parquet")
    measured = queries.quality_model.measure(docs_df)
    gam = queries.quality_model.train(measured, turned.where(~queries.held_out()))
    again = {r.doc_id: r.score for r in queries.quality_model.score(measured, gam).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-9 for r in found)


def test_neighbours(spark, rows):
    vectors = [(r.vec_id, np.array(r.embedding, np.float64)) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    ids, x = np.array([i for i, _ in vectors]), np.stack([v for _, v in vectors])
    unit, got = x / np.sqrt((x * x).sum(1, keepdims=True)), defaultdict(list)
    for r in sorted(queries.op6_hnsw_search(spark, "/root/testdata/sf0.01").collect(), key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    hits = 0
    asked = [i for i in ids.tolist() if i % 50 == 0]
    assert sorted(got) == sorted(asked)
    for q in asked:
        s = unit @ unit[ids == q][0]
        s[ids == q] = -2
        hits += len(set(ids[np.lexsort((ids, -np.round(s, 12)))[:5]].tolist()) & {v for _, v, _ in got[q]})
        assert [k for k, *_ in got[q]] == [1, 2, 3, 4, 5] and all(abs(t - s[ids == v][0]) < 1e-12 for _, v, t in got[q])
    assert hits >= 0.9 * 5 * len(asked)


def test_components(rows, docs):
    want = brute([(i, r.text) for i, r in docs.items()], 85)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows("op7_minhash_near_dedup")[1]} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows("op7_minhash_near_dedup")[1])


def test_mixture_equals_its_sql(rows):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    rel = db.sql(queries.ORACLE_SQL["op8_source_mixing"])
    types, found = rows("op8_source_mixing")
    plain = lambda v: round(v, 5) if isinstance(v, float) else v
    assert set(rel.columns) == set(types)
    assert Counter(tuple(plain(r[c]) for c in rel.columns) for r in found) == Counter(tuple(map(plain, r)) for r in rel.fetchall())


def test_shards(rows, docs):
    found, slots, loads, place = rows("op10_lpt_sharding")[1], defaultdict(list), Counter(), {}
    assert Counter(r.doc_id for r in found) == Counter(docs.keys())
    for r in found:
        raw = (docs[r.doc_id].text or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "bytes", None) and 0 <= r.shard < 24
        assert place.setdefault(raw, r.shard) == r.shard
        slots[r.shard].append(r.slot)
        loads[r.shard] += r.size
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_lines(rows, docs):
    found = rows("op1_line_dedup")[1]
    lines = {(i, k) for i, r in docs.items() for k, x in enumerate((r.text or "").split("\n")) if x.strip(" \t\r")}
    assert {(r.doc_id, r.line_no) for r in found} == lines and len(found) == len(lines)
    classes = defaultdict(list)
    for r in found:
        classes[r.class_doc, r.class_line].append((r.doc_id, r.line_no))
        assert r.kept == ((r.doc_id, r.line_no) == (r.class_doc, r.class_line))
    assert all(min(v) == k for k, v in classes.items())
