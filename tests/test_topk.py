"""Bounded top-k against scoring every pair, on made cases, and the share of pairs that it scores on the largest table."""

import random

import pytest
from pyspark.sql import functions as F

from tidemill.operators import retrieval, topk
from tidemill.plans.retrieval import _queries
from tidemill.sources import tables as S


def made(spark, seed, bare, flat=False):
    r = random.Random(seed)
    terms = [f"t{k}" for k in range(12)]
    share = {t: 0.02 * 1.5**k for k, t in enumerate(terms)}
    chunks = [(d, o, f"s{d % 3}", {t: 1.0 if flat else round(r.uniform(0.1, 2.2), 1) for t in terms if r.random() < share[t]}) for d in range(60) for o in range(10)]
    chunks += [(d, 0, "s1", chunks[5][3]) for d in range(100, 140)]  # ties
    queries = [(q, [(t, round(r.uniform(0.5, 6), 1)) for t in r.sample(terms, r.randint(1, 5))]) for q in range(25)] + [(99, [])]
    heads = [(q, s, round(r.uniform(0.1, 9), 1)) for q, _ in queries for s in ("s0", "s1", "none") if r.random() < 0.4]
    score = topk.summed() + F.coalesce("head", F.lit(0.0))
    index = topk.Index(
        spark.createDataFrame(chunks, "document bigint, ord int, section string, terms map<string,double>"),
        spark.createDataFrame(queries, "qid bigint, q array<struct<term:string,gain:double>>"),
        spark.createDataFrame(heads, "qid bigint, section string, head double"), score, bare,
    )
    head_of, want = {(q, s): h for q, s, h in heads}, {}
    for q, asked in queries:
        rows = []
        for d, o, s, held in chunks:
            shared = [g * held[t] for t, g in asked if t in held]
            if shared or bare and (q, s) in head_of:
                rows.append((-round(sum(shared) + head_of.get((q, s), 0.0), 6), d, o))
        want[q] = sorted(rows)
    return index, want


@pytest.mark.parametrize("seed,bare,flat", [(1, True, False), (2, False, False), (3, False, True)])
@pytest.mark.parametrize("most,least", [(3, None), (40, None), (5, 6.0)])
def test_equals_scoring_every_pair(spark, monkeypatch, seed, bare, flat, most, least):
    monkeypatch.setattr(topk, "BLOCK", 8)
    index, want = made(spark, seed, bare, flat)
    got = {}
    for r in topk.bounded_top(index, most, least).collect():
        got.setdefault(r.qid, {})[r["rank"]] = (-r.score, r.document, r.ord)
    for q, rows in want.items():
        rows = [x for x in rows if least is None or -x[0] >= least][:most]
        assert [got.get(q, {}).get(k + 1) for k in range(len(rows))] == rows and len(got.get(q, {})) == len(rows)


def test_under_a_twentieth_of_the_pairs_is_scored(spark):
    q, c = _queries(spark, "/root/testdata/sf0.1"), retrieval.chunk_tokens(S.chunks(spark, "/root/testdata/sf0.1"))
    pairs = q.count() * c.count()
    assert topk.candidates(retrieval.lexical_index(q, c), 3, retrieval.LEAST_SCORE).count() < 0.02 * pairs
    assert topk.candidates(retrieval.bm25_index(q, c), 10).count() < 0.05 * pairs


def test_a_chunks_roots_are_taken_once_for_all_its_queries(spark):
    chunks = spark.createDataFrame([(1, 0, "договор", "Договор подписан, подписан вчера"), (2, 0, "s", "no root of any")], "document bigint, ord int, section string, text string")
    queries = spark.createDataFrame([(q, text) for q in range(0, 6, 3) for q, text in ((q, "договор"), (q + 1, "подписан"), (q + 2, "оплата"))], "qid bigint, query string")
    hits = queries.select("qid").crossJoin(chunks.select("document", "ord"))
    scored = retrieval.lexical_of(hits, queries, chunks)
    assert "collect_list(qid" in scored._jdf.queryExecution().optimizedPlan().toString()
    want = {(r.qid, r.document): r.score for r in retrieval.lexical_top(queries, chunks, 9, 0.0).collect()}
    got = {(r.qid, r.document): r.score for r in scored.collect()}
    assert len(got) == 12 and {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v} and got[0, 1] == got[3, 1] > 0 == got[2, 1]


def test_hot_terms_are_gathered_in_blocks(spark):
    rows = [(d, 0, "s", {"hot": 1.0}) for d in range(5000)]
    blocks, terms = topk.impact_blocks(spark.createDataFrame(rows, "document bigint, ord int, section string, terms map<string,double>"))
    sizes = [r.n for r in blocks.select(F.size("postings").alias("n")).collect()]
    assert sum(sizes) == 5000 and max(sizes) < 2 * topk.BLOCK and terms.first()["df"] == 5000
