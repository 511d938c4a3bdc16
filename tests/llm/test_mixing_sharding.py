"""Poisson replication and shard balance against plain versions."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidemill.llm import mixing, sharding

SCHEMA = "doc_id bigint, text string, source string"


def quantile(u, rate):
    k, term, cdf = 0, math.exp(-rate), math.exp(-rate)
    while cdf <= u:
        k += 1
        term *= rate / k
        cdf += term
    return k


def test_counts_invert_the_distribution(spark):
    cases = [(u / 997, rate) for u in range(0, 997, 13) for rate in (0.0, 0.01, 0.7, 3.0, 42.5, 400.0)]
    df = spark.createDataFrame(cases, "u double, rate double")
    for r in df.withColumn("n", mixing.poisson_count(F.col("u"), mixing.poisson_steps(F.col("rate")))).collect():
        assert r.n == quantile(r.u, r.rate), r


def test_mix_reaches_the_weights(spark):
    rows = [(i, f"t{i}", "big" if i % 10 else ("small" if i % 20 else None)) for i in range(8000)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as rate", "2 as n")
    out = mixing.mix(df, weights={"big": 0.5, "small": 0.5}, total=0.5)
    n = Counter(r.source for r in out.select("source").collect())
    assert set(n) == {"big", "small"} and abs(n["big"] - 2000) < 200 and abs(n["small"] - 2000) < 200
    assert out.select("doc_id", "_copy").collect() == mixing.mix(df, weights={"big": 0.5, "small": 0.5}, total=0.5).select("doc_id", "_copy").collect()
    order = [r[0] for r in out.select("_order").collect()]
    assert order == sorted(order)
    assert mixing.mix(df.limit(0)).count() == 0
    assert mixing.mix(df, weights={}).count() == 0


def test_a_rare_source_of_a_large_table_gets_its_copies(spark):
    def number(*x):
        return int(hashlib.md5(":".join(x).encode()).hexdigest()[:13], 16)

    df = spark.range(2_000_000).selectExpr("id as doc_id", "if(id < 1, null, 'big') as source")
    rate = 2_000_000 / (1 + math.sqrt(1_999_999))
    assert rate > 2 * mixing.WHOLE
    got = Counter(r.doc_id for r in mixing.mix(df).where("source is null").select("doc_id").collect())
    pieces = math.ceil(rate / mixing.PIECE)
    names = ["count0", *(f"count0.{k}" for k in range(1, pieces))]
    assert got == {0: sum(quantile(number(x, "0") / mixing.SPAN, rate / pieces) for x in names)}
    assert abs(got[0] - rate) < 6 * math.sqrt(rate)


@pytest.mark.parametrize("rate", [650.0, 3000.0])
def test_large_rates_keep_mean_and_variance(spark, rate):
    df = spark.range(4000).selectExpr("id as doc_id", "'s' as source")
    n = [r[1] for r in mixing.mix(df, weights={"s": 1.0}, total=rate).groupBy("doc_id").agg(F.count("*")).collect()]
    mean = sum(n) / 4000
    assert abs(mean - rate) < 5 * math.sqrt(rate / 4000) and abs(sum((x - mean) ** 2 for x in n) / 4000 / rate - 1) < 0.12


def test_mix_repeats_rows_alike(spark):
    df = spark.createDataFrame([(None, None, None), (None, None, None), (4, "x", "s"), (4, "x", "s")], SCHEMA)
    n = Counter(r.doc_id for r in mixing.mix(df, total=3.0).collect())
    assert all(v % 2 == 0 for v in n.values())


@pytest.mark.parametrize("fine", [1, 64])
def test_shards(spark, fine):
    rows = [(i, "w" * ((i * 37) % 500) + str(i // 3 if i % 5 == 0 else i), "s") for i in range(3000)] + [(9000 + i, "hot text", "s") for i in range(700)] + [(1, None, "s"), (None, "", None), (None, None, "s")]
    out = sharding.shard(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "5 as shard", "6 as size"), 7, fine=fine).collect()
    assert len(out) == len(rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    slots, loads, place = defaultdict(list), Counter(), {}
    for r in out:
        slots[r.shard].append(r.slot)
        loads[r.shard] += r.size
    assert set(slots) <= set(range(7)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    texts = {i: t for i, t, _ in rows if i is not None and t is not None}
    for r in out:
        if r.doc_id in texts and r.doc_id != 1:
            assert place.setdefault(texts[r.doc_id], r.shard) == r.shard
    assert max(loads.values()) < 1.01 * sum(loads.values()) / 7
    assert sharding.shard(spark.createDataFrame([], SCHEMA)).count() == 0


def test_schedule_is_longest_first_to_the_least_loaded():
    loads = [0.0, 0.0, 0.0]
    assert sharding.schedule([(7, "a"), (6, "b"), (5, "c"), (4, "d"), (3, "e")], loads) == [("a", 0), ("b", 1), ("c", 2), ("d", 2), ("e", 1)]
    assert loads == [7, 9, 9]


@pytest.mark.parametrize("pack_groups", [None, 300])
def test_shards_stay_even_at_many_shuffle_partitions(spark, monkeypatch, pack_groups):
    if pack_groups:
        monkeypatch.setattr(sharding, "PACK_GROUPS", pack_groups)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        docs = spark.range(3000).selectExpr("id as doc_id", "concat(repeat('w', cast(400 + pmod(xxhash64(id), 1600) as int)), id) as text", "'s' as source")
        hot = spark.range(40).selectExpr("-id as doc_id", "repeat('hot ', 300) as text", "'s' as source")
        loads = Counter()
        for r in sharding.shard(docs.union(hot), 24).select("shard", "size").collect():
            loads[r.shard] += r.size
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(loads) == 24 and max(loads.values()) < 1.02 * sum(loads.values()) / 24
