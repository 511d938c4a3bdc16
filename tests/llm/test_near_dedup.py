"""Near-dedup against brute force: every pair of sets compared."""

import random

import pytest

from tidemill.llm import near_dedup

SCHEMA = "doc_id bigint, text string, source string, n_chars bigint"


def sets_of(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def brute(rows, percent):
    sets = {i: sets_of(t) for i, t in rows}
    part = {i: i for i in sets}

    def find(i):
        while part[i] != i:
            i = part[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                part[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed=1, bases=12, copies=18):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6)))
    rows = []
    for _ in range(bases):
        base = [word() for _ in range(r.randint(30, 160))]
        for _ in range(copies):
            text = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, 5])):
                text[r.randrange(len(text))] = word()
            rows.append(" ".join(text))
    rows += ["", None, "one", "ONE", "a b c d e", "A b c d\te", "x " * 300]
    return list(enumerate(rows))


@pytest.mark.parametrize("percent", [50, 80, 85])
def test_equals_brute_force(spark, percent):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "s", 1) for i, t in rows], SCHEMA)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_classes(df, percent=percent).collect()}
    assert got == brute(rows, percent)


def test_blocks_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    rows = corpus(2, 3, 40)
    df = spark.createDataFrame([(i, t, "s", 1) for i, t in rows], SCHEMA)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_classes(df, percent=85).collect()}
    assert got == brute(rows, 85)


def test_strangers_at_the_head_of_every_bucket_part_nobody(spark, monkeypatch):
    """A near pair whose buckets are all headed by smaller documents of low similarity to it, at many blocks a bucket."""
    monkeypatch.setattr(near_dedup, "SIGNATURES", 64)
    monkeypatch.setattr(near_dedup, "missed", lambda s, side, depth: 0.0 if side == 3 else 1.0)
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    passage, own = [word() for _ in range(120)], [word() for _ in range(60)]
    rows = [" ".join(passage + [word() for _ in range(60)]) for _ in range(400)]
    rows += [" ".join(passage[:k] + [word()] + passage[k + 1 :] + own) for k in (3, 60, 110)]
    df = spark.createDataFrame([(i, t, "s", 1) for i, t in enumerate(rows)], SCHEMA)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in near_dedup.near_classes(df, percent=85).collect()}
    want = brute(list(enumerate(rows)), 85)
    assert {want[i][1] for i in (400, 401, 402)} == {400} and got == want


def test_a_group_that_fits_a_block_is_met_once(spark, monkeypatch):
    """Members unlike the head, and unlike each other, take part in one cell of their bucket and in one of their group."""
    dealt, deal = [], near_dedup._blocks

    def spied(rows, group, sizes, *rest):
        cells = deal(rows, group, sizes, *rest)
        dealt.append((group, rows.join(sizes, group, "left_semi").count(), cells.count()))
        return cells

    monkeypatch.setattr(near_dedup, "_blocks", spied)
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    passage = [word() for _ in range(60)]
    rows = [(i, " ".join(passage + [word() for _ in range(10 + 30 * (i % 2))])) for i in range(300)]
    df = spark.createDataFrame([(i, t, "s", 1) for i, t in rows], SCHEMA)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in near_dedup.near_classes(df, percent=80).collect()}
    assert got == brute(rows, 80)
    assert {g for g, *_ in dealt} == {"key", "head"} and all(n and n == made for _, n, made in dealt)


def test_the_banding_follows_the_limit():
    for percent in range(40, 101, 5):
        b = near_dedup.banding(percent)
        assert near_dedup.missed(percent / 100, b.side, b.depth) <= near_dedup.MISS
        assert near_dedup.missed(percent / 100, b.side - 1, b.depth) > near_dedup.MISS or b.side == 1
    assert near_dedup.banding(85) == near_dedup.Banding(8, 2, 13)
    with pytest.raises(ValueError, match="percent"):
        near_dedup.banding(0)


def test_nulls_repeats_and_clashing_names(spark):
    text = "a long enough text of seven words"
    df = spark.createDataFrame([(None, "x"), (2, None), (2, None), (3, text), (1, text), (1, text)], "doc_id bigint, text string").selectExpr("*", "1 as head", "2 as h1", "3 as component")
    rows = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_classes(df).collect()}
    assert rows == {None: (0, None, True), 1: (3, 1, True), 2: (0, 2, True), 3: (3, 1, False)}
    assert sorted((r.doc_id or 0) for r in near_dedup.keep_one(df).collect()) == [0, 1, 2]
    assert near_dedup.keep_one(df).columns == df.columns


def test_rows_of_a_null_or_repeated_id_are_documents_of_their_own(spark):
    copy = "copied text that many of the rows hold"
    other = [f"text number {i} of {i * i} that nothing else in {i * 7} holds" for i in range(40)]
    rows = [(None, t) for t in other[:20]] + [(5, t) for t in other[20:30]] + [(i, t) for i, t in enumerate(other[30:], 100)]
    rows += [(None, copy), (None, copy + " "), (6, copy), (5, copy), (5, copy), (110, copy), (None, ""), (None, None), (5, None)]
    out = [(r.doc_id, r.text) for r in near_dedup.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()]
    assert sorted(out, key=str) == sorted([r for r in rows[:40]] + [(5, copy), (None, ""), (None, None), (5, None)], key=str)


def test_empty_table(spark):
    assert near_dedup.near_classes(spark.createDataFrame([], SCHEMA)).count() == 0
