"""The whole pipeline against a brute-force version over all documents of the smallest scale."""

import hashlib
import math
from collections import Counter, defaultdict

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_near_dedup import brute as near_brute
from tests.llm.test_quality import WORD, counts
from tidemill.llm import mixing
from tidemill.llm.queries import vocabulary_path

SF = "/root/testdata/sf0.001"


def within(a, b, t=2):
    """Whether two strings are at most ``t`` edits apart, by a banded table."""
    if abs(len(a) - len(b)) > t or sum((Counter(a) - Counter(b)).values()) > t:
        return False
    row = {j: j for j in range(t + 1)}
    for i in range(1, len(a) + 1):
        new = {}
        for j in range(max(0, i - t), min(len(b), i + t) + 1):
            new[j] = i if j == 0 else min(row.get(j, 99) + 1, new.get(j - 1, 99) + 1, row.get(j - 1, 99) + (a[i - 1] != b[j - 1]))
        if min(new.values()) > t:
            return False
        row = new
    return row.get(len(b), 99) <= t


def quality(docs):
    key = lambda line: " ".join(WORD.findall(line)).lower()
    shared, distinct, out = defaultdict(set), defaultdict(set), {}
    for i, (text, source) in docs.items():
        distinct[source].add(i)
        for line in (text or "").split("\n"):
            if WORD.search(line):
                shared[source, key(line)].add(i)
    for i, (text, source) in docs.items():
        limit = max(20, 0.05 * len(distinct[source]))
        lines = (text or "").split("\n")
        gone = {k for k, x in enumerate(lines) if WORD.search(x) and len(shared[source, key(x)]) > limit}
        n, *_, repeat = counts(text)
        if n >= 20 and 100 * repeat <= 30 * n and sum(len(WORD.findall(lines[k])) for k in gone) <= 0.5 * n:
            out[i] = ("\n".join(x for k, x in enumerate(lines) if k not in gone), source)
    return out


def line_dedup(docs):
    rows = [(i, k, x.lower().replace("\r", " ").replace("\t", " ").strip(" ")) for i, (t, _) in sorted(docs.items()) for k, x in enumerate(t.split("\n"))]
    rows = [r for r in rows if r[2]]
    texts = sorted({x for *_, x in rows}, key=len)
    part = {x: x for x in texts}

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for k, a in enumerate(texts):
        for b in texts[k + 1 :]:
            if len(b) > len(a) + 2:
                break
            if len(a) > 2 and within(a, b):
                part[find(a)] = find(b)
    first, gone, had = {}, defaultdict(set), Counter()
    for i, k, x in rows:
        had[i] += 1
        if first.setdefault(find(x), (i, k)) != (i, k):
            gone[i].add(k)
    return {i: ("\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]), s) for i, (t, s) in docs.items() if not had[i] or len(gone[i]) < had[i]}


def mixed(docs):
    number = lambda *x: int(hashlib.md5(":".join(x).encode()).hexdigest()[:13], 16)
    n = Counter(s for _, s in docs.values())
    weights = {s: math.sqrt(k) for s, k in n.items()}
    out = []
    for i, (_, s) in docs.items():
        rate = len(docs) * weights[s] / sum(weights.values()) / n[s]
        u, k, term, cdf = number("count0", str(i)) / mixing.SPAN, 0, math.exp(-rate), math.exp(-rate)
        while cdf <= u:
            k += 1
            term *= rate / k
            cdf += term
        out += [i] * k
    return out


@pytest.fixture(scope="module")
def stages(spark):
    docs = corpus_pipeline.table(spark, SF, "documents")
    rows = [{r.doc_id: (r.text, r.source) for r in docs.collect()}]
    for _, stage in corpus_pipeline.STAGES:
        before = docs
        docs = corpus_pipeline.written(stage(spark, docs, SF), "stage")
        if docs.columns[-1] == "n_chars":
            assert docs.columns == before.columns and docs.where("n_chars <> length(text)").count() == 0
        rows.append(docs.collect())
    return rows


def test_each_stage_on_its_input(stages):
    texts = lambda rows: {r.doc_id: (r.text, r.source) for r in rows}
    original, ruled, lines, near, mix, tokens = stages
    assert texts(ruled) == quality(original)
    assert texts(lines) == line_dedup(texts(ruled))
    classes = near_brute([(i, t) for i, (t, _) in texts(lines).items()], 80)
    assert texts(near) == {i: v for i, v in texts(lines).items() if classes[i][1] == i}
    assert Counter(r.doc_id for r in mix) == Counter(mixed(texts(near)))
    library, given = Tokenizer.from_file(vocabulary_path()), texts(mix)
    assert Counter(r.doc_id for r in tokens) == Counter(r.doc_id for r in mix)
    for r in tokens:
        assert r.ids == library.encode(given[r.doc_id][0], add_special_tokens=False).ids and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(given[r.doc_id][0].encode()).hexdigest()


def test_run_gives_the_last_stage(spark, stages):
    out = corpus_pipeline.run(spark, SF)
    assert Counter(r.doc_id for r in out.select("doc_id").collect()) == Counter(r.doc_id for r in stages[-1])


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def odd_rows():
    prose = lambda k: "\n".join(" ".join(f"w{k}x{i * 31 + j * 7}" for j in range(12)) for i in range(3))
    rows = [(k, prose(k), "en", f"s{k % 3}", 1) for k in range(12)]
    rows += [(None, prose(100), None, None, None), (None, prose(101), "en", "s0", None), (3, prose(102), "en", "s0", 5), (3, prose(102), "en", "s0", 5), (20, None, "en", "s1", None), (21, "", "en", None, 0), (22, "x" * 300_000, "en", "s1", 0), (23, prose(5), "en", "s2", 1)]
    return rows


def test_stages_take_null_ids_repeated_rows_and_clashing_names(spark):
    docs = spark.createDataFrame(odd_rows(), SCHEMA).selectExpr("*", "1 as _row", "2 as kept", "3 as id", "4 as host", "5 as h1", "6 as ids", "7 as _copy", "8 as rate")
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, SF), name)
        assert docs.columns[5:] == ["_row", "kept", "id", "host", "h1", "ids", "_copy", "rate"] and docs.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
        seen.append(Counter((r.doc_id, (r.text or "")[:8]) for r in docs.select("doc_id", "text").collect()))
    ruled, lines, near, _ = seen
    want = Counter((r[0], r[1][:8]) for r in odd_rows() if r[1] and len(r[1].split()) >= 20)
    assert ruled == want and sum(want.values()) == 17
    # equal rows keep their lines together; a copy under another id loses all of its own
    assert lines == want - Counter([(23, "w5x0 w5x")]) and near == lines - Counter([(3, "w102x0 w")])
    tokens = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert tokens.count() == docs.count()


def test_values_of_columns_of_any_name_pass_unharmed(spark):
    names = ["_row", "_check", "_key", "_gone", "_left", "_source", "_copies", "_copy", "_rate", "_order", "_name", "_class", "_n", "doc", "least", "text_key", "removed_keys", "gone", "left"]
    docs = spark.createDataFrame([(*r, *(f"{n}/{r[0]}" for n in names)) for r in odd_rows()[:12]], f"{SCHEMA}, {', '.join(f'{n} string' for n in names)}")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, SF), name)
        rows = docs.collect()
        assert rows and all(r[n] == f"{n}/{r['doc_id']}" for r in rows for n in names), name


def test_stages_take_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_what_a_stage_wrote_is_given_back(spark):
    import glob

    from tidemill.llm import shared

    before = set(glob.glob(f"{shared.shared_dir(spark)}/tidemill/*"))
    with shared.scratch(spark):
        shared.written(spark.range(3), "gone")
        held = shared.kept(spark.range(4))
        held.count()
        out = shared.outlasting(spark.range(5), "stays")
    after = set(glob.glob(f"{shared.shared_dir(spark)}/tidemill/*")) - before
    assert len(after) == 1 and "stays" in after.pop() and out.count() == 5 and not held.is_cached
