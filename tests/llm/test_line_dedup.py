"""Line dedup against brute force over all pairs of distinct lines."""

import random

from pyspark.sql import functions as F

from tidemill.llm import line_dedup

SCHEMA = "doc_id bigint, text string"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def brute(rows, threshold=2):
    lines = [(i, k, line) for i, t in rows for k, line in enumerate((t or "").lower().replace("\r", " ").replace("\t", " ").split("\n"))]
    lines = [(i, k, x.strip(" ")) for i, k, x in lines if x.strip(" ")]
    texts = sorted({x for *_, x in lines})
    part, links = {x: x for x in texts}, dict.fromkeys(texts, 0)

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for k, a in enumerate(texts):
        for b in texts[:k]:
            if min(len(a), len(b)) > threshold and abs(len(a) - len(b)) <= threshold and distance(a, b) <= threshold:
                links[a] += 1
                links[b] += 1
                part[find(a)] = find(b)
    first = {}
    for i, k, x in sorted(lines, key=lambda r: ((r[0] is not None, r[0]), r[1])):
        first.setdefault(find(x), (i, k))
    return {(i, k): (*first[find(x)], links[x], first[find(x)] == (i, k)) for i, k, x in lines}


def corpus(seed=3, sizes=(20, 60), alphabet="abcdé ", edits="xyzÉ中\U0001f600\U0001f601", bases=25):
    r = random.Random(seed)
    bases = ["".join(r.choice(alphabet) for _ in range(r.randint(*sizes))).strip() or "abc" for _ in range(bases)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(r.randint(1, 6)):
            s = list(r.choice(bases))
            for _ in range(r.choice([0, 1, 1, 2, 3])):
                at = r.randrange(len(s) + 1)
                s[at : at + r.choice([0, 1])] = [r.choice(edits)] if r.random() < 0.7 else []
            lines.append("".join(s) + r.choice(["", "\r", "  ", "\t"]))
        rows.append((i, "\n".join(lines)))
    return [*rows, (60, ""), (61, None), (62, "\n\n"), (63, "short\nshort"), (64, "x" * 20000)]


def classes(spark, rows):
    return {(r.doc_id, r.line_no): (r.class_doc, r.class_line, r.n_links, r.kept) for r in line_dedup.line_classes(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_short_lines_equal_brute_force(spark):
    rows = corpus(8, (3, 23), "abcdefghij", "xyé", 60)
    assert classes(spark, rows) == brute(rows)
    few = [(i, x) for i, x in enumerate(["a", "b", "ab", "abc", "abd", "abcd", "xbc", "qrs", "abcde", "aab", ""])]
    assert classes(spark, few) == brute(few)


def test_hot_segments_lose_no_link(spark, monkeypatch):
    """Lines of one template, and long runs of one character, at a bound that refines nearly every key."""
    r = random.Random(4)
    rows = [(1000 + i, f"page {r.randrange(10**6):06d} of the annual report of the company {r.choice(['a', 'bb', 'ccc'])}\n" + "z" * r.randint(3, 40)) for i in range(150)] + corpus(9)
    want = brute(rows)
    for bound in (2, 60):
        monkeypatch.setattr(line_dedup, "HOT_PAIRS", bound)
        assert classes(spark, rows) == want


def test_a_template_line_five_thousand_times_over(spark):
    rows = [(i, f"Page {i * 7919 % 10**9:09d} of the annual report") for i in range(5000)]
    out = classes(spark, rows)
    texts = {i: f"{i * 7919 % 10**9:09d}" for i, _ in rows}
    for i in range(0, 5000, 1250):
        assert out[i, 0][2] == sum(distance(texts[i], x) <= 2 for j, x in texts.items() if j != i)


def test_null_ids_and_repeated_rows(spark):
    rows = [(None, "one line here"), (3, "one lime here"), (3, "one lime here"), (1, "another thing")]
    out = sorted((r.doc_id or 0, r.class_doc, r.n_links, r.kept) for r in line_dedup.line_classes(spark.createDataFrame(rows, SCHEMA)).collect())
    assert out == [(0, None, 1, True), (1, 1, 0, True), (3, None, 1, False), (3, None, 1, False)]


def test_equals_brute_force(spark):
    rows = corpus()
    assert classes(spark, rows) == brute(rows)


def test_banded_distance_is_exact_up_to_the_threshold(spark):
    r, rows = random.Random(5), []
    for _ in range(3000):
        a = "".join(r.choice("abc") for _ in range(r.randint(3, 30)))
        b = list(a)
        for _ in range(r.randint(0, 4)):
            at = r.randrange(len(b) + 1)
            b[at : at + r.randint(0, 1)] = [r.choice("abc")] * r.randint(0, 1)
        if abs(len(a) - len(b)) <= 2 and len(b) > 2:
            rows.append((a, "".join(b)))
    df = spark.createDataFrame(rows, "a string, b string")
    both = df.select(F.least(line_dedup.within(F.col("a"), F.col("b"), 2), F.lit(3)).alias("x"), F.least(F.levenshtein("a", "b"), F.lit(3)).alias("y"))
    assert both.where("x <> y").count() == 0


def test_documents_keep_first_lines(spark):
    line = "this is a line of more than twenty four bytes"
    df = spark.createDataFrame([(1, f"{line}\nown one"), (2, line.replace("more", "mare")), (3, f"\nother\n{line.upper()}"), (4, ""), (None, None)], SCHEMA).selectExpr("*", "1 as kept", "2 as line_no")
    out = {r.doc_id: r.text for r in line_dedup.drop_repeated_lines(df).collect()}
    assert out == {1: f"{line}\nown one", 3: "\nother", 4: "", None: None}
    assert line_dedup.drop_repeated_lines(df).columns == df.columns


def test_rows_of_a_null_or_repeated_id_lose_their_own_lines_alone(spark):
    rows = [(None, "common\nalpha"), (None, "beta\ncommon"), (None, "gamma\ndeltoids"), (None, "common"), (7, "common\nseven"), (7, "eight\nnine"), (8, "common"), (9, "alpha\nten")]
    out = sorted((r.doc_id or 0, r.text) for r in line_dedup.drop_repeated_lines(spark.createDataFrame(rows, SCHEMA)).collect())
    left = [line for _, text in out for line in text.split("\n")]
    assert sorted(left) == sorted({line for _, text in rows for line in text.split("\n")})
    assert [x for x in out if x[0]] == [(7, "eight\nnine"), (7, "seven"), (9, "ten")]


def test_empty_table(spark):
    assert line_dedup.line_classes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_main_path_has_no_python(spark):
    df = spark.createDataFrame([(1, "a\nb")], SCHEMA)
    plan = line_dedup.drop_repeated_lines(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_removal_is_linear_in_a_documents_lines(spark):
    import time

    numbers = F.sequence(F.lit(0), F.lit(600_000))
    rows = spark.range(1).select(F.array_join(F.transform(numbers, lambda k: k.cast("string")), "\n").alias("t"), F.filter(numbers, lambda k: k % 3 != 1).alias("g"))
    began = time.time()
    text = rows.select(line_dedup._without(F.col("t"), F.col("g")).alias("x")).first()["x"]
    assert text == "\n".join(str(k) for k in range(1, 600_001, 3)) and time.time() - began < 30
    few = spark.createDataFrame([("a\n\nb\nc", [0]), ("a\n\nb\nc", [3]), ("a\n\nb", [0, 2]), ("x", [0])], "t string, g array<int>")
    assert [r.x for r in few.select(line_dedup._without(F.col("t"), F.col("g")).alias("x")).collect()] == ["\nb\nc", "a\n\nb", "", ""]
