"""Secret scans: candidates by pattern, false positives removed by a random forest, in DataFrame and MLlib functions only."""

from __future__ import annotations

import json
import re
from collections import Counter
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_RUN = r"[A-Za-z0-9+/_.\-]"
_NAMED = r"(?i:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|auth)"
_GIVEN = r"[\"']{0,1}[ ]{0,2}[:=][ ]{0,2}[\"']{0,1}"
#: A candidate: a private key in its armour, the password of a URL, a run of 8 signs or more after a word for a secret, or one of 20 or more that stands alone.
CANDIDATE = "|".join([
    r"-----BEGIN (?:[A-Z0-9]{1,16} ){0,4}PRIVATE KEY-----[^-]*+(?:-----END [A-Z0-9 ]{1,64}-----)?",
    r"(?<=:)(?<=://[^\s/:@]{1,64}:)[^\s/@:\"'<>]{3,128}+(?=@)",
    rf"(?<=[:=][ ]{{0,2}}[\"']{{0,1}})(?<={_NAMED}{_GIVEN})[^\s\"'<>,;]{{8,}}+",
    rf"(?<![\p{{L}}\p{{N}}+/_.\-]){_RUN}{{20,}}+={{0,2}}(?!\p{{L}})",
])
#: Characters of the text before and after a candidate that its neighbouring words are sought in.
BEFORE, AFTER = 48, 24
_SECRET_WORDS = r"(?i)(?:token|secret|passw|pwd|api.?key|access.?key|auth|credential|private|bearer)[^\n]{0,12}$"
_HASH_WORDS = r"(?i)(?:sha-?\d*|md5|commit|checksum|uuid|digest|etag|hash|revision|version|build)[^\n]{0,8}$"
_PATH_BEFORE = r"(?:https?:|[A-Za-z0-9_]/|~/|\./)\S*$"
_URL_BEFORE = r"://[^\s/:@]*:$"
#: Words of a dictionary that are taken, the first ones of the file that have so many letters.
WORDS, LEAST_LETTERS = 4000, 4
#: Of the letter pairs inside dictionary words, the most frequent that make up this share are common.
COMMON = 0.8
#: Findings of a text whose lengths are summed together.
STRIDE = 512
NAMES = [
    "length", "switches", "vowel_switches", "common_pairs", "unseen_pairs", "distinct", "digits", "uppers", "marks", "hex", "covered", "slashes", "in_path", "in_url", "armour",
    "named", "hash_named", "assigned", "quoted", "run", "holder",
]


@dataclass(frozen=True)
class Lexicon:
    """Words, and patterns for what they cover of a text and for its letter pairs that are common, or unseen, within words."""

    words: tuple[str, ...]
    covering: str
    common: str
    unseen: str


def _trie(words: list[str]) -> str:
    """A pattern for the longest of the words at a place."""
    tree: dict = {}
    for w in words:
        node = tree
        for c in w:
            node = node.setdefault(c, {})
        node[""] = {}

    def text(node: dict) -> str:
        parts = [re.escape(c) + text(rest) for c, rest in sorted(node.items()) if c]
        if not parts:
            return ""
        some = parts[0] if len(parts) == 1 and "" not in node else "(?:" + "|".join(parts) + ")"
        return some + ("?" if "" in node else "")

    return text(tree)


def _pairs(pairs: set[str]) -> str:
    firsts: dict[str, list[str]] = {}
    for p in sorted(pairs):
        firsts.setdefault(p[0], []).append(p[1])
    return "|".join(f"{a}(?=[{''.join(b)}])" for a, b in firsts.items()) or "(?!)"


def lexicon(words: list[str]) -> Lexicon:
    """The lexicon of a list of lower-case words of letters a to z."""
    words = sorted({w for w in words if re.fullmatch("[a-z]+", w)})
    seen = Counter(w[i : i + 2] for w in words for i in range(len(w) - 1))
    common, left = set(), COMMON * seen.total()
    for pair, n in seen.most_common():
        if left <= 0:
            break
        common.add(pair)
        left -= n
    letters = "abcdefghijklmnopqrstuvwxyz"
    return Lexicon(tuple(words), _trie(words) or "(?!)", _pairs(common), _pairs({a + b for a in letters for b in letters} - set(seen)))


def read_words(path: str, most: int = WORDS) -> list[str]:
    """The first ``most`` words of ``LEAST_LETTERS`` letters or more of a word list, one a line, or of a tokenizer's JSON file, whose whole words stand in order of use."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith(".json"):
        vocab = json.loads(text)["model"]["vocab"]
        listed = [w[1:] for w in sorted(vocab, key=vocab.get) if w.startswith("\u0120")]
    else:
        listed = [w.strip().lower() for w in text.split("\n")]
    return list(dict.fromkeys(w for w in listed if re.fullmatch(f"[a-z]{{{LEAST_LETTERS},}}", w)))[:most]


def _share(c: Column, pattern: str, n: Column) -> Column:
    return F.regexp_count(c, F.lit(pattern)) / n


def with_features(found: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Add the columns ``NAMES`` to rows of ``candidate, before, after``.  Each is one pass over the candidate, however long."""
    c, n = F.col("candidate"), F.length("candidate").cast("double")
    low = F.lower(c)
    signs = F.array(*(F.lit(chr(k)) for k in range(33, 127)))
    values = {
        "length": F.log(n),
        "switches": _share(c, "[a-z](?=[^a-z])|[A-Z](?=[^A-Z])|[0-9](?=[^0-9])|[^a-zA-Z0-9](?=[a-zA-Z0-9])", n),
        "vowel_switches": _share(low, "[aeiou](?=[b-df-hj-np-tv-z])|[b-df-hj-np-tv-z](?=[aeiou])", n),
        "common_pairs": _share(low, lexicon.common, n),
        "unseen_pairs": _share(low, lexicon.unseen, n),
        "distinct": F.size(F.filter(signs, lambda x: F.contains(c, x))) / F.least(n, F.lit(94.0)),
        "digits": _share(c, "[0-9]", n),
        "uppers": _share(c, "[A-Z]", n),
        "marks": _share(c, r"[^A-Za-z0-9+/_.\-]", n),
        "hex": c.rlike("^[0-9a-f]++$|^[0-9A-F]++$").cast("double"),
        "covered": 1 - F.length(F.regexp_replace(low, lexicon.covering, "")) / n,
        "slashes": _share(c, r"[/.]", n),
        "in_path": F.col("before").rlike(_PATH_BEFORE).cast("double"),
        "in_url": F.col("before").rlike(_URL_BEFORE).cast("double"),
        "armour": F.startswith(c, F.lit("-----BEGIN")).cast("double"),
        "named": F.col("before").rlike(_SECRET_WORDS).cast("double"),
        "hash_named": F.col("before").rlike(_HASH_WORDS).cast("double"),
        "assigned": F.col("before").rlike(r"[:=]\s*[\"']?$").cast("double"),
        "quoted": (F.col("before").rlike(r"[\"']$") & F.col("after").rlike(r"^[\"']")).cast("double"),
        "run": c.rlike(r"(.)\1{3}").cast("double"),
        "holder": low.rlike("example|sample|dummy|placeholder|your|change|insert|xxxx|0000|1234").cast("double"),
    }
    return found.select("*", *(v.alias(k) for k, v in values.items()))


def _named(value: Column, use) -> Column:
    """``use(value)`` with the value made once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _running(sizes: Column) -> Column:
    """The sum of all sizes before each: strides are summed first, then each place from the start of its own."""
    total = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda s, x: s + x)

    def within(sizes: Column) -> Column:
        sums = F.transform(F.sequence(F.lit(0), ((F.greatest(F.size(sizes), F.lit(1)) - 1) / STRIDE).cast("int")), lambda b: total(F.slice(sizes, b * STRIDE + 1, STRIDE)))
        bases = _named(sums, lambda s: F.transform(s, lambda _, b: total(F.slice(s, 1, b))))
        return _named(bases, lambda base: F.transform(sizes, lambda _, i: F.get(base, (i / STRIDE).cast("int")) + total(F.slice(sizes, (i / STRIDE).cast("int") * STRIDE + 1, i % STRIDE))))

    return _named(sizes, within)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, finding_no`` (from 0), ``start`` (code point, from 0), ``candidate, before, after`` of every match in the whole texts."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).withColumn("found", F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0))).where(F.size("found") > 0)
    both = F.struct(F.col("found").alias("found"), F.split("text", CANDIDATE, -1).alias("parts"))
    sized = lambda q: F.struct(q["found"].alias("found"), q["parts"].alias("parts"), _running(F.transform(q["found"], lambda c, i: (F.length(c) + F.length(F.get(q["parts"], i))).cast("bigint"))).alias("before"))
    place = lambda q: lambda c, i: F.struct(
        i.alias("finding_no"), (F.get(q["before"], i) + F.length(F.get(q["parts"], i))).cast("int").alias("start"), c.alias("candidate"),
        F.right(F.get(q["parts"], i), F.lit(BEFORE)).alias("before"), F.left(F.get(q["parts"], i + 1), F.lit(AFTER)).alias("after"),
    )
    return rows.select("doc_id", F.inline(_named(_named(both, sized), lambda q: F.transform(q["found"], place(q)))))


def train(findings: DataFrame, lexicon: Lexicon, trees: int = 32, depth: int = 8, seed: int = 7) -> PipelineModel:
    """A random forest over the features of labelled findings (``candidate, before, after, label``), reviewed ones or made up; rows with a null field are left out."""
    rows = with_features(findings.dropna(subset=["candidate", "before", "after", "label"]).where("candidate <> ''"), lexicon)
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=NAMES, outputCol="features"), forest]).fit(rows)


def scan(docs: DataFrame, model: PipelineModel, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row for each candidate: ``doc_id, finding_no, start, length, secret_sha256, score, is_secret``.

    Candidates are found, described and scored where the text is read: no shuffle, and the
    forest and the lexicon are the only things sent to the tasks, of sizes that do not grow with the input.  The
    secrets themselves are given as digests only.

    Null and empty texts have no candidates; null ids and repeated rows pass through; other columns are not read.
    """
    scored = model.transform(with_features(candidates(docs, id_col, text_col), lexicon))
    score = vector_to_array("probability")[1]
    return scored.select("doc_id", "finding_no", "start", F.length("candidate").alias("length"), F.sha2(F.col("candidate").cast("binary"), 256).alias("secret_sha256"), score.alias("score"), (score >= threshold).alias("is_secret"))
