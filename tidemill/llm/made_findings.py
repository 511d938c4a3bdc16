"""Made-up labelled findings, for training where no reviewed ones are given.  Nothing else here is made up: ``secrets.train`` takes any table of findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lines of the shapes below that are made; a fixed number, whatever is scanned.
ROWS = 9000
NAMED = ['token = "', 'secret: ', 'api_key="', "PASSWORD=", "access_key = '", 'TOKEN = "', '"password": "', "auth_token: ", "pwd=", "client_secret = "]
PROSE = ["and of the ", "ist der ", "to be in ", "que la ", "for those, ", "line\n", ""]
HASHED = ["commit ", "sha256:", "md5 = ", "checksum: ", "uuid: ", "revision ", 'digest="', "etag: "]
ENDS = ['" of it', "\n", "' in", " and", '"', "!! THE", ""]


def labelled_findings(spark: SparkSession, words: list[str], n: int = ROWS, seed: int = 0) -> DataFrame:
    """``candidate, before, after, label``: keys of the common shapes by words for secrets (1), and what scanners mistake for them (0).

    False ones are runs of real ``words`` and of made-up syllables, digests, UUIDs, paths, numbers, rulers and placeholders.  All come from hashes of the row number.
    """
    h = lambda k, size=256: F.sha2(F.concat_ws(":", F.lit(f"{seed}-{k}"), F.col("id").cast("string")), size)
    dice = lambda k, m: F.pmod(F.xxhash64("id", F.lit(f"{seed}{k}")), F.lit(m)).cast("int")
    b64 = lambda k, size=256: F.base64(F.unhex(h(k, size)))
    alnum = lambda k: F.regexp_replace(F.base64(F.unhex(h(k, 512))), "[+/=]", "")
    pick = lambda k, xs: F.element_at(F.array(*map(F.lit, xs)), dice(k, len(xs)) + 1)
    heap, syllables = F.array(*map(F.lit, words[:600])), F.array(*(F.lit(c + v + e) for c in "bdfgklmnprstvz" for v in "aeiou" for e in ("", "n", "r")))
    roll = lambda k, i, m: F.pmod(F.xxhash64("id", F.lit(f"{seed}{k}"), i), F.lit(m)).cast("int") + 1
    some = lambda k, m, pool, size, gap="": F.array_join(F.transform(F.sequence(F.lit(1), m), lambda i: F.element_at(pool, roll(k, i, size))), gap)
    real = lambda k, least, most, gap="": some(k, F.lit(least) + dice(f"n{k}", most - least + 1), heap, min(600, len(words)), gap)
    said = lambda k, least, most: some(k, F.lit(least) + dice(f"n{k}", most - least + 1), syllables, 210)
    marks = F.array(*map(F.lit, "!@#$%^&*_-+=?~"))
    uuid = F.concat_ws("-", *(F.substring(h(40), s, m) for s, m in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    strong = F.concat(F.initcap(F.substring(alnum(50), 1, 4)), F.element_at(marks, dice("m", 14) + 1), F.substring(alnum(51), 1, 3), F.element_at(marks, dice("o", 14) + 1), F.substring(alnum(52), 1, 5))
    pem = F.concat(F.lit("-----BEGIN "), pick(60, ["RSA ", "EC ", "OPENSSH ", ""]), F.lit("PRIVATE KEY-----\n"), b64(61, 512), b64(62, 512), F.lit("\n-----END PRIVATE KEY-----"))
    kinds = [
        (F.substring(h(1), 1, 40), pick(1, NAMED), 1), (F.substring(h(2), 1, 32), pick(2, NAMED), 1), (h(3), pick(3, NAMED), 1), (F.upper(F.substring(h(4), 1, 40)), pick(4, NAMED), 1),
        (b64(5), pick(5, NAMED), 1), (F.concat(F.lit("AKIA"), F.upper(F.substring(alnum(6), 1, 16))), pick(6, NAMED + PROSE), 1), (F.concat(F.lit("ghp_"), F.substring(alnum(7), 1, 36)), pick(7, NAMED + PROSE), 1),
        (F.concat(F.lit("sk-"), F.substring(alnum(8), 1, 48)), pick(8, NAMED + PROSE), 1), (F.concat_ws(".", F.concat(F.lit("eyJ"), F.substring(alnum(9), 1, 30)), F.substring(alnum(10), 1, 60), F.substring(alnum(11), 1, 40)), pick(9, NAMED + PROSE), 1),
        (F.substring(alnum(12), 1, 12), pick(12, NAMED), 1), (F.substring(h(13), 1, 40), pick(13, PROSE), 1), (F.substring(alnum(14), 1, 40), pick(14, PROSE), 1),
        (strong, pick(15, NAMED), 1), (strong, pick(16, ["postgres://admin:", "https://user:", "amqp://svc:"]), 1), (pem, pick(17, PROSE), 1),
        (real(20, 4, 7), pick(20, PROSE), 0), (F.upper(real(21, 4, 7)), pick(21, PROSE), 0), (said(22, 8, 14), pick(22, PROSE), 0), (real(23, 4, 7, "-"), pick(23, [*PROSE, "see https://a.org/"]), 0), (said(24, 8, 14), pick(24, PROSE + NAMED), 0),
        (F.substring(h(26), 1, 40), pick(26, HASHED), 0), (F.substring(h(27), 1, 32), pick(27, HASHED), 0), (h(28), pick(28, HASHED), 0), (uuid, pick(29, HASHED + PROSE), 0), (real(25, 2, 3, "_"), pick(25, NAMED), 0),
        (F.concat(F.lit("/usr/"), real(30, 1, 2), F.lit("/"), real(31, 1, 3), F.lit("/"), said(32, 2, 4), F.lit(".html")), pick(30, PROSE), 0), (F.substring(F.conv(F.substring(h(33), 1, 15), 16, 10), 1, 18), pick(33, PROSE + NAMED[:4]), 0),
        (F.repeat(pick(34, ["=", "-", "_", ".", "x", "0"]), 30), pick(35, PROSE + NAMED[:4]), 0), (F.concat(F.lit("your_"), real(36, 1, 2), pick(36, ["_token_here", "_xxxxxxxx", "_example_key", "_changeme12345"])), pick(37, NAMED), 0),
        (real(38, 1, 1), pick(38, ["https://user:", "ftp://guest:"]), 0),
    ]
    kind = F.col("id") % len(kinds)
    made = reduce(lambda so_far, k: so_far.when(kind == k, F.struct(kinds[k][0].alias("candidate"), kinds[k][1].alias("before"), F.lit(kinds[k][2]).cast("double").alias("label"))), range(len(kinds)), F)
    return spark.range(0, n, 1, 1).select(made.alias("m"), pick("after", ENDS).alias("after")).select("m.candidate", "m.before", "after", "m.label")
