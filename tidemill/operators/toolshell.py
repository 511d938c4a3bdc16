"""What stands around a model's tool calls: canonical calls, strict replies, character budgets of sources and of history, merged searches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import retrieval as R

LONGEST_SEARCH, SEARCH_HITS, LEAST_EVIDENCE = 500, 6, 2.0


def canonical_arguments(arguments: Column) -> Column:
    """A JSON object with the keys of all its objects in order, so that equal calls have equal texts; null for anything else, an object that names a key twice included.

    The text is parsed to a variant, which keeps an object's fields in order of their names whatever order they are written in, and tells ``1`` from ``"1"``.
    """
    value = F.try_parse_json(arguments)
    return F.when(F.schema_of_variant(value).startswith("OBJECT"), F.to_json(value))


def first_calls(calls: DataFrame, keys: list[str], order: str, name: str, arguments: str) -> DataFrame:
    """Calls with ``duplicate``: whether one of the same name and canonical arguments came before it in its dialog.  Kinds count too: ``1`` is not ``1.0``."""
    again = F.row_number().over(Window.partitionBy(*keys, name, "_canonical", "_kinds").orderBy(order)) > 1
    kinds = F.schema_of_variant(F.try_parse_json(arguments))
    told = calls.withColumn("_canonical", canonical_arguments(F.col(arguments))).withColumn("_kinds", kinds)
    return told.withColumn("duplicate", again & F.col("_canonical").isNotNull()).drop("_canonical", "_kinds")


def strict_choice(reply: Column, field: str, allowed: Column, others: list[str] | None = None) -> Column:
    """The value of ``field`` in a JSON object that holds just the expected keys, if it is a text and an allowed one; else null.  A number is no text, whatever it spells."""
    made = F.try_parse_json(reply)
    keys = F.json_object_keys(reply)
    expected = F.array(*map(F.lit, sorted([field, *(others or [])])))
    inner = F.try_variant_get(made, f"$['{field}']", "variant")
    value = F.when(F.schema_of_variant(inner) == "STRING", F.try_variant_get(made, f"$['{field}']", "string"))
    return F.when((F.array_sort(keys) == expected) & F.array_contains(allowed, value), value)


def budgeted_sources(chunks: DataFrame, keys: list[str], order: str, text: str, cost: Column, most: int, offset: int = 0, least: int = 100) -> DataFrame:
    """The sources that a reply may read, in order, while their texts and ``cost`` fit in ``most`` characters: ``excerpt, truncated, next_offset``.

    The first text starts at ``offset``.  The first text that does not fit is cut at a word and ends the list; nothing is added when
    under ``least`` characters are left.
    """
    place = Window.partitionBy(*keys).orderBy(order)
    rows = chunks.withColumn("_start", F.when(F.row_number().over(place) == 1, offset).otherwise(0))
    rows = rows.withColumn("_text", F.expr("substring({0}, _start + 1, length({0}))".format(text))).withColumn("_cost", cost)
    used = F.coalesce(F.sum(F.length("_text") + F.col("_cost")).over(place.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_left", F.lit(most) - used - F.col("_cost") - least)
    rows = rows.withColumn("_over", (F.length("_text") > F.col("_left")).cast("int"))
    before = F.coalesce(F.sum("_over").over(place.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_before", before).where((F.col("_before") == 0) & (F.col("_left") >= least))
    cut = F.substring(F.col("_text"), F.lit(1), F.col("_left").cast("int"))
    excerpt = F.when(F.col("_over") == 0, F.col("_text")).otherwise(F.regexp_replace(cut, r"(?s) [^ ]*$", ""))
    rows = rows.withColumn("excerpt", excerpt).withColumn("truncated", F.col("_over") == 1)
    rows = rows.withColumn("next_offset", F.when(F.col("truncated"), F.col("_start") + F.length("excerpt")))
    return rows.drop("_start", "_text", "_cost", "_left", "_over", "_before")


def kept_places(roles: list[str], calls: list[bool], sizes: list[int], most: int, least: int = 4) -> list[int]:
    """Which messages of a history stay when its oldest exchanges go until it fits.

    The first message stays.  After it go, from the front, a user's message with the plain answer
    after it, or a message that is no user's; after a request that a tool call answers, the call and its result.
    """
    total, left, at, request = sum(sizes), len(roles), 1, None
    front = lambda k: k < len(roles)
    while total > most and left > least:
        first, second = (request, at) if request is not None else (at, at + 1)
        if not front(first) or not front(second):
            break
        if roles[first] == "user" and roles[second] == "assistant" and not calls[second]:
            gone, at, request = (first, second), second + 1, None
        elif roles[first] != "user":
            gone, at = (first,), first + 1
        elif calls[second] and front(second + 1):
            gone, at, request = (second, second + 1), second + 2, first
        else:
            break
        total -= sum(sizes[k] for k in gone)
        left -= len(gone)
    return [0, *([] if request is None else [request]), *range(at, len(roles))] if roles else []


def compacted(messages: DataFrame, key: str, order: str, role: str, has_calls: Column, size: Column, most: int, least: int = 4) -> DataFrame:
    """Each dialog's messages without its oldest exchanges, as ``kept_places`` tells; only roles and sizes are gathered by dialog, texts are joined back."""
    rows = messages.select(key, order, F.col(role).alias("_role"), has_calls.alias("_calls"), size.cast("bigint").alias("_size"))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        return pdf.iloc[kept_places(pdf["_role"].tolist(), pdf["_calls"].tolist(), pdf["_size"].tolist(), most, least)][[key, order]]

    return messages.join(rows.groupBy(key).applyInPandas(fold, rows.select(key, order).schema), [key, order], "left_semi")


def merged_search(question: Column, search: Column) -> Column:
    """What a tool searches for: its own words, then the user's question unless that is the same; the question alone where both are over 500 characters.

    Null, which refuses the call, for a search of under two or over 500 characters.
    """
    own, asked = _stripped(search), _stripped(F.coalesce(question, F.lit("")))
    merged = F.concat_ws(" ", own, asked)
    both = F.when(F.length(merged) <= LONGEST_SEARCH, merged).otherwise(asked)
    return F.when(F.length(own).between(2, LONGEST_SEARCH), F.when((asked == "") | (F.lower(asked) == F.lower(own)), own).otherwise(both))


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def agent_search(calls: DataFrame, chunks: DataFrame, most: int = SEARCH_HITS) -> DataFrame:
    """``qid, document, ord, score, rank``: the ``most`` hits of each call's merged query, put in order by their lexical score against the question; refused calls have none.

    ``calls`` has ``qid, question, search``.
    """
    queries = calls.select("qid", merged_search(F.col("question"), F.col("search")).alias("query")).where("query is not null")
    found = R.bm25_top(queries, chunks, most).select("qid", "document", "ord")
    asked = calls.select("qid", F.when(F.trim("question") != "", F.col("question")).otherwise(F.col("search")).alias("query"))
    return R.top(R.lexical_of(found, asked, chunks), most)


def evidence_covers(hits: DataFrame, queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """``qid, covers``: whether any source of a question scores two or more against it."""
    scores = R.lexical_of(hits, queries, chunks).groupBy("qid").agg(F.max("score").alias("best"))
    return queries.select("qid").join(scores, "qid", "left").select("qid", F.coalesce(F.col("best") >= LEAST_EVIDENCE, F.lit(False)).alias("covers"))
