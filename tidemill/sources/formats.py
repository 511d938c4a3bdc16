"""Sources and sinks: strict Parquet, JSON catalogs, line files, NDJSON event logs, chat snapshots, completion streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TOOL_STATUSES = ["preparing", "running", "completed", "error", "awaiting_user"]
EVENT = "type string, text string, tool_call struct<id:string,name:string,reason:string,arguments:variant,result:variant>, status string, response variant, detail string, _bad string"
SNAPSHOT = "version int, activeChatId string, chats array<struct<id:string,title:string,updatedAt:string,status:string,closedAt:string,feedbackDismissed:boolean,messages:array<struct<id:string,role:string,content:string,createdAt:string,kind:string>>>>, _bad string"


class SchemaMismatch(ValueError):
    """A file's columns or types are not those that were declared."""


def strict_parquet(spark: SparkSession, path: str, schema: StructType, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that keep all ``rules`` and rows that break one, with ``broken`` naming which; another schema is refused."""
    df = spark.read.parquet(path)
    if [(f.name, f.dataType) for f in df.schema] != [(f.name, f.dataType) for f in schema]:
        raise SchemaMismatch(f"{df.schema.simpleString()} is not {schema.simpleString()}")
    broken = F.filter(F.array(*(F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items())), lambda x: x.isNotNull())
    marked = df.withColumn("broken", broken)
    return marked.where(F.size("broken") == 0).drop("broken"), marked.where(F.size("broken") > 0)


def zstd_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.option("compression", "zstd").mode(mode).parquet(path)


def json_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Topics of a catalog file, one JSON document with an array."""
    topic = "id string, title string, parent_title string, description string, keys array<string>, document string, section string, path string"
    return spark.read.schema(f"topics array<struct<{', '.join(f'{a}:{b}' for a, b in (x.split(' ', 1) for x in topic.split(', ')))}>>").json(path, multiLine=True).select(F.inline("topics"))


def lexicon_lines(spark: SparkSession, path: str) -> DataFrame:
    """Words of a lexicon file: comments and words of one letter left out."""
    word = F.replace(F.lower(F.trim("value")), F.lit("ё"), F.lit("е"))
    return spark.read.text(path).select(word.alias("word")).where(~F.startswith("word", F.lit("#")) & (F.length("word") >= 2)).distinct()


def corpus_lines(spark: SparkSession, path: str) -> DataFrame:
    """Distinct non-blank lines."""
    return spark.read.text(path).select(F.trim("value").alias("query")).where("query <> ''").distinct()


def sectioned_lines(lines: DataFrame, order: str) -> DataFrame:
    """Lines under the bracketed header above them, split at the first bar: ``header, kind, text``."""
    head = F.regexp_extract("value", r"^\s*\[(.*)\]\s*$", 1)
    under = F.last(F.when(head != "", head), ignorenulls=True).over(Window.partitionBy("file").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    rows = lines.withColumn("header", under).where((head == "") & (F.trim("value") != ""))
    return rows.select("file", order, "header", F.trim(F.split_part("value", F.lit("|"), F.lit(1))).alias("kind"), F.trim(F.regexp_extract("value", r"^[^|]*\|(.*)$", 1)).alias("text"))


def parse_events(lines: DataFrame, value: str = "value") -> DataFrame:
    """NDJSON dialog events with ``valid``; blank lines are left out, whatever is malformed is kept and marked."""
    rows = lines.where(F.trim(F.regexp_replace(value, "\r$", "")) != "")
    e = rows.withColumn("e", F.from_json(value, EVENT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    e = e.withColumn("v", F.try_parse_json(F.trim(value)))
    is_text = lambda path: F.coalesce(F.schema_of_variant(F.try_variant_get("v", path, "variant")) == "STRING", F.lit(False))
    tool = F.col("e.tool_call.id").isNotNull() & F.col("e.tool_call.name").isNotNull() & F.col("e.status").isin(TOOL_STATUSES)
    valid = (
        F.when(F.col("e._bad").isNotNull() | F.col("v").isNull(), False).when(F.col("e.type") == "text", is_text("$.text")).when(F.col("e.type") == "tool", tool)
        .when(F.col("e.type") == "done", F.col("e.response").isNotNull()).when(F.col("e.type") == "error", is_text("$.detail")).otherwise(False)
    )
    return e.select(*[c for c in rows.columns if c != value], F.coalesce(valid, F.lit(False)).alias("valid"), "e.type", "e.text", "e.status", "e.detail", F.col("e.tool_call.id").alias("call_id"))


def stream_outcomes(events: DataFrame) -> DataFrame:
    """What a client makes of each stream of ``id, seq`` events: only ``done`` confirms, and what follows it is ignored.

    ``failed`` if an invalid or error event comes before ``done``, or none comes; ``text`` is the last snapshot before the end.
    """
    ends = events.groupBy("id").agg(F.min(F.when(F.col("valid") & (F.col("type") == "done"), F.col("seq"))).alias("done"), F.min(F.when(~F.col("valid") | (F.col("type") == "error"), F.col("seq"))).alias("bad"))
    seen = events.join(ends, "id").where((F.col("done").isNull() | (F.col("seq") <= F.col("done"))) & (F.col("bad").isNull() | (F.col("seq") < F.col("bad"))))
    texts = seen.where("valid and type = 'text'").groupBy("id").agg(F.max_by("text", "seq").alias("text"))
    failed = F.col("done").isNull() | (F.coalesce("bad", F.col("done") + 1) < F.col("done"))
    return ends.join(texts, "id", "left").select("id", failed.alias("failed"), "text")


def completion_text(lines: DataFrame) -> DataFrame:
    """Text of server-sent completion streams (``id, seq, value``): deltas in order; whole only if the terminator came."""
    data = lines.where(F.startswith("value", F.lit("data:"))).select("id", "seq", F.trim(F.substring("value", 6, 1 << 30)).alias("data"))
    delta = F.get_json_object("data", "$.choices[0].delta.content")
    parts = F.sort_array(F.collect_list(F.when(delta.isNotNull(), F.struct("seq", delta.alias("t")))))
    return data.groupBy("id").agg(F.array_join(F.transform(parts, lambda x: x["t"]), "").alias("text"), F.max(F.col("data") == "[DONE]").alias("whole"))


def read_snapshots(rows: DataFrame, value: str = "value") -> DataFrame:
    """Chats of client snapshots, version 1 brought to 2; one invalid chat refuses its whole snapshot, which then has no rows."""
    s = rows.withColumn("s", F.from_json(value, SNAPSHOT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    status = lambda c: F.when(F.col("s.version") == 1, F.coalesce(c["status"], F.lit("open"))).otherwise(c["status"])
    dismissed = lambda c: F.when(F.col("s.version") == 1, F.coalesce(c["feedbackDismissed"], F.lit(False))).otherwise(c["feedbackDismissed"])
    stamp = lambda x: F.try_to_timestamp(x).isNotNull()
    ok = lambda c: F.coalesce(
        (F.length(c["id"]) > 0) & (F.length(c["title"]) > 0) & stamp(c["updatedAt"]) & c["messages"].isNotNull() & dismissed(c).isNotNull()
        & (F.size(F.array_distinct(F.transform(c["messages"], lambda m: m["id"]))) == F.size(c["messages"])) & F.when(status(c) == "open", c["closedAt"].isNull()).when(status(c) == "closed", stamp(c["closedAt"])).otherwise(False),
        F.lit(False),
    )
    ids = F.transform("s.chats", lambda c: c["id"])
    whole = F.col("s._bad").isNull() & F.col("s.version").isin(1, 2) & (F.size("s.chats") > 0) & F.forall("s.chats", ok) & (F.size(F.array_distinct(ids)) == F.size(ids)) & F.array_contains(ids, F.col("s.activeChatId"))
    chats = F.transform("s.chats", lambda c: F.struct(c["id"].alias("chat_id"), c["title"].alias("title"), status(c).alias("status"), c["updatedAt"].alias("updated_at"), F.size(c["messages"]).alias("n_messages")))
    return s.where(F.coalesce(whole, F.lit(False))).select(*[c for c in rows.columns if c != value], F.inline(chats))


def event_lines(events: DataFrame) -> DataFrame:
    """``value``: each event as one line of JSON, absent fields left out."""
    return events.select(F.to_json(F.struct(*events.columns)).alias("value"))


def write_ndjson(events: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Events as NDJSON files; for a stream, ``event_lines`` goes to ``writeStream.format("text")`` alike."""
    event_lines(events).write.mode(mode).text(path)
