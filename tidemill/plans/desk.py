"""Queries of the store, the tool shell, clarification, links and keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import markdown
from ..functions import text as T
from ..operators import answers as A
from ..operators import cards, clarify, ingest, store, toolshell
from ..operators import retrieval as R
from ..registry import query
from ..sources import formats
from ..sources import tables as S
from .retrieval import _LEXICAL

_DIALOGS = """w AS (SELECT user_id AS id, event_id AS revision, event_type AS status, event_type IN ('purchase', 'error') AS closed, event_type || ' seen' AS summary, ts AS updated_at FROM events),
d AS (SELECT id, max(revision) AS revision, arg_max(status, revision) AS status, arg_max(closed, revision) AS closed, arg_max(summary, revision) AS summary FROM w GROUP BY id)"""


def _dialogs(spark, sf_dir):
    e, kind = S.table(spark, sf_dir, "events"), F.col("event_type")
    rows = e.select(F.col("user_id").alias("id"), F.col("event_id").alias("revision"), kind.alias("status"), kind.isin("purchase", "error").alias("closed"), F.concat(kind, F.lit(" seen")).alias("summary"))
    return ingest.latest(rows, ["id"], "revision")


@query("opened_dialogs", f"WITH {_DIALOGS} SELECT c_custkey AS id, CAST(0 AS BIGINT) AS revision, 'open' AS status, false AS closed FROM customer WHERE c_custkey NOT IN (SELECT id FROM d)")
def opened_dialogs(spark, sf_dir):
    """First versions of customers' dialogs that the store does not have."""
    ids = S.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    return store.opened(ids, _dialogs(spark, sf_dir), F.lit(None).cast("timestamp")).select("id", "revision", "status", "closed")


@query("closing_save", f"WITH {_DIALOGS} SELECT id, revision + 1 AS revision, status, closed, CASE WHEN NOT closed THEN summary END AS summary FROM d")
def closing_save(spark, sf_dir):
    """The next version of every dialog, without what was derived if it closes."""
    return store.saved(_dialogs(spark, sf_dir).withColumnRenamed("revision", "expected"), ["summary"]).select("id", "revision", "status", "closed", "summary")


@query("derived_only", f"WITH {_DIALOGS}, n AS (SELECT id, revision - id % 2 AS revision, 'new ' || id AS summary FROM d) SELECT d.id, d.revision, d.status, d.closed, CASE WHEN d.closed AND n.id IS NOT NULL THEN n.summary ELSE d.summary END AS summary FROM d LEFT JOIN n ON n.id = d.id AND n.revision = d.revision")
def derived_only(spark, sf_dir):
    """Insights written back: half of them name an old revision, and open dialogs take none."""
    now = _dialogs(spark, sf_dir)
    deltas = now.select("id", (F.col("revision") - F.col("id") % 2).alias("revision"), F.concat(F.lit("new "), F.col("id").cast("string")).alias("summary"))
    return store.with_derived(now, deltas, ["summary"])


@query("retry_times", "SELECT event_id, strftime(ts + INTERVAL 5 MINUTE, '%Y-%m-%d %H:%M:%S') AS retry_at FROM events WHERE event_type = 'error'")
def retry_times(spark, sf_dir):
    failed = S.table(spark, sf_dir, "events").where("event_type = 'error'")
    return failed.select("event_id", F.date_format(store.retry_at(F.col("ts").cast("timestamp")), "yyyy-MM-dd HH:mm:ss").alias("retry_at"))


@query(
    "rating_rights",
    f"WITH {S.MESSAGES}, m AS (SELECT conv_id, role = 'assistant' AND turn % 4 <> 1 AND NOT turn % 6 = 3 AND trim(text) <> '' AS answer, conv_id % 2 = 0 AS closed, conv_id % 5 = 0 AS handed, conv_id % 3 = 0 AS rated FROM messages) "
    "SELECT conv_id, NOT bool_or(rated) AND (bool_or(closed) OR bool_or(handed)) AND bool_or(answer) AS can_rate, NOT bool_or(closed) AND NOT bool_or(handed) AS can_contact FROM m GROUP BY conv_id",
)
def rating_rights(spark, sf_dir):
    i, turn = F.col("conv_id"), F.col("turn")
    rows = S.messages(spark, sf_dir).select("conv_id", "role", "text", F.when(turn % 4 != 1, "answer").otherwise("notice").alias("kind"), (turn % 6 == 3).alias("is_card"))
    return store.can_rate(rows, ["conv_id"], i % 2 == 0, i % 5 == 0, i % 3 == 0)


@query("topic_by_id", f"WITH {S.CATALOG} SELECT event_id, k, title AS topic_title FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) LEFT JOIN catalog ON id = k")
def topic_by_id(spark, sf_dir):
    rows = S.table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    return A.by_topic_id(rows, S.catalog(spark, sf_dir).select("id", "title"), "k")


_FIRST = "split_part({}, ' ', 1)"


@query(
    "topic_by_title",
    f"WITH {S.MESSAGES}, {S.CATALOG}, t AS (SELECT replace(lower({_FIRST.format('title')}), 'ё', 'е') AS k, arg_max(id, id) AS topic_id FROM catalog GROUP BY k), m AS (SELECT conv_id, turn, {_FIRST.format('text')} AS subtopic FROM messages WHERE role = 'user') "
    "SELECT conv_id, turn, subtopic, topic_id FROM m JOIN t ON t.k = replace(lower(trim(subtopic)), 'ё', 'е')",
)
def topic_by_title(spark, sf_dir):
    """Messages by the topic that their first word names; of topics with one name the last counts."""
    first = lambda c: F.split_part(c, F.lit(" "), F.lit(1))
    topics = S.catalog(spark, sf_dir).select("id", first(F.col("title")).alias("title"))
    rows = S.messages(spark, sf_dir).where("role = 'user'").select("conv_id", "turn", first(F.col("text")).alias("subtopic"))
    return A.by_title(rows, topics, "subtopic", "id")


@query("source_coverage", f"WITH {S.CHUNKS}, a AS (SELECT source AS section, count(*) AS seeds FROM documents WHERE doc_id % 3 = 0 GROUP BY 1), b AS (SELECT section, count(*) AS generated FROM chunks WHERE ord > 2 GROUP BY 1) SELECT coalesce(a.section, b.section) AS section, coalesce(seeds, 0) AS seeds, coalesce(generated, 0) AS generated FROM a FULL JOIN b ON a.section = b.section")
def source_coverage(spark, sf_dir):
    """Seeds, here every third document, and generated queries, here later lines, by source."""
    seeds = S.table(spark, sf_dir, "documents").where("doc_id % 3 = 0").select(F.col("source").alias("section"))
    return ingest.coverage(seeds, S.chunks(spark, sf_dir).where("ord > 2").select("section"), "section")


@query("colliding_paths", "WITH i AS (SELECT DISTINCT 'data/' || source AS path FROM documents), o AS (SELECT DISTINCT 'data/src' || (page_id % 40) AS path FROM pages) SELECT path FROM i INTERSECT SELECT path FROM o")
def colliding_paths(spark, sf_dir):
    inputs = S.table(spark, sf_dir, "documents").select(F.concat(F.lit("data//./"), "source", F.lit("/")).alias("path"))
    outputs = S.table(spark, sf_dir, "pages").select(F.concat(F.lit("data/src"), (F.col("page_id") % 40).cast("string")).alias("path"))
    return ingest.colliding_paths(inputs, outputs)


_OFF_SOURCE = "source-0"
_CASES = " ".join(
    f"WHEN {k} THEN " + (f"CASE WHEN source = '{_OFF_SOURCE}' THEN '{clarify.OFF_PORTAL[k]}' ELSE '{form}' END" if k in clarify.OFF_PORTAL else f"CASE WHEN regexp_matches(intent, '^(?:{'|'.join(clarify.LOOKS)})') THEN '{clarify.LOOK_FORM[1]}' ELSE '{form}' END" if k == clarify.LOOK_FORM[0] else f"'{form}'")
    for k, form in enumerate(clarify.ACTION_FORMS)
)
_ASKS = " ".join(f"WHEN {k} THEN '{form}'" for k, form in enumerate(clarify.QUESTION_FORMS))


@query(
    "intent_forms",
    f"WITH {S.CATALOG}, i AS (SELECT 'source-' || parent AS source, CASE WHEN id % 2 = 0 THEN 'A' ELSE 'Q' END AS kind, CASE WHEN id % 3 = 0 THEN 'найти ' || title ELSE title END AS intent FROM catalog), "
    "v AS (SELECT *, unnest(range(CASE WHEN kind = 'A' THEN 16 ELSE 4 END)) AS variant FROM i) "
    f"SELECT source, kind, intent, CAST(variant AS INT) AS variant, CASE WHEN kind = 'A' THEN replace(CASE variant {_CASES} END, '%s', intent) ELSE replace(CASE variant {_ASKS} END, '%s', upper(substring(intent, 1, 1)) || substring(intent, 2) || '?') END AS text FROM v",
)
def intent_forms(spark, sf_dir):
    """Catalog titles as actions and questions, in all their forms."""
    c = S.catalog(spark, sf_dir)
    intents = c.select(F.concat(F.lit("source-"), F.col("parent").cast("string")).alias("source"), F.when(F.col("id") % 2 == 0, "A").otherwise("Q").alias("kind"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("найти "), "title")).otherwise(F.col("title")).alias("intent"))
    return clarify.intent_forms(intents, [_OFF_SOURCE])


@query("section_labels", f"WITH {S.CATALOG} SELECT id, CASE WHEN id % 3 = 0 THEN title ELSE (parent + 1) || '.' || id || ' ' || title END AS label, CASE WHEN id % 3 = 0 THEN '' ELSE (parent + 1) || '.' || id END AS family FROM catalog")
def section_labels(spark, sf_dir):
    number = F.when(F.col("id") % 3 != 0, F.concat_ws(".", F.col("parent") + 1, "id"))
    rows = S.catalog(spark, sf_dir).select("id", clarify.section_label(number, F.col("title")).alias("label"))
    return rows.select("id", "label", clarify.section_family(F.col("label")).alias("family"))


@query("source_links", "SELECT doc_id, '/staticfiles/' || replace(url_encode(source || ' ' || lang || '/' || left(text, 30) || '.pdf'), '%2F', '/') || CASE WHEN doc_id % 2 = 0 THEN '#page=' || doc_id ELSE '' END AS link FROM documents WHERE text IS NOT NULL")
def source_links(spark, sf_dir):
    name = F.concat(F.col("source"), F.lit(" "), F.col("lang"), F.lit("/"), F.left("text", F.lit(30)), F.lit(".pdf"))
    page = F.when(F.col("doc_id") % 2 == 0, F.col("doc_id"))
    return S.table(spark, sf_dir, "documents").where("text is not null").select("doc_id", clarify.source_link(name, page).alias("link"))


@query("event_lines", "SELECT to_json({'type': event_type, 'id': event_id, 'text': 'user ' || user_id}) AS value FROM events")
def event_lines(spark, sf_dir):
    e = S.table(spark, sf_dir, "events").select(F.col("event_type").alias("type"), F.col("event_id").alias("id"), F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("text"))
    return formats.event_lines(e)


@query(
    "repeated_calls",
    "WITH c AS (SELECT event_id, user_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 AS k FROM events) SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type, k, event_id % 5 = 0 ORDER BY event_id) > 1 AS duplicate FROM c",
)
def repeated_calls(spark, sf_dir):
    """Calls that repeat an earlier one of their dialog, whatever the order of their arguments at any depth; every fifth writes its number as a text, which is another call."""
    k = (F.get_json_object("props", "$.k").cast("bigint") % 10).cast("string")
    k = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit('"'), k, F.lit('"'))).otherwise(k)
    written = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"a": ["x", {"q": 1, "p": null}], "k": {"n": '), k, F.lit(', "m": true}}'))).otherwise(F.concat(F.lit('{"k":{"m":true,"n":'), k, F.lit('},"a":["x",{"p":null,"q":1}]}')))
    calls = S.table(spark, sf_dir, "events").select("event_id", "user_id", F.col("event_type").alias("name"), written.alias("arguments"))
    return toolshell.first_calls(calls, ["user_id"], "event_id", "name", "arguments").select("event_id", "duplicate")


@query(
    "strict_choices",
    "SELECT event_id, CASE WHEN event_id % 3 <> 0 AND event_id % 7 <> 0 AND CAST(json_extract_string(props, '$.k') AS BIGINT) % 2 = 0 THEN json_extract_string(props, '$.k') END AS choice FROM events",
)
def strict_choices(spark, sf_dir):
    """Replies that hold just a topic and a reason, with the id of an even topic as a text; every third has a key too many, and every seventh has a number for its id."""
    extra = F.when(F.col("event_id") % 3 == 0, F.lit(', "more": 1')).otherwise(F.lit(""))
    k = F.get_json_object("props", "$.k")
    topic = F.when(F.col("event_id") % 7 == 0, k).otherwise(F.concat(F.lit('"'), k, F.lit('"')))
    reply = F.concat(F.lit('{"topic": '), topic, F.lit(', "reason": "r"'), extra, F.lit("}"))
    even = F.transform(F.sequence(F.lit(0), F.lit(998), F.lit(2)), lambda x: x.cast("string"))
    return S.table(spark, sf_dir, "events").select("event_id", toolshell.strict_choice(reply, "topic", even, ["reason"]).alias("choice"))


@query(
    "source_budget",
    f"WITH {S.CHUNKS}, c AS (SELECT document, ord, length(text) AS n, text, sum(length(text) + 60) OVER (PARTITION BY document ORDER BY ord) - length(text) - 60 AS used FROM chunks), "
    "l AS (SELECT *, 2000 - used - 160 AS room FROM c), o AS (SELECT *, coalesce(sum((n > room)::INT) OVER (PARTITION BY document ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM l) "
    "SELECT document, ord, n > room AS truncated, CASE WHEN n <= room THEN text ELSE regexp_replace(substring(text, 1, CAST(room AS INT)), ' [^ ]*$', '') END AS excerpt, CASE WHEN n > room THEN length(regexp_replace(substring(text, 1, CAST(room AS INT)), ' [^ ]*$', '')) END AS next_offset FROM o WHERE before = 0 AND room >= 100",
)
def source_budget(spark, sf_dir):
    """Every document's lines as sources of a reply of 2000 characters, sixty of which each costs besides its text."""
    rows = toolshell.budgeted_sources(S.chunks(spark, sf_dir), ["document"], "ord", "text", F.lit(60), 2000)
    return rows.select("document", "ord", "truncated", "excerpt", F.col("next_offset").cast("bigint").alias("next_offset"))


@query("history_budget")
def history_budget(spark, sf_dir):
    """The turns of each conversation that a prompt of 2000 characters keeps; every third assistant turn counts as a tool call."""
    rows = S.table(spark, sf_dir, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    return toolshell.compacted(rows, "conv_id", "turn", "role", (F.col("role") == "assistant") & (F.col("turn") % 3 == 2), F.length("text"), 2000).select("conv_id", "turn", "role")


@query("agent_search")
def agent_search(spark, sf_dir):
    """Catalog titles searched for beside each topic's parent title."""
    c = S.catalog(spark, sf_dir)
    calls = c.select(F.col("id").alias("qid"), F.col("title").alias("question"), "parent").join(c.select(F.col("id").alias("parent"), F.col("title").alias("search")), "parent")
    return toolshell.agent_search(calls, S.chunks(spark, sf_dir))


@query("evidence_covers", f"WITH {_LEXICAL}, h AS (SELECT id AS qid, c.document, c.ord FROM catalog k JOIN chunks c ON c.document % 50 = k.id % 50 AND c.ord < 3) SELECT q.qid, coalesce(max(score) >= 2, false) AS covers FROM queries q LEFT JOIN h USING (qid) LEFT JOIN lexical l ON l.qid = h.qid AND l.document = h.document AND l.ord = h.ord GROUP BY q.qid")
def evidence_covers(spark, sf_dir):
    """Whether the opening lines of some documents answer each catalog title."""
    c = S.catalog(spark, sf_dir).select(F.col("id").alias("qid"), F.col("title").alias("query"))
    chunks = S.chunks(spark, sf_dir)
    hits = c.select("qid", (F.col("qid") % 50).alias("m")).join(chunks.where("ord < 3").select("document", "ord", (F.col("document") % 50).alias("m")), "m").select("qid", "document", "ord")
    return toolshell.evidence_covers(hits, c, chunks)


@query("clarification_cards")
def clarification_cards(spark, sf_dir):
    """Cards for user messages over a catalog of numbered sections; tested on hand cases."""
    q = R.by_chunk(S.corpus(spark, sf_dir).select("qid", F.col("query").alias("question")), ["qid"])
    c = S.catalog(spark, sf_dir).select(F.col("id").alias("n"), "title", F.concat(F.col("parent") + 1, F.lit("."), F.col("id"), F.lit(" "), F.initcap("title")).alias("section"))
    words = lambda rows, key, text: rows.select(key, F.explode(F.array_distinct(T.significant_stems(text))).alias("stem"))
    met = words(q, "qid", "question").join(words(c, "n", "title"), "stem").groupBy("qid", "n").agg(F.count("*").alias("score"))
    best = R.top(met, 3, ties=("n",)).join(c, "n").select("qid", F.col("rank").alias("pos"), "section")
    return cards.decisions(q, best, c)


@query("topic_keys")
def topic_keys(spark, sf_dir):
    """Keys of every topic: of its names, its most frequent stems and what goes with them."""
    c = S.catalog(spark, sf_dir)
    rows = S.messages(spark, sf_dir).where("role = 'user'").select((F.col("conv_id") % 20).alias("topic"), (F.col("conv_id") * 1000 + F.col("turn")).alias("pos"), "text")
    stems = A.frequent_stems(rows, "topic", "text").groupBy("topic").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "stem"))), lambda x: x["stem"]).alias("stems"))
    none = F.array().cast("array<string>")
    rows = c.join(stems, F.col("id") % 20 == F.col("topic"), "left")
    return rows.select("id", A.derived_keys(F.col("title"), F.concat(F.lit("topic "), F.col("parent").cast("string")), F.lit(None).cast("string"), none, F.coalesce("stems", none)).alias("keys"))


@query("topic_descriptions")
def topic_descriptions(spark, sf_dir):
    """What each document says of itself, as a topic's description is drawn from a section."""
    d = S.table(spark, sf_dir, "documents")
    told = A.description(F.coalesce("text", F.lit("")), F.col("source"), F.col("lang"), F.col("doc_id").cast("string"), F.col("source"), r"^\d+$")
    return d.select("doc_id", told.alias("description"))


@query("repaired_tables")
def repaired_tables(spark, sf_dir):
    """Documents with their tables made whole; tested on hand cases."""
    return S.table(spark, sf_dir, "documents").select("doc_id", markdown.repaired_tables("text").alias("text"))


@query("split_chunks")
def split_chunks(spark, sf_dir):
    """Documents in overlapping pieces, cut where the text allows it."""
    return ingest.split_chunks(S.table(spark, sf_dir, "documents"), ["doc_id"], "text")


@query("id_times", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS made FROM events WHERE event_id % 7 <> 0 UNION ALL SELECT event_id, NULL FROM events WHERE event_id % 7 = 0")
def id_times(spark, sf_dir):
    """When an id was made, from its first eight digits; every seventh is too short to be one."""
    seconds = F.lpad(F.lower(F.hex(F.unix_timestamp(F.col("ts").cast("timestamp")))), 8, "0")
    oid = F.concat(seconds, F.when(F.col("event_id") % 7 != 0, F.lit("a" * 16)).otherwise(F.lit("b")))
    return S.table(spark, sf_dir, "events").select("event_id", F.date_format(ingest.object_id_time(oid), "yyyy-MM-dd HH:mm:ss").alias("made"))


@query("valid_contacts", "SELECT c_custkey AS id, c_custkey % 2 = 0 AND length(trim(c_name)) BETWEEN 1 AND 300 AND c_custkey % 3 <> 0 AS valid FROM customer")
def valid_contacts(spark, sf_dir):
    i = F.col("c_custkey")
    number = F.lpad(i.cast("string"), 12, "7")
    inn = F.when(i % 2 == 0, F.when(i % 4 == 0, number).otherwise(F.right(number, F.lit(10)))).otherwise(F.right(number, F.lit(11)))
    mail = F.when(i % 3 != 0, F.concat(F.lit("u"), i.cast("string"), F.lit("@a.b.org"))).otherwise(F.lit("u@org"))
    return S.table(spark, sf_dir, "customer").select(i.alias("id"), clarify.valid_contact(inn, F.col("c_name"), mail).alias("valid"))


@query("subtopic_prefixes", f"WITH {S.MESSAGES}, m AS (SELECT conv_id, turn, role || ' / ' || text AS t FROM messages) SELECT conv_id, turn, role AS head, length(trim(substring(t, length(role) + 3))) AS n_chars FROM m JOIN messages USING (conv_id, turn)")
def subtopic_prefixes(spark, sf_dir):
    head, rest = clarify.subtopic(F.concat("role", F.lit(" / "), "text"))
    return S.messages(spark, sf_dir).select("conv_id", "turn", head.alias("head"), F.length(rest).cast("bigint").alias("n_chars"))


@query("safe_paths", "SELECT page_id, page_id % 4 = 0 AS safe FROM pages")
def safe_paths(spark, sf_dir):
    i = F.col("page_id")
    name = F.concat(F.lit("/staticfiles/a"), i.cast("string"))
    path = F.when(i % 4 == 0, F.concat(name, F.lit(".pdf#page=3"))).when(i % 4 == 1, F.concat(name, F.lit("/../b.pdf"))).when(i % 4 == 2, F.concat(name, F.lit(".pdf?x"))).otherwise(F.concat(F.lit("http://a"), name, F.lit(".pdf")))
    return S.table(spark, sf_dir, "pages").select("page_id", clarify.safe_source_path(path).alias("safe"))


@query("carried_notes", f"WITH {S.MESSAGES}, p AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, role, text FROM messages) SELECT conv_id, CAST(pos AS INT) AS pos, CASE WHEN conv_id % 2 = 0 THEN 'note ' || pos END AS note FROM p")
def carried_notes(spark, sf_dir):
    """Notes of cached messages on fresh ones of the same place, role and text; odd conversations were said anew."""
    fresh = ingest.assign_order(S.messages(spark, sf_dir), ["conv_id"], "turn", "pos").select("conv_id", "pos", "role", "text")
    cached = fresh.select("conv_id", "pos", "role", F.when(F.col("conv_id") % 2 == 0, F.col("text")).otherwise(F.concat("text", F.lit("!"))).alias("text"), F.concat(F.lit("note "), F.col("pos").cast("string")).alias("note"))
    return ingest.same_place(fresh, cached, ["conv_id"]).select("conv_id", "pos", "note")
