"""Queries over log lines, event streams and requests. Their texts are made from the fixture's rows, so that the SQL knows what must come out without parsing them."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from ..operators import chunks, logs, outline, predicates, prompt, render, turns
from ..sources import rollouts, sse, store
from ..streaming import observed, tail
from .registry import Tables, query


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]))


def _folder(t: Tables, name: str) -> str:
    return f"{observed.shared_folder(t.spark)}/turnloom/{name}-{uuid.uuid4().hex}"


def _event_lines(t: Tables) -> DataFrame:
    """Every fifth line blank, every fifth broken."""
    ok = _json(timestamp=F.lit("2026-01-01T00:00:00Z"), type=F.col("event_type"), payload=F.struct(F.col("event_id").alias("n"), F.col("user_id").alias("session")))
    return t.events.select("event_id", F.when(F.col("event_id") % 5 == 0, "  ").when(F.col("event_id") % 5 == 1, "{broken").otherwise(ok).alias("line"))


@query("SELECT event_id AS n, event_type AS type, 1767225600::BIGINT AS at FROM events WHERE event_id % 5 > 1")
def rollout_lines(t: Tables) -> DataFrame:
    e = rollouts.events(rollouts.parse_events(_event_lines(t)))
    return e.select(F.try_variant_get("payload", "$.n", "long").alias("n"), "type", F.unix_timestamp("ts").alias("at"))


@query("SELECT event_id AS n, event_type AS type FROM events WHERE event_id % 5 > 1 AND user_id = 7")
def session_log(t: Tables) -> DataFrame:
    """The log of one session, read back from a log table."""
    path = _folder(t, "log")
    e = rollouts.events(rollouts.parse_events(_event_lines(t)))
    e = e.select(F.try_variant_get("payload", "$.session", "long").alias("session"), F.try_variant_get("payload", "$.n", "long").alias("n"), "type", F.to_json("payload").alias("fields"))
    store.write_log(e, path)
    return t.spark.read.parquet(path).where("session = 7").select("n", "type")


@query("SELECT conv_id % 3 AS k, count(*) AS lines, count(DISTINCT conv_id % 3) AS folders FROM conversations GROUP BY 1")
def log_files(t: Tables) -> DataFrame:
    """Lines of all files below a folder."""
    path = _folder(t, "walk")
    rows = t.conversations.select((F.col("conv_id") % 3).alias("k"), _json(text=F.col("text")).alias("value"))
    rows.write.partitionBy("k").text(path)
    got = rollouts.read_lines(t.spark, path, "*.txt").where("bytes > 0 and modified is not null").withColumn("k", F.regexp_extract("file", r"/k=(\d+)/", 1).cast("long"))
    return got.groupBy("k").agg(F.count("*").alias("lines"), F.count_distinct(F.regexp_extract("file", r"/(k=\d+)/", 1)).alias("folders"))


def _session_lines(t: Tables) -> DataFrame:
    """A file a conversation: of three, one starts with a description, one with one that is too long, one with another event."""
    meta = _json(type=F.lit("session_meta"), payload=F.struct(F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("id"), F.lit("/w").alias("cwd"), F.lit("cli").alias("originator"), F.rpad(F.lit(""), F.when(F.col("conv_id") % 3 == 1, 70_000).otherwise(1), "x").alias("note")))
    first = t.conversations.select("conv_id").distinct().where("conv_id % 3 < 2").select(F.col("conv_id").alias("file"), F.lit(-1).cast("long").alias("line_no"), meta.alias("line"))
    rest = t.conversations.select(F.col("conv_id").alias("file"), F.col("turn").cast("long").alias("line_no"), _json(type=F.lit("response_item"), payload=F.struct("role")).alias("line"))
    return first.unionByName(rest)


@query("SELECT DISTINCT conv_id AS file, 's' || conv_id AS session_id, '/w' AS cwd, 'cli' AS originator FROM conversations WHERE conv_id % 3 = 0")
def session_descriptions(t: Tables) -> DataFrame:
    return rollouts.session_meta(_session_lines(t))


@query("SELECT 's' || max(conv_id) AS session_id FROM (SELECT DISTINCT conv_id FROM conversations ORDER BY 1 DESC LIMIT 8) WHERE conv_id % 3 = 0")
def latest_session(t: Tables) -> DataFrame:
    files = t.conversations.select(F.col("conv_id").alias("file"), F.timestamp_seconds("conv_id").alias("modified"))
    return rollouts.latest_session(files, rollouts.session_meta(_session_lines(t)))


@query("""SELECT conv_id AS file, CASE conv_id % 4 WHEN 2 THEN n - 5 ELSE 0 END::BIGINT AS start, conv_id % 4 = 0 AS is_new FROM (SELECT conv_id, sum(length(text))::BIGINT + 10 AS n FROM conversations GROUP BY 1)
WHERE conv_id % 3 = 0 AND conv_id % 4 <> 1""")
def attached_files(t: Tables) -> DataFrame:
    """Of four files one is new, one as it was, one has grown, one has shrunk."""
    files = t.conversations.groupBy(F.col("conv_id").alias("file")).agg((F.sum(F.length("text")) + 10).alias("bytes"))
    k = F.col("file") % 4
    known = files.where(k > 0).select("file", (F.col("bytes") + F.when(k == 2, -5).when(k == 3, 5).otherwise(0)).alias("bytes"))
    return rollouts.attached(files, rollouts.session_meta(_session_lines(t)), known, "cli", "/w")


@query("SELECT user_id AS stream, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS line_no, event_type || ':' || event_id AS line, true AS whole FROM events UNION ALL SELECT DISTINCT user_id, count(*) OVER (PARTITION BY user_id), 'half', false FROM events")
def framed_lines(t: Tables) -> DataFrame:
    """Chunks that end in the middle of a line: each event's line comes in two of them, and a half one at the end."""
    line = F.concat("event_type", F.lit(":"), F.col("event_id").cast("string"), F.when(F.col("event_id") % 2 == 0, "\r\n").otherwise("\n"))
    parts = t.events.select("user_id", "event_id", F.posexplode(F.array(F.substring(line, 1, 3), F.expr("substring(concat(event_type, ':', event_id, case when event_id % 2 = 0 then '\r\n' else '\n' end), 4)"))).alias("part", "x"))
    rows = parts.select("user_id", (F.col("event_id") * 2 + F.col("part")).alias("n"), "x")
    last = t.events.select("user_id").distinct().select("user_id", F.lit(1 << 60).alias("n"), F.lit("half").alias("x"))
    return rollouts.framed(rows.unionByName(last).withColumnRenamed("user_id", "stream"), "stream", "n", "x")


@query("SELECT doc_id, CASE WHEN doc_id % 4 < 3 THEN 'with' || doc_id % 2 END AS condition, CASE WHEN doc_id % 4 < 3 THEN 't' || doc_id END AS task, CASE doc_id % 4 WHEN 0 THEN 'stats' WHEN 1 THEN 'turns' ELSE 'status' END AS kind FROM documents WHERE doc_id % 4 < 3")
def discovered_tasks(t: Tables) -> DataFrame:
    k = F.col("doc_id") % 4
    path = F.concat(F.lit("/runs/with"), (F.col("doc_id") % 2).cast("string"), F.lit("/t"), F.col("doc_id").cast("string"), F.when(k == 0, "/stats.json").when(k == 1, "/turns.jsonl").when(k == 2, "/status.json").otherwise("/notes.md"))
    return rollouts.discovered(t.documents.select("doc_id", path.alias("file"))).drop("file")


@query("SELECT source, count(*) AS docs, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1")
def reports_by_suffix(t: Tables) -> DataFrame:
    """Statistics written for two halves of the corpus beside other reports, read by the end of their names and added up."""
    path = _folder(t, "reports")
    for half in (0, 1):
        d = t.documents.where(F.col("doc_id") % 2 == half)
        stats = d.groupBy("source").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"))
        store.write_replay(d.select("doc_id", "source"), stats, f"{path}/run{half}")
    return t.spark.read.json(f"{path}/*/stats").groupBy("source").agg(F.sum("docs").alias("docs"), F.sum("chars").alias("chars"))


@query("SELECT source, count(*)::BIGINT AS done FROM documents GROUP BY 1")
def job_status(t: Tables) -> DataFrame:
    """Two versions of a status; the last one counts."""
    path = _folder(t, "status")
    n = t.documents.groupBy("source").agg(F.count("*").alias("done"))
    store.write_status(n.withColumn("done", F.lit(0).cast("long")), path)
    store.write_status(n, path)
    return store.read_status(t.spark, path).select("source", "done")


@query("SELECT conv_id, turn, CASE WHEN role = 'system' THEN 'developer' ELSE role END AS role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations WHERE length(trim(text)) > 0")
def trajectory_rows(t: Tables) -> DataFrame:
    e = rollouts.trajectory_events(t.conversations, "conv_id", "turn", "role", "text").where("type = 'response_item'")
    n = t.conversations.where(F.length(F.trim("text")) > 0).withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).cast("long"))
    return e.join(n.select("conv_id", "place", "turn"), ["conv_id", "place"]).select("conv_id", "turn", "role", "text", "place")


@query("""WITH m AS (SELECT *, turn // 4 AS phase, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS n FROM conversations WHERE length(trim(text)) > 0),
u AS (SELECT conv_id, turn * 10 AS tokens, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE role = 'user'),
r AS (SELECT m.conv_id, phase, 1 AS k, turn, 'response_item' AS type, CASE WHEN role = 'system' THEN 'developer' ELSE role END AS role, CASE WHEN role = 'assistant' THEN u.tokens END AS tokens FROM m LEFT JOIN u ON u.conv_id = m.conv_id AND u.n = m.n AND role = 'assistant'
UNION ALL SELECT DISTINCT conv_id, turn // 4, 0, 0, 'phase', NULL, NULL FROM conversations WHERE turn // 4 > (SELECT min(c.turn // 4) FROM conversations c WHERE c.conv_id = conversations.conv_id))
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY phase, k, turn) AS place, type, role, tokens::BIGINT AS tokens FROM r""")
def phased_trajectory(t: Tables) -> DataFrame:
    """Four turns a phase; the n-th user message's turn stands for the n-th usage record."""
    m = t.conversations.withColumn("phase", F.floor(F.col("turn") / 4)).withColumn("turn", F.col("turn").cast("long"))
    u = t.conversations.where("role = 'user'").select("conv_id", "turn", (F.col("turn") * 10).alias("tokens"))
    return rollouts.phase_events(m, u, "conv_id", "phase", "turn", "role", "text", "turn", "tokens").drop("text")


def _stream(t: Tables) -> DataFrame:
    """An event stream a conversation: items (the index is the turn mod 3), deltas, usage, a line that isn't JSON, the end."""
    n = F.col("turn").cast("long")
    item = _json(type=F.lit("response.output_item.done"), output_index=F.col("turn") % 3, item=F.struct(F.lit("message").alias("type"), F.col("turn").alias("id"), F.array(F.struct(F.lit("output_text").alias("type"), F.col("role").alias("text"))).alias("content")))
    delta = _json(type=F.lit("response.output_text.delta"), delta=F.concat("role", F.lit(";")))
    usage = _json(type=F.lit("response.in_progress"), response=F.struct(F.col("conv_id").alias("no"), F.lit("completed").alias("status"), F.when(F.col("turn") % 2 == 0, F.struct(F.col("turn").alias("input_tokens"), F.lit(2).alias("output_tokens"))).alias("usage")))
    data = lambda c: F.concat(F.lit("data: "), c)
    rows = t.conversations.select("conv_id", F.explode(F.array(F.struct((n * 4).alias("n"), data(item).alias("line")), F.struct((n * 4 + 1).alias("n"), data(delta).alias("line")), F.struct((n * 4 + 2).alias("n"), data(usage).alias("line")), F.struct((n * 4 + 3).alias("n"), F.lit("data: [DONE]").alias("line")))).alias("x"))
    return sse.parse_sse(rows.select("conv_id", "x.n", "x.line"))


@query("SELECT conv_id, turn, t AS type FROM conversations, (SELECT unnest(['response.output_item.done', 'response.output_text.delta', 'response.in_progress']) AS t)")
def sse_events(t: Tables) -> DataFrame:
    return _stream(t).select("conv_id", F.floor(F.col("n") / 4).alias("turn"), "type")


@query("SELECT conv_id, turn % 3 AS index, max(turn) AS id, max_by(role, turn) AS text FROM conversations GROUP BY 1, 2")
def sse_items(t: Tables) -> DataFrame:
    return sse.output_items(_stream(t), "conv_id", "n").select("conv_id", F.col("index").cast("long").alias("index"), F.try_variant_get("item", "$.id", "long").alias("id"), F.try_variant_get("item", "$.content[0].text", "string").alias("text"))


@query("SELECT conv_id, conv_id AS no, len(list(DISTINCT turn % 3))::INT AS n, arg_min(role, (turn % 3, -turn)) AS first FROM conversations GROUP BY 1")
def sse_final_response(t: Tables) -> DataFrame:
    r = sse.final_response(_stream(t), "conv_id", "n")
    return r.select("conv_id", F.get_json_object("body", "$.no").cast("long").alias("no"), F.size("items").alias("n"), F.get_json_object(F.col("items")[0], "$.content[0].text").alias("first"))


@query("SELECT conv_id, string_agg(role || ';', '' ORDER BY turn) AS text FROM conversations GROUP BY 1")
def sse_text(t: Tables) -> DataFrame:
    return sse.response_text(_stream(t), "conv_id", "n")


@query("SELECT conv_id, max(turn) AS input, 2::BIGINT AS output, max(turn) + 2 AS total FROM conversations WHERE turn % 2 = 0 GROUP BY 1")
def sse_usage(t: Tables) -> DataFrame:
    return sse.response_usage(_stream(t), "conv_id", "n").where("input is not null").select("conv_id", "input", "output", "total")


@query("SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN role WHEN turn % 3 = 1 THEN 'x' ELSE '' END AS delta, role || chr(10) || 'b' AS whole, CASE WHEN turn % 2 = 0 THEN 'message,reasoning' ELSE 'message' END AS items, 'output_text,unknown' AS parts FROM conversations")
def response_parts(t: Tables) -> DataFrame:
    """Deltas of two shapes, whole texts, and what a response holds."""
    k = F.col("turn") % 3
    event = F.when(k == 0, _json(type=F.lit("a.delta"), delta=F.col("role"))).when(k == 1, _json(type=F.lit("b.delta"), text=F.lit("x"))).otherwise(_json(type=F.lit("c.done"), text=F.lit("y")))
    part = lambda text, kind: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    message = F.struct(F.lit("message").alias("type"), F.array(part(F.col("role"), "output_text"), part(F.lit("b"), None)).alias("content"))
    reasoning = F.struct(F.lit("reasoning").alias("type"), F.lit(None).cast("array<struct<type:string,text:string>>").alias("content"))
    body = F.parse_json(F.when(F.col("turn") % 2 == 0, _json(output=F.array(message, reasoning))).otherwise(_json(output=F.array(message))))
    shape = sse.response_shape(body)
    return t.conversations.select("conv_id", "turn", sse.text_delta(F.parse_json(event)).alias("delta"), sse.whole_text(body).alias("whole"), F.array_join(shape["items"], ",").alias("items"), F.array_join(shape["parts"], ",").alias("parts"))


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'r' || turn END AS source_id, CASE WHEN turn % 2 = 0 THEN role END AS payload FROM conversations")
def response_fallback(t: Tables) -> DataFrame:
    body = F.parse_json(F.when(F.col("turn") % 2 == 0, _json(id=F.concat(F.lit("r"), F.col("turn").cast("string")), output_text=F.col("role"))).otherwise(_json(id=F.lit("r"), output_text=F.lit("  "))))
    s = sse.assistant_sources(body)
    return t.conversations.select("conv_id", "turn", s["source_id"].alias("source_id"), s["payload"].alias("payload"))


@query("""SELECT conv_id, string_agg('event: response.output_item.added' || chr(10) || 'data: {"type":"response.output_item.added","output_index":' || turn || ',"item":{"id":' || turn || '}}' || chr(10) || chr(10)
|| 'event: response.output_item.done' || chr(10) || 'data: {"type":"response.output_item.done","output_index":' || turn || ',"item":{"id":' || turn || '}}' || chr(10) || chr(10), '' ORDER BY turn)
|| 'event: response.completed' || chr(10) || 'data: {"type":"response.completed"}' || chr(10) || chr(10) || 'data: [DONE]' || chr(10) || chr(10) AS body FROM conversations GROUP BY 1""")
def sse_synthesis(t: Tables) -> DataFrame:
    items = t.conversations.select("conv_id", "turn", F.parse_json(_json(id=F.col("turn"))).alias("item"))
    return sse.synthesize(items, "conv_id", "turn")


@query("SELECT doc_id, CASE WHEN doc_id % 4 < 3 THEN doc_id END AS n FROM documents")
def embedded_json(t: Tables) -> DataFrame:
    """Objects by themselves, in a fence, between words; and none."""
    body, k = _json(n=F.col("doc_id")), F.col("doc_id") % 4
    x = F.when(k == 0, body).when(k == 1, F.concat(F.lit("so:\n```json\n"), body, F.lit("\n```\nend"))).when(k == 2, F.concat(F.lit("I say "), body, F.lit(" done"))).otherwise("nothing {here")
    return t.documents.select("doc_id", x.alias("x")).select("doc_id", F.try_variant_get(sse.json_object("x"), "$.n", "long").alias("n"))


@query("""SELECT doc_id, '{"2":true,"10":null,"a":{"b":[1,2.5],"d":' || doc_id || '},"z":"' || source || '"}' AS stable FROM documents""")
def stable_values(t: Tables) -> DataFrame:
    body = F.concat(F.lit('{"z":"'), F.col("source"), F.lit('","10":null,"a":{"d":'), F.col("doc_id").cast("string"), F.lit('.0,"b":[1,2.50]},"2":true}'))
    return t.documents.select("doc_id", V.stable_json(body).alias("stable"))


@query("SELECT source, printf('%x', list_reduce(list_prepend(2166136261, list_transform(string_split(source, ''), lambda x: ord(x)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) % 4294967296)) AS hash FROM (SELECT DISTINCT source FROM documents)")
def fnv_hashes(t: Tables) -> DataFrame:
    return t.documents.select("source").distinct().select("source", V.fnv1a(F.col("source")).alias("hash"))


@query("""SELECT doc_id, '{"a": [{"Authorization": "[redacted]", "n": ' || doc_id || '}], "api_key": "[redacted]", "text": "' || source || '"}' AS redacted FROM documents""")
def redacted_logs(t: Tables) -> DataFrame:
    """A log written with its secrets blanked at every depth, and read again."""
    body = F.concat(F.lit('{"api_key":"k1","text":"'), F.col("source"), F.lit('","a":[{"Authorization":"Bearer x","n":'), F.col("doc_id").cast("string"), F.lit("}]}"))
    path = _folder(t, "redacted")
    store.write_log(t.documents.select("doc_id", body.alias("fields")), path)
    return t.spark.read.parquet(path).select("doc_id", F.col("fields").alias("redacted"))


@query("SELECT doc_id, source || '|deep|' || lang AS leaves FROM documents WHERE lang IS NOT NULL")
def leaf_strings(t: Tables) -> DataFrame:
    body = _json(a=F.col("source"), b=F.array(F.struct(F.lit("deep").alias("x"), F.lit(3).alias("n"))), c=F.col("lang"))
    return t.documents.where("lang is not null").select("doc_id", F.array_join(V.leaves(body), "|").alias("leaves"))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_id WHEN 1 THEN event_id + 1 END AS input, CASE event_id % 3 WHEN 0 THEN 5 WHEN 1 THEN 6 END::BIGINT AS output, CASE event_id % 3 WHEN 0 THEN 4 WHEN 1 THEN 3 END::BIGINT AS cached,
CASE event_id % 3 WHEN 0 THEN event_id + 5 WHEN 1 THEN 99 WHEN 2 THEN 7 END AS total FROM events""")
def usage_fields(t: Tables) -> DataFrame:
    """Usage under three sets of names; a given total counts."""
    e, k = F.col("event_id"), F.col("event_id") % 3
    body = F.when(k == 0, _json(input_tokens=e, output_tokens=F.lit(5), input_tokens_details=F.struct(F.lit(4).alias("cached_tokens")))).when(k == 1, _json(prompt_tokens=e + 1, completion_tokens=F.lit(6), cached_input_tokens=F.lit(3), total_tokens=F.lit(99))).otherwise(_json(total_tokens=F.lit(7)))
    return t.events.select("event_id", T.usage(F.parse_json(body)).alias("u")).select("event_id", "u.input", "u.output", "u.cached", "u.total")


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'h' || event_id WHEN 1 THEN 'b' || event_id WHEN 2 THEN 'm' || event_id ELSE 'anonymous_' || substr(sha256(props), 1, 16) END AS key FROM events")
def session_keys(t: Tables) -> DataFrame:
    """The id from a header, the body, the metadata, or a hash."""
    own = lambda letter, k: F.when(F.col("event_id") % 4 == k, F.concat(F.lit(f" {letter}"), F.col("event_id").cast("string"))).otherwise("  ")
    return t.events.select("event_id", rollouts.session_key([own("h", 0)], [F.lit(None).cast("string"), own("b", 1)], [own("m", 2)], F.col("props")).alias("key"))


@query("SELECT event_id, CASE event_id % 6 WHEN 0 THEN event_id ELSE 0 END AS \"offset\", CASE event_id % 6 WHEN 0 THEN 3 WHEN 1 THEN 1 WHEN 2 THEN 5 ELSE 5 END::BIGINT AS \"limit\" FROM events")
def recall_arguments(t: Tables) -> DataFrame:
    """Whole numbers, numbers below what is allowed, numbers as strings, broken ones, none, and what isn't JSON."""
    e, k = F.col("event_id").cast("string"), F.col("event_id") % 6
    a = F.when(k == 0, F.concat(F.lit('{"offset":'), e, F.lit(',"limit":3}'))).when(k == 1, '{"offset":-2,"limit":0}').when(k == 2, '{"offset":"4","limit":"9"}').when(k == 3, '{"offset":1.5,"limit":2.5}').when(k == 4, "[]").otherwise("{")
    offset, limit = T.recall_bounds(a)
    return t.events.select("event_id", offset.alias("offset"), limit.alias("limit"))


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN event_id WHEN 1 THEN 0 WHEN 2 THEN 0 WHEN 3 THEN 3 ELSE 0 END::BIGINT AS n, event_id % 5 < 2 AS yes FROM events")
def coercions(t: Tables) -> DataFrame:
    k = F.col("event_id") % 5
    n = F.when(k == 0, F.col("event_id").cast("string")).when(k == 1, "-4.5").when(k == 2, "NaN").when(k == 3, "3.9").otherwise("words")
    yes = F.when(k == 0, " Yes ").when(k == 1, "on").when(k == 2, "OFF").when(k == 3, "0").otherwise("what")
    return t.events.select("event_id", T.non_negative(n).alias("n"), T.flag(yes).alias("yes"))


@query(r"SELECT doc_id, substr(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 80) AS line FROM documents")
def compact_lines(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.compact_line("text", 80).alias("line"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN source || chr(10) || 'x' WHEN 1 THEN 'head' || chr(13) || chr(10) || source WHEN 2 THEN 'head' || chr(10) || 'Output:' || chr(10) ELSE 'head' || chr(10) || 'Output:' || chr(10) || source END AS payload FROM documents")
def tool_payloads(t: Tables) -> DataFrame:
    """A header before the output goes; texts without one, with nothing after it, or of other tools stay."""
    k, s = F.col("doc_id") % 4, F.col("source")
    out = F.when(k == 0, F.concat(F.lit("head\r\nOutput:\r\n"), s, F.lit("\r\nx"))).when(k == 1, F.concat(F.lit("head\r\n"), s)).when(k == 2, "head\nOutput:\n").otherwise(F.concat(F.lit("head\nOutput:\n"), s))
    return t.documents.select("doc_id", T.tool_payload(F.when(k == 3, "other").otherwise("exec_command"), out).alias("payload"))


def _items(t: Tables) -> DataFrame:
    """Input items of eight kinds; the turn mod 8 says which."""
    k, n = F.col("turn") % 8, F.col("turn").cast("string")
    part = F.array(F.struct(F.lit("input_text").alias("type"), F.col("role").alias("text")))
    kinds = [
        _json(type=F.lit("message"), role=F.lit("user"), id=F.concat(F.lit("u"), n), content=part),
        _json(type=F.lit("message"), role=F.lit("assistant"), id=F.concat(F.lit("a"), n), content=F.col("role")),
        _json(type=F.lit("function_call"), call_id=F.concat(F.lit("c"), n), name=F.lit("look")),
        _json(type=F.lit("function_call_output"), call_id=F.concat(F.lit("c"), (F.col("turn") - 1).cast("string")), output=F.concat(F.lit("got "), n)),
        _json(type=F.lit("reasoning"), id=F.concat(F.lit("r"), n)),
        _json(type=F.lit("message"), role=F.lit("developer"), id=F.concat(F.lit("m"), n), content=F.lit("[memory] old")),
        _json(type=F.lit("message"), role=F.lit("system"), id=F.concat(F.lit("y"), n), content=F.lit("rules")),
        _json(type=F.lit("unheard_of"), id=F.concat(F.lit("q"), n)),
    ]
    body = kinds[-1]
    for i, x in enumerate(kinds[:-1]):
        body = F.when(k == i, x).otherwise(body)
    return t.conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.parse_json(body).alias("item"))


@query("""SELECT conv_id, turn, CASE turn % 8 WHEN 0 THEN 'u' || turn WHEN 1 THEN 'a' || turn WHEN 2 THEN 'tool_call:c' || turn WHEN 3 THEN 'c' || turn - 1 WHEN 4 THEN 'r' || turn END AS source_id,
CASE turn % 8 WHEN 0 THEN 'user' WHEN 2 THEN 'tool_call' WHEN 3 THEN 'tool' ELSE 'assistant' END AS kind, CASE WHEN turn % 8 IN (2, 3) THEN 'look' END AS tool,
CASE turn % 8 WHEN 0 THEN role WHEN 1 THEN role WHEN 2 THEN '{"call_id":"c' || turn || '","name":"look","type":"function_call"}' WHEN 3 THEN 'got ' || turn ELSE '{"id":"r' || turn || '","type":"reasoning"}' END AS payload FROM conversations WHERE turn % 8 < 5""")
def request_sources(t: Tables) -> DataFrame:
    """Items as typed sources; an output's call is the item before it."""
    return rollouts.request_sources(_items(t), "conv_id", "turn")


@query("""SELECT conv_id, turn, CASE turn % 8 WHEN 0 THEN 'u' || turn WHEN 1 THEN 'a' || turn WHEN 2 THEN 'c' || turn WHEN 3 THEN 'c' || turn - 1 WHEN 4 THEN 'r' || turn WHEN 5 THEN 'm' || turn WHEN 6 THEN 'y' || turn ELSE 'q' || turn END AS ref,
turn % 8 IN (5, 6) AS is_instruction, turn % 8 = 5 AS is_memory FROM conversations""")
def described_items(t: Tables) -> DataFrame:
    d = rollouts.described(F.col("item"), F.col("turn"))
    return _items(t).select("conv_id", "turn", d.alias("d")).select("conv_id", "turn", "d.ref", "d.is_instruction", "d.is_memory")


@query("""SELECT conv_id, count(*)::INT AS items, count(*) FILTER (turn % 8 = 0)::INT AS "user", count(*) FILTER (turn % 8 = 1)::INT AS assistant, count(*) FILTER (turn % 8 = 5)::INT AS developer, count(*) FILTER (turn % 8 = 3)::INT AS tool_outputs, 'm' || conv_id AS model, conv_id % 2 = 0 AS stream FROM conversations GROUP BY 1""")
def request_contexts(t: Tables) -> DataFrame:
    bodies = _items(t).groupBy("conv_id").agg(F.collect_list("item").alias("input"))
    body = F.parse_json(_json(model=F.concat(F.lit("m"), F.col("conv_id").cast("string")), stream=F.col("conv_id") % 2 == 0, input=F.col("input")))
    m = rollouts.request_metrics(body)
    return bodies.select("conv_id", m.alias("m")).select("conv_id", "m.items", "m.user", "m.assistant", "m.developer", "m.tool_outputs", "m.model", "m.stream")


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 1 ELSE 0 END::INT AS n, CASE event_id % 4 WHEN 0 THEN '{"id":' || event_id || '}' WHEN 1 THEN '{"content":[{"text":"' || event_type || '","type":"input_text"}],"role":"user","type":"message"}' WHEN 2 THEN '{"id":' || event_id || '}' END AS first FROM events""")
def input_items(t: Tables) -> DataFrame:
    """An array, a text, an object, and none of these."""
    k, one = F.col("event_id") % 4, F.struct(F.col("event_id").alias("id"))
    body = F.when(k == 0, _json(input=F.array(one, one))).when(k == 1, _json(input=F.col("event_type"))).when(k == 2, _json(input=one)).otherwise(_json(input=F.lit(5)))
    items = rollouts.input_items(F.parse_json(body))
    return t.events.select("event_id", F.size(items).alias("n"), F.get(items, F.lit(0)).alias("first"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN '\"' || event_type || '\"' WHEN 1 THEN event_id::VARCHAR END AS value FROM events")
def object_paths(t: Tables) -> DataFrame:
    """Each row's own path into its payload."""
    v = F.parse_json(_json(a=F.struct(F.array(F.col("event_type")).alias("list"), F.col("event_id").alias("n"))))
    path = F.when(F.col("event_id") % 3 == 0, "$.a.list[0]").when(F.col("event_id") % 3 == 1, "$.a.n").otherwise("$.a.none")
    return t.events.select("event_id", chunks.object_path(v, path).alias("value"))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN '{"callId":"c' || event_id || '","selector":{"kind":"whole"}}' WHEN 1 THEN '{"selector":{"chunks":[{"end":9,"start":2}],"kind":"chunks"}}' ELSE '{"selector":{"kind":"object_path","path":["a","0"]}}' END AS pointer FROM events""")
def piece_pointers(t: Tables) -> DataFrame:
    k = F.col("event_id") % 3
    source = F.when(k == 0, _json(callId=F.concat(F.lit("c"), F.col("event_id").cast("string"))))
    kind = F.when(k == 0, "whole").when(k == 1, "chunks").otherwise("object_path")
    spans, path = F.array(F.struct(F.lit(2).alias("start"), F.lit(9).alias("end"))), F.array(F.lit("a"), F.lit("0"))
    return t.events.select("event_id", chunks.pointer(source, kind, spans, path).alias("pointer"))


@query("""WITH d AS (SELECT doc_id, text, length(text) AS n, least(length(text), 5) AS a, least(length(text), 9) AS b, least(length(text), 12) AS c FROM documents)
SELECT doc_id, CASE WHEN n = 0 THEN '' ELSE '<segment start=0 end=' || a || '>' || chr(10) || substr(text, 1, a) || chr(10) || '</segment>' || CASE WHEN c > b THEN chr(10) || '<gap omittedChars=' || (b - a) || ' />' || chr(10) || '<segment start=' || b || ' end=' || c || '>' || chr(10) || substr(text, b + 1, c - b) || chr(10) || '</segment>'
|| CASE WHEN n > c THEN chr(10) || '<gap omittedChars=' || (n - c) || ' />' ELSE '' END ELSE CASE WHEN n > a THEN chr(10) || '<gap omittedChars=' || (n - a) || ' />' ELSE '' END END END AS rendered,
strlen(substr(text, 1, a) || substr(text, b + 1, c - b))::BIGINT AS bytes, nullif(substr(text, 1, a) || substr(text, b + 1, c - b), '') AS comparable FROM d""")
def selections(t: Tables) -> DataFrame:
    """Spans beyond the text, empty, overlapping and out of order: two are left, rendered, sized and made comparable."""
    span = lambda a, b: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"))
    spans = F.array(span(9, 12), span(-4, 5), span(3, 7), span(8, 8), span(10, 11))
    d = t.documents.select("doc_id", "text", chunks.selected(F.col("text"), spans).alias("s"))
    d = d.select("doc_id", prompt.selection_text(F.col("s"), F.length("text")).alias("rendered"), prompt.selection_bytes(F.col("s")).alias("bytes"))
    return d.withColumn("comparable", prompt.comparable_text(F.col("rendered")))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'thread.started' WHEN 1 THEN 'turn.started' WHEN 2 THEN 'turn.completed' WHEN 3 THEN 'item.completed' END AS type, CASE event_id % 5 WHEN 0 THEN 's' || event_id END AS thread, CASE WHEN event_id % 5 IN (1, 2) THEN 't' || event_id END AS turn,
CASE event_id % 5 WHEN 3 THEN 'exec_observed_c' || event_id END AS source_id, CASE event_id % 5 WHEN 3 THEN 'ls -l' END AS command, CASE event_id % 5 WHEN 3 THEN event_type END AS payload FROM events""")
def envelope_events(t: Tables) -> DataFrame:
    """Log envelopes as thread, turn and item events, and the tool sources of completed commands."""
    e, k = F.col("event_id").cast("string"), F.col("event_id") % 5
    body = (
        F.when(k == 0, _json(type=F.lit("session_meta"), payload=F.struct(F.concat(F.lit("s"), e).alias("id"))))
        .when(k == 1, _json(type=F.lit("event_msg"), payload=F.struct(F.lit("task_started").alias("type"), F.concat(F.lit("t"), e).alias("turn_id"))))
        .when(k == 2, _json(type=F.lit("event_msg"), payload=F.struct(F.lit("task_complete").alias("type"), F.concat(F.lit("t"), e).alias("turn_id"))))
        .when(k == 3, _json(type=F.lit("event_msg"), payload=F.struct(F.lit("exec_command_end").alias("type"), F.concat(F.lit("c"), e).alias("call_id"), F.array(F.lit("ls"), F.lit("-l")).alias("command"), F.col("event_type").alias("aggregated_output"))))
        .otherwise(_json(type=F.lit("event_msg"), payload=F.struct(F.lit("exec_command_end").alias("type"), F.lit("").alias("aggregated_output"))))
    )
    x = t.events.select("event_id", prompt.envelope_event(F.parse_json(body)).alias("x"))
    s = prompt.observed_tool(F.col("x.type"), F.col("x.item"), F.col("x.command"), F.col("x.output"))
    return x.select("event_id", "x.type", "x.thread", "x.turn", s["source_id"].alias("source_id"), s["command"].alias("command"), s["payload"].alias("payload"))


@query("SELECT event_id, event_id % 3 < 2 AS parsed, CASE WHEN event_id % 3 < 2 THEN event_type END AS type, CASE event_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' END AS thread, CASE event_id % 3 WHEN 0 THEN 'i' || event_id END AS item FROM events")
def event_summaries(t: Tables) -> DataFrame:
    k = F.col("event_id") % 3
    body = F.when(k == 0, _json(type=F.col("event_type"), params=F.struct(F.lit("a").alias("threadId"), F.struct(F.concat(F.lit("i"), F.col("event_id").cast("string")).alias("id")).alias("item")))).when(k == 1, _json(type=F.col("event_type"), params=F.struct(F.struct(F.lit("b").alias("id")).alias("thread")))).otherwise("[1]")
    s = prompt.event_summary(F.parse_json(body))
    return t.events.select("event_id", s.alias("s")).select("event_id", "s.parsed", "s.type", "s.thread", "s.item")


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN '{"n":' || event_id || '}' WHEN 1 THEN '"plain ' || event_id || '"' ELSE '{"binaryBase64":"' || base64(encode('b' || event_id)) || '","bytes":' || strlen('b' || event_id) || '}' END AS payload FROM events""")
def frame_payloads(t: Tables) -> DataFrame:
    k, e = F.col("event_id") % 3, F.col("event_id").cast("string")
    text = F.when(k == 0, _json(n=F.col("event_id"))).when(k == 1, F.concat(F.lit("plain "), e))
    return t.events.select("event_id", prompt.frame_payload(text, F.when(k == 2, F.encode(F.concat(F.lit("b"), e), "UTF-8"))).alias("payload"))


@query("SELECT user_id, 'Token usage: total=' || format('{:,}', t) || ' input=' || format('{:,}', i - c) || CASE WHEN c > 0 THEN ' (+ ' || format('{:,}', c) || ' cached)' ELSE '' END || ' output=' || format('{:,}', t - i) AS line FROM (SELECT user_id, sum(event_id)::BIGINT AS t, sum(CASE WHEN event_id % 2 = 0 THEN event_id ELSE 0 END)::BIGINT AS i, sum(CASE WHEN event_id % 4 = 0 THEN event_id ELSE 0 END)::BIGINT AS c FROM events GROUP BY 1)")
def token_summaries(t: Tables) -> DataFrame:
    part = lambda c: F.sum(F.when(c, F.col("event_id")).otherwise(0))
    s = t.events.groupBy("user_id").agg(F.sum("event_id").alias("t"), part(F.col("event_id") % 2 == 0).alias("i"), part(F.col("event_id") % 4 == 0).alias("c"))
    return s.select("user_id", render.token_summary(F.col("t"), F.col("i"), F.col("c"), F.col("t") - F.col("i")).alias("line"))


@query("""WITH b AS (SELECT doc_id, source, doc_id % 4 AS k, least(4, length(source)) AS a, length(source) AS n FROM documents),
p AS (SELECT doc_id, 0 AS i, 'whole' AS selector, source AS content FROM b WHERE k < 2 UNION ALL SELECT doc_id, unnest([0, 1]), unnest(['path:0', 'path:1']), unnest(['"' || source || '"', doc_id::VARCHAR]) FROM b WHERE k = 2
UNION ALL SELECT doc_id, 0, 'chunks:0-' || a, substr(source, 1, a) FROM b WHERE k = 3 UNION ALL SELECT doc_id, 1, 'chunks:' || a || '-' || n, substr(source, a + 1) FROM b WHERE k = 3 AND n > a)
SELECT doc_id, doc_id || ':' || i AS piece_id, selector, content FROM p WHERE content <> ''""")
def dispatched_chunks(t: Tables) -> DataFrame:
    """Sources of four kinds: a user's and a call's whole, an own tool's by elements, another tool's by an outline of four characters and the rest."""
    k = F.col("doc_id") % 4
    body = F.when(k == 2, _json(items=F.array(F.to_json(F.struct("source")), F.lit("x"))))
    body = F.when(k == 2, F.concat(F.lit('{"items":["'), F.col("source"), F.lit('",'), F.col("doc_id").cast("string"), F.lit("]}"))).otherwise(F.col("source"))
    kind, tool = F.when(k == 0, "user").when(k == 1, "tool_call").otherwise("tool"), F.when(k == 2, "recall.page").otherwise("shell")
    s = t.documents.select("doc_id", kind.alias("kind"), tool.alias("tool"), body.alias("payload"))
    a, n = F.least(F.lit(4), F.length("payload")), F.length("payload")
    spans = F.array(F.struct(F.lit(0).alias("start"), a.alias("end")), F.struct(a.alias("start"), n.alias("end")))
    return chunks.dispatched(s, "doc_id", "kind", "tool", "payload", spans)


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i, len(string_split(text, chr(10))) AS n FROM documents WHERE text <> ''),
s AS (SELECT *, (sum(length(line) + 2) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) - length(line) - 2)::INT AS start, (sum(length(line)) OVER (PARTITION BY doc_id) + 2 * (n - 1))::INT AS total FROM l),
c AS (SELECT doc_id, start, total FROM s WHERE line <> '' AND i < n UNION SELECT doc_id, 0, total FROM s),
e AS (SELECT *, lead(start, 1, total) OVER (PARTITION BY doc_id ORDER BY start) AS "end" FROM c)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1)::INT AS index, start, "end" FROM e WHERE "end" > start""")
def outlined_chunks(t: Tables) -> DataFrame:
    """Texts with a blank line after each line, cut by the paragraphs' first lines; the last one has no line feed to be found by."""
    d = t.documents.select("doc_id", F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n")).alias("text"))
    return outline.outlined(d, "doc_id", "text")


#: Texts cut in halves of at most 500 characters, for seven rounds, where the second half is first found; an outline fails on some lengths.
HALVES = """WITH RECURSIVE r AS (SELECT doc_id, 0 AS round, 0::BIGINT AS start, text AS p FROM documents WHERE text <> ''
UNION ALL SELECT doc_id, round + 1, start + CASE part WHEN 1 THEN 0 ELSE cut END, CASE part WHEN 1 THEN substr(p, 1, cut) ELSE substr(p, cut + 1) END
FROM (SELECT *, strpos(p, substr(p, length(p) // 2 + 1)) - 1 AS cut FROM r WHERE round < 7 AND length(p) > 500 AND length(p) % 97 <> 5), (SELECT unnest([1, 2]) AS part) WHERE cut > 0),
bad AS (SELECT DISTINCT doc_id FROM r WHERE round < 7 AND length(p) % 97 = 5),
leaf AS (SELECT doc_id, start, start + length(p) AS stop FROM r WHERE doc_id NOT IN (FROM bad) AND NOT (round < 7 AND length(p) > 500 AND strpos(p, substr(p, length(p) // 2 + 1)) > 1)
UNION ALL SELECT doc_id, 0, length(text) FROM documents WHERE doc_id IN (FROM bad))
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1)::INT AS index, start::INT AS start, stop::INT AS "end" FROM leaf"""


def _picky(text: str) -> list[str]:
    if len(text) % 97 == 5:
        raise ValueError("no outline")
    return outline.halves(500)(text)


@query(HALVES)
def iterated_outlines(t: Tables) -> DataFrame:
    """Pieces split again and again, for seven rounds at most; a source with a piece on which the outline fails stays whole."""
    return outline.outlined(t.documents, "doc_id", "text", _picky)


@query("SELECT event_id, last_value(CASE WHEN event_id % 7 = 0 THEN user_id END IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS thread FROM events")
def default_threads(t: Tables) -> DataFrame:
    """A log an event type. Every seventh event names its thread; the others belong to the latest one named in their log."""
    e = t.events.select("event_id", "event_type", F.when(F.col("event_id") % 7 == 0, F.col("user_id")).alias("thread"))
    return rollouts.with_default_thread(e, "event_type", ["event_id"], "thread").select("event_id", "thread")


#: Seconds that a waiter waits and a turn is kept.
WAIT, KEEP = 6 * 3600, 4 * 86_400

#: A queue a thread, an event at a time: waiters still there, turns still there, and what this event settles.
WAITING = f"""WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) // 1000000 AS sec, event_type AS kind, event_id::VARCHAR AS got, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000000, event_id) AS n FROM events WHERE event_type IN ('view', 'purchase')),
q AS (SELECT user_id, 0::BIGINT AS n, []::BIGINT[] AS w, []::STRUCT(sec BIGINT, got VARCHAR)[] AS t, []::STRUCT(sec BIGINT, got VARCHAR)[] AS o FROM (SELECT DISTINCT user_id FROM e)
UNION ALL SELECT user_id, n, CASE WHEN kind = 'purchase' THEN w[2:] WHEN len(t) > 0 THEN w ELSE list_append(w, sec) END, CASE WHEN kind <> 'purchase' THEN t[2:] WHEN len(w) > 0 THEN t ELSE list_append(t, struct_pack(sec := sec, got := got)) END,
  list_concat(l, CASE WHEN kind = 'purchase' AND len(w) > 0 THEN [struct_pack(sec := w[1], got := got)] WHEN kind <> 'purchase' AND len(t) > 0 THEN [struct_pack(sec := sec, got := t[1].got)] ELSE []::STRUCT(sec BIGINT, got VARCHAR)[] END)
  FROM (SELECT e.*, list_filter(q.w, lambda x: e.sec - x <= {WAIT}) AS w, list_filter(q.t, lambda x: e.sec - x.sec <= {KEEP}) AS t, list_transform(list_filter(q.w, lambda x: e.sec - x > {WAIT}), lambda x: struct_pack(sec := x, got := NULL::VARCHAR)) AS l FROM q JOIN e ON e.user_id = q.user_id AND e.n = q.n + 1))
SELECT user_id AS thread, o.sec AS asked_at, o.got AS got FROM (SELECT user_id, unnest(o) AS o FROM q)
UNION ALL SELECT user_id, sec, NULL FROM (SELECT user_id, unnest(arg_max(w, n)) AS sec FROM q GROUP BY 1) WHERE sec + {WAIT} + 1 < (SELECT max(sec) FROM e)"""


@query(WAITING)
def waiting_turns(t: Tables) -> DataFrame:
    """Views as requests that wait for a completed turn of their thread, purchases as such turns. Who still waits as the watermark ends gets none yet."""
    path = _folder(t, "waits")
    kind = F.when(F.col("event_type") == "purchase", "turn").otherwise("wait")
    t.events.where(F.col("event_type").isin("view", "purchase")).select(F.col("user_id").alias("thread"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("order"), kind.alias("kind"), F.col("event_id").cast("string").alias("got")).write.parquet(path)
    live = t.spark.readStream.schema("thread long, at timestamp, order long, kind string, got string").parquet(path)
    with observed.with_rocksdb(t.spark):
        return observed.run_available(observed.paired_turns_stream(live, WAIT, KEEP), "pairs")


def _log_rows(t: Tables) -> DataFrame:
    """(file, place, line): documents as lines of some log files, each of which describes itself first; a file has about 500 lines."""
    files = max(8, t.documents.count() // 500)
    d = t.documents.select((F.col("doc_id") % files).alias("file"), F.col("doc_id").alias("place"), F.concat(F.col("doc_id").cast("string"), F.lit(" "), F.regexp_replace("text", "[\\r\\n]", " ")).alias("line"))
    head = t.spark.range(files).select(F.col("id").alias("file"), F.lit(-1).cast("long").alias("place"), F.concat(F.lit('{"type":"session_meta","payload":{"id":"s'), F.col("id").cast("string"), F.lit('","cwd":"/w","originator":"'), F.when(F.col("id") % 4 == 3, "ide").otherwise("cli"), F.lit('"}}')).alias("line"))
    return head.unionByName(d)


#: The lines of those files with their first and last bytes, and each file's length.
LOGS = """(SELECT *, sum(n) OVER (PARTITION BY file ORDER BY place ROWS UNBOUNDED PRECEDING)::BIGINT - n AS start, sum(n) OVER (PARTITION BY file ORDER BY place ROWS UNBOUNDED PRECEDING)::BIGINT AS stop, sum(n) OVER (PARTITION BY file)::BIGINT AS bytes, max(place) OVER (PARTITION BY file) = place AS last FROM (
SELECT *, strlen(line)::BIGINT + 1 AS n FROM (SELECT doc_id % (SELECT greatest(8, count(*) // 500) FROM documents) AS file, doc_id AS place, doc_id || ' ' || regexp_replace(text, '[\r\n]', ' ', 'g') AS line FROM documents
UNION ALL SELECT i, -1, '{"type":"session_meta","payload":{"id":"s' || i || '","cwd":"/w","originator":"' || CASE WHEN i % 4 = 3 THEN 'ide' ELSE 'cli' END || '"}}' FROM (SELECT unnest(range((SELECT greatest(8, count(*) // 500) FROM documents))) AS i))))"""


def _write_logs(rows: DataFrame, path: str, share: float, half: bool = False) -> None:
    """Each file's first share of bytes, wherever that ends; `half` leaves out the last line feed of every fourth file."""
    out = path.removeprefix("file://")

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        k = int(pdf["file"].iloc[0])
        body = "".join(x + "\n" for x in pdf.sort_values("place")["line"]).encode()
        body = body[: int(len(body) * share) - (half and k % 4 == 1)]
        fs, folder = tail.opened(path) if "://" in path else tail.opened(out)
        fs.create_dir(folder, recursive=True)
        with fs.open_output_stream(f"{folder}/{k}.jsonl") as f:
            f.write(body)
        return pd.DataFrame({"bytes": [len(body)]})

    rows.groupBy("file").applyInPandas(write, "bytes long").agg(F.sum("bytes")).collect()


@query(f"""SELECT file, start, line FROM {LOGS} WHERE file % 4 <> 2 AND NOT (file % 4 = 1 AND last)
UNION ALL SELECT file, start, line FROM {LOGS} WHERE file % 4 = 2 AND stop <= floor(bytes * 0.6)
UNION ALL SELECT file, sum(n) OVER (PARTITION BY file ORDER BY place ROWS UNBOUNDED PRECEDING)::BIGINT - n, line FROM (SELECT file, place, 'new ' || line AS line, n + 4 AS n FROM {LOGS} WHERE file % 4 = 2 AND place % 3 = 0)""")
def tailed_lines(t: Tables) -> DataFrame:
    """Logs followed over two triggers: at first each ends within a line, then it is whole, lacks its last line feed, or was truncated and has other lines."""
    path, rows = _folder(t, "tail"), _log_rows(t)
    base = _folder(t, "tailed")

    def follow() -> None:
        q = tail.tailed(t.spark, path).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/progress").trigger(availableNow=True).start()
        q.awaitTermination()

    _write_logs(rows, path, 0.6)
    follow()
    _write_logs(rows.where("file % 4 <> 2"), path, 1.0, half=True)
    _write_logs(rows.where("file % 4 = 2 and place % 3 = 0").withColumn("line", F.concat(F.lit("new "), "line")), path, 1.0)
    follow()
    out = t.spark.read.schema("file string, start long, line string").parquet(f"{base}/out")
    return out.select(F.regexp_extract("file", r"(\d+)\.jsonl$", 1).cast("long").alias("file"), "start", "line")


@query(f"""SELECT file, file % 4 = 0 AS is_new, start, line FROM (SELECT *, max(CASE WHEN stop <= bytes // 2 THEN stop ELSE 0 END) OVER (PARTITION BY file) AS seen FROM {LOGS}) WHERE file % 4 IN (0, 2) AND file % 5 < 4 OR file % 4 = 1 AND start >= seen AND file % 5 < 4""")
def attached_lines(t: Tables) -> DataFrame:
    """What there is to read as a follower attaches: of a new log all, of one that has grown what follows the half seen before, of one that has shrunk all;
    nothing of every fifth, which is as it was, nor of another program's logs."""
    path, rows = _folder(t, "attach"), _log_rows(t)
    _write_logs(rows, path, 1.0)
    read = rollouts.read_lines(t.spark, path)
    files = read.groupBy("file").agg(F.max("bytes").alias("bytes"))
    number = F.regexp_extract("file", r"(\d+)\.jsonl$", 1).cast("long")
    w = Window.partitionBy("file").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = rows.withColumn("stop", F.sum(F.octet_length("line") + 1).over(w)).withColumn("bytes", F.max("stop").over(Window.partitionBy("file")))
    half = ends.groupBy("file").agg(F.coalesce(F.max(F.when(F.col("stop") <= F.floor(F.col("bytes") / 2), F.col("stop"))), F.lit(0)).alias("half")).withColumnRenamed("file", "k")
    known = files.withColumn("k", number).join(half, "k").where("k % 4 > 0 or k % 5 = 4")
    known = known.select("file", F.when(F.col("k") % 5 == 4, F.col("bytes")).when(F.col("k") % 4 == 1, F.col("half")).otherwise(F.col("bytes") + 100).alias("bytes"))
    attached = rollouts.attached(files, rollouts.session_meta(read), known, "cli", "/w")
    return tail.attached_lines(files, attached).select(number.alias("file"), "is_new", "start", "line")


@query("""SELECT user_id, count(*) AS events, count(*) FILTER (event_type = 'view') AS calls, count(*) FILTER (event_type = 'click') AS outputs, string_agg(DISTINCT CASE WHEN event_type IN ('view', 'click') THEN 'tool' || event_id % 3 END, ',' ORDER BY CASE WHEN event_type IN ('view', 'click') THEN 'tool' || event_id % 3 END) AS tools FROM events GROUP BY 1""")
def observed_items(t: Tables) -> DataFrame:
    """Counts of a thread's items by type, and the tools named in them."""
    kind = F.when(F.col("event_type") == "view", "function_call").when(F.col("event_type") == "click", "function_call_output").otherwise("message")
    e = t.events.select("user_id", kind.alias("kind"), F.concat(F.lit("tool"), (F.col("event_id") % 3).cast("string")).alias("tool"))
    return turns.item_counts(e, "user_id", "kind", "tool").select("user_id", "events", "calls", "outputs", F.array_join("tools", ",").alias("tools"))


@query("SELECT event_id, CASE WHEN event_id % 4 IN (0, 1, 2) THEN true ELSE false END AS met FROM events")
def live_expectations(t: Tables) -> DataFrame:
    """An answer that is what was expected, one in another case with a label before it, one in quotes, and another one."""
    k, want = F.col("event_id") % 4, F.concat("event_type", F.col("event_id").cast("string"))
    said = F.when(k == 0, want).when(k == 1, F.concat(F.lit("Answer: "), F.upper(want))).when(k == 2, F.concat(F.lit("`"), want, F.lit("`."))).otherwise(F.concat(want, F.lit(" or not")))
    return t.events.select("event_id", predicates.expected(said, want).alias("met"))


@query("""WITH e AS (SELECT user_id, event_id, event_type, epoch_us(ts) // 1000000 AS sec, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
w AS (SELECT e.* FROM e JOIN (SELECT user_id, max(n) AS f FROM e WHERE event_type = 'signup' GROUP BY 1) USING (user_id) WHERE n >= f),
a AS (SELECT user_id, max(sec) FILTER (event_type <> 'error') - min_by(sec, n) AS seconds, coalesce(max_by(event_id % 7, n) FILTER (event_type = 'click'), count(*) FILTER (event_type = 'purchase')) AS finished FROM w GROUP BY 1),
r AS (SELECT *, CASE WHEN seconds > 0 AND finished > 0 THEN round_even(3600.0::DOUBLE * finished / seconds, 2) END AS per_hour FROM a)
SELECT user_id AS log, seconds, finished, per_hour, round_even(8.0::DOUBLE / nullif(per_hour, 0), 2) AS hours_left FROM r""")
def batch_logs(t: Tables) -> DataFrame:
    """A log a user, a line an event: starts of batches, completions, heartbeats that tell a count, notes, and lines without a time."""
    stamp = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    kind, i = F.col("event_type"), F.col("event_id").cast("string")
    told = F.when(kind == "signup", F.concat(F.lit(" batch_start "), i)).when(kind == "purchase", F.concat(F.lit(" done ["), i, F.lit("/9]"))).when(kind == "click", F.concat(F.lit(" heartbeat completed_this_run="), (F.col("event_id") % 7).cast("string"), F.lit("/9 queued=2"))).otherwise(F.concat(F.lit(" note "), F.col("props")))
    line = F.when(kind == "error", F.concat(F.lit("no time here: "), F.col("props"))).otherwise(F.concat(stamp, told))
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    df = t.events.select(F.col("user_id").alias("log"), n.alias("n"), line.alias("line"))
    return logs.batch_progress(df, "log", "n", "line", F.lit(20), F.lit(12)).select("log", "seconds", "finished", "per_hour", "hours_left")
