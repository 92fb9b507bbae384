"""Queries over documents, benchmark, labels, events and pages: dedupe, chunks, decisions, usage, turns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.values import leaves
from ..operators import archive, chunks, containment, decisions, dedupe, logs, metrics, predicates, render, turns
from ..streaming import observed
from .registry import Tables, query

HASH = "substr(sha256(text), 1, 20)"
PREVIEW = "CASE WHEN length(text) > 160 THEN substr(text, 1, 157) || '...' ELSE text END"
#: Documents as pieces: a session a source; the later half (by id) is new.
DOCS = f"(SELECT doc_id, source, {HASH} AS hash, doc_id % 2 = 1 AS is_new FROM documents)"


def _docs(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "source", T.short_hash("text", 20).alias("hash"), (F.col("doc_id") % 2 == 1).alias("is_new"))


@query(f"SELECT doc_id, {PREVIEW} AS preview FROM documents")
def text_preview(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.preview("text").alias("preview"))


@query("SELECT doc_id, substr(sha256(text), 1, 20) AS content_hash, substr(sha256(text), 1, 16) AS archive_ref FROM documents")
def content_hash(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.short_hash("text", 20).alias("content_hash"), T.short_hash("text").alias("archive_ref"))


@query("SELECT doc_id, strlen(text)::BIGINT AS bytes, length(text)::BIGINT AS units, ceil(length(text) / 4.0)::BIGINT AS tokens, length(to_json(text)::VARCHAR)::BIGINT AS json_chars FROM documents")
def byte_sizes(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.byte_size("text").alias("bytes"), T.utf16_length("text").alias("units"), T.estimated_tokens("text").alias("tokens"), T.json_length("text").alias("json_chars"))


@query("SELECT doc_id, CASE WHEN length(text) > 4000 THEN substr(text, 1, 4000) || '... [truncated ' || (length(text) - 4000) || ' chars]' ELSE text END AS compact, regexp_replace(source, '[^A-Za-z0-9._-]', '_', 'g') || '_' || substr(sha256(source), 1, 10) AS session_dir FROM documents")
def compact_texts(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.compact_json("text").alias("compact"), T.session_dir("source").alias("session_dir"))


@query(f"SELECT doc_id, canonical, is_new AND doc_id <> canonical AS duplicate FROM (SELECT *, first_value(doc_id) OVER (PARTITION BY source, hash ORDER BY is_new, doc_id) AS canonical FROM {DOCS})")
def mark_duplicates(t: Tables) -> DataFrame:
    return dedupe.mark_duplicates(_docs(t), ["source"], "hash", "is_new", "doc_id", "doc_id").select("doc_id", "canonical", "duplicate")


@query(f"SELECT doc_id, canonical, doc_id <> canonical AS duplicate FROM (SELECT *, first_value(doc_id) OVER (PARTITION BY hash ORDER BY NOT is_new, doc_id) AS canonical FROM {DOCS})")
def collapse_prefer_new(t: Tables) -> DataFrame:
    return dedupe.collapse_prefer(_docs(t), [], "hash", "is_new", "doc_id", "doc_id").select("doc_id", "canonical", "duplicate")


@query(f"""SELECT doc_id, canonical, asked AND n > 1 AND doc_id <> canonical AS duplicate FROM (SELECT *, doc_id % 3 <> 0 AS asked FROM {DOCS}) JOIN (
SELECT hash, count(*) AS n, coalesce(max(doc_id) FILTER (doc_id % 3 = 0 AND is_new), min(doc_id) FILTER (doc_id % 3 = 0), min(doc_id)) AS canonical FROM {DOCS} GROUP BY 1) USING (hash)""")
def verified_duplicates(t: Tables) -> DataFrame:
    """Every document whose id isn't a multiple of three is asked to go."""
    d = _docs(t).withColumn("asked", F.col("doc_id") % 3 != 0)
    return dedupe.collapse_verified(d, [], "hash", "asked", "is_new", "doc_id", "doc_id").select("doc_id", "canonical", "duplicate")


@query(f"SELECT doc_id, canonical FROM (SELECT *, first_value(doc_id) OVER (PARTITION BY hash ORDER BY NOT is_new, doc_id) AS canonical FROM {DOCS}) WHERE doc_id <> canonical")
def duplicate_markers(t: Tables) -> DataFrame:
    m = dedupe.collapse_prefer(_docs(t), [], "hash", "is_new", "doc_id", "doc_id")
    return dedupe.duplicate_markers(m, [], "doc_id", ["doc_id"]).select("doc_id", "canonical")


@query(f"SELECT hash, max(doc_id) AS doc_id, max_by(source, doc_id) AS source FROM {DOCS} GROUP BY 1")
def dedupe_by_id(t: Tables) -> DataFrame:
    return dedupe.dedupe_last(_docs(t).select("hash", "doc_id", "source"), ["hash"], "doc_id")


@query(f"SELECT doc_id, hash FROM {DOCS} d WHERE is_new AND NOT EXISTS (SELECT 1 FROM {DOCS} o WHERE NOT o.is_new AND o.hash = d.hash)")
def new_source_antijoin(t: Tables) -> DataFrame:
    d = _docs(t)
    return dedupe.new_sources(d.where("is_new").select("hash", "doc_id"), d.where("not is_new"), ["hash"])


@query("SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def verbatim_check(t: Tables) -> DataFrame:
    return archive.verbatim(t.documents, t.benchmark, "doc_id", "text", "item_id", "text")


@query("""SELECT doc_id, needle FROM documents JOIN (SELECT DISTINCT text AS needle FROM benchmark UNION SELECT substr(text, 5, 9) FROM benchmark UNION SELECT substr(text, 20, 5) FROM benchmark UNION SELECT DISTINCT source FROM documents) ON contains(text, needle) OR contains(source, needle)
UNION SELECT doc_id, '"source":"' || source || '"' FROM documents WHERE source LIKE '%1'""")
def leaf_containment(t: Tables) -> DataFrame:
    """Benchmark items, some of their parts and sources' names among the strings of payloads, and what only payloads as they are written hold.

    The former are looked for in the strings alone: a payload as it is written has escapes (a line feed is a backslash and an n) which are no text.
    An empty needle is in every payload with a string.
    """
    b, d = t.benchmark, t.documents
    needles = b.select(F.col("text").alias("needle")).union(b.select(F.substring("text", 5, 9))).union(b.select(F.substring("text", 20, 5))).union(d.select("source")).distinct().withColumn("n", F.col("needle"))
    # A field as the payload writes it, known by the name that isn't escaped.
    field = F.regexp_extract(F.to_json(F.struct("source")), r"(?s)^\{(.*)\}$", 1)
    fields = d.where("source like '%1'").select(field.alias("needle"), F.concat(F.lit('"source":"'), "source", F.lit('"')).alias("n")).distinct()
    payloads = d.select("doc_id", F.to_json(F.struct(F.col("text"), F.array(F.struct("source")).alias("in"))).alias("payload"))
    strings = payloads.select("doc_id", F.explode(leaves(F.col("payload"))).alias("text"))
    found = containment.contained(strings, "doc_id", "text", needles, "n", "needle").union(containment.contained(payloads, "doc_id", "payload", fields, "n", "needle"))
    everywhere = d.where("text is not null or source is not null").select("doc_id").distinct().crossJoin(needles.where("needle = ''").select("n"))
    return found.union(everywhere).select("doc_id", F.col("n").alias("needle"))


LINES = r"(SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i, len(string_split(text, chr(10))) AS n FROM documents)"
SPANS = f"(SELECT doc_id, i, length(line) + CASE WHEN i < n THEN 1 ELSE 0 END AS len, line || CASE WHEN i < n THEN chr(10) ELSE '' END AS content FROM {LINES})"
LINE_CHUNKS = f"""(SELECT doc_id, doc_id || ':' || (i - 1) AS piece_id, (sum(len) OVER w - len)::INT AS "start", (sum(len) OVER w)::INT AS "end", substr(sha256(content), 1, 20) AS content_hash FROM {SPANS} WHERE len > 0 WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING))"""


def _lines(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "text", chunks.line_spans(F.col("text")).alias("spans"))


@query(f"SELECT * FROM {LINE_CHUNKS}")
def line_chunks(t: Tables) -> DataFrame:
    p = chunks.explode_pieces(_lines(t), "doc_id", "text", F.col("spans"))
    return p.select("doc_id", "piece_id", "start", "end", T.short_hash("content", 20).alias("content_hash"))


@query("SELECT doc_id, doc_id % 3 = 0 OR text = '' AS lossless FROM documents")
def lossless_check(t: Tables) -> DataFrame:
    """Line spans as they are, with the first one missing, and with the last one cut short: only the first are lossless."""
    spans = F.col("spans")
    short = F.transform(spans, lambda s, i: F.struct(s["start"].alias("start"), F.when(i == F.size(spans) - 1, s["end"] - 1).otherwise(s["end"]).alias("end")))
    kind = F.col("doc_id") % 3
    broken = F.when(kind == 0, spans).when(kind == 1, F.slice(spans, F.lit(2), F.greatest(F.lit(0), F.size(spans) - 1))).otherwise(short)
    return _lines(t).select("doc_id", chunks.lossless(F.col("text"), broken).alias("lossless"))


@query("""WITH a AS (SELECT doc_id, length(text) AS n, instr(text, '. A') AS p, text FROM documents),
b AS (SELECT *, CASE WHEN p > 0 THEN p + 3 ELSE 1 END AS after FROM a),
c AS (SELECT *, instr(substr(text, after), '. ') AS i FROM b),
o AS (SELECT doc_id, n, 0 AS cut FROM c UNION SELECT doc_id, n, p - 1 FROM c WHERE p > 0 UNION SELECT doc_id, n, i + after - 2 FROM c WHERE i > 0),
s AS (SELECT doc_id, cut, lead(cut, 1, n) OVER (PARTITION BY doc_id ORDER BY cut) AS "end" FROM o)
SELECT doc_id, coalesce(string_agg(cut || '-' || "end", ',' ORDER BY cut) FILTER ("end" > cut), '') AS spans FROM s GROUP BY 1""")
def anchor_spans(t: Tables) -> DataFrame:
    """Three anchors, one of them nowhere: each one found cuts the text, and what precedes the first is a span too."""
    spans = chunks.anchor_spans(F.col("text"), F.array(F.lit(". A"), F.lit("zzzz"), F.lit(". ")))
    return t.documents.select("doc_id", F.array_join(F.transform(spans, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",").alias("spans"))


@query("""WITH s AS (SELECT doc_id, unnest([(doc_id * 7) % 50, (doc_id * 11) % 50, (doc_id * 13) % 50]) AS a FROM documents), e AS (SELECT doc_id, a, a + 9 AS b FROM s),
m AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY doc_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM e),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM m),
r AS (SELECT doc_id, min(a) AS a, max(b) AS b FROM g GROUP BY doc_id, g)
SELECT doc_id, string_agg(a || '-' || b, ',' ORDER BY a) AS spans FROM r GROUP BY 1""")
def merge_spans(t: Tables) -> DataFrame:
    start = lambda k: (F.col("doc_id") * k % 50).cast("int")
    spans = F.array(*[F.struct(start(k).alias("start"), (start(k) + 9).cast("int").alias("end")) for k in (7, 11, 13)])
    return t.documents.select("doc_id", F.array_join(F.transform(chunks.merge_spans(spans), lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",").alias("spans"))


@query("""SELECT user_id, event_id, (i - 1)::BIGINT AS index, k::VARCHAR AS element FROM (SELECT user_id, event_id, (props::JSON->>'k')::INT AS k FROM events), (SELECT unnest([1, 2]) AS i) WHERE (i = 1 OR i = 2)""")
def json_array_chunks(t: Tables) -> DataFrame:
    """Props wrapped as {"data": {"items": [k, k]}}: split at the array found under `data`."""
    k = F.get_json_object("props", "$.k")
    wrapped = F.try_parse_json(F.concat(F.lit('{"results": [], "data": {"items": ['), k, F.lit(","), k, F.lit("]}}")))
    return t.events.select("user_id", "event_id", F.posexplode(chunks.json_elements(wrapped)).alias("index", "element")).withColumn("index", F.col("index").cast("long"))


@query("SELECT event_id, (props::JSON->>'k')::BIGINT AS k, coalesce((props::JSON->>'k')::BIGINT, 0) AS input, json_type(props::JSON) = 'OBJECT' AS is_object FROM events")
def props_projection(t: Tables) -> DataFrame:
    v = F.try_parse_json("props")
    return t.events.select("event_id", F.try_variant_get(v, "$.k", "long").alias("k"), F.coalesce(F.try_variant_get(v, "$.k", "long"), F.lit(0)).alias("input"), F.startswith(F.schema_of_variant(v), F.lit("OBJECT")).alias("is_object"))


DECIDED = """(SELECT d.doc_id, d.source, d.doc_id % 5 AS created, d.doc_id % 4 = 0 AS is_user, length(d.source) % 2 = 1 AS routed_new, d.n_chars % 3 > 0 AS old, coalesce(l.quality = 0, false) AS drop,
CASE WHEN l.quality = 0 THEN CASE l.doc_id % 3 WHEN 0 THEN 'clearly_unrelated_to_current_work' WHEN 1 THEN 'old_task_after_confirmed_task_switch' ELSE 'because' END END AS reason FROM documents d LEFT JOIN labels l USING (doc_id))"""
ACCEPTED = "(drop AND coalesce(reason IN ('exact_duplicate', 'clearly_unrelated_to_current_work') OR reason = 'old_task_after_confirmed_task_switch' AND routed_new AND old AND created < 3, false))"


def _decided(t: Tables) -> DataFrame:
    """Labels of low quality as drop decisions, with three reasons, one unknown; sources with names of odd length begin a new task, two of three documents are an old one's."""
    reason = F.when(F.col("doc_id") % 3 == 0, decisions.UNRELATED).when(F.col("doc_id") % 3 == 1, decisions.OLD_TASK).otherwise("because")
    low = t.labels.where("quality = 0").select("doc_id", F.lit(True).alias("drop"), reason.alias("reason"))
    pieces = t.documents.select("doc_id", "source", (F.col("doc_id") % 5).alias("created"), (F.col("doc_id") % 4 == 0).alias("is_user"), (F.length("source") % 2 == 1).alias("routed_new"), (F.col("n_chars") % 3 > 0).alias("old"))
    return decisions.with_overrides(pieces, low, ["doc_id"])


@query(f"SELECT doc_id, drop, reason FROM {DECIDED}")
def decision_overrides(t: Tables) -> DataFrame:
    return _decided(t).select("doc_id", "drop", "reason")


def _accepted(t: Tables) -> DataFrame:
    ok = decisions.accepted(F.col("drop"), F.col("reason"), F.col("routed_new"), F.col("old"), F.col("created"), F.lit(3))
    return _decided(t).withColumn("accepted", ok)


@query(f"SELECT doc_id, reason FROM {DECIDED} WHERE {ACCEPTED}")
def accepted_drops(t: Tables) -> DataFrame:
    return _accepted(t).where("accepted").select("doc_id", "reason")


@query(f"""WITH a AS (SELECT *, doc_id // 4 AS scope, {ACCEPTED} AS ok FROM {DECIDED}),
v AS (SELECT scope, bool_or(is_user) AS had, bool_or(is_user AND NOT ok) AS has FROM a GROUP BY 1)
SELECT doc_id, ok AND NOT (had AND NOT has AND coalesce(reason = 'clearly_unrelated_to_current_work', true)) AS dropped FROM a JOIN v USING (scope)""")
def sanity_guard(t: Tables) -> DataFrame:
    """Four documents a scope, the first of each a user's."""
    p = _accepted(t).withColumn("scope", F.floor(F.col("doc_id") / 4)).withColumn("kind", F.when(F.col("is_user"), "user").otherwise("assistant"))
    return decisions.sanity_guard(p, ["scope"], "kind", "accepted", "reason").select("doc_id", "dropped")


@query("SELECT doc_id, 'unknown' AS problem FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 2 = 0) UNION ALL SELECT doc_id, 'repeated' FROM labels GROUP BY 1 HAVING count(*) > 1")
def invalid_decisions(t: Tables) -> DataFrame:
    return decisions.invalid_decisions(t.labels.select("doc_id"), t.documents.where("doc_id % 2 = 0"), ["doc_id"])


@query(f"SELECT l.doc_id, piece_id, (\"end\" - \"start\")::BIGINT AS chars, content_hash FROM (SELECT * FROM {LINE_CHUNKS}) l")
def materialize_pieces(t: Tables) -> DataFrame:
    """Piece descriptors joined with archived texts."""
    p = chunks.explode_pieces(_lines(t), "doc_id", "text", F.col("spans")).select("doc_id", "piece_id", "start", "end")
    m = archive.materialize_pieces(p, t.documents, ["doc_id"], "text", "start", "end")
    return m.select("doc_id", "piece_id", F.length("content").cast("long").alias("chars"), T.short_hash("content", 20).alias("content_hash"))


@query("SELECT doc_id, count(*) AS pieces, max(\"end\" - \"start\")::BIGINT AS longest FROM (SELECT * FROM " + LINE_CHUNKS + ") GROUP BY 1")
def chunk_telemetry(t: Tables) -> DataFrame:
    p = chunks.explode_pieces(_lines(t), "doc_id", "text", F.col("spans"))
    return p.groupBy("doc_id").agg(F.count("*").alias("pieces"), F.max(F.col("end") - F.col("start")).cast("long").alias("longest"))


VALUE = "(floor(value * 100))::BIGINT"


def _usage(t: Tables) -> DataFrame:
    return t.events.select("user_id", "event_type", "ts", "event_id", F.floor(F.col("value") * 100).cast("long").alias("units"))


@query(f"SELECT user_id, event_type, count(*) AS calls, sum({VALUE})::BIGINT AS total FROM events GROUP BY ROLLUP (user_id, event_type) HAVING user_id IS NOT NULL")
def usage_by_class(t: Tables) -> DataFrame:
    return metrics.usage_rollup(_usage(t), "user_id", "event_type", "units")


@query(f"SELECT event_id, user_id, count(*) OVER w AS calls, sum({VALUE}) OVER w::BIGINT AS running FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def running_usage(t: Tables) -> DataFrame:
    return metrics.running_totals(_usage(t), "user_id", ["ts", "event_id"], "units").select("event_id", "user_id", "calls", "running")


@query(f"SELECT user_id, min({VALUE}) AS units_min, floor(avg({VALUE}) + 0.5)::BIGINT AS units_avg, max({VALUE}) AS units_max, sum({VALUE})::BIGINT AS units_total FROM events GROUP BY 1")
def usage_series(t: Tables) -> DataFrame:
    return _usage(t).groupBy("user_id").agg(*metrics.series("units", "units"))


@query(f"SELECT user_id, date_part('day', ts)::BIGINT AS round, max({VALUE}) AS input, sum({VALUE})::BIGINT AS output, max(CASE WHEN event_type = 'view' THEN {VALUE} END) AS cached FROM events GROUP BY 1, 2")
def recorded_usage(t: Tables) -> DataFrame:
    u = _usage(t).select("user_id", F.dayofmonth("ts").cast("long").alias("round"), F.col("units").alias("input"), F.col("units").alias("output"), F.when(F.col("event_type") == "view", F.col("units")).alias("cached"))
    return metrics.recorded_usage(u, "user_id")


@query(f"SELECT user_id, m.main, coalesce(s.side, 0)::BIGINT AS side, (m.main + coalesce(s.side, 0))::BIGINT AS all_in FROM (SELECT user_id, sum({VALUE})::BIGINT AS main FROM events WHERE event_type <> 'error' GROUP BY 1) m LEFT JOIN (SELECT user_id, sum({VALUE})::BIGINT AS side FROM events WHERE event_type = 'error' GROUP BY 1) s USING (user_id)")
def all_in_usage(t: Tables) -> DataFrame:
    """One pass: both sums are conditional aggregates of the same groups."""
    side = F.col("event_type") == "error"
    out = _usage(t).groupBy("user_id").agg(F.sum(F.when(~side, F.col("units"))).alias("main"), F.coalesce(F.sum(F.when(side, F.col("units"))), F.lit(0)).alias("side"))
    return out.where("main is not null").withColumn("all_in", F.col("main") + F.col("side"))


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, array_to_string(list_sort(list(event_id ORDER BY event_id)[1:10]), ',') AS first_ten FROM events GROUP BY 1")
def status_counts(t: Tables) -> DataFrame:
    """The first ten ids of each status come from a ranked top-k, not from a list of them all."""
    from pyspark.sql import Window

    n = t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))
    rank = F.row_number().over(Window.partitionBy("event_type").orderBy("event_id"))
    ten = t.events.select("event_type", "event_id").withColumn("_r", rank).where("_r <= 10").groupBy("event_type").agg(F.array_sort(F.collect_list("event_id")).alias("ids"))
    return n.join(ten, "event_type").select("event_type", "n", "users", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("first_ten"))


TURNS = """(SELECT user_id, event_type, event_id, ts, dense_rank() OVER (PARTITION BY user_id ORDER BY n) AS turn FROM (SELECT *, max(ends) OVER (PARTITION BY user_id, n) AS done FROM (
SELECT * FROM (SELECT *, sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id, n ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS ends FROM (
SELECT *, sum((event_type = 'signup')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM events) WHERE n > 0) WHERE ends = 0 OR ends = 1 AND event_type = 'purchase')) WHERE done = 1)"""


def _turns(t: Tables) -> DataFrame:
    return turns.observed_turns(t.events.select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"], F.col("event_type") == "signup", F.col("event_type") == "purchase")


@query(f"SELECT user_id, turn, count(*) AS events, count(*) FILTER (event_type = 'click') AS clicks, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds FROM {TURNS} GROUP BY 1, 2")
def observed_turn_summary(t: Tables) -> DataFrame:
    return _turns(t).groupBy("user_id", "turn").agg(
        F.count("*").alias("events"), F.sum((F.col("event_type") == "click").cast("long")).alias("clicks"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds")
    )


@query("SELECT source, count(*) AS docs, avg((n_chars > 2000)::INT)::DOUBLE AS long_rate, count(*) FILTER (length(trim(text)) > 0)::DOUBLE / count(*) AS filled_rate FROM documents GROUP BY 1")
def comparison_rates(t: Tables) -> DataFrame:
    return t.documents.groupBy("source").agg(F.count("*").alias("docs"), F.avg((F.col("n_chars") > 2000).cast("int")).alias("long_rate"), (F.sum((F.length(F.trim("text")) > 0).cast("long")) / F.count("*")).alias("filled_rate"))


@query("SELECT event_id, status, coalesce(status IN (408, 409, 425, 429) OR status >= 500, false) AS retry FROM (SELECT event_id, 400 + event_id % 120 AS status FROM events)")
def retryable_status(t: Tables) -> DataFrame:
    e = t.events.select("event_id", (400 + F.col("event_id") % 120).alias("status"))
    return e.withColumn("retry", predicates.retryable(F.col("status")))


@query("SELECT event_id, CASE WHEN event_type = 'click' THEN CASE WHEN n <= 1043480 THEN 'large' END WHEN n <= 395904 THEN 'small' WHEN n <= 1043480 THEN 'large' END AS model FROM (SELECT *, event_id * 150 AS n FROM events)")
def model_choice(t: Tables) -> DataFrame:
    purpose = F.when(F.col("event_type") == "click", "source_chunk_batch").otherwise("piece_drop_batch")
    return t.events.select("event_id", predicates.model_for(purpose, F.col("event_id") * 150).alias("model"))


@query("""SELECT event_id, CASE WHEN event_type = 'view' THEN 'new_task' WHEN event_type = 'click' AND event_id % 3 - 2 < 0 THEN 'revive_task' ELSE 'same_task' END AS kind,
CASE WHEN event_type = 'click' AND event_id % 3 - 2 < 0 THEN (event_id % 3 - 2)::INT END AS index FROM events""")
def coerced_routes(t: Tables) -> DataFrame:
    kind = F.when(F.col("event_type") == "view", "new_task").when(F.col("event_type") == "click", "revive_task").otherwise(F.col("event_type"))
    return t.events.select("event_id", predicates.coerced_route(kind, F.col("event_id") % 3 - 2).alias("r")).select("event_id", "r.kind", "r.index")


@query("SELECT d.doc_id, l.quality, CASE WHEN l.doc_id IS NULL THEN 'missing_from_response' ELSE 'answered' END AS status FROM documents d LEFT JOIN labels l USING (doc_id)")
def chunk_result_defaults(t: Tables) -> DataFrame:
    return predicates.with_missing(t.documents.select("doc_id"), t.labels, ["doc_id"], "quality")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unfinished_runs(t: Tables) -> DataFrame:
    return predicates.unfinished(t.documents.select("doc_id"), t.labels, ["doc_id"])


@query("""SELECT a.user_id, a.event_id, b.units FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE event_type = 'click') a
LEFT JOIN (SELECT user_id, floor(value * 100)::BIGINT AS units, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE event_type = 'view') b USING (user_id, n)""")
def positional_usage(t: Tables) -> DataFrame:
    """Clicks stand for assistant messages, views for usage records; they meet by their place."""
    e = _usage(t).select("user_id", "event_id", "event_type", "units")
    return predicates.zipped(e.where("event_type = 'click'").select("user_id", "event_id"), e.where("event_type = 'view'"), "user_id", "event_id", "units")


@query("""SELECT user_id, event_id, coalesce(CASE WHEN event_id % 7 = 0 THEN 'own' END, c.tool) AS tool FROM (SELECT user_id, event_id, event_id % 4 AS call FROM events WHERE event_type = 'purchase') o
LEFT JOIN (SELECT user_id, event_id % 4 AS call, max_by(event_type || event_id, event_id) AS tool FROM events WHERE event_type <> 'purchase' GROUP BY 1, 2) c USING (user_id, call)""")
def tool_names(t: Tables) -> DataFrame:
    """Purchases are outputs, every other event a call; ids modulo four are call ids."""
    out = F.col("event_type") == "purchase"
    name = F.when(~out, F.concat("event_type", F.col("event_id").cast("string"))).when(F.col("event_id") % 7 == 0, "own")
    items = t.events.select("user_id", "event_id", (F.col("event_id") % 4).alias("call"), name.alias("name"), out.alias("is_output"))
    return predicates.named_outputs(items, "user_id", "call", "event_id", "name", "is_output").select("user_id", "event_id", "tool")


@query("SELECT user_id, sum(length(props))::BIGINT AS bytes, count(*) AS calls, count(DISTINCT event_id % 5) AS sources FROM events WHERE event_type = 'error' GROUP BY 1")
def recalled_sources(t: Tables) -> DataFrame:
    e = t.events.where("event_type = 'error'").select("user_id", F.octet_length("props").cast("long").alias("size"), F.array(F.col("event_id") % 5).alias("ids"))
    return logs.recalled(e, "user_id", "ids", "size")


@query("SELECT doc_id, n_chars AS actual, ceil((length(text) + length(source) + 200) / 4.0)::BIGINT AS estimated, n_chars - ceil((length(text) + length(source) + 200) / 4.0)::BIGINT AS delta FROM documents")
def usage_estimates(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", F.col("n_chars").alias("actual"), T.utf16_length("text").alias("a"), T.utf16_length("source").alias("b"))
    return logs.usage_with_estimates(d, "actual", [F.col("a"), F.col("b"), F.lit(200)]).select("doc_id", "actual", "estimated", "delta")


@query("""SELECT user_id, count(*) AS events, min(event_id) AS first_event FROM (SELECT *, max(CASE WHEN event_type = 'signup' THEN event_id END) OVER (PARTITION BY user_id) AS l FROM events) WHERE event_id >= l GROUP BY 1""")
def latest_batch(t: Tables) -> DataFrame:
    e = logs.latest_batch(t.events.select("user_id", "event_id", "event_type"), "user_id", "event_id", F.col("event_type") == "signup")
    return e.groupBy("user_id").agg(F.count("*").alias("events"), F.min("event_id").alias("first_event"))


@query(f"SELECT user_id, turn, count(*) AS events, arg_min(event_id, (ts, event_id)) AS first_event, arg_max(event_id, (ts, event_id)) AS last_event FROM {TURNS} GROUP BY 1, 2")
def observed_turns_stream(t: Tables) -> DataFrame:
    """The turns of `observed_turn_summary` as a stream over the events' files; its SQL is the batch version."""
    live = t.spark.readStream.schema(t.events.schema).parquet(f"{t.sf_dir}/events.parquet*")
    return observed.run_available(observed.observed_turns_stream(live, F.col("event_type") == "signup", F.col("event_type") == "purchase"), "turns")


@query("""SELECT source, '- ' || source || ': ' || count(*) || ' documents, ' || sum(n_chars) || ' characters, longest ' || max(n_chars) AS line FROM documents GROUP BY 1""")
def report_lines(t: Tables) -> DataFrame:
    n = t.documents.groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("c"), F.max("n_chars").alias("m"))
    return n.select("source", render.report_line(F.col("source"), {"documents": F.col("n"), "characters": F.col("c")}, F.col("m")).alias("line"))
