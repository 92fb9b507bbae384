"""Replays under several policies with compactions, and the reports and counts around them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import fold, metrics, predicates, render, rounds, turns
from ..sources import store
from .conversations import PIECES, _pieces, user
from .logs import _folder, _json
from .registry import Tables, query
from .state import COMPACTED

POLICIES = ["drop-tools", "retain-all", "retain-recent"]


@query(f"""WITH b AS ({COMPACTED}), p AS (SELECT conv_id, round, place, kind, length(text) + 30 AS chars, row_number() OVER (PARTITION BY conv_id ORDER BY place DESC) AS last FROM {PIECES}),
h AS (SELECT b.conv_id, b.round, b.compactions, b.tokens, q.policy, coalesce(sum(CASE WHEN q.policy = 'drop-tools' AND kind <> 'user' THEN 0 WHEN q.policy = 'retain-recent' AND (SELECT count(*) FROM p n WHERE n.conv_id = p.conv_id AND n.round < b.round AND n.place > p.place) >= 12 THEN 0 ELSE chars END), 0)::BIGINT AS held
  FROM b, (SELECT unnest(['drop-tools', 'retain-all', 'retain-recent']) AS policy) q LEFT JOIN p ON p.conv_id = b.conv_id AND p.round < b.round GROUP BY ALL)
SELECT conv_id, policy, count(*) AS rounds, max(compactions)::BIGINT AS compactions, min(tokens) AS baseline_min, floor(avg(tokens) + 0.5)::BIGINT AS baseline_avg, max(tokens) AS baseline_max, sum(tokens)::BIGINT AS baseline_total,
min(held) AS rewritten_min, floor(avg(held) + 0.5)::BIGINT AS rewritten_avg, max(held) AS rewritten_max, sum(held)::BIGINT AS rewritten_total, floor(avg(tokens) + 0.5)::BIGINT - floor(avg(held) + 0.5)::BIGINT AS savings_avg, max(tokens) - max(held) AS savings_max FROM h GROUP BY 1, 2""")
def replayed_sessions(t: Tables) -> DataFrame:
    """Sessions with compactions replayed under three policies at once: tokens of the compacted history against characters of the memory held."""
    compacted = (F.col("role") == "assistant") & (F.col("turn") % 3 == 0)
    b = rounds.compacted_tokens(t.conversations, "conv_id", "turn", "role", "text", user(), compacted)
    held = fold.replay(_pieces(t), POLICIES, "conv_id").select("conv_id", "round", "policy", F.col("before_chars").alias("held"))
    return metrics.trace_stats(b.join(held, ["conv_id", "round"]), ["conv_id", "policy"], "tokens", "held", "compactions")


@query("""SELECT 'run' || doc_id % 3 AS trace, 'stats' AS kind, count(DISTINCT source)::BIGINT AS rows, sum(n_chars)::BIGINT AS total FROM documents GROUP BY 1
UNION ALL SELECT 'run' || doc_id % 3, 'turns', count(*), sum(doc_id)::BIGINT FROM documents GROUP BY 1 UNION ALL SELECT 'run' || doc_id % 3, 'status', 1, count(*) FROM documents GROUP BY 1""")
def suffix_reports(t: Tables) -> DataFrame:
    """Three runs' statistics, turns and statuses in one folder, each kind read by the end of its name with a schema of its own."""
    path = _folder(t, "suffixes")
    for run in range(3):
        d = t.documents.where(F.col("doc_id") % 3 == run)
        store.write_reports(d.groupBy("source").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars")), path, f"run{run}", ".stats.json")
        store.write_reports(d.select("source", "doc_id", F.col("n_chars").alias("chars")), path, f"run{run}", ".turns.jsonl")
        store.write_reports(d.agg(F.lit(f"run{run}").alias("job"), F.lit("completed").alias("status"), F.count("*").alias("done")), path, f"run{run}", ".status.json")
    read = lambda suffix, kind, c: store.read_reports(t.spark, path, suffix).groupBy("trace").agg(F.lit(kind).alias("kind"), F.count("*").alias("rows"), F.sum(c).alias("total"))
    return read(".stats.json", "stats", "chars").unionByName(read(".turns.jsonl", "turns", "doc_id")).unionByName(read(".status.json", "status", "done"))


@query("SELECT source, count(*) AS docs, sum(n_chars)::BIGINT AS chars, 2::BIGINT AS copies, '- ' || source || ': ' || count(*) || ' documents, longest ' || max(n_chars) AS line FROM documents GROUP BY 1")
def summary_reports(t: Tables) -> DataFrame:
    """A summary as JSON, as CSV and as a text of lines, read back: both tables have the same rows, and the text one line of each."""
    path = _folder(t, "summary")
    n = t.documents.groupBy("source").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"), F.max("n_chars").alias("longest"))
    store.write_report(n, f"{path}/json")
    store.write_report(n, f"{path}/csv", "csv")
    render.report(n.select(render.report_line(F.col("source"), {"documents": F.col("docs")}, F.col("longest")).alias("line")), f"{path}/text", "Sources")
    schema = "source string, docs long, chars long, longest long"
    both = t.spark.read.schema(schema).json(f"{path}/json").unionByName(t.spark.read.schema(schema).option("header", "true").csv(f"{path}/csv"))
    lines = t.spark.read.text(f"{path}/text").where("value like '- %'").select(F.col("value").alias("line"), F.regexp_extract("value", "^- (.*?): ", 1).alias("source"))
    return both.groupBy("source", "docs", "chars").agg(F.count("*").alias("copies")).join(lines, "source")


#: What an event's envelope is, by its type in the table.
ENVELOPE = {"signup": ("event_msg", "task_started"), "purchase": ("event_msg", "task_complete"), "view": ("response_item", "message"), "click": ("response_item", "function_call_output"), "error": ("turn_context", None)}
_ENVELOPES = "(VALUES " + ", ".join(f"('{k}', '{a}', {'NULL' if b is None else repr(b)})" for k, (a, b) in ENVELOPE.items()) + ") m(event_type, envelope, part)"


@query(f"""WITH e AS (SELECT user_id, envelope, part, CASE WHEN user_id % 2 = 0 THEN 'user' ELSE 'assistant' END AS role FROM events JOIN {_ENVELOPES} USING (event_type)),
c AS (SELECT user_id, 'envelope' AS kind, envelope AS name FROM e UNION ALL SELECT user_id, CASE envelope WHEN 'event_msg' THEN 'event' ELSE 'item' END, part FROM e WHERE part IS NOT NULL UNION ALL SELECT user_id, 'role', role FROM e WHERE part = 'message')
SELECT user_id, kind, name, count(*) AS n, (SELECT count(*) FROM e WHERE e.user_id = c.user_id AND part LIKE '%_output') AS results FROM c GROUP BY 1, 2, 3""")
def observed_counts(t: Tables) -> DataFrame:
    """Events as envelopes of logs, counted by envelope, event, item and role, with each thread's tool results."""
    kind = lambda i: F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v[i])) for k, v in ENVELOPE.items()])
    role = F.when(F.col("user_id") % 2 == 0, "user").otherwise("assistant")
    body = _json(type=kind(0), payload=F.struct(kind(1).alias("type"), role.alias("role"), F.col("props").alias("props")))
    counts = turns.turn_counts(t.events.select("user_id", F.parse_json(body).alias("e")), ["user_id"], "e")
    return counts.join(turns.tool_results(counts, ["user_id"]), "user_id")


@query("SELECT doc_id, kind, kind NOT IN ('user', 'tool_call') AND NOT (kind = 'tool' AND lang = 'en') AS chunkable FROM (SELECT *, ['user', 'tool_call', 'tool', 'assistant'][n_chars % 4 + 1] AS kind FROM documents)")
def chunkable_sources(t: Tables) -> DataFrame:
    """Documents as sources of four kinds by their length; English ones are outputs of the engine's own tool."""
    kind = F.get(F.array(*[F.lit(k) for k in ("user", "tool_call", "tool", "assistant")]), (F.col("n_chars") % 4).cast("int"))
    tool = F.when((kind == "tool") & (F.col("lang") == "en"), "recall")
    return t.documents.select("doc_id", kind.alias("kind"), predicates.chunkable(kind, tool).alias("chunkable"))


@query("""SELECT page_id, (page_id % 4 = 0 OR starts_with(body, 'data:') OR starts_with(body, 'event:') OR contains(body, chr(10) || 'data:')) AS stream FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN html WHEN 1 THEN 'data: ' || html ELSE 'id: 1' || chr(10) || 'data: ' || html END AS body FROM pages)""")
def sniffed_streams(t: Tables) -> DataFrame:
    """Pages as bodies of responses: bare, as events, as events after another field; each fourth says so in its type."""
    k = F.col("page_id") % 3
    body = F.when(k == 0, F.col("html")).when(k == 1, F.concat(F.lit("data: "), "html")).otherwise(F.concat(F.lit("id: 1\ndata: "), "html"))
    told = F.when(F.col("page_id") % 4 == 0, "Text/Event-Stream; charset=utf-8").otherwise("text/html")
    return t.pages.select("page_id", predicates.is_event_stream(told, body).alias("stream"))


@query("SELECT source, string_agg(lang, ',' ORDER BY first) AS langs FROM (SELECT source, coalesce(lang, '-') AS lang, min(doc_id) AS first FROM documents GROUP BY 1, 2) GROUP BY 1")
def unique_values(t: Tables) -> DataFrame:
    """The languages of each source in the order in which they first appear, from the first row of each."""
    first = t.documents.groupBy("source", F.coalesce("lang", F.lit("-")).alias("lang")).agg(F.min("doc_id").alias("first"))
    return first.groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "lang"))), lambda x: x["lang"]), ",").alias("langs"))
