"""Queries over conversations: rounds, context size, prompts, working sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import archive, decisions, fold, metrics, render, rounds
from .registry import Tables, query

#: Whether a row of conversations is a user's prompt, in SQL.
IS_USER = "(role = 'user' AND length(trim(text)) > 0 AND NOT starts_with(text, '<environment_context>') AND NOT starts_with(text, '<turn_aborted>') AND NOT starts_with(trim(text), '<user_interrupt>'))"
ROUNDS = f"(SELECT *, sum(CASE WHEN {IS_USER} THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS round FROM conversations)"
BASELINE = f"""(SELECT conv_id, round, turn, items, ceil((44 + chars + items - 1) / 4.0)::BIGINT AS tokens FROM (
  SELECT *, count(*) OVER w AS items, sum(length(to_json(text)::VARCHAR) + length(role) + 70) OVER w AS chars FROM {ROUNDS} WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)) WHERE {IS_USER})"""


def user() -> Column:
    return rounds.is_user_prompt(F.col("role"), F.col("text"))


def in_rounds(t: Tables) -> DataFrame:
    return rounds.segment_rounds(t.conversations, "conv_id", "turn", user())


def baseline(t: Tables) -> DataFrame:
    return rounds.baseline_tokens(t.conversations, "conv_id", "turn", "role", "text", user())


@query(f"SELECT conv_id, round, count(*) AS items, min(turn) AS first_turn, max(turn) AS last_turn FROM {ROUNDS} GROUP BY 1, 2")
def round_segmentation(t: Tables) -> DataFrame:
    return in_rounds(t).groupBy("conv_id", "round").agg(F.count("*").alias("items"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"))


@query(f"SELECT * FROM {BASELINE}")
def turn_baseline_tokens(t: Tables) -> DataFrame:
    return baseline(t)


@query(f"SELECT conv_id, count(*) AS rounds, min(tokens) AS tokens_min, floor(avg(tokens) + 0.5)::BIGINT AS tokens_avg, max(tokens) AS tokens_max, sum(tokens)::BIGINT AS tokens_total FROM {BASELINE} GROUP BY 1")
def session_context_stats(t: Tables) -> DataFrame:
    return baseline(t).groupBy("conv_id").agg(F.count("*").alias("rounds"), *metrics.series("tokens", "tokens"))


@query("SELECT conv_id, turn, role FROM (SELECT *, bool_and(role = 'system') OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS a FROM conversations) WHERE a")
def leading_instructions(t: Tables) -> DataFrame:
    return rounds.leading_instructions(t.conversations.select("conv_id", "turn", "role"), "conv_id", "turn", F.col("role") == "system")


@query("SELECT conv_id, turn, role FROM (SELECT *, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id) AS l FROM conversations) WHERE l IS NULL OR turn >= l")
def current_round_tail(t: Tables) -> DataFrame:
    return rounds.current_round_tail(t.conversations.select("conv_id", "turn", "role"), "conv_id", "turn", F.col("role") == "user")


@query("""SELECT conv_id, turn, bool_and(role = 'system') OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) OR l IS NULL OR turn >= l AS kept
FROM (SELECT *, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id) AS l FROM conversations)""")
def derived_prompt_items(t: Tables) -> DataFrame:
    return rounds.derived_prompt(t.conversations.select("conv_id", "turn", "role"), "conv_id", "turn", F.col("role") == "system", F.col("role") == "user").select("conv_id", "turn", "kept")


@query("""SELECT conv_id, turn, epoch, sum(length(text)) OVER (PARTITION BY conv_id, epoch ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS chars FROM (
SELECT *, sum(CASE WHEN role = 'assistant' AND turn % 3 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS epoch FROM conversations)""")
def compaction_epochs(t: Tables) -> DataFrame:
    """Every assistant message at a third turn stands for a compaction."""
    from pyspark.sql import Window

    e = rounds.compaction_epochs(t.conversations, "conv_id", "turn", (F.col("role") == "assistant") & (F.col("turn") % 3 == 0))
    w = Window.partitionBy("conv_id", "epoch").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return e.select("conv_id", "turn", "epoch", F.sum(F.length("text")).over(w).alias("chars"))


@query("SELECT conv_id, role, count(*) AS items FROM conversations GROUP BY 1, 2")
def item_type_counts(t: Tables) -> DataFrame:
    return t.conversations.groupBy("conv_id", "role").agg(F.count("*").alias("items"))


@query("SELECT conv_id, count(*) AS items, count(*) FILTER (role = 'user') AS user_items, count(*) FILTER (role = 'system') AS instruction_items, sum(strlen(text))::BIGINT AS bytes, ceil(sum(length(text)) / 4.0)::BIGINT AS tokens FROM conversations GROUP BY 1")
def request_metrics(t: Tables) -> DataFrame:
    role = lambda r: F.sum((F.col("role") == r).cast("long"))
    return t.conversations.groupBy("conv_id").agg(
        F.count("*").alias("items"), role("user").alias("user_items"), role("system").alias("instruction_items"), F.sum(T.byte_size("text")).alias("bytes"), F.ceil(F.sum(T.utf16_length("text")) / 4).cast("long").alias("tokens")
    )


TITLE = r"trim(regexp_replace(([x FOR x IN string_split_regex(text, '\r?\n') IF length(trim(x)) > 0])[1], '\s+', ' ', 'g'))"


@query(f"SELECT conv_id, CASE WHEN length(x) > 120 THEN substr(x, 1, 117) || '...' ELSE x END AS title FROM (SELECT conv_id, {TITLE} AS x FROM (SELECT conv_id, min_by(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY 1))")
def task_titles(t: Tables) -> DataFrame:
    first = t.conversations.where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    return first.select("conv_id", T.title("text").alias("title"))


def _pieces(t: Tables) -> DataFrame:
    """Every message as one whole piece of its round."""
    p = in_rounds(t).where("round > 0").withColumn("id", F.concat(F.lit("m"), F.lpad(F.col("turn").cast("string"), 6, "0")))
    kind = F.when(F.col("role") == "user", "user").otherwise("assistant")
    return p.select("conv_id", "round", F.col("turn").alias("place"), "id", F.col("id").alias("source"), kind.alias("kind"), T.byte_size("text").alias("size"), T.short_hash("text", 20).alias("hash"), (F.length("text") + 30).alias("chars"), "text")


def _replay(t: Tables, name: str) -> DataFrame:
    return fold.replay(_pieces(t), name, "conv_id", with_state=False).drop("task", "before_pieces", "before_chars", "added", "removed", "archived", "state")


PIECES = f"(SELECT conv_id, round, turn AS place, CASE WHEN role = 'user' THEN 'user' ELSE 'assistant' END AS kind, strlen(text) AS size, text FROM {ROUNDS} WHERE round > 0)"


def _closed_form(kept: str) -> str:
    """Working set after each round when nothing repeats: pieces so far that the policy keeps."""
    return f"""WITH p AS (SELECT conv_id, round, count(*) AS n, count(*) FILTER ({kept}) AS k, sum(CASE WHEN {kept} THEN size ELSE 0 END) AS b FROM {PIECES} WHERE size > 0 GROUP BY 1, 2)
SELECT conv_id, round, CASE WHEN round = 1 THEN 'new' ELSE 'same' END AS route, sum(k) OVER w::BIGINT AS pieces, sum(b) OVER w::BIGINT AS bytes, (n - k)::BIGINT AS dropped, 0::BIGINT AS guarded, 0::BIGINT AS duplicates,
sum(n) OVER w::BIGINT AS processed, (sum(n) OVER w - sum(k) OVER w)::BIGINT AS recallable FROM p WINDOW w AS (PARTITION BY conv_id ORDER BY round ROWS UNBOUNDED PRECEDING)"""


@query(_closed_form("kind = 'user'"))
def working_set_drop_tools(t: Tables) -> DataFrame:
    return _replay(t, "drop-tools")


@query(_closed_form("true"))
def working_set_retain_all(t: Tables) -> DataFrame:
    return _replay(t, "retain-all")


#: Every round starts with a user's message and has fewer than twelve, so that the guard never undoes these drops.
RECENT = f"""WITH p AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY place ROWS 11 PRECEDING) AS last12 FROM {PIECES} WHERE size > 0),
r AS (SELECT conv_id, round, count(*) AS n, max_by(last12, place) AS b FROM p GROUP BY 1, 2), c AS (SELECT *, sum(n) OVER w AS upto FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY round ROWS UNBOUNDED PRECEDING))
SELECT conv_id, round, CASE WHEN round = 1 THEN 'new' ELSE 'same' END AS route, least(12, upto)::BIGINT AS pieces, b::BIGINT AS bytes, (least(12, upto - n) + n - least(12, upto))::BIGINT AS dropped, 0::BIGINT AS guarded, 0::BIGINT AS duplicates,
upto::BIGINT AS processed, (upto - least(12, upto))::BIGINT AS recallable FROM c"""


@query(RECENT)
def working_set_retain_recent(t: Tables) -> DataFrame:
    return _replay(t, "retain-recent")


@query(_closed_form("true").replace("0::BIGINT AS guarded", "sum(n) OVER w::BIGINT AS guarded"))
def working_set_keep_none(t: Tables) -> DataFrame:
    return _replay(t, "keep-none")


@query(_closed_form("true"))
def working_set_cap_bytes(t: Tables) -> DataFrame:
    """No session of the fixture comes near the 32 KiB, so nothing goes; `cap_bytes` meets its budget."""
    return _replay(t, "cap-bytes")


# The rewritten request of a round: leading instructions, the memory block (earlier user pieces) and the current round.
REWRITTEN = f"""(SELECT b.conv_id, b.round, b.tokens AS baseline, ceil((44 + coalesce(i.chars, 0) + 90 + coalesce(m.chars, 0) + u.chars) / 4.0)::BIGINT AS rewritten FROM {BASELINE} b
JOIN (SELECT conv_id, round, sum(CASE WHEN {IS_USER} THEN length(to_json(text)::VARCHAR) + length(role) + 71 END) AS chars FROM {ROUNDS} GROUP BY 1, 2) u USING (conv_id, round)
LEFT JOIN (SELECT conv_id, sum(length(to_json(text)::VARCHAR) + length(role) + 71) AS chars FROM {ROUNDS} WHERE round = 0 GROUP BY 1) i USING (conv_id)
LEFT JOIN (SELECT conv_id, round, sum(c) OVER (PARTITION BY conv_id ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS chars FROM (SELECT conv_id, round, sum(CASE WHEN {IS_USER} THEN length(text) + 30 ELSE 0 END) AS c FROM {ROUNDS} WHERE round > 0 GROUP BY 1, 2)) m USING (conv_id, round))"""


def turn_context(t: Tables) -> DataFrame:
    """(conv_id, round, baseline, rewritten) under drop-tools: what is sent at each round's start. The memory in it is what
    the fold's rounds before left."""
    size = T.json_length("text") + F.length("role") + rounds.MESSAGE_CHARS + 1
    per = in_rounds(t).groupBy("conv_id", "round").agg(F.sum(F.when(user(), size)).alias("own"), F.sum(F.when(F.col("round") == 0, size)).alias("lead"))
    lead = per.where("round = 0").select("conv_id", F.col("lead").alias("first"))
    held = fold.replay(_pieces(t), "drop-tools", "conv_id").select("conv_id", "round", "before_chars")
    sent = per.where("round > 0").drop("lead").join(held, ["conv_id", "round"], "left").join(lead, "conv_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    sent = sent.select("conv_id", "round", F.ceil((rounds.REQUEST_CHARS + zero("first") + 90 + zero("before_chars") + F.col("own")) / 4).cast("long").alias("rewritten"))
    return baseline(t).select("conv_id", "round", F.col("tokens").alias("baseline")).join(sent, ["conv_id", "round"])


STATS = f"""(SELECT *, baseline_avg - rewritten_avg AS savings_avg, baseline_max - rewritten_max AS savings_max FROM (SELECT conv_id, count(*) AS rounds,
min(baseline) AS baseline_min, floor(avg(baseline) + 0.5)::BIGINT AS baseline_avg, max(baseline) AS baseline_max, sum(baseline)::BIGINT AS baseline_total,
min(rewritten) AS rewritten_min, floor(avg(rewritten) + 0.5)::BIGINT AS rewritten_avg, max(rewritten) AS rewritten_max, sum(rewritten)::BIGINT AS rewritten_total FROM {REWRITTEN} GROUP BY 1))"""


@query(f"SELECT conv_id, round, baseline, rewritten, baseline - rewritten AS savings, round_even(100.0::DOUBLE * (baseline - rewritten) / baseline, 1) AS reduction FROM {REWRITTEN}")
def rewrite_savings(t: Tables) -> DataFrame:
    return turn_context(t).withColumn("savings", F.col("baseline") - F.col("rewritten")).withColumn("reduction", T.percent_reduction(F.col("baseline").cast("double"), F.col("rewritten").cast("double")))


@query(f"SELECT * FROM {STATS}")
def trace_stats(t: Tables) -> DataFrame:
    return metrics.trace_stats(turn_context(t), "conv_id", "baseline", "rewritten")


_MEANS = ", ".join(f"floor(avg({k}_{m}) + 0.5)::BIGINT AS {k}_{m}" for k in ("baseline", "rewritten") for m in ("min", "avg", "max"))


@query(f"""SELECT count(*) AS traces, sum(rounds)::BIGINT AS rounds, {_MEANS}, floor(avg(savings_avg) + 0.5)::BIGINT AS savings_avg, floor(avg(savings_max) + 0.5)::BIGINT AS savings_max,
floor(1000.0::DOUBLE * avg((savings_avg > 0)::INT) + 0.5) / 10 AS savings_avg_positive, floor(1000.0::DOUBLE * avg((savings_max > 0)::INT) + 0.5) / 10 AS savings_max_positive,
floor(100.0::DOUBLE * (avg(baseline_avg) - avg(rewritten_avg)) / avg(baseline_avg) * 10 + 0.5) / 10 AS avg_reduction, floor(100.0::DOUBLE * (avg(baseline_max) - avg(rewritten_max)) / avg(baseline_max) * 10 + 0.5) / 10 AS peak_reduction,
floor(avg(a) * 10 + 0.5) / 10 AS mean_reduction, floor(avg(p) * 10 + 0.5) / 10 AS mean_peak_reduction, floor(median(a) * 10 + 0.5) / 10 AS median_reduction, floor(median(p) * 10 + 0.5) / 10 AS median_peak_reduction
FROM (SELECT *, CASE WHEN baseline_avg > 0 THEN 100.0::DOUBLE * (baseline_avg - rewritten_avg) / baseline_avg END AS a, CASE WHEN baseline_max > 0 THEN 100.0::DOUBLE * (baseline_max - rewritten_max) / baseline_max END AS p FROM {STATS})""")
def corpus_reduction(t: Tables) -> DataFrame:
    return metrics.corpus_reduction(metrics.trace_stats(turn_context(t), "conv_id", "baseline", "rewritten"))


@query(f"SELECT conv_id, count(*) AS turns, min(rewritten) AS least, floor(avg(rewritten) + 0.5)::BIGINT AS mean, median(rewritten)::DOUBLE AS median, max(rewritten) AS most, sum(rewritten)::BIGINT AS total FROM {REWRITTEN} GROUP BY GROUPING SETS ((conv_id), ())")
def pooled_turn_summary(t: Tables) -> DataFrame:
    return metrics.pooled_summary(turn_context(t), "conv_id", "rewritten")


@query(f"""WITH s AS (SELECT conv_id, rounds, baseline_total FROM {STATS}), a AS (SELECT conv_id, 'rounds' AS pick, row_number() OVER (ORDER BY rounds DESC, conv_id) AS place FROM s QUALIFY place <= 10)
SELECT * FROM a UNION ALL SELECT conv_id, 'baseline_total', row_number() OVER (ORDER BY baseline_total DESC, conv_id) AS p FROM s WHERE conv_id NOT IN (SELECT conv_id FROM a) QUALIFY p <= 10""")
def top_sessions(t: Tables) -> DataFrame:
    return metrics.top_two_ways(metrics.trace_stats(turn_context(t), "conv_id", "baseline", "rewritten"), "rounds", "baseline_total", "conv_id")


def _users(t: Tables) -> DataFrame:
    return _pieces(t).where("kind = 'user'")


GAP = f"(SELECT conv_id, place, size FROM {PIECES} WHERE kind <> 'user')"


@query(f"SELECT conv_id, count(*) AS archived, sum(size)::BIGINT AS bytes FROM {GAP} GROUP BY 1")
def archive_gap(t: Tables) -> DataFrame:
    p = _pieces(t).select("conv_id", "id", "size")
    gap = archive.archive_gap(p, _users(t), ["conv_id", "id"])
    return gap.groupBy("conv_id").agg(F.count("*").alias("archived"), F.sum("size").alias("bytes"))


@query(f"SELECT conv_id, turn, rn - 1 AS place, greatest(0, n - 3)::BIGINT AS \"left\" FROM (SELECT conv_id, place AS turn, row_number() OVER (PARTITION BY conv_id ORDER BY place) AS rn, count(*) OVER (PARTITION BY conv_id) AS n FROM {GAP}) WHERE rn BETWEEN 2 AND 3")
def recall_page(t: Tables) -> DataFrame:
    gap = _pieces(t).where("kind <> 'user'").select("conv_id", F.col("place").alias("turn"))
    return archive.page(gap, ["conv_id"], [F.col("turn")], 1, 2)


@query(f"SELECT conv_id, round, rn - 1 AS place, greatest(0, n - 5)::BIGINT AS \"left\" FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY round DESC) AS rn, count(*) OVER (PARTITION BY conv_id) AS n FROM (SELECT DISTINCT conv_id, round FROM {PIECES})) WHERE rn <= 5")
def task_page(t: Tables) -> DataFrame:
    """Each round as an archived task: newest first, five to a page."""
    return archive.page(_pieces(t).select("conv_id", "round").distinct(), ["conv_id"], [F.desc("round")], 0, 5)


def _entries(t: Tables) -> DataFrame:
    p = _users(t)
    return p.select("conv_id", "round", "id", render.piece_entry(F.col("id"), F.col("kind"), F.col("text")).alias("entry"))


ENTRIES = f"(SELECT conv_id, round, 'm' || lpad(place::VARCHAR, 6, '0') AS id, '[piece m' || lpad(place::VARCHAR, 6, '0') || ' user]' || chr(10) || text || chr(10) || '[/piece]' AS entry FROM {PIECES} WHERE kind = 'user')"


@query(f"SELECT * FROM {ENTRIES}")
def prompt_entries(t: Tables) -> DataFrame:
    return _entries(t)


@query(f"SELECT conv_id, '[memory]' || chr(10) || string_agg(entry, chr(10) ORDER BY round, id) || chr(10) || '[/memory]' AS text FROM {ENTRIES} GROUP BY 1")
def prompt_memory_text(t: Tables) -> DataFrame:
    return render.memory_text(_entries(t), "conv_id", ["round", "id"], "entry")


@query(f"SELECT conv_id, place, size, row_number() OVER (PARTITION BY conv_id ORDER BY place DESC) <= 2 AS kept FROM {PIECES}")
def retain_recent(t: Tables) -> DataFrame:
    return decisions.retain_recent(_pieces(t).select("conv_id", "place", "size"), ["conv_id"], [F.desc("place")], 2)


@query(f"""WITH RECURSIVE p AS (SELECT conv_id, place, size, row_number() OVER (PARTITION BY conv_id ORDER BY place DESC) AS rn FROM {PIECES}),
g AS (SELECT conv_id, place, size, rn, size <= 400 AS kept, CASE WHEN size <= 400 THEN size ELSE 0 END AS used FROM p WHERE rn = 1
UNION ALL SELECT p.conv_id, p.place, p.size, p.rn, g.used + p.size <= 400, CASE WHEN g.used + p.size <= 400 THEN g.used + p.size ELSE g.used END FROM g JOIN p ON p.conv_id = g.conv_id AND p.rn = g.rn + 1)
SELECT conv_id, place, size, kept FROM g""")
def cap_bytes(t: Tables) -> DataFrame:
    """A budget of 400 bytes, so that the fixture's short messages meet it."""
    return decisions.cap_bytes(_pieces(t), ["conv_id"], ["place"], "size", "place", 400)


@query("""WITH k AS (SELECT conv_id, turn, role, text, bool_and(role = 'system') OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS lead, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id) AS l FROM conversations),
r AS (SELECT conv_id, CASE WHEN role = 'system' THEN 0 ELSE 2 END AS part, turn AS pos, role, text FROM k WHERE lead OR l IS NULL OR turn >= l UNION ALL SELECT DISTINCT conv_id, 1, 0, 'developer', '[memory] of ' || conv_id FROM conversations)
SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY part, pos, role, text) - 1)::INT AS place, role, text FROM r""")
def rewritten_requests(t: Tables) -> DataFrame:
    from ..operators import prompt

    memory = t.conversations.select("conv_id").distinct().withColumn("text", F.concat(F.lit("[memory] of "), F.col("conv_id").cast("string")))
    return prompt.rewritten(t.conversations, memory, "conv_id", "turn", "role", "text")


@query(f"SELECT conv_id, CASE WHEN g > 0 THEN 'shell,recall' ELSE 'shell' END AS tools FROM (SELECT conv_id, count(*) FILTER (kind <> 'user') AS g FROM {PIECES} GROUP BY 1)")
def recall_tools(t: Tables) -> DataFrame:
    from ..operators import prompt

    gap = _pieces(t).groupBy("conv_id").agg(F.sum((F.col("kind") != "user").cast("long")).alias("g"))
    return gap.select("conv_id", F.array_join(prompt.with_recall_tool(F.array(F.lit("shell")), F.col("g")), ",").alias("tools"))
