"""Queries over sessions' states: versions, archives, routes, the fold, decisions, prompts, and what whole suites add up to."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import archive, decisions, dedupe, fold, metrics, packing, prompt, render, rounds, selectors
from ..sources import commits, store
from .conversations import IS_USER, PIECES, ROUNDS, _pieces, in_rounds, turn_context, user
from .logs import _folder, _json
from .registry import Tables, query


@query(f"SELECT conv_id AS session, max(round) AS round, count(*)::BIGINT AS pieces FROM {PIECES} GROUP BY 1")
def stored_states(t: Tables) -> DataFrame:
    """States written round by round, in two goes; the last version of each session is read."""
    path = _folder(t, "states")
    n = _pieces(t).groupBy(F.col("conv_id").alias("session"), "round").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("session").orderBy("round").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = n.select("session", "round", F.sum("n").over(upto).alias("pieces"))
    store.save_state(s.where("round <= 2"), path)
    store.save_state(s.where("round > 2"), path)
    return store.load_state(t.spark, path).select("session", F.col("round").cast("long").alias("round"), "pieces")


@query(f"SELECT conv_id AS session, max(round) AS round FROM {PIECES} WHERE round <= 2 GROUP BY 1")
def states_at_a_round(t: Tables) -> DataFrame:
    path = _folder(t, "states")
    store.save_state(_pieces(t).select(F.col("conv_id").alias("session"), "round").distinct().withColumn("n", F.lit(1)), path)
    return store.load_state(t.spark, path, at=2).select("session", F.col("round").cast("long").alias("round"))


@query("SELECT doc_id, text FROM documents")
def archived_sources(t: Tables) -> DataFrame:
    """Half of the sources archived, then all with another text: what was there first stays."""
    path = _folder(t, "archive")
    d = t.documents.select("doc_id", "text")
    store.archive(t.spark, d.where("doc_id % 2 = 0"), path, ["doc_id"])
    store.archive(t.spark, d.withColumn("text", F.when(F.col("doc_id") % 2 == 0, "changed").otherwise(F.col("text"))), path, ["doc_id"])
    return commits.read(t.spark, path)


@query("SELECT conv_id, place, turn, text FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) - 1 AS place, turn, text FROM conversations) WHERE turn % 3 <> 1")
def archived_by_request(t: Tables) -> DataFrame:
    """Sources asked in falling order; those of each third turn were never archived."""
    asked = t.conversations.groupBy("conv_id").agg(F.reverse(F.array_sort(F.collect_list(F.col("turn").cast("long")))).alias("ids"))
    there = t.conversations.where("turn % 3 <> 1").select("conv_id", F.col("turn").cast("long").alias("turn"), "text")
    return store.archived(asked, there, "conv_id", "ids", "turn").select("conv_id", F.col("place").cast("long").alias("place"), "turn", "text")


@query("SELECT doc_id FROM documents WHERE doc_id % 10 = 3")
def subset_rows(t: Tables) -> DataFrame:
    """A selection list of which every row is there."""
    wanted = t.documents.where("doc_id % 10 = 3").select("doc_id")
    return store.subset(t.documents.select("doc_id"), wanted, ["doc_id"])


@query("""SELECT source AS session, doc_id // 2 AS piece, 'repeated id' AS problem FROM documents GROUP BY 1, 2 HAVING count(*) > 1
UNION ALL SELECT source, doc_id // 2, 'missing field' FROM documents WHERE doc_id % 5 = 0 UNION ALL SELECT DISTINCT source, -1, 'unknown piece' FROM documents""")
def state_violations(t: Tables) -> DataFrame:
    """Ids of two rows each, blank hashes in each fifth, and a task that names a piece which isn't there."""
    p = t.documents.select(F.col("source").alias("session"), F.floor(F.col("doc_id") / 2).alias("piece"), F.when(F.col("doc_id") % 5 == 0, " ").otherwise("h").alias("hash"))
    tasks = p.select("session").distinct().withColumn("piece", F.lit(-1).cast("long"))
    return store.violations(p, "session", "piece", ["hash"], tasks)


@query("SELECT source AS session, 'p' || doc_id // 3 AS piece, greatest(0, max_by(n, doc_id))::BIGINT AS size, CASE WHEN max(doc_id) % 2 = 0 THEN 'p' || doc_id // 3 ELSE 'h' END AS hash FROM (SELECT *, CASE WHEN doc_id % 7 = 0 THEN -5 ELSE n_chars END AS n FROM documents) GROUP BY 1, doc_id // 3")
def pruned_states(t: Tables) -> DataFrame:
    """Pieces of three rows an id at most, sizes below 0, missing hashes."""
    d = F.col("doc_id")
    p = t.documents.select(F.col("source").alias("session"), F.concat(F.lit("p"), F.floor(d / 3).cast("string")).alias("piece"), d.alias("seq"), F.when(d % 7 == 0, -5).otherwise(F.col("n_chars")).alias("size"), F.when(d % 2 == 1, "h").alias("hash"))
    return store.pruned(p, "session", "piece", "seq").select("session", "piece", "size", "hash")


@query("SELECT doc_id // 2 AS piece, max_by(doc_id, (doc_id % 2, doc_id)) AS doc_id FROM documents GROUP BY 1")
def known_pieces(t: Tables) -> DataFrame:
    """Even documents as active pieces, odd ones as archived ones of the same ids, which come last."""
    d = t.documents.select(F.floor(F.col("doc_id") / 2).alias("piece"), "doc_id")
    return dedupe.all_known(d.where("doc_id % 2 = 0"), d.where("doc_id % 2 = 1"), ["piece"], "doc_id").select("piece", "doc_id")


@query("""SELECT source, coalesce(string_agg(CASE WHEN doc_id % 2 = 0 AND doc_id % 3 > 0 THEN doc_id END, ',' ORDER BY doc_id), '') AS kept_old, coalesce(string_agg(CASE WHEN doc_id % 2 = 0 AND doc_id % 3 = 0 THEN doc_id END, ',' ORDER BY doc_id), '') AS dropped_old,
coalesce(string_agg(CASE WHEN doc_id % 2 = 1 AND doc_id % 3 > 0 THEN doc_id END, ',' ORDER BY doc_id), '') AS kept_new, coalesce(string_agg(CASE WHEN doc_id % 2 = 1 AND doc_id % 3 = 0 THEN doc_id END, ',' ORDER BY doc_id), '') AS dropped_new FROM documents GROUP BY 1""")
def id_changes(t: Tables) -> DataFrame:
    d = t.documents.select("source", "doc_id", (F.col("doc_id") % 2 == 1).alias("is_new"))
    c = dedupe.id_changes(d, d.where("doc_id % 3 > 0"), ["source"], "doc_id", "is_new")
    return c.select("source", *[F.array_join(F.transform(x, lambda i: i.cast("string")), ",").alias(x) for x in ("kept_old", "dropped_old", "kept_new", "dropped_new")])


@query("SELECT doc_id // 2 AS id, min(doc_id) AS doc_id FROM documents WHERE doc_id // 2 % 5 > 0 GROUP BY 1")
def round_sources(t: Tables) -> DataFrame:
    """Sources of requests (even) and answers (odd) with shared ids, of which each fifth was processed before."""
    d = t.documents.select(F.floor(F.col("doc_id") / 2).alias("id"), "doc_id")
    return dedupe.round_sources(d.where("doc_id % 2 = 0"), d.where("doc_id % 2 = 1"), d.select("id").where("id % 5 = 0").distinct(), ["id"])


@query("""SELECT conv_id, turn, bool_and(role = 'system') OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) OR l IS NULL OR turn >= l AS kept
FROM (SELECT *, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id) AS l FROM conversations)""")
def input_refs(t: Tables) -> DataFrame:
    """Kept and dropped items of requests that carry a memory block already, which is neither."""
    block = t.conversations.select("conv_id").distinct().select("conv_id", F.lit(-1).cast("long").alias("turn"), F.lit("developer").alias("role"), F.lit("[memory] old").alias("text"))
    return prompt.input_refs(t.conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(block), "conv_id", "turn", "role", "text")


@query("SELECT conv_id, turn, CASE WHEN turn % 4 < least(n, 3) AND turn % 4 > 0 THEN (list_sort(l))[(n + 1 - turn % 4)::INT] END AS bundle FROM conversations JOIN (SELECT conv_id, count(*) AS n, list(turn) AS l FROM conversations GROUP BY 1) USING (conv_id)")
def relative_tasks(t: Tables) -> DataFrame:
    """Turns as archived tasks, named from the newest: -1, -2, and two indexes that name none."""
    b = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("l"))
    k = F.col("turn") % 4
    at = F.when((k < F.least(F.size("l"), F.lit(3))) & (k > 0), -k).when(k == 0, 0).otherwise(-1000).cast("int")
    return t.conversations.join(b, "conv_id").select("conv_id", "turn", archive.relative_index(F.col("l"), at).alias("bundle"))


#: Documents as pieces, four a round of their source's session: sizes from their lengths, hashes of which many repeat. Every fourth source, by
#: the last letter of its name, is quiet: all of it is the assistant's.
DOC_PIECES = """(SELECT *, kind || n_chars % 13 AS h FROM (SELECT source AS session, r // 4 + 1 AS round, 'm' || lpad(doc_id::VARCHAR, 12, '0') AS id, CASE WHEN ascii(right(source, 1)) % 4 = 0 THEN 'assistant' WHEN r % 4 = 0 THEN 'user' WHEN r % 4 = 1 THEN 'tool' ELSE 'assistant' END AS kind,
1 + n_chars * 7 % 3000 AS size, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS r FROM documents)))"""


def _doc_pieces(t: Tables) -> DataFrame:
    r = F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1
    kind = F.when(F.ascii(F.right("source", F.lit(1))) % 4 == 0, "assistant").when(F.col("r") % 4 == 0, "user").when(F.col("r") % 4 == 1, "tool").otherwise("assistant")
    d = t.documents.select("source", "doc_id", "n_chars").withColumn("r", r).withColumn("kind", kind).withColumn("id", F.concat(F.lit("m"), F.lpad(F.col("doc_id").cast("string"), 12, "0")))
    size = F.lit(1) + F.col("n_chars") * 7 % 3000
    return d.select(F.col("source").alias("session"), (F.floor(F.col("r") / 4) + 1).alias("round"), F.col("doc_id").alias("place"), "id", F.col("id").alias("source"), "kind", size.alias("size"), F.concat("kind", (F.col("n_chars") % 13).cast("string")).alias("hash"), size.alias("chars"))


def _told(pieces: DataFrame) -> DataFrame:
    """Each fifth round begins a new task, each seventh goes back to the last one, each eleventh asks for another page and goes back to the last but one."""
    r = F.col("round")
    return pieces.select("session", "round").distinct().withColumn("told", F.when(r % 5 == 0, "new").when(r % 7 == 0, "revive:-1").when(r % 11 == 0, "more,revive:-2").otherwise("same"))


def _folded(policy: str) -> str:
    """The same round by round in SQL: route, memory of the task gone back to, marks, the policy with its guard, one piece a hash."""
    left = {
        "retain-all": "cand", "drop-tools": "list_filter(cand, lambda x: x.kind = 'user')", "keep-none": "[]::P[]", "retain-recent": "cand[greatest(1, len(cand) - 11):]",
        "cap-bytes": "list_filter(cand, lambda x: list_contains(fit, x.id))", "no-tools": "CASE WHEN len(list_filter(cand, lambda x: x.kind = 'tool')) > 0 THEN cand ELSE list_filter(cand, lambda x: x.kind = 'user') END",
    }[policy]
    fit = "list_reduce(list_transform(list_reverse(cand), lambda x: struct_pack(used := x.size::BIGINT, ids := [x.id])), lambda a, x: CASE WHEN a.used + x.used <= 32768 THEN struct_pack(used := a.used + x.used, ids := list_concat(a.ids, x.ids)) ELSE a END, struct_pack(used := 0::BIGINT, ids := []::VARCHAR[])).ids" if policy == "cap-bytes" else "NULL"
    sql = f"""WITH RECURSIVE n AS (SELECT session, round, list(struct_pack(id := id, kind := kind, size := size::BIGINT, h := h) ORDER BY id) AS new FROM {DOC_PIECES} GROUP BY 1, 2),
f AS (SELECT DISTINCT session, 0::BIGINT AS round, NULL::VARCHAR AS route, NULL::VARCHAR AS task, []::P[] AS pieces, []::STRUCT(task VARCHAR, pieces P[])[] AS arch, ''::VARCHAR AS added, ''::VARCHAR AS removed, 0::BIGINT AS dropped, 0::BIGINT AS guarded, 0::BIGINT AS duplicates, 0::BIGINT AS processed FROM n
UNION ALL SELECT session, round, route, CASE WHEN len(done) > 0 THEN task END, done, arch, array_to_string(list_transform(list_filter(done, lambda x: NOT list_contains(list_transform(was, lambda y: y.id), x.id)), lambda x: x.id), ','),
  array_to_string(list_transform(list_filter(was, lambda x: NOT list_contains(list_transform(done, lambda y: y.id), x.id)), lambda x: x.id), ','), CASE WHEN undo THEN 0 ELSE len(cand) - len(l) END, CASE WHEN undo THEN len(cand) - len(l) ELSE 0 END, gone + len(kept) - len(done), processed + len(new)
FROM (SELECT *, CASE WHEN route <> 'new' THEN kept ELSE list_sort(list_concat(list_filter(kept, lambda x: NOT list_contains(nh, x.h)), list_filter(list_filter(kept, lambda x: list_contains(ni, x.id)), lambda x, i: list_position(nh, x.h) = i))) END AS done
FROM (SELECT *, list_transform(list_filter(kept, lambda x: list_contains(ni, x.id)), lambda x: x.h) AS nh FROM (SELECT *, CASE WHEN undo THEN cand ELSE l END AS kept, list_transform(new, lambda x: x.id) AS ni
FROM (SELECT *, len(list_filter(cand, lambda x: x.kind <> 'assistant')) > 0 AND len(list_filter(l, lambda x: x.kind <> 'assistant')) = 0 AS undo FROM (SELECT *, {left} AS l FROM (SELECT *, {fit} AS fit
FROM (SELECT *, list_concat(base, fresh) AS cand, gone1 + len(new) - len(fresh) AS gone FROM (SELECT *, CASE WHEN route = 'new' THEN new ELSE list_filter(new, lambda x, i: NOT list_contains(list_transform(base, lambda y: y.h), x.h) AND list_position(list_transform(new, lambda y: y.h), x.h) = i) END AS fresh
FROM (SELECT session, round, route, was, new, processed, CASE WHEN k > 0 THEN rev.task WHEN route = 'same' THEN task ELSE 'task_' || round END AS task,
  CASE WHEN route = 'same' THEN old ELSE list_concat(list_filter(old, lambda x, i: k = 0 OR i <> len(old) - k + 1), CASE WHEN len(was) > 0 THEN [struct_pack(task := task, pieces := was)] ELSE []::STRUCT(task VARCHAR, pieces P[])[] END) END AS arch,
  CASE WHEN k > 0 THEN list_sort(list_concat(rev.pieces, list_filter(was, lambda x: NOT list_contains(list_transform(rev.pieces, lambda y: y.h), x.h)))) ELSE was END AS base,
  CASE WHEN k > 0 THEN len(list_distinct(list_transform(list_concat(rev.pieces, was), lambda x: x.id))) - len(list_concat(rev.pieces, list_filter(was, lambda x: NOT list_contains(list_transform(rev.pieces, lambda y: y.h), x.h)))) ELSE 0 END AS gone1
FROM (SELECT *, old[len(old) - k + 1] AS rev, CASE WHEN k > 0 THEN 'revive' WHEN task IS NULL OR told = 'new' THEN 'new' ELSE 'same' END AS route
FROM (SELECT *, CASE WHEN task IS NULL THEN 0 WHEN told = 'revive:-1' AND len(old) > 0 THEN 1 WHEN told = 'more,revive:-2' AND len(old) > 5 THEN 2 ELSE 0 END AS k
FROM (SELECT f.session, n.round, f.task, f.pieces AS was, f.arch AS old, n.new, f.processed, CASE WHEN len(list_filter(n.new, lambda x: x.kind = 'user')) = 0 THEN 'same' WHEN n.round % 5 = 0 THEN 'new' WHEN n.round % 7 = 0 THEN 'revive:-1' WHEN n.round % 11 = 0 THEN 'more,revive:-2' ELSE 'same' END AS told
FROM f JOIN n ON n.session = f.session AND n.round = f.round + 1))))))))))))) 
SELECT session, round, route, task, len(pieces)::BIGINT AS pieces, coalesce(list_sum(list_transform(pieces, lambda x: x.size)), 0)::BIGINT AS bytes, added, removed, dropped::BIGINT AS dropped, guarded::BIGINT AS guarded, duplicates::BIGINT AS duplicates, len(arch)::BIGINT AS archived, processed::BIGINT AS processed, (processed - len(pieces))::BIGINT AS recallable FROM f WHERE round > 0"""
    return sql.replace("P[]", "STRUCT(id VARCHAR, kind VARCHAR, size BIGINT, h VARCHAR)[]")


def _shown(folded: DataFrame) -> DataFrame:
    text = [F.array_join(c, ",").alias(c) for c in ("added", "removed")]
    return folded.select("session", "round", "route", "task", "pieces", "bytes", *text, "dropped", "guarded", "duplicates", "archived", "processed", "recallable")


def _fold(t: Tables, policy: str) -> DataFrame:
    p = _doc_pieces(t)
    return _shown(fold.replay(p, policy, "session", _told(p), with_state=False))


@query(_folded("retain-all"))
def fold_retain_all(t: Tables) -> DataFrame:
    """Sessions in which pieces repeat, tasks change and come back, pages are asked for and indexes name no task."""
    return _fold(t, "retain-all")


@query(_folded("keep-none"))
def fold_keep_none(t: Tables) -> DataFrame:
    """The guard undoes what would leave nothing of a user's or a tool's; where all is the assistant's, the task ends."""
    return _fold(t, "keep-none")


@query(_folded("drop-tools"))
def fold_drop_tools(t: Tables) -> DataFrame:
    return _fold(t, "drop-tools")


@query(_folded("retain-recent"))
def fold_retain_recent(t: Tables) -> DataFrame:
    return _fold(t, "retain-recent")


@query(_folded("cap-bytes"))
def fold_cap_bytes(t: Tables) -> DataFrame:
    """Memories that don't fit into the 32 KiB: newest first, each piece that still fits."""
    return _fold(t, "cap-bytes")


def _no_tools(batch: list[fold.Piece]) -> set[str]:
    if any(p.kind == "tool" for p in batch):
        raise ValueError("no answer")
    return {p.id for p in batch if p.kind == "user"}


@query(_folded("no-tools"))
def fold_failing_policy(t: Tables) -> DataFrame:
    """A policy that gives no answer on batches with a tool's pieces: they are kept whole."""
    fold.POLICIES["no-tools"] = _no_tools
    return _fold(t, "no-tools")


@query(_folded("retain-recent"))
def resumed_fold(t: Tables) -> DataFrame:
    """The same in three goes, each from the states and the archive that the one before committed; one go comes twice and changes nothing."""
    path, p = _folder(t, "resumed"), _doc_pieces(t)
    for batch, rounds_ in enumerate(("round <= 3", "round between 4 and 9", "round between 4 and 9", "round > 9")):
        part = p.where(rounds_)
        fold.finalize(part, "retain-recent", part.select("session", "source"), path, "session", _told(part), ("replay", batch - (batch > 1)))
    return _shown(commits.read(t.spark, f"{path}/state"))


@query("SELECT source AS session, count(*)::BIGINT AS archived, ((count(*) + 3) // 4)::BIGINT AS rounds, 3::BIGINT AS versions FROM documents GROUP BY 1")
def finalized_stream(t: Tables) -> DataFrame:
    """Rounds that end in a stream, a batch a file, its sink called again with the last batch as after a lost driver: archive and states hold each once."""
    path, p = _folder(t, "final-stream"), _doc_pieces(t).withColumn("text", F.col("id"))
    sink, last = fold.finalizing(f"{path}/tables", "drop-tools", "rounds"), []

    def kept(batch: DataFrame, batch_id: int) -> None:
        last.append(batch_id)
        sink(batch, batch_id)

    for part in ("round <= 2", "round between 3 and 6", "round > 6"):
        p.where(part).coalesce(1).write.mode("append").parquet(f"{path}/in")
        live = t.spark.readStream.schema(p.schema).parquet(f"{path}/in")
        q = live.writeStream.foreachBatch(kept).option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()
        q.awaitTermination()
        sink(p.where(part), last[-1])
    archive_ = commits.read(t.spark, f"{path}/tables/archive").groupBy("session").agg(F.count("*").alias("archived"))
    state = commits.read(t.spark, f"{path}/tables/state").groupBy("session").agg(F.count("*").alias("rounds"))
    return archive_.join(state, "session").withColumn("versions", F.lit(len(commits.versions(t.spark, f"{path}/tables/state"))).cast("long"))


#: Limits in tokens of the batches below, and what is fixed: the request, each piece's wrapper.
LIMIT, SINGLE = 10_000, 14_000

#: A session of up to a thousand documents of a source at a time, an element a step: first which user pieces go with every batch, then the batches.
BATCHES = f"""WITH RECURSIVE c AS (SELECT *, max(CASE WHEN kind = 'user' THEN doc_id END) OVER (PARTITION BY session) = doc_id AS latest FROM (SELECT source || '-' || doc_id // 1000 AS session, doc_id, CASE WHEN doc_id % 10 = 0 THEN 'user' ELSE 'tool' END AS kind, n_chars + 160 AS cost, doc_id % 17 > 0 AS rendered FROM documents)),
x AS (SELECT session, 400 + 160 * count(*) + coalesce(sum(cost) FILTER (latest), 0) AS fixed FROM c GROUP BY 1),
u AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY doc_id DESC) AS n FROM c WHERE kind = 'user' AND rendered),
g AS (SELECT session, 0::BIGINT AS n, fixed::BIGINT AS shared, true AS every FROM x
UNION ALL SELECT u.session, u.n, CASE WHEN ceil((shared + cost) / 4.0) <= {LIMIT} THEN shared + cost ELSE shared END, every AND ceil((shared + cost) / 4.0) <= {LIMIT} FROM g JOIN u ON u.session = g.session AND u.n = g.n + 1),
h AS (SELECT session, max_by(shared, n) AS shared, max_by(every, n) AS every FROM g GROUP BY 1),
a AS (SELECT c.session, doc_id, cost, shared, row_number() OVER (PARTITION BY c.session ORDER BY doc_id) AS n FROM c JOIN h USING (session) WHERE rendered AND (every OR kind = 'user') AND ceil((shared + cost) / 4.0) <= {SINGLE}),
b AS (SELECT session, 0::BIGINT AS n, NULL::BIGINT AS doc_id, 0::BIGINT AS batch, 0::BIGINT AS following, false AS open, shared AS chars FROM h
UNION ALL SELECT a.session, a.n, a.doc_id, f + move, CASE WHEN big THEN f + move + 1 ELSE f + move END, NOT big, CASE WHEN big THEN a.shared WHEN over THEN a.shared + a.cost ELSE chars + a.cost END
FROM (SELECT a.*, b.following AS f, b.chars, ceil((a.shared + a.cost) / 4.0) > {LIMIT} AS big, ceil((b.chars + a.cost) / 4.0) > {LIMIT} AS over, CASE WHEN b.open AND (ceil((a.shared + a.cost) / 4.0) > {LIMIT} OR ceil((b.chars + a.cost) / 4.0) > {LIMIT}) THEN 1 ELSE 0 END AS move FROM b JOIN a ON a.session = b.session AND a.n = b.n + 1) a)
SELECT session, doc_id, batch FROM b WHERE n > 0"""


def _batch_pieces(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    p = t.documents.select(F.concat("source", F.lit("-"), F.floor(d / 1000).cast("string")).alias("session"), "doc_id", F.when(d % 10 == 0, "user").otherwise("tool").alias("kind"), F.col("n_chars").alias("size"), (d % 17 > 0).alias("rendered"))
    last = p.where("kind = 'user'").groupBy("session").agg(F.max("doc_id").alias("_last"))
    return p.join(last, "session", "left").withColumn("latest", F.col("doc_id").eqNullSafe(F.col("_last"))).drop("_last")


@query(BATCHES)
def prune_batches(t: Tables) -> DataFrame:
    """Documents of a source in batches of 10,000 tokens; a piece only too large to share goes alone, one too large for any goes nowhere; if
    not all user pieces fit, only those are evaluated; some aren't rendered."""
    return packing.prune_batches(_batch_pieces(t), "session", "doc_id", LIMIT, SINGLE)


@query(f"""WITH r AS (FROM ({BATCHES})), d AS (SELECT source || '-' || doc_id // 1000 AS session, doc_id, n_chars, CASE WHEN doc_id % 10 = 0 THEN 'user' ELSE 'tool' END AS kind FROM documents),
m AS (SELECT session, count(*) AS pieces, sha256('[' || string_agg('{{"id":' || doc_id || ',"kind":"' || kind || '","bytes":' || n_chars || '}}', ',' ORDER BY doc_id) || ']') AS manifest FROM d GROUP BY 1)
SELECT session, batch, string_agg(doc_id, ',' ORDER BY doc_id) AS evaluated, sum(n_chars)::BIGINT AS bytes, any_value(pieces) AS pieces, any_value(manifest) AS manifest FROM r JOIN d USING (session, doc_id) JOIN m USING (session) GROUP BY 1, 2""")
def batch_requests(t: Tables) -> DataFrame:
    """What is asked of each batch, with the manifest of its session's pieces."""
    p = _batch_pieces(t)
    manifests, requests = packing.batch_requests(p, packing.prune_batches(p, "session", "doc_id", LIMIT, SINGLE), "session", "doc_id")
    met = requests.join(manifests.select("session", "pieces", F.sha2("manifest", 256).alias("manifest")), "session")
    return met.select("session", "batch", F.array_join(F.transform("evaluated", lambda x: x.cast("string")), ",").alias("evaluated"), "bytes", "pieces", "manifest")


@query(f"SELECT conv_id, count(DISTINCT round) AS rounds, coalesce(sum(CASE WHEN kind = 'user' THEN size END), 0)::BIGINT AS bytes, count(*) FILTER (kind <> 'user') AS recallable, count(*) AS archived FROM {PIECES} GROUP BY 1")
def finalized_rounds(t: Tables) -> DataFrame:
    """The fold, the archive, the states and their metrics as one stage."""
    path = _folder(t, "final")
    p = _pieces(t)
    fold.finalize(p, "drop-tools", p.select("conv_id", "source", "text"), path, "conv_id")
    kept = commits.read(t.spark, f"{path}/archive").groupBy("conv_id").agg(F.count("*").alias("archived"))
    state = commits.read(t.spark, f"{path}/state").groupBy("conv_id").agg(F.count("*").alias("rounds"), F.max_by("bytes", "round").alias("bytes"), F.max_by("recallable", "round").alias("recallable"))
    return state.join(kept, "conv_id")


@query("""WITH d AS (SELECT *, doc_id % 8 AS k, length(text) AS n FROM documents),
p AS (SELECT doc_id, k, text, CASE k WHEN 0 THEN text WHEN 1 THEN CASE WHEN n = 0 THEN '' ELSE '<segment start=0 end=' || least(n, 5) || '>' || chr(10) || substr(text, 1, 5) || chr(10) || '</segment>' ||
  CASE WHEN n > 8 THEN chr(10) || '<gap omittedChars=3 />' || chr(10) || '<segment start=8 end=' || least(n, 12) || '>' || chr(10) || substr(text, 9, 4) || chr(10) || '</segment>' || CASE WHEN n > 12 THEN chr(10) || '<gap omittedChars=' || (n - 12) || ' />' ELSE '' END WHEN n > 5 THEN chr(10) || '<gap omittedChars=' || (n - 5) || ' />' ELSE '' END END
  WHEN 2 THEN text WHEN 3 THEN source WHEN 4 THEN '{"n":' || n_chars || '}' WHEN 5 THEN n_chars::VARCHAR END AS content FROM d WHERE k < 6)
SELECT doc_id, ['whole', 'chunks', 'object_path', 'object_path', 'object_path', 'object_path'][k + 1] AS kind, sha256(content) AS content, CASE k WHEN 1 THEN strlen(substr(text, 1, 5) || substr(text, 9, 4)) ELSE strlen(content) END::BIGINT AS bytes FROM p""")
def selected_pieces(t: Tables) -> DataFrame:
    """Documents as payloads read back whole, by spans, by paths with keys and indexes, and by two paths that lead nowhere."""
    k = F.col("doc_id") % 8
    arms = [
        '{"kind":"whole"}', '{"kind":"chunks","chunks":[{"start":8,"end":12},{"start":-3,"end":5},{"start":4,"end":6}]}', '{"kind":"object_path","path":["rows",0,"t"]}', '{"kind":"object_path","path":["it\'s","k",0]}',
        '{"kind":"object_path","path":["rows",1]}', '{"kind":"object_path","path":["rows",1,"n"]}', '{"kind":"object_path","path":["rows","t"]}', '{"kind":"object_path","path":["rows",-1]}',
    ]
    t1, t2 = F.to_json(F.struct(F.col("text").alias("t"))), F.to_json(F.struct(F.col("n_chars").alias("n")))
    body = F.concat(F.lit('{"rows":['), t1, F.lit(","), t2, F.lit('],"it\'s":'), F.to_json(F.struct(F.array("source").alias("k"))), F.lit("}"))
    d = t.documents.select("doc_id", F.when(k < 2, F.col("text")).otherwise(body).alias("payload"), F.lit("shell").alias("tool"))
    pieces = t.documents.select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(":0")).alias("piece"), F.parse_json(F.get(F.array(*[F.lit(a) for a in arms]), k.cast("int"))).alias("selector"))
    return selectors.resolved(pieces, d, ["doc_id"], "piece", "selector", "payload", "tool").select("doc_id", "kind", F.sha2("content", 256).alias("content"), "bytes")


@query(f"""WITH g AS (SELECT conv_id, place AS source, row_number() OVER (PARTITION BY conv_id ORDER BY place) - 1 AS at, count(*) OVER (PARTITION BY conv_id) AS n FROM {PIECES} WHERE kind <> 'user'),
c AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS call, length(text) % 4 AS o, length(text) % 3 AS l FROM conversations WHERE role = 'assistant')
SELECT c.conv_id, call, call <= 3 AS allowed, at - o AS place, source, CASE WHEN call <= 3 THEN greatest(0, coalesce((SELECT max(n) FROM g WHERE g.conv_id = c.conv_id), 0) - o - l) END::BIGINT AS "left" FROM c LEFT JOIN g ON g.conv_id = c.conv_id AND call <= 3 AND at >= o AND at < o + l""")
def recall_loops(t: Tables) -> DataFrame:
    """Every answer of the assistant's calls for a page, by its length: some pages are empty or end beyond the gap, and a session's fourth call is not answered."""
    calls = t.conversations.where("role = 'assistant'").select("conv_id", "turn", (F.length("text") % 4).cast("long").alias("offset"), (F.length("text") % 3).cast("long").alias("limit"))
    gap = _pieces(t).where("kind <> 'user'").select("conv_id", F.col("place").alias("source"))
    return archive.recalls(calls, gap, "conv_id", ["turn"], "source", ["source"])


@query("""WITH d AS (SELECT *, doc_id % 8 AS k, length(text) AS n FROM documents),
p AS (SELECT doc_id, k, text, CASE k WHEN 0 THEN text WHEN 1 THEN CASE WHEN n = 0 THEN '' ELSE '<segment start=0 end=' || least(n, 5) || '>' || chr(10) || substr(text, 1, 5) || chr(10) || '</segment>' ||
  CASE WHEN n > 8 THEN chr(10) || '<gap omittedChars=3 />' || chr(10) || '<segment start=8 end=' || least(n, 12) || '>' || chr(10) || substr(text, 9, 4) || chr(10) || '</segment>' || CASE WHEN n > 12 THEN chr(10) || '<gap omittedChars=' || (n - 12) || ' />' ELSE '' END WHEN n > 5 THEN chr(10) || '<gap omittedChars=' || (n - 5) || ' />' ELSE '' END END
  WHEN 2 THEN text WHEN 3 THEN source WHEN 4 THEN '{"n":' || n_chars || '}' WHEN 5 THEN n_chars::VARCHAR END AS content FROM d WHERE k < 6)
SELECT doc_id, ['whole', 'chunks', 'object_path', 'object_path', 'object_path', 'object_path'][k + 1] AS kind, sha256(content) AS content, CASE k WHEN 1 THEN strlen(substr(text, 1, 5) || substr(text, 9, 4)) ELSE strlen(content) END::BIGINT AS bytes FROM p""")
def selected_pieces(t: Tables) -> DataFrame:
    """Documents as payloads read back whole, by spans, by paths with keys and indexes, and by two paths that lead nowhere."""
    k = F.col("doc_id") % 8
    arms = [
        '{"kind":"whole"}', '{"kind":"chunks","chunks":[{"start":8,"end":12},{"start":-3,"end":5},{"start":4,"end":6}]}', '{"kind":"object_path","path":["rows",0,"t"]}', '{"kind":"object_path","path":["it\'s","k",0]}',
        '{"kind":"object_path","path":["rows",1]}', '{"kind":"object_path","path":["rows",1,"n"]}', '{"kind":"object_path","path":["rows","t"]}', '{"kind":"object_path","path":["rows",-1]}',
    ]
    t1, t2 = F.to_json(F.struct(F.col("text").alias("t"))), F.to_json(F.struct(F.col("n_chars").alias("n")))
    body = F.concat(F.lit('{"rows":['), t1, F.lit(","), t2, F.lit('],"it\'s":'), F.to_json(F.struct(F.array("source").alias("k"))), F.lit("}"))
    d = t.documents.select("doc_id", F.when(k < 2, F.col("text")).otherwise(body).alias("payload"), F.lit("shell").alias("tool"))
    pieces = t.documents.select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(":0")).alias("piece"), F.parse_json(F.get(F.array(*[F.lit(a) for a in arms]), k.cast("int"))).alias("selector"))
    return selectors.resolved(pieces, d, ["doc_id"], "piece", "selector", "payload", "tool").select("doc_id", "kind", F.sha2("content", 256).alias("content"), "bytes")


@query("SELECT conv_id, n AS call, greatest(0, least(g - o, 2))::BIGINT AS got, greatest(0, g - o - 2)::BIGINT AS \"left\" FROM (SELECT conv_id, count(*) FILTER (kind <> 'user') AS g FROM " + PIECES + " GROUP BY 1), (SELECT unnest([1, 2, 3]) AS n, unnest([0, 2, 4]) AS o)")
def recall_loops(t: Tables) -> DataFrame:
    """Two answers with one and two calls, then one with none: three pages of two sources."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        visible = tuple(fold.Piece(i, i, "user", 1, i) for i in pdf.loc[pdf["kind"] == "user", "id"])
        state = fold.State(pieces=visible, processed=tuple(pdf["id"]))
        pages = fold.recall_loop(state, [[(0, 2)], [(2, 2), (4, 2)], []])
        return pd.DataFrame({"conv_id": pdf["conv_id"].iloc[0], "call": range(1, 4), "got": [len(p) for p, _ in pages], "left": [n for _, n in pages]})

    return _pieces(t).select("conv_id", "place", "id", "kind").groupBy("conv_id").applyInPandas(run, "conv_id long, call long, got long, left long")


#: Answers of a router, with {n} for a number from the row, and the path at which each is out of shape.
ROUTES = [
    ('{{"kind":"revive_task","relativeIndex":-{n}}}', None), ('{{"relativeIndex":0,"kind":"new_task"}}', None), ('{{"kind":"same_task","relativeIndex":0.0}}', None), ('{{"kind":"more_archived_tasks","relativeIndex":0}}', None),
    ('{{"kind":"new_task","relativeIndex":"abc"}}', "$.relativeIndex"), ('{{"kind":"revive_task","relativeIndex":-{n}.5}}', "$.relativeIndex"), ('{{"kind":5,"relativeIndex":0}}', "$.kind"), ('{{"kind":"same_task","relativeIndex":{n}}}', "$.relativeIndex"),
    ('{{"kind":"revive_task","relativeIndex":{n}}}', "$.relativeIndex"), ('{{"kind":"revive_task"}}', "$.relativeIndex"), ('{{"kind":"new_task","relativeIndex":0,"more":{n}}}', "$.more"), ('{{"kind":"new_task","relativeIndex":null}}', "$.relativeIndex"),
    ('["new_task",{n}]', "$"), ('{{broken {n}', "$"), ("null", "$"), ('{{"kind":"other","relativeIndex":0}}', "$.kind"),
]
_ROUTE_SQL = "[" + ", ".join("NULL" if p is None else f"'{p}'" for _, p in ROUTES) + "]"


@query(f"""SELECT event_id, problem, CASE WHEN problem IS NULL THEN ['revive_task', 'new_task', 'same_task', 'more_archived_tasks'][event_id % 16 + 1] END AS kind, CASE WHEN problem IS NULL THEN CASE WHEN event_id % 16 = 0 THEN -(user_id % 5 + 1) ELSE 0 END END::BIGINT AS index
FROM (SELECT *, ({_ROUTE_SQL})[event_id % 16 + 1] AS problem FROM events)""")
def strict_routes(t: Tables) -> DataFrame:
    """Answers of the fixed shape and fifteen ways to miss it: each with the path of its first violation."""
    n = (F.col("user_id") % 5 + 1).cast("string")
    bodies = F.array(*[F.concat(*[x for p in b.format(n="\0").split("\0") for x in (F.lit(p), n)][:-1]) for b, _ in ROUTES])
    body = F.get(bodies, (F.col("event_id") % len(ROUTES)).cast("int"))
    r = decisions.strict(body, decisions.ROUTE_SHAPE)
    return t.events.select("event_id", decisions.problem(body, decisions.ROUTE_SHAPE).alias("problem"), r["kind"].alias("kind"), r["relativeIndex"].alias("index"))


@query("""SELECT doc_id, CASE doc_id % 6 WHEN 1 THEN '$.results[1].sections[' || doc_id % 3 || '].anchor' WHEN 2 THEN '$.results[1].sections[' || doc_id % 3 || '].more' WHEN 3 THEN '$.results[1].sections' WHEN 4 THEN '$.results[0].itemId' WHEN 5 THEN '$.results' END AS problem,
CASE WHEN doc_id % 6 = 0 THEN length(text) + 1 END::BIGINT AS chars FROM documents""")
def strict_outlines(t: Tables) -> DataFrame:
    """Batches of outlines around the documents' texts: one answer an error, one with three sections, of which one may be out of shape."""
    k, at = F.col("doc_id") % 6, F.col("doc_id") % 3
    text = F.regexp_replace(F.to_json(F.struct(F.col("text").alias("t"))), r"(?s)^\{\"t\":(.*)\}$", "$1")
    plain = F.concat(F.lit('{"label":"l","anchor":'), text, F.lit("}"))
    odd = F.when(k == 1, F.lit('{"label":"l","anchor":7}')).when(k == 2, F.concat(F.lit('{"label":"l","more":1,"anchor":'), text, F.lit("}"))).otherwise(plain)
    sections = F.concat(F.lit("["), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.when(i == at, odd).otherwise(plain)), ","), F.lit("]"))
    first = F.when(k == 4, F.lit('{"itemId":4,"error":"e"}')).otherwise(F.lit('{"itemId":"a","error":"e"}'))
    body = F.concat(F.lit('{"results":['), first, F.lit(',{"itemId":"b","sections":'), F.when(k == 3, text).otherwise(sections), F.lit("}]}"))
    body = F.when(k == 5, F.concat(F.lit('{"results":'), text, F.lit("}"))).otherwise(body)
    got = decisions.strict(body, decisions.CHUNKS_SHAPE)
    chars = F.length(F.get(F.get(got["results"], F.lit(1))["sections"], F.lit(1))["anchor"]) + F.length(F.get(got["results"], F.lit(0))["error"])
    return t.documents.select("doc_id", decisions.problem(body, decisions.CHUNKS_SHAPE).alias("problem"), chars.cast("long").alias("chars"))


@query("""SELECT doc_id, CASE doc_id % 5 WHEN 1 THEN '$.defaultDecision.reason' WHEN 2 THEN '$.overrides[0].reason' WHEN 3 THEN '$.overrides[1].drop' WHEN 4 THEN '$.overrides[1].pieceId' END AS problem FROM labels""")
def strict_drops(t: Tables) -> DataFrame:
    """Batches of drops around the labels: reasons for what is kept, none for what goes, a word for a truth value, no piece."""
    k, i = F.col("doc_id") % 5, F.col("doc_id").cast("string")
    default = F.when(k == 1, F.lit('{"drop":false,"reason":"pure_ack_or_chatter"}')).otherwise(F.lit('{"drop":false,"reason":null}'))
    one = F.concat(F.lit('{"pieceId":"'), i, F.when(k == 2, F.lit('","drop":true,"reason":null}')).otherwise(F.lit('","drop":true,"reason":"empty_or_invalid"}')))
    two = F.when(k == 4, F.lit('{"drop":false,"reason":null}')).otherwise(F.concat(F.lit('{"pieceId":"'), i, F.when(k == 3, F.lit('","drop":"no","reason":null}')).otherwise(F.lit('","drop":false,"reason":null}'))))
    body = F.concat(F.lit('{"defaultDecision":'), default, F.lit(',"overrides":['), one, F.lit(","), two, F.lit("]}"))
    return t.labels.select("doc_id", decisions.problem(body, decisions.DROPS_SHAPE).alias("problem"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'no known reason' WHEN 1 THEN 'reason without drop' ELSE 'no decision' END AS problem FROM documents WHERE doc_id % 4 < 3")
def invalid_reasons(t: Tables) -> DataFrame:
    k = F.col("doc_id") % 4
    d = t.documents.select("doc_id", F.when(k == 0, True).when(k == 1, False).when(k == 3, True).alias("drop"), F.when(k == 0, "because").when(k > 0, decisions.UNRELATED).alias("reason"))
    return decisions.invalid_reasons(d, "doc_id")


@query("SELECT doc_id, coalesce(n, 0)::INT AS sections, CASE WHEN doc_id % 3 = 0 THEN 'answered' ELSE 'missing_from_response' END AS status FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 2 END AS n FROM documents)")
def chunk_answers(t: Tables) -> DataFrame:
    """Outlines for each third source, the others left out or not of the fixed shape."""
    from ..operators import predicates

    section = F.struct(F.lit("l").alias("label"), F.lit("a").alias("anchor"))
    body = F.when(F.col("doc_id") % 3 == 0, _json(itemId=F.col("doc_id").cast("string"), sections=F.array(section, section))).when(F.col("doc_id") % 3 == 1, _json(itemId=F.col("doc_id").cast("string")))
    got = t.documents.select(decisions.strict(body, decisions.CHUNK_SHAPE).alias("c")).where("c is not null").select(F.col("c.itemId").cast("long").alias("doc_id"), F.size("c.sections").alias("sections"))
    return predicates.with_missing(t.documents.select("doc_id"), got, ["doc_id"], "sections").withColumn("sections", F.coalesce("sections", F.lit(0)))


MARKED = f"(SELECT conv_id, place, kind, text, first_value(place) OVER (PARTITION BY conv_id, kind, length(text) % 4 ORDER BY place) AS first FROM {PIECES})"


@query(f"""WITH e AS (SELECT conv_id, place, CASE WHEN place = first THEN '[piece p' || place || ' ' || kind || ']' || chr(10) || text || chr(10) || '[/piece]' ELSE '[same p' || place || ' as p' || first || ']' END AS entry FROM {MARKED})
SELECT conv_id, '[memory]' || chr(10) || '[task t' || conv_id || ' since round 1, last round ' || max(r) || ']' || chr(10) || string_agg(entry, chr(10) ORDER BY place) || CASE WHEN conv_id % 2 = 0 THEN chr(10) || '[archive holds 4 sources: recall(offset, limit)]' ELSE '' END || chr(10) || '[/memory]' AS text
FROM e JOIN (SELECT conv_id, max(round) AS r FROM {PIECES} GROUP BY 1) USING (conv_id) GROUP BY 1""")
def memory_blocks(t: Tables) -> DataFrame:
    """Pieces and markers in one sequence, between the task's line and the archive's; pieces of one kind and length (mod 4) stand for copies."""
    p = _pieces(t).select("conv_id", "place", "round", F.concat(F.lit("p"), F.col("place").cast("string")).alias("id"), "kind", "text", (F.length("text") % 4).alias("c"))
    m = dedupe.collapse_prefer(p.withColumn("preferred", F.lit(True)), ["conv_id", "kind"], "c", "preferred", "place", "id")
    markers = dedupe.duplicate_markers(m, ["conv_id"], "id", ["place"])
    entries = render.prompt_entries(m.where("not duplicate"), markers, "conv_id", "place", "id", "kind", "text")
    task = p.groupBy("conv_id").agg(F.max("round").alias("last"))
    head, tail = render.memory_frame(F.concat(F.lit("t"), F.col("conv_id").cast("string")), F.lit(1), F.col("last"), F.when(F.col("conv_id") % 2 == 0, 4).otherwise(0))
    ends = task.select("conv_id", F.explode(F.array(F.struct(F.lit(-1).cast("long").alias("place"), head.alias("entry")), F.struct(F.lit(1 << 40).alias("place"), tail.alias("entry")))).alias("x")).select("conv_id", "x.place", F.lit("").alias("id"), "x.entry").where("entry is not null")
    return render.memory_text(entries.withColumn("place", F.col("place").cast("long")).unionByName(ends), "conv_id", ["place", "id"], "entry")


@query(f"SELECT conv_id, place AS piece, row_number() OVER (PARTITION BY conv_id ORDER BY place) - 1 AS place, CASE WHEN place % 2 = 0 THEN text ELSE substr(text, 1, 5) END AS content FROM {PIECES}")
def route_pieces(t: Tables) -> DataFrame:
    """Even pieces are rendered, of the others a router sees the preview."""
    p = _pieces(t).select("conv_id", F.col("place").alias("piece"), F.substring("text", 1, 5).alias("preview"))
    seen = _pieces(t).where("place % 2 = 0").select("conv_id", F.col("place").alias("piece"), "text")
    return render.route_pieces(p, seen, ["conv_id", "piece"], ["piece"], "preview", "text")


@query("""SELECT conv_id, string_agg('[item ["' || turn || '"] length=' || length(text) || ']' || chr(10) || text || chr(10) || '[/item]', chr(10) ORDER BY turn) AS input FROM conversations GROUP BY 1""")
def outline_requests(t: Tables) -> DataFrame:
    return render.outline_request(t.conversations, "conv_id", "turn", "turn", "text")


#: Every assistant message at a third turn compacts what was before it into itself.
COMPACTED = f"""WITH r AS (SELECT *, length(to_json(text)::VARCHAR) + length(role) + 70 AS size FROM {ROUNDS}), c AS (SELECT *, role = 'assistant' AND turn % 3 = 0 AND round > 0 AS cut FROM r),
s AS (SELECT a.conv_id, a.round, a.turn, (SELECT max(b.turn) FROM c b WHERE b.conv_id = a.conv_id AND b.cut AND b.turn < a.turn) AS last, (SELECT count(*) FROM c b WHERE b.conv_id = a.conv_id AND b.cut AND b.turn < a.turn) AS compactions FROM c a WHERE {IS_USER.replace('role', 'a.role').replace('text', 'a.text').replace('<environment_cona.text>', '<environment_context>')})
SELECT s.conv_id, s.round, s.compactions, (count(*) + (s.compactions > 0)::INT)::BIGINT AS items,
ceil((44 + sum(c.size) + CASE WHEN s.compactions > 0 THEN (SELECT d.size FROM c d WHERE d.conv_id = s.conv_id AND d.turn = s.last) ELSE 0 END + count(*) + (s.compactions > 0)::INT - 1) / 4.0)::BIGINT AS tokens
FROM s JOIN c ON c.conv_id = s.conv_id AND c.turn <= s.turn AND (c.round = 0 OR s.last IS NULL OR c.turn > s.last) GROUP BY s.conv_id, s.round, s.compactions, s.last"""


@query(COMPACTED)
def compacted_context(t: Tables) -> DataFrame:
    """Every assistant message at a third turn compacts what was before it into itself."""
    return rounds.compacted_tokens(t.conversations, "conv_id", "turn", "role", "text", user(), (F.col("role") == "assistant") & (F.col("turn") % 3 == 0))


@query(f"SELECT conv_id, max(round) AS rounds, string_agg('m' || lpad(place::VARCHAR, 6, '0'), ',' ORDER BY round, place) AS ids, count(*) AS pieces, sum(size)::BIGINT AS bytes FROM {PIECES} GROUP BY 1")
def memory_metrics(t: Tables) -> DataFrame:
    """Counts, ids and bytes of the last state under retain-all."""
    f = fold.replay(_pieces(t), "retain-all", "conv_id").where("state is not null")
    return f.select("conv_id", F.col("round").alias("rounds"), F.array_join("state.pieces.id", ",").alias("ids"), "pieces", "bytes")


CONTEXT = f"""(SELECT conv_id, 'without' AS side, sum(strlen(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS bytes, {IS_USER} AS starts FROM conversations
UNION ALL SELECT conv_id, 'with', sum(CASE WHEN {IS_USER} THEN strlen(text) ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT, {IS_USER} FROM conversations)"""


@query(f"SELECT conv_id, side, min(bytes) AS bytes_min, floor(avg(bytes) + 0.5)::BIGINT AS bytes_avg, max(bytes) AS bytes_max, sum(bytes)::BIGINT AS bytes_total FROM {CONTEXT} WHERE starts GROUP BY 1, 2")
def context_windows(t: Tables) -> DataFrame:
    """Bytes of each round's request with and without memory: all that was said before, or what the fold held before the round and its own message."""
    b = T.byte_size("text")
    turns_ = in_rounds(t).select("conv_id", "turn", "round", user().alias("starts"), b.alias("all"), F.when(user(), b).otherwise(0).alias("own"))
    run = metrics.running_sums(turns_, "conv_id", "turn", ["all"]).where("starts")
    held = fold.replay(_pieces(t).withColumn("chars", F.col("size")), "drop-tools", "conv_id").select("conv_id", "round", "before_chars")
    sides = run.join(held, ["conv_id", "round"]).select("conv_id", F.explode(F.array(F.struct(F.lit("without").alias("side"), F.col("all").alias("bytes")), F.struct(F.lit("with").alias("side"), (F.col("before_chars") + F.col("own")).alias("bytes")))).alias("x"))
    return sides.select("conv_id", "x.side", "x.bytes").groupBy("conv_id", "side").agg(*metrics.series("bytes", "bytes"))


@query("SELECT count(DISTINCT source) AS suites, count(*) AS runs, count(*) FILTER (doc_id % 5 > 0) AS passed, count(*) FILTER (doc_id % 5 = 0) AS failed, sum(n_chars)::BIGINT AS chars, sum(CASE WHEN doc_id % 5 = 0 THEN n_chars ELSE 0 END)::BIGINT AS failed_chars FROM documents")
def suite_totals(t: Tables) -> DataFrame:
    return metrics.suite_totals(t.documents.withColumn("ok", F.col("doc_id") % 5 > 0), "source", "ok", "n_chars")


@query("SELECT source, string_agg(doc_id, ',' ORDER BY doc_id) AS tail FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents WHERE doc_id % 5 = 0) WHERE r <= 10 GROUP BY 1")
def failure_tails(t: Tables) -> DataFrame:
    """The first ten failures of each source."""
    f = metrics.first_of_each(t.documents.where("doc_id % 5 = 0").select("source", "doc_id"), "source", "doc_id", 10)
    return f.select("source", F.array_join(F.transform("tail", lambda x: x.cast("string")), ",").alias("tail"))


@query("SELECT * FROM (VALUES ('completed', 1.0::DOUBLE), ('filled', 1.0::DOUBLE)) x(rate, value)")
def replay_rates(t: Tables) -> DataFrame:
    """All sessions are replayed to their end, and none of their requests is empty."""
    c = turn_context(t).groupBy("conv_id").agg(F.min("rewritten").alias("least"), F.count("*").alias("n"))
    want = in_rounds(t).where("round > 0").groupBy("conv_id").agg(F.count_distinct("round").alias("rounds"))
    r = want.join(c, "conv_id", "left").agg(F.avg((F.col("n") == F.col("rounds")).cast("double")).alias("completed"), F.avg((F.col("least") > 0).cast("double")).alias("filled"))
    return r.select(F.explode(F.array(F.struct(F.lit("completed").alias("rate"), F.col("completed").alias("value")), F.struct(F.lit("filled").alias("rate"), F.col("filled").alias("value")))).alias("x")).select("x.rate", "x.value")
