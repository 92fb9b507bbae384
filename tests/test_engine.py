"""The engine's operators on small tables and scenarios."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from turnloom.functions import text as T
from turnloom.functions import values
from turnloom.operators import archive, chunks, decisions, dedupe, fold
from turnloom.sources import commits, rollouts, sse, store
from turnloom.streaming.observed import observed_turns_stream


def piece(i, kind="assistant", h=None, size=10, text=""):
    return fold.Piece(i, f"s_{i}", kind, size, h or i, text_hash=text)


def run(rounds, drop=lambda b: {}, **k):
    state, outs = fold.State(), []
    for new, route in rounds:
        out = fold.step(state, new, route, drop, **k)
        state = out.state
        outs.append(out)
    return state, outs


ids = lambda state: [p.id for p in state.pieces]


def test_same_task_keeps_everything():
    state, outs = run([([piece("u1", "user"), piece("a1")], "same"), ([piece("u2", "user"), piece("a2")], "same")])
    assert ids(state) == ["a1", "u1", "a2", "u2"] and not state.archived and outs[0].route == "new"


def test_new_task_archives_and_shares():
    state, _ = run([([piece("u1", "user")], "same"), ([piece("u2", "user")], "new")])
    assert [[p.id for p in t.pieces] for t in state.archived] == [["u1"]] and ids(state) == ["u1", "u2"] and state.task.started == 2


def test_revive_swaps_tasks_and_prefers_revived_copies():
    state, outs = run([([piece("u1", "user", "h")], "same"), ([piece("u2", "user", "k"), piece("x2", "tool", "h")], "new"), ([piece("u3", "user")], -1)])
    assert outs[2].route == "-1" and state.task.id == "task_1"
    assert [t.id for t in state.archived] == ["task_2"]
    assert ids(state) == ["u1", "u2", "u3"] and state.pieces[0].duplicates == ("x2",)


def test_invalid_revive_stays():
    state, outs = run([([piece("u1", "user")], "same"), ([piece("u2", "user")], -3)])
    assert outs[1].route == "same" and not state.archived


def test_old_task_reason_only_on_a_new_task_and_old_pieces():
    drop = lambda b: {p.id: fold.OLD_TASK for p in b if p.id in ("t1", "t2")}
    rounds = [([piece("u1", "user"), piece("t1", "tool")], "same"), ([piece("u2", "user"), piece("t2", "tool")], "new")]
    assert ids(run(rounds, drop)[0]) == ["u1", "t2", "u2"]
    assert ids(run([rounds[0], (rounds[1][0], "same")], drop)[0]) == ["t1", "u1", "t2", "u2"]


def test_guard_undoes_what_leaves_only_the_assistant():
    rounds = [([piece("u1", "user"), piece("a1")], "same")]
    assert ids(run(rounds, lambda b: {"u1": fold.UNRELATED})[0]) == ["a1", "u1"]
    assert ids(run(rounds, lambda b: {"u1": "explicitly_invalidated_by_user"})[0]) == ["a1"]
    assert ids(run(rounds, fold.policy("keep-none"))[0]) == ["a1", "u1"]


def test_duplicates_go_under_what_stands_for_them():
    state, outs = run([([piece("u1", "user", "h")], "same"), ([piece("u2", "user", "h"), piece("u3", "user", "k"), piece("u4", "user", "k")], "same")])
    assert ids(state) == ["u1", "u3"] and outs[1].duplicates == ["u2", "u4"]
    assert [p.duplicates for p in state.pieces] == [("u2",), ("u4",)]


def test_new_task_prefers_new_copies_after_pruning():
    state, _ = run([([piece("u1", "user", "h")], "same"), ([piece("u2", "user", "h")], "new")])
    assert ids(state) == ["u2"] and state.pieces[0].duplicates == ("u1",)


def test_model_duplicates_need_the_same_text():
    drop = lambda b: {p.id: "exact_duplicate" for p in b if p.id in ("a1", "a3")}
    new = [piece("a1", text="t"), piece("a2", text="t"), piece("a3", text="other")]
    assert ids(run([(new, "same")], drop)[0]) == ["a2", "a3"]


def test_failing_or_wrong_policies_keep():
    def broken(batch):
        raise ValueError

    rounds = [([piece("u1", "user"), piece("a1")], "same")]
    assert len(run(rounds, broken)[0].pieces) == len(run(rounds, lambda b: {"nobody": fold.UNRELATED})[0].pieces) == 2


def test_empty_sources_are_processed_once_and_emptied_state_routes_new():
    state, outs = run([([piece("u1", "user", size=0)], "same"), ([piece("u2", "user")], "same")])
    assert outs[1].route == "new" and state.processed == ("s_u2",)


def test_batches():
    pieces = [piece(f"p{i}", size=1000) for i in range(5)] + [piece("big", size=20_000), piece("huge", size=90_000)]
    got = fold.batches(pieces, set(), limit=1600, single=10_000)
    assert [[p.id for p in b] for b in got] == [["p0", "p1", "p2", "p3"], ["p4"], ["big"]]
    users = [piece("u", "user", size=9000), *pieces[:2]]
    assert [[p.id for p in b] for b in fold.batches(users, set(), limit=1600, single=10_000)] == [["u"]]


def test_recall_pages_cover_the_gap_once():
    state, _ = run([([piece(f"u{i}", "user"), piece(f"t{i}", "tool")], "same") for i in range(8)], fold.policy("drop-tools"))
    seen, at = [], 0
    while True:
        page, left = fold.recall(state, at, 3)
        seen += page
        at += 3
        if not left:
            break
    assert seen == [f"s_t{i}" for i in range(8)]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.lists(st.tuples(st.sampled_from(["user", "assistant", "tool"]), st.integers(0, 4), st.integers(0, 30_000)), max_size=5), st.sampled_from(["same", "new", -1, -2])), max_size=6), st.sampled_from(sorted(fold.POLICIES)))
def test_candidates_are_kept_dropped_or_duplicates(rounds, name):
    state = fold.State()
    for r, (new, route) in enumerate(rounds):
        out = fold.step(state, [fold.Piece(f"{r}_{i}", f"s{r}_{i}", k, size, str(h)) for i, (k, h, size) in enumerate(new)], route, fold.policy(name))
        kept, gone = {p.id for p in out.state.pieces}, set(out.dropped) | set(out.duplicates)
        assert not kept & gone and set(out.candidates) <= kept | gone
        state = out.state
        assert len({p.id for p in state.pieces}) == len(state.pieces)


def one(spark, col, **values_):
    return spark.createDataFrame([tuple(values_.values())], ", ".join(f"{k} string" for k in values_)).select(col.alias("x")).first()["x"]


def test_text_functions(spark):
    assert one(spark, T.utf16_length("t"), t="a😀é") == 4
    assert one(spark, T.estimated_tokens("t"), t="abcde") == 2
    assert one(spark, T.preview("t"), t="x" * 161) == "x" * 157 + "..."
    assert one(spark, T.title("t"), t="\n  \n  two   words \nmore") == "two words"
    assert one(spark, T.tool_payload("n", "t"), n="exec_command", t="Exit: 0\r\nOutput:\r\nhello\r\n") == "hello\n"
    assert one(spark, T.tool_payload("n", "t"), n="other", t="x\nOutput:\ny") == "x\nOutput:\ny"
    assert one(spark, T.stable_json("t"), t='{"b":1,"a":[{"d":1,"c":2}]}') == '{"a":[{"c":2,"d":1}],"b":1}'
    assert [one(spark, T.non_negative("t"), t=x) for x in ("3.9", "-1", "NaN", "x", "1e400")] == [3, 0, 0, 0, 0]
    assert one(spark, F.struct(*T.recall_bounds("t")), t='{"offset":-2,"limit":0}') == (0, 1)
    assert one(spark, F.struct(*T.recall_bounds("t")), t='{"offset":"4","limit":7}') == (0, 7)
    assert one(spark, T.percent_reduction(F.lit(0.0), F.lit(1.0)), t="") is None


def test_nested_values(spark):
    body = json.dumps({"headers": {"Authorization": "x", "a": ["b", {"api_key": "y"}]}})
    assert json.loads(one(spark, values.redact("t"), t=body)) == {"headers": {"Authorization": "[redacted]", "a": ["b", {"api_key": "[redacted]"}]}}
    assert one(spark, values.leaves("t"), t='{"a":["x",{"b":"y"}],"c":1}') == ["x", "y"]
    assert one(spark, values.fnv1a("t"), t="a") == "e40c292c"


def test_rollout_log(spark, tmp_path):
    lines = [
        {"type": "session_meta", "payload": {"id": "S", "cwd": "/w", "originator": "cli"}},
        {"type": "event_msg", "payload": {"type": "token_count", "info": {"last_token_usage": {"input_tokens": 10, "output_tokens": 3, "cached_input_tokens": 4}}}},
    ]
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.jsonl").write_text("\n".join([*map(json.dumps, lines), "", "not json", "[1]"]))
    parsed = rollouts.parse_events(rollouts.read_lines(spark, f"file://{tmp_path}"))
    assert parsed.count() == 2
    assert rollouts.session_meta(rollouts.read_lines(spark, f"file://{tmp_path}")).select("session_id", "cwd").collect() == [("S", "/w")]
    e = rollouts.events(parsed)
    assert rollouts.usage_records(e, "file", "line_no").select("input", "output", "cached", "total").collect() == [(10, 3, 4, 13)]
    assert rollouts.newest(parsed).count() == 1


def test_request_sources(spark):
    items = [
        {"type": "function_call", "name": "weigh", "call_id": "k9", "arguments": "{}"},
        {"type": "message", "role": "assistant", "content": "twice"},
        {"type": "message", "id": "p-4", "role": "user", "content": [{"type": "input_text", "text": "how heavy"}, {"type": "input_text", "text": "is it?"}]},
        {"type": "function_call_output", "call_id": "k9", "output": "4 kg"},
        {"type": "message", "role": "assistant", "content": "twice"},
        {"type": "message", "id": "s-0", "role": "system", "content": "be brief"},
        {"type": "reasoning", "id": "z-1", "summary": []},
    ]
    df = spark.createDataFrame([("r", i, json.dumps(x)) for i, x in enumerate(items)], "request string, place int, body string").withColumn("item", F.parse_json("body"))
    got = rollouts.request_sources(df, "request", "place").orderBy("place").collect()
    assert [r["kind"] for r in got] == ["tool_call", "assistant", "user", "tool", "assistant", "assistant"]
    assert [got[i]["source_id"] for i in (0, 2, 3, 5)] == ["tool_call:k9", "p-4", "k9", "z-1"]
    assert got[2]["payload"] == "how heavy\nis it?" and got[3]["payload"] == "4 kg" and got[3]["tool"] == "weigh"
    assert got[1]["source_id"] != got[4]["source_id"]


def test_sse(spark):
    body = [
        'data: {"type":"response.output_text.delta","delta":"He"}', "event: x", 'data: {"type":"response.output_text.delta","delta":"y"}',
        'data: {"type":"response.output_item.done","output_index":10,"item":{"id":"b"}}', 'data: {"type":"response.output_item.done","output_index":2,"item":{"id":"old"}}',
        'data: {"type":"response.output_item.done","output_index":2,"item":{"id":"a"}}', 'data: {"type":"response.completed","response":{"usage":{"input_tokens":5,"output_tokens":2}}}', "data: [DONE]",
    ]
    e = sse.parse_sse(spark.createDataFrame([("r", i, x) for i, x in enumerate(body)], "response string, n int, line string"))
    items = sse.output_items(e, "response", "n")
    assert [json.loads(r["j"])["id"] for r in items.orderBy("index").select(F.to_json("item").alias("j")).collect()] == ["a", "b"]
    assert sse.response_text(e, "response", "n").first()["text"] == "Hey"
    assert sse.response_usage(e, "response", "n").select("input", "output", "total").first() == (5, 2, 7)
    back = sse.synthesize(items, "response", "index").first()["body"]
    assert back.index('"a"') < back.index('"b"') and back.endswith("data: [DONE]\n\n")
    texts = spark.createDataFrame([('x ```json\n{"a":1}\n``` y',), ('so {"a":1} it is',), ("none",)], "t string")
    assert [r["j"] for r in texts.select(F.to_json(sse.json_object("t")).alias("j")).collect()] == ['{"a":1}', '{"a":1}', None]


def test_store(spark, tmp_path):
    path = f"file://{tmp_path}/archive"
    first = spark.createDataFrame([("s", "a", "1"), ("s", "b", "2")], "session string, source string, text string")
    store.archive(spark, first, path, ["session", "source"])
    store.archive(spark, spark.createDataFrame([("s", "b", "changed"), ("s", "c", "3")], first.schema), path, ["session", "source"])
    assert sorted(r["text"] for r in commits.read(spark, path).collect()) == ["1", "2", "3"]
    states = f"file://{tmp_path}/state"
    for r in (1, 2):
        store.save_state(spark.createDataFrame([("s", r, f"v{r}")], "session string, round int, body string"), states)
    assert store.load_state(spark, states).first()["body"] == "v2" and store.load_state(spark, states, at=1).first()["body"] == "v1"
    assert store.violations(spark.createDataFrame([("s", "a"), ("s", "a"), ("s", " ")], "session string, piece string"), "session", "piece", ["piece"]).count() == 2
    with pytest.raises(ValueError, match="not found"):
        store.subset(first, spark.createDataFrame([("s", "zz")], "session string, source string"), ["session", "source"])


def test_chunks(spark):
    texts = ["", "a", "a\n", "\n\n", "a\nb\n\nc", "x" * 50]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string").withColumn("spans", chunks.line_spans(F.col("text")))
    assert all(r["ok"] for r in df.select(chunks.lossless(F.col("text"), F.col("spans")).alias("ok")).collect())
    back = chunks.explode_pieces(df, "id", "text", F.col("spans")).orderBy("id", "start").collect()
    assert ["".join(r["content"] for r in back if r["id"] == i) for i in range(len(texts))] == texts
    spans = F.from_json("t", "array<struct<start:int,end:int>>")
    assert one(spark, chunks.merge_spans(spans), t='[{"start":5,"end":9},{"start":0,"end":3},{"start":3,"end":4},{"start":8,"end":12},{"start":7,"end":7}]') == [(0, 4), (5, 12)]
    assert not one(spark, chunks.lossless(F.lit("abc"), F.from_json("t", "array<struct<start:int,end:int>>")), t='[{"start":0,"end":1},{"start":2,"end":3}]')


def test_greedy_skips_and_goes_on(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate([5, 90, 20, 80, 10])], "place int, size long").withColumn("s", F.lit(1))
    got = {r["place"]: r["kept"] for r in decisions.cap_bytes(df, ["s"], ["place"], "size", "place", 100).collect()}
    assert got == {4: True, 3: True, 2: False, 1: False, 0: True}


def test_dedupe_and_verbatim(spark):
    df = spark.createDataFrame([("k", 1, "a"), ("k", 2, "b"), ("j", 1, "c")], "key string, n int, v string")
    assert {r["v"] for r in dedupe.dedupe_last(df, ["key"], "n").collect()} == {"b", "c"}
    assert {r["v"] for r in dedupe.dedupe_first(df, ["key"], "n").collect()} == {"a", "c"}
    texts = spark.createDataFrame([(1, "xx needle yy pin"), (2, None), (3, "pi n")], "id int, text string")
    needles = spark.createDataFrame([(7, "needle"), (8, "pin"), (9, ""), (10, None), (11, "pin")], "item_id long, text string")
    assert sorted((r["id"], r["item_id"]) for r in archive.verbatim(texts, needles, "id", "text", "item_id", "text").collect()) == [(1, 7), (1, 8), (1, 11)]


def test_turn_stream(spark, tmp_path):
    rows = [(1, 1, "view"), (1, 2, "signup"), (1, 3, "click"), (1, 4, "purchase"), (1, 5, "click"), (2, 6, "signup"), (2, 7, "signup"), (2, 8, "purchase"), (1, 9, "signup"), (1, 10, "purchase")]
    df = spark.createDataFrame([(u, e, k) for u, e, k in rows], "user_id long, event_id long, event_type string").withColumn("ts", F.timestamp_seconds("event_id"))
    df.where("event_id <= 5").coalesce(1).write.parquet(f"file://{tmp_path}/in/0")
    df.where("event_id > 5").coalesce(1).write.parquet(f"file://{tmp_path}/in/1")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in/*")
    q = observed_turns_stream(stream, F.col("event_type") == "signup", F.col("event_type") == "purchase").writeStream.format("memory").queryName("turns_out").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted(tuple(r) for r in spark.sql("select * from turns_out").collect())
    assert got == [(1, 1, 3, 2, 4), (1, 2, 2, 9, 10), (2, 1, 2, 7, 8)]
