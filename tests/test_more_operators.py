"""Predicates, logs, prompts, outlines, settings."""

import json

import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from turnloom.functions.config import Settings, twice
from turnloom.operators import logs, outline, predicates, prompt
from turnloom.sources import rollouts


def one(spark, col, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(col.alias("x")).first()["x"]


def test_batch_progress(spark):
    lines = [
        "2026-01-01T00:00:00Z batch_start old", "2026-01-01T00:00:10Z done [1/2]", "2026-01-01T01:00:00Z batch_start new", "2026-01-01T01:10:00Z done [1/9]",
        "2026-01-01T01:20:00Z heartbeat completed_this_run=4/9 queued=2", "", "no time here", "2026-01-01T01:30:00Z done [5/9]",
    ]
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate(lines)], "log string, n int, line string")
    r = logs.batch_progress(df, "log", "n", "line", F.lit(20), F.lit(12)).first()
    assert (r["seconds"], r["finished"], r["per_hour"], r["hours_left"]) == (1800, 4, 8.0, 1.0)


def test_predicates(spark):
    assert one(spark, predicates.chunkable(F.col("k"), F.col("t")), k="tool", t="recall") is False
    assert one(spark, predicates.chunkable(F.col("k"), F.col("t")), k="assistant", t=None) is True
    assert one(spark, predicates.is_event_stream(F.col("c"), F.col("b")), c=None, b="x\ndata: {}") is True
    assert one(spark, predicates.is_event_stream(F.col("c"), F.col("b")), c="text/plain", b=" data: {}") is False
    assert one(spark, predicates.synthetic_memory(F.col("r"), F.col("b")), r="developer", b="x [memory] y") is True
    assert tuple(one(spark, predicates.coerced_route(F.col("k"), F.col("i")), k="revive_task", i="-2.7")) == ("revive_task", -2)
    assert tuple(one(spark, predicates.coerced_route(F.col("k"), F.col("i")), k="revive_task", i="3")) == ("same_task", None)


def test_selection_and_comparable_text(spark):
    seg = F.from_json("t", "array<struct<start:int,end:int,text:string>>")
    t = json.dumps([{"start": 0, "end": 3, "text": "abc"}, {"start": 5, "end": 7, "text": "fg"}])
    assert one(spark, prompt.selection_text(seg, F.lit(9)), t=t) == "<segment start=0 end=3>\nabc\n</segment>\n<gap omittedChars=2 />\n<segment start=5 end=7>\nfg\n</segment>\n<gap omittedChars=2 />"
    whole = json.dumps([{"start": 0, "end": 5, "text": "plain"}])
    assert one(spark, prompt.comparable_text(prompt.selection_text(seg, F.lit(5))), t=whole) == "plain"
    assert one(spark, prompt.selection_text(seg, F.lit(5)), t="[]") == ""
    assert one(spark, prompt.comparable_text(F.col("t")), t="<segment start=0>\nab\n</segment>\n<segment start=9>\ncd\n</segment>") == "abcd"
    assert one(spark, prompt.comparable_text(F.col("t")), t="plain") == "plain" and one(spark, prompt.comparable_text(F.col("t")), t="") is None


def test_envelopes(spark):
    v = F.try_parse_json("p")
    assert one(spark, prompt.envelope_event(v), p='{"type":"event_msg","payload":{"type":"task_started","turn_id":"T"}}')[:3] == ("turn.started", None, "T")
    assert one(spark, prompt.envelope_event(v), p='{"type":"event_msg","payload":{"type":"other"}}')["type"] is None
    assert one(spark, prompt.envelope_event(v), p='{"type":"event_msg","payload":{"type":"exec_command_end","aggregated_output":""}}')["type"] is None
    assert one(spark, prompt.event_summary(v), p='{"type":"item.completed","params":{"threadId":"T","item":{"id":"x"}}}')[:4] == (True, None, "item.completed", "T")
    assert one(spark, prompt.event_summary(v), p="3")["parsed"] is False


def test_stable_json_is_a_script_engines():
    from turnloom.functions.values import stable_text

    assert stable_text({"b": 1.0, "10": 1e21, "9": 1e-7, "\U0001f600": 0.5, "\uff5e": -0.0}) == '{"9":1e-7,"10":1e+21,"b":1,"\U0001f600":0.5,"\uff5e":0}'
    assert stable_text([None, True, 0.000001, 123456789012345680000, 1.5e300]) == "[null,true,0.000001,123456789012345680000,1.5e+300]"


def test_code_units(spark):
    from turnloom.functions import text as T

    t = "a\U0001f600" * 100
    assert one(spark, T.preview("t"), t=t) == "a\U0001f600" * 52 + "a..."
    assert one(spark, T.clipped("t", 6), t=t) == "a\U0001f600..." and one(spark, T.clipped("t", 5), t=t) == "a\ufffd..."
    assert one(spark, T.json_length("t"), t="\U0001f600") == 4
    assert one(spark, T.title("t", F.lit("Task 3")), t=" \n ") == "Task 3"


def test_many_lines_are_cut_in_one_pass(spark):
    from turnloom.operators import chunks

    t = "line of text\n" * 100_000 + "end"
    spans = one(spark, chunks.line_spans(F.col("t")), t=t)
    assert len(spans) == 100_001 and spans[-1] == (1_300_000, 1_300_003) and spans[7] == (91, 104)


def test_anchors_cut_where_they_are(spark):
    from turnloom.operators import chunks

    spans = lambda t, *a: [tuple(x) for x in one(spark, chunks.anchor_spans(F.col("t"), F.array(*map(F.lit, a))), t=t)]
    assert spans("abc. Def", "Def") == [(0, 5), (5, 8)]
    assert spans("xxAyyBzz", "A", "nowhere", "", "B") == [(0, 2), (2, 5), (5, 8)]
    assert spans("Axx", "A") == [(0, 3)] and spans("xx", "q") == [(0, 2)] and spans("", "q") == []


def test_versions_are_written_once(spark, tmp_path):
    from turnloom.sources import store

    path = f"file://{tmp_path}/states"
    rows = spark.createDataFrame([("s", 1, "x"), ("s", 2, "y")], "session string, round int, v string")
    store.save_state(rows, path)
    with pytest.raises(ValueError):
        store.save_state(rows.limit(1), path)
    with pytest.raises(ValueError):
        store.save_state(spark.createDataFrame([("t", 3, "x"), ("t", 3, "y")], rows.schema), path)
    assert store.load_state(spark, path, at=1).count() == 1


def test_recalls_are_counted():
    from turnloom.operators import fold

    state = fold.State(processed=tuple("abcdef"))
    assert fold.recall_loop(state, [[(0, 2)], []]) == [(["a", "b"], 4)]
    with pytest.raises(ValueError):
        fold.recall_loop(state, [[(0, 1), (1, 1)], [(2, 1), (3, 1)]])


def test_outlines_are_lossless_and_failures_keep_the_source_whole(spark):
    random.seed(9)
    texts = ["".join(random.choice("ab\n") for _ in range(random.randrange(60))) for _ in range(60)]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(900, None)], "id int, t string")

    def picky(text):
        if "aab" in text:
            raise ValueError
        return outline.paragraphs(text) or outline.halves(9)(text)

    out = {}
    for r in outline.outlined(d, "id", "t", picky).orderBy("id", "start").collect():
        own = out.setdefault(r["id"], [])
        assert r["index"] == len(own) and r["end"] > r["start"]
        own.append(texts[r["id"]][r["start"] : r["end"]])
    assert {i: "".join(p) for i, p in out.items()} == {i: t for i, t in enumerate(texts) if t}
    assert all(len(p) == 1 for i, p in out.items() if "aab" in texts[i]) and max(map(len, out.values())) > 4
    # At most seven rounds of halves.
    long = spark.createDataFrame([(1, "".join(map(chr, range(33, 33 + 2048))))], "id int, t string")
    assert outline.outlined(long, "id", "t", outline.halves(1)).count() == 128
    assert outline.split_once("xxAyyBzz", ["A", "nowhere", "B"]) == ["xx", "Ayy", "Bzz"]
    assert outline.split_once("abc. Def", ["Def"]) == ["abc. ", "Def"]


def test_selectors(spark):
    from turnloom.operators import selectors

    payload = '{"a":[{"b":"x"},[1,2]],"it\'s":"é","q\\"":{"n":null}}'
    arms = [('{"kind":"object_path","path":["a",0,"b"]}', "x"), ('{"kind":"object_path","path":["a",1]}', "[1,2]"), ('{"kind":"object_path","path":["it\'s"]}', "é"), ('{"kind":"object_path","path":["q\\"","n"]}', "null"),
            ('{"kind":"object_path","path":[]}', None), ('{"kind":"object_path","path":["a","b"]}', "gone"), ('{"kind":"object_path","path":["a",7]}', "gone"), ('{"kind":"object_path","path":["a",-1]}', "gone"), ('{"kind":"other"}', "gone"), ("{}", "gone"), ('{"kind":"object_path"}', "gone")]
    p = spark.createDataFrame([(1, f"{i:02d}", a) for i, (a, _) in enumerate(arms)] + [(2, "99", '{"kind":"whole"}')], "id int, piece string, s string").withColumn("s", F.parse_json("s"))
    got = {r["piece"]: r["content"] for r in selectors.resolved(p, spark.createDataFrame([(1, payload, "shell")], "id int, payload string, tool string"), ["id"], "piece", "s", "payload", "tool").collect()}
    assert {f"{i:02d}": w for i, (_, w) in enumerate(arms) if w not in (None, "gone")} == {k: v for k, v in got.items() if k != "04"} and got["04"].startswith("{")


def test_settings(monkeypatch):
    monkeypatch.setenv("TURNLOOM_RECALL_LIMIT", "9")
    monkeypatch.setenv("TURNLOOM_BATCH_TOKENS", "-4")
    s = Settings.resolve(recall_calls=2)
    assert (s.recall_limit, s.recall_calls, s.batch_tokens, s.verbose) == (9, 2, 180_000, False)
    seen = []
    assert twice(lambda n: seen.append(n) or n, lambda x: x == 2) == 2 and seen == [1, 2]
    with pytest.raises(ValueError):
        twice(lambda n: n, lambda x: False)


def test_trajectories_and_keys(spark):
    df = spark.createDataFrame([("s", 1, "system", "rules"), ("s", 2, "user", " "), ("s", 3, "user", "hi"), ("s", 4, "other", "x")], "session string, n int, role string, text string")
    got = rollouts.trajectory_events(df, "session", "n", "role", "text").orderBy("place").collect()
    assert [(r["place"], r["type"], r["role"]) for r in got] == [(0, "session_meta", None), (1, "response_item", "developer"), (2, "response_item", "user")]
    assert one(spark, rollouts.session_key([F.col("h")], [F.col("b")], [F.lit(None).cast("string")], F.lit("x")), h=" ", b="key") == "key"
    assert one(spark, rollouts.session_key([F.col("h")], [F.col("b")], [F.lit(None).cast("string")], F.lit("x")), h=None, b=None).startswith("anonymous_")
