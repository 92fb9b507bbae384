"""Findings of round 3: each of these failed before."""

from dataclasses import replace

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from turnloom.llm import cmlm
from turnloom.operators import fold
from turnloom.plans import QUERIES, SQL
from turnloom.streaming import observed, tail


def test_turns_of_a_thread_in_several_arrow_batches(spark, tmp_path):
    """Events of one micro-batch come unsorted, and a few to an Arrow batch: turns are those of all of them, by time."""
    kinds = {0: "signup", 3: "purchase", 5: "signup", 6: "signup", 9: "purchase"}
    events = [(u, s, u * 100 + s, kinds.get(s, "view")) for s in (9, 2, 5, 7, 0, 8, 3, 1, 6, 4) for u in (1, 2, 3)]
    df = spark.createDataFrame(events, "user_id long, s long, event_id long, event_type string").select("user_id", F.timestamp_seconds("s").alias("ts"), "event_id", "event_type")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        live = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
        got = observed.run_available(observed.observed_turns_stream(live, F.col("event_type") == "signup", F.col("event_type") == "purchase"), "turns").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    assert sorted(map(tuple, got)) == [x for u in (1, 2, 3) for x in ((u, 1, 4, u * 100, u * 100 + 3), (u, 2, 4, u * 100 + 6, u * 100 + 9))]


def _against_sql(spark, folder, name):
    """Rows of a query and of its SQL over the tables in a folder."""
    db = duckdb.connect()
    db.execute("SET timezone = 'UTC'")
    for f in folder.glob("*.parquet"):
        db.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    got = QUERIES[name](spark, str(folder))
    cols = sorted(got.columns)
    want = db.execute(f"SELECT {', '.join(cols)} FROM ({SQL[name]})").fetchall()
    return sorted(map(tuple, got.select(*cols).collect()), key=str), sorted(want, key=str)


def test_waiters_whose_time_ends_in_the_newest_second(spark, tmp_path):
    """The newest event is 0.9 s into the second in which user 1's waiter would give up: it still waits; user 2's, a second older, doesn't."""
    end = 6 * 3600 + 1
    rows = [(0, 1, 0.2, "view"), (1, 2, -0.8, "view"), (2, 3, end + 0.9, "purchase")]
    table = pa.table({"event_id": [r[0] for r in rows], "user_id": [r[1] for r in rows], "ts": pa.array([int((1_700_000_000 + r[2]) * 1_000_000) for r in rows], pa.timestamp("us")), "event_type": [r[3] for r in rows]})
    pq.write_table(table, tmp_path / "events.parquet")
    got, want = _against_sql(spark, tmp_path, "waiting_turns")
    assert got == want == [(1_699_999_999, None, 2)]


def test_needles_in_strings_and_not_in_their_escapes(spark, tmp_path):
    """A line feed before `the ` is written as `\\nthe `, which holds no `nthe `; a source's name may hold a quote; a short item's part is empty."""
    docs = [(0, "first line\nthe second line", "src1"), (1, 'it says "source":"src1" in its text', "src2"), (2, None, 'a"1'), (3, "", "src3"), (4, None, None), (5, "with nthe in it", "src1")]
    pq.write_table(pa.table({"doc_id": pa.array([d[0] for d in docs], pa.int64()), "text": pa.array([d[1] for d in docs]), "source": pa.array([d[2] for d in docs])}), tmp_path / "documents.parquet")
    pq.write_table(pa.table({"item_id": [0, 1], "text": ["abcdefghijklmnopqrsnthe xyz", "short one"]}), tmp_path / "benchmark.parquet")
    got, want = _against_sql(spark, tmp_path, "leaf_containment")
    assert got == want and (5, "nthe ") in got and (2, '"source":"a"1"') in got and (3, "") in got


def test_a_fold_that_nobody_goes_on_from_holds_no_repeated_ids(spark):
    """Pieces that repeat go under others: without states their ids are counted, not held, and all else is the same."""
    a, b = (kind("a", "s", "user", 1, "h") for kind in (fold.Piece, fold.Bare))
    assert a.absorb(replace(a, id="b")).duplicates == ("b",) and replace(b, seq=1).absorb(replace(b, id="b")).duplicates == ()
    rows = [(i % 3, i // 12 + 1, i, f"m{i:04d}", ("user", "tool", "assistant")[i % 5 % 3], i * 7 % 300 + 1, f"h{i % 13}") for i in range(900)]
    pieces = spark.createDataFrame(rows, "session long, round long, place long, id string, kind string, size long, hash string").withColumn("source", F.col("id"))
    told = pieces.select("session", "round").distinct().withColumn("told", F.expr("case when round % 5 = 0 then 'new' when round % 7 = 0 then 'revive:-1' else 'same' end"))
    for name in ("retain-all", "keep-none", "drop-tools", "retain-recent", "cap-bytes"):
        whole, bare = (fold.replay(pieces, name, "session", told, with_state=p) for p in (True, False))
        got = bare.collect()
        assert all(r["state"] is None for r in got)
        assert sorted(map(str, whole.drop("state").collect())) == sorted(str(r) for r in bare.drop("state").collect()) and len(got) == 225


def test_all_training_texts_teach_the_mixing_weights(spark):
    """Of 8,192 texts and more every second one, or fewer, gave the weights: those left out made no difference."""
    rng = np.random.default_rng(4)
    odd = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1
    docs = spark.createDataFrame([(i, " ".join(f"w{int(60 * x**2)}" for x in rng.random(6))) for i in range(9_000)], "doc_id long, text string")
    docs = docs.select("doc_id", F.when(odd, F.concat(F.lit("w0 w1 w2 w3 "), "text")).otherwise(F.col("text")).alias("text"))
    counts = cmlm.materialize(cmlm.token_counts(docs), "counts")
    v = cmlm.vocabulary(counts, 200, 3)
    train = cmlm.encode(docs, v).select("doc_id", "symbols")
    start = []
    for part in (train, train.where(~odd)):
        model = cmlm.fit(train, counts, v)
        start.append(cmlm.fit_gates(part, counts, model)[0])
    assert np.isfinite(start).all() and np.abs(start[0] - start[1]).max() > 0.01


def test_attached_lines_are_not_joined(spark, tmp_path):
    """Lines were joined to their files' flags, estimated at the size of the ranges: Spark broadcast the lines through the driver."""
    (tmp_path / "a.jsonl").write_text("one\ntwo\n")
    (tmp_path / "b.jsonl").write_text("three\nfour\n")
    files = spark.createDataFrame([(f"{tmp_path}/a.jsonl", 8), (f"{tmp_path}/b.jsonl", 11)], "file string, bytes long")
    attached = spark.createDataFrame([(f"{tmp_path}/a.jsonl", 0, True), (f"{tmp_path}/b.jsonl", 6, False)], "file string, start long, is_new boolean")
    out = tail.attached_lines(files, attached)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("Join")
    assert sorted((r["file"][-7:], r["is_new"], r["start"], r["line"]) for r in out.collect()) == [("a.jsonl", True, 0, "one"), ("a.jsonl", True, 4, "two"), ("b.jsonl", False, 6, "four")]
