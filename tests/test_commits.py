"""Commits: one of two writers wins, readers see whole versions, repeated batches change nothing."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from turnloom.sources import commits, store

STATE = "session string, round int, v string"


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_two_writers_of_one_version(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    head = commits.commit(spark, path, spark.createDataFrame([("a", 1, "x")], STATE), None, key="session")
    ok = commits.commit(spark, path, spark.createDataFrame([("b", 1, "first")], STATE), head)
    with pytest.raises(commits.Conflict):
        commits.commit(spark, path, spark.createDataFrame([("b", 1, "second")], STATE), head)
    assert rows(commits.read(spark, path), "session", "v") == [("a", "x"), ("b", "first")]
    assert commits.versions(spark, path) == [0, 1] and len(list((tmp_path / "t" / "data").iterdir())) == 2
    assert rows(commits.read(spark, path, head=head), "session") == [("a",)]
    assert rows(commits.read(spark, path, head=ok, keys=["b", "nobody"]), "v") == [("first",)]


@pytest.mark.parametrize("link", [True, False])
def test_a_name_is_taken_once(spark, tmp_path, link):
    path = f"file://{tmp_path}/{link}/m.json"
    with ThreadPoolExecutor(8) as pool:
        got = list(pool.map(lambda i: commits.create_once(spark, path, f"{i}", link), range(8)))
    if link:
        assert got.count(True) == 1 and (tmp_path / "True" / "m.json").read_text() == str(got.index(True))
    assert not commits.create_once(spark, path, "late", link)
    assert not [p for p in (tmp_path / str(link)).iterdir() if p.name.startswith(".") and not p.name.endswith(".crc")]


def test_concurrent_archives_lose_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/a"
    parts = [spark.createDataFrame([("s", f"x{(i + j) % 12}", f"from {i}") for j in range(8)], "session string, source string, text string") for i in range(4)]
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda d: store.archive(spark, d, path, ["session", "source"]), parts))
    got = commits.read(spark, path)
    assert rows(got, "source") == sorted((f"x{i}",) for i in range(11))
    assert len(commits.versions(spark, path)) == 4


def test_a_batch_counts_once(spark, tmp_path):
    state, archive = f"file://{tmp_path}/s", f"file://{tmp_path}/a"
    for batch in (0, 1, 1, 0):
        d = spark.createDataFrame([("a", batch, f"v{batch}")], STATE)
        store.save_state(d, state, batch=("q", batch))
        store.archive(spark, d, archive, ["session", "v"], batch=("q", batch))
    assert commits.versions(spark, state) == commits.versions(spark, archive) == [0, 1]
    assert rows(store.load_state(spark, state), "v") == [("v1",)]
    assert commits.before(spark, state, ("q", 1))["version"] == 0 and commits.before(spark, state, ("q", 0)) is None
    store.save_state(spark.createDataFrame([("b", 1, "other")], STATE), state, batch=("other query", 0))
    assert commits.manifest(spark, state)["batches"] == {"q": 1, "other query": 0}


def test_compaction_keeps_last_states_and_old_readers(spark, tmp_path):
    path = f"file://{tmp_path}/c"
    for r in range(3):
        store.save_state(spark.createDataFrame([("a", r, f"a{r}"), *([("b", r, f"b{r}")] if r < 2 else [])], STATE), path)
    old = commits.manifest(spark, path)
    store.compact_state(spark, path)
    assert rows(commits.read(spark, path), "v") == [("a2",), ("b1",)]
    assert len(commits.manifest(spark, path)["parts"]) == 1 and commits.read(spark, path, head=old).count() == 5


MEMORY = "session string, round int, piece string, seq int, size long, hash string"


def test_memory_is_pruned_and_checked(spark, tmp_path):
    path = f"file://{tmp_path}/m"
    assert store.load_memory(spark, path, MEMORY, "seq", ["hash"]).count() == 0
    pieces = spark.createDataFrame([("a", 1, "p", 1, -5, "h"), ("a", 1, "p", 2, 7, None), ("a", 1, "", 3, 1, "h"), ("b", 1, "q", 1, 1, "h")], MEMORY)
    store.save_memory(pieces, pieces.select("session", "round").distinct(), path, "seq", ["hash"])
    assert rows(store.load_memory(spark, path, MEMORY, "seq", ["hash"]), "session", "piece", "size", "hash") == [("a", "p", 7, "p"), ("b", "q", 1, "h")]
    store.save_memory(pieces.limit(0), spark.createDataFrame([("a", 2)], "session string, round int"), path, "seq", ["hash"])
    assert rows(store.load_memory(spark, path, MEMORY, "seq", ["hash"]), "session") == [("b",)]
    assert rows(store.load_memory(spark, path, MEMORY, "seq", ["hash"], at=1), "session") == [("a",), ("b",)]
    broken = spark.createDataFrame([("c", 1, "p", 1, 1, " ")], MEMORY)
    with pytest.raises(ValueError, match="breaks its rules"):
        store.save_memory(broken, broken.select("session", "round"), path, "seq", ["hash"])
    commits.commit(spark, path, broken, commits.manifest(spark, path))
    with pytest.raises(ValueError, match="breaks its rules"):
        store.load_memory(spark, path, MEMORY, "seq", ["hash"])


def test_status_is_replaced_at_once(spark, tmp_path):
    path = f"file://{tmp_path}/st"
    one = spark.createDataFrame([("a", 0)], "job string, done int")
    assert [store.write_status(one.withColumn("done", F.lit(i)), path) for i in range(3)] == [0, 1, 2]
    assert rows(store.read_status(spark, path), "done") == [(2,)]
