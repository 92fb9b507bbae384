"""Lines of growing files: each once, whatever the splits, half lines, truncations and restarts."""

import random

import pyarrow.fs as pafs
import pytest

from turnloom.streaming import tail


def cut(path, ranges, split):
    out = []
    for a, b in ranges:
        for at in range(a, b, split):
            out += list(tail.lines(pafs.LocalFileSystem(), str(path), at, min(at + split, b), a))
    return out


@pytest.mark.parametrize("read", [3, 64, 1 << 20])
def test_splits_give_each_line_once(tmp_path, monkeypatch, read):
    monkeypatch.setattr(tail, "READ", read)
    random.seed(read)
    for _ in range(40):
        body = b"".join(random.choice([b"", b"x", b"long line " * 5, "é漢".encode(), b"\r"]) + b"\n" for _ in range(random.randrange(30))) + random.choice([b"", b"half"])
        (tmp_path / "f").write_bytes(body)
        whole, at, want = body[: body.rfind(b"\n") + 1], 0, []
        for line in whole.split(b"\n")[:-1]:
            want.append((at, line.removesuffix(b"\r")))
            at += len(line) + 1
        for split in (1, 2, 7, 1000):
            assert cut(tmp_path / "f", [(0, len(whole))], split) == want
        if want:
            start = random.choice(want)[0]
            assert cut(tmp_path / "f", [(0, start), (start, len(whole))], 5) == want


def test_ranges_of_a_manifest(spark, tmp_path):
    text = "".join(f"line {i} é\n" for i in range(500))
    (tmp_path / "a.jsonl").write_text(text)
    (tmp_path / "b.jsonl").write_text("one\ntwo\nhalf")
    size = len(text.encode())
    middle = len("".join(f"line {i} é\n" for i in range(200)).encode())
    rows = [(f"file://{tmp_path}/a.jsonl", middle, size, 1), (f"file://{tmp_path}/b.jsonl", 0, 12, 2), (f"file://{tmp_path}/b.jsonl", 5, 5, 3)]
    got = tail.read_ranges(spark.createDataFrame(rows, "file string, start long, end long, line int"), split=37).orderBy("file", "start").collect()
    assert [r["line"] for r in got] == [*(f"line {i} é" for i in range(200, 500)), "one", "two"]
    assert got[0]["start"] == middle
    assert tail.read_ranges(spark.createDataFrame([], "file string, start long, end long")).count() == 0


def test_a_stream_follows_growth_half_lines_and_truncation(spark, tmp_path):
    logs, out, progress = tmp_path / "logs" / "deep", f"file://{tmp_path}/out", f"file://{tmp_path}/progress"
    logs.mkdir(parents=True)

    def run():
        """A query of its own each time, so that each trigger is a restart too."""
        q = tail.tailed(spark, f"file://{tmp_path}/logs", split=9).writeStream.format("parquet").option("path", out).option("checkpointLocation", progress).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted((r["file"].rsplit("/")[-1], r["start"], r["line"]) for r in spark.read.parquet(out).collect())

    a, b = logs / "a.jsonl", logs / "b.jsonl"
    a.write_bytes("eins\nzwei é\nhal".encode())
    b.write_bytes(b"first\nsecond\nthird\n")
    (logs / "other.txt").write_bytes(b"no\n")
    want = [("a.jsonl", 0, "eins"), ("a.jsonl", 5, "zwei é"), ("b.jsonl", 0, "first"), ("b.jsonl", 6, "second"), ("b.jsonl", 13, "third")]
    assert run() == want
    assert run() == want  # nothing new
    with a.open("ab") as f:
        f.write(b"f line\nmore\nhal")
    b.write_bytes(b"new\n")  # truncated
    (logs / "c.jsonl").write_bytes(b"late file\r\n")
    want = sorted([*want, ("a.jsonl", 13, "half line"), ("a.jsonl", 23, "more"), ("b.jsonl", 0, "new"), ("c.jsonl", 0, "late file")])
    assert run() == want
    b.write_bytes(b"xyz\nlonger than before\n")  # rewritten, and longer
    with a.open("ab") as f:
        f.write(b"f\n")
    want = sorted([*want, ("b.jsonl", 0, "xyz"), ("b.jsonl", 4, "longer than before"), ("a.jsonl", 28, "half")])
    assert run() == want
