"""Logs that grow: lines by byte ranges, as a batch from a manifest of ranges and as a stream with byte offsets.

Files are read through pyarrow's file systems (local, HDFS, object stores), on the executors; the driver lists files and looks at the
end of those that changed.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

#: Bytes of a file that a task reads, and of one read.
SPLIT, READ = 64 << 20, 1 << 20
#: Bytes before an offset that tell a grown file from a rewritten one.
MARK = 64


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    path = path.replace("s3a://", "s3://", 1)  # one store, by the name it has here
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path.removeprefix("file:"))


def lines(fs: pafs.FileSystem, path: str, start: int, end: int, first: int) -> Iterator[tuple[int, bytes]]:
    """(offset, line) of the whole lines that start in [start, end) of a file whose range begins at `first`.

    A split in the middle of a range leaves the line that it cuts to the split before, which reads on beyond its end until that line ends. Line feeds
    end lines; a carriage return before one belongs to it; what follows the last line feed is no whole line.
    """
    with fs.open_input_file(path) as f:
        skip = start != first
        at = start - skip
        f.seek(at)
        held: list[bytes] = []
        while at < end:
            block = f.read(READ)
            if not block:
                return
            held.append(block)
            if b"\n" not in block:
                continue
            parts = b"".join(held).split(b"\n")
            held = [parts.pop()]
            for line in parts:
                # The first line of a later split begins before it, if only with the line feed before it.
                if not skip:
                    if at >= end:
                        return
                    yield at, line[:-1] if line.endswith(b"\r") else line
                skip = False
                at += len(line) + 1


def text(line: bytes) -> str:
    return line.decode("utf-8", "replace")


def read_ranges(ranges: DataFrame, split: int = SPLIT, flag: str | None = None) -> DataFrame:
    """(file, start, line) of the whole lines that start in each range (file, start, end); `start` is then the line's own. `flag` is a boolean
    column of the ranges that their lines get too.

    Long ranges are split, and splits are dealt evenly to tasks, so that one long log is read by many. Ranges are in bytes and begin where
    a line does. A range beyond the end of its file gives what is there; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [("file", pa.string()), ("start", pa.int64()), ("line", pa.string()), *([(flag, pa.bool_())] if flag else [])]
        names, schema = [f[0] for f in fields], pa.schema(fields)
        for b in batches:
            for r in b.to_pylist():
                rows: list[tuple] = []
                more = (r[flag],) if flag else ()
                size = 0
                for at, line in lines(*opened(r["file"]), r["at"], min(r["at"] + split, r["end"]), r["start"]):
                    rows.append((r["file"], at, text(line), *more))
                    size += len(line)
                    if len(rows) >= 10_000 or size >= 8 * READ:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], names)

    spark = ranges.sparkSession
    own = [flag] if flag else []
    cut = ranges.where("end > start").select("file", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), *own)
    cut = cut.select("file", "start", "end", *own, F.explode(F.sequence(F.col("start"), F.col("end") - 1, F.lit(split))).alias("at"))
    return cut.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), "file", "at").mapInArrow(run, "file string, start long, line string" + (f", {flag} boolean" if flag else ""))


def attached_lines(files: DataFrame, attached: DataFrame) -> DataFrame:
    """(file, is_new, start, line): what there is to read of attached files (file, start, is_new; see rollouts.attached), given
    their lengths (file, bytes). Consumers order by (is_new descending, file, start): new files come first."""
    manifest = attached.join(files.select("file", F.col("bytes").alias("end")), "file")
    # The lines come with the flag: in a join they would be taken for as few bytes as their ranges, and be broadcast.
    return read_ranges(manifest.select("file", "start", "end", "is_new"), flag="is_new").select("file", "is_new", "start", "line")


def mark(f: pa.NativeFile, at: int) -> int:
    begin = max(0, at - MARK)
    f.seek(begin)
    return zlib.crc32(f.read(at - begin))


class Range(InputPartition):
    def __init__(self, file: str, start: int, end: int, first: int):
        self.file, self.start, self.end, self.first = file, start, end, first


class TailReader(DataSourceStreamReader):
    """Offsets map a file to [bytes read, checksum of the last of them].

    An offset ends at a line feed, so a half line is left until it is whole. A file that is shorter than what was read of it, or has other bytes
    at that place, was truncated and begins anew. Lines that a truncation took before they were read are gone. Nothing is kept between
    triggers but a cache of files that have not changed, so a restart goes on from the last offset.
    """

    def __init__(self, folder: str, suffix: str, split: int):
        self.folder, self.suffix, self.split = folder, suffix, split
        self.seen: dict[str, tuple] = {}

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        fs, root = opened(self.folder)
        there = fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True))
        now = {}
        for i in there:
            if i.type == pafs.FileType.File and i.path.endswith(self.suffix):
                was = self.seen.get(i.path)
                now[i.path] = was if was and was[:2] == (i.size, i.mtime_ns) else (i.size, i.mtime_ns, self.whole(fs, i.path, i.size))
        self.seen = now
        return {path: x[2] for path, x in sorted(now.items())}

    def whole(self, fs: pafs.FileSystem, path: str, size: int) -> list[int]:
        """The end of a file's last whole line, looked for from the end, and the checksum there."""
        with fs.open_input_file(path) as f:
            end = size
            while end > 0:
                begin = max(0, end - READ)
                f.seek(begin)
                at = f.read(end - begin).rfind(b"\n")
                if at >= 0:
                    return [begin + at + 1, mark(f, begin + at + 1)]
                end = begin
            return [0, 0]

    def partitions(self, start: dict, end: dict) -> list[Range]:
        fs, _ = opened(self.folder)
        out = []
        for path, (to, _) in sorted(end.items()):
            begin, was = start.get(path, (0, 0))
            if begin and end[path] != start[path]:
                with fs.open_input_file(path) as f:
                    begin = begin if begin <= to and mark(f, begin) == was else 0
            elif begin:
                continue
            out += [Range(path, at, min(at + self.split, to), begin) for at in range(begin, to, self.split)]
        return out or [Range("", 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[tuple[str, int, str]]:
        if partition.file:
            for at, line in lines(opened(self.folder)[0], partition.file, partition.start, partition.end, partition.first):
                yield partition.file, at, text(line)

    def commit(self, end: dict) -> None:
        pass


class LogTail(DataSource):
    """Source `log_tail` of options path, suffix (.jsonl) and split (bytes): a stream (file, start, line) of files that appear, grow and shrink."""

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return "file string, start long, line string"

    def streamReader(self, schema: StructType) -> TailReader:  # noqa: N802
        return TailReader(self.options["path"], self.options.get("suffix", ".jsonl"), int(self.options.get("split", SPLIT)))


def tailed(spark: SparkSession, folder: str, suffix: str = ".jsonl", split: int = SPLIT) -> DataFrame:
    """A stream (file, start, line) of the whole lines of the text files below a folder, each once, as they are written."""
    spark.dataSource.register(LogTail)
    return spark.readStream.format("log_tail").option("path", folder).option("suffix", suffix).option("split", str(split)).load()
