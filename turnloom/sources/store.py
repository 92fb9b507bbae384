"""Tables of sessions: versioned state, append-only archive, logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import non_negative
from ..functions.values import redact
from ..operators.dedupe import dedupe_last
from . import commits


def violations(pieces: DataFrame, session: str, piece: str, required: list[str], tasks: DataFrame | None = None) -> DataFrame:
    """Rows that break a state's rules: an id twice in a session, a required field that is null or blank, a task
    (session, piece) that names a piece which isn't there."""
    twice = pieces.groupBy(session, piece).count().where("count > 1").select(session, piece, F.lit("repeated id").alias("problem"))
    blank = F.lit(False)
    for c in required:
        blank = blank | F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
    out = twice.unionByName(pieces.where(blank).select(session, piece, F.lit("missing field").alias("problem")))
    if tasks is not None:
        out = out.unionByName(tasks.select(session, piece).join(pieces.select(session, piece), [session, piece], "left_anti").select(session, piece, F.lit("unknown piece").alias("problem")))
    return out


def pruned(pieces: DataFrame, session: str, piece: str, order: str) -> DataFrame:
    """A state's pieces as they are kept: the last of each id, sizes not below 0, an id for a missing hash."""
    p = dedupe_last(pieces.where((F.col(piece) != "") & F.col(piece).isNotNull()), [session, piece], order)
    out = p.withColumn("size", non_negative("size")) if "size" in p.columns else p
    return out.withColumn("hash", F.coalesce(F.nullif("hash", F.lit("")), F.col(piece))) if "hash" in p.columns else out


def save_state(state: DataFrame, path: str, session: str = "session", round_: str = "round", batch: tuple[str, int] | None = None) -> None:
    """Commits versions of sessions' states. A version is one (session, round); one that is there already, or twice, is an
    error, and so is another writer's commit meanwhile (commits.Conflict): nothing is visible then. A stream's batch that was
    committed before changes nothing."""
    spark = state.sparkSession
    base = commits.manifest(spark, path)
    if commits.has(base, batch):
        return
    keys = state.select(session, round_)
    again = keys.groupBy(session, round_).count().where("count > 1").select(session, round_)
    again = again.unionByName(keys.join(commits.read(spark, path, keys.schema, base).select(session, round_), [session, round_], "left_semi"))
    if found := again.limit(5).collect():
        raise ValueError(f"versions that exist: {found}")
    commits.commit(spark, path, state, base, key=session, batch=batch)


def load_state(spark: SparkSession, path: str, session: str = "session", round_: str = "round", at: int | None = None, schema: str | None = None) -> DataFrame:
    """Each session's last version, or its last one up to round `at`. A missing table is an empty one, if its schema is given."""
    s = commits.read(spark, path, schema)
    s = s.where(F.col(round_) <= at) if at is not None else s
    last = s.groupBy(session).agg(F.max(round_).alias(round_))
    return s.join(last, [session, round_], "left_semi")


def compact_state(spark: SparkSession, path: str, session: str = "session", round_: str = "round") -> None:
    """Commits a version that holds each session's last state only; readers of earlier versions keep theirs."""
    base = commits.manifest(spark, path)
    if base is not None:
        s = commits.read(spark, path, head=base)
        last = s.groupBy(session).agg(F.max(round_).alias(round_))
        commits.commit(spark, path, s.join(last, [session, round_], "left_semi"), base, replace=True)


def checked(pieces: DataFrame, session: str, piece: str, required: list[str]) -> DataFrame:
    """The pieces, or an error that names some rows which break a memory's rules."""
    if found := violations(pieces, session, piece, required).limit(5).collect():
        raise ValueError(f"memory breaks its rules: {found}")
    return pieces


def save_memory(pieces: DataFrame, versions: DataFrame, path: str, order: str, required: list[str], session: str = "session", round_: str = "round", piece: str = "piece", batch: tuple[str, int] | None = None) -> None:
    """Commits memories: of each version (session, round), a row a piece; pruned and checked first.

    A version's memory may be empty, so each version also has a row without a piece.
    """
    base = commits.manifest(pieces.sparkSession, path)
    if commits.has(base, batch):
        return
    rows = checked(pruned(pieces, session, piece, order), session, piece, required)
    marks = versions.select(session, round_, *[F.lit(None).cast(f.dataType).alias(f.name) for f in pieces.schema if f.name not in (session, round_)])
    commits.commit(pieces.sparkSession, path, rows.unionByName(marks), base, key=session, batch=batch)


def load_memory(spark: SparkSession, path: str, schema: str, order: str, required: list[str], session: str = "session", round_: str = "round", piece: str = "piece", at: int | None = None) -> DataFrame:
    """Each session's last memory, pruned and checked again; empty where there is none."""
    last = load_state(spark, path, session, round_, at, schema)
    return checked(pruned(last, session, piece, order), session, piece, required)


def archive(spark: SparkSession, sources: DataFrame, path: str, keys: list[str], batch: tuple[str, int] | None = None) -> None:
    """Commits the sources that the archive lacks; what is there stays as it is. If another writer comes between, what is
    lacking is looked up again. A stream's batch that was committed before changes nothing."""

    def add(base: dict | None) -> dict:
        if commits.has(base, batch):
            return base
        fresh = sources.dropDuplicates(keys)
        if base is not None:
            fresh = fresh.join(commits.read(spark, path, head=base).select(*keys), keys, "left_anti")
        return commits.commit(spark, path, fresh, base, key=keys[0], batch=batch)

    commits.retried(spark, path, add)


def archived(requests: DataFrame, archive_: DataFrame, session: str, ids: str, source: str) -> DataFrame:
    """Of each request (session, ids) its archived sources in the order asked, `place` from 0; missing ones are skipped."""
    asked = requests.select(session, F.posexplode(ids).alias("place", source))
    return asked.join(archive_, [session, source])


def write_log(events: DataFrame, path: str, body: str = "fields") -> None:
    """Appends events to a log, secrets blanked at every depth of their fields."""
    events.withColumn(body, redact(F.col(body))).write.mode("append").parquet(path)


def write_replay(turns: DataFrame, stats: DataFrame, path: str) -> None:
    """A replay's outputs: its turns and statistics as JSON, its series as CSV."""
    turns.write.mode("overwrite").json(f"{path}/turns")
    stats.write.mode("overwrite").json(f"{path}/stats")
    turns.write.mode("overwrite").option("header", "true").csv(f"{path}/series")


def write_status(status: DataFrame, path: str) -> int:
    """A job's status takes the place of the one before, at once; its version."""
    spark = status.sparkSession
    return commits.retried(spark, path, lambda base: commits.commit(spark, path, status, base, replace=True))["version"]


def read_status(spark: SparkSession, path: str) -> DataFrame:
    """The last complete status."""
    return commits.read(spark, path)


#: What reports of a run hold, by the end of their names.
REPORTS = {".stats.json": "source string, docs long, chars long", ".turns.jsonl": "source string, doc_id long, chars long", ".status.json": "job string, status string, done long"}


def write_reports(rows: DataFrame, path: str, trace: str, suffix: str) -> None:
    """One report of a run, in a folder or file whose name is the run's and the suffix."""
    rows.write.mode("overwrite").json(f"{path}/{trace}{suffix}")


def read_reports(spark: SparkSession, path: str, suffix: str, schema: str | None = None) -> DataFrame:
    """All reports below a folder whose names end in a suffix, with `trace`, the run's name; their fields are those of REPORTS or a schema
    of one's own, and fields that a report lacks are null. None there: no rows."""
    schema = schema or REPORTS[suffix]
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/*{suffix}")
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p):
        return spark.createDataFrame([], f"{schema}, trace string")
    return spark.read.schema(schema).json(f"{path}/*{suffix}").withColumn("trace", F.regexp_extract(F.col("_metadata.file_path"), rf"([^/]+){suffix.replace('.', '[.]')}(/|$)", 1))


def write_report(df: DataFrame, path: str, kind: str = "json") -> None:
    df.write.mode("overwrite").option("header", "true").format(kind).save(path)


def subset(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The wanted rows; an error names some that aren't there."""
    missing = wanted.select(*keys).join(rows.select(*keys), keys, "left_anti").limit(5).collect()
    if missing:
        raise ValueError(f"not found: {missing}")
    return rows.join(wanted.select(*keys), keys, "left_semi")
