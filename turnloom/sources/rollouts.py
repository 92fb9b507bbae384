"""Session logs: JSON lines, and the items, sources and usage in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.prompt import text_at
from ..functions.text import estimated_tokens, first_filled, short_hash, stable_json, tool_payload, usage


def read_lines(spark: SparkSession, path: str, glob: str = "*.jsonl") -> DataFrame:
    """(file, bytes, modified, line) of every line below a folder."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"), F.col("_metadata.file_modification_time").alias("modified"), F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("line"))


def parse_events(lines: DataFrame, line: str = "line") -> DataFrame:
    """Adds `event`, a VARIANT; blank lines and lines that aren't a JSON object are left out."""
    e = lines.withColumn("event", F.try_parse_json(F.nullif(F.trim(line), F.lit(""))))
    return e.where(F.startswith(F.schema_of_variant("event"), F.lit("OBJECT")))


def events(parsed: DataFrame) -> DataFrame:
    """The envelope's fields: timestamp, type, payload."""
    text = lambda p: F.try_variant_get("event", p, "string")
    return parsed.withColumns({"ts": F.try_to_timestamp(text("$.timestamp")), "type": text("$.type"), "payload": F.try_variant_get("event", "$.payload", "variant")})


#: Fixed value: bytes within which a file's first line must end to be read as its description.
META_BYTES = 65_536


def session_meta(lines: DataFrame, file: str = "file", order: str = "line_no", line: str = "line") -> DataFrame:
    """(file, session_id, cwd, originator) of files whose first line, of 64 KiB at most, is the session's description."""
    first = lines.groupBy(file).agg(F.min_by(line, order).alias("line")).where(F.octet_length("line") <= META_BYTES)
    e = events(parse_events(first)).where("type = 'session_meta'")
    get = lambda p: F.try_variant_get("payload", p, "string")
    return e.select(file, get("$.id").alias("session_id"), get("$.cwd").alias("cwd"), get("$.originator").alias("originator")).where("session_id is not null")


def latest_session(files: DataFrame, meta: DataFrame, n: int = 8) -> DataFrame:
    """(session_id): that of the newest file with a valid description, among the n newest files."""
    return newest(files, n).join(meta, "file").agg(F.max_by("session_id", F.struct("modified", "file")).alias("session_id"))


def attached(files: DataFrame, meta: DataFrame, known: DataFrame, originator: str, cwd: str) -> DataFrame:
    """(file, start): files to tail, those of one originator and folder. A new one from its start, first; a known one
    from the bytes read before if it has grown, from its start if it has shrunk."""
    mine = files.join(meta.where((F.col("originator") == originator) & (F.col("cwd") == cwd)).select("file"), "file", "left_semi")
    f = mine.join(known.select("file", F.col("bytes").alias("_seen")), "file", "left").where(F.col("_seen").isNull() | (F.col("bytes") != F.col("_seen")))
    return f.select("file", F.when(F.col("_seen").isNull() | (F.col("bytes") < F.col("_seen")), 0).otherwise(F.col("_seen")).cast("long").alias("start"), F.col("_seen").isNull().alias("is_new"))


def framed(chunks: DataFrame, stream: str, order: str, text: str) -> DataFrame:
    """(stream, line_no, line, whole) of a stream that arrives in chunks: lines may span chunks, what follows the last
    line feed is a line that isn't whole yet. A chunk's parts have the numbers of its lines by a running count of line feeds, so
    only the parts of one line meet."""
    w = Window.partitionBy(stream).orderBy(order)
    cut = chunks.select(stream, order, F.split(F.coalesce(text, F.lit("")), "\n").alias("_p")).withColumn("_n", (F.size("_p") - 1).cast("long"))
    cut = cut.withColumn("_before", F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_all", F.sum("_n").over(Window.partitionBy(stream)))
    parts = cut.select(stream, order, "_before", "_all", F.posexplode("_p").alias("_i", "_t")).withColumn("line_no", F.col("_before") + F.col("_i"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), F.col("_t").alias("t")))), lambda x: x["t"]), "")
    lines = parts.groupBy(stream, "line_no", "_all").agg(joined.alias("line"))
    return lines.select(stream, "line_no", F.regexp_replace("line", "\r$", "").alias("line"), (F.col("line_no") < F.col("_all")).alias("whole")).where("whole or line <> ''")


def discovered(files: DataFrame, file: str = "file") -> DataFrame:
    """Adds condition, task and kind, from paths .../condition/task/kind.json; other paths are left out."""
    part = lambda i: F.regexp_extract(file, r"([^/]+)/([^/]+)/([^/]+)\.jsonl?$", i)
    return files.withColumns({"condition": part(1), "task": part(2), "kind": part(3)}).where("kind <> ''")


def with_default_thread(events: DataFrame, log: str, order: list[str], thread: str) -> DataFrame:
    """Events without a thread id get the latest one named before them in their log."""
    w = Window.partitionBy(log).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return events.withColumn(thread, F.last(thread, ignorenulls=True).over(w))


def newest(files: DataFrame, n: int = 8) -> DataFrame:
    """The n files changed last."""
    return files.select("file", "modified").distinct().orderBy(F.desc("modified"), "file").limit(n)


def usage_records(e: DataFrame, session: str, order: str) -> DataFrame:
    """(session, order, input, output, cached, total) of token counts in a log."""
    u = usage(F.try_variant_get("payload", "$.info.last_token_usage", "variant")).alias("u")
    return e.where("type = 'event_msg'").where(F.try_variant_get("payload", "$.type", "string") == "token_count").select(session, order, u).select(session, order, "u.*")


def message_text(item: Column) -> Column:
    """A message's content: its text, or the texts of its parts, a line each; the item as JSON if there is none."""
    parts = F.transform(F.try_variant_get(item, "$.content", "array<variant>"), lambda p: F.try_variant_get(p, "$.text", "string"))
    joined = F.array_join(F.filter(parts, lambda x: x.isNotNull()), "\n")
    plain = F.when(~F.startswith(F.schema_of_variant(F.try_variant_get(item, "$.content", "variant")), F.lit("ARRAY")), F.try_variant_get(item, "$.content", "string"))
    return F.coalesce(plain, F.nullif(joined, F.lit("")), stable_json(F.to_json(item)))


def request_sources(items: DataFrame, request: str, order: str, item: str = "item") -> DataFrame:
    """Typed sources of request items: (request, order, source_id, kind, tool, payload).

    Tool outputs take the name of the call with the same id (the last one). Instructions, and the memory block that
    a rewritten request carries, are no sources. An item without an id is known by its content and place, so
    that equal items of a request stay apart.
    """
    v = F.col(item)
    get = lambda p: F.try_variant_get(v, p, "string")
    i = items.withColumns({"_type": F.coalesce(get("$.type"), F.lit("message")), "_role": get("$.role"), "_call": get("$.call_id"), "_name": get("$.name"), "_id": get("$.id")})
    output = F.col("_type").endswith("_output")
    call = F.col("_type").endswith("_call") & ~output
    kind = F.when(output, "tool").when(call, "tool_call").when(F.col("_type") == "reasoning", "assistant").when(F.col("_role").isin("user", "assistant"), F.col("_role"))
    i = i.withColumn("kind", kind).where("kind is not null")
    names = i.where(call & F.col("_call").isNotNull() & F.col("_name").isNotNull()).groupBy(request, "_call").agg(F.max_by("_name", order).alias("_called"))
    i = i.join(names, [request, "_call"], "left").withColumn("tool", F.coalesce("_name", "_called"))
    text = F.coalesce(get("$.output"), F.to_json(F.try_variant_get(v, "$.output", "variant")))
    payload = F.when(output, tool_payload("tool", text)).when(call, stable_json(F.to_json(v))).when(F.col("_type") == "reasoning", stable_json(F.to_json(v))).otherwise(message_text(v))
    own = F.coalesce("_id", F.when(call, F.concat(F.lit("tool_call:"), "_call")), F.col("_call"), F.concat(F.lit("input_"), F.col(order).cast("string"), F.lit("_"), short_hash(F.to_json(v), 20)))
    return i.select(request, order, own.alias("source_id"), "kind", "tool", payload.alias("payload"))


def input_items(body: Column) -> Column:
    """A request's input as an array of JSON items: an array's elements, a text as a user's message, an object by itself, else none."""
    v = F.try_variant_get(body, "$.input", "variant")
    kind = F.schema_of_variant(v)
    text = F.regexp_replace(F.to_json(F.struct(F.try_variant_get(body, "$.input", "string").alias("t"))), r'(?s)^\{"t":(.*)\}$', "$1")
    message = F.concat(F.lit('{"content":[{"text":'), text, F.lit(',"type":"input_text"}],"role":"user","type":"message"}'))
    return (
        F.when(F.startswith(kind, F.lit("ARRAY")), F.transform(F.try_variant_get(body, "$.input", "array<variant>"), lambda x: F.to_json(x)))
        .when(kind == "STRING", F.array(message))
        .when(F.startswith(kind, F.lit("OBJECT")), F.array(F.to_json(v)))
        .otherwise(F.expr("cast(array() as array<string>)"))
    )


def described(item: Column, index: Column) -> Column:
    """(ref, type, role, is_instruction, is_memory) of an input item (VARIANT)."""
    get = lambda p: F.try_variant_get(item, p, "string")
    role = get("$.role")
    ref = F.coalesce(get("$.id"), get("$.call_id"), F.concat(F.lit("input_"), short_hash(F.to_json(item), 20)))
    content = F.coalesce(F.array_join(F.transform(F.try_variant_get(item, "$.content", "array<variant>"), lambda p: F.coalesce(F.try_variant_get(p, "$.text", "string"), F.lit(""))), "\n"), get("$.content"), F.lit(""))
    message = F.coalesce(get("$.type"), F.lit("")) == "message"
    return F.struct(
        index.alias("index"), ref.alias("ref"), get("$.type").alias("type"), role.alias("role"), (message & F.coalesce(role.isin("system", "developer"), F.lit(False))).alias("is_instruction"),
        F.coalesce(message & (role == "developer") & F.contains(content, F.lit("[memory]")), F.lit(False)).alias("is_memory"),
    )


def request_metrics(body: Column) -> Column:
    """Model, stream, size and item counts of a request (VARIANT); items are those of an input array, or one text."""
    items = F.when(F.startswith(F.schema_of_variant(F.try_variant_get(body, "$.input", "variant")), F.lit("ARRAY")), F.try_variant_get(body, "$.input", "array<variant>"))
    get = lambda x, p: F.try_variant_get(x, p, "string")
    said = lambda r: F.coalesce(F.size(F.filter(items, lambda x: (get(x, "$.type") == "message") & (get(x, "$.role") == r))), F.lit(0))
    out = F.coalesce(F.size(F.filter(items, lambda x: get(x, "$.type").rlike(r"^function_call_output$|_tool_call_output$"))), F.lit(0))
    text = F.to_json(body)
    return F.struct(
        text_at(body, "$.model").alias("model"), F.try_variant_get(body, "$.stream", "boolean").alias("stream"), F.octet_length(text).cast("long").alias("bytes"), estimated_tokens(text).alias("tokens"),
        F.coalesce(F.size(items), F.when(text_at(body, "$.input").isNotNull(), 1), F.lit(0)).alias("items"), said("user").alias("user"), said("assistant").alias("assistant"), said("developer").alias("developer"), out.alias("tool_outputs"),
    )


def session_key(headers: list[Column], body: list[Column], metadata: list[Column], fallback: Column) -> Column:
    """The first filled of a request's session ids; a hash of the fallback if none is."""
    return F.coalesce(first_filled(*headers, *body, *metadata), F.concat(F.lit("anonymous_"), short_hash(fallback, 16)))


def phase_events(messages: DataFrame, usages: DataFrame, session: str, phase: str, order: str, role: str, text: str, usage_order: str, tokens: str) -> DataFrame:
    """(session, place, type, role, text, tokens) of a trajectory in phases: a transition before each phase but the first,
    and the n-th usage record with the n-th assistant message."""
    ok = messages.where(F.col(role).isin("system", "user", "assistant", "tool") & (F.length(F.trim(F.col(text))) > 0))
    n = F.row_number().over(Window.partitionBy(session, role).orderBy(phase, order))
    told = usages.select(session, F.row_number().over(Window.partitionBy(session).orderBy(usage_order)).alias("_n"), F.col(tokens).cast("long").alias("tokens"))
    said = ok.withColumn("_n", F.when(F.col(role) == "assistant", n)).join(told, [session, "_n"], "left")
    rows = said.select(session, F.col(phase).alias("_p"), F.lit(1).alias("_k"), F.col(order).alias("_o"), F.lit("response_item").alias("type"), F.when(F.col(role) == "system", "developer").otherwise(F.col(role)).alias("role"), F.col(text).alias("text"), "tokens")
    first = messages.groupBy(session).agg(F.min(phase).alias("_first"))
    marks = messages.select(session, F.col(phase).alias("_p")).distinct().join(first, session).where(F.col("_p") > F.col("_first"))
    marks = marks.select(session, "_p", F.lit(0).alias("_k"), F.lit(0).cast("long").alias("_o"), F.lit("phase").alias("type"), F.lit(None).cast("string").alias("role"), F.col("_p").cast("string").alias("text"), F.lit(None).cast("long").alias("tokens"))
    place = F.row_number().over(Window.partitionBy(session).orderBy("_p", "_k", "_o"))
    return rows.unionByName(marks).select(session, place.cast("long").alias("place"), "type", "role", "text", "tokens")


def yaml_trajectory(text: str) -> list[dict]:
    """Messages (phase, place, role, text) of a trajectory file in YAML; needs the yaml package."""
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading YAML trajectories needs the yaml package") from e
    doc = yaml.safe_load(text) or {}
    out = []
    for i, phase in enumerate(doc.get("phases") or [doc]):
        for m in phase.get("messages") or []:
            out.append({"phase": i, "place": len(out), "role": str(m.get("role", "")), "text": str(m.get("content", ""))})
    return out


def trajectory_events(messages: DataFrame, session: str, order: str, role: str, text: str) -> DataFrame:
    """(session, place, type, role, text) of a message list: a session's description first, then filled messages of known roles; system becomes developer."""
    ok = messages.where(F.col(role).isin("system", "user", "assistant", "tool") & (F.length(F.trim(F.col(text))) > 0))
    rows = ok.select(session, F.row_number().over(Window.partitionBy(session).orderBy(order)).cast("long").alias("place"), F.lit("response_item").alias("type"), F.when(F.col(role) == "system", "developer").otherwise(F.col(role)).alias("role"), F.col(text).alias("text"))
    meta = messages.select(session).distinct().select(session, F.lit(0).cast("long").alias("place"), F.lit("session_meta").alias("type"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    return meta.unionByName(rows)


def item_tokens(items: DataFrame, item: str = "item") -> DataFrame:
    return items.withColumn("tokens", estimated_tokens(F.to_json(F.col(item))))
