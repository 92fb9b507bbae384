"""Server-sent event streams: items, text and usage of a streamed response."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import short_hash, usage
from ..operators.prompt import text_at


def parse_sse(lines: DataFrame, line: str = "line") -> DataFrame:
    """Adds `event` (VARIANT) and `type`: the data lines that hold JSON."""
    body = F.trim(F.substr(F.col(line), F.lit(6)))
    e = lines.where(F.startswith(line, F.lit("data:"))).withColumn("event", F.try_parse_json(body)).where("event is not null")
    return e.withColumn("type", F.try_variant_get("event", "$.type", "string"))


def output_items(events: DataFrame, response: str, order: str) -> DataFrame:
    """(response, index, item) of output items, by number: the last write to each index, whatever event carried it."""
    i, item = F.try_variant_get("event", "$.output_index", "int"), F.try_variant_get("event", "$.item", "variant")
    done = events.withColumn("index", i).withColumn("_item", F.to_json(item)).where("index is not null and _item is not null")
    last = done.groupBy(response, "index").agg(F.max_by("_item", order).alias("item"))
    return last.withColumn("item", F.try_parse_json("item"))


def final_response(events: DataFrame, response: str, order: str) -> DataFrame:
    """(response, body): the last response object that an event carries or is, its output being the items streamed, in
    the order of their indexes, if there were any."""
    inner = F.try_variant_get("event", "$.response", "variant")
    kind = lambda p: F.schema_of_variant(F.try_variant_get("event", p, "variant"))
    own = F.startswith(kind("$.output"), F.lit("ARRAY")) | (kind("$.output_text") == "STRING")
    body = F.when(F.startswith(F.schema_of_variant(inner), F.lit("OBJECT")), F.to_json(inner)).when(own, F.to_json("event"))
    last = events.groupBy(response).agg(F.max_by(body, F.when(body.isNotNull(), F.col(order))).alias("body"))
    items = output_items(events, response, order).groupBy(response).agg(F.array_sort(F.collect_list(F.struct("index", F.to_json("item").alias("item")))).alias("items"))
    return last.join(items, response, "left").select(response, "body", F.transform("items", lambda x: x["item"]).alias("items")).where("body is not null")


def text_delta(event: Column) -> Column:
    """What a streamed event adds to a text: its delta, or the text of an event whose type ends in .delta."""
    return F.coalesce(text_at(event, "$.delta"), F.when(F.endswith(text_at(event, "$.type"), F.lit(".delta")), text_at(event, "$.text")), F.lit(""))


def whole_text(response: Column) -> Column:
    """A response's text: output_text, else the texts of all parts of its output, a line each."""
    parts = F.flatten(F.transform(F.try_variant_get(response, "$.output", "array<variant>"), lambda i: F.coalesce(F.try_variant_get(i, "$.content", "array<variant>"), F.expr("cast(array() as array<variant>)"))))
    texts = F.filter(F.transform(parts, lambda p: text_at(p, "$.text")), lambda x: x.isNotNull())
    return F.coalesce(text_at(response, "$.output_text"), F.array_join(texts, "\n"), F.lit(""))


def response_shape(response: Column, most: int = 25) -> Column:
    """What a response holds, for diagnostics: its status, and the different types of its items and of their parts."""
    items = F.try_variant_get(response, "$.output", "array<variant>")
    kinds = lambda a: F.slice(F.array_distinct(F.transform(a, lambda x: F.coalesce(text_at(x, "$.type"), F.lit("unknown")))), F.lit(1), F.lit(most))
    parts = F.flatten(F.transform(items, lambda i: F.coalesce(F.try_variant_get(i, "$.content", "array<variant>"), F.expr("cast(array() as array<variant>)"))))
    return F.struct(text_at(response, "$.status").alias("status"), kinds(items).alias("items"), kinds(parts).alias("parts"))


def assistant_sources(response: Column) -> Column:
    """The assistant's text sources of a response without usable items: its output_text, if that isn't blank."""
    t = text_at(response, "$.output_text")
    own = F.concat(F.coalesce(text_at(response, "$.id"), F.lit("response")), F.lit("_output_text_"), short_hash(F.to_json(response), 20))
    return F.when(F.length(F.trim(t)) > 0, F.struct(F.coalesce(F.nullif(text_at(response, "$.id"), F.lit("")), own).alias("source_id"), F.lit("assistant").alias("kind"), t.alias("payload")))


def response_text(events: DataFrame, response: str, order: str) -> DataFrame:
    """(response, text): the completed text if there is one, else the deltas in order."""
    get = lambda p: F.try_variant_get("event", p, "string")
    delta = F.when(F.col("type") == "response.output_text.delta", get("$.delta"))
    done = F.when(F.col("type") == "response.output_text.done", get("$.text"))
    parts = F.array_sort(F.collect_list(F.when(delta.isNotNull(), F.struct(F.col(order), delta.alias("d")))))
    return events.groupBy(response).agg(F.coalesce(F.max_by(done, F.when(done.isNotNull(), F.col(order))), F.array_join(F.transform(parts, lambda p: p["d"]), "")).alias("text"))


def response_usage(events: DataFrame, response: str, order: str) -> DataFrame:
    """(response, input, output, cached, total): the last usage reported."""
    u = F.to_json(F.try_variant_get("event", "$.response.usage", "variant"))
    last = events.groupBy(response).agg(F.max_by(u, F.when(u.isNotNull() & (u != "null"), F.col(order))).alias("u"))
    return last.select(response, usage(F.try_parse_json("u")).alias("u")).select(response, "u.*")


def synthesize(items: DataFrame, response: str, order: str, item: str = "item") -> DataFrame:
    """(response, body): an event stream that adds and finishes each item, then completes. The stream is the product, so its items meet."""
    event = lambda kind: F.concat(F.lit(f'event: {kind}\ndata: {{"type":"{kind}","output_index":'), F.col(order).cast("string"), F.lit(',"item":'), F.to_json(F.col(item)), F.lit("}\n\n"))
    line = F.concat(event("response.output_item.added"), event("response.output_item.done"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), line.alias("l")))), lambda x: x["l"])
    return items.groupBy(response).agg(F.concat(F.array_join(lines, ""), F.lit('event: response.completed\ndata: {"type":"response.completed"}\n\ndata: [DONE]\n\n')).alias("body"))


def json_object(text: str) -> object:
    """A JSON value inside a text: fenced, or from the outermost braces or brackets; null if there is none."""
    c = F.col(text)
    fenced = F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)```", 1)
    braces, brackets = F.regexp_extract(c, r"(?s)(\{.*\})", 1), F.regexp_extract(c, r"(?s)(\[.*\])", 1)
    return F.coalesce(F.try_parse_json(c), *[F.try_parse_json(F.nullif(x, F.lit(""))) for x in (fenced, braces, brackets)])
