"""Requests with their memory block, and what observers report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import fnv1a
from .predicates import synthetic_memory
from .rounds import derived_prompt


def rewritten(items: DataFrame, memory: DataFrame, session: str, order: str, role: str, text: str) -> DataFrame:
    """(session, place, role, text) of each session's new request: instructions, the memory block, the current round.

    A memory block that the request carries already is left out first. Sessions without memory get no block. Places
    come from a rank over ids alone; texts move with their row, not gathered by session.
    """
    own = items.where(~synthetic_memory(F.col(role), F.col(text)))
    kept = derived_prompt(own, session, order, F.col(role).isin("system", "developer"), F.col(role) == "user").where("kept")
    instruction = F.col(role).isin("system", "developer")
    rows = kept.select(session, F.when(instruction, 0).otherwise(2).alias("part"), F.col(order).alias("at"), F.col(role).alias("role"), F.col(text).alias("text"))
    block = memory.select(session, F.lit(1).alias("part"), F.lit(0).cast("long").alias("at"), F.lit("developer").alias("role"), F.col("text"))
    both = rows.unionByName(block.join(items.select(session).distinct(), session, "left_semi"))
    place = F.row_number().over(Window.partitionBy(session).orderBy("part", "at", "role", "text")).cast("int") - 1
    return both.select(session, place.alias("place"), "role", "text")


def input_refs(items: DataFrame, session: str, order: str, role: str, text: str) -> DataFrame:
    """(session, order, kept): which input items a rewritten request keeps; the memory block it carried is neither kept nor dropped."""
    own = items.where(~synthetic_memory(F.col(role), F.col(text)))
    kept = derived_prompt(own, session, order, F.col(role).isin("system", "developer"), F.col(role) == "user")
    return kept.select(session, order, "kept")


def with_recall_tool(tools: Column, gap: Column, name: str = "recall") -> Column:
    """A request's tool names with the recall tool, if something can be recalled and it isn't there; always an array."""
    tools = F.coalesce(tools, F.expr("cast(array() as array<string>)"))
    return F.when((gap > 0) & ~F.array_contains(tools, name), F.concat(tools, F.array(F.lit(name)))).otherwise(tools)


#: The marks around a selected segment and for characters left out, which renderings of other origin hold too.
SEGMENT, GAP = ("<segment start=", " end=", ">", "</segment>"), ("<gap omittedChars=", " />")


def selection_text(segments: Column, whole: Column) -> Column:
    """Selected segments (start, end, text) in order, each between marks, and a mark for what is left out between them."""
    kind = "struct<at:int,n:int,parts:array<string>>"
    gap = lambda n: F.concat(F.lit(GAP[0]), n.cast("string"), F.lit(GAP[1]))
    out = F.aggregate(
        F.array_sort(segments),
        F.expr(f"cast(named_struct('at', 0, 'n', 0, 'parts', array()) as {kind})"),
        lambda acc, s: F.struct(
            s["end"].cast("int").alias("at"), (acc["n"] + 1).alias("n"),
            F.concat(
                acc["parts"], F.when((s["start"] > acc["at"]) | (acc["n"] > 0), F.array(gap(F.greatest(F.lit(0), s["start"] - acc["at"])))).otherwise(F.expr("cast(array() as array<string>)")),
                F.array(F.concat(F.lit(SEGMENT[0]), s["start"].cast("string"), F.lit(SEGMENT[1]), s["end"].cast("string"), F.lit(SEGMENT[2])), s["text"], F.lit(SEGMENT[3])),
            ).alias("parts"),
        ).cast(kind),
    )
    done = F.when(out["at"] < whole, F.concat(out["parts"], F.array(gap(whole - out["at"])))).otherwise(out["parts"])
    return F.when(F.size(segments) > 0, F.array_join(done, "\n")).otherwise(F.lit(""))


def selection_bytes(segments: Column) -> Column:
    """Exact UTF-8 bytes of the selected text, without marks."""
    return F.octet_length(F.array_join(F.transform(segments, lambda s: s["text"]), "")).cast("long")


def comparable_text(rendered: Column) -> Column:
    """What two renderings must share to be the same text: the segments of a selection, else the text; null if empty."""
    parts = F.regexp_extract_all(rendered, F.lit(r"(?s)<segment[^>]*>\n?(.*?)\n?</segment>"), F.lit(1))
    return F.nullif(F.when(F.size(parts) > 0, F.array_join(parts, "")).otherwise(rendered), F.lit(""))


def event_summary(event: Column) -> Column:
    """What an observed event says of itself: method, type, thread, turn, item; parsed is false for what is no object."""
    get = lambda *p: F.coalesce(*[text_at(event, x) for x in p])
    return F.struct(
        F.coalesce(F.startswith(F.schema_of_variant(event), F.lit("OBJECT")), F.lit(False)).alias("parsed"), get("$.method").alias("method"), get("$.type").alias("type"), get("$.params.threadId", "$.params.thread.id").alias("thread"),
        get("$.params.turnId", "$.params.turn.id").alias("turn"), get("$.params.itemId", "$.params.item.id").alias("item"), get("$.params.item.type").alias("item_type"), get("$.params.item.status").alias("item_status"),
    )


def text_at(event: Column, path: str) -> Column:
    """The string at a path; null for what is there but no string."""
    v = F.try_variant_get(event, path, "variant")
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(event, path, "string"))


def envelope_event(event: Column) -> Column:
    """The thread, turn or item event that a log's envelope stands for: (type, thread, turn, item, command, output); nulls for others."""
    t, inner, p = text_at(event, "$.type"), text_at(event, "$.payload.type"), lambda k: text_at(event, f"$.payload.{k}")
    said = t == "event_msg"
    output = F.nullif(p("aggregated_output"), F.lit(""))
    type_ = (
        F.when((t == "session_meta") & p("id").isNotNull(), "thread.started")
        .when(said & (inner == "task_started"), "turn.started")
        .when(said & (inner == "task_complete"), "turn.completed")
        .when(said & (inner == "exec_command_end") & output.isNotNull(), "item.completed")
    )
    words = F.array_join(F.try_variant_get(event, "$.payload.command", "array<string>"), " ")
    done = type_ == "item.completed"
    return F.struct(
        type_.alias("type"), F.when(type_ == "thread.started", p("id")).alias("thread"), F.when(type_.isin("turn.started", "turn.completed"), p("turn_id")).alias("turn"),
        F.when(done, F.coalesce(p("call_id"), p("process_id"), p("turn_id"))).alias("item"), F.when(done, F.coalesce(p("command"), words)).alias("command"), F.when(done, output).alias("output"),
    )


def observed_tool(type_: Column, item: Column, command: Column, output: Column) -> Column:
    """The tool source of a completed command: (source_id, tool, payload, command); null for other events and empty outputs."""
    own = F.when(F.nullif(item, F.lit("")).isNotNull(), item).otherwise(fnv1a(output))
    return F.when((type_ == "item.completed") & (F.length(output) > 0), F.struct(F.concat(F.lit("exec_observed_"), own).alias("source_id"), F.lit("exec_command").alias("tool"), output.alias("payload"), command.alias("command")))


def frame_payload(text: Column, data: Column) -> Column:
    """A frame's payload as JSON: a text that is JSON as it is, another as a string, bytes as Base64 and their number."""
    binary = F.to_json(F.struct(F.base64(data).alias("binaryBase64"), F.octet_length(data).alias("bytes")))
    plain = F.regexp_replace(F.to_json(F.struct(text.alias("t"))), r'(?s)^\{"t":(.*)\}$', "$1")
    return F.when(data.isNotNull(), binary).otherwise(F.coalesce(F.to_json(F.try_parse_json(text)), plain))
