"""Pieces read back from the archive by their selectors: the whole source, spans of its text, or a path into its payload."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import preview
from .chunks import SPANS, own_tool, selected
from .prompt import selection_bytes, selection_text


def path_text(path: Column) -> Column:
    """A row's own path, an array of VARIANT keys and indexes, as the text of a path; null if it can lead nowhere."""

    def step(x: Column) -> Column:
        kind, text = F.schema_of_variant(x), F.try_variant_get(x, "$", "string")
        key = F.when(~F.contains(text, F.lit("'")), F.concat(F.lit("['"), text, F.lit("']"))).when(~F.contains(text, F.lit('"')), F.concat(F.lit('["'), text, F.lit('"]')))
        return F.when(kind == "STRING", key).when((kind == "BIGINT") & (F.try_variant_get(x, "$", "long") >= 0), F.concat(F.lit("["), text, F.lit("]")))

    steps = F.transform(path, step)
    return F.when(~F.exists(steps, lambda s: s.isNull()), F.concat(F.lit("$"), F.array_join(steps, "")))


def resolved(pieces: DataFrame, archive: DataFrame, keys: list[str], piece: str, selector: str, payload: str, tool: str) -> DataFrame:
    """(keys, piece, kind, content, preview, bytes) of pieces (keys, piece, selector) with archived sources (keys, payload, tool).

    A selector is a VARIANT of one of three kinds: `whole`; `chunks` with spans [{start, end}], rendered with marks for what is
    left out, whose bytes are those of the segments alone; `object_path` with a path of keys and indexes, whose value is a string as it
    is or else JSON. Pieces go if their source isn't archived, their path leads nowhere, or their selector is of no known kind.
    """
    s, v = F.col(selector), F.try_parse_json(F.col(payload))
    met = pieces.select(*keys, piece, selector).join(archive.select(*keys, payload, tool), keys).withColumn("kind", F.try_variant_get(s, "$.kind", "string"))
    spans = F.try_variant_get(s, "$.chunks", "array<struct<start:int,end:int>>").cast(SPANS)
    met = met.withColumn("_parts", F.when(F.col("kind") == "chunks", selected(F.col(payload), spans)))
    at = F.call_function("try_variant_get", v, path_text(F.try_variant_get(s, "$.path", "array<variant>")), F.lit("variant"))
    met = met.withColumn("_value", F.when(F.col("kind") == "object_path", at))
    value = F.when(F.schema_of_variant("_value") == "STRING", F.try_variant_get("_value", "$", "string")).otherwise(F.to_json("_value"))
    whole = F.when(own_tool(F.col(tool)), F.coalesce(F.to_json(v), F.col(payload))).otherwise(F.col(payload))
    content = F.when(F.col("kind") == "whole", whole).when(F.col("kind") == "chunks", selection_text(F.col("_parts"), F.length(payload))).when(F.col("kind") == "object_path", value)
    out = met.withColumn("content", content).where("content is not null")
    size = F.when(F.col("kind") == "chunks", selection_bytes(F.col("_parts"))).otherwise(F.octet_length("content").cast("long"))
    return out.select(*keys, piece, "kind", "content", preview(F.col("content")).alias("preview"), size.alias("bytes"))
