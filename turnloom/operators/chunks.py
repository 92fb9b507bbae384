"""Lossless pieces of texts and JSON values."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

#: Keys whose array a payload is split at, in order of preference.
ARRAY_KEYS = ("results", "rows", "items", "exports", "changedFiles", "namespaces", "edges")


SPANS = "array<struct<start:int,end:int>>"


def _between(starts: Column, end: Column) -> Column:
    """Spans from each start to the next, the last one to the end; empty ones are left out. The starts are made once a row."""
    ends = F.concat(F.slice(starts, F.lit(2), F.greatest(F.lit(0), F.size(starts) - 1)), F.array(end.cast("int")))
    return F.filter(F.zip_with(starts, ends, lambda s, e: F.struct(s.cast("int").alias("start"), e.cast("int").alias("end"))), lambda x: x["end"] > x["start"])


def line_spans(text: Column) -> Column:
    """Spans (start, end), from 0, of a text's lines, each with its line feed; an empty array for an empty text.

    One search from line feed to line feed, whatever the number of lines.
    """

    @F.pandas_udf("array<int>")
    def after(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [0, *(m.end() for m in re.finditer("\n", t))], na_action="ignore")

    return _between(after(text), F.length(text))


def sliced(rows: DataFrame, keep: list[str], text: str, spans: str) -> DataFrame:
    """(keep, index, span's fields, content): a row for each span (start, end, ...) of a row's text, its characters as `content`.

    The text is sliced where it is, so that a piece costs its own length and not that of what precedes it, and only pieces move on.
    """
    fields = rows.schema[spans].dataType.elementType
    kept = [f for f in rows.select(*keep).schema]
    schema = StructType([*kept, StructField("index", IntegerType()), *fields, StructField("content", StringType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)
        for b in batches:
            for i, (t, s) in enumerate(zip(b.column(len(keep)), b.column(len(keep) + 1), strict=True)):
                t, s = t.as_py(), s.as_py()
                own = tuple(b.column(j)[i].as_py() for j in range(len(keep)))
                for k, x in enumerate(s or () if t is not None else ()):
                    content = t[x["start"] : x["end"]]
                    out.append((*own, k, *x.values(), content))
                    size += len(content)
                    if len(out) >= 20_000 or size >= 1 << 24:
                        yield flush()
                        out, size = [], 0
        if out:
            yield flush()

    return rows.select(*keep, text, spans).mapInArrow(run, schema)


def anchor_spans(text: Column, anchors: Column) -> Column:
    """Spans cut where each anchor occurs, searched forward; anchors that are empty or not found are skipped, and what
    precedes the first is a span of its own. Each anchor is searched for once, from where the one before ended."""

    @F.pandas_udf("array<int>")
    def starts(texts: pd.Series, lists: pd.Series) -> pd.Series:
        out = []
        for t, own in zip(texts, lists, strict=True):
            at, found = 0, [0]
            for a in own if t is not None and own is not None else ():
                i = t.find(a, at) if a else -1
                if i >= 0:
                    at = i + len(a)
                    found += [i] if i > 0 else []
            out.append(None if t is None else found)
        return pd.Series(out)

    return _between(starts(text, anchors), F.length(text))


def normalized_spans(spans: Column, length: Column) -> Column:
    """Spans cut to the text, empty ones left out, sorted; one that starts before the end of the one kept before goes."""
    cut = lambda x: F.greatest(F.lit(0), F.least(length, x)).cast("int")
    inside = F.filter(F.transform(spans, lambda s: F.struct(cut(s["start"]).alias("start"), cut(s["end"]).alias("end"))), lambda s: s["end"] > s["start"])
    return F.aggregate(
        F.array_sort(inside).cast(SPANS), F.expr(f"cast(array() as {SPANS})"),
        lambda acc, s: F.when(F.coalesce(F.try_element_at(acc, F.lit(-1))["end"], F.lit(-1)) > s["start"], acc).otherwise(F.concat(acc, F.array(s)).cast(SPANS)),
    )


def selected(text: Column, spans: Column) -> Column:
    """The text's segments (start, end, text) at normalized spans."""
    return F.transform(normalized_spans(spans, F.length(text)), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.substring(text, s["start"] + 1, s["end"] - s["start"]).alias("text")))


def object_path(payload: Column, path: list[str | int] | Column) -> Column:
    """The value, as JSON, that a path of keys and indexes leads to in a VARIANT, or that a row's own path text names."""
    if isinstance(path, list):
        path = F.lit("$" + "".join(f"[{p}]" if isinstance(p, int) else f"['{p}']" for p in path))
    return F.to_json(F.call_function("try_variant_get", payload, path, F.lit("variant")))


def pointer(source: Column, kind: Column, spans: Column, path: Column) -> Column:
    """A source's pointer with the selector of a piece of it, as JSON with sorted keys."""
    arm = F.to_json(F.struct(F.when(kind == "chunks", spans).alias("chunks"), kind.alias("kind"), F.when(kind == "object_path", path).alias("path")))
    own = F.coalesce(F.regexp_extract(source, r"(?s)^\s*\{(.*)\}\s*$", 1), F.lit(""))
    return F.to_json(F.parse_json(F.concat(F.lit("{"), own, F.when(F.trim(own) != "", F.lit(",")).otherwise(F.lit("")), F.lit('"selector":'), arm, F.lit("}"))))


def own_tool(tool: Column, prefix: str = "recall.") -> Column:
    """Output of the engine's own tools is split by its structure."""
    return F.coalesce(F.startswith(tool, F.lit(prefix)), F.lit(False))


def dispatched(sources: DataFrame, source: str, kind: str, tool: str, payload: str, outline: Column) -> DataFrame:
    """(source, piece_id, selector, content) of sources (texts or JSON), by what they are.

    A user's and a call's are whole; an own tool's is cut at the elements of its array, else whole; all others by the
    outline's spans, whole if there are none. Pieces without bytes go, unless nothing else is left of the source.
    """
    v = F.try_parse_json(F.col(payload))
    whole = F.array(F.struct(F.lit("whole").alias("selector"), F.col(payload).alias("content")))
    items = F.transform(json_elements(v), lambda x, i: F.struct(F.concat(F.lit("path:"), i.cast("string")).alias("selector"), x.alias("content")))
    cut = F.transform(outline, lambda s: F.struct(F.concat(F.lit("chunks:"), s["start"].cast("string"), F.lit("-"), s["end"].cast("string")).alias("selector"), F.substring(F.col(payload), s["start"] + 1, s["end"] - s["start"]).alias("content")))
    plain = F.col(kind).isin("user", "tool_call")
    parts = F.when(plain, whole).when((F.col(kind) == "tool") & own_tool(F.col(tool)), F.coalesce(items, whole)).otherwise(F.coalesce(F.when(F.size(cut) > 0, cut), whole))
    out = sources.select(source, F.posexplode(parts).alias("i", "p")).where((F.octet_length("p.content") > 0))
    return out.select(source, F.concat(F.col(source).cast("string"), F.lit(":"), F.col("i").cast("string")).alias("piece_id"), "p.selector", "p.content")


def merge_spans(spans: Column) -> Column:
    """Sorted spans, those that touch or overlap made one."""
    kind = "array<struct<start:int,end:int>>"
    return F.aggregate(
        F.array_sort(F.filter(spans, lambda s: s["end"] > s["start"])).cast(kind),
        F.expr(f"cast(array() as {kind})"),
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1))["end"], F.lit(-1)) >= s["start"]),
            F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(F.try_element_at(acc, F.lit(-1))["start"].alias("start"), F.greatest(F.try_element_at(acc, F.lit(-1))["end"], s["end"]).alias("end")))).cast(kind),
        ).otherwise(F.concat(acc, F.array(s)).cast(kind)),
    )


def lossless(text: Column, spans: Column) -> Column:
    """Whether spans cover a text from its start to its end without a gap, an overlap or an empty span."""
    first = F.coalesce(F.get(spans, F.lit(0))["start"], F.lit(0)) == 0
    last = F.coalesce(F.try_element_at(spans, F.lit(-1))["end"], F.lit(0)) == F.length(text)
    steps = F.forall(F.sequence(F.lit(1), F.size(spans)), lambda i: (F.get(spans, i - 1)["end"] > F.get(spans, i - 1)["start"]) & ((i == 1) | (F.get(spans, i - 1)["start"] == F.get(spans, i - 2)["end"])))
    return first & last & F.when(F.size(spans) > 0, steps).otherwise(F.lit(True))


def explode_pieces(sources: DataFrame, source: str, text: str, spans: Column) -> DataFrame:
    """(source, index, piece_id source:index, start, end, content): a piece for each span that isn't empty."""
    out = sliced(sources.select(source, text, spans.alias("_s")), [source], text, "_s").where("end > start")
    return out.select(source, "index", F.concat(F.col(source).cast("string"), F.lit(":"), F.col("index").cast("string")).alias("piece_id"), "start", "end", "content")


def json_elements(payload: Column) -> Column:
    """Elements, as JSON texts, of the array that a payload is, or has under the first filled key, else under one of `data`; null if none."""
    def array_at(path: str) -> Column:
        return F.transform(F.try_variant_get(payload, path, "array<variant>"), lambda v: F.to_json(v))

    tries = [array_at("$"), *[array_at(f"$.{k}") for k in ARRAY_KEYS], *[array_at(f"$.data.{k}") for k in ARRAY_KEYS]]
    return F.coalesce(*[F.when(F.size(t) > 0, t) for t in tries])
