"""The memory block of a prompt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import utf16_length


def piece_entry(piece: Column, kind: Column, text: Column) -> Column:
    return F.concat(F.lit("[piece "), piece, F.lit(" "), kind, F.lit("]\n"), text, F.lit("\n[/piece]"))


def duplicate_entry(piece: Column, canonical: Column) -> Column:
    return F.concat(F.lit("[same "), piece, F.lit(" as "), canonical, F.lit("]"))


def prompt_entries(pieces: DataFrame, markers: DataFrame, session: str, order: str, piece: str, kind: str, text: str) -> DataFrame:
    """(session, order, id, entry): pieces and duplicate markers (session, canonical, order, piece) in one sequence."""
    own = pieces.select(session, order, F.col(piece).alias("id"), piece_entry(F.col(piece), F.col(kind), F.col(text)).alias("entry"))
    return own.unionByName(markers.select(session, order, F.col(piece).alias("id"), duplicate_entry(F.col(piece), F.col("canonical")).alias("entry")))


def memory_frame(task: Column, started: Column, last: Column, archived: Column) -> tuple[Column, Column]:
    """Lines before and after the entries: the current task, and how much is archived; null where there is nothing to say."""
    head = F.when(task.isNotNull(), F.concat(F.lit("[task "), task, F.lit(" since round "), started.cast("string"), F.lit(", last round "), last.cast("string"), F.lit("]")))
    tail = F.when(archived > 0, F.concat(F.lit("[archive holds "), archived.cast("string"), F.lit(" sources: recall(offset, limit)]")))
    return head, tail


def outline_request(items: DataFrame, batch: str, order: str, item: str, text: str) -> DataFrame:
    """(batch, input): a batch's sources for an outline policy, each with its id and length. The input is the product, so they meet."""
    block = F.concat(F.lit("[item "), F.to_json(F.array(F.col(item).cast("string"))), F.lit(" length="), utf16_length(text).cast("string"), F.lit("]\n"), F.col(text), F.lit("\n[/item]"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), block.alias("b")))), lambda x: x["b"])
    return items.groupBy(batch).agg(F.array_join(lines, "\n").alias("input"))


def route_pieces(pieces: DataFrame, rendered: DataFrame, keys: list[str], order: list[str], preview: str, text: str) -> DataFrame:
    """What a router sees of the current pieces, in order: their rendered text, else their preview; adds `place` and `content`."""
    out = pieces.join(rendered.select(*keys, F.col(text).alias("_t")), keys, "left")
    place = F.row_number().over(Window.partitionBy(keys[0]).orderBy(*order)).cast("long") - 1
    return out.select(*keys, place.alias("place"), F.coalesce("_t", preview).alias("content"))


def memory_text(entries: DataFrame, session: str, order: list[str], entry: str) -> DataFrame:
    """(session, text): a session's entries in order between the block's marks. The block is the product, so its entries meet."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(entry).alias("_e")))), lambda x: x["_e"])
    return entries.groupBy(session).agg(F.concat_ws("\n", F.lit("[memory]"), F.array_join(lines, "\n"), F.lit("[/memory]")).alias("text"))


def report_line(name: Column, counts: dict[str, Column], longest: Column) -> Column:
    """A line of a written report: a name, its counts, and the longest."""
    parts = [F.concat(c.cast("string"), F.lit(f" {k}")) for k, c in counts.items()]
    return F.concat(F.lit("- "), name, F.lit(": "), F.concat_ws(", ", *parts, F.concat(F.lit("longest "), longest.cast("string"))))


def report(lines: DataFrame, path: str, title: str, line: str = "line") -> None:
    """Writes a report of few lines as text."""
    head = lines.sparkSession.createDataFrame([(0, f"# {title}"), (1, "")], "_n int, value string")
    body = lines.select(F.lit(2).alias("_n"), F.col(line).alias("value"))
    head.unionByName(body).orderBy("_n", "value").select("value").coalesce(1).write.mode("overwrite").text(path)


def token_summary(total: Column, inputs: Column, cached: Column, output: Column) -> Column:
    """A session's tokens in words."""
    n = lambda c: F.format_number(c, 0)
    return F.concat(F.lit("Token usage: total="), n(total), F.lit(" input="), n(inputs - cached), F.when(cached > 0, F.concat(F.lit(" (+ "), n(cached), F.lit(" cached)"))).otherwise(""), F.lit(" output="), n(output))
