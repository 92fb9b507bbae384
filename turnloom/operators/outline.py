"""Iterative chunking of a source by an outline policy: pieces are split again until nothing splits."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunks import sliced
from .packing import written

#: Anchors of a text: strings that start its sections, in order.
Outline = Callable[[str], list[str]]


def split_once(text: str, anchors: list[str]) -> list[str]:
    """Sections from anchor to anchor, searched forward; what precedes the first found is a section of its own."""
    at, starts = 0, []
    for a in anchors:
        i = text.find(a, at) if a else -1
        if i >= 0:
            starts.append(i)
            at = i + len(a)
    cuts = sorted({0, *starts, len(text)})
    return [text[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a]


def paragraphs(text: str) -> list[str]:
    """A deterministic outline: the first line of each paragraph."""
    return [p.split("\n", 1)[0] + "\n" for p in text.split("\n\n") if "\n" in p or p] if "\n\n" in text else []


def halves(most: int) -> Outline:
    """A deterministic outline: what follows the middle of a text longer than `most`."""
    return lambda text: [text[len(text) // 2 :]] if len(text) > most else []


def sections(outline: Outline) -> type:
    """The outline as a table function: the sections (at, to) of a piece, how many there are, and whether the policy failed."""

    class Sections:
        def eval(self, content: str) -> Iterator[tuple[int, int, int, bool]]:
            try:
                parts = split_once(content, outline(content))
            except Exception:
                yield 0, len(content), 1, True
                return
            at = 0
            for p in parts:
                yield at, at + len(p), len(parts), False
                at += len(p)

    return F.udtf(Sections, returnType="at int, to int, parts int, failed boolean")


def outlined(sources: DataFrame, source: str, text: str, outline: Outline = paragraphs, rounds: int = 7) -> DataFrame:
    """(source, index, start, end) of each source's pieces, which cover its text without a gap; a null or empty text has none.

    A round asks the policy for the sections of each piece that the round before made, a row a piece, and only the pieces that split go into the next
    one. A source of which the policy fails on any piece is one whole piece. A round's spans are written before the next begins, so that no plan and no
    row holds more than one round.
    """
    table = sections(outline)
    texts = sources.where(F.length(text) > 0).select(source, text)
    open_ = written(texts.select(source, F.lit(0).alias("start"), F.length(text).alias("end")), "outline-spans")
    whole, done, failed = open_, [], []
    for _ in range(rounds):
        spans = open_.groupBy(source).agg(F.collect_list(F.struct("start", "end")).alias("spans"))
        pieces = sliced(texts.join(spans, source), [source], text, "spans")
        asked = written(pieces.lateralJoin(table(F.col("content").outer())).select(source, (F.col("start") + F.col("at")).alias("start"), (F.col("start") + F.col("to")).alias("end"), "parts", "failed"), "outline-round")
        done.append(asked.where("parts = 1").select(source, "start", "end"))
        failed.append(asked.where("failed").select(source))
        open_ = asked.where("parts > 1").select(source, "start", "end")
        if open_.isEmpty():
            break
    bad = reduce(DataFrame.union, failed).distinct()
    kept = reduce(DataFrame.unionByName, [*done, open_]).join(bad, source, "left_anti").unionByName(whole.join(bad, source, "left_semi"))
    return kept.select(source, (F.row_number().over(Window.partitionBy(source).orderBy("start")) - 1).alias("index"), "start", "end")
