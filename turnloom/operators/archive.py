"""The archive: what left the working set, its pages, and its texts."""

from __future__ import annotations

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .chunks import sliced
from .containment import contained

#: Bytes of needles that are broadcast at most.
MOST_BYTES = 16_000_000


def archive_gap(processed: DataFrame, visible: DataFrame, keys: list[str]) -> DataFrame:
    """Processed sources that aren't visible."""
    return processed.join(visible.select(*keys), keys, "left_anti")


def page(rows: DataFrame, part: list[str], order: list[Column], offset: int | Column, limit: int | Column) -> DataFrame:
    """Rows offset to offset + limit of each part, with their `place` from 0 and how many are `left` after the page."""
    w = Window.partitionBy(*part)
    offset, limit = (F.lit(x) if isinstance(x, int) else x for x in (offset, limit))
    ranked = rows.withColumn("place", F.row_number().over(w.orderBy(*order)).cast("long") - 1).withColumn("_n", F.count("*").over(w))
    out = ranked.where((F.col("place") >= offset) & (F.col("place") < offset + limit))
    return out.withColumn("left", F.greatest(F.lit(0), F.col("_n") - offset - limit).cast("long")).drop("_n")


def recalls(calls: DataFrame, gap: DataFrame, session: str, order: list[str], source: str, source_order: list[str], most: int = 3) -> DataFrame:
    """(session, call from 1, allowed, place from 0, source, left): what each recall of a session gives from its archive gap, oldest first.

    calls: session, order, offset, limit. The first `most` calls of a session are answered, later ones are not; a call that gives nothing is one row
    without a source. Each gap is ranked once and calls meet it by session and place, so a page costs its own rows.
    """
    numbered = calls.withColumn("call", F.row_number().over(Window.partitionBy(session).orderBy(*order)).cast("long")).withColumn("allowed", F.col("call") <= most)
    asked = numbered.select(session, "call", "allowed", "offset", F.explode_outer(F.when(F.col("allowed") & (F.col("limit") > 0), F.sequence(F.col("offset"), F.col("offset") + F.col("limit") - 1))).alias("_at"), "limit")
    ranked = gap.select(session, source, (F.row_number().over(Window.partitionBy(session).orderBy(*source_order)) - 1).cast("long").alias("_at"))
    size = gap.groupBy(session).agg(F.count("*").alias("_n"))
    got = asked.join(ranked, [session, "_at"], "left").join(size, session, "left").withColumn("left", F.when(F.col("allowed"), F.greatest(F.lit(0), F.coalesce("_n", F.lit(0)) - F.col("offset") - F.col("limit"))))
    # A page that ends beyond the gap has rows without a source, of which one stays if it has no others.
    got = got.withColumn("_found", F.max(source).over(Window.partitionBy(session, "call"))).withColumn("place", F.when(F.col(source).isNotNull(), F.col("_at") - F.col("offset")))
    return got.where(F.col(source).isNotNull() | F.col("_found").isNull()).select(session, "call", "allowed", "place", source, F.col("left").cast("long").alias("left")).distinct()


def relative_index(bundles: Column, index: Column) -> Column:
    """The bundle that a negative index names, from the newest; null if there is none."""
    return F.when((index < 0) & (F.abs(index) <= F.size(bundles)), F.element_at(bundles, index))


def materialize_pieces(pieces: DataFrame, archive: DataFrame, keys: list[str], text: str, start: str, end: str) -> DataFrame:
    """Pieces with the text that their span selects from the archived source; those without a source are left out.

    A source's spans meet its text as one row, which is then sliced: no text is copied for each of its pieces.
    """
    rest = [c for c in pieces.columns if c not in (*keys, start, end)]
    spans = pieces.groupBy(*keys).agg(F.collect_list(F.struct(F.col(start).alias("start"), F.col(end).alias("end"), *rest)).alias("_spans"))
    out = sliced(archive.select(*keys, text).join(spans, keys), keys, text, "_spans")
    return out.select(*keys, *rest, F.col("start").alias(start), F.col("end").alias(end), "content")


def append_sources(archive: DataFrame, sources: DataFrame, keys: list[str]) -> DataFrame:
    """The archive with the sources it lacks; what is there stays as it is."""
    return archive.unionByName(sources.dropDuplicates(keys).join(archive.select(*keys), keys, "left_anti"))


def verbatim(texts: DataFrame, needles: DataFrame, text_id: str, text: str, needle_id: str, needle: str) -> DataFrame:
    """(text_id, needle_id), each once: texts that contain a needle word for word. Empty needles occur nowhere.

    Needles of up to MOST_BYTES in all, which is checked, go out as one automaton that finds all of them in a pass over each
    text. More of them stay a table and meet the texts in a join.
    """
    filled = needles.where((F.length(needle) > 0) & F.col(needle_id).isNotNull()).select(needle_id, needle)
    if filled.agg(F.coalesce(F.sum(F.octet_length(needle)), F.lit(0))).first()[0] > MOST_BYTES:
        return contained(texts, text_id, text, needles, needle_id, needle)
    words: dict[str, list] = {}
    for r in filled.collect():
        words.setdefault(r[1], []).append(r[0])
    automaton = ahocorasick.Automaton()
    for w, ids in words.items():
        automaton.add_word(w, ids)
    automaton.make_automaton()
    shared = texts.sparkSession.sparkContext.broadcast(automaton if words else None)

    @F.pandas_udf(f"array<{needles.schema[needle_id].dataType.simpleString()}>")
    def find(t: pd.Series) -> pd.Series:
        a = shared.value
        return t.map(lambda x: sorted({i for _, ids in a.iter(x) for i in ids}) if a is not None and x else [])

    return texts.where(F.col(text_id).isNotNull()).select(text_id, F.explode(find(text)).alias(needle_id)).distinct()
