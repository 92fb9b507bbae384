"""Duplicates with provenance: what stays, what goes, and which piece stands for it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dedupe_last(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last row of each key, whole; a partial aggregate, so a frequent key is cheap."""
    cols = rows.columns
    best = rows.groupBy(*key).agg(F.max_by(F.struct(*cols), F.col(order)).alias("_r"))
    return best.select("_r.*")


def dedupe_first(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    cols = rows.columns
    best = rows.groupBy(*key).agg(F.min_by(F.struct(*cols), F.col(order)).alias("_r"))
    return best.select("_r.*")


def new_sources(sources: DataFrame, processed: DataFrame, key: list[str]) -> DataFrame:
    """Sources not processed yet."""
    return sources.join(processed.select(*key), key, "left_anti")


def canonical_pieces(pieces: DataFrame, scope: list[str], content: str, rank: list[Column], piece: str) -> DataFrame:
    """Adds `canonical`, the id of the piece that stands for all of the same content in the scope: the least by `rank`.

    An aggregate and a join, not a window: the aggregate is partial, and in the join back adaptive execution can split the
    rows of a frequent content, which a window could not.
    """
    keys = [*scope, content]
    best = pieces.groupBy(*keys).agg(F.min_by(piece, F.struct(*rank)).alias("canonical"), F.count("*").alias("copies"))
    return pieces.join(best, keys)


def mark_duplicates(pieces: DataFrame, scope: list[str], content: str, is_new: str, order: str, piece: str) -> DataFrame:
    """New pieces that repeat an old one, or an earlier new one, are duplicates of it; old pieces all stay."""
    out = canonical_pieces(pieces, scope, content, [F.col(is_new), F.col(order), F.col(piece)], piece)
    return out.withColumn("duplicate", F.col(is_new) & (F.col(piece) != F.col("canonical")))


def collapse_prefer(pieces: DataFrame, scope: list[str], content: str, preferred: str, created: str, piece: str) -> DataFrame:
    """One piece of each content stays: the earliest preferred one, else the earliest."""
    out = canonical_pieces(pieces, scope, content, [~F.col(preferred), F.col(created), F.col(piece)], piece)
    return out.withColumn("duplicate", F.col(piece) != F.col("canonical"))


def collapse_verified(pieces: DataFrame, scope: list[str], text: str, requested: str, is_new: str, created: str, piece: str) -> DataFrame:
    """Pieces that were asked to go as exact duplicates, where their text does occur again.

    The piece that stands for them is the last new one not asked to go, else the first not asked, else the first.
    """
    keys = [*scope, text]
    place = F.struct(F.col(created), F.col(piece))
    free, fresh = ~F.col(requested), ~F.col(requested) & F.col(is_new)
    best = pieces.groupBy(*keys).agg(
        F.count("*").alias("copies"),
        F.coalesce(F.max_by(piece, F.when(fresh, place)), F.min_by(piece, F.when(free, place)), F.min_by(piece, place)).alias("canonical"),
    )
    out = pieces.join(best, keys)
    return out.withColumn("duplicate", F.col(requested) & (F.col("copies") > 1) & (F.col(piece) != F.col("canonical")))


def duplicate_markers(marked: DataFrame, scope: list[str], piece: str, order: list[str]) -> DataFrame:
    """(scope, canonical, order, piece): a row for each piece that another stands for, the first of each id."""
    gone = marked.where("duplicate").groupBy(*scope, piece).agg(F.min_by(F.struct("canonical", *order), F.struct(*order)).alias("_m"))
    return gone.select(*scope, "_m.canonical", *[F.col(f"_m.{c}") for c in order if c != piece], piece)


def all_known(active: DataFrame, archived: DataFrame, key: list[str], order: str) -> DataFrame:
    """Active and archived pieces, one of each id: the last by order, an archived one before an active one of the same."""
    both = active.withColumn("_a", F.lit(0)).unionByName(archived.withColumn("_a", F.lit(1)))
    return both.groupBy(*key).agg(F.max_by(F.struct(*active.columns), F.struct("_a", F.col(order))).alias("_r")).select("_r.*")


def id_changes(before: DataFrame, after: DataFrame, scope: list[str], piece: str, is_new: str) -> DataFrame:
    """(scope, kept_old, dropped_old, kept_new, dropped_new): ids before a round's decisions against ids after them, sorted."""
    b = before.join(after.select(*scope, piece).withColumn("_kept", F.lit(True)), [*scope, piece], "left").withColumn("_kept", F.coalesce("_kept", F.lit(False)))
    ids = lambda new, kept: F.array_sort(F.collect_list(F.when((F.col(is_new) == new) & (F.col("_kept") == kept), F.col(piece))))
    return b.groupBy(*scope).agg(ids(False, True).alias("kept_old"), ids(False, False).alias("dropped_old"), ids(True, True).alias("kept_new"), ids(True, False).alias("dropped_new"))


def round_sources(request: DataFrame, assistant: DataFrame, processed: DataFrame, key: list[str]) -> DataFrame:
    """A round's sources: the request's and the assistant's, those not processed before, each id once (the request's first)."""
    both = request.withColumn("_o", F.lit(0)).unionByName(assistant.withColumn("_o", F.lit(1)))
    return new_sources(dedupe_first(both, key, "_o").drop("_o"), processed, key)
