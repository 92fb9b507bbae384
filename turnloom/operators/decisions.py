"""Keep-or-drop decisions: defaults, acceptance, the guard, and the deterministic policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.schema import problem, strict  # noqa: F401  decisions are read by their shapes
from .greedy import greedy

#: Reasons for which a drop is accepted; the first six are structural.
STRUCTURAL_REASONS = ("exact_duplicate", "explicitly_invalidated_by_user", "old_task_after_confirmed_task_switch", "pure_ack_or_chatter", "transient_format_request_only", "empty_or_invalid")
UNRELATED = "clearly_unrelated_to_current_work"
REASONS = (*STRUCTURAL_REASONS, UNRELATED)
OLD_TASK = "old_task_after_confirmed_task_switch"


def with_overrides(pieces: DataFrame, decisions: DataFrame, keys: list[str]) -> DataFrame:
    """Each piece with its decision (drop, reason); kept, without a reason, where none was made."""
    d = decisions.select(*keys, F.struct("drop", "reason").alias("_d"))
    out = pieces.join(d, keys, "left").withColumn("_d", F.coalesce("_d", F.struct(F.lit(False).alias("drop"), F.lit(None).cast("string").alias("reason"))))
    return out.select(*pieces.columns, "_d.drop", "_d.reason")


def accepted(drop: Column, reason: Column, new_task: Column, old: Column, created: Column, started: Column) -> Column:
    """A drop for a known reason; the old-task reason only for pieces older than a task just begun."""
    applies = (reason != OLD_TASK) | (new_task & old & (created < started))
    return F.coalesce(drop & reason.isin(*REASONS) & applies, F.lit(False))


def _object(**fields: dict) -> dict:
    return {"type": "object", "properties": fields, "required": list(fields), "additionalProperties": False}


_TEXT = {"type": "string"}
_KEPT, _DROPPED = {"drop": {"enum": [False], "type": "boolean"}, "reason": {"type": "null"}}, {"drop": {"enum": [True], "type": "boolean"}, "reason": {"type": "string", "enum": list(REASONS)}}

#: Fixed shapes of what a model decides: a route (an index only for what is revived), a source's sections, a batch of them, and
#: which pieces to drop: one decision, one with its piece, a batch of overrides of a default.
ROUTE_SHAPE = {
    "anyOf": [
        _object(kind={"type": "string", "enum": ["same_task", "new_task", "more_archived_tasks"]}, relativeIndex={"type": "integer", "enum": [0]}),
        _object(kind={"type": "string", "enum": ["revive_task"]}, relativeIndex={"type": "integer", "maximum": -1}),
    ]
}
CHUNK_SHAPE = {"anyOf": [_object(itemId=_TEXT, sections={"type": "array", "items": _object(label=_TEXT, anchor=_TEXT)}), _object(itemId=_TEXT, error=_TEXT)]}
CHUNKS_SHAPE = _object(results={"type": "array", "items": CHUNK_SHAPE})
DECISION_SHAPE = {"anyOf": [_object(**_KEPT), _object(**_DROPPED)]}
DROP_SHAPE = {"anyOf": [_object(pieceId=_TEXT, **_KEPT), _object(pieceId=_TEXT, **_DROPPED)]}
DROPS_SHAPE = _object(defaultDecision=DECISION_SHAPE, overrides={"type": "array", "items": DROP_SHAPE})


def invalid_reasons(decisions: DataFrame, key: str) -> DataFrame:
    """(key, problem): drops without a known reason, and reasons given for what is kept."""
    known = F.coalesce(F.col("reason").isin(*REASONS), F.lit(False))
    problem = F.when(F.col("drop") & ~known, "no known reason").when(~F.col("drop") & F.col("reason").isNotNull(), "reason without drop").when(F.col("drop").isNull(), "no decision")
    return decisions.select(key, problem.alias("problem")).where("problem is not null")


def invalid_decisions(decisions: DataFrame, pieces: DataFrame, keys: list[str]) -> DataFrame:
    """Decisions on unknown pieces, and pieces decided more than once: (keys, problem)."""
    unknown = decisions.join(pieces.select(*keys), keys, "left_anti").select(*keys, F.lit("unknown").alias("problem"))
    twice = decisions.groupBy(*keys).count().where("count > 1").select(*keys, F.lit("repeated").alias("problem"))
    return unknown.unionByName(twice)


def sanity_guard(pieces: DataFrame, scope: list[str], kind: str, accepted_drop: str, reason: str) -> DataFrame:
    """Adds `dropped`. Where some candidate is not the assistant's but no such piece would survive, only structural drops count.

    The verdict of a scope is a partial aggregate joined back: verdicts are small, and adaptive execution splits a large scope's rows.
    """
    verdict = pieces.groupBy(*scope).agg(F.bool_or(F.col(kind) != "assistant").alias("_had"), F.bool_or((F.col(kind) != "assistant") & ~F.col(accepted_drop)).alias("_has"))
    undo = F.col("_had") & ~F.col("_has") & ~F.coalesce(F.col(reason).isin(*STRUCTURAL_REASONS), F.lit(False))
    return pieces.join(verdict, scope).withColumn("dropped", F.col(accepted_drop) & ~undo).drop("_had", "_has")


def retain_recent(pieces: DataFrame, scope: list[str], order: list[Column], n: int = 12) -> DataFrame:
    """Adds `kept`: the last n of each scope."""
    return pieces.withColumn("kept", F.row_number().over(Window.partitionBy(*scope).orderBy(*order)) <= n)


def cap_bytes(pieces: DataFrame, scope: list[str], order: list[str], size: str, piece: str, budget: int = 32_768) -> DataFrame:
    """(scope, piece, size, kept): newest first, each that still fits. Only ids and sizes move, and no task gathers a scope."""
    rows = pieces.select(*scope, *order, *([] if piece in order else [piece]), F.col(size).cast("long").alias(size))
    return greedy(rows, scope, [F.desc(c) for c in (*order, piece)], size, F.lit(budget)).select(*scope, piece, size, "kept")
