"""All named queries of the working-set engine."""

from . import conversations, logs, replays, sources, state
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "conversations", "logs", "replays", "sources", "state"]
