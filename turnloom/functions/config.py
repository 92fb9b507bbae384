"""Settings: an option, else the environment, else a default."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass, fields
from typing import TypeVar

T = TypeVar("T")


def positive_int(x: object, default: int) -> int:
    try:
        n = int(str(x))
    except ValueError:
        return default
    return n if n > 0 else default


def boolean(x: object, default: bool) -> bool:
    s = str(x).strip().lower()
    return True if s in ("1", "true", "yes", "on") else False if s in ("0", "false", "no", "off") else default


@dataclass(frozen=True)
class Settings:
    """Limits of the fold and of recall. Environment names are TURNLOOM_ and the field's in capitals."""

    batch_tokens: int = 180_000
    single_tokens: int = 996_000
    recall_calls: int = 3
    recall_limit: int = 5
    chunk_rounds: int = 7
    verbose: bool = False

    @classmethod
    def resolve(cls, **options: object) -> Settings:
        out = {}
        for f in fields(cls):
            given = options.get(f.name)
            given = os.environ.get(f"TURNLOOM_{f.name.upper()}") if given is None else given
            parse = boolean if isinstance(f.default, bool) else positive_int
            out[f.name] = f.default if given is None else parse(given, f.default)
        return cls(**out)


def twice(call: Callable[[int], T], valid: Callable[[T], bool]) -> T:
    """A policy's answer, asked again once if it fails or isn't valid."""
    for attempt in (1, 2):
        try:
            got = call(attempt)
        except Exception:
            if attempt == 2:
                raise
            continue
        if valid(got):
            return got
    raise ValueError("no valid answer in two attempts")
