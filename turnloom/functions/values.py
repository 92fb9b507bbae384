"""Arrow-batched functions for what no built-in expresses: nested JSON walks and a code-unit hash."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Names of fields whose content is never logged.
SECRET_KEYS = ("authorization", "proxy-authorization", "access_token", "refresh_token", "id_token", "api_key", "openai_api_key", "x-api-key")


def redact_value(x: object) -> object:
    if isinstance(x, dict):
        return {k: "[redacted]" if k.lower() in SECRET_KEYS else redact_value(v) for k, v in x.items()}
    return [redact_value(v) for v in x] if isinstance(x, list) else x


def leaf_strings(x: object) -> list[str]:
    if isinstance(x, str):
        return [x]
    items = x.values() if isinstance(x, dict) else x if isinstance(x, list) else ()
    return [s for v in items for s in leaf_strings(v)]


def _parsed(text: str | None) -> object:
    try:
        return json.loads(text) if text is not None else None
    except ValueError:
        return text


def redact_text(body: str | None) -> str | None:
    try:
        return None if body is None else json.dumps(redact_value(json.loads(body)), sort_keys=True, ensure_ascii=False)
    except ValueError:
        return body


@F.pandas_udf(StringType())
def redact(body: pd.Series) -> pd.Series:
    """A JSON text with secret fields blanked at every depth; other texts as they are."""
    return body.map(redact_text)


@F.pandas_udf(ArrayType(StringType()))
def leaves(body: pd.Series) -> pd.Series:
    """All strings inside a JSON text, in order; a text that isn't JSON is its only one."""
    return body.map(lambda t: None if t is None else leaf_strings(_parsed(t)))


def _number(x: float | int) -> str:
    """A number as a script engine prints it."""
    if isinstance(x, bool) or x is None:
        return json.dumps(x)
    if x != x or x in (float("inf"), float("-inf")):
        return "null"
    if abs(x) < 1e21 and float(x).is_integer():
        return str(int(x)) if x else "0"
    mantissa, _, power = repr(float(x)).partition("e")
    if not power:
        return mantissa
    e = int(power)
    if -7 < e < 0:
        digits = mantissa.replace(".", "").lstrip("-")
        return ("-" if x < 0 else "") + "0." + "0" * (-e - 1) + digits.rstrip("0")
    return f"{mantissa.removesuffix('.0')}e{'+' if e > 0 else '-'}{abs(e)}"


def _place(key: str) -> tuple:
    """Keys that are array indexes come first, by value; others by their UTF-16 code units."""
    index = key.isdigit() and key.isascii() and (key == "0" or key[0] != "0") and int(key) < 2**32 - 1
    return (0, int(key), b"") if index else (1, 0, key.encode("utf-16-be", "surrogatepass"))


def stable_text(x: object) -> str:
    if isinstance(x, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{stable_text(x[k])}" for k in sorted(x, key=_place)) + "}"
    if isinstance(x, list):
        return "[" + ",".join(map(stable_text, x)) + "]"
    return json.dumps(x, ensure_ascii=False) if isinstance(x, str) else _number(x)


@F.pandas_udf(StringType())
def stable_json(body: pd.Series) -> pd.Series:
    """JSON with its keys in stable order at every level and numbers as scripts print them; null for what isn't JSON."""

    def one(t: str | None) -> str | None:
        try:
            return None if t is None else stable_text(json.loads(t))
        except ValueError:
            return None

    return body.map(one)


def fnv1a32(text: str) -> str:
    h = 0x811C9DC5
    for unit in memoryview(text.encode("utf-16-le")).cast("H"):
        h = (h ^ unit) * 0x01000193 & 0xFFFFFFFF
    return f"{h:x}"


@F.pandas_udf(StringType())
def fnv1a(text: pd.Series) -> pd.Series:
    """FNV-1a, 32 bits, over UTF-16 code units, as hexadecimal digits."""
    return text.map(lambda t: None if t is None else fnv1a32(t))
