"""Column functions over texts and ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHARS_PER_TOKEN = 4


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def utf16_length(c: Column | str) -> Column:
    """Length in UTF-16 code units; characters beyond the first plane count twice."""
    return (F.octet_length(F.encode(_col(c), "UTF-16BE")) / 2).cast("long")


def estimated_tokens(*parts: Column | str) -> Column:
    """One token for each four code units, rounded up; several parts count together."""
    total = utf16_length(parts[0])
    for p in parts[1:]:
        total = total + utf16_length(p)
    return F.ceil(total / CHARS_PER_TOKEN).cast("long")


def byte_size(c: Column | str) -> Column:
    return F.octet_length(_col(c)).cast("long")


def json_length(c: Column | str) -> Column:
    """Length of the text as a JSON string in UTF-16 code units, quotes included."""
    return utf16_length(F.to_json(F.struct(_col(c).alias("t")))) - 6


def short_hash(c: Column | str, n: int = 16) -> Column:
    """The first n hexadecimal digits of SHA-256."""
    return F.substring(F.sha2(_col(c), 256), 1, n)


def utf16_prefix(c: Column | str, n: int) -> Column:
    """The first n UTF-16 code units; half a pair at the end becomes U+FFFD."""
    c = _col(c)
    units = F.substring(F.encode(c, "UTF-16BE"), 1, 2 * n)
    last = F.conv(F.hex(F.substring(units, 2 * n - 1, 2)), 16, 10).cast("int")
    cut = (F.octet_length(units) == 2 * n) & last.between(0xD800, 0xDBFF)
    wide = F.when(cut, F.concat(F.decode(F.substring(units, 1, 2 * n - 2), "UTF-16BE"), F.lit("\ufffd"))).otherwise(F.decode(units, "UTF-16BE"))
    return F.when(utf16_length(c) == F.length(c), F.substring(c, 1, n)).otherwise(wide)


def clipped(c: Column | str, most: int) -> Column:
    """The text, or its start and three dots, `most` code units in all."""
    c = _col(c)
    return F.when(utf16_length(c) > most, F.concat(utf16_prefix(c, most - 3), F.lit("..."))).otherwise(c)


def preview(c: Column | str) -> Column:
    return clipped(c, 160)


def title(c: Column | str, fallback: Column | None = None) -> Column:
    """The first line that isn't blank, its white space collapsed, at most 120 code units; the fallback (null) if there is none."""
    line = F.get(F.filter(F.split(_col(c), "\r?\n"), lambda x: F.length(F.trim(x)) > 0), F.lit(0))
    found = clipped(F.trim(F.regexp_replace(line, r"\s+", " ")), 120)
    return found if fallback is None else F.coalesce(found, fallback)


def compact_json(c: Column | str, most: int = 4000) -> Column:
    c = _col(c)
    return F.when(utf16_length(c) > most, F.concat(utf16_prefix(c, most), F.lit("... [truncated "), (utf16_length(c) - most).cast("string"), F.lit(" chars]"))).otherwise(c)


def compact_line(c: Column | str, most: int) -> Column:
    return F.substring(F.trim(F.regexp_replace(_col(c), r"\s+", " ")), 1, most)


def stable_json(c: Column | str) -> Column:
    """A JSON text with its keys sorted at every level; null if it isn't JSON."""
    return F.to_json(F.try_parse_json(_col(c)))


def tool_payload(name: Column | str, output: Column | str) -> Column:
    """A command tool's output without its header, which ends in a line `Output:`; as it is if there is no header or nothing after it."""
    plain = F.replace(_col(output), F.lit("\r\n"), F.lit("\n"))
    at = F.locate("\nOutput:\n", plain)
    tail = F.substr(plain, at + F.lit(9))
    return F.when((_col(name) == "exec_command") & (at > 0) & (F.length(tail) > 0), tail).otherwise(_col(output))


def session_dir(key: Column | str) -> Column:
    """A folder name for a session key: its safe characters, at most 72, and ten digits of its hash."""
    return F.concat(F.substring(F.regexp_replace(_col(key), r"[^A-Za-z0-9._-]", "_"), 1, 72), F.lit("_"), short_hash(key, 10))


def first_filled(*cols: Column | str) -> Column:
    """The first value that isn't blank, trimmed."""
    return F.coalesce(*[F.nullif(F.trim(_col(c)), F.lit("")) for c in cols])


def non_negative(c: Column | str) -> Column:
    """A whole number, cut off towards zero and not below it; 0 for what isn't a finite number."""
    d = _col(c).try_cast("double")
    ok = d.isNotNull() & ~F.isnan(d) & (F.abs(d) < 9.2e18)
    return F.when(ok, F.greatest(F.lit(0), F.when(ok, d).cast("long"))).otherwise(F.lit(0)).cast("long")


def recall_bounds(arguments: Column | str) -> tuple[Column, Column]:
    """Offset (0 unless a whole number not below 0) and limit (5 unless a whole number; 1 at least) of a call's JSON
    arguments. Numbers in strings are no numbers; what isn't an object has no arguments."""
    v = F.try_parse_json(_col(arguments))

    def whole(path: str) -> Column:
        at = F.try_variant_get(v, path, "variant")
        d = F.try_variant_get(v, path, "double")
        return F.when((F.schema_of_variant(at) != "STRING") & (d == F.floor(d)), d.cast("long"))

    o = whole("$.offset")
    return F.when(o >= 0, o).otherwise(F.lit(0)).cast("long"), F.greatest(F.lit(1), F.coalesce(whole("$.limit"), F.lit(5))).cast("long")


def flag(c: Column | str, default: bool = False) -> Column:
    """A yes or no in words; the default for others."""
    t = F.lower(F.trim(_col(c).cast("string")))
    return F.when(t.isin("1", "true", "yes", "on"), True).when(t.isin("0", "false", "no", "off"), False).otherwise(F.lit(default))


def usage(v: Column) -> Column:
    """Token counts of a usage VARIANT, by any of its usual names; total is given or input plus output."""
    def pick(*paths: str) -> Column:
        return F.coalesce(*[F.try_variant_get(v, p, "long") for p in paths])

    i, o = pick("$.input_tokens", "$.prompt_tokens"), pick("$.output_tokens", "$.completion_tokens")
    cached = pick("$.cached_input_tokens", "$.input_tokens_details.cached_tokens", "$.prompt_tokens_details.cached_tokens")
    return F.struct(i.alias("input"), o.alias("output"), cached.alias("cached"), F.coalesce(pick("$.total_tokens"), i + o).alias("total"))


def percent_reduction(before: Column | str, after: Column | str) -> Column:
    b = _col(before)
    return F.bround(100.0 * (b - _col(after)) / F.nullif(b, F.lit(0)), 1)
