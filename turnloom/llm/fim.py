"""Fill-in-the-middle: a rope of each text is split at two unit ranks, its parts are put in another order between sentinels."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Marks before prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: Code points of a leaf (of a longer unit: all of it).
LEAF = 1024


class Rope:
    """A text as a binary tree. Every node caches how many units start in it and how many code points it has.

    A leaf holds a string and the offsets at which units start in it; None for `starts` means one at each code point.
    """

    __slots__ = ("chars", "left", "right", "starts", "text", "units")

    def __init__(self, text: str = "", starts: list[int] | None = None, left: Rope | None = None, right: Rope | None = None):
        self.text, self.starts, self.left, self.right = text, starts, left, right
        self.units = left.units + right.units if left else len(text) if starts is None else len(starts)
        self.chars = left.chars + right.chars if left else len(text)

    def __str__(self) -> str:
        out, stack = [], [self]
        while stack:
            node = stack.pop()
            if node.left:
                stack += (node.right, node.left)
            else:
                out.append(node.text)
        return "".join(out)


def leaves(text: str, unit: re.Pattern | None) -> list[Rope]:
    if unit is None:
        return [Rope(text[at : at + LEAF]) for at in range(0, len(text), LEAF)]
    out, begun, starts = [], 0, []
    for m in unit.finditer(text):
        if m.start() - begun >= LEAF and starts:
            out.append(Rope(text[begun : m.start()], starts))
            begun, starts = m.start(), []
        starts.append(m.start() - begun)
    return [*out, Rope(text[begun:], starts)] if text else out


def rope(text: str, unit: re.Pattern | None = None) -> Rope:
    """A balanced rope; units are the matches of a pattern from left to right, or code points."""
    level = leaves(text, unit)
    while len(level) > 1:
        level = [Rope(left=a, right=b) for a, b in zip(level[::2], level[1::2], strict=False)] + level[len(level) & ~1 :]
    return level[0] if level else Rope("", [])


def concat(*parts: Rope) -> Rope:
    out = None
    for p in parts:
        if p.chars:
            out = p if out is None else Rope(left=out, right=p)
    return out or Rope("", [])


def split(node: Rope, rank: int, units: bool = True) -> tuple[Rope, Rope]:
    """The rope before and from the start of the unit (or code point) of that rank; past the last one, all is before.

    Only nodes on the way down to the rank are made anew. What comes before the first unit belongs to it.
    """
    if rank <= 0:
        return Rope("", []), node
    if rank >= (node.units if units else node.chars):
        return node, Rope("", [])
    before, after = [], []
    while node.left:
        here = node.left.units if units else node.left.chars
        if rank < here:
            after.append(node.right)
            node = node.left
        else:
            before.append(node.left)
            node, rank = node.right, rank - here
    at = rank if not units or node.starts is None else node.starts[rank]
    cut = None if node.starts is None else bisect_left(node.starts, at)
    a = Rope(node.text[:at], None if cut is None else node.starts[:cut])
    b = Rope(node.text[at:], None if cut is None else [s - at for s in node.starts[cut:]])
    return concat(*before, a), concat(b, *reversed(after))


def drawn(doc_id: int | None) -> tuple[int, int, int, int]:
    """Four 32-bit numbers that only the id decides."""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return int(h[:8], 16), int(h[8:16], 16), int(h[16:24], 16), int(h[24:32], 16)


def arranged(text: str, doc_id: int | None, unit: re.Pattern | None = None, rate: int = 90, spm: int = 20) -> tuple[int, str, int | None, int | None, str]:
    """Units, form, code points of prefix and middle, and the rearranged text."""
    tree = rope(text, unit)
    n = tree.units
    h1, h2, h3, h4 = drawn(doc_id)
    if not text or any(s in text for s in SENTINELS) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    head, suffix = split(tree, high)
    prefix, middle = split(head, low)
    p, s, m = (Rope(x, []) for x in SENTINELS)
    if h4 % 100 < spm:
        return n, "spm", prefix.chars, middle.chars, str(concat(s, suffix, p, prefix, m, middle))
    return n, "psm", prefix.chars, middle.chars, str(concat(p, prefix, s, suffix, m, middle))


def restored(output: str, form: str) -> str:
    """The text from an arranged one: its rope is cut at the sentinels. A text that holds one is never arranged, and
    no sentinel can straddle a border, so that the first match of each is the one that was put in."""
    if form == "plain":
        return output
    p, s, m = SENTINELS
    inner, last = (p, s) if form == "spm" else (s, p)
    at, end = output.index(inner), output.index(m)
    head, middle = split(rope(output), end + len(m), units=False)
    head = split(head, end, units=False)[0]
    first, second = split(head, at, units=False)
    first, second = split(first, len(last), units=False)[1], split(second, len(inner), units=False)[1]
    return str(concat(second, middle, first) if form == "spm" else concat(first, middle, second))


def transform(docs: DataFrame, unit: str | None = None, rate: int = 90, spm: int = 20) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output): every whole text rearranged for filling in its middle.

    Units are the matches of the pattern `unit` from left to right, by default code points. The prefix ends before the unit of
    the smaller of two ranks drawn from doc_id, the middle before that of the larger. Of 100 documents `rate` are
    rearranged, of 100 such ones `spm` as suffix, prefix, middle and the others as prefix, suffix, middle.

    A null text counts as empty; an empty text and one that holds a sentinel stay as they are (plain). A null doc_id draws from the
    empty id. Repeated rows give the same result each; an empty table gives no rows; other columns are ignored. No shuffle: a text
    costs what its length is, and only one text at a time is held as a rope.
    """
    pattern = re.compile(unit) if unit else None
    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
    types = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.large_string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_pylist()
            rows = [arranged(t.as_py() or "", i, pattern, rate, spm) for t, i in zip(b.column(1), ids, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 5, list(types)[1:], strict=True))], schema=types)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def restore(arranged_docs: DataFrame) -> DataFrame:
    """Adds `restored`, the text rebuilt from `output` and `form` alone."""
    schema = StructType([*arranged_docs.schema.fields, StructField("restored", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            back = [restored(o.as_py(), f.as_py()) for o, f in zip(b.column("output"), b.column("form"), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(back, pa.large_string())], names=[*b.schema.names, "restored"])

    return arranged_docs.mapInArrow(run, schema)


ORACLE = """
WITH h AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
u AS (SELECT doc_id, t, length(t)::BIGINT AS n, ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2, ('0x' || x[17:24])::BIGINT AS h3, ('0x' || x[25:32])::BIGINT AS h4 FROM h),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
o AS (SELECT *, substring(t, 1, lo) AS p, substring(t, lo + 1, hi - lo) AS m, substring(t, hi + 1) AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN lo END AS prefix_chars, CASE WHEN form <> 'plain' THEN hi - lo END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM o
"""
