"""Mixing sources to target weights by a low-discrepancy schedule. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, pieces, running

#: The schedule's period, and an odd number near it over the golden ratio: slot i is the point i * STEP mod PERIOD.
PERIOD_BITS = 31
STEP = 1327217885
#: Points with the same leading bits share a cell; a slot meets only the sources of its cell. At least so many bits.
CELL_BITS = 11


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """(source, source_size, s, target): words that each source gives to the mix, for rows (source, source_size).

    Sources by code point (null last) carry the repeated weights and split share * all words by weight; none
    gives more than `most` times its size, and what it can't give goes to the others by weight. With sources by
    rising cap / weight, those below the common level are capped, and the level is (rest of the words) /
    (rest of the weights) at the first source that is not. One row a source meets in a task here, nothing else does.
    """
    everything = Window.partitionBy()
    ws = F.array(*[F.lit(float(w)) for w in weights])
    t = sizes.withColumn("s", (F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1).cast("int"))
    t = t.withColumn("w", F.get(ws, F.col("s") % len(weights))).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    t = t.withColumn("r", F.col("cap") / F.col("w"))
    before = Window.orderBy("r", "s").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rest = F.sum("source_size").over(everything) * F.lit(float(share)) - (F.sum("cap").over(before) - F.col("cap"))
    t = t.withColumn("level", rest / (F.sum("w").over(everything) - (F.sum("w").over(before) - F.col("w"))))
    first = F.min(F.when(F.col("r") >= F.col("level"), F.struct("r", "s", "level"))).over(everything)
    t = t.withColumn("target", F.least(F.col("cap"), first["level"] * F.col("w")))
    return t.select("source", "source_size", "s", F.coalesce("target", F.lit(0.0)).alias("target"))


def source_parts(targets: DataFrame) -> DataFrame:
    """Adds lo and hi, each source's part [lo, hi) of the period, in proportion to its target, in order of s."""
    upto = Window.orderBy("s").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = F.coalesce(F.try_divide(F.sum("target").over(upto), F.sum("target").over(Window.partitionBy())), F.lit(0.0)) * F.lit(float(1 << PERIOD_BITS))
    out = targets.withColumn("hi", F.floor(edge))
    return out.withColumn("lo", F.coalesce(F.lag("hi").over(Window.orderBy("s")), F.lit(0)))


def schedule(sources: DataFrame, slots: int, cell_bits: int = CELL_BITS) -> DataFrame:
    """(i, s, k): the mix's slots 0 to slots - 1, the source of each and the slot's rank within that source.

    sources: (s, lo, hi). Slot i is a golden-ratio point of the period and falls to the source whose part holds it, so
    that every stretch of the mix holds each source nearly in proportion to its target (the error grows with the
    logarithm of the stretch). Ranks are two-level running counts, so no source meets in a task.
    """
    spark = sources.sparkSession
    mask = (1 << PERIOD_BITS) - 1
    point: Column = (F.col("i").bitwiseAND(F.lit(mask)) * F.lit(STEP)).bitwiseAND(F.lit(mask))
    drawn = spark.range(slots).withColumnRenamed("id", "i").withColumn("u", point).withColumn("cell", F.shiftright("u", PERIOD_BITS - cell_bits))
    cells = sources.where("hi > lo").select("s", "lo", "hi", F.explode(F.sequence(F.shiftright("lo", PERIOD_BITS - cell_bits), F.shiftright(F.col("hi") - 1, PERIOD_BITS - cell_bits))).alias("cell"))
    dealt = drawn.join(cells, "cell").where("u >= lo and u < hi").select("s", "i")
    return running(dealt, ["s"], F.floor(F.col("i") / 50_000), ["i"], F.lit(1), "k").select("i", "s", "k")


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, block: int = 32) -> DataFrame:
    """(doc_id, size, source_size, target, taken, first_slot, last_slot): how many words of each document the mix takes,
    repeats counted, and the first and last slots of the mix that take some (null: none).

    Each source's documents are shuffled (by MD5 of doc_id) onto a line of words, which repeats; the schedule has as many
    slots of `block` words as the targets need, and a source's k-th slot takes the k-th block of its repeated
    line. What the low-discrepancy points give a source is what it gives to the mix: its target to within a few blocks.
    No word is taken more than `most` (a whole number) times: slots beyond that are passed over. Size: words; null, empty and wordless texts
    have 0 and give 0. A null source is a source of its own. Repeated rows are rows of their own, one after another
    on the line; a text of any length takes as many blocks as it fills. An empty table gives no rows; other
    columns are ignored.

    No source meets in one task: positions and ranks are two-level running sums.
    """
    spark = docs.sparkSession
    text_size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    base = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", text_size.alias("size")), "mix-rows")
    targets = source_targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    targets = materialize(source_parts(targets), "mix-sources")
    total, n_sources = targets.agg(F.coalesce(F.sum("target"), F.lit(0.0)), F.count("*")).first()
    n_rows = base.count()
    # Cells many times as many as sources, so that a cell holds few; a table of a few thousand where sources are few.
    slots = schedule(targets.select("s", "lo", "hi"), -(-int(total) // block), max(CELL_BITS, min(PERIOD_BITS, n_sources.bit_length() + 4)))

    rows = base.join(targets.select(F.col("source").alias("_source"), "s", "source_size", "target"), F.col("source").eqNullSafe(F.col("_source"))).drop("source", "_source")
    rows = materialize(rows.withColumn("h", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), "mix-sourced")
    # Sub-groups by the hash's leading bits, as many as the rows ask for, so that their order is the hash's.
    sub = F.shiftright(F.conv(F.substring("h", 1, 8), 16, 10).cast("long"), max(0, 32 - pieces(n_rows).bit_length()))
    placed = running(rows.where("size > 0"), ["s"], sub, ["h", "doc_id", "size"], F.col("size"), "a")
    placed = materialize(placed.select("s", "a", "doc_id", "size", "source_size", "target"), "mix-placed")
    # What meets the slots is slim: place on the line, block, words in it.
    again = placed.select("s", "a", "size", F.explode(F.array(*[F.col("a") + p * F.col("source_size") for p in range(int(most))])).alias("b"))
    parts = again.withColumn("k", F.explode(F.sequence(F.floor(F.col("b") / block), F.floor((F.col("b") + F.col("size") - 1) / block))))
    overlap = F.least(F.col("b") + F.col("size"), (F.col("k") + 1) * block) - F.greatest(F.col("b"), F.col("k") * block)
    parts = parts.select("s", "k", "a", overlap.cast("int").alias("words"))
    used = parts.join(slots, ["s", "k"]).groupBy("s", "a").agg(F.sum("words").alias("taken"), F.min("i").alias("first_slot"), F.max("i").alias("last_slot"))
    none = rows.where("size = 0").withColumn("taken", F.lit(0)).withColumn("first_slot", F.lit(None).cast("long")).withColumn("last_slot", F.lit(None).cast("long"))
    cols = ["doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot", "last_slot"]
    return placed.join(used, ["s", "a"], "left").select(*cols).unionByName(none.select(*cols))


def apply_mix(docs: DataFrame, **how) -> DataFrame:
    """The rows of `docs` as the mix takes them: as often as it takes their words, to the nearest whole number (half up).

    Rows that share a doc_id (null ones too) are taken alike. Null, empty and wordless texts go; an empty table stays
    empty; texts of any length move once, and columns pass through, whatever their names.
    """
    taken = mix_documents(docs, **how).groupBy(F.col("doc_id").alias("_id")).agg(F.sum("taken").alias("_taken"), F.sum("size").alias("_size"))
    copies = taken.where("_size > 0").select("_id", F.floor((2 * F.col("_taken") + F.col("_size")) / (2 * F.col("_size"))).alias("_copies")).where("_copies > 0")
    cols = docs.columns
    out = docs.join(copies.hint("merge"), F.col("doc_id").cast("long").eqNullSafe(F.col("_id")))
    return out.select(*cols, F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy")).select(*cols)


ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
z AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
n AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS s FROM z),
w AS (SELECT *, CASE s % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w, source_size * 2.0::DOUBLE AS cap FROM n),
l AS (SELECT *, cap / w AS r,
  (sum(source_size) OVER () * 1.5::DOUBLE - (sum(cap) OVER (ORDER BY cap / w, s ROWS UNBOUNDED PRECEDING) - cap))
  / (sum(w) OVER () - (sum(w) OVER (ORDER BY cap / w, s ROWS UNBOUNDED PRECEDING) - w)) AS level FROM w),
t AS (SELECT s, source, source_size, coalesce(least(cap, w * (SELECT min_by(level, struct_pack(r, s)) FROM l WHERE r >= level)), 0.0)::DOUBLE AS target FROM l),
e AS (SELECT s, floor(coalesce(sum(target) OVER (ORDER BY s ROWS UNBOUNDED PRECEDING) / sum(target) OVER (), 0.0) * 2147483648.0::DOUBLE)::BIGINT AS hi FROM t),
f AS (SELECT s, hi, coalesce(lag(hi) OVER (ORDER BY s), 0) AS lo FROM e),
g AS (SELECT i, (i * 1327217885) & 2147483647 AS u FROM (SELECT unnest(range(0, (SELECT (floor(sum(target))::BIGINT + 31) // 32 FROM t))) AS i)),
k AS (SELECT i, s, row_number() OVER (PARTITION BY s ORDER BY i) - 1 AS k FROM g JOIN f ON u >= lo AND u < hi),
p AS (SELECT row_number() OVER () AS id, d.doc_id, d.size, t.s, t.source_size, t.target,
  (sum(size) OVER (PARTITION BY t.s ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS a
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, a + pass * source_size AS b FROM p, (SELECT unnest([0, 1]) AS pass) WHERE size > 0),
x AS (SELECT *, unnest(range(b // 32, (b + size - 1) // 32 + 1)) AS k FROM q),
y AS (SELECT id, sum(least(b + size, (x.k + 1) * 32) - greatest(b, x.k * 32))::BIGINT AS taken, min(i) AS first_slot, max(i) AS last_slot FROM x JOIN k ON x.s = k.s AND x.k = k.k GROUP BY id)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken, first_slot, last_slot FROM p LEFT JOIN y USING (id)
"""
