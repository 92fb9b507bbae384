"""Which texts contain which needles, as a join: each needle is looked for where its rarest byte gram occurs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import written

#: Bytes of the longest grams (a power of two), and bits of the filter that grams of texts pass: a fixed size, whatever the needles.
GRAM, BITS = 16, 25
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(text: bytes, levels: set[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(bytes, hash of the gram that starts at each byte), for grams of some powers of two bytes; longer ones are made of shorter ones."""
    h, size, power = np.frombuffer(text, np.uint8).astype(np.uint64) + np.uint64(1), 1, _MULTIPLIER
    with np.errstate(over="ignore"):
        while len(h):
            if size in levels:
                mixed = (h ^ (h >> np.uint64(31))) * np.uint64(2 * size + 1)
                yield size, (mixed ^ (mixed >> np.uint64(29))).view(np.int64)
            if size >= GRAM:
                return
            h = h[:-size] * power + h[size:]
            size, power = 2 * size, power * power


def level(length: int) -> int:
    """Bytes of the grams by which a needle of so many bytes is found."""
    return min(GRAM, 1 << (length.bit_length() - 1))


def _grams(needles: DataFrame, needle_id: str, needle: str) -> DataFrame:
    """(needle, gram, bytes): all grams of each needle, each once."""
    kind = needles.schema[needle_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                raw = b.column(1)[i].as_py().encode()
                for size, h in gram_hashes(raw, {level(len(raw))}):
                    u = np.unique(h)
                    yield pa.RecordBatch.from_arrays([pa.concat_arrays([b.column(0).slice(i, 1)] * len(u)), pa.array([b.column(1)[i].as_py()] * len(u), pa.string()), pa.array(u), pa.array(np.full(len(u), size, np.int32))], names=["id", "text", "_gram", "_bytes"])

    out = needles.where(F.col(needle_id).isNotNull() & (F.length(needle) > 0)).select(needle_id, needle)
    return out.mapInArrow(run, f"{needle_id} {kind}, {needle} string, _gram long, _bytes int")


def _filter(grams: DataFrame) -> np.ndarray:
    """A bit for each gram's hash; at most 2 ** (BITS - 6) words come to the driver."""
    slot = F.col("_gram").bitwiseAND(F.lit((1 << BITS) - 1))
    words = grams.select(F.shiftright(slot, 6).cast("int").alias("w"), F.expr("shiftleft(1L, cast(_gram & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    out = np.zeros(1 << (BITS - 6), np.uint64)
    out[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64).view(np.uint64)
    return out


def _passing(text: bytes, levels: set[int], bits: np.ndarray) -> np.ndarray:
    found = [np.zeros(0, np.int64)]
    for _, h in gram_hashes(text, levels):
        slot = h & ((1 << BITS) - 1)
        found.append(h[(bits[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1) == 1])
    return np.concatenate(found)


def contained(texts: DataFrame, text_id: str, text: str, needles: DataFrame, needle_id: str, needle: str) -> DataFrame:
    """(text_id, needle_id), each once: texts that contain a needle word for word. A text_id may have several texts (a payload's strings).

    Every needle's grams are counted over all texts, and its rarest one becomes its key: texts send the keys that they hold, what meets a needle is
    verified. The needles stay a table; what is broadcast is a filter of fixed size, by which texts send only what may be a gram of some
    needle. Needles shorter than the grams have shorter ones. Empty needles and null ids or texts are nowhere.
    """
    spark = texts.sparkSession
    grams = written(_grams(needles, needle_id, needle), "containment-grams")
    levels = {r["_bytes"] for r in grams.select("_bytes").distinct().collect()}
    filled = texts.where(F.col(text_id).isNotNull() & (F.length(text) > 0)).select(text_id, text)
    kind = texts.schema[text_id].dataType.simpleString()
    every = spark.sparkContext.broadcast(_filter(grams))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = [np.unique(_passing(t.as_py().encode(), levels, every.value)) for t in b.column(0)]
            u, n = np.unique(np.concatenate(held) if held else np.zeros(0, np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(n)], names=["_gram", "_n"])

    counts = filled.select(text).mapInArrow(counted, "_gram long, _n long").groupBy("_gram").agg(F.sum("_n").alias("_n"))
    rarest = F.min_by("_gram", F.struct(F.coalesce("_n", F.lit(0)), "_gram")).alias("_gram")
    keys = written(grams.join(counts, "_gram", "left").groupBy(needle_id, needle).agg(rarest, F.min(F.coalesce("_n", F.lit(0))).alias("_n")).where("_n > 0").drop("_n"), "containment-keys")
    every.destroy()
    wanted = spark.sparkContext.broadcast(_filter(keys))

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = [np.unique(_passing(t.as_py().encode(), levels, wanted.value)) for t in b.column(1)]
            at = np.repeat(np.arange(len(b)), [len(h) for h in held])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(np.concatenate([np.zeros(0, np.int64), *held]))], names=["id", "_gram"])

    met = filled.mapInArrow(sent, f"{text_id} {kind}, _gram long").join(keys, "_gram").select(text_id, needle_id, needle).distinct()
    return met.join(filled, text_id).where(F.contains(text, needle)).select(text_id, needle_id).distinct()
