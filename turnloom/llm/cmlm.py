"""LM scoring: online logistic context mixing over the binary decisions of a word code.

A text is its lower-cased words and an end. The coded words have a prefix code (its shape from which documents words
share); any other word is an escape, then one of those counted in training, by its count, or a new one, spelled in
bytes by a code of the same kind. Every bit of a code is predicted by several hashed contexts, whose stretched
probabilities are summed with weights that a gate chooses; the weights are learnt from training texts and refined as
a text goes by. The bits' probabilities multiply to the text's.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from numpy.lib.stride_tricks import sliding_window_view
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .langid import held_out

#: The end of a text; no word is empty.
END = b""
#: Most slots of a table of word contexts, and decisions counted for each of fewer. Every node of the tree has them: node and
#: context are hashed together.
WORD_SLOTS, SLOT_DECISIONS = 1 << 22, 8
#: Newton steps that the weights are learnt with, each over training texts of its own, four times as many as all before it.
GATE_STEPS = 4
#: Slots that travel together when tasks' tables are summed, and tasks whose slots meet in one group.
STRIP, FAN = 1 << 14, 256
#: Levels of branches of words that share documents; dimensions of their vectors; frequent words that give documents a direction.
DEPTH, DIMS, ANCHORS = 5, 8, 512
#: Slots of the tables of one, two and four bytes before.
BYTE_SLOTS = (1 << 16, 1 << 20, 1 << 20)
#: Weight of the shorter context's prediction, in counts.
PRIOR = np.float32(8.0)
#: The shorter context's parts below which a context was seen often: more than 30 times, more than 1,000.
OFTEN = (PRIOR / (PRIOR + np.float32(30.5)), PRIOR / (PRIOR + np.float32(1000.5)))
#: Symbols that are predicted at a time.
PIECE = 2048
#: Symbols of a segment: refinement starts afresh with each. Decisions that are mixed with one set of weights.
SEGMENT, BLOCK = 256, 32


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Maximal runs without 0x20 or 0x09-0x0D, A-Z lowered, of one text after another, and where each text ends."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    ends, flat = np.asarray(lists.offsets)[1:] - lists.offsets[0].as_py(), lists.flatten().cast(pa.binary())
    there = np.asarray(pc.binary_length(flat)) > 0  # around a text's outer white space there are empty ones
    if there.all():
        return flat, ends.astype(np.int64)
    return flat.filter(pa.array(there)), np.r_[0, np.cumsum(there)][ends]


def runs(b: pa.RecordBatch, most: int = 1 << 24) -> Iterator[pa.RecordBatch]:
    """Rows with about `most` bytes of text together, or one."""
    at = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(b.column("text")), 0)).astype(np.int64)) // most
    cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), b.num_rows]
    return (b.slice(lo, hi - lo) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True) if hi > lo)


class Code:
    """A binary code: each symbol's nodes and bits, and each node's share of ones. Nodes of four levels under one are
    numbered together, 1 to 15 from a multiple of 16, so that what a path looks up lies side by side.

    `tree` is a pair of trees, or the symbols of a leaf, which get a Huffman code there. As nodes have exact
    probabilities, any tree gives the symbols theirs; its shape decides what contexts can predict.
    """

    def __init__(self, counts: list[int], tree: tuple | list | None = None):
        k = len(counts)
        kids: list[tuple[int, int]] = []
        weight: list[int] = []

        def join(a: tuple[int, int], b: tuple[int, int]) -> tuple[int, int]:
            kids.append((a[1], b[1]))
            weight.append(a[0] + b[0])
            return weight[-1], k + len(kids) - 1

        def build(t: tuple | list) -> tuple[int, int] | None:
            if isinstance(t, tuple):
                a, b = (build(x) for x in t)
                return join(a, b) if a and b else a or b
            heap = [(max(1, counts[i]), i) for i in t]
            heapq.heapify(heap)
            while len(heap) > 1:
                heapq.heappush(heap, join(heapq.heappop(heap), heapq.heappop(heap)))
            return heap[0] if heap else None

        root = build(list(range(k)) if tree is None else tree)
        self.paths: list[tuple[tuple[int, ...], tuple[int, ...]]] = [((), ())] * k
        ones: list[np.ndarray] = []
        level = [(root[1], (), ())] if root else []
        while level:
            after = []
            for x, nodes, bits in level:
                if x < k:
                    self.paths[x] = (nodes, bits)
                    continue
                a, b = kids[x - k]
                if len(nodes) % 4:
                    number = nodes[-1] + nodes[-1] % 16 + bits[-1]
                else:
                    number = 16 * len(ones) + 1
                    ones.append(np.full(16, 0.5))
                ones[number // 16][number % 16] = (weight[b - k] if b >= k else max(1, counts[b])) / weight[x - k]
                after += [(a, (*nodes, number), (*bits, 0)), (b, (*nodes, number), (*bits, 1))]
            level = after
        self.ones = np.concatenate(ones) if ones else np.full(1, 0.5)

    def decisions(self) -> Decisions:
        return Decisions([len(p) for p, _ in self.paths], [n for p, _ in self.paths for n in p], [b for _, bits in self.paths for b in bits])


class Decisions:
    """Node and bit of each decision of each symbol of a code, as 2 * node + bit."""

    def __init__(self, size: list[int], node: list[int], bit: list[int]):
        self.size, self.step = np.array(size, np.int64), 2 * np.array(node, np.uint32) + np.array(bit, np.uint32)
        self.first = np.cumsum(self.size) - self.size
        #: Twice the node's hash, and the bit.
        self.key = hashed(self.step >> np.uint32(1)) << np.uint32(1) | self.step & np.uint32(1)

    def of(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols' decisions one after another: how many each has, and their places in `step` and `key`."""
        n = self.size.take(symbols, mode="wrap")
        ends = np.cumsum(n)
        flat = np.repeat(self.first.take(symbols, mode="wrap") - (ends - n), n)
        flat += np.arange(len(flat))
        return n, flat


def clusters(symbols: np.ndarray, vectors: np.ndarray, weight: np.ndarray, depth: int) -> tuple | list:
    """A tree of the symbols: each level cuts along the main axis of their vectors where the two sides differ most."""
    if depth == 0 or len(symbols) < 3:
        return symbols.tolist()
    x, w = vectors[symbols], weight[symbols]
    x = x - np.average(x, axis=0, weights=w)
    along = x @ np.linalg.eigh((x * w[:, None]).T @ x)[1][:, -1]
    order = np.argsort(along, kind="stable")
    low, mass = np.cumsum((along * w)[order])[:-1], np.cumsum(w[order])[:-1]
    cut = int(np.argmax(low**2 * (1 / mass + 1 / np.maximum(w.sum() - mass, 1e-9)))) + 1
    return tuple(clusters(np.sort(part), vectors, weight, depth - 1) for part in (symbols[order[:cut]], symbols[order[cut:]]))


def leaves(tree: tuple | list, out: np.ndarray, number: int = 0) -> int:
    """Numbers the leaves in `out`, by symbol."""
    if isinstance(tree, tuple):
        for t in tree:
            number = leaves(t, out, number)
        return number
    out[tree] = number
    return number + 1


def mixed(*parts: np.ndarray) -> np.ndarray:
    h = np.zeros(len(parts[0]), np.uint32)
    for p in parts:
        h = (h ^ p.astype(np.uint32)) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
    return h


def hashed(node: np.ndarray) -> np.ndarray:
    """Nodes that are numbered together differ in the last four bits only, and meet in a cache line of a table."""
    node = node.astype(np.uint32)
    h = (node >> np.uint32(4)) * np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(13)
    h *= np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(16)
    return h ^ node & np.uint32(15)


def slots(node: np.ndarray, context: np.ndarray, size: int) -> np.ndarray:
    """The table slot of each decision by hashes of node and context, `size` slots (a power of two) in all."""
    return ((hashed(node) ^ context) & np.uint32(size - 1)).astype(np.int64)


def keyed_slots(key: np.ndarray, context: np.ndarray, size: int) -> np.ndarray:
    """Twice these slots, and the decision's bit, by its key."""
    h = context << np.uint32(1)
    h ^= key
    h &= np.uint32(2 * size - 1)
    return h


def logistic(s: np.ndarray) -> np.ndarray:
    """In place, of -14 to 14; by tanh, which numpy has vector code for."""
    np.clip(s, -14, 14, out=s)
    s *= np.float32(0.5)
    np.tanh(s, out=s)
    s *= np.float32(0.5)
    s += np.float32(0.5)
    return s


def probable(p: np.ndarray) -> np.ndarray:
    return np.clip(p, np.float32(1e-6), np.float32(1 - 1e-6))


class Counts:
    """Ones and all by slot, four bytes each, as every task holds all of them."""

    def __init__(self, ones: np.ndarray, total: np.ndarray):
        share = ones / np.maximum(total, 1)
        share *= 65_535
        self.packed = np.minimum(total, 65_535).astype(np.uint32)
        self.packed <<= np.uint32(16)
        self.packed |= np.rint(share, out=share).astype(np.uint32)

    @cached_property
    def pairs(self) -> np.ndarray:
        """By slot, its ones' and the shorter context's part in a probability, side by side; made where it is used."""
        out = np.empty(len(self.packed), np.complex64)
        for lo in range(0, len(out), 1 << 16):
            v, part = self.packed[lo : lo + (1 << 16)], out[lo : lo + (1 << 16)]
            n = (v >> np.uint32(16)).astype(np.float32)
            part.real = (v & np.uint32(0xFFFF)).astype(np.float32) * np.float32(1 / 65_535) * n / (n + PRIOR)
            part.imag = PRIOR / (n + PRIOR)
        return out

    def predict(self, at: np.ndarray, before: np.ndarray, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities of a one, smoothed by the shorter context's, their stretched values, and gates; of each decision
        its bit in `own` is left out."""
        pair = self.pairs.take(at, mode="wrap")
        p, weight = pair.real, pair.imag
        if own is None:
            p = weight * before + p
        else:
            left = 1 - weight * (1 / PRIOR)
            p = (weight * (before - own * (1 / PRIOR)) + p) / left
            weight = weight / left
        np.clip(p, np.float32(1e-6), np.float32(1 - 1e-6), out=p)
        st = 1 - p
        np.divide(p, st, out=st)
        return p, np.log(st, out=st), (weight < OFTEN[0]).view(np.uint8) + (weight < OFTEN[1]).view(np.uint8)


def refined(st: np.ndarray, z: np.ndarray, bit: np.ndarray, size: np.ndarray, rate: float = 0.5, block: int = BLOCK) -> np.ndarray:
    """Natural log probability of each segment's bits.

    st: its predictors' stretched probabilities (a row each); z: their sum by the weights learnt; size: decisions of
    each segment, one segment after another. A segment adds to those weights and to their sum corrections of its own,
    0 at first; they stand still within a block of decisions and then move along its gradient. Segments go side by side.
    """
    rows = sliding_window_view(np.pad(signed(st, z, bit), ((0, 0), (0, block))), block, axis=1)
    return refined_blocks(lambda at: rows[:, at], len(st) + 1, size, rate, block)


def signed(st: np.ndarray, z: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """Predictors, a one for what is added to their sum, and that sum, each turned about where the bit is 0: so they speak of the bit that came."""
    out = np.empty((len(st) + 2, *z.shape), np.float32)
    way = np.subtract(bit * np.float32(2), 1, out=out[-2])
    np.multiply(st, way, out=out[:-2])
    np.multiply(z, way, out=out[-1])
    return out


def refined_blocks(rows: Callable[[np.ndarray], np.ndarray], k: int, size: np.ndarray, rate: float = 0.5, block: int = BLOCK) -> np.ndarray:
    """`refined` by `rows`, which makes the k + 1 rows of `signed` of the blocks of decisions that begin at given places."""
    m = len(size)
    order = np.argsort(-size, kind="stable")  # segments that still go on come first
    first, size = (np.cumsum(size) - size)[order], size[order]
    delta = np.zeros((k, m, 1), np.float32)
    total, reach, step = np.zeros(m), np.arange(block), np.float32(rate / (block + 64))
    for at in range(0, int(size[0]) if m else 0, block):
        a, whole = int(np.searchsorted(-size, -at, side="left")), int(np.searchsorted(-size, -at - block, side="right"))
        x = rows(first[:a] + at)
        s = x[-1]
        for d, row in zip(delta, x[:-1], strict=True):
            s += d[:a] * row
        e = logistic(np.negative(s, out=s))  # what the bit that came lacks of certainty
        if whole < a:
            e[whole:] *= reach < (size[whole:a] - at)[:, None]
        for d, row in zip(delta, x[:-1], strict=True):
            d[:a, 0] += step * np.einsum("ij,ij->i", e, row)
        p = np.subtract(1, e, out=e)
        if block % 4 == 0:  # four of them, at least 1e-25, share a logarithm
            p = p[:, : block // 2] * p[:, block // 2 :]
            p = p[:, : block // 4] * p[:, block // 4 :]
        total[:a] += np.log(p).sum(axis=1)
    out = np.empty(m)
    out[order] = total
    return out


class Mixer:
    """A code, the counts of each of its contexts, and the weights by gate (predictor by gate).

    A gate is how often each context was seen: at most 30 times, at most 1,000, more.
    """

    def __init__(self, decisions: Decisions, ones: np.ndarray, counts: list[Counts]):
        self.d, self.ones, self.counts = decisions, probable(ones.astype(np.float32)), counts
        self.first = np.log(self.ones / (1 - self.ones))
        self.gates = 3 ** len(counts)
        self.start = np.full((1 + len(counts), self.gates), 1 / (1 + len(counts)))

    @cached_property
    def alone(self) -> np.ndarray:
        """Of each place in the decisions, the probability of a one without contexts and, beside it, stretched."""
        node = self.d.step >> np.uint32(1)
        return self.ones[node] + self.first[node] * np.complex64(1j)

    def inputs(self, symbols: np.ndarray, contexts: list[np.ndarray], learnt: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bits of the symbols' decisions, predictors' stretched probabilities (a row each) and gates; if these are
        `learnt` symbols, each decision by the counts of all others."""
        n, flat = self.d.of(symbols)
        return self.inputs_at(flat, [np.repeat(c, n) for c in contexts], learnt)

    def inputs_at(self, flat: np.ndarray, contexts: list[np.ndarray], learnt: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """These of decisions by their places and contexts."""
        key, alone = self.d.key.take(flat, mode="wrap"), self.alone.take(flat, mode="wrap")
        bit = (key & np.uint32(1)).astype(np.float32)
        st, gate = np.empty((1 + len(contexts), len(key)), np.float32), np.zeros(len(key), np.uint8)
        p, st[0] = alone.real, alone.imag
        for i, (c, ctx) in enumerate(zip(self.counts, contexts, strict=True)):
            at = keyed_slots(key, ctx, len(c.packed))
            at >>= np.uint32(1)
            p, st[i + 1], seen = c.predict(at.astype(np.int64), p, bit if learnt else None)
            seen *= np.uint8(3**i)
            gate += seen
        return bit, st, gate

    def weighed(self, st: np.ndarray, gate: np.ndarray) -> np.ndarray:
        w, gate = self.start.astype(np.float32), gate.astype(np.int64)
        z = w[0].take(gate, mode="wrap") * st[0]
        for i in range(1, len(st)):
            z += w[i].take(gate, mode="wrap") * st[i]
        return z

    def score(self, symbols: np.ndarray, ends: np.ndarray, contexts: list[np.ndarray], together: int = 100_000) -> np.ndarray:
        """Natural log probability of each text (that ends at `ends`), about `together` symbols in memory at a time."""
        begin = np.r_[0, ends[:-1]]
        parts = np.maximum(1, -(-(ends - begin) // SEGMENT))
        text = np.repeat(np.arange(len(ends)), parts)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
        lo = begin[text] + nth * SEGMENT
        hi = np.minimum(lo + SEGMENT, ends[text])
        cost = np.zeros(len(text))
        # Segments follow one another, so a run of them is a run of symbols.
        cuts = np.r_[0, np.flatnonzero(np.diff(lo // together)) + 1, len(text)] if len(text) else [0]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            run = slice(lo[a], hi[b - 1])
            n, flat = self.d.of(symbols[run])
            size = np.diff(np.r_[0, np.cumsum(n)][np.r_[lo[a:b] - lo[a], hi[b - 1] - lo[a]]])
            which = np.repeat(np.arange(run.start, run.stop, dtype=np.int32), n)
            places = [sliding_window_view(np.r_[x, np.zeros(BLOCK, np.int32)], BLOCK) for x in (flat.astype(np.int32), which)]

            def rows(at: np.ndarray, places: list[np.ndarray] = places) -> np.ndarray:
                flat, which = (x[at].astype(np.int64).ravel() for x in places)
                bit, st, gate = self.inputs_at(flat, [c.take(which, mode="wrap") for c in contexts])
                return signed(st, self.weighed(st, gate), bit).reshape(-1, len(at), BLOCK)

            cost[a:b] = refined_blocks(rows, len(self.start) + 1, size)
        return np.bincount(text, cost, len(ends))

    def slopes(self, symbols: np.ndarray, contexts: list[np.ndarray]) -> np.ndarray:
        """Gradient and Hessian, by gate, of the log probability of learnt symbols' decisions in the weights; flat."""
        k = len(self.start)
        gradient, hessian = np.zeros((self.gates, k)), np.zeros((self.gates, k, k))
        for lo in range(0, len(symbols), PIECE):
            bit, st, gate = self.inputs(symbols[lo : lo + PIECE], [c[lo : lo + PIECE] for c in contexts], learnt=True)
            p = logistic(self.weighed(st, gate))
            order = np.argsort(gate, kind="stable")
            x, p, e = st.take(order, axis=1), p.take(order), (bit - p).take(order)
            weighted = x * (p * (1 - p))
            ends = np.cumsum(np.bincount(gate, minlength=self.gates)).tolist()
            for g, (a, b) in enumerate(zip([0, *ends], ends, strict=False)):
                if a < b:
                    gradient[g] += x[:, a:b] @ e[a:b]
                    hessian[g] += weighted[:, a:b] @ x[:, a:b].T
        return np.concatenate([gradient.ravel(), hessian.ravel()])

    def quadratic(self, slopes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each gate, the terms linear and quadratic in the weights of those decisions' log probability, from its slopes here."""
        k, g = self.start.shape
        gradient, hessian = slopes[: g * k].reshape(g, k), slopes[g * k :].reshape(g, k, k)
        return gradient + np.einsum("ijk,ki->ij", hessian, self.start), hessian

    def solved(self, linear: np.ndarray, hessian: np.ndarray, ridge: float = 16.0) -> np.ndarray:
        """The weights best by the summed terms of each gate's logistic regression; the ridge holds gates with few bits at the mean."""
        k = len(self.start)
        return np.linalg.solve(hessian + ridge * np.eye(k), (linear + ridge / k)[:, :, None])[:, :, 0].T


class Vocabulary:
    """The coded words; symbol K is the escape, told from the rest at the root. Words that share documents share branches."""

    def __init__(self, ranked: list[tuple[bytes, int]], tail: int):
        self.ids = {w: i for i, (w, _) in enumerate(ranked)}
        self.counts, self.escape, self.tail = [c for _, c in ranked], len(ranked), tail
        self.kind = np.dtype("<u2" if self.escape < 1 << 16 else "<u4")
        rng = np.random.default_rng(3)
        self.anchors = np.zeros((self.escape + 1, DIMS), np.float32)
        n = min(ANCHORS, self.escape)
        self.anchors[:n] = rng.standard_normal((n, DIMS))
        if END in self.ids:
            self.anchors[self.ids[END]] = 0

    def shape(self, vectors: np.ndarray) -> None:
        """The words' code from a vector for each: the sum of the directions of the documents around it."""
        weight = np.array(self.counts, float)
        mean = vectors / np.maximum(weight, 1)[:, None]
        tree = clusters(np.arange(self.escape), mean, weight, DEPTH) if self.escape else []
        self.leaf = np.zeros(self.escape + 1, np.int32)
        leaves(tree, self.leaf)
        code = Code([*self.counts, self.tail + 1], ([self.escape], tree))
        self.word, self.word_ones = code.decisions(), code.ones
        decisions = int((np.array([*self.counts, self.tail]) * self.word.size).sum())
        self.slots = 1 << min(WORD_SLOTS, max(STRIP, decisions // SLOT_DECISIONS)).bit_length() - 1

    def spell(self, byte_counts: list[int]) -> None:
        code = Code(byte_counts)
        self.byte, self.byte_ones = code.decisions(), code.ones

    @cached_property
    def coded(self) -> pa.Array:
        return pa.array(list(self.ids), pa.binary())

    def encoded(self, text: str | None) -> tuple[bytes, Counter]:
        """The text's symbols with its end, packed, and its escaped words."""
        symbols, w, k = (x[0].as_py() for x in self.encoded_all(pa.array([text], pa.string())))
        return symbols, Counter(dict(zip(w, k, strict=True)))

    def encoded_all(self, texts: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
        """Of each text, its symbols with its end, packed; its different escaped words, and how often each stands there."""
        flat, ends = words(texts)
        m = len(texts)
        ids = pc.index_in(flat, value_set=self.coded).fill_null(self.escape).to_numpy(zero_copy_only=False)
        last = ends + np.arange(m)  # an end follows each text's words
        symbols, inner = np.full(len(ids) + m, self.ids.get(END, self.escape), self.kind), np.ones(len(ids) + m, bool)
        inner[last] = False
        symbols[inner] = ids
        escaped = np.flatnonzero(symbols == self.escape)
        text = np.searchsorted(last, escaped)
        w = flat.take(pa.array(np.where(inner[escaped], escaped - text, 0), mask=~inner[escaped])).fill_null(END).dictionary_encode()
        pair, k = np.unique(text * max(1, len(w.dictionary)) + w.indices.to_numpy(), return_counts=True)
        first = pa.array(np.searchsorted(pair, np.arange(m + 1) * max(1, len(w.dictionary))).astype(np.int32))
        offset = np.r_[0, last + 1].astype(np.int64) * self.kind.itemsize
        packed = pa.Array.from_buffers(pa.binary(), m, [None, pa.py_buffer(offset.astype(np.int32)), pa.py_buffer(symbols)])
        return packed, pa.ListArray.from_arrays(first, w.dictionary.take(pa.array(pair % max(1, len(w.dictionary))))), pa.ListArray.from_arrays(first, pa.array(k.astype(np.int64)))

    def word_contexts(self, symbols: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        """Hashes of the coded word before, and of the branches of the three before; fewer at a text's start."""
        n = len(symbols)
        first = np.repeat(np.r_[0, ends[:-1]], np.diff(np.r_[0, ends]))
        known = np.flatnonzero(symbols != self.escape)
        before = np.cumsum(symbols != self.escape) - (symbols != self.escape)  # how many known ones precede
        back = []
        for k in range(1, 4):
            at = np.where(before >= k, known[np.maximum(before - k, 0)] if len(known) else 0, -1)
            back.append(np.where(at >= first, symbols[np.maximum(at, 0)], self.escape) if n else symbols)
        return [mixed(back[0]), mixed(*(np.where(b == self.escape, -1, self.leaf[b]) for b in back))]

    def spelled(self, escaped: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Bytes of the words, each with an end (256), where each word ends, and hashes of the one, two and four bytes before."""
        size = np.fromiter((len(w) + 1 for w in escaped), np.int64, len(escaped))
        ends = np.cumsum(size)
        flat = np.frombuffer(b"".join(w + b" " for w in escaped), np.uint8).astype(np.int32)
        flat[ends - 1] = 256
        back = [np.r_[np.full(k, 257, np.int32), flat][: len(flat)] for k in range(1, 5)]
        place = np.arange(len(flat)) - np.repeat(ends - size, size)
        for k, b in enumerate(back, 1):
            b[place < k] = 257
        return flat, ends, [mixed(back[0]), mixed(*back[:2]), mixed(*back)]


class Tally:
    """Zeros and ones by slot of one task, for several tables of contexts."""

    def __init__(self, sizes: list[int]):
        self.table = [np.zeros(2 * s, np.int32) for s in sizes]
        self.one = np.ones(0, np.int32)

    def add(self, d: Decisions, symbols: np.ndarray, contexts: list[np.ndarray]) -> None:
        n, flat = d.of(symbols)
        key = d.key.take(flat, mode="wrap")
        if len(self.one) < len(key):
            self.one = np.ones(2 * len(key), np.int32)
        for table, ctx in zip(self.table, contexts, strict=True):
            # An array of ones takes a path of add.at that a single one doesn't, nearly 20 times as fast.
            np.add.at(table, keyed_slots(key, np.repeat(ctx, n), len(table) // 2).astype(np.int64), self.one[: len(key)])

    def strips(self) -> Iterator[pa.RecordBatch]:
        """(table, strip, counts): slots that were hit, STRIP together."""
        for i, table in enumerate(self.table):
            for lo in range(0, len(table), 2 * STRIP):
                part = table[lo : lo + 2 * STRIP]
                if part.any():
                    yield pa.RecordBatch.from_pydict({"t": pa.array([i], pa.int32()), "strip": pa.array([lo // (2 * STRIP)], pa.int32()), "n": [packed(part)]})


def packed(counts: np.ndarray) -> bytes:
    """Counts of a strip, byte planes apart, compressed; a slot's pair beyond 32 bits is halved until it fits, as its share is what counts."""
    if len(counts) and counts.max() > 2**31 - 1:
        pairs = counts.reshape(-1, 2)
        counts = (pairs >> np.maximum(0, np.ceil(np.log2(np.maximum(pairs.max(axis=1), 1) / (2**31 - 1))).astype(np.int64))[:, None]).ravel()
    return zlib.compress(counts.astype(np.int32).view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpacked(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(b), np.uint8).reshape(4, -1).T).view(np.int32).ravel()


STRIPS = "t int, strip int, n binary"


def _summed(parts: DataFrame, sizes: list[int], fan: int = FAN) -> list[Counts]:
    """Tables from their tasks' strips, summed in a tree: at most `fan` tasks' strips of a place meet in one group, on every
    level but the last before which they are no more than that."""

    def add(pdf: pd.DataFrame) -> np.ndarray:
        return sum(unpacked(b).astype(np.int64) for b in pdf["n"])

    def inner(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"t": pdf["t"][:1], "strip": pdf["strip"][:1], "node": pdf["node"][:1], "n": [packed(add(pdf))]})

    def last(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"t": pdf["t"][:1], "strip": pdf["strip"][:1], "n": [add(pdf).astype(np.float32).tobytes()]})

    nodes = parts.rdd.getNumPartitions()
    if nodes > fan:
        parts = parts.withColumn("node", F.spark_partition_id())
    while nodes > fan:
        parts = parts.withColumn("node", F.floor(F.col("node") / fan).cast("int")).groupBy("t", "strip", "node").applyInPandas(inner, "t int, strip int, node int, n binary")
        nodes = -(-nodes // fan)
    tables = [(np.zeros(s, np.float32), np.zeros(s, np.float32)) for s in sizes]
    for r in parts.select("t", "strip", "n").groupBy("t", "strip").applyInPandas(last, STRIPS).toLocalIterator():
        n = np.frombuffer(r["n"], np.float32).reshape(-1, 2)
        ones, total = tables[r["t"]]
        at = slice(r["strip"] * STRIP, r["strip"] * STRIP + len(n))
        ones[at], total[at] = n[:, 1], n.sum(axis=1)
    return [Counts(*tables.pop(0)) for _ in sizes]


def token_counts(train: DataFrame) -> DataFrame:
    """(w, c) of all tokens of texts, ends included (as the empty word)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for whole in batches for x in runs(whole, 1 << 25)):
            c = pc.value_counts(words(b.column("text"))[0])
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([c.field(0), pa.array([END], pa.binary())]), pa.concat_arrays([c.field(1), pa.array([b.num_rows], pa.int64())])], ["w", "c"])

    return train.select("text").mapInArrow(run, "w binary, c long").groupBy("w").agg(F.sum("c").alias("c"))


def vocabulary(counts: DataFrame, coded: int, least: int) -> Vocabulary:
    """The `coded` most frequent words, seen `least` times or more: a bound on the model, not on what is counted or
    scored. All other training tokens give the escape its probability, and every different word gives its bytes."""
    top = counts.where((F.col("c") >= least) | (F.col("w") == F.lit(END))).orderBy(F.desc("c"), "w").limit(coded).select("w", "c").toArrow()
    ranked = list(zip(top.column("w").to_pylist(), top.column("c").to_pylist(), strict=True))
    tail = (counts.agg(F.sum("c")).first()[0] or 0) - sum(c for _, c in ranked)

    def count_bytes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = np.zeros(257, np.int64)
        for pdf in batches:
            c[:256] += np.bincount(np.frombuffer(b"".join(pdf["w"]), np.uint8), minlength=256)
            c[256] += len(pdf)
        yield pd.DataFrame({"b": np.arange(257), "n": c})

    v = Vocabulary(ranked, int(tail))
    n = np.ones(257, np.int64)
    for r in counts.select("w").where(F.col("w") != F.lit(END)).mapInPandas(count_bytes, "b int, n long").groupBy("b").agg(F.sum("n").alias("n")).collect():
        n[r["b"]] += r["n"]
    v.spell(n.tolist())
    return v


def encode(docs: DataFrame, v: Vocabulary) -> DataFrame:
    """(row, doc_id, n_bytes, symbols, w, k) of documents (doc_id, text), written once: later passes read no text.

    symbols are packed; w and k are the text's different escaped words and how often each stands there.
    """
    shared = docs.sparkSession.sparkContext.broadcast(v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for whole in batches for x in runs(whole)):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), *shared.value.encoded_all(b.column("text"))], ["doc_id", "n_bytes", "symbols", "w", "k"])

    src = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    rows = src.mapInArrow(run, "doc_id long, n_bytes long, symbols binary, w array<binary>, k array<long>")
    out = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "lm-encoded")
    shared.destroy()  # what it made is written
    return out


def _symbols(column: pa.Array, kind: np.dtype, most: int = 300_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows (first, end) with their symbols and where each row ends; one row or about `most` symbols in each."""
    offset = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset).astype(np.int64) // kind.itemsize
    flat = np.frombuffer(column.buffers()[2] or b"", kind)
    cuts = np.r_[0, np.flatnonzero(np.diff((offset[:-1] - offset[0]) // most)) + 1, len(column)] if len(column) else [0]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(a), int(b), flat[offset[a] : offset[b]].astype(np.int32), offset[a + 1 : b + 1] - offset[a]


def _learn_code(train: DataFrame, v: Vocabulary) -> None:
    """Shapes the words' code by the directions of the documents that hold them."""
    shared = train.sparkSession.sparkContext.broadcast(v)
    dims = [f"d{i}" for i in range(DIMS)]

    def directions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        total = np.zeros((v.escape + 1, DIMS))
        for b in batches:
            for _, _, symbols, ends in _symbols(b.column("symbols"), v.kind, 200_000):
                d = np.add.reduceat(v.anchors[symbols], np.r_[0, ends[:-1]], axis=0)
                d /= np.maximum(np.linalg.norm(d, axis=1), 1e-9)[:, None]
                n = np.diff(np.r_[0, ends])
                for i in range(DIMS):
                    total[:, i] += np.bincount(symbols, np.repeat(d[:, i], n), v.escape + 1)
        hit = np.flatnonzero(total.any(axis=1))
        # In whole 1024ths, so that the order in which tasks' sums arrive doesn't matter.
        yield pa.RecordBatch.from_arrays([pa.array(hit.astype(np.int32)), *[pa.array(np.rint(total[hit, i] * 1024).astype(np.int64)) for i in range(DIMS)]], ["slot", *dims])

    rows = train.select("symbols").mapInArrow(directions, "slot int, " + ", ".join(f"{c} long" for c in dims))
    got = rows.groupBy("slot").agg(*[F.sum(c).alias(c) for c in dims]).where(F.col("slot") < v.escape).toPandas()
    vectors = np.zeros((v.escape, DIMS))
    vectors[got["slot"]] = got[dims] / 1024
    shared.destroy()
    v.shape(vectors)


class Model:
    """The words' mixer and the mixer of new words' bytes."""

    def __init__(self, vocabulary: Vocabulary, word: list[Counts], byte: list[Counts]):
        self.v = vocabulary
        self.word = Mixer(vocabulary.word, vocabulary.word_ones, word)
        self.byte = Mixer(vocabulary.byte, vocabulary.byte_ones, byte)

    def score(self, symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Natural log probability of texts' symbols."""
        return self.word.score(symbols, ends, self.v.word_contexts(symbols, ends))

    def spelling(self, new: list[bytes]) -> np.ndarray:
        """Natural log probability of each word's bytes."""
        if not new:
            return np.zeros(0)
        flat, ends, contexts = self.v.spelled(new)
        return self.byte.score(flat, ends, contexts)


def fit(train: DataFrame, counts: DataFrame, v: Vocabulary) -> Model:
    """A model from encoded training texts and all token counts; every different word teaches spelling once."""
    spark = train.sparkSession
    _learn_code(train, v)
    shared = spark.sparkContext.broadcast(v)
    word_sizes = [v.slots, v.slots]

    def learn_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, tally = shared.value, Tally(word_sizes)
        for b in batches:
            for _, _, symbols, ends in _symbols(b.column("symbols"), v.kind):
                contexts = v.word_contexts(symbols, ends)
                for lo in range(0, len(symbols), 4096):
                    at = slice(lo, lo + 4096)
                    tally.add(v.word, symbols[at], [c[at] for c in contexts])
        yield from tally.strips()

    def learn_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, tally = shared.value, Tally(list(BYTE_SLOTS))
        for b in batches:
            if b.num_rows:
                flat, _, contexts = v.spelled(b.column("w").to_pylist())
                for lo in range(0, len(flat), 16_384):
                    at = slice(lo, lo + 16_384)
                    tally.add(v.byte, flat[at], [c[at] for c in contexts])
        yield from tally.strips()

    by_word = _summed(train.select("symbols").mapInArrow(learn_words, STRIPS), word_sizes)
    by_byte = _summed(counts.select("w").where(F.col("w") != F.lit(END)).mapInArrow(learn_bytes, STRIPS), list(BYTE_SLOTS))
    shared.destroy()
    return Model(v, by_word, by_byte)


def fit_gates(train: DataFrame, counts: DataFrame, model: Model, shared: Broadcast | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The weights that mixing starts from, of words and of bytes: a logistic regression for each gate over all training
    texts, and all their different words, in one pass. Each is judged in one of GATE_STEPS steps, chosen by hash, of which the
    first are small; a step goes to the weights that are best by the quadratic terms of all texts judged so far, so
    every text counts once and alike. What a decision added to the counts is left out when it is judged. `shared` holds the model, if it was sent already."""
    shared = shared or train.sparkSession.sparkContext.broadcast(model)
    texts = train.select("symbols", F.pmod(F.xxhash64("doc_id"), F.lit(4 ** (GATE_STEPS - 1))).alias("part"))
    spelled = counts.where(F.col("w") != F.lit(END)).select("w", F.pmod(F.xxhash64("w"), F.lit(4 ** (GATE_STEPS - 1))).alias("part"))

    def of_texts(m: Model, b: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, _, symbols, ends in _symbols(b.column("symbols"), m.v.kind, 50_000):
            yield m.word.slopes(symbols, m.v.word_contexts(symbols, ends))

    def of_words(m: Model, b: pa.RecordBatch) -> Iterator[np.ndarray]:
        if b.num_rows:
            flat, _, contexts = m.v.spelled(b.column("w").to_pylist())
            yield m.byte.slopes(flat, contexts)

    out = []
    for name, rows, slopes in (("word", texts, of_texts), ("byte", spelled, of_words)):
        mixer: Mixer = getattr(model, name)
        size = mixer.gates * len(mixer.start) * (len(mixer.start) + 1)
        linear, hessian = 0.0, 0.0
        for step in range(GATE_STEPS):
            own = rows.where((F.col("part") < 4**step) & (F.col("part") >= 4**step // 4)).drop("part")

            def run(batches: Iterator[pa.RecordBatch], start: np.ndarray = mixer.start, name: str = name, slopes=slopes, size: int = size) -> Iterator[pa.RecordBatch]:
                m, total = shared.value, np.zeros(size)
                getattr(m, name).start = start
                for b in batches:
                    total += sum(slopes(m, b), np.zeros(size))
                # In whole 1024ths, so that the order in which tasks' sums arrive doesn't matter.
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(np.rint(total * 1024).astype(np.int64))], ["i", "x"])

            total = np.zeros(size)
            for r in own.mapInArrow(run, "i int, x long").groupBy("i").agg(F.sum("x").alias("x")).collect():
                total[r["i"]] = r["x"] / 1024
            more = mixer.quadratic(total)
            linear, hessian = linear + more[0], hessian + more[1]
            mixer.start = mixer.solved(linear, hessian)
        out.append(mixer.start)
    return out[0], out[1]


def score_documents(docs: DataFrame, coded: int = 65_535, least: int = 3) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of all documents (doc_id, text).

    Learnt from those that are not held out (crc32 of doc_id mod 10). A null text is an empty one: its end is its only
    token. Long texts are mixed in segments, so memory doesn't grow with them. Repeated rows give repeated results,
    an empty table none; other columns are ignored. bits_per_byte is null for texts without bytes.

    Counts of the coded words travel by broadcast; other words, each document's once, meet their counts in a join.
    """
    spark = docs.sparkSession
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counts = materialize(token_counts(src.where(~held_out(10))), "lm-counts")
    n, distinct, once = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.coalesce(F.sum((F.col("c") == 1).cast("long")), F.lit(0))).first()
    floor = n + 0.1 * (distinct + 1)
    v = vocabulary(counts, coded, least)
    encoded = encode(src, v)
    train = encoded.where(~held_out(10)).select("doc_id", "symbols")
    model = fit(train, counts, v)
    shared = spark.sparkContext.broadcast(model)
    starts = fit_gates(train, counts, model, shared)
    model = None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        m.word.start = starts[0]
        b10 = np.r_[np.log10((np.array(m.v.counts, float) + 0.1) / floor), 0.0]
        for batch in batches:
            for a, b, symbols, ends in _symbols(batch.column("symbols"), m.v.kind):
                begin = np.r_[0, ends[:-1]]
                known = np.add.reduceat((symbols < m.v.escape).astype(np.int64), begin)
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), part.column("doc_id"), part.column("n_bytes"), pa.array(ends - begin), pa.array(known), pa.array(np.add.reduceat(b10[symbols], begin)), pa.array(m.score(symbols, ends) / np.log(10))],
                    ["row", "doc_id", "n_bytes", "n_tokens", "coded", "base", "score"],
                )

    def spell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        m.byte.start = starts[1]
        for pdf in batches:
            code, seen = pd.factorize(pdf["w"])
            yield pd.DataFrame({"row": pdf["row"], "k": pdf["k"], "x": pdf["k"] * (m.spelling(list(seen)) / np.log(10))[code]})

    scored = encoded.select("row", "doc_id", "n_bytes", "symbols").mapInArrow(run, "row long, doc_id long, n_bytes long, n_tokens long, coded long, base double, score double")
    escaped = encoded.select("row", "doc_id", F.explode(F.arrays_zip("w", "k")).alias("x")).select("row", "doc_id", "x.w", "x.k")
    # An escaped word is one of those counted in training, by its count, or a new one, by its spelling; how often
    # it is new, the words seen once tell (Good and Turing).
    tail = float(max(1, v.tail))
    new = min(0.95, max(0.05, once / tail))
    found = escaped.join(counts, "w").groupBy("row").agg(
        F.sum("k").alias("rare_known"), F.sum(F.col("k") * F.log10((F.col("c") + 0.1) / floor)).alias("rare_base"), F.sum(F.col("k") * F.log10((1 - new) * F.col("c") / tail)).alias("rare_score")
    )
    # Training texts have no new words.
    unseen = escaped.where(held_out(10)).join(counts.select("w"), "w", "left_anti").select("row", "w", "k")
    unseen = unseen.mapInPandas(spell, "row long, k long, x double").groupBy("row").agg(F.sum("k").alias("new_words"), F.sum("x").alias("new_spelt"))
    out = scored.join(found, "row", "left").join(unseen, "row", "left")
    zero = lambda x: F.coalesce(F.col(x), F.lit(0))
    score = F.col("score") + zero("rare_score") + zero("new_spelt") + zero("new_words") * float(np.log10(new))
    return out.select(
        "doc_id", held_out(10).alias("held_out"), "n_tokens", (F.col("coded") + zero("rare_known")).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + zero("rare_base") + zero("new_words") * float(np.log10(0.1 / floor))).alias("base_score"), score.alias("score"), F.when(F.col("n_bytes") > 0, -score * F.lit(float(np.log2(10))) / F.col("n_bytes")).alias("bits_per_byte"),
    )
