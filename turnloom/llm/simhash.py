"""SimHash near-duplicates: fingerprints, pigeonhole blocks, links within a Hamming radius, components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from itertools import count as count_from

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

SEED = 42
#: Blocks with more fingerprints than this are linked through shared neighbours instead of pairs.
PAIRS_MOST = 32
#: Members of a larger block of shingle sets that all others of the block meet in a round.
LEADERS = 2
#: Bands of a MinHash signature and hashes a band: 0.9998 of pairs of sets with a similarity of 0.8 agree on a band.
BANDS, ROWS = 16, 4
#: Longs of a set's sketch; sets of more shingles than SKETCHED fill it, so that it tells them apart no more.
SKETCH, SKETCHED = 16, 2000
#: Pairs of sketches that a block compares at most; beyond, it is split. And pairs where sketches tell nothing.
COMPARED, UNTOLD = 1 << 26, 1 << 12


def fingerprint(text: str | None, width: int) -> int:
    """Bit b is 1 if set in over half of the XXH64 of the text's word shingles; 0 for a text without words."""
    return majority(shingle_hashes(text, width))


def majority(hashes: np.ndarray) -> int:
    """Bit b is 1 if set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        ones += np.unpackbits(hashes[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * ones > len(hashes)).astype(np.uint8), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, fp): fp as a signed long."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fps = np.fromiter((fingerprint(t, width) for t in pdf["text"]), np.uint64, len(pdf))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "fp": fps.view(np.int64)})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, fp long")


def block_masks(radius: int, shared: int = 2) -> list[int]:
    """Masks of `shared` of radius + shared blocks: two fingerprints within the radius agree on one of them at least."""
    n = radius + shared
    edges = [64 * i // n for i in range(n + 1)]
    blocks = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(n)]
    return [sum(blocks[i] for i in c) for c in combinations(range(n), shared)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(fps: DataFrame, radius: int) -> DataFrame:
    """Edges (a, b) between distinct fingerprints; their components are those of all pairs within the radius.

    Every fingerprint goes to each of its block keys. In a block of few fingerprints all pairs are verified by
    Hamming distance. Larger blocks (copies edited in many ways) emit no pairs: every member emits what it
    becomes with up to half the radius of the block's other bits flipped; two members that share such a neighbour
    are linked, and members within an even radius share one. So a block of n costs n times a constant.
    That needs an even radius; for an odd one every verified pair is joined in the block.
    """
    masks = block_masks(radius)
    keyed = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks])).alias("m", "key"))
    busy = keyed.groupBy("m", "key").agg(F.count("*").alias("n")).where("n > 1")
    keyed = materialize(keyed.join(busy, ["m", "key"]), "simhash-blocks")
    small = keyed if radius % 2 else keyed.where(F.col("n") <= PAIRS_MOST)
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    pairs = small.select("m", "key", F.col("fp").alias("a")).join(small.select("m", "key", F.col("fp").alias("b")), ["m", "key"]).where((F.col("a") < F.col("b")) & near).select("a", "b")
    if radius % 2:
        return pairs
    flips: list[Column] = []
    free = [[b for b in range(64) if not m >> b & 1] for m in masks]
    for bits in free:
        flips.append(F.array(*[F.lit(_signed(sum(1 << b for b in c))) for k in range(radius // 2 + 1) for c in combinations(bits, k)]))
    chosen = flips[0]
    for i in range(1, len(flips)):
        chosen = F.when(F.col("m") == i, flips[i]).otherwise(chosen)
    big = keyed.where(F.col("n") > PAIRS_MOST).select("fp", F.explode(chosen).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("v")).distinct()
    star = big.groupBy("v").agg(F.min("fp").alias("a"), F.count("*").alias("k")).where("k > 1").select("v", "a")
    return pairs.unionByName(big.join(star, "v").where("a < fp").select("a", F.col("fp").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge; root: the smallest node that it reaches.

    Large-star and small-star rounds until the edges stand still, which they do after a number of rounds that grows with
    the logarithm of the longest path squared.
    """
    cur = materialize(edges.select("a", "b").where("a <> b").distinct(), "cc-0")
    count = -1
    for i in count_from(1):
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("l")).select("a", F.least("a", "l").alias("l"))
        large = both.join(least, "a").where("b > a and b <> l").select(F.col("l").alias("a"), "b").distinct()
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("l"))
        small = down.join(low, "u").where("v <> l").select(F.col("l").alias("a"), F.col("v").alias("b")).unionByName(low.select(F.col("l").alias("a"), F.col("u").alias("b"))).distinct()
        new = materialize(small, f"cc-{i}")
        n, same = new.count(), new.join(cur, ["a", "b"], "left_semi").count()
        if n == count == same:
            break
        cur, count = new, n
    return new.select(F.col("b").alias("node"), F.col("a").alias("root"))


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) for documents (doc_id, text).

    Shingles are `width` words of the text with A-Z lowered, repeats included; a text of fewer words is one shingle.
    Null, empty and wordless texts have fingerprint 0 and are linked like any other. component_id is the smallest
    doc_id reachable through links of at most `radius` differing bits. Repeated rows give repeated results; an
    empty table none; other columns are ignored. Work is on distinct fingerprints, so copies cost one row each.
    """
    fp = materialize(fingerprints(docs, width), "simhash-fp")
    distinct = materialize(fp.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    comp = components(links(distinct.select("fp"), radius))
    rooted = distinct.join(comp, distinct["fp"] == comp["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = materialize(rooted.join(ids, "root").select("fp", "component_id"), "simhash-classes")
    return fp.join(classes, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, width: int = 5, radius: int = 2) -> DataFrame:
    """The rows of `docs` without near-duplicates: of each component the row with the smallest doc_id stays.

    A row without doc_id goes by its text, after all others. Rows that repeat a doc_id count once.
    """
    return _first_of_each(docs, near_duplicates(_by_own_id(docs), width, radius))


def _own() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(1 << 62).bitwiseOR(F.xxhash64("text").bitwiseAND(F.lit((1 << 61) - 1))))


def _by_own_id(docs: DataFrame) -> DataFrame:
    return docs.select(_own().alias("doc_id"), "text")


def _first_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    kept = materialize(found.where("doc_id = component_id").groupBy(F.col("doc_id").alias("_kept")).agg(F.count("*").alias("_n")), "simhash-kept")
    # One plan at every size: a merge join moves each text once, where a broadcast would hold only while survivors are few.
    out = docs.withColumn("_own", _own()).join(kept.select("_kept").hint("merge"), F.col("_own") == F.col("_kept"), "left_semi")
    if kept.where("_n > 1").limit(1).count():
        out = out.dropDuplicates(["_own"])
    return out.drop("_own")


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """The XXH64 of the text's word shingles; a text of fewer words is one shingle, one without words has none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    start = np.r_[0, end[:-1] + 1]
    n = max(1, len(words) - width + 1)
    h = xxhash.xxh64_intdigest
    return np.array([h(line[s:e], SEED) for s, e in zip(start[:n].tolist(), end[min(width, len(words)) - 1 :].tolist(), strict=True)], np.uint64)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The different ones of the text's shingle hashes, in order."""
    return np.unique(shingle_hashes(text, width))


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Bit b is 1 if an odd number of the set's shingles fall on it. So sketches differ in no more bits than sets in shingles."""
    odd = np.bincount((shingles >> np.uint64(32)).astype(np.int64) % (64 * SKETCH), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def set_id(shingles: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(shingles.tobytes(), SEED)


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, fp, node, size, bands, sketch): the text's fingerprint; the shingle set's hash, size, MinHash bands and sketch."""
    rng = np.random.default_rng(SEED)
    a = rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)

    def bands(x: np.ndarray) -> list[int]:
        low = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
        for at in range(0, len(x), 4096):
            part = x[at : at + 4096]
            low = np.minimum(low, (part[None, :] * a[:, None] + b[:, None]).min(axis=1))
        return [xxhash.xxh64_intdigest(r.tobytes()) for r in low.reshape(BANDS, ROWS)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fps, node, size, keys, marks = [], [], [], [], []
            for t in pdf["text"]:
                every = shingle_hashes(t, width)
                x = np.unique(every)
                fps.append(_signed(majority(every)))
                marks.append(sketch(x))
                node.append(_signed(set_id(x)))
                size.append(len(x))
                keys.append(np.array(bands(x), np.uint64).view(np.int64))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "fp": np.array(fps, np.int64), "node": np.array(node, np.int64), "size": np.array(size, np.int64), "bands": keys, "sketch": marks})

    return docs.mapInPandas(run, "doc_id long, fp long, node long, size long, bands array<long>, sketch array<long>")


def fingerprinted(sig: DataFrame, radius: int) -> DataFrame:
    """Pairs (a, b, sa, sb) of different sets that SimHash links: each fingerprint's first set with its others, and with the
    first sets of the fingerprints linked to it."""
    fps = materialize(sig.groupBy("fp").agg(F.min(F.struct("node", "size")).alias("x")), "shingle-fp")
    ends = links(fps.select("fp"), radius).join(fps.select(F.col("fp").alias("a"), "x"), "a").join(fps.select(F.col("fp").alias("b"), F.col("x").alias("y")), "b").select("x", "y")
    same = sig.select("fp", "node", "size").distinct().join(fps, "fp").select("x", F.struct("node", "size").alias("y"))
    both = ends.unionByName(same).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).where("x.node < y.node")
    return both.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.col("x.size").alias("sa"), F.col("y.size").alias("sb")).distinct()


def meetings(members: DataFrame, by: list[str], least: float, salt: int) -> tuple[DataFrame, DataFrame]:
    """(pairs, large): pairs (a, b, sa, sb) of members (node, size, root, *by) that share a block `by`, have different
    roots and sizes that allow the similarity; and the members of blocks of more than PAIRS_MOST.

    In such a large block every member meets up to LEADERS members, by hash and salt, that are not of the block's most
    frequent root: pairs stay linear, and a block with no more than a few members outside that root is settled.
    """
    sizes = members.groupBy(*by, "root").agg(F.count("*").alias("k")).groupBy(*by).agg(F.sum("k").alias("n"), F.max(F.struct("k", "root")).alias("main"), F.count("*").alias("roots")).where("roots > 1")
    members = materialize(members.join(sizes.select(*by, "n", F.col("main.root").alias("main")), by), f"shingle-blocks-{salt}")
    small, large = members.where(F.col("n") <= PAIRS_MOST), members.where(F.col("n") > PAIRS_MOST)
    left, right = (small.select(*by, F.col("node").alias(x), F.col("size").alias(f"s{x}"), F.col("root").alias(f"r{x}")) for x in "ab")
    pairs = left.join(right, by).where("a < b and ra <> rb").select("a", "b", "sa", "sb")
    chosen = [F.min(F.struct(F.xxhash64(F.lit(salt * LEADERS + i), "node", *by).alias("h"), "node", "size", "root")) for i in range(LEADERS)]
    leads = large.where("root <> main").groupBy(*by).agg(F.array_distinct(F.array(*[F.struct(c["node"].alias("node"), c["size"].alias("size"), c["root"].alias("root")) for c in chosen])).alias("lead"))
    led = large.join(leads, by).select("node", "size", "root", F.explode("lead").alias("lead")).where("root <> lead.root").select(F.struct("node", "size").alias("x"), F.struct("lead.node", "lead.size").alias("y"))
    led = led.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.col("x.size").alias("sa"), F.col("y.size").alias("sb"))
    return pairs.unionByName(led).where(F.least("sa", "sb") >= F.lit(least) * F.greatest("sa", "sb") - 1e-9).distinct(), large.select("node", "size", *by)


def unlike(large: DataFrame, nodes: DataFrame, roots: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """(pairs, rest) of members (node, size, m, key) of large blocks: all pairs (a, b, sa, sb) of a block with different roots,
    but for those whose sketches differ in more bits than sets of that similarity can in shingles; and the members of the
    blocks where that would be more than COMPARED pairs of sketches, or more than UNTOLD of sets too large for them."""
    rooted = large.join(roots.select("node", "root"), "node")
    by = rooted.groupBy("m", "key", "root").agg(F.count("*").alias("k"), F.max("size").alias("most")).groupBy("m", "key")
    blocks = by.agg(F.sum("k").alias("n"), F.max(F.struct("k", "root")).alias("main"), F.count("*").alias("roots"), F.max("most").alias("most")).where("roots > 1")
    work = (F.col("n") - F.col("main.k")) * F.col("n")
    blocks = blocks.select("m", "key", F.col("main.root").alias("main"), ((work <= COMPARED) & ((F.col("most") <= SKETCHED) | (work <= UNTOLD))).alias("told"))
    members = materialize(rooted.join(blocks, ["m", "key"]).join(nodes.select("node", "sketch"), "node"), "shingle-unlike")
    told = members.where("told").select("m", "key", "main", "node", "size", "root", *[F.col("sketch")[i].alias(f"s{i}") for i in range(SKETCH)])
    left, right = (told.select("m", "key", "main", *[F.col(c).alias(f"{x}_{c}") for c in told.columns[3:]]) for x in "ab")
    bits = sum((F.bit_count(F.col(f"a_s{i}").bitwiseXOR(F.col(f"b_s{i}"))) for i in range(SKETCH)), F.lit(0))
    near = (bits <= F.lit((1 - least) / (1 + least)) * (F.col("a_size") + F.col("b_size")) + 1e-9) & (F.least("a_size", "b_size") >= F.lit(least) * F.greatest("a_size", "b_size") - 1e-9)
    # Those outside a block's most frequent root meet all others; two of them once.
    met = left.where("a_root <> main").join(right.drop("main"), ["m", "key"]).where((F.col("a_root") != F.col("b_root")) & ((F.col("b_root") == F.col("main")) | (F.col("a_node") < F.col("b_node"))) & near)
    x, y = (f(F.struct(F.col("a_node").alias("node"), F.col("a_size").alias("size")), F.struct(F.col("b_node").alias("node"), F.col("b_size").alias("size"))) for f in (F.least, F.greatest))
    pairs = met.select(x["node"].alias("a"), y["node"].alias("b"), x["size"].alias("sa"), y["size"].alias("sb")).distinct()
    return pairs, members.where("not told").select("node", "size", "m", "key")


def split_blocks(large: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Members (node, size, root, lo, hi) of large blocks (m, key) whose members still have different roots, and of the
    blocks that a second band makes of them. Pairs with a similarity of 0.8 agree on two bands in 0.997 of cases."""
    rooted = large.select("node", "m", "key").join(roots.select("node", "root"), "node")
    mixed = rooted.groupBy("m", "key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("m", "key")
    both = rooted.join(mixed, ["m", "key"]).join(nodes.select("node", "size", "bands"), "node")
    both = both.select("node", "size", "root", F.struct("m", "key").alias("x"), F.posexplode("bands").alias("m", "key")).withColumn("y", F.struct("m", "key"))
    return both.select("node", "size", "root", F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi")).distinct()


def similar(docs: DataFrame, width: int = 5, least: float = 0.8, radius: int = 2) -> DataFrame:
    """(doc_id, component_id) for documents (doc_id, text): linked are those whose sets of word shingles have a Jaccard
    similarity of `least` or more, counted exactly for all candidates. component_id is the smallest doc_id reachable.

    Candidates are the links of SimHash fingerprints, and what shares a MinHash band: sets of that similarity differ in more bits
    than pigeonhole blocks can hold. In blocks too large for all pairs each set meets leaders; in those that then still hold
    several components all sets that are outside the largest one meet all others by sketches. Where even that is too much, blocks
    are split by a second band, and what is unlinked meets leaders there, until a round links nothing.
    Texts without words have one empty set and are linked; equal texts are one node; an empty table gives no rows.
    """
    sig = materialize(signatures(docs, width), "shingle-signatures")
    nodes = materialize(sig.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("size").alias("size"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "shingle-nodes")
    keyed = nodes.select("node", "size", F.col("node").alias("root"), F.posexplode("bands").alias("m", "key"))
    pairs, large = meetings(keyed, ["m", "key"], least, 0)
    pairs = materialize(pairs.unionByName(fingerprinted(sig, radius)).distinct(), "shingle-pairs")
    large = materialize(large, "shingle-large")
    asked = materialize(pairs.select(F.explode(F.array("a", "b")).alias("node")).unionByName(large.select("node")).distinct(), "shingle-asked")
    ids = nodes.join(asked, "node", "left_semi").select(F.col("least").alias("doc_id")).distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 500):
                sets = [shingle_set(t, width) for t in pdf["text"][at : at + 500]]
                yield pd.DataFrame({"node": np.array([_signed(set_id(x)) for x in sets], np.int64), "x": [x.view(np.int64) for x in sets]})

    sets = docs.join(ids.hint("merge"), "doc_id", "left_semi").select("text").mapInPandas(run, "node long, x array<long>")
    sets = materialize(sets.join(asked.hint("merge"), "node", "left_semi").dropDuplicates(["node"]), "shingle-sets")

    def verified(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sets.select(F.col("node").alias("a"), F.col("x")).hint("merge"), "a").join(sets.select(F.col("node").alias("b"), F.col("x").alias("y")).hint("merge"), "b")
        common = F.size(F.array_intersect("x", "y"))
        return both.where(common >= F.lit(least) * (F.col("sa") + F.col("sb") - common) - 1e-9).select("a", "b")

    def reached(roots: DataFrame, edges: DataFrame, label: str) -> DataFrame:
        comp = components(edges).select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        return materialize(roots.join(comp, F.col("root") == F.col("_n"), "left").select("node", "least", F.coalesce("_r", "root").alias("root")), label)

    roots = reached(nodes.select("node", "least", F.col("node").alias("root")), verified(pairs), "shingle-roots")
    of = [roots.select(F.col("node").alias(x), F.col("root").alias(f"r{x}")) for x in "ab"]
    more, large = unlike(large, nodes, roots, least)
    more = materialize(more, "shingle-more-0")
    edges = materialize(verified(more).join(of[0], "a").join(of[1], "b").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "shingle-links-0")
    if edges.limit(1).count():
        roots = reached(roots, edges, "shingle-roots-0")
    for salt in count_from(1) if large.limit(1).count() else ():
        more = materialize(meetings(split_blocks(large, nodes, roots), ["lo", "hi"], least, salt)[0], f"shingle-more-{salt}")
        of = [roots.select(F.col("node").alias(x), F.col("root").alias(f"r{x}")) for x in "ab"]
        edges = materialize(verified(more).join(of[0], "a").join(of[1], "b").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), f"shingle-links-{salt}")
        if not edges.limit(1).count():
            break
        roots = reached(roots, edges, f"shingle-roots-{salt}")
    firsts = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = materialize(roots.join(firsts, "root").select("node", "component_id"), "shingle-classes")
    return sig.join(classes, "node").select("doc_id", "component_id")


def keep_dissimilar(docs: DataFrame, width: int = 5, least: float = 0.8) -> DataFrame:
    """As keep_one, for texts whose shingle sets have a similarity of `least` or more."""
    return _first_of_each(docs, similar(_by_own_id(docs), width, least))
