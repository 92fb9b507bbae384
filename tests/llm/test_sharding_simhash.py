import heapq
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from turnloom.llm import sharding, simhash
from tests.llm.helpers import ODD, SCHEMA, odd_docs


def plain_lpt(jobs, n):
    heap, loads = [(0, j) for j in range(n)], [0] * n
    for s in sorted(jobs, reverse=True):
        x, j = heapq.heappop(heap)
        heapq.heappush(heap, (x + s, j))
        loads[j] += s
    return loads


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 40), st.integers(1, 60)), max_size=20, unique_by=lambda x: x[0]), st.integers(1, 7))
def test_bulk_lpt_equals_a_job_at_a_time(classes, n):
    loads = [0] * n
    for size, j, first, end in sharding.lpt(classes, n):
        loads[j] += size * (end - first)
    assert loads == plain_lpt([s for s, c in classes for _ in range(c)], n)


def test_shards(spark):
    docs = odd_docs(spark, ODD + [(100 + i, f"text {i % 37} " * (i % 50)) for i in range(500)])
    rows = sharding.shard_documents(docs, 5).collect()
    assert len(rows) == docs.count()
    by_text, slots = {}, {}
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in rows:
        t = text[r["doc_id"]]
        assert r["size"] == 8 + len((t or "").encode()) and r["text_crc32"] == zlib.crc32((t or "").encode())
        by_text.setdefault(t, set()).add(r["shard"])
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(len(s) == 1 for s in by_text.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    jobs = {}
    for d in docs.collect():
        jobs[d["text"]] = jobs.get(d["text"], 0) + 8 + len((d["text"] or "").encode())
    got = [sum(r["size"] for r in rows if r["shard"] == j) for j in range(5)]
    assert got == plain_lpt(jobs.values(), 5)


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert sharding.shard_documents(empty).count() == 0
    assert simhash.near_duplicates(empty).count() == 0


def brute(fps, radius):
    u = sorted(set(fps))
    root = {x: x for x in u}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    a = np.array(u, np.uint64)
    for i, x in enumerate(u):
        for j in np.nonzero(np.bitwise_count(a[:i] ^ np.uint64(x)) <= radius)[0]:
            p, q = find(x), find(u[j])
            root[max(p, q)] = min(p, q)
    return {x: find(x) for x in u}


def check(docs, width, radius):
    rows = simhash.near_duplicates(docs, width, radius).collect()
    src = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want_fp = [(d, simhash.fingerprint(t, width)) for d, t in src]
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["fp"] % 2**64) for r in rows) == sorted((d if d is not None else -1, f) for d, f in want_fp)
    roots = brute([f for _, f in want_fp], radius)
    least = {}
    for d, f in want_fp:
        if d is not None:
            least[roots[f]] = min(d, least.get(roots[f], d))
    for r in rows:
        assert r["component_id"] == least.get(roots[r["fp"] % 2**64])
    return rows


def test_components_against_brute_force(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(400)]
    docs = []
    for g in range(40):
        base = [words[i] for i in rng.integers(0, 400, 300)]
        for _ in range(6):
            w = list(base)
            for i in rng.integers(0, 300, rng.integers(0, 4)):
                w[i] = words[rng.integers(0, 400)]
            docs.append((1000 + len(docs), " ".join(w)))
    rows = check(odd_docs(spark, ODD + docs), 3, 2)
    assert len({r["component_id"] for r in rows}) < len(rows)
    check(odd_docs(spark, docs), 5, 3)


def test_large_blocks_lose_no_link(spark, monkeypatch):
    """A ball of fingerprints larger than PAIRS_MOST, linked through shared neighbours."""
    rng = np.random.default_rng(1)
    fps = set()
    while len(fps) < 300:
        fps.add(int(sum(1 << int(b) for b in rng.choice(20, rng.integers(0, 5), replace=False))))
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    got = {r["node"]: r["root"] for r in simhash.components(simhash.links(df, 2)).collect()}
    want = {k: v for k, v in brute(fps, 2).items()}
    assert all(got.get(k, k) == v for k, v in want.items())


def test_fingerprint_by_hand():
    import xxhash

    text = "A b\tC d É"
    sh = ["a b c", "b c d", "c d É"]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert simhash.fingerprint(text, 3) == want


def test_edited_copies_are_found(spark):
    """Components of all pairs whose sets of five-word shingles have a similarity of 0.8 or more, counted one by one."""
    rng = np.random.default_rng(9)
    docs = []
    for g in range(40):
        base = [f"w{i}" for i in rng.integers(0, 900, 200)]
        for edits in (0, 1, 2, 3, 4, 6, 9):
            w = list(base)
            for i in rng.choice(200, edits, replace=False):
                w[i] = f"new{rng.integers(0, 10**6)}"
            docs.append((len(docs), " ".join(w)))
    docs += [(1000 + d, t) for d, t in ODD if d is not None]
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    sets = [shingles((t or "").lower().split()) for _, t in docs]
    root = list(range(len(docs)))
    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) >= 0.8 * len(a | sets[j]) - 1e-9:
                root = [root[j] if r == root[i] else r for r in root]
    want = {}
    for (d, _), r in zip(docs, root, strict=True):
        want.setdefault(r, set()).add(d)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {}
    for r in simhash.similar(df).collect():
        got.setdefault(r["component_id"], set()).add(r["doc_id"])
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    assert simhash.keep_dissimilar(df).select("doc_id").distinct().count() == len(want)
    assert simhash.keep_one(df).select("doc_id").distinct().count() > len(want)  # two of 64 bits lose copies


def test_large_blocks_of_sets(spark):
    """Hundreds of texts around one long passage, so that blocks exceed PAIRS_MOST: pairs of edited copies among them, all
    too far from the others to be linked. And a group of many near copies of one text."""
    rng = np.random.default_rng(10)
    word = lambda: f"n{rng.integers(0, 10**7)}"
    shared = [word() for _ in range(120)]
    docs = []
    for _ in range(150):
        own = [word() for _ in range(60)]
        for _ in range(2):
            w = list(own)
            for i in rng.choice(60, rng.integers(0, 4), replace=False):
                w[i] = word()
            docs.append((len(docs), " ".join(shared + w)))
    for _ in range(200):
        w = list(shared) * 2
        for i in rng.choice(240, rng.integers(1, 6), replace=False):
            w[i] = word()
        docs.append((len(docs), " ".join(w)))
    sets = [set(zip(*[t.split()[i:] for i in range(5)], strict=False)) for _, t in docs]
    root, links = list(range(len(docs))), 0
    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) >= 0.8 * len(a | sets[j]) - 1e-9:
                links += 1
                root = [root[j] if r == root[i] else r for r in root]
    want = {}
    for (d, _), r in zip(docs, root, strict=True):
        want.setdefault(r, set()).add(d)
    nodes = simhash.signatures(spark.createDataFrame(docs, "doc_id long, text string"), 5).selectExpr("node", "explode(bands) key")
    assert nodes.groupBy("key").count().where(f"count > {simhash.PAIRS_MOST}").count()
    got = {}
    for r in simhash.similar(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        got.setdefault(r["component_id"], set()).add(r["doc_id"])
    assert links and len(want) > 100
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def near_copies(n=300, words=150, seed=11):
    """Copies of one text, each with up to 14 other words, so that many pairs are too far apart."""
    rng = np.random.default_rng(seed)
    base = [f"w{i}" for i in rng.integers(0, 10**7, words)]
    docs = []
    for d in range(n):
        w = list(base)
        for i in rng.choice(words, rng.integers(0, 14), replace=False):
            w[i] = f"n{rng.integers(0, 10**7)}"
        docs.append((d, " ".join(w)))
    return docs


def similar_by_hand(docs):
    sets = [set(zip(*[t.split()[i:] for i in range(5)], strict=False)) for _, t in docs]
    root = list(range(len(docs)))
    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) >= 0.8 * len(a | sets[j]) - 1e-9:
                root = [root[j] if r == root[i] else r for r in root]
    return root


def grouped(pairs):
    out = {}
    for d, r in pairs:
        out.setdefault(r, set()).add(d)
    return sorted(map(sorted, out.values()))


def test_near_copies_make_few_pairs(spark, monkeypatch):
    """Sets are fetched for pairs that can be similar: before, a group's members met others in 120 blocks of two bands."""
    docs, seen, write = near_copies(), {}, simhash.materialize

    def counted(df, label):
        out = write(df, label)
        if label.startswith(("shingle-pairs", "shingle-more")):
            seen[label] = out.count()
        return out

    monkeypatch.setattr(simhash, "materialize", counted)
    got = simhash.similar(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    assert grouped((r["doc_id"], r["component_id"]) for r in got) == grouped(zip(range(len(docs)), similar_by_hand(docs), strict=True))
    assert sum(seen.values()) < 40 * len(docs), seen


def test_blocks_beyond_the_comparison_bound(spark, monkeypatch):
    """Blocks too large for sketches are split by a second band and lose nothing here."""
    monkeypatch.setattr(simhash, "COMPARED", 0)
    docs = near_copies(120, seed=12)
    got = simhash.similar(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert grouped((r["doc_id"], r["component_id"]) for r in got) == grouped(zip(range(len(docs)), similar_by_hand(docs), strict=True))


def test_simhash_links_stand_without_bands(spark, monkeypatch):
    """Near-dedup goes through fingerprints: their links, counted exactly, hold where no band brings anything."""
    none = "select cast(null as long) a, cast(null as long) b, cast(null as long) sa, cast(null as long) sb where false"
    monkeypatch.setattr(simhash, "meetings", lambda members, *_: (spark.sql(none), members.where("false").select("node", "size", "m", "key")))
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in rng.integers(0, 10**6, 4000)]
    docs = [(0, " ".join(base)), (1, " ".join([*base[:-1], "end"])), (2, " ".join(f"v{i}" for i in range(4000)))]
    docs += [(3, "a b c d e f g a b c d e f g"), (4, "a b c d e f g a b c d e f g a b c d e f g")]
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[1] == 0 and got[2] == 2 and got[3] == got[4]


def test_sketches_differ_no_more_than_sets():
    rng = np.random.default_rng(4)
    for n in (0, 1, 50, 3000):
        x, more = (rng.integers(0, 1 << 63, k, dtype=np.uint64) for k in (n, rng.integers(0, 200)))
        x, y = np.unique(x), np.unique(np.r_[x[n // 10 :], more])
        bits = np.unpackbits((simhash.sketch(x) ^ simhash.sketch(y)).view(np.uint8)).sum()
        assert bits <= len(np.setxor1d(x, y))
