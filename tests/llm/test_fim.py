import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import ODD, odd_docs
from turnloom.llm import fim


def plainly(text, doc_id):
    """The same by slices, without a rope."""
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(text)
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:lo], text[lo:hi], text[hi:]
    if h4 % 100 < 20:
        return n, "spm", lo, hi - lo, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", lo, hi - lo, f"<P>{p}<S>{s}<M>{m}"


def test_odd_texts(spark):
    rows = [*ODD, (20, "𝒳é漢" * 3000), (21, "a <P> b"), (22, "<" * 50), (23, "x<S"), (24, "w " * 400_000), *((i, f"text <{i} of some > length" * (i % 90)) for i in range(100, 400))]
    out = fim.restore(fim.transform(odd_docs(spark, rows))).collect()
    key = lambda r: (str(r[0]), str(r[1]))
    assert sorted(((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in out), key=str) == sorted(((d, *plainly(t, d)) for d, t in rows), key=str)
    assert sorted(((r["doc_id"], r["restored"]) for r in out), key=key) == sorted(((d, t or "") for d, t in rows), key=key)
    assert {r["form"] for r in out} == {"plain", "psm", "spm"}
    assert fim.restore(fim.transform(odd_docs(spark, []))).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text("<>PSMab\n𝒳", max_size=60), st.integers(0, 10**6))
def test_round_trip(text, doc_id):
    n, form, _, _, out = got = fim.arranged(text, doc_id)
    assert got == plainly(text, doc_id)
    assert fim.restored(out, form) == text


def test_splits_of_ropes_keep_counts():
    random.seed(4)
    for unit in (None, re.compile(r"\w+"), re.compile(r"[^\n]*\n?(?!$)")):
        text = "".join(random.choice(["one ", "twelve\n", "漢字 ", "  "]) for _ in range(4000))
        tree = fim.rope(text, unit)
        starts = list(range(len(text))) if unit is None else [m.start() for m in unit.finditer(text)]
        assert (tree.units, tree.chars) == (len(starts), len(text)) and str(tree) == text
        for rank in [0, 1, len(starts) - 1, len(starts), len(starts) + 9, *random.sample(range(len(starts)), 60)]:
            a, b = fim.split(tree, rank)
            at = 0 if rank <= 0 else starts[rank] if rank < len(starts) else len(text)
            assert (str(a), str(b)) == (text[:at], text[at:])
            assert (a.units + b.units, a.chars + b.chars) == (tree.units, tree.chars) and a.units == min(max(rank, 0), tree.units)
            c, d = fim.split(fim.concat(b, a), len(b.units * "x"))
            assert str(fim.concat(d, c)) == text


def test_a_split_makes_few_nodes():
    """Both halves share all but the way to the cut with the whole."""
    tree = fim.rope("x" * 1_000_000)

    def nodes(r):
        seen, stack = set(), [r]
        while stack:
            n = stack.pop()
            seen.add(id(n))
            stack += [n.left, n.right] if n.left else []
        return seen

    a, b = fim.split(tree, 345_678)
    assert len((nodes(a) | nodes(b)) - nodes(tree)) <= 4 * 11


def test_word_units(spark):
    docs = odd_docs(spark, [(i, "alpha beta  gamma\ndelta " * 50) for i in range(60)])
    for r in fim.restore(fim.transform(docs, unit=r"\S+", rate=100)).collect():
        assert r["n"] == 200 and r["restored"] == "alpha beta  gamma\ndelta " * 50
        assert r["form"] != "plain" and len(r["output"]) == len(r["restored"]) + 9
        head = r["restored"][: r["prefix_chars"]]
        assert not head or head[-1].isspace()
