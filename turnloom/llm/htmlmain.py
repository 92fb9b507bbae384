"""HTML extraction: the contiguous region with the largest sum of word and tag scores."""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Comments, declarations, raw-text elements with their content, tags, text. What is cut off at the end counts as its kind.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(script|style|noscript|template|textarea|title|iframe|svg|math|object)\b[^>]*>.*?(?:</\1\s*>|\Z)|"
    # A quote opens a value only after an equals sign.
    r"<(/?)([a-zA-Z][\w:-]*)((?:[^>=]|=\s*+(?:\"[^\"]*\"|'[^']*'|[^\s>]*+))*+)(?:>|\Z)|<[^<]?|[^<]+",
    re.S | re.I,
)
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that mostly hold no article text; `tag:` and their kind is a name of theirs.
_SKIP = frozenset("head nav header footer aside form button select menu dialog".split())
#: Names of classes, ids and roles: what they say before any page is read. They are evidence, which what is learnt can overrule.
_NOISE = frozenset(
    "ad ads advert adverts advertisement banner sidebar menu nav navbar navigation breadcrumb breadcrumbs comment comments disqus cookie cookies consent notice popup promo sponsor sponsored related share social footer header masthead newsletter subscribe complementary contentinfo".split()
)
_TEXT = frozenset("article content entry post story main body text".split())
_NOT = frozenset("no not non has have with without".split())
#: Names that say little on a paragraph or a heading, which are text by their kind; there they are names of their own, with `p:`.
_WEAK = frozenset("related share social notice header footer complementary contentinfo".split())
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
#: A name that is a word of noise or of text; one that has it as a part; the sum from which an element's words don't count.
WHOLE, PART, GONE = 8.0, 2.0, -6.0
#: What is learnt of a place or a name says no more than this, and weighs as much as what a name says by itself after so many words.
MOST, TRUST = 6.0, 500.0
_ATTR = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


def prior(name: str) -> float:
    """What an element's kind or a class, id or role says by itself: above 0 for text, below for what isn't."""
    if name.startswith("tag:"):
        return -WHOLE
    if name.startswith("p:"):
        return max(prior(name[2:]), -PART)
    if name in _NOISE or name in _TEXT:
        return WHOLE if name in _TEXT else -WHOLE
    parts = re.split(r"[_-]+", name)
    if parts[0] in _NOT:
        return 0.0
    return PART * (any(p in _TEXT for p in parts) - any(p in _NOISE for p in parts))


def weighed(name: str, inside: int, outside: int) -> float:
    """What a name says after so many words in and outside of articles: the odds learnt, with its prior worth TRUST words."""
    odds = float(np.clip(np.log((inside + 0.5) / (outside + 0.5)), -MOST, MOST))
    own, n = prior(name), inside + outside
    return odds + own if own == 0 else (odds * n + own * TRUST) / (n + TRUST)


class Token:
    """A tag (text None) or a run of text; `place` and the `names` of open elements are what its score depends on.

    `lean` sums up what elements and names say; a text that leans to GONE or further is not the article's.
    """

    __slots__ = ("text", "place", "breaks", "names", "lean", "n")

    def __init__(self, text, place, breaks, names, lean):
        self.text, self.place, self.breaks, self.names, self.lean = text, place, breaks, names, lean
        self.n = len(text.split()) if text else 1

    @property
    def gone(self) -> bool:
        return self.lean <= GONE


def _names(tag: str, attributes: str) -> tuple[str, ...]:
    own = dict.fromkeys(x for a in _ATTR.findall(attributes) for x in (a[0] or a[1] or a[2]).lower().split())
    return tuple(f"p:{x}" if tag in _PROSE and x in _WEAK else x for x in own)


def tokens(page: str, weights: dict[str, float] | None = None) -> list[Token]:
    """The page's tags and texts, with what the elements around them say by their kind and their names.

    Of a page with one article (or, without any, one main element) the elements that hold it are its wrappers, not noise: what they say
    against it doesn't count.
    """
    run, held = _tokens(page, weights or {}, frozenset())
    return _tokens(page, weights or {}, held)[0] if held else run


def _tokens(page: str, weights: dict[str, float], wrappers: frozenset[int]) -> tuple[list[Token], frozenset[int]]:
    """The tokens, and the places of elements that say something against the page's only article and hold it."""
    out: list[Token] = []
    # Open elements: kind, all names and the lean down to each, place in the page, whether it says something against its content.
    stack: list[tuple[str, tuple[str, ...], float, int, bool]] = []
    around: dict[str, list[frozenset[int]]] = {"article": [], "main": []}
    for m in _TOKEN.finditer(page):
        name = m[3]
        names, lean = stack[-1][1:3] if stack else ((), 0.0)
        if name is None:
            if m[1] or m[0][0] == "<" and len(m[0]) > 1 and m[0][1] in "!?":
                continue
            inner = next((e[0] for e in reversed(stack) if e[0] not in _INLINE), "")
            link = any(e[0] == "a" for e in stack)
            out.append(Token(m[0], "word:" + ("link:" if link else "") + inner, False, names, lean))
            continue
        name, end = name.lower(), bool(m[2])
        block = name not in _INLINE
        if end:
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if at is not None:
                del stack[at:]
        else:
            if block:  # a new block ends an open paragraph and what is open inside it
                at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] not in _INLINE), None)
                if at is not None and (stack[at][0] == "p" or stack[at][0] == name == "li"):
                    del stack[at:]
                    names, lean = stack[-1][1:3] if stack else ((), 0.0)
            if name in around:
                around[name].append(frozenset(e[3] for e in stack if e[4]))
            own: tuple[str, ...] = ()
            if name in _SKIP and not (name == "header" and any(e[0] in ("article", "main") for e in stack)):
                own = (f"tag:{name}",)
            if name not in ("html", "body", "article", "main"):
                own += _names(name, m[4])
            says = sum(weights.get(x, prior(x)) for x in own)
            if m.start() in wrappers:
                own, says = (), 0.0
            names, lean = names + own, lean + says
            if name not in _VOID and not m[4].endswith("/"):
                stack.append((name, names, lean, m.start(), says < 0))
        out.append(Token(None, ("/" if end else "") + name, block, names, lean))
    only = around["article"] or around["main"]
    return out, only[0] if len(only) == 1 else frozenset()


def region(scores: list[float]) -> tuple[int, int]:
    """[first, end) of the contiguous run with the largest sum, the earliest if several; (0, 0) if none is positive."""
    best, at, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, at = total, (start, i + 1)
    return at


def blocks(run: list[Token]) -> str:
    """The run's text: references decoded, white space inside a block one space, blocks joined by a line feed."""
    parts, cur = [], []
    for t in run:
        if t.breaks:
            parts.append("".join(cur))
            cur = []
        elif t.text is not None and not t.gone:
            cur.append(t.text)
        elif t.place in ("br", "img", "wbr"):
            cur.append(" ")
    parts.append("".join(cur))
    lines = (" ".join(entities.unescape(p).split()) for p in parts)
    return "\n".join(x for x in lines if x)


class Scorer:
    """Score of a word or a tag by its place, and of a word by the names around it. Words of places never seen count 1, tags -1."""

    def __init__(self, places: dict[str, float], names: dict[str, float] | None = None):
        """names: the whole weight of those that were learnt; others have their prior."""
        self.places, self.names = places, names or {}

    def __call__(self, t: Token) -> float:
        if t.text is None:
            return min(-0.01, self.places.get(t.place, -1.0))
        if t.gone or not t.n:
            return 0.0
        return t.n * (self.places.get(t.place, 1.0) + float(np.clip(t.lean, -MOST, MOST)))

    def extract(self, page: str | None) -> str:
        run = tokens(page or "", self.names)
        a, b = region([self(t) for t in run])
        return blocks(run[a:b])


def evidence(pages: list[str | None]) -> Counter:
    """How often each place occurs inside and outside the labelled region, and each name around words. A page is labelled
    by its markup: one article element, without what elements and names in it say is noise, unless that is most of it.

    All words count for the names around them: inside, outside, or as noise in the article. Those of the elements that hold the
    article count too, as they stand in the page, so that a site's wrappers are learnt as such.
    """
    c: Counter = Counter()
    for page in pages:
        run, _ = _tokens(page or "", {}, frozenset())
        a = [i for i, t in enumerate(run) if t.place == "article"]
        b = [i for i, t in enumerate(run) if t.place == "/article"]
        if len(a) != 1 or len(b) != 1 or a[0] > b[0]:
            continue
        at, around = run[a[0]].lean, len(run[a[0]].names)
        noise = {i for i in range(a[0] + 1, b[0]) if run[i].text is not None and run[i].lean - at <= GONE}
        if 2 * sum(run[i].n for i in noise) > sum(t.n for t in run[a[0] + 1 : b[0]] if t.text is not None):
            noise = set()
        for i, t in enumerate(run):
            inside = a[0] < i < b[0]
            if t.n and not (i in noise or t.text is not None and not inside and t.gone):  # names explain those
                c[t.place, inside] += t.n
            if t.text is not None:
                for x in dict.fromkeys(t.names[around:] if i in noise else t.names):
                    c["name:" + x, inside and i not in noise] += t.n
    return c


def fitted(n: dict[tuple[str, bool], int]) -> Scorer:
    """Log odds, inside against outside, of places and names counted as by `evidence`."""
    names = {k[5:] for k, _ in n if k.startswith("name:")}
    odds = {p: float(np.clip(np.log((n.get((p, True), 0) + 0.5) / (n.get((p, False), 0) + 0.5)), -MOST, MOST)) for p, _ in n if not p.startswith("name:")}
    return Scorer(odds, {x: weighed(x, n.get((f"name:{x}", True), 0), n.get((f"name:{x}", False), 0)) for x in names})


def fit(pages: DataFrame, sample: int = 2048) -> Scorer:
    """A scorer from at most `sample` pages (the smallest hashes of page_id; of repeated ids the first by their text)."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            c = evidence(pdf["html"].tolist())
            yield pd.DataFrame({"place": [k for k, _ in c], "inside": [i for _, i in c], "n": list(c.values())})

    hashed = pages.select(F.xxhash64("page_id").alias("h"), F.xxhash64("html").alias("g"), "html")
    # Ranked before any text moves: pairs of hashes alone are sorted.
    last = hashed.select("h", "g").orderBy("h", "g").limit(sample).agg(F.max(F.struct("h", "g")).alias("x")).first()["x"]
    if last is None:
        return Scorer({})
    chosen = hashed.where((F.col("h") < last["h"]) | (F.col("h") == last["h"]) & (F.col("g") <= last["g"])).select("html").limit(sample)
    rows = chosen.mapInPandas(count, "place string, inside boolean, n long").groupBy("place", "inside").agg(F.sum("n").alias("n"))
    return fitted({(r["place"], r["inside"]): r["n"] for r in rows.collect()})  # places and names of the sampled pages alone


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page (page_id, url, html).

    Null and empty pages, and pages without text, give an empty text. Markup that is cut off or not closed is taken
    as it stands, and a page of any length as a whole. Of regions with equal sums the earliest counts. Repeated rows give
    repeated results, an empty table none; other columns are ignored.
    """
    src = pages.select("page_id", "url", "html")
    shared = pages.sparkSession.sparkContext.broadcast(fit(src))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            text = [shared.value.extract(p) for p in pdf["html"]]
            yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": text, "n_chars": [len(t) for t in text]})

    kind = src.schema["page_id"].dataType.simpleString()
    return src.mapInPandas(run, f"page_id {kind}, url string, text string, n_chars long")
