from turnloom.llm import htmlmain

PAGE = "<html><head><title>No</title><style>p{}</style></head><body><nav><ul><li><a href='/x'>menu one</a></li><li><a href='/y'>two</a></li></ul></nav><div class=\"ad\">Buy this now and more of it</div><article><h1>Head &amp; line</h1><p>First  <b>block</b>\n of &eacute;t&eacute; words here.<p>Second block, with a <a href=/z>link</a> inside it.</p><script>var t='</p>';</script><div class='advert box'>inner advert</div><p>Last one.</p></article><div id=comments><p>I said this</p></div><footer>&copy; me and others</footer></body></html>"
WANT = "Head & line\nFirst block of été words here.\nSecond block, with a link inside it.\nLast one."
SCHEMA = "page_id long, url string, html string, text string, n_chars int"


def test_pages(spark):
    more = [PAGE.replace("Last one.", f"Last one number {i} of many.") for i in range(30)]
    rows = [(0, "u", PAGE), (1, None, None), (2, "u", ""), (3, "u", "plain text only"), (4, "u", PAGE[: PAGE.index("</article>")]), (5, "u", "<p>cut off in a ta<b"), (None, "u", "<!-- "), (0, "u", PAGE)]
    rows += [(100 + i, "u", p) for i, p in enumerate(more)]
    pages = spark.createDataFrame([(*r, None, None) for r in rows], SCHEMA)
    out = htmlmain.main_text(pages).collect()
    assert len(out) == len(rows)
    by = {r["page_id"]: r for r in out}
    assert by[0]["text"] == WANT and by[0]["n_chars"] == len(WANT)
    assert by[1]["text"] == by[2]["text"] == by[None]["text"] == ""
    assert by[3]["text"] == "plain text only"
    assert by[4]["text"] == WANT
    assert by[5]["text"].startswith("cut off in a ta")
    assert by[107]["text"] == WANT.replace("Last one.", "Last one number 7 of many.")
    assert htmlmain.main_text(spark.createDataFrame([], SCHEMA)).count() == 0


def test_region():
    assert htmlmain.region([-1, 2, -1, 3, -9, 3]) == (1, 4)
    assert htmlmain.region([-1, -2]) == (0, 0)
    assert htmlmain.region([]) == (0, 0)


def brute(scores):
    return max([0.0] + [sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)])


def test_region_has_the_largest_sum():
    import random

    r = random.Random(3)
    for _ in range(200):
        s = [r.randint(-5, 5) for _ in range(r.randint(0, 12))]
        a, b = htmlmain.region(s)
        assert sum(s[a:b]) == brute(s)


def fitted():
    return htmlmain.fitted(htmlmain.evidence([PAGE.replace("Last one.", f"Last one number {i} of many.") for i in range(30)]))


BODY = "".join(f"<p>Paragraph {i} has some words of the article in it.</p>" for i in range(5))
TEXT = "\n".join(f"Paragraph {i} has some words of the article in it." for i in range(5))


def site(wrap, inner=BODY):
    before, after = wrap
    return f"<html><body><nav><a href=/>menu</a><a href=/x>more of it</a></nav>{before}<article>{inner}</article>{after}<div class='comments'><p>I said this</p></div><footer>me and others</footer></body></html>"


def test_wrappers_of_articles_are_no_noise():
    """Whether a site's pages were read before or not, a form or a div of any name around the article is its wrapper."""
    plain = fitted()
    for wrap in (("<form action=/post method=post>", "<input type=hidden></form>"), ("<div class='social'>", "</div>"), ("<div id=sidebar><div class='banner'>", "</div></div>"), ("<aside>", "</aside>")):
        like = htmlmain.fitted(htmlmain.evidence([site(wrap).replace("Paragraph 1", f"Paragraph number {i}") for i in range(200)]))
        assert like.extract(site(wrap)) == plain.extract(site(wrap)) == TEXT
    # Learnt from articles, a wrapper without one is still the site's.
    like = htmlmain.fitted(htmlmain.evidence([site(("<form>", "</form>")) for _ in range(200)]))
    assert like.extract(f"<html><body><nav><a href=/>menu</a></nav><form>{BODY}</form><footer>me and others</footer></body></html>") == TEXT


def test_names_on_paragraphs_say_little():
    inner = BODY.replace("<p>Paragraph 2", '<p class="related">Paragraph 2').replace("<p>Paragraph 3", '<p class="notice">Paragraph 3')
    assert fitted().extract(site(("", ""), inner)) == TEXT
    inner = BODY.replace("<p>Paragraph 2", '<div class="advert">Buy this now</div><p>Paragraph 2')
    assert fitted().extract(site(("", ""), inner)) == TEXT


def test_quotes_in_bare_values():
    for tag in ("<p title=foo'bar>", '<p title=a"b data-x=1>', "<p title='it>is' x>", '<p title="a\'b>c">', "<p a=b=c'>", "<p it's>"):
        assert fitted().extract(site(("", ""), BODY.replace("<p>", tag))) == TEXT


def plainly(scorer, page):
    """The region by trying all of them."""
    run = htmlmain.tokens(page, scorer.names)
    scores = [scorer(t) for t in run]
    best = max(((sum(scores[i:j]), -i, -j) for i in range(len(run)) for j in range(i + 1, len(run) + 1)), default=(0, 0, 0))
    return htmlmain.blocks(run[-best[1] : -best[2]]) if best[0] > 0 else ""


def test_extraction_equals_trying_all_regions():
    import random

    r, s = random.Random(8), fitted()
    bits = ["<p>", "</p>", "<div class=ad>", "<div class='social'>", "</div>", "<article>", "</article>", "<a href=x>", "</a>", " word ", "two &amp; three", "<nav>", "</nav>", "<li>", "<br>", "<form>", "</form>", "<h1>", "</h1>"]
    for _ in range(150):
        page = "".join(r.choice(bits) for _ in range(r.randint(0, 30)))
        a, b = htmlmain.region([s(t) for t in htmlmain.tokens(page, s.names)])
        run = htmlmain.tokens(page, s.names)
        assert abs(sum(s(t) for t in run[a:b]) - brute([s(t) for t in run])) < 1e-9
        assert s.extract(page) == htmlmain.blocks(run[a:b])
        if not any(sum(map(s, run[i:j])) == 0 for i in range(len(run)) for j in range(i + 1, len(run) + 1)):
            assert s.extract(page) == plainly(s, page)


def test_names_are_evidence_and_no_veto():
    body = "".join(f"<p>Paragraph {i} has some words of the article in it.</p>" for i in range(5))
    text = "\n".join(f"Paragraph {i} has some words of the article in it." for i in range(5))
    s = fitted()
    for name in ("entry-content no-sidebar", "post has-comments", "post-social", "content sidebar"):
        assert s.extract(f'<html><body><nav><a href=/>menu</a></nav><div class="{name}">{body}</div><footer>me</footer></body></html>') == text
    board = '<p class="notice-board">A board of notices hangs in the hall of the house.</p>'
    assert s.extract(f"<html><body><article>{body}{board}</article></body></html>") == text + "\nA board of notices hangs in the hall of the house."
    assert s.extract(f'<html><body><article>{body}<div class="comments"><p>I said this</p></div></article></body></html>') == text


def test_names_are_learnt():
    pages = [f'<html><body><div class="zone9"><p>wares to buy {i} now and here</p></div><article><p>text number {i} of the article</p></article></body></html>' for i in range(40)]
    c = htmlmain.evidence(pages)
    assert c["name:zone9", False] > 0 and c["name:zone9", True] == 0


def test_ties_repeats_and_long_pages(spark):
    assert htmlmain.region([1, -1, 1]) == (0, 1) and htmlmain.region([2, 0, -3, 2]) == (0, 1)
    long = "<article>" + "<p>one two three</p>" * 60_000 + "</article>"
    rows = [(1, "u", PAGE, None, None), (1, "u", PAGE, None, None), (2, "u", long, None, None)]
    out = htmlmain.main_text(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [r["text"] for r in out if r["page_id"] == 1] == [WANT] * 2
    assert [r["n_chars"] for r in out if r["page_id"] == 2] == [60_000 * 14 - 1]
