import html
import random
import re

from kinetrace.llm import html_extract as he

PAGES = "page_id long, url string, html string, text string, _host int"


def test_blocks_entities_and_tolerated_markup():
    source = """<html><body><header><h1>Site</h1></header><div id=cookieNotice>We use cookies</div><div class=content><h2>Title &eacute;&#8212;x</h2>
    <p>One <a href=x>two</a>\n three<br>four<p class="a>b">Five<b>six</p><ul><li>a<li>b</ul><table><tr><td>c1<td>c2<tr><td>d</table></div>
    <aside>side</aside><section class="reader-comments"><p>nice</p></section><script>if(a<b){"</p>"}</script><form>f<input></form><footer>x &copy; y</footer>"""
    page = he.parse(source)
    assert he.article_text(page, set(), {}) == "Title é—x\nOne two three four\nFivesix\na\nb\nc1\nc2\nd"
    for odd in ("", "plain & text", "<p>a</b></i></div>b", "<!-- open", "<p", "</p>x", "<a " * 500, '<a b="' * 500, "<div>" * 5000 + "deep"):
        he.article_text(he.parse(odd), set(), {})
    assert he.article_text(he.parse("<div>" * 3000 + "deep"), set(), {}) == "deep"




def test_alignment_is_a_largest_simple_tree_match():
    def brute(a, b, own, ref, la, lb):
        if la[a] != lb[b]:
            return 0
        x, y = own[a], ref[b]
        best = {(i, 0): 0 for i in range(len(x) + 1)} | {(0, j): 0 for j in range(len(y) + 1)}
        for i in range(1, len(x) + 1):
            for j in range(1, len(y) + 1):
                best[i, j] = max(best[i - 1, j], best[i, j - 1], best[i - 1, j - 1] + brute(x[i - 1], y[j - 1], own, ref, la, lb))
        return 1 + best[len(x), len(y)]

    rng = random.Random(3)
    tree = lambda n: (["r"] + [rng.choice("ab") for _ in range(n - 1)], [-1] + [rng.randrange(k) for k in range(1, n)])
    for _ in range(60):
        (la, pa), (lb, pb) = tree(rng.randint(1, 9)), tree(rng.randint(1, 9))
        found = he.align(la, pa, lb, pb)
        assert len(found) == brute(0, 0, he._children(pa), he._children(pb), la, lb)
        assert all(la[a] == lb[b] and (a == 0 or found[pa[a]] == pb[b]) for a, b in found.items())
        assert len(set(found.values())) == len(found)


def test_constant_slots_of_a_host_are_template(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows, want = [], {}
    for k in range(30):
        host = f"h{k % 2}.example.com"
        paragraphs = [" ".join(word() for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(1, 5))]
        body = "".join(f"<p>{html.escape(p)}</p>" for p in paragraphs)
        rows.append((k, f"https://{host}/x{k}", f"<body><div class=top>Welcome to {host}</div><div class=box><h1>t{k}</h1>{body}</div><p>All rights of {host}</p></body>", "z", 1))
        want[k] = "\n".join([f"t{k}", *paragraphs])
    rows += [(100, "https://only.example.com/", "<p>Alone here</p>", None, None), (101, None, None, None, None), (102, "https://h0.example.com/e", "", None, None), (103, "nonsense", "<p>" + "x " * 100_000, None, None)]
    rows += [(200 + k, "https://copy.example.com/", "<div>the same text</div>", None, None) for k in range(20)]
    want |= {100: "Alone here", 101: "", 102: "", 103: ("x " * 100_000).strip()} | {200 + k: "the same text" for k in range(20)}
    for sent in (he.SENT_CHARS, 0):
        he.SENT_CHARS, before = sent, he.SENT_CHARS
        try:
            got = he.extract_main_text(spark.createDataFrame(rows, PAGES).repartition(4)).collect()
        finally:
            he.SENT_CHARS = before
        assert {r.page_id: r.text for r in got} == want and len(got) == len(rows)
        assert all(r.n_chars == len(r.text) for r in got)
    assert he.extract_main_text(spark.createDataFrame([], PAGES)).count() == 0


def test_articles_of_the_test_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r.text for r in he.extract_main_text(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        parts = [html.unescape(re.sub(r"</?b>", "", p.replace("<br>", " "))).split() for p in re.split(r"</?(?:p|h1)>", inner)]
        assert got[r.page_id] == "\n".join(" ".join(p) for p in parts if p)


def test_slots_decide_beside_and_within_articles(spark):
    rng = random.Random(4)
    words = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(12))
    rows, want = [], {}
    for k in range(24):
        title, first, second, body, teaser = (words() for _ in range(5))
        if k % 3:  # a card beside the real text, which is in a plain element
            source = f"<body><div>Our motto</div><div class=text><p>{body}</p><p>{second}</p></div><article><p>{teaser}</p></article></body>"
            want[k] = f"{body}\n{second}\n{teaser}"
        else:  # another layout: notices within the article
            source = f"<body><main><h1>{title}</h1><p>Like and share this page</p><p>{first}</p><p>{second}</p><p>Printed on paper</p></main><section>Our address</section></body>"
            want[k] = f"{title}\n{first}\n{second}"
        rows.append((k, f"https://one.example.com/{k}", source, None, None))
    got = {r.page_id: r.text for r in he.extract_main_text(spark.createDataFrame(rows, PAGES).repartition(3)).collect()}
    assert got == want


def test_verdicts_of_wrappers_and_ids():
    text = lambda source: he.article_text(he.parse(source), set(), {})
    assert text("<body><form><h1>Title</h1><div><p>Body</p></div></form></body>") == "Title\nBody"
    assert text("<form><div>Go</div><article><p>Body</p></article></form>") == "Body"
    for wrapper in ("class='content sidebar-right'", "id='search-results'", "class=search-page", "id=sidebar-main"):
        assert text(f"<body><div {wrapper}><article><p>Body</p></article></div><div id=sidebar-left>Other</div></body>") == "Body"
    inner = "<h2 id='cookies-and-sessions'>A</h2><section id='related-work'>B</section><h2 id='search-algorithms'>C</h2><h2 id=search>D</h2>"
    assert text(f"<article>{inner}<div class=share>x</div><aside>y</aside><div id=cookieNotice>z</div></article>") == "A\nB\nC\nD"
    for closed in ("aside", "nav", "div hidden", "div class=comments", "div class=related"):
        assert text(f"<p>Body</p><{closed}><article>Card</article></{closed.split()[0]}>") == "Body"


def test_varying_slots_overrule_words_of_the_layout(spark):
    source = lambda k: f"<p>Motto</p><div class=page-widget><p>Text{k} body</p></div><div class=ad>Buy{k}</div><div class=page-header>Our name</div>"
    rows = [(k, f"https://one.example.com/{k}", source(k), None, None) for k in range(6)]
    rows += [(9, "https://two.example.com/", source(9), None, None)]
    got = {r.page_id: r.text for r in he.extract_main_text(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == {**{k: f"Text{k} body" for k in range(6)}, 9: "Motto"}
