import random
import re

from keelson.llm import html_text as h

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var a="</p><p>no";</script></head><body class="post">
<header><h1>Site</h1></header><nav><ul><li><a href=x>Menu</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<div class='ad'>Buy <p>now</p></div><!-- <p>hidden</p> --><article><header><h2>Head &eacute;&nbsp; line</h2></header>
<p>One  <b>bold</b>
text<br>more &lt;tag&gt; 5 < 6<p>Two.</p><ul><li>item <a href="a>b">link</a><li>second</ul>
<form><p>mail</p><input></form><aside><p>side</p></aside><div id="comments"><p>First!</p></div><p>End.</p></article><footer>&copy; x</footer>"""


def test_one_page():
    found = h.blocks(PAGE)
    assert [t for t, z in found if z >= h.MAIN] == ["Head é line", "One bold text more <tag> 5 < 6", "Two.", "item link", "second", "End."]
    assert not any(z == h.OTHER for _, z in found)
    assert h.blocks(None) == [] and h.blocks("") == [] and h.blocks("<p>open <b>x") == [("open x", h.OTHER)] and h.blocks("<script>x") == []


def main_text(page):
    return [t for t, z in h.blocks(page) if z >= h.MAIN]


def test_articles_survive_class_pieces():
    for page in ('<article class="post has-sidebar"><p>Text.</p></article>', '<main class="no-sidebar">Text.</main>', '<div class="content with-comments">Text.</div>', "<article id=has-menu>Text."):
        assert main_text(page) == ["Text."]
    for name in ("comment-list", "post-comments", "sidebar", "site-footer widget", "ad-slot-3", "cookie-notice"):
        assert main_text(f'<article><p>Text.</p><div class="{name}"><p>Other.</p></div></article>') == ["Text."]


def test_broken_markup_is_linear_and_leaves_no_tags():
    import time

    assert h.blocks("<p>a <a title=\"it\"s'>b</a> c</p>") == [("a b c", h.OTHER)]
    assert [t for t, _ in h.blocks('<p>1</p><p title="never closed>2</p><p>3</p>')] == ["1", "2", "3"]
    assert [t for t, _ in h.blocks("<p>1<![CDATA[x]]></p></><p>2 < 3<!-- rest")] == ["1", "2 < 3"]
    t = time.time()
    for piece in ('<a title="', "<a title='x", "<!", "<", "= '", "<!--", "<svg>", "&amp;"):
        h.blocks("<p>" + piece * 200_000 + ">" + piece * 10)
    assert time.time() - t < 60


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_alignment_is_longest():
    rnd = random.Random(5)
    for _ in range(300):
        a, b = ([rnd.choice("abcde") for _ in range(rnd.randrange(12))] for _ in range(2))
        hit = sorted(h.shared_lines(a, b))
        it = iter(b)
        assert len(hit) == lcs(a, b) and all(any(a[i] == y for y in it) for i in hit)
    assert len(h.shared_lines(["x"] * 2000, ["x"] * 1000 + ["y"] + ["x"] * 900)) == 1900


def test_alignment_is_longest_at_any_size(monkeypatch):
    """Over a million equal-line matches with one line shifted; and halving against the plain table."""
    a = [x for k in range(210) for x in (f"label {k}", *["0"] * 5)]
    assert len(h.shared_lines(a, ["0", *a])) == len(h.shared_lines(["p", *a, "q"], ["0", "r", *a, "s"])) == 1260
    monkeypatch.setattr(h, "ROW_BITS", 4, raising=False)
    rnd = random.Random(6)
    for _ in range(300):
        a, b = ([rnd.choice("abcde") for _ in range(rnd.randrange(25))] for _ in range(2))
        hit = sorted(h.aligned(a, b))
        assert len(hit) == lcs(a, b) and all(a[i] == b[j] for i, j in hit) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(hit, hit[1:]))


def test_template_goes_without_structure(spark):
    rows = []
    for k in range(1200):
        body = "".join(f"<p>Story {k} part {j}, told at some length for page {k}.</p>" for j in range(4))
        rows.append((k, f"http://h{k % 2}.org/a/{k:05d}", f"<body><div>Daily site</div><div>Top<br>stories</div>{body}<div>All rights reserved by us</div>"))
    got = h.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert len(got) == 1200
    for r in got:
        assert r.text == "\n".join(f"Story {r.page_id} part {j}, told at some length for page {r.page_id}." for j in range(4)) and r.n_chars == len(r.text)


def test_differencing_decides(spark):
    """Pages whose article element holds a template too, or holds nothing but one; and pages of a class-less layout."""
    rows, want = [], {}
    for k in range(60):
        own = [f"Own sentence {j} of page {k}, told at some length." for j in range(5)]
        body = "".join(f"<p>{x}</p>" for x in own)
        if k < 20:  # nested template beside a sentence that all articles quote
            page = f"<article><div>Read the daily site in the app, it is free.</div>{body}<p>All of them quote this sentence.</p><p>Share this</p></article>"
            own = [*own, "All of them quote this sentence."]
        elif k < 40:  # the main element is a template
            page = f"<main><h1>Welcome to the daily site.</h1></main><div><span>Top stories</span></div>{body}"
        else:
            page = f"<div>Daily site</div><div>Sections of all kinds.</div>{body}<div>Imprint</div>"
        rows.append((k, f"http://h{k // 20}.org/{k:03d}", page))
        want[k] = "\n".join(own)
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in h.extract(df).collect()}
    ends = {0, 19, 20, 39, 40, 59}  # pages with one neighbour keep what looks like sentences
    assert {k: v for k, v in got.items() if k not in ends} == {k: v for k, v in want.items() if k not in ends}
    alone = {r.page_id: r.text for r in h.extract(df.withColumn("url", h.F.concat(h.F.lit("http://"), h.F.col("page_id"), h.F.lit(".org/")))).collect()}
    assert sum(alone[k] != got[k] for k in got) >= 54


def test_template_larger_than_the_text_goes(spark):
    menu = "".join(f"<div>Department {j} of the daily site</div>" for j in range(14))
    rows = [(k, f"http://h{k % 2}.org/a/{k:05d}", f"<body>{menu}" + "".join(f"<p>Own {k} part {j}, told at some length for the page numbered {k}.</p>" for j in range(4)) + "</body>") for k in range(100)]
    got = h.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert len(got) == 100 and all(r.text == "\n".join(f"Own {r.page_id} part {j}, told at some length for the page numbered {r.page_id}." for j in range(4)) for r in got)


def test_runs_of_copies_reach_beyond_block_edges(spark, monkeypatch):
    """Runs of 1 to 900 copies, exact ones and ones with a line of their own, are compared with the pages beside the run."""
    rows, want, k = [], {}, 0
    for story, n in enumerate([3, 1, 900, 4, 1, 1, 300, 5, 2]):
        for _ in range(n):
            own = [f"Story {story} part {j}, told at {'great ' * story}length." for j in range(12)] + [f"Seen {k}"] * (story % 2)
            rows.append((k, f"http://one.org/a/{story}?ref={k}", "<body><div>Daily site</div><div>Top stories</div>" + "".join(f"<p>{x}</p>" for x in own) + "<div>All rights reserved</div></body>"))
            want[k] = "\n".join(own)
            k += 1
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    for size in (10, 100, 10**6):
        monkeypatch.setattr(h, "BLOCK_PAGES", size)
        monkeypatch.setattr(h, "LEAST_PAGES", size)
        got = {r.page_id: r.text for r in h.extract(df).collect()}
        assert got == want


def test_copies_and_edges(spark):
    art = "<article><p>The.</p><p>Same words here</p><p>{}</p><p>Share this</p></article>"
    rows = [(k, f"http://a.org/x/{k}", art.format(f"Long and different text number {k} " * 4)) for k in range(4)]
    rows += [(7, "http://b.org/1", art.format("copy")), (8, "http://b.org/2", art.format("copy")), (8, "http://b.org/2", art.format("copy")), (9, None, None), (None, "bad", "<p>x")]
    got = {r.page_id: r.text for r in h.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got[1].split("\n")[0] == "The." and "Share this" not in got[1] and got[1].count("number 1") == 4
    assert got[0].endswith("Share this") and got[7] == got[8] == "The.\nSame words here\ncopy\nShare this"
    assert got[9] == "" and got[None] == "x"
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    assert h.extract(df.limit(0)).count() == 0
    clash = df.withColumns({c: h.F.lit("z") for c in ("host", "path", "text", "n_chars", "block", "ghost", "body", "h")})
    assert {r.page_id: r.text for r in h.extract(clash).collect()} == got


def test_very_long_pages(spark):
    """A page of four million characters, one line of a million, and a neighbour that shares most of it."""
    long = "".join(f"<p>Line {k} of a very long page.</p>" for k in range(100_000)) + "<p>" + "word " * 200_000 + "</p>"
    rows = [(1, "http://l.org/1", f"<article>{long}<p>One.</p></article>"), (2, "http://l.org/2", f"<article><p>Two.</p>{long}</article>")]
    got = {r.page_id: r.n_chars for r in h.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    n = sum(len(f"Line {k} of a very long page.") + 1 for k in range(100_000)) + 999_999
    assert got == {1: n + 5, 2: n + 5}


def test_fixture_pages(spark):
    """The article's paragraphs, by a plain reading of the fixture's fixed layout."""
    import html

    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    want = {}
    for r in rows:
        art = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        parts = re.split(r"</?(?:p|h1)>", art)
        want[r.page_id] = "\n".join(x for x in (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", p)).split()) for p in parts) if x)
    got = {r.page_id: r.text for r in h.op2_html_text(spark, "/root/testdata/sf0.01").collect()}
    assert sum(got[k] != want[k] for k in want) == 0
