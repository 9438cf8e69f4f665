import html
import re

import pytest

from deckloom.llm import html_extract as h
from deckloom.llm.queries import op10_html, table

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style></head><body class="page">
<header><h1>Site</h1></header><div id="main-nav"><a href=x>Home</a></div>
<main><article class="post-12"><header><h1>Title &amp; more</h1><p>By me</p></header>
<p>First <b>bold<br>next</b> line that is long enough.<p>Second <a href="u">link</a>&nbsp;here &lt;tag&gt; &#8364;.
<ul><li>one<li>two</ul><div class="ad-box"><p>BUY</p></div><table><tr><td>c1<td>c2</table><form><input><p>mail</p></form><aside>side</aside>
<script>if (a < b) "</p>"</script><!-- <p>gone</p> --></article>
<section class="comments"><p>I like this very much indeed, yes, I do like it, a great deal of it in fact.</p></section></main><footer>f</footer></body>"""


def test_article_only():
    assert h.main_blocks(PAGE, None) == ["Title & more", "First bold next line that is long enough.", "Second link here <tag> €.", "one", "two", "c1", "c2"]


@pytest.mark.parametrize("source, want", [
    ("", []), ("plain", ["plain"]), ("<p>a", ["a"]), ("<p>a</p><p>b<!-- x", ["a", "b"]), ("<div>a<div>b</div>c</div>", ["a", "b", "c"]), ("a <b", ["a"]),
    ("<p>a &am b &lt", ["a &am b <"]),
])
def test_broken_markup(source, want):
    assert h.main_blocks(source, None) == want


def test_hosts_agree_on_a_path(spark):
    text = "Words of the article that go on for a while here. " * 3
    usual = f"<body><div class='c'><p>{text}</p></div><div class='side'><p>short</p></div></body>"
    odd = f"<body><div class='c'><p>{text}</p></div><div class='side'><p>{text} {text[:40]}</p></div></body>"
    rows = [(i, f"http://h.example.org/{i}", usual) for i in range(5)] + [(9, "https://u@H.example.org:80/x", odd), (9, "https://u@H.example.org:80/x", odd), (10, None, None), (11, "x", ""), (12, "http://h.example.org", "<p>" + "a b " * 100_000)]
    frame = spark.createDataFrame([(*r, 1, "h") for r in rows], "page_id long, url string, html string, path int, host string")
    for few in (100, 0):
        got = {r["page_id"]: r for r in h.extract_pages(frame, broadcast_hosts=few).collect()}
        assert got[9]["text"] == got[0]["text"] == " ".join(text.split())
        assert got[10]["text"] == got[11]["text"] == "" and got[12]["n_chars"] == 399_999
        assert h.extract_pages(frame, broadcast_hosts=few).count() == len(rows)
    assert h.extract_pages(frame.limit(0)).count() == 0


def test_table(spark, sf_dir):
    pages = {r["page_id"]: r["html"] for r in table(spark, sf_dir, "pages").collect()}
    for r in op10_html(spark, sf_dir).collect():
        inner = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " ", x.replace("<b>", ""))).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert r["text"] == "\n\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


@pytest.mark.parametrize("depth", [505, 520, 20_000])
def test_any_depth(depth):
    page = "<div>" * depth + "<nav>MENU TEXT</nav><p>The words of the article itself.</p>" + "</div>" * depth + "<p>after</p>"
    assert h.main_blocks(page, None)[:1] == ["The words of the article itself."] and "MENU TEXT" not in str(h.main_blocks(page, None))


def test_votes_against_plain_counting(spark):
    """Each page votes for its own best path; hosts take the most votes, the
    first path of those in code point order."""
    rows = []
    for i in range(60):
        kind = ["c1", "c2", "k"][(i * i) % 7 % 3]
        rows.append((i, f"http://h{i % 4}.org/{i}", f"<body><div class='{kind}'><p>{'word ' * 30}{i}</p></div><div class=menu><p>x</p></div></body>"))
    rows.append((99, None, rows[0][2]))
    votes = {}
    for _, url, source in rows[:-1]:
        own = votes.setdefault(url.split("/")[2], {})
        path = h.parse(source).best().path
        own[path] = own.get(path, 0) + 1
    want = {host: min(own, key=lambda p: (-own[p], p)) for host, own in votes.items()}
    got = h.host_paths(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["host"]: r["path"] for r in got} == want and set(want.values()) <= {"html>body>div.c#", "html>body>div.k"}


def test_a_page_of_two_parts_is_kept():
    """Where the host's path holds only part of a page's article, the page's
    own container stands."""
    text = "Words of the article that go on for a while here. " * 4
    page = f"<body><div class=whole><div class=a><p>{text}</p></div><div class=b><p>{text}</p></div></div></body>"
    assert len(h.main_blocks(page, "html>body>div.whole>div.a")) == 2
