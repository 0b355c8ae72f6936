"""Main text of pages: parsing, and repeated runs against a count of all windows."""

from collections import Counter, defaultdict

import numpy as np
import pytest

from taxatally.llm import html_text
from taxatally.llm.html_blocks import blocks

PAGE = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{{}}</style><script>var t="</p><article>";</script></head>
<body class="sidebar-left"><header><h1>Site</h1></header><nav><ul><li><a href=x>Home<li>About</ul></nav><!-- <p>gone</p> --><div class="ad">Buy &lt;now&gt;</div>
<article><header><h1>Head&nbsp; line</h1></header><p>One <b>two</b>\n three<br>four &amp five &#8364;<p>Next<ul><li>a<li>b</ul><div class="share-buttons">Share</div>
<section id="comments"><article class="comment"><p>Nice</p></article></section></article>
<aside>Side</aside><form><p>Mail</p></form><div id=cookieNotice>We use</div><p hidden>no</p><footer>&copy; all</footer></body></html>"""


def kept(html):
    return html_text.main_texts([blocks(html)], np.empty(0, np.uint64))[0][0]


def test_blocks():
    assert kept(PAGE.replace("{{}}", "{}")) == "Head line\nOne two three four & five €\nNext\na\nb"
    assert kept(None) == kept("") == kept("<html><body></body></html>") == kept("<script>x") == ""
    assert kept("plain <i>text</i> only") == "plain text only"
    assert kept("a<p>b<p>c</div>d</p>e") == "a\nb\nc\nd\ne"
    assert kept("1 < 2 and 3 > 2 <b") == "1 < 2 and 3 > 2 <b"
    assert kept('<p title="a > b">x</p><p title="open>y</p>z') == "x\ny\nz"
    assert kept("<nav>menu<article>inside</nav>after") == "after"
    assert kept("<div class='has-sidebar'><p>yes</p></div><div class='left-sidebar'>no</div><div class=page-header>no</div>") == "yes"
    assert kept("<main><p>m</p></main><div role=navigation>n</div><div style='display: none'>h</div><p>o") == "m\no"
    assert kept("<article><p>unclosed <b>bold<p>more") == "unclosed bold\nmore"
    assert kept("<p>x<textarea><p>no</p></textarea>y<select><option>1</select>z<p>&am &quo &#0; &#xD800;") == "xyz\n&am &quo � �"
    assert kept("<table><tr><td>1<td>2<tr><td><p>3</table><p>" + "w " * 200000) == "1\n2\n3\n" + ("w " * 200000).strip()


class Page:
    def __init__(self, html, run):
        one = html_text.Streams([blocks(html)], run)
        self.tokens, self.runs, self.article = one.tokens, one.windows(run), html_text.articles([blocks(html)])[0]


def brute(pages, run, ratio, least):
    """The same by counting all windows of every host; pages are (id, url, html)."""
    hosts = defaultdict(dict)
    for i, url, html in pages:
        if html is not None:
            hosts[(url or "").split("//")[-1].split("/")[0] if url else ""].setdefault(html, Page(html, run))
    runs = {}
    for host, streams in hosts.items():
        family = {h: int(s.article) or h for h, s in streams.items()}
        names = list(streams)
        for a in names:
            for b in names:
                x, y = streams[a].tokens.tolist(), streams[b].tokens.tolist()
                if a < b and not streams[a].article and not streams[b].article and 5 * longest(x, y) >= 4 * max(len(x), len(y)) and x:
                    old, new = family[b], family[a]
                    family = {h: new if f == old else f for h, f in family.items()}
        on = defaultdict(set)
        for h, s in streams.items():
            for w in s.runs.tolist():
                if w:
                    on[w].add(family[h])
        n = len(set(family.values()))
        needed = max(2, min(least, n), ratio * n)
        runs[host] = np.array(sorted(w for w, f in on.items() if len(f) >= needed), np.uint64)
    out = []
    for i, url, html in pages:
        host = (url or "").split("//")[-1].split("/")[0] if url else ""
        out.append((i, url, *html_text.main_texts([blocks(html)], runs.get(host, np.empty(0, np.uint64)), run)[0]))
    return Counter((i, u, t, len(t), r, m) for i, u, t, r, m in out)


def longest(x, y):
    best, row = 0, [0] * (len(y) + 1)
    for a in x:
        new = [0] * (len(y) + 1)
        for j, b in enumerate(y):
            if a == b:
                new[j + 1] = row[j] + 1
                best = max(best, new[j + 1])
        row = new
    return best


def unmarked_pages():
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(400)]
    text = lambda n: " ".join(rng.choice(words, n))
    pages = []
    for host in range(4):
        menu, foot = [text(2) for _ in range(6)], text(9)
        for i in range(2 + 6 * host):
            body = "".join(f"<p>{text(int(rng.integers(3, 40)))}</p>" for _ in range(int(rng.integers(1, 5))))
            pages.append((len(pages), f"http://h{host}.org/{i}", "<body>" + "".join(f"<div>{m}</div>" for m in menu) + body + f"<p>Written by {rng.choice(words)}</p><div>{foot}</div>"))
    copy = "<p>" + text(60) + "</p>"
    pages += [(len(pages) + i, f"http://h3.org/c{i}", f"<body>{copy}<p>{i}</p>") for i in range(5)]
    article = "<article>" + text(30) + "</article>"
    pages += [(100 + i, "http://h2.org/", f"<p>{text(10)}</p>{article}<div>same on all pages of a copied article, in many words</div>") for i in range(4)]
    return pages + [(200, None, "<p>no address</p>"), (201, None, None), (202, "x", ""), (0, pages[0][1], pages[0][2]), (0, pages[0][1], pages[0][2]), (None, "http://h1.org/n", "<p>null id")]


def test_runs_against_windows(spark):
    pages = unmarked_pages()
    docs = spark.createDataFrame([(*p, "x", 3) for p in pages], "page_id long, url string, html string, host string, part int")
    got = Counter(tuple(r) for r in html_text.extract(docs.repartition(5)).collect())
    assert got == brute(pages, 8, html_text.RATIO, 3)
    by = {r[0]: r for r in got}
    assert sum(r[4] for r in got) > 500
    assert by[len([p for p in pages if p[0] is not None and p[0] < 100 and "c" not in p[1]]) - 1] is not None
    copied = [r for r in got if r[1] and "/c" in r[1]]
    assert len(copied) == 5 and all(len(r[2].split()) == 61 for r in copied)
    assert all("same on all pages" in r[2] for r in got if r[0] is not None and 100 <= r[0] < 104)


def test_hosts_in_parts(spark):
    pages = [(i, "http://one.org/", f"<div>home news about contact search and some other words</div><p>text number {i} {i * 7} {i * 11} and {i * 13}</p>") for i in range(300)]
    docs = spark.createDataFrame(pages, "page_id long, url string, html string")
    for size in (3000, 1 << 20):
        got = html_text.extract(docs, part_bytes=size).collect()
        assert sorted((r.page_id, r.text) for r in got) == [(i, f"text number {i} {i * 7} {i * 11} and {i * 13}") for i in range(300)]


def test_parts_do_not_change_the_text(spark):
    """Runs that stand once in a part, and pages of one article, count over the whole host."""
    own = lambda i: " ".join(f"own{i}x{j}" for j in range(30))
    rare = "<div>a notice that three pages of the site show in many words</div>"
    same = "<div>this stands around one article that four pages have in common</div>"
    pages = [(i, "http://one.org/", f"<p>{own(i)}</p>" + (rare if i % 30 == 0 else "")) for i in range(90)]
    pages += [(100 + i, "http://one.org/", f"{same}<article>one article</article><p>{own(100 + i)}</p>") for i in range(4)]
    docs = spark.createDataFrame(pages, "page_id long, url string, html string")
    whole, parts = ({tuple(r) for r in html_text.extract(docs, part_bytes=size).collect()} for size in (1 << 20, 600))
    assert whole == parts
    text = {r[0]: r[2] for r in parts}
    assert all(text[i] == own(i) for i in range(90)) and all("this stands around" in text[100 + i] for i in range(4))


def test_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = [tuple(r) for r in pages.select("page_id", "url", "html").collect()]
    got = html_text.extract(pages).collect()
    for r in got:
        html = next(h for i, _, h in rows if i == r.page_id)
        inside = html.split("<article>")[1].split("</article>")[0]
        assert r.text == kept("<article>" + inside) and r.n_chars == len(r.text)
    assert html_text.extract(pages.filter("page_id < 0")).collect() == []


def test_boilerplate_found_by_runs(spark):
    # 44 of 100 pages of this table have a menu, an advert and a footer that their host shows once or twice.
    got = html_text.extract(spark.read.parquet("/root/testdata/sf0.1/pages.parquet")).selectExpr("sum(n_repeated) AS runs", "sum(n_marked) AS marks").first()
    assert got.runs > 0.6 * got.marks


@pytest.mark.parametrize("n", [0, 1, 2, 50, 400])
def test_suffixes(n):
    tokens = np.random.default_rng(n).integers(0, 3, n).astype(np.uint64)
    order, common = html_text.suffixes(tokens)
    listed = [tokens[i:].tolist() for i in range(n)]
    assert order.tolist() == sorted(range(n), key=lambda i: listed[i])
    for at in range(1, n):
        a, b = listed[order[at - 1]], listed[order[at]]
        assert common[at] == next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
