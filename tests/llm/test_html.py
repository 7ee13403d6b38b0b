import time

import pytest

from tessera.llm import html

SCHEMA = "page_id long, url string, html string, text string"


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>no</title>{head}</head><body>{body}</body></html>"


LONG = "Some words of an article that go on for a while, with commas and all."
CASES = {
    "plain": (page(f"<nav><ul><li><a href='/'>Home</a></ul></nav><div class='ad'>Buy</div><article><h1>T &amp; U</h1><p>{LONG}<br>more\n here</p><p><b>x<br><p>{LONG}</article><footer>&copy; f</footer>"), f"T & U\n{LONG} more here\nx\n{LONG}"),
    "unclosed": (f"<body><nav>m</nav><article><h1>A</h1><p>{LONG}<p>b &am", f"A\n{LONG}\nb &am"),
    "classes": (page(f"<div id='cookieNotice'>We use</div><div class='site-header'>Logo</div><div class='content'><p>{LONG}</p><div class='ad-box'>Ad</div><p>End <i>in</i>line</p><div class='share-buttons'>share</div></div><div class='sidebar'><p>{LONG * 2}</p></div><section id='comments'><article class='comment'><p>{LONG * 3}</p></article></section>"), f"{LONG}\nEnd inline"),
    "scripts": (page(f"<main><script>var a='<p>no</p>'</script><style>p{{}}</style><p>{LONG}</p><form><p>mail <input></p></form><noscript>js</noscript><!-- no > no --><p hidden>no</p><p style='display: none'>no</p></main>", "<style>b{}</style>"), LONG),
    "header in article": (page(f"<header><p>Site</p></header><article><header><h1>Title</h1></header><p>{LONG}</p><footer>by me</footer></article>"), f"Title\n{LONG}"),
    "wrapper with a word": (page(f"<div class='with-sidebar'><article><h1>T</h1><p>{LONG}</p></article><div class='sidebar'>s</div></div>"), f"T\n{LONG}"),
    "text not markup": (page(f"<article><p>{LONG} 1 < 2 and <3 a&nbsp;&#39;b&#x27;</p></article>"), f"{LONG} 1 < 2 and <3 a 'b'"),
    "quotes": (page(f"<article><p title=\"a > b\">{LONG}</p><p class='x>y'>z</p></article>"), f"{LONG}\nz"),
    "empty": ("", ""),
    "no text": (page("<nav>only</nav>"), ""),
    "bare": (LONG, LONG),
    "comment unclosed": (f"<article><p>{LONG}</p><!-- the rest <p>x</p>", LONG),
    "formula": (page(f"<article><p>{LONG} Let <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>no</annotation></math> be <svg viewBox='0 0 1 1'><path d='M0'/><text>y</text></svg>.</p></article>"), f"{LONG} Let x=2 be y."),
    "doubtful words": (page(f"<article><p>{LONG}</p><div class='widget-article'><p>Body too.</p></div><div class='related'><p>See <a href='x'>this other long title of a page</a></p></div><p class='search-results'>More body.</p></article>"), f"{LONG}\nBody too.\nMore body."),
    "list and table": (page(f"<article><p>{LONG}</p><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></article>"), f"{LONG}\na\nb\nc\nd"),
}


@pytest.mark.parametrize("name", CASES)
def test_own_best_container(name):
    text, want = CASES[name]
    assert html.extract(text, [])[0] == want


def test_hosts_agree_on_a_path(spark):
    body = "<div class='post p{k}'><p>{long}</p></div><div class='teaser'><p>{other}</p></div>"
    rows = [(k, "http://A.example.com:80/x", page(body.format(k=k, long=LONG * 3, other="short, text")), "z") for k in range(9)]
    # on this page the teaser is longer than the article, but the host's paths say where the article is
    rows += [(9, "https://u@a.example.com/y?z", page(body.format(k=9, long=LONG, other=LONG + " More words here, yes, more.")), "z")]
    rows += [(10, "http://b.example.com", page(f"<article><p>{LONG}</p></article>"), "z"), (11, None, None, None), (None, "no url", "", ""), (12, "http://a.example.com", page(f"<div class='other'><p>{LONG * 9}</p></div>"), ""), (13, "", "x " * 200_000, ""), (13, "", "x " * 200_000, "")]
    got = {r.page_id: r for r in html.extract_pages(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[9].text == LONG and got[9].path == "html>body>div.p0.post" and got[9].host == "a.example.com"
    assert got[0].text == LONG * 3 and got[10].text == LONG and got[11].text == "" and got[None].text == ""
    assert got[12].text == LONG * 9 and len(got[13].text) == 399_999
    assert html.extract(rows[9][2], [])[0] == LONG + " More words here, yes, more."


def test_empty_table(spark):
    assert html.extract_pages(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("unit", ["<", "<p>", "<a \"", "<div>", "</p>", "<!--", "&amp;", "<a href='x'>", "<p class=\"", "<b>x", "<script>", "<b></i>", "<div></p>", "<div class='widget'>w", "<div class='ad'><h1>", "<li>", "<td>", "<b>x<hr>", "<i><div><b></i>"])
def test_odd_runs_end_soon(unit):
    began = time.time()
    for leader in ("html>body", "html>div>div"):
        html.extract(unit * 20_000 + "</i>text<p class='ad'>x", [leader])
        html.extract(unit * 20_000 + "</i></p></b><div></div>" * 5_000, [leader])
    html.votes(unit * 20_000 + "text")
    assert time.time() - began < 10


def test_deep_pages_take_linear_time():
    text = "<div class='related'>x" * 100_000
    began = time.time()
    html.votes(text)
    html.extract(text, ["div>div"], frozenset({html.path_number("div.related>div.related")}))
    assert time.time() - began < 10


def test_an_article_in_two_containers_stays_whole():
    both = page(f"<main><div class='a'><p>{LONG * 6}</p></div><div class='b'><p>{LONG * 4}</p></div></main>")
    leader = ["html>body>main>div.a"]
    assert html.extract(both, leader)[0] == f"{LONG * 6}\n{LONG * 4}"
    assert html.extract(page(f"<main><div class='a'><p>{LONG * 6}</p></div></main>"), leader) == (LONG * 6, leader[0])


def test_a_host_of_many_templates_has_its_paths(spark):
    """Ten templates; on some pages a teaser is longer than the article."""
    rows = []
    for k in range(200):
        long = LONG * (1 if k % 20 == 0 else 4)
        rows.append((k, "http://h.example.com/x", page(f"<div class='teaser'><p>{LONG + ' and more words'}</p></div><div class='t{chr(97 + k // 20)}'><p>{long}</p></div>"), ""))
    got = {r.page_id: r for r in html.extract_pages(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[k].text == LONG * (1 if k % 20 == 0 else 4) for k in got)


def test_what_a_host_repeats_goes(spark):
    """The same doubtful class holds a repeated call on one host and text of its own on another."""
    body = "<article><p>{long} {k}</p><div class='widget-box'><p>{inner}</p></div></article>"
    rows = [(k, "http://a.com/", page(body.format(long=LONG, k=k, inner="Join our club today.")), "") for k in range(8)]
    rows += [(100 + k, "http://b.com/", page(body.format(long=LONG, k=k, inner=f"Part {k} of the story.")), "") for k in range(8)]
    rows += [(200 + k, "http://c.com/", page(body.format(long=LONG, k=0, inner="One page, read twice.")), "") for k in range(2)]
    got = {r.page_id: r.text for r in html.extract_pages(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[k] == f"{LONG} {k}" and got[100 + k] == f"{LONG} {k}\nPart {k} of the story." for k in range(8))
    assert got[200] == f"{LONG} 0\nOne page, read twice."


def generated(rng, k):
    """A page of one of three hosts' templates with a known article, and that article's text."""
    words = lambda n: " ".join(rng.choice(["sea", "green", "boat", "lamp", "river,", "stone.", "Tom", "eats", "&amp;", "caf&eacute;"]) for _ in range(n))
    blocks = [words(rng.randint(5, 60)) for _ in range(rng.randint(1, 12))]
    inner = "".join(rng.choice([f"<p>{b}</p>", f"<p><b>{b}</b>", f"<div class='widget-text'>{b}</div>", f"<ul><li>{b}</ul>", f"<blockquote>{b}</blockquote>"]) for b in blocks)
    noise = lambda: rng.choice([f"<div class='share-bar'>{words(4)}</div>", f"<div class=ad>{words(20)}</div>", f"<form>{words(3)}<input></form>", "<script>x<y</script>", f"<aside>{words(9)}</aside>", ""])
    host = k % 3
    hold = [f"<article>{noise()}{inner}{noise()}</article>", f"<div class='content c{k}'>{noise()}{inner}{noise()}</div>", f"<main><div id=x>{noise()}{inner}</div></main>{noise()}"][host]
    html_ = page(f"<nav><a href=/>{words(3)}</a></nav><div class='cookie-notice'>{words(12)}</div>{hold}<div id='comments'><p>{words(80)}</p></div><footer>{words(6)}</footer>")
    return f"http://h{host}.com/{k}", html_, [" ".join(html.unescape(b).split()) for b in blocks]


def test_precision_and_recall_on_generated_pages(spark):
    import random

    rng = random.Random(3)
    made = [generated(rng, k) for k in range(300)]
    rows = [(k, url, text, "") for k, (url, text, _) in enumerate(made)]
    hit = got_n = want_n = whole = 0
    for r in html.extract_pages(spark.createDataFrame(rows, SCHEMA)).collect():
        want, got = made[r.page_id][2], r.text.split("\n")
        hit += sum(len(b) for b in got if b in want)
        got_n, want_n = got_n + sum(map(len, got)), want_n + sum(map(len, want))
        whole += got == want
    print(f"precision {hit / got_n:.4f}, recall {hit / want_n:.4f}, whole pages {whole / len(made):.4f}")
    assert hit >= 0.99 * got_n and hit >= 0.99 * want_n and whole >= 0.97 * len(made)
