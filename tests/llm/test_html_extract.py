import html
import re
import time

from tessera.llm import html_extract as op


def test_blocks():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="menu-page"><nav>Menu <b>x</b></nav><header>Top</header><!-- no --><div class="ad banner">Buy</div>
    <p>Hi &amp; yo<b>l</b>d <!-- c --> x<br>y<p>2 &lt; 3<script>if(a<b) "</p>"</script></p><div id="comments"><p>bad</p></div><form>f</form><aside>s</aside><p>end <a title="a>b">z</a> 1 < 2</p>
    <footer>F</footer>"""
    assert op.blocks(page) == (["Hi & yold x y", "2 < 3", "end z 1 < 2"], False)
    assert op.blocks("<p>out</p><article><h1>A</h1><p>b\n\t c<nav>no</nav><div class='share'>no</div></article><p>out") == (["A", "b c"], True)
    assert op.blocks("<main><ul><li>1<li>2</ul></main>") == (["1", "2"], True)
    assert op.blocks("<aside><article>x</article></aside><p>y") == (["y"], False)
    assert op.blocks(None) == op.blocks("") == op.blocks("<script>x") == op.blocks("<!-- open") == ([], False)


def test_classes_count_as_a_whole():
    for c in ("post has-sidebar", "share-price-report", "notification-service", "notice"):
        assert op.blocks(f'<article class="{c}"><p>Text</p></article>') == (["Text"], True)
    assert op.blocks('<main class="with-sidebar"><p>Text') == (["Text"], True)
    assert op.blocks('<article><p class="notice-board">Text</p><p class="notice">x</p><article class="comment">y</article><div class="site-footer">z') == (["Text"], True)


def test_broken_markup_takes_linear_time():
    begin = time.monotonic()
    assert op.blocks("<p>a</p>" + "<a " * 1_700_000) == (["a"], False)
    for broken in ("<a =\"", "<a ='x'\" ", "</a ", "<!--", "<!- ", "<", "<b>", "<i></b>", "<p class='", "&", "<script"):
        op.blocks("<p>a</p>" + broken * 200_000)
    op.blocks("<span><div>" + "<b>" * 100_000 + "</span>" * 100_000)
    assert time.monotonic() - begin < 40
    assert op.blocks("<p title=it's>a</p><p title='a>b'>c</p><p class=\"x>d</p>") == (["a", "c", "d"], False)


def test_blocks_that_most_main_texts_have_go(spark):
    notice = "<p>Read our terms of use before you copy any of this</p>"
    quoted = "<p>A passage of ten words that only three of them quote</p>"
    rows = [(k, f"http://a.example/{k}", f"<article>{notice}<p>Story {k} {' '.join(f'w{k}x{i}' for i in range(20))}</p>{quoted if k < 3 else ''}</article>") for k in range(10)]
    rows += [(20 + k, "http://b.example/", f"<article><p>{'copied words of an article ' * 4}</p><p>{'y' * (k + 1)}</p></article>") for k in range(12)]
    rows += [(40 + k, "http://c.example/", f"<article>{notice}<p>{'own words here ' * 9}</p></article>") for k in range(12)]
    got = {r["page_id"]: r["text"] for r in op.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k].startswith(f"Story {k} ") for k in range(10))
    assert [k for k in range(10) if got[k].endswith("them quote")] == [0, 1, 2]
    assert all(got[20 + k].startswith("copied") and got[40 + k].startswith("Read our") for k in range(12))  # a group of near copies; one text


def test_pages_with_marked_text(spark):
    pages = {r["page_id"]: r for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    for r in op.op5_html_extract(spark, "/root/testdata/sf0.01").collect():
        body = re.search("<article>(.*)</article>", pages[r["page_id"]]["html"], re.S)[1]
        want = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1)>", body)]
        assert r["text"] == "\n".join(filter(None, want)) and r["n_chars"] == len(r["text"])


def brute(rows, depth):
    """Removes what lies in a run of depth tokens that another page of the host has too."""
    from urllib.parse import urlsplit

    out = []
    streams = [(urlsplit(u).netloc if u else "", (i, u, h), " ".join(op.blocks(h)[0]).split(" ")) for i, u, h in rows]
    for (i, u, h), (host, me, tokens) in zip(rows, streams):
        other = {tuple(t[k : k + depth]) for g, page, t in streams if g == host and page != me for k in range(len(t) - depth + 1)}
        gone = {k + d for k in range(len(tokens) - depth + 1) if tuple(tokens[k : k + depth]) in other for d in range(depth)}
        at, kept = 0, []
        for b in op.blocks(h)[0]:
            words = b.split(" ")
            rest = [w for k, w in enumerate(words) if at + k not in gone]
            at += len(words)
            kept += [" ".join(rest)] if rest else []
        out.append((i, "\n".join(kept)))
    return sorted(out, key=str)


def test_repeated_runs_of_a_host_go(spark):
    top = "".join(f"<p>Welcome to the site number one of the town, line {k}</p>" for k in range(2))
    rows = [(k, f"http://a.example/{k}", f"<body>{top}<p>Text {k} has words of its own {'z' * k}</p></body>") for k in range(5)]
    rows += [(9, "http://b.example/", f"<body>{top}</body>"), (10, "http://c.example/", f"<p>{top}"), (10, "http://c.example/", f"<p>{top}"), (11, None, None), (None, None, "<p>x"), (12, "http://a.example/e", "")]
    frame = spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in rows], "page_id long, url string, html string, host string, uid int")
    got = op.extract(frame).collect()
    assert sorted(((r["page_id"], r["text"]) for r in got), key=str) == brute(rows, op.DEPTH)
    assert {r["text"] for r in got if r["page_id"] == 3} == {"3 has words of its own zzz"}  # the word Text follows the repeated lines on each page


def test_repeats_on_marked_pages_count(spark):
    menu = "<p>Home of the daily paper with news sport and weather</p>"
    rows = [(k, f"http://a.example/{k}", f"{menu}<article><p>Article {k} {'y' * k}</p></article>") for k in range(4)]
    rows += [(9, "http://a.example/9", f"{menu}<p>Own words of the page without marks"), (10, "http://b.example/", f"{menu}<p>Alone here")]
    got = {r["page_id"]: r["text"] for r in op.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[9] == "Own words of the page without marks" and got[10].startswith("Home of") and got[2] == "Article 2 yy"


def test_empty(spark):
    assert op.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
