import random

from runlens.llm import template_removal as tr

PAGES = "page_id long, url string, html string"


def text(html):
    return tr.Page(html).text()


def test_article_and_what_stands_around_it():
    assert text("""<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head>
        <body class="has-sidebar"><header><h1>Site</h1></header><nav><ul><li><a href="/a">A</a></ul></nav><!-- <p>no</p> --><div class="ad">buy</div>
        <div id="cookie-notice">We use cookies</div><article><header><h1>Real &amp; title</h1></header><p><b>One <i>t</i>wo<br>three<p>four &lt;x&gt; &am
        <aside>more</aside><section class="comments"><article class="comment">nope</article></section><form>mail <input></form></article>
        <aside>side</aside><footer>&copy; f""") == "Real & title One two three four <x> &am"


def test_odd_markup():
    assert text("") == "" and text("plain < text & <b") == "plain < text &"
    assert text("<p title='a>b'>x</p><p>y</b></i>z<ul><li>a<li>b</ul>") == "x yz a b"
    assert text("<main><div class=content>a&nbsp;b</div></main>tail") == "a b"
    assert text("<div>" * 50_000 + "deep") == "deep"
    assert text("<article>one</article><p>mid</p><article>two</article>") == "one two"
    assert text("<script>never closed <p>x") == ""


def test_recurring_subtrees(spark):
    page = "<html><body><div class=top>SITE <b>name</b></div><div><p>{}</p></div><div class=bottom>bye</div></body></html>"
    copies = [(100 + i, "http://h.org/c", page.format("the same long words on many pages of the host")) for i in range(8)]
    few = [(200 + i, "http://few.org/", page.format(f"only {i}")) for i in range(tr.MIN_PAGES - 1)]
    rows = [(i, f"http://h.org/{i}", page.format(f"text {i} of the page is longer than all")) for i in range(tr.MIN_PAGES)] + copies + few
    rows += [(None, None, None), (1, "http://h.org/1", page.format("text 1 of the page is longer than all")), (9, "x", "")]
    df = spark.createDataFrame([(*r, "c", "d") for r in rows], PAGES + ", text string, deleted string").repartition(4)
    got = sorted(((r["page_id"], r["text"], r["n_chars"]) for r in tr.main_texts(df).collect()), key=str)

    def want(r):
        if not r[2]:
            return ""
        words = r[2].split("<p>")[1].split("</p>")[0]
        return f"SITE name {words} bye" if "few" in r[1] else words

    assert got == sorted(((r[0], want(r), len(want(r))) for r in rows), key=str)
    assert tr.main_texts(spark.createDataFrame([], PAGES)).collect() == []


def test_a_marked_article_is_never_cut(spark):
    page = "<body><div>menu</div><article><p>shared words</p><p>own {}</p></article></body>"
    got = tr.main_texts(spark.createDataFrame([(i, "http://h.org", page.format(i)) for i in range(9)], PAGES)).collect()
    assert {r["text"] for r in got} == {f"shared words own {i}" for i in range(9)} and {r["n_deleted"] for r in got} == {0}


def host_texts(spark, htmls):
    rows = [(i, "http://h.org/p", h) for i, h in enumerate(htmls)]
    got = sorted(tr.main_texts(spark.createDataFrame(rows, PAGES).repartition(3)).collect(), key=lambda r: r["page_id"])
    return [r["text"] for r in got], [r["n_deleted"] for r in got]


def test_boxes_that_recur_inside_marked_articles(spark):
    box = "<div class=bio><p>Ann writes here, at greater length than in any article of the site</p></div>"
    page = "<article><h1>Head {0}</h1><div><p>own {0}</p><p>as ever</p></div>" + box + "</article>"
    assert host_texts(spark, [page.format(i) for i in range(tr.MIN_PAGES)]) == ([f"Head {i} own {i} as ever" for i in range(tr.MIN_PAGES)], [1] * tr.MIN_PAGES)
    few, none = host_texts(spark, [page.format(i) for i in range(tr.MIN_PAGES - 1)])
    assert all("Ann writes" in t for t in few) and not any(none)
    # copies of one article with other things around it are one article; what is all of an article stays, and so does a heading
    copies = [f"<article><h1>A</h1><div>the same long words</div><p>seen {i}</p></article>" for i in range(9)]
    assert host_texts(spark, copies + [f"<article><p>an altogether different article {i}</p></article>" for i in range(3)])[1] == [0] * 12
    outside = ["<article><p>own words {0}</p><div>both in and out</div></article><div>both in and out</div>".format(i) for i in range(5)]
    assert host_texts(spark, outside) == ([f"own words {i}" for i in range(5)], [1] * 5)
    sole = ["<article><h1>A</h1><div>all there is</div></article>"] + [f"<article><div>all there is</div><div><h2>sub</h2></div><p>long words of {i}</p></article>" for i in range(9)]
    assert host_texts(spark, sole) == (["A all there is", *[f"sub long words of {i}" for i in range(9)]], [0, *[1] * 9])


def test_a_long_note_under_every_page(spark):
    note = "<div>legal <b>note</b> " + "of many words " * 20 + "</div>"
    page = "<body><div>SITE</div><p>text <a>{}</a> here</p>" + note + "</body>"
    assert host_texts(spark, [page.format(i) for i in range(50)]) == ([f"text {i} here" for i in range(50)], [2] * 50)
    # one in ten pages without it, and copies of a page with other things around it
    pages = [page.format(i) for i in range(45)] + [f"<body><div>SITE</div><p>the one long text on copies of the page</p><p>{i}</p></body>" for i in range(5)]
    texts, _ = host_texts(spark, pages)
    assert texts == [f"text {i} here" for i in range(45)] + [f"the one long text on copies of the page {i}" for i in range(5)]


def brute(htmls):
    """Texts of the pages of one host, counted by the definition."""
    pages = [tr.Page(h) for h in htmls]
    different = {h: p for h, p in zip(htmls, pages)}.values()
    seen = lambda part: sum(part in p.blocks() for p in different)
    usual = {b for p in different for b in p.blocks() if seen(b) >= max(tr.MIN_PAGES, tr.USUAL * len(different))}
    marks = [max(((n, b) for b, n in p.blocks().items() if b not in usual), default=(0, 0))[1] for p in different]
    found = {}
    for p, mark in zip(different, marks):
        for i, h in enumerate(p.subtrees()):
            if h and p.countable(i):
                found.setdefault(h, set()).add(mark)
    recurring = frozenset(h for h, m in found.items() if len(m) >= tr.MIN_PAGES)
    return [p.text(p.taken_out(recurring)) for p in pages]


def test_counts_by_definition(spark):
    rng = random.Random(5)
    block = lambda: rng.choice(["<div>{}</div>", "<p>{}</p>", "<ul><li>{}</ul>", "<section><h2>x</h2>{}</section>", "<div><p>{}</p><p>b</p></div>"]).format(rng.choice("abcdefgh") * rng.randrange(1, 4))
    htmls = [rng.choice(["<article>{}</article>", "<body>{}</body>"]).format("".join(block() for _ in range(rng.randrange(1, 7))) + rng.choice(["", f"<p>own {rng.randrange(40)}</p>"])) for _ in range(120)]
    want = brute(htmls)
    assert host_texts(spark, htmls)[0] == want and want != [text(h) for h in htmls]
