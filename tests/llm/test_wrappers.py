import html
import random
import re

import pytest

from pyspark.sql import functions as F

from quarry.llm import queries, wrappers

SCHEMA = "page_id long, url string, html string"
SF = "/root/testdata/sf0.01"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(n))


def site_pages():
    """(id, url, html, main text) of hosts with different templates."""
    rng = random.Random(2)
    out = []
    for i in range(30):
        title, paras = prose(rng, 5), [prose(rng, rng.randint(20, 60)) for _ in range(rng.randint(1, 6))]
        body = "".join(f"<p>{p}</p>" for p in paras)
        text = " ".join([title, *paras])
        menu = "<ul>" + "".join(f'<li><a href="/{w}">{w}</a></li>' for w in ("home", "news", "about")) + "</ul>"
        out.append((i, f"https://user@A.example:8080/{i}", f"""<!doctype html><html><head><title>x</title><script>var a="<p>no</p>";</script></head>
            <body><header><h1>The site</h1></header><nav>{menu}</nav><main><article class="post"><h1>{title}</h1>{body}
            <aside>See also</aside><div class="newsletter"><form>Mail <input></form></div></article>
            <section id="comments"><article class="comment"><p>{prose(rng, 90)}</p></article></section></main><footer>&copy; me</footer>""", text))
        # unnamed boxes: only what differs from page to page tells the text from the rest
        side = "Popular today and every day " * 12
        notice = f"<div class='box b{i}'><p>{prose(rng, 6)}</p></div>" if i % 2 else ""
        out.append((100 + i, f"http://b.example/{i}", f"""<body><div id=top>{menu}</div><div class="w{i % 3}"><div class="l">{side}</div>
            <div class="r"><h2>{title}{body}</div></div>{notice}<div class="cookie-notice">{prose(rng, 40)}</div></body>""", text))
        out.append((200 + i, f"http://c.example/{i}", f"""<div role="navigation">{menu}</div><div class="entry-content" itemprop=articleBody>
            <h2>{title}</h2><ul>{"".join(f"<li>{p}" for p in paras)}</ul><!-- <p>hidden</p> --><p style="display:none">no</p></div>
            <div class="share-buttons">Share this</div>""", text))
    return out


def test_templates(spark):
    pages = site_pages()
    table = spark.createDataFrame([p[:3] for p in pages], SCHEMA).repartition(7)
    got = {r["page_id"]: r["text"] for r in wrappers.extract(table).collect()}
    assert got == {p[0]: p[3] for p in pages}


def test_edge_rows(spark):
    rows = [(1, None, None), (2, "", ""), (3, "::", "   "), (4, "http://x/", "plain &amp;  text\n\nonly"),
            (4, "http://x/", "plain &amp;  text\n\nonly"), (None, "http://x/a", "<p>one<p>two <b>th</b>ree<br>four"),
            (6, "http://y/", "<article><p>cut off <i>he"), (7, "http://y/", "<article>" + "<p>long words</p>" * 20_000),
            (8, "http://y/", "<article><table><tr><td>a<td>b</table>&lt;p&gt;&nbsp;&#233;</article"), (9, "http://z/", "<!-- never closed <p>x"),
            (10, "http://z/", "<script>x</scrip"), (11, "http://z/", "a < b <3 > c")]
    table = spark.createDataFrame(rows, SCHEMA)
    for c in ("host", "place", "text", "wrapper"):
        table = table.withColumn(c, F.lit("x"))
    got = [(r["page_id"], r["text"]) for r in wrappers.extract(table).collect()]
    want = [(1, ""), (2, ""), (3, ""), (4, "plain & text only"), (4, "plain & text only"), (None, "one two three four"),
            (6, "cut off he"), (7, " ".join(["long words"] * 20_000)), (8, "a b <p> é"), (9, ""), (10, ""), (11, "a < b <3 > c")]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_query(spark):
    pages = {r[0]: (r[1], r[2]) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = queries.op3_main_text(spark, SF).collect()
    assert sorted(r["page_id"] for r in rows) == sorted(pages)
    for r in rows:
        url, page = pages[r["page_id"]]
        article = re.sub("</?b>", "", re.search("<article>(.*?)</article>", page, re.S)[1]).replace("<br>", " ")
        want = [" ".join(html.unescape(b).split()) for b in re.split("</?(?:p|h1)>", article)]
        assert r["text"] == " ".join(b for b in want if b) and r["url"] == url and r["n_chars"] == len(r["text"])


def shape(w):
    mark = {(True, False): "", (False, False): "?", (True, True): "+", (False, True): "*"}[w[wrappers.REQUIRED], w[wrappers.REPEATED]]
    inner = " ".join(shape(c) for c in w[wrappers.CHILDREN])
    return w[wrappers.LABEL] + (f"({inner})" if inner else "") + mark


def test_alignment_makes_optional_and_repeated_groups():
    pages = ["<div><h1>a</h1><p>b</p><p>c</p></div>", "<div><h1>a</h1><h2>x</h2><p>d</p></div><hr>",
             "<div><h1>a</h1><p>b</p></div><dl><dt>1<dd>2<dt>3<dd>4</dl>"]
    w = None
    for p in pages:
        own = wrappers.skeleton(wrappers.parse(p))
        w = own if w is None else wrappers.merge(w, own)
    assert shape(w) == "#page(div(h1 h2? p+) dl(dt+ dd+)?)"
    assert w[wrappers.CHILDREN][0][wrappers.CHILDREN][0][wrappers.CONSTANT] == "a"


def test_empty(spark):
    assert wrappers.extract(spark.createDataFrame([], SCHEMA)).count() == 0


def read(spark, pages, parts=3):
    """Text by page of one host's (html, main text), and what it should be."""
    table = spark.createDataFrame([(i, "http://h.example/", p) for i, (p, _) in enumerate(pages)], SCHEMA).repartition(parts)
    return {r["page_id"]: r["text"] for r in wrappers.extract(table).collect()}, {i: t for i, (_, t) in enumerate(pages)}


def letters(i):
    return "".join("qrstuvwxyz"[int(d)] for d in f"{i:04d}")


def test_pages_with_names_of_their_own(spark):
    """More different boxes before the article than a wrapper tells apart."""
    rng, pages = random.Random(3), []
    for i in range(700):
        text = prose(rng, 20)
        kind = f' class="{letters(i)}"' if i % 2 else ""
        pages.append((f"<body><header><p>{prose(rng, 5)}</p></header><div class='box-{letters(i)}'><p>{prose(rng, 9)}</p></div>"
                      f"<article{kind}><header>{text}</header></article></body>", text))
    got, want = read(spark, pages)
    assert got == want
    w = None
    for p, _ in pages:
        own = wrappers.skeleton(wrappers.parse(p))
        w = own if w is None else wrappers.merge(w, own)
    assert wrappers.article_place(w)[:3] == ["#page", "body", "article"]
    assert len(w[wrappers.CHILDREN][0][wrappers.CHILDREN]) <= wrappers.WIDTH
    assert sum(c[wrappers.PAGES] for c in w[wrappers.CHILDREN][0][wrappers.CHILDREN]) == 3 * 700


def test_one_page_with_many_children():
    boxes = "".join(f"<div class='{letters(i)}'>x</div>" for i in range(500))
    assert wrappers.article_place(wrappers.skeleton(wrappers.parse(f"<body>{boxes}<article>text</article></body>")))[-1] == "article"


def test_texts_that_begin_alike_are_no_constants(spark):
    rng, start, pages = random.Random(4), "Reported by our own staff. " * 10, []
    for _ in range(20):
        text = start + prose(rng, 60)
        pages.append((f"<body><div class='l'><p>{prose(rng, 9)}</p></div><div class='r'><p>{text}</p></div></body>", text))
    got, want = read(spark, pages)
    assert got == want


def test_whole_page_is_read_without_its_header(spark):
    rng, pages = random.Random(5), []
    for _ in range(20):
        one, two = prose(rng, 30), prose(rng, 30)
        pages.append((f"<html><body><header><p>{prose(rng, 3)}</p></header><div class='p'><p>{one}</p></div>"
                      f"<div class='q'><p>{two}</p></div></body></html>", f"{one} {two}"))
    got, want = read(spark, pages)
    assert got == want


def test_layout_that_goes_by_names_of_boilerplate(spark):
    """Body classes, wrappers and forms around the page; regions of others' texts stay out."""
    rng = random.Random(6)
    templates = {
        "body": "<body class='single has-sidebar'>{side}<article class='post category-search'>{text}</article></body>",
        "state": "<body class='no-comments'><div class='with-sidebar search-enabled'><article>{text}</article>{side}</div></body>",
        "form": "<body><form id=aspnetForm><div class=content>{text}</div>{side}</form></body>",
        "unnamed": "<body><form id=aspnetForm><div class=l><p>the same</p></div><div class=r>{text}</div>{side}</form></body>",
        "wrap": "<body><div class='content-sidebar-wrap'><div class=r>{text}</div>{side}</div></body>",
        "plain": "<body><div id=search><article>{text}</article></div><div class=b><p>{few}</p></div>{side}</body>",
        "others": "<body><div class=r>{text}</div><section id=comments><article class=c><p>{many}</p></article></section></body>",
        "related": "<body><div class=r>{text}</div><div class=related-posts><p>{many}</p></div><aside><p>{many}</p></aside></body>",
        "teaser": "<body><div class=r>{text}</div><aside><article><p>{few}</p></article></aside></body>",
    }
    rows, want = [], {}
    for name, template in templates.items():
        for i in range(9):
            paras = [prose(rng, 40) for _ in range(2)]
            page = template.format(text="".join(f"<p>{p}</p>" for p in paras), few=prose(rng, 9), many=prose(rng, 400),
                                   side=f"<div class='sidebar'><p>{prose(rng, 12)}</p></div>")
            rows.append((len(rows), f"http://{name}.example/", page))
            want[len(want)] = " ".join(paras)
    # a host of one page has only that page's structure
    rows += [(len(rows) + i, f"http://{i}.single/", h) for i, (_, _, h) in enumerate(rows[:45:9])]
    want |= {81 + i: want[9 * i] for i in range(5)}
    got = {r["page_id"]: r["text"] for r in wrappers.extract(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert {i: (rows[i][1], got[i]) for i in want if got[i] != want[i]} == {}
    assert len(got) == len(want)


@pytest.mark.parametrize("depth", [140, 160, 500, 5000])
def test_deep_nesting(depth):
    """Texts stay whole and in page order at any depth; boilerplate goes there too."""
    page = "".join(f"<div>a{i} " for i in range(depth)) + "<nav><div>menu</div></nav><p>last</p>" + "".join(
        f"</div>b{i} " for i in reversed(range(depth)))
    want = " ".join([*(f"a{i}" for i in range(depth)), "last", *(f"b{i}" for i in reversed(range(depth)))])
    assert wrappers.main_text(f"<article>{page}</article>", None) == want


def test_deep_page_beside_a_sound_one(spark):
    pages = [(1, "https://h.org/1", "<div>" * 5000 + "deep text"), (2, "https://h.org/2", "<article><p>sound</p></article>"),
             (3, "https://h.org/3", "<ul>" + "<li>x" * 3000), (4, "https://h.org/4", "</div>" * 3000 + "<p>open")]
    got = {r["page_id"]: r["text"] for r in wrappers.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[1] == "deep text" and got[2] == "sound" and got[3] == " ".join(["x"] * 3000) and got[4] == "open"


@pytest.mark.parametrize("page,text", [
    ("<nav><svg/></nav><article><p>kept</p></article>", "kept"),
    ("<article><p>a <svg class='i' /> b<svg width=\"1\"><text>c</text></svg></p></article>", "a b"),
    ("<article><p data-x=it's>text one don't stop</p><p>two</p></article>", "text one don't stop two"),
    ("<article><p title=\"a>b\">one</p><p title='c>d'>two</p></article>", "one two"),
    ("<article><p class=\"open>one</p><p>two</p></article>", "one two"),
    ("<article><p data-class='ad' data-note='class=\"ad\"'>one</p></article>", "one"),
    ("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be</p></article>", "Let x=1 be"),
    ("<article><p>one</p><script>if (a < b) '<p>no</p>'</script><p>two</p></article>", "one two"),
    ("<article><p " + "x='1' " * 3000 + ">one</p></article>", "one"),
    ("<article><p>one</p><p " + "x" * 50000, "one"),
])
def test_attributes_and_foreign_elements(page, text):
    assert wrappers.main_text(page, None) == text


@pytest.mark.parametrize("name,stays", [
    ("ad-hoc-analysis", True), ("comment-on-policy", True), ("related-work", True), ("share-of-votes", True),
    ("ad", False), ("ad-box", False), ("related-posts", False), ("share-buttons", False), ("comments-list", False),
    ("cookie-law-note", False), ("newsletter-signup", False), ("advert-of-the-day", False),
])
def test_names_inside_an_article(name, stays):
    page = f"<article><p>one</p><div class='{name}'><p>two</p></div></article>"
    assert wrappers.main_text(page, None) == ("one two" if stays else "one")
