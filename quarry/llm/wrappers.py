"""Main text of web pages through wrappers inferred per host.

A page is read as a tree of its block elements.  A wrapper is a union-free regular expression over such
trees: every element is required, optional ("?") or repeated ("+"), and holds text slots.  It starts as one
page and takes in the host's other pages one by one: the token streams of two elements' children are
aligned (longest common subsequence of labels), runs and periods of equal labels fold into repeated groups,
what only one side has becomes optional, and texts that differ turn a constant into a slot.

Each task folds its own pages into one wrapper per host; wrappers of a host then meet in salted
groups and at last in one, so that a host with a third of all pages is never in one task.  All pages
take part.  From the wrapper follows where the host keeps its articles: an element that says so
(article, main, names such as "entry-content"), or else the one whose slots -- text that differs from page to
page, outside links -- hold most of the text.  Applied to a page, that place gives the text blocks;
regions that are boilerplate by element or name (menus, headers, footers, sidebars, notices, adverts, forms,
comments) are left out, as are constants outside the article.  In an article a name decides if all of
its words say boilerplate or mere structure: "related-posts" does, "related-work" and "ad-hoc-analysis" do not.

Defined results: a null or empty html gives an empty text; a null or odd url belongs to the host "";
a page that lacks the host's place is read by its own structure; cut-off or badly nested html closes
at the end; below ``MOST_DEPTH`` levels elements only break the text into blocks (and are left out if they are
boilerplate), so that any depth can be read; a null id is kept; repeated rows are pages of their own; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import bounded_batches, materialize

SALTS = 64
#: Children of an element from which a wrapper folds those of one label, then the rarest optional ones of
#: one tag, into one; and from which also required ones.
WIDTH, MOST_WIDTH = 200, 2000
#: Levels of elements in a tree.
MOST_DEPTH = 150

# Kinds of elements, and words of class, id and role.
RAW = ("script", "style", "noscript", "template", "textarea", "title", "iframe", "object", "annotation-xml", "annotation")
FOREIGN = ("svg",)       # like those, but "/>" ends them
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rb rp rt "
                   "ruby s samp small span strike strong sub sup time tt u var nobr picture "
                   "math maction merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace "
                   "msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics none".split())
WHOLE = frozenset(("#page", "html", "body"))
BOILERPLATE_TAGS = frozenset("nav footer aside form button select option dialog menu head fieldset".split())
BOILERPLATE_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs footer sidebar aside ad ads adv advert adverts advertisement "
    "advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification "
    "alert popup modal overlay newsletter subscribe subscription signup login comment comments commentlist disqus "
    "reply replies respond discussion related recommended recommendations share sharing social widget toolbar "
    "pagination pager paging search paywall complementary contentinfo".split())
#: Words that name mere structure: beside a word of boilerplate they leave it one, in an article too.
STRUCTURE_WORDS = frozenset(
    "a area articles bar block body bottom bottombar box button buttons by card cards center col column content container "
    "desktop div element em feed fixed footer form frame grid group head header heading holder icon icons id in inline inner "
    "input item items js label large left li line link links list main message mid middle mobile module more news "
    "outer page panel panels placeholder post posts pre primary region right row rows secondary section sections "
    "site slot small space spacer sticky stories strip tab tabs text thread title top topbar ul unit us view wrap wrapper "
    "zone inarticle incontent media leaderboard skyscraper mpu rectangle native google gpt dfp label labels tools tool "
    "facebook twitter email print whatsapp linkedin pinterest buttonset cta prompt settings".split())
#: Words that make a name one of boilerplate whatever stands beside them.
SURE_WORDS = frozenset("advert adverts advertisement advertising sponsored breadcrumb breadcrumbs navbar cookie cookies gdpr "
                       "newsletter paywall pagination disqus commentlist contentinfo".split())
#: From these on, and in names that end in those, a name tells what an element has or shows, not what it is.
STATES = frozenset("has have with without no not hide show supports enable disable".split())
TOPICS = frozenset(("category", "tag"))      # the same, of an element that may hold the article
STATE_ENDS = frozenset("enabled disabled open opened closed".split())
#: Words of regions that hold texts of others, however long; names and elements that are such a region by themselves.
OTHERS_WORDS = frozenset("comment comments commentlist disqus reply replies respond discussion related recommended "
                         "recommendations".split())
REGION_NAMES = frozenset("sidebar aside footer nav navbar navigation menu".split())
REGION_TAGS = BOILERPLATE_TAGS - {"form", "fieldset"} | {"header"}
HEADER_WORDS = frozenset("header masthead topbar banner".split())
CONTENT_WORDS = ("articlebody", "entry-content", "post-content", "article-content", "article-body", "post-body",
                 "story-body", "main-content", "content", "article", "post", "story", "entry")
#: Names that a group's elements go by: boilerplate, and the ranks of places of an article.
GROUP_NAMES = {"": "", "x": "ad", "0": "", "1": "entry-content", "2": "main", "3": "content"}
CLOSED_BY = {"p": None, "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th", "tr"),
             "th": ("td", "th", "tr"), "tr": ("tr",), "option": ("option",)}

# As html reads it: a quote opens a value only behind "=", any other one is part of a name or value.
_VALUE = r"""(?>"[^"]*"|'[^']*'|[^\s>"'][^\s>]*)"""
_ATTRS = rf"(?>[\s/]++|[^\s/>=][^\s/>=]*+(?>\s*+=\s*+{_VALUE}?)?|=)*+"
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    rf"|<(?P<raw>(?:{'|'.join(RAW)})(?=[\s/>])|(?:{'|'.join(FOREIGN)})(?=[\s/>])(?!{_ATTRS}(?<=/)>)){_ATTRS}>(?:.*?</(?P=raw)\s*>|.*\Z)"
    rf"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>{_ATTRS})>|<[!?/][^>]*(?:>|\Z)"
    r"|<[a-zA-Z][^>]*(?:>|\Z)|(?P<text>[^<]+|<)", re.S | re.I)
ATTRIBUTE = re.compile(rf"([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+({_VALUE})?)?")
NAMED_BY = frozenset(("class", "id", "role", "itemprop"))


class Node:
    """An element: its label, and children that are elements or texts (with a mark for links)."""
    __slots__ = ("tag", "label", "names", "children", "dropped", "layout")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.children, names, self.dropped, self.layout = tag, [], [], False, False
        if attrs and not attrs.isspace():
            for name, value in ATTRIBUTE.findall(attrs):
                name, value = name.lower(), value.strip("\"'").lower()
                if name == "hidden" or name == "style" and re.search(r"display\s*:\s*none", value):
                    self.dropped = True
                elif name in NAMED_BY:
                    names.append(re.sub(r"[\d]+", "", value))
        self.names = " ".join(names)
        self.label = f"{tag}.{self.names}" if self.names else tag

    def words(self) -> frozenset:
        return frozenset(re.split(r"[^a-z]+", self.names))

    def meant(self) -> list[str]:
        """Names, as far as they say what the element is."""
        out = []
        states = STATES | TOPICS if rank(self) is not None else STATES
        for name in self.names.split():
            words = [w for w in re.split(r"[^a-z]+", name) if w]
            if len(words) > 1 and words[-1] in STATE_ENDS:
                continue
            out.append(" ".join(words[:next((i for i, w in enumerate(words[:-1]) if w in states), len(words))]))
        return out

    def marks(self) -> set:
        """Words that say what the element is."""
        return {w for n in self.meant() for w in n.split()}

    def region(self) -> bool:
        return self.tag in REGION_TAGS or bool(REGION_NAMES & {*self.names.split()} or OTHERS_WORDS & self.marks())

    def boilerplate(self, in_article: bool) -> bool:
        if self.tag in WHOLE:
            return False
        if self.dropped or not self.layout and self.tag in BOILERPLATE_TAGS:
            return True
        if self.layout:
            return False
        if not in_article and self.tag == "header":
            return True
        if not self.names:
            return False
        if in_article:
            return any(SURE_WORDS & words or BOILERPLATE_WORDS & words and words <= BOILERPLATE_WORDS | STRUCTURE_WORDS
                       for words in ({w for w in re.split(r"[^a-z]+", n) if w} for n in self.meant()))
        return bool(self.marks() & (BOILERPLATE_WORDS | HEADER_WORDS))


class _Open:
    """The elements that are open while a page is read."""

    def __init__(self, root: Node):
        self.path, self.tags, self.left_out = [root], Counter(), 0

    def push(self, node: Node) -> None:
        if len(self.path) < MOST_DEPTH:
            self.path[-1].children.append(node)
        else:
            self.breaks()
            self.left_out += node.boilerplate(True)
        self.path.append(node)
        self.tags[node.tag] += 1

    def pop(self) -> str:
        node = self.path.pop()
        self.tags[node.tag] -= 1
        if len(self.path) >= MOST_DEPTH:
            self.left_out -= node.boilerplate(True)
            self.breaks()
        return node.tag

    def breaks(self) -> None:
        """An empty element where one begins or ends that is too deep for the tree."""
        self.path[MOST_DEPTH - 1].children.append(Node("div"))

    def text(self, text: str, link: bool) -> None:
        if len(self.path) <= MOST_DEPTH:
            self.path[-1].children.append((text, link))
        elif not self.left_out:
            self.path[MOST_DEPTH - 1].children.append((text, link))

    def close(self, tag: str) -> bool:
        """Ends the innermost element of this tag, and what is open in it."""
        if not self.tags[tag]:
            return False
        while self.pop() != tag:
            pass
        return True

    def close_implied(self, by: tuple) -> None:
        """Ends the innermost element of one of these tags, unless a list or table is nearer."""
        if not any(self.tags[t] for t in by):
            return
        for node in reversed(self.path[1:]):
            if node.tag in by:
                self.close(node.tag)
                return
            if node.tag in ("ul", "ol", "dl", "table", "tbody", "select"):
                return


def parse(page: str) -> Node:
    """The tree of block elements.  Inline elements leave only their text; links are marked."""
    root = Node("#page")
    now, link = _Open(root), 0
    for m in TOKEN.finditer(page):
        if m["text"] is not None:
            now.text(m["text"], link > 0)
            continue
        if m["tag"] is None:
            if m["raw"]:
                now.text(" ", False)
            continue
        tag = m["tag"].lower()
        if tag in VOID or tag in FOREIGN:
            if tag in ("br", "hr"):
                now.text(" ", False)
            continue
        if tag in INLINE:
            if tag == "a":
                link = max(0, link + (-1 if m["end"] else 1))
            continue
        if m["end"]:
            if now.close(tag):
                link = 0
            continue
        if now.path[-1].tag == "p":         # a block ends a paragraph
            now.pop()
            link = 0
        if CLOSED_BY.get(tag):
            now.close_implied(CLOSED_BY[tag])
        node = Node(tag, m["attrs"])
        now.push(node)
        if (m["attrs"] or "").rstrip().endswith("/"):
            now.pop()
    return root


def blocks(node: Node, in_article: bool = True):
    """Text blocks in page order, boilerplate left out."""
    run: list[str] = []
    for c in node.children:
        if isinstance(c, tuple):
            run.append(c[0])
            continue
        if run:
            yield " ".join(entities.unescape("".join(run)).split())
            run = []
        if not c.boilerplate(in_article):
            yield from blocks(c, in_article)
    if run:
        yield " ".join(entities.unescape("".join(run)).split())


def text_of(nodes: list[Node]) -> str:
    return " ".join(b for n in nodes for b in blocks(n, n.tag not in WHOLE) if b)


def rank(node: Node) -> int | None:
    """How surely an element says that it holds the article: 0 is surest."""
    if node.tag == "article":
        return 0
    if node.tag == "main" or "main" in node.words():
        return 2
    names = {*node.names.split(), *node.names.replace("_", "-").split()}
    named = [i for i, c in enumerate(CONTENT_WORDS) if c in names]
    return None if not named else 1 if named[0] < 8 else 3


def kind(node: Node) -> str:
    """What a group keeps apart."""
    if node.boilerplate(False):
        return "x"
    return "" if (r := rank(node)) is None else str(r)


# -- wrappers: [label, tag, names, required, repeated, pages, chars, link chars, constant, children] ---------

LABEL, TAG, NAMES_AT, REQUIRED, REPEATED, PAGES, CHARS, LINKS, CONSTANT, CHILDREN = range(10)


def skeleton(node: Node) -> list:
    """A page's tree as the wrapper of this one page."""
    texts = [c for c in node.children if isinstance(c, tuple) and not c[0].isspace()]
    whole = " ".join("".join(t for t, _ in texts).split())
    return [node.label, node.tag, node.names, True, False, 1, sum(len(t) for t, _ in texts),
            sum(len(t) for t, a in texts if a), whole if len(whole) <= 200 else f"{len(whole)} {xxhash.xxh3_128_hexdigest(whole)}",
            fold([skeleton(c) for c in node.children if isinstance(c, Node)])]


def fold(children: list) -> list:
    """Runs of one label, then periods of up to four labels, become repeated elements or groups."""
    out: list = []
    for c in children:
        if out and out[-1][LABEL] == c[LABEL]:
            out[-1] = merge(out[-1], c)
            out[-1][REPEATED] = True
        else:
            out.append(c)
    for period in (2, 3, 4):
        i = 0
        while i + 2 * period <= len(out):
            now, then = out[i:i + period], out[i + period:i + 2 * period]
            if [c[LABEL] for c in now] == [c[LABEL] for c in then]:
                out[i:i + 2 * period] = [repeated(merge(a, b)) for a, b in zip(now, then)]
            else:
                i += 1
    return narrow(out)


def repeated(node: list) -> list:
    node[REPEATED] = True
    return node


def merge(a: list, b: list) -> list:
    """The wrapper of what either one matches."""
    return [a[LABEL], a[TAG], a[NAMES_AT], a[REQUIRED] and b[REQUIRED], a[REPEATED] or b[REPEATED],
            a[PAGES] + b[PAGES], a[CHARS] + b[CHARS], a[LINKS] + b[LINKS],
            a[CONSTANT] if a[CONSTANT] == b[CONSTANT] else None, align(a[CHILDREN], b[CHILDREN])]


def optional(node: list) -> list:
    node[REQUIRED] = False
    return node


def align(a: list, b: list) -> list:
    """Children aligned on their labels; what has no partner becomes optional."""
    x, y = [c[LABEL] for c in a], [c[LABEL] for c in b]
    if x == y:
        return [merge(p, q) for p, q in zip(a, b)]
    out, i, j = [], 0, 0
    for block in SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks():
        out += [optional(c) for c in a[i:block.a]] + [optional(c) for c in b[j:block.b]]
        out += [merge(p, q) for p, q in zip(a[block.a:block.a + block.size], b[block.b:block.b + block.size])]
        i, j = block.a + block.size, block.b + block.size
    return narrow(out)


def grouped(w: list) -> list:
    """An element as one of a group, which has a tag and a kind; no element's own label starts with "*"."""
    k = kind(_as_node(w))
    return [f"*{w[TAG]}.{k}", w[TAG], GROUP_NAMES[k], False, True, *w[PAGES:]]


def by_label(children: list) -> list:
    """One repeated child for those of one label, where the first of them stands."""
    first: dict[str, list] = {}
    for c in children:
        if (had := first.get(c[LABEL])) is not None:
            required = had[REQUIRED] or c[REQUIRED]
            c = repeated(merge(had, c))
            c[REQUIRED] = required
        first[c[LABEL]] = c
    return list(first.values())


def narrow(children: list) -> list:
    """Many children become fewer; none is dropped."""
    if len(children) <= WIDTH:
        return children
    out = by_label(children)
    rare = sorted(c[PAGES] for c in out if not c[REQUIRED] and c[LABEL][0] != "*")
    if len(out) > WIDTH and rare:
        most = rare[min(len(out) - WIDTH // 2, len(rare)) - 1]
        out = by_label([grouped(c) if not c[REQUIRED] and c[PAGES] <= most else c for c in out])
    return out if len(out) <= MOST_WIDTH else by_label([grouped(c) for c in out])


def _as_node(w: list) -> Node:
    n = Node(w[TAG])
    n.names, n.label = w[NAMES_AT], w[LABEL]
    return n


def own_chars(w: list, pages: int) -> int:
    return max(0 if w[CONSTANT] and pages > 2 and w[PAGES] >= pages else w[CHARS] - 2 * w[LINKS], 0)


def slot_chars(w: list, pages: int, in_article: bool = False, layout: frozenset = frozenset()) -> float:
    """Characters in the slots of a wrapper's element, less those in links; a text that is the same on
    several pages is no slot.  ``layout``: ids of elements that are no boilerplate whatever they are called."""
    if id(w) not in layout and _as_node(w).boilerplate(in_article):
        return 0.0
    return own_chars(w, pages) + sum(slot_chars(c, pages, in_article, layout) for c in w[CHILDREN])


def step(w: list, beside: list):
    return w[LABEL] if w[LABEL][0] != "*" else [w[LABEL], *(c[LABEL] for c in beside if c is not w)]


def layouts(wrapper: list) -> list[tuple[list, list]]:
    """(path, element) of elements that go by a name or tag of boilerplate, but hold most of the text: what
    the pages are laid out in.  Regions of other texts are none, nor do they count."""
    pages, out = max(wrapper[PAGES], 1), []

    def chars(w):
        return 0 if _as_node(w).region() else own_chars(w, pages) + sum(map(chars, w[CHILDREN]))

    least = chars(wrapper) / 2

    def walk(w, path, beside):
        if chars(w) <= least:
            return
        path = [*path, step(w, beside)]
        if _as_node(w).boilerplate(False):
            out.append((path, w))
        for c in w[CHILDREN]:
            walk(c, path, w[CHILDREN])

    walk(wrapper, [], [])
    return out


def article_place(wrapper: list) -> list:
    """Labels from the page's root to the element that holds the article; for a group, a list of its label
    and those beside it."""
    pages = max(wrapper[PAGES], 1)
    layout = frozenset(id(w) for _, w in layouts(wrapper))
    found: list[tuple] = []
    inside: list[tuple] = []        # places below boilerplate, but one for a page and not among others' texts

    def walk(w, path, beside, places):
        node = _as_node(w)
        if id(w) not in layout and node.boilerplate(False):
            if rank(node) is not None or OTHERS_WORDS & node.marks():
                return
            places = inside
        if places is inside and w[REPEATED]:
            return
        path = [*path, step(w, beside)]
        if (r := rank(node)) is not None:
            places.append((r, -slot_chars(w, pages, True, layout), len(path), path))
        for c in w[CHILDREN]:
            walk(c, path, w[CHILDREN], places)

    walk(wrapper, [], [], found)
    # of the best kind, the one with most text
    first = lambda places: min((f for f in places if f[1] < 0), default=None, key=lambda f: (*f[:3], [str(p) for p in f[3]]))
    best, below = first(found), first(inside)
    # an element with a better place, and more text in it than there is outside, is no boilerplate
    if below and (not best or below[0] < best[0]) and -below[1] > slot_chars(wrapper, pages, False, layout):
        return below[3]
    if best:
        return best[3]
    path, now = [wrapper[LABEL]], wrapper
    while True:
        each = [(slot_chars(c, pages, False, layout), i) for i, c in enumerate(now[CHILDREN])]
        total = slot_chars(now, pages, False, layout)
        if not each or max(each)[0] < 0.7 * max(total, 1) or not now[CHILDREN][max(each)[1]][CHILDREN]:
            return path
        now = now[CHILDREN][max(each)[1]]
        if now[LABEL][0] == "*":        # boxes with names of their own: the text is in what holds them
            return path
        path.append(now[LABEL])


def at_place(root: Node, path: list) -> list[Node]:
    """Elements of a page at a place."""
    now = [root]
    for label in path[1:]:
        inner = [c for n in now for c in n.children if isinstance(c, Node)]
        if isinstance(label, str):
            now = [c for c in inner if c.label == label]
        else:
            now = [c for c in inner if c.label not in label and label[0] == f"*{c.tag}.{kind(c)}"]
    return now


def read(root: Node, place: list, laid_out: list[list]) -> str:
    nodes = at_place(root, place)
    for n in [n for path in laid_out for n in at_place(root, path)]:
        n.layout = True
    return text_of(nodes)


def main_text(page: str | None, place: list | None, laid_out: list[list] = ()) -> str:
    root = parse(page or "")
    text = read(root, place, laid_out) if place else ""
    if not text:
        own = skeleton(root)
        text = read(root, article_place(own), [path for path, _ in layouts(own)])
    return text


def host_of(url):
    """Spark column: the host of a url, lower case, without user and port."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper) of a table (host, html); wrappers as JSON."""

    def task(batches):
        held: dict[str, list] = {}
        for batch in batches:
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = skeleton(parse(page or ""))
                held[host] = merge(held[host], own) if host in held else own
        salt = TaskContext.get().partitionId() % SALTS
        yield pa.RecordBatch.from_pydict({"host": list(held), "salt": [salt] * len(held),
                                          "wrapper": [json.dumps(w) for w in held.values()]}, schema=pa.schema([
                                              ("host", pa.string()), ("salt", pa.int32()), ("wrapper", pa.string())]))

    def together(group: pd.DataFrame) -> pd.DataFrame:
        whole = None
        for w in sorted(group["wrapper"]):
            whole = json.loads(w) if whole is None else merge(whole, json.loads(w))
        first = group.iloc[:1].copy()
        first["wrapper"] = json.dumps(whole)
        return first

    each = pages.mapInArrow(task, "host string, salt int, wrapper string")
    some = each.groupBy("host", "salt").applyInPandas(together, "host string, salt int, wrapper string")
    return some.groupBy("host").applyInPandas(together, "host string, salt int, wrapper string").select("host", "wrapper")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text of every row."""
    bounded_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"),
                        F.col(html_col).alias("html"))

    def places(batches):
        for batch in batches:
            hosts = map(json.loads, batch.column(1).to_pylist())
            found = [json.dumps([article_place(w), [path for path, _ in layouts(w)]]) for w in hosts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, type=pa.string())], names=["p_host", "place"])

    # a host's wrapper is needed once: what goes on is the place of its articles
    place = infer_wrappers(rows.select("host", "html")).mapInArrow(places, "p_host string, place string")
    place = materialize(place, "llm-places")

    def run(batches):
        for batch in batches:
            texts = [main_text(h, *json.loads(p) if p else [None])
                     for h, p in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, type=pa.string())],
                                             names=["page_id", "url", "text"])

    both = rows.join(place, F.col("host") == F.col("p_host"), "left").select("page_id", "url", "html", "place")
    return both.mapInArrow(run, f"page_id {rows.dtypes[0][1]}, url string, text string")
