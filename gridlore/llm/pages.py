"""Main text of web pages, with site templates found by counting subtrees.

A page is parsed into elements; each gets a hash of its tag, its class, its text and its children's hashes.
Spark counts how many distinct pages of a host hold each hash (one row a page and hash; equal html is one page).
Subtrees that recur on many pages of the host, and elements that are boilerplate by tag, role or name, are
deleted; the rest of the article is the text. Inside an article or main element only containers such as div and
section are counted: paragraphs, headings and text-level elements are its content, and a sentence that many
articles share stays. A container that holds most of the article's text, or of a page's articles, is not
template however often it recurs.

Where text differs from page to page, as in reader comments and adverts, it is the *shape* that recurs: the tag, the names without
their digits and the set of the children's tags and names, without any text. Shapes are counted by host with the subtrees. A
recurring shape alone says nothing (every article's body has one); in an article, or in a page without one, it goes
if what it holds tells: short dated marks at its start or many of them, after the article's text is over (comments); links
for most of its text, there or under a name of boilerplate (lists of stories, social links); or such a name and hardly any paragraphs
(adverts). What holds most of the text is spared unless it is dated so.

Names alone count only as a whole: share-buttons is boilerplate, share-price, side-by-side and notice-period are not. Nothing else
is left out: formulas, captions, fallback texts and hidden elements are text, and so is every main element. A form
around an article, or around most of a page's paragraphs where it has no article, is no form of the reader's.

Character references are decoded, white space in a block becomes one space, blocks are trimmed and joined by
one line end. A null html is an empty page with empty text. Null or odd urls share one host. Null ids and
repeated rows are kept (those of equal html count as one page); pages of any length and depth are parsed whole,
in time proportional to their length and without recursion; an empty table gives an empty result; other columns are ignored.
Ties do not arise: a share on a limit counts as reached.
"""

from __future__ import annotations

import hashlib
import html
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlore.llm import common

LEAST_PAGES, SHARE = 5, 0.1

# HTML's elements by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes title textarea".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody tfoot thead tr ul".split())
GONE = frozenset("head script style iframe noembed noframes template title textarea nav footer aside form button select menu search".split())
CONTAINERS = frozenset("aside center details dialog div fieldset footer form header menu nav search section".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form status".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsored sponsor promo promotion banner breadcrumb breadcrumbs comment comments disqus cookie cookies consent gdpr notice notices alert "
    "footer foot header masthead menu nav navbar navigation newsletter subscribe signup paywall popup modal overlay related recommended share sharing social sidebar side toolbar widget widgets pagination pager skip "
    "commentlist replies reply adsbygoogle".split()
)
#: Words that do not change what a name of the above says: nav-main, site-footer, ad-slot-2.
PLAIN = frozenset(
    "site page main top bottom left right center middle inner outer wrapper wrap container content area slot unit box bar block list item items link links section panel group row col column "
    "primary secondary global mobile desktop small large wide fixed sticky button buttons form post posts article articles title text js id the of and my "
    "user users reader readers thread threads respond fb facebook placeholder law info story stories icon icons".split()
)
HEADS = frozenset("head header masthead".split())
#: Beginnings of words in names that, with other signs, tell boilerplate; share, side, notice and the like mean too much else.
HINTS = ("ads", "advert", "sponsor", "promo", "comment", "disqus", "cookie", "consent", "newsletter", "related", "recommend", "social", "breadcrumb", "sidebar", "subscribe")
#: Elements whose shapes are counted, if they have a name.
SHAPED = CONTAINERS | frozenset("ul ol li ins article".split())
DATE = re.compile(r"\b(?:\d{4}-\d{1,2}-\d{1,2}|\d{1,2}[./]\d{1,2}[./]\d{2,4}|\d{1,2}:\d{2}|(?:\d+|an?|one) (?:second|minute|hour|day|week|month|year)s? ago|(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.? \d{1,2})\b", re.I)
#: A dated mark is at most so long, and stands at most so far into a comment; comments come after this share of the text.
MARK, START, LATE = 80, 120, 0.8
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "body": {"head"}}
HOLDS = frozenset("table ul ol dl select body html article main section div button".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+>|[^>]*(?:>|\Z))", re.S)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
SPLIT = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])|(?<=[A-Za-z])(?=[0-9])")


def named(label: str) -> set[str]:
    """The names of boilerplate in a class or id, if it holds nothing else: share-buttons, but not share-price or side-by-side."""
    parts = {w.lower() for w in SPLIT.split(label) if w and not w.isdigit()}
    known = {label.lower()} & NAMES or parts & NAMES
    return known if known and (label.lower() in NAMES or parts <= NAMES | PLAIN) else set()


def plain(name: str) -> str:
    """A name without its digits: comment-17 is like comment-18."""
    return re.sub("[0-9]+", "", name)


class Element:
    """`own` is the tag, and `tag` what it stands for; `measure` sets `size`, `held`, `prose`, `linked`, `marks` and `first`."""

    __slots__ = ("tag", "own", "drop", "head", "name", "children", "hash", "shape", "inside", "size", "held", "prose", "linked", "marks", "first")

    def __init__(self, tag: str, attributes: str, inside: bool):
        self.tag = self.own = tag
        self.name, self.children, self.hash, self.shape, self.size, self.held, self.prose, self.linked, self.marks, self.first = "", [], 0, 0, 0, 0, 0, 0, 0, 0
        self.drop, self.head = tag in GONE, tag == "header"
        self.inside = inside or tag in ("article", "main")
        if len(attributes) > 1:
            found = {k.lower(): html.unescape(a or b or c or "") for k, a, b, c in ATTRIBUTE.findall(attributes)}
            labels = f"{found.get('class', '')} {found.get('id', '')}".split()
            self.name = " ".join(labels).lower()
            if tag not in ("html", "body", "main"):
                words = set().union(*map(named, labels))
                if self.inside and words and words <= HEADS:  # an article's own header keeps its headings
                    self.head, words = True, set()
                if tag == "article":
                    words &= {"comment", "comments", "reply"}
                self.drop |= found.get("role", "").lower() in ROLES or bool(words)
            if found.get("role", "").lower() == "main":
                self.tag, self.inside = "main", True

    def close(self) -> None:
        own = hashlib.blake2b(f"{self.tag}\0{self.name}".encode(errors="replace"), digest_size=8)
        for child in self.children:
            own.update(b"\1" + child.hash.to_bytes(8) if isinstance(child, Element) else b"\2" + " ".join(child.split()).encode(errors="replace"))
        self.hash = int.from_bytes(own.digest())
        if self.name and self.own in SHAPED:
            kinds = sorted({f"{c.own}.{plain(c.name)}" for c in self.elements()})
            self.shape = int.from_bytes(hashlib.blake2b("\2".join([self.own, plain(self.name), *kinds]).encode(errors="replace"), digest_size=8, person=b"shape").digest())

    def elements(self) -> list[Element]:
        return [c for c in self.children if isinstance(c, Element)]


class Open:
    """The open elements, with the depths of each tag and of those that hold others, so that no search walks the stack."""

    def __init__(self, root: Element):
        self.stack, self.depths, self.holds = [root], {root.own: [0]}, [0]

    def push(self, e: Element) -> None:
        self.depths.setdefault(e.own, []).append(len(self.stack))
        if e.own in HOLDS:
            self.holds.append(len(self.stack))
        self.stack.append(e)

    def pop_to(self, depth: int) -> None:
        while len(self.stack) > depth:
            e = self.stack.pop()
            self.depths[e.own].pop()
            if e.own in HOLDS:
                self.holds.pop()
            e.close()

    def last(self, tag: str) -> int:
        """Depth of the innermost open element of that tag; 0 if there is none."""
        at = self.depths.get(tag)
        return at[-1] if at else 0


def parse(page: str) -> Element:
    root = Element("html", "", False)
    open_, at, size = Open(root), 0, len(page)
    stack = open_.stack
    while at < size:
        m = TOKEN.search(page, at)
        upto = m.start() if m else size
        if upto > at:
            stack[-1].children.append(html.unescape(page[at:upto]))
        if not m:
            break
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                stack[-1].children.append(m[0][9:].removesuffix("]]>"))
            continue
        tag = m[2].lower()
        if m[1]:
            depth = open_.last(tag)
            if depth and (tag in BLOCK or depth >= open_.holds[-1]):  # a stray inline end tag ends nothing
                open_.pop_to(depth)
            if tag == "br":
                stack[-1].children.append(" ")
            continue
        if tag == "html":
            continue
        depth = max(map(open_.last, CLOSES.get(tag, ())), default=0)
        if tag in BLOCK:
            depth = max(depth, open_.last("p"))
        if depth and depth >= open_.holds[-1]:
            open_.pop_to(depth)
        new = Element(tag, m[3], stack[-1].inside)
        stack[-1].children.append(new)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])|\Z", re.I).search(page, at).start()
            if tag == "xmp":
                new.children.append(page[at:end])
            at = end if end < size else size
            new.close()
            close = page.find(">", at)
            at = size if close < 0 else close + 1
        elif tag not in VOID:
            open_.push(new)
        else:
            new.close()
    open_.pop_to(0)
    return root


def measure(root: Element) -> None:
    """Set on every element the text below it that is not dropped, what of it stands in articles, paragraphs and links,
    how many short dated marks there are, and how far into it the first is."""
    order, todo = [], [root]
    while todo:
        e = todo.pop()
        order.append(e)
        todo += e.elements()
    for e in reversed(order):
        e.size = e.held = e.prose = e.linked = e.marks = e.first = 0
        if e.drop:
            continue
        own = []
        for c in e.children:
            if isinstance(c, Element):
                if c.marks and not e.marks:
                    e.first = e.size + c.first
                e.size, e.held, e.prose, e.linked, e.marks = e.size + c.size, e.held + c.held, e.prose + c.prose, e.linked + c.linked, e.marks + c.marks
            else:
                own.append(c)
                e.size += len(" ".join(c.split()))
        if e.tag in ("article", "main"):
            e.held = e.size
        if e.tag == "p":
            e.prose = e.size
        if e.tag == "a":
            e.linked = e.size
        if not e.marks and 0 < e.size <= MARK and (e.tag == "time" or DATE.search(" ".join(own))):
            e.marks = 1


def unwrap(root: Element) -> None:
    """Measure the page, and keep forms that wrap its article, or most of its paragraphs where it has no article."""
    forms, todo = [], [root]
    while todo:
        e = todo.pop()
        if e.own == "form" and e.drop:
            e.drop = False
            forms.append(e)
        todo += e.elements()
    measure(root)
    shut = [e for e in forms if not e.held and (root.held or 2 * e.prose <= root.prose)]
    for e in shut:
        e.drop = True
    if shut:
        measure(root)


def counted(e: Element) -> bool:
    """Whether an element may be template: anything outside an article or main, and containers inside."""
    return e.tag not in ("html", "body", "main", "article") and (not e.inside or e.tag in CONTAINERS)


def subtrees(root: Element) -> set[int]:
    """Hashes that count towards the site's template."""
    out, todo = set(), [root]
    while todo:
        e = todo.pop()
        if e.tag in ("script", "style", "head"):
            continue
        if e.children and counted(e):
            out.add(e.hash)
        if e.shape:
            out.add(e.shape)
        todo += e.elements()
    return out


def hinted(name: str) -> bool:
    return any(w.lower() in NAMES or w.lower().startswith(HINTS) for w in SPLIT.split(name) if w)


def telling(e: Element, done: int, whole: int) -> bool:
    """Whether an element whose shape recurs is boilerplate, `done` of the `whole` text having come before it."""
    late = done > 0 and done >= LATE * (whole - e.size)
    if late and e.marks and (e.first <= START or e.marks > 1):
        return True
    if 2 * e.size > whole or not e.size:
        return False
    name = hinted(e.name)
    return 2 * e.linked >= e.size and (late or name) or name and 2 * e.prose < e.size


def spared(root: Element, template: set[int]) -> set[int]:
    """Elements (by id) that recur but hold most of an article's text, with all in them, or of the page's articles."""
    out, todo = set(), [(root, 0, False)] if template and root.held else []
    while todo:
        e, own, free = todo.pop()
        if e.drop:
            continue
        if free:
            out.add(id(e))
        elif e.tag in ("article", "main"):
            own = e.size
        elif e.hash in template and counted(e):
            if e.inside:
                if 2 * e.size <= own:
                    continue
                free = True
            elif 2 * e.held <= root.held:
                continue
            out.add(id(e))
        todo += [(c, own, free) for c in e.elements()]
    return out


def headings(e: Element) -> list[Element]:
    out, todo = [], [e]
    while todo:
        x = todo.pop()
        if x.tag in HEADINGS:
            out.append(x)
        elif x is e or not x.drop:
            todo += reversed(x.elements())
    return out


def main_text(root: Element, template: set[int]) -> str:
    unwrap(root)
    found = {"article": [], "main": []}
    todo: list = [(root, False)]
    kept = spared(root, template)
    gone = lambda e: e.drop or e.hash in template and counted(e) and id(e) not in kept
    while todo:
        e, within = todo.pop()
        if gone(e):
            continue
        if e.tag in found and not (within and e.tag == "main"):  # a main in a main is part of it
            found[e.tag].append(e)
        if e.tag != "article":
            todo += [(c, within or e.tag == "main") for c in reversed(e.elements())]
    starts = found["article"] or found["main"] or [root]

    def blocks_of(whole: int) -> tuple[list[str], int]:
        """Blocks, and how much text went by its shape."""
        blocks, now, done, less = [], [], 0, 0

        def flush() -> None:
            if text := " ".join("".join(now).split()):
                blocks.append(text)
            now.clear()

        for start in starts:
            walk: list = [start]
            while walk:
                e = walk.pop()
                if isinstance(e, str):
                    now.append(e)
                    done += len(" ".join(e.split()))
                elif e is None:
                    flush()
                elif gone(e):
                    continue
                elif e.shape in template and e is not start and telling(e, done, whole):
                    less += e.size
                else:
                    children = e.children
                    if e.head and (e.own == "header" or not e.prose):
                        children = headings(e) if e.inside else []
                    if e.tag in BLOCK:
                        flush()
                        walk.append(None)
                    elif e.tag in ("br", "td", "th"):
                        now.append(" ")
                    walk += reversed(children)
            flush()
        return blocks, less

    whole = sum(e.size for e in starts)
    blocks, less = blocks_of(whole)
    if less:  # what goes is no part of the text that comments and lists of links come after
        blocks, _ = blocks_of(whole - less)
    return "\n".join(blocks)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))


def templates(pages: DataFrame, tables: common.Tables, least: int = LEAST_PAGES, share: float = SHARE) -> DataFrame:
    """__host and the hashes of its template: in `least` distinct pages at least and in that share of them.

    A page has a bounded number of subtrees, so a host has at most that number over `share` of them."""

    def work(hosts: list, htmls: list, prints: list) -> list:
        rows = [(h, x, p) for h, page, p in zip(hosts, htmls, prints, strict=True) for x in ([None, *sorted(subtrees(parse(page)))] if page else [None])]
        return [[r[0] for r in rows], [None if r[1] is None else r[1] - 2**63 for r in rows], [r[2] for r in rows]]

    rows = pages.select(host(F.col("url")).alias("h"), "html", F.xxhash64("html").alias("print"))
    each = common.map_columns(rows, "h string, hash long, print long", lambda: work, rows=200).distinct()
    counts = tables(each.groupBy("h", "hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("hash").isNull() | (F.col("n") >= least)), "subtrees")
    sizes = counts.where("hash is null").select(F.col("h").alias("__h"), F.col("n").alias("total"))
    often = common.look_up(counts.where("hash is not null"), tables(sizes, "sizes"), "h", "__h", ["hash"]).where(F.col("n") >= F.col("total") * share)
    return often.groupBy(F.col("h").alias("__host")).agg(F.collect_list("hash").alias("__template"))


def extract(pages: DataFrame, least: int = LEAST_PAGES, share: float = SHARE) -> DataFrame:
    """page_id, url, text, n_chars. A host's template is bounded, and hosts are looked up without gathering a host's pages."""
    tables = common.Tables()
    sites = tables(templates(pages, tables, least, share), "templates")
    tables.drop_but(sites)
    rows = common.look_up(pages.select("page_id", "url", "html", host(F.col("url")).alias("__h")), sites, "__h", "__host", ["page_id", "html"], "left").select("page_id", "url", "html", "__template")

    def work(ids: list, urls: list, htmls: list, known: list) -> list:
        texts = [main_text(parse(page), {x + 2**63 for x in t or ()}) if page else "" for page, t in zip(htmls, known, strict=True)]
        return [ids, urls, texts, [len(t) for t in texts]]

    return common.map_columns(rows, "page_id long, url string, text string, n_chars long", lambda: work, rows=200)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(common.table(spark, sf_dir, "pages"))
