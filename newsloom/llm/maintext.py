"""Main text of web pages by tree scoring.

A page is parsed into a tree of block elements (unclosed and crossed tags are tolerated). Parts that are
never article text (menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, comments of
readers) are left out by tag, role, or a word of class or id; in an <article> or <main> all words of a name must say so, and words that articles use too (legal, header, related ...)
count only where all of the name says so, as in site-header but not in article-header. Every run of text in a block is a
paragraph and passes points for its length and commas to its ancestors: all to the container, half to the next, a third
of a share to those above, but `SEMANTIC` shares to an <article> or <main>, however far up. A container's score is
discounted by the share of its text that is links. The container of the highest score, of equals the inner one, stands for
the article, and siblings that are headings, linkless blocks, or score at least a fifth of it are kept with it.

Defined results: null, empty and markup-only pages give the empty text; repeated rows give a row each;
an empty table gives an empty result; pages may be of any length; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import read, texts_of

# HTML element names by their part in a page, and words of class, id and role that mark boilerplate.
RAW = frozenset("script style noscript template iframe svg math textarea title select object audio video canvas xmp noembed noframes".split())
DROPPED = frozenset("nav footer aside form button input label fieldset dialog menu head header".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q s samp small span strike strong sub sup time tt u var wbr br img ruby rt rp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADS = frozenset("h1 h2 h3 h4 h5 h6".split())
LEAVES = HEADS | frozenset("p pre blockquote li dd dt td th figcaption caption address".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}
PARAGRAPH = {"p"}
#: Elements whose content is text up to their end tag, which `/>` does not replace.
LITERAL = frozenset("script style title textarea xmp iframe noembed noframes".split())
FENCE = frozenset("ul ol dl table article section div main body td th blockquote figure".split())
BAD_WORDS = frozenset(
    "nav navbar navigation menu menubar masthead topbar footer sidebar cookie cookies consent gdpr"
    " ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion comment comments commentlist disqus"
    " share sharing recommended newsletter subscribe subscription signup login popup modal overlay breadcrumb breadcrumbs pagination"
    " pager widget toolbar outbrain taboola".split()
)
#: Words that mark boilerplate only with each other and with words of layout, not beside any other word.
SOFT_WORDS = frozenset("header foot side aside rail notice notices banner alert alerts respond replies social related skip copyright legal".split())
PLAIN_WORDS = frozenset(
    "site page top bottom main global inner outer wrapper wrap container box bar block area section region panel list item items link links icon icons"
    " button buttons group row col column left right primary secondary sub mini fixed sticky mobile desktop js to and".split()
)
#: Words that are plain beside those of BAD_WORDS only.
OF_ARTICLES = frozenset("article articles post posts entry story content body text single blog news user users reader readers inline in form count title head label slot unit".split())
#: Words that are plain beside related only.
RELATED = frozenset("related content contents articles posts stories reading news topics pages more".split())
#: A paragraph's points are divided by so much for its container, the next, and so on; those FAR up get the last share.
SHARES = (1, 2, 6, 9, 12)
FAR = len(SHARES) - 1
#: Shares of a paragraph's points that semantic elements get.
SEMANTIC = {"article": 1.05, "main": 0.6}
BAD_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())

TOKEN = re.compile(
    r"<!--(?:.*?-->|.*)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*>|[^>]*$)|<[!?/][^>]*>?", re.S
)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
#: Class names that tell of a page's layout, not of the part that they stand on.
LAYOUT = re.compile(r"(?i)^(?:has|with|no|without|is|js|left|right|two|one|full)[-_]|[-_](?:layout|page|template|theme|enabled|wrapper|container|grid)$")
SPLIT = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")


class Node:
    __slots__ = ("tag", "up", "depth", "kids", "text", "linked", "near", "score", "drop")

    def __init__(self, tag, up, drop=False):
        self.tag, self.up, self.drop, self.depth = tag, up, drop, 0 if up is None else up.depth + 1
        self.kids, self.text, self.linked, self.near, self.score = [], 0, 0, None, 0.0


class Open:
    """The elements that are open at a place of a page, found by tag without a climb.

    A closable element (p, li, a heading ...) is open at most once since the last fence, as the next of its kind closes it.
    """

    def __init__(self, root: Node):
        self.path, self.by_tag, self.fences = [root], {}, []

    @property
    def here(self) -> Node:
        return self.path[-1]

    def push(self, node: Node) -> None:
        self.path.append(node)
        self.by_tag.setdefault(node.tag, []).append(node)
        if node.tag in FENCE:
            self.fences.append(node)

    def leave(self, node: Node) -> None:
        """Close node and all in it; the root stays open."""
        while len(self.path) > max(node.depth, 1):
            last = self.path.pop()
            self.by_tag[last.tag].pop()
            if last.tag in FENCE:
                self.fences.pop()

    def nearest(self, tag: str) -> Node | None:
        return some[-1] if (some := self.by_tag.get(tag)) else None

    def end(self, tag: str) -> None:
        """An end tag: a leaf's does not reach over a fence."""
        node = self.nearest(tag)
        if node is not None and not (tag in LEAVES and self.fences and self.fences[-1].depth > node.depth):
            self.leave(node)

    def start(self, tag: str) -> None:
        """A start tag closes what cannot hold it, up to the last fence."""
        fence = self.fences[-1] if self.fences else None
        ends = CLOSES.get(tag, PARAGRAPH)
        over = [node for t in (ends | HEADS if tag in HEADS or tag == "p" else ends) if (node := self.nearest(t)) is not None and (fence is None or node.depth > fence.depth)]
        if over:
            self.leave(min(over, key=lambda node: node.depth))
        if fence is not None and fence.tag in ends and fence.tag in ("td", "th"):
            self.leave(fence)


def unwanted(tag: str, attributes: str, in_article: bool, classes: bool = True) -> bool:
    if tag in DROPPED and not (tag == "header" and in_article) and (classes or tag not in ("form", "fieldset")):
        return True
    if len(attributes) < 3:
        return False
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
        if name == "role" and value.lower() in BAD_ROLES:
            return True
        if classes and name in ("class", "id") and tag not in ("html", "body", "main"):
            if any(marks_boilerplate([w.lower() for w in SPLIT.split(part) if w], in_article) for part in value.split() if not LAYOUT.search(part)):
                return True
    return False


def marks_boilerplate(words: list[str], in_article: bool = False) -> bool:
    """Whether the words of one class name or id mark boilerplate; in an article all of them must say so, as in post-comments, but not in ad-free."""
    bad = not BAD_WORDS.isdisjoint(words)
    if bad and not in_article:
        return True
    if not bad and SOFT_WORDS.isdisjoint(words):
        return False
    plain = (RELATED if "related" in words else frozenset()) | (OF_ARTICLES if bad else frozenset())
    return all(w in BAD_WORDS or w in SOFT_WORDS or w in PLAIN_WORDS or w in plain or len(w) == 1 or w.isdigit() for w in words)


def parse(html: str, classes: bool = True) -> Node:
    root = Node("html", None)
    opened = Open(root)
    buffer: list[str] = []
    link, at, linked = 0, 0, 0
    inlines, within = [], Counter()  # open inline elements from an unwanted one on, and how many of each tag

    def flush():
        nonlocal linked
        if buffer:
            text = " ".join(unescape("".join(buffer)).split())
            buffer.clear()
            if text and not opened.here.drop:
                opened.here.kids.append((text, min(linked, len(text))))
        linked = 0

    n = len(html)
    while at < n:
        m = TOKEN.search(html, at)
        if not m:
            buffer.append(html[at:])
            break
        if m.start() > at:
            buffer.append(html[at : m.start()])
            if link:
                linked += m.start() - at
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if tag in INLINE:
            if tag == "a":
                link = 0 if m[1] else 1
            elif tag == "br":
                buffer.append(" ")
            if not m[1] and tag not in VOID:
                if inlines or len(m[3]) > 3 and unwanted(tag, m[3], bool(opened.nearest("article") or opened.nearest("main")), classes):
                    inlines.append(tag)
                    within[tag] += 1
                    if len(inlines) == 1:
                        kept = len(buffer)
            elif inlines and m[1] and within[tag]:
                while (last := inlines.pop()) != tag:
                    within[last] -= 1
                within[tag] -= 1
                if not inlines:
                    del buffer[kept:]
            continue
        if inlines:
            del buffer[kept:]
            inlines.clear()
            within.clear()
        flush()
        link = 0
        if m[1]:
            opened.end(tag)
            continue
        if tag in RAW:
            if not m[3].endswith("/>") or tag in LITERAL:
                end = ends_of(tag).search(html, at)
                at = end.end() if end else n
            continue
        if tag in ("html", "body") and opened.here is root:
            continue
        opened.start(tag)
        if tag in VOID:
            continue
        if tag in ("body", "main") and opened.here.drop:  # an unclosed <head> ends here
            opened.leave(root)
        here = opened.here
        inside = bool(opened.nearest("article") or opened.nearest("main"))
        node = Node(tag, here, here.drop or unwanted(tag, m[3], inside, classes))
        here.kids.append(node)
        opened.push(node)
    if inlines:
        del buffer[kept:]
    flush()
    return root


@cache
def ends_of(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}\b[^>]*>?", re.I)


def score(root: Node) -> list[Node]:
    """Fills in text, linked and score of every node; returns the nodes that hold text."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        node.near = [0.0] * len(SHARES)
        order.append(node)
        todo += [k for k in node.kids if isinstance(k, Node) and not k.drop]
    for node in reversed(order):
        for kid in node.kids:
            if isinstance(kid, Node):
                node.text, node.linked = node.text + kid.text, node.linked + kid.linked
            else:
                text, linked = kid
                node.text, node.linked = node.text + len(text), node.linked + linked
                points = 1 + text.count(",") + min(len(text) / 100, 3)
                to = node.up if node.tag in LEAVES and node.up is not None else node
                to.near[0] += points
        if node.up is not None:
            here = node.up.near
            for k, points in enumerate(node.near):
                here[min(k + 1, FAR)] += points
        node.score = sum(node.near) * SEMANTIC[node.tag] if node.tag in SEMANTIC else sum(p / share for p, share in zip(node.near, SHARES))
    for node in order:
        node.score *= 1 - (node.linked / node.text if node.text else 0)
    return [x for x in order if x.text]


def blocks(node: Node) -> list[str]:
    out, todo = [], [node]
    while todo:
        x = todo.pop()
        if isinstance(x, Node):
            if not x.drop:
                todo += reversed(x.kids)
        else:
            out.append(x[0])
    return out


def main_text(html: str) -> str:
    """The main text; a page that has none without what its classes and forms mark as boilerplate is read with it."""
    return _main_text(parse(html)) or (_main_text(parse(html, False)) if html else "")


def _main_text(root: Node) -> str:
    nodes = [x for x in score(root) if x.tag not in LEAVES]
    if not nodes:
        return ""
    top = max(x.score for x in nodes)
    best = [x for x in nodes if x.score >= top - 1e-9][-1]
    if best.up is None:
        return "\n".join(blocks(best))
    kept = []
    for kid in best.up.kids:
        if kid is best:
            kept.append(kid)
        elif not isinstance(kid, Node):
            if best.tag not in ("article", "main") and kid[1] < 0.25 * len(kid[0]):
                kept.append(kid)
        elif not kid.drop and kid.text:
            dense = kid.linked >= 0.25 * kid.text
            if not dense and (kid.tag == "h1" or kid.score >= 0.2 * best.score or best.tag not in ("article", "main") and kid.tag in LEAVES):
                kept.append(kid)
    return "\n".join(line for k in kept for line in (blocks(k) if isinstance(k, Node) else [k[0]]))


def extract(pages: DataFrame, html_col="html", *keep: str) -> DataFrame:
    """The columns named in keep, and text."""

    @F.pandas_udf("string")
    def run(html):
        return html.map(lambda h: main_text(h or ""))

    return pages.select(*keep, run(F.col(html_col)).alias("text"))


def op4(spark, sf_dir: str) -> DataFrame:
    out = extract(read(spark, sf_dir, "pages", "page_id", "url", "html"), "html", "page_id", "url")
    return out.withColumn("n_chars", F.length("text").cast("long"))
