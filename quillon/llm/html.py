"""Main text of web pages by tree scoring.

A page is parsed into a light tree. Parts that are never article text are cut off by their tag, role or name. Every
paragraph then passes points for its length and its commas to its ancestors (all to the parent, half to the grandparent,
less further up); an element's sum is discounted by its link density. From the best container one climbs to the outermost
article or main part around it, or without one as far as the other children are not links; everything below is written
out in page order, short or long, but for menus. Articles side by side are one text.

Names are read class by class: a class speaks of boilerplate if it has a word for it ("ad", "comments") and its other
words only say where or in what ("container", "post"); "social-sciences" or "has-sidebar" do not. What is cut off by a
soft tag (form, nav, aside, ...), a role or a name stays if it wraps the page's article: if it holds its largest main
part, else its largest article, else its first h1, and half of the unlinked text outside comments with it (without any
of these, four fifths of the text; a form half of it). Headings are never menus. In an article only a list of links under a
heading that announces other pages ("Related", "Read next") goes, with the heading.

Without an article or main part, the blocks beside the best container and beside what wraps it are kept if they are not
links, nor a short line of the page's foot (rights, terms, privacy), nor a scrap: text without a paragraph, heading or
sentence. Runs of three or more links between blocks are menus, in cells too, and so are paragraphs of short links before
the first or after the last prose of their container. An article beside the best one goes if its heading is a link and it
is short, or if its name says teaser.

Defined results: NULL, empty or text-free HTML gives an empty text; plain text without tags is its own article; unclosed
and stray tags follow the usual implied ends; character references are decoded, broken ones stay as they are; a comment
without an end goes with all after it, a tag without one goes alone (after ``REPAIRS`` of these the rest is text);
declarations (<!...>, <![...>) end at the next ">"; equal pages give equal texts; an empty table gives no rows; columns of the caller
are kept. The work is linear in the page, whatever its tags.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark math q ruby rt rp s samp small span strike strong sub sup time tt u var wbr br img".split())
#: Cut off whatever they hold.
HARD_TAGS = frozenset("script style noscript template iframe frame object embed svg canvas audio video map head title button select textarea input label legend datalist".split())
#: Cut off unless they wrap the article.
SOFT_TAGS = frozenset("nav menu header footer aside form fieldset dialog".split())
JUNK_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
COMMENT_NAMES = frozenset("comment comments commentlist disqus respond replies reply discussion discussions".split())
#: Words of class names and ids that mark boilerplate.
JUNK_NAMES = COMMENT_NAMES | frozenset("""nav navbar navigation menu menus breadcrumb breadcrumbs header masthead footer sidebar aside widget widgets ad ads adv advert adverts
    advertisement advertisements advertising adsense sponsor sponsors sponsored promo promos promotion promoted banner cookie cookies consent gdpr notice notices
    alert alerts popup popover modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations trending
    search pagination pager toolbar skip hidden copyright legal disclaimer outbrain taboola foot rail rails teaser teasers topbar subnav sitenav footnav sitemap""".split())
#: Words beside them that only say where, in what or how.
BESIDE = frozenset("""article articles post posts entry entries story stories page pages site main content contents body text container wrapper wrap inner outer box
    block section area region zone slot unit module component panel bar strip row col column columns grid list lists item items link links group holder frame card
    cards top bottom left right center middle upper lower side first last primary secondary global local mobile desktop sticky fixed floating inline button buttons
    icon icons form field title heading message messages info image img media video logo policy law settings preferences manager warning accept close more you may
    like also read next prev previous your our the and of in on to by js ui wp is google dfp gpt mpu leaderboard skyscraper rectangle billboard placement placeholder
    native thread tree author meta avatar small large big mini full new latest recent odd even depth level parent children reply tools tool btn id no""".split())
#: A class with such a word speaks of boilerplate that is elsewhere.
SPEAKS_OF = frozenset("has with without no not open closed enabled disabled layout theme".split())
#: Heads of articles are no page headers.
HEADS = frozenset("header banner".split())
OF_ARTICLE = frozenset("article post entry story content section chapter".split())
#: As the id of a part of an article, such a word may as well be its subject.
SUBJECTS = frozenset("discussion discussions notice notices alert alerts legal copyright disclaimer search sharing navigation social header footer subscription promotion recommended recommendations trending overlay banner menu menus reply consent".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: Blocks that are parts of a text, never its container.
PARTS = frozenset("p pre h1 h2 h3 h4 h5 h6 hr li dt dd tr td th tbody thead tfoot ul ol dl caption option figcaption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())

#: What heads of link lists say that lead to other pages, and what lines at the foot of a page say.
ELSEWHERE = re.compile(r"(related|recommended|popular|trending|latest|sponsored|share|follow us|most (read|popular|viewed)|more (from|on|in|about|stories|news|articles|posts)|read (more|next|also)|you (may|might)( also)? like|(up|what'?s) next)\b", re.I)
FOOT = re.compile(r"all rights reserved|terms (of|and) (use|service|conditions)|privacy policy|cookie policy|©|\(c\) ?\d{4}|powered by", re.I)
FOOT_CHARS = 300
SENTENCE = re.compile(r"[.!?…。！？:;][\"'”’»)\]]*$")

#: Marks of a node: whether one of these elements is open at it, counted from the nearest element that hides those outside.
OPEN_P, OPEN_LI, OPEN_DT, OPEN_TR, OPEN_TD, OPEN_OPTION, IN_ARTICLE, IN_MAIN, IN_CODE, IN_LINK, IN_QUOTE = (1 << i for i in range(11))
SETS = {"p": OPEN_P, "li": OPEN_LI, "dt": OPEN_DT, "dd": OPEN_DT, "tr": OPEN_TR, "td": OPEN_TD, "th": OPEN_TD, "option": OPEN_OPTION, "article": IN_ARTICLE, "main": IN_MAIN, "pre": IN_CODE, "code": IN_CODE, "a": IN_LINK, "blockquote": IN_QUOTE}
HIDES: Counter = Counter()
for _tags, _mark in (("html body table td th article section div blockquote ul ol li button", OPEN_P), ("ul ol menu", OPEN_LI), ("dl", OPEN_DT), ("table", OPEN_TR), ("tr table", OPEN_TD), ("select", OPEN_OPTION)):
    for _t in _tags.split():
        HIDES[_t] |= _mark
#: For a start tag: the open elements that it ends.
ENDS = {"li": OPEN_LI, "dt": OPEN_DT, "dd": OPEN_DT, "tr": OPEN_TR, "td": OPEN_TD, "th": OPEN_TD, "option": OPEN_OPTION} | dict.fromkeys(ENDS_P, OPEN_P)
KEEP, SOFT, COMMENT, HARD = range(4)
#: A comment or tag that the page ends in goes; after so many tags without an end the rest is left to the parser.
UNFINISHED = re.compile(r"<!--|<\?|</?[a-zA-Z]")
REPAIRS = 50


class Node:
    __slots__ = ("tag", "junk", "parent", "children", "marks", "score", "length", "linked", "links", "prose", "heads", "plain")

    def __init__(self, tag: str, parent: Node | None, junk: int = KEEP, marks: int = 0):
        self.tag, self.parent, self.junk, self.marks = tag, parent, junk, marks
        self.children: list[Node | str] = []
        self.score, self.length, self.linked, self.links, self.prose, self.heads, self.plain = 0.0, 0, 0, 0, False, False, 0


def _words(name: str) -> set[str]:
    return set(re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()))


def _name_junk(name: str, subject: bool = False) -> int:
    """What a class name or an id marks; ``subject``: it may be the subject of a part of an article."""
    words = _words(name)
    found = words & JUNK_NAMES
    other = {w for w in words - found if len(w) > 1}
    if not found or other & SPEAKS_OF or not other <= BESIDE or subject and found <= SUBJECTS:
        return KEEP
    if found <= HEADS and words & OF_ARTICLE:
        return KEEP
    return COMMENT if found & COMMENT_NAMES else SOFT


def _junk(tag: str, attrs: list[tuple[str, str | None]], marks: int) -> int:
    if tag in HARD_TAGS:
        return HARD
    found = KEEP
    if tag in SOFT_TAGS and not (tag == "header" and marks & (IN_ARTICLE | IN_MAIN) or tag == "footer" and marks & IN_QUOTE):
        found = SOFT
    if not attrs or tag in ("html", "body"):
        return found
    a = dict(attrs)
    if "hidden" in a or (a.get("aria-hidden") or "") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style") or ""):
        return HARD
    if (a.get("role") or "").lower() in JUNK_ROLES:
        found = SOFT
    if not marks & IN_CODE:  # there, classes are those of syntax highlighters
        names = [_name_junk(x) for x in (a.get("class") or "").split()]
        if a.get("id") and tag not in HEADINGS:
            names.append(_name_junk(a["id"], bool(marks & (IN_ARTICLE | IN_MAIN))))
        found = max(found, *names, KEEP)
    return found


class Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("root", None)
        self.open: Counter = Counter()

    def _close(self, n: Node) -> None:
        """Close the open elements up to this one."""
        while self.at is not n:
            self.open[self.at.tag] -= 1
            self.at = self.at.parent
        self.open[n.tag] -= 1
        self.at = n.parent

    def handle_starttag(self, tag: str, attrs: list) -> None:
        ended = ENDS.get(tag, 0)
        if self.at.marks & ended:
            n = self.at
            while not SETS.get(n.tag, 0) & ended:
                n = n.parent
            self._close(n)
        outer = self.at.marks
        node = Node(tag, self.at, _junk(tag, attrs, outer), outer & ~HIDES[tag] | SETS.get(tag, 0) if tag in HIDES else outer | SETS.get(tag, 0))
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node
            self.open[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)  # as in a browser, the slash means nothing

    def handle_endtag(self, tag: str) -> None:
        if self.open[tag] > 0:
            n = self.at
            while n.tag != tag:
                n = n.parent
            self._close(n)

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        return self.parse_bogus_comment(i, report)  # as in a browser, whatever follows "<!["; the standard parser raises


def parse(html: str) -> Node:
    builder = Builder()
    builder.feed(html)
    for _ in range(REPAIRS):  # what the parser still holds has no end
        held = builder.rawdata
        if builder.cdata_elem or not UNFINISHED.match(held):
            break
        builder.rawdata = ""
        more = -1 if held.startswith(("<!--", "<?")) else held.find("<", 1)
        if more < 0:
            break
        builder.feed(held[more:])
    builder.close()
    return builder.root


def _order(root: Node) -> list[Node]:
    """All nodes, parents first."""
    nodes, stack = [], [root]
    while stack:
        n = stack.pop()
        nodes.append(n)
        stack.extend(c for c in reversed(n.children) if isinstance(c, Node))
    return nodes


def _around(n: Node | None) -> set[int]:
    found = set()
    while n is not None:
        found.add(id(n))
        n = n.parent
    return found


def prune(root: Node) -> None:
    """Cut off junk, but not what wraps the article."""
    for n in _order(root):
        n.children = [c for c in n.children if isinstance(c, str) or c.junk != HARD]
    nodes = _order(root)
    for n in reversed(nodes):
        own = 0 if n.marks & IN_LINK else sum(len(c.strip()) for c in n.children if isinstance(c, str))
        n.plain = own + sum(c.plain for c in n.children if isinstance(c, Node))
    anchor = next((max(found, key=lambda n: n.plain) for tag in ("main", "article") if (found := [n for n in nodes if n.tag == tag and n.junk == KEEP])), None) or next((n for n in nodes if n.tag == "h1"), None)
    around = _around(anchor)
    total, stack = root.plain, [root]
    while stack:
        for c in stack.pop().children:
            if isinstance(c, Node):
                if c.junk == COMMENT and id(c) not in around:
                    total -= c.plain
                else:
                    stack.append(c)

    def wraps(n: Node) -> bool:
        if anchor is None or n.tag == "form":
            return n.plain > (0.5 if n.tag == "form" else 0.8) * total
        return id(n) in around and n.plain > 0.5 * total

    for n in nodes:
        n.children = [c for c in n.children if isinstance(c, str) or c.junk == KEEP or wraps(c)]


def measure(root: Node) -> list[Node]:
    """Lengths of text and of linked text, points, and scores; children before parents."""
    nodes = _order(root)[::-1]
    for n in nodes:
        own = " ".join("".join(c if isinstance(c, str) else " " for c in n.children).split())
        inner = [c for c in n.children if isinstance(c, Node)]
        n.length = len(own) + sum(c.length for c in inner)
        n.linked = n.length if n.tag == "a" else sum(c.linked for c in inner)
        n.links = (n.tag == "a") + sum(c.links for c in inner)
        n.prose = n.tag in ("p", "blockquote", "pre", "figure") and n.length > 0 or any(c.prose for c in inner)
        n.heads = n.tag in HEADINGS and n.length > 0 or any(c.heads for c in inner)
    for n in nodes:
        if n.tag in INLINE:
            continue
        pieces: list[str] = []
        stack = [iter(n.children)]
        while stack:  # the text of the block itself, with what is inline in it
            c = next(stack[-1], None)
            if c is None:
                stack.pop()
            elif isinstance(c, str):
                pieces.append(c)
            elif c.tag in INLINE:
                stack.append(iter(c.children))
        text = " ".join("".join(pieces).split())
        if not text:
            continue
        points = (1 + min(len(text) / 100, 3) + text.count(",") + text.count("，")) * (1 - n.linked / max(1, n.length))
        up, share = (n.parent or n) if n.tag in PARTS or n.tag == "blockquote" else n, 1.0
        for depth in range(5):
            up.score += points * share
            if up.parent is None:
                break
            up, share = up.parent, 0.5 if depth == 0 else share * 0.6
    for n in nodes:
        n.score = (n.score + 25 * (n.tag in ("article", "main") and n.length > 0)) * (1 - n.linked / max(1, n.length))
    return nodes


def _links_only(n: Node, least: int = 3) -> bool:
    return n.links >= least and n.linked >= 0.8 * n.length


def _menu(n: Node) -> bool:
    return n.tag in ("ul", "ol", "dl", "table", "tbody", "tr", "td", "th", "div", "section", "center") and _links_only(n) and not n.prose and not n.marks & IN_ARTICLE


def text_of(n: Node, most: int) -> str:
    """The text below a node, up to about so many characters."""
    pieces: list[str] = []
    stack: list = [n]
    size = 0
    while stack and size < most:
        c = stack.pop()
        if isinstance(c, str):
            pieces.append(c)
            size += len(c)
        else:
            pieces.append("" if c.tag in INLINE and c.tag != "br" else " ")
            stack.extend(reversed(c.children))
    return " ".join("".join(pieces).split())


def elsewhere(nodes: list[Node]) -> set[int]:
    """Ids of headings that announce other pages, with the link lists after them, and of paragraphs of links at an edge of the text."""
    out = set()
    for n in nodes:
        last, prose, menus = None, [], []
        for i, c in enumerate(n.children):
            if isinstance(c, str):
                continue
            if last is not None and c.tag in ("ul", "ol", "div", "section") and _links_only(c, 2) and ELSEWHERE.match(text_of(last, 80)):
                out |= {id(last), id(c)}
            last = c if c.tag in HEADINGS else last if c.tag in INLINE else None
            if c.tag == "p" and not c.marks & IN_ARTICLE and _links_only(c) and c.linked <= 25 * c.links:
                menus.append((i, c))
            elif c.length > c.linked * 2 and (c.prose or c.tag in HEADINGS):
                prose.append(i)
        out |= {id(c) for i, c in menus if not prose or i < prose[0] or i > prose[-1]}
    return out


def blocks(root: Node, without: frozenset[int] = frozenset()) -> list[str]:
    """The texts of the blocks below a node, in page order, but for the nodes of these ids, menus, and runs of links beside blocks."""
    found: list[str] = []
    piece: list[str] = []
    links: list[int] = []  # lengths of the links of the run

    def end(owner: Node) -> None:
        if text := " ".join("".join(piece).split()):
            run = len(links) >= 3 and sum(links) >= 0.8 * len(text) and owner.tag not in PARTS and not owner.marks & IN_ARTICLE
            if not run:
                found.append(text)
        piece.clear()
        links.clear()

    stack: list[tuple[Node, Iterator]] = [(root, iter(root.children))]
    owner = [root]
    while stack:
        n, rest = stack[-1]
        c = next(rest, None)
        if c is None:
            stack.pop()
            if n.tag not in INLINE:
                end(owner.pop() if len(owner) > 1 else root)
        elif isinstance(c, str):
            piece.append(c)
        elif c.tag == "br":
            piece.append(" ")
        elif id(c) not in without and not _menu(c):
            if c.tag not in INLINE:
                end(owner[-1])
                owner.append(c)
            elif c.tag == "a":
                links.append(c.length)
            stack.append((c, iter(c.children)))
    end(root)
    return found


def _linked(n: Node) -> bool:
    return n.length > 0 and n.linked > 0.5 * n.length and n.tag not in HEADINGS and n.tag != "p"


def _foreign(n: Node, near: bool) -> bool:
    """Whether a block beside the text is no part of it: links, a line of the page's foot, or a scrap without a paragraph, heading or sentence."""
    if _linked(n):
        return True
    if n.length == 0 or n.tag in HEADINGS:
        return False
    text = text_of(n, FOOT_CHARS + 1)
    if len(text) <= FOOT_CHARS and FOOT.search(text):
        return True
    scrap = n.tag in ("div", "section", "center", "td", "address", "details") and not n.prose and not n.heads
    return scrap and not SENTENCE.search(text) if near else scrap and n.length <= FOOT_CHARS


def _teaser(n: Node, best: Node) -> bool:
    """Whether an article beside the best one leads to another page: its heading is a link, and it is short."""
    return n.tag == "article" and n.heads and n.linked > 0 and n.length < 0.3 * best.length and any(isinstance(c, Node) and c.tag in HEADINGS and c.length and c.linked >= 0.8 * c.length for c in _order(n))


def _whole(best: Node) -> tuple[Node, frozenset[int]]:
    """The node that holds the whole text around the best one, and the ids of those of its children that don't belong to it."""
    top, n = None, best
    while n.parent is not None:
        if n.tag in ("article", "main"):
            top = n
        n = n.parent
    if top is not None:
        if top.tag == "main":
            return top, frozenset(id(c) for c in _order(top) if c is not top and (not c.parent.marks & IN_ARTICLE and _teaser(c, top) or c.parent is top and c.tag not in INLINE and c.tag != "article" and _foreign(c, True) and not c.marks & IN_ARTICLE))
        beside = [c for c in top.parent.children if isinstance(c, Node) and c is not top]
        if not any(c.tag == "article" for c in beside):
            return top, frozenset()
        return top.parent, frozenset(id(c) for c in beside if c.tag not in ("article", "main", *HEADINGS) or _linked(c) or _teaser(c, top))
    at, out, near = best, set(), True
    while at.parent is not None:
        around = [c for c in at.parent.children if isinstance(c, Node) and c is not at and c.tag not in INLINE]
        out |= {id(c) for c in around if _foreign(c, near)}
        near = near and all(c.length == 0 for c in around)
        at = at.parent
    return at, frozenset(out)


def main_text(html: str | None) -> str:
    if not html:
        return ""
    root = parse(html)
    prune(root)
    nodes = measure(root)
    best = root
    for n in nodes[::-1]:  # parents first: of equals, the outer one
        if n.tag not in INLINE and n.tag not in PARTS and n.score > best.score:
            best = n
    whole, without = _whole(best)
    return " ".join(blocks(whole, without | elsewhere(nodes)))


@F.pandas_udf(T.StringType())
def _texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield pd.Series([main_text(h) for h in batch], dtype=object)


def main_text_column(html: Column) -> Column:
    return _texts(html)
