"""Main text of web pages by paths on which the pages of a host agree.

Each page's containers are scored by the text of their blocks, less links; from
the whole page one goes down to the largest container for as long as what lies
outside it isn't text of the article, however long the page.  The page votes with
that container's generalised path (tags and classes, digits made alike).  Spark sums the votes for each host and path; every page is
then read again by its host's winning path, or by its own best one where the
page has no such container.
"""

from __future__ import annotations

import re
from collections import defaultdict
from html import unescape
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hosts whose paths are broadcast at most (about 100 bytes each).
HOSTS = 100_000
SALT = 16
#: Letters outside links that make a block beside a container a paragraph.
PROSE = 70

# Element names of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noframes noembed".split())
BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINER = set("article body center details div fieldset main section table tbody td tr".split())
DROPPED = set(
    "head script style textarea title xmp iframe noframes noembed noscript template nav footer aside form menu dialog svg math button select object canvas audio video map search".split()
)
#: Words in a class, id or role that mark what isn't the article.
MARKS = set(
    "ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay sidebar sidebars side rail widget widgets nav navbar navigation menu menus breadcrumb breadcrumbs pager pagination toc footer foot masthead header topbar toolbar comment comments commentlist disqus respond reply replies share sharing social related recommended newsletter subscribe subscription signup login search form skip copyright disclaimer complementary contentinfo".split()
)
MAIN = set("article main content articlebody post entry story".split())
#: Words beside marks in names of boxes ("left-sidebar"); any other word makes a name a slug or a flag ("side-effects", "has-sidebar").
LAYOUT = set("area block body bottom box button buttons col column container header icon icons inner item items left link links list outer panel posts primary right row secondary section site slot top unit wrap wrapper".split())
#: Marks that parts of an article have, too: text elements anywhere, and notes inside article or main, aren't dropped for them.
SOFT = set("alert banner disclaimer form menu notice notices related reply search side skip social toc widget".split())
NOTES = set("alert disclaimer notice notices side".split())
TEXTUAL = set("a abbr b blockquote cite code em h1 h2 h3 h4 h5 h6 i mark p pre q small span strong time".split())
HEADING = set("h1 h2 h3 h4 h5 h6".split())
REPLIES = set("comment comments commentlist disqus respond reply replies".split())
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
WALL = set("ul ol dl table body html div section article main td th".split())

_QUOTED = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_PLAIN = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>""")
_NAMED = re.compile(r"""(?:^|[\s"'])(class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_WORD = re.compile(r"[a-z]+")
_DIGITS = re.compile(r"\d+")


class _Node:
    __slots__ = ("tag", "step", "key", "up", "box", "head", "dropped", "parent", "own", "score", "bonus", "held", "fixed", "mark", "inner", "prose", "title", "main", "below")

    def __init__(self, tag, step, up, dropped, parent, bonus):
        self.tag, self.step, self.up, self.dropped, self.parent, self.bonus = tag, step, up, dropped, parent, bonus
        # paths are compared by a running hash: spelt out, those of deep pages would take their square
        self.key = 0 if up is None else hash((up.key, step)) if step else up.key
        self.box, self.head = self, tag == "h1" or up is not None and up.head
        self.own, self.score, self.held = 0.0, 0.0, False
        self.fixed, self.mark, self.inner = False, None, False
        self.prose, self.title, self.main, self.below = 0.0, 0.0, 0.0, []

    @property
    def path(self) -> str:
        steps, n = [], self
        while n is not None:
            steps.append(n.step)
            n = n.up
        return "".join(f">{x}" for x in reversed(steps) if x)


class _Mark:
    """An element whose name marks it: letters outside links, and headings or articles, that it holds."""

    __slots__ = ("up", "words", "size", "titles", "mains", "articles")

    def __init__(self, up, words):
        self.up, self.words = up, words
        self.size = self.titles = self.mains = self.articles = 0


def _attributes(text: str) -> tuple[str, set[str], set[str], set[str]]:
    """First class, digits made alike, the words of article names, and the marks that name the element
    by class or role, and by id: those of names made of marks and words of layout, or that say of what
    part of an article they are ("post-comments": the last word that isn't layout names the box)."""
    first, words, named, by_id = "", set(), set(), set()
    for name, value in _NAMED.findall(text):
        name, value = name.lower(), value.strip("\"'").lower()
        for token in value.split():
            parts = [w for w in _WORD.findall(token) if len(w) > 1]
            kind = next((w for w in reversed(parts) if w not in LAYOUT), None)
            if kind in MARKS and set(parts) <= MARKS | LAYOUT | MAIN:
                (by_id if name == "id" else named).update(MARKS.intersection(parts))
            elif kind in MAIN:
                words.update(parts)
        if name == "class" and value.split():
            first = _DIGITS.sub("#", value.split()[0])
    return first, words, named, by_id


def _marks(tag: str, words: set[str], named: set[str], by_id: set[str], inner: bool) -> set[str]:
    """The marks an element may be dropped for; ids of headings and inside an article are slugs."""
    if tag in ("body", "html") or words & MAIN:
        return set()
    found = named if inner or tag in HEADING else named | by_id
    if found and (tag in TEXTUAL and found <= SOFT or inner and found <= NOTES):
        return set()
    return found


class Page:
    """Containers and blocks of a page: blocks are (container, text, letters in links).

    An element that its name marks is dropped unless it is where the page's text is;
    pages with such a one are parsed again with it kept.
    """

    def __init__(self, html: str):
        kept = self._parse(html, frozenset())
        if kept:
            self._parse(html, kept)

    def _parse(self, html: str, kept: frozenset) -> frozenset:
        """The page without marked elements, but for those whose numbers are kept; the numbers that should be.

        Each character is looked at a bounded number of times, whatever the page.
        """
        root = _Node("", "", None, False, None, False)
        self.nodes, self.blocks = [root], []
        marks, whole = [], _Mark(None, set())
        root.mark = whole
        stack, pieces, linked, links = [root], [], 0, 0
        place, head = None, False  # where the first of the pieces stands, and whether any is of a title
        number = defaultdict(int)  # open elements of each name

        def flush():
            nonlocal pieces, linked, place, head
            if place is not None:
                text = " ".join("".join(pieces).split())
                self.blocks.append((place, text))
                own = max(0, len(text) - 2 * linked)
                place.own += own
                place.prose += own if own >= PROSE else 0
                if head:
                    place.title += len(text) if place.inner == "article" else own
            pieces, linked, place, head = [], 0, None, False

        def text(raw):
            nonlocal linked, place, head
            top = stack[-1]
            if not top.fixed and not links:
                top.mark.size += len(raw.strip())
            if not top.dropped:
                raw = unescape(raw) if "&" in raw else raw
                pieces.append(raw)
                if raw.strip():
                    place, head = place or top.box, head or top.head
                if links:
                    linked += len(raw.strip())

        def cut(k):
            nonlocal links
            for n in stack[k:]:
                links -= n.tag == "a"
                number[n.tag] -= 1
            del stack[k:]

        def close_within(tags, walls):
            """End the innermost of some elements, unless a wall stands before it."""
            if any(number[t] for t in tags):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in tags:
                        flush()
                        return cut(k)
                    if stack[k].tag in walls:
                        return None
            return None

        at, size, quoted = 0, len(html), True
        while at < size:
            lt = html.find("<", at)
            if lt < 0:
                text(html[at:])
                break
            if lt > at:
                text(html[at:lt])
            if html.startswith("<!--", lt):
                end = html.find("-->", lt + 4)
                at = size if end < 0 else end + 3
                continue
            if html.find(">", lt) < 0:
                text(html[lt:])
                break
            m = None
            if quoted and html[lt + 1 : lt + 3].strip("/")[:1].isalpha():
                m = _QUOTED.match(html, lt)
                # quotes that don't end before the page does mean nothing from here on
                quoted = m is not None
            m = m or _PLAIN.match(html, lt)
            if m is None:
                text("<")
                at = lt + 1
                continue
            at = m.end()
            close, name, rest = m[1], m[2], m[3]
            if not name:
                continue
            tag = name.lower()
            if close:
                if tag == "br":
                    pieces.append(" ")
                block = tag in BLOCK
                if number[tag]:
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k].tag == tag:
                            if block:
                                flush()
                            cut(k)
                            break
                        if not block and stack[k].tag in BLOCK:
                            break
                continue
            if tag in VOID:
                if tag == "hr":
                    flush()
                elif tag == "br":
                    pieces.append(" ")
                continue
            if tag in RAW:
                end = re.compile(f"</{tag}", re.I).search(html, at)
                stop = size if end is None else end.start()
                gt = html.find(">", stop)
                at = size if gt < 0 else gt + 1
                continue
            if tag in BLOCK:
                flush()
                # an open paragraph ends where a block begins; list items and cells end each other
                close_within(("p",), WALL)
            if tag in SAME:
                close_within(SAME[tag], WALL - {"td", "th"})
            first, words, named, by_id = _attributes(rest) if rest else ("", set(), set(), set())
            up = stack[-1]
            fixed = up.fixed or tag in DROPPED or (tag == "header" and not up.inner)
            found = set() if fixed or not (named or by_id) else _marks(tag, words, named, by_id, up.inner)
            mark = up.mark
            if found:
                mark = _Mark(up.mark, found)
                marks.append(mark)
            if not fixed:
                mark.titles += tag == "h1"
                mark.mains += tag == "main"
                mark.articles += tag == "article"
            dropped = up.dropped or fixed or bool(found and len(marks) - 1 not in kept)
            step = "" if tag in ("html", "body") or tag not in BLOCK else f"{tag}.{first}" if first else tag
            node = _Node(tag, step, up, dropped, up.box, tag in ("article", "main") or bool(words & {"articlebody", "main"}))
            node.held = tag in CONTAINER
            node.fixed, node.mark, node.inner = fixed, mark, "article" if "article" in (tag, up.inner) else "main" if tag == "main" else up.inner
            stack.append(node)
            number[tag] += 1
            links += tag == "a"
            if node.held:
                if not dropped:
                    self.nodes.append(node)
            else:
                node.box = up.box
        flush()
        for n in reversed(self.nodes):
            n.score += n.own
            up = n.parent
            if up is not None:
                up.score, up.prose, up.title, up.main = up.score + n.score, up.prose + n.prose, up.title + n.title, up.main + (n.score if n.bonus else n.main)
                up.below.append(n)
        for m in reversed(marks):
            for x in ("size", "titles", "mains", "articles"):
                setattr(m.up, x, getattr(m.up, x) + getattr(m, x))
        return frozenset(i for i, m in enumerate(marks) if _holds_page(m, whole))

    def best(self) -> _Node:
        """The innermost container that leaves out no text of the article."""
        node = self.nodes[0]
        while True:
            child = max(reversed(node.below), key=lambda n: n.score, default=None)
            if child is None or not child.score or _leaves_out(node, child):
                return node
            node = child

    def votes(self) -> tuple[str, float]:
        top = self.best()
        total = sum(n.own for n in self.nodes)
        return top.path, sum(n.own for n in self._inside({top})) / total if total else 0.0

    def _inside(self, chosen: set) -> set:
        """The containers in some of them, and those; a container stands after the one around it."""
        inside = set()
        for n in self.nodes:
            if n in chosen or n.parent in inside:
                inside.add(n)
        return inside

    def text(self, path: str | None) -> str:
        """Text of the containers on a path, or of the best one."""
        chosen = set()
        if path is not None:
            key = 0
            for step in path.split(">")[1:]:
                key = hash((key, step))
            chosen = {n for n in self.nodes if n.key == key} if path else {self.nodes[0]}
        if not chosen or not any(n.score for n in chosen):
            chosen = {self.best()}
        inside = self._inside(chosen)
        return "\n".join(t for n, t in self.blocks if n in inside)


def _leaves_out(node: _Node, child: _Node) -> bool:
    """Whether what lies in a container outside the largest one in it is text of the article."""
    outside = node.score - child.score
    if node.title > child.title or (outside and node.inner == "article"):
        return True
    if child.bonus:
        # the page says where its article is; other articles count, and what stands beside it in main
        return bool(node.inner and node.own) or node.main > child.score or outside > child.score
    return outside > 0 and bool(node.inner or node.own or node.prose > child.prose)


def _holds_page(m: _Mark, whole: _Mark) -> bool:
    """Whether a marked element holds most of a page's text and no article lies elsewhere."""
    if 2 * m.size <= whole.size:
        return False
    if m.mains or m.size == whole.size:
        return True
    heads = m.titles + m.articles
    return not m.words & REPLIES and (m.titles > 0 or whole.titles + whole.mains + whole.articles == heads)


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def _vote(batches):
    for batch in batches:
        total: dict = defaultdict(float)
        for url, html in zip(batch.column(0), batch.column(1), strict=True):
            path, weight = Page(html.as_py() or "").votes()
            if weight:
                total[host_of(url.as_py()), path] += weight
        keys = list(total)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([total[k] for k in keys], pa.float64())], names=["host", "path", "weight"])


def _hosts(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([host_of(u) for u in batch.column(1).to_pylist()], pa.string())], names=["page_id", "url", "html", "host"])


def _read(batches):
    for batch in batches:
        texts = [Page(h.as_py() or "").text(p.as_py()) for h, p in zip(batch.column(2), batch.column(3), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), batch.column(3)], names=["page_id", "url", "text", "n_chars", "path"]
        )


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars and path (the host's, null if it has none) of each page.

    Blocks of the article in page order, one line each, references decoded and
    white space squeezed.  Null html is empty and gives an empty text; pages
    without a readable url share the empty host; repeated rows come back as
    often; an empty table gives none; other columns are not read.  The hosts'
    paths are broadcast where they are at most HOSTS, which is counted first,
    and joined in SALT parts for each host beyond.
    """
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    votes = base.select("url", "html").mapInArrow(_vote, "host string, path string, weight double")
    # rounded, so that the order of adding doesn't choose between equals
    votes = votes.groupBy("host", "path").agg(F.round(F.sum("weight"), 6).alias("weight"))
    won = votes.groupBy("host").agg(F.max(F.struct("weight", "path")).alias("top")).select("host", F.col("top.path").alias("path"))
    from contactloom.llm.blocks import checkpoint

    won = checkpoint(won)
    named = base.mapInArrow(_hosts, "page_id long, url string, html string, host string")
    if won.limit(HOSTS + 1).count() <= HOSTS:
        both = named.join(F.broadcast(won), "host", "left")
    else:
        won = won.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        both = named.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALT)).cast("int")).join(won, ["host", "salt"], "left")
    return both.select("page_id", "url", "html", "path").mapInArrow(_read, "page_id long, url string, text string, n_chars long, path string")
