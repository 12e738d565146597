"""HTML main-text extraction by tree scoring.

A page is read once into a flat tree (parents before children) and a list of events: texts and block boundaries. Scripts, forms,
navigation, footers and the like (by element or role) and hidden elements never count. Every other block of running text is a
paragraph that passes points for its length and commas, times one minus its link density, to its container, by halves and less to
the next REACH containers above. The best container, by points and its own link density, leads to the article: the article or
main element around it if there is one, else itself with its siblings that have running text of few links, and all between them.

Elements of which a class or id name says nothing but boilerplate (``comment-list``, ``cookie-notice``; not ``related-work``) are left
out before the points are given, unless that would leave a page without running text: then the names are wrong and only the
points count. Names that may be boilerplate (``top``, ``legal``) count outside an article element alone, and never for a paragraph;
names of elements within running text never count.
Outside an article element boxes that are mostly links of few words are menus and go; lists of longer linked titles stay. Within
one, all goes that says what it is (navigation, forms, asides, comments, ...), and nothing else. Articles side by side with running
text are all kept.

Text: character references are decoded, white space inside a block becomes one space, blocks are trimmed and joined in page
order by one newline. A line break is white space. Nothing is capped; time grows with the page's length, whatever its depth.

Defined results: null or empty html gives an empty text, as does a page without running text; unclosed, misnested and cut-off
markup is read as browsers do in the main; repeated rows give repeated results. Columns other than those named are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul head".split())
CLOSES_P = BLOCKS - {"caption", "tbody", "tfoot", "thead", "tr", "body", "html", "head", "legend"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NEVER = frozenset("script style noscript template nav footer aside form button input select textarea iframe svg canvas object embed video audio dialog menu head title map option datalist noembed noframes xmp".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar status tablist".split())
#: An inline end tag doesn't close these; a paragraph isn't closed through those.
CONTAINERS = frozenset("td th article main body section div table".split())
HOLDS_P = (BLOCKS - {"p"}) | {"td", "th", "button", "object"}
#: (tags that close each other, tags that bound them)
CLOSE_EACH_OTHER = ((("li",), ("ul", "ol", "menu")), (("dt", "dd"), ("dl",)), (("tr",), ("table",)), (("td", "th"), ("tr", "table")), (("option",), ("select",)))
#: Elements within running text; what they are named is a matter of style.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q ruby s samp small span strike strong sub sup time tt u var wbr br img html body".split())
KEEP, MAYBE, NAMED, DROP = range(4)
REACH = 5  # containers above a paragraph that get points of it
MENU_WORDS = 3.5  # links of a menu have fewer words on average
PARAGRAPHS = frozenset("p pre li dd dt blockquote td th figcaption tr caption".split())
WEIGHT = {"article": 12.0, "main": 10.0, "section": 2.0, "div": 5.0, "pre": 3.0, "td": 3.0, "blockquote": 3.0, "ul": -3.0, "ol": -3.0, "dl": -3.0, "form": -3.0, "th": -5.0, "address": -3.0}

# Words of class and id names: boilerplate for certain, boilerplate unless the name also says content, content; and words that say nothing of either.
SURE = re.compile(r"(ads?|advert\w*|adsense|adbox|sponsor\w*|promo\w*|cookies?|consent|gdpr|comments?|commentlist|disqus|respond|reply|replies|share|sharing|social|related|recommend\w*|newsletter|subscri\w*|signup|login|nav|navbar|navigation|menu|breadcrumbs?|footer|sidebar|pagination|pager|popup|modal|overlay|paywall|toolbar|skip|copyright|masthead|dfp|outbrain|taboola)$")
LIKELY = re.compile(r"(header|banner|notices?|alert|widget|teaser|tags?|tools|rail|aside|extra|feedback|legal|disclaimer|site|top|bottom|hidden)$")
CONTENT = re.compile(r"(article|articlebody|body|content|entry|main|post|story|text|page|blog|hentry)$")
NEUTRAL = re.compile(r"(list|box|block|section|container|wrap\w*|inner|outer|area|bar|items?|groups?|units?|panel|col|column|rows?|grid|links?|posts|buttons?|btns?|icons?|module|slots?|zone|holder|left|right|small|large|mobile|desktop|fixed|sticky|thread|reading|the|js|\d+)$")
NOT_WITH = frozenset("with has no without".split())

TAG = re.compile(r"<(?:!--(?:.*?)(?:-->|$)|(/?)([a-zA-Z][^\s/>]*)((?:\s*(?:=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"'][^\s>]*)?|[^\s>=]+))*)\s*(?:>|$)|[!?/][^>]*(?:>|$))", re.S)
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
NAME_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Page:
    """The flat tree: tag, parent and own drop mark of each node; events (node, text) with None for a block boundary."""

    def __init__(self) -> None:
        self.tag, self.parent, self.drop, self.bonus = ["#", "body"], [-1, 0], [KEEP, KEEP], [0.0, 0.0]
        self.events: list[tuple[int, str | None]] = []

    def add(self, tag: str, parent: int, raw: str) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        drop, bonus = marks(tag, raw)
        self.drop.append(drop)
        self.bonus.append(bonus)
        return len(self.tag) - 1


class Open:
    """The open elements, with the places of each tag and of the tags that bound others, so that no search walks the stack."""

    def __init__(self, tags: list[str]) -> None:
        self.tags, self.stack = tags, [0, 1]  # a page has one body, whether it says so or not
        self.at: dict[str, list[int]] = {"body": [1]}
        self.containers, self.blocks = [1], [1]

    def push(self, node: int) -> None:
        tag, place = self.tags[node], len(self.stack)
        self.stack.append(node)
        self.at.setdefault(tag, []).append(place)
        if tag in CONTAINERS:
            self.containers.append(place)
        if tag in HOLDS_P:
            self.blocks.append(place)

    def cut(self, place: int) -> None:
        for node in self.stack[place:]:
            self.at[self.tags[node]].pop()
        del self.stack[place:]
        for bounds in (self.containers, self.blocks):
            while bounds and bounds[-1] >= place:
                bounds.pop()

    def last(self, *tags: str) -> int:
        """The place of the innermost of these tags, 0 if none is open."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)


def marks(tag: str, raw: str) -> tuple[int, float]:
    """KEEP, NAMED or DROP for what an element says of itself, and its bonus as a container."""
    if tag in NEVER:
        return DROP, 0.0
    if not raw.strip(" /\n\t\r") or tag in ("html", "body", "a", "br", "img"):
        return KEEP, 0.0
    inline = tag in INLINE
    attributes = {}
    for name, *values in ATTRIBUTE.findall(raw):
        attributes.setdefault(name.lower(), next((v for v in values if v), ""))
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or HIDDEN.search(attributes.get("style", "")):
        return DROP, 0.0
    role = attributes.get("role", "").lower()
    if role in ROLES:
        return DROP, 0.0
    bonus = 10.0 * (role in ("main", "article")) + 12.0 * ("articlebody" in attributes.get("itemprop", "").lower())
    sure = likely = content = False
    for name in () if inline else f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
        words = [w.lower() for w in NAME_WORDS.findall(name)]
        if any(w in NOT_WITH for w in words[:-1]):
            continue
        content |= any(CONTENT.match(w) for w in words)
        if all(any(kind.match(w) for kind in (SURE, LIKELY, CONTENT, NEUTRAL)) for w in words):  # a word of its own makes it a matter of the article
            sure |= any(SURE.match(w) for w in words)
            likely |= any(LIKELY.match(w) for w in words)
        sure |= "".join(words) in ("adbox", "readnext", "readmore", "seealso")
    if attributes.get("itemtype", "").lower().endswith("/comment"):
        sure = True
    if tag in ("article", "main"):
        return NAMED if sure and not content else KEEP, bonus
    maybe = likely and not content and tag not in PARAGRAPHS and tag not in HEADINGS
    return NAMED if sure else MAYBE if maybe else KEEP, bonus + 8.0 * content


def parse(html: str) -> Page:
    page = Page()
    tags, events = page.tag, page.events
    opened = Open(tags)
    stack = opened.stack
    at, size = 0, len(html)
    endless: set[str] = set()
    while at < size:
        m = TAG.search(html, at)
        if m is None:
            events.append((stack[-1], unescape(html[at:])))
            break
        if m.start() > at:
            events.append((stack[-1], unescape(html[at : m.start()])))
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            place = opened.last(name)
            if name == "p" and not place:
                events.append((stack[-1], None))
            elif place > 1 and (name in BLOCKS or place >= opened.containers[-1]):
                if any(tags[i] in BLOCKS for i in stack[place:]):
                    events.append((stack[place], None))
                opened.cut(place)
            continue
        if name in CLOSES_P and (place := opened.last("p")) > opened.blocks[-1]:
            events.append((stack[place], None))
            opened.cut(place)
        for group, bounds in CLOSE_EACH_OTHER:
            if name in group and (place := opened.last(*group)) > opened.last(*bounds):
                events.append((stack[place], None if name not in ("td", "th") else " "))
                opened.cut(place)
        if (name == "body" or (name in BLOCKS and name != "head")) and opened.at.get("head"):
            opened.cut(opened.at["head"][0])
        if name in ("body", "html"):
            continue
        node = page.add(name, stack[-1], m[3])
        if name in BLOCKS:
            events.append((node, None))
        elif name in ("br", "td", "th", "img"):
            events.append((stack[-1], " "))
        if name in RAW:
            end = None if name in endless else re.compile(rf"</{name}(?=[\s/>])", re.I).search(html, at)
            if end is None:
                endless.add(name)
                if name in ("title", "textarea", "iframe"):
                    continue
            stop = end.start() if end else size
            at = html.find(">", stop) + 1 if end else size
            at = at or size
            continue
        if name not in VOID and not (m[3].rstrip().endswith("/") and name in ("path", "svg", "circle", "rect", "use")):
            opened.push(node)
    return page


class Tree:
    """A page's blocks and points, without what is marked as ``least`` or more."""

    def __init__(self, page: Page, least: int) -> None:
        tag, parent = page.tag, page.parent
        n = len(tag)
        self.page, self.n, self.inside = page, n, [False] * n
        inside, in_link, self.block_of, self.hidden = self.inside, [False] * n, [0] * n, [False] * n
        in_header = [False] * n
        for i in range(1, n):
            p = parent[i]
            inside[i] = inside[p] or tag[i] in ("article", "main")
            in_link[i] = in_link[p] or tag[i] == "a"
            self.block_of[i] = i if tag[i] in BLOCKS or tag[i] in ("td", "th") else self.block_of[p]
            # a header inside an article gives its headings alone
            in_header[i] = tag[i] not in HEADINGS and (tag[i] == "header" or in_header[p]) if inside[i] else False
            mark = KEEP if inside[p] and page.drop[i] == MAYBE else page.drop[i]
            self.hidden[i] = self.hidden[p] or mark >= least or (tag[i] == "header" and not inside[p])
        shown = [not (a or b) for a, b in zip(self.hidden, in_header, strict=True)]

        self.blocks: list[tuple[int, str]] = []  # a block's first node and its text
        self.length, self.linked, self.links, self.link_words = [0] * n, [0] * n, [0] * n, [0] * n
        self.score, self.scored = [0.0] * n, [False] * n
        parts: list[str] = []
        first = linked = words = 0
        begun, last_link = False, -1

        def close() -> None:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                self.blocks.append((first, text))
                self._give(first, text, min(linked, len(text)), words)

        for node, text in page.events:
            if text is None:
                close()
                linked = words = 0
                begun = False
            elif shown[node]:
                if not begun and text.strip():
                    first, begun = node, True
                parts.append(text)
                if in_link[node]:
                    linked += len(text.strip())
                    words += len(text.split())
        close()
        for i in range(1, n):
            if tag[i] == "a" and shown[i]:
                self.links[self.block_of[i]] += 1
        for i in range(n - 1, 0, -1):
            for sums in (self.length, self.linked, self.links, self.link_words):
                sums[parent[i]] += sums[i]

    def _give(self, first: int, text: str, linked: int, words: int) -> None:
        """A block's points to its container and the REACH containers above."""
        tag, parent, block_of = self.page.tag, self.page.parent, self.block_of
        box = block_of[first]
        self.length[box] += len(text)
        self.linked[box] += linked
        self.link_words[box] += words
        if tag[box] in HEADINGS:
            return
        points = (1.0 + text.count(",") + text.count("，") + text.count("、") + min(len(text) / 100.0, 3.0)) * (1.0 - linked / len(text))
        up = block_of[parent[box]] if tag[box] in PARAGRAPHS and parent[box] > 0 else box
        for level in range(REACH + 1):
            if up <= 0:
                break
            self.score[up] += points if level == 0 else points / 2 if level == 1 else points / (3.0 * level)
            self.scored[up] = True
            up = block_of[parent[up]]

    def density(self, i: int) -> float:
        return self.linked[i] / self.length[i] if self.length[i] else 0.0

    def best(self) -> int:
        """The container with the most points, 0 if none has any."""
        found, most = 0, 0.0
        for i in range(1, self.n):
            if self.scored[i] and not self.hidden[i]:
                total = (self.score[i] + WEIGHT.get(self.page.tag[i], 0.0) * (self.length[i] > 0) + self.page.bonus[i]) * (1.0 - self.density(i))
                if total > most:
                    found, most = i, total
        return found

    def article(self, best: int) -> list[bool]:
        """Which nodes belong to the article that the best container leads to."""
        tag, parent, n = self.page.tag, self.page.parent, self.n
        several = any(tag[i] == "article" and not self.hidden[i] for i in range(1, n))
        up, around = best, 0
        while up > 0 and not around:
            around = up if tag[up] == "article" or (tag[up] == "main" and not several) else 0
            up = parent[up]
        chosen = [False] * n
        chosen[around or best] = True
        if around and tag[around] == "article":  # articles side by side
            for i in range(1, n):
                chosen[i] |= tag[i] == "article" and parent[i] == parent[around] and not self.hidden[i] and self.score[i] >= 3.0 and self.density(i) < 0.3
        if not around and tag[best] not in ("body", "html"):
            siblings = [i for i in range(1, n) if parent[i] == parent[best] and not self.hidden[i] and self.block_of[i] == i]
            for i in siblings:
                running = self.scored[i] and self.score[i] >= 3.0 or tag[i] in PARAGRAPHS and self.length[i] > 80
                chosen[i] |= running and self.density(i) < 0.3 or (tag[i] in ("h1", "h2") and i < best)
            kept = [i for i in siblings if chosen[i]]
            for i in siblings:  # what lies between is of the article too
                chosen[i] |= kept[0] < i < kept[-1] and self.density(i) <= 0.5
        for i in range(1, n):
            chosen[i] = chosen[i] or chosen[parent[i]]
        return chosen

    def text(self) -> str:
        best = self.best()
        if not best:
            return ""
        tag, parent = self.page.tag, self.page.parent
        chosen, menu = self.article(best), [False] * self.n
        for i in range(1, self.n):
            box = not self.inside[i] and tag[i] in ("ul", "ol", "dl", "div", "section", "table") and i != best and self.length[i] > 0 and self.density(i) > 0.5
            menu[i] = menu[parent[i]] or (box and self.link_words[i] < MENU_WORDS * max(1, self.links[i]))
        return "\n".join(text for node, text in self.blocks if chosen[node] and not menu[node])


def main_text(html: str | None) -> str:
    """The main text of a page; empty if it has none."""
    if not html:
        return ""
    page = parse(html)
    found = Tree(page, MAYBE)
    if not any(len(text) >= 25 and page.tag[found.block_of[node]] not in HEADINGS for node, text in found.blocks) and (NAMED in page.drop or MAYBE in page.drop):
        return Tree(page, DROP).text() or found.text()
    return found.text()


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    source = pages.select(F.col(id_col).cast("long").alias(id_col), F.col(url_col).cast("string").alias(url_col), F.col(html_col).alias("html"))
    return source.mapInArrow(run, f"`{id_col}` long, `{url_col}` string, text string, n_chars long")
