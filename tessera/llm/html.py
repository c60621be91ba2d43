"""Main text of web pages by scoring the element tree.

Each block of text gives points for its length and commas to the elements around
it, the nearest first; an element's points are discounted by its share of linked
text. The best container is kept, and of what stands beside it, or beside an element around it, that which has little linked text,
without menus, notices, adverts, forms, comments and other furniture. The time is in
proportion to the page: each character is looked at a bounded number of times.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noscript noframes noembed xmp template".split())
DROPPED = frozenset("head nav footer aside button select option input label fieldset dialog svg math canvas object audio video map menu script style textarea title iframe noscript noframes noembed template".split())
BLOCKS = frozenset(
    "html body address article blockquote center dd details dir div dl dt fieldset figcaption figure form h1 h2 h3 h4 h5 h6 header hgroup hr li main ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
PARAGRAPHS = frozenset("p li dd dt td th pre blockquote figcaption caption summary h1 h2 h3 h4 h5 h6".split())
CLOSES_P = BLOCKS - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
#: Which open elements a new one ends, and where the search for them stops.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("table", "tr")),
    "th": (("td", "th"), ("table", "tr")),
    "tbody": (("tbody", "thead", "tfoot"), ("table",)),
    "tfoot": (("tbody", "thead", "tfoot"), ("table",)),
}
#: Words of class, id and role that name page furniture.
FURNITURE = frozenset(
    "ad ads adbox advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist complementary consent contentinfo cookie cookies disqus dialog footer gdpr header hidden login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promotion related respond search share sharing sidebar signup skyscraper social sponsor sponsored subscribe toolbar topbar widget widgets".split()
)
#: What comes before or after such a word where the name tells of a page's state or layout.
STATE_BEFORE = frozenset("has no not with without hide show".split())
STATE_AFTER = frozenset("open closed enabled disabled".split())
#: Those of them that name reader comments.
COMMENTS = frozenset("comment comments commentlist disqus respond".split())
#: Those of them that name adverts, notices and sign-ups wherever they stand in a name.
SURE = frozenset(
    "ad ads adbox advert adverts advertisement advertising adsense consent cookie cookies gdpr login newsletter promo promotion signup skyscraper sponsor sponsored subscribe".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: In an article, what such a name is part of only goes with this share of its text in links.
LINKED = 0.25
#: Ancestors that a block's points are passed to at most.
LEVELS = 32
#: Unlinked characters that an element further out than the best one and its siblings has to have to be kept.
FAR = 80
#: A named element with this share of the unlinked text is no furniture, where no article stands apart from it.
MOST = 0.5
#: Paragraphs of an advert or the like that holds most of its article: it isn't closed where it should be.
PARAGRAPHS_OF_MOST = 3
#: Elements inside each other at most; those further in are taken as part of the last one.
DEEPEST = 512
#: So many tags with quotes that aren't closed, and quotes aren't looked at any more.
UNCLOSED = 16

_OTHER = r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>"
_PLAIN = r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>"
_TAG = re.compile(_OTHER + r"""|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""" + _PLAIN, re.S)
_TAG_WITHOUT_QUOTES = re.compile(_OTHER + r"|<(?!)()()()" + _PLAIN, re.S)
_COMMENT = re.compile(r"<!--.*", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAMED = re.compile(r"class|id\b|role|hidden|style", re.I)
_HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def is_furniture(tag: str, attributes: str, inside_article: bool) -> bool:
    """Whether the element goes with all that is in it, whatever that is."""
    if tag in DROPPED:
        return True
    if tag == "header" and not inside_article:
        return True
    if tag in ("html", "body", "main") or not attributes or not _NAMED.search(attributes):
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), unescape(m[2] or m[3] or m[4] or "")
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return True
        if name == "style" and _HIDDEN_STYLE.search(value):
            return True
    return False


def named_furniture(tag: str, attributes: str) -> tuple[str, bool] | None:
    """The word of a class, id or role that names furniture, one for comments first, and whether such words are the whole name."""
    if tag in ("html", "body", "main"):
        return None
    found = (tag, True) if tag == "form" else None
    if not attributes or not _NAMED.search(attributes):
        return found
    for m in _ATTRIBUTE.finditer(attributes):
        if m[1].lower() in ("class", "id", "role"):
            for word in unescape(m[2] or m[3] or m[4] or "").split():
                parts = [x for x in re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", word).lower()) if x]
                if parts and parts[0] not in STATE_BEFORE and parts[-1] not in STATE_AFTER and not FURNITURE.isdisjoint(parts):
                    if not COMMENTS.isdisjoint(parts):
                        return "comments", True
                    named = next((x for x in parts if x in SURE), None) or next(x for x in parts if x in FURNITURE)
                    whole = named in SURE or FURNITURE.issuperset(parts)
                    found = (named, whole or (found is not None and found[1]))
    return found


class Tree:
    """Elements in page order, and the blocks of text in them."""

    def __init__(self) -> None:
        self.tag, self.parent = ["#root"], [-1]
        #: (element, text, linked characters)
        self.blocks: list[tuple[int, str, int]] = []
        #: Elements named as furniture: the word that names them, and whether that is the whole name.
        self.named: dict[int, tuple[str, bool]] = {}

    @classmethod
    def parse(cls, html: str) -> Tree:
        tree = cls()
        stack, pieces, linked = [0], [], 0
        dropped: list[str] = []
        #: How many elements of a name are open, in ``dropped``, and too far in to be kept.
        opened, in_dropped, beyond = Counter(), Counter(), Counter()
        links, articles = 0, 0

        def end_block() -> None:
            nonlocal linked
            if pieces:
                text = " ".join("".join(pieces).split())
                if text:
                    at = len(stack) - 1
                    while at and tree.tag[stack[at]] not in BLOCKS:
                        at -= 1
                    tree.blocks.append((stack[at], text, min(linked, len(text))))
                pieces.clear()
            linked = 0

        def add_text(text: str) -> None:
            nonlocal linked
            if text and not dropped:
                text = unescape(text) if "&" in text else text
                pieces.append(text)
                if links:
                    linked += len(text.strip())

        def close(at: int) -> None:
            """Close the elements from place ``at`` of the stack on."""
            nonlocal links, articles
            if any(tree.tag[x] in BLOCKS for x in stack[at:]):
                end_block()
            for x in stack[at:]:
                links -= tree.tag[x] == "a"
                articles -= tree.tag[x] in ("article", "main")
                opened[tree.tag[x]] -= 1
            del stack[at:]

        def find(names: tuple[str, ...], until: tuple[str, ...]) -> int:
            if not any(opened[x] for x in names):
                return 0
            for at in range(len(stack) - 1, 0, -1):
                if tree.tag[stack[at]] in names:
                    return at
                if tree.tag[stack[at]] in until:
                    return 0
            return 0

        at, size, last, unclosed = 0, len(html), html.rfind(">") + 1, 0
        while at < size:
            # behind the last > there are no tags
            m = (_TAG if unclosed < UNCLOSED else _TAG_WITHOUT_QUOTES).search(html, at, last) if at < last else None
            if not m:
                add_text(_COMMENT.sub("", html[at:]))
                break
            unclosed += m[5] is not None
            if m.start() > at:
                add_text(html[at : m.start()])
            at = m.end()
            name = m[2] or m[5]
            if not name:
                if m[0].startswith("<![CDATA["):
                    add_text(m[0][9:].removesuffix("]]>").replace("&", "&amp;"))
                elif m[0].startswith("<!--") and not m[0].endswith("-->"):
                    break
                continue
            name, attributes = name.lower(), (m[3] if m[2] else m[6]) or ""
            if m[1] or m[4]:
                if dropped:
                    if in_dropped[name]:
                        while (gone := dropped.pop()) != name:
                            in_dropped[gone] -= 1
                        in_dropped[name] -= 1
                    elif name in ("body", "html"):
                        dropped.clear()
                        in_dropped.clear()
                elif beyond[name]:
                    beyond[name] -= 1
                    if name in BLOCKS:
                        end_block()
                elif name == "br":
                    add_text(" ")
                elif found := find((name,), () if name in ("body", "html") else ("td", "th", "table") if name not in BLOCKS else ()):
                    close(found)
                elif name == "p":
                    end_block()
                continue
            if name in RAW and name not in ("noscript", "template"):
                rest = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(html, at)
                at = size if not rest else html.find(">", rest.start()) + 1 or size
                continue
            if name in VOID:
                if not dropped:
                    if name == "hr":
                        end_block()
                    elif name == "br":
                        add_text(" ")
                continue
            if dropped:
                if name == "body" and dropped == ["head"]:
                    dropped.clear()
                    in_dropped.clear()
                else:
                    dropped.append(name)
                    in_dropped[name] += 1
                    continue
            if name == "p" or name in CLOSES_P:
                if found := find(("p",), ("td", "th", "table", "li", "article", "section", "div", "blockquote")):
                    close(found)
            if name in ENDS and (found := find(*ENDS[name])):
                close(found)
            named = named_furniture(name, attributes)
            if is_furniture(name, attributes, articles > 0) or (named and name not in BLOCKS):
                if name in BLOCKS or name in DROPPED:
                    end_block()
                dropped.append(name)
                in_dropped[name] += 1
                continue
            if name in BLOCKS:
                end_block()
            if len(stack) > DEEPEST:
                beyond[name] += 1
                continue
            opened[name] += 1
            tree.tag.append(name)
            tree.parent.append(stack[-1])
            stack.append(len(tree.tag) - 1)
            if named:
                tree.named[len(tree.tag) - 1] = named
            links += name == "a"
            articles += name in ("article", "main")
        end_block()
        if tree.named:
            tree.drop_named()
        return tree

    def drop_named(self) -> None:
        """Drop the blocks of elements named as furniture.

        Where no article or main element with text stands outside of all of them, those stay that hold
        one (under no other name in between), and those with MOST of the page's unlinked text. Inside an article
        those stay that have MOST of it, in several paragraphs, and those of which such a word is only part of the name, if it
        isn't a SURE one and few of their words are links; so do its own headers. Comments only stay around the only article.
        """
        n = len(self.tag)
        text, linked, paragraphs, under, article = [0] * n, [0] * n, [0] * n, [-1] * n, [0] * n
        for node, words, in_links in self.blocks:
            text[node] += len(words) - in_links
            linked[node] += in_links
            paragraphs[node] += self.tag[node] in PARAGRAPHS
        for i in range(n - 1, 0, -1):
            text[self.parent[i]] += text[i]
            linked[self.parent[i]] += linked[i]
            paragraphs[self.parent[i]] += paragraphs[i]
        for i in range(1, n):
            under[i] = i if i in self.named else under[self.parent[i]]
            article[i] = i if self.tag[i] in ("article", "main") else article[self.parent[i]]
        articles = [i for i in range(n) if self.tag[i] in ("article", "main") and text[i]]
        stay: set[int] = set()
        held: set[int] = set()
        if all(under[i] >= 0 for i in articles):
            held = {under[i] for i in articles if under[i] != i} or {i for i in articles if under[i] == i}
        for i, (name, whole) in self.named.items():
            around = article[self.parent[i]]
            most = name != "comments" and text[i] >= MOST * text[around] > 0
            if around:
                weak = name == "header" or not whole
                most = (most and paragraphs[i] >= PARAGRAPHS_OF_MOST) or (weak and linked[i] < LINKED * (text[i] + linked[i]))
            elif articles:
                most = False
            if i in held or most:
                while i > 0 and i not in stay:
                    stay.add(i)
                    i = self.parent[i]
        gone = [False] * n
        for i in range(1, n):
            gone[i] = gone[self.parent[i]] or (i in self.named and i not in stay)
        self.blocks = [x for x in self.blocks if not gone[x[0]]]

    def scores(self) -> list[float]:
        """Points of each element, discounted by the share of linked text in it."""
        n = len(self.tag)
        points, text, linked = [0.0] * n, [0] * n, [0] * n
        for node, words, in_links in self.blocks:
            text[node] += len(words)
            linked[node] += in_links
            worth = (1 if len(words) >= 25 else 0.25) + words.count(",") + min(len(words) / 100, 3)
            worth *= 1 - in_links / len(words)
            up, level = (self.parent[node] if self.tag[node] in PARAGRAPHS else node), 0
            while up > 0 and level < LEVELS:
                points[up] += worth / (1, 2)[level] if level < 2 else worth / (3 * level)
                up, level = self.parent[up], level + 1
        for node in range(n - 1, 0, -1):
            text[self.parent[node]] += text[node]
            linked[self.parent[node]] += linked[node]
        self.text, self.linked = text, linked
        return [p * (1 - linked[i] / text[i]) if text[i] else 0.0 for i, p in enumerate(points)]

    def kept(self) -> set[int]:
        """The best container and the siblings that go with it; all, where nothing has points."""
        score = self.scores()
        best = max(range(len(score)), key=lambda i: (score[i], -i))
        if score[best] <= 0:
            return {0}
        up = best
        while up > 0 and self.tag[up] not in ("article", "main"):
            up = self.parent[up]
        named = up > 0 and self.linked[up] < 0.5 * self.text[up]
        best = up if named else best
        least = max(10.0, 0.2 * score[best])
        solid = {node for node, words, _ in self.blocks if self.tag[node] in PARAGRAPHS or len(words) >= 80}
        for node in sorted(solid, reverse=True):
            while node > 0 and self.parent[node] not in solid:
                node = self.parent[node]
                solid.add(node)
        found, around, up = {best}, set(), self.parent[best]
        while up >= 0:
            around.add(up)
            up = self.parent[up]
        for i in range(1, len(self.tag)):
            if self.parent[i] not in around or i in around or i == best or not self.text[i]:
                continue
            few = self.linked[i] < LINKED * self.text[i]
            beside = self.parent[i] == self.parent[best]
            if named:
                # beside an article only what scores like one, other articles, and the title before it
                keep = (beside and (score[i] >= least or (self.tag[i] == "article" and few))) or (self.tag[i] == "h1" and i < best and few)
            else:
                # elsewhere all paragraphs and what holds some; further out only those of some length
                keep = (beside and score[i] >= least) or (i in solid and few and (beside or self.text[i] - self.linked[i] >= FAR))
            if keep:
                found.add(i)
        return found


def main_text(html: str | None) -> str:
    """The blocks of the article, one a line; white space inside a block is one space."""
    tree = Tree.parse(html or "")
    if not tree.blocks:
        return ""
    kept = tree.kept()
    inside = [i in kept for i in range(len(tree.tag))]
    for i in range(1, len(inside)):
        inside[i] = inside[i] or inside[tree.parent[i]]
    return "\n".join(text for node, text, _ in tree.blocks if inside[node])


def extract_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """All columns of pages but html, with text and n_chars (code points) added.

    A page that is null, empty or has no text gives an empty text. Broken markup is read as
    browsers do in the main: implied ends, unclosed and stray tags. Repeated pages give equal
    rows; columns named text or n_chars are replaced. Pages of any length are read whole, in time in proportion to their length; of elements inside
    each other beyond DEEPEST the text is that of the last one. An empty table gives an empty one.
    """
    kept = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    source = pages.select(*kept, F.col(html).cast("string").alias("_html"))
    names = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in kept)

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = [main_text(x.as_py()) for x in part.column(part.num_columns - 1)]
                columns = [*part.columns[:-1], pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, "text", "n_chars"])

    return source.mapInArrow(run, f"{names}, text string, n_chars long")
