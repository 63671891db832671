"""Main text of web pages by tree scoring.

Every paragraph earns points for its length and its commas and passes them to its ancestors, less to farther ones. A
container's points are discounted by the share of its text that stands in links. The best container and those of its
siblings that read like text are kept; what is marked up or named as something else (menus, notices, comments) is not.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import append

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""", re.S)
HINT = re.compile(r"""(?:\b(?:class|id|role|aria-label|itemprop)\s*+=\s*+)(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?=[\s=/]|$)|aria-hidden\s*+=\s*+["']?true|display\s*+:\s*+none|visibility\s*+:\s*+hidden""", re.I)
# What HTML says of its elements, and names that pages give to what is not the article.
RAW = frozenset("script style textarea title noscript iframe noframes noembed xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1
 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption search""".split())
CLOSES_P = BLOCKS - frozenset("body html td th tr tbody thead tfoot caption".split())
DROPPED = RAW | frozenset("template svg math object audio video canvas select head nav footer aside button input label menu dialog search".split())
#: What holds controls, unless it turns out to hold the page's paragraphs, as on pages that are one form.
FORMS = frozenset("form fieldset".split())
LISTED = {"li": ("li", ("ul", "ol", "menu", "dir")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)),
          "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
BOILER = re.compile(r"""(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menus?|breadcrumbs?|side-?bar|footers?|site-?header
 |page-?header|masthead|top-?bar|comments?|comment-?list|disqus|respond|replies|reply|cookies?|consent|gdpr|notices?|alerts?|popup|modal
 |overlay|newsletter|subscri\w+|signup|login|share|sharing|social|related|recommend\w*|more-?stories|tags?|widget|toolbar|pagination|pager
 |skip-?link|copyright|legal|disclaimer|search\w*|navigation|complementary|contentinfo)(?=$|[\s_-])""".replace("\n ", ""), re.I)
# A word behind one of these says what an element has or is about, not what it is; the second kind only beside an article's name.
MODIFIED = re.compile(r"(?<![a-z])(?:with|without|no|has)[-_]+[^\s]*", re.I)
TOPIC = re.compile(r"(?:^|(?<=\s))(?:tag|category|topic|type|format|status)-[^\s]*", re.I)
ROLE_MAIN = re.compile(r"""\brole\s*+=\s*+["']?main\b""", re.I)
# Names of what readers write, which can outweigh a short article.
REPLIES = re.compile(r"(?:^|[\s_-])(?:comments?|comment-?list|disqus|respond|replies|reply)(?=$|[\s_-])", re.I)
ARTICLE = re.compile(r"(?:^|[\s_-])(?:article\w*|body|content|entry\w*|main|post|story|text|hentry)(?=$|[\s_-])", re.I)
SPACE = re.compile(r"\s+")
#: Points of a paragraph: one, one for each comma, one for each 100 characters up to three.
LENGTH_UNIT, LENGTH_MOST = 100, 3
LINKED = 0.5
#: Share of links above which a list or table is a menu where it stands before or behind all paragraphs of an unmarked container.
LINKS_ONLY = 0.9
#: Share of the page's unlinked points above which an element named as something else is the article after all: where names
#: speak for it, and where none do.
MOST, NEARLY_ALL = 0.5, 0.8
#: Points of a paragraph that may be an article by itself.
PARAGRAPH = 3
#: Characters from which on a text without links reads as a sentence, if it ends like one.
SENTENCE, SENTENCE_ENDS = 25, tuple(".!?…:。！？»”\"')")


HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def boiler_name(hints: str) -> bool:
    """Whether a name says that the element is something else than the article."""
    hints = MODIFIED.sub(" ", hints)
    if any(ARTICLE.fullmatch(word) for word in hints.split()):
        hints = TOPIC.sub(" ", hints)
    return bool(BOILER.search(hints))


def joined(parts: list) -> tuple[str, int]:
    """Text and linked characters of the parts of a block."""
    text = SPACE.sub(" ", html.unescape("".join(p[1] for p in parts))).strip()
    return text, min(sum(p[2] for p in parts), len(text))


class Node:
    """An element. What holds for it and all below it is set when it opens; sums over what is below it come later, from the last
    element to the first. Elements are numbered in page order: ``at``, and ``end`` behind the last one below."""
    __slots__ = ("tag", "parent", "at", "end", "children", "dropped", "boost", "named", "form", "replies", "main", "block", "in_article", "namer",
                 "under_replies", "score", "chars", "linked", "points", "clear", "kept", "gone", "inner", "holds_main")

    def __init__(self, tag: str, parent, at: int, dropped: bool, boost: float, named: bool = False, replies: bool = False, main: bool = False):
        self.tag, self.parent, self.at, self.end, self.children = tag, parent, at, at + 1, []
        self.dropped, self.boost, self.named, self.form, self.replies, self.main = dropped, boost, named, tag in FORMS, replies, main
        self.block = self if parent is None or tag in BLOCKS else parent.block
        self.in_article = tag in ("article", "main") or (parent is not None and parent.in_article)
        self.under_replies = replies or (parent is not None and parent.under_replies)
        #: The innermost element, itself included, that only scoring can keep.
        self.namer = self if named or self.form else parent.namer if parent is not None else None
        self.score, self.chars, self.linked, self.points, self.clear = 0.0, 0, 0, 0.0, 0.0
        self.kept = self.gone = self.inner = self.holds_main = False
        if parent is not None:
            parent.children.append(self)

    def around(self, other) -> bool:
        """Whether ``other`` is this element or stands in it."""
        return self.at <= other.at < self.end


class Page:
    """Blocks of one page: text, the element it stands in, and its linked characters."""

    def __init__(self, source: str):
        self.root = Node("html", None, 0, False, 0.0)
        self.nodes, self.stack, self.open = [self.root], [self.root], Counter(["html"])
        self.blocks: list[tuple[Node, str, int]] = []
        #: Blocks as read: the innermost block element, and (element, text, linked characters) of its parts.
        self.pieces: list[tuple[Node, list[tuple[Node, str, int]]]] = []
        self.parts: list[tuple[Node, str, int]] = []
        self.read(source)
        self.flush()
        for node in reversed(self.nodes[1:]):
            node.parent.end = max(node.parent.end, node.end)

    def flush(self) -> None:
        """Ends a block; its text belongs to the innermost block element that is open."""
        if self.parts:
            self.pieces.append((self.stack[-1].block, self.parts))
            self.parts = []

    def text(self, piece: str) -> None:
        if piece and not self.stack[-1].dropped:
            self.parts.append((self.stack[-1], piece, len(piece.strip()) if self.open["a"] else 0))

    def close_to(self, depth: int) -> None:
        """Closes the open elements from ``depth`` on."""
        if any(n.tag in BLOCKS for n in self.stack[depth:]):
            self.flush()
        self.open.subtract(n.tag for n in self.stack[depth:])
        del self.stack[depth:]

    def nearest(self, tags, stops) -> int:
        if not any(self.open[t] for t in tags):
            return 0
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag in tags:
                return i
            if self.stack[i].tag in stops:
                return 0
        return 0

    def opened(self, tag: str, attributes: str) -> None:
        if tag in ("html", "body"):
            return
        if tag == "br" or tag == "hr":
            self.parts.append((self.stack[-1], " ", 0))
        if tag in CLOSES_P and (at := self.nearest(("p",), ("table", "button", "object", "td", "th"))):
            self.close_to(at)
        if tag in LISTED:
            closes, stops = LISTED[tag]
            if at := self.nearest(closes.split(), stops):
                self.close_to(at)
        if tag in BLOCKS:
            self.flush()
        if tag in VOID or (tag in ("svg", "math") and attributes.endswith("/")):
            return
        hints = " ".join(a or b or c for a, b, c in HINT.findall(attributes)) if attributes else ""
        parent = self.stack[-1]
        boiler = bool(hints and tag not in ("article", "main") and boiler_name(hints))
        dropped = (parent.dropped or tag in DROPPED or (tag == "header" and not parent.in_article)
                   or bool(attributes and HIDDEN.search(attributes)))
        boost = 25.0 if tag in ("article", "main") or (hints and ARTICLE.search(hints)) else 0.0
        node = Node(tag, parent, len(self.nodes), dropped, boost, boiler, boiler and bool(REPLIES.search(hints)), tag == "main" or bool(ROLE_MAIN.search(attributes)))
        self.nodes.append(node)
        self.stack.append(node)
        self.open[tag] += 1

    def closed(self, tag: str) -> None:
        if tag == "p" and not self.nearest(("p",), ()):
            self.flush()
            return
        at = self.nearest((tag,), ("table", "td", "th") if tag not in BLOCKS else ())
        if at:
            self.close_to(at)

    def read(self, source: str) -> None:
        at, n = 0, len(source)
        while at < n:
            start = source.find("<", at)
            if start < 0:
                self.text(source[at:])
                return
            token = TOKEN.match(source, start)
            if token is None:  # a bare sign
                self.text(source[at:start + 1])
                at = start + 1
                continue
            self.text(source[at:start])
            at = token.end()
            slash, name, attributes = (token[1], token[2], token[3]) if token[2] else (token[4], token[5], token[6])
            if not name or at == n and source[-1] != ">":
                continue  # a comment, a declaration, or a tag that the page's end cuts off
            name = name.lower()
            if slash:
                self.closed(name)
                continue
            if name in RAW and not (attributes or "").endswith("/"):
                end = re.compile(f"</{re.escape(name)}(?=[\\s/>])[^>]*+>", re.I).search(source, at)
                at = end.end() if end else n
                continue
            self.opened(name, attributes or "")

    def settle(self) -> None:
        """Drops the elements that are named as something else, but for those that turn out to hold the article."""
        if any(top.namer for _, parts in self.pieces for top, *_ in parts):
            self.decide()
        self.pass_down()
        for node, parts in self.pieces:
            text, linked = joined([p for p in parts if not p[0].gone])
            if text:
                self.blocks.append((node, text, linked))

    def pass_down(self) -> None:
        """Tells every element whether it is below one that scoring has dropped."""
        for node in self.nodes:
            node.gone = ((node.named or node.form) and node.dropped) or (node.parent is not None and node.parent.gone)

    def add_up(self, names: tuple[str, ...]) -> None:
        """Adds what elements hold to those above them."""
        for node in reversed(self.nodes[1:]):
            for name in names:
                value = getattr(node, name)
                if value:
                    setattr(node.parent, name, getattr(node.parent, name) + value)

    def decide(self) -> None:
        # A paragraph's parts under different names count apart.
        held, every = [], 0.0
        for node, parts in self.pieces:
            under: dict = {}
            for part in parts:
                under.setdefault(id(part[0].namer), []).append(part)
            for own in under.values():
                text, linked = joined(own)
                if text:
                    plain = node.tag not in HEADINGS and linked <= LINKED * len(text)
                    top, points = own[0][0], self.points(node, text) if plain else 0.0
                    points *= 1 - linked / len(text)
                    held.append((top, points))
                    every += points
                    top.points += points
                    top.clear += 0.0 if top.under_replies else points
                    top.chars += len(text)
                    top.linked += linked
        self.add_up(("points", "clear", "chars", "linked"))
        marks = [n for n in self.nodes if n.boost and not n.named and n.clear]
        for n in marks:
            up = n if n.points > MOST * every else None
            while up is not None and not up.inner:
                up.inner, up = True, up.parent
            up = n if n.main else None
            while up is not None and not up.holds_main:
                up.holds_main, up = True, up.parent
        # Marks under no name, those with most points first.
        free = sorted((n for n in marks if not self.under_name(n)), key=lambda n: -n.points)

        def elsewhere(node: Node) -> float:
            """Most points that an article's mark under no name has outside ``node``."""
            most, up = 0.0, node.parent
            while up is not None:
                if up.boost and not up.named and up.clear:
                    most = max(most, up.points - node.points)
                up = up.parent
            for n in free:
                if n.points <= most or not (node.around(n) or n.around(node)):
                    return max(most, n.points)
            return most

        for node in self.nodes:
            if not (node.named or node.form) or not node.chars:
                continue
            share = node.points / every if every else 0.0
            if node.form and not node.named:
                node.dropped = node.dropped or not (share > MOST and node.points >= PARAGRAPH or node.inner or node.holds_main)
                continue
            marked = node.boost > 0 or node.inner
            node.dropped = not (node.holds_main or node.linked <= LINKED * node.chars and (
                share >= 1 if node.replies else share > MOST and marked and elsewhere(node) <= (1 - NEARLY_ALL) * every
                or share > NEARLY_ALL and elsewhere(node) < PARAGRAPH))
        self.pass_down()
        left = [(top, points) for top, points in held if points and not top.gone]
        if sum(points for _, points in left) < PARAGRAPH and not any(self.boosted(top) for top, _ in left):
            # Names would leave no paragraph; on this page they tell nothing.
            for node in self.nodes:
                if node.named and node.chars:
                    node.dropped = node.dropped and (node.replies or node.form or node.linked > LINKED * node.chars)

    @staticmethod
    def under_name(node: Node) -> bool:
        while node is not None and node.namer is not None:
            if node.namer.named:
                return True
            node = node.namer.parent
        return False

    @staticmethod
    def boosted(node: Node | None) -> bool:
        while node is not None and not node.boost:
            node = node.parent
        return node is not None

    @staticmethod
    def points(node: Node, text: str) -> float:
        return 0.5 if node.tag in HEADINGS else 1 + text.count(",") + min(len(text) // LENGTH_UNIT, LENGTH_MOST)

    def main_text(self) -> str:
        self.settle()
        for node in self.nodes:
            node.chars = node.linked = 0
        for node, text, linked in self.blocks:
            points = self.points(node, text)
            share, up = 1.0, node if node.tag not in ("p", "pre", "blockquote", "li", "td", "dd", "dt", "tr") else node.parent
            while up is not None and share > 1e-9:  # what is farther up gets nothing that could be seen
                up.score += points * share
                share /= 2
                up = up.parent
            node.chars += len(text)
            node.linked += linked
        self.add_up(("chars", "linked"))
        found, best, most = [self.root], self.root, -1.0
        while found:
            node = found.pop()
            found += [c for c in node.children if not c.dropped]
            if node.chars and node.tag not in ("p", "li", "a", "b", "i", "span"):
                worth = (node.score + node.boost) * (1 - node.linked / node.chars)
                if worth > most or (worth == most and node.tag in ("article", "main")):
                    best, most = node, worth
        while best.parent is not None and best.tag not in BLOCKS:
            best = best.parent
        return "\n".join(text for node, text, _ in self.article(best))

    def article(self, best: Node) -> list[tuple[Node, str, int]]:
        """The blocks of ``best``, of its siblings that are article too, and what their parent says itself."""
        best.kept = True
        floor = max(10.0, 0.2 * (best.score + best.boost))
        own: dict[int, list[tuple[str, int]]] = {}
        for node, text, linked in self.blocks:
            own.setdefault(node.at, []).append((text, linked))
        for near in best.parent.children if best.parent is not None else ():
            if near is best or near.dropped or not near.chars:
                continue
            density = near.linked / near.chars
            if (near.tag == "h1" or (near.score + near.boost) * (1 - density) >= floor or (near.tag == "p" and density < 0.25 and near.chars > 80)
                    or (near.tag in HEADINGS and not near.linked and near.at < best.at) or self.is_section(near, best, own)):
                near.kept = True
        for node in self.nodes[1:]:
            node.kept = node.kept or node.parent.kept
        marked = best.in_article or self.boosted(best)
        kept = []
        for block in self.blocks:
            node, text, linked = block
            if node.kept or (node is best.parent and reads(text, linked)):
                kept.append(block)
        plain = [i for i, (node, text, linked) in enumerate(kept) if node.tag not in HEADINGS and linked <= LINKED * len(text)]
        inside = range(plain[0], plain[-1] + 1) if plain else range(0)
        return [block for i, block in enumerate(kept) if marked or i in inside or not self.link_list(block[0], best)]

    def is_section(self, near: Node, best: Node, own: dict) -> bool:
        """Whether a sibling of the best container has paragraphs that read as text: a short section beside a long one."""
        if near.tag not in ("p", "section", "article", "div", "blockquote") or near.linked > 0.25 * near.chars:
            return False
        inside = [self.nodes[i] for i in range(near.at, near.end)] if near.tag != "p" else [near]
        return any(reads(text, linked) for n in inside if n.tag in ("p", "blockquote") and not n.gone for text, linked in own.get(n.at, ()))

    @staticmethod
    def link_list(node: Node, best: Node) -> bool:
        """Whether the block stands in a list or table inside ``best`` that holds links and hardly anything else."""
        while node is not None and node is not best:
            if node.tag in ("ul", "ol", "dl", "table") and node.linked > LINKS_ONLY * node.chars:
                return True
            node = node.parent
        return False


def reads(text: str, linked: int) -> bool:
    """Whether a block reads as a sentence and not as a label, a menu or a notice of rights."""
    return len(text) >= SENTENCE and linked <= 0.25 * len(text) and text.endswith(SENTENCE_ENDS) and "©" not in text


def main_text(source: str | None) -> str:
    return Page(source).main_text() if source else ""


def extract(pages: DataFrame, source: str = "html") -> DataFrame:
    """``pages`` with text string, the main text of column ``source``. Rows stay where they are.

    Null, empty and textless pages give the empty text. White space inside a block becomes one blank, blocks are joined by
    a line feed in page order; nothing is cut. Repeated rows get equal results, an empty table stays empty, a column named
    text is replaced.
    """
    @F.pandas_udf("text string")
    def texts(pages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"text": [main_text(p) for p in pages]})

    return append(pages, texts(F.col(source)), ["text"])
