"""Main text of web pages by tree scoring.

The page is cut into tags and text by one tolerant regular expression and built into a tree (void elements, implied
end tags, raw-text elements, cut-off pages).  Elements that never hold the article - by name (navigation, footers,
forms, scripts ...) or by the words of their class, id or role (advert, cookie, sidebar, comments ...) - are pruned; forms, headers and those marked by words
only where they hold neither the page's main article nor nearly all its text, and something else is left.  Words that
articles use of themselves (related, search, social, header ...) prune only what is short or mostly links; the header
of an article stays where it holds a heading.
Each paragraph passes points for its length and commas to its ancestors, full to the parent, half to the
grandparent and less beyond; a container's points are discounted by its link density.  The best container, widened
to the article element around it, is kept with those siblings that score or read like it.

Every block of what is kept comes out in page order: character references decoded, white space (line breaks
included) as single spaces, trimmed, blocks joined by a blank line.  Nothing else is dropped or shortened.

Defined cases: null, empty and text-free pages give the empty text; pages without any scored paragraph give all text
that isn't pruned; repeated rows are extracted each; other columns are ignored; an empty table gives no rows.  A long
page is parsed whole, as a tree in one task's memory of a small multiple of its size.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z)|</?[a-zA-Z][^>]*(?:>|\Z)""", re.S)
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
UNSEEN = re.compile(r"hidden|display", re.I)
NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
WORDS = re.compile(r"[a-z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp svg math".split())
DROP = frozenset("head nav footer header aside form button select script style noscript iframe object canvas svg math template dialog menu textarea title fieldset audio video map".split())
BLOCK = frozenset("html body main article section div p pre blockquote ul ol li dl dt dd table caption thead tbody tfoot tr td th h1 h2 h3 h4 h5 h6 figure figcaption address details summary hr center header footer nav aside form fieldset hgroup".split())
PARAGRAPH = frozenset("p pre blockquote li dd td h1 h2 h3 h4 h5 h6 figcaption".split())
#: Opening one of these ends an open element of the set, unless an element of the second set lies between.
ENDS = {
    **dict.fromkeys("address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split(), (frozenset(["p"]), frozenset("button table td th caption object".split()))),
    "li": (frozenset(["li", "p"]), frozenset(["ul", "ol", "table"])),
    "dt": (frozenset(["dt", "dd", "p"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd", "p"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th", "p"]), frozenset(["table"])),
    "td": (frozenset(["td", "th", "p"]), frozenset(["table", "tr"])),
    "th": (frozenset(["td", "th", "p"]), frozenset(["table", "tr"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
#: Words of a class, id or role that mark what isn't the article.
AWAY = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist disqus respond replies consent cookie cookies gdpr notice notices "
    "footer footnav masthead topbar menu menus nav navbar navigation navigational sidebar sidebars aside widget widgets sponsor sponsored sponsors promo promos "
    "promoted newsletter subscribe subscription signup login popup modal overlay pagination pager toolbar skip searchbox contentinfo outbrain taboola".split()
)
#: Words that mark the same, but that parts of articles carry too: only short or linked blocks go.
PERHAPS = frozenset("foot header rail share sharing social promotion related recommended recommendations search complementary".split())
#: Before a word of these it says what a block lacks or has beside it.
BESIDE = frozenset("no with has without hide".split())
ARTICLE = frozenset("article entry post story content".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements among DROP that are kept where the article lies in them, as those marked by a word are.
WRAPPERS = frozenset("header aside form dialog fieldset".split())
SOFT, HARD, LOOSE = 1, 2, 3
#: A block of at least so many characters, at most a quarter of them linked, is prose.
PROSE = 200
SAFE = frozenset(["html", "body", "article", "main"])


class Node:
    __slots__ = ("name", "parent", "kids", "points", "away", "size", "linked")

    def __init__(self, name: str, parent: Node | None, away: int = 0):
        self.name, self.parent, self.away = name, parent, away
        self.kids: list[Node | str] = []
        self.points = 0.0
        self.size = self.linked = 0


def _hidden(attributes: str) -> bool:
    """By the attributes ``hidden`` and ``aria-hidden`` or the style; not by words inside other values."""
    if not UNSEEN.search(attributes):
        return False
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").strip().lower()
        if name == "hidden" and not value.startswith("until") or name == "aria-hidden" and value == "true" or name == "style" and NO_DISPLAY.search(value):
            return True
    return False


def _away(name: str, attributes: str) -> int:
    if name in DROP and name not in WRAPPERS:
        return HARD
    if name in SAFE:
        return 0
    if attributes and _hidden(attributes):
        return HARD
    if name in WRAPPERS:
        return SOFT
    loose = 0
    for m in NAMED.finditer(attributes):
        value = re.sub(r"([a-z])([A-Z])", r"\1 \2", m[1] or m[2] or m[3] or "").lower()
        named = [WORDS.findall(x) for x in value.split()]
        words = [w for found in named for w, before in zip(found, ["", *found]) if before not in BESIDE]
        if not AWAY.isdisjoint(words):
            return SOFT
        if not PERHAPS.isdisjoint(words):
            loose = 0 if "header" in words and not ARTICLE.isdisjoint(words) else LOOSE
    return loose


def _settle(root: Node) -> None:
    """Loosely marked blocks that read as prose stay, and headers inside an article that hold a heading."""
    order, todo, loose = [], [(root, False)], False
    while todo:
        x, inside = todo.pop()
        order.append((x, inside))
        loose = loose or x.away == LOOSE or x.away == SOFT and x.name == "header"
        todo += [(k, inside or x.name in ("article", "main")) for k in x.kids if type(k) is Node and k.away != HARD]
    if not loose:
        return
    size: dict[Node, tuple[int, int, bool]] = {}
    for x, inside in reversed(order):
        kids = [size[k] for k in x.kids if type(k) is Node and k.away != HARD]
        own = sum(len(k.strip()) for k in x.kids if type(k) is str) + sum(k[0] for k in kids)
        linked = own if x.name == "a" else sum(k[1] for k in kids)
        titled = x.name in HEADING or any(k[2] for k in kids)
        size[x] = own, linked, titled
        if x.away == LOOSE:
            x.away = 0 if own >= PROSE and 4 * linked < own or inside and titled and 4 * linked < own else SOFT
        elif x.away == SOFT and x.name == "header" and inside and titled and 4 * linked < own:
            x.away = 0


def _restore(root: Node) -> None:
    """Keep what is softly pruned but holds the page's main article, or nearly all of its text outside links."""
    order, todo = [], [(root, False)]
    while todo:
        x, pruned = todo.pop()
        pruned = pruned or x.away == SOFT
        order.append((x, pruned))
        todo += [(k, pruned) for k in x.kids if type(k) is Node and k.away != HARD and k.name != "a"]
    if not any(pruned for _, pruned in order):
        return
    prose: dict[Node, int] = {}
    free = 0
    for x, pruned in reversed(order):
        own = sum(len(k.strip()) for k in x.kids if type(k) is str)
        prose[x] = own + sum(prose.get(k, 0) for k in x.kids if type(k) is Node)
        free += 0 if pruned else own
    articles = [(x, pruned) for x, pruned in order if x.name in ("article", "main") and prose[x]]
    if any(not pruned for _, pruned in articles):
        return
    up: Node | None = max((x for x, _ in articles), key=prose.__getitem__, default=None)
    if up is not None and prose[up] > free:
        while up is not None:
            up.away, up = 0, up.parent
        return
    for x, _ in order:
        if x.away and prose[x] > 0.9 * prose[root]:
            x.away = 0


def parse(page: str) -> Node:
    root = at = Node("#root", None)
    pos, n = 0, len(page)
    while pos < n:
        m = TAG.search(page, pos)
        if not m:
            at.kids.append(page[pos:])
            break
        if m.start() > pos:
            at.kids.append(page[pos: m.start()])
        pos = m.end()
        if m[2] is None or page[m.end() - 1] != ">":  # a comment, or a tag cut off by the page's end
            continue
        name = m[2].lower()
        if m[1]:
            up: Node | None = at
            while up is not None and up.name != name:
                if name in ("b", "i", "em", "strong", "a", "span") and up.name in BLOCK:
                    up = None  # a stray inline end tag doesn't close a block
                    break
                up = up.parent
            if up is not None and up.parent is not None:
                at = up.parent
            continue
        if name in ENDS:
            ended, walls = ENDS[name]
            up = at
            while up is not None and up.name not in walls:
                if up.name in ended and up.parent is not None:
                    at = up.parent
                up = up.parent
        node = Node(name, at, _away(name, m[3]))
        at.kids.append(node)
        if name in RAW and not (name in ("svg", "math") and m[3].endswith("/")):
            end = re.compile(rf"</{name}\b[^>]*>?", re.I).search(page, pos)
            pos = end.end() if end else n
        elif name not in VOID and not m[3].endswith("/"):
            at = node
    return root


def _measure(node: Node) -> None:
    """Text lengths and link lengths, and points passed from paragraphs; without recursion, pages may nest deeply."""
    order, todo = [], [node]
    while todo:
        x = todo.pop()
        order.append(x)
        todo += [k for k in x.kids if type(k) is Node and not k.away]
    for x in reversed(order):
        commas = 0
        for k in x.kids:
            if type(k) is str:
                size = len(k.strip())
                x.size += size
                commas += k.count(",") + k.count("，") + k.count("、")
            elif not k.away:
                x.size += k.size
                x.linked += k.size if k.name == "a" else k.linked
        if x.name in PARAGRAPH or x.name in ("div", "section", "article", "main", "body", "center") and any(type(k) is str and len(k.strip()) > 25 for k in x.kids):
            if x.size:
                points = (1 + commas + min(x.size / 100, 3)) * (1 - x.linked / x.size)
                own = x.name not in PARAGRAPH
                up, level = (x if own else x.parent), 0
                while up is not None and level < 5:
                    up.points += points / (1, 2, 6, 9, 12)[level]
                    up, level = up.parent, level + 1


def _density(x: Node) -> float:
    return x.linked / x.size if x.size else 0.0


def _inside(node: Node) -> bool:
    """Whether neither it nor anything around it is pruned."""
    up: Node | None = node
    while up is not None:
        if up.away:
            return False
        up = up.parent
    return True


def _chosen(root: Node) -> list[Node]:
    best, top, todo = None, 0.0, [root]
    while todo:
        x = todo.pop()
        if x.points > 0 and x.name not in PARAGRAPH and (score := x.points * (1 - _density(x))) > top:
            best, top = x, score
        todo += [k for k in x.kids if type(k) is Node and not k.away]
    if best is None or best.parent is None:
        return [root]
    up = best
    while up is not None:
        if up.name in ("article", "main"):
            best = up
            if up.name == "article" and not any(type(k) is Node and k.name == "article" and k is not up for k in (up.parent.kids if up.parent else [])):
                break
        up = up.parent
    kept = []
    for k in best.parent.kids:
        if k is best:
            kept.append(k)
        elif type(k) is Node and not k.away and k.size:
            score, dense = k.points * (1 - _density(k)), _density(k)
            least = max(10, 0.2 * top)
            if best.name not in ("article", "main") and dense < 0.25:
                least = min(0.2 * top, max(1, k.size / 100))  # a short section of prose passes by its own size
            if k.name not in PARAGRAPH and score >= least or k.name in PARAGRAPH and k.name != "li" and (k.size > 80 and dense < 0.25 or 0 < k.size <= 80 and dense == 0 and best.name not in ("article", "main")):
                kept.append(k)
    return kept


def extract(page: str | None) -> str:
    """The page's main text."""
    if not page:
        return ""
    root = parse(page)
    _settle(root)
    _restore(root)
    _measure(root)
    text = _text(_chosen(root))
    if not text:  # nothing but what is softly pruned
        todo = [root]
        while todo:
            x = todo.pop()
            x.away = x.away if x.away == HARD else 0
            todo += [k for k in x.kids if type(k) is Node and k.away != HARD]
        text = _text([root])
    return text


def _text(kept: list[Node]) -> str:
    blocks, run = [], []

    def flush() -> None:
        text = " ".join(entities.unescape("".join(run)).split())
        if text:
            blocks.append(text)
        run.clear()

    for top in kept:
        flush()
        todo: list = [top]
        while todo:
            x = todo.pop()
            if x is None:
                flush()
            elif type(x) is str:
                run.append(x)
            elif not x.away:
                if x.name == "br":
                    run.append(" ")
                elif x.name in BLOCK or x.parent is None:
                    flush()
                    todo.append(None)
                    todo += reversed(x.kids)
                else:
                    todo += reversed(x.kids)
        flush()
    return "\n\n".join(blocks)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            text = [extract(h.as_py()) for h in part.column("html")]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], ["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
