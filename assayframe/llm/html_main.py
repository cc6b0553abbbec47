"""Main text of web pages by consensus host paths.

Pass one scores the containers of every page and each page votes for the generalised tag-class path of its best
one; Spark adds the votes up per host. Pass two extracts from the containers at the paths that the host prefers, if they
hold a fair part of the page, and else from the page's own best container.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from hashlib import blake2b
from urllib.parse import urlsplit

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, text_slices

#: Winning paths are broadcast up to this many bytes and joined by a salted shuffle beyond.
BROADCAST_BYTES, SALTS = 8 << 20, 64
#: A path wins with this part of the votes of its host's first one.
WINNING_PART = 0.5
#: The part of a page's prose that winning containers must hold, and that a name can't take away from a page.
FAIR_PART, OVERRULING_PART = 0.3, 0.5
#: Characters of a block outside paragraphs from which it counts as prose.
PROSE = 40

_RAW = frozenset("script style noscript template textarea iframe title xmp noembed noframes".split())
_DROP = frozenset("nav footer aside button menu dialog head select datalist svg canvas object audio video map".split())
_INLINE_DROP = frozenset("label".split())
_BOX = frozenset("html body main article section div td th table thead tbody tfoot tr ul ol dl li dd dt figure blockquote fieldset details center header form hgroup search".split())
_BLOCK = frozenset("p h1 h2 h3 h4 h5 h6 pre figcaption caption summary address legend".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
_PROSE_TAGS = frozenset("p pre blockquote".split()) | _HEADING
_VOID = frozenset("br hr img input meta link area base col embed source track wbr param".split())
#: What an opening tag closes, and what it doesn't look beyond.
_ENDS = {
    "li": ("li", ("ul", "ol", "menu")), "dd": ("dd dt", ("dl",)), "dt": ("dd dt", ("dl",)), "td": ("td th", ("tr", "table")),
    "th": ("td th", ("tr", "table")), "tr": ("tr", ("table", "tbody", "thead", "tfoot")), "tbody": ("tbody thead tfoot", ("table",)),
    "thead": ("tbody thead tfoot", ("table",)), "tfoot": ("tbody thead tfoot", ("table",)),
}
_COMMENTS = frozenset("comment comments commentlist disqus replies".split())
_FURNITURE = _COMMENTS | frozenset(
    "ad ads advert adverts advertisement advertisements advertising adslot banner banners sponsor sponsors sponsored promo promos promoted cookie "
    "cookies consent gdpr notice notices alert alerts popup popups modal modals overlay newsletter newsletters subscribe subscription "
    "signup login share sharing breadcrumb breadcrumbs menu menus nav navs navbar navigation topbar toolbar sidebar sidebars footer footers "
    "masthead pagination pager widget widgets".split()
)
#: Words that furniture and articles both use: as a part of a longer name they count only where links make up the content.
_PERHAPS = frozenset("side rail header headers head foot related recommend recommended recommendation recommendations social respond discussion toc skip hidden".split())
_NOISE_ROLE = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar".split())
#: Attributes follow the tokenizer's states: a quote opens a value only right after "=". Nothing is tried twice.
_TAG = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)|</(?=[^a-zA-Z])[^>]*+(?:>|\Z)|"
    r"<(/?)([a-zA-Z][^\s/>]*+)((?>[\s/=]++|[^\s/>=]++(?>\s*+=\s*+(?>\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>\"'][^\s>]*+|(?=>)))?+)*+)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"([^\s/>=]++)(?>\s*+=\s*+(?>\"([^\"]*+)\"?|'([^']*+)'?|([^\s>]++)))?+")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for t in _RAW}
_USED = frozenset("class id role hidden aria-hidden style".split())
_INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_SAYS_WITH = re.compile(r"^(?:has|with|no|without|is)[-_]", re.I)
_DIGITS = re.compile(r"\d+")
_WHITE = re.compile(r"\s+")
#: Words that say nothing of what a container holds; digits don't either.
_FILLER = frozenset(
    "container wrapper wrap box bar section area list block inner outer left right top bottom site page main primary secondary item items link links button "
    "buttons panel row col column content global module slot unit group post posts entry entries article title text small large desktop mobile".split()
)
#: Verdicts on a container: plain; furniture only if it is made of links; also if it is a small part of a page without an article; furniture unless it holds most of
#: the page, in an article only if it is small; the same without regard to articles (forms); readers' comments; furniture.
PLAIN, IF_LINKS, IF_SMALL, UNLESS_MOST, FORM, COMMENTS, GONE = range(7)
#: A small part of an article, or of the page, that holds no heading.
SMALL_PART = 0.2


class Box:
    """An element that matters: its place in the tree, generalised path, verdict and the text below it."""

    __slots__ = ("path", "parent", "tag", "verdict", "dropped", "chars", "links", "holds")

    def __init__(self, path: str, parent: Box | None, tag: str, verdict: int):
        self.path, self.parent, self.tag, self.verdict = path, parent, tag, verdict
        self.dropped = self.holds = False
        self.chars = self.links = 0


class Block:
    """A run of text between block boundaries, in pieces (box, text, whether linked)."""

    __slots__ = ("box", "tag", "pieces")

    def __init__(self, box: Box, tag: str, pieces: list[tuple[Box, str, bool]]):
        self.box, self.tag, self.pieces = box, tag, pieces

    def text(self) -> str:
        return _WHITE.sub(" ", "".join(html.unescape(t) for b, t, _ in self.pieces if not b.dropped)).strip()


def _attributes(raw: str) -> dict[str, str]:
    """The attributes that verdicts and paths need; the first of equal names counts."""
    out: dict[str, str] = {}
    if raw.strip():
        for name, a, b, c in _ATTR.findall(raw):
            if (name := name.lower()) in _USED:
                out.setdefault(name, html.unescape(a or b or c))
    return out


def generalised(tag: str, classes: str) -> str:
    """``tag.class1.class2`` with digits dropped, so that numbered classes of a host agree."""
    return ".".join([tag, *sorted({_DIGITS.sub("", c.lower()) for c in classes.split()} - {""})])


def _named(attributes: dict[str, str]) -> int:
    """What class and id say. A whole name is furniture; a part of it, as in ``modal-verbs``, is a hint that only links confirm."""
    worst = PLAIN
    for name in [*attributes.get("class", "").split(), *attributes.get("id", "").split()]:
        if _SAYS_WITH.match(name):  # such as "has-sidebar", which tells of a neighbour
            continue
        words = {w.lower() for w in _WORDS.findall(name)} - _FILLER
        known = words & (_FURNITURE | _PERHAPS)
        if not known:
            continue
        if known != words:
            found = IF_LINKS
        elif words <= _COMMENTS:
            found = COMMENTS
        else:
            found = UNLESS_MOST if words & _FURNITURE else IF_SMALL
        worst = max(worst, found)
    return worst


def verdict(tag: str, attributes: dict[str, str], parent: Box) -> int:
    if tag in _DROP or "hidden" in attributes or attributes.get("role", "").lower() in _NOISE_ROLE or _INVISIBLE.search(attributes.get("style", "")):
        return GONE
    named = _named(attributes) if tag not in _HEADING and ("class" in attributes or "id" in attributes) else PLAIN
    if tag in ("html", "body", "main", "article"):
        return named if named == COMMENTS and tag == "article" else PLAIN
    if tag == "header":  # that of an article is its head
        while parent is not None and parent.tag not in ("article", "main", "section"):
            parent = parent.parent
        return max(named, GONE if parent is None else PLAIN)
    if tag in ("form", "fieldset", "legend", "label") or attributes.get("aria-hidden", "").lower() == "true" or attributes.get("role", "").lower() == "form":
        return COMMENTS if named == COMMENTS else FORM
    return named


def walk(source: str) -> tuple[list[Box], list[Block]]:
    """Containers of a page, parents first, and its text blocks in order; verdicts are settled by what the page holds."""
    root = Box("", None, "", PLAIN)
    boxes, stack, blocks = [root], [root], []
    pieces: list[tuple[Box, str, bool]] = []
    linked = False

    def flush() -> None:
        if pieces:
            if any(not t.isspace() for _, t, _ in pieces):
                inner = stack[-1]
                while inner.tag not in _BOX and inner.tag not in _BLOCK and inner.parent is not None:
                    inner = inner.parent
                blocks.append(Block(inner, inner.tag, pieces.copy()))
            pieces.clear()

    def close(names: str, beyond: tuple[str, ...] = ()) -> None:
        """Closes the innermost open element of these names, unless one of ``beyond`` comes first."""
        wanted = names.split()
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in wanted:
                del stack[i:]
                return
            if stack[i].tag in beyond:
                return

    at, n = 0, len(source)
    while at < n:
        cut = source.find("<", at)
        if cut < 0:
            cut = n
        if cut > at:
            pieces.append((stack[-1], source[at:cut], linked))
        if cut >= n:
            break
        m = _TAG.match(source, cut)
        if not m:  # a lone "<" is text
            pieces.append((stack[-1], "<", linked))
            at = cut + 1
            continue
        at = m.end()
        closing, tag = m[1], (m[2] or "").lower()
        if not tag:
            continue
        if tag in _RAW:
            if not closing:
                end = _RAW_END[tag].search(source, at)
                at = end.end() if end else n
                if tag != "title":
                    pieces.append((stack[-1], " ", linked))
            continue
        if tag in _VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                pieces.append((stack[-1], " ", linked))
            continue
        block = tag in _BLOCK or tag in _BOX or tag in _DROP
        if tag == "a":
            linked = not closing
        if block:
            flush()
            if closing:
                if any(b.tag == tag for b in stack):
                    close(tag)
                continue
            close("p", ("td", "th", "table", "button", "object"))
            if tag in _ENDS:
                close(*_ENDS[tag])
            if tag in _HEADING and stack[-1].tag in _HEADING:
                stack.pop()
        elif closing:
            if stack[-1].tag == tag:  # inline elements stand on the stack only where they are furniture
                stack.pop()
            continue
        attributes = _attributes(m[3]) if m[3] else {}
        found = verdict(tag, attributes, stack[-1]) if attributes or tag in _DROP or tag in ("header", "form", "fieldset", "legend", "label") else PLAIN
        if not block and found == PLAIN:
            continue
        if m[3].endswith("/") and tag in ("svg", "object", "canvas"):
            continue
        parent = stack[-1]
        path = f"{parent.path}>{generalised(tag, attributes.get('class', ''))}"
        if len(path) > 1000:  # deep pages: the head of the path by its digest
            path = f"#{blake2b(parent.path.encode('utf-8', 'surrogatepass'), digest_size=16).hexdigest()}>{path[len(parent.path) + 1 :]}"
        box = Box(path, parent, tag, found)
        boxes.append(box)
        stack.append(box)
    flush()
    _settle(boxes, blocks)
    return boxes, blocks


def _sums(boxes: list[Box], blocks: list[Block]) -> None:
    for box in boxes:
        box.chars = box.links = 0
    for block in blocks:
        for box, text, linked in block.pieces:
            if not box.dropped:
                size = 0 if text.isspace() else len(text)
                box.chars += size
                box.links += size if linked else 0
    for box in reversed(boxes):
        if box.parent is not None and not box.dropped:
            box.parent.chars += box.chars
            box.parent.links += box.links


def _comments(boxes: list[Box], within: dict[int, Box | None]) -> None:
    """Settles comments: outside an article, and as a post of their own, they go; in an article a section of that name needs the structure of a list
    of posts: two containers of one path, or a form."""
    named = [b for b in boxes if b.verdict == COMMENTS]
    for box in named:
        if within[id(box)] is None or box.tag in ("article", "li"):
            box.verdict = GONE
            continue
        inside, paths = {id(box)}, []
        for other in boxes:
            if id(other.parent) in inside:
                inside.add(id(other))
                if other.tag in ("article", "section", "div", "li", "form"):
                    paths.append(other.path)
        box.verdict = GONE if len(set(paths)) < len(paths) or any(p.rsplit(">", 1)[1].startswith("form") for p in paths) else PLAIN


def _settle(boxes: list[Box], blocks: list[Block]) -> None:
    """Drops what the verdicts and the sizes of containers say, and adds up the rest."""
    # The article around each container; a page without one may have a main part instead.
    for holder in ("article", "main"):
        within: dict[int, Box | None] = {}
        for box in boxes:
            above = None if box.parent is None else within[id(box.parent)]
            within[id(box)] = above if above is not None or box.tag != holder or box.verdict != PLAIN else box
        own = [b for b in boxes if within[id(b)] is b]
        if holder == "article":
            _comments(boxes, within)
        if own:
            break
    for box in boxes:
        box.dropped = box.verdict == GONE or (box.parent is not None and box.parent.dropped)
    headed = {id(b.box) for b in blocks if b.tag in _HEADING and not b.box.dropped}
    for box in reversed(boxes):
        if box.parent is not None and not box.dropped:
            if box.tag in ("article", "main") or box.holds:
                box.parent.holds = True
            if id(box) in headed:
                headed.add(id(box.parent))
    _sums(boxes, blocks)
    # What a name says can be overruled by size, but outside the article not where the page has one.
    page = boxes[0].chars - boxes[0].links
    marked = any(b.tag in ("article", "main") and not b.dropped and b.chars for b in boxes)
    most = float("inf") if marked else OVERRULING_PART * page
    changed = False
    for box in boxes:
        if box.parent is not None and box.parent.dropped:
            changed |= not box.dropped
            box.dropped = True
        elif not box.dropped and box.verdict != PLAIN and not box.holds:
            worth, article = box.chars - box.links, within[id(box)]
            whole = page if article is None else article.chars - article.links
            small = worth <= SMALL_PART * whole and id(box) not in headed
            box.dropped = 2 * box.links > box.chars
            if box.verdict == FORM or (box.verdict == UNLESS_MOST and article is None):
                box.dropped = worth <= most
            elif box.verdict == UNLESS_MOST or (box.verdict == IF_SMALL and article is None):
                box.dropped |= small
            changed |= box.dropped
    if changed:
        _sums(boxes, blocks)


def _is_prose(block: Block) -> bool:
    free = sum(len(t) for b, t, linked in block.pieces if not b.dropped and not linked)
    each = sum(len(t) for b, t, _ in block.pieces if not b.dropped and not t.isspace())
    return 2 * free > each > 0 and (block.tag in _PROSE_TAGS or free >= PROSE)


def best(boxes: list[Box], blocks: list[Block]) -> Box:
    """The page's main container: from the root down as long as one child holds half of the prose and what stands beside it is
    none, or the child is the page's article."""
    # Prose blocks below each box.
    prose: dict[int, int] = defaultdict(int)
    kept = [b for b in blocks if not b.box.dropped]
    for block in kept:
        if _is_prose(block):
            prose[id(block.box)] += 1
    kids: dict[int, list[Box]] = defaultdict(list)
    for box in reversed(boxes):
        if box.parent is not None and not box.dropped:
            prose[id(box.parent)] += prose[id(box)]
            if box.tag in _BOX:
                kids[id(box.parent)].append(box)
    at = boxes[0]
    while own := kids[id(at)]:
        top = max(reversed(own), key=lambda b: b.chars - b.links)
        worth, whole = top.chars - top.links, at.chars - at.links
        if worth <= 0 or 2 * worth < whole:
            break
        alone = top.tag in ("article", "main") and sum(b.tag == top.tag for b in own) == 1
        if not alone and prose[id(at)] > prose[id(top)]:
            break
        if top.tag in ("li", "tr", "td", "dd", "dt", "tbody", "blockquote", "figure"):
            break
        at = top
    return at


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def votes(pages: DataFrame) -> DataFrame:
    """(host, path, votes, points): what each page prefers, added up; partial sums leave the tasks. Pages without a host
    don't vote."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, str], list[int]] = defaultdict(lambda: [0, 0])
        schema = pa.schema({"host": pa.string(), "path": pa.string(), "votes": pa.int64(), "points": pa.int64()})

        def out() -> pa.RecordBatch:
            rows = [(h, p, v, s) for (h, p), (v, s) in seen.items()]
            seen.clear()
            return pa.RecordBatch.from_pydict(dict(zip(schema.names, map(list, zip(*rows, strict=True)), strict=True)), schema=schema)

        for batch in batches:
            for url, source in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
                host = host_of(url) if source else ""
                if host:
                    box = best(*walk(source))
                    if box.path and box.chars:
                        cell = seen[host, box.path]
                        cell[0] += 1
                        cell[1] += box.chars - box.links
            if len(seen) > 50_000:
                yield out()
        if seen:
            yield out()

    return (
        pages.select("url", "html")
        .mapInArrow(run, "host string, path string, votes long, points long")
        .groupBy("host", "path")
        .agg(F.sum("votes").alias("votes"), F.sum("points").alias("points"))
    )


def winning_paths(pages: DataFrame, part: float = WINNING_PART) -> DataFrame:
    """(host, paths): the paths with ``part`` of the votes of the host's first one at least: some 1 / part of them, or as many as tie."""
    most = Window.partitionBy("host")
    return (
        votes(pages)
        .withColumn("most", F.max("votes").over(most))
        .where(F.col("votes") >= part * F.col("most"))
        .groupBy("host")
        .agg(F.array_sort(F.collect_list(F.struct((-F.col("votes")).alias("v"), (-F.col("points")).alias("s"), "path"))).alias("p"))
        .select("host", F.col("p.path").alias("paths"))
    )


def _common(a: Box, b: Box, depth: dict[int, int]) -> Box:
    while a is not b:
        if depth[id(a)] >= depth[id(b)]:
            a = a.parent
        else:
            b = b.parent
    return a


def main_text(source: str | None, paths: list[str] | None) -> str:
    """Text of the container that the winning ``paths`` share, if what stands at them is a fair part of the page's prose, and
    else of the page's own best container. Ties fall to the outer container."""
    if not source:
        return ""
    boxes, blocks = walk(source)
    wanted = set(paths or ())
    matched = [b for b in boxes if b.path in wanted and not b.dropped and b.chars > b.links]
    chosen = None
    if matched:
        depth = {id(boxes[0]): 0}
        for box in boxes[1:]:
            depth[id(box)] = depth[id(box.parent)] + 1
        ids = {id(b) for b in matched}
        outer, under = [], set()
        for box in boxes[1:]:  # parents come first
            if id(box.parent) in under or id(box.parent) in ids:
                under.add(id(box))
            elif id(box) in ids:
                outer.append(box)
        held = sum(b.chars - b.links for b in outer)
        if held >= FAIR_PART * (boxes[0].chars - boxes[0].links):
            chosen = outer[0]
            for box in outer[1:]:
                chosen = _common(chosen, box, depth)
    if chosen is None:
        chosen = best(boxes, blocks)
    inside = {id(chosen)}
    for box in boxes:
        if id(box.parent) in inside:
            inside.add(id(box))
    texts = (b.text() for b in blocks if not b.box.dropped and id(b.box) in inside)
    return " ".join(t for t in texts if t)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page.

    Nulls: a null html gives an empty text; pages with a null or malformed url stand alone, by their own best container.
    Empty, deep and very long pages are treated whole, repeated rows each give a row. Votes of one path add up over a host, so a
    host of any size is a few sums. Empty table: no rows. Other columns are ignored.
    """
    winners = staged(winning_paths(pages), "paths")
    size = winners.agg(F.sum(F.length("host") + F.length(F.array_join("paths", "")))).first()[0] or 0
    source = pages.select("page_id", "url", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "html"):
                known = part.column("paths").to_pylist()
                texts = [main_text(s, p) for s, p in zip(part.column("html").to_pylist(), known, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    @F.pandas_udf("string")
    def host(url: pd.Series) -> pd.Series:
        return url.map(host_of)

    hosted = source.withColumn("host", host("url"))
    if size <= BROADCAST_BYTES:
        joined = hosted.join(F.broadcast(winners), "host", "left")
    else:  # a large host is dealt out over SALTS tasks
        salted = winners.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = hosted.withColumn("salt", F.pmod(F.xxhash64("page_id", "html"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")
    page_kind = dict(source.dtypes)["page_id"]
    return joined.select("page_id", "url", "html", "paths").mapInArrow(
        run, f"page_id {page_kind}, url string, text string, n_chars long"
    )
