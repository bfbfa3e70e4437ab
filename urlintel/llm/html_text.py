"""Main-text extraction from HTML by minimum cut.

A page is cut into blocks of text. A linear classifier over each block's enclosing elements and wording gives the cost
of calling it content or boilerplate; these become capacities to the two terminals. Neighbouring blocks, and blocks
under the same parent, are tied by smoothness edges. The minimum cut, found by max-flow, labels all blocks at once.
A telling word in a class, id, role or label is a cost for what stands inside, which its text and its edges can
outweigh; elements that are boilerplate by their name, hidden ones, and boxes are settled. A box is a block-level element
with a class, id or itemprop that names comments, adverts, related pages, cookies or the like and besides only says what
part or place of the page that is (``comment-list``, ``relatedPosts``, but not ``has-comments`` or ``category-social``);
however long its text is, it is not the article's. An inline element with a telling
word is a block of its own up to its end tag; what is kept of a line of text is joined again.

Defined results: null or empty html gives an empty text; a page cut off anywhere is read as far as it goes; an element that
holds no text of the page (svg, object, ...) and isn't closed loses its tag only, but a script, style, title, textarea or
iframe takes the rest of the page; character references are decoded within a run of text, not across tags; white space
is whatever ``str.split`` splits at, no-break space included; ``<br>`` is white space; any length of page is read whole;
repeated rows give repeated results; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter, deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_slices

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|style|hidden|aria-hidden|aria-label|itemprop)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/]|\Z)""", re.I)
WORD = re.compile(r"[a-z]+")

# Elements by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg math iframe object textarea title head canvas audio video".split())
TEXT_ONLY = frozenset("script style title textarea iframe".split())  # unclosed, they take the rest of the page
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
BOILER_TAGS = frozenset("nav footer aside form menu dialog button select fieldset".split())
CONTENT_TAGS = frozenset("article main".split())
BOILER_WORDS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion promotions banner cookie cookies notice notices consent gdpr alert alerts popup modal overlay nav navbar navigation menu menus breadcrumb breadcrumbs sidebar rail footer masthead topbar comment comments discussion disqus replies reply respond share sharing social related recommended recommendations newsletter subscribe subscription widget widgets toolbar pagination pager login signup register search copyright legal disclaimer complementary contentinfo".split())
CONTENT_WORDS = frozenset("article content main post entry story body text articlebody mainentity".split())
COMMENT_BOXES = frozenset("comment comments commenter commenters commentlist disqus replies respond livefyre giscus utterances guestbook".split())
BOXES = COMMENT_BOXES | frozenset("ad ads advert adverts advertisement advertisements advertising adsbygoogle sponsor sponsored sponsors promo taboola outbrain related recommended recommendations cookie cookies gdpr consent sidebar newsletter subscribe share sharing social widget widgets breadcrumb breadcrumbs pagination pager popup".split())
PLACES = frozenset("a article articles area bar banner block blog body bottom box button buttons by col column container content count cta desktop entry feed footer for form google grid group head header heading holder icons id in inner item items label left link links list message mobile module more new news notice of on outer overlay page pages panel post posts region right row section site slot space sticky stories story strip text the thread title to top unit view wrap wrapper you your zone".split())
READERS = frozenset("buyer buyers customer customers guest guests reader readers user users visitor visitors".split())
BOX_JOINED = re.compile(r"\A(comments?|ads?|related|cookies?|share|social|newsletter|sponsored)(area|articles|banner|bar|block|body|box|buttons?|consent|container|content|form|links|lists?|notice|pages|popup|posts|section|slot|stories|threads?|units?|wrap|wrapper)\Z")
CLOSES = {"li": {"li"}, "p": {"p"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}

# Weights of the classifier: costs in favour of content when positive.
INSIDE_CONTENT, INSIDE_BOILER, INSIDE_BOX, HINT = 4.0, -6.0, -9.0, 1.5
# A class, id, role or label that only has words of boilerplate, and one that has such a word among others.
WHOLE, PART = -5.0, -2.0
BIAS, PER_LOG_WORD, LINKED, SENTENCE, HEADING = -1.6, 0.8, -4.0, 0.6, 0.5
# Weights of the smoothness edges.
NEXT, SAME_PARENT, FAR_APART = 0.3, 0.9, 0.05


class Block:
    __slots__ = ("context", "heading", "linked", "parent", "parts", "steps")

    def __init__(self, parent: int, context: float, heading: bool, steps: int):
        self.parts: list[str] = []
        self.linked = 0
        self.parent, self.context, self.heading, self.steps = parent, context, heading, steps


def boxed(token: str) -> tuple[bool, bool]:
    """Whether a class, id or itemprop names a box, and one of comments."""
    words = set(WORD.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", token).lower()))
    words = {part for w in words for part in BOX_JOINED.sub(r"\1 \2", w).split()}
    reviews = bool(words & {"review", "reviews"} and words & READERS)
    rest = words - BOXES - PLACES - READERS - ({"review", "reviews"} if reviews else set())
    return not rest and (reviews or bool(words & BOXES)), not rest and (reviews or bool(words & COMMENT_BOXES))


Context = tuple[float, float]  # for content by elements and words; cost of the words of boilerplate


def context_of(tag: str, attributes: str, above: Context) -> Context:
    """What the classifier says of all that stands in an element, from its name, class, id and role, and from what it stands in."""
    plain, cost = above
    hidden, box, telling, own = False, False, False, 0.0
    if attributes and tag not in ("html", "body"):
        for name, value in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'")
            if name in ("class", "id", "itemprop") and tag not in INLINE and tag != "main":
                box = box or any(boxed(t)[tag == "article"] for t in value.split())
            value = value.lower()
            if name in ("hidden", "aria-hidden") and value != "false" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                hidden = True
            elif name != "style":
                for token in [value] if name == "aria-label" else value.split():
                    words = set(WORD.findall(token))
                    boiler = words & BOILER_WORDS or words & {"header"} and plain + cost < INSIDE_CONTENT
                    if boiler:
                        own = min(own, WHOLE if boiler == words else PART)
                    telling = telling or not boiler and bool(words & CONTENT_WORDS)
    if box or plain <= INSIDE_BOX:
        return INSIDE_BOX, 0.0
    if hidden or tag in BOILER_TAGS or tag == "header" and plain + cost < INSIDE_CONTENT:
        return INSIDE_BOILER, 0.0
    if tag == "main":
        return INSIDE_CONTENT, own
    inside = plain <= INSIDE_BOILER or cost <= WHOLE
    if own <= WHOLE:
        plain = min(plain, 0.0)
    cost = min(cost, own)
    if tag == "article" and plain > INSIDE_BOILER:
        plain = max(plain, INSIDE_CONTENT if cost > WHOLE else HINT)
    elif tag == "article":
        plain += HINT
    elif telling and not inside:
        plain = max(plain, HINT)
    return plain, cost


def blocks_of(page: str) -> tuple[list[Block], list[list[tuple[Block, str]]]]:
    """The page's runs of text between block-level tags and telling inline ones, in order; and the lines between block-level tags, as pieces of these blocks."""
    out: list[Block] = []
    lines: list[list[tuple[Block, str]]] = []
    stack: list[tuple[str, Context, int, str]] = [("", (0.0, 0.0), 0, "")]  # tag, context, number of the element, attributes
    spans: list[tuple[str, int, bool, Block | None]] = []  # open inline elements: tag, place in the stack, whether they are on it, the block around
    opened: Counter[str] = Counter()
    made, links, at, steps = 0, 0, 0, 0
    now: Block | None = None
    line: list[tuple[Block, str]] | None = None
    gap = False
    end = len(page)

    def cut(k: int) -> None:
        del stack[k:]
        while spans and spans[-1][1] + spans[-1][2] > k:
            opened[spans.pop()[0]] -= 1

    while at < end:
        token = TOKEN.search(page, at)
        stop = token.start() if token else end
        if stop > at:
            piece = page[at:stop]
            if "&" in piece:
                piece = html.unescape(piece)
            if now is None and piece.isspace():
                gap = True
            elif now is None:
                tag, context, number, _ = stack[-1]
                now = Block(number, sum(context), tag in ("h1", "h2", "h3", "h4", "h5", "h6"), steps)
                out.append(now)
                steps = 0
            if now is not None:
                if line is None:
                    lines.append(line := [])
                line.append((now, f" {piece}" if gap else piece))
                gap = False
                now.parts.append(piece)
                if links:
                    now.linked += len(piece)
        if token is None:
            break
        at = token.end()
        closing, tag, attributes = (token[1], token[2], token[3]) if token[2] else (token[4], token[5], token[6])
        if not tag:
            continue
        tag = tag.lower()
        if tag == "a":
            links = 0 if closing else 1
        if tag in INLINE:
            if tag == "a" or tag in VOID:
                continue
            if closing:
                if not opened[tag]:
                    continue
                opened[tag] -= 1
                k = next(k for k in range(len(spans) - 1, -1, -1) if spans[k][0] == tag)
                _, place, pushed, around = spans.pop(k)
                if not pushed:
                    continue
                del stack[place]
                # What was opened inside and is still open stands where the element stood.
                spans[k:] = [(t, p - 1, x, b) for t, p, x, b in spans[k:]]
                for i in range(place, len(stack)):
                    stack[i] = (stack[i][0], context_of(stack[i][0], stack[i][3], stack[i - 1][1]), *stack[i][2:])
                now = around if place == len(stack) and line is not None and (around is None or any(b is around for b, _ in line)) else None
                steps += now is None
                continue
            context = context_of(tag, attributes, stack[-1][1]) if attributes else stack[-1][1]
            if attributes.endswith("/"):
                continue
            opened[tag] += 1
            if sum(context) >= sum(stack[-1][1]):
                spans.append((tag, len(stack), False, None))
                continue
            spans.append((tag, len(stack), True, now))
            made += 1
            steps += 1
            stack.append((tag, context, made, attributes))
            now = None
            continue
        elif tag == "br":
            if now is not None:
                now.parts.append(" ")
                line.append((now, " "))
            else:
                gap = True
            continue
        now = line = None
        gap = False
        steps += 1
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    cut(k)
                    break
            continue
        if tag in RAW and not attributes.endswith("/"):
            shut = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            if shut:
                at = shut.end()
            elif tag in TEXT_ONLY:
                at = end
            continue
        if tag in VOID or attributes.endswith("/"):
            continue
        shuts = CLOSES.get(tag, {"p"})
        k = len(stack) - 1
        while stack[k][0] in INLINE:
            k -= 1
        if stack[k][0] in shuts:
            cut(k)
        made += 1
        links = 0
        stack.append((tag, context_of(tag, attributes, stack[-1][1]), made, attributes))
    return out, lines


def tidy(parts: list[str]) -> str:
    return " ".join("".join(parts).split())


def score(block: Block, text: str) -> float:
    """The classifier: above 0 for content."""
    if block.context <= INSIDE_BOILER or block.context >= INSIDE_CONTENT:
        return block.context
    words = text.count(" ") + 1
    size = max(1, sum(map(len, block.parts)))
    return block.context + BIAS + PER_LOG_WORD * words.bit_length() + LINKED * block.linked / size + SENTENCE * (text[-1] in ".!?…\"'”»") + HEADING * block.heading


def min_cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay on the source's side: Dinic's max-flow over scores (terminals) and undirected edges."""
    n = len(scores)
    source, sink = n, n + 1
    to: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def join(a: int, b: int, forth: float, back: float) -> None:
        out[a].append(len(to))
        to.append(b)
        room.append(forth)
        out[b].append(len(to))
        to.append(a)
        room.append(back)

    for i, s in enumerate(scores):
        if s > 0:
            join(source, i, s, 0.0)
        elif s < 0:
            join(i, sink, -s, 0.0)
    for a, b, w in edges:
        join(a, b, w, w)
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if room[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [x >= 0 for x in level[:n]]
        tried = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                least = min(room[e] for e in path)
                for e in path:
                    room[e] -= least
                    room[e ^ 1] += least
                full = next(k for k, e in enumerate(path) if room[e] <= tiny)
                a = to[path[full] ^ 1]
                del path[full:]
                continue
            while tried[a] < len(out[a]):
                e = out[a][tried[a]]
                if room[e] > tiny and level[to[e]] == level[a] + 1:
                    break
                tried[a] += 1
            else:
                if a == source:
                    break
                e = path.pop()
                a = to[e ^ 1]
                tried[a] += 1
                continue
            path.append(e)
            a = to[e]


def smoothness(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Edges between neighbours, weaker the more tags stand between them, and between siblings."""
    edges, last = [], {}
    for i, b in enumerate(blocks):
        if i:
            edges.append((i - 1, i, max(FAR_APART, NEXT / max(1, b.steps))))
        if b.parent in last:
            edges.append((last[b.parent], i, SAME_PARENT))
        last[b.parent] = i
    return edges


def main_text(page: str | None) -> str:
    if not page:
        return ""
    every, lines = blocks_of(page)
    found = [(b, t) for b in every if (t := tidy(b.parts))]
    if not found:
        return ""
    blocks = [b for b, _ in found]
    content = min_cut([score(b, t) for b, t in found], smoothness(blocks))
    kept = {id(b) for b, keep in zip(blocks, content, strict=True) if keep}
    return "\n\n".join(t for line in lines if (t := tidy([piece if id(b) in kept else " " for b, piece in line])))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row a page: page_id, url, text, n_chars."""

    def make():
        def do(batch: pa.RecordBatch) -> pa.RecordBatch:
            text = [main_text(x) for x in batch.column(2).to_pylist()]
            return pa.record_batch([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

        return do

    columns = (F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return map_slices(pages.select(*columns), make, "page_id long, url string, text string, n_chars long")
