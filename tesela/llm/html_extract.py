"""Main text of web pages by tag-path ratios.

A page is read once into blocks of text, each with its path of block elements from the root. For every path the text
length, the number of blocks, punctuation and linked text are added up; length and punctuation by block are smoothed over
the page's sequence of blocks, fused, and paths at or above a share of their deviation are content. The deepest element
that holds nearly all content is the article; all its blocks belong to the text, short ones, linked ones and headings too.
Elements that are never content by name, role or class (menus, page headers, footers, fields, adverts, comments) take no
part, nor do hidden ones. A class or id says so if it names reader comments ("post-comments"), or is made of such words and
words of layout alone ("ad", "menu-list") and none beside it names content; the element of one that only holds such a word
("has-sidebar", "legal-analysis"), or a form, which may be wrapped around a page, goes if no path in it is content and no
block in it has half the ratio that content has on average.

Where names leave nothing at all, only those of comments count. Of blocks that stand in the page itself, without an element
around the article, those between the first content and the last stay, and headings above it; blocks of links go.

Elements are rows of parent links, so a page takes memory and time in proportion to its length, however deep it is nested.

Defined results: null or empty html, or a page without such blocks, gives an empty text; unclosed and stray tags are
mended as browsers do for paragraphs, items and cells; a line break inside a block is white space; an empty table makes no
rows; repeated rows are extracted each; other columns are not handed on; a very long page is read whole."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesela.llm.common import col, release, small_batches, table

#: Share of the deviation of fused ratios that a content path reaches; share of the content that the article holds.
THRESHOLD, HOLDS = 0.8, 0.8

# Names of HTML elements and words of classes, ids and roles.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
NEVER = frozenset("aside button datalist dialog footer frameset head iframe input label legend menu nav noframes noscript object optgroup option search select svg canvas audio video map template textarea".split())
RAW = frozenset("script style title textarea iframe noframes noscript xmp template svg".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertisements adsense banner sponsor sponsored promo promotion promoted cookie cookies consent gdpr notice notices notification alert popup overlay modal newsletter subscribe subscription signup login signin register menu nav navbar navigation breadcrumb breadcrumbs pagination pager toc sidebar aside widget widgets related recommended recommendations share sharing social comment comments commentlist disqus reply replies respond discussion footer foot masthead topbar toolbar search skip copyright legal disclaimer tags outbrain taboola paywall header".split()
)
#: Names with these words are reader comments whatever stands beside them, unless it says whether there are any; some need a second word.
COMMENTS, COMMENTS_OF = frozenset("comment comments commentlist disqus respond".split()), {"discussion": frozenset("thread threads board forum".split()), "replies": frozenset("list thread".split())}
STATES = frozenset("no not has have with without open opened close closed enable enabled disable disabled allow allowed on off".split())
#: Words of classes and ids that say how an element is laid out, and those that name content.
LAYOUT = frozenset("area bar box buttons container icons inner item items links list posts slot unit wrap wrapper".split())
CONTENT = frozenset("article body content entry main page post story text".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An opening tag of the first kind ends an open element of the second, unless one of the third stands between.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""", re.S)
_END = {tag: re.compile(f"</{tag}", re.I) for tag in RAW}
#: A whole attribute, name and value together, so that nothing inside a value or a longer name is taken for one.
_ATTR = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
_UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.I)
_WORD = re.compile(r"[A-Za-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_PUNCT = re.compile(r"[.,;:!?…、。，！？¿¡]")
_BLANK = re.compile(r"\s+")


def _comments(words: list[str]) -> bool:
    """Whether a name stands for reader comments."""
    return not STATES.intersection(words) and any(w in COMMENTS or COMMENTS_OF.get(w, STATES).intersection(words) for w in words)


def _hinted(value: str, inside: bool, hints: bool) -> int:
    """2 if a name of a class or id is one of reader comments, or made of hints alone and none names content; 1 if a hint is
    among its words, else 0. Without `hints` only comments count."""
    names = [[w.lower() for w in _WORD.findall(_CAMEL.sub(" ", name))] for name in value.split()]
    if any(map(_comments, names)):
        return 2
    hint = lambda w: hints and w in HINTS and not (inside and w == "header")
    if not any(hint(w) for ws in names for w in ws):
        return 0
    return 2 if any(any(map(hint, ws)) and all(hint(w) or w in LAYOUT for w in ws) for ws in names) and not any(w in CONTENT for ws in names for w in ws) else 1


def _shunned(tag: str, attrs: str, inside: bool, hints: bool = True) -> int:
    """2 for an element that is never content, 1 for one that may not be; `inside` an article, a header is its headline."""
    if tag in NEVER or (tag == "header" and not inside):
        return 2
    level = int(tag in ("form", "fieldset"))
    if attrs and tag not in ("html", "body", "article", "main", "h1"):
        for name, *values in _ATTR.findall(attrs):
            name, value = name.lower(), next((v for v in values if v), "")
            if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and _UNSEEN.search(value)):
                return 2
            if name == "role" and value.strip().lower() in ROLES:
                return 2
            if name in ("class", "id"):
                level = max(level, _hinted(value, inside, hints))
    return level


@dataclass
class Block:
    """A block's text, the number of its path, its element, its linked characters, and the nearest element around it that
    may not be content (0: none), with how many of these there are."""

    text: str
    path: int
    element: int
    linked: int
    doubtful: int
    doubts: int


class _Page:
    """Blocks of a page in order, and its block elements: parent (a smaller number), tag, and the doubtful one around each."""

    def __init__(self, html: str, hints: bool = True):
        self.hints = hints
        self.blocks: list[Block] = []
        self.parent, self.tag, self.around = [0], [""], [0]
        self.paths: dict[tuple[int, str], int] = {}
        # open elements: tag, block element, shunned, path, inside an article, nearest doubtful element, number of these
        self.stack: list[tuple[str, int, bool, int, bool, int, int]] = [("", 0, False, 0, False, 0, 0)]
        self.places: dict[str, list[int]] = {}  # places in the stack of the open elements of a tag
        self.open_blocks = [0]  # and of all block elements
        self.parts: list[str] = []
        self.links = self.linked = 0
        at, last = 0, html.rfind(">") + 1
        for m in iter(lambda: _TAG.search(html, at, last), None):
            if m.start() > at:
                self.text(html[at : m.start()])
            at = m.end()
            slash, tag, attrs = m[1] or m[4] or "", m[2] or m[5], m[3] or m[6] or ""
            if not tag:
                continue
            tag = tag.lower()
            if slash:
                self.close(tag)
                continue
            self.open(tag, attrs)
            if tag in RAW and not attrs.endswith("/"):
                end = _END[tag].search(html, at)
                at = end.start() if end else len(html)
        if at < len(html) and not html.startswith("<!--", at):
            self.text(html[at:])
        self.flush()

    def text(self, raw: str) -> None:
        if not self.stack[-1][2] and self.stack[-1][0] not in RAW:
            raw = unescape(raw) if "&" in raw else raw
            self.parts.append(raw)
            if self.links:
                self.linked += len(raw)

    def flush(self) -> None:
        if self.parts:
            text = _BLANK.sub(" ", "".join(self.parts)).strip()
            if text:
                _, element, _, path, _, doubtful, doubts = self.stack[-1]
                self.blocks.append(Block(text, path, element, self.linked, doubtful, doubts))
            self.parts = []
        self.linked = 0

    def last(self, tags: Iterable[str]) -> int:
        """The place of the innermost open element of one of the tags, 0 for none."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def pop(self, to: int) -> None:
        """Closes all elements from that place on."""
        if self.open_blocks[-1] >= to:
            self.flush()
        while len(self.stack) > to:
            tag = self.stack.pop()[0]
            self.places[tag].pop()
            self.links -= tag == "a"
        while self.open_blocks[-1] >= to:
            self.open_blocks.pop()

    def open(self, tag: str, attrs: str) -> None:
        if tag == "br":
            self.parts.append(" ")
        if tag in BLOCKS:
            self.flush()
            if self.stack[self.open_blocks[-1]][0] == "p":  # a block ends an open paragraph
                self.pop(self.open_blocks[-1])
            if tag in ENDS:
                ended, walls = ENDS[tag]
                while (at := self.last(ended)) > self.last(walls):
                    self.pop(at)
                    if tag != "tr":
                        break
        if tag in VOID or attrs.endswith("/") and tag not in BLOCKS:
            return
        _, element, shunned, path, inside, doubtful, doubts = self.stack[-1]
        level = _shunned(tag, attrs, inside, self.hints)
        place = len(self.stack)
        if tag in BLOCKS:
            path = self.paths.setdefault((path, tag), len(self.paths) + 1)
            self.parent.append(element)
            self.tag.append(tag)
            element = len(self.tag) - 1
            if level == 1:
                doubtful, doubts = element, doubts + 1
            self.around.append(doubtful)
            self.open_blocks.append(place)
        self.links += tag == "a"
        self.places.setdefault(tag, []).append(place)
        self.stack.append((tag, element, shunned or tag in RAW or level == 2, path, inside or tag in ("article", "main"), doubtful, doubts))

    def close(self, tag: str) -> None:
        if tag in ("body", "html"):
            return
        if tag == "br":
            self.parts.append(" ")
        at = self.last([tag])
        if at and (tag in BLOCKS or at > self.open_blocks[-1]):  # else a stray end
            self.pop(at)


def _smooth(x: list[float]) -> list[float]:
    """Weights 1 2 1 over the sequence."""
    return [(x[max(0, i - 1)] + 2 * v + x[min(len(x) - 1, i + 1)]) / 4 for i, v in enumerate(x)]


def content_paths(blocks: list[Block]) -> set[tuple[int, int]]:
    """Paths, with the number of doubtful elements around, whose fused ratio of text and punctuation reaches the threshold."""
    total: dict[tuple[int, int], list[float]] = {}
    keys = [(b.path, b.doubts) for b in blocks]
    for b, key in zip(blocks, keys, strict=True):
        t = total.setdefault(key, [0, 0, 0, 0])
        t[0] += 1
        t[1] += len(b.text)
        t[2] += len(_PUNCT.findall(b.text))
        t[3] += min(b.linked, len(b.text))
    length = _smooth([total[key][1] / total[key][0] for key in keys])
    points = _smooth([total[key][2] / total[key][0] for key in keys])
    fused: dict[tuple[int, int], list[float]] = {}
    for key, n, p in zip(keys, length, points, strict=True):
        fused.setdefault(key, []).append(n * (1 + p))
    score = {key: sum(v) / len(v) * (1 - total[key][3] / max(1, total[key][1])) * total[key][1] ** 0.5 for key, v in fused.items()}
    mean = sum(score.values()) / len(score)
    deviation = (sum((s - mean) ** 2 for s in score.values()) / len(score)) ** 0.5
    least = min(THRESHOLD * deviation, max(score.values()))
    return {key for key, s in score.items() if s >= least and s > 0} or {max(score, key=score.get)}


#: Elements that are not an article by themselves, and those that hold a page rather than an article.
PIECES, WHOLE = HEADINGS | {"p", "li", "pre", "blockquote", "ul", "ol"}, frozenset({"body", "html", ""})


#: Unlinked signs that may be an article although names around them are made of hints.
ARTICLE_SIGNS = 140


def main_text(html: str | None) -> str:
    """The article of a page, its blocks joined by line feeds. If names leave nothing, the page is read again without them."""
    page = _Page(html) if html else None
    if page and not page.blocks:
        page = _Page(html, hints=False)
        if sum(len(b.text) - b.linked for b in page.blocks) < ARTICLE_SIGNS:
            return ""
    if not page or not page.blocks:
        return ""
    parent, tag, blocks = page.parent, page.tag, page.blocks
    paths = content_paths(blocks)
    # of the elements that may not be content those go that hold none
    ratio = [len(b.text) * (1 + len(_PUNCT.findall(b.text))) * (1 - min(1, b.linked / len(b.text))) for b in blocks]
    good = [r for r, b in zip(ratio, blocks, strict=True) if (b.path, b.doubts) in paths]
    least = sum(good) / len(good) / 2
    holding = {0}
    for r, b in zip(ratio, blocks, strict=True):
        if (b.path, b.doubts) in paths or r >= least > 0:
            element = b.doubtful
            while element not in holding:
                holding.add(element)
                element = page.around[parent[element]]
    blocks = [b for b in blocks if b.doubtful in holding]
    weight, plain = [0] * len(tag), [0] * len(tag)  # content in an element, and blocks that are no headings
    for b in blocks:
        if (b.path, b.doubts) in paths:
            weight[b.element] += len(b.text)
        plain[b.element] += tag[b.element] not in HEADINGS
    for e in range(len(tag) - 1, 0, -1):  # a parent's number is less
        weight[parent[e]] += weight[e]
        plain[parent[e]] += plain[e]
    # the deepest element that holds nearly all: each such element is within the one before
    held = HOLDS * weight[0]
    article = max(e for e, w in enumerate(weight) if w >= held)
    # a lone paragraph is not the article: step out to what holds it, unless that is the page itself
    if tag[article] in PIECES and tag[parent[article]] not in WHOLE:
        article = parent[article]
    # headings that stand beside the article's element belong to it
    while tag[parent[article]] not in WHOLE and plain[parent[article]] == plain[article]:
        article = parent[article]
    whole = tag[article] not in WHOLE
    inside = [e == article for e in range(len(tag))]
    for e in range(article + 1, len(tag)):
        inside[e] = inside[parent[e]]
    if whole:
        return "\n".join(b.text for b in blocks if inside[b.element])
    # blocks that stand in the page itself: content, the headings above it, and what stands between and is no link
    content = [i for i, b in enumerate(blocks) if inside[b.element] and (b.path, b.doubts) in paths]
    if not content:
        return ""
    low = content[0]
    while low and tag[blocks[low - 1].element] in HEADINGS:
        low -= 1
    kept = set(content).union(i for i in range(low, content[-1]) if 2 * blocks[i].linked < len(blocks[i].text))
    return "\n".join(blocks[i].text for i in sorted(kept))


def extract(df: DataFrame, html: str = "html", hand_on: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns `hand_on` and `text`, the main text of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(h) for h in batch.column(0).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], texts], names=[*hand_on, "text"])
        release()

    small_batches(df.sparkSession)
    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in hand_on] + ["text string"])
    return df.select(col(html).alias("__html"), *map(col, hand_on)).mapInArrow(run, schema)


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


QUERIES = {"op6_html_text": op6_html_text}
ORACLES: dict[str, str] = {}
