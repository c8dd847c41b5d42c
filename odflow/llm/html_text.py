"""Main text of web pages as a maximum-scoring subsequence.

A page is a sequence of words and tags. Words score positive and tags negative; weights come from labelled pages (those
that mark their article with an ``article`` or ``main`` element): a tag costs the more, the oftener it stands outside of
articles, and a word gains by how much oftener words of the block element around it stand in articles. A linear scan finds
the contiguous region of highest score on every page, whether it has such elements or not. Blocks inside it are left out if
labelled pages show their class or id outside of articles only, or, for names that no labelled page shows, if their element or
name says that they are boilerplate.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odflow.llm.common import slices

#: Fixed values of HTML: elements without end tag, elements whose content is no markup, elements that break a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg math iframe object select".split())
BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements and parts of names that hold no article text.
APART = frozenset("nav footer aside button dialog menu".split()) | RAW
APART_NAME = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|banner|promo\w*|nav\w*|menu\w*|breadcrumb\w*|sidebar\w*|side|footer|site-?header|masthead|cookie\w*|consent|notice\w*|alert|popup|modal|"
    r"newsletter|subscribe\w*|share|sharing|social|related|recommend\w*|comment\w*|replies|disqus|widget\w*|pagination|login|signup|search|skip-?link|copyright|legal)(?:$|[\s_-])",
    re.I,
)
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*(?:>|\Z)|[^<]+|<", re.S)
_NAME = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)


def parse(page: str, names: frozenset = frozenset(), seen: tuple[Counter, Counter] | None = None) -> list[tuple[str, str, bool, bool, str]]:
    """(tag or '', text, apart, in article, block) in page order: tags as name or /name, texts with the block element around them.

    Unclosed elements end with their parent; a block that is apart ends at its own end tag, or at an end tag of an
    element around it. Elements with a class or id in ``names`` are apart. ``seen`` counts classes and ids of elements in or
    around an article, and of all others. A form is apart unless it holds most of the page's words, for then it wraps the page; a header
    outside of articles is apart unless it lies in another block and has a heading and no list, form or menu, for then it is the text's own.
    """
    out: list[tuple[str, str, bool, bool, str]] = []
    stack: list[tuple[str, bool]] = []  # element, whether apart
    around: list[list[str]] = []  # classes and ids of the open elements
    depth, inside, at, n = 0, 0, 0, len(page)
    spans: list[list] = []  # forms and headers: name, first token, end, whether inside of another element
    while at < n:
        m = _TOKEN.match(page, at)
        at = m.end()
        name = m[2]
        if name is None:
            got = m[0]
            if got[0] != "<" or got == "<":
                out.append(("", got, depth > 0, inside > 0, next((e for e, _ in reversed(stack) if e in BLOCK), "")))
            continue
        name = name.lower()
        if m[1]:
            if any(e == name for e, _ in stack):
                while stack:
                    e, apart = stack.pop()
                    around.pop()
                    depth -= apart
                    inside -= e in ("article", "main")
                    if e in ("form", "header"):
                        next(x for x in reversed(spans) if x[0].endswith(e) and x[2] is None)[2] = len(out)
                    if e == name:
                        break
            out.append(("/" + name, "", depth > 0, inside > 0, ""))
            continue
        apart = name in APART
        own: list[str] = []
        for key, a, b, c in _NAME.findall(m[3]):
            value = a or b or c
            if key.lower() in ("class", "id"):
                own += value.lower().split()
            apart |= key.lower() == "hidden" or (key.lower() == "aria-hidden" and value == "true")
            apart |= value.lower() in ROLES if key.lower() == "role" else bool(value and APART_NAME.search(value))
        apart |= any(t in names for t in own)
        if name in ("html", "body", "article", "main"):
            apart = False
        if seen is not None:
            seen[0 if inside else 1].update(own)
            if name in ("article", "main") and not inside:
                seen[0].update(own + [t for tokens in around for t in tokens])
        out.append((name, "", depth > 0 or apart, inside > 0, ""))
        closed = m[3].rstrip().endswith("/")
        if name in RAW and (not closed or name in ("script", "style")):
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = end.end() if end else n
        elif name not in VOID and not closed:
            if name == "form" or (name == "header" and not inside):
                spans.append([name, len(out) - 1, None, bool(stack) and stack[-1][0] not in ("html", "body")])
            elif name == "header":  # an article's own stays
                spans.append(["own header", len(out), None, True])
            stack.append((name, apart))
            around.append(own)
            depth += apart
            inside += name in ("article", "main")
    for span in spans:
        span[2] = len(out) if span[2] is None else span[2]
    return _without_spans(out, spans)


def _without_spans(tokens: list[tuple[str, str, bool, bool, str]], spans: list[list]) -> list[tuple[str, str, bool, bool, str]]:
    """tokens with those forms and headers apart that do not belong to the text."""
    if not spans:
        return tokens
    words = [0 if tag or apart else len(text.split()) for tag, text, apart, _, _ in tokens]
    whole, gone = sum(words), set()
    for name, first, end, within in spans:
        if name == "own header":
            continue
        if name == "form":
            keep = 2 * sum(words[first:end]) > whole
        else:
            tags = {t[0] for t in tokens[first:end]}
            keep = within and bool(tags & {"h1", "h2"}) and not tags & {"nav", "ul", "ol", "form", "menu"}
        if not keep:
            gone.update(range(first, end))
    return [(tag, text, apart or i in gone, article, block) for i, (tag, text, apart, article, block) in enumerate(tokens)]


def best_region(values: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous run of highest sum; (0, 0) if none is above 0. Of equal runs the one that ends first."""
    best, at, total, start = 0.0, (0, 0), 0.0, 0
    for i, value in enumerate(values):
        if total <= 0:
            total, start = 0.0, i
        total += value
        if total > best:
            best, at = total, (start, i + 1)
    return at


class Model:
    """Costs of tags, and gains of a word by the block element around it."""

    def __init__(self, pages: list[str]):
        inside, outside, word_in, word_out = Counter(), Counter(), Counter(), Counter()
        seen = (Counter(), Counter())
        for page in pages:
            parse(page, seen=seen)
        #: classes and ids that labelled pages show outside of articles only
        self.names = frozenset(t for t, n in seen[1].items() if n >= 5 and t not in seen[0])
        for page in pages:
            tokens = parse(page, self.names)
            if any(t[0] == "article" or t[0] == "main" for t in tokens):
                for tag, text, apart, article, block in tokens:
                    if tag:
                        (inside if article and not apart else outside)[tag.lstrip("/")] += 1
                    elif not apart:
                        (word_in if article else word_out)[block] += len(text.split())
        total_in, total_out = sum(inside.values()) + 1, sum(outside.values()) + 1
        self.cost = {}
        for tag in inside.keys() | outside.keys():
            odds = math.log((outside[tag] + 0.5) / total_out) - math.log((inside[tag] + 0.5) / total_in)
            self.cost[tag] = min(max(odds, 0.05), 8.0)
        #: of words in blocks that no labelled page shows the gain is 1; the most a word loses is half of that
        self.gain = {b: min(max(math.log((word_in[b] + 0.5) / (word_out[b] + 0.5)), -0.5), 1.0) for b in word_in.keys() | word_out.keys()}
        #: of tags that no labelled page shows: blocks cost more than inline elements, a cell of one word still gains
        self.other_block, self.other = 0.3, 0.1

    def text(self, page: str) -> str:
        """Main text; empty if there is none."""
        tokens = parse(page, self.names)
        values = []
        for tag, text, apart, _, block in tokens:
            if tag:
                name = tag.lstrip("/")
                values.append(-self.cost.get(name, self.other_block if name in BLOCK else self.other))
            elif apart:
                values.append(-0.2 * len(text.split()))
            else:
                values.append(len(text.split()) * self.gain.get(block, 1.0))
        blocks, now = [], []
        for tag, text, apart, _, _ in tokens[slice(*best_region(values))]:
            if tag:
                if tag.lstrip("/") in BLOCK:
                    blocks.append("".join(now))
                    now = []
            elif not apart:
                now.append(text)
        blocks.append("".join(now))
        return " ".join(b for b in (" ".join(html.unescape(b).split()) for b in blocks) if b)


def fit(pages: DataFrame, bound: int = 500) -> Model:
    """From about ``bound`` pages that mark their article (that bound is the parameter)."""
    marked = pages.filter(F.lower("html").rlike("<(article|main)[\\s>]"))
    n = marked.count()
    unit = F.xxhash64("html", F.lit(7)).cast("double") / 2.0**64 + 0.5
    return Model(sorted(r[0] for r in marked.filter(unit < min(1.0, bound / max(1, n))).select("html").collect()))


def extracted(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every row; the model is fitted on ``pages`` unless given.

    Null or empty html has the empty text. Repeated rows each have a row; other columns are ignored.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or fit(pages))

    def texts(batches):
        for batch in slices(batches, "html"):
            out = [shared.value.text(x) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    source = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    return source.mapInArrow(texts, f"page_id {kind}, url string, text string, n_chars long")
