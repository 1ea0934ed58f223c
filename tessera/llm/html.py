"""Main text of web pages by line-block distribution."""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import by_value, small_batches, table

by_value(__name__)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|svg|iframe|title)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)",
    re.S | re.I,
)
_SPACE = re.compile(r"\s+")
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_AROUND = frozenset("head nav header footer aside form menu dialog select button fieldset object audio video canvas".split())
_ROOTS = frozenset("article main".split())
#: Elements that group others; only these are named after parts of a page.
_BOXES = frozenset("div section article main td ul ol dl body center table blockquote".split())
#: Words of class and id names of parts around an article, and words that go with them.
_PARTS = re.compile(
    r"ad|ads|advert\w*|adsense|banners?|promo\w*|sponsor\w*|nav|navbar|navigation|menu\w*|breadcrumbs?|sidebars?|side|aside"
    r"|header|masthead|footers?|cookies?|consent|notices?|notifications?|alerts?|popup|modal|newsletter|subscribe|subscription|signup|login"
    r"|comments?|respond|reply|replies|disqus|social|share|sharing|related|recommend\w*|widgets?|toolbar|pagination|pager|skip|hidden",
    re.I,
)
_WITH = re.compile(
    r"\d+|top|bottom|left|right|main|site|page|global|primary|secondary|list|box|block|bar|area|wrap|wrapper|container|section|inner|outer|content"
    r"|group|item|items|slot|unit|posts?|articles?|stories|links?|buttons?|icons?|form|panel|column|col|row|sticky|fixed|mobile|desktop|policy",
    re.I,
)
#: Names that only say whether the page has such a part.
_ABOUT = re.compile(r"(?:^|\s)(?:no|has|with|without|hide|show)[-_]\S+", re.I)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|aria-label)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
#: Lines that stand for the markup removed around a part of the page.
WINDOW = 3


def _named(token: str) -> bool:
    """Whether a class is a part around the article and no word of it says otherwise: side-bar, but not side-effects."""
    words = re.findall(r"[A-Za-z][a-z]*|\d+", token)
    if _PARTS.fullmatch(token):
        return True
    return any(map(_PARTS.fullmatch, words)) and all(_PARTS.fullmatch(w) or _WITH.fullmatch(w) for w in words)


def _around(name: str, attrs: str) -> bool:
    """Whether an element is something around the article, by its name, class, id or role."""
    if name in _AROUND:
        return True
    if not attrs or name in ("html", "body", "main"):
        return False
    for key, *values in _ATTRIBUTE.findall(attrs):
        key, value = key.lower(), next((v for v in values if v), "")
        if key == "role" and value.lower() in _ROLES or key == "hidden" or key == "aria-hidden" and value == "true":
            return True
        if key in ("class", "id") and name in _BOXES and any(map(_named, _ABOUT.sub(" ", value).split())):
            return True
    return False


def lines_of(page: str) -> list[tuple[str, int, bool, tuple]]:
    """The page's lines after stripping markup: text, length that counts, whether inside article or main, and the
    numbers of the open elements that group others.

    A line is the text of a block. What is in elements around the article leaves no line. Where such an
    element, an article or a main part begins or ends outside of an article, ``WINDOW`` empty lines stand
    for the markup. Outside of an article, the length that counts leaves out the text of links.
    """
    lines: list[tuple[str, int, bool, tuple]] = []
    boxes: list[tuple[str, int]] = []
    path: tuple = ()
    parts: list[str] = []
    linked = 0
    skip: list[str] = []  # open elements from the one that is around the article on
    roots = links = 0
    begun = False  # an article or main element was seen

    def flush() -> None:
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            parts.clear()
            if text:
                lines.append((text, len(text) if roots else max(len(text) - linked, 0), roots > 0, path))
        linked = 0

    def gap() -> None:
        flush()
        if not roots:
            lines.extend([("", 0, False, ())] * WINDOW)

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at and not skip:
            piece = page[at : m.start()]
            parts.append(piece)
            if links:
                linked += len(piece.strip())
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        if skip:
            own = name in _ROOTS and not m["end"] and not begun and skip[0] != "aside" and not _around(name, m["attrs"])
            if own:
                skip.clear()  # an element left open before the article
            elif m["end"]:
                if name == "body":
                    skip.clear()
                elif name in skip:
                    while skip.pop() != name:
                        pass
                    if not skip:
                        gap()
                continue
            else:
                if name not in _VOID and name not in ("p", "li"):
                    skip.append(name)
                continue
        if name == "a":
            links = 0 if m["end"] else 1
            continue
        if not m["end"] and name not in _VOID and not m["attrs"].endswith("/") and _around(name, m["attrs"]):
            gap()
            skip.append(name)
            links = 0
        elif name in _ROOTS:
            if m["end"]:
                flush()
                roots = max(roots - 1, 0)
                gap()
            else:
                gap()
                roots += 1
                begun = True
        elif name not in _INLINE:
            flush()
        if name in _BOXES and not skip:
            if not m["end"]:
                boxes.append((name, at))
            elif any(b == name for b, _ in boxes):
                while boxes.pop()[0] != name:
                    pass
            path = tuple(k for _, k in boxes)
    if at < len(page) and not skip:
        parts.append(page[at:])
    flush()
    return lines


def surges(lengths: list[int], least: float) -> list[tuple[int, int]]:
    """First and past line of the parts of a page whose text lengths, summed over the last ``WINDOW`` lines, leave zero,
    come to ``least`` somewhere (the surge), and return to zero (the dive)."""
    parts, start, total, high = [], None, 0, 0
    for i, n in enumerate([*lengths, *[0] * WINDOW]):
        total += n - (lengths[i - WINDOW] if i >= WINDOW else 0)
        if total and start is None:
            start, high = i, 0
        high = max(high, total)
        if not total and start is not None:
            if high >= least:
                parts.append((start, i))
            start = None
    return parts


def main_text(page: str | None) -> str:
    """The article's blocks, one a line.

    Text lengths are summed over windows of ``WINDOW`` lines, and the parts between surge and dive are kept, short
    lines and lines of links too. On a page with text in an article or main element only lines in such elements have a
    length, and any length is a surge, as nothing of an article may go. On other pages a part surges if it comes
    to a tenth of the largest sum, and of the parts those in the same element as most of the longest one are kept.
    """
    if not page:
        return ""
    lines = lines_of(page)
    inside = any(root and n for _, n, root, _ in lines)
    if inside:
        parts = surges([n if root else 0 for _, n, root, _ in lines], 1)
        return "\n".join(t for a, b in parts for t, _, root, _ in lines[a:b] if t and root)
    lengths = [n for _, n, _, _ in lines]
    largest = max((sum(lengths[i : i + WINDOW]) for i in range(len(lengths))), default=0)
    parts = surges(lengths, max(largest / 10, 1))
    if not parts:
        return ""
    a, b = max(parts, key=lambda p: (sum(lengths[p[0] : p[1]]), -p[0]))
    weight: dict[int, int] = {}
    for _, n, _, path in lines[a:b]:
        for box in path:
            weight[box] = weight.get(box, 0) + n
    most = sum(lengths[a:b]) / 2
    home = max((box for box, n in weight.items() if n > most), default=None)  # the innermost: it begins last
    kept = [(c, d) for c, d in parts if (c, d) == (a, b) or any(n and (home is None or home in path) for _, n, _, path in lines[c:d])]
    return "\n".join(t for c, d in kept for t, _, _, path in lines[c:d] if t and ((c, d) == (a, b) or home is None or home in path))


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` columns, ``text`` and ``n_chars`` (code points) of every row.

    A null or empty page, or one without text, gives an empty text. Unclosed elements, stray angle
    brackets and cut-off pages are read as far as they go. Pages of any length count whole; repeated rows and null ids are
    rows like others; other columns are ignored; no pages give no rows.
    """

    def run(batches):
        for b in batches:
            texts = [main_text(h.as_py()) for h in b[html_col]]
            yield pa.RecordBatch.from_arrays(
                [*[b[c] for c in keep], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=[*keep, "text", "n_chars"],
            )

    from pyspark.sql.types import LongType, StringType, StructField, StructType

    schema = StructType([*[pages.schema[c] for c in keep], StructField("text", StringType()), StructField("n_chars", LongType())])
    return pages.select(*keep, F.col(html_col)).mapInArrow(run, schema)


def op2_html_extraction(spark, sf_dir: str) -> DataFrame:
    small_batches(spark, 500)
    return extract(table(spark, sf_dir, "pages"))
