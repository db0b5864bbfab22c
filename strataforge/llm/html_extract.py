"""Main text of web pages by tag-path ratios.

A page is read into blocks of text, each with its path of tags from the root. For each path, the text
outside links and the punctuation are summed over all its blocks; a path's ratio grows with both for
each block. A block's ratio is smoothed over its neighbours in the same container and fused with the
container's, which is counted over all paths that end there; a heading's also with that of the block it
heads. Blocks whose fused ratio is over a share of the page's best are content.

What elements are called only weighs their ratios: text in a footer, a notice or a comment needs a much
larger ratio than text elsewhere. Menus and lists of links have no weight of their own; their ratios are
small.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements that begin and end a block of text; elements without an end tag; elements whose content isn't markup; elements whose content isn't text of the page.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp".split())
HIDDEN = frozenset("noscript template svg math iframe object canvas select button datalist audio video".split())
#: Foreign elements, which a slash at the end of their tag closes.
FOREIGN = frozenset(("svg", "math"))
#: Elements and words of class, id and role whose text is seldom the article.
WEIGHED_TAGS = frozenset("footer aside form dialog".split())
WEIGHED_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner footer header masthead sidebar aside widget related recommended share sharing social "
    "comment comments reply replies disqus cookie cookies consent notice gdpr popup modal newsletter subscribe subscription signup login search copyright toolbar complementary contentinfo".split()
)
#: What is left of the ratio of text in such an element, and how often a page's header counts.
WEIGHT = 0.01
#: An element called so that holds this share of the page's text, in as many blocks, is a wrapper and isn't weighed.
WRAPPER_SHARE, WRAPPER_BLOCKS = 0.6, 3
#: Part of a link's text that counts as text of its block.
LINK_SHARE = 0.05
#: Weight of a neighbour in smoothing, where the block itself has 1.
NEIGHBOUR = 0.5
#: What a heading has of the fused ratio of the next block.
HEADS = 0.8
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Of the best fused ratio on the page, content has this share or more; and at least so much. Both are fitted on pages whose article is known.
SHARE, LEAST = 0.5, 0.5

_NAME = re.compile(r"[A-Za-z][^\s/>]*+")
#: One attribute, or nothing, behind the white space before it. Nothing is tried twice, so reading is linear.
_ATTRIBUTE = re.compile(r"[\s/]*+(?:([^\s/>=]++|=[^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?+)?+")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}
_WORD = re.compile(r"[A-Za-z]+")
_PUNCTUATION = re.compile(r"[.,;:!?。，；：！？、]")
#: An opening tag that cannot stand inside these closes them.
_CLOSES = {"li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "option": ("option",)}


class Page:
    """The blocks of a page in order, and the tree of its paths: a path is a number, its parent's is less."""

    def __init__(self) -> None:
        self.parent: list[int] = [-1]
        self.known: dict[tuple[int, str], int] = {}
        self.heading: list[bool] = []
        self.path: list[int] = []
        self.text: list[str] = []
        self.linked: list[int] = []  # characters of the block inside links
        self.owner: list[int] = []  # the innermost element called as WEIGHED, or -1
        self.wrapper: list[tuple[int, bool]] = []  # for each such element: the next one around it, and whether it may be a wrapper
        self.holds: set[int] = set()  # such elements that hold an article

    def step(self, path: int, name: str) -> int:
        found = self.known.setdefault((path, name), len(self.parent))
        if found == len(self.parent):
            self.parent.append(path)
        return found

    def add(self, path: int, heading: bool, pieces: list[tuple[str, bool]], owner: int) -> None:
        text = " ".join(html.unescape("".join(p for p, _ in pieces)).split())
        if text:
            self.path.append(path)
            self.heading.append(heading)
            self.text.append(text)
            self.linked.append(min(len(text), len(" ".join(html.unescape("".join(p for p, inside in pieces if inside)).split()))))
            self.owner.append(owner)


def _tag(page: str, at: int) -> tuple[str, str, bool, int]:
    """Of the tag whose name begins at: its name, its class, id and role, whether a slash ends it, and where it ends (the page's end if it doesn't)."""
    name = _NAME.match(page, at)
    at, named = name.end(), []
    while True:
        found = _ATTRIBUTE.match(page, at)
        key = found[1]
        if key is None:
            end = found.end()
            closed = page[at:end].endswith("/") or page[max(0, end - 1) : end] == "/"
            return name[0].lower(), " ".join(named), closed, min(len(page), end + 1)
        if key.lower() in ("class", "id", "role"):
            named.append(found[2] or found[3] or found[4] or "")
        at = found.end()


def read(page: str) -> Page:
    """Blocks and paths of a page, in time linear in its length."""
    out = Page()
    stack: list[tuple[str, int, int, bool, bool]] = []  # tag, path, owner, in a link, hidden
    opened: Counter[str] = Counter()
    held: list[tuple[str, bool]] = []
    at, path, owner, linked, hidden = 0, 0, -1, False, False

    def flush() -> None:
        if held:
            out.add(path, any(opened[h] for h in _HEADINGS), held, owner)
            held.clear()

    def pop() -> None:
        nonlocal path, owner, linked, hidden
        if stack[-1][0] in BLOCKS:
            flush()
        opened[stack.pop()[0]] -= 1
        _, path, owner, linked, hidden = stack[-1] if stack else ("", 0, -1, False, False)

    while at < len(page):
        mark = page.find("<", at)
        mark = len(page) if mark < 0 else mark
        if mark > at and not hidden:
            held.append((page[at:mark], linked))
        if mark == len(page):
            break
        follows = page[mark + 1 : mark + 2]
        if page.startswith("<!--", mark):
            end = page.find("-->", mark + 2 if page.startswith("<!-->", mark) else mark + 4)
            at = len(page) if end < 0 else end + 3
        elif follows in ("!", "?"):
            end = page.find(">", mark)
            at = len(page) if end < 0 else end + 1
        elif follows == "/":
            if not page[mark + 2 : mark + 3].isascii() or not page[mark + 2 : mark + 3].isalpha():
                end = page.find(">", mark)
                at = len(page) if end < 0 else end + 1
                continue
            tag, _, _, at = _tag(page, mark + 2)
            if tag == "br":
                held.append((" ", linked))
            while opened[tag]:
                done = stack[-1][0] == tag
                pop()
                if done:
                    break
        elif follows.isascii() and follows.isalpha():
            tag, named, slash, at = _tag(page, mark + 1)
            if tag in RAW:
                end = _RAW_END[tag].search(page, at)
                at = len(page) if not end else _tag(page, end.start() + 2)[3]
                continue
            if tag in VOID:
                if tag in BLOCKS:
                    flush()
                elif tag != "wbr" and not hidden:
                    held.append((" ", linked))
                continue
            if slash and tag in FOREIGN:
                continue
            if tag in BLOCKS:
                flush()
                gone = _CLOSES.get(tag, ("p",))
                while stack and (stack[-1][0] in gone or (stack[-1][0] not in BLOCKS and opened["p"] and any(s[0] in gone for s in stack[-4:-1]))):
                    pop()
            words = _WORD.findall(named)
            if tag in ("article", "main"):
                around = owner
                while around >= 0 and around not in out.holds:
                    out.holds.add(around)
                    around = out.wrapper[around][0]
            elif tag in WEIGHED_TAGS or (tag not in ("html", "body") and any(w.lower() in WEIGHED_WORDS for w in words)) or (tag == "header" and not (opened["article"] or opened["main"])):
                out.wrapper.append((owner, tag not in WEIGHED_TAGS))
                owner = len(out.wrapper) - 1
            # an article's header is no container of its own
            if tag in BLOCKS and tag != "header":
                path = out.step(path, f"{tag}.{' '.join(words)}" if words else tag)
            linked, hidden = linked or tag == "a", hidden or tag in HIDDEN
            stack.append((tag, path, owner, linked, hidden))
            opened[tag] += 1
        else:
            if not hidden:
                held.append(("<", linked))
            at = mark + 1
    flush()
    return out


def _weights(page: Page) -> list[float]:
    """For each block WEIGHT if it is in an element called as WEIGHED, but for wrappers, and else 1."""
    n = len(page.wrapper)
    chars, blocks = [0] * n, [0] * n
    for owner, text in zip(page.owner, page.text):
        if owner >= 0:
            chars[owner] += len(text)
            blocks[owner] += 1
    for k in range(n - 1, -1, -1):
        around = page.wrapper[k][0]
        if around >= 0:
            chars[around] += chars[k]
            blocks[around] += blocks[k]
    total = sum(map(len, page.text))
    weight = [1.0] * n
    for k, (around, may) in enumerate(page.wrapper):
        wraps = k in page.holds or (may and chars[k] >= WRAPPER_SHARE * total and blocks[k] >= WRAPPER_BLOCKS)
        weight[k] = (weight[around] if around >= 0 else 1.0) if wraps else WEIGHT
    return [weight[owner] if owner >= 0 else 1.0 for owner in page.owner]


def ratios(page: Page) -> list[float]:
    """The fused ratio of each block."""
    n = len(page.parent)
    weight = _weights(page)
    own = [[0.0, 0.0, 0] for _ in range(n)]  # text outside links, punctuation, blocks
    for path, text, linked, w in zip(page.path, page.text, page.linked, weight):
        count = own[path]
        count[0] += w * (len(text) - (1 - LINK_SHARE) * linked)
        count[1] += w * len(_PUNCTUATION.findall(text)) * (1 - linked / len(text))
        count[2] += 1
    # the text before the first element is in the root, as that element is
    up = [max(0, parent) for parent in page.parent]
    inside = [[0.0, 0.0, 0] for _ in range(n)]
    for k in range(n):
        for j in range(3):
            inside[up[k]][j] += own[k][j]

    def ratio(count: list[float], w: float) -> float:
        return math.log1p(w * count[0] / count[2] * (1 + count[1] / count[2]))

    plain = [ratio(own[path], 1.0) for path in page.path]
    fused = []
    for k, path in enumerate(page.path):
        near = [j for j in (k - 1, k + 1) if 0 <= j < len(plain) and up[page.path[j]] == up[path] and weight[j] == weight[k]]
        smooth = (plain[k] + NEIGHBOUR * sum(plain[j] for j in near)) / (1 + NEIGHBOUR * len(near))
        fused.append((smooth + ratio(inside[up[path]], weight[k])) / 2)
    for k in range(len(fused) - 2, -1, -1):
        if page.heading[k] and weight[k] == weight[k + 1]:
            fused[k] = max(fused[k], HEADS * fused[k + 1])
    return fused


def main_text(page: str | None) -> str:
    """The text of the content blocks, in order, joined by line feeds."""
    found = read(page or "")
    fused = ratios(found)
    least = max(LEAST, SHARE * max(fused, default=0.0))
    return "\n".join(text for text, x in zip(found.text, fused) if x >= least)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(page.as_py()) for page in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for each row of pages (page_id, url, html); other columns are ignored.

    A null or empty page gives an empty text, and so does a page without content. Broken markup is read
    as browsers do: a comment, script or tag without an end runs to the page's end. Pages of any length
    take time in proportion to it. Equal rows give equal rows, null ids and urls stay null; an empty
    table gives an empty result.
    """
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
