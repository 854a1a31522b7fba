"""Main text of web pages by tag-path ratios.

Every text node is filed under its root-to-leaf tag path. Text length and punctuation are
aggregated per path, turned into ratios per node, fused, smoothed along the page, and paths at or
above a threshold derived from their spread hold the content nodes. Blocks inside the content's own
container (headings, short lines, lists) join them; structural boilerplate (menus, forms, headers,
footers) never does. Names that mark boilerplate (in class, id and role) rule an element out unless
an article or main lies in it, the name tells a state of the page (``has-sidebar``,
``comments-open``), or nothing would be left: then elements that hold all the text are wrappers.

Defined results: null or empty html, or a page without text, gives an empty string. Repeated pages
are extracted row by row. Broken markup is read as browsers do: unclosed elements end with their
container, stray ends are ignored. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:[^>"']++|"[^"]*"|'[^']*'|["'])*?)>|<[!?/][^>]*>""",
    re.DOTALL,
)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.IGNORECASE)
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*>", re.IGNORECASE) for t in ("script", "style", "textarea", "title", "noscript", "template", "svg", "math", "iframe", "object")}

# Element names of the HTML standard by their role here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary "
    "table tbody td tfoot th thead tr ul".split()
)
BOILERPLATE = frozenset("head nav header footer aside form button select menu dialog label fieldset search".split())
ENDS_WITH_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
KEEPERS = frozenset("html body article main".split())

# Words in class, id and role names that mark menus, adverts, notices and comments.
NAMES = frozenset(
    "ad ads adbox advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist cookie cookies "
    "consent disclaimer disqus footer gdpr header legal login masthead menu modal nav navbar navigation newsletter notice notices "
    "notification outbrain overlay pagination pager popup promo promotion promoted recommended related respond search share sharing "
    "sidebar signup skip social sponsor sponsored subscribe subscription taboola tags toolbar topbar widget widgets".split()
)
# Words that turn such a name into a statement about the page.
STATES = frozenset("has have no not with without is are open opened close closed on off enabled disabled".split())
_WORD = re.compile(r"[a-z]+")
PUNCTUATION = re.compile(r"[.,;:!?…。，；！？、]")


class _Element:
    __slots__ = ("name", "path", "fixed", "named", "link", "parent", "depth")

    def __init__(self, name: str, label: str, parent: _Element | None, fixed: bool, named: bool = False) -> None:
        self.name, self.parent = name, parent
        self.path = f"{parent.path}/{label}" if parent else label
        self.fixed = fixed or (parent.fixed if parent else False)
        self.named = named
        self.link = name == "a" or (parent.link if parent else False)
        self.depth = parent.depth + 1 if parent else 0


def _unwanted(name: str, attributes: str) -> tuple[str, bool, bool]:
    """The path label of an element, whether it is boilerplate by structure, and whether by name."""
    if not attributes:
        return name, name in BOILERPLATE, False
    named = " ".join(next(filter(None, m.groups()), "") for m in _NAMED.finditer(attributes)).lower()
    words = set(_WORD.findall(named))
    fixed = name in BOILERPLATE or bool(_HIDDEN.search(attributes))
    marked = name not in KEEPERS and any(parts & NAMES and not parts & STATES for parts in (set(_WORD.findall(x)) for x in named.split()))
    return (f"{name}.{'.'.join(sorted(words))}" if words else name), fixed, marked


def parse(page: str) -> list[list[tuple[str, _Element]]]:
    """Blocks in page order: runs of text nodes between block boundaries, each with its element."""
    root = _Element("", "", None, False)
    stack, blocks, current, at = [root], [], [], 0

    def close() -> None:
        nonlocal current
        if current:
            blocks.append(current)
            current = []

    def text(raw: str) -> None:
        if raw:
            current.append((html.unescape(raw) if "&" in raw else raw, stack[-1]))

    while m := _TAG.search(page, at):
        text(page[at : m.start()])
        at = m.end()
        if not m["name"]:
            continue
        name = m["name"].lower()
        if m["end"]:
            if name in BLOCK:
                close()
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == name:
                    del stack[i:]
                    break
                if stack[i].name in BLOCK and name not in BLOCK:  # an inline end does not close blocks
                    break
            continue
        if name in _RAW_END:
            if not m["rest"].rstrip().endswith("/") or name not in ("svg", "math"):
                end = _RAW_END[name].search(page, at)
                at = end.end() if end else len(page)
            continue
        if name in VOID:
            if name == "hr":
                close()
            elif current:
                current.append((" ", stack[-1]))
            continue
        if name in BLOCK:
            close()
            for i in range(len(stack) - 1, 0, -1):  # a block ends an open paragraph
                if stack[i].name == "p":
                    del stack[i:]
                    break
                if stack[i].name in BLOCK:
                    break
            same = ENDS_WITH_SAME.get(name, ())
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name in same:
                    del stack[i:]
                    break
                if stack[i].name in ("ul", "ol", "dl", "table", "select", "div", "article", "body"):
                    break
        label, fixed, marked = _unwanted(name, m["rest"])
        stack.append(_Element(name, label, stack[-1], fixed, marked))
    text(page[at:])
    close()
    return blocks


def _ruled_out(blocks: list[list[tuple[str, _Element]]]) -> set[_Element]:
    """Elements that are boilerplate by name: those that bear one and hold no article or main."""
    marked: set[_Element] = set()
    keeps: set[_Element] = set()
    for element in {e for block in blocks for _, e in block}:
        node: _Element | None = element
        inside = False
        while node:
            inside |= node.name in ("article", "main")
            if node.named:
                (keeps if inside else marked).add(node)
            node = node.parent
    return marked - keeps


def _fuse(blocks: list[list[tuple[str, _Element]]]) -> np.ndarray:
    """For each block, whether it holds a content node."""
    nodes = [(i, e.path, 0 if e.link else len(t), 0 if e.link else len(PUNCTUATION.findall(t))) for i, b in enumerate(blocks) for t, e in b if t.strip()]
    paths = {p: k for k, p in enumerate(dict.fromkeys(n[1] for n in nodes))}
    path = np.array([paths[n[1]] for n in nodes])
    count = np.bincount(path)
    length = np.bincount(path, [n[2] for n in nodes]) / count
    marks = np.bincount(path, [n[3] for n in nodes]) / count
    fused = (length / max(length.max(), 1) + marks / max(marks.max(), 1)) / 2
    along = fused[path]
    around = np.convolve(np.pad(along, 2, mode="edge"), np.array([0.05, 0.2, 0.5, 0.2, 0.05]), mode="valid")
    smooth = np.bincount(path, around) / count
    score = (fused + smooth) / 2
    threshold = min(score.max(), score.std())
    content = score >= threshold if threshold > 0 else score >= 0
    out = np.zeros(len(blocks), dtype=bool)
    for (i, *_), k in zip(nodes, path, strict=True):
        out[i] |= content[k]
    return out


def _container(elements: list[_Element], sizes: list[int]) -> _Element:
    """The deepest element that holds at least nine tenths of the chosen text."""
    total, held, found = sum(sizes), {}, elements[0]
    for element, size in zip(elements, sizes, strict=True):
        node: _Element | None = element
        while node:
            held[node] = held.get(node, 0) + size
            node = node.parent
    for node, size in held.items():
        if 10 * size >= 9 * total and (10 * held[found] < 9 * total or node.depth > found.depth):
            found = node
    while found.name in ("p", "b", "strong", "i", "em", "span", "font", "h1", "h2", "h3", "h4", "h5", "h6") and found.parent:
        found = found.parent
    return found


def _outside(node: _Element | None, elements: set[_Element]) -> bool:
    while node and node not in elements:
        node = node.parent
    return node is None


def main_text(page: str | None) -> str:
    """The page's main text, one line per block."""
    if not page:
        return ""
    sound = [[x for x in block if not x[1].fixed] for block in parse(page)]
    out_of = _ruled_out(sound)
    blocks: list[list[tuple[str, _Element]]] = []
    # Where names rule everything out, the outermost of them are wrappers, and so on inwards.
    while not blocks and any(t.strip() for block in sound for t, _ in block):
        verdict = {e: _outside(e, out_of) for block in sound for _, e in block}
        blocks = [b for b in ([x for x in block if verdict[x[1]]] for block in sound) if any(t.strip() for t, _ in b)]
        out_of = {e for e in out_of if not _outside(e.parent, out_of)}
    if not blocks:
        return ""
    chosen = _fuse(blocks)
    sizes = [sum(len(t) for t, _ in b) for b in blocks]
    linked = [2 * sum(len(t) for t, e in b if e.link) > n for b, n in zip(blocks, sizes, strict=True)]
    picked = np.flatnonzero(chosen)
    box = _container([blocks[i][0][1] for i in picked], [sizes[i] for i in picked])
    wide = box.name in ("", "html", "body")
    out = []
    for i, block in enumerate(blocks):
        node: _Element | None = block[0][1]
        while node and node is not box:
            node = node.parent
        if chosen[i] or (node and not linked[i] and (not wide or picked[0] <= i <= picked[-1] or block[0][1].name in ("h1", "h2"))):
            out.append(" ".join("".join(t for t, _ in block).split()))
    return "\n".join(t for t in out if t)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = [main_text(p) for p in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            ["page_id", "url", "text", "n_chars"],
        )

    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").alias("url"), F.col("html").alias("html"))
    return arrow_map(rows, run, "page_id bigint, url string, text string, n_chars bigint")
