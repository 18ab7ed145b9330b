"""Main text of web pages by tag-path ratios."""

from __future__ import annotations

import html
import re
from collections import defaultdict
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.common import arrow_map, only

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>[^>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*)*)>", re.S
)
ATTRIBUTE = re.compile(r"([a-zA-Z_:-][\w:.-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)
#: Elements (fixed values): without content; with raw text that is not shown; inside a line; ended by a sibling of their kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template title textarea iframe object svg math canvas video audio select".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rp rt s samp small span strike strong sub sup time tt u var wbr".split()
)
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
CONTAINERS = frozenset("body html div section article main td center".split())
#: Elements of running text, which belong to the content beside them though their own paths score low.
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote figcaption caption td th".split())
#: Elements, roles and words in class or id that are never part of an article (fixed values).
ASIDE = frozenset("nav footer aside form button dialog menu fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
WORDS = frozenset(
    """ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist
    consent cookie cookies copyright disclaimer discussion disqus footer gdpr hidden login masthead menu modal nav navbar
    navigation newsletter notice notices notification overlay pager pagination popup promo promotion promoted recommended
    related replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe subscription
    tags teaser toolbar topbar widget widgets""".split()
)
#: Words that remarks of readers go by: these are set aside however long they are.
REMARKS = frozenset("comment comments commentlist discussion disqus replies reply respond".split())
#: Words that parts of an article go by as well; inside one the scores decide.
AMBIGUOUS = frozenset(
    "banner disclaimer notice notices notification promo promoted promotion recommended related search social sponsored subscription tags teaser widget".split()
)
#: How an element is marked: never shown; as a remark; by its name; by its role or as a form; by a word of its class or id; by a part of such a word.
HIDDEN, REMARK, NAME, KIND, WORD, PART = "hidden", "remark", "name", "kind", "word", "part"
PUNCTUATION = re.compile(r"[.,;:!?…。，；：！？、]")


class Element(NamedTuple):
    name: str
    number: int


class Piece(NamedTuple):
    """Text directly inside one element: its block, tag path and enclosing elements."""

    block: int
    path: tuple[str, ...]
    inside: tuple[int, ...]
    text: str


class Page(NamedTuple):
    """Shown text in order, names of all elements, marks of suspected ones, and elements around an article or main."""

    pieces: list[Piece]
    names: dict[int, str]
    marks: dict[int, str]
    around: set[int]


def _mark(name: str, rest: str, in_article: bool) -> str | None:
    """What speaks for an element belonging to what surrounds the article, the strongest sign of all."""
    found = set()
    if name in ASIDE:
        found.add(KIND if name in ("form", "fieldset") else NAME)
    elif name == "header" and not in_article:
        found.add(KIND)
    if "=" in rest or "hidden" in rest:
        for key, *values in ATTRIBUTE.findall(rest):
            key, value = key.lower(), "".join(values).lower()
            if key in ("class", "id") and name not in ("body", "html", "article", "main"):
                for token in value.split():
                    if token in REMARKS:
                        found.add(REMARK)
                    elif token in WORDS and not (in_article and token in AMBIGUOUS):
                        found.add(WORD)
                    elif not WORDS.isdisjoint(re.split(r"[^a-z0-9]+", token)):
                        found.add(PART)
            elif key == "role" and value in ROLES:
                found.add(KIND)
            elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none", value)):
                found.add(HIDDEN)
    return next((m for m in (HIDDEN, REMARK, NAME, KIND, WORD, PART) if m in found), None)


def pieces_of(page: str) -> Page:
    """The text of a page in order and its elements; broken markup is closed as browsers do."""
    stack: list[Element] = []
    names: dict[int, str] = {}
    marks: dict[int, str] = {}
    around: set[int] = set()
    out: list[Piece] = []
    block = at = 0
    position, size = 0, len(page)

    def add(text: str) -> None:
        if text and not text.isspace():
            out.append(Piece(block, tuple(e.name for e in stack), tuple(e.number for e in stack), html.unescape(text)))
        elif text and out and out[-1].block == block:
            out.append(out[-1]._replace(text=" "))

    def close(index: int) -> None:
        nonlocal block
        if any(e.name not in INLINE for e in stack[index:]):
            block += 1
        del stack[index:]

    while position < size:
        found = TOKEN.search(page, position)
        if not found:
            add(page[position:])
            break
        add(page[position : found.start()])
        position = found.end()
        name = (found["name"] or "").lower()
        if not name:
            continue
        if found["end"]:
            index = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].name == name), None)
            if name not in INLINE:
                block += 1
            if index is not None and (name not in INLINE or all(e.name in INLINE for e in stack[index:])):
                close(index)
            continue
        if name == "br":
            add_space = out and out[-1].block == block
            if add_space:
                out.append(out[-1]._replace(text=" "))
            continue
        if name in RAW and not found["rest"].rstrip().endswith("/"):
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.I).search(page, position)
            position = end.end() if end else size
            continue
        if name not in INLINE:
            block += 1
            # A block ends an open paragraph; list items, cells and the like end their kind.
            index = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].name == "p"), None)
            if index is not None:
                close(index)
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].name in SIBLINGS.get(name, ()):
                    close(i)
                    break
                if stack[i].name in CONTAINERS or stack[i].name in ("ul", "ol", "dl", "table", "tbody", "select"):
                    break
        if name not in VOID:
            at += 1
            names[at] = name
            in_article = any(e.name in ("article", "main") for e in stack)
            if name in ("article", "main"):
                around.update(e.number for e in stack)
            mark = _mark(name, found["rest"], in_article)
            if mark:
                marks[at] = mark
            stack.append(Element(name, at))
    return Page(out, names, marks, around)


def path_ratios(pieces: list[Piece]) -> dict[tuple[str, ...], tuple[float, float]]:
    """Characters and punctuation per piece of every tag path."""
    length, marks, number = defaultdict(float), defaultdict(float), defaultdict(int)
    for p in pieces:
        length[p.path] += len(p.text.strip())
        marks[p.path] += len(PUNCTUATION.findall(p.text))
        number[p.path] += 1
    return {path: (length[path] / n, marks[path] / n) for path, n in number.items()}


def path_scores(pieces: list[Piece], width: float = 1.0) -> np.ndarray:
    """Fused score of every piece: its path's two ratios, each smoothed in page order with a Gaussian, multiplied."""
    ratios = path_ratios(pieces)
    series = np.array([ratios[p.path] for p in pieces])
    reach = int(np.ceil(3 * width))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / width) ** 2)
    kernel /= kernel.sum()
    padded = np.pad(series, ((reach, reach), (0, 0)), mode="edge")
    smooth = np.stack([np.convolve(padded[:, i], kernel, "valid") for i in (0, 1)], 1)
    return smooth[:, 0] * smooth[:, 1]


def _block_path(piece: Piece) -> tuple[str, ...]:
    return tuple(name for name in piece.path if name not in INLINE)


def _content_blocks(pieces: list[Piece], high: set[tuple], threshold: float, in_article: bool) -> set[int]:
    """Blocks of a container's pieces that are content.

    A block with a piece on a selected path is content, and so is all between the first
    and the last of these. Beyond them bare text stays out, unless the container is an
    article; headings, list items, paragraphs and cells stay. Menus stay out everywhere:
    blocks on paths with most of their text in links whose own ratios, unsmoothed, do
    not reach the threshold.
    """
    linked, length, marks, number = defaultdict(float), defaultdict(float), defaultdict(float), defaultdict(int)
    for p in pieces:
        path = _block_path(p)
        length[path] += len(p.text.strip())
        linked[path] += len(p.text.strip()) * ("a" in p.path)
        marks[path] += len(PUNCTUATION.findall(p.text))
        number[path] += 1
    menus = {x for x, n in number.items() if 2 * linked[x] > length[x] and length[x] * marks[x] < threshold * n * n}
    chosen = {p.block for p in pieces if p.path in high and _block_path(p) not in menus}
    if not chosen:
        return {p.block for p in pieces}
    first, last = min(chosen), max(chosen)
    out = set()
    for p in pieces:
        path = _block_path(p)
        beside = in_article or first <= p.block <= last or (path and path[-1] in TEXTUAL)
        if p.block in chosen or (beside and path not in menus):
            out.add(p.block)
    return out


def _aside(page: Page, selected: list[Piece], high: set[tuple]) -> set[tuple[int, ...]]:
    """Enclosing elements (as in `inside`) of the pieces that are set aside.

    An element around an article or main, or with most of the selected text, is not set
    aside by its name, role or class; one suspected only by a part of a word keeps the
    pieces on selected paths. Remarks of readers, which may be articles themselves, are
    released only around an article with nine tenths of it, and a page with an article
    has none of its text in a footer or the like, however short it is.
    """
    held: dict[int, int] = defaultdict(int)
    total = 0
    for p in selected:
        if not any(page.marks.get(e) == HIDDEN for e in p.inside):
            total += len(p.text)
            for e in p.inside:
                held[e] += len(p.text)

    def firm(e: int) -> str | None:
        mark = page.marks.get(e)
        if mark in (None, HIDDEN):
            return mark
        if mark == REMARK:
            return None if e in page.around and held[e] >= 0.9 * total else mark
        return None if e in page.around or (2 * held[e] > total and not (mark == NAME and page.around)) else mark

    kept = {e: m for e in page.marks if (m := firm(e))}
    out = set()
    for p in page.pieces:
        marks = {kept[e] for e in p.inside if e in kept}
        if marks - {PART} or (marks and p.path not in high):
            out.add(p.inside)
    return out


def main_text(page: str | None, strictness: float = 0.8) -> str:
    """The article of a page: its blocks joined by an empty line.

    Paths whose fused score reaches `strictness` standard deviations of all scores hold
    content. The content's container is the article or main element with nine tenths of
    it, or all those that hold some of it if they have nine tenths together, or else the
    innermost container of nine tenths of it. Of its blocks those on selected paths are
    kept, with the headings, lists and lines beside them; menus and what is set aside
    are not. NULL, empty and textless pages give "".
    """
    found = pieces_of(page or "")
    pieces, names = found.pieces, found.names
    shown = [p for p in pieces if p.text != " "]
    if not shown:
        return ""
    scores = path_scores(shown)
    threshold = strictness * scores.std()
    by_path: dict[tuple, list[float]] = defaultdict(list)
    for p, s in zip(shown, scores, strict=True):
        by_path[p.path].append(s)
    # A path counts by its mean: one piece beside the article does not lift the others.
    high = {path for path, found_scores in by_path.items() if np.mean(found_scores) >= max(threshold, 1e-9)}
    selected = [p for p in shown if p.path in high]
    aside = _aside(found, selected, high)
    content = [p for p in selected if p.inside not in aside]
    content = content or [p for p in shown if p.inside not in aside]
    weight: dict[int, int] = defaultdict(int)
    for p in content:
        for e in p.inside:
            weight[e] += len(p.text)
    total = sum(len(p.text) for p in content)
    marked = {e for e in weight if names[e] in ("article", "main")}
    # Among nested marked elements of equal weight the inner one, which was opened later.
    heaviest = max(marked, key=lambda e: (weight[e], e), default=None)
    in_article = True
    if heaviest is not None and weight[heaviest] >= 0.9 * total:
        chosen = {heaviest}
    elif sum(len(p.text) for p in content if not marked.isdisjoint(p.inside)) >= 0.9 * total:
        chosen = marked
    else:
        in_article = False
        chosen = {max((e for e in weight if names[e] in CONTAINERS and weight[e] >= 0.9 * total), default=0)} - {0}
    inside = [p for p in pieces if p.inside not in aside and (not chosen or not chosen.isdisjoint(p.inside))]
    kept = _content_blocks([p for p in inside if p.text != " "], high, threshold, in_article)
    blocks: dict[int, list[str]] = defaultdict(list)
    for p in inside:
        if p.block in kept:
            blocks[p.block].append(p.text)
    joined = (" ".join("".join(parts).split()) for _, parts in sorted(blocks.items()))
    return "\n\n".join(b for b in joined if b)


def extract(pages: DataFrame, key: str, url: str, page: str) -> DataFrame:
    """key, url, text, n_chars of every row; repeated rows and NULL keys stay, NULL pages have the empty text.

    Each page is judged by itself, whole, in the task that reads it: no shuffle.
    """
    kinds = dict(pages.dtypes)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(x) for x in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["key", "url", "text", "n_chars"]
        )

    found = arrow_map(only(pages, key=F.col(key), url=F.col(url), page=F.col(page)), run, f"key {kinds[key]}, url {kinds[url]}, text string, n_chars long")
    return found.select(F.col("key").alias(key), F.col("url").alias(url), "text", "n_chars")
