"""Main text of web pages by two-pass block rules.

The page is cut into blocks at block-level tags.  The first pass judges every
block by its link density, its length in words and characters and the share of
stop words among its words; the second lets undecided short blocks inherit the
label of the nearest decided neighbour.

The containers a block lies in only lean the judgement: inside an article a
block needs many links to go, inside a named page part it goes although it
reads like main text.  A name is overruled where the rules find no main text
anywhere else: the outermost part that holds most of what reads like main text
then counts as an ordinary container.

Stop words are the commonest words of all pages of one declared language; each
page is read with the list that covers most of its words.  Where none covers
enough, or a script has no spaces, length and links decide alone.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

STOP_WORDS = 100
# A block is short with fewer words and fewer characters than these.
SHORT_WORDS, SHORT_CHARS = 16, 130
LINKS_HIGH = 0.33
STOPS_HIGH, STOPS_LOW = 0.25, 0.15

# Element names of the HTML standard, and usual names of page parts.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
NESTING = frozenset("address article aside blockquote details dialog div dl fieldset figure footer form header main menu nav ol search section table ul".split())
DROPPED = frozenset("script style noscript template svg math iframe object audio video canvas textarea select button title".split())
PAGE_PARTS = frozenset("nav aside footer form menu dialog search".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PART_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice popup modal overlay newsletter subscribe "
    "subscription signup login sidebar aside widget related recommended recommendations share sharing social nav navbar navigation menu breadcrumb breadcrumbs pagination pager "
    "masthead footer copyright comment comments replies reply respond disqus search form complementary contentinfo dialog alert skip".split()
)
COMMENT_NAMES = frozenset("comment comments replies reply respond disqus".split())

# What a line on rights begins with.
COPYRIGHT = ("\u00a9", "Copyright ", "(c) ", "(C) ")
# Parts of a class name that say that something is not there, or only how the page is laid out.
UNNAMED = frozenset("no not non without has have with open free hide hidden layout js".split())

# A quote that never ends is taken as an ordinary character.
_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*|[^>]*)(?:>|\Z)", re.S)
_LANG = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?\s*([a-zA-Z]{2,3})\b", re.I)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_TOKEN = re.compile(r"[a-z0-9]+")


@dataclass
class Block:
    """A run of text between block-level tags.

    ``place`` is 1 in an article, else 0; ``within`` are the named page parts
    around it, outermost first.
    """

    place: int
    heading: bool
    within: tuple[int, ...] = ()
    parts: list[str] = field(default_factory=list)
    linked: int = 0

    def text(self) -> str:
        return " ".join(html.unescape("".join(self.parts)).split())


def _names(attributes: str) -> set[str]:
    """Names of page parts among the class, id and role tokens: a whole token, or the first or last part of a compound."""
    found = set()
    for m in _NAMED.finditer(attributes):
        for token in (m[1] or m[2] or m[3] or "").lower().split():
            parts = _TOKEN.findall(token)
            if parts and not UNNAMED.intersection(parts):
                found.update((parts[0], parts[-1]))
    return found & PART_NAMES


def _place(tag: str, attributes: str, outer: int, in_comments: bool) -> tuple[int, bool, bool]:
    """Place of a container's text, whether it is a named part, and whether reader comments enclose it."""
    names = _names(attributes) if "=" in attributes else set()
    if tag in ("article", "main") and not in_comments:
        return 1, False, False
    if in_comments or names & COMMENT_NAMES:
        return 0, True, True
    if tag in PAGE_PARTS or names or tag == "header" and outer != 1:
        return 0, True, False
    return outer, False, False


def blocks(page: str) -> list[Block]:
    """The page's blocks in order, without scripts, styles, comments and other dropped elements."""
    # Tag, place, the named parts so far, and whether reader comments enclose it.
    stack: list[tuple[str, int, tuple[int, ...], bool]] = [("", 0, (), False)]
    opened: dict[str, list[int]] = {}
    n_parts = 0
    out: list[Block] = []
    block = Block(0, False)
    at, link = 0, 0

    def text(piece: str) -> None:
        block.parts.append(piece)
        if link:
            block.linked += len(piece.split())

    while True:
        m = _MARKUP.search(page, at)
        if m is None:
            text(page[at:])
            break
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag, closing = m[2].lower(), m[1] == "/"
        if tag in DROPPED:
            if not closing and not m[3].endswith("/"):
                end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else len(page)
            block.parts.append(" ")
            continue
        if tag == "a":
            link = 0 if closing else 1
        elif tag == "br":
            block.parts.append(" ")
        if tag not in BLOCK:
            continue
        if tag in NESTING:
            if closing:
                if opened.get(tag):
                    open_at = opened[tag][-1]
                    for left in stack[open_at:]:
                        opened[left[0]].pop()
                    del stack[open_at:]
            elif not m[3].endswith("/"):
                _, outer, within, in_comments = stack[-1]
                place, named, in_comments = _place(tag, m[3], outer, in_comments)
                n_parts += named
                opened.setdefault(tag, []).append(len(stack))
                # An article begins anew: the parts around it don't name it.
                stack.append((tag, place, (*within, n_parts) if named else () if place > outer else within, in_comments))
        out.append(block)
        _, place, within, _ = stack[-1]
        if not closing and tag not in NESTING and "=" in m[3] and _names(m[3]):
            n_parts += 1
            place, within = 0, (*within, n_parts)
        block, link = Block(place, tag in HEADINGS and not closing, within), 0
    out.append(block)
    return [b for b in out if any(p and not p.isspace() for p in b.parts)]


def density(block: Block, text: str, words: list[str], stops: frozenset[str] | None) -> bool | None:
    """What length, links and stop words alone say of a block; None is undecided.

    ``stops`` is None where no list covers the page's language.
    """
    links = block.linked / max(len(words), 1)
    if links > LINKS_HIGH or text.startswith(COPYRIGHT):
        return False
    if len(words) < SHORT_WORDS and len(text) < SHORT_CHARS or block.heading:
        return None if links == 0 else False
    share = sum(w in stops for w in words) / len(words) if stops is not None else STOPS_HIGH
    # Text without spaces has no words to count.
    if share >= STOPS_HIGH or len(words) < SHORT_WORDS:
        return True
    return None if share >= STOPS_LOW else False


def _overruled(found: list[tuple[Block, str]], judged: list[bool | None]) -> set[int]:
    """Named parts to be taken as ordinary containers, so that the page has main text outside of parts, if it has any."""
    gone: set[int] = set()
    while True:
        held: Counter[int] = Counter()
        for (block, text), label in zip(found, judged):
            if label:
                part = next((p for p in block.within if p not in gone), None)
                if part is None:
                    return gone
                held[part] += len(text)
        if not held:
            return gone
        part, most = held.most_common(1)[0]
        if 2 * most < sum(held.values()):
            return gone
        gone.add(part)


def keep(found: list[tuple[Block, str]], stops: frozenset[str] | None) -> list[bool]:
    """Which blocks are main text; None stands for undecided between the passes."""
    split = [text.lower().split() for _, text in found]
    judged = [density(block, text, words, stops) for (block, text), words in zip(found, split)]
    in_article = any(block.place and label is not False for (block, _), label in zip(found, judged))
    gone = set() if in_article else _overruled(found, judged)
    labels: list[bool | None] = []
    for (block, _), words, label in zip(found, split, judged):
        if any(p not in gone for p in block.within):
            label = False
        elif block.place:
            label = label is not False or block.linked <= 2 * LINKS_HIGH * len(words)
        labels.append(label)
    decided = [k for k, label in enumerate(labels) if label is not None]
    out, after = [], 0
    for k, label in enumerate(labels):
        if label is not None:
            out.append(label)
            continue
        while after < len(decided) and decided[after] < k:
            after += 1
        # Both ends of the page count as decided boilerplate.
        left = decided[after - 1] if after else -1
        right = decided[after] if after < len(decided) else len(labels)
        left_label, right_label = bool(after and labels[left]), bool(after < len(decided) and labels[right])
        if left_label == right_label:
            out.append(left_label)
        elif found[k][0].heading:
            out.append(right_label)
        elif len(split[k]) >= SHORT_WORDS:
            out.append(True)
        else:
            out.append(left_label if k - left < right - k else right_label if right - k < k - left else False)
    return out


def page_stops(texts: list[str], lists: Sequence[frozenset[str]]) -> frozenset[str] | None:
    """The list that covers most of the page's words; None if none covers ``STOPS_LOW`` of them."""
    words = Counter(w for t in texts for w in t.lower().split())
    total = sum(words.values())
    covers = [sum(words[w] for w in stops if w in words) for stops in lists]
    best = max(covers, default=0)
    return lists[covers.index(best)] if best and best >= STOPS_LOW * total else None


def main_text(page: str, lists: Sequence[frozenset[str]]) -> str:
    found = [(b, t) for b in blocks(page) if (t := b.text())]
    stops = page_stops([t for _, t in found], lists)
    return "\n".join(t for (_, t), good in zip(found, keep(found, stops)) if good)


def stop_words(pages: DataFrame, n: int = STOP_WORDS) -> list[frozenset[str]]:
    """The ``n`` commonest words of the blocks of all pages that declare a language, for each of them and for the others.

    Letters only, ties by the word; two or three letters of the declaration count.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: dict[str, Counter[str]] = {}
            for value in batch["html"]:
                page = value.as_py() or ""
                declared = _LANG.search(page)
                words = total.setdefault(declared[1].lower() if declared else "", Counter())
                for block in blocks(page):
                    words.update(block.text().lower().split())
            rows = [(lang, w, k) for lang, words in total.items() for w, k in words.items() if w.isalpha()]
            columns = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()))], names=["lang", "word", "n"])

    counted = pages.select("html").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    lists: dict[str, set[str]] = {}
    for r in counted.withColumn("place", place).filter(F.col("place") <= n).collect():
        lists.setdefault(r["lang"], set()).add(r["word"])
    return [frozenset(lists[lang]) for lang in sorted(lists)]


def extract_text(pages: DataFrame) -> DataFrame:
    """Add text (the main text, blocks joined by a line break) and n_chars to every row.

    Defined cases: a null or empty page, or one without main text, has an empty
    text; unclosed tags end with the page, unclosed quotes with their tag; character references are decoded,
    unknown ones stay; white space within a block becomes one space.  Input
    columns text and n_chars are replaced.
    """
    pages = pages.drop("text", "n_chars")
    lists = stop_words(pages)

    @F.arrow_udf(T.StringType())
    def extract(column: pa.Array) -> pa.Array:
        return pa.array([main_text(p.as_py() or "", lists) for p in column], pa.string())

    return pages.withColumn("text", extract("html")).withColumn("n_chars", F.length("text").cast("long"))
