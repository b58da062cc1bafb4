"""Main text of web pages by two-pass block rules over stop-word density, length and link density.

The densities and the length of a block vote, and so does an article element around it, with no more weight than they have.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.common import by_bytes, table

SLICE_BYTES = 4 << 20
SHORT, LONG = 70, 200
STOP_LOW, STOP_HIGH = 0.30, 0.32
LINKS = 0.2
# Frequent function words of the languages served.
STOP_WORDS = frozenset(
    """
    a about after all also an and any are as at be because been before but by can could did do for from had has have he
    her him his how i if in into is it its just like may more most my no not now of on one only or other our out over
    she should so some such than that the their them then there these they this those to up was we were what when
    where which who will with would you your
    à au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou où par pas
    plus pour qu que qui sa se ses son sont sur un une vous y
    aber als am an auch auf aus bei bis das dass dem den der des die durch ein eine einem einen einer er es für hat ich
    ihr im in ist mit nach nicht noch nur oder sich sie sind so über um und von vor war wie wir zu zum zur
    al como con cuando de del desde donde e el ella en entre era es esta este fue ha hasta hay la las lo los me mi más
    muy no nos o para pero por porque que se sin sobre su sus también un una y ya yo
    che con da dei del della di e gli il in la le non per più si sono un una
    ao as com da das do dos e em na nas no nos não o os ou para pela pelo por que se seu sua um uma
    """.split()
)
# Elements whose content is no text of a page, elements that are page furniture, and elements that start a block.
SKIPPED = frozenset("script style noscript template textarea title svg math iframe select button object canvas audio video head".split())
FURNITURE = frozenset("nav footer aside form menu dialog fieldset".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
NESTING = frozenset("address article aside blockquote details dialog div dl fieldset figure footer form header main menu nav ol section table ul td".split())
# Words that make a class, id or role the name of page furniture, and words that such names are put together with.
NAMED = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert "
    "popup modal overlay newsletter subscribe subscription signup login breadcrumb breadcrumbs menu nav navbar navigation topbar toolbar sidebar aside "
    "widget widgets footer footnav header masthead comment comments commentlist respond replies reply disqus discussion share sharing social related "
    "recommended recommendations teaser teasers outbrain taboola pagination pager tags copyright legal disclaimer search skip complementary contentinfo".split()
)
JOINED = frozenset(
    "site page main top bottom left right primary secondary global post posts entry article articles story stories news list box block bar wrapper wrap container section area slot unit links link form inner outer "
    "user users reader readers thread body content text group row column panel strip zone holder item items mobile desktop small large".split()
)
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)", re.S)
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"\shidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WORD = re.compile(r"\w+")


@dataclass(slots=True)
class Block:
    text: str
    linked: int  # characters inside links
    inside: int  # number of the article or main element, 0 outside any
    furniture: bool
    heading: bool


def names_furniture(attributes: str, inside: bool) -> tuple[bool, set[str]]:
    """Whether an element's class, id or role names furniture, and all these names in lower case.

    A whole name counts: every word of it names furniture or goes with words that do ("site-header", never "has-sidebar").
    """
    names = {n for found in _NAMES.finditer(attributes) for n in (found[1] or found[2] or found[3] or "").lower().split()}
    for name in names:
        words = {w for w in re.split(r"[^a-z]+", name) if w}
        if words & NAMED and words <= NAMED | JOINED and not (inside and words == {"header"}):
            return True, names
    return False, names


def blocks(page: str) -> list[Block]:
    """A page's blocks of text in order, with what the rules need of their surroundings."""
    out: list[Block] = []
    # Open nesting elements: name, furniture or not, number of the article around.
    stack: list[tuple[str, bool, int]] = []
    open_, unclosed = Counter(), set()
    articles, links, heading = 0, 0, False
    held: list[str] = []
    linked = 0

    def close() -> None:
        nonlocal linked
        text = " ".join("".join(held).split())
        if text:
            _, furniture, inside = stack[-1] if stack else ("", False, 0)
            out.append(Block(text, linked, inside, furniture, heading))
        held.clear()
        linked = 0

    at, size = 0, len(page)
    while at < size:
        m = _TAG.search(page, at)
        chunk = page[at : m.start()] if m else page[at:]
        if chunk:
            text = entities.unescape(chunk)
            held.append(text)
            if links:
                linked += sum(map(len, text.split()))
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        name, ending = m[2].lower(), bool(m[1])
        if name in SKIPPED:
            if not ending and not m[3].endswith("/"):
                end = None if name in unclosed else re.compile(rf"</{name}\s*[^>]*>", re.I).search(page, at)
                if end:
                    at = end.end()
                elif name in ("script", "style"):
                    break
                else:
                    unclosed.add(name)
            continue
        if name == "a":
            links = 0 if ending else 1
        elif name == "br":
            held.append(" ")
        elif name in BLOCKS:
            close()
            links = 0
            heading = name in ("h1", "h2", "h3", "h4", "h5", "h6") and not ending
            if name in NESTING:
                if ending:
                    while open_[name]:
                        last = stack.pop()[0]
                        open_[last] -= 1
                        if last == name:
                            break
                else:
                    _, furniture, inside = stack[-1] if stack else ("", False, 0)
                    named, names = names_furniture(m[3], bool(inside)) if m[3] else (False, ())
                    if name in ("article", "main") or "main" in names:
                        if not furniture and not named and not inside:
                            articles += 1
                            inside = articles
                    furniture = furniture or named or name in FURNITURE or name == "header" and not inside or bool(m[3] and _HIDDEN.search(m[3]))
                    stack.append((name, furniture, inside))
                    open_[name] += 1
    close()
    return out


def stop_count(block: Block, stop_words: frozenset[str]) -> tuple[int, int]:
    """Stop words of a block, and all of its words."""
    words = _WORD.findall(block.text.lower())
    return sum(map(stop_words.__contains__, words)), len(words)


def first_pass(block: Block, stop_words: frozenset[str], articles: bool) -> str:
    """good or bad where the votes tell, else near (an even vote), weak (outvoted) or short.

    Furniture and blocks of links are bad whatever their words. Of other blocks from ``SHORT`` characters on, stop-word
    density votes for or against, a length from ``LONG`` on for, and an article around it for. Outside the article that a
    page marks, two votes stand against a block, and a short one is bad.
    """
    if block.furniture or block.linked > LINKS * len(block.text.replace(" ", "")):
        return "bad"
    place = 1 if block.inside else -2 if articles else 0
    if len(block.text) < SHORT:
        return "bad" if place < 0 else "short"
    stops, words = stop_count(block, stop_words)
    share = stops / max(1, words)
    votes = place + (len(block.text) >= LONG) + (1 if share >= STOP_HIGH else 0 if share >= STOP_LOW else -1)
    return "good" if votes > 0 else "near" if votes == 0 else "weak"


def seeded(found: list[Block], labels: list[str], stop_words: frozenset[str]) -> list[str]:
    """Where no block of a page is good, its undecided block with the most stop words is; the first, if several have as many.

    Where none has any, and all undecided ones are short, it is the longest.
    """
    open_ = [i for i, x in enumerate(labels) if x not in ("good", "bad")]
    if "good" in labels or not open_:
        return labels
    counts = {i: stop_count(found[i], stop_words)[0] for i in open_}
    best = max(open_, key=lambda i: (counts[i], len(found[i].text), -i))
    if not counts[best] and any(labels[i] != "short" for i in open_):
        return labels
    return [*labels[:best], "good", *labels[best + 1 :]]


def second_pass(found: list[Block], labels: list[str]) -> list[str]:
    """Labels good and bad only: an undecided block takes the label of the nearest decided block on either side.

    Where the two differ a nearly good block is good, a heading goes with what follows, and else the nearer one counts
    (the bad one, if both are as near). Furniture is no neighbour. The edges of an article, whose neighbours are of the
    same article, count as good; at the edges of other pages only the other side counts, and with no side at all a nearly
    good block is good and others are bad.
    """
    out = list(labels)
    decided = [x in ("good", "bad") and not b.furniture for x, b in zip(labels, found, strict=True)]
    nearest: list[list[int]] = []
    for order in (range(len(found)), range(len(found) - 1, -1, -1)):
        place, last = [-1] * len(found), -1
        for i in order:
            place[i] = last
            if decided[i]:
                last = i
        nearest.append(place)
    for i, b in enumerate(found):
        if labels[i] in ("good", "bad"):
            continue
        sides = []
        for place in nearest:
            j = place[i]
            if j >= 0 and found[j].inside == b.inside:
                sides.append((abs(i - j), labels[j]))
            else:
                sides.append((len(found), "good" if b.inside else ""))
        told = {x for _, x in sides if x}
        if len(told) == 1:
            out[i] = told.pop()
        elif labels[i] == "near":
            out[i] = "good"
        elif not told:
            out[i] = "bad"
        else:
            out[i] = sides[1][1] if b.heading else min(sides)[1]
    return out


def main_text(page: str | None, stop_words: frozenset[str] = STOP_WORDS) -> str:
    """The kept blocks of a page, joined by one space."""
    found = blocks(page or "")
    articles = any(b.inside and not b.furniture for b in found)
    labels = second_pass(found, seeded(found, [first_pass(b, stop_words, articles) for b in found], stop_words))
    return " ".join(b.text for b, label in zip(found, labels, strict=True) if label == "good")


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", stop_words: frozenset[str] = STOP_WORDS) -> DataFrame:
    """One row per page row: page_id, url, text, n_chars (code points).

    A null or empty page, or one without main text, has an empty text. Any length is read whole; ids and urls may be
    null or repeated; an empty table gives no rows; other columns are not read.
    """
    src = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    schema = T.StructType([src.schema["page_id"], src.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "html", SLICE_BYTES):
            text = [main_text(x, stop_words) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()), pa.array(list(map(len, text)), pa.int64())], names=schema.names)

    return src.mapInArrow(run, schema)


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
