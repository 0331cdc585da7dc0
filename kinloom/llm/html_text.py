"""HTML extraction: blocks are classified by rules in two passes."""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from kinloom.llm.common import intake, outgo

#: Frequent words of English, French, German and Spanish.
STOP_WORDS = frozenset(
    """
    a an and are as at be but by for from had has have he her his if in is it its not of on or she that the their
    them there they this to was we were which who will with would you
    au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas plus
    pour qu que qui sa se ses son sont sur un une vous
    aber als am auch auf aus bei das dem den der des die durch ein eine einem einen einer er es für hat ich im ist
    mit nach nicht noch nur oder sich sie sind so um und von vor war wenn werden wie wird zu zum zur über
    al como con del el ella ellos era esta este fue ha la las lo los más me mi muy no nos o para pero por porque
    se si sin sobre su sus también un una y ya
    """.split()
)
BLOCK_TAGS = frozenset(
    """address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption
    figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre
    section select summary table tbody td tfoot th thead title tr ul video audio canvas iframe object""".split()
)
#: Elements whose content is never text of the page.
RAW_TAGS = frozenset("script style noscript template textarea title iframe svg math object canvas audio video select".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())
ASIDE_TAGS = frozenset("nav footer aside form menu dialog button fieldset".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar".split())
ASIDE_NAMES = frozenset(
    """ad ads adbox adslot banner byline copyright dialog disclaimer disqus footer gdpr login masthead menu modal nav
    navigation notice notices notification overlay pager pagination popup promo promoted promotion recommendations
    recommended related replies reply share sharing signup social subscribe subscription survey tags toc toolbar
    topbar widget widgets""".split()
)
ASIDE_STARTS = ("advert", "sponsor", "comment", "cookie", "consent", "sidebar", "newsletter", "breadcrumb", "navbar", "adsense")
#: A class with one of these describes a wrapper, not an aside.
WRAPPER_NAMES = frozenset("has with no without page wrapper layout container body root site".split())
MAIN_NAMES = ("articlebody", "article-body", "post-content", "entry-content", "article-content", "story-body")

#: Rules of the first pass, in code points and shares.
SHORT, LONG, STOP_LOW, STOP_HIGH, LINKS = 70, 200, 0.2, 0.3, 0.5
#: What a block's surroundings add to its stop words' share: in the article, and outside of the article that a page marks.
INSIDE, OUTSIDE = 0.3, -1.0
#: A short block that begins so is a notice of rights.
_RIGHTS = re.compile(r"(?:©|\(c\)|copyright\b|all rights reserved)", re.I)
_LETTERS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")

# The loop over a tag's inside never backs up, so broken quotes cost no more than their length.
# A quoted value has any length; one with "<" in it ends where a value can end, at a quote before a space, "/" or ">",
# or is short: else its closing quote is missing, and the next tag's quote would swallow the text between.
_VALUE = r"{0}(?:[^<{0}]*+{0}|[^{0}]*+{0}(?=[\s/>])|[^{0}]{{0,9999}}{0})"
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']|{_VALUE.format('"')}|{_VALUE.format("'")}|[\"'])*+)>", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\b(hidden)\b")
_NAME = re.compile(r"[^a-z0-9]+")

GOOD, BAD, OPEN = 1, 0, None


@dataclass
class Block:
    raw: list[str] = field(default_factory=list)
    linked: list[str] = field(default_factory=list)
    aside: bool = False
    main: bool = False
    heading: int = 0
    begun: bool = False
    text: str = ""
    label: int | None = OPEN


def _kind(tag: str, attributes: str) -> str:
    """'aside', 'hint' (an aside by its name only), 'main' or ''."""
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes) if m[1]} if attributes.strip() else {}
    role = found.get("role", "").lower()
    if tag in ASIDE_TAGS or role in ASIDE_ROLES or re.search(r"\bhidden\b(?!\s*=\s*[\"']?false)", re.sub(r"\"[^\"]*\"|'[^']*'", "", attributes)) or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", found.get("style", "")):
        return "aside"
    named = f"{found.get('class', '')} {found.get('id', '')}".lower()
    for name in named.split():
        words = [w for w in _NAME.split(name) if w]
        if not WRAPPER_NAMES & set(words) and any(w in ASIDE_NAMES or w.startswith(ASIDE_STARTS) for w in words):
            return "hint"
    if tag in ("article", "main") or role in ("main", "article") or found.get("itemprop", "").lower() == "articlebody" or any(n in named for n in MAIN_NAMES):
        return "main"
    return "header" if tag == "header" else ""


def blocks_of(page: str) -> list[Block]:
    """The page's blocks in order, with what surrounds them."""
    # The stack holds (tag, aside, main, within a certain aside) of what is open, so a tag costs the same at any depth.
    out, block, stack, links, at = [], Block(), [], 0, 0
    open_tags: Counter = Counter()
    seen_main = False

    def close() -> None:
        nonlocal block
        text = " ".join(html.unescape("".join(block.raw)).split())
        if text:
            block.text = text
            out.append(block)
        block = Block()

    def within(kind: str) -> tuple[bool, bool, bool]:
        """What an element of this kind makes of the state around it."""
        aside, main, certain = stack[-1][1:] if stack else (False, False, False)
        certain = certain or kind == "aside"
        if kind == "main!":
            return False, True, certain
        return aside or kind in ("aside", "hint") or kind == "header" and not main, main or kind == "main", certain

    aside = main = False

    def add(piece: str) -> None:
        if piece:
            if not block.begun:
                block.aside, block.main = aside, main
                block.begun = not piece.isspace()
            block.raw.append(piece)
            if links:
                block.linked.append(piece)

    while True:
        m = _TOKEN.search(page, at)
        add(page[at : m.start() if m else len(page)])
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag == "a":
                links = max(0, links - 1)
            if tag in BLOCK_TAGS:
                close()
            while open_tags[tag]:
                last = stack.pop()[0]
                open_tags[last] -= 1
                if last == tag:
                    aside, main = stack[-1][1:3] if stack else (False, False)
                    break
            continue
        if tag == "br":
            add(" ")
            continue
        if tag in RAW_TAGS and not m[3].endswith("/"):
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page) if tag in ("script", "style") else at
            if tag in BLOCK_TAGS:
                close()
            continue
        if tag == "a":
            links = 1
        if tag in BLOCK_TAGS:
            close()
            links = 0 if tag not in ("li",) else links
            if tag[0] == "h" and tag[1:].isdigit():
                block.heading = int(tag[1])
        if tag in VOID_TAGS or m[3].endswith("/"):
            continue
        if tag in BLOCK_TAGS - {"p", "html", "body", "head"} and not (tag[0] == "h" and tag[1:].isdigit()) or tag in ("span", "p") and m[3].strip():
            kind = _kind(tag, m[3])
            if kind == "main" and not seen_main and not (stack and stack[-1][3]):
                seen_main, kind = True, "main!"
            if kind or tag in BLOCK_TAGS - {"li", "dt", "dd", "tr", "td", "th", "option", "p"}:
                if kind in ("aside", "hint") and tag == "span":
                    kind = "" if block.raw else kind
                stack.append((tag, *within(kind)))
                open_tags[tag] += 1
                aside, main = stack[-1][1:3]
    close()
    return out


def densities(b: Block) -> tuple[float, float]:
    """Shares of stop words in a block's words, and of links in its characters."""
    words = _LETTERS.findall(b.text.lower())
    return sum(w in STOP_WORDS for w in words) / max(1, len(words)), len(" ".join("".join(b.linked).split())) / max(1, len(b.text))


def first_pass(blocks: list[Block]) -> list[int | None]:
    """Labels by density, length and links; the elements around a block are one more feature of it.

    An aside, a block of links and a notice of rights are bad.  A first-rank
    heading is good where the page marks no article; other headings, and short
    blocks but those half of links, are open.  Of the rest, long ones are good,
    and so are those with enough stop words, where being in the article counts
    for and being outside of the one that the page marks counts against.
    """
    whole = any(b.main and not b.aside for b in blocks)
    out: list[int | None] = []
    for b in blocks:
        stops, linked = densities(b)
        size = len(b.text)
        around = INSIDE if b.main else OUTSIDE if whole else 0.0
        if b.aside or linked > LINKS or (size < LONG and not b.main and _RIGHTS.match(b.text)):
            label = BAD
        elif stops + around <= 0 and whole:
            label = BAD
        elif b.heading:
            label = GOOD if b.heading == 1 and not whole else OPEN
        elif size < SHORT:
            label = BAD if linked > 0.3 else OPEN
        elif stops + around >= STOP_HIGH or (stops + around >= STOP_LOW or not whole) and size > LONG:
            label = GOOD
        else:
            label = OPEN
        out.append(label)
    return out


def second_pass(labels: list[int | None], silent: list[bool]) -> list[int]:
    """Open blocks take the label of the nearest decided one, the one before on ties; good where none is decided.

    ``silent`` blocks say nothing of their neighbours.
    """
    near: list[tuple[int, int] | None] = [None] * len(labels)
    for order in (range(len(labels)), range(len(labels) - 1, -1, -1)):
        last = None
        for i in order:
            if labels[i] is not OPEN:
                last = last if silent[i] else (i, labels[i])
            elif last is not None and (near[i] is None or abs(last[0] - i) < abs(near[i][0] - i)):
                near[i] = last
    return [label if label is not OPEN else GOOD if found is None else found[1] for label, found in zip(labels, near)]


def classify(blocks: list[Block]) -> None:
    """Set every block's label."""
    labels = first_pass(blocks)
    # In an article that the page marks, what was set aside says nothing of its neighbours.
    whole = any(b.main and not b.aside for b in blocks)
    for b, label in zip(blocks, second_pass(labels, [whole and x == BAD for x in labels])):
        b.label = label


def main_text(page: str) -> str:
    """The main text's blocks joined by blank lines."""
    blocks = blocks_of(page)
    classify(blocks)
    return "\n\n".join(b.text for b in blocks if b.label == GOOD)


def _extract(page: pa.Array) -> pa.Array:
    return pa.array([main_text(p.as_py() or "") for p in page], pa.string())


def extract_text(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """Add the main text of every page.

    First pass: stop words' and links' shares, length, and what surrounds a
    block (:func:`first_pass`).  Second pass: short blocks and headings take
    the label of the nearest decided neighbour, the one before on ties, good
    where there is none.

    Null and empty pages have empty text.  Rows are independent and nothing is
    shuffled; other columns stay whatever their names and nulls (one named like
    ``text_col`` is replaced); repeated rows give repeated texts; an empty table
    gives an empty one.  Broken markup is read as far as it can be told.
    """
    base, names = intake(pages, html_col)
    return outgo(base, names, {html_col: F.col("_w0"), text_col: F.arrow_udf(_extract, "string")(F.coalesce(F.col("_w0"), F.lit("")))})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    out = extract_text(pages)
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
