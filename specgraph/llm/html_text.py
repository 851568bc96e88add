"""Main text of web pages by two-pass block rules.

A page is read once, tag by tag; block-level tags cut its text into blocks.
Elements that hold no article text by what they are (navigation, page header and
footer, aside, scripts, controls, hidden ones, such roles) are left out.

* Pass 1 decides each block by its link density, its density of stop words and its
  length: many links or, in a long block, hardly a stop word make it boilerplate;
  a dense block or a long one of middling density is text; notices about cookies and
  copyright lines are boilerplate; the others are open.  On a page that has hardly a
  stop word at all, or nothing that is text by them, lengths and links decide.
* Containers whose class names or ids speak of menus, adverts, comments and the
  like are weighed by the labels of pass 1: one is left out if there is text enough
  beside it (how much depends on what else its name says), or if it is mostly links; a name by itself takes
  nothing away, so an article in a container of such a name stays.
* Article and main elements are a prior, and only if they hold at least half of the
  text: inside, only runs of bare links and longer blocks with links and
  hardly a stop word are out at once, other doubtful blocks are open; outside,
  only a high density of stop words makes a block text at once.
* Pass 2 gives open blocks the label of their nearest decided neighbours; where
  these differ, a heading takes the label of what follows it, and any other
  block that of the closer one (the earlier one if equally close).  Where there is
  a prior, it decides unless the neighbours on both sides speak against it.

White space inside a block becomes one space; blocks are joined by one newline.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specgraph.llm.encoders import small_batches

GOOD, BAD, OPEN = 1, -1, 0

#: Lengths in code points, densities as shares of the words or code points of a block.
SHORT, LONG = 70, 200
LINKS_HIGH, LINKS_ONLY = 0.33, 0.8
STOP_NONE, STOP_LOW, STOP_HIGH = 0.05, 0.15, 0.30

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    """
    a about after all also an and any are as at be because been but by can could did do for from had has have he her his how i if in into
    is it its more no not of on one only or other our out she so some than that the their them then there they this to up was we were what
    when which who will with would you your
    aber als am auch auf aus bei das dass dem den der des die durch ein eine einem einen einer er es für hat ich im ist mit nach nicht
    noch nur oder sich sie sind so und von war wie wir zu zum zur
    au aux avec ce cette dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas plus pour que qui sa se ses son
    sur un une vous
    al como con cuando de del el ella ellos en entre es esta este ha la las lo los me mi muy no o para pero por que se si sin sobre su sus
    también un una y ya
    """.split()
)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg math canvas iframe object audio video textarea title xmp noembed noframes".split())
DROPPED = frozenset("head nav footer aside button select menu dialog datalist".split())
REGION = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCK = (
    frozenset(
        """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form head
        header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul""".split()
    )
    | HEADINGS
)
#: Starting one of these ends an open one of the group, up to the nearest of the fence.
CLOSES = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu"})), "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})), "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "tr": (frozenset({"tr"}), frozenset({"table"})), "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})), "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "option": (frozenset({"option"}), frozenset({"select"})),
}

# Words in class names, ids and roles of containers that hold no article text.
NAME_WORDS = frozenset(
    """
    ad ads adsense advert adverts advertisement advertising adbox banner breadcrumb breadcrumbs byline captcha comment comments commentlist
    consent cookie cookies copyright disclaimer disqus feedback foot footer gdpr header infobar login masthead menu menubar modal nav navbar
    navigation newsletter notice notices notification outbrain overlay pager paging pagination paywall popup promo promotion promoted
    recommendation recommendations recommended related reply replies respond rail search share sharing sidebar signup skip social sponsor
    sponsored sponsors subscribe subscription taboola toolbar topbar widget widgets
    """.split()
)
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
# What follows one of these says what a container has; the last of them, in which state the page is.
LAYOUT_WORDS = frozenset("has with no without is js".split())
STATE_WORDS = frozenset("enabled open closed free required allowed on off".split())
# Words in names of containers that may wrap a whole page, and of ones that hold articles.
SCOPE_WORDS = frozenset("layout page wrap wrapper container site outer inner holder".split())
TEXT_WORDS = frozenset("article blog body content entry main news post story text".split())
# Of the words above, those that names of wrappers may have for what stands beside the text.
BESIDE_WORDS = frozenset("banner modal notice overlay popup rail sidebar toolbar widget widgets".split())
#: What a container's name says: nothing; it speaks of an aside and of text or layout; of text, then of an aside; of an aside alone.
NO, MIXED, TAIL, ASIDE, OUT = 0, 1, 2, 3, 4
#: Text beside such a container, as a share of its own, from which it is left out.
BESIDE = {MIXED: 1.0, TAIL: 1 / 8, ASIDE: 1 / 20}

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>")
LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
LETTERS = re.compile(r"[^\W\d_]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
COPYRIGHT = re.compile(r"©|\(c\)\s*\d{4}|\bcopyright\b", re.I)
# Words of consent notices, in the languages of the stop words.
COOKIE = re.compile(r"\bcookies?\b", re.I)
CONSENT = re.compile(r"\b(?:accept|agree|consent|privacy|preferences|settings|experience|akzeptier|zustimm|einwillig|datenschutz|einstellung|accepte|confidentialité|paramètr|acept|privacidad|preferencias)", re.I)
#: Consent notices are no longer than this.
NOTICE = 600


def _parts(name: str) -> list[str]:
    parts = [p.lower() for p in NAME_PART.findall(name)]
    return parts[: next((i for i, p in enumerate(parts) if p in LAYOUT_WORDS), len(parts))]


def _named(value: str, in_region: bool) -> int:
    """How strongly a list of class names, or an id, speaks of an aside.  Inside an article a header is the article's own."""
    found, text = NO, False
    for name in value.split():
        parts = _parts(name)
        aside = [i for i, p in enumerate(parts) if p in NAME_WORDS and not (in_region and p == "header")]
        words = [i for i, p in enumerate(parts) if p in TEXT_WORDS]
        if not aside or parts[-1] in STATE_WORDS:
            text = text or bool(words)
        elif words and words[-1] > aside[-1]:
            found = max(found, MIXED)
        elif words:
            found = max(found, TAIL)
        elif not SCOPE_WORDS.isdisjoint(parts) and {parts[i] for i in aside} <= BESIDE_WORDS:
            found = max(found, MIXED)
        else:
            found = ASIDE
    return TAIL if found == ASIDE and text else found


def _suspect(tag: str, attributes: str, in_region: bool) -> int:
    """OUT for elements that hold no article text, else how strongly the element's names, or a form, speak against it."""
    if tag in DROPPED or (tag == "header" and not in_region):
        return OUT
    form = TAIL if tag == "form" else NO
    if not attributes or tag in ("html", "body", "article", "main"):
        return form
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or HIDDEN.search(found.get("style", "")):
        return OUT
    if found.get("role", "").lower() in ROLES:
        return OUT
    return max(form, *(_named(unescape(found.get(k, "")), in_region) for k in ("class", "id")))


class Block:
    """``doubts`` are the suspect containers around it from the outside in, as (number, what its name says, whether it stands in an article)."""

    __slots__ = ("text", "linked", "heading", "region", "doubts", "density")

    def __init__(self, text: str, linked: int, heading: bool, region: bool, doubts: tuple[tuple[int, int, bool], ...] = ()):
        self.text, self.linked, self.heading, self.region, self.doubts = text, linked, heading, region, doubts
        self.density: float | None = None  # of stop words, once it is asked for

    def stops(self) -> float:
        if self.density is None:
            self.density = stop_density(self.text)
        return self.density


def blocks(html: str) -> list[Block]:
    """Blocks of text outside the containers that are left out, in page order."""
    found = all_blocks(html)
    if not any(b.doubts for b in found):
        return found
    gone = asides(found)
    return [b for b in found if not any(d[0] in gone for d in b.doubts)]


def asides(found: list[Block]) -> set[int]:
    """Numbers of the suspect containers that are left out, by the labels that pass 1 gives the blocks inside and beside them.

    Beside a container stands what is in none of the suspect ones but those around it.
    """
    labels = evidence(found)
    read = any(b.region and label != BAD for b, label in zip(found, labels))  # an article element holds text
    own: dict[tuple, list[int]] = {}  # by containers: code points that are text, not boilerplate, linked, all
    for b, label in zip(found, labels):
        sums = own.setdefault(b.doubts, [0, 0, 0, 0])
        n = len(b.text)
        sums[0] += n * (label == GOOD or (b.region and label != BAD))
        sums[1] += n * (label != BAD)
        sums[2] += b.linked
        sums[3] += n
    inside: dict[tuple, list[int]] = {}
    for path, sums in own.items():
        for k in range(1, len(path) + 1):
            total = inside.setdefault(path[:k], [0, 0, 0, 0])
            for i, x in enumerate(sums):
                total[i] += x
    out = set()
    for path, (good, plain, linked, whole) in inside.items():
        number, says, in_region = path[-1]
        beside = [own.get(path[:k], (0, 0))[:2] for k in range(len(path))]
        good_beside, plain_beside = (sum(x[i] for x in beside) for i in (0, 1))
        if read and not in_region and not any(d[2] for d in path):
            # The page's article is elsewhere, unless it stands in this container.
            if not any(b.region for b in found if path[-1] in b.doubts):
                out.add(number)
                continue
        if linked > LINKS_HIGH * whole:
            out.add(number)
        elif says == ASIDE or not good:
            if plain_beside > 0 and plain_beside >= BESIDE[says] * plain:
                out.add(number)
        elif good_beside >= BESIDE[says] * good:
            out.add(number)
    return out


def all_blocks(html: str) -> list[Block]:
    """Blocks with the suspect containers around them."""
    out: list[Block] = []
    stack: list[str] = []
    text: list[str] = []
    doubts: list[tuple[int, tuple[int, int, bool]]] = []  # depth and description of the suspect containers that are open
    linked = out_at = region = links = paragraphs = numbered = 0
    heading, breaks, at, end = False, 0, 0, len(html)

    def flush() -> None:
        nonlocal text, linked, heading
        if text:
            joined = " ".join(unescape("".join(text)).split())
            if joined:
                out.append(Block(joined, min(linked, len(joined)), heading, region > 0, tuple(d for _, d in doubts)))
        text, linked, heading = [], 0, False

    def pop(depth: int) -> None:
        nonlocal out_at, region, links, paragraphs
        while len(stack) > depth:
            gone = stack.pop()
            region -= gone in REGION
            links -= gone == "a"
            paragraphs -= gone == "p"
        if out_at > depth:
            out_at = 0
        while doubts and doubts[-1][0] > depth:
            doubts.pop()

    while at < end:
        k = html.find("<", at)
        k = end if k < 0 else k
        if k > at and not out_at:
            piece = html[at:k]
            text.append(piece)
            breaks = breaks if piece.isspace() else 0
            if links:
                linked += len(unescape(piece).strip())
        if k == end:
            break
        at = k
        following = html[k + 1 : k + 2]
        if html.startswith("<!--", k):
            k = html.find("-->", k + 4)
            at = end if k < 0 else k + 3
            continue
        if following in ("!", "?"):
            k = html.find(">", k)
            at = end if k < 0 else k + 1
            continue
        m = TAG.match(html, at) or LOOSE_TAG.match(html, at)
        if not m:
            if following.isalpha() or following == "/":
                at = end if html.find(">", at) < 0 else html.find(">", at) + 1  # a tag that the page's end cuts off
            else:
                text.append("<") if not out_at else None
                at += 1
            continue
        at = m.end()
        closing, tag, attributes = m[1], m[2].lower(), m[3]
        if tag == "br":
            breaks += 1
            if not out_at:
                flush() if breaks > 1 else text.append(" ")
            continue
        if tag in BLOCK:
            flush()
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i] == tag:
                    pop(i)
                    break
                if tag not in BLOCK and stack[i] in BLOCK:
                    break
            continue
        if tag in RAW:
            if not attributes.endswith("/"):
                k = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(html, at)
                close = html.find(">", k.start()) if k else -1
                at = end if close < 0 else close + 1
            continue
        if tag in VOID:
            continue
        if tag in BLOCK and paragraphs:  # any block ends an open paragraph
            i = len(stack) - 1
            while i >= 0 and (stack[i] not in BLOCK or stack[i] == "p"):
                if stack[i] == "p":
                    pop(i)
                    break
                i -= 1
        if tag in CLOSES:
            group, fence = CLOSES[tag]
            for i in range(len(stack) - 1, -1, -1):
                if stack[i] in group:
                    pop(i)
                    break
                if stack[i] in fence:
                    break
        if tag == "body" and "head" in stack:
            pop(stack.index("head"))
        stack.append(tag)
        region += tag in REGION
        links += tag == "a"
        paragraphs += tag == "p"
        if not out_at:
            says = _suspect(tag, attributes, region > 0)
            if says == OUT:
                flush()
                out_at = len(stack)
            elif says:
                flush()
                numbered += 1
                doubts.append((len(stack), (numbered, says, region > 0)))
            if tag in HEADINGS:
                heading = True
    flush()
    return out


def stop_density(text: str) -> float:
    """Stop words, as runs of letters, for each word, as it stands between white space; 1 at most."""
    words = text.count(" ") + 1
    return min(1.0, sum(map(STOP_WORDS.__contains__, LETTERS.findall(text.lower()))) / words)


def _by_density(text: str, density: float, linked: int) -> int:
    """The label of a block without many links."""
    if len(text) < SHORT:
        return BAD if linked else OPEN
    if density >= STOP_HIGH:
        return GOOD
    if density >= STOP_LOW:
        return GOOD if len(text) >= LONG else OPEN
    return BAD if (len(text) >= LONG and density < STOP_NONE) or linked else OPEN


def _by_length(text: str, linked: int) -> int:
    return GOOD if len(text) >= LONG else BAD if linked and len(text) < SHORT else OPEN


def evidence(found: list[Block]) -> list[int]:
    """The label of each block by its own links, length and stop words, wherever it stands."""
    by_links = [b.linked > LINKS_HIGH * len(b.text) for b in found]
    density = [0.0 if bad else b.stops() for b, bad in zip(found, by_links)]
    words = [0 if bad else b.text.count(" ") + 1 for b, bad in zip(found, by_links)]
    unknown = sum(d * n for d, n in zip(density, words)) < STOP_NONE * sum(words)

    def labels(by_length: bool) -> list[int]:
        out = []
        for b, d, bad in zip(found, density, by_links):
            n = len(b.text)
            if bad or (n < LONG and COPYRIGHT.search(b.text)) or (n < NOTICE and COOKIE.search(b.text) and CONSENT.search(b.text)):
                out.append(BAD)
            else:
                out.append(_by_length(b.text, b.linked) if by_length else _by_density(b.text, d, b.linked))
        return out

    out = labels(unknown)
    return out if unknown or GOOD in out else labels(True)


def priors(found: list[Block], labels: list[int]) -> list[int]:
    """GOOD inside and BAD outside article and main, if these hold at least half of the text that isn't links or is good by itself; else OPEN."""
    inside = sum(len(b.text) - b.linked for b in found if b.region)
    outside = sum(len(b.text) for b, label in zip(found, labels) if label == GOOD and not b.region)
    if inside < outside or not any(b.region for b in found):
        return [OPEN] * len(found)
    return [GOOD if b.region else BAD for b in found]


def first_pass(found: list[Block], own: list[int] | None = None) -> list[int]:
    own = evidence(found) if own is None else own
    bare = [b.linked >= LINKS_ONLY * len(b.text) for b in found]
    labels = []
    for i, (b, label, prior) in enumerate(zip(found, own, priors(found, own))):
        if prior == GOOD and label == BAD:
            in_run = bare[i] and ((i > 0 and bare[i - 1]) or (i + 1 < len(found) and bare[i + 1]))
            link_text = b.linked and len(b.text) >= SHORT and b.stops() < STOP_LOW
            label = BAD if in_run or link_text else OPEN
        elif prior == BAD and label == GOOD and b.stops() < STOP_HIGH:
            label = OPEN
        labels.append(label)
    return labels


def second_pass(found: list[Block], labels: list[int], prior: list[int] | None = None) -> list[int]:
    """Neighbours are looked for on the block's own side of an article's edge; against the prior they must agree on both sides."""
    n = len(found)
    prior = prior or [OPEN] * n
    before: list[tuple[int, int]] = []  # label of the nearest decided block before, code points between
    label, gap = OPEN, 0
    for i in range(n):
        if i and prior[i] != prior[i - 1]:
            label, gap = OPEN, 0
        before.append((label, gap))
        label, gap = (labels[i], 0) if labels[i] else (label, gap + len(found[i].text))
    out, label, gap = list(labels), OPEN, 0
    for i in range(n - 1, -1, -1):
        if i + 1 < n and prior[i] != prior[i + 1]:
            label, gap = OPEN, 0
        if labels[i]:
            label, gap = labels[i], 0
            continue
        earlier, distance = before[i]
        if prior[i]:
            out[i] = earlier if earlier and earlier == label else prior[i]
        elif not earlier or not label or earlier == label:
            out[i] = earlier or label or GOOD
        elif found[i].heading:
            out[i] = label
        else:
            out[i] = earlier if distance <= gap else label
        gap += len(found[i].text)
    return out


def main_text(html: str | None) -> str:
    found = blocks(html or "")
    own = evidence(found)
    kept = second_pass(found, first_pass(found, own), priors(found, own))
    return "\n".join(b.text for b, label in zip(found, kept) if label == GOOD)


def _extract(batches):
    for batch in small_batches(batches):
        texts = [main_text(h) for h in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of each page.

    Null or empty html gives an empty text.  Null keys and urls and repeated
    pages pass through row by row; other columns are left out.
    """
    return pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html")).mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
