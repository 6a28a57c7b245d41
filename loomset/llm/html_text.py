"""Main text of web pages by tag-path ratios.

Every piece of text hangs on a path of tags from the root. Text of an article shares few paths
that carry long text with much punctuation; menus and boxes have many nodes with little of both.
Per path, text length and punctuation are summed and divided by the number of nodes, smoothed
over the paths that come before and after, multiplied, and held against a threshold. Blocks on the paths
above it are the article, wherever they stand, with the headings over them. Of what is below it,
blocks that stand between them belong to it too, but link lists and boxes do not. The tags article
and main are a hint: outside them a path must reach more, inside them sentences are enough.

A null or empty page, and one without text, gives the empty string. Pages of any size are read
whole, and markup that is cut off or never closed is read as far as it goes. Repeated rows give
repeated results.
"""

from __future__ import annotations

import re
from collections import defaultdict
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomset.llm.workers import map_batches, texts_of

# Share of the spread of the fused ratios that a path must reach; share of the best one that it must
# reach outside the tags that name an article, where these hold most text of the first kind.
THRESHOLD = 0.3
OUTSIDE = 0.5
_KERNEL = np.array([0.06, 0.24, 0.4, 0.24, 0.06])

_VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main "
    "menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
_NEVER = frozenset(
    "head title script style noscript template nav footer aside button select textarea label legend "
    "option iframe svg math canvas object audio video menu dialog datalist".split()
)
_CONTAINER = frozenset("article main".split())
# Blocks of one of the first stand beside each other; the second may stand in one of their own.
_SECTION = frozenset("article body div html main section".split())
_WRAPPED = frozenset("blockquote figure pre table".split())
_LIST = frozenset("dl ol table ul".split())
# An open element of the first kind ends where one of the second starts.
_ENDS = {
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]),
    "th": frozenset(["td", "th"]),
    "option": frozenset(["option"]),
}
_KEEPS_OPEN = frozenset("html body div section article main table ul ol dl blockquote".split())

# Tags that may hold a box. Headings, paragraphs, items and what stands in a line are no boxes.
_BOX = frozenset(
    "article aside details div dl fieldset figure form header ol section table ul".split()
)
# Words of class, id and role that name what is no article, and words that may stand beside them.
_NOISE = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising banner breadcrumb breadcrumbs "
    "byline captcha comment comments commentlist consent cookie cookies copyright dialog disclaimer "
    "disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices "
    "pager pagination popup promo promoted promotion recommended related replies reply search "
    "share sharing sidebar signup skip social sponsor sponsored subscribe subscription teaser "
    "toolbar tooltip topbar widget alert complementary contentinfo form".split()
)
_NOISE_ARTICLE = frozenset(
    "ad advert advertisement comment comments promo related reply sponsored teaser".split()
)
_BESIDE = frozenset(
    "area articles aside bar block body bottom box button buttons card container content entry "
    "group holder icons inner item items left link links list main media module outer page panel "
    "post posts right row section site slot stories thread top unit wrap wrapper".split()
)
# What links under a reader's comment say, whatever the comment's classes are.
_ANSWER = frozenset("reply antworten répondre responder report flag".split())
# Characters, such as a date, that may stand beside that link.
_BESIDE_ANSWER = 40
_NOISE_HEADER = frozenset(["header", "pageheader", "siteheader"])
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
# Content of these is no markup: it runs to the end tag.
_RAW = {
    tag: re.compile(f"</{tag}(?=[\\s/>])", re.I)
    for tag in "script style textarea title iframe xmp noembed noframes".split()
}
_OPEN_TAG = re.compile(
    r"""<([a-zA-Z][^\s/>]*+)((?:[^>"'=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|[="'])*+)>"""
)
_END_TAG = re.compile(r"</([a-zA-Z][^\s/>]*+)[^>]*+>")
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_SENTENCE = re.compile(r"[.!?…。！？][\"'»”)]*\s*$")
_PUNCTUATION = re.compile(r"[.,;:!?…。、，！？；：¿¡\"'()«»“”]")


def _names_noise(token: str, noise: frozenset[str]) -> bool:
    """Whether a class names a box: as a whole, or by its words if nothing else is among them."""
    if token.lower() in noise:
        return True
    words = {word.lower() for word in _WORD.findall(token) if len(word) > 1}
    return bool(words & noise) and words <= _NOISE | _BESIDE


def _is_hidden(attrs: str) -> bool:
    for found in _ATTRIBUTE.finditer(attrs):
        name, value = found[1].lower(), found[2] or found[3] or found[4]
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if name == "style" and value and _HIDDEN.search(value):
            return True
    return False


def _is_noise(tag: str, attrs: str, in_article: bool) -> bool:
    """Whether class, id or role name a box that is no article. An id inside an article is a place
    to link to and names none."""
    if tag not in _BOX:
        return False
    if tag == "form":  # a page may be wrapped in one
        return True
    noise = _NOISE_ARTICLE if tag == "article" else _NOISE
    for found in _ATTRIBUTE.finditer(attrs):
        name, value = found[1].lower(), found[2] or found[3] or found[4]
        if not value or name not in ("class", "id", "role") or (name == "id" and in_article):
            continue
        tokens = value.split()
        if any(_names_noise(token, noise) for token in tokens):
            return True
        if tag in ("div", "section", "table") and {t.lower() for t in tokens} & _NOISE_HEADER:
            return True
    return False


class PageReader:
    """Reads a page into nodes of text, each with its path, element and block."""

    def __init__(self) -> None:
        # By the path above, tag, and whether names say that a box starts here.
        self.paths: dict[tuple[int, str, bool], int] = {}
        # Of elements: parent, tag, innermost such box. Element 0 is the root.
        self.parent = [0]
        self.box = [0]
        self.tag = [""]
        # Of elements: the innermost block, and whether they lie in a tag that names an article.
        self.within = [0]
        self.named = [False]
        # Open elements: tag, element, path, skipped.
        self.open: list[tuple[str, int, int, bool]] = [("", 0, 0, False)]
        self.count: dict[str, int] = defaultdict(int)
        # Where the open elements of each tag are, those that are blocks, and those that end no other.
        self.at: dict[str, list[int]] = defaultdict(lambda: [0])
        self.blocks_at = [0]
        self.keeps_at = [0]
        self.block = 0
        # Of texts: path, element, block, text, in a link.
        self.texts: list[tuple[int, int, int, str, bool]] = []

    def read(self, page: str) -> None:
        """Go through the markup once. A tag or comment that never ends runs to the end."""
        at, size = 0, len(page)
        while at < size:
            left = page.find("<", at)
            if left < 0:
                self.add_text(page[at:])
                return
            if left > at:
                self.add_text(page[at:left])
            mark = page[left + 1 : left + 2]
            if mark.isascii() and mark.isalpha():
                found = _OPEN_TAG.match(page, left)
                if not found:
                    return
                tag, at = found[1].lower(), found.end()
                self.start(tag, found[2])
                if tag in _RAW:
                    ended = _RAW[tag].search(page, at)
                    if not ended:
                        return
                    at = ended.start()
            elif mark == "/" and page[left + 2 : left + 3].isalpha():
                found = _END_TAG.match(page, left)
                if not found:
                    return
                self.end(found[1].lower())
                at = found.end()
            elif mark and mark in "!?/":
                comment = page.startswith("<!--", left)
                right = page.find("-->", left + 2) if comment else page.find(">", left)
                if right < 0:
                    return
                at = right + (3 if comment else 1)
            else:
                self.add_text("<")
                at = left + 1

    def start(self, tag: str, attrs: str) -> None:
        if tag in _BLOCK:
            self.block += 1
            self._end_open("p")
        if tag in _ENDS:
            for other in _ENDS[tag]:
                self._end_open(other)
        if tag in _VOID:
            if tag == "br":
                self.add_text(" ")
            return
        _, above, path, skipped = self.open[-1]
        box = False
        if not skipped:
            in_article = self.count["article"] > 0 or self.count["main"] > 0
            if tag == "form" or (attrs.strip(" /") and tag not in ("html", "body")):
                box = _is_noise(tag, attrs, in_article)
                skipped = tag != "main" and _is_hidden(attrs)
            if tag in _NEVER:
                skipped = True
            elif skipped:
                pass
            elif tag == "header":
                skipped = not in_article
            elif self.count["header"] and tag not in _HEADING and tag not in ("div", "hgroup"):
                # Of the header of an article only headings belong to its text.
                skipped = tag in _BLOCK or tag in ("span", "time")
        path = self.paths.setdefault((path, tag, box), len(self.paths) + 1)
        self.parent.append(above)
        self.box.append(len(self.tag) if box else self.box[above])
        self.tag.append(tag)
        self.within.append(len(self.tag) - 1 if tag in _BLOCK else self.within[above])
        self.named.append(self.named[above] or tag in _CONTAINER)
        for places in self._places(tag):
            places.append(len(self.open))
        self.open.append((tag, len(self.tag) - 1, path, skipped))
        self.count[tag] += 1

    def _places(self, tag: str) -> list[list[int]]:
        found = [self.at[tag]]
        if tag in _BLOCK:
            found.append(self.blocks_at)
        if tag in _KEEPS_OPEN:
            found.append(self.keeps_at)
        return found

    def end(self, tag: str) -> None:
        if tag in _BLOCK:
            self.block += 1
        if not self.count[tag]:
            return
        if tag not in _BLOCK and self.at[tag][-1] < self.blocks_at[-1]:
            return  # a stray end of an inline element ends no block
        while self.open[-1][0] != tag:
            self._pop()
        self._pop()

    def add_text(self, text: str) -> None:
        _, element, path, skipped = self.open[-1]
        if not skipped:
            if "&" in text:
                text = unescape(text)
            self.texts.append((path, element, self.block, text, self.count["a"] > 0))

    def _pop(self) -> None:
        tag = self.open.pop()[0]
        self.count[tag] -= 1
        for places in self._places(tag):
            places.pop()

    def _end_open(self, tag: str) -> None:
        if not self.count[tag] or self.at[tag][-1] < self.keeps_at[-1]:
            return
        while self.open[-1][0] != tag:
            self._pop()
        self._pop()


def path_scores(texts: list[tuple[int, int, int, str, bool]]) -> dict[int, float]:
    """The fused ratio of every path that has text: text and punctuation outside links for each
    of its nodes, smoothed over the order in which paths appear."""
    sums: dict[int, list[int]] = {}
    for path, _, _, text, linked in texts:
        size = len(text.strip())
        own = sums.setdefault(path, [0, 0, 0])
        if size:
            own[0] += 1
            if not linked:
                own[1] += size
                own[2] += len(_PUNCTUATION.findall(text))
    order = list(sums)
    nodes, length, marks = np.array(list(sums.values()), float).T
    nodes = np.maximum(nodes, 1)
    smooth = [
        np.convolve(np.pad(x, 2, mode="edge"), _KERNEL, mode="valid")
        for x in (length / nodes, (marks + 1) / nodes)
    ]
    own = (length / nodes) * ((marks + 1) / nodes)
    return dict(zip(order, np.sqrt(own * smooth[0] * smooth[1]).tolist(), strict=True))


def _answered(reader: PageReader, texts: list[tuple[int, int, int, str, bool]]) -> list[bool]:
    """Of every element whether it lies in a reader's comment: an item or box with a link to answer
    it. Of comments that stand beside each other, the children of what holds them all are dropped;
    one comment goes with the box right around its link. Empty without comments."""
    plain: dict[int, int] = defaultdict(int)
    for _, _, block, text, linked in texts:
        plain[block] += 0 if linked else len(text.strip())
    links = [
        e
        for _, e, block, text, linked in texts
        if linked and plain[block] <= _BESIDE_ANSWER and text.strip(" .:()[]").lower() in _ANSWER
    ]
    if not links:
        return []
    parent, tag = reader.parent, reader.tag
    held = [0] * len(parent)
    for e in links:
        held[e] += 1
    for e in range(len(parent) - 1, 0, -1):  # children have larger numbers
        held[parent[e]] += held[e]
    around = [False] * len(parent)
    if len(links) > 1:
        for e in range(1, len(parent)):
            above = parent[e]
            around[e] = around[above] or (0 < held[e] < len(links) and held[above] == len(links))
    else:
        box = parent[links[0]]
        while box and tag[box] not in ("li", "div", "dd"):
            box = parent[box]
        for e in range(1, len(parent)) if box else ():
            around[e] = around[parent[e]] or e == box
        inside = sum(len(text.strip()) for _, e, _, text, _ in texts if around[e])
        if 2 * inside > sum(len(text.strip()) for *_, text, _ in texts):
            return []
    return around


def content_texts(reader: PageReader) -> list[tuple[int, int, int, str, bool]]:
    """The texts of the blocks that make up the article."""
    texts = reader.texts
    if not any(text.strip() for *_, text, _ in texts):
        return []
    scores = path_scores(texts)
    # A box that is named as no article is one all the same if it holds more text than what is in
    # no box, on a path that scores as high; not so outside a tag that names an article.
    if any(reader.box):
        best: dict[int, float] = defaultdict(float)
        weights: dict[int, int] = defaultdict(int)
        tagged = False
        for path, element, _, text, linked in texts:
            if not linked:
                box = reader.box[element]
                best[box] = max(best[box], scores[path])
                weights[box] += len(text.strip())
                tagged = tagged or (not box and bool(text.strip()) and reader.named[element])
        out: set[int] = set()
        for box in sorted(set(reader.box) - {0}):
            # A box in a box that stays is held against that one.
            above = reader.box[reader.parent[box]]
            above = 0 if above in out else above
            lower = best[box] < best[above] or weights[box] <= weights[above]
            if lower or (tagged and not reader.named[box]):
                out.add(box)
        texts = [t for t in texts if reader.box[t[1]] not in out]
    answered = _answered(reader, texts)
    if answered:
        texts = [t for t in texts if not answered[t[1]]]
    if not any(text.strip() for *_, text, _ in texts):
        return []
    if len(texts) < len(reader.texts):
        scores = path_scores(texts)
    values = np.array(list(scores.values()))
    least = min(values.max(), THRESHOLD * values.std())
    parent, tag = reader.parent, reader.tag
    children = [0] * len(parent)
    for above in parent[1:]:
        children[above] += 1

    # Of every element, whose children have larger numbers: the last one inside it, and the section
    # its blocks stand in.
    named, within = reader.named, reader.within
    last_in = list(range(len(parent)))
    for e in range(len(parent) - 1, 0, -1):
        last_in[parent[e]] = max(last_in[parent[e]], last_in[e])
    section = [0] * len(parent)
    listed = [0] * len(parent)
    for e in range(1, len(parent)):
        above = parent[e]
        if tag[e] in _SECTION:
            section[e] = e
        else:
            section[e], listed[e] = section[above], listed[above]
            if tag[e] in _WRAPPED:
                while tag[section[e]] in ("div", "section") and children[section[e]] == 1:
                    section[e] = section[parent[section[e]]]
            if tag[e] in _LIST and not listed[e]:
                listed[e] = e

    # Of blocks: element, length, length in links, best score outside links.
    blocks: dict[int, list] = {}
    linked_in: dict[int, list[int]] = defaultdict(lambda: [0, 0])
    for path, element, block, text, linked in texts:
        size = len(text.strip())
        if not size:
            continue
        own = within[element]
        found = blocks.setdefault(block, [own, 0, 0, -1.0, ""])
        found[1] += size
        found[4] += text
        if linked:
            found[2] += size
        else:
            found[3] = max(found[3], scores[path])
        if listed[own]:
            linked_in[listed[own]][0] += size
            linked_in[listed[own]][1] += size * linked

    def is_high(found: list, bar: float) -> bool:
        return found[3] >= bar and tag[found[0]] not in _HEADING

    highest = max((f[3] for f in blocks.values() if tag[f[0]] not in _HEADING), default=-1.0)
    weight = [0, 0]
    for found in blocks.values():
        if is_high(found, least):
            weight[named[found[0]]] += found[1] - found[2]
    hinted = weight[1] >= weight[0] and weight[1] > 0
    outside = max(least, OUTSIDE * highest) if hinted else least
    high = {b for b, f in blocks.items() if is_high(f, least if named[f[0]] else outside)}
    if not high:
        return texts
    hosts = {section[blocks[b][0]] for b in high}
    # Sections right around these, where a title and a lead stand before the body.
    around = {section[parent[h]] for h in hosts}
    last = max(high)

    kept = set(high)
    for block, (element, size, linked, _, text) in blocks.items():
        if block in high or tag[element] in _HEADING or (hinted and not named[element]):
            continue
        if listed[element]:
            size, linked = linked_in[listed[element]]
        links = 2 * linked > size and (listed[element] or tag[element] != "p")
        before = section[element] in around and block < last
        sentence = (hinted or before) and _SENTENCE.search(text)
        if not links and (section[element] in hosts or sentence):
            kept.add(block)

    # A heading stands over the blocks that follow up to the next one of its rank, as far as the
    # element reaches that holds it with more than headings.
    over: dict[str, int] = {}
    holders: dict[int, int] = {}
    for block in sorted(blocks):
        element = blocks[block][0]
        if tag[element] in _HEADING:
            for rank in [r for r in over if r >= tag[element]]:
                del over[rank]
            over[tag[element]] = block
        elif block in kept:
            for head in over.values():
                own = holders.get(head)
                if own is None:
                    own = parent[blocks[head][0]]
                    while own and tag[own] in ("div", "header", "hgroup") and own not in hosts:
                        own = parent[own]
                    holders[head] = own
                if own <= element <= last_in[own] and (named[blocks[head][0]] or not hinted):
                    kept.add(head)
    return [t for t in texts if t[2] in kept]


def main_text(html: str | None) -> str:
    """The article of a page: its blocks in page order, one to a line."""
    if not html:
        return ""
    reader = PageReader()
    reader.read(html)
    blocks: dict[int, list[str]] = {}
    for _, _, block, text, _ in content_texts(reader):
        blocks.setdefault(block, []).append(text)
    lines = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n".join(line for line in lines if line)


def extract_pages(df: DataFrame, html: str = "html", *keep: str) -> DataFrame:
    """``keep``, then ``text`` and ``n_chars``, for every row. One pass without a shuffle."""
    kept = [f for f in df.schema.fields if f.name in keep]
    columns = [F.col(f"`{f.name}`").alias(f"k{i}") for i, f in enumerate(kept)]
    fields = [f"k{i} {f.dataType.simpleString()}" for i, f in enumerate(kept)]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [main_text(page) for page in texts_of(batch.column(0))]
        return pa.RecordBatch.from_arrays(
            [*batch.columns[1:], pa.array(found), pa.array(map(len, found), pa.int64())],
            [*batch.schema.names[1:], "text", "n_chars"],
        )

    schema = ", ".join([*fields, "text string", "n_chars bigint"])
    result = map_batches(df.select(F.col(f"`{html}`").alias("html"), *columns), work, schema)
    return result.toDF(*[f.name for f in kept], "text", "n_chars")
