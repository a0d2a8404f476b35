"""Main text of web pages: a minimum cut over text blocks separates content from boilerplate."""

from __future__ import annotations

import html as entities
import re
from collections import Counter, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: A tag ends at the first >; nothing in it is matched in two ways, and a text without > is not searched.
TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)>|<!--|<[!?/][^>]*+>""")
CUT_OFF = re.compile(r"<(?=[a-zA-Z/!?])")
ATTRIBUTE = re.compile(r"""([^\s"'=<>/]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
NAME = re.compile(r"[a-z]+")

#: Elements whose content is no text of the page.
RAW = frozenset("script style title noscript template textarea iframe svg math object canvas audio video select datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
BOILER_TAGS = frozenset("nav footer aside form menu dialog button fieldset".split())
CONTENT_TAGS = {"article": 4.0, "main": 3.0}
UNHINTED = frozenset("html body article main h1 h2 h3 h4 h5 h6".split())
BOILER_NAMES = frozenset(
    """ad ads adv advert adverts advertisement advertising adsbygoogle banner bottom breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie
    cookies copyright disclaimer disqus dropdown footer form header legal login masthead menu modal nav navbar navigation newsletter notice notification
    overlay pager pagination popup promo promotion reactions recommended related replies reply search share sharing sidebar signup social sponsor
    sponsored subscribe tags toolbar topbar widget widgets""".split())
CONTENT_NAMES = frozenset("article content main post entry story text body".split())
#: Elements that an opening of the same kind closes.
SELF_CLOSING = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Words before a name that say that a page has or lacks such a part, not that this is it.
ABOUT = frozenset("has have with without no not hide show".split())
BOILER = -6.0
SHORT = 1.0
CLOSERS = {tag: re.compile(f"</{tag}[^>]*+>", re.I) for tag in RAW}


def _named(value: str) -> tuple[bool, bool]:
    """Whether class or id names speak for content, and whether for boilerplate."""
    content = boiler = False
    for name in value.lower().split():
        words = NAME.findall(name)
        content |= len(words) == 1 and words[0] in CONTENT_NAMES
        boiler |= not (words and words[0] in ABOUT) and not BOILER_NAMES.isdisjoint(words)
    return content, boiler


def _bias(parent: float, tag: str, attributes: str) -> float:
    """How much an element speaks for content (positive) or boilerplate, given where it stands.

    Names of boilerplate count where the element has none of content; a main element inside an element that only its
    name marks as boilerplate starts anew, what is inside other boilerplate stays that.
    """
    if tag == "main" and parent == BOILER:
        parent = 0.0
    if parent <= BOILER or tag in BOILER_TAGS or tag == "header" and parent < 2:
        return 2 * BOILER if tag in BOILER_TAGS else min(parent, BOILER)
    own = CONTENT_TAGS.get(tag, 0.0)
    if attributes and "=" in attributes or "hidden" in attributes:
        content = boiler = False
        for m in ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and UNSEEN.search(value):
                return 2 * BOILER
            if name in ("class", "id", "role") and tag not in UNHINTED:
                says = _named(value)
                content, boiler = content or says[0], boiler or says[1]
        if boiler and not content:
            return BOILER
        if content:
            own = max(own, 1.5)
    return parent + own


def blocks(page: str) -> list[tuple[str, float, int, int]]:
    """(text, classifier logit, number of the enclosing element, its depth) of every text block in page order."""
    out: list[tuple[str, float, int, int]] = []
    stack: list[tuple[str, float, int]] = [("", 0.0, 0)]
    text: list[str] = []
    linked = number = at = links = 0
    end = len(page)
    opened: Counter[str] = Counter()

    def flush() -> None:
        nonlocal linked
        if not text:
            return
        whole = "".join(text)
        if "&" in whole:
            whole = entities.unescape(whole)
        words = whole.split()
        if words:
            bias, size = stack[-1][1], len(words)
            joined = " ".join(words)
            logit = bias
            if bias > BOILER:
                logit += min(size, 40) / 20 - 0.8 - 5 * min(1.0, linked / max(1, len(joined)))
                logit += 0.5 if joined[-1] in ".!?…\"”" else 0.0
                logit -= 3.0 if joined.startswith("©") else 0.0
            out.append((joined, logit, stack[-1][2], len(stack)))
        text.clear()
        linked = 0

    while at < end:
        whole_tags = page.find(">", at) >= 0
        m = TAG.search(page, at) if whole_tags else None
        # a page may end inside a tag, which is dropped
        cut_off = None if whole_tags else CUT_OFF.search(page, at)
        stop = m.start() if m else cut_off.start() if cut_off else end
        if stop > at:
            piece = page[at:stop]
            text.append(piece)
            if links:
                linked += len(piece)
        if not m:
            break
        at = m.end()
        name = m[2]
        if name is None:
            if m.group() == "<!--":
                close = page.find("-->", at)
                at = end if close < 0 else close + 3
            continue
        tag = name.lower()
        if tag in INLINE:
            if tag == "a":
                links = 0 if m[1] else 1
            elif tag == "br":
                text.append(" ")
            continue
        flush()
        if tag in VOID:
            continue
        if m[1]:
            while opened[tag]:  # what stands above its opening is closed, too
                top = stack.pop()[0]
                opened[top] -= 1
                if top == tag:
                    break
            links = 0
            continue
        if tag in RAW:
            close = CLOSERS[tag].search(page, at)
            at = close.end() if close else end
            continue
        closes = SELF_CLOSING.get(tag)
        while closes and stack[-1][0] in closes:
            opened[stack.pop()[0]] -= 1
        number += 1
        opened[tag] += 1
        stack.append((tag, _bias(stack[-1][1], tag, m[3]), number if tag not in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li") else stack[-1][2]))
    flush()
    return out


def cut(gain: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes a minimum cut leaves with the source.

    A node with positive gain hangs on the source with that capacity, one with negative gain on the sink. Flow is
    augmented along shortest residual paths; nodes from which no sink can be reached any more stay closed.
    """
    n = len(gain)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        near[a][b] = near[a].get(b, 0.0) + w
        near[b][a] = near[b].get(a, 0.0) + w
    excess, room = [max(0.0, g) for g in gain], [max(0.0, -g) for g in gain]
    kept = [False] * n
    for start in range(n):
        while excess[start] > 1e-9 and not kept[start]:
            before, queue, goal = {start: -1}, deque([start]), -1
            while queue:
                a = queue.popleft()
                if room[a] > 1e-9:
                    goal = a
                    break
                for b, w in near[a].items():
                    if w > 1e-9 and b not in before and not kept[b]:
                        before[b] = a
                        queue.append(b)
            if goal < 0:
                for a in before:
                    kept[a] = True
                break
            flow, a = min(excess[start], room[goal]), goal
            while before[a] >= 0:
                flow = min(flow, near[before[a]][a])
                a = before[a]
            a = goal
            while before[a] >= 0:
                near[before[a]][a] -= flow
                near[a][before[a]] += flow
                a = before[a]
            excess[start] -= flow
            room[goal] -= flow
    return kept


def main_text(page: str, smooth: float = 0.8) -> str:
    """Blocks labelled content, in page order, joined by line feeds.

    Neighbours in page order are tied, the closer in the element tree the more; so are consecutive blocks of one
    element that others stand between.
    """
    found = blocks(page)
    edges, last = [], {}
    for k, (_, _, parent, depth) in enumerate(found):
        if k:
            apart = 0 if parent == found[k - 1][2] else 1 + abs(depth - found[k - 1][3])
            edges.append((k - 1, k, smooth / (1 + 2 * apart)))
        if parent in last and last[parent] < k - 1:
            edges.append((last[parent], k, smooth / 2))
        last[parent] = k
    gain = [b[1] for b in found]
    if max(gain, default=0.0) <= 0:  # a page of short blocks only: length says nothing there
        gain = [g + SHORT if g > -1 else g for g in gain]
    keep = cut(gain, edges)
    return "\n".join(b[0] for b, good in zip(found, keep) if good)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page: its main text, empty if it has none or html is null.

    Pages of any length are read whole, in time linear in their tags; a page that ends inside a tag, a comment or a script
    loses that. Repeated rows give equal results; other columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                texts = [main_text(h or "") for h in batch.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                    ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
