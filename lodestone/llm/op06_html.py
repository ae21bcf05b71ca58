"""HTML extraction by minimum-cut labelling.

A page becomes text blocks with the path of elements above them. A classifier turns tags, class
names, link density, length and punctuation into the probability that a block is content; the
costs of either label are the capacities of its edges to the two terminals. Blocks next to each
other, and blocks under one parent, are tied by smoothness edges. The minimum cut between the
terminals gives the labelling of least total cost; content blocks, in page order, are the text.

A block whose terminals outweigh all its ties takes its cheaper label in every minimum cut; such
blocks are fixed first, again and again, and the maximum flow runs on what is left.

Defined results: null html, or a page without content, has an empty text; markup that is cut off
or not closed ends with the page (an unclosed button, select or svg with the block it stands in); repeated rows are extracted each; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from lodestone.ship import ship

# Fixed lists of element names and of words in class names, ids and roles.
RAW = ("script", "style", "template", "title", "textarea", "iframe")
#: Without text of the article, up to their end tag or the next tag of a block; svg may also close itself.
SILENT = frozenset("svg select button".split())
BLOCKS = frozenset("noscript address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that end when one of the second set begins inside their parent.
ENDS = {"p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr", "tbody"}, "th": {"td", "th", "tr", "tbody"}, "tr": {"tr", "tbody", "tfoot"}, "option": {"option", "optgroup"}, "head": {"body"}}
TAG_COST = {"nav": -7.0, "footer": -7.0, "aside": -7.0, "form": -7.0, "menu": -7.0, "dialog": -7.0, "fieldset": -4.0, "search": -7.0, "head": -9.0, "header": -5.0, "article": 4.0, "main": 3.0, "blockquote": 0.5, "pre": 0.5, "p": 1.0, "li": -0.5, "td": -0.3, "address": -2.0, "noscript": -3.0}
NOT_CONTENT = re.compile(r"(?:^|[\s_-])(?:ads?|adverts?|advertise\w*|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|alert|side-?bar|side|menu|nav\w*|breadcrumbs?|foot\w*|header|masthead|comments?|respond|disqus|replies|share|sharing|social|related|recommend\w*|newsletter|subscribe|subscription|popup|modal|overlay|widget|pagination|pager|login|signup|search|toolbar|tags|copyright|legal|skip|hidden|contentinfo|complementary|navigation)(?:$|[\s_-])", re.I)
CONTENT = re.compile(r"(?:^|[\s_-])(?:article\w*|content|post|entry|story|main|body|text|prose)(?:$|[\s_-])", re.I)
ADJACENT, SIBLING, SCALE = 0.5, 1.0, 1000

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(" + "|".join(RAW) + r")(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:$|[\s=/])|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)


class Block:
    __slots__ = ("linked", "parent", "path", "size", "tag", "text")

    def __init__(self, text: str, linked: int, path: float, parent: int, tag: str):
        self.text, self.linked, self.path, self.parent, self.tag = text, linked, path, parent, tag
        self.size = len(text)


def blocks(page: str) -> list[Block]:
    """Text blocks in page order. path: the sum of costs of the elements above; parent: the number of the nearest container."""
    out: list[Block] = []
    stack: list[tuple[str, float, int, bool]] = [("", 0.0, 0, False)]
    opened: Counter[str] = Counter()
    parts: list[str] = []
    linked = 0
    in_link = False
    silent = ""
    number = 0
    at = 0

    def close() -> None:
        nonlocal linked, in_link
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                tag, cost, own, _ = stack[-1]
                holder = stack[-2][2] if len(stack) > 1 and (tag in ENDS or tag in HEADINGS) else own
                out.append(Block(text, linked, cost, holder, tag))
            parts.clear()
        linked, in_link = 0, False

    def say(raw: str) -> None:
        nonlocal linked
        if raw and not silent:
            text = entities.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if in_link:
                linked += len(text.strip())

    for m in _TOKEN.finditer(page):
        say(page[at : m.start()])
        at = m.end()
        name = m[3]
        if not name:
            if m[1]:
                parts.append(" ")
            continue
        name = name.lower()
        if name not in BLOCKS:
            if name in SILENT:
                if m[2]:
                    silent = "" if silent == name else silent
                elif not silent and not m[4].endswith("/"):
                    silent = name
                parts.append(" ")
            elif name == "a":
                in_link = not m[2]
            elif name == "br" or name == "img":
                parts.append(" ")
            continue
        silent = ""
        close()
        if m[2]:
            while opened[name]:  # end tags without a start say nothing
                last = stack.pop()[0]
                opened[last] -= 1
                if last == name:
                    break
            continue
        while len(stack) > 1 and name in ENDS.get(stack[-1][0], ()):
            opened[stack.pop()[0]] -= 1
        if name in VOID:
            continue
        _, cost, _, inside = stack[-1]
        if not (name == "header" and inside):
            cost += TAG_COST.get(name, 0.0)
        if m[4]:
            names = " ".join(x or y or z for x, y, z in _NAMES.findall(m[4]))
            if names:
                if name not in ("body", "html", "article", "main") and NOT_CONTENT.search(names):
                    # a word for content beside it, or a paragraph or heading of its own, is a weaker sign than a container
                    cost -= 3.0 if CONTENT.search(names) or name == "p" or name in HEADINGS else 9.0
                elif CONTENT.search(names):
                    cost += 1.5
            if _HIDDEN.search(m[4]):
                cost -= 9.0
        number += 1
        opened[name] += 1
        stack.append((name, cost, number, inside or name == "article"))
    say(page[at:])
    close()
    return out


def logit(block: Block) -> float:
    """Log-odds of being content."""
    links = block.linked / max(1, block.size)
    ends = block.text[-1] in ".!?…\"'”»:;,"
    z = -0.5 + min(2.0, math.log1p(block.size) / 2.5) - 4.0 * links + (0.5 if ends else 0.0)
    if block.tag in HEADINGS:
        z += 0.7
    return max(-12.0, min(12.0, z + block.path))


def ties(found: list[Block]) -> dict[tuple[int, int], int]:
    """Smoothness edges: neighbours on the page, and each block with the one before it under the same parent."""
    edges: dict[tuple[int, int], int] = {}
    last: dict[int, int] = {}
    for i, block in enumerate(found):
        if i:
            edges[i - 1, i] = int(ADJACENT * SCALE)
        if block.parent in last:
            k = (last[block.parent], i)
            edges[k] = edges.get(k, 0) + int(SIBLING * SCALE)
        last[block.parent] = i
    return edges


def _saturate(room: dict[int, dict[int, int]], source: int, sink: int) -> None:
    """Sends the maximum flow, shortest paths first: all of one length in one sweep. room: what each edge still takes."""
    while True:
        level, queue = {source: 0}, deque([source])
        while queue:
            u = queue.popleft()
            for v, c in room[u].items():
                if c > 0 and v not in level:
                    level[v] = level[u] + 1
                    queue.append(v)
        if sink not in level:
            return
        untried = {u: list(room[u]) for u in level}
        path = [source]
        while path:
            u = path[-1]
            if u == sink:
                flow = min(room[a][b] for a, b in zip(path, path[1:]))
                for k in range(len(path) - 1, 0, -1):
                    a, b = path[k - 1], path[k]
                    room[a][b] -= flow
                    room[b][a] = room[b].get(a, 0) + flow
                    if not room[a][b]:
                        full = k
                del path[full:]
                continue
            while untried[u] and not (room[u][untried[u][-1]] > 0 and level.get(untried[u][-1]) == level[u] + 1):
                untried[u].pop()
            if untried[u]:
                path.append(untried[u][-1])
            else:
                path.pop()
                if path:
                    untried[path[-1]].pop()


def min_cut(keep: list[int], drop: list[int], edges: dict[tuple[int, int], int]) -> list[bool]:
    """Labels of least cost: keep[i] or drop[i] for block i's label, and the weight of each edge whose ends differ.

    True: content. Of several minimum cuts the one with the most content.
    """
    n = len(keep)
    label: list[bool | None] = [None] * n
    near: list[dict[int, int]] = [{} for _ in range(n)]
    for (a, b), w in edges.items():
        near[a][b] = near[a].get(b, 0) + w
        near[b][a] = near[b].get(a, 0) + w
    keep, drop = list(keep), list(drop)
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if label[i] is None and abs(keep[i] - drop[i]) > sum(near[i].values()):
            label[i] = keep[i] < drop[i]
            for j, w in near[i].items():
                if label[i]:
                    drop[j] += w
                else:
                    keep[j] += w
                del near[j][i]
                queue.append(j)
            near[i] = {}
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        # source side: content; the source's edge to a block costs its drop, the edge to the sink its keep
        source, sink = n, n + 1
        room: dict[int, dict[int, int]] = {i: dict(near[i]) for i in rest}
        room[source], room[sink] = {}, {}
        for i in rest:
            both = min(keep[i], drop[i])
            room[source][i], room[i][sink] = drop[i] - both, keep[i] - both
            room[i][source] = room[sink][i] = 0
        _saturate(room, source, sink)
        # blocks that can't reach the sink are content
        back = {sink}
        queue = deque([sink])
        while queue:
            v = queue.popleft()
            for u in room[v]:
                if u not in back and room[u].get(v, 0) > 0:
                    back.add(u)
                    queue.append(u)
        for i in rest:
            label[i] = i not in back
    return [bool(x) for x in label]


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    if not found:
        return ""
    keep, drop = [], []
    for block in found:
        z = logit(block)
        keep.append(int(SCALE * math.log1p(math.exp(-z))))
        drop.append(int(SCALE * math.log1p(math.exp(z))))
    return "\n".join(b.text for b, yes in zip(found, min_cut(keep, drop, ties(found))) if yes)


def extract(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of each row."""
    ship(pages.sparkSession)
    named = pages.select(pages[id_column].alias("page_id"), pages[url_column].alias("url"), pages[html_column].cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(x) for x in part["html"].to_pylist()]
                yield pa.RecordBatch.from_arrays([part["page_id"], part["url"], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return named.mapInArrow(run, f"page_id {named.schema['page_id'].dataType.simpleString()}, url {named.schema['url'].dataType.simpleString()}, text string, n_chars long")
