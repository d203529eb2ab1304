"""Main text of web pages by a tree-structured graphical model.

Every element of a page is content or not. An element's tag, names, text length and share of link text depend on its state, and its
state on that of its parent and on its tag: these potentials are counted on labelled pages. Messages are passed from the
leaves to the root and back (sum-product), which gives each element's exact probability of being content. The text of elements that
are more likely content than not is the main text.

Text in head, script, style and the like is never content. Character references are decoded; a block is the text between two
block-level tags, with white space turned into one space; blocks are joined by an empty line.

Defined cases: a null or empty html has the empty text, as has a page without content. Broken markup is closed as browsers do: an open
paragraph or list item ends where the next begins, and what is open at the end of the page ends there. Ids and urls may repeat or be null.
Other columns pass through; those named as a result are replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tallyhouse.llm import html_labels

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head script style title template noscript svg math iframe object canvas audio video datalist".split())
FOREIGN = frozenset(("svg", "math"))
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Tags that an opening tag ends, and tags beyond which it ends nothing.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",)), "body": (("head",), ()),
}
SPACE = re.compile(r"\s+")
NAMES = re.compile(r"[a-z]+")
COMMENT_END, COMMENT_EMPTY = re.compile(r"--!?>"), re.compile(r"-?>")
SMOOTH = 0.5
#: Weight of what is seen of the text: parents show the same text again.
SEEN_AGAIN = 0.3


class Page(HTMLParser):
    """Elements (tag, names, parent, lengths, label) and blocks (pairs of element and text) of a page."""

    def __init__(self, html: str, marked: bool = False):
        """marked: data-label is a training mark; on other pages it is an attribute like any other."""
        super().__init__(convert_charrefs=True)
        self.marked, self.depths = marked, {}  # of each tag, where its open elements stand in `open`
        self.tags, self.names, self.parents, self.labels = ["#"], [()], [-1], [None]
        self.chars, self.linked = [0], [0]
        self.open, self.hidden, self.links = [0], 0, 0
        self.blocks: list[list[tuple[int, str]]] = [[]]
        self.feed(html)
        self.close()
        for k in range(len(self.tags) - 1, 0, -1):
            self.chars[self.parents[k]] += self.chars[k]
            self.linked[self.parents[k]] += self.linked[k]

    def parse_comment(self, i, report=1):  # ends with --> or --!>, or at once
        found = COMMENT_END.search(self.rawdata, i + 4)
        if (short := COMMENT_EMPTY.match(self.rawdata, i + 4)) is not None:
            found = short
        return found.end() if found else -1

    def parse_marked_section(self, i, report=1):  # <![...]> is a comment
        at = self.rawdata.find(">", i)
        return at + 1 if at >= 0 else -1

    def handle_starttag(self, tag, attrs):
        if tag not in INLINE and tag not in HIDDEN:
            self.blocks.append([])
            self._end(("p",), ("button", "table", "td", "th", "caption"))
        if tag in ENDS:
            self._end(*ENDS[tag])
        if tag == "br":
            self.handle_data(" ")
        found, label = [], None
        for name, value in attrs:
            if name in ("class", "id", "role", "aria-label"):
                found += NAMES.findall((value or "").lower())
            elif name == "hidden" or (name == "style" and "display:none" in (value or "").replace(" ", "").lower()):
                found.append("#hidden")
            elif name == "data-label" and self.marked:
                label = int(value)
        self.tags.append(tag)
        self.names.append(tuple(found))
        self.parents.append(self.open[-1])
        self.labels.append(label)
        self.chars.append(0)
        self.linked.append(0)
        if tag not in VOID:
            self.depths.setdefault(tag, []).append(len(self.open))
            self.open.append(len(self.tags) - 1)
            self.hidden += tag in HIDDEN
            self.links += tag == "a"

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if any(self.depths.get(t) for t in FOREIGN) and tag not in VOID:  # only svg, math and what is in them close themselves
            self._end((tag,), ())

    def handle_endtag(self, tag):
        if tag not in INLINE and tag not in HIDDEN:
            self.blocks.append([])
        self._end((tag,), ())

    def _end(self, tags, walls):
        """Close the innermost open element of these tags, and all in it, unless a wall stands before it."""
        at, wall = (max((self.depths[t][-1] for t in some if self.depths.get(t)), default=0) for some in (tags, walls))
        if not at or at < wall:
            return
        for gone in self.open[at:]:
            tag = self.tags[gone]
            self.depths[tag].pop()
            self.hidden -= tag in HIDDEN
            self.links -= tag == "a"
        del self.open[at:]

    def handle_data(self, data):
        if self.hidden:
            return
        at = self.open[-1]
        self.blocks[-1].append((at, data))
        size = len(data) - data.count(" ")
        self.chars[at] += size
        self.linked[at] += size if self.links else 0

    def features(self, k: int) -> list[str]:
        """What is seen of an element; a nameless one within a line of text shows nothing and follows its parent."""
        if self.tags[k] in INLINE and not self.names[k]:
            return []
        n = self.chars[k]
        size = "0" if n == 0 else str(min(6, int(math.log2(n)) // 2))
        share = "" if n == 0 else str(min(3, int(4 * self.linked[k] / n)))
        return [f"size {size}", f"links {share}", *(f"name {x}" for x in set(self.names[k]))]


class Model:
    """Counts on labelled pages, as logarithms of potentials."""

    def __init__(self, pages: list[str]):
        move, seen, total = Counter(), Counter(), Counter()
        features: set[str] = set()
        for html in pages:
            page = Page(html, marked=True)
            state = [1]
            for k in range(1, len(page.tags)):
                state.append(state[page.parents[k]] if page.labels[k] is None else page.labels[k])
                move[state[page.parents[k]], page.tags[k], state[k]] += 1
                move[state[page.parents[k]], "", state[k]] += 1
                total[state[k]] += 1
                for f in page.features(k):
                    seen[state[k], f] += 1
                    features.add(f)
        part = {f: 1.0 if f.startswith("name") else SEEN_AGAIN for f in features}
        self.emit = {f: tuple(part[f] * math.log((seen[s, f] + SMOOTH) / (total[s] + 2 * SMOOTH)) for s in (0, 1)) for f in features}
        tags = {t for _, t, _ in move}
        self.move = {t: tuple(self._move(move, t, p) for p in (0, 1)) for t in tags}

    def _move(self, move: Counter, tag: str, parent: int) -> tuple[float, float]:
        """Probabilities of both states of a child with this tag; a tag seldom seen follows what all tags do."""
        both = [move[parent, "", s] for s in (0, 1)]
        whole = sum(both)
        counts = [move[parent, tag, s] + both[s] / max(1, whole) * 0.5 + SMOOTH / 3 for s in (0, 1)] if tag else [b + SMOOTH for b in both]
        return counts[0] / sum(counts), counts[1] / sum(counts)

    def marginals(self, page: Page) -> list[float]:
        """Probability of each element being content."""
        n = len(page.tags)
        other = self.move[""]
        moves = [self.move.get(t, other) for t in page.tags]
        own: list[tuple[float, float]] = []
        for k in range(n):
            a = b = 0.0
            for f in page.features(k):
                if (e := self.emit.get(f)) is not None:
                    a, b = a + e[0], b + e[1]
            top = max(a, b)
            own.append((math.exp(max(a - top, -300)), math.exp(max(b - top, -300))))
        inside, up = [list(x) for x in own], [(1.0, 1.0)] * n
        for k in range(n - 1, 0, -1):  # children come behind their parents
            (m00, m01), (m10, m11) = moves[k]
            a, b = inside[k]
            u0, u1 = m00 * a + m01 * b, m10 * a + m11 * b
            scale = u0 + u1
            up[k] = (u0 / scale, u1 / scale)
            p = inside[page.parents[k]]
            p[0] *= up[k][0]
            p[1] *= up[k][1]
            if (s := p[0] + p[1]) < 1e-100:
                p[0], p[1] = max(p[0] / s, 1e-200), max(p[1] / s, 1e-200)
        out = [1.0] * n
        belief = [(0.0, 1.0)] * n  # the page itself is content
        for k in range(1, n):
            b0, b1 = belief[page.parents[k]]
            c0, c1 = b0 / up[k][0], b1 / up[k][1]
            (m00, m01), (m10, m11) = moves[k]
            d0, d1 = c0 * m00 + c1 * m10, c0 * m01 + c1 * m11
            a, b = d0 * inside[k][0], d1 * inside[k][1]
            s = a + b
            belief[k] = (a / s, b / s)
            out[k] = b / s
        return out


def main_text(html: str | None, model: Model) -> str:
    page = Page(html or "")
    content = model.marginals(page)
    blocks = (SPACE.sub(" ", "".join(t for k, t in block if content[k] > 0.5)).strip() for block in page.blocks)
    return "\n\n".join(b for b in blocks if b)


def extracted(pages: DataFrame, labelled: list[str] | None = None) -> DataFrame:
    """The columns of pages (html among them) without html, plus text and n_chars (code points)."""
    model = pages.sparkSession.sparkContext.broadcast(Model(labelled or html_labels.pages()))
    kept = [f for f in pages.schema.fields if f.name not in ("html", "text", "n_chars")]
    schema = T.StructType([*kept, *T.StructType.fromDDL("text string, n_chars long").fields])

    def run(batches):
        for batch in batches:
            texts = [main_text(x, model.value) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in kept] + [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    return pages.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
