"""Operator 9: main text of HTML pages by a tree-structured graphical model.

The block elements of a page form a tree.  Each node is content or not; a node's state depends on
its parent's (the pair potential, by kind of tag) and shows in what can be seen of the node (the
node potentials: tag, words of class and id, length of own text, share of link text, sentence
ends).  Sum-product messages go up the tree and down again, which gives every node's exact marginal;
the text of nodes that are content with probability over one half is kept, in page order.

All potentials are learned counts.  Labelled pages are those that mark their own article
(``article``, ``main``, ``role=main``, ``itemprop=articleBody``): what stands inside and not in a
part marked as something else is content.  Every other labelled page is learned with those marks
taken away, so the model does not lean on them alone.  About ``SAMPLE`` pages, picked by a hash, are
learned from.  Prior counts (``PRIOR``) say what the HTML standard says of its tags and what the
usual class words mean; they decide where the sample has no such element.

Class, id and role words are learned too, whatever their language: a word is one of boilerplate, like those of
the list, if at least ``OFTEN`` block elements of labelled pages bear it that neither are nor hold content, and
``AGAINST`` times as many as are content.  An element that is hidden (``hidden``, ``display:none``) counts as boilerplate.

An element that by its tag or class is not the article passes that on to all within, as the kind of
pair that rarely turns to content.  ``body`` doesn't, nor does an element marked as the article, nor a
wrapper: an element so by its class words, or a form, that holds most of the text of the page (or of the
article that it stands in) and leaves less than a quarter as much outside that could be content.

Scripts, styles, templates and the head are never text.  Character references are decoded, white
space inside a block becomes one space, blocks are joined by one space.

Edge cases: a NULL or empty page has the text "", a page without any element its whole text.  Unclosed and stray tags are repaired as browsers
do for the usual cases; markup that never ends is markup up to the end.  Without any labelled page
the prior counts decide.  Repeated rows are kept.  Other columns are not looked at.
"""

from __future__ import annotations

import html as html_lib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col

#: Pages to learn from, about.
SAMPLE = 2000
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|itemprop|style)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
RAW = {t: re.compile(rf"</{t}\s*>|\Z", re.I) for t in ("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "select")}
HIDDEN = re.compile(r"(?<![\w-])hidden(?![\w-])", re.I)
QUOTED = re.compile(r"=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>]+)")
NAMES = re.compile(r"[A-Z]?[^\W\d_A-Z]+|[A-Z]+")
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose start and end break the text into blocks.
BLOCK = set("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - set("body button caption head html legend option summary tbody td tfoot th thead tr".split())
#: What an opening tag closes, up to the nearest of the elements in the second set.
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, set())}
#: Class and id words, and what they usually say.
BOILER_WORDS = set("ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer footer form header login masthead menu modal nav navbar navigation newsletter notice notices pagination pager popup promo promoted promotion related respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split())
CONTENT_WORDS = set("article articlebody body content entry main post story text".split())
#: How many elements of no content bear a word that counts as one of boilerplate, and how often as many as of content.
OFTEN, AGAINST = 10, 50
MARKS = {"article", "main"}
#: Elements that may hold the whole page whatever their class says.
WRAPPER_TAGS = set("center div form section span table tbody td tr".split())
#: "hidden" stands for any hidden element.
BOILER_TAGS = set("hidden aside button dialog fieldset footer form header legend menu nav option".split())
#: Prior counts (state 0, state 1) of what a node shows; all else starts at (1, 1).
PRIOR = {("tag", t): (400.0, 0.5) for t in BOILER_TAGS} | {("tag", t): (1.0, 60.0) for t in MARKS} | {("tag", "p"): (1.0, 40.0)} | {("word", "boiler"): (400.0, 0.5), ("word", "content"): (2.0, 20.0), ("word", "both"): (40.0, 2.0)}
#: Prior count of content within boilerplate, against 20; a single labelled element outweighs it.
RARE = 1e-4
#: Prior counts of pairs (kind of the child, parent state, state).
PAIR_PRIOR = {
    ("plain", 0, 0): 20.0, ("plain", 0, 1): 1.0, ("plain", 1, 0): 0.5, ("plain", 1, 1): 20.0,
    ("boiler", 0, 0): 20.0, ("boiler", 0, 1): RARE, ("boiler", 1, 0): 20.0, ("boiler", 1, 1): RARE,
    ("class", 0, 0): 20.0, ("class", 0, 1): RARE, ("class", 1, 0): 20.0, ("class", 1, 1): RARE,
}


class Node:
    """A block element.  Its ``kind``, which the pair potential depends on, is "boiler" for an element that by
    its tag, "class" for one that by its class is not the article, and so for all within, up to an element that
    is marked as the article.
    ``wraps`` says that it holds most of the text of its page (or of the article that it stands in)."""

    __slots__ = ("tag", "parent", "words", "marked", "names", "kind", "chars", "linked", "ends", "wraps")

    def __init__(self, tag: str, parent: int, words: str, marked: bool, names: frozenset[str] = frozenset()):
        self.tag, self.parent, self.words, self.marked, self.names = tag, parent, words, marked, names
        self.kind, self.wraps = "plain", False
        self.chars = self.linked = self.ends = 0


def _kind(node: Node, outer: str, wrapper: bool = False) -> str:
    """The kind of a node within one of kind ``outer``."""
    if node.marked:  # a comment marked as an article is still one of the comments
        return outer if outer != "plain" and node.words == "boiler" else "plain"
    own = "plain" if wrapper or node.tag == "body" else "boiler" if node.tag in BOILER_TAGS else "class" if node.words == "boiler" else "plain"
    return own if outer == "plain" or own == "boiler" else outer


def _set_kinds(nodes: list[Node]) -> None:
    """The kinds, once the text of all nodes is known."""
    for i, n in enumerate(nodes[1:], 1):
        n.kind = _kind(n, nodes[n.parent].kind)
    held = [n.chars for n in nodes]
    plain = [n.chars * (n.kind == "plain") for n in nodes]  # text that no class word or tag speaks against
    scope = [0] * len(nodes)
    for i in range(len(nodes) - 1, 0, -1):
        up = nodes[i].parent
        held[up], plain[up] = held[up] + held[i], plain[up] + plain[i]
    for i, n in enumerate(nodes[1:], 1):
        up = n.parent
        scope[i] = up if nodes[up].marked else scope[up]  # the article that it stands in, or the page
        n.wraps = 2 * held[i] > held[scope[i]]
        n.kind = _kind(n, nodes[up].kind, n.wraps and n.tag in WRAPPER_TAGS and 4 * (plain[scope[i]] - plain[i]) < held[i])
        if n.kind == "plain" and n.words == "boiler":
            n.words = "none"


def _read(attributes: str) -> tuple[frozenset[str], bool, bool]:
    """Class, id and role words, whether the element is marked as the article, and whether it is hidden."""
    names, marked = set(), False
    hidden = bool(HIDDEN.search(QUOTED.sub("", attributes)))
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        value, name = a or b or c, name.lower()
        if name == "style":
            hidden |= "display:none" in value.lower().replace(" ", "")
        elif name in ("role", "itemprop"):
            marked |= value.lower() in ("main", "articlebody")
            names |= {"nav"} if value.lower() in ("navigation", "banner", "contentinfo", "complementary", "search") else {f"{name}:{value.lower()}"}
        else:
            names.update(w.lower() for w in NAMES.findall(value))
    return frozenset(names), marked, hidden


def _kind_of_words(names: frozenset[str], learned: frozenset[str]) -> str:
    """What class and id words say; ``learned``: words of boilerplate beside the list."""
    boiler, content = not names.isdisjoint(BOILER_WORDS) or not names.isdisjoint(learned), not names.isdisjoint(CONTENT_WORDS)
    return "both" if boiler and content else "boiler" if boiler else "content" if content else "none"


def dom(page: str, learned: frozenset[str] = frozenset()) -> tuple[list[Node], list[tuple[int, str]]]:
    """The nodes (parents first) and the text blocks, each with its node, in page order; ``learned``: see ``Model``."""
    nodes = [Node("html", -1, "none", False)]
    stack: list[tuple[str, int]] = [("html", 0)]  # open elements, and the node their text belongs to
    blocks: list[tuple[int, str]] = []
    buffer: list[str] = []
    links = 0

    def flush() -> None:
        if buffer:
            if text := " ".join("".join(buffer).split()):
                blocks.append((stack[-1][1], text))
                node = nodes[stack[-1][1]]
                node.chars += len(text)
                node.ends += text[-1] in ".!?\"'”»"
            buffer.clear()

    def add(raw: str) -> None:
        if raw:
            text = html_lib.unescape(raw) if "&" in raw else raw
            buffer.append(text)
            if links:
                nodes[stack[-1][1]].linked += len(text.strip())

    def close(depth: int) -> None:
        nonlocal links
        while len(stack) > depth:
            if stack[-1][0] in BLOCK or stack[-1][1] != stack[-2][1]:
                flush()
            links -= stack[-1][0] == "a"
            stack.pop()

    at = 0
    while m := TOKEN.search(page, at):
        add(page[at : m.start()])
        at = m.end()
        end, start = m.group(1), m.group(2)
        if start:
            tag = start.lower()
            if tag in RAW:
                if not m.group(3).rstrip().endswith("/"):
                    at = RAW[tag].search(page, at).end()
                continue
            if tag == "br":
                buffer.append(" ")
            if tag in ("html",) or tag in VOID and tag != "hr":
                continue
            if tag in CLOSES_P:
                p = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] in ("p", "table", "td", "th", "button")), 0)
                if stack[p][0] == "p":
                    close(p)
            if tag in IMPLIED:
                closed, limit = IMPLIED[tag]
                while i := next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] in closed or stack[i][0] in limit), 0):
                    if stack[i][0] in limit:
                        break
                    close(i)
            if tag == "hr":
                flush()
                continue
            names, marked, hidden = _read(m.group(3)) if m.group(3) else (frozenset(), False, False)
            words = _kind_of_words(names, learned)
            hidden = hidden and tag != "body"  # a page that a script uncovers
            if tag in BLOCK or words == "boiler" or hidden:
                flush()
                nodes.append(Node("hidden" if hidden else tag, stack[-1][1], words, (marked or tag in MARKS) and not hidden, names))
                stack.append((tag, len(nodes) - 1))
            else:
                stack.append((tag, stack[-1][1]))
            links += tag == "a"
        elif end:
            tag = end.lower()
            if tag == "br":
                buffer.append(" ")
            if i := next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag), 0):
                close(i)
    add(page[at:])
    flush()
    _set_kinds(nodes)
    return nodes, blocks


def shown(node: Node, masked: bool = False) -> list[tuple[str, str]]:
    """What can be seen of a node."""
    tag = "div" if masked and node.marked else node.tag
    out = [("tag", tag if tag in BLOCK or tag == "hidden" else "inline"), ("word", "none" if masked and node.marked else node.words)]
    out.append(("length", str(min(8, node.chars.bit_length() // 2 + (node.chars > 0)))))
    if node.chars:
        out.append(("links", str(min(4, 4 * node.linked // node.chars))))
        out.append(("ends", str(min(2, node.ends))))
    return out


def labels(nodes: list[Node]) -> list[int] | None:
    """State of each node by the page's own marks; None where it marks no article."""
    if not any(n.marked for n in nodes):
        return None
    out: list[int] = []
    for n in nodes:
        inside = n.parent >= 0 and out[n.parent] == 1
        # within the article, class words of what holds most of it don't count, nor what they pass on
        own = n.tag in BOILER_TAGS or n.words == "boiler" and not n.wraps
        out.append(int(inside and not own or n.marked and n.kind == "plain"))
    return out


class Model:
    """Potentials from counts {(name, value, state): n}; pairs are ("pair", kind and parent state, state).

    Counts of ("name", word, state) give ``learned``, the words of boilerplate beside the list."""

    def __init__(self, counts: dict[tuple[str, str, int], float]):
        names = {k[1]: n for k, n in counts.items() if k[0] == "name" and k[2] == 0}
        self.learned = frozenset(w for w, n in names.items() if n >= OFTEN and n >= AGAINST * counts.get(("name", w, 1), 0) and w not in CONTENT_WORDS)
        seen = {(k[0], k[1]) for k in counts if k[0] not in ("pair", "name")} | set(PRIOR)
        n = {f: [counts.get((*f, s), 0) + PRIOR.get(f, (1.0, 1.0))[s] for s in (0, 1)] for f in seen}
        total = Counter()
        for (name, _), both in n.items():
            for s in (0, 1):
                total[name, s] += both[s]
        self.node = {f: (math.log(both[0] / total[f[0], 0]), math.log(both[1] / total[f[0], 1])) for f, both in n.items()}
        pair = {(k, p, s): counts.get(("pair", f"{k}{p}", s), 0) + v for (k, p, s), v in PAIR_PRIOR.items()}
        share = {(k, p, s): pair[k, p, s] / (pair[k, p, 0] + pair[k, p, 1]) for k, p, s in pair}
        self.pair = {k: [share[k, p, s] for p in (0, 1) for s in (0, 1)] for k in ("plain", "class", "boiler")}
        self.root = (0.98, 0.02)

    def marginals(self, nodes: list[Node], masked: bool = False) -> list[float]:
        """P(content) of each node: messages to the parents, then back to the children."""
        n, get = len(nodes), self.node.get
        pairs = [self.pair[node.kind] for node in nodes]
        own = []
        for node in nodes:
            a = b = 0.0
            for f in shown(node, masked):
                x, y = get(f, (0.0, 0.0))
                a, b = a + x, b + y
            top = max(a, b)
            own.append([math.exp(a - top), math.exp(b - top)])
        up = [(1.0, 1.0)] * n
        below = [list(x) for x in own]  # node potential times the messages of the children
        for i in range(n - 1, 0, -1):
            b0, b1 = below[i]
            p00, p01, p10, p11 = pairs[i]
            m0, m1 = p00 * b0 + p01 * b1, p10 * b0 + p11 * b1
            scale = m0 + m1
            up[i] = m0, m1 = m0 / scale, m1 / scale
            parent = below[nodes[i].parent]
            x, y = parent[0] * m0, parent[1] * m1
            if x + y < 1e-200:
                x, y = x * 1e200, y * 1e200
            parent[0], parent[1] = x, y
        belief = [(0.0, 0.0)] * n
        x, y = below[0][0] * self.root[0], below[0][1] * self.root[1]
        belief[0] = x / (x + y), y / (x + y)
        for i in range(1, n):
            q0, q1 = belief[nodes[i].parent]
            p00, p01, p10, p11 = pairs[i]
            q0, q1 = q0 / up[i][0] if up[i][0] else 0.0, q1 / up[i][1] if up[i][1] else 0.0  # without this child's message
            x, y = (q0 * p00 + q1 * p10) * below[i][0], (q0 * p01 + q1 * p11) * below[i][1]
            belief[i] = (x / (x + y), y / (x + y)) if x + y else (1.0, 0.0)
        return [b[1] for b in belief]

    def text(self, page: str | None) -> str:
        if not page:
            return ""
        nodes, blocks = dom(page, self.learned)
        p = self.marginals(nodes) if len(nodes) > 1 else [1.0]
        return " ".join(t for node, t in blocks if p[node] > 0.5)


def counts_of(page: str, masked: bool) -> Counter:
    """What a labelled page adds to the counts; nothing if it marks no article."""
    nodes, _ = dom(page)
    states = labels(nodes)
    out: Counter = Counter()
    holds = list(states or [])  # whether a node is content or holds some
    for i in range(len(holds) - 1, 0, -1):
        holds[nodes[i].parent] |= holds[i]
    for node, s, h in zip(nodes, states or [], holds):
        if s == h:
            for w in node.names:
                out["name", w, s] += 1
        for name, value in shown(node, masked):
            out[name, value, s] += 1
        if node.parent >= 0:
            out["pair", f"{node.kind}{states[node.parent]}", s] += 1
    return out


def train(pages: DataFrame, html_col: str = "html", sample: int = SAMPLE) -> Model:
    """Counts over about ``sample`` pages that a hash picks."""
    text = col(html_col)
    every = max(1, pages.count() // sample)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for page, masked in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total.update(counts_of(page, masked))
        rows = [{"name": k[0], "value": k[1], "state": k[2], "n": n} for k, n in total.items()]
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("name", pa.string()), ("value", pa.string()), ("state", pa.int32()), ("n", pa.int64())]))

    picked = pages.where(text.isNotNull() & (F.pmod(F.xxhash64(text), F.lit(every)) == 0))
    counted = picked.select(text.alias("html"), (F.pmod(F.hash(text), F.lit(2)) == 0).alias("masked")).mapInArrow(count, "name string, value string, state int, n long")
    rows = counted.groupBy("name", "value", "state").agg(F.sum("n").alias("n")).collect()  # one row per tag, class word and the like of the sample
    return Model({(r["name"], r["value"], r["state"]): r["n"] for r in rows})


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", model: Model | None = None) -> DataFrame:
    """Per page: id, url, the main text and its number of characters."""
    model = model or train(pages, html_col)

    @F.arrow_udf("string")
    def main_text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([model.text(x.as_py()) for x in batch], pa.string())

    out = pages.select(col(id_col), col(url_col), main_text(col(html_col)).alias("_text"))
    return out.select(col(id_col), col(url_col), F.col("_text").alias("text"), F.length("_text").cast("long").alias("n_chars"))
