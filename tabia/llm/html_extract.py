"""Main text of web pages by a tree-structured graphical model over DOM nodes.

Every element is a binary variable: part of the article or not. It has a
potential from its own features, and an edge potential with its parent. One
upward and one downward sweep of sum-product messages give exact marginals, as
the graph is a tree. The weights are fitted to labelled pages by the gradient of
the log likelihood, which needs the same marginals.
"""

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabia.llm import labelled_pages
from tabia.llm.common import slices, table, whole

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<data>.*?)(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+)>"
    r"|(?P<odd><(?P<end2>/?)(?P<name2>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest2>[^>]*)>)",
    re.S,
)
#: once a quote is left open, the rest of the page is read with tags that end at the next >
LOOSE = re.compile(TAG.pattern.replace(r"""=\s*+(?:\"[^\"]*+\"|'[^']*+')|=""", "="), re.S)
MARKS = re.compile(r"""(?:^|(?<=[\s"'/]))(class|id|role|data-y|hidden|style)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDES = re.compile(r"""(?:^|\s)hidden(?:[\s/=]|$)""", re.I)
QUOTED = re.compile(r""""[^"]*"|'[^']*'""")
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = set("script style noscript template head title textarea select option svg math iframe object canvas".split())
RAW = set("script style noscript template textarea title iframe".split())
RAW_END = {name: re.compile(f"</{name}(?=[\\s/>])[^>]*>", re.I) for name in RAW}
UNENDED = re.compile(r"<!--|<!\[CDATA\[")
BLOCK = set(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure"
    " footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody thead"
    " tfoot tr td th caption ul legend".split()
)
CLOSES_P = BLOCK - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
#: an element that ends an open one of the second set, unless one of the third stands between
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
}
FENCE = {"table", "td", "th", "button", "body", "html", "div", "article", "section", "aside", "main", "li"}
GOOD = re.compile(r"article|content|post|story|entry|main|body|text", re.I)
BAD = re.compile(
    r"(?:^|[\s_-])ads?(?:$|[\s_-])|advert|banner|promo|sponsor|cookie|consent|gdpr|notice|alert|popup|modal|newsletter|subscri"
    r"|nav|menu|breadcrumb|header|foot|copyright|side|widget|rail|comment|discuss|reply|respond|disqus|share|social"
    r"|related|recommend|more-|search|login|signup|form|toolbar|skip|pagination|tags?\b",
    re.I,
)
SPACE = re.compile(r"\s+")
GROUPS = {
    "chrome": set("nav header footer aside form button dialog menu label input fieldset legend".split()),
    "holder": set("article main".split()),
    "text": set("p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption".split()),
    "list": set("ul ol li dl dt dd".split()),
    "table": set("table tbody thead tfoot tr td th caption".split()),
    "inline": set("a b i em strong span code u small sup sub abbr cite q s mark time font del ins kbd var samp".split()),
    "block": set("div section body html center address details summary".split()),
}
GROUP_OF = {t: g for g, tags in GROUPS.items() for t in tags}
EPOCHS, RATE, RIDGE = 120, 0.7, 0.0002
SLICE = 4 << 20


class Node:
    __slots__ = ("tag", "marks", "parent", "children", "own", "linked", "label", "hidden", "bad", "good")

    def __init__(self, tag, marks, parent):
        self.tag, self.marks, self.parent = tag, marks, parent
        self.children: list[int] = []
        self.own = self.linked = 0
        self.label = None
        self.hidden = self.bad = self.good = False


class Open:
    """The open elements, and where the innermost of each name stands, so that no tag walks over all of them."""

    def __init__(self, nodes):
        self.nodes = nodes
        self.stack = [0]
        self.places: dict = {}

    def push(self, k):
        self.places.setdefault(self.nodes[k].tag, []).append(len(self.stack))
        self.stack.append(k)

    def cut(self, place):
        while len(self.stack) > place:
            self.places[self.nodes[self.stack.pop()].tag].pop()

    def innermost(self, names) -> int:
        """Place of the innermost open element with one of the names, 0 if there is none."""
        return max((self.places[x][-1] for x in names if self.places.get(x)), default=0)


def parse(page: str):
    """Nodes in document order (parents first) and the text runs (node, raw text).

    A line break is a run of one blank; a rule (``hr``) ends its block, as a run
    of None. Every tag takes a bounded number of steps besides those that close
    what was opened, and no search passes the page's last ``>``, so the time
    grows with the length of the page, however broken its markup.
    """
    nodes = [Node("html", "", -1)]
    runs: list = []
    open_ = Open(nodes)
    at, last, tag = 0, page.rfind(">") + 1, TAG

    def text(raw):
        if raw:
            runs.append((open_.stack[-1], raw))

    while True:
        found = tag.search(page, at, last) if at < last else None
        if not found:
            # behind the last > only an unended comment or data section can begin
            found = UNENDED.search(page, at)
            text(page[at : found.start() if found else len(page)])
            if found and found[0] != "<!--":
                text(html.escape(page[found.end() :], quote=False))
            return nodes, runs
        text(page[at : found.start()])
        at = found.end()
        if found["odd"]:
            tag = LOOSE
        whole_tag = page.startswith("<!--", found.start()) and not found[0].endswith("-->")
        if found["data"] is not None:
            ended = found[0].endswith("]]>")
            text(html.escape(found["data"] if ended else found["data"] + page[at:], quote=False))
            if not ended:
                return nodes, runs
            continue
        if whole_tag:
            return nodes, runs
        name = (found["name"] or found["name2"] or "").lower()
        if not name:
            continue
        if name == "br":
            text(" ")
            continue
        if found["end"] or found["end2"]:
            place = open_.innermost((name,))
            if place and (name in BLOCK or open_.innermost(FENCE) <= place):
                open_.cut(place)
            continue
        if name == "html" and len(open_.stack) > 1:
            continue
        drop, fence = SIBLINGS.get(name, (None, None))
        if name in CLOSES_P:
            drop, fence = (drop or set()) | {"p"}, (fence or set()) | FENCE - {"li" if name == "li" else ""}
        while drop:
            place = open_.innermost(drop)
            if not place or open_.innermost(fence) > place:
                break
            open_.cut(place)
            if name != "tr":
                break
        rest = found["rest"] if found["name"] else found["rest2"]
        node = Node(name, "", open_.stack[-1])
        k = len(nodes)
        nodes.append(node)
        nodes[open_.stack[-1]].children.append(k)
        names = []
        for mark in MARKS.finditer(rest or ""):
            value = mark[2] or mark[3] or mark[4] or ""
            kind = mark[1].lower()
            if kind == "data-y":
                node.label = int(value)
            elif kind == "style":
                node.hidden = "display:none" in value.replace(" ", "").lower()
            elif kind != "hidden":
                names.append(value)
        node.marks = " ".join(names)
        node.bad = bool(BAD.search(node.marks)) if node.marks else False
        node.good = bool(GOOD.search(node.marks)) if node.marks else False
        if rest and HIDES.search(QUOTED.sub('""', rest)):
            node.hidden = True
        node.hidden = node.hidden or name in HIDDEN
        if name in RAW:
            close = RAW_END[name].search(page, at, last)
            at = close.end() if close else len(page)
        elif name in VOID:
            if name in BLOCK:
                runs.append((k, None))
        elif not (rest or "").rstrip().endswith("/"):
            open_.push(k)


def features(nodes, runs) -> list[list[str]]:
    """Names of the binary features of each node."""
    total = [0] * len(nodes)
    linked = [0] * len(nodes)
    stops = [0] * len(nodes)
    for k, raw in runs:
        if raw is not None:
            n = len(raw.strip())
            total[k] += n
            stops[k] += raw.count(".") + raw.count(",")
            if nodes[k].tag == "a":
                linked[k] += n
    told = [n >= 40 and s * 100 > n for n, s in zip(total, stops)]  # sentences of the node itself
    parts = [0] * len(nodes)  # children that are paragraphs with sentences
    for k in range(len(nodes) - 1, 0, -1):
        up = nodes[k].parent
        total[up] += total[k]
        stops[up] += stops[k]
        linked[up] += total[k] if nodes[k].tag == "a" else linked[k]
        if nodes[k].tag == "p" and not nodes[k].bad and total[k] >= 40 and stops[k] * 100 > total[k] and 2 * linked[k] < total[k]:
            parts[up] += 1
    first = next((k for k, node in enumerate(nodes) if told[k] and not node.bad and GROUP_OF.get(node.tag) != "chrome"), 0)
    out = []
    for k, node in enumerate(nodes):
        group = GROUP_OF.get(node.tag, "other")
        names = ["bias", "group " + group]
        if node.tag in GROUPS["chrome"] or node.tag in GROUPS["holder"] or node.tag in ("body", "html", "p", "h1"):
            names.append("tag " + node.tag)
        if node.bad:
            names.append("bad name")
        if node.good and not node.bad:
            names.append("good name")
        n = total[k]
        names.append("size " + ("none" if not n else "short" if n < 40 else "middle" if n < 300 else "long"))
        if n and linked[k] > 0.5 * n:
            names.append("links")
            if k < first:
                names.append("links before the text")
        if n and stops[k] * 100 > n:
            names.append("sentences")
        plain = group != "chrome" and node.tag != "a" and not node.bad
        if told[k] and plain:
            names.append("own sentences " + (node.tag if node.tag in ("html", "body", "div", "td") else group))
        if parts[k] and plain:
            names.append("paragraphs" if parts[k] > 1 else "paragraph")
        if 10 * n > 7 * total[0] and plain and 2 * linked[k] < n:
            names.append("most of the page " + group)
        out.append(names)
    return out


def edge_kind(nodes, k) -> str:
    """The edge potential depends on the group of the child and on whether its name tells something."""
    node = nodes[k]
    group = GROUP_OF.get(node.tag, "other")
    return "chrome" if group == "chrome" or node.bad else "inline" if group == "inline" else "holder" if group == "holder" or node.good else "plain"


def logsum(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a + math.log1p(math.exp(b - a))


def marginals(nodes, unary, edges):
    """P(node = 1), and for each child the joint of (parent, child), by sum-product up and down the tree.

    unary: score of label 1 against 0; edges: for each node the 2 x 2 scores [parent][child].
    """
    n = len(nodes)
    up = [[0.0, u] for u in unary]  # score of a node's subtree by the node's label
    sent = [None] * n
    for k in range(n - 1, 0, -1):
        e, own = edges[k], up[k]
        message = (logsum(e[0][0] + own[0], e[0][1] + own[1]), logsum(e[1][0] + own[0], e[1][1] + own[1]))
        sent[k] = message
        p = up[nodes[k].parent]
        p[0] += message[0]
        p[1] += message[1]
    belief = [None] * n
    joint = [None] * n
    belief[0] = up[0]
    for k in range(1, n):
        p, m, e, own = belief[nodes[k].parent], sent[k], edges[k], up[k]
        out = (p[0] - m[0], p[1] - m[1])  # what reaches the parent from everywhere but this child
        both = [[out[a] + e[a][b] + own[b] for b in (0, 1)] for a in (0, 1)]
        down = [logsum(out[0] + e[0][b], out[1] + e[1][b]) for b in (0, 1)]
        belief[k] = [own[0] + down[0], own[1] + down[1]]
        top = max(map(max, both))
        weights = [[math.exp(x - top) for x in row] for row in both]
        z = sum(map(sum, weights))
        joint[k] = [[x / z for x in row] for row in weights]
    return [1 / (1 + math.exp(max(-700, min(700, b[0] - b[1])))) for b in belief], joint


def scored(nodes, names, model):
    unary, pair = model
    return marginals(
        nodes,
        [sum(unary.get(f, 0.0) for f in own) for own in names],
        [pair.get(edge_kind(nodes, k), ZERO) if k else ZERO for k in range(len(nodes))],
    )


ZERO = ((0.0, 0.0), (0.0, 0.0))


def train(pages=None):
    """Weights by gradient ascent on the log likelihood of the labelled pages.

    A weight's steps shrink with the root of the sum of its squared slopes, so
    that features of few pages are learnt as fast as those of all.
    """
    data = []
    for page in pages or labelled_pages.pages():
        nodes, runs = parse(page)
        labels = []
        for node in nodes:
            labels.append(node.label if node.label is not None else labels[node.parent] if node.parent >= 0 else 0)
        data.append((nodes, features(nodes, runs), labels))
    unary: dict = {}
    pair: dict = {}
    unary_size: dict = {}
    pair_size: dict = {}
    for _ in range(EPOCHS):
        slope: dict = {}
        turn: dict = {}
        for nodes, names, labels in data:
            p, joint = scored(nodes, names, (unary, pair))
            for k, own in enumerate(names):
                for f in own:
                    slope[f] = slope.get(f, 0.0) + labels[k] - p[k]
                if k:
                    t = turn.setdefault(edge_kind(nodes, k), [[0.0, 0.0], [0.0, 0.0]])
                    for a in (0, 1):
                        for b in (0, 1):
                            t[a][b] += (labels[nodes[k].parent] == a and labels[k] == b) - joint[k][a][b]
        for f, g in slope.items():
            g -= RIDGE * len(data) * unary.get(f, 0.0)
            unary_size[f] = unary_size.get(f, 1e-9) + g * g
            unary[f] = unary.get(f, 0.0) + RATE * g / math.sqrt(unary_size[f])
        for kind, t in turn.items():
            w = pair.setdefault(kind, [[0.0, 0.0], [0.0, 0.0]])
            size = pair_size.setdefault(kind, [[1e-9, 1e-9], [1e-9, 1e-9]])
            for a in (0, 1):
                for b in (0, 1):
                    g = t[a][b] - RIDGE * len(data) * w[a][b]
                    size[a][b] += g * g
                    w[a][b] += RATE * g / math.sqrt(size[a][b])
    return unary, pair


def main_text(page: str, model) -> str:
    """The text of the nodes whose marginal is above one half, a line for each block."""
    if not page:
        return ""
    nodes, runs = parse(page)
    p, _ = scored(nodes, features(nodes, runs), model)
    hidden = [False] * len(nodes)
    block = [0] * len(nodes)
    for k, node in enumerate(nodes):
        if k:
            hidden[k] = node.hidden or hidden[node.parent]
            block[k] = k if node.tag in BLOCK else block[node.parent]
    lines, parts, last = [], [], None

    def close():
        line = SPACE.sub(" ", "".join(parts)).strip()
        if line:
            lines.append(line)
        parts.clear()

    for k, raw in runs:
        if raw is None:
            close()
            continue
        if block[k] != last:
            close()
            last = block[k]
        if p[k] > 0.5 and not hidden[k]:
            parts.append(html.unescape(raw))
    close()
    return "\n".join(lines)


EXTRACTED = "page_id long, url string, text string, n_chars long"


def extract_batches(batches, model):
    for batch in batches:
        for part in slices(batch, "html", SLICE):
            found = [main_text(x or "", model) for x in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id"), part.column("url"), pa.array(found), pa.array(list(map(len, found)), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )


def extract(pages: DataFrame, model=None) -> DataFrame:
    """page_id, url, the article's text and its length in code points, for each page.

    Character references are decoded, white space inside a block is one space, as
    is a ``br``, blocks are joined by a line break. The article may stand in any
    element, or in the body or page itself. A null
    or empty page, and one without an article, give an empty text. Broken markup
    is read as far as it goes. Repeated rows are extracted each. Extra columns
    are not read.
    """
    model = model or train()
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), whole("html").alias("html"))
    return rows.mapInArrow(lambda batches: extract_batches(batches, model), EXTRACTED)


def op2_html_extraction(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages"))
