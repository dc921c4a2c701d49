"""Main text of web pages by a site style tree.

The pages of a host are merged into one tree. A node is an element (tag, class and id) below one presentation style of its
parent; a style is the sequence of child elements, runs of the same one folded. Per host and node, m pages hold it:

* presentation importance: the entropy, to base m, of the shares of its styles (1 if m = 1);
* content importance of text: 1 less the mean, over distinct block texts, of the entropy to base m of a text's spread over
  pages. Text of its own on every page gives 1, the same text on all pages gives 0;
* composite importance: ``(1 - g**l) * presentation + g**l * sum(p * style importance)`` over its l styles with shares p,
  bottom up, a style's importance being the mean of its children's.

Nodes below ``threshold`` that at least ``min_pages`` pages hold are noise, and their branches are removed from each page,
inside an article as outside. Elements deeper than 64 levels are folded into their ancestor there for the tree; their text stays.

Entropy cannot tell an article from noise that is new on every page, such as rotating adverts or page-wise menus. So what
the markup says of itself is taken as given importance: elements that name a menu, header, footer, sidebar, notice,
advert, form, script, style or comment list (tag, ARIA role, class or id) weigh 0, and ``article`` and ``main`` weigh 1.
A class or id counts as a whole: has-sidebar or comments-open name a state and weigh nothing. By its name alone, no element
is dropped that holds ``main``, or that holds an article while none is outside such elements.
Where a page has an article, its text is the main text; else that of ``main``; else what is left of the body.

Character references are decoded, white space inside a block is one space, blocks are trimmed and joined by a line feed.
Null and empty pages give an empty text. Pages with a null or odd url share one host. Repeated rows give repeated rows.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

# What HTML says of its elements, and names that sites give to what is not the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template svg math".split())
UNENDED = frozenset("script style textarea title xmp iframe".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr picture".split())
DROPPED_TAGS = frozenset("nav footer aside form script style noscript template iframe head title button select textarea input object canvas svg math menu dialog audio video datalist".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alertdialog alert toolbar tablist".split())
DROPPED_NAMES = frozenset("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup sidebar menu nav navbar navigation breadcrumb breadcrumbs footer share sharing social related recommended comment comments commentlist disqus replies reply pagination pager widget toolbar login copyright disclaimer".split())
CLOSES_P = frozenset("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"tr", "td", "th", "thead"}, "tfoot": {"tr", "td", "th", "tbody"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}, "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<(?=/?[a-zA-Z])[^>]*\Z""", re.S)
_ATTR = re.compile(r"""([^\s"'>/=][^\s>/=]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_READ = frozenset("class id role hidden aria-hidden style".split())
_NAME = re.compile(r"[a-z]+")
# Names that say how a page is laid out or what state it is in, not what the element is: has-sidebar, comments-open.
_STATE_FIRST = frozenset("has have no not without with is hide show".split())
_STATE_LAST = frozenset("open opened closed enabled disabled on off active inactive visible collapsed expanded".split())
NAMED = -2  # noise by its class or id alone


class Node:
    __slots__ = ("tag", "label", "given", "parent", "children", "key", "depth", "holds", "main", "inside")

    def __init__(self, tag: str, label: str, given: int, parent: "Node | None"):
        self.tag, self.label, self.given, self.parent = tag, label, given, parent
        self.children: list[Node | str] = []
        self.key, self.depth, self.holds, self.main = 0, 0, tag in ("#", "html", "body"), False
        self.inside = given > 0 or (parent is not None and parent.inside)  # in an article or main, or one itself


def attributes(rest: str) -> dict[str, str]:
    """The attributes in ``_READ`` of a tag, by lower-case name; the first of a name counts."""
    out: dict[str, str] = {}
    for name, value in _ATTR.findall(rest):
        name = name.lower()
        if name in _READ and name not in out:
            out[name] = value[1:-1] if value[:1] in ("'", '"') and value[-1:] == value[:1] and len(value) > 1 else value
    return out


def _noise_name(names: str, header: bool) -> bool:
    """Whether a class or id names an element that isn't the article; ``header``: whether header and masthead do."""
    for name in names.lower().split():
        words = _NAME.findall(name)
        if len(words) > 1 and (words[0] in _STATE_FIRST or words[-1] in _STATE_LAST):
            continue
        if not DROPPED_NAMES.isdisjoint(words) or header and ("header" in words or "masthead" in words):
            return True
    return False


def _given(tag: str, attrs: dict[str, str], inside: bool) -> int:
    """-1: noise, NAMED: noise by its name, 1: article, 2: main, 0: not said."""
    role = attrs.get("role", "").lower()
    if tag in DROPPED_TAGS or role in DROPPED_ROLES or (tag == "header" and not inside):
        return -1
    if "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or "display:none" in attrs.get("style", "").lower().replace(" ", ""):
        return -1
    names = attrs.get("class", "") + " " + attrs.get("id", "")
    if tag == "article" or role == "article":
        if _noise_name(names, False):
            return -1
    elif tag not in ("html", "body", "main") and role != "main" and _noise_name(names, not inside):
        return NAMED
    if tag == "article" or role == "article":
        return 1
    return 2 if tag == "main" or role == "main" else 0


def parse(page: str) -> Node:
    """A tree of elements and text; never fails, whatever the markup."""
    root = node = Node("#", "#", 0, None)
    opened: Counter = Counter()  # elements that are open, by tag: an end without a beginning needs no search
    at, n = 0, len(page)

    def back_to(up: Node) -> Node:
        x = node
        while x is not up:
            opened[x.tag] -= 1
            x = x.parent
        return up

    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            node.children.append(page[at:])
            break
        if m.start() > at:
            node.children.append(page[at : m.start()])
        at = m.end()
        close, name, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            if m[0].startswith("<![CDATA["):
                node.children.append(_html.escape(m[0][9:].removesuffix("]]>")))
            continue
        tag = name.lower()
        if close:
            if opened[tag] > 0:
                up = node
                while up.tag != tag:
                    up = up.parent
                node = back_to(up.parent)
            continue
        targets = CLOSES.get(tag, set()) | ({"p"} if tag in CLOSES_P else set())
        if any(opened[x] > 0 for x in targets):
            stop, up, last = SCOPES.get(tag, set()), node, None
            while up.parent is not None and up.tag not in stop:
                if up.tag in targets:
                    last = up
                elif up.tag not in INLINE and up.tag != "p" and not (targets - {"p"}):
                    break
                up = up.parent
            if last is not None:
                node = back_to(last.parent)
        if tag in VOID:
            if tag == "br" or tag == "hr":
                node.children.append(" " if tag == "br" else Node("hr", "hr", 0, node))
            continue
        attrs = attributes(rest) if rest else {}
        label = tag + "".join("." + x for x in sorted(attrs.get("class", "").lower().split())) + ("#" + attrs["id"].lower() if attrs.get("id") else "")
        new = Node(tag, label, _given(tag, attrs, node.inside), node)
        node.children.append(new)
        up = new if new.given > 0 else None
        while up is not None and not up.holds:
            up.holds, up = True, up.parent
        up = new if new.given == 2 else None
        while up is not None and not up.main:
            up.main, up = True, up.parent
        if tag in RAW:
            if tag in ("svg", "math") and rest and rest.rstrip().endswith("/"):
                continue
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
            # Text after a script or the like that isn't ended belongs to it; other elements without an end are taken as empty.
            at = end.end() if end else n if tag in UNENDED else at
        else:
            node = new
            opened[tag] += 1
    return root


def number(root: Node, hash64: Callable[[str], int], most_depth: int = 64) -> Iterator[tuple[Node, int]]:
    """Give every element its key in the style tree; yields (node, style hash). Deeper elements than ``most_depth`` share
    their ancestor's key."""
    todo = [root]
    root.key = hash64("#")
    while todo:
        node = todo.pop()
        below = [x for x in node.children if isinstance(x, Node) and x.tag not in INLINE]
        folded = [x.label for x, y in zip(below, [None, *below]) if y is None or y.label != x.label]
        style = hash64("\x00".join(folded))
        yield node, style
        for x in below:
            x.depth = min(node.depth + 1, most_depth)
            x.key = hash64(f"{node.key}\x00{style}\x00{x.label}") if node.depth < most_depth else node.key
            todo.append(x)


def blocks(root: Node, noise: frozenset[int] = frozenset()) -> list[tuple[str, int, int]]:
    """(text, node's key, kind) in page order; kind: 1 in an article, 2 in main, 0 elsewhere. Noise is left out.

    ``noise`` are keys of nodes of low importance; they don't count for what holds an article or ``main``, or is one.
    """
    out: list[tuple[str, int, int]] = []
    run: list[str] = []
    owner = (root.key, 0)

    def flush() -> None:
        if run:
            text = " ".join(_html.unescape("".join(run)).split())
            if text:
                out.append((text, *owner))
            run.clear()

    outside: list[bool] = []

    def dropped(x: Node, kind: int) -> bool:
        if x.given == NAMED and kind != 1 and x.holds:
            if x.main:
                return False
            if not outside:
                outside.append(_has(root, 1))
            return outside[0]
        return x.given < 0 or (x.given == 0 and not x.holds and x.key in noise)

    todo: list[tuple] = [(root, 0, False)]
    while todo:
        x, kind, leave = todo.pop()
        if isinstance(x, str):
            run.append(x)
            continue
        if leave:
            flush()
            owner = leave
            continue
        if dropped(x, kind):
            if x.tag not in INLINE:
                flush()
            continue
        now = kind if kind == 1 or (kind == 2 and x.given != 1) else max(x.given, 0)
        if x.tag not in INLINE:
            flush()
            todo.append((x, kind, owner))
            owner = (x.key, now)
        todo.extend((c, now, False) for c in reversed(x.children))
    flush()
    return out


def main_text(root: Node, noise: frozenset[int] = frozenset()) -> str:
    found = blocks(root, noise)
    kinds = {k for _, _, k in found}
    want = 1 if 1 in kinds else 2 if 2 in kinds else 0
    if want == 0 and _has(root, 1):
        return ""  # an article that is empty, or cut off before its text
    return "\n".join(t for t, _, k in found if k == want)


def _has(root: Node, given: int) -> bool:
    """Whether such a node is on the page, outside all that is noise."""
    todo = [root]
    while todo:
        x = todo.pop()
        if x.given == given:
            return True
        todo.extend(c for c in x.children if isinstance(c, Node) and c.given >= 0)
    return False


_HOST = re.compile(r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", re.I)


def host(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


def _hash() -> Callable[[str], int]:
    from xxhash import xxh64_intdigest

    return lambda s: xxh64_intdigest(s.encode("utf-8", "surrogatepass")) - (1 << 63)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(url, html) -> (host, node, parent, style, depth, kind, x, n, nlogn); kind 0: the style x, 1: the text x, 2: the page."""
    h = _hash()
    for batch in batches:
        total: Counter = Counter()
        logs: Counter = Counter()
        for url, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if not page:
                continue
            root, own, of = parse(page), Counter(), {}
            at = host(url)
            styles = {}
            for node, style in number(root, h):
                up = node.parent
                styles[node.key] = style
                place = of.setdefault(node.key, (at, node.key, up.key if up else 0, styles.get(up.key, 0) if up else 0, node.depth))
                own[place, 0, style] += 1
                own[place, 2, 0] = 1
            for text, key, _ in blocks(root):
                own[of[key], 1, h(text)] += 1
            for k, n in own.items():
                total[k] += n
                logs[k] += n * math.log(n)
        if total:
            rows = [(*place, kind, x, n, logs[place, kind, x]) for (place, kind, x), n in total.items()]
            kinds = [pa.string(), *[pa.int64()] * 7, pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["host", "node", "parent", "style", "depth", "kind", "x", "n", "nlogn"])


def site_style_tree(pages: DataFrame, gamma: float = 0.9) -> DataFrame:
    """(host, node, m, importance) of every node of every host's tree."""
    rows = pages.select("url", "html").mapInArrow(_features, "host string, node long, parent long, style long, depth long, kind long, x long, n long, nlogn double")
    # A text's entropy over pages: log N - sum(n log n) / N, so sums suffice and a frequent text is never gathered.
    parts = materialise(rows.groupBy("host", "node", "parent", "style", "depth", "kind", "x").agg(F.sum("n").alias("n"), F.sum("nlogn").alias("nlogn")), "style-tree")
    by = ["host", "node", "parent", "style", "depth"]
    n, is_style, is_text = F.col("n"), F.col("kind") == 0, F.col("kind") == 1
    nodes = parts.groupBy(*by).agg(
        F.sum(F.when(F.col("kind") == 2, n)).alias("m"), F.sum(F.when(is_style, n)).alias("uses"), F.sum(F.when(is_style, n * F.log(n))).alias("uses_log"), F.count(F.when(is_style, 1)).alias("l"),
        F.avg(F.when(is_text, F.log(n) - F.col("nlogn") / n)).alias("spread"),
    )
    base = F.log(F.col("m"))
    nodes = nodes.select(
        *by, "m", "l",
        F.when(F.col("m") > 1, F.least(F.lit(1.0), (F.log("uses") - F.col("uses_log") / F.col("uses")) / base)).otherwise(F.lit(1.0)).alias("shown"),
        F.when(F.col("spread").isNotNull(), F.when(F.col("m") > 1, F.greatest(F.lit(0.0), 1 - F.col("spread") / base)).otherwise(F.lit(1.0))).alias("said"),
    )
    nodes = materialise(nodes, "style-nodes")
    shares = parts.filter(is_style).select("host", "node", F.col("x").alias("own_style"), "n")
    deepest = nodes.agg(F.max("depth")).first()[0]
    done = None
    for depth in range(deepest if deepest is not None else -1, -1, -1):
        level = nodes.filter(F.col("depth") == depth)
        if done is None:
            level = level.withColumn("below", F.lit(None).cast("double"))
        else:
            under = done.filter(F.col("depth") == depth + 1).groupBy("host", F.col("parent").alias("node"), F.col("style").alias("own_style")).agg(F.avg("importance").alias("i"))
            mixed = shares.join(under, ["host", "node", "own_style"]).groupBy("host", "node").agg((F.sum(F.col("n") * F.col("i")) / F.sum("n")).alias("below"))
            level = level.join(mixed, ["host", "node"], "left")
        content = F.when(F.col("below").isNull(), F.col("said")).when(F.col("said").isNull(), F.col("below")).otherwise((F.col("below") + F.col("said")) / 2)
        share = F.pow(F.lit(gamma), F.col("l"))
        whole = F.when(content.isNull(), F.col("shown")).when(F.col("below").isNull(), content).otherwise((1 - share) * F.col("shown") + share * content)
        level = materialise(level.select("host", "node", "parent", "style", "depth", "m", whole.alias("importance")), "style-level")
        done = level if done is None else done.unionByName(level)
    return (done if done is not None else nodes.withColumn("importance", F.col("shown"))).select("host", "node", "m", "importance")


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    h = _hash()
    for batch in batches:
        texts = []
        for page, noise in zip(batch.column("html").to_pylist(), batch.column("noise").to_pylist()):
            if not page:
                texts.append("")
                continue
            root = parse(page)
            if noise:
                for _ in number(root, h):
                    pass
            texts.append(main_text(root, frozenset(noise or ())))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, threshold: float = 0.2, min_pages: int = 5, broadcast_nodes: int = 100_000, id_col: str = "page_id") -> DataFrame:
    """One row per page: page_id, url, text, n_chars. Noise nodes go to the tasks by broadcast up to ``broadcast_nodes`` of
    them, beyond that by a join on the host."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    tree = site_style_tree(rows)
    noise = tree.filter((F.col("importance") < threshold) & (F.col("m") >= min_pages))
    noise = materialise(noise.groupBy("host").agg(F.collect_set("node").alias("noise")), "style-noise")
    size = noise.agg(F.sum(F.size("noise"))).first()[0] or 0
    at = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    joined = rows.withColumn("host", at).join(F.broadcast(noise) if size <= broadcast_nodes else noise, "host", "left")
    kind = dict(rows.dtypes)["page_id"]
    return joined.select("page_id", "url", "html", "noise").mapInArrow(_extract, f"page_id {kind}, url string, text string, n_chars long")
