"""Main text of web pages by wrapper induction.

Pages of one host come from one template. A page's tag tree is aligned with the tree of a page of the same host
(its pivot) by simple tree matching, which finds the largest set of nodes matched in order level by level. Over all pages of
the host, nodes of the pivot whose text is the same in nearly all matched pages are template; slots whose text varies are
content. Regions that HTML itself declares to be no article (navigation, footers, forms, scripts, adverts by their
class and so on) are left out of the trees from the start, and where a page has an article or main element,
only that is read.

Trees are small strings, the join key is salted for hosts with many pages, and what a host's wrapper holds is bounded by its pivot.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Generator, Iterator
from zlib import crc32

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..runtime import materialize
from .urls import host_of

# Names of the HTML standard and usual class names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math xmp noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCKS - {"html", "head", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "summary", "li", "dd", "dt"}
OUTSIDE = frozenset("head nav header footer aside form menu dialog button select datalist object audio video canvas map search fieldset label input".split()) | RAW
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert dialog alertdialog toolbar".split())
NAMES = re.compile(
    r"(?:^|[-_\s])(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumbs?|sidebar\w*|side|footer|foot|header|masthead|topbar|cookies?\w*|consent|notice|alert|popup|modal|overlay|newsletter|subscribe|signup|share|sharing|social|related|recommend\w*|comments?|respond|disqus|replies|widget|toolbar|pagination|pager|login|search|skip|copyright|legal|disclaimer)(?:$|[-_\s])",
    re.I,
)
ARTICLE = frozenset(("article", "main"))
#: A slot is template where so many pages match it and at least this share of them has the pivot's text.
LEAST_PAGES = 8
CONSTANT_SHARE = 0.8
#: Pages of a host with one salt, about.
SALT_PAGES = 2000

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_SPACE = re.compile(r"\s+")


class Node:
    """An element: its tag, its child elements, and for blocks the text lines directly in it."""

    __slots__ = ("tag", "kids", "out", "text")

    def __init__(self, tag: str, out: bool = False) -> None:
        self.tag, self.kids, self.out, self.text = tag, [], out, ""


def _is_outside(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in OUTSIDE and not (tag == "header" and in_article):
        return True
    if "=" not in attributes and "hidden" not in attributes.lower():
        return False
    for name, *values in _ATTRIBUTE.findall(attributes):
        value, name = next((v for v in values if v), ""), name.lower()
        if name == "role" and value.lower() in ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "style" and "display:none" in value.replace(" ", "").lower():
            return True
        if name in ("class", "id") and tag not in ("html", "body", "article", "main") and NAMES.search(value):
            return True
    return False


def parse(page: str | None) -> Node:
    """The tree of block elements of a page; each run of inline content is a leaf ``#`` with its text, white space made one."""
    root = Node("#root")
    stack, run, at, page = [root], [], 0, page or ""
    article = 0

    def flush() -> None:
        if run:
            text = _SPACE.sub(" ", entities.unescape("".join(run))).strip()
            run.clear()
            if text and not stack[-1].out:
                leaf = Node("#")
                leaf.text = text
                stack[-1].kids.append(leaf)

    def close(tag: str) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag == tag:
                flush()
                del stack[k:]
                return
            if tag == "p" and stack[k].tag in ("article", "section", "div", "td", "main", "li", "blockquote"):
                return

    n = len(page)
    while at < n:
        m = _TAG.search(page, at)
        if not m:
            run.append(page[at:])
            break
        if m.start() > at:
            run.append(page[at : m.start()])
        at = m.end()
        if m[0].startswith("<![CDATA["):
            continue
        if m[2] is None:
            continue
        tag, end = m[2].lower(), m[1] == "/"
        if end:
            if tag in BLOCKS or tag in OUTSIDE:
                close(tag)
                if tag == "p" and "p" not in (x.tag for x in stack):
                    flush()
            continue
        if tag == "br":
            run.append("\n")
            continue
        if tag in RAW:
            # Its content is no markup: skip to its end tag.
            stop = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = stop.end() if stop else n
            continue
        if tag in VOID:
            if tag in BLOCKS:
                flush()
            continue
        if tag in BLOCKS or tag in OUTSIDE:
            flush()
            if tag in CLOSES_P:
                close("p")
            if tag in ("li", "dt", "dd", "tr", "td", "th"):
                # The same kind of item ends the one before, within its list or row.
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in ("ul", "ol", "dl", "table"):
                        break
                    if stack[k].tag == tag or {stack[k].tag, tag} == {"dt", "dd"} or {stack[k].tag, tag} == {"td", "th"}:
                        del stack[k:]
                        break
            out = stack[-1].out or _is_outside(tag, m[3], any(x.tag in ARTICLE for x in stack))
            node = Node(tag, out)
            if not out:
                stack[-1].kids.append(node)
            stack.append(node)
        elif not stack[-1].out and _is_outside(tag, m[3], False):
            # An inline element that is no content: its text is dropped with it.
            flush()
            node = Node(tag, True)
            stack.append(node)
            stop = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            stack.pop()
            at = stop.end() if stop else at
    flush()
    return _article(root)


def _weight(node: Node) -> int:
    return len(node.text) + sum(len(n.text) for n in _below(node))


def _article(root: Node) -> Node:
    """The tree below the article or main elements if there is one with text, else the whole tree."""
    found, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.tag in ARTICLE and _weight(node):
            inner = [k for k in _below(node) if k.tag == "article" and _weight(k)]
            found.append(node) if node.tag == "article" or not inner else todo.extend(reversed(inner))
        else:
            todo.extend(reversed(node.kids))
    if not found:
        return root
    top = Node("#root")
    top.kids = found
    return top


def _below(node: Node) -> list[Node]:
    """All nodes below in page order; trees may be as deep as the page nests them, so nothing here recurses."""
    out, todo = [], node.kids[::-1]
    while todo:
        out.append(todo.pop())
        todo += reversed(out[-1].kids)
    return out


def skeleton(root: Node) -> str:
    """The tree as ``tag(children)`` with a checksum in place of each text."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if isinstance(node, str):
            out.append(node)
        elif node.tag == "#":
            out.append(f"#{crc32(node.text.encode('utf-8', 'surrogatepass')):08x}")
        else:
            out.append(f"{node.tag}(")
            todo.append(")")
            for k, kid in enumerate(reversed(node.kids)):
                todo += [",", kid] if k else [kid]
    return "".join(out)


def from_skeleton(text: str) -> Node:
    root = Node("#top")
    stack = [root]
    for tag, leaf, end in re.findall(r"([^(),]+)\(|#([0-9a-f]{8})|(\))", text):
        if end:
            stack.pop()
            continue
        node = Node("#" if leaf else tag)
        node.text = leaf
        stack[-1].kids.append(node)
        if not leaf:
            stack.append(node)
    return root.kids[0] if root.kids else root


def match(a: Node, b: Node) -> tuple[int, list[tuple[Node, Node]]]:
    """Simple tree matching: the most pairs of nodes of equal tag, roots with roots, children in order; equal texts count double."""
    todo, answer = [_matching(a, b)], None
    while todo:
        try:
            todo.append(_matching(*todo[-1].send(answer)))
            answer = None
        except StopIteration as done:
            todo.pop()
            answer = done.value
    return answer


def _matching(a: Node, b: Node) -> Generator[tuple[Node, Node], tuple[int, list[tuple[Node, Node]]], tuple[int, list[tuple[Node, Node]]]]:
    """One level of ``match``: yields pairs of children and is sent their matches.

    Equal children at either end of two lists are paired at once; the rest by dynamic programming.
    """
    if a.tag != b.tag:
        return 0, []
    pairs = [(a, b)]
    score = 2 if a.tag == "#" and a.text == b.text else 1
    x, y = a.kids, b.kids
    if not x or not y:
        return score, pairs
    lo, hi = 0, 0
    same = lambda p, q: p.tag == q.tag == "#" and p.text == q.text
    while lo < min(len(x), len(y)) and same(x[lo], y[lo]):
        pairs.append((x[lo], y[lo]))
        lo += 1
    while hi < min(len(x), len(y)) - lo and same(x[-1 - hi], y[-1 - hi]):
        pairs.append((x[-1 - hi], y[-1 - hi]))
        hi += 1
    score += 2 * (lo + hi)
    x, y = x[lo : len(x) - hi], y[lo : len(y) - hi]
    if not x or not y:
        return score, pairs
    inner = {}
    above = [0] * (len(y) + 1)
    rows = [above]
    for i, p in enumerate(x):
        row = [0]
        for j, q in enumerate(y):
            best = above[j + 1] if above[j + 1] >= row[j] else row[j]
            if p.tag == q.tag:
                if p.tag == "#":
                    w = 2 if p.text == q.text else 1
                elif not p.kids or not q.kids:
                    w = 1
                elif len(p.kids) == 1 == len(q.kids) and p.kids[0].tag == "#" == q.kids[0].tag:
                    w = 3 if p.kids[0].text == q.kids[0].text else 2
                else:
                    inner[i, j] = yield p, q
                    w = inner[i, j][0]
                if above[j] + w > best:
                    best = above[j] + w
            row.append(best)
        rows.append(row)
        above = row
    i, j = len(x), len(y)
    score += rows[i][j]
    while i and j:
        if rows[i][j] == rows[i - 1][j]:
            i -= 1
        elif rows[i][j] == rows[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs += (inner[i, j] if (i, j) in inner else (yield x[i], y[j]))[1]
    return score, pairs


def _hashed(root: Node) -> Node:
    return from_skeleton(skeleton(root))


def leaves(root: Node) -> list[Node]:
    return [n for n in _below(root) if n.tag == "#"]


def main_text(page: Node, wrapper: Node | None = None, template: frozenset[int] = frozenset()) -> str:
    """The page's texts in order, without those aligned to a template slot of the wrapper with the same text."""
    own = leaves(page)
    drop = set()
    if wrapper is not None and template:
        shape = _hashed(page)
        slot = {id(n): k for k, n in enumerate(leaves(wrapper))}
        place = {id(n): k for k, n in enumerate(leaves(shape))}
        for p, q in match(wrapper, shape)[1]:
            if p.tag == "#" and slot[id(p)] in template and p.text == q.text:
                drop.add(place[id(q)])
    return "\n\n".join(n.text for k, n in enumerate(own) if k not in drop)


def extract(pages: DataFrame, id_: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text), a row for each row of ``pages``; blocks are joined by an empty line.

    A host's pivot is its page with the smallest hash of id and html among those with text. A null or empty html has an
    empty text. A null url has the empty host, whose pages are treated as of one host. Equal pages have equal texts;
    repeated rows are handled each by itself. Character references are decoded. An empty table gives an empty table.
    """
    own = pages.select(F.col(f"`{id_}`").alias("page_id"), F.col(f"`{url}`").alias("url"), F.coalesce(F.col(f"`{html}`"), F.lit("")).alias("html"))
    own = own.withColumns({"host": host_of(F.coalesce("url", F.lit(""))), "mark": F.xxhash64("page_id", "html")})
    hosts = own.filter("html <> ''").groupBy("host").agg(F.min("mark").alias("mark"), F.count("*").alias("pages"))
    hosts = materialize(hosts.withColumn("salts", F.ceil(F.col("pages") / SALT_PAGES).cast("int")), "hosts")

    def skeletons(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[["host", "salts"]].assign(pivot=[skeleton(parse(h)) for h in batch["html"]])

    first = own.join(hosts.select(F.col("host").alias("h"), F.col("mark").alias("m"), "salts"), (F.col("host") == F.col("h")) & (F.col("mark") == F.col("m")))
    pivots = first.select("host", "salts", "html").mapInPandas(skeletons, "host string, salts int, pivot string")
    pivots = pivots.groupBy("host").agg(F.first("salts").alias("salts"), F.min("pivot").alias("pivot"))
    pivots = materialize(pivots.select(F.col("host").alias("p_host"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("p_salt"), "pivot", "salts"), "pivots")
    # Salts of a row come from its own hash; the pivots stand once for each salt of their host. Both tables are written
    # first: Spark sees their size, and moves the pages only where they are too large to be sent around.
    counted = own.join(hosts.select(F.col("host").alias("h"), F.col("salts").alias("s")), F.col("host") == F.col("h"), "left")
    salted = counted.withColumn("salt", F.pmod(F.col("mark"), F.coalesce("s", F.lit(1)).cast("long")).cast("int")).drop("h", "s")

    def agree(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts: dict[tuple[str, int], list[int]] = {}
            trees: dict[str, tuple[Node, dict[int, int]]] = {}
            for host, pivot, page in zip(batch["host"], batch["pivot"], batch["html"]):
                if host not in trees:
                    tree = from_skeleton(pivot)
                    trees[host] = tree, {id(n): k for k, n in enumerate(leaves(tree))}
                tree, slot = trees[host]
                for p, q in match(tree, _hashed(parse(page)))[1]:
                    if p.tag == "#":
                        c = counts.setdefault((host, slot[id(p)]), [0, 0])
                        c[0] += 1
                        c[1] += p.text == q.text
            yield pd.DataFrame([(h, s, m, e) for (h, s), (m, e) in counts.items()], columns=["host", "slot", "matched", "equal"])

    on = (F.col("host") == F.col("p_host")) & (F.col("salt") == F.col("p_salt"))
    met = salted.filter("html <> ''").join(pivots.drop("salts"), on).select("host", "pivot", "html")
    votes = met.mapInPandas(agree, "host string, slot int, matched long, equal long")
    votes = votes.groupBy("host", "slot").agg(F.sum("matched").alias("matched"), F.sum("equal").alias("equal"))
    fixed = votes.filter((F.col("matched") >= LEAST_PAGES) & (F.col("equal") >= F.col("matched") * CONSTANT_SHARE))
    # As many slots as the pivot has leaves, at most.
    fixed = fixed.groupBy("host").agg(F.collect_set("slot").alias("template")).withColumnRenamed("host", "t_host")
    wrappers = materialize(pivots.join(fixed, F.col("p_host") == F.col("t_host")).select("p_host", "p_salt", "pivot", "template"), "wrappers")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            trees: dict[str, tuple[Node, frozenset[int]]] = {}
            texts = []
            for host, pivot, template, page in zip(batch["host"], batch["pivot"], batch["template"], batch["html"]):
                if pivot is None:
                    texts.append(main_text(parse(page)))
                    continue
                if host not in trees:
                    trees[host] = from_skeleton(pivot), frozenset(int(k) for k in template)
                texts.append(main_text(parse(page), *trees[host]))
            yield batch[["page_id", "url"]].assign(text=texts)

    rows = salted.join(wrappers, on, "left").select("page_id", "url", "host", "html", "pivot", "template")
    kind = pages.schema[id_].dataType.simpleString()
    return rows.mapInPandas(read, f"page_id {kind}, url string, text string")
