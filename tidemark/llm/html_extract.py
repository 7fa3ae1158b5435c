"""Main text of web pages by wrapper induction.

Pages of one host share a template. Every page is parsed into a tree in which runs of equal siblings are one node. Texts that most of a host's
pages have at the same node are template, the others are slots. Pages of equal trees are added up, and the different trees of a host are
aligned by simple tree matching, in rounds, until one is left; it has the slots' text of all pages at its nodes. The lowest node that holds all
the slots' text outside menus, headers, footers and the like is where the host keeps its content. This wrapper
is then applied to every page of the host.
"""

from __future__ import annotations

import html
import json
import re

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.url_filter import url_parts
from tidemark.session import staged

#: trees of a host that are aligned in one place
FAN = 32
#: share of the different pages with a node from which a text in it is template
SHARED = 0.8
#: share of the text from which a marked node is content
HALF = 0.5
#: distinct pages that must share a text before it counts as template
AGREE = 3
#: tree nodes deeper than this are hung up here; the walk over a page itself has no limit
DEPTH = 64

# fixed values: kinds of HTML elements
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe svg math object xmp noframes".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span strike strong sub sup "
             "time tt u var wbr".split())
CLOSES_P = set("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
DROP = set("nav aside footer form button select option dialog menu input".split()) | RAW
MARKS = set("ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header masthead menu modal "
            "nav navbar navigation newsletter notice popup promo promoted related share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split())
#: elements without text of their own
INVISIBLE = set("button select option input".split()) | RAW
#: elements that no amount of text makes content
STRONG = set("nav aside footer menu dialog".split())
NEGATED = set("no not with without has hide hidden".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

_TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z))""", re.S)
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


def _label(tag: str, attrs: str) -> tuple[str, bool]:
    """A node's label (tag with its classes, numbers aside; "!" at the end if the element says that it is no content) and whether it is left out anyway."""
    drop, names = tag in DROP, []
    for key, a, b, c in _ATTR.findall(attrs) if attrs else ():
        value = (a or b or c).lower()
        if key.lower() == "role":
            drop |= value in ROLES
        else:
            drop |= any(not NEGATED & set(parts) and any(t in MARKS for t in parts) for parts in (re.split(r"[^a-z]+", c) for c in value.split()))
            names.append(re.sub(r"\d+", "", value).strip())
    if tag in ("html", "body", "article", "main"):
        drop = False
    label = tag + "." + " ".join(names) if names else tag
    return (label + "!" if drop else label), drop and (tag in INVISIBLE or tag in INLINE)


def _tag(label: str) -> str:
    return label.split(".")[0].rstrip("!")


def closed(path: tuple[str, ...], opened) -> bool:
    """Does the path lead through a marked node that is not among the paths ``opened``?"""
    return any(x.endswith("!") and path[:k] not in opened for k, x in enumerate(path, 1))


def walk(source: str):
    """Pieces of a page in order: (path of labels, is it dropped by its elements, text or None at the edge of a block)."""
    stack: list[tuple[str, str, bool]] = []  # tag, label, dropped
    path: tuple[str, ...] = ()
    at, end = 0, len(source)

    def inside() -> bool:
        return bool(stack) and stack[-1][2]

    while at < end:
        m = _TAG.search(source, at)
        text = source[at:m.start() if m else end]
        if text:
            yield path, inside(), html.unescape(text)
        if not m:
            break
        at = m.end()
        closing, tag, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if tag == "br":
            yield path, inside(), " "
            continue
        if tag not in INLINE:
            yield path, inside(), None
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    path = path[:k]
                    break
        else:
            shut = {"p"} if tag in CLOSES_P else SAME.get(tag, ())
            if shut:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in shut:
                        del stack[k:]
                        path = path[:k]
                        break
                    if stack[k][0] not in INLINE:
                        break
            if tag in VOID or attrs.rstrip().endswith("/") and tag not in RAW and tag not in ("p", "div", "article"):
                continue
            label, drop = _label(tag, attrs)
            if tag == "header" and not label.endswith("!") and not any(t in ("article", "main") for t, _, _ in stack):
                label += "!"
            stack.append((tag, label, drop or inside()))
            path = (*path, label)
            if tag in RAW:
                close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
                at = close.start() if close else end
    yield path, inside(), None


def blocks(source: str | None):
    """Blocks of a page: (path, dropped, text with white space as single spaces)."""
    parts: list[str] = []
    where: tuple[tuple[str, ...], bool] = ((), False)
    for path, drop, text in walk(source or ""):
        if text is None:
            if parts:
                joined = " ".join("".join(parts).split())
                if joined:
                    yield *where, joined
                parts = []
        elif not drop:
            if not parts:
                where = tuple(p for p in path if _tag(p) not in INLINE), drop
            parts.append(text)


class Node:
    """A template node: children in order, for every page that has it the texts that stand directly in it, and the length of slots' text
    that was counted elsewhere."""

    def __init__(self, label: str, own: int = 0):
        self.label, self.own, self.children, self.texts = label, own, [], {}


def tree(page: int, found: list[tuple[tuple[str, ...], str]]) -> tuple[Node, list[int]]:
    """Tree of a page's blocks, neighbouring siblings with one label as one node, and every block's node by its place in preorder."""
    root, places = Node(""), []
    root.place, size = 0, 1
    for path, text in found:
        node = root
        for label in path[:DEPTH]:
            if not node.children or node.children[-1].label != label:
                node.children.append(Node(label))
                node.children[-1].place, size = size, size + 1
            node = node.children[-1]
        node.texts.setdefault(page, []).append(text)
        places.append(node.place)
    return root, places


def packed(node: Node) -> list:
    """A tree as nested lists of label, length of slots' text and children."""
    return [node.label, node.own, [packed(c) for c in node.children]]


def unpacked(rows: list) -> Node:
    node = Node(rows[0], rows[1])
    node.children = [unpacked(c) for c in rows[2]]
    return node


def matching(a: Node, b: Node) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching: the greatest number of matched nodes with order kept, and the matched children."""
    if a.label != b.label:
        return 0, []
    m, n = len(a.children), len(b.children)
    best = [[0] * (n + 1) for _ in range(m + 1)]
    gain = {}
    for i in range(1, m + 1):
        for j in range(1, n + 1):
            gain[i, j] = matching(a.children[i - 1], b.children[j - 1])[0]
            best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + gain[i, j])
    pairs, i, j = [], m, n
    while i and j:
        if gain[i, j] and best[i][j] == best[i - 1][j - 1] + gain[i, j]:
            pairs.append((i - 1, j - 1))
            i, j = i - 1, j - 1
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return 1 + best[m][n], pairs[::-1]


def merge(a: Node, b: Node) -> None:
    """Lay a page's tree over the template: matched nodes join, others are inserted in their order."""
    a.own += b.own
    for page, texts in b.texts.items():
        a.texts.setdefault(page, []).extend(texts)
    _, pairs = matching(a, b)
    out, done_a, done_b = [], 0, 0
    for i, j in [*pairs, (len(a.children), len(b.children))]:
        out += a.children[done_a:i] + b.children[done_b:j]
        if i < len(a.children):
            merge(a.children[i], b.children[j])
            out.append(a.children[i])
        done_a, done_b = i + 1, j + 1
    a.children = out


def _chosen(template: Node) -> tuple[list, list, int]:
    """Path of the content node, paths of the opened marked nodes, and the length of all slots' text, from the nodes' ``own``."""
    def weigh(node: Node) -> int:
        node.weight = node.own + sum(map(weigh, node.children))
        return node.weight

    total = weigh(template)
    opened = set()

    def clean(node: Node, path: tuple[str, ...]) -> int:
        """The slots' text outside marked nodes; a marked node that holds half of all slots' text is content."""
        if node.label.endswith("!"):
            if node.weight < HALF * total or _tag(node.label) in STRONG:
                node.clean = 0
                return 0
            opened.add(path)
        node.clean = node.own + sum(clean(c, (*path, c.label)) for c in node.children)
        return node.clean

    rest = clean(template, ())
    node, path = template, ()
    while node.children and _tag(node.label) not in ("article", "main"):
        top = max(node.children, key=lambda c: getattr(c, "clean", 0))
        if getattr(top, "clean", 0) < rest or _tag(top.label) not in ("html", "body", "article", "main", "section", "div", "td", "tr", "table", "tbody"):
            break
        node, path = top, (*path, top.label)
    return list(path), ["\n".join(p) for p in sorted(opened)], total


def induce(pages: list[str | None]) -> dict | None:
    """The wrapper of a few pages: path of their content node and the template texts below it; None if the pages don't show one."""
    seen, template = [], Node("")
    for source in pages:
        found = [(path, text) for path, _, text in blocks(source)]
        if found and found not in seen:
            merge(template, tree(len(seen), found)[0])
            seen.append(found)
    if len(seen) < 2:
        return None
    fixed: dict[str, list[str]] = {}

    def count(node: Node, path: tuple[str, ...]) -> None:
        sets = [set(t) for t in node.texts.values()]
        same = set.intersection(*sets) if len(sets) == len(seen) >= AGREE else set()
        if same:
            fixed["\n".join(path)] = sorted(same)
        node.own = sum(len(t) for texts in node.texts.values() for t in texts if t not in same)
        for c in node.children:
            count(c, (*path, c.label))

    count(template, ())
    root, opened, total = _chosen(template)
    return {"root": root, "fixed": fixed, "open": opened} if total else None


def block_digest(path: tuple[str, ...], text: str) -> int:
    return xxhash.xxh64_intdigest("\n".join((*path[:DEPTH], "", text)).encode("utf-8", "surrogatepass")) - (1 << 63)


def big_nodes(found: list[tuple[tuple[str, ...], str]]) -> set[tuple[str, ...]]:
    """Marked nodes that hold half of a single page's text."""
    weight: dict[tuple[str, ...], int] = {}
    for path, text in found:
        for k, x in enumerate(path, 1):
            if x.endswith("!") and _tag(x) not in STRONG:
                weight[path[:k]] = weight.get(path[:k], 0) + len(text)
    total = sum(len(t) for _, t in found)
    return {p for p, w in weight.items() if w >= HALF * total}


def extract(source: str | None, wrapper: dict | None) -> str:
    """Main text: with a wrapper all blocks that are no template, also beside the host's content node, where single pages have more; a page
    without a wrapper gives the blocks of its article or main element, or else all blocks that no element marks as something else."""
    found = [(path, text) for path, _, text in blocks(source)]
    if wrapper:
        opened = {tuple(p.split("\n")) for p in wrapper["open"]}
        fixed = {tuple(p.split("\n")) if p else (): set(t) for p, t in wrapper["fixed"].items()}
        shared = wrapper.get("digests", ())
        return " ".join(t for p, t in found if not closed(p, opened) and t not in fixed.get(p[:DEPTH], ()) and not (shared and block_digest(p, t) in shared))
    opened = big_nodes(found)
    found = [(p, t) for p, t in found if not closed(p, opened)]
    main = [t for p, t in found if any(_tag(x) in ("article", "main") for x in p)]
    return " ".join(main or [t for _, t in found])


def _page_rows(batches):
    """For every page with blocks: host, page, the page's longest unmarked block as ``lead``, its tree, and of each block its node, path, path with
    text, and length."""
    for b in batches:
        for start in range(0, b.num_rows, 256):
            out: tuple[list, ...] = ([], [], [], [], [])
            for host, digest, source in zip(*(b.slice(start, 256).column(k).to_pylist() for k in range(3))):
                found = [(p, t) for p, _, t in blocks(source)]
                if not found:
                    continue
                opened = big_nodes(found)
                lead = block_digest((), max((t for p, t in found if not closed(p, opened)), key=lambda t: (len(t), t), default=""))
                shape, places = tree(0, found)
                known: dict[tuple[str, ...], int] = {}
                rows = []
                for place, (p, t) in zip(places, found):
                    if p not in known:
                        known[p] = block_digest(p, "")
                    rows.append({"node": place, "path": known[p], "both": block_digest(p, t), "n": len(t)})
                for column, v in zip(out, (host, digest, lead, json.dumps(packed(shape), separators=(",", ":")), rows)):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.string(), pa.int64(), pa.int64(), pa.string(), _BLOCKS))],
                                             names=["host", "digest", "lead", "tree", "blocks"])


_BLOCKS = pa.list_(pa.struct([("node", pa.int32()), ("path", pa.int64()), ("both", pa.int64()), ("n", pa.int64())]))


def _filled(group: pd.DataFrame) -> pd.DataFrame:
    """Trees with their slots' text, from trees and the lengths at some of their nodes by place in preorder."""
    out = []
    for text, slots in zip(group["tree"], group["slots"]):
        top, own = unpacked(json.loads(text)), {s["node"]: s["n"] for s in slots}
        nodes, place = [top], 0
        while nodes:
            node = nodes.pop()
            node.own, place = int(own.get(place, 0)), place + 1
            nodes += node.children[::-1]
        out.append(json.dumps(packed(top), separators=(",", ":")))
    return pd.DataFrame({"host": group["host"], "tree": out})


def _aligned(group: pd.DataFrame) -> pd.DataFrame:
    template = Node("")
    for text in sorted(group["tree"]):
        merge(template, unpacked(json.loads(text)))
    return pd.DataFrame({"host": [group["host"].iloc[0]], "tree": [json.dumps(packed(template), separators=(",", ":"))]})


def _wrapper(group: pd.DataFrame) -> pd.DataFrame:
    out = []
    for text, digests in zip(group["tree"], group["digests"]):
        root, opened, total = _chosen(unpacked(json.loads(text)))
        out.append(json.dumps({"root": root, "fixed": {}, "open": opened, "digests": [] if digests is None else sorted(int(x) for x in digests)}) if total else None)
    return pd.DataFrame({"host": group["host"], "wrapper": out})


def templates(trees: DataFrame) -> DataFrame:
    """One tree per host from all its different ones (host, tree): in a round, about ``FAN`` of them are aligned to one."""
    while True:
        sizes = trees.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
        if (sizes.agg(F.max("n")).first()[0] or 1) == 1:
            return trees
        placed = trees.join(sizes, "host").withColumn("part", F.pmod(F.xxhash64("tree"), F.ceil(F.col("n") / FAN)))
        trees = staged(placed.groupBy("host", "part").applyInPandas(_aligned, "host string, tree string"))


def _extract(batches):
    known: dict[str, dict] = {}
    for b in batches:
        names = b.schema.names
        keep = [k for k, n in enumerate(names) if n not in ("html", "wrapper")]
        for start in range(0, b.num_rows, 256):  # bounds what is held as Python objects
            s = b.slice(start, 256)
            texts = []
            for source, w in zip(s.column(names.index("html")).to_pylist(), s.column(names.index("wrapper")).to_pylist()):
                if w is not None and w not in known:
                    if len(known) >= 1000:
                        known.clear()
                    known[w] = json.loads(w)
                    known[w]["digests"] = frozenset(known[w]["digests"])
                texts.append(extract(source, known[w] if w is not None else None))
            yield pa.RecordBatch.from_arrays([s.column(k) for k in keep] + [pa.array(texts, pa.string())], names=[names[k] for k in keep] + ["text"])


def wrappers(pages: DataFrame) -> DataFrame:
    """One wrapper (JSON; NULL where none is seen) per host with two different pages.

    Template texts are counted over all pages of the host: of the different pages that have a node, ``SHARED`` have the text there. Pages with
    the same longest block are equal or revised copies of one article and count once. All different pages' slots show which
    marked nodes hold content: their lengths are added up over pages of one tree, and all different trees are aligned.
    """
    rows = pages.select(url_parts(F.col("url"))[0].alias("host"), F.xxhash64("html").alias("digest"), "html").where("host <> '' and html is not null")
    seen = staged(rows.mapInArrow(_page_rows, "host string, digest bigint, lead bigint, tree string, blocks array<struct<node: int, path: bigint, both: bigint, n: bigint>>"))
    found = seen.select("host", "lead", F.explode(F.array_distinct(F.transform("blocks", lambda x: F.struct(x["path"].alias("path"), x["both"].alias("both"))))).alias("b")).select("host", "lead", "b.*")
    texts = found.groupBy("host", "path", "both").agg(F.countDistinct("lead").alias("n")).where(F.col("n") >= AGREE)
    nodes = found.groupBy("host", "path").agg(F.countDistinct("lead").alias("n_node"))
    fixed = staged(texts.join(nodes, ["host", "path"]).where(F.col("n") >= F.col("n_node") * SHARED).select("host", "both"))
    hosts = seen.groupBy("host").agg(F.countDistinct("lead").alias("n")).where("n > 1").select("host")
    shape = F.xxhash64("tree").alias("shape")
    each = seen.join(hosts, "host", "left_semi").groupBy("host", "digest").agg(F.first(F.col("blocks")).alias("blocks"), F.first(shape).alias("shape"))
    slots = (each.select("host", "shape", F.explode("blocks").alias("b")).select("host", "shape", "b.node", "b.both", "b.n").join(fixed, ["host", "both"], "left_anti")
             .groupBy("host", "shape", "node").agg(F.sum("n").alias("n")).groupBy("host", "shape").agg(F.collect_list(F.struct("node", "n")).alias("slots")))
    kinds = seen.select("host", shape, "tree").dropDuplicates(["host", "shape"])
    trees = staged(kinds.join(slots, ["host", "shape"]).select("host", "tree", "slots").mapInPandas(lambda it: map(_filled, it), "host string, tree string"))
    digests = fixed.groupBy("host").agg(F.collect_set("both").alias("digests"))
    return staged(templates(trees).join(digests, "host", "left").mapInPandas(lambda it: map(_wrapper, it), "host string, wrapper string"))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url and the main ``text`` of every page, by the wrapper of its host.

    NULL and empty pages give an empty text; pages without a host, and hosts of fewer than two different pages, are read without a
    wrapper. Character references are decoded, white space in a block is one space, blocks are joined by one space. Repeated rows each
    come out. Other columns are not read.
    """
    found = wrappers(pages)
    rows = pages.select("page_id", "url", "html", url_parts(F.col("url"))[0].alias("host")).join(found, "host", "left").select("page_id", "url", "html", "wrapper")
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema if f.name in ("page_id", "url"))
    return rows.mapInArrow(_extract, schema + "text string")
