"""Main-text extraction with a site style tree.

All pages of a host are merged into one style tree: a node is a chain of styles (tag with its class) from the body down, ``LEVELS``
long at most (what stands deeper belongs to its ancestor there). For each node two importances come from entropies over the
m pages that have it, with logarithms to base m. Presentation: the entropy of the child styles its pages show below it, 0 where
all show the same. Content: one minus the mean entropy of its own texts, where a text on c of m pages has entropy log c / log m;
what all pages repeat is worth 0, what one page alone says is worth 1. The composite importance of a node with k children is
(1 - g**k) times its presentation plus g**k times the mean composite of its children, its own text being one of them; that of
a leaf is its content. A branch whose composites are all below ``LEAST_IMPORTANCE`` is noise and goes whole from each page,
if ``LEAST_PAGES`` pages have it.

Adverts and reader comments say something new on each page, so no entropy tells them from articles. What markup says of
itself is a prior beside the tree: navigation, footers, asides and class names such as ``ad`` go, prose inside a marked
article stays even if the host repeats it. ``prior=False`` leaves both to the tree alone. A page doesn't lose all its text
to the tree.

Pages are parsed once. The parse writes blocks of text by page and, counted inside each task first, the features of nodes; so
a hot host is a few rows a task. The composites are sums over descendants of their own shares times the weights on the
path to them, which are plain aggregates over (host, node), not a walk in one task. The styles to cut are few; their size is
checked before they are broadcast to the blocks, else both meet in a salted join. Only blocks are joined, never html.

Defined results: null or empty html gives empty text; markup that ends too early is read as far as it goes; null url is a
host of its own; repeated rows each give a row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Importance below which a branch goes, pages a node needs for that, weight of children by their number, and levels of a tree.
LEAST_IMPORTANCE, LEAST_PAGES, ATTENUATION, LEVELS = 0.2, 8, 0.9, 64
#: Entries of a task's own count before it is handed on, styles to cut that are broadcast, and tasks for a host beyond that.
HELD, BROADCAST, SALTS = 100_000, 200_000, 64
# Elements by role in HTML, and words in class, id and role attributes that name a branch's purpose.
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg math".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("head form button select datalist object canvas audio video map fieldset".split()) | RAW
ROLES = frozenset("nav aside footer dialog menu".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead tr caption ul".split())
CELLS = frozenset(("td", "th"))
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th figcaption caption article main".split())
NOISE = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar cookie cookies consent gdpr notice alert newsletter subscribe subscription signup share sharing social related recommended comments comment disqus respond reply replies breadcrumb breadcrumbs menu nav navbar navigation footer masthead toolbar popup modal overlay widget pagination pager copyright login search skip contentinfo complementary".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr",), "tbody": ("tr", "thead", "tbody"), "tfoot": ("tr", "tbody")}
SCOPE = frozenset("table td th caption html template object button ul ol dl".split())
HARD = frozenset("table td th button".split())
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>"[^"]*"|'[^']*'|[^>"'])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"']+)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)|([^\s=/"']+)""")
WORDS = re.compile(r"[a-zA-Z]+")
HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")


MAIN, NOISY, PROTECTED = 1, 2, 4


def style_hash(above: int, style: str) -> int:
    return xxhash.xxh64_intdigest(style, above & 0xFFFFFFFF) ^ (above * 31 & 0xFFFFFFFFFFFFFFFF)


class Node:
    """An open or closed element: what holds for all below it is passed on, so nothing walks the stack."""

    __slots__ = ("tag", "above", "level", "style", "noise", "main", "block", "marks", "hard", "scope", "shape", "textless")

    def __init__(self, tag: str, above: Node | None, style: int, noise: bool, main: bool, at: int):
        self.tag, self.above, self.style, self.noise, self.main = tag, above, style, noise, main
        self.level = 0 if above is None else min(LEVELS, above.level + 1)
        self.block = self if above is None or tag in BLOCKS or tag in CELLS else above.block
        #: Places on the stack of the nearest element, this one included, that is a block or noise, and of the nearest scopes.
        self.marks = at if noise or tag in BLOCKS else -1 if above is None else above.marks
        self.hard = at if tag in HARD else -1 if above is None else above.hard
        self.scope = at if tag in SCOPE else -1 if above is None else above.scope
        self.shape: dict[int, None] = {}
        self.textless = above is not None and above.textless or tag in DROPPED

    def chain(self) -> list[int]:
        """Styles of all ancestors, the root first."""
        out, node = [], self.above
        while node is not None:
            if node.level < self.level:
                out.append(node.style)
            node = node.above
        return list(dict.fromkeys(reversed(out)))


def attributes(raw: str) -> dict[str, str]:
    found = {}
    for name, value, alone in ATTRIBUTE.findall(raw):
        found.setdefault((name or alone).lower(), entities.unescape(value.strip("\"'")) if value else "")
    return found


def open_node(tag: str, raw: str, above: Node, at: int, prior: bool) -> Node:
    """A node below another; what its markup says of its purpose goes down to all below it."""
    noise, main, name = above.noise, above.main, ""
    if raw and not raw.isspace():
        found = attributes(raw)
        name = found.get("class", "")
        noise = noise or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
        if prior:
            words = {w.lower() for w in WORDS.findall(" ".join((name, found.get("id", ""), found.get("role", ""))))}
            noise = noise or not words.isdisjoint(NOISE) and tag not in ("body", "html", "article", "main") or tag == "article" and not words.isdisjoint(("comment", "comments", "reply"))
            main = main or found.get("role", "").lower() == "main" or found.get("itemprop", "").lower() == "articlebody"
    if prior:
        main = main or tag in ("article", "main")
        noise = noise or tag in ROLES or tag == "header" and not main
    style = style_hash(above.style, f"{tag}.{name}") if above.level < LEVELS else above.style
    return Node(tag, above, style, noise or tag in DROPPED, main, at)


def read_page(source: str, prior: bool = True) -> tuple[list[tuple[str, Node, bool, bool]], list[Node]]:
    """Blocks in page order (text, their node, noise, main) and all nodes, in time that follows the page's length."""
    root = Node("", None, 0, False, False, 0)
    nodes, stack, inline = [root], [root], []
    places: dict[str, list[int]] = {}  # of the open elements, by tag
    blocks: list[tuple[str, Node, bool, bool]] = []

    def flush() -> None:
        if inline:
            text = " ".join(entities.unescape("".join(inline)).split())
            if text:
                top = stack[-1]
                blocks.append((text, top.block, top.noise, top.main))
            inline.clear()

    def drop(depth: int) -> None:
        for node in stack[depth:]:
            places[node.tag].pop()
        del stack[depth:]

    def pop_to(depth: int) -> None:
        flush()
        drop(depth)

    def close(tags: tuple[str, ...]) -> None:
        """End the innermost of these elements, if no scope stands between."""
        depth = max((places[t][-1] for t in tags if places.get(t)), default=0)
        if depth and depth >= (stack[-1].hard if tags == ("p",) else stack[-1].scope):
            if tags == ("td", "th"):  # cells of a row are one block
                drop(depth)
            else:
                pop_to(depth)

    at = 0
    while True:
        found = TOKEN.search(source, at)
        if not found:
            inline.append(source[at:])
            break
        if found.start() > at:
            inline.append(source[at : found.start()])
        at = found.end()
        tag = found[2] or found[5]
        if not tag:
            continue
        tag, raw = tag.lower(), found[3] or found[6] or ""
        if found[1] or found[4]:  # an end tag
            if tag == "br":
                inline.append(" ")
            elif places.get(tag):
                depth = places[tag][-1]
                if tag in BLOCKS or stack[-1].marks >= depth:
                    pop_to(depth)
                else:
                    if tag in CELLS:
                        inline.append(" ")
                    drop(depth)
            continue
        if tag in BLOCKS:
            flush()
            if tag not in ("body", "html"):
                close(("p",))
        if tag in CLOSES:
            close(CLOSES[tag])
        if tag in VOID:
            inline.append(" " if tag in ("br", "hr") else "")
            continue
        if tag in ("body", "html") and places.get(tag):
            continue
        if tag == "body" and len(stack) > 1:  # what is open before the body, such as an unclosed head, ends here
            pop_to(2 if stack[1].tag == "html" else 1)
        above = stack[-1]
        node = open_node(tag, raw, above, len(stack), prior)
        if tag in CELLS:
            inline.append(" ")
        if tag in RAW:
            if not raw.endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(source, at)
                at = end.end() if end else len(source)
            continue
        if node.noise and not above.noise:
            flush()
        if node.style != above.style:
            above.shape[node.style] = None
        places.setdefault(tag, []).append(len(stack))
        stack.append(node)
        nodes.append(node)
        if tag == "p" and raw.endswith("/"):
            pop_to(len(stack) - 1)
    flush()
    return blocks, nodes


def host_of(url: str | None) -> str:
    found = HOST.match(url or "")
    return found[1].lower() if found else ""


def page_features(blocks: list[tuple[str, Node, bool, bool]], nodes: list[Node]) -> tuple[set[tuple[int, bool, int]], dict[int, Node]]:
    """(style, whether it is a text, feature) of a page, each once, and a node of each style. A node's shape is that of all its
    places on the page together; what can't hold text, such as the head, takes no part."""
    named: dict[int, Node] = {}
    shapes: dict[int, dict[int, None]] = {}
    for node in nodes:
        if not node.textless:
            named.setdefault(node.style, node)
            shapes.setdefault(node.style, {}).update(node.shape)
    seen = {(style, False, xxhash.xxh64_intdigest(",".join(f"{c:x}" for c in shape if c in named))) for style, shape in shapes.items()}
    seen |= {(node.style, True, xxhash.xxh64_intdigest(text)) for text, node, _, _ in blocks if node.style in named}
    return seen, named


def parsed(pages: DataFrame, prior: bool = True) -> DataFrame:
    """Rows of two kinds from one reading of (page_id, url, html). A page: page_id, url, host, blocks (text, style, flags). A count:
    host, style, chain (styles above), leaf, feature, n pages of the host that show the feature at the node, counted by task."""
    kind = pages.schema[0].dataType.simpleString()
    schema = f"page_id {kind}, url string, host string, blocks array<struct<text: string, style: bigint, flags: int>>, style bigint, chain array<bigint>, leaf boolean, feature bigint, n bigint"
    names = ["page_id", "url", "host", "blocks", "style", "chain", "leaf", "feature", "n"]
    block = pa.struct([("text", pa.string()), ("style", pa.int64()), ("flags", pa.int32())])
    signed = lambda values: np.array(values, np.uint64).view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        chains: dict[int, list[int]] = {}

        def flush(kind: pa.DataType) -> pa.RecordBatch:
            rows, n = list(held), len(held)
            columns = [pa.nulls(n, kind), pa.nulls(n, pa.string()), pa.array([r[0] for r in rows], pa.string()), pa.nulls(n, pa.list_(block)), pa.array(signed([r[1] for r in rows])), pa.array([signed(chains[r[1]]) for r in rows], pa.list_(pa.int64())), pa.array([r[2] for r in rows], pa.bool_()), pa.array(signed([r[3] for r in rows])), pa.array(list(held.values()), pa.int64())]
            held.clear()
            chains.clear()
            return pa.RecordBatch.from_arrays(columns, names=names)

        of = pa.null()
        for batch in batches:
            of = batch.column(0).type
            for a in range(0, batch.num_rows, 200):
                part = batch.slice(a, 200)
                hosts, found = [], []
                for url, source in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    blocks, nodes = read_page(source or "", prior)
                    features, named = page_features(blocks, nodes)
                    hosts.append(host_of(url))
                    held.update((hosts[-1], *f) for f in features)
                    for style, node in named.items():
                        if style not in chains:
                            chains[style] = [s for s in node.chain() if s in named]
                    found.append([{"text": t, "style": int(signed([n.style])[0]), "flags": MAIN * main + NOISY * noise + PROTECTED * (main and n.tag in PROSE)} for t, n, noise, main in blocks if not n.textless])
                n = part.num_rows
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(hosts, pa.string()), pa.array(found, pa.list_(block)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.bool_()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], names=names)
                if len(held) > HELD:
                    yield flush(of)
        if held:
            yield flush(of)

    return common.arrow(pages, run, schema)


def style_tree(counts: DataFrame) -> DataFrame:
    """host, style, chain, m (pages that have the node), presentation, content (null without text of its own), composite and top
    (the largest composite of the branch) of each node of the style trees that has text in its branch."""
    n, logs = F.col("n"), F.col("n") * F.log("n")
    counts = counts.groupBy("host", "style", "leaf", "feature").agg(F.sum("n").alias("n"), F.first("chain").alias("chain"))
    of = lambda leaf, x: F.sum(F.when(F.col("leaf") == leaf, x))
    nodes = counts.groupBy("host", "style").agg(F.first("chain").alias("chain"), of(False, n).alias("m"), of(False, logs).alias("shape_logs"), of(True, n).alias("texts"), of(True, logs).alias("text_logs"))
    share = lambda x: F.when(F.col("m") > 1, F.greatest(F.lit(0.0), x)).otherwise(1.0)
    nodes = nodes.select("host", "style", "chain", "m", share(1 - F.col("shape_logs") / F.col("m") / F.log("m")).alias("presentation"), F.when(F.col("texts") > 0, share(1 - F.col("text_logs") / F.col("texts") / F.log("m"))).alias("content"))
    nodes = common.written(nodes, "style-nodes")
    line = F.concat("chain", F.array("style"))
    live = nodes.where("content is not null").select("host", F.explode(line).alias("style")).distinct()
    nodes = nodes.join(live, ["host", "style"])
    below = nodes.where(F.size("chain") > 0).groupBy("host", F.element_at("chain", -1).alias("style")).agg(F.count("*").alias("inner"))
    nodes = nodes.join(below, ["host", "style"], "left").withColumn("inner", F.coalesce("inner", F.lit(0)))
    k = F.col("inner") + F.when(F.col("content").isNotNull(), 1).otherwise(0)
    nodes = nodes.withColumns({"weight": k * F.log(F.lit(ATTENUATION)) - F.log(k), "k": k})
    own = F.when(F.col("inner") == 0, F.col("content")).otherwise((1 - F.pow(F.lit(ATTENUATION), "k")) * F.col("presentation") + F.coalesce(F.exp("weight") * F.col("content"), F.lit(0.0)))
    nodes = common.written(nodes.withColumn("own", own), "style-nodes")
    weights = nodes.select("host", F.col("style").alias("over"), "weight")
    path = nodes.select("host", "style", F.explode("chain").alias("over")).join(weights, ["host", "over"]).groupBy("host", "style").agg(F.sum("weight").alias("path"))
    nodes = common.written(nodes.join(path, ["host", "style"], "left").withColumn("path", F.coalesce("path", F.lit(0.0))), "style-nodes")
    start = nodes.select("host", F.col("style").alias("over"), F.col("path").alias("start"))
    composite = nodes.select("host", "own", "path", F.explode(line).alias("over")).join(start, ["host", "over"]).groupBy("host", F.col("over").alias("style")).agg(F.sum(F.col("own") * F.exp(F.col("path") - F.col("start"))).alias("composite"))
    nodes = nodes.join(composite, ["host", "style"])
    top = nodes.select("host", "composite", F.explode(line).alias("over")).groupBy("host", F.col("over").alias("style")).agg(F.max("composite").alias("top"))
    return nodes.join(top, ["host", "style"]).select("host", "style", "chain", "m", "presentation", "content", "composite", "top")


def branches_to_cut(counts: DataFrame, least: float = LEAST_IMPORTANCE, pages: int = LEAST_PAGES) -> DataFrame:
    """host, cut: styles of the branches of each host that are noise."""
    low = style_tree(counts).where((F.col("m") >= pages) & (F.col("top") < least))
    return low.groupBy("host").agg(F.sort_array(F.collect_set("style")).alias("cut"))


def main_text(source: str, cut: frozenset[int] = frozenset(), prior: bool = True) -> str:
    """The blocks of one page that stay, in page order, joined by an empty line; cut are styles."""
    blocks = [b for b in read_page(source, prior)[0] if not b[2]]
    kept = [b for b in blocks if not (b[1].style in cut and not (b[3] and b[1].tag in PROSE))]
    return "\n\n".join(t for t, *_ in [b for b in kept if b[3]] or kept or blocks)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", prior: bool = True) -> DataFrame:
    """page_id, url, text, n_chars, and how many blocks the tree (n_cut) and the prior alone (n_prior) took, of each row of pages."""
    common.tune(pages.sparkSession)
    pages = common.only(pages, id_col, url_col, html_col).toDF("page_id", "url", "html")
    read = common.written(parsed(pages, prior), "parsed")
    cut = common.written(branches_to_cut(read.where("n is not null").select("host", "style", "chain", "leaf", "feature", "n")), "cut")
    rows = read.where("blocks is not null").select("page_id", "url", "host", "blocks")
    size = cut.agg(F.sum(F.size("cut"))).first()[0] or 0
    if size <= BROADCAST:
        rows = rows.join(F.broadcast(cut), "host", "left")
    else:  # each host's row is repeated for each salt, so a hot host's pages go to many tasks
        cut = cut.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(cut, ["host", "salt"], "left")
    flag = lambda x, bit: x.flags.bitwiseAND(F.lit(bit)) != 0
    rows = rows.withColumn("cut", F.coalesce("cut", F.array().cast("array<bigint>")))
    low = lambda x: F.array_contains("cut", x.style) & ~flag(x, PROTECTED)
    rows = rows.withColumns({"said": F.filter("blocks", lambda x: ~flag(x, NOISY)), "n_cut": F.size(F.filter("blocks", low)), "n_prior": F.size(F.filter("blocks", lambda x: flag(x, NOISY) & ~low(x)))})
    rows = rows.withColumn("kept", F.filter("said", lambda x: ~low(x)))
    rows = rows.withColumn("main", F.filter("kept", lambda x: flag(x, MAIN)))
    chosen = F.when(F.size("main") > 0, F.col("main")).when(F.size("kept") > 0, F.col("kept")).otherwise(F.col("said"))
    text = rows.select("page_id", "url", F.array_join(F.transform(chosen, lambda x: x.text), "\n\n").alias("text"), "n_cut", "n_prior")
    return text.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"), "n_cut", "n_prior")
