"""Main text of web pages by a site style tree.

The pages of one host are merged into a tree of style nodes: a node is the chain of tags, classes and ids
from the root (``html`` and ``body`` are the root).  Over the pages that have it, a node has presentation importance,
the entropy of the child sequences it shows, and content importance, one less the mean entropy of the spread of its
text blocks over pages: a block that all pages repeat counts 0, one that a single page has counts 1.  Both are to
the base of the number of pages; pages of one host with equal markup are one page.

A branch is removed from every page, inside and outside ``article`` or ``main``, if its importance is low: relative to
that of the whole site (so a site of copies loses nothing), and after mixing with ``PRIOR_PAGES`` imagined pages that
show it as important, ``REGION_PAGES`` inside a region.  Thus a branch that all pages repeat goes from five pages on,
in a region from 19 on; few pages are weak evidence.  Named noise has prior importance 0, which no statistics lift: nodes
whose tag, role, class or id says navigation, header, footer, sidebar, notice, advert, form, script, style or reader
comment (their links and texts often differ on every page, as an article's do).  It is not counted in the tree.

Of what is left, the regions make the text if they hold at least a tenth of its characters (a teaser alone is no main text); else all of it is the text.

The tree is never gathered: pages emit hashed (site, node, feature, page) rows, which are made distinct and counted
twice with map-side combining (by feature, then by node).  Only nodes of low importance come back, as one short list
for each host; they are joined on host and a salt, so a host with a third of all pages is spread.

Text: character references are decoded, white space inside a block becomes one blank, blocks are trimmed
and joined by one blank in page order; nothing is cut off.  Unclosed and stray tags follow the usual
recovery rules; a tag that the page's end cuts off is dropped.  Elements deeper than ``MAX_DEPTH`` count for
the style node at that depth, but open, close and say noise or main like any other.

Defined results: null or empty pages give empty text; a null address is a host of its own with the empty
name; repeated rows come back each; an empty table gives an empty result; only id, address and page are read.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import BROADCAST_ROWS, materialize, values
from tallyloom.llm.urlfilter import split_url

LOW_IMPORTANCE = 0.3
CONTENT_WEIGHT = 0.9
PRIOR_PAGES = 2
REGION_PAGES = 8
SALTS = 32
MAX_DEPTH = 256

# Names of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span"
    " strike strong sub sup time tt u var wbr".split()
)
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4"
    " h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split()
)
NOISE_TAGS = frozenset(
    "head script style noscript template iframe object embed applet svg canvas audio video form button select"
    " textarea input nav aside footer menu dialog title".split()
)
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adsbygoogle banner sponsor sponsored promo promotion nav"
    " navbar navigation menu breadcrumb breadcrumbs sidebar aside footer header masthead cookie cookies consent notice"
    " notices gdpr popup modal overlay newsletter subscribe subscription signup login share sharing social related"
    " recommended comment comments commentlist disqus replies respond reviews widget toolbar pagination pager copyright"
    " disclaimer alert search".split()
)
MAIN_WORDS = frozenset("article post entry content main story body text".split())
REGIONS = frozenset(("article", "main"))
ROOTS = frozenset(("html", "body"))

# Elements that a start tag closes implicitly, up to the nearest of the barriers.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
_NAME = r"<(/?)([a-zA-Z][^\s/>]*)"
# a tag with its quoted values, else (an unpaired quote) one that ends at the next bracket
_MARKUP = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*>|{_NAME}((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|{_NAME}([^>]*)>", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_CUT_TAG = re.compile(r"<[a-zA-Z/!?][^>]*\Z")
_SPLIT = re.compile(r"[^a-z]+")


def _hash(*parts) -> int:
    h = xxhash.xxh64_intdigest("\x00".join(map(str, parts)).encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


class _Node:
    __slots__ = ("children", "main", "named_noise", "path", "tag")

    def __init__(self, tag: str, path: int, named_noise: bool, main: bool, children: list[str] | None = None):
        self.tag, self.path, self.named_noise, self.main = tag, path, named_noise, main
        self.children = [] if children is None else children


def _style(tag: str, attributes: str) -> tuple[str, list[frozenset[str]], str]:
    """Tag with classes and id (digits generalised), the words of each of those names, and the role."""
    if "=" not in attributes:
        return tag, [], ""
    names, role = [], ""
    for key, a, b, c in _ATTRIBUTE.findall(attributes):
        value = html.unescape(a or b or c).lower()
        if key.lower() == "role":
            role = value.strip()
        else:
            names += value.split()
    words = [frozenset(w for w in _SPLIT.split(n) if w) for n in names]
    return " ".join([tag, *sorted(re.sub(r"\d+", "0", n) for n in names)]), words, role


def _is_noise(tag: str, names: list[frozenset[str]], role: str, inside: bool) -> bool:
    """Whether tag, role or names say that a branch is no main text.

    A name such as ``entry-content`` outweighs others on its element, and ``post-header`` holds the title.
    """
    if tag in NOISE_TAGS or role in NOISE_ROLES or (tag == "header" and not inside):
        return True
    if tag in ROOTS or tag in REGIONS or any(n and n <= MAIN_WORDS for n in names):
        return False
    return any(n & NOISE_WORDS and not ("header" in n and n & MAIN_WORDS) for n in names)


def walk(page: str) -> Iterator[tuple[str, list[_Node], str]]:
    """Events ``("text", open nodes, text)``, ``("open", open nodes, "")`` and ``("break", open nodes, "")``."""
    root = _Node("#", 0, False, False)
    stack, at, size = [root], 0, len(page)
    held = Counter()  # open elements by name, so that a stray end tag needs no search

    def cut(k: int) -> None:
        held.subtract(n.tag for n in stack[k:])
        del stack[k:]

    while at < size:
        found = _MARKUP.search(page, at)
        text = page[at : found.start()] if found else _CUT_TAG.sub("", page[at:])
        if text:
            yield "text", stack, html.unescape(text) if "&" in text else text
        if not found:
            return
        at = found.end()
        closing, name, attributes = found.group(1, 2, 3) if found[2] else found.group(4, 5, 6)
        if name is None:
            continue
        tag = name.lower()
        if closing:
            for k in range(len(stack) - 1, 0, -1) if held[tag] else ():
                if stack[k].tag == tag:
                    yield "break" if any(n.tag not in INLINE for n in stack[k:]) else "stay", stack, ""
                    cut(k)
                    break
            continue
        if tag in ENDS_PARAGRAPH:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    cut(k)
                    break
                if stack[k].tag not in INLINE:
                    break
        if tag in _CLOSES:
            ends, barriers = _CLOSES[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in barriers:
                    break
                if stack[k].tag in ends:
                    cut(k)
                    break
        top = stack[-1]
        if tag not in INLINE:
            if tag not in RAW:
                yield "break", stack, ""
            top.children.append(tag)
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        style, words, role = _style(tag, attributes)
        main = top.main or tag in REGIONS
        noise = top.named_noise or _is_noise(tag, words, role, top.main)
        shallow = len(stack) < MAX_DEPTH and tag not in ROOTS
        stack.append(_Node(tag, _hash(top.path, style), noise, main) if shallow else _Node(tag, top.path, noise, main, top.children))
        held[tag] += 1
        yield "open", stack, ""


def events(page: str) -> Iterator[tuple[str, list[_Node], str]]:
    """Events ``("open", open nodes, "")`` and ``("block", open nodes, text)``: text between block boundaries, white space collapsed."""
    held: list[str] = []
    owner: list[_Node] = []
    for kind, stack, text in walk(page):
        if kind == "text":
            if not held:
                owner = stack[:MAX_DEPTH]  # deeper nodes have the path of the last of these
                if len(stack) > MAX_DEPTH:
                    owner.append(stack[-1])
            held.append(text)
        elif kind == "break" or (kind == "open" and _visible_change(stack)):
            if held and (done := " ".join("".join(held).split())):
                yield "block", owner, done
            held = []
        if kind == "open":
            yield kind, stack, ""
    if held and (done := " ".join("".join(held).split())):
        yield "block", owner, done


def blocks(page: str | None) -> Iterator[tuple[list[_Node], str]]:
    """``(open nodes, text)`` of each block in page order."""
    return ((stack, text) for kind, stack, text in events(page or "") if kind == "block")


def _visible_change(stack: list[_Node]) -> bool:
    """Whether the node just opened is noise below a parent that isn't, so that its text is apart."""
    return stack[-1].named_noise and not stack[-2].named_noise


def style_rows(page: str | None) -> set[tuple[int, int, int]]:
    """``(node, kind, feature)`` of one page without named noise; kind 0: the node occurs, 1: a child sequence, 2: a text block."""
    rows: set[tuple[int, int, int]] = set()
    nodes: dict[int, _Node] = {}
    texts: list[tuple[list[_Node], str]] = []
    for kind, stack, text in events(page or ""):
        if stack[-1].named_noise:
            continue
        if kind == "open":
            nodes[id(stack[-1])] = stack[-1]
        elif kind == "block":
            texts.append((stack, text))
            nodes[id(stack[0])] = stack[0]
    for node in nodes.values():
        rows.add((node.path, 0, 0))
        rows.add((node.path, 1, _hash(*node.children)))
    for stack, text in texts:
        feature = _hash(text)
        rows.update([(n.path, 2, feature) for n in stack])
    return rows


def main_text(page: str | None, low: frozenset[int] | set[int] = frozenset(), low_inside: frozenset[int] | set[int] = frozenset()) -> str:
    """The page's text without named noise and without branches of low importance (``low_inside`` for those in a region)."""
    found, total, inside = [], 0, 0
    for stack, text in blocks(page):
        if stack[-1].named_noise or any(n.path in (low_inside if n.main else low) for n in stack):
            continue
        main = stack[-1].main
        total += len(text)
        inside += len(text) * main
        found.append((main, text))
    only = inside and 10 * inside >= total
    return " ".join([text for main, text in found if main or not only])


_ROW = {"site": pa.int64(), "node": pa.int64(), "kind": pa.int32(), "feature": pa.int64(), "page": pa.int64()}


def _emitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[] for _ in _ROW]
        for site, key, page in values(*batch.columns):
            rows = style_rows(page)
            for column, part in zip(out, ([site] * len(rows), *zip(*rows), [key] * len(rows)) if rows else ()):
                column.extend(part)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, _ROW.values())], list(_ROW))


def style_tree(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(site, node, pages, texts, presentation, content, importance)`` of every style node; site: the hash of a host."""
    page = F.col(html_col).cast("string")
    hashed = pages.select(F.xxhash64(split_url(F.col(url_col))[0]).alias("site"), F.xxhash64(page).alias("key"), page.alias("page"))
    rows = hashed.mapInArrow(_emitted, "site long, node long, kind int, feature long, page long").distinct()
    counts = rows.groupBy("site", "node", "kind", "feature").agg(F.count("*").cast("double").alias("c"))
    of = lambda kind, value: F.coalesce(F.sum(F.when(F.col("kind") == kind, value)), F.lit(0.0))
    c = F.col("c")
    nodes = counts.groupBy("site", "node").agg(
        of(0, c).alias("pages"), of(1, c).alias("shown"), of(1, c * F.log(c)).alias("shown_log"),
        of(2, F.lit(1.0)).alias("texts"), of(2, F.log(c)).alias("text_log"),
    )
    base = F.log(F.greatest(F.col("pages"), F.lit(2.0)))
    single = F.col("pages") < 2
    presentation = F.when(single, F.lit(1.0)).otherwise((F.log("shown") - F.col("shown_log") / F.col("shown")) / base)
    content = F.when(single | (F.col("texts") == 0), F.lit(1.0)).otherwise(1 - F.col("text_log") / (F.col("texts") * base))
    nodes = nodes.select("site", "node", "pages", "texts", presentation.alias("presentation"), content.alias("content"))
    mixed = CONTENT_WEIGHT * F.col("content") + (1 - CONTENT_WEIGHT) * F.col("presentation")
    return nodes.withColumn("importance", F.when(F.col("texts") == 0, F.col("presentation")).otherwise(mixed))


def low_nodes(tree: DataFrame, threshold: float = LOW_IMPORTANCE) -> DataFrame:
    """``(site, node, inside)``: nodes whose branches are removed outside regions, and whether inside them too.

    ``tree`` is read twice: a written table.
    """
    whole = tree.where("node = 0").select("site", F.col("importance").alias("whole"))
    own = F.when(F.col("whole") > 0, F.least(F.lit(1.0), F.col("importance") / F.col("whole"))).otherwise(F.lit(1.0))
    mixed = lambda prior: (prior + F.col("pages") * own) / (prior + F.col("pages"))
    # a node is at most as important as the lesser prior lets it be, so one join serves both
    rows = tree.where((F.col("node") != 0) & (F.col("texts") > 0) & (F.col("importance") < threshold)).join(whole, "site")
    return rows.where(mixed(PRIOR_PAGES) < threshold).select("site", "node", (mixed(REGION_PAGES) < threshold).alias("inside"))


def _extracted(pages: pa.Array, low: pa.Array, inside: pa.Array) -> pa.Array:
    return pa.array([main_text(p, frozenset(x or ()), frozenset(y or ())) for p, x, y in values(pages, low, inside)], pa.string())


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(id, url, text, n_chars)`` for every page."""
    nodes = materialize(low_nodes(materialize(style_tree(pages, url_col, html_col), "tree")), "low")
    low = nodes.groupBy("site").agg(F.collect_set("node").alias("low"), F.collect_set(F.when(F.col("inside"), F.col("node"))).alias("inside"))
    rows = pages.select(F.col(id_col).alias("__id"), F.col(url_col).alias("__url"), F.col(html_col).cast("string").alias("__page"))
    rows = rows.withColumn("__site", F.xxhash64(split_url(F.col("__url"))[0]))
    if nodes.count() <= BROADCAST_ROWS:
        joined = rows.join(F.broadcast(low), rows["__site"] == low["site"], "left")
    else:
        rows = rows.withColumn("__salt", F.pmod(F.xxhash64("__id", "__url"), F.lit(SALTS)))
        low = low.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        joined = rows.join(low, (rows["__site"] == low["site"]) & (rows["__salt"] == low["salt"]), "left")
    udf = F.arrow_udf(_extracted, "string").asNondeterministic()
    done = joined.select(F.col("__id").alias(id_col), F.col("__url").alias(url_col), udf("__page", "low", "inside").alias("text"))
    return done.withColumn("n_chars", F.length("text").cast("long"))
