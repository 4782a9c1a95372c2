"""Main text of web pages by a site style tree.

The pages of a host are merged into one tree of element paths. For each path the
entropy of its child patterns over the pages (presentation) and of the texts
below it (content) give an importance between 0 and 1: alike on every page is
unimportant, different on every page is important. Branches of low importance are
cut from each page. Beside it stand fixed rules for what no page counts as its
text (scripts, forms, menus, asides, advert and comment containers), and the
page's own ``main`` or ``article`` element limits the text where there is one;
its plain paragraphs and headings are never cut for being alike.

Defined cases: null and empty html give an empty text; a page whose url has no
host is judged without a tree; broken and cut-off markup is closed where it ends;
repeated rows are each returned and counted; other columns are ignored; pages of any
length and nesting are read whole, and an element keeps its own role however deep it lies
(the style tree alone judges what is nested deeper than 400 levels with its ancestor
there). Attributes are read one by one, the first of a name counts, and the id of
a paragraph, heading, list item or cell is an anchor, no hint.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..session import stage
from .common import small

#: Branches below this importance go; paths seen on fewer pages are not judged.
LEAST_IMPORTANCE, LEAST_PAGES = 0.4, 5
DAMPING = 0.9

# Elements by their role in HTML.
RAW = "script style textarea title noscript template iframe noembed noframes xmp".split()
NOISE = "head nav header footer aside form svg button select menu dialog canvas object map".split()
VOID = "area base br col embed hr img input link meta source track wbr param".split()
BLOCKS = (
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd pre blockquote table "
    "caption thead tbody tfoot tr td th figure figcaption address details summary center fieldset hgroup"
).split() + NOISE
PLAIN = "p h1 h2 h3 h4 h5 h6 li ul ol pre blockquote table thead tbody tr td th dl dt dd".split()
# Words of class and id names, and roles, of what is not the text.
NOISE_NAMES = (
    "ad ads adv advert adverts advertisement banner sponsor sponsored promo promotion cookie cookies "
    "consent gdpr notice sidebar comment comments disqus menu nav navbar navigation breadcrumb "
    "breadcrumbs share sharing social related recommended newsletter subscribe popup modal overlay "
    "footer pagination pager widget"
).split()
NOISE_ROLES = "navigation banner contentinfo complementary search dialog alert menu menubar".split()

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+>|[^>]*(?:>|\Z))",
    re.S,
)
# one attribute after the other, so that values and parts of names are never taken for names
_ATTRIBUTE = re.compile(r"([^\s=/>\"']++)(?:\s*+=\s*+(?:\"([^\"]*+)\"?|'([^']*+)'?|([^\s>]++)))?|[\s=/>\"']")
_NAME_WORD = re.compile(r"[a-z]+")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for t in RAW}
_RAW, _NOISE, _VOID, _BLOCKS, _PLAIN = map(frozenset, (RAW, NOISE, VOID, BLOCKS, PLAIN))
_NOISE_NAMES, _NOISE_ROLES = frozenset(NOISE_NAMES), frozenset(NOISE_ROLES)
_ENDS_P = _BLOCKS - {"html", "body"}
#: Elements of running text: their ids are anchors and say nothing about them.
_TEXT = frozenset("p h1 h2 h3 h4 h5 h6 li pre blockquote tr td th dt dd".split())
#: Levels that the style tree tells apart; what lies deeper is judged as its ancestor there.
LEVELS = 400


class Node:
    """A block element; ``items`` are texts and child nodes in order."""

    __slots__ = ("tag", "label", "noise", "items", "path", "within")

    def __init__(self, tag, label, noise, path, within=frozenset()):
        self.tag, self.label, self.noise, self.path, self.items = tag, label, noise, path, []
        self.within = within  # article and main, of those that it is or lies in


def _element(tag, attributes):
    """Label of the style tree, and whether the element is never text."""
    names, noise = [], tag in _NOISE
    if "=" in attributes:
        seen = set()
        for kind, *values in _ATTRIBUTE.findall(attributes):
            kind = kind.lower()
            if kind not in ("class", "id", "role") or kind in seen:  # the first of a name counts
                continue
            seen.add(kind)
            value = "".join(values).lower()
            if kind == "role":
                noise |= value.strip() in _NOISE_ROLES
            else:
                names += value.split()
                if kind == "class" or tag not in _TEXT:
                    noise |= not _NOISE_NAMES.isdisjoint(_NAME_WORD.findall(value))
    if tag in ("html", "body", "main", "article"):
        noise = False
    return ".".join([tag, *sorted(names)]), noise


def parse(text: str) -> Node:
    root = Node("", "", False, _key(""))
    stack, opened, at = [root], Counter(), 0
    size = len(text)

    def close(i):
        opened.subtract(n.tag for n in stack[i:])
        del stack[i:]

    while at < size:
        m = _TOKEN.search(text, at)
        if m is None:
            stack[-1].items.append(text[at:])
            break
        if m.start() > at:
            stack[-1].items.append(text[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if opened[tag] > 0:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        close(i)
                        break
                    if stack[i].tag in ("td", "th", "table") and tag not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html"):
                        break
            continue
        if tag == "br":
            stack[-1].items.append(" ")
        elif tag in _RAW:
            end = _RAW_END[tag].search(text, at)
            at = end.end() if end else size
        elif tag in _BLOCKS:
            if tag in _ENDS_P and stack[-1].tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6"):
                if stack[-1].tag == "p" or tag[0] == "h" and tag[1:].isdigit() or tag == "p":
                    close(-1)
            elif tag in ("li", "dt", "dd", "tr", "td", "th") and stack[-1].tag in (
                (tag,) if tag not in ("dt", "dd", "td", "th") else ("dt", "dd") if tag[0] == "d" else ("td", "th")
            ):
                close(-1)
            elif tag == "body" and stack[-1].tag == "head":
                close(-1)
            label, noise = _element(tag, m[3])
            up = stack[-1]
            path = _key(f"{up.path}/{label}") if len(stack) <= LEVELS else up.path
            within = up.within | {tag} if tag in ("article", "main") else up.within
            node = Node(tag, label, noise, path, within)
            up.items.append(node)
            stack.append(node)
            opened[tag] += 1
    return root


def _clean(pieces):
    return " ".join(_html.unescape("".join(pieces)).split())


def blocks(node: Node):
    """Texts of a node in page order: (its innermost node, the nodes from the root down to LEVELS, text)."""
    trail, out, run = [], [], []

    def flush():
        text = _clean(run)
        run.clear()
        if text:
            out.append((trail[-1] if trail else node, trail[:LEVELS], text))

    todo = [iter([node])]
    while todo:
        item = next(todo[-1], None)
        if item is None:
            todo.pop()
            flush()
            if trail:
                trail.pop()
        elif isinstance(item, str):
            run.append(item)
        else:
            flush()
            if not item.noise:
                trail.append(item)
                todo.append(iter(item.items))
    return out


def _key(text):
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace")) - (1 << 63)


def tree_rows(text: str):
    """What a page adds to its host's tree: distinct (path, kind, value).

    Kind 0: the page has the path; 1: a pattern of children; 2: a text below it.
    """
    root, rows = parse(text), set()
    todo = [root]
    while todo:
        node = todo.pop()
        children = [x for x in node.items if not isinstance(x, str)]
        todo += [x for x in children if not x.noise]
        rows.add((node.path, 0, 0))
        rows.add((node.path, 1, _key("|".join(x.label for x in children))))
    for _, trail, block in blocks(root):
        value = _key(block)
        rows.update((n.path, 2, value) for n in trail)
    return rows


def importance(pages: DataFrame) -> DataFrame:
    """host, path, pages, importance, for the paths of all hosts."""

    def run(batches):
        for b in batches:
            hosts, paths, kinds, values = [], [], [], []
            for host, text in zip(b.column("host").to_pylist(), b.column("html").to_pylist()):
                for path, kind, value in tree_rows(text or ""):
                    hosts.append(host)
                    paths.append(path)
                    kinds.append(kind)
                    values.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(hosts, pa.string()), pa.array(paths, pa.int64()), pa.array(kinds, pa.int32()),
                 pa.array(values, pa.int64())],
                names=["host", "path", "kind", "value"],
            )

    rows = pages.where("host != ''").select("host", "html").mapInArrow(
        run, "host STRING, path BIGINT, kind INT, value BIGINT"
    )
    counts = rows.groupBy("host", "path", "kind", "value").agg(F.count("*").alias("n"))
    n, kind = F.col("n"), F.col("kind")
    sums = counts.groupBy("host", "path").agg(
        F.sum(F.when(kind == 0, n)).alias("pages"),
        F.sum(F.when(kind == 1, n * F.log(n))).alias("patterns"),
        F.sum(F.when(kind == 2, F.log(n))).alias("repeats"),
        F.count(F.when(kind == 2, n)).alias("texts"),
    )
    scale = F.log("pages")
    style = (scale - F.col("patterns") / F.col("pages")) / scale
    # a text on c pages, evenly spread, has entropy log c to the base of the pages
    content = F.when(F.col("texts") > 0, 1 - F.col("repeats") / F.col("texts") / scale).otherwise(0.0)
    weight = F.pow(F.lit(DAMPING), F.least("texts", F.lit(8)))
    value = F.when(F.col("pages") < 2, 1.0).otherwise((1 - weight) * F.greatest(style, content) + weight * content)
    return sums.select("host", "path", "pages", value.alias("importance"))


def main_text(text: str, low=frozenset()) -> str:
    """The page's text without the branches whose path is in ``low``."""
    found = blocks(parse(text))
    for tag in ("article", "main"):
        inside = [x for x in found if tag in x[0].within]
        if inside:
            break
    else:
        tag, inside = None, found
    kept = []
    for _, trail, block in inside:
        own = False
        for node in trail:
            if own or tag is None:
                plain = tag is not None and node.tag in _PLAIN and "." not in node.label
                if not plain and node.tag not in ("", "html", "body") and node.path in low:
                    break
            own = own or node.tag == tag
        else:
            kept.append(block)
    return "\n".join(kept)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text: one row per row of ``pages``."""
    address = F.regexp_extract(F.lower(F.coalesce("url", F.lit(""))), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    rows = pages.select("page_id", "url", "html", address.alias("host"))
    low = stage(
        importance(rows)
        .where((F.col("pages") >= LEAST_PAGES) & (F.col("importance") < LEAST_IMPORTANCE))
        .groupBy("host")
        .agg(F.collect_set("path").alias("low")),  # the paths of a host's templates
        "site-style",
    )
    # paths and hosts weigh about 8 and 64 bytes
    sized = low.select(F.explode("low"))
    by_host = F.broadcast(low) if small(sized, 96) else low

    def run(batches):
        for b in batches:
            lows = b.column("low").to_pylist()
            texts = [
                main_text(t or "", frozenset(x or ())) for t, x in zip(b.column("html").to_pylist(), lows)
            ]
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("url"), pa.array(texts, pa.string())],
                names=["page_id", "url", "text"],
            )

    return rows.join(by_host, "host", "left").select("page_id", "url", "html", "low").mapInArrow(
        run, "page_id BIGINT, url STRING, text STRING"
    )
