"""Main text of web pages: gradient-boosted trees over DOM nodes, then a hierarchical decoding that keeps ancestors and descendants consistent."""

from __future__ import annotations

import html as html_lib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|head|noscript|template|textarea|select|option|button|svg|canvas|iframe|object|xmp)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>"
    r"|</(?P<close>[a-zA-Z][^\s/>]*)[^>]*>"
    r"|<(?P<open>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<[!?/][^>]*>",
    re.S | re.I,
)
_ATTR = re.compile(r"(?:^|\s)(class|id|role|aria-label|itemprop|name|hidden|style|type)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# Tags that make nodes, tags that a new one of them ends, and their groups.
BLOCKS = "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table thead tbody tfoot tr td th caption figure figcaption nav header footer aside form fieldset details summary address center dialog menu label hr".split()
VOID = {"hr", "br", "img", "input", "meta", "link", "source", "wbr", "area", "base", "col", "embed", "track", "param"}
ENDS = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "thead": ("thead tbody tfoot", "table"), "tbody": ("thead tbody tfoot", "table"), "tfoot": ("thead tbody tfoot", "table")}
GROUPS = ["body html", "main", "article", "section", "div center", "p", "h1", "h2 h3 h4 h5 h6", "ul ol dl menu", "li dt dd", "blockquote pre", "table thead tbody tfoot tr td th caption", "figure figcaption", "nav", "header", "footer", "aside", "form fieldset label", "details summary dialog address hr"]
# Attribute tokens by what they say of a node.
HINTS = {
    "content": "content article post entry body main text story page prose markdown maincontent articlebody blog news",
    "menu": "nav menu breadcrumb breadcrumbs navbar navigation pager pagination tabs toc skip",
    "head": "header masthead banner branding logo topbar hero site",
    "foot": "footer foot copyright legal colophon bottom",
    "side": "sidebar side aside related recommended widget rail more trending popular links secondary complementary also",
    "notice": "cookie consent notice alert popup modal overlay gdpr privacy newsletter subscribe signup subscription message paywall toast info",
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion banner adsense dfp adslot",
    "comment": "comment comments reply replies discussion disqus respond thread responses reader",
    "form": "form search login contact signin register input",
    "share": "share sharing social tweet facebook follow tags tag meta byline author date",
}
_HINT = {w: k for k, words in enumerate(HINTS.values()) for w in words.split()}
_GROUP = {t: k for k, tags in enumerate(GROUPS) for t in tags.split()}
_BLOCK = set(BLOCKS)
N_HINTS, N_GROUPS = len(HINTS), len(GROUPS)
SCALARS = ["depth", "subtree_chars", "own_chars", "density", "link_density", "words", "stops", "commas", "p_below", "nodes_below", "inputs", "images", "siblings", "sibling_at", "same_tag", "sibling_chars", "sibling_links", "at_page", "share_of_page", "parent_chars", "parent_link_density", "h1_below", "h1_before", "copyright", "mean_word", "link_count", "hidden", "share_of_parent", "marks"]
N_FEATURES = 3 * N_GROUPS + 3 * N_HINTS + len(SCALARS)


@lru_cache(maxsize=65536)
def _hints(attrs: str) -> tuple[int, bool]:
    """Bits of the hint groups that the attributes name, and whether they hide the node."""
    bits, hidden = 0, False
    for name, *values in _ATTR.findall(attrs):
        value, name = values[0] or values[1] or values[2], name.lower()
        if name == "hidden" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            hidden = True
        elif name != "style":
            for part in _PART.findall(value):
                k = _HINT.get(part.lower())
                if k is not None:
                    bits |= 1 << k
    return bits, hidden


class Tree:
    """Block nodes of a page in document order: parent, tag, attribute text, and runs of text that belong to a node."""

    __slots__ = ("parent", "tag", "attrs", "runs", "link_chars", "link_count", "inputs", "images")

    def __init__(self) -> None:
        self.parent, self.tag, self.attrs = [-1], ["#root"], [""]
        self.runs: list[tuple[int, str]] = []
        self.link_chars, self.link_count, self.inputs, self.images = [0], [0], [0], [0]


def parse(markup: str) -> Tree:
    """Reads any text as markup: unknown, unclosed and wrongly nested tags never fail. Raw elements (scripts, styles, head, form controls) hold no text."""
    tree, at, pos, link, end = Tree(), 0, 0, False, len(markup)
    parent, tags, runs = tree.parent, tree.tag, tree.runs
    waiting: list[str] = []
    low = None

    def flush(node: int) -> None:
        if waiting:
            text = "".join(waiting)
            waiting.clear()
            text = " ".join(text.split())
            if text:
                runs.append((node, text))

    def up_to(node: int, names: tuple[str, ...] | set[str], stop: tuple[str, ...] | set[str]) -> int:
        x = node
        while x > 0 and tags[x] not in stop:
            if tags[x] in names:
                return x
            x = parent[x]
        return -1

    for m in _TOKEN.finditer(markup):
        start = m.start()
        if start < pos:
            continue
        if start > pos:
            piece = markup[pos:start]
            # each stretch of text on its own: references don't run across markup
            waiting.append(html_lib.unescape(piece) if "&" in piece else piece)
            if link:
                tree.link_chars[at] += len(piece)
        pos = m.end()
        kind = m.lastgroup
        if kind is None:
            continue
        if kind == "raw":
            name = m["raw"].lower()
            if low is None:
                low = markup.lower()
            shut = low.find(f"</{name}", pos)
            if name == "option" and shut < 0:
                continue
            if name == "head":
                body = low.find("<body", pos)
                shut = min(x for x in (shut if shut >= 0 else end, body if body >= 0 else end))
                if shut == end:  # neither end: the head ends at the first block
                    continue
                pos = shut if low.startswith("<body", shut) else low.find(">", shut) + 1 or end
            else:
                pos = end if shut < 0 else low.find(">", shut) + 1 or end
                tree.inputs[at] += name in ("textarea", "select", "button")
            waiting.append(" ")
        elif kind == "close":
            name = m["close"].lower()
            if name == "a":
                link = False
            elif name in _BLOCK:
                x = up_to(at, (name,), ())
                if x > 0:
                    flush(at)
                    at, link = parent[x], False
        else:
            name = m["open"].lower()
            if name in _BLOCK:
                flush(at)
                link = False
                if name in ("html", "body") and name in tags:
                    continue
                if name in ENDS:
                    names, stop = ENDS[name]
                    x = up_to(at, set(names.split()), set(stop.split()))
                    at = parent[x] if x > 0 else at
                elif tags[at] == "p" or tags[at][:1] == "h" and tags[at][1:].isdigit() and name[:1] == "h" and name[1:].isdigit():
                    at = parent[at]
                parent.append(at)
                tags.append(name)
                tree.attrs.append(m["attrs"])
                for c in (tree.link_chars, tree.link_count, tree.inputs, tree.images):
                    c.append(0)
                if name != "hr":
                    at = len(tags) - 1
            elif name == "a":
                link = "href" in m["attrs"].lower()
                tree.link_count[at] += 1
            elif name == "br":
                waiting.append(" ")
            elif name == "input":
                tree.inputs[at] += 1
            elif name == "img":
                tree.images[at] += 1
    if pos < end:
        waiting.append(html_lib.unescape(markup[pos:]) if "&" in markup[pos:] else markup[pos:])
    flush(at)
    return tree


_STOPS = set("the of and to in is that for it on with as was be by this are or from at an have not der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce el los las del y por con una su para al lo como más pero sus".split())


def features(tree: Tree) -> np.ndarray:
    """A row of numbers for each node; the first row is the page itself."""
    n, parent, tags = len(tree.tag), tree.parent, tree.tag
    own = [0] * n
    words, stops, commas, copyright_, marks = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    for node, text in tree.runs:
        own[node] += len(text)
        split = text.split(" ")
        words[node] += len(split)
        stops[node] += sum(1 for w in split if w in _STOPS)
        commas[node] += text.count(",") + text.count(". ") + text.endswith(".")
        marks[node] += text.count("|") + text.count("·") + text.count("»") + text.count("›")
        copyright_[node] |= "©" in text
    depth, own_hint, above, group = [0] * n, [0] * n, [0] * n, [-1] * n
    hidden = [0] * n
    children = [0] * n
    index = [0] * n
    h1_at = n
    for i in range(1, n):
        p = parent[i]
        depth[i] = depth[p] + 1
        own_hint[i], hide = _hints(tree.attrs[i]) if tree.attrs[i] else (0, False)
        hidden[i] = hide or hidden[p]
        above[i] = above[p] | own_hint[p]
        group[i] = _GROUP[tags[i]]
        index[i] = children[p]
        children[p] += 1
        if tags[i] == "h1" and h1_at == n:
            h1_at = i
    sub, links, link_n, below, p_below, sub_words, sub_commas, inputs, images, h1, sub_stops, hints_below, sub_copy, sub_marks = own[:], tree.link_chars[:], tree.link_count[:], [1] * n, [0] * n, words[:], commas[:], tree.inputs[:], tree.images[:], [0] * n, stops[:], own_hint[:], copyright_[:], marks[:]
    for i in range(n - 1, 0, -1):
        p = parent[i]
        h1[i] |= tags[i] == "h1"
        sub[p] += sub[i]
        links[p] += links[i]
        link_n[p] += link_n[i]
        below[p] += below[i]
        p_below[p] += p_below[i] + (tags[i] == "p")
        sub_words[p] += sub_words[i]
        sub_commas[p] += sub_commas[i]
        inputs[p] += inputs[i]
        images[p] += images[i]
        h1[p] |= h1[i]
        sub_stops[p] += sub_stops[i]
        hints_below[p] |= hints_below[i]
        sub_copy[p] |= sub_copy[i]
        sub_marks[p] += sub_marks[i]
    before, total = [0] * n, 0
    node_text = own
    for i in range(n):
        before[i] = total
        total += node_text[i]
    total = max(total, 1)
    tag_sum: dict[tuple[int, str], int] = {}
    for i in range(1, n):
        key = (parent[i], tags[i])
        tag_sum[key] = tag_sum.get(key, 0) + 1
    i = np.arange(n)
    par = np.array(parent)
    par[0] = 0
    a = lambda x: np.array(x, dtype=np.float64)
    sub_, links_, children_, below_ = a(sub), a(links), a(children), a(below)
    density = np.minimum(links_ / np.maximum(sub_, 1), 1.0)
    sib = np.maximum(children_[par], 1)
    others = np.maximum(sib - 1, 1)
    sib_chars = (sub_[par] - a(own)[par] - sub_) / others
    sib_links = np.minimum((links_[par] - a(tree.link_chars)[par] - links_) / np.maximum(sub_[par] - a(own)[par] - sub_, 1), 1.0)
    same = np.array([0.0] + [tag_sum[(parent[k], tags[k])] for k in range(1, n)])
    out = np.zeros((n, N_FEATURES), dtype=np.float32)
    g = np.array(group)
    on = g >= 0
    out[i[on], g[on]] = 1
    pg = g[par]
    on = pg >= 0
    out[i[on], N_GROUPS + pg[on]] = 1
    base = 2 * N_GROUPS
    inside = np.zeros((n, N_GROUPS), dtype=bool)
    eye = np.eye(N_GROUPS, dtype=bool)
    for k in range(1, n):
        p = parent[k]
        inside[k] = inside[p] | eye[group[p]] if p > 0 else inside[p]
    out[:, base : base + N_GROUPS] = inside
    base += N_GROUPS
    shift = np.arange(N_HINTS)
    for bits in (own_hint, above, hints_below):
        out[:, base : base + N_HINTS] = (np.array(bits)[:, None] >> shift) & 1
        base += N_HINTS
    w = np.maximum(a(sub_words), 1)
    scalars = [
        a(depth), np.log1p(sub_), np.log1p(a(own)), sub_ / below_, density, np.log1p(a(sub_words)), a(sub_stops) / w, a(sub_commas) / w, a(p_below), np.log1p(below_),
        a(inputs), a(images), sib, a(index) / sib, same / sib, np.log1p(np.maximum(sib_chars, 0)), sib_links, a(before) / total, sub_ / total, np.log1p(sub_[par]), density[par],
        a(h1), (i > h1_at) * 1.0 - (h1_at == n), a(sub_copy), sub_ / w, np.log1p(a(link_n)), a(hidden), sub_ / np.maximum(sub_[par], 1), a(sub_marks) / w,
    ]
    for k, x in enumerate(scalars):
        out[:, base + k] = x
    return out


class Forest:
    """Boosted trees of one depth as arrays; ``margin`` sums their leaves."""

    def __init__(self, feature: np.ndarray, threshold: np.ndarray, leaf: np.ndarray, bias: float) -> None:
        self.feature, self.threshold, self.leaf, self.bias = feature, threshold, leaf, bias
        self.depth = int(np.log2(leaf.shape[1]))

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            out += leaf[at - len(feature)]
        return out

    @classmethod
    @lru_cache(maxsize=1)
    def load(cls) -> Forest:
        x = json.loads(Path(__file__).with_name("html_model.json").read_text())
        return cls(np.array(x["feature"]), np.array(x["threshold"], dtype=np.float32), np.array(x["leaf"]), x["bias"])

    def dump(self, path: Path) -> None:
        path.write_text(json.dumps({"feature": self.feature.tolist(), "threshold": [[round(float(v), 6) for v in t] for t in self.threshold], "leaf": [[round(float(v), 5) for v in t] for t in self.leaf], "bias": self.bias}, separators=(",", ":")))


def decode(parent: list[int], margin: np.ndarray) -> list[bool]:
    """The likeliest labelling in which a node that is cut takes its whole subtree along; the page itself stays."""
    keep = (-np.logaddexp(0.0, -margin)).tolist()
    cut = (-np.logaddexp(0.0, margin)).tolist()
    n = len(parent)
    cut_all, kept_best = cut[:], keep[:]
    for i in range(n - 1, 0, -1):
        p = parent[i]
        cut_all[p] += cut_all[i]
        kept_best[p] += max(cut_all[i], kept_best[i])
    out = [True] * n
    for i in range(1, n):
        out[i] = out[parent[i]] and kept_best[i] >= cut_all[i]
    return out


#: Tags and hint groups of what is no main text, if a page gives no other sign.
_ASIDE_TAGS = {"nav", "header", "footer", "aside", "form", "fieldset", "dialog", "menu"}
_ASIDE_HINTS = sum(1 << list(HINTS).index(k) for k in ("menu", "head", "foot", "side", "notice", "ad", "comment", "form", "share"))


def plain_nodes(tree: Tree) -> list[bool]:
    """Whether neither a node nor one above it is marked as something else than main text; for pages of which nothing else would stay."""
    out = [True] * len(tree.tag)
    for i in range(1, len(out)):
        bits, hidden = _hints(tree.attrs[i]) if tree.attrs[i] else (0, False)
        out[i] = out[tree.parent[i]] and tree.tag[i] not in _ASIDE_TAGS and not hidden and not bits & _ASIDE_HINTS
    return out


def main_texts(pages: list[str | None]) -> list[str]:
    """Main text of each page; null, empty and textless markup give an empty text, and others at least what isn't marked as something else."""
    trees = [parse(x or "") for x in pages]
    rows = [features(t) for t in trees]
    margin = Forest.load().margin(np.concatenate(rows)) if rows else np.zeros(0)
    out, at = [], 0
    for tree, x in zip(trees, rows):
        kept = decode(tree.parent, margin[at : at + len(x)])
        at += len(x)
        if not any(kept[node] for node, _ in tree.runs):
            kept = plain_nodes(tree)
        out.append("\n".join(text for node, text in tree.runs if kept[node]))
    return out


def extract(pages: DataFrame, chunk: int = 256) -> DataFrame:
    """``pages(page_id, url, html, ...)`` to ``(page_id, url, text, n_chars)``, a row for each row; nothing is capped.

    Null or empty html gives an empty text; repeated rows stay; other columns are ignored; an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, chunk):
                part = batch.slice(at, chunk)
                texts = main_texts(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    slim = pages.select("page_id", "url", "html")
    kinds = ", ".join(f"{c} {slim.schema[c].dataType.simpleString()}" for c in ("page_id", "url"))
    return slim.mapInArrow(run, f"{kinds}, text string, n_chars long")
