"""A document tree from any markup, its text and its serialised form, and the flattened node table."""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

ELEMENT, TEXT, COMMENT, DOCUMENT = 1, 3, 8, 9
#: Elements nested deeper lie beside each other at this depth.
MAX_DEPTH = 256

# The markup standard's element classes.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style xmp iframe noembed noframes".split())
RCDATA = {"title", "textarea"}
HEAD = set("base link meta title style script noscript template".split())
CLOSES_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li dd dt".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
SCOPE = set("html table td th caption marquee object template applet button".split())
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}), "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr"}), "th": ({"td", "th"}, {"tr"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"})}

_TAG = re.compile(r"<!--(?P<comment>.*?)(?:--!?>|\Z)|<(?P<bogus>[!?][^>]*)>|</(?P<end>[a-zA-Z][^\s/>]*)[^>]*>|<(?P<start>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
_ATTR = re.compile(r"([^\s=/>\"'][^\s=/>]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")


class Node:
    __slots__ = ("kind", "tag", "attrs", "data", "children", "parent", "depth")

    def __init__(self, kind: int, tag: str = "", attrs: dict[str, str] | None = None, data: str = "") -> None:
        self.kind, self.tag, self.attrs, self.data = kind, tag, attrs if attrs is not None else {}, data
        self.children: list[Node] = []
        self.parent: Node | None = None
        self.depth = 0

    def add(self, child: Node) -> Node:
        child.parent, child.depth = self, self.depth + 1
        self.children.append(child)
        return child

    def remove(self) -> None:
        if self.parent is not None:
            self.parent.children = [c for c in self.parent.children if c is not self]
            self.parent = None

    def walk(self) -> Iterator[Node]:
        """This node and all below it in document order, without recursion."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(reversed(node.children))

    def elements(self) -> Iterator[Node]:
        """Elements below this node."""
        return (n for n in self.walk() if n.kind == ELEMENT and n is not self)

    def ancestors(self) -> Iterator[Node]:
        node = self.parent
        while node is not None and node.kind == ELEMENT:
            yield node
            node = node.parent

    def element_children(self) -> list[Node]:
        return [c for c in self.children if c.kind == ELEMENT]

    def sibling(self, step: int) -> Node | None:
        if self.parent is None:
            return None
        line = self.parent.element_children()
        at = next(i for i, c in enumerate(line) if c is self) + step
        return line[at] if 0 <= at < len(line) else None

    def text(self) -> str:
        return "".join(n.data for n in self.walk() if n.kind == TEXT)

    def own_text(self) -> str:
        return "".join(c.data for c in self.children if c.kind == TEXT)

    def inner_html(self) -> str:
        return "".join(serialise(c) for c in self.children)


def serialise(node: Node) -> str:
    out: list[str] = []
    stack: list[Node | str] = [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        elif x.kind == TEXT:
            raw = x.parent is not None and x.parent.tag in RAW
            out.append(x.data if raw else x.data.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&#34;").replace("'", "&#39;"))
        elif x.kind == COMMENT:
            out.append(f"<!--{x.data}-->")
        else:
            if x.kind == ELEMENT:
                attrs = "".join(f' {k}="' + v.replace("&", "&amp;").replace('"', "&#34;").replace("'", "&#39;").replace("<", "&lt;").replace(">", "&gt;") + '"' for k, v in x.attrs.items())
                out.append(f"<{x.tag}{attrs}{'/' if x.tag in VOID else ''}>")
                if x.tag in VOID:
                    continue
                stack.append(f"</{x.tag}>")
            stack.extend(reversed(x.children))
    return "".join(out)


def attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in _ATTR.findall(text):
        value = a or b or c
        out.setdefault(name.lower(), html_lib.unescape(value) if "&" in value else value)
    return out


class _Builder:
    def __init__(self, fragment: bool) -> None:
        self.doc = Node(DOCUMENT)
        self.fragment = fragment
        if fragment:
            self.html = self.head = self.body = self.at = self.doc
        else:
            self.html = self.doc.add(Node(ELEMENT, "html"))
            self.head = self.html.add(Node(ELEMENT, "head"))
            self.body = self.html.add(Node(ELEMENT, "body"))
            self.at = self.head
        self.in_head = not fragment

    def text(self, data: str) -> None:
        if not data:
            return
        if self.in_head and self.at is self.head:
            if not data.strip():
                return
            self.to_body()
        data = data.replace("\r\n", "\n").replace("\r", "\n")
        last = self.at.children[-1] if self.at.children else None
        if last is not None and last.kind == TEXT:
            last.data += data
        else:
            self.at.add(Node(TEXT, data=data))

    def to_body(self) -> None:
        self.in_head, self.at = False, self.body

    def up(self, names: set[str], stop: set[str]) -> Node | None:
        node: Node | None = self.at
        while node is not None and node.kind == ELEMENT and node is not self.body and node.tag not in stop:
            if node.tag in names:
                return node
            node = node.parent
        return None

    def close(self, node: Node) -> None:
        self.at = node.parent or self.doc

    def start(self, tag: str, attrs: dict[str, str]) -> None:
        if tag in ("html", "head", "body") and not self.fragment:
            target = {"html": self.html, "head": self.head, "body": self.body}[tag]
            for k, v in attrs.items():
                target.attrs.setdefault(k, v)
            if tag == "body" and self.in_head:
                self.to_body()
            return
        if self.in_head:
            if tag not in HEAD:
                self.to_body()
        if tag in CLOSES_P:
            p = self.up({"p"}, SCOPE)
            if p is not None:
                self.close(p)
        if tag in HEADINGS and self.at.tag in HEADINGS:
            self.close(self.at)
        if tag == "a":
            a = self.up({"a"}, SCOPE)
            if a is not None:
                self.close(a)
        if tag in IMPLIED:
            names, stop = IMPLIED[tag]
            while (x := self.up(names, stop)) is not None:
                self.close(x)
        if tag == "tr" and self.at.tag == "table":
            self.at = self.at.add(Node(ELEMENT, "tbody"))
        elif tag in ("td", "th") and self.at.tag in ("table", "tbody", "thead", "tfoot"):
            if self.at.tag == "table":
                self.at = self.at.add(Node(ELEMENT, "tbody"))
            self.at = self.at.add(Node(ELEMENT, "tr"))
        node = self.at.add(Node(ELEMENT, tag, attrs))
        if tag not in VOID and node.depth < MAX_DEPTH:
            self.at = node

    def end(self, tag: str) -> None:
        if tag in ("html", "body"):
            return
        if tag == "head":
            if self.in_head:
                self.to_body()
            return
        node = self.up({tag}, set() if tag in ("table", "td", "th", "tr", "tbody", "thead", "tfoot") else SCOPE - {tag})
        if node is not None:
            self.close(node)
        elif tag == "p" and not self.in_head:
            self.at.add(Node(ELEMENT, "p"))


def parse(markup: str, fragment: bool = False) -> Node:
    """The tree of any text. A document always has ``html``, ``head`` and ``body``; a fragment has only what the text says."""
    b, pos, n = _Builder(fragment), 0, len(markup)
    low = None
    for m in _TAG.finditer(markup):
        if m.start() < pos:
            continue
        piece = markup[pos : m.start()]
        if piece:
            b.text(html_lib.unescape(piece) if "&" in piece else piece)
        pos = m.end()
        if m["comment"] is not None:
            b.at.add(Node(COMMENT, data=m["comment"]))
        elif m["end"]:
            b.end(m["end"].lower())
        elif m["start"]:
            tag, raw_attrs = m["start"].lower(), m["attrs"]
            b.start(tag, attributes(raw_attrs) if raw_attrs else {})
            if tag in RAW or tag in RCDATA:
                low = low if low is not None else markup.lower()
                shut = low.find(f"</{tag}", pos)
                data = markup[pos : shut if shut >= 0 else n]
                if data:
                    b.at.add(Node(TEXT, data=html_lib.unescape(data) if tag in RCDATA else data))
                pos = n if shut < 0 else (low.find(">", shut) + 1 or n)
                b.close(b.at)
    if pos < n:
        piece = markup[pos:]
        b.text(html_lib.unescape(piece) if "&" in piece else piece)
    return b.doc


def node_rows(markup: str) -> Iterator[tuple]:
    """``(node_id, parent_id, end_id, depth, node_type, name, attrs, own_text, text)`` in document order.

    ``end_id`` is the last id below a node, so that containment is a range: ``a.node_id < d.node_id <= a.end_id``.
    """
    doc = parse(markup)
    order = list(doc.walk())
    at = {id(x): i for i, x in enumerate(order)}
    end, depth, texts = list(range(len(order))), [0] * len(order), [""] * len(order)
    for i, x in enumerate(order):
        depth[i] = depth[at[id(x.parent)]] + 1 if x.parent is not None else 0
    for i in range(len(order) - 1, 0, -1):
        p = at[id(order[i].parent)]
        end[p] = max(end[p], end[i])
    for i, x in enumerate(order):
        texts[i] = x.data if x.kind != ELEMENT and x.kind != DOCUMENT else x.text()
        yield i, at[id(x.parent)] if x.parent is not None else None, end[i], depth[i], x.kind, x.tag or {TEXT: "#text", COMMENT: "#comment", DOCUMENT: "#document"}[x.kind], x.attrs if x.kind == ELEMENT else None, x.own_text(), texts[i]


NODE_SCHEMA = "node_id int, parent_id int, end_id int, depth int, node_type int, name string, attrs map<string,string>, own_text string, text string"


def parse_nodes(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """The node table of every page: ``key`` and the columns of :func:`node_rows`. Null markup gives no rows; no shuffle."""
    kinds = [pa.int32()] * 5 + [pa.string(), pa.map_(pa.string(), pa.string()), pa.string(), pa.string()]
    names = [c.split(" ")[0] for c in NODE_SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                markup = batch.column(1)[i].as_py()
                if markup is None:
                    continue
                cols = list(zip(*node_rows(markup)))
                cols[6] = [list(a.items()) if a is not None else None for a in cols[6]]
                same = batch.column(0).take(pa.array([i] * len(cols[0])))
                yield pa.RecordBatch.from_arrays([same, *(pa.array(c, k) for c, k in zip(cols, kinds))], names=[key, *names])

    slim = pages.select(key, html)
    return slim.mapInArrow(run, f"{key} {slim.schema[key].dataType.simpleString()}, {NODE_SCHEMA}")
