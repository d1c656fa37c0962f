"""XML text to normalised documents and events, and back."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any
from xml.parsers import expat
from xml.sax.saxutils import escape

Value = dict[str, Any]


class XmlError(ValueError):
    pass


def iter_events(data: str | bytes) -> Iterator[Value]:
    """``startElement``, ``text`` and ``endElement`` events; comments and instructions leave none, but part the text around them, as CDATA sections do.

    Names keep their prefixes. White space within the root is text, outside it isn't.
    """
    events: list[Value] = []
    text: list[str] = []
    depth = 0

    def flush(*_: Any) -> None:
        if text and depth:
            events.append({"type": "text", "value": "".join(text)})
        text.clear()

    def start(name: str, attrs: dict[str, str]) -> None:
        nonlocal depth
        flush()
        depth += 1
        events.append({"type": "startElement", "name": name, "attrs": dict(attrs)})

    def end(name: str) -> None:
        nonlocal depth
        flush()
        depth -= 1
        events.append({"type": "endElement", "name": name})

    p = expat.ParserCreate()
    p.buffer_text = True
    p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler = start, end, text.append
    p.CommentHandler = p.ProcessingInstructionHandler = p.StartCdataSectionHandler = p.EndCdataSectionHandler = flush
    p.EntityDeclHandler = _refuse
    try:
        p.Parse(data, True)
    except expat.ExpatError as e:
        raise XmlError(str(e)) from None
    yield from events


def _refuse(*_: Any) -> None:
    raise XmlError("entity declarations aren't read")


def decode(data: str | bytes) -> Value:
    """``{"type": "document", "root": element}`` with elements ``{type, name, attrs, children}`` and texts ``{type, value}``."""
    stack: list[Value] = [{"children": []}]
    for e in iter_events(data):
        if e["type"] == "startElement":
            node = {"type": "element", "name": e["name"], "attrs": e["attrs"], "children": []}
            stack[-1]["children"].append(node)
            stack.append(node)
        elif e["type"] == "endElement":
            stack.pop()
        else:
            stack[-1]["children"].append(e)
    return {"type": "document", "root": stack[0]["children"][0]}


def root(value: Value) -> Value | None:
    kind = value.get("type")
    return value.get("root") if kind == "document" else value if kind == "element" else None


def children(value: Value) -> list[Value]:
    kind = value.get("type")
    return [value["root"]] if kind == "document" else list(value.get("children", ())) if kind == "element" else []


def attr(value: Value, name: str) -> str | None:
    return (root(value) or value).get("attrs", {}).get(name)


def text(value: Value) -> str:
    """All text below a node, in order."""
    out, stack = [], [value]
    while stack:
        x = stack.pop()
        if x.get("type") == "text":
            out.append(x["value"])
        stack.extend(reversed(children(x)))
    return "".join(out)


_NAME = re.compile(r"[A-Za-z_:\u0080-\U0010FFFF][\w:.\-\u0080-\U0010FFFF]*\Z")


def encode(value: Value) -> str:
    """Markup of a document, element or text; attributes by name; elements without children as a pair of tags."""
    out: list[str] = []
    stack: list[Value | str] = [value]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        kind = x.get("type")
        if kind == "document":
            if not isinstance(x.get("root"), dict):
                raise XmlError("a document needs a root element")
            stack.append(x["root"])
        elif kind == "text":
            out.append(escape(str(x["value"]), {"\r": "&#xD;"}))
        elif kind == "element":
            name = x.get("name")
            if not isinstance(name, str) or not _NAME.match(name):
                raise XmlError(f"bad element name {name!r}")
            attrs = "".join(f' {k}="' + escape(str(v), {'"': "&#34;", "\n": "&#xA;", "\t": "&#x9;", "\r": "&#xD;"}) + '"' for k, v in sorted((x.get("attrs") or {}).items()))
            out.append(f"<{name}{attrs}>")
            stack.append(f"</{name}>")
            stack.extend(reversed(x.get("children") or []))
        else:
            raise XmlError(f"unknown node type {kind!r}")
    return "".join(out)
