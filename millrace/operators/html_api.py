"""Page, document and element functions over parsed markup. Functions that need a live browser raise :class:`NotSupported`.

Decisions where forms differ: an element is the first match; ``inner_text`` of a selector joins all matches, ``inner_html`` is the
first's; both raise on no match. Setters change the tree in place and text is written as text.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from millrace.functions import urls
from millrace.functions.errors import NotFound, NotSupported
from millrace.operators import cssx, xpath
from millrace.operators.dom import DOCUMENT, ELEMENT, TEXT, Node, parse, serialise
from millrace.operators.selectors import select


@dataclass(frozen=True)
class QuerySelector:
    """A selector with its kind, ``css`` or ``xpath``."""

    kind: str
    text: str


@dataclass
class HtmlPage:
    url: str
    root: Node
    cookies: list[dict[str, Any]] = field(default_factory=list)
    isClosed: bool = False

    @property
    def title(self) -> str:
        return next((n.text() for n in select(self.root, "title")), "")

    @property
    def frames(self) -> list[HtmlPage]:
        return [HtmlPage(urls.absolute(base_url(self), n.attrs.get("src")) or "about:blank", parse(n.attrs["srcdoc"]) if "srcdoc" in n.attrs else parse("")) for n in select(self.root, "iframe")]

    @property
    def body(self) -> Node | None:
        return next(iter(select(self.root, "body")), None)

    @property
    def head(self) -> Node | None:
        return next(iter(select(self.root, "head")), None)


Root = HtmlPage | Node


def _node(root: Root) -> Node:
    return root.root if isinstance(root, HtmlPage) else root


def html_parse(markup: str | bytes, url: str = "about:blank", cookies: list[dict[str, Any]] | None = None) -> HtmlPage:
    return HtmlPage(url, parse(markup.decode("utf-8", "replace") if isinstance(markup, bytes) else markup), list(cookies or ()))


def is_html_element(value: Any) -> bool:
    return isinstance(value, Node) and value.kind == ELEMENT


def is_html_document(value: Any) -> bool:
    return isinstance(value, HtmlPage) or isinstance(value, Node) and value.kind == DOCUMENT


def url(page: HtmlPage) -> str:
    return page.url


def base_url(page: HtmlPage) -> str:
    return urls.base_url(page.url, next((n.attrs["href"] for n in select(page.root, "base[href]")), None))


def resolve_url(page: HtmlPage, text: str) -> str | None:
    return urls.absolute(base_url(page), text)


def x(expression: str) -> QuerySelector:
    xpath.compile_xpath(expression)
    return QuerySelector("xpath", expression)


def evaluate_xpath(root: Root, expression: str) -> Any:
    return xpath.evaluate(_node(root), expression)


def frames(page: HtmlPage, prop: str, expression: str) -> list[HtmlPage]:
    rx = re.compile(expression)
    return [f for f in page.frames if rx.search(str(getattr(f, prop, "") or ""))]


def elements(root: Root, selector: str | QuerySelector) -> list[Node]:
    if isinstance(selector, QuerySelector) and selector.kind == "xpath":
        found = xpath.evaluate(_node(root), selector.text)
        return [n for n in found if isinstance(n, Node)] if isinstance(found, list) else []
    return select(_node(root), selector.text if isinstance(selector, QuerySelector) else selector)


def element(root: Root, selector: str | QuerySelector) -> Node | None:
    return next(iter(elements(root, selector)), None)


def element_exists(root: Root, selector: str | QuerySelector) -> bool:
    return bool(elements(root, selector))


def elements_count(root: Root, selector: str | QuerySelector) -> int:
    return len(elements(root, selector))


def _one(root: Root, selector: str | QuerySelector | None) -> Node:
    if selector is None:
        node = _node(root)
        return next(iter(node.element_children()), node) if node.kind == DOCUMENT else node
    found = element(root, selector)
    if found is None:
        raise NotFound(str(selector))
    return found


def attr_get(root: Root, *names: str) -> dict[str, str]:
    own = _one(root, None).attrs
    return {n: own[n.lower()] for n in names if n.lower() in own}


def attr_query(root: Root, selector: str, *names: str) -> dict[str, str]:
    return attr_get(_one(root, selector), *names)


def attr_set(root: Root, name: str | Mapping[str, str], value: str | None = None) -> None:
    for k, v in (name if isinstance(name, Mapping) else {name: value}).items():
        _one(root, None).attrs[k.lower()] = str(v)


def attr_remove(root: Root, *names: str) -> None:
    for n in names:
        _one(root, None).attrs.pop(n.lower(), None)


def inner_html(root: Root, selector: str | None = None) -> str:
    return _one(root, selector).inner_html()


def inner_html_all(root: Root, selector: str) -> list[str]:
    return [n.inner_html() for n in elements(root, selector)]


def inner_html_set(root: Root, first: str, second: str | None = None) -> None:
    node, markup = (_one(root, None), first) if second is None else (_one(root, first), second)
    node.children = []
    for c in parse(markup, fragment=True).children:
        node.add(c)


def inner_text(root: Root, selector: str | None = None) -> str:
    if selector is None:
        return _one(root, None).text()
    found = elements(root, selector)
    if not found:
        raise NotFound(selector)
    return "".join(n.text() for n in found)


def inner_text_all(root: Root, selector: str) -> list[str]:
    return [n.text() for n in elements(root, selector)]


def inner_text_set(root: Root, first: str, second: str | None = None) -> None:
    node, text = (_one(root, None), first) if second is None else (_one(root, first), second)
    node.children = []
    node.add(Node(TEXT, data=text))


def styles(text: str) -> dict[str, str | float]:
    """Inline style declarations; values that are numbers become floats."""
    out: dict[str, str | float] = {}
    for part in re.split(r";(?![^(]*\))", text):
        name, colon, value = part.partition(":")
        name, value = name.strip().lower(), value.strip()
        if colon and name and value:
            out[name] = float(value) if re.fullmatch(r"[+-]?(?:\d+\.?\d*|\.\d+)", value) else value
    return out


def _write_styles(node: Node, of: Mapping[str, Any]) -> None:
    node.attrs["style"] = " ".join(f"{k}: {cssx.text_of(v)};" for k, v in of.items())


def style_get(node: Node, *names: str) -> dict[str, str | float]:
    of = styles(node.attrs.get("style", ""))
    return {n: of[n.lower()] for n in names if n.lower() in of}


def style_set(node: Node, name: str | Mapping[str, Any], value: Any = None) -> None:
    more = dict(name) if isinstance(name, Mapping) else {name: value}
    _write_styles(node, styles(node.attrs.get("style", "")) | {k.lower(): v for k, v in more.items()})


def style_remove(node: Node, *names: str) -> None:
    _write_styles(node, {k: v for k, v in styles(node.attrs.get("style", "")).items() if k not in {n.lower() for n in names}})


def cookie_get(page: HtmlPage, name: str) -> dict[str, Any] | None:
    return next((c for c in page.cookies if c.get("name") == name), None)


def query(root: Root, text: str, dialect: str = "css") -> list[Any]:
    """``QUERY ... USING css | xpath``."""
    if dialect == "css":
        return cssx.evaluate(_node(root), text, base_url(root) if isinstance(root, HtmlPage) else "")
    if dialect == "xpath":
        found = evaluate_xpath(root, text)
        return found if isinstance(found, list) else [found]
    raise ValueError(f"unknown dialect {dialect!r}")


def query_one(root: Root, text: str, dialect: str = "css") -> Any:
    return next(iter(query(root, text, dialect)), None)


def query_value(root: Root, text: str, dialect: str = "css") -> Any:
    found = query(root, text, dialect)
    if not found:
        raise NotFound(text)
    return found[0]


query_any = query_one


def query_count(root: Root, text: str, dialect: str = "css") -> int:
    return len(query(root, text, dialect))


def query_exists(root: Root, text: str, dialect: str = "css") -> bool:
    return bool(query(root, text, dialect))


def properties(value: Any) -> dict[str, Any]:
    """The readable properties of a page, a document or an element."""
    if isinstance(value, HtmlPage):
        return {"url": value.url, "URL": value.url, "title": value.title, "cookies": value.cookies, "isClosed": value.isClosed, "frames": value.frames, "mainFrame": value.root, "document": value.root, "response": None}
    if value.kind == DOCUMENT:
        body = next(iter(select(value, "body")), None)
        return {"title": next((n.text() for n in select(value, "title")), ""), "body": body, "head": next(iter(select(value, "head")), None), "innerHTML": serialise(value), "innerText": value.text(), "nodeType": DOCUMENT, "nodeName": "#document", "children": value.children, "length": len(value.children)}
    kids = value.element_children()
    return {
        "textContent": value.text(), "innerText": value.text(), "innerHTML": value.inner_html(), "value": value.attrs.get("value"), "attributes": dict(value.attrs), "style": styles(value.attrs.get("style", "")),
        "previousElementSibling": value.sibling(-1), "nextElementSibling": value.sibling(1), "parentElement": value.parent if value.parent is not None and value.parent.kind == ELEMENT else None, "nodeType": value.kind, "nodeName": value.tag, "children": kids, "length": len(kids),
    }


# Functions that act on a live page.
BROWSER_ONLY = "BLUR COOKIE_DEL COOKIE_SET CLICK CLICK_ALL FOCUS HOVER UNHOVER INPUT INPUT_CLEAR MOUSE NAVIGATE NAVIGATE_BACK NAVIGATE_FORWARD PAGINATION PDF PRESS PRESS_SELECTOR SCREENSHOT SCROLL SCROLL_BOTTOM SCROLL_ELEMENT SCROLL_TOP SELECT WAIT_ATTR WAIT_NO_ATTR WAIT_ATTR_ALL WAIT_NO_ATTR_ALL WAIT_ELEMENT WAIT_NO_ELEMENT WAIT_CLASS WAIT_NO_CLASS WAIT_CLASS_ALL WAIT_NO_CLASS_ALL WAIT_STYLE WAIT_NO_STYLE WAIT_STYLE_ALL WAIT_NO_STYLE_ALL WAIT_NAVIGATION".split()


def browser_only(name: str) -> Any:
    def refuse(*_: Any, **__: Any) -> Any:
        raise NotSupported(f"{name} needs a live browser")

    refuse.__name__ = name.lower()
    return refuse
