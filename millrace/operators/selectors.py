"""CSS selectors over :class:`millrace.operators.dom.Node` trees."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

from millrace.operators.dom import ELEMENT, Node

Test = Callable[[Node], bool]
_IDENT = r"-?(?:[_a-zA-Z\u0080-\U0010FFFF]|\\.)(?:[\w\-\u0080-\U0010FFFF]|\\.)*|--[\w\-]*"
_SIMPLE = re.compile(rf"\s*(?:(?P<tag>\*|{_IDENT})|\#(?P<id>(?:[\w\-\u0080-\U0010FFFF]|\\.)+)|\.(?P<cls>{_IDENT})|\[\s*(?P<attr>[\w\-:]+)\s*(?:(?P<op>[~|^$*!]?=)\s*(?:\"(?P<v1>[^\"]*)\"|'(?P<v2>[^']*)'|(?P<v3>[^\s\]]+))\s*(?P<flag>[iI])?\s*)?\]|:(?P<pseudo>:?[\w\-]+))")
_COMB = re.compile(r"\s*([>+~,])\s*|\s+(?=\S)")
_TAGS = re.compile(r"[a-zA-Z][a-zA-Z0-9]*(?:\s*,\s*[a-zA-Z][a-zA-Z0-9]*)*")


class SelectorError(ValueError):
    pass


def _plain(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text)


def _argument(text: str, pos: int) -> tuple[str, int]:
    """The text within the parentheses that open at ``pos``, and where they end."""
    depth, quote = 0, ""
    for i in range(pos, len(text)):
        c = text[i]
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
            if not depth:
                return text[pos + 1 : i], i + 1
    raise SelectorError(f"unclosed parenthesis in {text!r}")


def _nth(formula: str) -> Callable[[int], bool]:
    f = formula.strip().lower().replace(" ", "")
    f = {"odd": "2n+1", "even": "2n"}.get(f, f)
    m = re.fullmatch(r"([+-]?\d*)n([+-]\d+)?|([+-]?\d+)", f)
    if not m:
        raise SelectorError(f"bad position {formula!r}")
    if m[3] is not None:
        k = int(m[3])
        return lambda i: i == k
    a = int(m[1] + "1") if m[1] in ("", "+", "-") else int(m[1])
    b = int(m[2] or 0)
    return lambda i: (i - b == 0) if a == 0 else (i - b) % a == 0 and (i - b) // a >= 0


def _line(node: Node, same_tag: bool) -> list[Node]:
    return [c for c in node.parent.element_children() if not same_tag or c.tag == node.tag] if node.parent is not None else [node]


def _position(node: Node, same_tag: bool, from_end: bool) -> int:
    line = _line(node, same_tag)
    at = next(i for i, c in enumerate(line) if c is node)
    return len(line) - at if from_end else at + 1


def _pseudo(name: str, arg: str | None) -> Test:
    if name in ("not", "is", "where", "matches", "any") and arg is not None:
        inner = compile_selector(arg)
        return (lambda n: not inner(n)) if name == "not" else inner
    if name in ("has", "haschild") and arg is not None:
        arg = arg.strip()
        if name == "haschild" or arg.startswith(">"):
            inner = compile_selector(arg.lstrip("> "))
            return lambda n: any(inner(c) for c in n.element_children())
        inner = compile_selector(arg)
        return lambda n: any(inner(c) for c in n.elements())
    if name in ("contains", "containsown") and arg is not None:
        want = arg.strip().strip("\"'").lower()
        return lambda n: want in (n.own_text() if name == "containsown" else n.text()).lower()
    if name in ("matches", "matchesown") and arg is not None:
        rx = re.compile(arg)
        return lambda n: bool(rx.search(n.own_text() if name == "matchesown" else n.text()))
    if name.startswith("nth-") and arg is not None:
        of, test = name, _nth(arg)
        return lambda n: test(_position(n, "of-type" in of, "last" in of))
    simple: dict[str, Test] = {
        "first-child": lambda n: _position(n, False, False) == 1, "last-child": lambda n: _position(n, False, True) == 1, "only-child": lambda n: len(_line(n, False)) == 1,
        "first-of-type": lambda n: _position(n, True, False) == 1, "last-of-type": lambda n: _position(n, True, True) == 1, "only-of-type": lambda n: len(_line(n, True)) == 1,
        "empty": lambda n: not any(c.kind == ELEMENT or c.data for c in n.children if c.kind != 8), "root": lambda n: n.parent is None or n.parent.kind != ELEMENT,
        "checked": lambda n: "checked" in n.attrs or "selected" in n.attrs, "disabled": lambda n: "disabled" in n.attrs, "enabled": lambda n: "disabled" not in n.attrs and n.tag in ("input", "button", "select", "textarea", "option", "fieldset"),
        "link": lambda n: n.tag in ("a", "area", "link") and "href" in n.attrs, "input": lambda n: n.tag in ("input", "select", "textarea", "button"),
    }
    if arg is None and name in simple:
        return simple[name]
    raise SelectorError(f"unknown pseudo-class {name!r}")


def _attribute(name: str, op: str | None, value: str, fold: bool) -> Test:
    name = name.lower()
    norm = (lambda s: s.lower()) if fold else (lambda s: s)
    v = norm(value)
    if op is None:
        return lambda n: name in n.attrs
    tests: dict[str, Callable[[str], bool]] = {
        "=": lambda a: a == v, "~=": lambda a: bool(v) and v in a.split(), "|=": lambda a: a == v or a.startswith(v + "-"),
        "^=": lambda a: bool(v) and a.startswith(v), "$=": lambda a: bool(v) and a.endswith(v), "*=": lambda a: bool(v) and v in a,
    }
    if op == "!=":
        return lambda n: norm(n.attrs.get(name, "")) != v
    return lambda n: name in n.attrs and tests[op](norm(n.attrs[name]))


def _compound(text: str, pos: int) -> tuple[Test | None, int, str]:
    tests: list[Test] = []
    tag = "*"
    while m := _SIMPLE.match(text, pos):
        if tests and m[0][:1].isspace() or m["tag"] and tests:
            break
        pos = m.end()
        if m["tag"]:
            tag = _plain(m["tag"]).lower()
            tests.append(lambda n, t=tag: t == "*" or n.tag == t)
        elif m["id"]:
            tests.append(lambda n, v=_plain(m["id"]): n.attrs.get("id") == v)
        elif m["cls"]:
            tests.append(lambda n, v=_plain(m["cls"]): v in n.attrs.get("class", "").split())
        elif m["attr"]:
            value = m["v1"] if m["v1"] is not None else m["v2"] if m["v2"] is not None else m["v3"] or ""
            tests.append(_attribute(m["attr"], m["op"], value, bool(m["flag"])))
        else:
            arg = None
            if text[pos : pos + 1] == "(":
                arg, pos = _argument(text, pos)
            tests.append(_pseudo(m["pseudo"].lower(), arg))
    if not tests:
        return None, pos, tag
    return (tests[0] if len(tests) == 1 else lambda n: all(t(n) for t in tests)), pos, tag


def _chain(left: Test, comb: str, right: Test) -> Test:
    if comb == ">":
        return lambda n: right(n) and n.parent is not None and n.parent.kind == ELEMENT and left(n.parent)
    if comb == "+":
        return lambda n: right(n) and (p := n.sibling(-1)) is not None and left(p)
    if comb == "~":

        def before(n: Node) -> bool:
            if not right(n) or n.parent is None:
                return False
            for c in n.parent.element_children():
                if c is n:
                    return False
                if left(c):
                    return True
            return False

        return before
    return lambda n: right(n) and any(left(a) for a in n.ancestors())


@lru_cache(maxsize=1024)
def _compiled(text: str) -> tuple[Test, frozenset[str]]:
    """A test of one element, and the tags of the elements that can pass it (``*``: any)."""
    groups: list[Test] = []
    tags: set[str] = set()
    current, comb, pos = None, "", 0
    text = text.strip()
    if not text:
        raise SelectorError("empty selector")
    if _TAGS.fullmatch(text):
        names = frozenset(re.split(r"\s*,\s*", text.lower()))
        return (lambda n: n.tag in names), names
    while True:
        test, pos, tag = _compound(text, pos)
        if test is None:
            raise SelectorError(f"bad selector {text!r} at {pos}")
        current = test if current is None else _chain(current, comb, test)
        if pos >= len(text):
            groups.append(current)
            tags.add(tag)
            break
        m = _COMB.match(text, pos)
        if not m:
            raise SelectorError(f"bad selector {text!r} at {pos}")
        pos, comb = m.end(), m[1] or " "
        if comb == ",":
            groups.append(current)
            tags.add(tag)
            current = None
    return (groups[0] if len(groups) == 1 else lambda n: any(g(n) for g in groups)), frozenset(tags)


def compile_selector(text: str) -> Test:
    """A test of one element; raises :class:`SelectorError`."""
    return _compiled(text)[0]


def select(root: Node, selector: str) -> list[Node]:
    """Matching elements below ``root`` in document order."""
    test = compile_selector(selector)
    out, stack = [], root.children[::-1]
    while stack:
        node = stack.pop()
        if node.kind == ELEMENT:
            if test(node):
                out.append(node)
            stack += node.children[::-1]
    return out


class Elements:
    """The elements below ``root``, listed once for many selectors; ``root`` mustn't change meanwhile."""

    def __init__(self, root: Node) -> None:
        self.nodes = list(root.elements())
        self.tags = {n.tag for n in self.nodes}

    def select(self, selector: str) -> list[Node]:
        test, tags = _compiled(selector)
        return [n for n in self.nodes if test(n)] if "*" in tags or not tags.isdisjoint(self.tags) else []
