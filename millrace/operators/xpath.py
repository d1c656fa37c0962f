"""An XPath 1.0 subset over document trees: axes in short form and by name, predicates, functions, comparisons and arithmetic."""

from __future__ import annotations

import math
import re
from functools import lru_cache
from typing import Any

from millrace.operators.dom import COMMENT, DOCUMENT, ELEMENT, TEXT, Node

_TOKEN = re.compile(r"\s*(?:(?P<num>\d+\.?\d*|\.\d+)|(?P<str>\"[^\"]*\"|'[^']*')|(?P<op>//|::|\.\.|!=|<=|>=|[/|()\[\]@,.=<>+*\-])|(?P<name>[A-Za-z_][\w.\-]*(?::(?!:)[A-Za-z_][\w.\-]*)?))")
AXES = {"child", "descendant", "descendant-or-self", "parent", "ancestor", "ancestor-or-self", "self", "following-sibling", "preceding-sibling", "following", "preceding", "attribute"}


class XPathError(ValueError):
    pass


class Attr:
    """An attribute as a node of its own."""

    __slots__ = ("owner", "name", "value")

    def __init__(self, owner: Node, name: str) -> None:
        self.owner, self.name, self.value = owner, name, owner.attrs[name]

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Attr) and other.owner is self.owner and other.name == self.name

    def __hash__(self) -> int:
        return hash((id(self.owner), self.name))


class _Parser:
    def __init__(self, text: str) -> None:
        self.tokens: list[tuple[str, str]] = []
        pos = 0
        text = text.rstrip()
        while pos < len(text):
            m = _TOKEN.match(text, pos)
            if not m:
                raise XPathError(f"bad expression {text!r} at {pos}")
            pos = m.end()
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
        self.at = 0

    def peek(self, k: int = 0) -> tuple[str, str]:
        return self.tokens[self.at + k] if self.at + k < len(self.tokens) else ("end", "")

    def take(self, value: str | None = None) -> tuple[str, str]:
        t = self.peek()
        if value is not None and t[1] != value or t[0] == "end":
            raise XPathError(f"expected {value or 'more'}, found {t[1]!r}")
        self.at += 1
        return t

    def is_(self, *values: str) -> bool:
        return self.peek()[0] in ("op", "name") and self.peek()[1] in values

    LEVELS = (("or",), ("and",), ("=", "!="), ("<", "<=", ">", ">="), ("+", "-"), ("*", "div", "mod"))

    def expression(self, level: int = 0) -> tuple:
        if level == len(self.LEVELS):
            return self.unary()
        left = self.expression(level + 1)
        while self.is_(*self.LEVELS[level]):
            op = self.take()[1]
            left = ("bin", op, left, self.expression(level + 1))
        return left

    def unary(self) -> tuple:
        if self.is_("-"):
            self.take()
            return ("neg", self.unary())
        left = self.path()
        while self.is_("|"):
            self.take()
            left = ("union", left, self.path())
        return left

    def path(self) -> tuple:
        kind, value = self.peek()
        if kind == "num":
            self.take()
            return ("lit", float(value))
        if kind == "str":
            self.take()
            return ("lit", value[1:-1])
        start: tuple | None = None
        if value == "(" and kind == "op":
            self.take()
            start = self.expression()
            self.take(")")
        elif kind == "name" and self.peek(1)[1] == "(" and value not in ("text", "node", "comment"):
            self.take(), self.take()
            args = []
            while not self.is_(")"):
                args.append(self.expression())
                if self.is_(","):
                    self.take()
            self.take(")")
            start = ("call", value, args)
        steps: list[tuple] = []
        if start is not None:
            if self.is_("["):
                start = ("filter", start, self.predicates())
            if not self.is_("/", "//"):
                return start
        root = False
        if start is None and self.is_("/", "//"):
            root = True
        while True:
            if self.is_("//"):
                self.take()
                steps.append(("descendant-or-self", ("node", ""), []))
                steps.append(self.step())
            elif self.is_("/"):
                self.take()
                if self.peek()[0] == "end" and not steps:
                    break
                steps.append(self.step())
            elif not steps and not root and start is None:
                steps.append(self.step())
            else:
                break
        return ("path", root, start, steps)

    def predicates(self) -> list[tuple]:
        out = []
        while self.is_("["):
            self.take()
            out.append(self.expression())
            self.take("]")
        return out

    def step(self) -> tuple:
        if self.is_("."):
            self.take()
            return ("self", ("node", ""), self.predicates())
        if self.is_(".."):
            self.take()
            return ("parent", ("node", ""), self.predicates())
        axis = "child"
        if self.is_("@"):
            self.take()
            axis = "attribute"
        elif self.peek()[0] == "name" and self.peek(1)[1] == "::":
            axis = self.take()[1]
            self.take()
            if axis not in AXES:
                raise XPathError(f"unknown axis {axis!r}")
        kind, value = self.take()
        if value == "*":
            test = ("any", "")
        elif kind == "name" and value in ("text", "node", "comment") and self.is_("("):
            self.take(), self.take(")")
            test = (value, "")
        elif kind == "name":
            test = ("name", value.lower())
        else:
            raise XPathError(f"unexpected {value!r}")
        return (axis, test, self.predicates())


@lru_cache(maxsize=512)
def compile_xpath(text: str) -> tuple:
    p = _Parser(text)
    out = p.expression()
    if p.peek()[0] != "end":
        raise XPathError(f"unexpected {p.peek()[1]!r} in {text!r}")
    return out


def string(x: Any) -> str:
    if isinstance(x, list):
        return string(x[0]) if x else ""
    if isinstance(x, Attr):
        return x.value
    if isinstance(x, Node):
        return x.data if x.kind in (TEXT, COMMENT) else x.text()
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, float):
        return "NaN" if math.isnan(x) else str(int(x)) if x.is_integer() else repr(x)
    return str(x)


def number(x: Any) -> float:
    if isinstance(x, bool | float):
        return float(x)
    try:
        return float(string(x).strip())
    except ValueError:
        return math.nan


def boolean(x: Any) -> bool:
    return bool(x) and not (isinstance(x, float) and math.isnan(x))


class _Evaluator:
    def __init__(self, root: Node) -> None:
        top = root
        while top.parent is not None:
            top = top.parent
        self.top = top
        self.order = {id(n): i for i, n in enumerate(top.walk())}

    def sort(self, nodes: list) -> list:
        seen, out = set(), []
        for n in nodes:
            k = n if isinstance(n, Attr) else id(n)
            if k not in seen:
                seen.add(k)
                out.append(n)
        return sorted(out, key=lambda n: (self.order[id(n.owner)], 1) if isinstance(n, Attr) else (self.order[id(n)], 0))

    def axis(self, name: str, n: Any) -> list:
        if isinstance(n, Attr):
            up = [n.owner, *n.owner.ancestors()]
            return {"parent": up[:1], "ancestor": up, "self": [n]}.get(name, [])
        siblings = n.parent.children if n.parent is not None else [n]
        at = next(i for i, c in enumerate(siblings) if c is n)
        if name == "child":
            return n.children
        if name == "attribute":
            return [Attr(n, a) for a in n.attrs]
        if name in ("descendant", "descendant-or-self"):
            return [x for x in n.walk() if x is not n or name.endswith("self")]
        if name == "parent":
            return [n.parent] if n.parent is not None else []
        if name in ("ancestor", "ancestor-or-self"):
            out, x = [n] if name.endswith("self") else [], n.parent
            while x is not None:
                out.append(x)
                x = x.parent
            return out
        if name == "following-sibling":
            return siblings[at + 1 :]
        if name == "preceding-sibling":
            return siblings[:at][::-1]
        if name in ("following", "preceding"):
            own, here = {id(x) for x in n.walk()}, self.order[id(n)]
            above = set(map(id, self.axis("ancestor", n)))
            line = [x for x in self.top.walk() if id(x) not in own and id(x) not in above]
            return [x for x in line if self.order[id(x)] > here] if name == "following" else [x for x in line if self.order[id(x)] < here][::-1]
        return [n]

    @staticmethod
    def test(test: tuple, axis: str, n: Any) -> bool:
        kind, name = test
        if kind == "node":
            return True
        if kind in ("text", "comment"):
            return isinstance(n, Node) and n.kind == (TEXT if kind == "text" else COMMENT)
        if axis == "attribute":
            return kind == "any" or n.name == name
        return isinstance(n, Node) and n.kind == ELEMENT and (kind == "any" or n.tag == name)

    def keep(self, nodes: list, predicates: list) -> list:
        for p in predicates:
            out = []
            for i, n in enumerate(nodes):
                v = self.run(p, n, i + 1, len(nodes))
                if v == i + 1 if isinstance(v, float) and not isinstance(v, bool) else boolean(v):
                    out.append(n)
            nodes = out
        return nodes

    def compare(self, op: str, a: Any, b: Any) -> bool:
        for x in a if isinstance(a, list) else [a]:
            for y in b if isinstance(b, list) else [b]:
                if op in ("=", "!="):
                    if isinstance(a, bool) or isinstance(b, bool):
                        p, q = boolean(a), boolean(b)
                    elif isinstance(x, float) or isinstance(y, float):
                        p, q = number(x), number(y)
                    else:
                        p, q = string(x), string(y)
                    if (p == q) == (op == "="):
                        return True
                elif {"<": number(x) < number(y), "<=": number(x) <= number(y), ">": number(x) > number(y), ">=": number(x) >= number(y)}[op]:
                    return True
        return False

    def call(self, name: str, args: list, n: Any, pos: int, size: int) -> Any:
        v = [self.run(a, n, pos, size) for a in args]
        s = lambda k: string(v[k] if len(v) > k else [n])
        table = {
            "position": lambda: float(pos), "last": lambda: float(size), "count": lambda: float(len(v[0])), "string": lambda: s(0), "number": lambda: number(v[0] if v else [n]), "boolean": lambda: boolean(v[0]),
            "not": lambda: not boolean(v[0]), "true": lambda: True, "false": lambda: False, "concat": lambda: "".join(map(string, v)), "contains": lambda: s(1) in s(0), "starts-with": lambda: s(0).startswith(s(1)), "ends-with": lambda: s(0).endswith(s(1)),
            "normalize-space": lambda: " ".join(s(0).split()), "string-length": lambda: float(len(s(0))), "translate": lambda: s(0).translate({ord(c): (s(2)[i] if i < len(s(2)) else None) for i, c in reversed(list(enumerate(s(1))))}),
            "substring-before": lambda: s(0).partition(s(1))[0] if s(1) in s(0) else "", "substring-after": lambda: s(0).partition(s(1))[2], "lower-case": lambda: s(0).lower(), "upper-case": lambda: s(0).upper(),
            "substring": lambda: s(0)[max(0, round(number(v[1])) - 1) : max(0, round(number(v[1])) - 1 + round(number(v[2]))) if len(v) > 2 else None], "sum": lambda: sum(map(number, v[0])),
            "floor": lambda: float(math.floor(number(v[0]))), "ceiling": lambda: float(math.ceil(number(v[0]))), "round": lambda: float(math.floor(number(v[0]) + 0.5)), "name": lambda: getattr((v[0][0] if v and v[0] else n), "tag", ""), "local-name": lambda: getattr((v[0][0] if v and v[0] else n), "tag", ""),
        }
        if name not in table:
            raise XPathError(f"unknown function {name!r}")
        return table[name]()

    def run(self, e: tuple, n: Any, pos: int = 1, size: int = 1) -> Any:
        kind = e[0]
        if kind == "lit":
            return e[1]
        if kind == "neg":
            return -number(self.run(e[1], n, pos, size))
        if kind == "union":
            return self.sort(self.run(e[1], n, pos, size) + self.run(e[2], n, pos, size))
        if kind == "call":
            return self.call(e[1], e[2], n, pos, size)
        if kind == "filter":
            return self.keep(self.run(e[1], n, pos, size), e[2])
        if kind == "bin":
            op = e[1]
            if op in ("or", "and"):
                left = boolean(self.run(e[2], n, pos, size))
                return left if left == (op == "or") else boolean(self.run(e[3], n, pos, size))
            a, b = self.run(e[2], n, pos, size), self.run(e[3], n, pos, size)
            if op in ("=", "!=", "<", "<=", ">", ">="):
                return self.compare(op, a, b)
            x, y = number(a), number(b)
            if op in ("div", "mod") and y == 0:
                return math.nan if op == "mod" or x == 0 or math.isnan(x) else math.copysign(math.inf, x)
            return {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "div": lambda: x / y, "mod": lambda: math.fmod(x, y)}[op]()
        _, root, start, steps = e
        now = [self.top] if root else self.run(start, n, pos, size) if start is not None else [n]
        for axis, test, predicates in steps:
            now = self.sort([x for m in now for x in self.keep([c for c in self.axis(axis, m) if self.test(test, axis, c)], predicates)])
        return now


def evaluate(root: Node, expression: str) -> list | str | float | bool:
    """Node sets as a list (text and attribute nodes as strings), other results as they are. Paths from ``/`` start at the document."""
    start = root
    if root.kind == DOCUMENT and not expression.lstrip().startswith("/"):
        start = next(iter(root.element_children()), root)
    out = _Evaluator(root).run(compile_xpath(expression), start)
    return [x if isinstance(x, Node) and x.kind in (ELEMENT, DOCUMENT) else string(x) for x in out] if isinstance(out, list) else out
