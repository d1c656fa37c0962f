"""Selection pipelines: selectors and the 45 operations on selections, compiled once and run over a page in one pass.

``a >> :attr("href") >> :compact()`` and ``:compact(:attr("href", a))`` are the same program: selectors push a selection, operations
take one (or as many as they have nested expressions) and push their result.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime
from functools import lru_cache
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import urls
from millrace.operators.dom import ELEMENT, Node, parse, serialise
from millrace.operators.selectors import SelectorError, compile_selector, select

# Operation names by family.
FAMILIES = {
    "cardinality": "first last nth",
    "selection": "take skip slice compact distinct dedupeByAttr dedupeByText",
    "filter": "within has matches not withAttr withText",
    "traversal": "parent closest children next prev siblings",
    "map": "text ownText normalize trim attr prop html outerHtml value absUrl url parseUrl replace regex toNumber toDate",
    "reducer": "exists empty count one indexOf len join",
}
FAMILY = {name: family for family, names in FAMILIES.items() for name in names.split()}
#: Literal arguments: the least and the most of each operation that has any.
ARGUMENTS = {"nth": (1, 1), "take": (1, 1), "skip": (1, 1), "slice": (2, 2), "dedupeByAttr": (1, 1), "within": (1, 1), "has": (1, 1), "matches": (1, 1), "not": (1, 1), "withAttr": (1, 1), "withText": (1, 1), "parent": (0, 1), "closest": (1, 1), "children": (0, 1), "next": (0, 1), "prev": (0, 1), "siblings": (0, 1), "attr": (1, 1), "prop": (1, 1), "url": (1, 1), "replace": (2, 2), "regex": (1, 2), "toDate": (0, 1), "join": (1, 1), "indexOf": (0, 1)}


@dataclass(frozen=True)
class Op:
    """A selector (``name`` is None) or an operation with its literal arguments and how many nested selections it takes."""

    name: str | None
    selector: str = ""
    args: tuple[Any, ...] = ()
    arity: int = 0


def _split(text: str, mark: str) -> list[str]:
    """``text`` at the top-level occurrences of ``mark``, outside quotes and brackets."""
    out, depth, quote, start, i = [], 0, "", 0, 0
    while i < len(text):
        c = text[i]
        if quote:
            if c == "\\":
                i += 1
            elif c == quote:
                quote = ""
        elif c in "\"'":
            quote = c
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif not depth and text.startswith(mark, i):
            out.append(text[start:i])
            i += len(mark)
            start = i
            continue
        i += 1
    if quote or depth:
        raise SelectorError(f"unbalanced quotes or brackets in {text!r}")
    return [*out, text[start:]]


_CALL = re.compile(r":([A-Za-z]+)\s*\((.*)\)\Z", re.S)
_NUMBER = re.compile(r"[+-]?(?:\d+\.?\d*|\.\d+)\Z")
_STRING = re.compile(r"\"((?:[^\"\\]|\\.)*)\"\Z|'((?:[^'\\]|\\.)*)'\Z", re.S)


def _step(text: str) -> Iterator[Op]:
    text = text.strip()
    m = _CALL.match(text)
    if not m or m[1] not in FAMILY:
        if m and not m[1].islower():
            raise SelectorError(f"unknown operation {m[1]!r}")
        compile_selector(text)
        yield Op(None, text)
        return
    name, args, arity = m[1], [], 0
    for part in _split(m[2], ",") if m[2].strip() else []:
        part = part.strip()
        if s := _STRING.match(part):
            args.append(re.sub(r"\\(.)", lambda e: {"n": "\n", "t": "\t"}.get(e[1], e[1]) if e[1] in "nt\"'\\" else e[0], s[1] if s[1] is not None else s[2]))
        elif _NUMBER.match(part):
            args.append(float(part) if "." in part else int(part))
        else:
            arity += 1
            yield from _compile(part)
    low, high = ARGUMENTS.get(name, (0, 0))
    if not low <= len(args) <= high:
        raise SelectorError(f":{name} takes {low} to {high} literal arguments, got {len(args)}")
    if arity > (2 if name == "indexOf" else 1):
        raise SelectorError(f":{name} takes one selection")
    yield Op(name, args=tuple(args), arity=arity)


def _compile(text: str) -> Iterator[Op]:
    for part in _split(text, ">>"):
        yield from _step(part)


@lru_cache(maxsize=512)
def compile_pipeline(text: str) -> tuple[Op, ...]:
    return tuple(_compile(text))


def _whole(n: Any) -> int | None:
    return int(n) if isinstance(n, int | float) and not isinstance(n, bool) and n == int(n) else None


def text_of(item: Any) -> str:
    """The string of an item: a node's text, the usual form of other values, nothing for None."""
    if isinstance(item, Node):
        return item.text()
    if item is None:
        return ""
    if isinstance(item, bool):
        return str(item).lower()
    if isinstance(item, float) and item.is_integer() and abs(item) < 1e21:
        return str(int(item))
    return item if isinstance(item, str) else json.dumps(item, ensure_ascii=False) if isinstance(item, dict) else str(item)


def identity(item: Any) -> Any:
    """A key under which items are the same: nodes by themselves, values by type and value."""
    return (Node, id(item)) if isinstance(item, Node) else (type(item), json.dumps(item, sort_keys=True) if isinstance(item, dict) else item)


def _once(items: list, key: Callable[[Any], Any]) -> list:
    seen: set = set()
    return [x for x in items if not ((k := key(x)) in seen or seen.add(k))]


def _items(x: Any) -> list:
    return x if isinstance(x, list) else [] if x is None else [x]


def _nodes(x: Any) -> list[Node]:
    return [n for n in _items(x) if isinstance(n, Node) and n.kind == ELEMENT]


def _squeeze(text: str) -> str:
    return " ".join(text.split())


def to_number(item: Any) -> float | None:
    s = re.sub(r"[^\d+\-.,eE]", "", text_of(item).strip(), flags=re.ASCII)
    if "," in s:
        head, _, tail = s.partition(",")
        if "." in s or s.count(",") > 1 or len(tail) == 3 and tail.isdigit() and head.lstrip("+-").isdigit():
            s = s.replace(",", "")
        else:
            s = s.replace(",", ".")
    try:
        out = float(s)
    except ValueError:
        return None
    return out if math.isfinite(out) else None


# The date layouts that are tried, in this order, as this library's own patterns.
DATE_LAYOUTS = ["%Y-%m-%dT%H:%M:%S.%f%z", "%Y-%m-%dT%H:%M:%S%z", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d", "%a, %d %b %Y %H:%M:%S %z", "%a, %d %b %Y %H:%M:%S %Z", "%d %b %y %H:%M %z", "%d %b %y %H:%M %Z", "%A, %d-%b-%y %H:%M:%S %Z", "%a %b %d %H:%M:%S %Y", "%a %b %d %H:%M:%S %Z %Y", "%a %b %d %H:%M:%S %z %Y", "%Y-%m-%d %H:%M", "%d %b %Y", "%b %d, %Y"]
# Pieces of reference-time layouts and the patterns they stand for.
LAYOUT_PIECES = [("2006", "%Y"), ("January", "%B"), ("Jan", "%b"), ("Monday", "%A"), ("Mon", "%a"), ("MST", "%Z"), ("-07:00", "%z"), ("-0700", "%z"), ("Z07:00", "%z"), ("01", "%m"), ("02", "%d"), ("_2", "%d"), ("15", "%H"), ("03", "%I"), ("04", "%M"), ("05", "%S"), ("PM", "%p"), ("06", "%y"), ("1", "%m"), ("2", "%d"), ("3", "%I"), ("4", "%M"), ("5", "%S")]
_PIECE = re.compile("|".join(re.escape(a) for a, _ in sorted(LAYOUT_PIECES, key=lambda x: -len(x[0]))))


def from_layout(layout: str) -> str:
    """A reference-time layout (``2006-01-02 15:04``) as a strptime pattern."""
    return _PIECE.sub(lambda m: dict(LAYOUT_PIECES)[m[0]], layout.replace("%", "%%"))


def to_date(item: Any, layout: str | None = None) -> str | None:
    """UTC time of a date text, RFC 3339 with the digits of a second's fraction that it has; zone abbreviations other than UTC count as UTC."""
    s = text_of(item).strip()
    if not s:
        return None
    for pattern in ([from_layout(layout)] if layout and layout.strip() else []) + DATE_LAYOUTS:
        text = re.sub(r"(\.\d{6})\d+", r"\1", s) if "%f" in pattern else s
        if pattern.endswith("%Z") or " %Z " in pattern:
            m = re.search(r"\b([A-Z]{3,4})\b(?=$| \d{4}$)", text)
            if not m:
                continue
            text, pattern = text.replace(m[1], "UTC"), pattern
        try:
            t = datetime.strptime(text, pattern)
        except ValueError:
            continue
        t = t.replace(tzinfo=UTC) if t.tzinfo is None else t.astimezone(UTC)
        fraction = f".{t.microsecond:06d}".rstrip("0") if t.microsecond else ""
        return t.strftime("%Y-%m-%dT%H:%M:%S") + fraction + "Z"
    return None


def prop(node: Node, name: str) -> Any:
    if name in ("checked", "selected", "disabled"):
        return name in node.attrs
    return node.attrs.get(name)


def _replace(text: str, pattern: str, by: str) -> str:
    try:
        rx = _regex(pattern)
    except re.error:
        return text.replace(pattern, by)

    def expand(m: re.Match) -> str:
        def one(g: re.Match) -> str:
            name = g[1] or g[2]
            if name is None:
                return "$"
            try:
                return m[int(name) if name.isdigit() else name] or ""
            except (IndexError, KeyError):
                return ""

        return re.sub(r"\$(?:\{(\w+)\}|(\w+)|\$)", one, by)

    return rx.sub(expand, text)


@lru_cache(maxsize=256)
def _regex(pattern: str) -> re.Pattern:
    """The pattern, without what linear-time engines don't have: look-around and back-references are errors."""
    if re.search(r"\(\?(?:[=!]|<[=!])|\\[1-9]", pattern):
        raise re.error("look-around and back-references aren't supported")
    return re.compile(pattern.replace("(?P<", "(?P<"))


def _map(name: str, args: tuple, item: Any, base: str) -> Any:
    if item is None:
        return None
    node = isinstance(item, Node)
    if name in ("text", "ownText", "attr", "prop", "html", "outerHtml", "value", "url"):
        if not node:
            return None
        return {
            "text": item.text, "ownText": item.own_text, "attr": lambda: item.attrs.get(args[0].lower()), "prop": lambda: prop(item, args[0]), "html": item.inner_html,
            "outerHtml": lambda: serialise(item), "value": lambda: prop(item, "value"), "url": lambda: urls.absolute(base, item.attrs.get(args[0].lower())),
        }[name]()
    s = text_of(item)
    if name == "normalize":
        return _squeeze(s)
    if name == "trim":
        return s.strip()
    if name == "absUrl":
        return urls.absolute(base, s)
    if name == "parseUrl":
        return urls.parts(s)
    if name == "replace":
        return _replace(s, str(args[0]), str(args[1]))
    if name == "regex":
        try:
            m = _regex(str(args[0])).search(s)
            return m[_whole(args[1]) if len(args) > 1 else 0] if m else None
        except (re.error, IndexError, TypeError):
            return None
    return to_number(item) if name == "toNumber" else to_date(item, args[0] if args else None)


def _tested(text: str) -> Callable[[Node], bool] | None:
    try:
        return compile_selector(text)
    except SelectorError:
        return None


def _filter(name: str, arg: str, nodes: list[Node]) -> list[Node]:
    test = _tested(str(arg))
    if test is None:
        return []
    keep: dict[str, Callable[[Node], bool]] = {
        "within": lambda n: any(test(a) for a in n.ancestors()), "has": lambda n: any(test(d) for d in n.elements()), "matches": test, "not": lambda n: not test(n),
        "withAttr": lambda n: str(arg).lower() in n.attrs, "withText": lambda n: str(arg) in n.text(),
    }
    return [n for n in nodes if keep[name](n)]


def _traverse(name: str, args: tuple, nodes: list[Node]) -> list[Node]:
    test = _tested(str(args[0])) if args else lambda n: True
    if test is None:
        return []

    def step(n: Node) -> list[Node]:
        if name == "parent":
            return [n.parent] if n.parent is not None and n.parent.kind == ELEMENT else []
        if name == "closest":
            return next(([a] for a in (n, *n.ancestors()) if test(a)), [])
        if name == "children":
            return n.element_children()
        if name in ("next", "prev"):
            x = n.sibling(1 if name == "next" else -1)
            return [x] if x is not None else []
        return [c for c in n.parent.element_children() if c is not n] if n.parent is not None else []

    return [x for n in nodes for x in step(n) if test(x)]


def _slice(items: list, start: int, count: int) -> list:
    start = max(0, len(items) + start) if start < 0 else start
    return items[start : start + count] if count > 0 else []


def _apply(op: Op, values: list, base: str) -> Any:
    name, args, last = op.name, op.args, values[-1] if values else []
    items, family = _items(last), FAMILY[op.name]
    if family == "cardinality":
        at = {"first": 0, "last": len(items) - 1}.get(name, _whole(args[0]) if args else None)
        return items[at] if at is not None and 0 <= at < len(items) else None
    if family == "selection":
        if name in ("take", "skip", "slice"):
            n = [_whole(a) for a in args]
            if None in n:
                return []
            return _slice(items, n[0], n[1]) if name == "slice" else items[: max(0, n[0])] if name == "take" else items[max(0, n[0]) :]
        if name == "compact":
            return [x for x in items if x is not None]
        if name == "distinct":
            return _once(items, identity)
        nodes = _nodes(last)
        return _once(nodes, (lambda n: n.attrs.get(args[0].lower(), "<none>")) if name == "dedupeByAttr" else lambda n: _squeeze(n.text()))
    if family == "filter":
        return _filter(name, args[0], _nodes(last))
    if family == "traversal":
        return _traverse(name, args, _nodes(last))
    if family == "map":
        return [_map(name, args, x, base) for x in last] if isinstance(last, list) else _map(name, args, last, base)
    if name == "indexOf":
        wanted = args[0] if args else next(iter(_items(values[-1])), None)
        within = _items(values[0])
        return next((i for i, x in enumerate(within) if identity(x) == identity(wanted)), -1)
    if name == "len":
        return len(last.encode()) if isinstance(last, str) else len(items)
    if name == "join":
        return str(args[0]).join(text_of(x) for x in items)
    return {"exists": len(items) > 0, "empty": not items, "count": len(items), "one": len(items) == 1}[name]


def evaluate(root: Node, pipeline: str, base: str = "") -> list:
    """The result of a pipeline on a tree as a list; a single value is a list of one, None (no item) a list without any."""
    stack: list[Any] = []
    for op in compile_pipeline(pipeline):
        if op.name is None:
            stack.append(select(root, op.selector))
            continue
        take = op.arity or (1 if stack else 0)
        if take > len(stack):
            stack.append([])
            continue
        values = stack[len(stack) - take :] if take else []
        del stack[len(stack) - take :]
        stack.append(_apply(op, values, base))
    out = stack[-1] if stack else []
    return out if isinstance(out, list) else [] if out is None else [out]


def as_text(item: Any) -> str | None:
    """An item as a column value: nodes as their markup, objects as JSON, numbers and booleans in their usual form."""
    return None if item is None else serialise(item) if isinstance(item, Node) else text_of(item)


def query(pages: DataFrame, pipelines: dict[str, str], key: str = "page_id", html: str = "html", url: str | None = "url") -> DataFrame:
    """``key`` and, for each name in ``pipelines``, its results as ``array<string>``, one parse of each page for all; no shuffle.

    Null markup gives null arrays. Pipelines are compiled (and refused) here, on the driver.
    """
    for text in pipelines.values():
        compile_pipeline(text)
    names = list(pipelines)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for i in range(batch.num_rows):
                markup = batch.column(1)[i].as_py()
                base = batch.column(2)[i].as_py() or "" if url else ""
                root = parse(markup) if markup is not None else None
                for col, name in zip(out, names):
                    col.append([as_text(x) for x in evaluate(root, pipelines[name], base)] if root is not None else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.list_(pa.string())) for c in out)], names=[key, *names])

    slim = pages.select(key, html, *([url] if url else []))
    kinds = ", ".join(f"`{n}` array<string>" for n in names)
    return slim.mapInArrow(run, f"{key} {slim.schema[key].dataType.simpleString()}, {kinds}")


def _re_space(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+", " ")


#: Operations on a column ``array<string>`` of results, for pipelines that go on in the JVM.
COLUMN_OPS: dict[str, Callable[..., Column]] = {
    "first": lambda c: F.try_element_at(c, F.lit(1)),
    "last": lambda c: F.try_element_at(c, F.lit(-1)),
    "nth": lambda c, n: F.try_element_at(c, F.lit(n + 1)) if n >= 0 else F.lit(None).cast("string"),
    "take": lambda c, n: F.slice(c, 1, max(0, n)),
    "skip": lambda c, n: F.slice(c, F.lit(max(0, n) + 1), F.greatest(F.lit(0), F.size(c))),
    "slice": lambda c, start, count: F.slice(c, F.lit(start + 1) if start >= 0 else F.greatest(F.lit(1), F.size(c) + start + 1), F.lit(max(0, count))),
    "compact": F.array_compact,
    "distinct": F.array_distinct,
    "normalize": lambda c: F.transform(c, lambda x: F.trim(_re_space(x))),
    "trim": lambda c: F.transform(c, lambda x: F.regexp_replace(F.regexp_replace(x, r"(?U)^\s+", ""), r"(?U)\s+$", "")),
    "exists": lambda c: F.size(c) > 0,
    "empty": lambda c: F.size(c) == 0,
    "count": F.size,
    "one": lambda c: F.size(c) == 1,
    "indexOf": lambda c, x: F.array_position(c, x) - 1,
    "join": lambda c, sep: F.array_join(c, sep, ""),
}
