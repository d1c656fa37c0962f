"""CSV text to records and back, with strict and relaxed widths, header rules and value inference."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator, Mapping, Sequence
from typing import Any

from millrace.functions.errors import checked_options

DEFAULTS: dict[str, Any] = {"delimiter": ",", "comment": None, "columns": None, "nullValues": (), "header": True, "trim": False, "skipEmpty": True, "strict": True, "inferTypes": False}


class CsvError(ValueError):
    pass


def options(given: Mapping[str, Any] | None) -> dict[str, Any]:
    o = checked_options(given, DEFAULTS, "csv")
    for name in ("delimiter", "comment"):
        if o[name] is not None and len(o[name]) != 1 or name == "delimiter" and o[name] in ("\n", "\r", '"', "�", None):
            raise CsvError(f"{name} must be one character")
    if o["comment"] == o["delimiter"]:
        raise CsvError("comment and delimiter must differ")
    return o


def records(text: str | bytes, o: Mapping[str, Any]) -> Iterator[tuple[int, list[str]]]:
    """``(record number from 1, fields as read)``; blank and comment lines aren't records. Quotes are strict unless ``strict`` is off."""
    s = (text.decode() if isinstance(text, bytes) else text).replace("\r\n", "\n")
    delimiter, comment, lazy, n, pos, end = o["delimiter"], o["comment"], not o["strict"], 0, 0, len(s)
    while pos < end:
        if s[pos] == "\n":
            pos += 1
            continue
        if comment and s[pos] == comment:
            pos = s.find("\n", pos) + 1 or end
            continue
        n += 1
        fields, more = [], True
        while more:
            if o["trim"]:
                while pos < end and s[pos] != "\n" and s[pos].isspace() and s[pos] != delimiter:
                    pos += 1
            if pos < end and s[pos] == '"':
                pos, out = pos + 1, []
                while True:
                    q = s.find('"', pos)
                    if q < 0:
                        if not lazy:
                            raise CsvError(f"record {n}: quote isn't closed")
                        out.append(s[pos:])
                        pos = end
                        break
                    out.append(s[pos:q])
                    pos = q + 1
                    if s[pos : pos + 1] == '"':
                        out.append('"')
                        pos += 1
                    elif pos >= end or s[pos] in (delimiter, "\n"):
                        break
                    elif lazy:
                        out.append('"')
                    else:
                        raise CsvError(f"record {n}: quote within a quoted field")
                fields.append("".join(out))
            else:
                stop = pos
                while stop < end and s[stop] != delimiter and s[stop] != "\n":
                    stop += 1
                if not lazy and '"' in s[pos:stop]:
                    raise CsvError(f"record {n}: quote in a field without quotes")
                fields.append(s[pos:stop])
                pos = stop
            more = pos < end and s[pos] == delimiter
            pos += 1
        yield n, fields


def header_names(cells: Sequence[str]) -> list[str]:
    """Blank names become ``colN``, repeated ones ``name_2`` and on, without colliding with names that are there."""
    names, used = [], set()
    plain = [c.strip() or f"col{i}" for i, c in enumerate(cells, 1)]
    for name in plain:
        out, k = name, 2
        while out in used:
            out, k = f"{name}_{k}", k + 1
        used.add(out)
        names.append(out)
    return names


_INT = re.compile(r"[+-]?\d+\Z", re.ASCII)
_FLOAT = re.compile(r"[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|inf(?:inity)?|nan|0[xX](?:[0-9a-fA-F]+\.?[0-9a-fA-F]*|\.[0-9a-fA-F]+)[pP][+-]?\d+)\Z", re.ASCII | re.IGNORECASE)


def convert(value: str, o: Mapping[str, Any]) -> Any:
    """A field as a value: trimmed, null markers, then (with ``inferTypes``) integer, float, boolean, text."""
    if o["trim"]:
        value = value.strip()
    if value in o["nullValues"]:
        return None
    if o["inferTypes"]:
        if _INT.match(value) and -(2**63) <= int(value) < 2**63:
            return int(value)
        if _FLOAT.match(value):
            return float.fromhex(value) if "x" in value.lower() else float(value)
        if value.lower() in ("true", "false"):
            return value.lower() == "true"
    return value


def _is_empty(fields: Sequence[str], o: Mapping[str, Any]) -> bool:
    return all(not f for f in fields)


def iter_rows(text: str | bytes, given: Mapping[str, Any] | None = None) -> Iterator[tuple[int, list[Any]]]:
    """``(record_no, values)``: raw rows, headers included; strict mode wants every row as wide as the first."""
    o, width = options(given), None
    for n, fields in records(text, o):
        if o["skipEmpty"] and _is_empty(fields, o):
            continue
        width = len(fields) if width is None else width
        if o["strict"] and len(fields) != width:
            raise CsvError(f"record {n}: expected {width} fields, got {len(fields)}")
        yield n, [convert(f, o) for f in fields]


def iter_objects(text: str | bytes, given: Mapping[str, Any] | None = None) -> Iterator[tuple[int, dict[str, Any]]]:
    """``(record_no, object)``. Names come from the first record, or from ``columns`` where ``header`` is off; both at once is an error."""
    o = options(given)
    if o["header"] and o["columns"]:
        raise CsvError("row 1: header and columns exclude each other")
    names = list(o["columns"]) if o["columns"] else None
    if names is not None and len(set(names)) != len(names):
        raise CsvError("columns has a name twice")
    for n, fields in records(text, o):
        if o["skipEmpty"] and _is_empty(fields, o):
            continue
        if names is None:
            names = header_names(fields) if o["header"] else [f"col{i}" for i in range(1, len(fields) + 1)]
            if o["header"]:
                continue
        if o["strict"] and len(fields) != len(names):
            raise CsvError(f"record {n}: expected {len(names)} fields, got {len(fields)}")
        values = [convert(f, o) for f in fields[: len(names)]]
        yield n, dict(zip(names, values + [None] * (len(names) - len(values))))


def decode(text: str | bytes, given: Mapping[str, Any] | None = None) -> list[dict[str, Any]]:
    return [x for _, x in iter_objects(text, given)]


def decode_rows(text: str | bytes, given: Mapping[str, Any] | None = None) -> list[list[Any]]:
    return [x for _, x in iter_rows(text, given)]


def _cell(value: Any, o: Mapping[str, Any]) -> str:
    if value is None:
        s = ""
    elif isinstance(value, bool):
        s = str(value).lower()
    elif isinstance(value, float):
        s = str(int(value)) if value.is_integer() and abs(value) < 1e21 else repr(value)
    elif isinstance(value, list | dict):
        s = json.dumps(value, ensure_ascii=False, separators=(",", ":"))
    else:
        s = str(value)
    if s and (o["delimiter"] in s or any(c in s for c in '"\n\r') or s[0].isspace() or s == r"\."):
        s = '"' + s.replace('"', '""') + '"'
    return s


def encode(data: Iterable[Any], given: Mapping[str, Any] | None = None) -> str:
    """Objects or rows (the first decides) as CSV text; columns default to the first object's keys."""
    o, rows = options(given), list(data)
    if not rows:
        return ""
    out: list[list[Any]] = []
    objects = isinstance(rows[0], Mapping)
    names = list(o["columns"] or (rows[0] if objects else ()))
    if o["header"] and names:
        out.append(names)
    for i, row in enumerate(rows, 1):
        if isinstance(row, Mapping) != objects:
            raise CsvError(f"row {i}: objects and rows are mixed")
        out.append([row.get(c) for c in names] if objects else list(row))
    return "".join(o["delimiter"].join(_cell(v, o) for v in row) + "\n" for row in out)
