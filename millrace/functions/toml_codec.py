"""TOML text to objects and back."""

from __future__ import annotations

import json
import math
import re
import tomllib
from collections.abc import Mapping
from datetime import UTC, date, datetime, time
from typing import Any

from millrace.functions.errors import checked_options


class TomlError(ValueError):
    pass


def _temporal(value: Any, native: bool) -> Any:
    """Text as written, or ``{"flavor", "value"}`` of one of the four kinds."""
    if isinstance(value, datetime):
        flavor = "offset-datetime" if value.tzinfo else "local-datetime"
        s = value.isoformat().replace("+00:00", "Z") if value.utcoffset() is not None and not value.utcoffset() else value.isoformat()
    else:
        flavor, s = ("local-date" if isinstance(value, date) else "local-time"), value.isoformat()
    s = re.sub(r"(\.\d*?)0+(?=$|Z|[+-])", r"\1", s) if "." in s else s
    return {"flavor": flavor, "value": s} if native else s


def _plain(value: Any, native: bool) -> Any:
    if isinstance(value, dict):
        return {k: _plain(v, native) for k, v in value.items()}
    if isinstance(value, list):
        return [_plain(v, native) for v in value]
    if isinstance(value, date | time):
        return _temporal(value, native)
    if isinstance(value, int) and not isinstance(value, bool) and not -(2**63) <= value < 2**63:
        raise TomlError(f"integer {value} doesn't fit into 64 bits")
    return value


def decode(data: str | bytes, given: Mapping[str, Any] | None = None) -> dict[str, Any]:
    o = checked_options(given, {"datetime": "string", "strict": True}, "toml")
    if o["strict"] is not True:
        raise TomlError("strict can't be turned off")
    if o["datetime"] not in ("string", "native"):
        raise TomlError("datetime must be string or native")
    try:
        return _plain(tomllib.loads(data.decode() if isinstance(data, bytes) else data), o["datetime"] == "native")
    except (tomllib.TOMLDecodeError, UnicodeDecodeError) as e:
        raise TomlError(str(e)) from None


_BARE = re.compile(r"[A-Za-z0-9_-]+\Z")


def _name(k: str) -> str:
    return k if _BARE.match(k) else json.dumps(k, ensure_ascii=False)


def _scalar(value: Any, preserve: bool) -> str:
    if value is None:
        raise TomlError("null has no form")
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, int):
        return str(value)
    if isinstance(value, float):
        return ("nan" if math.isnan(value) else "inf" if value > 0 else "-inf") if not math.isfinite(value) else repr(value)
    if isinstance(value, datetime):
        if preserve or value.tzinfo is None:
            return value.isoformat()
        return value.astimezone(UTC).isoformat().replace("+00:00", "Z")
    if isinstance(value, date | time):
        return value.isoformat()
    if isinstance(value, str):
        return json.dumps(value, ensure_ascii=False).replace("\x7f", "\\u007f")
    if isinstance(value, list | tuple):
        if any(isinstance(v, Mapping) for v in value):
            raise TomlError("objects within inline arrays have no form")
        return "[" + ", ".join(_scalar(v, preserve) for v in value) + "]"
    raise TomlError(f"{type(value).__name__} has no form")


def _is_tables(value: Any) -> bool:
    if not isinstance(value, list) or not value or not any(isinstance(v, Mapping) for v in value):
        return False
    if not all(isinstance(v, Mapping) for v in value):
        raise TomlError("arrays can't mix objects and other values")
    return True


def encode(value: Mapping[str, Any], given: Mapping[str, Any] | None = None) -> str:
    """Inline keys first, then tables, then arrays of tables."""
    o = checked_options(given, {"sortKeys": False, "datetime": "rfc3339"}, "toml")
    if o["datetime"] not in ("rfc3339", "preserve"):
        raise TomlError("datetime must be rfc3339 or preserve")
    if not isinstance(value, Mapping):
        raise TomlError("the top must be an object")
    preserve = o["datetime"] == "preserve"
    out: list[str] = []

    def table(obj: Mapping[str, Any], path: tuple[str, ...]) -> None:
        items = sorted(obj.items()) if o["sortKeys"] else list(obj.items())
        for k, v in items:
            if not isinstance(v, Mapping) and not _is_tables(v):
                out.append(f"{_name(k)} = {_scalar(v, preserve)}")
        for k, v in items:
            if isinstance(v, Mapping):
                here = (*path, k)
                if out:
                    out.append("")
                out.append(f"[{'.'.join(map(_name, here))}]")
                table(v, here)
        for k, v in items:
            if _is_tables(v):
                for one in v:
                    here = (*path, k)
                    if out:
                        out.append("")
                    out.append(f"[[{'.'.join(map(_name, here))}]]")
                    table(one, here)

    table(value, ())
    return "\n".join(out) + ("\n" if out else "")
