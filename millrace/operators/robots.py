"""robots.txt: parsing, rule matching, and matching a table of paths."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import Any
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = "struct<groups:array<struct<userAgents:array<string>,allow:array<string>,disallow:array<string>,crawlDelay:double>>,sitemaps:array<string>,host:string>"
MATCH_SCHEMA = "struct<allowed:boolean,directive:string,pattern:string,userAgent:string>"
MAX_LINE = 1 << 20


def parse(text: str) -> dict[str, Any]:
    """Groups (consecutive agents share one until a rule seals it), sitemaps and host. Empty rules seal but aren't kept."""
    groups: list[dict[str, Any]] = []
    sitemaps: list[str] = []
    host, sealed = None, True
    for raw in text.removeprefix("﻿").splitlines():
        if len(raw.encode()) > MAX_LINE:
            raise ValueError("a line is over 1 MiB")
        name, colon, value = raw.partition("#")[0].partition(":")
        if not colon:
            continue
        name, value = name.strip().lower(), value.strip()
        if name == "user-agent":
            if not value:
                continue
            if sealed:
                groups.append({"userAgents": [], "allow": [], "disallow": [], "crawlDelay": None})
                sealed = False
            groups[-1]["userAgents"].append(value)
        elif name in ("allow", "disallow", "crawl-delay"):
            if not groups:
                continue
            sealed = True
            if name == "crawl-delay":
                try:
                    groups[-1]["crawlDelay"] = float(value)
                except ValueError:
                    pass
            elif value:
                groups[-1][name].append(value)
        elif name == "sitemap" and value:
            sitemaps.append(value)
        elif name == "host" and value and host is None:
            host = value
    return {"groups": groups, "sitemaps": sitemaps, "host": host}


_HEX = re.compile(r"%([0-9A-Fa-f]{2})")
_KEEP = set(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-._~!$&'()*+,;=:@/?%")


def canonical(path: str) -> str:
    """Percent-encoding in one form: unreserved octets plain, all others as upper-case escapes."""
    unreserved = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-._~"
    s = _HEX.sub(lambda m: chr(int(m[1], 16)) if int(m[1], 16) in unreserved else m[0].upper(), path)
    return "".join(chr(b) if b in _KEEP else f"%{b:02X}" for b in s.encode())


def path_of(target: str) -> str:
    """The path and query that rules are held against; the fragment goes, an absolute URL gives its path."""
    if re.match(r"[a-zA-Z][a-zA-Z0-9+.\-]*://", target):
        x = urlsplit(target)
        target = (x.path or "/") + (f"?{x.query}" if x.query else "")
    target = target.partition("#")[0]
    return canonical(target if target.startswith("/") else f"/{target}")


@lru_cache(maxsize=8192)
def _rule(pattern: str) -> tuple[re.Pattern, int]:
    """A pattern as an anchored expression, and its length in octets without wildcards."""
    end = pattern.endswith("$")
    body = canonical(pattern[:-1] if end else pattern)
    rx = "".join(".*" if c == "*" else re.escape(c) for c in re.sub(r"\*+", "*", body))
    return re.compile(rx + ("$" if end else ""), re.S), len(body.replace("*", "")) + end


def match(robots: dict[str, Any], target: str, user_agent: str | None = None) -> dict[str, Any]:
    """The rule in force: of the groups that name the agent exactly (whatever case; else ``*``) the longest match, ties to Allow, then file order."""
    path, agent = path_of(target), (user_agent or "*").strip().lower()
    default = {"allowed": True, "directive": None, "pattern": None, "userAgent": None}
    if path.partition("?")[0] == "/robots.txt":
        return default
    groups = robots.get("groups") or []
    named = [(g, a) for g in groups for a in g["userAgents"] if a.lower() == agent][:]
    chosen = named or [(g, a) for g in groups for a in g["userAgents"] if a == "*"]
    best: tuple[int, bool] | None = None
    out, seen = default, set()
    for g, a in chosen:
        if id(g) in seen:
            continue
        seen.add(id(g))
        for kind in ("allow", "disallow"):
            for pattern in g[kind] or ():
                rx, length = _rule(pattern)
                if rx.match(path) and (best is None or (length, kind == "allow") > best):
                    best = (length, kind == "allow")
                    out = {"allowed": kind == "allow", "directive": kind, "pattern": pattern, "userAgent": a}
    return out


def allows(robots: dict[str, Any], target: str, user_agent: str | None = None) -> bool:
    return match(robots, target, user_agent)["allowed"]


def sitemaps(robots: dict[str, Any]) -> list[str]:
    return list(robots.get("sitemaps") or ())


def match_paths(targets: DataFrame, text: str, column: str = "url", user_agent: str | None = None) -> DataFrame:
    """``targets`` with a struct ``match`` of one robots.txt; null targets have a null match. No shuffle."""
    robots = parse(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("allowed", pa.bool_()), ("directive", pa.string()), ("pattern", pa.string()), ("userAgent", pa.string())])
        for batch in batches:
            found = [None if x is None else match(robots, x, user_agent) for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], names=[*batch.schema.names, "match"])

    kinds = targets.schema.simpleString()[len("struct<") : -1]
    return targets.mapInArrow(run, f"{kinds}, match {MATCH_SCHEMA}")
