"""Sitemaps: one document, and the walk over a tree of them, on the driver by demand or as a table of bodies level by level."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from typing import Any
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions.errors import checked_options
from millrace.functions.xml_codec import XmlError, iter_events

DEFAULTS = {"recursive": True, "dedupe": True, "maxDepth": 8, "timeout": 30_000, "headers": None}
Fetch = Callable[[str], str | bytes]


class SitemapError(ValueError):
    pass


def parse(body: str | bytes, source: str = "") -> dict[str, Any]:
    """``{"type": "urlset" | "index", "urls": [...], "sitemaps": [...]}``; ``loc`` is needed, ``priority`` must be a number, fields hold text only."""
    out: dict[str, Any] = {"type": None, "urls": [], "sitemaps": []}
    path: list[str] = []
    entry: dict[str, Any] | None = None
    value: list[str] = []
    try:
        for e in iter_events(body):
            if e["type"] == "startElement":
                name = e["name"].rpartition(":")[2]
                path.append(name)
                if len(path) == 1:
                    out["type"] = {"urlset": "urlset", "sitemapindex": "index"}.get(name)
                    if out["type"] is None:
                        raise SitemapError(f"unknown root {name!r}")
                elif len(path) == 2:
                    entry = {} if name == ("url" if out["type"] == "urlset" else "sitemap") else None
                elif len(path) == 3:
                    value = []
                elif len(path) == 4 and entry is not None and path[2] in ("loc", "lastmod", "changefreq", "priority"):
                    raise SitemapError(f"elements within {path[2]}")
            elif e["type"] == "text":
                if len(path) == 3:
                    value.append(e["value"])
            else:
                if len(path) == 3 and entry is not None:
                    entry.setdefault(path[2], "".join(value).strip())
                elif len(path) == 2 and entry is not None:
                    if not entry.get("loc"):
                        raise SitemapError("an entry has no loc")
                    if out["type"] == "urlset":
                        try:
                            priority = float(entry["priority"]) if entry.get("priority") else None
                        except ValueError:
                            raise SitemapError(f"bad priority {entry['priority']!r}") from None
                        out["urls"].append({"loc": entry["loc"], "lastmod": entry.get("lastmod") or None, "changefreq": entry.get("changefreq") or None, "priority": priority, "source": source})
                    else:
                        out["sitemaps"].append({"loc": urljoin(source, entry["loc"]), "lastmod": entry.get("lastmod") or None})
                    entry = None
                path.pop()
    except XmlError as e:
        raise SitemapError(str(e)) from None
    return out


def stream(url: str, fetch: Fetch, given: Mapping[str, Any] | None = None) -> Iterator[dict[str, Any]]:
    """Entries in pre-order, fetched as they are asked for. A map within itself is skipped; too deep a tree is an error."""
    o = checked_options(given, DEFAULTS, "sitemap")
    if not isinstance(o["maxDepth"], int) or o["maxDepth"] < 0:
        raise SitemapError("maxDepth must be a whole number")
    seen: set[str] = set()
    maps: set[str] = set()
    stack: list[tuple[str, int, tuple[str, ...]]] = [(url, 0, ())]
    while stack:
        at, depth, above = stack.pop()
        if at in above or o["dedupe"] and at in maps:
            continue
        if depth > o["maxDepth"]:
            raise SitemapError(f"deeper than {o['maxDepth']}: {at}")
        maps.add(at)
        doc = parse(fetch(at), at)
        for entry in doc["urls"]:
            if not o["dedupe"] or entry["loc"] not in seen:
                seen.add(entry["loc"])
                yield entry
        if o["recursive"]:
            stack.extend((s["loc"], depth + 1, (*above, at)) for s in reversed(doc["sitemaps"]))


def urls(url: str, fetch: Fetch, given: Mapping[str, Any] | None = None) -> list[dict[str, Any]]:
    return list(stream(url, fetch, given))


ENTRY = "loc string, lastmod string, changefreq string, priority double"


def walk_table(bodies: DataFrame, start: str, max_depth: int = 8, dedupe: bool = True) -> DataFrame:
    """The tree below ``start`` over ``bodies(url, body)``: ``(place, source, loc, lastmod, changefreq, priority)``, in the order of ``place``.

    Bodies are parsed once, in parallel. Levels are joined one by one, ``max_depth`` times at most; only children's addresses move. ``place``
    is the path of positions, so that its order is the walk's. Maps that a path already holds are skipped; a deeper one raises.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for url, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                doc = parse(body, url)
                rows += [(url, i, True, s["loc"], s["lastmod"], None, None) for i, s in enumerate(doc["sitemaps"])]
                rows += [(url, i, False, u["loc"], u["lastmod"], u["changefreq"], u["priority"]) for i, u in enumerate(doc["urls"])]
            if rows:
                kinds = (pa.string(), pa.int32(), pa.bool_(), pa.string(), pa.string(), pa.string(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["source", "at", "is_map", "loc", "lastmod", "changefreq", "priority"])

    parsed = bodies.select("url", "body").where("body is not null").mapInArrow(read, f"source string, at int, is_map boolean, {ENTRY}").cache()
    edges = parsed.where("is_map").select("source", "at", "loc")
    level = bodies.sparkSession.createDataFrame([(start, [], [start])], "url string, place array<int>, above array<string>")
    levels = [level]
    for depth in range(max_depth + 1):
        nxt = level.join(edges, level.url == edges.source).where(~F.array_contains("above", F.col("loc")))
        level = nxt.select(F.col("loc").alias("url"), F.concat("place", F.array("at")).alias("place"), F.concat("above", F.array("loc")).alias("above"))
        if depth == max_depth:
            deepest = level.first()
            if deepest is not None:
                raise SitemapError(f"deeper than {max_depth}: {deepest.url}")
        else:
            levels.append(level)
    every = levels[0]
    for one in levels[1:]:
        every = every.unionByName(one)
    rows = every.join(parsed.where("not is_map"), every.url == parsed.source).select(F.concat("place", F.array("at")).alias("place"), "source", "loc", "lastmod", "changefreq", "priority")
    if dedupe:
        rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("loc").orderBy("place"))).where("n = 1").drop("n")
    return rows
