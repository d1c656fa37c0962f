"""Functions for SQL: :func:`register` puts scalar (Arrow-batched) and table functions under names in a session."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from millrace.functions import csv_codec, toml_codec, urls, xml_codec, yaml_codec
from millrace.operators import article, cssx, dom, html_api, robots, sitemap


def _json(value: Any) -> str | None:
    return None if value is None else json.dumps(value, ensure_ascii=False, sort_keys=True)


def _css(html: str, pipeline: str, url: str) -> list[str | None]:
    return [cssx.as_text(x) for x in cssx.evaluate(dom.parse(html), pipeline, url)]


def _xpath(html: str, expression: str) -> list[str | None]:
    found = html_api.query(html_api.html_parse(html), expression, "xpath")
    return [cssx.as_text(x) for x in found]


#: Name: result type, function of one row. A null argument gives null.
SCALARS: dict[str, tuple[str, Callable[..., Any]]] = {
    "css_query": ("array<string>", _css),
    "css_count": ("bigint", lambda html, selector: len(_css(html, selector, ""))),
    "xpath_query": ("array<string>", _xpath),
    "csv_decode": ("string", lambda text, options: _json(csv_codec.decode(text, json.loads(options)))),
    "csv_encode": ("string", lambda rows, options: csv_codec.encode(json.loads(rows), json.loads(options))),
    "xml_decode": ("string", lambda text: _json(xml_codec.decode(text))),
    "xml_encode": ("string", lambda value: xml_codec.encode(json.loads(value))),
    "yaml_decode": ("string", lambda text: _json(yaml_codec.decode(text))),
    "yaml_encode": ("string", lambda value: yaml_codec.encode(json.loads(value))),
    "toml_decode": ("string", lambda text: _json(toml_codec.decode(text))),
    "toml_encode": ("string", lambda value: toml_codec.encode(json.loads(value))),
    "robots_allows": ("boolean", lambda text, path, agent: robots.allows(robots.parse(text), path, agent)),
    "robots_match": (robots.MATCH_SCHEMA, lambda text, path, agent: robots.match(robots.parse(text), path, agent)),
    "article_extract": (f"struct<{article.SCHEMA.replace(' ', ':').replace(',:', ',')}>", lambda html, url: article.extract(html, url)),
    "article_text": ("string", lambda html: article.extract(html)["text"]),
    "article_markdown": ("string", lambda html: article.extract(html)["markdown"]),
    "resolve_url": ("string", urls.absolute),
    "to_number": ("double", cssx.to_number),
    "to_date_utc": ("string", cssx.to_date),
}


def _vectorised(f: Callable[..., Any], as_frame: bool) -> Callable[..., Any]:
    def run(*columns: pd.Series) -> Any:
        rows = [None if any(x is None or x is pd.NA or isinstance(x, float) and x != x for x in r) else f(*r) for r in zip(*columns)]
        if as_frame:
            return pd.DataFrame([r if r is not None else {} for r in rows])
        return pd.Series(rows, dtype=object)

    return run


class NodeTable:
    """``dom_nodes(html)``: the node table of one page."""

    def eval(self, html: str) -> Iterator[tuple]:
        if html is not None:
            yield from dom.node_rows(html)


class CsvRecords:
    """``csv_records(text, options)``: ``(record_no, values)``, objects as maps."""

    def eval(self, text: str, options: str) -> Iterator[tuple]:
        if text is not None:
            for n, x in csv_codec.iter_objects(text, json.loads(options or "{}")):
                yield n, {k: None if v is None else cssx.text_of(v) for k, v in x.items()}


class XmlEvents:
    """``xml_events(text)``: ``(event_no, type, name, attrs, value)``."""

    def eval(self, text: str) -> Iterator[tuple]:
        if text is not None:
            for n, e in enumerate(xml_codec.iter_events(text)):
                yield n, e["type"], e.get("name"), e.get("attrs"), e.get("value")


class YamlDocuments:
    """``yaml_documents(text)``: ``(doc_no, value)`` with values as JSON."""

    def eval(self, text: str) -> Iterator[tuple]:
        if text is not None:
            for n, x in enumerate(yaml_codec.decode_all(text)):
                yield n, _json(x)


class SitemapEntries:
    """``sitemap_entries(body, source)``: ``(loc, lastmod, changefreq, priority)`` of one document."""

    def eval(self, body: str, source: str) -> Iterator[tuple]:
        if body is not None:
            for x in sitemap.parse(body, source or "")["urls"]:
                yield x["loc"], x["lastmod"], x["changefreq"], x["priority"]


TABLES: dict[str, tuple[type, str]] = {
    "dom_nodes": (NodeTable, dom.NODE_SCHEMA),
    "csv_records": (CsvRecords, "record_no int, record map<string,string>"),
    "xml_events": (XmlEvents, "event_no int, type string, name string, attrs map<string,string>, value string"),
    "yaml_documents": (YamlDocuments, "doc_no int, value string"),
    "sitemap_entries": (SitemapEntries, sitemap.ENTRY),
}


def register(spark: SparkSession, prefix: str = "") -> list[str]:
    """Registers all functions as ``<prefix><name>`` and gives the names."""
    for name, (kind, f) in SCALARS.items():
        spark.udf.register(prefix + name, F.pandas_udf(_vectorised(f, kind.startswith("struct")), kind, F.PandasUDFType.SCALAR))
    for name, (handler, schema) in TABLES.items():
        spark.udtf.register(prefix + name, F.udtf(handler, returnType=schema))
    return [prefix + n for n in (*SCALARS, *TABLES)]
