"""Further queries of the catalog: functions by their registered names, and selection operations, each over every row of a table."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.catalog import DECODED, H1, HREFS, mapped, register, spread, table
from millrace.functions.registry import FUNCTIONS
from millrace.operators import cssx, html_api

ARROW = {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}
LINKS = "list_transform(regexp_extract_all(html, '<a href=\"[^\"]*\">([^<]*)</a>', 1), lambda x: " + DECODED.format("x") + ")"
#: How ``&`` and non-breaking blanks alone are written in texts.
ESCAPED = "replace({}, '&', '&amp;')"


def call(name: str, *args: Any) -> Any:
    return FUNCTIONS[name](*args)


def by_row(df: DataFrame, inputs: list[str], to: dict[str, str], f: Callable[..., tuple], keep: list[str]) -> DataFrame:
    return mapped(df, inputs, [(n, k, ARROW[k]) for n, k in to.items()], f).select(*keep, *to)


# --- selection operations ---


@register(
    f"""WITH h AS (SELECT page_id, html, {HREFS} AS a, {LINKS} AS t, {H1} AS h1 FROM pages)
SELECT page_id, array_to_string(t, '|') AS texts, array_to_string(t, '|') AS own_texts, array_to_string(list_transform(t, lambda x: {ESCAPED.format('x')}), '|') AS inner_html,
regexp_extract(html, '<li><a href="[^"]*">', 0) AS outer_html, CAST(len(regexp_extract_all(html, '<a href=')) AS VARCHAR) AS with_attr, CAST(len(list_filter(t, lambda x: contains(x, 'an'))) AS VARCHAR) AS with_text,
CAST(len(regexp_extract_all(html, '<li>')) AS VARCHAR) AS children, CAST(len(regexp_extract_all(html, '</li><li>')) AS VARCHAR) AS prev,
CAST(len(regexp_extract_all(html, '<li>')) * (len(regexp_extract_all(html, '<li>')) - 1) AS VARCHAR) AS siblings, CAST(len(list_distinct(a)) AS VARCHAR) AS by_attr, CAST(len(list_distinct(t)) AS VARCHAR) AS by_text,
trim(regexp_replace(h1, '\\s+', ' ', 'g')) AS normalized, regexp_replace(h1, '^\\s+|\\s+$', '', 'g') AS trimmed, CAST(octet_length(encode(h1)) AS VARCHAR) AS length, CAST(len(a) AS VARCHAR) AS many FROM h"""
)
def css_more(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps, filters, traversals and reducers that the other page queries leave out."""
    names = {
        "texts": ':join("|", :text(a))', "own_texts": ':join("|", :ownText(a))', "inner_html": ':join("|", :html(a))', "outer_html": ":outerHtml(:first(li))", "with_attr": ':count(:withAttr("href", a))',
        "with_text": ':count(:withText("an", a))', "children": ":count(:children(ul))", "prev": ":count(:prev(li))", "siblings": ":count(:siblings(li))", "by_attr": ':count(:dedupeByAttr("href", a))',
        "by_text": ":count(:dedupeByText(a))", "normalized": ":normalize(:text(:first(h1)))", "trimmed": ":trim(:text(:first(h1)))", "length": ":len(:text(:first(h1)))", "many": ":len(a)",
    }
    found = cssx.query(table(spark, sf_dir, "pages"), names)
    first = lambda c: F.try_element_at(F.col(c), F.lit(1))
    return found.select("page_id", *[(F.regexp_substr(first(c), F.lit('^<li><a href="[^"]*">')) if c == "outer_html" else first(c)).alias(c) for c in names])


@register(
    f"""WITH h AS (SELECT page_id, url, {HREFS} AS a, {H1} AS h1 FROM pages)
SELECT page_id, array_to_string(list_transform(a, lambda x: regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || x), '|') AS absolute, replace(h1, 'an', 'AN') AS replaced, nullif(regexp_extract(h1, '[a-z]+', 0), '') AS matched FROM h"""
)
def css_text_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"absolute": ':join("|", :absUrl(:attr("href", a)))', "replaced": ':replace("an", "AN", :text(:first(h1)))', "matched": ':regex("[a-z]+", :text(:first(h1)))'}
    found = cssx.query(table(spark, sf_dir, "pages"), names)
    return found.select("page_id", *[F.try_element_at(F.col(c), F.lit(1)).alias(c) for c in names])


# --- page functions by name ---


@register(
    f"""WITH h AS (SELECT *, {LINKS} AS t, {H1} AS h1, len(regexp_extract_all(html, '<li>')) AS n FROM pages)
SELECT page_id, true AS is_document, url AS own_url, url AS base, CAST(n AS BIGINT) AS items, len(regexp_extract_all(html, '<table')) > 0 AS has_table, array_to_string(t, '|') AS texts,
array_to_string(list_transform(t, lambda x: {ESCAPED.format('x')}), '|') AS inner_html, h1 || '!' AS text_set, '<b>' || page_id || '</b>' AS html_set, page_id || ' ' || url AS attrs, CAST(n AS BIGINT) AS by_xpath,
t[1] AS one, t[1] AS value, n > 0 AS some, CAST(page_id AS VARCHAR) AS cookie, 'color ' || page_id AS styles, CAST(0 AS BIGINT) AS frames, 'Copy' AS fetched, url LIKE 'http://%' AS opens FROM h"""
)
def html_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions on documents and elements, called by their names; what is set is read back."""

    def one(page_id: int, url: str, html: str) -> tuple:
        page = call("WEB::HTML::OPEN", url, lambda _: html)
        h1, plain, first = call("ELEMENT", page, "h1"), call("INNER_TEXT_ALL", page, "li a"), call("ELEMENT", page, "nav")
        call("INNER_TEXT_SET", h1, call("INNER_TEXT", h1) + "!")
        call("INNER_HTML_SET", first, f"<b>{page_id}</b>")
        call("ATTR_SET", first, {"data-a": str(page_id), "data-b": url, "data-c": "x"})
        call("ATTR_REMOVE", first, "data-c")
        attrs = call("ATTR_GET", first, "data-a", "data-b", "data-c")
        call("STYLE_SET", first, {"color": "red", "order": page_id})
        call("STYLE_REMOVE", first, "color")
        kept = call("STYLE_GET", first, "color", "order")
        whole = call("PARSE", html, url, [{"name": "id", "value": str(page_id)}])
        links = call("ELEMENTS", whole, call("X", "//li/a"))
        return (
            call("IS_HTML_DOCUMENT", page), call("URL", page), call("BASE_URL", page), call("ELEMENTS_COUNT", whole, "li"), call("ELEMENT_EXISTS", whole, "table"), "|".join(plain), "|".join(call("INNER_HTML_ALL", whole, "li a")),
            call("INNER_TEXT", page, "h1"), call("INNER_HTML", page, "nav"), " ".join(attrs.values()), len(links), html_api.query_one(whole, "li a").text(), call("INNER_TEXT", html_api.query_one(whole, "li a")), html_api.query_exists(whole, "li"),
            call("COOKIE_GET", whole, "id")["value"], f"color {int(float(kept['order']))}" if "color" not in kept else "kept", len(call("FRAMES", whole, "url", ".*")), call("DOWNLOAD", url, lambda _: "Copy"), call("WEB::HTML::CAN_OPEN", url, lambda u: 200 if u.startswith("http://") else 404),
        )

    to = {"is_document": "boolean", "own_url": "string", "base": "string", "items": "bigint", "has_table": "boolean", "texts": "string", "inner_html": "string", "text_set": "string", "html_set": "string", "attrs": "string", "by_xpath": "bigint", "one": "string", "value": "string", "some": "boolean", "cookie": "string", "styles": "string", "frames": "bigint", "fetched": "string", "opens": "boolean"}
    return by_row(table(spark, sf_dir, "pages").select("page_id", "url", "html"), ["page_id", "url", "html"], to, one, ["page_id"])


@register(
    """SELECT p_partkey, p_name AS title, p_brand AS byline, strftime(DATE '1995-01-01' + CAST(p_partkey % 900 AS INTEGER), '%Y-%m-%d') AS published, 'A note on part ' || p_partkey AS excerpt,
contains(lower(p_name), lower(p_name)) AS in_text, length(p_name) > 0 AS in_markdown FROM part"""
)
def article_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata, text and Markdown of a page made from each part."""

    def one(key: int, name: str, brand: str, day: str) -> tuple:
        words = f"The goods of part {key} left the store in the morning, and the clerk wrote their numbers into the book before noon."
        markup = f'<html><head><title>{name}</title><meta property="article:published_time" content="{day}"><meta name="author" content="{brand}"><meta name="description" content="A note on part {key}"></head><body><nav><a href="/">Home</a></nav><article><h1>{name}</h1><p>{words}</p><p>{words} {words}</p></article></body></html>'
        found = call("WEB::ARTICLE::EXTRACT", markup)
        return found["title"], found["byline"], (found["publishedAt"] or "")[:10], found["excerpt"], words in " ".join(call("WEB::ARTICLE::TEXT", markup).split()) and "Home" not in found["text"], words in " ".join(call("WEB::ARTICLE::MARKDOWN", markup).split())

    src = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", F.date_format(F.date_add(F.lit("1995-01-01").cast("date"), (F.col("p_partkey") % 900).cast("int")), "yyyy-MM-dd").alias("day"))
    to = {"title": "string", "byline": "string", "published": "string", "excerpt": "string", "in_text": "boolean", "in_markdown": "boolean"}
    return by_row(spread(src), ["p_partkey", "p_name", "p_brand", "day"], to, one, ["p_partkey"])


# --- codecs, tokens, sessions, peers ---


@register("SELECT p_partkey, p_name || '|' || p_size AS streamed, p_name || '|' || p_size AS rowed, CAST(2 AS BIGINT) AS n, 'start ' || p_name || ' end' AS events, p_brand || ',' || p_size AS documents FROM part")
def codec_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row, event and document forms of the CSV, XML and YAML decoders."""

    def one(key: int, name: str, size: int, brand: str) -> tuple:
        text = call("CSV::ENCODE", [{"name": name, "size": size}])
        objects, rows, again = list(call("CSV::DECODE_STREAM", text)), call("CSV::DECODE_ROWS", text), list(call("CSV::DECODE_ROWS_STREAM", text))
        kinds = list(call("XML::DECODE_STREAM", call("XML::ENCODE", {"type": "element", "name": "p", "attrs": {}, "children": [{"type": "text", "value": name}]})))
        said = " ".join({"startelement": "start", "endelement": "end"}.get(str(e["type"]).lower().replace("_", ""), e.get("value") or "") for e in kinds)
        docs = call("YAML::DECODE_ALL", call("YAML::ENCODE", {"brand": brand}) + "\n---\n" + call("YAML::ENCODE", {"size": size}))
        return "|".join(map(str, objects[0][1].values())), "|".join(map(str, rows[-1])), len(again), said, f"{docs[0]['brand']},{docs[1]['size']}"

    to = {"streamed": "string", "rowed": "string", "n": "bigint", "events": "string", "documents": "string"}
    return by_row(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_brand"), ["p_partkey", "p_name", "p_size", "p_brand"], to, one, ["p_partkey"])


@register("SELECT c_custkey, c_name AS sub, c_custkey % 2 = 0 AS verified, 'Bearer t' || c_custkey AS header, 'r' || c_custkey AS refreshed, 'Bearer' AS kind, 'a ' || c_mktsegment AS scopes FROM customer")
def token_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens signed with one of two keys and verified with one; OAuth 2 grants from an injected transport."""

    def one(key: int, name: str, segment: str) -> tuple:
        token = call("SECURITY::JWT::SIGN", {"sub": name}, call("SECURITY::JWT::HMAC_KEY", "even" if key % 2 == 0 else "odd"))
        try:
            good = call("SECURITY::JWT::VERIFY", token, call("SECURITY::JWT::HMAC_KEY", "even"), {"algorithms": ["HS256"]})["verified"]
        except ValueError:
            good = False
        provider = call("SECURITY::OAUTH2::PROVIDER", {"issuer": "https://id.example", "tokenEndpoint": "https://id.example/token"})
        answer = {"access_token": f"t{key}", "refresh_token": f"r{key}", "token_type": "Bearer", "expires_in": 60, "scope": f"a {segment}"}
        client = call("SECURITY::OAUTH2::CLIENT", provider, {"clientID": "c", "clientSecret": "s"}, lambda *_, **__: (200, json.dumps(answer)))
        got = call("SECURITY::OAUTH2::CLIENT_CREDENTIALS", client)
        return call("SECURITY::JWT::INSPECT", token)["claims"]["sub"], good, call("SECURITY::OAUTH2::AUTH_HEADER", got)["Authorization"], call("SECURITY::OAUTH2::REFRESH_TOKEN", got), call("SECURITY::OAUTH2::TOKEN_TYPE", got), " ".join(call("SECURITY::OAUTH2::SCOPES", got))

    to = {"sub": "string", "verified": "boolean", "header": "string", "refreshed": "string", "kind": "string", "scopes": "string"}
    return by_row(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), ["c_custkey", "c_name", "c_mktsegment"], to, one, ["c_custkey"])


@register("SELECT n_nationkey, n_name AS kept, CAST(1 AS BIGINT) AS n, true AS some, true AS closed FROM nation")
def sqlite_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A database in memory for each row: what is committed stays, what is rolled back goes."""

    def one(key: int, name: str) -> tuple:
        db = call("DB::SQLITE::OPEN", {"path": ":memory:"})
        db.query("CREATE TABLE t (id INTEGER PRIMARY KEY, name TEXT)", dialect="sql_exec")
        work = call("DB::SQLITE::BEGIN", db)
        work.query("INSERT INTO t VALUES (?, ?)", [key, name], dialect="sql_exec")
        call("DB::SQLITE::COMMIT", work)
        work = call("DB::SQLITE::BEGIN", db)
        work.query("INSERT INTO t VALUES (?, ?)", [key + 1000, "gone"], dialect="sql_exec")
        call("DB::SQLITE::ROLLBACK", work)
        return db.query_one("SELECT name FROM t")["name"], db.query_count("SELECT * FROM t"), db.query_exists("SELECT * FROM t WHERE id = ?", [key]), call("DB::SQLITE::CLOSE", db)

    return by_row(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), ["n_nationkey", "n_name"], {"kept": "string", "n": "bigint", "some": "boolean", "closed": "boolean"}, one, ["n_nationkey"])


@register("SELECT n_nationkey, n_name AS cell, CAST(n_regionkey AS BIGINT) AS region, 'Sheet1,' || n_name AS sheets, 'Sheet1' AS left_over, true AS closed FROM nation")
def workbook_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A workbook for each row, in the tasks."""

    def one(key: int, name: str, region: int) -> tuple:
        book = call("DOCUMENT::XLSX::CREATE")
        sheet = call("DOCUMENT::XLSX::ADD_SHEET", book, name)
        call("DOCUMENT::XLSX::SET", sheet, "A1", name)
        call("DOCUMENT::XLSX::APPEND", sheet, [[key, region]])
        names = ",".join(call("DOCUMENT::XLSX::SHEETS", book))
        cell, line = call("DOCUMENT::XLSX::GET", call("DOCUMENT::XLSX::SHEET", book, name), "A1"), call("DOCUMENT::XLSX::RANGE", sheet, "A2:B2")
        call("DOCUMENT::XLSX::DELETE_SHEET", book, name)
        return cell, int(line[0][1]), names, ",".join(call("DOCUMENT::XLSX::SHEETS", book)), call("DOCUMENT::XLSX::CLOSE", book)

    to = {"cell": "string", "region": "bigint", "sheets": "string", "left_over": "string", "closed": "boolean"}
    return by_row(table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"), ["n_nationkey", "n_name", "n_regionkey"], to, one, ["n_nationkey"])


@register("SELECT n_nationkey, 'https://x.example/' || n_name || '.xml' AS maps, 'https://x.example/' || n_name AS fetched, 'https://x.example/' || n_name AS streamed, n_name <> 'NATION_3' AS allowed FROM nation")
def crawl_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Robots rules and sitemaps of a site for each row, from an injected transport."""

    def one(key: int, name: str) -> tuple:
        rules = call("WEB::ROBOTS::PARSE", f"User-agent: *\nDisallow: /NATION_3$\nSitemap: https://x.example/{name}.xml\n")
        body = f"<urlset><url><loc>https://x.example/{name}</loc></url></urlset>"
        where = call("WEB::ROBOTS::SITEMAPS", rules)[0]
        got = call("WEB::SITEMAP::FETCH", where, lambda _: body)
        return where, str(next(v for k, v in _flat(got) if k == "loc")), next(iter(call("WEB::SITEMAP::STREAM", where, lambda _: body)))["loc"], call("WEB::ROBOTS::ALLOWS", rules, f"/{name}")

    return by_row(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), ["n_nationkey", "n_name"], {"maps": "string", "fetched": "string", "streamed": "string", "allowed": "boolean"}, one, ["n_nationkey"])


def _flat(value: Any) -> list[tuple[str, Any]]:
    if isinstance(value, dict):
        return [x for k, v in value.items() for x in ([(k, v)] if not isinstance(v, dict | list) else _flat(v))]
    return [x for v in value for x in _flat(v)] if isinstance(value, list) else []
