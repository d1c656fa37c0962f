"""All functions by name. Names of live-browser functions are there, too, and refuse to run."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from millrace.functions import chat, csv_codec, jwt, oauth2, toml_codec, xml_codec, yaml_codec
from millrace.operators import article, html_api, robots, sitemap
from millrace.sources import archive, pdf, redis_template, rest, sql_handle, xlsx


def _method(name: str) -> Callable[..., Any]:
    return lambda handle, *args, **named: getattr(handle, name)(*args, **named)


def _open_pdf(path: str) -> list[dict[str, Any]]:
    with open(path, "rb") as f:
        return pdf.pages(f.read())


def _fetch_page(url: str, fetch: Callable[[str], str | bytes]) -> html_api.HtmlPage:
    """A page from a transport that the caller brings: a table look-up, a cache or an HTTP client."""
    return html_api.html_parse(fetch(url), url)


def _can_fetch(url: str, status: Callable[[str], int]) -> bool:
    try:
        return 200 <= status(url) < 300
    except OSError:
        return False


FUNCTIONS: dict[str, Callable[..., Any]] = {
    "CSV::DECODE": csv_codec.decode, "CSV::DECODE_ROWS": csv_codec.decode_rows, "CSV::DECODE_STREAM": csv_codec.iter_objects, "CSV::DECODE_ROWS_STREAM": csv_codec.iter_rows, "CSV::ENCODE": csv_codec.encode,
    "XML::ROOT": xml_codec.root, "XML::TEXT": xml_codec.text, "XML::CHILDREN": xml_codec.children, "XML::ATTR": xml_codec.attr, "XML::DECODE": xml_codec.decode, "XML::DECODE_STREAM": xml_codec.iter_events, "XML::ENCODE": xml_codec.encode,
    "YAML::DECODE": yaml_codec.decode, "YAML::DECODE_ALL": yaml_codec.decode_all, "YAML::ENCODE": yaml_codec.encode, "TOML::DECODE": toml_codec.decode, "TOML::ENCODE": toml_codec.encode,
    "WEB::ROBOTS::PARSE": robots.parse, "WEB::ROBOTS::ALLOWS": robots.allows, "WEB::ROBOTS::MATCH": robots.match, "WEB::ROBOTS::SITEMAPS": robots.sitemaps,
    "WEB::SITEMAP::FETCH": lambda url, fetch: sitemap.parse(fetch(url), url), "WEB::SITEMAP::URLS": sitemap.urls, "WEB::SITEMAP::STREAM": sitemap.stream,
    "WEB::ARTICLE::EXTRACT": article.extract, "WEB::ARTICLE::TEXT": lambda x, *a: article.extract(x, *a)["text"], "WEB::ARTICLE::MARKDOWN": lambda x, *a: article.extract(x, *a)["markdown"],
    "WEB::HTML::OPEN": _fetch_page, "DOCUMENT": _fetch_page, "WEB::HTML::CAN_OPEN": _can_fetch, "DOCUMENT_EXISTS": _can_fetch, "DOWNLOAD": lambda url, fetch: fetch(url),
    "IS_HTML_ELEMENT": html_api.is_html_element, "IS_HTML_DOCUMENT": html_api.is_html_document, "URL": html_api.url, "BASE_URL": html_api.base_url, "RESOLVE_URL": html_api.resolve_url, "X": html_api.x, "XPATH": html_api.evaluate_xpath,
    "FRAMES": html_api.frames, "ATTR_GET": html_api.attr_get, "ATTR_QUERY": html_api.attr_query, "ATTR_REMOVE": html_api.attr_remove, "ATTR_SET": html_api.attr_set, "COOKIE_GET": html_api.cookie_get,
    "ELEMENT": html_api.element, "ELEMENT_EXISTS": html_api.element_exists, "ELEMENTS": html_api.elements, "ELEMENTS_COUNT": html_api.elements_count, "INNER_HTML": html_api.inner_html, "INNER_HTML_SET": html_api.inner_html_set, "INNER_HTML_ALL": html_api.inner_html_all,
    "INNER_TEXT": html_api.inner_text, "INNER_TEXT_SET": html_api.inner_text_set, "INNER_TEXT_ALL": html_api.inner_text_all, "PARSE": html_api.html_parse, "STYLE_GET": html_api.style_get, "STYLE_REMOVE": html_api.style_remove, "STYLE_SET": html_api.style_set,
    "DB::POSTGRES::OPEN": sql_handle.PostgresDatabase, "DB::SQLITE::OPEN": sql_handle.SqliteDatabase, "DB::REDIS::OPEN": redis_template.RedisConnection,
    **{f"DB::{db}::{name.upper()}": _method(name) for db in ("POSTGRES", "SQLITE") for name in ("close", "begin", "commit", "rollback")}, "DB::REDIS::CLOSE": _method("close"),
    "DOCUMENT::XLSX::CREATE": xlsx.Workbook, "DOCUMENT::XLSX::OPEN": xlsx.Workbook.open, **{f"DOCUMENT::XLSX::{n.upper()}": _method(n) for n in ("sheets", "save", "close", "sheet", "add_sheet", "delete_sheet", "get", "range", "append", "save_as", "set", "write_range")},
    "DOCUMENT::PDF::OPEN": _open_pdf, "ARCHIVE::LIST": archive.list_entries, "ARCHIVE::READ": archive.read_entry, "ARCHIVE::EXTRACT": archive.extract, "NET::REST::CLIENT": rest.RestClient,
    "SECURITY::JWT::INSPECT": jwt.inspect, "SECURITY::JWT::VERIFY": jwt.verify, "SECURITY::JWT::SIGN": jwt.sign, "SECURITY::JWT::HMAC_KEY": jwt.hmac_key, "SECURITY::JWT::PUBLIC_KEY": jwt.public_key, "SECURITY::JWT::PRIVATE_KEY": jwt.private_key,
    "SECURITY::OAUTH2::DISCOVER": oauth2.discover, "SECURITY::OAUTH2::PROVIDER": oauth2.provider, "SECURITY::OAUTH2::CLIENT": oauth2.client, **{f"SECURITY::OAUTH2::{n.upper()}": _method(n) for n in ("client_credentials", "refresh", "token", "access_token", "refresh_token", "id_token", "expired", "valid_for", "auth_header")},
    "SECURITY::OAUTH2::TOKEN_TYPE": lambda t: t.tokenType, "SECURITY::OAUTH2::SCOPES": lambda t: list(t.scopes), "SECURITY::OAUTH2::EXPIRES_AT": lambda t: t.expiresAt,
    "AI::LLM::MODEL": chat.model, "AI::LLM::SESSION": chat.Session, **{f"AI::LLM::{n.upper()}": _method(n) for n in ("generate", "chat", "summarize", "extract", "classify", "reset", "fork", "history")},
    **{name: html_api.browser_only(name) for name in html_api.BROWSER_ONLY},
}
