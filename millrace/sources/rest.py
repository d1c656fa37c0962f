"""A REST client over an injected transport, and calls for a table of requests."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field
from typing import Any
from urllib.parse import urlencode, urljoin, urlsplit

from pyspark.sql import DataFrame

from millrace.functions.errors import checked_options

#: ``(method, url, headers, body, timeout in ms)`` to ``(status, headers, body)``.
Transport = Callable[[str, str, dict[str, str], bytes | None, int], tuple[int, list[tuple[str, str]], bytes]]
METHODS = {"GET", "HEAD", "POST", "PUT", "PATCH", "DELETE", "OPTIONS"}
ENCODINGS = {"json": "application/json", "form": "application/x-www-form-urlencoded", "text": "text/plain; charset=utf-8", "binary": "application/octet-stream"}
CONFIG = {"baseUrl": None, "headers": None, "encoding": "json", "requestEncoding": None, "responseEncoding": None, "timeout": 30_000, "response": "body", "errorMode": "raise"}
EXECUTION = ("requestEncoding", "responseEncoding", "timeout", "response", "errorMode", "encoding")


class RestError(RuntimeError):
    pass


def encode_body(value: Any, encoding: str) -> bytes | None:
    if value is None:
        return None
    if encoding == "json":
        return json.dumps(value, separators=(",", ":"), ensure_ascii=False).encode()
    if encoding == "form":
        if not isinstance(value, Mapping):
            raise RestError("a form body must be an object")
        return urlencode([(k, x) for k, v in value.items() for x in (v if isinstance(v, list) else [v])]).encode()
    return value if isinstance(value, bytes) else str(value).encode()


def decode_body(data: bytes, encoding: str | None, content_type: str) -> Any:
    """By ``encoding``, else by the content type; JSON keeps integers and floats apart; an empty body is None."""
    if not data:
        return None
    if encoding is None:
        encoding = "json" if "json" in content_type else "text" if content_type.startswith("text/") or not content_type else "binary"
    return json.loads(data) if encoding == "json" else data.decode("utf-8", "replace") if encoding in ("text", "form") else data


@dataclass
class RestClient:
    config: Mapping[str, Any]
    transport: Transport
    _o: dict[str, Any] = field(init=False, repr=False)

    def __post_init__(self) -> None:
        self._o = checked_options(self.config, CONFIG, "rest client")
        if urlsplit(self._o["baseUrl"] or "").scheme not in ("http", "https"):
            raise ValueError("baseUrl must be an http(s) URL")
        for k in ("encoding", "requestEncoding", "responseEncoding"):
            if self._o[k] is not None and self._o[k] not in ENCODINGS:
                raise ValueError(f"unknown {k}")

    def __repr__(self) -> str:
        return f"<rest client {urlsplit(self._o['baseUrl']).hostname}>"

    def query(self, path: str, request: Mapping[str, Any] | None = None, options: Mapping[str, Any] | None = None) -> list[Any]:
        """Results as a list; the items of a body that is one, in ``body`` mode."""
        r = checked_options(request, {"method": "GET", "query": None, "headers": None, "body": None}, "rest request")
        o = {**self._o, **{k: v for k, v in checked_options(options, dict.fromkeys(EXECUTION), "rest options").items() if v is not None}}
        method = str(r["method"]).upper()
        if method not in METHODS:
            raise ValueError(f"unknown method {method!r}")
        base = o["baseUrl"] if o["baseUrl"].endswith("/") else o["baseUrl"] + "/"
        url = urljoin(base, path.lstrip("/"))
        if urlsplit(url)[:2] != urlsplit(base)[:2]:
            raise ValueError("the path leaves the base URL")
        if r["query"]:
            url += ("&" if "?" in url else "?") + urlencode([(k, x) for k, v in r["query"].items() for x in (v if isinstance(v, list) else [v]) if x is not None])
        sent = o["requestEncoding"] or o["encoding"]
        headers = {**({"content-type": ENCODINGS[sent]} if r["body"] is not None else {}), **{k.lower(): str(v) for k, v in {**(o["headers"] or {}), **(r["headers"] or {})}.items()}}
        status, got, data = self.transport(method, url, headers, encode_body(r["body"], sent), int(o["timeout"]))
        many: dict[str, list[str]] = {}
        for k, v in got:
            many.setdefault(k.lower(), []).append(v)
        ok = 200 <= status < 300
        if not ok and o["errorMode"] == "raise":
            raise RestError(f"{method} {urlsplit(url).path}: status {status}")
        body = decode_body(data, o["responseEncoding"], many.get("content-type", [""])[0])
        if o["response"] == "full":
            return [{"ok": ok, "status": status, "headers": {k: v[0] if len(v) == 1 else v for k, v in many.items()}, "body": body, "url": url}]
        return body if isinstance(body, list) else [body]


def call_each(requests: DataFrame, config: Mapping[str, Any], transport: Transport, path: str = "path") -> DataFrame:
    """``(path, status, body)`` of a GET for every row, batch by batch on the executors; the transport must be picklable."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        client = RestClient({**config, "response": "full", "errorMode": "return", "responseEncoding": "text"}, transport)
        for batch in batches:
            out = [client.query(p)[0] for p in batch[path]]
            yield pd.DataFrame({path: batch[path], "status": [x["status"] for x in out], "body": [x["body"] for x in out]})

    return requests.select(path).mapInPandas(run, f"{path} string, status int, body string")


__all__ = ["RestClient", "RestError", "call_each", "decode_body", "encode_body"]
