"""Articles: the best-scoring container of a page, cleaned, with metadata, as text, sanitised markup and Markdown.

Scores are sums over a container's subtree; one bottom-up pass gives them for all containers.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.functions.urls import absolute
from millrace.operators.cssx import to_date
from millrace.operators.dom import ELEMENT, TEXT, Node, parse
from millrace.operators.selectors import Elements, select

# Key words, weights and limits of the scoring.
POSITIVE = "article content entry post story main body text prose blog doc docs manual guide".split()
NEGATIVE = "comment related share social subscribe newsletter promo advert ads sponsor cookie sidebar breadcrumb pagination pager menu nav footer modal popup recommend trending rail".split()
TAG_BONUS = {"article": 55, "main": 34, "section": 16, "div": 4, "body": -22}
CANDIDATES = {"article", "main", "section", "div", "body"}
#: Statistic, most that counts, weight of each.
COUNTED = {"words": (700, 0.18), "p": (24, 6), "li": (20, 1.5), "code": (10, 4), "table": (6, 5), "heading": (8, 2)}
FORM_CONTROLS = {"form", "input", "button", "select", "textarea"}
STRUCTURE = {"p", "ul", "ol", "pre", "blockquote", "table", "h2", "h3", "h4"}
KEEP = {"img", "pre", "code", "table", "ul", "ol", "blockquote"}
DROP = "script,style,noscript,nav,aside,footer,form,button,iframe,svg,canvas,template,dialog,menu"
PRUNED = {"div", "section", "article", "span", "p", "header", "figure", "ul", "ol", "li"}
LINKY = {"div", "section", "ul", "ol", "p", "header", "li", "span", "table"}
SHORT_META = "time,[rel='author'],[itemprop='author'],.byline,[class*='byline'],[class*='author'],[class*='date'],[class*='meta'],[id*='author'],[id*='byline'],[id*='date']"
ALLOWED = set("a abbr article b blockquote br caption cite code dd del dfn div dl dt em figcaption figure h1 h2 h3 h4 h5 h6 header hr i img ins kbd li mark ol p pre q s samp section small span strong sub sup table tbody td tfoot th thead time tr u ul var wbr".split())
ALLOWED_ATTRS = {"a": {"href"}, "blockquote": {"cite"}, "q": {"cite"}, "img": {"src", "alt", "height", "width"}, "time": {"datetime"}, "td": {"colspan", "rowspan"}, "th": {"colspan", "rowspan", "scope"}}
SCHEMES = {"http", "https", "mailto", "tel"}
LD_TYPES = {"article", "analysisnewsarticle", "blogposting", "newsarticle", "reportage", "scholarlyarticle", "techarticle"}
META = {
    "title": "og:title twitter:title parsely-title title", "byline": "author article:author parsely-author", "excerpt": "description og:description twitter:description parsely-description",
    "siteName": "og:site_name application-name", "publishedAt": "article:published_time datepublished pubdate parsely-pub-date", "updatedAt": "article:modified_time datemodified lastmod parsely-modified-date",
    "lang": "content-language language", "canonicalUrl": "og:url", "leadImage": "og:image og:image:url twitter:image image",
}
TITLE_MARKS = [" | ", " - ", " — ", " :: ", " • "]
FIELDS = ["title", "byline", "excerpt", "siteName", "publishedAt", "updatedAt", "lang", "dir", "canonicalUrl", "leadImage", "text", "html", "markdown", "wordCount", "readingTimeMinutes", "tags", "categories"]
SCHEMA = ", ".join(f"{f} {'bigint' if f in ('wordCount', 'readingTimeMinutes') else 'array<string>' if f in ('tags', 'categories') else 'string'}" for f in FIELDS)

_SPACE = re.compile(r"[\t\n\f\r ]+")


def squeeze(text: str) -> str:
    """ASCII white space as one blank, any white space off the ends."""
    return _SPACE.sub(" ", text).strip()


def size(text: str) -> int:
    return len(text.encode())


def comparable(text: str) -> str:
    return squeeze("".join(c if c.isalpha() or c.isnumeric() or c.isspace() else " " for c in squeeze(text).lower()))


def title_matches(text: str, title: str) -> bool:
    a, b = comparable(text), comparable(title)
    return bool(a and b) and (a.startswith(b) or b.startswith(a) or b in a and size(b) >= 24)


def signals(node: Node) -> str:
    return " ".join(squeeze(node.attrs.get(k, "")) for k in ("id", "class", "role", "itemprop")).strip().lower() if node.attrs else ""


def _has(text: str, words: list[str]) -> bool:
    return any(w in text for w in words)


def timestamp(raw: str | None, strict: bool = False) -> str | None:
    """RFC 3339 in UTC, to the second; text of no known layout stays as it is, unless ``strict``."""
    raw = squeeze(raw or "")
    if not raw:
        return None
    for layout in (None, "2006-01-02 15:04:05 -0700", "2006-01-02T15:04:05", "January 2, 2006 3:04 PM", "January 2, 2006", "Jan 2, 2006 3:04 PM", "Jan 2, 2006"):
        found = to_date(raw, layout)
        if found:
            return re.sub(r"\.\d+Z$", "Z", found)
    return None if strict else raw


def unique(values: list[str]) -> list[str]:
    return list({squeeze(v).lower(): squeeze(v) for v in reversed(values) if squeeze(v)}.values())[::-1]


def split_values(text: str) -> list[str]:
    return unique(re.split(r"[,;|]", text))


def byline(text: str | None) -> str | None:
    s = squeeze(text or "")
    return squeeze(s[3:]) if s.lower().startswith("by ") and len(s) > 3 else s or None


def cut(text: str, limit: int) -> str:
    text = squeeze(text)
    raw = text.encode()
    if len(raw) <= limit:
        return text
    at = raw[:limit].rfind(b" ")
    return raw[: at if at > 0 else limit].decode("utf-8", "ignore").strip() + "..."


def score_candidates(doc: Node, title: str) -> list[tuple[float, Node, int]]:
    """``(score, container, words)`` of every container with 80 bytes of text or more, in document order."""
    order = [n for n in doc.walk() if n.kind in (ELEMENT, TEXT)]
    stats: dict[int, dict[str, float]] = {}
    skip = {"script", "style", "noscript", "template"}
    out = []
    for node in reversed(order):
        s = {"words": 0, "bytes": 0, "links": 0, "p": 0, "li": 0, "code": 0, "table": 0, "heading": 0, "forms": 0, "negative": 0, "author": 0, "structure": 0, "title": 0}
        if node.kind == TEXT:
            parts = node.data.split()
            s["words"], s["bytes"] = len(parts), sum(map(size, parts)) + max(0, len(parts) - 1)
        else:
            first = True
            for child in node.children:
                c = stats.get(id(child))
                if c is None or child.tag in skip:
                    continue
                for k, v in c.items():
                    s[k] += v
                if c["bytes"]:
                    s["bytes"] += not first
                    first = False
            sig = signals(node)
            if node.tag == "a":
                s["links"] += s["bytes"]
            s["p"] += node.tag == "p"
            s["li"] += node.tag == "li"
            s["code"] += node.tag in ("pre", "code")
            s["table"] += node.tag == "table"
            s["heading"] += node.tag in ("h2", "h3", "h4")
            s["forms"] += node.tag in FORM_CONTROLS
            s["negative"] += bool(sig) and _has(sig, NEGATIVE)
            s["author"] += "author" in sig or "byline" in sig or node.attrs.get("rel") == "author"
            s["structure"] += node.tag in STRUCTURE
            if title and node.tag in ("h1", "h2") and title_matches(node.text(), title):
                s["title"] = 1
        stats[id(node)] = s
    for node in order:
        if node.kind != ELEMENT or node.tag not in CANDIDATES and squeeze(node.attrs.get("role", "").lower()) != "main":
            continue
        s = stats[id(node)]
        if s["bytes"] < 80:
            continue
        sig = signals(node)
        score = TAG_BONUS.get(node.tag, 0) + sum(min(s[k], most) * weight for k, (most, weight) in COUNTED.items())
        score += 18 * _has(sig, POSITIVE) - 28 * _has(sig, NEGATIVE) - 95 * s["links"] / s["bytes"] - 10 * s["forms"]
        score -= 4 * min(s["negative"] - (1 if _has(sig, NEGATIVE) and s["negative"] else 0), 12)
        score += -30 * (s["words"] < 35) + 22 * bool(s["title"]) + 8 * bool(s["author"]) - 14 * (s["structure"] < 2)
        out.append((score, node, int(s["words"])))
    return out


def _below(root: Node | Elements, selector: str) -> list[Node]:
    return root.select(selector) if isinstance(root, Elements) else select(root, selector)


def clean(root: Node, title: str | None, base: str) -> None:
    """Takes boilerplate, the repeated title, short bylines and empty containers out of ``root``, and makes its addresses absolute."""
    for n in _below(root, DROP):
        n.remove()

    def fold(node: Node, prune: bool) -> tuple[int, int, bool]:
        if node.kind == TEXT:
            return size(squeeze(node.data)), 0, False
        n = links = 0
        keep = False
        for child in list(node.children):
            a, b, c = fold(child, prune)
            if child.parent is node:
                n, links, keep = n + a, links + b, keep or c
        if node.kind != ELEMENT or node is root:
            return n, links, keep
        links = n if node.tag == "a" else links
        keep = keep or node.tag in KEEP
        if prune:
            if node.tag in PRUNED and not keep and not n:
                node.remove()
                return 0, 0, False
            return n, links, keep
        sig = signals(node)
        if sig and (_has(sig, NEGATIVE) and not _has(sig, POSITIVE) or node.tag in LINKY and n and links / n > 0.72):
            node.remove()
            return 0, 0, False
        return n, links, keep

    fold(root, False)
    if title:
        for n in _below(root, "h1,h2"):
            if title_matches(n.text(), title):
                n.remove()
                break
    for n in _below(root, SHORT_META):
        text = squeeze(n.text())
        if text and size(text) <= 120 and not _below(n, "p,pre,table,ul,ol"):
            n.remove()
    if base:
        for n in _below(root, "[href],[src]"):
            for k in ("href", "src"):
                if k in n.attrs:
                    n.attrs[k] = absolute(base, n.attrs[k]) or n.attrs[k].strip()
    fold(root, True)


def _safe(url: str) -> bool:
    scheme = re.match(r"\s*([a-zA-Z][a-zA-Z0-9+.\-]*):", url)
    return scheme is None or scheme[1].lower() in SCHEMES


def sanitise(node: Node) -> str:
    """Markup of what is below ``node`` from the allowed elements and attributes; other elements leave their text."""
    esc = lambda s: s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&#34;").replace("'", "&#39;")
    out: list[str] = []
    for c in node.children:
        if c.kind == TEXT:
            out.append(esc(c.data))
        elif c.kind == ELEMENT and c.tag not in ("script", "style"):
            inner = sanitise(c)
            if c.tag not in ALLOWED:
                out.append(inner)
                continue
            allowed = {"dir", "lang", "title"} | ALLOWED_ATTRS.get(c.tag, set())
            attrs = "".join(f' {k}="{esc(v)}"' for k, v in c.attrs.items() if k in allowed and (k not in ("href", "src", "cite") or _safe(v)))
            if c.tag == "a" and not attrs:
                out.append(inner)
            elif c.tag in ("br", "hr", "img", "wbr"):
                out.append(f"<{c.tag}{attrs}/>")
            else:
                out.append(f"<{c.tag}{attrs}>{inner}</{c.tag}>")
    return "".join(out)


def _inline(node: Node) -> str:
    out = []
    for c in node.children:
        if c.kind == TEXT:
            out.append(_SPACE.sub(" ", c.data))
        elif c.kind == ELEMENT:
            t = _inline(c)
            if c.tag in ("strong", "b") and t.strip():
                t = f"**{t.strip()}**"
            elif c.tag in ("em", "i") and t.strip():
                t = f"*{t.strip()}*"
            elif c.tag == "code":
                t = f"`{c.text()}`"
            elif c.tag == "a" and c.attrs.get("href") and _safe(c.attrs["href"]) and t.strip():
                t = f"[{t.strip()}]({c.attrs['href']})"
            elif c.tag == "img" and c.attrs.get("src") and _safe(c.attrs["src"]):
                t = f"![{c.attrs.get('alt', '')}]({c.attrs['src']})"
            elif c.tag == "br":
                t = "  \n"
            out.append(t)
    return "".join(out)


def markdown(node: Node) -> str:
    """Markdown of what is below ``node``: headings, paragraphs, lists, quotes, code, tables, rules, links and images."""
    blocks: list[str] = []
    run: list[Node] = []
    block_tags = {"p", "div", "section", "article", "header", "ul", "ol", "pre", "blockquote", "table", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "figure", "main", "dl"}

    def flush() -> None:
        if run:
            holder = Node(ELEMENT, "span")
            holder.children = run[:]
            text = _inline(holder).strip()
            if text:
                blocks.append(text)
            run.clear()

    for c in node.children:
        if c.kind != ELEMENT or c.tag not in block_tags:
            run.append(c)
            continue
        flush()
        if c.tag[0] == "h" and c.tag[1:].isdigit():
            blocks.append(f"{'#' * int(c.tag[1])} {_inline(c).strip()}")
        elif c.tag in ("ul", "ol"):
            items = [markdown(li).replace("\n", "\n  ") for li in c.element_children() if li.tag == "li"]
            blocks.append("\n".join(f"{f'{i}.' if c.tag == 'ol' else '-'} {x}" for i, x in enumerate(items, 1)))
        elif c.tag == "pre":
            blocks.append("```\n" + c.text().strip("\n") + "\n```")
        elif c.tag == "blockquote":
            blocks.append("\n".join(f"> {x}".rstrip() for x in markdown(c).split("\n")))
        elif c.tag == "table":
            rows = [[squeeze(_inline(d)).replace("|", "\\|") for d in r.element_children()] for r in _below(c, "tr")]
            rows = [r for r in rows if r]
            if rows:
                width = max(map(len, rows))
                lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
                blocks.append("\n".join([lines[0], "| " + " | ".join(["---"] * width) + " |", *lines[1:]]))
        elif c.tag == "hr":
            blocks.append("---")
        else:
            inner = markdown(c)
            if inner:
                blocks.append(inner)
    flush()
    return "\n\n".join(b for b in blocks if b)


def _first(doc: Elements, *selectors: str) -> Node | None:
    return next((n for s in selectors for n in _below(doc, s)[:1]), None)


def _ld_items(value: Any) -> Iterator[dict]:
    if isinstance(value, list):
        for v in value:
            yield from _ld_items(v)
    elif isinstance(value, dict):
        kinds = value.get("@type")
        if any(isinstance(k, str) and k.lower() in LD_TYPES for k in (kinds if isinstance(kinds, list) else [kinds])):
            yield value
        for k in ("@graph", "mainEntity", "mainEntityOfPage"):
            yield from _ld_items(value.get(k))


def _ld_text(value: Any, *keys: str) -> str | None:
    if isinstance(value, list):
        return ", ".join(x for x in (_ld_text(v, *keys) for v in value) if x) or None
    if isinstance(value, dict):
        return next((x for k in keys if (x := _ld_text(value.get(k), *keys))), None)
    return squeeze(value) or None if isinstance(value, str) else None


def _json_ld(doc: Elements, base: str) -> dict[str, Any]:
    for script in _below(doc, "script[type='application/ld+json']"):
        try:
            found = next(_ld_items(json.loads(script.text())), None)
        except ValueError:
            continue
        if found:
            words = found.get("keywords")
            section = found.get("articleSection")
            image = _ld_text(found["image"][0] if isinstance(found.get("image"), list) and found["image"] else found.get("image"), "url", "contentUrl")
            return {
                "title": _ld_text(found.get("headline")) or _ld_text(found.get("name")), "byline": byline(_ld_text(found.get("author"), "name")), "excerpt": _ld_text(found.get("description")), "siteName": _ld_text(found.get("publisher"), "name"),
                "publishedAt": timestamp(_ld_text(found.get("datePublished"))), "updatedAt": timestamp(_ld_text(found.get("dateModified"))), "lang": _ld_text(found.get("inLanguage"), "name"), "canonicalUrl": absolute(base, _ld_text(found.get("url")) or ""),
                "leadImage": absolute(base, image or "") or image, "tags": unique([x for w in (words if isinstance(words, list) else [words or ""]) for x in split_values(str(w))]), "categories": unique([str(x) for x in (section if isinstance(section, list) else [section or ""])]),
            }
    return {}


def _meta(doc: Elements, base: str) -> dict[str, Any]:
    index: dict[str, list[str]] = {}
    for m in _below(doc, "meta"):
        key = next((v for k in ("property", "name", "itemprop") if (v := squeeze(m.attrs.get(k, "")).lower())), "")
        if key and (value := squeeze(m.attrs.get("content", ""))):
            index.setdefault(key, []).append(value)
    first = lambda keys: next((index[k][0] for k in keys.split() if k in index), "")
    out: dict[str, Any] = {name: first(keys) or None for name, keys in META.items()}
    out["byline"] = byline(out["byline"])
    for k in ("publishedAt", "updatedAt"):
        out[k] = timestamp(out[k])
    for k in ("canonicalUrl", "leadImage"):
        out[k] = absolute(base, out[k]) or out[k] if out[k] else None
    out["tags"] = unique(split_values(first("keywords news_keywords")) + index.get("article:tag", []))
    out["categories"] = unique(index.get("article:section", []) + index.get("section", []))
    return out


def _fallback(doc: Elements, candidate: Node | None, base: str) -> dict[str, Any]:
    text = lambda n: squeeze(n.text()) or None if n is not None else None
    page = _first(doc, "html")
    link = _first(doc, "link[rel~='canonical']")
    scopes = [s for s in (candidate, _first(doc, "article"), _first(doc, "main"), doc) if s is not None]
    times = next((t for s in scopes if (t := _below(s, "time"))), []) if "time" in doc.tags else []
    stamps = [x for t in times if (x := timestamp(t.attrs.get("datetime") or t.text(), strict=True))]
    image = next((n.attrs["src"] for s in scopes for n in _below(s, "img[src]")), None) if "img" in doc.tags else None
    who = next((n for q in ("[rel='author']", "[itemprop='author']", ".byline", "[class*='byline']", "[class*='author']") for n in _below(doc, q) if 0 < size(squeeze(n.text())) <= 120), None)
    return {
        "title": text(_first(doc, "article h1", "main h1", "h1")), "byline": byline(text(who)), "publishedAt": stamps[0] if stamps else None, "updatedAt": stamps[1] if len(stamps) > 1 else None, "lang": page.attrs.get("lang") if page is not None else None,
        "dir": page.attrs.get("dir") if page is not None else None, "canonicalUrl": (absolute(base, link.attrs.get("href", "")) or link.attrs.get("href")) if link is not None else None, "leadImage": absolute(base, image or "") or image,
        "tags": unique([n.text() for n in _below(doc, "a[rel~='tag'],.tags a")]), "categories": unique([n.text() for n in _below(doc, "a[rel~='category'],.categories a,.category a")]),
    }


def split_title(text: str) -> tuple[str | None, str | None]:
    """Title and site of a page title: the longer side of the first mark is the title."""
    text = squeeze(text)
    for mark in TITLE_MARKS:
        left, found, right = text.rpartition(mark)
        if found:
            left, right = squeeze(left), squeeze(right)
            return (left, right) if len(left) >= len(right) else (right, left)
    return text or None, None


def extract(markup: str | Node, url: str = "") -> dict[str, Any]:
    """The 17 fields of an article; those that a page doesn't have are None."""
    if not isinstance(markup, str):
        return _extract(markup, url)
    return {k: v[:] if isinstance(v, list) else v for k, v in _extract_last(markup, url).items()}


@lru_cache(maxsize=1)
def _extract_last(markup: str, url: str) -> dict[str, Any]:
    """Fields of the last page: calls for its fields, text and Markdown one after another cost one extraction."""
    return _extract(parse(markup), url)


def _extract(root: Node, url: str) -> dict[str, Any]:
    doc = Elements(root)
    href = next((n.attrs["href"] for n in _below(doc, "base[href]")), "")
    base = absolute(url, href) or url
    found: dict[str, Any] = dict.fromkeys(FIELDS)

    def fill(more: dict[str, Any]) -> None:
        for k, v in more.items():
            if not found[k]:
                found[k] = v or None

    fill(_json_ld(doc, base))
    fill(_meta(doc, base))
    hint = found["title"] or squeeze(next((n.text() for n in _below(doc, "h1")), "")) or None
    best = None
    for one in score_candidates(root, hint or ""):
        if best is None or one[0] > best[0]:
            best = one
    fill(_fallback(doc, best[1] if best else None, base))
    title, site = split_title(next((n.text() for n in _below(doc, "title")), ""))
    fill({"title": title, "siteName": site})
    if best is not None:
        root = best[1]
        clean(root, found["title"], base)
        text = squeeze(root.text())
        words = len(text.split())
        if text and (words >= 35 or size(text) >= 220 and best[0] >= 55):
            fill({"text": text, "html": sanitise(root).strip(), "markdown": markdown(root), "wordCount": words, "readingTimeMinutes": max(1, math.ceil(words / 200))})
            lead = next((cut(p.text(), 220) for p in _below(root, "p") if size(squeeze(p.text())) >= 48), None)
            fill({"excerpt": lead, "leadImage": next((n.attrs["src"] for n in _below(root, "img[src]")), None)})
    return found


def extract_pages(pages: DataFrame, key: str = "page_id", html: str = "html", url: str = "url") -> DataFrame:
    """``key`` and the 17 fields of every page, one pass and no shuffle; null markup gives nulls."""
    kinds = [pa.int64() if f in ("wordCount", "readingTimeMinutes") else pa.list_(pa.string()) if f in ("tags", "categories") else pa.string() for f in FIELDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [extract(m, u or "") if m is not None else dict.fromkeys(FIELDS) for m, u in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[f] for r in rows], k) for f, k in zip(FIELDS, kinds))], names=[key, *FIELDS])

    slim = pages.select(key, html, url)
    return slim.mapInArrow(run, f"{key} {slim.schema[key].dataType.simpleString()}, {SCHEMA}")
