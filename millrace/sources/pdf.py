"""Pages of simple PDF files: count, size, rotation and text of uncompressed or Flate-compressed content. Encrypted files are refused."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.functions.errors import NotSupported

_OBJ = re.compile(rb"(\d+)\s+(\d+)\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
_SHOW = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>|\b(?:Tj|TJ|T\*|Td|TD|Tm|ET)\b|['\"]")


class PdfError(ValueError):
    pass


def _string(raw: bytes) -> str:
    if raw[:1] == b"<":
        digits = re.sub(rb"\s", b"", raw[1:-1])
        data = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        return data.decode("utf-16-be", "replace") if data[:2] == b"\xfe\xff" else data.decode("latin-1")
    body = re.sub(rb"\\([nrtbf()\\]|[0-7]{1,3}|\r?\n)", lambda m: {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}.get(m[1], b"" if m[1].strip() == b"" else m[1] if not m[1].isdigit() else bytes([int(m[1], 8) & 255])), raw[1:-1])
    return body.decode("utf-16-be", "replace") if body[:2] == b"\xfe\xff" else body.decode("latin-1")


def _text(content: bytes) -> str:
    out: list[str] = []
    held: list[str] = []
    for m in _SHOW.finditer(content):
        t = m[0]
        if t[:1] in b"(<":
            held.append(_string(t))
        elif t in (b"Tj", b"TJ", b"'", b'"'):
            out.append("".join(held))
            held = []
        else:
            held = []
            if out and not out[-1].endswith("\n"):
                out.append("\n")
    return re.sub(r"\n+", "\n", "".join(out)).strip()


def pages(data: bytes) -> list[dict[str, Any]]:
    """``{number, width, height, rotation, text, blocks}`` of each page, in order; ``blocks`` are the text's lines."""
    if not data.lstrip()[:5] == b"%PDF-":
        raise PdfError("no PDF")
    if re.search(rb"/Encrypt\b", data):
        raise NotSupported("encrypted PDF files")
    objects = {int(n): body for n, _, body in _OBJ.findall(data)}

    def stream(body: bytes) -> bytes:
        m = _STREAM.search(body)
        if not m:
            return b""
        try:
            return zlib.decompress(m[1]) if b"/FlateDecode" in body[: m.start()] else m[1]
        except zlib.error:
            raise PdfError("a stream can't be read") from None

    for body in list(objects.values()):
        if re.search(rb"/Type\s*/ObjStm", body):
            raw, n, first = stream(body), int(re.search(rb"/N\s+(\d+)", body)[1]), int(re.search(rb"/First\s+(\d+)", body)[1])
            head = list(map(int, raw[:first].split()[: 2 * n]))
            for k in range(n):
                end = head[2 * k + 3] if k + 1 < n else len(raw) - first
                objects.setdefault(head[2 * k], raw[first + head[2 * k + 1] : first + end])
    ref = lambda text, key: [int(x) for x in re.findall(rb"(\d+)\s+\d+\s+R", m[1])] if (m := re.search(rb"/" + key + rb"\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", text)) else []
    root = next((b for b in objects.values() if re.search(rb"/Type\s*/Catalog\b", b)), None)
    if root is None:
        raise PdfError("no catalog")
    out: list[dict[str, Any]] = []
    stack = [(k, b"") for k in ref(root, b"Pages")]
    seen: set[int] = set()
    while stack:
        k, above = stack.pop()
        if k in seen or k not in objects:
            continue
        seen.add(k)
        body = objects[k]
        if kids := ref(body, b"Kids"):
            stack += [(c, body + above) for c in reversed(kids)]
            continue
        both = body + above
        box = re.search(rb"/MediaBox\s*\[\s*([-\d.]+)\s+([-\d.]+)\s+([-\d.]+)\s+([-\d.]+)", both)
        x0, y0, x1, y1 = map(float, box.groups()) if box else (0.0, 0.0, 612.0, 792.0)
        turn = re.search(rb"/Rotate\s+(-?\d+)", both)
        text = "\n".join(filter(None, (_text(stream(objects.get(c, b""))) for c in ref(body, b"Contents"))))
        out.append({"number": len(out) + 1, "width": abs(x1 - x0), "height": abs(y1 - y0), "rotation": int(turn[1]) % 360 if turn else 0, "text": text, "blocks": text.split("\n") if text else []})
    return out


def read_pages(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """Pages of every file of a ``binaryFile`` table."""
    kinds = {"number": pa.int32(), "width": pa.float64(), "height": pa.float64(), "rotation": pa.int32(), "text": pa.string(), "blocks": pa.list_(pa.string())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = pages(data) if data is not None else []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([k] * len(rows), batch.schema.field(0).type), *(pa.array([r[n] for r in rows], t) for n, t in kinds.items())], names=[key, *kinds])

    slim = files.select(key, content)
    return slim.mapInArrow(run, f"{key} {slim.schema[key].dataType.simpleString()}, number int, width double, height double, rotation int, text string, blocks array<string>")
