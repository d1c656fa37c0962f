"""ZIP and TAR archives: listing, reading and safe extraction, for one archive and for a table of them."""

from __future__ import annotations

import fnmatch
import io
import os
import re
import shutil
import stat
import tarfile
import tempfile
import zipfile
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import asdict, dataclass
from datetime import UTC, datetime
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.functions.errors import NotFound, checked_options

MAX_ENTRY = 64 << 20


class ArchiveError(ValueError):
    pass


@dataclass
class Entry:
    name: str
    size: int
    compressedSize: int | None
    mode: int
    modTime: str | None
    isDir: bool
    isRegular: bool
    isSymlink: bool
    linkName: str | None
    format: str


def _format(data: bytes, wanted: str) -> str:
    if wanted not in ("auto", "zip", "tar", "tar.gz", "tgz"):
        raise ArchiveError(f"unknown format {wanted!r}")
    if wanted != "auto":
        return "tar.gz" if wanted == "tgz" else wanted
    if data[:4] in (b"PK\3\4", b"PK\5\6"):
        return "zip"
    if data[:2] == b"\x1f\x8b":
        return "tar.gz"
    if data[257:262] == b"ustar" or len(data) >= 1024 and not data[:1024].strip(b"\0"):
        return "tar"
    raise ArchiveError("unknown archive format")


def _open(data: bytes, fmt: str) -> Iterator[tuple[Entry, Any]]:
    """Entries in archive order, each with a function that reads it."""
    try:
        if fmt == "zip":
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                for i in z.infolist():
                    mode = i.external_attr >> 16
                    link = stat.S_ISLNK(mode)
                    entry = Entry(i.filename, i.file_size, i.compress_size, mode & 0o7777, datetime(*i.date_time, tzinfo=UTC).isoformat().replace("+00:00", "Z") if i.date_time[1] else None, i.is_dir(), not i.is_dir() and not link, link, z.read(i).decode() if link else None, "zip")
                    yield entry, lambda i=i: _bounded(z.open(i), i.file_size)
        else:
            with tarfile.open(fileobj=io.BytesIO(data), mode="r:gz" if fmt == "tar.gz" else "r:") as t:
                for m in t:
                    entry = Entry(m.name + ("/" if m.isdir() and not m.name.endswith("/") else ""), m.size, None, m.mode & 0o7777, datetime.fromtimestamp(m.mtime, UTC).isoformat().replace("+00:00", "Z"), m.isdir(), m.isreg(), m.issym(), m.linkname or None, fmt)
                    yield entry, lambda m=m: _bounded(t.extractfile(m), m.size)
    except (zipfile.BadZipFile, tarfile.TarError, EOFError, OSError) as e:
        raise ArchiveError(f"can't be read: {e}") from None


def _bounded(f: Any, size: int) -> bytes:
    if size > MAX_ENTRY:
        raise ArchiveError("an entry is over 64 MiB")
    data = f.read(MAX_ENTRY + 1)
    if len(data) > MAX_ENTRY:
        raise ArchiveError("an entry is over 64 MiB")
    return data


def list_entries(data: bytes, given: Mapping[str, Any] | None = None) -> list[dict[str, Any]]:
    o = checked_options(given, {"format": "auto"}, "archive list")
    return [asdict(e) for e, _ in _open(data, _format(data, o["format"]))]


def read_entry(data: bytes, name: str, given: Mapping[str, Any] | None = None) -> bytes | str | None:
    """The first regular entry of that name."""
    o = checked_options(given, {"format": "auto", "as": "binary", "missing": "error"}, "archive read")
    if o["as"] not in ("binary", "string") or o["missing"] not in ("error", "none"):
        raise ArchiveError("as is binary or string, missing is error or none")
    for e, read in _open(data, _format(data, o["format"])):
        if e.name == name and e.isRegular:
            return read().decode() if o["as"] == "string" else read()
    if o["missing"] == "none":
        return None
    raise NotFound(name)


def safe_path(name: str) -> str:
    """A relative path within the destination; absolute ones, drives, ``..`` and empty parts are refused."""
    plain = name.rstrip("/")
    if not plain or plain.startswith("/") or "\\" in plain or "\0" in plain or re.match(r"[A-Za-z]:", plain) or any(p in ("", "..") for p in plain.split("/")):
        raise ArchiveError(f"unsafe path {name!r}")
    return "/".join(p for p in plain.split("/") if p != ".") or "."


def _glob(pattern: str) -> re.Pattern:
    """A pattern in which ``*`` and ``?`` stay within one part of a path."""
    return re.compile("/".join(fnmatch.translate(p).removeprefix("(?s:").removesuffix(")\\Z").replace(".*", "[^/]*") for p in pattern.split("/")) + r"\Z")


def selected(path: str, include: Sequence[str], exclude: Sequence[str]) -> bool:
    hit = lambda patterns: any(_glob(p).match(path) for p in patterns)
    return (not include or hit(include)) and not hit(exclude)


def extract(data: bytes, destination: str, given: Mapping[str, Any] | None = None) -> list[dict[str, Any]]:
    """Writes eligible entries below ``destination`` after all paths have been checked; what was written goes again if one fails."""
    o = checked_options(given, {"format": "auto", "links": "skip", "include": (), "exclude": (), "overwrite": False, "createDirs": True}, "archive extract")
    fmt, seen, parents = _format(data, o["format"]), {}, set()
    for e, _ in _open(data, fmt):
        path = safe_path(e.name)
        if path in seen and not (e.isDir and seen[path]):
            raise ArchiveError(f"path {path!r} twice")
        seen[path] = e.isDir
        parents |= {path[: m.start()] for m in re.finditer("/", path)}
        if not (e.isDir or e.isRegular or e.isSymlink or e.linkName):
            raise ArchiveError(f"special entry {path!r}")
        if e.isSymlink and o["links"] == "error":
            raise ArchiveError(f"link {path!r}")
    if bad := sorted(p for p in parents if seen.get(p) is False):
        raise ArchiveError(f"{bad[0]!r} is no directory")
    if not os.path.isdir(destination) and not o["createDirs"]:
        raise NotFound(destination)
    out, made = [], []
    os.makedirs(destination, exist_ok=True)
    stage = tempfile.mkdtemp(dir=destination, prefix=".extract-")
    try:
        moves = []
        for k, (e, read) in enumerate(_open(data, fmt)):
            path = safe_path(e.name)
            result = {"name": e.name, "path": None, "size": e.size, "isDir": e.isDir, "skipped": True, "reason": None}
            out.append(result)
            if not selected(path, o["include"], o["exclude"]):
                result["reason"] = "filtered"
            elif not (e.isDir or e.isRegular):
                result["reason"] = "link"
            else:
                target = os.path.join(destination, path)
                if e.isRegular and os.path.lexists(target) and not o["overwrite"]:
                    raise ArchiveError(f"{path!r} exists")
                if e.isRegular:
                    with open(os.path.join(stage, str(k)), "wb") as f:
                        f.write(read())
                moves.append((k, target, e.isDir))
                result |= {"path": path, "skipped": False}
        for k, target, is_dir in moves:
            os.makedirs(target if is_dir else os.path.dirname(target), exist_ok=True)
            if not is_dir:
                os.replace(os.path.join(stage, str(k)), target)
                made.append(target)
    except BaseException:
        for path in made:
            os.unlink(path)
        raise
    finally:
        shutil.rmtree(stage, ignore_errors=True)
    return out


ENTRY_SCHEMA = "name string, size long, compressedSize long, mode int, modTime string, isDir boolean, isRegular boolean, isSymlink boolean, linkName string, format string"
_KINDS = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_(), pa.string(), pa.string()]


def list_archives(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """Entries of every archive of a ``binaryFile`` table: ``(key, entry_no, ...)``."""
    names = ENTRY_SCHEMA.replace(",", "").split()[::2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = list_entries(data) if data is not None else []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([k] * len(rows), batch.schema.field(0).type), pa.array(range(len(rows)), pa.int32()), *(pa.array([r[n] for r in rows], t) for n, t in zip(names, _KINDS))], names=[key, "entry_no", *names])

    slim = files.select(key, content)
    return slim.mapInArrow(run, f"{key} {slim.schema[key].dataType.simpleString()}, entry_no int, {ENTRY_SCHEMA}")
