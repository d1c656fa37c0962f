from __future__ import annotations

import io
import tarfile
import zipfile
import zlib
from datetime import UTC, datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.functions import chat
from millrace.functions.errors import HandleClosed, NotFound
from millrace.sources import archive, pdf, redis_template, rest, sql_handle, xlsx
from millrace.streaming import events


def zipped(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name.replace("__", "/"), text)
    return out.getvalue()


def test_archive(tmp_path, spark):
    data = zipped(a__b="hi", c="yo")
    assert [e["name"] for e in archive.list_entries(data)] == ["a/b", "c"] and archive.read_entry(data, "c", {"as": "string"}) == "yo" and archive.read_entry(data, "x", {"missing": "none"}) is None
    with pytest.raises(NotFound):
        archive.read_entry(data, "x")
    out = archive.extract(data, str(tmp_path / "o"), {"include": ["a/*"]})
    assert [x["skipped"] for x in out] == [False, True] and (tmp_path / "o/a/b").read_text() == "hi"
    with pytest.raises(archive.ArchiveError):
        archive.extract(data, str(tmp_path / "o"), {})
    for bad in ("../x", "/x", "a/../../x", "C:x"):
        with pytest.raises(archive.ArchiveError):
            archive.safe_path(bad)
    t = io.BytesIO()
    with tarfile.open(fileobj=t, mode="w:gz") as f:
        link = tarfile.TarInfo("l")
        link.type, link.linkname = tarfile.SYMTYPE, "c"
        f.addfile(link)
    assert archive.list_entries(t.getvalue())[0]["isSymlink"] and archive.extract(t.getvalue(), str(tmp_path / "p"))[0]["reason"] == "link"
    with pytest.raises(archive.ArchiveError):
        archive.extract(t.getvalue(), str(tmp_path / "q"), {"links": "error"})
    table = spark.createDataFrame([("z", bytearray(data)), ("n", None)], "path string, content binary")
    assert archive.list_archives(table).count() == 2


def test_xlsx(tmp_path):
    b = xlsx.Workbook()
    s = b.sheet("Sheet1")
    s.write_range("A1", [["Name", "Active", "Score"], ["a", True, 1.5], ["b", False, 2]])
    s.append([["c", True, datetime(2024, 3, 1, tzinfo=UTC)]])
    b.save_as(str(tmp_path / "x.xlsx"))
    q = xlsx.Workbook.open(str(tmp_path / "x.xlsx"))
    rows = q.sheet("Sheet1").query("A1:C5", {"headers": True, "trimEmptyRows": True})
    assert rows[:2] == [{"Name": "a", "Active": True, "Score": 1.5}, {"Name": "b", "Active": False, "Score": 2}] and rows[2]["Score"] == datetime(2024, 3, 1, tzinfo=UTC)
    assert q.sheet("Sheet1").range("A6:B6") == [[None, None]] and q.sheets() == ["Sheet1"]
    t = q.add_sheet("two")
    q.delete_sheet("two")
    with pytest.raises(HandleClosed):
        t.get("A1")
    for bad in ("$A$1", "A0", "B2:A1", "S!A1"):
        with pytest.raises(xlsx.XlsxError):
            s.query(bad)
    q.close()
    with pytest.raises(HandleClosed):
        q.sheets()


def test_sqlite(tmp_path, spark):
    h = sql_handle.SqliteDatabase({"path": str(tmp_path / "d.db")})
    h.query("create table u(id integer primary key, n text)", dialect="sql_exec")
    assert h.query("with v as (select 'x' as n) insert into u(n) select n from v", dialect="sql_exec") == [{"rowsAffected": 1, "lastInsertId": 1}]
    assert h.query_one("select * from u where n = ?", ["x"]) == {"id": 1, "n": "x"} and h.query_one("select * from u where n = ?", ["q"]) is None and h.query_exists("select 1 where 0") is False
    t = h.begin()
    t.query("insert into u(n) values('y')", dialect="sql_exec")
    t.rollback()
    with pytest.raises(HandleClosed):
        t.commit()
    assert h.query_count("select * from u") == 1 and h.table(spark, "select * from u").collect()[0].n == "x"
    open_ = h.begin()
    assert h.close() and h.close()
    for use in (lambda: h.query("select 1"), lambda: open_.query("select 1")):
        with pytest.raises(HandleClosed):
            use()
    with pytest.raises(ValueError):
        sql_handle.SqliteDatabase({"memory": True, "path": "x"})
    assert sql_handle.postgres_options({"host": "h", "database": "d", "user": "u"})["url"] == "jdbc:postgresql://h:5432/d"
    assert sql_handle.numbered_to_plain("select $2, '$1' where a = $1") == ("select ?, '$1' where a = ?", [2, 1])


def test_redis_templates():
    c, b = redis_template.compile_template, redis_template.bind
    assert b(c("HGETALL user:$id"), {"id": 3}) == ["HGETALL", "user:3"] and b(c("MGET $keys..."), {"keys": ["a", 1]}) == ["MGET", "a", "1"]
    assert b(c(r'SET "a b\n$x" \'$y\''.replace("\\'", "'")), {"x": 1}) == ["SET", "a b\n1", "$y"]
    for bad in ("", "GET 'x", "$cmd x", "GET a$k...", 'GET "\\q"'):
        with pytest.raises(redis_template.TemplateError):
            c(bad)
    for bad in ({}, {"id": 1, "z": 2}, {"id": {}}):
        with pytest.raises(redis_template.TemplateError):
            b(c("GET $id"), bad)
    conn = redis_template.RedisConnection(lambda args: args, lambda name: name == "get")
    assert conn.query("GET a") == ["GET", "a"]
    with pytest.raises(redis_template.TemplateError):
        conn.query("DEL a")


def test_rest():
    seen = []

    def transport(method, url, headers, body, timeout):
        seen.append((method, url, headers, body))
        return (404 if "bad" in url else 200), [("Content-Type", "application/json"), ("X", "1"), ("X", "2")], b'[{"n": 1, "f": 1.0}]'

    c = rest.RestClient({"baseUrl": "https://h/api", "headers": {"A": "b"}}, transport)
    assert c.query("items", {"query": {"q": [1, 2]}}) == [{"n": 1, "f": 1.0}] and seen[0][1] == "https://h/api/items?q=1&q=2"
    assert c.query("x", {"method": "post", "body": {"a": 1}}, {"response": "full"})[0]["headers"]["x"] == ["1", "2"] and seen[1][3] == b'{"a":1}'
    with pytest.raises(rest.RestError):
        c.query("bad")
    assert c.query("bad", None, {"errorMode": "return", "response": "full"})[0]["ok"] is False
    with pytest.raises(ValueError):
        c.query("//evil.com/x/../..//", {"nosuch": 1})


def test_pdf():
    content = zlib.compress(b"BT /F1 12 Tf (Hello) Tj 0 -14 Td [(Wor) 3 (ld\\051)] TJ ET")
    data = b"%PDF-1.4\n1 0 obj<</Type/Catalog/Pages 2 0 R>>endobj 2 0 obj<</Type/Pages/Kids[3 0 R]/Count 1/MediaBox[0 0 200 100]>>endobj 3 0 obj<</Type/Page/Parent 2 0 R/Rotate 90/Contents 4 0 R>>endobj 4 0 obj<</Filter/FlateDecode>>stream\n" + content + b"\nendstream endobj"
    assert pdf.pages(data) == [{"number": 1, "width": 200.0, "height": 100.0, "rotation": 90, "text": "Hello\nWorld)", "blocks": ["Hello", "World)"]}]
    with pytest.raises(pdf.PdfError):
        pdf.pages(b"x")


def test_chat():
    chat.register("echo-test", lambda o: lambda m, x: m[-1]["content"])
    s = chat.model("echo-test", {"model": "m", "session": True})
    s.chat("hi")
    f = s.fork()
    f.chat("yo")
    assert len(s.history()) == 2 and len(f.history()) == 4 and s.reset() and s.history() == [] and s.classify("a", ["a", "b"]) == {"label": "a"}
    assert s.extract('{"a": 1}', {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer"}}}) == {"a": 1}
    for bad in (lambda: s.extract("[]", {"type": "object"}), lambda: s.classify("c", ["a"]), lambda: s.generate("x", {"temperature": 3}), lambda: s.query_count("generate", "x")):
        with pytest.raises(ValueError):
            bad()


def test_idle():
    t = pd.Timestamp("2024-01-01")
    ms = lambda n: t + pd.Timedelta(milliseconds=n)
    e = pd.DataFrame([(ms(0), "a", "started"), (ms(100), "b", "started"), (ms(200), "a", "finished"), (ms(900), "b", "failed"), (ms(1000), "c", "started"), (ms(1100), "c", "finished")], columns=["ts", "request_id", "kind"])
    assert events.idle_times(e, 500, 0).values.tolist() == [[ms(1600), 0]]
    assert events.idle_times(e, 500, 1).idle_at.tolist() == [ms(700), ms(1600)]


def test_streams(spark, tmp_path):
    e = spark.createDataFrame([("s", "2024-01-01 00:00:00", "a", "started"), ("s", "2024-01-01 00:00:01", "a", "finished"), ("s", "2024-01-01 00:01:00", "b", "started"), ("s", "2024-01-01 00:02:00", "b", "finished")], "session string, ts string, request_id string, kind string").selectExpr("session", "cast(ts as timestamp) ts", "request_id", "kind")
    batch = {str(r.idle_at) for r in events.network_idle_batch(e).collect()}
    assert batch == {"2024-01-01 00:00:01.500000", "2024-01-01 00:02:00.500000"}
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    q = events.network_idle(stream).writeStream.format("memory").queryName("idle_test").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    assert {str(r.idle_at) for r in spark.table("idle_test").collect()} >= {"2024-01-01 00:00:01.500000"}
    assert events.first_match(e, "kind = 'started'", "session").count() == 1
    row = spark.createDataFrame([(b"abc",)], "b binary").select(events.body(F.col("b"), 2).alias("x")).first().x
    assert bytes(row.body) == b"ab" and row.bodyTruncated


def test_network_idle_of_stray_and_repeated_events(spark):
    """The batch form against requests followed one by one: ends without a start, repeated ends and starts, events of one time."""
    import random

    import pandas as pd

    r = random.Random(3)
    rows = [("a", 0, "r1", "started"), ("a", 10, "r1", "finished"), ("a", 20, "r1", "failed"), ("a", 30, "r2", "started"), ("a", 2000, "r2", "finished")]
    rows += [(f"s{r.randrange(4)}", 100 * r.randrange(200), f"r{r.randrange(4)}", r.choice(["started", "started", "finished", "failed"])) for _ in range(400)]
    rows = sorted({(s, t, q): (s, t, q, k) for s, t, q, k in rows}.values(), key=lambda x: (x[0], x[1], x[2]))
    at = lambda ms: pd.Timestamp("2024-01-01") + pd.Timedelta(milliseconds=ms)
    df = spark.createDataFrame(pd.DataFrame([(s, at(t), q, k) for s, t, q, k in rows], columns=["session", "ts", "request_id", "kind"]))
    for inflight in (0, 1):
        wanted = set()
        for s in {x[0] for x in rows}:
            own = pd.DataFrame([(at(t), q, k) for x, t, q, k in rows if x == s], columns=["ts", "request_id", "kind"])
            wanted |= {(s, x.idle_at.isoformat(), x.inflight) for x in events.idle_times(own, 500, inflight).itertuples()}
        got = {(x.session, x.idle_at.isoformat(), x.inflight) for x in events.network_idle_batch(df, 500, inflight).collect()}
        assert got == wanted and ("a", at(520).isoformat(), 0) not in got


def test_postgres_handle_over_injected_connections(tmp_path):
    """SQLite's connections stand in for PostgreSQL's: numbered parameters, transactions of their own, and closed handles."""
    import sqlite3

    from millrace.functions.errors import HandleClosed, NotSupported
    from millrace.functions.registry import FUNCTIONS

    given, seen = {"host": "h", "database": "d"}, []

    def connect(options):
        seen.append(options["url"])
        return sqlite3.connect(tmp_path / "stand-in.db")

    db = FUNCTIONS["DB::POSTGRES::OPEN"](given, connect)
    db.query("CREATE TABLE t (id INTEGER, name TEXT)", dialect="sql_exec")
    assert db.query("INSERT INTO t VALUES ($2, $1)", ["one", 1], "sql_exec") == [{"rowsAffected": 1}]
    work = FUNCTIONS["DB::POSTGRES::BEGIN"](db)
    work.query("INSERT INTO t VALUES (2, 'gone')", dialect="sql_exec")
    assert FUNCTIONS["DB::POSTGRES::ROLLBACK"](work) and db.query_count("SELECT * FROM t") == 1
    work = FUNCTIONS["DB::POSTGRES::BEGIN"](db)
    work.query("INSERT INTO t VALUES (3, 'kept')", dialect="sql_exec")
    assert FUNCTIONS["DB::POSTGRES::COMMIT"](work)
    assert db.query("SELECT name FROM t WHERE id = $1 OR id = $1 + 2 ORDER BY id", [1]) == [{"name": "one"}, {"name": "kept"}]
    with pytest.raises(HandleClosed):
        work.query("SELECT 1")
    assert FUNCTIONS["DB::POSTGRES::CLOSE"](db) and db.close() and set(seen) == {"jdbc:postgresql://h:5432/d"}
    with pytest.raises(HandleClosed):
        db.query("SELECT 1")
    with pytest.raises(NotSupported):
        FUNCTIONS["DB::POSTGRES::OPEN"](given).query("SELECT 1")
