"""Queryable SQL: SQLite handles on the driver, SQL over Spark views, and PostgreSQL over injected connections or JDBC."""

from __future__ import annotations

import re
import sqlite3
from collections.abc import Callable, Mapping, Sequence
from typing import Any
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession

from millrace.functions.errors import HandleClosed, NotSupported, checked_options


def _params(given: Sequence[Any] | None) -> list[Any]:
    out = list(given or ())
    for x in out:
        if not (x is None or isinstance(x, bool | int | float | str | bytes)):
            raise TypeError("parameters must be scalars")
    return out


_COMMENT = re.compile(r"\s*(?:--[^\n]*\n|/\*.*?\*/)", re.S)


def verb(sql: str) -> str:
    """The statement's verb; that of the statement after ``WITH`` for one that begins so."""
    pos = 0
    while m := _COMMENT.match(sql, pos):
        pos = m.end()
    first = re.match(r"\s*(\w+)", sql[pos:])
    word = first[1].lower() if first else ""
    if word == "with":
        depth = 0
        for m in re.finditer(r"'(?:[^']|'')*'|\"[^\"]*\"|[()]|\b(select|insert|update|delete|replace)\b", sql[pos:], re.I):
            depth += (m[0] == "(") - (m[0] == ")")
            if m[1] and not depth:
                return m[1].lower()
    return word


class Queryable:
    """``sql`` gives rows as objects, ``sql_exec`` one object of counts; the text is never rewritten."""

    def _cursor(self) -> sqlite3.Connection:
        raise NotImplementedError

    def query(self, text: str, params: Sequence[Any] | None = None, dialect: str = "sql") -> list[dict[str, Any]]:
        db = self._cursor()
        if dialect == "sql":
            cur = db.execute(text, _params(params))
            if cur.description is None:
                raise ValueError("the statement gives no rows; use sql_exec")
            names = [d[0] for d in cur.description]
            return [dict(zip(names, r)) for r in cur.fetchall()]
        if dialect == "sql_exec":
            cur = db.execute(text, _params(params))
            changes = verb(text) in ("insert", "update", "delete", "replace")
            out = {"rowsAffected": db.execute("SELECT changes()").fetchone()[0] if changes else 0}
            if verb(text) in ("insert", "replace"):
                out["lastInsertId"] = db.execute("SELECT last_insert_rowid()").fetchone()[0]
            return [out]
        raise ValueError(f"unknown dialect {dialect!r}")

    def query_one(self, text: str, params: Sequence[Any] | None = None, dialect: str = "sql") -> dict[str, Any] | None:
        return next(iter(self.query(text, params, dialect)), None)

    def query_value(self, text: str, params: Sequence[Any] | None = None, dialect: str = "sql") -> dict[str, Any]:
        found = self.query_one(text, params, dialect)
        if found is None:
            raise LookupError("no row")
        return found

    query_any = query_one

    def query_count(self, text: str, params: Sequence[Any] | None = None, dialect: str = "sql") -> int:
        return len(self.query(text, params, dialect))

    def query_exists(self, text: str, params: Sequence[Any] | None = None, dialect: str = "sql") -> bool:
        return bool(self.query(text, params, dialect))


class SqliteDatabase(Queryable):
    """Exactly one of ``memory``, ``path`` and ``uri``; ``create`` (true), ``readOnly`` (false)."""

    def __init__(self, given: Mapping[str, Any]) -> None:
        o = checked_options(given, {"memory": None, "path": None, "uri": None, "create": True, "readOnly": False}, "sqlite")
        if sum(bool(o[k]) for k in ("memory", "path", "uri")) != 1:
            raise ValueError("exactly one of memory, path and uri")
        if o["memory"] and o["readOnly"]:
            raise ValueError("a database in memory can't be read-only")
        mode = "ro" if o["readOnly"] else "rwc" if o["create"] else "rw"
        name = ":memory:" if o["memory"] else o["uri"] or f"file:{quote(o['path'])}?mode={mode}"
        self._db: sqlite3.Connection | None = sqlite3.connect(name, uri=name != ":memory:", isolation_level=None)
        self._open: list[SqliteTransaction] = []

    def _cursor(self) -> sqlite3.Connection:
        if self._db is None:
            raise HandleClosed("the database is closed")
        return self._db

    def begin(self) -> SqliteTransaction:
        self._cursor().execute("BEGIN")
        self._open.append(SqliteTransaction(self))
        return self._open[-1]

    def close(self) -> bool:
        """Rolls open transactions back; closing again does nothing."""
        if self._db is not None:
            for t in self._open:
                if not t._done:
                    t.rollback()
            self._db.close()
            self._db = None
        return True

    def table(self, spark: SparkSession, text: str, params: Sequence[Any] | None = None) -> DataFrame:
        """A query's rows as a DataFrame; all values of a column must fit one type."""
        rows = self.query(text, params)
        if not rows:
            raise ValueError("no rows, no schema")
        return spark.createDataFrame(rows)


class SqliteTransaction(Queryable):
    def __init__(self, parent: SqliteDatabase) -> None:
        self._parent, self._done = parent, False

    def _cursor(self) -> sqlite3.Connection:
        if self._done:
            raise HandleClosed("the transaction has ended")
        return self._parent._cursor()

    def _end(self, word: str) -> bool:
        self._cursor().execute(word)
        self._done = True
        return True

    def commit(self) -> bool:
        return self._end("COMMIT")

    def rollback(self) -> bool:
        return self._end("ROLLBACK")


class SparkSql:
    """The same modifiers over views of a session; results stay lazy, EXISTS reads one row."""

    def __init__(self, spark: SparkSession) -> None:
        self._spark, self._closed = spark, False

    def query(self, text: str, params: Sequence[Any] | None = None, dialect: str = "sql") -> DataFrame:
        if self._closed:
            raise HandleClosed("the handle is closed")
        if dialect != "sql":
            raise NotSupported(f"{dialect} over Spark views")
        return self._spark.sql(text, args=_params(params)) if params else self._spark.sql(text)

    def query_one(self, text: str, params: Sequence[Any] | None = None) -> dict[str, Any] | None:
        row = self.query(text, params).first()
        return row.asDict() if row else None

    def query_count(self, text: str, params: Sequence[Any] | None = None) -> int:
        return self.query(text, params).count()

    def query_exists(self, text: str, params: Sequence[Any] | None = None) -> bool:
        return not self.query(text, params).isEmpty()

    def close(self) -> bool:
        self._closed = True
        return True


def postgres_options(given: Mapping[str, Any]) -> dict[str, str]:
    """Options of ``spark.read.format("jdbc")``; ``uri`` or single fields, never both. The driver's jar is the cluster's to bring."""
    o = checked_options(given, {"uri": None, "host": None, "port": None, "database": None, "user": None, "password": None, "sslMode": None}, "postgres")
    fields = [k for k in o if k != "uri" and o[k] is not None]
    if bool(o["uri"]) == bool(fields):
        raise ValueError("uri or single fields, not both")
    if o["uri"]:
        if not re.match(r"postgres(ql)?://", o["uri"]):
            raise ValueError("bad uri")
        return {"url": "jdbc:postgresql" + o["uri"][o["uri"].index(":") :], "driver": "org.postgresql.Driver"}
    if not o["host"] or not o["database"]:
        raise ValueError("host and database are needed")
    out = {"url": f"jdbc:postgresql://{o['host']}:{int(o['port'] or 5432)}/{quote(o['database'])}", "driver": "org.postgresql.Driver"}
    out |= {k: str(o[k]) for k in ("user", "password") if o[k] is not None}
    return out | ({"sslmode": o["sslMode"]} if o["sslMode"] else {})


class _Rows:
    """Statements with ``$n`` parameters over a connection of the Python database interface."""

    def _connection(self) -> Any:
        raise NotImplementedError

    def query(self, text: str, params: Sequence[Any] | None = None, dialect: str = "sql") -> list[dict[str, Any]]:
        if dialect not in ("sql", "sql_exec"):
            raise ValueError(f"unknown dialect {dialect!r}")
        plain, order = numbered_to_plain(text)
        given = _params(params)
        cursor = self._connection().cursor()
        try:
            cursor.execute(plain, [given[k - 1] for k in order])
            if dialect == "sql_exec":
                return [{"rowsAffected": max(0, cursor.rowcount)}]
            if cursor.description is None:
                raise ValueError("the statement gives no rows; use sql_exec")
            names = [d[0] for d in cursor.description]
            return [dict(zip(names, r)) for r in cursor.fetchall()]
        finally:
            cursor.close()

    query_one, query_value, query_count, query_exists = Queryable.query_one, Queryable.query_value, Queryable.query_count, Queryable.query_exists
    query_any = query_one


class PostgresDatabase(_Rows):
    """A handle over connections that ``connect(options)`` makes, one for the handle and one for each transaction; parameters are marked ``?`` there.

    ``options`` are those of Spark's JDBC source, with which :meth:`table` reads in the executors. Without ``connect``, only that works.
    """

    def __init__(self, given: Mapping[str, Any], connect: Callable[[dict[str, str]], Any] | None = None) -> None:
        self.options, self._connect, self._own, self._closed = postgres_options(given), connect, None, False
        self._begun: list[PostgresTransaction] = []

    def _check(self) -> None:
        if self._closed:
            raise HandleClosed("the database is closed")

    def _new(self) -> Any:
        self._check()
        if self._connect is None:
            raise NotSupported("statements from the driver need a connection; pass connect")
        return self._connect(self.options)

    def _connection(self) -> Any:
        self._check()
        if self._own is None:
            self._own = self._new()
        return self._own

    def query(self, text: str, params: Sequence[Any] | None = None, dialect: str = "sql") -> list[dict[str, Any]]:
        """Each statement is a transaction of its own."""
        connection = self._connection()
        try:
            found = super().query(text, params, dialect)
        except Exception:
            connection.rollback()
            raise
        connection.commit()
        return found

    def begin(self) -> PostgresTransaction:
        self._begun.append(PostgresTransaction(self._new()))
        return self._begun[-1]

    def close(self) -> bool:
        """Rolls open transactions back; closing again does nothing."""
        for t in self._begun:
            if not t._done:
                t.rollback()
        if self._own is not None:
            self._own.close()
        self._own, self._closed, self._begun = None, True, []
        return True

    def table(self, spark: SparkSession, query: str) -> DataFrame:
        self._check()
        return spark.read.format("jdbc").options(**self.options).option("query", query).load()


class PostgresTransaction(_Rows):
    def __init__(self, connection: Any) -> None:
        self._own, self._done = connection, False

    def _connection(self) -> Any:
        if self._done:
            raise HandleClosed("the transaction has ended")
        return self._own

    def _end(self, how: str) -> bool:
        connection = self._connection()
        self._done = True
        try:
            getattr(connection, how)()
        finally:
            connection.close()
        return True

    def commit(self) -> bool:
        return self._end("commit")

    def rollback(self) -> bool:
        return self._end("rollback")


def numbered_to_plain(text: str) -> tuple[str, list[int]]:
    """``$n`` markers outside quotes and comments as ``?``, and the parameters' numbers in their order."""
    order: list[int] = []

    def one(m: re.Match) -> str:
        if m[1] is None:
            return m[0]
        order.append(int(m[1]))
        return "?"

    return re.sub(r"'(?:[^']|'')*'|\"[^\"]*\"|--[^\n]*|/\*.*?\*/|\$(\d+)", one, text, flags=re.S), order
