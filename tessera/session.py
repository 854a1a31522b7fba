"""Sessions: statements of the dialect over versioned tables.

A session runs one transaction at a time. Reads see the catalog version captured at BEGIN (or at
the statement, in auto-commit); writes make new immutable folders and a private catalog, which a
commit publishes in one atomic step. Savepoints are copies of the private catalog.
"""

from __future__ import annotations

import copy
import importlib
import time
from collections.abc import Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .plans.dialect import check_with, lower, with_default_names
from .plans.lexer import DialectError, Token, literal, statements, tokenize
from .sources.storage import ConflictError, Store

#: Values of a sequence that are reserved at a time; a crash wastes what is left of a block.
SEQUENCE_BLOCK = 100
MAX_RECURSION = 1000

# Types of the dialect and what they become.
TYPES = {
    "INT": "int", "INTEGER": "int", "SMALLINT": "smallint", "TINYINT": "tinyint", "BIGINT": "bigint",
    "SERIAL": "int", "BIGSERIAL": "bigint", "VARCHAR": "string", "CHAR": "string", "TEXT": "string",
    "BOOLEAN": "boolean", "BOOL": "boolean", "DATE": "date", "TIME": "string", "TIMESTAMP": "timestamp_ntz",
    "DOUBLE": "double", "FLOAT": "float", "BYTEA": "binary", "BLOB": "binary", "UUID": "string", "JSON": "string", "JSONB": "string",
}
INDEX_KINDS = ("HASH", "BTREE", "BRIN", "GIN", "BITMAP", "GIST")
DEFAULT_NOW = {"CURRENT_DATE": "current_date()", "CURRENT_TIMESTAMP": "localtimestamp()", "CURRENT_TIME": "date_format(localtimestamp(), 'HH:mm:ss')"}


@dataclass
class Result:
    """What a statement gives: a message, rows, or an error."""

    ok: bool
    message: str = ""
    rows: DataFrame | None = None

    def collect(self) -> list:
        return self.rows.collect() if self.rows is not None else []


@dataclass
class _Transaction:
    base: int
    before: dict
    catalog: dict
    changed: set[str] = field(default_factory=set)
    savepoints: list[tuple[str, dict, set[str], dict]] = field(default_factory=list)
    pending: dict[str, list[list[str]]] = field(default_factory=dict)
    failed: bool = False
    pin: str | None = None


class _Cursor:
    """A walk over a statement's tokens."""

    def __init__(self, tokens: list[Token]) -> None:
        self.tokens, self.i = tokens, 0

    def peek(self, *words: str) -> bool:
        return self.i < len(self.tokens) and self.tokens[self.i].is_word(*words)

    def accept(self, *words: str) -> str | None:
        if self.peek(*words):
            self.i += 1
            return self.tokens[self.i - 1].text.upper()
        return None

    def expect(self, *words: str) -> str:
        found = self.accept(*words)
        if not found:
            raise DialectError(f"Syntax error: expected {' or '.join(words)} near {self._near()}")
        return found

    def symbol(self, text: str) -> bool:
        if self.i < len(self.tokens) and self.tokens[self.i].kind == "symbol" and self.tokens[self.i].text == text:
            self.i += 1
            return True
        return False

    def need(self, text: str) -> None:
        if not self.symbol(text):
            raise DialectError(f"Syntax error: expected {text!r} near {self._near()}")

    def name(self) -> str:
        return self.take("word", "quoted").text

    def take(self, *kinds: str) -> Token:
        if self.i >= len(self.tokens) or self.tokens[self.i].kind not in kinds:
            raise DialectError(f"Syntax error: expected {' or '.join(kinds)} near {self._near()}")
        self.i += 1
        return self.tokens[self.i - 1]

    def rest(self) -> list[Token]:
        out, self.i = self.tokens[self.i :], len(self.tokens)
        return out

    def until(self, *stops: str) -> list[Token]:
        """Tokens up to a top-level comma, closing parenthesis or stop word."""
        depth, start = 0, self.i
        while self.i < len(self.tokens):
            t = self.tokens[self.i]
            if not depth and ((t.kind == "symbol" and t.text in ",)") or t.is_word(*stops)):
                break
            if t.kind == "symbol":
                depth += (t.text in "([") - (t.text in ")]")
            self.i += 1
        return self.tokens[start : self.i]

    def end(self) -> None:
        if self.i < len(self.tokens):
            raise DialectError(f"Syntax error near {self._near()}")

    def _near(self) -> str:
        return " ".join(t.text for t in self.tokens[self.i : self.i + 4]) or "the end"


class Session:
    """One client's state: transaction, sequence positions, temporary views and functions."""

    def __init__(self, spark: SparkSession, root: str, slow_ms: float | None = None) -> None:
        self.spark = spark.newSession()
        self.spark.conf.set("spark.sql.ansi.enabled", "false")
        self.spark.conf.set("spark.sql.cteRecursionLevelLimit", str(MAX_RECURSION))
        self.store = Store(self.spark, root)
        self.slow_ms, self.slow_log = slow_ms, []
        self._txn: _Transaction | None = None
        self._explicit = False
        self._args: Sequence[object] = ()
        self._blocks: dict[str, tuple[int, int]] = {}
        self._current: dict[str, int] = {}
        self._registered: dict[str, str] = {}
        self._depth = 0

    # --- entry ---------------------------------------------------------------------------------

    def execute(self, sql: str, args: Sequence[object] = ()) -> Result:
        """Run one statement; ``$1`` … stand for args, which are bound as typed values."""
        began = time.monotonic()
        try:
            parts = statements(sql)
            if len(parts) != 1:
                raise DialectError("One statement at a time" if parts else "Empty statement")
            return self._run(parts[0], args)
        except Exception as e:
            if self._explicit and self._txn and not isinstance(e, ConflictError):
                self._txn.failed = True
            return Result(False, self._explain_error(e))
        finally:
            took = (time.monotonic() - began) * 1000
            if self.slow_ms is not None and took >= self.slow_ms:
                self.slow_log.append((sql, took))

    def script(self, sql: str) -> list[Result]:
        """Run the statements of a script, stopping at the first failure."""
        out = []
        for tokens in statements(sql):
            try:
                out.append(self._run(tokens, ()))
            except Exception as e:
                if self._explicit and self._txn:
                    self._txn.failed = True
                out.append(Result(False, self._explain_error(e)))
                break
        return out

    def sql(self, sql: str, args: Sequence[object] = ()) -> DataFrame:
        """The rows of a query; raises what execute() would report."""
        result = self.execute(sql, args)
        if not result.ok:
            raise DialectError(result.message)
        if result.rows is None:
            raise DialectError("The statement returns no rows")
        return result.rows

    def load(self, table: str, rows: DataFrame) -> Result:
        """Bulk load: make a table of a DataFrame's rows, or append them to a table of the same columns."""
        number, catalog = self.store.latest()
        own = not self._explicit
        if own:
            self._txn = _Transaction(number, catalog, copy.deepcopy(catalog))
        try:
            if table not in self._txn.catalog["tables"]:
                self._free(table, "Table or view", "tables", "views")
                columns = [
                    {"name": f.name, "declared": f.dataType.simpleString().upper(), "type": f.dataType.simpleString(), "array": False, "not_null": False, "default": None}
                    for f in rows.schema.fields
                ]
                self._put("tables", table, {"columns": columns, "schema": rows.schema.jsonValue(), "folders": []})
            names = [x["name"] for x in self._entry("tables", table)["columns"]]
            self._append(table, rows.select(*names))
            if own:
                self._publish()
            return Result(True, f"Loaded {table}")
        finally:
            if own:
                self._txn = None

    def close(self) -> None:
        """End the session; an open transaction is rolled back."""
        self._end()

    def _end(self) -> None:
        if self._txn and self._txn.pin:
            self.store.unpin(self._txn.pin)
        self._txn, self._explicit = None, False

    @staticmethod
    def _explain_error(e: Exception) -> str:
        text = str(e) if isinstance(e, DialectError) else next((x.strip() for x in str(e).split("\n") if x.strip()), type(e).__name__)
        if "RECURSION_LEVEL_LIMIT_EXCEEDED" in str(e):
            return f"Recursive query did not finish within {MAX_RECURSION} iterations"
        return text

    # --- transactions --------------------------------------------------------------------------

    def _run(self, tokens: list[Token], args: Sequence[object]) -> Result:
        c = _Cursor(tokens)
        if c.accept("BEGIN") or (c.peek("START") and c.accept("START")):
            c.accept("TRANSACTION")
            c.end()
            return self._begin()
        if c.accept("COMMIT"):
            c.end()
            return self._commit()
        if c.peek("ROLLBACK") and not (len(tokens) > 1 and tokens[1].is_word("TO")):
            c.accept("ROLLBACK")
            c.end()
            self._end()
            return Result(True, "Transaction rolled back")
        if self._txn and self._explicit and self._txn.failed and not (c.peek("ROLLBACK")):
            raise DialectError("Current transaction is aborted, statements are ignored until ROLLBACK")
        if self._explicit:
            return self._in_transaction(c, args)
        # A note before the catalog is read: VACUUM then spares what this statement reads and writes.
        pin = self.store.pin(0) if c.peek("INSERT", "UPDATE", "DELETE", "CALL", "VACUUM") else None
        try:
            number, catalog = self.store.latest()
            self._txn = _Transaction(number, catalog, copy.deepcopy(catalog), pin=pin)
            result = self._in_transaction(c, args)
            self._publish()
            return result
        finally:
            if not self._explicit:
                self._txn = None
            if pin:
                self.store.unpin(pin)

    def _begin(self) -> Result:
        if self._explicit:
            raise DialectError("A transaction is already open")
        number, catalog = self.store.latest()
        self._txn, self._explicit = _Transaction(number, catalog, copy.deepcopy(catalog), pin=self.store.pin(number)), True
        return Result(True, "Transaction started")

    def _commit(self) -> Result:
        if not self._explicit or not self._txn:
            raise DialectError("No transaction is open")
        failed = self._txn.failed
        try:
            if not failed:
                self._publish()
        finally:
            self._end()
        return Result(not failed, "Transaction rolled back: a statement in it had failed" if failed else "Transaction committed")

    def _publish(self) -> None:
        self._flush()
        t = self._txn
        if t and t.changed:
            self.store.commit(t.base, t.catalog, t.changed, t.before)

    def _savepoint(self, c: _Cursor) -> Result:
        t = self._need_explicit()
        if c.accept("SAVEPOINT"):
            name = c.name()
            self._flush()
            t.savepoints.append((name, copy.deepcopy(t.catalog), set(t.changed), {}))
            return Result(True, f"Savepoint {name} set")
        release = bool(c.accept("RELEASE"))
        if not release:
            c.expect("ROLLBACK")
            c.expect("TO")
        c.accept("SAVEPOINT")
        name = c.name()
        at = max((i for i, s in enumerate(t.savepoints) if s[0] == name), default=-1)
        if at < 0:
            raise DialectError(f"Savepoint not found: {name}")
        if release:
            del t.savepoints[at:]
            return Result(True, f"Savepoint {name} released")
        _, catalog, changed, _ = t.savepoints[at]
        del t.savepoints[at + 1 :]
        t.catalog, t.changed, t.pending, t.failed = copy.deepcopy(catalog), set(changed), {}, False
        return Result(True, f"Rolled back to savepoint {name}")

    def _need_explicit(self) -> _Transaction:
        if not self._explicit or not self._txn:
            raise DialectError("No transaction is open")
        return self._txn

    # --- dispatch ------------------------------------------------------------------------------

    def _in_transaction(self, c: _Cursor, args: Sequence[object]) -> Result:
        outer, self._args = self._args, args
        try:
            return self._dispatch(c)
        finally:
            self._args = outer

    def _dispatch(self, c: _Cursor) -> Result:
        if c.peek("SELECT", "WITH"):
            return Result(True, rows=self._query(c.rest()))
        if c.peek("SAVEPOINT", "RELEASE", "ROLLBACK"):
            return self._savepoint(c)
        for word, handler in (
            ("INSERT", self._insert), ("UPDATE", self._update), ("DELETE", self._delete), ("CREATE", self._create), ("DROP", self._drop),
            ("CALL", self._call), ("EXPLAIN", self._explain), ("ANALYZE", self._analyze), ("VACUUM", self._vacuum), ("SHOW", self._show),
        ):
            if c.accept(word):
                result = handler(c)
                c.end()
                return result
        raise DialectError(f"Syntax error near {c._near()}")

    def _entry(self, kind: str, name: str) -> dict:
        found = self._txn.catalog[kind].get(name)
        if found is None:
            what = {"tables": "Table", "views": "View", "functions": "Function", "procedures": "Procedure", "sequences": "Sequence", "triggers": "Trigger", "extensions": "Extension"}[kind]
            raise DialectError(f"{what} not found: {name}")
        return found

    def _put(self, kind: str, name: str, value: object) -> None:
        if value is None:
            self._txn.catalog[kind].pop(name, None)
        else:
            self._txn.catalog[kind][name] = value
        self._txn.changed.add(f"{kind}/{name}")

    # --- queries -------------------------------------------------------------------------------

    def _frame(self, table: str) -> DataFrame:
        return self.store.read(self.spark, self._entry("tables", table))

    def _prepare(self, tokens: list[Token], seen: frozenset[str] = frozenset()) -> None:
        """Make the tables, views and functions that tokens name visible to Spark's analyzer."""
        catalog = self._txn.catalog
        for name, kind in list(self._registered.items()):
            if kind == "view" and name not in catalog["tables"] and name not in catalog["views"]:
                self.spark.catalog.dropTempView(name)
                del self._registered[name]
            elif kind == "function" and name not in catalog["functions"]:
                self.spark.sql(f"DROP TEMPORARY FUNCTION IF EXISTS `{name}`")
                del self._registered[name]
        for name in {t.text for t in tokens if t.kind in ("word", "quoted")}:
            if name in seen:
                raise DialectError(f"View {name} refers to itself")
            if name in catalog["tables"] or name in catalog["views"]:
                self._registered[name] = "view"
            elif name in catalog["functions"]:
                self._registered[name] = "function"
            if name in catalog["tables"]:
                self._frame(name).createOrReplaceTempView(name)
            elif name in catalog["views"]:
                body = tokenize(catalog["views"][name]["sql"])
                self._prepare(body, seen | {name})
                self.spark.sql(lower(with_default_names(body))).createOrReplaceTempView(name)
            elif name in catalog["functions"]:
                self._register(name, seen)

    def _register(self, name: str, seen: frozenset[str]) -> None:
        f = self._txn.catalog["functions"][name]
        if f["language"] == "SQL":
            self._prepare(tokenize(f["body"]), seen | {name})
            params = ", ".join(f"`{p}` {t}" for p, t in f["params"])
            self.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {f['returns']} RETURN ({lower(tokenize(f['body']))})")
            return
        module = importlib.import_module(self._entry("extensions", f["extension"])["module"])
        self.spark.udf.register(name, F.pandas_udf(_vectorised(getattr(module, f["symbol"])), f["returns"]))

    def _query(self, tokens: list[Token]) -> DataFrame:
        self._flush()
        self._check_ends(tokens)
        check_with(tokens)
        self._prepare(tokens)
        return self.spark.sql(lower(with_default_names(tokens), self._args))

    @staticmethod
    def _check_ends(tokens: list[Token]) -> None:
        if any(t.kind == "body" for t in tokens):
            raise DialectError("Syntax error: a quoted body is not part of a query")

    def _explain(self, c: _Cursor) -> Result:
        tokens = c.rest()
        if not tokens or not tokens[0].is_word("SELECT", "WITH"):
            raise DialectError("EXPLAIN needs a query")
        self._flush()
        self._prepare(tokens)
        return Result(True, rows=self.spark.sql("EXPLAIN COST " + lower(with_default_names(tokens), self._args)))

    def _show(self, c: _Cursor) -> Result:
        catalog = self._txn.catalog
        if c.expect("TABLES", "STATS") == "TABLES":
            return Result(True, rows=self.spark.createDataFrame([(n,) for n in sorted(catalog["tables"])], "table_name string"))
        kinds = ("tables", "views", "indexes", "sequences", "functions", "procedures", "triggers")
        rows = [(k, str(len(catalog[k]))) for k in kinds]
        return Result(True, rows=self.spark.createDataFrame(rows, "metric string, value string"))

    # --- values --------------------------------------------------------------------------------

    def _next_value(self, name: str) -> int:
        s = self._entry("sequences", name)
        at, left = self._blocks.get(name, (0, 0))
        if not left:
            at, left = self.store.next_block(s["id"]) * SEQUENCE_BLOCK, SEQUENCE_BLOCK
        self._blocks[name] = (at + 1, left - 1)
        self._current[name] = s["start"] + at * s["increment"]
        return self._current[name]

    def _value(self, tokens: list[Token]) -> str:
        """SQL text of one inserted value."""
        if tokens and tokens[0].is_word("NEXTVAL", "CURRVAL"):
            name = tokens[2].text
            if tokens[0].is_word("NEXTVAL"):
                return literal(self._next_value(name))
            self._entry("sequences", name)
            if name not in self._current:
                raise DialectError(f"currval of sequence {name} is not yet defined in this session")
            return literal(self._current[name])
        return lower(tokens, self._args)

    def _default(self, column: dict) -> str:
        d = column.get("default")
        if not d:
            return "NULL"
        if d["kind"] == "nextval":
            return literal(self._next_value(d["value"]))
        return DEFAULT_NOW.get(d["value"], d["value"]) if d["kind"] == "now" else d["value"]

    # --- DML -----------------------------------------------------------------------------------

    def _insert(self, c: _Cursor) -> Result:
        c.expect("INTO")
        table = c.name()
        entry = self._entry("tables", table)
        columns = entry["columns"]
        names = [x["name"] for x in columns]
        given = names
        if c.symbol("("):
            given = [c.name()]
            while c.symbol(","):
                given.append(c.name())
            c.need(")")
        index = {n.lower(): i for i, n in enumerate(names)}
        unknown = [g for g in given if g.lower() not in index]
        if unknown:
            raise DialectError(f"Column not found: {unknown[0]}")
        if c.peek("SELECT", "WITH"):
            rows = self._query(c.rest())
            return self._insert_rows(table, rows, given)
        c.expect("VALUES")
        count = 0
        while True:
            c.need("(")
            values = [self._value(c.until())]
            while c.symbol(","):
                values.append(self._value(c.until()))
            c.need(")")
            if len(values) != len(given):
                raise DialectError(f"Column count {len(given)} does not match value count {len(values)}")
            by_name = {g.lower(): v for g, v in zip(given, values, strict=True)}
            row = [by_name[n.lower()] if n.lower() in by_name else self._default(x) for n, x in zip(names, columns, strict=True)]
            self._insert_one(table, entry, row)
            count += 1
            if not c.symbol(","):
                return Result(True, f"Inserted {count} row(s)")

    def _insert_one(self, table: str, entry: dict, row: list[str]) -> None:
        typed = self._typed(entry, row)
        if self._triggers(table, "INSERT"):
            self._flush()
            frame = self.spark.sql(f"SELECT {typed}")
            found = frame.collect()
            self._fire(table, "BEFORE", "INSERT", found)
            self._append(table, self.spark.createDataFrame(found, StructType.fromJson(entry["schema"])))
            self._fire(table, "AFTER", "INSERT", found)
        else:
            if any(x["declared"] in ("JSON", "JSONB") and not x["array"] or x["not_null"] for x in entry["columns"]):
                self.spark.sql(f"SELECT {typed}").collect()  # rejects the row now rather than at commit
            self._txn.pending.setdefault(table, []).append(row)

    def _typed(self, entry: dict, row: list[str]) -> str:
        out = []
        for x, v in zip(entry["columns"], row, strict=True):
            if x["declared"] in ("JSON", "JSONB") and not x["array"]:
                v = _checked_json(v)
            if x["not_null"]:
                message = literal(f"Column {x['name']} must not be NULL")
                v = f"coalesce({v}, raise_error({message}))"
            out.append(f"CAST({v} AS {x['type']}) AS `{x['name']}`")
        return ", ".join(out)

    def _flush(self) -> None:
        """Write the rows that INSERT statements have gathered, one folder per table."""
        t = self._txn
        if not t or not t.pending:
            return
        pending, t.pending = t.pending, {}
        for table, rows in pending.items():
            if table in t.catalog["tables"]:
                entry = t.catalog["tables"][table]
                self._append(table, self._values_frame(entry, rows))

    def _values_frame(self, entry: dict, rows: list[list[str]]) -> DataFrame:
        """One inline table of all rows; values that are no constants make one query per row instead."""
        names = ", ".join(f"`{x['name']}`" for x in entry["columns"])
        if not any("select" in v.lower() for r in rows for v in r):
            each = ", ".join(f"({', '.join(f'CAST({v} AS {x["type"]})' for v, x in zip(r, entry['columns'], strict=True))})" for r in rows)
            try:
                checked = self._typed(entry, [f"`{x['name']}`" for x in entry["columns"]])
                return self.spark.sql(f"SELECT {checked} FROM VALUES {each} AS t({names})").coalesce(1)
            except AnalysisException:  # a value that cannot stand in an inline table
                pass
        return self.spark.sql(" UNION ALL ".join(f"SELECT {self._typed(entry, r)}" for r in rows)).coalesce(1)

    def _append(self, table: str, rows: DataFrame) -> None:
        entry = copy.deepcopy(self._entry("tables", table))
        entry["folders"].append(self.store.write(table, rows))
        self._put("tables", table, entry)

    def _insert_rows(self, table: str, rows: DataFrame, given: list[str]) -> Result:
        entry = self._entry("tables", table)
        if len(rows.columns) != len(given):
            raise DialectError(f"Column count {len(given)} does not match value count {len(rows.columns)}")
        source = dict(zip((g.lower() for g in given), rows.toDF(*[f"_{i}" for i in range(len(given))]).columns, strict=True))
        renamed = rows.toDF(*source.values())
        out = [
            (F.col(source[x["name"].lower()]) if x["name"].lower() in source else F.expr(self._default(x))).cast(x["type"]).alias(x["name"])
            for x in entry["columns"]
        ]
        filled = renamed.select(*out)
        if self._triggers(table, "INSERT"):
            found = filled.collect()  # row triggers see each row, one by one
            self._fire(table, "BEFORE", "INSERT", found)
            self._append(table, self.spark.createDataFrame(found, StructType.fromJson(entry["schema"])))
            self._fire(table, "AFTER", "INSERT", found)
        else:
            self._append(table, filled)
        return Result(True, "Inserted rows of the query")

    def _where(self, c: _Cursor) -> str:
        return lower(c.rest(), self._args) if c.accept("WHERE") else "TRUE"

    def _update(self, c: _Cursor) -> Result:
        self._flush()
        table = c.name()
        entry = self._entry("tables", table)
        c.expect("SET")
        types = {x["name"].lower(): x for x in entry["columns"]}
        sets: dict[str, str] = {}
        while True:
            column = c.name()
            if column.lower() not in types:
                raise DialectError(f"Column not found: {column}")
            c.need("=")
            value = lower(c.until("WHERE"), self._args)
            x = types[column.lower()]
            if x["declared"] in ("JSON", "JSONB"):
                value = _checked_json(value)
            sets[x["name"]] = f"CAST({value} AS {x['type']})"
            if not c.symbol(","):
                break
        if c.peek("WHERE"):
            self._prepare(c.tokens[c.i :])
        where = self._where(c)
        self._frame(table).createOrReplaceTempView(table)
        picked = ", ".join(f"{sets[x['name']]} AS `{x['name']}`" if x["name"] in sets else f"`{x['name']}`" for x in entry["columns"])
        hit = self.spark.sql(f"SELECT {picked} FROM {table} WHERE {where}")
        n = self._rewrite(table, entry, where, hit, "UPDATE")
        return Result(True, f"Updated {n} row(s)")

    def _delete(self, c: _Cursor) -> Result:
        self._flush()
        c.expect("FROM")
        table = c.name()
        entry = self._entry("tables", table)
        if c.peek("WHERE"):
            self._prepare(c.tokens[c.i :])
        where = self._where(c)
        self._frame(table).createOrReplaceTempView(table)
        n = self._rewrite(table, entry, where, None, "DELETE")
        return Result(True, f"Deleted {n} row(s)")

    def _rewrite(self, table: str, entry: dict, where: str, hit: DataFrame | None, event: str) -> int:
        """Copy on write: rows that the condition does not hold for, and the changed ones."""
        matched = self.spark.sql(f"SELECT * FROM {table} WHERE {where}")
        triggers = self._triggers(table, event)
        rows = (hit if hit is not None else matched).collect() if triggers else None  # row triggers see each row
        n = len(rows) if rows is not None else matched.count()
        if rows:
            self._fire(table, "BEFORE", event, rows)
            self._flush()
        if n:
            self._frame(table).createOrReplaceTempView(table)
            kept = self.spark.sql(f"SELECT * FROM {table} WHERE NOT coalesce({where}, FALSE)")
            new = copy.deepcopy(self._entry("tables", table))
            new["folders"] = [self.store.write(table, kept.unionByName(hit) if hit is not None else kept)]
            self._put("tables", table, new)
        if rows:
            self._fire(table, "AFTER", event, rows)
        return n

    # --- triggers and procedures ---------------------------------------------------------------

    def _triggers(self, table: str, event: str) -> list[dict]:
        return [t for t in self._txn.catalog["triggers"].values() if t["table"] == table and t["event"] == event]

    def _fire(self, table: str, when: str, event: str, rows: list) -> None:
        for t in self._triggers(table, event):
            if t["when"] != when:
                continue
            p = self._entry("procedures", t["handler"])
            for row in rows:
                values = row.asDict()
                missing = [n for n, _ in p["params"] if n not in values]
                if missing:
                    raise DialectError(f"Trigger parameter {missing[0]} is not a column of {table}")
                self._run_body(p, [values[n] for n, _ in p["params"]])

    def _run_body(self, procedure: dict, values: list[object]) -> int:
        if self._depth > 16:
            raise DialectError("Procedures are nested too deeply")
        bound = {n: v for (n, _), v in zip(procedure["params"], values, strict=True)}
        outer, self._depth = self._args, self._depth + 1
        try:
            done = 0
            for tokens in statements(procedure["body"]):
                if tokens[0].is_word("BEGIN", "START", "COMMIT", "ROLLBACK", "SAVEPOINT", "RELEASE"):
                    raise DialectError("Transaction control is not allowed in a procedure")
                args: list[object] = []
                out = []
                for t in tokens:
                    if t.kind == "word" and t.text in bound:
                        args.append(bound[t.text])
                        t = Token("parameter", f"${len(args)}", t.at)
                    out.append(t)
                self._args = args
                self._dispatch(_Cursor(out))
                done += 1
            return done
        finally:
            self._args, self._depth = outer, self._depth - 1

    def _call(self, c: _Cursor) -> Result:
        name = c.name()
        p = self._entry("procedures", name)
        c.need("(")
        texts = []
        if not c.symbol(")"):
            texts.append(lower(c.until(), self._args))
            while c.symbol(","):
                texts.append(lower(c.until(), self._args))
            c.need(")")
        if len(texts) != len(p["params"]):
            raise DialectError(f"Procedure {name} takes {len(p['params'])} argument(s), {len(texts)} given")
        typed = ", ".join(f"CAST({v} AS {t})" for v, (_, t) in zip(texts, p["params"], strict=True))
        values = list(self.spark.sql(f"SELECT {typed}").first()) if texts else []
        if self._explicit:
            return Result(True, f"Procedure {name} ran {self._run_body(p, values)} statement(s)")
        saved = copy.deepcopy(self._txn.catalog)
        try:
            return Result(True, f"Procedure {name} ran {self._run_body(p, values)} statement(s)")
        except Exception:
            self._txn.catalog, self._txn.pending, self._txn.changed = saved, {}, set()
            raise

    # --- DDL -----------------------------------------------------------------------------------

    def _type(self, c: _Cursor) -> tuple[str, str, bool]:
        """(declared, Spark type, is array) of a column type."""
        declared = c.take("word").text.upper()
        if declared == "DECIMAL":
            precision, scale = 10, 0
            if c.symbol("("):
                precision = int(c.take("number").text)
                if c.symbol(","):
                    scale = int(c.take("number").text)
                c.need(")")
            spark_type = f"decimal({precision},{scale})"
        elif declared in TYPES:
            if c.symbol("("):
                c.take("number")
                c.need(")")
            spark_type = TYPES[declared]
        else:
            raise DialectError(f"Unknown type: {declared}")
        is_array = c.symbol("[")
        if is_array:
            c.need("]")
        return declared, f"array<{spark_type}>" if is_array else spark_type, is_array

    def _create(self, c: _Cursor) -> Result:
        replace = bool(c.accept("OR") and c.expect("REPLACE"))
        kind = c.expect("TABLE", "VIEW", "INDEX", "SEQUENCE", "FUNCTION", "PROCEDURE", "TRIGGER", "EXTENSION")
        return getattr(self, f"_create_{kind.lower()}")(c, replace)

    def _free(self, name: str, what: str, *kinds: str) -> None:
        if any(name in self._txn.catalog[k] for k in kinds):
            raise DialectError(f"{what} already exists: {name}")

    def _create_table(self, c: _Cursor, replace: bool) -> Result:
        name = c.name()
        self._free(name, "Table or view", "tables", "views")
        c.need("(")
        columns = []
        while True:
            column = c.name()
            declared, spark_type, is_array = self._type(c)
            not_null, default = False, None
            if c.accept("NOT"):
                c.expect("NULL")
                not_null = True
            if c.accept("DEFAULT"):
                if now := c.accept("CURRENT_DATE", "CURRENT_TIME", "CURRENT_TIMESTAMP"):
                    default = {"kind": "now", "value": now}
                elif c.accept("NEXTVAL"):
                    c.need("(")
                    default = {"kind": "nextval", "value": c.take("string").text}
                    c.need(")")
                else:
                    default = {"kind": "literal", "value": lower(c.until("NOT"))}
                if c.accept("NOT"):
                    c.expect("NULL")
                    not_null = True
            if declared in ("SERIAL", "BIGSERIAL"):
                sequence = f"{name}_{column}_seq"
                self._new_sequence(sequence, 1, 1)
                default = {"kind": "nextval", "value": sequence}
            if any(x["name"].lower() == column.lower() for x in columns):
                raise DialectError(f"Column defined twice: {column}")
            columns.append({"name": column, "declared": declared, "type": spark_type, "array": is_array, "not_null": not_null, "default": default})
            if not c.symbol(","):
                break
        c.need(")")
        schema = self.spark.createDataFrame([], ", ".join(f"`{x['name']}` {x['type']}" for x in columns)).schema
        self._put("tables", name, {"columns": columns, "schema": schema.jsonValue(), "folders": []})
        return Result(True, f"Table {name} created")

    def _create_view(self, c: _Cursor, replace: bool) -> Result:
        name = c.name()
        self._free(name, "Table or view", "tables", "views")
        c.expect("AS")
        at = c.tokens[c.i :]
        self._query(at)  # analysis only: an invalid view is refused now
        c.rest()
        text = " ".join(_render(t) for t in at)
        self._put("views", name, {"sql": text})
        return Result(True, f"View {name} created")

    def _create_index(self, c: _Cursor, replace: bool) -> Result:
        name = c.name()
        self._free(name, "Index", "indexes")
        c.expect("ON")
        table = c.name()
        entry = self._entry("tables", table)
        c.need("(")
        columns = [c.name()]
        while c.symbol(","):
            columns.append(c.name())
        c.need(")")
        kind = c.expect(*INDEX_KINDS) if c.accept("USING") else "BTREE"
        known = {x["name"].lower() for x in entry["columns"]}
        for column in columns:
            if column.lower() not in known:
                raise DialectError(f"Column not found: {column}")
        if kind == "GIST" and len(columns) != 2:
            raise DialectError("A GIST index needs exactly two columns")
        if kind != "GIST" and len(columns) != 1:
            raise DialectError(f"A {kind} index needs exactly one column")
        self._put("indexes", name, {"table": table, "columns": columns, "kind": kind})
        return Result(True, f"Index {name} created: VACUUM {table} lays the data out by it")

    def _new_sequence(self, name: str, start: int, increment: int) -> None:
        self._free(name, "Sequence", "sequences")
        self._put("sequences", name, {"start": start, "increment": increment, "id": f"{name}-{time.time_ns()}"})

    def _create_sequence(self, c: _Cursor, replace: bool) -> Result:
        name, start, increment = c.name(), 1, 1
        if c.accept("START"):
            c.accept("WITH")
            start = int(c.take("number").text)
        if c.accept("INCREMENT"):
            c.accept("BY")
            increment = int(c.take("number").text)
        self._new_sequence(name, start, increment)
        return Result(True, f"Sequence {name} created")

    def _params(self, c: _Cursor) -> list[list[str]]:
        c.need("(")
        out: list[list[str]] = []
        while not c.symbol(")"):
            if out:
                c.need(",")
            name = c.name()
            out.append([name, self._type(c)[1]])
        return out

    def _create_function(self, c: _Cursor, replace: bool) -> Result:
        name = c.name()
        if not replace:
            self._free(name, "Function", "functions")
        params = self._params(c)
        c.expect("RETURNS")
        returns = self._type(c)[1]
        c.expect("AS")
        if c.i < len(c.tokens) and c.tokens[c.i].kind == "body":
            body = c.take("body").text
            c.expect("LANGUAGE")
            language = c.name().upper()
            if language != "SQL":
                raise DialectError(f"Language not supported: {language}")
            parts = statements(body)
            if len(parts) != 1 or not parts[0][0].is_word("SELECT"):
                raise DialectError("A SQL function's body is one SELECT")
            value = {"params": params, "returns": returns, "language": "SQL", "body": body.strip().rstrip(";")}
        else:
            extension = c.name()
            c.need(",")
            symbol = c.take("string").text
            c.expect("LANGUAGE")
            c.name()
            module = importlib.import_module(self._entry("extensions", extension)["module"])
            if not callable(getattr(module, symbol, None)):
                raise DialectError(f"Symbol not found in extension {extension}: {symbol}")
            value = {"params": params, "returns": returns, "language": "PYTHON", "extension": extension, "symbol": symbol}
        self._put("functions", name, value)
        return Result(True, f"Function {name} created")

    def _create_procedure(self, c: _Cursor, replace: bool) -> Result:
        name = c.name()
        if not replace:
            self._free(name, "Procedure", "procedures")
        params = self._params(c)
        c.expect("AS")
        body = c.take("body").text
        c.expect("LANGUAGE")
        c.name()
        if not statements(body):
            raise DialectError("A procedure needs at least one statement")
        self._put("procedures", name, {"params": params, "body": body})
        return Result(True, f"Procedure {name} created")

    def _create_trigger(self, c: _Cursor, replace: bool) -> Result:
        name = c.name()
        self._free(name, "Trigger", "triggers")
        when, event = c.expect("BEFORE", "AFTER"), c.expect("INSERT", "UPDATE", "DELETE")
        c.expect("ON")
        table = c.name()
        self._entry("tables", table)
        for word in ("FOR", "EACH", "ROW", "EXECUTE"):
            c.expect(word)
        c.expect("FUNCTION", "PROCEDURE")
        handler = c.name()
        self._entry("procedures", handler)
        c.need("(")
        c.need(")")
        self._put("triggers", name, {"table": table, "when": when, "event": event, "handler": handler})
        return Result(True, f"Trigger {name} created")

    def _create_extension(self, c: _Cursor, replace: bool) -> Result:
        name = c.name()
        self._free(name, "Extension", "extensions")
        c.expect("AS")
        module = c.take("string").text
        try:
            importlib.import_module(module)
        except ImportError as e:
            raise DialectError(f"Extension {name} cannot be loaded: {e}") from e
        self._put("extensions", name, {"module": module})
        return Result(True, f"Extension {name} created")

    def _drop(self, c: _Cursor) -> Result:
        word = c.expect("TABLE", "VIEW", "SEQUENCE", "FUNCTION", "PROCEDURE", "TRIGGER", "EXTENSION", "INDEX")
        kind = {"INDEX": "indexes"}.get(word, word.lower() + "s")
        name = c.name()
        if kind == "indexes" and name not in self._txn.catalog["indexes"]:
            raise DialectError(f"Index not found: {name}")
        if kind != "indexes":
            entry = self._entry(kind, name)
        if word == "TRIGGER":
            c.expect("ON")
            if c.name() != entry["table"]:
                raise DialectError(f"Trigger {name} is not on that table")
        if word == "TABLE":
            self._txn.pending.pop(name, None)
            for dependent in ("indexes", "triggers"):
                for other in [n for n, x in self._txn.catalog[dependent].items() if x["table"] == name]:
                    self._put(dependent, other, None)
            self._put("stats", name, None)
        if word == "SEQUENCE":
            self._blocks.pop(name, None)
            self._current.pop(name, None)
        self._put(kind, name, None)
        return Result(True, f"{word.capitalize()} {name} dropped")

    # --- maintenance ---------------------------------------------------------------------------

    def _analyze(self, c: _Cursor) -> Result:
        self._flush()
        table = c.name()
        frame = self._frame(table)
        plain = [f for f in frame.schema.fields if f.dataType.typeName() not in ("array", "map", "struct", "binary", "variant")]
        parts = [F.count("*").alias("rows")]
        for f in plain:
            parts += [F.approx_count_distinct(f.name).alias(f"d_{f.name}"), F.min(f.name).cast("string").alias(f"l_{f.name}"), F.max(f.name).cast("string").alias(f"h_{f.name}")]
        found = frame.agg(*parts).first().asDict()
        columns = {f.name: {"distinct": found[f"d_{f.name}"], "min": found[f"l_{f.name}"], "max": found[f"h_{f.name}"]} for f in plain}
        self._put("stats", table, {"rows": found["rows"], "columns": columns})
        return Result(True, f"Analyzed {table}: {found['rows']} row(s), {len(frame.columns)} column(s)")

    def _vacuum(self, c: _Cursor) -> Result:
        """Compact a table's folders into one, laid out by its first index; sweep unnamed folders."""
        self._flush()
        table = c.name()
        entry = copy.deepcopy(self._entry("tables", table))
        before = len(entry["folders"])
        if before:
            order = next((x["columns"] for x in self._txn.catalog["indexes"].values() if x["table"] == table and x["kind"] in ("BTREE", "BRIN", "GIST", "BITMAP", "HASH")), None)
            frame = self._frame(table)
            frame = frame.repartitionByRange(*order) if order else frame.coalesce(max(1, frame.rdd.getNumPartitions() // 8))
            entry["folders"] = [self.store.write(table, frame, order)]
            self._put("tables", table, entry)
        live = set(entry["folders"])
        if self._explicit:
            return Result(True, f"Vacuumed {table}: reclaimed 0 folder(s), compacted {before}")
        self._publish()
        self._txn.changed = set()
        return Result(True, f"Vacuumed {table}: reclaimed {self.store.sweep(table, live, self._txn.pin)} folder(s), compacted {before}")


def _checked_json(value: str) -> str:
    """SQL text that gives the value, fails where it is no JSON, and keeps NULL."""
    return f"nvl2({value}, nvl2(try_parse_json({value}), {value}, raise_error('Invalid JSON')), NULL)"


def _render(t: Token) -> str:
    if t.kind == "string":
        return "'" + t.text.replace("'", "''") + "'"
    return f"`{t.text}`" if t.kind == "quoted" else t.text


def _vectorised(call):
    """An extension's function as a pandas UDF takes it, with its types spelled out."""

    def run(*columns):
        return call(*columns)

    run.__annotations__ = {"columns": pd.Series, "return": pd.Series}
    return run


class Engine:
    """A database below one folder; sessions are independent of each other."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root
        self._default = Session(spark, root)

    def session(self, **options) -> Session:
        return Session(self.spark, self.root, **options)

    def execute(self, sql: str, args: Sequence[object] = ()) -> Result:
        return self._default.execute(sql, args)

    def sql(self, sql: str, args: Sequence[object] = ()) -> DataFrame:
        return self._default.sql(sql, args)
