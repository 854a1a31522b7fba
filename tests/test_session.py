"""The dialect end to end, on small hand-written tables."""

from __future__ import annotations

import time
import uuid
from datetime import date, datetime
from decimal import Decimal

import pytest

from tessera.session import Engine, Session
from tessera.sources.storage import ConflictError


@pytest.fixture
def db(spark, tmp_path) -> Session:
    return Session(spark, str(tmp_path / uuid.uuid4().hex))


def run(db: Session, *sqls: str) -> None:
    for sql in sqls:
        result = db.execute(sql)
        assert result.ok, f"{sql}: {result.message}"


def rows(db: Session, sql: str, *args) -> list[tuple]:
    result = db.execute(sql, args)
    assert result.ok, result.message
    return sorted(tuple(r) for r in result.collect())


def fails(db: Session, sql: str, part: str = "") -> None:
    result = db.execute(sql)
    assert not result.ok
    assert part.lower() in result.message.lower(), result.message


def test_crud_and_messages(db):
    run(db, "CREATE TABLE users (id INT, name VARCHAR(20), age INT)", "INSERT INTO users VALUES (1, 'Ann', 30), (2, 'O''Hara', 25)", "INSERT INTO users (id) VALUES (3);")
    assert rows(db, "SELECT * FROM users WHERE age > 20") == [(1, "Ann", 30), (2, "O'Hara", 25)]
    assert db.execute("UPDATE users SET age = 31, name = 'Anna' WHERE id = 1").message == "Updated 1 row(s)"
    assert db.execute("DELETE FROM users WHERE age IN (SELECT MAX(age) FROM users)").message == "Deleted 1 row(s)"
    assert rows(db, "SELECT id FROM users") == [(2,), (3,)]
    assert db.execute("UPDATE users SET age = 1 WHERE id = 99").message == "Updated 0 row(s)"
    assert db.execute("ANALYZE users").message == "Analyzed users: 2 row(s), 3 column(s)"
    fails(db, "INSERT INTO users VALUES (1)", "does not match")
    fails(db, "CREATE TABLE users (id INT)", "exists")
    fails(db, "SELECT * FROM nowhere")
    fails(db, "SELEC 1", "syntax")
    run(db, "DROP TABLE users")
    assert rows(db, "SHOW TABLES") == []


def test_three_valued_logic_keeps_nulls_out_of_delete(db):
    run(db, "CREATE TABLE t (id INT, x INT)", "INSERT INTO t VALUES (1, 5), (2, NULL)")
    assert rows(db, "SELECT id FROM t WHERE NOT x > 1") == []
    assert db.execute("DELETE FROM t WHERE x > 1").message == "Deleted 1 row(s)"
    assert rows(db, "SELECT id FROM t") == [(2,)]


def test_aggregates_names_and_having(db):
    run(db, "CREATE TABLE sales (id INT, region VARCHAR, amount INT)", "INSERT INTO sales VALUES (1,'east',100),(2,'east',150),(3,'west',200),(4,'west',50),(5,'west',300)")
    out = db.sql("SELECT region, COUNT(*), SUM(amount), AVG(amount), MIN(amount), MAX(amount) FROM sales GROUP BY region")
    assert out.columns == ["region", "COUNT(*)", "SUM(amount)", "AVG(amount)", "MIN(amount)", "MAX(amount)"]
    assert sorted(tuple(r) for r in out.collect()) == [("east", 2, 250, 125.0, 100, 150), ("west", 3, 550, 550 / 3, 50, 300)]
    assert rows(db, "SELECT region, COUNT(*) FROM sales GROUP BY region HAVING count(*) > 2") == [("west", 3)]
    assert rows(db, "SELECT SUM(amount) FROM sales WHERE id > 99") == [(None,)]


def test_special_predicates(db):
    run(
        db, "CREATE TABLE t (id INT, d VARCHAR, tags VARCHAR[], data JSON)",
        "INSERT INTO t VALUES (1, 'the quick brown fox', ARRAY['urgent', 'bug'], '{\"status\": \"active\", \"count\": 42}')",
        "INSERT INTO t VALUES (2, 'foxglove flowers', ARRAY['low-priority'], '{\"status\": null}')",
        "INSERT INTO t VALUES (3, NULL, NULL, NULL)",
    )
    assert rows(db, "SELECT id FROM t WHERE d CONTAINS 'FOX'") == [(1,)]
    assert rows(db, "SELECT id FROM t WHERE d CONTAINS 'quick brown'") == []
    assert rows(db, "SELECT id FROM t WHERE tags @> 'urgent'") == [(1,)]
    assert rows(db, "SELECT id FROM t WHERE tags @> 'low'") == []
    assert rows(db, "SELECT id FROM t WHERE data ->> 'status' = 'active'") == [(1,)]
    assert rows(db, "SELECT id FROM t WHERE data ->> 'count' = '42'") == [(1,)]
    assert rows(db, "SELECT id FROM t WHERE data ->> 'none' = 'x'") == []
    fails(db, "INSERT INTO t (id, data) VALUES (4, '{invalid json}')")
    assert rows(db, "SELECT id FROM t WHERE d LIKE 'fox%'") == [(2,)]


def test_interval_ends_belong(db):
    run(db, "CREATE TABLE b (id INT, s INT, e INT)", "INSERT INTO b VALUES (1, 10, 15), (2, 20, 25), (3, NULL, 30)")
    assert rows(db, "SELECT id FROM b WHERE (s, e) OVERLAPS (16, 19)") == []
    assert rows(db, "SELECT id FROM b WHERE (s, e) OVERLAPS (15, 20)") == [(1,), (2,)]


def test_transactions(db, spark):
    run(db, "CREATE TABLE t (id INT)", "BEGIN", "INSERT INTO t VALUES (1)")
    other = Session(spark, db.store.root)
    assert rows(db, "SELECT id FROM t") == [(1,)]
    assert rows(other, "SELECT id FROM t") == []
    run(db, "COMMIT")
    assert rows(other, "SELECT id FROM t") == [(1,)]
    run(db, "BEGIN", "INSERT INTO t VALUES (2)", "ROLLBACK")
    assert rows(db, "SELECT id FROM t") == [(1,)]


def test_poisoned_transaction(db):
    run(db, "CREATE TABLE t (id INT)", "BEGIN", "INSERT INTO t VALUES (1)")
    fails(db, "SELECT * FROM missing")
    fails(db, "INSERT INTO t VALUES (2)", "aborted")
    assert not db.execute("COMMIT").ok
    assert rows(db, "SELECT id FROM t") == []


def test_savepoints_nest(db):
    run(db, "CREATE TABLE t (id INT)", "START TRANSACTION", "INSERT INTO t VALUES (1)", "SAVEPOINT a", "INSERT INTO t VALUES (2)", "SAVEPOINT b", "INSERT INTO t VALUES (3)", "ROLLBACK TO b")
    assert rows(db, "SELECT id FROM t") == [(1,), (2,)]
    run(db, "ROLLBACK TO SAVEPOINT a")
    fails(db, "RELEASE SAVEPOINT b", "not found")
    run(db, "ROLLBACK TO a", "RELEASE SAVEPOINT a", "COMMIT")
    assert rows(db, "SELECT id FROM t") == [(1,)]


def test_conflicting_writers(db, spark):
    run(db, "CREATE TABLE t (id INT)", "CREATE TABLE u (id INT)", "BEGIN", "INSERT INTO t VALUES (1)")
    other = Session(spark, db.store.root)
    run(other, "INSERT INTO u VALUES (7)")
    run(other, "INSERT INTO t VALUES (2)")
    assert not db.execute("COMMIT").ok
    assert rows(db, "SELECT id FROM t") == [(2,)]
    run(db, "BEGIN", "INSERT INTO t VALUES (3)")
    run(other, "INSERT INTO u VALUES (8)")
    run(db, "COMMIT")
    assert rows(db, "SELECT id FROM t") == [(2,), (3,)]
    assert rows(db, "SELECT id FROM u") == [(7,), (8,)]


def test_views_and_ctes(db):
    run(db, "CREATE TABLE e (id INT, name VARCHAR, salary INT)", "INSERT INTO e VALUES (1,'A',90000),(2,'B',60000),(3,'Carol',120000)", "CREATE VIEW rich AS SELECT id, name FROM e WHERE salary > 70000")
    assert rows(db, "SELECT name FROM rich") == [("A",), ("Carol",)]
    run(db, "INSERT INTO e VALUES (4, 'D', 80000)")
    assert len(rows(db, "SELECT name FROM rich")) == 3
    fails(db, "CREATE TABLE rich (id INT)", "exists")
    assert rows(db, "WITH x AS (SELECT name, salary FROM e WHERE salary > 100000) SELECT name FROM x") == [("Carol",)]
    run(db, "DROP VIEW rich")
    fails(db, "SELECT * FROM rich")


def test_recursion(db):
    run(db, "CREATE TABLE e (id INT, name VARCHAR, manager_id INT)", "INSERT INTO e VALUES (1,'CEO',0),(2,'VP1',1),(3,'VP2',1),(4,'M',2),(5,'I',4),(6,'J',3)")
    walk = "WITH RECURSIVE c AS (SELECT id, manager_id FROM e WHERE manager_id = 0 UNION ALL SELECT e.id, e.manager_id FROM e JOIN c ON e.manager_id = c.id) SELECT id FROM c"
    assert rows(db, walk) == [(i,) for i in range(1, 7)]
    fails(db, walk.replace("RECURSIVE ", ""), "RECURSIVE")
    fails(db, "WITH RECURSIVE c AS (SELECT id FROM e) SELECT id FROM c", "UNION ALL")


def test_sequences_and_defaults(db):
    run(db, "CREATE SEQUENCE s START WITH 100 INCREMENT BY 5", "CREATE TABLE t (id INT DEFAULT nextval('s'), name VARCHAR DEFAULT 'x', day DATE DEFAULT CURRENT_DATE)")
    fails(db, "INSERT INTO t (id) VALUES (currval('s'))", "not yet defined")
    run(db, "INSERT INTO t (name) VALUES ('a')", "INSERT INTO t (name) VALUES ('b')", "INSERT INTO t (id) VALUES (currval('s'))")
    assert [r[:2] for r in rows(db, "SELECT id, name FROM t")] == [(100, "a"), (105, "b"), (105, "x")]
    assert rows(db, "SELECT COUNT(*) FROM t WHERE day IS NOT NULL") == [(3,)]
    run(db, "CREATE TABLE u (id SERIAL, name VARCHAR)", "INSERT INTO u (name) VALUES ('a')", "INSERT INTO u (name) VALUES ('b')")
    assert rows(db, "SELECT id FROM u") == [(1,), (2,)]


def test_not_null_is_enforced(db):
    run(db, "CREATE TABLE t (id INT NOT NULL, x INT)")
    fails(db, "INSERT INTO t (x) VALUES (1)", "NULL")
    run(db, "INSERT INTO t VALUES (1, NULL)")


def test_functions_procedures_triggers(db):
    run(db, "CREATE TABLE orders (id INT, customer_id INT)", "INSERT INTO orders VALUES (1,5),(2,5),(3,6)", "CREATE TABLE customers (id INT)", "INSERT INTO customers VALUES (5),(6),(7)")
    run(db, "CREATE FUNCTION order_count(c INT) RETURNS BIGINT AS $$ SELECT COUNT(*) FROM orders WHERE customer_id = c $$ LANGUAGE SQL")
    assert rows(db, "SELECT id, order_count(id) FROM customers") == [(5, 2), (6, 1), (7, 0)]
    fails(db, "CREATE FUNCTION order_count(c INT) RETURNS BIGINT AS $$ SELECT 1 $$ LANGUAGE SQL", "exists")
    run(db, "CREATE TABLE audit (emp_id INT, what VARCHAR)")
    run(db, "CREATE PROCEDURE note(id INT) AS $$ INSERT INTO audit VALUES (id, 'id; kept') $$ LANGUAGE SQL", "CREATE TRIGGER g AFTER INSERT ON customers FOR EACH ROW EXECUTE PROCEDURE note()", "INSERT INTO customers VALUES (8)")
    assert rows(db, "SELECT * FROM audit") == [(8, "id; kept")]
    run(db, "CREATE PROCEDURE bad(id INT) AS $$ INSERT INTO audit VALUES (id, 'half'); INSERT INTO nowhere VALUES (1) $$ LANGUAGE SQL", "CREATE TRIGGER h BEFORE DELETE ON customers FOR EACH ROW EXECUTE PROCEDURE bad()")
    fails(db, "DELETE FROM customers WHERE id = 8")
    assert rows(db, "SELECT emp_id FROM audit") == [(8,)]
    assert (8,) in rows(db, "SELECT id FROM customers")
    fails(db, "CALL bad(1)")
    assert rows(db, "SELECT emp_id FROM audit") == [(8,)]
    fails(db, "CALL note()", "argument")
    run(db, "DROP TRIGGER h ON customers", "DELETE FROM customers WHERE id = 8", "DROP PROCEDURE bad")
    fails(db, "CREATE TRIGGER z BEFORE DELETE ON customers FOR EACH ROW EXECUTE PROCEDURE missing()", "not found")


def test_extension_functions(db):
    run(db, "CREATE EXTENSION ints AS 'tessera.functions.samples'", "CREATE FUNCTION plus(a INT, b INT) RETURNS INT AS ints, 'add_ints' LANGUAGE PYTHON", "CREATE TABLE t (a INT, b INT)", "INSERT INTO t VALUES (1, 2), (5, NULL)")
    assert rows(db, "SELECT a, plus(a, 10) FROM t") == [(1, 11), (5, 15)]
    assert db.execute("SELECT plus(a, b) AS x FROM t WHERE a = 1").collect()[0][0] == 3
    fails(db, "CREATE FUNCTION q(a INT) RETURNS INT AS ints, 'missing' LANGUAGE PYTHON", "symbol")
    fails(db, "CREATE EXTENSION no AS 'no.such.module'", "loaded")


def test_indexes_and_vacuum(db):
    run(db, "CREATE TABLE t (id INT, lo INT, hi INT)", *[f"INSERT INTO t VALUES ({i}, {i}, {i + 2})" for i in range(6)])
    fails(db, "CREATE INDEX i ON t (lo) USING GIST", "two columns")
    fails(db, "CREATE INDEX i ON t (lo, hi) USING BRIN", "one column")
    run(db, "CREATE INDEX i ON t (id) USING BTREE", "DELETE FROM t WHERE id = 3")
    before = rows(db, "SELECT * FROM t")
    assert db.execute("VACUUM t").message.startswith("Vacuumed t: reclaimed")
    assert rows(db, "SELECT * FROM t") == before
    assert len(db.store.files.names("data/t")) == 1


def test_windows_and_parameters(db):
    run(db, "CREATE TABLE s (id INT, region VARCHAR, amount INT)", "INSERT INTO s VALUES (1,'East',100),(2,'East',300),(3,'East',200),(4,'West',400)")
    assert rows(db, "SELECT id, ROW_NUMBER() OVER (PARTITION BY region ORDER BY amount) FROM s") == [(1, 1), (2, 3), (3, 2), (4, 1)]
    assert rows(db, "SELECT id FROM s WHERE region = $1 AND amount >= $2", "East", 200) == [(2,), (3,)]
    assert rows(db, "SELECT id FROM s WHERE region = $1", "x' OR 'a' = 'a") == []
    assert "Scan" in str(db.execute("EXPLAIN SELECT * FROM s WHERE id = 1").collect()[0][0])


def test_engine_survives_restart(spark, tmp_path):
    first = Engine(spark, str(tmp_path / "db"))
    assert first.execute("CREATE TABLE t (id SERIAL, v VARCHAR)").ok
    assert first.execute("INSERT INTO t (v) VALUES ('a')").ok
    second = Engine(spark, str(tmp_path / "db"))
    assert second.execute("INSERT INTO t (v) VALUES ('b')").ok
    ids = [r.id for r in second.sql("SELECT id FROM t").collect()]
    assert len(ids) == len(set(ids)) == 2


def test_slow_log(spark, tmp_path):
    db = Session(spark, str(tmp_path / "x"), slow_ms=0)
    db.execute("CREATE TABLE t (id INT)")
    assert db.slow_log and db.slow_log[0][0].startswith("CREATE")

def test_left_operands_of_the_own_predicates(db):
    run(db, "CREATE TABLE t (id INT, d VARCHAR, tags VARCHAR[])", "INSERT INTO t VALUES (1, 'The FOX', ARRAY['a']), (2, 'foxglove', ARRAY['b'])")
    assert rows(db, "SELECT id FROM t WHERE lower(d) CONTAINS 'fox'") == [(1,)]
    assert rows(db, "SELECT id FROM t WHERE NOT (d) CONTAINS 'fox' AND array_distinct(tags) @> 'b'") == [(2,)]
    assert rows(db, "SELECT id FROM t WHERE d LIKE $1", None) == []


def test_parameters_keep_their_types(db):
    found = db.sql("SELECT $1 AS d, $2 AS t, $3 AS n, $4 AS b", [date(2024, 2, 29), datetime(2024, 2, 29, 1, 2, 3, 4), Decimal("-12.340"), b"\x00a'"])
    assert [x for _, x in found.dtypes] == ["date", "timestamp_ntz", "decimal(5,3)", "binary"]
    assert tuple(found.first()) == (date(2024, 2, 29), datetime(2024, 2, 29, 1, 2, 3, 4), Decimal("-12.340"), bytearray(b"\x00a'"))


def test_vacuum_spares_open_snapshots_and_writers(spark, db):
    run(db, "CREATE TABLE t (id INT)", "INSERT INTO t VALUES (1), (2)")
    reader, writer = Session(spark, db.store.root), Session(spark, db.store.root)
    run(reader, "BEGIN")
    run(writer, "CREATE TABLE u (id INT)", "BEGIN", "INSERT INTO u VALUES (7)", "SAVEPOINT flushed")
    run(db, "DELETE FROM t WHERE id = 1", "VACUUM t", "VACUUM u")
    assert rows(reader, "SELECT id FROM t") == [(1,), (2,)]
    run(writer, "COMMIT")
    assert rows(db, "SELECT id FROM u") == [(7,)]
    run(reader, "ROLLBACK")
    run(db, "VACUUM t")
    assert len(db.store.files.names("data/t")) == 1 and db.store.files.names("pins") == []


def test_catalog_files_appear_whole_and_once(spark, db):
    files = db.store.files
    files.create("catalog/000000000099.json", "{}")
    with pytest.raises(ConflictError):
        files.create("catalog/000000000099.json", "[]")
    assert files.read("catalog/000000000099.json") == "{}" and files.names("tmp") == []


def test_insert_select_fires_row_triggers(db):
    run(
        db, "CREATE TABLE t (id INT, name VARCHAR)", "CREATE TABLE s (id INT, name VARCHAR)", "CREATE TABLE audit (id INT)", "INSERT INTO s VALUES (1, 'a'), (2, 'b')",
        "CREATE PROCEDURE note(id INT) AS $$ INSERT INTO audit VALUES (id) $$ LANGUAGE SQL", "CREATE TRIGGER w AFTER INSERT ON t FOR EACH ROW EXECUTE PROCEDURE note()",
        "INSERT INTO t SELECT id, name FROM s",
    )
    assert rows(db, "SELECT id FROM audit") == [(1,), (2,)] and rows(db, "SELECT name FROM t") == [("a",), ("b",)]


def test_many_inserts_in_one_transaction(db):
    run(db, "CREATE TABLE t (id INT, x DOUBLE, j JSON)", "BEGIN")
    began = time.monotonic()
    run(db, *[f"INSERT INTO t VALUES ({i}, {i}.5, NULL)" for i in range(100)], "COMMIT")
    assert time.monotonic() - began < 60
    assert db.sql("SELECT COUNT(*) AS n, SUM(x) AS s FROM t").first()[:] == (100, 5000.0)
