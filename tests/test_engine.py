"""The SQL engine: small fixtures, constraints, transactions, roles, policies, audit."""

import itertools

import pytest

from tessera.catalog import Outdated
from tessera.dialect import AccessDenied, SqlError
from tessera.security import AuditLog, RateLimiter, redact
from tessera.session import ConflictError, ConstraintError, DeadlineError, Engine

N = itertools.count()


@pytest.fixture
def eng(spark, tmp_path):
    return Engine(spark, str(tmp_path / f"e{next(N)}"))


def rows(df):
    return [tuple(r) for r in df.collect()]


def fill(e, name, ddl, values):
    e.sql(f"CREATE TABLE {name} ({ddl})")
    if values:
        e.sql(f"INSERT INTO {name} VALUES {values}")


def test_aggregates(eng):
    fill(eng, "emp", "id BIGINT PRIMARY KEY, dept TEXT, salary BIGINT", "(1,'a',100),(2,'a',200),(3,'b',300),(4,'b',400),(5,'c',500)")
    fill(eng, "nobody", "id BIGINT PRIMARY KEY, x BIGINT", "")
    assert rows(eng.sql("SELECT COUNT(*) AS n, SUM(salary) AS s, AVG(salary) AS a, MIN(salary) AS lo, MAX(salary) AS hi FROM emp")) == [(5, 1500, 300.0, 100, 500)]
    assert rows(eng.sql("SELECT COUNT(*) AS n FROM emp WHERE salary > 250")) == [(3,)]
    assert rows(eng.sql("SELECT COUNT(*) AS n, SUM(x) AS s FROM nobody")) == [(0, None)]
    assert rows(eng.sql("SELECT dept, SUM(salary) AS s FROM emp GROUP BY dept HAVING SUM(salary) > 400 ORDER BY dept")) == [("b", 700), ("c", 500)]


def test_windows(eng):
    fill(eng, "t", "id BIGINT, val BIGINT", "(3,5),(1,10),(2,20)")
    fill(eng, "scores", "id BIGINT", "(1),(1),(2)")
    assert rows(eng.sql("SELECT id, SUM(val) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM t ORDER BY id")) == [(1, 10), (2, 30), (3, 35)]
    assert [r[1] for r in rows(eng.sql("SELECT id, RANK() OVER (ORDER BY id) AS r FROM scores ORDER BY r"))] == [1, 1, 3]


def test_set_operations_and_subqueries(eng):
    fill(eng, "a", "id BIGINT", "(1),(2)")
    fill(eng, "b", "id BIGINT", "(2),(3)")
    q = lambda s: sorted(r[0] for r in rows(eng.sql(s)))
    assert q("SELECT id FROM a UNION ALL SELECT id FROM b") == [1, 2, 2, 3]
    assert q("SELECT id FROM a INTERSECT SELECT id FROM b") == [2]
    assert q("SELECT id FROM a EXCEPT SELECT id FROM b") == [1]
    assert q("SELECT id FROM a WHERE id IN (SELECT id FROM b)") == [2]
    assert q("SELECT id FROM a WHERE id NOT IN (SELECT id FROM b)") == [1]
    assert q("WITH RECURSIVE r AS (SELECT 1 AS id UNION ALL SELECT id + 1 FROM r WHERE id < 3) SELECT id FROM r") == [1, 2, 3]


def test_literals_and_types(eng):
    assert rows(eng.sql("SELECT 4*5 AS a, 1/2 AS b, 10%3 AS c, NOT true AS d, 10-3-2 AS e, 'it''s \\ ok' AS f")) == [(20, 0.5, 1, False, 5, "it's \\ ok")]
    fill(eng, "ev", "d DATE, ts TIMESTAMP, body TEXT, ok BOOLEAN", "('2026-05-20', '2026-05-20 01:02:03', 'hello', 'yes')")
    assert rows(eng.sql("SELECT body FROM ev WHERE d = '2026-05-20' AND ok = true")) == [("hello",)]
    with pytest.raises(Exception):
        eng.sql("INSERT INTO ev VALUES ('20 May', '2026-05-20', 'x', 'true')")
    assert eng.sql("SELECT * FROM ev").count() == 1


def test_vectors(eng):
    fill(eng, "docs", "id BIGINT PRIMARY KEY, emb VECTOR(3)", "(1,'[0,0,0]'),(2,'[1,0,0]'),(3,'[3,0,0]')")
    assert rows(eng.sql("SELECT id FROM docs ORDER BY emb <-> '[0,0,0]' LIMIT 2")) == [(1,), (2,)]
    assert rows(eng.sql("SELECT a.id, a.emb <-> b.emb AS d FROM docs a JOIN docs b ON b.id = 3 ORDER BY a.id")) == [(1, 3.0), (2, 2.0), (3, 0.0)]
    with pytest.raises(Exception):
        eng.sql("INSERT INTO docs VALUES (4, '[1,2]')")


def test_constraints_leave_no_ghost(eng):
    fill(eng, "u", "id BIGINT PRIMARY KEY, email TEXT UNIQUE, name TEXT NOT NULL", "(1,'a','x'),(2,NULL,'y'),(3,NULL,'z')")
    for bad in ("(1,'b','x')", "(4,'a','x')", "(5,'c',NULL)", "(6,'d','x'),(6,'e','x')"):
        with pytest.raises(ConstraintError):
            eng.sql(f"INSERT INTO u VALUES {bad}")
    with pytest.raises(ConstraintError):
        eng.sql("UPDATE u SET id = 1")
    with pytest.raises(ConstraintError):
        eng.sql("UPDATE u SET name = NULL WHERE id = 2")
    assert eng.sql("SELECT * FROM u").count() == 3
    with pytest.raises(SqlError):
        eng.sql("INSERT INTO u (id, nope) VALUES (9, 1)")
    eng.sql("INSERT INTO u (name, id) SELECT name, id + 10 FROM u WHERE id = 1")
    assert rows(eng.sql("SELECT id, email FROM u WHERE id = 11")) == [(11, None)]


def test_update_delete_alter(eng):
    fill(eng, "s", "id BIGINT PRIMARY KEY, name TEXT, pay BIGINT", "(1,'a',100),(2,'b',200)")
    eng.sql("INSERT INTO s VALUES (3,'c',NULL)")
    before = [f for f in eng.catalog.state["tables"]["s"]["folders"]]
    eng.sql("UPDATE s SET pay = pay + 5, name = name || '!' WHERE id = 1")
    assert eng.catalog.state["tables"]["s"]["folders"][1] == before[1]  # untouched rows are not written again
    eng.sql("DELETE FROM s WHERE pay > 150")
    assert sorted(rows(eng.sql("SELECT * FROM s")), key=str) == [(1, "a!", 105), (3, "c", None)]
    eng.sql("ALTER TABLE s ADD COLUMN email TEXT")
    eng.sql("INSERT INTO s VALUES (4,'d',1,'d@x')")
    assert rows(eng.sql("SELECT id, email FROM s ORDER BY id")) == [(1, None), (3, None), (4, "d@x")]
    with pytest.raises(SqlError):
        eng.sql("ALTER TABLE s ADD email TEXT")
    eng.sql("CREATE INDEX i ON s(pay)")
    eng.compact("s")
    assert len(eng.catalog.state["tables"]["s"]["folders"]) == 1 and eng.sql("SELECT * FROM s").count() == 3
    eng.sql("DROP TABLE s")
    with pytest.raises(Exception):
        eng.sql("SELECT * FROM s").count()
    eng.sql("CREATE TABLE IF NOT EXISTS s (id INT)")
    eng.sql("CREATE TABLE IF NOT EXISTS s (id INT)")
    with pytest.raises(SqlError):
        eng.sql("CREATE TABLE s (id INT)")


def test_transactions(eng):
    fill(eng, "t", "id BIGINT PRIMARY KEY, v TEXT", "(1,'one')")
    eng.sql("BEGIN")
    eng.sql("INSERT INTO t VALUES (2,'two')")
    eng.sql("DELETE FROM t WHERE id = 1")
    assert rows(eng.sql("SELECT id FROM t")) == [(2,)]
    assert rows(eng.sql("SELECT id FROM t", session="other")) == [(1,)]
    eng.sql("COMMIT")
    assert rows(eng.sql("SELECT id FROM t", session="other")) == [(2,)]
    eng.sql("BEGIN")
    eng.sql("DELETE FROM t")
    eng.sql("ROLLBACK")
    assert eng.sql("SELECT * FROM t").count() == 1
    for s in ("x", "y"):
        eng.sql("BEGIN", session=s)
        eng.sql("UPDATE t SET v = 'z'", session=s)
    eng.sql("COMMIT", session="x")
    with pytest.raises(ConflictError):
        eng.sql("COMMIT", session="y")
    with pytest.raises(SqlError):
        eng.sql("COMMIT")


def test_reopen(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "r"))
    fill(e, "t", "id BIGINT PRIMARY KEY", "(1),(2)")
    e.sql("ALTER TABLE t ENABLE ROW LEVEL SECURITY")
    again = Engine(spark, str(tmp_path / "r"))
    assert rows(again.sql("SELECT COUNT(*) AS n FROM t")) == [(0,)]  # protected, no policy: nothing is visible


def test_prepared(eng):
    fill(eng, "docs", "title TEXT", "('secret-a'),('secret-b')")
    eng.sql("PREPARE q AS SELECT title FROM docs WHERE title = $1")
    assert rows(eng.sql("EXECUTE q ('secret-a')")) == [("secret-a",)]
    assert rows(eng.sql("EXECUTE q ('x'' OR 1=1')")) == []
    with pytest.raises(SqlError):
        eng.sql("EXECUTE q")
    with pytest.raises(SqlError):
        eng.sql("PREPARE d AS DELETE FROM docs")
    assert rows(eng.sql("SELECT title FROM docs WHERE title = $1", ["secret-b"])) == [("secret-b",)]


def test_roles_and_policies(eng):
    fill(eng, "t", "owner TEXT, val TEXT", "('alice','a1'),('bob','b1')")
    fill(eng, "o", "owner TEXT", "('alice'),('bob')")
    eng.sql("ALTER TABLE t ENABLE ROW LEVEL SECURITY")
    eng.sql("CREATE POLICY p ON t USING (owner = CURRENT_USER)")
    eng.sql("SET ROLE 'alice'", session="a")
    eng.sql("SET ROLE 'bob'", session="b")
    assert rows(eng.sql("SELECT val FROM t", session="a")) == [("a1",)]
    assert rows(eng.sql("SELECT val FROM t", session="b")) == [("b1",)]
    joined = "SELECT o.owner FROM o JOIN t ON t.owner = o.owner"
    assert rows(eng.sql(joined, session="a")) == [("alice",)]
    assert rows(eng.sql("SELECT owner FROM o WHERE owner IN (SELECT owner FROM t)", session="b")) == [("bob",)]
    eng.sql("UPDATE t SET val = 'mine'", session="a")
    eng.sql("DELETE FROM t", session="b")
    eng.sql("CREATE POLICY all2 ON t USING (true)")
    eng.sql("SET ROLE 'alice'")
    assert rows(eng.sql("SELECT val FROM t")) == [("mine",)]
    for bad in ("CREATE TABLE z (id INT)", "DROP TABLE t", "ANALYZE TABLE t", "ALTER TABLE t ADD x INT", "SET ROLE 'admin'", "CREATE POLICY q ON t USING (true)"):
        with pytest.raises(AccessDenied):
            eng.sql(bad, session="a")


def test_validation_audit_metrics(eng, tmp_path):
    for bad in ("", "  ", "SELECT 1; SELECT 2", "SELECT '\0'", "SELECT '" + "x" * 70_000 + "'", "FLY", "-- only a comment"):
        with pytest.raises(SqlError):
            eng.sql(bad)
    assert rows(eng.sql("SELECT 'a;b' AS x;")) == [("a;b",)]
    eng.sql("SELECT 'p' AS password, 1 AS one /* password = 'hunter2' */")
    assert eng.audit.verify() and "hunter2" not in open(eng.audit.path).read()
    assert len(eng.audit.entries()) == 2 and eng.audit.export_tsv().count("\n") == 1
    text = open(eng.audit.path).read()
    with open(eng.audit.path, "w") as f:
        f.write(text.replace('"rows_affected": 0', '"rows_affected": 7', 1))
    assert not AuditLog(eng.audit.path).verify()
    m = eng.metrics.render()
    assert "tessera_queries_total 9" in m and "tessera_query_errors_total 7" in m
    assert redact("CREATE USER u IDENTIFIED BY 'x' TOKEN='y'") == "CREATE USER u IDENTIFIED BY '***' TOKEN='***'"
    r = RateLimiter(1, 2)
    r.take("s", 0.0), r.take("s", 0.0)
    with pytest.raises(RuntimeError):
        r.take("s", 0.0)
    r.take("s", 1.5)


def test_explain_statistics_cache(eng):
    fill(eng, "t", "id BIGINT PRIMARY KEY, g TEXT", "(1,'a'),(2,'a'),(3,'b')")
    assert "Statistics" in eng.explain("SELECT g FROM t WHERE id = 1")
    got = {r["column"]: (r["n_rows"], r["n_distinct"]) for r in eng.sql("ANALYZE TABLE t").collect()}
    assert got == {"id": (3, 3), "g": (3, 2)}
    a = eng.sql("SELECT COUNT(*) AS n FROM t")
    assert eng.sql("SELECT COUNT(*) AS n FROM t") is a and eng.metrics.hits == 1
    eng.sql("DELETE FROM t WHERE id = 1")
    assert rows(eng.sql("SELECT COUNT(*) AS n FROM t")) == [(2,)]


def test_command_line(eng, capsys):
    from tessera.__main__ import run_line, scrub

    fill(eng, "t", "id BIGINT PRIMARY KEY, v TEXT", "(1,NULL)")
    assert run_line(eng, "SELECT id, v FROM t") and run_line(eng, "\\explain SELECT id FROM t") and run_line(eng, "\\help") and run_line(eng, "\\metrics")
    text = capsys.readouterr().out
    assert "1\t[NULL]" in text and "Statistics" in text and "tessera_queries_total" in text
    assert not run_line(eng, "\\q") and scrub(eng) == []


def test_deadline(spark, tmp_path):
    """It covers the execution of a query, not only its planning."""
    import time

    e = Engine(spark, str(tmp_path / "d"), deadline=60)
    assert rows(e.sql("SELECT 1 AS x, 2 AS x")) == [(1, 2)]
    e.deadline = 2
    began = time.monotonic()
    with pytest.raises(DeadlineError):
        e.sql("SELECT SUM(a.id * b.id % 7) AS s FROM range(3000000) a JOIN range(3000000) b ON a.id <> b.id")
    assert time.monotonic() - began < 40
    e.deadline = None
    assert rows(e.sql("SELECT 2 AS x")) == [(2,)]


def test_subqueries_of_changes_see_the_whole_table(eng):
    fill(eng, "t", "id BIGINT PRIMARY KEY, v BIGINT", "(1, 10), (2, 20)")
    eng.sql("INSERT INTO t VALUES (3, 1000), (4, 2000)")
    eng.sql("DELETE FROM t WHERE v > (SELECT AVG(v) FROM t)")
    assert sorted(rows(eng.sql("SELECT id FROM t"))) == [(1,), (2,)]
    eng.sql("INSERT INTO t VALUES (5, 50)")
    eng.sql("UPDATE t SET v = (SELECT MAX(v) FROM t) + t.v WHERE id < 3")
    assert sorted(rows(eng.sql("SELECT id, v FROM t"))) == [(1, 60), (2, 70), (5, 50)]


def test_two_engines_lose_no_commit(spark, tmp_path):
    path = str(tmp_path / "two")
    a, b = Engine(spark, path), Engine(spark, path)
    fill(a, "t", "id BIGINT PRIMARY KEY, v BIGINT", "(1, 1)")
    b.sql("INSERT INTO t VALUES (2, 2)")
    a.bulk_insert("t", spark.sql("SELECT 3L AS id, 3L AS v"))
    b.compact("t")
    assert sorted(rows(a.sql("SELECT id FROM t"))) == [(1,), (2,), (3,)]
    # a manifest written between loading and saving is noticed
    state = a.catalog.draft()
    b.sql("INSERT INTO t VALUES (4, 4)")
    with pytest.raises(Outdated):
        a.catalog.save(state)
    a.sql("BEGIN")
    a.bulk_insert("t", spark.sql("SELECT 5L AS id, 5L AS v"))
    b.sql("INSERT INTO t VALUES (6, 6)")
    with pytest.raises(ConflictError):
        a.sql("COMMIT")
    assert sorted(rows(a.sql("SELECT id FROM t"))) == [(1,), (2,), (3,), (4,), (6,)]
    assert a.vacuum() > 0 and a.vacuum() == 0 and len(rows(b.sql("SELECT id FROM t"))) == 5
    before = a.catalog.folders()
    a.sql("DROP TABLE t")
    assert before and a.catalog.folders() == []


def test_files_are_reached_through_tables_alone(eng):
    fill(eng, "t", "id BIGINT PRIMARY KEY, v TEXT", "(1, 'a')")
    eng.sql("ALTER TABLE t ENABLE ROW LEVEL SECURITY")
    eng.sql("SET ROLE 'nobody'")
    assert rows(eng.sql("SELECT id FROM t")) == []
    with pytest.raises(Exception):
        eng.sql(f"SELECT * FROM parquet.`{eng.catalog.path}/data/t/*`").collect()


def test_text_has_the_functions_meaning(eng):
    """CAST, TRIM, COUNT(), places of nulls, default frames and vectors in SQL text."""
    one = lambda q: rows(eng.sql(q))[0][0]
    assert one("SELECT CAST(7 AS TEXT) AS x") == "7" and one("SELECT CAST(CAST('f' AS BOOLEAN) AS VARCHAR) AS x") == "false"
    assert one("SELECT CAST(NULL AS BOOLEAN) AS x") is None and one("SELECT CAST(TRIM('\t 5\n') AS INT) + 1 AS x") == 6
    assert one("SELECT TRIM(BOTH 'x' FROM 'xax') AS x") == "a" and one("SELECT CAST('[1,2]' AS VECTOR(2)) <-> '[1,0]' AS x") == 2.0
    for bad in ("CAST('maybe' AS BOOLEAN)", "CAST('2026-5-1' AS DATE)", "CAST('[1]' AS VECTOR(2))", "CAST('[1]' AS VECTOR(1)) <-> '[1,2]'"):
        with pytest.raises(Exception):
            eng.sql(f"SELECT {bad} AS x").collect()
    fill(eng, "t", "id BIGINT PRIMARY KEY, g BIGINT", "(1, NULL), (2, 5), (3, 5), (4, 1)")
    assert [r[0] for r in rows(eng.sql("SELECT id FROM t ORDER BY g, id"))] == [4, 2, 3, 1]
    assert [r[0] for r in rows(eng.sql("SELECT id FROM t ORDER BY g DESC, id DESC -- nulls first\n"))] == [1, 3, 2, 4]
    assert sorted(rows(eng.sql("SELECT SUM(id) OVER (ORDER BY 1) > 0 AS p, COUNT() OVER (PARTITION BY 1 ORDER BY 1) AS n, LAG(id) OVER (ORDER BY id) AS l FROM t")))[-1][1] == 4
    assert sorted(r[0] for r in rows(eng.sql("SELECT COUNT(*) OVER (ORDER BY 1) AS n FROM t"))) == [1, 2, 3, 4]
    assert sorted(rows(eng.sql("WITH RECURSIVE a AS (SELECT 2 AS z), r(n, m) AS (SELECT 1, CAST(NULL AS INT) UNION SELECT n % 4 + 1, z FROM r, a), s AS (SELECT n FROM r WHERE m = 2) SELECT n FROM s"))) == [(1,), (2,), (3,), (4,)]


def test_vector_length_of_the_function(spark):
    from tessera.functions import l2_to

    df = spark.sql("SELECT array(0.0D, 0.0D) AS v UNION ALL SELECT NULL")
    assert sorted((r[0] is None, r[0]) for r in df.select(l2_to("v", [3.0, 4.0])).collect()) == [(False, 5.0), (True, None)]
    with pytest.raises(Exception):
        spark.sql("SELECT array(0.0D, 0.0D, 100.0D) AS v").select(l2_to("v", [0.0, 0.0])).collect()
