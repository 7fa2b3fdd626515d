import pytest

from tessera.engine import Engine, TransactionError
from tessera.store.manifest import ConflictError
from tessera.store.tables import CatalogError, ConstraintError


@pytest.fixture
def db(spark, tmp_path):
    return Engine(spark, str(tmp_path / "db"))


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_insert_defaults_auto_returning(db):
    db.sql("CREATE TABLE t (id INTEGER PRIMARY KEY AUTO_INCREMENT, name VARCHAR(5) NOT NULL, n INT DEFAULT 7 CHECK (n > 0), u TEXT UNIQUE)")
    got = db.sql("INSERT INTO t (name) VALUES ('a'), ('b') RETURNING id, name, n")
    assert sorted(map(tuple, got.collect())) == [(1, "a", 7), (2, "b", 7)]
    assert db.sql("INSERT INTO t (name, n) SELECT name, n + id FROM t").collect()[0][0] == 2
    assert rows(db.sql("SELECT id, n FROM t")) == [(1, 7), (2, 7), (3, 8), (4, 9)]
    for bad in ("INSERT INTO t (name) VALUES (NULL)", "INSERT INTO t (name) VALUES ('toolong')", "INSERT INTO t (name, n) VALUES ('a', 0)", "INSERT INTO t (id, name) VALUES (1, 'x')", "INSERT INTO t (name, u) VALUES ('a', 'k'), ('b', 'k')"):
        with pytest.raises(ConstraintError):
            db.sql(bad)
    with pytest.raises(CatalogError):
        db.sql("INSERT INTO t (nope) VALUES (1)")
    assert db.sql("SELECT count(*) FROM t").first()[0] == 4


def test_update_delete_upsert(db):
    db.sql("CREATE TABLE k (id INT PRIMARY KEY, v INT, s TEXT)")
    db.sql("INSERT INTO k VALUES (1, 10, 'a'), (2, 20, 'b'), (3, NULL, 'c')")
    assert rows(db.sql("UPDATE k SET v = v / 3, s = s || '!' WHERE v >= 10 RETURNING id, v, s")) == [(1, 3, "a!"), (2, 6, "b!")]
    assert rows(db.sql("DELETE FROM k WHERE v > 5 RETURNING id")) == [(2,)]
    assert rows(db.sql("SELECT id FROM k")) == [(1,), (3,)]
    db.sql("INSERT INTO k VALUES (1, 0, 'z'), (4, 4, 'd') ON CONFLICT DO NOTHING")
    db.sql("INSERT INTO k VALUES (1, 5, 'q'), (5, 5, 'e') ON CONFLICT (id) DO UPDATE SET v = excluded.v + v, s = 'up'")
    assert rows(db.sql("SELECT id, v, s FROM k")) == [(1, 8, "up"), (3, None, "c"), (4, 4, "d"), (5, 5, "e")]
    db.sql("CREATE TABLE o (id INT, total INT)")
    db.sql("INSERT INTO o VALUES (1, 100), (4, 400)")
    db.sql("UPDATE k SET v = o.total FROM o WHERE o.id = k.id")
    db.sql("UPDATE k SET s = (SELECT max(total) FROM o) WHERE id = 3")
    assert rows(db.sql("SELECT id, v, s FROM k")) == [(1, 100, "up"), (3, None, "400"), (4, 400, "d"), (5, 5, "e")]
    db.sql("DELETE FROM k USING o WHERE o.id = k.id")
    assert rows(db.sql("SELECT id FROM k")) == [(3,), (5,)]
    db.sql("TRUNCATE TABLE k")
    assert db.sql("SELECT count(*) FROM k").first()[0] == 0


def test_foreign_keys(db):
    db.sql("CREATE TABLE d (id INT PRIMARY KEY, name TEXT)")
    db.sql("CREATE TABLE e (id INT PRIMARY KEY, d INT REFERENCES d(id) ON DELETE CASCADE ON UPDATE CASCADE)")
    db.sql("CREATE TABLE p (id INT PRIMARY KEY, lead INT REFERENCES e(id) ON DELETE SET NULL, x INT, FOREIGN KEY (x) REFERENCES d(id))")
    db.sql("INSERT INTO d VALUES (1, 'a'), (2, 'b'), (3, 'c')")
    db.sql("INSERT INTO e VALUES (10, 1), (11, 2)")
    db.sql("INSERT INTO p VALUES (100, 10, 3), (101, 11, NULL)")
    with pytest.raises(ConstraintError):
        db.sql("INSERT INTO e VALUES (12, 9)")
    with pytest.raises(ConstraintError):
        db.sql("DELETE FROM d WHERE id = 3")
    db.sql("UPDATE d SET id = 20 WHERE id = 2")
    assert rows(db.sql("SELECT id, d FROM e")) == [(10, 1), (11, 20)]
    db.sql("DELETE FROM d WHERE id = 1")
    assert rows(db.sql("SELECT id FROM e")) == [(11,)]
    assert rows(db.sql("SELECT id, lead FROM p")) == [(100, None), (101, 11)]
    db.sql("SET foreign_keys = OFF")
    db.sql("INSERT INTO e VALUES (12, 9)")


def test_transactions_and_snapshots(db, spark):
    db.sql("CREATE TABLE a (id INT, v INT)")
    db.sql("INSERT INTO a VALUES (1, 1)")
    other = Engine(spark, db.storage.root)
    db.sql("BEGIN")
    db.sql("UPDATE a SET v = 2")
    db.sql("SAVEPOINT s1")
    db.sql("INSERT INTO a VALUES (2, 2)")
    db.sql("ROLLBACK TO s1")
    assert rows(db.table("a")) == [(1, 2)] and rows(other.table("a")) == [(1, 1)]
    with pytest.raises(TransactionError):
        db.sql("BEGIN")
    db.sql("RELEASE s1")
    db.sql("COMMIT")
    assert rows(Engine(spark, db.storage.root).table("a")) == [(1, 2)]
    with pytest.raises(ConflictError):
        other.sql("INSERT INTO a VALUES (9, 9)")
    db.sql("BEGIN")
    db.sql("DELETE FROM a")
    db.sql("ROLLBACK")
    assert rows(db.table("a")) == [(1, 2)]
    db.sql("BEGIN READ ONLY")
    with pytest.raises(TransactionError):
        db.sql("DELETE FROM a")
    db.sql("COMMIT")


def test_definitions(db):
    db.sql("CREATE SCHEMA IF NOT EXISTS shop")
    db.sql("CREATE TABLE IF NOT EXISTS t (a INT, b TEXT)")
    db.sql("CREATE TABLE IF NOT EXISTS t (x INT)")
    db.sql("INSERT INTO t VALUES (1, 'x'), (1, 'y')")
    with pytest.raises(ConstraintError):
        db.sql("CREATE UNIQUE INDEX i ON t (a)")
    db.sql("CREATE UNIQUE INDEX i ON t (a, lower(b)) WHERE a > 0")
    with pytest.raises(ConstraintError):
        db.sql("INSERT INTO t VALUES (1, 'X')")
    db.sql("DROP INDEX i")
    db.sql("INSERT INTO t VALUES (1, 'X')")
    db.sql("ALTER TABLE t ADD COLUMN c INT DEFAULT 5")
    db.sql("ALTER TABLE t RENAME COLUMN b TO label")
    db.sql("INSERT INTO t (a, label) VALUES (2, 'z')")
    assert rows(db.sql("SELECT a, label, c FROM t")) == [(1, "X", 5), (1, "x", 5), (1, "y", 5), (2, "z", 5)]
    db.sql("ALTER TABLE t DROP COLUMN c")
    db.sql("ALTER TABLE t RENAME TO u")
    db.sql("CREATE VIEW big AS SELECT a FROM u WHERE a > 1")
    assert rows(db.sql("SELECT * FROM big")) == [(2,)]
    assert "Scan" in db.sql("EXPLAIN SELECT * FROM u").first()[0]
    db.sql("DROP TABLE u")
    with pytest.raises(CatalogError):
        db.sql("DROP TABLE u")
    db.sql("DROP TABLE IF EXISTS u")


def test_queries(db, spark, sf_dir):
    db.register_dir(sf_dir, ["nation", "region"])
    assert db.sql("SELECT 7/2, 7.0/2, 1/0, 7 % 0, -7 % 3, 2^3^2, 0xff, 1 << 70").first()[:] == (3, 3.5, None, None, -1, 512, 255, None)
    assert db.sql("SELECT n_nationkey / 2 AS h FROM nation WHERE n_nationkey = 7").first().h == 3
    assert db.sql("SELECT LENGTH('é'), CHAR_LENGTH('é'), SUBSTR('hello', 0, 2), SUBSTR('hello', -3, 2), TRIM(' \t x '), FIELD('b', 'a', 'b'), STRCMP('a', 'b')").first()[:] == (2, 1, "", "ll", "x", 2, -1)
    assert db.sql("SELECT '{\"a\": {\"b\": [1, 2]}}' #>> '{a,b,1}', '{\"a\": 1}' ->> 'a', '{\"a\": 1, \"b\": 2}' @> '{\"a\": 1}', '[1,2]' && '[2,3]'").first()[:] == ("2", "1", True, True)
    assert db.sql("SELECT '[0,0]' <-> '[3,4]', '[1,0]' <=> '[0,1]', '[1,2]' <#> '[3,4]', '[1]' <-> '[1,2]'").first()[:] == (5.0, 1.0, 11.0, None)
    assert db.sql("SELECT CAST('x' AS INT), '12'::int, 'it''s'").first()[:] == (None, 12, "it's")
    assert db.sql("SELECT n_name FROM nation WHERE n_nationkey = $1", [3]).count() == 1
    by_key = db.prepare("SELECT n_name FROM nation WHERE n_nationkey = ?")
    assert by_key(1).count() == 1 and by_key(99).count() == 0


def test_bound_statements(db):
    db.sql("CREATE TABLE t (a INT, b TEXT, v DOUBLE)")
    add = db.prepare("INSERT INTO t VALUES (?, ?, ?)")
    add(1, "it's", 2.5)
    add(2, None, None)
    db.sql("UPDATE t SET b = $2 WHERE a = $1", [2, "two"])
    assert rows(db.sql("SELECT * FROM t")) == [(1, "it's", 2.5), (2, "two", None)]


def test_shell(db):
    import io

    from tessera import cli

    out = io.StringIO()
    text = "CREATE TABLE t (a INT,\n b TEXT);\nINSERT INTO t VALUES (1, NULL);\nSELECT * FROM t;\n.tables\n.schema t\nSELEC;\n.help\n.quit\nSELECT 1;\n"
    cli.run(db, io.StringIO(text), out)
    said = out.getvalue()
    assert "1 | NULL" in said and "t (a INT, b STRING)" in said and "Error" in said and said.rstrip().endswith(cli.HELP)


def test_engines_of_one_session_are_apart(spark, tmp_path):
    a, b = Engine(spark, str(tmp_path / "a")), Engine(spark, str(tmp_path / "b"))
    a.sql("CREATE TABLE z (k INT)")
    b.sql("CREATE TABLE z (k INT)")
    a.sql("INSERT INTO z VALUES (1)")
    b.sql("INSERT INTO z VALUES (2), (3)")
    kept = a.sql("SELECT k FROM z")
    assert rows(b.sql("SELECT k FROM z")) == [(2,), (3,)] and rows(a.sql("SELECT k FROM z")) == rows(kept) == [(1,)]
    b.sql("CREATE TABLE only_b (k INT)")
    with pytest.raises(Exception, match="only_b"):
        a.sql("SELECT * FROM only_b")
    reader, writer = Engine(spark, str(tmp_path / "b")), b
    reader.sql("BEGIN")
    writer.sql("DELETE FROM z WHERE k = 2")
    assert reader.sql("SELECT count(*) FROM z").first()[0] == 2 and writer.sql("SELECT count(*) FROM z").first()[0] == 1
    reader.sql("ROLLBACK")
    reader.sql("BEGIN")
    assert reader.sql("SELECT count(*) FROM z").first()[0] == 1


def test_clauses(db):
    db.sql("CREATE TABLE nums (id INT)")
    db.sql("INSERT INTO nums VALUES (1), (2), (3), (4), (5)")
    assert rows(db.sql("SELECT id * 2 AS doubled FROM nums HAVING doubled < 6")) == [(2,), (4,)]
    assert rows(db.sql("SELECT id AS i FROM nums WHERE id > 1 HAVING i < 5 ORDER BY i DESC LIMIT 2")) == [(3,), (4,)]
    assert rows(db.sql("SELECT * FROM (SELECT id + 1 AS i FROM nums HAVING i > 5) q UNION ALL SELECT id AS i FROM nums HAVING i = 1")) == [(1,), (6,)]
    assert rows(db.sql("SELECT sum(id) AS s FROM nums HAVING sum(id) > 3")) == [(15,)] and rows(db.sql("SELECT id % 2 AS p, count(*) AS n FROM nums GROUP BY p HAVING n > 2")) == [(1, 3)]
    assert rows(db.sql("SELECT id FROM nums ORDER BY id FETCH FIRST 2 ROWS ONLY")) == [(1,), (2,)]
    assert rows(db.sql("SELECT id FROM nums ORDER BY id OFFSET 3 ROWS FETCH NEXT ROW ONLY")) == [(4,)]
    assert rows(db.sql("SELECT id FROM nums ORDER BY id OFFSET 1 LIMIT 2")) == [(2,), (3,)]
    assert rows(db.sql("SELECT id FROM (SELECT id FROM nums ORDER BY id FETCH FIRST 1 ROW ONLY) q WHERE id IN (SELECT id FROM nums FOR SHARE) FOR UPDATE")) == [(1,)]
    assert db.sql("SELECT ARRAY[1,2,3,4][1:2], ARRAY[1,2,3][:1], ARRAY[1,2,3][1:], ARRAY[1][3:9], '[1,{\"a\":2},3]'[1:2]").first()[:] == ([2, 3], [1, 2], [2, 3], [], '[{"a":2},3]')


def test_upsert_order_and_returning(db):
    db.sql("CREATE TABLE u (id INT PRIMARY KEY, v INT)")
    db.sql("INSERT INTO u VALUES (1, 10), (2, 20)")
    assert rows(db.sql("INSERT INTO u VALUES (1, 5), (3, 7) ON CONFLICT (id) DO UPDATE SET v = v + excluded.v RETURNING id, v")) == [(1, 15), (3, 7)]
    assert rows(db.sql("INSERT INTO u VALUES (2, 1), (9, 1), (2, 2), (9, 4), (9, 8) ON CONFLICT (id) DO UPDATE SET v = 2 * v + excluded.v RETURNING *")) == [(2, 84), (9, 20)]
    assert rows(db.sql("INSERT INTO u VALUES (4, 1), (4, 2), (1, 0) ON CONFLICT DO NOTHING RETURNING *")) == [(4, 1)]
    assert rows(db.sql("SELECT * FROM u")) == [(1, 15), (2, 84), (3, 7), (4, 1), (9, 20)]


def test_merge(db):
    db.sql("CREATE TABLE m (k INT PRIMARY KEY, v INT CHECK (v < 1000), s TEXT DEFAULT 'd')")
    db.sql("CREATE TABLE src (k INT, v INT)")
    db.sql("INSERT INTO m VALUES (1, 10, 'a'), (2, 20, 'b'), (3, 30, 'c'), (4, 40, 'e')")
    db.sql("INSERT INTO src VALUES (1, 100), (2, -1), (5, 50), (6, 0), (3, 30)")
    text = "MERGE INTO m USING src AS s ON m.k = s.k WHEN MATCHED AND s.v < 0 THEN DELETE WHEN MATCHED AND m.v = s.v THEN DO NOTHING WHEN MATCHED THEN UPDATE SET v = m.v + s.v, s = 'up' WHEN NOT MATCHED AND s.v > 0 THEN INSERT (k, v) VALUES (s.k, s.v)"
    assert db.sql(text).first()[0] == 3
    assert rows(db.sql("SELECT * FROM m")) == [(1, 110, "up"), (3, 30, "c"), (4, 40, "e"), (5, 50, "d")]
    db.sql("INSERT INTO src VALUES (1, 1)")
    for bad in (text, "MERGE INTO m USING (SELECT 1 AS k) s ON m.k = s.k WHEN MATCHED THEN UPDATE SET v = 5000"):
        with pytest.raises(ConstraintError):
            db.sql(bad)
    assert rows(db.sql("SELECT k FROM m")) == [(1,), (3,), (4,), (5,)]


def test_explain_show_pragma(db):
    db.sql("CREATE TABLE t (a INT, b TEXT)")
    db.sql("INSERT INTO t VALUES (1, 'x')")
    for text in ("UPDATE t SET b = 'y' WHERE a = 1", "DELETE FROM t WHERE a > 0", "INSERT INTO t SELECT a + 1, b FROM t", "INSERT INTO t VALUES (1, 'y')"):
        assert "Scan" in db.sql(f"EXPLAIN {text}").first()[0]
    assert rows(db.sql("SELECT * FROM t")) == [(1, "x")]
    assert rows(db.sql("SHOW TABLES")) == [("t",)] and rows(db.sql("SHOW COLUMNS FROM t")) == [("a", "int"), ("b", "string")]
    assert db.sql("PRAGMA synchronous = NORMAL").first()[1] == "NORMAL" and db.sql("PRAGMA synchronous").first()[1] == "NORMAL"
    for bad in ("PRAGMA nonsense", "PRAGMA wal = MAYBE", "SHOW nonsense"):
        with pytest.raises(ValueError):
            db.sql(bad)


def test_upkeep(db, spark):
    db.sql("CREATE TABLE t (a INT PRIMARY KEY)")
    for k in range(4):
        db.sql(f"INSERT INTO t VALUES ({k})")
    with pytest.raises(ConstraintError):
        db.sql("INSERT INTO t VALUES (2)")
    assert len(db.state["tables"]["t"]["files"]) == 4 and str(db.table("t")._jdf.queryExecution().optimizedPlan()).count("Relation") == 1
    assert db.sql("PRAGMA wal_checkpoint").first()[1] == "1" and len(db.state["tables"]["t"]["files"]) == 1
    assert db.vacuum() >= 4 and rows(Engine(spark, db.storage.root).sql("SELECT * FROM t")) == [(0,), (1,), (2,), (3,)]
    assert len(db.manifests.versions()) == 1
