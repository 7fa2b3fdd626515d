"""Statements that change tables, each on a copy in a database of its own, with the state they leave."""

from __future__ import annotations

from tessera.folders import shared
from tessera.plans.catalogue import Plan
from tessera.sources import table


def _engine(spark, sf_dir, *tables):
    from tessera.engine import Engine

    return Engine(spark, shared(spark, "db")).register_dir(sf_dir, tables)


def _plan(name, oracle, tables, *statements):
    """Runs all statements; the last one's rows are the result."""

    def run(spark, sf_dir):
        db = _engine(spark, sf_dir, *tables.split())
        for text in statements[:-1]:
            db.sql(text)
        return db.sql(statements[-1])

    return Plan(name, run, oracle)


NATIONS = ("CREATE TABLE n (k INT PRIMARY KEY, name VARCHAR(30) NOT NULL, r INT DEFAULT 9)", "INSERT INTO n SELECT n_nationkey, n_name, n_regionkey FROM nation")


def snapshot_isolation(spark, sf_dir):
    """A reader that began before a commit goes on seeing the rows of its time."""
    from tessera.engine import Engine

    db = _engine(spark, sf_dir, "nation")
    for text in NATIONS:
        db.sql(text)
    reader = Engine(spark, db.storage.root)
    reader.sql("BEGIN")
    db.sql("DELETE FROM n WHERE r = 1")
    old, new = (e.sql("SELECT count(*) AS c FROM n") for e in (reader, db))
    return old.toDF("before").crossJoin(new.toDF("after"))  # a row each


def refused(spark, sf_dir):
    """Changes that a constraint forbids, and what is left after each: all rows."""
    from tessera.engine import TransactionError
    from tessera.store.tables import ConstraintError

    db = _engine(spark, sf_dir, "nation", "region")
    for text in (
        "CREATE TABLE r (id INT PRIMARY KEY, name TEXT NOT NULL)", "INSERT INTO r SELECT * FROM region",
        "CREATE TABLE n (k INT PRIMARY KEY, name VARCHAR(30) NOT NULL UNIQUE, r INT CHECK (r >= 0) REFERENCES r(id))", "INSERT INTO n SELECT n_nationkey, n_name, n_regionkey FROM nation",
        "CREATE UNIQUE INDEX i ON n (name, r) WHERE r > 1",
    ):
        db.sql(text)
    out = []
    for what, text in REFUSED.items():
        if what == "read only":
            db.sql("BEGIN READ ONLY")
        try:
            db.sql(text)
            out.append((what, False))
        except (ConstraintError, TransactionError):
            out.append((what, True))
    db.sql("COMMIT")
    left = db.sql("SELECT count(*) AS n_rows, sum(k + r) AS s FROM n")
    return spark.createDataFrame(out, "what string, refused boolean").crossJoin(left)  # one row


#: By constraint, a statement against it.
REFUSED = {
    "not null": "INSERT INTO n VALUES (100, NULL, 1)", "primary key": "INSERT INTO n VALUES (3, 'x', 1)", "unique": "INSERT INTO n SELECT 100, name, r FROM n WHERE k = 5",
    "check": "UPDATE n SET r = -1 WHERE k = 2", "length": "INSERT INTO n VALUES (100, 'a name that has far more than thirty characters', 1)", "foreign key": "INSERT INTO n VALUES (100, 'x', 77)",
    "restrict": "DELETE FROM r WHERE id = 2", "unique index": "CREATE UNIQUE INDEX j ON n (r)", "read only": "DELETE FROM n",
}


def prepared(spark, sf_dir):
    """One statement with several values, and a change with bound ones."""
    db = _engine(spark, sf_dir, "nation")
    for text in NATIONS:
        db.sql(text)
    add = db.prepare("INSERT INTO n VALUES (?, ?, ?)")
    add(100, "it's", 1)
    db.sql("UPDATE n SET name = :name WHERE k = :k", {"name": "named", "k": 7})
    by_region = db.prepare("SELECT k, name FROM n WHERE r = $1 AND k > $2")
    return by_region(1, 2).unionAll(by_region(3, 0))


def index_changes(spark, sf_dir):
    db = _engine(spark, sf_dir, "nation")
    for text in (*NATIONS, "CREATE INDEX a ON n (r)", "CREATE UNIQUE INDEX b ON n (name)", "DROP INDEX a", "CREATE INDEX v ON n USING HNSW (k)", "INSERT INTO n VALUES (100, 'x', 2)"):
        db.sql(text)
    return db.sql("SHOW INDEXES").toDF("index_name").crossJoin(db.sql("SELECT count(*) AS n_rows FROM n WHERE r = 2"))  # one row


def bulk_load(spark, sf_dir):
    db = _engine(spark, sf_dir)
    db.sql("CREATE TABLE li (k BIGINT, line INT, qty DOUBLE CHECK (qty > 0))")
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS k", "l_linenumber AS line", "l_quantity AS qty")
    db.insert("li", rows)
    return db.sql("SELECT count(*) AS n, round(sum(qty), 2) AS q FROM li")


PLANS = [
    _plan("dml_insert_values", "SELECT * FROM (VALUES (100, 'new', 9), (101, 'two', 4)) v(k, name, r)", "nation", *NATIONS, "INSERT INTO n (k, name) VALUES (100, 'new')", "INSERT INTO n VALUES (101, 'two', 4)", "SELECT * FROM n WHERE k >= 100"),
    _plan("dml_insert_select", "SELECT n_nationkey AS k, n_name AS name, n_regionkey AS r FROM nation", "nation", *NATIONS, "SELECT * FROM n"),
    _plan("dml_insert_default_values", "SELECT 1 AS id, 5 AS v", "nation", "CREATE TABLE d (id INT AUTO_INCREMENT PRIMARY KEY, v INT DEFAULT 5)", "INSERT INTO d DEFAULT VALUES", "SELECT * FROM d"),
    _plan("dml_conflict_nothing", "SELECT 25 + 1 AS n, max(n_name) FILTER (WHERE n_nationkey = 3) AS kept FROM nation", "nation", *NATIONS, "INSERT INTO n VALUES (3, 'x', 1), (200, 'y', 1) ON CONFLICT DO NOTHING", "SELECT CAST(count(*) AS INT) AS n, max(CASE WHEN k = 3 THEN name END) AS kept FROM n"),
    _plan("dml_conflict_update", "SELECT n_nationkey AS k, CASE WHEN n_nationkey = 3 THEN 'up' ELSE n_name END AS name, CASE WHEN n_nationkey = 3 THEN n_regionkey + 10 ELSE n_regionkey END AS r FROM nation", "nation", *NATIONS, "INSERT INTO n VALUES (3, 'z', 10) ON CONFLICT (k) DO UPDATE SET name = 'up', r = r + excluded.r", "SELECT * FROM n"),
    _plan("dml_returning", "SELECT n_nationkey AS k, n_regionkey + 1 AS r1 FROM nation WHERE n_regionkey = 2", "nation", *NATIONS, "UPDATE n SET r = r + 1 WHERE r = 2 RETURNING k, r AS r1"),
    _plan("dml_update_expression", "SELECT n_nationkey AS k, CASE WHEN n_nationkey > 10 THEN lower(n_name) ELSE n_name END AS name, CASE WHEN n_nationkey > 10 THEN n_regionkey * 2 + n_nationkey ELSE n_regionkey END AS r FROM nation", "nation", *NATIONS, "UPDATE n SET name = LOWER(name), r = r * 2 + k WHERE k > 10", "SELECT * FROM n"),
    _plan("dml_update_subquery", "SELECT n_nationkey AS k, CASE WHEN n_regionkey = 0 THEN 4 ELSE n_regionkey END AS r FROM nation", "nation region", *NATIONS, "UPDATE n SET r = (SELECT max(r_regionkey) FROM region) WHERE r = 0", "SELECT k, r FROM n"),
    _plan("dml_update_from", "SELECT n_nationkey AS k, CASE WHEN r_name LIKE 'A%' THEN r_name ELSE n_name END AS name FROM nation JOIN region ON n_regionkey = r_regionkey", "nation region", *NATIONS, "UPDATE n SET name = region.r_name FROM region WHERE n.r = region.r_regionkey AND region.r_name LIKE 'A%'", "SELECT k, name FROM n"),
    _plan("dml_delete", "SELECT n_nationkey AS k FROM nation WHERE NOT (n_regionkey = 1 OR n_nationkey < 4)", "nation", *NATIONS, "DELETE FROM n WHERE r = 1 OR k < 4", "SELECT k FROM n"),
    _plan("dml_delete_using", "SELECT n_nationkey AS k FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name NOT LIKE 'A%'", "nation region", *NATIONS, "DELETE FROM n USING region WHERE n.r = region.r_regionkey AND region.r_name LIKE 'A%'", "SELECT k FROM n"),
    _plan("dml_truncate", "SELECT 0::BIGINT AS n", "nation", *NATIONS, "TRUNCATE TABLE n", "SELECT count(*) AS n FROM n"),
    _plan("ddl_alter", "SELECT n_nationkey AS k, n_name AS label, 1 AS extra FROM nation", "nation", *NATIONS, "ALTER TABLE n DROP COLUMN r", "ALTER TABLE n RENAME COLUMN name TO label", "ALTER TABLE n ADD COLUMN extra INT DEFAULT 1", "ALTER TABLE n RENAME TO m", "SELECT * FROM m"),
    _plan("ddl_view_schema", "SELECT n_name AS name FROM nation WHERE n_regionkey = 3", "nation", *NATIONS, "CREATE SCHEMA s", "CREATE VIEW v AS SELECT name FROM n WHERE r = 3", "SELECT * FROM v"),
    _plan("fk_cascade", "SELECT n_nationkey AS k FROM nation WHERE n_regionkey <> 1", "nation region", "CREATE TABLE r (id INT PRIMARY KEY, name TEXT)", "CREATE TABLE n (k INT PRIMARY KEY, r INT REFERENCES r(id) ON DELETE CASCADE)", "INSERT INTO r SELECT * FROM region", "INSERT INTO n SELECT n_nationkey, n_regionkey FROM nation", "DELETE FROM r WHERE id = 1", "SELECT k FROM n"),
    _plan("fk_set_null_update", "SELECT n_nationkey AS k, CASE n_regionkey WHEN 1 THEN NULL WHEN 2 THEN 20 ELSE n_regionkey END AS r FROM nation", "nation region", "CREATE TABLE r (id INT PRIMARY KEY, name TEXT)", "CREATE TABLE n (k INT PRIMARY KEY, r INT REFERENCES r(id) ON DELETE SET NULL ON UPDATE CASCADE)", "INSERT INTO r SELECT * FROM region", "INSERT INTO n SELECT n_nationkey, n_regionkey FROM nation", "DELETE FROM r WHERE id = 1", "UPDATE r SET id = 20 WHERE id = 2", "SELECT k, r FROM n"),
    _plan("txn_commit", "SELECT n_nationkey AS k FROM nation WHERE n_regionkey <> 2", "nation", *NATIONS, "BEGIN", "DELETE FROM n WHERE r = 2", "COMMIT", "SELECT k FROM n"),
    _plan("txn_rollback", "SELECT n_nationkey AS k FROM nation", "nation", *NATIONS, "BEGIN", "DELETE FROM n", "ROLLBACK", "SELECT k FROM n"),
    _plan("txn_savepoint", "SELECT n_nationkey AS k FROM nation WHERE n_regionkey <> 2", "nation", *NATIONS, "BEGIN", "DELETE FROM n WHERE r = 2", "SAVEPOINT a", "DELETE FROM n WHERE r = 3", "ROLLBACK TO a", "RELEASE a", "COMMIT", "SELECT k FROM n"),
    _plan("dml_upsert_returning", "SELECT n_nationkey AS k, n_regionkey + 10 AS r FROM nation WHERE n_nationkey IN (3, 4) UNION ALL SELECT 200, 30", "nation", *NATIONS, "INSERT INTO n VALUES (3, 'a', 4), (200, 'b', 10), (4, 'c', 10), (200, 'd', 20), (3, 'e', 6) ON CONFLICT (k) DO UPDATE SET r = r + excluded.r RETURNING k, r"),
    _plan("dml_merge", "SELECT n_nationkey AS k, CASE WHEN n_regionkey = 2 THEN 'ASIA!' ELSE n_name END AS name, n_regionkey AS r FROM nation WHERE n_regionkey <> 1 UNION ALL SELECT 101, 'new', 9", "nation region", *NATIONS,
          "MERGE INTO n USING (SELECT r_regionkey AS id, UPPER(r_name) AS label FROM region UNION ALL SELECT 77, 'new') s ON n.r = s.id WHEN MATCHED AND s.id = 1 THEN DELETE WHEN MATCHED AND s.id = 2 THEN UPDATE SET name = s.label || '!' WHEN MATCHED THEN DO NOTHING WHEN NOT MATCHED THEN INSERT (k, name) VALUES (101, s.label)", "SELECT * FROM n"),
    Plan("constraints_refused", refused, "SELECT what, true AS refused, n_rows, s FROM (VALUES " + ", ".join(f"('{w}')" for w in REFUSED) + ") v(what), (SELECT count(*) AS n_rows, CAST(sum(n_nationkey + n_regionkey) AS BIGINT) AS s FROM nation)"),
    Plan("prepared_statements", prepared, "SELECT n_nationkey AS k, CASE n_nationkey WHEN 7 THEN 'named' ELSE n_name END AS name FROM nation WHERE n_regionkey = 1 AND n_nationkey > 2 OR n_regionkey = 3 AND n_nationkey > 0 UNION ALL SELECT 100, 'it''s'"),
    Plan("ddl_index", index_changes, "SELECT i AS index_name, n AS n_rows FROM (VALUES ('b'), ('v')) v(i), (SELECT count(*) + 1 AS n FROM nation WHERE n_regionkey = 2)"),
    Plan("txn_snapshot", snapshot_isolation, 'SELECT count(*) AS before, count(*) FILTER (WHERE n_regionkey <> 1) AS "after" FROM nation'),
    Plan("bulk_load", bulk_load, "SELECT count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem"),
]
