"""Plans that stand for an operator work over whole tables, not over a slice of them."""

import duckdb
import pytest

from tessera.operators import vector
from tessera.plans import catalogue

RUN = catalogue.queries()


def count(sf_dir, sql):
    return duckdb.connect().execute(sql.replace("@", f"{sf_dir}/")).fetchone()[0]


def test_project_expressions(spark, sf_dir):
    assert len(RUN["project_expressions"](spark, sf_dir).collect()) == count(sf_dir, "SELECT count(*) FROM '@lineitem.parquet'")


def test_join_multi_key(spark, sf_dir):
    of_key = "SELECT count(*) AS n FROM '@lineitem.parquet' GROUP BY l_orderkey, l_linenumber"
    assert len(RUN["join_multi_key"](spark, sf_dir).collect()) == count(sf_dir, f"SELECT sum(n * n) FROM ({of_key})")


def test_join_full(spark, sf_dir):
    rows = RUN["join_full"](spark, sf_dir).collect()
    found = [sorted(r[k] for r in rows if r[k] is not None) for k in range(2)]
    want = [sorted(r[0] for r in spark.read.parquet(f"{sf_dir}/{t}.parquet").select(k).collect()) for t, k in (("customer", "c_custkey"), ("supplier", "s_suppkey"))]
    assert found == want
    shapes = {(r.c_custkey is None, r.s_suppkey is None) for r in rows}
    assert shapes == {(False, False), (False, True), (True, False)}


def test_not_in_subquery_null(spark, sf_dir):
    """The plan reads every customer: none is left out by a filter."""
    plan = RUN["not_in_subquery_null"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "(c_custkey" not in plan
    assert len(RUN["not_in_subquery_null"](spark, sf_dir).collect()) == 0  # a null among them


def test_ann_recall_asks_every_query(spark, tmp_path):
    rows = [(i, [float((i * 7919 + k * 104729) % 1009) for k in range(4)]) for i in range(1300)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert [tuple(r) for r in RUN["ann_recall"](spark, str(tmp_path)).collect()] == [(True, 26)]


def test_search_all_equals_search(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    index = vector.InvertedFile.build(rows, n_cells=8)
    queries = rows.where("vec_id % 100 = 0").select("vec_id", "embedding").collect()
    found = {}
    for r in index.search_all(spark.createDataFrame(queries).toDF("query_id", "embedding"), 5, probe=3).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append(r.vec_id)
    assert found == {q.vec_id: [r.vec_id for r in index.search(list(q.embedding), 5, probe=3).collect()] for q in queries}


@pytest.mark.parametrize("name,table", [("sort_multi", "customer"), ("sort_expression", "part"), ("sort_nulls", "nation"), ("sort_nulls_first", "nation"), ("scan_reverse", "nation")])
def test_sorts_are_whole_and_in_order(spark, sf_dir, name, table):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    want = con.execute(catalogue.oracle_sql()[name]).fetchall()
    assert [tuple(r) for r in RUN[name](spark, sf_dir).collect()] == want
    assert len(want) == spark.read.parquet(f"{sf_dir}/{table}.parquet").count()


@pytest.mark.parametrize("metric", ["l2", "cosine", "dot"])
def test_batch_search_equals_single_ones(spark, sf_dir, metric, monkeypatch):
    """In several blocks, with ties, a null vector and one of another dimension."""
    monkeypatch.setattr(vector, "QUERY_BLOCK", 3)
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").where("vec_id < 200")
    rows = rows.unionByName(rows.where("vec_id < 9").selectExpr("vec_id + 1000 AS vec_id", "embedding")).unionByName(spark.createDataFrame([(5000, None), (5001, [1.0, 2.0]), (5002, [0.0] * 64)], rows.schema))
    queries = rows.where("vec_id < 8 OR vec_id >= 5000")
    found = {}
    for r in vector.nearest_all(rows, queries.toDF("query_id", "embedding"), 4, metric=metric).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, round(r.distance, 9)))
    want = {q.vec_id: [(r.vec_id, round(r.distance, 9)) for r in vector.nearest(rows, list(q.embedding), 4, metric=metric).collect()] for q in queries.where("embedding IS NOT NULL").collect()}
    assert found == {q: v for q, v in want.items() if v}


def test_index_upkeep(spark, sf_dir, tmp_path):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    index = vector.InvertedFile.build(rows.where("vec_id % 2 = 0"), str(tmp_path), n_cells=8)
    index.insert(rows.where("vec_id % 2 = 1"))
    index.delete(rows.where("vec_id < 10").select("vec_id"))
    index.insert(rows.where("vec_id = 4"))
    query = list(rows.where("vec_id = 3").first().embedding)
    want = [r.vec_id for r in vector.nearest(rows, query, 6, where="vec_id >= 10 OR vec_id = 4").collect()]
    for _ in range(2):
        assert [r.vec_id for r in index.search(query, 6, probe=8).collect()] == want
        assert [r.vec_id for r in index.search_codes(query, 6, probe=8, more=8).collect()] == want
        index.vacuum()
    assert index.rows().count() == rows.count() - 9 and "cell" in index.search(query, 3, probe=2)._jdf.queryExecution().toString()
    assert [r.vec_id for r in index.search(query, 3, probe=8, where="label = 1").collect()] == [r.vec_id for r in vector.nearest(rows, query, 3, where="label = 1 AND (vec_id >= 10 OR vec_id = 4)").collect()]
