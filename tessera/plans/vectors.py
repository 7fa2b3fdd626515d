"""JSON, array and vector operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.folders import shared
from tessera.operators import vector
from tessera.plans.catalogue import Plan, dialect_plan
from tessera.sources import table

E = "events"
#: Cells of 64 that a query looks at: the vectors at hand have hardly any clusters.
PROBE = 40


def _query(spark, sf_dir, vec_id=0):
    return list(table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).first()["embedding"])


def knn(metric):
    def run(spark, sf_dir):
        found = vector.nearest(table(spark, sf_dir, "embeddings"), _query(spark, sf_dir), 10, metric=metric)
        return found.select("vec_id", F.round("distance", 4).alias("distance"))

    return run


def knn_filtered(spark, sf_dir):
    found = vector.nearest(table(spark, sf_dir, "embeddings"), _query(spark, sf_dir), 10, where="label = 1")
    return found.select("vec_id", F.round("distance", 4).alias("distance"))


def knn_batch(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    found = vector.nearest_all(rows, _queries(rows), 5)
    return found.select("query_id", "vec_id", F.round("distance", 4).alias("distance"), F.col("rank").cast("int").alias("rank"))


def _queries(rows):
    return rows.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), "embedding")


def _index(spark, rows):
    return vector.InvertedFile.build(rows, shared(spark, "ann"), n_cells=64)


def ann_recall(spark, sf_dir):
    """Recall at 10 of the inverted file against exact search, over the queries whose id is divisible by 50."""
    rows = table(spark, sf_dir, "embeddings")
    queries = _queries(rows)
    exact = vector.nearest_all(rows, queries, 10).select("query_id", "vec_id")
    found = _index(spark, rows).search_all(queries, 10, probe=PROBE).select("query_id", "vec_id", F.lit(1).alias("hit"))
    recall = exact.join(found, ["query_id", "vec_id"], "left").agg((F.count("hit") / F.count("*") >= 0.9).alias("enough"))
    return recall.crossJoin(queries.agg(F.count("*").cast("int").alias("queries")))


def ann_all_cells(spark, sf_dir):
    """The inverted file over all its cells, after deletions, a filter and a vacuum, is exact."""
    rows = table(spark, sf_dir, "embeddings")
    index = _index(spark, rows.where("vec_id % 2 = 0"))
    index.insert(rows.where("vec_id % 2 = 1"))
    index.delete(rows.where("vec_id % 3 = 0").select("vec_id"))
    index.vacuum()
    found = index.search_all(_queries(rows), 5, probe=64, where="label <> 1")
    return found.select("query_id", "vec_id", F.round("distance", 4).alias("distance"), F.col("rank").cast("int").alias("rank"))


def sq8_search(spark, sf_dir):
    """Search by 8-bit codes over all cells, ranked anew by the vectors."""
    rows = table(spark, sf_dir, "embeddings")
    found = _index(spark, rows).search_codes(_query(spark, sf_dir), 10, probe=64, more=8)
    return found.select("vec_id", F.round("distance", 4).alias("distance"))


def sq8_error(spark, sf_dir):
    """The largest error of scalar quantisation, in steps of its vector: at most one half."""
    coded = vector.quantised(table(spark, sf_dir, "embeddings")).withColumn("back", vector.restored())
    error = F.aggregate(F.zip_with(vector.doubles("embedding"), "back", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, x: F.greatest(s, x))
    return coded.select((error / F.col("step")).alias("e")).agg((F.max("e") <= 0.5001).alias("close"), F.count("*").alias("n"))


_L2 = "sqrt(list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE))))"
_DOT = "list_sum(list_transform(list_zip({0}.embedding, {1}.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))"
_COSINE = f"(1 - {_DOT.format('e', 'q')} / (sqrt({_DOT.format('e', 'e')}) * sqrt({_DOT.format('q', 'q')})))"


def _knn_sql(value, where=""):
    return f"SELECT vec_id, round(d, 4) AS distance FROM (SELECT e.vec_id, {value} AS d FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q {where}) ORDER BY d, vec_id LIMIT 10"


PLANS = [
    dialect_plan("json_get", "SELECT event_id, props ->> 'k' AS t, props -> 'k' AS j, props #>> '{k}' AS p, props -> '$.k' AS d, props ->> 'none' AS z FROM events",
                 "SELECT event_id, props ->> '$.k' AS t, props ->> '$.k' AS j, props ->> '$.k' AS p, props ->> '$.k' AS d, NULL::VARCHAR AS z FROM events", E),
    dialect_plan("json_path", "SELECT event_id, props #> '{k}' AS j, CONCAT('{\"a\": [', event_id, ', ', props, ']}') #> '{a,1}' AS o FROM events WHERE event_id < 0 OR props IS NOT NULL",
                 "SELECT event_id, props ->> '$.k' AS j, replace(props::VARCHAR, ' ', '') AS o FROM events", E),
    dialect_plan("json_contains", "SELECT event_id FROM events WHERE props @> '{\"k\": 7}'", "SELECT event_id FROM events WHERE (props ->> '$.k')::INT = 7", E),
    dialect_plan("json_contained", "SELECT event_id FROM events WHERE props <@ '{\"k\": 9, \"x\": 1}'", "SELECT event_id FROM events WHERE (props ->> '$.k')::INT = 9", E),
    dialect_plan("array_overlap", "SELECT n_nationkey, CONCAT('[', n_regionkey, ',9]') && '[1,2]' AS o FROM nation", "SELECT n_nationkey, n_regionkey IN (1, 2) AS o FROM nation", "nation"),
    dialect_plan("array_subscript", "SELECT n_nationkey, CONCAT('[', n_regionkey, ',', n_nationkey, ']')[1] AS s, '[1]'[5] AS z FROM nation", "SELECT n_nationkey, n_nationkey::VARCHAR AS s, NULL::VARCHAR AS z FROM nation", "nation"),
    dialect_plan("vector_subscript", "SELECT vec_id, embedding[0] AS a, embedding[999] AS z FROM embeddings", "SELECT vec_id, embedding[1] AS a, NULL::FLOAT AS z FROM embeddings", "embeddings"),
    dialect_plan("vector_distances", "SELECT a.vec_id, round(a.embedding <-> b.embedding, 4) AS l2, round(a.embedding <=> b.embedding, 4) AS cos, round(a.embedding <#> b.embedding, 3) AS dot FROM embeddings a JOIN embeddings b ON a.vec_id + 1 = b.vec_id",
                 f"SELECT e.vec_id, round({_L2}, 4) AS l2, round({_COSINE}, 4) AS cos, round({_DOT.format('e', 'q')}, 3) AS dot FROM embeddings e JOIN embeddings q ON e.vec_id + 1 = q.vec_id", "embeddings"),
    dialect_plan("vector_null", "SELECT '[1,2]' <-> '[1,2,3]' AS a, '[0,0]' <=> '[1,1]' AS b, '[3,4]' <-> '[0,0]' AS c FROM region", "SELECT NULL::DOUBLE AS a, NULL::DOUBLE AS b, 5.0::DOUBLE AS c FROM region", "region"),
    Plan("knn_l2", knn("l2"), _knn_sql(_L2)),
    Plan("knn_cosine", knn("cosine"), _knn_sql(_COSINE)),
    Plan("knn_dot", knn("dot"), _knn_sql(f"-{_DOT.format('e', 'q')}")),
    Plan("knn_filtered", knn_filtered, _knn_sql(_L2, "WHERE e.label = 1")),
    Plan("knn_batch", knn_batch, f"""SELECT query_id, vec_id, round(d, 4) AS distance, CAST(rank AS INT) AS rank FROM (SELECT q.vec_id AS query_id, e.vec_id, {_L2} AS d,
        row_number() OVER (PARTITION BY q.vec_id ORDER BY {_L2}, e.vec_id) AS rank FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q) WHERE rank <= 5"""),
    Plan("ann_recall", ann_recall, "SELECT true AS enough, count(*)::INT AS queries FROM embeddings WHERE vec_id % 50 = 0"),
    Plan("ann_all_cells", ann_all_cells, f"""SELECT query_id, vec_id, round(d, 4) AS distance, CAST(rank AS INT) AS rank FROM (SELECT q.vec_id AS query_id, e.vec_id, {_L2} AS d,
        row_number() OVER (PARTITION BY q.vec_id ORDER BY {_L2}, e.vec_id) AS rank FROM (SELECT * FROM embeddings WHERE vec_id % 3 <> 0 AND label <> 1) e, (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q) WHERE rank <= 5"""),
    Plan("sq8_search", sq8_search, _knn_sql(_L2)),
    Plan("sq8_error", sq8_error, "SELECT true AS close, count(*) AS n FROM embeddings"),
]
