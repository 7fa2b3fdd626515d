"""Scans, filters, joins, aggregates, windows, sorts, set operations and subqueries over the star schema."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.plans.catalogue import Plan, dialect_plan
from tessera.sources import table


def revenue_per_nation(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount")
    orders = (
        table(spark, sf_dir, "orders")
        .where(F.col("o_orderdate") >= F.lit("1994-01-01").cast("timestamp"))
        .select("o_orderkey", "o_custkey")
    )
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    revenue = F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return (
        line.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy("n_name")
        .agg(F.round(revenue, 2).alias("revenue"), F.count("*").alias("n_lines"))
        .where(F.col("n_lines") > 10)
        .orderBy(F.desc("revenue"), "n_name")
        .limit(10)
    )


def pricing_summary(spark, sf_dir):
    price, cut, tax = F.col("l_extendedprice"), 1 - F.col("l_discount"), 1 + F.col("l_tax")
    return (
        table(spark, sf_dir, "lineitem")
        .where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
            F.round(F.sum(price), 2).alias("sum_base"),
            F.round(F.sum(price * cut), 2).alias("sum_disc"),
            F.round(F.sum(price * cut * tax), 2).alias("sum_charge"),
            F.round(F.avg("l_quantity"), 6).alias("avg_qty"),
            F.count("*").alias("n"),
        )
    )


def top_customers_per_nation(spark, sf_dir):
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal", F.row_number().over(w).alias("rn")).where("rn <= 3")


def same(name: str, sql: str, tables: str, oracle: str | None = None) -> Plan:
    """A query whose text is the same for the engine and the oracle, but where ``oracle`` says otherwise."""
    return dialect_plan(name, sql, oracle or sql, tables)


C, O, L, N, R, S, P, E = "customer", "orders", "lineitem", "nation", "region", "supplier", "part", "events"

PLANS = [
    Plan(
        "revenue_per_nation",
        revenue_per_nation,
        """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue,
                  count(*) AS n_lines
           FROM lineitem JOIN orders ON l_orderkey = o_orderkey
                JOIN customer ON o_custkey = c_custkey
                JOIN nation ON c_nationkey = n_nationkey
           WHERE o_orderdate >= TIMESTAMP '1994-01-01'
           GROUP BY n_name HAVING count(*) > 10
           ORDER BY revenue DESC, n_name LIMIT 10""",
    ),
    Plan(
        "pricing_summary",
        pricing_summary,
        """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base,
                  round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
                  round(avg(l_quantity), 6) AS avg_qty, count(*) AS n
           FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""",
    ),
    Plan(
        "top_customers_per_nation",
        top_customers_per_nation,
        """SELECT c_custkey, c_nationkey, c_acctbal, CAST(rn AS INT) AS rn
           FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer) WHERE rn <= 3""",
    ),
    # scans and sources
    same("scan_table", "SELECT * FROM region", R),
    same("scan_reverse", "SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey DESC", N),
    same("scan_range", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 100 AND 900", O),
    same("scan_prefix", "SELECT p_partkey, p_type FROM part WHERE p_type >= 'P' AND p_type < 'Q'", P),
    same("scan_index_residual", "SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey < 500 AND c_mktsegment = 'BUILDING' AND c_acctbal > 0", C),
    same("dual", "SELECT 1 AS one, 'x' AS x, NULL IS NULL AS n", R),
    same("values_rows", "SELECT * FROM (VALUES (1, 'a'), (2, 'b'), (2, 'b')) AS v(k, s)", R),
    same("count_star", "SELECT count(*) AS n FROM lineitem", L),
    # projection and predicates
    same("project_expressions", "SELECT l_orderkey, l_linenumber, l_quantity * l_extendedprice AS gross, l_tax + l_discount - 1 AS rest FROM lineitem", L),
    same("project_star", "SELECT n.*, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey", f"{N} {R}"),
    same("filter_logic", "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' OR o_totalprice > 100000) AND NOT o_orderpriority = '1-URGENT'", O),
    same("compare_all", "SELECT p_partkey, p_size = 5 AS eq, p_size <> 5 AS ne, p_size < 5 AS lt, p_size <= 5 AS le, p_size > 5 AS gt, p_size >= 5 AS ge FROM part", P),
    same("between_not", "SELECT p_partkey FROM part WHERE p_size NOT BETWEEN 10 AND 40 AND p_retailprice BETWEEN 900 AND 1500", P),
    same("in_list", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderkey NOT IN (1, 2, 3)", O),
    same("in_list_null", "SELECT n_nationkey, n_nationkey NOT IN (1, NULL) AS maybe, NULLIF(n_regionkey, 1) IN (0, 2) AS hit FROM nation", N),
    same("in_subquery", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)", f"{C} {O}"),
    same("not_in_subquery", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)", f"{C} {O}"),
    same("not_in_subquery_null", "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT NULLIF(c_nationkey, 3) FROM customer)", f"{C} {N}"),
    same("exists_correlated", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 150000) AND c.c_acctbal > 0", f"{C} {O}"),
    same("not_exists", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)", f"{C} {O}"),
    same("is_null", "SELECT n_nationkey, NULLIF(n_regionkey, 2) IS NULL AS a, NULLIF(n_regionkey, 2) IS NOT NULL AS b FROM nation", N),
    same("is_distinct", "SELECT n_nationkey, NULLIF(n_regionkey, 2) IS DISTINCT FROM NULL AS a, NULLIF(n_regionkey, 2) IS NOT DISTINCT FROM 1 AS b FROM nation", N),
    same("three_valued_logic", "SELECT n_nationkey, (NULLIF(n_regionkey, 2) = 1) AND (n_nationkey > 3) AS a, (NULLIF(n_regionkey, 2) = 1) OR (n_nationkey > 3) AS o, NOT (NULLIF(n_regionkey, 2) = 1) AS n FROM nation", N),
    same("like_patterns", "SELECT p_partkey, p_type LIKE '%A%' AS a, p_name NOT LIKE '_o%' AS b, p_type ILIKE '%steel%' AS c FROM part", P),
    same("case_forms", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'mid' ELSE 'big' END AS s, CASE p_size WHEN 1 THEN 'one' WHEN 2 THEN 'two' END AS w FROM part", P),
    same(
        "cast_forms", "SELECT CAST('12' AS INT) AS a, CAST('x1' AS INT) AS b, '3.5'::DOUBLE AS c, CAST(7 AS TEXT) AS d, CAST('2020-02-03' AS DATE) AS e, CAST('no' AS DATE) AS f, CAST(2.9 AS BIGINT) IN (2, 3) AS g", R,
        "SELECT 12 AS a, TRY_CAST('x1' AS INT) AS b, 3.5::DOUBLE AS c, '7' AS d, DATE '2020-02-03' AS e, NULL::DATE AS f, true AS g",
    ),
    same("row_and_array", "SELECT n_nationkey, ARRAY[n_regionkey, n_nationkey, 7] AS a, (n_regionkey, n_nationkey) = (1, 2) AS r, ARRAY[n_regionkey, n_nationkey, 7][1:2] AS s, ARRAY[n_regionkey, n_nationkey, 7][:0] AS f FROM nation", N,
         "SELECT n_nationkey, [n_regionkey, n_nationkey, 7] AS a, n_regionkey = 1 AND n_nationkey = 2 AS r, [n_nationkey, 7] AS s, [n_regionkey] AS f FROM nation"),
    same("literals", "SELECT 0xff AS h, 0b101 AS b, 1.5 AS f, 'it''s' AS s, TRUE AS t, NULL IS NULL AS n", R, "SELECT 255 AS h, 5 AS b, 1.5::DOUBLE AS f, 'it''s' AS s, TRUE AS t, TRUE AS n"),
    same("distinct_rows", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders", O),
    same("distinct_limit", "SELECT DISTINCT p_size FROM part ORDER BY p_size LIMIT 5 OFFSET 2", P),
    # arithmetic and bits
    same(
        "arithmetic", "SELECT p_partkey, p_size + 3 AS a, p_size - 7 AS s, p_size * 1000000000 AS m, p_size / 7 AS d, p_size / 0 AS z, p_retailprice / 7 AS r, p_size % 7 AS k, -p_size % 7 AS neg, p_size % 0 AS kz FROM part", P,
        "SELECT p_partkey, p_size::BIGINT + 3 AS a, p_size::BIGINT - 7 AS s, p_size::BIGINT * 1000000000 AS m, p_size::BIGINT // 7 AS d, NULL::BIGINT AS z, p_retailprice / 7 AS r, p_size % 7 AS k, -p_size % 7 AS neg, NULL::INT AS kz FROM part",
    ),
    same(
        "power_and_bits", "SELECT p_partkey, 2 ^ 3 ^ 2 AS p, p_size ^ 2 AS sq, p_size & 6 AS a, p_size | 9 AS o, p_size << 3 AS l, p_size >> 1 AS r, 1 << 64 AS w, ~p_size AS n, -(-p_size) AS m FROM part", P,
        "SELECT p_partkey, 512::BIGINT AS p, (p_size::BIGINT * p_size) AS sq, p_size::BIGINT & 6 AS a, p_size::BIGINT | 9 AS o, p_size::BIGINT << 3 AS l, p_size::BIGINT >> 1 AS r, NULL::BIGINT AS w, ~p_size AS n, p_size AS m FROM part",
    ),
    # joins
    same("join_inner", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal < 0", f"{O} {C}"),
    same("join_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 150000", f"{O} {C}"),
    same("join_right", "SELECT c_custkey, o_orderkey FROM orders RIGHT JOIN customer ON c_custkey = o_custkey", f"{O} {C}"),
    same("join_full", "SELECT c_custkey, s_suppkey FROM customer FULL JOIN supplier ON c_custkey + 5 = s_suppkey", f"{C} {S}"),
    same("join_cross", "SELECT n_name, r_name FROM nation CROSS JOIN region", f"{N} {R}"),
    same("join_theta", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey < b.n_regionkey AND a.n_name > b.n_name", N),
    same("join_comma", "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey AND r_name LIKE 'A%'", f"{N} {R}"),
    same("join_self", "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey", S),
    same("join_multi_key", "SELECT a.l_orderkey, a.l_linenumber, b.l_quantity FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber", L),
    same("join_five_way", "SELECT r_name, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name", f"{L} {O} {C} {N} {R}"),
    same("join_in_derived", "SELECT t.n_name, count(*) AS n FROM (SELECT n_name, c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey) t JOIN orders ON o_custkey = t.c_custkey GROUP BY t.n_name", f"{C} {N} {O}"),
    same("join_derived", "SELECT c_name, t.n FROM customer JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) t ON t.o_custkey = c_custkey WHERE t.n > 12", f"{C} {O}"),
    same("join_null_keys", "SELECT a.n_nationkey AS a, b.r_name FROM (SELECT n_nationkey, NULLIF(n_regionkey, 1) AS k FROM nation) a LEFT JOIN (SELECT NULLIF(r_regionkey, 1) AS k, r_name FROM region) b ON a.k = b.k", f"{N} {R}"),
    same("join_mixed_types", "SELECT n_nationkey, r_name FROM nation JOIN region ON n_regionkey = CAST(r_regionkey AS DOUBLE)", f"{N} {R}"),
    same("join_using", "SELECT k, n_name, r_name FROM (SELECT n_regionkey AS k, n_name FROM nation) a JOIN (SELECT r_regionkey AS k, r_name FROM region) b USING (k)", f"{N} {R}"),
    same("join_natural", "SELECT k, n_name, r_name FROM (SELECT n_regionkey AS k, n_name FROM nation) a NATURAL JOIN (SELECT r_regionkey AS k, r_name FROM region) b", f"{N} {R}"),
    same("join_lateral", "SELECT n_nationkey, t.best FROM nation, LATERAL (SELECT max(s_acctbal) AS best FROM supplier WHERE s_nationkey = n_nationkey) t", f"{N} {S}"),
    same("join_residual", "SELECT c_custkey, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey AND o_totalprice > c_acctbal * 20", f"{O} {C}"),
    # aggregation
    same("agg_global", "SELECT count(*) AS n, sum(p_size) AS s, round(avg(p_size), 6) AS a, min(p_name) AS lo, max(p_retailprice) AS hi FROM part", P, "SELECT count(*) AS n, CAST(sum(p_size) AS BIGINT) AS s, round(avg(p_size), 6) AS a, min(p_name) AS lo, max(p_retailprice) AS hi FROM part"),
    same("agg_empty", "SELECT count(*) AS n, count(p_size) AS c, sum(p_size) AS s, avg(p_size) AS a, min(p_name) AS m FROM part WHERE p_size < 0", P, "SELECT count(*) AS n, count(p_size) AS c, CAST(sum(p_size) AS BIGINT) AS s, avg(p_size) AS a, min(p_name) AS m FROM part WHERE p_size < 0"),
    same("agg_nulls", "SELECT count(NULLIF(p_size, 1)) AS c, count(*) AS n, sum(NULLIF(p_size, 1)) AS s, count(DISTINCT NULLIF(p_size, 1)) AS d FROM part", P, "SELECT count(NULLIF(p_size, 1)) AS c, count(*) AS n, CAST(sum(NULLIF(p_size, 1)) AS BIGINT) AS s, count(DISTINCT NULLIF(p_size, 1)) AS d FROM part"),
    same("agg_group", "SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS s, min(c_name) AS lo, max(c_name) AS hi FROM customer GROUP BY c_mktsegment", C),
    same("agg_group_expression", "SELECT o_orderkey % 10 AS d, YEAR(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY o_orderkey % 10, YEAR(o_orderdate)", O, "SELECT o_orderkey % 10 AS d, CAST(year(o_orderdate) AS INT) AS y, count(*) AS n FROM orders GROUP BY ALL"),
    same("agg_having", "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS t FROM orders GROUP BY o_custkey HAVING count(*) > 10 AND avg(o_totalprice) > 50000", O),
    same("agg_having_alias", "SELECT p_size * 2 AS w FROM part HAVING w > 90", P, "SELECT CAST(p_size AS BIGINT) * 2 AS w FROM part WHERE p_size * 2 > 90"),
    same("agg_distinct", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS c FROM orders GROUP BY o_orderstatus", O),
    same("agg_filter", "SELECT l_returnflag, count(*) FILTER (WHERE l_quantity > 25) AS big, round(sum(l_tax) FILTER (WHERE l_linestatus = 'O'), 4) AS t FROM lineitem GROUP BY l_returnflag", L),
    same("agg_over_join", "SELECT n_name, round(avg(s_acctbal), 4) AS a, min(s_name) AS lo, max(s_acctbal) AS hi FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name", f"{N} {S}"),
    same("agg_in_order_by", "SELECT c_nationkey FROM customer GROUP BY c_nationkey ORDER BY count(*) DESC, c_nationkey LIMIT 5", C),
    same("agg_expression", "SELECT round(sum(l_extendedprice * l_discount) / count(*), 6) AS d FROM lineitem", L),
    # windows
    same("win_rank", "SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS INT) AS rn, CAST(rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS INT) AS rk, CAST(dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS INT) AS dr FROM part", P),
    same("win_whole", "SELECT c_custkey, count(*) OVER (PARTITION BY c_nationkey) AS n, round(sum(c_acctbal) OVER (PARTITION BY c_nationkey), 2) AS s, round(avg(c_acctbal) OVER (PARTITION BY c_nationkey), 4) AS a, min(c_acctbal) OVER (PARTITION BY c_nationkey) AS lo, max(c_acctbal) OVER (PARTITION BY c_nationkey) AS hi FROM customer", C),
    same("win_running", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 2) AS s, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders", O),
    same("win_range_ties", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size) AS n FROM part", P),
    same("win_rows_frame", "SELECT o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 4) AS a FROM orders", O),
    same("win_range_frame", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS n FROM part", P),
    same("win_count_nulls", "SELECT n_nationkey, count(NULLIF(n_regionkey, 1)) OVER (PARTITION BY n_regionkey) AS c, sum(NULLIF(n_regionkey, n_regionkey)) OVER (PARTITION BY n_regionkey) AS s FROM nation", N, "SELECT n_nationkey, count(NULLIF(n_regionkey, 1)) OVER (PARTITION BY n_regionkey) AS c, NULL::BIGINT AS s FROM nation"),
    # sort, limit, top-k
    same("sort_multi", "SELECT c_custkey, c_nationkey, c_acctbal FROM customer ORDER BY c_nationkey DESC, c_acctbal ASC, c_custkey", C),
    same("sort_expression", "SELECT p_partkey FROM part ORDER BY CASE WHEN p_size > 25 THEN 0 ELSE 1 END, p_retailprice / p_size DESC, p_partkey", P),
    same("sort_nulls", "SELECT n_nationkey, NULLIF(n_regionkey, 2) AS k FROM nation ORDER BY NULLIF(n_regionkey, 2) DESC NULLS LAST, n_nationkey", N),
    same("sort_nulls_first", "SELECT n_nationkey, NULLIF(n_regionkey, 2) AS k FROM nation ORDER BY NULLIF(n_regionkey, 2) ASC NULLS FIRST, n_nationkey", N),
    same("sort_default_nulls", "SELECT n_nationkey, CAST(row_number() OVER (ORDER BY NULLIF(n_regionkey, 2), n_nationkey) AS INT) AS up, CAST(row_number() OVER (ORDER BY NULLIF(n_regionkey, 2) DESC, n_nationkey) AS INT) AS down FROM nation", N,
         "SELECT n_nationkey, CAST(row_number() OVER (ORDER BY NULLIF(n_regionkey, 2) NULLS FIRST, n_nationkey) AS INT) AS up, CAST(row_number() OVER (ORDER BY NULLIF(n_regionkey, 2) DESC NULLS LAST, n_nationkey) AS INT) AS down FROM nation"),
    same("fetch_first", "SELECT o_orderkey FROM orders ORDER BY o_orderkey OFFSET 25 ROWS FETCH FIRST 10 ROWS ONLY", O, "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 25"),
    same("select_for_update", "SELECT c_custkey FROM customer WHERE c_acctbal < 0 FOR UPDATE", C, "SELECT c_custkey FROM customer WHERE c_acctbal < 0"),
    same("limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 25", O),
    same("top_k", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 20", L),
    same("top_k_join", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 9", f"{O} {C}"),
    # set operations
    same("union_distinct", "SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region", f"{N} {R}"),
    same("union_all", "SELECT n_regionkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region", f"{N} {R}"),
    same("intersect_distinct", "SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders", f"{C} {O}"),
    same("intersect_all", "SELECT n_regionkey AS k FROM nation INTERSECT ALL SELECT s_nationkey FROM supplier WHERE s_nationkey < 3", f"{N} {S}"),
    same("except_distinct", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders", f"{C} {O}"),
    same("except_all", "SELECT s_nationkey AS k FROM supplier EXCEPT ALL SELECT n_nationkey FROM nation", f"{N} {S}"),
    same("set_ops_order", "SELECT n_nationkey AS k, 'n' AS s FROM nation UNION ALL SELECT r_regionkey, 'r' FROM region ORDER BY k DESC, s LIMIT 8", f"{N} {R}"),
    same("set_ops_precedence", "SELECT r_regionkey AS k FROM region UNION SELECT n_nationkey FROM nation INTERSECT SELECT s_suppkey FROM supplier", f"{N} {R} {S}"),
    # subqueries and CTEs
    same("derived_nested", "SELECT k, n FROM (SELECT k, count(*) AS n FROM (SELECT o_custkey % 7 AS k FROM orders WHERE o_totalprice > 1000) x GROUP BY k) y WHERE n > 10", O),
    same("derived_limit", "SELECT t.o_orderkey FROM (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 30) t WHERE t.o_orderkey % 2 = 0", O),
    same("scalar_where", "SELECT p_partkey FROM part WHERE p_retailprice > (SELECT avg(p_retailprice) * 1.2 FROM part)", P),
    same("scalar_having", "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey HAVING count(*) > (SELECT count(*) / 25.0 FROM customer)", C),
    same("scalar_select", "SELECT n_nationkey, (SELECT count(*) FROM region) AS r FROM nation", f"{N} {R}"),
    same("scalar_correlated", "SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS top FROM customer", f"{C} {O}"),
    same("cte_chain", "WITH big AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 100000), per(k, n) AS (SELECT o_custkey, count(*) FROM big GROUP BY o_custkey) SELECT k, n FROM per WHERE n >= 2", O),
    same("cte_recursive", "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 50) SELECT n, n * n AS sq FROM t", R, "SELECT CAST(n AS INT) AS n, CAST(n * n AS INT) AS sq FROM range(1, 51) r(n)"),
    same("constant_false", "SELECT n_name FROM nation WHERE 1 = 0", N),
]
