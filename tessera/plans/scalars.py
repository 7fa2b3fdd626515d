"""One query for each small family of scalar functions, over real columns."""

from __future__ import annotations

from tessera.plans.catalogue import dialect_plan

C, O, N, P, E, D = "customer", "orders", "nation", "part", "events", "documents"

PLANS = [
    # strings
    dialect_plan("fn_lengths", "SELECT doc_id, LENGTH(text) AS b, OCTET_LENGTH(text) AS o, CHAR_LENGTH(text) AS c, LEN(lang) AS l, ASCII(source) AS a FROM documents",
                 "SELECT doc_id, strlen(text)::INT AS b, strlen(text)::INT AS o, length(text)::INT AS c, strlen(lang)::INT AS l, ascii(source) AS a FROM documents", D),
    dialect_plan("fn_case", "SELECT p_partkey, UPPER(p_name) AS u, LCASE(p_type) AS l, UCASE(p_brand) AS b FROM part", "SELECT p_partkey, upper(p_name) AS u, lower(p_type) AS l, upper(p_brand) AS b FROM part", P),
    dialect_plan("fn_left_right", "SELECT p_partkey, LEFT(p_name, 3) AS a, RIGHT(p_name, 4) AS b, LEFT(p_name, -2) AS c FROM part", "SELECT p_partkey, left(p_name, 3) AS a, right(p_name, 4) AS b, '' AS c FROM part", P),
    dialect_plan("fn_substr", "SELECT p_partkey, SUBSTR(p_name, 2) AS a, SUBSTRING(p_name, 2, 3) AS b, MID(p_name, -4, 2) AS c, SUBSTR(p_name, 0, 5) AS d, SUBSTR(p_name, -100, 2) AS e, SUBSTR(p_name, 2, -1) AS f FROM part",
                 "SELECT p_partkey, substr(p_name, 2) AS a, substr(p_name, 2, 3) AS b, substr(right(p_name, 4), 1, 2) AS c, '' AS d, left(p_name, 2) AS e, '' AS f FROM part WHERE length(p_name) < 100", P),
    dialect_plan("fn_substring_index", "SELECT c_custkey, SUBSTRING_INDEX(c_name, '#', 1) AS a, SUBSTRING_INDEX(c_name, '#', -1) AS b FROM customer",
                 "SELECT c_custkey, split_part(c_name, '#', 1) AS a, string_split(c_name, '#')[-1] AS b FROM customer", C),
    dialect_plan("fn_find", "SELECT p_partkey, INSTR(p_name, 'a') AS i, LOCATE('a', p_name) AS l, LOCATE('e', p_name, 4) AS l4, POSITION('o' IN p_name) AS p FROM part",
                 "SELECT p_partkey, instr(p_name, 'a')::INT AS i, instr(p_name, 'a')::INT AS l, (CASE WHEN instr(substr(p_name, 4), 'e') > 0 THEN instr(substr(p_name, 4), 'e') + 3 ELSE 0 END)::INT AS l4, instr(p_name, 'o')::INT AS p FROM part", P),
    dialect_plan("fn_field", "SELECT o_orderkey, FIELD(o_orderstatus, 'O', 'F', 'P') AS f, FIND_IN_SET(o_orderstatus, 'P,F,O') AS s FROM orders",
                 "SELECT o_orderkey, coalesce(list_position(['O', 'F', 'P'], o_orderstatus), 0)::BIGINT AS f, coalesce(list_position(['P', 'F', 'O'], o_orderstatus), 0)::INT AS s FROM orders", O),
    dialect_plan("fn_concat", "SELECT n_nationkey, CONCAT(n_name, '-', n_nationkey) AS c, CONCAT(n_name, NULL) AS z, CONCAT_WS('/', n_name, NULL, n_regionkey) AS w, n_name || '!' AS o FROM nation",
                 "SELECT n_nationkey, n_name || '-' || n_nationkey AS c, NULL::VARCHAR AS z, n_name || '/' || n_regionkey AS w, n_name || '!' AS o FROM nation", N),
    dialect_plan("fn_pad", "SELECT n_nationkey, LPAD(n_name, 9, '*') AS a, RPAD(n_name, 4, '*') AS b, LPAD(n_name, 12) AS c, LPAD(n_name, 30, '') AS d FROM nation",
                 "SELECT n_nationkey, lpad(n_name, 9, '*') AS a, rpad(n_name, 4, '*') AS b, lpad(n_name, 12, ' ') AS c, n_name AS d FROM nation", N),
    dialect_plan("fn_trim", "SELECT n_nationkey, TRIM(CONCAT('  ', n_name, ' ')) AS t, LTRIM(CONCAT('  ', n_name, ' ')) AS l, RTRIM(CONCAT(' ', n_name, '  ')) AS r FROM nation",
                 "SELECT n_nationkey, n_name AS t, n_name || ' ' AS l, ' ' || n_name AS r FROM nation", N),
    dialect_plan("fn_replace", "SELECT p_partkey, REPLACE(p_name, 'a', 'AA') AS r, REVERSE(p_name) AS v, REPEAT(p_brand, 2) AS p, REPEAT(p_brand, -1) AS z, SPACE(3) AS s FROM part",
                 "SELECT p_partkey, replace(p_name, 'a', 'AA') AS r, reverse(p_name) AS v, repeat(p_brand, 2) AS p, '' AS z, '   ' AS s FROM part", P),
    dialect_plan("fn_insert", "SELECT n_nationkey, INSERT(n_name, 2, 2, 'xyz') AS a, INSERT(n_name, 0, 2, 'x') AS b, INSERT(n_name, 99, 1, 'x') AS c FROM nation",
                 "SELECT n_nationkey, left(n_name, 1) || 'xyz' || substr(n_name, 4) AS a, n_name AS b, n_name AS c FROM nation", N),
    dialect_plan("fn_strcmp", "SELECT n_nationkey, STRCMP(n_name, 'J') AS a, STRCMP(n_name, NULL) AS b FROM nation", "SELECT n_nationkey, (CASE WHEN n_name < 'J' THEN -1 WHEN n_name > 'J' THEN 1 ELSE 0 END)::INT AS a, NULL::INT AS b FROM nation", N),
    dialect_plan("fn_format", "SELECT o_orderkey, FORMAT(o_orderkey * 1000, 2) AS f FROM orders", "SELECT o_orderkey, format('{:,}', o_orderkey * 1000) || '.00' AS f FROM orders", O),
    # numbers
    dialect_plan("fn_abs_sign", "SELECT c_custkey, ABS(c_acctbal) AS a, SIGN(c_acctbal) AS s, ABS(-c_custkey) AS k FROM customer", "SELECT c_custkey, abs(c_acctbal) AS a, sign(c_acctbal)::INT AS s, abs(-c_custkey) AS k FROM customer", C),
    dialect_plan("fn_mod_div", "SELECT c_custkey, MOD(c_custkey, 7) AS m, MOD(c_custkey, 0) AS z, DIV(c_custkey, 7) AS d, DIV(-c_custkey, 7) AS n, DIV(c_custkey, 0) AS dz FROM customer",
                 "SELECT c_custkey, (c_custkey % 7)::DOUBLE AS m, NULL::DOUBLE AS z, c_custkey // 7 AS d, -(c_custkey // 7) AS n, NULL::BIGINT AS dz FROM customer", C),
    dialect_plan("fn_rounding", "SELECT c_custkey, CEIL(c_acctbal) AS c, FLOOR(c_acctbal) AS f, CEILING(1.2) AS k FROM customer", "SELECT c_custkey, ceil(c_acctbal)::BIGINT AS c, floor(c_acctbal)::BIGINT AS f, 2::BIGINT AS k FROM customer", C),
    dialect_plan("fn_round", "SELECT n_nationkey, ROUND((n_nationkey - 12) / 8.0) AS r, ROUND(n_nationkey / 7.0, 2) AS r2, ROUND(n_nationkey * 10.5, -1) AS rn FROM nation",
                 "SELECT n_nationkey, round((n_nationkey - 12) / 8.0::DOUBLE)::BIGINT AS r, round(n_nationkey / 7.0::DOUBLE, 2) AS r2, round(n_nationkey * 10.5::DOUBLE, -1)::BIGINT AS rn FROM nation", N),
    dialect_plan("fn_truncate", "SELECT c_custkey, TRUNCATE(c_acctbal) AS t, TRUNC(c_acctbal / 3.0, 1) AS t1, TRUNCATE(c_acctbal, -2) AS tn FROM customer",
                 "SELECT c_custkey, trunc(c_acctbal)::BIGINT AS t, trunc(c_acctbal / 3.0::DOUBLE * 10) / 10 AS t1, (trunc(c_acctbal / 100) * 100)::BIGINT AS tn FROM customer", C),
    dialect_plan("fn_power", "SELECT p_partkey, SQRT(p_size) AS q, SQRT(-p_size) AS z, POW(p_size, 2) AS p, POWER(p_size, 0.5) AS h, round(EXP(p_size / 50.0), 9) AS e FROM part",
                 "SELECT p_partkey, sqrt(p_size) AS q, NULL::DOUBLE AS z, pow(p_size, 2) AS p, pow(p_size, 0.5) AS h, round(exp(p_size / 50.0::DOUBLE), 9) AS e FROM part", P),
    dialect_plan("fn_logs", "SELECT p_partkey, round(LN(p_size), 9) AS l, round(LOG(p_size), 9) AS g, round(LOG(2, p_size), 9) AS b, round(LOG2(p_size), 9) AS t, round(LOG10(p_size), 9) AS d, LN(-p_size) AS z FROM part",
                 "SELECT p_partkey, round(ln(p_size), 9) AS l, round(ln(p_size), 9) AS g, round(log2(p_size), 9) AS b, round(log2(p_size), 9) AS t, round(log10(p_size), 9) AS d, NULL::DOUBLE AS z FROM part", P),
    dialect_plan("fn_trigonometry", "SELECT p_partkey, round(SIN(p_size), 9) AS s, round(COS(p_size), 9) AS c, round(TAN(p_size), 6) AS t, round(ATAN(p_size), 9) AS a, round(ATAN2(p_size, 3), 9) AS a2, round(ASIN(p_size / 60.0), 9) AS i, round(ACOS(p_size / 60.0), 9) AS o, ASIN(2) AS z, round(COT(p_size), 6) AS k FROM part",
                 "SELECT p_partkey, round(sin(p_size), 9) AS s, round(cos(p_size), 9) AS c, round(tan(p_size), 6) AS t, round(atan(p_size), 9) AS a, round(atan2(p_size, 3), 9) AS a2, round(asin(p_size / 60.0::DOUBLE), 9) AS i, round(acos(p_size / 60.0::DOUBLE), 9) AS o, NULL::DOUBLE AS z, round(1 / tan(p_size), 6) AS k FROM part", P),
    dialect_plan("fn_angles", "SELECT p_partkey, round(DEGREES(p_size), 6) AS d, round(RADIANS(p_size), 9) AS r, round(PI(), 9) AS p FROM part", "SELECT p_partkey, round(degrees(p_size), 6) AS d, round(radians(p_size), 9) AS r, round(pi(), 9) AS p FROM part", P),
    dialect_plan("fn_random", "SELECT count(*) AS n, min(ok) AS ok FROM (SELECT RAND() >= 0 AND RANDOM(7) < 1 AS ok FROM part) t", "SELECT count(*) AS n, true AS ok FROM part", P),
    dialect_plan("fn_extremes", "SELECT p_partkey, GREATEST(p_size, 20, NULL) AS g, LEAST(p_size, 20, NULL) AS l FROM part", "SELECT p_partkey, greatest(p_size, 20, NULL) AS g, least(p_size, 20, NULL) AS l FROM part", P),
    # dates and times
    dialect_plan("fn_now", "SELECT LENGTH(NOW()) AS n, LENGTH(CURDATE()) AS d, LENGTH(CURTIME()) AS t, LEFT(SYSDATE(), 10) = CURRENT_DATE AS s FROM region", "SELECT 19::INT AS n, 10::INT AS d, 8::INT AS t, true AS s FROM region", "region"),
    dialect_plan("fn_date_parts", "SELECT o_orderkey, YEAR(o_orderdate) AS y, MONTH(o_orderdate) AS m, DAY(o_orderdate) AS d, DAYOFMONTH(o_orderdate) AS dm, DAYOFYEAR(o_orderdate) AS dy, QUARTER(o_orderdate) AS q, DAYOFWEEK(o_orderdate) AS w, WEEKDAY(o_orderdate) AS wd FROM orders",
                 "SELECT o_orderkey, year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS m, day(o_orderdate)::INT AS d, day(o_orderdate)::INT AS dm, dayofyear(o_orderdate)::INT AS dy, quarter(o_orderdate)::INT AS q, (dayofweek(o_orderdate) + 1)::INT AS w, (isodow(o_orderdate) - 1)::INT AS wd FROM orders", O),
    dialect_plan("fn_time_parts", "SELECT event_id, HOUR(ts) AS h, MINUTE(ts) AS m, SECOND(ts) AS s, MICROSECOND(ts) AS u, DATE(ts) AS d, TIME(ts) AS t FROM events",
                 "SELECT event_id, hour(ts)::INT AS h, minute(ts)::INT AS m, second(ts)::INT AS s, (microsecond(ts) % 1000000)::INT AS u, strftime(ts, '%Y-%m-%d') AS d, strftime(ts, '%H:%M:%S') AS t FROM events", E),
    dialect_plan("fn_names", "SELECT o_orderkey, DAYNAME(o_orderdate) AS d, MONTHNAME(o_orderdate) AS m FROM orders", "SELECT o_orderkey, dayname(o_orderdate) AS d, monthname(o_orderdate) AS m FROM orders", O),
    dialect_plan("fn_weeks", "SELECT o_orderkey, WEEK(o_orderdate) AS w, WEEKOFYEAR(o_orderdate) AS v, YEARWEEK(o_orderdate) AS y FROM orders",
                 "SELECT o_orderkey, ceil(dayofyear(o_orderdate) / 7)::INT AS w, ceil(dayofyear(o_orderdate) / 7)::INT AS v, (year(o_orderdate) * 100 + ceil(dayofyear(o_orderdate) / 7))::INT AS y FROM orders", O),
    dialect_plan("fn_date_add", "SELECT o_orderkey, DATE_ADD(o_orderdate, 40) AS a, ADDDATE(o_orderdate, 1) AS b, DATE_SUB(o_orderdate, 40) AS c, SUBDATE(o_orderdate, 365) AS d FROM orders",
                 "SELECT o_orderkey, strftime(o_orderdate::DATE + 40, '%Y-%m-%d') AS a, strftime(o_orderdate::DATE + 1, '%Y-%m-%d') AS b, strftime(o_orderdate::DATE - 40, '%Y-%m-%d') AS c, strftime(o_orderdate::DATE - 365, '%Y-%m-%d') AS d FROM orders", O),
    dialect_plan("fn_time_add", "SELECT ADDTIME('10:30:00', '01:45:30') AS a, ADDTIME('2020-01-01 23:30:00', '01:00:00') AS b, SUBTIME('00:10:00', '00:20:00') AS c, TIMEDIFF('10:00:00', '12:30:15') AS d FROM region",
                 "SELECT '12:15:30' AS a, '2020-01-01 00:30:00' AS b, '23:50:00' AS c, '-02:30:15' AS d FROM region", "region"),
    dialect_plan("fn_datediff", "SELECT o_orderkey, DATEDIFF(o_orderdate, '1995-01-01') AS d, TO_DAYS(o_orderdate) AS t, FROM_DAYS(TO_DAYS(o_orderdate)) AS f FROM orders",
                 "SELECT o_orderkey, date_diff('day', DATE '1995-01-01', o_orderdate::DATE)::INT AS d, (date_diff('day', DATE '1970-01-01', o_orderdate::DATE) + 719163)::INT AS t, strftime(o_orderdate, '%Y-%m-%d') AS f FROM orders", O),
    dialect_plan("fn_clock", "SELECT event_id, TIME_TO_SEC(TIME(ts)) AS s, SEC_TO_TIME(event_id * 7) AS t, MAKETIME(13, 5, 9) AS m FROM events",
                 "SELECT event_id, (hour(ts) * 3600 + minute(ts) * 60 + second(ts))::BIGINT AS s, (CASE WHEN event_id * 7 // 3600 < 100 THEN lpad((event_id * 7 // 3600)::VARCHAR, 2, '0') ELSE (event_id * 7 // 3600)::VARCHAR END) || ':' || lpad((event_id * 7 // 60 % 60)::VARCHAR, 2, '0') || ':' || lpad((event_id * 7 % 60)::VARCHAR, 2, '0') AS t, '13:05:09' AS m FROM events", E),
    dialect_plan("fn_make_date", "SELECT n_nationkey, MAKEDATE(2020, n_nationkey * 20) AS d, LAST_DAY('2020-02-03') AS l, TIMESTAMP('2020-02-03', '10:00:00') AS t FROM nation",
                 "SELECT n_nationkey, CASE WHEN n_nationkey > 0 THEN strftime(DATE '2020-01-01' + (n_nationkey * 20 - 1), '%Y-%m-%d') END AS d, '2020-02-29' AS l, '2020-02-03 10:00:00' AS t FROM nation", N),
    dialect_plan("fn_periods", "SELECT n_nationkey, PERIOD_ADD(202011, n_nationkey) AS a, PERIOD_DIFF(202311, 202011 + n_nationkey % 2) AS d FROM nation",
                 "SELECT n_nationkey, ((2020 * 12 + 10 + n_nationkey) // 12 * 100 + (2020 * 12 + 10 + n_nationkey) % 12 + 1)::BIGINT AS a, (36 - n_nationkey % 2)::BIGINT AS d FROM nation", N),
    dialect_plan("fn_date_format", "SELECT event_id, DATE_FORMAT(ts, '%Y/%m/%d %H-%i-%s') AS a, STRFTIME('%d.%m.%y', ts) AS b, TIME_FORMAT('13:05:09', '%H.%i') AS c, STR_TO_DATE('03,02,2020', '%d,%m,%Y') AS d FROM events",
                 "SELECT event_id, strftime(ts, '%Y/%m/%d %H-%M-%S') AS a, strftime(ts, '%d.%m.%y') AS b, '13.05' AS c, '2020-02-03' AS d FROM events", E),
    # system and control
    dialect_plan("fn_system", "SELECT LENGTH(VERSION()) > 0 AS v, DATABASE() AS d, USER() AS u, CONNECTION_ID() AS c, LAST_INSERT_ID() AS l FROM region", "SELECT true AS v, 'root' AS d, 'root' AS u, 1 AS c, 0 AS l FROM region", "region"),
    dialect_plan("fn_typeof", "SELECT TYPEOF(c_custkey) AS a, TYPEOF(c_acctbal) AS b, TYPEOF(c_name) AS c, TYPEOF(NULL) AS d FROM customer", "SELECT 'integer' AS a, 'real' AS b, 'text' AS c, 'null' AS d FROM customer", C),
    dialect_plan("fn_if", "SELECT p_partkey, IF(p_size > 25, 'big', 'small') AS a, IIF(NULLIF(p_size, p_size) > 1, 1, 2) AS b FROM part", "SELECT p_partkey, CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS a, 2 AS b FROM part", P),
    dialect_plan("fn_nulls", "SELECT p_partkey, IFNULL(NULLIF(p_size, 1), -1) AS a, NVL(NULL, 'x') AS b, COALESCE(NULL, NULLIF(p_size, 2), 0) AS c, ISNULL(NULLIF(p_size, 3)) AS d FROM part",
                 "SELECT p_partkey, coalesce(nullif(p_size, 1), -1) AS a, 'x' AS b, coalesce(nullif(p_size, 2), 0) AS c, (p_size = 3)::INT AS d FROM part", P),
    dialect_plan("fn_bases", "SELECT p_partkey, BIN(p_size) AS b, CONV(p_size, 10, 16) AS h, CONV('ff', 16, 10) AS d, CONV('-a', 16, 10) AS m FROM part",
                 "SELECT p_partkey, ltrim(bin(p_size), '0') AS b, upper(to_hex(p_size)) AS h, '255' AS d, '-10' AS m FROM part", P),
]
