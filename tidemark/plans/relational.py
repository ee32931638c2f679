"""General SQL over the star schema and the events: joins, windows, sets, subqueries, grouping, scalar functions. Each has a DuckDB twin."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tidemark.sources.tables import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def over(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """SQL over the tables of a folder, which need no views: `FROM orders` is that folder's orders."""
    used = [t for t in TABLES if re.search(rf"\b(?:FROM|JOIN|,)\s+{t}\b", sql)]
    for t in used:
        sql = re.sub(rf"\b((?:FROM|JOIN)\s+|,\s+){t}\b(?!\.)", rf"\g<1>{{{t}}}", sql)
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in used})


def pair(name: str, spark_sql: str, duck_sql: str | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return over(spark, sf_dir, spark_sql)

    run.__name__ = name
    QUERIES[name], ORACLE[name] = run, duck_sql or spark_sql


def money(x: str, as_: str) -> str:
    """An exact sum: of the terms in hundredths of a cent."""
    return f"CAST(sum(CAST(round(({x}) * 10000) AS BIGINT)) AS BIGINT) AS {as_}"


pair("join_inner", f"""SELECT n_name, count(*) AS orders, {money('o_totalprice', 'total')} FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
pair("join_left", """SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
pair("join_right", """SELECT n_name, count(s_suppkey) AS suppliers FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name""")
pair("join_full", """SELECT a.k AS ak, b.k AS bk, a.n AS an, b.n AS bn FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY c_nationkey) a FULL OUTER JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY s_nationkey) b ON a.k = b.k""")
pair("join_self", """SELECT a.n_name AS one, b.n_name AS other FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey""")
pair("join_cross", """SELECT r_name, n_name FROM region CROSS JOIN nation""")
pair("join_semi", """SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)""")
pair("join_anti", """SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)""")
pair("join_range", """SELECT e.event_id, count(*) AS near FROM events e JOIN events f ON e.user_id = f.user_id AND f.ts > e.ts AND f.ts <= e.ts + INTERVAL 1 HOUR GROUP BY e.event_id""")
pair("agg_exact_sum", f"""SELECT l_returnflag, l_linestatus, {money('l_quantity', 'quantity')}, {money('l_extendedprice', 'base')}, {money('l_extendedprice * (1 - l_discount)', 'discounted')}, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus""")
pair(
    "agg_stats",
    """SELECT event_type, count(DISTINCT user_id) AS users, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, round(var_pop(value), 4) AS var, round(median(value), 6) AS median, min(value) AS lo, max(value) AS hi, bool_and(value > 0) AS positive, bool_or(value > 100) AS large, round(corr(value, event_id), 6) AS corr, round(regr_slope(value, event_id), 9) AS slope FROM events GROUP BY event_type""",
)
pair(
    "agg_collect",
    """SELECT event_type, array_join(array_sort(array_agg(DISTINCT user_id)), ',') AS users, max_by(event_id, struct(value, event_id)) AS top, min_by(event_id, struct(value, event_id)) AS bottom, bit_and(event_id) AS bits, count_if(value > 50) AS many FROM events GROUP BY event_type""",
    """SELECT event_type, array_to_string(list_sort(list(DISTINCT user_id)), ',') AS users, arg_max(event_id, (value, event_id)) AS top, arg_min(event_id, (value, event_id)) AS bottom, bit_and(event_id) AS bits, count(*) FILTER (value > 50) AS many FROM events GROUP BY event_type""",
)
pair("having", """SELECT o_custkey, count(*) AS n, max(o_totalprice) AS most FROM orders GROUP BY o_custkey HAVING count(*) > 5 AND max(o_totalprice) > 100000""")
pair("group_ordinal", """SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2""")
pair("grouping_sets", """SELECT l_returnflag, l_linestatus, grouping(l_returnflag) + 2 * grouping(l_linestatus) AS level, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())""", """SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag) + 2 * grouping(l_linestatus) AS INTEGER) AS level, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())""")
pair("cube", """SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)""")
pair("rollup", """SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)""")
pair("filter_clause", """SELECT event_type, count(*) FILTER (WHERE value > 50) AS high, count(DISTINCT user_id) FILTER (WHERE value <= 50) AS low_users FROM events GROUP BY event_type""")
pair("win_rank", """SELECT event_id, row_number() OVER w AS rn, rank() OVER w AS rk, dense_rank() OVER w AS dr, ntile(4) OVER (PARTITION BY event_type ORDER BY user_id, event_id) AS quarter, round(percent_rank() OVER w, 9) AS pr, round(cume_dist() OVER w, 9) AS cd FROM events WINDOW w AS (PARTITION BY event_type ORDER BY user_id, event_id)""", """SELECT event_id, CAST(row_number() OVER w AS INTEGER) AS rn, CAST(rank() OVER w AS INTEGER) AS rk, CAST(dense_rank() OVER w AS INTEGER) AS dr, CAST(ntile(4) OVER w AS INTEGER) AS quarter, round(percent_rank() OVER w, 9) AS pr, round(cume_dist() OVER w, 9) AS cd FROM events WINDOW w AS (PARTITION BY event_type ORDER BY user_id, event_id)""")
pair("win_lag", """SELECT event_id, lag(value, 1) OVER w AS before, lead(value, 2, -1.0) OVER w AS after FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
pair("win_value", """SELECT event_id, first_value(value) OVER w AS first, nth_value(value, 2) OVER w AS second, last_value(value) OVER w AS last FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
pair("win_frame_rows", """SELECT event_id, max(value) OVER w AS hi, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 FOLLOWING)""")
pair(
    "win_frame_range",
    # A frame of two hours is the end of one stretch of two hours and the start of the next: running aggregates over each, so that the work doesn't grow with the rows of a frame.
    """WITH e AS (SELECT event_id, event_type, value, unix_micros(CAST(ts AS TIMESTAMP)) AS at FROM events), placed AS (SELECT *, (at - pmod(at, 7200000000)) div 7200000000 AS stretch FROM e),
both AS (SELECT event_id, event_type, value, at, stretch, true AS own FROM placed UNION ALL SELECT NULL, event_type, value, at + 7200000000, stretch + 1, false FROM placed WHERE at IS NOT NULL)
SELECT event_id, n, hi FROM (SELECT event_id, own, count_if(own) OVER start + count_if(NOT own) OVER rest AS n, greatest(max(CASE WHEN own THEN value END) OVER start, max(CASE WHEN NOT own THEN value END) OVER rest) AS hi FROM both
  WINDOW start AS (PARTITION BY event_type, stretch ORDER BY at RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), rest AS (PARTITION BY event_type, stretch ORDER BY at DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) WHERE own""",
    """SELECT event_id, count(*) OVER w AS n, max(value) OVER w AS hi FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL '2' HOUR PRECEDING AND CURRENT ROW)""",
)
pair(
    "win_frame_groups",
    """SELECT event_id, count(*) OVER w AS n FROM (SELECT event_id, event_type, dense_rank() OVER (PARTITION BY event_type ORDER BY user_id) AS g FROM events) WINDOW w AS (PARTITION BY event_type ORDER BY g RANGE BETWEEN 1 PRECEDING AND CURRENT ROW)""",
    """SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY user_id GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS n FROM events""",
)
pair("order_nulls", """SELECT k, n, row_number() OVER (ORDER BY k ASC NULLS LAST, n DESC) AS place FROM (SELECT CASE WHEN n_regionkey > 2 THEN n_regionkey END AS k, n_name AS n FROM nation)""", """SELECT k, n, CAST(row_number() OVER (ORDER BY k ASC NULLS LAST, n DESC) AS INTEGER) AS place FROM (SELECT CASE WHEN n_regionkey > 2 THEN n_regionkey END AS k, n_name AS n FROM nation)""")
pair("topk", """SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 20 OFFSET 5""")
pair("union_all", """SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier""")
pair("union", """SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier""")
pair("intersect", """SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier""")
pair("except", """SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000""")
pair("except_all", """SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier""")
pair("intersect_all", """SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier""")
pair("cte", """WITH big AS (SELECT o_custkey, sum(o_totalprice) AS s FROM orders GROUP BY o_custkey), avg_ AS (SELECT avg(s) AS a FROM big) SELECT o_custkey FROM big, avg_ WHERE s > a * 1.5""")
pair("cte_recursive", """WITH RECURSIVE days(d, n) AS (SELECT DATE '2024-01-01', 1 UNION ALL SELECT CAST(d + INTERVAL 1 DAY AS DATE), n + 1 FROM days WHERE n < 31) SELECT d, n, count(event_id) AS events FROM days LEFT JOIN events ON CAST(ts AS DATE) = d GROUP BY d, n""")
pair("scalar_subquery", """SELECT event_type, count(*) AS above FROM events WHERE value > (SELECT avg(value) FROM events) GROUP BY event_type""")
pair("correlated_scalar", """SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS most FROM customer""")
pair("exists_corr", """SELECT p_partkey FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45 AND l_discount > 0.05)""")
pair("values_table", """SELECT x.name, count(n_nationkey) AS n FROM (VALUES (0, 'zero'), (1, 'one'), (9, 'nine')) AS x(k, name) LEFT JOIN nation ON n_regionkey = k GROUP BY x.name""")
pair(
    "generate_series",
    """SELECT d.n AS day, count(event_id) AS events FROM (SELECT explode(sequence(1, 31)) AS n) d LEFT JOIN events ON day(ts) = n GROUP BY d.n""",
    """SELECT CAST(d.n AS INTEGER) AS day, count(event_id) AS events FROM (SELECT unnest(generate_series(1, 31)) AS n) d LEFT JOIN events ON day(ts) = n GROUP BY d.n""",
)
pair(
    "lateral_unnest",
    """SELECT word, count(*) AS n FROM benchmark LATERAL VIEW explode(split(lower(text), '[^a-z]+')) x AS word WHERE word <> '' GROUP BY word""",
    """SELECT word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS word FROM benchmark) WHERE word <> '' GROUP BY word""",
)
pair("like_case", """SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS size, p_name LIKE '%e%' AS e FROM part WHERE p_brand LIKE 'Brand#_%' OR p_size + 1 > p_partkey % 50""")
pair("column_compare", """SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity * 1000 > l_extendedprice AND l_tax < l_discount""")
pair("count_star", """SELECT count(*) AS n FROM lineitem""")
pair("in_between", """SELECT o_orderkey FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH') AND o_totalprice NOT BETWEEN 1000 AND 200000 AND true""")

pair(
    "fn_string",
    """SELECT n_nationkey, lower(n_name) AS lo, upper(n_name) AS up, initcap(lower(n_name)) AS ini, length(n_name) AS len, octet_length(n_name) AS oct, bit_length(n_name) AS bits, substring(n_name, 2, 3) AS sub, left(n_name, 2) AS lft, right(n_name, 2) AS rgt, instr(n_name, 'A') AS pos, lpad(n_name, 12, '*') AS lp, rpad(n_name, 12, '-') AS rp, repeat(n_name, 2) AS rep, replace(n_name, 'A', 'x') AS rpl, reverse(n_name) AS rev, split_part(n_name, 'A', 1) AS spl, startswith(n_name, 'A') AS st, endswith(n_name, 'A') AS en, translate(n_name, 'AEI', 'aei') AS tr, ascii(n_name) AS asc, chr(65 + n_nationkey) AS ch, concat_ws('/', n_name, n_regionkey) AS cw, trim(concat('  ', n_name, ' ')) AS tm, levenshtein(n_name, 'CHINA') AS lev, lower(hex(n_nationkey)) AS hx FROM nation""",
    """SELECT n_nationkey, lower(n_name) AS lo, upper(n_name) AS up, upper(n_name[1]) || lower(n_name[2:]) AS ini, CAST(length(n_name) AS INTEGER) AS len, CAST(strlen(n_name) AS INTEGER) AS oct, CAST(bit_length(n_name) AS INTEGER) AS bits, substring(n_name, 2, 3) AS sub, left(n_name, 2) AS lft, right(n_name, 2) AS rgt, CAST(instr(n_name, 'A') AS INTEGER) AS pos, lpad(n_name, 12, '*') AS lp, rpad(n_name, 12, '-') AS rp, repeat(n_name, 2) AS rep, replace(n_name, 'A', 'x') AS rpl, reverse(n_name) AS rev, split_part(n_name, 'A', 1) AS spl, starts_with(n_name, 'A') AS st, ends_with(n_name, 'A') AS en, translate(n_name, 'AEI', 'aei') AS tr, ascii(n_name) AS asc, chr(65 + n_nationkey) AS ch, concat_ws('/', n_name, n_regionkey) AS cw, trim('  ' || n_name || ' ') AS tm, CAST(levenshtein(n_name, 'CHINA') AS INTEGER) AS lev, lower(hex(n_nationkey)) AS hx FROM nation""",
)
pair(
    "fn_regex",
    """SELECT p_partkey, p_name RLIKE '^[a-m]' AS lk, regexp_replace(p_name, '[aeiou]', '_') AS rp, regexp_extract(p_type, '([A-Z]+)$', 1) AS ex, regexp_count(p_name, 'a') AS ct FROM part""",
    """SELECT p_partkey, regexp_matches(p_name, '^[a-m]') AS lk, regexp_replace(p_name, '[aeiou]', '_', 'g') AS rp, regexp_extract(p_type, '([A-Z]+)$', 1) AS ex, CAST(len(regexp_extract_all(p_name, 'a')) AS INTEGER) AS ct FROM part""",
)
pair(
    "fn_date",
    """SELECT o_orderkey, year(o_orderdate) AS y, quarter(o_orderdate) AS q, month(o_orderdate) AS m, day(o_orderdate) AS d, dayofweek(o_orderdate) - 1 AS dow, dayofyear(o_orderdate) AS doy, CAST(date_trunc('MONTH', o_orderdate) AS TIMESTAMP_NTZ) AS mon, date_format(o_orderdate, 'yyyy/MM/dd') AS txt, unix_seconds(CAST(o_orderdate AS TIMESTAMP)) AS epoch, CAST(o_orderdate AS DATE) AS dt, date_add(CAST(o_orderdate AS DATE), 10) AS later, datediff(DATE '1998-12-31', CAST(o_orderdate AS DATE)) AS days, make_date(year(o_orderdate), 1, 1) AS jan, o_orderdate + INTERVAL '30' DAY AS plus FROM orders""",
    """SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(quarter(o_orderdate) AS INTEGER) AS q, CAST(month(o_orderdate) AS INTEGER) AS m, CAST(day(o_orderdate) AS INTEGER) AS d, CAST(dayofweek(o_orderdate) AS INTEGER) AS dow, CAST(dayofyear(o_orderdate) AS INTEGER) AS doy, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS mon, strftime(o_orderdate, '%Y/%m/%d') AS txt, epoch_us(o_orderdate) // 1000000 AS epoch, CAST(o_orderdate AS DATE) AS dt, CAST(CAST(o_orderdate AS DATE) + 10 AS DATE) AS later, CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-12-31') AS INTEGER) AS days, make_date(year(o_orderdate), 1, 1) AS jan, o_orderdate + INTERVAL 30 DAY AS plus FROM orders""",
)
pair(
    "fn_math",
    """SELECT l_orderkey, l_linenumber, abs(l_discount - 0.05) AS a, CAST(ceil(l_quantity / 7) AS BIGINT) AS c, CAST(floor(l_quantity / 7) AS BIGINT) AS f, sqrt(l_quantity) AS sq, round(cbrt(l_quantity), 9) AS cb, round(ln(l_quantity), 9) AS l, round(log10(l_quantity), 9) AS lt, round(log2(l_quantity), 9) AS l2, round(exp(l_discount), 9) AS e, round(power(l_quantity, 1.5), 6) AS p, round(sin(l_quantity), 9) AS s, round(atan2(l_quantity, 3.0), 9) AS at, round(degrees(l_discount), 9) AS dg, round(radians(l_quantity), 9) AS rd, CAST(sign(l_discount - 0.05) AS INTEGER) AS sg, l_orderkey % 7 AS md, l_orderkey div 7 AS dv, greatest(l_tax, l_discount) AS g, least(l_tax, l_discount) AS ls, isnan(l_tax) AS nn FROM lineitem""",
    """SELECT l_orderkey, l_linenumber, abs(l_discount - 0.05) AS a, CAST(ceil(l_quantity / 7) AS BIGINT) AS c, CAST(floor(l_quantity / 7) AS BIGINT) AS f, sqrt(l_quantity) AS sq, round(cbrt(l_quantity), 9) AS cb, round(ln(l_quantity), 9) AS l, round(log10(l_quantity), 9) AS lt, round(log2(l_quantity), 9) AS l2, round(exp(l_discount), 9) AS e, round(power(l_quantity, 1.5), 6) AS p, round(sin(l_quantity), 9) AS s, round(atan2(l_quantity, 3.0), 9) AS at, round(degrees(l_discount), 9) AS dg, round(radians(l_quantity), 9) AS rd, CAST(sign(l_discount - 0.05) AS INTEGER) AS sg, l_orderkey % 7 AS md, l_orderkey // 7 AS dv, greatest(l_tax, l_discount) AS g, least(l_tax, l_discount) AS ls, isnan(l_tax) AS nn FROM lineitem""",
)
pair("fn_conditional", """SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'O'), 'open') AS st, CASE WHEN o_totalprice > 200000 THEN 1 END AS big, ifnull(nullif(o_orderpriority, '5-LOW'), 'low') AS pr FROM orders""")
pair(
    "fn_array",
    """SELECT vec_id, size(embedding) AS n, element_at(embedding, 1) > 0 AS pos, array_position(transform(embedding, x -> x > 0), true) AS first_pos, size(filter(embedding, x -> x > 0.1)) AS many, array_join(transform(slice(sort_array(embedding), 1, 3), x -> CAST(floor(x * 1000F) AS BIGINT)), ',') AS low3, array_contains(transform(embedding, x -> CAST(floor(x * 10F) AS BIGINT)), 3L) AS has3, size(array_distinct(transform(embedding, x -> CAST(floor(x * 10F) AS BIGINT)))) AS kinds FROM embeddings""",
    """SELECT vec_id, CAST(len(embedding) AS INTEGER) AS n, embedding[1] > 0 AS pos, CAST(list_position(list_transform(embedding, lambda x: x > 0), true) AS BIGINT) AS first_pos, CAST(len(list_filter(embedding, lambda x: x > CAST(0.1 AS DOUBLE))) AS INTEGER) AS many, array_to_string(list_transform(list_sort(embedding)[1:3], lambda x: CAST(floor(x * CAST(1000 AS FLOAT)) AS BIGINT)), ',') AS low3, list_contains(list_transform(embedding, lambda x: CAST(floor(x * CAST(10 AS FLOAT)) AS BIGINT)), 3) AS has3, CAST(len(list_distinct(list_transform(embedding, lambda x: CAST(floor(x * CAST(10 AS FLOAT)) AS BIGINT)))) AS INTEGER) AS kinds FROM embeddings""",
)
pair(
    "fn_json",
    """SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k, to_json(named_struct('id', event_id)) AS j FROM events""",
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, '{"id":' || event_id || '}' AS j FROM events""",
)
pair("fn_cast", """SELECT event_id, CAST(value AS BIGINT) AS i, TRY_CAST(event_type AS DOUBLE) AS bad, CAST(user_id AS STRING) AS s, CAST(ts AS DATE) AS d FROM events WHERE value <> round(value)""", """SELECT event_id, CAST(trunc(value) AS BIGINT) AS i, TRY_CAST(event_type AS DOUBLE) AS bad, CAST(user_id AS VARCHAR) AS s, CAST(ts AS DATE) AS d FROM events WHERE value <> round(value)""")
pair("fn_map", """SELECT event_type, map_contains_key(map(event_type, value), 'view') AS m, named_struct('a', event_id, 'b', value).a AS a FROM events""", """SELECT event_type, map_contains(MAP {event_type: value}, 'view') AS m, {'a': event_id, 'b': value}.a AS a FROM events""")
