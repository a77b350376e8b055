"""The SQL surface: joins, aggregates, windows, sets, functions. Where both engines read the same text, it is written once."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import functions as Q
from .. import operators as R
from .. import streaming as S

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _sql(name: str, text: str, oracle: str | None = None) -> None:
    """``oracle`` only where the engines' dialects differ."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        for t in TABLES:
            if re.search(rf"\b{t}\b", text):
                read(spark, sf, t).createOrReplaceTempView(t)
        return spark.sql(text)

    QUERIES[name], ORACLE_SQL[name] = run, oracle or text


def _df(name: str, oracle: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return keep


# ---- order and limit ----
_sql("limit_sorted", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 25")
_sql("offset_limit", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 30")
_sql("topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 15")

# ---- aggregates ----
_sql("demo_sum_count_by_key", "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_orderstatus ORDER BY o_orderstatus ASC NULLS LAST")
_sql("agg_filter_clause", "SELECT l_returnflag, count(*) FILTER (WHERE l_quantity > 25) AS n, count(*) AS total FROM lineitem GROUP BY l_returnflag")
_sql("agg_distinct", "SELECT count(DISTINCT o_custkey) AS customers, count(DISTINCT o_orderpriority) AS priorities FROM orders")
_sql("agg_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(grouping(l_linestatus) AS INT) AS g FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
_sql("agg_cube", "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY CUBE (c_mktsegment, c_nationkey)")
_sql("agg_grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
_sql("agg_stats", "SELECT l_returnflag, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS sd, round(var_pop(l_quantity), 6) AS var, round(corr(l_quantity, l_extendedprice), 6) AS r, round(covar_pop(l_quantity, l_discount), 6) AS cov, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope FROM lineitem GROUP BY l_returnflag")
_sql("agg_bool", "SELECT l_returnflag, bool_and(l_quantity > 0) AS every_one, bool_or(l_tax > 0.07) AS any_one, bit_or(l_linenumber) AS bits, bit_xor(l_linenumber) AS odd FROM lineitem GROUP BY l_returnflag")
_sql("agg_array_string", "SELECT n_regionkey, array_join(sort_array(collect_list(n_name)), ',') AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
_sql("agg_median", "SELECT l_linestatus, median(l_quantity) AS med FROM lineitem GROUP BY l_linestatus")
_sql("agg_pricing_summary", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus")
_sql("agg_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) >= 15")


@_df("approx_distinct")
def _(spark, sf):
    return read(spark, sf, "orders").agg(F.approx_count_distinct("o_custkey", 0.02).alias("customers"))


@_df("approx_percentile")
def _(spark, sf):
    return read(spark, sf, "orders").groupBy("o_orderstatus").agg(F.percentile_approx("o_totalprice", [0.5, 0.9, 0.99], 10_000).alias("q"))


# ---- joins ----
_sql("join_inner", "SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey")
_sql("join_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P'")
_sql("join_right", "SELECT o_orderkey, c_custkey FROM (SELECT * FROM customer WHERE c_nationkey < 5) c RIGHT JOIN orders ON c_custkey = o_custkey")
_sql("join_full", "SELECT s_suppkey, c_custkey FROM (SELECT * FROM supplier WHERE s_nationkey < 12) s FULL JOIN (SELECT * FROM customer WHERE c_nationkey > 8 AND c_custkey % 10 = 0) c ON s_nationkey = c_nationkey")
_sql("join_semi", "SELECT c_custkey FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey", "SELECT c_custkey FROM customer SEMI JOIN orders ON c_custkey = o_custkey")
_sql("join_anti", "SELECT c_custkey FROM customer LEFT ANTI JOIN orders ON c_custkey = o_custkey", "SELECT c_custkey FROM customer ANTI JOIN orders ON c_custkey = o_custkey")
_sql("join_anti_gate", "SELECT count(*) AS orphans FROM orders f LEFT JOIN customer d ON f.o_custkey = d.c_custkey WHERE d.c_custkey IS NULL")
_sql("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
_sql("join_theta_range", "SELECT s_suppkey, n_nationkey FROM supplier JOIN nation ON s_nationkey < n_nationkey AND n_nationkey < s_nationkey + 3")
_sql("join_using", "SELECT p_partkey, n FROM part JOIN (SELECT l_partkey AS p_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey) q USING (p_partkey)")
_sql("join_star", "SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name")
_sql("join_lateral", "SELECT n_name, q.best FROM nation, LATERAL (SELECT max(s_acctbal) AS best FROM supplier WHERE s_nationkey = n_nationkey) q")
_sql("subq_exists", "SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o.o_orderkey AND l_discount > 0.09)")
_sql("subq_not_exists", "SELECT p_partkey FROM part p WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p.p_partkey AND l_quantity > 45)")
_sql("subq_in", "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
_sql("subq_scalar_correlated", "SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c.c_custkey) AS most FROM customer c")
_sql("subq_scalar_uncorrelated", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)")


@_df("join_range_binned", "SELECT event_id, o_orderkey FROM events JOIN (SELECT o_orderkey, o_orderkey * 3 AS lo, o_orderkey * 3 + 10 AS hi FROM orders) r ON event_id >= lo AND event_id < hi")
def _(spark, sf):
    ranges = read(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") * 3).alias("lo"), (F.col("o_orderkey") * 3 + 10).alias("hi"))
    return R.range_join(read(spark, sf, "events").select("event_id"), ranges, "event_id", "lo", "hi", 16).select("event_id", "o_orderkey")


@_df("join_asof", "SELECT p.user_id, p.event_id, v.value AS last_value FROM (SELECT * FROM events WHERE event_type <> 'view') p ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY user_id, ts) v ON p.user_id = v.user_id AND p.ts >= v.ts")
def _(spark, sf):
    e = read(spark, sf, "events")
    views = e.where("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("value").alias("last_value"))
    others = e.where("event_type <> 'view'").select("user_id", "ts", "event_id")
    return R.asof_join(others, views, "ts", ["user_id"], ["last_value"]).select("user_id", "event_id", "last_value")


# ---- windows ----
_sql("win_row_number", "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INT) AS rn FROM orders")
_sql("win_rank", "SELECT p_partkey, CAST(rank() OVER w AS INT) AS r, CAST(dense_rank() OVER w AS INT) AS d, round(percent_rank() OVER w, 6) AS p, round(cume_dist() OVER w, 6) AS c FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size)")
_sql("win_lag_lead", "SELECT event_id, lag(value) OVER w AS before, lead(value, 2) OVER w AS later FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
_sql("win_rows_frame", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS s FROM events")
_sql("win_range_frame", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS n FROM part")
_sql("win_ntile", "SELECT s_suppkey, CAST(ntile(4) OVER (ORDER BY s_acctbal, s_suppkey) AS INT) AS quarter FROM supplier")
_sql("win_first_last", "SELECT o_orderkey, first_value(o_orderkey) OVER w AS first_one, last_value(o_orderkey) OVER w AS last_one, nth_value(o_orderkey, 2) OVER w AS second_one FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")


@_df("win_groups_frame", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS n FROM part")
def _(spark, sf):
    return R.over_groups(F.count("*"), ["p_brand"], "p_size", 1, 1, read(spark, sf, "part"), "n").select("p_partkey", "n")


@_df("win_qualify", "SELECT o_orderkey, o_custkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2")
def _(spark, sf):
    at = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return R.qualify(read(spark, sf, "orders"), at <= 2).select("o_orderkey", "o_custkey")


@_df("set_distinct_on", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_orderdate, o_orderkey")
def _(spark, sf):
    return R.distinct_on(read(spark, sf, "orders"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


# ---- sets ----
_sql("set_union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
_sql("set_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
_sql("set_intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
_sql("set_intersect_all", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
_sql("set_except", "SELECT o_custkey AS k FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_nationkey < 12")
_sql("set_except_all", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
_sql("set_distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
_sql("set_values", "SELECT a, b FROM (VALUES (1, 'x'), (2, 'y'), (3, NULL)) AS t(a, b)")
_sql("cte_recursive", "WITH RECURSIVE t(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 12) SELECT n, f FROM t")

# ---- functions ----
_sql("fn_string", "SELECT c_custkey, upper(c_name) AS u, lower(c_name) AS l, length(c_name) AS n, substr(c_name, 3, 4) AS s, replace(c_name, 'o', '0') AS r, reverse(c_name) AS v, lpad(c_mktsegment, 12, '*') AS p, concat(c_mktsegment, '/', c_name) AS c, trim(concat('  ', c_name, ' ')) AS t, left(c_name, 3) AS lf, right(c_name, 3) AS rt, repeat('ab', 2) AS rep, translate(c_name, 'abc', 'xyz') AS tr, ascii(c_name) AS a, levenshtein(c_name, c_mktsegment) AS d, split_part(c_name, '#', 1) AS sp, octet_length(c_name) AS o FROM customer", "SELECT c_custkey, upper(c_name) AS u, lower(c_name) AS l, CAST(length(c_name) AS INT) AS n, substr(c_name, 3, 4) AS s, replace(c_name, 'o', '0') AS r, reverse(c_name) AS v, lpad(c_mktsegment, 12, '*') AS p, concat(c_mktsegment, '/', c_name) AS c, trim(concat('  ', c_name, ' ')) AS t, left(c_name, 3) AS lf, right(c_name, 3) AS rt, repeat('ab', 2) AS rep, translate(c_name, 'abc', 'xyz') AS tr, ascii(c_name) AS a, CAST(levenshtein(c_name, c_mktsegment) AS INT) AS d, split_part(c_name, '#', 1) AS sp, CAST(strlen(c_name) AS INT) AS o FROM customer")
_sql("fn_regex", "SELECT page_id, regexp_extract(url, '^(https?)://([^/]+)', 2) AS host, regexp_replace(url, '[0-9]+', '#') AS shape, url RLIKE 'utm_' AS tracked, CAST(regexp_count(url, '/') AS INT) AS slashes FROM pages", "SELECT page_id, regexp_extract(url, '^(https?)://([^/]+)', 2) AS host, regexp_replace(url, '[0-9]+', '#', 'g') AS shape, regexp_matches(url, 'utm_') AS tracked, CAST(len(regexp_extract_all(url, '/')) AS INT) AS slashes FROM pages")
_sql("fn_datetime", "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, dayofmonth(o_orderdate) AS d, quarter(o_orderdate) AS q, date_trunc('MONTH', o_orderdate) AS month_start, date_format(o_orderdate, 'yyyy-MM-dd') AS iso, datediff(o_orderdate, DATE '1995-01-01') AS days FROM orders", "SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m, CAST(day(o_orderdate) AS INT) AS d, CAST(quarter(o_orderdate) AS INT) AS q, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS month_start, strftime(o_orderdate, '%Y-%m-%d') AS iso, CAST(datediff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS INT) AS days FROM orders")
_sql("fn_math", "SELECT l_orderkey, l_linenumber, abs(-l_quantity) AS a, CAST(ceil(l_extendedprice) AS BIGINT) AS c, CAST(floor(l_extendedprice) AS BIGINT) AS f, round(l_extendedprice, 1) AS r, round(sqrt(l_quantity), 6) AS s, round(ln(l_quantity), 6) AS l, round(power(l_quantity, 2), 2) AS p, round(exp(l_discount), 8) AS e, CAST(sign(l_tax - 0.04) AS INT) AS g, round(atan2(l_quantity, l_tax + 1), 6) AS t, round(degrees(l_tax), 6) AS dg FROM lineitem")
_sql("fn_conditional", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band, coalesce(nullif(o_orderstatus, 'P'), 'none') AS s, greatest(o_orderkey, o_custkey) AS g, least(o_orderkey, o_custkey) AS l FROM orders")
_sql("fn_array", "SELECT vec_id, size(embedding) AS n, round(CAST(embedding[0] AS DOUBLE), 5) AS head, round(CAST(array_max(embedding) AS DOUBLE), 5) AS most, array_contains(array(1, 2, 3), label) AS has, size(slice(embedding, 2, 3)) AS part FROM embeddings", "SELECT vec_id, CAST(len(embedding) AS INT) AS n, round(CAST(embedding[1] AS DOUBLE), 5) AS head, round(CAST(list_max(embedding) AS DOUBLE), 5) AS most, list_contains([1, 2, 3], label) AS has, CAST(len(embedding[2:4]) AS INT) AS part FROM embeddings")
_sql("fn_unnest", "SELECT vec_id, pos, round(CAST(x AS DOUBLE), 5) AS x FROM embeddings LATERAL VIEW posexplode(slice(embedding, 1, 4)) e AS pos, x", "SELECT vec_id, CAST(i - 1 AS INT) AS pos, round(CAST(embedding[i] AS DOUBLE), 5) AS x FROM embeddings, range(1, 5) r(i)")
_sql("fn_map", "SELECT n_nationkey, element_at(map('k', n_name, 'r', CAST(n_regionkey AS STRING)), 'k') AS k, size(map_keys(map('k', n_name, 'r', 'x'))) AS n FROM nation", "SELECT n_nationkey, MAP {'k': n_name, 'r': CAST(n_regionkey AS VARCHAR)}['k'] AS k, CAST(len(map_keys(MAP {'k': n_name, 'r': 'x'})) AS INT) AS n FROM nation")
_sql("fn_struct", "SELECT n_nationkey, s.a AS a, s.b AS b FROM (SELECT n_nationkey, named_struct('a', n_name, 'b', n_regionkey) AS s FROM nation)", "SELECT n_nationkey, s.a AS a, s.b AS b FROM (SELECT n_nationkey, struct_pack(a := n_name, b := n_regionkey) AS s FROM nation)")
_sql("fn_json_text", "SELECT event_id, CAST(get_json_object(props, '$.k') AS INT) AS k FROM events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
_sql("fn_hash", "SELECT c_custkey, md5(c_name) AS m, sha2(c_name, 256) AS s, lower(hex(encode(c_name, 'UTF-8'))) AS h, base64(encode(c_name, 'UTF-8')) AS b FROM customer", "SELECT c_custkey, md5(c_name) AS m, sha256(c_name) AS s, lower(hex(encode(c_name))) AS h, base64(encode(c_name)) AS b FROM customer")
_sql("fn_cast_try", "SELECT event_id, try_cast(event_type AS INT) AS bad, CAST(event_id AS STRING) AS s, CAST(CAST(value AS DECIMAL(18, 2)) AS DOUBLE) AS d FROM events", "SELECT event_id, TRY_CAST(event_type AS INT) AS bad, CAST(event_id AS VARCHAR) AS s, CAST(CAST(value AS DECIMAL(18, 2)) AS DOUBLE) AS d FROM events")


@_df("fn_compat", "SELECT l_orderkey, l_linenumber, gcd(l_orderkey, l_partkey) AS g, lcm(CAST(l_linenumber AS BIGINT), CAST(12 AS BIGINT)) AS l, time_bucket(INTERVAL '5 days', l_shipdate, TIMESTAMP '1970-01-01') AS bin, l_orderkey // 7 AS q FROM lineitem")
def _(spark, sf):
    c = F.col
    bin_ = Q.date_bin(5 * 86400, c("l_shipdate")).cast("timestamp_ntz").alias("bin")
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", Q.gcd(c("l_orderkey"), c("l_partkey")).alias("g"), Q.lcm(c("l_linenumber"), F.lit(12)).alias("l"), bin_, Q.int_div(c("l_orderkey"), F.lit(7)).alias("q"))


# ---- extension: event time ----
@_df("ext_tumbling", "SELECT time_bucket(INTERVAL '1 day', ts) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark, sf):
    return S.tumbling(read(spark, sf, "events"), "ts", ["event_type"], "1 day").select(F.col("window.start").alias("day"), "event_type", "n")
