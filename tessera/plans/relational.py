"""A query for each relational operator, with its DuckDB statement. {name} stands for a table; statements both engines read alike are written once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import changes as ch
from tessera.operators.relational import asof, distinct_on, groups_frame, range_join
from tessera.session import sql, table
from tessera.sources.cursors import Sequence

STATEMENTS: dict[str, tuple[str, str]] = {}


def both(name: str, text: str) -> None:
    STATEMENTS[name] = (text, text.replace("{", "").replace("}", ""))


def pair(name: str, spark: str, duck: str) -> None:
    STATEMENTS[name] = (spark, duck)


# scans, projections, filters
both("s_1_seq_scan", "SELECT * FROM {orders}")
both("s_2_column_scan", "SELECT l_orderkey, l_quantity FROM {lineitem}")
both("s_3_index_equality", "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_custkey = 77")
both("s_4_index_range", "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_totalprice BETWEEN 1000 AND 50000")
both("s_5_pk_lookup", "SELECT * FROM {customer} WHERE c_custkey = 42")
both("s_6_pk_top", "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_orderkey LIMIT 10")
both("s_9_count_star", "SELECT count(*) AS n FROM {lineitem}")
both("s_10_aggregate_pushdown", "SELECT min(l_quantity) AS lo, max(l_quantity) AS hi, count(*) AS n FROM {lineitem}")
both("s_11_dual", "SELECT 1 + 1 AS two, 'a' AS letter")
both("s_12_values", "SELECT * FROM (VALUES (1, 'x'), (2, 'y'), (3, NULL)) AS v(id, name)")
pair("s_13_generate_series", "SELECT explode(sequence(1L, 100L, 3L)) AS n", "SELECT generate_series AS n FROM generate_series(1, 100, 3)")
pair("s_14_unnest", "SELECT p_partkey, explode(split(p_name, ' ')) AS word FROM {part}", "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part")
both("p_1_projection", "SELECT p_partkey, p_size * 2 AS twice, p_retailprice FROM {part}")
both("p_2_where", "SELECT p_partkey FROM {part} WHERE nullif(p_brand, 'Brand#11') <> 'Brand#2'")
both("p_3_comparison", "SELECT p_partkey, p_size = 5 AS a, p_size <> 5 AS b, p_size < 5 AS c, p_size >= 25 AS d FROM {part}")
both("p_4_three_valued", "SELECT p_partkey, (nullif(p_size, 3) > 10) AND (p_size < 40) AS a, (nullif(p_size, 3) > 10) OR (p_size = 3) AS b, NOT (nullif(p_size, 3) > 10) AS c FROM {part}")
pair("p_5_arithmetic", "SELECT p_partkey, CAST((25 - p_size) div 7 AS BIGINT) AS q, CAST((25 - p_size) % 7 AS BIGINT) AS m, p_retailprice * 2 - 1 AS r FROM {part}", "SELECT p_partkey, CAST(trunc((25 - p_size) / 7) AS BIGINT) AS q, CAST((25 - p_size) % 7 AS BIGINT) AS m, p_retailprice * 2 - 1 AS r FROM part")
both("p_6_power", "SELECT p_partkey, round(power(p_size, 2), 3) AS r FROM {part}")
pair("p_7_bits", "SELECT p_partkey, p_partkey & 12 AS a, p_partkey | 12 AS o, p_partkey ^ 12 AS x, shiftleft(p_partkey, 2) AS l, shiftright(p_partkey, 1) AS r, ~p_partkey AS n FROM {part}", "SELECT p_partkey, p_partkey & 12 AS a, p_partkey | 12 AS o, xor(p_partkey, 12) AS x, p_partkey << 2 AS l, p_partkey >> 1 AS r, ~p_partkey AS n FROM part")
both("p_8_concat", "SELECT p_partkey, p_name || '/' || nullif(p_brand, 'Brand#11') AS r FROM {part}")
both("p_9_is_null", "SELECT p_partkey, nullif(p_size, 3) IS NULL AS a, nullif(p_size, 3) IS NOT NULL AS b FROM {part}")
both("p_10_is_distinct", "SELECT p_partkey, nullif(p_size, 3) IS DISTINCT FROM nullif(p_size, 4) AS a, nullif(p_size, 3) IS NOT DISTINCT FROM NULL AS b FROM {part}")
both("p_11_is_true", "SELECT p_partkey, (nullif(p_size, 3) > 10) IS TRUE AS a, (nullif(p_size, 3) > 10) IS NOT FALSE AS b FROM {part}")
both("p_12_like", "SELECT p_partkey, p_name LIKE 's%l_ %' AS a, p_name NOT LIKE '%ring' AS b, p_name ILIKE 'RED%' AS c FROM {part}")
pair("p_13_regex", "SELECT p_partkey, p_name RLIKE 'r[ie]' AS a, p_name RLIKE '(?i)R[IE]D' AS b FROM {part}", "SELECT p_partkey, regexp_matches(p_name, 'r[ie]') AS a, regexp_matches(p_name, 'R[IE]D', 'i') AS b FROM part")
both("p_14_between", "SELECT p_partkey FROM {part} WHERE p_size BETWEEN 10 AND 20 AND p_size NOT BETWEEN 12 AND 13")
both("p_15_in", "SELECT p_partkey, p_size IN (1, 2, 3) AS a, p_size NOT IN (1, NULL) AS b FROM {part}")
pair("p_16_any_all", "SELECT p_partkey, exists(array(1, 5, 9), x -> p_size = x) AS a, forall(array(1, 5, 9), x -> p_size > x) AS b FROM {part}", "SELECT p_partkey, p_size = ANY([1, 5, 9]) AS a, p_size > ALL(SELECT unnest([1, 5, 9])) AS b FROM part")
both("p_17_case", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 's' WHEN p_size < 30 THEN 'm' END AS a, CASE p_size WHEN 1 THEN 'one' ELSE 'more' END AS b FROM {part}")
both("p_18_coalesce", "SELECT p_partkey, coalesce(nullif(p_brand, 'Brand#11'), p_type) AS r FROM {part}")
pair("p_19_cast", "SELECT p_partkey, CAST(p_retailprice AS INT) AS i, CAST(p_size AS STRING) AS s, CAST('2024-02-29' AS DATE) AS d, CAST('true' AS BOOLEAN) AS b FROM {part}", "SELECT p_partkey, trunc(p_retailprice)::INT AS i, p_size::VARCHAR AS s, DATE '2024-02-29' AS d, true AS b FROM part")
pair("p_20_subscript", "SELECT p_partkey, get(split(p_name, ' '), 0) AS a, get(split(p_name, ' '), 9) AS b, slice(array(p_size, 2, 3), 2, 2) AS c FROM {part}", "SELECT p_partkey, string_split(p_name, ' ')[1] AS a, string_split(p_name, ' ')[10] AS b, [p_size, 2, 3][2:3] AS c FROM part")
pair("p_21_json_arrow", "SELECT event_id, get_json_object(props, '$.k') AS t FROM {events}", "SELECT event_id, props->>'k' AS t FROM events")
pair("p_22_json_path", "SELECT event_id, get_json_object(concat('{{\"a\":', props, '}}'), '$.a.k') AS t FROM {events}", "SELECT event_id, json_extract_string('{\"a\":' || props || '}', '$.a.k') AS t FROM events")
both("p_28_hidden_order", "SELECT o_orderkey FROM {orders} ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey")
both("p_29_vector_filter", "SELECT l_orderkey, l_extendedprice * (1 - l_discount) AS net FROM {lineitem} WHERE l_discount > 0.05 AND l_quantity < 10")
# joins
both("j_1_theta", "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM {nation} a JOIN {nation} b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey")
pair("j_2_hash", "SELECT /*+ SHUFFLE_HASH(c) */ o_orderkey, c_name FROM {orders} o JOIN {customer} c ON o_custkey = c_custkey AND o_totalprice > c_acctbal", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey AND o_totalprice > c_acctbal")
pair("j_3_merge", "SELECT /*+ MERGE(c) */ o_orderkey, c_name FROM {orders} o JOIN {customer} c ON o_custkey = c_custkey", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
both("j_4_index_loop", "SELECT n_name, r_name FROM {nation} JOIN {region} ON n_regionkey = r_regionkey")
both("j_5_grace_hash", "SELECT l_partkey, o_orderdate, l_quantity FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey")
both("j_6_vector_hash", "SELECT p_type, count(*) AS n FROM {lineitem} JOIN {part} ON l_partkey = p_partkey GROUP BY p_type")
both("j_7_broadcast", "SELECT s_name, n_name FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey")
both("j_8_partitioned", "SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM {customer} JOIN {orders} ON c_custkey = o_custkey GROUP BY c_mktsegment")
both("j_9_gathered", "SELECT r_name, count(*) AS n FROM {region} JOIN {nation} ON r_regionkey = n_regionkey GROUP BY r_name")
both("j_10_using", "SELECT doc_id, lang, quality FROM {documents} JOIN {labels} USING (doc_id)")
both("j_10_natural", "SELECT doc_id, lang, toxic FROM {documents} NATURAL JOIN {labels}")
both("j_11_cross", "SELECT r_name, n_name FROM {region} CROSS JOIN {nation}")
pair("j_12_semi", "SELECT doc_id FROM {documents} d LEFT SEMI JOIN {labels} l ON d.doc_id = l.doc_id", "SELECT doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
pair("j_13_anti", "SELECT doc_id FROM {documents} d LEFT ANTI JOIN {labels} l ON d.doc_id = l.doc_id", "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
both("j_13_not_in", "SELECT doc_id FROM {documents} WHERE doc_id NOT IN (SELECT doc_id FROM {labels})")
pair("j_14_semi_syntax", "SELECT c_custkey FROM {customer} LEFT SEMI JOIN {orders} ON c_custkey = o_custkey AND o_totalprice > 400000", "SELECT c_custkey FROM customer SEMI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000")
both("j_15_derived", "SELECT c_name, t.n FROM {customer} JOIN (SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey) t ON c_custkey = t.o_custkey")
both("j_16_self", "SELECT a.conv_id, a.turn, b.role AS next_role FROM {conversations} a JOIN {conversations} b ON a.conv_id = b.conv_id AND a.turn + 1 = b.turn")
both("j_left", "SELECT d.doc_id, l.toxic FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id")
both("j_right", "SELECT d.doc_id, l.quality FROM {labels} l RIGHT JOIN {documents} d ON d.doc_id = l.doc_id")
both("j_full", "SELECT n_name, s_suppkey FROM {nation} FULL JOIN (SELECT * FROM {supplier} WHERE s_nationkey < 20) s ON n_nationkey = s_nationkey")
# subqueries
both("q_1_scalar", "SELECT o_orderkey FROM {orders} WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM {orders})")
both("q_2_correlated", "SELECT p_partkey, (SELECT count(*) FROM {lineitem} WHERE l_partkey = p_partkey) AS n FROM {part}")
both("q_3_in", "SELECT c_custkey FROM {customer} WHERE c_custkey IN (SELECT o_custkey FROM {orders} WHERE o_orderpriority = '1-URGENT')")
both("q_4_exists", "SELECT c_custkey FROM {customer} WHERE EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
both("q_5_with", "WITH a AS (SELECT o_custkey, sum(o_totalprice) AS t FROM {orders} GROUP BY o_custkey), b AS (SELECT avg(t) AS m FROM a) SELECT o_custkey, round(t, 2) AS total FROM a, b WHERE t > m")
both("q_6_recursive", "WITH RECURSIVE t(n, f, g) AS (SELECT CAST(1 AS BIGINT), CAST(0 AS BIGINT), CAST(1 AS BIGINT) UNION ALL SELECT n + 1, g, f + g FROM t WHERE n < 60) SELECT n, f FROM t")
both("q_9_having_subquery", "SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey HAVING count(*) > (SELECT count(*) / count(DISTINCT o_custkey) FROM {orders})")
# aggregates
G = "FROM {lineitem} GROUP BY l_returnflag"
both("a_1_count_star", f"SELECT l_returnflag, count(*) AS n {G}")
both("a_2_count_distinct", f"SELECT l_returnflag, count(nullif(l_discount, 0.05)) AS n, count(DISTINCT l_partkey) AS d {G}")
both("a_3_sum", f"SELECT l_returnflag, round(sum(l_extendedprice), 2) AS s, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS d {G}")
both("a_4_avg", f"SELECT l_returnflag, round(avg(l_quantity), 6) AS a, round(avg(DISTINCT l_quantity), 6) AS d {G}")
both("a_5_min_max", f"SELECT l_returnflag, min(l_shipdate) AS lo, max(l_extendedprice) AS hi {G}")
both("a_6_bool", f"SELECT l_returnflag, bool_and(l_quantity > 0) AS a, bool_or(l_quantity > 49) AS o {G}")
pair("a_7_string_agg", "SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM {nation} GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
pair("a_8_array_agg", "SELECT n_regionkey, array_sort(collect_list(n_nationkey)) AS keys FROM {nation} GROUP BY n_regionkey", "SELECT n_regionkey, list(n_nationkey ORDER BY n_nationkey) AS keys FROM nation GROUP BY n_regionkey")
both("a_9_variance", f"SELECT l_returnflag, round(stddev_pop(l_quantity), 6) AS a, round(stddev_samp(l_quantity), 6) AS b, round(var_pop(l_quantity), 6) AS c, round(var_samp(l_quantity), 6) AS d {G}")
both("a_10_corr", f"SELECT l_returnflag, round(corr(l_extendedprice, l_quantity), 6) AS r {G}")
both("a_11_covar", f"SELECT l_returnflag, round(covar_pop(l_discount, l_quantity), 6) AS a, round(covar_samp(l_discount, l_quantity), 6) AS b {G}")
both("a_12_regr", f"SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS a, round(regr_intercept(l_extendedprice, l_quantity), 3) AS b, round(regr_r2(l_extendedprice, l_quantity), 6) AS c, CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS d, round(regr_avgx(l_extendedprice, l_quantity), 6) AS e, round(regr_avgy(l_extendedprice, l_quantity), 4) AS f, round(regr_sxx(l_tax, l_quantity), 2) AS g, round(regr_syy(l_tax, l_quantity), 4) AS h, round(regr_sxy(l_tax, l_quantity), 4) AS i {G}")
pair("a_13_mode", "SELECT c_nationkey, mode() WITHIN GROUP (ORDER BY c_mktsegment) AS m FROM {customer} GROUP BY c_nationkey", "SELECT c_nationkey, m FROM (SELECT c_nationkey, c_mktsegment AS m, row_number() OVER (PARTITION BY c_nationkey ORDER BY count(*) DESC, c_mktsegment) AS k FROM customer GROUP BY c_nationkey, c_mktsegment) WHERE k = 1")
pair("a_14_percentile_cont", f"SELECT l_returnflag, round(percentile_cont(0.3) WITHIN GROUP (ORDER BY l_extendedprice), 4) AS p {G}", f"SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.3), 4) AS p FROM lineitem GROUP BY l_returnflag")
pair("a_15_percentile_disc", f"SELECT l_returnflag, percentile_disc(0.3) WITHIN GROUP (ORDER BY l_extendedprice) AS p {G}", f"SELECT l_returnflag, quantile_disc(l_extendedprice, 0.3) AS p FROM lineitem GROUP BY l_returnflag")
both("a_16_bits", "SELECT l_returnflag, bit_and(l_orderkey | 3) AS a, bit_or(l_orderkey) AS o, bit_xor(l_orderkey) AS x FROM {lineitem} GROUP BY l_returnflag")
both("a_17_filter", f"SELECT l_returnflag, count(*) FILTER (WHERE l_quantity > 25) AS n, round(sum(l_tax) FILTER (WHERE l_linestatus = 'F'), 4) AS s {G}")
both("a_18_group_expression", "SELECT p_size % 3 AS k, nullif(p_brand, 'Brand#11') AS b, count(*) AS n FROM {part} GROUP BY p_size % 3, nullif(p_brand, 'Brand#11')")
both("a_19_having", "SELECT l_partkey, round(sum(l_quantity), 2) AS q FROM {lineitem} GROUP BY l_partkey HAVING sum(l_quantity) > 800 AND count(*) > 30")
for key, form in (("a_20_grouping_sets", "GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())"), ("a_21_cube", "CUBE (l_returnflag, l_linestatus)"), ("a_22_rollup", "ROLLUP (l_returnflag, l_linestatus)")):
    both(key, f"SELECT l_returnflag, l_linestatus, count(*) AS n FROM {{lineitem}} GROUP BY {form}")
pair("a_23_grouping", "SELECT l_returnflag, l_linestatus, CAST(grouping_id(l_returnflag, l_linestatus) AS BIGINT) AS g, count(*) AS n FROM {lineitem} GROUP BY CUBE (l_returnflag, l_linestatus)", "SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag, l_linestatus) AS BIGINT) AS g, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
both("a_24_fused", "SELECT l_suppkey, count(*) AS n, round(sum(l_quantity), 2) AS s, round(avg(l_discount), 6) AS a, min(l_tax) AS lo, max(l_tax) AS hi FROM {lineitem} GROUP BY l_suppkey")
both("a_25_no_group", "SELECT count(*) AS n, round(sum(l_quantity), 2) AS s, round(avg(l_extendedprice), 4) AS a FROM {lineitem}")
both("a_26_parallel", "SELECT l_orderkey, count(*) AS n FROM {lineitem} GROUP BY l_orderkey")
both("a_27_vector", "SELECT l_linestatus, round(sum(l_extendedprice * (1 - l_discount)), 2) AS net FROM {lineitem} WHERE l_shipdate < TIMESTAMP '1998-01-01 00:00:00' GROUP BY l_linestatus")
both("a_28_two_phase", "SELECT o_orderpriority, round(avg(o_totalprice), 4) AS a, count(DISTINCT o_custkey) AS d FROM {orders} GROUP BY o_orderpriority")
both("a_29_statistics", "SELECT count(*) AS n, count(*) - count(nullif(p_brand, 'Brand#11')) AS nulls, count(DISTINCT p_brand) AS distinct_values, min(p_brand) AS lo, max(p_brand) AS hi FROM {part}")
# windows
O = "(PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"
T = "(PARTITION BY o_orderpriority ORDER BY o_orderdate)"
for key, f in (("w_1_row_number", f"CAST(row_number() OVER {O} AS BIGINT)"), ("w_2_rank", f"CAST(rank() OVER {T} AS BIGINT)"), ("w_3_dense_rank", f"CAST(dense_rank() OVER {T} AS BIGINT)"), ("w_4_ntile", f"CAST(ntile(4) OVER {O} AS BIGINT)"), ("w_5_lag", f"lag(o_totalprice, 2) OVER {O}"), ("w_5_lead", f"lead(o_totalprice) OVER {O}"), ("w_6_first_value", f"first_value(o_orderkey) OVER {O}"), ("w_6_last_value", f"last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)"), ("w_7_nth_value", f"nth_value(o_orderkey, 2) OVER {O}"), ("w_8_percent_rank", f"round(percent_rank() OVER {T}, 9)"), ("w_9_cume_dist", f"round(cume_dist() OVER {T}, 9)"), ("w_10_aggregates", f"round(sum(o_totalprice) OVER {O}, 2)"), ("w_11_partition_expression", "CAST(count(*) OVER (PARTITION BY o_custkey % 10) AS BIGINT)"), ("w_12_rows_frame", "round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 4)"), ("w_13_range_frame", "CAST(count(*) OVER (PARTITION BY o_orderpriority ORDER BY o_custkey RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS BIGINT)"), ("w_15_default_frame", f"CAST(count(*) OVER {T} AS BIGINT)"), ("w_17_sliding", "round(sum(o_totalprice) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 2)")):
    both(key, f"SELECT o_orderkey, {f} AS r FROM {{orders}}")
both("w_16_named", "SELECT o_orderkey, round(sum(o_totalprice) OVER w, 2) AS s, count(*) OVER w AS n FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
# sort, limit, distinct, sets
both("o_1_order_by", "SELECT p_partkey, nullif(p_brand, 'Brand#11') AS b FROM {part} ORDER BY b ASC NULLS LAST, p_partkey DESC")
both("o_2_external_sort", "SELECT l_orderkey, l_extendedprice FROM {lineitem} ORDER BY l_extendedprice, l_orderkey, l_partkey")
both("o_3_limit_offset", "SELECT o_orderkey FROM {orders} ORDER BY o_orderkey LIMIT 15 OFFSET 30")
both("o_4_top_k", "SELECT l_orderkey, l_extendedprice FROM {lineitem} ORDER BY l_extendedprice DESC NULLS FIRST, l_orderkey, l_partkey LIMIT 25")
both("o_5_vector_sort", "SELECT s_suppkey, s_acctbal FROM {supplier} ORDER BY s_acctbal DESC NULLS FIRST")
both("o_6_distinct", "SELECT DISTINCT p_type, p_brand FROM {part}")
both("o_8_merge_gather", "SELECT event_id, ts FROM {events} ORDER BY ts, event_id LIMIT 100")
both("o_10_union_gather", "SELECT * FROM (SELECT c_custkey AS k FROM {customer} UNION SELECT s_suppkey FROM {supplier}) t ORDER BY k LIMIT 40 OFFSET 5")
L, R = "SELECT c_nationkey AS k FROM {customer}", "SELECT s_nationkey AS k FROM {supplier}"
for key, op in (("u_1_union_all", "UNION ALL"), ("u_2_union", "UNION"), ("u_3_intersect", "INTERSECT"), ("u_4_intersect_all", "INTERSECT ALL"), ("u_5_except", "EXCEPT"), ("u_6_except_all", "EXCEPT ALL")):
    both(key, f"{L} {op} {R}")
both("u_7_ordered_chain", f"SELECT * FROM ({L} UNION ALL {R}) t ORDER BY k LIMIT 30")
both("tpch_q1", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge, round(avg(l_quantity), 6) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order FROM {lineitem} WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus")
both("tpch_q3", "SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate FROM {customer} JOIN {orders} ON c_custkey = o_custkey JOIN {lineitem} ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1998-03-15 00:00:00' GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC NULLS FIRST, l_orderkey LIMIT 10")
both("tpch_q5", "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM {customer} JOIN {orders} ON c_custkey = o_custkey JOIN {lineitem} ON l_orderkey = o_orderkey JOIN {supplier} ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY n_name")
both("tpch_q6", "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM {lineitem} WHERE l_shipdate >= TIMESTAMP '1997-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1998-01-01 00:00:00' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24")


def statement(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: sql(spark, sf_dir, STATEMENTS[name][0])


Frame = Callable[[SparkSession, str], DataFrame]
C = "c_custkey, c_acctbal, c_mktsegment"


def _customers(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")


def _new(s: SparkSession, d: str) -> DataFrame:
    """Rows to be put into the customers: every odd supplier key, some beyond the largest customer."""
    return table(s, d, "supplier").select((F.col("s_suppkey") * 40 + 1).alias("c_custkey"), F.col("s_acctbal").alias("c_acctbal"), F.lit("NEW").alias("c_mktsegment"))


_N = "(SELECT s_suppkey * 40 + 1 AS c_custkey, s_acctbal AS c_acctbal, 'NEW' AS c_mktsegment FROM supplier)"


def _log(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").select(F.expr("CASE o_orderstatus WHEN 'F' THEN 'D' WHEN 'O' THEN 'U' ELSE 'I' END").alias("op"), F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").alias("c_acctbal"), F.lit("LOG").alias("c_mktsegment"))


def _checked(s: SparkSession, d: str) -> DataFrame:
    """Rows that keep a rule, and whether those that break it raise."""
    try:
        ch.checked(_customers(s, d), rich=F.col("c_acctbal") >= 0).write.format("noop").mode("overwrite").save()
        raised = False
    except Exception:
        raised = True
    return ch.checked(_customers(s, d).where("c_acctbal >= 0"), rich=F.col("c_acctbal") >= 0).withColumn("raised", F.lit(raised))


FRAMES: dict[str, tuple[Frame, str | None]] = {
    "o_7_distinct_on": (lambda s, d: distinct_on(table(s, d, "orders"), ["o_custkey"], [("o_totalprice", "desc"), "o_orderkey"]).select("o_custkey", "o_orderkey"), "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey"),
    "w_14_groups_frame": (lambda s, d: groups_frame(table(s, d, "part"), ["p_type"], F.col("p_size"), -1, 1, F.sum("p_partkey"), "r").select("p_partkey", "r"), "SELECT p_partkey, CAST(sum(p_partkey) OVER (PARTITION BY p_type ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS r FROM part"),
    "j_asof": (lambda s, d: asof(table(s, d, "events").where("event_type = 'purchase'").select("event_id", "user_id", "ts"), table(s, d, "events").where("event_type = 'view'").select("user_id", F.col("ts").alias("seen"), F.col("value").alias("seen_value")).groupBy("user_id", "seen").agg(F.max("seen_value").alias("seen_value")), ["user_id"], "ts", "seen", ["seen", "seen_value"], slice_seconds=86400).select("event_id", "seen", "seen_value"), "SELECT p.event_id, v.seen, v.seen_value FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT user_id, ts AS seen, max(value) AS seen_value FROM events WHERE event_type = 'view' GROUP BY user_id, ts) v ON p.user_id = v.user_id AND p.ts >= v.seen"),
    "j_range": (lambda s, d: range_join(table(s, d, "part").select("p_partkey", F.col("p_retailprice").alias("price")), table(s, d, "supplier").select("s_suppkey", F.expr("s_acctbal").alias("lo"), F.expr("s_acctbal + 25").alias("hi")), "price", "lo", "hi", 25.0, 25.0).select("p_partkey", "s_suppkey"), "SELECT p_partkey, s_suppkey FROM part JOIN supplier ON p_retailprice >= s_acctbal AND p_retailprice < s_acctbal + 25"),
    "j_17_update_from": (lambda s, d: ch.update_from(_customers(s, d), _new(s, d), ["c_custkey"], {"c_acctbal": "c_acctbal"}), f"SELECT c.c_custkey, coalesce(n.c_acctbal, c.c_acctbal) AS c_acctbal, c.c_mktsegment FROM customer c LEFT JOIN {_N} n ON c.c_custkey = n.c_custkey"),
    "j_17_delete_using": (lambda s, d: ch.delete_using(_customers(s, d), _new(s, d), ["c_custkey"]), f"SELECT {C} FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM {_N})"),
    "j_18_merge": (lambda s, d: ch.merge(_customers(s, d), _new(s, d), ["c_custkey"], {"c_acctbal": "t.c_acctbal + s.c_acctbal"}, "s.c_acctbal < 2000"), f"SELECT coalesce(c.c_custkey, n.c_custkey) AS c_custkey, CASE WHEN n.c_custkey IS NULL THEN c.c_acctbal WHEN c.c_custkey IS NULL THEN n.c_acctbal ELSE c.c_acctbal + n.c_acctbal END AS c_acctbal, coalesce(c.c_mktsegment, n.c_mktsegment) AS c_mktsegment FROM customer c FULL JOIN {_N} n ON c.c_custkey = n.c_custkey WHERE NOT coalesce(c.c_custkey IS NOT NULL AND n.c_acctbal < 2000, false)"),
    "d_9_do_nothing": (lambda s, d: ch.insert_or_ignore(_customers(s, d), _new(s, d), ["c_custkey"]), f"SELECT {C} FROM customer UNION ALL SELECT * FROM {_N} WHERE c_custkey NOT IN (SELECT c_custkey FROM customer)"),
    "d_9_do_update": (lambda s, d: ch.upsert(_customers(s, d), _new(s, d), ["c_custkey"], {"c_acctbal": "excluded.c_acctbal"}), f"SELECT coalesce(c.c_custkey, n.c_custkey) AS c_custkey, coalesce(n.c_acctbal, c.c_acctbal) AS c_acctbal, coalesce(c.c_mktsegment, n.c_mktsegment) AS c_mktsegment FROM customer c FULL JOIN {_N} n ON c.c_custkey = n.c_custkey"),
    "d_10_update": (lambda s, d: ch.update(_customers(s, d), F.col("c_acctbal") < 1000, {"c_mktsegment": F.lit("LOW"), "c_acctbal": F.col("c_acctbal") + 1}), "SELECT c_custkey, CASE WHEN c_acctbal < 1000 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_acctbal < 1000 THEN 'LOW' ELSE c_mktsegment END AS c_mktsegment FROM customer"),
    "d_11_delete": (lambda s, d: ch.delete(_customers(s, d), F.expr("nullif(c_mktsegment, 'BUILDING') = 'MACHINERY'")), f"SELECT {C} FROM customer WHERE c_mktsegment <> 'MACHINERY'"),
    "d_12_cascade": (lambda s, d: ch.delete_parent(_customers(s, d).withColumn("nation", F.col("c_custkey") % 25), table(s, d, "nation").where("n_regionkey = 1"), "nation", "n_nationkey", "cascade"), f"SELECT {C}, c_custkey % 25 AS nation FROM customer WHERE c_custkey % 25 NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)"),
    "d_12_set_null": (lambda s, d: ch.delete_parent(_customers(s, d).withColumn("nation", F.col("c_custkey") % 25), table(s, d, "nation").where("n_regionkey = 1"), "nation", "n_nationkey", "set null"), f"SELECT {C}, CASE WHEN c_custkey % 25 IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) THEN NULL ELSE c_custkey % 25 END AS nation FROM customer"),
    "d_13_check": (_checked, f"SELECT {C}, (SELECT count(*) FROM customer WHERE c_acctbal < 0) > 0 AS raised FROM customer WHERE c_acctbal >= 0"),
    "d_2_unique": (lambda s, d: ch.duplicates(table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"]), "SELECT l_orderkey, l_linenumber, count(*) AS count FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1"),
    "d_2_foreign": (lambda s, d: ch.orphans(table(s, d, "documents").select("doc_id"), table(s, d, "labels"), "doc_id", "doc_id"), "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"),
    "t_1_change_log": (lambda s, d: ch.apply_changes(_customers(s, d), _log(s, d), ["c_custkey"]), f"WITH l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS k FROM orders) WHERE k = 1) SELECT {C} FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM l) UNION ALL SELECT o_custkey, o_totalprice, 'LOG' FROM l WHERE o_orderstatus <> 'F'"),
    "p_26_parameters": (lambda s, d: sql(s, d, "SELECT o_orderkey FROM {orders} WHERE o_custkey = :who AND o_totalprice > :least", {"who": 77, "least": 1000}), "SELECT o_orderkey FROM orders WHERE o_custkey = 77 AND o_totalprice > 1000"),
    "p_27_sequence": (lambda s, d: Sequence(100).number(table(s, d, "nation").select("n_nationkey"), [F.col("n_nationkey")]), "SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) + 99 AS id FROM nation"),
    "d_4_alter": (lambda s, d: table(s, d, "supplier").withColumnRenamed("s_name", "title").withColumn("s_acctbal", F.col("s_acctbal").cast("int")).drop("s_nationkey").withColumn("note", F.lit("none")), "SELECT s_suppkey, s_name AS title, trunc(s_acctbal)::INT AS s_acctbal, 'none' AS note FROM supplier"),
    "x_window_counts": (lambda s, d: table(s, d, "events").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n"), "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2"),
}


def queries() -> dict[str, Frame]:
    return {name: statement(name) for name in STATEMENTS} | {name: f for name, (f, _) in FRAMES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q for name, (_, q) in STATEMENTS.items()} | {name: q for name, (_, q) in FRAMES.items() if q}
