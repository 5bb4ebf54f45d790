"""A query for each scalar function over whole tables, with its DuckDB statement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import json_udf
from tessera.functions import text as fn
from tessera.functions.vectors import STOP
from tessera.session import sql, table

#: name -> (table, key columns, Spark expression, DuckDB expression or None)
SPECS: dict[str, tuple[str, str, str, str | None]] = {}


def add(name: str, frm: str, spark: str, duck: str | None) -> None:
    keys = {"part": "p_partkey", "customer": "c_custkey", "events": "event_id", "orders": "o_orderkey", "lineitem": "l_orderkey, l_partkey, l_linenumber", "embeddings": "vec_id", "documents": "doc_id", "pages": "page_id", "supplier": "s_suppkey", "nation": "n_nationkey"}
    SPECS[name] = (frm, keys[frm], spark, duck)


B = "nullif(p_brand, 'Brand#11')"  # NULL for one brand
for name, frm, spark, duck in [
    ("ss_1_upper", "part", fn("upper", "p_name"), "upper(p_name)"),
    ("ss_2_lower", "customer", fn("lower", "c_name"), "lower(c_name)"),
    ("ss_3_length", "documents", f"CAST({fn('length', 'text')} AS BIGINT)", "length(text)"),
    ("ss_4_substr", "part", fn("substr", "p_name", "p_size - 3", "5"), "substr(p_name, greatest(p_size - 3, 1), 5)"),
    ("ss_5_concat", "part", fn("concat", B, "p_type", "NULL"), f"concat({B}, p_type, NULL)"),
    ("ss_6_concat_ws", "part", fn("concat_ws", "'-'", B, "p_type"), f"concat_ws('-', {B}, p_type)"),
    ("ss_7_trim", "part", fn("trim", r"concat(' \t', p_name, '\n ')"), r"regexp_replace(' ' || chr(9) || p_name || chr(10) || ' ', '^\s+|\s+$', '', 'g')"),
    ("ss_8_btrim", "part", fn("btrim", "p_name", "'sadr'"), "trim(p_name, 'sadr')"),
    ("ss_9_ltrim", "part", fn("ltrim", "p_name", "'sadr'"), "ltrim(p_name, 'sadr')"),
    ("ss_10_rtrim", "part", fn("rtrim", "p_name", "'gtek'"), "rtrim(p_name, 'gtek')"),
    ("ss_11_replace", "documents", f"md5({fn('replace', 'text', chr(39) + 'th' + chr(39), chr(39) + 'TH' + chr(39))})", "md5(replace(text, 'th', 'TH'))"),
    ("ss_12_strpos", "documents", fn("strpos", "text", "'the'"), "strpos(text, 'the')"),
    ("ss_13_lpad", "part", fn("lpad", "p_name", "12", "'*#'"), "lpad(p_name, 12, '*#')"),
    ("ss_14_rpad", "part", fn("rpad", "p_name", "12", "'*#'"), "rpad(p_name, 12, '*#')"),
    ("ss_15_left", "part", fn("left", "p_name", "3"), "left(p_name, 3)"),
    ("ss_16_right", "part", fn("right", "p_name", "3"), "right(p_name, 3)"),
    ("ss_17_repeat", "part", fn("repeat", "p_brand", "2"), "repeat(p_brand, 2)"),
    ("ss_18_reverse", "documents", f"md5({fn('reverse', 'text')})", "md5(array_to_string(list_reverse(string_split(text, '')), ''))"),
    ("ss_19_initcap", "part", fn("initcap", "replace(p_name, ' ', '-')"), "array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), '-')"),
    ("ss_20_translate", "part", fn("translate", "p_name", "'aeiou'", "'AE'"), "translate(p_name, 'aeiou', 'AE')"),
    ("ss_21_split_part", "part", fn("split_part", "p_name", "' '", "p_size % 4"), "CASE WHEN p_size % 4 = 0 THEN '' ELSE split_part(p_name, ' ', p_size % 4) END"),
    ("ss_22_overlay", "part", fn("overlay", "p_name", "'XY'", "3"), "left(p_name, 2) || 'XY' || substr(p_name, 5)"),
    ("ss_23_starts_with", "part", fn("starts_with", "p_name", "'s'"), "starts_with(p_name, 's')"),
    ("ss_24_ends_with", "part", fn("ends_with", "p_name", "'t'"), "ends_with(p_name, 't')"),
    ("ss_25_chr", "part", fn("chr", "200 + p_size"), "chr(200 + p_size)"),
    ("ss_26_ascii", "documents", f"CAST({fn('ascii', 'text')} AS BIGINT)", "CAST(CASE WHEN text = '' THEN 0 ELSE unicode(text) END AS BIGINT)"),
    ("ss_27_quote_literal", "part", fn("quote_literal", "replace(p_name, 'r', '''')"), "'''' || replace(replace(p_name, 'r', ''''), '''', '''''') || ''''"),
    ("ss_28_quote_ident", "part", fn("quote_ident", "replace(p_name, 'r', '\"')"), "'\"' || replace(replace(p_name, 'r', '\"'), '\"', '\"\"') || '\"'"),
    ("ss_29_quote_nullable", "part", fn("quote_nullable", B), f"coalesce('''' || replace({B}, '''', '''''') || '''', 'NULL')"),
    ("ss_30_bit_length", "documents", f"CAST({fn('bit_length', 'text')} AS BIGINT)", "bit_length(text)"),
    ("ss_31_octet_length", "documents", f"CAST({fn('octet_length', 'text')} AS BIGINT)", "strlen(text)"),
    ("ss_32_format", "part", fn("format", "'%1 is %2, %s'", "p_name", "p_brand"), "p_name || ' is ' || p_brand || ', ' || p_name"),
    ("ss_33_substr_count", "documents", fn("substr_count", "text", "'the'"), "(length(text) - length(replace(text, 'the', ''))) // 3"),
    ("ss_34_normalize", "part", fn("normalize", "p_name"), "p_name"),
    ("ss_35_parse_ident", "part", fn("parse_ident", "concat('\"', p_type, '\". ', p_brand)"), "[p_type, p_brand]"),
    # numbers
    ("sm_1_abs", "customer", fn("abs", "c_acctbal"), "abs(c_acctbal)"),
    ("sm_2_round", "customer", fn("round", "c_acctbal"), "round(c_acctbal)"),
    ("sm_3_ceil", "customer", fn("ceil", "c_acctbal"), "CAST(ceil(c_acctbal) AS DOUBLE)"),
    ("sm_4_ceiling", "supplier", fn("ceiling", "s_acctbal"), "CAST(ceil(s_acctbal) AS DOUBLE)"),
    ("sm_5_floor", "customer", fn("floor", "c_acctbal"), "CAST(floor(c_acctbal) AS DOUBLE)"),
    ("sm_6_power", "part", f"round({fn('power', 'p_size', '3')}, 6)", "round(power(p_size, 3), 6)"),
    ("sm_7_sqrt", "part", f"round({fn('sqrt', 'p_retailprice')}, 6)", "round(sqrt(p_retailprice), 6)"),
    ("sm_8_sign", "customer", f"CAST({fn('sign', 'c_acctbal')} AS BIGINT)", "CAST(sign(c_acctbal) AS BIGINT)"),
    ("sm_9_trunc", "customer", f"round({fn('trunc', 'c_acctbal', '1')}, 6)", "round(trunc(c_acctbal * 10) / 10, 6)"),
    ("sm_10_ln", "part", f"round({fn('ln', 'p_retailprice')}, 6)", "round(ln(p_retailprice), 6)"),
    ("sm_11_log", "part", f"round({fn('log', 'p_retailprice')} + {fn('log', '2', 'p_retailprice')}, 6)", "round(log10(p_retailprice) + log2(p_retailprice), 6)"),
    ("sm_12_exp", "part", f"round({fn('exp', 'p_size / 50')}, 6)", "round(exp(p_size / 50), 6)"),
    ("sm_13_pi", "nation", f"round({fn('pi')}, 9)", "round(pi(), 9)"),
    ("sm_14_mod", "part", f"CAST({fn('mod', '25 - p_size', '7')} AS BIGINT)", "(25 - p_size) % 7"),
    ("sm_17_greatest", "part", fn("greatest", "p_size", "NULL", "25"), "greatest(p_size, NULL, 25)"),
    ("sm_18_least", "part", fn("least", "p_size", "NULL", "25"), "least(p_size, NULL, 25)"),
    ("sm_19_cbrt", "part", f"round({fn('cbrt', 'p_retailprice')}, 6)", "round(cbrt(p_retailprice), 6)"),
    ("sm_20_factorial", "part", fn("factorial", "p_size % 21"), "CAST(factorial(CAST(p_size % 21 AS INT)) AS BIGINT)"),
    ("sm_21_gcd", "part", fn("gcd", "p_size", "p_partkey"), "CAST(gcd(p_size, p_partkey) AS BIGINT)"),
    ("sm_22_lcm", "part", fn("lcm", "CAST(p_size AS BIGINT)", "p_partkey"), "CAST(lcm(p_size, p_partkey) AS BIGINT)"),
    ("sm_29_atan2", "part", f"round({fn('atan2', 'p_size', '10')}, 6)", "round(atan2(p_size, 10), 6)"),
    ("sm_39_width_bucket", "part", fn("width_bucket", "p_size", "10", "40", "6"), "CASE WHEN p_size < 10 THEN 0 WHEN p_size >= 40 THEN 7 ELSE CAST(floor((p_size - 10) / 5.0) AS BIGINT) + 1 END"),
    ("sm_40_div", "part", f"CAST({fn('div', '25 - p_size', '7')} AS BIGINT)", "CAST(trunc((25 - p_size) / 7) AS BIGINT)"),
    ("sm_41_scale", "lineitem", f"CAST({fn('scale', 'CAST(l_quantity AS DECIMAL(12,2))')} AS BIGINT)", "2"),
    ("sm_42_isfinite", "customer", fn("isfinite", "c_acctbal"), "isfinite(c_acctbal)"),
    ("sm_43_isinf", "customer", fn("isinf", "c_acctbal"), "isinf(c_acctbal)"),
    ("sm_44_isnan", "customer", fn("isnan", "nullif(c_acctbal, c_acctbal)"), "CAST(NULL AS BOOLEAN)"),
    ("sm_45_trim_scale", "customer", fn("trim_scale", "c_acctbal"), "c_acctbal"),
    ("sm_46_min_scale", "part", f"CAST({fn('min_scale', 'CAST(p_size AS DECIMAL(10,4)) / 4')} AS BIGINT)", "CASE p_size % 4 WHEN 0 THEN 0 WHEN 2 THEN 1 ELSE 2 END"),
    ("sm_47_trunc_precision", "customer", f"round({fn('trunc_precision', 'c_acctbal', '1')}, 6)", "round(trunc(c_acctbal * 10) / 10, 6)"),
    ("sm_48_round_precision", "lineitem", f"round({fn('round_precision', 'l_extendedprice', '1')}, 1)", "round(l_extendedprice, 1)"),
    ("sm_49_clamp", "customer", fn("clamp", "c_acctbal", "0", "5000"), "CAST(least(greatest(c_acctbal, 0), 5000) AS DOUBLE)"),
    # date and time
    ("sd_4_extract", "events", " + ".join(f"{fn('extract', f, 'ts')} * {10**k}" for k, f in enumerate(("year", "month", "day", "hour", "minute", "second", "dow", "doy"))) + f" + {fn('extract', 'epoch', 'ts')}", " + ".join(f"CAST(floor(extract({f} FROM ts)) AS BIGINT) * {10**k}" for k, f in enumerate(("year", "month", "day", "hour", "minute", "second", "dow", "doy"))) + " + CAST(floor(epoch(ts)) AS BIGINT)"),
    ("sd_5_date_trunc", "events", fn("date_trunc", "'hour'", "ts"), "date_trunc('hour', ts)"),
    ("sd_6_to_char", "events", fn("to_char", "ts", "'YYYY-MM-DD HH24:MI:SS Mon Dy'"), "strftime(ts, '%Y-%m-%d %H:%M:%S %b %a')"),
    ("sd_7_age", "orders", fn("age", "TIMESTAMP_NTZ '2002-01-01 00:00:00'", "o_orderdate"), "CAST((epoch_us(TIMESTAMP '2002-01-01') - epoch_us(o_orderdate)) // 86400000000 // 365 AS VARCHAR) || ' years ' || CAST((epoch_us(TIMESTAMP '2002-01-01') - epoch_us(o_orderdate)) // 86400000000 % 365 // 30 AS VARCHAR) || ' mons ' || CAST((epoch_us(TIMESTAMP '2002-01-01') - epoch_us(o_orderdate)) // 86400000000 % 365 % 30 AS VARCHAR) || ' days 00:00:00'"),
    ("sd_8_make_date", "part", fn("make_date", "2000 + p_size", "p_size % 12 + 1", "p_size % 28 + 1"), "make_date(2000 + p_size, p_size % 12 + 1, p_size % 28 + 1)"),
    ("sd_9_make_timestamp", "part", fn("make_timestamp", "2000 + p_size", "p_size % 12 + 1", "p_size % 28 + 1", "p_size % 24", "p_size % 60", "p_size + 0.75"), "make_timestamp(2000 + p_size, p_size % 12 + 1, p_size % 28 + 1, p_size % 24, p_size % 60, CAST(p_size AS DOUBLE))"),
    ("sd_10_to_timestamp", "events", fn("to_timestamp", "1700000000 + event_id + 0.5"), "make_timestamp((1700000000 + event_id) * 1000000 + 500000)"),
    ("sd_14_to_date", "orders", fn("to_date", "date_format(o_orderdate, 'dd-MM-yyyy')"), "CAST(o_orderdate AS DATE)"),
    ("sd_15_date_add", "orders", fn("date_add", "o_orderdate", "45"), "o_orderdate + INTERVAL 45 DAY"),
    ("sd_16_date_subtract", "orders", fn("date_subtract", "o_orderdate", "45"), "o_orderdate - INTERVAL 45 DAY"),
    ("sd_17_date_diff", "events", fn("date_diff", "TIMESTAMP_NTZ '2024-01-15 12:00:00'", "ts"), "CAST(trunc((epoch_us(TIMESTAMP '2024-01-15 12:00:00') - epoch_us(ts)) / 86400000000.0) AS BIGINT)"),
    ("sd_18_extract_epoch", "events", f"round({fn('extract_epoch', 'ts')}, 3)", "round(epoch_us(ts) / 1000000.0, 3)"),
    ("sd_19_make_interval", "part", fn("make_interval", "p_size % 3", "p_size % 2", "p_size", "1", "2", "3"), "concat_ws(' ', CASE p_size % 3 WHEN 0 THEN NULL WHEN 1 THEN '1 year' ELSE '2 years' END, CASE p_size % 2 WHEN 0 THEN NULL ELSE '1 mon' END, CASE p_size WHEN 0 THEN NULL WHEN 1 THEN '1 day' ELSE p_size || ' days' END, '01:02:03')"),
]:
    add(name, frm, spark, duck)
for name, number, x in [("degrees", 15, "p_size"), ("radians", 16, "p_size"), ("sin", 23, "p_size"), ("cos", 24, "p_size"), ("tan", 25, "p_size"), ("asin", 26, "p_size / 100"), ("acos", 27, "p_size / 100"), ("atan", 28, "p_size"), ("log10", 30, "p_retailprice"), ("log2", 31, "p_retailprice"), ("cot", 32, "p_size"), ("sinh", 33, "p_size / 10"), ("cosh", 34, "p_size / 10"), ("tanh", 35, "p_size / 10"), ("asinh", 36, "p_size"), ("acosh", 37, "p_size + 1"), ("atanh", 38, "p_size / 100")]:
    add(f"sm_{number}_{name}", "part", f"round({fn(name, x)}, 6)", f"round({name}({x}), 6)")
A = "array(p_size, p_size % 5, 3, p_size, 7)"
D = "[p_size, p_size % 5, 3, p_size, 7]"
N = "array(p_size, nullif(p_size % 5, 2), 3)"
M = "[p_size, nullif(p_size % 5, 2), 3]"
W = "array('red', p_brand, 'red', p_type)"
V = "['red', p_brand, 'red', p_type]"
E, G = "embedding", "CAST(embedding AS DOUBLE[])"
for name, spark, duck in [
    ("1_array_length", fn("array_length", A), f"len({D})"), ("2_cardinality", fn("cardinality", A), f"len({D})"), ("3_array_position", f"CAST({fn('array_position', A, '3')} AS BIGINT)", f"CAST(list_position({D}, 3) AS BIGINT)"),
    ("4_array_positions", fn("array_positions", A, "3"), f"list_filter(list_transform({D}, lambda e, i: CASE WHEN e = 3 THEN CAST(i AS BIGINT) END), lambda x: x IS NOT NULL)"), ("5_array_append", fn("array_append", A, "9"), f"list_append({D}, 9)"),
    ("6_array_prepend", fn("array_prepend", "9", A), f"list_prepend(9, {D})"), ("7_array_remove", fn("array_remove", A, "3"), f"list_filter({D}, lambda x: x <> 3)"), ("8_array_replace", fn("array_replace", A, "3", "33"), f"list_transform({D}, lambda x: CASE WHEN x = 3 THEN 33 ELSE x END)"),
    ("9_array_cat", fn("array_cat", A, "array(1, 2)"), f"list_concat({D}, [1, 2])"), ("10_array_to_string", fn("array_to_string", W, "'/'"), f"array_to_string({V}, '/')"), ("11_string_to_array", fn("string_to_array", "p_name", "' '"), "string_split(p_name, ' ')"),
    ("12_array_upper", fn("array_upper", A, "1"), f"len({D})"), ("13_array_lower", fn("array_lower", A, "1"), "CAST(1 AS BIGINT)"), ("14_array_dims", fn("array_dims", A), "'[1:5]'"), ("15_array_fill", fn("array_fill", "p_size", "3"), "[p_size, p_size, p_size]"),
    ("16_array_reverse", fn("array_reverse", A), f"list_reverse({D})"), ("17_array_distinct", fn("array_sort", fn("array_distinct", A)), f"list_sort(list_distinct({D}))"), ("18_array_sort", fn("array_sort", N), f"list_sort({M}, 'ASC', 'NULLS LAST')"),
    ("19_array_contains", fn("array_contains", A, "4"), f"list_contains({D}, 4)"), ("20_array_overlap", fn("array_overlap", A, "array(1, 2)"), f"list_has_any({D}, [1, 2])"), ("21_array_slice", fn("array_slice", A, "2", "4"), f"{D}[2:4]"),
    ("22_array_ndims", fn("array_ndims", f"array({A})"), "CAST(2 AS BIGINT)"), ("23_unnest_text", fn("unnest", W), f"array_to_string({V}, chr(10))"), ("24_string_to_table", fn("string_to_table", "p_name", "' '"), "string_split(p_name, ' ')"),
    ("25_array_to_json", fn("array_to_json", A), f"CAST(to_json({D}) AS VARCHAR)"), ("26_array_generate", fn("array_generate", "p_size", "p_size + 6", "2"), "generate_series(p_size, p_size + 6, 2)"), ("29_array_intersect", fn("array_intersect", A, "array(3, 4)"), f"list_filter({D}, lambda x: list_contains([3, 4], x))"),
    ("30_array_except", fn("array_except", A, "array(3, 4)"), f"list_filter({D}, lambda x: NOT list_contains([3, 4], x))"), ("31_array_compact", fn("array_compact", N), f"list_filter({M}, lambda x: x IS NOT NULL)"), ("32_array_flatten", fn("array_flatten", f"array({A}, {A})"), f"flatten([{D}, {D}])"),
    ("33_array_repeat", fn("array_repeat", "p_size", "2"), "[p_size, p_size]"), ("34_array_rotate", fn("array_rotate", A, "2"), f"list_concat({D}[3:], {D}[:2])"), ("35_array_to_set", fn("array_sort", fn("array_to_set", A)), f"list_sort(list_distinct({D}))"),
    ("36_array_zip", fn("array_zip", A, "array(1, 2)"), f"list_transform({D}, lambda x, i: [x, [1, 2][i]])"), ("37_array_min", fn("array_min", A), f"CAST(list_min({D}) AS DOUBLE)"), ("38_array_max", fn("array_max", A), f"CAST(list_max({D}) AS DOUBLE)"),
    ("39_array_sum", fn("array_sum", A), f"CAST(list_sum({D}) AS DOUBLE)"), ("40_array_avg", f"round({fn('array_avg', A)}, 6)", f"round(list_avg({D}), 6)"), ("41_array_every", fn("array_every", "array(p_size > 2, p_size < 40)"), "p_size > 2 AND p_size < 40"),
    ("42_array_some", fn("array_some", "array(p_size < 2, p_size > 40)"), "p_size < 2 OR p_size > 40"), ("43_overlay_array", fn("overlay_array", A, "array(100, 200)", "2"), f"list_concat({D}[:1], [100, 200], {D}[4:])"),
]:
    add(f"sa_{name}", "part", spark, duck)


def _sounds(x: str) -> str:
    """Soundex in DuckDB: each letter's code unless it is none or that of the letter before."""
    letters = f"regexp_replace(upper({x}), '[^A-Z]', '', 'g')"
    code = lambda i: f"substr(translate({letters}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '01230120022455012623010202'), {i}, 1)"
    return f"CASE WHEN {letters} = '' THEN '' ELSE rpad(left({letters}, 1) || array_to_string(list_transform(list_filter(range(2, length({letters}) + 1), lambda i: {code('i')} <> '0' AND {code('i')} <> {code('i - 1')})[:3], lambda i: {code('i')}), ''), 4, '0') END"


for name, frm, spark, duck in [
    ("sr_1_regexp_replace", "part", fn("regexp_replace", "p_name", "'([aeiou])'", "'<$1>'"), r"regexp_replace(p_name, '([aeiou])', '<\1>')"), ("sr_1_regexp_replace_all", "documents", f"md5({fn('regexp_replace', 'text', chr(39) + '[aeiou]+' + chr(39), chr(39) + '#' + chr(39), chr(39) + 'g' + chr(39))})", "md5(regexp_replace(text, '[aeiou]+', '#', 'g'))"),
    ("sr_2_regexp_match", "part", fn("regexp_match", "p_brand", "'(Brand)#([0-9]+)'"), "[regexp_extract(p_brand, '(Brand)#([0-9]+)', 1), regexp_extract(p_brand, '(Brand)#([0-9]+)', 2)]"), ("sr_3_regexp_count", "documents", fn("regexp_count", "text", "'th[aeiou]'"), "len(regexp_extract_all(text, 'th[aeiou]'))"),
    ("sr_4_regexp_substr", "documents", fn("regexp_substr", "text", "'[0-9]+'"), "nullif(regexp_extract(text, '[0-9]+'), '')"), ("sr_5_regexp_split", "part", fn("regexp_split_to_array", "p_name", "'[ aeiou]'"), "regexp_split_to_array(p_name, '[ aeiou]')"),
    ("sr_6_regexp_instr", "part", fn("regexp_instr", "p_name", "'[aeiou]'"), "CASE WHEN regexp_matches(p_name, '[aeiou]') THEN strpos(p_name, regexp_extract(p_name, '[aeiou]')) ELSE 0 END"), ("sr_7_regexp_like", "documents", fn("regexp_like", "text", "'[0-9]{4}'"), "regexp_matches(text, '[0-9]{4}')"),
    ("sr_8_regexp_escape", "part", fn("regexp_escape", "concat(p_name, '.*(', p_brand)"), r"p_name || '\.\*\(' || p_brand"),
    ("sc_1_md5", "documents", fn("md5", "text"), "md5(text)"), ("sc_2_sha256", "documents", fn("sha256", "text"), "sha256(text)"), ("sc_3_encode", "part", f"concat({fn('encode', 'p_name', chr(39) + 'hex' + chr(39))}, {fn('encode', 'p_name', chr(39) + 'base64' + chr(39))})", "lower(hex(p_name)) || base64(encode(p_name))"),
    ("sc_4_decode", "part", fn("decode", "lower(hex(p_name))", "'hex'"), "p_name"), ("sc_5_to_hex", "events", fn("to_hex", "event_id"), "lower(to_hex(event_id))"), ("sc_6_hashtext", "part", fn("hashtext", "p_name"), None), ("sc_7_crc32", "part", fn("crc32", "p_name"), "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(p_name, ''), lambda h: CAST(ascii(h) AS BIGINT))), lambda c, b: list_reduce(list_prepend(xor(c, b), CAST(range(8) AS BIGINT[])), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"),
    ("sc_8_bit_xor", "part", f"CAST({fn('bit_xor', 'p_size', '5')} AS BIGINT)", "CAST(xor(p_size, 5) AS BIGINT)"), ("sc_9_bit_and", "part", f"CAST({fn('bit_and_func', 'p_size', '5')} AS BIGINT)", "CAST(p_size & 5 AS BIGINT)"), ("sc_10_bit_or", "part", f"CAST({fn('bit_or_func', 'p_size', '5')} AS BIGINT)", "CAST(p_size | 5 AS BIGINT)"),
    ("sc_11_bit_count", "part", fn("bit_count", "p_partkey"), "CAST(bit_count(p_partkey) AS BIGINT)"), ("sc_12_bit_not", "part", f"CAST({fn('bit_not', 'p_size')} AS BIGINT)", "CAST(~p_size AS BIGINT)"),
    ("su_1_typeof", "part", f"concat_ws(',', {fn('pg_typeof', 'p_size')}, {fn('pg_typeof', 'p_partkey')}, {fn('pg_typeof', 'p_name')}, {fn('pg_typeof', 'p_retailprice')}, {fn('pg_typeof', 'NULL')})", "'integer,bigint,text,double precision,unknown'"),
    ("su_2_to_number", "part", fn("to_number", "concat('$', p_size, ',000.5')"), "CAST(p_size AS DOUBLE) * 1000 + 0.5"), ("su_5_num_nonnulls", "part", fn("num_nonnulls", B, "p_name", "NULL"), f"CAST(({B} IS NOT NULL)::INT + 1 AS BIGINT)"), ("su_6_num_nulls", "part", fn("num_nulls", B, "p_name", "NULL"), f"CAST(({B} IS NULL)::INT + 1 AS BIGINT)"),
    ("sf_1_levenshtein", "part", fn("levenshtein", "p_name", "p_type"), "CAST(levenshtein(p_name, p_type) AS BIGINT)"), ("sf_2_soundex", "part", fn("soundex", "p_name"), _sounds("p_name")), ("sf_3_difference", "part", fn("difference", "p_name", "p_type"), f"CAST(len(list_filter(range(1, 5), lambda k: substr({_sounds('p_name')}, k, 1) = substr({_sounds('p_type')}, k, 1))) AS BIGINT)"),
    ("sf_4_similarity", "part", f"round({fn('similarity', 'p_name', chr(39) + 'red ring' + chr(39))}, 6)", "round(len(list_intersect(list_distinct(list_transform(range(1, length('  ' || lower(p_name) || ' ') - 1), lambda i: substr('  ' || lower(p_name) || ' ', i, 3))), list_transform(range(1, 10), lambda i: substr('  red ring ', i, 3))))::DOUBLE / len(list_distinct(list_concat(list_transform(range(1, length('  ' || lower(p_name) || ' ') - 1), lambda i: substr('  ' || lower(p_name) || ' ', i, 3)), list_transform(range(1, 10), lambda i: substr('  red ring ', i, 3))))), 6)"),
    ("sf_5_hamming", "part", fn("hamming_distance", "p_name", "p_type"), "CAST(len(list_filter(range(1, greatest(length(p_name), length(p_type)) + 1), lambda i: substr(p_name, i, 1) <> substr(p_type, i, 1))) AS BIGINT)"),
    ("sj_1_build_object", "part", fn("jsonb_build_object", "'b'", "p_brand", "'a'", "p_size"), "CAST(json_object('a', p_size, 'b', p_brand) AS VARCHAR)"), ("sj_2_build_array", "part", fn("jsonb_build_array", "p_size", "7"), "CAST(json_array(p_size, 7) AS VARCHAR)"),
    ("sj_3_typeof", "events", fn("jsonb_typeof", "props"), "lower(json_type(props))"), ("sj_4_array_length", "part", fn("jsonb_array_length", f"to_json({A})"), "CAST(5 AS BIGINT)"), ("sj_5_extract_path", "events", fn("jsonb_extract_path", "props", "'k'"), "CAST(props->'k' AS VARCHAR)"),
    ("sj_6_extract_path_text", "events", fn("jsonb_extract_path_text", "props", "'k'"), "props->>'k'"), ("sj_7_object_keys", "events", fn("jsonb_object_keys", "props"), "list_sort(json_keys(props))"), ("sj_11_to_jsonb", "part", fn("to_jsonb", A), f"CAST(to_json({D}) AS VARCHAR)"),
    ("sj_14_delete_key", "events", fn("jsonb_delete_key", "concat('{\"a\":', event_id, ',\"z\":', props, '}')", "CASE event_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'z' ELSE 'none' END"), "CASE event_id % 3 WHEN 0 THEN '{\"z\":{\"k\":' || (props->>'k') || '}}' WHEN 1 THEN '{\"a\":' || event_id || '}' ELSE '{\"a\":' || event_id || ',\"z\":{\"k\":' || (props->>'k') || '}}' END"), ("sj_16_populate_record", "events", f"{fn('jsonb_populate_record', 'props', chr(39) + 'k BIGINT' + chr(39))}.k", "CAST(props->>'k' AS BIGINT)"), ("sj_17_array_elements", "part", fn("jsonb_array_elements", f"to_json({A})"), f"list_transform({D}, lambda x: CAST(x AS VARCHAR))"),
    ("sj_18_array_elements_text", "part", fn("jsonb_array_elements_text", f"to_json({W})"), V), ("sj_19_each", "events", fn("jsonb_each", "props"), "['k', props->>'k']"), ("sj_20_each_text", "events", fn("jsonb_each_text", "props"), "['k', props->>'k']"),
    ("sj_21_row_to_json", "part", fn("row_to_json", "named_struct('size', p_size, 'brand', p_brand)"), "CAST(json_object('size', p_size, 'brand', p_brand) AS VARCHAR)"), ("p_24_json_exists", "events", fn("jsonb_exists", "props", "'k'"), "list_contains(json_keys(props), 'k')"),
]:
    add(name, frm, spark, duck)
# full-text search: lexemes of whole texts (letters, digits and underscores), stop words left out
TV = fn("to_tsvector", "text")
_stop = "[" + ", ".join(f"'{w}'" for w in STOP) + "]"
_words = r"list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}_]+'), lambda w: w <> '')"
_lex = f"list_sort(list_distinct(list_filter({_words}, lambda w: NOT list_contains({_stop}, w))))"
_places = f"len(list_filter({_words}, lambda w: NOT list_contains({_stop}, w)))"
for name, spark, duck in [
    ("st_1_to_tsvector", f"array_join(transform({TV}, e -> e.lexeme), ' ')", f"array_to_string({_lex}, ' ')"), ("st_1_positions", f"aggregate({TV}, 0L, (n, e) -> n + size(e.positions))", f"CAST({_places} AS BIGINT)"),
    ("p_25_ts_match", fn("ts_match", TV, "'idiot | (ring & !the)'"), f"(list_contains({_lex}, 'idiot') OR (list_contains({_lex}, 'ring') AND NOT list_contains({_lex}, 'the')))"), ("s_7_gin_prefix", fn("ts_match", TV, "'thth:*'"), f"len(list_filter({_lex}, lambda w: starts_with(w, 'thth'))) > 0"),
    ("st_2_to_tsquery", fn("to_tsquery", "'a1 & (b1 | !c1)'"), "'''a1'' & ''b1'' | !''c1'''"), ("st_3_plainto_tsquery", fn("plainto_tsquery", "'red and ring'"), "'''red'' & ''ring'''"), ("st_4_phraseto_tsquery", fn("phraseto_tsquery", "'red ring'"), "'''red'' & ''ring'''"),
    ("st_5_ts_rank", f"round({fn('ts_rank', TV, chr(39) + 'idiot | er | re' + chr(39))}, 6)", f"round(coalesce(len(list_filter({_lex}, lambda w: w IN ('idiot', 'er', 're')))::DOUBLE / nullif(len({_lex}), 0), 0), 6)"),
    ("st_6_ts_rank_cd", f"round({fn('ts_rank_cd', TV, chr(39) + 'idiot | er | re' + chr(39))}, 6)", f"round(coalesce(len(list_filter({_words}, lambda w: w IN ('idiot', 'er', 're')))::DOUBLE / nullif({_places}, 0), 0), 6)"),
    ("st_7_ts_headline", f"md5({fn('ts_headline', 'text', chr(39) + 'er' + chr(39))})", r"md5(array_to_string(list_transform(string_split_regex(text, '\s+'), lambda w: CASE WHEN regexp_replace(lower(w), '[^\p{L}\p{N}_]', '', 'g') = 'er' THEN '<b>' || w || '</b>' ELSE w END), ' '))"),
    ("st_8_numnode", fn("numnode", "'a1 & (b1 | !c1)'"), "CAST(6 AS BIGINT)"), ("st_9_querytree", fn("querytree", "'a1 & b1'"), "'''a1'' & ''b1'''"), ("st_10_setweight", f"size({fn('setweight', TV, chr(39) + 'A' + chr(39))})", f"CAST(len({_lex}) AS INT)"),
    ("st_11_strip", f"aggregate({fn('strip', TV)}, 0L, (n, e) -> n + size(e.positions))", "CAST(0 AS BIGINT)"), ("st_12_length", fn("tsvector_length", TV), f"CAST(len({_lex}) AS BIGINT)"),
    ("st_14_concat", f"CAST(size({fn('tsvector_concat', fn('array_to_tsvector', 'array(lang, source)'), fn('array_to_tsvector', 'array(lang)'))}) AS BIGINT)", "CAST(3 AS BIGINT)"),
]:
    add(name, "documents", spark, duck)
add("st_13_array_to_tsvector", "part", f"array_join(transform({fn('array_to_tsvector', W)}, e -> concat(e.lexeme, ':', array_join(e.positions, '/'))), ' ')", "array_to_string(list_transform(list_sort(list_distinct(['red', lower(p_brand), lower(p_type)])), lambda l: l || ':' || CASE l WHEN 'red' THEN '1/3' WHEN lower(p_brand) THEN '2' ELSE '4' END), ' ')")
_row = f"list_transform({G}[8 * (vec_id % 8) + 1 : 8 * (vec_id % 8) + 8], lambda v: v)"
_col = f"list_transform(range(0, 8), lambda r: {G}[r * 8 + vec_id % 8 + 1])"
_ops = {
    "range": "list_max({x}) - list_min({x})", "rms_range": "sqrt(power(list_max({x}) - list_min({x}), 2) / 8)", "abs_norm": "list_sum(list_transform({x}, lambda v: abs(v)))", "abs_dev": "list_avg(list_transform({x}, lambda v: abs(v - list_avg({x}))))", "log_range": "ln(1 + list_max({x}) - list_min({x}))",
    "log_norm": "list_sum(list_transform({x}, lambda v: ln(1 + abs(v))))", "rms_dev": "sqrt(list_avg(list_transform({x}, lambda v: power(v - list_avg({x}), 2))))", "abs_range": "list_max(list_transform({x}, lambda v: abs(v))) - list_min(list_transform({x}, lambda v: abs(v)))", "rms_norm": "sqrt(list_avg(list_transform({x}, lambda v: v * v)))", "log_dev": "ln(1 + sqrt(list_avg(list_transform({x}, lambda v: power(v - list_avg({x}), 2)))))",
}
for _op, _duck in _ops.items():
    for _kind, _x in (("ROW", _row), ("COLUMN", _col)):
        add(f"sg_1_matrix_{_kind.lower()}_{_op}", "embeddings", f"round({fn('matrix', _kind, _op.upper(), '1', E, '8', '8', 'CAST(vec_id % 8 AS INT)')}, 5)", f"round({_duck.format(x=_x)}, 5)")
_enc = fn("string_encode", "'|'", "p_name", "replace(p_brand, '#', '|')", B)
add("sg_2_string_encode", "part", _enc, f"p_name || '|' || replace(p_brand, '#', '\\|') || '|' || coalesce({B}, '')")
add("sg_2_string_decode", "part", fn("string_decode", "'|'", _enc, "1"), "replace(p_brand, '#', '|')")


def scalar(name: str) -> Callable[[SparkSession, str], DataFrame]:
    frm, keys, expression, _ = SPECS[name]
    return lambda spark, sf_dir: sql(spark, sf_dir, f"SELECT {keys}, {expression.replace('{', '{{').replace('}', '}}')} AS result FROM {{{frm}}}")


def scalar_sql(name: str) -> str | None:
    frm, keys, _, duck = SPECS[name]
    return duck and f"SELECT {keys}, {duck} AS result FROM {frm}"


def _events(spark: SparkSession, sf_dir: str, column) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", column.alias("result"))


#: Functions without tables of their own for values, or that run as Arrow-batched UDFs.
EXTRA: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "sj_8_pretty": (lambda s, d: _events(s, d, json_udf.jsonb_pretty("props")), "SELECT event_id, '{' || chr(10) || '  \"k\": ' || (props->>'k') || chr(10) || '}' AS result FROM events"),
    "sj_9_strip_nulls": (lambda s, d: _events(s, d, json_udf.jsonb_strip_nulls(F.concat(F.lit('{"a":null,"b":'), "props", F.lit("}")))), "SELECT event_id, '{\"b\":{\"k\":' || (props->>'k') || '}}' AS result FROM events"),
    "sj_10_set": (lambda s, d: _events(s, d, json_udf.jsonb_set("props", F.expr("CASE event_id % 3 WHEN 0 THEN array('a') WHEN 1 THEN array('k') ELSE array('none', 'k') END"), F.lit("[1]"))), "SELECT event_id, CASE event_id % 3 WHEN 0 THEN '{\"a\":[1],\"k\":' || (props->>'k') || '}' WHEN 1 THEN '{\"k\":[1]}' ELSE '{\"k\":' || (props->>'k') || '}' END AS result FROM events"),
    "sj_13_concat": (lambda s, d: _events(s, d, json_udf.jsonb_concat("props", F.lit('{"z":1}'))), "SELECT event_id, '{\"k\":' || (props->>'k') || ',\"z\":1}' AS result FROM events"),
    "sj_15_delete_path": (lambda s, d: _events(s, d, json_udf.jsonb_delete_path(F.concat(F.lit('{"p":'), "props", F.lit("}")), F.array(F.lit("p"), F.expr("CASE event_id % 3 WHEN 0 THEN 'k' ELSE 'none' END")))), "SELECT event_id, CASE event_id % 3 WHEN 0 THEN '{\"p\":{}}' ELSE '{\"p\":{\"k\":' || (props->>'k') || '}}' END AS result FROM events"),
    "p_23_contains": (lambda s, d: _events(s, d, json_udf.jsonb_contains("props", F.lit('{"k":69}'))), "SELECT event_id, (props->>'k') = '69' AS result FROM events"),
    "sj_12_agg": (lambda s, d: sql(s, d, "SELECT event_type, to_json(array_sort(collect_list(event_id))) AS result FROM {events} GROUP BY event_type"), "SELECT event_type, CAST(to_json(list_sort(list(event_id))) AS VARCHAR) AS result FROM events GROUP BY event_type"),
    **{key: (lambda s, d, e=e: sql(s, d, f"SELECT c_custkey, {e} AS result FROM {{customer}}"), f"SELECT c_custkey, {q} AS result FROM customer") for key, e, q in [
        # the clock of the other engine, to the day
        *[(f"sd_{k}_{n}", f"date_format({fn(n)}, 'yyyy-MM-dd')", "strftime(now() AT TIME ZONE 'UTC', '%Y-%m-%d')") for k, n in ((1, "now"), (2, "current_date"), (11, "clock_timestamp"), (12, "statement_timestamp"))],
        ("sd_3_current_time", f"{fn('current_time')} RLIKE '^[0-2][0-9]:[0-5][0-9]:[0-5][0-9]$' AND abs(CAST(left({fn('current_time')}, 2) AS INT) - hour(current_timestamp())) % 23 < 2", "regexp_matches(strftime(now(), '%H:%M:%S'), '^[0-2][0-9]:')"),
        ("sd_13_timeofday", f"{fn('timeofday')} LIKE concat('%', year(current_timestamp()), '%')", "strftime(now(), '%Y') LIKE '20%'"),
        ("su_3_random", f"floor({fn('random')} * 0.999)", "CAST(0 AS BIGINT)"), ("su_4_gen_random_uuid", f"{fn('gen_random_uuid')} RLIKE '^[0-9a-f]{{{{8}}}}-[0-9a-f]{{{{4}}}}-4[0-9a-f]{{{{3}}}}-[89ab][0-9a-f]{{{{3}}}}-[0-9a-f]{{{{12}}}}$'", "regexp_matches(CAST(uuid() AS VARCHAR), '^[0-9a-f]{8}-[0-9a-f]{4}-4')"),
        ("sa_27_array_sample", f"aggregate(array({fn('array_sample', 'array(1, 2, 4, 8)', '2')}), 0, (n, a) -> n + size(a) * 100 + size(array_distinct(a)) * 10 + size(array_except(a, array(1, 2, 4, 8))))", "220"),
        ("sa_28_array_shuffle", f"array_sort({fn('array_shuffle', 'array(3, 1, 2)')})", "[1, 2, 3]"),
    ]},
    "su_3_random_spread": (lambda s, d: sql(s, d, f"SELECT count(DISTINCT r) > 0.99 * count(*) AS differ, abs(avg(r) - 0.5) < 0.1 AS centred FROM (SELECT {fn('random')} AS r FROM {{orders}})"), "SELECT true AS differ, true AS centred"),
    "su_4_uuid_spread": (lambda s, d: sql(s, d, f"SELECT count(DISTINCT u) = count(*) AS differ FROM (SELECT {fn('gen_random_uuid')} AS u FROM {{orders}})"), "SELECT count(DISTINCT u) = count(*) AS differ FROM (SELECT uuid() AS u FROM orders)"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: scalar(name) for name in SPECS} | {name: f for name, (f, _) in EXTRA.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: scalar_sql(name) for name in SPECS} | {name: q for name, (_, q) in EXTRA.items()}
    return {name: q for name, q in found.items() if q}
