"""String functions."""


def _substr(s, start, n=None):
    n = f"greatest({n}, 0)" if n is not None else f"char_length({s})"
    return f"substring({s}, greatest({start}, 1), {n})"


def _format(fmt, *args):
    out = fmt
    for k, a in enumerate(args, 1):
        out = f"replace({out}, '%{k}', CAST({a} AS STRING))"
    return f"replace({out}, '%s', CAST({args[0]} AS STRING))" if args else out


FUNCTIONS = {
    "upper": "upper({})".format, "lower": "lower({})".format, "length": "char_length({})".format, "substr": _substr,
    "concat": lambda *a: f"concat_ws('', {', '.join(a)})", "concat_ws": lambda *a: f"concat_ws({', '.join(a)})",
    "trim": lambda s: f"regexp_replace({s}, '^\\\\s+|\\\\s+$', '')",
    "btrim": lambda s, c="' '": f"trim(BOTH {c} FROM {s})", "ltrim": lambda s, c="' '": f"trim(LEADING {c} FROM {s})", "rtrim": lambda s, c="' '": f"trim(TRAILING {c} FROM {s})",
    "replace": "replace({}, {}, {})".format, "strpos": lambda s, p: f"CAST(instr({s}, {p}) AS BIGINT)", "lpad": lambda s, n, f="' '": f"lpad({s}, {n}, {f})", "rpad": lambda s, n, f="' '": f"rpad({s}, {n}, {f})",
    "left": "left({}, {})".format, "right": "right({}, {})".format, "repeat": "repeat({}, {})".format, "reverse": "reverse({})".format,
    "initcap": lambda s: f"array_join(transform(regexp_extract_all({s}, '[\\\\p{{L}}\\\\p{{N}}]+|[^\\\\p{{L}}\\\\p{{N}}]+', 0), w -> initcap(w)), '')",
    "translate": "translate({}, {}, {})".format, "split_part": lambda s, d, n: f"CASE WHEN {n} <= 0 THEN '' ELSE split_part({s}, {d}, greatest({n}, 1)) END",
    "overlay": lambda s, r, i, n=None: f"overlay({s} PLACING {r} FROM {i}" + (f" FOR {n})" if n else ")"), "starts_with": "startswith({}, {})".format, "ends_with": "endswith({}, {})".format,
    "chr": lambda n: f"decode(unhex(lpad(hex({n}), 8, '0')), 'UTF-32')", "ascii": "ascii({})".format,
    "quote_literal": lambda s: f"concat('''', replace({s}, '''', ''''''), '''')", "quote_ident": lambda s: f"concat('\"', replace({s}, '\"', '\"\"'), '\"')",
    "quote_nullable": lambda s: f"coalesce(concat('''', replace({s}, '''', ''''''), ''''), 'NULL')",
    "bit_length": "bit_length({})".format, "octet_length": "octet_length({})".format, "format": _format,
    "substr_count": lambda s, p: f"CASE WHEN {p} = '' THEN 0L ELSE CAST((char_length({s}) - char_length(replace({s}, {p}, ''))) div char_length({p}) AS BIGINT) END",
    "normalize": "{}".format, "parse_ident": lambda s: f"transform(split({s}, '[.]'), x -> regexp_replace(trim(x), '^\"(.*)\"$', '$1'))",
}
