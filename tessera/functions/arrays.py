"""Array functions: 1-based places, inclusive slices; a place outside the array is NULL."""

_DOUBLE = "transform({}, x -> CAST(x AS DOUBLE))"


def _slice(a, lo, hi):
    return f"slice({a}, greatest({lo}, 1), greatest(least({hi}, size({a})) - greatest({lo}, 1) + 1, 0))"


def _rotate(a, n):
    k = f"pmod({n}, greatest(size({a}), 1))"
    return f"concat(slice({a}, {k} + 1, size({a})), slice({a}, 1, {k}))"


def _generate(start, stop, step=None):
    if step is None:
        return f"sequence({start}, {stop})"
    return f"CASE WHEN ({step} > 0 AND {start} > {stop}) OR ({step} < 0 AND {start} < {stop}) THEN slice(array({start}), 1, 0) ELSE sequence({start}, {stop}, {step}) END"


_SUM = "aggregate({}, CAST(0 AS DOUBLE), (s, x) -> s + coalesce(CAST(x AS DOUBLE), 0))"
FUNCTIONS = {
    "array_length": lambda a, d="1": f"CAST(size({a}) AS BIGINT)", "cardinality": "CAST(size({}) AS BIGINT)".format, "array_position": "nullif(array_position({}, {}), 0)".format,
    "array_positions": "filter(transform({}, (e, i) -> if(e <=> {}, CAST(i + 1 AS BIGINT), NULL)), i -> i IS NOT NULL)".format, "array_append": "array_append({}, {})".format, "array_prepend": lambda x, a: f"array_prepend({a}, {x})",
    "array_remove": "filter({}, e -> NOT (e <=> {}))".format, "array_replace": "transform({}, e -> if(e <=> {}, {}, e))".format, "array_cat": "concat({}, {})".format,
    "array_to_string": lambda a, d, n=None: f"array_join({a}, {d})" if n is None else f"array_join({a}, {d}, {n})", "string_to_array": lambda s, d, n=None: f"split({s}, concat('\\\\Q', {d}, '\\\\E'))" if n is None else f"transform(split({s}, concat('\\\\Q', {d}, '\\\\E')), x -> nullif(x, {n}))",
    "array_upper": lambda a, d="1": f"CAST(size({a}) AS BIGINT)", "array_lower": lambda a, d="1": f"if(size({a}) = 0, NULL, 1L)", "array_dims": "if(size({0}) = 0, '[]', concat('[1:', size({0}), ']'))".format, "array_fill": "array_repeat({}, {})".format, "array_reverse": "reverse({})".format,
    "array_distinct": "array_distinct({})".format, "array_sort": "array_sort({})".format, "array_contains": "array_contains({}, {})".format, "array_overlap": lambda a, b: f"exists({a}, x -> exists({b}, y -> x <=> y))", "array_slice": _slice,
    "array_ndims": lambda a: f"CAST((char_length(typeof({a})) - char_length(replace(typeof({a}), 'array<', ''))) div 6 AS BIGINT)", "unnest": lambda a: f"array_join(transform({a}, x -> CAST(x AS STRING)), '\\n')", "string_to_table": lambda s, d: f"split({s}, concat('\\\\Q', {d}, '\\\\E'))",
    "array_to_json": "to_json({})".format, "array_generate": _generate, "array_sample": "slice(shuffle({}), 1, {})".format, "array_shuffle": "shuffle({})".format, "array_intersect": "filter({}, x -> array_contains({}, x))".format, "array_except": "filter({}, x -> NOT array_contains({}, x))".format,
    "array_compact": "array_compact({})".format, "array_flatten": "flatten({})".format, "array_repeat": lambda x, n: f"CASE WHEN {x} IS NULL THEN NULL ELSE array_repeat({x}, {n}) END", "array_rotate": _rotate, "array_to_set": "array_distinct({})".format,
    "array_zip": "zip_with({}, {}, (x, y) -> array(x, y))".format, "array_min": "CAST(array_min({}) AS DOUBLE)".format, "array_max": "CAST(array_max({}) AS DOUBLE)".format, "array_sum": _SUM.format, "array_avg": lambda a: f"{_SUM.format(a)} / nullif(size({a}), 0)",
    "array_every": "forall({}, x -> x)".format, "array_some": "exists({}, x -> x)".format, "overlay_array": lambda a, r, start, n=None: f"concat(slice({a}, 1, {start} - 1), {r}, slice({a}, {start} + {n or f'size({r})'}, size({a})))",
}
