"""Mathematical functions. Arguments outside a function's domain raise."""


def _guard(condition: str, name: str):
    return lambda x: f"CASE WHEN {condition.format(x)} THEN CAST(raise_error('{name}: argument out of range') AS DOUBLE) ELSE {name}({x}) END"


def _gcd(a, b):
    return f"aggregate(sequence(1, 96), struct(CAST({a} AS BIGINT) AS a, CAST({b} AS BIGINT) AS b), (s, i) -> if(s.b = 0, s, struct(s.b AS a, s.a % s.b AS b)), s -> abs(s.a))"


def _trunc(x, p="0"):
    return f"((CASE WHEN {x} >= 0 THEN CAST(floor({x} * power(10, {p})) AS DOUBLE) ELSE CAST(ceil({x} * power(10, {p})) AS DOUBLE) END) / power(10, {p}))"


def _width_bucket(v, lo, hi, n):
    return f"CAST(width_bucket({v}, {lo}, {hi}, {n}) AS BIGINT)"


_DIGITS = "coalesce(char_length(split_part(CAST({} AS STRING), '.', 2)), 0)"
FUNCTIONS = {
    "abs": "abs({})".format, "round": "round({})".format, "ceil": "CAST(ceil({}) AS DOUBLE)".format, "ceiling": "CAST(ceil({}) AS DOUBLE)".format, "floor": "CAST(floor({}) AS DOUBLE)".format,
    "power": "power({}, {})".format, "sqrt": _guard("{} < 0", "sqrt"), "sign": "sign({})".format, "trunc": _trunc, "ln": _guard("{} <= 0", "ln"),
    "log": lambda b, x=None: _guard("{} <= 0", "log10")(b) if x is None else f"log({b}, {x})", "exp": "exp({})".format, "pi": lambda: "pi()", "mod": "({}) % ({})".format, "degrees": "degrees({})".format, "radians": "radians({})".format,
    "greatest": lambda *a: f"greatest({', '.join(a)})", "least": lambda *a: f"least({', '.join(a)})", "cbrt": "cbrt({})".format,
    "factorial": lambda n: f"CASE WHEN {n} < 0 THEN CAST(raise_error('factorial of a negative number') AS BIGINT) WHEN {n} > 20 THEN 9223372036854775807 ELSE factorial(CAST({n} AS INT)) END",
    "gcd": _gcd, "lcm": lambda a, b: f"CASE WHEN {a} = 0 OR {b} = 0 THEN 0L ELSE abs({a} * {b}) div {_gcd(a, b)} END",
    **{f: f"{f}({{}})".format for f in ("sin", "cos", "tan", "atan", "sinh", "cosh", "tanh", "asinh")}, "asin": _guard("abs({}) > 1", "asin"), "acos": _guard("abs({}) > 1", "acos"), "atan2": "atan2({}, {})".format,
    "log10": _guard("{} <= 0", "log10"), "log2": _guard("{} <= 0", "log2"), "cot": "CASE WHEN tan({0}) = 0 THEN CAST(raise_error('division by zero') AS DOUBLE) ELSE cot({0}) END".format,
    "acosh": _guard("{} < 1", "acosh"), "atanh": _guard("abs({}) >= 1", "atanh"), "width_bucket": _width_bucket, "div": "({}) div ({})".format,
    "scale": _DIGITS.format, "isfinite": "NOT (isnan({0}) OR abs({0}) = double('Infinity'))".format, "isinf": "abs({}) = double('Infinity')".format, "isnan": "CASE WHEN {0} IS NULL THEN NULL ELSE isnan({0}) END".format,
    "trim_scale": "CAST({} AS DOUBLE)".format, "min_scale": lambda x: f"char_length(regexp_replace(split_part(CAST({x} AS STRING), '.', 2), '0+$', ''))", "trunc_precision": _trunc, "round_precision": "round({}, {})".format,
    "clamp": "CAST(least(greatest({}, {}), {}) AS DOUBLE)".format,
}
