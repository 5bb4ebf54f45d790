"""Scalar functions by name, as SQL expressions that Catalyst compiles; no Python runs on the executors for them.

text("initcap", "p_name") gives the expression, call("initcap", "p_name") the Column. register(spark) declares those
of fixed arity as temporary SQL functions pg_<name> for use in statements.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tessera.functions import arrays, datetimes, encoding, fuzzy, json, numbers, regex, strings, vectors

BUILDERS = {name: f for module in (strings, numbers, datetimes, arrays, regex, encoding, fuzzy, json, vectors) for name, f in module.FUNCTIONS.items()}


def text(name: str, *args: str) -> str:
    """The SQL expression of a function of SQL expressions. Unknown names raise."""
    if name.lower() not in BUILDERS:
        raise ValueError(f"no function named {name}")
    return f"({BUILDERS[name.lower()](*args)})"


def call(name: str, *args: str) -> Column:
    return F.expr(text(name, *args))


#: Declared types of the functions that register() makes available in SQL.
SIGNATURES = {
    "initcap": ("s STRING", "STRING"), "split_part": ("s STRING, d STRING, n INT", "STRING"), "quote_literal": ("s STRING", "STRING"), "quote_ident": ("s STRING", "STRING"),
    "quote_nullable": ("s STRING", "STRING"), "chr": ("n INT", "STRING"), "substr_count": ("s STRING, p STRING", "BIGINT"), "trim": ("s STRING", "STRING"),
    "cbrt": ("x DOUBLE", "DOUBLE"), "gcd": ("a BIGINT, b BIGINT", "BIGINT"), "lcm": ("a BIGINT, b BIGINT", "BIGINT"), "log": ("x DOUBLE", "DOUBLE"), "ceil": ("x DOUBLE", "DOUBLE"), "floor": ("x DOUBLE", "DOUBLE"),
    "clamp": ("v DOUBLE, lo DOUBLE, hi DOUBLE", "DOUBLE"), "age": ("a TIMESTAMP_NTZ, b TIMESTAMP_NTZ", "STRING"), "date_diff": ("a TIMESTAMP_NTZ, b TIMESTAMP_NTZ", "BIGINT"),
    "similarity": ("a STRING, b STRING", "DOUBLE"), "hamming_distance": ("a STRING, b STRING", "BIGINT"), "to_number": ("s STRING", "DOUBLE"), "regexp_escape": ("s STRING", "STRING"),
}


def register(spark: SparkSession) -> list[str]:
    """Temporary SQL functions pg_<name>; Catalyst inlines their bodies. Returns the names."""
    for name, (parameters, returns) in SIGNATURES.items():
        names = [p.split()[0] for p in parameters.split(", ")]
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION pg_{name}({parameters}) RETURNS {returns} RETURN {text(name, *names)}")
    return [f"pg_{name}" for name in SIGNATURES]
