"""Digests, encodings, bits and utilities."""

_NAMES = [("int", "integer"), ("bigint", "bigint"), ("smallint", "smallint"), ("double", "double precision"), ("float", "real"), ("string", "text"), ("boolean", "boolean"), ("timestamp_ntz", "timestamp without time zone"), ("date", "date"), ("binary", "bytea"), ("void", "unknown")]


def _typeof(x):
    cases = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _NAMES)
    return f"CASE WHEN {x} IS NULL THEN 'unknown' ELSE CASE typeof({x}) {cases} ELSE typeof({x}) END END"


FUNCTIONS = {
    "md5": "md5({})".format, "sha256": "sha2({}, 256)".format, "digest": lambda s, a=None: f"sha2({s}, 256)", "encode": lambda s, f: f"lower(hex(CAST({s} AS BINARY)))" if "hex" in f else f"base64(CAST({s} AS BINARY))",
    "decode": lambda s, f: f"CAST(unhex({s}) AS STRING)" if "hex" in f else f"CAST(unbase64({s}) AS STRING)", "to_hex": "lower(hex({}))".format, "hashtext": "xxhash64({})".format, "crc32": "crc32(CAST({} AS BINARY))".format,
    "bit_xor": "({}) ^ ({})".format, "bit_and_func": "({}) & ({})".format, "bit_or_func": "({}) | ({})".format, "bit_count": "CAST(bit_count({}) AS BIGINT)".format, "bit_not": "~({})".format,
    "pg_typeof": _typeof, "to_number": lambda s, f=None: f"CAST(regexp_replace({s}, '[^0-9.+-]', '') AS DOUBLE)", "random": lambda: "rand()", "gen_random_uuid": lambda: "uuid()",
    "num_nonnulls": lambda *a: " + ".join(f"CAST({x} IS NOT NULL AS BIGINT)" for x in a), "num_nulls": lambda *a: " + ".join(f"CAST({x} IS NULL AS BIGINT)" for x in a),
}
