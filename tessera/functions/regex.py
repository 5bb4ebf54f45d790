"""Regular expressions. Patterns are literals, so groups are counted when the plan is made."""

import re as _re


def _literal(p: str) -> str:
    return p[1:-1].replace("\\\\", "\\")


def _replace(s, p, r, flags="''"):
    if "g" in flags:
        return f"regexp_replace({s}, {p}, {r})"
    # only the first match: everything before it is captured lazily, everything behind it is kept
    raw, groups = _literal(p), _re.compile(_literal(p)).groups
    shifted = _re.sub(r"\$(\d)", lambda m: f"${int(m[1]) + 1}", r[1:-1])
    whole = f"(?s)^(.*?)(?:{raw})(.*)$".replace("\\", "\\\\")
    return f"CASE WHEN {s} RLIKE {p} THEN regexp_replace({s}, '{whole}', '$1{shifted}${groups + 2}') ELSE {s} END"


def _match(s, p):
    groups = _re.compile(_literal(p)).groups
    parts = ", ".join(f"regexp_extract({s}, {p}, {k})" for k in (range(1, groups + 1) if groups else [0]))
    return f"CASE WHEN {s} RLIKE {p} THEN array({parts}) END"


FUNCTIONS = {
    "regexp_replace": _replace, "regexp_match": _match, "regexp_count": "CAST(regexp_count({}, {}) AS BIGINT)".format, "regexp_substr": "regexp_substr({}, {})".format, "regexp_split_to_array": "split({}, {})".format,
    "regexp_instr": "CAST(regexp_instr({}, {}) AS BIGINT)".format, "regexp_like": "regexp_like({}, {})".format, "regexp_escape": lambda s: f"regexp_replace({s}, '([.^$|()\\\\[\\\\]{{}}*+?\\\\\\\\])', '\\\\\\\\$1')",
}
