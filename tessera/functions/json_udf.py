"""Functions that rewrite nested JSON documents, as Arrow-batched UDFs."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dumps(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _each(f):
    @F.pandas_udf(T.StringType())
    def run(j: pd.Series, *more: pd.Series) -> pd.Series:
        return pd.Series([None if row[0] is None else f(json.loads(row[0]), *row[1:]) for row in zip(j, *more)], dtype=object)

    return run


def _place(holder, key):
    """Where key leads in a container: a name in an object, a number (from the end if negative) in an array; None: nowhere."""
    if isinstance(holder, dict):
        return key if key in holder else None
    if isinstance(holder, list):
        try:
            at = int(key)
        except ValueError:
            return None
        return at if -len(holder) <= at < len(holder) else None
    return None


def _holder(doc, path):
    """The container of the path's last step, or None where the path doesn't lead that far."""
    for key in path[:-1]:
        at = _place(doc, key)
        if at is None:
            return None
        doc = doc[at]
    return doc


def _value(text):
    """JSON, or what isn't as a string."""
    try:
        return json.loads(text)
    except ValueError:
        return text


def _set(doc, path, value):
    """A missing last step is added (to an array at the end it lies beyond); where the path ends before, nothing changes. NULL path or value: NULL."""
    if path is None or value is None:
        return None
    path = list(path)
    holder = _holder(doc, path) if path else None
    if isinstance(holder, dict):
        holder[path[-1]] = _value(value)
    elif isinstance(holder, list):
        at = _place(holder, path[-1])
        if at is not None:
            holder[at] = _value(value)
        elif path[-1].lstrip("-").isdigit():
            holder.insert(0 if path[-1].startswith("-") else len(holder), _value(value))
    return dumps(doc)


def _delete(doc, path):
    """A path that leads nowhere deletes nothing. NULL path: NULL."""
    if path is None:
        return None
    path = list(path)
    holder = _holder(doc, path) if path else None
    at = _place(holder, path[-1]) if path else None
    if at is not None:
        del holder[at]
    return dumps(doc)


def _strip(value):
    if isinstance(value, dict):
        return {k: _strip(v) for k, v in value.items() if v is not None}
    return [_strip(v) for v in value] if isinstance(value, list) else value


def _join(a, b):
    b = json.loads(b)
    if isinstance(a, dict) and isinstance(b, dict):
        return dumps(a | b)
    return dumps((a if isinstance(a, list) else [a]) + (b if isinstance(b, list) else [b]))


def _inside(a, b) -> bool:
    """Whether a contains b."""
    if isinstance(a, dict) and isinstance(b, dict):
        return all(k in a and _inside(a[k], v) for k, v in b.items())
    if isinstance(a, list):
        return all(any(_inside(x, y) for x in a) for y in b) if isinstance(b, list) else b in a
    return a == b and isinstance(a, bool) == isinstance(b, bool)


jsonb_set = _each(_set)
jsonb_delete_path = _each(_delete)
jsonb_strip_nulls = _each(lambda d: dumps(_strip(d)))
jsonb_concat = _each(_join)
jsonb_pretty = _each(lambda d: json.dumps(d, indent=2, sort_keys=True, ensure_ascii=False))


@F.pandas_udf(T.BooleanType())
def jsonb_contains(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else _inside(json.loads(x), json.loads(y)) for x, y in zip(a, b)], dtype=object)
