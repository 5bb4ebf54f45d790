"""Date and time functions over zone-less timestamps."""

_FIELDS = {"year": "year({})", "month": "month({})", "day": "day({})", "hour": "hour({})", "minute": "minute({})", "second": "CAST(floor(second({})) AS INT)", "dow": "dayofweek({}) - 1", "doy": "dayofyear({})", "epoch": "unix_seconds(CAST({} AS TIMESTAMP))"}
_PATTERN = [("YYYY", "yyyy"), ("YY", "yy"), ("MM", "\0"), ("DD", "dd"), ("HH24", "HH"), ("HH12", "hh"), ("HH", "hh"), ("MI", "mm"), ("SS", "ss"), ("AM", "a"), ("PM", "a"), ("Month", "MMMM"), ("Mon", "MMM"), ("Day", "EEEE"), ("Dy", "EEE"), ("\0", "MM")]
MICROS = "unix_micros(CAST({} AS TIMESTAMP))"


def extract(field, ts):
    field = field.strip("'").lower()
    if field not in _FIELDS:
        raise ValueError(f"no field {field}")
    return f"CAST({_FIELDS[field].format(ts)} AS BIGINT)"


def pattern(fmt: str) -> str:
    """A PostgreSQL to_char pattern as a Java one; whatever is no token is quoted where it has letters."""
    out, at = "", 0
    tokens = [(a, b if b != "\0" else "MM") for a, b in _PATTERN if a != "\0"]
    tokens.sort(key=lambda t: -len(t[0]))
    while at < len(fmt):
        for a, b in tokens:
            if fmt.startswith(a, at):
                out, at = out + b, at + len(a)
                break
        else:
            c = fmt[at]
            out, at = out + (f"''{c}''" if c.isalpha() else c), at + 1
    return out


def age(a, b="current_timestamp()"):
    t = f"({MICROS.format(a)} - {MICROS.format(b)}) div 1000000"
    d = f"(({t}) div 86400)"
    s = f"(({t}) % 86400)"
    return f"format_string('%d years %d mons %d days %02d:%02d:%02d', {d} div 365, ({d} % 365) div 30, ({d} % 365) % 30, abs({s}) div 3600, (abs({s}) % 3600) div 60, abs({s}) % 60)"


def make_interval(y, mo, d, h, mi, s):
    unit = lambda n, one, many: f"CASE WHEN {n} = 0 THEN NULL WHEN {n} = 1 THEN '1 {one}' ELSE concat({n}, ' {many}') END"
    clock = f"CASE WHEN {h} = 0 AND {mi} = 0 AND {s} = 0 THEN NULL ELSE format_string('%02d:%02d:%02d', CAST({h} AS INT), CAST({mi} AS INT), CAST({s} AS INT)) END"
    return f"concat_ws(' ', {unit(y, 'year', 'years')}, {unit(mo, 'mon', 'mons')}, {unit(d, 'day', 'days')}, {clock})"


FUNCTIONS = {
    "now": lambda: "CAST(current_timestamp() AS TIMESTAMP_NTZ)", "current_date": lambda: "current_date()", "current_time": lambda: "date_format(current_timestamp(), 'HH:mm:ss')", "extract": extract, "date_part": extract,
    "date_trunc": lambda f, ts: f"CAST(date_trunc({f}, CAST({ts} AS TIMESTAMP)) AS TIMESTAMP_NTZ)", "to_char": lambda ts, fmt: "date_format({}, '{}')".format(ts, pattern(fmt.strip("'")).replace("''", "\\'")), "age": age,
    "make_date": "make_date({}, {}, {})".format, "make_timestamp": lambda y, m, d, h, mi, s: f"make_timestamp_ntz({y}, {m}, {d}, {h}, {mi}, floor({s}))", "to_timestamp": lambda x: f"CAST(timestamp_micros(CAST(({x}) * 1000000 AS BIGINT)) AS TIMESTAMP_NTZ)",
    "clock_timestamp": lambda: "CAST(current_timestamp() AS TIMESTAMP_NTZ)", "statement_timestamp": lambda: "CAST(current_timestamp() AS TIMESTAMP_NTZ)", "timeofday": lambda: "date_format(current_timestamp(), 'EEE MMM dd HH:mm:ss.SSSSSS yyyy z')",
    "to_date": lambda s, fmt=None: f"coalesce(try_to_date({s}, 'yyyy-MM-dd'), try_to_date({s}, 'MM/dd/yyyy'), try_to_date({s}, 'dd-MM-yyyy'), try_to_date({s}, 'yyyyMMdd'))",
    "date_add": lambda ts, n: f"{ts} + make_dt_interval(CAST({n} AS INT))", "date_subtract": lambda ts, n: f"{ts} - make_dt_interval(CAST({n} AS INT))", "date_diff": lambda a, b: f"CAST(({MICROS.format(a)} - {MICROS.format(b)}) div 86400000000 AS BIGINT)",
    "extract_epoch": lambda ts: f"{MICROS.format(ts)} / 1000000", "make_interval": make_interval,
}
