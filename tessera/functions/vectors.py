"""Text search vectors, matrices held as flat arrays, and delimited encodings."""

import re as _re

STOP = "was no for will with on is there are these such be the but in this into an of then and or it not if a that they at as by their to".split()
_WORDS = "filter(split(lower({}), '[^\\\\p{{L}}\\\\p{{N}}_]+'), w -> w <> '')"


def _let(name: str, value: str, body: str) -> str:
    """body with value under a name: a lambda's variable is worked out once, an expression inside a lambda for each element."""
    return f"transform(array({value}), {name} -> {body})[0]"


def tsvector(s):
    """Sorted lexemes with their places: stop words are left out but counted. Words are sorted with their places, and runs of equal words cut from that, so the work is n log n. sort_array compares natively where array_sort would evaluate an expression for each comparison."""
    stop = ", ".join(f"'{w}'" for w in STOP)
    pairs = f"sort_array(filter(transform({_WORDS.format(s)}, (w, i) -> named_struct('w', w, 'p', CAST(i + 1 AS BIGINT))), e -> e.w NOT IN ({stop})))"
    heads = "filter(transform(v_all, (x, i) -> named_struct('w', x.w, 'i', i, 'h', i = 0 OR get(v_all, i - 1).w <> x.w)), x -> x.h)"
    rows = "transform(v_heads, (x, k) -> named_struct('lexeme', x.w, 'positions', transform(slice(v_all, x.i + 1, coalesce(get(v_heads, k + 1).i, size(v_all)) - x.i), e -> e.p)))"
    return _let("v_all", pairs, _let("v_heads", heads, rows))


class Query:
    """A search query, parsed once when the plan is made: & | ! ( ) and word:* for beginnings."""

    def __init__(self, text: str, plain: bool = False):
        tokens = [("w", w) for w in _re.findall(r"[\w]+", text.lower()) if w not in STOP] if plain else _re.findall(r"[&|!()]|[\w]+(?::\*)?", text.lower())
        if plain:
            tokens = [x for k, (_, w) in enumerate(tokens) for x in ((["&"] if k else []) + [w])]
        self.tokens, self.at = tokens, 0
        self.tree = self._or() if tokens else None

    def _peek(self):
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def _or(self):
        out = self._and()
        while self._peek() == "|":
            self.at += 1
            out = ("|", out, self._and())
        return out

    def _and(self):
        out = self._not()
        while self._peek() == "&":
            self.at += 1
            out = ("&", out, self._not())
        return out

    def _not(self):
        token = self._peek()
        self.at += 1
        if token == "!":
            return ("!", self._not())
        if token == "(":
            out = self._or()
            self.at += 1
            return out
        return ("w", token)

    def words(self, tree=None) -> list[str]:
        tree = tree or self.tree
        return [] if tree is None else [tree[1]] if tree[0] == "w" else [w for t in tree[1:] for w in self.words(t)]

    def nodes(self, tree=None) -> int:
        tree = tree or self.tree
        return 0 if tree is None else 1 if tree[0] == "w" else 1 + sum(self.nodes(t) for t in tree[1:])

    def render(self, tree=None) -> str:
        tree = tree or self.tree
        if tree is None:
            return ""
        return f"'{tree[1]}'" if tree[0] == "w" else f"!{self.render(tree[1])}" if tree[0] == "!" else f"{self.render(tree[1])} {tree[0]} {self.render(tree[2])}"

    def matches(self, v: str, tree=None) -> str:
        tree = tree or self.tree
        if tree is None:
            return "false"
        if tree[0] == "w":
            return f"exists({v}, e -> {self._test('e.lexeme', tree[1])})"
        if tree[0] == "!":
            return f"NOT ({self.matches(v, tree[1])})"
        return f"(({self.matches(v, tree[1])}) {'AND' if tree[0] == '&' else 'OR'} ({self.matches(v, tree[2])}))"

    @staticmethod
    def _test(column: str, word: str) -> str:
        return f"startswith({column}, '{word[:-2]}')" if word.endswith(":*") else f"{column} = '{word}'"

    def any_word(self, column: str) -> str:
        return "(" + (" OR ".join(self._test(column, w) for w in self.words()) or "false") + ")"


def _query(q: str) -> Query:
    return Query(q.strip("'"))


def _headline(s, q):
    clean = "regexp_replace(lower(w), '[^\\\\p{L}\\\\p{N}_]', '')"
    return f"array_join(transform(split({s}, '\\\\s+'), w -> if({_query(q).any_word(clean)}, concat('<b>', w, '</b>'), w)), ' ')"


def _positions(v):
    return f"aggregate({v}, 0L, (n, e) -> n + size(e.positions))"


# --- matrices: ARRAY_MATRIX_{ROW|COLUMN}_{OPERATION}{n}(a, rows, columns, index)

def matrix(kind: str, operation: str, number: int, a: str, rows: str, columns: str, index: str) -> str:
    line = f"slice({a}, {index} * {columns} + 1, {columns})" if kind == "ROW" else f"transform(sequence(0, {rows} - 1), r -> {a}[r * {columns} + {index}])"
    x = f"transform({line}, v -> CAST(v AS DOUBLE))"
    total = lambda e: f"aggregate({x}, 0D, (s, v) -> s + {e})"
    n, mean = f"size({x})", f"({total('v')} / size({x}))"
    spread = f"(array_max({x}) - array_min({x}))"
    forms = {
        "RANGE": spread, "ABS_RANGE": f"(array_max(transform({x}, v -> abs(v))) - array_min(transform({x}, v -> abs(v))))", "RMS_NORM": f"sqrt({total('v * v')} / {n})", "RMS_RANGE": f"sqrt({spread} * {spread} / {n})",
        "ABS_NORM": total("abs(v)") if number < 46 else f"({total('abs(v)')} / {n})", "LOG_NORM": total("ln(1 + abs(v))"), "LOG_RANGE": f"ln(1 + {spread})",
        "RMS_DEV": f"sqrt({total(f'(v - {mean}) * (v - {mean})')} / {n})", "ABS_DEV": f"({total(f'abs(v - {mean})')} / {n})" if number < 51 else f"sqrt({total('v * v')} / {n} - power({total('abs(v)')} / {n}, 2))", "LOG_DEV": f"ln(1 + sqrt({total(f'(v - {mean}) * (v - {mean})')} / {n}))",
    }
    if operation not in forms:
        raise ValueError(f"no matrix operation {operation}")
    return f"CASE WHEN {n} = 0 THEN 0D ELSE {forms[operation]} END"


def string_encode(mark: str, *fields: str) -> str:
    escaped = [f"coalesce(replace(replace({f}, '\\\\', '\\\\\\\\'), '{mark}', '\\\\{mark}'), '')" for f in fields]
    return f"concat_ws('{mark}', {', '.join(escaped)})"


def string_decode(mark: str, line: str, index: str) -> str:
    m = _re.escape(mark).replace("\\", "\\\\")
    parts = f"transform(regexp_extract_all(concat('{mark}', {line}), '{m}((?:\\\\\\\\.|[^{m}\\\\\\\\])*)', 1), p -> regexp_replace(p, '\\\\\\\\(.)', '$1'))"
    return f"get({parts}, {index})"


FUNCTIONS = {
    "to_tsvector": tsvector, "ts_match": lambda v, q: _let("v_one", v, _query(q).matches("v_one")), "ts_rank": lambda v, q: _let("v_one", v, f"coalesce(CAST(size(filter(v_one, e -> {_query(q).any_word('e.lexeme')})) AS DOUBLE) / nullif(size(v_one), 0), 0D)"),
    "ts_rank_cd": lambda v, q: _let("v_one", v, f"coalesce(CAST(aggregate(filter(v_one, e -> {_query(q).any_word('e.lexeme')}), 0L, (n, e) -> n + size(e.positions)) AS DOUBLE) / nullif({_positions('v_one')}, 0), 0D)"), "ts_headline": _headline,
    "numnode": lambda q: f"CAST({_query(q).nodes()} AS BIGINT)", "querytree": lambda q: '"' + _query(q).render() + '"', "to_tsquery": lambda q: '"' + _query(q).render() + '"', "plainto_tsquery": lambda q: '"' + Query(q.strip("'"), True).render() + '"', "phraseto_tsquery": lambda q: '"' + Query(q.strip("'"), True).render() + '"',
    "setweight": lambda v, c: v, "strip": lambda v: f"transform({v}, e -> named_struct('lexeme', e.lexeme, 'positions', slice(e.positions, 1, 0)))", "tsvector_length": "CAST(size({}) AS BIGINT)".format,
    "array_to_tsvector": lambda a: f"transform(array_sort(array_distinct(transform(array_compact({a}), x -> lower(x)))), l -> named_struct('lexeme', l, 'positions', filter(transform({a}, (w, i) -> if(lower(w) = l, CAST(i + 1 AS BIGINT), NULL)), p -> p IS NOT NULL)))",
    "tsvector_concat": lambda a, b: f"concat({a}, transform({b}, e -> named_struct('lexeme', e.lexeme, 'positions', transform(e.positions, p -> p + aggregate({a}, 0L, (n, x) -> greatest(n, array_max(x.positions)))))))",
    "string_encode": lambda mark, *f: string_encode(mark.strip("'"), *f), "string_decode": lambda mark, line, k: string_decode(mark.strip("'"), line, k), "matrix": lambda kind, op, n, *rest: matrix(kind, op, int(n), *rest),
}
