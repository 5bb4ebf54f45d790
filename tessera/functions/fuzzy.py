"""Fuzzy matching."""


def _trigrams(s):
    p = f"concat('  ', lower({s}), ' ')"
    return f"array_distinct(transform(sequence(1, char_length({p}) - 2), i -> substring({p}, i, 3)))"


def _soundex(s):
    """Letters only; vowels, H, W and Y all end a run of equal codes. Runs are cut to one code before the zeros go, so no step is repeated for each letter."""
    letters = f"regexp_replace(upper({s}), '[^A-Z]', '')"
    codes = f"translate({letters}, 'BFPVCGJKQSXZDTLMNRAEIOUHWY', '11112222222233455600000000')"
    runs = f"regexp_replace({codes}, '(.)\\\\1+', '$1')"
    return f"CASE WHEN {letters} = '' THEN '' ELSE rpad(concat(left({letters}, 1), left(replace(substring({runs}, 2), '0', ''), 3)), 4, '0') END"


def _difference(a, b):
    """The two codes are worked out once each, as the variable of a lambda."""
    same = " + ".join(f"CAST(substring(x.a, {i}, 1) = substring(x.b, {i}, 1) AS BIGINT)" for i in range(1, 5))
    return f"transform(array(named_struct('a', {_soundex(a)}, 'b', {_soundex(b)})), x -> {same})[0]"


FUNCTIONS = {
    "levenshtein": "CAST(levenshtein({}, {}) AS BIGINT)".format, "soundex": _soundex,
    "difference": _difference,
    "similarity": lambda a, b: f"CAST(size(array_intersect({_trigrams(a)}, {_trigrams(b)})) AS DOUBLE) / size(array_union({_trigrams(a)}, {_trigrams(b)}))",
    "hamming_distance": lambda a, b: f"aggregate(sequence(1, greatest(char_length({a}), char_length({b}), 1)), 0L, (n, i) -> n + CAST(substring({a}, i, 1) <> substring({b}, i, 1) AS BIGINT))",
}
