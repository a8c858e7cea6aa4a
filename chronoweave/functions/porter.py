"""Porter's stemmer (M. F. Porter, 1980), by his definition of a word's measure, and the same as SQL over a vocabulary."""

from __future__ import annotations

from functools import lru_cache

# The suffixes of the published algorithm.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate",
    "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _kinds(w: str) -> str:
    """v or c for each letter; y is a vowel after a consonant."""
    out = ""
    for i, x in enumerate(w):
        out += "v" if x in "aeiou" or (x == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(w: str) -> int:
    return _kinds(w).count("vc")


def _short_end(w: str) -> bool:
    """Consonant, vowel, consonant other than w, x, y at the end."""
    return len(w) > 2 and _kinds(w)[-3:] == "cvc" and w[-1] not in "wxy"


def _longest(w: str, suffixes) -> str | None:
    return max((s for s in suffixes if w.endswith(s) and len(w) > len(s)), key=len, default=None)


@lru_cache(maxsize=200_000)
def stem(w: str) -> str:
    """The stem of a word in lower case; of up to two letters, the word."""
    if len(w) < 3:
        return w
    if w.endswith("sses") or (w.endswith("ies") and len(w) > 3):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    elif end := _longest(w, ("ed", "ing")):
        rest = w[: -len(end)]
        if "v" in _kinds(rest):
            w = rest
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif len(w) > 1 and w[-1] == w[-2] and _kinds(w)[-1] == "c" and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _short_end(w):
                w += "e"
    if w.endswith("y") and "v" in _kinds(w[:-1]):
        w = w[:-1] + "i"
    for table in (STEP_2, STEP_3):
        if (end := _longest(w, table)) and _measure(w[: -len(end)]) > 0:
            w = w[: -len(end)] + table[end]
    if (end := _longest(w, STEP_4)) and _measure(rest := w[: -len(end)]) > 1 and (end != "ion" or rest.endswith(("s", "t"))):
        w = rest
    if w.endswith("e") and ((m := _measure(w[:-1])) > 1 or (m == 1 and not _short_end(w[:-1]))):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w) > 1 else w


def stems_sql(vocabulary: str, prefix: str = "st") -> str:
    """CTEs for DuckDB that end in {prefix}(term, stem) for the terms of a CTE; letters are told apart by regular expressions, one step a CTE."""
    c, v = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
    some, one, more, vowel = f"^({c})?{v}{c}", f"^({c})?{v}{c}({v})?$", f"^({c})?{v}{c}{v}{c}", f"^({c})?[aeiouy]"
    short = f"^{c}[aeiouy][^aeiouwxy]$"
    m = lambda x, r: f"regexp_matches({x}, '{r}')"

    def table(x: str, t: dict[str, str]) -> str:
        p = f"^(.+?)({'|'.join(t)})$"
        rest = f"regexp_extract({x}, '{p}', 1)"
        new = "CASE " + f"regexp_extract({x}, '{p}', 2) " + " ".join(f"WHEN '{k}' THEN '{r}'" for k, r in t.items()) + " END"
        return f"CASE WHEN {m(x, p)} AND {m(rest, some)} THEN {rest} || {new} ELSE {x} END"

    cut = "regexp_extract(w, '^(.+?)(ed|ing)$', 1)"
    four = f"^(.+?)({'|'.join(STEP_4)})$"
    rest4 = f"regexp_extract(w, '{four}', 1)"
    steps = [
        "SELECT term, CASE WHEN term[1] = 'y' THEN 'Y' || term[2:] ELSE term END AS w FROM " + vocabulary,
        "SELECT term, CASE WHEN w LIKE '%sses' OR w LIKE '_%ies' THEN w[:-3] WHEN w LIKE '%s' AND w NOT LIKE '%ss' THEN w[:-2] ELSE w END AS w FROM {0}",
        f"SELECT term, w, CASE WHEN w LIKE '_%eed' THEN CASE WHEN {m('w[:-4]', some)} THEN w[:-2] ELSE w END WHEN {m('w', '^(.+?)(ed|ing)$')} AND {m(cut, vowel)} AND w NOT LIKE '_%eed' THEN NULL ELSE w END AS k FROM {{0}}",
        "SELECT term, coalesce(k, regexp_extract(w, '^(.+?)(ed|ing)$', 1)) AS w, k IS NULL AS cut FROM {0}",
        f"SELECT term, CASE WHEN NOT cut THEN w WHEN {m('w', '(at|bl|iz)$')} THEN w || 'e' WHEN {m('w', '(bb|cc|dd|ff|gg|hh|jj|kk|mm|nn|pp|qq|rr|tt|vv|ww|xx|00|11|22|33|44|55|66|77|88|99)$')} THEN w[:-2] WHEN {m('w', short)} THEN w || 'e' ELSE w END AS w FROM {{0}}",
        f"SELECT term, CASE WHEN w LIKE '_%y' AND {m('w[:-2]', vowel)} THEN w[:-2] || 'i' ELSE w END AS w FROM {{0}}",
        f"SELECT term, {table('w', STEP_2)} AS w FROM {{0}}",
        f"SELECT term, {table('w', STEP_3)} AS w FROM {{0}}",
        f"SELECT term, CASE WHEN {m('w', four)} AND {m(rest4, more)} AND (regexp_extract(w, '{four}', 2) <> 'ion' OR {m(rest4, '[st]$')}) THEN {rest4} ELSE w END AS w FROM {{0}}",
        f"SELECT term, CASE WHEN w LIKE '_%e' AND ({m('w[:-2]', more)} OR ({m('w[:-2]', one)} AND NOT {m('w[:-2]', short)})) THEN w[:-2] ELSE w END AS w FROM {{0}}",
        f"SELECT term, CASE WHEN length(term) < 3 THEN term ELSE lower(CASE WHEN w LIKE '%ll' AND {m('w', more)} THEN w[:-2] ELSE w END) END AS stem FROM {{0}}",
    ]
    names = [f"{prefix}{i}" for i in range(len(steps) - 1)] + [prefix]
    return ", ".join(f"{name} AS ({sql.format(names[i - 1] if i else '')})" for i, (name, sql) in enumerate(zip(names, steps)))
