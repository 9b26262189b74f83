"""Porter's stemmer as a chain of column expressions over distinct words, in Spark SQL and DuckDB SQL.

A leading y is written Y, so that [aeiouy] is a vowel wherever it stands; with C a consonant run and V a vowel run,
measure > 0 is ^(C)?VC, and so on. Each step is one projection; suffixes are tried in order and the first ends the step.
"""

from __future__ import annotations

import re

from corpuscope.plans.dialect import Dialect

_C = "[^aeiou][^aeiouy]*"
_V = "[aeiouy][aeiou]*"

# Porter's suffixes and replacements, in his order.
STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"),
    ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"),
    ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log"),
)
STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic", "ou")

STEPS = ("1a", "1b", "1c", "2", "3", "4", "5a", "5b")


def stem_ctes(d: Dialect, source: str) -> list[tuple[str, str]]:
    """CTEs p0 .. p9 and stem_dim(word, s1a .. s5b, stem) over source(word)."""
    cut = lambda n: f"substr(w, 1, length(w) - {n})"
    ends = lambda s, w="w": d.ends(w, s)
    m0 = lambda s: d.rx(s, f"^({_C})?{_V}{_C[:8]}")
    m1 = lambda s: d.rx(s, f"^({_C})?{_V}{_C}({_V})?$")
    m2 = lambda s: d.rx(s, f"^({_C})?{_V}{_C}{_V}{_C[:8]}")
    vowel = lambda s: d.rx(s, f"^({_C})?[aeiouy]")
    cvc = lambda s: d.rx(s, "^[^aeiou][^aeiouy]*[aeiouy][^aeiouwxy]$")
    doubles = "|".join(c * 2 for c in "bcdfghjkmnpqrtvwxy")

    def rules(table: tuple[tuple[str, str], ...]) -> str:
        whens = " ".join(f"WHEN {ends(a)} THEN CASE WHEN {m0(cut(len(a)))} THEN concat({cut(len(a))}, '{b}') ELSE w END" for a, b in table)
        return f"CASE {whens} ELSE w END"

    four = []
    for s in STEP4:
        test = m2(cut(len(s)))
        if s == "ion":
            test += f" AND {d.rx(cut(3), '[st]$')}"
        four.append(f"WHEN {ends(s)} THEN CASE WHEN {test} THEN {cut(len(s))} ELSE w END")
    bare = f"CASE WHEN {ends('ed')} AND {vowel(cut(2))} THEN {cut(2)} WHEN {ends('ing')} AND {vowel(cut(3))} THEN {cut(3)} END"
    repair = f"CASE WHEN {d.rx('b', '(at|bl|iz)$')} THEN concat(b, 'e') WHEN {d.rx('b', f'({doubles})$')} THEN substr(b, 1, length(b) - 1) WHEN {m1('b')} AND {cvc('b')} THEN concat(b, 'e') ELSE b END"
    expressions = [
        f"CASE WHEN {ends('sses')} OR {ends('ies')} THEN {cut(2)} WHEN {ends('ss')} THEN w WHEN {ends('s')} THEN {cut(1)} ELSE w END",
        None,
        f"CASE WHEN {ends('y')} AND {vowel(cut(1))} THEN concat({cut(1)}, 'i') ELSE w END",
        rules(STEP2),
        rules(STEP3),
        f"CASE {' '.join(four)} ELSE w END",
        f"CASE WHEN {ends('e')} AND ({m2(cut(1))} OR ({m1(cut(1))} AND NOT {cvc(cut(1))})) THEN {cut(1)} ELSE w END",
        f"CASE WHEN {ends('ll')} AND {m2('w')} THEN {cut(1)} ELSE w END",
    ]
    first = f"SELECT word, CASE WHEN substr(word, 1, 1) = 'y' AND length(word) > 2 THEN concat('Y', substr(word, 2)) ELSE word END AS w FROM {source}"
    out = [("p0", first)]
    done: list[str] = []
    for name, e in zip(STEPS, expressions, strict=True):
        prior = out[-1][0]
        held = "".join(f", s{x}" for x in done)
        if e is None:
            out.append(("p1x", f"SELECT word{held}, w, CASE WHEN {ends('eed')} THEN NULL ELSE {bare} END AS b FROM {prior}"))
            e = f"CASE WHEN length(word) <= 2 THEN w WHEN {ends('eed')} THEN CASE WHEN {m0(cut(3))} THEN {cut(1)} ELSE w END WHEN b IS NOT NULL THEN {repair} ELSE w END"
            prior = "p1x"
        else:
            e = f"CASE WHEN length(word) <= 2 THEN w ELSE {e} END"
        out.append((f"p{name}", f"SELECT word{held}, s{name} AS w, s{name} FROM (SELECT word{held}, {e} AS s{name} FROM {prior}) AS x"))
        done.append(name)
    out.append(("stem_dim", f"SELECT word, {', '.join(f'lower(s{x}) AS s{x}' for x in done)}, lower(w) AS stem FROM {out[-1][0]}"))
    return out


# -- the same steps in Python, for tokens that stay where their document lies ------------------------------------------

_M0, _M1, _M2 = (re.compile(p) for p in (f"({_C})?{_V}{_C[:8]}", f"({_C})?{_V}{_C}({_V})?$", f"({_C})?{_V}{_C}{_V}{_C[:8]}"))
_VOWEL, _CVC = re.compile(f"({_C})?[aeiouy]"), re.compile("[^aeiou][^aeiouy]*[aeiouy][^aeiouwxy]$")
_ENDS = {id(t): tuple(a for a, _ in t) for t in (STEP2, STEP3)}
_REPAIR = tuple(c * 2 for c in "bcdfghjkmnpqrtvwxy")


def _replaced(w: str, table: tuple[tuple[str, str], ...]) -> str:
    if not w.endswith(_ENDS[id(table)]):
        return w
    for a, b in table:
        if w.endswith(a):
            return w[: -len(a)] + b if _M0.match(w[: -len(a)]) else w
    return w


def stem(word: str) -> str:
    """stem_dim's stem of a lower-case word."""
    if len(word) <= 2:
        return word
    w = "Y" + word[1:] if word[0] == "y" else word
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _M0.match(w[:-3]) else w
    else:
        b = w[:-2] if w.endswith("ed") and _VOWEL.match(w[:-2]) else w[:-3] if w.endswith("ing") and _VOWEL.match(w[:-3]) else None
        if b is not None:
            w = b + "e" if b.endswith(("at", "bl", "iz")) else b[:-1] if b.endswith(_REPAIR) else b + "e" if _M1.match(b) and _CVC.match(b) else b
    if w.endswith("y") and _VOWEL.match(w[:-1]):
        w = w[:-1] + "i"
    w = _replaced(_replaced(w, STEP2), STEP3)
    for s in STEP4 if w.endswith(STEP4) else ():
        if w.endswith(s):
            b = w[: -len(s)]
            w = b if _M2.match(b) and (s != "ion" or b.endswith(("s", "t"))) else w
            break
    if w.endswith("e") and (_M2.match(w[:-1]) or (_M1.match(w[:-1]) and not _CVC.match(w[:-1]))):
        w = w[:-1]
    if w.endswith("ll") and _M2.match(w):
        w = w[:-1]
    return w.lower()
