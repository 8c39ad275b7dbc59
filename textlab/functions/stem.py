"""Porter stemmer (M. F. Porter, "An algorithm for suffix stripping", 1980).

A small per-token helper; the Spark job stems each *distinct* token once
(see ``textlab.operators.scoring.stem_table``).
"""

from __future__ import annotations

from functools import lru_cache

# --- fixed values: the suffix rules of the published algorithm ---------------
STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"),
         ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
         ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"),
         ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""),
         ("ness", "")]
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou",
         "ism", "ate", "iti", "ous", "ive", "ize"]
# -----------------------------------------------------------------------------

_STEP2 = sorted(STEP2, key=lambda t: -len(t[0]))
_STEP3 = sorted(STEP3, key=lambda t: -len(t[0]))
_STEP4 = sorted(STEP4, key=len, reverse=True)


def _is_cons(w: str, i: int) -> bool:
    c = w[i]
    if c in "aeiou":
        return False
    if c == "y":
        return i == 0 or not _is_cons(w, i - 1)
    return True


def _measure(s: str) -> int:
    n, i, k = 0, 0, len(s)
    while i < k and _is_cons(s, i):
        i += 1
    while i < k:
        while i < k and not _is_cons(s, i):
            i += 1
        if i >= k:
            break
        while i < k and _is_cons(s, i):
            i += 1
        n += 1
    return n


def _has_vowel(s: str) -> bool:
    return any(not _is_cons(s, i) for i in range(len(s)))


def _double_cons(s: str) -> bool:
    return len(s) >= 2 and s[-1] == s[-2] and _is_cons(s, len(s) - 1)


def _cvc(s: str) -> bool:
    k = len(s)
    return (k >= 3 and _is_cons(s, k - 3) and not _is_cons(s, k - 2) and _is_cons(s, k - 1)
            and s[-1] not in "wxy")


def _rules(w: str, rules, min_m: int) -> str:
    for suf, rep in rules:
        if w.endswith(suf):
            stem = w[: len(w) - len(suf)]
            return stem + rep if _measure(stem) > min_m else w
    return w


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    w = word
    if len(w) <= 2:
        return w
    # step 1a
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("ss"):
        pass
    elif w.endswith("s"):
        w = w[:-1]
    # step 1b
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        for suf in ("ed", "ing"):
            if w.endswith(suf) and _has_vowel(w[: -len(suf)]):
                w = w[: -len(suf)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif _double_cons(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _cvc(w):
                    w += "e"
                break
    # step 1c
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    w = _rules(w, _STEP2, 0)
    w = _rules(w, _STEP3, 0)
    # step 4
    for suf in _STEP4:
        if w.endswith(suf):
            stem_ = w[: len(w) - len(suf)]
            if _measure(stem_) > 1 and (suf != "ion" or stem_.endswith(("s", "t"))):
                w = stem_
            break
    # step 5a
    if w.endswith("e"):
        s = w[:-1]
        m = _measure(s)
        if m > 1 or (m == 1 and not _cvc(s)):
            w = s
    # step 5b
    if _measure(w) > 1 and _double_cons(w) and w.endswith("l"):
        w = w[:-1]
    return w
