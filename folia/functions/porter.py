"""Stemming of English words after Porter (1980), "An algorithm for suffix stripping".

A word is a string over c (consonant) and v (vowel); its measure m counts vc in that string. Steps
are tables of (suffix, replacement) with a condition on the stem, the longest suffix that fits is
tried alone. Words with characters beyond a-z, or of fewer than three, are left as they are.
"""

from __future__ import annotations

import re

# The published suffixes of steps 2, 3 and 4.
STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"),
    ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"),
    ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def shape(word: str) -> str:
    out = ""
    for i, c in enumerate(word):
        vowel = c in "aeiou" or (c == "y" and i > 0 and out[-1] == "c")
        out += "v" if vowel else "c"
    return out


def measure(stem: str) -> int:
    return len(re.findall("v+c+", shape(stem)))


def _short(stem: str) -> bool:
    """consonant, vowel, consonant, the last not w, x or y."""
    return shape(stem)[-3:] == "cvc" and len(stem) >= 3 and stem[-1] not in "wxy"


def _double(stem: str) -> bool:
    return len(stem) > 1 and stem[-1] == stem[-2] and shape(stem)[-1] == "c"


def _replace(word: str, table, least: int) -> str:
    for suffix, new in sorted(table, key=lambda x: -len(x[0])):
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            return stem + new if measure(stem) > least else word
    return word


def stem(word: str) -> str:
    if word is None or len(word) < 3 or not re.fullmatch("[a-z]+", word):
        return word
    for suffix, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(suffix):
            word = word[: -len(suffix)] + new
            break
    if word.endswith("eed"):
        word = word[:-1] if measure(word[:-3]) > 0 else word
    else:
        for suffix in ("ed", "ing"):
            if word.endswith(suffix):
                left = word[: -len(suffix)]
                if "v" in shape(left):
                    word = left
                    if word.endswith(("at", "bl", "iz")):
                        word += "e"
                    elif _double(word) and word[-1] not in "lsz":
                        word = word[:-1]
                    elif measure(word) == 1 and _short(word):
                        word += "e"
                break
    if word.endswith("y") and "v" in shape(word[:-1]):
        word = word[:-1] + "i"
    word = _replace(word, STEP2, 0)
    word = _replace(word, STEP3, 0)
    for suffix in sorted(STEP4, key=len, reverse=True):
        if word.endswith(suffix):
            left = word[: -len(suffix)]
            if measure(left) > 1 and (suffix != "ion" or left.endswith(("s", "t"))):
                word = left
            break
    if word.endswith("e"):
        m = measure(word[:-1])
        if m > 1 or (m == 1 and not _short(word[:-1])):
            word = word[:-1]
    if measure(word) > 1 and word.endswith("ll"):
        word = word[:-1]
    return word
