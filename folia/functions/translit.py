"""Roman input to Devanagari, and spelling variants of Devanagari words, at query-writing time."""

from __future__ import annotations

import re

VIRAMA, ANUSVARA = "्", "ं"
# Roman letters and the consonant they write.
CONSONANTS = {
    "ksh": "क्ष", "gy": "ज्ञ", "chh": "छ", "kh": "ख", "gh": "घ", "ch": "च", "jh": "झ", "Th": "ठ", "Dh": "ढ", "th": "थ", "dh": "ध", "ph": "फ",
    "bh": "भ", "Sh": "ष", "sh": "श", "ng": "ङ", "T": "ट", "D": "ड", "N": "ण", "k": "क", "g": "ग", "c": "च", "j": "ज", "t": "त", "d": "द",
    "n": "न", "p": "प", "f": "फ", "b": "ब", "m": "म", "y": "य", "r": "र", "l": "ल", "v": "व", "w": "व", "s": "स", "h": "ह",
}
# Roman letters, the vowel by itself, the sign after a consonant.
VOWELS = {
    "aa": ("आ", "ा"), "au": ("औ", "ौ"), "ai": ("ऐ", "ै"), "ee": ("ई", "ी"), "ii": ("ई", "ी"), "oo": ("ऊ", "ू"), "uu": ("ऊ", "ू"), "ri": ("ऋ", "ृ"),
    "a": ("अ", ""), "i": ("इ", "ि"), "u": ("उ", "ु"), "e": ("ए", "े"), "o": ("ओ", "ो"), "M": ("ं", "ं"),
}
_UNITS = re.compile("|".join(sorted(VOWELS, key=lambda x: -len(x))) + "|" + "|".join(sorted(CONSONANTS, key=lambda x: -len(x))) + r"|\s+|.", re.S)
_CONSONANT = "[क-हक़-य़]"
_NASALS = (("क-ङ", "ङ"), ("च-ञ", "ञ"), ("ट-ण", "ण"), ("त-न", "न"), ("प-म", "म"))


def to_devanagari(text: str) -> str:
    """Longest match, vowels first; consonants that meet are joined by a virama."""
    out, after = [], False
    for unit in _UNITS.findall(text):
        if unit in VOWELS:
            out.append(VOWELS[unit][after])
            after = False
        elif unit in CONSONANTS:
            out.append(VIRAMA * after + CONSONANTS[unit])
            after = True
        else:
            out.append(unit)
            after = False
    return "".join(out)


def nasal_variants(word: str) -> list[str]:
    """The word; nasals with virama as anusvara; a final nasal as anusvara; anusvara as nasals."""
    spelled = word
    for group, nasal in _NASALS:
        spelled = re.sub(f"{ANUSVARA}(?=[{group}])", nasal + VIRAMA, spelled)
    found = (word, re.sub(f"[ङञणनम]{VIRAMA}", ANUSVARA, word), re.sub("[नम]$", ANUSVARA, word), spelled)
    return list(dict.fromkeys(found))


def vowel_variants(word: str) -> list[str]:
    """The word; long a after a conjunct before a bare consonant; short and long i, u exchanged."""
    swap = [(a, b) for pair in (("ि", "ी"), ("ु", "ू")) for a, b in (pair, pair[::-1])]
    found = (word, re.sub(f"(?<={VIRAMA}{_CONSONANT})(?={_CONSONANT})", "ा", word), *(word.replace(a, b) for a, b in swap))
    return list(dict.fromkeys(found))


def variant_query(text: str) -> str:
    """Each word as a group of its spellings, groups joined by AND."""
    groups = []
    for word in text.split():
        forms = list(dict.fromkeys(n for v in vowel_variants(word) for n in nasal_variants(v)))
        groups.append(f"({' OR '.join(forms)})" if len(forms) > 1 else forms[0])
    return " AND ".join(groups)


def has_devanagari(text: str) -> bool:
    return re.search("[ऀ-ॿ]", text) is not None


def author_query(text: str, mode: str = "all", distance: int = 30, exact: bool = False, language: str = "", roman_input: bool = False) -> str:
    """What the search box sends. mode: all, phrase or near."""
    if roman_input and not has_devanagari(text) and language.lower() != "english":
        text = to_devanagari(text)
    words = text.split()
    if mode == "near" and len(words) > 1:
        return f"NEAR({' '.join(words)}, {max(0, distance)})"
    if not exact and has_devanagari(text) and (mode == "all" or (mode == "phrase" and len(words) == 1)):
        return variant_query(text)
    if mode == "phrase":
        return text if re.match(r"^\s*\(.*\)\s*$", text) else '"' + text.replace('"', "") + '"'
    return text
