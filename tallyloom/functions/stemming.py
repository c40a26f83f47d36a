"""Suffix stripping after Porter (1980), with the usual later extensions, for single words."""

from __future__ import annotations

from functools import lru_cache

# Words with their own stem.
IRREGULAR = {
    "skies": "sky",
    "sky": "sky",
    "dying": "die",
    "lying": "lie",
    "tying": "tie",
    "news": "news",
    "innings": "inning",
    "inning": "inning",
    "outings": "outing",
    "outing": "outing",
    "cannings": "canning",
    "canning": "canning",
    "howe": "howe",
    "proceed": "proceed",
    "exceed": "exceed",
    "succeed": "succeed",
}
# Suffix tables of the published algorithm, in test order.
STEP_2 = (
    ("ational", "ate"),
    ("tional", "tion"),
    ("enci", "ence"),
    ("anci", "ance"),
    ("izer", "ize"),
    ("bli", "ble"),
    ("alli", "al"),
    ("entli", "ent"),
    ("eli", "e"),
    ("ousli", "ous"),
    ("ization", "ize"),
    ("ation", "ate"),
    ("ator", "ate"),
    ("alism", "al"),
    ("iveness", "ive"),
    ("fulness", "ful"),
    ("ousness", "ous"),
    ("aliti", "al"),
    ("iviti", "ive"),
    ("biliti", "ble"),
    ("fulli", "ful"),
)
STEP_3 = (
    ("icate", "ic"),
    ("ative", ""),
    ("alize", "al"),
    ("iciti", "ic"),
    ("ical", "ic"),
    ("ful", ""),
    ("ness", ""),
)
STEP_4 = (
    "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()
)


def _shape(word: str) -> str:
    """The word as a string of c (consonant) and v (vowel)."""
    out = ""
    for i, ch in enumerate(word):
        vowel = ch in "aeiou" or (ch == "y" and i > 0 and out[-1] == "c")
        out += "v" if vowel else "c"
    return out


def _measure(word: str) -> int:
    return _shape(word).count("vc")


def _short_end(word: str) -> bool:
    shape = _shape(word)
    if len(word) == 2:
        return shape == "vc"
    return shape.endswith("cvc") and word[-1] not in "wxy"


def _double_end(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


# most words have none of the endings of a step
ENDS_2, ENDS_3, ENDS_4 = tuple(old for old, _ in STEP_2), tuple(old for old, _ in STEP_3), tuple(STEP_4)


def _swap(word: str, table, ends: tuple) -> str:
    if not word.endswith(ends):
        return word
    for old, new in table:
        if word.endswith(old):
            base = word[: -len(old)]
            return base + new if _measure(base) > 0 else word
    return word


def _plural(word: str) -> str:
    if word.endswith("ies") and len(word) == 4:
        return word[:-1]
    if word.endswith(("sses", "ies")):
        return word[:-2]
    if word.endswith("s") and not word.endswith("ss"):
        return word[:-1]
    return word


def _past(word: str) -> str:
    if not word.endswith(("ed", "ing")):
        return word
    if word.endswith("ied"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    for end in ("ed", "ing"):
        base = word[: -len(end)]
        if word.endswith(end) and "v" in _shape(base):
            break
    else:
        return word
    if base.endswith(("at", "bl", "iz")):
        return base + "e"
    if _double_end(base):
        return base if base[-1] in "lsz" else base[:-1]
    return base + "e" if _measure(base) == 1 and _short_end(base) else base


def _final_y(word: str) -> str:
    if word.endswith("y") and len(word) > 2 and _shape(word[:-1])[-1] == "c":
        return word[:-1] + "i"
    return word


def _derived(word: str) -> str:
    if word.endswith("alli") and _measure(word[:-4]) > 0:
        return _derived(word[:-2])
    if word.endswith("logi") and _measure(word[:-3]) > 0:
        return word[:-1]
    return _swap(word, STEP_2, ENDS_2)


def _drop_ending(word: str) -> str:
    if not word.endswith(ENDS_4):
        return word
    for end in STEP_4:
        if word.endswith(end):
            base = word[: -len(end)]
            fits = _measure(base) > 1 and (end != "ion" or base[-1] in "st")
            return base if fits else word
    return word


def _final_e(word: str) -> str:
    if word.endswith("e"):
        base = word[:-1]
        if _measure(base) > 1 or (_measure(base) == 1 and not _short_end(base)):
            word = base
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word


@lru_cache(maxsize=1 << 16)
def stem_word(word: str) -> str:
    """The stem of a lower-case word."""
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) <= 2:
        return word
    word = _final_y(_past(_plural(word)))
    return _final_e(_drop_ending(_swap(_derived(word), STEP_3, ENDS_3)))
