"""The suffix-stripping algorithm published by M. F. Porter in 1980."""

from __future__ import annotations

import re


def _shape(word: str) -> str:
    """The word as a string of v and c: y counts as a vowel after a consonant."""
    shape = ""
    for i, char in enumerate(word):
        vowel = char in "aeiou" or (char == "y" and i > 0 and shape[-1] == "c")
        shape += "v" if vowel else "c"
    return shape


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _has_vowel(stem: str) -> bool:
    return "v" in _shape(stem)


def _double_consonant(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _short_syllable(word: str) -> bool:
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


# The suffix rules of the published algorithm, longest suffix first.
STEP_2 = (
    ("ational", "ate"), ("ization", "ize"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"),
    ("tional", "tion"), ("biliti", "ble"), ("entli", "ent"), ("ousli", "ous"), ("ation", "ate"),
    ("alism", "al"), ("aliti", "al"), ("iviti", "ive"), ("enci", "ence"), ("anci", "ance"),
    ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("ator", "ate"), ("eli", "e"),
)
STEP_3 = (
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ness", ""), ("ful", ""),
)
STEP_4 = (
    "ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ion", "ism",
    "ate", "iti", "ous", "ive", "ize", "al", "er", "ic", "ou",
)


# One C-level test decides for most words that no rule of a step applies.
ENDS_2 = tuple(suffix for suffix, _ in STEP_2)
ENDS_3 = tuple(suffix for suffix, _ in STEP_3)


def _replace(word: str, rules, ends: tuple[str, ...]) -> str:
    if not word.endswith(ends):
        return word
    for suffix, replacement in rules:
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            return stem + replacement if _measure(stem) > 0 else word
    return word


def stem(word: str) -> str:
    if len(word) <= 2:
        return word

    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]

    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    elif word.endswith(("ed", "ing")):
        for suffix in ("ed", "ing"):
            base = word[: -len(suffix)]
            if word.endswith(suffix) and _has_vowel(base):
                word = base
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif _double_consonant(word) and word[-1] not in "lsz":
                    word = word[:-1]
                elif _measure(word) == 1 and _short_syllable(word):
                    word += "e"
                break

    if word.endswith("y") and _has_vowel(word[:-1]):
        word = word[:-1] + "i"

    word = _replace(_replace(word, STEP_2, ENDS_2), STEP_3, ENDS_3)

    for suffix in STEP_4 if word.endswith(STEP_4) else ():
        if word.endswith(suffix):
            base = word[: -len(suffix)]
            if _measure(base) > 1 and (suffix != "ion" or base.endswith(("s", "t"))):
                word = base
            break

    if word.endswith("e"):
        base = word[:-1]
        if _measure(base) > 1 or (_measure(base) == 1 and not _short_syllable(base)):
            word = base
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word
