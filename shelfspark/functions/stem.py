"""Porter's stemmer for English (1980), for one term at a time."""

from __future__ import annotations

import re
from functools import lru_cache

STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = dict.fromkeys("al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split(), "")


def _kinds(word: str) -> str:
    """c or v for each letter; a y after a consonant is a vowel."""
    out = ""
    for ch in word:
        out += "v" if ch in "aeiou" or (ch == "y" and out[-1:] == "c") else "c"
    return out


def _measure(word: str) -> int:
    return len(re.findall("v+c+", _kinds(word)))


def _short(word: str) -> bool:
    return _kinds(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _replaced(word: str, rules: dict[str, str], least: int) -> str:
    """The longest ending that has a rule decides, whether the rule applies or not."""
    for n in range(min(7, len(word)), 0, -1):
        if (end := word[-n:]) in rules:
            rest = word[:-n]
            return rest + rules[end] if _measure(rest) >= least and (end != "ion" or rest.endswith(("s", "t"))) else word
    return word


@lru_cache(100_000)
def stem(word: str) -> str:
    """Stem of a lower-case term; terms of two letters or fewer, or with anything but a to z, stay as they are."""
    if len(word) < 3 or not re.fullmatch("[a-z]+", word):
        return word
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) else word
    elif (end := next((e for e in ("ed", "ing") if word.endswith(e)), None)) and "v" in _kinds(word[: -len(end)]):
        word = word[: -len(end)]
        if word.endswith(("at", "bl", "iz")) or (_measure(word) == 1 and _short(word)):
            word += "e"
        elif word[-1:] == word[-2:-1] and _kinds(word)[-1] == "c" and word[-1] not in "lsz":
            word = word[:-1]
    if word.endswith("y") and "v" in _kinds(word[:-1]):
        word = word[:-1] + "i"
    word = _replaced(_replaced(_replaced(word, STEP2, 1), STEP3, 1), STEP4, 2)
    if word.endswith("e") and (_measure(word[:-1]) > 1 or (_measure(word[:-1]) == 1 and not _short(word[:-1]))):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word
