"""The Porter stemming algorithm (M. F. Porter, 1980), after the published description."""

from __future__ import annotations

import re

_C, _V = "[^aeiou]", "[aeiouy]"
_CC, _VV = f"{_C}(?:[^aeiouy])*", f"{_V}(?:[aeiou])*"
_M0 = re.compile(f"^(?:{_CC})?{_VV}{_CC}")
_M1 = re.compile(f"^(?:{_CC})?{_VV}{_CC}(?:{_VV})?$")
_M2 = re.compile(f"^(?:{_CC})?{_VV}{_CC}{_VV}{_CC}")
_VOWEL = re.compile(f"^(?:{_CC})?{_V}")
_CVC = re.compile(f"^{_CC}{_V}[^aeiouwxy]$")
#: Suffixes of the algorithm's second, third and fourth steps.
_STEP2 = dict(x.split("-") for x in "ational-ate tional-tion enci-ence anci-ance izer-ize bli-ble alli-al entli-ent eli-e ousli-ous ization-ize ation-ate ator-ate alism-al iveness-ive fulness-ful ousness-ous aliti-al iviti-ive biliti-ble logi-log".split())
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize".split()


def _suffix(word: str, suffixes) -> str:  # noqa: ANN001
    return max((s for s in suffixes if word.endswith(s)), key=len, default="")


def stem(word: str) -> str:
    """The stem of a word in lower case; words of other scripts and up to two letters stay."""
    if len(word) <= 2 or not word.isascii() or not word.isalpha():
        return word
    w = word
    if w.endswith("s"):
        w = w[:-2] if w.endswith(("sses", "ies")) else w if w.endswith("ss") else w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _M0.match(w[:-3]) else w
    elif (s := _suffix(w, ("ed", "ing"))) and _VOWEL.match(w[: -len(s)]):
        w = w[: -len(s)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif len(w) > 1 and w[-1] == w[-2] and w[-1] not in "aeioulsz":
            w = w[:-1]
        elif _M1.match(w) and _CVC.match(w):
            w += "e"
    if w.endswith("y") and _VOWEL.match(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        if (s := _suffix(w, table)) and _M0.match(w[: -len(s)]):
            w = w[: -len(s)] + table[s]
    if (s := _suffix(w, _STEP4)):
        if _M2.match(w[: -len(s)]):
            w = w[: -len(s)]
    elif w.endswith("ion") and w[-4:-3] in ("s", "t") and _M2.match(w[:-3]):
        w = w[:-3]
    if w.endswith("e") and (_M2.match(w[:-1]) or (_M0.match(w[:-1]) and not (_M1.match(w[:-1]) and _CVC.match(w[:-1])))):
        w = w[:-1]
    if w.endswith("ll") and _M2.match(w):
        w = w[:-1]
    return w
