"""English words as the default text-search configuration of common databases takes them: no stopwords, Snowball stems.

The stemmer follows the published description of the English (Porter 2) algorithm.
"""

from __future__ import annotations

import re
from functools import lru_cache

# The stopwords of the configuration.
STOPWORDS = frozenset(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that these "
    "those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during before after "
    "above below to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s "
    "t can will just don should now".split()
)
# Words that the algorithm takes as they are, and those that it replaces.
_KEPT = frozenset("sky news howe atlas cosmos bias andes".split())
_REPLACED = dict(skis="ski", skies="sky", dying="die", lying="lie", tying="tie", idly="idl", gently="gentl", ugly="ugli", early="earli", only="onli", singly="singl")
_KEPT_LATER = frozenset("inning outing canning herring earring proceed exceed succeed".split())
# Suffixes of the second, third and fourth step.
_SECOND = dict(
    tional="tion", enci="ence", anci="ance", abli="able", entli="ent", izer="ize", ization="ize", ational="ate", ation="ate", ator="ate", alism="al", aliti="al", alli="al", fulness="ful", ousli="ous",
    ousness="ous", iveness="ive", iviti="ive", biliti="ble", bli="ble", ogi="og", fulli="ful", lessli="less", li="",
)
_THIRD = dict(tional="tion", ational="ate", alize="al", icate="ic", iciti="ic", ical="ic", ful="", ness="", ative="")
_FOURTH = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split()

_REGION = re.compile("[aeiouy][^aeiouy]")
_DOUBLE = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_SHORT_END = re.compile("(?:^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$")
_VOWEL = re.compile("[aeiouy]")


def _longest(word: str, suffixes) -> str:
    return max((s for s in suffixes if word.endswith(s)), key=len, default="")


@lru_cache(maxsize=1 << 17)
def stem(word: str) -> str:
    """Stem of a lower-case word."""
    if len(word) <= 2 or word in _KEPT:
        return word
    if word in _REPLACED:
        return _REPLACED[word]
    w = re.sub("(^|[aeiouy])y", r"\1Y", word.removeprefix("'"))
    head = next((p for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    after = lambda i: m.end() if (m := _REGION.search(w, i)) else len(w)
    r1 = len(head) if head else after(0)
    r2 = after(r1)
    for s in ("'s'", "'s", "'"):
        if w.endswith(s):
            w = w[: -len(s)]
            break
    # plurals
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and _VOWEL.search(w[:-2]):
        w = w[:-1]
    if w in _KEPT_LATER:
        return w
    # past forms and participles
    s = _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if s in ("eed", "eedly"):
        if len(w) - len(s) >= r1:
            w = w[: -len(s)] + "ee"
    elif s and _VOWEL.search(w[: -len(s)]):
        w = w[: -len(s)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(_DOUBLE):
            w = w[:-1]
        elif _SHORT_END.search(w) and r1 >= len(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"
    s = _longest(w, _SECOND)
    if s and len(w) - len(s) >= r1 and (s != "ogi" or w[-4:-3] == "l") and (s != "li" or w[-3:-2] in tuple("cdeghkmnrt")):
        w = w[: -len(s)] + _SECOND[s]
    s = _longest(w, _THIRD)
    if s and len(w) - len(s) >= (r2 if s == "ative" else r1):
        w = w[: -len(s)] + _THIRD[s]
    s = _longest(w, _FOURTH)
    if s and len(w) - len(s) >= r2 and (s != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(s)]
    if w.endswith("e"):
        if len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _SHORT_END.search(w[:-1]):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def lexemes(words: list[str]) -> list[str]:
    """The stems of the words that are no stopwords, in order."""
    return [stem(w) for w in words if w not in STOPWORDS]
