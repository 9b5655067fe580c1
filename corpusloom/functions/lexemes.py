"""Text-search configurations: what becomes of a word before it is stored or asked for.

simple: the word in lower case. english: stop words go, the others are stemmed by the Snowball
English rules. A word keeps its place, also where a stop word before it went.
"""

from __future__ import annotations

import re
from functools import lru_cache

#: The English stop words of the common text-search dictionaries.
STOP_WORDS = frozenset(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers
    herself it its itself they them their theirs themselves what which who whom this that these those am is are
    was were be been being have has had having do does did doing a an the and but if or because as until while of
    at by for with about against between into through during before after above below to from up down in out on
    off over under again further then once here there when where why how all any both each few more most other
    some such no nor not only own same so than too very s t can will just don should now""".split()
)

#: Fixed values of the Snowball English stemmer: whole words that it maps or leaves.
WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"} | {
    w: w for w in ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")
}
LEFT_AFTER_PLURAL = frozenset("inning outing canning herring earring proceed exceed succeed".split())
#: Suffixes of step 2 and 3 and what stands for them, in the first region.
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate",
    "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble",
    "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
#: Suffixes of step 4, which go in the second region.
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")

_REGION = re.compile("[aeiouy][^aeiouy]")
_FIRST = re.compile("gener|commun|arsen")
_SHORT_END = re.compile("(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$")


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


@lru_cache(200_000)
def stem(word: str) -> str:
    """The Snowball English stem of a lower-case word."""
    if len(word) <= 2:
        return word
    if word in WHOLE:
        return WHOLE[word]
    word = re.sub("(^|[aeiouy])y", r"\1Y", word)
    begin = _FIRST.match(word) or _REGION.search(word)
    one = begin.end() if begin else len(word)
    inner = _REGION.search(word, one)
    two = inner.end() if inner else len(word)

    def cut(suffix: str, by: str = "") -> str:
        return word[: len(word) - len(suffix)] + by

    def fits(suffix: str, region: int) -> bool:
        return len(word) - len(suffix) >= region

    def short() -> bool:
        return one >= len(word) and _SHORT_END.search(word) is not None

    # 1a: plurals
    suffix = _longest(word, ("sses", "ied", "ies", "us", "ss", "s"))
    if suffix == "sses":
        word = cut(suffix, "ss")
    elif suffix in ("ied", "ies"):
        word = cut(suffix, "i" if len(word) > 4 else "ie")
    elif suffix == "s" and re.search("[aeiouy].", word[:-1]):
        word = cut(suffix)
    if word in LEFT_AFTER_PLURAL:
        return word
    # 1b: past and participle
    suffix = _longest(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if suffix in ("eed", "eedly"):
        word = cut(suffix, "ee") if fits(suffix, one) else word
    elif suffix and re.search("[aeiouy]", cut(suffix)):
        word = cut(suffix)
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif word.endswith(("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")):
            word = word[:-1]
        elif short():
            word += "e"
    # 1c
    word = re.sub("(?<=.[^aeiouy])[yY]$", "i", word)
    # 2 and 3
    suffix = _longest(word, STEP_2)
    if suffix and fits(suffix, one) and (suffix != "ogi" or word.endswith("logi")) and (suffix != "li" or re.search("[cdeghkmnrt]li$", word)):
        word = cut(suffix, STEP_2[suffix])
    suffix = _longest(word, STEP_3)
    if suffix and fits(suffix, two if suffix == "ative" else one):
        word = cut(suffix, STEP_3[suffix])
    # 4
    suffix = _longest(word, STEP_4)
    if suffix and fits(suffix, two) and (suffix != "ion" or word.endswith(("sion", "tion"))):
        word = cut(suffix)
    # 5
    if word.endswith("e") and (fits("e", two) or fits("e", one) and not _SHORT_END.search(word[:-1])) or word.endswith("ll") and fits("l", two):
        word = word[:-1]
    return word.replace("Y", "y")


def lexeme(word: str, config: str) -> str | None:
    """What a lower-case word is stored as; None for a stop word."""
    if config == "simple":
        return word
    if config == "english":
        return None if word in STOP_WORDS else stem(word)
    raise ValueError(f"unknown text-search configuration {config!r}")
