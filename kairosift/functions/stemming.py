"""Stems of English words, by the published rules of the second Porter stemmer; a word is stemmed once, in the vocabulary."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

# The rules' vowels, exceptions and endings, each step's in the order of the rules.
_VOWEL = "aeiouy"
_WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_KEPT = frozenset("inning outing canning herring earring proceed exceed succeed".split())
_STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al",
    "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less",
}
_STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize".split()

_REGION = re.compile(rf"[{_VOWEL}][^{_VOWEL}]")
_SHORT = re.compile(rf"(?:(?:^|.*[^{_VOWEL}])[{_VOWEL}][^{_VOWEL}wxY]|[{_VOWEL}][^{_VOWEL}])$")
_STEM_VOWEL = re.compile(f"[{_VOWEL}]")


def _regions(word: str) -> tuple[int, int]:
    """Where the parts begin in which endings may go."""
    start = next((len(p) for p in ("gener", "commun", "arsen") if word.startswith(p)), None)
    if start is None:
        found = _REGION.search(word)
        start = found.end() if found else len(word)
    found = _REGION.search(word, start)
    return start, found.end() if found else len(word)


def _short_end(word: str) -> bool:
    return _SHORT.match(word) is not None


def _longest(word: str, endings) -> str:
    return max((e for e in endings if word.endswith(e)), key=len, default="")


def _plural(word: str) -> str:
    if word.endswith("sses"):
        return word[:-2]
    if word.endswith(("ied", "ies")):
        return word[:-2] if len(word) > 4 else word[:-1]
    if word.endswith("s") and not word.endswith(("us", "ss")) and _STEM_VOWEL.search(word[:-2]):
        return word[:-1]
    return word


def _past(word: str, r1: int) -> str:
    ending = _longest(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    rest = word[: len(word) - len(ending)]
    if ending.startswith("eed"):
        return rest + "ee" if len(rest) >= r1 else word
    if not ending or not _STEM_VOWEL.search(rest):
        return word
    if rest.endswith(("at", "bl", "iz")):
        return rest + "e"
    if rest[-2:] in ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt"):
        return rest[:-1]
    return rest + "e" if len(rest) <= r1 and _short_end(rest) else rest


def _derived(word: str, r1: int, r2: int) -> str:
    ending = _longest(word, (*_STEP2, "ogi", "li"))
    rest = word[: len(word) - len(ending)]
    if ending and len(rest) >= r1:
        if ending == "ogi":
            word = rest + "og" if rest.endswith("l") else word
        elif ending == "li":
            word = rest if rest[-1:] in tuple("cdeghkmnrt") else word
        else:
            word = rest + _STEP2[ending]
    ending = _longest(word, (*_STEP3, "ative"))
    rest = word[: len(word) - len(ending)]
    if ending and len(rest) >= (r2 if ending == "ative" else r1):
        word = rest + _STEP3.get(ending, "")
    ending = _longest(word, (*_STEP4, "ion"))
    rest = word[: len(word) - len(ending)]
    if ending and len(rest) >= r2 and (ending != "ion" or rest.endswith(("s", "t"))):
        word = rest
    return word


def stem(word: str) -> str:
    """The stem of a lower-case word; words with anything but a-z and apostrophes are their own."""
    if len(word) < 3 or not re.fullmatch("[a-z']+", word):
        return word
    word = word.lstrip("'")
    if word in _WHOLE:
        return _WHOLE[word]
    word = re.sub(rf"(^|[{_VOWEL}])y", r"\1Y", word)
    r1, r2 = _regions(word)
    word = _plural(re.sub(r"('s'|'s|')$", "", word))
    if word in _KEPT:
        return word
    word = _past(word, r1)
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in _VOWEL:
        word = word[:-1] + "i"
    word = _derived(word, r1, r2)
    if word.endswith("e") and (len(word) > r2 or len(word) > r1 and not _short_end(word[:-1])):
        word = word[:-1]
    elif word.endswith("ll") and len(word) > r2:
        word = word[:-1]
    return word.replace("Y", "y")


def stemmed(words: DataFrame) -> DataFrame:
    """(term, stem) of the different words in ``words`` (term)."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([stem(w) for w in batch.column(0).to_pylist()], pa.string())], names=["term", "stem"])

    return words.select("term").where("term is not null").distinct().mapInArrow(run, "term string, stem string")
