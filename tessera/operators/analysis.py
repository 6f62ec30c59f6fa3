"""Analysis of English text for an index: words, stop words, stems, and lengths in one byte."""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = re.compile(r"\w+(?:['’]\w+)*")

# English words that an index leaves out.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or", "such", "that",
    "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with",
)

# Endings of the stemmer (Porter 1980, with the author's later changes "bli" and "logi") and what replaces them.
DOUBLE_ENDINGS = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"),
    ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"),
    ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log"),
)
MIDDLE_ENDINGS = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
LAST_ENDINGS = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")

_ENDS = {endings: tuple(e for e, _ in endings) for endings in (DOUBLE_ENDINGS, MIDDLE_ENDINGS)}
_RUNS = re.compile("v+c+")


def _shape(word: str) -> str:
    """c for each consonant and v for each vowel; y is a vowel after a consonant."""
    shape = ""
    for letter in word:
        shape += "v" if letter in "aeiou" or (letter == "y" and shape[-1:] == "c") else "c"
    return shape


def _measure(word: str) -> int:
    """How often a vowel is followed by a consonant."""
    return len(_RUNS.findall(_shape(word)))


def _short_end(word: str) -> bool:
    """Consonant, vowel, consonant other than w, x, y at the end."""
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _replaced(word: str, endings: tuple[tuple[str, str], ...]) -> str:
    """The longest ending that fits is replaced if a measured stem remains."""
    if word.endswith(_ENDS[endings]):
        fits = [e for e in endings if word.endswith(e[0])]
        ending, new = max(fits, key=lambda e: len(e[0]))
        if _measure(word[: -len(ending)]) > 0:
            return word[: -len(ending)] + new
    return word


def _plural(word: str) -> str:
    if word.endswith(("sses", "ies")):
        return word[:-2]
    return word[:-1] if word.endswith("s") and not word.endswith("ss") else word


def _past(word: str) -> str:
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    ending = next((e for e in ("ed", "ing") if word.endswith(e)), None)
    if ending is None or "v" not in _shape(word[: -len(ending)]):
        return word
    word = word[: -len(ending)]
    if word.endswith(("at", "bl", "iz")):
        return word + "e"
    if len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c":
        return word if word[-1] in "lsz" else word[:-1]
    return word + "e" if _measure(word) == 1 and _short_end(word) else word


def _without_last(word: str) -> str:
    if not word.endswith(LAST_ENDINGS):
        return word
    ending = max((e for e in LAST_ENDINGS if word.endswith(e)), key=len)
    rest = word[: -len(ending)]
    if _measure(rest) > 1 and (ending != "ion" or rest.endswith(("s", "t"))):
        return rest
    return word


def _final(word: str) -> str:
    if word.endswith("e") and (_measure(word[:-1]) > 1 or (_measure(word[:-1]) == 1 and not _short_end(word[:-1]))):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word[:-1]) > 1 else word


@functools.lru_cache(maxsize=1 << 18)
def stem(word: str) -> str:
    """Porter's stem of a word in lower case."""
    if len(word) < 3:
        return word
    word = _past(_plural(word))
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    return _final(_without_last(_replaced(_replaced(word, DOUBLE_ENDINGS), MIDDLE_ENDINGS)))


def term_of(word: str, stems: bool = True, stop: frozenset[str] = frozenset(STOP_WORDS)) -> str | None:
    """The term of a word in lower case, without possessive s; None for a stop word."""
    if word.endswith(("'s", "’s")):
        word = word[:-2]
    if word in stop:
        return None
    return stem(word) if stems else word


def analyse(text: str, stems: bool = True, stop: frozenset[str] = frozenset(STOP_WORDS)) -> list[tuple[int, str]]:
    """(position, term) of a text: words in lower case without possessive s, stop words left out but counted as places."""
    terms = ((at, term_of(word, stems, stop)) for at, word in enumerate(WORD.findall(text.lower())))
    return [(at, term) for at, term in terms if term is not None]


def coded_length(length: Column) -> Column:
    """The length that one byte keeps: exact below 40, then its four highest bits above 24."""
    over = length - 24
    shift = F.greatest(F.length(F.bin(F.greatest(over, F.lit(0)))) - 4, F.lit(0))
    power = F.pow(F.lit(2.0), shift).cast("bigint")
    return F.when(length < 24, length).otherwise(24 + F.floor(over / power) * power).cast("int")


def coded_length_of(length: int) -> int:
    """coded_length of one number."""
    if length < 24:
        return length
    shift = max((length - 24).bit_length() - 4, 0)
    return 24 + (length - 24 >> shift << shift)
