"""Tokens, stop words and stems, as column expressions where Spark has them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The English stop words.
STOP_WORDS = frozenset(
    """
    a about above after again against all am an and are as at be because been before being below between both but by
    can could did do does doing down during each few for from further had has have having he her here hers herself him
    himself his how i if in into is it its itself just may me might more most must my myself no nor not of off on once
    only or other our ours ourselves out over own same shall she should so some such than that the their theirs them
    themselves then there these they this those through to too under until up very was we were what when where which
    while who whom why will with would you your yours yourself yourselves
    """.split()
)


def tokens(text: Column) -> Column:
    """The words of a text in order: split at white space, characters other than letters and digits taken out of each
    word, lower case, empty words dropped. Null gives null, a text without words an empty array."""
    return F.filter(F.split(F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}\s]", "")), r"\s+"), lambda w: w != "")


def without_stop_words(words: Column, stop: frozenset[str] = STOP_WORDS) -> Column:
    """The words that are no stop words, order and repetition kept."""
    return F.filter(words, lambda w: ~w.isin(*sorted(stop))) if stop else words


_VOWELS = "aeiou"


def _shape(word: str) -> str:
    """v or c for each letter; y is a vowel after a consonant."""
    out = ""
    for ch in word:
        vowel = ch in _VOWELS or (ch == "y" and out.endswith("c"))
        out += "v" if vowel else "c"
    return out


def _measure(stem: str) -> int:
    """Number of changes from vowels to consonants."""
    return _shape(stem).count("vc")


def _short_end(stem: str) -> bool:
    """Consonant, vowel, consonant at the end, the last one not w, x or y."""
    return _shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


# Endings and what they become, in the published 1980 rules.
_SECOND = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
]
_THIRD = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_FOURTH = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _by_longest(word: str, endings: list[tuple[str, str]]) -> tuple[str, str, str] | None:
    fit = [(end, new) for end, new in endings if word.endswith(end)]
    if not fit:
        return None
    end, new = max(fit, key=lambda e: len(e[0]))
    return word[: -len(end)], end, new


def stem(word: str) -> str:
    """The Porter stem of a lower-case word (the rules as published in 1980); words of one or two letters stay."""
    if len(word) <= 2:
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        cut = next((word[: -len(e)] for e in ("ed", "ing") if word.endswith(e) and "v" in _shape(word[: -len(e)])), None)
        if cut is not None:
            word = cut
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c" and word[-1] not in "lsz":
                word = word[:-1]
            elif _measure(word) == 1 and _short_end(word):
                word += "e"
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for rules in (_SECOND, _THIRD):
        hit = _by_longest(word, rules)
        if hit and _measure(hit[0]) > 0:
            word = hit[0] + hit[2]
    hit = _by_longest(word, [(e, "") for e in _FOURTH])
    if hit and _measure(hit[0]) > 1 and (hit[1] != "ion" or hit[0].endswith(("s", "t"))):
        word = hit[0]
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or (m == 1 and not _short_end(word[:-1])):
            word = word[:-1]
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word


@F.pandas_udf(T.StringType())
def stem_column(words: pd.Series) -> pd.Series:
    """``stem`` of each word; meant for the distinct words of a corpus, joined back."""
    return words.map(stem, na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def stem_arrays(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """``stem`` of every word of each array; a task stems each distinct word once."""
    known: dict[str, str] = {}

    def one(words):
        if words is None:
            return None
        for w in words:
            if w is not None and w not in known:
                known[w] = stem(w)
        return [None if w is None else known[w] for w in words]

    for s in batches:
        yield s.map(one)
        if len(known) > 500_000:
            known.clear()


def analyse(text: Column, stop: frozenset[str] = STOP_WORDS, stemmed: bool = True) -> Column:
    """Tokens without stop words, stemmed."""
    words = without_stop_words(tokens(text), stop)
    return stem_arrays(words) if stemmed else words


#: Analysers by name: what makes an array of terms of a text. Index declarations keep the name.
_ANALYSERS: dict[str, Callable[[Column], Column]] = {"plain": tokens, "no stop words": lambda t: analyse(t, stemmed=False), "stemmed": analyse}


def register_analyser(name: str, analyser: Callable[[Column], Column]) -> None:
    """Make a tokenizer, stemmer or any other analysis of texts known under a name, in every process that uses the index."""
    _ANALYSERS[name] = analyser


def analyser(name: str) -> Callable[[Column], Column]:
    if name not in _ANALYSERS:
        raise ValueError(f"unknown analyser {name}")
    return _ANALYSERS[name]


def postings(df: DataFrame, key: str, *fields: str, analyser=tokens) -> DataFrame:
    """(field, term, key): one row for every term of each field of a row, without repetition; nulls give none."""
    if any(not f.strip() or "\0" in f for f in fields):
        raise ValueError("a field name is neither blank nor holds NUL")
    parts = [df.select(F.lit(f).alias("field"), F.explode(F.array_distinct(analyser(F.col(f)))).alias("term"), F.col(key)) for f in fields]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
