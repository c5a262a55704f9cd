"""Feature extraction: shingles, code tokens, entity profiles, and similarities of feature sets, as columns."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import ConfigurationError

#: Joins the tokens of a shingle.
JOINER = "\x1f"

WORD = r"[\p{L}\p{N}_]+"

#: Beyond ASCII, what is not of a word; and the bytes that are: those of ASCII, and all beyond.
OTHER = r"[[^\x00-\x7f]&&[^\p{L}\p{N}]]"
_OF_WORD = np.array([i >= 128 or chr(i).isalnum() or chr(i) == "_" for i in range(256)])


def fold(text: Column, general: bool = False) -> Column:
    """Case folding: an expression that is exact for text without compatibility characters, or, for any text,
    NFKC and full case folding in Arrow batches."""
    if not general:
        return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))

    @F.pandas_udf("string")
    def nfkc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).casefold())

    return nfkc(text)


def _size(size: int) -> int:
    if isinstance(size, bool) or not isinstance(size, int) or size <= 0:
        raise ConfigurationError("size must be a positive integer")
    return size


def once(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)`` where the value is evaluated once for a row, however often ``of`` names it: it is bound as a lambda's variable."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def words(text: Column, normalize: bool = True, general: bool = False) -> Column:
    if normalize:
        return F.regexp_extract_all(fold(text, general), F.lit(WORD), F.lit(0))
    return F.filter(F.split(text, r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]+"), lambda w: w != "")


def windows(tokens: Column, size: int) -> Column:
    """Runs of ``size`` tokens, joined; fewer tokens are one run; none give none."""
    return once(tokens, lambda t: _runs(t, size))


def _runs(tokens: Column, size: int) -> Column:
    short = F.when(F.size(tokens) == 0, F.array().cast("array<string>")).otherwise(F.array(F.array_join(tokens, JOINER)))
    last = F.greatest(F.lit(0), F.size(tokens) - (size - 1))
    joined = lambda w, i: F.concat(w, *[x for j in range(1, size) for x in (F.lit(JOINER), F.get(tokens, i + j))])
    runs = F.transform(F.slice(tokens, 1, last), joined)
    return F.when(F.size(tokens) <= size, short).otherwise(F.filter(runs, lambda r: r.isNotNull()))


def word_shingles(text: Column, size: int = 3, normalize: bool = True, general: bool = False) -> Column:
    """Distinct word shingles in order of first sight; null text gives null."""
    return F.array_distinct(windows(words(text, normalize, general), _size(size)))


@dataclass(frozen=True)
class WordShingles:
    """Word shingles of a text, as a column and in a form from which they are cut where a kernel needs them, which is quicker."""

    text: Column
    size: int = 3

    def __post_init__(self) -> None:
        _size(self.size)

    @property
    def column(self) -> Column:
        return word_shingles(self.text, self.size)

    @property
    def plain(self) -> Column:
        """The folded text, in which all characters beyond ASCII are those of words; others of them have become spaces."""
        spaced = lambda t: F.when(F.octet_length(t) == F.length(t), t).otherwise(F.regexp_replace(t, OTHER, " "))
        return once(fold(self.text), spaced)


def cut_shingles(data: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the ``plain`` texts of ``WordShingles`` that lie one after the other, up to ``ends``: bytes (with 64 more at the end), starts and
    lengths of all shingles in them, repeats too, and how many each text has."""
    bounds = np.zeros(len(data) + 1, bool)
    bounds[ends] = bounds[0] = True
    inside = _OF_WORD[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | bounds[1:-1]
    last[:-1] &= ~inside[1:] | bounds[1:-1]
    # Of what lies between two words one byte stays, which becomes the joiner.
    kept = inside.copy()
    kept[1:] |= inside[:-1]
    packed = np.where(inside, data, np.uint8(ord(JOINER)))[kept]
    packed = np.concatenate([packed, np.zeros(64, np.uint8)])
    place = np.cumsum(kept)
    start, end = np.flatnonzero(first), place[last]
    words = np.diff(np.searchsorted(start, np.concatenate([[0], ends])))
    start = place[start] - 1
    # The first word of every shingle: those that enough others follow, or the first of all.
    within = np.arange(len(start)) - np.repeat(np.cumsum(words) - words, words)
    total = np.repeat(words, words)
    head = np.flatnonzero(within <= np.maximum(total - size, 0))
    run = np.minimum(total[head], size)
    start = start[head]
    return packed, start, end[head + run - 1] - start, np.where(words > 0, np.maximum(words - size, 0) + 1, 0)


def char_shingles(text: Column, size: int = 3, normalize: bool = True, general: bool = False) -> Column:
    """Distinct character shingles; normalised text has its white space collapsed and trimmed."""
    _size(size)
    t = F.trim(F.regexp_replace(fold(text, general), r"\s+", " ")) if normalize else text
    # One pass over the text: each match takes one character and captures it with those that follow.
    runs = lambda t: F.array_distinct(F.regexp_extract_all(t, F.lit(f"(?s)(?=(.{{{size}}}))."), F.lit(1)))
    return once(t, lambda t: F.when(F.length(t) == 0, F.array().cast("array<string>")).when(F.length(t) <= size, F.array(t)).otherwise(runs(t)))


def text_shingles(text: Column, size: int = 3, general: bool = False) -> Column:
    """Word shingles with repeats; a text without words has one empty shingle, so that such texts match each other."""
    _size(size)
    return once(words(text, True, general), lambda w: F.when(F.size(w) == 0, F.array(F.lit(""))).otherwise(_runs(w, size)))


# --- code ------------------------------------------------------------------------------------------------------------

# The tokens must match those of the published lexer, so its numbers, strings and operators are stated as they are.
_DIGITS = r"[0-9](?:_?[0-9])*"
NUMBER = (
    r"0[xX][0-9A-Fa-f](?:_?[0-9A-Fa-f])*|0[bB][01](?:_?[01])*"
    rf"|(?:{_DIGITS})?(?:\.{_DIGITS})+(?:[eE][+-]?{_DIGITS})?|{_DIGITS}(?:[eE][+-]?{_DIGITS})?"
)
STRING = r"""'(?:\\.|[^'\\])*+'|"(?:\\.|[^"\\])*+\""""
OPERATORS = r"===|!==|>>>|<<=|>>=|==|!=|<=|>=|=>|->|::|&&|\|\||\+\+|--|\*\*|<<|>>|:="
CODE_TOKEN = rf"[\p{{L}}_][\p{{L}}\p{{N}}_]*|{NUMBER}|{STRING}|{OPERATORS}|\S"


def nfkc(text: Column) -> Column:
    """Compatibility composition (NFKC), in Arrow batches; ASCII text passes as it is."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))

    return run(text)


def code_tokens(text: Column, general: bool = False) -> Column:
    """Lexical tokens; numbers and strings become ``<number>`` and ``<string>``.

    ``general`` composes compatibility characters first, which text without any does not need."""
    lines = F.regexp_replace(nfkc(text) if general else text, "\r\n?", "\n")
    found = F.regexp_extract_all(lines, F.lit(CODE_TOKEN), F.lit(0))
    return F.transform(
        found,
        lambda t: F.when(F.rlike(t, F.lit(f"^(?:{NUMBER})$")), "<number>").when(F.rlike(t, F.lit(f"(?s)^(?:{STRING})$")), "<string>").otherwise(t),
    )


def code_shingles(text: Column, size: int = 5, general: bool = False) -> Column:
    """Runs of code tokens, with repeats; empty text gives none."""
    return windows(code_tokens(text, general), _size(size))


# --- entities --------------------------------------------------------------------------------------------------------
# The tags of the features (name:word:, name:gram:, address:word:, email:exact:, email:domain:, phone:exact:,
# title:word:, brand:exact:, sku:exact:, category:word:) and the padding ^ $ are part of the hashed features.


def _tagged(tag: str, values: Column) -> Column:
    return F.coalesce(F.transform(values, lambda v: F.concat(F.lit(tag), v)), F.array().cast("array<string>"))


def _compact(value: Column) -> Column:
    return F.regexp_replace(fold(value), r"[^\p{L}\p{N}]+", "")


def _one(tag: str, value: Column) -> Column:
    return F.when(value.isNotNull() & (value != ""), F.array(F.concat(F.lit(tag), value))).otherwise(F.array().cast("array<string>"))


def _sorted_set(*parts: Column) -> Column:
    return F.array_sort(F.array_distinct(F.concat(*parts)))


def customer_features(name: Column, address: Column, email: Column, phone: Column) -> Column:
    """Sorted tagged features of a person: name words and padded 3-grams, address words, e-mail, domain, last ten digits."""
    joined = F.array_join(words(name), " ")
    padded = F.concat(F.lit("^"), joined, F.lit("$"))
    grams = F.when(joined != "", char_shingles(padded, 3, normalize=False)).otherwise(F.array().cast("array<string>"))
    mail = fold(F.trim(email))
    digits = F.regexp_replace(phone, r"[^0-9]", "")
    return _sorted_set(
        _tagged("name:word:", words(name)), _tagged("name:gram:", grams), _tagged("address:word:", words(address)),
        _one("email:exact:", mail), _one("email:domain:", F.substring_index(mail, "@", -1)), _one("phone:exact:", F.right(digits, F.lit(10))),
    )


def product_features(title: Column, brand: Column, sku: Column, category: Column) -> Column:
    """Sorted tagged features of a product: title words, compact brand and article number, category words."""
    return _sorted_set(
        _tagged("title:word:", words(title)), _one("brand:exact:", _compact(brand)), _one("sku:exact:", _compact(sku)),
        _tagged("category:word:", words(category)),
    )


def require_features(features: Column) -> Column:
    """The features, or an error where there are none."""
    return F.when(F.size(features) > 0, features).otherwise(F.raise_error(F.lit("a record has no usable features")).cast("array<string>"))


# --- similarities ----------------------------------------------------------------------------------------------------


def jaccard(a: Column, b: Column) -> Column:
    """Exact Jaccard similarity of two feature sets; 1 if both are empty."""
    both = F.size(F.array_intersect(a, b)).cast("double")
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / F.size(F.array_union(a, b)))


def signature_similarity(a: Column, b: Column) -> Column:
    """Share of equal positions; 0 for signatures that are empty or of unequal length."""
    equal = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), equal.cast("double") / F.size(a)).otherwise(0.0)


def hamming_similarity(a: Column, b: Column) -> Column:
    """1 - differing bits / 64."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)
