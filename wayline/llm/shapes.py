"""Hashed n-grams of words and of word shapes, which are words with their letters and digits levelled."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayline.llm.common import bound, words_of

#: Runs that a shape levels, in this order, and what each becomes.
LEVELS = ((r"[\p{Ll}\p{Lo}\p{Lm}\p{M}]+", "a"), (r"\p{Lu}+", "A"), (r"\p{Nd}+", "0"))


def shape_of(text: Column) -> Column:
    """The text with each run of small letters as a, of capitals as A and of digits as 0; words stay apart."""
    for pattern, to in LEVELS:
        text = F.regexp_replace(text, pattern, to)
    return text


def text_grams(text: Column, shape_bits: int, word_bits: int) -> Column:
    """Hash buckets of the n-grams of a text: each pair of neighbouring word shapes, and each word."""
    return bound(word_hashes(words_of(text)), lambda words: grams_of(text, words, shape_bits, word_bits))


def word_hashes(words: Column) -> Column:
    """A 64-bit hash of each word."""
    return F.transform(words, lambda w: F.xxhash64(w))


def grams_of(text: Column, words: Column, shape_bits: int, word_bits: int) -> Column:
    """text_grams, given the hashes of the text's words.

    Pairs of shapes have the first 2^shape_bits numbers, odd ones where the same word stands twice; words have the
    2^word_bits numbers after these. Buckets are leading bits of hashes, and pairs mix two of these, so each word is
    hashed once.
    """
    top = lambda h, bits: F.shiftrightunsigned(h, 64 - bits)
    first = F.lit(1 << shape_bits).cast("long")

    def grams(shapes: Column) -> Column:
        rest = F.slice(shapes, F.lit(2), F.greatest(F.size(shapes) - 1, F.lit(0)))
        mixed = lambda x, i: top(F.shiftleft(F.get(shapes, i), 1).bitwiseXOR(x), shape_bits - 1)
        shaped = F.transform(rest, lambda x, i: F.shiftleft(mixed(x, i), 1) + (F.get(words, i) == F.get(words, i + 1)).cast("long"))
        return F.concat(shaped, F.transform(words, lambda x: top(x, word_bits) + first)).cast("array<int>")

    return bound(word_hashes(words_of(shape_of(text))), grams)
