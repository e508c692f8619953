"""Text expressions: cleaning, tokenizing, stop words, character n-grams.

All are built-in column expressions, so they stay inside code generation.
"""

from __future__ import annotations

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, SparkSession, functions as F

# Blank characters stripped from line ends, the word pattern (two or more
# word characters), the character classes kept by cleaning, and the pattern that drops
# punctuation, control characters and words of one or two letters with following blanks.
STRIP_CHARS = " \t\r\n\f\u000b"
WORD_PATTERN = r"([\p{L}\p{N}_]{2,})"
KEEP_UNICODE = r"[^\p{L}\p{N} ]+"
KEEP_ASCII = r"[^A-Za-z0-9 ]+"
SHORT_OR_PUNCT = r"([\p{Punct}¿¡]|\p{C}|\b\p{L}{1,2}\b)\s*"


def strip(line: Column) -> Column:
    return F.trim(line, F.lit(STRIP_CHARS))


def decode(raw: Column) -> Column:
    """Bytes to text; each invalid sequence becomes U+FFFD."""
    return F.make_valid_utf8(raw.cast("string"))


def clean_text(line: Column, *, ascii_only: bool = False) -> Column:
    """Drop punctuation, strip blanks, lower. ``ascii_only`` also drops accented letters."""
    pattern = KEEP_ASCII if ascii_only else KEEP_UNICODE
    return F.lower(F.trim(F.regexp_replace(line, pattern, "")))


def clean_text_short(line: Column) -> Column:
    """Drop punctuation, control characters and words of one or two letters."""
    return F.regexp_replace(line, SHORT_OR_PUNCT, "")


def tokenize(line: Column, *, pattern: str = WORD_PATTERN) -> Column:
    """Lower-cased words of two or more word characters, in order."""
    return F.regexp_extract_all(F.lower(line), F.lit(pattern), F.lit(1))


def tokenize_ws(line: Column) -> Column:
    """Lower-cased blank-separated tokens, without empty ones."""
    return F.array_remove(F.split(F.lower(line), r"\s+"), "")


def stop_words(language: str = "english") -> list[str]:
    """The list that ships with Spark for ``language``."""
    SparkSession.builder.getOrCreate()
    return list(StopWordsRemover.loadDefaultStopWords(language))


def remove_stop_words(tokens: Column, words: list[str]) -> Column:
    if not words:
        return tokens
    return F.filter(tokens, lambda t: ~t.isin(words))


def char_ngrams(text: Column, n: int = 3) -> Column:
    """All ``n``-character shingles; a shorter text gives itself, an empty one nothing.

    One look-ahead match per place, so the time is linear in the text's length.
    """
    grams = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).when(F.length(text) <= n, F.array(text)).otherwise(grams)


def format_vector(vec: Column) -> Column:
    """Array of doubles as blank-separated numbers with six decimals."""
    return F.array_join(F.transform(vec, lambda x: F.format_string("%.6f", F.round(x, 6) + F.lit(0.0))), " ")
