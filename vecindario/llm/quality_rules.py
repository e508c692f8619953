"""Line-first cleaning: rules per line, failures removed, documents that lose too much rejected.

Everything is built-in column expressions over one row at a time, so there is no shuffle and a hot
source costs no more than any other.

Edge cases: a null text counts as no words, fails the base rule and has a null ``clean_text``; an empty
one likewise with an empty ``clean_text``; lines without a word are dropped but count neither as
kept nor as lost; repeated rows are judged alike, one by one; extra columns pass through, and columns
that have an output's name are replaced by it; very long texts are judged whole, and nothing is ranked, so there are no ties.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

# Fixed values of the contract: blanks between words, the symbols that are counted.
BLANKS = " \t\n\x0b\f\r"
WORD_GAP = r"[ \t-\r]+"
SYMBOLS = "[#*$%&|<>]"

# Fixed values of the line rules.
SENTENCE_ENDS = list(".!?:;…。！？")
CLOSERS = " \t\n\x0b\f\r\"'”’»)]"
SEPARATORS = "[|»›•·>]"
SHOUT_MARKS = "[!?]"
ANY_MARK = "[#*$%&|<>»›•·!?]"
BOILERPLATE = (r"(?i)\b(cookies?|javascript|privacy policy|terms of (use|service)|all rights reserved|sign (up|in)|log ?in"
               r"|subscribe|newsletter|click here|read more|share (this|on)|skip to (main )?content|back to top"
               r"|follow us|add to cart|lorem ipsum)\b")


@dataclass(frozen=True)
class Rules:
    """Limits, all of them per line but the last three.

    A line's words are counted by its blanks. ``max_symbols``, ``max_separators`` and ``max_marks``
    (exclamation and question marks) are per word of the line. ``max_lost`` is the share of a document's
    word characters that may go with its failing lines.
    """

    unended_words: int = 12
    max_symbols: float = 0.3
    max_marks: float = 1.0
    max_separators: float = 0.15
    boilerplate_words: int = 20
    max_lost: float = 0.4
    min_words: int = 50
    max_repeat_percent: int = 50


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also where ``body`` uses it in lambdas."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, WORD_GAP), "")


def characters(tokens: Column) -> Column:
    return F.length(F.array_join(tokens, "")).cast("bigint")


def repeated_words(tokens: Column, width: int = 3) -> Column:
    """How many words lie in a window of ``width`` words that the text has twice or more.

    Each window becomes one long: its hash, with the lowest bits given to its place. Sorted, equal
    windows are neighbours. A text of n words keeps 63 - log2(n) bits of hash, so a million words
    compare by 43 bits and a usual text by more than 50.
    """
    def keys(w):
        mask = F.pow(F.lit(2), F.length(F.bin(F.size(w)))).cast("bigint")

        def windows(m):
            starts = F.sequence(F.lit(0), F.size(w) - width)
            hashed = F.transform(starts, lambda i: F.xxhash64(*[w[i + j] for j in range(width)]).bitwiseAND(-m) + i)
            return F.struct(m.alias("mask"), F.sort_array(hashed).alias("sorted"))
        return let(mask, windows)

    def places(k):
        def twin(a, b):
            apart = a.bitwiseXOR(b)
            return F.when((apart >= 0) & (apart < k.mask), F.array(a.bitwiseAND(k.mask - 1), b.bitwiseAND(k.mask - 1)))
        shifted = F.slice(k.sorted, F.lit(2), F.greatest(F.size(k.sorted) - 1, F.lit(1)))
        twins = F.filter(F.zip_with(k.sorted, shifted, twin), lambda x: x.isNotNull())
        return F.sort_array(F.array_distinct(F.flatten(twins)))

    def covered(p):
        gaps = F.zip_with(p, F.slice(p, F.lit(2), F.greatest(F.size(p), F.lit(1))),
                          lambda a, b: F.least(F.coalesce(b - a, F.lit(width)), F.lit(width)))
        return F.aggregate(gaps, F.lit(0).cast("bigint"), lambda total, gap: total + gap)

    return F.when(F.size(tokens) > width, let(let(let(tokens, keys), places), covered)).otherwise(F.lit(0).cast("bigint"))


def line_failure(line: Column, marked: Column, rules: Rules) -> Column:
    """The first rule that ``line`` fails: navigation, punctuation or boilerplate; null if it passes.

    ``marked`` says whether the document has any of the counted marks; without them the counts are 0.
    """
    def rule(n):
        per_word = lambda pattern, most: F.regexp_count(line, F.lit(pattern)) > most * n
        unended = (n < rules.unended_words) & ~F.substring(F.rtrim(line, F.lit(CLOSERS)), -1, 1).isin(SENTENCE_ENDS)
        return (F.when(marked & (n > 1) & per_word(SEPARATORS, rules.max_separators), "navigation")
                .when(unended | (marked & (per_word(SYMBOLS, rules.max_symbols) | per_word(SHOUT_MARKS, rules.max_marks))), "punctuation")
                .when((n <= rules.boilerplate_words) & line.rlike(BOILERPLATE), "boilerplate"))
    return let(F.size(F.split(F.trim(line, F.lit(BLANKS)), " ")), rule)


def judge(documents: DataFrame, text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """Add the counts, ``base_failed``, ``kept``, ``lost_chars``, ``n_failed_lines`` and ``clean_text``."""
    body = F.coalesce(F.col(text), F.lit(""))
    columns = documents.columns
    marked = body.rlike(ANY_MARK)
    lines = F.filter(F.split(body, "\n", -1), lambda x: x.rlike(r"[^ \t-\r]"))
    judged = let(marked, lambda m: F.transform(lines, lambda x: F.struct(x.alias("line"), line_failure(x, m, rules).alias("failed"))))
    counted = let(words(body), lambda w: F.struct(
        F.size(w).cast("bigint").alias("n_words"), characters(w).alias("word_chars"), repeated_words(w).alias("n_repeat_words")))
    failed = F.filter(F.col("_lines"), lambda x: x.failed.isNotNull())
    one = documents.select(*columns, counted.alias("_counted"), judged.alias("_lines"))
    n_words, chars, repeats = (F.col(f"_counted.{c}") for c in ("n_words", "word_chars", "n_repeat_words"))
    all_lines = F.transform(F.col("_lines"), lambda x: x.line)
    lost = characters(words(F.array_join(F.transform(failed, lambda x: x.line), "\n")))
    kept_lines = F.transform(F.filter(F.col("_lines"), lambda x: x.failed.isNull()), lambda x: x.line)
    base = (n_words < rules.min_words) | (100 * repeats > rules.max_repeat_percent * n_words)
    out = {"n_words": n_words, "word_chars": chars, "n_symbols": F.regexp_count(body, F.lit(SYMBOLS)).cast("bigint"),
           "n_dup_lines": (F.size(all_lines) - F.size(F.array_distinct(all_lines))).cast("bigint"),
           "n_repeat_words": repeats, "base_failed": base, "kept": ~base & (lost <= rules.max_lost * chars),
           "lost_chars": lost, "n_failed_lines": F.size(failed).cast("bigint"),
           "clean_text": F.when(F.col(text).isNotNull(), F.array_join(kept_lines, "\n"))}
    return one.select(*[c for c in columns if c not in out], *[v.alias(k) for k, v in out.items()])
