import collections
import re

import pytest

from vecindario.llm import quality_rules as Q

SENTENCE = "The quick brown fox jumps over the lazy dog near the quiet river bank today."


def brute(text, width=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    runs = [tuple(w[i:i + width]) for i in range(len(w) - width + 1)]
    seen = collections.Counter(runs)
    covered = {i + j for i, run in enumerate(runs) if seen[run] > 1 for j in range(width)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


TEXTS = [None, "", " \t\n\x0b\f\r ", "a", "a b", "a b c", "a b c a b c", "x x x x x x", "é ü # | <b>\n\nline\nline\n line",
         " ".join(["word"] * 5000), " ".join(str(i % 701) for i in range(20000)), "\n".join([SENTENCE] * 4), "一二 三四 五六 一二 三四 五六"]


def test_counts_equal_brute_force(spark):
    rows = [(i, t, "clash", 7) for i, t in enumerate(TEXTS)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string, extra int")
    out = Q.judge(df)
    assert out.columns.count("kept") == 1 and "extra" in out.columns
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(r.text), r.doc_id
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)


@pytest.mark.parametrize("line,why", [
    (SENTENCE, None), ("Home | About | Contact | Help", "navigation"), ("Latest news", "punctuation"),
    ("Please accept cookies to continue.", "boilerplate"), ("BUY!! NOW!! CHEAP!! HERE!!", "punctuation"),
    ("wo### rd%%% ab&&& cd*** and so on for a while with no end or stop", "punctuation"), ('He said "yes."', None)])
def test_line_rules(spark, line, why):
    out = Q.judge(spark.createDataFrame([(line,)], "text string"))
    row = out.selectExpr("n_failed_lines", "clean_text").first()
    assert (row.n_failed_lines == 1) == (why is not None) and row.clean_text == ("" if why else line)


def test_documents_that_lose_too_much_go(spark):
    good = "\n".join(" ".join(f"word{i}x{j}" for j in range(14)) + "." for i in range(6))
    bad = good + "\n" + "\n".join(" | ".join(f"item{i}{j}" for j in range(12)) for i in range(12))
    out = {r.doc_id: r.kept for r in Q.judge(spark.createDataFrame([(0, good), (1, bad)], "doc_id long, text string")).collect()}
    assert out == {0: True, 1: False}


def test_empty_table(spark):
    assert Q.judge(spark.createDataFrame([], "doc_id long, text string")).count() == 0
