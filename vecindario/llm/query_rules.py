"""Query of the quality rules."""

from __future__ import annotations

from . import quality_rules as Q

RULES = Q.Rules()


def op2_quality_rules(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return Q.judge(documents, rules=RULES).drop("text", "clean_text")


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql(rules: Q.Rules = RULES) -> str:
    blanks, closers = (" || ".join(f"chr({ord(c)})" for c in chars) for chars in (Q.BLANKS, Q.CLOSERS))
    ends = ", ".join(map(quoted, Q.SENTENCE_ENDS))
    count = lambda column, pattern: f"len(regexp_extract_all({column}, {quoted(pattern)}))"
    gone = rf"regexp_replace({{}}, '{Q.WORD_GAP}', '', 'g')"
    return rf"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
    w AS (SELECT r, list_filter(string_split_regex(t, '{Q.WORD_GAP}'), lambda x: x <> '') AS w FROM d),
    runs AS (SELECT r, i, w[i] || chr(0) || w[i + 1] || chr(0) || w[i + 2] AS run
             FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
    again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, run) AS n FROM runs) WHERE n > 1),
    covered AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM again) GROUP BY r),
    split AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d),
    lines AS (SELECT r, line, len(string_split(trim(line, {blanks}), ' ')) AS n FROM split WHERE regexp_matches(line, '[^ \t-\r]')),
    judged AS (SELECT r, line,
        (n > 1 AND {count('line', Q.SEPARATORS)} > {rules.max_separators}::DOUBLE * n)
        OR (n < {rules.unended_words} AND right(rtrim(line, {closers}), 1) NOT IN ({ends}))
        OR {count('line', Q.SYMBOLS)} > {rules.max_symbols}::DOUBLE * n OR {count('line', Q.SHOUT_MARKS)} > {rules.max_marks}::DOUBLE * n
        OR (n <= {rules.boilerplate_words} AND regexp_matches(line, {quoted(Q.BOILERPLATE)})) AS failed FROM lines),
    by_line AS (SELECT r, count(*) - count(DISTINCT line) AS dups, count(*) FILTER (failed) AS n_failed,
                       coalesce(sum(length({gone.format('line')})) FILTER (failed), 0) AS lost FROM judged GROUP BY r),
    counts AS (SELECT doc_id, len(w) AS n_words, length({gone.format('t')}) AS word_chars, {count('t', Q.SYMBOLS)} AS n_symbols,
                      coalesce(dups, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words,
                      coalesce(lost, 0)::BIGINT AS lost_chars, coalesce(n_failed, 0) AS n_failed_lines
               FROM d JOIN w USING (r) LEFT JOIN covered USING (r) LEFT JOIN by_line USING (r)),
    based AS (SELECT *, n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_percent} * n_words AS base_failed FROM counts)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT base_failed AND lost_chars <= {rules.max_lost}::DOUBLE * word_chars AS kept, lost_chars, n_failed_lines FROM based"""


QUERIES = {"op2_quality_rules": op2_quality_rules}
SQL = {"op2_quality_rules": sql()}
