"""The value-checked queries once more, as plain SQL over the same tables."""

from __future__ import annotations

import functools
import logging

from vecindario.functions.text import stop_words
from vecindario.plans.catalog import EMB_DIM, LANGUAGES, LOOKUP_WORDS, VEC_DIM

BLANKS = "' '||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"
TOKENS = r"regexp_extract_all(lower(line), '([\p{L}\p{N}_]{2,})', 1)"


@functools.cache
def stops(language: str = "english") -> str:
    words = [w.strip() for w in stop_words(language) if w.strip()]
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def lines(name: str = "lines", source: str = "documents", key: str = "doc_id", extra: str = "") -> str:
    return f"""{name} AS (
      SELECT doc_id{extra}, (n - 1)::INT AS line_no, trim(raw, {BLANKS}) AS line FROM (
        SELECT {key} AS doc_id{extra}, unnest(range(1, len(a) + 1)) AS n, unnest(a) AS raw
        FROM (SELECT *, string_split(text, chr(10)) AS a FROM {source} WHERE text IS NOT NULL)))"""


CONV = dict(source="conversations", key="conv_id * 1000000 + turn")
CONV_KEY = CONV["key"]


def posts(name: str = "posts", source: str = "lines", tokens: str = TOKENS, keep: str = "") -> str:
    return f"""{name} AS (
      SELECT doc_id, line_no, (n - 1)::INT AS "offset", word FROM (
        SELECT doc_id, line_no, unnest(range(1, len(t) + 1)) AS n, unnest(t) AS word
        FROM (SELECT doc_id, line_no, {tokens} AS t FROM {source})) {keep})"""


def toks(source: str = "lines") -> str:
    return f"toks AS (SELECT doc_id, line_no, {TOKENS} AS t FROM {source})"


def sampled(source: str = "posts", n: int = 50, keep: str = "") -> str:
    key = "md5(concat_ws('|', '42', word, doc_id, line_no, \"offset\"))"
    return f"""sampled AS (
      SELECT word, doc_id, line_no, "offset" FROM (
        SELECT *, row_number() OVER (PARTITION BY word ORDER BY {key}, doc_id, line_no, "offset") AS rn
        FROM {source} {keep}) WHERE rn <= {n})"""


def windows(source: str = "sampled", w: int = 10) -> str:
    return f"""windows AS (
      SELECT p.word, p.doc_id, p.line_no, p."offset",
             list_concat(t[greatest(1, p."offset" - {w - 1}):p."offset"], t[p."offset" + 2:p."offset" + {w + 1}]) AS win
      FROM {source} p JOIN toks USING (doc_id, line_no))"""


def vocab(source: str = "lines", prune: bool = False) -> str:
    n = f"(SELECT count(*)::DOUBLE FROM {source})"
    having = f"WHERE df >= 2 AND df <= 0.95 * {n}" if prune else ""
    return f"""vocab AS (
      SELECT term, df, ln(({n} + 1) / (df + 1.0::DOUBLE)) + 1 AS idf FROM (
        SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({TOKENS})) AS term FROM {source})
        WHERE term NOT IN {stops()} GROUP BY term) {having})"""


def conv_chain(external: bool = False, prune: bool = False) -> str:
    keep = f"WHERE word NOT IN {stops()}"
    sources = [lines("clines", **CONV), posts(source="clines"), toks("clines"), sampled(keep=keep)]
    if external:
        sources += [lines(), vocab("lines")]
    else:
        sources += [vocab("clines", prune)]
    if external or prune:
        sources += [windows().replace("windows AS", "allwin AS", 1),
                    "windows AS (SELECT * FROM allwin WHERE word IN (SELECT term FROM vocab))"]
    else:
        sources += [windows()]
    return ", ".join(sources)


TERMS = """terms AS (
      SELECT word, doc_id, line_no, "offset", term, count(*) AS tf
      FROM (SELECT word, doc_id, line_no, "offset", unnest(win) AS term FROM windows) GROUP BY ALL)"""
WEIGHTED = """weighted AS (
      SELECT word, doc_id, line_no, "offset", term, tf,
             raw / sqrt(sum(raw * raw) OVER (PARTITION BY word, doc_id, line_no, "offset")) AS weight
      FROM (SELECT t.*, (1 + ln(tf::DOUBLE)) * idf AS raw FROM terms t JOIN vocab USING (term)))"""
CENTROIDS = """sizes AS (SELECT word, count(*) AS n_windows FROM windows GROUP BY word),
    means AS (SELECT word, term, sum(weight) / any_value(n_windows) AS weight, any_value(n_windows) AS n_windows
              FROM weighted JOIN sizes USING (word) GROUP BY word, term),
    centroids AS (SELECT * FROM means UNION ALL
                  SELECT word, NULL, 0.0, n_windows FROM sizes WHERE word NOT IN (SELECT word FROM means))"""


def random_rows(dim: int) -> str:
    uniform = ("('0x' || substr(md5(concat_ws('|', '42', term, j // 4)), (j % 4)::INT * 8 + 1, 8))::BIGINT"
               " / 4294967296.0::DOUBLE")
    return f"""density AS (SELECT 1 / sqrt(count(*)::DOUBLE) AS d FROM vocab),
    signs AS (SELECT term, j, CASE WHEN u < d / 2 THEN -1 / sqrt(d * {dim}) ELSE 1 / sqrt(d * {dim}) END AS s
              FROM (SELECT term, j, {uniform} AS u FROM vocab, range(0, {dim}) r(j)), density WHERE u < d),
    cells AS (SELECT word, j, sum(weight * s) AS v FROM centroids JOIN signs USING (term) GROUP BY word, j),
    vectors AS (SELECT word, list(round(coalesce(v, 0), 6) + 0.0::DOUBLE ORDER BY j) AS vec
                FROM (SELECT word, j FROM (SELECT DISTINCT word FROM centroids), range(0, {dim}) r(j))
                LEFT JOIN cells USING (word, j) GROUP BY word)"""


def wide(dim: int) -> str:
    return "SELECT word, " + ", ".join(f"vec[{j + 1}] AS v{j}" for j in range(dim)) + " FROM vectors"


CLEAN = r"lower(trim(regexp_replace(line, '[^\p{L}\p{N} ]+', '', 'g'), ' '))"
MARKED = r"regexp_replace(line, '([\p{L}\p{N}_]+)', '⟦\1⟧', 'g')"
SHORT = (r"regexp_replace(regexp_replace(" + MARKED
         + r", '([[:punct:]¿¡]|\p{C}|⟦\p{L}{1,2}⟧)\s*', '', 'g'), '[⟦⟧]', '', 'g')")
SPLIT_WS = r"list_filter(string_split_regex({}, '\s+'), lambda x: x <> '')"


def sliding(source: str = "lines", size: int = 5, clean: str = CLEAN, keep: str = "true", whole: bool = False) -> str:
    half = size // 2
    win = "run" if whole else f"list_concat(run[1:{half}], run[{half + 2}:{size}])"
    tokens = f"list_filter({SPLIT_WS.format(clean)}, lambda x: {keep})"
    return f"""rows_ AS (
      SELECT doc_id, line_no, pos, run[{half + 1}] AS word, {win} AS win FROM (
        SELECT doc_id, line_no, (i - 1)::INT AS pos, t[i:i + {size - 1}] AS run FROM (
          SELECT doc_id, line_no, t, unnest(range(1, len(t) - {size - 2})) AS i
          FROM (SELECT doc_id, line_no, {tokens} AS t FROM {source}))))"""


RANKED = """counts AS (SELECT word, count(*) AS count FROM rows_ GROUP BY word),
    ranked AS (SELECT word, count, (row_number() OVER (ORDER BY count DESC, word) - 1)::DOUBLE AS label FROM counts)"""
INVERSE = """kept AS (SELECT * FROM counts WHERE count > 2),
    asc_ AS (SELECT count AS ascc, row_number() OVER (ORDER BY count) - 1 AS id FROM kept),
    desc_ AS (SELECT word, count, row_number() OVER (ORDER BY count DESC, word) - 1 AS id FROM kept),
    scale_ AS (SELECT sum(count)::DOUBLE AS t, min(count) / sum(count)::DOUBLE AS lo, max(count) / sum(count)::DOUBLE AS hi FROM kept),
    inverse AS (SELECT id, word, count, ascc, ascc / t AS weight,
                       least(1.0::DOUBLE, CASE WHEN hi = lo THEN 1.0 ELSE (ascc / t - lo + 0.01::DOUBLE) / (hi - lo) END) AS weight_n
                FROM desc_ JOIN asc_ USING (id), scale_)"""


def hash01(seed: int) -> str:
    return (f"('0x' || substr(md5(concat_ws('|', '{seed}', doc_id, line_no, pos)), 1, 8))::BIGINT"
            " / 4294967296.0::DOUBLE")


def shingles() -> str:
    gram = "list_transform(range(1, greatest(1, length(s) - 2) + 1), lambda i: substr(s, i, 3))"
    return f"""grams AS (SELECT doc_id, line_no, CASE WHEN length(s) > 0 THEN {gram} ELSE [] END AS g
                         FROM (SELECT doc_id, line_no, {SHORT} AS s FROM clines)),
    runs AS (SELECT doc_id, line_no, (i - 1)::INT AS pos, g[i:i + 6] AS run FROM (
               SELECT *, unnest(range(1, greatest(1, len(g) - 6) + 1)) AS i FROM grams WHERE len(g) > 0))"""


def with_(*ctes: str) -> str:
    return "WITH " + ", ".join(ctes) + " "


def oracle() -> dict[str, str]:
    lookup = "(" + ", ".join(f"'{w}'" for w in LOOKUP_WORDS) + ")"
    base = with_(lines(), posts())
    p4 = 'word, doc_id, line_no, "offset"'
    rows = with_(lines(), sliding())
    ranked = with_(lines(), sliding(), RANKED)
    inverse = with_(lines(), sliding(), RANKED, INVERSE)

    def conv() -> str:
        return f"WITH {conv_chain()}, {TERMS}, {WEIGHTED}"

    def conv_vec() -> str:
        return f"{conv()}, {CENTROIDS}, {random_rows(VEC_DIM)} "

    def by_lang() -> str:
        return " ".join(f"WHEN '{code}' THEN list_filter(t, lambda x: x NOT IN {stops(name)})" for code, name in LANGUAGES.items())

    texts = {
        "corpus_lines": lambda: with_(lines()) + "SELECT * FROM lines",
        "stack_corpora": lambda: with_(lines(), lines("clines", **CONV))
        + "SELECT 'documents' AS corpus, * FROM lines UNION ALL SELECT 'conversations' AS corpus, * FROM clines",
        "clean_text": lambda: with_(lines()) + f"SELECT doc_id, line_no, {CLEAN} AS clean FROM lines",
        "clean_text_short": lambda: with_(lines()) + f"SELECT doc_id, line_no, {SHORT} AS clean FROM lines",
        "tokens": lambda: base + "SELECT * FROM posts",
        "tokens_ws": lambda: with_(lines(), posts(tokens=SPLIT_WS.format("lower(line)"))) + "SELECT * FROM posts",
        "tokens_nostop": lambda: with_(lines(extra=", lang")) + f"""
            SELECT doc_id, line_no, (n - 1)::INT AS "offset", word FROM (
              SELECT doc_id, line_no, unnest(range(1, len(k) + 1)) AS n, unnest(k) AS word FROM (
                SELECT doc_id, line_no, CASE lang {by_lang()} ELSE t END AS k
                FROM (SELECT doc_id, line_no, lang, {TOKENS} AS t FROM lines)))""",
        "char_ngrams": lambda: with_(lines("clines", **CONV)) + """
            SELECT doc_id, line_no, len(g)::INT AS n_grams, array_to_string(g, '|') AS grams FROM (
              SELECT doc_id, line_no, CASE WHEN length(line) > 0 THEN list_transform(
                range(1, greatest(1, length(line) - 2) + 1), lambda i: substr(line, i, 3)) ELSE [] END AS g FROM clines)""",
        "postings": lambda: base + f"SELECT {p4} FROM posts",
        "postings_lookup": lambda: base + f"SELECT {p4} FROM posts WHERE word IN {lookup}",
        "postings_to_lines": lambda: with_(lines("clines", **CONV), posts(source="clines"))
        + f"SELECT {p4}, md5(line) AS line_md5 FROM posts JOIN clines USING (doc_id, line_no)",
        "coo_codec": lambda: base + "SELECT word, doc_id, line_no || ',' || \"offset\" AS coo, line_no, \"offset\" FROM posts",
        "sampled_postings": lambda: with_(lines(), posts(), sampled()) + "SELECT * FROM sampled",
        "stream_sampled_postings": lambda: with_(lines(), posts(), sampled()) + "SELECT * FROM sampled",
        "context_windows": lambda: with_(lines(), posts(), toks(), sampled(), windows())
        + f"SELECT {p4}, array_to_string(win, ' ') AS \"window\" FROM windows",
        "kwic_words": lambda: with_(lines(), posts(keep=f"WHERE word IN {lookup}"), toks(), windows("posts"))
        + f"SELECT {p4}, array_to_string(win, ' ') AS \"window\" FROM windows",
        "sliding_windows": lambda: rows + "SELECT doc_id, line_no, pos, word, array_to_string(win, ' ') AS \"window\" FROM rows_",
        "sliding_windows_stop": lambda: with_(lines(), sliding(keep=f"x NOT IN {stops()}"))
        + "SELECT doc_id, line_no, pos, word, array_to_string(win, ' ') AS \"window\" FROM rows_",
        "sliding_windows_ascii": lambda: with_(lines(), sliding(clean=CLEAN.replace(r"\p{L}\p{N}", "A-Za-z0-9")))
        + "SELECT doc_id, line_no, pos, word, array_to_string(win, ' ') AS \"window\" FROM rows_",
        "sliding_windows_whole": lambda: with_(lines(), sliding(whole=True))
        + "SELECT doc_id, line_no, pos, word, array_to_string(win, ' ') AS \"window\" FROM rows_",
        "context_windows_all": lambda: with_(lines("clines", **CONV), posts(source="clines"), toks("clines"), windows("posts"))
        + f"SELECT {p4}, array_to_string(win, ' ') AS \"window\" FROM windows",
        "shingle_windows": lambda: with_(lines("clines", **CONV), shingles()) + """
            SELECT doc_id, line_no, pos, run[len(run) // 2 + 1] AS word,
                   array_to_string(list_concat(run[1:len(run) // 2], run[len(run) // 2 + 2:]), '|') AS "window" FROM runs""",
        "batch_ids": lambda: base + """
            SELECT word, (row_number() OVER (ORDER BY length(word), word) - 1) // 100 AS batch_id
            FROM (SELECT DISTINCT word FROM posts)""",
        "vocab_size": lambda: base + "SELECT count(DISTINCT word) AS vocab_size FROM posts",
        "doc_freq": lambda: base + "SELECT word AS term, count(DISTINCT (doc_id, line_no)) AS df FROM posts GROUP BY word",
        "vocab_pruned": lambda: with_(lines(), vocab(prune=True)) + "SELECT term, df, round(idf, 6) AS idf FROM vocab",
        "vocab_postings": lambda: with_(lines(), posts(), vocab(prune=True))
        + f"SELECT {p4} FROM posts WHERE word IN (SELECT term FROM vocab)",
        "missing_words": lambda: with_(lines(), posts(), lines("clines", **CONV), vocab("clines"))
        + "SELECT term AS word FROM vocab WHERE term NOT IN (SELECT word FROM posts)",
        "windows_per_word": lambda: base + "SELECT word, least(count(*), 50) AS n_windows FROM posts GROUP BY word",
        "tfidf_windows": lambda: conv() + f" SELECT {p4}, term, tf, round(weight, 6) AS weight FROM weighted",
        "tfidf_external_idf": lambda: f"WITH {conv_chain(external=True)}, {TERMS}, {WEIGHTED}"
        + f" SELECT {p4}, term, tf, round(weight, 6) AS weight FROM weighted",
        "count_windows": lambda: f"WITH {conv_chain(prune=True)}, {TERMS}"
        + f" SELECT {p4}, term, tf FROM terms WHERE term IN (SELECT term FROM vocab)",
        "window_vectors": lambda: conv() + f""", words AS (
            SELECT word, row_number() OVER (ORDER BY length(word), word) - 1 AS label
            FROM (SELECT DISTINCT word FROM posts WHERE word NOT IN {stops()}))
            SELECT {p4}, term, round(weight, 6) AS weight, label FROM weighted JOIN words USING (word)""",
        "word_centroids": lambda: f"{conv()}, {CENTROIDS}"
        + " SELECT word, term, round(weight, 6) + 0.0::DOUBLE AS weight, n_windows FROM centroids",
        "hashing_tf": lambda: with_(lines("clines", **CONV), sliding("clines")) + """
            SELECT doc_id, line_no, pos, (('0x' || substr(md5(term), 1, 8))::BIGINT % 1024)::INT AS bucket, count(*) AS tf
            FROM (SELECT doc_id, line_no, pos, unnest(win) AS term FROM rows_) GROUP BY ALL""",
        "plain_idf": lambda: rows + """
            SELECT bucket, count(*) AS df, round(ln(((SELECT count(*)::DOUBLE FROM rows_) + 1) / (count(*) + 1.0::DOUBLE)), 6) AS idf
            FROM (SELECT DISTINCT doc_id, line_no, pos, (('0x' || substr(md5(term), 1, 8))::BIGINT % 1024)::INT AS bucket
                  FROM (SELECT doc_id, line_no, pos, unnest(win) AS term FROM rows_)) GROUP BY bucket""",
        "sparse_matmul": lambda: base + """, cells AS (SELECT doc_id, word, count(*)::DOUBLE AS a FROM posts GROUP BY ALL),
            langs AS (SELECT word, lang, count(*)::DOUBLE AS b FROM cells JOIN documents USING (doc_id) GROUP BY ALL)
            SELECT doc_id, lang, sum(a * b) AS weight FROM cells JOIN langs USING (word) GROUP BY ALL""",
        "label_counts": lambda: ranked + "SELECT * FROM counts",
        "rare_labels": lambda: ranked + "SELECT * FROM counts WHERE count <= 2",
        "drop_rare": lambda: ranked + """SELECT doc_id, line_no, pos, word, array_to_string(win, ' ') AS "window"
            FROM rows_ JOIN counts USING (word) WHERE count > 2""",
        "label_index": lambda: ranked + "SELECT * FROM ranked",
        "label_words": lambda: ranked + "SELECT label, word FROM ranked",
        "label_lookup": lambda: ranked + """SELECT doc_id, line_no, pos, label AS prediction,
            CASE WHEN count > 2 THEN word ELSE '' END AS pred_word FROM rows_ JOIN ranked USING (word)""",
        "inverse_rank_weights": lambda: inverse
        + "SELECT id, word, count, ascc, round(weight, 9) AS weight, round(weight_n, 9) AS weight_n FROM inverse",
        "stratified_sample": lambda: inverse + f"""SELECT doc_id, line_no, pos, word, array_to_string(win, ' ') AS "window"
            FROM rows_ JOIN inverse USING (word) WHERE {hash01(36)} < weight_n""",
        "hash_split": lambda: rows + f"""SELECT doc_id, line_no, pos, word,
            CASE WHEN {hash01(24)} < 0.7::DOUBLE THEN 'train' ELSE 'test' END AS split FROM rows_""",
        "predict_center_nb": lambda: with_(lines("clines", **CONV), sliding("clines")).rstrip() + f""",
            kept AS (SELECT doc_id, line_no, pos, word, list_sort(win) AS bag, {hash01(24)} < 0.7::DOUBLE AS train FROM rows_ JOIN (SELECT word FROM rows_ GROUP BY word HAVING count(*) > 2) USING (word)),
            classes AS (SELECT word, count(*) AS n, sum(len(bag)) AS total FROM kept WHERE train GROUP BY word),
            terms AS (SELECT word, term, count(*) AS c FROM (SELECT word, unnest(bag) AS term FROM kept WHERE train) GROUP BY ALL),
            sizes AS (SELECT (SELECT sum(n) FROM classes) AS rows, (SELECT count(*) FROM classes) AS n_classes, (SELECT count(DISTINCT term) FROM terms) AS n_terms),
            bags AS (SELECT DISTINCT bag, len(bag) AS size FROM kept WHERE NOT train),
            fixed AS (SELECT word, size, ln((n + 1.0::DOUBLE) / (rows + n_classes)) - size * ln(total + 1.0::DOUBLE * n_terms) AS score
                      FROM classes, sizes, (SELECT DISTINCT size FROM bags)),
            gains AS (SELECT bag, size, terms.word, sum(tf * ln(1 + c / 1.0::DOUBLE)) AS gain
                      FROM (SELECT bag, size, term, count(*) AS tf FROM (SELECT bag, size, unnest(bag) AS term FROM bags) GROUP BY ALL) JOIN terms USING (term) GROUP BY ALL),
            scores AS (SELECT bag, word, round(score + gain, 9) AS score FROM gains JOIN fixed USING (word, size)
                       UNION ALL SELECT bag, word, score FROM bags JOIN (SELECT size, min_by(word, (-round(score, 9), word)) AS word, max(round(score, 9)) AS score
                                                                         FROM fixed GROUP BY size) USING (size)),
            best AS (SELECT bag, min_by(word, (-score, word)) AS pred_word, max(score) AS score FROM scores GROUP BY bag)
            SELECT doc_id, line_no, pos, word, pred_word, round(score, 6) AS score FROM kept JOIN best USING (bag) WHERE NOT train""",
        "top_words": lambda: base + "SELECT word, count(*) AS count FROM posts GROUP BY word ORDER BY count DESC, word LIMIT 100",
        "words_by_length": lambda: base + "SELECT DISTINCT word, length(word)::INT AS n_chars FROM posts",
        "center_distances": lambda: """WITH x AS (SELECT vec_id, label, unnest(range(1, len(embedding) + 1)) AS d,
                                          unnest(embedding)::DOUBLE AS v FROM embeddings),
            c AS (SELECT label, d, avg(v) AS v FROM x GROUP BY ALL)
            SELECT vec_id, c.label AS center, round(sqrt(sum((x.v - c.v) * (x.v - c.v))), 6) AS distance
            FROM x JOIN c USING (d) GROUP BY vec_id, c.label""",
        "knn_graph": lambda: """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)
            SELECT vec_id, rank, neighbor, round(distance, 6) AS distance FROM (
              SELECT a.vec_id, b.vec_id AS neighbor, list_distance(a.v, b.v) AS distance,
                     row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.v, b.v), b.vec_id)::INT AS rank
              FROM e a JOIN e b ON a.vec_id <> b.vec_id) WHERE rank <= 5""",
        "emb_random": lambda: with_(lines(), posts(), toks(), sampled(keep=f"WHERE word NOT IN {stops()}"), windows(), vocab(),
                            TERMS, WEIGHTED, CENTROIDS, random_rows(EMB_DIM)) + wide(EMB_DIM),
        "vec_text_lines": lambda: conv_vec() + f"""SELECT 0 AS ord, '' AS word, count(*) || ' {VEC_DIM}' AS line FROM vectors
            UNION ALL SELECT 1, word, word || ' ' || array_to_string(
              list_transform(vec, lambda x: printf('%.6f', x)), ' ') FROM vectors""",
        "vec_roundtrip": lambda: conv_vec() + wide(VEC_DIM),
        "stream_postings": lambda: base + f"SELECT {p4} FROM posts",
    }
    out = {}
    for name, text in texts.items():
        try:
            out[name] = text()
        except Exception:  # one text that can't be built leaves the others
            logging.getLogger(__name__).exception("no SQL for %s", name)
    return out
