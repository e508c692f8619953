import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from vecindario.llm import decontamination as D

COMMON = "the of and to in is that for it as".split()


def words(rng, n):
    return [rng.choice(COMMON) if rng.random() < 0.5 else "".join(rng.choices(["ka", "lo", "mi", "ru", "te", "sa"], k=rng.randint(2, 4))) for _ in range(n)]


def bm25(items):
    bags = [Counter(x) for x in items]
    df = Counter(t for b in bags for t in b)
    mean = sum(map(len, items)) / len(items)
    part = [{t: math.log1p((len(items) - df[t] + 0.5) / (df[t] + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(x) / mean)) for t, n in b.items()} for b, x in zip(bags, items)]
    return [{t: v / sum(p.values()) for t, v in p.items()} for p in part]


def test_search_and_bound_equal_brute_force():
    rng = random.Random(1)
    items = [words(rng, rng.randint(8, 40)) for _ in range(300)]
    index = D.Index(list(range(300)), [" ".join(x) for x in items], [""] * 300)
    impacts = bm25(items)
    for _ in range(150):
        base = items[rng.randrange(300)]
        window = [w for w in base if rng.random() < rng.choice([0.3, 0.6, 0.9])] + words(rng, 40)
        hashes, _ = D.hashed(pa.array([" ".join(window)]))
        terms = [t for t, h in enumerate(index.words.tolist()) if h in set(hashes.tolist())]
        for threshold in (0.3, 0.6):
            want = {i: s for i, p in enumerate(impacts) if (s := sum(p[t] for t in set(window) & p.keys())) >= threshold}
            got = dict(index.search(terms, threshold))
            assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)
        possible = index.possible(D.np.zeros(len(terms), dtype=int), D.np.array(terms, dtype=int))
        assert len(possible) or not index.search(terms)


def corpus(seed=2):
    rng = random.Random(seed)
    items = [" ".join(words(rng, rng.randint(15, 55))) + "." for _ in range(60)]
    docs, truth = [], set()
    for i in range(150):
        body = words(rng, rng.randint(0, 900))
        if i % 3 == 0:
            k = rng.randrange(60)
            quote = items[k]
            if i % 2:
                quote = re.sub(r" ", ",\n", quote.upper())
            at = rng.randint(0, len(body))
            body[at:at] = [quote]
            truth.add((i, k))
        elif i % 3 == 1:
            half = items[rng.randrange(60)].split()
            body += half[:len(half) // 2]
        docs.append(" ".join(body))
    return docs, items, truth


@pytest.mark.parametrize("block", [20_000, 17])
def test_planted_items_are_found_and_clean_documents_left(spark, monkeypatch, block):
    monkeypatch.setattr(D, "BLOCK_ITEMS", block)
    docs, items, truth = corpus()
    rows = [(i, d, "x", 0.5) for i, d in enumerate(docs)] + [(900, None, "x", 0.5), (901, "", None, 0.5)] + [(0, docs[0], "x", 0.5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, item_id string, score double").repartition(4)
    bench = spark.createDataFrame(list(enumerate(items)) + [(500, None), (501, "?!")], "item_id long, text string")
    got = D.leaks(df, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == truth and len(got) == len(truth) + 1
    assert all(r.score >= 0.6 for r in got)
    clean = D.clean(df, bench)
    assert clean.columns == df.columns
    bad = {i for i, _ in truth}
    assert sorted(r.doc_id for r in clean.collect()) == sorted(r[0] for r in rows if r[0] not in bad)


def test_question_and_answer_columns(spark):
    bench = spark.createDataFrame([(1, "which river runs through the old town of mirasol", "the slow green kolumar"), (2, None, None)], "item_id long, q string, a string")
    docs = spark.createDataFrame([(1, "x " * 30 + "which river runs through the old town of mirasol"), (2, "Which river runs through the old town of Mirasol? The slow, green Kolumar.")], "doc_id long, text string")
    assert [r.doc_id for r in D.leaks(docs, bench, question="q", answer="a").collect()] == [2]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.leaks(docs, none).count() == 0 and D.clean(docs, none).count() == 1
    assert D.leaks(docs.limit(0), spark.createDataFrame([(1, "one two three four five six seven eight nine")], "item_id long, text string")).count() == 0


def test_scores_do_not_depend_on_blocks(spark):
    docs, items, truth = corpus()
    benchmark = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string")
    documents = spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "doc_id long, text string").repartition(3)
    found = [sorted(map(tuple, D.leaks(documents, benchmark, block_items=n).collect())) for n in (17, 20_000)]
    assert found[0] == found[1] and truth <= {r[:2] for r in found[0]}


def test_short_items_count_only_in_a_row(spark):
    benchmark = spark.createDataFrame([(0, "Which Kalo? mira tesa"), (1, "rumi"), (2, "..."), (3, None), (4, "a long item " + " ".join(words(random.Random(3), 20)))],
                                      "item_id long, text string")
    documents = spark.createDataFrame([(0, "so: WHICH kalo, mira\ntesa now"), (1, "mira which kalo and tesa"), (2, "x rumi y " * 5000), (3, "nothing"), (4, None), (5, "")],
                                      "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in D.leaks(documents, benchmark).collect()} == {(0, 0), (2, 1)}
    assert {r.doc_id for r in D.clean(documents, benchmark).collect()} == {1, 3, 4, 5}


def test_items_with_a_short_answer_are_found(spark):
    question = "what is the " + " ".join(words(random.Random(5), 12)) + "?"
    benchmark = spark.createDataFrame([(0, question + " Kalote")], "item_id long, text string")
    documents = spark.createDataFrame([(0, f"x {question}\nkalote."), (1, f"x {question}\nother.")], "doc_id long, text string")
    assert [(r.doc_id, r.answer_overlap) for r in D.leaks(documents, benchmark).collect()] == [(0, 1.0)]


def test_whole_benchmark_without_words(spark):
    documents = spark.createDataFrame([(0, "text")], "doc_id long, text string")
    assert D.leaks(documents, spark.createDataFrame([(0, "?!")], "item_id long, text string")).collect() == []
