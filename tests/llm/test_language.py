import collections
import random
import zlib

import numpy as np

from vecindario.llm import language as L

STEMS = {"aa": ["kolu", "mira", "tano", "pelu"], "bb": ["schtra", "gruft", "kampf", "wirst"], "cc": ["ðora", "þing", "ævi", "ísl"]}


def text(rng, lang, n):
    return " ".join("".join(rng.choices(STEMS[lang], k=rng.randint(1, 3))) for _ in range(n)) + "."


def table(spark, n=400):
    rng = random.Random(3)
    rows = []
    for i in range(n):
        lang = rng.choice(list(STEMS))
        rows.append((i, text(rng, lang, rng.randint(3, 60)), lang, "clash", 0.0))
    rows += [(n, None, "aa", "c", 0.0), (n + 1, "", None, "c", 0.0), (n + 2, "123 !! 456\n", "bb", "c", 0.0), (n + 3, text(rng, "cc", 30000), None, "c", 0.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score double").repartition(5), n


def test_held_out_accuracy_and_edges(spark):
    docs, n = table(spark)
    out = {r.doc_id: r for r in L.identify(docs).collect()}
    assert len(out) == n + 4
    truth = {r.doc_id: r.lang for r in docs.collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in out.items())
    judged = [i for i in range(n) if out[i].held_out]
    assert len(judged) > 50 and np.mean([out[i].lang_pred == truth[i] for i in judged]) > 0.95
    assert all(0 <= r.score <= 1 for r in out.values())
    assert [out[n + j].lang_pred for j in range(4)] == ["und", "und", "und", "cc"]


def test_frequencies_cover_every_document(spark):
    docs, n = table(spark, 60)
    got = L.frequencies(docs.repartition(7))
    want = np.zeros(L.BUCKETS)
    texts = [c for r in docs.collect() if (c := L.counted(r.text)) is not None]
    for c in texts:
        want += c > 0
    assert (got[:-1] == want).all() and got[-1] == len(texts)


def test_counts_equal_brute_force_and_ignore_blocks(monkeypatch):
    sample = "Straße, ÉTÉ 99x  – Łódź\n" * 40
    whole = L.counted(sample)
    chars = [32, *L.letters(sample).tolist(), 32]
    assert whole.sum() == sum(len(chars) - k for k in range(3))
    grams = collections.Counter(tuple(chars[i:i + k + 1]) for k in range(3) for i in range(len(chars) - k))
    assert np.count_nonzero(whole) <= len(grams)
    for size in (7, 64, 1000):
        monkeypatch.setattr(L, "BLOCK", size)
        assert (L.counted(sample) == whole).all()
    assert (L.counted("STRASSE été") == L.counted("strasse   ÉTÉ")).all()


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "some words", None), (2, None, None)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in L.identify(docs).collect()} == {"und"}
    assert L.identify(docs.limit(0)).count() == 0


def test_sample_is_bounded_per_language(spark):
    docs, _ = table(spark, 120)
    model = L.fit(docs, per_language=5)
    assert model.languages == ["aa", "bb", "cc"] and (model.weights == 0).mean() > 0.9


def test_temperature_minimises_log_loss():
    rng = np.random.default_rng(0)
    logits, labels = rng.normal(size=(500, 3)) * 3, rng.integers(0, 3, 500)
    t = L.cooled(logits, labels)

    def loss(x):
        return -np.log(L.softmax(logits / x)[np.arange(500), labels]).mean()
    assert loss(t) <= min(loss(x) for x in np.linspace(0.5, 9, 40)) + 1e-6


def test_equally_likely_languages_give_the_first_by_name():
    model = L.Model(["aa", "bb", "cc"], np.ones(L.BUCKETS), np.zeros((L.BUCKETS, 3)))
    assert model.predict("kolu mira") == ("aa", 1 / 3) and model.predict("12 !") == (L.UNKNOWN, 0.0)
