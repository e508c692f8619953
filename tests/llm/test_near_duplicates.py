import collections
import random

import numpy as np
import pyarrow as pa
import pytest

from vecindario.llm import near_duplicates as N, sketches as S
from vecindario.llm.components import components
from vecindario.llm.textarrays import buffers


def bag(text):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").split()
    return collections.Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)] if w else [])


def brute(a, b):
    return sum(1 / sum(max(a[e] / a[d], b[e] / b[d]) for e in a.keys() | b.keys()) for d in a.keys() & b.keys())


def words(rng, n):
    return [rng.choice("kolu mira tano pelu sira vaku noti geba".split()) + str(rng.randint(0, 300)) for _ in range(n)]


def test_similarity_equals_its_definition():
    rng = random.Random(1)
    for _ in range(60):
        a = words(rng, rng.randint(0, 40))
        b = [w if rng.random() < 0.9 else "new" for w in a] + a[:rng.randint(0, 12)]
        texts = [" ".join(a), " ".join(b)]
        owner, ids, weights = S.bags(*buffers(pa.array(texts)))
        sides = [(ids[owner == i], weights[owner == i]) for i in (0, 1)]
        assert np.isclose(S.similarity(*sides), brute(bag(texts[0]), bag(texts[1])))


def test_registers_agree_as_often_as_texts_are_similar():
    rng = random.Random(2)
    errors = []
    for _ in range(40):
        a = words(rng, 150)
        b = [w if rng.random() < 0.96 else "x" + w for w in a]
        owner, ids, weights = S.bags(*buffers(pa.array([" ".join(a), " ".join(b)])))
        r = S.sketches(owner, ids, weights, 2, 1200)
        errors.append((r[0] == r[1]).mean() - brute(bag(" ".join(a)), bag(" ".join(b))))
    assert abs(np.mean(errors)) < 0.01 and np.max(np.abs(errors)) < 0.08
    alone = S.sketches(*S.bags(*buffers(pa.array([" ".join(b)]))), 1, 1200)
    assert (alone[0] == r[1]).all()


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(70)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in parent if any(x in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("parts", [1, 6])
def test_classes_equal_brute_force(spark, parts):
    rng = random.Random(4)
    texts = []
    for _ in range(25):
        base = words(rng, rng.randint(60, 160))
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 6)):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 8])):
                copy[rng.randrange(len(copy))] = "edit" + str(rng.random())
            texts.append(" ".join(copy))
    shared = words(rng, 60)
    texts += [" ".join(shared + words(rng, 60)) for _ in range(30)]
    texts += [None, "", " ", " ", "one two", "one two", "One  two", "three"] + [texts[0]] * 40
    rows = [(i, t, "clash", b"x") for i, t in enumerate(texts)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, class_id string, node binary").repartition(parts)
    got = {r.doc_id: r.class_id for r in N.classes(df).collect()}
    bags, parent = [bag(t) for t in texts], list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(texts)):
        for j in range(i):
            if (texts[i] or "") == (texts[j] or "") or (bags[i] and bags[j] and bags[i].keys() & bags[j].keys() and brute(bags[i], bags[j]) >= 0.8):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    assert got == {i: find(i) for i in range(len(texts))}


def test_empty_table(spark):
    assert N.classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def joined_classes(texts, threshold=0.8):
    """The least index of each text's class, over all pairs by the definition."""
    bags, parent = [bag(t) for t in texts], list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(texts)):
        for j in range(i):
            shared = sum(bags[i][d] for d in bags[i].keys() & bags[j].keys()) / sum(bags[i].values())  # no term is above its share
            if shared >= threshold and find(i) != find(j) and brute(bags[i], bags[j]) >= threshold:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: find(i) for i in range(len(texts))}


def chain_and_clusters():
    """A chain of successive edits, two clusters of one half in common, and repeated lines."""
    rng = random.Random(5)
    chain = [words(rng, 120)]
    for i in range(59):
        chain.append(list(chain[-1]))
        chain[-1][(i * 7) % 120] = f"step{i}"
    half = words(rng, 70)
    sources = [half + words(rng, 50) for _ in range(2)]
    clusters = []
    for i in range(60):
        copy = list(sources[i % 2])
        for _ in range(rng.randint(1, 3)):
            copy[rng.randrange(70, 120)] = "edit" + str(rng.random())
        clusters.append(copy)
    lines = [words(rng, 12) * 4 + words(rng, 60) for _ in range(2)]
    repeated = [lines[i % 2] + ["end" + str(i)] for i in range(8)]
    return [" ".join(t) for t in chain + clusters + repeated]


def one_bucket(spark, texts):
    """All texts in one bucket, without a leader that stands out."""
    nodes = spark.createDataFrame([(i.to_bytes(2), t) for i, t in enumerate(texts)], "node binary, text string")
    return nodes.selectExpr("1L as key", f"{len(texts)}L as n", "node", "1L as score"), nodes


def in_full(spark, texts, linked):
    got = {i: i for i in range(len(texts))}
    return got | {int.from_bytes(r.node): int.from_bytes(r.component) for r in linked.collect()}


@pytest.mark.parametrize("block", [256, 24])
def test_large_bucket_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(N, "BLOCK", block, raising=False)
    texts = chain_and_clusters()
    random.Random(6).shuffle(texts)
    assert in_full(spark, texts, N.linked_nodes(*one_bucket(spark, texts), 0.8)) == joined_classes(texts)


def test_bucket_stays_open_after_a_round_without_links(spark):
    rng = random.Random(7)
    base = words(rng, 100)
    texts = [" ".join(base[:50] + words(rng, 50)) for _ in range(40)]  # all alone, and so is the leader
    texts = [" ".join(base), " ".join(base[:-1] + ["other"])] + texts
    want = joined_classes(texts)
    assert want[1] == 0 and len(set(want.values())) == 41
    assert in_full(spark, texts, N.linked_nodes(*one_bucket(spark, texts), 0.8)) == want


def test_bounds_are_above_similarities():
    rng = random.Random(8)
    texts = chain_and_clusters()[::5] + [" ".join(words(rng, 5) * rng.randint(1, 6) + words(rng, 30)) for _ in range(10)]
    owner, ids, weights = S.bags(*buffers(pa.array(texts)))
    bags = [(ids[owner == i], weights[owner == i]) for i in range(len(texts))]
    bounds = N.most_similar(bags, bags)
    exact = np.array([[S.similarity(a, b) for b in bags] for a in bags])
    assert (bounds >= exact - 1e-5).all() and np.allclose(np.diag(bounds), 1)


def test_firsts_keep_columns_of_any_name(spark):
    long = " ".join(f"w{i}" for i in range(30000))
    rows = [(1, "same text of five words here"), (1, "same text of five words here"), (3, "same text of five words here"), (4, None), (5, ""), (6, long), (7, long + " x")]
    names = ["_node", "_n", "_key", "_own", "_row", "node", "key", "component", "class_id", "bands", "a.b"]
    docs = spark.createDataFrame([(i, t, *[f"{i}{n}" for n in names]) for i, t in rows], ", ".join(["doc_id long", "text string", *[f"`{n}` string" for n in names]]))
    out = N.firsts(docs.repartition(3))
    assert out.columns == docs.columns
    got = sorted(map(tuple, out.collect()))
    assert got == sorted({tuple(r) for r in docs.collect() if r.doc_id in (1, 4, 6)})
