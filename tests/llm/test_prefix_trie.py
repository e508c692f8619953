import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from vecindario.llm import prefix_trie as P, queries, query_trie

SCHEMA = "conv_id long, turn long, role string, text string, path string, depth int"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)


def order(row):
    return [(v is not None, v or 0) if not isinstance(v, str) else (True, v) for v in row]


def brute(rows, rebuild=True):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    built = own
    if rebuild:
        built = {}
        for c, turns in own.items():
            h = zlib.crc32(str(c).encode()) % 9
            built[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children, out = defaultdict(list), []
    for node in members:
        if node:
            children[node[:-1]].append(node)

    def walk(node):
        saved = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        leaves = 0 if children[node] else 1
        for child in children[node]:
            more = walk(child)
            leaves, saved = leaves + more[0], saved + more[1]
        ends = ",".join(str(c) for c in sorted(members[node]) if len(built[c]) == len(node))
        out.append((min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(children[node]), leaves, saved,
                    hashlib.sha256(ends.encode()).hexdigest()))
        return leaves, saved
    if members:
        walk(())
    return sorted(out, key=order)


def same(spark, rows, group_rows=P.GROUP_ROWS, group_turns=P.GROUP_TURNS):
    got = P.trie(query_trie.rebuilt(P.gathered(frame(spark, rows))), group_rows, group_turns).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=order) == brute(rows)
    return got


def conversations(seed, n, turns=6, words=3):
    rng = random.Random(seed)
    return [(c, t, rng.choice(["user", "assistant"]), rng.choice(["a", "bé", "ccc"][:words])) for c in range(n) for t in range(rng.randint(0, turns)) if rng.random() < 0.95]


@pytest.mark.parametrize(("group_rows", "group_turns"), [(0, 0), (1, 0), (3, 6), (1000, 1000)])
def test_equals_brute_force_at_every_split_of_the_work(spark, group_rows, group_turns):
    same(spark, conversations(1, 80), group_rows, group_turns)


def test_query_and_its_sql(spark, tmp_path):
    rows = conversations(2, 60) + [(-3, 0, "user", "a"), (-3, 1, "user", None), (7, None, None, "x"), (None, 0, "user", "a")]
    frame(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.QUERIES["op13_prefix_trie"](spark, str(tmp_path))
    assert got.columns == COLUMNS and dict(got.dtypes)["depth"] == "bigint"
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    twin = con.sql(query_trie.SQL["op13_prefix_trie"])
    assert twin.columns == COLUMNS
    assert sorted(map(tuple, got.collect()), key=order) == sorted(twin.fetchall(), key=order)


def test_hot_first_turn_copies_and_a_long_conversation(spark):
    rows = [(c, 0, "system", "same start") for c in range(0, 600)]
    rows += [(c, 1 + t, "user", f"{c if c % 2 else 'copy'} {t}") for c in range(0, 600) for t in range(c % 4)]
    rows += [(1000, t, "user", f"long {t // 2}") for t in range(700)] + [(1001, t, "user", f"long {t // 2}") for t in range(690)]
    root = max(same(spark, rows, 20, 200), key=lambda r: r.n_convs)
    assert root.n_convs == 602


def test_a_large_group_deep_down_needs_few_steps(spark, monkeypatch):
    steps = []
    monkeypatch.setattr(P, "stripped", lambda *a, f=P.stripped: steps.append(a[2]) or f(*a))
    rows = [(5 * c, t, "user", f"shared {t}" if t < 40 else f"own {c}") for c in range(60) for t in range(41 + c % 2)]
    got = P.trie(P.gathered(frame(spark, rows)), 10, 10).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=order) == brute(rows, rebuild=False) and steps == [40]


def test_many_ends_at_one_node_are_hashed_in_order(spark, monkeypatch):
    monkeypatch.setattr(P, "IDS", 7)
    rows = [(c, 0, "user", "one") for c in range(500)]
    got = P.trie(P.gathered(frame(spark, rows))).collect()
    want = hashlib.sha256(",".join(map(str, range(500))).encode()).hexdigest()
    assert sorted((r.depth, r.n_convs, r.ends_sha256) for r in got) == [(0, 500, P.NOBODY), (1, 500, want)]


def test_nulls_ties_repeats_and_nothing(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (2, None, None, None), (2, 3, "", ""), (None, 0, "user", "zzz"), (6, 0, "user", "a")]
    got = P.trie(P.gathered(frame(spark, rows))).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=order) == brute(rows, rebuild=False)
    assert P.trie(P.gathered(frame(spark, rows).limit(0))).collect() == []
    assert P.trie(P.gathered(frame(spark, [(None, 0, "user", "a")]))).collect() == []


def test_turnless_conversation_ends_at_the_root(spark):
    lone = next(c for c in range(1, 99) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)
    got = same(spark, [(lone, 0, "user", "a")])
    assert [(r.depth, r.n_leaves, r.ends_sha256) for r in got] == [(0, 1, hashlib.sha256(str(lone).encode()).hexdigest())]


def test_supplied_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = queries.QUERIES["op13_prefix_trie"](spark, "/root/testdata/sf0.001").collect()
    assert sorted(map(tuple, got), key=order) == brute(rows)
