import collections
import random
import zlib

import numpy as np
import pytest
import tokenizers

from vecindario.llm import packing, tokens

PATH = tokens.default_path()


def test_ids_equal_the_tokenizer():
    random.seed(3)
    whole = tokenizers.Tokenizer.from_file(PATH)
    mine = tokens.Chunks(PATH)
    latin = [chr(c) for c in [*range(9, 14), *range(32, 127), *range(0xA0, 0x250)]]
    texts = ["".join(random.choices(latin, k=random.randint(0, 40))) for _ in range(5000)]
    texts += ["".join(random.choices("abcdefghijklmnopqrstuvwxyz '", k=60)) for _ in range(3000)]
    texts += ["a\x1cb c\x1fd", "ΑΣ ΟΔΟΣ", "<|endoftext|> x<|startoftext|>y", "中文 字 é İ", "don't WE'LL 12345", "\x00 \x01", "😀😀 ​"]
    for t in texts:
        assert np.frombuffer(mine.encode(t), "<u2").tolist() == whole.encode(t, add_special_tokens=False).ids, repr(t)


def test_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_BYTES", 64 * 300)
    mine, plain = tokens.Chunks(PATH), tokens.Chunks(PATH)
    for i in range(500):
        assert mine.encode(f"w{i} v{i % 7} {'long' * i}") == b"".join(plain[c] for c in (f"w{i}", f"v{i % 7}", "long" * i))
        assert mine.held <= 32 * 300 and len(mine) + len(mine.older) <= 80 and max(map(len, mine)) < 300


def subset(room, counts):
    sums = {0}
    for length, left in counts:
        sums = {s + k * length for s in sums for k in range(left + 1) if s + k * length <= room}
    return max(sums)


def test_fullest_is_the_best_sum():
    random.seed(1)
    for _ in range(200):
        room = random.randint(1, 60)
        counts = sorted({random.randint(1, 40): random.randint(1, 5) for _ in range(6)}.items(), reverse=True)
        used = dict(packing.fullest(room, counts))
        assert all(n <= dict(counts)[k] for k, n in used.items())
        assert sum(k * n for k, n in used.items()) == subset(room, counts)


def test_combinations_use_everything():
    random.seed(2)
    histogram = {k: random.randint(1, 5000) for k in random.sample(range(1, 1000), 600)}
    used, bins = collections.Counter(), 0
    for times, n in packing.combinations(histogram, 2048):
        assert sum(k * m for k, m in times) <= 2048 and n > 0
        bins += n
        for k, m in times:
            used[k] += m * n
    assert used == histogram
    assert bins <= 1.01 * sum(k * n for k, n in histogram.items()) / 2048 + 2


TEXTS = [None, "", "hello world", "hello world", " ".join(f"tok{i}" for i in range(9000)), "x", "word " * 2047, "word " * 2046 + "end", "é" * 50] + [f"small text {i} " * (i % 40) for i in range(300)]


@pytest.mark.parametrize("parts", [1, 5])
def test_pieces_and_places(spark, parts):
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string, offset string, length int").repartition(parts)
    out = packing.pack(packing.token_pieces(df, PATH, with_ids=True)).collect()
    whole = tokenizers.Tokenizer.from_file(PATH)
    by_doc = collections.defaultdict(list)
    for r in out:
        by_doc[r.doc_id].append(r)
    assert len(by_doc) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        ids = whole.encode(t or "", add_special_tokens=False).ids + [0]
        want = [ids[a:a + 2048] for a in range(0, len(ids), 2048)]
        got = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.length for r in got] == list(map(len, want)) and [r.start for r in got] == list(range(0, len(ids), 2048))
        assert [r.ids_crc32 for r in got] == [zlib.crc32(np.array(x, "<u4").tobytes()) for x in want]
        assert [np.frombuffer(r.ids, "<u2").tolist() for r in got] == want
    bins = collections.defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    for spans in bins.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= sum(r.length for r in out) / 2048 * 1.02 + 1


def test_empty_table_and_bad_lengths(spark):
    assert packing.pack(packing.token_pieces(spark.createDataFrame([], "doc_id long, text string"), PATH)).count() == 0
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(1, 0)], "k int, length long"))


def test_word_and_mark_share_the_cache():
    mine = tokens.Chunks(PATH)
    for text in ["Hola, hola. HOLA! (hola)", "İ. ß. ª. naïve, ½. a½, don't.", "Ω. ΛΟΓΟΣ. ok) )", "", "."]:
        assert mine.encode(text) == np.array(mine.exact(text), dtype="<u2").tobytes()
    assert "Hola" in mine and "Hola," not in mine
