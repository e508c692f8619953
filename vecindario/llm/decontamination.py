"""Benchmark decontamination: BM25 over test items with block-max WAND, verified by question and answer overlap.

The test items are indexed; every passage of every document is the query. A passage is a window of twice the longest
item's words, and windows overlap by half, so an item that a document quotes lies whole in one of them. Scores are
BM25 divided by the score that an item gives itself, so one threshold serves short and long items.

* Before any scoring, windows are bounded all at once: an item's commonest words make up at most half of the
  threshold, so a window without enough of the item's other words can't reach it. This drops no window that could.
* For the others, block-max WAND walks the posting lists and returns every item at or above the threshold.
* A hit counts if the window has enough of the three-word runs of the item's question, and of its answer; an item of
  fewer than ``SHORT`` words counts only if all its words stand in a row.

The number of items, their mean length, the longest one and each word's document frequency are counted over all items
before any index is built. An index holds about ``BLOCK_ITEMS`` items, chosen by hash; more items make more indexes and as
many scans, so what is sent to the tasks is bounded, and no score depends on the blocks. Documents are never shuffled.

Edge cases: null and empty texts have no passage; a very long text has many windows, taken whole; words are split at
blanks and ASCII marks and compared in lower case; items without a word are no evidence and are left out; repeated items
are all reported, a pair of row and item with its best window (ties: the first); repeated rows are judged one by one; an
empty benchmark finds nothing. ``leaks`` reads only the named columns, ``clean`` keeps all columns as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..session import cut
from .textarrays import BETWEEN, buffers, folded, groups, shingles, word_hashes

K1, B = 1.2, 0.75
THRESHOLD = 0.6
OVERLAP = 0.6
RUN = 3
SHORT = 8
POSTINGS_PER_BLOCK = 8
BLOCK_ITEMS = 20_000
END = np.iinfo(np.int64).max


def hashed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = buffers(column)
    return word_hashes(folded(data), offsets, BETWEEN)


def in_runs(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the runs of ``width`` words, or of all words if there are fewer."""
    return shingles(words, np.array([0, len(words)]), max(1, min(width, len(words))))[0]


def question_of(text: Column) -> Column:
    """Up to the last question mark that has text behind it, or else the first two thirds of the words."""
    words = F.split(F.trim(text), r"\s+")
    asked = F.regexp_extract(text, r"(?s)^(.*\?)\s*\S", 1)
    return F.when(F.length(asked) > 0, asked).otherwise(F.array_join(F.slice(words, F.lit(1), F.ceil(F.size(words) * 2 / 3).cast("int")), " "))


def parts_of(items: DataFrame, item: str, text: str, question: str | None, answer: str | None) -> DataFrame:
    """(item, question, answer)."""
    if question and answer:
        return items.select(F.col(item).alias("item"), F.coalesce(question, F.lit("")).alias("question"), F.coalesce(answer, F.lit("")).alias("answer"))
    body = F.coalesce(F.col(text), F.lit(""))
    words = F.split(F.trim(body), r"\s+")
    asked = F.regexp_extract(body, r"(?s)^(.*\?)\s*\S", 1)
    rest = F.when(F.length(asked) > 0, F.substring(body, F.length(asked) + 1, F.length(body))).otherwise(
        F.array_join(F.slice(words, F.ceil(F.size(words) * 2 / 3).cast("int") + 1, F.size(words)), " "))
    return items.select(F.col(item).alias("item"), question_of(body).alias("question"), rest.alias("answer"))


@dataclass
class Counts:
    """Over all items: their number, mean and greatest number of words, and the number of items with each word of a block."""

    n: int
    mean: float
    longest: int
    df: dict[int, int]


class Index:
    """Posting lists of the items' words, with the highest impact of each block of postings."""

    def __init__(self, items: list, questions: list[str], answers: list[str], counts: Counts | None = None):
        parts = [hashed(pa.array(x, pa.string())) for x in (questions, answers)]
        sizes = np.diff(parts[0][1]) + np.diff(parts[1][1])
        keep = np.flatnonzero(sizes > 0)
        self.items = [items[i] for i in keep]
        self.runs = [[np.unique(in_runs(h[at[i]:at[i + 1]], RUN)) for i in keep] for h, at in parts]
        self.longest = counts.longest if counts else int(sizes.max(initial=0))
        if not len(keep):
            return
        self.short = {}  # item number -> words and hash of a short item
        for number, i in enumerate(keep):
            if sizes[i] < SHORT:
                whole = np.concatenate([h[at[i]:at[i + 1]] for h, at in parts])
                self.short[number] = len(whole), in_runs(whole, SHORT)[0]
        bags = [np.unique(np.concatenate([h[at[i]:at[i + 1]] for h, at in parts]), return_counts=True) for i in keep]
        self.words = np.unique(np.concatenate([b[0] for b in bags]))
        term = np.concatenate([np.searchsorted(self.words, b[0]) for b in bags])
        owner = np.repeat(np.arange(len(bags)), [len(b[0]) for b in bags])
        tf = np.concatenate([b[1] for b in bags]).astype(float)
        length = np.bincount(owner, weights=tf)
        df, n, mean = np.bincount(term, minlength=len(self.words)), len(bags), length.mean()
        if counts:
            df, n, mean = np.array([counts.df[w] for w in self.words.view(np.int64).tolist()]), counts.n, counts.mean
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        impact = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[owner] / mean))
        impact /= np.bincount(owner, weights=impact)[owner]
        order = np.lexsort((owner, term))
        self.at = np.searchsorted(term[order], np.arange(len(self.words) + 1))
        self.owner, self.impact = owner[order], impact[order]
        # the commonest words of each item, up to half of the threshold, are left out of the bound
        common = np.lexsort((-df[term], owner))
        run = np.cumsum(impact[common])
        run -= np.repeat(np.concatenate(([0], run[np.searchsorted(owner[common], np.arange(1, len(bags))) - 1])) if len(bags) > 1 else [0.0], np.bincount(owner))
        free = np.zeros(len(term), dtype=bool)
        free[common] = run <= THRESHOLD / 2
        self.allowance = np.bincount(owner, weights=impact * free, minlength=len(bags))
        telling = ~free[order]
        self.telling_at = np.concatenate(([0], np.cumsum(telling)))[self.at]
        self.telling_owner, self.telling_impact = self.owner[telling], self.impact[telling]

    def possible(self, window: np.ndarray, term: np.ndarray) -> np.ndarray:
        """The windows whose telling words let some item reach the threshold; (window, term) pairs are distinct."""
        counts = self.telling_at[term + 1] - self.telling_at[term]
        place = np.repeat(self.telling_at[term] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())
        key = np.repeat(window, counts) * len(self.items) + self.telling_owner[place]
        if not len(key):
            return key
        order = np.argsort(key, kind="stable")
        key, value = key[order], self.telling_impact[place][order]
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        total = np.add.reduceat(value, starts) + self.allowance[key[starts] % len(self.items)]
        return np.unique(key[starts[total >= THRESHOLD - 1e-9]] // len(self.items))

    def search(self, terms: np.ndarray, threshold: float = THRESHOLD) -> list[tuple[int, float]]:
        """(item number, score) of every item at or above ``threshold`` for the distinct ``terms``, by block-max WAND."""
        lists = [Postings(self.owner[self.at[t]:self.at[t + 1]], self.impact[self.at[t]:self.at[t + 1]]) for t in terms]
        found = []
        while True:
            lists = sorted((x for x in lists if x.item != END), key=lambda x: x.item)
            bound, pivot = 0.0, None
            for i, x in enumerate(lists):
                bound += x.highest
                if bound >= threshold - 1e-9:
                    pivot = i
                    break
            if pivot is None:
                return found
            item = lists[pivot].item
            while pivot + 1 < len(lists) and lists[pivot + 1].item == item:
                pivot += 1
            ahead = lists[:pivot + 1]
            blocks = [x.block(item) for x in ahead]
            if sum(top for top, _ in blocks) < threshold - 1e-9:
                beyond = min(last for _, last in blocks) + 1
                if pivot + 1 < len(lists):
                    beyond = min(beyond, lists[pivot + 1].item)
                for x in ahead:
                    x.skip(beyond)
            elif lists[0].item == item:
                score = sum(float(x.impacts[x.at]) for x in ahead)
                if score >= threshold - 1e-9:
                    found.append((int(item), score))
                for x in ahead:
                    x.skip(item + 1)
            else:
                for x in ahead:
                    x.skip(item)

    def hits(self, column: pa.Array) -> Iterator[tuple[int, int, float, float, float]]:
        """(row, item number, score, question overlap, answer overlap) of each verified hit."""
        if not self.items:
            return
        hashes, at = hashed(column)
        if not len(hashes):
            return
        found = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        places = np.flatnonzero(self.words[found] == hashes)
        if not len(places):
            return
        step = self.longest
        counts = np.maximum(1, -(-np.diff(at) // step))  # windows of 2 * step words start every step words
        first = np.concatenate(([0], np.cumsum(counts)))
        row = np.searchsorted(at, places, side="right") - 1
        window = first[row] + (places - at[row]) // step
        earlier = (places - at[row]) >= step
        pairs = np.unique(np.concatenate((window, window[earlier] - 1)) * len(self.words) + np.concatenate((found[places], found[places[earlier]])))
        owner, term = pairs // len(self.words), pairs % len(self.words)
        for w in self.possible(owner, term).tolist():
            a, b = np.searchsorted(owner, [w, w + 1])
            hits = self.search(term[a:b])
            if not hits:
                continue
            r = int(np.searchsorted(first, w, side="right") - 1)
            start = int(at[r] + (w - first[r]) * step)
            end = int(min(start + 2 * step, at[r + 1]))
            runs = np.unique(np.concatenate([in_runs(hashes[start:end], n) for n in range(1, RUN + 1)]))
            for item, score in hits:
                overlap = [np.isin(x[item], runs).mean() if len(x[item]) else 1.0 for x in self.runs]
                if min(overlap) >= OVERLAP and self.in_a_row(item, hashes[start:end]):
                    yield r, item, score, *map(float, overlap)

    def in_a_row(self, item: int, window: np.ndarray) -> bool:
        """Whether a short item's words stand in a row in ``window``; other items pass."""
        if item not in self.short:
            return True
        width, whole = self.short[item]
        return len(window) >= width and bool((in_runs(window, width) == whole).any())


class Postings:
    """A posting list with a place in it."""

    __slots__ = ("at", "highest", "impacts", "item", "items", "lasts", "tops")

    def __init__(self, items: np.ndarray, impacts: np.ndarray):
        self.items, self.impacts, self.at = items, impacts, 0
        ends = np.minimum(np.arange(POSTINGS_PER_BLOCK, len(items) + POSTINGS_PER_BLOCK, POSTINGS_PER_BLOCK), len(items)) - 1
        self.lasts = items[ends]
        self.tops = np.maximum.reduceat(impacts, np.arange(0, len(items), POSTINGS_PER_BLOCK))
        self.highest, self.item = float(impacts.max()), int(items[0])

    def block(self, item: int) -> tuple[float, int]:
        """The highest impact of the block that could hold ``item``, and the block's last item."""
        i = int(np.searchsorted(self.lasts, item))
        return (float(self.tops[i]), int(self.lasts[i])) if i < len(self.lasts) else (0.0, END - 1)

    def skip(self, item: int) -> None:
        self.at = int(np.searchsorted(self.items, item))
        self.item = int(self.items[self.at]) if self.at < len(self.items) else END


def bags(parts: DataFrame) -> DataFrame:
    """(part, n, words): the block, number of words and distinct word hashes of each item with a word."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in groups(batch, "question"):
                halves = [hashed(part.column(i)) for i in (1, 2)]
                rows = [np.concatenate([h[at[i]:at[i + 1]] for h, at in halves]) for i in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in rows], pa.int32()),
                                                  pa.array([np.unique(x).view(np.int64).tolist() for x in rows], pa.list_(pa.int64()))], names=["part", "n", "words"])

    return parts.select("part", "question", "answer").mapInArrow(split, "part int, n int, words array<bigint>").filter("n > 0")


def indexes(items: DataFrame, item: str = "item_id", text: str = "text", question: str | None = None, answer: str | None = None,
            block_items: int = BLOCK_ITEMS) -> Iterator[Index]:
    """One index for each block of about ``block_items`` items."""
    rows = parts_of(items, item, text, question, answer)
    blocks = max(1, -(-rows.count() // block_items))
    rows = cut(rows.withColumn("part", F.pmod(F.xxhash64("item", "question", "answer"), F.lit(blocks)).cast("int")), "items")
    words = cut(bags(rows), "bags")
    whole = words.agg(F.count("*").alias("n"), F.avg("n").alias("mean"), F.max("n").alias("longest")).first()
    if not whole.n:
        return
    df = cut(words.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("df")), "frequencies")
    for part in range(blocks):
        own = words.filter(F.col("part") == part).select(F.explode("words").alias("word")).distinct()
        found = {r.word: r.df for r in df.join(own, "word").collect()}  # words of one block
        held = rows.filter(F.col("part") == part).select("item", "question", "answer").orderBy("item", "question", "answer").collect()
        if found:
            yield Index(*map(list, zip(*held, strict=True)), Counts(whole.n, whole.mean, whole.longest, found))


def leaks(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", **names) -> DataFrame:
    """(``key``, ``item``, score, question_overlap, answer_overlap): the best window of each pair of a row and an item."""
    schema = T.StructType([T.StructField(key, documents.schema[key].dataType), T.StructField(item, items.schema[item].dataType),
                           *[T.StructField(c, T.DoubleType()) for c in ("score", "question_overlap", "answer_overlap")]])
    out = documents.sparkSession.createDataFrame([], schema)
    for index in indexes(items, item, **names):
        def find(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in groups(batch, text):
                    best: dict = {}
                    for r, i, *scores in index.hits(part.column(1)):
                        best[r, i] = max(best.get((r, i), [0.0]), scores)
                    if best:
                        yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array([r for r, _ in best])), pa.array([index.items[i] for _, i in best]),
                                                          *[pa.array([s[j] for s in best.values()], pa.float64()) for j in range(3)]], names=schema.names)

        out = out.unionByName(documents.select(key, text).mapInArrow(find, schema))
    return out


def clean(documents: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", **names) -> DataFrame:
    """The rows of ``documents``, all columns, that hold no item."""
    at = documents.columns.index(text)
    for index in indexes(items, item, **names):
        def keep(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in groups(batch, text):
                    bad = np.zeros(part.num_rows, dtype=bool)
                    bad[[r for r, *_ in index.hits(part.column(at))]] = True
                    yield part.filter(pa.array(~bad))

        documents = documents.mapInArrow(keep, documents.schema)
    return documents
