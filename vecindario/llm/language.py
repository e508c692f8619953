"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

* N-grams of 1 to 3 characters of the lower-cased text (anything but letters counts as one blank) are hashed to
  ``BUCKETS`` columns.
* Document frequencies come from every document that may be learned from: each task counts its own, the counts are
  summed.
* The weights are learned by follow-the-regularised-leader with an elastic net on a bounded sample:
  at most ``PER_LANGUAGE`` documents of each language, those with the lowest hash of their key; learning runs in one task.
* A fifth of the sample is kept from learning and sets the temperature of the probabilities.

Whole texts are read, in blocks, for learning and prediction alike.

Edge cases: texts that are null or without any letter are ``und`` with score 0; documents with a null language are
predicted but not learned from; without anything to learn from all are ``und``; rows with equal keys are predicted
one by one; an empty table gives an empty result; of equally likely languages the first by name is given, and of documents whose
keys have equal hashes one is learned from; columns named lang_pred or score are replaced, others pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..session import cut
from .textarrays import groups

BUCKETS = 1 << 15
ORDERS = 3
BLOCK = 1 << 16
PER_LANGUAGE = 1000
SALTS = 64
EPOCHS = 2
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.002, 0.01
UNKNOWN = "und"


def folding() -> np.ndarray:
    """Lower-case letter, or blank, of each code point up to U+024F."""
    out = np.arange(592, dtype=np.uint32)
    for c in range(592):
        low = chr(c).lower()
        out[c] = ord(low) if chr(c).isalpha() and len(low) == 1 else 32
    return out


FOLD = folding()
_ODD = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


def letters(text: str) -> np.ndarray:
    """Code points with case folded and runs of other characters as one blank."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    low = points < len(FOLD)
    points = np.where(low, FOLD[np.where(low, points, 0)], points)
    points[(points >= 0x2000) & (points < 0x2070)] = 32
    blank = points == 32
    return points[~np.concatenate(([False], blank[1:] & blank[:-1]))] if len(points) else points


def counted(text: str | None) -> np.ndarray | None:
    """How often the text has each bucket's n-grams; None for texts without a letter."""
    if not text or not any(c.isalpha() for c in text):
        return None
    points = np.concatenate(([np.uint32(32)], letters(text), [np.uint32(32)]))
    counts = np.zeros(BUCKETS, dtype=np.int64)
    for start in range(0, len(points), BLOCK):
        block = points[max(0, start - ORDERS + 1):start + BLOCK]
        fresh = min(start, ORDERS - 1)
        value = np.zeros(len(block), dtype=np.uint32)
        for order in range(ORDERS):
            value = (value[:-1] if order else value) * np.uint32(0x01000193) + block[order:] * _ODD[order]
            mixed = value ^ (value >> np.uint32(15))
            mixed = mixed * np.uint32(0x2C1B3C6D)
            bucket = (mixed >> np.uint32(17)).astype(np.int64)
            counts += np.bincount(bucket[max(0, fresh - order):], minlength=BUCKETS)
    return counts


def weighted(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The columns and values of the text's TF-IDF vector of length one."""
    at = np.flatnonzero(counts)
    x = (1 + np.log(counts[at])) * idf[at]
    norm = np.sqrt(x @ x)
    return at, x / norm if norm else x


def frequencies(documents: DataFrame, text: str = "text") -> np.ndarray:
    """Number of documents with each bucket, and as last entry the number of documents."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS + 1, dtype=np.int64)
        for batch in batches:
            for body in batch.column(0):
                if (counts := counted(body.as_py())) is not None:
                    total[:-1] += counts > 0
                    total[-1] += 1
        if total[-1]:
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    out = np.zeros(BUCKETS + 1)
    rows = documents.select(text).mapInArrow(count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    for r in rows.collect():  # at most BUCKETS + 1 rows
        out[r.bucket] = r.n
    return out


@dataclass
class Model:
    """A fitted predictor; small and independent of the corpus size."""

    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # buckets x languages, mostly zero
    temperature: float = 1.0

    def predict(self, text: str | None) -> tuple[str, float]:
        counts = counted(text) if self.languages else None
        if counts is None:
            return UNKNOWN, 0.0
        at, x = weighted(counts, self.idf)
        p = softmax(x @ self.weights[at] / self.temperature)
        best = int(np.argmax(p))
        return self.languages[best], float(p[best])


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def learn(rows: list[tuple[np.ndarray, np.ndarray, int]], n_languages: int, epochs: int = EPOCHS) -> np.ndarray:
    """FTRL-proximal weights over (columns, values, class) rows, in a fixed shuffled order."""
    z, n = np.zeros((BUCKETS, n_languages)), np.zeros((BUCKETS, n_languages))

    def current(zs, ns):
        return np.where(np.abs(zs) > L1, -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(ns)) / ALPHA + L2), 0.0)

    order = np.random.default_rng(5)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, x, label = rows[i]
            w = current(z[at], n[at])
            error = softmax(x @ w)
            error[label] -= 1
            g = np.outer(x, error)
            root = np.sqrt(n[at])
            z[at] += g - (np.sqrt(n[at] + g * g) - root) / ALPHA * w
            n[at] += g * g
    return current(z, n)


def cooled(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least log loss, by golden section over its logarithm."""
    if not len(labels):
        return 1.0

    def loss(log_t):
        p = softmax(logits / np.exp(log_t))
        return -np.log(np.maximum(p[np.arange(len(labels)), labels], 1e-12)).mean()

    low, high, ratio = np.log(0.02), np.log(10.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fit(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """Fit on rows of (``key``, ``text``, ``lang``); rows without a language are left out."""
    labelled = labelled.select(key, text, lang).filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    spark = labelled.sparkSession
    n = frequencies(labelled, text)
    idf = np.log((n[-1] + 1) / (n[:-1] + 1)) + 1
    ranked = labelled.select(key, lang).withColumn("_order", F.xxhash64(F.col(key).cast("string")))
    chosen = ranked.withColumn("_salt", F.pmod("_order", F.lit(SALTS)))
    for part in ([lang, "_salt"], [lang]):  # a language that most documents have is first thinned in parts
        chosen = chosen.withColumn("_nth", F.row_number().over(Window.partitionBy(*part).orderBy("_order", key))).filter(F.col("_nth") <= per_language)
    chosen = cut(chosen.select(key, lang, "_order").distinct(), "chosen")
    sample = labelled.join(F.broadcast(chosen), [key, lang])  # per_language rows of each language
    sample = cut(sample.select(text, lang, F.pmod("_order", F.lit(5)).alias("fold"), "_order").dropDuplicates(["_order", lang]), "sample")
    languages = sorted(r[0] for r in chosen.select(lang).distinct().collect())
    if not languages:
        return Model([], idf, np.zeros((BUCKETS, 0)))

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, kept = [], []
        for batch in batches:
            for body, label, fold in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                if (counts := counted(body)) is not None:
                    (rows if fold else kept).append((*weighted(counts, idf), languages.index(label)))
        weights = learn(rows, len(languages))
        logits = np.array([x @ weights[at] for at, x, _ in kept]).reshape(-1, len(languages))
        temperature = cooled(logits, np.array([label for *_, label in kept], dtype=int))
        at, column = np.nonzero(weights)
        yield pa.RecordBatch.from_arrays([pa.array([*at.tolist(), -1], pa.int32()), pa.array([*column.tolist(), -1], pa.int32()),
                                          pa.array([*weights[at, column].tolist(), temperature])], names=["bucket", "language", "weight"])

    learned = sample.repartition(1).sortWithinPartitions("_order", lang).select(text, lang, "fold").mapInArrow(train, "bucket int, language int, weight double")
    model = Model(languages, idf, np.zeros((BUCKETS, len(languages))))
    for r in learned.collect():  # at most BUCKETS x languages rows
        if r.bucket < 0:
            model.temperature = r.weight
        else:
            model.weights[r.bucket, r.language] = r.weight
    return model


def predicted(documents: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Replace ``text`` by lang_pred and score; the other columns pass through."""
    kept = [c for c in documents.columns if c not in (text, "lang_pred", "score")]
    schema = T.StructType([*[documents.schema[c] for c in kept], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for batch in batches for part in groups(batch, text)):
            found = [model.predict(body.as_py()) for body in batch.column(len(kept))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(kept)], pa.array([x for x, _ in found], pa.string()),
                                              pa.array([p for _, p in found], pa.float64())], names=schema.names)

    return documents.select(*kept, text).mapInArrow(apply, schema)


def held_out(key: Column, parts: int = 4, part: int = 2) -> Column:
    """Rows kept from learning: the checksum of the key as text leaves ``part``."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string")), F.lit(parts)) == part, F.lit(False))


def identify(documents: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(``key``, held_out, lang_pred, score) for every document; learns from the rows that are not held out."""
    model = fit(documents.filter(~held_out(F.col(key))), key, text, lang)
    return predicted(documents.select(key, text), model, text).select(key, held_out(F.col(key)).alias("held_out"), "lang_pred", "score")
