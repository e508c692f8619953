"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

1. Each text gives a fixed number of statistics (``STATISTICS``), counted over its bytes and words.
2. Standardised by the training rows' moments, they go through cosine features whose inner products
   approximate a Gaussian kernel.
3. The normal equations of the ridge fit are summed per partition and added up: their size is fixed, so the fit
   uses every training row at any scale and the driver sees one small matrix.
4. A fifth of the training rows (by a hash) is kept from the fit; their scores, counted in 2,001 bins, give a monotone
   map to probabilities by pooling adjacent violators.

Edge cases: null and empty texts have statistics of zero and are scored like any other; labels other than 0 and 1,
null ones and those without a document are ignored; without training rows every score is 0.5; rows with
equal keys are scored one by one; an empty table gives an empty result; very long texts are counted whole; equal raw scores share a bin
and so a probability; columns named stats or score are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..session import cut
from .textarrays import buffers, groups, word_hashes

STATISTICS = ("log_bytes", "log_words", "word_bytes", "lower", "upper", "digit", "blank", "sentence", "comma", "shout", "bar", "symbol", "bracket",
              "other_ascii", "beyond_ascii", "control", "newline", "distinct_words", "next_equal", "pair_again", "upper_per_word", "symbol_per_word", "bar_per_word",
              "shout_per_word")
FEATURES = 200
WIDTH = 4.0
RIDGE = 1.0
SEED = 11
FIT_TASKS = 64
BINS = 2000
RAMP = 0.01  # share of the plain score, so that rows of one calibration step keep their order

# Fixed classes of bytes, by the names in STATISTICS.
CLASSES = ("lower", "upper", "digit", "blank", "sentence", "comma", "shout", "bar", "symbol", "bracket", "other_ascii", "beyond_ascii", "control", "newline")
CLASS_OF = np.full(256, CLASSES.index("other_ascii"), dtype=np.int64)
CLASS_OF[128:] = CLASSES.index("beyond_ascii")
CLASS_OF[:32] = CLASSES.index("control")
for name, characters in (("lower", bytes(range(97, 123))), ("upper", bytes(range(65, 91))), ("digit", b"0123456789"), ("blank", b" \t\v\f\r"), ("newline", b"\n"),
                         ("sentence", b"."), ("comma", b",;:'\"-"), ("shout", b"!?"), ("bar", b"|"), ("symbol", b"#*$%&<>@^~_=+\\/"), ("bracket", b"()[]{}")):
    CLASS_OF[list(characters)] = CLASSES.index(name)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of ``STATISTICS`` for each text."""
    n, sizes = len(offsets) - 1, np.diff(offsets).astype(float)
    doc = np.repeat(np.arange(n), np.diff(offsets))
    counts = np.bincount(doc * len(CLASSES) + CLASS_OF[data], minlength=n * len(CLASSES)).reshape(n, len(CLASSES)).astype(float)
    hashes, at = word_hashes(data, offsets)
    words = np.diff(at).astype(float)
    owner = np.repeat(np.arange(n), np.diff(at))
    same = np.zeros(len(hashes), dtype=bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    inner = owner[1:] == owner[:-1]
    pairs, pair_owner = (hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:])[inner], owner[1:][inner]
    bytes_, some = np.maximum(sizes, 1)[:, None], np.maximum(words, 1)
    column = dict(zip(CLASSES, (counts / bytes_).T, strict=True))
    per = dict(zip(CLASSES, (counts / some[:, None]).T, strict=True))
    column |= {"log_bytes": np.log1p(sizes), "log_words": np.log1p(words), "word_bytes": (sizes - counts[:, CLASSES.index("blank")]) / some,
               "distinct_words": distinct(owner, hashes, n) / some, "next_equal": np.bincount(owner, weights=same, minlength=n) / some,
               "pair_again": (np.bincount(pair_owner, minlength=n) - distinct(pair_owner, pairs, n)) / some}
    column |= {f"{c}_per_word": np.minimum(per[c], 20) for c in ("upper", "symbol", "bar", "shout")}
    column["word_bytes"] = np.minimum(column["word_bytes"], 100)
    return np.stack([column[c] for c in STATISTICS], axis=1)


def distinct(owner: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    if not len(values):
        return np.zeros(n)
    order = np.lexsort((values, owner))
    owner, values = owner[order], values[order]
    first = np.ones(len(values), dtype=bool)
    first[1:] = (owner[1:] != owner[:-1]) | (values[1:] != values[:-1])
    return np.bincount(owner[first], minlength=n).astype(float)


def described(documents: DataFrame, text: str = "text", name: str = "stats") -> DataFrame:
    """Replace ``text`` by its statistics, an array column ``name``; the other columns pass through."""
    kept = [c for c in documents.columns if c not in (text, name)]
    schema = T.StructType([*[documents.schema[c] for c in kept], T.StructField(name, T.ArrayType(T.DoubleType()))])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in groups(batch, text):
                stats = statistics(*buffers(part.column(len(kept))))
                at = pa.array(np.arange(len(stats) + 1) * len(STATISTICS), pa.int32())
                yield pa.RecordBatch.from_arrays([*part.columns[:len(kept)], pa.ListArray.from_arrays(at, pa.array(stats.ravel()))], names=schema.names)

    return documents.select(*kept, text).mapInArrow(measure, schema)


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


@dataclass
class Model:
    """A fitted scorer; small and independent of the corpus size."""

    mean: np.ndarray = field(default_factory=lambda: np.zeros(len(STATISTICS)))
    scale: np.ndarray = field(default_factory=lambda: np.ones(len(STATISTICS)))
    weights: np.ndarray | None = None
    raw: np.ndarray = field(default_factory=lambda: np.array([0.0]))
    calibrated: np.ndarray = field(default_factory=lambda: np.array([0.5]))

    def cosines(self, stats: np.ndarray) -> np.ndarray:
        """The random features and a constant."""
        random = np.random.default_rng(SEED)
        w = random.standard_normal((stats.shape[1], FEATURES)) / WIDTH
        b = random.uniform(0, 2 * np.pi, FEATURES)
        z = np.clip((stats - self.mean) / self.scale, -8, 8)
        return np.concatenate((np.sqrt(2 / FEATURES) * np.cos(z @ w + b), np.ones((len(stats), 1))), axis=1)

    def ridge(self, stats: np.ndarray) -> np.ndarray:
        return self.cosines(stats) @ self.weights if self.weights is not None else np.zeros(len(stats))

    def score(self, stats: np.ndarray) -> np.ndarray:
        ridge = self.ridge(stats)
        return (1 - RAMP) * np.interp(ridge, self.raw, self.calibrated) + RAMP * (np.clip(ridge, 0, 1) if self.weights is not None else 0.5)


def pooled(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The non-decreasing fit to ``values`` by weighted squares (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for v, w in zip(values.tolist(), weights.tolist(), strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks[-1]
            blocks[-1] = [(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2]
    return np.concatenate([np.full(n, v) for v, _, n in blocks]) if blocks else np.zeros(0)


def fit(training: DataFrame, key: str = "doc_id") -> Model:
    """Fit on rows of (``key``, stats, label 0 or 1)."""
    training = training.filter(F.col("label").isin(0, 1)).withColumn("_fold", F.pmod(F.xxhash64(F.lit("calibration"), F.col(key).cast("string")), F.lit(5)))
    moments = training.select(*[f(F.get("stats", i)).alias(f"{n}{i}") for i in range(len(STATISTICS)) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    model = Model()
    if moments["m0"] is None:
        return model
    model.mean = np.array([moments[f"m{i}"] for i in range(len(STATISTICS))])
    model.scale = np.array([max(moments[f"s{i}"], 1e-6) for i in range(len(STATISTICS))])
    size = FEATURES + 1

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size + 1))
        for batch in batches:
            z = model.cosines(matrix(batch.column(0)))
            total += z.T @ np.concatenate((z, batch.column(1).to_numpy(zero_copy_only=False).astype(float)[:, None]), axis=1)
        if total[-1, -2]:
            i, j = np.divmod(np.arange(total.size), size + 1)
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total.ravel())], names=["i", "j", "v"])

    fitted = training.filter("_fold <> 0").select("stats", "label").coalesce(FIT_TASKS).mapInArrow(equations, "i int, j int, v double")
    total = np.zeros((size, size + 1))
    for r in fitted.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():  # size x (size + 1) rows
        total[r.i, r.j] = r.v
    if not total[-1, -2]:
        return model
    penalty = RIDGE * np.eye(size)
    penalty[-1, -1] = 1e-9
    model.weights = np.linalg.solve(total[:, :-1] + penalty, total[:, -1])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = np.clip(np.rint((model.ridge(matrix(batch.column(0))) + 0.5) * BINS / 2), 0, BINS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(bins), batch.column(1)], names=["bin", "label"])

    rows = training.filter("_fold = 0").select("stats", F.col("label").cast("int").alias("label")).mapInArrow(counted, "bin int, label int")
    rows = rows.groupBy("bin").agg(F.count("*").alias("n"), F.sum("label").alias("ones")).orderBy("bin").collect()  # at most BINS + 1 rows
    model.raw = np.arange(BINS + 1) * 2 / BINS - 0.5
    model.calibrated = np.clip(model.raw, 0, 1)
    if rows:
        at, n, ones = (np.array([float(r[c]) for r in rows]) for c in ("bin", "n", "ones"))
        model.raw, model.calibrated = at * 2 / BINS - 0.5, pooled(ones / n, n)
    return model


def scored(stats: DataFrame, model: Model) -> DataFrame:
    """Replace the column ``stats`` by ``score``."""
    kept = [c for c in stats.columns if c not in ("stats", "score")]
    schema = T.StructType([*[stats.schema[c] for c in kept], T.StructField("score", T.DoubleType())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(matrix(batch.column(len(kept)))) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(kept)], pa.array(np.clip(score, 0, 1))], names=schema.names)

    return stats.select(*kept, "stats").mapInArrow(apply, schema)


def held_out(key: Column, parts: int = 3, part: int = 1) -> Column:
    """Rows kept from learning: the checksum of the key as text leaves ``part``."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string")), F.lit(parts)) == part, F.lit(False))


def classify(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """(``key``, held_out, score, predicted) for every document; learns from labels of rows that are not held out."""
    stats = cut(described(documents.select(key, text), text), "stats")
    marked = labels.select(key, F.col(label).alias("label")).filter(~held_out(F.col(key)))
    model = fit(cut(stats.join(marked, key), "training"), key)
    return scored(stats, model).select(key, held_out(F.col(key)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
