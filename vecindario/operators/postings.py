"""Postings: token occurrences, lookups, codecs, sampling and their context windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import arrays as A, text as T
from ..functions.hashing import hash_key
from ..session import cut

LEVELS = 24  # halvings of the hash range that a cutoff may take
CUT_WORDS = 65_536  # most frequent words with a cutoff at most, as the cutoffs are broadcast

LINE_KEYS = ("doc_id", "line_no")


def tokens(lines: DataFrame, *, tokenizer=T.tokenize, keys: tuple[str, ...] = LINE_KEYS) -> DataFrame:
    """One row per token with its 0-based offset in the line."""
    return lines.select(*keys, F.posexplode(tokenizer(F.col("line"))).alias("offset", "word"))


def postings(lines: DataFrame, *, tokenizer=T.tokenize, keys: tuple[str, ...] = LINE_KEYS) -> DataFrame:
    """``(word, doc_id, line_no, offset)`` for every occurrence, stop words included."""
    return tokens(lines, tokenizer=tokenizer, keys=keys).select("word", *keys, "offset")


def lookup(posts: DataFrame, words: list[str]) -> DataFrame:
    """All postings of some words; the filter reaches a parquet scan."""
    return posts.filter(F.col("word").isin(list(words)))


def encode_coordinate(line: Column, offset: Column) -> Column:
    return F.concat_ws(",", line.cast("string"), offset.cast("string"))


def decode_coordinate(coo: Column) -> Column:
    parts = F.split(coo, ",")
    return F.struct(parts[0].cast("int").alias("line_no"), parts[1].cast("int").alias("offset"))


def sample(posts: DataFrame, samples: int = 50, *, seed: int = 42,
           keys: tuple[str, ...] = LINE_KEYS) -> DataFrame:
    """Up to ``samples`` postings per word, chosen by seeded hash; 0 or less keeps all.

    Postings above the cutoff of a frequent word go before anything is sorted. The rank filter becomes
    a group limit on the map side, so a task sends at most ``samples`` rows of a word to the shuffle.
    """
    if samples <= 0:
        return posts
    ranked = posts.withColumn("rank_key", hash_key("word", *keys, "offset", seed=seed))
    cutoffs = hash_cutoffs(ranked, samples)
    if cutoffs is not None:
        low = F.col("cutoff").isNull() | (F.col("rank_key") < F.col("cutoff"))
        ranked = ranked.join(F.broadcast(cutoffs), "word", "left").filter(low).drop("cutoff")
    ranked = ranked.withColumn("rank_key", F.unhex("rank_key"))  # the same order in half the bytes
    order = Window.partitionBy("word").orderBy("rank_key", *keys, "offset")
    return (
        ranked.withColumn("rn", F.row_number().over(order))
        .filter(F.col("rn") <= samples)
        .drop("rank_key", "rn")
    )


def hash_cutoffs(ranked: DataFrame, samples: int, *, most: int | None = None) -> DataFrame | None:
    """``(word, cutoff)`` of the most frequent words: ``samples`` postings at least have a ``rank_key`` below it.

    The cutoffs are halvings of the hash range whose postings were all counted, so none of the lowest ``samples`` is
    above one. A word without enough postings below half the range, or beyond the ``most`` most frequent, has none.
    """
    low = F.conv(F.substring("rank_key", 1, 8), 16, 10).cast("bigint")
    levels = {j: f"n{j}" for j in range(1, LEVELS + 1)}
    counts = ranked.select("word", low.alias("low")).groupBy("word").agg(
        F.count("*").alias("n"), *[F.count_if(F.col("low") < (1 << 32 - j)).cast("int").alias(c) for j, c in levels.items()])
    cutoff = F.coalesce(*[F.when(F.col(c) >= samples, F.lit(f"{1 << 32 - j:08x}")) for j, c in reversed(levels.items())])
    frequent = counts.filter((F.col("n") > 4 * samples) & F.col("word").isNotNull()).select("word", "n", cutoff.alias("cutoff"))
    found = cut(frequent.filter(F.col("cutoff").isNotNull()).orderBy(F.desc("n"), "word").limit(most or CUT_WORDS).drop("n"), "cutoffs")
    return None if found.isEmpty() else found


def attach_lines(posts: DataFrame, lines: DataFrame, *, keys: tuple[str, ...] = LINE_KEYS) -> DataFrame:
    """The line of each posting."""
    return posts.join(lines, list(keys))


def context_windows(lines: DataFrame, *, wsize: int = 10, samples: int = 50, seed: int = 42,
                    words: list[str] | None = None, exclude: list[str] | None = None,
                    tokenizer=T.tokenize, keys: tuple[str, ...] = LINE_KEYS) -> DataFrame:
    """``(word, doc_id, line_no, offset, window)``: up to ``wsize`` tokens on each side.

    Sampling runs on bare postings and the chosen offsets go back to their line once,
    as one array per line, so a line of n tokens never travels n times. ``words``
    keeps, and ``exclude`` drops, centre words; context tokens are never dropped.
    """
    def wanted(df: DataFrame) -> DataFrame:
        if words is not None:
            df = lookup(df, words)
        if exclude:
            df = df.filter(~F.col("word").isin(exclude))
        return df

    toks = lines.select(*keys, tokenizer(F.col("line")).alias("toks"))
    if samples <= 0:
        picked = wanted(postings(lines, tokenizer=tokenizer, keys=keys)) if words is not None else None
        if picked is None:
            return wanted(
                toks.select(*keys, F.posexplode(F.transform(
                    "toks", lambda t, i: F.struct(t.alias("word"), A.around(F.col("toks"), i, wsize).alias("window"))
                )).alias("offset", "pick"))
                .select("pick.word", *keys, "offset", "pick.window")
            )
    else:
        picked = sample(wanted(postings(lines, tokenizer=tokenizer, keys=keys)), samples, seed=seed, keys=keys)
    per_line = picked.groupBy(*keys).agg(F.collect_list(F.struct("word", "offset")).alias("picks"))
    cuts = F.transform("picks", lambda p: F.struct(
        p["word"].alias("word"), p["offset"].alias("offset"),
        A.around(F.col("toks"), p["offset"], wsize).alias("window")))
    return (
        per_line.join(toks, list(keys))
        .select(*keys, F.explode(cuts).alias("pick"))
        .select("pick.word", *keys, "pick.offset", "pick.window")
    )


def in_vocabulary(posts: DataFrame, vocab: DataFrame) -> DataFrame:
    """Postings whose word is in ``vocab(term, …)``."""
    return posts.join(vocab.select(F.col("term").alias("word")), "word", "left_semi")


def missing_words(vocab: DataFrame, posts: DataFrame) -> DataFrame:
    """Vocabulary words without any posting."""
    return vocab.select(F.col("term").alias("word")).join(posts.select("word").distinct(), "word", "left_anti")
