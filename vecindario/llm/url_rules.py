"""URL filters as a sort-merge range join.

A rule's host is written label by label from the right (``org.example.``), so that with its path it is the prefix
of the keys that it fits, and an interval in their order. As a rule also fits subdomains, each distinct
(host, path) gives one key per host level; the levels of one host stand at its own depth, so rules and keys are
compared within a level. Rules and keys are sorted together by range partitions; a sweep keeps the stack of rules
whose interval is open, and its top is the longest rule that fits. What is open at the start of a partition comes
from the partitions before it: per partition, only the rules open at its last key are carried (no more than the
key has characters).

A url that no rule fits is allowed, unless another ``default`` is given.

Edge cases: null urls and urls without ``://`` have an empty host and path and fit no rule; of repeated rules one
counts, and block wins over allow if both are given; repeated urls are decided once and joined back; an empty
rule table decides all by default; other columns pass through, but for those that have an output's name;
very long urls are read whole; rules that fit at one host level are nested, so the longest of them is one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..session import cut

SEP = "\x01"  # between reversed host and path
OUTPUTS = ("host", "path", "rule", "verdict")


def host_of(url: Column) -> Column:
    raw = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(rules: DataFrame) -> DataFrame:
    """(rule, key, verdict) of rules with columns host, path, verdict."""
    host = F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    labels = F.reverse(F.split(host, r"\."))
    return (rules.select(F.concat(host, "path").alias("rule"), key_of(labels, F.col("path")).alias("key"), "verdict")
            .groupBy("rule", "key").agg(F.max("verdict").alias("verdict")))


def key_of(labels: Column, path: Column) -> Column:
    return F.concat(F.lpad(F.size(labels).cast("string"), 4, "0"), F.array_join(labels, "."), F.lit(SEP), path)


def decided(keys: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, verdict) for each row of ``keys`` (host, path, key) that lies in a rule's interval."""
    rows = keys.select("key", F.lit(1).alias("kind"), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    rows = rows.unionByName(rules.select("key", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"), "rule", "verdict"))
    rows = cut(rows, "events")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.spark_partition_id().alias("part")
    dealt = rows.repartitionByRange(parts, "key", "kind", F.xxhash64("host", "path")).sortWithinPartitions("key", "kind")
    dealt = cut(dealt.select("*", part, F.monotonically_increasing_id().alias("at")), "sorted")
    carried = carry(dealt)

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack, now = [], None
        for batch in batches:
            out = [[], [], [], []]
            for key, kind, host, path, rule, verdict, part in zip(*[batch.column(i).to_pylist() for i in range(7)], strict=True):
                if part != now:
                    now, stack = part, list(carried.get(part, ()))
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if kind == 0:
                    stack.append((key, rule, verdict))
                elif stack:
                    for column, value in zip(out, (host, path, *stack[-1][1:]), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in out], names=list(OUTPUTS))

    ordered = dealt.repartition(parts, "part").sortWithinPartitions("part", "at").select("key", "kind", "host", "path", "rule", "verdict", "part")
    return ordered.mapInArrow(sweep, "host string, path string, rule string, verdict string")


def carry(dealt: DataFrame) -> dict[int, tuple]:
    """The rules open at the start of each partition, outermost first.

    Each partition tells its first key, its last key and which of its own rules are open at the last one: rows
    bounded by the number of partitions and the depth of the keys.
    """
    ends = dealt.groupBy("part").agg(F.min("key").alias("first"), F.max("key").alias("last"))
    rules = dealt.filter("kind = 0").select("part", "key", "rule", "verdict")
    opened = rules.join(ends, "part").filter(F.col("last").startswith(F.col("key")))
    by_part: dict[int, list] = {}
    for r in opened.select("part", "key", "rule", "verdict").collect():
        by_part.setdefault(r.part, []).append((r.key, r.rule, r.verdict))
    out, open_rules = {}, []
    for r in ends.orderBy("part").collect():
        open_rules = [x for x in open_rules if r.first.startswith(x[0])]
        if open_rules:
            out[r.part] = tuple(open_rules)
        open_rules = sorted(x for x in [*open_rules, *by_part.get(r.part, [])] if r.last.startswith(x[0]))
    return out


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Add host, path, rule (host and path of the longest rule that fits, or null) and verdict."""
    kept = [c for c in pages.columns if c not in OUTPUTS or c == url]
    parsed = pages.select(*kept, host_of(F.col(url)).alias("_host"), path_of(F.col(url)).alias("_path"))
    labels = F.reverse(F.split("host", r"\."))
    distinct = parsed.select(F.col("_host").alias("host"), F.col("_path").alias("path")).filter("host <> ''").distinct()
    depth = F.explode(F.sequence(F.lit(1), F.size(labels)))
    keys = distinct.select("host", "path", labels.alias("labels"), depth.alias("depth"))
    rules = rule_table(rules)
    depths = F.broadcast(rules.select(F.substring("key", 1, 4).cast("int").alias("depth")).distinct())  # host depths of rules: a few
    keys = keys.join(depths, "depth").select("host", "path", key_of(F.slice("labels", F.lit(1), F.col("depth")), F.col("path")).alias("key"))
    longest = decided(keys, rules).groupBy("host", "path").agg(F.max(F.struct(F.length("rule"), "rule", "verdict")).alias("_best"))
    longest = longest.select(F.col("host").alias("_host"), F.col("path").alias("_path"), "_best")
    return parsed.join(longest, ["_host", "_path"], "left").select(
        *kept, F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_best.rule").alias("rule"),
        F.coalesce("_best.verdict", F.lit(default)).alias("verdict"))
