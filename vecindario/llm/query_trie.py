"""Query of the conversation prefix trie."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import prefix_trie as P
from ..session import cut

FAMILY, MOST = 5, 9


def rebuilt(conversations):
    """Each conversation with the first h turns of its family's first one, h = crc32 of its id modulo ``MOST``."""
    own = cut(conversations, "turns")
    first = own.select(F.col("conv_id").alias("base"), F.slice("turns", 1, MOST - 1).alias("begin"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(MOST)).cast("int")
    rows = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY).join(first, "base", "left").withColumn("h", h)
    begin = F.slice(F.coalesce("begin", F.slice("turns", 1, 0)), F.lit(1), F.col("h"))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return rows.select("conv_id", F.concat(begin, rest).alias("turns"))


def op13_prefix_trie(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return P.trie(rebuilt(P.gathered(rows))).select(
        "conv_id", F.col("depth").cast("bigint").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


# crc32 of the decimal id, a bit at a time, as DuckDB has no such function.
_CRC = ("xor(4294967295, list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), "
        "lambda a, b: list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)), xor(a, b)), 4294967295))")
SQL = {"op13_prefix_trie": f"""
    WITH own AS (SELECT conv_id, list(x ORDER BY turn NULLS FIRST, x) AS turns FROM (
                 SELECT conv_id, turn, {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS x FROM conversations) WHERE conv_id IS NOT NULL GROUP BY conv_id),
    built AS (SELECT o.conv_id, list_concat(coalesce(b.turns[1:o.h], []), o.turns[o.h + 1:]) AS turns
              FROM (SELECT *, {_CRC} % {MOST} AS h FROM own) o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % {FAMILY}),
    member AS (SELECT conv_id, len(turns) AS size, unnest(range(len(turns) + 1)) AS depth, turns FROM built),
    node AS (SELECT turns[1:depth] AS path, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
                    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (size = depth), '')) AS ends_sha256
             FROM member GROUP BY turns[1:depth], depth),
    linked AS (SELECT n.*, p.conv_id AS parent_conv_id, (SELECT count(*) FROM node c WHERE c.depth = n.depth + 1 AND c.path[1:n.depth] = n.path) AS n_children,
                      CASE WHEN n.depth > 0 THEN (n.n_convs - 1) * strlen(n.path[n.depth].text) ELSE 0 END AS saved
               FROM node n LEFT JOIN node p ON p.depth = n.depth - 1 AND p.path = n.path[1:n.depth - 1]),
    above AS (SELECT path[1:d] AS top, d AS depth, sum(saved) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
              FROM (SELECT *, unnest(range(depth + 1)) AS d FROM linked) GROUP BY path[1:d], d)
    SELECT l.conv_id, l.depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, ends_sha256
    FROM linked l JOIN above a ON a.top = l.path AND a.depth = l.depth"""}
QUERIES = {"op13_prefix_trie": op13_prefix_trie}
