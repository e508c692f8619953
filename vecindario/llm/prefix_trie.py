"""The prefix trie of conversations by truncation peeling, from the deepest turn up.

A node is a distinct sequence of first turns. Peeling starts at the greatest depth: conversations that end there are
merged with the nodes that survived from below, every node is counted and completed as it is found, then its last turn
is stripped and what became equal is grouped again. Each level passes on only one row per node, with the sums of its
subtree, so shared prefixes are walked once and not once per conversation.

On Spark: a turn is reduced to a 16-byte digest before the first shuffle, a conversation to the chain of digests of
its prefixes. Equal conversations are merged first (``ended``), by a range sort on chain and id that spreads a node at
which very many end, and their ids are hashed in order as a stream. Then two steps take turns until the root is reached.
Where every prefix is shared by few distinct conversations (at most ``GROUP_ROWS``, or ``GROUP_TURNS`` turns in all), tasks
peel group by group down to the smallest depth of which that holds. There, one level is stripped by a Spark aggregation
with partial sums before its shuffle, so a prefix that a third of all conversations share stays spread; what it leaves is
one row per node, mostly few enough for tasks again.

Bounds: a conversation is one row of 24 bytes a turn. The number of jobs is that of the levels at which more than
``GROUP_ROWS`` distinct sequences still meet in one prefix, not that of all levels.

Edge cases: turns go by ``turn`` (null first), ties by their digests; a null role or text is empty; repeated rows are
repeated turns; rows with a null conversation id belong to no conversation and are left out; a conversation without
turns ends at the root; an empty table has no node; only the named columns are read, so others can't clash. Roles and
texts are compared by 128 bits of SHA-256.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut

WIDTH = 16
GROUP_ROWS = 256
GROUP_TURNS = 1024
IDS = 1 << 16  # ids in one piece of a list that is hashed
ROWS = 4096  # rows of a batch that a task returns
NOBODY = hashlib.sha256().hexdigest()

NODE = "path binary, conv_id bigint, depth int, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
ENDED = "chain binary, sizes array<bigint>, depth int, n bigint, least bigint, ends string"
STATE = f"{ENDED}, children bigint, leaves bigint, saved bigint"


def names(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


def gathered(rows: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(``conv_id``, ``turns``): each conversation's turns in order, as (digest, UTF-8 bytes of the text)."""
    said, by = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(role), F.lit(""))
    body = F.concat(F.octet_length(by).cast("string"), F.lit(":"), by, said)
    digest = F.unhex(F.substring(F.sha2(body, 256), 1, 2 * WIDTH))
    turn = F.struct(F.col(order).alias("place"), digest.alias("digest"), F.octet_length(said).cast("bigint").alias("size"))
    listed = rows.filter(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("conv_id"), turn.alias("_turn"))
    listed = listed.groupBy("conv_id").agg(F.sort_array(F.collect_list("_turn")).alias("_turns"))
    return listed.select("conv_id", F.transform("_turns", lambda t: F.struct(t["digest"].alias("digest"), t["size"].alias("size"))).alias("turns"))


def chained(conversations: DataFrame) -> DataFrame:
    """(path, chain, sizes, conv_id): the digests of all prefixes in a row; ``path`` is the last of them, empty at the root."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            digests = column.flatten().to_pylist()
            paths, chains, at = [], [], 0
            for n in np.diff(column.offsets.to_numpy()).tolist():
                path, chain = b"", []
                for digest in digests[at:at + n]:
                    path = hashlib.blake2b(path + digest, digest_size=WIDTH).digest()
                    chain.append(path)
                at += n
                paths.append(path)
                chains.append(b"".join(chain))
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.binary()), pa.array(chains, pa.binary()), batch.column(2), batch.column(0)],
                                             names=["path", "chain", "sizes", "conv_id"])

    rows = conversations.select("conv_id", F.col("turns.digest").alias("digests"), F.col("turns.size").alias("sizes"))
    return rows.mapInArrow(link, "path binary, chain binary, sizes array<bigint>, conv_id bigint")


def batched(rows: Iterable[tuple], types: list[pa.DataType], names: list[str]) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)


def records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            yield from zip(*[c.to_pylist() for c in batch.slice(start, ROWS).columns], strict=True)


def ended(chains: DataFrame) -> DataFrame:
    """One row per distinct conversation: how many end there, the least id and the hash of all ids in order."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces():
            now, ids = None, []
            for path, chain, sizes, conv_id in records(batches):
                if now is None or path != now[0] or len(ids) == IDS:
                    if now is not None:
                        yield (*now, ids[0], len(ids), ",".join(map(str, ids)))
                    now, ids = (path, chain, sizes), []
                ids.append(conv_id)
            if now is not None:
                yield (*now, ids[0], len(ids), ",".join(map(str, ids)))
        yield from batched(pieces(), [pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.string()],
                           ["path", "chain", "sizes", "first", "n", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def whole():
            now = None
            for path, chain, sizes, first, n, ids in records(batches):
                if now is None or path != now[0]:
                    if now is not None:
                        yield (now[1], now[2], len(now[1]) // WIDTH, now[4], now[3], digest.hexdigest())
                    now, digest = [path, chain, sizes, first, 0], hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(ids.encode())
                now[4] += n
            if now is not None:
                yield (now[1], now[2], len(now[1]) // WIDTH, now[4], now[3], digest.hexdigest())
        yield from batched(whole(), [pa.binary(), pa.list_(pa.int64()), pa.int32(), pa.int64(), pa.int64(), pa.string()],
                           ["chain", "sizes", "depth", "n", "least", "ends"])

    pieces = chains.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    pieces = pieces.mapInArrow(listed, "path binary, chain binary, sizes array<bigint>, first bigint, n bigint, ids string")
    return pieces.repartition("path").sortWithinPartitions("path", "first").mapInArrow(hashed, ENDED)


def prefix(depth: Column | int) -> Column:
    """The path at ``depth`` of a chain; at depth 0 it is empty."""
    depth = F.lit(depth) if isinstance(depth, int) else depth
    return F.when(depth > 0, F.substr(F.col("chain"), (depth - 1) * WIDTH + 1, F.lit(WIDTH))).otherwise(F.lit(b""))


def lowest(state: DataFrame, group_rows: int, group_turns: int) -> int:
    """The smallest depth at which, and below which, no prefix has more rows than ``group_rows`` with more than ``group_turns`` turns below it."""
    exploded = state.filter("depth > 0").select("chain", "depth", F.explode(F.sequence(F.lit(0), F.col("depth") - 1)).alias("at"))
    groups = exploded.groupBy("at", prefix(F.col("at")).alias("path")).agg(F.sum(F.col("depth") - F.col("at")).alias("turns"), F.count("*").alias("n"))
    most = groups.filter((F.col("n") > group_rows) & (F.col("turns") > group_turns)).agg(F.max("at")).first()[0]
    return 0 if most is None else most + 1


def peeled(group: list[tuple], low: int) -> tuple[list[tuple], tuple]:
    """Nodes deeper than ``low`` and the one at ``low``, from all rows of ``STATE`` with one prefix of that depth."""
    entering, nodes, above = defaultdict(list), [], {}
    for row in group:
        entering[row[2]].append(row)
    for depth in range(max(entering), low - 1, -1):
        level, above, complete = above, {}, []
        for chain, sizes, _, n, least, ends, children, leaves, saved in entering.pop(depth, ()):
            path = chain[(depth - 1) * WIDTH:] if depth else b""
            if children is not None:  # a node that an earlier step has completed
                complete.append((chain, sizes, (path, least, depth, n, children, leaves, saved, ends)))
            else:  # conversations that end here join the survivors
                node = level.setdefault(path, [least, 0, 0, 0, NOBODY, chain, sizes, []])
                node[0], node[1], node[4] = min(node[0], least), node[1] + n, ends
        for path, (least, n, leaves, saved, ends, chain, sizes, children) in level.items():
            nodes += [(*child[:3], least, *child[3:]) for child in children]
            saved += (n - 1) * sizes[depth - 1] if depth else 0
            complete.append((chain, sizes, (path, least, depth, n, len(children), leaves or 1, saved, ends)))
        if depth == low:
            break
        for chain, sizes, done in complete:  # strip the last turn
            up = above.setdefault(chain[(depth - 2) * WIDTH:(depth - 1) * WIDTH] if depth > 1 else b"", [done[1], 0, 0, 0, NOBODY, chain, sizes, []])
            up[0], up[1], up[2], up[3] = min(up[0], done[1]), up[1] + done[3], up[2] + done[5], up[3] + done[6]
            up[7].append(done)
    (chain, sizes, done), = complete
    return nodes, (chain[:low * WIDTH], sizes[:low], *done)


def peeled_in_tasks(state: DataFrame, low: int) -> DataFrame:
    """Rows of ``NODE`` deeper than ``low``, and the nodes at ``low`` (``top``), without parent but with chain and sizes."""

    def peel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def results(group):
            nodes, top = peeled(group, low)
            for node in nodes:
                yield (*node, False, None, None)
            yield (*top[2:5], None, *top[5:], True, *top[:2])

        def found():
            now, group = None, []
            for mark, *row in records(batches):
                if mark != now and group:
                    yield from results(group)
                    group = []
                now = mark
                group.append(tuple(row))
            if group:
                yield from results(group)
        long = pa.int64()
        yield from batched(found(), [pa.binary(), long, pa.int32(), long, long, long, long, long, pa.string(), pa.bool_(), pa.binary(), pa.list_(long)],
                           [*names(NODE), "top", "chain", "sizes"])

    rows = state.filter(F.col("depth") >= low).select(prefix(low).alias("mark"), *names(STATE))
    return rows.repartition("mark").sortWithinPartitions("mark").mapInArrow(peel, f"{NODE}, top boolean, chain binary, sizes array<bigint>")


def stripped(level: DataFrame, ends: DataFrame, depth: int) -> DataFrame:
    """The nodes at ``depth``: those one deeper without their last turn, and conversations that end here, grouped."""
    carried = level.select(F.substr("chain", F.lit(1), F.lit(depth * WIDTH)).alias("chain"), F.slice("sizes", 1, depth).alias("sizes"), F.col("conv_id").alias("least"),
                           F.col("n_convs").alias("n"), F.lit(1).cast("bigint").alias("children"), F.col("n_leaves").alias("leaves"),
                           F.col("saved_tokens").alias("saved"), F.lit(None).cast("string").alias("ends"))
    zero = F.lit(0).cast("bigint")
    new = ends.filter(F.col("depth") == depth).select("chain", "sizes", "least", "n", zero.alias("children"), zero.alias("leaves"), zero.alias("saved"), "ends")
    sums = carried.unionByName(new).groupBy("chain", "sizes").agg(
        F.min("least").alias("conv_id"), F.sum("n").alias("n_convs"), F.sum("children").alias("n_children"), F.sum("leaves").alias("leaves"),
        F.sum("saved").alias("saved"), F.max("ends").alias("ends"))
    size = F.element_at("sizes", depth) if depth else F.lit(0)
    return sums.select(
        "chain", "sizes", prefix(depth).alias("path"), "conv_id", F.lit(depth).alias("depth"), "n_convs", "n_children",
        F.greatest("leaves", F.lit(1)).alias("n_leaves"), (F.col("saved") + (F.col("n_convs") - 1) * size).alias("saved_tokens"),
        F.coalesce("ends", F.lit(NOBODY)).alias("ends_sha256"))


def with_parents(level: DataFrame, upper: DataFrame, depth: int) -> DataFrame:
    """Rows of ``NODE`` at ``depth`` + 1, given the nodes at ``depth``; the root is one row, so no join is needed there."""
    if not depth:
        return level.withColumn("parent_conv_id", F.lit(upper.select("conv_id").first().conv_id)).select(*names(NODE))
    parents = upper.select(F.col("path").alias("up"), F.col("conv_id").alias("parent_conv_id"))
    return level.withColumn("up", prefix(depth)).join(parents, "up").select(*names(NODE))


def trie(conversations: DataFrame, group_rows: int = GROUP_ROWS, group_turns: int = GROUP_TURNS) -> DataFrame:
    """All nodes (``NODE``) of rows of ``gathered``."""
    whole = cut(ended(cut(chained(conversations), "chains")), "ended")
    blank = [F.lit(None).cast("bigint").alias(c) for c in ("children", "leaves", "saved")]
    ends = whole.select(*names(ENDED), *blank)
    deepest = ends.agg(F.max("depth")).first()[0]
    out, level, top = [], None, deepest
    while top is not None and (level is None or top):
        state = ends if level is None else ends.filter(F.col("depth") < top).unionByName(level.select(
            "chain", "sizes", "depth", F.col("n_convs").alias("n"), F.col("conv_id").alias("least"), F.col("ends_sha256").alias("ends"),
            F.col("n_children").alias("children"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved")))
        low = lowest(state, group_rows, group_turns)
        if level is None or low < top:
            found = cut(peeled_in_tasks(state, low), "peeled")
            out.append(found.filter("not top").select(*names(NODE)))
            level, top = found.filter("top").drop("top", "parent_conv_id"), low
        else:
            upper = cut(stripped(level, ends, top - 1), "level")
            out.append(with_parents(level, upper, top - 1))
            level, top = upper, top - 1
    root = level.withColumn("parent_conv_id", F.lit(None).cast("bigint")) if level is not None else whole.sparkSession.createDataFrame([], NODE)
    for part in out:
        root = root.select(*names(NODE)).unionByName(part)
    return root.select(*names(NODE))
