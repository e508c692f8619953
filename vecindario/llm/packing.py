"""Best-fit packing by minimum bin slack.

Per bin, the longest length left is set first and a subset-sum dynamic program over bit sets finds the
fullest combination of the other lengths; that combination is removed, as often as the counts allow.
The program needs only the count of each length (at most ``capacity`` of them), so its work does not grow
with the input: each combination uses up one length at least. Places follow from each piece's number
within its length, without any join on bins.

Edge cases: a null text is empty and becomes one piece of the end token; a very long text is cut into many pieces, and
texts are encoded in groups of about a megabyte, so memory follows the longest text and not the batch; pieces of equal
length are ties, and take their places in the order of the partitions; repeated rows are packed one by one;
lengths outside 1..capacity are an error; an empty table gives an empty result. ``token_pieces`` returns only the key and
its own columns; ``pack`` replaces columns named like its results.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import tokens
from .dense import numbered
from .textarrays import groups

CAPACITY = 2048
END_TOKEN = 0


def token_pieces(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_token: int = END_TOKEN,
                 key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: ``key``, piece, start, length, ids_crc32 and, if asked for, ids (binary, 16 bit)."""
    fields = [documents.schema[key], T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
              T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    schema = T.StructType(fields + [T.StructField("ids", T.BinaryType())] * with_ids)

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, last = tokens.chunks(tokenizer).encode, np.array([end_token], dtype="<u2").tobytes()
        for batch in (part for batch in batches for part in groups(batch, text)):
            rows = [[] for _ in schema.fields]
            keys = batch.column(0).to_pylist()
            for i, body in enumerate(batch.column(1)):
                ids = encode(body.as_py()) + last
                for piece, at in enumerate(range(0, len(ids), 2 * capacity)):
                    part = ids[at:at + 2 * capacity]
                    crc = zlib.crc32(np.frombuffer(part, dtype="<u2").astype("<u4").tobytes())
                    for column, value in zip(rows, (keys[i], piece, at // 2, len(part) // 2, crc, part), strict=False):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(v, type=t) for v, t in zip(rows, types(batch), strict=True)], names=schema.names)

    def types(batch):
        return [batch.schema.types[0], pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * with_ids

    return documents.select(key, text).mapInArrow(cut_up, schema)


def fullest(room: int, counts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(length, times) of the fullest combination that fits ``room``; counts: (length, number left), longest first.

    Bit s of ``reached`` says that the sum s can be made. Each length enters in portions of 1, 2, 4, ... pieces.
    """
    reached, full, steps = 1, (1 << (room + 1)) - 1, []
    for length, left in counts:
        most, portion = min(left, room // length), 1
        while most > 0:
            portion = min(portion, most)
            before = reached
            reached = (reached | reached << (portion * length)) & full
            if reached != before:
                steps.append((length, portion, before))
            most -= portion
            portion *= 2
        if reached >> room & 1:
            break
    used, at = {}, reached.bit_length() - 1
    for length, portion, before in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + portion
            at -= portion * length
    return list(used.items())


def combinations(histogram: dict[int, int], capacity: int) -> Iterator[tuple[list[tuple[int, int]], int]]:
    """([(length, times in a bin)], number of such bins) until every piece is used."""
    left = {k: v for k, v in histogram.items() if v}
    while left:
        lengths = sorted(left, reverse=True)
        longest = lengths[0]
        rest = [(k, left[k] - (k == longest)) for k in lengths]
        times = dict([(longest, 1)])
        for k, n in fullest(capacity - longest, rest):
            times[k] = times.get(k, 0) + n
        bins = min(left[k] // n for k, n in times.items())
        for k, n in times.items():
            left[k] -= n * bins
            if not left[k]:
                del left[k]
        yield list(times.items()), bins


def places(histogram: dict[int, int], capacity: int) -> np.ndarray:
    """Rows of (length, first number, first bin, times, offset), sorted: where the pieces of a length go."""
    rows, taken, first_bin = [], {}, 0
    for times, bins in combinations(histogram, capacity):
        base = 0
        for length, n in times:
            rows.append((length, taken.get(length, 0), first_bin, n, base))
            taken[length] = taken.get(length, 0) + n * bins
            base += n * length
        first_bin += bins
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, capacity: int = CAPACITY, length: str = "length") -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with a length of 1..capacity."""
    sized = numbered(pieces.drop("sequence_id", "offset"), length, "_number")
    histogram = {r[0]: r[1] for r in sized.groupBy(length).count().collect()}  # at most ``capacity`` rows
    if any(k is None or not 1 <= k <= capacity for k in histogram):
        raise ValueError(f"lengths must lie in 1..{capacity}")
    table = places(histogram, capacity)
    starts = table[:, 0] << 44 | table[:, 1]
    schema = T.StructType([*[f for f in sized.schema.fields if f.name != "_number"],
                           T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, number = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in (length, "_number"))
            found = table[np.searchsorted(starts, size << 44 | number, side="right") - 1] if len(table) else np.zeros((len(size), 5), dtype=np.int64)
            nth = number - found[:, 1]
            times = np.maximum(found[:, 3], 1)
            names = [n for n in batch.schema.names if n != "_number"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(batch.schema.get_field_index(n)) for n in names], pa.array(found[:, 2] + nth // times),
                 pa.array(found[:, 4] + nth % times * size)], names=[*names, "sequence_id", "offset"])

    return sized.mapInArrow(place, schema)
