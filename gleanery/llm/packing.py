"""Packing pieces into sequences by minimum bin slack.

For each bin, the largest remaining length is fixed, and a bitset subset-sum over the available
lengths finds the fullest combination for the rest; that combination is removed, as often as its
lengths allow. Pieces are dealt by hash to groups of about ``group_rows``, so that no task holds
more; each group loses about one sequence against a single pool, whatever the size of the table.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import cut


def fullest(counts: list[tuple[int, int]], room: int) -> list[int]:
    """The lengths of the fullest combination within ``room``; counts: (length, available), longest first.

    Bit s of ``reach`` is set if some combination sums to s. The walk ends as soon as the room is full.
    """
    mask, full = (1 << (room + 1)) - 1, 1 << room
    reach, trace = 1, []
    for length, available in counts:
        if length > room:
            continue
        for _ in range(min(available, room // length)):
            more = (reach | (reach << length)) & mask
            if more == reach:
                break
            trace.append((length, reach))
            reach = more
        if reach & full:
            break
    target, out = reach.bit_length() - 1, []
    for length, before in reversed(trace):
        if not before >> target & 1:
            out.append(length)
            target -= length
    return out


def minimum_bin_slack(lengths: list[int], capacity: int) -> list[tuple[list[int], int]]:
    """Bins as (lengths, times): together they use every given length (1 to capacity) exactly once."""
    left = Counter(lengths)
    order = sorted(left, reverse=True)
    bins = []
    at = 0
    while at < len(order):
        largest = order[at]
        if not left[largest]:
            at += 1
            continue
        left[largest] -= 1
        room = capacity - largest
        rest = fullest([(x, left[x]) for x in order[at:] if left[x] and x <= room], room) if room else []
        left[largest] += 1
        one = [largest, *rest]
        need = Counter(one)
        times = min(left[x] // k for x, k in need.items())
        for x, k in need.items():
            left[x] -= k * times
        bins.append((one, times))
    return bins


def pack(pieces: DataFrame, capacity: int = 2048, key: str = "doc_id", group_rows: int = 20_000) -> DataFrame:
    """Adds sequence_id and offset (gapless from 0 in each sequence) to pieces (key, piece, length, any others).

    Every row is placed once, repeated rows too; lengths must be from 1 to capacity. ``pieces``
    is written to the checkpoint folder first, as its number of rows decides the groups.
    """
    rows = cut(pieces)
    groups = max(1, -(-rows.count() // group_rows))
    rows = rows.withColumn("pack_group", F.pmod(F.xxhash64(F.col(f"`{key}`"), "piece"), F.lit(groups)))

    def place(table: pa.Table) -> pa.Table:
        table = table.sort_by([(key, "ascending"), ("piece", "ascending")])
        lengths = table.column("length").to_pylist()
        waiting: dict[int, list[int]] = {}
        for i in range(len(lengths) - 1, -1, -1):
            waiting.setdefault(lengths[i], []).append(i)
        sequence, offset = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
        n = 0
        for one, times in minimum_bin_slack(lengths, capacity):
            for _ in range(times):
                filled = 0
                for x in one:
                    i = waiting[x].pop()
                    sequence[i], offset[i] = n, filled
                    filled += x
                n += 1
        sequence += table.column("pack_group")[0].as_py() << 32
        return table.drop_columns(["pack_group"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return rows.groupBy("pack_group").applyInArrow(place, f"{schema}, sequence_id long, offset long")
