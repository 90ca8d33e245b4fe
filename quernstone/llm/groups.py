"""Meetings of what shares a key, for joins on blocks and buckets: no task holds all members of a hot key, and keys with the same members meet once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.common import lean, materialise, mix64

#: Rows of keys that are held at once.
LONG = 1 << 19
#: Sizes further apart than this don't meet.
RATIO = 1.75
#: Members of a small group, and bits of a sample in which two that belong together differ at most.
SMALL, APART = 8, 19


@lean
def members_of_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (v, key, mark) sorted by key and mark -> (group, v, key) of the keys with several members. A mark is a size times 2**48 and a sample of 48 bits. Where the next size is more than RATIO times the last, another group begins; in
    groups of up to SMALL members those go whose samples differ from all others in more than APART bits. group is a hash of the members, so that keys with the same ones are one group; of
    those at hand only the first is passed on. A key of more than LONG members is passed on as it comes, under a group of its own, so that none is held whole."""
    held: list[tuple[np.ndarray, ...]] = []
    have = 0
    streaming: int | None = None

    def own_group(key: int) -> int:
        return int(mix64(np.array([key], np.int64).view(np.uint64) + np.uint64(1 << 40)).view(np.int64)[0])

    def rows(group: np.ndarray, v: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(group), pa.array(v), pa.array(key.astype(np.int64))], names=["group", "v", "key"])

    def grouped(v: np.ndarray, key: np.ndarray, marks: np.ndarray) -> pa.RecordBatch:
        sizes, samples = marks >> 48, (marks & ((1 << 48) - 1)).view(np.uint64)
        starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (sizes[1:] > RATIO * sizes[:-1])])
        size = np.diff(np.r_[starts, len(key)])
        number = np.repeat(np.arange(len(starts)), size)
        close = np.repeat(size > SMALL, size)
        several = np.flatnonzero(np.repeat((size > 1) & (size <= SMALL), size))
        for far in range(1, SMALL):
            a = several[:-far]
            a = a[(several[far:] == a + far) & (number[several[far:]] == number[a])]
            if not len(a):
                break
            a = a[np.bitwise_count(samples[a] ^ samples[a + far]) <= APART]
            close[a] = close[a + far] = True
        v, key, number = v[close], key[close], number[close]
        if not len(v):
            return rows(v, v, key)
        starts = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])
        size = np.diff(np.r_[starts, len(key)])
        with np.errstate(over="ignore"):
            group = mix64(np.add.reduceat(mix64(v.view(np.uint64)), starts) + size.astype(np.uint64))
        keep = np.flatnonzero(size > 1)
        keep = keep[np.unique(group[keep], return_index=True)[1]]
        size, starts = size[keep], starts[keep]
        at = np.repeat(starts - np.r_[0, np.cumsum(size)[:-1]] if len(size) else starts, size) + np.arange(size.sum())
        return rows(np.repeat(group[keep].view(np.int64), size), v[at], key[at])

    for batch in batches:
        if not batch.num_rows:
            continue
        v, key, marks = (batch.column(i).to_numpy() for i in range(3))
        if streaming is not None:
            more = int(np.searchsorted(key != streaming, True))
            if more:
                yield rows(np.full(more, own_group(streaming), np.int64), v[:more], key[:more])
            if more == len(key):
                continue
            v, key, marks, streaming = v[more:], key[more:], marks[more:], None
        held.append((v, key, marks))
        have += len(key)
        if have < LONG:
            continue
        v, key, marks = (np.concatenate(x) for x in zip(*held, strict=True))
        last = int(np.flatnonzero(np.r_[True, key[1:] != key[:-1]])[-1])
        if last:
            yield grouped(v[:last], key[:last], marks[:last])
        held, have = [(v[last:], key[last:], marks[last:])], len(key) - last
        if have >= LONG:
            streaming = int(key[-1])
            yield rows(np.full(have, own_group(streaming), np.int64), v[last:], key[last:])
            held, have = [], 0
    if held:
        yield grouped(*(np.concatenate(x) for x in zip(*held, strict=True)))


def meetings(keyed: DataFrame, tile: int) -> DataFrame:
    """keyed: (v, key, mark) -> (group, x, y, side, v, key), where any two v that share a key and have sizes of at most RATIO to 1 and samples within APART bits meet in a task (group, x, y) of at most about two tiles.

    A group is the members of one or more keys, key the least of these; alone a v makes no group. A group of more than ``tile`` members is cut into tiles by a hash; tile x
    is side 0 of the tasks (x, y) with y >= x, and side 1 of (y, x) with y < x. A task with only one side of two different tiles has nothing to compare.
    """
    found = keyed.repartition("key").sortWithinPartitions("key", "mark").mapInArrow(members_of_keys, "group long, v long, key long")
    member = materialise(found.groupBy("group", "v").agg(F.min("key").alias("key")))
    large = member.groupBy("group").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > tile).select(F.col("group").alias("large"), F.ceil(F.col("members") / tile).cast("int").alias("cut"))
    tiles = F.coalesce("cut", F.lit(1))
    placed = member.join(large, F.col("group") == F.col("large"), "left").select("group", "v", "key", tiles.alias("tiles"), F.pmod(F.xxhash64(F.col("v"), F.lit(1)), tiles).cast("int").alias("tile"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    return placed.select("group", F.least("tile", "other").alias("x"), F.greatest("tile", "other").alias("y"), (F.col("tile") > F.col("other")).cast("int").alias("side"), "v", "key")
