"""Operator 8: language-model scoring by online logistic context mixing.

Bytes are coded bit by bit along a Huffman tree. Four predictors, for the contexts of the last one, two and three bytes and of the word so
far, each give a probability from counts over the corpus. Their logits are mixed with weights chosen by a gate (the depth in the
tree). The mixed probability is refined by an adaptive map from (depth, logit)
to observed frequency, and averaged with it. The cost of a bit is its negative log probability, so a document's sum is an exact code length.

Weights and maps are the document's own from its first byte to its last, whatever its length; they move along the coding error after every STEP bytes, as
the decoder could too. Thousands of documents advance in step as numpy arrays.

No document is scored by its own counts: documents are in two halves by a hash of their identifier, and the counts of each half score the other. The counts of all contexts and
bytes of the corpus are gathered as sorted arrays of each partition's sums, by regions of the contexts' hashes, and grow with it. From a region's counts an executor makes its part of the predictors' logits,
in hashed tables of 2**SLOT_BITS slots, which are all that reaches the driver and the workers: 13.7 MB for each half.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.llm.common import byte_batches, joined, lean, materialise, small_batches

#: Slots of each order's table and regions of it that are made apart, as powers of two; input partitions whose sums are added up before all are.
SLOT_BITS, REGION_BITS, FAN_IN = (16, 20, 22, 23), 3, 256
STEP = 64
ORDERS, HALVES = 4, 2
#: Bytes that are coded side by side, and bytes whose cells are sorted at once.
LANE_BYTES, COUNT_BYTES, HELD_BYTES = 4 << 20, 2 << 20, 24 << 20
RATE, MAP_RATE, FIRST_WEIGHT = 0.01, 0.02, 0.3
GATES, MAP_DEPTHS, MAP_STEPS = 4, 8, 33
_MUL = np.uint32(0x9E3779B1)
_WORD_BASE = 0x5BD1E995
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: Powers that a worker keeps.
MOST_KEPT = 5 << 20


_KEPT = [np.zeros(0, np.uint32), np.zeros(0, np.uint32)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers 0 to n - 1 of the word hash's base and of its inverse, modulo 2**32."""
    made = len(_KEPT[0]) < n
    found = [np.cumprod(np.r_[np.uint32(1), np.full(n - 1, x, np.uint32)], dtype=np.uint32) for x in (_WORD_BASE, pow(_WORD_BASE, -1, 1 << 32))] if made else _KEPT
    if made and n <= MOST_KEPT:
        _KEPT[:] = found
    return found[0][:n], found[1][:n]


def contexts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(order, byte) 24-bit contexts of each byte: the last one, two and three bytes, 0 standing for what precedes a text, and a hash of the letters since the last byte
    that isn't one."""
    n = len(data)
    gaps = 3 * np.arange(1, len(offsets))
    at = np.arange(n) + np.repeat(gaps, np.diff(offsets))
    padded = np.zeros(n + 3 * (len(offsets) - 1), np.uint32)
    padded[at] = data
    c1, c2, c3 = padded[at - 1], padded[at - 2], padded[at - 3]
    begin = np.zeros(n + 1, bool)
    begin[offsets] = True
    begin[1:] |= ~_LETTER[data]
    start = np.maximum.accumulate(np.where(begin[:-1], np.arange(n), 0))
    power, back = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint32)
    np.cumsum((data.astype(np.uint32) + np.uint32(1)) * back[:-1], dtype=np.uint32, out=sums[1:])
    word = (sums[:-1] - sums[start]) * power[:-1]
    two = c1 | c2 << np.uint32(8)
    return np.stack([c1, two, two | c3 << np.uint32(16), word >> np.uint32(8)])


def _summed(cells: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The different cells in order, and how often each is there."""
    if times is None:
        cells = np.sort(cells)
    else:
        by = np.argsort(cells, kind="stable")
        cells, times = cells[by], times[by]
    starts = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]]) if len(cells) else np.zeros(0, np.int64)
    return cells[starts], np.diff(np.r_[starts, len(cells)]) if times is None else np.add.reduceat(times, starts) if len(starts) else times


#: A partition's or region's sums: sorted cells (context and byte) as 4-byte and how often each is there as 8-byte numbers.
SUMS = "part int, region int, salt int, cells binary, times binary"


def _regions(part: int, cells: np.ndarray, times: np.ndarray, salt: int) -> Iterator[pd.DataFrame]:
    of = region_of(cells, part % ORDERS)
    for r in range(1 << REGION_BITS):
        own = of == r
        if own.any():
            yield pd.DataFrame({"part": [part], "region": [r], "salt": [salt], "cells": [cells[own].tobytes()], "times": [times[own].astype(np.int64).tobytes()]})


@lean
def _count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Frames: text, half -> SUMS of a partition; the first two orders are part of the third."""
    held: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.uint32), np.zeros(0, np.int64))] * (HALVES * ORDERS)
    fresh: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in held]

    def settle() -> None:
        for p, found in enumerate(fresh):
            if found:
                held[p] = _summed(*(np.concatenate(x) for x in zip(held[p], *found, strict=True)))
                found.clear()

    waiting: list[list[bytes]] = [[] for _ in range(HALVES)]
    sizes = [0] * HALVES

    def take(half: int) -> None:
        raw, waiting[half], sizes[half] = waiting[half], [], 0
        for first, last in byte_batches(raw, COUNT_BYTES):
            data, offsets = joined(raw[first:last])
            found = contexts(data, offsets)
            for k in (2, 3):
                fresh[half * ORDERS + k].append(_summed(found[k] << np.uint32(8) | data))
        if sum(len(x) for own in fresh for x, _ in own) > 1 << 22:
            settle()

    for frame in frames:
        for half, text in zip(frame["half"].tolist(), frame["text"].tolist(), strict=True):
            waiting[half].append(text.encode("utf-8", "replace"))
            sizes[half] += len(waiting[half][-1])
            if sizes[half] > COUNT_BYTES:
                take(half)
    for h in range(HALVES):
        take(h)
    settle()
    salt = TaskContext.get().partitionId() // FAN_IN if TaskContext.get() else 0
    for h in range(HALVES):
        cells, times = held[h * ORDERS + 2]
        byte, context = cells & np.uint32(255), cells >> np.uint32(8)
        for k, mask in ((0, 255), (1, 65535)):
            yield from _regions(h * ORDERS + k, *_summed((context & np.uint32(mask)) << np.uint32(8) | byte, times), salt)
        for k in (2, 3):
            yield from _regions(h * ORDERS + k, *held[h * ORDERS + k], salt)


@lean
def _added(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SUMS sorted by part, region and salt -> their totals, one row for each. What is held is as much as the different cells of one of them."""
    key, held, waiting, size = None, None, [], 0

    def settle() -> None:
        nonlocal held, waiting, size
        if waiting:
            held = _summed(*(np.concatenate(x) for x in zip(*([held] if held else []), *waiting, strict=True)))
            waiting, size = [], 0

    def total() -> pd.DataFrame:
        settle()
        return pd.DataFrame({"part": [key[0]], "region": [key[1]], "salt": [key[2]], "cells": [held[0].tobytes()], "times": [held[1].tobytes()]})

    for frame in frames:
        for row in frame.itertuples(index=False):
            if (row.part, row.region, row.salt) != key:
                if key is not None:
                    yield total()
                key, held = (row.part, row.region, row.salt), None
            waiting.append((np.frombuffer(row.cells, np.uint32), np.frombuffer(row.times, np.int64)))
            size += len(waiting[-1][0])
            if size > 1 << 22:
                settle()
    if key is not None:
        yield total()


def half_of(doc_id: Column) -> Column:
    """0 or 1."""
    return F.pmod(F.xxhash64(doc_id.cast("string"), F.lit(5)), F.lit(HALVES)).cast("int")


def gather_counts(docs: DataFrame) -> DataFrame:
    """SUMS over all texts, a row for each part (half and order) and region: how often each byte followed each context. FAN_IN partitions are added up first, then all."""
    texts = docs.where(F.length("text") > 0).select("text", half_of(F.col("doc_id")).alias("half"))
    some = texts.mapInPandas(_count, SUMS)
    for salt in (F.col("salt"), F.lit(0)):
        keys = ["part", "region", "salt"]
        some = some.withColumn("salt", salt).repartition(*keys).sortWithinPartitions(*keys).mapInPandas(_added, SUMS)
    return some


@dataclass
class Model:
    """tables: of each half the logits of a one bit, in sixteenths, in each slot of each order. nodes, path: (depth, byte) nodes and bits of a byte's
    path in the code tree; length: a byte's depth."""

    tables: np.ndarray
    nodes: np.ndarray
    path: np.ndarray
    length: np.ndarray


def _mixed(context: np.ndarray) -> np.ndarray:
    mixed = context * _MUL
    mixed ^= mixed >> np.uint32(15)
    return mixed * np.uint32(0x85EBCA77)


def region_of(cells: np.ndarray, order: int) -> np.ndarray:
    """The region that a cell's row is in."""
    return (cells >> np.uint32(8) if order == 0 else _mixed(cells >> np.uint32(8)) >> np.uint32(24)) >> np.uint32(8 - REGION_BITS)


def slots(context: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each context the row of 256 slots in its order's table, and what its nodes' numbers are mixed with there: contexts that share a row have their nodes in
    other slots. The first order's rows are its contexts."""
    if order == 0:
        return context, np.zeros_like(context)
    mixed = _mixed(context)
    return mixed >> np.uint32(32 - (SLOT_BITS[order] - 8)), (mixed >> np.uint32(1)) & np.uint32(255)


def _code(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Huffman tree over 256 bytes as (nodes, bits, length); the root is node 0."""
    heap = [(float(w), i) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    parent: dict[int, tuple[int, int]] = {}
    new = 256
    while len(heap) > 1:
        (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
        parent[i], parent[j] = (new, 0), (new, 1)
        heapq.heappush(heap, (a + b, new))
        new += 1
    paths = []
    for i in range(256):
        path, x = [], i
        while x in parent:
            x, bit = parent[x]
            path.append((new - 1 - x, bit))
        paths.append(path[::-1])
    length = np.array([len(p) for p in paths], np.int32)
    nodes, bits = np.zeros((length.max(), 256), np.int32), np.zeros((length.max(), 256), np.float32)
    for i, path in enumerate(paths):
        for d, (node, bit) in enumerate(path):
            nodes[d, i], bits[d, i] = node, bit
    return nodes, bits, length


def region(cells: np.ndarray, times: np.ndarray, order: int, number: int, nodes: np.ndarray, path: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The logits of a region of an order's table, from the counts of the contexts that are there."""
    size = 1 << SLOT_BITS[order] - REGION_BITS
    row, mix = slots(cells >> np.uint32(8), order)
    base, byte = (row.astype(np.int64) << 8) - number * size, (cells & np.uint32(255)).astype(np.int64)
    sums = np.zeros((2, size))
    for d in range(len(nodes)):
        on = length[byte] > d
        base, byte, mix, times = base[on], byte[on], mix[on], times[on]
        at, bit = base + (nodes[d][byte] ^ mix), path[d][byte]
        for b in (0, 1):
            sums[b] += np.bincount(at[bit == b], times[bit == b], size)
    return np.clip(np.rint(16 * np.log((sums[1] + 0.4) / (sums[0] + 0.4))), -127, 127).astype(np.int8)


#: Where the orders' tables begin, one after the other.
BEGIN = np.cumsum([0] + [1 << b for b in SLOT_BITS])


def fit(docs: DataFrame) -> Model:
    """Gather the counts of all documents; the executors make the tables, and the driver puts their regions together."""
    small_batches(docs.sparkSession)
    counts = materialise(gather_counts(docs))

    def bytes_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for cells, times in zip(frame["cells"], frame["times"], strict=True):
                found = np.bincount(np.frombuffer(cells, np.uint32) & 255, np.frombuffer(times, np.int64), 256)
                yield pd.DataFrame({"byte": np.arange(256, dtype=np.int32), "times": found.astype(np.int64)})

    weights = np.zeros(256)
    first = counts.where(F.col("part") % ORDERS == 0).mapInPandas(bytes_of, "byte int, times long")
    for r in first.groupBy("byte").agg(F.sum("times").alias("times")).collect():
        weights[r["byte"]] = r["times"]
    nodes, path, length = _code(weights + max(1.0, weights.sum() / 4096))  # so that no path is long

    @lean
    def logits(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for p, r, cells, times in zip(frame["part"].tolist(), frame["region"].tolist(), frame["cells"], frame["times"], strict=True):
                made = region(np.frombuffer(cells, np.uint32), np.frombuffer(times, np.int64).astype(np.float64), p % ORDERS, r, nodes, path, length)
                yield pd.DataFrame({"part": [p], "region": [r], "logits": [made.tobytes()]})

    tables = np.zeros(HALVES * BEGIN[-1], np.int8)
    for r in counts.mapInPandas(logits, "part int, region int, logits binary").toLocalIterator():
        piece = np.frombuffer(r["logits"], np.int8)
        at = r["part"] // ORDERS * BEGIN[-1] + BEGIN[r["part"] % ORDERS] + r["region"] * len(piece)
        tables[at : at + len(piece)] = piece
    return Model(tables, nodes, path, length)


def code_lengths(texts: list[bytes], halves: np.ndarray, model: Model) -> np.ndarray:
    """Bits of each text, by the counts of the half that it isn't in."""
    total = np.zeros(len(texts))
    by = np.argsort([-len(t) for t in texts], kind="stable")
    ranked = [texts[i] for i in by.tolist()]
    for first, last in byte_batches(ranked, LANE_BYTES):
        data, offsets = joined(ranked[first:last])
        total[by[first:last]] = _advance(data, offsets, (halves[by[first:last]] + 1) % HALVES, model)
    return total


def _advance(data: np.ndarray, offsets: np.ndarray, halves: np.ndarray, model: Model) -> np.ndarray:
    """Bits of the texts, longest first, by the counts of ``halves``; all move on by STEP bytes at a time."""
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    cost = np.zeros(n)
    if not len(data):
        return cost
    # of each byte and order the slot of its contexts' node 0; another node's number is mixed into its lowest 8 bits
    known = np.empty((len(data), ORDERS), np.int32)
    for k, c in enumerate(contexts(data, offsets)):
        row, mix = slots(c, k)
        known[:, k] = row << np.uint32(8) | mix
        known[:, k] += np.int32(BEGIN[k])
    known += np.repeat((halves * BEGIN[-1]).astype(np.int32), sizes)[:, None]
    # a lane's four weights are read as one 16-byte item; they belong to logits in sixteenths
    weights = np.full((GATES, n, ORDERS), FIRST_WEIGHT / 16, np.float32)
    start = (1 / (1 + np.exp(-(np.arange(MAP_STEPS) - MAP_STEPS // 2) / 2))).astype(np.float32)
    maps = np.broadcast_to(start, (MAP_DEPTHS, n, MAP_STEPS)).copy().reshape(MAP_DEPTHS, -1)
    one, half, map_rate, low, high = np.float32(1), np.float32(0.5), np.float32(MAP_RATE), np.float32(-7.9), np.float32(7.9)
    steps = -(-sizes // STEP)
    for t in range(int(steps[0])):
        m = int(np.searchsorted(-steps, -t, side="left"))
        at = ((offsets[:m] + t * STEP)[:, None] + np.arange(STEP)).ravel()
        lane = np.repeat(np.arange(m, dtype=np.int32), STEP)
        if (inside := at < np.repeat(offsets[1 : m + 1], STEP)).sum() < len(at):
            at, lane = at[inside], lane[inside]
        begin = np.flatnonzero(np.r_[True, lane[1:] != lane[:-1]])
        symbols = data[at]
        length = model.length.take(symbols)
        rows = known.take(at, axis=0)
        moves = np.zeros((GATES, m, ORDERS), np.float32)
        for d in range(int(length.max())):
            if d:
                on = np.flatnonzero(length > d)
                length, symbols, lane, rows = length.take(on), symbols.take(on), lane.take(on), rows.take(on, axis=0)
            bit, gate = model.path[d].take(symbols), min(d, GATES - 1)
            x = model.tables.take(rows ^ model.nodes[d].take(symbols)[:, None]).astype(np.float32)
            w = weights[gate].view(np.complex128)[:, 0].take(lane).view(np.float32).reshape(-1, ORDERS)
            z = np.einsum("ij,ij->i", w, x)
            np.minimum(np.maximum(z, low, out=z), high, out=z)
            p = np.exp(-z)
            p += one
            np.reciprocal(p, out=p)
            x *= (bit - p)[:, None]
            if d:
                first = np.flatnonzero(lane[1:] != lane[:-1])
                first += 1
                first = np.concatenate([[0], first])
                own = lane.take(first)
                own = slice(0, m) if len(own) == m else own
            else:
                first, own = begin, slice(0, m)
            moves[gate, own] += np.add.reduceat(x, first, axis=0)
            # of the bits of a step that meet in a cell of the map, the last moves it
            z += z
            cell = np.rint(z, out=z).astype(np.int32)
            cell += lane * np.int32(MAP_STEPS) + np.int32(MAP_STEPS // 2)
            refined = maps[min(d, MAP_DEPTHS - 1)]
            v = refined.take(cell)
            p += v
            p *= half
            refined[cell] = v + (bit - v) * map_rate
            p -= bit
            np.abs(p, out=p)
            np.subtract(one, p, out=p)
            cost[own] -= np.add.reduceat(np.log(p, out=p), first)
        weights[:, :m] += np.float32(RATE / 256) * moves
    return cost / np.log(2)


def score(docs: DataFrame, model=None) -> DataFrame:
    """(doc_id, n_bytes, bits, bits_per_byte), one row for each row of ``docs``.

    model: a broadcast Model; by default one is fitted on all of ``docs``. A document is scored by the counts of the half of the documents that it isn't in, so never by its own. A NULL text has NULLs; an empty one 0 bits and NULL bits a byte. Texts are coded whole. NULL identifiers (all in one half) and repeated
    rows stay as they are (each counts in the fit); other columns are ignored; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs)) if model is None else model

    @lean
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0
        for frame in frames:
            held.append(frame)
            size += int(frame["text"].str.len().sum())
            if size > HELD_BYTES:
                yield scored(pd.concat(held, ignore_index=True))
                held, size = [], 0
        if held:
            yield scored(pd.concat(held, ignore_index=True))

    def scored(frame: pd.DataFrame) -> pd.DataFrame:
        raw = [(t or "").encode("utf-8", "replace") for t in frame["text"].tolist()]
        null, half = frame["text"].isna().to_numpy(), frame["half"].to_numpy()
        bits = code_lengths(raw, half, shared.value)
        size = np.array([len(t) for t in raw], np.int64)
        rate = np.divide(bits, size, out=np.full(len(raw), np.nan), where=size > 0)
        return pd.DataFrame({"doc_id": frame["doc_id"], "n_bytes": pd.Series(pd.array(size, "Int64")).mask(null), "bits": pd.Series(pd.array(bits, "Float64")).mask(null), "bits_per_byte": pd.Series(rate, dtype="Float64").mask(size == 0)})

    return docs.select("doc_id", "text", half_of(F.col("doc_id")).alias("half")).mapInPandas(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, bits double, bits_per_byte double")
