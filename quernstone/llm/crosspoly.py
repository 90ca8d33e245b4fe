"""Operator 7: embedding near-dedup by cross-polytope hashing.

A vector is scaled to length one, padded to a power of two and rotated by three rounds of random signs and a fast Hadamard
transform. Its hash is the coordinate of largest absolute value with that coordinate's sign; a table joins two rotations' hashes. With
multiprobe a vector also enters the buckets of its next best coordinates, in the order of what they lose against the best. Pairs that
meet in a bucket are candidates; a pair is kept if its cosine is at least the threshold.

A bucket can hold a group of thousands of copies. Vectors that are equal bit by bit are one from the start, buckets with the same members meet once, large ones are split
into tiles so that no task holds a whole bucket, and no candidate is dropped. A task gives each vector's links and the edges of a spanning forest, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.common import lean, materialise, small_batches, whole_groups
from quernstone.llm.components import connected_components, union
from quernstone.llm.groups import meetings

TABLES, PROBES, THRESHOLD, SEED = 8, 3, 0.9, 11
#: Members of a bucket in one tile; the tiles of a bucket meet pairwise. Rows of a product.
TILE, ROWS = 1024, 256


def hadamard(x: np.ndarray) -> np.ndarray:
    """Rows times the Hadamard matrix over the square root of its size, by butterflies."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d, dtype=x.dtype)


def signs(dim: int, rotations: int, seed: int) -> np.ndarray:
    """(rotation, round, coordinate) of random signs."""
    return np.random.default_rng(seed).integers(0, 2, (rotations, 3, dim)).astype(np.float32) * 2 - 1


def buckets(vectors: np.ndarray, tables: int, probes: int, seed: int) -> np.ndarray:
    """(vector, table, probe) bucket numbers of unit vectors, the best first."""
    n, d = vectors.shape
    dim = 1 << max(1, (d - 1).bit_length())
    padded = np.zeros((n, dim), np.float32)
    padded[:, :d] = vectors
    flips = signs(dim, 2 * tables, seed)
    out = np.empty((n, tables, probes), np.int64)
    take = min(probes, 2 * dim)
    for t in range(tables):
        ranked, loss = [], []
        for r in (2 * t, 2 * t + 1):
            x = padded
            for k in range(3):
                x = hadamard(x * flips[r, k])
            both = np.concatenate([x, -x], axis=1)
            top = np.argsort(-both, axis=1, kind="stable")[:, :take]
            value = np.take_along_axis(both, top, axis=1)
            ranked.append(top)
            loss.append((value[:, :1] - value) ** 2)
        total = (loss[0][:, :, None] + loss[1][:, None, :]).reshape(n, -1)
        best = np.argsort(total, axis=1, kind="stable")[:, :probes]
        first, second = np.take_along_axis(ranked[0], best // take, axis=1), np.take_along_axis(ranked[1], best % take, axis=1)
        out[:, t] = (t * 2 * dim + first) * 2 * dim + second
    return out


def near_groups(vectors: DataFrame, threshold: float = THRESHOLD, tables: int = TABLES, probes: int = PROBES, seed: int = SEED, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(vec_id, kept_id, links): a row for each vector that has a near copy or an equal one.

    kept_id: the smallest identifier of the vector's group, a connected component of equal vectors and pairs with a cosine of ``threshold`` or more that share a bucket. links: how many different vectors
    make such a pair with this one; equal ones, which aren't listed in pairs, are one of them.

    NULL identifiers and vectors, vectors with a NULL or non-finite entry, empty ones and the zero vector are in no group. Vectors of different
    lengths are never paired. Rows with the same identifier count once, with the smallest vector. Identifiers may be of any type with an order. An empty table gives no rows; other columns are ignored.
    """
    small_batches(vectors.sparkSession)
    rows = vectors.select(F.col(id_column).alias("id"), F.col(column).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & F.expr("size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))") & F.expr("exists(v, x -> x != 0)"))
    rows = rows.groupBy("id").agg(F.min("v").alias("v"))
    # scaled by the largest entry first, so that no square is out of range
    rows = rows.withColumn("most", F.expr("aggregate(v, 0D, (s, x) -> greatest(s, abs(x)))")).withColumn("v", F.expr("transform(v, x -> x / most)"))
    rows = rows.withColumn("norm", F.expr("sqrt(aggregate(v, 0D, (s, x) -> s + x * x))")).select("id", F.expr("transform(v, x -> cast(x / norm as float))").alias("unit"))
    rows = materialise(rows.select("id", F.xxhash64("unit").alias("v"), "unit"))

    @F.pandas_udf("array<long>")
    def hashed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for units in parts:
            found = np.empty(len(units), object)
            size = units.map(len).to_numpy()
            for d in np.unique(size):
                at = np.flatnonzero(size == d)
                for i, b in zip(at, buckets(np.stack(units.to_numpy()[at]).astype(np.float32), tables, probes, seed).reshape(len(at), -1) + (int(d) << 40), strict=True):
                    found[i] = b
            yield pd.Series(found)

    heads = materialise(rows.groupBy("v").agg(F.min("unit").alias("unit")).withColumn("keys", hashed("unit")))
    sent = meetings(heads.select("v", F.explode(F.array_distinct("keys")).alias("key"), F.lit(1 << 48).alias("mark")), TILE).join(heads, "v")

    @lean
    def verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, cuts in whole_groups(frames, tasks):
            ids, side, x, y, key = (frame[c].to_numpy() for c in ("v", "side", "x", "y", "key"))
            units, keys = frame["unit"].to_numpy(), frame["keys"].to_numpy()
            found = []
            for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                alone = x[low] == y[low]
                if not alone and side[low] == side[high - 1]:
                    continue  # the other tile is empty
                middle = high if alone else low + int(np.searchsorted(side[low:high], 1))
                matrix, own_keys = np.stack(units[low:high]).astype(np.float64), np.stack(keys[low:high])
                n, parent, links = high - low, np.arange(high - low), np.zeros(high - low, np.int64)
                for a in range(0, middle - low, ROWS):
                    part = slice(a, min(a + ROWS, middle - low))
                    i, j = np.nonzero(matrix[part] @ matrix[0 if alone else middle - low :].T >= threshold)
                    i, j = i + a, j + (0 if alone else middle - low)
                    i, j = i[i < j], j[i < j]
                    if not len(i):
                        continue
                    parent = union(parent, i, j)
                    # a pair counts in the group of the least key that it shares
                    shared = np.where((own_keys[i][:, :, None] == own_keys[j][:, None, :]).any(axis=2), own_keys[i], np.iinfo(np.int64).max).min(axis=1)
                    first = shared == key[low]
                    links += np.bincount(i[first], minlength=n) + np.bincount(j[first], minlength=n)
                some = (links > 0) | (parent != np.arange(n))
                found.append((ids[low:high][some], ids[low:high][parent][some], links[some]))
            if found:
                yield pd.DataFrame({c: np.concatenate([f[k] for f in found]) for k, c in enumerate(("v", "root", "links"))})

    tasks = ["group", "x", "y"]
    found = sent.repartition(*tasks).sortWithinPartitions(*tasks, "side", "v").mapInPandas(verify, "v long, root long, links long")
    found = materialise(found.groupBy("v", "root").agg(F.sum("links").alias("links")))
    links = found.groupBy(F.col("v").alias("of")).agg(F.sum("links").alias("links"))
    roots = connected_components(found.select(F.col("v").alias("u"), F.col("root").alias("v"))).select(F.col("id").alias("of"), "root")
    rooted = rows.select("id", "v").join(links.join(roots, "of", "full"), F.col("v") == F.col("of"), "left").select("id", F.coalesce("root", "v").alias("root"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))
    kept = rooted.groupBy("root").agg(F.min("id").alias("kept_id"), F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)
    return rooted.join(kept, "root").select(F.col("id").alias("vec_id"), "kept_id", "links")
