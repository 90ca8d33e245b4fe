"""Operator 5: SimHash near-dedup over all pairs.

A fingerprint has 960 bits, each the sign of a sum over the document's distinct words. Near copies with a few per cent of words changed differ in
about 90 bits, unrelated documents in 350 or more; the threshold is 144.

Different fingerprints are cut into tiles by a hash, and every two tiles meet in one task, so that every pair is decided and no pair within the threshold is left out, whatever its bits
and sizes. Small tiles are compared by matrix products of the first 384 bits, which differ in no more bits than the whole. In large ones each of 48 segments of 20 bits is indexed: a pair within 144 bits
differs in at most two bits of some segment, or three of the first, so that looking up all such numbers meets it. What meets is compared in all bits. A task gives the edges of a spanning forest of its near
pairs, not all of them; equal fingerprints are one vertex from the start.

Work grows as the square of the different fingerprints, as any exact search at this distance: see the README.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.common import byte_batches, joined, lean, materialise, mix64, small_batches
from quernstone.llm.components import connected_components, union

WORDS, BLOCKS, BLOCK_BITS, WHOLE = 24, 5, 8, 3
BITS = WORDS * BLOCKS * BLOCK_BITS
#: The choices of WHOLE of a word's blocks.
CHOICES = np.array(list(itertools.combinations(range(BLOCKS), WHOLE)))
THRESHOLD = 144
GUARANTEED = WORDS * (BLOCKS - WHOLE + 1) - 1
BATCH_BYTES = 1 << 18
#: Powers that a worker keeps.
MOST_KEPT = 1 << 19
#: Up to so many rows are one tile; tiles of more rows; rows of the largest tile.
TILE, FEWEST, LARGEST = 2048, 4, 1 << 19
#: Segments that are indexed, and their bits; words of 64 bits that are compared first; rows for each lookup of a row from which an index costs less than all products.
SEGMENTS, SEGMENT_BITS, HEAD, FROM = 48, 20, 6, 2
#: Bits of the lower bound, a multiple of 8; rows of the two sides of a matrix product.
PREFIX, ROWS, COLUMNS, CHECKED = 384, 512, 1024, 1 << 16
_BASE = np.uint64(0x9E3779B97F4A7C15)
_KEPT = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: For each byte value, its 8 bits in the 8 byte lanes of a 64-bit word: eight counters that one addition updates.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).ravel()


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers 0 to n - 1 of the base and of its inverse, modulo 2**64."""
    if n > MOST_KEPT:
        return tuple(np.cumprod(np.r_[np.uint64(1), np.full(n - 1, x, np.uint64)]) for x in (int(_BASE), pow(int(_BASE), -1, 1 << 64)))
    if len(_KEPT[0]) < n:
        for i, x in enumerate((int(_BASE), pow(int(_BASE), -1, 1 << 64))):
            p = np.full(n, x, np.uint64)
            p[0] = 1
            _KEPT[i] = np.cumprod(p)
    return _KEPT[0][:n], _KEPT[1][:n]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document number, 64-bit hash) of each distinct word of each text, sorted by document. Words are runs of ASCII letters, digits and bytes from 128,
    and single characters of Chinese, Japanese and Korean."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    is_word = _WORD[data]
    inside = np.zeros(len(data) + 1, bool)
    inside[1:-1] = is_word[1:] & is_word[:-1]
    # each character of Chinese, Japanese and Korean text is a word
    lead = (data >= 0xE3) & (data <= 0xED)
    if lead.any():
        inside[:-1] &= ~lead
        inside[3:-1] &= ~(lead[:-3] & (data[3:] & 0xC0 != 0x80))
    inside[offsets] = False
    starts = np.flatnonzero(is_word & ~inside[:-1])
    ends = np.flatnonzero(is_word & ~inside[1:]) + 1
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    power, back = _powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power, out=sums[1:])
    hashes = mix64((sums[ends] - sums[starts]) * back[starts])
    doc = np.searchsorted(offsets, starts, side="right") - 1
    # distinct within the document: order by hash, then stably by document
    order = np.argsort(hashes, kind="stable")
    order = order[np.argsort(doc[order].astype(np.int32), kind="stable")]
    doc, hashes = doc[order], hashes[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    return doc[new], hashes[new]


def fingerprints(texts: list[str | None]) -> list[bytes | None]:
    """The 120-byte fingerprint of each text; None where it has no word."""
    return sized_fingerprints(texts)[0]


def sized_fingerprints(texts: list[str | None]) -> tuple[list[bytes | None], list[int]]:
    """fingerprints(), and how many different words each text has."""
    out: list[bytes | None] = [None] * len(texts)
    words = [0] * len(texts)
    raw = [(t or "").lower().encode("utf-8", "replace") for t in texts]
    for first, last in byte_batches(raw, BATCH_BYTES):
        data, offsets = joined(raw[first:last])
        doc, hashes = word_hashes(data, offsets)
        if not len(doc):
            continue
        begins = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        totals = np.diff(np.r_[begins, len(doc)])
        # runs of at most 255 words, so that no byte lane overflows
        runs = np.concatenate([np.arange(b, b + n, 255) for b, n in zip(begins, totals, strict=True)])
        owner = np.searchsorted(begins, runs, side="right") - 1
        first_run = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        signs = np.empty((len(begins), BITS), np.uint8)
        for w in range(BITS // 64):
            part = mix64(hashes + np.uint64((w + 1) * 0xD1B54A32D192ED03 & (1 << 64) - 1)).view(np.uint8).reshape(-1, 8)
            for k in range(8):
                lanes = np.add.reduceat(_LANES[part[:, k]], runs).view(np.uint8).reshape(-1, 8)
                counts = np.add.reduceat(lanes, first_run, axis=0, dtype=np.int64)
                signs[:, w * 64 + k * 8 : w * 64 + k * 8 + 8] = 2 * counts > totals[:, None]
        packed = np.packbits(signs, axis=1)
        for i, (d, n) in enumerate(zip(doc[begins].tolist(), totals.tolist(), strict=True)):
            out[first + d], words[first + d] = packed[i].tobytes(), n
    return out, words


def _signs(prints: np.ndarray) -> np.ndarray:
    """The first PREFIX bits of each row as -1 and 1."""
    bits = np.unpackbits(np.ascontiguousarray(prints).view(np.uint8)[:, : PREFIX // 8], axis=1)
    return bits.astype(np.float32) * 2 - 1


def _near(prints: np.ndarray, left: slice, right: slice, a: np.ndarray, b: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the pairs of a row in ``left`` and one in ``right`` within ``threshold`` bits; a, b: their _signs()."""
    i, j = np.nonzero(a @ b.T >= PREFIX - 2 * threshold)
    i, j = i + left.start, j + right.start
    near = np.empty(len(i), bool)
    for at in range(0, len(i), CHECKED):
        part = slice(at, at + CHECKED)
        near[part] = np.bitwise_count(prints[i[part]] ^ prints[j[part]]).sum(axis=1, dtype=np.int64) <= threshold
    return i[near], j[near]


def tile_components(prints: np.ndarray, sides: np.ndarray, threshold: int) -> np.ndarray:
    """The first row of each row's component, where rows within ``threshold`` bits are linked. prints: (n, 15) uint64, sorted by side; with both sides, only pairs
    of one row of each are compared. Rows that the first row links are not compared with each other again."""
    n = len(prints)
    middle = int(np.searchsorted(sides, 1))
    both = 0 < middle < n
    parent = np.arange(n)
    others = np.arange(middle if both else 1, n)
    near = others[np.bitwise_count(prints[others] ^ prints[0]).sum(axis=1, dtype=np.int64) <= threshold]
    parent[near] = 0
    if n < 3 or len(near) == n - 1:
        return parent
    for c in range(middle if both else 0, n, COLUMNS):
        right = slice(c, min(c + COLUMNS, n))
        b = None
        for r in range(0, middle if both else right.stop, ROWS):
            left = slice(r, min(r + ROWS, middle if both else right.stop))
            if (parent[left] == parent[left.start]).all() and (parent[right] == parent[left.start]).all():
                continue
            b = _signs(prints[right]) if b is None else b
            i, j = _near(prints, left, right, _signs(prints[left]), b, threshold)
            parent = union(parent, i, j)
    return parent


def keys(prints: np.ndarray) -> np.ndarray:
    """(print, key) numbers of 32 bits: a word, a choice and its blocks, of which pairs within GUARANTEED bits share one. prints: (n, 120) uint8. The query doesn't use them: pairs beyond may share none."""
    blocks = prints.reshape(len(prints), WORDS, BLOCKS).astype(np.uint32)
    out = np.broadcast_to((np.arange(WORDS * len(CHOICES), dtype=np.uint32) << np.uint32(24)).reshape(WORDS, -1), (len(prints), WORDS, len(CHOICES))).copy()
    for k in range(WHOLE):
        out |= blocks[:, :, CHOICES[:, k]] << np.uint32(8 * k)
    return out.reshape(len(prints), -1)


def segments(prints: np.ndarray) -> np.ndarray:
    """(segment, print) numbers of SEGMENT_BITS bits, all of the bits in order. prints: (n, 120) uint8."""
    b = prints.reshape(len(prints), -1, 5).astype(np.uint32)
    out = np.empty((SEGMENTS, len(prints)), np.uint32)
    out[::2] = (b[:, :, 0] << np.uint32(12) | b[:, :, 1] << np.uint32(4) | b[:, :, 2] >> np.uint32(4)).T
    out[1::2] = ((b[:, :, 2] & np.uint32(15)) << np.uint32(16) | b[:, :, 3] << np.uint32(8) | b[:, :, 4]).T
    return out


def radii(threshold: int) -> list[int]:
    """For each segment the differing bits up to which it is searched: a pair within ``threshold`` bits has a segment within its radius, since one beyond it in all segments
    differs in threshold + 1 bits at least."""
    whole, more = divmod(threshold + 1, SEGMENTS)
    return [whole] * more + [whole - 1] * (SEGMENTS - more)


def _flips(radius: int) -> Iterator[int]:
    """Every number of SEGMENT_BITS bits with at most ``radius`` bits set, the fewest first."""
    for n in range(radius + 1):
        for bits in itertools.combinations(range(SEGMENT_BITS), n):
            yield sum(1 << b for b in bits)


def _lookups(threshold: int) -> int:
    return sum(math.comb(SEGMENT_BITS, n) for r in radii(threshold) for n in range(r + 1))


def indexed_components(prints: np.ndarray, sides: np.ndarray, threshold: int) -> np.ndarray:
    """tile_components() by an index of each segment, in which all numbers within the segment's radius are looked up; more may be linked, by other pairs within ``threshold`` bits."""
    n = len(prints)
    middle = int(np.searchsorted(sides, 1))
    both = 0 < middle < n
    held, asking = slice(0, middle if both else n), slice(middle if both else 0, n)
    head, ones = np.ascontiguousarray(prints[:, :HEAD]), np.ones(HEAD, np.uint16)
    parts = segments(prints.view(np.uint8).reshape(n, -1))
    parent = np.arange(n)
    links: list[tuple[np.ndarray, np.ndarray]] = []

    def check(i: np.ndarray, j: np.ndarray) -> None:
        some = np.flatnonzero(np.bitwise_count(head.take(i, axis=0) ^ head.take(j, axis=0)) @ ones <= threshold)
        if len(some):
            i, j = i[some], j[some]
            near = np.bitwise_count(prints[i] ^ prints[j]).sum(axis=1, dtype=np.int64) <= threshold
            if near.any():
                links.append((i[near], j[near]))

    def settle() -> None:
        nonlocal parent
        if links:
            parent = union(parent, *(np.concatenate(x) for x in zip(*links, strict=True)))
            links.clear()

    # rows beside each other in the order of a segment first: most copies are linked so, and aren't compared again
    for part in parts:
        order = np.argsort(part, kind="stable")
        i, j = order[:-1], order[1:]
        beside = (part[i] == part[j]) & (parent[i] != parent[j])
        check(i[beside], j[beside])
        settle()
    start = np.zeros((1 << SEGMENT_BITS) + 1, np.int64)
    for part, radius in zip(parts, radii(threshold), strict=True):
        order = np.argsort(part[held], kind="stable")
        sizes = np.bincount(part[held], minlength=1 << SEGMENT_BITS)
        np.cumsum(sizes, out=start[1:])
        full = sizes > 0
        begin = start[:-1][full]
        asks = np.argsort(part[asking], kind="stable") + asking.start
        asked = [(asks, part[asks].astype(np.int64))]
        if not both:
            # of the two ways of a pair the one from the lesser number, in which the flip's highest bit isn't set
            asked += [(asks[low], asked[0][1][low]) for low in (np.flatnonzero(asked[0][1] >> b & 1 == 0) for b in range(SEGMENT_BITS))]

        def one_root() -> np.ndarray:
            """The root of a number's rows if they have the same, and else -1."""
            out, roots = np.full(1 << SEGMENT_BITS, -1, np.int64), parent[order]
            least = np.minimum.reduceat(roots, begin)
            out[full] = np.where(least == np.maximum.reduceat(roots, begin), least, -1)
            return out

        same = one_root()
        for flip in _flips(radius):
            rows, values = asked[0 if both else flip.bit_length()]
            number = values ^ flip
            hit = np.flatnonzero(full.take(number))
            row, number = rows.take(hit), number.take(hit)
            # rows that are all linked to the one that asks are passed over at once
            apart = np.flatnonzero(same.take(number) != parent.take(row))
            row, number = row.take(apart), number.take(apart)
            many = sizes.take(number)
            ends = np.cumsum(many)
            at = 0
            while at < len(row):
                last = max(at + 1, int(np.searchsorted(ends, ends[at] + CHECKED)))
                i, j, m = start.take(number[at:last]), row[at:last], many[at:last]
                if ends[last - 1] - ends[at] + m[0] > len(j):
                    i, j = np.repeat(i - (ends[at:last] - m - (ends[at] - m[0])), m), np.repeat(j, m)
                    i += np.arange(len(j))
                i = order.take(i)
                if not flip:
                    new = parent[i] != parent[j] if both else (parent[i] != parent[j]) & (i < j)
                    i, j = i[new], j[new]
                check(i, j)
                at = last
                if sum(len(x) for x, _ in links) > CHECKED:
                    settle()
        settle()
    return parent


def _fingerprint_udf():
    @F.pandas_udf("print binary, words int")
    @lean
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            prints, words = sized_fingerprints(texts.tolist())
            yield pd.DataFrame({"print": pd.Series(prints, dtype=object), "words": words})

    return run


def tiles_of(rows: int) -> int:
    """Into how many tiles so many rows are cut: FEWEST for more than TILE rows, and none over LARGEST."""
    return max(1, min(FEWEST, -(-rows // TILE)), -(-rows // LARGEST))


def _edges(same: DataFrame, threshold: int) -> DataFrame:
    """same: (v, print), all different -> (u, v) edges that link what all pairs within ``threshold`` bits link. Every two tiles meet in one task."""
    tiles = tiles_of(same.count())
    placed = same.select("v", "print", F.pmod(F.xxhash64("v"), F.lit(tiles)).cast("int").alias("tile")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    low, high = F.least("tile", "other"), F.greatest("tile", "other")
    placed = placed.select((high * (high + 1) / 2 + low).cast("int").alias("task"), (F.col("tile") > F.col("other")).alias("side"), (low == high).alias("alone"), "v", "print")

    @lean
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [(b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False), b.column(3).to_numpy(), np.frombuffer(b"".join(b.column(4).to_pylist()), np.uint64).reshape(-1, BITS // 64)) for b in batches if b.num_rows]
        if not found:
            return
        sides, alone, ids, prints = (np.concatenate(x) for x in zip(*found, strict=True))
        del found
        if not alone[0] and (sides == sides[0]).all():
            return  # the other tile is empty
        order = np.lexsort((ids, sides))
        sides, ids, prints = sides[order], ids[order], prints[order]
        left = len(ids) - int(sides.sum()) or len(ids)
        root = (indexed_components if left > FROM * _lookups(threshold) else tile_components)(prints, sides.astype(np.int8), threshold)
        own = np.flatnonzero(root != np.arange(len(ids)))
        yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(ids[root[own]])], names=["u", "v"])

    return placed.repartitionById(tiles * (tiles + 1) // 2, "task").mapInArrow(compare, "u long, v long")


def _grouped(docs: DataFrame, threshold: int) -> DataFrame:
    """(doc_id, sig, kept_doc_id, hamming) of near_duplicate_groups(), with sig, the xxhash64 of the text, to tell rows of one doc_id apart."""
    small_batches(docs.sparkSession)
    prints = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("sig"), _fingerprint_udf()("text").alias("found")).select("doc_id", "sig", "found.*")
    prints = materialise(prints.where(F.col("print").isNotNull()).dropDuplicates(["doc_id", "sig"]))
    # different fingerprints are numbered; numbers are short where hashes aren't
    same = materialise(prints.select("print").distinct().select(F.monotonically_increasing_id().alias("v"), "print"))
    prints = prints.join(same.select("print", "v"), "print")
    roots = connected_components(_edges(same, threshold)).select(F.col("id").alias("v"), "root")
    rooted = prints.select("doc_id", "sig", "print", "v").join(roots, "v", "left").withColumn("root", F.coalesce("root", "v"))
    kept = rooted.groupBy("root").agg(F.min(F.struct("doc_id", "sig", "print")).alias("kept"), F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)

    @F.pandas_udf("int")
    def hamming(a: pd.Series, b: pd.Series) -> pd.Series:
        x, y = (np.frombuffer(b"".join(s.tolist()), np.uint64).reshape(len(s), -1) for s in (a, b))
        return pd.Series(np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int32))

    gone = rooted.join(kept.select("root", "kept"), "root").where((F.col("doc_id") != F.col("kept.doc_id")) | (F.col("sig") != F.col("kept.sig")))
    return gone.select("doc_id", "sig", F.col("kept.doc_id").alias("kept_doc_id"), hamming("print", "kept.print").alias("hamming"))


def near_duplicate_groups(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, kept_doc_id, hamming) of every document that goes: those of a group of near copies but its smallest doc_id.

    Groups are connected components of all pairs within ``threshold`` bits; hamming is the distance to the kept
    document's fingerprint, which in a chain can exceed the threshold. Identifiers may be of any type with an order. Texts without a word (NULL, empty, only punctuation) and rows with a NULL doc_id are in no
    group. Equal rows count as one document; rows with one doc_id and other texts are documents of their own, of which one may go with its own doc_id as the kept one. Whole texts count, however
    long. An empty table gives no rows; other columns are ignored.
    """
    return _grouped(docs, threshold).drop("sig")


def drop_near_duplicates(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that near_duplicate_groups() gives; equal rows stay or go together, rows of one doc_id with other texts go by their own texts."""
    gone = _grouped(docs, threshold).select(F.col("doc_id").alias("_gone_id"), F.col("sig").alias("_gone_sig"))
    return docs.join(gone, (docs["doc_id"] == gone["_gone_id"]) & (F.xxhash64(docs["text"]) == gone["_gone_sig"]), "left_anti")
