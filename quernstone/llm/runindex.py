"""Operator 1: repeated passages by a run-length index.

A passage repeats where MIN_CHARS characters of one document occur in another. Every such stretch of text has an anchor, the
least hash of its 32-grams, which equal stretches share; consecutive stretches with one anchor form a window.

1. Each document gives its windows: anchor, hash and place, about three for each 200 characters.
2. One shuffle by anchor keeps the anchors of two or more documents. Where all windows of an anchor are equal, the
   windows are the passage. Otherwise each different window is kept once, with its first and last document.
3. The different windows of an anchor meet in one task, which concatenates them and builds their run-compressed Burrows-Wheeler transform,
   with the suffix array sampled at the ends of runs; what is kept of both is as long as there are runs. At run starts the suffix before and the common prefix with it are computed,
   and streamed from there: inside a run each step along the text moves the one on and lowers the other by one. These matching
   statistics chain suffixes that share MIN_CHARS characters; a chain with several documents is a repeat.
4. Spans of the same document are merged.

The result is exact: character i is marked if and only if it lies in a stretch of MIN_CHARS characters that occurs in another document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.llm.common import lean, materialise, mix64, own_columns, safe_name

MIN_CHARS, GRAM = 200, 32
#: Characters of windows indexed together in a task.
INDEX_CHARS = 1 << 20
#: Powers that a worker keeps.
MOST_KEPT = 1 << 19
_BASE = 0xC6A4A7935BD1E995
_KEPT = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]
ANCHORS = "doc_id long, sig long, anchor long, print long, a int, b int"


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers 0 to n - 1 of the base and of its inverse, modulo 2**64."""
    if n > MOST_KEPT:
        return tuple(np.cumprod(np.r_[np.uint64(1), np.full(n - 1, x, np.uint64)]) for x in (_BASE, pow(_BASE, -1, 1 << 64)))
    if len(_KEPT[0]) < n:
        for i, x in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(max(n, 1 << 16), x, np.uint64)
            p[0] = 1
            _KEPT[i] = np.cumprod(p)
    return _KEPT[0][:n], _KEPT[1][:n]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def prefix_sums(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums from which (sums[b] - sums[a]) * back[a] is a hash of codes[a:b] that doesn't depend on the place."""
    power, back = _powers(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * power[:-1], out=sums[1:])
    return sums, back


def _sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` of every ``width`` values in a row."""
    have = 1
    while have * 2 <= width:
        values = pick(values[:-have], values[have:])
        have *= 2
    rest = width - have
    return pick(values[: len(values) - rest], values[rest:]) if rest else values


def anchors(text: str, least: int = MIN_CHARS, gram: int = GRAM) -> tuple[np.ndarray, ...] | None:
    """(anchor, window hash, start, stop) of a text's windows; None if it is shorter than ``least``.

    The anchor of a stretch of ``least`` characters is the least hash of its grams, a function of the stretch alone. A window is the
    union of consecutive stretches with the same anchor, so every stretch of the text lies in exactly one."""
    n, gram = len(text), min(gram, least)
    if n < least:
        return None
    sums, back = prefix_sums(code_points(text))
    hashes = mix64((sums[gram:] - sums[:-gram]) * back[: n - gram + 1])
    lowest = _sliding(hashes, least - gram + 1, np.minimum)
    new = np.ones(len(lowest), bool)
    new[1:] = lowest[1:] != lowest[:-1]
    a = np.flatnonzero(new)
    b = np.r_[a[1:], len(lowest)] + least - 1
    prints = mix64((sums[b] - sums[a]) * back[a] + (b - a).astype(np.uint64))
    return lowest[a], prints, a, b


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling from eight symbols on; only suffixes that still tie are sorted again. text: symbols from 0 to 255, as after _dense()."""
    n = len(text)
    key = np.zeros(n, np.uint64)
    padded = np.concatenate([text.astype(np.uint64), np.zeros(8, np.uint64)])
    for k in range(8):
        key = key << np.uint64(8) | padded[k : n + k]
    order = np.argsort(key, kind="stable")
    new = np.ones(n, bool)
    new[1:] = key[order][1:] != key[order][:-1]
    starts = np.flatnonzero(new)
    rank = np.empty(n + 1, np.int64)
    rank[order] = np.repeat(starts, np.diff(np.r_[starts, n]))
    rank[n] = -1
    size = np.diff(np.r_[starts, n])
    open_ = order[np.repeat(size > 1, size)]
    depth = 8
    while len(open_):
        own, after = rank[open_], rank[np.minimum(open_ + depth, n)]
        key = own.astype(np.uint64) << np.uint64(32) | (after + 1).astype(np.uint64)
        by = np.argsort(key, kind="stable")
        open_, key, own = open_[by], key[by], own[by]
        m = len(open_)
        group = np.ones(m, bool)
        group[1:] = own[1:] != own[:-1]
        part = np.ones(m, bool)
        part[1:] = key[1:] != key[:-1]
        at = np.arange(m)
        starts = np.flatnonzero(part)
        size = np.diff(np.r_[starts, m])
        group_start = np.maximum.accumulate(np.where(group, at, 0))
        rank[open_] = np.repeat((own + at - group_start)[starts], size)
        open_ = open_[np.repeat(size > 1, size)]
        depth *= 2
    out = np.empty(n, np.int64)
    out[rank[:n]] = np.arange(n)
    return out


def _dense(codes: np.ndarray) -> np.ndarray:
    """Symbols from 0 in the order of the code points; more than 256 of them become two symbols each."""
    distinct, dense = np.unique(codes, return_inverse=True)
    return dense.astype(np.uint8) if len(distinct) <= 256 else dense


class RunIndex:
    """Run-compressed Burrows-Wheeler transform of texts, with a separator after each.

    Kept are the text, ends: where each text's separator is; heads: where runs begin in the transform; symbols: a run's symbol; first, last: the suffix array at a run's ends, and the
    same by place in the text. All but the text is as long as there are runs; suffix array and transform are gone once it is built.
    """

    def __init__(self, texts: list[str]):
        sizes = np.array([len(t) for t in texts], np.int64)
        self.codes = np.zeros(int(sizes.sum()) + len(texts), np.uint32)
        self.ends = np.cumsum(sizes + 1) - 1
        inside = np.ones(len(self.codes), bool)
        inside[self.ends] = False
        self.codes[inside] = code_points("".join(texts)) + 1
        dense = _dense(self.codes)
        if dense.dtype != np.uint8:
            wide = np.empty(2 * len(dense), np.uint8)
            wide[::2], wide[1::2] = dense >> 8, dense & 255
            both = suffix_array(wide)
            sa = both[both % 2 == 0] // 2
        else:
            sa = suffix_array(dense)
        bwt = self.codes[sa - 1]
        change = np.ones(len(sa), bool)
        change[1:] = bwt[1:] != bwt[:-1]
        change |= bwt == 0  # the texts' separators count as different symbols
        self.heads = np.flatnonzero(change)
        self.symbols = bwt[self.heads]
        self.first = sa[self.heads]
        self.last = sa[np.r_[self.heads[1:], len(sa)] - 1]
        # a run start by its place in the text, and the suffix before it in order, the end of the run before
        by = np.argsort(self.first[1:], kind="stable")
        self.starts, self.before = self.first[1:][by], self.last[:-1][by]
        self.lowest = int(sa[0]) if len(sa) else -1

    def index_bytes(self) -> int:
        """What is kept beside the text."""
        return sum(x.nbytes for x in (self.ends, self.heads, self.symbols, self.first, self.last, self.starts, self.before))

    def owner(self, places: np.ndarray) -> np.ndarray:
        """The texts that places are in."""
        return np.searchsorted(self.ends, places)

    def left(self, places: np.ndarray) -> np.ndarray:
        """Characters from each place to its text's end."""
        return self.ends[self.owner(places)] - places

    def matching_statistics(self) -> tuple[np.ndarray, np.ndarray]:
        """For each place of the text the suffix before it in order, and how many characters the two share, up to their texts' ends; the lowest suffix has itself and 0.

        Both are sampled at run starts. Elsewhere they stream from the last run start before in the text: the suffix before lies as much further on, and one character less a step is
        shared.
        """
        n = len(self.codes)
        at, other = self.starts, self.before
        sums, back = prefix_sums(self.codes)
        low, high = np.zeros(len(at), np.int64), np.minimum(self.left(at), self.left(other))
        while (todo := low < high).any():
            mid = (low + high + 1) // 2
            same = (sums[at + mid] - sums[at]) * back[at] == (sums[other + mid] - sums[other]) * back[other]
            low, high = np.where(todo & same, mid, low), np.where(todo & ~same, mid - 1, high)
        place = np.arange(n)
        sample = np.zeros(n, np.int64)
        sample[at] = np.arange(len(at))
        sample = np.maximum.accumulate(sample)
        gone = place - at[sample] if len(at) else place
        shared = np.maximum(low[sample] - gone, 0) if len(at) else np.zeros(n, np.int64)
        prior = np.where(shared > 0, other[sample] + gone, place) if len(at) else place
        if self.lowest >= 0:
            prior[self.lowest], shared[self.lowest] = self.lowest, 0
        ahead = gone < 0  # before the first run start of the text
        prior[ahead], shared[ahead] = place[ahead], 0
        return prior, shared

    def count(self, pattern: str) -> int:
        """Occurrences of ``pattern``, by backward search over the runs."""
        low, high = 0, len(self.codes)
        order = np.argsort(self.symbols, kind="stable")
        ends = np.r_[self.heads[1:], len(self.codes)]
        total = np.cumsum((ends - self.heads)[order])
        for c in (code_points(pattern)[::-1] + 1).tolist():
            a, b = np.searchsorted(self.symbols[order], [c, c + 1])
            if a == b:
                return 0
            own = order[a:b]
            before = total[a] - (ends - self.heads)[own[0]]
            inside = [int(np.clip(x - self.heads[own], 0, (ends - self.heads)[own]).sum()) for x in (low, high)]
            low, high = before + inside[0], before + inside[1]
            if low >= high:
                return 0
        return int(high - low)


def repeats(texts: list[str], lo: np.ndarray, hi: np.ndarray, least: int) -> list[tuple[int, int, int, bool]]:
    """(window, start, end, first) of the stretches of ``least`` characters or more that documents share. lo, hi: a window's first and last document. first: the
    window's first document is the stretch's first."""
    index = RunIndex(texts)
    prior, shared = index.matching_statistics()
    # suffixes that share enough with the one before are chains in the suffix array's order; a chain's members all share that much
    linked = np.flatnonzero(shared >= least)
    places = np.unique(np.concatenate([linked, prior[linked]]))
    up = np.arange(len(places))
    up[np.searchsorted(places, linked)] = np.searchsorted(places, prior[linked])
    while ((higher := up[up]) != up).any():
        up = higher
    owner = index.owner(places)
    low, high = lo[owner].copy(), hi[owner].copy()
    np.minimum.at(low, up, lo[owner])
    np.maximum.at(high, up, hi[owner])
    many, first_doc = (low < high)[up], low[up]
    # a window alone is a repeat where its own documents are several
    own = np.flatnonzero(lo < hi)
    begins = index.ends - np.array([len(t) for t in texts], np.int64)
    whole = np.concatenate([np.arange(begins[w], index.ends[w] - least + 1) for w in own.tolist()]) if len(own) else np.zeros(0, np.int64)
    whole = np.setdiff1d(whole, places, assume_unique=True)
    places = np.concatenate([places, whole])
    many = np.concatenate([many, np.ones(len(whole), bool)])
    owner = index.owner(places)
    leads = np.concatenate([first_doc, lo[owner[len(first_doc) :]]]) == lo[owner]
    out = []
    for first in (True, False):
        mark = np.zeros(len(index.codes) + 2, np.int8)
        mark[places[many & (leads == first)] + 1] = 1
        step = np.diff(mark)
        begin, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        of = index.owner(begin)
        # marks of neighbouring windows never touch: a separator and least - 1 unmarked places lie between
        out += [(w, s, e, first) for w, s, e in zip(of.tolist(), (begin - begins[of]).tolist(), (end - 1 - begins[of] + least).tolist(), strict=True)]
    return out


def _anchor_rows(least: int):
    @lean
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            held: list[tuple] = []
            size = 0
            for doc, sig, text in zip(frame["doc_id"].tolist(), frame["sig"].tolist(), frame["text"].tolist(), strict=True):
                found = anchors(text, least)
                if found is not None:
                    held.append((doc, sig, *found))
                    size += len(found[0])
                if size > 200_000:
                    yield _table(held)
                    held, size = [], 0
            if held:
                yield _table(held)

    return run


def _table(held: list[tuple]) -> pd.DataFrame:
    n = [len(x[2]) for x in held]
    columns = [np.concatenate([x[i] for x in held]) for i in range(2, 6)]
    return pd.DataFrame({"doc_id": np.repeat(np.array([x[0] for x in held], np.int64), n), "sig": np.repeat(np.array([x[1] for x in held], np.int64), n), "anchor": columns[0].view(np.int64), "print": columns[1].view(np.int64), "a": columns[2].astype(np.int32), "b": columns[3].astype(np.int32)})


@lean
def _cut_windows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows, size = [], 0
        for text, wanted in zip(frame["text"].tolist(), frame["wanted"].tolist(), strict=True):
            for w in wanted:
                rows.append((w["anchor"], w["print"], w["lo"], w["hi"], text[w["a"] : w["b"]]))
                size += w["b"] - w["a"]
            if size > 8 << 20:
                yield pd.DataFrame(rows, columns=["anchor", "print", "lo", "hi", "window"])
                rows, size = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=["anchor", "print", "lo", "hi", "window"])


def _index_windows(least: int):
    names = ["anchor", "print", "start", "stop", "first"]

    def solve(parts: list[pd.DataFrame]) -> pd.DataFrame:
        all_ = pd.concat(parts, ignore_index=True)
        found = repeats(all_["window"].tolist(), all_["lo"].to_numpy(), all_["hi"].to_numpy(), least)
        at = np.array([f[0] for f in found], np.int64)
        return pd.DataFrame({"anchor": all_["anchor"].to_numpy()[at], "print": all_["print"].to_numpy()[at], "start": np.array([f[1] for f in found], np.int32), "stop": np.array([f[2] for f in found], np.int32), "first": np.array([f[3] for f in found], bool)}, columns=names)

    @lean
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Windows come sorted by anchor; an index takes whole anchors until it has enough characters."""
        held: list[pd.DataFrame] = []
        size = 0
        for frame in frames:
            if not len(frame):
                continue
            anchor = frame["anchor"].to_numpy()
            total = np.cumsum(frame["window"].str.len().to_numpy())
            at = 0
            for cut in np.flatnonzero(np.r_[held and held[-1]["anchor"].iat[-1] != anchor[0], anchor[1:] != anchor[:-1]]).tolist():
                here = int(total[cut - 1] - (total[at - 1] if at else 0)) if cut > at else 0
                if size + here >= INDEX_CHARS:
                    held.append(frame.iloc[at:cut])
                    yield solve(held)
                    held, size, at = [], 0, cut
            held.append(frame.iloc[at:])
            size += int(total[-1] - (total[at - 1] if at else 0))
        if held:
            yield solve(held)

    return run


def repeated_passages(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, sig, start, stop, first): the stretches of each document, in characters from 0, that another document has too.

    first: no document with a smaller doc_id has them; where first is false, one does. A stretch is the union of matches of at least ``min_chars``; what a document
    repeats within itself only isn't one. sig is xxhash64 of the text: rows with one doc_id but other texts have spans of their own and aren't
    another document to each other; equal rows share theirs. Rows with a NULL doc_id or text, and texts shorter than ``min_chars``, have none. Texts are searched
    whole. An empty table gives no rows; other columns are ignored. Identifiers are whole numbers (TypeError for others); ``min_chars`` is 1 or more.
    """
    if not isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        raise TypeError("doc_id must be a whole number")
    texts = docs.where(F.col("doc_id").isNotNull() & (F.length("text") >= min_chars)).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("sig"), "text")
    found = texts.mapInPandas(_anchor_rows(min_chars), ANCHORS)
    w = Window.partitionBy("anchor")
    live = found.withColumns({"lo": F.min("doc_id").over(w), "hi": F.max("doc_id").over(w), "p0": F.min("print").over(w), "p1": F.max("print").over(w)}).where(F.col("lo") < F.col("hi"))
    live = materialise(live.withColumn("mixed", F.col("p0") != F.col("p1")).drop("hi", "p0", "p1"))
    span = ["doc_id", "sig", "start", "stop", "first"]
    pure = live.where(~F.col("mixed")).select("doc_id", "sig", F.col("a").alias("start"), F.col("b").alias("stop"), (F.col("doc_id") == F.col("lo")).alias("first"))
    mixed = live.where("mixed").drop("lo")
    # each different window once, at one place where its text can be read
    one = mixed.groupBy("anchor", "print").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.min(F.struct("doc_id", "sig", "a", "b")).alias("at"))
    wanted = one.groupBy(F.col("at.doc_id").alias("doc_id"), F.col("at.sig").alias("sig")).agg(F.collect_list(F.struct("anchor", "print", "lo", "hi", "at.a", "at.b")).alias("wanted"))
    windows = texts.join(wanted, ["doc_id", "sig"]).select("text", "wanted").mapInPandas(_cut_windows, "anchor long, print long, lo long, hi long, window string")
    windows = windows.repartition("anchor").sortWithinPartitions("anchor", "print")
    marked = windows.mapInPandas(_index_windows(min_chars), "anchor long, print long, start int, stop int, first boolean").distinct()
    own = Window.partitionBy("anchor", "print")
    placed = mixed.withColumn("own_lo", F.min("doc_id").over(own))
    leading = placed.where(F.col("doc_id") == F.col("own_lo")).join(marked, ["anchor", "print"]).select("doc_id", "sig", (F.col("a") + F.col("start")).alias("start"), (F.col("a") + F.col("stop")).alias("stop"), "first")
    following = placed.where(F.col("doc_id") > F.col("own_lo")).select("doc_id", "sig", F.col("a").alias("start"), F.col("b").alias("stop"), F.lit(False).alias("first"))
    return _merged(pure.select(span).union(leading.select(span)).union(following.select(span)))


def _merged(spans: DataFrame) -> DataFrame:
    """Unions of the spans of a document and kind that touch or overlap."""
    order = Window.partitionBy("doc_id", "sig", "first").orderBy("start", "stop")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("start") <= F.col("reach"), 0).otherwise(1)).over(order)
    return spans.distinct().withColumn("reach", reach).withColumn("island", island).groupBy("doc_id", "sig", "first", "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).select("doc_id", "sig", "start", "stop", "first")


def cut_repeats(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` without the stretches that a document with a smaller doc_id has; the first keeps them. A column n_chars is set to the new
    length. Rows of which only white space is left go; all others stay, NULL texts and identifiers included."""
    spans = repeated_passages(docs, min_chars).where(~F.col("first"))
    cuts = spans.groupBy(F.col("doc_id").alias("_cut_id"), F.col("sig").alias("_cut_sig")).agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("_cuts"))
    out = docs.join(cuts, (docs["doc_id"] == cuts["_cut_id"]) & (F.xxhash64(docs["text"]) == cuts["_cut_sig"]), "left")
    found = cuts["_cuts"]
    begins = F.concat(F.array(F.lit(0)), F.transform(found, lambda c: c["stop"]))
    ends = F.concat(F.transform(found, lambda c: c["start"]), F.array(F.length(docs["text"])))
    text = F.when(found.isNull(), docs["text"]).otherwise(F.array_join(F.zip_with(begins, ends, lambda a, b: F.substring(docs["text"], a + 1, b - a)), ""))
    new = safe_name(docs, "cut_text")
    out = out.withColumn(new, text).where(found.isNull() | F.col(new).rlike(r"\S"))
    kept = own_columns(docs)
    kept["text"] = F.col(new).alias("text")
    if "n_chars" in kept:
        kept["n_chars"] = F.when(found.isNull(), docs["n_chars"]).otherwise(F.length(new)).cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return out.select(*kept.values())
