"""Operator 3: language identification by prediction by partial matching.

For each language a context tree over bytes is counted on a bounded labelled sample: every context of up to ORDER
bytes with the bytes that followed it. Escapes follow method C with full exclusion: in a context where q distinct bytes
followed T times, a byte seen c times costs -log2(c / (T + q)), any other costs -log2(q / (T + q)) and is
coded in the next shorter context without the bytes excluded so far, at last evenly among the bytes never seen.
The code lengths of the 256 bytes in any context therefore are those of a probability distribution.

The statistics are frozen after fitting, so the cost of every byte in every context is a table; the
contexts of all languages form one tree, walked backwards from each position by array lookups for a whole batch. A document's
language is the one with the shortest code.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.llm.common import byte_batches, joined, lean, small_batches

ORDER = 4
#: A context of any length but none must occur this often in the sample of one language.
LEAST = 3
SAMPLE_PER_LANGUAGE = 200
#: Bits a byte in the best language, above which a document is in none of them.
REJECT_ABOVE = 6.0
BATCH_BYTES = 1 << 16
#: Costs are kept as whole numbers of 1 / UNITS bits.
UNITS = 1024
#: Contexts tabulated at once, which bounds what the driver needs beside the tables themselves.
CONTEXTS = 2048
RESULT = "lang string, bits_per_byte double, margin double, accepted boolean"


@dataclass
class Model:
    """classes: byte -> class (1 and more; the last is for bytes that no sample had; 0 stands for what precedes a text). child: (state shorter than order, class) -> state one byte longer, the last
    state meaning none; its last row stands for all other states. cost: (state, class, language) -> bits in UNITS."""

    languages: list[str]
    classes: np.ndarray
    child: np.ndarray
    cost: np.ndarray
    order: int

    def score(self, texts: list[bytes]) -> np.ndarray:
        """(text, language) code lengths in bits; 0 for an empty text."""
        total = np.zeros((len(texts), len(self.languages)))
        width = self.child.shape[1]
        flat, costs, none = self.child.ravel(), self.cost.reshape(-1, len(self.languages)), self.cost.shape[0] - 1
        other = self.child.shape[0] - 1
        for first, last in byte_batches(texts, BATCH_BYTES):
            data, offsets = joined(texts[first:last])
            if not len(data):
                continue
            # the texts with ORDER classes 0 in front of each
            pad = self.order * np.arange(1, last - first + 1)
            at = np.arange(len(data)) + np.repeat(pad, np.diff(offsets))
            symbols = np.zeros(len(data) + self.order * (last - first), np.int32)
            own = self.classes[data]
            symbols[at] = own
            node = flat[symbols[at - 1]] if self.order else np.zeros(len(data), np.int32)
            state = np.where(node != none, node, 0)
            for k in range(2, self.order + 1):
                node = flat[np.minimum(node, other) * width + symbols[at - k]]
                state = np.where(node != none, node, state)
            rows = costs[state * width + own]
            full = np.flatnonzero(np.diff(offsets))
            total[first + full] = np.add.reduceat(rows, offsets[full], axis=0, dtype=np.int64) / UNITS
        return total


def fit(samples: dict[str, list[bytes]], order: int = ORDER, least: int = LEAST) -> Model:
    """Count the samples' contexts and tabulate the code lengths. A language without bytes is left out."""
    samples = {k: [t for t in v if t] for k, v in samples.items()}
    languages = sorted(k for k, v in samples.items() if v)
    if not languages:
        return Model([], np.ones(256, np.int32), np.ones((2, 2), np.int32), np.zeros((2, 2, 0), np.uint16), order)
    seen = np.zeros(256, bool)
    for k in languages:
        for t in samples[k]:
            seen[np.frombuffer(t, np.uint8)] = True
    classes = np.full(256, seen.sum() + 1, np.int32)
    classes[seen] = np.arange(1, seen.sum() + 1)
    width = int(seen.sum()) + 2
    # counts[l][k]: context code (the last byte before is the lowest digit) * width + symbol -> times
    counts: list[list[tuple[np.ndarray, np.ndarray]]] = []
    for k in languages:
        stream = np.concatenate([np.r_[np.zeros(order, np.int64), classes[np.frombuffer(t, np.uint8)]] for t in samples[k]])
        starts = np.cumsum([0] + [len(t) + order for t in samples[k]])
        real = np.ones(len(stream), bool)
        for i in range(order):
            real[starts[:-1] + i] = False
        place = np.flatnonzero(real)
        code = np.zeros(len(place), np.int64)
        levels = []
        for n in range(order + 1):
            if n:
                code = code + stream[place - n] * width ** (n - 1)
            levels.append(np.unique(code * width + stream[place], return_counts=True))
        counts.append(levels)
    # the contexts that are kept, by length; a context's suffixes are kept with it
    kept = [np.zeros(1, np.int64)]
    for n in range(1, order + 1):
        these = []
        for levels in counts:
            pairs, times = levels[n]
            context, where = np.unique(pairs // width, return_inverse=True)
            these.append(context[np.bincount(where, times) >= least])
        found = np.unique(np.concatenate(these))
        kept.append(found[np.isin(found % width ** (n - 1), kept[n - 1])])
    base = np.cumsum([0] + [len(x) for x in kept])
    none = int(base[-1])
    child = np.full((int(base[order]) + 1, width), none, np.int32)
    suffix = np.zeros(none, np.int64)
    for n in range(1, order + 1):
        up = base[n - 1] + np.searchsorted(kept[n - 1], kept[n] % width ** (n - 1))
        suffix[base[n] : base[n + 1]] = up
        child[up, kept[n] // width ** (n - 1)] = np.arange(base[n], base[n + 1])
    cost = np.zeros((none + 1, width, len(languages)), np.uint16)
    for i, levels in enumerate(counts):
        table = np.zeros((none, width), np.float32)
        for n in range(order + 1):
            if not len(kept[n]):
                break
            pairs, times = levels[n]
            at = np.searchsorted(kept[n], pairs // width)
            hit = (at < len(kept[n])) & (kept[n][np.minimum(at, len(kept[n]) - 1)] == pairs // width)
            table[base[n] + at[hit], pairs[hit] % width] = times[hit]
        _code_lengths(table, suffix, base, cost[:none, :, i])
    return Model(languages, classes, child, cost, order)


def _code_lengths(table: np.ndarray, suffix: np.ndarray, base: np.ndarray, out: np.ndarray) -> None:
    """Fill ``out`` with the (context, class) bits of one language; a context it doesn't have costs what its longest suffix that it has does."""
    rest = np.zeros(table.shape, np.float32)  # bits of a class after the escape from the context
    unseen = 256 - int((table[0] > 0).sum())
    rest[0] = np.log2(max(1, unseen))
    for n in range(len(base) - 1):
        for first in range(base[n], base[n + 1], CONTEXTS):
            own = np.arange(first, min(first + CONTEXTS, base[n + 1]))
            times = table[own].astype(np.float64)
            has = times.sum(axis=1) > 0
            with np.errstate(divide="ignore", invalid="ignore"):
                if n:
                    up = suffix[own]
                    above = np.where(times > 0, 0, table[up])
                    q, total = (above > 0).sum(axis=1), above.sum(axis=1)
                    escape = np.where(q > 0, -np.log2(q / (total + q)), 0)[:, None]
                    rest[own] = np.where(above > 0, -np.log2(above / (total + q)[:, None]), escape + rest[up])
                q, total = (times > 0).sum(axis=1), times.sum(axis=1)
                coded = np.where(times > 0, -np.log2(times / (total + q)[:, None]), -np.log2(q / (total + q))[:, None] + rest[own])
            if n:
                coded[~has] = out[suffix[own[~has]]] / UNITS
            out[own] = np.minimum(np.rint(coded * UNITS), 65535)


def sample(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> dict[str, list[bytes]]:
    """Whole texts of at most ``per_language`` rows for each label in ``lang``, those with the lowest md5(doc_id): the bound of what is fitted
    and of what reaches the driver. Only identifiers are ranked; the texts are read in a second pass."""
    labelled = docs.where(F.col("lang").isNotNull() & (F.length("text") > 0) & F.col("doc_id").isNotNull())
    order = Window.partitionBy("lang").orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id")
    chosen = labelled.select("doc_id", "lang").withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_language).select("doc_id", "lang").distinct()
    rows = labelled.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"]).collect()
    out: dict[str, list[bytes]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["doc_id"], r["text"])):
        out.setdefault(r["lang"], []).append(r["text"].encode())
    return out


def identify(text: Column, model, reject_above: float = REJECT_ABOVE) -> Column:
    """struct(lang, bits_per_byte, margin, accepted) of a text. model: a broadcast Model. margin: how many bits a byte the second language costs more (NULL with one language).

    A NULL or empty text, or one that costs more than ``reject_above`` bits a byte in every language, has lang 'und' and isn't accepted; ties go to the
    name that sorts first. All bytes of a text count, however many.
    """

    @F.pandas_udf(RESULT)
    @lean
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = model.value
        for texts in parts:
            raw = [(t or "").encode("utf-8", "replace") for t in texts]
            size = np.array([len(t) for t in raw], float)
            if not m.languages:
                yield pd.DataFrame({"lang": "und", "bits_per_byte": None, "margin": None, "accepted": False}, index=range(len(raw)))
                continue
            bits = m.score(raw) / np.maximum(size, 1)[:, None]
            best = bits.argmin(axis=1)
            ranked = np.sort(bits, axis=1)
            ok = (size > 0) & (ranked[:, 0] <= reject_above)
            margin = ranked[:, 1] - ranked[:, 0] if len(m.languages) > 1 else np.full(len(raw), np.nan)
            yield pd.DataFrame({"lang": np.where(ok, np.array(m.languages, object)[best], "und"), "bits_per_byte": pd.Series(ranked[:, 0]).where(size > 0), "margin": pd.Series(margin).where(size > 0), "accepted": ok})

    return run(text)


def fitted(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE):
    small_batches(docs.sparkSession)
    return docs.sparkSession.sparkContext.broadcast(fit(sample(docs, per_language)))


def identify_languages(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, reject_above: float = REJECT_ABOVE) -> DataFrame:
    """(doc_id, lang, bits_per_byte, margin, accepted), one row for each row of ``docs``: every NULL doc_id and repeated row has its own, as in identify().
    Rows with a NULL lang are scored, not fitted; without any labelled text every row is 'und'. Other columns are ignored."""
    return docs.select("doc_id", identify(F.col("text"), fitted(docs, per_language), reject_above).alias("found")).select("doc_id", "found.*")


def keep_identified(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, reject_above: float = REJECT_ABOVE) -> DataFrame:
    """The rows of ``docs`` whose text identify() accepts, columns as they came."""
    return docs.where(identify(F.col("text"), fitted(docs, per_language), reject_above)["accepted"])
