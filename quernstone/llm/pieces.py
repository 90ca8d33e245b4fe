"""Operator 4: SentencePiece encoding and decoding for merge-type vocabularies.

A text's characters are joined by a score-ordered agenda of adjacent symbol pairs: the pair whose union is the best-scored piece
is merged first, the leftmost of equals, and the new symbol's pairs enter the agenda, until none is a piece. Characters that are no
piece become byte pieces.

A merge can't cross two neighbouring characters that stand next to each other in no piece. The vocabulary's own adjacent
pairs therefore say where a text falls apart into segments that are encoded independently; each Arrow batch encodes only
segments the worker doesn't hold yet. Texts are cut, and segments looked up and put together, as Arrow arrays. The sentencepiece library encodes the whole texts of each batch too, and the ids of each document are compared.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.llm.common import lean

SPACE = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Segments kept during a task; the older half goes when the newer is full.
HELD = 300_000
#: Lengths of the segments that are merged side by side; longer ones are merged alone.
LANES = ((0, 4), (4, 8), (8, 12), (12, 16), (16, 24), (24, 40), (40, 64))
NONE = np.int32(2**31 - 1)


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        n = shift = 0
        while True:
            b = data[at]
            at += 1
            n |= (b & 127) << shift
            if b < 128:
                return n
            shift += 7

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        elif tag & 7 == 2:
            n = varint()
            yield tag >> 3, data[at : at + n]
            at += n
        else:
            n = {1: 8, 5: 4}[tag & 7]
            yield tag >> 3, data[at : at + n]
            at += n


class _PairTable:
    """(left symbol, right symbol) -> place of their union, for arrays; an open-addressed hash table."""

    def __init__(self, pairs: dict[int, int]):
        self.bits = max(4, (2 * len(pairs)).bit_length())
        keys, values = np.fromiter(pairs.keys(), np.int64, len(pairs)), np.fromiter(pairs.values(), np.int32, len(pairs))
        self.keys, self.values = np.full((1 << self.bits) + 1024, -1, np.int64), np.full((1 << self.bits) + 1024, NONE, np.int32)
        at = self._slot(keys)
        while len(keys):
            free = self.keys[at] < 0
            _, first = np.unique(at, return_index=True)
            take = np.zeros(len(at), bool)
            take[first] = True
            take &= free
            self.keys[at[take]], self.values[at[take]] = keys[take], values[take]
            keys, values, at = keys[~take], values[~take], at[~take] + 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """NONE for a pair without a union, or where a symbol is negative."""
        keys = left.astype(np.int64) << 16 | right
        at = self._slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], NONE)
        open_ = np.nonzero((found != keys) & (found >= 0) & (keys >= 0))
        if len(open_[0]):
            keys, at = keys[open_], at[open_]
            place = np.arange(len(keys))
            values = np.full(len(keys), NONE, np.int32)
            while len(place):
                at = at + 1
                found = self.keys[at]
                hit = found == keys
                values[place[hit]] = self.values[at[hit]]
                more = ~hit & (found >= 0)
                place, keys, at = place[more], keys[more], at[more]
            out[open_] = values
        out[(left < 0) | (right < 0)] = NONE
        return out


class Codec:
    """One merge-type model with byte fallback, identity normalisation, a space put in front and none removed; ValueError for any other."""

    def __init__(self, path: str = MODEL):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as f:
            top = list(_fields(f.read()))
        trainer = dict(x for n, v in top if n == 2 for x in _fields(v))
        normal = dict(x for n, v in top if n == 3 for x in _fields(v))
        if trainer.get(3) != 2 or not trainer.get(35):
            raise ValueError("a BPE model with byte fallback is needed")
        if normal.get(2) or normal.get(3, 1) != 1 or normal.get(4, 1) != 0 or normal.get(5, 1) != 1:
            raise ValueError("the model's normalisation isn't supported")
        size = self.library.get_piece_size()
        self.pieces = [self.library.id_to_piece(i) for i in range(size)]
        if any(self.library.is_unused(i) for i in range(size)):
            raise ValueError("models with unused pieces aren't supported")
        self.byte_ids = [self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        special = {i for i in range(size) if self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i)}
        self.rank = {p: (-self.library.get_score(i), i) for i, p in enumerate(self.pieces) if i not in special}
        order = sorted(self.rank, key=self.rank.__getitem__)
        if len(order) > 1 << 16:
            raise ValueError("models with more than 65536 pieces aren't supported")
        place = {p: r for r, p in enumerate(order)}
        self.id_of = [self.rank[p][1] for p in order]
        self.single = {p: r for p, r in place.items() if len(p) == 1}
        self.pair = {place[p[:k]] << 16 | place[p[k:]]: r for p, r in place.items() for k in range(1, len(p)) if p[:k] in place and p[k:] in place}
        self.table = _PairTable(self.pair)
        self.symbol = np.full(0x110000, -1, np.int32)
        for c, r in self.single.items():
            self.symbol[ord(c)] = r
        self.ids = np.array(self.id_of, "<i4")
        self.unpieced = [("" if i in special else p.replace(SPACE, " ")) for i, p in enumerate(self.pieces)]
        self.byte_of = {i: b for b, i in enumerate(self.byte_ids)}
        self.surface, self.is_byte = np.array(self.unpieced, object), np.isin(np.arange(size), self.byte_ids)
        self.raw = pa.array([bytes([self.byte_of[i]]) if i in self.byte_of else p.encode() for i, p in enumerate(self.unpieced)], pa.large_binary())
        crossing = any(a != SPACE and b == SPACE for p in self.rank for a, b in zip(p, p[1:], strict=False))
        alone = "".join(c for c in "\n\r\t" if not any(c in p for p in self.rank if len(p) > 1))
        inner = f"[^{SPACE}{alone}]+"
        #: The rule in which cut() cuts texts, for one text; another that is put here is followed instead.
        self.split = self.rule = (lambda t: [t]) if crossing else re.compile(f"{SPACE}*{inner}|{SPACE}+" + (f"|[{alone}]" if alone else "")).findall
        self.crossing, self.alone = crossing, alone.encode()
        self.forget()

    def merge(self, text: str) -> list[int]:
        """Ids of a text in which spaces are already replaced. Symbols are the places of their pieces in the order of merging, -1 for what is no piece."""
        pair, single = self.pair, self.single
        symbols = [single.get(c, -1) for c in text]
        n = len(symbols)
        # entries: the union's place, then that of its left symbol; one is out of date if the two there no longer make this union
        agenda = [union << 32 | i for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if (union := pair.get(a << 16 | b, -1)) >= 0]
        if agenda:
            heapq.heapify(agenda)
            left, right = list(range(-1, n - 1)), list(range(1, n + 1))
            symbols.append(-1)  # nothing joins the end
            pop, push = heapq.heappop, heapq.heappush
            while agenda:
                entry = pop(agenda)
                union, i = entry >> 32, entry & 0xFFFFFFFF
                a = symbols[i]
                if a < 0:
                    continue
                j = right[i]
                if pair.get(a << 16 | symbols[j], -1) != union:
                    continue
                symbols[i], symbols[j] = union, -2
                k = right[i] = right[j]
                if k < n:
                    left[k] = i
                    if (more := pair.get(union << 16 | symbols[k], -1)) >= 0:
                        push(agenda, more << 32 | i)
                h = left[i]
                if h >= 0 and (more := pair.get(symbols[h] << 16 | union, -1)) >= 0:
                    push(agenda, more << 32 | h)
            symbols.pop()
        id_of = self.id_of
        if min(symbols, default=0) >= 0:
            return [id_of[x] for x in symbols]
        ids: list[int] = []
        for c, x in zip(text, symbols, strict=True):
            if x >= 0:
                ids.append(id_of[x])
            elif x == -1:
                ids.extend(self.byte_ids[b] for b in c.encode("utf-8", "replace"))
        return ids

    def merge_all(self, segments: list[str]) -> list[list[int]]:
        """merge() of each segment."""
        codes = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), np.uint32)
        ids, ends = self.merge_codes(codes, np.cumsum([0, *map(len, segments)]))
        return [x.tolist() for x in np.split(ids, ends[1:-1])] if segments else []

    def merge_codes(self, codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """merge() of segments of characters after each other: ids after each other, and their offsets. Segments of up to 64 characters pop their agendas together: a lane's
        agenda is a row with the place in order of each neighbouring pair's union, of which every lane takes the least, the leftmost of equals, in one step."""
        size = np.diff(offsets)
        symbols = self.symbol[codes]
        counts = np.zeros(len(size), np.int64)
        owners, found = [], []
        alone = size > LANES[-1][1]
        for low, high in LANES:
            own = np.flatnonzero((size > low) & (size <= high))
            if not len(own):
                continue
            width = int(size[own].max()) + 1
            inside = np.arange(width) < size[own][:, None]
            rows = np.full((len(own), width), -2, np.int32)
            rows[inside] = symbols[(offsets[own][:, None] + np.arange(width))[inside]]
            known = (rows != -1).all(axis=1)
            alone[own[~known]] = True
            own, rows = own[known], rows[known]
            if not len(own):
                continue
            # in an agenda's last place stands no pair, so that a row with nothing left to join has its least there
            agenda = np.full(rows.shape, NONE, np.int32)
            agenda[:, :-1] = self.table.find(rows[:, :-1], rows[:, 1:])
            while len(own):
                at = agenda.argmin(axis=1)
                lane = np.arange(len(own))
                union = agenda[lane, at]
                if (ended := union == NONE).any():
                    done = rows[ended]
                    used = done >= 0
                    owners.append(own[ended])
                    found.append(self.ids[done[used]])
                    counts[owners[-1]] = used.sum(axis=1)
                    own, rows, agenda, at, union = own[~ended], rows[~ended], agenda[~ended], at[~ended], union[~ended]
                    if not len(own):
                        break
                    lane = np.arange(len(own))
                rows[lane, at] = union
                keep = np.arange(rows.shape[1]) != at[:, None] + 1
                rows, agenda = rows[keep].reshape(len(own), -1), agenda[keep].reshape(len(own), -1)
                last = rows.shape[1] - 1
                agenda[lane, at] = np.where(at < last, self.table.find(union, rows[lane, np.minimum(at + 1, last)]), NONE)
                inner = np.flatnonzero(at)
                agenda[inner, at[inner] - 1] = self.table.find(rows[inner, at[inner] - 1], union[inner])
        for i in np.flatnonzero(alone):
            ids = self.merge(codes[offsets[i] : offsets[i + 1]].tobytes().decode("utf-32-le", "surrogatepass"))
            owners.append([i])
            found.append(np.array(ids, "<i4"))
            counts[i] = len(ids)
        ends = np.r_[0, np.cumsum(counts)]
        flat = np.empty(ends[-1], "<i4")
        if owners:
            order = np.concatenate(owners)
            many = counts[order]
            flat[np.repeat(ends[order] - (np.cumsum(many) - many), many) + np.arange(len(flat))] = np.concatenate(found)
        return flat, ends

    def cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The segments of all texts after each other, as bytes in which spaces stand for themselves, and the number of the first of each text, with the end. None and '' have none."""
        texts = texts.cast(pa.large_string()).fill_null("")
        if self.split is not self.rule:
            parts = [self.split(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts.to_pylist()]
            return pa.array([s.replace(SPACE, " ").encode() for p in parts for s in p], pa.large_binary()), np.cumsum([0, *map(len, parts)])
        own = pc.replace_substring(texts, SPACE, " ")
        own = pc.binary_join_element_wise(pc.if_else(pc.equal(own, ""), pa.scalar("", own.type), pa.scalar(" ", own.type)), own, pa.scalar("", own.type))
        ends = np.frombuffer(own.buffers()[1], np.int64)[own.offset : own.offset + len(own) + 1] if len(own) else np.zeros(1, np.int64)
        if ends[-1] == ends[0]:
            return pa.array([], pa.large_binary()), np.zeros(len(own) + 1, np.int64)
        data = np.frombuffer(own.buffers()[2], np.uint8)[: ends[-1]]
        begins = np.zeros(len(data), bool)
        if not self.crossing:
            space = data == ord(" ")
            begins[1:] = space[1:] & ~space[:-1]
            for c in self.alone:
                one = data == c
                begins |= one
                begins[1:] |= one[:-1]
        begins[ends[:-1][ends[:-1] < ends[1:]]] = True
        places = np.append(np.flatnonzero(begins), ends[-1])
        return pa.Array.from_buffers(pa.large_binary(), len(places) - 1, [None, pa.py_buffer(places), own.buffers()[2]]), np.searchsorted(places, ends)

    def merge_bytes(self, segments: pa.Array) -> pa.Array:
        """merge() of segments as cut() gives them, as little-endian int32."""
        if not len(segments):
            return pa.array([], pa.large_binary())
        places = np.frombuffer(segments.buffers()[1], np.int64)[segments.offset : segments.offset + len(segments) + 1]
        data = segments.buffers()[2].to_pybytes()[places[0] : places[-1]]
        codes = np.frombuffer(data.decode().encode("utf-32-le"), np.uint32)
        codes = np.where(codes == ord(" "), np.uint32(ord(SPACE)), codes)
        characters = np.append(0, np.cumsum(np.frombuffer(data, np.uint8) & 0xC0 != 0x80))
        ids, ends = self.merge_codes(codes, characters[places - places[0]])
        return pa.Array.from_buffers(pa.large_binary(), len(segments), [None, pa.py_buffer(4 * ends), pa.py_buffer(ids)])

    def ids_of(self, segments: pa.Array) -> pa.Array:
        """merge_bytes() of different segments, which are then held; those held are looked up."""
        (new, new_ids), (old, old_ids) = self.new, self.old
        at = pc.index_in(segments, value_set=new).fill_null(-1).to_numpy().astype(np.int64)
        absent = at < 0
        fresh = segments.filter(pa.array(absent))
        in_old = pc.index_in(fresh, value_set=old).fill_null(-1).to_numpy()
        wanted = in_old < 0
        at[absent] = len(new) + np.where(wanted, len(old) + np.cumsum(wanted) - 1, in_old)
        ids = pa.concat_arrays([new_ids, old_ids, self.merge_bytes(fresh.filter(pa.array(wanted)))]).take(pa.array(at))
        if len(fresh):
            if len(new) + len(fresh) > HELD:
                self.forget()
                self.old = (new, new_ids)
            if len(fresh) <= HELD:
                self.new = (pa.concat_arrays([self.new[0], fresh]), pa.concat_arrays([self.new[1], ids.filter(pa.array(absent))]))
        return ids

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bool | None]]:
        """The ids of all texts after each other, their offsets, and of each text whether the library gives the same ids for the whole text; None for None, which has no ids."""
        segments, first = self.cut(texts)
        segments = segments.dictionary_encode()
        found = self.ids_of(segments.dictionary).take(segments.indices)
        _, places, data = found.buffers()
        offsets = np.frombuffer(places, np.int64)[first] // 4 if len(found) else np.zeros(len(texts) + 1, np.int64)
        ids = np.frombuffer(data, "<i4")[: offsets[-1]] if len(found) else np.zeros(0, "<i4")
        theirs = iter(self.library.encode(texts.drop_null().to_pylist(), return_type="numpy", num_threads=1))
        return ids, offsets, [np.array_equal(next(theirs), ids[a:b]) if valid else None for valid, a, b in zip(texts.is_valid().to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]

    def encode_batch(self, texts: list[str | None]) -> tuple[list[bytes | None], list[bool | None]]:
        """encode_column() of a list: of each text its ids as little-endian int32, and whether the library agrees; None for None."""
        ids, offsets, agree = self.encode_column(pa.array(texts, pa.large_string()))
        return [None if t is None else ids[a:b].tobytes() for t, a, b in zip(texts, offsets[:-1], offsets[1:], strict=True)], agree

    def forget(self) -> None:
        """Drop the segments held."""
        none = pa.array([], pa.large_binary())
        self.new = self.old = (none, none)

    def round_trips(self, texts: list[str | None], ids: np.ndarray, offsets: np.ndarray) -> list[bool | None]:
        """Whether decoding the ids that encode_batch() gives for each text, here after each other, gives the text back; None for None. The bytes of all pieces are put
        together at once; a text is decoded alone only where they aren't its own, since what isn't UTF-8 becomes U+FFFD."""
        found = self.raw.take(pa.array(ids, pa.int32()))
        _, places, data = found.buffers()
        ends = np.frombuffer(places, np.int64)[offsets].tolist()
        joined = data.to_pybytes() if data else b""
        out: list[bool | None] = []
        for k, t in enumerate(texts):
            if t is None:
                out.append(None)
                continue
            own = t.encode("utf-8", "surrogatepass")
            begin = ends[k] + joined.startswith(b" ", ends[k], ends[k + 1])
            same = ends[k + 1] - begin == len(own) and joined.startswith(own, begin)
            out.append(same or self.decode_array(ids[offsets[k] : offsets[k + 1]]) == t)
        return out

    def decode_array(self, ids: np.ndarray) -> str:
        """decode() of an array."""
        if self.is_byte.take(ids).any():
            return self.decode(ids.tolist())
        joined = "".join(self.surface.take(ids).tolist())
        return joined[1:] if joined[:1] == " " else joined

    def decode(self, ids: list[int]) -> str:
        """The text of ids; runs of byte pieces are decoded together, what isn't UTF-8 becoming U+FFFD, and the space in front goes."""
        joined = "".join(map(self.unpieced.__getitem__, ids))
        if self.byte_of.keys() & set(ids):
            out, run = [], bytearray()
            for i in ids:
                if (b := self.byte_of.get(i)) is not None:
                    run.append(b)
                else:
                    if run:
                        out.append(run.decode("utf-8", "replace"))
                        run = bytearray()
                    out.append(self.unpieced[i])
            joined = "".join(out) + run.decode("utf-8", "replace")
        return joined[1:] if joined[:1] == " " else joined


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The worker's codec of a model."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def model_of(spark: SparkSession) -> str:
    """The vocabulary file that the session names in ``quernstone.sentencepiece.model``, which all workers can read; else MODEL."""
    return spark.conf.get("quernstone.sentencepiece.model", MODEL)


def encode(docs: DataFrame, model: str = MODEL, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids, n_tokens, round_trip, library_agrees), one row for each row of ``docs``.

    round_trip: decoding gives the text back. library_agrees: the sentencepiece library gives the same ids for the whole text. A NULL text has NULL in all but
    doc_id, an empty one no ids; a NULL doc_id and repeated rows stay as they are. A text is always encoded whole; one that has U+2581 itself comes back with a space. Other columns are
    ignored; an empty table gives no rows.
    """
    kind = docs.schema[id_column].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.IntegerType()), T.StructField("round_trip", T.BooleanType()), T.StructField("library_agrees", T.BooleanType())])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                texts = batch.column(1)
                values, offsets, agree = c.encode_column(texts)
                none = texts.is_null()
                trip = c.round_trips(texts.to_pylist(), values, offsets)
                ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()), mask=none)
                yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array(np.diff(offsets), pa.int32(), mask=none.to_numpy(zero_copy_only=False)), pa.array(trip, pa.bool_()), pa.array(agree, pa.bool_())], names=schema.names)
        c.forget()

    return docs.select(F.col(id_column), F.col(text)).mapInArrow(run, schema)


def decode(ids: Column, model: str = MODEL) -> Column:
    """The text of a column of ids; '' for no ids; NULL for NULL, and where an id is NULL, negative or beyond the vocabulary."""

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = codec(model)
        size = len(c.pieces)
        for rows in parts:
            yield pd.Series([None if r is None or any(i is None or not 0 <= i < size for i in r) else c.decode([int(i) for i in r]) for r in rows], dtype=object)

    return run(ids)
