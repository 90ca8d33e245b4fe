import heapq
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm.conftest import rows_of, sentence

from quernstone.llm import ctxmix


M32 = (1 << 32) - 1
LETTERS = {*range(65, 91), *range(97, 123), *range(128, 256)}


def contexts(data):
    """The contexts of each byte, by their definition."""
    out, word = [], 0
    for i, byte in enumerate(data):
        at = lambda k, i=i: data[i - k] if i >= k else 0
        out.append([at(1), at(1) | at(2) << 8, at(1) | at(2) << 8 | at(3) << 16, word >> 8])
        word = (word + byte + 1) * 0x5BD1E995 & M32 if byte in LETTERS else 0
    return out


def slot(context, order, node):
    if order == 0:
        return context << 8 | node
    h = context * 0x9E3779B1 & M32
    h ^= h >> 15
    h = h * 0x85EBCA77 & M32
    return h >> 32 - (ctxmix.SLOT_BITS[order] - 8) << 8 | (node ^ (h >> 1 & 255))


class PlainModel:
    """Tree and logits from the texts alone: dictionaries, and a Huffman tree of its own."""

    def __init__(self, texts, counted):
        """texts: those whose bytes make the tree; counted: those whose contexts are counted."""
        counts, weights = {}, [0] * 256
        for t in texts:
            for b in t:
                weights[b] += 1
        least = max(1.0, sum(weights) / 4096)
        heap = [(float(w + least), i, None) for i, w in enumerate(weights)]
        heapq.heapify(heap)
        inner = 256
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            heapq.heappush(heap, (a[0] + b[0], inner, (a, b)))
            inner += 1
        self.paths = {}

        def walk(tree, path):
            if tree[2] is None:
                self.paths[tree[1]] = path
            else:
                for bit in (0, 1):
                    walk(tree[2][bit], [*path, (inner - 1 - tree[1], bit)])

        walk(heap[0], [])
        for t in counted:
            for b, cs in zip(t, contexts(t), strict=True):
                for k, c in enumerate(cs):
                    for node, bit in self.paths[b]:
                        counts.setdefault((k, slot(c, k, node)), [0, 0])[bit] += 1
        self.logits = {at: max(-127, min(127, round(16 * math.log((one + 0.4) / (zero + 0.4))))) for at, (zero, one) in counts.items()}

    def cost(self, data):
        """One bit after the other; weights and map move after each step."""
        total = 0.0
        weights = [[ctxmix.FIRST_WEIGHT] * 4 for _ in range(ctxmix.GATES)]
        maps = [[1 / (1 + math.exp(-(s - 16) / 2)) for s in range(ctxmix.MAP_STEPS)] for _ in range(ctxmix.MAP_DEPTHS)]
        known = contexts(data)
        for begin in range(0, len(data), ctxmix.STEP):
            moves, cells = [[0.0] * 4 for _ in range(ctxmix.GATES)], {}
            deep = max(len(self.paths[b]) for b in data[begin : begin + ctxmix.STEP])
            for d in range(deep):
                now = {}
                for i in range(begin, min(begin + ctxmix.STEP, len(data))):
                    path = self.paths[data[i]]
                    if len(path) <= d:
                        continue
                    node, bit = path[d]
                    x = [self.logits.get((k, slot(c, k, node)), 0) / 16 for k, c in enumerate(known[i])]
                    g = min(d, ctxmix.GATES - 1)
                    z = max(-7.9, min(7.9, sum(a * b for a, b in zip(weights[g], x, strict=True))))
                    p = 1 / (1 + math.exp(-z))
                    for k in range(4):
                        moves[g][k] += ctxmix.RATE * (bit - p) * x[k]
                    level, cell = min(d, ctxmix.MAP_DEPTHS - 1), 16 + round(2 * z)
                    v = maps[level][cell]
                    final = (p + v) / 2
                    now[level, cell] = v + ctxmix.MAP_RATE * (bit - v)
                    total -= math.log2(final if bit else 1 - final)
                for (level, cell), v in now.items():
                    maps[level][cell] = v
            weights = [[w + m for w, m in zip(a, b, strict=True)] for a, b in zip(weights, moves, strict=True)]
        return total


def by_half(spark, texts):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    half = {r["doc_id"]: r["half"] for r in docs.select("doc_id", ctxmix.half_of(F.col("doc_id")).alias("half")).collect()}
    return docs, half


def test_counts_equal_those_of_the_definition(spark):
    rng = random.Random(1)
    texts = [sentence(rng, 50), "Ünï \n\n12 ab", sentence(rng, 900), "", None, "ab", "ab"]
    docs, half = by_half(spark, texts)
    want = {}
    for n, t in enumerate(texts):
        data = (t or "").encode()
        for b, cs in zip(data, contexts(data), strict=True):
            for k, c in enumerate(cs):
                at = (half[n] * 4 + k, c << 8 | b)
                want[at] = want.get(at, 0) + 1
    rows = ctxmix.gather_counts(docs.repartition(3)).collect()
    assert len({(r["part"], r["region"]) for r in rows}) == len(rows)
    got = [((r["part"], int(c)), int(t)) for r in rows for c, t in zip(np.frombuffer(r["cells"], np.uint32), np.frombuffer(r["times"], np.int64), strict=True)]
    assert len(dict(got)) == len(got) and dict(got) == want


def test_bits_of_the_query_equal_a_plain_coder(spark):
    """Tree, counts, tables, mixing and map all made anew; one text is over 10 kB."""
    rng = random.Random(2)
    texts = [sentence(rng, n) for n in (3, 40, 300, 120, 77)] + ["other words, ÜÖÄ\0", "", "a"]
    texts.append(" ".join(rng.choice(texts[2].split()) for _ in range(2600)))
    assert len(texts[-1]) > 10_000
    docs, half = by_half(spark, texts)
    assert set(half.values()) == {0, 1}
    raw = [t.encode() for t in texts]
    plain = [PlainModel(raw, [t for n, t in enumerate(raw) if half[n] != h]) for h in range(2)]
    for r in ctxmix.score(docs).collect():
        assert r["bits"] == pytest.approx(plain[half[r["doc_id"]]].cost(texts[r["doc_id"]].encode()), rel=2e-3, abs=0.05)


def test_code_tree_is_a_prefix_code():
    weights = np.random.default_rng(1).integers(1, 5000, 256)
    nodes, bits, length = ctxmix._code(weights)
    codes = {"".join(str(int(b)) for b in bits[: length[i], i]) for i in range(256)}
    assert len(codes) == 256 and sum(2.0 ** -len(c) for c in codes) == 1
    heap = weights.tolist()
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        cost += a
        heapq.heappush(heap, a)
    assert (weights * length).sum() == cost


def test_learned_text_is_cheaper_than_noise(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = ctxmix.fit(docs.where("doc_id % 2 = 0"))
    shared = spark.sparkContext.broadcast(model)
    held = ctxmix.score(docs.where("doc_id % 2 = 1 AND length(text) > 200"), shared).selectExpr("percentile(bits_per_byte, 0.5)").first()[0]
    rng = random.Random(3)
    noise = spark.createDataFrame([(1, "".join(chr(rng.randint(33, 126)) for _ in range(2000)))], "doc_id long, text string")
    junk = ctxmix.score(noise, shared).first()["bits_per_byte"]
    assert held < 4 < junk


def test_odd_rows(spark, odd_docs, clashing_docs, no_docs, odd_rows):
    out = ctxmix.score(odd_docs).collect()
    assert sorted(((r["doc_id"], r["n_bytes"]) for r in out), key=repr) == sorted(((d, None if t is None else len(t.encode())) for d, t, *_ in odd_rows), key=repr)
    by = {r["doc_id"]: r for r in out}
    assert by[30]["bits"] is None and by[30]["bits_per_byte"] is None
    assert by[31]["bits"] == 0 and by[31]["bits_per_byte"] is None
    assert len(rows_of(ctxmix.score(clashing_docs))) == len(out)
    assert ctxmix.score(no_docs).count() == 0
