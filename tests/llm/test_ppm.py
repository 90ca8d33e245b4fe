import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm.conftest import DOCS, rows_of

from quernstone.llm import ppm


def brute_bits(samples, text, order, least):
    """Code length of ``text`` under contexts counted in dictionaries, with escapes and exclusion step by step; samples: all languages, the first is scored."""
    counts, longest = [], {}
    for texts in samples:
        own = {}
        for t in texts:
            padded = [-1] * order + list(t)
            for i in range(order, len(padded)):
                for n in range(order + 1):
                    own.setdefault(tuple(padded[i - n : i]), {}).setdefault(padded[i], 0)
                    own[tuple(padded[i - n : i])][padded[i]] += 1
        counts.append(own)
        for c, v in own.items():
            longest[c] = max(longest.get(c, 0), sum(v.values()))
    kept = {()}
    for n in range(1, order + 1):
        kept |= {c for c, t in longest.items() if len(c) == n and t >= least and c[1:] in kept}
    own, total = counts[0], 0.0
    padded = [-1] * order + list(text)
    for i in range(order, len(padded)):
        symbol = padded[i]
        n = max(k for k in range(order + 1) if all(tuple(padded[i - j : i]) in kept for j in range(k + 1)))
        excluded = set()
        while n >= 0:
            here = {s: c for s, c in own.get(tuple(padded[i - n : i]), {}).items() if s not in excluded}
            q, t = len(here), sum(here.values())
            if symbol in here:
                total -= math.log2(here[symbol] / (t + q))
                break
            if q:
                total -= math.log2(q / (t + q))
            excluded |= set(own.get(tuple(padded[i - n : i]), {}))
            n -= 1
        else:
            total += math.log2(256 - len(excluded))
    return total


@pytest.mark.parametrize("order,least", [(0, 1), (1, 1), (2, 2), (3, 1), (ppm.ORDER, ppm.LEAST)])
def test_code_lengths_equal_a_step_by_step_coder(order, least):
    rng = random.Random(order)
    make = lambda letters, n: "".join(rng.choice(letters) for _ in range(n)).encode()
    samples = {"x": [make("aab ", 200), make("abc", 50)], "y": [make("bcd", 150)], "z": [b"zz"]}
    model = ppm.fit(samples, order, least)
    texts = [make("abcd e", n) for n in (1, 2, 5, 30, 80)] + ["é\0".encode()]
    got = model.score(texts)
    for k, name in enumerate(model.languages):
        rest = [samples[m] for m in samples if m != name]
        for t, bits in zip(texts, got[:, k], strict=True):
            assert bits == pytest.approx(brute_bits([samples[name], *rest], t, order, least), abs=len(t) / (2 * ppm.UNITS) + 1e-6)


def test_probabilities_of_all_bytes_sum_to_one():
    model = ppm.fit({"x": [b"abracadabra " * 20], "y": [b"hocus pocus " * 10]}, 3, 2)
    seen = model.classes.max() - 1
    for state in range(model.cost.shape[0] - 1):
        p = 2.0 ** -(model.cost[state] / ppm.UNITS)
        total = p[1 : seen + 1].sum(axis=0) + (256 - seen) * p[seen + 1]
        np.testing.assert_allclose(total, 1, rtol=1e-3)


def test_held_out_accuracy_and_rejection(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    fitted = docs.where("doc_id % 2 = 0")
    model = ppm.fitted(fitted, 50)
    held = docs.where("doc_id % 2 = 1 AND length(text) > 40").select("lang", ppm.identify(F.col("text"), model).alias("f"))
    right = held.where("f.accepted").agg(F.avg((F.col("lang") == F.col("f.lang")).cast("double"))).first()[0]
    assert right > 0.95
    junk = spark.createDataFrame([("\x01\x7f" + "".join(map(chr, range(0x3000, 0x3100))),)], "text string").select(ppm.identify(F.col("text"), model).alias("f")).first()["f"]
    assert junk["lang"] == "und" and not junk["accepted"]


def test_odd_rows(spark, odd_docs, clashing_docs, no_docs, odd_rows):
    out = ppm.identify_languages(odd_docs).collect()
    assert len(out) == len(odd_rows)
    by = {r["doc_id"]: r for r in out}
    for empty in (30, 31):
        assert by[empty]["lang"] == "und" and by[empty]["bits_per_byte"] is None and not by[empty]["accepted"]
    assert sum(r["doc_id"] is None for r in out) == 2
    assert rows_of(ppm.identify_languages(clashing_docs)) == rows_of(ppm.identify_languages(odd_docs))
    kept = ppm.keep_identified(clashing_docs)
    assert kept.columns == clashing_docs.columns and kept.count() == sum(r["accepted"] for r in out)
    assert ppm.identify_languages(no_docs).count() == 0
    unlabelled = spark.createDataFrame([(1, "text", None, None, 4)], DOCS)
    assert rows_of(ppm.identify_languages(unlabelled)) == [(1, "und", None, None, False)]


def test_ties_go_to_the_first_name(spark):
    docs = spark.createDataFrame([(1, "same words here", "b", None, 1), (2, "same words here", "a", None, 1)], DOCS)
    assert {r["lang"] for r in ppm.identify_languages(docs).collect()} <= {"a", "und"}
    assert all(r["margin"] == 0 for r in ppm.identify_languages(docs).collect())
