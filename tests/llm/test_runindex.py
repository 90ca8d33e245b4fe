import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tests.llm.conftest import DOCS, rows_of, sentence

from quernstone.llm import runindex


def brute(rows, least):
    """(doc_id, text) -> {(doc_id, text, first): marked characters}, from the set of all stretches of ``least`` characters."""
    rows = sorted({(d, t) for d, t in rows if d is not None and t is not None})
    where = {}
    for d, t in rows:
        for i in range(len(t) - least + 1):
            where.setdefault(t[i : i + least], set()).add(d)
    out = {}
    for d, t in rows:
        for i in range(len(t) - least + 1):
            docs = where[t[i : i + least]]
            if len(docs) > 1:
                out.setdefault((d, t, d == min(docs)), set()).update(range(i, i + least))
    return out


def islands(marks):
    return sorted({m for m in marks if m - 1 not in marks}), sorted({m + 1 for m in marks if m + 1 not in marks})


def expected(spark, rows, least):
    from pyspark.sql import functions as F

    found = brute(rows, least)
    texts = sorted({t for _, t, _ in found})
    sig = {r["t"]: r["s"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.xxhash64("t").alias("s")).collect()} if texts else {}
    return sorted([(d, sig[t], a, b, first) for (d, t, first), marks in found.items() for a, b in zip(*islands(marks), strict=True)], key=repr)


def test_spans_equal_those_of_all_stretches(spark):
    rng = random.Random(5)
    shared = [sentence(rng, n) for n in (60, 80, 150, 45)] + ["ab" * 300, "na " * 200, "ünï\U0001f600 " * 50]
    rows = []
    for i in range(60):
        parts = [sentence(rng, rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(shared)
            cut = rng.randint(0, 30)
            parts += [p[cut : len(p) - rng.randint(0, 30)], sentence(rng, rng.randint(0, 20))]
        rows.append((i, "".join(parts)))
    rows += [(3, rows[3][1]), (3, rows[7][1]), (70, rows[5][1]), (71, rows[5][1])]
    docs = spark.createDataFrame([(d, t, None, None, None) for d, t in rows], DOCS)
    for least in (200, 150):
        assert rows_of(runindex.repeated_passages(docs, least)) == expected(spark, rows, least)


def test_cutting_leaves_the_first(spark):
    rng = random.Random(6)
    passage = sentence(rng, 80)
    a, b = sentence(rng, 30), sentence(rng, 30)
    rows = [(2, f"{a} {passage} {b}"), (1, f"{b[::-1]} {passage}"), (5, passage), (9, a)]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], DOCS)
    out = {r["doc_id"]: r for r in runindex.cut_repeats(docs).collect()}
    assert sorted(out) == [1, 2, 9]
    assert out[1]["text"] == rows[1][1] and out[9]["text"] == a
    assert passage not in out[2]["text"] and a[:20] in out[2]["text"] and out[2]["n_chars"] == len(out[2]["text"])


def test_odd_rows(spark, odd_docs, clashing_docs, no_docs, odd_rows):
    short = [(d, t) for d, t, *_ in odd_rows if t is None or len(t) < 10_000]
    some = spark.createDataFrame([r for r in odd_rows if r[1] is None or len(r[1]) < 10_000], DOCS)
    assert rows_of(runindex.repeated_passages(some)) == expected(spark, short, 200)
    whole = {(r["doc_id"], r["start"], r["stop"], r["first"]) for r in runindex.repeated_passages(odd_docs).collect()}
    long = next(len(r[1]) for r in odd_rows if r[0] == 34)
    assert (34, 0, long, True) in whole and (35, 0, long, False) in whole
    cut = runindex.cut_repeats(clashing_docs)
    assert cut.columns == clashing_docs.columns and cut.count() == len(odd_rows) - 2  # both rows of 21 are copies of 20
    assert {r["text"] for r in cut.where("doc_id = 35").collect()} == {" tail"}
    assert runindex.repeated_passages(no_docs).count() == 0 and runindex.cut_repeats(no_docs).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", min_size=1, max_size=40), min_size=1, max_size=5))
def test_index_against_sorted_suffixes(texts):
    index = runindex.RunIndex(texts)
    codes = index.codes.tolist()
    sa = sorted(range(len(codes)), key=lambda i: codes[i:])
    bwt = [codes[i - 1] for i in sa]
    heads = [p for p in range(len(sa)) if p == 0 or bwt[p] != bwt[p - 1] or bwt[p] == 0]
    assert index.heads.tolist() == heads and index.symbols.tolist() == [bwt[p] for p in heads]
    assert index.first.tolist() == [sa[p] for p in heads] and index.last.tolist() == [sa[p - 1] for p in [*heads[1:], len(sa)]]
    prior, stats = index.matching_statistics()
    left = index.left(np.arange(len(codes)))
    for a, b in zip(sa, sa[1:]):
        n = 0
        most = min(int(left[a]), int(left[b]))
        while n < most and codes[a + n] == codes[b + n]:
            n += 1
        assert stats[b] == n and (not n or prior[b] == a)
    assert stats[sa[0]] == 0
    text = texts[0]
    for pattern in {text[:3], text[-2:], "ab", "c"}:
        assert index.count(pattern) == sum(t[i:].startswith(pattern) for t in texts for i in range(len(t)))


@settings(max_examples=40, deadline=None)
@given(st.text("abcde", min_size=1, max_size=400), st.integers(0, 3))
def test_suffix_array(text, times):
    data = np.frombuffer((text * (times + 1)).encode(), np.uint8)
    assert runindex.suffix_array(data).tolist() == sorted(range(len(data)), key=lambda i: bytes(data[i:]))


def test_every_stretch_lies_in_one_window():
    rng = random.Random(8)
    text = sentence(rng, 400) + "x" * 900 + "ab" * 300
    _, _, a, b = runindex.anchors(text)
    stretches = [i for s, e in zip(a.tolist(), b.tolist(), strict=True) for i in range(s, e - runindex.MIN_CHARS + 1)]
    assert sorted(stretches) == list(range(len(text) - runindex.MIN_CHARS + 1))
    assert runindex.anchors("short") is None


def test_the_index_is_as_long_as_there_are_runs():
    rng = random.Random(14)
    base = sentence(rng, 800)
    sizes = []
    for copies in (4, 64):
        texts = [base[:k] + "!" + base[k + 1 :] for k in (rng.randrange(len(base)) for _ in range(copies))]
        index = runindex.RunIndex(texts)
        runs = len(index.heads)
        assert index.index_bytes() <= 48 * runs + 8 * copies
        sizes.append((runs, len(index.codes)))
    (few, short), (many, long) = sizes
    assert long > 15 * short and many < 3 * few and many < long / 20


def test_short_passages_and_other_identifiers(spark):
    import pytest

    rows = [(1, "one passage here, twenty odd letters"), (2, "and one passage here, twenty odd"), (3, "nothing of it")]
    docs = spark.createDataFrame([(d, t, None, None, None) for d, t in rows], DOCS)
    for least in (20, 5):
        assert rows_of(runindex.repeated_passages(docs, least)) == expected(spark, rows, least)
    with pytest.raises(TypeError):
        runindex.repeated_passages(docs.selectExpr("cast(doc_id AS string) AS doc_id", "text"))
