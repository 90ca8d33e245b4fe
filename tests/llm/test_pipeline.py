"""The pipeline, stage by stage against brute force, and the registered queries."""

import random
import re

import numpy as np
import pytest
import sentencepiece
from tests.llm.conftest import DOCS, CLASHES, rows_of, sentence
from tests.llm.test_mixture import brute as brute_mixture
from tests.llm.test_runindex import brute as brute_repeats
from tests.llm.test_runindex import islands
from tests.llm.test_simhash import brute_groups

import __spark_entry__
import corpus_pipeline
from quernstone.llm import pieces, ppm, queries, simhash


@pytest.fixture(scope="module")
def corpus(spark, sf):
    """Documents of the driver's table with copies, a shared passage and odd rows among them."""
    rng = random.Random(12)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    passage = rows[0][1][:600] if len(rows[0][1]) > 600 else sentence(rng, 90)
    n = max(r[0] for r in rows)
    rows += [(n + 1 + k, r[1], *r[2:]) for k, r in enumerate(rows[10:20])]
    rows += [(n + 50 + k, f"{sentence(rng, 40)} {passage} {sentence(rng, 40)}", "en", "src1", 0) for k in range(5)]
    rows += [(n + 90, None, "en", "src1", None), (n + 91, "", "en", "src1", 0), (None, rows[3][1], "de", None, 5)]
    return rows


def test_stages_equal_brute_force(spark, corpus, sf, tmp_path):
    docs = spark.createDataFrame(corpus, DOCS)
    stages = corpus_pipeline.STAGES
    assert [n for n, _ in stages] == ["language_id", "simhash_near_dedup", "repeated_passages", "source_mixture", "sentencepiece"]

    def reread(k, df):
        df.write.parquet(str(tmp_path / str(k)))
        return spark.read.parquet(str(tmp_path / str(k)))

    one = reread(1, stages[0][1](spark, docs, sf))
    model = ppm.fit(ppm.sample(docs))
    bits = model.score([(r[1] or "").encode() for r in corpus])
    want = [r for r, b in zip(corpus, bits, strict=True) if r[1] and b.min() / len(r[1].encode()) <= ppm.REJECT_ABOVE]
    assert one.columns == docs.columns and rows_of(one) == sorted(want, key=repr)

    two = reread(2, stages[1][1](spark, one, sf))
    gone = {d for d, *_ in brute_groups([r[:2] for r in want], simhash.THRESHOLD)}
    want = [r for r in want if r[0] not in gone]
    assert two.columns == docs.columns and rows_of(two) == sorted(want, key=repr)

    three = reread(3, stages[2][1](spark, two, sf))
    marks = brute_repeats([r[:2] for r in want], 200)
    cut = []
    for d, t, *rest in want:
        own = marks.get((d, t, False), set())
        new = "".join(c for i, c in enumerate(t) if i not in own)
        if not own:
            cut.append((d, t, *rest))
        elif re.search(r"\S", new):
            cut.append((d, new, *rest[:2], len(new)))
    assert three.columns == docs.columns and rows_of(three) == sorted(cut, key=repr)

    four = reread(4, stages[3][1](spark, three, sf))
    taken = {(d, la, s): c for d, _, la, s, _, c in brute_mixture([r[:4] for r in cut])}
    mixed = [r for r in cut for _ in range(taken.get((r[0], r[2] or "", r[3] or ""), 0))]
    assert four.columns == docs.columns and rows_of(four) == sorted(mixed, key=repr)

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    five = stages[4][1](spark, four, sf).collect()
    assert sorted(((r["doc_id"], r["ids"]) for r in five), key=repr) == sorted(((r[0], library.encode(r[1])) for r in mixed), key=repr)
    assert all(r["library_agrees"] and r["round_trip"] for r in five)


def test_run_writes_its_stages(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "ids", "n_tokens", "round_trip", "library_agrees"] and out.count() > 0


def test_clashing_and_empty_tables(spark, corpus, sf):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(corpus[:40] + corpus[-8:], DOCS).select("*", *[F.lit("x").alias(c) for c in CLASHES])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        out.count()
        assert stage(spark, docs.limit(0), sf).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), sf).count() == 0


def test_every_operator_has_one_query():
    names = [n for n in __spark_entry__.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and set(names) == set(queries.QUERIES)
    assert "pipeline" in __spark_entry__.queries()


def test_near_dedup_stage_has_no_cut_by_size_or_sample(spark, sf, monkeypatch):
    """Pairs within the threshold whose sizes are 10 to 1 apart, and such that differ in 24 of any key's 48 sampled bits."""
    rng = np.random.default_rng(5)
    one = rng.integers(0, 256, (20, simhash.BITS // 8), dtype=np.uint8)
    other = one.copy()
    other[:10, 7] ^= 1
    other[10:, np.arange(6) * 20 + np.arange(6) % simhash.BLOCKS] ^= 15
    prints = {f"t{k}": (p.tobytes(), 9 if k < 20 or k >= 30 else 90) for k, p in enumerate(np.concatenate([one, other]))}
    monkeypatch.setattr(simhash, "_fingerprint_udf", lambda: simhash.F.udf(lambda t: prints[t], "print binary, words int"))
    docs = spark.createDataFrame([(k, f"t{k}", "en", "s", 2) for k in range(40)], DOCS)
    kept = dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs, sf)
    assert sorted(r.doc_id for r in kept.collect()) == list(range(20))
