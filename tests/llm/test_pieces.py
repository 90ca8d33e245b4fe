import random

import pytest
import sentencepiece
from pyspark.sql import functions as F
from tests.llm.conftest import DOCS, rows_of, sentence

from quernstone.llm import pieces


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


def brute(codec, text):
    """Merge the best adjacent pair again and again, looking at all of them each time."""
    symbols = list(pieces.SPACE + text.replace(" ", pieces.SPACE)) if text else []
    while True:
        found = [(*codec.rank[a + b], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if a + b in codec.rank]
        if not found:
            break
        i = min(found)[2]
        symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
    return [x for s in symbols for x in ([codec.rank[s][1]] if s in codec.rank else [codec.byte_ids[b] for b in s.encode()])]


def texts():
    rng = random.Random(9)
    letters = "abcdefgh  \n\t,.éüß你好\U0001f600\x00 <>0123"
    return ["", " ", "x" * 500, "banana" * 60 + "你", "  two  spaces ", "\n\nlines\r\n", "Hello, world!"] + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(150)] + [sentence(rng, 30) for _ in range(20)]


def test_agenda_equals_brute_force_and_the_library(library):
    codec = pieces.Codec()
    all_ = texts()
    blobs, agree = codec.encode_batch(all_)
    import numpy as np

    for t, b, ok in zip(all_, blobs, agree, strict=True):
        ids = np.frombuffer(b, "<i4").tolist()
        assert ids == brute(codec, t) == library.encode(t) and ok
        assert codec.decode(ids) == codec.decode_array(np.array(ids, np.int32)) == t == library.decode(ids)


def test_rows_in_spark(spark, odd_docs, clashing_docs, no_docs, odd_rows, library):
    out = pieces.encode(odd_docs).collect()
    want = sorted(((d, None if t is None else library.encode(t)) for d, t, *_ in odd_rows), key=repr)
    assert sorted(((r["doc_id"], r["ids"]) for r in out), key=repr) == want
    for r in out:
        assert (r["n_tokens"], r["round_trip"], r["library_agrees"]) == ((None,) * 3 if r["ids"] is None else (len(r["ids"]), True, True))
    assert rows_of(pieces.encode(clashing_docs)) == rows_of(pieces.encode(odd_docs))
    assert pieces.encode(no_docs).count() == 0


def test_decoding_column(spark, odd_docs):
    back = pieces.encode(odd_docs).where("doc_id = 36").select(pieces.decode(F.col("ids")).alias("t")).first()["t"]
    assert back == odd_docs.where("doc_id = 36").first()["text"]
    none = spark.createDataFrame([(None,), ([],)], "ids array<int>").select(pieces.decode(F.col("ids")).alias("t"))
    assert rows_of(none) == [("",), (None,)]
    wrong = spark.createDataFrame([(1, [5, None]), (2, [-1]), (3, [999_999, 5]), (4, [32_000_000]), (5, [5])], "n int, ids array<int>").select("n", pieces.decode(F.col("ids")).alias("t")).collect()
    assert {r["n"]: r["t"] is None for r in wrong} == {1: True, 2: True, 3: True, 4: True, 5: False}


def test_round_trips_decode_only_texts_that_differ(monkeypatch):
    import numpy as np

    codec = pieces.Codec()

    def check(all_, blobs, want):
        offsets = np.r_[0, np.cumsum([len(b or b"") // 4 for b in blobs])].astype(np.int32)
        assert codec.round_trips(all_, np.frombuffer(b"".join(b or b"" for b in blobs), "<i4"), offsets) == want

    odd = ["\u2581", "a \u2581b", "\ufffd", None, "", "\ud800", " \u2581 "]
    blobs = codec.encode_batch([t for t in odd if t != "\ud800"])[0]
    blobs.insert(odd.index("\ud800"), codec.encode_batch(["?"])[0][0])
    check(odd, blobs, [None if t is None else codec.decode_array(np.frombuffer(b, "<i4")) == t for t, b in zip(odd, blobs, strict=True)])
    good = ["one text", None, "", "other words", "ünïcödé \U0001f600"]
    blobs = codec.encode_batch(good)[0]
    blobs[0], blobs[3] = blobs[3], blobs[0]
    check(good, blobs, [False, None, True, False, True])
    byte = np.array([codec.byte_ids[b] for b in b"\xff"], "<i4").tobytes()
    check(["\ufffd", "\ufffdx"], [byte, byte], [True, False])
    check([None, None], [None, None], [None, None])

    def alone(self, ids):
        raise AssertionError("a text that comes back was decoded alone")

    monkeypatch.setattr(pieces.Codec, "decode_array", alone)
    all_ = texts()
    check(all_, codec.encode_batch(all_)[0], [True] * len(all_))


def test_a_wrong_split_is_noticed():
    codec = pieces.Codec()
    codec.split = lambda t: [t[:7], t[7:]]
    blobs, agree = codec.encode_batch(["a wonderful day", None, "hi", ""])
    assert agree == [False, None, True, True]


def test_lanes_equal_single_agendas():
    codec = pieces.Codec()
    rng = random.Random(11)
    segments = ["▁" + "".join(rng.choice("aabcdeinorst▁你q") for _ in range(rng.randint(0, 80))) for _ in range(3000)]
    assert codec.merge_all(segments) == [codec.merge(s) for s in segments]
    for s in segments[:300]:
        assert codec.merge(s) == brute(codec, s[1:].replace("▁", " ")) or not s[1:]


def test_worker_memory_turns_over(monkeypatch):
    monkeypatch.setattr(pieces, "HELD", 20)
    codec = pieces.Codec()
    all_ = texts()
    for at in range(0, len(all_), 7):
        assert codec.encode_batch(all_[at : at + 7])[0] == pieces.Codec().encode_batch(all_[at : at + 7])[0]


def test_cuts_equal_the_rule_of_one_text():
    import pyarrow as pa

    codec = pieces.Codec()
    all_ = [None, "", " ", "   ", "\n", " \n ", "\n\n a  b\r\n\tc ", "\u2581", "a\u2581 \u2581b", "x", "你 好\u2028\U0001f600  \x00", "", None, *texts()]
    for some in (all_, all_[:3], [], [None], ["", ""]):
        segments, first = codec.cut(pa.array(some, pa.string()))
        got = [[s.decode().replace(" ", pieces.SPACE) for s in segments.slice(a, b - a).to_pylist()] for a, b in zip(first[:-1], first[1:])]
        assert got == [codec.rule(pieces.SPACE + t.replace(" ", pieces.SPACE)) if t else [] for t in some]
        part = pa.array([*all_[:5], *some], pa.string()).slice(5)
        assert [x.tolist() if hasattr(x, "tolist") else x for x in codec.encode_column(part)] == [x.tolist() if hasattr(x, "tolist") else x for x in codec.encode_column(pa.array(some, pa.string()))]


def test_segments_of_a_task_are_merged_once(monkeypatch):
    codec = pieces.Codec()
    monkeypatch.setattr(codec.library, "encode", lambda texts, **_: [[]] * len(texts), raising=False)
    batches = [[" ".join(f"w{i:x}" for i in range(k, k + 1000)) for k in range(at, at + 50_000, 1000)] for at in range(0, 250_000, 50_000)]
    first = [codec.encode_batch(b)[0] for b in batches]

    def again(self, left, right):
        raise AssertionError("a segment was merged again")

    monkeypatch.setattr(pieces._PairTable, "find", again)
    assert [codec.encode_batch(b)[0] for b in batches] == first


def test_nulls_beyond_the_first_slice(spark, library):
    rows = [(i, None if i % 7 == 3 else "" if i % 7 == 4 else f"text {i} of\n many") for i in range(1203)]
    out = pieces.encode(spark.createDataFrame(rows, "doc_id int, text string").coalesce(1)).collect()
    want = {i: None if t is None else library.encode(t) for i, t in rows}
    assert {r["doc_id"]: r["ids"] for r in out} == want and len(out) == len(rows)
    for r in out:
        assert (r["n_tokens"], r["round_trip"], r["library_agrees"]) == ((None,) * 3 if r["ids"] is None else (len(r["ids"]), True, True))


def test_other_models_are_refused(tmp_path):
    with pytest.raises(Exception):  # noqa: B017
        pieces.Codec(str(tmp_path / "none.model"))
