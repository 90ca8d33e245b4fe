import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tests.llm.conftest import DOCS

from quernstone.llm import sstable


def build(entries, block=256):
    b = sstable.ShardBuilder(block)
    out = []
    for k, v in entries:
        if row := b.add(k, v):
            out.append(row)
    out += list(b.finish())
    assert [r[2] for r in out] == [sum(len(x[-1]) for x in out[:i]) for i in range(len(out))]
    return b"".join(r[-1] for r in out)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.binary(max_size=6), st.binary(max_size=40)), min_size=1, max_size=120), st.lists(st.binary(max_size=6), max_size=20))
def test_lookup_equals_a_dictionary(pairs, others):
    pairs.sort()
    reader = sstable.ShardReader(build(pairs))
    want = {}
    for k, v in pairs:
        want.setdefault(k, []).append(v)
    assert list(reader.scan()) == pairs and reader.count == len(pairs)
    for k in [*want, *others]:
        assert reader.get_all(k) == want.get(k, [])
        assert reader.get(k) == (want[k][0] if k in want else None)
        assert k not in want or reader.may_contain(k)


def test_bloom_filter_and_damage():
    data = build([(sstable.encode_key(i), b"v%d" % i) for i in range(2000)])
    reader = sstable.ShardReader(data)
    assert sum(reader.may_contain(sstable.encode_key(i)) for i in range(10_000, 30_000)) < 600
    bad = bytearray(data)
    bad[reader.places[3][0] + 10] ^= 1
    broken = sstable.ShardReader(bytes(bad))
    with pytest.raises(ValueError, match="damaged"):
        list(broken.scan())
    with pytest.raises(ValueError, match="order"):
        build([(b"b", b""), (b"a", b"")])


@given(st.lists(st.integers(-(2**63), 2**63 - 1), min_size=2, max_size=20))
def test_integer_keys_keep_their_order(values):
    assert [sstable.decode_int_key(k) for k in sorted(map(sstable.encode_key, values))] == sorted(values)


def read_back(shards):
    files = {}
    for r in shards.orderBy("shard", "file_offset").collect():
        assert r["file_offset"] == len(files.get(r["shard"], b""))
        files[r["shard"]] = files.get(r["shard"], b"") + r["payload"]
    return {k: sstable.ShardReader(v) for k, v in files.items()}


def test_shards_hold_every_document(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    readers = read_back(sstable.build_shards(docs, block_bytes=4096))
    found = [(sstable.decode_int_key(k), sstable.decode_value(v)) for _, r in sorted(readers.items()) for k, v in r.scan()]
    assert found == sorted((r["doc_id"], r["text"]) for r in docs.collect())
    assert all(len(r.places) > 1 for r in readers.values())


def test_odd_rows(spark, odd_docs, clashing_docs, no_docs, odd_rows):
    for docs in (odd_docs, clashing_docs):
        readers = read_back(sstable.build_shards(docs))
        want = {}
        for d, t, *_ in odd_rows:
            if d is not None:
                want.setdefault(d, []).append(t)
        for d, texts in want.items():
            got = [sstable.decode_value(v) for r in readers.values() for v in r.get_all(sstable.encode_key(d))]
            assert got == sorted(texts, key=lambda t: (t is not None, t or ""))
    assert sstable.build_shards(no_docs).count() == 0


def test_files_and_token_ids(spark, tmp_path):
    docs = spark.createDataFrame([(f"key{i % 50}", list(range(i))) for i in range(100)] + [("none", None)], "name string, ids array<int>")
    manifest = sstable.write_shards(docs, str(tmp_path / "out"), "name", "ids").collect()
    assert sum(m["entries"] for m in manifest) == 101 and sorted(os.listdir(tmp_path / "out")) == sorted(m["file"] for m in manifest)
    readers = [sstable.ShardReader((tmp_path / "out" / m["file"]).read_bytes()) for m in manifest]
    get = lambda k: [sstable.decode_value(v, "ids") for r in readers for v in r.get_all(sstable.encode_key(k))]
    assert sorted(get("key7")) == [list(range(7)), list(range(57))] and get("none") == [None] and get("absent") == []


def test_other_keys_are_refused(spark):
    for key in (1.2, True, None):
        with pytest.raises(TypeError):
            sstable.encode_key(key)
    with pytest.raises(TypeError):
        sstable.build_shards(spark.createDataFrame([(1.2, "a"), (1.7, "b")], "doc_id double, text string"))


def test_a_large_shard_keeps_16_bytes_a_key():
    b = sstable.ShardBuilder(1 << 30)
    for i in range(100_000):
        b.add(sstable.encode_key(i), b"")
    assert len(b.hashes) == 1_600_000
    data = b"".join(r[-1] for r in b.finish())
    reader = sstable.ShardReader(data)
    assert all(reader.may_contain(sstable.encode_key(i)) for i in range(0, 100_000, 997))
    assert sum(reader.may_contain(sstable.encode_key(i)) for i in range(200_000, 205_000)) < 150
