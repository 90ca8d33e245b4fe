import random
from collections import defaultdict

import numpy as np
from tests.llm.conftest import DOCS, rows_of, sentence

from quernstone.llm import groups as groups_module
from quernstone.llm import simhash
from quernstone.llm.components import connected_components


def brute_groups(rows, threshold):
    """Components of all pairs within the threshold, from every pair's distance."""
    prints = {}
    for doc, text in rows:
        p = simhash.fingerprints([text])[0]
        if doc is not None and p is not None:
            prints[doc] = min(prints.get(doc, p), p)
    ids = sorted(prints)
    x = np.frombuffer(b"".join(prints[i] for i in ids), np.uint8).reshape(len(ids), -1)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, i in enumerate(ids):
        for j in np.flatnonzero(np.bitwise_count(x ^ x[k]).sum(axis=1, dtype=int) <= threshold):
            a, b = find(i), find(ids[j])
            root[max(a, b)] = min(a, b)
    return sorted((i, find(i), int(np.bitwise_count(x[ids.index(i)] ^ x[ids.index(find(i))]).sum())) for i in ids if find(i) != i)


def corpus(seed=1):
    rng = random.Random(seed)
    rows, n = [], 0
    for group in range(25):
        words = sentence(rng, rng.randint(40, 200)).split()
        for _ in range(rng.choice([1, 2, 3, 12])):
            copy = list(words)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = sentence(rng, 1)
            rows.append((n, " ".join(copy)))
            n += 1
    rng.shuffle(rows)
    return rows


def test_groups_equal_those_of_all_pairs(spark):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], DOCS)
    assert rows_of(simhash.near_duplicate_groups(docs)) == sorted(brute_groups(rows, simhash.THRESHOLD), key=repr)


def test_fingerprint_is_the_sign_of_word_sums():
    a, b = simhash.fingerprints(["one two three one", "three  ONE, two"])
    assert a == b and len(a) == simhash.BITS // 8
    assert simhash.fingerprints([None, "", " ?! "]) == [None, None, None]
    many = simhash.fingerprints([f"w{i} x y" for i in range(700)])
    assert many == [simhash.fingerprints([f"w{i} x y"])[0] for i in range(700)]


def test_pairs_within_the_guaranteed_bits_always_share_a_key():
    rng = np.random.default_rng(2)
    one = rng.integers(0, 256, (200, simhash.BITS // 8), dtype=np.uint8)
    flips = np.zeros((200, simhash.BITS), np.uint8)
    for row in flips[:100]:
        row[rng.choice(simhash.BITS, simhash.GUARANTEED, replace=False)] = 1
    for row in flips[100:]:
        # the worst case: three blocks of every word but one are hit once
        for w in range(simhash.WORDS):
            hit = rng.choice(simhash.BLOCKS, 3 if w != 7 else 2, replace=False)
            row[(w * simhash.BLOCKS + hit) * 8 + rng.integers(0, 8, len(hit))] = 1
    assert simhash.GUARANTEED == 71 and set(flips.sum(axis=1).tolist()) == {71}
    a, b = simhash.keys(one), simhash.keys(one ^ np.packbits(flips, axis=1))
    assert a.shape[1] == 240 and (a == b).any(axis=1).all()


def planted_prints(rng):
    """60 rows, and 60 that differ from them in the threshold's bits, every fourth in one more."""
    one = rng.integers(0, 256, (60, simhash.BITS // 8), dtype=np.uint8)
    flips = np.zeros((60, simhash.BITS), np.uint8)
    for k, row in enumerate(flips):
        # ten bits of each of the first words, so that the others keep a key
        row[rng.choice(40 * 18, simhash.THRESHOLD + (k % 4 == 0), replace=False)] = 1
    rows = np.concatenate([one, one ^ np.packbits(flips, axis=1)]).view(np.uint64)
    return rows, [k if k < 60 or (k - 60) % 4 == 0 else k - 60 for k in range(120)]


def test_tiles_link_every_pair_within_the_threshold():
    rows, want = planted_prints(np.random.default_rng(6))
    assert simhash.tile_components(rows, np.zeros(120, int), simhash.THRESHOLD).tolist() == want
    assert simhash.tile_components(rows, np.repeat([0, 1], 60), simhash.THRESHOLD).tolist() == want


def test_a_hot_key_of_different_documents_is_cut_into_tiles(spark, monkeypatch):
    rows, want = planted_prints(np.random.default_rng(6))
    rows.view(np.uint8)[:, 115:] = 7  # the last word's five blocks are the same in all
    monkeypatch.setattr(simhash, "TILE", 10)
    texts = {f"t{k}": rows[k].tobytes() for k in range(120)}
    monkeypatch.setattr(simhash, "_fingerprint_udf", lambda: simhash.F.udf(lambda t: (texts[t], 9), "print binary, words int"))
    docs = spark.createDataFrame([(k, f"t{k}") for k in range(120)], "doc_id long, text string")
    found = sorted(tuple(r) for r in simhash.near_duplicate_groups(docs).collect())
    assert found == [(k, want[k], simhash.THRESHOLD) for k in range(120) if want[k] != k]


def test_identifiers_of_any_type_and_rows_of_one_identifier(spark):
    rng = random.Random(8)
    a, b, c = (sentence(rng, 60) for _ in range(3))
    docs = spark.createDataFrame([("x", a), ("y", a + " end"), ("z", b), ("z", a), ("w", c)], "doc_id string, text string")
    assert {(r.doc_id, r.kept_doc_id) for r in simhash.near_duplicate_groups(docs).collect()} == {("y", "x"), ("z", "x")}
    assert sorted((r.doc_id, r.text) for r in simhash.drop_near_duplicates(docs).collect()) == sorted([("x", a), ("z", b), ("w", c)])


def test_sizes_far_apart_do_not_meet():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4, 5, 6], pa.int64()), pa.array([7] * 5 + [8], pa.int32()), pa.array([n << 48 for n in (4, 7, 12, 22, 23, 23)], pa.int64())], names=["v", "key", "mark"])
    rows = [r for out in groups_module.members_of_keys(iter([batch])) for r in zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True)]
    assert sorted(v for _, v in rows) == [1, 2, 3, 4, 5] and len({g for g, _ in rows}) == 2


def test_samples_far_apart_go():
    import pyarrow as pa

    far = (1 << 20) - 1
    marks = [(1 << 48) + x for x in (0, far >> 1, 0, far, 0, far, 1, 5, 5 ^ far << 28)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(9), pa.int64()), pa.array([1, 1, 2, 2, 3, 3, 3, 4, 4], pa.int32()), pa.array(marks, pa.int64())], names=["v", "key", "mark"])
    rows = [r for out in groups_module.members_of_keys(iter([batch])) for r in zip(out.column(2).to_pylist(), out.column(1).to_pylist(), strict=True)]
    assert sorted(rows) == [(1, 0), (1, 1), (3, 4), (3, 5), (3, 6)]


def test_chinese_copies(spark):
    rng = random.Random(9)
    one, other = ("".join(chr(rng.randrange(0x4E00, 0x5E00)) for _ in range(300)) for _ in range(2))
    docs = spark.createDataFrame([(1, one), (2, one[:100] + "\u4e01" + one[101:]), (3, other)], "doc_id long, text string")
    assert [(r.doc_id, r.kept_doc_id) for r in simhash.near_duplicate_groups(docs).collect()] == [(2, 1)]


def test_odd_rows(odd_docs, clashing_docs, no_docs, odd_rows):
    expected = sorted(brute_groups([r[:2] for r in odd_rows], simhash.THRESHOLD), key=repr)
    assert rows_of(simhash.near_duplicate_groups(odd_docs)) == expected
    assert (21, 20) in {r[:2] for r in expected} or (20, 20) not in expected
    assert (35, 34) in {r[:2] for r in expected}
    gone = {r[0] for r in expected}
    assert rows_of(simhash.drop_near_duplicates(odd_docs)) == sorted((r for r in odd_rows if r[0] not in gone), key=repr)
    kept = simhash.drop_near_duplicates(clashing_docs)
    assert kept.columns == clashing_docs.columns
    assert kept.count() == len([r for r in odd_rows if r[0] not in gone])
    assert simhash.near_duplicate_groups(no_docs).count() == 0 and simhash.drop_near_duplicates(no_docs).count() == 0


def test_a_hot_block_of_thousands_of_copies(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "'the very same text in each of them' AS text", "'en' AS lang", "'s' AS source", "35 AS n_chars")
    found = simhash.near_duplicate_groups(docs)
    assert found.count() == 2999 and found.where("kept_doc_id <> 0 OR hamming <> 0").count() == 0


def test_components_of_paths_and_stars(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(50)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(7, 7)]
    root = defaultdict(lambda: None)

    def find(i):
        while root[i] not in (None, i):
            i = root[i]
        return i

    for u, v in edges:
        a, b = find(u), find(v)
        root[max(a, b)], root[min(a, b)] = min(a, b), min(a, b)
    linked = {x for u, v in edges if u != v for x in (u, v)}
    got = {r["id"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: find(i) for i in linked}


def test_keys_of_many_members_stream_by(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(groups_module, "LONG", 50)
    rng = random.Random(5)
    by_key = {k: sorted(rng.sample(range(1000), n)) for k, n in enumerate([1, 2, 30, 200, 3, 49, 120, 1, 51, 7])}
    by_key[20], by_key[21] = by_key[2], by_key[9]
    flat = [(v, k) for k in sorted(by_key) for v in by_key[k]]
    for step in (1, 7, 64, 10_000):
        batches = [pa.RecordBatch.from_arrays([pa.array([v for v, _ in flat[i : i + step]], pa.int64()), pa.array([k for _, k in flat[i : i + step]], pa.int32()), pa.array([1 << 48] * len(flat[i : i + step]), pa.int64())], names=["v", "key", "mark"]) for i in range(0, len(flat), step)]
        groups = defaultdict(set)
        for out in groups_module.members_of_keys(iter(batches)):
            for g, v in zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True):
                groups[g].add(v)
        assert {frozenset(g) for g in groups.values()} == {frozenset(m) for m in by_key.values() if len(m) > 1}


def spread_prints(rng, n, bits):
    """n rows, and n that differ from them in so many bits that lie as evenly over the segments as can be."""
    one = rng.integers(0, 256, (n, simhash.BITS // 8), dtype=np.uint8)
    flips = np.zeros((n, simhash.BITS), np.uint8)
    for row in flips:
        for k, segment in enumerate(rng.permutation(simhash.SEGMENTS)):
            row[segment * simhash.SEGMENT_BITS + rng.choice(simhash.SEGMENT_BITS, bits // simhash.SEGMENTS + (k < bits % simhash.SEGMENTS), replace=False)] = 1
    return np.concatenate([one, one ^ np.packbits(flips, axis=1)])


def test_pairs_at_the_threshold_without_a_key_and_of_sizes_far_apart(spark, monkeypatch):
    rows = spread_prints(np.random.default_rng(3), 40, simhash.THRESHOLD)
    a, b = simhash.keys(rows[:40]), simhash.keys(rows[40:])
    assert not (a == b).any(axis=1).all()
    texts = {f"t{k}": (rows[k].tobytes(), 9 if k < 40 else 90) for k in range(80)}
    monkeypatch.setattr(simhash, "_fingerprint_udf", lambda: simhash.F.udf(lambda t: texts[t], "print binary, words int"))
    docs = spark.createDataFrame([(k, f"t{k}") for k in range(80)], "doc_id long, text string")
    for tile, start in ((2048, 2), (10, 2), (2048, 0)):
        monkeypatch.setattr(simhash, "TILE", tile)
        monkeypatch.setattr(simhash, "FROM", start)
        assert sorted(tuple(r) for r in simhash.near_duplicate_groups(docs).collect()) == [(40 + k, k, simhash.THRESHOLD) for k in range(40)]


def test_the_index_links_what_products_link():
    rng = np.random.default_rng(4)
    rows = np.concatenate([spread_prints(rng, 50, bits) for bits in (1, 90, 143, 144, 145)])
    rows[3] = rows[4] ^ 1
    rows = np.concatenate([rows, np.repeat(rows[:1], 30, axis=0)])
    rows[-29:, 7] ^= np.arange(29, dtype=np.uint8)
    rows = rows.view(np.uint64)[rng.permutation(len(rows))]
    for threshold in (20, simhash.THRESHOLD):
        alone = np.zeros(len(rows), int)
        assert simhash.indexed_components(rows, alone, threshold).tolist() == simhash.tile_components(rows, alone, threshold).tolist()
    sides = np.repeat([0, 1], len(rows) // 2)
    linked = simhash.indexed_components(rows, sides, simhash.THRESHOLD)
    near = np.bitwise_count(rows[:, None] ^ rows[None]).sum(axis=2) <= simhash.THRESHOLD
    i, j = np.nonzero(near & (sides[:, None] < sides))
    assert len(i) > 50 and (linked[i] == linked[j]).all()
    i = np.arange(len(rows))
    assert (simhash.tile_components(rows, alone, simhash.THRESHOLD)[i] == simhash.tile_components(rows, alone, simhash.THRESHOLD)[linked]).all()
    assert sum(r + 1 for r in simhash.radii(simhash.THRESHOLD)) == simhash.THRESHOLD + 1
