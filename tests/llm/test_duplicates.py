import random
import time

import numpy as np
import pytest
from helpers import sentence

from hgspark.llm import fingerprints as P
from hgspark.llm import near_duplicates as N
from hgspark.llm.common import WordHashes, words_of


def shingles(t):
    w = words_of(t) if t else []
    return {tuple(w[i : i + N.SHINGLE]) for i in range(max(1, len(w) - N.SHINGLE + 1))} if w else set()


def corpus(seed=1, families=40):
    """Base texts with copies of 0 to 8 % changed words, an own length each."""
    rng, out = random.Random(seed), []
    for f in range(families):
        base = sentence(rng, rng.randint(8, 150)).split()
        for _ in range(rng.choice([1, 2, 3, 12])):
            w = [sentence(rng, 1) if rng.random() < rng.choice([0, 0.02, 0.05, 0.08]) else x for x in base]
            out.append((len(out), " ".join(w), f))
    return out


def test_groups_reach_recall_and_do_not_mix_families(spark):
    rows = corpus()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(5)
    kept = {r.doc_id: r.kept_doc_id for r in N.near_duplicates(docs).collect()}
    root = {d: kept.get(d, d) for d, *_ in rows}
    sets = {d: shingles(t) for d, t, _ in rows}
    near = [(a, b) for a, *_ in rows for b, *_ in rows if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= N.THRESHOLD + 0.05]
    assert len(near) > 100
    assert np.mean([root[a] == root[b] for a, b in near]) >= 0.97
    family = {d: f for d, _, f in rows}
    assert all(family[a] == family[b] for a, b in kept.items())
    assert all(b < a for a, b in kept.items())


def test_trees_find_pairs_at_the_threshold(spark):
    """Recall of the tree search alone, for vectors of known agreement."""
    rng = np.random.default_rng(4)
    n, agree = 150, int(np.ceil(N.SIZE * 0.62))
    rows = []
    for i in range(n):
        a = rng.integers(0, 256, N.SIZE, dtype=np.uint8)
        b = rng.integers(0, 256, N.SIZE, dtype=np.uint8)
        same = rng.permutation(N.SIZE)[:agree]
        b[same] = a[same]
        rows += [(2 * i, bytearray(a.tobytes())), (2 * i + 1, bytearray(b.tobytes()))]
    df = spark.createDataFrame(rows, "vector long, sketch binary").repartition(4)
    got = {(r.a, r.b) for r in N.near_links(df).collect()}
    assert len(got & {(2 * i, 2 * i + 1) for i in range(n)}) / n >= 0.9
    deep = {(r.a, r.b) for r in N.near_links(df, node_rows=1, trees=4).collect()}  # every node is split further
    assert len(deep & {(2 * i, 2 * i + 1) for i in range(n)}) / n >= 0.9


@pytest.mark.parametrize("levels", [2, 8, 10])
def test_trees_keep_pairs_at_the_threshold_at_any_depth(spark, levels):
    rng = np.random.default_rng(14)
    n, agree = 300, N._needed(N.THRESHOLD)
    rows = []
    for i in range(n):
        a = rng.integers(0, 256, N.SIZE, dtype=np.uint8)
        b = a + rng.integers(1, 256, N.SIZE, dtype=np.uint8)
        same = rng.permutation(N.SIZE)[:agree]
        b[same] = a[same]
        rows += [(2 * i, bytearray(a.tobytes())), (2 * i + 1, bytearray(b.tobytes()))]
    df = spark.createDataFrame(rows, "vector long, sketch binary").repartition(4)
    got = {(r.a, r.b) for r in N.near_links(df, levels=levels).collect()}
    assert len(got & {(2 * i, 2 * i + 1) for i in range(n)}) / n >= 0.9


def roots_of(links, n):
    forest = N._Forest(n)
    for a, b in links:
        forest.join(np.array([a]), np.array([b]))
    return [forest.top(i) for i in range(n)]


@pytest.mark.parametrize("options", [{}, {"node_rows": 300}, {"node_rows": 300, "most_levels": 2}, {"node_rows": 10_000}])
def test_templates_are_grouped_whatever_the_size_of_nodes(spark, options):
    """Three templates with copies of their own, and single texts; nodes end in tasks, are split, or are cut in blocks."""
    rng = np.random.default_rng(8)
    parts = []
    for share in (0.02, 0.1, 0.2):
        base = rng.integers(0, 256, N.SIZE, dtype=np.uint8)
        copies = np.repeat(base[None], 700, axis=0)
        flip = rng.random(copies.shape) < share
        copies[flip] = rng.integers(0, 256, flip.sum(), dtype=np.uint8)
        parts.append(copies)
    sketches = np.concatenate([*parts, rng.integers(0, 256, (300, N.SIZE), dtype=np.uint8)])
    df = spark.createDataFrame([(i, bytearray(r.tobytes())) for i, r in enumerate(sketches)], "vector long, sketch binary").repartition(4)
    tops = roots_of([(r.a, r.b) for r in N.near_links(df, **options).collect()], len(sketches))
    for k in range(3):
        own = tops[700 * k : 700 * (k + 1)]
        assert max(own.count(t) for t in set(own)) >= 697
    assert len(set(tops[2100:])) == 300
    assert len(set(tops)) <= 300 + 3 * 4


def test_settling_loses_no_link():
    """Held against all pairs of a node, for clouds of several widths around the threshold."""
    rng = np.random.default_rng(21)
    for spread in (0.1, 0.2, 0.3, 0.4):
        base = rng.integers(0, 256, (2, N.SIZE), dtype=np.uint8)
        base[1, : N.SIZE // 2] = base[0, : N.SIZE // 2]
        rows = base[rng.integers(0, 2, 350)]
        flip = rng.random(rows.shape) < spread
        rows[flip] = rng.integers(0, 256, flip.sum(), dtype=np.uint8)
        rows = np.unique(np.concatenate([rows, rng.integers(0, 256, (50, N.SIZE), dtype=np.uint8)]), axis=0)
        n = len(rows)
        for heavy in (np.arange(n), np.arange(0, n, 3)):
            forest = N._Forest(n)
            left = N._settle(rows, heavy, N.THRESHOLD, forest, np.arange(n))
            agree = (rows[:, None, :] == rows[None, :, :]).sum(axis=2) >= N._needed(N.THRESHOLD)
            assert not np.isin(heavy, left).any()
            tops = np.array([forest.top(i) for i in range(n)])
            gone = ~np.isin(np.arange(n), left)
            a, b = np.nonzero(agree & (gone[:, None] | gone[None, :]))
            assert (tops[a] == tops[b]).all()
            for x, y in forest.links:  # and makes none up: links are between near texts
                assert agree[x, y]


def test_a_hundred_thousand_copies_of_a_template():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 256, N.SIZE, dtype=np.uint8)
    rows = np.repeat(base[None], 100_000, axis=0)
    flip = rng.random(rows.shape) < 0.12
    rows[flip] = rng.integers(0, 256, flip.sum(), dtype=np.uint8)
    began = time.perf_counter()
    forest = N._Forest(len(rows))
    N.join_node(rows, N.THRESHOLD, forest, np.arange(len(rows)), 7)
    assert time.perf_counter() - began < 120
    assert len(forest.links) >= 99_990


def test_large_nodes_recurse():
    """One tree's node of many near copies, and far texts among them: a tree may part a few copies from the others."""
    rng = np.random.default_rng(2)
    base = rng.integers(0, 256, N.SIZE, dtype=np.uint8)
    copies = np.repeat(base[None], 400, axis=0)
    flip = rng.random(copies.shape) < 0.1
    copies[flip] = rng.integers(0, 256, flip.sum(), dtype=np.uint8)
    far = rng.integers(0, 256, (300, N.SIZE), dtype=np.uint8)
    sketches = np.concatenate([copies, far])
    forest = N._Forest(len(sketches))
    N.join_node(sketches, N.THRESHOLD, forest, np.arange(len(sketches)), 5)
    tops = [forest.top(i) for i in range(len(sketches))]
    assert max(tops[:400].count(t) for t in set(tops[:400])) >= 390
    assert len(set(tops[400:])) == 300
    assert not set(tops[400:]) & set(tops[:400])


def test_children_choose_distinct_coordinates():
    nodes = N.mix64(np.arange(5000, dtype=np.uint64))
    sketches = np.tile(np.arange(N.SIZE, dtype=np.uint8), (5000, 1))
    row, child = N.children(nodes, sketches, 0.6)
    assert len(row) / 5000 == pytest.approx(1 / 0.6, abs=0.03)
    assert len(np.unique(child)) == len(child)


def test_components_match_union_find(spark):
    rng = random.Random(6)
    links = {(a, b) for a, b in ((rng.randrange(60), rng.randrange(60)) for _ in range(45)) if a < b} | {(i, i + 1) for i in range(100, 140)}
    root = {x: x for e in links for x in e}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((top(a), top(b)))
        root[y] = x
    got = {r.vertex: r.root for r in N.connected(spark.createDataFrame(sorted(links), "a long, b long")).collect()}
    assert got == {x: top(x) for x in root}


def test_odd_rows_of_near_duplicates(spark, odd_docs, odd_rows, no_docs):
    got = {(r.doc_id, r.kept_doc_id, r.group_size) for r in N.near_duplicates(odd_docs).collect()}
    assert got == {(2, 1, 2)}
    left = N.drop_near_duplicates(odd_docs)
    assert left.columns == odd_docs.columns
    ids = sorted((r.doc_id for r in left.collect()), key=str)
    assert ids == sorted([r[0] for r in odd_rows if r[0] != 2], key=str)
    twice = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (2, "e f g h")], "doc_id long, text string")
    assert sorted(r.doc_id for r in N.drop_near_duplicates(twice).collect()) == [1, 2]
    assert N.near_duplicates(no_docs).count() == 0
    assert N.drop_near_duplicates(no_docs).count() == 0


def test_rows_without_an_id_stay_whatever_else_repeats(spark):
    rows = [(None, "a b c d", "x"), (None, "a b c d", "x"), (5, "e f g h", "y")]
    for more in ([], [(5, "e f g h", "z")], [(5, "i j k l", "y")]):
        df = spark.createDataFrame(rows + more, "doc_id long, text string, __text_hash string")
        left = N.drop_near_duplicates(df)
        assert left.columns == df.columns
        got = sorted(((r[0], r[1]) for r in left.collect()), key=str)
        assert got == sorted({(r[0], r[1]) for r in rows + more if r[0]} | set(), key=str) + [(None, "a b c d")] * 2


def hamming(a, b):
    return ((a ^ b) & (2**64 - 1)).bit_count()


@pytest.mark.parametrize(("radius", "spare"), [(0, 1), (1, 1), (3, 2), (3, 4), (6, 2)])
def test_search_finds_all_pairs(spark, radius, spare):
    rng = random.Random(radius)
    values = set()
    for _ in range(60):
        v = rng.randrange(-(2**63), 2**63)
        values.add(v)
        for _ in range(4):
            w = v & (2**64 - 1)
            for bit in rng.sample(range(64), rng.randint(0, radius + 1)):
                w ^= 1 << bit
            values.add(w - 2**64 if w >= 2**63 else w)
    got = [(r.fingerprint_a, r.fingerprint_b, r.distance) for r in P.hamming_pairs(spark.createDataFrame([(v,) for v in values], "f long"), "f", radius, spare).collect()]
    want = {(a, b, hamming(a, b)) for a in values for b in values if a < b and hamming(a, b) <= radius}
    assert len(got) == len(set(got))
    assert set(got) == want


def test_fingerprints_match_a_plain_vote(spark):
    rng = random.Random(3)
    texts = [sentence(rng, 30), "a a a b", "", None, sentence(rng, 200)]
    rarity = np.linspace(0.5, 9, 1 << P.DF_BITS).astype(np.float32)
    hashes = WordHashes(P.SEED)
    for t, got in zip(texts, P.simhash(texts, rarity, hashes), strict=True):
        words = words_of(t) if t else []
        if not words:
            assert got is None
            continue
        votes = [0.0] * 64
        for w in set(words):
            h = hashes[w]
            weight = max(1, np.rint((1 + np.log2(words.count(w))) * rarity[h >> (64 - P.DF_BITS)] * 4))
            for b in range(64):
                votes[b] += weight if h >> b & 1 else -weight
        assert got & (2**64 - 1) == sum(1 << b for b in range(64) if votes[b] > 0)


def test_near_fingerprints_hold_every_pair_once(spark):
    rows = corpus(9, 25)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(3)
    prints = {r.doc_id: r.fingerprint for r in P.fingerprints(docs).collect()}
    want = {(a, b) for a in prints for b in prints if a < b and hamming(prints[a], prints[b]) <= P.RADIUS}
    rows = P.near_fingerprints(docs).collect()
    members = {p: [min(i for i in prints if prints[i] == p)] for p in prints.values()}
    for r in rows:
        if r.fingerprint_a == r.fingerprint_b:
            assert (r.distance, r.doc_id_a, prints[r.doc_id_b]) == (0, members[r.fingerprint_a][0], r.fingerprint_a)
            members[r.fingerprint_a].append(r.doc_id_b)
    got = [(a, b) for ids in members.values() for a in ids for b in ids if a < b]
    for r in rows:
        if r.fingerprint_a != r.fingerprint_b:
            assert (r.doc_id_a, r.doc_id_b) == (members[r.fingerprint_a][0], members[r.fingerprint_b][0])
            got += [tuple(sorted((a, b))) for a in members[r.fingerprint_a] for b in members[r.fingerprint_b]]
    assert len(got) == len(set(got))
    assert set(got) == want


def test_keys_grow_with_the_fingerprints():
    kept = [P.spare_blocks(10**k, P.RADIUS) for k in (0, 5, 8, 10, 12)]
    assert kept == sorted(kept)
    assert kept[0] == 2
    for k, spare in zip((5, 8, 10, 12), kept[1:], strict=True):
        assert 10**k / 2 ** (64 * spare // (P.RADIUS + spare)) < 20


def test_odd_rows_of_fingerprints(odd_docs, no_docs):
    rows = P.near_fingerprints(odd_docs).collect()
    assert [(r.distance, r.doc_id_a, r.doc_id_b) for r in rows] == [(0, 1, 2)]
    prints = {r.doc_id: r.fingerprint for r in P.fingerprints(odd_docs).collect()}
    assert prints[3] is prints[4] is prints[5] is prints[8] is None
    assert P.near_fingerprints(no_docs).count() == 0
