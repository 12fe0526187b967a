import random

import numpy as np

from volatide.llm import neardup


def brute(rows, words, percent):
    """Components by comparing every pair of sets of words."""
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[find(i)] = find(j)
    heads = {}
    for i, (d, _) in enumerate(rows):
        heads.setdefault(find(i), []).append(d)
    return [(d, len(s), min(heads[find(i)])) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


def check(spark, rows, words, percent):
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words, percent).collect()
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found)
    assert got == sorted(brute(rows, words, percent))
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)


def edited(rng, words, share):
    return " ".join("x%d" % rng.randrange(10**6) if rng.random() < share else w for w in words)


def test_groups_of_near_copies(spark):
    rng = random.Random(4)
    rows, at = [], 0
    for size, share in ((420, 0.02), (40, 0.01), (30, 0.03), (25, 0.0)):
        base = ["w%d" % rng.randrange(5000) for _ in range(120)]
        for _ in range(size):
            rows.append((at, edited(rng, base, rng.random() * 2 * share)))
            at += 1
    rows += [(at + i, " ".join("w%d" % rng.randrange(5000) for _ in range(rng.randrange(1, 80)))) for i in range(100)]
    rng.shuffle(rows)
    check(spark, rows, 3, 85)


def test_odd_texts(spark):
    rows = [(9, None), (8, ""), (7, " \t\n"), (6, "one"), (5, "ONE"), (4, "one two"), (3, "One\ttwo "), (2, "one two three"), (1, "é È"), (0, "é è"), (10, "long word " * 30_000), (11, "long word " * 30_000 + "end"), (12, "one two three")]
    check(spark, rows, 3, 85)


def test_repeated_rows_null_ids_and_empty_tables(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (None, "q r s t"), (2, "a b c d")]
    df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, node string")
    found = neardup.near_duplicates(df, 3, 85).collect()
    assert sorted((r["component_id"] is None, r["kept"]) for r in found) == [(False, False), (False, False), (False, True), (False, True), (True, True)]
    assert neardup.near_duplicates(df.where("1 = 0")).count() == 0


def test_large_buckets_are_split_into_units(spark, monkeypatch):
    monkeypatch.setattr(neardup, "CHUNK", 16)
    rng = random.Random(6)
    base = ["w%d" % rng.randrange(5000) for _ in range(100)]
    check(spark, [(i, edited(rng, base, rng.random() * 0.05)) for i in range(150)], 3, 85)


def test_whole_sketches_never_exceed_the_difference():
    rng = np.random.default_rng(2)
    for _ in range(200):
        a, b = (np.unique(rng.integers(0, 400, rng.integers(1, 300)).astype(np.uint64)) for _ in range(2))
        x, y = (np.frombuffer(neardup.whole_sketch(neardup._mixed(s)), np.uint64) for s in (a, b))
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


def test_sampled_sketches_rule_out_no_pair_at_the_threshold():
    rng = np.random.default_rng(7)
    far = 0
    for _ in range(8000):  # Jaccard 85 / 100
        s = rng.integers(0, 2**64, 100, np.uint64)
        a, b = (np.frombuffer(neardup.odd_sketch(neardup.minhash(x)), np.uint64) for x in (s[:92], np.append(s[:85], s[92:])))
        far += np.bitwise_count(a ^ b).sum() > neardup.most_bits(85)
    assert far == 0 and neardup.most_bits(100) == 0


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(100, 140)]
    labels = {r["node"]: r["label"] for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert labels == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 140: 100}


def test_a_row_without_an_id_links_others(spark):
    words = ["w%d" % i for i in range(40)]
    texts = [" ".join(words), " ".join([*words[:37], "x", "y"]), " ".join([*words[3:37], "x", "y"])]
    both = [spark.createDataFrame([(1, texts[0]), (middle, texts[1]), (2, texts[2])], "doc_id long, text string") for middle in (3, None)]
    for df in both:
        found = neardup.near_duplicates(df, 3, 85).collect()
        assert [r["component_id"] for r in found] == [1, 1, 1]
    apart = neardup.near_duplicates(both[0].where("doc_id < 3"), 3, 85).collect()
    assert sorted(r["component_id"] for r in apart) == [1, 2]


def test_links_at_the_threshold_are_kept(spark):
    """Pairs of 100 shingles that share exactly 85 (linked) or 84 (not), and chains that only such a link joins."""
    rng, rows = random.Random(12), []
    for at in range(300):
        base = ["p%dx%d" % (at, rng.randrange(10**9)) for _ in range(94)]
        rows.append((2 * at, " ".join(base)))
        rows.append((2 * at + 1, " ".join([*base[: 87 - at % 2], *("q%dx%d" % (at, rng.randrange(10**9)) for _ in range(8))])))
    check(spark, rows, 3, 85)


def test_large_mixed_buckets_lose_no_link(spark, monkeypatch):
    """One band for all texts: a large group, small groups and single texts meet in one bucket."""
    monkeypatch.setattr(neardup, "CHUNK", 12)
    monkeypatch.setattr(neardup, "layout", lambda percent: (2, 0))
    rng, rows = random.Random(8), []
    for size, share in ((70, 0.02), (9, 0.02), (3, 0.02), (2, 0.03), *((1, 0),) * 25):
        base = ["w%d" % rng.randrange(5000) for _ in range(90)]
        rows += [(0, edited(rng, base, rng.random() * share)) for _ in range(size)]
    order = list(range(len(rows)))
    rng.shuffle(order)
    check(spark, [(i, t) for i, (_, t) in zip(order, rows, strict=True)], 3, 85)
