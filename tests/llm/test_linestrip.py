import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from volatide.llm import linestrip


def brute(rows, batches, min_docs, min_chars):
    """(doc_id, batch, n_all, n_removed, kept) of every row and (digest, batch, n_all, n_removed) of every key that lost lines."""
    def key_of(line):
        key = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
        return key if len(key) >= min_chars else None

    held, docs, lost = Counter(), [], {}
    for n in range(batches):
        earlier = Counter(held)
        for doc_id, text, batch in rows:
            if (batch or 0) != n:
                continue
            lines = (text or "").split("\n")
            kept = []
            for line in lines:
                key = key_of(line)
                if key is not None and earlier[key] >= min_docs:
                    lost.setdefault(key, [n, 0])[1] += 1
                else:
                    kept.append(line)
            held.update({k for k in map(key_of, lines) if k is not None})
            docs.append((doc_id, n, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(docs, key=str), {(hashlib.sha256(k.encode()).digest(), first, held[k], n) for k, (first, n) in lost.items()}


def corpus(seed, batches, last_empty):
    rng = random.Random(seed)
    pool = ["All rights reserved", "  all RIGHTS reserved\t", "Straße  ÄÖ line", "straße  Äö line", "short", "", "x" * 10, "\x0b" + "x" * 10 + "\r", "x" * 9, "Zwölf böse Boxkämpfer", " " * 10]
    rows = [(None, "All rights reserved\nmine", 0), (1, None, None), (1, "", 1), (2, "\n\n", 1), (3, "All rights reserved", batches - 1 - last_empty), (3, "All rights reserved", batches - 1 - last_empty)]
    for i in range(60):
        lines = rng.choices(pool, k=rng.randint(0, 6)) + ([f"line of its own {i}"] if rng.random() < 0.5 else [])
        rows.append((i, "\n".join(lines), rng.randrange(batches - last_empty)))
    return rows + [(99, "All rights reserved\nAll rights reserved\n" + "long " * 50_000, 1)]


@pytest.mark.parametrize("last_empty", [False, True])
def test_matches_brute_force(spark, last_empty):
    rows = corpus(3 + last_empty, 4, last_empty)
    docs = spark.createDataFrame([(*r, "row", True) for r in rows], "doc_id long, text string, n int, row string, closing boolean").repartition(3)
    found = linestrip.strip_seen_lines(docs, F.col("n"), batches=4, min_docs=3)
    want_docs, want_lines = brute(rows, 4, 3, 10)
    assert sorted((tuple(r) for r in found.docs.select("doc_id", "batch", "n_all", "n_removed", "kept").collect()), key=str) == want_docs
    got = [tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in found.lines.collect()]
    assert set(got) == want_lines and len(got) == len(want_lines) > 2


def test_empty_table_and_bad_numbers(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    found = linestrip.strip_seen_lines(empty, F.lit(0), batches=2)
    assert found.docs.count() == 0 and found.lines.count() == 0
    with pytest.raises(Exception, match="out of range"):
        linestrip.strip_seen_lines(spark.createDataFrame([(1, "a")], "doc_id long, text string"), F.lit(7), batches=2)


def test_a_shard_keeps_sorted_digests_through_its_blobs():
    rng = random.Random(5)
    held, lost, shard = Counter(), {}, linestrip.Shard(None)
    pool = [bytes(rng.choice([0, 0, 1, 255]) for _ in range(linestrip.WIDTH)) for _ in range(40)]  # many end in zeros
    for batch in range(6):
        part = rng.choices(pool, k=30)
        gone = set(linestrip._listed(shard.add(batch, linestrip._array(part), np.ones(30), np.full(30, 2.0), 4)))
        assert gone == {d for d in part if held[d] >= 4}
        for d in part:
            if held[d] >= 4:
                lost.setdefault(d, [batch, 0])[1] += 2
        held.update(part)
        shard = linestrip.Shard(shard.blobs())
        assert (shard.digests[1:] > shard.digests[:-1]).all()
    digests, first, docs, lines = shard.removed_lines()
    assert {d: (f, n, k) for d, f, n, k in zip(linestrip._listed(digests), first.tolist(), docs.tolist(), lines.tolist())} == {d: (f, held[d], k) for d, (f, k) in lost.items()}


def test_a_full_bitmap_changes_nothing(spark):
    docs = spark.createDataFrame([(0, 1, "keep this line\nlose this line\nx", 0)], "row long, doc_id long, text string, batch int")
    found = spark.createDataFrame([(hashlib.sha256(b"lose this line").digest(),)], "digest binary")
    full = linestrip._bitmap
    linestrip._bitmap = lambda found: np.full(linestrip.BITS // 64, 2**64 - 1, np.uint64)
    try:
        assert tuple(linestrip._without_lines(docs, found, 10).first()) == (1, 0, 3, 1, "keep this line\nx")
    finally:
        linestrip._bitmap = full
    assert tuple(linestrip._without_lines(docs, found, 10).first()) == (1, 0, 3, 1, "keep this line\nx")
