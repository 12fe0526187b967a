import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from volatide.llm import collocations


def brute(rows, longest, least, inside, top):
    """(lang, rank, phrase, a, l, r, n, score), by counting all phrases."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, longest + 1):
                f.update((lang, tuple(words[i : i + size])) for i in range(len(words) - size + 1))
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    over = Counter()
    for (lang, words), a in candidates.items():
        for size in range(2, len(words)):
            for i in range(len(words) - size + 1):
                key = (lang, words[i : i + size])
                over[key] = max(over[key], a)
    found = {}
    for (lang, words), a in candidates.items():
        if 100 * over[lang, words] >= inside * a:
            continue
        cuts = [(1_000_000 * a * a // (f[lang, words[:k]] * f[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        found.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), f[lang, words[:k]], f[lang, words[k:]]))
    return {(lang, i, p.decode(), -a, left, right, n[lang], -s) for lang, rows in found.items() for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1)}


def corpus(seed, rows=300):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "of", "é", "a b", "Zoë", "x" * 80, "İ", "data", "lake", "new", "york"] + [f"w{i}" for i in range(40)]
    out = [("en", None), (None, "a b. a b"), ("und", "a b a b"), ("en", ""), ("en", " \t\n..,"), ("fr", "word")]
    for _ in range(rows):
        words = rng.choices(vocabulary, [60 // (i + 1) + 1 for i in range(len(vocabulary))], k=rng.randint(0, 60))
        out.append((rng.choice(["en", "en", "fr", None, "und"]), "".join(w + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", " \x0b"]) for w in words)))
    return out + [out[-1]] * 20


@pytest.mark.parametrize("known, longest", [(1 << 16, 3), (6, 4), (0, 2)])
def test_matches_brute_force(spark, monkeypatch, known, longest):
    monkeypatch.setattr(collocations, "KNOWN", known)
    rows = corpus(known)
    docs = spark.createDataFrame([(i, t, g, 1, "x") for i, (g, t) in enumerate(rows)], "doc_id long, text string, lang string, n long, word string").repartition(3)
    found = collocations.collocations(docs, longest=longest, least=3, inside=50, top=30)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) > 30
    assert set(got) == brute(rows, longest, 3, 50, 30)


def test_empty_tables(spark):
    for rows in ([], [(1, None, "en"), (2, "", None)]):
        assert collocations.collocations(spark.createDataFrame(rows, "doc_id long, text string, lang string")).count() == 0


def test_tokens_in_chunks_of_any_size(monkeypatch):
    texts = ["Ab c. d", "", None, "e" * 30 + " f", "g", ",h i\n\nj", "k"]
    whole = [(w.as_py(), r, b) for words, rows, begins in collocations.tokens(pa.array(texts)) for w, r, b in zip(words, rows.tolist(), begins.tolist())]
    assert whole == [("ab", 0, True), ("c", 0, False), ("d", 0, True), ("e" * 30, 3, True), ("f", 3, False), ("g", 4, True), ("h", 5, True), ("i", 5, False), ("j", 5, True), ("k", 6, True)]
    for chunk in range(1, 40):
        monkeypatch.setattr(collocations, "CHUNK", chunk)
        assert whole == [(w.as_py(), r, b) for words, rows, begins in collocations.tokens(pa.array(texts).slice(0)) for w, r, b in zip(words, rows.tolist(), begins.tolist())]


def test_radix_sort_and_run_lengths():
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 3, (500, 3)).astype(np.uint32) * np.uint32(70_001)
    distinct, counts = collocations.run_lengths(keys)
    want, n = np.unique(keys, axis=0, return_counts=True)
    assert (distinct == want).all() and (counts == n).all()
    assert len(collocations.run_lengths(keys[:0])[0]) == 0


def test_a_full_bitmap_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(collocations, "BITS", 1 << 16)
    monkeypatch.setattr(collocations, "_passes", lambda keys, bitmap: np.ones(len(keys), bool))
    rows = corpus(9, 100)
    docs = spark.createDataFrame([(g, t) for g, t in rows], "lang string, text string")
    assert {tuple(r) for r in collocations.collocations(docs, longest=3, least=3, top=50).collect()} == brute(rows, 3, 3, 50, 50)


def test_counts_of_many_digits_stay_exact(spark):
    a, left, right = 999_999_999_999, 1_234_567_890_123, 2_345_678_901_234
    found = spark.createDataFrame([(a, left, right)], "a long, l long, r long").selectExpr(f"cast({collocations.SCORE} as long) AS score").first()["score"]
    assert found == 1_000_000 * a * a // (left * right)
