import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from volatide.llm import bpe, queries

PATH = P.path(queries.BPE_FILE)


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_of(data):
    return [int.from_bytes(data[i : i + 4], "little") for i in range(0, len(data), 4)]


def test_same_ids_as_the_library_on_odd_texts(library):
    rng = random.Random(3)
    alphabet = ["a", "b", "the", "ing", " ", " ", "\n", "\t", "  ", "'s", "'re", "'", "é", "ß", "漢", "😀", "1", "23", ".", "!!", " ", " ", "\x1c", "\x85", "_", "İ", "\r\n", "Z" * 40]
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(60))) for _ in range(1500)]
    texts += ["", " ", "  a", "a ", " a", "a" * 1000, "xyz" * 400, "\n\n a", "don't 's", "日本語" * 200, "ab" * 127, "é" * 128]
    tok = bpe.ByteBPE(PATH, P.PATTERN)
    for text, ids in zip(texts, tok.encode_texts(texts), strict=True):
        assert ids_of(ids) == library.encode_ordinary(text), repr(text)
        assert tok.decode(ids) == text.encode()


def one_by_one(tok, piece):
    """The leftmost pair of least rank, again and again."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, at = min((tok.ranks.get(parts[i] + parts[i + 1], 2**31), i) for i in range(len(parts) - 1))
        if rank == 2**31:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return b"".join(tok.ranks[p].to_bytes(4, "little") for p in parts)


def test_matrix_merges_one_by_one():
    tok = bpe.ByteBPE(PATH, P.PATTERN)
    rng = random.Random(5)
    pieces = [bytes(rng.choices(b"etaoinshr", k=rng.randrange(2, 200))) for _ in range(300)]
    assert tok._by_matrix(pieces, 256) == [one_by_one(tok, p) for p in pieces]


def test_long_rows_merge_in_the_same_order():
    tok = bpe.ByteBPE(PATH, P.PATTERN)
    rng = random.Random(9)
    pieces = [bytes(rng.choices(letters, k=rng.randrange(2, 900))) for letters in (b"etaoinshr", b"ab", b"a", bytes(range(256)), b"aab0 ", "日本語テキスト".encode()) for _ in range(60)]
    pieces += [b"the" * 800, bytes(rng.choices(b"etaoinshrdlu", k=3000)), b"a" * 3000, b"=" * 1001]
    for p in pieces:
        assert tok._by_long_row(p) == one_by_one(tok, p)


def test_very_long_matches_as_the_library(library):
    rng = random.Random(4)
    texts = ["".join(rng.choices("etaoinshrdlu", k=300_000)), "a" * 200_000, "日本語テキスト" * 20_000]
    tok = bpe.ByteBPE(PATH, P.PATTERN)
    for text, ids in zip(texts, tok.encode_texts(texts), strict=True):
        assert ids_of(ids) == library.encode_ordinary(text)


def test_merges_that_make_lower_ranks_go_first():
    """A rank file in which merging makes pairs that go before what is left, as trained ones hardly have."""
    tok = bpe.ByteBPE(PATH, P.PATTERN)
    rng = random.Random(2)
    for _ in range(30):
        parts = {bytes([b]): i for i, b in enumerate(b"abc")}
        words = sorted({bytes(rng.choices(b"abc", k=rng.randrange(2, 5))) for _ in range(25)})
        rng.shuffle(words)
        tok.ranks = parts | {w: i + 3 for i, w in enumerate(words)}
        tok.tokens = sorted(tok.ranks, key=tok.ranks.get)
        tok.bytes = bpe.np.array([tok.ranks.get(bytes([b]), 0) for b in range(256)], bpe.np.int32)
        pairs = [(tok.ranks[t[:i]], tok.ranks[t[i:]], r) for t, r in tok.ranks.items() for i in range(1, len(t)) if t[:i] in tok.ranks and t[i:] in tok.ranks]
        tok.pairs = bpe.PairTable(*bpe.np.array(pairs).T.reshape(3, -1).astype(bpe.np.int32))
        for _ in range(20):
            p = bytes(rng.choices(b"abc", k=rng.randrange(2, 60)))
            assert tok._by_long_row(p) == one_by_one(tok, p) == tok._by_matrix([p], 64)[0]


def test_long_texts_are_cut_only_where_matches_begin(library):
    text = "some words, and more  of\n\n them 123 don't " * 400
    cuts = list(bpe.stretches(text, 1000))
    assert "".join(cuts) == text and len(cuts) > 5
    tok = bpe.ByteBPE(PATH, P.PATTERN)
    assert ids_of(b"".join(tok.encode_batch([c])[0] for c in cuts)) == library.encode_ordinary(text)


def test_query_matches_the_library(spark, library):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.op3_byte_bpe(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_nulls_empty_tables_and_other_columns(spark):
    df = spark.createDataFrame([(1, None, "x"), (1, "", "x"), (2, "hello world", None)], "doc_id long, text string, ids string")
    out = bpe.decode(bpe.encode(df, PATH, P.PATTERN), PATH, P.PATTERN).collect()
    assert sorted(bytes(r["decoded"]) for r in out) == [b"", b"", b"hello world"] and {r["ids"] for r in out} == {"x", None}
    assert bpe.encode(df.where("1 = 0"), PATH, P.PATTERN).count() == 0
