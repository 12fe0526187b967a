"""The pipeline's stages against plain Python on the small tables."""

import importlib
import os
import sys
from collections import Counter

import public_tokenizers
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline
from tests.llm.test_neardup import brute as duplicates
from tests.llm.test_pii import brute as spans_of
from volatide.llm import bpe, mixing

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, out[-1], SF).write.parquet(str(folder / name))
        out.append(spark.read.parquet(str(folder / name)))
    return out


def test_all_but_the_last_keep_the_columns(stages):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "pii", "mixing", "byte_bpe"]
    assert all(s.columns == stages[0].columns for s in stages[1:-1])


def test_quality_rejects_labelled_junk_and_keeps_clean_documents(spark, stages):
    kept = {r["doc_id"] for r in stages[1].collect()}
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert sum((d in kept) == (q == 1) for d, q in truth.items()) >= 0.95 * len(truth)


def test_one_document_of_each_group_stays(stages):
    rows = [(r["doc_id"], r["text"]) for r in stages[1].collect()]
    want = {d for d, _, head in duplicates(rows, 5, 80) if d == head}
    assert {r["doc_id"] for r in stages[2].collect()} == want and stages[2].count() == len(want)


def test_personal_data_is_masked(stages):
    before = {r["doc_id"]: r["text"] for r in stages[2].collect()}
    for r in stages[3].collect():
        assert spans_of(r["text"]) == [] or spans_of(before[r["doc_id"]])
        assert r["n_chars"] == len(r["text"]) and (r["text"] == before[r["doc_id"]]) == ("<" not in r["text"] or not spans_of(before[r["doc_id"]]))


def test_mix_repeats_documents_as_decided(stages):
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(stages[3]).collect()}
    assert Counter(r["doc_id"] for r in stages[4].collect()) == Counter({d: n for d, n in copies.items() if n})


def test_tokens_decode_to_the_texts(stages):
    tok = bpe.tokenizer(public_tokenizers.path(corpus_pipeline.BPE_FILE), public_tokenizers.PATTERN)
    texts = Counter((r["doc_id"], r["text"]) for r in stages[4].collect())
    rows = stages[5].collect()
    assert all(r["round_trip"] for r in rows)
    assert Counter((r["doc_id"], tok.decode(bytes(r["token_ids"])).decode()) for r in rows) == texts


def test_run_gives_the_last_stage(spark, stages):
    key = lambda r: (r["doc_id"], r["n_tokens"])
    assert sorted(map(key, corpus_pipeline.run(spark, SF).collect())) == sorted(map(key, stages[-1].collect()))


def test_repeated_and_odd_rows(spark):
    rows = [(1, "a b c d e f g", "en", "s", 5), (1, "a b c d e f g", "en", "s", 5), (2, None, None, None, None), (None, "a b c d e f g", "en", "s", 5), (3, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.near_duplicate_stage(spark, docs, SF).collect()
    assert Counter(r["doc_id"] for r in left) == Counter([1, 2, 3])  # the row without an id is a copy of 1
    odd = [(None, "q r s t u v w", "en", "s", 5), (None, "q r s t u v w", "de", "s", 5), (7, "", "en", "s", 0), (7, "k l m n o p", "en", "s", 0)]
    left = corpus_pipeline.near_duplicate_stage(spark, docs.union(spark.createDataFrame(odd, docs.schema)), SF).collect()
    assert Counter(r["doc_id"] for r in left) == Counter([1, 2, 3, None, 7, 7])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() >= 0 and stage(spark, docs.where("1 = 0"), SF).count() == 0


def test_columns_with_clashing_names(spark):
    """Every stage but the last keeps columns named like its internal ones, with their values."""
    names = ["__quality", "__SPANS", "key", "row", "order", "gone", "first", "text_hash", "component_id", "p_size", "p_source", "e_low", "src", "u", "copies", "rank", "score", "pii_spans", "token_ids", "decoded", "a.b"]
    rows = [(i, "A sentence of plain words that stands for itself, number %d of them all." % i, "en", "s%d" % (i % 3), *range(len(names))) for i in range(30)]
    docs = spark.createDataFrame(rows, ", ".join(["doc_id long, text string, lang string, source string", *(f"`{n}` int" for n in names)]))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name == "byte_bpe":
            assert out.columns == ["doc_id", "lang", "source", "n_tokens", "token_ids", "round_trip"] and out.count() == 30
        else:
            assert out.columns == docs.columns and {r[4:] for r in out.collect()} <= {tuple(range(len(names)))}


def test_whole_run_matches_plain_python(spark):
    """All stages at once against brute force from the scores on: copies, personal data, copies taken and ids."""
    import tiktoken

    from volatide.llm import quality
    from volatide.llm.common import table

    docs = table(spark, SF, "documents")
    model = quality.learn(docs, table(spark, SF, "labels").where(~quality.held_out()))
    rows = [(r["doc_id"], r["text"]) for r in quality.annotate(docs, model).where("score >= 0.5").collect()]
    firsts = {d for d, _, head in duplicates(rows, 5, 80) if d == head}
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    masked = {}
    for d, text in rows:
        if d in firsts:
            out, at = [], 0
            spans = sorted(((int(a), -int(b), k) for k, a, b in (x.split(":") for x in spans_of(text))), key=lambda x: x[:2])
            for a, b, k in spans:
                if a >= at:
                    out += [text[at:a], f"<{k.upper()}>"]
                at = max(at, -b)
            masked[d] = "".join([*out, text[at:]]) if spans else text
    # The mix: plain water filling and Pareto ranks.
    import hashlib
    import re

    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for d, t in masked.items()}
    names = sorted({source[d] for d in masked})
    total = {s: sum(n for d, n in size.items() if source[d] == s) for s in names}
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), 1.5 * sum(total.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * total[s]}
        for s in over or open_:
            target[s] = 2.0 * total[s] if over else level * weight[s]
        left -= sum(target[s] for s in over)
        open_ = open_ - over if over else set()
    copies = Counter()
    for s in names:
        mine = [d for d in masked if source[d] == s and size[d]]
        whole = int(target[s] // total[s])
        need = target[s] - whole * total[s]
        f, g = need / total[s], {d: size[d] * 1024 // (size[d] + 100) / 1024 for d in mine}
        mean = sum(g[d] * size[d] for d in mine) / total[s]

        def odds(d):
            u = (int(hashlib.md5(f"mix:{d}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            p = f + f * (1 - f) * (g[d] - mean)
            return (u / (1 - u)) / (p / (1 - p))

        upto = 0
        for d in sorted(mine, key=odds) if need else mine:
            taken = need > 0 and upto + size[d] / 2 <= need
            upto += size[d]
            copies[d] += whole + taken
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.tokenizer(public_tokenizers.path(corpus_pipeline.BPE_FILE), public_tokenizers.PATTERN).ranks, special_tokens={})
    want = Counter({(d, b"".join(i.to_bytes(4, "little") for i in lib.encode_ordinary(masked[d]))): n for d, n in copies.items() if n})
    found = corpus_pipeline.run(spark, SF).collect()
    assert Counter((r["doc_id"], bytes(r["token_ids"])) for r in found) == want


def test_entry_registers_the_pipeline():
    entry = importlib.import_module("__spark_entry__")
    assert {"pipeline", *(f"op{n}" for n in range(1, 11))} <= {q.split("_")[0] for q in entry.queries()}
