import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from volatide.llm import langid, queries

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy_and_contract(spark):
    found = queries.op12_language(spark, SF)
    assert found.dtypes[:4] == [("doc_id", "bigint"), ("held_out", "boolean"), ("lang_pred", "string"), ("score", "double")]
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").withColumn("c", F.crc32(F.col("doc_id").cast("string")) % 4).collect()}
    rows = found.collect()
    assert len(rows) == len(docs)
    assert all(r["held_out"] == (docs[r["doc_id"]]["c"] == 2) and 0 <= r["score"] <= 1 and r["lang_pred"] in {"de", "en", "es", "fr"} for r in rows)
    held = [(r["lang_pred"], docs[r["doc_id"]]["lang"]) for r in rows if r["held_out"]]
    assert len(held) > 100 and np.mean([p == t for p, t in held]) > 0.98


def plain_counts(text):
    """Hashed n-grams, one at a time."""
    letters = ["" if not c else c for c in f" {text} ".lower()]
    joined = [" "] if not letters else []
    for c in letters:
        if c.isalpha():
            joined.append(c)
        elif not joined or joined[-1] != " ":
            joined.append(" ")
    found = Counter()
    for i in range(len(joined)):
        h = 0
        for n in range(1, langid.LONGEST + 1):
            if i + n > len(joined):
                break
            h = ((h ^ ord(joined[i + n - 1])) * 2654435761) % 2**32
            h ^= h >> 15
            if n > 1 or joined[i] != " ":
                found[h % langid.DIMENSIONS] += 1
    return found


def test_vectors_match_plain_counts(monkeypatch):
    for stretch in (1 << 18, 5):
        monkeypatch.setattr(langid, "STRETCH", stretch)
        for text in ("", "a", "Zoë läuft, 12 mal!", "日本語 text\n\n__x", "word " * 50):
            assert {int(i): int(n) for i, n in enumerate(langid.counts(text)) if n} == dict(plain_counts(text))


def test_predictions_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.learn(docs.where(~langid.held_out()), max_rows=60)
    texts = [r["text"] for r in docs.where(langid.held_out()).limit(40).collect()] + ["the", "ñ"]
    of, cosine, far = model.predict(texts)
    for text, k, score, rejected in zip(texts, of, cosine, far, strict=True):
        vector = {i: math.log1p(n) * float(model.idf[i]) for i, n in plain_counts(text).items()}
        length = math.sqrt(sum(v * v for v in vector.values()))
        near = [sum(v * float(c[i]) for i, v in vector.items()) / length for c in model.centroids]
        best = max(near)
        assert abs(best - score) < 1e-4 and near[list(model.owner).index(k) :] and max(n for n, o in zip(near, model.owner) if o == k) > best - 1e-4
        assert rejected == (1 - score > model.radius[k])
    assert len(model.centroids) > len(model.languages) == 4  # several a language
    assert model.centroids.nbytes <= langid.LARGEST


def test_what_is_far_is_rejected(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.learn(docs.where(~langid.held_out()))
    odd = spark.createDataFrame([("все люди рождаются свободными и равными в своём достоинстве",), ("xkq zvw qqj kxz vvk jqx",)], "text string")
    assert all(r["rejected"] for r in langid.annotate(odd, model).collect())
    done = langid.annotate(docs.where(langid.held_out()), model)
    assert done.where("rejected").count() < 0.06 * done.count()


def test_odd_rows(spark):
    rows = [(1, "en", None, 5), (2, "en", "", 5), (3, None, "12 34 ²", 5), (4, "en", "the cat and the dog", 5), (4, "en", "the cat and the dog", 5), (5, "fr", "le chat et le chien", 5), (6, "fr", "word " * 200_000, 5), (None, "fr", "les chats", 5), (7, None, "the dogs", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string, score int")
    found = langid.identify(docs).collect()
    assert len(found) == len(rows)
    by = {r["doc_id"]: r for r in found}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 and not by[i]["rejected"] for i in (1, 2, 3))
    assert {r["lang_pred"] for r in found if r["doc_id"] == 4} == {"en"} and by[5]["lang_pred"] == "fr" and by[7]["lang_pred"] == "en"
    assert by[None]["held_out"] is False
    assert langid.identify(docs.where("1 = 0")).count() == 0
    assert {r["lang_pred"] for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    kept = langid.annotate(docs, None)
    assert kept.columns == ["doc_id", "lang", "text", "lang_pred", "score", "rejected"]


def test_held_out_rows_teach_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(400)
    swapped = docs.withColumn("lang", F.when(langid.held_out(), F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit("s"))
    a, b = ({tuple(r) for r in langid.identify(d).collect()} for d in (docs, swapped))
    assert a == b


def test_a_repeated_row_stays_one(spark):
    docs = spark.createDataFrame([(1, "en", "the one text")] * 3000 + [(2, "fr", "le texte")], "doc_id long, lang string, text string")
    assert langid._sample(docs, 50).count() <= 2
