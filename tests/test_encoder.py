import numpy as np
import pytest
from pyspark.sql import functions as F

from volatide.operators import classify, encoder
from volatide.schemas import LABELS


def rows(spark, n=90):
    words = {"positive": "good gains soared", "negative": "bad losses fell", "neutral": "flat market waited"}
    data = []
    for i in range(n):
        label = LABELS[i % 3]
        data.append((f"{words[label].split()[i % 3]} the day {i % 11} said", label, "val" if i % 7 == 0 else "test" if i % 7 == 1 else "train"))
    return spark.createDataFrame([*data, (None, "neutral", "train"), ("x", "unknown", "train"), ("", None, "train")], "input_text string, label string, split string")


def test_gradients():
    net = encoder.Encoder(buckets=32, width=4, seed=3)
    x, y = net.prepared(["one two two", "", "three one", None]), np.array([0, 1, 2, 1])
    loss, g = net.gradient(x, y)
    assert loss == pytest.approx(net.loss(x, y) / 4)
    rng = np.random.default_rng(0)
    for name, w in net.w.items():
        for _ in range(6):
            at = tuple(rng.integers(0, s) for s in w.shape)
            w[at] += 1e-6
            up = net.loss(x, y)
            w[at] -= 2e-6
            down = net.loss(x, y)
            w[at] += 1e-6
            assert (up - down) / 8e-6 == pytest.approx(g[name][at], abs=1e-6)


def test_training_by_tasks_saving_and_scoring(spark, tmp_path):
    df = rows(spark)
    model = encoder.train(df, epochs=6, batch=8, workers=2, buckets=256)
    again = encoder.train(df.repartition(5), epochs=6, batch=8, workers=2, buckets=256)
    assert all(np.allclose(model.w[k], again.w[k]) for k in model.w) and 1 <= len(model.losses) <= 6
    encoder.save(model, spark, str(tmp_path / "model"))
    loaded = encoder.load(spark, str(tmp_path / "model"))
    out = encoder.predict(loaded, df).toPandas()
    assert np.allclose(out[[f"prob_{x}" for x in LABELS]].sum(axis=1), 1) and np.allclose(out["sentiment_score"], out["prob_positive"] - out["prob_negative"])
    test = out[out["split"] == "test"]
    assert (test["label"] == test["sentiment_label"]).mean() > 0.9
    plain = classify.predict(classify.train(df.where("split = 'train' and label in ('positive', 'neutral', 'negative')").fillna("")), df.where("split = 'test'").fillna("")).toPandas()
    assert (test["label"] == test["sentiment_label"]).mean() >= (plain["label"] == plain["sentiment_label"]).mean() - 0.1
    wrong = encoder.Encoder(16, 4)
    wrong.labels = wrong.labels[::-1]
    encoder.save(wrong, spark, str(tmp_path / "wrong"))
    with pytest.raises(ValueError, match="must be"):
        encoder.load(spark, str(tmp_path / "wrong"))


def test_options(spark):
    df = rows(spark, 30)
    assert encoder.Encoder(64, 4, max_length=2).prepared(["a b c d"])[0][1].tolist() == [0, 2]
    short = encoder.train(df, split=None, epochs=1, workers=1, buckets=64, width=4, max_length=1)
    assert short.max_length == 1 and len(short.losses) == 1
    assert encoder.predict(short, df.where(F.lit(False))).count() == 0


def test_training_is_a_job_an_epoch_and_copies_share_no_shard(spark, monkeypatch):
    monkeypatch.setattr(encoder, "SHARD_ROWS", 32)
    base = rows(spark, 60)
    hot = base.union(spark.createDataFrame([("gains soared", "positive", "train")] * 200, base.schema))
    sizes, inner = [], encoder.summed_parts

    def watched(parts):
        sizes.append([int(np.frombuffer(r["part"])[-1]) for r in parts.where("i = 15").collect()])
        return inner(parts)

    monkeypatch.setattr(encoder, "summed_parts", watched)
    model = encoder.train(hot, epochs=2, batch=8, workers=2, buckets=64, width=4)
    known = hot.where("split = 'train' and label in ('positive', 'neutral', 'negative')").count()
    assert len(model.losses) == len(sizes) == 2
    assert all(sum(s) == known for s in sizes) and len(sizes[0]) > 4 and max(sizes[0]) < 3 * 32


def test_batches_have_the_derivatives_of_their_rows():
    net = encoder.Encoder(buckets=32, width=4, seed=3)
    x, y = net.prepared(["one two two", "", "three one", None]), np.array([0, 1, 2, 1])
    loss, g = net.gradient(x, y)
    alone = [net.gradient(x[i : i + 1], y[i : i + 1]) for i in range(4)]
    assert loss == pytest.approx(np.mean([a for a, _ in alone]))
    assert all(np.allclose(g[k], np.mean([a[k] for _, a in alone], axis=0)) for k in net.w)
