import numpy as np
from pyspark.sql import functions as F

from volatide.llm import quality, queries

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy_and_contract(spark):
    found = queries.op1_quality(spark, SF)
    assert found.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = found.collect()
    assert len(rows) == docs.count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [(r["predicted"], truth[r["doc_id"]], r["score"]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([p == t for p, t, _ in held]) > 0.95
    good, bad = [s for _, t, s in held if t == 1], [s for _, t, s in held if t == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.97


def test_labels_of_held_out_rows_change_nothing(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet").limit(300), spark.read.parquet(f"{SF}/labels.parquet")
    flipped = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality.score_documents(docs, x.where(~quality.held_out())).orderBy("doc_id").collect() for x in (labels, flipped))
    assert a == b


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 7), (1, "", 7), (2, "a b c", 7), (3, "word " * 200_000, 7), (None, "x", 7), (4, "a b c", 7)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(2, 1), (2, 0), (3, 0), (1, None), (None, 1), (4, 1)], "doc_id long, quality int")
    rows = quality.score_documents(docs, labels).collect()
    assert len(rows) == 6 and all(0 <= r["score"] <= 1 for r in rows)
    by = [r["score"] for r in rows if r["doc_id"] in (2, 4)]
    assert by[0] == by[1]  # equal texts
    assert {r["score"] for r in quality.score_documents(docs, labels.where("1 = 0")).collect()} and quality.score_documents(docs.where("1 = 0"), labels).count() == 0


def test_isotonic_matches_brute_force():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=60), (rng.random(60) < 0.5).astype(float)
    _, level = quality.isotonic(x, y)
    assert (np.diff(level) > 0).all()
    s = y[np.argsort(x, kind="stable")]
    best = [max(min(s[a : b + 1].mean() for b in range(i, len(s))) for a in range(i + 1)) for i in range(len(s))]  # the min-max formula
    assert np.allclose(sorted(set(np.round(best, 12))), np.round(level, 12))


def plain_statistics(text):
    """The statistics, said again a character and a word at a time."""
    raw = (text or "").encode()
    words, n = raw.split(), max(1, len(raw))
    w = max(1, len(words))
    count = lambda chars: sum(b in chars for b in raw)
    upper, lower = count(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), count(b"abcdefghijklmnopqrstuvwxyz")
    lines, tail = [x for x in raw.split(b"\n") if x], words[-400:]
    return [
        np.log1p(len(raw)), np.log1p(len(words)), min(30.0, (len(raw) - count(b"\n")) / w), len(set(words)) / w,
        sum(a == b for a, b in zip(words, words[1:])) / w, count(b"|") / w, upper / max(1, upper + lower), count(b"0123456789") / n, count(b"!") / w,
        count(b"&%$#*~^=+_") / w, count(b".?") / w, count(b",;:") / w, count(b"\n") / w, 1 - len(set(lines)) / len(lines) if lines else 0.0,
        sum(b >= 128 for b in raw) / n, sum(b < 32 and b not in (9, 10, 13) or b == 127 for b in raw) / n, count(b"()[]{}<>") / w, count(b"\"'`") / w, count(b"@") / w, count(b"/\\") / w,
        sum(len(x) <= 2 for x in words) / w, sum(len(x) >= 15 for x in words) / w, len(set(tail)) / max(1, len(tail)),
        sum(b in b"&%$#*!|" for x in tail for b in x) / max(1, len(tail)),
    ]


def test_query_matches_brute_force(spark):
    """Statistics, features, ridge and calibration over the whole table, by plain sums on one machine."""
    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    train = {r["doc_id"]: float(r["quality"]) for r in labels.where(~quality.held_out()).collect() if r["doc_id"] in docs and r["quality"] is not None}
    folds = {r["doc_id"]: r["f"] for r in spark.createDataFrame([(d,) for d in docs], "doc_id long").select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(quality.FOLDS)).alias("f")).collect()}
    stats = {d: np.array(plain_statistics(t)) for d, t in docs.items()}
    ids = sorted(train)
    rows, y, fold = np.array([stats[d] for d in ids]), np.array([train[d] for d in ids]), np.array([folds[d] for d in ids])
    mean, scale = rows.mean(0), rows.std(0)
    drawn = quality.Model(mean, scale)

    def phi(x):
        z = np.clip((x - mean) / np.where(scale > 1e-9, scale, 1), -4, 4)
        return np.array([*(np.sqrt(2 / quality.FEATURES) * np.cos(z @ drawn.directions[:, j] + drawn.phases[j]) for j in range(quality.FEATURES)), *(z / 8), 1.0])

    x = np.array([phi(r) for r in rows])
    ridge = lambda part: np.linalg.solve(x[part].T @ x[part] + 0.01 * quality.RIDGE * part.sum() * np.eye(x.shape[1]), x[part].T @ y[part])
    whole = ridge(np.ones(len(ids), bool))
    left_out = np.empty(len(ids))
    for k in range(quality.FOLDS):
        left_out[fold == k] = x[fold == k] @ ridge(fold != k)
    drawn.knots = quality.isotonic(left_out, y)
    found = {r["doc_id"]: r["score"] for r in queries.op1_quality(spark, sf).collect()}
    for d in docs:
        raw = phi(stats[d]) @ whole
        want = 0.999 * np.interp(raw, *drawn.knots) + 0.001 / (1 + np.exp(-(4 * raw - 2)))
        assert abs(found[d] - want) < 1e-6, d


def test_features_approximate_a_gaussian_kernel():
    rng = np.random.default_rng(1)
    d = len(quality.STATISTICS)
    model = quality.Model(np.zeros(d), np.ones(d))
    a, b = rng.normal(0, 1, (200, d)), rng.normal(0, 1, (200, d))
    waves = lambda x: model.features(x)[:, : quality.FEATURES]
    kernel = np.exp(-((a - b) ** 2).sum(1) * quality.WIDTH**2 / d / 2)
    assert np.abs((waves(a) * waves(b)).sum(1) - kernel).mean() < 0.06


def test_the_order_of_rows_that_share_an_id_changes_nothing(spark):
    rows = [(i, f"{'fine words in a row ' * (i % 7 + 1)}{kind}", None) for i in range(200) for kind in ("one.", "&&& two ***")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    weights = []
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string, lang string")
        weights.append(quality.learn(docs, labels).weights)
    assert np.allclose(*weights, rtol=1e-6, atol=1e-9)
