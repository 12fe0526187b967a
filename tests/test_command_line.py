"""Commands run one after another on a small made-up market."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from volatide.__main__ import COMMANDS, main, parser


def fails(rows):
    raise RuntimeError("no answer")


def by_title(rows):
    label = {"good": "positive", "bad ": "negative", "so n": "neutral"}
    return [{"article_id": r["article_id"], "label": label[r["title"][:4]], "confidence": 0.9, "rationale": "its title"} for r in rows]


@pytest.fixture(scope="module")
def market(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("market")
    rng = np.random.default_rng(4)
    days = pd.bdate_range("2024-01-02", periods=90)
    close = 100 * np.exp(np.cumsum(rng.normal(size=90) * 0.01))
    rows = [f"{d.date()},{c:.4f},{c * 0.999:.4f},{c * 1.01:.4f},{c * 0.99:.4f},{1000 + i}" for i, (d, c) in enumerate(zip(days, close, strict=True))]
    (root / "prices.csv").write_text("Date,TRDPRC_1,OPEN_PRC,HIGH_1,LOW_1,ACVOL_UNS\n" + "\n".join(rows) + "\n")
    news = [f"https://x/{i},s,{'Chứng khoán' if i % 2 else 'Kinh doanh'},{['good', 'bad', 'so'][i % 3]} news {i},{d.date()},{d.date()} 09:00:00,{['good gains', 'bad losses', 'so so'][i % 3] + ' word' * 30}" for i, d in enumerate(list(days) * 2)]
    (root / "news.csv").write_text("url,source,category,title,date,published_at,body\n" + "\n".join(news) + "\n")
    return root


def test_a_whole_run(spark, market, capsys):
    at = lambda name: str(market / name)
    run = lambda *a: main(list(a), spark)
    run("preprocess", "--news", at("news.csv"), "--prices", at("prices.csv"), "--output", at("pre"))
    articles = at("pre/articles_clean.parquet")
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["mapped_rows"] == 180
    run("prepare-inputs", "--articles", articles, "--output", at("inputs.parquet"))
    run("prepare-training", "--articles", articles, "--output", at("corpus.parquet"))
    run("sample", "--corpus", at("corpus.parquet"), "--sample-size", "60", "--output", at("sample.parquet"))
    corpus = spark.read.parquet(at("corpus.parquet"))
    assert corpus.count() == 180 and spark.read.parquet(at("sample.parquet")).count() == 60
    label = F.when(F.col("title").startswith("good"), "positive").when(F.col("title").startswith("bad"), "negative").otherwise("neutral")
    corpus.select("article_id", label.alias("label"), F.lit(0.9).alias("confidence")).write.parquet(at("notes.parquet"))
    run("merge-annotations", "--corpus", at("corpus.parquet"), "--annotations", at("notes.parquet"), "--output", at("labeled.parquet"))
    run("train", "--labeled", at("labeled.parquet"), "--output", at("model"))
    run("infer", "--inputs", at("inputs.parquet"), "--model", at("model"), "--output", at("scores.parquet"))
    assert spark.read.parquet(at("scores.parquet")).count() == 180
    run("merge-scores", "--articles", articles, "--scores", at("scores.parquet"), "--output", at("merged.parquet"))
    run("daily-sentiment", "--scores", at("scores.parquet"), "--output", at("daily.parquet"))
    run("validate", "--articles", articles, "--scores", at("scores.parquet"), "--prices", at("prices.csv"), "--output", at("report"))
    run("model-frame", "--prices", at("prices.csv"), "--news", at("pre/daily_news_prices.parquet"), "--scores", at("scores.parquet"), "--output", at("frame.parquet"))
    frame = spark.read.parquet(at("frame.parquet"))
    assert frame.count() == 90 and frame.where("has_news = 1").count() == 90
    run("garch-parameters", "--prices", at("prices.csv"), "--train-end", "2024-04-01", "--output", at("garch.parquet"))
    run("expanding-garch", "--prices", at("prices.csv"), "--train-rows", "60", "--output", at("walk.parquet"))
    run("describe", "--prices", at("prices.csv"))
    run("repair-csv", "--news", at("news.csv"), "--output", at("fixed.csv"))
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1]) == {"total_rows": 180, "padded_rows": 0, "correct_rows": 180, "odd_rows": 0}
    frame.fillna({"macro_sentiment": 0.0, "market_sentiment": 0.0}).write.parquet(at("full.parquet"))
    run("validate-daily", "--scores", at("scores.parquet"), "--output", at("days"))
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["daily_rows"] == 90
    run("plot-data", "--prices", at("prices.csv"), "--scores", at("scores.parquet"), "--bins", "10", "--output", at("plots"))
    assert spark.read.parquet(at("plots/returns.parquet")).agg(F.sum("n")).first()[0] == 89 and spark.read.parquet(at("plots/scores.parquet")).count() == 10
    run("bootstrap-labels", "--corpus", at("sample.parquet"), "--models", "tests.test_command_line:fails,tests.test_command_line:by_title", "--limit", "50", "--output", at("boot.parquet"))
    boot = spark.read.parquet(at("boot.parquet"))
    assert boot.count() == 50 and {r["model_name"] for r in boot.collect()} == {"tests.test_command_line:by_title"}
    (market / "params.yaml").write_text("sentiment:\n  sample_size: 90  # rows\nother:\n  unknown: 1\n  seed: 7\n")
    both = ["--corpus", at("corpus.parquet"), "--models", "tests.test_command_line:by_title", "--articles", articles, "--prices", at("prices.csv"), "--news", at("pre/daily_news_prices.parquet")]
    run("--params", at("params.yaml"), "pipeline", "--mode", "full", *both, "--output", at("whole"))
    reports = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert {r["split"] for r in reports["accuracy"]} == {"train", "test"} and reports["daily"]["daily_rows"] == 90
    assert spark.read.parquet(at("whole/annotation_sample.parquet")).count() == 90 and spark.read.parquet(at("whole/modeling_ready.parquet")).count() == 90
    with pytest.raises(ValueError, match="needs a corpus"):
        run("pipeline", "--mode", "train", "--output", at("none"))
    run("experiment", "--frame", at("full.parquet"), "--train-end", "2024-04-01", "--val-end", "2024-04-15", "--sequence-length", "5", "--epochs", "1", "--output", at("experiment"))
    assert spark.read.parquet(at("experiment/errors.parquet")).first()["n"] > 5


def test_every_command_parses():
    for name, (_, needed, _, _) in COMMANDS.items():
        words = [w for path in needed for w in (f"--{path}", "x")] + (["--output", "y"] if name != "describe" else []) + (["--mode", "full"] if name == "pipeline" else [])
        assert parser().parse_args([name, *words]).command == name
