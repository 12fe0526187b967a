"""Sequences of features, a learned residual on top of the GARCH forecast, and robustness specifications."""

from __future__ import annotations

import pickle
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from volatide.operators import garch
from volatide.operators.network import Network, sum_over_tasks
from volatide.operators.recurrence import numbered
from volatide.operators.stats import error_metrics
from volatide.storage import cut

# Inputs of the network; without sentiment there are the market's and the news volume's only.
QUIET = ["garch_std_resid", "garch_forecast_var", "abs_return", "n_articles", "n_categories", "mean_body_len"]
FEATURES = [
    *QUIET, "mean_sentiment", "sentiment_std", "sentiment_volume", "negative_share", "neutral_share", "positive_share", "net_sentiment",
    "sentiment_surprise", "macro_sentiment", "market_sentiment", "has_sentiment",
]


#: Rows of a series that are windowed together, beside the halo of the rows before them.
SPAN = 512


def sequences(df: DataFrame, features: list[str], length: int, span: int = SPAN) -> DataFrame:
    """Add `window`: the features of the last `length` rows up to each row of a series; rows without a full window go.

    Rows are numbered and dealt into blocks of `span`; the last length - 1 rows of a block are sent to the next one too,
    so windows are made inside blocks and no series is sorted as a whole.
    """
    span = max(span, length)
    clean = numbered(df.dropna(subset=features).where(F.col("date").isNotNull()), name="__i")
    home, halo = F.floor(F.col("__i") / span), F.col("__i") % span > span - length
    sent = clean.withColumn("__in", F.explode(F.when(halo, F.array(home, home + 1)).otherwise(F.array(home))))
    last = Window.partitionBy("series_id", "__in").orderBy("__i").rowsBetween(1 - length, 0)
    rows = F.collect_list(F.array(*[F.col(f).cast("double") for f in features])).over(last)
    out = sent.withColumn("window", rows).where((F.size("window") == length) & (home == F.col("__in")))
    return out.drop("__i", "__in")


class LSTM(Network):
    """One LSTM layer, a rectified layer and a linear output, trained by Adam with early stopping, in numpy."""

    def __init__(self, inputs: int, hidden: int = 32, dense: int = 16, seed: int = 0):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.uniform(-1, 1, shape) / np.sqrt(hidden)
        self.w = {"x": draw(inputs, 4 * hidden), "h": draw(hidden, 4 * hidden), "b": draw(4 * hidden), "d": draw(hidden, dense), "e": draw(dense), "o": draw(dense, 1), "p": draw(1)}
        self.hidden = hidden

    def forward(self, x: np.ndarray):
        n, steps, _ = x.shape
        h = c = np.zeros((n, self.hidden))
        trail = []
        for t in range(steps):
            i, f, g, o = np.split(x[:, t] @ self.w["x"] + h @ self.w["h"] + self.w["b"], 4, axis=1)
            i, f, o = (1 / (1 + np.exp(-np.clip(v, -40, 40))) for v in (i, f, o))
            g, before = np.tanh(g), c
            c = f * c + i * g
            trail.append((x[:, t], h, before, i, f, g, o, c))
            h = o * np.tanh(c)
        wide = np.maximum(h @ self.w["d"] + self.w["e"], 0)
        return (wide @ self.w["o"] + self.w["p"])[:, 0], (trail, h, wide)

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        out, (trail, h, wide) = self.forward(x)
        g = {k: np.zeros_like(v) for k, v in self.w.items()}
        d = (2 * (out - y) / len(y))[:, None]
        g["o"], g["p"] = wide.T @ d, d.sum(0)
        dw = (d @ self.w["o"].T) * (wide > 0)
        g["d"], g["e"] = h.T @ dw, dw.sum(0)
        dh, dc = dw @ self.w["d"].T, np.zeros_like(h)
        for xt, before_h, before_c, i, f, gate, o, c in reversed(trail):
            tc = np.tanh(c)
            dc = dc + dh * o * (1 - tc * tc)
            dz = np.hstack([dc * gate * i * (1 - i), dc * before_c * f * (1 - f), dc * i * (1 - gate * gate), dh * tc * o * (1 - o)])
            g["x"] += xt.T @ dz
            g["h"] += before_h.T @ dz
            g["b"] += dz.sum(0)
            dh, dc = dz @ self.w["h"].T, dc * f
        return float(((out - y) ** 2).mean()), g

    def loss(self, x: np.ndarray, y: np.ndarray) -> float:
        return float(((self.forward(x)[0] - y) ** 2).sum()) if len(x) else 0.0


class Learned:
    """A network with the scales of its inputs and target."""

    def __init__(self, x: np.ndarray, y: np.ndarray, split: np.ndarray, epochs: int, summed=None, worker: int = 0, workers: int = 1):
        """Inputs and target are standardised on the train rows (of all workers) only."""
        add = summed or (lambda numbers: numbers)
        known = ~np.isnan(y)
        train, val = (split == "train") & known, (split == "val") & known
        steps = x.shape[1]
        n = add(np.array([float(train.sum())]))[0]
        if n == 0:
            raise ValueError("No train rows with a target.")
        self.mean = add(x[train].sum((0, 1))) / (n * steps)
        scale = np.sqrt(add(((x[train] - self.mean) ** 2).sum((0, 1))) / (n * steps))
        self.scale = np.where(scale > 1e-12, scale, 1)
        self.m = add(np.array([y[train].sum()]))[0] / n
        self.s = float(np.sqrt(add(np.array([((y[train] - self.m) ** 2).sum()]))[0] / n)) or 1.0
        z = (x - self.mean) / self.scale
        self.net = LSTM(x.shape[2])
        self.losses = self.net.train(z[train], (y[train] - self.m) / self.s, z[val], (y[val] - self.m) / self.s, epochs=epochs, summed=summed, worker=worker, workers=workers)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.net.forward((x - self.mean) / self.scale)[0] * self.s + self.m


def _windows(column: pd.Series) -> np.ndarray:
    return np.stack([np.stack(w) for w in column]).astype(float)


def learn_in_parallel(windows: DataFrame, target: str = "hybrid_residual_target", epochs: int = 30, workers: int = 4) -> DataFrame:
    """(model, losses), one row: a network whose rows are spread over the `workers` tasks of a barrier stage, which exchange gradients.

    The stage needs as many free slots as workers. If one task is lost, Spark starts all of them again.
    """

    def run(frames):
        parts, context = list(frames), BarrierTaskContext.get()
        frame = pd.concat(parts) if parts else pd.DataFrame(columns=["date", "split", "window", target])
        # Numbers of inputs are the same in all tasks, also in one without rows.
        shape = [x for x in context.allGather("x".join(map(str, _windows(frame["window"]).shape[1:])) if len(frame) else "") if x]
        if not shape:
            return
        empty = np.zeros((0, *map(int, shape[0].split("x"))))
        frame = frame.sort_values("date")
        x = _windows(frame["window"]) if len(frame) else empty
        learned = Learned(x, frame[target].to_numpy(float), frame["split"].to_numpy(), epochs, sum_over_tasks, context.partitionId(), workers)
        if context.partitionId() == 0:
            yield pd.DataFrame({"model": [pickle.dumps(learned)], "losses": [learned.losses]})

    dealt = windows.select("date", "split", "window", target).repartition(workers, "date")
    return dealt.mapInPandas(run, "model binary, losses array<double>", barrier=True)


#: Rows of a group whose network is trained in one task at most.
MOST_ROWS = 50_000


def learn_residuals(windows: DataFrame, target: str = "hybrid_residual_target", by: str = "series_id", epochs: int = 30, keep: tuple[str, ...] = (), most_rows: int = MOST_ROWS, workers: int = 4) -> DataFrame:
    """(by, date, split, *keep, predicted_residual) of every row: one network a group, on its train rows, stopped on val.

    Rows need `window`, `split`, `target`. Groups of up to `most_rows` rows (counted) are a task each; a larger one is
    trained by `workers` tasks that exchange gradients, and then predicted wherever its rows are.
    """
    columns = [by, "date", "split", *keep]
    kinds = dict(windows.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in columns) + ", predicted_residual double"
    picked = windows.select(*columns, "window", *[c for c in [target] if c not in columns])

    def run(_, frame):
        frame = frame.sort_values("date")
        x = _windows(frame["window"])
        return frame[columns].assign(predicted_residual=Learned(x, frame[target].to_numpy(float), frame["split"].to_numpy(), epochs).predict(x))

    sizes = picked.groupBy(by).agg(F.count("*").alias("__n")).where(F.col("__n") > most_rows)
    large = [row[by] for row in sizes.collect()]  # few: each has most_rows rows at least
    small = picked.where(~F.col(by).isin(large)) if large else picked
    out = small.groupBy(by).applyInPandas(run, schema)
    for name in large:
        own = picked.where(F.col(by) == F.lit(name))
        model = pickle.loads(learn_in_parallel(own, target, epochs, workers).collect()[0]["model"])

        def predict(frames, model=model):
            for frame in frames:
                if len(frame):
                    yield frame[columns].assign(predicted_residual=model.predict(_windows(frame["window"])))

        out = out.union(own.mapInPandas(predict, schema))
    return out


@dataclass(frozen=True)
class Spec:
    name: str
    threshold: float = 0.05
    target: str = "parkinson"
    features: list[str] = field(default_factory=lambda: list(FEATURES))
    kind: str = "hybrid"  # or garchx, expanding


def specifications() -> list[Spec]:
    """The seven robustness runs; each rebuilds its frame with its own threshold and target."""
    return [Spec("baseline_005"), Spec("threshold_010", 0.10), Spec("threshold_015", 0.15), Spec("garman_klass", target="garman_klass"), Spec("no_sentiment", features=list(QUIET)), Spec("garchx", kind="garchx"), Spec("expanding", kind="expanding")]


def hybrid_forecasts(frame: DataFrame, train_end: str, val_end: str, features: list[str] | None = None, length: int = 15, epochs: int = 30) -> DataFrame:
    """(series_id, date, split, actual, baseline, hybrid): the GARCH forecast, and it plus the learned residual."""
    return corrected_forecasts(garch.add_features(frame, train_end), train_end, val_end, features, length, epochs)


def residual_windows(full: DataFrame, train_end: str, val_end: str, features: list[str] | None = None, length: int = 15) -> DataFrame:
    """Windows with splits of a frame that has its garch columns. Features that it lacks are left out; rows without a target go."""
    from volatide.operators.labels import split_by_dates

    used = [f for f in features or FEATURES if f in full.columns]
    out = split_by_dates(sequences(full.dropna(subset=["hybrid_residual_target"]), used, length), train_end, val_end)
    return out.select("series_id", "date", "split", "window", "hybrid_residual_target", "target_next_vol", "garch_forecast_vol")


def corrected(windows: DataFrame, epochs: int = 30) -> DataFrame:
    """(series_id, date, split, actual, baseline, hybrid) of residual windows."""
    out = learn_residuals(windows, epochs=epochs, keep=("target_next_vol", "garch_forecast_vol"))
    baseline = F.col("garch_forecast_vol")
    return out.select("series_id", "date", "split", F.col("target_next_vol").alias("actual"), baseline.alias("baseline"), (baseline + F.col("predicted_residual")).alias("hybrid"))


def corrected_forecasts(full: DataFrame, train_end: str, val_end: str, features: list[str] | None = None, length: int = 15, epochs: int = 30) -> DataFrame:
    """`hybrid_forecasts` from a frame that has its garch columns."""
    return corrected(cut(residual_windows(full, train_end, val_end, features, length)), epochs)


def with_expanding_garch(frame: DataFrame, val_end: str, every: int = 21) -> DataFrame:
    """The garch columns with parameters that are first fitted up to `val_end` and again every few rows from there on."""
    walked = garch.expanding(frame, train_end=val_end, every=every)
    names = {"garch_conditional_vol": "conditional_vol", "garch_forecast_vol": "forecast_vol", "garch_std_resid": "std_resid"}
    columns = [F.col(old).alias(new) for new, old in names.items()]
    squares = [(F.col(c) * F.col(c)).alias(f"garch_{c.removesuffix('vol')}var") for c in ("conditional_vol", "forecast_vol")]
    full = frame.join(walked.select("series_id", "date", *columns, *squares), ["series_id", "date"], "left")
    return full.withColumn("hybrid_residual_target", F.col("target_next_vol") - F.col("garch_forecast_vol"))


def expanding_forecasts(frame: DataFrame, train_end: str, val_end: str, length: int = 15, epochs: int = 30, every: int = 21) -> DataFrame:
    """`hybrid_forecasts` with the garch columns of an expanding window."""
    return corrected_forecasts(with_expanding_garch(frame, val_end, every), train_end, val_end, None, length, epochs)


def garchx_forecasts(frame: DataFrame, val_end: str, aligned: bool = False) -> DataFrame:
    """(series_id, date, actual, baseline, hybrid, gamma): plain GARCH against one with lagged sentiment in the variance.

    Both are fitted up to `val_end` and scored after it. A day's variance is scored against the target of the same row;
    with `aligned` the next day's forecast is, which is made for the day that the target is of.
    """

    along = Window.partitionBy("series_id").orderBy("date")
    rows = frame.select("series_id", "date", "log_return", F.coalesce(F.lag("mean_sentiment").over(along).cast("double"), F.lit(0.0)).alias("x"), "target_next_vol")
    rows = rows.dropna(subset=["log_return", "target_next_vol"])
    known, blocks = rows.where(F.col("date") <= F.lit(val_end).cast("date")), garch.blocks_of(rows, "log_return", "x")
    sample = garch.sample_variance(blocks)
    plain, pushed = garch.fit_series(known), cut(garch.fit_series(known, exog="x"))
    value = F.sqrt(F.greatest(F.col("forecast_var" if aligned else "conditional_var"), F.lit(1e-12)))
    both = [garch.project(blocks, p.join(sample, "series_id"), exog).select("series_id", "date", value.alias(name)) for p, exog, name in ((plain, False, "baseline"), (pushed, True, "hybrid"))]
    out = rows.select("series_id", "date", F.col("target_next_vol").alias("actual")).join(both[0], ["series_id", "date"]).join(both[1], ["series_id", "date"])
    return out.join(pushed.select("series_id", "gamma"), "series_id").where(F.col("date") > F.lit(val_end).cast("date"))


def compare(forecasts: DataFrame) -> DataFrame:
    """Errors of both forecasts a series."""
    a = F.col("actual")
    names = [m.alias(f"{who}_{n}") for who in ("baseline", "hybrid") for m, n in zip(error_metrics(a, F.col(who)), ("rmse", "mae", "mape"), strict=True)]
    return forecasts.groupBy("series_id").agg(F.count("*").alias("n"), *names)
