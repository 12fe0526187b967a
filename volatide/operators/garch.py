"""AR(1)-GARCH(1,1), with or without an exogenous variable in the variance.

The variance and its derivatives are linear recurrences, so series are worked on in blocks (`recurrence`): each block's
map, a scan over a series' maps, then the rows. Likelihoods are minimised with their analytic score by a quasi-Newton
method over unconstrained parameters: omega = e^a, (alpha, beta) = 0.999 times two shares of three, phi = tanh b.
Series of up to LONGEST rows (counted) are fitted in one task each; for longer ones every evaluation is a Spark job over
the blocks, for all such series at once.

Defined results: rows without a return are left out; fewer than LEAST_ROWS returns are an error; series_id isn't null.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from volatide.functions.optimize import Minimiser, minimise
from volatide.operators.recurrence import BLOCK, packed, recur
from volatide.storage import cut

LEAST_ROWS = 30
#: Rows of a series that is fitted in one task at most.
LONGEST = 250_000
NAMES = ("c", "phi", "omega", "alpha", "beta", "gamma")
PARAMETERS = "c double, phi double, omega double, alpha double, beta double, gamma double, loss double"
#: Where the search starts, as (alpha, beta); the lowest minimum counts.
STARTS = ((0.08, 0.9), (0.05, 0.6), (0.2, 0.3))
TOO_SHORT = f"A GARCH fit takes at least {LEAST_ROWS} returns."


def residuals(y: np.ndarray, c: float, phi: float) -> np.ndarray:
    e = y - c
    e[1:] -= phi * y[:-1]
    return e


def seed_variance(sample: float, omega: float, alpha: float, beta: float) -> float:
    return max(sample, omega / max(1e-6, 1 - alpha - beta))


def seed(p: np.ndarray, sample: float) -> np.ndarray:
    """The first variance and its derivatives by the parameters."""
    room, out = max(1e-6, 1 - p[3] - p[4]), np.zeros(7)
    out[0] = seed_variance(sample, *p[2:5])
    if out[0] > sample:
        out[3] = 1 / room
        out[4] = out[5] = p[2] / room**2 if room > 1e-6 else 0.0
    return out


def pushes(p: np.ndarray, y: np.ndarray, x: np.ndarray | None, before: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Residuals, the return before each, and what each row adds to the next one's variance."""
    lag = np.concatenate([[0.0 if before is None else before], y[:-1]]) if len(y) else y
    e = y - p[0] - p[1] * lag
    return e, lag, p[2] + p[3] * e * e + (0.0 if x is None else p[5] * x)


def states(p: np.ndarray, y: np.ndarray, x: np.ndarray | None, before: float | None, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Residuals, the returns before them, and the variance with its derivatives at each row and after the last."""
    e, lag, u = pushes(p, y, x, before)
    v = recur(u[:, None], p[4], start[:1])[:, 0]
    inputs = np.column_stack([-2 * p[3] * e, -2 * p[3] * e * lag, np.ones(len(y)), e * e, v[:-1], np.zeros(len(y)) if x is None else x])
    return e, lag, np.column_stack([v, recur(inputs, p[4], start[1:])])


def moved(end: np.ndarray, n: int, beta: float, start: np.ndarray) -> np.ndarray:
    """The state after n rows from `start`, if `end` is the one from nothing."""
    out = beta**n * start + end
    out[5] += n * beta ** (n - 1) * start[0]
    return out


def score(e: np.ndarray, lag: np.ndarray, s: np.ndarray) -> tuple[float, np.ndarray]:
    """Negative log-likelihood and its derivatives."""
    v = s[:-1, 0]
    if not (np.isfinite(v).all() and (v > 0).all()):
        return np.inf, np.zeros(6)
    slope = (0.5 * (1 / v - (e / v) ** 2)) @ s[:-1, 1:]
    slope[0] -= (e / v).sum()
    slope[1] -= (e * lag / v).sum()
    return float(0.5 * (np.log(2 * np.pi) + np.log(v) + e * e / v).sum()), slope


def natural(t: np.ndarray, unit: float) -> np.ndarray:
    """Parameters of a point of the search; gamma is in `unit`s."""
    shares = np.exp(np.clip([t[3], t[4], 0.0], -30, 30))
    alpha, beta = 0.999 * shares[:2] / shares.sum()
    return np.array([t[0], math.tanh(t[1]), math.exp(min(max(t[2], -30), 30)), alpha, beta, t[5] * unit if len(t) > 5 else 0.0])


def by_point(t: np.ndarray, p: np.ndarray, slope: np.ndarray, unit: float) -> np.ndarray:
    """Derivatives by the point's coordinates."""
    a, b = p[3], p[4]
    out = [slope[0], slope[1] * (1 - p[1] ** 2), slope[2] * p[2], slope[3] * a * (1 - a / 0.999) - slope[4] * a * b / 0.999, slope[4] * b * (1 - b / 0.999) - slope[3] * a * b / 0.999]
    return np.array(out + ([slope[5] * unit] if len(t) > 5 else []))


def start_points(mean: float, sample: float, lagged: float, exog: bool, starts: tuple = STARTS) -> list[np.ndarray]:
    lagged = lagged if np.isfinite(lagged) and abs(lagged) < 0.9 else 0.05
    out = []
    for i, (a, b) in enumerate(starts):
        omega = sample * (0.05 if i == 0 else 1 - a - b)
        out.append(np.array([mean, math.atanh(lagged), math.log(max(omega, 1e-9)), math.log(a / (0.999 - a - b)), math.log(b / (0.999 - a - b))] + ([0.0] if exog else [])))
    return out


def fit(returns: np.ndarray, scale: float = 100.0, exog: np.ndarray | None = None) -> dict[str, float]:
    """Maximum likelihood of one series in memory; omega is in squared scaled units."""
    y = np.asarray(returns, float)
    keep = ~np.isnan(y)
    x = None if exog is None else np.nan_to_num(np.asarray(exog, float)[keep])
    y = y[keep] * scale
    if len(y) < LEAST_ROWS:
        raise ValueError(TOO_SHORT)
    sample = float(y.var(ddof=1))
    with np.errstate(all="ignore"):
        lagged = float(np.corrcoef(y[:-1], y[1:])[0, 1]) if sample > 0 else 0.05
    unit = 1.0 if x is None else sample / max(1e-300, float(np.sqrt(np.mean(x * x)))) or 1.0

    def f(t: np.ndarray) -> tuple[float, np.ndarray]:
        p = natural(t, unit)
        with np.errstate(all="ignore"):
            value, slope = score(*states(p, y, x, None, seed(p, sample)))
        return value / len(y), by_point(t, p, slope, unit) / len(y)

    t, value = min((minimise(f, t) for t in start_points(float(y.mean()), sample, lagged, x is not None)), key=lambda found: found[1])
    return dict(zip(NAMES, natural(t, unit).tolist(), strict=True)) | {"loss": float(value) * len(y)}


# Blocks: rows of packed(...) with the arrays y (scaled returns) and perhaps x, and y_before.


def blocks_of(df: DataFrame, column: str, exog: str | None = None, scale: float = 100.0, width: int = BLOCK) -> DataFrame:
    """(series_id, block, at, y, [x,] before, y_before, last); a null exogenous value counts as 0."""
    rows = df.where(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double")))
    columns = [(F.col(column) * scale).alias("y")] + ([F.coalesce(F.nanvl(F.col(exog).cast("double"), F.lit(0.0)), F.lit(0.0)).alias("x")] if exog else [])
    return packed(rows.select("series_id", "date", *columns), ["y"] + ["x"] * bool(exog), width=width).drop("x_before")


def _block(row, exog: bool) -> tuple[np.ndarray, np.ndarray | None, float | None]:
    before = row.y_before
    return np.asarray(row.y, float), np.asarray(row.x, float) if exog else None, None if before is None or np.isnan(before) else float(before)


def _scan(key: str | list[str], ends: DataFrame, width: int) -> DataFrame:
    """The state at the first row of each block: of (key, block, n, beta, end, seed)."""
    keys = [key] if isinstance(key, str) else key
    kinds = dict(ends.dtypes)

    def run(_, frame):
        frame = frame.sort_values("block")
        state, out = np.asarray(frame["seed"].iloc[0], float), []
        for n, beta, end in zip(frame["n"], frame["beta"], frame["end"]):
            out.append(state)
            state = moved(np.asarray(end, float), int(n), beta, state) if width == 7 else beta * state + end
        return frame[[*keys, "block"]].assign(start=out)

    return ends.groupBy(*keys).applyInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", block long, start array<double>")


def evaluate(blocks: DataFrame, trials: DataFrame, exog: bool) -> DataFrame:
    """(series_id, k, loss, slope) of the trials (series_id, k, p, sample): each a pass, a scan and a pass over the blocks."""
    tried = blocks.join(trials, "series_id")

    def ends(frames):
        for frame in frames:
            out = []
            for row in frame.itertuples():
                p, (y, x, before) = np.asarray(row.p), _block(row, exog)
                with np.errstate(all="ignore"):
                    end = states(p, y, x, before, np.zeros(7))[2][-1]
                out.append((row.series_id, row.k, row.block, len(y), p[4], end, seed(p, row.sample)))
            yield pd.DataFrame(out, columns=["series_id", "k", "block", "n", "beta", "end", "seed"])

    def sums(frames):
        for frame in frames:
            out = []
            for row in frame.itertuples():
                y, x, before = _block(row, exog)
                with np.errstate(all="ignore"):
                    value, slope = score(*states(np.asarray(row.p), y, x, before, np.asarray(row.start, float)))
                out.append((row.series_id, row.k, value, *slope))
            yield pd.DataFrame(out, columns=["series_id", "k", "loss", *NAMES])

    kind = dict(blocks.dtypes)["series_id"]
    found = tried.mapInPandas(ends, f"series_id {kind}, k int, block long, n int, beta double, end array<double>, seed array<double>")
    starts = _scan(["series_id", "k"], found, 7)
    each = tried.join(starts, ["series_id", "k", "block"]).mapInPandas(sums, f"series_id {kind}, k int, loss double, {', '.join(f'{n} double' for n in NAMES)}")
    return each.groupBy("series_id", "k").agg(F.sum("loss").alias("loss"), F.array(*[F.sum(n) for n in NAMES]).alias("slope"))


def facts(blocks: DataFrame, exog: bool) -> DataFrame:
    """(series_id, n, mean, sample, lagged, rms): size, moments, lag-1 correlation and the exogenous root mean square."""
    y = F.explode(F.arrays_zip("y", F.concat(F.array("y_before"), F.slice("y", 1, F.size("y") - 1)).alias("lag"), *["x"] * exog)).alias("r")
    rows = blocks.select("series_id", y).select("series_id", "r.y", "r.lag", *["r.x"] * exog)
    x = F.sqrt(F.avg(F.col("x") * F.col("x"))) if exog else F.lit(0.0)
    both = F.col("lag").isNotNull()
    return rows.groupBy("series_id").agg(F.count("*").alias("n"), F.avg("y").alias("mean"), F.coalesce(F.var_samp("y"), F.lit(0.0)).alias("sample"), F.corr(F.when(both, F.col("lag")), F.when(both, F.col("y"))).alias("lagged"), x.alias("rms"))


def fit_blocks(blocks: DataFrame, known: DataFrame, exog: bool = False, starts: tuple = STARTS[:1], rounds: int = 150, tolerance: float = 1e-7) -> DataFrame:
    """Parameters of every series, each evaluation a job over all blocks. `known` are their facts.

    What a search needs is kept in a row a series and start, in the shared folder; the driver only learns whether any still runs.
    """
    kind = dict(blocks.dtypes)["series_id"]
    schema = f"series_id {kind}, k int, n long, sample double, unit double, search array<double>, p array<double>, loss double"

    def begin(frames):
        for frame in frames:
            out = []
            for row in frame.itertuples():
                if row.n < LEAST_ROWS:
                    raise ValueError(TOO_SHORT)
                unit = (row.sample / max(1e-300, row.rms) or 1.0) if exog else 1.0
                for k, t in enumerate(start_points(row.mean, row.sample, float("nan") if row.lagged is None else row.lagged, exog, starts)):
                    search = Minimiser(t, tolerance, rounds)
                    out.append((row.series_id, k, row.n, row.sample, unit, search.state(), natural(t, unit), np.inf))
            yield pd.DataFrame(out, columns=["series_id", "k", "n", "sample", "unit", "search", "p", "loss"])

    def tell(frames):
        for frame in frames:
            out = []
            for row in frame.itertuples():
                search = Minimiser.restored(list(row.search))
                if not search.done:
                    slope = by_point(search.trial, np.asarray(row.p), np.asarray(row.slope, float), row.unit)
                    search.tell(row.value / row.n, slope / row.n)
                out.append((row.series_id, row.k, row.n, row.sample, row.unit, search.state(), natural(search.at if search.done else search.trial, row.unit), search.value * row.n))
            yield pd.DataFrame(out, columns=["series_id", "k", "n", "sample", "unit", "search", "p", "loss"])

    searches = cut(known.mapInPandas(begin, schema))
    done = F.col("search")[6] == 1.0
    while not searches.where(~done).isEmpty():
        found = evaluate(blocks, searches.where(~done).select("series_id", "k", "p", "sample"), exog)
        told = searches.join(found.withColumnRenamed("loss", "value"), ["series_id", "k"], "left").withColumn("slope", F.coalesce("slope", F.array_repeat(F.lit(0.0), 6)))
        searches = cut(told.mapInPandas(tell, schema))
    best = searches.groupBy("series_id").agg(F.min_by("p", "loss").alias("p"), F.min("loss").alias("loss"))
    return best.select("series_id", *[F.col("p")[i].alias(n) for i, n in enumerate(NAMES)], "loss")


def fit_packed(blocks: DataFrame, exog: bool = False, longest: int = LONGEST) -> DataFrame:
    """Parameters of every series: short ones in a task each, long ones over their blocks."""
    kind = dict(blocks.dtypes)["series_id"]
    sizes = blocks.groupBy("series_id").agg(F.max(F.col("before") + F.size("y")).alias("rows"))

    def run(key, frame):
        frame = frame.sort_values("block")
        x = np.concatenate(frame["x"].to_list()) if exog else None
        return pd.DataFrame([{"series_id": key[0], **fit(np.concatenate(frame["y"].to_list()), 1.0, x)}])

    short = blocks.join(sizes.where(F.col("rows") <= longest), "series_id").select("series_id", "block", "y", *["x"] * exog)
    out = short.groupBy("series_id").applyInPandas(run, f"series_id {kind}, {PARAMETERS}")
    long = sizes.where(F.col("rows") > longest).select("series_id")
    if long.isEmpty():
        return out
    rest = cut(blocks.join(long, "series_id", "left_semi"))
    return out.unionByName(fit_blocks(rest, facts(rest, exog), exog))


def fit_series(df: DataFrame, column: str = "log_return", exog: str | None = None, longest: int = LONGEST) -> DataFrame:
    """Parameters of each series."""
    return fit_packed(blocks_of(df, column, exog), exog is not None, longest)


def sample_variance(blocks: DataFrame, until: Column | None = None) -> DataFrame:
    """(series_id, sample) of the rows up to a date."""
    rows = blocks.select("series_id", F.explode(F.arrays_zip("at", "y")).alias("r"))
    value = F.col("r.y") if until is None else F.when(F.col("r.at") <= until, F.col("r.y"))
    return rows.groupBy("series_id").agg(F.coalesce(F.var_samp(value), F.lit(0.0)).alias("sample"))


def project(blocks: DataFrame, parameters: DataFrame, exog: bool = False, scale: float = 100.0, floor: float | None = None) -> DataFrame:
    """(series_id, date, conditional_var, forecast_var, std_resid) for parameters (series_id, NAMES, sample)."""
    kind, at = dict(blocks.dtypes)["series_id"], dict(blocks.dtypes)["at"].removeprefix("array<").removesuffix(">")
    both = blocks.join(parameters.select("series_id", F.array(*NAMES).alias("p"), "sample"), "series_id")

    def ends(frames):
        for frame in frames:
            out = []
            for row in frame.itertuples():
                p, (y, x, before) = np.asarray(row.p), _block(row, exog)
                end = recur(pushes(p, y, x, before)[2][:, None], p[4], np.zeros(1))[-1]
                out.append((row.series_id, row.block, len(y), p[4] ** len(y), end, seed(p, row.sample)[:1]))
            yield pd.DataFrame(out, columns=["series_id", "block", "n", "beta", "end", "seed"])

    def rows(frames):
        for frame in frames:
            for row in frame.itertuples():
                p, (y, x, before) = np.asarray(row.p), _block(row, exog)
                e, _, u = pushes(p, y, x, before)
                s = recur(u[:, None], p[4], np.asarray(row.start, float))[:, 0]
                v, ahead = s[:-1], s[1:].copy()
                if row.last:  # the next shock is unknown
                    ahead[-1] = p[2] + (p[3] + p[4]) * v[-1] + (p[5] * x[-1] if exog else 0.0)
                if exog:
                    ahead = np.maximum(ahead, 1e-12)
                yield pd.DataFrame({"series_id": row.series_id, "date": row.at, "conditional_var": v / scale**2, "forecast_var": ahead / scale**2, "std_resid": e / np.sqrt(v)})

    starts = _scan("series_id", both.mapInPandas(ends, f"series_id {kind}, block long, n int, beta double, end array<double>, seed array<double>"), 1)
    return both.join(starts, ["series_id", "block"]).mapInPandas(rows, f"series_id {kind}, date {at}, conditional_var double, forecast_var double, std_resid double")


def filter_series(df: DataFrame, parameters: dict[str, float], column: str = "log_return", exog: str | None = None, sample_until: str | None = None, width: int = BLOCK) -> DataFrame:
    """(series_id, date, conditional_var, forecast_var, std_resid) for fixed parameters."""
    blocks = blocks_of(df, column, exog, width=width)
    sample = sample_variance(blocks, None if sample_until is None else F.lit(sample_until).cast("date"))
    return project(blocks, sample.select("series_id", "sample", *[F.lit(float(parameters[n])).alias(n) for n in NAMES]), exog is not None)


def filter_fitted(df: DataFrame, parameters: DataFrame, column: str = "log_return") -> DataFrame:
    """(series_id, date, conditional_var, forecast_var, std_resid) for each series' own parameters."""
    blocks = blocks_of(df, column)
    return project(blocks, parameters.join(sample_variance(blocks), "series_id"))


def add_features(df: DataFrame, train_end: str, column: str = "log_return", target: str = "target_next_vol", parameters: DataFrame | None = None) -> DataFrame:
    """Fit on dates up to `train_end` (or take the parameters), project over all, and add the garch columns and the residual target."""
    last = F.lit(train_end).cast("date")
    if parameters is None:
        parameters = fit_series(df.where(F.col("date") <= last), column)
    blocks = blocks_of(df, column)
    found = project(blocks, parameters.join(sample_variance(blocks, last), "series_id"))
    named = {"garch_conditional_vol": F.sqrt("conditional_var"), "garch_forecast_vol": F.sqrt("forecast_var"), "garch_conditional_var": F.col("conditional_var"), "garch_forecast_var": F.col("forecast_var"), "garch_std_resid": F.col("std_resid")}
    out = df.join(found.select("series_id", "date", *[c.alias(n) for n, c in named.items()]), ["series_id", "date"], "left")
    return out.withColumn("hybrid_residual_target", F.col(target) - F.col("garch_forecast_vol"))


#: Groups of re-fits of a series that run in parallel, each with the rows before its last one.
REFIT_GROUPS = 8


def refits(blocks: DataFrame, ends: DataFrame, every: int, longest: int = LONGEST) -> DataFrame:
    """(series_id, cut, NAMES, loss) of `ends` (series_id, first, n): fits of the rows before first, first + every, ... A failed one is left out."""
    kind = dict(blocks.dtypes)["series_id"]
    cuts = ends.where(F.col("n") > F.col("first")).select("series_id", F.explode(F.sequence("first", F.col("n") - 1, F.lit(every))).alias("cut"))
    # Dealt by rank, so that each group's rows are those before its last cut.
    dealt = cuts.join(ends, "series_id").withColumn("cuts", F.ceil((F.col("n") - F.col("first")) / every))
    dealt = dealt.withColumn("job", F.floor((F.col("cut") - F.col("first")) / every / F.ceil(F.col("cuts") / REFIT_GROUPS)).cast("int"))
    jobs = dealt.where(F.col("cut") <= longest).groupBy("series_id", "job").agg(F.sort_array(F.collect_list("cut")).alias("cuts"))

    def run(key, frame):
        frame = frame.sort_values("block")
        y, found = np.concatenate(frame["y"].to_list()), []
        for at in frame["cuts"].iloc[0]:
            try:
                found.append({"series_id": key[0], "cut": at, **fit(y[:at], 1.0)})
            except (ValueError, np.linalg.LinAlgError):
                continue
        return pd.DataFrame(found, columns=["series_id", "cut", *NAMES, "loss"])

    needed = blocks.select("series_id", "block", "before", "y").join(jobs, "series_id").where(F.col("before") < F.element_at("cuts", -1))
    out = needed.groupBy("series_id", "job").applyInPandas(run, f"series_id {kind}, cut int, {PARAMETERS}")
    long = cuts.where(F.col("cut") > longest)
    if long.isEmpty():
        return out
    # Each long cut is a series of its own, of the blocks before it.
    apart = blocks.join(long, "series_id").where(F.col("before") < F.col("cut"))
    apart = apart.withColumn("y", F.slice("y", 1, F.least(F.size("y"), (F.col("cut") - F.col("before")).cast("int"))))
    apart = cut(apart.withColumn("series_id", F.to_json(F.struct("series_id", "cut"))))
    found = fit_blocks(apart, facts(apart, False)).withColumn("key", F.from_json("series_id", f"series_id {kind}, cut int"))
    return out.unionByName(found.select("key.series_id", "key.cut", *NAMES, "loss"))


def expanding(df: DataFrame, train_rows: int | None = None, every: int = 21, column: str = "log_return", train_end: str | None = None, width: int = BLOCK, longest: int = LONGEST) -> DataFrame:
    """(series_id, date, conditional_vol, forecast_vol, std_resid) with parameters re-fitted as rows arrive.

    The first fit is of the first `train_rows` rows, or of those up to `train_end`. Each re-fit sees only rows before its
    date; then the recurrence, whose parameters change at the re-fit dates, is scanned in blocks. A failed re-fit keeps
    the parameters before it. A re-fit recomputes past residuals but not past variances.
    """
    if (train_rows is None) == (train_end is None):
        raise ValueError("Either train_rows or train_end says where the first fit ends.")
    blocks = cut(blocks_of(df, column, width=width))
    kind, at = dict(blocks.dtypes)["series_id"], dict(blocks.dtypes)["at"].removeprefix("array<").removesuffix(">")
    rows = blocks.select("series_id", "block", "before", F.posexplode(F.arrays_zip("at", "y")).alias("i", "r")).withColumn("i", (F.col("before") + F.col("i")).cast("int"))
    early = F.lit(train_rows) if train_end is None else F.count(F.when(F.col("r.at") <= F.lit(train_end).cast("date"), 1))
    ends = rows.groupBy("series_id").agg(early.cast("int").alias("first"), F.count("*").cast("int").alias("n"))
    ends = cut(ends.join(rows.join(ends.select("series_id", "first"), "series_id").where(F.col("i") < F.col("first")).groupBy("series_id").agg(F.var_samp("r.y").alias("sample")), "series_id", "left"))
    fits = cut(refits(blocks, ends.select("series_id", "first", "n"), every, longest).select("series_id", "cut", F.array(*NAMES).alias("p")))
    # The fits inside a block, the last one before it, and one that begins with the next block.
    own = rows.select("series_id", "block", "i").join(fits, (rows["series_id"] == fits["series_id"]) & (F.col("i") == F.col("cut"))).groupBy(rows["series_id"], "block").agg(F.sort_array(F.collect_list(F.struct("cut", "p"))).alias("own"))
    along = Window.partitionBy("series_id").orderBy("block")
    near = blocks.select("series_id", "block").join(own, ["series_id", "block"], "left").select(
        "series_id",
        "block",
        "own",
        F.last(F.element_at("own", -1), ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1))["p"].alias("entering"),
        F.lead(F.get("own", F.lit(0))).over(along).alias("leaving"),
    )
    firsts = ends.where(F.col("n") > F.col("first")).join(fits, (ends["series_id"] == fits["series_id"]) & (F.col("cut") == F.col("first")), "left").select(ends["series_id"], "sample", F.col("p").alias("p0"))
    lasts = fits.groupBy("series_id").agg(F.max_by("p", "cut").alias("p_last"), F.max("cut").alias("cut_last"))
    both = blocks.join(near, ["series_id", "block"]).join(firsts, "series_id").join(lasts, "series_id", "left")

    def steps(row):
        """Of each row: parameters, residual, and the next row's b and input."""
        if row.p0 is None:
            raise ValueError(f"The first fit of series {row.series_id} failed.")
        y, _, before = _block(row, False)
        lag, p0, i0 = np.concatenate([[0.0 if before is None else before], y[:-1]]), np.asarray(row.p0), int(row.before)
        found = {int(c["cut"]): np.asarray(c["p"]) for c in (row.own if row.own is not None else [])}
        if row.leaving is not None:
            found[int(row.leaving["cut"])] = np.asarray(row.leaving["p"])
        p = p0 if row.entering is None else np.asarray(row.entering)
        of, e, b, u = [], np.empty(len(y)), np.empty(len(y)), np.empty(len(y))
        for t in range(len(y)):
            here, ahead = found.get(i0 + t), found.get(i0 + t + 1)
            p = p if here is None else here
            residual = lambda q, t=t: y[t] - q[0] - q[1] * lag[t]
            e[t] = residual(p0 if here is None else here)
            q, used = (p, e[t]) if ahead is None else (ahead, residual(ahead))
            of.append(p)
            b[t], u[t] = q[4], q[2] + q[3] * used**2
        return np.array(of), e, b, u, y, lag

    def block_ends(frames):
        for frame in frames:
            out = []
            for row in frame.itertuples():
                _, _, b, u, _, _ = steps(row)
                end = 0.0
                for x, y in zip(b, u):
                    end = y + x * end
                out.append((row.series_id, row.block, len(b), float(np.prod(b)), [end], [seed(np.asarray(row.p0), row.sample)[0]]))
            yield pd.DataFrame(out, columns=["series_id", "block", "n", "beta", "end", "seed"])

    def walked(frames):
        for frame in frames:
            for row in frame.itertuples():
                of, e, b, u, y, lag = steps(row)
                v = np.empty(len(b))
                last = float(row.start[0])
                for t in range(len(b)):
                    v[t] = last
                    last = u[t] + b[t] * last
                ahead = of[:, 2] + of[:, 3] * e**2 + of[:, 4] * v
                if row.last:
                    ahead[-1] = of[-1, 2] + (of[-1, 3] + of[-1, 4]) * v[-1]
                if row.p_last is not None:
                    seen = np.arange(len(b)) + row.before <= row.cut_last
                    e = np.where(seen, y - row.p_last[0] - row.p_last[1] * lag, e)
                yield pd.DataFrame({"series_id": row.series_id, "date": row.at, "conditional_vol": np.sqrt(v) / 100, "forecast_vol": np.sqrt(ahead) / 100, "std_resid": e / np.sqrt(v)})

    starts = _scan("series_id", both.mapInPandas(block_ends, f"series_id {kind}, block long, n int, beta double, end array<double>, seed array<double>"), 1)
    return both.join(starts, ["series_id", "block"]).mapInPandas(walked, f"series_id {kind}, date {at}, conditional_vol double, forecast_vol double, std_resid double")


def grid(df: DataFrame, alphas: list[float], betas: list[float], column: str = "log_return") -> DataFrame:
    """(series_id, alpha, beta, loss) of a fixed grid, variance-targeted, without an AR term."""
    points = [(a, b) for a in alphas for b in betas if a + b < 0.999]
    blocks = blocks_of(df, column)
    k = F.posexplode(F.array(*[F.struct(F.lit(float(a)).alias("alpha"), F.lit(float(b)).alias("beta")) for a, b in points])).alias("k", "x")
    trials = sample_variance(blocks).select("series_id", "sample", k).select("series_id", "sample", "k", "x.alpha", "x.beta")
    zero, omega = F.lit(0.0), F.col("sample") * (1 - F.col("alpha") - F.col("beta"))
    trials = cut(trials.withColumn("p", F.array(zero, zero, omega, "alpha", "beta", zero)))
    return evaluate(blocks, trials.select("series_id", "k", "p", "sample"), False).join(trials, ["series_id", "k"]).select("series_id", "alpha", "beta", "loss")


def validate(filtered: DataFrame, parameters: DataFrame) -> DataFrame:
    """Stationarity, and Ljung-Box on squared standardised residuals at lags 5 and 10."""
    from volatide.operators.stats import ljung_box

    squared = filtered.withColumn("z2", F.col("std_resid") * F.col("std_resid"))
    tests = ljung_box(squared, "z2").groupBy("series_id").agg(F.max(F.when(F.col("lag") == 5, F.col("p"))).alias("p5"), F.max(F.when(F.col("lag") == 10, F.col("p"))).alias("p10"))
    out = parameters.withColumn("alpha_plus_beta", F.col("alpha") + F.col("beta")).join(tests, "series_id")
    return out.select("series_id", "alpha_plus_beta", (F.col("alpha_plus_beta") < 1).alias("stationary"), "p5", "p10", ((F.col("p5") > 0.05) & (F.col("p10") > 0.05)).alias("no_remaining_arch_effects"))
