"""Estimators that simulate: one group of draws at a time, seeded by its key, so groups do not move one another.

Groups are cells of an experiment, tens of draws by design; equal draws of a larger cell are counted before they meet.
"""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIMULATIONS, RESAMPLES = 20000, 2000
#: Counts drawn at once.
CHUNK = 2_000_000


def _counted(draws: DataFrame, *keys: str) -> DataFrame:
    return draws.groupBy(*keys, "perfect", "usd").agg(F.count("*").alias("n"))


def best_of_k(draws: DataFrame, k: int) -> DataFrame:
    """Chance that one of ``k`` draws is perfect, with a bootstrap interval."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        cell, n, won = rows.cell.iloc[0], int(rows.n.sum()), int(rows.n[rows.perfect == 1].sum())
        rng = np.random.default_rng(zlib.crc32(cell.encode()))
        sample = np.sort(1 - (1 - rng.binomial(n, won / n, RESAMPLES) / n) ** k)
        return pd.DataFrame({"cell": [cell], "n": [n], "point": [1 - (1 - won / n) ** k], "lo": [sample[int(0.025 * RESAMPLES)]], "hi": [sample[int(0.975 * RESAMPLES) - 1]]})

    return _counted(draws, "cell").groupBy("cell").applyInPandas(run, "cell string, n long, point double, lo double, hi double")


def _key(rows: pd.DataFrame, keys: tuple[str, ...]) -> list:
    return [rows[k].iloc[0] for k in keys]


def _simulated(rows: pd.DataFrame, keys: tuple[str, ...], prior: float):
    """Cost of a draw by bootstrap over the chance of success by its Beta posterior."""
    import numpy as np

    n, won = int(rows.n.sum()), int(rows.n[rows.perfect == 1].sum())
    rng = np.random.default_rng(zlib.crc32(f"{'|'.join(map(str, _key(rows, keys)))}:{prior}".encode()))
    chance = rng.beta(won + prior, n - won + prior, SIMULATIONS)
    usd, share, step = rows.usd.to_numpy(), (rows.n / n).to_numpy(), max(1, CHUNK // len(rows))
    means = [rng.multinomial(n, share, min(step, SIMULATIONS - at)) @ usd / n for at in range(0, SIMULATIONS, step)]
    return np.concatenate(means) / chance, n, won


def cost_per_success(draws: DataFrame, keys: tuple[str, ...] = ("model",)) -> DataFrame:
    """Median and interval by cell, which ``keys`` name, under two priors; null without a success or with an unpriced
    draw."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        out = []
        for prior in (0.5, 1.0):
            won = rows.n[rows.perfect == 1].sum()
            if not won or rows.usd.isna().any():
                out.append((*_key(rows, keys), prior, None, None, None))
                continue
            cost, _, _ = _simulated(rows, keys, prior)
            out.append((*_key(rows, keys), prior, *np.quantile(cost, (0.5, 0.025, 0.975))))
        return pd.DataFrame(out, columns=[*keys, "prior", "median", "lo", "hi"])

    schema = ", ".join(f"{k} string" for k in keys)
    return _counted(draws, *keys).groupBy(*keys).applyInPandas(run, f"{schema}, prior double, median double, lo double, hi double")


def settled_pairs(draws: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of models that share ``within``, the cheaper first, and the chance that it is cheaper for each success;
    settled if that is at least 0.975 under both priors.  A cell with an unpriced draw is void: a part of its bill
    understates it."""
    keys = (*within, "model")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        n, won = int(rows.n.sum()), int(rows.n[rows.perfect == 1].sum())
        if n < 3 or not won or rows.usd.isna().any():
            return pd.DataFrame(columns=[*keys, "point", "half", "one"], dtype=object)
        cost = [_simulated(rows, keys, p)[0].tolist() for p in (0.5, 1.0)]
        named = {k: [v] for k, v in zip(keys, _key(rows, keys), strict=True)}
        return pd.DataFrame({**named, "point": [float((rows.usd * rows.n).sum() / won)], "half": [cost[0]], "one": [cost[1]]})

    schema = ", ".join(f"{k} string" for k in keys)
    s = _counted(draws, *keys).groupBy(*keys).applyInPandas(run, f"{schema}, point double, half array<double>, one array<double>")
    a, b = s.alias("a"), s.alias("b")
    on = (F.col("a.point") < F.col("b.point")) | ((F.col("a.point") == F.col("b.point")) & (F.col("a.model") < F.col("b.model")))
    for k in within:
        on = (F.col(f"a.{k}") == F.col(f"b.{k}")) & on
    j = a.join(b, on)
    less = lambda c: F.aggregate(F.zip_with(F.col(f"a.{c}"), F.col(f"b.{c}"), lambda x, y: (x < y).cast("int")), F.lit(0), lambda t, x: t + x) / SIMULATIONS
    d = j.select(*(F.col(f"a.{k}").alias(k) for k in within), F.col("a.model").alias("cheaper"), F.col("b.model").alias("dearer"), less("half").alias("p_half"), less("one").alias("p_one"))
    return d.withColumn("settled", F.least("p_half", "p_one") >= 0.975)


def false_discovery(pairs: DataFrame, *within: str) -> DataFrame:
    """Settled pairs, and how many of them are to be expected wrong: each by what its lesser chance leaves open."""
    settled_ = pairs.where("settled").groupBy(*within) if within else pairs.where("settled")
    return settled_.agg(F.count("*").alias("settled"), F.round(F.sum(1 - F.least("p_half", "p_one")), 6).alias("expected_wrong"))


def spearman_interval(points: DataFrame, x: str, y: str, resamples: int = 5000, seed: int = 7) -> DataFrame:
    """Spearman's rho with average ranks, and its interval over resamples of the points: models, of which there are few."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        n, rng, found = len(rows), np.random.default_rng(seed), []
        rho = lambda d: d[x].rank().corr(d[y].rank())
        for _ in range(resamples):
            r = rho(rows.iloc[rng.integers(0, n, n)])
            if r == r:  # a resample of one point has none
                found.append(r)
        found = np.sort(found)
        ends = [found[int(0.025 * len(found))], found[int(0.975 * len(found)) - 1]] if len(found) else [None, None]
        return pd.DataFrame({"n": [n], "rho": [rho(rows)], "lo": ends[:1], "hi": ends[1:]})

    return points.select(F.lit(0).alias("all"), F.col(x).cast("double").alias(x), F.col(y).cast("double").alias(y)).groupBy("all").applyInPandas(run, "n long, rho double, lo double, hi double")


def best_of_k_orders(draws: DataFrame, k: int, orders: int = 2000) -> DataFrame:
    """Tries until the first success within ``k``, and the chance of one, over random orders of each cell's draws."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        cell, n, won = rows.cell.iloc[0], int(rows.n.sum()), int(rows.n[rows.perfect == 1].sum())
        rng = np.random.default_rng(zlib.crc32(f"orders:{cell}".encode()))
        hits = np.arange(n) < won
        tried = np.array([rng.permutation(hits)[:k] for _ in range(orders)])
        first = np.where(tried.any(1), tried.argmax(1) + 1, tried.shape[1])
        return pd.DataFrame({"cell": [cell], "n": [n], "chance": [tried.any(1).mean()], "tries": [first.mean()]})

    return _counted(draws, "cell").groupBy("cell").applyInPandas(run, "cell string, n long, chance double, tries double")
