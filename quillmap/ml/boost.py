"""Boosted stumps: AdaBoost, RUSBoost and EasyEnsemble.

Features are binned once by their quantiles. A round sums the weights of both classes by feature and bin, one aggregation that
combines before the shuffle to a few hundred rows, and the best split is read off the sums. A stump is a feature, a threshold
and a value on either side; a row's margin is a column to which each round adds its stump, and which is written every
``EVERY`` rounds, so a round costs the same however many came before.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmap.operators.sampling import draw
from quillmap.session import cut


@dataclass
class Stump:
    feature: int
    threshold: float
    left: float
    right: float

    def value(self) -> Column:
        return F.when(F.col("_x")[self.feature] <= self.threshold, self.left).otherwise(self.right)


@dataclass
class Boosted:
    """A sum of stumps; above 0 means class 1."""

    stumps: list[Stump]

    def margin(self) -> Column:
        total = F.lit(0.0)
        for s in self.stumps:
            total = total + s.value()
        return total

    def scored(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``score``, the logistic of twice the margin."""
        x = rows.withColumn("_x", vector_to_array("features"))
        return x.withColumn("score", 1 / (1 + F.exp(-2 * self.margin()))).drop("_x")


BINS = 32
#: Rounds after which the margins are written, so that their expression stays short.
EVERY = 20


def _edges(data: DataFrame, dims: int) -> list[list[float]]:
    """Thresholds of each feature: distinct quantiles, at most ``BINS`` - 1."""
    columns = data.select(*[F.col("_x")[j].alias(f"x{j}") for j in range(dims)])
    cuts = columns.approxQuantile(columns.columns, [i / BINS for i in range(1, BINS)], 0.002)
    return [sorted(set(c)) for c in cuts]


def _bin(x: Column, cuts: list[float]) -> Column:
    return F.size(F.filter(F.array(*[F.lit(t) for t in cuts]).cast("array<double>"), lambda t: x > t))


def _split(weighted: DataFrame, edges: list[list[float]]) -> tuple[int, float, tuple[float, float], tuple[float, float]] | None:
    """Feature, threshold and class sums of both sides for the least Gini impurity; None where no feature splits the rows."""
    sums = (
        weighted.select("label", "w", F.posexplode("_bins").alias("feature", "bin"))
        .groupBy("feature", "bin")
        .agg(F.sum(F.when(F.col("label") == 0, F.col("w")).otherwise(0.0)).alias("w0"), F.sum(F.when(F.col("label") == 1, F.col("w")).otherwise(0.0)).alias("w1"))
        .orderBy("feature", "bin")
        .collect()
    )
    best, found = float("inf"), None
    for j, cuts in enumerate(edges):
        own = {r["bin"]: (r["w0"], r["w1"]) for r in sums if r["feature"] == j}
        all0, all1 = sum(v[0] for v in own.values()), sum(v[1] for v in own.values())
        left0 = left1 = 0.0
        for i, cut in enumerate(cuts):
            left0, left1 = left0 + own.get(i, (0.0, 0.0))[0], left1 + own.get(i, (0.0, 0.0))[1]
            sides = (left0, left1), (all0 - left0, all1 - left1)
            if min(sum(s) for s in sides) <= 1e-12 * (all0 + all1):
                continue
            impurity = sum(2 * s[0] * s[1] / sum(s) for s in sides)
            if impurity < best - 1e-12:
                best, found = impurity, (j, cut, *sides)
    return found


def adaboost(rows: DataFrame, rounds: int = 10, rate: float = 1.0, real: bool = True, undersample: bool = False, seed: int = 1) -> Boosted:
    """AdaBoost of stumps on ``features`` and ``label``; ``real`` adds half log odds (SAMME.R), else votes by error (SAMME).

    With ``undersample`` each round fits on all rows of the smaller class and a fresh sample of about as many others (RUSBoost).
    Stops early when no split is left or, voting, when a stump is no better than chance.
    """
    data = rows.select("features", "label", F.xxhash64(F.col("features").cast("string"), F.rand(seed)).alias("_key") if "feat_id" not in rows.columns else F.col("feat_id").alias("_key"))
    data = data.withColumn("_x", vector_to_array("features")).persist()
    n1, n = data.agg(F.sum("label"), F.count(F.lit(1))).first()
    out = Boosted([])
    try:
        if not n1 or n1 == n:
            out.stumps.append(Stump(0, 0.0, *([3.0, 3.0] if n1 else [-3.0, -3.0])))
            return out
        small, ratio = (1, n1 / (n - n1)) if n1 * 2 <= n else (0, (n - n1) / n1)
        edges = _edges(data, len(data.first()["_x"]))
        # a row's bin of a feature is the number of thresholds below it
        bins = [_bin(F.col("_x")[j], cuts) for j, cuts in enumerate(edges)]
        # rounds over few rows cost as many tasks as there are partitions
        state = cut(data.select("label", "_key", "_x", F.array(*bins).alias("_bins"), F.lit(0.0).alias("margin")).coalesce(n // 100_000 + 1))
        y = F.col("label") * 2 - 1
        for step in range(rounds):
            grow = F.exp(F.greatest(F.least(-y * F.col("margin"), F.lit(30.0)), F.lit(-30.0)))
            weighted = state.withColumn("w", grow)
            if undersample:
                weighted = weighted.where((F.col("label") == small) | (draw(F.col("_key"), seed * 1000 + step) < ratio * (1 << 32)))
            got = _split(weighted, edges)
            if got is None:
                break
            at, edge, left, right = got
            total = sum(left) + sum(right)
            tiny = 1e-6 * total
            if real:
                values = [rate * 0.5 * log((s[1] + tiny) / (s[0] + tiny)) for s in (left, right)]
            else:
                sides = [1.0 if s[1] > s[0] else -1.0 for s in (left, right)]
                wrong = sum(min(s) for s in (left, right)) / total
                if wrong >= 0.5:
                    break
                values = [rate * 0.5 * log((1 - wrong + 1e-9) / (wrong + 1e-9)) * v for v in sides]
            out.stumps.append(Stump(at, edge, *values))
            state = state.withColumn("margin", F.col("margin") + out.stumps[-1].value())
            if (step + 1) % EVERY == 0:
                state = cut(state)
        return out
    finally:
        data.unpersist()


def searched(rows: DataFrame, rates: tuple[float, ...] = (0.5, 1.0), rounds: tuple[int, ...] = (10, 20, 40), folds: int = 2, row_id: str = "feat_id", seed: int = 1, **kw) -> Boosted:
    """AdaBoost at the rate and number of rounds with the best F1 of class 1 in cross-validation, fitted again on all rows.

    One fit of the most rounds serves all numbers of rounds: its first stumps are the shorter fits, and all are scored on the
    held-out rows in one pass. Fits of different rates and folds run side by side.
    """
    data = rows.withColumn("_fold", F.pmod(F.xxhash64(row_id, F.lit(seed)), F.lit(folds)))

    def tried(job: tuple[float, int]) -> dict[tuple[float, int], float]:
        rate, fold = job
        model = adaboost(data.where(F.col("_fold") != fold).drop("_fold"), max(rounds), rate, seed=seed, **kw)
        held = data.where(F.col("_fold") == fold).withColumn("_x", vector_to_array("features"))
        told = held.select("label", *[(Boosted(model.stumps[:r]).margin() > 0).cast("int").alias(f"p{r}") for r in rounds])
        f1 = [(2 * F.count_if((F.col("label") == 1) & (F.col(f"p{r}") == 1)) / F.nullif(F.sum("label") + F.sum(f"p{r}"), F.lit(0))).alias(f"p{r}") for r in rounds]
        got = told.agg(*f1).first()
        return {(rate, r): got[f"p{r}"] or 0.0 for r in rounds}

    with ThreadPool(4) as pool:
        each = pool.map(inheritable_thread_target(rows.sparkSession)(tried), [(rate, fold) for rate in rates for fold in range(folds)])
    mean = {k: sum(e[k] for e in each if k in e) / folds for k in {k for e in each for k in e}}
    rate, most = max(sorted(mean), key=lambda k: (mean[k], -k[1]))
    return adaboost(rows, most, rate, seed=seed, **kw)


def easy_ensemble(rows: DataFrame, bags: int = 3, rounds: int = 5, seed: int = 1) -> Boosted:
    """The mean of AdaBoost models, each on all of the smaller class and its own sample of the larger. No rows, or rows of one class, give no stumps."""
    n1, n = rows.agg(F.coalesce(F.sum("label"), F.lit(0)), F.count(F.lit(1))).first()
    if n1 in (0, n):
        return Boosted([])
    small, ratio = (1, n1 / (n - n1)) if n1 * 2 <= n else (0, (n - n1) / n1)
    stumps = []
    for bag in range(bags):
        own = rows.where((F.col("label") == small) | (draw(F.col("feat_id"), seed * 7919 + bag) < ratio * (1 << 32)))
        stumps += [Stump(s.feature, s.threshold, s.left / bags, s.right / bags) for s in adaboost(own, rounds, seed=seed + bag).stumps]
    return Boosted(stumps)
