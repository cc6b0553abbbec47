"""Bayesian linear head: standardizer, MAP fit, diagonal curvature and posterior predictive."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import probability as P
from ..sources.shared import staged
from . import metrics

FLOOR = 1e-6


def features(embeddings: DataFrame) -> DataFrame:
    return embeddings.select(
        "vec_id", F.col("embedding").cast("array<double>").alias("x"), (F.col("label") >= 5).cast("int").alias("target"), (F.col("vec_id") % 5).alias("fold")
    )


def standardizer(rows: DataFrame) -> DataFrame:
    """Mean and population deviation of each dimension, the deviation floored."""
    flat = rows.select(F.posexplode("x").alias("dim", "v"))
    return flat.groupBy("dim").agg(F.avg("v").alias("mean"), F.greatest(F.stddev_pop("v"), F.lit(FLOOR)).alias("scale"))


def _dot(x: str, weights: Column) -> Column:
    return F.aggregate(F.zip_with(x, weights, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def diagonal(rows: DataFrame, weights: DataFrame, prior: float = 1.0) -> DataFrame:
    """Diagonal curvature: prior and the sum of p (1 - p) x squared, in each dimension, for given ``weights`` (dim, w).

    The dot product is made inside the row; what is shuffled is a partial sum for each dimension of a task."""
    # One row, as long as a vector.
    line = weights.agg(F.array_sort(F.collect_list(F.struct("dim", "w"))).getField("w").alias("w"))
    p = 1 / (1 + F.exp(-_dot("x", F.col("w"))))
    curved = rows.select("x").join(F.broadcast(line), F.lit(True)).select(F.col("x"), (p * (1 - p)).alias("c"))
    return curved.select(F.posexplode(F.transform("x", lambda v: F.col("c") * v * v)).alias("dim", "v")).groupBy("dim").agg((F.lit(prior) + F.sum("v")).alias("curvature"))


#: Partial sums that one task adds up, and rows of the Hessian that travel as one.
FAN, BLOCK_DIMS = 64, 16


def tree_sum(parts: DataFrame, fan: int = FAN) -> DataFrame:
    """Sums arrays by ``block``: ``parts`` (part, block, values) has as many rows a block as there were tasks; ``fan`` groups of them are
    added first, then those. So no task and no driver holds more than one in ``fan`` of the rows of a block."""

    def add(rows: pa.Table) -> pa.Table:
        values = rows["values"].combine_chunks()
        total = np.add.reduce(values.values.to_numpy().reshape(len(rows), -1), axis=0)
        return pa.table({"part": [rows["near"][0].as_py()], "block": rows["block"][:1], "values": pa.array([total], pa.list_(pa.float64()))})

    out = parts
    for near in (F.col("part") % fan, F.lit(0)):
        out = out.withColumn("near", near.cast("long")).groupBy("block", "near").applyInArrow(add, "part long, block int, values array<double>")
    return out.select("block", "values")


def fit_map(rows: DataFrame, prior: float = 1.0, rounds: int = 25, tolerance: float = 1e-9) -> tuple[np.ndarray, np.ndarray]:
    """Newton on the penalised loss, bias penalised too: (weights with the bias last, diagonal of the Hessian).

    The rows are staged once. A task returns its Hessian and gradient in blocks of dimensions, :func:`tree_sum` adds those of all tasks, and the
    driver gets one of each a round.
    """
    table = staged(rows.select("x", "target"), "features")
    d = len(table.select("x").first()[0]) + 1
    w = np.zeros(d)
    h = np.eye(d)
    for _ in range(rounds):
        shared = rows.sparkSession.sparkContext.broadcast(w)

        def partial(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            both, part = np.zeros((d, d + 1)), 0
            for pdf in batches:
                if len(pdf):
                    part = int(pdf["part"].iloc[0])
                    x = np.column_stack([np.stack(pdf["x"].to_numpy()), np.ones(len(pdf))])
                    p = 1 / (1 + np.exp(-x @ shared.value))
                    both[:, :d] += (x * (p * (1 - p))[:, None]).T @ x
                    both[:, d] += x.T @ (p - pdf["target"].to_numpy())
            starts = range(0, d, BLOCK_DIMS)
            yield pd.DataFrame({"part": part, "block": range(len(starts)), "values": [both[i : i + BLOCK_DIMS].ravel() for i in starts]})

        parts = table.withColumn("part", F.spark_partition_id()).mapInPandas(partial, "part long, block int, values array<double>")
        summed = tree_sum(parts).orderBy("block").toPandas()["values"]
        both = np.concatenate([np.asarray(v) for v in summed]).reshape(d, d + 1)
        g, h = both[:, d] + prior * w, both[:, :d] + prior * np.eye(d)
        step = np.linalg.solve(h, g)
        w = w - step
        if np.abs(step).max() < tolerance:
            break
    return w, np.diag(h).copy()


def normal(seed: int, *counters: Column) -> Column:
    """A standard normal deviate that is a function of the seed and the counters: two uniform numbers of their hash, then Box and Muller's transform."""
    h = F.sha2(F.concat_ws("|", F.lit(str(seed)), *(c.cast("string") for c in counters)), 256)
    uniform = lambda at: (F.conv(F.substring(h, at, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.sqrt(-2.0 * F.ln(uniform(1))) * F.cos(uniform(9) * (2.0 * math.pi))


def draws(estimates: DataFrame, n: int, seed: int) -> DataFrame:
    """(draw, dim, w): ``n`` draws around ``estimates`` (dim, w, curvature) from normals of variance 1 / curvature. A number depends on seed, draw
    and dimension alone, so any task makes any part of them, and makes it again the same."""
    each = estimates.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("draw"))
    return each.select("draw", "dim", (F.col("w") + normal(seed, F.col("draw"), F.col("dim")) / F.sqrt("curvature")).alias("w"))


def draw_weights(spark: SparkSession, weights: np.ndarray, curvature: np.ndarray, n: int, seed: int) -> DataFrame:
    """(draw, weights): :func:`draws` around a fit of :func:`fit_map`, each as one array."""
    fit = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(weights, curvature, strict=True))], "dim int, w double, curvature double")
    return draws(fit, n, seed).groupBy("draw").agg(F.array_sort(F.collect_list(F.struct("dim", "w"))).getField("w").alias("weights"))


def as_predictions(posterior_rows: DataFrame) -> DataFrame:
    """Posterior rows in the form that the metrics take: truth, answer, correctness, confidence, losses, score."""
    p, truth = F.col("p_mean"), F.col("target") == 1
    return posterior_rows.select("*", truth.alias("truth"), (F.round(p, 12) >= 0.5).alias("says_yes")).select(
        "*",
        (F.col("says_yes") == F.col("truth")).alias("correct"),
        P.confidence(p).alias("conf_cal"),
        P.nll_clipped(p, F.col("truth")).alias("nll"),
        P.brier(p, F.col("truth")).alias("brier"),
        F.round(1 - P.confidence(p), 12).alias("error_score"),
    )


def summary(predictions: DataFrame, key: str) -> DataFrame:
    """Counts, means, calibration error and ranking of errors for each ``key`` of :func:`as_predictions` rows."""
    means = predictions.groupBy(key).agg(
        F.count("*").alias("n"), F.sum((~F.col("correct")).cast("long")).alias("errors"),
        *(F.avg(c).alias(c) for c in ("nll", "brier", "conf_cal", "entropy", "variance", "information_gap")),
    )
    rank = metrics.ranking(predictions, [key], "error_score", ~F.col("correct"))
    return means.join(metrics.ece(predictions, [key]), key).join(rank, key)


def posterior(rows: DataFrame, draws: DataFrame) -> DataFrame:
    """Predictive mean, population variance, entropies and their gap over ``draws`` (draw, weights array with the bias last).

    The draws, whose number is a parameter, meet every row as one array; all happens inside the row and nothing is shuffled."""
    all_draws = draws.agg(F.array_sort(F.collect_list(F.struct("draw", "weights"))).getField("weights").alias("draws"))
    z = lambda w: _dot("x", F.slice(w, F.lit(1), F.size("x"))) + F.element_at(w, -1)
    scored = rows.join(F.broadcast(all_draws), F.lit(True)).select("vec_id", "target", F.transform("draws", lambda w: 1 / (1 + F.exp(-z(w)))).alias("p"))
    floor = F.lit(2.220446049250313e-16)
    h = lambda p: -(p * F.ln(F.greatest(p, floor)) + (1 - p) * F.ln(F.greatest(1 - p, floor)))
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v) / F.size(c)
    out = scored.withColumn("p_mean", mean(F.col("p"))).withColumn("expected_entropy", mean(F.transform("p", h)))
    out = out.withColumn("variance", mean(F.transform("p", lambda v: (v - F.col("p_mean")) * (v - F.col("p_mean")))))
    entropy = h(F.col("p_mean"))
    return out.select(
        "vec_id", "target", "p_mean", "variance", "expected_entropy", entropy.alias("entropy"), F.greatest(F.lit(0.0), entropy - F.col("expected_entropy")).alias("information_gap")
    )
