"""Temperature: grid of losses in one pass, and a one-dimensional fit on aggregates."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import probability as P
from . import metrics
from .validation import ContractError

LEAST, MOST = 0.01, 100.0


def _loss(margin, truth, beta):
    """log(1 + exp(-s)) with s the scaled margin of the truth, for any size of s."""
    s = F.when(truth, margin).otherwise(-margin) * beta
    return F.log1p(F.exp(-F.abs(s))) + F.greatest(-s, F.lit(0.0))


def grid(rows: DataFrame, key: str, temperatures: Sequence[float]) -> DataFrame:
    """Mean loss of each key at each temperature: one scan, one column for each temperature."""
    cols = [F.avg(_loss(F.col("margin"), F.col("quality") == 1, F.lit(1.0 / t))).alias(f"t{i}") for i, t in enumerate(temperatures)]
    pairs = F.array(*(F.struct(F.lit(t).alias("temperature"), F.col(f"t{i}").alias("nll")) for i, t in enumerate(temperatures)))
    return rows.groupBy(key).agg(*cols).select(key, F.explode(pairs).alias("x")).select(key, "x.temperature", "x.nll")


def fit(rows: DataFrame, key: str, points: int = 17, rounds: int = 10) -> DataFrame:
    """Temperature of least loss in [0.01, 100] for each key, with loss, Brier score and calibration error before and after.

    The loss is convex in 1 / temperature, so a grid on a log scale is narrowed around its best point; each round is one
    aggregate over all keys that returns some numbers for each. Keys are few: methods.
    """
    keys = [r[0] for r in rows.select(key).distinct().collect()]
    bounds = {k: (math.log(LEAST), math.log(MOST)) for k in keys}
    for _ in range(rounds):
        steps = {k: [lo + (hi - lo) * i / (points - 1) for i in range(points)] for k, (lo, hi) in bounds.items()}
        at = F.create_map(*(x for k in keys for x in (F.lit(k), F.array(*(F.lit(math.exp(-s)) for s in steps[k])))))
        scaled = rows.withColumn("betas", at[F.col(key)])
        got = scaled.groupBy(key).agg(*(F.avg(_loss(F.col("margin"), F.col("quality") == 1, F.col("betas")[i])).alias(f"l{i}") for i in range(points))).collect()
        for r in got:
            best = min(range(points), key=lambda i: r[f"l{i}"])
            s = steps[r[key]]
            bounds[r[key]] = (s[max(0, best - 1)], s[min(points - 1, best + 1)])
    spark = rows.sparkSession
    fitted = spark.createDataFrame([(k, math.exp(sum(b) / 2)) for k, b in bounds.items()], f"{key} string, fitted double")
    # One row for each key.
    scored = rows.join(F.broadcast(fitted), key).withColumn("truth", F.col("quality") == 1)
    out = None
    for name, beta in (("before", F.lit(1.0)), ("after", 1 / F.col("fitted"))):
        p = P.sigmoid(F.col("margin") * beta)
        made = scored.select(key, "margin", "truth", "fitted", p.alias("p"), ((F.col("margin") >= 0) == F.col("truth")).alias("correct"))
        means = made.groupBy(key, "fitted").agg(
            F.avg(_loss(F.col("margin"), F.col("truth"), beta)).alias(f"nll_{name}"), F.avg(P.brier(F.col("p"), F.col("truth"))).alias(f"brier_{name}")
        )
        error = metrics.ece(made.withColumn("conf", P.confidence(F.col("p"))), [key], conf="conf").withColumnRenamed("ece", f"ece_{name}")
        part = means.join(error, key)
        out = part if out is None else out.join(part.drop("fitted"), key)
    return out.withColumn("boundary_hit", (F.col("fitted") - LEAST < 1e-6 * (MOST - LEAST)) | (MOST - F.col("fitted") < 1e-6 * (MOST - LEAST)))


def misaligned(manifest: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    """Keys that a manifest and the predictions of one method don't share one to one: (key, in_manifest, in_predictions)."""
    count = lambda df, name: df.groupBy(key).agg(F.count("*").alias(name))
    both = count(manifest, "in_manifest").join(count(predictions, "in_predictions"), key, "full")
    zero = F.lit(0).cast("long")
    return both.select(key, F.coalesce("in_manifest", zero).alias("in_manifest"), F.coalesce("in_predictions", zero).alias("in_predictions")).where("in_manifest <> 1 OR in_predictions <> 1")


def aligned(manifest: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    """Manifest and predictions joined by key; an error unless each key stands once on both sides."""
    if broken := misaligned(manifest, predictions, key).limit(5).collect():
        raise ContractError(f"manifest and predictions differ: {[r[key] for r in broken]}")
    return manifest.join(predictions, key)
