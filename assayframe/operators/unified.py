"""The three sources of predictions as rows of one shape: methods raw and calibrated, ensembles, and the linear head."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import probability as P
from . import metrics

COLUMNS = ("variant", "input_id", "condition", "truth", "p_yes", "predictive_entropy", "expected_entropy", "information_gap", "variance")


def _shaped(rows: DataFrame) -> DataFrame:
    have = [F.col(c) if c in rows.columns else F.lit(None).cast("double").alias(c) for c in COLUMNS]
    says = F.col("p_yes") >= 0.5
    return rows.select(*have).select("*", says.alias("says_yes"), (says == F.col("truth")).alias("correct"), P.confidence(F.col("p_yes")).alias("confidence"))


def of_methods(rows: DataFrame) -> DataFrame:
    """Evaluation rows, raw and calibrated."""
    long = rows.select("doc_id", "condition", "truth", F.expr("stack(2, concat(method, '_raw'), p_raw, concat(method, '_calibrated'), p_cal) AS (variant, p_yes)"))
    return _shaped(long.select("variant", F.col("doc_id").cast("string").alias("input_id"), "condition", "truth", "p_yes", P.entropy(F.col("p_yes")).alias("predictive_entropy")))


def of_ensemble(ens: DataFrame, variant: str) -> DataFrame:
    return _shaped(ens.select("*", F.lit(variant).alias("variant"), F.col("doc_id").cast("string").alias("input_id"), F.col("p_mean").alias("p_yes")))


def of_head(posterior: DataFrame, variant: str = "linear_head") -> DataFrame:
    """Posterior rows; a vector is an input of its own, seen in the original condition."""
    return _shaped(
        posterior.select(
            "*", F.lit(variant).alias("variant"), F.concat(F.lit("vec-"), F.col("vec_id").cast("string")).alias("input_id"), F.lit("original").alias("condition"),
            (F.col("target") == 1).alias("truth"), F.col("p_mean").alias("p_yes"), F.col("entropy").alias("predictive_entropy"),
        )
    )


def union(*sources: DataFrame) -> DataFrame:
    out = sources[0]
    for more in sources[1:]:
        out = out.unionByName(more)
    return out


def summary(rows: DataFrame) -> DataFrame:
    """Metrics by variant and scope; a mean of a column that a source lacks is null."""
    scoped = metrics.with_scope(
        rows.select("*", P.nll_clipped(F.col("p_yes"), F.col("truth")).alias("nll"), P.brier(F.col("p_yes"), F.col("truth")).alias("brier"), F.round(1 - F.col("confidence"), 12).alias("error_score"))
    )
    keys = ["variant", "scope"]
    means = scoped.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(F.col("correct").cast("double")).alias("accuracy"),
        *(F.avg(c).alias(c) for c in ("nll", "brier", "confidence", "predictive_entropy", "expected_entropy", "information_gap")),
    )
    rank = metrics.ranking(scoped, keys, "error_score", ~F.col("correct"))
    return means.join(metrics.ece(scoped, keys, conf="confidence"), keys).join(rank, keys)


def signals(rows: DataFrame, entropy_of: tuple[str, ...], spread_of: tuple[str, ...]) -> DataFrame:
    """(variant, signal, input_id, condition, correct, score): the predictive entropy of the variants ``entropy_of``, and the variance and
    information gap of those of ``spread_of``."""
    named = lambda s: F.struct(F.lit(s).alias("signal"), F.round(s, 12).alias("score"))
    none = F.array().cast("array<struct<signal:string,score:double>>")
    each = F.concat(
        F.when(F.col("variant").isin(*entropy_of), F.array(named("predictive_entropy"))).otherwise(none),
        F.when(F.col("variant").isin(*spread_of), F.array(named("variance"), named("information_gap"))).otherwise(none),
    )
    return rows.select("variant", "input_id", "condition", "correct", F.explode(each).alias("s")).select("variant", "input_id", "condition", "correct", "s.signal", "s.score")


def error_detection(scored: DataFrame) -> DataFrame:
    return metrics.ranking(scored, ["variant", "signal"], "score", ~F.col("correct"))
