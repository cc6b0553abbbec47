"""Ensembles of members, uncertainty signals and seed summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import probability as P
from . import metrics


def combine(rows: DataFrame, members: int = 3, p: str = "p_cal") -> DataFrame:
    """One row per input and condition: mean, population variance, entropies, their gap and vote disagreement.

    An input that lacks one of the ``members``, has one twice or has a null probability is an error, which the query raises.
    """
    whole = (F.col("members") == members) & (F.col("distinct") == members) & (F.col("known") == members)
    broken = F.concat(F.lit("ensemble members of input "), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(", "), F.coalesce("condition", F.lit("null")), F.lit(": "), F.col("known").cast("string"))
    out = (
        rows.where("method <> 'baseline'")
        .groupBy("doc_id", "condition", "truth")
        .agg(
            F.avg(p).alias("p_mean"),
            F.var_pop(p).alias("variance"),
            F.avg(P.entropy(F.col(p))).alias("expected_entropy"),
            F.sum(F.col("says_yes").cast("long")).alias("yes_votes"),
            F.count("*").alias("members"),
            F.size(F.collect_set("method")).alias("distinct"),
            F.count(p).alias("known"),
        )
        .withColumn("members", F.when(whole, F.col("members")).otherwise(F.raise_error(broken).cast("long")))
        .drop("distinct", "known")
    )
    entropy = P.entropy(F.col("p_mean"))
    return out.select(
        "*",
        entropy.alias("predictive_entropy"),
        F.greatest(F.lit(0.0), entropy - F.col("expected_entropy")).alias("information_gap"),
        (1 - F.greatest("yes_votes", F.col("members") - F.col("yes_votes")) / F.col("members")).alias("disagreement"),
        (F.round("p_mean", 12) >= 0.5).alias("says_yes"),
        ((F.round("p_mean", 12) >= 0.5) == F.col("truth")).alias("correct"),
        P.confidence(F.col("p_mean")).alias("confidence"),
    )


def as_predictions(ens: DataFrame) -> DataFrame:
    """Ensemble rows in the form that the metrics take."""
    return ens.select(
        "*", F.lit("ensemble").alias("method"), F.col("confidence").alias("conf_cal"), P.nll_clipped(F.col("p_mean"), F.col("truth")).alias("nll"),
        P.brier(F.col("p_mean"), F.col("truth")).alias("brier"), F.round(1 - F.col("confidence"), 12).alias("error_score"),
    )


def scoped_metrics(ens: DataFrame) -> DataFrame:
    """All metrics of an ensemble for every condition and overall."""
    rows = metrics.with_scope(as_predictions(ens))
    means = rows.groupBy("scope").agg(
        F.count("*").alias("n"), F.sum((~F.col("correct")).cast("long")).alias("errors"), F.sum((F.col("disagreement") > 0).cast("long")).alias("n_disagree"),
        *(F.avg(c).alias(c) for c in ("nll", "brier", "confidence", "predictive_entropy", "expected_entropy", "information_gap", "variance", "disagreement")),
    )
    rank = metrics.ranking(rows, ["scope"], "error_score", ~F.col("correct"))
    return means.join(metrics.ece(rows, ["scope"]), "scope").join(rank, "scope")


SIGNALS = ("confidence_gap", "predictive_entropy", "information_gap", "variance", "disagreement")


def signals(ens: DataFrame) -> DataFrame:
    """Scores as rows: (doc_id, condition, correct, signal, score)."""
    score = {"confidence_gap": 1 - F.col("confidence")} | {s: F.col(s) for s in SIGNALS[1:]}
    return ens.select(
        "doc_id",
        "condition",
        "correct",
        F.explode(F.array(*(F.struct(F.lit(s).alias("signal"), F.round(score[s], 12).alias("score")) for s in SIGNALS))).alias("s"),
    ).select("doc_id", "condition", "correct", "s.signal", "s.score")


def error_detection(ens: DataFrame) -> DataFrame:
    return metrics.ranking(signals(ens), ["signal"], "score", ~F.col("correct"))


def degradation_detection(ens: DataFrame) -> DataFrame:
    """Original against any degraded condition and against each: an original row enters once for every target."""
    degraded = [c for c in metrics_conditions() if c != "original"]
    targets = F.when(
        F.col("condition") == "original", F.array(*map(F.lit, ["any_degraded", *degraded]))
    ).otherwise(F.array(F.lit("any_degraded"), F.col("condition")))
    rows = signals(ens).withColumn("target", F.explode(targets))
    return metrics.ranking(rows, ["signal", "target"], "score", F.col("condition") != "original")


def degradation_means(ens: DataFrame) -> DataFrame:
    """Mean score of originals and of each degraded condition, and their difference, for every signal."""
    means = signals(ens).groupBy("signal", "condition").agg(F.count("*").alias("n"), F.avg("score").alias("mean"))
    own = means.where("condition = 'original'").select("signal", F.col("mean").alias("mean_original"))
    return means.where("condition <> 'original'").join(own, "signal").select(
        "signal", F.col("condition").alias("target"), "n", "mean_original", F.col("mean").alias("mean_degraded"), (F.col("mean") - F.col("mean_original")).alias("difference")
    )


def seed_uq_summary(rows: DataFrame) -> DataFrame:
    """How well each member's own predictive entropy ranks errors (target ``error``) and degraded evidence: mean, sample
    deviation and range of AUROC and average precision over the members."""
    own = rows.where("method <> 'baseline'").select("method", "condition", "correct", F.round("entropy_cal", 12).alias("score"))
    degraded = [c for c in metrics_conditions() if c != "original"]
    targets = F.when(F.col("condition") == "original", F.array(*map(F.lit, ["error", "any_degraded", *degraded]))).otherwise(
        F.array(F.lit("error"), F.lit("any_degraded"), F.col("condition"))
    )
    wide = own.withColumn("target", F.explode(targets))
    positive = F.when(F.col("target") == "error", ~F.col("correct")).otherwise(F.col("condition") != "original")
    ranked = metrics.ranking(wide.withColumn("positive", positive), ["method", "target"], "score", F.col("positive"))
    return ranked.groupBy("target").agg(
        *(f(m).alias(f"{n}_{m}") for m in ("auroc", "average_precision") for n, f in (("mean", F.avg), ("sd", F.stddev_samp), ("min", F.min), ("max", F.max)))
    )


def metrics_conditions() -> tuple[str, ...]:
    from ..sources.fixtures import CONDITIONS

    return CONDITIONS


def seed_summary(rows: DataFrame) -> DataFrame:
    """Mean, sample deviation and range of the members' accuracies and losses, per condition."""
    by_seed = (
        rows.where("method <> 'baseline'")
        .groupBy("condition", "method")
        .agg(F.avg(F.col("correct").cast("double")).alias("accuracy"), F.avg("nll_cal").alias("nll"))
    )
    return by_seed.groupBy("condition").agg(
        *(f(m).alias(f"{n}_{m}") for m in ("accuracy", "nll") for n, f in (("mean", F.avg), ("sd", F.stddev_samp), ("min", F.min), ("max", F.max)))
    )
