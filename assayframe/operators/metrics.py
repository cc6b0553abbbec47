"""Evaluation rows and metrics over grouping sets.

Ranking metrics group by score before any window, and a window sees the distinct scores of one bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import probability as P
from .ordered import bucketed, running
from .validation import ContractError

OVERALL = "overall"


def evaluate(pred: DataFrame) -> DataFrame:
    """Raw and calibrated probability, correctness, confidence, losses and entropy of each prediction."""
    truth = F.col("quality") == 1
    p, q = P.sigmoid(F.col("margin")), P.sigmoid(F.col("margin") / F.col("temperature"))
    rows = pred.select("*", p.alias("p_raw"), q.alias("p_cal"), truth.alias("truth"), (F.col("margin") >= 0).alias("says_yes"))
    return rows.select(
        "*",
        (F.col("says_yes") == F.col("truth")).alias("correct"),
        P.confidence(F.col("p_raw")).alias("conf_raw"),
        P.confidence(F.col("p_cal")).alias("conf_cal"),
        P.nll(F.col("p_raw"), F.col("truth")).alias("nll_raw"),
        P.nll(F.col("p_cal"), F.col("truth")).alias("nll_cal"),
        P.brier(F.col("p_raw"), F.col("truth")).alias("brier_raw"),
        P.brier(F.col("p_cal"), F.col("truth")).alias("brier_cal"),
        P.entropy(F.col("p_cal")).alias("entropy_cal"),
        # A score that is compared is rounded, so that equal scores tie in every engine.
        P.to_tie(1 - P.confidence(F.col("p_cal"))).alias("error_score"),
    )


def attach_labels(scores: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """Scores with the label columns of their input, joined by ``key``. A score whose key has no label, a key with two labels and
    scores that carry a label already are errors."""
    told = [c for c in labels.columns if c != key]
    if taken := set(told) & set(scores.columns):
        raise ContractError(f"scores hold label columns: {sorted(taken)}")
    # One row: the least key that has two labels. The labels themselves join as they are, so a small table of them needs no shuffle.
    twice = labels.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").agg(F.min(F.coalesce(F.col(key).cast("string"), F.lit("null"))).alias("_twice"))
    joined = scores.join(labels.withColumn("_known", F.lit(True)), key, "left").join(F.broadcast(twice), F.lit(True))
    shown = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    fault = F.when(F.col("_twice").isNotNull(), F.concat(F.lit("two labels for "), "_twice")).when(F.col("_known").isNull(), F.concat(F.lit("no label for "), shown))
    checked = F.when(fault.isNotNull(), F.raise_error(fault).cast("boolean")).otherwise(F.col("_known"))
    return joined.withColumn("_known", checked).where("_known").drop("_known", "_twice")


def with_scope(rows: DataFrame, condition: str = "condition") -> DataFrame:
    """Every row under its condition and under the overall scope."""
    return rows.withColumn("scope", F.explode(F.array(F.lit(OVERALL), F.col(condition))))


def summary(rows: DataFrame) -> DataFrame:
    """Per method, and per method and condition: counts and means, in one pass over grouping sets."""
    return (
        rows.groupingSets([["method"], ["method", "condition"]], "method", "condition")
        .agg(
            F.count("*").alias("n"),
            F.sum((~F.col("correct")).cast("long")).alias("errors"),
            *(F.avg(c).alias(c) for c in ("nll_raw", "nll_cal", "brier_raw", "brier_cal", "conf_cal", "entropy_cal")),
        )
        .withColumn("condition", F.coalesce("condition", F.lit(OVERALL)))
        .withColumnRenamed("condition", "scope")
        .withColumn("accuracy", 1 - F.col("errors") / F.col("n"))
    )


def bins(rows: DataFrame, keys: list[str], n_bins: int, conf: str = "conf_cal") -> DataFrame:
    return (
        rows.groupBy(*keys, P.bin_index(F.round(conf, 12), n_bins).alias("bin"))
        .agg(F.count("*").alias("n"), F.avg(conf).alias("mean_conf"), F.avg(F.col("correct").cast("double")).alias("accuracy"))
    )


def ece(rows: DataFrame, keys: list[str], n_bins: int = 10, conf: str = "conf_cal") -> DataFrame:
    """Expected calibration error: bin gaps weighed by bin sizes."""
    return (
        bins(rows, keys, n_bins, conf)
        .groupBy(*keys)
        .agg((F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("mean_conf"))) / F.sum("n")).alias("ece"))
    )


def reliability(rows: DataFrame, keys: list[str], n_bins: int = 10) -> DataFrame:
    """All bins, empty ones with nulls."""
    all_bins = rows.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))))
    found = bins(rows, keys, n_bins)
    return all_bins.join(found, [*keys, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def ranking(rows: DataFrame, keys: list[str], score: Column | str, positive: Column, weight: Column | None = None) -> DataFrame:
    """AUROC (ties count half) and average precision (ties form one threshold); null where a class is missing."""
    w = F.lit(1) if weight is None else weight
    score = F.col(score) if isinstance(score, str) else score
    by_score = rows.groupBy(*keys, score.alias("score")).agg(
        F.sum(F.when(positive, w).otherwise(0)).cast("double").alias("pos"),
        F.sum(F.when(positive, 0).otherwise(w)).cast("double").alias("neg"),
    )
    # Prefix sums over buckets of scores: what is above a score follows from the totals and what is below.
    stepped = running(bucketed(by_score, F.col("score")), keys, F.col("_bucket"), ["score"], {"upto_pos": F.col("pos"), "upto_neg": F.col("neg")}, totals=True)
    tp, fp = F.col("all_upto_pos") - F.col("upto_pos") + F.col("pos"), F.col("all_upto_neg") - F.col("upto_neg") + F.col("neg")
    total = stepped.groupBy(*keys).agg(
        F.sum("pos").alias("p"),
        F.sum("neg").alias("n"),
        F.sum(F.col("pos") * (F.col("upto_neg") - 0.5 * F.col("neg"))).alias("wins"),
        F.sum(F.when(F.col("pos") > 0, F.col("pos") * tp / (tp + fp)).otherwise(0.0)).alias("hits"),
    )
    zero_is_null = lambda c: F.when(c != 0, c)
    return total.select(
        *keys,
        (F.col("wins") / zero_is_null(F.col("p") * F.col("n"))).alias("auroc"),
        (F.col("hits") / zero_is_null(F.col("p"))).alias("average_precision"),
    )


def average_ranks(rows: DataFrame, keys: list[str], score: str, id_col: str = "doc_id") -> DataFrame:
    """Ranks from 1, ties at their mean. Equal scores are counted before they are ordered, and a score that many rows share meets them in as many parts as they make."""
    marked = bucketed(rows, F.col(score), F.col(id_col)).withColumnRenamed("_bucket", "part")
    counts = marked.groupBy(*keys, score, "part").agg(F.count("*").alias("in_part"))
    ties = counts.groupBy(*keys, score).agg(F.sum("in_part").alias("ties"), F.collect_list("part").alias("parts"))
    placed = running(bucketed(ties, F.col(score)), keys, F.col("_bucket"), [score], {"upto": F.col("ties")})
    ranks = placed.select(*keys, score, F.explode("parts").alias("part"), (F.col("upto") - (F.col("ties") - 1) / 2.0).alias("avg_rank"))
    return marked.join(ranks, [*keys, score, "part"]).drop("part")


def risk_coverage(rows: DataFrame, keys: list[str], conf: str = "conf_cal", id_col: str = "doc_id") -> DataFrame:
    """Most confident first: coverage and risk at each prefix, ties by id."""
    rounded = P.to_tie(F.col(conf))
    cut = bucketed(rows, rounded, F.col(id_col), descending=True)
    curve = running(cut, keys, F.col("_bucket"), [F.desc(rounded), id_col, "condition"], {"wrong": (~F.col("correct")).cast("long")})
    k, n, errors = F.col("place"), F.col("size"), F.col("wrong")
    return curve.select(
        *keys,
        F.col(id_col),
        "condition",
        k.cast("long").alias("retained"),
        (k / n).alias("coverage"),
        errors.alias("errors"),
        (errors / k).alias("risk"),
        (1 - errors / k).alias("selective_accuracy"),
        F.col(conf).alias("threshold"),
    )


def thinned(curve: DataFrame, every: int = 24) -> DataFrame:
    return curve.where((F.col("retained") == 1) | (F.col("retained") % every == 0))


def paired_changes(rows: DataFrame) -> DataFrame:
    """Mean change of each condition from the original of the same input and method."""
    measures = {"correct": F.col("correct").cast("double"), "conf": F.col("conf_cal"), "nll": F.col("nll_cal"), "entropy": F.col("entropy_cal")}
    slim = rows.select("method", "doc_id", "condition", *(e.alias(m) for m, e in measures.items()))
    anchor = slim.where("condition = 'original'").select("method", "doc_id", *(F.col(m).alias(f"{m}_0") for m in measures))
    return (
        slim.join(anchor, ["method", "doc_id"])
        .groupBy("method", "condition")
        .agg(F.count("*").alias("n"), *(F.avg(F.col(m) - F.col(f"{m}_0")).alias(f"d_{m}") for m in measures))
    )


def long_form(rows: DataFrame) -> DataFrame:
    """Raw and calibrated columns as rows of one shape."""
    return rows.select(
        "doc_id",
        "condition",
        "truth",
        F.expr("stack(2, concat(method, '_raw'), p_raw, concat(method, '_calibrated'), p_cal) AS (variant, p_yes)"),
    ).select("*", (F.col("p_yes") >= 0.5).alias("says_yes"), P.confidence(F.col("p_yes")).alias("confidence"))
