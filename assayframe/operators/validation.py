"""Constraint suites: all violation counts of a table in one scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType


class ContractError(ValueError):
    """A table breaks a declared constraint."""


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, n): rows for which each rule isn't true; unknown counts as broken."""
    counts = df.agg(*(F.coalesce(F.sum((~F.coalesce(c, F.lit(False))).cast("long")), F.lit(0).cast("long")).alias(r) for r, c in rules.items()))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.col(r).alias("n")) for r in rules))).alias("x")).select("x.*")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def require(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """The table itself, or an error naming every broken rule."""
    broken = {r["rule"]: r["n"] for r in violations(df, rules).collect() if r["n"]}
    if broken:
        raise ContractError(str(broken))
    return df


def exact_columns(df: DataFrame, names: set[str]) -> DataFrame:
    if set(df.columns) != names:
        raise ContractError(f"columns differ: {sorted(set(df.columns) ^ names)}")
    return df


def without_columns(df: DataFrame, forbidden: set[str]) -> DataFrame:
    """Fails if a forbidden name stands anywhere in the schema, nested fields included; no data is read."""

    def names(kind) -> set[str]:
        if isinstance(kind, StructType):
            return {f.name for f in kind} | {n for f in kind for n in names(f.dataType)}
        return names(kind.elementType) if isinstance(kind, ArrayType) else set()

    if found := names(df.schema) & forbidden:
        raise ContractError(f"forbidden columns: {sorted(found)}")
    return df


def key_differences(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, side) of keys that only the ``left`` or only the ``right`` table has; none if the sets are equal."""
    a, b = (df.select(*keys).distinct().withColumn(n, F.lit(True)) for df, n in ((left, "_l"), (right, "_r")))
    return a.join(b, keys, "full").where("_l IS NULL OR _r IS NULL").select(*keys, F.when(F.col("_l").isNull(), "right").otherwise("left").alias("side"))


def alignment(rows: DataFrame, keys: list[str], variant: str, truth: str, n_variants: int) -> DataFrame:
    """Keys that some variant lacks or repeats, or on whose truth variants disagree."""
    return (
        rows.groupBy(*keys)
        .agg(F.count("*").alias("n"), F.count_distinct(variant).alias("variants"), F.count_distinct(truth).alias("truths"))
        .where((F.col("n") != n_variants) | (F.col("variants") != n_variants) | (F.col("truths") != 1))
    )


def contiguous(df: DataFrame, group: str, ordinal: str) -> DataFrame:
    """Groups whose ordinals aren't 0, 1, 2, ... without gaps."""
    before = F.lag(ordinal).over(Window.partitionBy(group).orderBy(ordinal))
    return df.withColumn("step", F.col(ordinal) - F.coalesce(before, F.lit(-1))).where("step <> 1").select(group).distinct()
