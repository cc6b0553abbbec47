"""Deterministic stratified sampling by hash rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import of_hex, running


def rank_hash(seed: int, salt: str, row_id: Column) -> Column:
    # Fixed value: the form of the hashed text.
    return F.sha2(F.concat(F.lit(f"sha256-stratified-v1|{seed}|{salt}|"), row_id), 256)


def hash_ranked(rows: DataFrame, stratum: str, row_id: str, seed: int, salt: str) -> DataFrame:
    """Place of each row in its stratum, from 1, by hash and then id."""
    hashed = rows.withColumn("rank_sha", rank_hash(seed, salt, F.col(row_id).cast("string")))
    placed = running(hashed, [stratum], of_hex(F.col("rank_sha")), ["rank_sha", row_id], {})
    return placed.drop("size").withColumn("place", F.col("place").cast("int"))


def largest_remainder(counts: DataFrame, key: str, total: int) -> DataFrame:
    """Seats of each class in proportion to its count ``n``: whole parts first, then the largest remainders, ties to the
    smaller key. ``counts`` has a row for each class."""
    everything = Window.partitionBy()
    share = counts.withColumn("all_n", F.sum("n").over(everything)).select(
        key, "n", F.expr(f"(n * {total}) div all_n").alias("whole"), F.expr(f"(n * {total}) % all_n").alias("rest")
    )
    left = F.lit(total) - F.sum("whole").over(everything)
    place = F.row_number().over(Window.orderBy(F.desc("rest"), key))
    return share.select(key, "n", (F.col("whole") + F.when(place <= left, 1).otherwise(0)).cast("long").alias("quota"))


def split(rows: DataFrame, stratum: str, row_id: str, sizes: dict[str, int], seed: int, salt: str) -> DataFrame:
    """Disjoint slices of one ranking: each split takes its quota of every stratum after those before it."""
    counts = rows.groupBy(stratum).agg(F.count("*").alias("n"))
    bounds = None
    for name, size in sizes.items():
        quota = largest_remainder(counts, stratum, size).select(stratum, F.col("quota").alias(f"q_{name}"))
        bounds = quota if bounds is None else bounds.join(quota, stratum)
    ranked = hash_ranked(rows, stratum, row_id, seed, salt).join(F.broadcast(bounds), stratum)  # a row for each stratum
    chosen, upto = F.lit(None).cast("string"), F.lit(0)
    cases = None
    for name in sizes:
        upto = upto + F.col(f"q_{name}")
        test = F.col("place") <= upto
        cases = F.when(test, F.lit(name)) if cases is None else cases.when(test, F.lit(name))
    return ranked.withColumn("split", cases.otherwise(chosen)).where("split IS NOT NULL").select(row_id, stratum, "rank_sha", "place", "split")


def leakage(splits: DataFrame, row_id: str) -> DataFrame:
    """Ids that stand in more than one split."""
    return splits.groupBy(row_id).agg(F.count_distinct("split").alias("n")).where("n > 1")


def stage(rows: DataFrame, key: str, n: int, length: str) -> DataFrame:
    """The first ``n`` - 1 keys, and the key of the longest row; where that is among them, the next unused key."""
    head = rows.select(key).distinct().orderBy(key).limit(n - 1)
    rest = rows.join(F.broadcast(head), key, "left_anti")  # n - 1 keys
    longest = rows.orderBy(F.desc(length), key).limit(1).select(key).join(head, key, "left_anti").withColumn("o", F.lit(0))
    spare = rest.orderBy(key).limit(1).select(key).withColumn("o", F.lit(1))
    last = longest.unionByName(spare).orderBy("o").limit(1).select(key)
    return head.unionByName(last)
