"""Places and running sums over a whole group without one task that sorts it.

Rows fall into buckets that follow the order. Bucket totals, a small table, give what comes before a bucket; a window then
only sorts inside one. The borders of buckets are quantiles of all rows, so no spread of the values makes a bucket large, and a value that
many rows share is cut by what breaks its ties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 1024


#: Parts into which the rows of a value are cut that holds a bucket or more.
PARTS = 63


def _quantiles(value: Column, n: int) -> Column:
    """The n - 1 borders of n parts of about equal numbers, by a sketch. Its size depends on ``n`` alone."""
    return F.percentile_approx(value.cast("double"), [i / n for i in range(1, n)], 10 * n)


def _place(borders: Column, value: Column, n: int) -> Column:
    """How many of the n - 1 sorted borders are at most ``value``, by halving; n is a power of two."""
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(n.bit_length() - 1))))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(borders, at + step - 1) <= value, at + step).otherwise(at))


def bucketed(rows: DataFrame, value: Column, tie: Column | None = None, descending: bool = False, buckets: int = BUCKETS) -> DataFrame:
    """``rows`` with ``_bucket``, which follows the order of ``value`` and, with ``tie``, of both (``tie`` always ascending).

    A bucket holds about one in ``buckets`` of the rows; a value that has more, and shows as a border that comes twice, is cut by quantiles of ``tie`` among its rows.
    Both are numbers. What is broadcast are ``buckets`` borders, and PARTS more for each such value, of which there are fewer than ``buckets``.
    """
    borders = rows.agg(_quantiles(value, buckets).alias("_borders"))
    at = _place(F.col("_borders"), value.cast("double"), buckets)
    marked = rows.join(F.broadcast(borders), F.lit(True)).withColumn("_at", at).drop("_borders")
    order = (F.lit(buckets - 1) - F.col("_at")) if descending else F.col("_at")
    if tie is None:
        return marked.withColumn("_bucket", order).drop("_at")
    twice = borders.select(F.explode(F.array_distinct(F.filter("_borders", lambda v, i: (i > 0) & (F.get("_borders", i - 1) == v)))).alias("_hot"))
    own = rows.select(value.cast("double").alias("_hot"), tie.cast("double").alias("_tie")).join(F.broadcast(twice), "_hot")
    cuts = own.groupBy("_hot").agg(_quantiles(F.col("_tie"), PARTS + 1).alias("_cuts"))
    part = F.when(F.col("_cuts").isNull(), F.lit(-1 if descending else PARTS + 1)).otherwise(_place(F.col("_cuts"), tie.cast("double"), PARTS + 1))
    # In a bucket the hot value is the least: its parts come first, or last if the order falls.
    split = marked.withColumn("_hot", value.cast("double")).join(F.broadcast(cuts), "_hot", "left")
    return split.withColumn("_bucket", order * (PARTS + 3) + part + 1).drop("_at", "_hot", "_cuts")


def of_hex(value: Column) -> Column:
    """Bucket of a hexadecimal digest: its first three digits."""
    return F.conv(F.substring(value, 1, 3), 16, 10).cast("int")


def running(rows: DataFrame, keys: list[str], bucket: Column, order: list[Column | str], sums: dict[str, Column], totals: bool = False) -> DataFrame:
    """Adds ``place`` (from 1), ``size`` (rows of the group) and the running sums ``sums``, this row included; with ``totals`` also
    ``all_`` and the name, the sums of the group.

    ``bucket`` must not fall as ``order`` goes on; the rows of a group and bucket are sorted in one task.
    """
    marked = rows.withColumns({"_bucket": bucket, **{f"_of_{n}": c for n, c in sums.items()}})
    own = [c for c in rows.columns if c != "_bucket"]
    counts = marked.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"), *(F.sum(f"_of_{n}").alias(f"_sum_{n}") for n in sums))
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    start = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    offsets = counts.select(
        *keys, "_bucket", start("_n").alias("_n"), F.sum("_n").over(whole).alias("size"), *(start(f"_sum_{n}").alias(f"_sum_{n}") for n in sums),
        *(F.sum(f"_sum_{n}").over(whole).alias(f"all_{n}") for n in sums if totals),
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    # Null keys are a group like any other.
    there = offsets.withColumnsRenamed({c: f"_{c}_" for c in (*keys, "_bucket")})
    same = F.lit(True)
    for c in (*keys, "_bucket"):
        same = same & marked[c].eqNullSafe(there[f"_{c}_"])
    return marked.join(there, same).select(
        *own,
        (F.col("_n") + F.row_number().over(inside)).alias("place"),
        "size",
        *((F.col(f"_sum_{n}") + F.sum(f"_of_{n}").over(upto)).alias(n) for n in sums),
        *(f"all_{n}" for n in sums if totals),
    )
