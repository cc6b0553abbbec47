"""Contiguous balanced shards from global byte-size prefix sums.

Everything is DataFrame code. The text is read once, for its size, checksum and hash; after that only a
compact table (key, size, checksum, hash) is range-partitioned, so the shuffle carries about 40 bytes a row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fine_grained, release, spread_join, staged

#: Bytes that every row costs besides its text.
ROW_OVERHEAD = 8
#: A group of equal texts stays together if it is no larger than this part of a shard.
WHOLE_PART = 0.01


def shard(docs: DataFrame, n_shards: int = 24, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Assign every row to a shard; rows of a shard are contiguous in the order of the text's hash, then of the key.

    A partition's total comes from its own rows, a prefix sum over the totals gives its base, and a row
    goes to the shard in whose equal target its midpoint lies. Equal texts stand side by side; a group of them that is small
    against a shard goes by the midpoint of the group and so stays together, a larger one is cut like any other rows. So a
    shard's bytes differ from the target by one such group or one row on each side, however skewed the sizes are.

    Nulls: a null text counts as empty, a null key sorts first. Empty table: no rows. Repeated rows each
    get a slot of their own, ties between them being broken by position. Long texts: sizes are longs; a
    single row is never cut, so a row above the target makes its shard larger. Other columns are ignored.

    Returns key, size, text_crc32, law, shard, slot, grown_shard (null under this law).
    """
    sized = staged(
        docs.select(
            F.col(key).alias("k"),
            (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_OVERHEAD).alias("size"),
            F.coalesce(F.crc32(F.col(text)), F.lit(0)).cast("long").alias("crc"),
            F.xxhash64(F.coalesce(text, F.lit(""))).alias("h"),
            F.monotonically_increasing_id().alias("pos"),
        ),
        "sized",
    )
    order = [F.col("h"), F.col("k").asc_nulls_first(), F.col("pos")]
    ranged = staged(
        sized.repartitionByRange(fine_grained(docs), *order).withColumn("part", F.spark_partition_id()), "ranged"
    )
    # One row per range partition: the number of partitions bounds this table.
    totals = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("byte_base"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("row_base"),
        F.sum("bytes").over(Window.partitionBy()).alias("all_bytes"),
    )
    inside = Window.partitionBy("part").orderBy(*order)
    placed = staged(
        ranged.withColumn("rank", F.row_number().over(inside))
        .withColumn("upto", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .join(F.broadcast(bases), "part")
        .select(
            "k", "size", "crc", "h", "pos", "all_bytes",
            (F.col("row_base") + F.col("rank") - 1).alias("global_rank"),
            (F.col("byte_base") + F.col("upto") - F.col("size")).alias("start"),
        ),
        "placed",
    )
    # Small groups of equal texts, by the midpoint of the whole. Only repeated texts have a row here.
    groups = (
        placed.groupBy("h")
        .agg(F.count("*").alias("n"), F.sum("size").alias("group_size"), F.min("start").alias("group_start"), F.max("all_bytes").alias("all"))
        .where((F.col("n") > 1) & (F.col("group_size") <= F.col("all") * (WHOLE_PART / n_shards)))
        .select("h", "group_size", "group_start")
    )
    own = spread_join(placed, "h", "pos", groups)
    middle = 2 * F.coalesce("group_start", "start") + F.coalesce("group_size", "size")
    at = F.call_function("div", middle * n_shards, 2 * F.col("all_bytes"))
    cut = staged(own.select("k", "size", "crc", "global_rank", F.least(F.lit(n_shards - 1), at).cast("int").alias("shard")), "cut")
    firsts = cut.groupBy("shard").agg(F.min("global_rank").alias("first_rank"))
    release(sized, ranged, placed)
    # firsts has n_shards rows at most, a parameter.
    return cut.join(F.broadcast(firsts), "shard").select(
        F.col("k").alias(key),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("global_rank") - F.col("first_rank")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
