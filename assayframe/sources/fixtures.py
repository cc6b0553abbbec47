"""Inputs, conditions, methods and predictions derived from the driver's tables by integer arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Condition names in order, methods with their published temperatures.
CONDITIONS = (
    "original",
    "lexical_evidence_removal",
    "prefix_truncation_50",
    "irrelevant_distractor",
    "lexical_contradiction",
    "no_passage",
)
METHODS = (("baseline", 2.9551), ("seed_1", 2.1542), ("seed_2", 1.7702), ("seed_3", 2.2581))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def expand_conditions(inputs: DataFrame) -> DataFrame:
    """Each input once for every condition: a generator inside the row, so nothing is shuffled."""
    return inputs.select("*", F.posexplode(F.array(*map(F.lit, CONDITIONS))).alias("condition_index", "condition"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, quality, condition, method, temperature, margin (yes minus no logit) and continuation text."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    methods = F.array(*(F.struct(F.lit(m).alias("method"), F.lit(t).alias("temperature")) for m, t in METHODS))
    rows = expand_conditions(labels).select("*", F.posexplode(methods).alias("method_index", "m"))
    u = F.expr("(doc_id * 7919 + condition_index * 104729L + method_index * 15485863L) % 4001")
    v = F.expr("(doc_id * 104723 + condition_index * 7907L + method_index * 1299709L) % 997")
    margin = (u - 2000).cast("double") / 500.0 + ((2 * F.col("quality") - 1) * (6 - F.col("condition_index"))).cast("double") / 4.0
    number = (v % 101).cast("string")
    completion = (
        F.when(v < 300, F.concat(F.lit(" Yes\nConfidence: "), number))
        .when(v < 600, F.concat(F.lit(" No\nConfidence: "), number, F.lit("\n")))
        .when(v < 700, F.lit(""))
        .when(v < 800, F.concat(F.lit("Yes\nConfidence: "), number))
        .when(v < 900, F.concat(F.lit(" No\n"), number))
        .otherwise(F.concat(F.lit(" Yes\nConfidence: 0"), number))
    )
    return rows.select(
        "doc_id",
        "quality",
        "condition_index",
        "condition",
        "method_index",
        F.col("m.method").alias("method"),
        F.col("m.temperature").alias("temperature"),
        margin.alias("margin"),
        completion.alias("completion"),
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predictions without their labels, which stand in a table of their own."""
    return predictions(spark, sf_dir).drop("quality")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", "quality")


#: Bits that a bitmap of keys has for each of them, and words of 64 bits at most: 16 MB, so that no number of keys makes it larger.
BITS_OF_KEY, MOST_WORDS = 16, 1 << 21


def may_hold(keys: DataFrame, key: str) -> Column:
    """Whether ``keys`` may hold the ``key`` of a row, a whole number: true for every key that is there, and for about one in BITS_OF_KEY of those that aren't (more where
    MOST_WORDS bounds the bitmap). A join decides after it; what this leaves out is never shuffled."""
    words = min(MOST_WORDS, 1 << max(0, keys.count() * BITS_OF_KEY // 64).bit_length())
    digest = F.xxhash64(F.col(key).cast("long"))  # of one type on both sides
    word, bit = F.pmod(digest, F.lit(words)).cast("int"), F.shiftrightunsigned(digest, 58).cast("int")
    empty = keys.sparkSession.range(words).select(F.col("id").cast("int").alias("word"), F.lit(0).cast("long").alias("bits"))
    own = keys.select(word.alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("bits"))
    each = empty.unionByName(own).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    bitmap = each.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda w: w["bits"]).alias("bitmap")).scalar()
    return F.getbit(F.get(bitmap, word), bit) == 1


def documents_with_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, question, passage, quality of the labelled documents; the question is picked by doc_id.

    Labels grow with the documents, so they are never broadcast: both sides are dealt by key at any size, and the texts are not sorted. Texts
    without a label stay where they are, but for a few that a bitmap of the labelled keys can't tell.
    """
    benchmark = table(spark, sf_dir, "benchmark").select(F.col("item_id"), F.col("text").alias("question"))
    n = benchmark.count()
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("passage"))
    return (
        docs.where(may_hold(labels, "doc_id"))
        .join(labels.hint("shuffle_hash"), "doc_id")
        .withColumn("item_id", F.col("doc_id") % F.lit(max(n, 1)))
        .join(benchmark, "item_id")
        .select("doc_id", "quality", "question", "passage")
    )
