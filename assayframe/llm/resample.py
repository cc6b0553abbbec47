"""Target-distribution importance resampling over hashed word runs.

A text's words are found and hashed without a Python loop over them: a table takes each byte of the Arrow buffer to its lowered form or to
zero, differences of "is zero" are the word boundaries, and a table-driven CRC-32 goes on by one byte for all words at once.
Corpus and target become counts per bucket; the log ratio of the two is a bucket's gain, a document's weight is the mean of its gains,
and seeded Gumbel noise on the weights turns "the highest scores" into a draw without replacement.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fine_grained, release, staged, text_slices

BUCKETS = 10_000
#: Bytes of a word over which all words go on together; what is longer is finished word by word by zlib.
STEPS = 48


def _forms() -> np.ndarray:
    """Each byte's lowered form if it belongs to a word (digits, letters, all bytes above ASCII), else zero."""
    table = np.zeros(256, np.uint8)
    for first, last in ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)):
        table[first : last + 1] = np.arange(first, last + 1)
    table[0x41 : 0x5A + 1] = np.arange(0x61, 0x7A + 1)
    return table


def _crc_table() -> np.ndarray:
    """The 256 steps of the reflected CRC-32 polynomial."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


FORMS, CRC = _forms(), _crc_table()


def find_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lowered bytes, word starts, word lengths, first word of each row and the end) of an Arrow array; null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    raw = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    lowered = FORMS[raw]
    inside = np.zeros(len(lowered) + 2, bool)
    inside[1:-1] = lowered != 0
    begins, ends = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    cuts = offsets[(offsets > 0) & (offsets < len(lowered))]  # rows touch: a word ends with its row
    begins[cuts] = inside[1:-1][cuts]
    ends[cuts - 1] = inside[1:-1][cuts - 1]
    starts = np.flatnonzero(begins)
    return lowered, starts, np.flatnonzero(ends) + 1 - starts, np.searchsorted(starts, offsets)


def advance(state: np.ndarray, lowered: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The CRC registers ``state`` after the bytes of their words; all go on together, byte by byte."""
    held = np.minimum(sizes, STEPS + 1).astype(np.uint8)
    order = np.argsort(STEPS + 1 - held, kind="stable")  # long words first, so those that go on are always a range
    at, left, out = starts[order], sizes[order], state[order]
    live = np.searchsorted(-held[order].astype(np.int64), -np.arange(STEPS + 1))  # words of more than k bytes
    long = int(live[STEPS])
    for k in range(STEPS):
        n = int(live[k])
        some = out[long:n]
        out[long:n] = CRC[(some ^ lowered[at[long:n] + k]) & 255] ^ (some >> 8)
    for i in range(long):
        word = lowered[at[i] : at[i] + left[i]].tobytes()
        out[i] = zlib.crc32(word, int(out[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    back = np.empty_like(out)
    back[order] = out
    return back


def features(texts: pa.Array, runs: int = 1, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket) of each run of 1 to ``runs`` words and the number of words of each row."""
    lowered, starts, sizes, firsts = find_words(texts)
    counts = np.diff(firsts)
    row = np.repeat(np.arange(len(texts)), counts)
    state, of, hashed = np.full(len(starts), 0xFFFFFFFF, np.uint32), np.arange(len(starts)), []
    for n in range(runs):
        if n:  # the run goes on over one space into the next word of its row
            goes = of + n < firsts[1:][row[of]]
            of, state = of[goes], state[goes]
            state = CRC[(state ^ 0x20) & 255] ^ (state >> 8)
        state = advance(state, lowered, starts[of + n], sizes[of + n])
        hashed.append((row[of], (state ^ np.uint32(0xFFFFFFFF)) % np.uint32(buckets)))
    return np.concatenate([r for r, _ in hashed]), np.concatenate([b for _, b in hashed]), counts


def bucket_counts(texts: DataFrame, runs: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts in each bucket. A task sends one row a bucket; the driver gets ``buckets`` rows, a parameter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for piece in text_slices(batch, "text"):
                total += np.bincount(features(piece.column("text"), runs, buckets)[1], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    rows = texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(buckets, np.int64)
    out[rows["bucket"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed target and corpus shares of each bucket, floored."""
    n, all_s, all_t = len(corpus), int(corpus.sum()), int(target.sum())
    ratio = ((int(t) + 1.0) * (all_s + float(n)) / ((int(s) + 1.0) * (all_t + float(n))) for s, t in zip(corpus, target, strict=True))
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, runs: int = 1) -> DataFrame:
    """doc_id, n_features, n_words and weight of every row; ``gain`` has one number a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in text_slices(batch, "text"):
                row, bucket, words = features(piece.column("text"), runs, len(gain))
                n, total = np.bincount(row, minlength=len(piece)), np.zeros(len(piece), np.int64)
                np.add.at(total, row, gain[bucket])
                weight = np.floor_divide(total, np.maximum(n, 1))
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(words.astype(np.int64)), pa.array(weight)],
                    names=["doc_id", "n_features", "n_words", "weight"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_features long, n_words long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """Thousandths of a Gumbel deviate from the hash of seed and id, floored."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, seed: int = 2024, runs: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of ``docs`` (doc_id, text); ``target`` has texts alone.

    ``percent`` of the rows with ``least_words`` are drawn, those of the highest score, ties to the smaller id; rank is null for others.
    Places come from a range partitioning by score and a prefix sum over the partitions' totals.

    Nulls: a null text has no words, a null id is last among ties and its noise is that of an empty id. Empty texts weigh 0. Repeated
    rows each have a row, and each a rank if they are drawn. Long texts are read whole, in slices of rows; a long word is hashed by itself. Empty
    tables: no rows; with an empty target the corpus alone decides. Other columns are ignored.
    """
    gain = gains(bucket_counts(docs, runs, buckets), bucket_counts(target, runs, buckets))
    scored = weigh(docs, gain, runs).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).withColumn("eligible", F.col("n_words") >= least_words)
    order = [F.col("eligible").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("weight")]
    ranged = staged(scored.repartitionByRange(fine_grained(docs), *order).withColumn("part", F.spark_partition_id()), "ranged")
    # One row a range partition: their number bounds this table.
    totals = ranged.groupBy("part").agg(F.count_if("eligible").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), F.floor(F.sum("n").over(Window.partitionBy()) * percent / 100).alias("most"))
    place = F.col("base") + F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return (
        ranged.join(F.broadcast(bases), "part")
        .withColumn("place", place)
        .select("doc_id", "n_features", "weight", "score", F.when(F.col("eligible") & (F.col("place") <= F.col("most")), F.col("place")).cast("long").alias("rank"))
    )


def keep(docs: DataFrame, target: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that :func:`resample` draws, with all their columns. Rows that share an id are drawn together."""
    drawn = staged(resample(docs, target, **how).where("rank is not null").select(F.col("doc_id").alias("drawn")).distinct(), "drawn")
    kept = staged(docs.join(drawn, docs["doc_id"].cast("long").eqNullSafe(drawn["drawn"]), "left_semi"), "resampled")
    release(drawn)
    return kept
