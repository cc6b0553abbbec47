"""Token-id files with a minimal perfect hash index.

A store is three Parquet tables in one folder:

- ``segments``: raw little-endian id payloads of consecutive documents in ascending key order, with the
  offsets of the documents in the payload;
- ``index``: buckets of a minimal perfect hash. A bucket's displacement seeds send each of its keys to a slot
  of its own without gaps; the slot holds the key's fingerprint and where its documents start (segment, row,
  count). A look-up reads one bucket, computes one slot and compares one fingerprint: constant time;
- ``starts``: how many ids and documents precede each segment.

Spark writes all three through its committer, so a task lost midway leaves nothing behind.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fine_grained, new_path, text_slices
from .tokens import BlockTokenizer

#: Keys of an index bucket, on average.
BUCKET_KEYS = 1000
#: Keys that share a displacement seed, on average.
GROUP_KEYS = 4
#: Ids of a segment before it is closed.
SEGMENT_IDS = 1 << 20
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)  # fixed values: multipliers of a published 64-bit mixer


def mix(x: np.ndarray, seed) -> np.ndarray:
    """Mixes 64-bit hashes with seeds."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + (np.asarray(seed).astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        for shift, by in ((30, MIX[0]), (27, MIX[1])):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
        return x ^ (x >> np.uint64(31))


def build_mph(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seeds and slots of a minimal perfect hash over distinct 64-bit hashes."""
    n = len(hashes)
    groups = max(1, n // GROUP_KEYS)
    group = (mix(hashes, 0) % np.uint64(groups)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    bounds = np.searchsorted(group[order], np.arange(groups + 1))
    seeds, slots, taken = np.zeros(groups, np.int32), np.zeros(n, np.int32), np.zeros(n, bool)
    for g in np.argsort(-np.diff(bounds), kind="stable"):
        members = order[bounds[g] : bounds[g + 1]]
        if not len(members):
            continue
        keys, seed = hashes[members], 1
        while True:
            # Many seeds are tried at once: the last groups find few free slots.
            tries = np.arange(seed, seed + 64)
            at = (mix(keys[None, :], tries[:, None]) % np.uint64(n)).astype(np.int64)
            fine = ~taken[at].any(axis=1)
            if len(members) > 1:
                fine &= (np.diff(np.sort(at, axis=1), axis=1) > 0).all(axis=1)
            if fine.any():
                hit = int(np.argmax(fine))
                seeds[g], slots[members] = tries[hit], at[hit]
                taken[at[hit]] = True
                break
            seed += 64
    return seeds, slots


def probe_mph(hashes: np.ndarray, seeds: np.ndarray, n: int) -> np.ndarray:
    """The slot of each hash; for hashes that aren't in the set, any slot."""
    group = (mix(hashes, 0) % np.uint64(len(seeds))).astype(np.int64)
    return (mix(hashes, seeds[group]) % np.uint64(n)).astype(np.int64)


def _key_hash(key) -> list:
    return [F.xxhash64(key).alias("h"), F.xxhash64(key, F.lit(7)).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int").alias("fp")]


def write(
    docs: DataFrame, tokenizer: str, path: str, key: str = "doc_id", text: str = "text", end_id: int = 1
) -> None:
    """Encode every whole text, append ``end_id`` and write the store at ``path``.

    Nulls: a null text is empty; a null key sorts first and has an index entry of its own. Repeated keys keep
    all their documents, contiguous, and one index entry a segment. Empty table: empty tables. Very long texts
    make a segment of their own. Other columns are ignored.
    """
    spark = docs.sparkSession

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = BlockTokenizer.open(tokenizer)
        context = TaskContext.get()
        first = (context.partitionId() if context else 0) << 32
        held: list[tuple] = []

        def close() -> pa.RecordBatch:
            nonlocal first
            ids = np.concatenate([h[0] for h in held])
            kind = "<u2" if not len(ids) or ids.max() < 1 << 16 else "<u4"
            offsets = np.concatenate(([0], np.cumsum(np.concatenate([h[1] for h in held])))).astype("<i8")
            cols = [
                pa.array([first], pa.int64()),
                pa.array([len(offsets) - 1], pa.int64()),
                pa.array([len(ids)], pa.int64()),
                pa.array([2 if kind == "<u2" else 4], pa.int32()),
                pa.array([ids.astype(kind).tobytes()], pa.binary()),
                pa.array([offsets.tobytes()], pa.binary()),
                pa.array([np.concatenate([h[2] for h in held]).tobytes()], pa.binary()),
                pa.array([np.concatenate([h[3] for h in held]).tobytes()], pa.binary()),
            ]
            held.clear()
            first += 1
            return pa.RecordBatch.from_arrays(
                cols, names=["segment", "n_docs", "n_ids", "width", "payload", "offsets", "hashes", "prints"]
            )

        count = 0
        for batch in batches:
            for part in text_slices(batch, "text"):
                offsets, ids = coder.encode(part.column("text"), end_id)
                held.append((ids, np.diff(offsets), part.column("h").to_numpy(), part.column("fp").to_numpy()))
                count += len(ids)
                if count >= SEGMENT_IDS:
                    count = 0
                    yield close()
        if held:
            yield close()

    ordered = docs.select(F.col(key).alias("k"), *_key_hash(F.col(key)), F.col(text).alias("text"))
    # The hash of the text only breaks ties: it lets a key that holds many rows spread over partitions.
    by = [F.col("k").asc_nulls_first(), F.xxhash64("text")]
    (
        ordered.repartitionByRange(fine_grained(docs), *by)
        .sortWithinPartitions(*by)
        .select("h", "fp", "text")
        .mapInArrow(
            segments,
            "segment long, n_docs long, n_ids long, width int, payload binary, offsets binary, hashes binary, "
            "prints binary",
        )
        .write.parquet(f"{path}/segments")
    )
    segs = spark.read.parquet(f"{path}/segments")

    # Two-level prefix sums: over a task's segments, and over the tasks, of which there are few.
    task = F.shiftright("segment", 32).alias("task")
    counts = segs.select("segment", task, "n_ids", "n_docs")
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        counts.groupBy("task")
        .agg(F.sum("n_ids").alias("i"), F.sum("n_docs").alias("d"))
        .select("task", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_base") for c in "id"))
    )
    inside = Window.partitionBy("task").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    counts.select(
        "segment",
        "task",
        F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("i"),
        F.coalesce(F.sum("n_docs").over(inside), F.lit(0)).alias("d"),
    ).join(bases, "task").select(
        "segment", (F.col("i") + F.col("i_base")).alias("ids_before"), (F.col("d") + F.col("d_base")).alias("docs_before")
    ).write.parquet(f"{path}/starts")

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                h, fp = np.frombuffer(row["hashes"], "<i8"), np.frombuffer(row["prints"], "<i4")
                new = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (fp[1:] != fp[:-1]))))
                runs = np.diff(np.append(new, len(h)))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(h[new]),
                        pa.array(fp[new]),
                        pa.array(np.full(len(new), row["segment"])),
                        pa.array(new.astype(np.int32)),
                        pa.array(runs.astype(np.int32)),
                    ],
                    names=["h", "fp", "segment", "row", "n"],
                )

    def bucket(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "fp", "segment", "row"])
        h = pdf["h"].to_numpy()
        first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        runs = np.diff(np.append(first, len(h)))
        keys = h[first].astype(np.uint64)
        seeds, slots = build_mph(keys)
        at, many = np.zeros(len(keys), "<i4"), np.zeros(len(keys), "<i4")
        at[slots], many[slots] = first, runs
        cells = {c: pdf[c].to_numpy().astype(t).tobytes() for c, t in (("fp", "<i4"), ("segment", "<i8"), ("row", "<i4"), ("n", "<i4"))}
        return pd.DataFrame(
            [{"bucket": pdf["bucket"].iloc[0], "seeds": seeds.tobytes(), "at": at.tobytes(), "many": many.tobytes(), **cells}]
        )

    n_docs = segs.agg(F.sum("n_docs")).first()[0] or 0
    n_buckets = max(1, n_docs // BUCKET_KEYS)
    (
        segs.select("segment", "hashes", "prints")
        .mapInArrow(entries, "h long, fp int, segment long, row int, n int")
        .withColumn("bucket", F.pmod(F.col("h"), F.lit(n_buckets)))
        .groupBy("bucket")
        .applyInPandas(
            bucket,
            "bucket long, seeds binary, at binary, many binary, fp binary, segment binary, row binary, n binary",
        )
        .withColumn("n_buckets", F.lit(n_buckets).cast("long"))
        .write.parquet(f"{path}/index")
    )


def lookup(spark: SparkSession, path: str, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """The documents of the given keys, read from the files through the index.

    Returns key, start (ids before the document in the whole store), n_tokens, ids_crc32 and ids_raw
    (little-endian unsigned 32-bit). Keys that the store lacks give no row; a key given twice counts once.
    """
    import zlib

    index = spark.read.parquet(f"{path}/index")
    segs = spark.read.parquet(f"{path}/segments").select("segment", "width", "payload", "offsets")
    starts = spark.read.parquet(f"{path}/starts").select("segment", "ids_before")
    found = index.select("n_buckets").first()
    n_buckets = found[0] if found else 1
    kind = dict(keys.dtypes)[key]
    asked = (
        # Keys travel as text: beside a null, pandas would turn longs into floats.
        keys.select(F.col(key).cast("string").alias("k"), *_key_hash(F.col(key)))
        .distinct()
        .withColumn("bucket", F.pmod(F.col("h"), F.lit(n_buckets)))
    )

    def probe(ask: pd.DataFrame, idx: pd.DataFrame) -> pd.DataFrame:
        out = {"k": [], "segment": [], "row": [], "n": []}
        if len(idx) and len(ask):
            b = idx.iloc[0]
            get = lambda c, t: np.frombuffer(b[c], t)
            seeds, at, many, fp = get("seeds", "<i4"), get("at", "<i4"), get("many", "<i4"), get("fp", "<i4")
            slots = probe_mph(ask["h"].to_numpy().astype(np.uint64), seeds, len(at))
            first, runs = at[slots].astype(np.int64), many[slots].astype(np.int64)
            which = np.repeat(np.arange(len(ask)), runs)
            cell = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs) + np.repeat(first, runs)
            hit = fp[cell] == ask["fp"].to_numpy()[which]  # the stored fingerprint
            which, cell = which[hit], cell[hit]
            keys_there = ask["k"].to_list()
            out = {
                "k": [keys_there[i] for i in which],
                "segment": get("segment", "<i8")[cell],
                "row": get("row", "<i4")[cell],
                "n": get("n", "<i4")[cell],
            }
        return pd.DataFrame(out)

    hits = (
        asked.groupBy("bucket")
        .cogroup(index.groupBy("bucket"))
        .applyInPandas(probe, "k string, segment long, row int, n int")
    )

    def read(hit: pd.DataFrame, seg: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(hit) and len(seg):
            s = seg.iloc[0]
            offsets = np.frombuffer(s["offsets"], "<i8")
            ids = np.frombuffer(s["payload"], "<u2" if s["width"] == 2 else "<u4").astype("<u4")
            for k, row, n in zip(hit["k"].to_list(), hit["row"], hit["n"], strict=True):
                for r in range(row, row + n):
                    raw = ids[offsets[r] : offsets[r + 1]].tobytes()
                    rows.append((k, int(s["ids_before"] + offsets[r]), len(raw) // 4, zlib.crc32(raw), raw))
        return pd.DataFrame(rows, columns=["k", "start", "n_tokens", "ids_crc32", "ids_raw"])

    return (
        hits.groupBy("segment")
        .cogroup(segs.join(starts, "segment").groupBy("segment"))
        .applyInPandas(read, "k string, start long, n_tokens long, ids_crc32 long, ids_raw binary")
        .select(F.col("k").cast(kind).alias(key), "start", "n_tokens", "ids_crc32", "ids_raw")
    )


def write_and_read(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Write the store in the shared folder and read every document back through the index."""
    path = new_path(docs.sparkSession, "token-store")
    write(docs, tokenizer, path, end_id=end_id)
    return lookup(docs.sparkSession, path, docs.select("doc_id")).drop("ids_raw")
