"""Checkpoints of tensors: headers, byte ranges and their digests.

A tensor file begins with the length of its header as a little-endian 64-bit number, then the header, a JSON object of names with
type, shape and byte range, then the ranges. The driver reads headers; tasks digest ranges, one tensor each, in pieces.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from hashlib import sha256
from math import prod

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.validation import ContractError
from .checked import files_below, open_path

#: Bytes of one element of each type.
WIDTHS = {"BOOL": 1, "U8": 1, "I8": 1, "F8_E4M3": 1, "F8_E5M2": 1, "I16": 2, "U16": 2, "F16": 2, "BF16": 2, "I32": 4, "U32": 4, "F32": 4, "I64": 8, "U64": 8, "F64": 8}
#: Bytes of a header at most, and of a range that a task reads at once.
HEADER_BYTES, PIECE_BYTES = 100 << 20, 8 << 20
RANGES = "file string, name string, dtype string, shape array<long>, start long, stop long"


def header(path: str) -> tuple[dict, int, int]:
    """(entries, where the ranges begin, bytes of the file)."""
    system, at = open_path(path)
    with system.open_input_file(at) as f:
        size = f.size()
        length = int.from_bytes(f.read(8), "little")
        if size < 8 or length > min(HEADER_BYTES, size - 8):
            raise ContractError(f"{path}: no header")
        try:
            entries = json.loads(f.read(length))
        except ValueError:
            raise ContractError(f"{path}: header is no JSON") from None
    if not isinstance(entries, dict):
        raise ContractError(f"{path}: header is no object")
    entries.pop("__metadata__", None)
    return entries, 8 + length, size


def layout_faults(path: str) -> list[str]:
    """What is wrong with the ranges of a file: unknown types, sizes that aren't those of the shapes, gaps, overlaps and bytes left over."""
    entries, begin, size = header(path)
    faults, upto = [], 0
    for name, e in sorted(entries.items(), key=lambda i: (i[1].get("data_offsets", [0, 0]), i[0])):
        start, stop = e.get("data_offsets", [0, 0])
        if e.get("dtype") not in WIDTHS:
            faults.append(f"{name}: type {e.get('dtype')}")
        elif stop - start != WIDTHS[e["dtype"]] * prod(e.get("shape", [])):
            faults.append(f"{name}: {stop - start} bytes for {e['dtype']} {e.get('shape')}")
        if start != upto:
            faults.append(f"{name}: begins at {start}, not at {upto}")
        upto = max(upto, stop)
    return faults + ([f"{size - begin - upto} bytes left over"] if size - begin != upto else [])


def tensors(spark: SparkSession, path: str, suffix: str = ".safetensors") -> DataFrame:
    """(file, name, dtype, shape, start, stop, sha256) of each tensor of the files below a path; offsets are the file's. A range beyond its file has no digest."""
    rows = []
    for file in files_below(path, suffix):
        entries, begin, _ = header(file)
        rows += [(file, name, e.get("dtype"), list(e.get("shape", [])), begin + e["data_offsets"][0], begin + e["data_offsets"][1]) for name, e in entries.items()]

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for file, start, stop in zip(batch["file"], batch["start"], batch["stop"], strict=True):
                made, system = sha256(), open_path(path)[0]
                with system.open_input_file(file) as f:
                    f.seek(start)
                    for at in range(start, stop, PIECE_BYTES):
                        made.update(f.read(min(PIECE_BYTES, stop - at)))
                    out.append(made.hexdigest() if f.tell() == stop else None)
            yield batch.assign(sha256=out)

    table = spark.createDataFrame(rows, RANGES)
    return table.repartition(max(1, min(len(rows), 1000)), "file", "name").mapInPandas(digest, RANGES + ", sha256 string")


def checkpoint_faults(found: DataFrame, expected: DataFrame) -> DataFrame:
    """(name, fault): tensors that only one side has, or whose type, shape or bytes differ. ``expected`` has name, dtype, shape and sha256."""
    a = found.groupBy("name").agg(F.count("*").alias("n"), F.first(F.struct("dtype", "shape")).alias("kind"), F.first("sha256").alias("sha"))
    b = expected.select("name", F.struct("dtype", "shape").alias("told"), F.col("sha256").alias("told_sha"), F.lit(True).alias("known"))
    fault = (
        F.when(F.col("n").isNull(), "missing").when(F.col("known").isNull(), "unknown").when(F.col("n") > 1, "repeated").when(~F.col("kind").eqNullSafe(F.col("told")), "type or shape")
        .when(~F.col("sha").eqNullSafe(F.col("told_sha")), "bytes")
    )
    return a.join(b, "name", "full").select("name", fault.alias("fault")).where("fault IS NOT NULL")
