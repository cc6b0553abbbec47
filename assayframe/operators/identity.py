"""Content-addressed identity: row hashes, canonical JSON and digests of tables."""

from __future__ import annotations

import datetime
import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def text_id(prefix: str, *parts: Column) -> Column:
    """prefix-sha256 of the parts joined by a bar."""
    return F.concat(F.lit(prefix + "-"), F.sha2(F.concat_ws("|", *(p.cast("string") for p in parts)), 256))


def _plain(value: object) -> object:
    if isinstance(value, (datetime.date, datetime.time)):
        return value.isoformat()
    raise TypeError(f"no canonical JSON for {type(value).__name__}")


def canonical(row: Column) -> Column:
    """A struct as JSON with sorted keys, compact separators and raw Unicode.

    Numbers keep their type and every digit: a long stays a long beside nulls, a double is the shortest text that reads back as
    itself. NaN, infinities, binary and decimals fail. Dates and times are ISO text.
    """

    @F.arrow_udf("string")
    def encode(rows: pa.Array) -> pa.Array:
        # From Arrow values straight to Python's, so that no batch decides on a type.
        lines = (json.dumps(r, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False, default=_plain) for r in rows.to_pylist())
        return pa.array(lines, pa.string())

    return encode(row)


def canonical_json(df: DataFrame, name: str = "json") -> DataFrame:
    """Adds the row as canonical JSON."""
    return df.withColumn(name, canonical(F.struct(*(F.col(f"`{c}`") for c in df.columns))))


def row_hash(df: DataFrame, name: str = "row_sha256") -> DataFrame:
    """Adds the sha256 of the row's canonical JSON."""
    return canonical_json(df, "_json").withColumn(name, F.sha2("_json", 256)).drop("_json")


def vector_digest(vector: Column) -> Column:
    """SHA-256 of an array of numbers as little-endian doubles, after their count; null for a null array or one with null in it."""

    @F.arrow_udf("string")
    def run(vectors: pa.Array) -> pa.Array:
        out = []
        for v in vectors:
            values = None if v.as_py() is None else v.values
            if values is None or values.null_count:
                out.append(None)
            else:
                out.append(hashlib.sha256(len(values).to_bytes(8, "little") + np.asarray(values, "<f8").tobytes()).hexdigest())
        return pa.array(out, pa.string())

    return run(vector.cast("array<double>"))


def verify_rows(df: DataFrame, name: str = "row_sha256") -> DataFrame:
    """Rows whose stored hash isn't that of their other columns; a missing hash differs."""
    found = F.sha2(canonical(F.struct(*(c for c in df.columns if c != name))), 256)
    return df.where(~found.eqNullSafe(F.col(name)))


def source_digest(df: DataFrame, index: str, text: str, buckets: int = 1024, fan: int = 1024) -> DataFrame:
    """One digest of a table in index order: row hashes to bucket digests, and those by ``fan`` to the digest above, up to one.

    A bucket gathers the hashes of a range of indices, 1024 rows wide where indices are distinct; no level gathers more than
    ``fan`` digests in a row. The height follows from the largest index.
    """
    rows = df.select(F.col(index).alias("i"), F.sha2(F.coalesce(text, F.lit("")), 256).alias("h"))
    level = rows.groupBy(F.expr(f"i div {buckets}").alias("b")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("i", "h"))).alias("x"))
    joined = F.sha2(F.array_join("x.h", "\n"), 256).alias("h")
    level = level.select("b", "n", joined)
    span = df.agg(F.min(index), F.max(index)).first()
    width = 1 if span[0] is None else max(abs(span[0]), abs(span[1])) // buckets + 1
    while width > fan:
        level = level.groupBy(F.expr(f"b div {fan}").alias("b")).agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct(F.col("b").alias("i"), "h"))).alias("x")).select("b", "n", joined)
        width = width // fan + 1
    return level.agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list(F.struct("b", "h"))).getField("h"), "\n"), 256).alias("digest"))
