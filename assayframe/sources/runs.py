"""Run manifests, one file for each run, and checkpoints of the linear head."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession

from ..operators.validation import ContractError

SCHEMA = "run_id string, stage string, status string, started string, ended string, error string, facts string"
HEAD = "dim int, weight double, curvature double"


@contextmanager
def recorded(spark: SparkSession, path: str, stage: str) -> Iterator[dict]:
    """Records the block as a run of ``stage``: what it puts into the dictionary, or how it failed. The error goes on.

    Every run adds a file of its own below ``path``; none is replaced.
    """
    facts: dict = {}
    run, started = f"{stage}-{uuid.uuid4().hex}", _now()

    def note(status: str, error: str | None) -> None:
        row = (run, stage, status, started, _now(), error, json.dumps(facts, sort_keys=True, ensure_ascii=False))
        spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("append").json(path)

    try:
        yield facts
    except BaseException as e:
        note("failed", " ".join(f"{type(e).__name__}: {e}".split())[:500])
        raise
    note("success", None)


def runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).json(path)


def _now() -> str:
    return datetime.now(UTC).isoformat()


def save_head(spark: SparkSession, path: str, weights, curvature) -> None:
    """One row for each dimension, the bias last; an existing checkpoint is an error."""
    rows = [(i, float(w), float(c)) for i, (w, c) in enumerate(zip(weights, curvature, strict=True))]
    spark.createDataFrame(rows, HEAD).coalesce(1).write.mode("error").parquet(path)


def load_head(spark: SparkSession, path: str) -> tuple[list[float], list[float]]:
    """Weights and curvatures in order of dimension, which must be 0, 1, 2, ... with finite values."""
    rows = spark.read.schema(HEAD).parquet(path).orderBy("dim").collect()  # as long as a vector
    if [r.dim for r in rows] != list(range(len(rows))) or not rows:
        raise ContractError(f"{path}: dimensions are missing or repeated")
    if any(v is None or v - v != 0 for r in rows for v in (r.weight, r.curvature)):
        raise ContractError(f"{path}: values aren't finite")
    return [r.weight for r in rows], [r.curvature for r in rows]


def settings_hash(settings: dict) -> str:
    """SHA-256 of settings whatever the order of their keys, at any depth."""
    from hashlib import sha256

    return sha256(json.dumps(settings, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False).encode()).hexdigest()
