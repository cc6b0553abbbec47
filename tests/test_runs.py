"""Run manifests, head checkpoints and posterior draws."""

import json

import numpy as np
import pytest
from assayframe.operators import head
from assayframe.operators.validation import ContractError
from assayframe.sources import runs


def test_runs_are_recorded_once_each(spark, tmp_path):
    path = str(tmp_path / "runs")
    with runs.recorded(spark, path, "score") as facts:
        facts["rows"] = 3
    with pytest.raises(KeyError), runs.recorded(spark, path, "score"):
        raise KeyError("a\nb")
    got = {r.status: r for r in runs.runs(spark, path).collect()}
    assert json.loads(got["success"].facts) == {"rows": 3} and got["success"].error is None
    assert got["failed"].error.startswith("KeyError:") and "\n" not in got["failed"].error
    assert got["failed"].run_id != got["success"].run_id


def test_head_round_trip(spark, tmp_path):
    path = str(tmp_path / "head")
    runs.save_head(spark, path, [0.5, -1e-300], [2.0, 3.0])
    assert runs.load_head(spark, path) == ([0.5, -1e-300], [2.0, 3.0])
    with pytest.raises(Exception, match="(?i)exist"):
        runs.save_head(spark, path, [1.0], [1.0])
    bad = str(tmp_path / "bad")
    runs.save_head(spark, bad, [float("nan")], [1.0])
    with pytest.raises(ContractError):
        runs.load_head(spark, bad)


def test_settings_hash():
    assert runs.settings_hash({"a": 1, "b": {"c": 2, "d": 3}}) == runs.settings_hash({"b": {"d": 3, "c": 2}, "a": 1})
    assert runs.settings_hash({"a": 1}) != runs.settings_hash({"a": 2})


def test_draws(spark):
    w, h = np.array([1.0, -2.0]), np.array([4.0, 100.0])
    rows = head.draw_weights(spark, w, h, 4000, 7).collect()
    x = np.array([r.weights for r in rows])
    assert np.allclose(x.mean(axis=0), w, atol=0.05) and np.allclose(x.std(axis=0), 1 / np.sqrt(h), rtol=0.05)
    again = head.draw_weights(spark, w, h, 4000, 7).collect()
    assert sorted(rows) == sorted(again)
    few = {r.draw: r.weights for r in head.draw_weights(spark, w, h, 10, 7).collect()}
    assert all(few[r.draw] == r.weights for r in rows if r.draw < 10)  # a draw doesn't depend on how many there are
    assert abs(np.corrcoef(x.T)[0, 1]) < 0.06


def test_tree_sum_of_many_tasks(spark):
    parts = spark.range(1000).selectExpr("id AS part", "CAST(id % 3 AS INT) AS block", "array(CAST(id AS DOUBLE), 1.0D) AS values").repartition(7)
    got = {r.block: r["values"] for r in head.tree_sum(parts, fan=16).collect()}
    assert got == {b: [float(sum(range(b, 1000, 3))), float(len(range(b, 1000, 3)))] for b in range(3)}


def test_fit_over_more_tasks_than_one_level(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 20))
    y = (x[:, 0] + rng.normal(size=600) > 0).astype(int)
    rows = spark.createDataFrame([(v.tolist(), int(t)) for v, t in zip(x, y, strict=True)], "x array<double>, target int")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        w, h = head.fit_map(rows.repartition(90))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    one, g = head.fit_map(rows.coalesce(1))
    assert np.allclose(w, one, atol=1e-9) and np.allclose(h, g, atol=1e-9)
