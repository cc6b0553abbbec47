"""The typed source, the writer with a ledger and tensor checkpoints."""

import json
import struct
from hashlib import sha256

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from assayframe.operators.validation import ContractError
from assayframe.sources import checked, jsonl, tensors
from pyspark.sql import functions as F


@pytest.fixture
def folder(tmp_path):
    pq.write_table(pa.table({"id": pa.array(range(100), pa.int64()), "t": [f"x{i}" if i % 9 else None for i in range(100)]}), tmp_path / "a.parquet", row_group_size=30)
    pq.write_table(pa.table({"id": pa.array([1, 2, 3], pa.int32()), "t": ["a", "b", "c"], "extra": [1, 2, 3]}), tmp_path / "b.parquet")
    pq.write_table(pa.table({"t": pa.array(["only"], pa.large_string())}), tmp_path / "c.parquet")
    return str(tmp_path)


def test_ordinals_and_faults(spark, folder):
    rows = checked.typed(spark, folder, "id bigint, t string NOT NULL")
    got = {r.ordinal: r for r in rows.repartition(7).collect()}
    assert sorted(got) == list(range(104)) and rows.rdd.getNumPartitions() == 6
    for i in range(100):
        assert got[i].id == i and got[i].t == (f"x{i}" if i % 9 else None) and got[i].faults == ([] if i % 9 else ["t: null"])
    assert [got[i].faults for i in (100, 103)] == [["id: int32 for int64"], ["id: missing"]] and got[101].id is None and got[101].t == "b"
    assert got[103].file.endswith("c.parquet") and got[103].t == "only"


def test_empty_folder(spark, tmp_path):
    assert checked.typed(spark, str(tmp_path), "id bigint").count() == 0


def test_ledger_of_the_write(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.range(1000).select("id", F.concat(F.lit("é"), F.col("id").cast("string")).alias("t"))
    checked.publish_once(rows, path, ["id"])
    assert jsonl.unpublished(spark, path) == []
    assert sorted(map(tuple, jsonl.published(spark, path, "id long, t string").collect())) == [(i, f"é{i}") for i in range(1000)]
    part = next(f for f in (tmp_path / "out" / "data").iterdir() if f.stat().st_size)
    part.write_bytes(part.read_bytes()[:-1] + b" ")
    assert jsonl.unpublished(spark, path) == [f"file {part.name}"]


def test_a_task_that_breaks_off_leaves_no_publication(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.range(0, 400, 1, 4).select("id", F.when(F.col("id") == 333, F.raise_error(F.lit("broke off"))).otherwise(F.lit("x")).alias("t"))
    checked.register(spark)
    with pytest.raises(Exception, match="broke off"):
        rows.select(F.concat_ws("|", F.col("id").cast("string"), "t")).write.format("ledger_lines").mode("append").option("path", path).save()
    assert jsonl.unpublished(spark, path) == ["no marker"]
    (tmp_path / "out" / "data" / "part-late.txt").write_text("of a task that ended after all\n")
    checked.publish_once(rows.where("id < 300"), path, ["id"])
    assert jsonl.unpublished(spark, path) == [] and jsonl.published(spark, path, "id long, t string").count() == 300


def save(path, arrays, spoil=None):
    entries, data = {"__metadata__": {"format": "pt"}}, b""
    for name, (dtype, shape, raw) in arrays.items():
        entries[name] = {"dtype": dtype, "shape": shape, "data_offsets": [len(data), len(data) + len(raw)]}
        data += raw
    (spoil or (lambda e: None))(entries)
    text = json.dumps(entries).encode()
    path.write_bytes(struct.pack("<Q", len(text)) + text + data)


def test_tensor_checkpoint(spark, tmp_path):
    arrays = {f"layer.{i}.weight": ("F32", [4, i + 1], bytes([i]) * 16 * (i + 1)) for i in range(5)} | {"scale": ("BF16", [], b"\x00\x3f"), "none": ("F16", [0, 3], b"")}
    file = tmp_path / "adapter.safetensors"
    save(file, arrays)
    assert tensors.layout_faults(str(file)) == []
    found = tensors.tensors(spark, str(tmp_path))
    got = {r.name: r for r in found.collect()}
    assert {n: (r.dtype, r["shape"], r.sha256) for n, r in got.items()} == {n: (d, s, sha256(raw).hexdigest()) for n, (d, s, raw) in arrays.items()}
    expected = spark.createDataFrame([(r.name, r.dtype, r["shape"], r.sha256) for r in got.values()], "name string, dtype string, shape array<long>, sha256 string")
    assert tensors.checkpoint_faults(found, expected).count() == 0
    raw = bytearray(file.read_bytes())
    raw[got["layer.3.weight"].start + 5] ^= 1
    file.write_bytes(bytes(raw))
    told = expected.where("name <> 'scale'").unionByName(expected.where("name = 'scale'").withColumn("name", F.lit("gone")))
    told = told.withColumn("dtype", F.when(F.col("name") == "layer.1.weight", "F16").otherwise(F.col("dtype")))
    faults = {(r.name, r.fault) for r in tensors.checkpoint_faults(tensors.tensors(spark, str(tmp_path)), told).collect()}
    assert faults == {("layer.3.weight", "bytes"), ("scale", "unknown"), ("gone", "missing"), ("layer.1.weight", "type or shape")}


def test_tensor_layout(spark, tmp_path):
    arrays = {"a": ("F32", [2], bytes(8)), "b": ("I8", [4], bytes(4)), "c": ("Q4", [1], bytes(1))}
    file = tmp_path / "x.safetensors"

    def spoil(e):
        e["a"]["shape"] = [3]
        e["b"]["data_offsets"] = [9, 13]

    save(file, arrays, spoil)
    assert tensors.layout_faults(str(file)) == ["a: 8 bytes for F32 [3]", "b: begins at 9, not at 8", "c: type Q4", "c: begins at 12, not at 13"]
    file.write_bytes(file.read_bytes()[:-3])
    assert any(f.endswith("left over") for f in tensors.layout_faults(str(file)))
    assert tensors.tensors(spark, str(tmp_path)).where("name = 'b'").first().sha256 is None
    file.write_bytes(b"\xff" * 20)
    with pytest.raises(ContractError):
        tensors.header(str(file))
