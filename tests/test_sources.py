"""JSON Lines sources, publication and ledgers."""

import os

import pytest
from assayframe.operators import identity, validation
from assayframe.sources import jsonl

KIND = "id long, t string"


@pytest.fixture
def rows(spark):
    return spark.createDataFrame([(2, "é"), (1, 'a"b')], KIND)


def test_round_trip(spark, rows, tmp_path):
    path = str(tmp_path / "out")
    assert jsonl.publish(rows, path, ["id"]) is True
    assert jsonl.publish(rows, path, ["id"]) is False
    with pytest.raises(validation.ContractError):
        jsonl.publish(rows.where("id = 1"), path, ["id"])
    back = jsonl.published(spark, path, KIND, unique=["id"])
    assert sorted(map(tuple, back.collect())) == [(1, 'a"b'), (2, "é")]
    with pytest.raises(validation.ContractError):
        jsonl.read(spark, f"{path}/data", KIND, rows=3)
    ledger = spark.read.schema(jsonl.LEDGER_SCHEMA).json(f"{path}/ledger")
    assert jsonl.verify_ledger(spark, f"{path}/data", ledger).count() == 0
    assert jsonl.verify_ledger(spark, f"{path}/data", ledger.limit(0)).count() > 0
    assert [r.id for r in jsonl.unfinished(rows, rows.where("id = 2"), "id").collect()] == [1]


def test_a_publication_that_broke_off_is_written_again(spark, rows, tmp_path):
    path = str(tmp_path / "out")
    jsonl.write(rows.where("id = 1"), f"{path}/data", ["id"])  # no ledger, no marker
    assert jsonl.unpublished(spark, path) == ["no marker"]
    assert jsonl.publish(rows, path, ["id"]) is True
    assert jsonl.published(spark, path, KIND).count() == 2


def test_damage_is_found(spark, rows, tmp_path):
    path = str(tmp_path / "out")
    jsonl.publish(rows, path, ["id"])
    part = next(tmp_path.glob("out/data/part-*"))
    part.write_text(part.read_text().replace("id", "di"))
    crc = part.with_name(f".{part.name}.crc")
    if crc.exists():
        os.remove(crc)
    assert jsonl.unpublished(spark, path) == [f"file {part.name}"]
    with pytest.raises(validation.ContractError):
        jsonl.published(spark, path, KIND)
    with pytest.raises(validation.ContractError):
        jsonl.publish(rows, path, ["id"])


@pytest.mark.parametrize(
    "content",
    ['{"id":1,"t":"a"}\r\n', '{"id":1,"t":"a"}', '{"id": 1,"t":"a"}\n', '{"t":"a","id":1}\n', '{"id":1,"t":"a","x":1}\n', '{"id":1}\n', '{"id":1,"t":"\\u00e9"}\n'],
)
def test_other_forms_are_not_exact(spark, tmp_path, content):
    path = tmp_path / "x.jsonl"
    path.write_bytes(content.encode())
    with pytest.raises(validation.ContractError):
        jsonl.read(spark, str(path), KIND, exact=True)


def test_exact_and_single_objects(spark, tmp_path):
    (tmp_path / "x.jsonl").write_bytes('{"id":1,"t":"é"}\n{"id":2,"t":null}\n'.encode())
    assert jsonl.read(spark, str(tmp_path / "x.jsonl"), KIND, exact=True, rows=2).count() == 2
    (tmp_path / "o.json").write_text('{\n "id": 7,\n "t": "z"\n}')
    assert tuple(jsonl.read_any(spark, str(tmp_path / "o.json"), KIND).first()) == (7, "z")
    spark.range(3).write.parquet(str(tmp_path / "p.parquet"))
    assert jsonl.read_any(spark, str(tmp_path / "p.parquet")).count() == 3
    assert jsonl.read_any(spark, str(tmp_path / "x.jsonl"), KIND).count() == 2
    with pytest.raises(validation.ContractError):
        jsonl.read_any(spark, str(tmp_path / "x.jsonl"))


def test_stored_differences(spark, rows):
    stored = spark.createDataFrame([(2, "é"), (1, "other"), (3, "x"), (4, "y"), (4, "y")], KIND)
    expected = rows.unionByName(spark.createDataFrame([(4, "y"), (5, None)], KIND))
    assert {(r.id, r.kind) for r in jsonl.stored_differences(stored, expected, ["id"]).collect()} == {(1, "different"), (3, "unknown"), (4, "repeated"), (5, "missing")}


def test_canonical_numbers(spark):
    df = spark.createDataFrame([(0.12345678901234566, 9007199254740993), (0.1234567890123457, None), (1e300, 1), (-0.0, 0)], "x double, n long").coalesce(1)
    lines = [r.json for r in identity.canonical_json(df).collect()]
    assert lines == ['{"n":9007199254740993,"x":0.12345678901234566}', '{"n":null,"x":0.1234567890123457}', '{"n":1,"x":1e+300}', '{"n":0,"x":-0.0}']
    hashed = identity.row_hash(df)
    assert identity.verify_rows(hashed).count() == 0
    assert identity.verify_rows(hashed.withColumn("n", hashed.n + 1)).count() == 3
    for bad in (float("nan"), float("inf")):
        with pytest.raises(Exception, match="JSON compliant"):
            identity.canonical_json(spark.createDataFrame([(bad,)], "x double")).collect()
