"""Verified JSON Lines sources and the verified publication of results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.identity import canonical, canonical_json
from ..operators.validation import ContractError, duplicates

#: Parts of a published folder: payload, ledger of its files, and the marker that names the ledger and comes last.
DATA, LEDGER, COMPLETE = "data", "ledger", "complete"
LEDGER_SCHEMA = "file string, bytes long, sha256 string"


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, sha256) of the files below a path."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        .select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    )


def _payload(spark: SparkSession, path: str) -> DataFrame:
    return file_digests(spark, path).where(~F.col("file").startswith("_") & ~F.col("file").startswith("."))


def misframed(spark: SparkSession, path: str) -> DataFrame:
    """Files that hold a carriage return or don't end in a line feed; an empty file is well framed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "length", "content").where(~F.col("file").startswith("_") & ~F.col("file").startswith("."))
    tail = F.expr("substring(content, -1)")
    return named.where((F.col("length") > 0) & ((tail != F.expr("X'0A'")) | F.expr("contains(content, X'0D')"))).select("file")


def not_canonical(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Lines that the canonical JSON of the row that they hold doesn't give back: other columns, missing ones, another order or spacing."""
    lines = spark.read.option("lineSep", "\n").text(path)
    row = F.from_json("value", schema, {"mode": "PERMISSIVE"})
    return lines.withColumn("row", row).where(F.col("row").isNull() | ~canonical(F.col("row")).eqNullSafe(F.col("value"))).select("value")


def read(
    spark: SparkSession, path: str, schema: StructType | str, unique: list[str] | None = None, rows: int | None = None, sha256: str | None = None, exact: bool = False
) -> DataFrame:
    """JSON Lines with a declared schema; a malformed row, repeated key, wrong count or wrong digest is an error.

    ``exact``: so are other framing than line feeds and lines that aren't the canonical JSON of the schema's columns.
    """
    if sha256 is not None:
        found = [r.sha256 for r in file_digests(spark, path).collect()]
        if found != [sha256]:
            raise ContractError(f"digest of {path}: {found}")
    if exact:
        if broken := misframed(spark, path).limit(3).collect():
            raise ContractError(f"framing of {path}: {[r.file for r in broken]}")
        if broken := not_canonical(spark, path, schema).limit(1).collect():
            raise ContractError(f"{path} holds a line that isn't canonical: {broken[0].value[:200]}")
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    if rows is not None and (n := df.count()) != rows:
        raise ContractError(f"{path} has {n} rows, not {rows}")
    if unique and duplicates(df, unique).limit(1).count():
        raise ContractError(f"{path} repeats {unique}")
    return df


def read_object(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A single JSON object as a one-row table."""
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "FAILFAST").json(path)


def read_any(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """A reader by suffix: .json, .jsonl, .parquet or text."""
    kind = path.rsplit(".", 1)[-1]
    if kind in ("json", "jsonl"):
        if schema is None:
            raise ContractError("JSON needs a schema")
        return read_object(spark, path, schema) if kind == "json" else read(spark, path, schema)
    return spark.read.parquet(path) if kind == "parquet" else spark.read.text(path)


def write(df: DataFrame, path: str, order: list[str], mode: str = "error") -> None:
    """Canonical JSON Lines in the order of the given columns, in one part for each sorted range."""
    canonical_json(df, "_json").orderBy(*order).select("_json").write.mode(mode).text(path)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def _ledger_digest(ledger: DataFrame) -> str:
    """Digest of a ledger: as many lines as the payload has files."""
    line = F.concat_ws("|", "file", F.col("bytes").cast("string"), "sha256")
    return ledger.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("d")).first()["d"]


def publish(df: DataFrame, path: str, order: list[str]) -> bool:
    """Write once: False if equal content is published there, an error if other content is.

    The payload comes first, then the ledger of its files, then the marker with the ledger's digest. A folder without a marker
    is a publication that broke off, and is written again.
    """
    spark = df.sparkSession
    if _exists(spark, f"{path}/{COMPLETE}/_SUCCESS"):
        if faults := unpublished(spark, path):
            raise ContractError(f"{path} is damaged: {faults}")
        old, lines = spark.read.text(f"{path}/{DATA}"), canonical_json(df, "_json").select(F.col("_json").alias("value"))
        if old.exceptAll(lines).limit(1).count() or lines.exceptAll(old).limit(1).count():
            raise ContractError(f"{path} holds other content")
        return False
    write(df, f"{path}/{DATA}", order, "overwrite")
    _payload(spark, f"{path}/{DATA}").coalesce(1).write.mode("overwrite").json(f"{path}/{LEDGER}")
    digest = _ledger_digest(spark.read.schema(LEDGER_SCHEMA).json(f"{path}/{LEDGER}"))
    spark.createDataFrame([(digest,)], "ledger_sha256 string").coalesce(1).write.mode("overwrite").json(f"{path}/{COMPLETE}")
    return True


def unpublished(spark: SparkSession, path: str) -> list[str]:
    """What is wrong with a published folder: a missing marker, a ledger that isn't the marker's, files that aren't the ledger's."""
    if not _exists(spark, f"{path}/{COMPLETE}/_SUCCESS"):
        return ["no marker"]
    ledger = spark.read.schema(LEDGER_SCHEMA).json(f"{path}/{LEDGER}")
    told = spark.read.schema("ledger_sha256 string").json(f"{path}/{COMPLETE}").first()
    if told is None or told[0] != _ledger_digest(ledger):
        return ["ledger"]
    return sorted(f"file {r.file}" for r in verify_ledger(spark, f"{path}/{DATA}", ledger).limit(20).collect())


def published(spark: SparkSession, path: str, schema: StructType | str, unique: list[str] | None = None) -> DataFrame:
    """The rows of a published folder, verified against ledger, marker and canonical form."""
    if faults := unpublished(spark, path):
        raise ContractError(f"{path}: {faults}")
    return read(spark, f"{path}/{DATA}", schema, unique=unique, exact=True)


def verify_ledger(spark: SparkSession, path: str, ledger: DataFrame) -> DataFrame:
    """Files whose bytes or digest differ from the ledger (file, bytes, sha256), or that one side lacks."""
    a = _payload(spark, path).select("file", F.struct("bytes", "sha256").alias("found"))
    b = ledger.select("file", F.struct("bytes", "sha256").alias("listed"))
    return a.join(b, "file", "full").where("NOT (found <=> listed)")


def unfinished(rows: DataFrame, finished: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't finished yet: how a run resumes."""
    return rows.join(finished.select(key).distinct(), key, "left_anti")


def stored_differences(stored: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, kind): rows that only one side has, that a side repeats, or whose other columns differ."""
    rest = [c for c in expected.columns if c not in keys]
    side = lambda df, n: df.groupBy(*keys).agg(F.count("*").alias(f"n_{n}"), F.first(F.struct(*rest)).alias(n))
    both = side(stored, "stored").join(side(expected, "expected"), keys, "full")
    kind = (
        F.when(F.col("n_stored").isNull(), "missing").when(F.col("n_expected").isNull(), "unknown").when((F.col("n_stored") > 1) | (F.col("n_expected") > 1), "repeated")
        .when(~F.col("stored").eqNullSafe(F.col("expected")), "different")
    )
    return both.select(*keys, kind.alias("kind")).where("kind IS NOT NULL")
