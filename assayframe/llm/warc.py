"""WARC files and a Merkle fixity audit between replicas.

A store is a table of WARC records as they lie in files: file, offset, record. It can be written as WARC files and read back from them.
For the audit records are hashed where they lie; a file's hashes in offset order are the leaves of a tree whose nodes cover ordered
offset ranges. The audit compares roots and descends only below nodes that differ.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import spread_join, staged

#: Children of a node: what one group gathers.
FANOUT = 16
#: Distinct page ids of a file, and records from which the pages of such ids are dealt out to further parts of it.
PAGES_PER_FILE, RECORDS_PER_FILE = 512, 4096
#: The date of records whose pages have none of their own: a fixed value, so that equal pages give equal records.
NO_DATE = "1970-01-01T00:00:00Z"
_ID = "md5(concat_ws('|', cast(page_id as string), coalesce(url, ''), coalesce(html, '')))"
_UUID = f"regexp_replace({_ID}, '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '$1-$2-$3-$4-$5')"
_RECORD = (
    f"concat('WARC/1.1\\r\\nWARC-Type: resource\\r\\nWARC-Record-ID: <urn:uuid:', {_UUID}, '>\\r\\nWARC-Date: {NO_DATE}\\r\\nWARC-Target-URI: ', coalesce(url, ''), "
    "'\\r\\nContent-Type: text/html\\r\\nContent-Length: ', cast(coalesce(octet_length(html), 0) as string), '\\r\\n\\r\\n', coalesce(html, ''), '\\r\\n\\r\\n')"
)
_FIELD = re.compile(rb"([!#-'*+.0-9A-Z^-z|~-]+):[ \t]*([^\r\n]*)\r\n")


def _file(per_file: int) -> Column:
    return F.coalesce(F.expr(f"cast(floor(page_id / {per_file}) as bigint)"), F.lit(-1).cast("long")).alias("file")


def _laid_out(pages: DataFrame, per_file: int, columns: dict[str, Column]) -> DataFrame:
    """file, part, leaf, page_id, offset, length, digest and ``columns``, which may be made from the ``record``, of every page."""
    record = F.expr(_RECORD)
    rows = pages.select(_file(per_file), "page_id", "url", F.monotonically_increasing_id().alias("pos"), record.alias("record")).select(
        "file", "page_id", "url", "pos", F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("digest"), *(c.alias(n) for n, c in columns.items())
    )
    large = pages.select(_file(per_file)).groupBy("file").agg(F.count("*").alias("n")).where(F.col("n") > RECORDS_PER_FILE)
    parts = large.select("file", F.ceil(F.col("n") / RECORDS_PER_FILE).alias("parts"))
    sized = spread_join(rows, "file", "pos", parts).withColumn("part", F.coalesce(F.pmod("pos", "parts"), F.lit(0)).cast("int"))
    order = Window.partitionBy("file", "part").orderBy("page_id", "url", "digest")
    upto = F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, 0))
    placed = sized.withColumn("offset", upto - F.col("length")).withColumn("leaf", F.row_number().over(order) - F.lit(1))
    return placed.select("file", "part", "leaf", "page_id", "offset", "length", "digest", *columns)


def store(pages: DataFrame, per_file: int = PAGES_PER_FILE) -> DataFrame:
    """file, part, page_id, offset and record of each page as a WARC resource record.

    A file takes the pages of ``per_file`` consecutive ids, in order of id, url and digest; a null id goes to file -1. Where it would
    hold many more records than RECORDS_PER_FILE, they are dealt out to parts of it, so that no file grows with the repeats of an id.
    Null urls and bodies are empty. Repeated pages are records of their own, with one record id. Other columns are ignored.
    """
    return _laid_out(pages, per_file, {"record": F.col("record")}).select("file", "part", "page_id", "offset", "record")


def index(pages: DataFrame, per_file: int = PAGES_PER_FILE, **views: Column) -> DataFrame:
    """The records of :func:`store` as the audit takes them, without their bytes: file, part, leaf, page_id, offset, length, digest, and for
    each of ``views``, such as what a replica holds in the place of ``record``, the digest of it. Only these are shuffled."""
    return _laid_out(pages, per_file, {n: F.sha2(c, 256) for n, c in views.items()})


def write_files(stored: DataFrame, path: str) -> None:
    """The store as WARC files, one below ``path`` for each file and part."""
    # A record ends with two line ends, the second of which the writer adds.
    lines = stored.repartition("file", "part").sortWithinPartitions("file", "part", "offset").selectExpr("file", "part", "left(record, length(record) - 2) AS line")
    lines.write.partitionBy("file", "part").option("lineSep", "\r\n").text(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """file, part, offset, record, type, record_id, uri and body (null url and body come back empty) of the records of WARC files below
    ``path``. A file that isn't framed as WARC is an error. A task holds one file at a time."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(path)
    named = files.select(
        F.regexp_extract("path", r"file=(-?\d+)", 1).cast("long").alias("file"), F.regexp_extract("path", r"part=(\d+)", 1).cast("int").alias("part"), "path", "content"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found = [(row["file"], row["part"], *r) for r in parse(row["content"], row["path"])]
                names = ["file", "part", "offset", "record", "type", "record_id", "uri", "body"]
                kinds = [pa.int64(), pa.int32(), pa.int64(), *[pa.string()] * 5]
                columns = list(zip(*found, strict=True)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return named.mapInArrow(run, "file long, part int, offset long, record string, type string, record_id string, uri string, body string")


def parse(raw: bytes, name: str = "") -> Iterator[tuple[int, str, str, str, str, str]]:
    """(offset, record, type, record id, uri, body) of each record of a WARC file; whatever breaks the format is an error."""
    at = 0
    while at < len(raw):
        head = raw.find(b"\r\n\r\n", at)
        if not raw.startswith((b"WARC/1.0\r\n", b"WARC/1.1\r\n"), at) or head < 0:
            raise ValueError(f"{name}: no WARC record at byte {at}")
        block = raw[at + 10 : head + 2]
        fields = {k.lower(): v for k, v in _FIELD.findall(block)}
        told = fields.get(b"content-length", b"")
        if b"".join(m[0] for m in re.finditer(_FIELD, block)) != block or not told.isdigit() or not {b"warc-type", b"warc-record-id", b"warc-date"} <= set(fields):
            raise ValueError(f"{name}: bad header at byte {at}")
        start, stop = head + 4, head + 4 + int(told)
        if raw[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"{name}: record at byte {at} isn't as long as it says")
        text = [x.decode() for x in (raw[at : stop + 4], fields[b"warc-type"], fields[b"warc-record-id"], fields.get(b"warc-target-uri", b""), raw[start:stop])]
        yield at, *text
        at = stop + 4


def records(stored: DataFrame) -> DataFrame:
    """The records of a store as the audit takes them: file, part, leaf, offset, length, digest, and page_id if it is known."""
    order = Window.partitionBy("file", "part").orderBy("offset")
    known = ["page_id"] if "page_id" in stored.columns else []
    slim = stored.select("file", "part", *known, "offset", F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("digest"))
    return slim.withColumn("leaf", F.row_number().over(order) - F.lit(1))


def tree(leaves: DataFrame, fanout: int = FANOUT) -> list[DataFrame]:
    """Levels of the trees of all files, leaves first: file, part, node, hash, start, end (offsets covered)."""
    level = leaves.select(
        "file",
        "part",
        F.col("leaf").cast("long").alias("node"),
        F.sha2(F.concat_ws("|", F.lit("leaf"), "offset", "length", "digest"), 256).alias("hash"),
        F.col("offset").alias("start"),
        (F.col("offset") + F.col("length")).alias("end"),
    )
    levels = [staged(level, "level")]
    while (levels[-1].agg(F.max("node")).first()[0] or 0) > 0:
        up = (
            levels[-1]
            .groupBy("file", "part", F.expr(f"node div {fanout}").alias("node"))
            .agg(
                F.array_sort(F.collect_list(F.struct("start", "end", "hash"))).alias("c"),
                F.min("start").alias("start"),
                F.max("end").alias("end"),
            )
            .select(
                "file",
                "part",
                "node",
                F.sha2(F.concat_ws("|", F.lit("node"), "start", "end", F.concat_ws("|", "c.hash")), 256).alias("hash"),
                "start",
                "end",
            )
        )
        levels.append(staged(up, "level"))
    return levels


def differing(a: list[DataFrame], b: list[DataFrame], fanout: int = FANOUT) -> DataFrame:
    """(file, part, node) of the leaves that differ or that one replica lacks, found from the roots down."""
    depth = max(len(a), len(b))
    open_nodes = None
    for k in range(depth - 1, -1, -1):
        sides = []
        for levels, name in ((a, "ha"), (b, "hb")):
            # A replica with lower trees has its root stand in for the missing levels.
            own = levels[min(k, len(levels) - 1)].select("file", "part", "node", F.col("hash").alias(name))
            if open_nodes is not None:
                own = own.withColumn("above", F.expr(f"node div {fanout}")).join(open_nodes, ["file", "part", "above"], "left_semi").drop("above")
            sides.append(own)
        open_nodes = (
            sides[0].join(sides[1], ["file", "part", "node"], "full").where("NOT (ha <=> hb)").select("file", "part", F.col("node").alias("above"))
        )
        if k:
            open_nodes = staged(open_nodes, "differing")
    return open_nodes.withColumnRenamed("above", "node")


def audit(a: DataFrame, b: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Every record of replica ``a`` (see :func:`records`) with ``corrupt``: whether ``b`` differs at its leaf.

    Records that only ``b`` has come with null in the columns of ``a``. Empty tables: no rows.
    """
    a, b = staged(a, "replica-a"), staged(b, "replica-b")
    bad = differing(tree(a, fanout), tree(b, fanout), fanout).withColumn("corrupt", F.lit(True))
    return (
        a.withColumn("node", F.col("leaf").cast("long"))
        .join(bad, ["file", "part", "node"], "full")
        .select("file", "part", "node", *(["page_id"] if "page_id" in a.columns else []), "offset", "length", "digest", F.coalesce("corrupt", F.lit(False)).alias("corrupt"))
    )
