"""Byte-level BPE over ranks: every distinct word is encoded once, ids are joined back by position.

A task cuts its documents into blocks. In a block each pre-token has a code, a document is its codes in order
(position is the place in that list), and the block's distinct pre-tokens, dealt out by a hash, meet those of all
other blocks in the task that encodes them. The ids return to the block, where documents are laid out again and
joined with the token-byte table by id. Shuffled are distinct words of blocks and packed codes, never a row for each
occurrence. A text is read and split once: words and positions leave the task as rows of one exchange, which the two
sides of the join read in turn.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fine_grained, text_slices

#: Bytes of text of a block and pre-tokens of a run of its documents: they bound a task's memory.
BLOCK_BYTES, RUN_CODES = 24 << 20, 1 << 20
#: Rows of words and of positions. A word row goes to ``lot``; a position row stays with its block.
_ROW = pa.schema(
    [("lot", pa.int32()), ("block", pa.int64()), ("owner", pa.int64()), ("n_words", pa.int64()), ("docs", pa.list_(pa.int64())),
     ("codes", pa.binary()), ("sizes", pa.binary()), ("words", pa.binary())]
)
_ROW_DDL = "lot int, block long, owner long, n_words long, docs array<long>, codes binary, sizes binary, words binary"
_SPACE = r"[\t-\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: A cut before this space would split a run of white space; such texts are matched whole.
ODD = rf"\x01|{_SPACE} (?:{_SPACE}|\z)"


@lru_cache(2)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(2)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks(path), special_tokens={})


@lru_cache(2)
def token_bytes(path: str) -> pa.Array:
    """The token-byte table that decoding joins: row i holds token i. Its size is that of the vocabulary."""
    of = {i: b for b, i in ranks(path).items()}
    return pa.array([of.get(i) for i in range(max(of) + 1)], pa.large_binary())


def pack_codes(codes: np.ndarray) -> bytes:
    """Seven bits a byte, low bits first, high bit set on all but a code's last byte."""
    codes = codes.astype(np.uint64)
    sizes = 1 + (codes > 0x7F).astype(np.int64) + (codes > 0x3FFF) + (codes > 0x1FFFFF) + (codes > 0xFFFFFFF)
    starts = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint8)
    for k in range(int(sizes.max(initial=0))):
        has = sizes > k
        byte = (codes[has] >> np.uint64(7 * k)) & np.uint64(0x7F)
        out[starts[has] + k] = byte | np.where(sizes[has] > k + 1, 0x80, 0).astype(np.uint64)
    return out.tobytes()


def unpack_codes(raw: bytes) -> np.ndarray:
    data = np.frombuffer(raw, np.uint8)
    ends = np.flatnonzero(data < 0x80)
    if not len(ends):
        return np.zeros(0, np.int64)
    starts = np.concatenate(([0], ends[:-1] + 1))
    sizes, out = ends - starts + 1, np.zeros(len(ends), np.int64)
    for k in range(int(sizes.max())):
        has = sizes > k
        out[has] |= (data[starts[has] + k].astype(np.int64) & 0x7F) << (7 * k)
    return out


def gather(lens: np.ndarray, table: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lays out table rows (of ``lens`` values each) in the order of ``index``: (offsets, values)."""
    starts, each = np.cumsum(lens) - lens, lens[index]
    upto = np.concatenate(([0], np.cumsum(each)))
    return upto, table[np.arange(upto[-1]) - np.repeat(upto[:-1] - starts[index], each)]


def block_codes(texts: pa.Array, pattern: str) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(offsets, codes, words): text i is words[c] for c in codes[offsets[i]:offsets[i + 1]], frequent words first."""
    find = regex.compile(pattern).findall
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    odd = pc.match_substring_regex(texts, ODD)
    odd_rows = np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist()
    plain = pc.if_else(odd, pa.scalar("", pa.large_string()), texts) if odd_rows else texts
    split = pc.split_pattern(pc.replace_substring(plain, " ", "\x01 "), "\x01")
    chunks = split.flatten().dictionary_encode()
    found = list(map(find, chunks.dictionary.to_pylist()))
    n_chunks = len(found)
    found += [find(texts[r].as_py()) for r in odd_rows]  # matched whole
    lens = np.fromiter(map(len, found), np.int64, len(found))
    coded = pa.array(list(chain.from_iterable(found)), pa.large_string()).dictionary_encode()
    del found
    table = coded.indices.to_numpy(zero_copy_only=False)
    whole_at = int(lens[:n_chunks].sum())
    upto, codes = gather(lens[:n_chunks], table[:whole_at], chunks.indices.to_numpy(zero_copy_only=False))
    lists = split.offsets.to_numpy()
    offsets = upto[lists - lists[0]]
    if odd_rows:
        ends = whole_at + np.cumsum(lens[n_chunks:])
        whole = {r: table[end - n : end] for r, end, n in zip(odd_rows, ends, lens[n_chunks:], strict=True)}
        parts = [whole.get(r, codes[offsets[r] : offsets[r + 1]]) for r in range(len(texts))]
        offsets, codes = np.concatenate(([0], np.cumsum([len(p) for p in parts]))), np.concatenate(parts)
    counts = np.bincount(codes, minlength=len(coded.dictionary))
    order = np.argsort(-counts, kind="stable")
    order = order[: np.count_nonzero(counts)]
    rank = np.zeros(len(counts), np.int64)
    rank[order] = np.arange(len(order))
    return offsets, rank[codes], coded.dictionary.cast(pa.large_binary()).take(pa.array(order)).to_pylist()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Array, pa.Array]]:
    """(number, doc_ids, texts) of each block of a task; many small batches make one block."""
    context = TaskContext.get()
    number = (context.partitionId() if context else 0) << 32
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        for part in text_slices(batch, "text", BLOCK_BYTES):
            own = pc.sum(pc.binary_length(part.column("text"))).as_py() or 0
            if held and size + own > BLOCK_BYTES:
                table = pa.Table.from_batches(held).combine_chunks()
                yield number, table["doc_id"].combine_chunks(), table["text"].combine_chunks()
                held, size, number = [], 0, number + 1
            held.append(part)
            size += own
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield number, table["doc_id"].combine_chunks(), table["text"].combine_chunks()


def _runs(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs (a, b) of documents of about RUN_CODES codes, one document at least."""
    a = 0
    while a < len(offsets) - 1:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + RUN_CODES, "right")) - 1)
        yield a, b
        a = b


def _split_rows(batches: Iterator[pa.RecordBatch], pattern: str, lots: int) -> Iterator[pa.RecordBatch]:
    """Rows of ``_ROW``: positions of each block, then its distinct words by lot.

    A block's name is made from its words, so that a block that is made again from other rows has another name.
    """
    for number, doc_ids, texts in _blocks(batches):
        offsets, codes, words = block_codes(texts, pattern)
        block = np.uint64(xxhash.xxh3_64_intdigest(b"\0".join([str(number).encode(), str(len(codes)).encode(), *words]))).astype(np.int64).item()
        for a, b in _runs(offsets):
            yield pa.RecordBatch.from_pydict(
                {
                    "lot": [-1], "block": [block], "owner": [None], "n_words": [len(words)], "docs": [doc_ids.slice(a, b - a).to_pylist()],
                    "codes": [pack_codes(codes[offsets[a] : offsets[b]])], "sizes": [pack_codes(np.diff(offsets[a : b + 1]))], "words": [None],
                },
                schema=_ROW,
            )
        lot = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % lots
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(lot, kind="stable")
        bounds = np.searchsorted(lot[order], np.arange(lots + 1))
        for at in np.flatnonzero(np.diff(bounds)).tolist():
            own = order[bounds[at] : bounds[at + 1]]
            yield pa.RecordBatch.from_pydict(
                {
                    "lot": [at], "block": [None], "owner": [block], "n_words": [None], "docs": [None],
                    "codes": [pack_codes(np.diff(own, prepend=0))], "sizes": [pack_codes(sizes[own])], "words": [b"".join([words[i] for i in own.tolist()])],
                },
                schema=_ROW,
            )


def _coded_rows(batches: Iterator[pa.RecordBatch], coder: tiktoken.Encoding) -> Iterator[pa.RecordBatch]:
    """The words of each row as counts and ids. A word's rows share this task, so it is encoded once for all blocks."""
    seen: dict[bytes, int] = {}  # place in ids
    ids: list[list[int]] = []
    for batch in batches:
        for at in range(0, len(batch), 64):
            part = batch.slice(at, 64)
            sizes = [unpack_codes(s) for s in part.column("sizes").to_pylist()]
            upto = np.concatenate(([0], np.cumsum(np.concatenate(sizes))))
            raw = pa.py_buffer(b"".join(part.column("words").to_pylist()))
            words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(upto) - 1, [None, pa.py_buffer(upto), raw]).dictionary_encode()
            place = []
            for word in words.dictionary.to_pylist():
                known = seen.get(word)
                if known is None:
                    known = seen[word] = len(ids)
                    ids.append(coder.encode_ordinary(word.decode()))
                place.append(known)
            mine = [ids[i] for i in place]
            lens = np.fromiter(map(len, mine), np.int64, len(mine))
            table = np.fromiter(chain.from_iterable(mine), np.int64, int(lens.sum()))
            index = words.indices.to_numpy(zero_copy_only=False)
            ends = np.cumsum([0, *map(len, sizes)])
            counts, flat = [], []
            for a, b in zip(ends, ends[1:], strict=False):
                _, got = gather(lens, table, index[a:b])
                counts.append(pack_codes(lens[index[a:b]]))
                flat.append(pack_codes(got))
            yield pa.RecordBatch.from_arrays(
                [pa.array([-1] * len(part), pa.int32()), part.column("owner"), part.column("codes"), pa.array(counts, pa.binary()), pa.array(flat, pa.binary())],
                names=["lot", "block", "codes", "counts", "ids"],
            )


def _laid_out(positions: pa.Table, words: pa.Table, table_path: str, finish: Callable[[pa.Array, pa.Array], list[pa.Array]], schema: pa.Schema) -> pa.Table:
    """Documents of one block: ids by position, and their bytes by a join with the token-byte table."""
    own = [np.cumsum(unpack_codes(c)) for c in words["codes"].to_pylist()]
    codes = np.concatenate([np.zeros(0, np.int64), *own])
    made = set(positions["n_words"].to_pylist())
    if made != {len(codes)} and made:
        raise ValueError("a block's input changed while the query ran; write the input to a table first")
    counts = np.concatenate([np.zeros(0, np.int64), *map(unpack_codes, words["counts"].to_pylist())])
    flat = np.concatenate([np.zeros(0, np.int64), *map(unpack_codes, words["ids"].to_pylist())])
    lens = np.zeros(len(codes), np.int64)
    lens[codes] = counts
    where = np.empty(len(codes), np.int64)
    where[codes] = np.arange(len(codes))
    _, table = gather(counts, flat.astype("<u4"), where)  # in order of code
    out = []
    for docs, raw, sizes in zip(positions["docs"], positions["codes"], positions["sizes"], strict=True):
        upto, ids = gather(lens, table, unpack_codes(raw.as_py()))
        n = len(docs)
        ends = upto[np.concatenate(([0], np.cumsum(unpack_codes(sizes.as_py()))))]
        found = token_bytes(table_path).take(pa.array(ids))
        byte_ends = np.frombuffer(found.buffers()[1], np.int64, len(found) + 1)[ends]
        each = [
            pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(at), data])
            for at, data in ((4 * ends, pa.py_buffer(ids)), (byte_ends, found.buffers()[2] or pa.py_buffer(b"")))
        ]
        out.append(pa.Table.from_arrays([docs.values, *finish(*each)], schema=schema))
    return pa.concat_tables(out) if out else schema.empty_table()


def _encode(docs: DataFrame, ranks_path: str, pattern: str, finish: Callable[[pa.Array, pa.Array], list[pa.Array]], ddl: str, schema: pa.Schema) -> DataFrame:
    n = fine_grained(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda b: _split_rows(b, pattern, n), _ROW_DDL)
    dealt = rows.repartition(n, "lot", "block")  # one exchange, which both sides read
    # Not deterministic, so that the filter stays above the exchange.
    kind = lambda of: F.when(F.spark_partition_id() >= 0, of)
    words = dealt.where(kind(F.col("lot") >= 0)).mapInArrow(
        lambda b: _coded_rows(b, encoding(ranks_path, pattern)), "lot int, block long, codes binary, counts binary, ids binary"
    )
    positions = dealt.where(kind(F.col("lot") < 0))
    return (
        positions.groupBy("lot", "block")
        .cogroup(words.groupBy("lot", "block"))
        .applyInArrow(lambda left, right: _laid_out(left, right, ranks_path, finish, schema), ddl)
    )


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, ids (raw little-endian unsigned 32-bit) and decoded (bytes) of every whole text.

    Nulls: a null text is empty; a null doc_id is carried. Empty texts give no ids; repeated rows each give a row;
    a very long text makes a block of its own. Empty table: no rows. Other columns are ignored.

    The input is read once. Where a lost executor makes a task run again on other rows than before, which a stored table
    rules out, the query fails instead of mixing the two.
    """
    kind = [("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())]
    return _encode(
        docs, ranks_path, pattern, lambda ids, decoded: [ids.cast(pa.binary()), decoded.cast(pa.binary())], "doc_id long, ids binary, decoded binary", pa.schema(kind)
    )


def digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Counts and digests of the ids and of the decoded bytes, per document: what :func:`encode` gives, hashed where it is made."""

    def sha(column: pa.Array) -> pa.Array:
        at, data = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1).tolist(), memoryview(column.buffers()[2])
        return pa.array([hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(at, at[1:], strict=False)], pa.string())

    def finish(ids: pa.Array, decoded: pa.Array) -> list[pa.Array]:
        return [pc.divide(pc.binary_length(ids), 4), sha(ids), sha(decoded)]

    kind = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    return _encode(docs, ranks_path, pattern, finish, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", pa.schema(kind))
