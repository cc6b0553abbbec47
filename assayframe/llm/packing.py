"""Packing token streams into fixed windows by multiway differencing.

No shuffle: each task encodes its documents, full windows leave at once, and the rests gather in groups of a
bounded number of tokens. A group is divided into windows by Karmarkar-Karp differencing: the two partial
partitions with the largest imbalance are merged, the heavy windows of one onto the light windows of the other.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices
from .tokens import BlockTokenizer

WINDOW = 2048
#: Tokens that a group holds before it is packed: bounds a task's memory and the differencing.
GROUP_TOKENS = 512 * WINDOW
#: Longest piece of a rest; several pieces a window let differencing level the windows.
PIECE = 512
SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)


def difference(sizes: np.ndarray, k: int) -> list[list[int]]:
    """Divide ``sizes`` into ``k`` sets of near-equal sums; returns the indices of each set."""
    if k <= 1:
        return [list(range(len(sizes)))]
    left, right = [], []  # node -> children; nodes below len(sizes) are items
    n = len(sizes)
    heap = []
    for i, size in enumerate(sizes):
        heap.append((-int(size), i, np.array([size]), np.array([i])))
    heapq.heapify(heap)
    tie = n
    while len(heap) > 1:
        _, _, a, a_nodes = heapq.heappop(heap)
        _, _, b, b_nodes = heapq.heappop(heap)
        # a and b hold their non-empty windows, heaviest first; the others are empty.
        over = len(a) + len(b) - k
        if over <= 0:
            sums, nodes = np.concatenate([a, b]), np.concatenate([a_nodes, b_nodes])
        else:
            # b's heaviest windows take the empty ones of a; its lighter ones meet a's lightest, crosswise.
            first, rest = len(a) - over, len(b) - over
            left.extend(a_nodes[first:].tolist())
            right.extend(b_nodes[rest:][::-1].tolist())
            ids = np.arange(n + len(left) - over, n + len(left))
            sums = np.concatenate([a[:first], a[first:] + b[rest:][::-1], b[:rest]])
            nodes = np.concatenate([a_nodes[:first], ids, b_nodes[:rest]])
        order = np.argsort(-sums, kind="stable")
        sums, nodes = sums[order], nodes[order]
        least = int(sums[-1]) if len(sums) == k else 0
        heapq.heappush(heap, (least - int(sums[0]), tie, sums, nodes))
        tie += 1
    out = []
    for node in heap[0][3].tolist() if heap else []:
        stack, items = [node], []
        while stack:
            x = stack.pop()
            if x < n:
                items.append(x)
            else:
                stack += [left[x - n], right[x - n]]
        out.append(items)
    return out


def pack_group(sizes: np.ndarray, window: int) -> list[list[int]]:
    """Windows of a group: as few as the total allows, one more whenever a window is over capacity."""
    k = max(1, -(-int(sizes.sum()) // window))
    while True:
        sets = difference(sizes, k)
        if max(int(sizes[s].sum()) for s in sets) <= window:
            return sets
        k += 1


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = 1,
    window: int = WINDOW,
    group_tokens: int = GROUP_TOKENS,
    piece: int = PIECE,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: which ids of which document stand where in which sequence.

    With ``with_ids`` the piece's ids come too (array<int>); a sequence's ids in order of offset, padded to
    ``window``, are the training sequence.

    Nulls: a null text is empty and has the end id only; a null doc_id is carried. Empty and repeated rows are
    packed like any other; a very long text becomes full windows and one rest. Empty table: no rows. Other
    columns are ignored. sequence_id is unique and holds the task's number in its upper bits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = BlockTokenizer.open(tokenizer)
        context = TaskContext.get()
        next_id = (context.partitionId() if context else 0) << 33
        pool: list[tuple] = []
        held = 0

        def rows(done: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*done, strict=True))
            kinds = [pa.int64()] * 7 + [pa.list_(pa.int32())] * with_ids
            names = [*(f.split()[0] for f in SCHEMA.split(", ")), *["ids"] * with_ids]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, type=t) for c, t in zip(cols, kinds, strict=True)], names=names
            )

        def flush() -> list[tuple]:
            nonlocal next_id, held
            done = []
            for chosen in pack_group(np.array([p[2] for p in pool], dtype=np.int64), window):
                at = 0
                for i in chosen:
                    p = pool[i]
                    done.append((*p[:5], next_id, at, *p[5:]))
                    at += p[2]
                next_id += 1
            pool.clear()
            held = 0
            return done

        for batch in batches:
            for part in text_slices(batch, "text"):
                offsets, ids = coder.encode(part.column("text"), end_id)
                raw, done = memoryview(ids.astype("<u4").tobytes()), []
                for r, doc in enumerate(part.column("doc_id").to_pylist()):
                    lo, hi = int(offsets[r]), int(offsets[r + 1])
                    at = lo
                    while at < hi:
                        whole = hi - at >= window
                        step = window if whole else min(piece, hi - at)
                        got = (doc, at - lo, step, zlib.crc32(raw[4 * at : 4 * (at + step)]), hi - lo)
                        if with_ids:
                            got += (ids[at : at + step].astype(np.int32),)
                        if whole:
                            done.append((*got[:5], next_id, 0, *got[5:]))
                            next_id += 1
                        else:
                            pool.append(got)
                            held += step
                        at += step
                    if held >= group_tokens:
                        done += flush()
                if done:
                    yield rows(done)
        if pool:
            yield rows(flush())

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, SCHEMA + (", ids array<int>" if with_ids else "")
    )
