"""SimHash near-duplicates by a binary trie self-join.

Fingerprints are the leaves of a binary trie. The join walks pairs of nodes of equal depth from the root,
adds an error for each bit on which the two paths differ and prunes a pair whose errors exceed the budget.

To share the walk out, bits are cut into ``budget + 1`` blocks: two fingerprints within the budget agree on one
block at least. Each block in turn is rotated to the top, and fingerprints that share it meet in one task, where
the walk has no errors left for the top block and the whole budget below it. A fingerprint has at most
sum C(bits, <= budget) neighbours, and equal fingerprints are one row, so nothing grows with the square of a group.
A task keeps a spanning forest of the links that it finds; the forests meet in rounds of joins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fine_grained, release, spread_join, staged, text_slices

BITS = 64
#: Node pairs held at once while walking.
FRONTIER = 1 << 19
#: Deviations that candidates may lie beyond the mean of texts at the threshold. More of them cost time, not precision.
SLACK = 3.0
#: Rows of 24 bytes up to which a table is broadcast.
BROADCAST_ROWS = 200_000
#: A fingerprint that holds more than one in so many rows is hot; there are fewer than HOT of them.
HOT = 1000


def shingles(text: str | None, words: int) -> list[bytes]:
    """Space-joined word shingles of the text with A-Z lowered; words are runs without ASCII white space."""
    split = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not split:
        return []
    if len(split) <= words:
        return [b" ".join(split)]
    return [b" ".join(split[i : i + words]) for i in range(len(split) - words + 1)]


def hashes(text: str | None, words: int, seed: int = 42) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.array([digest(s, seed) for s in shingles(text, words)], dtype=np.uint64)


def majority(h: np.ndarray) -> np.uint64:
    """A bit is 1 if it is set in over half of the hashes; no hash gives zero."""
    n = len(h)
    if not n:
        return np.uint64(0)
    bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 255):  # byte-wide sums are the fast ones
        counts += np.add.reduce(bits[at : at + 255], axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > n, bitorder="little").view("<u8")[0]


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id and fp, the 64-bit SimHash as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.array([majority(hashes(t.as_py(), words)) for t in batch.column("text")], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(out.view(np.int64))], names=["doc_id", "fp"]
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def trie_pairs(keys: np.ndarray, top: int, budget: int, bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i < j) of sorted distinct ``keys`` that agree on the ``top`` first bits and differ in
    ``budget`` bits at most. A node is a range of the sorted keys; a pair of nodes is a row of arrays."""
    n = len(keys)
    if n < 2:
        return
    head = keys >> np.uint64(64 - top) if top else np.zeros(n, np.uint64)
    lo = np.flatnonzero(np.concatenate(([True], head[1:] != head[:-1])))
    hi = np.append(lo[1:], n)
    keep = hi - lo > 1
    lo, hi = lo[keep], hi[keep]
    stack = [(top, lo, hi, lo, hi, np.zeros(len(lo), np.int8))]
    while stack:
        depth, alo, ahi, blo, bhi, err = stack.pop()
        if len(alo) > FRONTIER:  # halves, one after the other: memory stays bounded
            half = len(alo) // 2
            stack.append((depth, alo[half:], ahi[half:], blo[half:], bhi[half:], err[half:]))
            stack.append((depth, alo[:half], ahi[:half], blo[:half], bhi[:half], err[:half]))
            continue
        single = (ahi - alo == 1) & (bhi - blo == 1)
        if single.any():
            i, j = alo[single], blo[single]
            near = (i != j) & (np.bitwise_count(keys[i] ^ keys[j]) <= budget)
            if near.any():
                yield i[near], j[near]
            alo, ahi, blo, bhi, err = (x[~single] for x in (alo, ahi, blo, bhi, err))
        if not len(alo) or depth >= bits:
            continue
        bit = np.uint64(1 << (63 - depth))
        above = np.uint64((0xFFFFFFFFFFFFFFFF << (64 - depth)) & 0xFFFFFFFFFFFFFFFF)
        amid = np.clip(np.searchsorted(keys, (keys[alo] & above) | bit), alo, ahi)
        same = alo == blo
        bmid = np.where(same, amid, np.clip(np.searchsorted(keys, (keys[blo] & above) | bit), blo, bhi))
        nxt = []
        for a0, a1, b0, b1, add, skip in (
            (alo, amid, blo, bmid, 0, False),
            (amid, ahi, bmid, bhi, 0, False),
            (alo, amid, bmid, bhi, 1, False),
            (amid, ahi, blo, bmid, 1, True),  # for a node with itself the mirror image of the row above
        ):
            ok = (a1 > a0) & (b1 > b0) & (err + add <= budget)
            if skip:
                ok &= ~same
            ok &= ~((a0 == b0) & (a1 - a0 == 1))
            nxt.append((a0[ok], a1[ok], b0[ok], b1[ok], err[ok] + np.int8(add)))
        stack.append((depth + 1, *(np.concatenate(x) for x in zip(*nxt, strict=True))))


class Forest:
    """Least-root labels of rows linked by batches of pairs."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def span(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Adds the pairs and returns those of them that the spanning forest is made of."""
        made = [(i[:0], j[:0])]
        while True:
            a, b = self.root[i], self.root[j]
            apart = a != b
            if not apart.any():
                return tuple(np.concatenate(x) for x in zip(*made, strict=True))
            i, j = i[apart], j[apart]
            # Each higher root hooks on to a lower one by one pair, so no cycle comes up.
            high, pick = np.unique(np.maximum(a, b)[apart], return_index=True)
            self.root[high] = np.minimum(a, b)[apart][pick]
            made.append((i[pick], j[pick]))
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root[:] = up

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        root = self.root
        while True:
            a, b = root[i], root[j]
            if (a == b).all():
                return
            low, high = np.minimum(a, b), np.maximum(a, b)
            np.minimum.at(root, high, low)
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root[:] = up


def blocks(bits: int, budget: int) -> list[tuple[int, int]]:
    """(start, width) of the ``budget + 1`` blocks."""
    edges = [round(bits * i / (budget + 1)) for i in range(budget + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def links(distinct: DataFrame, budget: int = 2) -> DataFrame:
    """Edges (a, b) that span every group of distinct fingerprints ``fp`` linked within ``budget`` bits."""
    parts = blocks(BITS, budget)
    turned = distinct.select(
        F.explode(
            F.array(
                *(
                    F.struct(
                        F.lit(i).alias("turn"),
                        (
                            F.shiftleft("fp", s).bitwiseOR(F.shiftrightunsigned("fp", BITS - s)) if s else F.col("fp")
                        ).alias("key"),
                        F.lit(w).alias("top"),
                    )
                    for i, (s, w) in enumerate(parts)
                )
            )
        ).alias("x")
    ).select("x.*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            turn, key = batch.column("turn").to_numpy(), batch.column("key").to_numpy().view(np.uint64)
            for t in np.unique(turn):
                held.setdefault(int(t), []).append(key[turn == t])
        for t, chunks in held.items():
            keys = np.unique(np.concatenate(chunks))
            start, top = parts[t]
            forest = Forest(len(keys))
            for i, j in trie_pairs(keys, top, budget):
                forest.add(i, j)
            linked = np.flatnonzero(forest.root != np.arange(len(keys)))
            back = (keys >> np.uint64(start) | keys << np.uint64(BITS - start)) if start else keys
            yield pa.RecordBatch.from_arrays(
                [pa.array(back[linked].view(np.int64)), pa.array(back[forest.root[linked]].view(np.int64))],
                names=["a", "b"],
            )

    return turned.repartition(
        fine_grained(distinct), "turn", F.expr("shiftrightunsigned(key, 64 - top)")
    ).mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of every vertex of ``edges`` (a, b) but the roots; root is the least id that is reachable.

    A task first turns the edges that it holds into stars (member, root). Then, until nothing moves: a member of several roots
    keeps the least and ties the others to it, and a root that is itself a member hands its members on to its own root. Rounds
    grow with the logarithm of the longest path. Both joins look up rows of which few exist: members of several roots, and
    roots that are members. A star of any size is dealt out over many tasks; nothing is broadcast.
    """

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches if len(b)]
        if not held:
            return
        a, b = (np.concatenate(x) for x in zip(*held, strict=True))
        ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        forest = Forest(len(ids))
        forest.add(at[: len(a)], at[len(a) :])
        linked = np.flatnonzero(forest.root != np.arange(len(ids)))
        yield pa.RecordBatch.from_arrays([pa.array(ids[linked]), pa.array(ids[forest.root[linked]])], names=["a", "b"])

    e = staged(edges.where("a <> b").select("a", "b").mapInArrow(stars, "a long, b long").distinct(), "edges")
    while True:
        least = e.groupBy("a").agg(F.min("b").alias("m"), F.max("b").alias("most"))
        several = least.where("m <> most").select("a", "m")
        tied = spread_join(e, "a", "b", several)
        s = tied.select(
            F.when(F.col("b") > F.col("m"), F.col("b")).otherwise(F.col("a")).alias("a"),
            F.when(F.col("b") > F.col("m"), F.col("m")).otherwise(F.col("b")).alias("b"),
            (F.col("b") > F.coalesce("m", "b")).alias("moved"),
        )
        s = s.groupBy("a", "b").agg(F.max("moved").alias("moved"))
        parents = s.groupBy("a").agg(F.min("b").alias("up"))
        roots = s.select("b").distinct().hint("merge")
        up = parents.join(roots, F.col("a") == F.col("b")).select("b", "up")
        after = spread_join(s, "b", "a", up).select("a", F.coalesce("up", "b").alias("b"), (F.col("moved") | F.col("up").isNotNull()).alias("moved"))
        before, e = e, staged(after, "edges")
        release(before)
        if e.where("moved").isEmpty():
            return e.select(F.col("a").alias("id"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, words: int = 3, budget: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id reachable by links.

    Nulls: a null or wordless text has fingerprint zero and links like any other; a null doc_id is carried and is
    never the smallest unless the whole component has none. Repeated rows stay. Empty table: no rows. Texts are
    taken whole. Other columns are ignored.
    """
    fps = staged(fingerprints(docs, words), "fingerprints")
    distinct = staged(fps.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "distinct")
    total = distinct.agg(F.sum("n")).first()[0] or 0
    roots = components(links(distinct.select("fp"), budget))
    rooted = distinct.join(roots.withColumnRenamed("id", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp")
    )
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n_fps"))
    # A component of one fingerprint needs no join; the rows of a large one are dealt out.
    tied = spread_join(rooted, "root", "fp", least.where("n_fps > 1").select("root", "component_id"))
    classes = staged(tied.select("fp", "n", F.coalesce("component_id", "first").alias("component_id")), "components")
    hot = F.broadcast(classes.where(F.col("n") * HOT > total).select("fp", F.col("component_id").alias("hot_id"), F.lit(True).alias("is_hot")))
    marked = fps.join(hot, "fp", "left")
    rest = marked.where("is_hot IS NULL").select("doc_id", "fp").join(classes.select("fp", "component_id"), "fp")
    rows = marked.where("is_hot").select("doc_id", "fp", F.col("hot_id").alias("component_id")).unionByName(rest)
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Near-duplicates by shingle similarity.
#
# A similarity of 0.8 moves about a seventh of the bits, far more than a walk over 64 bits can allow. So a text gets a
# longer fingerprint, WORDS_64 words of 64 bits, and each three of its bytes are a trie of their own, walked with a budget of
# TABLE_BUDGET bits. Pairs that any walk meets are candidates if the whole fingerprints are near enough; a candidate is a link
# only if the shingle sets themselves are similar.
WORDS_64, TABLE_BYTES, TABLE_BUDGET = 5, 3, 2
_TABLES = 8 * WORDS_64 // TABLE_BYTES
_RECORD = np.dtype([("slot", "u1"), ("key", "<u4"), ("id", "<i8"), ("sig", "u1", 8 * WORDS_64)])
#: Weight of the texts of a block; a text weighs one, and one more for every SHINGLES_WEIGHT shingles. Columns counted at once.
BLOCK_WEIGHT, SHINGLES_WEIGHT, COLUMNS = 512, 1024, 4096


def bit_limit(similarity: float, bits: int = 64 * WORDS_64, slack: float = 1.5) -> int:
    """Differing bits of texts of this Jaccard similarity: the mean of their distribution and ``slack`` deviations."""
    p = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    return round(bits * p + slack * (bits * p * (1 - p)) ** 0.5)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes: a repeated line counts once, unlike in op4's fingerprint."""
    return np.unique(hashes(text, words))


def long_fingerprint(h: np.ndarray) -> bytes:
    """Of a shingle set."""
    out = []
    for i in range(WORDS_64):
        with np.errstate(over="ignore"):
            x = (h ^ np.uint64(0x9E3779B97F4A7C15 * (i + 1) & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xD6E8FEB86659FD93)
            x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        out.append(int(majority(x ^ (x >> np.uint64(32)))).to_bytes(8, "little"))
    return b"".join(out)


Pairs = Iterator[tuple[np.ndarray, np.ndarray]]


def _linked(sig: np.ndarray, members: np.ndarray, limit: int, forest: Forest) -> Pairs:
    """Pairs that join all members that near steps connect: each is compared with those that nothing has reached yet, so a
    tight group costs about one comparison a member."""
    left = members
    while len(left) > 1:
        reached, left = [left[0]], left[1:]
        while reached and len(left):
            x = reached.pop()
            near = np.bitwise_count(sig[left] ^ sig[x]).sum(axis=1, dtype=np.int64) <= limit
            if near.any():
                yield forest.span(np.full(int(near.sum()), x), left[near])
                reached += left[near].tolist()
                left = left[~near]


def table_links(rec: np.ndarray, limit: int, forest: Forest, where: np.ndarray, sigs: np.ndarray) -> Pairs:
    """Near pairs that the walk over the trie of one table meets: those of a spanning forest. ``where`` gives each record's row in
    ``sigs``, on which the forest stands."""

    def group(members: np.ndarray) -> Pairs:
        if len(np.unique(forest.root[members])) > 1:
            yield from _linked(sigs, members, limit, forest)

    order = np.argsort(rec["key"], kind="stable")
    keys, first, count = np.unique(rec["key"][order], return_index=True, return_counts=True)
    rows = where[order]
    for k in np.flatnonzero(count > 1):
        yield from group(np.unique(rows[first[k] : first[k] + count[k]]))
    wide = keys.astype(np.uint64) << np.uint64(64 - 8 * TABLE_BYTES)
    for i, j in trie_pairs(wide, 8, TABLE_BUDGET, 8 * TABLE_BYTES):
        small = (count[i] == 1) & (count[j] == 1)
        a, b = rows[first[i[small]]], rows[first[j[small]]]
        for at in range(0, len(a), 1 << 18):
            x, y = a[at : at + (1 << 18)], b[at : at + (1 << 18)]
            near = np.bitwise_count(sigs[x] ^ sigs[y]).sum(axis=1, dtype=np.int64) <= limit
            yield forest.span(x[near], y[near])
        for p, q in zip(i[~small].tolist(), j[~small].tolist(), strict=True):
            yield from group(np.unique(np.concatenate([rows[first[p] : first[p] + count[p]], rows[first[q] : first[q] + count[q]]])))


def candidates(classes: DataFrame, limit: int) -> DataFrame:
    """Distinct pairs (a < b) of ids of ``classes`` (id, sig) whose fingerprints differ in ``limit`` bits at most: of the pairs that a
    task meets, a spanning forest. So whatever two ids meet anywhere, these pairs connect them."""
    n = max(64, 2 * fine_grained(classes))
    width = TABLE_BYTES

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 20_000):
                part = batch.slice(at, 20_000)
                ids = part.column("id").to_numpy()
                sig = np.frombuffer(b"".join(part.column("sig").to_pylist()), np.uint8).reshape(len(ids), 8 * WORDS_64)
                made, lots = [], []
                for table in range(_TABLES):
                    own = sig[:, table * width : (table + 1) * width].astype(np.uint32)
                    for turn in range(width):
                        rec = np.zeros(len(ids), _RECORD)
                        rec["slot"], rec["id"], rec["sig"] = table * width + turn, ids, sig
                        for k in range(width):
                            rec["key"] = rec["key"] << np.uint32(8) | own[:, (turn + k) % width]
                        made.append(rec)
                        top = own[:, turn].astype(np.int64) + 256 * (table * width + turn)
                        lots.append(top * 2654435761 % 4294967296 % n)
                rec, lot = np.concatenate(made), np.concatenate(lots)
                order = np.argsort(lot, kind="stable")
                bounds = np.searchsorted(lot[order], np.arange(n + 1))
                full = [b for b in range(n) if bounds[b + 1] > bounds[b]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(full, pa.int32()), pa.array([rec[order[bounds[b] : bounds[b + 1]]].tobytes() for b in full], pa.binary())],
                    names=["lot", "records"],
                )

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = b"".join(r for batch in batches for r in batch.column("records").to_pylist())
        if not raw:
            return
        rec = np.frombuffer(raw, _RECORD)
        ids, first, where = np.unique(rec["id"], return_index=True, return_inverse=True)
        sigs = rec["sig"][first].view("<u8")
        forest = Forest(len(ids))

        def out(found: list) -> pa.RecordBatch:
            i, j = (ids[np.concatenate(x)] for x in zip(*found, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(i, j)), pa.array(np.maximum(i, j))], names=["a", "b"])

        order = np.argsort(rec["slot"], kind="stable")
        bounds = np.searchsorted(rec["slot"][order], np.arange(257))
        found, held = [], 0
        for s in range(256):
            own = order[bounds[s] : bounds[s + 1]]
            if len(own) > 1:
                for i, j in table_links(rec[own], limit, forest, where[own], sigs):
                    if len(i):
                        found.append((i, j))
                        held += len(i)
                    if held > FRONTIER:
                        yield out(found)
                        found, held = [], 0
        if found:
            yield out(found)

    return (
        classes.select("id", "sig").mapInArrow(deal, "lot int, records binary").repartition(n, "lot").mapInArrow(walk, "a long, b long").distinct()
    )


def shingle_sets(texts: DataFrame, words: int) -> DataFrame:
    """(id, set, weight) of (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                sets = [shingle_set(t.as_py(), words).view(np.int64) for t in part.column("text")]
                ends = np.cumsum([0, *map(len, sets)])
                lists = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(np.concatenate(sets))).cast(pa.list_(pa.int64()))
                weight = pa.array(1 + np.diff(ends) // SHINGLES_WEIGHT, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("id"), lists, weight], names=["id", "set", "weight"])

    return texts.mapInArrow(run, "id long, set array<long>, weight long")


def judged(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b, similar) of ``pairs``: whether their shingle sets reach the similarity."""
    # Merge joins, which AQE splits where one text has many pairs.
    side = lambda key, name: sets.select(F.col("id").alias(key), F.col("set").alias(name)).hint("merge")
    both = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b")
    met = both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("shared"), (F.size("x") + F.size("y")).alias("both"))
    return met.select("a", "b", (F.col("shared") >= similarity * (F.col("both") - F.col("shared"))).alias("similar"))


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Shared values of every set of ``left`` with every set of ``right``, counted exactly by products of 0/1 matrices."""
    rows = [np.repeat(np.arange(len(side)), [len(x) for x in side]) for side in (left, right)]
    flat = [np.concatenate(side) for side in (left, right)]
    known = np.intersect1d(np.unique(flat[0]), np.unique(flat[1]), assume_unique=True)  # others are in no intersection
    out = np.zeros((len(left), len(right)), np.float32)
    columns = [np.searchsorted(known, x) for x in flat]
    for x, column, k in zip(flat, columns, (0, 1), strict=True):
        column[column == len(known)] = 0
        there = known[column] == x if len(known) else np.zeros(len(x), bool)
        rows[k], columns[k] = rows[k][there], column[there]
    orders = [np.argsort(c, kind="stable") for c in columns]
    rows, columns = [r[o] for r, o in zip(rows, orders, strict=True)], [c[o] for c, o in zip(columns, orders, strict=True)]
    for at in range(0, len(known), COLUMNS):
        parts = []
        for side, r, c in zip((left, right), rows, columns, strict=True):
            a, b = np.searchsorted(c, (at, at + COLUMNS))
            m = np.zeros((len(side), min(COLUMNS, len(known) - at)), np.float32)
            m[r[a:b], c[a:b] - at] = 1
            parts.append(m)
        out += parts[0] @ parts[1].T
    return out


def block_links(rows: pd.DataFrame, similarity: float) -> pd.DataFrame:
    """Links between labels of one task (group, label, set, first, second): members of the first block against those of the second, for
    each group apart. Of the links a spanning forest of the labels is returned."""
    found: list[tuple[int, int]] = []
    for _, own in rows.groupby("group", sort=False):
        label, sets = own["label"].to_numpy(), [np.asarray(x, np.int64) for x in own["set"]]
        names, at = np.unique(label, return_inverse=True)
        i, j = np.flatnonzero(own["first"].to_numpy()), np.flatnonzero(own["second"].to_numpy())
        if len(names) < 2 or not len(i) or not len(j):
            continue
        shared = common_counts([sets[k] for k in i], [sets[k] for k in j])
        sizes = np.array([len(x) for x in sets])
        near = shared >= similarity * (sizes[i][:, None] + sizes[j][None, :] - shared)
        a, b = np.nonzero(near & (at[i][:, None] != at[j][None, :]))
        x, y = Forest(len(names)).span(at[i[a]], at[j[b]])
        found += zip(names[x].tolist(), names[y].tolist(), strict=True)
    return pd.DataFrame(found, columns=["a", "b"], dtype="int64")


def links_between(members: DataFrame, similarity: float) -> DataFrame:
    """(a, b) labels that some pair of texts of one group links, of ``members`` (group, label, set, weight).

    A group is compared in blocks of bounded weight, so that a task holds two blocks, however large a group is. Small groups share a
    task. In a large one a label of a block's weight has blocks of its own, which needn't meet each other; the other labels are
    dealt out. Blocks meet in pairs, so a text goes to as many tasks as its group has blocks that it must meet.
    """
    slim = members.select("group", "label", "id", "weight")
    per_label = staged(slim.groupBy("group", "label").agg(F.sum("weight").alias("w")), "labels")
    big = F.col("w") >= BLOCK_WEIGHT
    per_group = per_label.groupBy("group").agg(F.sum("w").alias("all_w"), F.sum(F.when(~big, F.col("w")).otherwise(0)).alias("mixed_w"))
    small_w = per_group.where(F.col("all_w") <= BLOCK_WEIGHT).agg(F.sum("all_w")).first()[0] or 0
    parts = lambda w: F.ceil(w / F.lit(float(BLOCK_WEIGHT)))
    of_label = staged(per_label.join(per_group, "group"), "of-label")
    spread = lambda what, n: F.pmod(F.xxhash64(what), F.greatest(n, F.lit(1))).cast("long")
    shown = lambda *cs: F.concat_ws(":", *(c.cast("string") for c in cs))
    with_size = spread_join(members.drop("weight"), "label", "id", of_label.select("label", "w", "all_w", "mixed_w"))
    small = F.col("all_w") <= BLOCK_WEIGHT
    block = (
        F.when(small, shown(F.lit("s"), spread("group", F.lit(max(1, -(-small_w // BLOCK_WEIGHT))))))
        .when(big, shown(F.col("group"), F.col("label"), spread("id", parts(F.col("w")))))
        .otherwise(shown(F.col("group"), F.lit("m"), spread("label", parts(F.col("mixed_w")))))
    )
    placed = staged(with_size.select("group", "label", "set", small.alias("small"), F.when(big & ~small, F.col("label")).alias("only"), block.alias("block")), "placed")
    blocks = placed.where("NOT small").select("group", "block", "only").distinct()
    pairs = (
        blocks.select("group", F.col("block").alias("x"), F.col("only").alias("x_only"))
        .join(blocks.select("group", F.col("block").alias("y"), F.col("only").alias("y_only")), "group")
        .where("x <= y AND NOT (x_only IS NOT NULL AND x_only <=> y_only)")
        .select("x", "y", F.concat_ws("|", "x", "y").alias("task"))
    )
    # What a block takes part in: as the first, the second or, with itself, both.
    as_first = pairs.select(F.col("x").alias("block"), "task", F.lit(True).alias("first"), (F.col("x") == F.col("y")).alias("second"))
    as_second = pairs.where("x <> y").select(F.col("y").alias("block"), "task", F.lit(False).alias("first"), F.lit(True).alias("second"))
    large = placed.where("NOT small").join(as_first.unionByName(as_second).hint("merge"), "block").select("task", "group", "label", "set", "first", "second")
    alone = placed.where("small").select(F.col("block").alias("task"), "group", "label", "set", F.lit(True).alias("first"), F.lit(True).alias("second"))
    return alone.unionByName(large).groupBy("task").applyInPandas(lambda rows: block_links(rows, similarity), "a long, b long").distinct()


def similar_groups(classes: DataFrame, texts: Callable[[DataFrame], DataFrame], words: int, similarity: float) -> DataFrame:
    """(id, root) of the ids of ``classes`` (id, sig) that candidates of this similarity join, without the roots themselves.

    A spanning forest of the candidates comes first, so that a tight group costs a pair a member. Where some of its pairs are
    not similar, the parts that the others leave may still be linked by pairs that the forest left out: the parts that failed
    pairs connect are a group, and all texts of its different parts are compared, in blocks.
    """
    pairs = staged(candidates(classes, bit_limit(similarity, slack=SLACK)), "spanning")
    sets = staged(shingle_sets(texts(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()), words), "sets")
    first = staged(judged(pairs, sets, similarity), "judged")
    roots = components(first.where("similar"))
    # Failed pairs tell which parts still have to meet.
    a_root = spread_join(first.where("NOT similar").select("a", "b"), "a", "b", roots.select(F.col("id").alias("a"), F.col("root").alias("a_root")))
    b_root = spread_join(a_root, "b", "a", roots.select(F.col("id").alias("b"), F.col("root").alias("b_root")))
    apart = b_root.select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b")).where("a <> b")
    open_parts = staged(apart.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "apart")
    if open_parts.isEmpty():
        return roots
    below = components(open_parts)
    groups = below.select(F.col("id").alias("label"), F.col("root").alias("group")).unionByName(below.select(F.col("root").alias("label"), F.col("root").alias("group")).distinct())
    with_label = sets.join(roots.hint("merge"), "id", "left").select("id", F.coalesce("root", "id").alias("label"), "set", "weight")
    members = staged(spread_join(with_label, "label", "id", groups).where("group IS NOT NULL"), "members")
    joined = components(links_between(members, similarity))
    out = spread_join(roots, "root", "id", joined.select(F.col("id").alias("root"), F.col("root").alias("up"))).select("id", F.coalesce("up", "root").alias("root"))
    done = staged(out.unionByName(joined), "roots")
    release(pairs, sets, first, open_parts, members)
    return done


def keep_one(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` without near copies: of each group of similar texts the row of the smallest doc_id stays.

    Texts are similar from ``similarity`` of their sets of ``words``-word shingles upward. Fingerprints find the candidates,
    so that a few links at the threshold are missed; the sets decide, so that no pair below it is a link. Links chain into
    groups. Nulls: wordless texts are one group; a null doc_id is the last choice.
    Repeated rows are copies. Empty table: no rows. All columns are returned, whatever their names.
    """
    names = iter(f"{n}_{i}" for i in range(1 << 30) for n in ("near_copy_row", "near_copy_check") if f"{n}_{i}" not in docs.columns)
    row, check = next(names), next(names)
    # A row is known by 128 bits of its id and text.
    marked = docs.withColumns({row: F.xxhash64("doc_id", "text"), check: F.xxhash64(F.lit(1), "text", "doc_id")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), words) for t in batch.column("text")]
            equal = [xxhash.xxh3_64_intdigest(h.tobytes()) for h in sets]
            sig = [long_fingerprint(h) for h in sets]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(np.array(equal, np.uint64).view(np.int64)), pa.array(sig, pa.binary())],
                names=["doc_id", "row", "check", "id", "sig"],
            )

    prints = marked.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(row).alias("row"), F.col(check).alias("check"), "text").mapInArrow(
        run, "doc_id long, row long, check long, id long, sig binary"
    )
    choice = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row", "check")
    classes = staged(prints.groupBy("id").agg(F.min(choice).alias("first"), F.first("sig").alias("sig")), "classes")  # a class is a set
    firsts = classes.select("id", F.col("first.row").alias(row), F.col("first.check").alias(check))

    def texts(ids: DataFrame) -> DataFrame:
        wanted = staged(firsts.join(ids, "id", "left_semi"), "wanted")
        few = wanted.count() <= BROADCAST_ROWS  # beyond, the texts are shuffled
        return marked.select(row, check, "text").join(F.broadcast(wanted) if few else wanted, [row, check]).dropDuplicates(["id"]).select("id", "text")

    roots = similar_groups(classes.select("id", "sig"), texts, words, similarity)
    # Rows of a large group are dealt out; a class that no link joins keeps its first row.
    group = classes.drop("sig").join(roots.hint("merge"), "id", "left").groupBy(F.coalesce("root", "id").alias("root")).agg(F.min("first").alias("first"))
    kept = group.select(F.col("first.row").alias(row), F.col("first.check").alias(check))
    return marked.join(kept.hint("merge"), [row, check], "left_semi").dropDuplicates([row, check]).select(*docs.columns)
