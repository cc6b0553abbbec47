"""Approximate nearest neighbours by a hierarchical k-means tree.

The tree is fitted on a bounded sample and every vector goes down it to a leaf. A query keeps the tree's nodes in a
priority queue and takes the best bin first, leaf after leaf. How many leaves it opens is widened until the recall
of calibration queries, whose true neighbours are found by a full scan, reaches the target.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fine_grained, release, staged

#: Vectors that the fit sees at most, those of the least hash; children of a node; vectors of a leaf, about, in the whole table
#: and at least in the fit.
FIT_ROWS, BRANCH, LEAF_ROWS, LEAF_FIT = 20_000, 6, 512, 12
#: Queries that calibrate, those of the least hash, and the recall that they must reach.
CALIBRATION_QUERIES, TARGET_RECALL = 128, 0.96
#: Cells that the vectors are dealt out to, about. A cell lies within a branch of the tree and hands on at most k rows a query.
CELLS = 64
#: Queries of a block, about: a task holds one block's queries and lets the vectors of one cell pass by, so its memory is bounded.
BLOCK_QUERIES = 20_000
#: Products held at once, and queries that a task opens leaves for at once.
PRODUCTS, OPENED = 1 << 22, 256


@dataclass
class Tree:
    """Nodes in breadth-first order: centers, children (empty for a leaf) and the number of each leaf."""

    centers: np.ndarray
    children: list[list[int]]
    leaf: list[int]
    branch: np.ndarray  # of each leaf: the child of the root above it

    @property
    def n_leaves(self) -> int:
        return len(self.branch)

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row: the nearest center by Euclidean distance at each level."""
        at = np.zeros(len(x), np.int64)
        out = np.full(len(x), -1, np.int64)
        live = np.arange(len(x))
        while len(live):
            for node in np.unique(at[live]):
                rows = live[at[live] == node]
                if self.leaf[node] >= 0:
                    out[rows] = self.leaf[node]
                    continue
                kids = np.array(self.children[node])
                c = self.centers[kids]
                at[rows] = kids[np.argmin((c * c).sum(1)[None, :] - 2 * x[rows] @ c.T, axis=1)]
            live = live[out[live] < 0]
        return out

    def best_bins(self, q: np.ndarray, visits: int) -> list[int]:
        """Leaves in the order in which a priority queue on inner products with centers opens them."""
        near = self.centers @ q
        queue, out = [(-near[0], 0)], []
        while queue and len(out) < visits:
            _, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                out.append(self.leaf[node])
            for kid in self.children[node]:
                heapq.heappush(queue, (-near[kid], kid))
        return out


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 10) -> tuple[np.ndarray, np.ndarray]:
    distinct = np.unique(x, axis=0)
    k = min(k, len(distinct))
    centers = distinct[rng.choice(len(distinct), k, replace=False)]
    near = np.zeros(len(x), np.int64)
    for _ in range(rounds):
        near = np.argmin((centers * centers).sum(1)[None, :] - 2 * x @ centers.T, axis=1)
        for j in range(k):
            if (near == j).any():
                centers[j] = x[near == j].mean(axis=0)
    return centers, near


def depth_for(rows: int, fitted: int, branch: int = BRANCH) -> int:
    """Depth at which leaves hold about LEAF_ROWS of all rows, as far as LEAF_FIT fitted rows a leaf go."""
    wanted, able = max(1, rows // LEAF_ROWS), max(1, fitted // LEAF_FIT)
    depth = 1
    while branch**depth < wanted and branch ** (depth + 1) <= able:
        depth += 1
    return depth


def grow(x: np.ndarray, depth: int, branch: int = BRANCH, seed: int = 0) -> Tree:
    rng = np.random.default_rng(seed)
    centers, children, leaf, branches = [x.mean(axis=0)], [[]], [-1], []
    todo = [(0, x, 0, 0)]
    while todo:
        node, rows, level, top = todo.pop(0)
        if level == depth or len(np.unique(rows, axis=0)) <= branch:
            leaf[node] = len(branches)
            branches.append(top)
            continue
        found, near = _kmeans(rows, branch, rng)
        for j, c in enumerate(found):
            kid = len(centers)
            centers.append(c)
            children.append([])
            leaf.append(-1)
            children[node].append(kid)
            todo.append((kid, rows[near == j] if (near == j).any() else c[None, :], level + 1, j if level == 0 else top))
    return Tree(np.stack(centers), children, leaf, np.array(branches))


def _matrix(column) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column])


def _top(
    ids: np.ndarray, x: np.ndarray, queries: np.ndarray, owns: np.ndarray, k: int, opened: np.ndarray | None = None, leaf: np.ndarray | None = None, least: np.ndarray | None = None
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, scores) for each query: the ``k`` largest inner products, ties to the smaller id, without rows of the query's own id.
    ``opened`` (leaves x queries) tells which rows count, by their ``leaf``; what lies below ``least`` of a query may be left out."""
    step = max(1, PRODUCTS // max(1, len(x)))
    for at in range(0, len(queries), step):
        block = x @ queries[at : at + step].T
        if opened is not None:
            block[~opened[leaf, at : at + step]] = -np.inf
        for j in range(block.shape[1]):
            scores = block[:, j]
            scores[ids == owns[at + j]] = -np.inf
            floor = -np.inf if least is None else least[at + j]
            rows = np.flatnonzero(scores >= floor - 1e-9 * max(1.0, abs(floor)) if np.isfinite(floor) else scores > -np.inf)
            if len(rows) > k:
                # Blocked products may differ in the last bits: all that could be among the k are scored again row by row.
                edge = np.partition(scores, len(scores) - k)[len(scores) - k]
                rows = np.flatnonzero(scores >= edge - 1e-9 * max(1.0, abs(edge)))
            exact = (x[rows] * queries[at + j]).sum(axis=1)
            order = np.lexsort((ids[rows], -exact))[:k]
            yield rows[order], exact[order]


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and v (doubles): rows whose vector is there, finite throughout and not zero; equal rows are one candidate.

    Where lengths differ, the length of the most rows counts, the greater of equals, and rows of another take no part.
    """
    v = F.col("embedding").cast("array<double>")
    rows = (
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
        .where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
        .where(~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
        .where(F.exists("v", lambda c: c != 0))
    )
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(2).collect()
    if len(lengths) > 1:
        rows = rows.where(F.size("v") == lengths[0]["d"])
    return rows.distinct()


def search(vectors: DataFrame, k: int = 20, every: int = 20, target: float = TARGET_RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id ``every`` divides, its ``k`` nearest others found.

    Null, zero or non-finite vectors and null ids take no part, nor do vectors of another length than most rows have. Equal
    vectors tie to the smaller vec_id. Repeated rows are one candidate; a vec_id with different vectors is a candidate
    with each of them, is asked once, with the least of them as bytes, and is never its own neighbour. Fewer than ``k`` candidates:
    all of them. Empty table: no rows. Other columns are ignored.

    The full scan of calibration compares a fixed number of queries with all rows, block by block; the search itself
    sends a query to the cells of the branches that it opens. Queries come in blocks. A task holds one block and lets one cell's
    vectors pass by, sorted behind the queries, so its memory doesn't grow with the table.
    """
    spark = vectors.sparkSession
    rows = staged(usable(vectors), "usable")
    schema = "query_id long, rank int, vec_id long, score double"
    total = rows.count()
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(FIT_ROWS).toPandas()
    if sample.empty:
        return spark.createDataFrame([], schema)
    tree = grow(_matrix(sample["v"]), depth_for(total, len(sample)))
    is_query = F.col("vec_id") % every == 0
    shared = spark.sparkContext.broadcast(tree)

    def to_leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = _matrix(pdf["v"])
                yield pd.DataFrame(
                    {"vec_id": pdf["vec_id"], "raw": [r.astype("<f8").tobytes() for r in x], "leaf": shared.value.assign(x).astype(np.int32)}
                )

    indexed = staged(rows.mapInPandas(to_leaves, "vec_id long, raw binary, leaf int"), "leaves")
    release(rows)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")  # Spark cuts each task's rows to k before the exchange
    asking = staged(indexed.where(is_query).groupBy("vec_id").agg(F.min("raw").alias("raw")), "queries")
    n_asking = asking.count()

    # Calibration: true neighbours of a fixed number of queries, and how many leaves a queue opens to reach them.
    calib = asking.orderBy(F.xxhash64("vec_id"), "vec_id").limit(CALIBRATION_QUERIES).toPandas()
    visits = tree.n_leaves
    if len(calib):
        asked = spark.sparkContext.broadcast((calib["vec_id"].to_numpy(), _floats(calib["raw"])))

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    ids, x, leaf = pdf["vec_id"].to_numpy(), _floats(pdf["raw"]), pdf["leaf"].to_numpy()
                    owns, q = asked.value
                    for own, (got, score) in zip(owns, _top(ids, x, q, owns, k), strict=True):
                        yield pd.DataFrame({"query_id": own, "vec_id": ids[got], "score": score, "leaf": leaf[got]})

        truth = (
            indexed.mapInPandas(scan, "query_id long, vec_id long, score double, leaf int")
            .withColumn("rank", F.row_number().over(best))
            .where(F.col("rank") <= k)
            .groupBy("query_id")
            .agg(F.collect_list("leaf").alias("leaves"))
            .toPandas()
        )
        vector = dict(zip(calib["vec_id"].tolist(), _floats(calib["raw"]), strict=True))
        opened = []
        for own, leaves in zip(truth["query_id"].tolist(), truth["leaves"], strict=True):
            place = {leaf: i + 1 for i, leaf in enumerate(tree.best_bins(vector[own], tree.n_leaves))}
            opened += [place[leaf] for leaf in leaves]
        opened = np.array(opened or [tree.n_leaves])
        visits = 1
        while visits < tree.n_leaves and (opened <= visits).mean() < target:
            visits += 1

    # Cells: a branch of the tree, dealt out in proportion to its size. The table has a row for each branch.
    n_branches = int(tree.branch.max()) + 1
    branch_of = spark.sparkContext.broadcast(tree.branch)
    lookup = F.create_map(*(x for i, b in enumerate(tree.branch.tolist()) for x in (F.lit(i), F.lit(b))))
    placed = indexed.withColumn("branch", lookup[F.col("leaf")])
    sizes = dict(placed.groupBy("branch").count().collect())  # at most BRANCH rows
    deals = [max(1, round(CELLS * sizes.get(b, 0) / max(1, total))) for b in range(n_branches)]
    deal_of = F.create_map(*(x for b, d in enumerate(deals) for x in (F.lit(b), F.lit(d))))
    base = F.create_map(*(x for b in range(n_branches) for x in (F.lit(b), F.lit(sum(deals[:b])))))
    starts = np.concatenate(([0], np.cumsum(deals)))
    n_blocks = max(1, -(-n_asking // BLOCK_QUERIES))
    none = F.lit(None).cast("binary")
    cells = placed.select(
        F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"),
        (base[F.col("branch")] + F.pmod(F.xxhash64("vec_id", "raw"), deal_of[F.col("branch")])).cast("int").alias("cell"),
        F.lit(True).alias("candidate"), "vec_id", "raw", none.alias("leaves"), "leaf",
    )

    def open_leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), OPENED):
                part, out = pdf.iloc[at : at + OPENED], []
                for own, raw in zip(part["vec_id"], part["raw"], strict=True):
                    leaves = np.array(shared.value.best_bins(np.frombuffer(raw, "<f8"), visits), np.int32)
                    top = branch_of.value[leaves]
                    for b in np.unique(top):
                        mine = leaves[top == b].astype("<i4").tobytes()
                        out += [(c, own, raw, mine) for c in range(starts[b], starts[b + 1])]
                yield pd.DataFrame(out, columns=["cell", "vec_id", "raw", "leaves"])

    queries = asking.mapInPandas(open_leaves, "cell int, vec_id long, raw binary, leaves binary").select(
        F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).cast("int").alias("block"), "cell", F.lit(False).alias("candidate"), "vec_id", "raw", "leaves", F.lit(None).cast("int").alias("leaf")
    )
    n_leaves = tree.n_leaves

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = None
        for pdf in batches:
            for key, part in pdf.groupby(["block", "cell"]):  # in order
                if task is None or task.key != key:
                    if task is not None:
                        yield from task.found()
                    task = _Task(key, k, n_leaves)
                there = part["candidate"].to_numpy()
                task.ask(part[~there])
                task.scan(part[there])
        if task is not None:
            yield from task.found()

    met = queries.unionByName(cells).repartition(fine_grained(vectors), "block", "cell").sortWithinPartitions("block", "cell", "candidate")
    found = met.mapInPandas(meet, "query_id long, vec_id long, score double")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


class _Task:
    """The queries of one block in one cell, and the best of the vectors that have passed by so far."""

    def __init__(self, key: tuple[int, int], k: int, n_leaves: int):
        self.key, self.k, self.n_leaves = key, k, n_leaves
        self.asked: list[pd.DataFrame] = []
        self.owns: np.ndarray | None = None

    def ask(self, part: pd.DataFrame) -> None:
        if len(part):
            self.asked.append(part[["vec_id", "raw", "leaves"]])

    def _ready(self) -> bool:
        if self.owns is None and self.asked:
            rows = pd.concat(self.asked)
            self.owns, self.queries = rows["vec_id"].to_numpy(), _floats(rows["raw"])
            self.opened = np.zeros((self.n_leaves, len(rows)), bool)
            for j, mine in enumerate(rows["leaves"]):
                self.opened[np.frombuffer(mine, "<i4"), j] = True
            self.least = np.full(len(rows), -np.inf)
            self.best = [(np.zeros(0, np.int64), np.zeros(0))] * len(rows)
            self.asked = []
        return self.owns is not None

    def scan(self, part: pd.DataFrame) -> None:
        if not len(part) or not self._ready():
            return
        ids, x, leaf = part["vec_id"].to_numpy(), _floats(part["raw"]), part["leaf"].to_numpy().astype(np.int64)
        for j, (got, score) in enumerate(_top(ids, x, self.queries, self.owns, self.k, self.opened, leaf, self.least)):
            if len(got):
                names, scores = np.concatenate([self.best[j][0], ids[got]]), np.concatenate([self.best[j][1], score])
                order = np.lexsort((names, -scores))[: self.k]
                self.best[j] = names[order], scores[order]
                if len(order) == self.k:
                    self.least[j] = scores[order[-1]]

    def found(self) -> Iterator[pd.DataFrame]:
        if self.owns is not None:
            counts = [len(names) for names, _ in self.best]
            yield pd.DataFrame(
                {"query_id": np.repeat(self.owns, counts), "vec_id": np.concatenate([n for n, _ in self.best]), "score": np.concatenate([c for _, c in self.best])}
            )


def _floats(raw) -> np.ndarray:
    return np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), -1)
