"""Approximate nearest neighbours by a hierarchical k-means tree with best-bin-first traversal."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import matrix, stored, usable_vectors


@dataclass(frozen=True)
class Tree:
    """``centres[i]`` of node i; ``children[i]`` is empty for a leaf; node 0 is the root."""

    centres: np.ndarray
    children: tuple[tuple[int, ...], ...]

    def leaves_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row: down the tree to the nearest child."""
        node = np.zeros(len(x), np.int64)
        pending = [0] if len(x) else []
        while pending:
            at = pending.pop()
            below = self.children[at]
            rows = np.flatnonzero(node == at)
            if below and len(rows):
                node[rows] = np.asarray(below)[_nearest(x[rows], self.centres[list(below)])]
                pending += below
        return node

    def order(self, query: np.ndarray, most: int) -> list[int]:
        """The first ``most`` leaves of a best-bin-first traversal.

        The queue holds nodes seen so far; the one whose centre has the largest inner product
        with the query is opened next.
        """
        worth = self.centres @ query
        queue, out = [(-worth[0], 0)], []
        while queue and len(out) < most:
            _, node = heapq.heappop(queue)
            if self.children[node]:
                for child in self.children[node]:
                    heapq.heappush(queue, (-worth[child], child))
            else:
                out.append(node)
        return out

    @property
    def n_leaves(self) -> int:
        return sum(not c for c in self.children)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (0.5 * (centres * centres).sum(axis=1) - x @ centres.T).argmin(axis=1)


def _k_means(x: np.ndarray, k: int, rounds: int, random: np.random.Generator) -> np.ndarray:
    """Centres of at most ``k`` clusters; starts from distinct rows, empty clusters vanish."""
    distinct = np.unique(x, axis=0)
    centres = distinct[random.choice(len(distinct), min(k, len(distinct)), replace=False)]
    for _ in range(rounds):
        own = _nearest(x, centres)
        found, place = np.unique(own, return_inverse=True)
        sums = np.zeros((len(found), x.shape[1]))
        np.add.at(sums, place, x)
        new = sums / np.bincount(place)[:, None]
        if new.shape == centres.shape and np.allclose(new, centres):
            break
        centres = new
    return centres


def fit_tree(sample: np.ndarray, branches: int = 16, depth: int = 2, rounds: int = 12, seed: int = 1) -> Tree:
    """A tree of k-means splits; a node with few or equal rows stays a leaf."""
    random = np.random.default_rng(seed)
    centres, children = [sample.mean(axis=0) if len(sample) else np.zeros(sample.shape[1])], [()]
    pending = [(0, sample, 0)]
    while pending:
        node, rows, level = pending.pop()
        if level == depth or len(rows) <= branches:
            continue
        split = _k_means(rows, branches, rounds, random)
        if len(split) < 2:
            continue
        own = _nearest(rows, split)
        children[node] = tuple(range(len(centres), len(centres) + len(split)))
        for i, centre in enumerate(split):
            centres.append(centre)
            children.append(())
            pending.append((children[node][i], rows[own == i], level + 1))
    return Tree(np.array(centres), tuple(children))


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of equal rows in double precision, added up in the order of components.

    Unlike a matrix product, equal vectors have equal scores wherever they stand.
    """
    out = np.zeros(len(a))
    for i in range(a.shape[1]):
        out += a[:, i] * b[:, i]
    return out


def best_of(query_ids, queries, ids, vectors, k: int):
    """For each query its ``k`` best rows: arrays ``query, id, score``; ties go to the smaller id.

    Of equal vectors only the ``k + 1`` smallest ids can be among the best, so the others
    are left out first. A matrix product picks the rows that may be best, with room for its
    rounding; these are scored exactly.
    """
    if not (len(ids) and len(query_ids)):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    order = np.lexsort((*vectors.T, ids))
    ids, vectors = ids[order], vectors[order]
    new = np.append(True, ids[1:] != ids[:-1])  # rows that repeat an id count once
    ids, vectors = ids[new], vectors[new]
    _, group = np.unique(vectors, axis=0, return_inverse=True)
    by_group = np.lexsort((ids, group.reshape(-1)))
    g = group.reshape(-1)[by_group]
    starts = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
    rank = np.arange(len(g)) - np.repeat(starts, np.diff(np.append(starts, len(g))))
    kept = np.sort(by_group[rank <= k])
    ids, vectors = ids[kept], vectors[kept]
    rough = queries @ vectors.T
    rough[query_ids[:, None] == ids[None, :]] = -np.inf
    slack = 1e-12 * queries.shape[1] * np.abs(queries).max(initial=0) * np.abs(vectors).max(initial=0)
    out = []
    for i, query in enumerate(query_ids):
        row = rough[i]
        bound = np.partition(row, len(row) - k)[len(row) - k] if len(row) > k else -np.inf
        at = np.flatnonzero((row >= bound - 2 * slack) & (row > -np.inf))
        score = exact_scores(np.broadcast_to(queries[i], (len(at), queries.shape[1])), vectors[at])
        best = np.lexsort((ids[at], -score))[:k]
        out.append((np.full(len(best), query), ids[at][best], score[best]))
    return tuple(np.concatenate(x) for x in zip(*out))


def nearest_neighbours(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    recall: float = 0.97,
    sample_rows: int = 20_000,
    branches: int = 16,
    depth: int = 2,
    calibration_queries: int = 200,
    chunk_rows: int = 32_768,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    seed: int = 7,
) -> DataFrame:
    """About the ``k`` rows of largest inner product for each query, the query's own row left out.

    The tree is fitted on at most ``sample_rows`` rows (by a hash of the id), so that it has a
    bounded size; every row is put into one of its leaves. A query visits leaves best bin
    first. How many is calibrated: ``calibration_queries`` queries are compared with all rows,
    and visits are widened until their true neighbours are found with a share of ``recall``.
    A leaf with more than ``chunk_rows`` rows is cut into chunks, each of which returns its
    ``k`` best; scores are exact products of the original vectors.

    Rows whose id or vector is null, whose vector holds null, NaN or infinity, or is zero
    or empty take no part. Short vectors count as filled up with zeros. Rows that repeat an id count once
    a leaf. An empty table gives no rows. Other columns are not read. Returns
    ``query_id, rank, vec_id, score``.
    """
    usable = usable_vectors(vectors, id_col, vector_col).filter(F.exists("vector", lambda x: x != 0))
    query_ids = vectors.filter(is_query & F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("vec_id")).distinct()
    stats = usable.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("dim")).first()
    rows, dim = stats["n"], stats["dim"] or 1
    spread = F.xxhash64(F.lit(seed), "vec_id")

    def share(of: int, most: int) -> Column:  # about ``most`` of ``of`` rows
        return F.shiftright(spread, 11) / F.lit(float(1 << 53)) + F.lit(0.5) <= F.lit(min(1.0, most / max(of, 1)))

    sample = usable.filter(share(rows, sample_rows)).limit(2 * sample_rows).toArrow()
    x = matrix(sample["vector"], dim)
    tree = fit_tree(x[np.argsort(np.asarray(sample["vec_id"], np.int64), kind="stable")], branches, depth)
    shared = vectors.sparkSession.sparkContext.broadcast(tree)  # of bounded size, see above

    def placed(batches):
        for batch in batches:
            leaf = shared.value.leaves_of(matrix(batch["vector"], dim))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf, pa.int32())], names=["vec_id", "vector", "leaf"])

    kind = usable.schema["vector"].dataType.simpleString()
    members = stored(usable.mapInArrow(placed, f"vec_id bigint, vector {kind}, leaf int"), "ann-leaves")
    queries = stored(
        members.join(query_ids, "vec_id", "left_semi").dropDuplicates(["vec_id"]).select(F.col("vec_id").alias("query_id"), "vector"),
        "ann-queries",
    )
    visits = _calibrated(members, queries, tree, dim, k, recall, calibration_queries)

    def leaves(batches):
        for batch in batches:
            q = matrix(batch["vector"], dim)
            lists = [shared.value.order(row, visits) for row in q]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists, pa.list_(pa.int32()))], names=["query_id", "vector", "leaves"])

    sizes = {r["leaf"]: r["count"] for r in members.groupBy("leaf").count().collect()}  # a row for each leaf
    parts = F.create_map(*[F.lit(v) for leaf, n in sizes.items() for v in (leaf, -(-n // chunk_rows))]) if sizes else None
    if parts is None:
        return queries.select("query_id", F.lit(0).alias("rank"), F.col("query_id").alias("vec_id"), F.lit(0.0).alias("score"))
    split = members.withColumn("chunk", F.pmod(F.xxhash64("vec_id"), parts[F.col("leaf")]).cast("int"))
    asked = (
        queries.mapInArrow(leaves, f"query_id bigint, vector {kind}, leaves array<int>")
        .select("query_id", "vector", F.explode("leaves").alias("leaf"))
        .withColumn("parts", parts[F.col("leaf")]).filter(F.col("parts").isNotNull())
        .select("query_id", "vector", "leaf", F.explode(F.sequence(F.lit(0), (F.col("parts") - 1).cast("int"))).alias("chunk"))
    )

    def search(q: pa.Table, rows: pa.Table) -> pa.Table:
        own, near, score = best_of(
            np.asarray(q["query_id"], np.int64), matrix(q["vector"], dim),
            np.asarray(rows["vec_id"], np.int64), matrix(rows["vector"], dim), k,
        )
        return pa.table({"query_id": pa.array(own, pa.int64()), "vec_id": pa.array(near, pa.int64()), "score": pa.array(score, pa.float64())})

    found = asked.groupBy("leaf", "chunk").cogroup(split.groupBy("leaf", "chunk")).applyInArrow(
        search, "query_id bigint, vec_id bigint, score double"
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )


def _calibrated(members: DataFrame, queries: DataFrame, tree: Tree, dim: int, k: int, recall: float, most: int) -> int:
    """The least number of leaves with which the calibration queries find ``recall`` of their true neighbours."""
    sample = queries.orderBy(F.xxhash64("query_id"), "query_id").limit(most).toArrow()
    ids, q = np.asarray(sample["query_id"], np.int64), matrix(sample["vector"], dim)
    if not len(ids):
        return 1

    def compare(batches):
        for batch in batches:
            rows = np.asarray(batch["vec_id"], np.int64)
            own, near, score = best_of(ids, q, rows, matrix(batch["vector"], dim), k)
            leaf = dict(zip(rows.tolist(), batch["leaf"].to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(own, pa.int64()), pa.array(near, pa.int64()), pa.array(score, pa.float64()),
                 pa.array([leaf[i] for i in near.tolist()], pa.int32())],
                names=["query_id", "vec_id", "score", "leaf"],
            )

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    true = (
        members.mapInArrow(compare, "query_id bigint, vec_id bigint, score double, leaf int")
        .withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k).select("query_id", "leaf").toPandas()
    )
    place = {i: {leaf: n for n, leaf in enumerate(tree.order(row, tree.n_leaves))} for i, row in zip(ids.tolist(), q)}
    needed = np.sort([place[i][leaf] + 1 for i, leaf in zip(true["query_id"], true["leaf"])])
    if not len(needed):
        return 1
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)])
