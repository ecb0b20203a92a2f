"""Exact top-k search by selection on distributed histograms of scores."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import matrix, stored, usable_vectors


def exact_topk(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    scale: int = 1024,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    chunk_rows: int = 1024,
    query_rows: int = 1024,
    bins: int = 256,
) -> DataFrame:
    """The ``k`` best candidates of each query by integer inner product.

    Components become ``floor(scale * x)``. Every query is scored against every other row,
    in blocks of ``query_rows`` by ``chunk_rows``, once per round. A round counts scores in
    ``bins`` bins of the interval that is known to hold the k-th best score; summed over all
    blocks, the counts say in which bin that score lies, and the next round refines this
    bin. When a bin is one score wide, or few scores lie at or above it, a last round
    fetches the scores from there on, and ranks decide ties by the smaller id. A block
    reports nothing below its own k-th best score, and of scores equal to the bound only
    its ``k`` smallest ids, so a vector that occurs a million times costs ``k`` rows a block.

    Rows whose id or vector is null, or whose vector holds null, NaN or infinity, take no
    part; nor do vectors whose square sum after scaling exceeds 2**60, as their scores may not fit
    64 bits. Short vectors count as filled up with zeros. Rows that repeat an id count once
    (the greatest vector). Scores are exact below 2**53. An empty
    table gives no rows; fewer than ``k`` candidates are all returned. Other columns are not
    read. Returns ``query_id, rank, vec_id, score``.
    """
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + (F.abs(x.cast("double")) * F.lit(float(scale)) + 1) ** 2)
    usable = usable_vectors(vectors, id_col, vector_col).filter(square <= F.lit(float(2**60)))
    query_ids = vectors.filter(is_query).select(F.col(id_col).cast("bigint").alias("vec_id"))
    sizes = usable.agg(
        F.count(F.lit(1)).alias("rows"),
        F.max(F.size("vector")).alias("dim"),
        F.max(F.aggregate("vector", F.lit(0.0), lambda s, x: F.greatest(s, F.abs(x.cast("double"))))).alias("most"),
    ).first()
    n_queries = query_ids.filter(F.col("vec_id").isNotNull()).distinct().count()
    chunks = max(1, -(-sizes["rows"] // chunk_rows))
    blocks = max(1, -(-n_queries // query_rows))
    bound = min(int((scale * (sizes["most"] or 0.0) + 1) ** 2) * (sizes["dim"] or 0), 2**60) + 1  # of any score, by the sums of squares

    every_chunk = F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk")
    every_block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    spread = F.xxhash64("vec_id")
    candidates = usable.select(
        "vec_id", "vector", F.pmod(spread, F.lit(chunks)).cast("int").alias("chunk"), every_block
    )
    queries = stored(
        usable.join(query_ids.distinct(), "vec_id", "left_semi")
        .groupBy("vec_id").agg(F.max("vector").alias("vector"))
        .withColumn("block", F.pmod(spread, F.lit(blocks)).cast("int")),
        "topk-queries",
    )

    def against(state: DataFrame, block_of, schema: str) -> DataFrame:
        left = queries.join(state, queries["vec_id"] == state["query_id"]).select(
            "query_id", "vector", "lo", "past", "width", "block", every_chunk
        )
        return left.groupBy("chunk", "block").cogroup(candidates.groupBy("chunk", "block")).applyInArrow(
            block_of, schema
        )

    width = max(1, -(-2 * bound // bins))
    state = queries.select(
        F.col("vec_id").alias("query_id"), F.lit(-bound).cast("bigint").alias("lo"),
        F.lit(bins * width - bound).cast("bigint").alias("past"), F.lit(width).cast("bigint").alias("width"), F.lit(0).cast("bigint").alias("above"),
    )
    while True:
        counts = against(state, _counter(scale, k), "query_id bigint, bin bigint, n bigint")
        state = stored(_next_state(state, counts, k), "topk-state")
        left = state.filter((F.col("width") > 1) & (F.col("tail") > 8 * k)).limit(1).count()
        state = state.drop("tail")
        if not left:
            break
        # every width shrinks alike, so that all queries end together; 1 is the end
        state = state.withColumn("width", F.greatest(F.lit(1), F.ceil(F.col("width") / bins)).cast("bigint"))
    found = against(state, _fetcher(scale, k), "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _next_state(state: DataFrame, counts: DataFrame, k: int) -> DataFrame:
    """The bin with the k-th best score becomes the next interval of each query.

    ``tail`` is the number of scores at or above its lower end. Queries with fewer than
    ``k`` candidates keep their lowest reported bin.
    """
    down = Window.partitionBy("query_id").orderBy(F.desc("bin"))
    pick = (
        counts.groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
        .withColumn("reached", F.sum("n").over(down))
        .join(state, "query_id")
        .withColumn("tail", F.col("above") + F.col("reached"))
    )
    enough = F.col("tail") >= k
    chosen = pick.groupBy("query_id").agg(
        F.coalesce(F.max(F.when(enough, F.col("bin"))), F.min("bin")).alias("chosen")
    )
    return pick.join(chosen, "query_id").filter(F.col("bin") == F.col("chosen")).select(
        "query_id",
        (F.col("lo") + F.col("bin") * F.col("width")).alias("lo"),
        (F.col("lo") + (F.col("bin") + 1) * F.col("width")).alias("past"),
        "width",
        (F.col("tail") - F.col("n")).alias("above"),
        "tail",
    )


def _scores(queries: pa.Table, candidates: pa.Table, scale: int):
    """Query ids, candidate ids in ascending order, and the matrix of integer scores."""
    ids = np.asarray(candidates["vec_id"], dtype=np.int64)
    a, b = matrix(queries["vector"]), matrix(candidates["vector"])
    width = max(a.shape[1], b.shape[1])
    a, b = (np.floor(scale * np.pad(m, ((0, 0), (0, width - m.shape[1])))) for m in (a, b))
    order = np.lexsort((*b.T[::-1], ids)) if len(ids) else np.empty(0, np.int64)
    ids, b = ids[order], b[order]
    last = np.append(ids[1:] != ids[:-1], True)[: len(ids)]  # the greatest of the rows of an id
    ids, b = ids[last], b[last]
    most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * width
    if most < 2.0**53:
        scores = (a @ b.T).astype(np.int64)
    else:
        scores = a.astype(np.int64) @ b.astype(np.int64).T
    return np.asarray(queries["query_id"], dtype=np.int64), ids, scores


def _counter(scale: int, k: int):
    def count(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int]] = []
        if queries.num_rows and candidates.num_rows:
            own, ids, scores = _scores(queries, candidates, scale)
            lo, past, width = (np.asarray(queries[c], dtype=np.int64) for c in ("lo", "past", "width"))
            for i, query in enumerate(own):
                s = scores[i][ids != query]
                cell = (s[(s >= lo[i]) & (s < past[i])] - lo[i]) // width[i]
                at, n = np.unique(cell, return_counts=True)
                keep = np.cumsum(n[::-1])[::-1] - n < k  # fewer than k above: not below the own k-th best
                out += [(query, int(c), int(m)) for c, m in zip(at[keep], n[keep])]
        return pa.table(
            {c: pa.array([r[j] for r in out], pa.int64()) for j, c in enumerate(("query_id", "bin", "n"))}
        )

    return count


def _fetcher(scale: int, k: int):
    def fetch(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        found = ([], [], [])
        if queries.num_rows and candidates.num_rows:
            own, ids, scores = _scores(queries, candidates, scale)
            lo = np.asarray(queries["lo"], dtype=np.int64)
            for i, query in enumerate(own):
                at = np.flatnonzero((scores[i] >= lo[i]) & (ids != query))
                at = at[np.lexsort((ids[at], -scores[i][at]))][:k]
                found[0].append(np.full(len(at), query))
                found[1].append(ids[at])
                found[2].append(scores[i][at])
        return pa.table({
            c: pa.array(np.concatenate(v) if v else [], pa.int64())
            for c, v in zip(("query_id", "vec_id", "score"), found)
        })

    return fetch
