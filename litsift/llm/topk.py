"""Exact top-k search by inner product: the threshold algorithm over sorted per-dimension lists.

Candidates are dealt into blocks of bounded size. A task holds one block, sorts a list of its candidates for every
dimension once, and takes the queries from a stream, QUERIES at a time. Queries read the lists from both ends, to growing
depths; whatever turns up is scored in full, and a query stops reading when the bound on unseen candidates (the sum of
each list's contribution at the current depth) is below its k-th best score. That score is carried on: the first block
gives every query a floor, from which it begins in all others. The best of all blocks are merged for each query row.

The bound stops early where few dimensions decide a query; where all weigh alike, in dozens of dimensions, nearly every
candidate turns up in some list before it falls below the k-th score, and the work is that of scoring all pairs. n_scored
says how many candidates a query has scored.

Edge cases: vectors that are null, or hold null or non-finite components, take no part, nor do null ids; shorter vectors
count as padded with zeros; ties go to the smaller id; candidates of a query's own id are left out; repeated rows count
one by one, as candidates and as queries (each has its own ranks); with fewer than k candidates all are returned; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litsift.llm.common import cut

#: Candidates of a block, queries that read its lists together, and queries of a task; they bound memory and time of a task.
CANDIDATES, QUERIES, TASK_QUERIES = 8192, 512, 1 << 16
#: Rows without vec_id say how many candidates of a block the query has scored.
FOUND = "row long, query_id long, vec_id long, score long, n_scored long"

NAMES = ["row", "query_id", "vec_id", "score", "n_scored"]


class Lists:
    """Sorted lists of a block of candidates; rows come in order of id."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.up = np.argsort(vectors, axis=0, kind="stable")
        self.down = np.argsort(-vectors, axis=0, kind="stable")
        self.up_values, self.down_values = np.sort(vectors, axis=0), -np.sort(-vectors, axis=0)

    def top(self, own: np.ndarray, queries: np.ndarray, k: int, floor: np.ndarray | None = None) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
        """For each query positions and scores of the k best that reach its floor, best first, ties by id; and how many it scored.

        All queries read the lists together: what turns up at a depth is scored in full for those that still read.
        """
        n = len(self.ids)
        none = np.empty(0, dtype=np.int64), np.empty(0, dtype=queries.dtype)
        best, scored = [none] * len(queries), np.zeros(len(queries), dtype=np.int64)
        kth = np.full(len(queries), -np.inf) if floor is None else floor.copy()
        rising, falling = np.maximum(queries, 0), np.minimum(queries, 0)
        reading, seen, depth = np.arange(len(queries)), np.zeros(n, dtype=bool), 1
        bound = rising @ self.down_values[0] + falling @ self.up_values[0] if n else None
        reading = reading[bound >= kth] if n else reading[:0]
        while len(reading):
            depth = min(2 * depth, n)
            fresh = np.zeros(n, dtype=bool)
            fresh[self.down[:depth]] = fresh[self.up[:depth]] = True
            fresh &= ~seen
            seen |= fresh
            at = np.flatnonzero(fresh)
            scores = queries[reading] @ self.vectors[at].T
            scored[reading] += len(at)
            worst = -np.inf if scores.dtype.kind == "f" else np.iinfo(scores.dtype).min
            scores[own[reading][:, None] == self.ids[at][None]] = worst
            low = np.partition(scores, len(at) - k, axis=1)[:, len(at) - k] if len(at) > k else np.full(len(reading), -np.inf)
            for row, i in enumerate(reading):
                good = np.flatnonzero((scores[row] >= max(low[row], kth[i])) & (scores[row] > worst))
                places, values = np.concatenate([best[i][0], at[good]]), np.concatenate([best[i][1], scores[row, good]])
                keep = np.lexsort((self.ids[places], -values))[:k]
                best[i] = places[keep], values[keep]
                if len(keep) == k:
                    kth[i] = max(kth[i], values[keep[-1]])
            if depth == n:
                break
            bound = rising[reading] @ self.down_values[depth - 1] + falling[reading] @ self.up_values[depth - 1]
            reading = reading[bound >= kth[reading]]
        return best, scored


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Lists of integers as the rows of a matrix, padded with zeros."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), dims), dtype=np.int64)
    at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(np.arange(len(sizes)), sizes), at] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def searched(k: int, dims: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The best of a block for each query; of a cell the candidates come first, then its queries with their floors."""

    def found(batch: pa.RecordBatch, lists: Lists) -> Iterator[pa.RecordBatch]:
        rows, own = batch.column("row").to_numpy(), batch.column("vec_id").to_numpy()
        queries, floor = matrix(batch.column("v"), dims), batch.column("floor").to_numpy(zero_copy_only=False)
        if lists.vectors.dtype.kind == "f":
            queries = queries.astype(float)
        best, scored = lists.top(own, queries, k, np.nan_to_num(floor, nan=-np.inf, neginf=-np.inf))
        n = [len(at) for at, _ in best]
        places, scores = np.concatenate([at for at, _ in best]), np.concatenate([s for _, s in best]).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(rows, n)), pa.array(np.repeat(own, n)), pa.array(lists.ids[places]), pa.array(scores), pa.nulls(len(places), pa.int64())], NAMES)
        yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(own), pa.nulls(len(rows), pa.int64()), pa.nulls(len(rows), pa.int64()), pa.array(scored)], NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, lists = None, [], None
        for batch in batches:
            cells, asks = batch.column("cell").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False)
            edges = np.append(np.flatnonzero(np.append(True, (cells[1:] != cells[:-1]) | (asks[1:] != asks[:-1]))), len(cells)) if len(cells) else []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                part = batch.slice(a, b - a)
                if cells[a] != cell:
                    cell, held, lists = cells[a], [], None
                if not asks[a]:
                    held.append((part.column("vec_id").to_numpy(), matrix(part.column("v"), dims)))
                    continue
                if lists is None and held:
                    ids, vectors = (np.concatenate(x) for x in zip(*held, strict=True))
                    order, held = np.argsort(ids, kind="stable"), []
                    exact = float(np.abs(vectors).max(initial=0)) ** 2 * max(1, dims) < 2**50  # doubles then add up exactly
                    lists = Lists(ids[order], vectors[order].astype(float) if exact else vectors[order])
                for x in range(0, part.num_rows if lists else 0, QUERIES):
                    yield from found(part.slice(x, QUERIES), lists)

    return run


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0) -> DataFrame:
    """From rows (vec_id, embedding): row (of the query), query_id, rank, vec_id and score of each query row's k best candidates, and n_scored."""
    good = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.col("vec_id").isNotNull()
    scaled = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    rows = cut(vectors.where(F.coalesce(good, F.lit(False))).select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), scaled.alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")))
    size = rows.agg(F.count("*").alias("n"), F.count_if("asks").alias("q"), F.max(F.size("v")).alias("dims")).first()
    n_blocks, n_parts, dims = -(-max(1, size["n"]) // CANDIDATES), -(-max(1, size["q"]) // TASK_QUERIES), size["dims"] or 0
    block = F.pmod(F.xxhash64("row", F.lit("block")), F.lit(n_blocks)).cast("int")
    part = F.pmod(F.xxhash64("row", F.lit("part")), F.lit(n_parts)).cast("int")
    spread = lambda first, n: F.explode(F.sequence(F.lit(first), F.lit(n - 1)))
    asking = rows.where("asks").select("row", "vec_id", "v", F.lit(True).alias("asks"), part.alias("part"))
    held = rows.select("row", "vec_id", "v", F.lit(False).alias("asks"), F.lit(None).cast("double").alias("floor"), block.alias("block"), spread(0, n_parts).alias("part"))

    def search(asked: DataFrame, first: int, last: int) -> DataFrame:
        """Blocks first to last - 1 against all queries, a task for each block and part of the queries."""
        wanted = asked.select("row", "vec_id", "v", "asks", "floor", spread(first, last).alias("block"), "part")
        both = held.where(F.col("block").between(first, last - 1)).unionByName(wanted).withColumn("cell", ((F.col("block") - first) * n_parts + F.col("part")).cast("int"))
        cells = both.repartitionById((last - first) * n_parts, F.col("cell")).sortWithinPartitions("cell", "asks", "row")
        return cells.select("cell", "row", "vec_id", "v", "asks", "floor").mapInArrow(searched(k, dims), FOUND)

    found = search(asking.withColumn("floor", F.lit(None).cast("double")), 0, 1)
    if n_blocks > 1:
        found = cut(found)
        floors = found.groupBy("row").agg(F.when(F.count("vec_id") >= k, F.min("score")).cast("double").alias("floor"))
        found = found.union(search(asking.join(floors, "row", "left"), 1, n_blocks))
    best = Window.partitionBy("row").orderBy(F.desc_nulls_last("score"), "vec_id")
    each = found.withColumns({"rank": F.row_number().over(best), "n_scored": F.sum("n_scored").over(Window.partitionBy("row"))})
    return each.where(F.col("vec_id").isNotNull() & (F.col("rank") <= k)).select("row", "query_id", "rank", "vec_id", "score", "n_scored")


#: DuckDB SQL for the query: vectors of every id divisible by 20 against all rows.
SQL = """
WITH v AS (
  SELECT row_number() OVER () AS own, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.own, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
