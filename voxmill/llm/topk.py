"""Exact top-k inner products by the threshold algorithm over sorted per-dimension lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bound_batches, settled, table

SCALE, K, EVERY = 64, 20, 20
BLOCK_ROWS = 4096
QUERY_BLOCK_ROWS = 1024
#: At least so many tasks share the row blocks that a query block meets, and at most so many row blocks go to one of them.
STRANDS, STRAND_BLOCKS = 16, 64
#: Products of larger parts are not exact in the doubles that score a block; they are scored in integers.
MAX_COMPONENT = 1 << 22


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component, as array<long>.

    Left out: null ids, null or empty vectors, vectors that hold null or non-finite parts. A part
    that no long holds is an error, as it is in SQL.
    """
    scaled = lambda x: x.cast("double") * scale
    part = lambda x: F.when(F.abs(scaled(x)) < 2.0**63, F.floor(scaled(x))).otherwise(F.raise_error(F.lit("a vector's part is beyond the range of long")).cast("long"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))
    whole = F.coalesce(F.forall("embedding", lambda x: F.coalesce(fine(x), F.lit(False))), F.lit(False))
    kept = vectors.where(F.col("vec_id").isNotNull() & whole & (F.size("embedding") > 0))
    return kept.select("vec_id", F.transform("embedding", part).alias("v"))


def sorted_lists(rows: np.ndarray) -> np.ndarray:
    """Of each dimension (column), the places of the rows by rising component."""
    return np.argsort(rows, axis=0, kind="stable")


def threshold_search(
    ids: np.ndarray, rows: np.ndarray, order: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, best_so_far: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows of a block that may be among the k best of each query: (query position, vec_id, score).

    `order` is sorted_lists(rows). `best_so_far` (queries, k) holds each query's best scores in earlier
    blocks, in any order, and is brought up to date: what is below all of a query's is passed over.

    Each dimension has one sorted list, walked from the end that the query's sign prefers.
    Walking is by doubling depths: rows seen so far are scored in full (from the second block on only at the
    depth where the bound falls below the k-th score of the earlier ones), and the search stops
    when the sum of what each list could still give is below the k-th best score, of this block or
    of the earlier ones. (A tie at the bound goes on, as the unseen row may have the smaller id.)
    """
    n, dims = rows.shape
    ranked = np.take_along_axis(rows, order, axis=0).astype(np.float64)
    exact, wanted = rows.astype(np.float64), queries.astype(np.float64)
    depths = [max(1, 2 * k // dims)]
    while depths[-1] * dims < n:
        depths.append(2 * depths[-1])
    depths = np.array(depths[:-1], np.int64)  # from the last on, all rows have been seen
    bounds = ranked[n - depths] @ np.maximum(wanted, 0).T + ranked[depths - 1] @ np.minimum(wanted, 0).T
    at, found, scores, whole = [], [], [], []

    def settle(q: int, names: np.ndarray, got: np.ndarray) -> None:
        fit = (names != query_ids[q]) & (got >= best_so_far[q].min())
        names, got = names[fit], got[fit]
        top = np.lexsort((names, -got))[:k]
        best_so_far[q] = np.partition(np.concatenate([best_so_far[q], got[top]]), len(top))[len(top) :]
        at.append(np.full(len(top), q))
        found.append(names[top])
        scores.append(got[top])

    for q, w in enumerate(wanted):
        floor = best_so_far[q].min()
        # With a k-th score of earlier blocks, the depth at which the bound falls below it is known; else it is walked to.
        for i in np.flatnonzero(bounds[:, q] < floor)[:1] if floor > -np.inf else range(len(depths)):
            up, down = order[n - depths[i] :, w > 0], order[: depths[i], w < 0]
            seen = np.unique(np.concatenate([up.ravel(), down.ravel()]))
            names, got = ids[seen], exact[seen] @ w
            others = got[names != query_ids[q]]
            least = max(floor, np.partition(others, len(others) - k)[len(others) - k]) if len(others) > k else floor
            if bounds[i, q] < least:
                settle(q, names, got)
                break
        else:
            whole.append(q)
    full = exact @ wanted[whole].T  # lists that run out: all rows, scored together
    for j, q in enumerate(whole):
        settle(q, ids, full[:, j])
    join = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
    return join(at, np.int64), join(found, np.int64), join(scores, np.int64)


def integer_search(ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As threshold_search, for parts of any size: every row is scored, in 64 bits where no sum can pass them, else in Python's integers."""
    largest = lambda x: max((abs(int(v)) for v in (x.max(initial=0), x.min(initial=0))), default=0)
    kind = np.int64 if largest(rows) * largest(queries) * rows.shape[1] < 1 << 63 else object
    rows, queries = rows.astype(kind), queries.astype(kind)
    at, found, scores = [], [], []
    for q, (qid, w) in enumerate(zip(query_ids, queries, strict=True)):
        top = sorted((-s, i) for s, i in zip((rows @ w).tolist(), ids.tolist(), strict=True) if i != qid)[:k]
        at += [q] * len(top)
        found += [i for _, i in top]
        scores += [-s for s, _ in top]
    return np.array(at, np.int64), np.array(found, np.int64), np.array(scores, np.int64)


def _small(rows: np.ndarray) -> np.ndarray:
    return ((rows > -MAX_COMPONENT) & (rows < MAX_COMPONENT)).all(1)


def block_search(
    ids: np.ndarray, rows: np.ndarray, order: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, best_so_far: np.ndarray
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The best rows for each query among those with small parts (of which `order` has the lists) and among the others, as (query position, vec_id, score)."""
    fine, asked = _small(rows), _small(queries)
    if fine.any() and asked.any():
        best = best_so_far[asked]
        at, found, score = threshold_search(ids[fine], rows[fine], order, query_ids[asked], queries[asked], k, best)
        best_so_far[asked] = best
        yield np.flatnonzero(asked)[at], found, score
    for r, q in ((~fine, asked), (np.ones(len(rows), bool), ~asked)):
        if r.any() and q.any():
            at, found, score = integer_search(ids[r], rows[r], query_ids[q], queries[q], k)
            yield np.flatnonzero(q)[at], found, score


def _blocks(vectors: DataFrame, rows: int, name: str) -> DataFrame:
    """One row for each block of about `rows` vectors of one dimension: ids and components.

    `vectors` is settled, so rows can be dealt by their place: repeated ids spread like others.
    """
    n = vectors.count()
    parts = max(1, -(-n // rows))
    packed = vectors.withColumn("dims", F.size("v")).withColumn(name, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(parts)).cast("int"))
    own = packed.groupBy("dims", name).agg(F.sort_array(F.collect_list(F.struct("vec_id", "v"))).alias("_rows"))
    return own.select("dims", name, F.col("_rows.vec_id").alias(f"{name}_ids"), F.flatten(F.col("_rows.v")).alias(f"{name}_v"))


def _listed(blocks: DataFrame) -> DataFrame:
    """Add each block's sorted lists, made once, and the largest sum of squares of a row of it."""

    def lists(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            orders, reach = [], []
            for dims, v in zip(batch["dims"], batch["b_v"], strict=True):
                rows = np.asarray(v, np.int64).reshape(-1, dims)
                orders.append(sorted_lists(rows[_small(rows)]).astype(np.int32).tobytes())
                reach.append(float((rows.astype(np.float64) ** 2).sum(1).max()))
            yield batch.assign(b_order=orders, b_reach=reach)

    return blocks.mapInPandas(lists, "dims int, b int, b_ids array<long>, b_v array<long>, b_order binary, b_reach double")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best rows other than itself, ties to the smaller id.

    Both sides are (vec_id, v). Blocks of queries meet blocks of rows of the same dimension,
    those with long vectors first; a task carries each query's k-th best score from one block to the next.
    A pair gives at most k rows a query, of which the k best of all are ranked. Copies of a vector are
    rows like any other; repeated ids count once for each row. An empty side gives no rows.
    """
    bound_batches(vectors.sparkSession)
    left = _blocks(settled(queries), query_rows, "q")
    right = settled(_listed(_blocks(settled(vectors), block_rows, "b")))
    strands = max(STRANDS, -(-right.count() // STRAND_BLOCKS))
    # Query blocks go to every strand, row blocks to their own, so no key holds all blocks.
    spread = left.withColumn("strand", F.explode(F.sequence(F.lit(0), F.lit(strands - 1))))
    pairs = spread.join(right.withColumn("strand", F.pmod("b", F.lit(strands))), ["dims", "strand"])
    dealt = pairs.repartition("dims", "q", "strand").sortWithinPartitions("dims", "q", "strand", F.col("b_reach").desc())

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, best = None, None
        for batch in batches:
            for r in batch.itertuples(index=False):
                ids, qids = np.asarray(r.b_ids, np.int64), np.asarray(r.q_ids, np.int64)
                rows, asked = np.asarray(r.b_v, np.int64).reshape(-1, r.dims), np.asarray(r.q_v, np.int64).reshape(-1, r.dims)
                if (r.dims, r.q, r.strand) != key:
                    key, best = (r.dims, r.q, r.strand), np.full((len(qids), k), -np.inf)
                order = np.frombuffer(r.b_order, np.int32).reshape(-1, r.dims)
                for at, found, score in block_search(ids, rows, order, qids, asked, k, best):
                    yield pd.DataFrame({"query_id": qids[at], "vec_id": found, "score": score})

    best = dealt.mapInPandas(search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quantised(table(spark, sf_dir, "embeddings"))
    return top_k(rows, rows.where(F.pmod("vec_id", F.lit(EVERY)) == 0))


OP2_SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % {EVERY} = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
"""
