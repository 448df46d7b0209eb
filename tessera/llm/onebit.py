"""Approximate nearest neighbours by randomly rotated one-bit codes.

Indexing rotates each unit vector by random orthogonal matrices and keeps the signs, packed to bits
(short vectors are turned several times, for ``BITS`` bits at least), with scalars: its length, and
for each rotation the inner product of the rotated unit vector with its own code. From them the inner
product with a query is estimated without bias, with an error that is bounded with a chosen
confidence. The codes are made once and written. A search estimates all candidates of a block from
their bits, takes the best few exactly, and reranks, on the original vectors, those whose upper bound
reaches the best exact scores so far.

Rows of queries and of the index are dealt into blocks of bounded size, each pair of blocks is a
task's group, and every group gives its best; the best of all groups are the result. Every query meets
every code: a query set that grows with the index makes the work grow with their product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import cut, discard

QUERY_BLOCK, INDEX_BLOCK = 8192, 16384
#: Standard deviations of the estimate that the error bound spans, and least bits of a code.
SPREAD, BITS = 4.0, 512


def rotation(dims: int, seed: int = 11, bits: int = BITS) -> np.ndarray:
    """Random orthogonal matrices below each other, for ``bits`` rows at least, the same for a seed everywhere."""
    rng = np.random.default_rng(seed)
    turns = []
    for _ in range(max(1, -(-bits // dims))):
        q, r = np.linalg.qr(rng.normal(size=(dims, dims)))
        turns.append((q * np.sign(np.diag(r))).T)
    return np.concatenate(turns)


def encode(vectors: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits, lengths, and for each rotation the inner products of the rotated unit vectors with their codes."""
    dims = vectors.shape[1]
    length = np.linalg.norm(vectors, axis=1)
    turned = vectors @ turn.T / length[:, None]
    own = np.abs(turned).reshape(len(vectors), -1, dims).sum(2) / np.sqrt(dims)
    return np.packbits(turned > 0, axis=1), length, own


def signs_of(bits: np.ndarray, length: np.ndarray, own: np.ndarray, dims: int) -> np.ndarray:
    """Codes as rows of +-1, each rotation's scaled so that a product with a rotated query is the mean estimate."""
    count = own.shape[1]
    signs = np.unpackbits(bits, axis=1, count=count * dims).astype(np.float32).reshape(len(bits), count, dims) * 2 - 1
    signs *= (length[:, None] / own / (count * np.sqrt(dims))).astype(np.float32)[:, :, None]
    return signs.reshape(len(bits), count * dims)


def error_of(length: np.ndarray, own: np.ndarray, dims: int, spread: float = SPREAD) -> np.ndarray:
    """Bounds of the estimates' errors for queries of length one."""
    each = np.maximum(0, 1 - own**2) / own**2 / max(1, dims - 1)
    return spread * np.sqrt(each.sum(1)) / own.shape[1] * length


def estimate(queries: np.ndarray, turn: np.ndarray, bits: np.ndarray, length: np.ndarray, own: np.ndarray, spread: float = SPREAD) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products (queries by candidates) from the codes, and bounds of their errors."""
    guess = (queries @ turn.T).astype(np.float32) @ signs_of(bits, length, own, queries.shape[1]).T
    error = error_of(length, own, queries.shape[1], spread).astype(np.float32)
    return guess, np.linalg.norm(queries, axis=1)[:, None].astype(np.float32) * error


def inner(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed from the first component to the last."""
    total = np.zeros(len(vectors))
    for j in range(len(query)):
        total += vectors[:, j] * query[j]
    return total


def search_block(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, codes: tuple[np.ndarray, np.ndarray, np.ndarray], turn: np.ndarray, k: int):
    """For each query the ``k`` best of a block: (query number, candidate numbers, exact scores)."""
    bits, length, own = codes
    signs = signs_of(bits, length, own, queries.shape[1])
    error = error_of(length, own, queries.shape[1]).astype(np.float32)
    lengths = np.linalg.norm(queries, axis=1).astype(np.float32)
    turned = (queries @ turn.T).astype(np.float32)
    first = min(k + 1, len(ids))
    for low in range(0, len(queries), 128):
        for i, guess in enumerate(turned[low : low + 128] @ signs.T):
            at = low + i
            near = np.argpartition(-guess, first - 1)[:first]
            near = near[ids[near] != query_ids[at]]
            exact = inner(vectors[near], queries[at])
            # what the bound can't tell from the best so far
            least = np.partition(exact, len(exact) - k)[len(exact) - k] if len(near) >= k else -np.inf
            guess[near] = -np.inf
            more = np.flatnonzero(guess + lengths[at] * error >= least) if least > -np.inf else np.setdiff1d(np.arange(len(ids)), near)
            more = more[ids[more] != query_ids[at]]
            numbers, scores = np.concatenate([near, more]), np.concatenate([exact, inner(vectors[more], queries[at])])
            best = np.lexsort((ids[numbers], -scores))[:k]
            yield at, numbers[best], scores[best]


def search(vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector: str = "embedding", seed: int = 11, query_block: int = QUERY_BLOCK, index_block: int = INDEX_BLOCK) -> DataFrame:
    """(query_id, rank, ``id_col``, score): for each row where ``is_query`` holds, the ``k`` other rows with the largest inner product.

    Nearest first, ties to the smaller id; all others where there are fewer than ``k``. Null ids and
    vectors that are null, zero, of another than the commonest dimension, or hold a null or
    non-finite component take no part. Rows that repeat an id count once, with its smallest vector.
    """
    good = vectors.where(F.col(id_col).isNotNull() & F.col(vector).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    ok = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    good = cut(good.where(ok).groupBy("id").agg(F.min("v").alias("v")), "onebit")
    sizes = good.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.count_if(is_query(F.col("id"))).alias("q")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not sizes:
        return vectors.sparkSession.createDataFrame([], f"query_id long, rank int, {id_col} long, score double")
    dims, n, q = sizes[0]["d"], sizes[0]["n"], sizes[0]["q"]
    turn = rotation(dims, seed)

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            if not len(flat):
                continue
            bits, length, own = encode(flat, turn)
            codes = [b.tobytes() + np.append(own[i], length[i]).tobytes() for i, b in enumerate(bits)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([v.tobytes() for v in flat], pa.binary()), pa.array(codes, pa.binary())], names=["id", "v", "code"])

    index = cut(good.where(F.size("v") == dims).mapInArrow(indexed, "id long, v binary, code binary"), "onebit-codes")
    discard(good)
    q_blocks, i_blocks = max(1, -(-q // query_block)), max(1, -(-n // index_block))
    block = lambda blocks, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(blocks)).cast("int")
    held = index.select(block(i_blocks, 1).alias("b"), F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("a"), "id", "v", "code")
    asked = index.where(is_query(F.col("id"))).select(block(q_blocks, 2).alias("a"), F.explode(F.sequence(F.lit(0), F.lit(i_blocks - 1))).alias("b"), "id", "v")

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            stacked = lambda t, c, kind: np.frombuffer(b"".join(t[c].to_pylist()), kind).reshape(t.num_rows, -1)
            ids, query_ids = right["id"].to_numpy(), left["id"].to_numpy()
            codes = stacked(right, "code", np.uint8)
            scalars = codes[:, -(-len(turn) // 8) :].copy().view(np.float64)
            codes = (codes[:, : -(-len(turn) // 8)], scalars[:, -1], scalars[:, :-1])
            for at, numbers, scores in search_block(query_ids, stacked(left, "v", np.float64), ids, stacked(right, "v", np.float64), codes, turn, k):
                found.append((np.full(len(numbers), query_ids[at]), ids[numbers], scores))
        columns = [np.concatenate([f[j] for f in found]) if found else np.zeros(0) for j in range(3)]
        return pa.table({name: pa.array(c, t) for name, c, t in zip(("query_id", "id", "score"), columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)})

    found = asked.groupBy("a", "b").cogroup(held.groupBy("a", "b")).applyInArrow(run, "query_id long, id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
