"""Exact top-k inner-product search by block-at-a-time pruning.

Vectors (terms: their dimensions) are sorted by id and packed into blocks of consecutive documents; a block keeps a forward
index (the rows of its documents) and the largest and smallest weight of every term. For a query the sum of its term maxima
bounds every score in a block. Blocks are taken per query in falling order of that bound and scored through their forward
index until the bound falls below the score of the k-th best so far.

Shards of blocks and chunks of queries meet in an equi-join on the shard (each chunk goes to each shard once), so a task
holds one chunk and one shard. A first pass over one shard in eight gives every query a lower bound of its k-th score;
the second pass, over all shards, starts from it and returns only what can still be among the k best, which keeps what is
merged near k rows a query however many shards there are.

Cases: vectors that are null or hold null or non-finite components, and rows without an id, take no part; missing
components count as 0 where lengths differ; rows equal in id and vector count once; different vectors under one id are
candidates and queries of their own, and never candidates of their own id; ties go to the smaller id; fewer than k
candidates give fewer rows; empty tables give an empty result. Scores beyond a long end at its limits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storeline.session import cut_lineage

BLOCK, SHARD, CHUNK = 512, 8192, 256
#: One shard in so many gives the first bounds.
SEED_SHARE = 8
LOWEST = np.iinfo(np.int64).min


def finite(vector: Column) -> Column:
    return vector.isNotNull() & F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def pack_vectors(name: str, rows_each: int):
    """Arrow map function: consecutive (id, vector, theta) rows become (name, n, dims, ids, vectors, thetas)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, k, held, count = TaskContext.get().partitionId() << 32, 0, [], 0

        def out(table: pa.Table) -> pa.RecordBatch:
            lists = table.column("vector").combine_chunks()
            n, sizes = len(lists), pc.list_value_length(lists).to_numpy()
            dims = int(sizes.max(initial=0))
            values = np.zeros((n, dims), np.int64)
            values[np.repeat(np.arange(n), sizes), np.concatenate([np.arange(s) for s in sizes]) if n else []] = lists.flatten().to_numpy()
            return pa.RecordBatch.from_arrays(
                [pa.array([base | k], pa.int64()), pa.array([n], pa.int64()), pa.array([dims], pa.int64()),
                 pa.array([table.column("id").to_numpy().tobytes()], pa.binary()), pa.array([values.tobytes()], pa.binary()),
                 pa.array([table.column("theta").to_numpy().tobytes()], pa.binary())],
                names=[name, "n", "dims", "ids", "vectors", "thetas"])

        for b in batches:
            held.append(b)
            count += b.num_rows
            while count >= rows_each:
                table = pa.Table.from_batches(held)
                yield out(table.slice(0, rows_each))
                k, held, count = k + 1, table.slice(rows_each).to_batches(), count - rows_each
        if count:
            yield out(pa.Table.from_batches(held))

    return run


def packed(rows: DataFrame, name: str, rows_each: int, n: int) -> DataFrame:
    """Rows in the order of their ids, ``rows_each`` to a packed row."""
    schema = f"{name} long, n long, dims long, ids binary, vectors binary, thetas binary"
    parts = max(1, -(-n // (4 * rows_each)))
    return cut_lineage(rows.repartitionByRange(parts, "id", F.xxhash64("vector")).sortWithinPartitions("id").mapInArrow(
        pack_vectors(name, rows_each), schema), name)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products as whole numbers: by floating point where that is exact, else by Python's integers."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1] if a.size and b.size else 0
    if 0 <= most < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    exact = a.astype(object) @ b.T.astype(object)
    return np.clip(exact, LOWEST, np.iinfo(np.int64).max).astype(np.int64)


def best_of_shard(q_ids: np.ndarray, q: np.ndarray, theta: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(query, id, score) of the k best of one shard for each query, of those that reach its bound."""
    cuts = np.arange(0, len(ids), BLOCK)
    top, low = np.maximum.reduceat(v, cuts, axis=0), np.minimum.reduceat(v, cuts, axis=0)
    high = products(np.maximum(q, 0), top) + products(np.minimum(q, 0), low)
    # the bound saturates with the scores, so it never falls short of one
    order = np.argsort(-high.astype(np.float64), axis=1, kind="stable")
    best = np.full((len(q), k), LOWEST, np.int64)
    best_id = np.full((len(q), k), np.iinfo(np.int64).max, np.int64)
    filled = np.zeros(len(q), np.int64)
    kth = theta.copy()
    going = np.ones(len(q), bool)
    for r in range(len(cuts)):
        block = order[:, r]
        going &= high[np.arange(len(q)), block] >= kth
        if not going.any():
            break
        for b in np.unique(block[going]).tolist():
            mine = np.flatnonzero(going & (block == b))
            rows = slice(cuts[b], cuts[b] + BLOCK)
            score = products(q[mine], v[rows])
            mask = (ids[rows][None, :] != q_ids[mine][:, None]) & (score >= kth[mine][:, None])
            some = mask.any(axis=1)
            mine, score, mask = mine[some], score[some], mask[some]
            for i, s, m in zip(mine.tolist(), score, mask):
                at = np.flatnonzero(m)
                n = int(filled[i])
                scores = np.concatenate([best[i, :n], s[at]])
                names = np.concatenate([best_id[i, :n], ids[rows][at]])
                keep = np.lexsort((names, ~scores))[:k]  # ~ reverses whole numbers without overflow
                filled[i] = n = len(keep)
                best[i, :n], best_id[i, :n] = scores[keep], names[keep]
                if n == k:
                    kth[i] = max(kth[i], scores[keep[-1]])
    who, at = np.nonzero(np.arange(k)[None, :] < filled[:, None])
    return who, best_id[who, at], best[who, at]


def search(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "vector") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of ``vectors`` for every row of ``queries`` (both: id, array of long).

    Candidates are all rows but those of the query's own id."""
    tidy = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<long>").alias("vector")).where(
        "id is not null and vector is not null").distinct()
    rows, asked = cut_lineage(tidy(vectors), "vectors"), cut_lineage(tidy(queries), "queries")
    n, m = rows.count(), asked.count()
    shards = packed(rows.withColumn("theta", F.lit(0).cast("long")), "shard", SHARD, n).drop("thetas")
    names = [c for c in shards.columns if c != "shard"]
    shards = shards.select("shard", *(F.col(c).alias(f"s_{c}") for c in names))
    numbers = shards.select("shard")

    def meet(chunks: DataFrame, of: DataFrame, reach: DataFrame) -> DataFrame:
        """Every chunk with every shard of ``reach``, by an equi-join on the shard's number."""
        lists = reach.agg(F.collect_list("shard").alias("all"))  # one number for every SHARD rows
        wide = chunks.join(F.broadcast(lists)).withColumn("shard", F.explode("all")).drop("all")
        return wide.join(of, "shard").mapInArrow(score, "query_id long, asked long, vec_id long, score long")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                one = {c: b.column(c)[i] for c in b.schema.names}
                q_ids, theta = (np.frombuffer(one[c].as_buffer(), np.int64) for c in ("ids", "thetas"))
                ids = np.frombuffer(one["s_ids"].as_buffer(), np.int64)
                q = np.frombuffer(one["vectors"].as_buffer(), np.int64).reshape(one["n"].as_py(), one["dims"].as_py())
                v = np.frombuffer(one["s_vectors"].as_buffer(), np.int64).reshape(one["s_n"].as_py(), one["s_dims"].as_py())
                d = min(q.shape[1], v.shape[1])
                who, found, scores = best_of_shard(q_ids, q[:, :d], theta, ids, v[:, :d], k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(q_ids[who]), pa.array(one["chunk"].as_py() * CHUNK + who), pa.array(found), pa.array(scores)],
                    names=["query_id", "asked", "vec_id", "score"])

    def ranked(found: DataFrame) -> DataFrame:
        w = Window.partitionBy("query_id", "asked").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    first = packed(asked.withColumn("theta", F.lit(LOWEST)), "chunk", CHUNK, m)
    seeds = numbers.where(F.pmod(F.xxhash64("shard"), F.lit(SEED_SHARE)) == 0)
    bounds = ranked(meet(first, shards, seeds)).where(F.col("rank") == k).select("query_id", "asked", "score")
    lists = bounds.groupBy(F.floor(F.col("asked") / CHUNK).alias("chunk")).agg(
        F.collect_list(F.struct(F.pmod("asked", F.lit(CHUNK)).alias("at"), "score")).alias("bounds"))  # CHUNK at most
    again = cut_lineage(first.join(lists, "chunk", "left"), "bounded").mapInArrow(
        put_bounds, "chunk long, n long, dims long, ids binary, vectors binary, thetas binary")
    return ranked(meet(again, shards, numbers)).select("query_id", "rank", "vec_id", "score")


def put_bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed queries with the bounds that the first pass has found."""
    for b in batches:
        thetas = []
        for n, found in zip(b.column("n").to_pylist(), b.column("bounds").to_pylist()):
            theta = np.full(n, LOWEST, np.int64)
            for x in found or ():
                theta[x["at"]] = x["score"]
            thetas.append(theta.tobytes())
        names = ["chunk", "n", "dims", "ids", "vectors"]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(thetas, pa.binary())], names=[*names, "thetas"])
