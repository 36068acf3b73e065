"""Exact top-k vector search by distributed histogram selection.

Every round scores all pairs block by block as integer matrix products and keeps only counts: how
many candidates of a query fall in each of ``BINS`` equal score ranges. The range that holds a
query's k-th best score is found from the summed counts and becomes the next round's whole range,
until it is one integer wide. A last pass emits the candidates above the k-th score and, at the
k-th score itself, the smallest ids; ``row_number`` settles the ranks.

A block's histogram is cut below its own k-th best range: the global k-th score cannot lie there, as
the block alone holds k better ones. So a block sends at most k rows a query and round, whatever
ties or copies it holds.

Vectors become ``floor(256 * x)``. Vectors that are null, empty or hold null or non-finite parts take no
part, nor do rows without an id; vectors of other lengths than the query's are no candidates of it. Scores must fit 64 bits.
A query id repeated asks once, with its smallest vector; a candidate row repeated counts each time.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noticejobs.llm.common import arrow_rows, stored

BINS = 1024
#: Rows of a candidate block and queries of a query block.
BLOCK_ROWS, BLOCK_QUERIES = 8192, 1024
#: Query blocks are broadcast in batches up to this size, one batch after the other; candidate blocks are never moved.
BROADCAST_BYTES = 32 << 20


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, dim, v): integer vectors of the rows that take part."""
    bad = F.exists("x", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0)).filter(~bad)
    return rows.select("vec_id", F.size("x").alias("dim"), F.transform("x", lambda e: F.floor(e * 256)).cast("array<long>").alias("v"))


def candidate_blocks(rows: DataFrame) -> DataFrame:
    """Rows packed, partition by partition, into (dim, n, ids, matrix) of at most BLOCK_ROWS rows."""
    schema = pa.schema([("dim", pa.int32()), ("n", pa.int32()), ("ids", pa.binary()), ("matrix", pa.binary())])

    def pack(dim: int, held: list) -> pa.RecordBatch:
        ids, m = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
        return pa.RecordBatch.from_pydict({"dim": [dim], "n": [len(ids)], "ids": [ids.astype("<i8").tobytes()], "matrix": [m.astype("<i8").tobytes()]}, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[int, list] = {}
        for batch in batches:
            ids, dims = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            flat, ends = batch.column(2).flatten().to_numpy(zero_copy_only=False), np.cumsum(dims)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                m = flat[(ends[at] - dim)[:, None] + np.arange(dim)]
                for k in range(0, len(at), BLOCK_ROWS):
                    held = open_.setdefault(int(dim), [])
                    held.append((ids[at[k : k + BLOCK_ROWS]], m[k : k + BLOCK_ROWS]))
                    if sum(len(x[0]) for x in held) >= BLOCK_ROWS:
                        yield pack(int(dim), open_.pop(int(dim)))
        for dim, held in open_.items():
            yield pack(dim, held)

    return rows.mapInArrow(run, "dim int, n int, ids binary, matrix binary")


def top_k(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of ``vectors`` for every row of ``queries``, its own id excepted."""
    blocks = stored(candidate_blocks(usable(vectors, id_col, vector_col)))
    asked = usable(queries, id_col, vector_col).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v"))
    asked = stored(asked.withColumn("dim", F.size("v")))
    n_queries, most = asked.agg(F.count("*"), F.max("dim")).first()
    n_blocks = max(1, -(-n_queries // BLOCK_QUERIES))
    n_batches = min(n_blocks, max(1, -(-n_queries * (most or 0) * 8 // BROADCAST_BYTES)))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)).cast("int"))

    def scored(limits: DataFrame, emit, schema: str) -> DataFrame:
        """Apply ``emit`` to each pair of a candidate block and a query block of the same dimension."""
        with_limits = asked.join(limits, "query_id")
        qblocks = with_limits.groupBy("dim", "block").agg(F.collect_list(F.struct("query_id", "v", "low", "width")).alias("q"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k_row in range(batch.num_rows):
                    row = {name: batch.column(name)[k_row] for name in ("n", "dim", "ids", "matrix", "q")}
                    dim, n = row["dim"].as_py(), row["n"].as_py()
                    ids = np.frombuffer(row["ids"].as_buffer(), "<i8")
                    m = np.frombuffer(row["matrix"].as_buffer(), "<i8").reshape(n, dim)
                    q = row["q"].values
                    qid, low, width = (q.field(x).to_numpy(zero_copy_only=False) for x in ("query_id", "low", "width"))
                    qv = q.field("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                    # float64 products of integers are exact up to 2**53; beyond that, integers multiply
                    exact = float(np.abs(m).max(initial=0)) * float(np.abs(qv).max(initial=0)) * dim < 2**53
                    left = m.T.astype(np.float64) if exact else m.T
                    for j in range(0, len(qid), 64):
                        part = slice(j, j + 64)
                        s = (qv[part].astype(np.float64) @ left).astype(np.int64) if exact else qv[part] @ left
                        yield from emit(qid[part], low[part], width[part], ids, s)

        def batch(k: int) -> DataFrame:
            asked_now = F.broadcast(qblocks if n_batches == 1 else qblocks.filter(F.col("block") % n_batches == k))
            return blocks.join(asked_now, "dim").select("dim", "n", "ids", "matrix", "q").mapInArrow(run, schema)

        return batch(0) if n_batches == 1 else reduce(DataFrame.unionByName, [stored(batch(k)) for k in range(n_batches)])

    counted = pa.schema([("query_id", pa.int64()), ("bin", pa.int64()), ("c", pa.int64())])

    def histogram(qid, low, width, ids, s) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[], [], []]
        for q, lo, w, row in zip(qid, low, width, s, strict=True):
            b = np.minimum((row[ids != q] - lo) // w, BINS)  # BINS: better than this round's range
            b = b[b >= 0]
            if len(b) > k:
                b = b[b >= np.partition(b, len(b) - k)[len(b) - k]]
            bins, n = np.unique(b, return_counts=True)
            out[0] += [q] * len(bins)
            out[1] += bins.tolist()
            out[2] += n.tolist()
        yield arrow_rows(counted, out)

    ranked = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def survivors(qid, low, width, ids, s) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[], [], []]
        for q, lo, row in zip(qid, low, s, strict=True):
            at = np.flatnonzero((row >= lo) & (ids != q))
            at = at[np.lexsort((ids[at], -row[at]))][:k]  # a block's k best in the final order
            out[0] += [q] * len(at)
            out[1] += ids[at].tolist()
            out[2] += row[at].tolist()
        yield arrow_rows(ranked, out)

    # First range: |score| <= |q| * max |x|, from the data; one pass over the blocks' norms.
    longest = usable(vectors, id_col, vector_col).agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e))).first()[0] or 0.0
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e)) * F.lit(float(np.sqrt(longest)))
    reach = F.ceil(norm).cast("long") + 1
    limits = asked.select("query_id", (-reach).alias("low"), F.ceil((2 * reach + 1) / BINS).cast("long").alias("width"))
    # A round narrows the range BINS times; how many are needed follows from the widest one.
    widest = limits.agg(F.max("width")).first()[0] or 1
    best_first = Window.partitionBy("query_id").orderBy(F.desc("bin"))
    while True:
        bins = scored(limits, histogram, "query_id long, bin long, c long").groupBy("query_id", "bin").agg(F.sum("c").alias("c"))
        running = bins.withColumn("above", F.sum("c").over(best_first))
        kth = running.filter(F.col("above") >= k).groupBy("query_id").agg(F.max("bin").alias("bin"))
        # Fewer than k candidates: everything from the range's lower end on is returned.
        found = limits.join(kth, "query_id", "left")
        narrowed = found.select("query_id", (F.col("low") + F.coalesce("bin", F.lit(0)) * F.col("width")).alias("low"), F.when(F.col("bin").isNull(), 1).otherwise(F.ceil(F.col("width") / BINS)).cast("long").alias("width"), "bin")
        limits = stored(narrowed.select("query_id", "low", "width"))
        if widest == 1:
            break
        widest = -(-widest // BINS)
    rows = scored(limits, survivors, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
