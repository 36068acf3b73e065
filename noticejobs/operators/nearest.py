"""Best partners of stated queries among all rows: by shared words, by cosine, and by cosine within probed cells.

Queries are broadcast in batches of a checked size and meet the rows where these lie; a task keeps its best k for each
query, so only these are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticejobs.sources.shared import discard, materialized

#: Bytes of queries broadcast at a time, queries that are scored at a time, and words or numbers of rows that meet them.
BATCH_BYTES, BLOCK_QUERIES, CHUNK_ITEMS = 16 << 20, 256, 1 << 15
#: Bytes of queries with words that are broadcast at a time, queries and rows whose products are found at once, and tasks for each core.
ASKED_BYTES, ASKED_AT_ONCE, ROWS_AT_ONCE, TASKS_PER_CORE = 128 << 20, 512, 2048, 2
#: Share of pairs that have a word, from which on it meets as a matrix, and such words at most.
DENSE_FROM, DENSE_WORDS = 0.002, 512
#: Vectors that cells are fitted on at most, rounds of fitting, and vectors of a stored block.
SAMPLE_VECTORS, ROUNDS, BLOCK_VECTORS = 20_000, 12, 2048


def top_k(df: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("rank") <= k)


class Best:
    """The k rows with the highest scores for each of n queries, equal scores by the smaller id."""

    def __init__(self, n: int, k: int):
        self.k, self.score, self.id = k, np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        """``score`` is queries x rows; -inf leaves a pair out."""
        near = (score >= self.score[:, -1:]) & (score > -np.inf)
        some = np.flatnonzero(near.any(axis=0))
        if not len(some):
            return
        scores = np.concatenate([self.score, score[:, some]], axis=1)
        names = np.concatenate([self.id, np.broadcast_to(ids[some], (len(score), len(some)))], axis=1)
        order = np.lexsort((names, -scores))[:, : self.k]
        self.score, self.id = np.take_along_axis(scores, order, 1), np.take_along_axis(names, order, 1)

    def add_block(self, who: np.ndarray, asked: np.ndarray, held: np.ndarray, ids: np.ndarray) -> None:
        """A block of vectors for the queries numbered ``who``, by cosine; so many queries at a time that memory has a bound."""
        for j in range(0, len(who), BLOCK_QUERIES):
            few = who[j : j + BLOCK_QUERIES]
            some = Best(0, self.k)
            some.score, some.id = self.score[few], self.id[few]
            some.add(np.round(asked[few] @ held.T, 9), ids)
            self.score[few], self.id[few] = some.score, some.id

    def merge(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Pairs of a query's number and a row."""
        if not len(query):
            return
        some = np.unique(query)
        who = np.concatenate([np.repeat(some, self.k), query])
        scores, names = np.concatenate([self.score[some].reshape(-1), score]), np.concatenate([self.id[some].reshape(-1), ids])
        order = np.lexsort((names, -scores, who))
        first = np.searchsorted(who[order], some)
        kept = order[(first[:, None] + np.arange(self.k)).reshape(-1)]
        self.score[some], self.id[some] = scores[kept].reshape(-1, self.k), names[kept].reshape(-1, self.k)

    def rows(self, queries: np.ndarray) -> pa.RecordBatch:
        held = self.score > -np.inf
        return pa.RecordBatch.from_pydict({"a": pa.array(np.broadcast_to(queries[:, None], held.shape)[held], pa.int64()), "b": pa.array(self.id[held], pa.int64()), "score": pa.array(self.score[held], pa.float64())})


def in_batches(queries: DataFrame, size: Column, answer: Callable[[object], DataFrame], batch_bytes: int) -> DataFrame:
    """Union of ``answer`` (to a broadcast Arrow table) over the batches of ``queries`` (id, ...)."""
    asked = materialized(queries)
    n = max(1, -(-(asked.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]) // batch_bytes))
    out = None
    for k in range(n):
        batch = asked if n == 1 else asked.filter(F.pmod(F.xxhash64("id"), F.lit(n)) == k)
        found = answer(asked.sparkSession.sparkContext.broadcast(batch.toArrow()))  # batch_bytes on average
        found = found if n == 1 else materialized(found)
        out = found if out is None else out.unionByName(found)
    discard(asked)
    return out


class Held:
    """Rows with what they hold of a vocabulary: (row, code) in order, each once, with its number in the row; and the sizes of the rows."""

    def __init__(self, words: pa.ListArray, vocabulary: pa.Array):
        self.sizes, self.width = np.diff(words.offsets.to_numpy()), max(1, len(vocabulary))
        code = pc.fill_null(pc.index_in(words.flatten(), vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        known = np.flatnonzero(code >= 0)
        self.keys, self.counts = np.unique(np.repeat(np.arange(len(self.sizes)), self.sizes)[known] * self.width + code[known], return_counts=True)

    def block(self, first: int, last: int, values: np.ndarray) -> RowBlock:
        at = slice(*np.searchsorted(self.keys, (first * self.width, last * self.width)))
        return RowBlock(self.keys[at] - first * self.width, values[at], self.sizes[first:last], self.width)


class RowBlock:
    """Some rows, their words also in order of code."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, sizes: np.ndarray, width: int):
        self.keys, self.values, self.sizes, self.width = keys, values, sizes, width
        row, code = np.divmod(keys, width)
        self.frequency = np.bincount(code, minlength=width)
        self.ends = np.append(0, np.cumsum(self.frequency))
        order = np.argsort(code, kind="stable")
        self.row, self.code, self.value = row[order], code[order], values[order].astype(np.float32)

    def spread(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words that so many queries and rows have (``asked`` is the share of queries) that a product of matrices is faster: their columns by code
        (-1: none) and the matrix of columns x rows."""
        gain = asked * self.frequency
        common = np.flatnonzero(gain >= DENSE_FROM * len(self.sizes))
        common = np.sort(common[np.argsort(-gain[common], kind="stable")[:DENSE_WORDS]])
        column = np.full(self.width, -1, np.int64)
        column[common] = np.arange(len(common))
        held = np.zeros((len(common), len(self.sizes)), np.float32)
        mine = np.flatnonzero(column[self.code] >= 0)
        held[column[self.code[mine]], self.row[mine]] = self.value[mine]
        return column, held


class Asked:
    """A block of queries with weighted words, and their best k rows so far."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, starts: np.ndarray, codes: np.ndarray, weights: np.ndarray, k: int):
        self.ids, self.sizes, self.starts, self.codes, self.weights = ids, sizes, starts, codes, weights
        self.lengths = np.diff(np.append(starts, len(codes)))
        self.query = np.repeat(np.arange(len(ids)), self.lengths)
        self.best = Best(len(ids), k)

    def products(self, block: RowBlock, column: np.ndarray, held: np.ndarray) -> np.ndarray:
        """Sums of weight times value over the words that a query and a row share, queries x rows, in single precision."""
        at = column[self.codes]
        common = np.flatnonzero(at >= 0)
        asked = np.zeros((len(self.ids), len(held)), np.float32)
        asked[self.query[common], at[common]] = self.weights[common]
        out = asked @ held
        rest = np.flatnonzero((at < 0) & (block.frequency[self.codes] > 0))
        n = block.frequency[self.codes[rest]]
        place = np.repeat(block.ends[self.codes[rest]] - np.cumsum(n) + n, n) + np.arange(n.sum())
        cell = np.repeat(self.query[rest] * len(block.sizes), n) + block.row[place]
        np.add.at(out.reshape(-1), cell, np.repeat(self.weights[rest].astype(np.float32), n) * block.value[place])
        return out

    def exact(self, block: RowBlock, query: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Products of pairs in double precision."""
        n = self.lengths[query]
        entry = np.repeat(self.starts[query] - np.cumsum(n) + n, n) + np.arange(n.sum())
        keys = np.repeat(row * block.width, n) + self.codes[entry]
        place = np.minimum(np.searchsorted(block.keys, keys), len(block.keys) - 1)
        parts = np.where(block.keys[place] == keys, self.weights[entry] * block.values[place], 0.0)
        return np.bincount(np.repeat(np.arange(len(query)), n), parts, len(query))

    def meet(self, block: RowBlock, column: np.ndarray, held: np.ndarray, ids: np.ndarray, score: Scores) -> None:
        """Only pairs whose product may still lift them among the best k are looked at one by one."""
        found = self.products(block, column, held)
        if score.others:
            for r in np.flatnonzero(np.isin(ids, self.ids)):
                found[self.ids == ids[r], r] = 0
        k = self.best.k
        off = (self.lengths[:, None] + 8) * 2.0**-22  # how far a sum in single precision may be off, of itself
        least = score.least(self.best.score[:, -1:], self.sizes[:, None], block.sizes[None, :])
        near = found >= np.maximum(least * (1 - off) - 1e-9, 1e-30).astype(np.float32)
        many = np.flatnonzero(near.sum(axis=1) > k)
        if len(many) and found.shape[1] > k:
            value = score.score(found[many].astype(float), self.sizes[many, None], block.sizes[None, :])
            kth = np.maximum(np.partition(value, -k, axis=1)[:, -k, None], 0)
            near[many] &= value >= kth * (1 - 4 * off[many]) - score.step
        query, row = np.nonzero(near)
        if len(query):
            order = np.argsort(row, kind="stable")  # the words of a row lie together
            query, row = query[order], row[order]
            product = found[query, row].astype(float) if score.whole else self.exact(block, query, row)
            value, last = score.score(product, self.sizes[query], block.sizes[row]), self.best.score[query, -1]
            took = (value > last) | ((value == last) & (value > -np.inf) & (ids[row] < self.best.id[query, -1]))
            self.best.merge(query[took], value[took], ids[row[took]])


@dataclass
class Scores:
    """How a score comes from the product of a query and a row and from their sizes; the score grows with the product."""

    #: Scores by products and sizes; -inf leaves a pair out.
    score: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]
    #: The least product that may reach a score.
    least: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]
    #: Whether products are exact in single precision (few small numbers), and the step to which scores are rounded.
    whole: bool = True
    step: float = 0.0
    #: Whether a row of the query's own id is left out.
    others: bool = True
    #: Value of a word by how often it stands in a row and by the row's size.
    value: Callable[[np.ndarray, np.ndarray], np.ndarray] = lambda counts, sizes: np.ones(len(counts))


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` over all cores; a number of tasks that does not grow with them, as each sends its best k for every query."""
    return rows.repartition(TASKS_PER_CORE * rows.sparkSession.sparkContext.defaultParallelism, key)


def asked_blocks(table: pa.Table, k: int) -> tuple[pa.Array, np.ndarray, list[Asked]]:
    """Vocabulary of the queries (id, words, weights), the share of queries that have each word, and their blocks."""
    words = table["words"].combine_chunks()
    flat, sizes = words.flatten(), np.diff(words.offsets.to_numpy())
    vocabulary = pc.unique(flat)
    codes = pc.index_in(flat, vocabulary).to_numpy(zero_copy_only=False).astype(np.int64)
    weights = table["weights"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float)
    ids, ends, blocks = table["id"].to_numpy(), np.append(0, np.cumsum(sizes)), []
    for i in range(0, len(ids), ASKED_AT_ONCE):
        j = min(i + ASKED_AT_ONCE, len(ids))
        at = slice(ends[i], ends[j])
        blocks.append(Asked(ids[i:j], sizes[i:j], ends[i:j] - ends[i], codes[at], weights[at], k))
    return vocabulary, np.bincount(codes, minlength=max(1, len(vocabulary))) / max(1, len(ids)), blocks


def best_partners(rows: DataFrame, queries: DataFrame, score: Scores, k: int, batch_bytes: int = ASKED_BYTES) -> DataFrame:
    """(a, rank, b, score): the best k rows for each query, equal scores by id.

    ``rows`` are (id, words) and ``queries`` (id, words, weights), their words distinct. Words that many queries and rows have meet as matrices, all others by
    postings of a block of rows; sums are made in single precision with a bound on their error, and what may be among
    the best is summed again in double precision.
    """

    def answer(shared) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            vocabulary, share, blocks = asked_blocks(shared.value, k)
            for batch in batches:
                held, ids = Held(batch.column(1), vocabulary), batch.column(0).to_numpy()
                values = score.value(held.counts, held.sizes[held.keys // held.width])
                for first in range(0, len(ids), ROWS_AT_ONCE):
                    last = min(first + ROWS_AT_ONCE, len(ids))
                    block = held.block(first, last, values)
                    if len(block.keys):
                        spread = block.spread(share)
                        for asked in blocks:
                            asked.meet(block, *spread, ids[first:last], score)
            for asked in blocks:
                yield asked.best.rows(asked.ids)

        return rows.filter("id is not null").select("id", "words").mapInArrow(run, "a long, b long, score double")

    found = in_batches(queries.filter("id is not null").select("id", "words", "weights"), F.lit(64) + F.size("words") * 24, answer, batch_bytes)
    return top_k(found, "a", [F.desc("score"), F.col("b")], k)


def matrix(lists: pa.ListArray | pa.ChunkedArray) -> np.ndarray:
    """Vectors as rows of unit length; a vector of zeros stays one."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    m = lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(lists), -1)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def vector_topk(queries: DataFrame, chunks: DataFrame, k: int, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Best k chunks of every query by cosine, rounded to nine decimals, then chunk_id. Rows without a vector take no part."""

    def answer(shared) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids = shared.value["id"].to_numpy()
            if not len(ids):
                return
            asked = matrix(shared.value["vector"])
            best = [Best(len(asked[i : i + BLOCK_QUERIES]), k) for i in range(0, len(asked), BLOCK_QUERIES)]
            for batch in batches:
                step = max(1, CHUNK_ITEMS // asked.shape[1])
                for i in range(0, batch.num_rows, step):
                    part = batch.slice(i, step)
                    held = matrix(part.column(1))
                    for j, b in enumerate(best):
                        b.add(np.round(asked[j * BLOCK_QUERIES : (j + 1) * BLOCK_QUERIES] @ held.T, 9), part.column(0).to_numpy())
            for j, b in enumerate(best):
                yield b.rows(ids[j * BLOCK_QUERIES : (j + 1) * BLOCK_QUERIES])

        return chunks.filter("vector is not null").select(F.col("chunk_id").cast("long"), "vector").mapInArrow(run, "a long, b long, score double")

    found = in_batches(queries.filter("vector is not null").select(F.col("query_id").cast("long").alias("id"), "vector"), F.lit(16) + 8 * F.size("vector"), answer, batch_bytes)
    return top_k(found, "a", [F.desc("score"), F.col("b")], k).select(F.col("a").alias("query_id"), "rank", F.col("b").alias("chunk_id"), F.round("score", 4).alias("score"))


@dataclass
class Cells:
    #: (cell, ids, vectors): all vectors, in blocks of one cell.
    blocks: DataFrame
    #: Centres of the cells, by number.
    centres: np.ndarray


def nearest_cells(vectors: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """Numbers of the n centres with the largest cosine, nearest first."""
    return np.argsort(-(vectors @ centres.T), axis=1, kind="stable")[:, :n]


def fit_cells(chunks: DataFrame, cells: int, sample: int = SAMPLE_VECTORS) -> np.ndarray:
    """Centres by spherical k-means over at most ``sample`` vectors, those with the smallest hash of their id."""
    rows = chunks.filter("vector is not null").orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(sample).select("vector").toArrow()
    x = matrix(rows["vector"])
    centres = x[np.random.default_rng(0).permutation(len(x))[:cells]]
    for _ in range(ROUNDS):
        near = nearest_cells(x, centres, 1)[:, 0]
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        filled = np.linalg.norm(sums, axis=1) > 1e-9
        centres[filled] = sums[filled] / np.linalg.norm(sums[filled], axis=1, keepdims=True)
    return centres


def build_cells(chunks: DataFrame, cells: int) -> Cells:
    """Every vector in the blocks of its cell; a cell of many vectors has many blocks."""
    centres = fit_cells(chunks, cells)
    shared = chunks.sparkSession.sparkContext.broadcast(centres)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest_cells(matrix(batch.column(1)), shared.value, 1)[:, 0].astype(np.int32))], names=["chunk_id", "vector", "cell"])

    placed = chunks.filter("vector is not null").select(F.col("chunk_id").cast("long").alias("chunk_id"), F.col("vector").cast("array<float>").alias("vector")).mapInArrow(place, "chunk_id long, vector array<float>, cell int")
    placed = materialized(placed)
    sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK_VECTORS).cast("int").alias("n"))  # a row a cell
    dealt = placed.join(F.broadcast(sizes), "cell").groupBy("cell", F.pmod(F.xxhash64("chunk_id"), F.col("n")).alias("salt")).agg(F.collect_list(F.struct("chunk_id", "vector")).alias("x"))
    blocks = materialized(dealt.select("cell", F.col("x.chunk_id").alias("ids"), F.flatten("x.vector").alias("vectors")))
    discard(placed)
    return Cells(blocks, centres)


def probe_cells(index: Cells, queries: DataFrame, k: int, probes: int, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """As vector_topk, within the ``probes`` cells nearest to each query."""
    centres = index.centres

    def answer(shared) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids = shared.value["id"].to_numpy()
            if not len(ids):
                return
            asked = matrix(shared.value["vector"])
            probed = np.zeros((len(asked), len(centres)), bool)
            np.put_along_axis(probed, nearest_cells(asked, centres, probes), True, 1)
            best = Best(len(ids), k)
            for batch in batches:
                for i in range(batch.num_rows):
                    who = np.flatnonzero(probed[:, batch.column(0)[i].as_py()])
                    if len(who):
                        names = batch.column(1)[i].values.to_numpy()
                        held = batch.column(2)[i].values.to_numpy().astype(float).reshape(len(names), -1)
                        held /= np.maximum(np.linalg.norm(held, axis=1, keepdims=True), 1e-12)
                        best.add_block(who, asked, held, names)
            yield best.rows(ids)

        return index.blocks.mapInArrow(run, "a long, b long, score double")

    found = in_batches(queries.filter("vector is not null").select(F.col("query_id").cast("long").alias("id"), "vector"), F.lit(16) + 8 * F.size("vector"), answer, batch_bytes)
    return top_k(found, "a", [F.desc("score"), F.col("b")], k).select(F.col("a").alias("query_id"), "rank", F.col("b").alias("chunk_id"), F.round("score", 4).alias("score"))
