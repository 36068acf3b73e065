"""N-gram Jaccard join with prefix trees, and the groups its links form.

Every document becomes the set of its distinct word n-grams (64-bit hashes). Equal sets are one class. A global
order puts n-grams that a fixed-size count sketch finds repeated last, all others by hash; the sketch counts those that
stand in two documents of the ``REPEAT_GRAMS`` n-grams that a task holds at a time. Two sets with Jaccard similarity at or above the threshold share one of the first
``n - ceil(threshold * n) + 1`` n-grams of either, so only sets that share one are compared. Of n-grams that
are shared by the very same sets, the first in the global order stands for all.

Parity bits of the sets rule out most pairs that share an n-gram by chance before any set is moved.
Comparison is by trie: the sets to be compared with one probe are stored, in the global order, in a compressed
trie; the probe walks it once, sharing the overlap of common beginnings, and leaves a subtree as soon
as its longest set cannot reach the needed overlap with the n-grams that remain.

Groups need connectivity, not all pairs. First every n-gram's sets are compared with the smallest of
them (a star). Then, for n-grams whose sets still lie in different components, each set outside the
n-gram's largest component is compared with all sets of other components. No link between components is left
out; pairs inside one component are not enumerated, so a group of n near copies costs about n comparisons.

Defined results: null and empty texts have no n-grams, link with nothing and are their own group; a
text with fewer words than n is one n-gram; rows that share a doc_id are one document; a null doc_id has
group null and links with nothing. Columns other than doc_id and text are ignored; an empty table gives an empty result. Two different
n-grams with the same 64-bit hash would count as one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticejobs.llm.common import discard, leaves_nothing, release_memory, slices, stored, texts
from noticejobs.llm.shingles import shingle_sets

#: Counters of the frequency sketch: 4 MB, whatever the corpus.
SKETCH, SKETCH_CHUNK = 1 << 20, 1 << 14
#: N-grams among which a task looks for repeated ones at a time: 16 MB.
REPEAT_GRAMS = 1 << 21
#: Ids that are broadcast at most: 8 MB of longs.
BROADCAST_IDS = 1 << 20
#: Sets compared with a probe in one trie.
TRIE_SETS = 256


def in_order(s: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """A sorted set in the global order: by rank of frequency, then by hash."""
    return s[np.argsort(rank[(s & np.uint64(SKETCH - 1)).astype(np.int64)], kind="stable")]


def frequency_ranks(docs: DataFrame, n: int) -> np.ndarray:
    """A rank for each counter of the sketch: 0 unless its n-grams were repeated clearly more often than most."""

    @leaves_nothing
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH, np.int64)
        held: list[np.ndarray] = []

        def repeated() -> np.ndarray:
            grams = np.sort(np.concatenate(held)) if held else np.zeros(0, np.uint64)
            same = grams[1:] == grams[:-1]
            again = np.zeros(len(grams), bool)
            again[1:] |= same
            again[:-1] |= same
            held.clear()
            return np.bincount((grams[again] & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH)

        for batch in batches:
            for _, rows in slices(batch):
                held += shingle_sets(rows, n)
                if sum(map(len, held)) >= REPEAT_GRAMS:
                    total += repeated()
        yield from rows_of(total + repeated(), TaskContext.get().partitionId() % 256)

    def rows_of(total: np.ndarray, part: int) -> Iterator[pa.RecordBatch]:
        parts = total.astype("<i8").reshape(-1, SKETCH_CHUNK)
        yield pa.RecordBatch.from_pydict({"chunk": pa.array(range(len(parts)), pa.int32()), "part": pa.array([part] * len(parts), pa.int32()), "counts": pa.array([p.tobytes() for p in parts], pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x.as_buffer(), "<i8") for x in table["counts"]], axis=0)
        return pa.table({"chunk": pa.array([table["chunk"][0].as_py()], pa.int32()), "part": pa.array([table["part"][0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    schema = "chunk int, part int, counts binary"
    parts = texts(docs).mapInArrow(count, schema).groupBy("chunk", "part").applyInArrow(add, schema)
    got = parts.groupBy("chunk").applyInArrow(add, schema).toArrow().sort_by("chunk")  # 8 MB, whatever the corpus
    counts = np.concatenate([np.frombuffer(x.as_buffer(), "<i8") for x in got["counts"]]) if len(got) else np.zeros(SKETCH, np.int64)
    del got
    # Repeated n-grams that are many and rare fill all counters alike; what stands clearly above that noise is frequent.
    usual = float(np.median(counts))
    noise = 4 * math.sqrt(usual) + 1
    ranks = np.empty(len(counts), np.uint8)  # part by part, as the driver holds only so much
    for i in range(0, len(counts), SKETCH_CHUNK):
        ranks[i : i + SKETCH_CHUNK] = np.clip(np.ceil(2 * np.log2(np.maximum((counts[i : i + SKETCH_CHUNK] - usual) / noise, 1))), 0, 255)
    return ranks


def parity_bits(s: np.ndarray) -> bytes:
    """A bit for each of about n / 2 slots: whether an odd number of the set's n-grams fall in it."""
    slots = max(64, 1 << max(0, len(s) // 2 - 1).bit_length())
    return np.packbits((np.bincount((s >> np.uint64(40)).astype(np.int64) & (slots - 1), minlength=slots) & 1).astype(np.uint8), bitorder="little").tobytes()


#: A fixed number of parity bits, for a condition inside a join.
PARITY_BITS = 512


def parity_words(s: np.ndarray) -> np.ndarray:
    """``PARITY_BITS`` parity bits of a set as longs; what ``parity_bits`` says of differences holds for them too."""
    bits = np.bincount((s >> np.uint64(48)).astype(np.int64) & (PARITY_BITS - 1), minlength=PARITY_BITS) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64)


def plausible(pairs: DataFrame, bits: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that the parity bits cannot rule out.

    Every n-gram that only one of two sets holds flips one bit, so the bits that differ are at most the
    n-grams that differ; more of them than the similarity allows rule a pair out for certain.
    """
    left = bits.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("bits").alias("ba"))
    right = bits.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bb"))
    both = pairs.join(left, "a").join(right, "b").filter(F.least("na", "nb") * den >= F.greatest("na", "nb") * num)

    @leaves_nothing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for n, a, b in zip((batch.column(2).to_numpy() + batch.column(4).to_numpy()).tolist(), batch.column(3), batch.column(5), strict=True):
                x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                while len(x) != len(y):  # the longer is folded: its slots are those of the shorter, twice over
                    x, y = (x, y) if len(x) > len(y) else (y, x)
                    x = x[: len(x) // 2] ^ x[len(x) // 2 :]
                keep.append(int(np.bitwise_count(x ^ y).sum()) <= n - 2 * -(-num * n // (num + den)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "na", "ba", "nb", "bb").mapInArrow(run, "a long, b long")


class Trie:
    """Compressed trie of ordered sets; node = [children by first n-gram, keys that end here, longest size below]."""

    def __init__(self):
        self.root: list = [{}, [], 0]

    def add(self, key, s: np.ndarray) -> None:
        node, at = self.root, 0
        node[2] = max(node[2], len(s))
        while at < len(s):
            first = int(s[at])
            held = node[0].get(first)
            if held is None:
                node[0][first] = (s[at:], [{}, [key], len(s)])
                return
            edge, below = held
            width = min(len(edge), len(s) - at)
            differ = np.flatnonzero(edge[:width] != s[at : at + width])
            same = int(differ[0]) if len(differ) else width
            if same < len(edge):  # the edge splits
                middle = [{int(edge[same]): (edge[same:], below)}, [], below[2]]
                node[0][first] = (edge[:same], middle)
                below = middle
            below[2] = max(below[2], len(s))
            node, at = below, at + same
        node[1].append(key)

    def search(self, probe: np.ndarray, num: int, den: int) -> Iterator:
        """Keys of the sets with ``den * overlap >= num * union``; all keys of one size and depth end together."""
        sorted_probe = np.sort(probe)
        p = len(probe)

        def need(size: int) -> int:
            return -(-num * (size + p) // (num + den))

        stack = [(self.root, 0, 0)]
        while stack:
            node, depth, overlap = stack.pop()
            if node[1] and overlap >= need(depth):
                yield from node[1]
            for edge, below in node[0].values():
                got, at, longest = overlap, 0, below[2]
                while at < len(edge):
                    part = edge[at : at + 64]
                    where = np.searchsorted(sorted_probe, part)
                    where[where == p] = 0
                    got += int((sorted_probe[where] == part).sum())
                    at += len(part)
                    if got + longest - depth - at < need(longest):
                        break  # too many misses for even the longest set below
                else:
                    stack.append((below, depth + len(edge), got))


def linked(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity; the sets of one a's partners share tries."""
    crowded = pairs.groupBy("a").count().filter(F.col("count") > TRIE_SETS).select("a", F.ceil(F.col("count") / TRIE_SETS).cast("int").alias("blocks"))
    dealt = pairs.join(crowded, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("blocks", F.lit(1))).cast("int").alias("salt"))
    members = dealt.join(sets.withColumnRenamed("node", "b"), "b").select("a", "salt", F.lit(1).alias("role"), F.col("b").alias("node"), "grams")
    probes = dealt.select("a", "salt").distinct().join(sets.withColumnRenamed("node", "a"), "a").select("a", "salt", F.lit(0).alias("role"), F.col("a").alias("node"), "grams")
    runs = probes.unionByName(members).repartition("a", "salt").sortWithinPartitions("a", "salt", "role")

    @leaves_nothing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, probe, trie = None, [], Trie()

        def answer() -> set:
            return {(current[0], b) for p in probe for b in trie.search(p, num, den)}

        for batch in batches:
            found = set()
            a, salt, role, node, grams = (batch.column(k) for k in range(5))
            for k, key in enumerate(zip(a.to_pylist(), salt.to_pylist(), strict=True)):
                if key != current:
                    if current:
                        found |= answer()
                    current, probe, trie = key, [], Trie()
                s = np.frombuffer(grams[k].as_buffer(), "<u8")
                if role[k].as_py():
                    trie.add(node[k].as_py(), s)
                else:
                    probe.append(s)
            yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([x for _, x in found], pa.int64())})
        found = answer() if current else set()
        yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([x for _, x in found], pa.int64())})

    return runs.mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): smallest node reachable, for every node of the undirected edges (a, b), by alternating stars."""
    now = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.withColumnRenamed("m", "v"))
        before, now = now, stored(small.filter("u <> v").distinct())
        discard(before)
        new = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if new == mark:
            break
        mark = new
    out = now.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    out.stored_in = now.stored_in
    return out


def jaccard_groups(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id: groups of documents linked by ``den * intersection >= num * union``."""
    spark = docs.sparkSession
    rank = spark.sparkContext.broadcast(frequency_ranks(docs, n))  # 1 MB, whatever the corpus
    release_memory()  # of the driver: the sketch is free by now, and the joins that follow are what fills its other memory

    @leaves_nothing
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, rows in slices(batch):
                sets = shingle_sets(rows, n)
                prefix = [in_order(s, rank.value)[: len(s) - -(-num * len(s) // den) + 1].view(np.int64) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(ids, pa.int64()), "n": pa.array([len(s) for s in sets], pa.int64()),
                    "class": pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    "prefix": pa.array(prefix, pa.list_(pa.int64())),
                    "bits": pa.array([parity_bits(s) for s in sets], pa.binary()),
                    "words": pa.array([parity_words(s) for s in sets], pa.list_(pa.int64())),
                })

    @leaves_nothing
    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, rows in slices(batch):
                yield pa.RecordBatch.from_pydict({"node": pa.array(ids, pa.int64()), "grams": pa.array([in_order(s, rank.value).astype("<u8").tobytes() for s in shingle_sets(rows, n)], pa.binary())})

    described = stored(texts(docs).mapInArrow(describe, "doc_id long, n long, class binary, prefix array<long>, bits binary, words array<long>"))
    present = described.filter("class is not null and doc_id is not null")
    classes = stored(present.groupBy("class").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("bits").alias("bits"), F.first("words").alias("words")))
    ids = stored(described.select("doc_id", "n", "class"))
    discard(described)

    index = classes.select("node", "n", F.posexplode("prefix").alias("pos", "gram"))
    # The sets of an n-gram, as two sums of hashes; of n-grams with the same sets the first in the global order is kept.
    sharing = index.groupBy("gram").agg(F.count("*").alias("c"), F.min("node").alias("least"), F.min("pos").alias("pos"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")).filter("c > 1")
    shared = sharing.groupBy("c", "least", "x", "y").agg(F.min_by("gram", "pos").alias("gram")).select("gram")
    index = stored(index.join(shared, "gram", "left_semi"))

    def sets_of(pairs: DataFrame) -> DataFrame:
        nodes = stored(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        ids = F.broadcast(nodes) if nodes.count() <= BROADCAST_IDS else nodes  # else texts and ids are joined by a shuffle
        wanted = texts(docs).join(ids, F.col("doc_id") == F.col("node"), "left_semi")
        sets = stored(wanted.mapInArrow(grams, "node long, grams binary"))
        discard(nodes)
        return sets

    def checked(pairs: DataFrame) -> DataFrame:
        """The pairs whose sets reach the similarity; ``pairs`` is discarded."""
        sets = sets_of(pairs)
        edges = stored(linked(pairs, sets, num, den))
        discard(pairs, sets)
        return edges

    # Stars: every set of an n-gram and size band against the smallest node of both.
    banded = index.withColumn("band", F.floor(F.log("n") / math.log(den / num)))
    leader = banded.groupBy("gram", "band").agg(F.min("node").alias("a"), F.count("*").alias("c")).filter("c > 1")
    stars = stored(banded.join(leader, ["gram", "band"]).filter("node <> a").select("a", F.col("node").alias("b")).distinct())
    near_stars = stored(plausible(stars, classes, num, den))
    edges = checked(near_stars)
    groups = components(edges)
    discard(edges)

    # What stars left open: sets of one n-gram in different components.
    placed = stored(index.join(groups, "node", "left").withColumn("comp", F.coalesce("comp", "node")))
    sizes = placed.groupBy("gram", "comp").agg(F.count("*").alias("c"))
    open_ = sizes.groupBy("gram").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.count("*").alias("k")).filter("k > 1").select("gram", "main")
    # Sizes of similar sets lie in one band or in two next to each other, so a set stays only if these hold another component.
    band = F.floor(F.log("n") / (math.log(den / num) * 1.000001))
    lying = placed.select("gram", "comp", F.explode(F.array(band - 1, band, band + 1)).alias("band")).groupBy("gram", "band").agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
    near_bands = lying.filter("low <> high").select("gram", "band")
    rest = placed.withColumn("band", band).join(near_bands, ["gram", "band"], "left_semi").join(open_, "gram").join(classes.select("node", *[F.get("words", F.lit(k)).alias(f"p{k}") for k in range(PARITY_BITS // 64)]), "node")
    l, r = rest.filter("comp <> main").alias("l"), rest.alias("r")
    reach = F.least(F.col("l.n") - F.col("l.pos"), F.col("r.n") - F.col("r.pos"))  # overlap from this n-gram on, if it is the first shared
    near = (F.col("l.gram") == F.col("r.gram")) & (F.col("l.comp") != F.col("r.comp")) & (den * F.least("l.n", "r.n") >= num * F.greatest("l.n", "r.n")) & (reach * (num + den) >= num * (F.col("l.n") + F.col("r.n")))
    # Bits that differ are at most the n-grams that differ, and those are bounded by the similarity.
    differ = sum((F.bit_count(F.col(f"l.p{k}").bitwiseXOR(F.col(f"r.p{k}"))) for k in range(PARITY_BITS // 64)), F.lit(0))
    near &= differ <= F.col("l.n") + F.col("r.n") - 2 * F.ceil(num * (F.col("l.n") + F.col("r.n")) / (num + den))
    crossing = l.join(r, near & ((F.col("r.comp") == F.col("r.main")) | (F.col("l.node") < F.col("r.node")))).select(F.least("l.node", "r.node").alias("a"), F.greatest("l.node", "r.node").alias("b")).distinct()
    crossing = stored(plausible(crossing.join(stars, ["a", "b"], "left_anti"), classes, num, den))
    discard(stars, placed, index)
    if not crossing.isEmpty():
        more = checked(crossing)
        if not more.isEmpty():
            stars_only, groups = groups, components(groups.select(F.col("node").alias("a"), F.col("comp").alias("b")).unionByName(more))
            discard(stars_only)
        discard(more)
    else:
        discard(crossing)
    rank.unpersist()

    moved = stored(classes.select("class", "node", "copies").join(groups, "node", "left").filter("copies > 1 or comp is not null").select("class", F.coalesce("comp", "node").alias("comp")))
    discard(classes, groups)
    # A class with very many copies is a hot key of this join; adaptive execution splits it, as the other side has one row a class.
    return ids.join(moved, "class", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id")).alias("component_id"))
