"""Document fingerprints by MinHash, and near duplicates found through bands of them.

A text becomes the set of its five-word shingles (64-bit hashes). For each of ``PERMUTATIONS`` maps ``x -> a x + b`` modulo 2^64
with odd ``a`` (bijections drawn from a universal family) the least value over the set is kept, as 16 bits of a mix of it;
numpy applies a map to all shingles of many texts at once. The share of equal values of two fingerprints
estimates the Jaccard similarity of the texts.

Near duplicates: ``BANDS`` bands of ``ROWS`` values each are join keys. Texts with one set of shingles are one class. In each
bucket of equal bands the classes are compared with the one of the smallest id; then, where a bucket still holds several components,
the classes outside its largest component are compared with all classes of other components. Parity bits rule out
pairs that cannot be near, before any set is moved; all other pairs are decided by the exact Jaccard similarity of their sets. A pair
at similarity 0.8 shares no band with a probability of 0.002.

A document and the next one stand side by side after a range partitioning by (doc_id, hash of the text): the first row of each range, found
from ids and hashes alone, is also sent to the range before it. Texts travel compressed. Near duplicates need fingerprints only, so these are
computed where the texts lie.

Defined results: null and empty texts, and texts without words, have the empty set; its fingerprint equals itself alone, so two
of them have likeness 1, and it has no near duplicates; a text with fewer than five words is one shingle; rows that share a doc_id stand in the order
of their text's hash, equal rows follow each other, and null ids come first; in the near-duplicate classes rows that share a doc_id are one
node, each with the class of its own text, and a null id has class null; other columns are ignored; an empty table gives an empty result; a table of one row has itself as next.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticejobs.llm import trie_join
from noticejobs.llm.common import SLICE_BYTES, discard, slices, stored, texts
from noticejobs.llm.shingles import shingle_sets, shingles

BANDS, ROWS = 16, 5
PERMUTATIONS = BANDS * ROWS
SHINGLE, SEED = 5, 20
#: Shingles that one step works on: what it touches stays in the processor's cache.
STEP_SHINGLES = 1 << 15


def maps() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    a, b = rng.integers(0, 1 << 64, (2, PERMUTATIONS), np.uint64)
    return a | np.uint64(1), b


_A, _B = maps()
_MIX = np.uint64(0x9E3779B97F4A7C15)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of ``PERMUTATIONS`` 16-bit values for each set; all bits set for an empty one."""
    out = np.full((len(sets), PERMUTATIONS), 0xFFFF, np.uint16)
    filled = [k for k, s in enumerate(sets) if len(s)]
    sizes = np.array([len(sets[k]) for k in filled], np.int64)
    first = 0
    while first < len(filled):
        last, total = first + 1, int(sizes[first])
        while last < len(filled) and total + sizes[last] <= STEP_SHINGLES:
            total += int(sizes[last])
            last += 1
        x = np.concatenate([sets[k] for k in filled[first:last]])
        starts = np.cumsum(sizes[first:last]) - sizes[first:last]
        least = np.empty((PERMUTATIONS, last - first), np.uint64)
        room = np.empty_like(x)
        for j in range(PERMUTATIONS):
            np.multiply(x, _A[j], out=room)
            room += _B[j]
            np.minimum.reduceat(room, starts, out=least[j])
        least ^= least >> np.uint64(32)
        out[filled[first:last]] = ((least * _MIX) >> np.uint64(48)).T
        first = last
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal values, row by row."""
    return (a == b).mean(axis=1) if len(a) else np.zeros(0)


def hex_of(signature: np.ndarray) -> list[str]:
    return [row.astype(">u2").tobytes().hex() for row in signature]


def class_of(s: np.ndarray) -> bytes | None:
    """Hash of a whole set."""
    return xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None


def edited(text: str, following: str) -> str:
    """``text`` with its second half replaced by as much of the beginning of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


#: Characters of a range on average.
RANGE_CHARS = 4 << 20
ROUTED = pa.schema([("part", pa.int32()), ("guest", pa.bool_()), ("known", pa.bool_()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("packed", pa.binary()), ("class_id", pa.int64())])


def range_heads(rows: DataFrame) -> list[tuple]:
    """First (doc_id is known, doc_id, text_hash) of each range; one row a range reaches the driver."""
    total = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    ranged = rows.select("known", "doc_id", "text_hash").repartitionByRange(max(1, -(-total // RANGE_CHARS)), "known", "doc_id", "text_hash")
    heads = ranged.groupBy(F.spark_partition_id()).agg(F.min(F.struct("known", "doc_id", "text_hash")).alias("head")).select("head.*")
    return sorted(map(tuple, heads.collect()))


def beside_next(docs: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """(guest, doc_id, text_hash, packed, class_id), range by range: the rows in order, each behind its row of ``classes`` (doc_id, text_hash,
    class_id), which has no text; and at the end, as a guest, the row that comes next."""
    known = F.col("doc_id").isNotNull()
    rows = texts(docs).select(known.alias("known"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    heads = range_heads(rows)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row in its range, and the first row of a range in the range before it too."""
        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            out: list[tuple] = []
            text = batch.column(3).cast(pa.binary())
            for k, (*key, class_id) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 1, 2, 4)), strict=True)):
                row = tuple(key)
                part = bisect_right(heads, row) - 1
                packed = packer.compress(text[k].as_py()) if text[k].is_valid else None
                out.append((part, False, *row, packed, class_id))
                if heads[part] == row and packed is not None:
                    out.append(((part - 1) % len(heads), True, *row, packed, None))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * 7, ROUTED)], schema=ROUTED)

    both = rows.select("known", "doc_id", "text_hash", "text", F.lit(None).cast("long").alias("class_id"))
    if classes is not None:
        both = both.unionByName(classes.select(F.lit(True).alias("known"), "doc_id", "text_hash", F.lit(None).cast("string").alias("text"), "class_id"))
    dealt = both.mapInArrow(route, "part int, guest boolean, known boolean, doc_id long, text_hash long, packed binary, class_id long")
    dealt = dealt.repartition(max(1, len(heads)), "part").sortWithinPartitions("part", "guest", "known", "doc_id", "text_hash", F.col("packed").isNotNull())
    return dealt.select("guest", F.when(F.col("known"), F.col("doc_id")).alias("doc_id"), "text_hash", "packed", "class_id")


STAMPED = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
    ("n_shingles", pa.int64()), ("class_id", pa.int64()),
])
STAMPED_DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_shingles long, class_id long"


def fingerprints(docs: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next and n_shingles of every document, and
    class_id: that of ``classes``, else its own id."""

    def stamp(held: list[tuple]) -> pa.RecordBatch:
        guests, ids, near, rows = zip(*held, strict=True)
        own = [k for k in range(len(rows) - 1) if not guests[k]]
        changed = [edited(rows[k], rows[k + 1]) for k in own]
        sets = shingle_sets(list(rows), SHINGLE)
        whole, cut = signatures(sets), signatures(shingles(changed, SHINGLE))
        mine = whole[own]
        return pa.RecordBatch.from_arrays([
            pa.array([ids[k] for k in own], pa.int64()), pa.array([len(rows[k]) for k in own], pa.int64()), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in changed], pa.string()),
            pa.array(hex_of(mine), pa.string()), pa.array(hex_of(cut), pa.string()), pa.array(likeness(mine, cut)), pa.array(likeness(mine, whole[[k + 1 for k in own]])),
            pa.array([len(sets[k]) for k in own], pa.int64()), pa.array([ids[k] if near[k] is None else near[k] for k in own], pa.int64()),
        ], schema=STAMPED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()
        held, size, moved = [], 0, (None, None, None)
        for batch in batches:
            for guest, doc_id, text_hash, packed, class_id in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if packed is None:
                    moved = (doc_id, text_hash, class_id)
                    continue
                text = unpacker.decompress(packed).decode()
                held.append((guest, doc_id, moved[2] if moved[:2] == (doc_id, text_hash) else None, text))
                size += len(text)
                if size >= SLICE_BYTES and len(held) > 1:
                    yield stamp(held)
                    held, size = held[-1:], len(text)  # the last row waits for the one after it
        if len(held) > 1:
            yield stamp(held)

    return beside_next(docs, classes).mapInArrow(run, STAMPED_DDL)


def bands_of(signature: np.ndarray) -> np.ndarray:
    """Join keys: a 64-bit hash of each band and its number."""
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX, (len(signature), BANDS)).copy()
    values = signature.reshape(len(signature), BANDS, ROWS).astype(np.uint64)
    for j in range(ROWS):
        keys = (keys ^ values[:, :, j]) * _MIX
        keys ^= keys >> np.uint64(32)
    return keys.view(np.int64)


@F.pandas_udf(T.ArrayType(T.LongType()))
def band_keys(signature: pd.Series) -> pd.Series:
    return pd.Series(list(bands_of(np.array([np.frombuffer(x, np.uint16) for x in signature]).reshape(-1, PERMUTATIONS))))


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n, class, signature and parity bits of the documents with shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, done = batch.column(2), 0
            for ids, rows in slices(batch):
                sets = shingle_sets(rows, SHINGLE)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(ids, pa.int64()), "text_hash": hashes.slice(done, len(ids)), "n": pa.array([len(s) for s in sets], pa.int64()), "class": pa.array([class_of(s) for s in sets], pa.binary()),
                    "signature": pa.array([x.tobytes() for x in signatures(sets)], pa.binary()), "bits": pa.array([trie_join.parity_bits(s) for s in sets], pa.binary()), "words": pa.array([trie_join.parity_words(s) for s in sets], pa.list_(pa.int64())),
                })
                done += len(ids)

    rows = texts(docs).filter("doc_id is not null and text is not null").withColumn("text_hash", F.xxhash64("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, n long, class binary, signature binary, bits binary, words array<long>").filter("class is not null")


def checked_broadcast(table: DataFrame) -> DataFrame:
    """A stored table, to be broadcast if it is small enough."""
    return F.broadcast(table) if table.count() <= trie_join.BROADCAST_IDS else table


def near_classes(docs: DataFrame, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, text_hash, class_id) of the rows that are a copy of or near to another one, and not their class' first document:
    the smallest doc_id that links reach."""
    rows = stored(signed(docs))
    classes = stored(rows.groupBy("class").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("n", "signature", "bits", "words")]))
    ids = stored(rows.select("doc_id", "text_hash", "class"))
    discard(rows)
    buckets = stored(classes.select("node", F.explode(band_keys("signature")).alias("band")))
    leaders = stored(buckets.groupBy("band").agg(F.min("node").alias("a"), F.count("*").alias("c")).filter("c > 1").select("band", "a"))
    index = stored(buckets.join(checked_broadcast(leaders), "band"))  # only bands that two classes share
    discard(buckets, leaders)

    def checked(pairs: DataFrame) -> DataFrame:
        """The pairs that are near, by their whole sets."""
        likely = stored(trie_join.plausible(pairs, classes, num, den))
        sets = sets_of(docs, likely)
        near = stored(trie_join.linked(likely, sets, num, den))
        discard(likely, sets)
        return near

    stars = stored(index.filter("node <> a").select("a", F.col("node").alias("b")).distinct())
    near = checked(stars)
    groups = trie_join.components(near)
    placed = stored(index.select("band", "node").join(groups, "node", "left").withColumn("comp", F.coalesce("comp", "node")))
    sizes = placed.groupBy("band", "comp").agg(F.count("*").alias("c"))
    open_ = stored(sizes.groupBy("band").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.count("*").alias("k")).filter("k > 1").select("band", "main"))
    parity = [F.get("words", F.lit(k)).alias(f"p{k}") for k in range(trie_join.PARITY_BITS // 64)]
    rest = placed.join(checked_broadcast(open_), "band").join(classes.select("node", "n", *parity), "node")
    l, r = rest.filter("comp <> main").alias("l"), rest.alias("r")
    apart = (F.col("l.band") == F.col("r.band")) & (F.col("l.comp") != F.col("r.comp")) & ((F.col("r.comp") == F.col("r.main")) | (F.col("l.node") < F.col("r.node"))) & (F.least("l.n", "r.n") * den >= F.greatest("l.n", "r.n") * num)
    differ = sum((F.bit_count(F.col(f"l.p{k}").bitwiseXOR(F.col(f"r.p{k}"))) for k in range(len(parity))), F.lit(0))
    apart &= differ <= F.col("l.n") + F.col("r.n") - 2 * F.ceil(num * (F.col("l.n") + F.col("r.n")) / (num + den))
    crossing = l.join(r, apart).select(F.least("l.node", "r.node").alias("a"), F.greatest("l.node", "r.node").alias("b")).distinct()
    crossing = stored(crossing.join(stars, ["a", "b"], "left_anti"))
    if not crossing.isEmpty():
        more = checked(crossing)
        stars_only, groups = groups, trie_join.components(groups.select(F.col("node").alias("a"), F.col("comp").alias("b")).unionByName(more))
        discard(stars_only, more)
    moved = stored(classes.select("class", "node", "copies").join(groups, "node", "left").filter("copies > 1 or comp is not null").select("class", F.coalesce("comp", "node").alias("class_id")))
    discard(classes, index, stars, near, groups, placed, open_, crossing)
    out = stored(ids.join(checked_broadcast(moved), "class").filter("doc_id <> class_id").select("doc_id", "text_hash", "class_id").distinct())
    discard(ids, moved)
    return out


def sets_of(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node, grams) of the documents in ``pairs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, rows in slices(batch):
                yield pa.RecordBatch.from_pydict({"node": pa.array(ids, pa.int64()), "grams": pa.array([s.astype("<u8").tobytes() for s in shingle_sets(rows, SHINGLE)], pa.binary())})

    nodes = stored(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    ids = F.broadcast(nodes) if nodes.count() <= trie_join.BROADCAST_IDS else nodes  # else texts and ids are joined by a shuffle
    sets = stored(texts(docs).join(ids, F.col("doc_id") == F.col("node"), "left_semi").mapInArrow(run, "node long, grams binary"))
    discard(nodes)
    return sets


def near_duplicates(docs: DataFrame, num: int = 80, den: int = 100) -> DataFrame:
    """fingerprints(docs) with class_id: the smallest doc_id among the near duplicates that links reach, its own without any."""
    return fingerprints(docs, near_classes(docs, num, den))
