"""Periodic runs of words: maximal stretches that repeat themselves with some period.

A document is coded as numbers, one for each different word, and cut into overlapping tiles: for periods of one octave
(2^k to 2^(k+1) - 1) a tile is a few times 2^k words long and overlaps the next one by three times 2^k, so that every stretch shows in some tile;
short periods share tiles of ``TILE_WORDS``. Tiles of long documents are dealt out over the cluster and each is solved by
itself. In it boundaries stand every 2^(k-1) words. A stretch of matching words (equal to the word one period later)
covers a boundary and the block of 2^(k-1) words after it, so only periods at which the block's hash comes again are looked
at. For those, Z-functions of the boundary (forwards, and backwards over the reversed words, within a window that widens as far as they
match) say how far words match on either side. Hashes only choose where to look; matches are those of the words themselves.

A tile gives fragments (document, period, first and last matching word). Fragments are shuffled by document and period and
stitched where they touch; what is long enough is a run. A stretch whose first period of words is itself a repetition belongs to a smaller
period (theorem of Fine and Wilf) and is left out in the tile, so a text of one repeated word sends one fragment and not one for
each multiple of the period.

Work is in proportion to ``n log n`` for n words; the tiles of the largest octaves hold the whole document.

Defined results: null and empty texts have no words and no runs; rows that share a doc_id are judged each by their own text,
equal rows alike; a null doc_id is an id as any other; columns other than doc_id and text are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticejobs.llm.common import texts

#: Shortest run.
MIN_WORDS = 12
#: Words between the starts of tiles of the periods below ``1 << (LOW_OCTAVES)``.
TILE_WORDS, LOW_OCTAVES = 4096, 10
#: Words that a task works on at a time.
BATCH_WORDS = 1 << 19
#: Characters from which on the tiles of a text are dealt out over the cluster.
LONG_TEXT = 1 << 16
#: Elements of one comparison of blocks.
CHUNK = 1 << 21
TILE = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("at", pa.int64()), ("low", pa.int32()), ("high", pa.int32()), ("last", pa.bool_()), ("codes", pa.list_(pa.int32()))])
TILE_DDL = "doc_id long, text_hash long, at long, low int, high int, last boolean, codes array<int>"
FRAGMENT = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("period", pa.int64()), ("first", pa.int64()), ("end", pa.int64())])
FRAGMENT_DDL = "doc_id long, text_hash long, period long, first long, end long"
KEY = ("doc_id", "text_hash")


def overlap(octave: int) -> int:
    return (3 << octave) + 16


def tiles(n: int) -> Iterator[tuple[int, int, int, int]]:
    """(start, end, lowest, highest octave) of the tiles of a document of n words."""
    top = (n // 2).bit_length() - 1
    low, core, high = 0, TILE_WORDS, LOW_OCTAVES - 1
    while low <= top and n >= MIN_WORDS:
        if n <= core + overlap(high):  # one tile holds the whole document
            yield 0, n, low, top
            return
        for at in range(0, n, core):
            end = min(n, at + core + overlap(high))
            yield at, end, low, high
            if end == n:
                break
        low = high = high + 1
        core = 4 << high


def tiles_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tiles of (doc_id, text_hash, text) rows, in batches of about ``BATCH_WORDS`` words."""
    rows: list[tuple] = []
    size = 0

    def out() -> pa.RecordBatch:
        columns = list(zip(*[r[:6] for r in rows], strict=True))
        offsets = np.zeros(len(rows) + 1, np.int32)
        np.cumsum([len(r[6]) for r in rows], out=offsets[1:])
        codes = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([r[6] for r in rows])))
        return pa.RecordBatch.from_arrays([*(pa.array(c, f.type) for c, f in zip(columns, TILE)), codes], schema=TILE)

    for batch in batches:
        ids, hashes, column = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary())
        for k in range(len(ids)):
            text = column[k].as_py()
            words = text.split() if text else []  # bytes split at the ASCII blanks
            if len(words) < MIN_WORDS:
                continue
            known: dict[bytes, int] = {}
            codes = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words))
            if len(known) == len(words):  # no word comes twice
                continue
            for at, end, low, high in tiles(len(words)):
                rows.append((ids[k], hashes[k], at, low, high, end == len(words), codes[at:end]))
                size += end - at
                if size >= BATCH_WORDS:
                    yield out()
                    rows, size = [], 0
    if rows:
        yield out()


def z_function(s: list[int], upto: int) -> list[int]:
    """z[i], for i below ``upto``: how many items s[i:] begins with that s begins with too."""
    n = len(s)
    z = [0] * min(n, upto)
    left = right = 0
    for i in range(1, len(z)):
        k = min(right - i, z[i - left]) if i < right else 0
        if i + k >= right:
            while i + k < n and s[k] == s[i + k]:
                k += 1
            left, right = i, i + k
        z[i] = k
    return z


def prime_factors(n: int) -> Iterator[int]:
    p = 2
    while p * p <= n:
        if n % p == 0:
            yield p
            while n % p == 0:
                n //= p
        p += 1
    if n > 1:
        yield n


class Boundary:
    """How far the words of a tile match those one period later, around one place, within so many words on either side."""

    def __init__(self, words: list[int], c: int, longest: int, width: int = 0):
        self.width = max(width, 4 * (longest + 1))
        low, high = max(0, c - self.width), min(len(words), c + self.width)
        self.more_before, self.more_after = low > 0, high < len(words)
        words, c = words[low:high], c - low
        self.forward = z_function(words[c:], longest + 1)
        before = words[:c][::-1]
        self.reach = min(len(words), c + longest)  # where the reversed words begin
        self.c, self.skip, self.size = c, len(before) + 1, len(words)
        self.backward = z_function([*before, -1, *words[: self.reach][::-1]], self.skip + longest + 1)

    def matches(self, period: int) -> tuple[int, int]:
        """(matching words before the boundary, from it on)."""
        back = self.skip + self.reach - self.c - period
        return self.backward[back] if period + self.c <= self.reach else 0, self.forward[period] if period < len(self.forward) else 0

    def short(self, period: int) -> bool:
        """Whether the words match as far as this boundary looks, and there are more."""
        before, after = self.matches(period)
        return (self.more_before and before == self.c) or (self.more_after and self.c + period + after == self.size)

    def repeats(self, period: int) -> bool:
        """Whether the period of words that begins at the boundary is itself a repetition."""
        return any(self.forward[period // p] >= period - period // p for p in prime_factors(period))


def block_hashes(codes: np.ndarray, tile: np.ndarray, pad: int) -> Iterator[np.ndarray]:
    """Hashes of the blocks of 4, 8, 16, ... words that begin at each word; blocks of different tiles differ."""
    h = np.zeros(len(codes) + pad, np.uint64)
    h[: len(codes)] = codes.astype(np.uint64) + (tile.astype(np.uint64) << np.uint64(32))
    h *= np.uint64(0x9E3779B97F4A7C15)
    width, factor = 1, 0xD6E8FEB86659FD93
    while True:
        h[:-width] = h[:-width] * np.uint64(factor) + h[width:]
        h ^= h >> np.uint64(31)
        factor = (factor * 0x2545F4914F6CDD1D) % (1 << 64) | 1
        width *= 2
        if width >= 4:
            yield h


def chains(h: np.ndarray, starts: np.ndarray, sizes: np.ndarray, octave: int, step: int, block: int) -> tuple[np.ndarray, ...]:
    """(tile, boundary, period) at which the block of a boundary comes again, first boundaries of unbroken rows of them only."""
    shortest = 1 << octave
    counts = np.maximum((sizes - shortest - block) // step + 1, 0)
    tile = np.repeat(np.arange(len(starts)), counts)
    places = starts[tile] + step * (np.arange(len(tile)) - np.repeat(np.cumsum(counts) - counts, counts))
    views = np.lib.stride_tricks.sliding_window_view(h, shortest)
    at, period, rows = [], [], max(1, CHUNK // shortest)
    for k in range(0, len(places), rows):
        part = places[k : k + rows]
        r, c = np.nonzero(views[part + shortest] == h[part][:, None])
        at.append(r + k)
        period.append(c + shortest)
    at, period = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (at, period))
    of, place = tile[at], places[at] - starts[tile[at]]
    inside = place + period + block <= sizes[of]
    of, place, period = of[inside], place[inside], period[inside]
    order = np.lexsort((place, period, of))
    of, place, period = of[order], place[order], period[order]
    goes_on = np.zeros(len(of), bool)
    goes_on[1:] = (of[1:] == of[:-1]) & (period[1:] == period[:-1]) & (place[1:] == place[:-1] + step)
    heads = np.flatnonzero(~goes_on)
    lasts = np.append(heads[1:], len(of))[: len(heads)] - 1
    again = np.lexsort((period[heads], place[heads], of[heads]))
    return tuple(x[again] for x in (of[heads], place[heads], period[heads], place[lasts]))


def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fragments of each tile: the matching words of a primitive period that are long enough, or that an end of the tile cuts."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, hashes, at, low, high, last = (batch.column(k).to_pylist() for k in range(6))
        lists = batch.column(6)
        codes = lists.flatten().to_numpy(zero_copy_only=False)
        sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        lowest, highest = np.array(low), np.array(high)
        found: list[tuple] = []
        hashed = block_hashes(codes, np.repeat(np.arange(len(sizes)), sizes), 4 << int(highest.max()))
        h = next(hashed)
        for octave in range(int(highest.max()) + 1):
            step, block = (2 if octave == 2 else 4, 4) if octave < 4 else (1 << octave - 1, 1 << octave - 1)
            if octave > 3:
                h = next(hashed)
            chosen = np.flatnonzero((lowest <= octave) & (highest >= octave))
            if not len(chosen):
                continue
            held, boundary, words, done = (-1, -1), None, [], {}
            for t, c, q, end in zip(*(x.tolist() for x in chains(h, starts[chosen], sizes[chosen], octave, step, block)), strict=True):
                t = int(chosen[t])
                if t != held[0]:
                    words, done = codes[starts[t] : starts[t] + sizes[t]].tolist(), {}
                while c <= end:
                    if c < done.get(q, 0):
                        c += -(-(done[q] - c) // step) * step
                        continue
                    if held != (t, c):
                        held, boundary = (t, c), Boundary(words, c, (2 << octave) - 1)
                    while boundary.short(q):
                        boundary = Boundary(words, c, (2 << octave) - 1, 4 * boundary.width)
                    before, after = boundary.matches(q)
                    if after and not boundary.repeats(q):
                        first, stop = c - before, c + after
                        cut = (first == 0 and at[t] > 0) or (stop + q == len(words) and not last[t])
                        if cut or stop - first + q >= max(MIN_WORDS, 2 * q):
                            found.append((ids[t], hashes[t], q, at[t] + first, at[t] + stop))
                    done[q] = max(c + after, done.get(q, 0))
                    c += step
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), FRAGMENT)], schema=FRAGMENT)


def keyed(docs: DataFrame) -> DataFrame:
    return texts(docs).select("doc_id", F.xxhash64("text").alias("text_hash"), "text")


def fragments(docs: DataFrame, long_text: int = LONG_TEXT) -> DataFrame:
    """Fragments of all documents; tiles of long ones are dealt out by document, place and octave."""
    rows = keyed(docs).filter("text is not null")
    short = rows.filter(F.length("text") <= long_text).mapInArrow(lambda batches: solve(tiles_of(batches)), FRAGMENT_DDL)
    dealt = rows.filter(F.length("text") > long_text).mapInArrow(tiles_of, TILE_DDL).repartition(*KEY, "at", "low")
    return short.unionByName(dealt.mapInArrow(solve, FRAGMENT_DDL))


def stitched(parts: DataFrame) -> DataFrame:
    """(doc_id, text_hash, start, length, period): fragments that touch are one run."""
    order = Window.partitionBy(*KEY, "period").orderBy("first", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce(F.col("first") > F.col("reach"), F.lit(True)).cast("long")
    pieces = parts.distinct().withColumn("reach", reach).withColumn("piece", F.sum(opens).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = pieces.groupBy(*KEY, "period", "piece").agg(F.min("first").alias("start"), F.max("end").alias("end"))
    length = F.col("end") - F.col("start") + F.col("period")
    return whole.select(*KEY, "start", length.alias("length"), "period").filter(F.col("length") >= F.greatest(F.lit(MIN_WORDS), 2 * F.col("period")))


def find_runs(docs: DataFrame) -> DataFrame:
    """doc_id, text, runs: array of (start, length, period) by start, then period."""
    runs = stitched(fragments(docs)).groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("found"))
    runs = runs.select(F.col("doc_id").alias("run_id"), F.col("text_hash").alias("run_hash"), "found")
    rows = keyed(docs)
    rows = rows.join(runs, rows["doc_id"].eqNullSafe(runs["run_id"]) & (rows["text_hash"] == runs["run_hash"]), "left")
    ordered = F.transform("found", lambda r: F.struct(r["start"].alias("start"), r["length"].alias("length"), r["period"].alias("period")))
    return rows.select("doc_id", "text", F.coalesce(ordered, F.array().cast("array<struct<start:bigint,length:bigint,period:bigint>>")).alias("runs"))


def collapse(found: DataFrame) -> DataFrame:
    """``found`` of find_runs with ``collapsed`` in place of the text: its words but for those behind the first period of a run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, runs = batch.column(1).cast(pa.binary()), batch.column(2)
            kept = []
            for k in range(batch.num_rows):
                text = column[k].as_py()
                words = text.split() if text else []
                spans = runs[k].as_py()
                if spans:
                    stay = np.ones(len(words), bool)
                    for r in spans:
                        stay[r["start"] + r["period"] : r["start"] + r["length"]] = False
                    words = [w for w, s in zip(words, stay.tolist(), strict=True) if s]
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary()).cast(pa.string()), runs], names=["doc_id", "collapsed", "runs"])

    return found.mapInArrow(run, "doc_id long, collapsed string, runs array<struct<start:bigint,length:bigint,period:bigint>>")


def with_planted_repeats(docs: DataFrame) -> DataFrame:
    """Every tenth document (by crc32 of its id) with its tail made periodic: from a word on, the next words repeat to the end."""
    blanks = r"[\x20\x09-\x0D]+"
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, F.filter(F.split("text", blanks), lambda w: w != "")).alias("words"))
    g, n = F.floor(F.col("h") / 10), F.size("words")
    a = F.when(n > 0, g % n).cast("int")
    rows = rows.select("doc_id", "text", "words", g.alias("g"), a.alias("a"), (n - a).alias("left"))
    rows = rows.withColumn("p", (1 + F.floor(F.col("left") / (3 + F.col("g") % 8))).cast("int"))
    unit = F.slice("words", F.col("a") + 1, F.col("p"))
    tail: Column = F.slice(F.flatten(F.array_repeat(unit, F.ceil(F.col("left") / F.col("p")).cast("int"))), F.lit(1), F.col("left"))
    edited = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), tail), " ")
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), edited).otherwise(F.col("text")).alias("text"))
