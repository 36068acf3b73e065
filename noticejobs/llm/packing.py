"""Lexical retrieval packing of documents into fixed token windows.

Texts become token ids once. A document's full windows are sequences of their own; its remainder is written, and the
document frequency of every term (a token id) and the mean length are taken over the remainders of the whole
corpus. Each remainder is then placed by content: its key is its heaviest terms by BM25 weight, of those that
another remainder holds too, and the remainders are dealt by ranges of that key. So copies and texts about the same
rare terms meet wherever they lie in the table, at every size of it. A run of equal keys longer than a task's share
is divided by doc_id, so no common key outgrows a task.

Each shard (about ``SHARD_TOKENS`` tokens in key order) is an inverted index with the corpus-wide BM25 weights, used
window by window: the longest unused remainder is the seed, the index returns its unused neighbours by score, and they
fill the window greedily, whole while they fit; the best of those that do not fit is cut to fill what is
left, and the rest of it stays in the pool. Only the last window of a shard can be short; it is cut into
sequences whose lengths are powers of two, which need no padding.

Ids of one piece are contiguous ids of its document; every id lies in exactly one piece.
``sequence_id`` is the partition's number times 2**33 plus a count, and 2**60 more for sequences of remainders, so it
does not depend on retries.

Defined results: a null or empty text has the end id alone; equal scores go to the earlier document of the
shard (by key, then doc_id); repeated rows are packed each; a null doc_id stays null; a text of any length is cut into whole
windows first; columns other than doc_id and text are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from array import array
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticejobs.llm.common import arrow_rows, leaves_nothing, slices, stored, texts

WINDOW = 2048
#: Tokens of a shard, shards of a task, and terms of the key by which remainders are dealt.
SHARD_TOKENS, TASK_SHARDS, KEY_TERMS = 1_500_000, 4, 3
#: Pieces of text whose ids a worker remembers (beyond this it starts afresh), and bytes of text that it works on at a time.
CACHE_PIECES, SLICE = 600_000, 2 << 20
K1, B = 1.2, 0.75
#: Neighbours of a seed that are sorted before the others, and the share of a shard above which a term's weights are a row.
BEST, DENSE = 64, 0.12
OUT = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"))])
REMAINDERS = pa.schema([("doc_id", pa.int64()), ("doc_tokens", pa.int64()), ("start", pa.int64()), ("rest", pa.binary())])
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class WordIds:
    """Token ids of whole texts, with those of each blank-separated piece remembered.

    The tokenizer drops white space, so a text's ids are those of its pieces in order. Pieces of plain
    characters are split here and given to the tokenizer's model word by word; all others, and those that may hold the
    string of a special token, go to the tokenizer itself.
    """

    PLAIN = re.compile("[\\n\\t\\x21-\\x7e\\u00a1-\\u0233]*")
    WORDS = regex.compile(r"\x00|'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}\x00]+")

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {}  # byte -> the character that stands for it
        for c in map(chr, [*range(0x80), *range(0xA0, 0x800), 0x1000, 0x2000, 0x4000, 0x8000, 0xF000, *range(0x10000, 0x10FFFF, 0x3F0F)]):
            shown = byte_level.pre_tokenize_str(c)[0][0]
            self.letters.update(zip(c.encode(), shown, strict=True))
        self.end_id = end_id
        self.forget()

    def forget(self) -> None:
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, int] = {}  # a piece's number; number 0 is the end id
        self.pool, self.begin, self.count = np.array([self.end_id], np.uint32), np.zeros(1, np.int64), np.ones(1, np.int64)

    def word(self, w: str) -> bytes:
        shown = w if w.isascii() else "".join([self.letters[b] for b in w.encode()])  # visible ASCII stands for itself
        got = self.words[w] = array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()
        return got

    def learn(self, new: list[str]) -> None:
        found: list[bytes] = [b""] * len(new)
        plain: list[int] = []
        other: list[int] = []
        word, known, text = self.word, self.words.get, "\n".join(new)
        special = [x for x in self.special if x in text]
        for k, piece in enumerate(new):
            if piece.isalpha() and piece.isascii():
                w = piece.lower()
                found[k] = known(w) or word(w)
            elif self.PLAIN.fullmatch(piece) and not (special and any(x in piece for x in special)):
                plain.append(k)
            else:
                other.append(k)
        # The words of all plain pieces come from one pass over them, a NUL between two.
        text = "\0".join([new[k] for k in plain])
        text = (text if text.isascii() else unicodedata.normalize("NFC", text)).lower()
        ids, size = [], 0
        ends = []
        for w in self.WORDS.findall(text):
            if w == "\0":
                ends.append(size)
            else:
                got = known(w) or word(w)
                ids.append(got)
                size += len(got)
        raw = b"".join(ids)
        for k, at, end in zip(plain, [0, *ends], [*ends, size], strict=True) if plain else ():
            found[k] = raw[at:end]
        for k, got in zip(other, self.tokenizer.encode_batch([new[k] for k in other], add_special_tokens=False) if other else [], strict=True):
            found[k] = array("I", got.ids).tobytes()
        count = np.fromiter(map(len, found), np.int64, len(found)) >> 2
        number = len(self.count)
        self.begin = np.append(self.begin, len(self.pool) + np.cumsum(count) - count)
        self.count = np.append(self.count, count)
        self.pool = np.append(self.pool, np.frombuffer(b"".join(found), np.uint32))
        self.pieces.update(zip(new, range(number, number + len(new))))

    def lowered(self, text: str) -> str:
        """The text in lower case, where that is plain and makes no special token: fewer pieces differ then."""
        low = text.lower()
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return text
        return text if any(x in low for x in self.special) else low

    def encode(self, rows: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with the end id, one after the other, and how many each text has."""
        pool = pa.system_memory_pool()  # the default one would keep what it once held
        lowered = pa.array([self.lowered(x or "") for x in rows], pa.large_string(), memory_pool=pool)
        cut = pc.split_pattern(lowered, " ", memory_pool=pool)
        flat = pc.dictionary_encode(cut.flatten(), memory_pool=pool)
        known = flat.dictionary.to_numpy(zero_copy_only=False).tolist()  # each piece of these texts once
        held = list(map(self.pieces.get, known))
        new = [p for p, n in zip(known, held, strict=True) if n is None]
        if len(self.pieces) + len(new) > CACHE_PIECES:
            self.forget()
            new = known
        self.learn(new)
        held = np.fromiter(map(self.pieces.__getitem__, known), np.int64, len(known))[flat.indices.to_numpy()]
        size = cut.value_lengths().to_numpy().astype(np.int64) + 1
        end = np.cumsum(size)
        number = np.zeros(end[-1] if len(end) else 0, np.int64)
        inner = np.ones(len(number), bool)
        inner[end - 1] = False
        number[inner] = held
        count = self.count[number]
        total = np.cumsum(count)
        ids = self.pool[np.repeat(self.begin[number] - (total - count), count) + np.arange(total[-1] if len(total) else 0)]
        return ids, np.diff(total[end - 1], prepend=0) if len(end) else end


class Corpus(NamedTuple):
    """Statistics of all remainders: their number, mean length, and how many hold each term."""

    n: int
    mean: float
    df: np.ndarray

    def weight(self, term: np.ndarray, tf: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        idf = np.log(1 + (self.n - self.df[term] + 0.5) / (self.df[term] + 0.5))
        return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / max(1.0, self.mean)))

    def keys(self, parts: list[np.ndarray]) -> np.ndarray:
        """For each part its ``KEY_TERMS`` heaviest terms that another part of the corpus holds too, -1 where there are fewer.

        A term in over half of the corpus says nothing; equal weights go to the smaller term.
        """
        doc, term, tf = counted(parts)
        length = np.array([len(x) for x in parts], float)
        weight = self.weight(term, tf, length[doc])
        weight[(self.df[term] < 2) | (2 * self.df[term] > self.n)] = 0
        out = np.full((len(parts), KEY_TERMS), -1, np.int64)
        start = np.flatnonzero(np.diff(doc, prepend=-1))
        for k in range(KEY_TERMS if len(doc) else 0):
            best = np.maximum.reduceat(weight, start)
            at = np.flatnonzero((weight == np.repeat(best, np.diff(start, append=len(doc)))) & (weight > 0))
            at = at[np.diff(doc[at], prepend=-1) != 0]  # the first of equals
            out[doc[at], k] = term[at]
            weight[at] = 0
        return out


def counted(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(part, term, how often it occurs) of the distinct terms of each part, in order."""
    size = np.array([len(x) for x in parts], np.int64)
    doc = np.repeat(np.arange(len(parts), dtype=np.uint64), size)
    key = np.sort((doc << np.uint64(32)) | (np.concatenate(parts) if len(parts) else np.zeros(0)).astype(np.uint64))
    first = np.flatnonzero(np.diff(key, prepend=key[:1] + np.uint64(1)))
    return (key[first] >> np.uint64(32)).astype(np.int64), (key[first] & np.uint64(0xFFFFFFFF)).astype(np.int64), np.diff(first, append=len(key))


class Pool:
    """BM25 index of the remainders of one shard, with the corpus' statistics (default: the shard's own)."""

    def __init__(self, parts: list[np.ndarray], vocabulary: int, corpus: Corpus | None = None):
        n = len(parts)
        doc, term, tf = counted(parts)
        self.first = np.searchsorted(doc, np.arange(n + 1))
        self.terms = term
        df = np.bincount(term, minlength=vocabulary)
        length = np.array([len(x) for x in parts], float)
        corpus = corpus or Corpus(n, length.mean() if n else 1, df)
        weight = corpus.weight(term, tf, length[doc])
        order = np.argsort(term.astype(id_type(vocabulary)), kind="stable")
        self.doc, self.weight = doc[order], weight[order]
        self.end = np.cumsum(df)
        self.size = df
        # A frequent term's postings are a row of weights by document.
        frequent = np.flatnonzero(df > max(16, DENSE * n))
        self.row = np.full(vocabulary, -1)
        self.row[frequent] = np.arange(len(frequent))
        self.rows = np.zeros((len(frequent), n))
        at = np.flatnonzero(self.row[term] >= 0)
        self.rows[self.row[term[at]], doc[at]] = weight[at]

    def scores(self, seed: int) -> np.ndarray:
        """BM25 scores of all documents against the terms of the seed."""
        terms = self.terms[self.first[seed] : self.first[seed + 1]]
        row = self.row[terms]
        total = self.rows[row[row >= 0]].sum(0)
        rare = terms[row < 0]
        size, end = self.size[rare], self.end[rare]
        at = np.arange(size.sum()) + np.repeat(end - np.cumsum(size), size)  # the places of all their postings
        total += np.bincount(self.doc[at], self.weight[at], minlength=len(total))
        return total

    def neighbours(self, seed: int, unused: np.ndarray, wanted: Callable[[np.ndarray], np.ndarray] | None = None) -> Iterator[np.ndarray]:
        """Unused documents by falling score against the seed, equal scores in order: the best of them, then all others
        (or those of them that ``wanted`` still marks by then)."""
        left = np.flatnonzero(unused)
        score = -self.scores(seed)[left]
        if len(left) > 4 * BEST:
            limit = np.partition(score, BEST)[BEST]
            best, rest = np.flatnonzero(score <= limit), np.flatnonzero(score > limit)
            yield left[best[np.argsort(score[best], kind="stable")]]
            rest = rest[wanted(left[rest])] if wanted else rest
            left, score = left[rest], score[rest]
        yield left[np.argsort(score, kind="stable")]


def id_type(vocabulary: int) -> type:
    return np.uint16 if vocabulary <= 65536 else np.uint32


def pack_shard(docs: list[tuple[int | None, int, int, np.ndarray]], sequence: int, vocabulary: int, window: int = WINDOW, corpus: Corpus | None = None) -> tuple[list[list], int]:
    """Rows of OUT as columns for a shard's remainders (doc_id, doc_tokens, start, ids), and the next sequence number."""
    out: list[list] = [[] for _ in OUT.names]

    def put(k: int, at: int, length: int, offset: int) -> None:
        doc, total, start, ids = docs[k]
        crc = zlib.crc32(ids[at : at + length].astype("<u4").tobytes())
        for column, value in zip(out, (doc, start + at, length, crc, total, sequence, offset), strict=True):
            column.append(value)

    start = np.zeros(len(docs), np.int64)
    left = np.array([len(ids) for *_, ids in docs], np.int64)
    parts = [ids for *_, ids in docs]
    corpus = corpus or Corpus(len(parts), sum(map(len, parts)) / max(1, len(parts)), np.bincount(counted(parts)[1], minlength=vocabulary))
    indexed = np.arange(len(docs))
    pool = Pool(parts, vocabulary, corpus)
    unused = left > 0
    by_length = iter(np.argsort(-left, kind="stable").tolist())
    total = int(left.sum())
    while total:
        if len(indexed) > 512 and 2 * unused.sum() < len(indexed):  # the index goes on with the unused half
            indexed = np.flatnonzero(unused)
            pool = Pool([parts[k] for k in indexed], vocabulary, corpus)
        seed = next((k for k in by_length if unused[k]), None)
        if seed is None:  # only remainders that were cut before
            seed = int(np.flatnonzero(unused)[0])
        chosen, gap = [(seed, int(left[seed]))], window - int(left[seed])
        unused[seed] = False
        if gap and total > left[seed]:
            spare = None
            smallest = int(left[unused].min())
            useful = lambda x: left[indexed[x]] <= (gap if spare is not None else window)  # noqa: B023, E731 - as it is when asked
            for local in pool.neighbours(int(np.searchsorted(indexed, seed)), unused[indexed], useful):
                ranked, at = indexed[local], 0
                while gap and (spare is None or gap >= smallest):
                    fits = np.flatnonzero(left[ranked[at:]] <= gap)
                    if spare is None and at < len(ranked) and not (len(fits) and fits[0] == 0):
                        spare = int(ranked[at])  # the best of those that do not fit
                    if not len(fits):
                        break
                    k = int(ranked[at + fits[0]])
                    at += int(fits[0]) + 1
                    chosen.append((k, int(left[k])))
                    gap -= int(left[k])
                    unused[k] = False
            if gap and spare is not None:
                chosen.append((spare, gap))
                gap = 0
        sizes = [window] if not gap else [1 << b for b in range(window.bit_length(), -1, -1) if (window - gap) >> b & 1]
        offset = 0
        for k, size in chosen:
            while size:
                part = min(size, sizes[0] - offset)
                put(k, int(start[k]), part, offset)
                start[k] += part
                left[k] -= part
                total -= part
                size -= part
                offset += part
                if offset == sizes[0]:
                    sizes.pop(0)
                    sequence += 1
                    offset = 0
    return out, sequence


_encoders: dict[tuple[str, int], WordIds] = {}


def encoded(docs: DataFrame, path: str, end_id: int, window: int, vocabulary: int) -> DataFrame:
    """(doc_id, doc_tokens, crcs and first sequence of the full windows, start and ids of the remainder), written.

    The last row of a task has only ``terms`` and in how many remainders each is ``held``; their number and tokens are terms -1 and -2.
    """
    schema = pa.schema([*REMAINDERS, ("crcs", pa.list_(pa.int64())), ("sequence", pa.int64()), ("terms", pa.list_(pa.int64())), ("held", pa.list_(pa.int64()))])

    @leaves_nothing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (path, end_id) not in _encoders:
            _encoders[path, end_id] = WordIds(path, end_id)
        sequence = TaskContext.get().partitionId() << 33
        df, n, total = np.zeros(vocabulary, np.int64), 0, 0
        for batch in batches:
            for doc_ids, rows in slices(batch, SLICE):
                out: list[list] = [[] for _ in schema.names]
                ids, size = _encoders[path, end_id].encode(rows)
                wide, small = memoryview(ids.astype("<u4").tobytes()), memoryview(ids.astype(id_type(vocabulary)).tobytes())
                width, at = len(small) // max(1, len(ids)), 0
                for doc, n_ids in zip(doc_ids, size.tolist(), strict=True):
                    full = n_ids // window
                    crcs = [zlib.crc32(wide[4 * k : 4 * (k + window)]) for k in range(at, at + full * window, window)]
                    for column, value in zip(out, (doc, n_ids, full * window, small[width * (at + full * window) : width * (at + n_ids)], crcs, sequence, None, None), strict=True):
                        column.append(value)
                    sequence += full
                    at += n_ids
                parts = [np.frombuffer(x, id_type(vocabulary)) for x in out[3] if len(x)]
                df += np.bincount(counted(parts)[1], minlength=vocabulary)
                n += len(parts)
                total += sum(map(len, parts))
                yield arrow_rows(schema, out)
        held = np.flatnonzero(df)
        yield arrow_rows(schema, [*[[None]] * 6, [np.append(held, [-1, -2])], [np.append(df[held], [n, total])]])

    return stored(texts(docs).mapInArrow(run, "doc_id long, doc_tokens long, start long, rest binary, crcs array<long>, sequence long, terms array<long>, held array<long>"))


def statistics(rows: DataFrame, vocabulary: int) -> Corpus:
    """The sums of what the tasks of ``encoded`` counted."""
    counts = rows.filter("terms is not null").select(F.explode(F.arrays_zip("terms", "held")).alias("x"))
    got = counts.groupBy("x.terms").agg(F.sum("x.held").alias("n")).toArrow()  # as many rows as the vocabulary at most
    df = np.zeros(vocabulary + 2, np.int64)
    df[got["terms"].to_numpy()] = got["n"].to_numpy()
    return Corpus(int(df[-1]), int(df[-2]) / max(1, int(df[-1])), df[:-2])


def unpacked(column: pa.Array, vocabulary: int) -> list[np.ndarray]:
    return [np.frombuffer(x, id_type(vocabulary)) for x in column.to_pylist()]


def vocabulary_size(path: str, end_id: int) -> int:
    """One more than the largest id: of the tokenizer's file, and the end id."""
    with open(path) as file:
        held = json.load(file)
    return max(*held["model"]["vocab"].values(), *(t["id"] for t in held["added_tokens"]), end_id) + 1


def pack(docs: DataFrame, path: str, end_id: int = 1, window: int = WINDOW, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    vocabulary = vocabulary_size(path, end_id)
    rows = encoded(docs, path, end_id, window, vocabulary)
    full = rows.filter(F.size("crcs") > 0).select("doc_id", "doc_tokens", "sequence", F.posexplode("crcs").alias("k", "ids_crc32"))
    number = F.col("k").cast("long")
    full = full.select("doc_id", (number * window).alias("start"), F.lit(window).cast("long").alias("length"), "ids_crc32", "doc_tokens", (F.col("sequence") + number).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    remainders = rows.filter(F.length("rest") > 0).select(*REMAINDERS.names)
    corpus = statistics(rows, vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast(corpus)
    names = [f"key{k}" for k in range(KEY_TERMS)]
    keyed = pa.schema([*REMAINDERS, *((c, pa.int64()) for c in names)])

    @leaves_nothing
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = shared.value.keys(unpacked(batch.column(3), vocabulary))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c) for c in found.T)], schema=keyed)

    @leaves_nothing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = (1 << 60) + (TaskContext.get().partitionId() << 33)
        shard: list[tuple] = []
        held = 0
        for batch in batches:
            for doc, total, start, rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                shard.append((doc, total, start, np.frombuffer(rest, id_type(vocabulary))))
                held += len(shard[-1][3])
                if held >= shard_tokens:
                    out, sequence = pack_shard(shard, sequence, vocabulary, window, shared.value)
                    yield arrow_rows(OUT, out)
                    shard, held = [], 0
        if shard:
            out, sequence = pack_shard(shard, sequence, vocabulary, window, shared.value)
            yield arrow_rows(OUT, out)

    tasks = max(1, -(-int(corpus.n * corpus.mean) // (TASK_SHARDS * shard_tokens)))
    dealt = remainders.mapInArrow(keys, "doc_id long, doc_tokens long, start long, rest binary, " + ", ".join(f"{c} long" for c in names))
    dealt = stored(dealt)  # the ranges are found from a sample, so an exchange by range reads its rows twice
    dealt = dealt.repartitionByRange(tasks, *names, "doc_id").sortWithinPartitions(*names, "doc_id", "rest")
    return full.unionByName(dealt.select(*REMAINDERS.names).mapInArrow(run, SCHEMA))
