"""Byte-level BPE encoding and decoding with recursive DuckDB queries inside each task.

Each task keeps the distinct pre-tokens of its partition and encodes those it has not met yet in a
DuckDB database in memory: a recursive query holds (word, position, token) rows, joins neighbours with
the merge table and contracts the leftmost pair of minimum rank of every word, until no word has
a pair left; an ordered aggregate over the token rows gives each word's ids. The ids of a text are those
of its pre-tokens in order. Decoding joins the ids of whole texts with the vocabulary and aggregates their
bytes in order, ``DECODE_TOKENS`` ids at a time.

A text is first cut before every blank that follows a non-blank, which is always a boundary of the
pattern, so that the pattern itself runs once over each distinct piece. Letters, digits and white space are what
the library's own pattern engine takes for them: characters on which the two engines' tables
differ are matched through a stand-in of the right class.

One recursion step a merge is quadratic in a pre-token's length, so pre-tokens of more than ``SHORT_BYTES`` bytes
contract all places of their minimum-rank pair in a step (a merged token only takes part in pairs of higher
rank, so the result is the same), and those of more than ``LONG_BYTES`` bytes, which only unbroken runs of one class
of characters can be, are merged by a heap of pairs, with the same rule and result. Nothing is cut short.

Defined results: null texts count as empty; an empty text has no ids; repeated rows are encoded each and columns other
than doc_id and text are ignored; an empty table gives an empty result; equal ranks in a word go to the leftmost pair.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from noticejobs.llm.common import arrow_rows, slices, texts

SHORT_BYTES, LONG_BYTES = 200, 4096
#: Pre-tokens and pieces a worker remembers; beyond this it starts afresh.
CACHE_WORDS, CACHE_PIECES = 600_000, 500_000
#: Words encoded by one recursive query, bytes of long ones, and ids decoded by one query: no query needs to spill.
WORDS_PER_QUERY, BYTES_PER_QUERY, DECODE_TOKENS = 40_000, 8192, 1_000_000
DUCKDB_MEMORY = "384MB"
OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

#: A token row is (word, place, next, tok, after): next is the place of the word's next token or 0, after that
#: token. A word's best pair is one number: merged token, place of the left and of the right token. Every
#: step emits the words it contracted, so a word's rows of its last step are its tokens.
ENCODE = """
WITH RECURSIVE t(step, word, place, next, tok, after) AS (
    SELECT 0::SMALLINT, word, place, next, tok, after FROM start
    UNION ALL
    (WITH best AS (
        SELECT word, min((m.merged::BIGINT << 16) + (place::BIGINT << 8) + next) AS pair
        FROM t JOIN merges m ON m.pair = (tok::BIGINT << 20) + after WHERE next > 0 GROUP BY 1),
    contracted AS (
        SELECT best.word, (pair >> 16)::INTEGER AS merged, ((pair >> 8) & 255)::SMALLINT AS l, b.place AS r, b.next AS right_next, b.after AS right_after
        FROM best JOIN t b ON b.word = best.word AND b.place = (pair & 255))
    SELECT (step + 1)::SMALLINT, t.word, place, CASE WHEN place = l THEN right_next ELSE next END, CASE WHEN place = l THEN merged ELSE tok END,
        CASE WHEN place = l THEN right_after WHEN next = l AND l > 0 THEN merged ELSE after END
    FROM t JOIN contracted c ON c.word = t.word WHERE place <> r)
), last AS (SELECT word, max(step) AS step FROM t GROUP BY 1)
SELECT word, list(tok ORDER BY place) AS tokens FROM t JOIN last USING (word, step) GROUP BY word
"""
#: All places of a word's best pair at once; in a run of overlapping places, every second one starting with the first.
ENCODE_LONG = """
WITH RECURSIVE t(step, word, place, tok) AS (
    SELECT 0, word, place, tok FROM start
    UNION ALL
    (WITH pairs AS (SELECT *, lead(tok) OVER w AS after, row_number() OVER w AS n FROM t WINDOW w AS (PARTITION BY word ORDER BY place)),
        ranked AS (SELECT p.*, m.merged, min(m.merged) OVER (PARTITION BY word) AS best FROM pairs p LEFT JOIN merges m ON m.pair = (p.tok << 20) + p.after),
        runs AS (SELECT *, n - row_number() OVER (PARTITION BY word, merged = best ORDER BY n) AS run FROM ranked WHERE best IS NOT NULL),
        chosen AS (SELECT *, merged IS NOT DISTINCT FROM best AND row_number() OVER (PARTITION BY word, merged = best, run ORDER BY n) % 2 = 1 AS hit FROM runs),
        gone AS (SELECT *, lag(hit) OVER (PARTITION BY word ORDER BY n) AS taken FROM chosen)
    SELECT step + 1, word, place, CASE WHEN hit THEN merged ELSE tok END FROM gone WHERE taken IS NOT TRUE)
)
SELECT word, list(tok ORDER BY place) AS tokens FROM t JOIN (SELECT word, max(step) AS step FROM t GROUP BY word) USING (word, step) GROUP BY word
"""
DECODE = "SELECT doc, list(bytes ORDER BY place) AS bytes FROM ids JOIN vocabulary USING (tok) GROUP BY doc ORDER BY doc"


class BytePairs:
    def __init__(self, path: str, pattern: str):
        import duckdb

        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
        self.pattern = regex.compile(pattern)
        self.forget()
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": DUCKDB_MEMORY, "temp_directory": ""})
        pairs = [(self.ranks[t[:k]], self.ranks[t[k:]], rank) for t, rank in self.ranks.items() for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks]
        self.load("merges", pa.table({"pair": pa.array([(l << 20) + r for l, r, _ in pairs], pa.int64()), "merged": pa.array([m for _, _, m in pairs], pa.int64())}))
        self.single = np.array([self.ranks[bytes([k])] for k in range(256)], np.int64)
        self.load("vocabulary", pa.table({"tok": pa.array(self.ranks.values(), pa.int32()), "bytes": pa.array(self.ranks.keys(), pa.binary())}))
        self.classes()

    def forget(self) -> None:
        self.words: dict[str, bytes] = {}  # pre-token -> ids
        self.bare: dict[str, int] = {}  # a text's first piece -> its number
        self.after: dict[str, int] = {}  # a piece without the blank before it -> its number
        self.pool, self.begin, self.count = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def classes(self) -> None:
        """Characters that the pattern engines class differently, each with a stand-in of the library's class."""
        import tiktoken

        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        one_byte = {bytes([k]): k for k in range(256)}
        of = []
        for pattern in (r"\p{L}", r"\p{N}", r"\s"):
            library = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks=one_byte, special_tokens={})
            of.append((set(bytes(library.encode_ordinary(every)).decode()), set(regex.findall(pattern, every))))
        letters = {c for c in every if c.isalpha()}
        differ = {c for theirs, ours in of for c in theirs ^ ours} | (letters ^ of[0][0])
        sample = [min(theirs & ours - {"'"}, default="") for theirs, ours in of]
        kind = lambda c: next((s for s, (theirs, _) in zip(sample, of, strict=True) if c in theirs), "~")
        self.stand_in = {ord(c): kind(c) for c in sorted(differ)}
        self.differs = frozenset(differ)
        spaces = sorted({c for c in every if c.isspace()} | of[2][0])
        self.blanks = [c + " " for c in spaces if c.isascii()], [c + " " for c in spaces]

    def load(self, name: str, table: pa.Table) -> None:
        self.db.register("incoming", table)
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM incoming")
        self.db.unregister("incoming")

    def encode_words(self, words: list[str]) -> None:
        """Put the ids of words into the cache, by recursive queries."""
        raw = [w.encode() for w in words]
        short = [k for k, b in enumerate(raw) if len(b) <= SHORT_BYTES]
        for begin in range(0, len(short), WORDS_PER_QUERY):
            part = short[begin : begin + WORDS_PER_QUERY]
            size = np.array([len(raw[k]) for k in part])
            place, width = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size), np.repeat(size, size)
            tok = self.single[np.frombuffer(b"".join(raw[k] for k in part), np.uint8)].astype(np.int32)
            last = place + 1 == width
            self.load("start", pa.table({
                "word": np.repeat(np.array(part, np.int32), size), "place": place.astype(np.int16), "next": np.where(last, 0, place + 1).astype(np.int16),
                "tok": tok, "after": np.where(last, -1, np.roll(tok, -1)).astype(np.int32),
            }))
            self.keep(words, self.db.sql(ENCODE).to_arrow_table())
        part, held = [], 0
        for k in [*(k for k, b in enumerate(raw) if SHORT_BYTES < len(b) <= LONG_BYTES), None]:
            if part and (k is None or held + len(raw[k]) > BYTES_PER_QUERY):
                size = np.array([len(raw[j]) for j in part])
                self.load("start", pa.table({"word": np.repeat(np.array(part), size), "place": np.arange(size.sum()), "tok": self.single[np.frombuffer(b"".join(raw[j] for j in part), np.uint8)]}))
                self.keep(words, self.db.sql(ENCODE_LONG).to_arrow_table())
                part, held = [], 0
            if k is not None:
                part.append(k)
                held += len(raw[k])
        for k, b in enumerate(raw):
            if len(b) > LONG_BYTES:
                self.words[words[k]] = np.array(self.merge_long(b), "<u4").tobytes()

    def keep(self, words: list[str], got: pa.Table) -> None:
        tokens = got["tokens"].combine_chunks()
        ids, ends = tokens.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes(), tokens.offsets.to_numpy() * 4
        self.words.update((words[k], ids[a:b]) for k, a, b in zip(got["word"].to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True))

    def merge_long(self, b: bytes) -> list[int]:
        """Leftmost minimum-rank contraction of one long word, with a heap of pairs over a linked list."""
        token: list[bytes | None] = [b[k : k + 1] for k in range(len(b))]
        after, before = list(range(1, len(b) + 1)), list(range(-1, len(b) - 1))
        heap = [(r, k) for k in range(len(b) - 1) if (r := self.ranks.get(b[k : k + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, k = heapq.heappop(heap)
            n = after[k] if token[k] is not None else len(b)
            if n >= len(b) or self.ranks.get(token[k] + token[n]) != rank:
                continue
            token[k], token[n] = token[k] + token[n], None
            after[k] = after[n]
            if after[k] < len(b):
                before[after[k]] = k
            for a, c in ((before[k], k), (k, after[k])):
                if a >= 0 and c < len(b) and (r := self.ranks.get(token[a] + token[c])) is not None:
                    heapq.heappush(heap, (r, a))
        return [self.ranks[t] for t in token if t is not None]

    def matches(self, piece: str) -> list[str]:
        """The pattern's matches. A blank and letters are one match; so is one mark after them."""
        if not piece.isascii() and not self.differs.isdisjoint(piece):
            return [piece[m.start() : m.end()] for m in self.pattern.finditer(piece.translate(self.stand_in))]
        head, last = piece[:1], piece[-1:]
        if head == " " or head.isalpha():
            if piece[1:].isalpha():
                return [piece]
            if last in ".,!?" and piece[1:-1].isalpha():
                return [piece[:-1], last]
        return self.pattern.findall(piece)

    def learn(self, bare: set[str], after: set[str]) -> None:
        """Number new pieces and put their ids into the pool."""
        found = [self.matches(p) for p in bare] + [[" " + p] if p.isascii() and p.isalpha() else self.matches(" " + p) for p in after]
        missing = {w for ws in found for w in ws if w not in self.words}
        if len(self.words) + len(missing) > CACHE_WORDS:
            self.words.clear()
            missing = {w for ws in found for w in ws}
        if missing:
            self.encode_words(sorted(missing))
        ids = [self.words[ws[0]] if len(ws) == 1 else b"".join([self.words[w] for w in ws]) for ws in found]
        count = np.fromiter(map(len, ids), np.int64, len(ids)) >> 2
        self.begin = np.append(self.begin, len(self.pool) + np.cumsum(count) - count)
        number = len(self.count)
        self.count = np.append(self.count, count)
        self.pool = np.append(self.pool, np.frombuffer(b"".join(ids), "<u4"))
        self.bare.update(zip(bare, range(number, number + len(bare))))
        self.after.update(zip(after, range(number + len(bare), number + len(ids))))

    def cut(self, text: str) -> list[str]:
        """A text's first piece, and the others without the blank before them; no piece starts with two characters of white space."""
        parts = text.split(" ")
        if not any(b in text for b in self.blanks[not text.isascii()]):
            return parts
        out = [parts[0]]
        for p in parts[1:]:
            before = out[-1][-1:] or (" " if len(out) > 1 else "")
            if before and not before.isspace():
                out.append(p)
            else:
                out[-1] += " " + p
        return out

    def ids(self, rows: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each text has."""
        cut = [self.cut(x) if x else [""] for x in rows]
        first, rest = [x[0] for x in cut], [p for x in cut for p in x[1:]]
        bare, after = set(first).difference(self.bare), set(rest).difference(self.after)
        if len(self.count) + len(bare) + len(after) > CACHE_PIECES:
            words = self.words
            self.forget()
            self.words = words
            bare, after = set(first), set(rest)
        self.learn(bare, after)
        size = np.fromiter(map(len, cut), np.int64, len(cut))
        start = np.cumsum(size) - size
        piece = np.empty(size.sum(), np.int64)
        others = np.ones(len(piece), bool)
        others[start] = False
        piece[start] = np.fromiter(map(self.bare.__getitem__, first), np.int64, len(first))
        piece[others] = np.fromiter(map(self.after.__getitem__, rest), np.int64, len(rest))
        count = self.count[piece]
        total = np.cumsum(count)
        ids = self.pool[np.repeat(self.begin[piece] - (total - count), count) + np.arange(total[-1] if len(total) else 0)]
        return ids, np.add.reduceat(count, start) if len(start) else np.zeros(0, np.int64)

    def decoded(self, ids: np.ndarray, size: np.ndarray) -> list[str]:
        """SHA-256 of each text's decoded bytes: an ordered aggregation over (text, place, id) rows."""
        sums = [hashlib.sha256() for _ in size]
        doc = np.repeat(np.arange(len(size), dtype=np.int32), size)
        for k in range(0, len(ids), DECODE_TOKENS):
            part = slice(k, k + DECODE_TOKENS)
            self.load("ids", pa.table({"doc": doc[part], "place": np.arange(len(ids[part]), dtype=np.int32), "tok": ids[part].astype(np.int32)}))
            got = self.db.sql(DECODE).to_arrow_table()
            lists = got["bytes"].combine_chunks()
            pieces = lists.values.cast(pa.binary())
            data = memoryview(pieces.buffers()[2] or b"")
            at = np.frombuffer(pieces.buffers()[1], np.int32)[lists.offsets.to_numpy() + pieces.offset].tolist()
            for n, a, b in zip(got["doc"].to_pylist(), at[:-1], at[1:], strict=True):
                sums[n].update(data[a:b])
        return [x.hexdigest() for x in sums]

    def encode(self, rows: list[str | None]) -> tuple[list, list, list]:
        ids, size = self.ids(rows)
        raw, ends = memoryview(ids.astype("<u4").tobytes()), (4 * np.cumsum(size)).tolist()
        return size.tolist(), [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip([0, *ends[:-1]], ends)], self.decoded(ids, size)


_coders: dict[tuple[str, str], BytePairs] = {}


def encode_decode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (path, pattern) not in _coders:
            _coders[path, pattern] = BytePairs(path, pattern)
        coder = _coders[path, pattern]
        for batch in batches:
            for ids, rows in slices(batch):
                yield arrow_rows(OUT, [ids, *coder.encode(rows)])

    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
