"""Language identification by cross-parsing entropy.

A suffix automaton of a bounded sample of labelled text per language answers "how long is the
longest prefix of the rest that occurs somewhere in the sample". Cutting a text greedily into such
longest matches gives ``c`` phrases; ``c * log2(sample length) / text length`` estimates the cross
entropy in bits a character, and the language with the smallest estimate wins.

Texts are lower-cased; letters stay, every run of other characters is one blank. All texts of a batch step through
the automata together, in blocks of ``BLOCK`` characters: each block is first parsed as if a phrase began with it; then
the parse of the block before it is carried on into it until both are in one state, which corrects its count. A
block in which they never meet hands its own last state on. So the phrases are those of the whole text, whatever
its length.

The fit reads a bounded sample: of each language ``SAMPLE_DOCS`` labelled texts, and of those the first
``SAMPLE_CHARS`` characters. The automata take about 16 MB a language in each worker.

Defined results: a null text or one without a letter is ``und`` with score 0, as is every text when
no labelled text exists; equal estimates go to the language that sorts first; repeated rows are
scored each by itself; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noticejobs.llm.common import arrow_rows, slices, texts

BLOCK = 512
#: Sample bound: characters of labelled text for each language, and documents they come from.
SAMPLE_CHARS, SAMPLE_DOCS = 40_000, 48
#: Letters, by frequency in the sample, whose transitions are columns of a table; those of all others are found by search.
DENSE_LETTERS = 64
OUT = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("n_letters", pa.int64()), ("phrases", pa.int64())])


def normalised(text: str) -> str:
    return "".join(c if c.isalpha() else " " for c in text.lower())


def learn(docs: DataFrame, sample_chars: int = SAMPLE_CHARS, sample_docs: int = SAMPLE_DOCS) -> dict[str, str]:
    """Labelled text for each language: whole documents in hash order until ``sample_chars`` is reached."""
    letters = F.substring("text", 1, sample_chars).rlike(r"\p{L}")  # a text without letters takes no place in the sample
    rows = docs.filter(F.col("lang").isNotNull() & letters).select("doc_id", F.col("lang").alias("sample_lang"), F.xxhash64("doc_id").alias("h"))
    order = Window.partitionBy("sample_lang").orderBy("h", "doc_id")
    chosen = rows.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= sample_docs)
    # At most sample_docs rows a language: small by construction.
    got = docs.select("doc_id", F.substring("text", 1, sample_chars).alias("t"), "lang").join(F.broadcast(chosen), [docs["doc_id"] == chosen["doc_id"], docs["lang"] == chosen["sample_lang"]]).filter("t is not null").select("sample_lang", "k", "h", "t").collect()
    sample: dict[str, str] = {}
    for lang, _, _, text in sorted(got):
        have = sample.get(lang, "")
        if len(have) < sample_chars:
            sample[lang] = (have + " " + " ".join(normalised(text).split()))[: sample_chars + 1]
    return {k: v for k, v in sample.items() if v.strip()}


def suffix_automaton(word: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton of all substrings; state 0 is the start."""
    move, link, length, last = [{}], [-1], [0], 0
    for c in word:
        new = len(move)
        move.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in move[p]:
            move[p][c] = new
            p = link[p]
        if p >= 0:
            q = move[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                clone = len(move)
                move.append(move[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and move[p].get(c) == q:
                    move[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    return move


class CrossParser:
    """Automata of all languages in one table: entry = 2 * (next state's offset) + (a new phrase began).

    Codes: 0 a blank, then the frequent letters, then ``strange`` (in no sample), then the rarer letters of the sample.
    """

    def __init__(self, sample: dict[str, str], dense: int = DENSE_LETTERS):
        self.langs = sorted(sample)
        letters = [c for c, _ in sorted(Counter("".join(sample.values())).items(), key=lambda x: (-x[1], x[0])) if c != " "]
        strange = min(dense, len(letters)) + 1
        self.width = strange + 1
        code = np.zeros(0x110000, np.int32)
        code[[k for k in range(0x110000) if chr(k).isalpha()]] = strange
        for k, c in enumerate(letters):
            code[ord(c)] = k + 1 if k < dense else k + 2
        self.code, tables, base, start, lost, self.bits = code, [], 0, [], [], []
        keys, to = [], []
        for lang in self.langs:
            word = code[np.frombuffer(sample[lang].encode("utf-32-le"), np.uint32)].tolist()
            move = suffix_automaton(word)
            lost.append(base + len(move) * self.width)  # the state after a letter that the sample lacks, a phrase of its own
            fresh = np.full(self.width, 2 * lost[-1] + 1, np.int64)
            for c, s in move[0].items():
                if c < self.width:
                    fresh[c] = 2 * (base + s * self.width) + 1
            table = np.tile(fresh, len(move) + 1).reshape(-1, self.width)
            for s, out in enumerate(move):
                for c, x in out.items():
                    if c < self.width:
                        table[s, c] = 2 * (base + x * self.width)
                    else:
                        keys.append(((base + s * self.width) << 20) + c)
                        to.append(2 * (base + x * self.width))
            table[0] = fresh - 1  # a text's first phrase is counted from the start
            tables.append(table.ravel())
            start.append(base)
            self.bits.append(np.log2(len(word) + 1))
            base += table.size
        self.table = np.concatenate(tables) if tables else np.zeros(0, np.int64)
        self.table = self.table.astype(np.int32) if base < 1 << 30 else self.table
        self.start, self.lost = np.array(start, np.int64), np.array(lost, np.int64)
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.to = np.append(np.array(keys, np.int64)[order], np.int64(-1)), np.append(np.array(to, np.int64)[order], 0)

    def found(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Transitions by rare letters, -1 where there are none."""
        key = (state << 20) + code
        at = np.searchsorted(self.keys[:-1], key)
        return np.where(self.keys[at] == key, self.to[at], -1)

    def step(self, state: np.ndarray, code: np.ndarray, lang: np.ndarray, rare: bool) -> np.ndarray:
        """Next states (as table entries) of states (as offsets); ``lang`` broadcasts against ``state``."""
        if not rare:
            return self.table[state + code]
        code, lang = np.broadcast_to(code, state.shape), np.broadcast_to(lang, state.shape)
        out = self.table[state + np.minimum(code, self.width - 1)].astype(np.int64)
        at = np.nonzero(code >= self.width)
        if len(at[0]):
            s, c, l = state[at].astype(np.int64), code[at].astype(np.int64), lang[at]
            go, again = self.found(s, c), self.found(self.start[l], c)
            begun = np.where(again >= 0, again, 2 * self.lost[l]) + (s != self.start[l])
            out[at] = np.where(go >= 0, go, begun)
        return out

    def phrases(self, docs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases (languages x texts), characters and letters of each text."""
        raw = np.frombuffer("\0".join(x.lower().replace("\0", " ") for x in docs).encode("utf-32-le") + b"\0\0\0\0", np.uint32)
        code, ends = self.code[raw], raw == 0
        keep = (code != 0) | ends
        keep[1:] |= (code[:-1] != 0) & ~ends[1:]
        at = np.cumsum(keep & ~ends)[ends]  # kept characters up to each text's end
        letters = np.diff(np.cumsum(code != 0)[ends], prepend=0)
        code = code[keep & ~ends]
        rare = bool((code >= self.width).any())
        size = np.diff(at, prepend=0)
        n_blocks = -(-size // BLOCK)
        of = np.repeat(np.arange(len(docs)), n_blocks)
        k = np.arange(len(of)) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
        begin = (at - size)[of] + k * BLOCK
        length = np.minimum(BLOCK, size[of] - k * BLOCK)
        order = np.argsort(-length, kind="stable")
        sorted_begin = begin[order]
        active = np.searchsorted(-length[order], -np.arange(BLOCK), side="left")
        lang = np.arange(len(self.langs))[:, None]
        state = np.repeat(self.start.astype(self.table.dtype), len(begin)).reshape(len(self.langs), -1)
        count = np.zeros(state.shape, np.int64)
        for j in range(BLOCK):
            n = active[j]
            if not n:
                break
            entry = self.step(state[:, :n], code[sorted_begin[:n] + j], lang, rare)
            state[:, :n] = entry >> 1
            count[:, :n] += entry & 1
        last, counts = np.empty_like(state), np.empty_like(count)
        last[:, order], counts[:, order] = state, count
        self.carry(code, begin, length, k, last, counts, rare)
        total = np.zeros((len(self.langs), len(docs)), np.int64)
        for row, c in zip(total, counts, strict=True):
            np.add.at(row, of, c)
        return total + (size > 0), size, letters

    def carry(self, code: np.ndarray, begin: np.ndarray, length: np.ndarray, k: np.ndarray, last: np.ndarray, counts: np.ndarray, rare: bool) -> None:
        """Correct the counts of blocks for the phrases that reach into them from the block before."""
        # A row for each language and block that is not its text's first: lang, block.
        inner = np.flatnonzero(k > 0)
        lang, block = (x.ravel() for x in np.meshgrid(np.arange(len(self.langs)), inner, indexing="ij"))
        alone, fix = last.copy(), np.zeros(last.shape, np.int64)
        while len(block):
            real, guess = last[lang, block - 1], self.start[lang].astype(last.dtype)
            entered = np.zeros(len(block), np.int64)
            result, live = alone[lang, block], np.arange(len(block))
            j = 0
            while len(live):
                at, l = code[begin[block[live]] + j], lang[live]
                a, b = self.step(real, at, l, rare), self.step(guess, at, l, rare)
                entered[live] += (a & 1).astype(np.int64) - (b & 1)
                real, guess = a >> 1, b >> 1
                j += 1
                ended = length[block[live]] == j
                result[live[ended]] = real[ended]
                on = (real != guess) & ~ended
                live, real, guess = live[on], real[on], guess[on]
            fix[lang, block] = entered
            changed = result != last[lang, block]
            last[lang, block] = result
            # A block whose last state is not what the next one was given has the next one corrected again.
            lang, block = lang[changed], block[changed] + 1
            follows = block < len(k)
            follows[follows] = k[block[follows]] > 0
            lang, block = lang[follows], block[follows]
        counts += fix

    def predict(self, docs: list[str | None]) -> tuple[list, list, list, list]:
        if not self.langs:
            n = len(docs)
            return ["und"] * n, [0.0] * n, [0] * n, [0] * n
        total, size, letters = self.phrases([x or "" for x in docs])
        bits = total * np.array(self.bits)[:, None] / np.maximum(size, 1)
        best = bits.argmin(0)
        low, high = np.sort(bits, 0)[0], np.sort(bits, 0)[min(1, len(self.langs) - 1)]
        score = np.where(high > 0, 1 - low / np.maximum(high, 1e-12), 0) if len(self.langs) > 1 else np.ones(len(docs))
        sure = letters > 0
        return [self.langs[b] if s else "und" for b, s in zip(best, sure, strict=True)], np.where(sure, score, 0).tolist(), letters.tolist(), np.where(sure, total[best, np.arange(len(docs))], 0).tolist()


_parsers: dict[int, CrossParser] = {}


def identify(docs: DataFrame, sample: dict[str, str]) -> DataFrame:
    """doc_id, lang_pred, score, n_letters, phrases (of the winning language) for every row of ``docs``."""
    key = hash(tuple(sorted(sample.items())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _parsers:  # one automaton table for each worker process
            _parsers.clear()
            _parsers[key] = CrossParser(sample)
        for batch in batches:
            for ids, rows in slices(batch):
                yield arrow_rows(OUT, [ids, *_parsers[key].predict(rows)])

    return texts(docs).mapInArrow(run, "doc_id long, lang_pred string, score double, n_letters long, phrases long")


def fold(modulus: int):
    """crc32 of the document's id as text, modulo ``modulus``."""
    return F.crc32(F.col("doc_id").cast("string")) % modulus


def held_out_predictions(docs: DataFrame) -> DataFrame:
    """Fit on the folds 0, 1 and 3 of 4, predict every document."""
    sample = learn(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter(fold(4) != 2))
    return identify(docs, sample).select("doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", "score", "n_letters", "phrases")
