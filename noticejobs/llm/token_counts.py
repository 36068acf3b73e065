"""Token counts under a unigram vocabulary: count-only Viterbi over Aho-Corasick matches.

The pieces and scores are those of a sentencepiece file. A text is cut at blanks as the Metaspace
pre-tokenizer does (each blank becomes ``▁`` at the front of the next word, and one is put before the
text), so that every word is segmented by itself; its best score and number of pieces are kept per
word, never the pieces. Rules of ``tokenizers.models.Unigram``: a later path replaces an earlier one
only with a strictly higher score, candidates come in order of their start; a character without a
piece of its own costs the lowest score less 10, and a run of such characters is one unknown token,
or one token for each of its bytes with ``byte_fallback``.

Defined results: a null text and an empty one have 0 tokens and score 0; repeated rows count each; of paths with one score
the first found stays; a text or word of any length is taken whole, and a word needs memory for the longest piece only, beside four bytes a letter inside the automaton; columns other than doc_id and text are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from noticejobs.llm.common import arrow_rows, slices, texts

UNKNOWN_PENALTY = 10.0
#: Words whose counts a worker remembers; beyond this it starts afresh.
CACHE_WORDS = 400_000
#: Longer words are not remembered.
CACHE_LETTERS = 100
MARK = "▁"
OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_unknown", pa.int64()), ("score", pa.float64())])


def vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) in id order of a sentencepiece file; control and byte pieces keep their places."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(k), model.get_score(k)) for k in range(model.get_piece_size())]


class UnigramCounter:
    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool = True):
        self.machine, self.bytes = ahocorasick.Automaton(), byte_fallback
        self.longest = max(len(piece) for piece, _ in pieces)
        for piece, score in pieces:
            if piece:
                self.machine.add_word(piece, (len(piece), score))
        self.machine.make_automaton()
        self.unknown = min(score for _, score in pieces) - UNKNOWN_PENALTY
        self.cache: dict[str, tuple[int, int, float]] = {}

    def word(self, word: str) -> tuple[int, int, float]:
        """Tokens, unknown characters and score of the best path. The state of a place is (score, tokens, unknown characters, whether
        its last character is unknown); places further back than the longest piece are forgotten."""
        size, unknown, count_bytes = self.longest + 1, self.unknown, self.bytes
        states: list[tuple[float, int, int, bool]] = [(0.0, 0, 0, False)] * size
        matches = self.machine.iter(word)
        match = next(matches, None)
        for end in range(1, len(word) + 1):
            top, back, single = 0.0, None, False
            while match is not None and match[0] == end - 1:  # longest piece first
                length, score = match[1]
                state = states[(end - length) % size]
                single |= length == 1
                if back is None or state[0] + score > top:
                    top, back = state[0] + score, state
                match = next(matches, None)
            if not single:
                state = states[(end - 1) % size]
                if back is None or state[0] + unknown > top:
                    step = len(word[end - 1].encode()) if count_bytes else not state[3]  # a run of unknown characters is one token
                    states[end % size] = (state[0] + unknown, state[1] + step, state[2] + 1, True)
                    continue
            states[end % size] = (top, back[1] + 1, back[2], False)
        score, tokens, strange, _ = states[len(word) % size]
        return tokens, strange, score

    def text(self, text: str | None) -> tuple[int, int, float]:
        tokens, unknown, score, cache = 0, 0, 0.0, self.cache
        if not text:
            return 0, 0, 0.0
        text = text.replace(MARK, " ")
        for w in (text if text[0] == " " else " " + text).split(" ")[1:]:
            got = cache.get(w)
            if got is None:
                got = self.word(MARK + w)
                if len(w) <= CACHE_LETTERS:
                    if len(cache) >= CACHE_WORDS:
                        cache.clear()
                    cache[w] = got
            tokens += got[0]
            unknown += got[1]
            score += got[2]
        return tokens, unknown, score


_counters: dict[str, UnigramCounter] = {}


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, n_unknown (characters), score of the best segmentation of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _counters:
            _counters[path] = UnigramCounter(vocabulary(path))
        counter = _counters[path]
        for batch in batches:
            for ids, rows in slices(batch):
                yield arrow_rows(OUT, [ids, *zip(*map(counter.text, rows), strict=True)])

    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, n_unknown long, score double")
