"""Quality classifier: naive Bayes support vectors.

A text's features are indicators of n-grams: single words and pairs of words, and runs of one to three
word shapes (``Aa``, ``A!!``, ``9``, ``=`` for a word equal to the one before), hashed into a fixed number
of slots. Each indicator is scaled by the log ratio of its smoothed counts in the two classes; a
linear hinge-loss model is fitted on the scaled, length-normalised vectors by dual coordinate
descent, and a logistic curve fitted on rows kept apart turns its margin into a score.

The fit uses a bounded sample: the ``SAMPLE_ROWS`` labelled rows with the smallest hash of their id, as many of them, in
that order, as have ``SAMPLE_FEATURES`` features together. One task fits the model, and only its weights, which
have a fixed size, reach the driver. Every text is scored in whole.

Defined results: null and empty texts have no features, so they get the score of the intercept; with no
labels, or labels of one class only, every score is 1.0 (or 0.0, if only 0 was seen); a document with several
labels takes the lowest; of labelled rows with one doc_id, that whose features sort first is learned from; repeated rows are
scored each; equal vectors get equal scores; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticejobs.llm.common import arrow_rows, leaves_nothing, slices, texts

SAMPLE_ROWS, SAMPLE_FEATURES = 8192, 1 << 23
WORD_SLOTS, SHAPE_SLOTS = 1 << 18, 1 << 16
SLOTS = WORD_SLOTS + SHAPE_SLOTS
CACHE_WORDS = 200_000
EPOCHS, COST, SMOOTHING = 12, 1.0, 1.0
_RUNS = re.compile(rb"([Aa])\1+|([0-9])[0-9]*|([^Aa0-9])\3+")
_CLASS = bytes(65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c >= 128 else c for c in range(256))
OUT = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def shape(word: bytes) -> bytes:
    """Letters become A or a, runs shrink to one (letters, digits) or two (marks) characters."""
    return _RUNS.sub(lambda m: m[1] or (b"9" if m[2] else m[3] * 2), word.translate(_CLASS))


class Features:
    def __init__(self):
        self.known: dict[bytes, int] = {}  # places in the table
        self.table = np.zeros((2, 0), np.uint64)

    def hashes(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of words and of their shapes."""
        new = set(words).difference(self.known)
        if len(self.known) + len(new) > CACHE_WORDS:
            self.known, self.table, new = {}, self.table[:, :0], set(words)
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        fresh = [[xxhash.xxh64_intdigest(w) for w in new], [xxhash.xxh64_intdigest(shape(w), 1) for w in new]]
        self.table = np.concatenate([self.table, np.array(fresh, np.uint64).reshape(2, -1)], axis=1)
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        return self.table[0][at], self.table[1][at]

    def slots(self, rows: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Distinct feature slots of each text, one after the other, and how many each text has."""
        split = [x.encode().split() if x else [] for x in rows]
        size = np.array([len(x) for x in split])
        word, form = self.hashes([w for x in split for w in x])
        doc = np.repeat(np.arange(len(rows)), size)
        n = len(doc)
        same = np.zeros(n, bool)
        same[1:] = (word[1:] == word[:-1]) & (doc[1:] == doc[:-1])
        form = np.where(same, np.uint64(61), form)
        parts = [(doc, word >> np.uint64(46)), (doc, WORD_SLOTS + (form >> np.uint64(48)))]
        mix, pair = np.uint64(0x9E3779B97F4A7C15), np.arange(1, n)[doc[1:] == doc[:-1]] if n else np.zeros(0, np.int64)
        parts.append((doc[pair], (word[pair - 1] * mix + word[pair]) * mix >> np.uint64(46)))
        parts.append((doc[pair], WORD_SLOTS + ((form[pair - 1] * mix + form[pair]) * mix >> np.uint64(48))))
        three = pair[(pair > 1)]
        three = three[doc[three - 2] == doc[three]]
        parts.append((doc[three], WORD_SLOTS + (((form[three - 2] * mix + form[three - 1]) * mix + form[three]) * mix >> np.uint64(48))))
        key = np.concatenate([d.astype(np.int64) * (2 * SLOTS) + s.astype(np.int64) for d, s in parts])
        key = np.unique(key)
        return (key % (2 * SLOTS)).astype(np.int32), np.bincount(key // (2 * SLOTS), minlength=len(rows))


class Model:
    """Weights by slot, already multiplied by the log-count ratios; norm scales a text's vector."""

    def __init__(self, weight: np.ndarray, ratio: np.ndarray, bias: float, slope: float, shift: float):
        self.weight, self.square, self.bias, self.slope, self.shift = weight.astype(np.float32), np.square(ratio).astype(np.float32), bias, slope, shift

    @classmethod
    def of(cls, weight: bytes, square: bytes, bias: float, slope: float, shift: float) -> Model:
        out = cls(np.frombuffer(weight, np.float32), np.zeros(0), bias, slope, shift)
        out.square = np.frombuffer(square, np.float32)
        return out

    def margins(self, slots: np.ndarray, size: np.ndarray) -> np.ndarray:
        doc = np.repeat(np.arange(len(size)), size)
        norm = np.sqrt(np.bincount(doc, self.square[slots], minlength=len(size)))
        return np.bincount(doc, self.weight[slots], minlength=len(size)) / np.maximum(norm, 1e-9) + self.bias

    def scores(self, slots: np.ndarray, size: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(slots, size) + self.shift, -30, 30)))


def constant(score: float) -> Model:
    return Model(np.zeros(2 * SLOTS), np.zeros(2 * SLOTS), 0.0, 0.0, 40.0 if score else -40.0)


def fit(rows: list[tuple[np.ndarray, int]]) -> Model:
    """rows: distinct slots and label of each sample text; every fifth row sets the logistic curve."""
    if len({y for _, y in rows}) < 2:
        return constant(rows[0][1] if rows else 1.0)
    curve = [k for k in range(len(rows)) if k % 5 == 4]
    base = [k for k in range(len(rows)) if k % 5 != 4]
    if len({rows[k][1] for k in base}) < 2:
        base = list(range(len(rows)))
    count = np.full((2, 2 * SLOTS), SMOOTHING)
    for k in base:
        count[rows[k][1], rows[k][0]] += 1
    ratio = np.log(count[1] / count[1].sum()) - np.log(count[0] / count[0].sum())
    x = []
    for k in base:
        v = ratio[rows[k][0]]
        x.append(v / max(1e-9, np.sqrt(v @ v)))
    y = np.array([1.0 if rows[k][1] else -1.0 for k in base])
    share = np.array([(y < 0).mean(), (y > 0).mean()])
    cost = COST * np.where(y > 0, 0.5 / share[1], 0.5 / share[0])  # both classes weigh the same
    w, bias, alpha = np.zeros(2 * SLOTS), 0.0, np.zeros(len(base))
    rng = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(base)):
            at, v = rows[base[i]][0], x[i]
            gradient = y[i] * (w[at] @ v + bias) - 1
            new = min(max(alpha[i] - gradient / (v @ v + 1), 0.0), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[at] += step * v
                bias += step
                alpha[i] = new
    model = Model(w * ratio, ratio, bias, 1.0, 0.0)
    curve = curve if len({rows[k][1] for k in curve}) == 2 else base
    m = model.margins(np.concatenate([rows[k][0] for k in curve]), np.array([len(rows[k][0]) for k in curve]))
    t = np.array([rows[k][1] for k in curve], float)
    n1 = t.sum()
    t = np.where(t > 0, (n1 + 1) / (n1 + 2), 1 / (len(t) - n1 + 2))
    a, b = 2.0, 0.0
    for _ in range(50):  # Newton's method for the logistic curve
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        g, h = np.array([(p - t) @ m, (p - t).sum()]), p * (1 - p)
        hess = np.array([[h @ (m * m), h @ m], [h @ m, h.sum()]]) + 1e-3 * np.eye(2)
        da, db = np.linalg.solve(hess, g + 1e-3 * np.array([a, b]))
        a, b = a - da, b - db
        if abs(da) + abs(db) < 1e-6:
            break
    model.slope, model.shift = max(a, 1e-3), b
    return model


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_features: int = SAMPLE_FEATURES) -> Model:
    """Fit on at most ``sample_rows`` labelled documents of ``sample_features`` features, chosen by the hash of their id."""
    rated = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)")
    chosen = rated.groupBy("doc_id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    picked = texts(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "y")  # bounded by sample_rows

    @leaves_nothing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            y, done = batch.column(2).to_pylist(), 0
            for ids, rows in slices(batch):
                slots, size = features.slots(rows)
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "y": pa.array(y[done : done + len(ids)], pa.int32()), "slots": pa.array([x.tobytes() for x in np.split(slots, np.cumsum(size)[:-1])], pa.binary())})
                done += len(ids)

    @leaves_nothing
    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data: list[tuple[np.ndarray, int]] = []
        last, held = None, 0
        for batch in batches:  # in the order of the sample; what is beyond its bound is not kept
            for doc, y, slots in zip(*(batch.column(k) for k in range(3)), strict=True):
                if held < sample_features and doc.as_py() != last:
                    data.append((np.frombuffer(slots.as_py(), np.int32), y.as_py()))
                    last, held = doc.as_py(), held + len(data[-1][0])
        model = fit([data[k] for k in np.random.default_rng(3).permutation(len(data))])
        yield pa.RecordBatch.from_pydict({"weight": [model.weight.tobytes()], "square": [model.square.tobytes()], "bias": [float(model.bias)], "slope": [float(model.slope)], "shift": [float(model.shift)]})

    sample = picked.mapInArrow(run, "doc_id long, y int, slots binary").withColumn("h", F.xxhash64("doc_id"))
    one = sample.repartition(1).sortWithinPartitions("h", "doc_id", "slots").select("doc_id", "y", "slots")  # the bounded sample in one task
    got = one.mapInArrow(fitted, "weight binary, square binary, bias double, slope double, shift double").toArrow().to_pylist()
    return Model.of(**got[0]) if got else constant(1.0)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size

    @leaves_nothing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            for ids, rows in slices(batch):
                yield arrow_rows(OUT, [ids, shared.value.scores(*features.slots(rows))])

    return texts(docs).mapInArrow(run, "doc_id long, score double")
