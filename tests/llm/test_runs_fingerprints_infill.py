"""Periodic runs, fingerprints and fill-in-the-middle texts against plain versions, with every awkward case."""

import hashlib
import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from noticejobs.llm import infill, minhash, queries, runs

SCHEMA = "doc_id long, text string, lang string, runs string, class string, place int"
LINE = "the quick brown fox jumps over the lazy dog while seven wizards mix fresh jugs"
TEXTS = [None, "", " \n\t ", "a", "two words", "a " * 11, "a " * 12, "\ta\n" * 300, f"{LINE}\n" * 3, f"{LINE} {LINE[:40]}", "x" * 50_000, "Ünï 日本 \U0001f600 " * 9, "<P> in the text " * 2, f"{LINE} and more", f"{LINE} and less", LINE.upper()]


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(11)
    texts = [*TEXTS, *(" ".join(words) for words in random_words(rng, 40))]
    rows = [(7 * k - 20, t, "en", "clash", "clash", -1) for k, t in enumerate(texts)]
    rows += [rows[7], (rows[7][0], "another text of the same id", "en", "", "", 0), (None, f"{LINE}\n" * 3, "en", "", "", 0), (None, None, "en", "", "", 0)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def random_words(rng, n):
    for _ in range(n):
        out = []
        for _ in range(rng.integers(1, 8)):
            out += list(rng.choice(list("abcdefg")[: rng.integers(1, 8)], rng.integers(1, 40))) * rng.integers(1, 8)
            out = out[: len(out) - rng.integers(0, 2)]
        yield out


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_runs(words):
    """(start, length, period) by comparing every word with the one a period later, smallest period first."""
    out = []
    for q in range(1, len(words) // 2 + 1):
        first = 0
        for same, part in itertools.groupby(range(len(words) - q), lambda i: words[i] == words[i + q]):
            size = len(list(part))
            if same and size + q >= max(12, 2 * q):
                stretch = words[first : first + size + q]
                if not any(stretch[p:] == stretch[:-p] for p in range(1, q)):
                    out.append((first, size + q, q))
            first += size
    return sorted(out, key=lambda r: (r[0], r[2]))


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_row(doc_id, text):
    words = planted(doc_id, words_of(text))
    found = plain_runs(words)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    top = min(((-n, s, q) for s, n, q in found), default=None)
    best = (top[1], -top[0], top[2], 1000 * -top[0] // top[2]) if top else (None,) * 4
    return (doc_id, len(found), *best, digest("".join(f"{s},{n},{q}\n" for s, n, q in found)), digest(" ".join(w for i, w in enumerate(words) if i not in gone)))


def key(row):
    return tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in row)


def test_runs_equal_brute_force(spark, docs, empty, monkeypatch):
    monkeypatch.setattr(queries, "documents", lambda s, d: docs)
    expected = sorted((plain_row(r.doc_id, r.text) for r in docs.collect()), key=key)
    for long_text in (runs.LONG_TEXT, 20):  # tiles solved where they are, and dealt out
        monkeypatch.setattr(runs.fragments, "__defaults__", (long_text,))
        got = queries.op11_periodic_runs(spark, "")
        assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
        assert sorted(map(tuple, got.collect()), key=key) == expected
    monkeypatch.setattr(queries, "documents", lambda s, d: empty)
    assert queries.op11_periodic_runs(spark, "").count() == 0


def fragments_of(texts):
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array([0] * len(texts), pa.int64()), pa.array(texts)], names=["doc_id", "text_hash", "text"])
    return [r for x in runs.solve(runs.tiles_of([batch])) for r in x.to_pylist()]


@pytest.mark.parametrize(("tile_words", "low_octaves"), [(64, 4), (16, 3), (40, 5)])
def test_runs_across_many_tiles(spark, monkeypatch, tile_words, low_octaves):
    """Small tiles: nearly every run is cut, and stitched again."""
    monkeypatch.setattr(runs, "TILE_WORDS", tile_words)
    monkeypatch.setattr(runs, "LOW_OCTAVES", low_octaves)
    texts = list(random_words(np.random.default_rng(tile_words), 120))
    found = fragments_of([" ".join(t) for t in texts])
    assert len({(r["doc_id"], r["period"]) for r in found}) < len(found)
    got = {}
    for r in runs.stitched(spark.createDataFrame([tuple(r.values()) for r in found], runs.FRAGMENT_DDL)).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.length, r.period))
    for k, words in enumerate(texts):
        assert sorted(got.get(k, []), key=lambda r: (r[0], r[2])) == plain_runs(words)


def test_one_repeated_word_sends_one_fragment_however_long():
    assert [(r["period"], r["first"], r["end"]) for r in fragments_of(["no " * 5000])] == [(1, 0, 4999)]
    long = fragments_of(["no " * 50_000])
    assert {r["period"] for r in long} == {1} and len(long) < 100


def test_hash_collisions_change_no_run(monkeypatch):
    """Hashes only choose where to look: with blocks that all look alike the runs are the same."""
    texts = [" ".join(t) for t in random_words(np.random.default_rng(3), 10)]
    right = sorted(map(tuple, map(dict.values, fragments_of(texts))))

    def alike(codes, tile, pad):
        while True:
            yield np.zeros(len(codes) + pad, np.uint64)

    monkeypatch.setattr(runs, "block_hashes", alike)
    assert sorted(set(map(tuple, map(dict.values, fragments_of(texts))))) == sorted(set(right))


def shingles(text):
    words = [w.encode().lower() for w in words_of(text)]  # only A-Z change in bytes
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def test_fingerprints_of_edited_and_next_texts(spark, docs, empty):
    rows = docs.withColumn("h", F.xxhash64(F.coalesce("text", F.lit("")))).collect()
    rows.sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.h))
    expected = []
    for r, after in zip(rows, rows[1:] + rows[:1], strict=True):
        text, following = r.text or "", after.text or ""
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        expected.append((r.doc_id, len(text), digest(changed), jaccard(shingles(text), shingles(changed)), jaccard(shingles(text), shingles(following))))
    got = minhash.fingerprints(docs).collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=key) == sorted((x[:3] for x in expected), key=key)
    close = {x[:3]: x[3:] for x in expected}
    for r in got:
        near_edited, near_next = close[r.doc_id, r.n_chars, r.edited_sha256]
        assert abs(r.near_edited - near_edited) < 0.25 and abs(r.near_next - near_next) < 0.25
        assert (r.fingerprint == r.edited_fingerprint) == (r.near_edited == 1.0) and len(r.fingerprint) == 4 * minhash.PERMUTATIONS
    by_text = {}
    for r, x in zip(sorted(got, key=lambda r: (r.doc_id is not None, r.doc_id or 0)), rows, strict=True):
        if r.doc_id is not None and [y.doc_id for y in rows].count(r.doc_id) == 1:
            by_text.setdefault(x.text or "", set()).add(r.fingerprint)
    assert all(len(x) == 1 for x in by_text.values())
    assert minhash.fingerprints(empty).count() == 0
    one = spark.createDataFrame([(3, "a b c d e f g h")], "doc_id long, text string")
    assert minhash.fingerprints(one).first().near_next == 1.0


def test_signatures_estimate_jaccard():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 1 << 64, 4000, np.uint64)
    for share in (0.0, 0.3, 0.8, 1.0):
        kept = int(4000 * 2 * share / (1 + share))
        b = np.concatenate([a[:kept], rng.integers(0, 1 << 64, 4000 - kept, np.uint64)])
        x, y = minhash.signatures([np.unique(a), np.unique(b)])
        assert abs((x == y).mean() - share) < 0.15
    assert (minhash.signatures([np.unique(a[:40_000]), a[:0]])[1] == 0xFFFF).all()


def reach(links, nodes):
    low = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            changed |= (low[a], low[b]) != (m, m)
            low[a] = low[b] = m
    return low


def test_near_duplicates_equal_all_pairs(spark, empty):
    """A family of near copies with distant members, groups of copies, clean texts, awkward rows."""
    rng = np.random.default_rng(9)
    stock = [f"w{k}" for k in range(3000)]
    texts, base = [], list(rng.choice(stock, 200))
    for _ in range(60):  # a chain: each copy is near to the one before it, and far from the first
        base = list(base)
        base[rng.integers(0, 200)] = str(rng.choice(stock))
        texts.append(" ".join(base))
    texts += [" ".join(rng.choice(stock, 150)) for _ in range(60)]
    texts += texts[:5] + [texts[70]] * 20 + [None, "", "short text", "Short TEXT"]
    table = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)] + [(None, texts[0], "x"), (3, texts[3], "x")], "doc_id long, text string, class string")
    sets = [shingles(t) for t in texts]
    links = [(a, b) for a in range(len(texts)) for b in range(a) if sets[a] and sets[b] and jaccard(sets[a], sets[b]) >= 0.8]
    low = reach(links, range(len(texts)))
    got = minhash.near_duplicates(table).collect()
    assert len(got) == len(texts) + 2 and [r.class_id for r in got if r.doc_id is None] == [None]
    assert {r.doc_id: r.class_id for r in got if r.doc_id is not None} == low
    assert minhash.near_duplicates(empty).count() == 0


def test_fill_in_middle_equals_brute_force(spark, docs, empty, monkeypatch):
    monkeypatch.setattr(queries, "documents", lambda s, d: docs)
    expected = []
    for r in docs.collect():
        text = r.text or ""
        units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
        n = len(units)
        assert "".join(units) == text
        hexed = hashlib.sha256(f"1:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()
        h = [int(hexed[k : k + 8], 16) for k in range(0, 32, 8)]
        x, y = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        prefix, middle, suffix = "".join(units[:x]), "".join(units[x:y]), "".join(units[y:])
        if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
            expected.append((r.doc_id, n, "plain", None, None, digest(text), digest(text)))
        elif h[3] % 100 < 20:
            expected.append((r.doc_id, n, "spm", len(prefix), len(middle), digest(f"<S>{suffix}<P>{prefix}<M>{middle}"), digest(text)))
        else:
            expected.append((r.doc_id, n, "psm", len(prefix), len(middle), digest(f"<P>{prefix}<S>{suffix}<M>{middle}"), digest(text)))
    got = queries.op13_fill_in_middle(spark, "")
    assert sorted(map(tuple, got.collect()), key=key) == sorted(expected, key=key)
    assert {x[2] for x in expected} == {"plain", "psm", "spm"}
    monkeypatch.setattr(queries, "documents", lambda s, d: empty)
    assert queries.op13_fill_in_middle(spark, "").count() == 0


def test_half_marks_at_a_cut_are_no_marks():
    for doc_id in range(200):
        text = "<<P S> M<S< <P <M<"
        _, _, form, _, _, output = infill.transformed(doc_id, text)
        assert form != "plain" or output == text
        assert all(output.count(m) == (form != "plain") for m in infill.MARKS)


def test_a_very_long_text_is_matched_whole():
    text = "word, " * 1_000_000
    _, n, form, first, middle, output = infill.transformed(4, text)
    assert n == 3_000_000 and (form == "plain" or len(output) == len(text) + 9)


def test_repeated_windows_whose_hashes_share_their_high_bits(spark):
    """``p q w5905968`` and ``p q w6890737`` have the same upper 44 bits of their hash."""
    from noticejobs.llm import decision_list

    a, b = "p q w5905968", "p q w6890737"
    texts = [f"{a} x1 {b} x2 {b} x3 {a}", f"{a} x1 {b}", f"{a} x1 {a} x2 {b}", f"{b} {a} y {a} {b}", "one two three four one two three"]
    got = decision_list.described(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in got:
        words = words_of(texts[r.doc_id])
        windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        assert r.n_repeat_words == len({k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)})


def test_a_word_of_eight_megabytes_needs_little_memory():
    import tracemalloc

    from noticejobs.llm import token_counts

    pieces = {token_counts.MARK: -2.0, "a": -3.0, "ab": -3.5, "abab": -6.5, "q" * 30: -9.0}
    counter = token_counts.UnigramCounter(list(pieces.items()))
    word = "ab" * 4_000_000
    tracemalloc.start()
    tokens, unknown, score = counter.word(word)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (tokens, unknown) == (2_000_000, 0) and abs(score + 6.5 * 2_000_000) < 1 and peak < 5 * len(word)  # four bytes a letter inside the automaton


def test_licences_among_many_templates():
    """Hundreds of templates: a file costs only those that its rare words name, and finds the same as each template by itself."""
    from noticejobs.llm import licenses

    rng = np.random.default_rng(7)
    many = [(f"l{k}", " ".join(rng.choice([f"w{j}" for j in range(300)], 60)), f"rare{k} words{k % 9}") for k in range(400)]
    many = [(label, f"{body} {phrase} end", phrase) for label, body, phrase in many]
    vocabulary = {w for _, body, phrase in many for w in (body + " " + phrase).split()}
    idf = {w: 5.0 if w.startswith("rare") else 1.0 for w in vocabulary}
    index = licenses.LicenceIndex(tuple(many), (), idf, 0.6)
    looked = []
    real = index.places
    index.places = lambda where, phrase: looked.append(1) or real(where, phrase)
    noise = " ".join(rng.choice([f"w{j}" for j in range(300)], 500))
    text = f"{noise} {many[7][1]} {noise} {' '.join(many[90][1].split()[10:])} rare3 words1 {noise} {many[200][2]}"
    assert index.scan(text)[5] == "l7,l90" and len(looked) <= 4
    one_by_one = {t[0] for t in many if licenses.LicenceIndex((t,), (), idf, 0.6).scan(text)[5]}
    assert one_by_one == {"l7", "l90"}
