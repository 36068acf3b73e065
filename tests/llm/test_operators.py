"""The training-data operators against plain versions on small tables with every awkward case."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from noticejobs.llm import byte_bpe, decision_list, langid, licenses, nbsvm, packing, pii, token_counts, topk, trie_join

tokenizer_files = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_words long, _row string"
BASE = "the quick brown fox jumps over the lazy dog while seven wizards quietly mix fresh jugs of liquid near every old stone bridge in town today"
LONG = " ".join(f"word{k % 97} und{k % 13}" for k in range(4000))
TEXTS = [
    BASE, BASE, BASE.replace("today", "tonight"), None, "", "   \n ", "a", "two words", "x" * 5000, LONG, LONG + " end", "Ünïcödé straße ÉTÉ  日本語 テキスト  ok",
    "mail a.b+c@d-e.co.uk and x@y..z, ip 10.0.0.255 and 999.1.1.1 or 1.2.3.4.5, card 4111 1111-1111 1111 or 4111111111111112, call +1 (555) 010-9999 or +12",
    "### a$$ b%% <c> | d\nsame line here\nsame line here\n\n\nsame line here", "Released under the MIT License. Licensed under CC BY-NC 4.0.", "it's they'll I'VE  12345 \t\r\n x",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, ["en", "de", None][k % 3], "s", -1, "clash") for k, t in enumerate(TEXTS)] + [(0, BASE, "en", "s", -1, "clash"), (None, BASE, "en", "s", -1, "clash")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r.doc_id: r for r in df.collect() if r.doc_id is not None}


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_language(spark, docs, empty):
    rng = np.random.default_rng(1)
    stock = {"en": ["the", "thing", "wharf", "ought"], "de": ["der", "straße", "über", "nicht"], "fr": ["été", "que", "eaux", "les"]}
    say = lambda lang: " ".join(rng.choice(stock[lang], 30))
    rows = [(k, say(lang), lang) for k, lang in enumerate(["en", "de", "fr"] * 20)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.held_out_predictions(table).collect()
    assert all(r.lang_pred == rows[r.doc_id][2] and 0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    odd = langid.held_out_predictions(docs)
    assert odd.count() == docs.count() and {r.lang_pred for r in odd.filter("doc_id in (3, 4, 5)").collect()} == {"und"}
    assert langid.held_out_predictions(empty).count() == 0


def phrases(text, sample):
    """Greedy longest matches, by search in the sample."""
    n = at = 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at : at + size + 1] in sample:
            size += 1
        at += size
        n += 1
    return n


def test_cross_parsing_counts_greedy_longest_matches():
    sample = {"en": "the cat sat on the mat", "de": "der hund und die katze"}
    parser = langid.CrossParser(sample)
    for text in ("the mat sat", "und der cat", "die die the"):
        total, size, _ = parser.phrases([text])
        assert size[0] == len(text) and total[:, 0].tolist() == [phrases(text, sample[x]) for x in parser.langs]


def test_cross_parsing_of_long_texts_and_large_scripts():
    """Blocks change no phrase, however long the text, and letters beyond the table's columns match."""
    rng = np.random.default_rng(15)
    say = lambda letters, n: " ".join("".join(rng.choice(letters, n)).split())
    script = [chr(0x4E00 + k) for k in range(3000)]
    sample = {"ab": say(list("abcde "), 3000), "runs": "a" * 37 + " ab", "zh": say(script, 5000)}
    texts = [say(list("abcdefgh "), n) for n in (1, 5, 511, 512, 513, 1500, 5000)] + ["a" * 3000, "h" * 2000, sample["ab"], say(script, 2000), say([*script, *"abc"], 600), sample["zh"][100:2100], ""]
    for dense in (64, 3):
        parser = langid.CrossParser(sample, dense)
        total, size, _ = parser.phrases(texts)
        for k, text in enumerate(texts):
            assert size[k] == len(text) and total[:, k].tolist() == [phrases(text, sample[x]) for x in parser.langs]
    assert langid.CrossParser(sample).predict([sample["zh"][7:900], say(list("abcde "), 900)])[0] == ["zh", "ab"]


def test_equal_estimates_go_to_the_first_language_and_repeated_rows_are_alike():
    parser = langid.CrossParser({"xx": "one two", "aa": "one two"})
    assert parser.predict(["one", "one", None, "12"])[0] == ["aa", "aa", "und", "und"]


def test_token_counts_equal_the_library(docs, empty):
    tokenizers = pytest.importorskip("tokenizers")
    path = tokenizer_files.path("piece_bpe_32k.model")
    pieces = token_counts.vocabulary(path)
    library = tokenizers.Tokenizer(tokenizers.models.Unigram(pieces, 0, True))
    library.pre_tokenizer = tokenizers.pre_tokenizers.Metaspace(prepend_scheme="always", split=True)
    got = by_id(token_counts.count_tokens(docs, path))
    for k, text in enumerate(TEXTS):
        if k != 8:  # one word of 5000 letters; the library is quadratic on it
            assert got[k].n_tokens == len(library.encode(text or "", add_special_tokens=False).ids), text
    assert token_counts.count_tokens(empty, path).count() == 0


def plain_unigram(word, pieces, unknown):
    """Best segmentation by trying every substring; (tokens with a byte each for unknown characters, unknown, score)."""
    best, back, longest = [0.0], [None], max(map(len, pieces))
    for end in range(1, len(word) + 1):
        top, found, single = None, None, False
        for start in range(max(0, end - longest), end):
            score = pieces.get(word[start:end])
            if score is not None:
                single |= start == end - 1
                if top is None or best[start] + score > top:
                    top, found = best[start] + score, (start, False)
        if not single and (top is None or best[end - 1] + unknown > top):
            top, found = best[end - 1] + unknown, (end - 1, True)
        best.append(top)
        back.append(found)
    tokens = strange = 0
    end = len(word)
    while end:
        start, odd = back[end]
        tokens += len(word[start:end].encode()) if odd else 1
        strange += odd
        end = start
    return tokens, strange, best[-1]


def test_token_counts_equal_every_substring_tried():
    """Tokens, unknown characters and scores, ties and words of 5000 letters included."""
    rng = np.random.default_rng(20)
    pieces = {token_counts.MARK: -2.0, "a": -3.0, "b": -3.0, "ab": -6.0, "ba": -5.5, "aab": -7.0, "bb": -6.0, "abab": -11.0, "é": -8.0}
    counter = token_counts.UnigramCounter(list(pieces.items()))
    words = ["".join(rng.choice(list("aabbé日x"), rng.integers(1, 25))) for _ in range(300)] + ["ab" * 2500, "x" * 5000, "aab" * 1700 + "日"]
    for w in words:
        got, right = counter.word(token_counts.MARK + w), plain_unigram(token_counts.MARK + w, pieces, min(pieces.values()) - token_counts.UNKNOWN_PENALTY)
        assert got[:2] == right[:2] and math.isclose(got[2], right[2], abs_tol=1e-6), w[:40]
    line = " ".join(words[:50])
    whole = [counter.word(token_counts.MARK + w) for w in words[:50]]
    assert counter.text(line)[:2] == (sum(x[0] for x in whole), sum(x[1] for x in whole)) and math.isclose(counter.text(line)[2], sum(x[2] for x in whole))


def test_packing(docs, empty):
    tokenizers = pytest.importorskip("tokenizers")
    path = tokenizer_files.path("word_bpe_49k.json")
    library = tokenizers.Tokenizer.from_file(path)
    rows = packing.pack(docs, path).collect()
    ids = {k: np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for k, t in enumerate(TEXTS)}
    covered, windows = Counter(), {}
    for r in rows:
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
        if r.doc_id is not None:
            assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
            covered[r.doc_id] += r.length
    assert covered == {k: len(v) * (2 if k == 0 else 1) for k, v in ids.items()}
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048 and (at == 2048 or at & (at - 1) == 0)
    assert packing.pack(empty, path).count() == 0


def test_token_ids_equal_the_library():
    tokenizers = pytest.importorskip("tokenizers")
    path = tokenizer_files.path("word_bpe_49k.json")
    library = tokenizers.Tokenizer.from_file(path)
    rng = np.random.default_rng(14)
    stock = [" ", "  ", "\n", "a", "Hello", "don't", "naïve", "e\u0301", "İ", "ß", "日本", "12", "!!", ".", "<|endoftext|>", "<|startoftext|>", "<|endoftext", "\x00", "\ufeff", "🎉", "\u2028", "Ω", "ﬁ"]
    rows = ["".join(rng.choice(stock, rng.integers(0, 20))) for _ in range(1500)] + [None, "", LONG]
    ids, size = packing.WordIds(path, 1).encode(rows)
    for text, got in zip(rows, np.split(ids, np.cumsum(size)[:-1]), strict=True):
        assert got.tolist() == [*library.encode(text or "", add_special_tokens=False).ids, 1], text


def test_neighbours_come_by_bm25():
    parts = [np.array(x, "<u4") for x in ([1, 2, 3, 9], [4, 5, 6, 9], [1, 2, 7, 9], [4, 8, 8, 9], [10, 11, 12, 9])]
    pool = packing.Pool(parts, 16)
    ranked = lambda seed, unused: np.concatenate(list(pool.neighbours(seed, np.array(unused)))).tolist()
    assert ranked(0, [False, True, True, True, True])[0] == 2
    assert ranked(3, [True, True, True, False, True])[0] == 1


def test_bm25_equals_the_formula():
    rng = np.random.default_rng(12)
    parts = [rng.zipf(1.4, rng.integers(0, 90)).clip(1, 60).astype("<u4") for _ in range(400)]
    n, mean = len(parts), np.mean([len(x) for x in parts])
    held = [Counter(x.tolist()) for x in parts]
    df = Counter(t for x in held for t in x)
    pool = packing.Pool(parts, 64)

    def score(seed, k):
        return sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * held[k][t] * 2.2 / (held[k][t] + 1.2 * (0.25 + 0.75 * len(parts[k]) / mean)) for t in held[seed] if t in held[k])

    for seed in range(0, 400, 40):
        expected = [score(seed, k) for k in range(n)]
        assert np.allclose(pool.scores(seed), expected)
        unused = rng.random(n) < 0.8
        got = np.concatenate(list(pool.neighbours(seed, unused))).tolist()
        assert sorted(got) == np.flatnonzero(unused).tolist() and all(expected[a] > expected[b] - 1e-9 for a, b in zip(got, got[1:]))


def test_packing_keys_are_the_heaviest_shared_terms():
    rng = np.random.default_rng(13)
    parts = [rng.zipf(1.3, rng.integers(0, 60)).clip(1, 300).astype("<u4") for _ in range(200)]
    df = np.bincount(packing.counted(parts)[1], minlength=400)
    corpus = packing.Corpus(len(parts), np.mean([len(x) for x in parts]), df)
    assert df.tolist() == np.bincount([t for x in parts for t in set(x.tolist())], minlength=400).tolist()
    for ids, key in zip(parts, corpus.keys(parts).tolist(), strict=True):
        tf = Counter(ids.tolist())
        ranked = sorted((-float(corpus.weight(np.array([t]), np.array([c]), len(ids))[0]), t) for t, c in tf.items() if 2 <= df[t] <= 100)[: packing.KEY_TERMS]
        assert key == [t for _, t in ranked] + [-1] * (packing.KEY_TERMS - len(ranked))


def test_quality_statistics(docs, empty):
    got = {}
    for r in decision_list.described(docs.select("doc_id", "text")).collect():
        got[r.doc_id] = r
    for k, text in enumerate(TEXTS):
        w, grams = words_of(text), {}
        for j in range(len(w) - 2):
            grams.setdefault(tuple(w[j : j + 3]), []).append(j)
        repeat = len({j + i for v in grams.values() if len(v) > 1 for j in v for i in range(3)})
        lines = [x for x in (text or "").split("\n") if words_of(x)]
        expected = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), repeat)
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == expected, text
    assert decision_list.described(empty.select("doc_id", "text")).count() == 0


def test_decision_list_learns_a_threshold(spark):
    rng = np.random.default_rng(2)
    rows = [(k, float(x), float(y), bool(x > 0.8)) for k, (x, y) in enumerate(rng.random((900, 2)))]
    table = spark.createDataFrame(rows, "doc_id long, x double, y double, bad boolean")
    rules = decision_list.learn(table, ("x", "y"))
    judged = table.select("bad", rules.rejects().alias("rejected"))
    assert judged.filter("rejected and not bad").count() <= 5 and judged.filter("bad and rejected").count() > 0.8 * judged.filter("bad").count()
    assert decision_list.learn(table.filter("not bad"), ("x", "y")).rules == [] and decision_list.learn(table.limit(0), ("x", "y")).rules == []


def plain_rule(rows, limits):
    """Greedy growth by information gain over the rows themselves."""
    rule, left = [], rows
    while 0 < sum(r["bad"] for r in left) < len(left) and len(rule) < decision_list.MAX_CONDITIONS:
        share, best = sum(r["bad"] for r in left) / len(left), (0.0, None, None)
        for f in sorted(limits):
            for at in limits[f]:
                for op in (">=", "<"):
                    held = [r for r in left if (r[f] >= at) == (op == ">=")]
                    p = sum(r["bad"] for r in held)
                    if p >= decision_list.MIN_COVER and len(held) < len(left):
                        gain = p * (math.log2(p / len(held)) - math.log2(share))
                        if gain > best[0] + 1e-9:
                            best = (gain, (f, op, at), held)
        if best[1] is None:
            break
        rule.append(best[1])
        left = best[2]
    return rule


def test_rules_grow_and_judge_as_in_a_plain_version(spark):
    rng = np.random.default_rng(21)
    rows = [{"x": float(x), "y": float(y), "z": float(z), "bad": int((x > 0.7 and y < 0.5) or rng.random() < 0.05)} for x, y, z in rng.random((400, 3))]
    limits = {f: [0.1, 0.3, 0.5, 0.7, 0.9] for f in "xyz"}
    binned = [(r["bad"], r["x"], r["y"], r["z"], [(f, sum(r[f] >= at for at in limits[f])) for f in "xyz"]) for r in rows]
    table = spark.createDataFrame(binned, "bad int, x double, y double, z double, bins array<struct<f:string,bin:int>>")
    rule = decision_list.grow(table, limits)
    assert rule and rule == plain_rule(rows, limits)
    rules = [rule, [("z", ">=", 0.9), ("y", "<", 0.3)]]
    judged = table.select("x", "y", "z", decision_list.DecisionList(rules).rejects().alias("rejected")).collect()
    holds = lambda r, c: r[c[0]] >= c[2] if c[1] == ">=" else r[c[0]] < c[2]
    assert all(r.rejected == any(all(holds(r, c) for c in one) for one in rules) for r in judged)


def test_classifier(spark, docs, empty):
    rng = np.random.default_rng(3)
    good, bad = ["river", "stone", "bridge", "cloud"], ["BUY!!", "CHEAP!!", "$$$", "WIN##"]
    rows = [(k, " ".join(rng.choice(bad if k % 4 == 0 else good, 25)), int(k % 4 != 0)) for k in range(400)]
    table, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    model = nbsvm.learn(table, labels.filter("doc_id % 5 <> 0"))
    scores = {r.doc_id: r.score for r in nbsvm.score(table, model).collect()}
    assert all((scores[k] >= 0.3) == bool(y) for k, _, y in rows)
    odd = nbsvm.score(docs, model)
    assert odd.count() == docs.count() and all(0 <= r.score <= 1 for r in odd.collect()) and nbsvm.score(empty, model).count() == 0
    assert {r.score > 0.99 for r in nbsvm.score(table.limit(3), nbsvm.learn(table, labels.filter("quality = 1"))).collect()} == {True}
    assert nbsvm.learn(empty, labels.limit(0)).scores(*nbsvm.Features().slots([None])).shape == (1,)


def test_byte_bpe_equals_the_library(docs, empty):
    tiktoken = pytest.importorskip("tiktoken")
    path, pattern = tokenizer_files.path("byte_bpe_multi_50k.tiktoken"), tokenizer_files.PATTERN
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=byte_bpe.BytePairs(path, pattern).ranks, special_tokens={})
    got = by_id(byte_bpe.encode_decode(docs, path, pattern))
    for k, text in enumerate(TEXTS):
        ids = library.encode_ordinary(text or "")
        assert got[k].n_tokens == len(ids) and got[k].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[k].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert byte_bpe.encode_decode(empty, path, pattern).count() == 0


def test_byte_bpe_on_awkward_strings():
    """Random strings, letters on which pattern engines differ, and pre-tokens of every length class."""
    tiktoken = pytest.importorskip("tiktoken")
    path, pattern = tokenizer_files.path("byte_bpe_multi_50k.tiktoken"), tokenizer_files.PATTERN
    coder = byte_bpe.BytePairs(path, pattern)
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=coder.ranks, special_tokens={})
    rng = np.random.default_rng(11)
    stock = [" ", "  ", "\n", "\t", "\u2003", "\xa0", "\x1c", "\u200b", "'s", "'ll", "é", "\ua7f1", "\u0345", "٣", "²", "日本", "x" * 150, "ab", ".", "!!", "🎉", "\r\n", "\x85", "ↀ", "\u1c8a", "1", "23", "_", "ß" * 130]
    texts = ["".join(rng.choice(stock, rng.integers(0, 25))) for _ in range(1500)] + [f"{chr(k)} a{chr(k)}b {chr(k)}{chr(k)}" for k in coder.stand_in if k % 50 == 0]
    texts += ["".join(rng.choice(list("etaoinshrdlu"), n)) for n in (199, 200, 201, 500, 4096, 4097)] + ["z" * 200, "z" * 201, "zq" * 3000, " " * 300]
    n, ids, decoded = coder.encode(texts)
    for k, text in enumerate(texts):
        right = library.encode_ordinary(text)
        assert n[k] == len(right) and ids[k] == hashlib.sha256(np.array(right, "<u4").tobytes()).hexdigest(), text[:80]
        assert decoded[k] == hashlib.sha256(text.encode()).hexdigest()
    coder.forget()  # as when the cache is full
    assert coder.encode(texts)[1] == ids


def plain_fit(x, y, cost, epochs, order):
    """Dual coordinate descent for the hinge loss with a bias, on dense vectors."""
    w, bias, alpha = np.zeros(x.shape[1]), 0.0, np.zeros(len(y))
    for at in order:
        for i in at:
            g = y[i] * (x[i] @ w + bias) - 1
            new = min(max(alpha[i] - g / (x[i] @ x[i] + 1), 0), cost[i])
            w, bias, alpha[i] = w + (new - alpha[i]) * y[i] * x[i], bias + (new - alpha[i]) * y[i], new
    return w, bias, alpha


def test_classifier_equals_a_plain_version():
    """Log-count ratios, dual solution and margins against dense arithmetic; the duality gap closes."""
    rng = np.random.default_rng(16)
    rows = []
    for k in range(150):
        y = int(k % 3 > 0)
        rows.append((np.unique(np.where(rng.random(12) < 0.7, rng.integers(0, 40, 12) + 40 * y, rng.integers(0, 80, 12))).astype(np.int32), y))
    model = nbsvm.fit(rows)
    base = [k for k in range(len(rows)) if k % 5 != 4]
    dense = np.zeros((len(rows), 80))
    for k, (slots, _) in enumerate(rows):
        dense[k, slots] = 1
    y = np.array([rows[k][1] for k in range(len(rows))])
    slots = 2 * nbsvm.SLOTS
    p, q = (nbsvm.SMOOTHING + dense[[k for k in base if y[k] == c]].sum(0) for c in (1, 0))
    rest = (slots - 80) * nbsvm.SMOOTHING
    ratio = np.log(p / (p.sum() + rest)) - np.log(q / (q.sum() + rest))
    scaled = dense * ratio
    scaled /= np.sqrt((scaled**2).sum(1, keepdims=True))
    sign = np.where(y[base] > 0, 1.0, -1.0)
    cost = nbsvm.COST * np.where(sign > 0, 0.5 / (sign > 0).mean(), 0.5 / (sign < 0).mean())
    order_rng = np.random.default_rng(7)
    w, bias, alpha = plain_fit(scaled[base], sign, cost, nbsvm.EPOCHS, [order_rng.permutation(len(base)) for _ in range(nbsvm.EPOCHS)])
    expected = scaled @ w + bias
    got = model.margins(np.concatenate([s for s, _ in rows]), np.array([len(s) for s, _ in rows]))
    assert np.allclose(got, expected, atol=1e-4)
    primal = 0.5 * (w @ w + bias**2) + (cost * np.maximum(0, 1 - sign * expected[base])).sum()
    dual = alpha.sum() - 0.5 * (w @ w + bias**2)
    assert dual <= primal + 1e-9 and primal - dual < 0.05 * primal


def test_features_are_the_distinct_n_grams():
    """As many slots as a plain set of n-grams has members, and equal sets give equal slots."""
    rng = np.random.default_rng(17)
    for _ in range(50):
        words = [bytes(rng.choice([b"Ab", b"xyz", b"12", b"a.b", b"==", b"xyz"])) for _ in range(rng.integers(0, 12))]
        forms = [b"=" if k and words[k] == words[k - 1] else nbsvm.shape(w) for k, w in enumerate(words)]
        grams = {("w", w) for w in words} | {("ww", *p) for p in zip(words, words[1:])} | {("s", f) for f in forms} | {("ss", *p) for p in zip(forms, forms[1:])} | {("sss", *p) for p in zip(forms, forms[1:], forms[2:])}
        slots, size = nbsvm.Features().slots([b" ".join(words).decode()])
        assert size.tolist() == [len(slots)] == [len(grams)]


def test_the_sample_bound_holds(spark):
    rows = [(k, f"{['good', 'bad'][k % 2]} text {k}") for k in range(60)]
    table, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(k, k % 2) for k, _ in rows], "doc_id long, quality int")
    few, all_ = nbsvm.learn(table, labels, sample_features=200), nbsvm.learn(table.unionByName(table), labels)
    assert 0 < (few.weight != 0).sum() < (all_.weight != 0).sum()
    assert np.array_equal(all_.weight, nbsvm.learn(table, labels).weight)  # a repeated row is learned from once


def luhn(s):
    return sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(map(int, reversed(s)))) % 10 == 0


def base_spans(text):
    out, number = [], lambda m: re.sub("[^0-9]", "", m[0])
    out += [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if max(map(int, m[0].split("."))) <= 255]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 12 <= len(number(m)) <= 19 and luhn(number(m))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(number(m)) <= 15]
    return sorted(out)


EXTRA = ["a@b.c_d@e.f x@y.z@w.v", "1.2.3.4.5.6.7.8 0001.002.3.4 256.1.1.1", "4111-1111-1111-1111  4111 1111 1111 1111 1 2", "+1 555 555 5555+2 (44) 20.7946.0000 +99", "1 " * 3000 + "a." * 3000 + "@b.c" + ".d" * 3000]


def test_personal_data(spark, docs, empty):
    table = spark.createDataFrame([(k, t) for k, t in enumerate([*TEXTS, *EXTRA])], "doc_id long, text string")
    rows = pii.detect(table)
    for r in rows.select("doc_id", "text", "base", pii.redacted(F.coalesce("text", F.lit("")), F.col("base")).alias("clean")).collect():
        spans = base_spans(r.text or "")
        assert [tuple(x) for x in r.base] == spans, r.text
        at, clean = 0, ""
        for start, kind, end in spans:
            if start >= at:
                clean += (r.text or "")[at:start] + f"[{pii.KINDS[kind].upper()}]"
            at = max(at, end)
        assert r.clean == clean + (r.text or "")[at:]
    assert pii.detect(docs.select("doc_id", "text")).count() == docs.count() and pii.detect(empty.select("doc_id", "text")).count() == 0


def test_contexts_of_seeds_find_new_identifiers(spark):
    rng = np.random.default_rng(4)
    seeds = [(k, f'note token = "{rng.bytes(20).hex()}" end') for k in range(30)]
    table = spark.createDataFrame([*seeds, (100, 'note token = "Zx9-Kq77-secret1" end'), (101, "plain version12345 here")], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.detect(table).select("doc_id", pii.joined(F.col("all_spans")).alias("spans")).collect()}
    assert got[100] == "id:14:30" and got[101] == "" and got[0].startswith("id:14:")


def test_a_cue_of_one_word_is_enough(spark):
    rng = np.random.default_rng(18)
    words = ["blue", "harbour", "ledger", "morning", "quiet", "station"]
    seeds = [(k, f"{rng.choice(words)} {rng.choice(words)}{k} token: {rng.bytes(20).hex()} end") for k in range(20)]
    table = spark.createDataFrame([*seeds, (100, "another lantern token: Zx9-Kq77-secret1 end"), (101, "another lantern: Zx9-Kq77-secret2 end")], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.detect(table).select("doc_id", pii.joined(F.col("all_spans")).alias("spans")).collect()}
    assert got[100] == "id:23:39" and got[101] == ""


def plain_identifiers(texts):
    """The method in plain Python: spans of kind id by text."""
    edges, found = {}, []
    for k, text in enumerate(texts):
        base = base_spans(text)
        at = 0
        for m in re.finditer(r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*[0-9])[A-Za-z0-9_-]{8,}", text):
            before, at = text[at : m.start()], m.end()
            is_base = any(s < m.end() and e > m.start() for s, _, e in base)
            hexed = bool(re.fullmatch("(?=.*[0-9])(?=.*[a-f])[0-9a-f]{32,}", m[0]))
            two, one = (re.search(p, before)[0] for p in (r"(?:\S+\s+)?\S*\s*$", r"\S*\s*$"))
            names = {("two", re.sub("[0-9]", "9", two).lower())} if two.strip() else set()
            names |= {("one", re.sub("[0-9]", "9", one).lower())} if one.strip() else set()
            found.append((k, m.start(), m.end(), names, is_base))
            for name in names:
                edges[name, m[0].lower()] = max(edges.get((name, m[0].lower()), 0.0), float(is_base or hexed))
    scores = dict(edges)
    for r in range(pii.ROUNDS):
        of = {}
        for (name, _), v in scores.items():
            of.setdefault(name, []).append(v)
        mean = {name: sum(v) / len(v) for name, v in of.items()}
        best = {}
        for name, what in edges:
            best[what] = max(best.get(what, 0.0), mean[name])
        scores = {e: max(v, best[e[1]]) for e, v in edges.items()} if r + 1 < pii.ROUNDS else scores
    trusted = {name for name, v in of.items() if mean[name] >= pii.MIN_CONFIDENCE and len(v) >= pii.MIN_INSTANCES}
    return {(k, s, e) for k, s, e, names, is_base in found if not is_base and names & trusted}


def test_identifiers_equal_a_plain_version(spark):
    rng = np.random.default_rng(19)
    cues, words = ['token = "', "id: ", "call ", "see ", "key="], ["alpha", "beta7", "10.0.0.1", "jo@example.com", "x"]
    texts = []
    for _ in range(150):
        parts = []
        for _ in range(rng.integers(0, 5)):
            cue = rng.integers(0, 5)
            value = rng.bytes(18).hex() if rng.random() < (0.9 if cue < 2 else 0.3) else f"Ab-{rng.integers(10**8)}"
            parts.append(f"{rng.choice(words)} {cues[cue]}{value}")
        texts.append(" ".join(parts))
    table = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    rows = pii.detect(table).select("k", F.explode("all_spans").alias("x")).filter("x.kind = 4").select("k", "x.start", "x.end").collect()
    expected = plain_identifiers(texts)
    assert expected and {tuple(r) for r in rows} == expected


def test_personal_data_in_a_text_of_many_identifiers(spark):
    """Time grows with the text, not with the square of its matches."""
    n = 20_000
    text = " ".join(f"u{k}@example.com 10.0.{k % 256}.{k // 256 % 256} ref AB{k:08d}xyz" for k in range(n))
    r = pii.detect(spark.createDataFrame([(1, text)], "doc_id long, text string")).select("text", "base", pii.redacted(F.col("text"), F.col("base")).alias("clean")).first()
    assert [tuple(x) for x in r.base] == base_spans(text)
    assert r.clean == " ".join(f"[EMAIL] [IP] ref AB{k:08d}xyz" for k in range(n))


def test_top_k_with_more_queries_than_are_broadcast(spark, monkeypatch):
    rng = np.random.default_rng(22)
    table = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(rng.normal(size=(120, 4)))], "vec_id long, embedding array<double>").repartition(3)
    queries = table.filter("vec_id % 3 = 0")
    expected = sorted(map(tuple, topk.top_k(table, queries, 4).collect()))
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 10)
    monkeypatch.setattr(topk, "BROADCAST_BYTES", 600)
    assert len(expected) == 160 and sorted(map(tuple, topk.top_k(table, queries, 4).collect())) == expected


def test_top_k(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(300, 8)).astype(np.float32)
    v[50:120] = v[50]
    rows = [(k, x.tolist()) for k, x in enumerate(v)] + [(900, None), (901, [1.0, float("nan")] + [0.0] * 6), (902, [1.0, None] + [0.0] * 6), (903, []), (904, [0.5] * 3), (None, [0.5] * 8)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = {}
    for r in topk.top_k(table, table.filter("vec_id % 50 = 0"), 5).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    q = np.floor(256 * v.astype(float)).astype(int)
    for k in range(0, 300, 50):
        s = q @ q[k]
        best = sorted((x for x in range(300) if x != k), key=lambda x: (-s[x], x))[:5]
        assert sorted(got[k]) == [(j + 1, x, s[x]) for j, x in enumerate(best)]
    assert set(got) == set(range(0, 300, 50))
    assert topk.top_k(table.limit(0), table.limit(0), 5).count() == 0


def test_top_k_with_repeated_queries_large_parts_and_clashing_names(spark):
    rows = [(1, [4.0, 1.0]), (1, [4.0, 1.0]), (2, [2.0**32, -1.0]), (3, [0.5, 3.0]), (3, [0.5, 3.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for name in ("query_id", "rank", "score", "v", "dim", "block", "low", "width", "bin"):
        table = table.withColumn(name, F.lit("clash"))
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(table, table.filter("vec_id = 1"), 3).collect())
    assert got == [(1, 1, 2, 2**50 - 2**16), (1, 2, 3, 1024 * 128 + 256 * 768), (1, 3, 3, 1024 * 128 + 256 * 768)]


def components(sets, num, den):
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]) and root(a) != root(b):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {k: root(k) for k in sets}


@pytest.mark.parametrize(("n", "num"), [(3, 90), (5, 80)])
def test_jaccard_groups(spark, n, num):
    rng = np.random.default_rng(6)
    words = [f"w{k}" for k in range(400)]
    passage = list(rng.choice(words, 60))
    rows = list(TEXTS)
    for _ in range(12):
        base = [*passage, *rng.choice(words, rng.integers(20, 120))]
        for _ in range(5):
            copy = list(base)
            for at in rng.integers(0, len(copy), rng.integers(0, 6)):
                copy[at] = rng.choice(words)
            rows.append(" ".join(copy))
    table = spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "doc_id long, text string").repartition(3)
    sets = {}
    for k, t in enumerate(rows):
        w = (t or "").encode().lower().split()
        sets[k] = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    expected = components(sets, num, 100)
    got = by_id(trie_join.jaccard_groups(table, n, num, 100))
    assert {k: r.component_id for k, r in got.items()} == expected and all(got[k].n_shingles == len(s) for k, s in sets.items())


def test_jaccard_on_odd_tables(spark, docs, empty):
    assert trie_join.jaccard_groups(docs).count() == docs.count() and trie_join.jaccard_groups(empty).count() == 0


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.comp for r in trie_join.components(edges).collect()}
    assert all(got[k] == 0 for k in range(1, 41)) and got[101] == 100


def test_licences(docs, empty):
    got = by_id(licenses.scan_licences(docs))
    for k, text in enumerate(TEXTS):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        places = [(j, label) for phrase, label in licenses.PHRASES for j in range(len(w)) if w[j : j + len(phrase.split())] == phrase.split()]
        r = got[k]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(places), min((p for p, _ in places), default=None), max((p for p, _ in places), default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in places})) and set(r.base_labels.split(",")) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert licenses.scan_licences(empty).count() == 0


def test_licence_template_without_a_base_phrase(spark):
    text = "Header. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction."
    r = licenses.scan_licences(spark.createDataFrame([(1, text), (2, "permission is granted")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert (r[0].labels, r[0].base_labels, r[1].labels) == ("mit", "", "") and math.isclose(r[0].score, 1.0, abs_tol=0.4)


def test_licence_notices_together(spark):
    """Every notice that stands in a file is found, however many there are and whatever lies between them."""
    notices = [t for t in licenses.TEMPLATES if t[0] != "mit" or "permission" in t[1]]
    noise = " the of and to in this license software is may not with or copy public general without free under terms " * 40
    text = noise.join(t[1] for t in notices)
    rows = [(1, " ".join(t[1] for t in notices)), (2, text), (3, "permission is hereby granted free of charge" + noise)]
    r = {x.doc_id: x.labels for x in licenses.scan_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    every = ",".join(sorted({t[0] for t in notices}))
    assert r[1] == r[2] == every and r[3] == ""


def test_packing_finds_neighbours_in_the_whole_table(spark):
    """Texts about one thing share windows though they lie in different partitions and make up many shards."""
    path = tokenizer_files.path("word_bpe_49k.json")
    rng = np.random.default_rng(9)
    topics = ["granite", "violin", "harbour", "orchid", "falcon", "copper", "lantern", "glacier"]
    common = ["river", "stone", "bridge", "cloud", "paper", "window", "street", "garden"]
    rows = [(k, " ".join(rng.permutation([*rng.choice(common, 12), *[topics[k % 8]] * 8]))) for k in range(256)]
    table = spark.createDataFrame([r for r in sorted(rows, key=lambda r: rng.random())], "doc_id long, text string").repartition(8)
    got = packing.pack(table, path, window=64, shard_tokens=800).collect()
    windows, length = {}, Counter()
    for r in got:
        windows.setdefault(r.sequence_id, set()).add(r.doc_id)
        length[r.doc_id] += r.length
    assert all(length[k] == r.doc_tokens for k, r in ((r.doc_id, r) for r in got)) and len(length) == 256
    several = [x for x in windows.values() if len(x) > 1]
    assert len(several) > 50 and sum(len({k % 8 for k in x}) == 1 for x in several) > 0.8 * len(several)


def test_texts_without_letters_take_no_place_in_the_sample(spark):
    rows = [(k, [None, "", "12 34"][k % 3], "xx") for k in range(200)] + [(1000, "ein wort", "xx")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid.learn(table, sample_docs=1) == {"xx": " ein wort"}
