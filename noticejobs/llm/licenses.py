"""Licence scan with a positional rare-token index.

Every licence template is a word sequence. One pass over all documents counts in how many of them
each template word occurs; the inverse document frequency (IDF) of those words is all that is kept. The index has
two parts: under the word with the highest IDF of each phrase, the templates whose mandatory key phrase it is; and for every word
its postings, the (template, position) pairs at which it stands.

A second pass looks up the licence words of each file, those of the highest IDF first. They name the templates that the file may
hold; those whose whole key phrase it holds are candidates. The postings of the file's words are then intersected by relative
position: every place of a word votes, in each candidate that has the word, for the offset "place less template position",
and the template words that agree with the best offset (within ``SLACK`` words) are counted, each once. Templates that a file does
not name cost nothing, however many there are. The share of agreeing words
is taken of the template words the document holds, and scaled down where those are under half of the template. A
template is reported when the share reaches ``threshold``; so it always is when that share of all its words stands
at one place, whatever else the document holds. The plain phrases (``PHRASES``) are always reported.

Words: A-Z lower-cased, then runs of digits, a-z and non-ASCII characters.

Defined results: a null or empty text has no words, places or labels and score 0; a document
repeated is reported each time; equal words of a template vote for each of their positions; a text of any length is looked
through whole, and every notice in it is found; of rarest words with one frequency the first of the phrase counts; columns other than
doc_id and text are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticejobs.llm.common import arrow_rows, slices, texts

#: Phrases and their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

#: Public licence notices, openings or whole texts, their labels and mandatory key phrases.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "permission is hereby granted free of charge"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "with or without fee is hereby granted"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache license version 2 0"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gnu general public license"),
    ("gpl", "this work is licensed under the gnu general public license version 3", "gnu general public license"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "gnu lesser general public license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", "mozilla public license"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("mit", "released under the mit license", "mit license"),
    ("agpl", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version", "gnu affero general public license"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions", "to alter it and redistribute it freely"),
    ("boost", "boost software license version 1 0 permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "boost software license"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", "free and unencumbered software released into the public domain"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", "eclipse public license"),
    ("cc0", "to the extent possible under law the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide", "dedicated all copyright and related and neighboring rights"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software", "the software is provided as is"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software", "the author disclaims all warranties with regard to this software"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages", "redistributions of source code must retain the above copyright notice"),
)

#: Agreeing offsets may differ from the best one by so many words.
SLACK = 2
_SPACE = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])


def words(text: str | None) -> list[bytes]:
    return text.encode().lower().translate(_SPACE).split() if text else []


class LicenceIndex:
    """Templates and phrases, and the IDF of their words."""

    def __init__(self, templates: tuple, phrases: tuple, idf: dict[str, float], threshold: float):
        self.idf = {w.encode(): v for w, v in idf.items()}
        self.templates = [(label, text.encode().split(), phrase.encode().split()) for label, text, phrase in templates]
        self.phrases = [(text.encode().split(), label) for text, label in phrases]
        self.threshold = threshold
        rarest = lambda p: max(p, key=lambda w: self.idf.get(w, 0))
        #: Templates, and plain phrases, by the word with the highest IDF of their (key) phrase.
        self.named: dict[bytes, list[int]] = defaultdict(list)
        self.plain: dict[bytes, list[int]] = defaultdict(list)
        #: (template, position) of each word.
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for t, (_, body, phrase) in enumerate(self.templates):
            self.named[rarest(phrase)].append(t)
            for k, w in enumerate(body):
                self.postings[w].append((t, k))
        for t, (phrase, _) in enumerate(self.phrases):
            self.plain[rarest(phrase)].append(t)
        #: A document that holds none of these can hold neither a phrase nor a key phrase.
        self.rarest = self.named.keys() | self.plain.keys()

    @staticmethod
    def places(where: dict[bytes, list[int]], phrase: list[bytes]) -> list[int]:
        starts = set(where.get(phrase[0], ()))
        for k, w in enumerate(phrase[1:], 1):
            starts &= {p - k for p in where.get(w, ())}
        return sorted(starts)

    @staticmethod
    def agreeing(votes: dict[int, int]) -> int:
        """Most words of a template that agree with one offset; ``votes`` has the template's positions of each offset, as bits."""
        most = 0
        for o in votes:
            bits = 0
            for d in range(2 * SLACK + 1):
                bits |= votes.get(o + d, 0)
            most = max(most, bits.bit_count())
        return most

    def scan(self, text: str | None) -> tuple:
        found = words(text)
        if self.rarest.isdisjoint(found):
            return len(found), 0, None, None, "", "", 0.0
        where: dict[bytes, list[int]] = defaultdict(list)
        for k, w in enumerate(found):
            if w in self.idf:
                where[w].append(k)
        rare_first = sorted(self.rarest & where.keys(), key=lambda w: (-self.idf[w], w))
        base = [(p, self.phrases[t][1]) for w in rare_first for t in self.plain.get(w, ()) for p in self.places(where, self.phrases[t][0])]
        labels, score = {label for _, label in base}, 1.0 if base else 0.0
        votes: dict[int, dict[int, int]] = {t: defaultdict(int) for w in rare_first for t in self.named.get(w, ()) if self.places(where, self.templates[t][2])}
        held = dict.fromkeys(votes, 0)
        if votes:
            for w, places in where.items():
                for t, k in self.postings.get(w, ()):
                    if t in votes:
                        held[t] += 1
                        for p in places:
                            votes[t][p - k] |= 1 << k
        for t, offsets in votes.items():
            label, body, _ = self.templates[t]
            share = self.agreeing(offsets) / held[t] * min(1.0, held[t] / (0.5 * len(body))) if held[t] else 0.0
            if share >= self.threshold:
                labels.add(label)
                score = max(score, share)
        at = [p for p, _ in base]
        return len(found), len(base), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), score


def word_frequencies(docs: DataFrame, vocabulary: list[str]) -> tuple[int, dict[str, int]]:
    """Number of documents, and in how many each word of the (fixed, small) vocabulary occurs."""
    wanted = {w.encode() for w in vocabulary}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df: Counter = Counter()
        for batch in batches:
            for ids, rows in slices(batch):
                df[b""] += len(ids)
                for text in rows:
                    df.update(wanted.intersection(words(text)))
        yield pa.RecordBatch.from_pydict({"word": [w.decode() for w in df], "n": list(df.values())}, schema=pa.schema([("word", pa.string()), ("n", pa.int64())]))

    # As many rows as the templates have words.
    counted = {r["word"]: r["n"] for r in texts(docs).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return counted.pop("", 0), counted


def scan_licences(docs: DataFrame, templates: tuple = TEMPLATES, phrases: tuple = PHRASES, threshold: float = 0.6) -> DataFrame:
    """One row per document: n_words, places of the phrases, labels with and without the templates, score."""
    vocabulary = sorted({w for row in [*(t[1] for t in templates), *(t[2] for t in templates), *(p[0] for p in phrases)] for w in row.split()})
    total, df = word_frequencies(docs, vocabulary)
    idf = {w: math.log((total + 1) / (df.get(w, 0) + 0.5)) for w in vocabulary}
    index = LicenceIndex(templates, phrases, idf, threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, rows in slices(batch):
                yield arrow_rows(OUT, [ids, *zip(*map(index.scan, rows), strict=True)])

    return texts(docs).mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
