"""Fill-in-the-middle examples: a text is cut into prefix, middle and suffix, and its parts change places.

A unit is a run of letters A-Z and a-z, or one other character. One ``fullmatch`` of ``(unit)*`` keeps every
repetition of the capture; the ends of the repetitions give the number of units and both cuts. The
quantifiers are possessive, as no other split of a text can match, so nothing is kept for going back.

Form and cuts come from the first four 8-digit groups of ``sha256(seed:doc_id)``, so a document is cut alike in every run. Marks
are looked for in the whole text: a text that holds one of them stays plain, so marks part the output without doubt.

Defined results: null and empty texts are plain, with 0 units and an empty output; a null doc_id counts as an empty one; rows that
share a doc_id are cut each by their own text; a text of any length is matched whole, with 16 bytes and one integer for each unit;
columns other than doc_id and text are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticejobs.llm.common import arrow_rows, slices, texts

UNITS = regex.compile(r"([A-Za-z]++|[^A-Za-z])*+")
#: Marks before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: Of a hundred texts so many stay plain, and so many of the others begin with their suffix.
PLAIN_SHARE, SUFFIX_FIRST_SHARE = 10, 20
OUT = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])


def draws(doc_id: int | None, seed: str = "1") -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]


def transformed(doc_id: int | None, text: str | None, seed: str = "1") -> tuple:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of one text."""
    text = text or ""
    ends = UNITS.fullmatch(text).ends(1)
    n, (h1, h2, h3, h4) = len(ends), draws(doc_id, seed)
    if not text or any(m in text for m in MARKS) or h3 % 100 >= 100 - PLAIN_SHARE:
        return doc_id, n, "plain", None, None, text
    ends.append(0)  # the end of no unit, reached by index -1
    first, second = (ends[k - 1] for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = text[:first], text[first:second], text[second:]
    p, s, m = MARKS
    if h4 % 100 < SUFFIX_FIRST_SHARE:
        return doc_id, n, "spm", first, second - first, f"{s}{suffix}{p}{prefix}{m}{middle}"
    return doc_id, n, "psm", first, second - first, f"{p}{prefix}{s}{suffix}{m}{middle}"


def fill_in_middle(docs: DataFrame, seed: str = "1") -> DataFrame:
    """doc_id, n (units), form (plain, psm, spm), prefix_chars, middle_chars, output (the whole text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, rows in slices(batch):
                yield arrow_rows(OUT, list(zip(*(transformed(k, t, seed) for k, t in zip(ids, rows, strict=True)), strict=True)))

    return texts(docs).mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made from."""
    p, s, m = map(F.lit, MARKS)
    part = lambda c, mark, k: F.split_part(c, mark, F.lit(k))
    body = F.substring(output, len(MARKS[0]) + 1, 2**31 - 1)
    parts, middle = part(body, m, 1), part(body, m, 2)
    psm = F.concat(part(parts, s, 1), middle, part(parts, s, 2))
    spm = F.concat(part(parts, p, 2), middle, part(parts, p, 1))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
