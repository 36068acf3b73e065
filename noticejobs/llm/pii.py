"""Personal data: base patterns plus bootstrapped contextual extraction, all in Spark expressions.

Base spans (e-mail, ip, card, phone) come from regular expressions and checks. Base spans and long hexadecimal
strings are the seed entities. Every identifier-like string (eight or more characters with a digit) is an
instance; the up to two words before it, and the last of them alone, are its lexical patterns. On the graph of patterns and
instances, a pattern's confidence is the mean score of its instances, an instance's score the best confidence among
its patterns (1 for seeds); after ``ROUNDS`` rounds, the instances of patterns with enough confidence and
different instances become spans of kind ``id``, unless they overlap a base span.

Spans are code points, end exclusive. Only DataFrame functions are used. Sums and maxima along an array are
taken by chunks (``running``), so a text's time grows with its length and its number of matches, not with their square.

Defined results: a null text counts as empty; the same span found by two kinds is listed for both; repeated rows are
searched each; equal starts go in the order of ``KINDS``; an empty table gives an empty result; other columns are kept, but
for names that begin with an underscore and those of the result (``base``, ``found``, ``all_spans``), which must not occur.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticejobs.llm.common import discard, stored

KINDS = ("email", "ip", "card", "phone", "id")
ROUNDS, MIN_CONFIDENCE, MIN_INSTANCES = 3, 0.8, 3
#: Stands for a separator inside a match, so that a match is one run of one character class.
JOINT, OTHER = "", ""
LOCAL = rf"[A-Za-z0-9._%+\-{JOINT}]"
EMAIL = rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++{JOINT}[A-Za-z0-9\-{JOINT}]++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
IP_VALID = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.|$)){4}$"
CARD = rf"[0-9][0-9{JOINT}]++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
INSTANCE = r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{8,}+"
NEVER = 2**31 - 1
#: Elements of a chunk of a running sum, and code points of a block of a text that is cut.
CHUNK, BLOCK = 64, 2048


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, add: Callable[[Column, Column], Column], first: int = 0) -> Column:
    """For each element of an int array, ``add`` folded over the elements up to it: by chunks, then over the chunks."""

    def folded(part: Column) -> Column:
        start = F.struct(F.lit(first).alias("at"), F.lit([]).cast("array<int>").alias("out"))

        def step(acc: Column, x: Column) -> Column:
            return bind(add(acc["at"], x), lambda now: F.struct(now.alias("at"), F.array_append(acc["out"], now).alias("out")))

        return F.aggregate(part, start, step, lambda acc: acc["out"])

    # A chunk's running values go on from the whole of the chunks before it.
    def joined_parts(v: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / CHUNK).cast("int")), lambda k: folded(F.slice(v, k * CHUNK + 1, F.lit(CHUNK))))

        def shifted(p: Column) -> Column:
            wholes = folded(F.transform(p, lambda x: F.element_at(x, -1)))
            before = F.concat(F.array(F.lit(first)), wholes)
            return F.flatten(F.zip_with(p, F.slice(before, F.lit(1), F.size(p)), lambda x, w: F.transform(x, lambda y: add(w, y))))

        return bind(parts, shifted)

    return bind(values, lambda v: F.when(F.size(v) == 0, F.lit([]).cast("array<int>")).when(F.size(v) <= CHUNK, folded(v)).otherwise(joined_parts(v)))


def plus(a: Column, b: Column) -> Column:
    return a + b


def matches(text: Column, pattern: str) -> Column:
    """Matches of a pattern as structs (start, end, value, before): before is the text since the last match."""
    found, parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def placed(rows: Column) -> Column:
        ends = running(F.transform(rows, lambda x: F.length(x["b"]) + F.length(x["m"])), plus)
        return F.zip_with(rows, ends, lambda x, end: F.struct((end - F.length(x["m"])).alias("start"), end.alias("end"), x["m"].alias("value"), x["b"].alias("before")))

    return bind(F.zip_with(found, F.slice(parts, F.lit(1), F.size(found)), lambda m, b: F.struct(m.alias("m"), b.alias("b"))), placed)


def overlapping(spans: Column, base: Column) -> Column:
    """For each (start, end, ...) of ``spans`` whether it overlaps one of ``base``, as booleans; one walk along both, by start."""
    tagged = lambda xs, kind: F.transform(xs, lambda x, i: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end"), i.alias("i")))

    def walk(row: Column) -> Column:
        reach = running(F.transform(row, lambda x: F.when(x["kind"] == 0, x["end"]).otherwise(0)), lambda a, b: F.greatest(a, b))
        after = F.reverse(running(F.reverse(F.transform(row, lambda x: F.when(x["kind"] == 0, x["start"]).otherwise(NEVER))), lambda a, b: F.least(a, b), NEVER))
        hits = F.zip_with(row, F.zip_with(reach, after, lambda r, a: F.struct(r.alias("r"), a.alias("a"))), lambda x, y: F.struct(x["i"].alias("i"), x["kind"].alias("kind"), ((y["r"] > x["start"]) | (y["a"] < x["end"])).alias("hit")))
        return F.transform(F.sort_array(F.filter(hits, lambda x: x["kind"] == 1)), lambda x: x["hit"])

    return F.when(F.size(base) == 0, F.transform(spans, lambda _: F.lit(False))).otherwise(bind(F.sort_array(F.concat(tagged(base, 0), tagged(spans, 1))), walk))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    def term(acc: Column, i: Column) -> Column:
        d = F.substring(number, -i, F.lit(1)).cast("int")
        twice = d * 2
        return acc + F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), term) % 10 == 0


def of_kind(found: Column, kind: int) -> Column:
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end")))


def count_kind(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def with_spans(docs: DataFrame) -> DataFrame:
    """``docs`` with ``base`` (start, kind number, end; sorted) and ``found`` (instances with their contexts)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.lit([]).cast("array<struct<start:int,end:int,value:string,before:string>>")
    plain = F.translate(text, JOINT, OTHER)
    dots = F.regexp_replace(plain, r"\.(?=[A-Za-z0-9-])", JOINT)
    chains = F.regexp_replace(plain, r"(?<=[0-9])[\x20-](?=[0-9])", JOINT)
    out = docs.withColumn("_digit", text.rlike("[0-9]"))
    out = out.withColumn("_email", F.when(F.contains(text, F.lit("@")), matches(dots, EMAIL)).otherwise(none))
    out = out.withColumn("_ip", F.when(F.col("_digit") & text.rlike(r"[0-9]\.[0-9]"), matches(text, IP)).otherwise(none))
    out = out.withColumn("_card", F.when(F.col("_digit"), F.filter(matches(chains, CARD), lambda x: F.length(digits(x["value"])).between(12, 19))).otherwise(none))
    out = out.withColumn("_phone", F.when(F.col("_digit") & F.contains(text, F.lit("+")), matches(text, PHONE)).otherwise(none))
    valid = (
        F.col("_email"),
        F.filter("_ip", lambda x: x["value"].rlike(IP_VALID)),
        F.filter("_card", lambda x: luhn(digits(x["value"]))),
        F.filter("_phone", lambda x: F.length(digits(x["value"])).between(9, 15)),
    )
    spans = [of_kind(v, k) for k, v in enumerate(valid)]
    out = out.withColumn("base", F.sort_array(F.concat(*spans)))
    def patterns(before: Column) -> Column:
        """Hashes of the last two words and of the last word alone, digits as 9; found from the end, so in one pass."""
        ending = lambda regex: F.lower(F.regexp_replace(F.regexp_extract(F.reverse(before), regex, 0), "[0-9]", "9"))
        two, one = ending(r"^\s*+\S*+(?:\s++\S++)?"), ending(r"^\s*+\S*+")
        return F.filter(F.array_distinct(F.array(*[F.when(x.rlike(r"\S"), F.sha2(F.concat(x, F.lit(mark)), 256)) for x, mark in ((two, "2"), (one, "1"))])), lambda x: x.isNotNull())

    def described(found: Column) -> Column:
        return F.zip_with(found, overlapping(found, F.col("base")), lambda x, hit: F.struct(
            x["start"].alias("start"), x["end"].alias("end"), F.sha2(F.lower(x["value"]), 256).alias("instance"), patterns(x["before"]).alias("patterns"),
            hit.alias("is_base"), x["value"].rlike("^(?=.*[0-9])(?=.*[a-f])[0-9a-f]{32,}$").alias("is_hex"),
        ))

    nothing = F.lit([]).cast("array<struct<start:int,end:int,instance:string,patterns:array<string>,is_base:boolean,is_hex:boolean>>")
    out = out.withColumn("found", F.when(F.col("_digit"), bind(matches(text, INSTANCE), described)).otherwise(nothing))
    return out.drop("_digit", "_email", "_ip", "_card", "_phone")


def trusted_patterns(found: DataFrame, rounds: int = ROUNDS, confidence: float = MIN_CONFIDENCE, instances: int = MIN_INSTANCES) -> DataFrame:
    """(pattern): from rows (pattern, instance, is_base, is_hex), those that mostly precede seeds or trusted instances."""
    edges = stored(found.groupBy("pattern", "instance").agg(F.max((F.col("is_base") | F.col("is_hex")).cast("double")).alias("seed")))
    scored, used = edges.withColumn("score", F.col("seed")), [edges]
    for k in range(rounds):
        patterns = scored.groupBy("pattern").agg(F.avg("score").alias("confidence"), F.count("*").alias("n"))
        if k + 1 < rounds:
            known = stored(edges.join(patterns, "pattern").groupBy("instance").agg(F.max("confidence").alias("best")))
            used.append(known)
            scored = edges.join(known, "instance").withColumn("score", F.greatest("seed", "best"))
    trusted = stored(patterns.filter((F.col("confidence") >= confidence) & (F.col("n") >= instances)).select("pattern"))
    discard(*used)
    return trusted


def joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def detect(docs: DataFrame, keep: tuple[str, ...] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``base`` and ``all_spans``: sorted arrays of (start, kind number, end)."""
    rows = with_spans(docs).select(*(keep or docs.columns), "base", "found").withColumn("_row", F.monotonically_increasing_id())
    rows = stored(rows)
    found = rows.filter(F.size("found") > 0).select("_row", F.explode("found").alias("x")).select("_row", "x.*").withColumn("pattern", F.explode("patterns")).drop("patterns")
    fresh = found.filter("not is_base").join(trusted_patterns(found), "pattern")
    fresh = fresh.groupBy("_row").agg(F.collect_set(F.struct("start", F.lit(KINDS.index("id")).alias("kind"), "end")).alias("fresh"))
    may_gain = F.exists("found", lambda x: ~x["is_base"])
    # Only rows with an instance that is no base span can gain one; the others skip the join.
    with_ids = rows.filter(may_gain).join(fresh, "_row", "left").withColumn("all_spans", F.when(F.col("fresh").isNull(), F.col("base")).otherwise(F.sort_array(F.concat("base", "fresh")))).drop("fresh")
    same = rows.filter(~may_gain).withColumn("all_spans", F.col("base"))
    return same.unionByName(with_ids).drop("_row", "found")


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; of overlapping spans the first counts."""
    labels = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def cut(blocks: Column) -> Column:
        """What lies between spans and the labels, from blocks of the text: no piece is sought from the text's beginning."""

        def between(a: Column, b: Column) -> Column:
            x, y = F.floor(a / BLOCK).cast("int"), F.floor(b / BLOCK).cast("int")
            block = lambda k: F.coalesce(F.get(blocks, k), F.lit(""))
            inner = F.array_join(F.slice(blocks, x + 2, F.greatest(y - x - 1, F.lit(0))), "")
            return F.when(x == y, F.substring(block(x), a % BLOCK + 1, b - a)).otherwise(F.concat(F.substring(block(x), a % BLOCK + 1, F.lit(BLOCK)), inner, F.substring(block(y), F.lit(1), b % BLOCK)))

        def joined_up(reach: Column) -> Column:
            before = F.concat(F.array(F.lit(0)), reach)
            pieces = F.zip_with(spans, F.slice(before, F.lit(1), F.size(spans)), lambda x, at: F.when(x["start"] >= at, F.concat(between(at, x["start"]), F.get(labels, x["kind"]))).otherwise(""))
            return F.concat(F.array_join(pieces, ""), between(F.element_at(reach, -1), F.length(text)))

        return bind(running(F.transform(spans, lambda x: x["end"]), lambda a, b: F.greatest(a, b)), joined_up)

    return F.when(F.size(spans) == 0, text).otherwise(bind(F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % BLOCK), F.lit(0)), cut))
