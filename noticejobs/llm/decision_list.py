"""Quality rules: decision lists learned by sequential covering, applied as Spark conditions.

Text statistics are Spark columns. Labelled rows are reduced to bins of each statistic; a rule grows by
the threshold condition with the best information gain over the rows that earlier rules left, is pruned back to
the prefix of its conditions that is most precise on rows kept apart, and joins the list if it is precise
enough there. The list becomes an ordered ``when ... when ... otherwise`` expression.

Only DataFrame functions run on the executors; the driver sees counts by statistic and bin, whose
number does not depend on the rows.

Defined results: a null text has no words; statistics of texts without words are 0; a document with several
labels counts once for each; without labels of both kinds the list is empty and keeps everything; a
condition is ``statistic >= limit`` or ``statistic < limit``; of conditions with one gain the first by name, limit and sign is taken;
repeated rows are judged each; an empty table gives an empty result; other columns are kept, but for the names of the statistics.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticejobs.llm.common import discard, stored

BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
#: Columns that the rules may test, made from the statistics below.
FEATURES = ("n_words", "word_length", "symbol_share", "upper_share", "mark_share", "dup_line_share", "repeat_share", "distinct_share", "double_mark_share", "digit_share")
BINS, MAX_RULES, MAX_CONDITIONS = 24, 8, 3
MIN_PRECISION, MIN_COVER = 0.97, 3
#: Labels that are broadcast at most: 16 MB.
BROADCAST_LABELS = 1 << 20


#: Low bits of a sort key, which hold a window's place.
PLACE = (1 << 20) - 1


def with_repeated_words(rows: DataFrame, n: int = 3) -> DataFrame:
    """``n_repeat_words``: words of ``_words`` in an n-word window found twice or more, the first find included.

    Windows are sorted by the high bits of their hash and their place. Where different windows share these bits, or places
    need more bits, the text's whole hashes are sorted with their places instead.
    """
    grams = F.transform(F.sequence(F.lit(0), F.size("_words") - n), lambda i: F.xxhash64(*[F.get("_words", i + k) for k in range(n)]))
    rows = rows.withColumn("_grams", F.when(F.size("_words") < n, F.lit([]).cast("array<bigint>")).otherwise(grams))
    rows = rows.withColumn("_all_differ", F.size(F.array_distinct("_grams")) == F.size("_grams"))
    keys = F.transform("_grams", lambda h, i: h.bitwiseAND(F.lit(~PLACE)).bitwiseOR(i.cast("long")))
    rows = rows.withColumn("_sorted", F.sort_array(F.when(F.col("_all_differ") | (F.size("_grams") > PLACE), F.lit([]).cast("array<bigint>")).otherwise(keys)))

    def gram(key: Column) -> Column:
        return F.get("_grams", key.bitwiseAND(F.lit(PLACE)).cast("int"))

    def alike(x: Column, y: Column) -> Column:
        """Whether two keys have the same high bits; no key is like one that is not there."""
        return F.coalesce(x.bitwiseAND(F.lit(~PLACE)) == y.bitwiseAND(F.lit(~PLACE)), F.lit(False))

    def before(keys: str, k: Column) -> Column:
        return F.get(keys, F.when(k > 0, k - 1))

    rows = rows.withColumn("_again", F.filter("_sorted", lambda x, k: alike(x, F.get("_sorted", k + 1)) | alike(x, before("_sorted", k))))
    mixed = F.filter("_again", lambda x, k: alike(x, before("_again", k)) & (gram(before("_again", k)) != gram(x)))
    rows = rows.withColumn("_whole", (F.size("_grams") > PLACE) | (F.size(mixed) > 0))
    places = F.transform("_again", lambda x: x.bitwiseAND(F.lit(PLACE)))
    whole = F.sort_array(F.transform("_grams", lambda h, i: F.struct(h.alias("h"), i.cast("long").alias("i"))))
    twice = bind(whole, lambda s: F.transform(F.filter(s, lambda x, k: F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, F.when(k > 0, k - 1))["h"] == x["h"], F.lit(False))), lambda x: x["i"]))
    rows = rows.withColumn("_places", F.when(F.col("_all_differ"), F.lit([]).cast("array<bigint>")).when(F.col("_whole"), twice).otherwise(places))
    covered = F.size(F.array_distinct(F.flatten(F.transform("_places", lambda i: F.sequence(i, i + n - 1)))))
    return rows.withColumn("n_repeat_words", covered.cast("long")).drop("_grams", "_all_differ", "_sorted", "_again", "_whole", "_places")


def bind(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def described(docs: DataFrame) -> DataFrame:
    """``docs`` with the statistics of their texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, BLANKS), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = docs.withColumn("_words", words).withColumn("_lines", lines)
    out = out.withColumn("n_words", F.size("_words").cast("long"))
    out = out.withColumn("word_chars", F.length(F.array_join("_words", "")).cast("long"))
    out = out.withColumn("n_symbols", F.regexp_count(text, F.lit(SYMBOLS)).cast("long"))
    out = out.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    out = with_repeated_words(out)
    share = lambda n, of: F.round(F.when(F.col(of) > 0, n / F.col(of)).otherwise(0.0), 6)
    out = out.withColumns({
        "word_length": share(F.col("word_chars"), "n_words"),
        "symbol_share": share(F.col("n_symbols"), "word_chars"),
        "upper_share": share(F.regexp_count(text, F.lit("[A-Z]")), "word_chars"),
        "mark_share": share(F.regexp_count(text, F.lit(r"[!-/:-@\[-`{-~]")), "word_chars"),
        "double_mark_share": share(F.regexp_count(text, F.lit(r"([!-/:-@\[-`{-~])\1")), "n_words"),
        "digit_share": share(F.regexp_count(text, F.lit("[0-9]")), "word_chars"),
        "dup_line_share": F.round(F.when(F.size("_lines") > 0, F.col("n_dup_lines") / F.size("_lines")).otherwise(0.0), 6),
        "repeat_share": share(F.col("n_repeat_words"), "n_words"),
        "distinct_share": share(F.size(F.array_distinct("_words")), "n_words"),
    })
    return out.drop("_words", "_lines")


def base_failed() -> Column:
    """Too few words, or over half of them in repeated windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def significant(x: float) -> float:
    """Rounded to three digits, so that thresholds read well and small changes do not move them."""
    return 0.0 if not x else round(x, 2 - math.floor(math.log10(abs(x))))


def condition(c: tuple[str, str, float]) -> Column:
    name, op, at = c
    return F.col(name) >= at if op == ">=" else F.col(name) < at


def both(conditions: list[tuple[str, str, float]]) -> Column:
    return reduce(lambda a, b: a & b, map(condition, conditions), F.lit(True))


class DecisionList:
    """Ordered rules; the first that holds rejects the row."""

    def __init__(self, rules: list[list[tuple[str, str, float]]]):
        self.rules = rules

    def rejects(self) -> Column:
        return reduce(lambda expr, rule: expr.when(both(rule), True), self.rules[1:], F.when(both(self.rules[0]), True)).otherwise(False) if self.rules else F.lit(False)

    def __str__(self) -> str:
        return "; ".join(" and ".join(f"{a} {o} {t:g}" for a, o, t in rule) for rule in self.rules)


def learn(rows: DataFrame, features: tuple[str, ...] = FEATURES) -> DecisionList:
    """rows: the statistics, a unique id ``doc_id`` and ``bad`` (true: to be rejected) of labelled documents."""
    cuts = [k / BINS for k in range(1, BINS)] + [0.01, 0.99]
    got = rows.agg(*[F.percentile_approx(f, sorted(cuts), 10_000).alias(f) for f in features]).first()
    limits = {f: sorted({significant(x) for x in (got[f] or [])}) for f in features}
    # A row's bin of a statistic is the number of limits at or below its value.
    binned = rows.select(F.col("bad").cast("int").alias("bad"), (F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(3)) == 0).alias("prune"), *features, F.array(*[F.struct(F.lit(f).alias("f"), sum((F.when(F.col(f) >= x, 1).otherwise(0) for x in limits[f]), F.lit(0)).alias("bin")) for f in features]).alias("bins"))
    left = table = stored(binned)
    rules: list[list] = []
    while len(rules) < MAX_RULES:
        rule = grow(left.filter("not prune"), limits)
        rule = prune(left.filter("prune"), rule) if rule else []
        if not rule:
            break
        rules.append(rule)
        left = table.filter(reduce(lambda a, b: a & b, (~both(r) for r in rules)))
    discard(table)
    return DecisionList(rules)


def grow(rows: DataFrame, limits: dict[str, list[float]]) -> list:
    rule: list = []
    bad, total = rows.agg(F.coalesce(F.sum("bad"), F.lit(0)), F.count("*")).first()
    while 0 < bad < total and len(rule) < MAX_CONDITIONS:
        counts = rows.filter(both(rule)).select("bad", F.explode("bins").alias("b")).groupBy("b.f", "b.bin").agg(F.sum("bad").alias("bad"), F.count("*").alias("n")).collect()  # statistics x bins
        by: dict[str, dict[int, tuple[int, int]]] = {}
        for r in counts:
            by.setdefault(r["f"], {})[r["bin"]] = (r["bad"], r["n"])
        best = (0.0, None, 0, 0)
        for f in sorted(by):
            for k, at in enumerate(limits[f]):
                above = [v for b, v in by[f].items() if b > k]  # value >= limits[k]
                p, n = sum(v[0] for v in above), sum(v[1] for v in above)
                for op, p1, n1 in ((">=", p, n), ("<", bad - p, total - n)):
                    if p1 >= MIN_COVER and n1 < total:
                        gain = p1 * (math.log2(p1 / n1) - math.log2(bad / total))
                        if gain > best[0] + 1e-9:
                            best = (gain, (f, op, at), p1, n1)
        if best[1] is None:
            break
        rule = [*rule, best[1]]
        bad, total = best[2], best[3]
    return rule


def prune(rows: DataFrame, rule: list) -> list:
    """The prefix of the rule with the best (Laplace) precision on rows kept apart, if that is good enough."""
    prefixes = [rule[: k + 1] for k in range(len(rule))]
    got = rows.agg(*[x for k, p in enumerate(prefixes) for x in (F.coalesce(F.sum(F.when(both(p), F.col("bad"))), F.lit(0)).alias(f"p{k}"), F.count(F.when(both(p), 1)).alias(f"n{k}"))]).first()
    scored = [((got[f"p{k}"] + 1) / (got[f"n{k}"] + 2), -k, got[f"p{k}"], got[f"n{k}"]) for k in range(len(prefixes))]
    value, k, bad, n = max(scored)
    return prefixes[-k] if bad >= MIN_COVER and bad / n >= MIN_PRECISION else []


def labelled(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (or their statistics) with a label; ``bad`` where the quality is 0. Labels are broadcast if they are few enough."""
    rated = labels.select(F.col("doc_id").alias("rated_id"), F.col("quality").alias("rated_quality")).filter("rated_id is not null and rated_quality in (0, 1)")
    rated = F.broadcast(rated) if rated.count() <= BROADCAST_LABELS else rated
    return stats.join(rated, F.col("doc_id") == F.col("rated_id")).withColumn("bad", F.col("rated_quality") == 0).drop("rated_id", "rated_quality")
