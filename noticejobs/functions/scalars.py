"""Scalar functions (columns in, column out). Clocks are explicit: ``as_of`` is a timestamp column or literal."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that text tools of browsers trim, beyond Java's ``\s``.
SPACE = r"[\s  -   　﻿]"
DAY_MS = 86_400_000


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def moment(as_of: Column | str) -> Column:
    return F.lit(as_of).cast("timestamp") if isinstance(as_of, str) else as_of


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def holds(c: Column | str, q: str) -> Column:
    """Case-insensitive literal substring; a missing value holds nothing."""
    return F.coalesce(F.contains(F.lower(col(c)), F.lit(q.lower())), F.lit(False))


def trimmed(c: Column | str) -> Column:
    return F.regexp_replace(col(c), f"^{SPACE}+|{SPACE}+$", "")


def slugify(c: Column | str) -> Column:
    """Lower case, only ASCII word characters, blanks and hyphens; blank runs become one hyphen."""
    kept = F.regexp_replace(F.lower(col(c)), f"[^\\w\\-{SPACE[1:-1]}]", "")
    return F.regexp_replace(kept, f"{SPACE}+", "-")


def truncate(c: Column | str, n: int) -> Column:
    return F.when(F.length(col(c)) <= n, col(c)).otherwise(F.concat(F.substring(col(c), 1, n - 1), F.lit("…")))


def format_date(c: Column | str, pattern: str = "MMM d, yyyy") -> Column:
    return F.date_format(col(c), pattern)


def relative_time(c: Column | str, as_of: Column | str) -> Column:
    minutes = F.floor((F.unix_millis(moment(as_of)) - F.unix_millis(col(c).cast("timestamp"))) / 60_000)
    hours, days = F.floor(minutes / 60), F.floor(minutes / 1440)
    said = lambda n, unit: F.concat(n.cast("string"), F.lit(f"{unit} ago"))
    return F.when(minutes < 1, "just now").when(minutes < 60, said(minutes, "m")).when(hours < 24, said(hours, "h")).when(days < 7, said(days, "d")).otherwise(format_date(c))


def capitalize(c: Column | str) -> Column:
    """First character upper, the rest as it is."""
    return F.concat(F.upper(F.substring(col(c), 1, 1)), F.substring(col(c), 2, 2_000_000_000))


def parse_conditions(c: Column | str) -> Column:
    """Comma-separated conditions, trimmed; empty ones stay."""
    return F.transform(F.split(col(c), ","), trimmed)


def condition_preview(c: Column | str, n: int = 3) -> Column:
    more = F.size(col(c)) - n
    return F.concat(F.array_join(F.slice(col(c), 1, n), ", "), F.when(more > 0, F.concat(F.lit(", +"), more.cast("string"), F.lit(" more"))).otherwise(""))


def source_portal(url: Column | str) -> Column:
    return F.try_parse_url(col(url), F.lit("HOST"))


def valid_url(url: Column | str) -> Column:
    return F.coalesce(F.try_parse_url(col(url), F.lit("PROTOCOL")).isNotNull() & F.try_parse_url(col(url), F.lit("HOST")).isNotNull(), F.lit(False))


def parse_size(c: Column | str) -> Column:
    """'4.2 MB' as bytes; units of 1024."""
    number = F.regexp_extract(col(c), r"^\s*([0-9]+(?:\.[0-9]+)?)\s*([KMGT]?)B\s*$", 1).try_cast("double")
    unit = F.regexp_extract(F.upper(col(c)), r"([KMGT]?)B\s*$", 1)
    power = F.when(unit == "K", 1024.0).when(unit == "M", 1024.0**2).when(unit == "G", 1024.0**3).when(unit == "T", 1024.0**4).otherwise(1.0)
    return F.round(number * power).cast("long")


def parse_duration(c: Column | str) -> Column:
    """'4.2s' as seconds; anything else is null."""
    return F.regexp_extract(col(c), r"^\s*([0-9]+(?:\.[0-9]+)?)\s*s\s*$", 1).try_cast("double")


def parse_retry(action: Column | str) -> Column:
    """'(retry 2/3)' as (attempt, max_attempts), 'Failed: X' as error."""
    part = lambda k: F.regexp_extract(col(action), r"\(retry (\d+)/(\d+)\)", k).try_cast("int")
    error = F.regexp_extract(col(action), r"^Failed:\s*(.*)$", 1)
    return F.struct(part(1).alias("attempt"), part(2).alias("max_attempts"), F.when(error != "", error).alias("error"))


def frequency_hours(c: Column | str) -> Column:
    every = F.regexp_extract(col(c), r"^Every (\d+) hours?$", 1).try_cast("int")
    return F.when(col(c) == "Daily", 24).when(col(c) == "Weekly", 168).otherwise(every)


def first_matching_fact(facts: Column | str, q: Column) -> Column:
    """First fact of which some blank-separated word stands in the question."""
    hit = lambda f: F.exists(F.split(F.lower(f), r"\s+"), lambda w: F.contains(F.lower(q), w))
    return F.get(F.filter(col(facts), hit), F.lit(0))


def lead_facts(facts: Column | str, n: int = 2) -> Column:
    return F.array_join(F.slice(col(facts), 1, n), " — ")


def highlight(c: Column | str, q: str) -> Column:
    if not q:
        return col(c)
    return F.regexp_replace(col(c), f"(?iu)({re.escape(q)})", "<mark>$1</mark>")


def excerpt(c: Column | str, q: str, width: int = 80) -> Column:
    """``width`` characters around the first hit, from the start where there is none."""
    at = F.locate(q.lower(), F.lower(col(c)))
    return F.substring(col(c), F.greatest(F.lit(1), at - width // 2), F.lit(width))


#: Ordered routers: the first branch with a keyword in the question wins. Fixed values.
ROUTERS = {
    "notice": (("deadline", ("deadline", "last date", "when")), ("eligibility", ("eligib", "qualify", "requirement")), ("apply", ("apply", "how", "process")), ("contact", ("contact", "address", "phone"))),
    "document": (("constitution", ("constitution", "fundamental")), ("budget", ("budget", "fiscal")), ("procurement", ("procurement", "bidding")), ("civil", ("civil", "servant")), ("it", ("it policy", "digital"))),
    "chat": (("exam", ("exam", "psc")), ("tender", ("tender", "bid", "procurement")), ("policy", ("policy", "nrb", "monetary")), ("teacher", ("teacher", "education", "recruit"))),
}


def classify_question(q: Column | str, router: tuple = ROUTERS["chat"], default: str = "default") -> Column:
    return F.coalesce(*[F.when(any_of([holds(q, w) for w in words]), F.lit(name)) for name, words in router], F.lit(default))


def answer_notice_question(q: Column, as_of: Column | str) -> Column:
    """Templated answer from the notice's columns, by the notice router."""
    days = deadline_days("deadline", as_of)
    kind = classify_question(q, ROUTERS["notice"], "fact")
    portal = F.coalesce("source_portal", F.lit("the official website"))
    eligible = F.get(F.filter("key_facts", lambda f: holds(f, "qualif") | holds(f, "eligib")), F.lit(0))
    fact = first_matching_fact("key_facts", q)
    say = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return (
        F.when((kind == "deadline") & F.col("deadline").isNull(), F.lit("No deadline is given."))
        .when(kind == "deadline", say("Deadline: ", format_date("deadline"), "; ", F.when(days > 0, say(days.cast("string"), " days left")).otherwise("already passed"), "."))
        .when((kind == "eligibility") & eligible.isNotNull(), say("Eligibility: ", eligible, "."))
        .when(kind == "eligibility", say("See the full text by ", F.col("organization"), "."))
        .when(kind == "apply", say("Apply to ", F.col("organization"), " at ", portal, ". ", F.coalesce(lead_facts("key_facts"), F.lit(""))))
        .when(kind == "contact", say("Contact: ", F.coalesce("source_url", "source_portal", F.lit("the official portal")), "."))
        .when(fact.isNotNull(), say("From the notice: ", fact, "."))
        .otherwise(say(F.col("organization"), ": ", F.col("title"), ". ", F.coalesce("ai_summary", "description", F.lit(""))))
    )


def label(c: Column | str, names: dict[str, str], default: str) -> Column:
    """Display name of a code, with a default."""
    pairs = [F.lit(x) for item in names.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), col(c)), F.lit(default)) if pairs else F.lit(default)


def search_term(description: Column | str) -> Column:
    """Text in quotes of a description such as "Searched for 'x'"."""
    return F.regexp_extract(col(description), "'([^']*)'", 1)


def title_from_filename(name: Column | str) -> Column:
    return F.regexp_replace(col(name), r"\.[^.]+$", "")


def update_nested_field(fields: Column | str, key: str, value: str) -> Column:
    """An array of (key, value, ...) structs with one key's value replaced."""
    return F.transform(col(fields), lambda s: F.when(s["key"] == key, s.withField("value", F.lit(value))).otherwise(s))


def parse_body(c: Column | str) -> Column:
    """Question of a JSON body; malformed JSON is an empty object, a missing question is ''."""
    return F.coalesce(F.from_json(col(c), "question string", {"mode": "PERMISSIVE"})["question"], F.lit(""))


def deadline_days(deadline: Column | str, as_of: Column | str) -> Column:
    """Days to the deadline, started ones counted whole; not calendar days."""
    return F.ceil((F.unix_millis(col(deadline)) - F.unix_millis(moment(as_of))) / DAY_MS)


def words_of(c: str | Column) -> Column:
    """Lower-case runs of a-z and 0-9, repeats included."""
    return F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: w != "")
