import datetime as dt

import pytest
from pyspark.sql import functions as F

from noticejobs.functions import scalars as S

AS_OF = "2026-06-15 12:00:00"


def value(spark, column, **cells):
    types = {k: ("timestamp" if isinstance(v, dt.datetime) else "array<string>" if isinstance(v, list) else "string") for k, v in cells.items()}
    row = spark.createDataFrame([tuple(cells.values())], ", ".join(f"{k} {t}" for k, t in types.items())) if cells else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("expression", "text", "expected"),
    [
        (lambda: S.slugify("c"), "  Héllo, World_1 -x ", "-hllo-world_1--x-"), (lambda: S.capitalize("c"), "mY word", "MY word"), (lambda: S.truncate("c", 5), "abcdef", "abcd…"), (lambda: S.truncate("c", 6), "abcdef", "abcdef"),
        (lambda: S.parse_size("c"), "4.2 MB", 4404019), (lambda: S.parse_size("c"), "890 KB", 911360), (lambda: S.parse_size("c"), "x", None), (lambda: S.parse_duration("c"), "4.2s", 4.2), (lambda: S.parse_duration("c"), "-", None),
        (lambda: S.frequency_hours("c"), "Every 6 hours", 6), (lambda: S.frequency_hours("c"), "Manual", None), (lambda: S.frequency_hours("c"), "Weekly", 168), (lambda: S.source_portal("c"), "https://portal.example/a?b", "portal.example"), (lambda: S.valid_url("c"), "not a url", False), (lambda: S.valid_url("c"), None, False),
        (lambda: S.search_term("c"), "Searched for 'civil service'", "civil service"), (lambda: S.title_from_filename("c"), "a.b.pdf", "a.b"), (lambda: S.parse_body("c"), "{bad", ""), (lambda: S.parse_body("c"), '{"question": "q?"}', "q?"), (lambda: S.parse_body("c"), "{}", ""),
        (lambda: S.classify_question("c"), "Is it forbidden?", "tender"), (lambda: S.classify_question("c", S.ROUTERS["document"]), "it policy", "it"), (lambda: S.classify_question("c"), None, "default"), (lambda: S.highlight("c", "a.b"), "xA.Bx axb", "x<mark>A.B</mark>x axb"),
        (lambda: S.label("c", {"view": "Viewed"}, "Other"), "view", "Viewed"), (lambda: S.label("c", {"view": "Viewed"}, "Other"), "z", "Other"), (lambda: S.holds("c", "10%"), "at 10% off", True), (lambda: S.holds("c", "1_%"), "at 10% off", False), (lambda: S.holds("c", "x"), None, False),
    ],
)
def test_text_functions(spark, expression, text, expected):
    assert value(spark, expression(), c=text) == expected


def test_retry_and_conditions(spark):
    assert tuple(value(spark, S.parse_retry("c"), c="Failed: 403 (retry 2/3)"))[:2] == (2, 3)
    assert value(spark, S.parse_conditions("c"), c=" psc,\texam ,,") == ["psc", "exam", "", ""]
    assert value(spark, S.condition_preview("c"), c=list("abcde")) == "a, b, c, +2 more"
    assert value(spark, S.lead_facts("c"), c=["a", "b", "c"]) == "a — b"
    assert value(spark, S.first_matching_fact("c", F.lit("what about fees?")), c=["Age limit", "Fees apply"]) == "Fees apply"


@pytest.mark.parametrize(("deadline", "days"), [((2026, 6, 15, 17), 1), ((2026, 6, 15, 12), 0), ((2026, 6, 15, 5), 0), ((2026, 6, 14, 11), -1), ((2026, 7, 31), 46)])
def test_deadline_days_are_not_calendar_days(spark, deadline, days):
    assert value(spark, S.deadline_days("c", AS_OF), c=dt.datetime(*deadline)) == days


@pytest.mark.parametrize(("when", "said"), [((2026, 6, 15, 13), "just now"), ((2026, 6, 15, 11, 1), "59m ago"), ((2026, 6, 14, 13), "23h ago"), ((2026, 6, 9, 12), "6d ago"), ((2026, 6, 1), "Jun 1, 2026")])
def test_relative_time(spark, when, said):
    assert value(spark, S.relative_time("c", AS_OF), c=dt.datetime(*when)) == said


def test_update_nested_field(spark):
    row = spark.sql("select array(named_struct('key', 'a', 'value', '1'), named_struct('key', 'b', 'value', '2')) as f")
    assert [tuple(x) for x in row.select(S.update_nested_field("f", "b", "9")).first()[0]] == [("a", "1"), ("b", "9")]
