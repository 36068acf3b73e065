"""Registered queries against their SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from noticejobs.plans import QUERIES, SQL

DATA = Path("/root/testdata/sf0.001")
SOME = ["j4_match_alerts", "j5_route_notifications", "a1_facet_counts", "a2_facets", "p6_deadline_status", "t8_keyword_retrieve", "t9_vector_topk", "j12_recommend", "w2_apply_changes", "w3_edit_history", "j22_compare_documents", "x2_stream_match_counts", "x5_activity_sessions", "x3_digest", "x8_late_data", "j11_related_notices", "j21_related_questions", "a8_match_counts", "x9_retry_state", "s1_s2_csv_round_trip", "u2_upsert_scraped", "a12_engagement_month", "w7_retry_chains", "f4_relative_time", "f13_due_sources", "j3_keyword_index", "j4_backfill", "j22_near_documents", "a29_user_sketches", "a3_shared_users", "a17_latency_sketches", "a11_account_and_matches", "x6_dedupe_scraped", "u2_stored_upsert", "s6_match_sink", "j7_unseen_notices", "j7_unseen_counts", "w11_running_items", "j16_pair_runs", "s3_validate_import"]


def rows(frame):
    plain = lambda x: "" if x is None or (isinstance(x, float) and math.isnan(x)) or str(x) in ("<NA>", "NaT") else repr(round(float(x), 6)) if hasattr(x, "__float__") and not isinstance(x, str) else str(x)
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(plain, r)) for r in frame.itertuples(index=False))


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, name):
    with duckdb.connect() as db:
        for file in DATA.glob("*.parquet"):
            db.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
        expected = db.execute(SQL[name]).df()
    got = QUERIES[name](spark, str(DATA)).toPandas()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got) == rows(expected)
