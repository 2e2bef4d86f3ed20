"""Rows around both ends of the calendar: queries by session against their SQL, on tables that reach beyond it."""

import os

import duckdb
import pytest
from test_queries import ORACLES, QUERIES, SF, TABLES, rows, same

#: What documents' and conversations' ids are multiplied with, so that their times go on to May.
WIDER = {"documents": ("doc_id", 72), "conversations": ("conv_id", 300)}
NAMES = "social_items social_daily social_summary social_report social_extremes entities_news_items alerting_daily_news alerting_news_coverage alerting_sentiment_averages alerting_news_shifts alerting_price_moves overview_sentiment_by_session streams_daily_sentiment sessions_of_events sessions_latest_completed".split()


@pytest.fixture(scope="module")
def wide(tmp_path_factory):
    folder, con = str(tmp_path_factory.mktemp("wide")), duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t}_ AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
        key, by = WIDER.get(t, ("", 1))
        con.execute(f"COPY (SELECT * {f'REPLACE ({key} * {by} + 7 * ({key} % 5) AS {key})' if key else ''} FROM {t}_) TO '{folder}/{t}.parquet'")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return folder, con


@pytest.mark.parametrize("name", NAMES)
def test_rows_at_the_ends_of_the_calendar(spark, wide, name):
    folder, con = wide
    got, want = QUERIES[name](spark, folder).toPandas(), con.execute(ORACLES[name]).df()
    assert len(want) and sorted(got.columns) == sorted(want.columns) and same(rows(got), rows(want))


def test_the_tables_reach_beyond_the_calendar(wide):
    seen, last = wide[1].execute("SELECT (SELECT max(doc_id) * 780 / 86400 FROM documents), (SELECT max(conv_id) * 3600 / 86400 FROM conversations)").fetchone()
    assert min(seen, last) > 95
