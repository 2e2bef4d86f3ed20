"""The derived tables."""

import __spark_entry__ as entry
from tessera.sources import tables as T

SF = entry.SMALL


def values(df, column):
    return {r[0] for r in df.select(column).distinct().collect()}


def test_kinds_of_posts_and_of_actions_are_two_things(spark):
    assert values(T.post_mentions(spark, SF), "post_kind") == {"opinion", "share", "short"}
    assert values(T.stored_actions(spark, SF), "action_type") == {"split", "bonus", "demerger"}
    assert T.post_sentiment(spark, SF).count() > 0
