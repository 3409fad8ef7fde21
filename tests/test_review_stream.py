"""Rejudging under every version of the thresholds."""

from __future__ import annotations

from corvane.streaming.review_log import rejudge_stream


def test_rejudge_takes_every_version(spark):
    measured = spark.createDataFrame([("a", 75), ("b", 500)], "doc string, characters long")
    thresholds = spark.createDataFrame([(i, i) for i in range(150)], "version int, min_characters long")
    rows = rejudge_stream(measured, thresholds).collect()
    assert len(rows) == 300
    assert sum(r.low_text for r in rows) == 74
