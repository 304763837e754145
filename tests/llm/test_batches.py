"""Whole texts reach the Python workers in batches of a bounded number of rows."""

import pyarrow as pa

from tallyvine.llm import common


def _sizes(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["rows"])


def test_batches_are_small_unless_the_session_says_otherwise(spark):
    before = spark.conf.get(common._BATCH_SETTING, None)
    try:
        spark.conf.unset(common._BATCH_SETTING)
        frame = spark.range(0, 5000, 1, 1)
        found = [row.rows for row in common.map_batches(frame, _sizes, "rows long").collect()]
        assert sum(found) == 5000 and max(found) == common.BATCH_ROWS
        spark.conf.set(common._BATCH_SETTING, "3000")
        found = [row.rows for row in common.map_batches(frame, _sizes, "rows long").collect()]
        assert sorted(found) == [2000, 3000]
    finally:
        if before is None:
            spark.conf.unset(common._BATCH_SETTING)
        else:
            spark.conf.set(common._BATCH_SETTING, before)
