"""A bounded run ends when nothing has come for a while, however often the query looks for messages meanwhile."""

import time

from tidemark.sources import lake
from tidemark.streaming import bounded


def test_idle_runs_end_in_time(spark, tmp_path):
    """Looking for files makes a trigger active, which isn't work: the first run takes what is there, the second finds nothing."""
    spark.range(200).repartition(40).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    for expected in (200, 0):
        began = time.perf_counter()
        assert bounded.run_bounded(stream(), lake.batch_folder(str(tmp_path / "out")), str(tmp_path / "check"), idle_seconds=4.0) == expected
        assert 4 < time.perf_counter() - began < 16
    assert spark.read.parquet(str(tmp_path / "out")).count() == 200
