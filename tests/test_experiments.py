"""Devices of commands."""

import pytest

from loomwright.plans import experiments


def test_devices_run_out(spark):
    rows = spark.createDataFrame([(1, "python a --gpu_ids 0,1 --x"), (0, "python b")], "id long, command string")
    assert [(r["id"], r["devices"]) for r in experiments.on_devices(rows, ["4", "2", "7"]).orderBy("id").collect()] == [(0, "4"), (1, "2,7")]
    with pytest.raises(Exception, match="required for python a"):
        experiments.on_devices(rows, ["4", "2"]).collect()
