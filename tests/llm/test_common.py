from __future__ import annotations

import os

from orewright.llm.common import Scratch, shared_dir, sweep


def test_scratch_tables_outlive_their_source_and_are_swept(spark):
    scratch = Scratch(spark)
    a = scratch.save(spark.range(5).toDF("n"))
    b = scratch.save(a.where("n > 1"))
    scratch.drop(a)
    assert b.count() == 3
    root = scratch.root.removeprefix("file://")
    assert root.startswith(shared_dir(spark).removeprefix("file://")) and len(os.listdir(root)) >= 1
    sweep(spark)
    assert not os.path.exists(root)
    assert Scratch(spark).save(spark.range(2)).count() == 2

