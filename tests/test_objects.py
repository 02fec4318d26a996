"""The storage folder of the orphan query: one object for every version, nothing beside it."""

import os

from lexidx.operators import sweep
from lexidx.plans import fixtures


def _files(spark, root):
    top = root.split(":", 1)[-1]
    return sorted(os.path.relpath(os.path.join(d, f), top) for d, _, names in os.walk(top) for f in names)


def test_each_version_has_one_object_and_nothing_beside_it(spark):
    keys = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (None, 1), (7, 1)], "index_id bigint, version int")
    root = fixtures.write_objects(spark, keys)
    files = _files(spark, root)
    assert [os.path.dirname(f) for f in files] == ["index_id=1/version=1", "index_id=1/version=2", "index_id=7/version=1",
                                                   "index_id=__HIVE_DEFAULT_PARTITION__/version=1"]
    assert all(os.path.basename(f).startswith("part-") for f in files)
    found = {(r["artifact_key"], r["files"], r["bytes"]) for r in fixtures.listed_objects(spark, root).collect()}
    assert found == {(f"{i}/{n}/index.tar.gz", 1, 9) for i, n in ((1, 1), (1, 2), (7, 1), ("__HIVE_DEFAULT_PARTITION__", 1))}


def test_no_keys_leave_an_empty_storage(spark):
    root = fixtures.write_objects(spark, spark.createDataFrame([], "index_id bigint, version int"))
    assert sweep.list_files(spark, root).count() == 0
