"""The listing by tasks, and a storage of many objects on little disk."""

import os

import pytest
from pyspark.sql import functions as F

from lexidx.operators import sweep
from lexidx.plans import artifact_queries, fixtures
from lexidx.session import checkpoint_root

NAMES = ["a.txt", "b c+(1).txt", "é.txt", "_hidden", "_k=1", ".dot", "_metadata", "_common_metadata_x", "x._COPYING_", "part%2F1"]
FOLDERS = ["", "one", "one/two/three", "_gone", "_k=2/deep", ".dotted", "_metadata", "y._COPYING_", "odd [1]+{a}", "index_id=1/version=2"]


def _rows(files):
    return sorted((r["path"], r["bytes"], r["modified"]) for r in files.collect())


def _tree(root, folders=FOLDERS):
    for i, folder in enumerate(folders):
        os.makedirs(f"{root}/{folder}", exist_ok=True)
        for j, name in enumerate(NAMES):
            if not os.path.isdir(f"{root}/{folder}/{name}"):
                with open(f"{root}/{folder}/{name}", "w") as f:
                    f.write("x" * (i + j + 1))
        open(f"{root}/{folder}/empty", "w").close()


@pytest.mark.parametrize("folders", [[f for f in FOLDERS if f != "_metadata"], ["_metadata", "deep/_metadata"], [f"w{i}/x" for i in range(40)]])
def test_tasks_list_what_spark_lists(spark, tmp_dir, folders):
    _tree(tmp_dir, folders)
    os.symlink(f"{tmp_dir}/{folders[1]}", f"{tmp_dir}/link")
    os.symlink(f"{tmp_dir}/nowhere", f"{tmp_dir}/broken")
    os.utime(f"{tmp_dir}/{folders[1]}/a.txt", ns=(0, 1_234_567_891_234_567))
    rows = _rows(sweep.list_files(spark, tmp_dir))
    assert len(rows) >= 3 * len(folders[1:]) and rows == _rows(sweep._list_with_spark(spark, tmp_dir))


def test_one_folder_of_many_files_comes_in_bounded_batches(spark, tmp_dir, monkeypatch):
    monkeypatch.setattr(sweep, "LISTED_ROWS", 7)
    for i in range(50):
        with open(f"{tmp_dir}/f{i}", "w") as f:
            f.write("x")
    assert {os.path.basename(r["path"]) for r in sweep.list_files(spark, f"file:{tmp_dir}/").collect()} == {f"f{i}" for i in range(50)}
    with pytest.raises(FileNotFoundError):
        sweep.list_files(spark, f"{tmp_dir}/absent")


def test_the_driver_holds_no_file_of_the_listing(spark, tmp_dir):
    _tree(tmp_dir, FOLDERS[:3])
    assert "binaryFile" not in sweep.list_files(spark, tmp_dir)._jdf.queryExecution().optimizedPlan().toString()


def test_stored_objects_are_listed_like_folders_of_their_own(spark):
    rows = [(1, 1), (1, 2), (1, 2), (None, 1), (7, None), (-3, 4)] + [(i, n) for i in range(10, 60) for n in range(1, 9)]
    keys = spark.createDataFrame(rows, "index_id bigint, version int").repartition(4)
    columns = ("artifact_key", "folder", "files", "bytes")
    got = [sorted(tuple(r[c] for c in columns) for r in fixtures.listed_objects(spark, write(spark, keys)).collect())
           for write in (fixtures.store_objects, fixtures.write_objects)]
    assert got[0] == got[1] and len(got[0]) == len(set(rows))


def test_a_file_with_no_link_to_spare_is_followed_by_another(spark, monkeypatch):
    monkeypatch.setattr(fixtures, "OBJECT_FOLDERS", 1)
    n = 66_000  # a file of ext4 has 65,000 names at most
    root = fixtures.store_objects(spark, spark.range(n).select(F.col("id").alias("index_id"), F.lit(1).alias("version")))
    assert sweep.list_files(spark, root).agg(F.count("*"), F.sum("bytes")).first()[:] == (n, 9 * n)


def test_the_storage_of_the_orphan_query_takes_little_disk(spark, tmp_dir):
    """Before, every object took a block and a folder of its own, 8 KB."""
    n = 6000
    (spark.range(n).select(F.col("id").alias("o_orderkey"), (F.col("id") % 700).alias("o_custkey"), F.lit(10.0).alias("o_totalprice"),
                           F.concat((F.col("id") % 5 + 1).cast("string"), F.lit("-X")).alias("o_orderpriority"))
     .write.parquet(f"{tmp_dir}/orders.parquet"))
    store = f"{checkpoint_root(spark).split(':', 1)[-1]}/lexidx"
    before = set(os.listdir(store)) if os.path.isdir(store) else set()
    found = artifact_queries.orphan_artifacts(spark, tmp_dir).collect()
    assert len(found) == len(set(found)) == n * 2 // 5
    (root,) = [f"{store}/{name}" for name in os.listdir(store) if name not in before and name.startswith("objects-")]
    blocks, files = {}, 0
    for folder, _, names in os.walk(root):
        files += len(names)
        for path in [folder, *(f"{folder}/{name}" for name in names)]:
            st = os.stat(path)
            blocks[st.st_ino] = st.st_blocks * 512
    assert files == n * 4 // 5 and sum(blocks.values()) < 1024 * files
