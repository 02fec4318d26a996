"""Running counts per key in a sort order, without one task per key.

A window partitioned by the key puts every row of a key into one task; a
key holding a third of all rows would make that task a third of the job.
Here rows are dealt in ranges of (key, order), so a key's rows are cut by rank, however
sparse or crowded its order is. Every task counts through its range once; only the first key of a
range can have rows in the ranges before it, so one small row per range (its first and last key and their
counts) is all that has to be known of the others. The same plan serves every size, rows are shuffled
once, and building it runs no job.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def new_key(keys: pa.Array, before) -> np.ndarray:
    """Marks the rows whose key differs from that of the row before; a null key equals a null key."""
    previous = pa.concat_arrays([pa.array([before], keys.type), keys.slice(0, len(keys) - 1)])
    differ = pc.fill_null(pc.not_equal(keys, previous), False).to_numpy(zero_copy_only=False)
    one_null = pc.xor(pc.is_null(keys), pc.is_null(previous)).to_numpy(zero_copy_only=False)
    return differ | one_null


def running_count(df: DataFrame, key: str, order: str, flag: str, out: str, ranges: int | None = None) -> DataFrame:
    """Add ``out`` = number of rows with ``flag`` true among the rows of the
    same ``key`` up to and including this one in ``order``.

    Rows with a null key form a group of their own, rows with a null order
    come first (in any order among themselves); a null flag counts as false. ``ranges`` defaults to the session's shuffle partitions.
    """
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # A fixed number of ranges: both readers below see the same ones.
    dealt = (df.withColumn("_on", F.coalesce(F.col(flag), F.lit(False)).cast("long"))
             .repartitionByRange(n, F.col(key).asc_nulls_first(), F.col(order).asc_nulls_first())
             .sortWithinPartitions(F.col(key).asc_nulls_first(), F.col(order).asc_nulls_first()))
    dealt = dealt.withColumn("_range", F.spark_partition_id())

    def count(batches):
        known, count_so_far, first = None, 0, True
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, on = batch.column(key), batch.column("_on").to_numpy()
            fresh = new_key(keys, known)
            if first:
                fresh[0], first = True, False
            sums = np.cumsum(on)
            # the sum before each row's key began; before any did in this batch, minus what the key has from earlier ones
            base = sums - on
            base[0] = 0 if fresh[0] else -count_so_far
            local = sums - base[np.maximum.accumulate(np.where(fresh, np.arange(len(base)), 0))]
            known, count_so_far = keys[-1].as_py(), int(local[-1])
            yield batch, local, fresh

    def rows(batches):
        ordinal = -1
        for batch, local, fresh in count(batches):
            numbers = ordinal + np.cumsum(fresh)
            ordinal = int(numbers[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(local), pa.array(numbers == 0)], [*batch.schema.names, "_local", "_first"])

    def summary(batches):
        seen = None
        for batch, local, fresh in count(batches):
            keys = batch.column(key)
            starts = np.flatnonzero(fresh)
            if seen is None:
                seen = {"_range": batch.column("_range")[0].as_py(), "first": keys[0].as_py(), "several": False, "of_first": 0}
                starts = starts[1:]
            if not seen["several"]:
                end = starts[0] - 1 if len(starts) else len(local) - 1
                if end >= 0:
                    seen["of_first"] = int(local[end])
                seen["several"] = bool(len(starts))
            seen["last"], seen["of_last"] = keys[-1].as_py(), int(local[-1])
        if seen is not None:
            yield pa.RecordBatch.from_pylist([seen], pa.schema([
                ("_range", pa.int32()), ("first", keys.type), ("of_first", pa.int64()), ("last", keys.type), ("of_last", pa.int64()), ("several", pa.bool_())]))

    kind = df.schema[key].dataType
    with_count = T.StructType([*dealt.schema.fields, T.StructField("_local", T.LongType()), T.StructField("_first", T.BooleanType())])
    counted = dealt.mapInArrow(rows, with_count)
    # Both branches read one exchange (a reused one): nothing is pruned below them. Rows check that they agree.
    ends = dealt.mapInArrow(summary, T.StructType([
        T.StructField("_range", T.IntegerType()), T.StructField("first", kind), T.StructField("of_first", T.LongType()),
        T.StructField("last", kind), T.StructField("of_last", T.LongType()), T.StructField("several", T.BooleanType())]))
    # One row for each range. What a range's last key has so far: all of it since the range in which it began.
    w = Window.orderBy("_range")
    same = F.lag("last").over(w).eqNullSafe(F.col("first"))
    chained = ends.withColumn("_chain", F.sum((F.col("several") | ~same).cast("int")).over(w))
    so_far = chained.withColumn("_sum", F.sum("of_last").over(Window.partitionBy("_chain").orderBy("_range")))
    before = so_far.select("_range", F.col("first").alias("_of"), F.coalesce(F.when(same, F.lag("_sum").over(w)), F.lit(0)).alias("_before"))
    total = (F.when(~F.col("_first"), F.col("_local")).when(F.col(key).eqNullSafe(F.col("_of")), F.col("_local") + F.col("_before"))
             .otherwise(F.raise_error(F.lit("running_count: ranges of the two readers differ")).cast("long")))
    return counted.join(F.broadcast(before), "_range", "left").select(*df.columns, total.alias(out))
