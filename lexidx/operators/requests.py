"""Lookups for tables of requests (Q1, Q2, Q5): postings and points in buckets by key.

One literal lookup opens the files its key falls in. A table of requests is a join, and to
join without moving the postings, a version can keep them in buckets by
(field, term, slice), sorted: the requests are exchanged to the buckets and merged there.
A term with very many postings is cut into slices by document id, and its requests are
sent to all of them. Points are bucketed by (field, cell), cells being ranges of values that hold about equally many
points; a range request goes to the cells it touches.

Requests that ask for the same thing have the same answer. Where only totals of it are wanted,
``once_each`` leaves one request for each thing asked, and ``answered`` gives its totals to all that asked:
the work follows what is asked for, not how often.

Buckets are known to the session's catalog; ``open_buckets`` enters a written folder again.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexidx.operators import commits

SLICE_POSTINGS = 1 << 20
CELLS = 1024


@dataclass(frozen=True)
class Buckets:
    """A bucketed table: its name in the session's catalog, where it lies, its keys and their number of buckets.

    ``cuts`` are the slices of the terms that have several, or the cell bounds of each field.
    """
    table: str
    path: str
    keys: tuple
    count: int
    schema: str
    cuts: dict


def _write(df: DataFrame, path: str, keys: list[str], order: list[str], count: int, cuts: dict) -> Buckets:
    spark = df.sparkSession
    b = Buckets(f"lexidx_{uuid.uuid4().hex[:12]}", path, tuple(keys), count, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), cuts)
    # dealt like the buckets, so each bucket is one sorted file
    (df.repartition(count, *keys).sortWithinPartitions(*order).write.bucketBy(count, *keys).sortBy(*order)
     .option("path", f"{path}/rows").saveAsTable(b.table))
    commits.create_if_absent(spark, f"{path}/buckets.json", json.dumps(asdict(b)))
    return b


def open_buckets(spark: SparkSession, path: str) -> Buckets:
    """Enter a folder of buckets in this session's catalog."""
    kept = json.loads(commits.read_text(spark, f"{path}/buckets.json"))
    b = Buckets(**{**kept, "keys": tuple(kept["keys"]), "table": f"lexidx_{uuid.uuid4().hex[:12]}", "path": path})
    keys = ", ".join(b.keys)
    spark.sql(f"CREATE TABLE {b.table} ({b.schema}) USING parquet CLUSTERED BY ({keys}) INTO {b.count} BUCKETS LOCATION '{path}/rows'")
    return b


def close_buckets(spark: SparkSession, b: Buckets) -> None:
    """Take the table out of the catalog; its files stay."""
    spark.sql(f"DROP TABLE IF EXISTS {b.table}")


def bucket_postings(postings: DataFrame, terms: DataFrame, path: str, count: int, slice_postings: int = SLICE_POSTINGS) -> Buckets:
    """(field, term, slice, doc_id, tf) in ``count`` buckets. Terms with slices: never more than there are postings / ``slice_postings``."""
    rows = terms.where(F.col("doc_freq") > slice_postings).select("field", "term", F.ceil(F.col("doc_freq") / F.lit(slice_postings)).alias("slices")).collect()
    large = [(r["field"], r["term"], int(r["slices"])) for r in rows]
    cut = _with_slices(postings.select("field", "term", "doc_id", "tf"), large).withColumn(
        "slice", F.pmod(F.xxhash64("doc_id"), "slices").cast("int")).select("field", "term", "slice", "doc_id", "tf")
    return _write(cut, path, ["field", "term", "slice"], ["field", "term", "slice", "doc_id"], count, {"slices": large})


def _with_slices(df: DataFrame, large: list) -> DataFrame:
    if not large:
        return df.withColumn("slices", F.lit(1))
    known = df.sparkSession.createDataFrame([tuple(x) for x in large], "field string, term string, slices int")
    return df.join(F.broadcast(known), ["field", "term"], "left").withColumn("slices", F.coalesce("slices", F.lit(1)))


def term_lookups(b: Buckets, requests: DataFrame) -> DataFrame:
    """(req_id, doc_id, tf) for requests (req_id, field, term): the documents that hold the exact term."""
    asked = _with_slices(requests.select("req_id", "field", "term"), b.cuts["slices"]).select(
        "req_id", "field", "term", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
    rows = requests.sparkSession.table(b.table)
    return rows.hint("merge").join(asked, ["field", "term", "slice"]).select("req_id", "doc_id", "tf")


def bucket_points(points: DataFrame, path: str, count: int, cells: int = CELLS) -> Buckets:
    """(field, cell, value, doc_id) in ``count`` buckets; at most ``cells`` cells for each field, from its quantiles."""
    at = [i / cells for i in range(1, cells)]
    rows = points.groupBy("field").agg(F.percentile_approx("value", at, 10 * cells).alias("at")).collect()
    bounds = {r["field"]: sorted(set(r["at"])) for r in rows}
    cut = points.withColumn("cell", _cell(bounds, F.col("value"))).select("field", "cell", "value", "doc_id")
    return _write(cut, path, ["field", "cell"], ["field", "cell", "value", "doc_id"], count, {"bounds": bounds})


def _cell(bounds: dict, value):
    """The number of the field's bounds below ``value``: a binary search over one constant for each field."""
    out = F.lit(None).cast("int")
    for field, at in bounds.items():
        if not at:
            found = F.lit(0)
        else:
            known = F.from_json(F.lit(json.dumps(at)), "array<double>")
            steps = [1 << i for i in reversed(range(len(at).bit_length()))]
            found = F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0),
                                lambda n, step: F.when(F.get(known, n + step - 1) < value, n + step).otherwise(n))
        out = F.when(F.col("field") == field, found).otherwise(out)
    return out


def range_lookups(b: Buckets, requests: DataFrame) -> DataFrame:
    """(req_id, doc_id, value) for requests (req_id, field, lo, hi): points from lo to hi, ends included; a null end is open."""
    most = max((len(at) for at in b.cuts["bounds"].values()), default=0)
    lo = F.when(F.col("lo").isNull(), F.lit(0)).otherwise(_cell(b.cuts["bounds"], F.col("lo").cast("double")))
    hi = F.when(F.col("hi").isNull(), F.lit(most)).otherwise(_cell(b.cuts["bounds"], F.col("hi").cast("double")))
    asked = (requests.select("req_id", "field", "lo", "hi", lo.alias("_from"), hi.alias("_to")).where("_from <= _to")
             .select("req_id", "field", "lo", "hi", F.explode(F.sequence("_from", "_to")).alias("cell")))
    rows = requests.sparkSession.table(b.table)
    inside = (F.col("lo").isNull() | (F.col("value") >= F.col("lo"))) & (F.col("hi").isNull() | (F.col("value") <= F.col("hi")))
    return rows.hint("merge").join(asked, ["field", "cell"]).where(inside).select("req_id", "doc_id", "value")


TERM, RANGE = ("field", "term"), ("field", "lo", "hi")


def once_each(requests: DataFrame, asks: tuple) -> DataFrame:
    """One request for each distinct thing asked (``asks``: TERM or RANGE); its ``req_id`` is that thing."""
    return requests.select(*asks).distinct().select(F.struct(*asks).alias("req_id"), *asks)


def answered(requests: DataFrame, totals: DataFrame, asks: tuple) -> DataFrame:
    """(req_id, totals) of every request whose thing asked is among ``totals``, one row for each ``req_id`` of ``once_each``."""
    names = [c for c in totals.columns if c != "req_id"]
    found = totals.select(*[F.col("req_id")[a].alias(f"_{a}") for a in asks], *names)
    same = [F.col(a).eqNullSafe(F.col(f"_{a}")) for a in asks]  # an open end equals an open end
    return requests.join(found, same).select("req_id", *names)
