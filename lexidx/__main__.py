"""Command line for cluster jobs (run with spark-submit or python -m lexidx).

  build  NDJSON -> published version; appends its lifecycle events (Parquet)
  load   verify a published version and report its status row
  fold   current version rows from a lifecycle event log

The session comes from the deployment (master, spark.checkpoint.dir and
the settings of lexidx.session.CLUSTER_CONF are set there).
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lexidx.operators import artifact, catalog, versioning
from lexidx.operators.schema import fields_of
from lexidx.session import ensure_conf


def _fields(spec: str):
    """title:text,tag:keyword,count:long"""
    return fields_of([tuple(p.split(":", 1)) for p in spec.split(",") if p])


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(prog="lexidx")
    sub = ap.add_subparsers(dest="cmd", required=True)
    b = sub.add_parser("build")
    b.add_argument("--source", required=True)
    b.add_argument("--fields", required=True)
    b.add_argument("--root", required=True)
    b.add_argument("--index", required=True)
    b.add_argument("--version", type=int, required=True)
    b.add_argument("--version-id", required=True)
    b.add_argument("--layout", choices=["range", "local"], default="range")
    b.add_argument("--events", required=True, help="lifecycle log folder (Parquet, appended)")
    ld = sub.add_parser("load")
    ld.add_argument("--root", required=True)
    ld.add_argument("--index", required=True)
    ld.add_argument("--version", type=int, required=True)
    ld.add_argument("--versions", required=True, help="current version rows (the output of fold)")
    fo = sub.add_parser("fold")
    fo.add_argument("--events", required=True)
    fo.add_argument("--out", required=True)
    a = ap.parse_args(argv)

    spark = SparkSession.builder.appName(f"lexidx-{a.cmd}").getOrCreate()
    ensure_conf(spark)
    if a.cmd == "build":
        ev = versioning.build_version(spark, a.source, _fields(a.fields), a.root, a.index,
                                      a.version, a.version_id, layout=a.layout)
        ev.write.mode("append").parquet(a.events)
        ev.select("kind", "error_message").show(truncate=False)
    elif a.cmd == "load":
        artifact.load_version(spark, a.root, a.index, a.version, spark.read.parquet(a.versions)).show(truncate=False)
    else:
        folded = catalog.fold_versions(spark.read.parquet(a.events))
        # Load looks versions up by index and number; the key of a published artifact names both.
        folded.select("*", F.regexp_extract("artifact_key", "index_id=([^/]+)", 1).alias("index_id"),
                      F.expr("try_cast(regexp_extract(artifact_key, 'version=([0-9]+)', 1) as int)").alias("version")) \
            .write.mode("overwrite").parquet(a.out)


if __name__ == "__main__":
    main()
