"""Catalog and lifecycle as tables.

``catalog``: (index_id, name, description, ...). ``versions``: (version_id,
index_id, version, status, doc_count, artifact_size, checksum, artifact_key,
error_message). Requests are tables too; every operator answers a whole
batch of requests with joins and aggregates, never a driver loop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexidx.operators import fold, ordered

# The version statuses and the two groups the rules use.
STATUSES = ("CREATED", "BUILDING", "BUILT", "UPLOADED", "READY", "FAILED")
ACTIVE = ("CREATED", "BUILDING")
HAS_ARTIFACT = ("UPLOADED", "READY")

# Messages that must read as they do.
NAME_BLANK = "Index name must not be blank"
NAME_TAKEN = "Index with name '%s' already exists"
INDEX_NOT_FOUND = "Index %s not found"
VERSION_NOT_FOUND = "Version %s not found for index %s"
BUILD_ACTIVE = "Index %s already has an active build"
NOT_AVAILABLE = "Artifact for version %s of index %s is not available (status=%s)"


def register_indexes(batch: DataFrame, catalog: DataFrame) -> DataFrame:
    """Accept a batch of (req_id, name); refuse names already present or
    repeated earlier in the batch. The earliest request of a name is found by
    an aggregate joined back (skew-safe), not a window over the name."""
    first = batch.where(F.col("name").isNotNull()).groupBy("name").agg(F.min("req_id").alias("_first"))
    taken = catalog.select("name").distinct().withColumn("_taken", F.lit(True))
    out = batch.join(first, "name", "left").join(taken, "name", "left")
    nameless = F.col("name").isNull()
    refused = nameless | F.col("_taken").isNotNull() | (F.col("req_id") != F.col("_first"))
    return out.select(
        "req_id", "name",
        F.when(refused, F.lit("REFUSED")).otherwise(F.lit("ACCEPTED")).alias("status"),
        F.when(nameless, F.lit(NAME_BLANK))
        .when(refused, F.format_string(NAME_TAKEN, F.col("name"))).alias("message"))


def lookup_indexes(requests: DataFrame, catalog: DataFrame, by: str = "index_id") -> DataFrame:
    """Resolve (req_id, index_id) -- or (req_id, name) with ``by="name"``
    -- requests to catalog rows or a not-found error."""
    other = "name" if by == "index_id" else "index_id"
    j = requests.select("req_id", by).join(catalog.select("index_id", "name"), by, "left")
    found = F.col(other).isNotNull()
    return j.select("req_id", "index_id", "name",
                    F.when(found, F.lit("FOUND")).otherwise(F.lit("NOT_FOUND")).alias("status"),
                    F.when(~found, F.format_string(INDEX_NOT_FOUND, F.col(by))).alias("message"))


def list_indexes_page(catalog: DataFrame, page: int, size: int) -> DataFrame:
    """One page by name (stable order) plus the total as a scalar subquery."""
    total = catalog.select(F.count(F.lit(1))).scalar()
    return (catalog.orderBy("name", "index_id").offset(page * size).limit(size)
            .select("index_id", "name", total.alias("total")))


def list_versions(requests: DataFrame, catalog: DataFrame, versions: DataFrame) -> DataFrame:
    """C4: all versions of each requested index, newest first; a missing
    index gives one error row."""
    known = requests.join(catalog.select("index_id"), "index_id", "left_semi")
    missing = requests.join(catalog.select("index_id"), "index_id", "left_anti")
    rows = known.join(versions, "index_id").select(
        "index_id", "version", "status", F.lit(None).cast("string").alias("error"))
    errs = missing.select("index_id", F.lit(None).cast("int").alias("version"),
                          F.lit(None).cast("string").alias("status"),
                          F.format_string(INDEX_NOT_FOUND, F.col("index_id")).alias("error"))
    return rows.unionByName(errs).orderBy("index_id", F.col("version").desc())


def resolve_versions(requests: DataFrame, catalog: DataFrame, versions: DataFrame) -> DataFrame:
    """Resolve (req_id, index_id, version) to a version row, telling a
    missing index from a missing version."""
    idx = catalog.select("index_id", F.lit(True).alias("_idx"))
    v = versions.select("index_id", "version", "version_id", "status", "artifact_key")
    j = requests.join(idx, "index_id", "left").join(v, ["index_id", "version"], "left")
    res = (F.when(F.col("_idx").isNull(), F.lit("INDEX_NOT_FOUND"))
           .when(F.col("version_id").isNull(), F.lit("VERSION_NOT_FOUND")).otherwise(F.lit("FOUND")))
    msg = (F.when(F.col("_idx").isNull(), F.format_string(INDEX_NOT_FOUND, F.col("index_id")))
           .when(F.col("version_id").isNull(), F.format_string(
               VERSION_NOT_FOUND, F.col("version"), F.col("index_id"))))
    return j.select("req_id", "index_id", "version", "version_id", res.alias("resolution"),
                    "status", "artifact_key", msg.alias("message"))


def next_version(catalog: DataFrame, versions: DataFrame) -> DataFrame:
    """max(version) + 1 per index, 1 when it has none (partial aggregate
    before the join, so a hot index is one row)."""
    mx = versions.groupBy("index_id").agg(F.max("version").alias("_max"))
    return catalog.select("index_id").join(mx, "index_id", "left").select(
        "index_id", (F.coalesce("_max", F.lit(0)) + 1).cast("int").alias("next_version"))


def active_builds(versions: DataFrame) -> DataFrame:
    """Per index, the number of CREATED/BUILDING versions; conflict
    message when there is any."""
    a = versions.groupBy("index_id").agg(
        F.count(F.when(F.col("status").isin(*ACTIVE), F.lit(1))).alias("active_count"))
    return a.select("index_id", "active_count", F.when(F.col("active_count") > 0, F.format_string(
        BUILD_ACTIVE, F.col("index_id"))).alias("message"))


def constraint_audit(catalog: DataFrame, versions: DataFrame) -> DataFrame:
    """Breaches of the unique name, unique (index, version) and one
    active build per index rules: (rule, subject, n)."""
    names = catalog.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
        F.lit("DUPLICATE_NAME").alias("rule"), F.col("name").alias("subject"), "n")
    iv = versions.groupBy("index_id", "version").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
        F.lit("DUPLICATE_VERSION").alias("rule"),
        F.concat_ws(":", F.col("index_id").cast("string"), F.col("version").cast("string")).alias("subject"), "n")
    act = (versions.where(F.col("status").isin(*ACTIVE)).groupBy("index_id")
           .agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
               F.lit("MULTIPLE_ACTIVE_BUILDS").alias("rule"), F.col("index_id").cast("string").alias("subject"), "n"))
    return names.unionByName(iv).unionByName(act)


def cascade_delete(catalog: DataFrame, versions: DataFrame, deleted: DataFrame):
    """Drop the deleted indexes and, with them, their versions; versions
    whose index is gone are orphans and go as well. Returns (catalog, versions)."""
    cat = catalog.join(deleted.select("index_id"), "index_id", "left_anti")
    ver = versions.join(cat.select("index_id"), "index_id", "left_semi")
    return cat, ver


def artifact_gate(resolved: DataFrame) -> DataFrame:
    """Only UPLOADED and READY versions expose their artifact."""
    ok = F.col("status").isin(*HAS_ARTIFACT)
    return resolved.where(F.col("resolution") == "FOUND").select(
        "req_id", "index_id", "version", "status",
        F.when(ok, F.col("artifact_key")).alias("artifact_key"),
        F.when(~ok, F.format_string(NOT_AVAILABLE,
                                    F.col("version"), F.col("index_id"), F.col("status"))).alias("message"))


# ---- lifecycle fold (C11, C12) --------------------------------------------

UNGUARDED = fold.UNGUARDED


def classify_events(events: DataFrame) -> DataFrame:
    """Outcome of every lifecycle event when replayed in ``seq`` order per
    version: APPLIED, DUPLICATE (repeated CREATED/READY), STALE (guarded
    transition refused) or NOT_FOUND (before the version exists).

    BUILDING/BUILT/UPLOADED always apply, so they cut each version's log into
    segments; inside a segment only the first READY/FAILED can depend on the
    state, which is fixed by the segment head. Each event's fate is thus a
    running count (the segment number) plus per-segment minimums: aggregates
    joined back, and a running count that splits a hot version over many
    tasks (``ordered.running_count``). No event list is ever collected.
    """
    created = (events.where(F.col("kind") == "CREATED").groupBy("version_id")
               .agg(F.min("seq").alias("_created")))
    e = events.join(created, "version_id", "left")
    # Only transitions after creation move the state.
    live_unguarded = F.col("kind").isin(*UNGUARDED) & (F.col("seq") > F.col("_created"))
    e = e.withColumn("_lu", F.coalesce(live_unguarded, F.lit(False)))
    e = ordered.running_count(e, "version_id", "seq", "_lu", "_seg")
    rf = F.col("kind").isin("READY", "FAILED")
    # The head's kind as a small code keeps the aggregate hash-based.
    head_code = F.when(F.col("_lu"), F.when(F.col("kind") == "UPLOADED", 3)
                       .when(F.col("kind") == "BUILT", 2).otherwise(1))
    seg = e.groupBy("version_id", "_seg").agg(
        F.max(head_code).alias("_head"),
        F.min(F.when(rf, F.col("seq"))).alias("_first_rf"),
        F.min(F.when(F.col("kind") == "READY", F.col("seq"))).alias("_first_ready"))
    e = e.join(seg, ["version_id", "_seg"])
    # READY applies only straight after UPLOADED; once READY, FAILED is ignored.
    ready_reached = (F.col("_head") == 3) & (F.col("_first_ready") == F.col("_first_rf"))
    outcome = (F.when(F.col("_created").isNull() | (F.col("seq") < F.col("_created")), F.lit("NOT_FOUND"))
               .when(F.col("kind") == "CREATED", F.when(F.col("seq") == F.col("_created"), F.lit("APPLIED"))
                     .otherwise(F.lit("DUPLICATE")))
               .when(F.col("kind").isin(*UNGUARDED), F.lit("APPLIED"))
               .when(F.col("kind") == "READY", F.when(ready_reached & (F.col("seq") == F.col("_first_ready")),
                                                      F.lit("APPLIED"))
                     .when(ready_reached, F.lit("DUPLICATE")).otherwise(F.lit("STALE")))
               .when(F.col("kind") == "FAILED", F.when(ready_reached & (F.col("seq") > F.col("_first_ready")),
                                                       F.lit("STALE")).otherwise(F.lit("APPLIED"))))
    return e.withColumn("outcome", outcome).drop("_created", "_lu", "_seg", "_head", "_first_rf", "_first_ready")


def fold_versions(events: DataFrame, snapshot: DataFrame | None = None) -> DataFrame:
    """C11 + C12: current version rows from the event log, and from the rows before it if given.

    Events: (version_id, seq, ts, kind, doc_count, artifact_size, checksum,
    artifact_key, error_message). Each field is the value of the last
    applied event that writes it. See ``fold``: one scan, the log dealt in
    ranges of (version, seq), every stretch reduced to one small function.
    """
    return fold.fold(events, snapshot)
