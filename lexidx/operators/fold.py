"""The lifecycle fold as composition of transitions.

An event is a function over the few statuses a version can have: for each status
before it, the status after it, whether it applied, and which fields it writes. Such
functions compose in log order, and a stretch of any length is again one function of
that small size. So the log is dealt by (version, seq) in ranges, which splits a
version of any size by rank; every task reduces its stretch in one sorted pass
with constant memory; and the few stretches of a version that spans tasks are composed.

Only the first version of a task can have events before it, so only its function is
needed for every status; all others start from nothing. A snapshot of current rows enters as one event of its
version that stands before all others, so snapshot plus new events gives the row that a full replay gives.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# The events that always apply to an existing version, and the statuses an event can meet.
UNGUARDED = ("BUILDING", "BUILT", "UPLOADED")
BEFORE = (None, "CREATED", "BUILDING", "BUILT", "UPLOADED", "READY", "FAILED")

SNAPSHOT = "#snapshot"
EVENT = ("version_id", "seq", "kind", "ts", "doc_count", "artifact_size", "checksum", "artifact_key", "error_message")
ROW = ("status", "doc_count", "artifact_size", "checksum", "artifact_key", "error_message", "applied_events", "created_at", "updated_at")
# Places in a path: ROW, then whether the build fields, the key and the message were written on it.
STATUS, COUNT, SIZE, CHECKSUM, KEY, ERROR, APPLIED, CREATED_AT, UPDATED_AT, BUILD_SET, KEY_SET, ERROR_SET = range(12)


def start(status: str | None) -> list:
    return [status, None, None, None, None, None, 0, None, None, False, False, False]


def step(path: list, kind, ts, doc_count, artifact_size, checksum, artifact_key, error_message) -> bool:
    """Apply one event to a path, in place; False if the status refuses it."""
    status = path[STATUS]
    if status is None:
        if kind != "CREATED":
            return False
        path[CREATED_AT] = ts
    elif kind == "READY":
        if status != "UPLOADED":
            return False
    elif kind == "FAILED":
        if status == "READY":
            return False
        path[COUNT:ERROR + 1] = None, None, None, None, error_message
        path[BUILD_SET:] = True, True, True
    elif kind == "BUILT":
        path[COUNT:KEY] = doc_count, artifact_size, checksum
        path[BUILD_SET] = True
    elif kind == "UPLOADED":
        path[KEY], path[KEY_SET] = artifact_key, True
    elif kind != "BUILDING":
        return False  # a repeated CREATED, or no kind of event
    path[STATUS] = kind
    path[APPLIED] += 1
    path[UPDATED_AT] = ts
    return True


def _path_type(events: DataFrame) -> T.StructType:
    of = {f.name: f.dataType for f in events.schema.fields}
    types = {"status": T.StringType(), "applied_events": T.LongType(), "created_at": of["ts"], "updated_at": of["ts"]}
    return T.StructType([T.StructField("start", T.StringType()), *(T.StructField(c, types.get(c, of.get(c))) for c in ROW),
                         *(T.StructField(c, T.BooleanType()) for c in ("build_set", "key_set", "error_set"))])


def stretches(events: DataFrame) -> DataFrame:
    """(version_id, first, paths): every task's function for each of its versions; ``first`` orders those of one version.

    ``events`` has the EVENT columns and ``snapshot``, a row of ROW or null.
    """
    path_type = _path_type(events)
    schema = T.StructType([T.StructField("version_id", events.schema["version_id"].dataType), T.StructField("first", events.schema["seq"].dataType),
                           T.StructField("paths", T.ArrayType(path_type))])
    arrow = to_arrow_schema(schema)
    names = [f.name for f in path_type.fields]

    def run(batches):
        out, now, first, paths = [], None, None, None
        before_all = True  # the version at hand is the task's first

        def done():
            out.append({"version_id": now, "first": first, "paths": [dict(zip(names, [s, *p])) for s, p in paths]})

        for batch in batches:
            for version, seq, kind, *rest, row in zip(*(c.to_pylist() for c in batch.columns)):
                if paths is None or version != now:
                    if paths is not None:
                        done()
                        before_all = False
                    now, first = version, seq
                    paths = [(s, start(s)) for s in (BEFORE if before_all else BEFORE[:1])]
                if kind == SNAPSHOT:
                    paths = [(s, [*(row[c] for c in ROW), True, True, True]) for s, _ in paths]
                    continue
                for _, p in paths:
                    step(p, kind, *rest)
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist(out, arrow)
                out = []
        if paths is not None:
            done()
        if out:
            yield pa.RecordBatch.from_pylist(out, arrow)

    dealt = events.select(*EVENT, "snapshot").repartitionByRange("version_id", "seq").sortWithinPartitions("version_id", "seq")
    return dealt.mapInArrow(run, schema)


def compose(parts: DataFrame) -> DataFrame:
    """The row of each version: its stretches' functions in order, from nothing. Versions that never came to be have none."""
    paths = parts.schema["paths"].dataType.elementType
    state = F.struct(*[(F.lit(0).cast("long") if c == "applied_events" else F.lit(None).cast(paths[c].dataType)).alias(c) for c in ROW])

    def follow(row, part):
        path = F.filter(part["paths"], lambda p: p["start"].eqNullSafe(row["status"]))[0]

        def field(c, written):
            return F.when(path[written], path[c]).otherwise(row[c]).alias(c)
        return F.struct(
            path["status"].alias("status"), *(field(c, "build_set") for c in ("doc_count", "artifact_size", "checksum")),
            field("artifact_key", "key_set"), field("error_message", "error_set"),
            (row["applied_events"] + path["applied_events"]).alias("applied_events"),
            F.coalesce(row["created_at"], path["created_at"]).alias("created_at"),
            F.when(path["applied_events"] > 0, path["updated_at"]).otherwise(row["updated_at"]).alias("updated_at"))

    # One stretch for nearly every version, and never more than there are tasks.
    by_version = parts.groupBy("version_id").agg(F.sort_array(F.collect_list(F.struct("first", "paths"))).alias("parts"))
    return (by_version.select("version_id", F.aggregate("parts", state, follow).alias("row")).where(F.col("row.status").isNotNull())
            .select("version_id", "row.*"))


def fold(events: DataFrame, snapshot: DataFrame | None = None) -> DataFrame:
    """Current rows (version_id and ROW) from a log of events, and from the rows that stood before it.

    Events without a version or of an unknown kind change nothing. ``snapshot`` has the columns of the result.
    """
    log = events.select(*EVENT).where(F.col("version_id").isNotNull())
    types = {f.name: f.dataType for f in _path_type(log).fields}
    none = F.lit(None).cast(T.StructType([T.StructField(c, types[c]) for c in ROW]))
    log = log.withColumn("snapshot", none)
    if snapshot is not None:
        rows = snapshot.where(F.col("version_id").isNotNull() & F.col("status").isNotNull())
        at = {f.name: f.dataType for f in log.schema.fields}
        log = log.unionByName(rows.select(
            F.col("version_id").cast(at["version_id"]).alias("version_id"), F.lit(SNAPSHOT).alias("kind"),
            *[F.lit(None).cast(at[c]).alias(c) for c in EVENT if c not in ("version_id", "kind")],  # a null seq comes before all others
            F.struct(*[F.col(c).cast(types[c]).alias(c) for c in ROW]).alias("snapshot")))
    return compose(stretches(log))
