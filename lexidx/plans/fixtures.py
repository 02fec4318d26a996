"""Inputs derived from the driver's tables (FIXTURES.md §4, G1-G3).

G1: one NDJSON document per `part` row, ``line = p_partkey + 1``, corrupted
by fixed modulus rules (first match wins). Written as text to a fresh
folder below the shared checkpoint root, in line order, so the scan sees
the physical line numbers the oracle computes.
"""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexidx.operators import commits, sweep
from lexidx.plans import tables
from lexidx.session import scratch_path

# The corruption rules of G1, in priority order.
G1_RULES = [
    (97, 0, "blank"),
    (89, 1, "bogus"),
    (83, 2, "title_null"),
    (79, 3, "count_nan"),
    (73, 4, "count_str"),
    (71, 5, "stock_TRUE"),
    (67, 6, "stock_maybe"),
    (61, 7, "tag_int"),
    (59, 8, "not_json"),
    (53, 9, "two_docs"),
]
G1_BAD_KINDS = ("bogus", "title_null", "count_nan", "stock_maybe", "tag_int", "not_json", "two_docs")
TWO_DOCS = '{"title": "one"} {"title": "two"}'


def _esc(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def g1_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    kind = F.lit("ok")
    for mod, rem, name in reversed(G1_RULES):
        kind = F.when(k % mod == rem, F.lit(name)).otherwise(kind)
    p = tables.table(spark, sf_dir, "part").select(
        "p_partkey", "p_name", "p_brand", "p_size", "p_retailprice", kind.alias("kind"))
    kd = F.col("kind")
    size = F.col("p_size").cast("string")
    title = F.when(kd == "title_null", F.lit("null")).otherwise(F.concat(F.lit('"'), _esc(F.col("p_name")), F.lit('"')))
    tag = F.when(kd == "tag_int", F.lit("123")).otherwise(F.concat(F.lit('"'), _esc(F.col("p_brand")), F.lit('"')))
    count = (F.when(kd == "count_nan", F.lit('"a dozen"'))
             .when(kd == "count_str", F.concat(F.lit('" '), size, F.lit(' "'))).otherwise(size))
    stock = (F.when(kd == "stock_TRUE", F.lit('"TRUE"')).when(kd == "stock_maybe", F.lit('"maybe"'))
             .when(F.col("p_size") % 2 == 0, F.lit("true")).otherwise(F.lit("false")))
    extra = F.when(kd == "bogus", F.lit(', "bogus": 1')).otherwise(F.lit(""))
    obj = F.concat(F.lit('{"title": '), title, F.lit(', "tag": '), tag, F.lit(', "count": '), count,
                   F.lit(', "price": '), F.col("p_retailprice").cast("string"),
                   F.lit(', "in_stock": '), stock, extra, F.lit("}"))
    value = (F.when(kd == "blank", F.when(k % 194 == 0, F.lit("")).otherwise(F.lit("   ")))
             .when(kd == "two_docs", F.lit(TWO_DOCS))
             .when(kd == "not_json", F.concat(F.lit("not json "), k.cast("string")))
             .otherwise(obj))
    return p.select((k + 1).alias("line"), value.alias("value"), "kind")


def write_g1(spark: SparkSession, sf_dir: str) -> str:
    """Write G1 as text files whose name order is line order; return the folder."""
    path = scratch_path(spark, "g1-ndjson")
    g1_lines(spark, sf_dir).orderBy("line").select("value").write.mode("overwrite").text(path)
    return path


# ---- G2: catalog tables from customer and orders ------------------------

# Order priority digit -> version status.
PRIORITY_STATUS = [("1", "READY"), ("2", "UPLOADED"), ("3", "BUILT"), ("4", "BUILDING"), ("5", "FAILED")]


def artifact_key(index_id: Column, version: Column) -> Column:
    """A2: {index}/{version}/index.tar.gz."""
    return F.concat_ws("/", index_id.cast("string"), version.cast("string"), F.lit("index.tar.gz"))


def search_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("index_id"), F.lower("c_name").alias("name"),
        F.col("c_mktsegment").alias("description"))


def index_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions numbered per index in order-key order: a running count per
    customer that stays skew-safe if one customer holds most orders."""
    from lexidx.operators import ordered
    o = tables.table(spark, sf_dir, "orders")
    status = F.lit(None).cast("string")
    for digit, st in reversed(PRIORITY_STATUS):
        status = F.when(F.substring("o_orderpriority", 1, 1) == digit, F.lit(st)).otherwise(status)
    o = o.select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice", F.lit(True).alias("_one"))
    o = ordered.running_count(o, "o_custkey", "o_orderkey", "_one", "_version")
    v = o.select(F.col("o_orderkey").alias("version_id"), F.col("o_custkey").alias("index_id"),
                 F.col("_version").cast("int").alias("version"), status.alias("status"), "o_totalprice")
    built = F.col("status").isin("BUILT", "UPLOADED", "READY")
    return v.select(
        "version_id", "index_id", "version", "status",
        F.when(built, (F.col("o_totalprice").cast("bigint") % 1000)).alias("doc_count"),
        F.when(built, F.col("o_totalprice").cast("bigint")).alias("artifact_size"),
        F.when(built, F.sha2(F.col("version_id").cast("string"), 256)).alias("checksum"),
        F.when(F.col("status").isin("UPLOADED", "READY"),
               artifact_key(F.col("index_id"), F.col("version"))).alias("artifact_key"))


def index_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests for index ids: one per order; every 300th points nowhere."""
    o = tables.table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("req_id"), F.when(
        F.col("o_orderkey") % 300 == 0, F.col("o_custkey") + 1000000).otherwise(F.col("o_custkey")).alias("index_id"))


def version_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests for (index, version): one per version; every 300th names a
    missing index, every 700th a version that does not exist."""
    v = index_version(spark, sf_dir)
    k = F.col("version_id")
    return v.select(
        k.alias("req_id"),
        F.when(k % 300 == 0, F.col("index_id") + 1000000).otherwise(F.col("index_id")).alias("index_id"),
        F.when(k % 700 == 0, F.col("version") + 1000).otherwise(F.col("version")).alias("version"))


# ---- G3: lifecycle log from events --------------------------------------

# Event type -> lifecycle event kind.
EVENT_KIND = [("signup", "CREATED"), ("view", "BUILDING"), ("click", "BUILT"), ("purchase", "UPLOADED")]
READY_BELOW = 20.0


def lifecycle_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.table(spark, sf_dir, "events")
    kind = F.when(F.col("value") < READY_BELOW, F.lit("READY")).otherwise(F.lit("FAILED"))
    kind = F.when(F.col("event_type") != "error", F.lit(None)).otherwise(kind)
    for et, k in EVENT_KIND:
        kind = F.when(F.col("event_type") == et, F.lit(k)).otherwise(kind)
    return e.select(
        F.col("user_id").alias("version_id"), F.col("event_id").alias("seq"), "ts", kind.alias("kind"),
        F.floor("value").cast("bigint").alias("doc_count"),
        F.floor(F.col("value") * 100).cast("bigint").alias("artifact_size"),
        F.sha2("props", 256).alias("checksum"),
        F.concat_ws("/", F.col("user_id").cast("string"), F.col("event_id").cast("string"),
                    F.lit("index.tar.gz")).alias("artifact_key"),
        F.concat(F.lit("error "), F.col("props")).alias("error_message"))


# ---- index definitions for the audit (V12, V13) -------------------------

# Field types by nation key modulo 6 ("bogus" is invalid).
DEFINITION_TYPES = ["keyword", "text", "long", "double", "boolean", "bogus"]


def index_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexidx.operators.schema import FIELDS_TYPE
    c = tables.table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    name = (F.when(k % 7 == 0, F.col("c_name")).when(k % 11 == 0, F.lit(""))
            .when(k % 13 == 0, F.repeat(F.lit("x"), 70))
            .otherwise(F.lower(F.replace(F.col("c_name"), F.lit("#"), F.lit("_")))))
    desc = F.when(k % 17 == 0, F.repeat(F.col("c_mktsegment"), 60)).otherwise(F.col("c_mktsegment"))
    ftype = F.element_at(F.array(*[F.lit(t) for t in DEFINITION_TYPES]), (F.col("c_nationkey") % 6 + 1).cast("int"))
    second = F.when(k % 23 == 0, F.lit("title")).when(k % 29 == 0, F.lit("Bad Field")).otherwise(F.lit("seg"))
    fields = F.when(k % 19 == 0, F.array().cast(FIELDS_TYPE)).otherwise(F.array(
        F.struct(F.lit("title").alias("name"), F.lit("text").alias("type")),
        F.struct(second.alias("name"), ftype.alias("type"))))
    return c.select(k.alias("index_id"), name.alias("name"), desc.alias("description"), fields.alias("fields"))


# ---- G4: stored objects -------------------------------------------------

def write_objects(spark: SparkSession, keys: DataFrame) -> str:
    """A storage folder with an object of its own for each (index_id, version): {root}/index_id=<id>/version=<n>/part-*.

    On a local disk Hadoop starts processes for the permissions of every new file and the driver moves the
    files one by one, so there the tasks create the objects themselves, below the shared folder.
    """
    root = scratch_path(spark, "objects")
    # A number of tasks of its own: the keys are few bytes, the files behind them are the work.
    dealt = keys.select("index_id", "version", F.lit("artifact").alias("value")).repartition(
        max(sweep.LISTING_TASKS, 4 * spark.sparkContext.defaultParallelism), "index_id", "version")
    local = commits.local_path(spark, root)
    if local is None:
        dealt.write.partitionBy("index_id", "version").text(root)
        return root

    def create(batches):
        for batch in batches:
            for index_id, version, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                names = ("__HIVE_DEFAULT_PARTITION__" if k is None else k for k in (index_id, version))
                folder = "{}/index_id={}/version={}".format(local, *names)
                os.makedirs(folder, exist_ok=True)
                with open(f"{folder}/part-00000.txt", "w", encoding="utf-8") as f:
                    f.write(f"{value}\n")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    os.makedirs(local, exist_ok=True)
    dealt.mapInArrow(create, "n long").agg(F.sum("n")).collect()
    return root


OBJECT_FOLDERS = 256


def store_objects(spark: SparkSession, keys: DataFrame) -> str:
    """The objects of ``write_objects`` as files of a few large folders: {root}/<folder>/v<id>,<n>.

    On a local disk a small file takes a block and a folder of its own another, 8 KB for each object. Here an
    object takes an entry in its folder: it is linked to an equal one that is there already. Other storages have no folders.
    """
    root = scratch_path(spark, "objects")
    local = commits.local_path(spark, root)
    if local is None:
        return write_objects(spark, keys)
    folder = F.pmod(F.xxhash64("index_id", "version"), F.lit(OBJECT_FOLDERS))
    dealt = keys.select("index_id", "version", F.lit("artifact").alias("value"), folder.alias("folder")).repartition(
        max(sweep.LISTING_TASKS, 4 * spark.sparkContext.defaultParallelism), "folder")

    def create(batches):
        written = {}  # folder -> a file in it
        for batch in batches:
            for index_id, version, value, folder in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                names = ("__HIVE_DEFAULT_PARTITION__" if k is None else k for k in (index_id, version))
                path = "{}/{}/v{},{}".format(local, folder, *names)
                try:
                    if folder in written:
                        os.link(written[folder], path)
                        continue
                    os.makedirs(os.path.dirname(path), exist_ok=True)
                except FileExistsError:
                    continue
                except OSError:  # a file can't have more links, or none at all on this disk
                    pass
                with open(path, "w", encoding="utf-8") as f:
                    f.write(f"{value}\n")
                written[folder] = path
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    os.makedirs(local, exist_ok=True)
    dealt.mapInArrow(create, "n long").agg(F.sum("n")).collect()
    return root


def listed_objects(spark: SparkSession, root: str) -> DataFrame:
    """The folders of ``sweep.stored_folders`` with the keys that a catalog uses for them."""
    files = sweep.list_files(spark, root)
    name = F.substring_index("path", "/", -1)
    key = F.replace(F.substring(name, 2, 1 << 20), F.lit(","), F.lit("/"))
    own = files.withColumn("path", F.when(name.contains(","), F.concat(F.lit("objects/"), key, F.lit("/index.tar.gz")))
                           .otherwise(F.regexp_replace("path", r"index_id=([^/]+)/version=([^/]+)/[^/]*$", "objects/$1/$2/index.tar.gz")))
    return sweep.stored_folders(own, r"objects/(([^/]+/[^/]+/index\.tar\.gz))$")


# ---- G5: archive entries from pages -------------------------------------

# Pages per archive and the unsafe-entry rules (by page_id).
PAGES_PER_ARCHIVE = 50
ESCAPE_MOD, DOT_MOD, SYMLINK_MOD, FIFO_MOD = 13, 23, 17, 19
URL_HOST = r"^https?://([^/?#]+)"
URL_PATH = r"^https?://[^/?#]+(/[^?#]*)?"


def page_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of archives of at most PAGES_PER_ARCHIVE pages each: (archive,
    position, entry, entry_type, size). Every archive is a bounded group."""
    p = tables.table(spark, sf_dir, "pages")
    pid = F.col("page_id")
    base = F.concat(F.regexp_extract("url", URL_HOST, 1), F.regexp_extract("url", URL_PATH, 1))
    entry = (F.when(pid % ESCAPE_MOD == 0, F.concat(F.lit("../"), base))
             .when(pid % DOT_MOD == 0, F.concat(F.lit("./"), base)).otherwise(base))
    kind = (F.when(pid % SYMLINK_MOD == 0, F.lit("symlink")).when(pid % FIFO_MOD == 0, F.lit("other"))
            .otherwise(F.lit("file")))
    rows = p.select(F.floor(pid / PAGES_PER_ARCHIVE).alias("grp"), "page_id", entry.alias("entry"), kind.alias("entry_type"),
                    F.when(kind == "file", F.octet_length("html")).otherwise(0).cast("bigint").alias("size"))
    w = Window.partitionBy("grp").orderBy("page_id")
    return rows.select(
        F.concat(F.lit("pages-"), F.col("grp").cast("string"), F.lit(".tar.gz")).alias("archive"),
        (F.row_number().over(w) - 1).cast("int").alias("position"), "entry", "entry_type", "size")
