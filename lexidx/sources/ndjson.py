"""NDJSON document sets (S1-S3): physical line numbers, JSON decode.

A document set is one or more newline-delimited JSON files. Lines are
numbered from 1 across the files in path order, blank lines included in the
count but not returned, as a reader that skips blank lines would see them.

Numbering needs no global sort and no single partition: every input split
(file, block start) is counted, the tiny split table is prefix-summed, and
the offsets are broadcast back (one small row per input split).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# A line is blank when every character is Java whitespace (a no-break space
# is content, as in String.isBlank).
NOT_BLANK = r"[^\p{javaWhitespace}]"
END_MARK = "end of line"


def read_lines(spark: SparkSession, path: str, keep_blank: bool = False) -> DataFrame:
    """(line BIGINT, value STRING) with physical 1-based line numbers.

    Files are ordered by path and lines by position. The split table is
    keyed by a 64-bit hash of the path plus the block start, so it stays
    small enough to broadcast even with millions of splits.
    """
    def scan():
        return spark.read.text(path).select(
            "value",
            F.col("_metadata.file_path").alias("_path"),
            F.xxhash64(F.col("_metadata.file_path")).alias("_file"),
            F.col("_metadata.file_block_start").alias("_block"),
            F.monotonically_increasing_id().alias("_rid"))

    # Prefix sums in two steps: blocks within their file, then files. Only the
    # second meets in one task, with one row per file (what any listing holds).
    blocks = scan().groupBy("_path", "_file", "_block").agg(
        F.min("_rid").alias("_min_rid"), F.count(F.lit(1)).alias("_n"))
    files = blocks.groupBy("_path").agg(F.sum("_n").alias("_lines"))
    earlier = Window.orderBy("_path").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("_path", F.coalesce(F.sum("_lines").over(earlier), F.lit(0)).alias("_before"))
    above = Window.partitionBy("_path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (blocks.withColumn("_within", F.coalesce(F.sum("_n").over(above), F.lit(0))).join(files, "_path")
               .select("_file", "_block", "_min_rid", (F.col("_before") + F.col("_within")).alias("_start")))
    # 40 bytes per input split: 100 TB in 256 MB splits is 16 MB. The text itself must not be shuffled.
    lines = scan().join(F.broadcast(offsets), ["_file", "_block"]).select(
        (F.col("_start") + F.col("_rid") - F.col("_min_rid") + 1).alias("line"), "value")
    if not keep_blank:
        lines = lines.where(is_not_blank(F.col("value")))
    return lines


def is_not_blank(value: Column) -> Column:
    return value.rlike(NOT_BLANK)


def java_trim(s: Column) -> Column:
    """String.trim(): strip every char up to U+0020 at both ends."""
    return F.regexp_replace(s, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def parse(lines: DataFrame) -> DataFrame:
    """Add ``j`` (VARIANT), ``keys`` (distinct, document order) and
    ``malformed`` (NULL when the line is one JSON object, else the reason).

    Repeated keys keep the last value at the first key's position, like a
    linked hash map. The parser itself stops after one document, so the line is
    parsed as the first of two elements of an array, the second a fixed mark:
    anything after the closing brace, a second document included, spoils that.
    """
    df = lines.withColumn("_pair", F.expr(f"try_parse_json(concat('[', value, ',\"{END_MARK}\"]'))"))
    whole = F.expr(f"try_variant_get(_pair, '$[1]', 'string') = '{END_MARK}' AND try_variant_get(_pair, '$[2]', 'variant') IS NULL")
    df = df.withColumn("j", F.when(whole, F.expr("try_variant_get(_pair, '$[0]', 'variant')")))
    # Only lines that fail are parsed again, for the reason.
    first = F.expr("schema_of_variant(try_parse_json(value))")
    trimmed = java_trim(F.col("value"))
    reason = (F.when(F.col("j").isNotNull() & (trimmed != ""), F.when(
                  ~F.expr("schema_of_variant(j)").startswith("OBJECT"), F.lit("NOT_AN_OBJECT")))
              .when(first.startswith("OBJECT"), F.lit("TRAILING_CONTENT")).otherwise(F.lit("INVALID_JSON")))
    df = df.withColumn("malformed", reason).drop("_pair")
    return df.withColumn("keys", F.when(F.col("malformed").isNull(),
                                        F.array_distinct(F.json_object_keys(F.col("value")))))


def raw_text(key: Column) -> Column:
    """The JSON text of one top-level value as written (numbers keep their
    decimal point). A second, lazy decode: only evaluated where it is used."""
    return F.from_json(F.col("value"), "map<string,string>")[key]


def java_class(v: Column, raw: Column | None = None) -> Column:
    """Java class the reference's decoder gives the value: String, Integer,
    Long, BigInteger, Double, Boolean, ArrayList, LinkedHashMap (NULL for
    JSON null). The VARIANT drops a trailing ``.0``, so when ``raw`` (the
    value's source text) is given it decides between integer and Double."""
    t = F.schema_of_variant(v)
    as_long = F.try_variant_get(v, "$", "bigint")
    is_num = (t == "BIGINT") | t.startswith("DECIMAL") | (t == "DOUBLE") | (t == "FLOAT")
    integral = (F.when(t == "BIGINT", F.when(as_long.between(-2147483648, 2147483647), F.lit("Integer"))
                       .otherwise(F.lit("Long")))
                .otherwise(F.lit("BigInteger")))
    if raw is None:
        num = F.when((t == "BIGINT") | t.rlike(r"^DECIMAL\(\d+,0\)$"), integral).otherwise(F.lit("Double"))
    else:
        num = F.when(raw.rlike("[.eE]"), F.lit("Double")).otherwise(integral)
    return (F.when(v.isNull() | (t == "VOID"), F.lit(None))
            .when(t == "STRING", F.lit("String"))
            .when(t == "BOOLEAN", F.lit("Boolean"))
            .when(is_num, num)
            .when(t.startswith("ARRAY"), F.lit("ArrayList"))
            .when(t.startswith("OBJECT"), F.lit("LinkedHashMap"))
            .otherwise(t))


def _scalar_text(v: Column, cls: Column) -> Column:
    return (F.when(cls == "String", F.variant_get(v, "$", "string"))
            .when(cls == "Double", F.variant_get(v, "$", "double").cast("string"))
            .when(cls.isin("Integer", "Long", "BigInteger", "Boolean"), F.variant_get(v, "$", "string"))
            .when(cls.isNull(), F.lit("null")))


def java_text(v: Column, cls: Column) -> Column:
    """String.valueOf of the decoded value. Arrays and objects are rendered
    as compact JSON text, an approximation of the collections' toString."""
    return (F.when(cls.isin("ArrayList", "LinkedHashMap"), F.to_json(v))
            .otherwise(_scalar_text(v, cls)))


def json_fields(parsed: DataFrame) -> DataFrame:
    """One row per (line, position, field): Java class and value text.

    Position is the 0-based place of the key in the object.
    """
    objs = parsed.where(F.col("malformed").isNull())
    # explode_outer + filter: a plain explode would infer a size() filter
    # that evaluates the map conversion a second time.
    kv = objs.select("line", "keys", F.from_json(F.col("value"), "map<string,string>").alias("raw"),
                     F.explode_outer(F.try_variant_get(F.col("j"), "$", "map<string,variant>")).alias("field", "v"))
    kv = kv.where(F.col("field").isNotNull())
    kv = kv.withColumn("json_type", java_class(F.col("v"), F.col("raw")[F.col("field")]))
    return kv.select(
        "line", (F.array_position("keys", F.col("field")) - 1).cast("int").alias("position"),
        "field", "json_type",
        F.when(F.col("json_type").isNotNull(), java_text(F.col("v"), F.col("json_type"))).alias("value"))


def malformed_lines(parsed: DataFrame) -> DataFrame:
    """S3: non-blank lines that are not one JSON object, with the reason."""
    return parsed.where(F.col("malformed").isNotNull()).select(
        "line", "value", F.col("malformed").alias("reason"))
