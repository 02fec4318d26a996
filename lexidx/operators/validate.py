"""Validate and coerce documents against a field list.

Per field, in the order of the keys in each document: unknown field, then
explicit null, then type. The first bad key of the first bad line fails the
build. Everything is one narrow projection over the parsed lines; only the
final first-error and count reductions aggregate (one row per partition).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexidx.operators.schema import Field, FieldType, column_of, fields_of
from lexidx.sources.ndjson import java_class, java_text, java_trim, raw_text

LONG_MAX = 9223372036854775807
LONG_MIN = -9223372036854775808
TWO_64 = "18446744073709551616"

# Mismatch labels and the string grammars of Long.parseLong
# and Double.parseDouble (after trim).
LABELS = {
    FieldType.KEYWORD: "keyword (string)",
    FieldType.TEXT: "text (string)",
    FieldType.LONG: "long",
    FieldType.DOUBLE: "double",
    FieldType.BOOLEAN: "boolean",
}
ERROR_TYPE = "array<struct<pos:int,field:string,kind:string,message:string>>"
LONG_STRING = r"^[+-]?[0-9]+$"
DOUBLE_STRING = (r"^[+-]?(NaN|Infinity|(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"
                 r"|0[xX]([0-9a-fA-F]+\.?[0-9a-fA-F]*|\.[0-9a-fA-F]+)[pP][+-]?[0-9]+)[fFdD]?)$")


def _field_value(f: Field) -> Column:
    # Field names match [a-z0-9_]+, so the bracket path needs no escaping.
    return F.try_variant_get(F.col("j"), f"$['{f.name}']", "variant")


def _family(tag: Column) -> Column:
    """Coarse JSON type from the VARIANT type name."""
    return (F.when(tag.isNull() | (tag == "VOID"), F.lit(None))
            .when(tag == "STRING", F.lit("String"))
            .when(tag == "BOOLEAN", F.lit("Boolean"))
            .when((tag == "BIGINT") | tag.startswith("DECIMAL") | (tag == "DOUBLE") | (tag == "FLOAT"),
                  F.lit("Number"))
            .when(tag.startswith("ARRAY"), F.lit("ArrayList"))
            .otherwise(F.lit("LinkedHashMap")))


def _to_long(v: Column, fam: Column, tag: Column) -> Column:
    """Number.longValue() or Long.parseLong(trim(s)); NULL = mismatch."""
    d = F.variant_get(v, "$", "double")
    two64 = F.lit(TWO_64).cast("decimal(20,0)")
    low64 = F.pmod(F.try_variant_get(v, "$", "decimal(38,0)"), two64)
    s = java_trim(F.variant_get(v, "$", "string"))
    return (F.when(tag == "BIGINT", F.variant_get(v, "$", "bigint"))
            .when(fam == "Number", F.when(tag.rlike(r"^DECIMAL\(\d+,0\)$") & low64.isNotNull(),
                                          F.when(low64 > LONG_MAX, low64 - two64).otherwise(low64).cast("bigint"))
                  .when(F.isnan(d), F.lit(0).cast("bigint"))
                  .when(d >= float(LONG_MAX), F.lit(LONG_MAX))
                  .when(d <= float(LONG_MIN), F.lit(LONG_MIN))
                  .otherwise(d.cast("bigint")))
            .when((fam == "String") & s.rlike(LONG_STRING), s.try_cast("bigint")))


def _to_double(v: Column, fam: Column) -> Column:
    s = java_trim(F.variant_get(v, "$", "string"))
    return (F.when(fam == "Number", F.variant_get(v, "$", "double"))
            .when((fam == "String") & s.rlike(DOUBLE_STRING), s.try_cast("double")))


def _to_boolean(v: Column, fam: Column) -> Column:
    s = F.lower(java_trim(F.variant_get(v, "$", "string")))
    return (F.when(fam == "Boolean", F.variant_get(v, "$", "boolean"))
            .when((fam == "String") & s.isin("true", "false"), s == "true"))


def coerce(f: Field, v: Column, fam: Column, tag: Column) -> Column:
    """The typed value of field ``f``; NULL when absent, null or mismatched."""
    if f.type in (FieldType.KEYWORD, FieldType.TEXT):
        return F.when(fam == "String", F.variant_get(v, "$", "string"))
    if f.type is FieldType.LONG:
        return _to_long(v, fam, tag)
    if f.type is FieldType.DOUBLE:
        return _to_double(v, fam)
    return _to_boolean(v, fam)


# The reference's library refuses a single term over this many UTF-8 bytes.
MAX_TERM_BYTES = 32766


# Columns of a user's fields carry a prefix that no field name can contain
# until the final select: a field may be called line, status, keys or value.
TYPED, RAW, KIND, TAG, FAMILY = "#d_", "#v_", "#k_", "#t_", "#f_"


def validate(parsed: DataFrame, fields, keyword_byte_limit: int | None = None) -> DataFrame:
    """V1-V10 in one narrow pass over ``sources.ndjson.parse`` output.

    Adds one typed column per field (``#d_<f>``) and ``status`` (OK / MALFORMED /
    INVALID); ``#v_<f>`` (the raw VARIANT) and ``#k_<f>`` (error kind) stay
    for ``errors``. Intermediate values are staged as columns so every
    expression is built once; messages are only built by ``errors`` for
    the INVALID lines.
    """
    fl = fields_of(fields)
    names = F.array(*[F.lit(f.name) for f in fl])
    ok_obj = F.col("malformed").isNull()
    df = parsed
    for f in fl:
        df = df.withColumn(RAW + f.name, F.when(ok_obj, _field_value(f)))
    for f in fl:
        df = df.withColumn(TAG + f.name, F.schema_of_variant(F.col(RAW + f.name)))
    for f in fl:
        df = df.withColumn(FAMILY + f.name, _family(F.col(TAG + f.name)))
    for f in fl:
        df = df.withColumn(TYPED + f.name, coerce(f, F.col(RAW + f.name), F.col(FAMILY + f.name), F.col(TAG + f.name)))
    for f in fl:
        present = F.array_contains(F.col("keys"), F.lit(f.name))
        kind = (F.when(~present, F.lit(None))
                .when(F.col(FAMILY + f.name).isNull(), F.lit("NULL"))
                .when(F.col(TYPED + f.name).isNull(), F.lit("TYPE_MISMATCH")))
        if keyword_byte_limit is not None and f.type is FieldType.KEYWORD:
            # Optional: an un-analysed term longer than the library accepts.
            kind = kind.when(F.octet_length(F.col(TYPED + f.name)) > keyword_byte_limit, F.lit("IMMENSE_TERM"))
        df = df.withColumn(KIND + f.name, kind)
    has_bad = F.size(F.array_except(F.col("keys"), names)) > 0
    for f in fl:
        has_bad = has_bad | F.col(KIND + f.name).isNotNull()
    status = (F.when(~ok_obj, F.lit("MALFORMED"))
              .when(has_bad, F.lit("INVALID")).otherwise(F.lit("OK")))
    return df.withColumn("status", status).drop(*[x + f.name for f in fl for x in (TAG, FAMILY)])


def keep_where(df: DataFrame, cond: Column) -> DataFrame:
    """``df.where(cond)`` for conditions over the validation columns.

    A plain filter is pushed below the staged projections and inlines the
    whole coercion stack into the predicate (many copies per row). Wrapping
    the kept row in a 0/1-element array and exploding it keeps the condition
    above the projection, where it reads the computed columns once.
    """
    cols = df.columns
    return (df.select(F.explode_outer(F.when(cond, F.array(F.struct(*cols)))).alias("#r"))
              .where(F.col("#r").isNotNull()).select(*[F.col("#r")[c].alias(c) for c in cols]))


def field_message(f: Field, cls: Column) -> Column:
    """The message of field ``f``'s error; ``cls`` is the Java class of a mismatched value."""
    v, k = F.col(RAW + f.name), F.col(KIND + f.name)
    return (F.when(k == "NULL", F.format_string("Line %d: field '%s' is null", F.col("line"), F.lit(f.name)))
            .when(k == "IMMENSE_TERM", F.format_string(
                "Line %d: field '%s' holds a term of %d bytes, longer than %d", F.col("line"),
                F.lit(f.name), F.octet_length(F.variant_get(v, "$", "string")), F.lit(MAX_TERM_BYTES)))
            .when(k == "TYPE_MISMATCH", F.format_string(
                "Line %d: field '%s' expected %s but got %s value '%s'", F.col("line"),
                F.lit(f.name), F.lit(LABELS[f.type]), cls, java_text(v, cls))))


def mismatch_class(f: Field) -> Column:
    return F.when(F.col(KIND + f.name) == "TYPE_MISMATCH", java_class(F.col(RAW + f.name), raw_text(F.lit(f.name))))


def coerced(validated: DataFrame, f: Field) -> DataFrame:
    """(line, field, value, message) of every line that gives ``f`` a value that is
    not null: typed, or null with the mismatch message. One narrow pass."""
    rows = keep_where(validated, F.col("malformed").isNull() & F.array_contains("keys", f.name)
                      & ~F.col(KIND + f.name).eqNullSafe("NULL"))
    rows = rows.withColumn("#c", mismatch_class(f))
    return rows.select("line", F.lit(f.name).alias("field"), F.col(TYPED + f.name).alias("value"),
                       field_message(f, F.col("#c")).alias("message"))


def values(validated: DataFrame, fields) -> DataFrame:
    """(line, status, malformed, one struct ``doc``): the typed values by field name."""
    return validated.select("line", "status", "malformed", F.struct(
        *[F.col(TYPED + f.name).alias(f.name) for f in fields_of(fields)]).alias("doc"))


def _error_structs(df: DataFrame, fl: list[Field]) -> DataFrame:
    """Add ``errors`` to INVALID lines. Messages, the exact Java class and
    the value text are only built here, after the filter, for bad lines."""
    names = F.array(*[F.lit(f.name) for f in fl])
    for f in fl:
        df = df.withColumn("#c_" + f.name, mismatch_class(f))
    parts = []
    for f in fl:
        k = F.col(KIND + f.name)
        pos = (F.array_position(F.col("keys"), F.lit(f.name)) - 1).cast("int")
        parts.append(F.when(k.isNotNull(), F.struct(
            pos.alias("pos"), F.lit(f.name).alias("field"), k.alias("kind"),
            field_message(f, F.col("#c_" + f.name)).alias("message"))))
    unknown = F.transform(F.array_except(F.col("keys"), names), lambda k: F.struct(
        (F.array_position(F.col("keys"), k) - 1).cast("int").alias("pos"), k.alias("field"),
        F.lit("UNKNOWN_FIELD").alias("kind"),
        F.format_string("Line %d: unknown field '%s'", F.col("line"), k).alias("message")))
    known = F.filter(F.array(*parts), lambda x: x.isNotNull())
    return df.withColumn("errors", F.array_sort(F.concat(unknown, known)))


def errors(validated: DataFrame, fields) -> DataFrame:
    """Every field error: (line, position, field, kind, message)."""
    bad = _error_structs(keep_where(validated, F.col("status") == "INVALID"), fields_of(fields))
    # explode_outer + filter: see index.text_postings (no inferred size filter).
    return bad.select("line", F.explode_outer("errors").alias("e")).where(F.col("e").isNotNull()).select(
        "line", F.col("e.pos").alias("position"), F.col("e.field").alias("field"),
        F.col("e.kind").alias("kind"), F.col("e.message").alias("message"))


# Message of a line that does not decode to one JSON object. The decoder's
# own wording is not reproduced; the reason code is kept instead.
MALFORMED_MESSAGE = {
    "INVALID_JSON": "Malformed JSON document",
    "NOT_AN_OBJECT": "JSON document is not an object",
    "TRAILING_CONTENT": "Trailing content after JSON document",
}


def _malformed_message(reason: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, m in MALFORMED_MESSAGE.items():
        out = F.when(reason == k, F.lit(m)).otherwise(out)
    return out


def first_error(validated: DataFrame, fields) -> DataFrame:
    """V9: the first bad key of the first bad line; zero rows when clean.

    One pass: keep the bad lines, take each line's first error (or its
    malformed message), then a global ``min`` over (line, position,
    message); partial aggregation leaves one row per partition.
    """
    bad = _error_structs(keep_where(validated, F.col("status") != "OK"), fields_of(fields))
    first_err = F.get(F.col("errors"), 0)
    first = F.when(F.col("status") == "MALFORMED", F.struct(
        F.col("line").alias("line"), F.lit(-1).alias("position"),
        _malformed_message(F.col("malformed")).alias("message"))).otherwise(F.struct(
            F.col("line").alias("line"), first_err["pos"].alias("position"), first_err["message"].alias("message")))
    m = bad.agg(F.min(first).alias("m"))
    return m.where(F.col("m").isNotNull()).select(
        F.col("m.line").alias("line"),
        F.coalesce(F.col("m.message"), F.lit("IndexBuildException")).alias("message"))


def typed_documents(validated: DataFrame, fields) -> DataFrame:
    """Typed rows of the lines that pass, ``doc_id`` = physical line; a
    field called doc_id has the column ``schema.column_of`` names."""
    fl = fields_of(fields)
    rows = keep_where(validated.select("line", "status", *[TYPED + f.name for f in fl]), F.col("status") == "OK")
    return rows.select(F.col("line").alias("doc_id"), *[F.col(TYPED + f.name).alias(column_of(f.name)) for f in fl])


def doc_count(validated: DataFrame) -> DataFrame:
    """Documents indexed (non-blank lines) and lines that fail."""
    return validated.agg(
        F.count(F.lit(1)).alias("doc_count"),
        F.count(F.when(F.col("status") != "OK", F.lit(1))).alias("failed_lines"))
