"""Field lists: the declared, never inferred schema of an index.

A field list is an ordered list of (name, type). In catalog tables it is the
column ``fields ARRAY<STRUCT<name STRING, type STRING>>``.
"""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class FieldType(str, Enum):
    KEYWORD = "keyword"
    TEXT = "text"
    LONG = "long"
    DOUBLE = "double"
    BOOLEAN = "boolean"

    @classmethod
    def parse(cls, value: str) -> "FieldType":
        """Storage form: case-insensitive; written lower-case."""
        return cls(value.strip().lower())


# Spark type of the stored value of each field type.
STORED_TYPE = {
    FieldType.KEYWORD: T.StringType(),
    FieldType.TEXT: T.StringType(),
    FieldType.LONG: T.LongType(),
    FieldType.DOUBLE: T.DoubleType(),
    FieldType.BOOLEAN: T.BooleanType(),
}


@dataclass(frozen=True)
class Field:
    name: str
    type: FieldType

    @staticmethod
    def of(name: str, type_: str | FieldType) -> "Field":
        return Field(name, type_ if isinstance(type_, FieldType) else FieldType.parse(type_))


def fields_of(spec) -> list[Field]:
    """Accept [(name, type)], {name: type} or [Field]."""
    if isinstance(spec, dict):
        spec = list(spec.items())
    out = [s if isinstance(s, Field) else Field.of(*s) for s in spec]
    names = [f.name for f in out]
    if len(set(names)) != len(names):
        raise ValueError(f"duplicate field names in {names}")
    return out


def struct_type(fields: list[Field]) -> T.StructType:
    """Typed document schema; every field nullable because it may be omitted."""
    return T.StructType([T.StructField(f.name, STORED_TYPE[f.type], True) for f in fields])


FIELDS_TYPE = T.ArrayType(T.StructType([
    T.StructField("name", T.StringType()), T.StructField("type", T.StringType())]))

# Fixed values of the definition rules.
INDEX_NAME_PATTERN = "^[a-z0-9_-]+$"
FIELD_NAME_PATTERN = "^[a-z0-9_]+$"
MAX_NAME_LENGTH = 64
MAX_DESCRIPTION_LENGTH = 512
TYPE_NAMES = ("keyword", "text", "long", "double", "boolean")


def definition_audit(defs: DataFrame, id_col: str = "index_id") -> DataFrame:
    """One row per broken rule of a table of index definitions.

    Input columns: ``id_col``, name, description, fields. Output:
    (index_id, rule, subject) where subject is the offending name or field.
    """
    name, desc, fields = F.col("name"), F.col("description"), F.col("fields")
    idc = F.col(id_col).alias("index_id")
    blank = name.isNull() | (F.trim(name) == "")
    index_rules = [
        ("NAME_BLANK", blank),
        ("NAME_TOO_LONG", F.length(name) > MAX_NAME_LENGTH),
        ("NAME_PATTERN", ~blank & ~name.rlike(INDEX_NAME_PATTERN)),
        ("DESCRIPTION_TOO_LONG", F.coalesce(F.length(desc), F.lit(0)) > MAX_DESCRIPTION_LENGTH),
        ("NO_FIELDS", fields.isNull() | (F.size(fields) == 0)),
        ("DUPLICATE_FIELD_NAMES",
         F.size(fields) != F.size(F.array_distinct(F.transform(fields, lambda x: x["name"])))),
    ]
    per_index = defs.select(idc, name, desc, fields, F.explode(F.array(*[
        F.when(cond, F.lit(rule)) for rule, cond in index_rules])).alias("rule"))
    per_index = per_index.where(F.col("rule").isNotNull()).select(
        "index_id", "rule", F.col("name").alias("subject"))

    f = defs.select(idc, F.posexplode(fields).alias("pos", "f"))
    fname, ftype = F.col("f.name"), F.col("f.type")
    fblank = fname.isNull() | (F.trim(fname) == "")
    field_rules = [
        ("FIELD_NAME_BLANK", fblank),
        ("FIELD_NAME_TOO_LONG", F.length(fname) > MAX_NAME_LENGTH),
        ("FIELD_NAME_PATTERN", ~fblank & ~fname.rlike(FIELD_NAME_PATTERN)),
        ("FIELD_TYPE_MISSING", ftype.isNull()),
        ("FIELD_TYPE_UNKNOWN", ftype.isNotNull() & ~ftype.isin(*TYPE_NAMES)),
    ]
    per_field = f.select("index_id", fname.alias("subject"), F.explode(F.array(*[
        F.when(cond, F.lit(rule)) for rule, cond in field_rules])).alias("rule"))
    per_field = per_field.where(F.col("rule").isNotNull()).select("index_id", "rule", "subject")
    return per_index.unionByName(per_field)


def column_of(field: str) -> str:
    """The table column that holds a field: its name, but for a field that is
    called like the key column (``#`` occurs in no field name)."""
    return "doc_id#field" if field == "doc_id" else field


def fields_to_map(fields: Column) -> Column:
    """Field list → name→type map (types normalised to lower case). A
    repeated name keeps its first place and its last type, as a linked map does."""
    names = F.array_distinct(F.transform(fields, lambda x: x["name"]))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.lower(F.trim(F.element_at(
        F.filter(fields, lambda x: x["name"] == n), -1)["type"]))))


def map_to_fields(m: Column) -> Column:
    """name→type map → field list."""
    return F.transform(F.map_entries(m), lambda e: F.struct(
        e["key"].alias("name"), e["value"].alias("type")))


def fields_literal(fields: list[Field]) -> Column:
    return F.array(*[F.struct(F.lit(f.name).alias("name"), F.lit(f.type.value).alias("type"))
                     for f in fields])
