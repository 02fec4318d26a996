"""Small tables with the awkward rows every operator has to bear."""

from tests.conftest import SF_SMALL  # noqa: F401

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, extra=()):
    """Documents with ids from 0; ``extra`` are further (id, text) rows."""
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in [*enumerate(texts), *extra]]
    return spark.createDataFrame(rows, DOCS)


def clashing(df):
    """The same table with columns whose names operators use themselves."""
    from pyspark.sql import functions as F
    out = df
    for name in ("score", "spans", "ids", "shard", "cid", "token", "hub", "uid", "stats", "y", "fold", "list", "part",
                 "component", "formatted", "turns", "record_id", "headers", "rank", "n", "_bucket"):
        out = out.withColumn(name, F.lit("x"))
    return out
