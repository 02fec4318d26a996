"""Sharding by balanced label propagation, with Spark joins only.

Documents are linked through hubs (here: equal texts). Every document starts in
the shard its hash names. In each round a hub counts the votes of its
documents' shards; documents want to move to the shard where most of their
neighbours are. A shard takes newcomers up to its quota (its even share plus a
slack, less the linked rows that stay); where more want in, a hash of the document decides
who moves, in that proportion. At last the law ``rows`` is enforced exactly:
shards with more rows than their share hand over rows that cut no link first,
until counts are at most one apart. No list of a hub's documents is ever built:
hubs are counted with partial aggregates, and positions in a shard come from
counts of hash buckets, so one text may hold a third of all rows.

Defined cases: a null text has size 1, the CRC of an empty text, and is linked
with nothing (so are empty texts); a null id is a value like any other;
repeated rows are rows of their own; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexidx.llm.common import staged

SHARDS = 8
ROUNDS = 3
SLACK = 0.05
BUCKET_ROWS = 20_000


def _bucket(c: Column | str, n: int) -> Column:
    return F.pmod(F.xxhash64(c, F.lit(7)), F.lit(n))


def _unit(*cols) -> Column:
    """A hash of the columns, spread over [0, 1)."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 30)) / F.lit(float(1 << 30))


def documents_as_nodes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, hub): the text's only trace is its size, CRC and 128-bit hub name."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.when(text != "", F.unhex(F.md5(text))).alias("hub"))


def propagate(nodes: DataFrame, shards: int, rounds: int, slack: float) -> DataFrame:
    """``nodes`` (uid, hub, ...) with ``linked`` (whether the hub has other rows) and ``shard``."""
    now = nodes.withColumn("shard", F.pmod(F.xxhash64("uid"), F.lit(shards)).cast("int"))
    for r in range(rounds):
        votes = (now.where(F.col("hub").isNotNull()).groupBy("hub", "shard").agg(F.count("*").alias("votes"))
                 .withColumn("luck", F.xxhash64("hub", "shard", F.lit(11)))  # ties go to no shard in particular
                 .groupBy("hub").agg(F.sum("votes").alias("rows"), F.max(F.struct("votes", "luck", "shard")).alias("best"))
                 .where("rows > 1").select("hub", "rows", F.col("best")["shard"].alias("wanted")))
        want = (now.drop("linked", "wanted", "rows").join(votes, "hub", "left")
                .withColumn("linked", F.col("wanted").isNotNull())
                .withColumn("wanted", F.coalesce("wanted", "shard")))
        want = staged(nodes.sparkSession, want, f"shards-round-{r}")
        # A few rows per pair of shards: who stays, who wants in. Rows without links hold no place:
        # they yield to newcomers when counts are evened out.
        flows = want.groupBy("shard", "wanted", "linked").agg(F.count("*").alias("n")).collect()
        stay = [sum(f["n"] for f in flows if f["linked"] and f["shard"] == f["wanted"] == s) for s in range(shards)]
        enter = [sum(f["n"] for f in flows if f["shard"] != f["wanted"] == s) for s in range(shards)]
        quota = (1 + slack) * sum(f["n"] for f in flows) / shards
        open_share = [min(1.0, max(0.0, quota - stay[s]) / enter[s]) if enter[s] else 1.0 for s in range(shards)]
        share = F.element_at(F.array(*[F.lit(float(x)) for x in open_share]), F.col("wanted") + 1)
        # Documents of a hub move together, unless the hub is too large a part of a shard.
        draw = F.when(F.col("rows") * 16 > quota, _unit("uid", F.lit(r))).otherwise(_unit("hub", F.lit(r)))
        moves = (F.col("shard") != F.col("wanted")) & (draw < share)
        now = want.withColumn("shard", F.when(moves, F.col("wanted")).otherwise(F.col("shard")))
    return now.drop("wanted", "rows")


def _offsets(counts: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Rows before each bucket, from a table of bucket counts (its size is set by the number of buckets)."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0))).drop("n")


def numbered(rows: DataFrame, by: str, first: str, n_buckets: int, out: str, tie: list[str]) -> DataFrame:
    """``rows`` with a gapless number from 0 within ``by``, in order of ``first``, then of a hash bucket.

    Only the rows of one bucket are sorted together; earlier buckets count as sums.
    """
    keyed = rows.withColumn("_bucket", _bucket("uid", n_buckets))
    before = _offsets(keyed.groupBy(by, first, "_bucket").agg(F.count("*").alias("n")), [by], [first, "_bucket"])
    w = Window.partitionBy(by, first, "_bucket").orderBy(*tie)
    return (keyed.withColumn("_rank", F.row_number().over(w) - 1).join(before, [by, first, "_bucket"])
            .withColumn(out, (F.col("before") + F.col("_rank")).cast("long")).drop("_rank", "before", "_bucket"))


def even_out(nodes: DataFrame, shards: int, n_buckets: int) -> DataFrame:
    """Move just enough rows that shard counts are at most one apart, rows without links first."""
    counts = {r["shard"]: r["n"] for r in nodes.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    largest_first = sorted(range(shards), key=lambda s: (-counts.get(s, 0), s))
    share = dict.fromkeys(range(shards), total // shards)
    for s in largest_first[:total % shards]:
        share[s] += 1
    excess = {s: counts.get(s, 0) - share[s] for s in range(shards)}
    givers, takers = [s for s in excess if excess[s] > 0], [s for s in excess if excess[s] < 0]
    if not givers:
        return nodes
    order = numbered(nodes.where(F.col("shard").isin(givers)).withColumn("_linked", F.col("linked").cast("int")),
                     "shard", "_linked", n_buckets, "_place", ["uid"])
    at, place = 0, None  # each giver's rows below its excess get consecutive places among all that move
    for s in givers:
        here = F.when((F.col("shard") == s) & (F.col("_place") < excess[s]), F.col("_place") + at)
        place = here if place is None else F.coalesce(place, here)
        at += excess[s]
    at, taker = 0, F.col("shard")  # places are dealt to takers in turn, as many as each lacks
    for s in takers:
        taker = F.when((F.col("_move") >= at) & (F.col("_move") < at - excess[s]), F.lit(s)).otherwise(taker)
        at -= excess[s]
    moved = order.withColumn("_move", place).withColumn("shard", taker.cast("int"))
    return moved.drop("_move", "_place", "_linked").unionByName(nodes.where(~F.col("shard").isin(givers)))


def shard_documents(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, slack: float = SLACK) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard): law ``rows``, so the last is null."""
    spark = docs.sparkSession
    # uid tells rows apart in hashes and orders; equal rows may share one, which does no harm.
    nodes = documents_as_nodes(docs).withColumn("uid", F.xxhash64("doc_id", "text_crc32", "size"))
    # A hub of its own for each empty text: no link, and no heap of null keys in the joins.
    nodes = staged(spark, nodes.withColumn("hub", F.coalesce("hub", F.unhex(F.lpad(F.hex("uid"), 16, "0")))), "shards-nodes")
    n_buckets = max(16, nodes.count() // (shards * BUCKET_ROWS))
    placed = even_out(propagate(nodes, shards, rounds, slack), shards, n_buckets)
    placed = staged(spark, placed.select("doc_id", "size", "text_crc32", "uid", "shard", F.lit(0).alias("_all")), "shards-placed")
    return numbered(placed, "shard", "_all", n_buckets, "slot", ["uid", "doc_id"]).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
