"""A publication spreads over all cores and exchanges no more than it must, with the tables of a plain build."""

from pyspark.sql import functions as F

from lexidx.operators import blockmax, index
from lexidx.operators.schema import fields_of


def _parquet_of_one_row_group(spark, path, n):
    rng = spark.range(n, numPartitions=1)
    words = F.concat_ws(" ", F.lit("common"), *[F.sha2(F.concat_ws("-", "id", F.lit(i)), 512) for i in range(12)])
    rng.select(F.col("id").alias("doc_id"), words.alias("text")).write.option("parquet.block.size", 1 << 30).parquet(path)
    return spark.read.parquet(path)


def test_a_file_of_one_row_group_is_dealt_to_all_cores(spark, tmp_dir):
    docs = _parquet_of_one_row_group(spark, f"{tmp_dir}/one", 20_000)
    par = spark.sparkContext.defaultParallelism
    assert docs.rdd.getNumPartitions() >= par
    filled = index.spread(docs).select(F.spark_partition_id().alias("p")).distinct().count()
    assert filled == par
    index.write_version(docs, fields_of([("text", "text")]), f"{tmp_dir}/version")
    stored = spark.read.parquet(f"{tmp_dir}/version/stored")
    assert 2 * stored.select(F.spark_partition_id().alias("p")).distinct().count() >= par


def test_published_tables_are_those_of_a_plain_build(spark, tmp_dir):
    rows = [(None, "a b a", "x"), (3, "", "y"), (3, "b " * 300 + "z" * 600, None), (3, "b c", "x"), (700, None, "x"), (5, "c b b", "y"), (-9, "a", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, tag string")
    fields = fields_of([("text", "text"), ("tag", "keyword")])
    index.write_version(docs, fields, f"{tmp_dir}/v")
    back, plain = index.read(spark, f"{tmp_dir}/v"), index.build(docs, fields)
    key = lambda df: sorted(map(repr, df.collect()))
    assert key(back.postings) == key(plain.postings)
    assert back.postings.schema.simpleString() == plain.postings.schema.simpleString()
    assert key(back.lengths) == key(plain.lengths.where("length > 0"))
    assert key(back.blocks) == key(blockmax.block_table(back.postings, back.stats()))


def test_blocks_cut_by_pieces_of_files_are_whole(spark, tmp_dir):
    docs = spark.range(0, 3000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("common word"), F.sha2(F.col("id").cast("string"), 256)).alias("text"))
    post = index.text_postings(docs, "text").repartitionByRange(5, "field", "term", "doc_id").sortWithinPartitions("field", "term", "doc_id")
    post.write.option("parquet.block.size", 4096).parquet(f"{tmp_dir}/postings")
    stats = index.field_stats(index.doc_lengths(docs, fields_of([("text", "text")])))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        back = spark.read.parquet(f"{tmp_dir}/postings")
        pieces = blockmax.piece_blocks(back, stats)
        assert pieces.count() > blockmax.block_table(back, stats).count()  # some blocks lie in two pieces
        got = blockmax.joined_pieces(pieces).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = blockmax.block_table(spark.read.parquet(f"{tmp_dir}/postings"), stats).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
