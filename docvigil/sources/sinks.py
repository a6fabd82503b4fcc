"""Reports and grids as files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docvigil.functions.text import split_field, split_table
from docvigil.functions.values import cell_type
from docvigil.operators.fixpoint import forget, written


def canonical_json(df: DataFrame) -> Column:
    """A row as JSON: keys in order, nulls kept, no spaces."""
    return F.to_json(F.struct(*[F.col(f"`{c}`").alias(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"})


def write_report(df: DataFrame, path: str) -> None:
    df.select(canonical_json(df).alias("value")).write.text(path)


def export_grid(blocks: DataFrame) -> DataFrame:
    """Blocks as sheet rows (doc_id, row, block_id, label, value, type): tables give a row a table row;
    rows run on from 4 through a document's blocks."""
    rows = F.when(F.col("type") == "table", split_table(F.col("text")))
    label, value = split_field(F.col("text"))
    b = blocks.withColumns({"rows": F.coalesce(rows, F.array().cast("array<array<string>>")), "label": label, "value": value})
    b = b.withColumn("n", F.greatest(F.size("rows"), F.lit(1)))
    before = F.sum("n").over(Window.partitionBy("doc_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1))
    b = b.withColumn("start", F.coalesce(before, F.lit(0)) + 4)
    out = b.select("doc_id", "block_id", "start", "label", "value", F.posexplode_outer(F.when(F.size("rows") > 0, F.col("rows"))).alias("k", "cells"))
    text = F.coalesce(F.array_join("cells", " | "), F.col("value"))
    return out.select("doc_id", (F.col("start") + F.coalesce("k", F.lit(0))).alias("row"), "block_id", F.when(F.col("cells").isNull(), F.col("label")).otherwise("").alias("label"), text.alias("value"), cell_type(text).alias("value_type"))


#: Characters of a digest by which the store's folders are named.
SHARD = 1


def _stored(spark: SparkSession, folder: str) -> DataFrame:
    schema = "sha string, size bigint, content binary, shard string"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    there = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path)
    return spark.read.schema(schema).parquet(folder) if there else spark.createDataFrame([], schema)


def read_objects(spark: SparkSession, folder: str, wanted: DataFrame | None = None) -> DataFrame:
    """(sha, size, content, valid) of the store's objects, one a digest, or of those in ``wanted(sha)`` only.

    ``valid``: the content has the digest and size that it is stored under. A store that does not exist yet is
    empty; a digest that two writers stored at once is one object, a valid copy of it where there is one.
    """
    stored = _stored(spark, folder)
    if wanted is not None:  # folders of other digests are not read
        stored = stored.join(wanted.select("sha", F.substring("sha", 1, SHARD).alias("shard")).distinct(), ["shard", "sha"], "left_semi")
    stored = stored.withColumn("valid", _valid())
    # one order picks all columns of a copy; who does not ask for contents has none moved
    best = F.struct("valid", "size", F.sha2("content", 256))
    return stored.groupBy("sha").agg(F.max_by("size", best).alias("size"), F.max_by("content", best).alias("content"), F.bool_or("valid").alias("valid"))


def _valid() -> Column:
    return F.coalesce((F.sha2("content", 256) == F.col("sha")) & (F.octet_length("content") == F.col("size")), F.lit(False))


def store_objects(df: DataFrame, column: str, folder: str) -> DataFrame:
    """Store the distinct contents of ``column`` by digest and return (sha, size, created): all digests of ``df``
    and whether this call stored them.

    What is stored already and whole is not written again (an anti-join with the store's objects of these
    digests), so a call that is repeated, or that follows one which was killed, adds only what is missing; a
    writer's files appear when its job commits. Null contents are nothing; a damaged object is stored anew.
    Only digests and sizes decide; contents move once, those to be stored, and are written once.
    """
    spark = df.sparkSession
    data = F.col(column).cast("binary")
    given = df.filter(data.isNotNull()).select(F.sha2(data, 256).alias("sha"), data.alias("content"))
    one = written(given.groupBy("sha").agg(F.max(F.octet_length("content").cast("bigint")).alias("size")))
    shard = F.substring("sha", 1, SHARD)
    shards = [r[0] for r in one.select(shard).distinct().collect()]  # as many as digits, to the power of SHARD
    known = _stored(spark, folder).filter(F.col("shard").isin(shards)).withColumn("valid", _valid()).select("sha", "valid").filter("valid").select("sha").distinct().withColumn("created", F.lit(False))
    marked = written(one.join(known, "sha", "left").select("sha", "size", F.coalesce("created", F.lit(True)).alias("created")))
    new = given.join(marked.filter("created").select("sha", "size"), "sha").groupBy("sha").agg(F.first("size").alias("size"), F.first("content").alias("content"))
    new.withColumn("shard", shard).write.mode("append").partitionBy("shard").parquet(folder)
    forget(one)
    return marked
