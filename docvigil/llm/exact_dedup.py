"""Exact duplicates by deterministic block naming, in DataFrame operations only.

1. *Heads.* Two texts can only be equal if their byte lengths and first bytes are. A row whose
   (length, head) no other row shares is settled: it is alone. Whole texts of all others go on.
2. *Blocks.* Each remaining text is cut into fixed-size blocks. The distinct blocks are sorted over all
   partitions, by ranges of a hash and then by their bytes; a block's place in that order is its name.
3. *Pairs.* Names of adjacent blocks are paired, the distinct pairs sorted and numbered in turn,
   until each text has one name. Names depend on the texts alone, not on partitions. Texts are equal if and only if (length, name) are: no hashing of
   contents decides anything, so nothing can collide.

Names are fixed by writing each name table before it is used. Distinct blocks and pairs are
pre-aggregated before the shuffle; joins of hot blocks and hot groups have a written table on one
side, so that adaptive execution can split them.

Edge cases: null text counts as empty (length 0, one empty block); of rows equal in text and doc_id
one stays; null doc_ids rank lowest; an empty table gives an empty result; ``carry`` columns travel
in a struct, so none of their names can clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docvigil.llm.common import materialize, numbered
from docvigil.operators.fixpoint import forget


def exact_groups(docs: DataFrame, carry: list[str] | None = None, block_bytes: int = 8192, head_bytes: int = 64) -> DataFrame:
    """One row for each row of ``docs(doc_id, text, ...)``: ``row`` (struct of the ``carry``
    columns, all by default), ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``."""
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in carry or docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"),
        F.octet_length(data).alias("n_bytes"), F.substring(data, 1, head_bytes).alias("head"), data.alias("data"),
    )
    shared = materialize(rows.groupBy("n_bytes", "head").count().filter("count > 1").select("n_bytes", "head"), "heads")
    # digests are taken before the join: texts that are alone do not travel (unless they are carried)
    alone = rows.withColumn("text_sha256", F.sha2("data", 256)).drop("data").join(shared.hint("merge"), ["n_bytes", "head"], "left_anti").select(
        "row", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")

    held = rows.join(shared.hint("merge"), ["n_bytes", "head"], "left_semi").drop("head")
    held = materialize(held.withColumn("uid", F.monotonically_increasing_id()), "held")
    named = _name(held, block_bytes)
    rank = F.struct(F.coalesce("id", F.lit(-(1 << 63)).cast("long")), F.col("uid"))
    member = held.select("uid", "id", "n_bytes").join(named, "uid").select("uid", "id", "n_bytes", "name")
    member = materialize(member, "members")
    groups = member.groupBy("n_bytes", "name").agg(F.max("id").alias("keep_id"), F.max_by("uid", rank).alias("keep_uid"), F.count("uid").alias("group_size"))
    groups = materialize(groups, "groups")
    found = materialize(member.join(groups, ["n_bytes", "name"]).select("uid", "keep_id", "group_size", (F.col("uid") == F.col("keep_uid")).alias("kept")), "decisions")
    copies = held.join(found, "uid").select("row", "keep_id", "group_size", "kept", F.sha2("data", 256).alias("text_sha256"))
    return alone.unionByName(copies)


def _name(held: DataFrame, block_bytes: int) -> DataFrame:
    """(uid, name) of each text in ``held(uid, n_bytes, data)``."""
    last = F.floor(F.greatest(F.col("n_bytes") - 1, F.lit(0)) / block_bytes).cast("int")
    blocks = held.select("uid", (last + 1).alias("n"), F.explode(F.sequence(F.lit(0), last)).alias("pos"), "data").select(
        "uid", "n", "pos", F.expr(f"substring(data, pos * {block_bytes} + 1, {block_bytes})").alias("block"))
    # in the order of a hash, then of the bytes: ranges are even, and their bounds short
    names = numbered(blocks.select("block").distinct().withColumn("hash", F.xxhash64("block")), "hash", "block", deal=("hash",))
    level = materialize(blocks.join(names.drop("hash"), "block").select("uid", "n", "pos", "name"), "level")
    forget(names)
    done = level.filter("n = 1").select("uid", "name")
    level = level.filter("n > 1")
    most = level.agg(F.max("n")).first()[0] or 1
    while most > 1:
        pairs = level.groupBy("uid", "n", (F.col("pos") / 2).cast("int").alias("pos")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"))
        pairs = materialize(pairs.withColumn("n", ((F.col("n") + 1) / 2).cast("int")), "pairs")
        names = numbered(pairs.select("a", "b").distinct(), "a", "b")
        level = materialize(pairs.join(names, ["a", "b"]).select("uid", "n", "pos", "name"), "level")
        forget(names, pairs)
        done = done.unionByName(level.filter("n = 1").select("uid", "name"))
        level = level.filter("n > 1")
        most = (most + 1) // 2
    return done


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without exact copies: of equal texts, the largest doc_id stays."""
    return exact_groups(docs).filter("kept").select("row.*")
