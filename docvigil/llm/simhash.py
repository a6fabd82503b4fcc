"""Near duplicates by SimHash fingerprints, linked through pivot distance tables.

Fingerprints: A-Z are lowered, word shingles (repeats included) are hashed with XXH64 (seed 42), and
a bit is set if it is in over half of the hashes. Whole texts are read; nothing is shuffled. Further
fingerprints of a text are those of its rehashed shingles, as if of another seed.

Links: equal fingerprints are one node. For all others, a table of Hamming distances to reference
fingerprints (pivots) is computed once. The bits lie in ``radius + agree`` groups, and the pivots of a
group differ from a common base only inside it, so the differences of a row's distances to them depend
on that group's bits alone. Two fingerprints that differ in ``radius`` bits at most agree in ``agree``
groups at least, hence in all coordinates of these. Rows that share the coordinates of so many groups
meet in a bucket; a pair is discarded if any coordinate of the whole table differs by more than the
radius (by the triangle inequality it cannot be near), and survivors are verified bit by bit. More
groups must agree where there are more fingerprints, so that buckets stay small; links are the same.

A bucket with more than ``BUCKET`` fingerprints does not form its pairs. Its rows emit all fingerprints
around them instead, within half the radius (rounded down for centres, up for members). Two fingerprints
within the radius share one of these, and all members of one are within the radius of its centre, so a
star in each gives the same components.

Edge cases: null text counts as empty; texts without a word have fingerprint 0 and link like others;
fewer words than a shingle make one shingle; rows with equal doc_id are each returned; null doc_ids
are returned with their group's id; an empty table gives an empty result. A very long text costs about
15 times its bytes in its task.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docvigil.llm.common import SPACE, Words, materialize, mix, text_slices
from docvigil.llm.components import connected_components

BITS = 64
#: Pivots that each group has beside the base.
PIVOTS = 8
#: Fingerprints in a bucket up to which its pairs are formed.
BUCKET = 48
#: Buckets of more than two up to which they are broadcast to the fingerprints.
FEW = 200_000
#: Shingles that are hashed at once.
STEP = 65_536

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def fingerprints(docs: DataFrame, shingle: int = 3, prints: int = 1) -> DataFrame:
    """(doc_id, text_hash, fp, fp1, ...) of each row of ``docs(doc_id, text)``: ``prints`` fingerprints
    as signed longs; text_hash tells rows of equal doc_id apart."""
    names = ["fp", *[f"fp{k}" for k in range(1, prints)]]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            for low, high, data, offsets in text_slices(batch.column("text")):
                words = Words(_LOWER[data], offsets, SPACE)
                # the words of the run, joined by single spaces: a shingle is a slice of it
                sizes = words.end - words.start
                at = np.concatenate([[0], np.cumsum(sizes + 1)])
                keep = ~SPACE[words.data]
                joined = np.full(int(at[-1]), 32, np.uint8)
                place = np.ones(int(at[-1]), bool)
                place[at[1:] - 1] = False
                joined[place] = words.data[keep]
                joined = joined.tobytes()
                out = np.zeros((prints, high - low), np.uint64)
                for i in range(high - low):
                    a, b = int(words.first[i]), int(words.first[i + 1])
                    if a == b:
                        continue
                    n = max(1, b - a - shingle + 1)
                    ahead = min(shingle, b - a)
                    counts = np.zeros((prints, BITS), np.int64)
                    for c in range(a, a + n, STEP):
                        d = min(c + STEP, a + n)
                        hashes = np.array([xxh64_intdigest(joined[s:e], 42) for s, e in zip(at[c:d].tolist(), (at[c + ahead : d + ahead] - 1).tolist())], "<u8")
                        for k in range(prints):
                            bits = np.unpackbits((mix(hashes, k) if k else hashes).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                            counts[k] += bits.sum(0, dtype=np.int64)
                    out[:, i] = np.packbits(counts * 2 > n, axis=1, bitorder="little").view("<u8")[:, 0]
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(low, high - low) for c in ("doc_id", "text_hash")] + [pa.array(x.view(np.int64)) for x in out], names=["doc_id", "text_hash", *names])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(sign, ", ".join(f"{c} long" for c in ("doc_id", "text_hash", *names)))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def bit_groups(n: int) -> list[tuple[int, int]]:
    """``n`` runs of neighbouring bits of nearly equal length."""
    edges = [-(-BITS * k // n) for k in range(n + 1)]
    return list(zip(edges[:-1], edges[1:]))


def pivot_groups(n: int) -> list[list[int]]:
    """For each of ``n`` groups its pivots; the base of all groups is 0."""
    draw = np.random.RandomState(7)
    return [[int("".join(map(str, draw.randint(0, 2, high - low))), 2) << low for _ in range(PIVOTS)] for low, high in bit_groups(n)]


def distances(fp: Column, n: int) -> list[list[Column]]:
    """A fingerprint's row of the pivot table, by group: the distances to its pivots."""
    return [[F.bit_count(fp.bitwiseXOR(F.lit(_signed(p)))) for p in group] for group in pivot_groups(n)]


def groups_to_agree(nodes: int, radius: int) -> int:
    """The least number of groups, from three, whose bits part so many nodes into buckets of a few."""
    agree = 3
    while agree < 6 and 2 ** (BITS * agree / (radius + agree)) < nodes / 8:
        agree += 1
    return agree


def _around(df: DataFrame, reach: int) -> DataFrame:
    """``df(part, fp, rep)`` with every fingerprint within ``reach`` bits (2 at most) of fp, as ``ball``."""
    own = df.select("part", "rep", F.col("fp").alias("ball"))
    if not reach:
        return own
    one = lambda c: F.expr(f"shiftleft(1L, {c})")
    first = df.select("part", "fp", "rep", F.explode(F.sequence(F.lit(0), F.lit(BITS - 1))).alias("i"))
    if reach == 1:
        return own.unionByName(first.select("part", "rep", F.col("fp").bitwiseXOR(one("i")).alias("ball")))
    both = first.select("part", "fp", "rep", "i", F.explode(F.sequence(F.col("i"), F.lit(BITS - 1))).alias("j"))
    flip = F.when(F.col("i") == F.col("j"), one("i")).otherwise(one("i").bitwiseOR(one("j")))
    return own.unionByName(both.select("part", "rep", F.col("fp").bitwiseXOR(flip).alias("ball")))


def near_pairs(nodes: DataFrame, radius: int = 2, agree: int | None = None) -> DataFrame:
    """Edges (u, v) between ``nodes(fp, rep)``, distinct fingerprints, that connect exactly the
    fingerprints within ``radius`` (4 at most) differing bits. With a column ``part``, fingerprints of
    different parts do not meet."""
    if radius not in (1, 2, 3, 4):
        raise ValueError("a radius of 1 to 4 bits: neighbourhoods of hot buckets grow with the power of half of it")
    agree = agree or groups_to_agree(nodes.count(), radius)
    nodes = nodes if "part" in nodes.columns else nodes.withColumn("part", F.lit(0))
    n = radius + agree
    base = F.bit_count("fp")
    table = nodes.select("part", "fp", "rep", *[F.xxhash64(*[d - base for d in g]).alias(f"g{i}") for i, g in enumerate(distances(F.col("fp"), n))])
    keys = F.array(*[F.xxhash64(F.lit(k), "part", *[f"g{i}" for i in c]) for k, c in enumerate(combinations(range(n), agree))])
    keyed = table.select("part", "fp", "rep", F.explode(keys).alias("key"))
    # most buckets hold one or two fingerprints: least and largest are the pair, so only others are read again
    held = keyed.groupBy("key").agg(F.count("fp").alias("n"), F.min("rep").alias("u"), F.max("rep").alias("v"), F.min("fp").alias("a"), F.max("fp").alias("b"))
    buckets = materialize(held.filter("n > 1"), "buckets")
    larger = buckets.filter("n > 2").select("key", "n")
    larger = F.broadcast(larger) if larger.count() <= FEW else larger
    some = keyed.join(larger.filter(F.col("n") <= BUCKET), "key").drop("n")
    one, other = some.select("key", F.col("fp").alias("a"), F.col("rep").alias("u")), some.select("key", F.col("fp").alias("b"), F.col("rep").alias("v"))
    pairs = one.join(other, "key").filter("u < v").select("u", "v", "a", "b").unionByName(buckets.filter("n = 2").select("u", "v", "a", "b"))
    apart = [F.abs(x - y) for x, y in zip(sum(distances(F.col("a"), n), []), sum(distances(F.col("b"), n), []))]
    pairs = pairs.filter(F.greatest(F.abs(F.bit_count("a") - F.bit_count("b")), *apart) <= radius)
    edges = pairs.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius).select("u", "v")

    hot = materialize(keyed.join(larger.filter(F.col("n") > BUCKET).select("key"), "key").select("part", "fp", "rep").distinct(), "hot")
    balls = materialize(_around(hot, (radius + 1) // 2), "balls")
    near = balls if radius % 2 == 0 else _around(hot, radius // 2)
    centre = near.groupBy("part", "ball").agg(F.min("rep").alias("v"))
    stars = balls.join(materialize(centre, "centres"), ["part", "ball"]).filter("rep <> v").select(F.greatest("rep", "v").alias("u"), F.least("rep", "v").alias("v"))
    return edges.unionByName(stars).distinct()


def _classes(prints: DataFrame, radius: int) -> DataFrame:
    """(fp, component_id) of each fingerprint that a row with doc_id has."""
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")).filter("rep IS NOT NULL"), "nodes")
    found = materialize(connected_components(near_pairs(nodes, radius)), "components")
    of = nodes.join(found, nodes["rep"] == found["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return materialize(of, "classes")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row of ``docs(doc_id, text)``; component_id is the
    smallest doc_id that links reach."""
    prints = materialize(fingerprints(docs, shingle), "fingerprints")
    return prints.join(_classes(prints, radius), "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, radius: int = 2, prints: int = 1) -> DataFrame:
    """The rows of ``docs`` with one document of each group: the one with the smallest doc_id, and of
    several texts of this id in the group the one whose hash is least. Texts link if any of their
    ``prints`` fingerprints do. A text of an id that goes does not take the id's other texts along; rows
    equal in id and text stay or go together; rows with null doc_id stay."""
    rows = fingerprints(docs, shingle, prints).filter("doc_id IS NOT NULL")
    rows = materialize(rows.groupBy(*rows.columns).agg(F.lit(1).alias("one")).drop("one").withColumn("uid", F.monotonically_increasing_id()), "fingerprints")
    each = F.array(*[F.struct(F.lit(k).alias("part"), F.col(f"fp{k}" if k else "fp").alias("fp")) for k in range(prints)])
    each = rows.select("uid", F.explode(each).alias("p")).select("uid", "p.part", "p.fp")
    # a row stands for all that share one of its fingerprints; they are tied to it
    nodes = materialize(each.groupBy("part", "fp").agg(F.min("uid").alias("rep")), "nodes")
    ties = each.join(nodes, ["part", "fp"]).filter(F.col("uid") != F.col("rep")).select(F.col("uid").alias("u"), F.col("rep").alias("v"))
    edges = near_pairs(nodes, radius).unionByName(ties)
    found = materialize(connected_components(edges), "components")
    member = materialize(rows.join(found, rows["uid"] == found["node"]).select("doc_id", "text_hash", "component"), "members")
    first = materialize(member.groupBy("component").agg(F.min(F.struct("doc_id", "text_hash")).alias("first")), "groups")
    gone = member.join(first, "component").filter(F.struct("doc_id", "text_hash") != F.col("first"))
    gone = materialize(gone.select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).distinct(), "dropped")
    return docs.join(gone, (docs["doc_id"] == gone["gone_id"]) & (F.xxhash64(docs["text"]) == gone["gone_hash"]), "left_anti")
