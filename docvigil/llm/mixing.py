"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Targets: sources in code-point order (null last) weigh 1, 2, 3, 1, ... and share all tokens; no
target passes ``most`` times its source's tokens, and what is above goes to the others by weight.
Places are numbered by ranges of sources, and the common level of the uncapped ones is the root of a
concave function of one number, found by Newton steps of exact whole sums.

Rates: of all document rates 0 <= r <= ``most`` that meet the source's target in tokens, entropy
balancing takes those closest to 1 in entropy, sum r log r - r + 1. By the convex dual they are
r = min(most, exp(b x)), x being the document's size over the source's mean: one multiplier b a
source, with the box inside the dual. Where a source must shrink, its long documents go first; where
it must grow, they are repeated first. Newton steps on the logarithm of the tokens, kept inside a
bracket, solve all sources at once, and raise an error if they do not converge. Documents enter only by (source, size), so the
table that each step aggregates is a pre-aggregated histogram, and a step's result has one row a
source; no rate, document or sum of documents passes through the driver.

Copies: a document gets floor(r) copies, and one more where its hash is below a cut-off of its
source, read from a histogram of hashes so that the source's tokens reach the target from below.
Then rounds follow: documents larger than what is missing are set aside, the others are dealt anew
and taken in turn as far as they fit, and one more that fits best. A document gets a second copy
beyond its rate only when none with fewer fits. Rounds end when no document of any source fits, so
what a source lacks is less than its smallest document that may still be taken. The rounds are kept
as a few numbers of each source, from which every row finds its own copies.

Edge cases: null text has size 0; empty documents take nothing; a source without tokens has target
0; null source is a source; ties and reruns give the same copies, since the order is a hash of id
and text; rows equal in both are taken alike; an empty table gives an empty result; ``carry``
columns travel in a struct, so none of their names can clash.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docvigil.llm.common import materialize, n_words, numbered
from docvigil.operators.fixpoint import forget

#: Sources up to which tables with a row a source are broadcast to the documents; beyond, Spark joins
#: by shuffles, of which adaptive execution splits a hot source.
FEW = 5_000
#: Bins of the hash histogram of a source.
BINS = 2048
#: Bins of a round's hashes for each power of two.
FINE = 64
#: Newton steps end when every source is this near its target, relatively.
TOLERANCE = 1e-10
#: Steps after which the solver gives up with an error (halving a bracket alone takes about 60).
STEPS = 200


def by_source(df: DataFrame, few: bool, pending: str = "false") -> tuple[DataFrame, bool]:
    """A table with a row a source, computed once: held by the driver if there are ``few``, else written. And
    whether its boolean column ``pending`` holds in any row."""
    if few:
        rows = df.collect()
        return df.sparkSession.createDataFrame(rows, df.schema), pending != "false" and any(r[pending] for r in rows)
    df = materialize(df, "sources")
    return df, bool(df.filter(pending).limit(1).count())


def forget_rounds(few: bool, *tables: DataFrame) -> None:
    if not few:
        forget(*tables)


def source_targets(sizes: DataFrame, most: float, weights: tuple[int, ...]) -> DataFrame:
    """``sizes(source, size, n)`` to one row a source: its tokens, documents, mean and target."""
    per = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n_docs"))
    per = numbered(per.withColumn("none", F.col("source").isNull()), "none", "source", name="place")
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    per = per.select("source", "source_size", "n_docs", weight.alias("w"), (F.col("source_size") * F.lit(most)).alias("cap"))
    per, _ = by_source(per, per.count() <= FEW)
    total, rest = per.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0))).first()
    level, held = (total / rest if rest else 0.0), None
    while True:  # the level only rises, and each step caps a further source or is the last
        capped = F.col("cap") <= F.lit(level) * F.col("w")
        now, n, rest = per.agg(F.coalesce(F.sum(F.when(capped, F.col("cap"))), F.lit(0)), F.count_if(capped), F.coalesce(F.sum(F.when(~capped, F.col("w"))), F.lit(0))).first()
        if n == held or not rest:
            break
        level, held = max(level, float((total - now) / rest)), n
    target = F.least(F.col("cap").cast("double"), F.lit(float(level)) * F.col("w"))
    return per.select("source", "source_size", "n_docs", target.alias("target"), (F.col("source_size") / F.col("n_docs")).alias("mean"))


def entropy_rates(sizes: DataFrame, targets: DataFrame, most: float, few: bool = False) -> DataFrame:
    """``targets`` with ``tilt``: b of each source's rates min(most, exp(b size / mean)); null where the
    source takes nothing, infinite where it takes all ``most`` times."""
    x, limit = F.col("size") / F.col("mean"), F.log(F.lit(float(most)))
    full = F.col("target") >= F.col("source_size") * F.lit(most * (1 - TOLERANCE))
    live = targets.filter("source_size > 0 AND target > 0").withColumn("full", full)
    spread = sizes.join(live.filter("NOT full"), sizes["source"].eqNullSafe(live["source"])).groupBy(live["source"], "mean", "target", "source_size").agg(F.sum(F.col("n") * F.col("size") * x).alias("second"))
    # a first step: as if all tokens lay in documents of their mean length by tokens
    first = F.log(F.col("target") / F.col("source_size")) * F.col("source_size") / F.col("second")
    none = F.lit(None).cast("double")
    state, pending = by_source(spread.select("source", "mean", "target", first.alias("b"), none.alias("low"), none.alias("high"), F.lit(True).alias("open")), few, "open")
    for _ in range(STEPS):
        if not pending:
            break
        power = F.col("b") * x
        tokens = F.col("n") * F.col("size") * F.exp(F.least(power, limit))
        slope = F.when(power < limit, tokens * x).otherwise(0.0)
        open_ = state.filter("open")
        sums = sizes.join(open_, sizes["source"].eqNullSafe(open_["source"])).groupBy(open_["source"], "mean", "target", "b", "low", "high").agg(F.sum(tokens).alias("m"), F.sum(slope).alias("d"), F.sum(slope * x).alias("dd"))
        off = F.log(F.col("m") / F.col("target"))
        sums = sums.withColumn("low", F.when(off < 0, F.col("b")).otherwise(F.col("low"))).withColumn("high", F.when(off >= 0, F.col("b")).otherwise(F.col("high")))
        # Newton's step on the logarithm of the tokens, corrected by its curvature where that is mild
        grade, bend = F.col("d") / F.col("m"), F.col("dd") / F.col("m") - (F.col("d") / F.col("m")) * (F.col("d") / F.col("m"))
        mild = F.greatest(F.lit(0.5), F.least(F.lit(1.5), 1 - off * bend / (2 * grade * grade)))
        newton = F.col("b") - off / grade / mild
        wider = F.when(off < 0, F.greatest(2 * F.abs("b"), F.lit(1.0))).otherwise(-F.greatest(2 * F.abs("b"), F.lit(1.0)))
        fair = F.coalesce((F.col("d") > 0) & F.coalesce(newton > F.col("low"), F.lit(True)) & F.coalesce(newton < F.col("high"), F.lit(True)), F.lit(False))
        step = F.when(fair, newton).otherwise(F.coalesce((F.col("low") + F.col("high")) / 2, wider))
        done = (F.abs(off) < TOLERANCE) | F.coalesce(F.col("high") - F.col("low") <= F.abs("high") * F.lit(1e-14), F.lit(False))
        moved = sums.withColumn("open", ~done).select("source", "mean", "target", F.when(F.col("open"), step).otherwise(F.col("b")).alias("b"), "low", "high", "open")
        before = state
        state, pending = by_source(moved.unionByName(state.filter("NOT open")), few, "open")
        forget_rounds(few, before)
    if pending:
        raise ArithmeticError(f"the rates of some source did not converge in {STEPS} steps")
    # rounded, so that the order in which Spark adds cannot show
    found = state.select(F.col("source").alias("s"), F.round("b", 11).alias("b")).unionByName(live.filter("full").select(F.col("source").alias("s"), F.lit(float("inf")).alias("b")))
    return targets.join(found, targets["source"].eqNullSafe(found["s"]), "left").drop("s").withColumnRenamed("b", "tilt")


def mix_sources(docs: DataFrame, most: int = 3, weights: tuple[int, ...] = (1, 2, 3), carry: list[str] | None = None) -> DataFrame:
    """One row for each row of ``docs(doc_id, text, source, ...)``: ``row`` (struct of the
    ``carry`` columns, all by default), ``size``, ``source_size``, ``target``, ``rate``, ``copies``
    (at most ``most``) and ``taken`` = copies x size."""
    carry = carry or docs.columns
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), F.xxhash64("doc_id", "text").alias("key"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"))
    light = "text" not in carry
    sized = materialize(rows if light else rows.drop("row"), "sizes")
    sizes = materialize(sized.groupBy("source", "size").agg(F.count("key").alias("n")), "histogram")
    targets = source_targets(sizes, most, weights)
    few = targets.count() <= FEW

    def small(of_sources: DataFrame) -> DataFrame:
        return F.broadcast(of_sources) if few else of_sources

    plan, _ = by_source(entropy_rates(sizes, targets, most, few), few)

    tilted = F.exp(F.least(F.col("tilt") * F.col("size") / F.col("mean"), F.log(F.lit(float(most)))))
    rate = F.when(F.col("tilt").isNull(), 0.0).when(F.col("tilt") == float("inf"), float(most)).otherwise(tilted)
    whole = F.floor(F.col("rate") + F.lit(1e-6)).cast("long")
    part = F.greatest(F.lit(0.0), F.col("rate") - F.col("whole"))
    #: A document's turn: its hash in (0, 1] over its broken part of a copy.
    turn = (F.pmod(F.xxhash64("key", F.lit("turn")), F.lit(1 << 40)) + 1) / F.lit(float(1 << 40)) / F.col("part")

    def planned(base: DataFrame, by: DataFrame) -> DataFrame:
        named = small(by.withColumnRenamed("source", "s"))
        out = base.join(named, base["source"].eqNullSafe(named["s"]), "left").drop("s")
        out = out.withColumn("rate", rate).withColumn("whole", whole).withColumn("part", part)
        return out.withColumn("bin", F.when(F.col("part") > 0, F.least(F.lit(BINS - 1), F.floor(turn / 2 * BINS))).cast("int"))

    # the cut-off of each source: whole bins of turns that fit into what floor(rate) leaves of the target
    seen = planned(sized, plan)
    hist = seen.groupBy("source", "bin").agg(F.sum("size").alias("tokens"), F.sum(F.col("size") * F.col("whole")).alias("base"), F.first("target").alias("target"))
    by_bin = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # at most BINS + 1 rows a source
    of_source = Window.partitionBy("source")
    hist = hist.withColumn("missing", F.col("target") - F.sum("base").over(of_source)).withColumn("upto", F.sum(F.when(F.col("bin").isNotNull(), F.col("tokens")).otherwise(0)).over(by_bin))
    fit = F.col("bin").isNotNull() & (F.col("upto") <= F.col("missing"))
    cut = hist.groupBy("source").agg(F.coalesce(F.max(F.when(fit, F.col("bin"))), F.lit(-1)).alias("cut"), (F.first("missing") - F.coalesce(F.max(F.when(fit, F.col("upto"))), F.lit(0))).alias("missing"))
    plan, _ = by_source(plan.join(cut.withColumnRenamed("source", "s"), plan["source"].eqNullSafe(F.col("s")), "left").drop("s"), few)

    # what is still missing: rounds among the documents that fit, until none does
    unit = F.xxhash64("key", "source")
    first = F.when(F.col("bin").isNotNull() & (F.col("bin") <= F.col("cut")), 1).otherwise(0).cast("long")

    def place(of: Column, turn: Column) -> Column:
        return F.floor(F.log2(F.pmod(F.xxhash64(of, turn), F.lit(1 << 40)) + 1) * FINE).cast("int")

    def gains(r: Column, of: Column, size: Column, whole: Column, held: Column) -> Column:
        """Whether round ``r`` gives a document with ``held`` copies beyond ``whole`` one more."""
        open_ = (size <= r["gap"]) & (held == r["level"]) & (whole + held < most)
        return F.when(open_ & ((place(of, r["turn"]) <= r["cut"]) | (of == r["pick"])), 1).otherwise(0).cast("long")

    round_type = "array<struct<turn:int,gap:double,level:bigint,cut:int,pick:bigint>>"
    no_rounds = F.array().cast(round_type)

    def extra(rounds: Column, start: Column) -> Column:
        """Copies beyond ``whole`` that a row has after these rounds."""
        return F.aggregate(F.coalesce(rounds, no_rounds), start, lambda x, r: x + gains(r, F.col("unit"), F.col("size"), F.col("whole"), x))

    state = plan.select(F.col("source").alias("s"), F.col("missing").alias("gap"), F.lit(0).cast("long").alias("floor"), no_rounds.alias("rounds"))
    left = planned(sized, plan).filter("size > 0 AND size <= missing").select("source", unit.alias("unit"), "size", "whole", first.alias("first")).filter(F.col("whole") + F.col("first") < most)
    left = materialize(left, "left")  # once: what a row has gained is found from the rounds
    for n in count():
        nth = F.lit(n).cast("int")
        of_s, by_place = Window.partitionBy("s"), Window.partitionBy("s").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)  # at most 40 * FINE + 1 rows a source
        seen = left.join(small(state), left["source"].eqNullSafe(state["s"])).withColumn("extra", extra(F.col("rounds"), F.col("first")))
        seen = seen.filter((F.col("size") <= F.col("gap")) & (F.col("whole") + F.col("extra") < most) & (F.col("extra") >= F.col("floor")))
        hist = seen.groupBy("s", "extra", place(F.col("unit"), nth).alias("place")).agg(F.sum("size").alias("tokens"), F.first("gap").alias("gap"))
        hist = hist.withColumn("level", F.min("extra").over(of_s)).filter("extra = level").withColumn("upto", F.sum("tokens").over(by_place))
        fit = F.col("upto") <= F.col("gap")
        cut = hist.groupBy("s").agg(F.first("level").alias("level"), F.coalesce(F.max(F.when(fit, F.col("place"))), F.lit(-1)).alias("cut"), (F.first("gap") - F.coalesce(F.max(F.when(fit, F.col("upto"))), F.lit(0))).alias("rest"))
        if not few:
            cut = materialize(cut, "fit")
        # of the others the one that fits best; rows that are equal in all go together
        done = cut.withColumnRenamed("s", "c")
        best = seen.join(small(done), seen["s"].eqNullSafe(done["c"])).filter((F.col("extra") == F.col("level")) & (place(F.col("unit"), nth) > F.col("cut")) & (F.col("size") <= F.col("rest")))
        best = best.groupBy("s", "unit").agg(F.sum("size").alias("total"), F.first("rest").alias("room")).filter("total <= room")
        best = best.groupBy(F.col("s").alias("b")).agg(F.max(F.struct("total", "unit")).alias("best"))
        step = state.join(done, state["s"].eqNullSafe(done["c"]), "left").join(best, F.col("s").eqNullSafe(best["b"]), "left")
        moved = (F.col("cut") >= 0) | F.col("best").isNotNull()
        one = F.struct(nth.alias("turn"), "gap", "level", "cut", F.col("best.unit").alias("pick"))
        old = state, cut
        state, pending = by_source(step.select(
            "s", F.coalesce(F.col("rest") - F.coalesce("best.total", F.lit(0)), "gap").alias("gap"),
            F.when(F.col("level").isNull(), F.col("floor")).when(moved, F.col("level")).otherwise(F.col("level") + 1).alias("floor"),
            F.when(moved, F.concat("rounds", F.array(one))).otherwise(F.col("rounds")).alias("rounds"), F.col("level").isNotNull().alias("open")), few, "open")
        state = state.drop("open")
        forget_rounds(few, *old[n == 0 :])  # the first state is part of the plan
        if not pending:
            break
    forget(left)
    plan, _ = by_source(plan.join(state.select("s", "rounds"), plan["source"].eqNullSafe(F.col("s")), "left").drop("s"), few)
    out = planned(sized if light else rows, plan).withColumn("unit", unit)
    copies = F.least(F.lit(most), F.col("whole") + extra(F.col("rounds"), first)).cast("long")
    return out.select("row", "size", "source_size", "target", "rate", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, most: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken."""
    taken = mix_sources(docs, most, weights).filter("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row.*")
