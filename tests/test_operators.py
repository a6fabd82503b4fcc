"""Operators on small tables: worked examples, edge cases, tampering, order of input."""

from __future__ import annotations

from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from docvigil.functions import text as X
from docvigil.functions import values as V
from docvigil.operators import audit as A
from docvigil.operators import blocks as B
from docvigil.operators import cells as C
from docvigil.operators import rollups as R
from docvigil.operators import templates as T
from docvigil.plans.block_queries import j12, w2
from docvigil.streaming import logs as L

SF = "/root/testdata/sf0.001"


def one(spark, column, schema="x string", *values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], schema).select(column).collect()]


def test_white_space_and_folding(spark):
    texts = [" a 　b\u001cc ", "Straße  X", "", None]
    assert one(spark, X.norm(F.col("x")), "x string", *texts) == ["a b c", "Straße X", "", None]
    assert one(spark, X.fold(F.col("x")), "x string", *texts)[1] == "strasse x"
    assert one(spark, X.norm_contains(F.col("x"), F.lit("  ")), "x string", *texts) == [False] * 4
    assert one(spark, X.same_text(F.col("x"), F.col("x")), "x string", *texts) == [True, True, False, False]


def test_numbers_fail_closed(spark):
    assert one(spark, V.parse_number(F.col("x")), "x string", "1,234.5", "12,34", "1e5", "", None, "-7") == [1234.5, None, None, None, None, -7.0]
    assert one(spark, V.needs_review(F.col("x")), "x double", 0.8, 0.79, 1.01, float("nan"), float("inf"), None) == [False, True, True, True, True, True]
    assert one(spark, V.parse_date(F.col("x")).cast("string"), "x string", "2024-02-29", "2023-02-29", "2024-2-9") == ["2024-02-29", None, None]
    assert one(spark, V.cell_type(F.col("x")), "x string", "12", "012", "1234567890123456", " ", None) == ["number", "text", "text", "blank", "blank"]


def test_worked_case(spark):
    """One table of two cells, one of them changed and confirmed without review."""
    schema = "case_id string, table_id string, cell_id string, text string, source_page int, source_x double, requires_review boolean, auto_confirmed boolean"
    expected = spark.createDataFrame([("c", "t", "1", "Lot 7", 1, 5.0, False, False), ("c", "t", "2", "9 mg", 1, 9.0, True, False)], schema)
    actual = spark.createDataFrame([("c", "t", "1", " Lot  7", 1, 5.0, False, False), ("c", "t", "2", "8 mg", 2, 9.0, True, True)], schema)
    m = C.eval_metrics(C.match_cells(expected, actual)).first()
    assert (m.table_rate, m.cell_rate, m.source_rate, m.false_auto) == (1.0, 0.5, 0.5, 1)
    none = C.eval_metrics(C.match_cells(expected.limit(0), actual)).first()
    assert (none.expected_tables, none.table_rate, none.cell_rate) == (0, 0.0, 0.0)


def test_order_of_input_does_not_matter(spark):
    from docvigil.plans.views import view

    cells = view(spark, SF, "cells")
    actual = view(spark, SF, "actual")
    once = C.eval_metrics(C.match_cells(cells, actual), ("l_returnflag",)).toPandas().sort_values("l_returnflag").values.tolist()
    again = C.eval_metrics(C.match_cells(cells.repartition(7), actual.orderBy(F.rand(1))), ("l_returnflag",)).toPandas().sort_values("l_returnflag").values.tolist()
    assert once == again


def test_status_fold_of_nothing_is_unknown(spark):
    s = spark.createDataFrame([("a", "pass"), ("a", None), ("b", "fail"), ("b", "unknown"), ("c", "pass")], "k string, status string")
    assert dict(R.fold_status(s, ["k"]).collect()) == {"a": "unknown", "b": "fail", "c": "pass"}
    assert R.harness_summary(s.limit(0).withColumn("category", F.lit("x"))).first().decision == "fail"


def test_chain_finds_every_tampering(spark):
    fields = ["job", "seq", "action"]
    base = spark.createDataFrame([("j", i, f"a{i}") for i in range(1, 6)], "job string, seq long, action string").toPandas()
    previous, rows = "", []
    for r in base.itertuples():
        row = spark.createDataFrame([(r.job, r.seq, r.action, previous)], "job string, seq long, action string, previous_hash string")
        previous_now = row.select(A.event_digest(F.col("previous_hash"), *fields)).first()[0]
        rows.append((r.job, r.seq, r.action, previous, previous_now))
        previous = previous_now
    schema = "job string, seq long, action string, previous_hash string, event_hash string"
    whole = spark.createDataFrame(rows, schema)
    assert A.verify_chain(whole, ["job"], fields).count() == 0
    gone = A.verify_chain(whole.filter("seq <> 3"), ["job"], fields).collect()
    assert [(r.seq, r.violations) for r in gone] == [(4, "sequence gap")]
    forged = whole.withColumn("action", F.when(F.col("seq") == 2, "x").otherwise(F.col("action")))
    assert [(r.seq, r.violations) for r in A.verify_chain(forged, ["job"], fields).collect()] == [(2, "content changed")]


def test_events_reject_unknown_filters(spark):
    e = spark.createDataFrame([(1, "a")], "job_id int, action string")
    with pytest.raises(ValueError):
        A.scan_events(e, colour="red")
    with pytest.raises(ValueError):
        A.scan_events(e, action=" ")
    assert A.scan_events(e, action="a").count() == 1


def test_visual_lines(spark):
    rows = [(1, 1, 1, 0.0, 0.0, 50.0, 10.0), (1, 1, 2, 55.0, 1.0, 50.0, 10.0), (1, 1, 3, 0.0, 14.0, 50.0, 10.0), (1, 1, 4, 200.0, 0.0, 10.0, 10.0)]
    f = spark.createDataFrame(rows, "doc_id long, page int, fragment_id long, x double, y double, w double, h double")
    found = {r.fragment_id: r.line for r in B.visual_lines(f).collect()}
    assert found[1] == found[2] and found[3] != found[1] and found[4] not in (found[1], found[3])
    assert w2(spark, SF).count() > 0


def test_metadata_is_used_once(spark):
    d = j12(spark, SF).toPandas()
    assert d.fragment_id.is_unique and d.source_id.is_unique and len(d)


def test_job_states_by_hand(spark):
    wanted = []
    events = spark.read.parquet(f"{SF}/events.parquet")
    rows = L.lifecycle(events).toPandas().sort_values(["ts", "event_id"])
    for job, g in rows.groupby("job_id"):
        status, attempts = "new", 0
        for r in g.itertuples():
            legal = True
            if (status, r.action) == ("new", "submit"):
                status = "queued"
            elif (status, r.action) == ("queued", "start"):
                status, attempts = "running", attempts + 1
            elif (status, r.action) == ("running", "succeed"):
                status = "succeeded"
            elif (status, r.action) == ("running", "fail"):
                status = "queued" if attempts < 3 else "failed"
            elif (status, r.action) == ("failed", "retry"):
                status, attempts = "queued", 0
            else:
                legal = False
            wanted.append((job, r.event_id, r.action, status, attempts, legal))
    stream = L.stream_jobs(L.lifecycle(L.stream_table(spark, SF, "events", L.EVENTS)))
    found = L.drain(stream, "test-jobs").toPandas()
    assert sorted(map(tuple, found.values.tolist())) == sorted(wanted)


def test_cross_field_reaches_a_fixed_point(spark):
    v = spark.createDataFrame([(1, "a", "1"), (1, "b", "2"), (1, "c", "1.5"), (2, "a", "1"), (2, "b", "2"), (2, "c", "9"), (3, "a", "0")], "doc_id long, field_id string, value string").withColumn("value_type", F.lit("number"))
    p = spark.createDataFrame([("a", "b", "less_than_or_equal"), ("b", "c", "less_than_or_equal")], "field_id string, related string, operator string")
    assert sorted(T.cross_field(v, p).select("doc_id", "field_id").collect()) == [(1, "c"), (2, "a"), (2, "b"), (2, "c")]


def test_cross_field_follows_long_chains_and_cycles(spark):
    names = [f"f{i:02d}" for i in range(50)]
    rows = [(d, n, str(-i if not (d == 2 and n == "f30") else 7), "number") for d in (1, 2) for i, n in enumerate(names)]
    chain = [(a, b, "greater_than") for a, b in zip(names, names[1:])]
    v = spark.createDataFrame(rows, "doc_id long, field_id string, value string, value_type string")
    live = T.cross_field(v, spark.createDataFrame(chain, "field_id string, related string, operator string")).groupBy("doc_id").count().collect()
    assert sorted(map(tuple, live)) == [(1, 50), (2, 20)]  # f29 <= f30, so f00 to f29 fall; f30 is larger than f31 still
    ring = [("f00", "f01", "equals"), ("f01", "f00", "equals"), ("f02", "f00", "not_equals")]
    v = spark.createDataFrame([(1, "f00", "x", "string"), (1, "f01", " x ", "string"), (1, "f02", "y", "string"), (2, "f00", "x", "string"), (2, "f01", "z", "string"), (2, "f02", "y", "string")], v.schema)
    assert sorted(tuple(r[:2]) for r in T.cross_field(v, spark.createDataFrame(ring, "field_id string, related string, operator string")).collect()) == [(1, "f00"), (1, "f01"), (1, "f02")]


@pytest.mark.parametrize(
    "operator, kind, a, b, holds",
    [
        ("before", "date", "2024-01-01", "2024-01-02", True), ("before", "date", "2024-01-02", "2024-01-02", False), ("before_or_equal", "date", "2024-01-02", "2024-01-02", True), ("after", "", "2024-01-03", "2024-01-02", True),
        ("after_or_equal", "date", "2024-02-30", "2024-01-02", False), ("less_than", "number", "9", "10", True), ("less_than_or_equal", "number", "1,000", "1000", True), ("greater_than", "number", "10", "9", True), ("greater_than_or_equal", "number", "x", "9", False),
        ("equals", "number", "1.0", "1", True), ("equals", "number", "1", "x", False), ("not_equals", "number", "1", "x", False), ("not_equals", "number", "1", "2", True), ("equals", "boolean", "Yes", "1", True), ("not_equals", "boolean", "yes", "no", True),
        ("equals", "date", " a", "a ", True), ("equals", "string", "1.0", "1", False), ("not_equals", "string", "1.0", "1", True), ("like", "string", "a", "a", False), (None, "string", "a", "a", False), ("equals", "string", "a", None, False),
    ],
)
def test_typed_comparisons(spark, operator, kind, a, b, holds):
    row = spark.createDataFrame([(operator, a, b, kind)], "o string, a string, b string, k string")
    assert row.select(V.fields_agree(*[F.col(c) for c in "oabk"])).first()[0] is holds


def plain_output(fields):
    out: dict = {}
    for _, key, value in sorted(fields, key=lambda f: f[0]):
        path = [p for p in key.split(".") if p]
        at = out
        for part in path[:-1]:
            if not isinstance(at.get(part), dict):
                at[part] = {}
            at = at[part]
        if path:
            at[path[-1]] = value
    return out


def test_output_is_nested_as_values_are_set(spark):
    import json
    import random

    rng = random.Random(4)
    docs = {1: [(1, "a.b", "1"), (2, "a.c", "2")], 2: [(1, "a.b.c.d", "1"), (2, "a.b", "x"), (3, "a.b.e", "y")], 3: [(1, "k", "1"), (2, "k", "2")], 4: [(1, "..", "1")], 5: [(1, 'q"."\\n', 'v"\n')], 6: []}
    for d in range(10, 60):
        docs[d] = [(i, ".".join(rng.choices(["a", "b", "", "c d", "é"], k=rng.randint(1, 4))), f"{d}-{i}") for i in range(rng.randint(1, 12))]
    rows = [(d, f"f{p}", p, k, v, None) for d, fields in docs.items() for p, k, v in fields] + [(6, "w", 1, "z", None, "missing"), (3, "w", 9, "k", "no", "low")]
    got = T.map_fields(spark.createDataFrame(rows, "doc_id long, field_id string, position int, output_key string, value string, warning string")).collect()
    assert {r.doc_id: json.loads(r.output) for r in got} == {d: plain_output(f) for d, f in docs.items()}
    assert {r.doc_id: (r.confirmed, r.review) for r in got}[3] == (2, "w: low")


PAIRS = "participant int, case_id string, a_seconds long, b_seconds long, eligible boolean, reduction_percent double"


def reductions(spark, *pairs):
    rows = [(i, "c", a, b, True, 100 * (a - b) / a) for i, (a, b) in enumerate(pairs)] + [(99, "c", 10, 1, False, 90.0)]
    return tuple(R.paired_median(spark.createDataFrame(rows, PAIRS)).first())


def test_paired_median_is_the_median_of_reductions(spark):
    assert reductions(spark, (100, 50), (10, 10), (1000, 900)) == (3, 10.0, False)
    assert reductions(spark, (100, 50), (100, 70), (1000, 900)) == (3, 30.0, True)
    assert reductions(spark, (100, 50), (10, 10)) == (2, 25.0, False)
    assert reductions(spark, (7, 4), (100, 83), (100, 10), (100, 99))[2] is False  # 42.857... and 17: 29.93
    assert reductions(spark, (7, 4), (700, 581 - 1), (100, 10), (100, 99))[2] is True  # 42.857... and 17.142...: exactly 30
    assert reductions(spark)[1:] == (None, False)


def test_pairs_count_included_and_approved_runs(spark):
    rows = [
        (1, "c", "m", 1, 1, False, "approved", True, 100), (1, "c", "m", 2, 2, True, "approved", True, 80), (1, "c", "s", 3, 1, True, "approved", True, 40),  # the second attempt counts
        (2, "c", "m", 4, 1, True, "approved", True, 90), (2, "c", "s", 5, 1, True, "blocked", True, 30), (3, "c", "m", 6, 1, True, "approved", False, 90), (3, "c", "s", 7, 1, True, "approved", True, 30),
        (4, "c", "m", 8, 1, True, "approved", True, 90), (5, "c", "m", 9, 1, True, "approved", True, 90), (5, "c", "s", 10, 1, True, "approved", True, 30), (6, "c", "m", 11, 1, True, "approved", True, 9), (6, "c", "m", 12, 2, True, "approved", True, 9), (6, "c", "s", 13, 1, True, "approved", True, 3),
    ]
    runs = spark.createDataFrame(rows, "participant int, case_id string, arm string, run_id int, attempt int, included boolean, outcome string, checklist boolean, seconds long")
    done = spark.createDataFrame([(1,), (2,), (3,), (4,), (6,)], "participant int")
    got = {r.participant: r for r in R.pair_arms(runs, ("m", "s"), done).collect()}
    assert (got[1].a_seconds, got[1].reduction_percent, got[1].eligible) == (80, 50.0, True)
    assert [(p, r.calculable, r.eligible) for p, r in sorted(got.items())] == [(1, True, True), (2, False, False), (3, False, False), (4, False, False), (5, True, False), (6, False, False)]
    assert (got[4].b_outcome, got[4].b_included, got[2].b_outcome) == (None, None, "blocked")


def test_ratio_is_compared_as_rounded(spark):
    df = spark.createDataFrame([(1, 55, 100, "pass"), (2, 54, 100, "fail")], "g int, matched long, total long, status string")
    assert sorted(tuple(r) for r in R.ratio_rollup(df, ["g"], 0.55).select("g", "status").collect()) == [(1, "pass"), (2, "fail")]


def test_participants_out_of_order_at_a_tie(spark):
    def t(day):
        return None if day is None else datetime(2024, 1, day)

    people = [(1, 1, 2, 3, None), (2, 1, 1, 3, None), (3, 1, 2, 2, None), (4, 1, 2, 5, None), (5, 1, 2, 3, 6), (6, 1, 2, 3, 5), (7, 5, 6, 7, None), (8, 1, None, 3, None), (9, None, None, None, None)]
    p = spark.createDataFrame([(i, *map(t, d)) for i, *d in people], "participant int, approved timestamp, consented timestamp, practised timestamp, withdrawn timestamp")
    r = spark.createDataFrame([(i, t(5), t(6)) for i in range(1, 9)], "participant int, started timestamp, ended timestamp")
    got = dict(map(tuple, R.check_participants(p, r).collect()))
    assert got == {
        2: "consent before approval", 3: "practice before consent", 4: "practice after a run", 6: "a run after leaving",
        7: "approval after a run; consent after a run; practice after a run", 8: "consent after a run; practice before consent",
    }


def test_orders_and_revisions_of_pairs(spark):
    def t(day):
        return datetime(2024, 1, day)

    runs = [(1, "c", "m", t(1), t(2), True, "a"), (1, "c", "s", t(2), t(3), True, "a"), (2, "c", "m", t(1), t(3), True, "a"), (2, "c", "s", t(2), t(4), True, "b"), (3, "c", "s", t(1), t(2), True, "a"), (4, "c", "m", t(1), t(2), True, None)]
    runs += [(5, "c", "m", t(1), t(2), True, None), (5, "c", "s", t(3), t(4), True, "a"), (5, "c", "s", t(5), t(6), False, "b")]
    r = spark.createDataFrame(runs, "participant int, case_id string, arm string, started timestamp, ended timestamp, included boolean, task string")
    orders = spark.createDataFrame([(i, "m", "s") for i in (1, 2, 3, 5)], "participant int, first string, second string")
    assert sorted(map(tuple, R.arm_order(r, orders).collect())) == [(2, "order"), (3, "order"), (4, "no order")]
    assert sorted(map(tuple, R.revision_differences(r, ("m", "s"), ["task"]).collect())) == [(2, "c", "task"), (5, "c", "task")]


def test_the_store_keeps_one_whole_object_a_digest(spark, tmp_path):
    import glob
    import hashlib
    import os

    from docvigil.sources.sinks import read_objects, store_objects

    folder = str(tmp_path / "store")
    df = lambda *texts: spark.createDataFrame([(t,) for t in texts], "text string")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    found = lambda out: sorted((r.sha, r.size, r.created) for r in out.collect())
    assert read_objects(spark, folder).count() == 0
    assert found(store_objects(df("a", "b", "a", None, "é"), "text", folder)) == sorted([(sha("a"), 1, True), (sha("b"), 1, True), (sha("é"), 2, True)])
    assert found(store_objects(df("b", "c"), "text", folder)) == sorted([(sha("b"), 1, False), (sha("c"), 1, True)])
    # a run that was killed before its job committed left files that no reader sees
    killed = f"{folder}/_temporary/0/_temporary/attempt_1/shard={sha('d')[:1]}"
    os.makedirs(killed)
    open(f"{killed}/part-0.parquet", "wb").write(b"half")
    assert found(store_objects(df("a", "d"), "text", folder)) == sorted([(sha("a"), 1, False), (sha("d"), 1, True)])
    # damage: another content under a's digest
    part = glob.glob(f"{folder}/shard={sha('a')[:1]}/part-*")[0]
    os.remove(part)
    spark.createDataFrame([(sha("a"), 1, b"x", sha("a")[:1])], "sha string, size bigint, content binary, shard string").write.mode("append").partitionBy("shard").parquet(folder)
    assert {r.sha: r.valid for r in read_objects(spark, folder).collect()} == {sha(t): t != "a" for t in "abcdé"}
    assert found(store_objects(df("a"), "text", folder)) == [(sha("a"), 1, True)]
    rows = read_objects(spark, folder).collect()
    assert all(r.valid for r in rows) and sorted(bytes(r.content).decode() for r in rows) == ["a", "b", "c", "d", "é"]


def test_merges_of_a_crowded_block(spark):
    import random

    from docvigil.operators import checks as H

    rng = random.Random(5)
    merges, cells = [], []
    for b in range(30):
        for m in range(rng.randint(0, 7)):
            r, c = rng.randint(0, 8), rng.randint(0, 8)
            merges.append((b, f"{b}-{m}", r, c, r + rng.randint(-1, 3), c + rng.randint(-1, 3)))
        cells += [(b, rng.randint(0, 11), rng.randint(0, 11), rng.choice(["v", " ", None])) for _ in range(12)]
    blocks = [(b, 10, 10) for b in range(30) if b % 7]
    wanted = {}
    for b, m, r1, c1, r2, c2 in merges:
        real = r1 <= r2 and c1 <= c2
        hit = real and any(o[0] == b and o[1] != m and o[2] <= o[4] and o[3] <= o[5] and o[2] <= r2 and r1 <= o[4] and o[3] <= c2 and c1 <= o[5] for o in merges)
        lost = real and any(x == b and r1 <= r <= r2 and c1 <= c <= c2 and (r, c) != (r1, c1) and (t or "").strip() for x, r, c, t in cells)
        known = b % 7 != 0
        bad = [n for n, v in (("unknown block", not known), ("outside table", known and (not real or r2 >= 10 or c2 >= 10)), ("overlap", hit), ("value lost", lost)) if v]
        if bad:
            wanted[m] = "; ".join(bad)
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    out = H.check_merges(frame(merges, "block_id int, merge_id string, r1 int, c1 int, r2 int, c2 int"), frame(cells, "block_id int, row int, col int, text string"), frame(blocks, "block_id int, n_rows int, n_cols int"))
    assert dict(map(tuple, out.collect())) == wanted
    # one block with 100,000 ranges of which two overlap
    many = spark.range(100_000).selectExpr("1 AS block_id", "CAST(id AS STRING) AS merge_id", "CAST(id DIV 100 AS INT) AS r1", "CAST(id % 100 AS INT) * 3 AS c1", "CAST(id DIV 100 AS INT) AS r2", "CAST(id % 100 AS INT) * 3 + IF(id = 777, 3, 1) AS c2")
    out = H.check_merges(many, frame([], "block_id int, row int, col int, text string"), frame([(1, 1000, 300)], "block_id int, n_rows int, n_cols int"))
    assert sorted(map(tuple, out.collect())) == [("777", "overlap"), ("778", "overlap")]


def test_annotations_need_one_block_and_text(spark):
    from docvigil.operators import checks as H

    notes = spark.createDataFrame([(1, "b", "x"), (2, "c", "x"), (3, "b", " "), (4, "d", None), (5, None, "x")], "annotation_id int, block_id string, text string")
    blocks = spark.createDataFrame([("b",), ("c",), ("c",)], "block_id string")
    assert dict(map(tuple, H.check_annotations(notes, blocks).collect())) == {2: "repeated block", 3: "no text", 4: "unknown block; no text", 5: "unknown block"}


def test_versions_in_force_and_as_asked(spark):
    import random

    rng = random.Random(6)
    versions = [(t, (rng.randint(0, 3), i), rng.random() < 0.8, (a := rng.randint(0, 30)), None if rng.random() < 0.3 else a + rng.randint(-2, 12)) for t in "ab" for i in range(25)]
    docs = [(i, rng.choice("abc"), rng.choice([None, *range(-2, 45)]), rng.choice([None, None, v[1]])) for i, v in enumerate(rng.choices(versions, k=150))]
    schema = "struct<major:int,minor:int>"
    t = spark.createDataFrame(versions, f"template_id string, version {schema}, active boolean, valid_from int, valid_until int")
    d = spark.createDataFrame(docs, f"doc int, template_id string, as_of int, asked {schema}")

    def plain(t_id, day, asked):
        mine = [v for v in versions if v[0] == t_id]
        if asked is not None:
            return asked if any(v[1] == asked for v in mine) else None
        return max((v[1] for v in mine if v[2] and day is not None and v[3] <= day and (v[4] is None or day < v[4])), default=None)

    got = {r.doc: r.version and tuple(r.version) for r in T.effective_version(d, t).collect()}
    assert got == {i: plain(t_id, day, asked) for i, t_id, day, asked in docs}
    got = {r.doc: r.version and tuple(r.version) for r in T.effective_version(d.drop("asked"), t).collect()}
    assert got == {i: plain(t_id, day, None) for i, t_id, day, _ in docs}
    assert T.effective_version(d, t.limit(0)).filter("version IS NOT NULL").count() == 0


def test_headers_in_pairs_and_numbers_beyond_range(spark):
    from docvigil.operators import parameters as P

    rows = [(1, '{"request_headers":[["Authorization","abc"]]}'), (2, '{"x":1e400}'), (3, '{"x":1e300}')]
    got = {r.id: r.parameters for r in P.redact_params(spark.createDataFrame(rows, "id int, p string"), "id", "p").collect()}
    assert got[1] == '{"request_headers":[["Authorization","[REDACTED]"]]}' and "Infinity" not in got[2] and got[3] == '{"x":1e+300}'


def test_neighbours_equal_plain_loops(spark):
    import random

    rng = random.Random(7)
    rows = [(d, p, f"{d}-{p}-{i}", float(rng.randint(0, 90)), float(rng.choice([rng.randint(0, 60), 13.5])), float(rng.randint(0, 30)), float(rng.choice([0, 3, 9, 10, 40, 300])), rng.choice(["paragraph", "field", "table"])) for d in range(4) for p in (1, 2) for i in range(40)]
    blocks = spark.createDataFrame(rows, "doc_id int, page int, block_id string, x double, y double, w double, h double, type string")
    chosen = [(*r, r[2], rng.choice(["label", "text"])) for r in rows if rng.random() < 0.4]
    anchors = spark.createDataFrame(chosen, "doc_id int, page int, block_id string, x double, y double, w double, h double, type string, anchor_id string, kind string")
    right, under = {}, set()
    for d, p, own, x, y, w, h, _, a, kind in chosen:
        page = [r for r in rows if r[:2] == (d, p) and r[2] != own]
        beside = [(r[3], r[4], r[2]) for r in page if r[3] >= x + w and r[4] < y + h and y < r[4] + r[6] and abs(r[4] - y) <= max(4, min(h, r[6]) / 2)]
        if beside:
            right[(d, a)] = min(beside)[2]
        lower = sorted((r[4], r[3], r[2], r[7]) for r in page if r[4] > y and (kind != "label" or (r[3] < x + w and x < r[3] + r[5])))
        for place, r in enumerate(lower, 1):
            if r[3] == "table" or (kind == "label" and place > 1):
                break
            under.add((d, a, r[2], place))
    assert {(r.doc_id, r.anchor_id): r.block_id for r in B.right_of(blocks, anchors).collect()} == right
    assert {tuple(r) for r in B.below(blocks, anchors).collect()} == under


def plain_hits(texts, anchors):
    norm = lambda x: " ".join(x.split()).lower().replace("ß", "ss")
    out = set()
    for d, t in texts.items():
        for template, anchor, mode, text in anchors:
            if {"exact": t == text, "contains": norm(text) in norm(t) and norm(text) != ""}.get(mode, norm(t) == norm(text)):
                out.add((d, template, anchor))
    return out


@pytest.mark.parametrize("few, library, segment", [(64, 20_000, 32_768), (0, 20_000, 7), (0, 9, 40)])
def test_anchors_are_found_by_any_plan(spark, monkeypatch, few, library, segment):
    import random

    monkeypatch.setattr(T, "FEW", few)
    monkeypatch.setattr(T, "LIBRARY", library)
    monkeypatch.setattr(T, "SEGMENT", segment)
    rng = random.Random(1)
    texts = {d: "".join(rng.choices(["ab", "ß", "b a", " ", "cd\n", "é", "😀", "."], k=rng.randint(1, 60))) for d in range(60)}
    anchors = [("t", f"c{i}", "contains", "".join(rng.choices(["ab", "SS", "b", " ", "c", "É", "😀"], k=rng.randint(1, 5)))) for i in range(40)]
    anchors += [("t", "x", "exact", texts[3]), ("u", "n", "normalized", texts[4].upper().replace("SS", "ß")), ("u", "same", "contains", "ab"), ("u", "blank", "contains", " ")]
    anchors = [a for a in anchors if a[3].strip()]
    b = spark.createDataFrame([(d, str(d), 1, "paragraph", 0.0, 0.0, t) for d, t in texts.items()], "doc_id long, block_id string, page int, type string, y double, x double, text string")
    a = spark.createDataFrame([(t, i, "label", m, x, None, None) for t, i, m, x in anchors], "template_id string, anchor_id string, kind string, mode string, text string, page int, block_types array<string>")
    got = {(r.doc_id, r.template_id, r.anchor_id) for r in T.match_anchors(b, a).collect()}
    assert got == plain_hits(texts, anchors)


@pytest.mark.parametrize("few", [64, 0])
def test_anchors_take_time_in_proportion_to_texts(spark, monkeypatch, few):
    import time

    monkeypatch.setattr(T, "FEW", few)
    text = "lorem ipsum dolor " * 58_000 + "seal number"  # 1 MB
    b = spark.createDataFrame([(1, "1", 1, "paragraph", 0.0, 0.0, text)], "doc_id long, block_id string, page int, type string, y double, x double, text string")
    a = spark.createDataFrame([("t", "a", "label", "contains", "Seal  Number", None, None), ("t", "b", "label", "contains", "seal numbers", None, None)], "template_id string, anchor_id string, kind string, mode string, text string, page int, block_types array<string>")
    T.match_anchors(b, a).collect()
    began = time.time()
    assert [r.anchor_id for r in T.match_anchors(b, a).collect()] == ["a"]
    assert time.time() - began < 5


def test_contracts_of_other_names(spark):
    """Nothing in the operators knows the given tables' values."""
    contracts = spark.createDataFrame([("send", ["ship"], ["box"], ["post"], None, None, True, True)], "action string, aliases array<string>, scopes array<string>, event_types array<string>, statuses array<string>, result_statuses array<string>, uploader boolean, unattempted boolean")
    jobs = spark.createDataFrame([(1, "new", None, 5, 0), (2, "new", None, 5, 1)], "job_id int, status string, result_status string, uploader int, attempts int")
    rows = [(1, 1, "ship", "post", 5, "box"), (2, 1, "send", "post", 6, "box"), (3, 2, "send", "post", 5, "box"), (4, 1, "ship", "mail", 5, "bag"), (5, 9, "send", "post", 5, "box"), (6, 1, "sell", "post", 5, "box"), (7, 1, "send", None, 5, None)]
    got = dict(map(tuple, A.check_contract(spark.createDataFrame(rows, "event_id int, job_id int, action string, event_type string, actor int, scope string"), contracts, jobs).collect()))
    assert got == {2: "uploader", 3: "attempted job", 4: "scope; event type", 5: "uploader; attempted job", 6: "unknown action", 7: "scope; event type"}
    runs = spark.createDataFrame([(1, 1, "c", "m", datetime(2024, 1, 1), datetime(2024, 1, 2), 0, True, "good"), (2, 2, "c", "m", datetime(2024, 1, 1), datetime(2024, 1, 2), 0, True, "F")], "run_id int, participant int, case_id string, arm string, started timestamp, ended timestamp, pause long, included boolean, outcome string")
    assert [tuple(r) for r in R.check_runs(runs, ["good"]).collect()] == [(2, "outcome")]
    events = spark.createDataFrame([(1, '{"deep":{"size":"7"}}'), (2, '{"deep":1}'), (3, None)], "event_id int, body string")
    assert [tuple(r) for r in A.event_view(events, "body", {"size": ("$.deep.size", "int")}, ["event_id"]).orderBy("event_id").collect()] == [(1, 7), (2, None), (3, None)]


def test_download_evidence_compares_ids(spark):
    h = "a" * 64
    artifacts = spark.createDataFrame([(1, 1, 10, h, "x"), (1, 1, 11, h, "y"), (2, 2, 20, h, "x")], "job_id int, document_id int, artifact_id int, sha string, name string")
    rows = [
        (1, 1, 1, None, None, None, [10, 11]), (2, 1, 1, h, "x", None, [10]), (3, 1, 1, h, "x", None, [10, 11]), (4, 1, 1, None, None, None, [10, 11, 20]), (5, 1, 1, None, None, None, [10]),
        (6, 1, 1, None, None, [11], [11]), (7, 1, 1, None, None, [], []), (8, 1, 1, h, "x", [11], [11]), (9, 1, 2, None, None, None, [10]), (10, 1, 1, h, None, None, None), (11, 1, 1, None, None, [20], [20]), (12, 2, 2, h, "x", None, [20, 20]),
    ]
    e = spark.createDataFrame(rows, "event_id int, job_id int, document_id int, sha string, name string, required array<int>, recorded array<int>")
    got = {r.event_id: (r.evidence, r.artifact_id, r.verdict) for r in A.download_evidence(e, artifacts).collect()}
    assert got == {
        1: (2, 10, ""), 2: (1, 10, ""), 3: (1, 10, "surplus"), 4: (2, 10, "foreign"), 5: (2, 10, "missing"), 6: (1, 11, ""), 7: (0, None, "required ids do not match"), 8: (1, 11, "required ids do not match"),
        9: (0, None, "no artifact; foreign"), 10: (0, None, "malformed declaration; no match"), 11: (1, 20, "required ids do not match; foreign"), 12: (1, 20, ""),
    }


def test_scopes_bind_documents_actors_and_actions(spark):
    entities = spark.createDataFrame([("doc", 1, None, 1, "ok", 5, None), ("vote", 1, 1, 1, "ok", 6, ["yes"])], "scope_type string, scope_id int, job_id int, document_id int, status string, actor int, verbs array<string>")
    rows = [(1, 1, 1, "put", 5, "doc", 1), (2, 1, 1, "put", 6, "doc", 1), (3, 1, 2, "see", 6, "doc", 1), (4, 1, 1, "yes", 6, "vote", 1), (5, 2, 1, "no", 5, "vote", 1), (6, 1, 1, "see", 5, "vote", 7), (7, 1, 1, "pay", 5, "doc", 1)]
    e = spark.createDataFrame(rows, "event_id int, job_id int, document_id int, action string, actor int, scope_type string, scope_id int")
    got = dict(map(tuple, A.resolve_scope(e, entities, {"pay": ["done"]}, ["put"], ["vote"]).collect()))
    assert got == {2: "other actor", 3: "other document", 5: "other job; other actor; other action", 6: "no such entity", 7: "state"}


def test_empty_inputs(spark):
    from docvigil.plans.views import view

    b = view(spark, SF, "blocks").limit(0)
    for out in (B.reading_order(b), B.review_gate(b), B.ocr_boundary(b), B.visual_lines(b.withColumn("fragment_id", F.col("idx").cast("long"))), B.table_groups(b.withColumn("tabular", F.lit(True)))):
        assert isinstance(out.toPandas(), pd.DataFrame) and out.count() == 0


def test_headers_merged_over_cells(spark):
    rows = spark.createDataFrame([(1, 0, 0, c, t) for c, t in enumerate(["Lot", "", "No", "Qty"])] + [(1, 0, 1, c, t) for c, t in enumerate(["", " ", "L7", "3"])] + [(1, 0, 2, 0, "L8")], "doc_id long, table_no int, row int, col int, text string")
    tables = spark.createDataFrame([("t", ["lot_no", "QTY", "unit"])], "template_id string, columns array<string>")
    score = T.column_score(rows, tables).first()
    assert abs(score.share - 2 / 3) < 1e-12 and score.header_row == 0
    fields = spark.createDataFrame([("t", "lot", "Lot No"), ("t", "qty", "qty"), ("t", "none", "colour")], "template_id string, field_id string, label string")
    assert {r.field_id: r.value for r in T.table_lookup(rows, fields).collect()} == {"lot": "L7", "qty": "3"}


def test_approvals_over_conversions(spark):
    schema = "block int, seq int, actor string, action string, text string, original string, conversion string, source string"
    events = spark.createDataFrame(
        [
            (1, 1, "a", "edit", "new", "old", "k1", "s"), (1, 2, "b", "approve", "new", "old", "k1", "s"), (1, 3, "a", "approve", "new", "old", "k1", "s"), (1, 4, "b", "approve", "old", "old", "k1", "s"),
            (1, 5, "c", "needs_fix", None, None, None, "s"), (1, 6, "b", "approve", "new", "old", "k1", "s"),
            (2, 1, "a", "edit", "new", "old", "k1", "s"), (2, 2, "b", "approve", "new", "new", "k2", "s"), (2, 3, "b", "approve", "new", "old", "k2", "s"), (2, 4, "b", "approve", "new", "new", "k2", "s2"),
            (3, 1, None, "edit", "new", "old", "k1", "s"), (3, 2, "b", "approve", "old", "old", "k1", "s"),
        ], schema)
    found = {(r.block, r.seq): r.against for r in A.approval_check(events, ["block"]).collect()}
    assert found == {
        (1, 2): "", (1, 3): "same actor", (1, 4): "stale text", (1, 6): "needs fix",
        (2, 2): "", (2, 3): "stale text", (2, 4): "no edit", (3, 2): "no edit",
    }


def test_secrets_and_content(spark):
    from docvigil.operators import parameters as P

    rows = [(1, '{"Api-Key":"k","n":null,"max_tokens":"3","url":"http://u:p@h/x"}'), (2, "token=abc; x=1"), (3, None), (4, "[1,2]"), (5, '{"message":"hello","secret_text":"x"}'), (6, '{"outer":{"my_password":"pw1","max_tokens":7},"list":["token: t2"]}'), (7, r'{"encoded":"{\\"api_key\\":\\"k9\\"}"}')]
    df = spark.createDataFrame(rows, "id int, p string")
    found = {r.id: r.parameters for r in P.redact_params(df, "id", "p").collect()}
    assert '"k"' not in found[1] and "u:p" not in found[1] and '"max_tokens":"3"' in found[1]
    assert found[2] == "token=[REDACTED]; x=1" and found[3] is None and found[4] == "[1,2]"
    assert "pw1" not in found[6] and "t2" not in found[6] and "max_tokens" in found[6] and "7" in found[6] and "k9" not in found[7]
    assert [(r.id, r.name) for r in P.reject_content(df, "id", "p").collect()] == [(2, ""), (4, ""), (5, "message"), (7, "")]  # no JSON object may be stored either


def test_items_without_a_counterpart_are_blocked(spark):
    side = "item_id string, label_id string, fixture_id string, document_id string, block_id string, value string, number double, page int, x double, risk string, requires_review boolean, extractor string, kind string"
    e = spark.createDataFrame([("i", "colour", "f", "d", "b", "red", None, 1, 2.0, "low", False, None, "pdf")], side)
    a = e.withColumns({"confidence": F.lit(0.9), "auto_confirmed": F.lit(True)})
    assert C.validate_items(e, a).first().status == "pass"
    none = C.validate_items(e, a.limit(0)).first()
    assert none.status == "block_auto_confirm" and none.failed_rules == ["scope_binding", "value_non_modification", "provenance", "risk_gate"]
    unsure = C.validate_items(e, a.withColumn("confidence", F.lit(float("nan")))).first()
    assert unsure.status == "block_auto_confirm" and unsure.failed_rules == ["risk_gate"]
