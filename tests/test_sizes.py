"""What a task holds must not grow with the table: shares of rows, narrow shuffles, small sides that Spark sees as small."""

from __future__ import annotations

import glob
import re

import pytest

from docvigil.operators import cells as C
from docvigil.operators import fixpoint
from docvigil.operators import templates as T
from docvigil.plans import load
from docvigil.plans.registry import QUERIES, select
from docvigil.plans.source_queries import s4
from docvigil.sources import sinks as K

SF = "/root/testdata/sf0.001"


load()


def plan(df, capsys) -> str:
    df.explain()
    return capsys.readouterr().out


@pytest.fixture
def small_shares(monkeypatch):
    monkeypatch.setattr(fixpoint, "SHARE", 50, raising=False)


def test_numbered_tables_go_out_in_even_shares(spark, small_shares, capsys):
    text = plan(select(spark, SF, "SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS n FROM lineitem"), capsys)
    assert int(re.search(r"hashpartitioning\(l_orderkey#\d+L?, (\d+)\), REPARTITION_BY_NUM", text)[1]) > 100


def test_header_spans_are_not_shuffled_by_name(spark, small_shares, capsys):
    rows = spark.range(2_000).selectExpr("id div 4 AS doc_id", "id div 2000 AS table_no", "0 AS row", "CAST(id % 4 AS INT) AS col", "CASE id % 4 WHEN 0 THEN 'Part' WHEN 1 THEN 'No' WHEN 2 THEN ' ' ELSE 'Qty' END AS text")
    score = T.column_score(rows, spark.createDataFrame([("t", ["part no", "no qty", "qty part"])], "template_id string, columns array<string>"))
    text = plan(score, capsys)
    assert "hashpartitioning(name" not in text and re.search(r"hashpartitioning\(doc_id#\d+L?, table_no#\d+L?, 40\), REPARTITION_BY_NUM", text)
    assert {(r.share, r.header_row) for r in score.collect()} == {(2 / 3, 0)} and score.count() == 500


def test_reviewed_fields_go_out_once_by_document(spark, small_shares, capsys):
    v = spark.range(1_000).selectExpr("id div 4 AS doc_id", "concat('f', id % 4) AS field_id", "CAST(id % 4 AS STRING) AS value", "'number' AS value_type")
    rules = spark.createDataFrame([("f0", "f1", "less_than"), ("f1", "f2", "greater_than"), ("f3", "f1", "equals"), ("f0", "f1", "not_equals")], "field_id string, related string, operator string")
    left = T.cross_field(v, rules)
    text = plan(left, capsys)
    assert "SortMergeJoin" not in text and re.search(r"hashpartitioning\(doc_id#\d+L?, 20\), REPARTITION_BY_NUM", text)
    assert {r.field_id for r in left.collect()} == {"f2"} and left.count() == 250


def test_rows_without_a_document_or_field_stay(spark):
    v = spark.createDataFrame([(None, "a", "2", "number"), (1, "a", "2", "number"), (1, None, "1", "number"), (1, "b", "1", "number"), (1, "b", "3", "number")], "doc_id long, field_id string, value string, value_type string")
    rules = spark.createDataFrame([("a", "b", "less_than")], "field_id string, related string, operator string")
    assert sorted((str(r.doc_id), str(r.field_id), r.value) for r in T.cross_field(v, rules).collect()) == [("1", "None", "1"), ("1", "b", "1"), ("1", "b", "3"), ("None", "a", "2")]


def test_mapped_fields_go_out_in_small_shares(spark, capsys, monkeypatch):
    monkeypatch.setattr(T, "SHARE", 400, raising=False)
    f = spark.range(3_000).selectExpr("id div 3 AS doc_id", "concat('f', id % 3) AS field_id", "id % 3 AS position", "concat('out.k', id % 3) AS output_key", "CAST(id AS STRING) AS value", "CAST(NULL AS STRING) AS warning")
    out = T.map_fields(f)
    assert re.search(r"hashpartitioning\(doc_id#\d+L?, 30\), REPARTITION_BY_NUM", plan(out, capsys))
    assert out.filter("doc_id = 1").first().output == '{"out":{"k0":"3","k1":"4","k2":"5"}}' and out.count() == 1_000


def test_sets_compare_in_even_shares(spark, small_shares, capsys):
    a, b = spark.range(1_000).selectExpr("id div 4 AS k", "CAST(id % 4 AS STRING) AS c"), spark.range(4, 1_000).selectExpr("id div 4 AS k", "CAST(id % 4 AS STRING) AS c")
    out = C.same_set(a, b)
    text = plan(out, capsys)
    assert "Join" not in text and re.search(r", 40\), REPARTITION_BY_NUM", text)
    assert tuple(out.first()) == (4, 0, False)
    none = spark.createDataFrame([(None, "x")], "k long, c string")
    assert tuple(C.same_set(none, none).first()) == (0, 0, True)


def test_cases_move_once_and_are_written_small(spark, capsys):
    out = s4(spark, SF)
    path = re.search(r"file:(/\S*docvigil-cases-[0-9a-f]+)", plan(out, capsys))[1]
    assert glob.glob(f"{path}*/*.json.gz") and not glob.glob(f"{path}*/*.json")


@pytest.mark.parametrize("far", [1, 2**40])
def test_the_highest_version_by_numbers_or_as_it_is(spark, far):
    kind = "struct<major:int,minor:int,patch:bigint>"
    rows = [("t", (1, 9, 5), 1), ("t", (2, -3, far), 1), ("t", (2, -3, 0), 1), ("t", (1, 9, -(2**40)), 2), ("u", (0, 0, 0), 1)]
    v = spark.createDataFrame(rows, f"template_id string, version {kind}, valid_from int")
    assert v.schema["version"].dataType.simpleString() == T._highest(v, ["template_id", "valid_from"]).schema["version"].dataType.simpleString()
    got = {(r.template_id, r.valid_from): tuple(r.version) for r in T._highest(v, ["template_id", "valid_from"]).collect()}
    assert got == {("t", 1): (2, -3, max(far, 0)), ("t", 2): (1, 9, -(2**40)), ("u", 1): (0, 0, 0)}
    none = v.union(spark.createDataFrame([("n", (None, 1, 2), 1), ("n", (None, 1, 3), 1)], v.schema))
    assert {r.template_id: tuple(r.version) for r in T._highest(none, ["template_id"]).collect()}["n"] == (None, 1, 3)


def test_who_asks_for_no_version_is_not_shuffled_by_it(spark, capsys):
    v = spark.createDataFrame([("t", (1, 0, 0), True, 1, None), ("t", (1, 0, 1), False, 1, None)], "template_id string, version struct<major:int,minor:int,patch:bigint>, active boolean, valid_from int, valid_until int")
    docs = spark.createDataFrame([(1, "t", 5, None), (2, "t", 5, (1, 0, 1)), (3, "t", 0, None), (4, "t", 5, (9, 9, 9))], "doc long, template_id string, as_of int, asked struct<major:int,minor:int,patch:bigint>")
    out = T.effective_version(docs, v)
    assert "isnotnull(asked" in plan(out, capsys)
    assert {r.doc: r.version and r.version.patch for r in out.collect()} == {1: 0, 2: 1, 3: None, 4: None}


def test_anchor_hits_are_not_shuffled_by_text(spark, capsys):
    blocks = spark.createDataFrame([(1, "b", 1, "label", 0.0, 0.0, "the total")], "doc_id long, block_id string, page int, type string, y double, x double, text string")
    anchors = spark.createDataFrame([("t", "a", "label", "contains", "total", None, None)], "template_id string, anchor_id string, kind string, mode string, text string, page int, block_types array<string>")
    out = T.match_anchors(blocks, anchors)
    assert "hashpartitioning(find" not in plan(out, capsys) and out.count() == 1


def test_stored_contents_move_once(spark, tmp_path, capsys):
    d = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "text string")
    folder = f"file://{tmp_path}/store"
    assert {r.created for r in K.store_objects(d.limit(1), "text", folder).collect()} == {True}
    assert sorted(r.created for r in K.store_objects(d, "text", folder).collect()) == [False, True]
    text = plan(K.read_objects(spark, folder).select("sha", "valid"), capsys)
    assert "max_by(" not in text and K.read_objects(spark, folder).filter("valid").count() == 2


def test_candidate_tables_are_made_once(spark, capsys):
    assert "Window" not in plan(QUERIES["d15_table_warnings"](spark, SF), capsys)


def test_evidence_goes_out_in_even_shares(spark, small_shares, capsys):
    text = plan(QUERIES["j28_download_evidence"](spark, SF), capsys)
    assert min(map(int, re.findall(r"hashpartitioning\(event_id#\d+L?, (\d+)\)", text))) > 100
