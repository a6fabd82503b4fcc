"""Operators whose rules SQL states poorly, against plain Python and rows worked out by hand."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from docvigil.operators import audit as A
from docvigil.operators import blocks as B
from docvigil.operators import checks as H
from docvigil.operators import parameters as P
from docvigil.operators import templates as T
from docvigil.operators.fixpoint import shared_folder
from docvigil.plans.block_queries import _fragments, j12
from docvigil.streaming import logs as L

SF = "/root/testdata/sf0.001"


def test_cross_field_follows_a_long_chain(spark):
    rows = [(1, f"f{i:02d}", 1.0 if i else 2.0) for i in range(50)] + [(2, f"f{i:02d}", float(i)) for i in range(50)]
    pairs = [(f"f{i:02d}", f"f{i - 1:02d}") for i in range(1, 50)] + [("f00", "gone")]
    v = spark.createDataFrame(rows, "doc_id long, field_id string, number double").repartition(2)
    # f00 needs a field that is not there; each next one needs the one before it
    left = T.cross_field(v.filter("doc_id = 1"), spark.createDataFrame(pairs, "field_id string, related string"))
    assert left.count() == 0


def naive_lines(rows: list[tuple]) -> dict[int, int]:
    """Fragments (id, x, y, w, h) gathered line by line, every rule spelt out."""
    lines: list[list[tuple]] = []
    out = {}
    for f in sorted(rows, key=lambda r: (r[2], r[1], r[0])):
        i, x, y, w, h = f
        for line in reversed(lines):
            left = min(line, key=lambda r: r[1])
            tall = max(left[4], h)
            gaps = [max(x - (r[1] + r[3]), r[1] - (x + w), 0) for r in line]
            top, low = min(r[2] for r in line), max(r[2] + r[4] for r in line)
            if abs((y + h / 2) - (left[2] + left[4] / 2)) > tall * 0.25:
                shared = max(0.0, min(y + h, low) - max(y, top))
                side = [g for r in line for g in (x - (r[1] + r[3]), r[1] - (x + w))]
                joins = shared >= 0.25 * min(h, low - top) and any(-0.15 * tall <= g <= 2 * tall for g in side)
            else:
                joins = min(gaps) <= 2 * tall
            if joins:
                line.append(f)
                out[i] = lines.index(line) + 1
                break
        else:
            lines.append([f])
            out[i] = len(lines)
    return out


def test_visual_lines_equal_plain_loops(spark):
    rng = random.Random(7)
    rows = []
    for page in range(12):
        for i in range(40):
            rows.append((1, page, page * 100 + i, float(rng.randint(0, 400)), float(rng.randint(0, 120)), float(rng.randint(5, 90)), float(rng.randint(6, 16))))
    f = spark.createDataFrame(rows, "doc_id long, page int, fragment_id long, x double, y double, w double, h double")
    found: dict = {}
    for r in B.visual_lines(f).collect():
        found.setdefault(r.page, {})[r.fragment_id] = r.line
    for page in range(12):
        assert found[page] == naive_lines([r[2:] for r in rows if r[1] == page])


def test_metadata_assignment_equals_plain_loops(spark):
    frags = _fragments(spark, SF).toPandas()
    sources = frags[frags.idx % 3 != 1]
    wanted = {}
    for key, g in frags.groupby(["doc_id", "page"]):
        s = sources[(sources.doc_id == key[0]) & (sources.page == key[1])]
        by_text: dict = {}
        for r in s.itertuples():
            by_text.setdefault(r.text, []).append((r.fragment_id + 1, r.idx % 2, r.x + 3, r.y))
        pairs = [(abs(r.x - x) + abs(r.y - y), rank, r.fragment_id, sid) for r in g.itertuples() for sid, rank, x, y in by_text.get(r.text, [])]
        while pairs:  # the best pair that is left, then all without its ends
            best = min(pairs)
            wanted[best[2]] = best[3]
            pairs = [p for p in pairs if p[2] != best[2] and p[3] != best[3]]
        if len(wanted) > 3000:
            break
    found = {r.fragment_id: r.source_id for r in j12(spark, SF).collect()}
    assert wanted and all(found[k] == v for k, v in wanted.items())


def plain_approvals(events: list[dict]) -> dict[int, str]:
    out = {}
    for a in events:
        if a["action"] != "approve":
            continue
        past = [p for p in events if p["seq"] < a["seq"] and p["action"] != "approve" and not (p["source"] and a["source"] and p["source"] != a["source"])]
        other = lambda p, a=a: bool(p["conversion"] and a["conversion"] and p["conversion"] != a["conversion"])
        edits = [p for p in past if p["action"] == "edit" and p["actor"] is not None]
        own = [p for p in edits if not other(p)]
        far = [p for p in edits if other(p) and p["text"] == a["text"]]
        if any(a["conversion"] is not None and p["conversion"] == a["conversion"] for p in edits):
            far = []
        fixes = [p["seq"] for p in past if p["action"] == "needs_fix" and not other(p)]
        last = max(own, key=lambda p: p["seq"], default=None)
        bad = []
        if fixes and max(fixes) > (last["seq"] if last else 0):
            bad.append("needs fix")
        if any(p["actor"] == a["actor"] for p in own + far):
            bad.append("same actor")
        if not last and not far:
            bad.append("no edit")
        if a["text"] != (last["text"] if last else a["original"]) or far and a["text"] != a["original"]:
            bad.append("stale text")
        out[a["seq"]] = "; ".join(bad)
    return out


def test_approvals_equal_plain_loops(spark):
    rng = random.Random(5)
    names = ["seq", "actor", "action", "text", "original", "conversion", "source"]
    rows, wanted = [], {}
    for block in range(60):
        mine = []
        for seq in range(1, rng.randint(2, 25)):
            mine.append(dict(zip(names, (seq, rng.choice(["a", "b", "c", None]), rng.choice(["edit", "needs_fix", "approve", "approve", "note"]), rng.choice("xy"), rng.choice("xy"), rng.choice(["k1", "k1", "k2", "k3", None]), rng.choice(["s", "s", "s2", None])))))
        mine = [m for m in mine if not (m["action"] == "approve" and m["actor"] is None)]
        rows += [(block, *m.values()) for m in mine]
        wanted |= {(block, k): v for k, v in plain_approvals([m for m in mine if m["action"] != "note"]).items()}
    df = spark.createDataFrame(rows, "block int, seq long, actor string, action string, text string, original string, conversion string, source string")
    assert {(r.block, r.seq): r.against for r in A.approval_check(df, ["block"]).collect()} == wanted


def test_no_secret_survives_at_any_depth():
    rng = random.Random(3)
    names = ["password", "clientSecret", "X-Api-Key", "sig", "accessKey", "%70assword", "APIToken", "set-cookie"]

    def tree(depth: int) -> object:
        kind = rng.randint(0, 6)
        if depth == 0 or kind == 0:
            return rng.choice(["plain", 1, None, True, 2.5])
        if kind == 1:
            return [tree(depth - 1) for _ in range(3)]
        if kind == 2:
            return {"name": rng.choice(names), "value": rng.choice(["hidden!", ["hidden!"], {"v": "hidden!"}])}
        if kind == 3:
            return json.dumps({rng.choice(names): "hidden!", "k": tree(depth - 1)})
        if kind == 4:
            return rng.choice(["https://u:hidden!@h/x", "https://h/?token=hidden!", "a=1&auth=hidden!", "Authorization: Digest hidden!", '{"password": hidden!', "sk-hidden!"])
        return {rng.choice([*names, "a", "b"]): "hidden!" if rng.random() < 0.5 and False else tree(depth - 1), rng.choice(names) + "_2": {"deep": ["hidden!"]}, "plain": 1}

    for _ in range(400):
        text = json.dumps({"root": tree(4)})
        out = P._redact(text)
        assert "hidden!" not in out and isinstance(json.loads(out), dict)
        assert P._redact(out) == out  # nothing more to hide
    assert json.loads(P._redact('{"b":1,"c":1.5,"d":"x","e":null,"usage":{"max_tokens":3}}')) == {"b": 1, "c": 1.5, "d": "x", "e": None, "usage": {"max_tokens": 3}}
    assert P._redact('{"a":1,"a":2,"password":3}') == P.REDACTED and P._redact("[" * 100 + "]" * 100).count(P.REDACTED) == 1


def test_content_is_found_by_path():
    found = lambda value: {(f["name"], f["reason"]) for f in P._findings(json.dumps(value), 50)}
    assert found({"a": {"b": [{"prompt": "x"}]}}) == {("a.b.[0].prompt", "content-bearing name")}
    assert found({"options": [{"name": "body", "value": "x"}, ["text", "y"]], "n": 1}) == {("options.[0].body", "content-bearing name"), ("options.[1].text", "content-bearing name")}
    assert found({"headers": [["X-Document", "y"]], "files": ["a"]}) == {("headers.[0].X-Document", "content-bearing name"), ("files", "file")}
    assert found({"output": {"bytes": 3}, "size": {"bytes": 3}}) == {("output", "content-bearing name")}
    assert found({"message_id": 1, "content_type": "t", "secret_text": "x", "form_data_type": "z", "model_data": {}}) == set()
    assert found({"long": "x" * 51, "json": "{}"}) == {("long", "content-sized value"), ("json", "content-bearing name")}
    assert found({"metadata_json": '{"payload": 1}'}) == {("metadata_json.payload", "content-bearing name")}
    assert found([1]) == {("", "no JSON object")} and P._findings(None, 50) == []


def test_rules_of_an_unknown_kind_are_errors(spark):
    df = spark.createDataFrame([(1, '{"a":"x"}')], "id int, body string")
    with pytest.raises(ValueError):
        T.check_schema(df, "id", "body", [("a", "shape", 1)])
    assert T.check_schema(df, "id", "body", [("a", "const", "y")]).first().violations == "a is another constant"
    assert T.check_schema(df, "id", "body", [("a", "const", "x"), ("a", "type", "string")]).count() == 0


def test_backlog_numbers_over_many_ranges(spark):
    rows = [(i, (i * 7919) % 3000, "queued" if i % 5 else "succeeded", "light" if i % 100 else "heavy") for i in range(3000)]
    found = {r.job_id: (r.mode, r.place) for r in A.backlog(spark.createDataFrame(rows, "job_id long, seq long, status string, mode string").repartition(7)).collect()}
    for mode in ("light", "heavy"):
        queue = sorted((s, i) for i, s, status, m in rows if status == "queued" and m == mode)
        assert [found[i] for _, i in queue] == [(mode, n + 1) for n in range(len(queue))]


def test_sheets_by_hand(spark):
    rows = [
        ("small", 1, 3, 2, "c"), ("small", 2, 1, 1, "a"), ("small", 3, 3, 2, "later"), ("small", 4, 2, 2, ""), ("small", 5, None, None, "loose"),
        ("high", 1, 5000, 3, "z"), ("high", 2, 7, 1, "y"), ("wide", 1, 1, 9000, "q"), ("wide", 2, 1, 4, "p"), ("wide", 3, 9, 1, "r"), ("none", 2, None, 1, "second"), ("none", 1, 1, None, "first"),
    ]
    found: dict = {}
    for r in H.sheet_grid(spark.createDataFrame(rows, "sheet string, nth long, row int, col int, value string")).orderBy("sheet", "place").collect():
        found.setdefault(r.sheet, []).append(r.cells)
    assert found == {"small": [["a", ""], ["", ""], ["", "later"], ["loose"]], "high": [["y", "", ""], ["", "", "z"]], "wide": [["p", "q"], ["r"]], "none": [["first"], ["second"]]}


def test_anchors_and_labels_meet_on_keys(spark):
    blocks = spark.createDataFrame([(1, "b1", 1, "paragraph", 0.0, 0.0, "Total amount due"), (1, "b2", 2, "table", 0.0, 0.0, "Part|Qty\nA|to"), (2, "b1", 1, "heading", 0.0, 0.0, "x")], "doc_id long, block_id string, page int, type string, y double, x double, text string")
    anchors = spark.createDataFrame([("t", "c", "label", "contains", "AL amount D", None, None), ("t", "one", "label", "contains", "x", None, None), ("t", "h", "table_header", "contains", "qt", None, ["table"]), ("t", "e", "label", "exact", "X", None, None), ("t", "n", "label", "normalized", " total  AMOUNT due", 1, None), ("t", "blank", "label", "contains", " ", None, None)], "template_id string, anchor_id string, kind string, mode string, text string, page int, block_types array<string>")
    hits = T.match_anchors(blocks, anchors)
    assert sorted((r.doc_id, r.block_id, r.anchor_id) for r in hits.collect()) == [(1, "b1", "c"), (1, "b1", "n"), (1, "b2", "h"), (2, "b1", "one")]
    plan = hits._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    fields = spark.createDataFrame([("t", "q", "Qty"), ("t", "r", "a:b"), ("t", "z", "no")], "template_id string, field_id string, label string")
    labelled = spark.createDataFrame([(1, "x", "Qty : 5 A:B: seven"), (2, "x", "subQty: 5"), (3, "x", "no colon")], "doc_id long, block_id string, text string")
    found = T.label_values(labelled, fields)
    assert sorted((r.doc_id, r.field_id, r.value) for r in found.collect()) == [(1, "q", "5"), (1, "r", "seven")]
    assert "NestedLoop" not in found._jdf.queryExecution().toString()


def test_states_end_with_a_horizon(spark, tmp_path):
    schema = "event_id long, ts timestamp, user_id long, event_type string"
    for n, (day, user) in enumerate(((1, 1), (2, 2), (20, 3), (25, 3), (26, 1))):
        rows = spark.sql(f"SELECT CAST({n} AS LONG) AS event_id, TIMESTAMP '2024-01-{day:02d} 00:00:00' AS ts, CAST({user} AS LONG) AS user_id, 'e{n}' AS event_type")
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    kept = {r.event_id for r in L.drain(L.stream_conflicts(stream(), "user_id", "event_type"), "all").collect()}
    ended = {r.event_id for r in L.drain(L.stream_conflicts(stream(), "user_id", "event_type", horizon="1 day"), "ended").collect()}
    assert kept == {3, 4} and ended == {3}
    once = L.drain(L.stream_record_once(stream(), ["user_id"], ["event_type"]), "once").collect()
    assert {(r.event_id, r.first_event_id, r.first_event_type, r.repeated) for r in once} == {(0, 0, "e0", False), (1, 1, "e1", False), (2, 2, "e2", False), (3, 2, "e2", True), (4, 0, "e0", True)}


def test_scratch_needs_a_shared_folder_on_a_cluster(spark):
    class Elsewhere:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Elsewhere()

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(RuntimeError):
        shared_folder(Session())
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


def test_only_written_tables_are_forgotten(spark, tmp_path):
    from docvigil.operators.fixpoint import forget, written

    spark.range(3).write.parquet(str(tmp_path / "own"))
    own, scratch = spark.read.parquet(str(tmp_path / "own")), written(spark.range(5))
    folder = scratch.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
    forget(own, scratch)
    import os

    assert own.count() == 3 and not os.path.exists(folder)


def test_pages_are_read_in_batches(spark):
    """Pages that cross batches, repeated texts, and more copies on a page than pairs can be laid out for."""
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        rng = random.Random(9)
        f = [(d, p, i, rng.choice("abc"), float(rng.randint(0, 9)), float(rng.randint(0, 9)), 5.0, 4.0) for i, (d, p) in enumerate((d, p) for d in range(4) for p in (1, 2) for _ in range(20))]
        s = [(d, p, t, i, rng.randint(0, 2), x + rng.randint(0, 3), y) for d, p, i, t, x, y, _, _ in f if rng.random() < 0.7]
        fragments = spark.createDataFrame(f, "doc_id long, page int, fragment_id long, text string, x double, y double, w double, h double")
        sources = spark.createDataFrame(s, "doc_id long, page int, text string, source_id long, rank int, x double, y double")
        wanted, used_f, used_s = set(), set(), set()
        for _, _, i, j in sorted((abs(a[4] - b[5]) + abs(a[5] - b[6]), b[4], a[2], b[3]) for a in f for b in s if a[:2] == b[:2] and a[3] == b[2]):
            if i not in used_f and j not in used_s:
                used_f.add(i)
                used_s.add(j)
                wanted.add((f[i][0], i, j))
        assert {tuple(r) for r in B.assign_metadata(fragments, sources).collect()} == wanted
        lines = {r.fragment_id: r.line for r in B.visual_lines(fragments).collect()}
        for d in range(4):
            for p in (1, 2):
                own = naive_lines([(r[2], *r[4:]) for r in f if r[:2] == (d, p)])
                assert own == {i: lines[i] for i in own}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    many = spark.range(20_000).selectExpr("1L AS doc_id", "1 AS page", "id AS fragment_id", "CAST(id AS STRING) AS text", "CAST(id AS DOUBLE) AS x", "0D AS y")
    pairs = B.assign_metadata(many, many.selectExpr("doc_id", "page", "text", "fragment_id AS source_id", "0 AS rank", "x", "y"))
    assert pairs.filter("fragment_id = source_id").count() == 20_000
