"""Jobs, events and audit logs: sequences, hash chains, contracts, references, stored objects."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docvigil.functions.text import norm
from docvigil.functions.values import finite
from docvigil.operators.cells import rules
from docvigil.operators.fixpoint import dealt, written

EVENT_FILTERS = ("document_id", "block_id", "conversion_id", "job_id", "action", "status")


def scan_events(events: DataFrame, **filters: object) -> DataFrame:
    """Events that equal every filter; an unknown or blank filter is an error, not all rows."""
    for name, value in filters.items():
        if name not in EVENT_FILTERS or name not in events.columns:
            raise ValueError(f"unknown filter {name}")
        if value is None or isinstance(value, str) and not value.strip():
            raise ValueError(f"filter {name} is blank")
    return events.filter(reduce(lambda a, b: a & b, [F.col(k) == F.lit(v) for k, v in filters.items()], F.lit(True)))


def sequence_gaps(events: DataFrame, by: list[str]) -> DataFrame:
    """Events whose number is not their place, counted from 1 in each group."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy("seq", "event_id"))
    return events.withColumn("place", place).filter("seq <> place").select(*by, "event_id", "seq", "place")


def event_digest(previous: Column, *fields: str) -> Column:
    """SHA-256 of an event's canonical JSON: fields by name, nulls kept, and the previous digest."""
    named = sorted([(c, F.col(c)) for c in fields] + [("previous_hash", previous)])
    return F.sha2(F.to_json(F.struct(*[v.alias(k) for k, v in named]), {"ignoreNullFields": "false"}), 256)


def verify_chain(events: DataFrame, by: list[str], fields: list[str]) -> DataFrame:
    """Events that break their group's chain, and how. Each event is compared with the one numbered
    before it by a join on (group, number), so a log in one chain is verified in parallel as well."""
    before = events.select(*by, (F.col("seq") + 1).alias("seq"), F.col("event_hash").alias("before"))
    j = events.join(before, [*by, "seq"], "left")
    gap = (F.col("seq") > 1) & F.col("before").isNull()
    link = F.when(F.col("seq") == 1, F.col("previous_hash") != "").otherwise(F.coalesce(F.col("previous_hash") != F.col("before"), F.lit(False)))
    bad = rules(("sequence gap", gap), ("broken link", link), ("content changed", F.col("event_hash") != event_digest(F.col("previous_hash"), *fields)))
    return j.select(*by, "seq", F.concat_ws("; ", bad).alias("violations")).filter("violations <> ''")


def chain_heads(events: DataFrame, by: list[str], checkpoint: DataFrame) -> DataFrame:
    """Chains whose head is not the checkpoint's: (by..., head_hash, length)."""
    heads = events.groupBy(*by).agg(F.max_by("event_hash", "seq").alias("found_hash"), F.max("seq").alias("found_length"))
    j = checkpoint.join(heads, by, "full_outer")
    return j.filter(~F.col("head_hash").eqNullSafe(F.col("found_hash")) | ~F.col("length").eqNullSafe(F.col("found_length"))).select(*by, "length", "found_length")


def missing_refs(child: DataFrame, parent: DataFrame, keys: dict[str, str]) -> DataFrame:
    """Child rows whose reference (child column to parent column) finds no parent; null refers to nothing."""
    p = parent.select(*[F.col(b).alias(f"_p{i}") for i, b in enumerate(keys.values())]).distinct()
    on = reduce(lambda a, b: a & b, [F.col(a) == F.col(f"_p{i}") for i, a in enumerate(keys)])
    named = reduce(lambda a, b: a & b, [F.col(a).isNotNull() for a in keys])
    return child.filter(named).join(p, on, "left_anti")


def fk_violations(entities: dict[str, DataFrame], references: list[tuple[str, str, dict[str, str]]]) -> DataFrame:
    """(child, parent, rows) of each broken reference of (child, parent, keys), composite ones too."""
    found = [missing_refs(entities[c], entities[p], k).agg(F.count(F.lit(1)).alias("n")).select(F.lit(c).alias("child"), F.lit(p).alias("parent"), F.lit(",".join(k)).alias("keys"), "n") for c, p, k in references]
    return reduce(DataFrame.unionByName, found)


def match_targets(events: DataFrame, targets: DataFrame, bound: list[str]) -> DataFrame:
    """Events with whether a registered target has all their bound fields, null matching null."""
    t = targets.select(*[F.col(c).alias(f"_{c}") for c in bound]).distinct().withColumn("_hit", F.lit(True))
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in bound])
    return events.join(t, on, "left").withColumn("registered", F.coalesce("_hit", F.lit(False))).drop("_hit", *[f"_{c}" for c in bound])


def job_context(jobs: DataFrame, documents: DataFrame) -> DataFrame:
    return jobs.join(documents, "document_id")


def approval_check(events: DataFrame, by: list[str]) -> DataFrame:
    """Approvals with what stands against them: open needs-fix, same actor, no edit, stale text.

    ``events(by..., seq, actor, action, text, original, conversion, source)``; an approval is held against
    the earlier edits and needs-fix marks of its target, as far as their source, where both name one, is
    its own. Marks of another conversion do not count; edits of another conversion count only where none
    of the approval's own exists, and only with the approved text. Edits without an actor do not count.

    An approval never meets its key's events one by one. The last edit and mark are running maxima in one
    ordered window: an event stands under its source and conversion and under any, an approval looks where
    its own agree, four rows each at most. Whether there was an edit by an actor or with a text is decided
    by the first such event of each source and conversion.
    """
    no, any_of = F.lit(False), F.lit("*")
    named = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit("-"))
    e = events.filter("action IN ('approve', 'edit', 'needs_fix')").withColumns({"is_appr": F.col("action") == "approve", "edited": (F.col("action") == "edit") & F.col("actor").isNotNull()})

    def seen(c: str) -> Column:
        asks = F.when(F.col(c).isNull(), F.array(any_of)).otherwise(F.array(named(c), F.lit("-")))
        return F.when(F.col("is_appr"), asks).otherwise(F.array(named(c), any_of))

    spots = e.withColumn("at_source", F.explode(seen("source"))).withColumn("at_conversion", F.explode(seen("conversion")))
    before = Window.partitionBy(*by, "at_source", "at_conversion").orderBy("seq", F.col("is_appr").desc()).rowsBetween(Window.unboundedPreceding, -1)
    last = F.max(F.when(F.col("edited"), F.struct("seq", "text"))).over(before)
    fix = F.max(F.when(F.col("action") == "needs_fix", F.col("seq"))).over(before)
    ran = spots.withColumns({"last": last, "fix": fix}).filter("is_appr").groupBy(*by, "seq").agg(F.max("last").alias("last"), F.max("fix").alias("fix"))
    appr = e.filter("is_appr").select(*by, "seq", "actor", "text", "original", "conversion", "source")

    edits = e.filter("edited")
    earlier = F.col("p_seq") < F.col("seq")
    differ = lambda c: F.coalesce(F.col(c) != F.col(f"p_{c}"), no)

    def first(keys: list[str]) -> DataFrame:
        """The first edit of each source and conversion for the given columns."""
        other = [c for c in ("conversion", "source") if c not in keys]
        return edits.groupBy(*by, *keys, *other).agg(F.min("seq").alias("p_seq")).select(*by, *keys, "p_seq", *[F.col(c).alias(f"p_{c}") for c in other])

    def found(keys: list[str], holds: Column, name: str) -> DataFrame:
        j = appr.join(first(keys), [*by, *keys]).filter(earlier & ~differ("source") & holds)
        return j.select(*by, "seq").distinct().withColumn(name, F.lit(True))

    g = appr.join(ran, [*by, "seq"], "left")
    for keys, holds, name in (
        (["actor"], ~differ("conversion"), "same"), (["conversion"], F.lit(True), "matched"),
        (["text"], differ("conversion"), "far"), (["text", "actor"], differ("conversion"), "far_same"),
    ):
        g = g.join(found(keys, holds, name), [*by, "seq"], "left")
    g = g.fillna(False, ["same", "matched", "far", "far_same"])
    far_counts = ~F.col("matched") & F.col("far")
    at = F.col("last.seq")
    wanted = F.when(at.isNotNull(), F.col("last.text")).otherwise(F.col("original"))
    bad = rules(
        ("needs fix", F.coalesce(F.col("fix") > F.coalesce(at, F.lit(0)), no)), ("same actor", F.col("same") | (far_counts & F.col("far_same"))), ("no edit", at.isNull() & ~far_counts),
        ("stale text", ~F.col("text").eqNullSafe(wanted) | (far_counts & ~F.col("text").eqNullSafe(F.col("original")))))
    return g.select(*by, "seq", F.concat_ws("; ", bad).alias("against"))


def check_contract(events: DataFrame, contracts: DataFrame, jobs: DataFrame) -> DataFrame:
    """Events that their action's contract does not allow.

    ``events(event_id, job_id, action, event_type, actor, scope)``; ``contracts(action, aliases, scopes,
    event_types, statuses, result_statuses, uploader, unattempted)``, where null lists allow all and an action
    goes by its name or an alias; ``jobs(job_id, status, result_status, uploader, attempts)``. What a contract
    asks for and a job does not have counts against the event.
    """
    c = contracts.select(
        F.explode(F.array_distinct(F.array_append(F.col("aliases"), F.col("action")))).alias("action"), "scopes", "event_types", "statuses", "result_statuses",
        F.coalesce("uploader", F.lit(False)).alias("by_uploader"), F.coalesce("unattempted", F.lit(False)).alias("unattempted"), F.lit(True).alias("known"))
    j = events.join(c, "action", "left").join(jobs.select("job_id", "status", "result_status", "uploader", "attempts"), "job_id", "left")
    known, no = F.coalesce("known", F.lit(False)), F.lit(False)
    outside = lambda allowed, v: known & F.col(allowed).isNotNull() & ~F.coalesce(F.array_contains(F.col(allowed), F.col(v)), no)
    bad = rules(
        ("unknown action", ~known), ("scope", outside("scopes", "scope")), ("event type", outside("event_types", "event_type")), ("job status", outside("statuses", "status")),
        ("result status", outside("result_statuses", "result_status")), ("uploader", known & F.col("by_uploader") & ~F.coalesce(F.col("actor") == F.col("uploader"), no)),
        ("attempted job", known & F.col("unattempted") & ~F.coalesce(F.col("attempts") == 0, no)))
    return j.select("event_id", F.concat_ws("; ", bad).alias("violations")).filter("violations <> ''")


#: A SHA-256 digest in lowercase hexadecimal.
DIGEST = "^[0-9a-f]{64}$"


def download_evidence(events: DataFrame, artifacts: DataFrame, rows: int | None = None) -> DataFrame:
    """What download events rest on: (event_id, evidence, artifact_id, verdict).

    ``artifacts(job_id, document_id, artifact_id, sha, name)`` are those of successful results. A declared
    hash or name asks for both, and for an artifact of the event's job and document that has them; without,
    all of these artifacts match. ``required``, where not null, is the part of the matching ids that the event
    stands for, else all. ``recorded`` ids, exploded and counted against them, must be the same set: what is
    not recorded is missing, what is recorded of the same job is surplus, and of another or of none, foreign.
    ``evidence`` counts the ids that the event stands for and ``artifact_id`` is the least of them. ``rows``: about
    how many artifacts there are, where the caller knows; else they are counted.
    """
    n = artifacts.count() if rows is None else rows
    declared = F.col("sha").isNotNull() | F.col("name").isNotNull()
    formed = F.coalesce(F.col("sha").rlike(DIGEST) & (F.trim("name") != ""), F.lit(False))
    e = events.select("event_id", "job_id", "document_id", "sha", "name", "required", "recorded", declared.alias("declared"), formed.alias("formed"))
    a = artifacts.select("job_id", "document_id", "artifact_id", F.col("sha").alias("_sha"), F.col("name").alias("_name"))
    yes, no = F.lit(True), F.lit(False)
    match = ~F.col("declared") | F.coalesce(F.col("formed") & (F.col("sha") == F.col("_sha")) & (F.col("name") == F.col("_name")), no)
    scope = ["job_id", "document_id"]
    ids = dealt(e, *scope, rows=n).join(dealt(a, *scope, rows=n), scope).select("event_id", "artifact_id", yes.alias("own"), match.alias("match"), no.alias("asked"), no.alias("noted"))
    ids = ids.unionByName(e.select("event_id", F.explode("required").alias("artifact_id")).select("*", no.alias("own"), no.alias("match"), yes.alias("asked"), no.alias("noted")))
    ids = ids.unionByName(e.select("event_id", F.explode("recorded").alias("artifact_id")).select("*", no.alias("own"), no.alias("match"), no.alias("asked"), yes.alias("noted")))
    ids = dealt(ids, "event_id", rows=2 * n).groupBy("event_id", "artifact_id").agg(*[F.bool_or(c).alias(c) for c in ("own", "match", "asked", "noted")])
    own, hit, asked, noted = (F.col(c) for c in ("own", "match", "asked", "noted"))
    counts = ids.groupBy("event_id").agg(
        F.count_if(own).alias("n_own"), F.count_if(hit).alias("n_match"), F.count_if(asked & ~hit).alias("n_astray"), F.min(F.when(hit, F.col("artifact_id"))).alias("least_match"), F.min(F.when(asked, F.col("artifact_id"))).alias("least_asked"), F.count_if(asked).alias("n_asked"),
        F.count_if(hit & ~noted).alias("all_missing"), F.count_if(asked & ~noted).alias("asked_missing"), F.count_if(noted & own & ~hit).alias("all_surplus"), F.count_if(noted & own & ~asked).alias("asked_surplus"), F.count_if(noted & ~own).alias("foreign"))
    j = dealt(e, "event_id", rows=2 * n).join(counts, "event_id", "left").fillna(0, ["n_own", "n_match", "n_astray", "n_asked", "all_missing", "asked_missing", "all_surplus", "asked_surplus", "foreign"])
    part = F.col("required").isNotNull()
    pick = lambda x, y: F.when(part, F.col(x)).otherwise(F.col(y))
    bad = rules(
        ("no artifact", F.col("n_own") == 0), ("malformed declaration", F.col("declared") & ~F.col("formed")), ("no match", (F.col("n_own") > 0) & (F.col("n_match") == 0)),
        ("required ids do not match", part & ((F.col("n_asked") == 0) | (F.col("n_astray") > 0))), ("missing", pick("asked_missing", "all_missing") > 0), ("surplus", pick("asked_surplus", "all_surplus") > 0), ("foreign", F.col("foreign") > 0))
    return j.select("event_id", pick("n_asked", "n_match").alias("evidence"), pick("least_asked", "least_match").alias("artifact_id"), F.concat_ws("; ", bad).alias("verdict"))


def resolve_scope(events: DataFrame, entities: DataFrame, states: dict[str, list[str]], uploads: list[str], acted: list[str]) -> DataFrame:
    """Events whose scope is not an entity of their own job and document that allows the action.

    ``events(event_id, job_id, document_id, action, actor, scope_type, scope_id)``; ``entities(scope_type,
    scope_id, job_id, document_id, status, actor, verbs)``, job_id null for what belongs to a document only.
    ``states``: the statuses that an action needs. The entity's actor (its uploader, or who decided) must be the
    event's for actions in ``uploads`` and for scope types in ``acted``; ``verbs``, where not null, are the
    actions that the entity itself stands for.
    """
    names = ["job_id", "document_id", "status", "actor", "verbs"]
    e = entities.select("scope_type", "scope_id", *[F.col(c).alias(f"_{c}") for c in names], F.lit(True).alias("_found"))
    j = events.join(e, ["scope_type", "scope_id"], "left")
    no = F.lit(False)
    allowed = reduce(lambda w, kv: w.when(F.col("action") == kv[0], F.col("_status").isin(*kv[1])), states.items(), F.when(no, True)).otherwise(F.lit(True))
    found = F.coalesce("_found", no)
    personal = F.col("action").isin(*uploads) | F.col("scope_type").isin(*acted)
    bad = rules(
        ("no such entity", ~found), ("other job", found & F.col("_job_id").isNotNull() & ~F.col("job_id").eqNullSafe(F.col("_job_id"))), ("other document", found & ~F.col("document_id").eqNullSafe(F.col("_document_id"))),
        ("state", found & ~F.coalesce(allowed, no)), ("other actor", found & personal & ~F.coalesce(F.col("actor") == F.col("_actor"), no)), ("other action", found & F.col("_verbs").isNotNull() & ~F.coalesce(F.array_contains("_verbs", F.col("action")), no)))
    return j.select("event_id", F.concat_ws("; ", bad).alias("violations")).filter("violations <> ''")


def dedupe_by_content(df: DataFrame, column: str, key: str) -> tuple[DataFrame, DataFrame]:
    """One object for each content with its size, uses and first user; and each row's reference, new
    where it is the first."""
    hashed = df.select(key, F.col(column).alias("content"), F.sha2(column, 256).alias("sha"))
    objects = hashed.groupBy("sha").agg(F.min(key).alias("first_key"), F.count(key).alias("uses"), F.first(F.octet_length("content")).alias("size"))
    refs = hashed.select(key, "sha").join(objects.select("sha", "first_key"), "sha").select(key, "sha", (F.col(key) == F.col("first_key")).alias("is_new"))
    return objects, refs


def orphan_objects(objects: DataFrame, refs: DataFrame) -> DataFrame:
    return objects.join(refs, "sha", "left_anti")


def verify_hashes(jobs: DataFrame, objects: DataFrame) -> DataFrame:
    """Each job's recorded hash against its stored object."""
    o = objects.select("object_id", F.sha2("content", 256).alias("found"), F.lit(True).alias("there"), F.col("content").isNull().alias("empty"))
    j = jobs.join(o, "object_id", "left")
    status = F.when(F.col("recorded").isNull(), "not recorded").when(F.col("there").isNull(), "missing").when(F.col("empty"), "missing content").when(F.col("found") == F.col("recorded"), "match").otherwise("mismatch")
    return j.select("job_id", status.alias("hash_status"))


def check_payloads(events: DataFrame, payload: str, fields: dict[str, tuple[str, ...]]) -> DataFrame:
    """Events whose JSON payload names, under any alias of a field, another value than the row."""
    bad = []
    for column, aliases in fields.items():
        differs = [F.get_json_object(payload, f"$.{a}").isNotNull() & ~F.get_json_object(payload, f"$.{a}").eqNullSafe(F.col(column).cast("string")) for a in aliases]
        bad.append((column, reduce(lambda a, b: a | b, differs)))
    return events.select("event_id", F.concat_ws("; ", rules(*bad)).alias("differs")).filter("differs <> ''")


def check_entities(df: DataFrame, key: str, texts: list[str], hashes: list[str], jsons: list[str]) -> DataFrame:
    """Rows with blank texts, malformed hashes, invalid JSON objects or a key that another row has."""
    bad = [(f"{c} is blank", norm(F.coalesce(c, F.lit(""))) == "") for c in texts] + [(f"{c} is no hash", ~F.col(c).rlike(DIGEST)) for c in hashes]
    bad += [(f"{c} is no object", F.try_parse_json(c).isNull() | ~F.trim(c).startswith("{")) for c in jsons] + [(f"{key} repeats", F.count(F.lit(1)).over(Window.partitionBy(key)) > 1)]
    return df.select(key, F.concat_ws("; ", rules(*bad)).alias("violations")).filter("violations <> ''")


def backlog(jobs: DataFrame) -> DataFrame:
    """Queued jobs with their rank in their mode, and whether a heavy one waits for a running one. Jobs are
    dealt out by ranges of (mode, seq, job_id), numbered inside them, and get the numbers of the ranges
    before: a mode with most of the queue is many tasks."""
    running = jobs.filter("status = 'running' AND mode = 'heavy'").select("mode").distinct().withColumn("busy", F.lit(True))
    q = jobs.filter("status = 'queued'").select("mode", "seq", "job_id").repartitionByRange("mode", "seq", "job_id").withColumn("part", F.spark_partition_id())
    q = written(q)
    counts = q.groupBy("mode", "part").agg(F.count("job_id").alias("n"))  # a row a range
    before = F.coalesce(F.sum("n").over(Window.partitionBy("mode").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("mode", "part").orderBy("seq", "job_id"))
    q = q.withColumn("nth", place).join(counts.select("mode", "part", before.alias("before")), ["mode", "part"])
    return q.join(running, "mode", "left").select("job_id", "mode", (F.col("nth") + F.col("before")).alias("place"), F.coalesce("busy", F.lit(False)).alias("blocked"))


def job_view(jobs: DataFrame) -> DataFrame:
    """What a list of jobs shows: label, progress percent, number of warnings."""
    progress = F.when(F.col("status") == "succeeded", 100).when(F.col("status") == "running", F.least(F.lit(95), (100 * F.col("attempts") / F.greatest(F.col("max_attempts"), F.lit(1))).cast("int"))).otherwise(0)
    return jobs.select("job_id", F.initcap("status").alias("label"), progress.alias("progress"), F.size(F.coalesce("warnings", F.array().cast("array<string>"))).alias("n_warnings"))


def event_view(events: DataFrame, payload: str, fields: dict[str, tuple[str, str]], keep: list[str]) -> DataFrame:
    """The few fields that workflow rules read: columns to ``keep``, and of the JSON column ``payload`` each
    named field by its (path, type); what is absent or of another type is null."""
    read = [F.get_json_object(payload, path).try_cast(kind).alias(name) for name, (path, kind) in fields.items()]
    return events.select(*keep, *read)


def check_review_events(e: DataFrame) -> DataFrame:
    """Review events with malformed fields, and the revised text that each stands for.

    A box is absent or whole: four finite numbers, none negative, with an area. An edit has a revised text
    that is not its original; what is needed of a text must not be blank.
    """
    box = [F.col(c) for c in ("x", "y", "w", "h")]
    absent = reduce(lambda a, b: a & b, [c.isNull() for c in box])
    whole = reduce(lambda a, b: a & b, [finite(c) & (c >= 0) for c in box]) & (F.col("w") > 0) & (F.col("h") > 0)
    blank = lambda c: F.coalesce(norm(F.col(c)) == "", F.lit(True))
    edit = F.col("action") == "edit"
    bad = rules(
        ("action", F.coalesce(~F.col("action").isin("edit", "approve", "reject", "needs_fix"), F.lit(True))), ("id", blank("block_id")), ("hash", ~F.coalesce(F.col("hash").rlike(DIGEST), F.lit(False))),
        ("page", F.coalesce(F.col("page") < 1, F.lit(True))), ("box", ~absent & ~F.coalesce(whole, F.lit(False))), ("original text", F.col("original").isNull()),
        ("revised text", edit & blank("revised")), ("unchanged text", edit & F.coalesce(F.col("revised") == F.col("original"), F.lit(False))))
    text = F.when(edit, F.col("revised")).otherwise(F.coalesce("revised", "original"))
    return e.select("event_id", F.concat_ws("; ", bad).alias("violations"), F.md5(text).alias("text_md5"))


def check_decisions(decisions: DataFrame, items: DataFrame, roles: DataFrame) -> DataFrame:
    """Decisions by roles that may not decide, on items that are not open, or too low for high risk."""
    j = decisions.join(items, "item_id", "left").join(roles, "role", "left")
    high = F.col("risk").isin("high", "critical")
    bad = rules(("role", ~F.coalesce("may_decide", F.lit(False))), ("item", F.coalesce(F.col("state") != "open", F.lit(True))), ("high risk needs approval", F.coalesce(high, F.lit(False)) & ~((F.col("decision") == "approve") & F.coalesce("may_approve_high", F.lit(False)))))
    return j.select("decision_id", F.concat_ws("; ", bad).alias("violations")).filter("violations <> ''")


def expire(df: DataFrame, now: Column) -> DataFrame:
    """Rows that are due to go: expires_at is now or earlier."""
    return df.filter(F.col("expires_at") <= now)


def append_versions(requests: DataFrame, attributes: list[str]) -> DataFrame:
    """Requests in order as versions: what a request leaves out carries on from the version before."""
    w = Window.partitionBy("id").orderBy("seq")
    carried = {c: F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)) for c in attributes}
    out = requests.withColumns({"version": F.row_number().over(w), "changed": F.concat_ws(",", *[F.when(F.col(c).isNotNull(), F.lit(c)) for c in attributes])})
    return out.withColumns(carried)
