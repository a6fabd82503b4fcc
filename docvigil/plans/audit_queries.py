"""Queries on jobs, events, audit logs and stored objects."""

from __future__ import annotations

from pyspark.sql import functions as F

from docvigil.operators import audit as A
from docvigil.operators.fixpoint import dealt, new_folder
from docvigil.plans.registry import query, select
from docvigil.plans.views import duck, view, with_views
from docvigil.sources.sinks import read_objects, store_objects


def _sql(spark, sf_dir, views, text):
    return select(spark, sf_dir, f"{with_views('spark', *views)} {text}" if views else text)


@query("s8_scan_events", "SELECT event_id, user_id AS job_id, event_type AS action FROM events WHERE user_id = 8 AND event_type = 'click'")
def s8(spark, sf_dir):
    e = _sql(spark, sf_dir, (), "SELECT event_id, user_id AS job_id, event_type AS action FROM events")
    return A.scan_events(e, job_id=8, action="click")


@query("w7_sequence_gaps", duck("log") + ", p AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY seq, event_id) AS place FROM log) SELECT job_id, event_id, seq, place FROM p WHERE seq <> place")
def w7(spark, sf_dir):
    return A.sequence_gaps(view(spark, sf_dir, "log"), ["job_id"])


#: An event's canonical JSON in SQL, as its digest has it.
_CANONICAL = """'{{"action":"' || action || '","actor":' || {actor} || ',"job_id":' || job_id || ',"previous_hash":"' || {previous} || '","seq":' || seq || '}}'"""


def _sealed(spark, sf_dir):
    """The log as chains of digests, each job's events in order."""
    log = view(spark, sf_dir, "log").select("job_id", "event_id", F.col("true_seq").alias("seq"), "action", "actor")
    chain = "array<struct<seq:bigint,event_id:bigint,action:string,actor:bigint,previous_hash:string,event_hash:string>>"
    e = F.struct(*[F.col(c).cast("string" if c == "action" else "long").alias(c) for c in ("seq", "event_id", "action", "actor")])

    def link(done, x):
        previous = F.coalesce(F.try_element_at(done, F.lit(-1))["event_hash"], F.lit(""))
        canonical = F.concat(F.lit('{"action":"'), x["action"], F.lit('","actor":'), x["actor"].cast("string"), F.lit(',"job_id":'), F.col("job_id").cast("string"), F.lit(',"previous_hash":"'), previous, F.lit('","seq":'), x["seq"].cast("string"), F.lit("}"))
        return F.concat(done, F.array(F.struct(x["seq"].alias("seq"), x["event_id"].alias("event_id"), x["action"].alias("action"), x["actor"].alias("actor"), previous.alias("previous_hash"), F.sha2(canonical, 256).alias("event_hash"))))

    jobs = log.groupBy("job_id").agg(F.array_sort(F.collect_list(e)).alias("events"))
    return jobs.select("job_id", F.explode(F.aggregate("events", F.array().cast(chain), link)).alias("e")).select("job_id", "e.*")


def _tampered(spark, sf_dir):
    """Chains in which events were lost, rewritten and linked elsewhere after they were sealed."""
    n = F.col("event_id")
    return _sealed(spark, sf_dir).filter(n % 151 != 5).withColumns({"actor": F.when(n % 73 == 1, F.col("actor") + 100).otherwise(F.col("actor")), "previous_hash": F.when(n % 109 == 7, F.lit("elsewhere")).otherwise(F.col("previous_hash"))})


_CHAIN = duck("log").replace("WITH ", "WITH RECURSIVE ", 1) + f""", o AS (SELECT job_id, event_id, true_seq AS seq, action, actor FROM log),
    c AS (SELECT job_id, event_id, seq, action, actor, '' AS previous_hash, sha256({_CANONICAL.format(actor="actor", previous="''")}) AS event_hash FROM o WHERE seq = 1
    UNION ALL SELECT o.job_id, o.event_id, o.seq, o.action, o.actor, c.event_hash, sha256({_CANONICAL.format(actor="o.actor", previous="c.event_hash").replace("action ||", "o.action ||").replace("|| job_id", "|| o.job_id").replace("|| seq", "|| o.seq")}) FROM c JOIN o ON o.job_id = c.job_id AND o.seq = c.seq + 1),
    t AS (SELECT job_id, event_id, seq, action, CASE WHEN event_id % 73 = 1 THEN actor + 100 ELSE actor END AS actor, CASE WHEN event_id % 109 = 7 THEN 'elsewhere' ELSE previous_hash END AS previous_hash, event_hash FROM c WHERE event_id % 151 <> 5)"""


@query("w8_verify_chain", _CHAIN + f""", j AS (SELECT t.*, b.event_hash AS before FROM t LEFT JOIN t b ON b.job_id = t.job_id AND b.seq = t.seq - 1),
    v AS (SELECT job_id, seq, concat_ws('; ', CASE WHEN seq > 1 AND before IS NULL THEN 'sequence gap' END, CASE WHEN CASE WHEN seq = 1 THEN previous_hash <> '' ELSE before <> previous_hash END THEN 'broken link' END, CASE WHEN event_hash <> sha256({_CANONICAL.format(actor="actor", previous="previous_hash")}) THEN 'content changed' END) AS violations FROM j) SELECT * FROM v WHERE violations <> ''""")
def w8(spark, sf_dir):
    return A.verify_chain(_tampered(spark, sf_dir), ["job_id"], ["job_id", "seq", "action", "actor"])


@query("w8_content_changed", _CHAIN + f""" SELECT count(CASE WHEN event_id % 73 = 1 OR event_id % 109 = 7 THEN 1 END) AS altered, count(CASE WHEN event_hash <> sha256({_CANONICAL.format(actor="actor", previous="previous_hash")}) THEN 1 END) AS found FROM t""")
def w8b(spark, sf_dir):
    t = _tampered(spark, sf_dir)
    found = A.verify_chain(t, ["job_id"], ["job_id", "seq", "action", "actor"]).filter("contains(violations, 'content changed')")
    return t.agg(F.count_if(F.expr("event_id % 73 = 1 OR event_id % 109 = 7")).alias("altered")).crossJoin(found.agg(F.count("seq").alias("found")))


@query("w8_chain_heads", duck("log") + ", h AS (SELECT job_id, arg_max(event_id, true_seq) AS e, max(true_seq) AS n FROM log GROUP BY job_id) SELECT job_id, CASE WHEN job_id % 9 = 0 THEN n + 1 ELSE n END AS length, n AS found_length FROM h WHERE job_id % 9 = 0 OR job_id % 10 = 0")
def w8c(spark, sf_dir):
    e = view(spark, sf_dir, "log").select("job_id", F.col("true_seq").alias("seq"), F.col("event_id").cast("string").alias("event_hash"))
    heads = e.groupBy("job_id").agg(F.max_by("event_hash", "seq").alias("head_hash"), F.max("seq").alias("length"))
    checkpoint = heads.withColumns({"length": F.when(F.col("job_id") % 9 == 0, F.col("length") + 1).otherwise(F.col("length")), "head_hash": F.when(F.col("job_id") % 10 == 0, F.lit("x")).otherwise(F.col("head_hash"))})
    return A.chain_heads(e, ["job_id"], checkpoint)


@query("j18_missing_refs", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 7 <> 0)")
def j18(spark, sf_dir):
    o, c = (_sql(spark, sf_dir, (), q) for q in ("SELECT o_orderkey, o_custkey FROM orders", "SELECT c_custkey FROM customer WHERE c_custkey % 7 <> 0"))
    return A.missing_refs(o, c, {"o_custkey": "c_custkey"})


@query("j19_fk_violations", """SELECT 'jobs' AS child, 'documents' AS parent, 'document_id' AS keys, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 11 <> 0)
    UNION ALL SELECT 'artifacts', 'jobs', 'job_id,document_id', count(*) FROM (SELECT l_orderkey, CASE WHEN l_partkey % 13 = 0 THEN -1 ELSE coalesce(o_custkey, -2) END AS d FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey) a WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = a.l_orderkey AND o_custkey = a.d)""")
def j19(spark, sf_dir):
    entities = {
        "documents": _sql(spark, sf_dir, (), "SELECT c_custkey AS document_id FROM customer WHERE c_custkey % 11 <> 0"),
        "jobs": _sql(spark, sf_dir, (), "SELECT o_orderkey AS job_id, o_custkey AS document_id FROM orders"),
        "artifacts": _sql(spark, sf_dir, (), "SELECT l_orderkey AS job_id, CASE WHEN l_partkey % 13 = 0 THEN -1 ELSE coalesce(o_custkey, -2) END AS document_id FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey"),
    }
    return A.fk_violations(entities, [("jobs", "documents", {"document_id": "document_id"}), ("artifacts", "jobs", {"job_id": "job_id", "document_id": "document_id"})])


_TARGETS = "SELECT DISTINCT user_id AS job_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_type END AS action FROM events WHERE user_id % 5 <> 0"
_BOUND = "SELECT event_id, user_id AS job_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_type END AS action FROM events"


@query("j20_match_targets", f"SELECT e.event_id, t.ok IS NOT NULL AS registered FROM ({_BOUND}) e LEFT JOIN (SELECT *, true AS ok FROM ({_TARGETS})) t ON e.job_id IS NOT DISTINCT FROM t.job_id AND e.action IS NOT DISTINCT FROM t.action")
def j20(spark, sf_dir):
    return A.match_targets(_sql(spark, sf_dir, (), _BOUND), _sql(spark, sf_dir, (), _TARGETS), ["job_id", "action"]).select("event_id", "registered")


@query("j21_job_context", "SELECT o_orderkey AS job_id, o_custkey AS document_id, o_orderstatus AS status, c_name AS title FROM orders JOIN customer ON o_custkey = c_custkey")
def j21(spark, sf_dir):
    return A.job_context(_sql(spark, sf_dir, (), "SELECT o_orderkey AS job_id, o_custkey AS document_id, o_orderstatus AS status FROM orders"), _sql(spark, sf_dir, (), "SELECT c_custkey AS document_id, c_name AS title FROM customer"))


#: Review threads: events of users as edits, requests and approvals of blocks.
_THREADS = """SELECT user_id, event_id % 3 AS block, event_id AS seq, CASE WHEN event_id % 23 <> 0 THEN CAST(event_id % 4 AS STRING) END AS actor, CASE event_id % 5 WHEN 0 THEN 'edit' WHEN 1 THEN 'needs_fix' WHEN 2 THEN 'approve' WHEN 3 THEN 'approve' ELSE 'edit' END AS action,
    CAST(event_id % 7 % 2 AS STRING) AS text, CAST(event_id % 2 AS STRING) AS original, CASE event_id % 11 WHEN 0 THEN NULL WHEN 1 THEN 'k2' WHEN 2 THEN 'k3' ELSE 'k1' END AS conversion, CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 13 = 1 THEN 's2' ELSE 's1' END AS source FROM events"""


@query("j22_approval_check", f"""WITH e AS ({_THREADS}), j AS (SELECT a.user_id, a.block, a.seq, a.text, a.original, p.seq AS ps, p.action = 'edit' AND p.actor IS NOT NULL AS ed, p.action = 'needs_fix' AS nf, coalesce(a.conversion <> p.conversion, false) AS oth, coalesce(a.conversion = p.conversion, false) AS con, coalesce(a.actor = p.actor, false) AS mine, p.text AS pt
    FROM e a LEFT JOIN e p ON a.user_id = p.user_id AND a.block = p.block AND p.seq < a.seq AND p.action <> 'approve' AND NOT coalesce(a.source <> p.source, false) WHERE a.action = 'approve'),
    g AS (SELECT user_id, block, seq, text, original, max(CASE WHEN ed AND NOT oth THEN ps END) AS last, arg_max(pt, ps) FILTER (WHERE ed AND NOT oth) AS latest, max(CASE WHEN nf AND NOT oth THEN ps END) AS fix, coalesce(bool_or(ed AND NOT oth AND mine), false) AS same, coalesce(bool_or(ed AND con), false) AS matched, coalesce(bool_or(ed AND oth AND pt = text), false) AS far, coalesce(bool_or(ed AND oth AND pt = text AND mine), false) AS fs FROM j GROUP BY ALL)
    SELECT user_id, block, seq, concat_ws('; ', CASE WHEN fix > coalesce(last, 0) THEN 'needs fix' END, CASE WHEN same OR (NOT matched AND far AND fs) THEN 'same actor' END, CASE WHEN last IS NULL AND NOT (NOT matched AND far) THEN 'no edit' END, CASE WHEN text <> CASE WHEN last IS NOT NULL THEN latest ELSE original END OR (NOT matched AND far AND text <> original) THEN 'stale text' END) AS against FROM g""")
def j22(spark, sf_dir):
    return A.approval_check(_sql(spark, sf_dir, (), _THREADS), ["user_id", "block"])


_CONTRACT_EVENTS = "SELECT event_id, user_id AS job_id, event_type AS action, CASE WHEN event_id % 27 = 0 THEN 'other' ELSE 'lifecycle' END AS event_type, user_id % 7 AS actor, CASE WHEN event_id % 5 = 0 THEN 'document' ELSE 'job' END AS scope FROM events"
_JOBS = "SELECT DISTINCT user_id AS job_id, CASE WHEN user_id % 9 = 0 THEN 'failed' ELSE 'running' END AS status, CASE WHEN user_id % 4 = 0 THEN 'failed' WHEN user_id % 4 <> 1 THEN 'succeeded' END AS result_status, user_id % 6 AS uploader, user_id % 5 % 3 AS attempts FROM events"


@query("j27_check_contract", f"""WITH e AS ({_CONTRACT_EVENTS}), j AS ({_JOBS}), v AS (SELECT event_id, concat_ws('; ', CASE WHEN action NOT IN ('click', 'view', 'purchase', 'pay', 'signup') THEN 'unknown action' END, CASE WHEN action IN ('click', 'purchase') AND scope <> 'job' THEN 'scope' END, CASE WHEN action IN ('click', 'signup') AND event_type <> 'lifecycle' THEN 'event type' END, CASE WHEN action IN ('click', 'purchase') AND status <> 'running' THEN 'job status' END,
    CASE WHEN action = 'view' AND coalesce(result_status, '') <> 'succeeded' THEN 'result status' END, CASE WHEN action IN ('purchase', 'signup') AND actor <> uploader THEN 'uploader' END, CASE WHEN action = 'signup' AND attempts <> 0 THEN 'attempted job' END) AS violations FROM e JOIN j USING (job_id)) SELECT * FROM v WHERE violations <> ''""")
def j27(spark, sf_dir):
    rows = [
        ("click", [], ["job"], ["lifecycle"], ["running"], None, False, False), ("view", [], ["job", "document"], None, ["running", "failed"], ["succeeded"], False, None),
        ("pay", ["purchase"], ["job"], None, ["running"], None, True, False), ("signup", [], None, ["lifecycle"], None, None, True, True)]
    contracts = spark.createDataFrame(rows, "action string, aliases array<string>, scopes array<string>, event_types array<string>, statuses array<string>, result_statuses array<string>, uploader boolean, unattempted boolean")
    return A.check_contract(_sql(spark, sf_dir, (), _CONTRACT_EVENTS), contracts, _sql(spark, sf_dir, (), _JOBS))


#: Downloads of orders: some declare a hash and a name, some stand for one line, and what they recorded.
_DOWNLOADS = """SELECT o_orderkey AS event_id, o_orderkey AS job_id, o_custkey AS document_id, CASE WHEN o_orderkey % 7 = 0 THEN 'short' WHEN o_orderkey % 3 <> 0 THEN LPAD(CAST(o_orderkey % 50 AS STRING), 64, '0') END AS sha, CASE WHEN o_orderkey % 3 = 1 THEN 'n1' WHEN o_orderkey % 3 = 2 THEN 'n0' END AS name,
    CASE WHEN o_orderkey % 10 = 0 THEN 'none' WHEN o_orderkey % 10 = 5 THEN 'one' WHEN o_orderkey % 10 = 6 THEN 'odd' END AS demand FROM orders"""
_ARTIFACTS = "SELECT l_orderkey AS job_id, o_custkey AS document_id, LPAD(CAST(l_orderkey % 50 + CASE WHEN l_partkey % 5 = 0 THEN 1 ELSE 0 END AS STRING), 64, '0') AS sha, CONCAT('n', CAST(l_linenumber % 3 AS STRING)) AS name, l_orderkey * 10 + l_linenumber AS artifact_id FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_suppkey % 4 <> 0"
#: Ids that were recorded: a job's lines but one in six, and for every ninth job a line of the next.
_RECORDED = "SELECT l_orderkey AS event_id, l_orderkey * 10 + l_linenumber + CASE WHEN l_orderkey % 9 = 0 AND l_linenumber = 1 THEN 10 ELSE 0 END AS artifact_id FROM lineitem WHERE l_partkey % 6 <> 0"


@query("j28_download_evidence", f"""WITH e AS ({_DOWNLOADS}), a AS (SELECT DISTINCT * FROM ({_ARTIFACTS})), n AS (SELECT DISTINCT * FROM ({_RECORDED})), f AS (SELECT *, sha IS NOT NULL OR name IS NOT NULL AS declared, coalesce(regexp_matches(sha, '^[0-9a-f]{{64}}$') AND trim(name) <> '', false) AS formed FROM e),
    own AS (SELECT event_id, artifact_id, bool_or(NOT declared OR coalesce(formed AND f.sha = a.sha AND f.name = a.name, false)) AS hit FROM f JOIN a ON a.job_id = f.job_id AND a.document_id = f.document_id GROUP BY ALL),
    asked AS (SELECT event_id, event_id * 10 + CASE WHEN demand = 'one' THEN 1 ELSE 9 END AS artifact_id FROM e WHERE demand IN ('one', 'odd')),
    sel AS (SELECT event_id, artifact_id FROM own JOIN e USING (event_id) WHERE hit AND demand IS NULL UNION ALL SELECT * FROM asked),
    g AS (SELECT f.*, (SELECT count(*) FROM own o WHERE o.event_id = f.event_id) AS n_own, (SELECT count(*) FROM own o WHERE o.event_id = f.event_id AND hit) AS n_match, (SELECT count(*) FROM sel s WHERE s.event_id = f.event_id) AS evidence, (SELECT min(artifact_id) FROM sel s WHERE s.event_id = f.event_id) AS artifact_id,
        (SELECT count(*) FROM asked s WHERE s.event_id = f.event_id AND NOT EXISTS (SELECT 1 FROM own o WHERE o.event_id = s.event_id AND o.artifact_id = s.artifact_id AND hit)) AS astray,
        (SELECT count(*) FROM sel s WHERE s.event_id = f.event_id AND NOT EXISTS (SELECT 1 FROM n WHERE n.event_id = s.event_id AND n.artifact_id = s.artifact_id)) AS missing,
        (SELECT count(*) FROM n JOIN own o ON o.event_id = n.event_id AND o.artifact_id = n.artifact_id WHERE n.event_id = f.event_id AND NOT EXISTS (SELECT 1 FROM sel s WHERE s.event_id = n.event_id AND s.artifact_id = n.artifact_id)) AS surplus,
        (SELECT count(*) FROM n WHERE n.event_id = f.event_id AND NOT EXISTS (SELECT 1 FROM own o WHERE o.event_id = n.event_id AND o.artifact_id = n.artifact_id)) AS alien FROM f)
    SELECT event_id, evidence, artifact_id, concat_ws('; ', CASE WHEN n_own = 0 THEN 'no artifact' END, CASE WHEN declared AND NOT formed THEN 'malformed declaration' END, CASE WHEN n_own > 0 AND n_match = 0 THEN 'no match' END, CASE WHEN demand IS NOT NULL AND (demand = 'none' OR astray > 0) THEN 'required ids do not match' END, CASE WHEN missing > 0 THEN 'missing' END, CASE WHEN surplus > 0 THEN 'surplus' END, CASE WHEN alien > 0 THEN 'foreign' END) AS verdict FROM g""")
def j28(spark, sf_dir):
    n = _sql(spark, sf_dir, (), "SELECT l_orderkey FROM lineitem").count()
    recorded = dealt(_sql(spark, sf_dir, (), _RECORDED), "event_id", rows=n).groupBy("event_id").agg(F.collect_set("artifact_id").alias("recorded"))
    events = dealt(_sql(spark, sf_dir, (), _DOWNLOADS), "event_id", rows=n).join(recorded, "event_id", "left")
    part = F.when(F.col("demand") == "none", F.array().cast("array<bigint>")).when(F.col("demand") == "one", F.array(F.col("event_id") * 10 + 1)).when(F.col("demand") == "odd", F.array(F.col("event_id") * 10 + 9))
    return A.download_evidence(events.withColumn("required", part), _sql(spark, sf_dir, (), _ARTIFACTS), n)


_SCOPED = """SELECT event_id, user_id AS job_id, user_id AS document_id, event_type AS action, event_id % 4 AS actor, CASE event_id % 3 WHEN 0 THEN 'job' WHEN 1 THEN 'document' ELSE 'decision' END AS scope_type,
    CASE WHEN event_id % 101 = 0 THEN -1 WHEN event_id % 53 = 0 THEN (user_id + 1) % 150 ELSE user_id END AS scope_id FROM events"""
_USERS = "(SELECT DISTINCT user_id FROM events)"
_ENTITIES = f"""SELECT 'job' AS scope_type, user_id AS scope_id, user_id AS job_id, user_id AS document_id, CASE WHEN user_id % 8 = 0 THEN 'failed' ELSE 'running' END AS status, user_id % 4 AS actor, CAST(NULL AS STRING) AS verb FROM {_USERS} a
    UNION ALL SELECT 'document', user_id, CAST(NULL AS BIGINT), CASE WHEN user_id % 31 = 0 THEN 0 ELSE user_id END, 'stored', user_id % 4, CAST(NULL AS STRING) FROM {_USERS} b UNION ALL SELECT 'decision', user_id, user_id, user_id, 'stored', user_id % 3, CASE WHEN user_id % 2 = 0 THEN 'click' ELSE 'view' END FROM {_USERS} c"""


@query("j34_resolve_scope", f"""WITH e AS ({_SCOPED}), n AS ({_ENTITIES}), j AS (SELECT e.*, n.scope_id IS NOT NULL AS found, n.job_id AS j, n.document_id AS d, n.status, n.actor AS a, n.verb FROM e LEFT JOIN n ON e.scope_type = n.scope_type AND e.scope_id = n.scope_id), v AS (SELECT event_id, concat_ws('; ', CASE WHEN NOT found THEN 'no such entity' END, CASE WHEN j <> job_id THEN 'other job' END, CASE WHEN d <> document_id THEN 'other document' END,
    CASE WHEN found AND action = 'purchase' AND status NOT IN ('running', 'stored') THEN 'state' END, CASE WHEN (action = 'signup' OR scope_type = 'decision') AND a <> actor THEN 'other actor' END, CASE WHEN verb <> action THEN 'other action' END) AS violations FROM j) SELECT * FROM v WHERE violations <> ''""")
def j34(spark, sf_dir):
    entities = _sql(spark, sf_dir, (), _ENTITIES).withColumn("verbs", F.when(F.col("verb").isNotNull(), F.array("verb")))
    return A.resolve_scope(_sql(spark, sf_dir, (), _SCOPED), entities, {"purchase": ["running", "stored"]}, ["signup"], ["decision"])


@query("s11_objects", "SELECT sha256(text) AS sha, min(doc_id) AS first_key, count(*) AS uses, CAST(first(strlen(text)) AS INT) AS size FROM documents GROUP BY 1")
def s11(spark, sf_dir):
    return A.dedupe_by_content(_sql(spark, sf_dir, (), "SELECT doc_id, text FROM documents"), "text", "doc_id")[0]


@query("s11_references", "SELECT doc_id, sha256(text) AS sha, doc_id = min(doc_id) OVER (PARTITION BY text) AS is_new FROM documents")
def s11b(spark, sf_dir):
    return A.dedupe_by_content(_sql(spark, sf_dir, (), "SELECT doc_id, text FROM documents"), "text", "doc_id")[1]


@query("s11_store", "SELECT sha256(text) AS sha, CAST(max(strlen(text)) AS BIGINT) AS size, NOT bool_or(doc_id % 3 <> 0) AS created, true AS valid FROM documents WHERE text IS NOT NULL GROUP BY 1")
def s11_store(spark, sf_dir):
    """Texts of two documents in three are stored, then all: the second call adds the rest. Read back and verified."""
    d = _sql(spark, sf_dir, (), "SELECT doc_id, text FROM documents")
    folder = new_folder(spark, "store")
    store_objects(d.filter("doc_id % 3 <> 0"), "text", folder)
    second = store_objects(d, "text", folder)
    return second.join(read_objects(spark, folder).select("sha", "valid"), "sha")


@query("j35_orphan_objects", "SELECT sha256(text) AS sha FROM documents EXCEPT SELECT sha256(text) FROM documents WHERE doc_id % 3 <> 0")
def j35(spark, sf_dir):
    d = _sql(spark, sf_dir, (), "SELECT doc_id, text FROM documents")
    objects = A.dedupe_by_content(d, "text", "doc_id")[0].select("sha")
    return A.orphan_objects(objects, A.dedupe_by_content(d.filter("doc_id % 3 <> 0"), "text", "doc_id")[1])


@query("d18_verify_hashes", "SELECT doc_id AS job_id, CASE WHEN doc_id % 7 = 0 THEN 'not recorded' WHEN doc_id % 11 = 0 THEN 'missing' WHEN doc_id % 13 = 0 THEN 'missing content' WHEN doc_id % 5 = 0 THEN 'mismatch' ELSE 'match' END AS hash_status FROM documents")
def d18(spark, sf_dir):
    d = _sql(spark, sf_dir, (), "SELECT doc_id, text FROM documents")
    jobs = d.select(F.col("doc_id").alias("job_id"), F.col("doc_id").alias("object_id"), F.when(F.col("doc_id") % 7 != 0, F.sha2(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text")), 256)).alias("recorded"))
    objects = d.filter("doc_id % 11 <> 0").select(F.col("doc_id").alias("object_id"), F.when(F.col("doc_id") % 13 != 0, F.col("text")).alias("content"))
    return A.verify_hashes(jobs, objects)


_PAYLOADS = """SELECT event_id, user_id, event_type, CONCAT('{"user":', CAST(CASE WHEN event_id % 31 = 0 THEN user_id + 1 ELSE user_id END AS STRING), ',"type":"', CASE WHEN event_id % 41 = 0 THEN 'other' ELSE event_type END, '"}') AS payload FROM events"""


@query("d14_check_payloads", f"SELECT event_id, concat_ws('; ', CASE WHEN event_id % 31 = 0 THEN 'user_id' END, CASE WHEN event_id % 41 = 0 THEN 'event_type' END) AS differs FROM ({_PAYLOADS}) WHERE event_id % 31 = 0 OR event_id % 41 = 0")
def d14(spark, sf_dir):
    return A.check_payloads(_sql(spark, sf_dir, (), _PAYLOADS), "payload", {"user_id": ("user", "user_id"), "event_type": ("type",)})


_ROWS = """SELECT event_id % 9990 AS id, CASE WHEN event_id % 67 = 0 THEN '  ' ELSE event_type END AS name, CASE WHEN event_id % 59 = 0 THEN 'abc' ELSE sha256(CAST(event_id AS STRING)) END AS hash, CASE WHEN event_id % 83 = 0 THEN '{bad' WHEN event_id % 89 = 0 THEN '[1]' ELSE props END AS body FROM events"""


@query("d11_check_entities", f"""WITH r AS ({_ROWS}), v AS (SELECT id, concat_ws('; ', CASE WHEN trim(name) = '' THEN 'name is blank' END, CASE WHEN NOT regexp_matches(hash, '^[0-9a-f]{{64}}$') THEN 'hash is no hash' END, CASE WHEN NOT coalesce(json_valid(body), false) OR body NOT LIKE '{{%' THEN 'body is no object' END, CASE WHEN count(*) OVER (PARTITION BY id) > 1 THEN 'id repeats' END) AS violations FROM r) SELECT * FROM v WHERE violations <> ''""")
def d11(spark, sf_dir):
    rows = _sql(spark, sf_dir, (), _ROWS.replace("sha256(CAST(event_id AS STRING))", "sha2(CAST(event_id AS STRING), 256)"))
    return A.check_entities(rows, "id", ["name"], ["hash"], ["body"])


_QUEUE = "SELECT o_orderkey AS job_id, o_orderdate AS seq, CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'F' THEN 'running' ELSE 'succeeded' END AS status, CASE WHEN o_orderkey % 3 = 0 THEN 'heavy' ELSE 'light' END AS mode, CAST(o_orderkey % 4 AS INT) AS attempts, 4 AS max_attempts FROM orders"


@query("t5_backlog", f"SELECT job_id, mode, row_number() OVER (PARTITION BY mode ORDER BY seq, job_id) AS place, mode = 'heavy' AS blocked FROM ({_QUEUE}) WHERE status = 'queued'")
def t5(spark, sf_dir):
    return A.backlog(_sql(spark, sf_dir, (), _QUEUE))


@query("p16_job_view", f"SELECT job_id, upper(status[1]) || status[2:] AS label, CAST(CASE status WHEN 'succeeded' THEN 100 WHEN 'running' THEN least(95, 100 * attempts / max_attempts) ELSE 0 END AS INT) AS progress, CAST(job_id % 3 AS INT) AS n_warnings FROM ({_QUEUE})")
def p16(spark, sf_dir):
    j = _sql(spark, sf_dir, (), _QUEUE).withColumn("warnings", F.when(F.col("job_id") % 3 > 0, F.array_repeat(F.lit("w"), (F.col("job_id") % 3).cast("int"))))
    return A.job_view(j)


@query("p19_event_view", duck("log") + " SELECT event_id, job_id, action, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, date_trunc('second', ts) AS at FROM log")
def p19(spark, sf_dir):
    log = view(spark, sf_dir, "log").withColumn("at", F.date_trunc("second", "ts"))
    return A.event_view(log, "props", {"k": ("$.k", "long")}, ["event_id", "job_id", "action", "at"])


_REVIEWS = "SELECT conv_id, conv_id * 100 + turn AS event_id, CASE WHEN turn = 5 THEN 'shout' WHEN turn % 2 = 0 THEN 'edit' ELSE 'approve' END AS action, CASE WHEN conv_id % 9 = 0 THEN ' ' ELSE CAST(conv_id AS STRING) END AS block_id, CASE WHEN conv_id % 8 = 0 THEN 'x' ELSE '{0}' END AS hash, CAST(turn % 4 AS INT) AS page, CASE WHEN turn = 2 THEN NULL WHEN turn = 3 THEN NULL WHEN turn = 4 AND conv_id % 7 = 0 THEN text ELSE CONCAT(text, '!') END AS revised, text AS original, CAST(CASE WHEN conv_id % 3 <> 0 THEN turn END AS DOUBLE) AS x, CAST(CASE WHEN conv_id % 3 <> 0 THEN 5 END AS DOUBLE) AS y, CAST(CASE WHEN conv_id % 12 = 1 THEN 0 WHEN conv_id % 3 <> 0 THEN 2 END AS DOUBLE) AS w, CAST(CASE WHEN conv_id % 12 = 2 THEN NULL WHEN conv_id % 3 <> 0 THEN 1 END AS DOUBLE) AS h FROM conversations".format("a" * 64)


@query("d21_check_review_events", f"""SELECT event_id, concat_ws('; ', CASE WHEN action = 'shout' THEN 'action' END, CASE WHEN trim(block_id) = '' THEN 'id' END, CASE WHEN hash = 'x' THEN 'hash' END, CASE WHEN page < 1 THEN 'page' END, CASE WHEN conv_id % 12 IN (1, 2) THEN 'box' END, CASE WHEN original IS NULL THEN 'original text' END, CASE WHEN action = 'edit' AND coalesce(trim(revised), '') = '' THEN 'revised text' END, CASE WHEN action = 'edit' AND revised = original THEN 'unchanged text' END) AS violations,
    md5(CASE WHEN action = 'edit' THEN revised ELSE coalesce(revised, original) END) AS text_md5 FROM ({_REVIEWS})""")
def d21(spark, sf_dir):
    return A.check_review_events(_sql(spark, sf_dir, (), _REVIEWS))


_DECISIONS = "SELECT conv_id * 100 + turn AS decision_id, conv_id AS item_id, CASE WHEN turn % 3 = 0 THEN 'viewer' WHEN turn % 3 = 1 THEN 'reviewer' ELSE 'approver' END AS role, CASE WHEN turn % 2 = 0 THEN 'approve' ELSE 'reject' END AS decision FROM conversations"
_OPEN = "SELECT DISTINCT conv_id AS item_id, CASE WHEN conv_id % 6 = 0 THEN 'closed' ELSE 'open' END AS state, CASE WHEN conv_id % 4 = 0 THEN 'high' ELSE 'low' END AS risk FROM conversations WHERE conv_id % 10 <> 0"


@query("d12_check_decisions", f"""WITH v AS (SELECT decision_id, concat_ws('; ', CASE WHEN role = 'viewer' THEN 'role' END, CASE WHEN coalesce(state, '') <> 'open' THEN 'item' END, CASE WHEN risk = 'high' AND NOT (decision = 'approve' AND role = 'approver') THEN 'high risk needs approval' END) AS violations FROM ({_DECISIONS}) LEFT JOIN ({_OPEN}) USING (item_id)) SELECT * FROM v WHERE violations <> ''""")
def d12(spark, sf_dir):
    roles = spark.createDataFrame([("reviewer", True, False), ("approver", True, True), ("admin", True, True), ("viewer", False, False)], "role string, may_decide boolean, may_approve_high boolean")
    return A.check_decisions(_sql(spark, sf_dir, (), _DECISIONS), _sql(spark, sf_dir, (), _OPEN), roles)


@query("x6_expire", "SELECT event_id, ts + INTERVAL '10' DAY AS expires_at FROM events WHERE ts + INTERVAL '10' DAY <= TIMESTAMP '2024-01-20 00:00:00'")
def x6(spark, sf_dir):
    e = _sql(spark, sf_dir, (), "SELECT event_id, ts + INTERVAL '10' DAY AS expires_at FROM events")
    return A.expire(e, F.lit("2024-01-20 00:00:00").cast("timestamp"))


_REQUESTS = "SELECT user_id AS id, event_id AS seq, CASE WHEN event_id % 3 = 0 THEN event_type END AS title, CASE WHEN event_id % 4 = 0 THEN CAST(floor(value) AS BIGINT) END AS size FROM events"


@query("w17_append_versions", f"""SELECT id, seq, last_value(title IGNORE NULLS) OVER w AS title, last_value(size IGNORE NULLS) OVER w AS size, row_number() OVER w AS version, concat_ws(',', CASE WHEN title IS NOT NULL THEN 'title' END, CASE WHEN size IS NOT NULL THEN 'size' END) AS changed
    FROM ({_REQUESTS}) WINDOW w AS (PARTITION BY id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def w17(spark, sf_dir):
    return A.append_versions(_sql(spark, sf_dir, (), _REQUESTS), ["title", "size"])
