"""Streams of events: idempotent ingest, conflicts, job states, hash chains, review rules, queues.

A key's state is held by stateful processors (``transformWithState``, row by row: no frame is built for a key): values, lists and maps in RocksDB,
so that an entry of a map is read and written alone and what a key holds need not fit into a batch's memory. The
rows of a key inside one micro-batch are handled in (ts, event_id) order; across batches, in order of arrival.
A micro-batch's rows of a key are held at once; the source's limits on a batch bound them.

State stays for ever unless ``horizon`` or ``ttl`` is given: exactness is the default. With a horizon (event time)
a timer forgets a key in the first batch after the watermark has passed its last event; with ``ttl``
(milliseconds of processing time) each value is forgotten so long after it was last written; such a stream
goes on in empty batches until it is stopped, so it is not for ``drain``. ``initial``, a batch
table of keys with their state, is what the first batch starts from.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from docvigil.operators.fixpoint import new_folder

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
#: The time of a row in microseconds, by which a key's rows are ordered.
AT = "_at"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_table(spark: SparkSession, sf_dir: str, name: str, schema: str) -> DataFrame:
    """A given table as a stream of its files; the pattern finds a file or a folder of that name."""
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


def drain(stream: DataFrame, name: str) -> DataFrame:
    """All rows that a stream yields from what is there now, through a Parquet sink on shared storage."""
    spark = stream.sparkSession
    out = new_folder(spark, name)
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", new_folder(spark, f"{name}-log")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def stream_once(events: DataFrame, keys: list[str], horizon: str | None = None) -> DataFrame:
    """One event of each key, of a batch any. With a horizon, repeats that come later than it pass again."""
    if horizon is None:
        return events.dropDuplicates(keys)
    return events.withWatermark("ts", horizon).dropDuplicatesWithinWatermark(keys)


class KeyedProcessor(StatefulProcessor):
    """A processor whose states are named in ``declare`` and forgotten together by a timer, if ``timed``. It
    yields tuples of the columns ``names``."""

    names: list[str] = []

    def __init__(self, timed: bool, ttl: int | None):
        self.timed, self.ttl = timed, ttl

    def declare(self, handle: StatefulProcessorHandle) -> list:
        """The states of a key."""
        raise NotImplementedError

    def handle(self, rows: list[Row]) -> Iterator[tuple]:
        """What a micro-batch's rows of a key yield, and the states after them."""
        raise NotImplementedError

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.api = handle
        self.states = self.declare(handle)

    def handleInputRows(self, key: object, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        part = sorted(rows, key=lambda r: tuple((v is None, v) for v in (r[AT], r["event_id"])))
        for t in list(self.api.listTimers()) if self.timed else []:
            self.api.deleteTimer(t)
            if t <= timerValues.getCurrentWatermarkInMs():  # due, but rows come before timers
                self.forget()
        as_row = Row(*self.names)
        for r in self.handle(part):
            yield as_row(*r)
        if self.timed:
            self.api.registerTimer(max((part[-1][AT] or 0) // 1000, timerValues.getCurrentWatermarkInMs()) + 1)

    def handleExpiredTimer(self, key: object, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.forget()
        return iter(())

    def forget(self) -> None:
        for state in self.states:
            state.clear()

    def close(self) -> None:
        pass


#: From a key's state and rows to the state after them and what they yield.
Step = Callable[[tuple, list[Row]], tuple[tuple, list[tuple]]]


class ValueProcessor(KeyedProcessor):
    """One value a key, through ``step(state, rows) -> (state, output rows)``."""

    def __init__(self, step: Step, state: str, start: tuple, timed: bool, ttl: int | None):
        super().__init__(timed, ttl)
        self.step, self.state, self.start = step, state, start

    def declare(self, handle: StatefulProcessorHandle) -> list:
        self.held = handle.getValueState("held", self.state, self.ttl)
        return [self.held]

    def handle(self, rows: list[Row]) -> Iterator[tuple]:
        held = self.held.get()
        after, out = self.step(self.start if held is None else tuple(held), rows)
        self.held.update(after)
        yield from out

    def handleInitialState(self, key: object, initialState: Row, timerValues) -> None:
        self.held.update(tuple(initialState[c.split()[0]] for c in self.state.split(", ")))


def _stateful(events: DataFrame, key: str | list[str], processor: KeyedProcessor, output: str, horizon: str | None, initial: DataFrame | None) -> DataFrame:
    keys = [key] if isinstance(key, str) else key
    spark = events.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) != ROCKS:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)  # the only store that holds lists and maps
    if horizon is not None:
        events = events.withWatermark("ts", horizon)
    processor.names = [c.split()[0] for c in output.split(", ")]
    mode = "EventTime" if horizon is not None else "ProcessingTime" if processor.ttl is not None else "None"
    begin = initial.groupBy(*keys) if initial is not None else None
    return events.withColumn(AT, F.unix_micros("ts")).groupBy(*keys).transformWithState(processor, output, "Append", mode, initialState=begin)


def _keyed(events: DataFrame, key: str | list[str], step: Step, output: str, state: str, start: tuple, horizon: str | None = None, ttl: int | None = None, initial: DataFrame | None = None) -> DataFrame:
    """Events by key through ``step``; ``initial`` has the columns of the key and of the state."""
    return _stateful(events, key, ValueProcessor(step, state, start, horizon is not None, ttl), output, horizon, initial)


def stream_record_once(events: DataFrame, keys: list[str], payload: list[str], horizon: str | None = None, ttl: int | None = None, initial: DataFrame | None = None) -> DataFrame:
    """Every request with the event that was recorded for its keys: the first one, with its own
    ``payload`` columns; ``repeated`` says that the request itself was not recorded."""
    fields = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    kept = ["event_id", *payload]

    def step(state: tuple, rows: list[Row]) -> tuple[tuple, list[tuple]]:
        first = state if state[0] is not None else tuple(rows[0][c] for c in kept)
        return first, [(*[r[c] for c in keys], r["event_id"], r["event_id"] != first[0], *first) for r in rows]

    output = ", ".join([*[f"{c} {fields[c]}" for c in keys], "event_id long", "repeated boolean", *[f"first_{c} {fields[c]}" for c in kept]])
    return _keyed(events, keys, step, output, ", ".join(f"{c} {fields[c]}" for c in kept), (None,) * len(kept), horizon, ttl, initial)


def stream_conflicts(requests: DataFrame, key: str, parameter: str, horizon: str | None = None, ttl: int | None = None, initial: DataFrame | None = None) -> DataFrame:
    """Requests that use a key again with other parameters than its first."""

    def step(state: tuple, rows: list[Row]) -> tuple[tuple, list[tuple]]:
        digests = [hashlib.sha256(str(r[parameter]).encode()).hexdigest() for r in rows]
        first = state[0] or digests[0]
        return (first,), [(r[key], r["event_id"]) for r, d in zip(rows, digests) if d != first]

    return _keyed(requests, key, step, f"{key} long, event_id long", "first string", ("",), horizon, ttl, initial)


# The state after an event, by state and action; a failed attempt queues again while attempts remain.
TRANSITIONS = {("new", "submit"): "queued", ("queued", "start"): "running", ("running", "succeed"): "succeeded", ("failed", "retry"): "queued"}


def job_step(status: str, attempts: int, action: str, most: int) -> tuple[str, int, bool]:
    """A job's status and attempts after an action, and whether the action was legal."""
    if status == "running" and action == "fail":
        return ("queued" if attempts < most else "failed"), attempts, True
    after = TRANSITIONS.get((status, action))
    if after is None:
        return status, attempts, False
    if (status, action) == ("failed", "retry"):
        attempts = 0
    return after, attempts + (after == "running"), True


def stream_jobs(events: DataFrame, most: int = 3, horizon: str | None = None, ttl: int | None = None, initial: DataFrame | None = None) -> DataFrame:
    """Each lifecycle event (job_id, action) with the job's status after it; illegal ones change nothing."""

    def step(state: tuple, rows: list[Row]) -> tuple[tuple, list[tuple]]:
        status, attempts = state
        out = []
        for r in rows:
            status, attempts, legal = job_step(status, attempts, r["action"], most)
            out.append((r["job_id"], r["event_id"], r["action"], status, attempts, legal))
        return (status, attempts), out

    return _keyed(events, "job_id", step, "job_id long, event_id long, action string, status string, attempts int, legal boolean", "status string, attempts int", ("new", 0), horizon, ttl, initial)


def stream_chain(events: DataFrame, key: str, horizon: str | None = None, ttl: int | None = None, initial: DataFrame | None = None) -> DataFrame:
    """Events with their number and digest in their key's chain, which ``initial`` (key, seq, head) may begin."""

    def step(state: tuple, rows: list[Row]) -> tuple[tuple, list[tuple]]:
        seq, head = state
        out = []
        for r in rows:
            seq, previous = seq + 1, head
            head = hashlib.sha256(f"{previous}|{seq}|{r['event_id']}|{r['action']}".encode()).hexdigest()
            out.append((r[key], r["event_id"], seq, previous, head))
        return (seq, head), out

    return _keyed(events, key, step, f"{key} long, event_id long, seq long, previous_hash string, event_hash string", "seq long, head string", (0, ""), horizon, ttl, initial)


class ReviewProcessor(KeyedProcessor):
    """A block's review: its latest text, its editors (an entry each), and its open marks (a list)."""

    def declare(self, handle: StatefulProcessorHandle) -> list:
        self.text = handle.getValueState("text", "text string", self.ttl)
        self.editors = handle.getMapState("editors", "actor string", "event_id long", self.ttl)
        self.marks = handle.getListState("marks", "event_id long", self.ttl)
        return [self.text, self.editors, self.marks]

    def __init__(self, key: str, timed: bool, ttl: int | None):
        super().__init__(timed, ttl)
        self.key = key

    def handle(self, rows: list[Row]) -> Iterator[tuple]:
        held = self.text.get()
        edited, text = held is not None, held and held[0]
        marked = self.marks.exists()
        changed, own = False, {}  # who edited, as far as asked or seen here
        for r in rows:
            who, action = r["actor"], r["action"]
            if action == "edit" and who is not None:
                if not own.get(str(who)):
                    self.editors.updateValue((str(who),), (int(r["event_id"]),))
                    own[str(who)] = True
                text, edited, changed = r["hash"], True, True
                if marked:
                    self.marks.clear()
                    marked = False
            elif action == "needs_fix":
                self.marks.appendValue((int(r["event_id"]),))
                marked = True
            elif action == "approve":
                if who is not None and str(who) not in own:
                    own[str(who)] = self.editors.containsKey((str(who),))
                bad = [("needs fix", marked), ("same actor", who is not None and own[str(who)]), ("no edit", not edited), ("stale text", edited and r["hash"] != text)]
                yield r[self.key], r["event_id"], "; ".join(n for n, b in bad if b)
        if changed:
            self.text.update((text,))

    def handleInitialState(self, key: object, initialState: Row, timerValues) -> None:
        if initialState["text"] is not None:
            self.text.update((initialState["text"],))
        for actor in initialState["editors"]:
            self.editors.updateValue((str(actor),), (-1,))
        if initialState["marked"]:
            self.marks.appendValue((-1,))


def stream_reviews(events: DataFrame, key: str, horizon: str | None = None, ttl: int | None = None, initial: DataFrame | None = None) -> DataFrame:
    """Approvals and what stands against each, decided from the key's state alone: its editors, the latest
    text, and whether a needs-fix mark is open. Edits without an actor do not count. ``initial`` has the key,
    ``text``, ``editors`` (a list) and ``marked``."""
    out = _stateful(events, key, ReviewProcessor(key, horizon is not None, ttl), "key long, event_id long, against string", horizon, initial)
    return out.withColumnRenamed("key", key)


def stream_review_queue(blocks: DataFrame, batch: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """New blocks through a batch operator, batch by batch; a repeated batch replaces its own rows."""
    spark = blocks.sparkSession
    out = new_folder(spark, name)

    def write(df: DataFrame, number: int) -> None:
        batch(df).write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = blocks.writeStream.foreachBatch(write).option("checkpointLocation", new_folder(spark, f"{name}-log")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out).drop("batch")


def review_items(documents: DataFrame, blocks: DataFrame, decided: DataFrame) -> DataFrame:
    """Review items of a stream of documents: each meets its blocks, a batch table, in a stream-static join,
    and of the blocks that need review those wait that no decision names.

    ``documents(doc_id, ts, ...)`` a stream, ``blocks(doc_id, block_id, requires_review)``, ``decided(doc_id,
    block_id)``; the result has the documents' columns, ``block_id``, ``requires_review`` and ``waits``.
    """
    done = decided.select("doc_id", "block_id").distinct().withColumn("_done", F.lit(True))
    j = documents.join(blocks.select("doc_id", "block_id", "requires_review"), "doc_id").join(done, ["doc_id", "block_id"], "left")
    return j.withColumn("waits", F.col("requires_review") & F.col("_done").isNull()).drop("_done")


def running_counts(items: DataFrame, by: list[str]) -> DataFrame:
    """A stream's items, those to review, and those that wait, by group so far; run in update mode, a group has a
    row in each batch that changes it. Counts are the engine's own state: a batch that is repeated after a
    failure begins from the state before it."""
    return items.groupBy(*by).agg(F.count("block_id").alias("blocks"), F.count_if("requires_review").alias("to_review"), F.count_if("waits").alias("waiting"))


def keep_latest(counts: DataFrame, by: list[str], name: str, folder: str | None = None) -> DataFrame:
    """Run a stream of counts in update mode to its present end and return each group's latest row.

    Each batch is written under its number, so a batch that runs again replaces what it wrote before and counts
    nothing twice; the last number of a group wins. With a ``folder`` a later call goes on where the last ended.
    """
    spark = counts.sparkSession
    folder = folder or new_folder(spark, name)

    def write(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    query = counts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.parquet(f"{folder}/rows")
    values = [c for c in rows.columns if c not in by and c != "batch"]
    return rows.groupBy(*by).agg(F.max_by(F.struct(*values), "batch").alias("v")).select(*by, "v.*")


def lifecycle(events: DataFrame) -> DataFrame:
    """The given events as lifecycle events of jobs."""
    action = F.create_map(*[F.lit(x) for kv in {"signup": "submit", "view": "start", "click": "succeed", "error": "fail", "purchase": "retry"}.items() for x in kv])
    return events.select("event_id", "ts", F.col("user_id").alias("job_id"), F.coalesce(F.try_element_at(action, F.col("event_type")), F.lit("submit")).alias("action"))
