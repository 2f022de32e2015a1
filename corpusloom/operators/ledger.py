"""The ledger of changes to records, as a fold over its events.

Each record (``path``) has a content and a state machine of its own. Its events are taken in order
of ``at, seq``; a submission is applied, held for review or refused; what is held can be
approved, dismissed or released under new rules; what was applied can be taken back as
long as nothing has changed the record since. Records are dealt over tasks, and a record's
events stream through one in order, so that a task holds the entries of one record at a time.
"""

from __future__ import annotations

from collections import deque
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from corpusloom.sources import shards
from corpusloom.sources.lineage import cut

#: Changes of a record whose earlier text is kept.
KEPT = 50
PARTS = 64

EVENTS = "path string, key string, at timestamp, seq long, op string, plan string, before string, after string, thread string, client string, reason string"
#: One entry of the ledger.
ENTRY = "path string, key string, status string, reason string, at timestamp, seq long, client string, before string, after string, thread string, undo boolean, undone timestamp, written_at timestamp, written_seq long"
#: What is known of a record.
RECORD = "path string, content string, human_edited boolean, not_threads array<string>, last_at timestamp, last_seq long"
_OUTCOME = "key string, at timestamp, seq long, op string, outcome string, reason string"


def _struct(columns: str) -> str:
    return f"struct<{', '.join(x.replace(' ', ':', 1) for x in columns.split(', '))}>"


_ROW = f"kind string, path string, entry {_struct(ENTRY)}, record {_struct(RECORD)}, outcome {_struct(_OUTCOME)}"


def _names(columns: str) -> list[str]:
    return [x.split()[0] for x in columns.split(", ")]


class Entry(NamedTuple):
    """What became of a key. ``undo``: the text to take it back is kept; ``written``: when it got this status."""

    status: str
    reason: str | None
    at: object
    seq: int
    client: str | None
    before: str | None
    after: str | None
    thread: str | None
    undo: bool = False
    undone: object = None
    written: tuple = ()


class Machine:
    """The state of one record."""

    def __init__(self, path: str, kept: int = KEPT):
        self.path, self.kept = path, kept
        self.content: str | None = None
        self.human_edited, self.not_threads = False, []
        self.entries: dict[str, Entry] = {}
        self.undoable: deque[str] = deque()
        self.last = (None, None)

    def _apply(self, key: str, e: Entry, undo: bool = True) -> None:
        self.content = e.after
        self.entries[key] = e._replace(status="applied", undo=undo)
        if undo:
            self.undoable.append(key)
            if len(self.undoable) > self.kept:
                old = self.undoable.popleft()
                self.entries[old] = self.entries[old]._replace(undo=False, before=None, after=None)

    def step(self, event: dict) -> tuple[str, str | None]:
        """Takes one event; ``outcome, reason``."""
        op, key, now = event["op"], event["key"], (event["at"], event["seq"])
        self.last = now
        if op == "edit":
            self.content, self.human_edited = event["after"], True
            return "edited", None
        if not key:
            return "rejected", "no key"
        had = self.entries.get(key)
        if op == "submit":
            if had:
                return "duplicate", had.status
            e = Entry("", event["reason"], *now, event["client"], event["before"], event["after"], event["thread"], written=now)
            if event["plan"] == "apply":
                if self.content != e.before:
                    return "rejected", "conflict"  # doesn't use up the key
                self._apply(key, e)
                return "applied", e.reason
            held = event["plan"] == "review"
            self.entries[key] = e._replace(status="review") if held else e._replace(status="rejected", before=None, after=None)
            return self.entries[key].status, e.reason
        if op == "undo":
            return self._undo(key, had, event["at"])
        if not had or had.status != "review":
            return "rejected", "no such pending review"
        return self._decide(op, key, had, event, now)

    def _decide(self, op: str, key: str, had: Entry, event: dict, now: tuple) -> tuple[str, str | None]:
        e = had._replace(at=event["at"], written=now)
        if op == "dismiss" or (op == "sweep" and event["plan"] == "dismiss"):
            if had.thread and had.thread not in self.not_threads:
                self.not_threads.append(had.thread)  # the record isn't of this thread; that is no edit by hand
            self.entries[key] = e._replace(status="dismissed", reason="dismissed by you", before=None, after=None)
            return "dismissed", "dismissed by you"
        if op == "sweep":  # decided and done elsewhere
            self._apply(key, e._replace(reason="approved by you"), undo=False)
            return "applied", "approved by you"
        if op == "recheck" and event["plan"] != "apply":
            return "review", had.reason
        if event["before"] is not None or event["after"] is not None:
            e = e._replace(before=event["before"], after=event["after"])  # planned anew on what is there now
        if self.content != e.before:
            return ("review", "conflict") if op == "recheck" else ("rejected", "conflict")
        if op == "recheck":
            self._apply(key, e._replace(reason=f"{had.reason} (held earlier; released on re-check)"), undo=False)
        else:
            self._apply(key, e._replace(reason="approved by you"))
        return "applied", self.entries[key].reason

    def _undo(self, key: str, had: Entry | None, at) -> tuple[str, str | None]:
        if not had or had.status != "applied":
            return "rejected", "no such change"
        if had.undone is not None:
            return "rejected", "already taken back"
        if not had.undo:
            return "rejected", "too old to take back"
        if self.content is None and had.after is not None:
            return "rejected", "no longer there"
        if self.content != had.after:
            return "rejected", "changed since"
        self.content = had.before
        self.entries[key] = had._replace(undo=False, undone=at, before=None, after=None)
        self.undoable.remove(key)
        return "applied", "taken back by you"

    def restore(self, record: dict | None, entries: list[tuple[str, Entry]]) -> None:
        """Goes on from what was stored."""
        if record:
            self.content, self.human_edited, self.not_threads = record["content"], record["human_edited"], list(record["not_threads"])
            self.last = record["last_at"], record["last_seq"]
        self.entries = dict(entries)
        self.undoable = deque(k for k, e in sorted(entries, key=lambda x: x[1].written) if e.undo)


def _stored(row: dict) -> tuple[str, Entry]:
    return row["key"], Entry(row["status"], row["reason"], row["at"], row["seq"], row["client"], row["before"], row["after"], row["thread"], row["undo"], row["undone"], (row["written_at"], row["written_seq"]))


def fold(events: DataFrame, entries: DataFrame | None = None, records: DataFrame | None = None, kept: int = KEPT) -> DataFrame:
    """``kind, path, entry, record, outcome``: the entries and records after all events, and what came of each event.

    ``events`` are as ``EVENTS``: ``op`` is submit, approve, dismiss, undo, recheck, sweep (decided
    elsewhere) or edit (the record is written by hand); ``plan`` says whether a submission
    is to be applied, held for review or rejected, whether a held one now would, and what
    was decided elsewhere. ``before`` is the content that a change was made for, null if the record isn't there.
    ``entries`` and ``records`` are what earlier events have left, if they all came before.
    Events without a path, a time or a number are left out; of several at one ``at, seq`` the order is that of op and key.
    """
    names, none = _names(EVENTS), F.lit(None)
    rows = events.where("path is not null and at is not null and seq is not null")
    rows = rows.select(F.lit(1).alias("_k"), *names, none.cast(_struct(ENTRY)).alias("_e"), none.cast(_struct(RECORD)).alias("_r"))

    def stored(df: DataFrame, entry, record) -> DataFrame:
        cells = (none.cast(rows.schema[c].dataType).alias(c) for c in names[1:])
        return df.select(F.lit(0).alias("_k"), "path", *cells, entry.cast(_struct(ENTRY)).alias("_e"), record.cast(_struct(RECORD)).alias("_r"))

    if entries is not None:
        rows = rows.unionByName(stored(entries, F.struct(*_names(ENTRY)), none))
    if records is not None:
        rows = rows.unionByName(stored(records, none, F.struct(*_names(RECORD))))
    schema = to_arrow_schema(StructType.fromDDL(_ROW))
    rows = rows.repartition("path").sortWithinPartitions("path", "_k", "at", "seq", "op", "key")

    def told(m: Machine) -> list[tuple]:
        out = [("record", m.path, None, (m.path, m.content, m.human_edited, m.not_threads, *m.last), None)]
        for key, e in m.entries.items():
            out.append(("entry", m.path, (m.path, key, *e[:-1], *e.written), None, None))
        return out

    def run(batches):
        machine, before, record = None, [], None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if machine is None or machine.path != row["path"]:
                    if machine is not None:
                        if before or record:
                            machine.restore(record, before)
                        out += told(machine)
                    machine, before, record = Machine(row["path"], kept), [], None
                if row["_k"] == 0:
                    if row["_e"]:
                        before.append(_stored(row["_e"]))
                    else:
                        record = row["_r"]
                    continue
                if before or record:
                    machine.restore(record, before)
                    before, record = [], None
                outcome = machine.step(row)
                out.append(("outcome", machine.path, None, None, (row["key"], row["at"], row["seq"], row["op"], *outcome)))
            yield _batch(schema, out)
        if machine is not None:
            if before or record:
                machine.restore(record, before)
            yield _batch(schema, told(machine))

    return rows.mapInArrow(run, _ROW)


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    cell = lambda f, v: dict(zip([x.name for x in f.type], v, strict=True)) if isinstance(v, tuple) else v
    return pa.RecordBatch.from_pylist([{f.name: cell(f, v) for f, v in zip(schema, row, strict=True)} for row in rows], schema)


def entries_of(folded: DataFrame) -> DataFrame:
    return folded.where("kind = 'entry'").select("entry.*")


def records_of(folded: DataFrame) -> DataFrame:
    return folded.where("kind = 'record'").select("record.*")


def outcomes_of(folded: DataFrame) -> DataFrame:
    """``path, key, at, seq, op, outcome, reason`` of each event."""
    return folded.where("kind = 'outcome'").select("path", "outcome.*")


def apply(spark: SparkSession, home: str, events: DataFrame, number: int, parts: int = PARTS, kept: int = KEPT) -> shards.State | None:
    """Adds a batch of events to the ledger in a folder: the same state after any number of batches, in any order.

    Events are logged by shard of their record. A record whose new events are all later than those
    before goes on from its stored state; one that gets an earlier event is folded again from
    the log. Only shards of touched records are written anew, and a batch that has been added isn't added again.
    """
    state = shards.current(spark, home)
    if state and state.meta["batch"] >= number:
        return state
    parts = state.parts if state else parts
    names = _names(EVENTS)
    part = shards.shard(F.col("path"), parts)
    log = f"{home}/log/batch={number}"
    events.where("path is not null and at is not null and seq is not null").select(*names, part.alias("part")).repartition("part").write.mode("overwrite").partitionBy("part").parquet(log)
    read = lambda *paths: spark.read.option("basePath", f"{home}/log").schema(f"{EVENTS}, part int, batch int").parquet(*paths).drop("batch")
    new = read(log)
    touched = {r["part"] for r in new.select("part").distinct().collect()}  # as many as shards
    if state is None:
        entries, records = spark.createDataFrame([], ENTRY), spark.createDataFrame([], RECORD)
    else:
        entries, records = (shards.read(spark, home, state, name, touched) for name in ("entries", "records"))
    first = new.groupBy("path").agg(F.min(F.struct("at", "seq")).alias("_first"))
    known = records.select("path", F.struct(F.col("last_at").alias("at"), F.col("last_seq").alias("seq")).alias("_last"))
    paths = cut(first.join(known, "path", "left").select("path", F.coalesce(F.col("_first") <= F.col("_last"), F.lit(False)).alias("late")))
    late, on_time = paths.where("late").select("path"), paths.where("not late").select("path")
    history = [*(state.meta["log"] if state else []), number]
    taken = new.join(on_time, "path", "left_semi")
    if touched and state:
        again = read(*(f"{home}/log/batch={n}" for n in history)).where(F.col("part").isin(*touched))
        taken = taken.unionByName(again.join(late, "path", "left_semi"))
    going_on = lambda df: df.join(on_time, "path", "left_semi")
    folded = cut(fold(taken.drop("part"), going_on(entries), going_on(records), kept).where("kind <> 'outcome'"))
    keep = lambda df: df.join(paths.select("path"), "path", "left_anti")
    tables = {"entries": keep(entries).unionByName(entries_of(folded)), "records": keep(records).unionByName(records_of(folded))}
    return shards.replaced(spark, home, state, tables, touched, parts, {"batch": number, "log": history})


def follow(feed: DataFrame, home: str, parts: int = PARTS, kept: int = KEPT) -> None:
    """Adds a stream of events batch by batch until it ends."""
    spark = feed.sparkSession

    def batch(rows: DataFrame, number: int) -> None:
        apply(spark, home, rows, number, parts, kept)
        shards.sweep(spark, home)

    feed.writeStream.foreachBatch(batch).option("checkpointLocation", f"{home}-feed").trigger(availableNow=True).start().awaitTermination()


def entries(spark: SparkSession, home: str) -> DataFrame:
    return shards.read(spark, home, shards.current(spark, home), "entries")


def records(spark: SparkSession, home: str) -> DataFrame:
    return shards.read(spark, home, shards.current(spark, home), "records")


def recent(entries: DataFrame, limit: int = 15) -> DataFrame:
    """The latest changes that were applied, with whether they can be taken back; of one instant the one written later first."""
    rows = entries.where("status = 'applied'").select("key", "path", "at", "reason", "client", F.col("undo").alias("can_undo"), "undone", "written_at", "written_seq")
    return rows.orderBy(F.desc("at"), F.desc("written_at"), F.desc("written_seq"), "key").limit(max(1, min(50, limit))).drop("written_at", "written_seq")


def pruned(entries: DataFrame, kept: int = KEPT) -> DataFrame:
    """The entries with the text to take them back for the ``kept`` latest changes of all records alone."""
    latest = entries.where("undo").orderBy(F.desc("at"), F.desc("written_at"), F.desc("written_seq"), "key").limit(kept).select("path", "key", F.lit(True).alias("_kept"))
    rows = entries.join(latest, ["path", "key"], "left")
    stays = ~F.col("undo") | F.coalesce("_kept", F.lit(False))
    return rows.withColumn("before", F.when(stays, F.col("before"))).withColumn("after", F.when(stays, F.col("after"))).withColumn("undo", F.col("undo") & stays).drop("_kept").select(entries.columns)


def pending(entries: DataFrame) -> DataFrame:
    """What is held for review."""
    return entries.where("status = 'review'")


def status(entries: DataFrame, keys: DataFrame) -> DataFrame:
    """Each of the asked ``key``s with its entry, without the kept texts; null where there is none."""
    return keys.select("key").distinct().join(entries.drop("before", "after"), "key", "left")
