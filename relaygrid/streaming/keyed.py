"""Streaming operators on Spark's keyed state (``transformWithState``).

Only narrow rows enter the state operators: keys, instants and, where a result
is built from it, the message as JSON text.  Time moves by a clock column, the
arrival of a row and not its own timestamp, so no row is ever too late to be
judged; state is dropped by timers on that clock.  In tests and when a log is
replayed the clock is an argument.

Keys that hold a large share of all rows are *spread*: what is kept in state
(completions, deletions, inserts: few) goes to every one of ``spread`` sub-keys,
what asks (messages: many) to one of them.  A task holds the narrow rows of one
sub-key and one micro-batch while it orders them.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from relaygrid import vocabulary as V
from relaygrid.functions.messages import Message, flag
from relaygrid.operators import inject, purge, replay
from relaygrid.operators.filters import instant

CLOCK = "_clock"
#: Sub-keys of a key.
SPREAD = 8
_STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def clocked(stream: DataFrame, now=None) -> DataFrame:
    """``stream`` with the clock: the time a batch is processed, or ``now``; must not run backwards between batches."""
    at = F.current_timestamp() if now is None else instant(now)
    # a row's clock lies ahead of the watermark of all batches before, also where these had the same clock
    return stream.withColumn(CLOCK, at).withWatermark(CLOCK, "1 millisecond")


def run_caught_up(
    stream: DataFrame, checkpoint: str, each_batch: Callable[[DataFrame, int], None] | None = None, output: str | None = None
) -> None:
    """Process what is there and stop at the end of every partition."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if each_batch is not None:
        query = writer.foreachBatch(each_batch).start()
    else:
        query = writer.format("parquet").outputMode("append").start(output)
    query.awaitTermination()


def _stateful(rows: DataFrame, keys: list[str], processor: StatefulProcessor, out, timers: bool, loaded: DataFrame | None = None) -> DataFrame:
    """``processor`` per key; ``loaded`` rows are its state before the first batch."""
    rows.sparkSession.conf.set(_STATE_STORE, _ROCKSDB)
    initial = None if loaded is None else loaded.groupBy(*keys)
    return rows.groupBy(*keys).transformWithState(processor, out, "append", "eventTime" if timers else "none", initial)


def _as_text(*columns: Column | str) -> Column:
    return F.to_json(F.struct(*columns), _JSON)


def _from_text(text: Column, fields: list[T.StructField]) -> Column:
    return F.from_json(text, T.StructType(fields), _JSON)


def _sub_keys(kept: Column, row_id: str, spread: int) -> Column:
    """All sub-keys for a row that is kept, one for a row that asks."""
    return F.explode(F.when(kept, F.sequence(F.lit(0), F.lit(spread - 1))).otherwise(F.array(F.pmod(F.xxhash64(row_id), F.lit(spread)).cast("int"))))


class _Quiet(StatefulProcessor):
    """No timers, nothing to close."""

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        return iter(())

    def close(self) -> None:
        pass


# --- replays ------------------------------------------------------------------------

class _Answer(_Quiet):
    """Per entity, plugin and version: the newest completion, for a while after it arrived."""

    def __init__(self, ttl_s: float):
        self.ttl = int(ttl_s * 1_000_000)

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "at long, id long, body string, until long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        batch = [(r["at"], r["side"], r["id"], r["body"], r["clock"]) for r in rows]
        newest = self.held.get() if self.held.exists() else None
        if newest is not None:
            batch.append((newest[0], 0, newest[1], newest[2], None))
        current = fresh = None
        for at, side, row_id, body, clock in sorted(batch, key=lambda r: r[:3]):
            if side == 0:
                current = (at, row_id, body)
                fresh = None if clock is None else (*current, (clock + self.ttl) // 1000)
            elif current is not None and at - current[0] < self.ttl:
                yield Row(id=row_id, status_id=current[1], trigger=body, cached=current[2])
        if fresh is not None:  # the newest of all came with this batch
            self.held.update(fresh)
            self.handle.registerTimer(fresh[3])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        if self.held.exists() and self.held.get()[3] <= timerValues.getCurrentWatermarkInMs():
            self.held.clear()
        return iter(())


def _emitted(stream: DataFrame) -> Column:
    """Of a completion, what :func:`replay.replayed_results` reads: the last step of its lineage and, of each result, what is not replaced."""
    status = F.col("status")
    replaced = ("source", "flags", "timestamp")
    kept = [f.name for f in stream.schema["status"].dataType["results"].dataType.elementType.fields if f.name not in replaced]
    results = F.transform(status["results"], lambda r: F.when(r.isNotNull(), F.struct(*[r[c].alias(c) for c in kept])))
    path = status["input"]["source"]["path"]
    last = F.when(F.size(path) > 0, F.slice(path, -1, 1))
    return F.struct(F.struct(F.struct(last.alias("path")).alias("source")).alias("input"), results.alias("results"))


def replay_stream(
    stream: DataFrame, consumer: tuple[Column, Column], ttl_s: float = V.REPLAY_TTL_S, min_runtime_s: float = V.REPLAY_MIN_RUNTIME_S,
    now=None, results_as_of=None, spread: int = SPREAD,
) -> DataFrame:
    """Answer messages from completions seen so far.

    The stream mixes ``binary`` and ``status`` messages.  A message is answered
    by the newest completion of its entity, plugin and version at or before it
    and no older than the TTL; of earlier batches only the newest is known, and
    only for a TTL after it arrived.  A batch touches the state of its own keys.

    Gives (seq of the message held back, status_id), or, with
    ``results_as_of``, the results re-emitted for it as of that instant.
    """
    is_status = F.col("model") == "status"
    completes = flag(is_status & replay.is_cacheable(min_runtime_s))
    asks = flag(Message(stream).is_binary & ~flag(F.col("flags.bypass_cache")))
    emits = results_as_of is not None
    # a part of a row that is null would be nested nulls in the text; one struct per side keeps texts short
    body = F.when(completes, _as_text(_emitted(stream).alias("status"))).otherwise(_as_text("source", "flags")) if emits else F.lit(None).cast("string")
    narrow = clocked(stream.where(completes | asks), now).select(
        F.when(completes, F.col("status.input.entity.sha256")).otherwise(F.col("entity.sha256")).alias("sha256"),
        F.when(completes, F.col("author.name")).otherwise(consumer[0]).alias("name"),
        F.when(completes, F.col("author.version")).otherwise(consumer[1]).alias("version"),
        F.unix_micros("timestamp").alias("at"), F.when(completes, 0).otherwise(1).alias("side"), F.col("seq").alias("id"),
        body.alias("body"), F.unix_micros(CLOCK).alias("clock"), CLOCK,
    )
    # what lacks a part of its key, or its instant, matches nothing
    narrow = narrow.where(F.col("sha256").isNotNull() & F.col("name").isNotNull() & F.col("version").isNotNull() & F.col("at").isNotNull())
    narrow = narrow.withColumn("sub", _sub_keys(F.col("side") == 0, "id", spread))
    found = _stateful(narrow, ["sha256", "name", "version", "sub"], _Answer(ttl_s), "id long, status_id long, trigger string, cached string", timers=True)
    if not emits:
        return found.select(F.col("id").alias("seq"), "status_id")
    schema = stream.schema
    answered = found.select(
        F.col("id").alias("seq"), "status_id", _from_text(F.col("trigger"), [schema["source"], schema["flags"]]).alias("t"),
        _from_text(F.col("cached"), [schema["status"]]).alias("c"),
    )
    return replay.replayed_results(answered.select(
        "seq", "status_id", F.col("t.source").alias("_source"), F.col("t.flags").alias("_flags"), F.col("c.status").alias("_cached")), results_as_of)


# --- deletions ----------------------------------------------------------------------

def _holds(kind: str, at: int | None, bound: int | None) -> bool:
    if kind == purge.BY_AUTHOR:
        return at is not None and bound is not None and at < bound
    if kind == purge.BY_SUBMISSION:
        return bound is None or bound == at
    return True


class _Deleted(_Quiet):
    """Per kind and token: the newest deletion; answers the messages it purges."""

    def init(self, handle) -> None:
        self.held = handle.getValueState("held", "seq long, bound long")

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N802, N803
        self.held.update((initialState["id"], initialState["at"]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        newest, asked = (tuple(self.held.get()) if self.held.exists() else None), []
        before = newest
        for r in rows:
            if r["is_delete"]:
                if newest is None or r["id"] > newest[0]:
                    newest = (r["id"], r["at"])
            else:
                asked.append((r["id"], r["at"]))
        if newest is None:
            return
        if newest != before:
            self.held.update(newest)
        for message, at in asked:
            if _holds(key[0], at, newest[1]):
                yield Row(id=message, hit=True, body=None)


class _Survivor(_Quiet):
    """Per message: its text, unless a token's answer says that it is deleted."""

    def init(self, handle) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        bodies, hit = [], False
        for r in rows:
            if r["hit"]:
                hit = True
            else:
                bodies.append(r["body"])
        if not hit:
            for body in bodies:
                yield Row(id=key[0], body=body)


def purge_stream(stream: DataFrame, loaded: DataFrame | None = None, spread: int = SPREAD, carry: list[str] | None = None) -> DataFrame:
    """Messages not deleted so far.

    The stream mixes ``binary`` messages and ``delete`` rows, the latter with
    their payload in ``deletion``.  A deletion acts on its own batch and on
    later ones; it does not recall messages that went out.  A message asks for
    each of its tokens, and the answers meet by its id.  The cost of a batch is
    that of its own tokens, whatever the number of deletions.

    ``loaded``: the register (:func:`purge.latest_deletes`) before the stream.
    ``carry``: the columns to give out beside ``seq``; all by default.
    """
    columns = [c for c in stream.columns if c not in ("deletion", "seq")] if carry is None else carry
    deletes = stream.where(F.col("model") == "delete").select("seq", "action", F.col("deletion").alias("entity"))
    entries = purge.entries(deletes).select(
        "kind", "token", F.lit(True).alias("is_delete"), F.col("seq").alias("id"), F.unix_micros("bound").alias("at"))
    messages = stream.where(Message(stream).is_binary)
    asked = messages.select("seq", F.explode(purge.tokens()).alias("t")).where(F.col("t.token").isNotNull()).select(
        "t.kind", "t.token", F.lit(False).alias("is_delete"), F.col("seq").alias("id"), F.unix_micros("t.at").alias("at"))
    tokens = entries.unionByName(asked).withColumn("sub", _sub_keys(F.col("is_delete"), "id", spread))
    register = None
    if loaded is not None:
        every = F.explode(F.sequence(F.lit(0), F.lit(spread - 1))).alias("sub")
        register = loaded.select("kind", "token", every, F.col("seq").alias("id"), F.unix_micros("bound").alias("at"))
    hits = _stateful(tokens, ["kind", "token", "sub"], _Deleted(), "id long, hit boolean, body string", timers=False, loaded=register)
    carriers = messages.select(F.col("seq").alias("id"), F.lit(False).alias("hit"), (_as_text(*columns) if columns else F.lit("{}")).alias("body"))
    left = _stateful(carriers.unionByName(hits), ["id"], _Survivor(), "id long, body string", timers=False)
    if not columns:
        return left.select(F.col("id").alias("seq"))
    message = _from_text(F.col("body"), [stream.schema[c] for c in columns]).alias("m")
    return left.select(F.col("id").alias("seq"), message).select("seq", "m.*")


# --- inserts ------------------------------------------------------------------------

class _Parents(_Quiet):
    """Per insert key: the parents it was sent to, so that taking it back reaches them."""

    def init(self, handle) -> None:
        self.sent = handle.getMapState("sent", "parent string", "seq long")

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N802, N803
        self.sent.updateValue((initialState["parent"],), (initialState["id"],))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        for seq, parent, body in sorted(((r["id"], r["parent"], r["body"]) for r in rows), key=lambda r: r[0]):
            if body is not None:
                if not self.sent.containsKey((parent,)) or self.sent.getValue((parent,))[0] < seq:
                    self.sent.updateValue((parent,), (seq,))
                    yield Row(parent=parent, insert_key=key[0], id=seq, body=body, kept=True)
            else:
                for (known,) in list(self.sent.keys()):
                    if self.sent.getValue((known,))[0] < seq:
                        self.sent.removeKey((known,))
                        yield Row(parent=known, insert_key=key[0], id=seq, body=None, kept=True)


class _Children(_Quiet):
    """Per parent: its inserts by key; the messages of that parent are answered with all of them."""

    #: Messages in a row of answers.
    TOGETHER = 32

    def init(self, handle) -> None:
        self.held = handle.getMapState("held", "insert_key string", "seq long, body string")

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N802, N803
        self.held.updateValue((initialState["insert_key"],), (initialState["id"], initialState["body"]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        changes, asked = {}, []
        for r in rows:
            if r["kept"]:
                if r["insert_key"] not in changes or r["id"] > changes[r["insert_key"]][0]:
                    changes[r["insert_key"]] = (r["id"], r["body"])
            else:
                asked.append((r["id"], r["body"]))
        for insert, (seq, body) in changes.items():
            if self.held.containsKey((insert,)) and self.held.getValue((insert,))[0] >= seq:
                continue
            if body is None:
                self.held.removeKey((insert,))
            else:
                self.held.updateValue((insert,), (seq, body))
        if asked:
            children = [(k[0], v[1]) for k, v in self.held.iterator()]
            # texts leave once per message and once per group of messages, not once per child
            for start in range(0, len(asked) if children else 0, self.TOGETHER):
                yield Row(messages=asked[start:start + self.TOGETHER], inserts=children)


def inject_stream(stream: DataFrame, now, loaded: DataFrame | None = None, spread: int = SPREAD) -> DataFrame:
    """Each message, and one child per insert known for its entity so far.

    The stream mixes ``binary`` messages and ``insert`` rows with their payload
    in ``insert``; a NULL payload takes the insert of that key back from every
    parent.  An insert acts on its own batch and on later ones.  ``loaded``: the
    register (:func:`inject.latest_inserts`) before the stream.
    """
    text_of = _as_text(F.col("insert.child").alias("child"), F.col("insert.child_history").alias("child_history"))
    parents = known = None
    if loaded is not None:
        every = F.explode(F.sequence(F.lit(0), F.lit(spread - 1))).alias("sub")
        parents = loaded.select("kafka_key", F.col("parent_sha256").alias("parent"), F.col("seq").alias("id"))
        known = loaded.select(F.col("parent_sha256").alias("parent"), every, F.col("kafka_key").alias("insert_key"), F.col("seq").alias("id"), text_of.alias("body"))
    inserts = stream.where((F.col("model") == "insert") & F.col("kafka_key").isNotNull()).select(
        "kafka_key", F.col("insert.parent_sha256").alias("parent"), F.col("seq").alias("id"),
        F.when(F.col("insert").isNotNull(), text_of).alias("body"),
    ).where(F.col("body").isNull() | F.col("parent").isNotNull())
    sent = _stateful(inserts, ["kafka_key"], _Parents(), "parent string, insert_key string, id long, body string, kept boolean", timers=False, loaded=parents)
    messages = stream.where(Message(stream).is_binary).drop("insert")
    fields = [c for c in messages.columns if c != "seq"]
    asks = messages.where(inject.injectable(messages) & F.col("entity.sha256").isNotNull()).select(
        F.col("entity.sha256").alias("parent"), F.lit(None).cast("string").alias("insert_key"), F.col("seq").alias("id"),
        _as_text("source").alias("body"), F.lit(False).alias("kept"),
    )
    both = sent.unionByName(asks).withColumn("sub", _sub_keys(F.col("kept"), "id", spread))
    out = "messages array<struct<id:long,body:string>>, inserts array<struct<insert_key:string,body:string>>"
    answered = _stateful(both, ["parent", "sub"], _Children(), out, timers=False, loaded=known)
    shape = stream.schema["insert"].dataType
    of_insert = F.transform("inserts", lambda i: F.named_struct(
        F.lit("insert_key"), i["insert_key"], F.lit("i"), _from_text(i["body"], [shape["child"], shape["child_history"]])))
    each = answered.select(of_insert.alias("inserts"), F.explode("messages").alias("m"))
    parsed = each.select("inserts", F.col("m.id").alias("seq"), _from_text(F.col("m.body"), [stream.schema["source"]])["source"].alias("source"))
    opened = parsed.select("seq", "source", F.explode("inserts").alias("c")).select(
        "seq", F.col("c.insert_key").alias("_insert"), "source", F.col("c.i.child").alias("_child"), F.col("c.i.child_history").alias("_history"))
    made = inject.child_fields(messages.schema, now)
    children = opened.select("seq", *[made.get(c, F.lit(None).cast(messages.schema[c].dataType)).alias(c) for c in fields], F.col("_insert").alias("injected_key"))
    return messages.select("seq", *fields, F.lit(None).cast("string").alias("injected_key")).unionByName(children)


# --- tasks and pauses -----------------------------------------------------------------

#: Tasks are dealt to buckets by the hash of their id; the tasks of a bucket lie in cells, and a batch reads and writes the cells it touches.
BUCKETS, CELLS = 2048, 64
#: Rows and bytes that are packed together before they move.
_PACK_ROWS, _PACK_BYTES = 65_536, 1 << 24


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with a bucket as one row per bucket, the other columns as lists, for so many rows at a time."""
    held, count, size = [], 0, 0

    def pack() -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        bucket = rows.column("bucket").to_numpy()
        order = np.argsort(bucket, kind="stable")
        found, first = np.unique(bucket[order], return_index=True)
        ends = pa.array(np.append(first, len(order)), pa.int32())
        names = [n for n in rows.schema.names if n != "bucket"]
        lists = [pa.ListArray.from_arrays(ends, rows.column(n).take(pa.array(order))) for n in names]
        return pa.RecordBatch.from_arrays([pa.array(found), *lists], names=["bucket", *names])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count, size = count + batch.num_rows, size + batch.nbytes
        if count >= _PACK_ROWS or size >= _PACK_BYTES:
            yield pack()
            held, count, size = [], 0, 0
    if held:
        yield pack()


class _Tasks(StatefulProcessor):
    """The tasks of a bucket: starts until they finish or their time is over, finishes for a while; one timer stands for the earliest end.

    A cell is a text, {task: [end, start]}: when it is over by the clock, in
    milliseconds, and the start's text, or null of a task that has finished.
    """

    #: The end of what does not end.
    NEVER = (1 << 63) - 1

    def __init__(self, lost_after_s: int, kept_s: int, size: int):
        self.lost_after, self.kept, self.size = lost_after_s * 1000, kept_s * 1000, size

    def init(self, handle) -> None:
        self.handle = handle
        self.cells = handle.getMapState("cells", "cell int", "tasks string")
        # the earliest end of each cell
        self.ends = handle.getValueState("ends", "ends binary")

    def _read(self, cell: int) -> dict:
        return json.loads(self.cells.getValue((cell,))[0])

    def _write(self, cell: int, tasks: dict) -> int:
        """Store a cell; its earliest end."""
        if not tasks:
            self.cells.removeKey((cell,))
            return self.NEVER
        self.cells.updateValue((cell,), (json.dumps(tasks, ensure_ascii=False, separators=(",", ":")),))
        return min(end for end, _ in tasks.values())

    def _ends(self) -> np.ndarray:
        held = self.ends.get()
        return np.full(self.size, self.NEVER, np.int64) if held is None else np.frombuffer(held[0], np.int64).copy()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        begun: dict[int, dict] = {}
        ended: dict[int, set] = {}
        clock = 0
        for part in rows:
            clock = int(part["clock"].iloc[-1]) // 1000
            for cells, tasks, at, bodies in zip(part["cell"], part["task"], part["at"], part["body"], strict=True):
                for cell, task, began, body in zip(cells.tolist(), tasks, at.tolist(), bodies, strict=True):
                    if body is None:
                        ended.setdefault(cell, set()).add(task)
                    else:
                        starts = begun.setdefault(cell, {})
                        if task not in starts or (began, body) < starts[task]:
                            starts[task] = (began, body)
        before = self._ends()
        ends = before.copy()
        for cell in begun.keys() | ended.keys():
            # a cell without an end is empty
            known, finished, changed = self._read(cell) if before[cell] < self.NEVER else {}, ended.get(cell, ()), False
            for task in finished:
                if task not in known or known[task][1] is not None:
                    known[task] = (clock + self.kept, None)
                    changed = True
            for task, (began, body) in begun.get(cell, {}).items():
                if task not in known:  # nor finished, in this batch or before
                    known[task] = (began // 1000 + self.lost_after, body)
                    changed = True
            if changed:
                ends[cell] = self._write(cell, known)
        self._settle(before, ends)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        before = self._ends()
        ends = before.copy()
        lost = []
        for cell in np.flatnonzero(before < now).tolist():
            left = {}
            for task, (end, body) in self._read(cell).items():
                if end >= now:
                    left[task] = (end, body)
                elif body is not None:
                    lost.append(body)
            ends[cell] = self._write(cell, left)
        self._settle(before, ends)
        if lost:
            yield pd.DataFrame({"body": lost})

    def _settle(self, before: np.ndarray, ends: np.ndarray) -> None:
        if (ends == before).all():
            return
        earliest = int(ends.min())
        if earliest == self.NEVER:
            self.ends.clear()
            return
        self.ends.update((ends.tobytes(),))
        if earliest != int(before.min()):
            self.handle.registerTimer(earliest)

    def close(self) -> None:
        pass


def lost_task_stream(
    starts: DataFrame, finishes: DataFrame, lost_after_s: int = V.LOST_AFTER_S, now=None, kept_s: int | None = None,
    buckets: int = BUCKETS, cells: int = CELLS,
) -> DataFrame:
    """Starts without a finish once their time is over by the clock.

    ``starts`` has ``dequeued, started_at`` and whatever is to be reported;
    ``finishes`` has ``dequeued``.  A start is reported once, by a timer, in the
    run whose clock (``now``) lies beyond its deadline; no further row has to
    arrive, and a start that arrives long after its deadline is reported too.
    Starts that are not overdue yet wait in state for a later run.  A finish may
    arrive before its start; it is remembered for ``kept_s`` (twice
    ``lost_after_s``).  Tasks without id are not tracked.

    Tasks move and lie in state many at a time, in ``cells`` of each of
    ``buckets``: a call of the state is far dearer than a task.  Both numbers
    belong to a checkpoint and stay as long as it is used.
    """
    def narrow(rows: DataFrame, at: Column, body: Column) -> DataFrame:
        return rows.select(F.col("dequeued").cast("string").alias("task"), at.alias("at"), body.alias("body"))

    begun = narrow(starts.where(F.col("dequeued").isNotNull() & F.col("started_at").isNotNull()), F.unix_micros("started_at"), _as_text(*starts.columns))
    ended = narrow(finishes.where(F.col("dequeued").isNotNull()), F.lit(0).cast("long"), F.lit(None).cast("string"))
    place = F.xxhash64("task")
    dealt = begun.unionByName(ended).select(
        F.pmod(place, F.lit(buckets)).alias("bucket"), F.pmod(F.shiftright(place, 32), F.lit(cells)).cast("int").alias("cell"), "task", "at", "body",
    )
    packed = dealt.mapInArrow(_packed, "bucket long, cell array<int>, task array<string>, at array<long>, body array<string>")
    rows = clocked(packed, now).withColumn("clock", F.unix_micros(CLOCK))
    rows.sparkSession.conf.set(_STATE_STORE, _ROCKSDB)
    processor = _Tasks(lost_after_s, 2 * lost_after_s if kept_s is None else kept_s, cells)
    lost = rows.groupBy("bucket").transformWithStateInPandas(processor, "body string", "append", "eventTime")
    return lost.select(_from_text(F.col("body"), starts.schema.fields).alias("s")).select("s.*")


class _Pauses(StatefulProcessor):
    """The last recorded pause, and those waiting until time has passed them, by stretches of time; one timer stands for the earliest."""

    #: Milliseconds of a stretch.
    STRETCH = 3_600_000

    def __init__(self, gap_s: int):
        self.gap = gap_s * 1_000_000

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long")
        self.waiting = handle.getMapState("waiting", "stretch long", "instants binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        arrived = np.unique(np.concatenate([part["at"].to_numpy(np.int64) for part in rows]))
        # what lies within the gap of a recorded pause is not recorded, whatever else arrives
        arrived = arrived if not self.last.exists() else arrived[arrived - self.last.get()[0] > self.gap]
        stretch = arrived // 1000 // self.STRETCH
        for one in np.unique(stretch).tolist():
            instants = arrived[stretch == one]
            if self.waiting.containsKey((one,)):
                instants = np.union1d(instants, np.frombuffer(self.waiting.getValue((one,))[0], np.int64))
            self.waiting.updateValue((one,), (instants.tobytes(),))
        if len(arrived):
            self.handle.registerTimer(int(arrived[0]) // 1000)  # a timer knows milliseconds
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        last = before = self.last.get()[0] if self.last.exists() else None
        recorded, ahead = [], None
        for one in sorted(k[0] for k in self.waiting.keys()):
            instants = np.frombuffer(self.waiting.getValue((one,))[0], np.int64)
            while True:
                instants = instants if last is None else instants[np.searchsorted(instants, last + self.gap, "right"):]
                if not len(instants) or int(instants[0]) // 1000 >= now:
                    break
                last = int(instants[0])
                recorded.append(last)
            if len(instants):
                self.waiting.updateValue((one,), (instants.tobytes(),))
                ahead = int(instants[0]) // 1000
                break
            self.waiting.removeKey((one,))
        if last != before:
            self.last.update((last,))
        if ahead is not None:
            self.handle.registerTimer(ahead)
        if recorded:
            yield pd.DataFrame({"at": recorded})

    def close(self) -> None:
        pass


def throttled_pause_stream(pauses: DataFrame, gap_s: int = V.PAUSE_GAP_S, lateness: str = "1 minute", by: list[str] | None = None) -> DataFrame:
    """Pauses that are recorded: more than ``gap_s`` after the last recorded one, per ``by`` (one sequence by default).

    Pauses may arrive in any order within ``lateness``: a timer judges each
    when the newest row lies that far ahead, so what is recorded does not
    depend on the batches.  A column ``is_pause``, if there is one, is false for
    rows that only move time on; these do not reach the state.  Spark drops a
    pause that comes later still.  The pauses of a sequence meet in one task, as
    numbers; only stretches of time that a batch touches are read and written.
    """
    keys = by or ["_all"]
    rows = pauses if "is_pause" in pauses.columns else pauses.withColumn("is_pause", F.lit(True))
    rows = rows.withColumn("_all", F.lit(0)).withWatermark("paused_at", lateness)
    # a filter could be moved below the watermark, which is to see all rows
    at = F.filter(F.array(F.unix_micros("paused_at")), lambda at: at.isNotNull() & F.col("is_pause"))
    rows = rows.select(*keys, "paused_at", F.explode(at).alias("at"))
    rows.sparkSession.conf.set(_STATE_STORE, _ROCKSDB)
    recorded = rows.groupBy(*keys).transformWithStateInPandas(_Pauses(gap_s), "at long", "append", "eventTime")
    return recorded.select(F.timestamp_micros("at").alias("paused_at"))
