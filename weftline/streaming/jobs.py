"""Live versions of edit replay, density and connectivity.

Each job reads files as a stream, a few to a micro-batch, and keeps its result
as Parquet in the shared folder: each micro-batch writes only what it changed, and one that is run again replaces its
own output.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.affine import AXES, INDEX, Affine, nearest
from ..operators.aggregate import density_map
from ..operators.edits import DEPTH, Ids, union, without
from ..sources.files import scratch


def files_as_stream(spark: SparkSession, path: str, schema: StructType, per_batch: int = 1) -> DataFrame:
    """A stream of the Parquet files at ``path`` (a file, a folder or a pattern)."""
    pattern = path if any(c in path for c in "*?[") else f"{path[:-1]}[{path[-1]}]"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(pattern)


def _run(stream: DataFrame, mode: str, name: str, keep: Callable[[DataFrame, int, str], None]) -> str:
    """Runs ``stream`` over what is there now and returns the folder that ``keep`` wrote to."""
    spark, out = stream.sparkSession, scratch(stream.sparkSession, name)
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", scratch(spark, f"{name}-state")).trigger(availableNow=True)
    query.foreachBatch(lambda batch, k: keep(batch, k, out)).start().awaitTermination()
    return out


def _changed(batch: DataFrame, k: int, out: str) -> None:
    """The rows of a micro-batch, in a folder of its number: one that is run again replaces its own."""
    batch.write.mode("overwrite").parquet(f"{out}/batch={k}")


def upserted(spark: SparkSession, out: str, schema: StructType, keys: list[str]) -> DataFrame:
    """The newest row of each key among the changes that micro-batches left in ``out``."""
    rest = [f.name for f in schema if f.name not in keys]
    rows = spark.read.schema(StructType([*schema, StructField("batch", LongType())])).parquet(out)
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("new"))
    return newest.select(*[f"new.{f.name}" if f.name in rest else f.name for f in schema])


def _upserts(stream: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """A running aggregate in update mode: each micro-batch writes the keys that it touched, and no others."""
    return upserted(stream.sparkSession, _run(stream, "update", name, _changed), stream.schema, keys)


def stream_density(points: DataFrame, affine: Affine, dims) -> DataFrame:
    """Density of all points of a stream (x, y, z)."""
    return _upserts(density_map(points, affine, dims), "density", list(INDEX))


def stream_connectivity(ends: DataFrame, parcels: DataFrame, affine: Affine) -> DataFrame:
    """(a, b, n), a <= b: lines between labels, from a stream of one row a line (sid, x0..z0, x1..z1)."""
    labelled = ends
    for e, label in (("0", "label_a"), ("1", "label_b")):
        labelled = _nearest_label(labelled, parcels, affine, e, label)
    pairs = labelled.where("label_a > 0 AND label_b > 0").groupBy(F.least("label_a", "label_b").alias("a"), F.greatest("label_a", "label_b").alias("b"))
    return _upserts(pairs.agg(F.count("*").alias("n")), "connectivity", ["a", "b"])


def _nearest_label(ends: DataFrame, parcels: DataFrame, affine: Affine, end: str, name: str) -> DataFrame:
    at = [c.alias(v) for c, v in zip(nearest(affine, [F.col(a + end) for a in AXES]), INDEX, strict=True)]
    return ends.select("*", *at).join(parcels.select(*INDEX, F.col("label").alias(name)), list(INDEX), "left").drop(*INDEX).fillna(0, [name])


#: What an edit leaves behind: (session, step, kind, place, all_but, sid); see ``EditProcessor``.
CHANGES = "session long, step long, kind string, flag boolean, sid long"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Held:
    """A map state of which a call reads each entry once, and writes in the end what changed."""

    def __init__(self, state, empty: bool):
        self.state, self.whole, self.emptied = state, empty, False
        self.known: dict[tuple, tuple | None] = {}
        self.changed: set[tuple] = set()

    def getValue(self, key: tuple) -> tuple | None:
        if key not in self.known and not self.whole:
            self.known[key] = self.state.getValue(key) if self.state.containsKey(key) else None
        return self.known.get(key)

    def containsKey(self, key: tuple) -> bool:
        return self.getValue(key) is not None

    def updateValue(self, key: tuple, value: tuple) -> None:
        self.known[key] = value
        self.changed.add(key)

    def removeKey(self, key: tuple) -> None:
        self.known[key] = None
        self.changed.add(key)

    def keys(self) -> Iterator[tuple]:
        """Of a map of ids to true."""
        if not self.whole:
            self.known = {tuple(k): (True,) for k in self.state.keys()} | self.known
            self.whole = True
        return iter([k for k, v in self.known.items() if v is not None])

    def clear(self) -> None:
        self.known, self.changed, self.whole, self.emptied = {}, set(), True, True

    def write(self, new: bool) -> None:
        if self.emptied and not new:
            self.state.clear()
        for key in sorted(self.changed):
            if self.known[key] is not None:
                self.state.updateValue(key, self.known[key])
            elif not new and not self.emptied and self.state.containsKey(key):
                self.state.removeKey(key)


class EditProcessor(StatefulProcessor):
    """Undo and redo of one session in map and value states.

    ``selected`` and ``deleted`` map ids to true, beside a flag that turns the set round ("all but"); each
    deletion on the undo or redo stack is a map entry (its number, its ids), and ``head`` keeps the flags, the
    last seq and the numbers on the two stacks (20 at most).  So an edit reads and writes the entries of the ids that it
    names, and adding or removing an id writes one entry and ``head``, however many ids the session holds; the edits of one
    micro-batch read an entry once and write it once.

    Rows come out for what changed: (step, kind, flag, sid) with kind "turned" (flag: whether the deletions are now all but the
    ids listed), "deleted" (flag: whether sid is listed now), and the errors "gap" and "late" (sid: the seq that came, step: where).
    A gap is a seq that isn't the one after the last, where ``dense``; late is one that isn't above the last: both are applied when they come.
    """

    def __init__(self, dense: bool):
        self.dense = dense

    def init(self, handle: StatefulProcessorHandle) -> None:
        head = "seq long, step long, turned boolean, inverted boolean, keeper boolean, next long, undo array<long>, redo array<long>"
        self.head = handle.getValueState("head", head)
        ids = {name: handle.getMapState(name, "sid long", "listed boolean") for name in ("selected", "kept", "deleted")}
        self.states = ids | {"stack": handle.getMapState("stack", "number long", "flag boolean, ids array<long>")}

    @staticmethod
    def _ids(state) -> set[int]:
        return {k[0] for k in state.keys()}

    @staticmethod
    def _put(state, old: set[int], new: set[int]) -> None:
        for k in old - new:
            state.removeKey((k,))
        for k in new - old:
            state.updateValue((k,), (True,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        log = pd.concat(list(rows)).sort_values("seq", kind="stable")
        new = not self.head.exists()
        seq, step, turned, inverted, keeper, number, undo, redo = (None, 0, False, False, None, 0, [], []) if new else self.head.get()
        held = {name: _Held(state, new) for name, state in self.states.items()}
        self.selected, self.kept, self.deleted, self.stack = (held[name] for name in ("selected", "kept", "deleted", "stack"))
        undo, redo, out = list(undo), list(redo), []
        self.turned = turned
        for op, sid, at in zip(log.op, log.sid, log.seq, strict=True):
            step, at = step + 1, int(at)
            if seq is not None and at <= seq:
                out.append((step, "late", None, at))
            elif self.dense and seq is not None and at > seq + 1:
                out.append((step, "gap", None, at))
            seq = at if seq is None else max(seq, at)
            if op in ("add", "remove"):
                if (op == "add") != inverted:
                    self.selected.updateValue((int(sid),), (True,))
                elif self.selected.containsKey((int(sid),)):
                    self.selected.removeKey((int(sid),))
                keeper = None
            elif op == "clear":
                self.selected.clear()
                inverted, keeper = False, None
            elif op == "invert":
                inverted, keeper = self._invert(inverted, keeper)
            elif op == "delete" and (inverted or next(iter(self.selected.keys()), None) is not None):
                ids = self._ids(self.selected)
                self.stack.updateValue((number,), (inverted, sorted(ids)))
                for gone in redo:
                    self.stack.removeKey((gone,))
                undo, redo, number = self._pushed(undo, number), [], number + 1
                self._change((inverted, ids), union, step, out)
                self.selected.clear()
                inverted, keeper = False, None
            elif op == "undo" and undo:
                last = undo.pop()
                redo = self._pushed(redo, last)
                self._change(self._item(last), without, step, out)
            elif op == "redo" and redo:
                last = redo.pop()
                undo = self._pushed(undo, last)
                self._change(self._item(last), union, step, out)
        for entries in held.values():
            entries.write(new)
        self.head.update((seq, step, self.turned, inverted, keeper, number, undo, redo))
        yield pd.DataFrame(
            {"session": pd.Series([key[0]] * len(out), dtype="int64"), "step": pd.Series([o[0] for o in out], dtype="int64"), "kind": pd.Series([o[1] for o in out], dtype="object"), "flag": pd.Series([o[2] for o in out], dtype="boolean"), "sid": pd.Series([o[3] for o in out], dtype="Int64")}
        )

    def _item(self, number: int) -> Ids:
        flag, ids = self.stack.getValue((number,))
        return flag, {int(i) for i in ids}

    def _pushed(self, stack: list[int], number: int) -> list[int]:
        if len(stack) == DEPTH:
            self.stack.removeKey((stack[0],))
        return [*stack[-(DEPTH - 1) :], number]

    def _change(self, item: Ids, how, step: int, out: list) -> None:
        """Takes ``item`` to or from the deletions.  Where neither is turned round, only its own ids are read and written."""
        if not self.turned and not item[0]:
            for i in sorted(item[1]):
                listed = self.deleted.containsKey((i,))
                if how is union and not listed:
                    self.deleted.updateValue((i,), (True,))
                elif how is without and listed:
                    self.deleted.removeKey((i,))
                if listed != (how is union):
                    out.append((step, "deleted", how is union, i))
            return
        old = self._ids(self.deleted)
        turned, new = how((self.turned, old), item)
        if turned != self.turned:
            out.append((step, "turned", turned, None))
        out += [(step, "deleted", False, i) for i in sorted(old - new)] + [(step, "deleted", True, i) for i in sorted(new - old)]
        self._put(self.deleted, old, set(new))
        self.turned = turned

    def _invert(self, inverted: bool, keeper: bool | None) -> tuple[bool, bool | None]:
        ids = self._ids(self.selected)
        if keeper is not None:  # what was kept comes back
            self._put(self.selected, ids, self._ids(self.kept))
            return keeper, None
        if not ids and not inverted:
            return inverted, keeper
        turned, new = without((True, frozenset()), union((self.turned, self._ids(self.deleted)), (inverted, ids)))
        self.kept.clear()
        self._put(self.kept, set(), ids)
        self._put(self.selected, ids, set(new))
        return turned, inverted

    def close(self) -> None:
        """Nothing is held outside the state."""


def stream_edit_changes(log: DataFrame, *, dense: bool = False) -> DataFrame:
    """CHANGES of all sessions of a stream (session, seq, op, sid), with its micro-batches: what each edit changed, and error rows."""
    spark = log.sparkSession
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKSDB)
    try:
        schema = StructType.fromDDL(CHANGES)
        live = log.select("session", "seq", "op", "sid").groupBy("session").transformWithStateInPandas(EditProcessor(dense), schema, "append", "none")
        out = _run(live, "append", "edits", _changed)
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    return spark.read.schema(StructType([*schema, StructField("batch", LongType())])).parquet(out)


def stream_replay_edits(log: DataFrame, *, dense: bool = False) -> DataFrame:
    """(session, all_but, sid) deleted at the end of a stream (session, seq, op, sid).

    Sessions are expected in order of seq; an edit that comes after a later one is applied
    when it comes (``stream_edit_changes`` reports it).
    """
    changes = stream_edit_changes(log, dense=dense)
    turned = changes.where("kind = 'turned'").groupBy("session").agg(F.max_by("flag", "step").alias("all_but"))
    listed = changes.where("kind = 'deleted'").groupBy("session", "sid").agg(F.max_by("flag", "step").alias("flag")).where("flag").select("session", "sid")
    rows = listed.join(turned, "session", "left").select("session", F.coalesce("all_but", F.lit(False)).alias("all_but"), "sid")
    everything = turned.where("all_but").join(listed.select("session").distinct(), "session", "left_anti").select("session", "all_but", F.lit(None).cast("long").alias("sid"))
    return rows.unionByName(everything)
