"""A stream's result is the batch result."""

import random

import pandas as pd
from compare import rows
from conftest import DATA

from weftline.operators import edits
from weftline.sources import tables as t
from weftline.streaming import jobs


def test_replay_in_micro_batches(spark, tmp_path):
    log = t.edits(spark, DATA)
    for k in range(3):  # files that arrive one after the other
        log.where(f"seq % 1000000 >= {k * 334} AND seq < {(k + 1) * 334}").coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    live = jobs.stream_replay_edits(jobs.files_as_stream(spark, str(tmp_path / "log" / "*.parquet"), log.schema, per_batch=1))
    assert rows(live) == rows(edits.replay_edits(log))


OPS = ["add", "add", "add", "remove", "invert", "delete", "undo", "redo", "clear", "nothing"]


def test_every_edit_in_micro_batches(spark, tmp_path):
    rng = random.Random(7)
    log = [(s, q, rng.choice(OPS), rng.randrange(6)) for s in range(30) for q in range(rng.randrange(1, 90))]
    df = spark.createDataFrame(log, "session long, seq long, op string, sid long")
    for k in range(3):
        df.where(f"seq >= {k * 30} AND seq < {(k + 1) * 30}").coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    stream = jobs.files_as_stream(spark, str(tmp_path / "log" / "*.parquet"), df.schema, per_batch=1)
    assert rows(jobs.stream_replay_edits(stream)) == rows(edits.replay_edits(df))


def test_gaps_and_late_edits_are_reported(spark, tmp_path):
    parts = [[(1, 1, "add", 5), (1, 2, "delete", None), (2, 10, "add", 1)], [(1, 5, "add", 6), (1, 6, "delete", None), (2, 11, "delete", None)], [(1, 3, "undo", None)]]
    for k, part in enumerate(parts):
        spark.createDataFrame(part, "session long, seq long, op string, sid long").coalesce(1).write.parquet(str(tmp_path / f"log{k}"))
    stream = jobs.files_as_stream(spark, str(tmp_path / "log*" / "*.parquet"), spark.read.parquet(str(tmp_path / "log0")).schema, per_batch=1)
    changes = jobs.stream_edit_changes(stream, dense=True)
    assert sorted((r.session, r.step, r.kind, r.sid) for r in changes.where("kind IN ('gap', 'late')").collect()) == [(1, 3, "gap", 5), (1, 5, "late", 3)]
    assert [(r.step, r.flag, r.sid) for r in changes.where("kind = 'deleted' AND session = 1").orderBy("step").collect()] == [(2, True, 5), (4, True, 6), (5, False, 6)]


class _Counted(dict):
    """A map or value state that counts what is written."""

    written = 0

    def updateValue(self, k, v):
        _Counted.written += 1
        self[k] = v

    def removeKey(self, k):
        _Counted.written += 1
        self.pop(k, None)

    def containsKey(self, k):
        return k in self

    getValue = dict.get

    def exists(self):
        return "head" in self

    def get(self):
        return self["head"]

    def update(self, v):
        _Counted.written += 1
        self["head"] = v


class _Handle:
    def getValueState(self, *_):
        return _Counted()

    getMapState = getValueState


def test_an_edit_writes_little_state():
    processor = jobs.EditProcessor(False)
    processor.init(_Handle())

    def run(log):
        _Counted.written = 0
        out = pd.concat(list(processor.handleInputRows((1,), iter([pd.DataFrame(log, columns=["seq", "op", "sid"])]), None)))
        return _Counted.written, len(out)

    assert run([(k, "add", k) for k in range(1_000)])[0] == 1_001
    assert run([(2_000, "delete", None)]) == (1_002, 1_000)  # the ids once, one item of the stack and the head
    for k in range(3):  # beside a thousand deleted ids, each edit writes its entry and the head
        assert run([(3_000 + k, "add", 5_000 + k)]) == (2, 0)
    assert run([(4_000, "delete", None)]) == (3 + 2, 3)
