"""Replay of edit logs: selections, deletions, undo and redo.

A session's log is a state machine, so its rows are folded in order; sessions
are spread over tasks and read as a stream, never gathered.  The state holds
ids only.  A selection may be turned round without naming all other ids, so a
set is (all_but, ids): the ids, or all but them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Set
from dataclasses import dataclass, field
from typing import Any, NamedTuple

import pandas as pd
from pyspark.sql import DataFrame

DEPTH = 20
Ids = tuple[bool, Set[int]]
NONE: Ids = (False, frozenset())


def union(a: Ids, b: Ids) -> Ids:
    match a[0], b[0]:
        case False, False:
            return False, a[1] | b[1]
        case True, True:
            return True, a[1] & b[1]
        case True, False:
            return True, a[1] - b[1]
    return True, b[1] - a[1]


def without(a: Ids, b: Ids) -> Ids:
    """What is in ``a`` and not in ``b``."""
    not_b = (not b[0], b[1])
    kept = union((not a[0], a[1]), (not not_b[0], not_b[1]))
    return not kept[0], kept[1]


@dataclass
class Session:
    """Selection, deletions and the two stacks of one session.

    The selection's set is this object's own and changes in place; a deletion
    hands it to the stack and begins another.
    """

    selected: Ids = field(default_factory=lambda: (False, set()))
    deleted: Ids = NONE
    keeper: Ids | None = None  # what an inversion would restore
    undo: list[Ids] = field(default_factory=list)
    redo: list[Ids] = field(default_factory=list)

    def apply(self, op: str, sid: int | None = None) -> None:
        """One edit; unknown ones do nothing."""
        if op in ("add", "remove"):
            all_but, ids = self.selected
            (ids.add if (op == "add") != all_but else ids.discard)(sid)
            self.keeper = None
        elif op == "clear":
            self.selected, self.keeper = (False, set()), None
        elif op == "invert":
            if self.keeper is not None:
                self.selected, self.keeper = self.keeper, None
            elif self.selected != NONE:
                all_but, ids = without((True, frozenset()), union(self.deleted, self.selected))
                self.selected, self.keeper = (all_but, set(ids)), self.selected
        elif op == "delete" and self.selected != NONE:
            _push(self.undo, self.selected)
            self.redo.clear()
            self.deleted = union(self.deleted, self.selected)
            self.selected, self.keeper = (False, set()), None
        elif op == "undo" and self.undo:
            last = self.undo.pop()
            _push(self.redo, last)
            self._take_back(last)
        elif op == "redo" and self.redo:
            last = self.redo.pop()
            _push(self.undo, last)
            self._repeat(last)

    def _take_back(self, last: Ids) -> None:
        self.deleted = without(self.deleted, last)

    def _repeat(self, last: Ids) -> None:
        self.deleted = union(self.deleted, last)


def _push(stack: list, item: Any) -> None:
    stack.append(item)
    if len(stack) > DEPTH:
        stack.pop(0)


@dataclass
class RoiSession:
    """Current version of each region, with one stack for all of a session's regions."""

    current: dict[int, int] = field(default_factory=dict)
    undo: list[tuple[int, int | None, int]] = field(default_factory=list)
    redo: list[tuple[int, int | None, int]] = field(default_factory=list)

    def apply(self, op: str, roi_id: int | None = None, version: int | None = None) -> None:
        if op == "modify":
            _push(self.undo, (roi_id, self.current.get(roi_id), version))
            self.redo.clear()
            self.current[roi_id] = version
        elif op == "undo" and self.undo:
            last = self.undo.pop()
            _push(self.redo, last)
            self._set(last[0], last[1])
        elif op == "redo" and self.redo:
            last = self.redo.pop()
            _push(self.undo, last)
            self._set(last[0], last[2])

    def _set(self, roi_id: int, version: int | None) -> None:
        if version is None:
            self.current.pop(roi_id, None)
        else:
            self.current[roi_id] = version


class RegionEdit(NamedTuple):
    roi_id: int
    before: int | None
    after: int


@dataclass
class History(Session):
    """Deletions and region edits of one session on one stack: undo takes back the last of either kind."""

    regions: RoiSession = field(default_factory=RoiSession)

    def apply(self, op: str, sid: int | None = None, roi_id: int | None = None, version: int | None = None) -> None:
        if op != "modify":
            return super().apply(op, sid)
        _push(self.undo, RegionEdit(roi_id, self.regions.current.get(roi_id), version))
        self.redo.clear()
        self.regions.current[roi_id] = version

    def _take_back(self, last: Ids | RegionEdit) -> None:
        if isinstance(last, RegionEdit):
            self.regions._set(last.roi_id, last.before)
        else:
            super()._take_back(last)

    def _repeat(self, last: Ids | RegionEdit) -> None:
        if isinstance(last, RegionEdit):
            self.regions._set(last.roi_id, last.after)
        else:
            super()._repeat(last)

    def end(self) -> list[tuple[bool | None, int | None, int | None, int | None]]:
        """(all_but, sid, roi_id, version) rows: what is deleted, then the regions' versions."""
        return [(a, s, None, None) for a, s in id_rows(self.deleted)] + [(None, None, r, v) for r, v in sorted(self.regions.current.items())]


def id_rows(ids: Ids) -> list[tuple[bool, int | None]]:
    """(all_but, sid) rows of a set; one row with a null for 'all'."""
    if not ids[1]:
        return [(True, None)] if ids[0] else []
    return [(ids[0], s) for s in sorted(ids[1])]


def _fold(log: DataFrame, columns: list[str], start: Callable[[], Any], rows: Callable[[Any], Iterable[tuple]], schema: str, names: list[str]) -> DataFrame:
    """Applies ``columns`` of each session's rows in order of seq to a state, and returns ``rows`` of its end."""

    def frame(done: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame({n: pd.Series([r[k] for r in done], dtype="boolean" if n == "all_but" else "Int64") for k, n in enumerate(names)})

    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, state = None, None
        done: list[tuple] = []
        for batch in batches:
            for s, *edit in batch.itertuples(index=False):
                if s != session:
                    if state is not None:
                        done += [(session, *r) for r in rows(state)]
                    session, state = s, start()
                state.apply(*edit)
            if len(done) > 10_000:
                yield frame(done)
                done = []
        if state is not None:
            done += [(session, *r) for r in rows(state)]
        yield frame(done)

    ordered = log.repartition("session").sortWithinPartitions("session", "seq")
    return ordered.select("session", *columns).mapInPandas(replay, schema)


def replay_edits(log: DataFrame) -> DataFrame:
    """(session, all_but, sid): what each session of ``log`` (session, seq, op, sid) has deleted at its end."""
    return _fold(log, ["op", "sid"], Session, lambda s: id_rows(s.deleted), "session long, all_but boolean, sid long", ["session", "all_but", "sid"])


def replay_selection(log: DataFrame) -> DataFrame:
    """(session, all_but, sid): what each session has selected at its end."""
    return _fold(log, ["op", "sid"], Session, lambda s: id_rows(s.selected), "session long, all_but boolean, sid long", ["session", "all_but", "sid"])


def replay_roi_edits(log: DataFrame) -> DataFrame:
    """(session, roi_id, version): the version of each region that ``log`` (session, seq, op, roi_id, version) ends with."""
    return _fold(log, ["op", "roi_id", "version"], RoiSession, lambda s: sorted(s.current.items()), "session long, roi_id long, version long", ["session", "roi_id", "version"])


def replay_history(log: DataFrame) -> DataFrame:
    """(session, all_but, sid, roi_id, version): deletions and region versions that ``log`` (session, seq, op, sid, roi_id, version) ends with.

    Both kinds of edits share one stack of each session.  A row names either a
    deletion or a region.
    """
    names = ["session", "all_but", "sid", "roi_id", "version"]
    return _fold(log, ["op", "sid", "roi_id", "version"], History, History.end, "session long, all_but boolean, sid long, roi_id long, version long", names)


def current_voxels(versions: DataFrame, current: DataFrame) -> DataFrame:
    """Rows of ``versions`` (roi_id, version, ...) that are current."""
    return versions.join(current, ["roi_id", "version"])


def visible_after(universe: DataFrame, deleted: DataFrame, session: int) -> DataFrame:
    """(sid) of ``universe`` that a session's deletions leave."""
    own = deleted.where(deleted.session == session)
    but = own.where("all_but").select("sid")
    if own.where("all_but").isEmpty():
        return universe.select("sid").join(own.select("sid"), "sid", "left_anti")
    return universe.select("sid").join(but, "sid", "left_semi")
