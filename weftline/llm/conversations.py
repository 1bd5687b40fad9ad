"""Conversation structure repair (operator 13).

A repaired conversation's role initials read ``(s?(ua)+)?``.  Edits of its rows,
in order of turn (nulls first, then role, then the SHA-256 of the text):

    D  delete             3   the only edit of blank and duplicate rows
    I  insert             2   an empty text of the role that may follow
    K  keep               0   only where the role may follow
    R  give another role  2   user or assistant, whichever may follow

and 1 for each truncated row that isn't deleted.  The cheapest edits are found, of
equally cheap ones those whose initials (the audit) come first in ASCII:

1. A cost DP backward over (row, state of the roles) gives each node the cost from it to the end.
2. Arcs that keep to that cost are optimal.  Nodes are ranked by the first letter of
   their least audit, then by the first 2, 4, 8, .. letters: a rank and the rank of the
   node that so many letters lead to.  In each state one role may follow, so a node has one arc a letter
   and equal letters lead to one node.
3. The arc of the least (letter, rank of its target) leads on, and the path is read off pointers that are doubled.

This is done with arrays for about 1 MB of whole conversations at once.  A
conversation of over LONG_ROWS rows or LONG_BYTES bytes isn't gathered: its rows
are cut into parts by range, each part becomes a (min, +) matrix of its costs between
states, a scan over the parts' matrices (a row a part) gives each part its
costs behind it, then its state before it, and its edits follow by the same steps.  Duplicates are
found by the first row of each role and digest.  SHA-256 can't be computed
in pieces, so the texts of a long conversation pass through one task, as a stream: memory
is bounded, time isn't.

Defined results: null role and text read as one space; a null conversation is
one; a null turn counts in no gap; the duplicate of a blank row is blank; a role is its first character, '' of
an empty role; equal rows stand beside each other; a conversation without rows left
has zeros and an empty audit; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, materialise

DELETE, INSERT, REROLE, CUT, NEVER = 3, 2, 2, 1, 1 << 40
#: States: 0 nothing yet, 1 after s, 2 after u, 3 after a.  Where a row of initial other, s, u, a leads (4: nowhere), and what may be put in.
STEP = np.array([[4, 1, 2, 4], [4, 4, 2, 4], [4, 4, 4, 3], [4, 4, 2, 4]])
INTO = np.array([2, 2, 3, 2])
ROLE = {2: "user", 3: "assistant"}
CODE = {"s": 1, "u": 2, "a": 3}
LETTERS, END = "DIKR", np.array([0, NEVER, NEVER, 0])
#: Conversations of more are cut into parts of about PART_ROWS rows.
LONG_ROWS, LONG_BYTES, PART_ROWS = 20_000, 16 << 20, 50_000
#: So many ids of long conversations at most go to every task; more are joined by a shuffle.
BROADCAST_IDS = 100_000
ORDER = ["turn", "role", "digest"]


def _inserted(costs: np.ndarray) -> np.ndarray:
    """Costs (rows, 4) to the end where inserts may come first."""
    user, assistant = np.minimum(costs[:, 2], costs[:, 3] + INSERT), np.minimum(costs[:, 3], costs[:, 2] + INSERT)
    return np.stack([np.minimum(costs[:, 0], user + INSERT), np.minimum(costs[:, 1], user + INSERT), user, assistant], axis=1)


class Repair:
    """Least audits of conversations (or parts) that stand one behind the other.

    ``code`` is each row's initial, ``forced`` whether it must go, ``cut`` whether it is
    truncated, ``sizes`` the rows of each conversation and ``behind`` (conversations, 4)
    the cost of what follows it.  Node 4 p + s is place p in state s; a conversation
    of n rows has n + 1 places.
    """

    def __init__(self, code: np.ndarray, forced: np.ndarray, cut: np.ndarray, sizes: np.ndarray, behind: np.ndarray):
        self.code, self.sizes, self.behind = code, sizes, behind
        self.stay = np.where(forced, NEVER, np.where(cut, CUT, 0))[:, None]
        number = np.arange(len(sizes))
        self.rows = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64) if len(sizes) else np.zeros(0, np.int64)
        self.first = self.rows + number
        self.last = self.first + sizes
        self.cost = np.full((len(code) + len(sizes), 4), NEVER)
        self._costs()

    def _taken(self, rows: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Costs (rows, 4) of deleting, keeping and giving another role to ``rows``, and ``after`` behind them."""
        after = np.concatenate([after, np.full((len(after), 1), NEVER)], axis=1)
        keep = np.take_along_axis(after, STEP.T[self.code[rows]], 1) + self.stay[rows]
        return after[:, :4] + DELETE, keep, after[:, INTO] + REROLE + self.stay[rows]

    def _costs(self) -> None:
        self.cost[self.last] = np.minimum(_inserted(self.behind), NEVER)
        order = np.argsort(-self.sizes, kind="stable")
        for back in range(1, int(self.sizes.max(initial=0)) + 1):
            some = order[: np.searchsorted(-self.sizes[order], -back, side="right")]
            place = self.last[some] - back
            delete, keep, rerole = self._taken(self.rows[some] + self.sizes[some] - back, self.cost[place + 1])
            self.cost[place] = np.minimum(_inserted(np.minimum(np.minimum(delete, keep), rerole)), NEVER)

    def paths(self, state: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Conversation, node and letter (of LETTERS) of each edit of the least paths from ``state``, and the states that they end in."""
        places = len(self.cost)
        row_place = np.delete(np.arange(places), self.last)
        letter, target = np.full((places, 4, 4), False), np.zeros((places, 4, 4), np.int64)  # place, state, arc
        target[:, :, 1] = 4 * np.arange(places)[:, None] + INTO
        letter[:, :, 1] = np.take(self.cost, INTO, axis=1) + INSERT == self.cost
        delete, keep, rerole = self._taken(np.arange(len(self.code)), self.cost[row_place + 1])
        onward = 4 * (row_place + 1)[:, None]
        for arc, cost, to in ((0, delete, np.arange(4)), (2, keep, np.minimum(STEP.T[self.code], 3)), (3, rerole, INTO)):
            letter[row_place, :, arc], target[row_place, :, arc] = cost == self.cost[row_place], onward + to
        ends = self.behind == self.cost[self.last]
        letter[self.last] &= ~ends[:, :, None]
        letter, target = letter.reshape(-1, 4), target.reshape(-1, 4)
        own = np.arange(len(letter))
        done = ~letter.any(axis=1)

        # ranks by the first 1, 2, 4, .. letters of the least audit; 0 is its end
        arc = letter.argmax(axis=1)
        rank, jump, left = np.where(done, 0, arc + 1), np.where(done, own, target[own, arc]), np.where(done, 0, 1)
        while not done[jump].all():
            left = left + left[jump]
            rank = np.unique(rank * (int(rank.max(initial=0)) + 1) + rank[jump], return_inverse=True)[1]
            jump = jump[jump]
        # the ranks select
        arc = np.where(letter, (np.arange(4) + 1) * (int(rank.max(initial=0)) + 1) + rank[target], np.iinfo(np.int64).max).argmin(axis=1)
        pointer = np.where(done, own, target[own, arc])

        start = 4 * self.first + state
        count = left[start]
        who = np.repeat(np.arange(len(start)), count)
        step = np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count)
        node, bit, end = start[who], 0, start
        while bit < int(count.max(initial=0)).bit_length():
            odd = (step >> bit) & 1 == 1
            node[odd] = pointer[node[odd]]
            odd = (count >> bit) & 1 == 1
            end = np.where(odd, pointer[end], end)
            pointer, bit = pointer[pointer], bit + 1
        return who, node, arc[node], end % 4

    def row_of(self, who: np.ndarray, node: np.ndarray) -> np.ndarray:
        """The row at each node of a path."""
        return node // 4 - who


def _prepared(conversations: DataFrame) -> DataFrame:
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    gone = F.coalesce(F.col("dropped"), F.lit(False)) if "dropped" in conversations.columns else F.lit(False)
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.when(~gone, role).alias("role"), F.when(~gone, text).alias("text"), gone.alias("gone"))
    return rows.withColumn("digest", F.sha2("text", 256)).withColumns({"blank": ~F.col("text").rlike(r"[^\x20\x09-\x0D]"), "cut": F.col("text").rlike(r"[^.!?\x20\x09-\x0D][\x20\x09-\x0D]*\z")})


def _only(rows: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    return rows.join(ids.withColumnRenamed("conv_id", "__id"), F.col("conv_id").eqNullSafe(F.col("__id")), how)


def _halves(rows: DataFrame, long_rows: int, long_bytes: int) -> tuple[DataFrame, tuple[DataFrame, DataFrame] | None]:
    """Rows of usual conversations, and those of long ones with their ids (None: there are none)."""
    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("b"))
    ids = materialise(sizes.where((F.col("n") > long_rows) | (F.col("b") > long_bytes)).select("conv_id"))
    n = ids.count()
    if not n:
        return rows, None
    few = F.broadcast(ids) if n <= BROADCAST_IDS else ids
    return _only(rows, few, "left_anti"), (materialise(_only(rows, few, "left_semi")), ids)


# ---- whole conversations


def _fields(conv: pa.DataType) -> tuple[pa.Schema, pa.Schema]:
    one = [("conv_id", conv), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())]
    return pa.schema(one), pa.schema([("conv_id", conv), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole conversations of about a block, from rows sorted by conversation; the last one of a block waits for its end."""
    held: list[pa.RecordBatch] = []
    for batch in blocks(batches, 3):
        ids = batch.column(0).to_pylist()
        cut = batch.num_rows
        while cut and ids[cut - 1] == ids[-1]:
            cut -= 1
        if held and (cut or held[-1].column(0)[0].as_py() != ids[0]):
            if cut:
                yield pa.Table.from_batches([*held, batch.slice(0, cut)])
                held = []
            else:
                yield pa.Table.from_batches(held)
                held = []
        elif cut:
            yield pa.Table.from_batches([batch.slice(0, cut)])
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _solve(table: pa.Table, texts: bool) -> pa.RecordBatch:
    """Results of the whole conversations of ``table``: one row each, or the repaired rows."""
    ids, turns, roles, text, gone, digests, blank, cut = (table.column(c).to_pylist() for c in range(8))
    names, bounds, rows = [], [], []  # conversations, rows left up to the end of each, and those rows
    for k, i in enumerate(ids):
        if not names or i != names[-1]:
            names.append(i)
            bounds.append(len(rows))
        if not gone[k]:
            rows.append(k)
    starts, ends = bounds, [*bounds[1:], len(rows)]
    code, forced, seen = np.zeros(len(rows), np.int64), np.zeros(len(rows), bool), set()
    stats = []
    for a, b in zip(starts, ends, strict=True):
        seen.clear()
        blanks = copies = truncated = illegal = 0
        previous = None
        for n in range(a, b):
            k = rows[n]
            initial, key = roles[k][:1], (roles[k], digests[k])
            code[n] = CODE.get(initial, 0)
            if blank[k]:
                blanks += 1
            elif key in seen:
                copies += 1
            else:
                truncated += cut[k]
            forced[n] = blank[k] or key in seen
            seen.add(key)
            illegal += previous is not None and previous + initial not in ("su", "ua", "au")
            previous = initial
        times = {turns[rows[n]] for n in range(a, b)} - {None}
        stats.append((max(times) - min(times) + 1 - len(times) if times else 0, blanks, copies, truncated, illegal))
    found = Repair(code, forced, np.array([bool(cut[k]) for k in rows], bool), np.subtract(ends, starts).astype(np.int64), np.tile(END, (len(names), 1)))
    who, node, letter, _ = found.paths(np.zeros(len(names), np.int64))
    place = np.cumsum(np.bincount(who, minlength=len(names))) if len(who) else np.zeros(len(names), int)
    own, into = found.row_of(who, node).tolist(), INTO[node % 4].tolist()
    letters = "".join(LETTERS[k] for k in letter.tolist())
    lines: list[list] = [[], [], [], [], []]
    audits, hashes, begun = [], [], 0
    for c, stop in enumerate(place.tolist()):
        audit = letters[begun:stop]
        kept = [(e, roles[rows[n]] if e == "K" else ROLE[r], "" if e == "I" else text[rows[n]]) for e, n, r in zip(audit, own[begun:stop], into[begun:stop], strict=True) if e != "D"]
        if texts:
            for column, values in zip(lines, ([names[c]] * len(kept), range(len(kept)), *zip(*kept, strict=True)) if kept else ([],) * 5, strict=True):
                column.extend(values)
        else:
            hashes.append(hashlib.sha256("\n".join(f"{r}:{t}" for _, r, t in kept).encode()).hexdigest())
        audits.append(audit)
        begun = stop
    one, each = _fields(table.schema.field(0).type)
    if texts:
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(lines, each, strict=True)], schema=each)
    columns = [names, *zip(*stats, strict=True), found.cost[found.first, 0].tolist(), audits, hashes]
    return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(columns, one, strict=True)], schema=one)


def _usual(rows: DataFrame, schema: str, texts: bool) -> DataFrame:
    names = ["conv_id", "turn", "role", "text", "gone", "digest", "blank", "cut"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole(b for b in batches if b.num_rows):
            yield _solve(table, texts)

    return rows.select(*names).repartition("conv_id").sortWithinPartitions("conv_id", *ORDER).mapInArrow(run, schema)


# ---- long conversations, by parts

_KEYS = ["conv_id", "part"]


def _beside(left: DataFrame, right: DataFrame) -> DataFrame:
    """``left`` with the columns of ``right``, by conversation (a null is one) and part."""
    named = right.withColumnsRenamed({c: f"__{c}" for c in _KEYS})
    return left.join(named, F.col("conv_id").eqNullSafe(F.col("__conv_id")) & (F.col("part") == F.col("__part")), "inner").drop("__conv_id", "__part")


def _part_repair(table: pa.Table, behind: np.ndarray) -> Repair:
    """The rows of a part, once for each row of ``behind``."""
    times = len(behind)
    code, forced, cut = (np.tile(table.column(c).to_numpy(), times) for c in ("code", "forced", "cut"))
    return Repair(code.astype(np.int64), forced.astype(bool), cut.astype(bool), np.full(times, table.num_rows), behind)


def _sorted(table: pa.Table) -> pa.Table:
    return table.sort_by("place")


def _scan(matrices: list[list[int]], back: bool, maps: list[list[int]] | None = None) -> list:
    """What stands behind each part (``back``), or the state before each by ``maps``."""
    if not back:
        state, out = 0, []
        for to in maps or []:
            out.append(state)
            state = to[state]
        return out
    behind, out = END, []
    for m in reversed(matrices):
        out.append(behind.tolist())
        behind = np.minimum((np.array(m).reshape(4, 4) + behind).min(axis=1), NEVER)
    return out[::-1]


def _parted(rows: DataFrame, part_rows: int) -> DataFrame:
    """Rows left, cut into parts by range, with ``place`` (unique, in order), ``code``, ``forced`` and the first faults; written once."""
    n = max(1, -(-rows.count() // part_rows))
    # the number of a row in the written table spreads equal rows over parts
    numbered = rows.where(~F.col("gone")).drop("gone").withColumn("salt", F.monotonically_increasing_id())
    ranged = numbered.repartitionByRange(n, "conv_id", *ORDER, "salt").sortWithinPartitions("conv_id", *ORDER, "salt")
    placed = materialise(ranged.withColumns({"part": F.spark_partition_id(), "place": F.monotonically_increasing_id()}).drop("salt"))
    firsts = placed.groupBy("conv_id", "role", "digest").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("first"))
    initial = F.substring("role", 1, 1)
    code = F.coalesce(*[F.when(initial == k, v) for k, v in CODE.items()], F.lit(0))
    flagged = placed.join(firsts, "place", "left").withColumn("again", F.col("first").isNull() & ~F.col("blank"))
    return materialise(flagged.select("conv_id", "part", "place", "turn", "text", "role", initial.alias("initial"), code.alias("code"), "blank", "again", (F.col("blank") | F.col("again")).alias("forced"), "cut"))


def _long(rows: DataFrame, part_rows: int) -> tuple[DataFrame, DataFrame]:
    """One row a conversation without its digest, and the edits (conv_id, part, step, edit, role, text) of long conversations."""
    conv = rows.schema["conv_id"].dataType.simpleString()
    placed = _parted(rows, part_rows)
    small = placed.select("conv_id", "part", "place", "initial", "code", "forced", "cut")

    def summary(table: pa.Table) -> pa.Table:
        table = _sorted(table)
        unit = np.full((4, 4), NEVER)
        np.fill_diagonal(unit, 0)
        found = _part_repair(table, unit)
        initials = table.column("initial").to_pylist()
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        matrix = found.cost[found.first].T.ravel().tolist()  # from state, to state
        return pa.table({"conv_id": table.column("conv_id")[:1], "part": table.column("part")[:1], "matrix": pa.array([matrix], pa.list_(pa.int64())), "begins": initials[:1], "ends": initials[-1:], "illegal": pa.array([illegal], pa.int64())})

    parts = materialise(small.groupBy(*_KEYS).applyInArrow(summary, f"conv_id {conv}, part int, matrix array<long>, begins string, ends string, illegal long"))

    def scan(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        begins, ends, illegal = (table.column(c).to_pylist() for c in ("begins", "ends", "illegal"))
        bad = sum(illegal) + sum(a + b not in ("su", "ua", "au") for a, b in zip(ends, begins[1:], strict=False))
        behind = _scan(table.column("matrix").to_pylist(), True)
        return table.select(_KEYS).append_column("behind", pa.array(behind, pa.list_(pa.int64()))).append_column("illegal", pa.array([bad] * table.num_rows, pa.int64()))

    behind = materialise(parts.groupBy("conv_id").applyInArrow(scan, f"conv_id {conv}, part int, behind array<long>, illegal long"))

    def ends(table: pa.Table) -> pa.Table:
        table = _sorted(table)
        exits = np.tile(np.array(table.column("behind")[0].as_py()), (4, 1))
        found = _part_repair(table, exits)
        to = found.paths(np.arange(4))[3].tolist()
        return pa.table({"conv_id": table.column("conv_id")[:1], "part": table.column("part")[:1], "ends": pa.array([to], pa.list_(pa.int64())), "cost": pa.array([int(found.cost[found.first[0], 0])], pa.int64())})

    maps = _beside(small, behind.drop("illegal")).groupBy(*_KEYS).applyInArrow(ends, f"conv_id {conv}, part int, ends array<long>, cost long")

    def entries(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        states = _scan([], False, table.column("ends").to_pylist())
        return table.select([*_KEYS, "behind", "illegal"]).append_column("state", pa.array(states, pa.int64())).append_column("cost", pa.array([table.column("cost")[0].as_py()] * table.num_rows, pa.int64()))

    begun = materialise(_beside(behind, maps).groupBy("conv_id").applyInArrow(entries, f"conv_id {conv}, part int, behind array<long>, illegal long, state long, cost long"))

    def edits(table: pa.Table) -> pa.Table:
        table = _sorted(table)
        found = _part_repair(table, np.array([table.column("behind")[0].as_py()]))
        who, node, letter, _ = found.paths(np.array([table.column("state")[0].as_py()]))
        own = table.column("place").to_numpy()
        row = np.minimum(found.row_of(who, node), len(own) - 1)
        n = len(node)
        chosen = [LETTERS[k] for k in letter.tolist()]
        return pa.table(
            {
                "conv_id": pa.array([table.column("conv_id")[0].as_py()] * n, table.schema.field("conv_id").type),
                "part": pa.array([table.column("part")[0].as_py()] * n, pa.int32()),
                "step": pa.array(range(n), pa.int64()),
                "edit": pa.array(chosen, pa.string()),
                "place": pa.array([None if e == "I" else int(own[r]) for e, r in zip(chosen, row, strict=True)], pa.int64()),
                "new_role": pa.array([ROLE[r] if e in "IR" else None for e, r in zip(chosen, INTO[node % 4].tolist(), strict=True)], pa.string()),
            }
        )

    steps = materialise(_beside(small, begun.select(*_KEYS, "behind", "state")).groupBy(*_KEYS).applyInArrow(edits, f"conv_id {conv}, part int, step long, edit string, place long, new_role string"))
    audits = steps.groupBy(*_KEYS).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("step", "edit"))), lambda s: s["edit"]), "").alias("audit"))
    audit = audits.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "audit"))), lambda s: s["audit"]), "").alias("audit"))
    faults = placed.groupBy("conv_id").agg(*[F.sum(c.cast("long")).alias(n) for n, c in (("blank", F.col("blank")), ("duplicate", F.col("again")), ("truncated", F.col("cut") & ~F.col("forced")))])
    turns = placed.where("turn IS NOT NULL").groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
    costs = begun.groupBy("conv_id").agg(F.max("illegal").alias("illegal"), F.max("cost").alias("cost"))
    one = faults
    for other in (turns, costs, audit):
        named = other.withColumnRenamed("conv_id", "__id")
        one = one.join(named, F.col("conv_id").eqNullSafe(F.col("__id")), "left").drop("__id")
    one = one.withColumns({"gaps": F.coalesce("gaps", F.lit(0)), "audit": F.coalesce("audit", F.lit(""))})
    texts = placed.select("place", "role", "text")
    lines = steps.where("edit <> 'D'").join(texts, "place", "left").select("conv_id", "part", "step", "edit", F.coalesce("new_role", "role").alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return one, lines


def _hashed(lines: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): texts stream by, in order."""
    conv = lines.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, kind = None, None, None
        for batch in blocks((b for b in batches if b.num_rows), 1):
            kind = batch.column(0).type
            for i, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if digest is not None and i == now:
                    digest.update(b"\n" + line.encode())
                else:
                    if digest is not None:
                        yield _digest_row(now, digest, kind)
                    now, digest = i, hashlib.sha256(line.encode())
        if digest is not None:
            yield _digest_row(now, digest, kind)

    line = F.concat("role", F.lit(":"), "text").alias("line")
    rows = lines.repartition("conv_id").sortWithinPartitions("conv_id", "part", "step")
    return rows.select("conv_id", line).mapInArrow(run, f"conv_id {conv}, repaired_sha256 string")


def _digest_row(conv, digest, kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array([digest.hexdigest()])], ["conv_id", "repaired_sha256"])


# ---- the operator

COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def repair(conversations: DataFrame, *, long_rows: int = LONG_ROWS, long_bytes: int = LONG_BYTES, part_rows: int = PART_ROWS) -> DataFrame:
    """One row a conversation (COLUMNS) of (conv_id, turn, role, text).

    Rows of a true column ``dropped``, if there is one, aren't there, but their conversation is in the result.
    """
    rows = _prepared(conversations)
    conv = rows.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {conv}, " + ", ".join(f"{c} long" for c in COLUMNS[1:7]) + ", audit string, repaired_sha256 string"
    usual, long = _halves(rows, long_rows, long_bytes)
    out = _usual(usual, schema, False)
    if long is None:
        return out
    one, lines = _long(long[0], part_rows)
    hashed = _hashed(lines).withColumnRenamed("conv_id", "__id")
    whole = one.join(hashed, F.col("conv_id").eqNullSafe(F.col("__id")), "left").drop("__id").withColumnRenamed("conv_id", "__id")
    whole = long[1].join(whole, F.col("conv_id").eqNullSafe(F.col("__id")), "left").drop("__id")
    filled = {c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in COLUMNS[1:7]} | {"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest()))}
    return out.unionByName(whole.withColumns(filled).select(*COLUMNS))


def repaired_rows(conversations: DataFrame, *, long_rows: int = LONG_ROWS, long_bytes: int = LONG_BYTES, part_rows: int = PART_ROWS) -> DataFrame:
    """(conv_id, place, edit, role, text): the rows of the repaired conversations; ``place`` rises in order."""
    rows = _prepared(conversations)
    conv = rows.schema["conv_id"].dataType.simpleString()
    usual, long = _halves(rows, long_rows, long_bytes)
    out = _usual(usual, f"conv_id {conv}, place long, edit string, role string, text string", True)
    if long is None:
        return out
    lines = _long(long[0], part_rows)[1]
    place = F.shiftleft(F.col("part").cast("long"), 33) + F.col("step")
    return out.unionByName(lines.select("conv_id", place.alias("place"), "edit", "role", "text"))


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, dropped): rows harmed by crc32(conv_id:turn) modulo 20, for tests and the query.

    0 drops a row, 1 empties its text, 2 takes its marks of an end, 3 repeats it, 4 makes its role user.  Nulls read as one space.
    """
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    harm = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), harm.alias("harm"))
    text: Column = F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.explode(F.sequence(F.lit(1), F.when(F.col("harm") == 3, 2).otherwise(1)))
    out = rows.select("conv_id", "turn", F.when(F.col("harm") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("harm") == 0).alias("dropped"), times.alias("copy"))
    return out.drop("copy")
