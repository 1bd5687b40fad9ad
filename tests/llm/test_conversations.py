import hashlib
import heapq
import random
import re
import zlib

import numpy as np
import pytest

from tests.conftest import DATA
from weftline.llm import conversations as c
from weftline.llm import registry

LEGAL = re.compile(r"(s?(ua)+)?\Z")
SCHEMA = "conv_id long, turn long, role string, text string"


def plain_harm(rows):
    """Rows after damage, by the letter of the contract."""
    out, ids = [], []
    for i, t, r, x in rows:
        ids.append(i)
        shown = [" " if v is None else v for v in (i, t)]
        harm = zlib.crc32(f"{shown[0]}:{shown[1]}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        if harm == 0:
            continue
        x = "" if harm == 1 else re.sub("[.!?]", "", x) if harm == 2 else x
        out += [(i, t, "user" if harm == 4 else r, x)] * (2 if harm == 3 else 1)
    return out, set(ids)


def plain_repair(rows):
    """Cheapest edits of one conversation by trying all, cheapest and least first."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).hexdigest()))
    seen, faults, must = set(), {"blank": 0, "duplicate": 0, "truncated": 0}, []
    for _, _, role, text in rows:
        kind = None
        if not re.search(r"[^\x20\x09-\x0D]", text):
            kind = "blank"
        elif (role, text) in seen:
            kind = "duplicate"
        elif re.findall(r"[^\x20\x09-\x0D]", text)[-1] not in ".!?":
            kind = "truncated"
        seen.add((role, text))
        must.append(kind)
        if kind:
            faults[kind] += 1
    turns = {r[1] for r in rows} - {None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    initials = [r[2][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    heap, been = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, n, made, kept = heapq.heappop(heap)
        if (n, made[:1] if len(made) < 2 else made[-1] * 2) in been:  # was there cheaper, or as cheap by a lesser audit
            continue
        been.add((n, made[:1] if len(made) < 2 else made[-1] * 2))
        if n == len(rows) and LEGAL.match(made):
            return gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest()
        begun = lambda s: LEGAL.match(s) or LEGAL.match(s + "a") or LEGAL.match(s + "ua")
        for role in ("user", "assistant"):
            if begun(made + role[0]):
                heapq.heappush(heap, (cost + 2, audit + "I", n, made + role[0], (*kept, f"{role}:")))
        if n < len(rows):
            _, _, role, text = rows[n]
            heapq.heappush(heap, (cost + 3, audit + "D", n + 1, made, kept))
            if must[n] not in ("blank", "duplicate"):
                more = cost + (must[n] == "truncated")
                if role and begun(made + role[0]):
                    heapq.heappush(heap, (more, audit + "K", n + 1, made + role[0], (*kept, f"{role}:{text}")))
                for new in ("user", "assistant"):
                    if begun(made + new[0]):
                        heapq.heappush(heap, (more + 2, audit + "R", n + 1, made + new[0], (*kept, f"{new}:{text}")))


def expected(rows):
    kept, ids = plain_harm(rows)
    return {i: plain_repair([r for r in kept if r[0] == i]) for i in ids}


def got(df):
    return {r.conv_id: tuple(r[k] for k in c.COLUMNS[1:]) for r in df.collect()}


def some(seed, n=60):
    rng = random.Random(seed)
    texts = ["Yes.", "No", " ", "", None, "So. ", "Why?\n", "é", "Well!"]
    rows = []
    for i in [*range(n), None]:
        rows += [(i, rng.choice([None, *range(5)]), rng.choice(["user", "assistant", "assistant", "system", None, "", "tool"]), rng.choice(texts)) for _ in range(rng.randrange(7))]
    rng.shuffle(rows)
    return rows


def test_query_by_the_letter(spark):
    rows = [tuple(r[k] for k in ("conv_id", "turn", "role", "text")) for r in spark.read.parquet(f"{DATA}/conversations.parquet").collect()]
    assert got(registry.queries()["op13_conversations"](spark, DATA)) == expected(rows)


@pytest.mark.parametrize("long", [{}, {"long_rows": 2, "part_rows": 3}, {"long_bytes": 0, "part_rows": 1}])
def test_every_kind(spark, long):
    rows = some(3)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS place", "'x' AS digest", "2 AS part")
    assert got(c.repair(c.damaged(df), **long)) == expected(rows)


@pytest.mark.parametrize("long", [{}, {"long_rows": 5, "part_rows": 7}])
def test_long_conversation_and_texts(spark, long):
    rng = random.Random(5)
    rows = [(1, t, rng.choice(["user", "assistant"]), f"{rng.choice(['a', 'b', 'c'])}{rng.randrange(40)}{rng.choice(['.', ''])}") for t in range(200)]
    rows += [(2, 0, "user", "Hm. " * 50_000), (2, 1, "assistant", "Ja.")]
    df = c.damaged(spark.createDataFrame(rows, SCHEMA))
    want = expected(rows)
    assert got(c.repair(df, **long)) == want
    lines = {}
    for r in c.repaired_rows(df, **long).orderBy("conv_id", "place").collect():
        lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    for i, w in want.items():
        assert hashlib.sha256("\n".join(lines.get(i, [])).encode()).hexdigest() == w[-1]


def test_no_rows_and_nothing_left(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert c.repair(c.damaged(empty)).count() == 0 and c.repaired_rows(empty).count() == 0
    gone = spark.createDataFrame([(7, 1, "user", "Hi.", True)], SCHEMA + ", dropped boolean")
    assert got(c.repair(gone)) == {7: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())}
    assert got(c.repair(gone, long_rows=0)) == got(c.repair(gone))


def test_ranks_follow_least_audits():
    # equal costs: D before I before K before R
    found = c.Repair(np.array([2, 2, 3, 3]), np.zeros(4, bool), np.zeros(4, bool), np.array([4]), np.array([c.END]))
    letters = "".join(c.LETTERS[k] for k in found.paths(np.array([0]))[2])
    assert letters == plain_repair([(1, k, r, f"{k}.") for k, r in enumerate(["user", "user", "assistant", "assistant"])])[6]
