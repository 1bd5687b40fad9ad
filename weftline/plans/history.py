"""Queries of edit logs and streams (F08-F10, T)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.affine import AXES
from ..operators import edits
from ..sources import tables as t
from ..sources.files import scratch
from ..streaming import jobs
from .base import Plans

plan = Plans()


def _replay_sql(log: str, result: str) -> str:
    """Replays ``log`` (session, seq, op, sid, roi, version) an edit at a time in every session; ``result`` selects from ``session_end``."""
    last, again = "u[len(u)]", "r[len(r)]"
    current = ", ".join(
        f"CASE WHEN op = 'modify' AND roi = {k} THEN version WHEN op = 'undo' AND {last}.roi = {k} THEN {last}.a WHEN op = 'redo' AND {again}.roi = {k} THEN {again}.b ELSE cur[{k + 1}] END" for k in range(5)
    )
    item = "STRUCT(ids BIGINT[], roi BIGINT, a BIGINT, b BIGINT)"
    return f"""WITH RECURSIVE edit_log AS ({log}), edit AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY seq) AS n FROM edit_log),
replayed AS (SELECT DISTINCT session, 0::BIGINT AS n, []::BIGINT[] AS sel, []::BIGINT[] AS del, [NULL, NULL, NULL, NULL, NULL]::BIGINT[] AS cur, []::{item}[] AS u, []::{item}[] AS r FROM edit_log
UNION ALL SELECT replayed.session, edit.n,
CASE WHEN op = 'add' THEN list_distinct(list_append(sel, sid)) WHEN op = 'remove' THEN list_filter(sel, lambda q: q <> sid) WHEN op = 'delete' THEN []::BIGINT[] ELSE sel END,
CASE WHEN op = 'delete' THEN list_distinct(list_concat(del, sel)) WHEN op = 'undo' AND len(u) > 0 AND {last}.roi IS NULL THEN list_filter(del, lambda q: NOT list_contains({last}.ids, q))
WHEN op = 'redo' AND len(r) > 0 AND {again}.roi IS NULL THEN list_distinct(list_concat(del, {again}.ids)) ELSE del END,
[{current}],
CASE WHEN op = 'modify' THEN list_append(u, {{'ids': []::BIGINT[], 'roi': roi, 'a': cur[roi + 1], 'b': version}}::{item})[-20:] WHEN op = 'delete' AND len(sel) > 0 THEN list_append(u, {{'ids': sel, 'roi': NULL, 'a': NULL, 'b': NULL}}::{item})[-20:]
WHEN op = 'undo' THEN u[1:greatest(0, len(u) - 1)] WHEN op = 'redo' AND len(r) > 0 THEN list_append(u, {again})[-20:] ELSE u END,
CASE WHEN op = 'modify' OR op = 'delete' AND len(sel) > 0 THEN []::{item}[] WHEN op = 'undo' AND len(u) > 0 THEN list_append(r, {last})[-20:] WHEN op = 'redo' THEN r[1:greatest(0, len(r) - 1)] ELSE r END
FROM replayed JOIN edit ON edit.session = replayed.session AND edit.n = replayed.n + 1),
session_end AS (SELECT * FROM replayed QUALIFY n = max(n) OVER (PARTITION BY session)) {result}"""


_EDITS = _replay_sql(
    "SELECT user_id AS session, event_id AS seq, CASE event_type WHEN 'click' THEN 'add' WHEN 'view' THEN 'remove' WHEN 'signup' THEN 'redo' WHEN 'error' THEN 'undo' WHEN 'purchase' THEN 'delete' END AS op, event_id % 500 AS sid, NULL::BIGINT AS roi, NULL::BIGINT AS version FROM events",
    "SELECT session, false AS all_but, unnest(del) AS sid FROM session_end",
)
_REGION_EDITS = _replay_sql(
    "SELECT user_id AS session, event_id AS seq, CASE event_type WHEN 'purchase' THEN 'modify' WHEN 'error' THEN 'undo' WHEN 'signup' THEN 'redo' ELSE 'none' END AS op, NULL::BIGINT AS sid, event_id % 5 AS roi, event_id AS version FROM events",
    ", current_region AS (SELECT session, unnest(cur) AS version FROM session_end) SELECT session, version % 5 AS roi_id, version, (version % 25)::INT AS i, (version // 25 % 25)::INT AS j, (version // 625 % 25)::INT AS k FROM current_region WHERE version IS NOT NULL",
)
_BOTH_EDITS = _replay_sql(
    "SELECT user_id AS session, event_id AS seq, CASE WHEN event_type = 'click' THEN 'add' WHEN event_type = 'view' THEN 'remove' WHEN event_type = 'signup' THEN 'redo' WHEN event_type = 'error' THEN 'undo' WHEN event_id % 2 = 0 THEN 'delete' ELSE 'modify' END AS op, event_id % 500 AS sid, event_id % 5 AS roi, event_id AS version FROM events",
    ", current_region AS (SELECT session, unnest(cur) AS version FROM session_end) SELECT session, false AS all_but, unnest(del) AS sid, NULL::BIGINT AS roi_id, NULL::BIGINT AS version FROM session_end UNION ALL SELECT session, NULL, NULL, version % 5, version FROM current_region WHERE version IS NOT NULL",
)


@plan(_EDITS)
def replay_edits(spark, d):
    return edits.replay_edits(t.edits(spark, d))


@plan("""WITH o AS (SELECT user_id AS session, event_id AS seq, event_type, event_id % 500 AS sid FROM events), c AS (SELECT session, max(seq) FILTER (WHERE event_type IN ('view', 'purchase')) AS last FROM o GROUP BY session)
SELECT DISTINCT o.session, false AS all_but, sid FROM o JOIN c ON o.session = c.session WHERE event_type = 'click' AND seq > coalesce(last, -1)""")
def clear_selection(spark, d):
    log = t.edits(spark, d).withColumn("op", F.when(F.col("op") == "remove", "clear").otherwise(F.col("op")))
    return edits.replay_selection(log)


@plan(_BOTH_EDITS)
def replay_history(spark, d):
    """Deletions and region edits on one stack: each second purchase draws a region's new version."""
    e = F.col("seq")
    log = t.edits(spark, d).withColumn("op", F.when((F.col("op") == "delete") & (e % 2 != 0), "modify").otherwise(F.col("op")))
    return edits.replay_history(log.select("session", "seq", "op", "sid", (e % 5).alias("roi_id"), e.alias("version")))


@plan(_REGION_EDITS)
def replay_roi_edits(spark, d):
    """Current voxels: each purchase draws one voxel of a new version of a region."""
    e = F.col("event_id")
    op = F.when(F.col("event_type") == "purchase", "modify").when(F.col("event_type") == "error", "undo").when(F.col("event_type") == "signup", "redo").otherwise("none")
    events = t.read(spark, d, "events")
    log = events.select(F.col("user_id").alias("session"), e.alias("seq"), op.alias("op"), (e % 5).alias("roi_id"), e.alias("version"))
    versions = events.where("event_type = 'purchase'").select((e % 5).alias("roi_id"), e.alias("version"), *[(F.floor(e / s) % 25).cast("int").alias(c) for c, s in zip("ijk", (1, 25, 625), strict=True)])
    return edits.current_voxels(versions, edits.replay_roi_edits(log))


def _in_files(spark, df, name: str, key: str, n: int = 4) -> tuple[str, object]:
    """``df`` as files in order of ``key``: a stream's arrivals."""
    path = scratch(spark, name)
    df.repartitionByRange(n, key).write.parquet(path)
    return path, df.schema


@plan(_EDITS)
def stream_replay_edits(spark, d):
    path, schema = _in_files(spark, t.edits(spark, d), "edit-log", "seq")
    return jobs.stream_replay_edits(jobs.files_as_stream(spark, f"{path}/*.parquet", schema, per_batch=4))


@plan("SELECT i, j, k, value::BIGINT AS n FROM img")
def stream_density(spark, d):
    li = t.read(spark, d, "lineitem")
    arriving = jobs.files_as_stream(spark, f"{d}/lineitem.parquet", li.schema)
    points = arriving.select((F.col("l_quantity") - 25).alias("x"), (F.col("l_extendedprice") / 2000 - 26).alias("y"), (500 * F.col("l_discount") - 25).alias("z"))
    return jobs.stream_density(points, t.GRID, t.DIMS)


@plan("SELECT least(label_a, label_b) AS a, greatest(label_a, label_b) AS b, count(*) AS n FROM lab WHERE label_a > 0 AND label_b > 0 GROUP BY 1, 2")
def stream_connectivity(spark, d):
    rows = t.read(spark, d, "embeddings")
    arriving = jobs.files_as_stream(spark, f"{d}/embeddings.parquet", rows.schema)
    at = lambda k: F.get("embedding", k).cast("double") * 100.0
    ends = arriving.select(F.col("vec_id").alias("sid"), *[at(k).alias(f"{a}0") for k, a in enumerate(AXES)], *[at(60 + k).alias(f"{a}1") for k, a in enumerate(AXES)])
    return jobs.stream_connectivity(ends, t.parcels(spark, d), t.GRID)
