"""Sainte-Laguë quotas against a loop that hands out one block at a time, and the drawing of blocks."""

import heapq
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from weftline.llm import mixing


def one_by_one(votes, blocks):
    """Quota of each party: each block goes to the highest quotient, ties to the first party."""
    heap = [(-Fraction(v), i, 0) for i, v in enumerate(votes) if v > 0]
    heapq.heapify(heap)
    got = [0] * len(votes)
    for _ in range(blocks if heap else 0):
        _, i, k = heapq.heappop(heap)
        got[i] += 1
        heapq.heappush(heap, (-Fraction(votes[i]) / (2 * k + 3), i, k + 1))
    return got


@pytest.mark.parametrize("seed", range(4))
def test_quotas_are_the_loop(spark, seed):
    random.seed(seed)
    votes = [random.choice([0.0, 1.0, random.randint(1, 9) * 1.0, random.random() * 5000]) for _ in range(60)]
    names = [None if i >= 55 else f"s{i // 5:02}" for i in range(60)]
    df = spark.createDataFrame([(n, i % 5, v) for i, (n, v) in enumerate(zip(names, votes, strict=True))], "source string, shard long, votes double")
    for blocks in (0, 1, 17, 1000):
        got = {(r.source, r.shard): r.quota for r in mixing.quotas(df, blocks).collect()}
        assert [got[n, i % 5] for i, n in enumerate(names)] == one_by_one(votes, blocks)
        assert sum(got.values()) == blocks


def test_small_sources_come_near_their_targets(spark):
    rows = [(i, "w " * (1 + i % 40), f"s{i % 30}") for i in range(900)] + [(1000 + i, "v " * 3, f"t{i}") for i in range(3)] + [(2000, None, None), (2001, "a b c", None), (2001, "a b c", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"target": F.lit(0), "draw": F.lit("x"), "SIZE": F.lit(1)})
    made = mixing.plan(df, shard_words=100, shard_rows=10)
    assert made.count() == len(rows) and made.where("taken > 2 * size OR taken < 0 OR (size > 0 AND taken IS NULL)").isEmpty()
    of = df.select("doc_id", "source").distinct()
    sums = made.join(of, "doc_id").groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.first("source_size").alias("size")).collect()
    assert all(abs(r.taken - r.target) <= max(16, 0.1 * r.target) for r in sums), sums
    assert len({r.taken for r in made.where("size > 100").collect()} | {1, 2, 3}) > 2


def shared_again(sizes, weights, budget, repeats):
    """Targets by sharing the excess of full sources again until none is above."""
    left, full = budget * sum(sizes), set()
    while True:
        open_ = [i for i in range(len(sizes)) if i not in full]
        level = left / sum(weights[i] for i in open_) if open_ else 0
        over = [i for i in open_ if level * weights[i] > repeats * sizes[i]]
        if not over:
            return [repeats * s if i in full else level * weights[i] for i, s in enumerate(sizes)]
        full |= set(over)
        left -= sum(repeats * sizes[i] for i in over)


@pytest.mark.parametrize("sizes", [[1] * 1000, [7, 7, 7, 7], [0, 5, 5, 100, 1, 1, 1, 40], [3] * 5 + [90] * 4, [0, 0], [10**6, 1, 1]])
def test_targets_of_equal_sources(spark, sizes):
    df = spark.createDataFrame([(f"s{i:04}", s) for i, s in enumerate(sizes)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    want = shared_again(sizes, [mixing.WEIGHTS[i % 3] for i in range(len(sizes))], 1.5, 2)
    assert [got[f"s{i:04}"] for i in range(len(sizes))] == pytest.approx(want)
    assert sum(want) == pytest.approx(1.5 * sum(sizes))


def test_small_sources_of_a_word(spark):
    rows = [(i, "w", f"s{i:04}") for i in range(1000)]
    made = mixing.plan(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert abs(sum(r.taken for r in made) - 1500) <= 15 and all(r.taken <= 2 for r in made)
    beside = mixing.plan(spark.createDataFrame([*((i, "a b c " * 100, "big") for i in range(60)), (99, "v", "tiny")], "doc_id long, text string, source string")).collect()
    assert {r.taken for r in beside if r["size"] == 1} == {2}  # its target is 2


def test_equal_rows_and_null_ids_are_dealt_evenly(spark):
    rows = [(None, "a b", "s")] * 300 + [(None, f"c {k}", "s") for k in range(300)] + [(7, f"d {k}", "s") for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    made = mixing.plan(df, shard_rows=50)
    assert made.count() == 900 and sorted(map(tuple, made.collect()), key=str) == sorted(map(tuple, mixing.plan(df.repartition(3), shard_rows=50).collect()), key=str)
    sizes = mixing.dealt(df, shard_rows=50).groupBy("shard").count().collect()
    assert len(sizes) == 18 and max(r["count"] for r in sizes) < 100


def test_empty_mix(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert [(r.taken, r.target) for r in mixing.plan(df).collect()] == [(0, 0.0)] * 2
    assert mixing.apply(df).columns == df.columns and mixing.apply(df).isEmpty()
