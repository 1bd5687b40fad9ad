"""Byte-level BPE against the tiktoken library, and the heap against the fold."""

import hashlib
import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from weftline.llm import byte_bpe as B

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def encoding():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=B.read_ranks(PATH), special_tokens={})


def texts():
    random.seed(1)
    letters = " \n\t  \x1c\x85᠎　aAbBtheing'sé漢😀1²Ⅷ½_-.!́�"
    out = ["", None, "a" * 3000, "ab" * 900 + " x", "it's I'll  don't\n\n x  ", "\n", " ", "<|endoftext|>", "the the the", "the the the"]
    out += ["".join(random.choice(letters) for _ in range(random.randint(1, 80))) for _ in range(600)]
    return out + ["".join(random.choice("etaoinshr") for _ in range(random.randint(1, 40))) for _ in range(400)]


@pytest.mark.parametrize("cached", [0, 100_000])
def test_round_trip(spark, encoding, cached):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([(i, t, "old") for i, t in rows], "doc_id long, text string, ids string")
    coded = B.decode(B.encode(df, PATH, P.PATTERN, cache_words=cached, long_word=1000), PATH)
    got = {r.doc_id: r for r in coded.collect()}
    assert coded.columns == ["doc_id", "text", "ids", "decoded"]
    for i, t in rows:
        assert np.frombuffer(bytes(got[i].ids), "<u4").tolist() == encoding.encode_ordinary(t or ""), t
        assert bytes(got[i].decoded) == (t or "").encode()


def test_digests(spark, encoding):
    df = spark.createDataFrame([(1, "Hello there"), (2, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in B.digests(df, PATH, P.PATTERN).collect()}
    ids = np.array(encoding.encode_ordinary("Hello there"), "<u4")
    assert (rows[1].n_tokens, rows[1].ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
    assert (rows[2].n_tokens, rows[2].decoded_sha256) == (0, hashlib.sha256(b"").hexdigest())
    assert B.digests(df.limit(0), PATH, P.PATTERN).count() == 0


def test_heap_is_the_plain_loop():
    ranks = B.read_ranks(PATH)
    random.seed(2)
    for _ in range(300):
        word = "".join(random.choice("abcdeghinorst ") for _ in range(random.randint(1, 30))).encode()
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 40))
            if parts[best] + parts[best + 1] not in ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        assert B.merge_long(word, ranks) == [ranks[p] for p in parts]


def test_parts_join_to_the_text():
    for t in map(lambda t: t or "", texts()):
        for irregular in (True, False):
            first, *others = B.parts_of(t, irregular)
            assert first + "".join(p if p[:1] == "\n" and not irregular else " " + p for p in others) == t


def test_small_blocks_other_patterns_and_kept_columns(spark, encoding):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("more", F.lit(1))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    coded = B.encode(df, PATH, P.PATTERN + "|(?!)", keep=["doc_id"], decoded_col="bytes", cache_words=100, block_chars=500)
    assert coded.columns == ["doc_id", "ids", "bytes"]
    got = {r.doc_id: r for r in coded.collect()}
    for i, t in rows:
        assert np.frombuffer(bytes(got[i].ids), "<u4").tolist() == encoding.encode_ordinary(t or ""), t
        assert bytes(got[i].bytes) == (t or "").encode()
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_plan_is_short(spark):
    df = spark.createDataFrame([(1, "Hello there")], "doc_id long, text string")
    plan = B.digests(df, PATH, P.PATTERN)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and len(plan) < 4_000_000


def test_every_merge_by_rank(spark):
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"abc": 257}
    B.check_ranks(ranks)
    for wrong in ({b"abc": 256, b"ab": 257}, {b"abc": 256}, {b"ab": 1 << 17}):
        with pytest.raises(ValueError):
            B.check_ranks({bytes([b]): b for b in range(256)} | wrong)
    literal = B.rank_literal(ranks)
    words = [list(w) for w in (b"", b"a", b"ab", b"abcab", b"cabc")]
    got = spark.createDataFrame([(words,)], "w array<array<long>>").select(B.fold_words(F.col("w"), literal).alias("w")).first().w
    assert got == [[], [97], [256], [257, 256], [99, 257]]


def test_fold_computes_a_key_once_and_takes_no_slices(spark):
    literal = B.rank_literal({bytes([b]): b for b in range(256)} | {b"ab": 256, b"abc": 257})
    words = spark.createDataFrame([([[97, 98]],)], "w array<array<long>>").select(B.fold_words(F.col("w"), literal).alias("w"))
    plan = words._jdf.queryExecution().optimizedPlan().toString()
    assert "slice(" not in plan and plan.count(" % ") <= 4


def test_no_shuffle_beside_the_ranks(spark, monkeypatch):
    df = spark.createDataFrame([(1, "Hello there, hello there")], "doc_id long, text string").repartition(3)
    plans, collect = [], type(df).toArrow
    monkeypatch.setattr(type(df), "toArrow", lambda self: (plans.append(self._jdf.queryExecution().executedPlan().toString()), collect(self))[1])
    assert B.digests(df, PATH, P.PATTERN).count() == 1
    assert len(plans) == 1 and "MapInArrow" in plans[0] and "Exchange" not in plans[0]


def test_only_odd_parts_meet_the_pattern_in_python():
    known = B._Known(B._Known.packed(pa.array([b" the", b"."], pa.binary()), np.array([7, 8, 9], "<u2"), np.array([2, 1])))
    cutter, seen = B._Cutter(P.PATTERN, known), []
    find, cutter.find = cutter.find, lambda unit: (seen.append(unit), find(unit))[1]
    texts = pa.array(["a the cat, naïve. the. x×y it's", None, "the the!"])
    cut = B.cut_block(cutter, texts, B.irregular_texts(texts), "<u2")
    assert sorted(seen) == ["", " ", " it's", " x×y", "a", "the"]
    words = list(cutter.rest)
    for text, ids, at, which in zip(texts.to_pylist(), *cut, strict=True):
        some = [(i // 2, words[k]) for i, k in zip(np.frombuffer(at, "<i4").tolist(), np.frombuffer(which, "<i4").tolist(), strict=True)]
        ids, got = np.frombuffer(ids, "<u2").tolist(), []
        for w in find(text or ""):
            if w == " the" or w == ".":
                n = 2 if w == " the" else 1
                assert ids[len(got) : len(got) + n] == ([7, 8] if n == 2 else [9])
                got += [0] * n
            else:
                assert some.pop(0) == (len(got), w.encode())
        assert len(got) == len(ids) and not some


def test_ids_are_put_in_place_for_many_rows_at_once():
    new = B._New.of(pa.array([[5], [], [6, 7]], pa.list_(pa.int64())), [b"long"], {b"long": 9, **{bytes([b]): 0 for b in range(256)}} | {b"lo": 1, b"ng": 2}, "<u2")
    packed = lambda rows, kind: pa.array([np.array(r, kind).tobytes() for r in rows], pa.binary())
    ids = packed([[99], [1, 2], [], [3], []], "<u2")[1:]
    at, which = packed([[0], [0, 2, 4], [0, 0], [], []], "<i4")[1:], packed([[0], [2, 0, 1], [0, 2], [], []], "<i4")[1:]
    got, stops = B.put_in(ids, at, which, new, "<u2")
    rows = [got[a:b].tolist() for a, b in zip(stops[:-1], stops[1:], strict=True)]
    assert rows == [[6, 7, 1, 5, 2, 9], [5, 6, 7], [3], []]


def test_no_plan_holds_the_ranks(spark):
    df = spark.createDataFrame([(1, "Hello there")], "doc_id long, text string")
    assert len(B.digests(df, PATH, P.PATTERN)._jdf.queryExecution().toString()) < 200_000


def test_two_arrow_passes_are_of_different_stages(spark):
    df = spark.createDataFrame([(k, f"some wordz{k}") for k in range(40)], "doc_id long, text string")
    plan = B.encode(df, PATH, P.PATTERN)._jdf.queryExecution().executedPlan().toString()
    steps = [x for x in plan.split() if x in ("MapInArrow", "Exchange")]
    assert steps[:3] == ["MapInArrow", "Exchange", "MapInArrow"]  # in one stage an executor would hold two Python workers a core


def test_long_words_and_kept_columns_of_blocks_of_one_row(spark, encoding):
    rows = [(k, {"a": [k, None]} if k % 2 else None, " x" * k + "é" * 200 + f" q{k}z") for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, more map<string, array<int>>, text string")
    for r in B.encode(df, PATH, P.PATTERN, block_chars=1, cache_words=10).collect():
        assert (r.more, np.frombuffer(bytes(r.ids), "<u4").tolist()) == (rows[r.doc_id][1], encoding.encode_ordinary(r.text))
