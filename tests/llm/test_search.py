import collections
import math
import random
import re

import numpy as np
import pytest

from tests.conftest import DATA
from weftline.llm import registry, search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, items, top=20):
    """All scores by the letter of the contract."""
    counted = [(i, collections.Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n, words = len(counted), sum(sum(c.values()) for _, c in counted)
    df = collections.Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        asked, scores = collections.Counter(TERM.findall((text or "").translate(LOWER))), []
        for i, c in counted:
            m = 75 + (25 * sum(c.values()) * n) // words
            score = sum(k * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m)) for t, k in asked.items())
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, k + 1, s[3], -s[0]) for k, s in enumerate(sorted(scores, key=lambda s: s[:3])[:top])]
    return sorted(out, key=str)


def got(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=str)


def test_query_by_the_letter(spark):
    docs, items = ([(r[0], r[1]) for r in spark.read.parquet(f"{DATA}/{t}.parquet").select(i, "text").collect()] for t, i in (("documents", "doc_id"), ("benchmark", "item_id")))
    assert got(registry.queries()["op11_search"](spark, DATA)) == plain(docs, items)


def odd(seed=4):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)] + ["Äh", "naïve", "x1", "日本", "A"]
    docs = [(k, rng.choice([" ", "-", "_,"]).join(rng.choices(words, weights=[1 / (j + 1) for j in range(len(words))], k=rng.randrange(1, 90)))) for k in range(400)]
    docs += [(5, docs[5][1]), (5, docs[5][1]), (None, docs[7][1]), (901, None), (902, ""), (903, "!!! ~"), (904, "w1 " * 200 + "w59 " * 3), (905, " ".join(f"u{j} w{j % 60}" for j in range(5000)))]
    items = [(k, " ".join(rng.choices(words, k=rng.randrange(1, 12)))) for k in range(25)] + [(100, None), (101, "?"), (102, "unknown"), (103, "w59 w59 W59"), (103, "w58"), (104, "w1"), (104, "w1")]
    return docs, items


@pytest.mark.parametrize("shares", [1_000, 7])
def test_every_kind(spark, monkeypatch, shares):
    monkeypatch.setattr(search, "ITEMS", shares)
    docs, items = odd()
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS width", "'x' AS term", "2 AS doc_ids")
    i = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS item", "2 AS doc_id")
    want = plain(docs, list(dict.fromkeys(items)))
    assert got(search.ranked(d, i)) == want


def test_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    one = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert search.ranked(none, one).count() == 0
    assert search.ranked(one.withColumnRenamed("item_id", "doc_id"), one.limit(0)).count() == 0
    assert search.ranked(none.unionByName(spark.createDataFrame([(1, "--")], "doc_id long, text string")), one).count() == 0


def test_bounds_are_no_less_than_scores_and_save_work():
    docs, items = odd(9)
    found = [collections.Counter(search.terms(t.encode())) for _, t in items if t]
    found = [f for f in found if f]
    texts = [t.encode() for _, t in docs if t and search.terms(t.encode())]
    df = collections.Counter(t for x in texts for t in set(search.terms(x)))
    query = search._Query(list(enumerate(found)), df, len(texts), sum(len(search.terms(x)) for x in texts))
    import pyarrow as pa

    blocks = [r for b in search._indexed([pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": pa.array(texts, pa.binary())})]) for r in b.to_pylist() if r["width"]]
    tight = []
    for b in blocks:
        bound = query.bounds(b["width"], b["slices"], np.array(b["lengths"]), np.array(b["highest"]))
        for d, text in enumerate(b["texts"]):
            exact = query.exact(text, b["lengths"][d])
            assert (bound[:, d] >= exact).all()
            tight.append(exact.sum() / max(1, bound[:, d].sum()))
    assert np.mean(tight) > 0.7 and sum(len(b["doc_ids"]) for b in blocks) == len(texts)
