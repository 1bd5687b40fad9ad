"""The pipeline against a plain version of each stage, on Python lists."""

import collections
import hashlib

import numpy as np
import public_tokenizers as P
import tiktoken
from conftest import DATA
from test_dedup import brute
from test_texts import PIECES, base, distance

from weftline.llm import byte_bpe, mixing, quality, toxicity

#: The smallest table has too few labels for a lexicon.
LARGER = "/root/testdata/sf0.01"


def plain_score(text, lexicon, seen):
    tokens = (text or "").lower().split()
    hits = []
    for i, token in enumerate(tokens):
        w = token.strip(toxicity.EDGE)
        if not w:
            continue
        if w not in seen:
            near = [weight for t, weight in lexicon.terms.items() if abs(len(t) - len(w)) < 2 and distance(w, t) < 2]
            fuzzy = near and len(w) >= toxicity.MIN_FUZZY and w not in lexicon.clean
            seen[w] = lexicon.terms[w] if w in lexicon.terms else toxicity.FUZZY * max(near) if fuzzy else None
        if seen[w] is not None:
            hits.append((i, seen[w]))
    return 1 - np.exp(-toxicity.STEEPNESS * toxicity.evidence(tokens, hits))


def test_pipeline_is_its_plain_version(spark):
    import corpus_pipeline

    docs, labels = (spark.read.parquet(f"{LARGER}/{t}.parquet") for t in ("documents", "labels"))
    schema, rows = docs.schema, docs.collect()
    lexicon, seen = toxicity.fit(docs, toxicity.training_labels(labels)), {}
    assert lexicon.terms
    kept = [r for r in rows if plain_score(r.text, lexicon, seen) < 0.7]
    assert len(kept) < len(rows)
    verdicts = {r.doc_id: r for r in quality.rate(spark.createDataFrame(kept, schema), PIECES).collect()}
    assert all(verdicts[r.doc_id].base_failed == base(r.text)[-1] for r in kept)
    kept = [r for r in kept if verdicts[r.doc_id].kept]
    _, components = brute([(r.doc_id, r.text) for r in kept], 5, 80)
    kept = [r for r in kept if components[r.doc_id] == r.doc_id]
    taken = {r.doc_id: r for r in mixing.plan(spark.createDataFrame(kept, schema)).collect()}
    times = {i: int(np.floor(r.taken / r["size"] + 0.5)) if r.taken else 0 for i, r in taken.items()}
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(P.path(corpus_pipeline.VOCAB)), special_tokens={})
    expected = collections.Counter()
    for r in kept:
        ids = np.array(encoding.encode_ordinary(r.text), "<u4")
        expected[r.doc_id, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest()] += times[r.doc_id]
    got = collections.Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, LARGER).collect())
    assert got == +expected


def test_stages_return_documents(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = spark.createDataFrame([(10**9, None, None, None, None), (10**9 + 1, "", "en", "src0", 0), (10**9 + 1, "", "en", "src0", 0)], docs.schema)
    for some in (docs.unionByName(odd), docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, some, DATA).columns == docs.columns, name
    assert corpus_pipeline.STAGES[-1][1](spark, odd, DATA).count() == 3
