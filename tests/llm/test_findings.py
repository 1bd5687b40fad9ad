"""Cases in which an operator once did less than the whole job."""

import random

import public_tokenizers as P
import pytest

from weftline.llm import quality, toxicity

PIECES = P.path("piece_bpe_32k.model")
WORDS = "the of and house river light water stone garden under over people little great".split()


def varied(n, words=120, seed=1):
    rng = random.Random(seed)
    return [" ".join(rng.choice(WORDS) for _ in range(words)) for _ in range(n)]


def kept(spark, rows):
    df = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string")
    return {r.doc_id for r in quality.rate(df, PIECES).where("kept").collect()}


@pytest.mark.parametrize("near", [False, True])
def test_copies_do_not_narrow_bands(spark, near):
    rng = random.Random(2)
    copy = ["".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(3)) for _ in range(50)]
    copies = [" ".join(copy[:k] + [WORDS[i % 14]] + copy[k + 1 :]) if near else " ".join(copy) for i in range(400) for k in [rng.randrange(50)]]
    got = kept(spark, [(t, "en") for t in copies + varied(100)])
    assert len(got & set(range(400, 500))) >= 98


def test_small_classes_are_judged(spark):
    rng = random.Random(3)
    junk = " ".join("".join(chr(rng.randint(0x1200, 0x1250)) for _ in range(5)) for _ in range(40))
    rare = [(t, "xx") for t in varied(9, seed=4)]
    got = kept(spark, [(t, "en") for t in varied(200)] + rare + [(junk, "xx"), (junk, "yy")])
    assert {209, 210}.isdisjoint(got)
    assert len(got & set(range(200))) >= 198 and set(range(200, 209)) <= got


def test_long_texts_of_a_rare_language_stay(spark):
    rows = [(t, "en") for n in (60, 400, 3000) for t in varied(60, n, n)] + [(t, "xx") for n in (60, 400) for t in varied(30, n, n + 1)]
    assert len(kept(spark, rows + [(varied(1, 3000, 9)[0], "xx")]) & {len(rows)}) == 1


def test_one_misspelling_of_a_sure_term_is_toxic():
    verdicts = toxicity._Verdicts(toxicity.Matcher(toxicity.Lexicon({"idiot": 0.95, "idiom": 0.3}, frozenset({"idiots"}))))
    assert toxicity.score_text("you are an idi0t", verdicts) >= 0.7
    assert toxicity.score_text("what an idi0t move", verdicts) >= 0.7
    assert toxicity.score_text('they said "idi0t" once', verdicts) < 0.7 > toxicity.score_text("what an idiomx move", verdicts)
    assert toxicity.score_text("what idiots", verdicts) == 0


def test_copies_do_not_remove_terms(spark):
    rng = random.Random(5)
    toxic = [f"{rng.choice(WORDS)} {rng.choice(WORDS)} moron {rng.choice(WORDS)} {i}" for i in range(100)]
    texts = [(t, 1) for t in toxic + ["you moron of a copied text"] * 2000] + [(t, 0) for t in varied(100, 30)]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, x) for i, (_, x) in enumerate(texts)], "doc_id long, toxic int")
    terms = toxicity.fit(docs, labels).terms
    assert terms["moron"] == pytest.approx(101 / 103) and "copied" not in terms
