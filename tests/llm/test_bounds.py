"""No word, language, class or table is left out for its length, rarity or size."""

import collections

from conftest import DATA
from pyspark.sql import functions as F

from weftline.llm import language, toxicity


def test_padded_and_long_words_are_scored():
    verdicts = toxicity._Verdicts(toxicity.Matcher(toxicity.Lexicon({"idiot": 0.95, "x" * 90: 0.95}, frozenset())))
    for word in ("*" * 60 + "idiot", "idiot" + "!" * 200, "x" * 90, "x" * 89, "." * 70 + "idi0t"):
        assert toxicity.score_text(f"a {word} b", verdicts) >= 0.7, word


def test_small_table_has_a_lexicon(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.classify(docs, labels).join(labels, "doc_id")
    got = collections.Counter((r.toxic, r.predicted) for r in scored.where("toxic IS NOT NULL").collect())
    assert got[1, 1] >= 0.5 * (got[1, 1] + got[1, 0]) and got[0, 1] == 0, got


def test_toxicity_of_odd_tables(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    odd = spark.createDataFrame([(None, "you"), (1, None), (1, None), (2, "word " * 200_000)], "doc_id long, text string")
    got = toxicity.classify(docs.unionByName(odd).withColumns({"Score": F.lit("x"), "label": F.lit(1)}), labels)
    assert got.where("held_out IS NULL OR score IS NULL OR predicted IS NULL").isEmpty() and got.count() == docs.count() + 4
    assert toxicity.classify(docs.limit(0), labels).isEmpty()


def test_six_hundred_languages(spark):
    letters = [chr(0x4E00 + i) for i in range(1200)]
    rows = [(k, " ".join([letters[2 * k] * 3, letters[2 * k + 1] * 2] * 5), f"l{k:03}") for k in range(600)]
    profiles = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    places = language._Places(profiles)
    assert len(profiles) == 600 and all(places.predict(t)[0] == lang for _, t, lang in rows)


def test_profiles_are_counted_by_the_letter(spark):
    rows = [(1, "Abc ab", "a"), (2, "abc", "a"), (2, "abc", "a"), (3, "xyz", "b"), (4, None, "b"), (None, "xy", "b"), (5, "q", None)]
    profiles = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))

    def plain(texts):
        seen = collections.Counter()
        for t in texts:
            padded = " " + t.lower() + " "
            for n in (1, 2, 3):
                seen.update(g for g in (padded[i : i + n] for i in range(len(padded) - n + 1)) if g != " " and not (n == 3 and g[1] == " "))
        code = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
        return [code(g) for g in sorted(seen, key=lambda g: (-seen[g], code(g)))]

    assert profiles == {"a": plain(["abc ab", "abc", "abc"]), "b": plain(["xyz", "xy"])}


def test_language_of_odd_tables(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(None, "x", "en"), (1, "", "en"), (1, "", "en"), (2, "wort " * 200_000, "de")], docs.schema)
    got = language.identify(docs.unionByName(odd).withColumns({"Score": F.lit("x"), "part": F.lit(1), "key": F.lit(2)}))
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"] and got.count() == docs.count() + 4
    assert got.where("held_out IS NULL OR lang_pred IS NULL OR score < 0 OR score > 1").isEmpty()
    assert language.identify(docs.limit(0)).isEmpty()

    copies = docs.where("lang = 'en'").limit(1).crossJoin(spark.range(5000).select("id")).select(F.col("id").alias("doc_id"), "text", "lang")
    named = copies.select("lang", F.col("doc_id").cast("string").alias("key"), "text")
    assert 0 < language.sample(named, 320).count() <= 320
