"""Toxicity, quality, licences, language, mixing and the pipeline on small inputs."""

import collections
import gzip
import random
import re

import public_tokenizers as P
import pytest
from compare import rows, sql_rows
from conftest import DATA
from pyspark.sql import functions as F

from weftline.llm import language, licenses, main_text, mixing, quality, registry, toxicity, warc

SQL = registry.oracle_sql()
PIECES = P.path("piece_bpe_32k.model")


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, name):
    assert rows(registry.queries()[name](spark, DATA)) == sql_rows(duck, SQL[name])


def distance(a, b):
    """Edits of one letter and swaps of two neighbours."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row, last = [i], rows[-1]
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                row[-1] = min(row[-1], rows[i - 2][j - 2] + 1)
        rows.append(row)
    return rows[-1][-1]


def test_swapped_letters_are_one_edit():
    m = toxicity.Matcher(toxicity.Lexicon({"idiot": 1.0, "idler": 0.9}, frozenset({"dilot"})))
    found = {w: m.weight(w) for w in ("idiot", "idoit", "diiot", "idito", "ildier", "iidot", "odiit", "idlre")}
    assert found == {"idiot": 1.0, **dict.fromkeys(("idoit", "diiot", "idito", "iidot"), toxicity.FUZZY), "ildier": None, "odiit": None, "idlre": toxicity.FUZZY * 0.9}


def test_automaton_is_edit_distance():
    random.seed(8)
    terms = {"".join(random.choice("abc") for _ in range(random.randint(4, 7))): 1.0 for _ in range(25)}
    m = toxicity.Matcher(toxicity.Lexicon(terms, frozenset()))
    for _ in range(4000):
        w = "".join(random.choice("abcd") for _ in range(random.randint(0, 9)))
        d = min(distance(w, t) for t in terms)
        assert m.weight(w) == (1.0 if d == 0 else toxicity.FUZZY if d == 1 and len(w) >= toxicity.MIN_FUZZY else None), w


def test_context_separates_quotation():
    verdicts = toxicity._Verdicts(toxicity.Matcher(toxicity.Lexicon({"idiot": 0.9}, frozenset())))
    plain, heated = toxicity.score_text("what an idiot move", verdicts), toxicity.score_text("you idiot and again idiot", verdicts)
    quoted = toxicity.score_text('they said the word "idiot" once', verdicts)
    assert quoted < plain < heated
    assert toxicity.score_text("what an idi0t move", verdicts) > 0 == toxicity.score_text(None, verdicts) == toxicity.score_text("", verdicts)


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.classify(docs.select("doc_id", "text"), labels).join(labels, "doc_id").where("held_out").select("toxic", "predicted").collect()
    right = sum(r.toxic == r.predicted for r in got)
    assert right / len(got) > 0.95 and not any(r.predicted and not r.toxic for r in got)


def test_toxicity_without_labels(spark):
    df = spark.createDataFrame([(1, "an idiot"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in toxicity.classify(df, none).collect()] == [0.0, 0.0]


def base(text):
    """Base rules by the letter of their definition."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    twice = collections.Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if twice[w] > 1 for k in range(8)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 20 or 100 * len(repeated) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(repeated), failed


def test_base_rules(spark):
    random.seed(9)
    texts = [None, "", " \n ", "a\x0bb\x0cc　d", "x " * 40, "one\ntwo\none\n\n \none", "# a | b & <c>"]
    texts += ["".join(random.choice("ab \n\t#é") for _ in range(random.randint(0, 200))) for _ in range(60)]
    texts += [" ".join(random.choice("abc") for _ in range(random.randint(1, 60))) for _ in range(60)]
    df = spark.createDataFrame([(i, t, None if i % 3 else "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    for r in quality.rate(df, PIECES).collect():
        assert tuple(r[c] for c in (*quality.COUNTS, "base_failed")) == base(texts[r.doc_id])
        assert not (r.base_failed and r.kept)
    assert quality.rate(df.limit(0), PIECES).count() == 0


def test_bands_reject_outliers_and_keep_the_rest(spark):
    random.seed(10)
    word = lambda: random.choice("the of and house river light water stone garden under over people little great".split())
    good = [" ".join(word() for _ in range(120)) for _ in range(200)]
    bad = [" ".join("".join(chr(random.randint(0x1200, 0x1250)) for _ in range(5)) for _ in range(40)) for _ in range(3)]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(good + bad)], "doc_id long, text string, lang string")
    kept = {r.doc_id for r in quality.rate(df, PIECES).where("kept").collect()}
    assert len(kept & set(range(200))) >= 198
    assert quality.keep(df, PIECES).count() == len(kept)


def test_licences(spark):
    mit = "Copyright (c) 2020 Someone\n" + licenses.KNOWN["MIT"].replace("sublicense", "sub-licence").upper().replace(", ", " ,\n")
    df = spark.createDataFrame([(1, mit), (2, licenses.KNOWN["ISC"] + " more"), (3, None), (4, "..."), (5, licenses.KNOWN["BSD-3-Clause"])], "doc_id long, text string")
    got = {r.doc_id: r.license_id for r in licenses.scan(df).collect()}
    assert got == {1: "MIT", 2: None, 3: None, 4: None, 5: "BSD-3-Clause"}


def test_places_are_plain_distances():
    random.seed(11)
    words = lambda letters: " ".join("".join(random.choice(letters) for _ in range(5)) for _ in range(200))
    profiles = {x: language.ranked(*language.grams(words(a))).tolist() for x, a in (("p", "abcde"), ("q", "cdefg"), ("r", "xyzéa"))}
    places = language._Places(profiles)
    for letters in ("abc", "efg", "xyé", "mn"):
        r = language.ranked(*language.grams(words(letters)))
        assert places.distances(r).tolist() == [language.plain_distances(r, profiles)[x] for x in places.langs]


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").select("lang", "lang_pred").collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.95
    odd = spark.createDataFrame([(1, None, "en"), (2, "123 !", "en"), (3, "the house", None)], "doc_id long, text string, lang string")
    assert {r.doc_id: r.lang_pred for r in language.identify(odd).collect()}[2] == "und"


def test_mix(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = spark.createDataFrame([(10**9, None, None), (10**9 + 1, "", "zero"), (10**9 + 1, "", "zero"), (10**9 + 2, "only words", None)], "doc_id long, text string, source string")
    both = docs.select("doc_id", "text", "source").unionByName(odd)
    plan = mixing.plan(both).join(both.select("doc_id", "source").distinct(), "doc_id")
    assert plan.where("taken > 2 * size OR taken < 0").count() == 0
    sums = plan.distinct().groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.first("source_size").alias("size")).collect()
    assert all(abs(r.taken - r.target) <= 64 + 1 and r.target <= 2 * r.size for r in sums)
    assert abs(sum(r.target for r in sums) - 1.5 * sum(r["size"] for r in sums)) < 1e-6 * sum(r["size"] for r in sums)
    again = mixing.plan(both.repartition(7))
    assert rows(again) == rows(mixing.plan(both))
    assert mixing.plan(both.limit(0)).count() == 0


PAGES = [
    ("<html><body><nav><a href=x>Menu</a></nav><article><h1>T &amp; U</h1><p>One,  two\n three<p>Four <b>five</b><br>six</article><div class='comments'><p>I say, no, no, never, at all, to this</p></div><footer>f</footer></body></html>", "T & U\n\nOne, two three\n\nFour five six"),
    ("<div class=sidebar><p>side, a, b, c, d</p></div><div id=main><p>Body text, long enough.</p><ul><li>x<li>y</ul></div><form><p>send, it</p></form>", "Body text, long enough.\n\nx\n\ny"),
    ("plain text", "plain text"), ("", ""), (None, ""), ("<script>var a='<p>no</p>'</script>", ""), ("<div>" * 3000 + "<p>deep</p>", "deep"),
]


def test_main_text(spark):
    df = spark.createDataFrame([(i, "u", h, "old") for i, (h, _) in enumerate(PAGES)], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in main_text.extract(df).collect()}
    assert [got[i].text for i in range(len(PAGES))] == [t for _, t in PAGES]
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_warc_pushdown_and_empty(spark, tmp_path):
    big = "x" * 1200
    df = spark.createDataFrame([(1, "http://a\r\nb", big), (2, None, big), (3, "http://c", "small"), (4, "http://d", "small"), (5, "http://e", None), (6, "http://f", "é" * 600)], "page_id long, url string, html string")
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(df).collect()}
    assert got == {1: (1200, "revisit", 2), 2: (1200, "response", None), 3: (5, "response", None), 4: (5, "response", None), 5: (0, "response", None), 6: (1200, "response", None)}
    path = f"file://{tmp_path}/w"
    warc.write_archives(df, path)
    seen = warc.read_archives(spark, path).where("warc_type = 'response' AND target_uri LIKE 'http://c%'")
    assert [bytes(r.payload) for r in seen.collect()] == [b"small"]
    assert warc.read_archives(spark, path, payload=False).where("payload IS NOT NULL").count() == 0
    assert warc.round_trip(df.limit(0)).count() == 0


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_warc_writes_add_up(spark, tmp_path, compression):
    rows = [(i, f"http://{i}", "p" * 1500) for i in range(4)]
    df = spark.createDataFrame(rows + rows[:1], "page_id long, url string, html string").withColumns({"payload": F.lit(1), "ID": F.lit(2), "sha": F.lit("x")})
    path = f"file://{tmp_path}/w"
    warc.write_archives(df, path, compression=compression)
    warc.write_archives(df.where("page_id = 3"), path, compression=compression)
    got = collections.Counter((r.record_id, r.warc_type) for r in warc.read_archives(spark, path).collect())
    assert got == {("<urn:page:3>", "response"): 2, ("<urn:page:0>", "revisit"): 2, ("<urn:page:1>", "revisit"): 1, ("<urn:page:2>", "revisit"): 1}
    assert warc.read_archives(spark, path, payload=False).where("content_length > 0").count() == 2


def test_warc_beside_archives_of_others(spark, tmp_path):
    path = f"file://{tmp_path}"
    (tmp_path / "theirs.warc").write_bytes(warc.record({"warc_type": "response", "record_id": "<r>", "payload": b"x"}, "2024-01-01T00:00:00Z"))
    (tmp_path / "part-0123456789ab-0-7-0.warc").write_bytes(b"left by a task that wasn't committed")
    assert warc.read_archives(spark, path).count() == 1
    warc.write_archives(spark.createDataFrame([(1, "http://a", "y")], "page_id long, url string, html string"), path)
    assert sorted(r.record_id for r in warc.read_archives(spark, path).collect()) == ["<r>", "<urn:page:1>"]


def test_warc_of_others(spark, tmp_path):
    records = [warc.record({"warc_type": t, "record_id": f"<{t}>", "payload": b"x" * 3000}, "2024-01-01T00:00:00Z") for t in ("warcinfo", "request", "response")]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    (tmp_path / "b.warc").write_bytes(b"".join(records))
    (tmp_path / "notes.txt").write_text("no archive")
    found = warc.read_archives(spark, f"file://{tmp_path}")
    assert found.count() == 6 and [len(r.payload) for r in found.where("warc_type = 'response'").collect()] == [3000, 3000]
    for name, cut in (("b.warc", lambda x: x[:-700]), ("a.warc.gz", lambda _: b"".join(map(gzip.compress, [*records[:2], records[2][:-700]])))):
        whole = (tmp_path / name).read_bytes()
        (tmp_path / name).write_bytes(cut(whole))
        for payload in (True, False):
            with pytest.raises(Exception, match="ends inside"):
                warc.read_archives(spark, f"file://{tmp_path}", payload=payload).collect()
        (tmp_path / name).write_bytes(whole)
