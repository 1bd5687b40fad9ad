"""Whole licence texts in many spellings, against a canonicaliser in plain Python."""

import hashlib
import random
import re

import regex
from pyspark.sql import functions as F

from weftline.llm import licenses as L


def plain(text):
    out = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    out = re.sub(L.TITLE, "\n", out, count=1)
    out = re.sub(L.NUMBER, "\n", re.sub(L.COPYRIGHT, "\n", out))
    for other, usual in L.ALIKE:
        out = out.replace(other, usual)
    return regex.sub(L.NOT_WORD, " ", out).strip(" ")


def spelt(text, seed):
    """``text`` with another case, spelling, punctuation and width of lines, a title and copyright lines."""
    random.seed(seed)
    out = text.replace("sublicense", "sub-license").replace("NONINFRINGEMENT", "NON-INFRINGEMENT").replace("acknowledgment", "acknowledgement")
    out = "".join(c.upper() if random.random() < 0.1 else c for c in out).replace(", ", random.choice([",  ", " , ", "; "]))
    words, lines = out.replace("\n", " \n ").split(" "), [""]
    for w in words:
        if w == "\n" or len(lines[-1]) + len(w) > 60 + seed:
            lines.append("")
        lines[-1] += w.strip("\n") + " "
    head = random.choice(["The MIT License (MIT)\n\n", "ISC License\n", "BSD 3-Clause Licence\n\n", "", "\n"])
    return f"{head}Copyright (c) 20{seed:02} Someone <a@b.c>\nAll rights reserved.\n\n" + "\n".join(lines) + "\n"


def test_planted_licences(spark):
    whole = {k: t for k, t in L.KNOWN.items() if not k.endswith("notice")}
    rows = [(f"{k}/{seed}", k, spelt(t, seed)) for k, t in whole.items() for seed in range(6)]
    rows += [("changed", None, whole["MIT"].replace("free of charge", "for a charge")), ("more", None, whole["MIT"] + " And more.")]
    df = spark.createDataFrame(rows, "doc_id string, expected string, text string")
    got = {r.doc_id: r for r in L.scan(df).collect()}
    wrong = [i for i, k, _ in rows if got[i].license_id != k]
    assert not wrong
    assert all(got[i].license_digest == hashlib.sha256(plain(t).encode()).hexdigest() for i, _, t in rows)


def test_table_of_licences_and_odd_rows(spark):
    known = spark.createDataFrame([("b", "Our Terms. Do it."), ("a", "our terms; do it"), ("none", "..."), ("null", None)], "license_id string, text string")
    rows = [(1, "OUR TERMS: do it!"), (1, "OUR TERMS: do it!"), (2, None), (3, "?!"), (4, ""), (5, "word " * 300_000), (None, "our terms do it")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"LICENSE_ID": F.lit("x"), "digest": F.lit(1)})
    got = L.scan(df, known).collect()
    assert sorted((r.doc_id or 0, r.license_id or "") for r in got) == [(0, "a"), (1, "a"), (1, "a"), (2, ""), (3, ""), (4, ""), (5, "")]
    assert [r.license_digest for r in got if r.doc_id == 2] == [None]
    assert L.scan(df.limit(0), known).isEmpty() and L.scan(df, known.limit(0)).where("license_id IS NOT NULL").isEmpty()


def test_licences_from_files(spark, tmp_path):
    (tmp_path / "Long-2.0.txt").write_text("Long License\nVersion 2.0\n\n" + "1. Definitions, of many terms.\n" * 300)
    (tmp_path / "Other-1.0.md").write_text("Copyright (c) 2020 Somebody\nUse it as you like.")
    known = L.texts_of_files(spark, f"file://{tmp_path}")
    docs = spark.createDataFrame([(1, "LONG LICENSE\nversion 2.0\n" + "1) definitions of many terms\n" * 300), (2, "Use it, as you like!"), (3, "Use it.")], "doc_id long, text string")
    assert {r.doc_id: r.license_id for r in L.scan(docs, known).collect()} == {1: "Long-2.0", 2: "Other-1.0", 3: None}
