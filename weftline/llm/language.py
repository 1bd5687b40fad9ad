"""Language identification by rank-order profiles (operator 4).

After Cavnar and Trenkle, "N-Gram-Based Text Categorization" (1994).  A text's
profile is its TOP most frequent n-grams of 1 to 3 letters, words padded with
a space, most frequent first.  ``fit`` adds up the n-grams of a bounded sample
of the rows it is given (at most ``max_documents`` of each language, by a hash of
the id).  Every language with a row is learned.  ``predict`` takes the language whose profile has the least
out-of-place distance: the sum, over the document's n-grams, of how far each
one's rank is from its rank in the profile, or TOP where the profile lacks it.

The score is how far the best distance is below the second, against the second.

Defined results: a text that is null or has no letter is ``und`` with score 0,
and so is every text if nothing was learned; with one language learned its
score is 1; a null id isn't held out; a language of few texts is learned from
those; long texts are read whole; repeated rows are predicted alike; an empty table
gives no rows; ties between n-grams go by their code points and ties between
languages by their names; other columns are passed on, those named like an
output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blocks, replaced

TOP = 400
#: Parts of a language whose least hashes make up its sample.
SPREAD = 16
#: Code points take 21 bits; shorter n-grams have zeros in front.
BITS = np.uint64(21)
NOT_LETTERS = regex.compile(r"\P{L}+")


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the text's 1- to 3-grams and how often each occurs."""
    words = NOT_LETTERS.sub(" ", (text or "").lower()).strip(" ")
    if not words:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    c = np.frombuffer(f" {words} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    space = c == 32
    two = (c[:-1] << BITS) | c[1:]
    three = (two[:-1] << BITS) | c[2:]
    return np.unique(np.concatenate([c[~space], two, three[~space[1:-1]]]), return_counts=True)


def ranked(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The TOP most frequent codes, most frequent first, ties by code."""
    return codes[np.lexsort((codes, -counts))[:TOP]]


def sample(rows: DataFrame, most: int) -> DataFrame:
    """At most ``most`` rows of each lang of ``rows`` (lang, key, text): those of the least keys' hashes, copies of a key by text.

    Languages are dealt to SPREAD parts, so that none meets in one task whole; Spark
    cuts each part to ``most`` before it is shuffled.
    """
    hashed = rows.select("lang", F.xxhash64("key").alias("h"), F.xxhash64("text").alias("t"), "text").withColumn("part", F.pmod("h", F.lit(SPREAD)))
    order = [F.col("h"), F.col("t")]
    part = Window.partitionBy("lang", "part").orderBy(*order)
    few = hashed.withColumn("place", F.row_number().over(part)).where(F.col("place") <= max(1, most // SPREAD))
    return few.select("lang", "text")


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *, max_documents: int = 4_096) -> dict[str, list[int]]:
    """Profile (ranked n-gram codes) of each language, from at most ``max_documents`` rows of it."""
    names = {"lang": F.col(f"`{lang_col}`").cast("string"), "key": F.col(f"`{id_col}`").cast("string"), "text": F.col(f"`{text_col}`")}
    rows = df.select(*[c.alias(n) for n, c in names.items()]).where("lang IS NOT NULL AND text IS NOT NULL")
    # the share of a language's rows that gives twice as many as are taken: only those are sorted
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n")).withColumn("share", 2.0 * max_documents / F.col("n"))
    chosen = rows.join(sizes, "lang").where(F.pmod(F.xxhash64("key", F.lit(1)), F.lit(1_000_000)) < F.col("share") * 1_000_000)
    chosen = sample(chosen.select("lang", "key", "text"), max_documents)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, 1):
            for lang in set(langs := batch.column(0).to_pylist()):
                found = [grams(t) for x, t in zip(langs, batch.column(1).to_pylist(), strict=True) if x == lang]
                codes, at = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
                times = np.bincount(at, np.concatenate([n for _, n in found]), len(codes)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes.astype(np.int64)), pa.array(times)], ["lang", "gram", "n"])

    counts = chosen.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # Spark cuts each task's rows of a language to the TOP best before they are shuffled
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram")).alias("place")
    profiles: dict[str, list[int]] = {}
    for r in counts.select("lang", "gram", place).where(F.col("place") <= TOP).orderBy("lang", "place").collect():
        profiles.setdefault(r.lang, []).append(r.gram)
    return profiles


def plain_distances(ranks: np.ndarray, profiles: dict[str, list[int]]) -> dict[str, int]:
    """Out-of-place distance of a document's ranked n-grams to each profile, one by one (what the tests hold ``_Places`` against)."""
    out = {}
    for lang, codes in profiles.items():
        place = {c: i for i, c in enumerate(codes)}
        out[lang] = sum(abs(place[c] - i) if c in place else TOP for i, c in enumerate(ranks.tolist()))
    return out


class _Places:
    """Ranks of all profiles' n-grams in one table: a row for each n-gram."""

    def __init__(self, profiles: dict[str, list[int]]):
        self.langs = sorted(profiles)
        self.codes = np.unique(np.array([c for x in self.langs for c in profiles[x]], np.uint64))
        self.place = np.full((len(self.codes) + 1, len(self.langs)), -1, np.int16)
        for k, lang in enumerate(self.langs):
            self.place[np.searchsorted(self.codes, np.array(profiles[lang], np.uint64)), k] = np.arange(len(profiles[lang]))

    def distances(self, ranks: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.codes, ranks)
        at[(at >= len(self.codes)) | (self.codes[np.minimum(at, len(self.codes) - 1)] != ranks)] = len(self.codes)
        place = self.place[at]
        return np.where(place < 0, TOP, np.abs(place - np.arange(len(ranks))[:, None])).sum(axis=0)

    def predict(self, text: str | None) -> tuple[str, float]:
        codes, counts = grams(text)
        if not len(codes) or not self.langs:
            return "und", 0.0
        far = self.distances(ranked(codes, counts))
        order = np.argsort(far, kind="stable")
        if len(order) == 1:
            return self.langs[0], 1.0
        best, second = float(far[order[0]]), float(far[order[1]])
        return self.langs[order[0]], (second - best) / second if second else 0.0


def predict(df: DataFrame, profiles: dict[str, list[int]], text_col: str = "text") -> DataFrame:
    """``df`` with lang_pred and score."""
    schema = replaced(df.schema, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()))
    position = df.columns.index(text_col)
    keep = [i for i, c in enumerate(df.columns) if c in schema.names[:-2]]

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = _Places(profiles)
        for batch in blocks(batches, position):
            found = [places.predict(t) for t in batch.column(position).to_pylist()]
            made = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), *made], schema.names)

    return df.mapInArrow(compute, schema)


def identify(df: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learned from the rows whose crc32 of the id's text isn't 0 modulo 5."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    profiles = fit(df.where(~held_out), "doc_id")
    return predict(df.select("doc_id", "text"), profiles).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
