"""Quality rules with tokeniser fertility (operator 2).

``measure`` gives each whole text its base counts and, from a public
SentencePiece vocabulary with byte fallback, characters per token, the share of
byte-fallback tokens and the entropy of the tokens (in bits, over the most that
so many tokens can have).  Words are tokenised one by one, as pieces never
cross white space.

``judge`` derives a rejection band of each measure from all texts that pass the
base rules, per language and size class (powers of two of the number of
tokens): quartiles, widened by WIDTH times their distance and by at least
SLACK.  A text outside a band goes.  Copies and near copies (texts of the same
least hash of WINDOW words) count once in a class, so that they don't narrow its bands.

A class of fewer than MIN_GROUP such texts has wider bands: from the nearest
sizes of its language that make up MIN_GROUP texts (or all sizes), and from the
nearest sizes of all languages; what lies in either, or between the two, is
inside.  A language of fewer than LEAST texts has those of all languages alone.

Defined results: null counts as empty; a text without words fails the base
rules; null and '' are one language of its own; equal rows are judged alike,
each by itself; an end of a band is inside it; long texts are measured whole; an
empty table gives no rows; columns named like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import MEMO, blocks, materialise, replaced

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
WINDOW = 8
WIDTH, SLACK, MIN_GROUP = 3.0, {"chars_per_token": 0.4, "byte_share": 0.01, "entropy": 0.02}, 50
#: Quartiles of fewer texts say nothing of a language.
LEAST = 4
#: Up to so many bands go to every task; more are joined by a shuffle.
BROADCAST_BANDS = 20_000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FIELDS = [T.StructField(c, T.LongType()) for c in (*COUNTS, "n_tokens")] + [T.StructField(c, T.DoubleType()) for c in SLACK] + [T.StructField("__family", T.LongType())]


def repeated_words(words: list[bytes], hashes: dict[bytes, int], size: int = WINDOW) -> tuple[int, int]:
    """Words that lie in some window of ``size`` words which the text holds twice or more, and the least hash of a window."""
    n = len(words) - size + 1
    if n < 1:
        return 0, 0
    h = np.array(list(map(hashes.__getitem__, words)), np.uint64)
    with np.errstate(over="ignore"):
        windows = np.zeros(n, np.uint64)
        for i in range(size):
            windows = (windows ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
            windows ^= windows >> np.uint64(31)
    found, at, times = np.unique(windows, return_inverse=True, return_counts=True)
    family = int(found[0].astype(np.int64))
    twice = np.flatnonzero(times[at] > 1)
    if not len(twice):
        return 0, family
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, twice, 1)
    np.add.at(edges, twice + size, -1)
    return int((np.cumsum(edges) > 0).sum()), family


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(lines) - len(set(lines))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        self[word] = got = xxhash.xxh3_64_intdigest(word)
        return got


class _Pieces(dict):
    """Token ids of each word, packed; bounded."""

    def __init__(self, model_path: str):
        self.encode = sentencepiece.SentencePieceProcessor(model_file=model_path).encode

    def __missing__(self, word: str) -> bytes:
        got = np.array(self.encode(word), np.uint16).tobytes()
        if len(word) <= 40:
            if len(self) >= MEMO:
                self.clear()
            self[word] = got
        return got


def measure(df: DataFrame, model_path: str, text_col: str = "text") -> DataFrame:
    """``df`` with the base counts, n_tokens, chars_per_token, byte_share and entropy of each text.

    ``model_path`` holds the vocabulary on every machine.
    """
    schema = replaced(df.schema, *FIELDS)
    names = {f.name for f in FIELDS}
    keep, position = [i for i, c in enumerate(df.columns) if c.lower() not in names], df.columns.index(text_col)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, pieces = _Hashes(), _Pieces(model_path)
        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        size = model.get_piece_size()
        is_byte = np.array([model.is_byte(i) for i in range(size)])

        def row(text: str) -> tuple:
            words = text.encode("utf-8", "surrogatepass").split()
            chars = len(text) - sum(map(text.count, SPACES))
            times = np.bincount(np.frombuffer(b"".join(map(pieces.__getitem__, text.split())), np.uint16), minlength=size)
            n, some = int(times.sum()), times[times > 0]
            repeated, family = repeated_words(words, hashes)
            entropy = float(np.log2(n) - (some * np.log2(some)).sum() / n) if n else 0.0
            return (
                len(words), chars, sum(map(text.count, SYMBOLS)), duplicate_lines(text), repeated, n,
                chars / n if n else 0.0, float(times[is_byte].sum() / n) if n else 0.0, entropy / np.log2(n) if n > 1 else 0.0, family,
            )

        for batch in blocks(batches, position):
            rows = [row(t or "") for t in batch.column(position).to_pylist()]
            made = zip(*rows, strict=True) if rows else [[] for _ in FIELDS]
            types = [pa.int64()] * (len(COUNTS) + 1) + [pa.float64()] * len(SLACK) + [pa.int64()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), *(pa.array(x, t) for x, t in zip(made, types, strict=True))], schema.names)

    return df.mapInArrow(compute, schema)


def judge(measured: DataFrame, lang_col: str = "lang", digest_col: str = "text_digest") -> DataFrame:
    """``measured`` with base_failed and kept; ``digest_col`` tells texts apart.  It is read twice: pass a written table."""
    size = F.floor(F.log2(F.greatest("n_tokens", F.lit(1))))
    rows = measured.withColumns(
        {
            "base_failed": (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")),
            "__lang": F.coalesce(F.col(f"`{lang_col}`"), F.lit("")),
            "__size": size,
        }
    )
    quartiles = [F.percentile_approx(c, F.array(F.lit(0.25), F.lit(0.75)), 10_000).alias(f"__{c}") for c in SLACK]
    # one text of each family stands for it
    texts = materialise(rows.where("NOT base_failed").groupBy("__lang", "__size", "__family").agg(*[F.min_by(c, digest_col).alias(c) for c in SLACK]))
    classes = materialise(texts.groupBy("__lang", "__size").agg(F.count("*").alias("__n")))  # a row for each language and size class
    few = classes.count() <= BROADCAST_BANDS
    own = _bands(texts, classes, ["__lang"], few)
    sizes = classes.groupBy("__size").agg(F.sum("__n").alias("__n"), F.min("__n").alias("__least"))
    shared = _bands(texts, sizes.drop("__least"), [], few, sizes.where(F.col("__least") < MIN_GROUP).select("__size"))
    sure, some = F.col("__n") >= MIN_GROUP, F.col("__own_of") >= LEAST
    ends = [
        F.when(sure, F.col(f"__own_{end}_{c}")).when(some, pick(f"__own_{end}_{c}", f"__all_{end}_{c}")).otherwise(F.col(f"__all_{end}_{c}")).alias(f"__{end}_{c}")
        for c in SLACK
        for end, pick in (("low", F.least), ("high", F.greatest))
    ]
    named = lambda df, name, keys: df.select(*keys, *[F.col(c).alias(f"__{name}_{c}") for c in df.columns if c not in keys])
    bands = classes.join(named(own, "own", ["__lang", "__size"]), ["__lang", "__size"]).join(F.broadcast(named(shared, "all", ["__size"])), "__size", "left")
    bands = materialise(bands.select("__lang", "__size", *ends))
    inside = F.lit(True)
    for c in SLACK:
        inside &= F.coalesce(F.col(c).between(F.col(f"__low_{c}"), F.col(f"__high_{c}")), F.lit(True))
    out = rows.join(F.broadcast(bands) if few else bands, ["__lang", "__size"], "left").withColumn("kept", ~F.col("base_failed") & inside)
    return out.drop("__lang", "__size", "__family", *(f"__{end}_{c}" for end in ("low", "high") for c in SLACK))


def _bands(texts: DataFrame, classes: DataFrame, within: list[str], few: bool, wanted: DataFrame | None = None) -> DataFrame:
    """(*within, __size, of, low_c, high_c for each measure c) of ``classes`` (*within, __size, __n), or of the ``wanted`` sizes.

    A class takes its own texts and, as long as they are fewer than MIN_GROUP,
    those of the nearest other sizes; ``of`` is how many.
    """
    other = classes.select(*within, F.col("__size").alias("__near"), F.col("__n").alias("__m"))
    asking = classes.drop("__n") if wanted is None else wanted
    pairs = (asking.join(other, within) if within else asking.crossJoin(other)).withColumn("__far", F.abs(F.col("__size") - F.col("__near")))
    nearer = Window.partitionBy(*within, "__size").orderBy("__far").rangeBetween(Window.unboundedPreceding, -1)
    taken = pairs.withColumn("__nearer", F.coalesce(F.sum("__m").over(nearer), F.lit(0))).where(F.col("__nearer") < MIN_GROUP).select(*within, "__size", "__near")
    quartiles = [F.percentile_approx(c, F.array(F.lit(0.25), F.lit(0.75)), 10_000).alias(c) for c in SLACK]
    members = texts.withColumnRenamed("__size", "__near").join(F.broadcast(taken) if few else taken, [*within, "__near"])
    found = members.groupBy(*within, "__size").agg(F.count("*").alias("of"), *quartiles)
    ends = []
    for c, slack in SLACK.items():
        low, high = F.get(c, 0), F.get(c, 1)
        reach = F.greatest(WIDTH * (high - low), F.lit(slack))
        ends += [(low - reach).alias(f"low_{c}"), (high + reach).alias(f"high_{c}")]
    return found.select(*within, "__size", "of", *ends)


def rate(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of ``df``: id_col, a digest of the text, lang_col, all measures, base_failed and kept."""
    columns = df.select(id_col, F.xxhash64(text_col).alias("text_digest"), lang_col, text_col)
    return judge(materialise(measure(columns, model_path, text_col).drop(text_col)), lang_col)


def keep(df: DataFrame, model_path: str, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``df`` that are kept.  The verdict depends on text and language only, so equal rows stay or go together."""
    digest, lang = F.md5(F.coalesce(text_col, F.lit("")).cast("binary")), F.coalesce(F.col(f"`{lang_col}`"), F.lit(""))
    columns = df.select(digest.alias("__digest"), lang.alias("__of"), F.col(f"`{lang_col}`"), text_col)
    judged = judge(materialise(measure(columns, model_path, text_col).drop(text_col)), lang_col, "__digest")
    gone = judged.where("NOT kept").select("__digest", "__of").distinct()
    return df.join(gone, (digest == F.col("__digest")) & (lang == F.col("__of")), "left_anti")
