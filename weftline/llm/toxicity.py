"""Toxicity by a misspelling-tolerant lexicon and context windows (operator 1).

``fit`` learns a lexicon from a bounded sample of labelled rows
(``max_documents``, smallest hash of the id first) in which each text counts
once a label: words that occur in at least MIN_DOCUMENTS toxic texts, beside as
many different neighbours, and hardly in other ones.

``score`` runs every word of every whole text through the product of a
Levenshtein automaton of distance 1 (a swap of two neighbours is one edit) and the trie of the lexicon.  The product
is made deterministic as words ask for its states.  Words that the sample's
clean documents hold are no misspellings.  Each hit counts by its distance (one
unquoted misspelling of a sure term is enough for a score of 0.7),
by how surely the sample shows its term (n of n + clean + 2 documents) and by the WINDOW words on either side: less inside quotation marks or after a word
of reporting, more beside other hits or a second-person pronoun.

Defined results: null, empty and blank texts score 0; an empty or one-sided
sample gives an empty lexicon, so all scores are 0; repeated rows are scored
alike; a null id isn't held out and labels nothing; words of any length are looked
up; the driver holds the words of the sample's toxic texts that may be terms, and
the words of its clean texts that are near one; other columns are passed on, those named like an output are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import MEMO, blocks, materialise, replaced

MIN_DOCUMENTS, MIN_SHARE, MIN_FUZZY = 5, 0.9, 5
#: Letters of the shortest term.
SHORTEST = 4
WINDOW = 6
# FUZZY: a misspelling of a term of weight MIN_SHARE still scores 1 - exp(-STEEPNESS * 0.9 * 0.85) = 0.706
FUZZY, QUOTED, HEATED, STEEPNESS = 0.85, 0.5, 1.25, 1.6
QUOTES = "\"'“”‘’«»„`"
EDGE = QUOTES + ".,;:!?()[]{}<>*#$%&|~^_-+=/\\…"
# fixed values: words of reporting and second-person pronouns (English, German, French, Spanish)
REPORTING = frozenset("said says say called calls wrote writes quote quoted quotes word words term terms phrase sagte sagt nannte wort dit disait appelle mot dijo dice llamó palabra".split())
SECOND = frozenset("you your you're youre yourself u du dich dir dein ihr tu te toi vous votre tú ti usted ustedes".split())


#: A node of the trie, the edits so far, and the letter that must come next where two have changed places.
Item = tuple[int, int, str]


class Lexicon(NamedTuple):
    terms: dict[str, float]  # and how much an exact hit counts
    clean: frozenset[str]  # near a term, but in clean documents


class Matcher:
    """How much a word counts: by its term if it is one, FUZZY times its surest term at distance 1, None further off."""

    def __init__(self, lexicon: Lexicon):
        self.terms, self.clean = lexicon.terms, lexicon.clean
        self.next: list[dict[str, int]] = [{}]  # the trie
        self.final = [0.0]  # the weight of the term that ends here
        for term in sorted(lexicon.terms):
            node = 0
            for c in term:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.final.append(0.0)
                node = self.next[node][c]
            self.final[node] = lexicon.terms[term]
        self.sets: list[frozenset[Item]] = []
        self.number: dict[frozenset[Item], int] = {}
        self.moves: list[dict[str, int]] = []
        self.accepts: list[tuple[int, float] | None] = []
        self.dead = self._state(frozenset())
        self.start = self._state(frozenset({(0, 0, "")} | {(m, 1, "") for m in self.next[0].values()}))

    def _state(self, found: frozenset[Item]) -> int:
        if found not in self.number:
            self.number[found] = len(self.sets)
            self.sets.append(found)
            self.moves.append({})
            self.accepts.append(min(((e, -self.final[n]) for n, e, wanted in found if self.final[n] and not wanted), default=None))
        return self.number[found]

    def _move(self, state: int, c: str) -> int:
        """Items after one more letter; a term's letter missing in the word is an edit too, and so are two that change places."""
        after: set[Item] = set()
        for node, edits, wanted in self.sets[state]:
            if wanted:
                if c == wanted:
                    after.add((node, edits, ""))
                continue
            if c in self.next[node]:
                after.add((self.next[node][c], edits, ""))
            if edits == 0:
                after.add((node, 1, ""))
                for x, m in self.next[node].items():
                    after.add((m, 1, ""))
                    if x != c and c in self.next[m]:
                        after.add((self.next[m][c], 1, x))
        after |= {(m, 1, "") for node, edits, _ in after if edits == 0 for m in self.next[node].values()}
        self.moves[state][c] = to = self._state(frozenset(after))
        return to

    def weight(self, word: str) -> float | None:
        state, moves, dead = self.start, self.moves, self.dead
        for c in word:
            to = moves[state].get(c)
            state = self._move(state, c) if to is None else to
            if state == dead:
                return None
        found = self.accepts[state]
        if found is None:
            return None
        edits, weight = found[0], -found[1]
        if edits == 0:
            return weight
        return FUZZY * weight if len(word) >= MIN_FUZZY and word not in self.clean else None


class _Verdicts(dict):
    """How much each white-space separated token counts; bounded."""

    def __init__(self, matcher: Matcher):
        self.weight = matcher.weight

    def __missing__(self, token: str) -> float | None:
        if len(self) >= MEMO:
            self.clear()
        got = self.weight(token.strip(EDGE))
        if len(token) < 64:
            self[token] = got
        return got


def evidence(tokens: list[str], hits: list[tuple[int, float]]) -> float:
    """Sum over the hits (position, weight) by weight and context window."""
    total = 0.0
    for k, (i, weight) in enumerate(hits):
        before, after = tokens[max(0, i - WINDOW) : i], tokens[i + 1 : i + 1 + WINDOW]
        token = tokens[i]
        quoted = (token[0] in QUOTES or any(t[0] in QUOTES and t[-1] not in QUOTES for t in before)) and (
            token.rstrip(".,;:!?")[-1:] in QUOTES or any(t.rstrip(".,;:!?")[-1:] in QUOTES for t in after)
        )
        words = {t.strip(EDGE) for t in before}
        heated = any(abs(j - i) <= WINDOW for j, _ in hits[max(0, k - 1) : k + 2] if j != i) or not SECOND.isdisjoint(words | {t.strip(EDGE) for t in after})
        total += weight * (QUOTED if quoted or not REPORTING.isdisjoint(words) else 1) * (HEATED if heated else 1)
    return total


def score_text(text: str | None, verdicts: dict[str, float | None]) -> float:
    tokens = (text or "").lower().split()
    found = list(map(verdicts.__getitem__, tokens))
    hits = [(i, d) for i, d in enumerate(found) if d is not None] if len(found) > found.count(None) else []
    return 1 - math.exp(-STEEPNESS * evidence(tokens, hits)) if hits else 0.0


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", *, max_documents: int = 40_000) -> Lexicon:
    """Lexicon from at most ``max_documents`` rows of ``labels`` (id_col, label_col) and their texts in ``df``."""
    ids = F.col(f"`{id_col}`").cast("long")
    chosen = labels.select(ids.alias("id"), F.col(f"`{label_col}`").alias("label")).where("id IS NOT NULL AND label IS NOT NULL").orderBy(F.xxhash64("id"), "id").limit(max_documents)
    # the broadcast side holds at most max_documents rows of 12 bytes
    rows = df.select(ids.alias("id"), F.col(f"`{text_col}`").alias("text")).join(F.broadcast(chosen), "id")
    rows = rows.withColumn("digest", F.xxhash64("text")).groupBy("label", "digest").agg(F.first("text").alias("text"))
    rows = materialise(rows)  # read three times

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).to_pylist():
                tokens = ["", *((text or "").lower().split()), ""]
                seen = {t.strip(EDGE): xxhash.xxh3_64_intdigest(f"{tokens[i - 1]} {tokens[i + 1]}") - 2**63 for i, t in enumerate(tokens[1:-1], 1)}
                seen = {w: beside for w, beside in seen.items() if len(w) >= SHORTEST}
                yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "beside"])

    toxic = rows.where("label = 1").select("text").mapInArrow(contexts, "word string, beside long")
    # a term occurs in MIN_DOCUMENTS toxic texts; in one of twenty, three at least, where they are few
    least = max(3, min(MIN_DOCUMENTS, math.ceil(rows.where("label = 1").count() / 20)))
    found = toxic.groupBy("word").agg(F.count("*").alias("n"), F.approx_count_distinct("beside").alias("ways")).where((F.col("n") >= least) & (F.col("ways") >= least))
    # as many as the sample's toxic texts have words, at most
    candidates = dict(found.select("word", "n").toArrow().to_pandas().itertuples(index=False))

    def counted(keep) -> DataFrame:
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            test = keep()
            for batch in batches:
                for text in batch.column(0).to_pylist():
                    seen = [w for w in {t.strip(EDGE) for t in (text or "").lower().split()} if test(w)]
                    yield pa.RecordBatch.from_arrays([pa.array(seen, pa.string())], ["word"])

        clean = rows.where("label = 0").select("text").mapInArrow(count, "word string")
        return clean.groupBy("word").agg(F.count("*").alias("n"))

    words = frozenset(candidates)
    inside = {r.word: r.n for r in counted(lambda: words.__contains__).collect()}
    terms = {w: n / (n + inside.get(w, 0) + 2) for w, n in candidates.items() if n >= MIN_SHARE * (n + inside.get(w, 0))}
    draft = Lexicon(terms, frozenset())

    def near():
        matcher = Matcher(draft)
        return lambda w: w not in terms and matcher.weight(w) is not None

    clean = frozenset(r.word for r in counted(near).select("word").collect())
    return Lexicon(terms, clean)


def score(df: DataFrame, lexicon: Lexicon, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``df`` with ``out_col``: 0 to 1, higher where the text is likelier toxic."""
    schema = replaced(df.schema, T.StructField(out_col, T.DoubleType()))
    position = df.columns.index(text_col)
    keep = [i for i, c in enumerate(df.columns) if c in schema.names[:-1]]

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        verdicts = _Verdicts(Matcher(lexicon))
        for batch in blocks(batches, position):
            scores = [score_text(t, verdicts) for t in batch.column(position).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(scores, pa.float64())], schema.names)

    return df.mapInArrow(compute, schema)


def training_labels(labels: DataFrame) -> DataFrame:
    """The rows of ``labels`` that may be learned from: crc32 of the id's text isn't 1 modulo 3."""
    return labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)


def classify(df: DataFrame, labels: DataFrame, *, cut: float = 0.7) -> DataFrame:
    """``df`` with held_out, score and predicted (1 where score >= cut)."""
    scored = score(df, fit(df, training_labels(labels)))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return scored.withColumns({"held_out": held_out, "predicted": (F.col("score") >= cut).cast("int")})
