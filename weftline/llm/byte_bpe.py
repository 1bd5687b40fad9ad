r"""Byte-level BPE encoding and decoding (operator 7).

``encode`` adds ``ids``: the token ids as packed little-endian unsigned 32-bit
integers, and where ``decoded_col`` is named also the bytes that they stand for.
``decode`` turns a column of such ids into bytes by joining the pieces of the ids.

Plan of ``encode`` (no shuffle of texts):

1. A bounded sample of documents (about ``cache_docs``) gives the most frequent
   words.  Each is folded once; the at most ``cache_words`` results of at most
   64 bytes each are broadcast.  The cache only saves work.
2. An Arrow pass cuts each text into words by the pattern and resolves those
   that are in the cache.  A block of documents (about ``block_chars``
   characters) becomes one row, with the distinct other words beside it.
3. A fold of ranked merges, written with Spark's higher-order functions over
   arrays of bytes and a constant rank map, encodes the distinct words of a block.
   The map travels with the words (2 MB a block), not in the plan.
4. A shuffle deals out the blocks, so the two Arrow passes are of different
   stages: an executor holds one Python worker a core, not two.
5. An Arrow pass puts the ids in place and joins the pieces of all ids.  Words
   over ``long_word`` bytes, for which the fold's time is quadratic, are merged
   there with a heap.

The texts enter only the first pass and no shuffle, unless ``keep`` names their column.

Ranks must be those of trained merges: each token of several bytes arises from
its bytes by merges of rising rank (``check_ranks``; ValueError otherwise).
Then two pairs of one rank never overlap unless they are the same pair, so the
least entry of a word is the merge to make.

Defined results: a null or empty text has no ids and decodes to no bytes;
repeated rows are encoded one by one; ties between equal ranks go to the
leftmost pair; an empty table gives no rows; very long texts are one row each;
input columns named like an output column are replaced.
"""

from __future__ import annotations

import base64
import heapq
import json
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from itertools import accumulate, chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from public_tokenizers import PATTERN
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blocks, let, materialise, replaced

#: Ids are below 2 ** BITS; the rank of a pair that doesn't merge; the id beside a word's ends.
BITS, NONE, END = 17, 1 << 17, (1 << 17) - 1
#: White_Space characters of Unicode: what \s of the pattern stands for.
WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"
#: Texts in which a run of white space may hold a word of several separators.
IRREGULAR = f"[{WHITE}]{{3}}|[{WHITE}]{{2}}$"
#: Parts that stand for one word of letters, with the space before it, and at most one sign that is a word by itself.
MARKS = ".,;:!?"
SIMPLE = f"^[A-Za-zÀ-ÖØ-öø-ÿ]+[{MARKS}]?$"
#: Bytes of packed ids that are put in place at once.
PLACED = 1 << 18
RANKS = "struct<d:array<bigint>,e:array<bigint>>"


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a ``.tiktoken`` vocabulary file: one base64 token and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())}


def merge_long(word: bytes, ranks: dict[bytes, int], made: list[int] | None = None) -> list[int]:
    """Ids of one word by ranked merges with a heap, in O(n log n); the ranks merged are added to ``made``."""
    n = len(word)
    end, left, right, alive = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
    heap = [(ranks[word[i : i + 2]], i, i + 2) for i in range(n - 1) if word[i : i + 2] in ranks]
    heapq.heapify(heap)
    while heap:
        merged, i, stop = heapq.heappop(heap)
        j = right[i] if alive[i] else n
        if j >= n or end[j] != stop:
            continue
        if made is not None:
            made.append(merged)
        alive[j], end[i], right[i] = False, stop, right[j]
        if right[i] < n:
            left[right[i]] = i
            if (rank := ranks.get(word[i : end[right[i]]])) is not None:
                heapq.heappush(heap, (rank, i, end[right[i]]))
        if left[i] >= 0 and (rank := ranks.get(word[left[i] : stop])) is not None:
            heapq.heappush(heap, (rank, left[i], stop))
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


def check_ranks(ranks: dict[bytes, int]) -> None:
    """ValueError unless all single bytes are tokens and each other token arises by merges of rising rank."""
    if max(ranks.values(), default=0) >= END or any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("a vocabulary needs all 256 bytes and ids below 2 ** 17 - 1")
    for token, rank in ranks.items():
        made: list[int] = []
        if merge_long(token, ranks, made) != [rank] or made != sorted(made):
            raise ValueError(f"token {rank} doesn't arise by merges of rising rank")


def rank_map(ranks: dict[bytes, int]) -> tuple[list[int], list[int | None]]:
    """The ranks as a map from a pair of ids to the id of both, in two arrays, d and e.

    A pair's key is left * 2**BITS + right.  Keys fall into groups by key % size(d);
    ``e`` holds key * 2**BITS + rank in slot (key + d[group]) % size(e), where
    d[group] is such that no two keys share a slot.  So e XOR key * 2**BITS is the
    rank of a pair that merges; for any other it is null or not below 2**BITS.
    """
    pairs = {}
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                pairs[(left << BITS) + right] = rank
    n_groups, n_slots = len(pairs) // 3 | 1, len(pairs) * 9 // 8 | 1
    groups: dict[int, list[int]] = {}
    for key in pairs:
        groups.setdefault(key % n_groups, []).append(key)
    shift, entries = [0] * n_groups, [None] * n_slots
    slot = 0
    for group, keys in sorted(groups.items(), key=lambda x: -len(x[1])):
        while True:
            slot = (slot + 1) % n_slots
            at = slot - keys[0]
            if entries[slot] is None and len(slots := {(k + at) % n_slots for k in keys}) == len(keys) and all(entries[i] is None for i in slots):
                break
        shift[group] = at % n_slots
        for k in keys:
            entries[(k + at) % n_slots] = (k << BITS) + pairs[k]
    return shift, entries


def rank_literal(ranks: dict[bytes, int]) -> tuple[Column, int, int]:
    """``rank_map`` as a literal, and the sizes of its arrays."""
    shift, entries = rank_map(ranks)
    literal = F.from_json(F.lit(json.dumps({"d": shift, "e": entries}, separators=(",", ":"))), RANKS)
    return literal, len(shift), len(entries)


class _Ranks:
    """``rank_map`` for an Arrow pass, which sends it with each block of words.

    As a literal it would be 3 MB of text in each plan, which the driver keeps for every query it has run.
    """

    def __init__(self, ranks: dict[bytes, int]):
        shift, entries = rank_map(ranks)
        self.sizes = len(shift), len(entries)
        self.d, self.e, self.empty = np.array(shift, np.int64), np.array([x or 0 for x in entries], np.int64), np.array([x is None for x in entries])

    def row(self) -> pa.Array:
        lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (pa.array(self.d), pa.array(self.e, mask=self.empty))]
        return pa.StructArray.from_arrays(lists, ["d", "e"])


def fold_words(words: Column, ranks: tuple[Column, int, int]) -> Column:
    """Ids of each word of ``words`` by ranked merges; ``ranks`` is what ``rank_literal`` returns, or a column of the same.

    A word is an array of the ids of its single bytes.  The fold's state is an
    array with one number for each two neighbours (the word's ends are END): the
    rank of their merge or NONE, then both ids.  Each step takes the least
    number, which names the merge and both pieces, and puts in the two numbers
    of the merged piece and its neighbours.  Lambdas are interpreted, so a pair's
    key is a value of its own that is computed once, and ``filter`` by position
    stands for ``slice``, which takes several times as long on short arrays.
    """
    table, n_groups, n_slots = ranks

    def encode(d: Column, e: Column) -> Column:
        def key(left: Column, right: Column) -> Column:
            return F.shiftleft(left, BITS).bitwiseOR(right)

        def number(key: Column) -> Column:
            slot = (F.get(d, (key % n_groups).cast("int")) + key) % n_slots
            rank = F.get(e, slot.cast("int")).bitwiseXOR(F.shiftleft(key, BITS))
            return F.shiftleft(F.least(rank, F.lit(NONE).cast("long")), 2 * BITS).bitwiseOR(key)

        def left(x: Column) -> Column:
            return F.shiftright(x, BITS).bitwiseAND(F.lit(END).cast("long"))

        def merge(state: Column, piece: Column, at: Column) -> Column:
            before, after = left(F.get(state, at - 2)), F.get(state, at).bitwiseAND(F.lit(END).cast("long"))
            merged = F.transform(F.array(key(before, piece), key(piece, after)), number)
            return F.concat(F.filter(state, lambda _, i: i < at - 2), merged, F.filter(state, lambda _, i: i > at))

        def step(state: Column, _: Column) -> Column:
            def at_least(least: Column) -> Column:
                at = F.array_position(state, least).cast("int")
                return F.when(least < NONE << 2 * BITS, let(at, lambda at: merge(state, F.shiftright(least, 2 * BITS), at))).otherwise(state)

            return let(F.array_min(state), at_least)

        def word(w: Column) -> Column:
            end = F.array(F.lit(END).cast("long"))
            start = F.transform(F.zip_with(F.concat(end, w), F.concat(w, end), key), number)
            return F.aggregate(F.sequence(F.lit(2), F.size(w)), start, step, lambda state: F.filter(F.transform(state, left), lambda _, i: i > 0))

        return F.transform(words, lambda w: F.when(F.size(w) < 2, w).otherwise(word(w)))

    return let(table["d"], lambda d: let(table["e"], lambda e: encode(d, e)))


def apart(left: str, right: str) -> bool:
    """Whether the words on both sides of the space between two parts don't depend on each other."""
    return bool(left and right) and left[-1] not in WHITE and right[0] not in WHITE


def parts_of(text: str, irregular: bool) -> list[str]:
    """``text`` in parts whose words don't depend on each other, for the pattern of ``public_tokenizers``.

    The first part is as in the text.  Any other begins with a line feed, or stands
    for a space and itself.  White space between two other characters is a word of
    all but its last character, then either one more word or, where that is a
    space, the beginning of the next word; so runs of at most two characters can be
    cut before each space and line feed.  ``irregular`` texts are cut only at
    single spaces between other characters.
    """
    if not irregular:
        return text.replace("\n", " \n").split(" ")
    out: list[str] = []
    last = ""
    for part in text.split(" "):
        if out and not apart(last, part):
            out[-1] += " " + part
        else:
            out.append(part)
        last = part
    return out


def irregular_texts(texts: pa.Array) -> list[bool]:
    return pc.fill_null(pc.match_substring_regex(texts, IRREGULAR), False).to_pylist()


class _Known:
    """Packed ids of known words, found by bisection on 64-bit hashes: a fifth of a dict's memory in each Python worker."""

    def __init__(self, arrays: tuple[bytes, ...]):
        hashes, stops, words, id_stops, ids = arrays
        self.hashes, self.order = memoryview(hashes).cast("Q"), np.frombuffer(hashes, np.uint64)
        self.stops, self.words = memoryview(stops).cast("I"), words
        self.id_stops, self.ids = memoryview(id_stops).cast("I"), ids
        self.table = pa.Array.from_buffers(pa.binary(), len(self.hashes), [None, pa.py_buffer(stops), pa.py_buffer(words)])

    @staticmethod
    def packed(words: pa.Array, ids: np.ndarray, counts: np.ndarray) -> tuple[bytes, ...]:
        """The arrays of distinct ``words`` (binary) with ``counts`` of the packed ``ids`` each, to be broadcast; no object for each word is held."""
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w.as_py()) for w in words), np.uint64, len(words))
        order = np.argsort(hashes, kind="stable")
        taken = words.take(pa.array(order))
        stops = np.concatenate(([0], np.cumsum(pc.binary_length(taken).to_numpy())))
        text = b"".join(w.as_py() for w in taken) if len(taken) else b""
        begins, sizes = (np.cumsum(counts) - counts)[order], counts[order]
        ends = np.cumsum(sizes)
        flat = ids[np.repeat(begins - (ends - sizes), sizes) + np.arange(sizes.sum())]
        return hashes[order].tobytes(), stops.astype(np.uint32).tobytes(), text, (np.concatenate(([0], ends)) * ids.itemsize).astype(np.uint32).tobytes(), flat.tobytes()

    def places(self, words: pa.Array) -> np.ndarray:
        """Where each of ``words`` (binary) stands among the known ones; -1 for unknown ones."""
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words.to_numpy(zero_copy_only=False)), np.uint64, len(words))
        if not len(self.order) or not len(words):
            return np.full(len(words), -1)
        places = np.minimum(np.searchsorted(self.order, hashes), len(self.order) - 1)
        same = pc.equal(self.table.take(pa.array(places)), words).to_numpy(zero_copy_only=False)
        for k in np.flatnonzero(~same & (self.order[places] == hashes)).tolist():  # different words of one hash
            places[k] = self.place(words[k].as_py())
            same[k] = places[k] >= 0
        return np.where(same, places, -1)

    def place(self, word: bytes) -> int:
        """As ``places`` for one word."""
        h = xxhash.xxh3_64_intdigest(word)
        i = bisect_left(self.hashes, h)
        while i < len(self.hashes) and self.hashes[i] == h:
            if self.words[self.stops[i] : self.stops[i + 1]] == word:
                return i
            i += 1
        return -1

    def get(self, word: bytes) -> bytes | None:
        i = self.place(word)
        return self.ids[self.id_stops[i] : self.id_stops[i + 1]] if i >= 0 else None


class _Cutter:
    """Cuts texts into words and resolves those whose ids are known."""

    def __init__(self, pattern: str, known: _Known | None):
        self.find, self.plain, self.known = regex.compile(pattern).findall, pattern == PATTERN, known
        self.start()

    def start(self) -> None:
        """A new block: no unknown words so far."""
        self.rest: dict[bytes, int] = {}

    def words(self, unit: str) -> list[bytes]:
        return [w.encode("utf-8", "surrogatepass") for w in self.find(unit)]

    def text_words(self, text: str, irregular: bool) -> list[bytes]:
        """The words of a text that isn't cut by Arrow."""
        if not self.plain:
            return self.words(text)
        first, *others = parts_of(text, irregular)
        return self.words(first) + [w for part in others for w in self.words(part if part[:1] == "\n" else " " + part)]


class _Cut(NamedTuple):
    """Of each text: the packed ids of its known words, and where (in bytes) which unknown words go (packed integers)."""

    ids: list[bytes]
    at: list[bytes]
    which: list[bytes]


def _runs(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Each run of ``counts`` numbers from ``starts`` on, one behind the other."""
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)


def _part_words(cutter: _Cutter, names: pa.Array, firsts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different words of parts behind the first of a text (``names``) and of the ``firsts``: the words, the number of each part's words, and which they are.

    Letters with at most one mark behind them, which most parts are, are cut by Arrow; others by the pattern.
    """
    simple = pc.match_substring_regex(names, SIMPLE).to_numpy(zero_copy_only=False)
    plain = names.filter(pa.array(simple))
    stems = pc.utf8_rtrim(plain, MARKS)
    marked = (pc.binary_length(plain).to_numpy() - pc.binary_length(stems).to_numpy()).astype(bool)
    marks = pc.utf8_slice_codeunits(plain.filter(pa.array(marked)), -1)
    others = [cutter.words(x if x[:1] == "\n" else " " + x) for x in names.filter(pa.array(~simple)).to_numpy(zero_copy_only=False)]
    others += map(cutter.words, firsts)
    parts = [pc.binary_join_element_wise("", stems, " ").cast(pa.binary()), marks.cast(pa.binary()), pa.array(list(chain.from_iterable(others)), pa.binary())]
    coded = pa.concat_arrays(parts).dictionary_encode()
    number = coded.indices.to_numpy()
    stem, mark, other = np.split(number, np.cumsum([len(x) for x in parts[:2]]))
    counts = np.ones(len(names) + len(firsts), np.int64)
    at_simple, at_other = np.flatnonzero(simple), np.concatenate((np.flatnonzero(~simple), np.arange(len(names), len(counts))))
    counts[at_simple] += marked
    counts[at_other] = np.fromiter(map(len, others), np.int64, len(others))
    starts = np.cumsum(counts) - counts
    which = np.empty(counts.sum(), np.int64)
    which[starts[at_simple]] = stem
    which[starts[at_simple[marked]] + 1] = mark
    which[_runs(starts[at_other], counts[at_other])] = other
    return coded.dictionary, counts, which


class _Words(NamedTuple):
    """The words of a block: the different ones, which of them stand one behind the other, where each text's begin and end, and the texts' order."""

    names: pa.Array
    word: np.ndarray
    stops: np.ndarray
    order: list[int]


def block_words(cutter: _Cutter, texts: pa.Array, irregular: list[bool]) -> _Words:
    """The words of a block's texts.  Regular texts are cut by Arrow, so that each distinct part is looked at once; other ones, which come last, one by one."""
    single = np.flatnonzero(irregular) if cutter.plain else np.arange(len(texts))
    regular = np.setdiff1d(np.arange(len(texts)), single)
    lists = pc.split_pattern(pc.replace_substring(pc.fill_null(texts.take(pa.array(regular)), ""), "\n", " \n"), " ")
    stops = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy())))
    parts = lists.flatten().dictionary_encode()
    index, names = parts.indices.to_numpy().astype(np.int64), parts.dictionary
    # the first part of a text is as it stands there, so it is cut by itself
    words, counts, which = _part_words(cutter, names, names.take(pa.array(index[stops[:-1]])).to_pylist())
    index[stops[:-1]] = len(names) + np.arange(len(regular))
    if len(single):
        alone = [cutter.text_words(texts[k].as_py() or "", irregular[k]) for k in single.tolist()]
        coded = pa.concat_arrays([words, pa.array(list(chain.from_iterable(alone)), pa.binary())]).dictionary_encode()
        number = coded.indices.to_numpy()
        words, which = coded.dictionary, np.concatenate((number[: len(words)][which], number[len(words) :]))
        index = np.concatenate((index, len(counts) + np.arange(len(single))))
        counts = np.concatenate((counts, np.fromiter(map(len, alone), np.int64, len(alone))))
        stops = np.concatenate((stops, stops[-1] + 1 + np.arange(len(single))))
    word = which[_runs((np.cumsum(counts) - counts)[index], counts[index])]
    return _Words(words, word, np.concatenate(([0], np.cumsum(counts[index])))[stops], np.concatenate((regular, single)).tolist())


def cut_block(cutter: _Cutter, texts: pa.Array, irregular: list[bool], dtype: str) -> _Cut:
    """Cuts the texts of a block; each distinct word is looked up once."""
    known, width = cutter.known, np.dtype(dtype).itemsize
    names, word, word_stops, order = block_words(cutter, texts, irregular)
    # of each distinct word: its ids among the known ones, or its number among the unknown ones
    places = known.places(names)
    new = np.flatnonzero(places < 0)
    numbers = np.full(len(names), -1)
    numbers[new] = [cutter.rest.setdefault(w, len(cutter.rest)) for w in names.take(pa.array(new)).to_numpy(zero_copy_only=False)]
    id_stops = np.frombuffer(known.id_stops, np.uint32).astype(np.int64) // width
    sizes = np.where(places < 0, 0, id_stops[places + 1] - id_stops[places])
    starts = np.concatenate(([0], np.cumsum(sizes[word])))
    begin = starts[word_stops]
    ids = np.frombuffer(known.ids, dtype)[_runs(id_stops[places[word]], sizes[word])].tobytes()
    holes = np.flatnonzero(numbers[word] >= 0)
    hole_stops = np.searchsorted(holes, word_stops)
    at = ((starts[holes] - np.repeat(begin[:-1], np.diff(hole_stops))) * width).astype("<i4").tobytes()
    gaps = numbers[word[holes]].astype("<i4").tobytes()
    out = _Cut([b""] * len(texts), [b""] * len(texts), [b""] * len(texts))
    for n, k in enumerate(order):
        out.ids[k] = ids[begin[n] * width : begin[n + 1] * width]
        out.at[k], out.which[k] = at[4 * hole_stops[n] : 4 * hole_stops[n + 1]], gaps[4 * hole_stops[n] : 4 * hole_stops[n + 1]]
    return out


def byte_lists(words: Sequence[bytes], single: np.ndarray) -> pa.Array:
    """Each word as a list of the ids of its single bytes."""
    offsets = np.fromiter(accumulate(map(len, words), initial=0), np.int32, len(words) + 1)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(single[np.frombuffer(b"".join(words), np.uint8)]))


def _flat(column: pa.Array, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """The packed integers of all rows, and where each row's begin and end."""
    stops = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return np.frombuffer(data[stops[0] : stops[-1]] if data else b"", dtype), (stops - stops[0]) // np.dtype(dtype).itemsize


def _packed(values: np.ndarray, stops: np.ndarray) -> pa.Array:
    """Rows of bytes out of ``values``, which begin and end at ``stops`` of them."""
    return pa.Array.from_buffers(pa.binary(), len(stops) - 1, [None, pa.py_buffer((stops * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


class _New(NamedTuple):
    """Ids of a block's unknown words: all of them, and where each word's begin and end."""

    ids: np.ndarray
    stops: np.ndarray

    @staticmethod
    def of(lists: pa.Array, long_words: list[bytes], ranks: dict[bytes, int], dtype: str) -> _New:
        """Of folded words; the ids of a long one, whose list is empty, are found here."""
        ids, stops = lists.flatten().to_numpy(zero_copy_only=False).astype(dtype), lists.offsets.to_numpy().astype(np.int64)
        stops = stops - stops[0]
        if not long_words:
            return _New(ids, stops)
        words, large = np.split(ids, stops[1:-1]), iter(long_words)
        words = [x if len(x) else np.array(merge_long(next(large), ranks), dtype) for x in words]
        return _New(np.concatenate(words), np.concatenate(([0], np.cumsum(list(map(len, words))))))


def put_in(ids: pa.Array, at: pa.Array, which: pa.Array, new: _New, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids of rows, with those of unknown words in place, and where each row's begin and end."""
    known, stops = _flat(ids, dtype)
    holes, hole_stops = _flat(at, "<i4")
    words = _flat(which, "<i4")[0]
    if not len(words):
        return known.astype("<u4"), stops
    holes = holes // np.dtype(dtype).itemsize + np.repeat(stops[:-1], np.diff(hole_stops))
    counts = np.diff(new.stops)[words]
    shift = np.concatenate(([0], np.cumsum(counts)))
    out = np.empty(len(known) + shift[-1], "<u4")
    out[np.arange(len(known)) + np.repeat(shift, np.diff(holes, prepend=0, append=len(known)))] = known
    out[_runs(holes + shift[:-1], counts)] = new.ids[_runs(new.stops[words], counts)]
    return out, stops + shift[hole_stops]


class _Pieces:
    """Joins the binary pieces of ids."""

    def __init__(self, ranks: dict[bytes, int]):
        pieces = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            pieces[rank] = token
        self.sizes = np.array([len(x) for x in pieces])
        self.starts = np.concatenate(([0], np.cumsum(self.sizes[:-1])))
        self.pool = np.frombuffer(b"".join(pieces), np.uint8)

    def __call__(self, ids: np.ndarray) -> bytes:
        return self.joined(ids, np.array([0, len(ids)]))[0].tobytes()

    def joined(self, ids: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of rows of ids, and where each row's begin and end."""
        sizes = self.sizes[ids]
        return self.pool[_runs(self.starts[ids], sizes)], np.concatenate(([0], np.cumsum(sizes)))[stops]


def _cache(df: DataFrame, text_col: str, pattern: str, ranks: dict[bytes, int], shared: Broadcast, sizes: tuple[int, int], cache_docs: int, cache_words: int, dtype: str) -> tuple[bytes, ...]:
    """Packed ids of all tokens and of the most frequent words of a bounded sample of documents, as ``_Known`` takes them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = _Cutter(pattern, None)
        for batch in blocks(batches, 0, 1 << 20):
            names, word, _, _ = block_words(cutter, batch.column(0), irregular_texts(batch.column(0)))
            found = pa.RecordBatch.from_arrays([names, pa.array(np.bincount(word, minlength=len(names)), pa.int64())], ["word", "n"])
            yield found.filter(pc.less_equal(pc.binary_length(names), 64))

    texts = df.select(F.col(f"`{text_col}`").alias("text"))
    total = texts.count()
    if total > cache_docs:
        texts = texts.sample(cache_docs / total, 7)
    counts = texts.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = counts.where("n > 1").orderBy(F.desc("n"), "word").limit(cache_words)
    single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value.row()
        for batch in batches:
            words = batch.column(0).cast(pa.binary())
            all_of_it = pa.array([0, len(words)], pa.int32())
            columns = [pa.ListArray.from_arrays(all_of_it, words), pa.ListArray.from_arrays(all_of_it, byte_lists(words.to_pylist(), single)), table]
            yield pa.RecordBatch.from_arrays(columns, ["words", "pieces", "ranks"])

    # written first, so that the words are ranked once
    chosen = materialise(top.select("word").repartition(df.sparkSession.sparkContext.defaultParallelism, "word"))
    pieces = chosen.mapInArrow(split, f"words array<binary>, pieces array<array<long>>, ranks {RANKS}")
    found = pieces.select("words", fold_words(F.col("pieces"), (F.col("ranks"), *sizes)).alias("ids")).toArrow()
    del counts, top, chosen, pieces
    # a word that is a token has its rank alone, which its fold gives too
    words = found.column("words").combine_chunks().flatten().cast(pa.binary())
    lists = found.column("ids").combine_chunks().flatten()
    values, sizes = lists.flatten().to_numpy(zero_copy_only=False).astype(dtype), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    tokens = pa.array(list(ranks), pa.binary())
    fresh = pc.invert(pc.is_in(tokens, value_set=words)).to_numpy(zero_copy_only=False)
    own = np.fromiter(ranks.values(), dtype, len(ranks))[fresh]
    out = _Known.packed(pa.concat_arrays([words, tokens.filter(pa.array(fresh))]), np.concatenate([values, own]), np.concatenate([sizes, np.ones(len(own), np.int64)]))
    del found, words, lists, tokens
    pa.default_memory_pool().release_unused()
    return out


def encode(
    df: DataFrame,
    vocab_path: str,
    pattern: str,
    text_col: str = "text",
    *,
    keep: Sequence[str] | None = None,
    decoded_col: str | None = None,
    cache_docs: int = 50_000,
    cache_words: int = 500_000,
    block_chars: int = 1 << 21,
    long_word: int = 256,
) -> DataFrame:
    """The columns ``keep`` of ``df`` (all, if None) and ``ids``: the packed ids of ``text_col``.  See the module's docstring."""
    ranks = read_ranks(vocab_path)
    check_ranks(ranks)
    rank_rows = _Ranks(ranks)
    dtype = "<u2" if max(ranks.values()) < 1 << 16 else "<u4"
    single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
    context = df.sparkSession.sparkContext
    sizes, rank_rows = rank_rows.sizes, context.broadcast(rank_rows)
    cache = context.broadcast(_cache(df, text_col, pattern, ranks, rank_rows, sizes, cache_docs, cache_words, dtype))
    all_ranks = context.broadcast(ranks)

    out = {"ids", (decoded_col or "ids").lower()}
    kept = [f for f in df.schema.fields if f.name.lower() not in out and (keep is None or f.name in keep)]
    parts = [T.StructField(f"c{k}", t) for k, t in enumerate([*(f.dataType for f in kept), *[T.BinaryType()] * 3])]  # kept columns, ids, at, which
    cut_schema = T.StructType(
        [
            T.StructField("__docs", T.ArrayType(T.StructType(parts))),
            T.StructField("__rest", T.ArrayType(T.ArrayType(T.LongType()))),
            T.StructField("__long", T.ArrayType(T.BinaryType())),
            T.StructField("__ranks", T.StructType([T.StructField(c, T.ArrayType(T.LongType())) for c in "de"])),
        ]
    )
    out_schema = T.StructType(kept + [T.StructField(c, T.BinaryType()) for c in ["ids", *([decoded_col] if decoded_col else [])]])
    n = len(kept)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, table = _Cutter(pattern, _Known(cache.value)), rank_rows.value.row()
        for block in blocks(batches, n, block_chars):
            cutter.start()
            rows = cut_block(cutter, block.column(n), irregular_texts(block.column(n)), dtype)
            words = list(cutter.rest)
            short = byte_lists([w if len(w) <= long_word else b"" for w in words], single)
            docs = pa.StructArray.from_arrays([*block.columns[:n], *(pa.array(r, pa.binary()) for r in rows)], [f.name for f in parts])
            columns = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (docs, short, pa.array([w for w in words if len(w) > long_word], pa.binary()))]
            yield pa.RecordBatch.from_arrays([*columns, table], cut_schema.names)
            del rows, words, short, docs, columns
        pa.default_memory_pool().release_unused()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        join = _Pieces(all_ranks.value) if decoded_col else None
        for batch in batches:
            for docs, rest, long_words in zip(*batch.columns, strict=True):
                new = _New.of(rest.values, long_words.as_py(), all_ranks.value, dtype)
                block = pa.RecordBatch.from_arrays(docs.values.flatten(), [f.name for f in parts])
                for some in blocks(iter([block]), n, PLACED):
                    ids, stops = put_in(*some.columns[n:], new, dtype)
                    results = [_packed(ids, stops), *([_packed(*join.joined(ids, stops))] if join else [])]
                    yield pa.RecordBatch.from_arrays([*some.columns[:n], *results], out_schema.names)
        pa.default_memory_pool().release_unused()

    columns = [F.col(f"`{f.name}`") for f in kept]
    first = df.select(*columns, F.col(f"`{text_col}`").alias("__text")).mapInArrow(cut, cut_schema)
    folded = first.select("__docs", fold_words(F.col("__rest"), (F.col("__ranks"), *sizes)).alias("__rest"), "__long", F.monotonically_increasing_id().alias("__block"))
    return folded.repartition("__block").drop("__block").mapInArrow(place, out_schema)


def decode(df: DataFrame, vocab_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``df`` with ``out_col``: the bytes that the packed ids of ``ids_col`` stand for."""
    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(vocab_path))
    schema = replaced(df.schema, T.StructField(out_col, T.BinaryType()))
    names, position = df.columns, df.columns.index(ids_col)
    keep = [i for i, c in enumerate(names) if c in schema.names[:-1]]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _Pieces(ranks.value)
        for batch in blocks(batches, position, 1 << 23):
            done = [pieces(np.frombuffer(x or b"", "<u4")) for x in batch.column(position).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(done, pa.binary())], schema.names)

    return df.mapInArrow(join, schema)


def digests(df: DataFrame, vocab_path: str, pattern: str) -> DataFrame:
    """The query's columns, from what ``encode`` returns."""
    coded = encode(df, vocab_path, pattern, keep=["doc_id"], decoded_col="decoded")
    return coded.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
